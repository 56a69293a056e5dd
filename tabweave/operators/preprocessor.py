"""Table and image preparation behind one constructor."""

from __future__ import annotations

from tabweave.operators.images import ImagePrep
from tabweave.operators.prep import TablePrep


class Preprocessor:
    """``table`` prepares numeric columns, ``image`` prepares pixels."""

    def __init__(
        self,
        table_scaler: str | None = "standard",
        table_impute: str | None = "mean",
        image_size: tuple[int, int] = (224, 224),
        augment: bool = True,
    ) -> None:
        self.table = TablePrep(scaler=table_scaler, impute=table_impute)
        self.image = ImagePrep(size=image_size, augment=augment)
