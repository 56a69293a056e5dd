"""Pixels to model inputs: resize, normalise, augment.

Images are decoded by the ``image`` reader; the work here runs inside Arrow
batches, one image after the other, on whatever partition its row is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Channel means and deviations of the usual photo corpus.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
# The training distortions and their strengths.
FLIP_SHARE, MAX_TURN, JITTER, HUE = 0.5, 15.0, 0.2, 0.05
#: Bytes of pixels that a task hands on at once, about.
OUTPUT_BYTES = 32 << 20
# Luma weights.
LUMA = np.array([0.299, 0.587, 0.114])

# All values of a channel: what depends on one value only is worked out once for each.
LEVELS = np.arange(256, dtype=float)

Image = np.ndarray  # height x width x 3, RGB, uint8


def to_rgb(data: bytes, height: int, width: int, channels: int) -> Image:
    """Decode the reader's row-major BGR, BGRA or grey bytes."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def _as_bytes(x: np.ndarray) -> np.ndarray:
    """Rounded to whole levels; ``x`` is overwritten."""
    x += 0.5
    np.floor(x, out=x)
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


@lru_cache(maxsize=256)
def _taps(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights, ``(n_out, taps)``, of a bilinear resize; shrinking widens the filter.

    Weights of one output sum to one; positions beyond an edge weigh nothing.
    """
    ratio = n_in / n_out
    reach = max(ratio, 1.0)
    center = (np.arange(n_out) + 0.5) * ratio
    at = np.floor(center - reach).astype(int)[:, None] + np.arange(int(np.ceil(2 * reach)) + 1)
    w = np.maximum(0.0, 1.0 - np.abs(at + 0.5 - center[:, None]) / reach) * ((at >= 0) & (at < n_in))
    return np.clip(at, 0, n_in - 1), w / w.sum(axis=1, keepdims=True)


def _squeeze(img: Image, n_out: int) -> Image:
    """Resize the first axis: a weighted sum of a few rows for each row of the output."""
    at, w = _taps(img.shape[0], n_out)
    out = np.zeros((n_out, *img.shape[1:]))
    part = np.empty_like(out)
    for k in range(at.shape[1]):
        out += np.multiply(w[:, k, None, None], img[at[:, k]], out=part)
    return _as_bytes(out)


def resize(img: Image, size: tuple[int, int]) -> Image:
    """Width first, then height, rounding to whole pixel values in between."""
    h, w = size
    if img.shape[1] != w:
        img = _squeeze(np.ascontiguousarray(img.transpose(1, 0, 2)), w).transpose(1, 0, 2)
    if img.shape[0] != h:
        img = _squeeze(np.ascontiguousarray(img), h)
    return img


def turn(img: Image, degrees: float) -> Image:
    """Rotate about the centre, nearest pixel, black outside."""
    h, w = img.shape[:2]
    a = np.deg2rad(degrees)
    dx, dy = np.arange(w) - (w - 1) / 2, (np.arange(h) - (h - 1) / 2)[:, None]
    sx = np.rint(np.cos(a) * dx - np.sin(a) * dy + (w - 1) / 2)
    sy = np.rint(np.sin(a) * dx + np.cos(a) * dy + (h - 1) / 2)
    outside = (sx < 0) | (sx >= w) | (sy < 0) | (sy >= h)
    sy *= w
    sy += sx
    sy[outside] = 0
    out = np.ascontiguousarray(img).reshape(-1, 3)[sy.astype(np.int32)]
    out[outside] = 0
    return out


def _grey(img: Image) -> np.ndarray:
    return np.floor(img @ LUMA + 0.5)


def _blend_level(img: Image, other: float, share: float) -> Image:
    """Towards one level, the same everywhere."""
    return _as_bytes(other + (LEVELS - other) * share)[img]


def _blend(img: Image, other: np.ndarray, share: float) -> Image:
    x = img.astype(float)
    x -= other
    x *= share
    x += other
    return _as_bytes(x)


def shift_hue(img: Image, shift: float) -> Image:
    """Move the hue by ``shift`` of a full turn; grey stays grey."""
    share = LEVELS / 255
    r, g, b = (np.ascontiguousarray(img[..., i]) for i in range(3))
    most = np.maximum(np.maximum(r, g), b)
    red, green = most == r, most == g
    high = share[most]
    span = high - share[np.minimum(np.minimum(r, g), b)]
    hue = share[np.where(red, g, np.where(green, b, r))]
    hue -= share[np.where(red, b, np.where(green, r, g))]
    hue /= np.where(span > 0, span, 1.0)
    hue += np.array([4.0, 2.0, 0.0])[np.where(red, 2, green)]
    hue /= 6
    hue += shift
    hue -= np.floor(hue)
    hue *= 6
    # channel n of a colour with this hue, brightest value and span
    out = np.empty(img.shape, np.uint8)
    for c, n in enumerate((5, 3, 1)):
        k = n + hue
        np.subtract(k, 6, out=k, where=k >= 6)
        np.minimum(k, 4 - k, out=k)
        np.clip(k, 0, 1, out=k)
        k *= span
        np.subtract(high, k, out=k)
        k *= 255
        out[..., c] = _as_bytes(k)
    return out


def jitter(img: Image, rng: np.random.Generator) -> Image:
    """Brightness, contrast, saturation and hue, in random order."""
    light, contrast, colour = rng.uniform(1 - JITTER, 1 + JITTER, 3)
    hue = rng.uniform(-HUE, HUE)

    steps: list[Callable[[Image], Image]] = [
        lambda x: _blend_level(x, 0.0, light),
        lambda x: _blend_level(x, np.floor(_grey(x).mean() + 0.5), contrast),
        lambda x: _blend(x, _grey(x)[:, :, None], colour),
        lambda x: shift_hue(x, hue),
    ]
    for i in rng.permutation(len(steps)):
        img = steps[i](img)
    return img


def distort(img: Image, rng: np.random.Generator) -> Image:
    if rng.random() < FLIP_SHARE:
        img = img[:, ::-1]
    return jitter(turn(img, rng.uniform(-MAX_TURN, MAX_TURN)), rng)


@dataclass(frozen=True)
class ImagePrep:
    """Model inputs from rows of ``scan_image_pixels``.

    Adds ``pixels array<float>``, channel after channel, and its shape ``c, h,
    w``.  Unreadable images are left out; ``validate_images`` reports them.
    """

    size: tuple[int, int] = (224, 224)
    mean: tuple[float, float, float] = CHANNEL_MEAN
    std: tuple[float, float, float] = CHANNEL_STD
    augment: bool = True

    def evaluation(self, df: DataFrame) -> DataFrame:
        """Resize, scale to 0..1, normalise: the same every time."""
        return self._run(df, None, True)

    def training(self, df: DataFrame, epoch: int = 0, seed: int = 42) -> DataFrame:
        """Like :meth:`evaluation` with random distortions in between.

        The draws depend on path, epoch and seed only, so a task that runs
        again yields the same pixels.
        """
        draws = F.xxhash64(F.col("path"), F.lit(epoch), F.lit(seed)) if self.augment else None
        return self._run(df, draws, True)

    def plain(self, df: DataFrame) -> DataFrame:
        """Resize and scale to 0..1, without normalising."""
        return self._run(df, None, False)

    def _run(self, df: DataFrame, draws, normalize: bool) -> DataFrame:
        size = self.size
        # The input for each level of each channel.
        inputs = np.repeat(LEVELS[None] / 255, 3, axis=0)
        if normalize:
            inputs = (inputs - np.array(self.mean)[:, None]) / np.array(self.std)[:, None]
        inputs = inputs.astype(np.float32)
        extra = [c for c in df.columns if c not in ("height", "width", "channels", "data")]
        ready = df.where("height > 0").select(
            *extra, "height", "width", "channels", "data", (F.lit(0) if draws is None else draws).cast("bigint").alias("__draw")
        )
        random = draws is not None

        def one(data: pa.Scalar, height: int, width: int, channels: int, draw: int) -> np.ndarray:
            img = resize(to_rgb(data.as_buffer(), height, width, channels), size)
            if random:
                img = distort(img, np.random.default_rng(draw & ((1 << 63) - 1)))
            return np.concatenate([inputs[c][img[:, :, c]].ravel() for c in range(3)])

        # Arrow arrays are made from the pixels as they are; pandas would make a list of numbers of each image.
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_image = 3 * size[0] * size[1]
            some = max(1, OUTPUT_BYTES // (4 * one_image))
            for whole in batches:
                for start in range(0, whole.num_rows, some):
                    batch = whole.slice(start, some)
                    numbers = (batch.column(c).to_pylist() for c in ("height", "width", "channels", "__draw"))
                    pixels = np.concatenate([one(*r) for r in zip(batch.column("data"), *numbers, strict=True)])
                    ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * one_image)
                    made = [pa.ListArray.from_arrays(ends, pa.array(pixels))]
                    made += [pa.array(np.full(batch.num_rows, n, np.int32)) for n in (3, *size)]
                    yield pa.record_batch([*(batch.column(c) for c in extra), *made], [*extra, "pixels", "c", "h", "w"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*extra).schema)
        return ready.mapInArrow(run, f"{fields}, pixels array<float>, c int, h int, w int")
