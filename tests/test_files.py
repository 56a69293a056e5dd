"""Readers and image operators on files written by the tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.models.images import fit_image_classifier, predict_images
from tabweave.operators import images as px
from tabweave.operators.preprocessor import Preprocessor
from tabweave.plans.derived_files import png
from tabweave.sources import images
from tabweave.sources.store import model_load, model_save
from tabweave.sources.files import preview, scan_csv, scan_dataset


def test_csv_types_and_missing_values(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('i,f,b,s,d,gone,mix\n1,1.5,True,"x, ""y""",2024-01-01,,1\nNA,nan,False,null,2024-01-02,NA,a\n3,1e3,,z,,N/A,2d\n')
    df = scan_csv(spark, str(f))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string", "gone": "double", "mix": "string"}
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (1, 1.5, True, 'x, "y"', "2024-01-01", None, "1")
    assert rows[1] == (None, None, False, None, "2024-01-02", None, "a")
    assert scan_csv(spark, str(f), schema="i int, f double, b boolean, s string, d date, gone int, mix string").dtypes[4] == ("d", "date")
    assert len(preview(df, 2).collect()) == 2
    assert scan_dataset(spark, str(f)).columns == df.columns


def test_csv_encoding_and_options(spark, tmp_path):
    f = tmp_path / "t.CSV"
    f.write_bytes("n;v\né;1\n".encode("latin-1"))
    assert scan_dataset(spark, str(f), encoding="latin1", sep=";").first().asDict() == {"n": "é", "v": 1}


def test_reader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_csv(spark, str(tmp_path / "no.csv"))
    with pytest.raises(FileNotFoundError):
        scan_dataset(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError):
        scan_dataset(spark, str(tmp_path / "a.xlsx"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(RuntimeError):
        scan_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "two.csv").write_text("a,b\n1,2\n")
    with pytest.raises(RuntimeError):
        scan_csv(spark, str(tmp_path / "two.csv"), schema="a int")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(0)
    for label, base in (("cat", 30), ("dog", 200)):
        (root / label / "deeper").mkdir(parents=True)
        for i in range(6):
            img = np.clip(base + rng.integers(-20, 20, (10, 12, 3)), 0, 255).astype(np.uint8)
            (root / label / f"{i}.png").write_bytes(png(img))
            (root / label / "deeper" / f"{i}.png").write_bytes(png(img))
    (root / "top.png").write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    (root / "cat" / "BROKEN.PNG").write_bytes(b"not an image")
    (root / "cat" / "note.txt").write_text("no")
    (root / "dog" / "sound.webp").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    (root / "dog" / "ok.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8 ")
    return str(root)


def names(rows):
    return sorted(r["path"].rsplit("/", 1)[1] for r in rows)


def test_image_folder(spark, folder, tmp_path):
    rows = images.scan_image_folder(spark, folder).collect()
    assert len(rows) == 15 and rows == sorted(rows, key=lambda r: (r["label"], r["path"]))
    assert {r["label"] for r in rows} == {"cat", "dog"}
    assert scan_dataset(spark, folder).count() == 15
    with pytest.raises(FileNotFoundError):
        images.scan_image_folder(spark, str(tmp_path / "none"))
    (tmp_path / "a").mkdir()
    with pytest.raises(ValueError):
        images.scan_image_folder(spark, str(tmp_path))


def test_image_status_and_headers(spark, folder):
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in images.image_status(spark, folder).collect()}
    assert status["BROKEN.PNG"] == "corrupt" and status["ok.webp"] == "unsupported" and status["0.png"] == "ok"
    assert names(images.corrupt_images(spark, folder).collect()) == ["BROKEN.PNG"]
    magic = {r["path"].rsplit("/", 1)[1]: (r["format"], r["ok"]) for r in images.magic_bytes(spark, folder).collect()}
    assert magic["ok.webp"] == ("webp", True) and magic["sound.webp"] == (None, False)
    assert magic["BROKEN.PNG"] == (None, False) and magic["3.png"] == ("png", True)


def test_resize():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (px.resize(img, (5, 7)) == img).all()
    flat = np.full((4, 4, 3), 9, np.uint8)
    assert (px.resize(flat, (11, 3)) == 9).all()
    up = px.resize(np.array([[[0] * 3, [100] * 3]], np.uint8), (1, 4))[0, :, 0]
    assert up.tolist() == [0, 25, 75, 100]
    down = px.resize(np.array([[[0] * 3, [0] * 3, [100] * 3, [100] * 3]], np.uint8), (1, 2))[0, :, 0]
    assert down.tolist() == [14, 86]  # the widened triangle reaches over the middle


def test_distortions():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (9, 9, 3)).astype(np.uint8)
    assert (px.turn(img, 0) == img).all()
    assert (px.turn(px.turn(img, 90), -90) == img).all()
    assert np.abs(px.shift_hue(img, 0.0).astype(int) - img).max() <= 1
    red = np.zeros((1, 1, 3), np.uint8)
    red[..., 0] = 255
    assert px.shift_hue(red, 1 / 3)[0, 0].tolist() == [0, 255, 0]
    grey = np.full((2, 2, 3), 77, np.uint8)
    assert (px.shift_hue(grey, 0.04) == 77).all()


def test_colour_layouts():
    bgr = bytes([1, 2, 3, 4, 5, 6])
    assert px.to_rgb(bgr, 1, 2, 3).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert px.to_rgb(bytes([7]), 1, 1, 1).tolist() == [[[7, 7, 7]]]
    assert px.to_rgb(bytes([1, 2, 3, 9]), 1, 1, 4).tolist() == [[[3, 2, 1]]]


def test_image_inputs(spark, folder):
    rows = images.scan_image_pixels(spark, folder)
    prep = px.ImagePrep(size=(10, 12))
    plain = prep.plain(rows).orderBy("path").collect()
    assert len(plain) == 12  # unreadable files are left out here
    raw = rows.where("height > 0").orderBy("path").first()
    want = px.to_rgb(raw["data"], 10, 12, 3).transpose(2, 0, 1).ravel() / 255
    assert np.allclose(plain[0]["pixels"], want, atol=1e-6)
    normal = prep.evaluation(rows).orderBy("path").first()["pixels"]
    mean, std = np.repeat(px.CHANNEL_MEAN, 120), np.repeat(px.CHANNEL_STD, 120)
    assert np.allclose(normal, (want - mean) / std, atol=1e-5)
    one = prep.training(rows, epoch=1).orderBy("path").collect()
    assert one == prep.training(rows.repartition(5), epoch=1).orderBy("path").collect()
    assert one != prep.training(rows, epoch=2).orderBy("path").collect()
    calm = px.ImagePrep(size=(10, 12), augment=False).training(rows).orderBy("path").first()["pixels"]
    assert calm == normal


def test_facade():
    both = Preprocessor(table_scaler="robust", image_size=(8, 8), augment=False)
    assert both.table.scaler == "robust" and both.image.size == (8, 8) and not both.image.augment


def test_image_classifier(spark, folder, tmp_path):
    model = fit_image_classifier(images.scan_image_pixels(spark, folder), size=(4, 4))
    rows = predict_images(spark, folder, model).collect()
    assert len(rows) == 12 and all(r["path"].split("/")[-2] == r["predicted"] for r in rows)
    path = model_save(model, str(tmp_path / "image_model"))
    assert predict_images(spark, folder, model_load(path)).orderBy("path").collect() == sorted(rows)
    with pytest.raises(ValueError):
        fit_image_classifier(images.scan_image_pixels(spark, folder), head="forest")
    listing = images.list_files(spark, folder)
    assert listing.columns == ["path", "length"] and listing.where(F.col("length") > 0).count() > 0
