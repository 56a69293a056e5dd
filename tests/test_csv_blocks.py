"""CSV files with line breaks inside quotes, cut by many tasks, against the reader that takes a file whole."""

import csv
import random

import pytest

from tabweave.sources.csv_blocks import csv_records
from tabweave.sources.files import scan_csv


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(draw):
    kind = draw.random()
    if kind < 0.3:
        return "\n".join("".join(draw.choices('ab ,"é', k=draw.randint(0, 12))) for _ in range(draw.randint(1, 6)))
    if kind < 0.32:
        return "long\n\n" * draw.randint(500, 8000) + '"'
    return "".join(draw.choices("abcdef ", k=draw.randint(1, 30))) + "."


def write(path, rows, ends="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=ends).writerows([["id", "a", "b\nc"], *rows])


def whole(spark, path):
    out = spark.read.options(header="true", multiLine="true", escape='"', mode="FAILFAST").csv(path)
    return sorted(map(repr, (tuple(r) for r in out.collect())))


def plain(folder):
    """What Python reads: Spark's reader of whole files keeps the ``\\r`` of a record's end."""
    rows = []
    for f in folder.iterdir():
        with open(f, newline="", encoding="utf-8") as opened:
            rows += list(csv.reader(opened))[1:]
    return sorted(repr(tuple(v or None for v in r)) for r in rows)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_same_rows_as_whole_files(spark, tmp_path, small_blocks, ends):
    draw = random.Random(1)
    for part in range(2):
        write(tmp_path / f"{part}.csv", [[str(part * 10_000 + i), field(draw), field(draw)] for i in range(250)], ends)
    path = str(tmp_path)
    df = scan_csv(spark, path, multi_line=True, infer=False, na_texts=[])
    assert df.columns == ["id", "a", "b\nc"]
    assert df.rdd.getNumPartitions() > 20
    got = [tuple(r) for r in df.collect()]
    assert len(got) == 500
    assert sorted(map(repr, got)) == (whole(spark, path) if ends == "\n" else plain(tmp_path))
    by_shuffle = csv_records(spark, path, broadcast_blocks=0)
    assert sorted(r.record for r in by_shuffle.collect()) == sorted(r.record for r in csv_records(spark, path).collect())
    assert by_shuffle.where("first").count() == 2


def test_types_and_short_files(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('i,s\n1,"a\nb"\n\nNA,"say ""x\ny"""\n3,c')
    rows = [tuple(r) for r in scan_csv(spark, str(f), multi_line=True).collect()]
    assert sorted(rows, key=repr) == sorted([(1, "a\nb"), (None, 'say "x\ny"'), (3, "c")], key=repr)
    f.write_bytes(b'i,s\r\n1,"a\r\nb"\r\n2,c\r\n')
    df = scan_csv(spark, str(f), multi_line=True)
    assert df.columns == ["i", "s"] and [tuple(r) for r in df.collect()] == [(1, "a\r\nb"), (2, "c")]
    f.write_text("i,s\n")
    assert scan_csv(spark, str(f), multi_line=True).count() == 0


def test_ragged_and_latin(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('i,s\n1,"a\nb"\n2\n')
    with pytest.raises(RuntimeError, match="2 fields"):
        scan_csv(spark, str(f), multi_line=True)
    f.write_bytes('i,s\n1,"é\nb"\n'.encode("latin-1"))
    assert [tuple(r) for r in scan_csv(spark, str(f), multi_line=True, encoding="latin-1").collect()] == [(1, "é\nb")]


def test_header_over_several_blocks(spark, tmp_path, small_blocks):
    f = tmp_path / "t.csv"
    name = "x\n" * 20_000
    f.write_text(f'i,"{name}"\n1,"a\nb"\n')
    df = scan_csv(spark, str(f), multi_line=True)
    assert df.columns == ["i", name] and [tuple(r) for r in df.collect()] == [(1, "a\nb")]
