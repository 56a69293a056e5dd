"""WARC archives: round trip, revisits, determinism, commits and broken files."""

import gzip
import hashlib
import io

import pyarrow as pa
import pytest

from tabweave.llm.files import file_system, shared_folder
from tabweave.llm.warc import read_archives, read_records, record, round_trip, write_archives

BIG = "payload " * 200


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(parts)


def content(folder):
    fs, path = file_system(folder)
    found = {}
    for info in fs.get_file_info(pa.fs.FileSelector(path)):
        if info.is_file:
            with fs.open_input_stream(info.path, compression=None) as f:
                found[info.base_name] = f.read()
    return found


def brute(rows):
    out = []
    for key, url, html, _ in rows:
        data = (html or "").encode()
        same = [k for k, _, h, _ in rows if h == html and k is not None]
        revisit = len(data) >= 1000 and bool(same) and key != max(same)
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(map(repr, out))


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"{BIG}{i % 7}" if i % 3 else f"small {i % 2}", "x") for i in range(60)]
    rows += [(100, None, None, None), (101, "http://h/é\n", "", ""), (None, "http://n/", BIG + "0", ""), (102, "u", "é" * 300_000, "")]
    got = round_trip(frame(spark, rows), roll=3000)
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == brute(rows)
    texts = {r.page_id: r.text for r in got.where("record_type = 'response'").collect()}
    assert all(texts[k] == (html or "") for k, _, html, _ in rows if k in texts)


def test_repeated_rows(spark):
    rows = [(1, "u", BIG, ""), (1, "u", BIG, ""), (0, "v", BIG, ""), (2, "w", "s", ""), (2, "w", "s", "")]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in round_trip(frame(spark, rows)).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1), (2, "response", None), (2, "response", None)]


def test_files_depend_on_the_records_alone(spark):
    rows = [(i, f"http://h/{i}", f"{BIG}{i * i % 11}", "") for i in range(80)]
    seen = []
    for parts in (1, 5):
        folder = shared_folder(spark, "warc")
        manifest = write_archives(frame(spark, rows, parts), folder, roll=2000).collect()
        files = content(folder)
        assert {m.name: (m.bytes, m.sha256) for m in manifest} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
        assert sum(m.records for m in manifest) == 80 and len(files) > 3
        seen.append(files)
    assert seen[0] == seen[1]
    keys = [h["X-Key"] for name in sorted(seen[0]) for h, _ in read_records(io.BytesIO(seen[0][name]))]
    assert [int(k) for k in keys] == list(range(80))


def test_unlisted_files_are_not_read(spark):
    folder = shared_folder(spark, "warc")
    write_archives(frame(spark, [(1, "u", "x", "")]), folder)
    fs, path = file_system(folder)
    for name in ("part-00000009.warc.gz", ".part-00000000.warc.gz.abc.tmp"):
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(b"left by a lost task")
    assert read_archives(spark, folder).count() == 1
    with fs.open_output_stream(f"{path}/part-00000000.warc.gz", compression=None) as f:
        f.write(b"short")
    with pytest.raises(Exception, match="not the file that the manifest lists"):
        read_archives(spark, folder).count()


def test_records_are_read_in_any_portion():
    members = [record(i, 0, "u", b"x" * i * 50, "d", None, False) for i in range(5)]
    for portion in (1, 7, 1000):
        assert [len(b) for _, b in read_records(io.BytesIO(b"".join(members)), portion)] == [0, 50, 100, 150, 200]
    with pytest.raises(ValueError, match="inside a record"):
        list(read_records(io.BytesIO(members[1][:-3])))
    with pytest.raises(ValueError, match="not a WARC"):
        list(read_records(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))))
    with pytest.raises(ValueError, match="length"):
        list(read_records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))))


def test_empty(spark):
    folder = shared_folder(spark, "warc")
    assert write_archives(frame(spark, []), folder).count() == 0
    assert round_trip(frame(spark, [])).count() == 0
