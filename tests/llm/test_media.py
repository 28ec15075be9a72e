import hashlib
import random
import zlib
from pathlib import Path
from types import SimpleNamespace

import pytest

from graniteflow.llm.common import fresh_path
from graniteflow.llm.media import FORMAT, MediaArchive, decode_image, encode_image, feature_of, media_columns, padded, store

SCHEMA = "doc_id long, text string, media string, member int"


def test_image_round_trip():
    for n in (0, 1, 191, 192, 193, 40_000):
        data = padded(bytes(random.Random(n).randbytes(n)))
        assert len(data) % 192 == 0 and len(data) >= 192
        assert decode_image(encode_image(data)) == data
    with pytest.raises(ValueError):
        decode_image(encode_image(data)[:-20] + b"x" * 20)


def test_store_and_read_back(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcé漢 ") for _ in range(rng.choice([0, 5, 192, 3000]))), "", 1) for i in range(200)]
    rows += [(500, None, None, None), (None, "x", None, None), (7, rows[7][1], None, None), (501, "y" * 300_000, "", 0), (502, rows[5][1], "", 0)]
    folder = fresh_path(spark, "media-test")
    store(spark.createDataFrame(rows, SCHEMA), folder)
    out = media_columns(spark, folder).collect()
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        full = padded(data)
        media = encode_image(full)
        want.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(full), None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_damaged_member_leaves_the_others(spark):
    folder = fresh_path(spark, "media-torn")
    store(spark.createDataFrame([(i, f"text {i} " * 50, "", 0) for i in range(50)], SCHEMA).coalesce(1), folder)
    (archive,) = Path(folder.removeprefix("file://")).glob("*.zip")
    data = bytearray(archive.read_bytes())
    at = data.index(b"IDAT", len(data) // 3)
    data[at + 8 : at + 12] = b"\0\0\0\0"
    archive.write_bytes(data)
    spark.dataSource.register(MediaArchive)
    rows = spark.read.format(FORMAT).option("spanBytes", 1000).load(folder)
    assert rows.count() == 50 and rows.where("error IS NOT NULL").count() == 1 and rows.rdd.getNumPartitions() > 3
    assert media_columns(spark, folder).where("error IS NULL").count() == 49


def test_empty_table(spark):
    folder = fresh_path(spark, "media-empty")
    store(spark.createDataFrame([], SCHEMA), folder)
    assert media_columns(spark, folder).collect() == []


def test_damaged_archive_and_foreign_members_leave_the_others(spark):
    import zipfile

    folder = fresh_path(spark, "media-bad")
    store(spark.createDataFrame([(i, f"text {i}", "", 0) for i in range(20)], SCHEMA).coalesce(1), folder)
    local = Path(folder.removeprefix("file://"))
    (local / "broken.zip").write_bytes(b"PK\x03\x04 no directory here" * 200)
    with zipfile.ZipFile(local / "foreign.zip", "w") as z:
        z.writestr("readme.txt", "not an image")
        z.writestr("77/3.png", encode_image(padded(b"abc")))
    out = media_columns(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out if r["error"] is None) == [*range(20), 77]
    bad = [r for r in out if r["error"]]
    assert len(bad) == 2 and all(r["doc_id"] is None and r["n_bytes"] is None for r in bad)


def test_reopening_that_fails_costs_a_try_not_the_task(tmp_path, monkeypatch):
    import zipfile

    from graniteflow.llm import media

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for name in ("one", "two", "three"):
            archive.writestr(name, name.encode() * 10)
    reader, opened, system = media.MediaReader({"path": f"file://{tmp_path}"}), [], media.fs.LocalFileSystem()

    class Flaky:
        """The first read of a member fails, and so does the next opening."""

        def open_input_file(self, path):
            if len(opened) == 1:
                opened.append(None)
                raise OSError("not now")
            opened.append(system.open_input_file(path))
            return opened[-1]

    monkeypatch.setattr(media, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: (Flaky(), uri))))
    fetch, calls = reader.fetch, []

    def once(file, info):
        calls.append(info.filename)
        if len(calls) == 1:
            raise OSError("lost")
        return fetch(file, info)

    monkeypatch.setattr(reader, "fetch", once)
    rows = [r for batch in reader.read(media.Span(str(tmp_path / "a.zip"), 0, 1 << 20)) for r in batch.to_pylist()]
    assert [(r["member"], r["media"], r["error"]) for r in rows] == [(n, n.encode() * 10, None) for n in ("one", "two", "three")]
    assert all(f.closed for f in opened if f is not None)
