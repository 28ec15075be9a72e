import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from graniteflow.llm import warc
from graniteflow.llm.common import fresh_path, written
from graniteflow.llm.warc import cut, framed, page_table, read_archives, unframed, write_archives

SCHEMA = "page_id long, url string, html string, digest string, block int"


def test_framing_round_trip():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["WARC/1.1", "\r\n", "é", "a" * 9, "WARC/1.", "0\r\n\r\n"]) for _ in range(rng.randint(0, 30)))
        block = framed(text, rng.randint(1, 20))
        assert "WARC/1.1" not in block and unframed(block.encode()).decode() == text
        assert "".join(cut(block, 7)) == block
    with pytest.raises(ValueError):
        unframed(b"5\r\nabc\r\n0\r\n\r\n")


def expected(rows, least=0):
    best = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= least:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h, *_ in rows:
        data, lead = (h or "").encode(), best.get(h or "")
        first = lead is None or i == lead
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else lead))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", "".join(rng.choice(["<p>", "é", "\r\n", "WARC/1.1\r\n", "\r\n\r\n", "漢", "x"]) for _ in range(rng.choice([0, 3, 500, 20_000]))), "d", 1) for i in range(120)]
    rows += [(i, "http://y WARC/1.1", "copy", "d", 1) for i in range(200, 260)]
    rows += [(None, None, None, None, None), (None, "u\r\nWARC/1.1", "copy", None, None), (300, "u", None, "", 0), (300, "u", None, "", 0), (-5, "u", rows[7][2], "", 0)]
    for least in (0, 10):
        path = fresh_path(spark, "warc-test")
        write_archives(spark.createDataFrame(rows, SCHEMA), path, least=least, segment=1000, chunk=64)
        assert sorted(map(tuple, page_table(spark, path).collect()), key=str) == expected(rows, least)
    html = {r["page"]: r["payload"].decode() for r in read_archives(spark, path).collect() if r["record_type"] == "response"}
    assert sorted(html.values()) == sorted([h or "" for i, _, h, *_ in rows if (i, "revisit") not in {(e[0], e[3]) for e in expected(rows, 10)}])


def test_lost_segment_is_reported(spark):
    path = fresh_path(spark, "warc-torn")
    write_archives(spark.createDataFrame([(1, "u", "z" * 5000, "", 0), (2, "u", "y", "", 0)], SCHEMA).coalesce(1), path, segment=1000, chunk=64)
    local = Path(path.removeprefix("file://"))
    whole = b"".join(gzip.open(p).read() for p in sorted(local.glob("*.gz")))
    records = whole.split(b"WARC/1.1\r\n")
    torn = fresh_path(spark, "warc-torn2")
    Path(torn.removeprefix("file://")).mkdir(parents=True)
    (Path(torn.removeprefix("file://")) / "a.txt").write_bytes(b"WARC/1.1\r\n".join(r for r in records if b"Segment-Number: 3" not in r))
    found = {r["page"][:12]: r["problem"] for r in read_archives(spark, torn).collect()}
    assert found["<urn:page:1:"] == "segments are missing" and found["<urn:page:2:"] is None


def test_empty_table(spark):
    path = fresh_path(spark, "warc-empty")
    write_archives(spark.createDataFrame([], SCHEMA), path)
    assert page_table(spark, path).collect() == []


def test_torn_records_are_given_out(spark, tmp_path):
    def record(name, block, size=None, more="WARC-Type: response\r\n"):
        return f"WARC/1.1\r\n{more}WARC-Record-ID: <{name}>\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n{block}\r\n\r\n"

    block = "HTTP/1.1 200 OK\r\n\r\nbody"
    torn = [record("short", block, 999), record("typeless", block, more=""), "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <head>\r\nContent-Length: "]
    torn += [record("next", block, 999, "WARC-Type: continuation\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <sound>\r\n")]
    (tmp_path / "a.warc").write_bytes((record("sound", block) + "".join(torn)).encode())
    out = {r["page"].strip("<>"): r for r in read_archives(spark, f"file://{tmp_path}").collect()}
    assert {n: r["problem"] for n, r in out.items()} == {"sound": None} | dict.fromkeys(["short", "typeless", "head", "next"], "record is torn")
    assert bytes(out["sound"]["payload"]) == b"body" and out["short"]["record_type"] is None
    with pytest.raises(Exception, match="record is torn"):
        page_table(spark, f"file://{tmp_path}").collect()


def test_revisits_are_resolved(spark, tmp_path):
    def record(name, kind, digest, block="", more=""):
        return f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-RECORD-ID: <urn:page:{name}:x>\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}content-length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    whole = record(5, "response", digest, "HTTP/1.1 200 OK\r\n\r\nbody")
    refer = "WARC-Refers-To: <urn:page:{}>\r\n".format
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.warc").write_text(whole + record(3, "revisit", digest, "HTTP/1.1 200 OK\r\n\r\n", refer(5)), newline="")
    assert sorted(map(tuple, page_table(spark, f"file://{tmp_path}/good").collect())) == [(3, 4, digest, "revisit", 5), (5, 4, digest, "response", None)]
    for n, (to, sha) in enumerate([(6, digest), (5, "OTHER")]):
        (tmp_path / f"bad{n}").mkdir()
        (tmp_path / f"bad{n}" / "a.warc").write_text(whole + record(3, "revisit", sha, "", refer(to)), newline="")
        with pytest.raises(Exception, match="no response for the revisit of page 3"):
            page_table(spark, f"file://{tmp_path}/bad{n}").collect()


def test_pages_are_written_unshuffled_where_copies_are_few_and_payloads_stay_in_their_tasks(spark, monkeypatch):
    plans = []
    write = warc.write_archives

    def noted(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(warc, "written", noted)
    rows = [(i, "u", "é" * i if i % 50 else "copy", "d", 1) for i in range(1, 400)] + [(2**53 + 1, "u", "z" * 40_000, "d", 1), (2**53 + 3, "u", "copy", "d", 1), (None, "u", "z", "d", 1)]
    path = fresh_path(spark, "warc-plan")
    write(spark.createDataFrame(rows, SCHEMA), path)
    assert sorted(map(tuple, page_table(spark, path).collect()), key=str) == expected(rows)
    assert [name for name, _ in plans] == ["warc-leaders", "warc-followers", "warc-pages", "warc-known"]
    pages = dict(plans)["warc-pages"]
    assert pages.count("MapInPandas") == 3 and "FlatMapGroups" not in pages and "payload#" not in pages
