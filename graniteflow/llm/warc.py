"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

A record's HTTP block is sent in chunked transfer framing. A block longer than ``segment`` is cut into
segment 1 (its own type) and continuation records that name it as WARC-Segment-Origin-ID; the last
carries WARC-Segment-Total-Length. Reading finds the records of the archives, brings the segments of one
origin together, orders them by number, verifies the total length and decodes the framing. Whole records
are decoded, and finished, where they are read; only segments are shuffled.

Archives are text files of Spark's writer, gzip-compressed, so they lie wherever Spark can write. Every
record ends with two CRLF, of which the writer's line end is one. The reader splits at the version line,
which no block holds: the framing cuts every ``WARC/1.1`` of a payload in two chunks. A record's id begins
with ``urn:page:`` and its page_id, and a revisit refers to it by that much.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteflow.llm.common import fresh_path, written

#: Fixed values of the format.
VERSION, CRLF, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
STATUS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(text: str, chunk: int) -> str:
    """text in chunked framing, each chunk ``chunk`` code points long at most; a chunk ends inside each ``WARC/1.1``."""
    out, stretches = [], text.split("WARC/1.1")
    for n, stretch in enumerate(stretches, 1):
        part = "1" * (n > 1) + stretch + "WARC/1." * (n < len(stretches))
        for at in range(0, len(part), chunk):
            piece = part[at : at + chunk]
            out.append(f"{len(piece.encode()):x}\r\n{piece}\r\n")
    return "".join([*out, "0\r\n\r\n"])


def unframed(block: bytes) -> bytes:
    """The payload of a chunked message body; a malformed one raises ValueError."""
    out, at = [], 0
    while True:
        end = block.index(b"\r\n", at)
        size = int(block[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if block[at + size : at + size + 2] != b"\r\n":
            raise ValueError(f"chunk at byte {at} has no end")
        out.append(block[at : at + size])
        at += size + 2


def cut(block: str, segment: int) -> list[str]:
    """block in segments of ``segment`` code points at most."""
    return [block[at : at + segment] for at in range(0, len(block), segment)]


def record(kind: str, page: str, url: str, block: str, size: int, headers: dict[str, str]) -> str:
    """A record; size is the block's in bytes."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{page}>", "WARC-Target-URI": url, **headers, "Content-Type": "application/http; msgtype=response", "Content-Length": str(size)}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None) + CRLF + block + CRLF


def page_urn(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{uuid.uuid4()}"


def number_in(urn: str | None) -> int | None:
    """The page_id in a record id; None if it has none."""
    found = re.match(r"<?urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = 16_384, chunk: int = 4096) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to gzip-compressed archives under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest page_id is a response;
    the others are revisits without payload that refer to it. Rows that tie for it are all responses.
    A null html is an empty payload; null ids count as smallest, and where all ids are null the rows are
    responses; a null url is written empty. Other columns are ignored.
    """
    body = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "), r"WARC/1\.1", "WARC/1.%31").alias("url"), body.alias("html"))
    light = pages.where(F.octet_length("html") >= least).select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"))
    # a table of its own: both sides of the join are then plain exchanges, whose hot keys Spark can split
    leading = written(light.groupBy("sha1").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-leaders")
    led = light.join(leading, "sha1").where("page_id IS NULL OR page_id < leader").where("leader IS NOT NULL")
    # a table too: where its files are few bytes it is broadcast, and the pages themselves aren't shuffled
    followers = written(led.select("page_id", "leader", "sha1").distinct(), "warc-followers")
    keyed = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    same = keyed["page_id"].eqNullSafe(followers["page_id"]) & (keyed["sha1"] == followers["sha1"])
    rows = keyed.join(followers, same, "left").select(keyed["page_id"], "url", "html", keyed["sha1"], "leader")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, url, html, sha1, size, leader in zip(*(frame[c] for c in ("page_id", "url", "html", "sha1", "size", "leader")), strict=True):
                page_id, leader = (None if pd.isna(x) else x for x in (page_id, leader))
                urn = page_urn(page_id)
                headers = {"WARC-Date": "2000-01-01T00:00:00Z", "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()}
                if leader is not None:
                    headers |= {"WARC-Refers-To": f"<urn:page:{leader}>", "WARC-Profile": PROFILE, "X-Payload-Length": str(size)}
                    block = STATUS.replace("Transfer-Encoding: chunked\r\n", "")
                    out.append(record("revisit", urn, url, block, len(block), headers))
                    continue
                parts = cut(STATUS + framed(html, chunk), segment)
                sizes = [len(p.encode()) for p in parts]
                total, first = sum(sizes), urn
                for n, (part, size) in enumerate(zip(parts, sizes, strict=True), 1):
                    if len(parts) == 1:
                        own = {}
                    elif n == 1:
                        own = {"WARC-Segment-Number": "1"}
                    else:
                        urn = page_urn(page_id)
                        own = {"WARC-Segment-Number": str(n), "WARC-Segment-Origin-ID": f"<{first}>", "WARC-Segment-Total-Length": str(total) if n == len(parts) else None}
                    out.append(record("response" if n == 1 else "continuation", urn, url, part, size, (headers if n == 1 else {}) | own))
            yield pd.DataFrame({"value": out})

    own = F.when(F.col("leader").isNull(), F.col("html"))
    number = {c: F.col(c).cast("long").cast("string").alias(c) for c in ("page_id", "leader")}  # as text, as pandas makes doubles of numbers beside nulls
    columns = rows.select(number["page_id"], "url", own.alias("html"), "sha1", F.octet_length("html").alias("size"), number["leader"])
    columns.mapInPandas(write, "value string").write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def _whole(text: str | None, default: int) -> int:
    """The number in a header, which may be cut off or missing."""
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]+\s*", text) else default


FIELDS = "origin string, number int, total long, kind string, page string, url string, digest string, refers string, length long, block binary"


class Segment(NamedTuple):
    """A record of an archive, in the columns of FIELDS."""

    origin: str | None
    number: int
    total: int
    kind: str | None
    page: str | None
    url: str | None
    digest: str | None
    refers: str | None
    length: int
    block: bytes


def parsed(stretches: Iterable[bytes]) -> Iterator[Segment]:
    """The record after each version line; a torn one has no ``kind``."""
    end = END.encode()
    for stretch in stretches:
        if not stretch or stretch.isspace():
            continue
        head, _, data = stretch.partition(end)
        lines = (line.partition(":") for line in head.decode(errors="replace").split(CRLF) if ":" in line)
        h = {name.strip().lower(): text.strip() for name, _, text in lines}  # names are case-insensitive
        size = _whole(h.get("content-length"), -1)
        whole = 0 <= size <= len(data) and "warc-type" in h
        number = _whole(h.get("warc-segment-number"), 0)
        yield Segment(
            h.get("warc-segment-origin-id") or h.get("warc-record-id"), number, _whole(h.get("warc-segment-total-length"), -1), h["warc-type"] if whole else None,
            h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), _whole(h.get("x-payload-length"), -1), data[: max(size, 0)],
        )


def _named(rows: list[tuple], schema: str) -> pd.DataFrame:
    """rows in the columns of a schema; as objects, so that numbers beside nulls stay whole."""
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")], dtype=object)


PAGES = "page string, url string, record_type string, digest string, refers string, payload binary, payload_bytes long, problem string"


def _page(first: Segment, blocks: list[bytes], total: int, missing: bool) -> tuple:
    block, problem, payload = b"".join(blocks), None, b""
    if first.kind is None:
        problem = "record is torn"
    elif missing:
        problem = "segments are missing"
    elif total >= 0 and total != len(block):
        problem = f"total length is {len(block)}, not {total}"
    else:
        head, _, body = block.partition(END.encode())
        try:
            payload = unframed(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError as e:
            problem = f"chunked framing: {e}"
    size = len(payload)
    if first.kind == "revisit":
        size = first.length
    return (first.page, first.url, first.kind, (first.digest or "").removeprefix("sha1:"), first.refers, payload, size, problem)


def read_archives(spark, path: str, finish: Callable[[list[tuple]], list[tuple]] | None = None, schema: str = PAGES) -> DataFrame:
    """A row for each record that isn't a continuation: ids, type, digest, payload in full and ``problem``.

    problem is null for a sound record, else it says what is wrong (record torn, segments missing, wrong total
    length, bad framing); the row is kept. A torn record, be it a continuation, has a row of its own with a null
    type, and counts as missing among its page's segments. Segments that come twice with one number count once. A revisit has
    an empty payload and the length that it states. Read are archives with one version line, ``WARC/1.1``, and
    UTF-8 blocks; a payload that holds that line is taken for two records, of which the first is torn.
    ``finish`` makes rows of ``schema`` of a batch of these rows where their payloads are decoded.
    """
    finish = finish or (lambda pages: pages)
    found = spark.read.option("lineSep", VERSION).text(path)
    stretches = F.col("value").cast("binary").alias("value")

    def single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _named(finish([_page(r, [r.block], r.total, False) for r in parsed(frame["value"]) if r.number == 0 or r.kind is None]), schema)

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _named([r for r in parsed(frame["value"]) if r.number > 0 and r.kind is not None], FIELDS)

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for those in frame["segments"]:
                by_number: dict[int, Segment] = {}
                for r in those:
                    by_number.setdefault(r["number"], Segment(**{f: r[f] for f in Segment._fields}))
                rows = [by_number[n] for n in sorted(by_number)]
                whole = [r.number for r in rows] == list(range(1, len(rows) + 1)) and rows[-1].total >= 0
                out.append(_page(rows[0], [r.block for r in rows], rows[-1].total, not whole))
            yield _named(finish(out), schema)

    # only heads that name a segment's number are parsed again
    cut_up = found.where(F.substring_index("value", END, 1).rlike("(?i)warc-segment-number")).select(stretches).mapInPandas(numbered, FIELDS)
    by_origin = cut_up.groupBy("origin").agg(F.collect_list(F.struct(*Segment._fields)).alias("segments")).select("segments")
    return found.select(stretches).mapInPandas(single, schema).unionByName(by_origin.mapInPandas(gathered, schema))


LIGHT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _checked(pages: list[tuple]) -> list[tuple]:
    """The columns of LIGHT of each page; one with a problem, else one with a payload unlike its digest, raises ValueError."""
    out = []
    for name, *_, problem in pages:
        if problem is not None:
            raise ValueError(f"{name}: {problem}")
    for name, _, kind, digest, refers, payload, size, _ in pages:
        if kind == "response" and digest_of(payload) != digest:
            raise ValueError("a payload differs from its digest")
        out.append((number_in(name), size, digest, kind, number_in(refers)))
    return out


def page_table(spark, path: str) -> DataFrame:
    """The archives' records as op6 asks: length and digest of the decoded payload, a revisit's those of the response it refers to.

    A record with a problem, a payload unlike its digest, and a revisit whose response isn't there with the
    digest it states raise ValueError.
    """
    # the light columns of each record, kept: payloads are decoded once, and the join below sees plain exchanges
    light = written(read_archives(spark, path, _checked, LIGHT), "warc-pages")
    revisits, responses = (light.where(F.col("record_type") == k) for k in ("revisit", "response"))
    wanted = revisits.select("refers_to", "payload_digest").distinct()
    known = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").join(wanted, ["refers_to", "payload_digest"], "left_semi").distinct()
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    solved = revisits.drop("payload_bytes").join(written(known, "warc-known"), ["refers_to", "payload_digest"], "left")
    return responses.unionByName(solved.withColumn("payload_bytes", F.coalesce("payload_bytes", missing)))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_table(spark, path)
