"""Media columns: payloads as 8-bit images in ZIP archives, through a Spark data source of our own.

Writing: each task fills archives of bounded size under the folder and the driver's commit names them.
Reading: the plan lists the archives and cuts them into byte ranges; a task reads the central directory
of its archive, takes the members whose header lies in its range and streams their bytes in Arrow
batches. A member that can't be read is tried again by its offset, with the archive opened anew; one that
stays unreadable gives a row with ``error`` and leaves the others alone. So does an archive whose directory
stays unreadable: one row, without a member, for the span at its beginning.

Files are reached with pyarrow's file systems, so local and remote folders do alike.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from graniteflow.llm.common import fresh_path

#: Samples in a row of an image; the padding of payloads follows from it.
WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NAME = re.compile(r"(None|-?\d{1,19})/(\d{1,18})\.png")
FORMAT = "media_archive"


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(samples: bytes, level: int = 1) -> bytes:
    """A greyscale PNG of 8-bit samples, WIDTH a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> bytes:
    """The samples of ``encode_image``; ValueError for a damaged image."""
    if media[:8] != SIGNATURE:
        raise ValueError("no image signature")
    at, data, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this module")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """A histogram of 16 grey levels and a 64-bit hash of which of 64 spans are lighter than the mean."""
    grey = np.frombuffer(samples, np.uint8)
    levels = np.bincount(grey >> 4, minlength=16)
    spans = grey.reshape(64, -1).mean(1)
    bits = np.packbits(spans > grey.mean())
    return bytes((levels * 255 // len(grey)).astype(np.uint8)).hex() + "-" + bits.tobytes().hex()


@dataclass
class Span(InputPartition):
    """The bytes [low, high) of an archive."""

    path: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


SCHEMA = pa.schema([("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.span = int(options.get("spanbytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Span]:
        system, root = fs.FileSystem.from_uri(self.folder)
        archives = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith(".zip"))
        return [Span(path, low, min(low + self.span, size)) for path, size in archives for low in range(0, size, self.span)] or [Span("", 0, 0)]

    def fetch(self, opened, info: zipfile.ZipInfo) -> bytes:
        """A member's bytes by its offset alone; ValueError if they don't match the directory."""
        opened.seek(info.header_offset)
        head = opened.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack("<HH", head[26:30])
        opened.seek(info.header_offset + 30 + name + extra)
        media = opened.read(info.compress_size)
        if info.compress_type != zipfile.ZIP_STORED or len(media) != info.file_size or zlib.crc32(media) != info.CRC:
            raise ValueError("the member is damaged")
        return media

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        rows, held, opened, members = [], 0, None, []
        for _ in range(1 + self.retries):
            try:
                opened = system.open_input_file(span.path)
                members, error = [i for i in zipfile.ZipFile(opened).infolist() if span.low <= i.header_offset < span.high], None
                break
            except (OSError, ValueError, struct.error, zipfile.BadZipFile, NotImplementedError) as e:
                error, opened = f"{type(e).__name__}: {e}", self.closed(opened)
        if error and not span.low:
            rows.append((None, span.path, None, None, error))
        for info in members:
            media, error = None, None
            for _ in range(1 + self.retries):
                try:
                    opened = opened or system.open_input_file(span.path)  # opening again is a try like any other
                    media, error = self.fetch(opened, info), None
                    break
                except (OSError, ValueError, struct.error) as e:
                    error, opened = f"{type(e).__name__}: {e}", self.closed(opened)
            rows.append((info.filename, span.path, info.header_offset, media, error))
            held += len(media or b"")
            if held >= self.batch:
                yield self.batch_of(rows)
                rows, held = [], 0
        self.closed(opened)
        if rows:
            yield self.batch_of(rows)

    @staticmethod
    def closed(opened) -> None:
        if opened is not None:
            opened.close()

    @staticmethod
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class MediaWriter(DataSourceArrowWriter):
    """Takes columns member and media. Archives get their final name when the job commits."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.most = int(options.get("archivebytes", 32 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        buffer = io.BytesIO()
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def flush() -> None:
            nonlocal buffer, archive
            archive.close()
            if archive.namelist():
                names.append(f"{uuid.uuid4().hex}.zip")
                with system.open_output_stream(f"{root}/_{names[-1]}.part") as out:
                    out.write(buffer.getbuffer())
            buffer = io.BytesIO()
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        count = 0
        for batch in iterator:
            for member, media in zip(batch["member"], batch["media"], strict=True):
                archive.writestr(zipfile.ZipInfo(member.as_py()), media.as_py())
                count += 1
                if buffer.tell() > self.most or count % 30_000 == 0:
                    flush()
        flush()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{root}/_{name}.part", f"{root}/{name}")

    def abort(self, messages: list[Written]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        for message in messages:
            for name in message.names if message else []:
                system.delete_file(f"{root}/_{name}.part")


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options spanBytes, batchBytes, retries; for writing archiveBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "member string, archive string, offset long, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter({k.lower(): v for k, v in self.options.items()})


def store(docs: DataFrame, folder: str) -> None:
    """Writes each text of ``docs`` (doc_id, text) as an image member named ``<doc_id>/<bytes of the text>.png``."""
    docs.sparkSession.dataSource.register(MediaArchive)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, media = [], []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                data = text.as_py().encode()
                names.append(f"{doc.as_py()}/{len(data)}.png")
                media.append(encode_image(padded(data)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["member", "media"])

    docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(images, "member string, media binary").write.format(FORMAT).mode("append").save(folder)


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]
)
OUT_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each member of the archives under ``folder``: digests and features of the samples read back.

    Null text was stored as empty (a row of spaces), a null doc_id is null again, repeated rows have members
    of their own, an empty folder gives no rows. A member that can't be read or decoded has nulls and ``error``,
    a member whose name isn't of this module a null doc_id and n_bytes, an unreadable archive one such row.
    """
    spark.dataSource.register(MediaArchive)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, media, error in zip(b["member"], b["media"], b["error"], strict=True):
                named = NAME.fullmatch(name.as_py() or "")
                doc, size = (None if named is None or named[1] == "None" else int(named[1])), named and int(named[2])
                media, error = media.as_py(), error.as_py()
                try:
                    if error:
                        raise ValueError(error)
                    samples = decode_image(media)
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((doc, size, None, None, None, None, None, None, str(e)))
                    continue
                rows.append(
                    (doc, size, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples), None)
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OUT.types, strict=True)] if rows else [pa.array([], t) for t in OUT.types], schema=OUT)

    return spark.read.format(FORMAT).load(folder).mapInArrow(digests, OUT_SQL)


def op10_media(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "media")
    store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return media_columns(spark, folder)
