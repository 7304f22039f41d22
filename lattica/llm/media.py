"""Media columns: payloads as sound members of archives, and a Spark data source.

``store`` writes each payload losslessly as a mono WAV member with 8-bit
samples into ZIP archives (deflated) of bounded size. The data source
``media_archive`` reads them back: its driver side lists archives only and
plans byte ranges over them; a task opens the archive's directory, takes the
members whose header lies in its range and streams them as Arrow batches of
bounded size. A member that can't be read is tried again on its own, from its
offset, with a fresh handle; the others aren't read twice.

Archives are named anew by each task attempt, and only those that a commit
lists are read, so lost executors leave nothing visible.
"""

from __future__ import annotations

import hashlib
import json
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
from pyspark.sql.types import StructType

from .common import shared_dir, small

#: A payload is a positive multiple of this many bytes.
FRAME, FILL, RATE = 192, b" ", 8000
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 32 << 20, 16 << 20, 4 << 20, 3
HEADER = 44

MEMBERS = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, archive string, offset long, attempts int, error string"


def payload_of(raw: bytes) -> bytes:
    """``raw`` filled with spaces up to a positive multiple of 192."""
    return raw + FILL * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def wav(samples: bytes) -> bytes:
    """Mono, unsigned 8-bit PCM."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def samples_of(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a sound as stored here")
    return media[HEADER : HEADER + int.from_bytes(media[40:44], "little")]


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    archive: str
    low: int
    high: int

    def __init__(self, archive: str, low: int, high: int):
        super().__init__(None)
        self.archive, self.low, self.high = archive, low, high


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (doc_id, n_bytes, payload) into archives of about ``ARCHIVE_BYTES``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        done, out, archive, name, n = [], None, None, "", 0

        def close() -> None:
            archive.close()
            out.close()
            done.append((name, store.get_file_info(f"{root}/{name}").size))

        for b in small(iterator):
            for doc, size, payload in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["payload"].to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{'' if doc is None else doc}_{size}_{n}.wav")
                archive.writestr(info, wav(payload), zipfile.ZIP_DEFLATED, 1)
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_archives-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.archives if m else []:
                store.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.keep_errors = options.get("keeperrors", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        """Byte ranges; only names and sizes of archives are read here."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("_archives-"):
                with store.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [ByteRange(name, at, at + self.range_bytes) for name, size in sorted(found) for at in range(0, size, self.range_bytes)]

    def member(self, open_archive, info: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """One member's media, the attempts it took, and what went wrong last."""
        for attempt in range(1, self.attempts + 1):
            try:
                with open_archive().open(info) as f:  # the archive's checksum is verified
                    return f.read(), attempt, None
            except (OSError, EOFError, zipfile.BadZipFile, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                open_archive(again=True)
        if not self.keep_errors:
            raise OSError(f"{info.filename} at {info.header_offset}: {error}")
        return None, self.attempts, error

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive, so nothing was planned
            return
        store, root = fs.FileSystem.from_uri(self.path)
        held: list = []

        def open_archive(again: bool = False) -> zipfile.ZipFile:
            if again or not held:
                held[:] = [zipfile.ZipFile(store.open_input_file(f"{root}/{partition.archive}"))]
            return held[0]

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("attempts", pa.int32()), ("error", pa.string())])
        rows, waiting = [], 0
        for info in open_archive().infolist():
            if not partition.low <= info.header_offset < partition.high:
                continue
            doc, size, _ = info.filename.removesuffix(".wav").split("_")
            media, attempts, error = self.member(open_archive, info)
            whole = media is not None
            rows.append((int(doc) if doc else None, int(size), len(media) if whole else None, hashlib.sha256(media).hexdigest() if whole else None, samples_of(media) if whole else None, partition.archive, info.header_offset, attempts, error))
            waiting += len(media or b"")
            if waiting >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, waiting = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(path)`` and the like for writing."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload) of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            raw = [(t or "").encode() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array(map(payload_of, raw), pa.binary())], names=["doc_id", "n_bytes", "payload"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload binary")


def store(rows: DataFrame, path: str) -> None:
    """Write (doc_id, n_bytes, payload) as archives; repeated rows stay repeated."""
    rows.sparkSession.dataSource.register(MediaArchive)
    rows.write.format("media_archive").mode("append").option("path", path).save()


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members; an unreadable one fails the job, or is a row with ``error`` if ``keepErrors``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(samples: bytes) -> str:
    """Mean, deviation, share of steps that cross the middle, and the loudness of eight equal parts."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    crossing = np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)) / (len(x) - 1)
    parts = np.sqrt((x.reshape(8, -1) ** 2).mean(axis=1))
    return ",".join(f"{v:.4f}" for v in (x.mean(dtype=np.float64), x.std(dtype=np.float64), crossing, *parts))


def features(members: DataFrame) -> DataFrame:
    """Digests and features of the payloads as they were read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            got = [p or b"" for p in b["payload"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b["doc_id"],
                "n_bytes": b["n_bytes"],
                "payload_bytes": pa.array(map(len, got), pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in got], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in got], pa.int64()),
                "media_bytes": b["media_bytes"],
                "media_sha256": b["media_sha256"],
                "feature": pa.array([feature_of(p) if p else None for p in got], pa.string()),
            })

    return members.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "payload").mapInArrow(run, FEATURES)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text of ``docs`` as sound, read it back and describe it.

    Null and empty texts are 192 spaces. Rows may repeat; other columns are
    ignored; an empty input gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(payloads(docs), path)
    return features(load(spark, path))
