"""Token ids in seekable files of independent zstandard frames.

One file holds a range of doc_ids in ascending order:

    one zstandard frame per document: its ids, little-endian unsigned 32-bit, end id included
    a skippable frame (magic 0x184D2A50): per document its doc_id (int64) and whether it has one (uint8)
    a skippable frame (magic 0x184D2A5E), the seek table of the public seekable format: per frame
        its compressed size, its decompressed size and the low 32 bits of XXH64 of its content,
        then the number of frames, a flag byte (0x80: checksums) and the magic 0x8F92EAB1

A reader fetches the tail of a file, finds the frames it wants and decompresses only those.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, scratch, settle, small_batches
from .tokens import encoder

#: Fixed values of the public seekable format.
SEEK_MAGIC, FOOTER_MAGIC, INDEX_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80
END_ID = 0
LEVEL = 1


class FrameWriter:
    """Writes one file; frames must come in the order in which readers count them."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.compress = out, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.seek, self.ids = bytearray(), []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.out.write(frame)
        self.seek += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids.append(doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        n = len(self.ids)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is not None for i in self.ids)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(self.seek) + 9) + self.seek + struct.pack("<IBI", n, CHECKSUMS, FOOTER_MAGIC))


class FrameReader:
    """Reads single documents of one file; `source` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END) if not hasattr(source, "size") else source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("not a file of frames with a seek table and checksums")
        table = size - 9 - 12 * n
        source.seek(table)
        self.frames = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        source.seek(int(self.at[-1]) + 8)
        index = source.read(9 * n)
        has = np.frombuffer(index, np.uint8, n, 8 * n)
        self.doc_ids = [i if h else None for i, h in zip(np.frombuffer(index, "<i8", n).tolist(), has.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 1] // 4, dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.frames)

    def read(self, k: int) -> bytes:
        """The ids of the k-th document, checked."""
        import xxhash
        import zstandard

        self.source.seek(int(self.at[k]))
        size, length, check = (int(x) for x in self.frames[k])
        ids = zstandard.ZstdDecompressor().decompress(self.source.read(size), max_output_size=length)
        if len(ids) != length or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return ids


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark uses, for tasks that write whole files themselves. Hadoop's names of S3 are s3 here."""
    name, mark, rest = uri.partition("://")
    if not mark:
        return pafs.FileSystem.from_uri("file://" + os.path.abspath(uri))
    return pafs.FileSystem.from_uri(f"{'s3' if name in ('s3a', 's3n') else name}://{rest}")


def _write_task(folder: str, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, encode = context.partitionId(), encoder(vocabulary).encode
        fs, base = open_path(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{number:06d}.tokens"
        draft = f"{base}/.{name}-{context.taskAttemptId()}"  # renamed when whole: a task that is lost leaves no half file
        end = np.array([END_ID], "<u4").tobytes()
        with fs.open_output_stream(draft) as out:
            writer = FrameWriter(out)
            for b in gathered(batches, "text"):
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text"))):
                    writer.add(doc_id, ids + end)
            writer.close()
        fs.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"number": [number], "path": [f"{folder}/{name}"], "docs": [len(writer.ids)], "tokens": [writer.tokens]}, FILES)

    return run


FILES = pa.schema([("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the ids of every document and return one row per file: number, path, docs, tokens, first_token.

    Documents are range-partitioned and sorted by doc_id (nulls first; rows of one id by text).
    Each text's ids are followed by id 0; a null text counts as empty. Repeated rows are written
    each for itself, other columns are ignored, and an empty table gives files without documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spread = F.xxhash64("text")  # rows of one id lie apart, if there are many
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), spread).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), spread, "text")
    files = settle(ordered.mapInArrow(_write_task(folder, vocabulary), "number int, path string, docs long, tokens long"), "files")
    # one row per file, as many as partitions
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
            fs, at = open_path(path)
            with fs.open_input_file(at) as source:
                reader = FrameReader(source)
                for k in range(0, len(reader), 1000):
                    own = range(k, min(k + 1000, len(reader)))
                    starts = reader.starts[own.start : own.stop] + first
                    ids = [reader.read(i) for i in own]
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[own.start : own.stop], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_tokens(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    n = files.count()
    paths = files.select("path", "first_token").repartition(max(1, n))
    return paths.mapInArrow(_read_task, "doc_id long, start long, n_tokens long, ids binary")


def round_trip_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents, read the files back and return a checksum of each one's ids."""
    back = read_tokens(write_tokens(docs, scratch(spark, "tokens")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
