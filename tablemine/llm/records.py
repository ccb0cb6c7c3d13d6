"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

A record is: payload length (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload (4), a mark.
The payload is: document id (8 bytes, signed), flags (1 byte: 1 the id is NULL, 2 ids of 4 bytes instead of 2), number of the
task that wrote it (4), ids that this task wrote before (8), ids. All numbers are little-endian. The mark is a line feed and 32 hex digits drawn anew for every folder, so no payload holds it;
it is the line end of Spark's text writer, which carries the records to any file system Spark writes to and commits whole
tasks only, so a lost executor leaves no half-written shard. Spark's text reader ends its lines there too: readers take record
after record from any split of a shard, never hold a whole one, and need not know where a split starts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.llm.common import attach
from tablemine.llm.encoding import forget, pieces_of, slices
from tablemine.session import scratch_path

#: Bytes of text in a shard, about. Bytes of text in a task that writes them.
SHARD_BYTES, TASK_BYTES = 8 << 20, 256 << 20

# Fixed values of the record format.
MASK = 0xA282EAD8
HEAD, FOOT, MARK = 12, 4, 33
NULL_ID, WIDE = 1, 2
ABOUT, INFO = "<qBIQ", 21


def masked(data: bytes) -> int:
    """CRC-32 turned by 15 bits plus a constant, so a checksum of data that holds checksums stays telling."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool, part: int = 0, first: int = 0) -> bytes:
    """One record without the mark; it is the record of task ``part`` behind ``first`` ids."""
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
    payload = struct.pack(ABOUT, doc_id or 0, flags, part, first) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(shard: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, place of the next record) of the record at ``at``; raises if a checksum is wrong."""
    size = shard[at : at + 8]
    (length,), (check,) = struct.unpack("<Q", size), struct.unpack_from("<I", shard, at + 8)
    if masked(size) != check:
        raise ValueError(f"length of the record at {at} is damaged")
    payload = shard[at + HEAD : at + HEAD + length]
    if masked(payload) != struct.unpack_from("<I", shard, at + HEAD + length)[0]:
        raise ValueError(f"record at {at} is damaged")
    doc_id, flags, _, _ = struct.unpack_from(ABOUT, payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=INFO).astype("<u4")
    return (None if flags & NULL_ID else doc_id), ids, at + HEAD + length + FOOT + MARK


def write_records(df: DataFrame, folder: str, tokenizer: str, *, text: str = "text", key: str = "doc_id", end: int = 2, shards: int | None = None) -> None:
    """Encode every row of ``df(key long, text)`` and write records in ascending key order, then the index.

    ``folder/data`` has one file per shard, of about SHARD_BYTES of text or one record, in order of their names; ``folder/index`` is a table (shard, offset, length,
    doc_id, n_tokens, start), start counting the ids of all records before. Rows are dealt out by ranges of (key, hash of the
    text) and sorted within; nothing is sorted in one place. NULL texts are empty and give the end id only; NULL keys come
    first; equal keys are ordered by the hash; an empty table gives no record. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = shards or max(1, df.rdd.getNumPartitions(), -(-size // TASK_BYTES))
    # the third key parts repeated rows, so that one text a million times over is many tasks
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(tasks, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h")
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces_of(tokenizer)
        wide = max(encoder.width, end + 1) > 1 << 16
        tail, first = struct.pack("<I", end), 0
        for b in parts:
            for i, texts in slices(b.column(1)):
                keys, part, out = b.column(0).slice(i, len(texts)).to_pylist(), b.column(2)[i].as_py(), []
                for k, x in zip(keys, encoder.encode(texts)):
                    ids = np.frombuffer(x + tail, "<u4")
                    out.append(frame(k, ids, wide, part, first))
                    first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                del texts, out
                pa.default_memory_pool().release_unused()

    mark = "\n" + uuid.uuid4().hex
    records = dealt.mapInArrow(encode, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", mark).option("maxRecordsPerFile", max(1, n * SHARD_BYTES // max(size, 1))).text(f"{folder}/data")
    spark.range(0, 1, 1, 1).select(F.lit(mark).alias("mark")).write.parquet(f"{folder}/mark")
    heads = _lines(spark, folder).select("shard", F.substring("record", 1, HEAD + INFO).alias("head"), F.length("record").cast("long").alias("size"))
    entries = heads.mapInArrow(_entries, "shard string, length long, doc_id long, n_tokens long, part long, first long")
    entries.write.parquet(f"{folder}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{folder}/entries")
    inside = W.partitionBy("shard").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    placed = attach(entries.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))), _bases(entries), ["part"])
    placed.select("shard", "offset", "length", "doc_id", "n_tokens", "part", (F.col("base") + F.col("first")).alias("start")).write.parquet(f"{folder}/index")


def _bases(entries: DataFrame) -> DataFrame:
    """(part, base): ids before those of the task. One row per task, so one window over them."""
    sums = entries.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, record): every record, whatever the splits."""
    mark = spark.read.parquet(f"{folder}/mark").first().mark
    read = spark.read.option("lineSep", mark).text(f"{folder}/data")
    return read.select(F.col("_metadata.file_name").alias("shard"), F.col("value").cast("binary").alias("record"))


def _checked(head: bytes, size: int, shard: str) -> None:
    """Raise unless a record of ``size`` bytes without its mark begins with that length and its checksum."""
    length = size - HEAD - FOOT
    if length < INFO or struct.pack("<QI", length, masked(head[:8])) != head[:HEAD]:
        raise ValueError(f"length of a record of {shard} is damaged")


def _entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows from the heads alone: payloads are passed over, and checked when they are read."""
    forget()
    names = ["shard", "length", "doc_id", "n_tokens", "part", "first"]
    for b in parts:
        out: list[list] = [[], [], [], [], []]
        for shard, head, size in zip(*(c.to_pylist() for c in b.columns)):
            _checked(head, size, shard)
            doc_id, flags, part, first = struct.unpack_from(ABOUT, head, HEAD)
            n = (size - HEAD - INFO - FOOT) // (4 if flags & WIDE else 2)
            for column, v in zip(out, (size + MARK, None if flags & NULL_ID else doc_id, n, part, first)):
                column.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out]], names)


def _sequences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    names = ["shard", "part", "doc_id", "first", "ids"]
    for whole in parts:
        for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            out: list[list] = [[], [], [], []]
            for shard, record in zip(*(c.to_pylist() for c in b.columns)):
                _checked(record, len(record), shard)
                doc_id, ids, _ = unframe(record, 0)
                _, _, part, first = struct.unpack_from(ABOUT, record, HEAD)
                for column, v in zip(out, (part, doc_id, first, ids.tobytes())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], names)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, start, ids) of every record, checksums compared; ids are unsigned 32-bit numbers, little-endian."""
    bases = spark.read.parquet(f"{folder}/index").groupBy("part").agg(F.min("start").alias("base"))
    rows = _lines(spark, folder).mapInArrow(_sequences, "shard string, part long, doc_id long, first long, ids binary")
    return attach(rows, bases, ["part"]).select("shard", "doc_id", (F.col("base") + F.col("first")).alias("start"), "ids")


def records_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors share."""
    return scratch_path(spark, "records")
