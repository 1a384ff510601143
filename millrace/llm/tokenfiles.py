"""Token ids in Parquet list columns, written for selective reads.

Rows stand in ascending doc_id order over the files, so footers, row groups and page
indexes let a reader take few documents, or the metadata without the tokens.  Ids are
packed by Parquet's delta or dictionary encoding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import codec, tokenizer_path
from .common import checked, materialize, new_path, per_batch, table

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
_SCHEMA = "doc_id long, file int, start_in_file long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, encoding: str = "delta", tokenizer: str | None = None) -> None:
    """Encodes the whole ``text`` of every row, adds ``end_id`` and writes ids by doc_id.

    ``encoding`` is "delta" (data page version 2, ids as DELTA_BINARY_PACKED) or
    "dictionary".  Texts, the smaller side, are what moves to their range of doc_ids;
    encoding follows in place.  Null texts are empty, null doc_ids come first, equal
    doc_ids stand in the order of their texts' hashes, over all files.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding!r}")
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        at, file = 0, None
        for b in batches:
            if file is None and b.num_rows:
                from pyspark import TaskContext

                file = TaskContext.get().partitionId()
            doc, n, ids, size = [], [], [], 0
            own = b.column(0)
            for row, i in codec(tokenizer).encode_batch(b.column(1)):
                doc.append(own[row].as_py())
                ids.append(np.append(np.frombuffer(i, "<i4"), np.int32(end_id)))
                n.append(len(ids[-1]))
                size += n[-1]
                if size > 1 << 18 or row + 1 == b.num_rows:
                    starts = at + np.cumsum(n) - n
                    flat = np.concatenate(ids)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([file] * len(doc), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), lists], ["doc_id", "file", "start_in_file", "n_tokens", "ids"])
                    at += len(flat)
                    doc, n, ids, size = [], [], [], 0

    out = rows.mapInArrow(run, _SCHEMA).write
    for key, value in {
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "compression": "zstd" if encoding == "dictionary" else "snappy",
    }.items():
        out = out.option(key, value)
    out.parquet(path)


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The files' rows with ``start``: ids of all documents before, over all files.

    The start within a file is stored; one row for each file gives what the files before
    hold, from two metadata columns alone.  These rows, as many as files, are written, counted
    and then broadcast, so no row with ids moves.  An empty table gives no rows.
    """
    rows = spark.read.schema(_SCHEMA).parquet(path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = rows.join(checked(materialize(files, "token-files")), "file").withColumn("start", F.col("first") + F.col("start_in_file"))
    return out.select("doc_id", "start", "n_tokens", *columns)


def with_crc32(rows: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """Replaces ``ids`` by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    rest = [c for c in rows.columns if c != ids]

    def run(b: pa.RecordBatch):
        lists = b.column(len(rest))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        raw = memoryview(flat).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(rest))), pa.array(crc, pa.int64())], [*rest, into])

    return per_batch(rows.select(*rest, ids), run, rows.select(*rest).schema.add(into, "long"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to the shared folder, reads them back and digests them.

    Null and empty texts hold the end id alone; null doc_ids stand first; repeated rows get a
    row and a start each.  An empty table gives no rows; extra columns are not read.
    """
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return with_crc32(read_tokens(spark, path, "ids"))
