"""Sharding by weighted rendezvous hashing of stable record keys.

Each record scores every shard with -weight / ln(u), u a hash of (key, shard) in
(0, 1), and goes to the highest.  A shard's score never depends on the others, so
a new shard takes records only into itself and a removed one gives up only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

SHARDS = 8
#: Rows that one numbering group holds on average.
GROUP_ROWS = 200_000


def rendezvous(key, weights: Sequence[float]) -> F.Column:
    """Shard of a key column under weighted rendezvous hashing; null keys hash as one key.

    The uniform number of (key, shard) is the first 52 bits of their MD5, so any engine can
    find a record's shard again; ties go to the lower shard.
    """
    best = []
    for shard, weight in enumerate(weights):
        h = F.md5(F.concat(F.lit(f"{shard}|"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))))
        u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        best.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("first")))
    top = F.greatest(*best) if len(best) > 1 else best[0]
    return (-top["first"]).cast("int")


def assign(df: DataFrame, key: str, shard_weights: Sequence[float], into: str = "shard") -> DataFrame:
    """Adds the column ``into`` with each row's shard; all other columns stay."""
    if not shard_weights or min(shard_weights) <= 0:
        raise ValueError("shard weights must be positive")
    return df.withColumn(into, rendezvous(F.col(key), shard_weights))


def numbered(df: DataFrame, shard: str, order: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard, without gathering a shard in one task.

    Rows fall into groups of about ``group_rows`` by a hash of ``order`` and a row salt, so
    that equal keys spread too.  Counts of groups give each group's first slot; a window
    then numbers the rows of one group.  ``df`` is written first, so both passes see the
    same groups.
    """
    df = materialize(df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(64))), "slots")
    groups = max(1, -(-df.count() // group_rows))
    df = df.withColumn("__group", F.pmod(F.xxhash64(*[F.col(c) for c in order], "__salt"), F.lit(groups)).cast("int")).drop("__salt")
    sizes = df.groupBy(shard, "__group").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(shard, "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = W.partitionBy(shard, "__group").orderBy(*order)
    out = df.withColumn("__at", F.row_number().over(within).cast("long"))
    out = out.join(sizes, [shard, "__group"])
    return out.withColumn("slot", F.col("__first") + F.col("__at") - 1).drop("__group", "__at", "__first")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``key``.

    Null texts have no bytes (size 1, crc32 0).  A null doc_id is a key of its own.
    Repeated rows share a shard and get slots of their own.  An empty table gives no rows.
    Extra columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    thin = assign(thin, "doc_id", [1.0] * SHARDS)
    thin = assign(thin, "doc_id", [1.0] * (SHARDS + 1), into="grown_shard")
    out = numbered(thin, "shard", ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharding_sql(documents: str = "documents") -> str:
    """DuckDB SQL of ``op10_sharding`` for up to ``GROUP_ROWS`` documents, whose slots one group numbers.

    DuckDB has no crc32: a table made from its polynomial takes the texts byte by byte.
    """

    def scores(shards: int) -> str:
        u = "(CAST('0x' || substr(md5('{}|' || key), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {}"
        return "[" + ", ".join(f"-1.0 / ln({u.format(k, float(1 << 52))})" for k in range(shards)) + "]"

    return f"""
WITH bits AS (SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN {0xEDB88320} ELSE 0 END), b) ORDER BY b) AS crcs
  FROM range(256) r(b)),
d AS (SELECT doc_id, coalesce('=' || CAST(doc_id AS VARCHAR), 'null') AS key, encode(coalesce(text, '')) AS bytes FROM {documents}),
n AS (SELECT doc_id, key, octet_length(bytes) + 1 AS size,
  list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
s AS (SELECT doc_id, size, {scores(SHARDS)} AS scores, {scores(SHARDS + 1)} AS grown,
  xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]), {0xFFFFFFFF}::BIGINT), {0xFFFFFFFF}) AS text_crc32 FROM n, bits),
p AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS shard, CAST(list_position(grown, list_max(grown)) - 1 AS INT) AS grown_shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM p"""


ORACLE = {"op10_sharding": sharding_sql()}
