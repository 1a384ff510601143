"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share a total over the sources by weight, no source above a multiple of its
own size.  The total is cut into blocks of equal words; the highest quotients
target / (2k + 1) win them: first for sources, then within a source for up to ``GROUPS``
groups of its shards, then within a group for its shards (of about ``CELL_ROWS`` documents).
A shard's documents stand in a seeded order, and its blocks are the first ones of that
stream: full passes first, then the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checked, materialize, n_words, table, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 16
CELL_ROWS = 8_192
#: Groups of a source's shards: what the driver gets of a source, however many shards it has.
GROUPS = 1_024
SEED = 7


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Shares ``share`` of all sizes by weight; what a source has above ``repeats`` times its
    size goes to the others by weight, until none is above."""
    total, limit = share * sum(sizes), [repeats * s for s in sizes]
    full: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest, weight = total - sum(limit[i] for i in full), sum(weights[i] for i in free)
        given = {i: rest * weights[i] / weight for i in free} if weight else {}
        over = [i for i in free if given.get(i, 0.0) > limit[i]]
        if not over:
            return [float(limit[i]) if i in full else float(given.get(i, 0.0)) for i in range(len(sizes))]
        full.update(over)


def apportion(values: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Sainte-Lague: ``seats`` to the highest quotients value / (2k + 1), ties to the first.

    ``caps`` limits a party's seats; what is then left over stays unassigned.
    """
    n = len(values)
    caps = list(caps) if caps is not None else [seats] * n
    total = sum(values)
    if not n or total <= 0 or seats <= 0:
        return [0] * n
    # At this divisor rounding gives no more seats than there are; the next highest follow one by one.
    spare = seats - n / 2
    got = [max(0, min(caps[i], int(v * spare / total + 0.5 - 1e-6))) if spare > 0 else 0 for i, v in enumerate(values)]
    heap = [(-v / (2 * got[i] + 1), i) for i, v in enumerate(values) if v > 0 and got[i] < caps[i]]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-values[i] / (2 * got[i] + 1), i))
    return got


def _key(seed: int) -> F.Column:
    """128-bit key of a row's doc_id, source and text, nulls told from empty texts."""
    text = lambda c: F.md5(F.coalesce(F.col(c), F.lit("")))
    flag = lambda c: F.col(c).isNull().cast("int").cast("string")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text("source"), flag("source"), text("text"), flag("text")))


def quotas(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED, cell_rows: int = CELL_ROWS, groups: int = GROUPS) -> DataFrame:
    """One row for each distinct (doc_id, source, text): how the mix takes it.

    Columns: key (128 bits of the row), doc_id, source, size, copies (equal rows),
    source_size, target, passes (times that every word is taken), at (words of the row's
    cell before it) and rest (words of the cell's stream that one more pass takes).

    The driver gets one row for each source and each of its ``groups``, never rows of documents
    or cells.
    """
    spark = docs.sparkSession
    thin = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key(seed).alias("key"))
    thin = thin.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    thin = materialize(thin, "mix-sizes")
    cells = thin.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("cells"))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    thin = thin.join(cells, thin["source"].eqNullSafe(cells["s"])).withColumn("cell", F.pmod(number, "cells").cast("int")).drop("s", "cells")
    words_ = thin.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    limit = F.ceil(F.col("words") * repeats / block_words).cast("long")
    own = materialize(words_.withColumns({"grp": F.pmod("cell", F.lit(groups)).cast("int"), "most": limit}), "mix-cells")
    by_source: dict = {}
    for r in own.groupBy("source", "grp").agg(F.sum("words").alias("words"), F.sum("most").alias("most")).collect():
        by_source.setdefault(r["source"], []).append((r["grp"], int(r["words"]), int(r["most"])))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for _, w, _ in by_source[s]) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    seats = apportion(goal, int(sum(goal) / block_words + 0.5), [-(-repeats * s // block_words) for s in sizes])
    rows = []
    for name, size, t, q in zip(names, sizes, goal, seats, strict=True):
        parts = sorted(by_source[name])
        shares = apportion([w for _, w, _ in parts], q, [m for _, _, m in parts])
        rows += [(name, g, size, t, blocks) for (g, _, _), blocks in zip(parts, shares, strict=True)]
    won = F.broadcast(spark.createDataFrame(rows, "s string, g int, source_size long, target double, seats long"))

    def share_out(part):
        part = part.sort_values("cell")
        blocks = apportion(part["words"].tolist(), int(part["seats"].iloc[0]), part["most"].tolist())
        part["take"] = [min(b * block_words, repeats * w) for b, w in zip(blocks, part["words"], strict=True)]
        return part[["source", "cell", "source_size", "target", "words", "take"]]

    plan = own.join(won, own["source"].eqNullSafe(won["s"]) & (own["grp"] == won["g"])).drop("s", "g")
    plan = plan.groupBy("source", "grp").applyInPandas(share_out, "source string, cell int, source_size long, target double, words long, take long")
    whole = F.greatest("words", F.lit(1))
    plan = plan.select(F.col("source").alias("s"), F.col("cell").alias("c"), "source_size", "target", F.floor(F.col("take") / whole).alias("passes"), F.pmod("take", whole).alias("rest"))
    order = W.partitionBy("source", "cell").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    thin = thin.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    plan = checked(materialize(plan, "mix-plan"))
    return thin.join(plan, thin["source"].eqNullSafe(plan["s"]) & (thin["cell"] == plan["c"])).drop("s", "c", "cell")


def taken(groups: DataFrame) -> DataFrame:
    """``quotas`` with one row for each document and the words that the mix takes of it."""
    each = groups.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at") - F.col("i") * F.col("size")))
    return each.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: each document as often as it is taken, one in each cell
    cut after the words that still fit (joined by single blanks).  Columns stay; n_chars,
    where present, follows the text.  Null, empty and blank texts are never taken; a null source
    is one of its own; an empty table gives no rows."""
    groups = quotas(docs, **options)
    size = F.col("size")
    total = F.col("passes") * size * F.col("copies")
    part = F.greatest(F.lit(0), F.least(size * F.col("copies"), F.col("rest") - F.col("at")))
    plan = groups.where("size > 0").select(
        F.col("key").alias("__key"),
        F.floor((total + part) / size).cast("int").alias("__full"),
        F.pmod(total + part, size).cast("int").alias("__part"),
    )
    seed = options.get("seed", SEED)
    once = docs.withColumn("__key", _key(seed)).dropDuplicates(["__key"]).join(plan, "__key")
    cut = F.array_join(F.slice(words(F.col("text")), 1, F.col("__part")), " ")
    copies = F.array_repeat(F.col("text"), F.col("__full"))
    texts = F.when(F.col("__part") > 0, F.concat(copies, F.array(cut))).otherwise(copies)
    out = once.withColumn("__text", F.explode(texts)).withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document.

    Null texts have size 0 and are never taken; a null source is a source of its own, the
    last; equal rows are taken one after the other.  No documents: no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return taken(quotas(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(documents: str = "documents", cell_rows: int = CELL_ROWS) -> str:
    """DuckDB SQL of ``op7_mixing`` for sources of up to ``GROUPS`` cells."""
    hashed = lambda c: f"md5(coalesce({c}, '')), CAST(CAST({c} IS NULL AS INT) AS VARCHAR)"
    weights = "[" + ", ".join(str(w) for w in WEIGHTS) + "]"
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '-'), {hashed("source")}, {hashed("text")})) AS key FROM {documents}),
n AS (SELECT source, CAST(ceil(count(DISTINCT key) / {cell_rows}) AS BIGINT) AS cells, sum(size) AS size,
  row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT source, place, size::DOUBLE AS size, {REPEATS} * size::DOUBLE AS most, {weights}[(place - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM n),
f AS (SELECT *, {SHARE} * sum(size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w WINDOW o AS (ORDER BY most / weight, place)),
full_ AS (SELECT source FROM f WHERE rest * weight / free > most),
left_ AS (SELECT {SHARE} * sum(size) - sum(CASE WHEN source IN (SELECT source FROM full_) THEN most ELSE 0 END) AS rest,
  sum(CASE WHEN source IN (SELECT source FROM full_) THEN 0 ELSE weight END) AS free FROM w),
goal AS (SELECT w.*, CASE WHEN w.source IN (SELECT source FROM full_) THEN most ELSE left_.rest * weight / nullif(left_.free, 0) END AS target FROM w, left_),
won AS (SELECT place, count(*) AS seats FROM (
  SELECT place, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r FROM
    (SELECT place, target, unnest(range(0, CAST(ceil(most / {BLOCK_WORDS}) AS BIGINT))) AS k FROM goal) WHERE target > 0)
  WHERE r <= (SELECT CAST(floor(sum(target) / {BLOCK_WORDS} + 0.5) AS BIGINT) FROM goal) GROUP BY place),
g AS (SELECT d.doc_id, d.size, d.key, goal.place, goal.size AS source_size, goal.target, CAST('0x' || substr(key, 1, 8) AS BIGINT) % n.cells AS cell
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN goal ON n.place = goal.place),
c AS (SELECT place, cell, sum(size) AS words FROM g GROUP BY place, cell),
q AS (SELECT place, cell, count(*) AS blocks FROM (
  SELECT x.place, cell, seats, row_number() OVER (PARTITION BY x.place ORDER BY words / (2 * k + 1) DESC, cell) AS r FROM
    (SELECT *, unnest(range(0, CAST(ceil({REPEATS} * words / {BLOCK_WORDS}) AS BIGINT))) AS k FROM c WHERE words > 0) x JOIN won ON x.place = won.place)
  WHERE r <= seats GROUP BY place, cell),
t AS (SELECT c.*, least(coalesce(blocks, 0) * {BLOCK_WORDS}, {REPEATS} * words) AS take FROM c LEFT JOIN q USING (place, cell)),
s AS (SELECT g.*, words, take, coalesce(sum(g.size) OVER (PARTITION BY g.place, g.cell ORDER BY key, g.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM g JOIN t ON g.place = t.place AND g.cell = t.cell)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(take // greatest(words, 1) * size + greatest(0, least(size, take % greatest(words, 1) - ahead)) AS BIGINT) AS taken FROM s"""


ORACLE = {"op7_mixing": mixing_sql()}
