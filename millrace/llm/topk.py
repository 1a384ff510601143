"""Exact top-k inner-product search with a three-phase uniform threshold.

A score is the sum of partial scores over ``parts`` slices of the dimensions; each
slice is a node that holds its slice of the vectors and its own score lists.  Phase 1 gathers
the best partial scores of every node; the k-th best total among these entries bounds the k-th
best of all from below.  Phase 2 sends the cutoff bound / parts to all nodes, which return
every entry that reaches it: a vector below the cutoff in every slice cannot reach the bound.
Phase 3 resolves the pairs that came to their exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, scratch, table

TOP = 5
PARTS = 2
#: Entries of a node's list that phase 1 gathers from a task and keeps of all, for each wanted result.
DEPTH, KEEP = 4, 20
#: Bytes of query vectors of one pass over the vectors: what is broadcast.
QUERY_BYTES = 8 << 20
#: Queries and vectors of one matrix product inside a task.
ROWS = 2048
_LEAST = np.iinfo(np.int64).min


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(row, vec_id, v array<bigint>) of the rows whose vector is whole and finite.

    ``row`` tells rows apart; rows that repeat an id stay rows of their own.  A component that
    no long can hold is an error.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.col(vec_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**63), F.floor(x)).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))
    ints = F.transform(v, lambda x: whole(x * F.lit(float(scale))).cast("long"))
    rows = df.where(good & F.col(id_col).isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly; OverflowError if a result is beyond a long.

    float64 where no sum can leave its exact range, 64-bit integers or Python's beyond.
    """
    size = lambda x: max(-int(x.min()), int(x.max())) if x.size else 0
    bound = a.shape[1] * size(a) * size(b)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if any(not -(1 << 63) < x < 1 << 63 for x in exact.ravel()):
        raise OverflowError("a score is beyond a long")
    return exact.astype(np.int64)


def _matrix(column) -> np.ndarray:
    """Rows of one length as int64."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(n, len(flat) // n if n else 0)


def _cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    edges = [dim * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


_LISTS = "q int, part int, row long, score long"


def _arrow(q, part, row, score):
    cols = [pa.array(q.astype(np.int32)), pa.array(np.full(len(q), part, np.int32)), pa.array(row), pa.array(score)]
    return pa.RecordBatch.from_arrays(cols, ["q", "part", "row", "score"])


def _search(vectors: DataFrame, nodes: DataFrame, qrow: np.ndarray, qid: np.ndarray, qm: np.ndarray, top: int, parts: int) -> DataFrame:
    """One pass: the results of the queries (qrow, qid, qm) among the vectors of their length."""
    spark, cuts, depth, keep = vectors.sparkSession, _cuts(qm.shape[1], parts), DEPTH * top, KEEP * top
    shipped = spark.sparkContext.broadcast((qrow, qm))

    def partial(batches):
        """(node, first query, rows, partial scores) of the slices in this task; a query's own row scores least."""
        own, m = shipped.value
        for b in batches:
            node = b.column(0).to_numpy()
            for p, (lo, hi) in enumerate(cuts):
                some = b.filter(pa.array(node == p))
                for r in range(0, some.num_rows, ROWS):
                    part = some.slice(r, ROWS)
                    row, x = part.column(1).to_numpy(), _matrix(part.column(2))
                    for at in range(0, len(m), ROWS):
                        s = product(m[at : at + ROWS, lo:hi], x)
                        s[own[at : at + ROWS, None] == row] = _LEAST
                        yield p, at, row, s

    def local_lists(batches):
        best: dict[tuple[int, int], list] = {}
        for p, at, row, s in partial(batches):
            have = [s, np.broadcast_to(row, s.shape)]
            if (p, at) in best:
                have = [np.hstack(pair) for pair in zip(best[p, at], have, strict=True)]
            if have[0].shape[1] > depth:
                top_ = np.argpartition(have[0], -depth, axis=1)[:, -depth:]
                have = [np.take_along_axis(y, top_, 1) for y in have]
            best[p, at] = have
        for (p, at), (s, row) in best.items():
            i, j = np.nonzero(s > _LEAST)
            if len(i):
                yield _arrow(at + i, p, row[i, j], s[i, j])

    def resolve(batches):
        _, m = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                q, x = m[b.column(0).to_numpy()], _matrix(b.column(3))
                bound = q.shape[1] * max(abs(int(q.min())), abs(int(q.max()))) * max(abs(int(x.min())), abs(int(x.max()))) if q.size else 0
                s = np.einsum("ij,ij->i", q, x) if bound < 1 << 63 else np.array([product(q[k : k + 1], x[k : k + 1])[0, 0] for k in range(len(q))], np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(s, pa.int64())], ["q", "row", "vec_id", "score"])

    def totals(pairs: DataFrame) -> DataFrame:
        """(q, row, vec_id, score): exact scores of pairs (q, row)."""
        return pairs.join(vectors, "row").select("q", "row", "vec_id", "v").mapInArrow(resolve, "q int, row long, vec_id long, score long")

    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    # Phase 1: the best partial scores of every node; totals of these entries alone bound the k-th best of all.
    lists = materialize(nodes.mapInArrow(local_lists, _LISTS), "topk-lists")
    rank = W.partitionBy("q", "part").orderBy(F.desc("score"), "row")
    entries = lists.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= keep).select("q", "row").distinct()
    first = totals(entries).withColumn("r", F.row_number().over(best)).where(F.col("r") == top).select("q", "score")
    # A row for each query of the pass at most.  With fewer vectors than k there is no bound, and all entries come.
    cutoff = np.full(len(qid), _LEAST + 1)
    for r in first.collect():
        cutoff[r["q"]] = -(-r["score"] // parts)
    limits = spark.sparkContext.broadcast(cutoff)

    # Phase 2: every node returns all entries that reach the cutoff.
    def sufficient(batches):
        for p, at, row, s in partial(batches):
            i, j = np.nonzero(s >= limits.value[at : at + ROWS, None])
            if len(i):
                yield _arrow(at + i, p, row[j], s[i, j])

    found = materialize(nodes.mapInArrow(sufficient, _LISTS), "topk-entries")
    # Phase 3: each pair that some node returned gets its exact score.
    scored = totals(found.select("q", "row").distinct())
    names = F.broadcast(spark.createDataFrame(list(enumerate(qid.tolist())), "q int, query_id long"))  # a row for each query of the pass
    out = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.join(names, "q").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, parts: int = PARTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``top`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Both are (row long, vec_id long, v array<long>); a query never finds the row of its own
    ``row``, ties go to the smaller vec_id, and a repeated query has its results repeated.
    Vectors of another length take no part in a query.  Queries come in passes of
    ``query_bytes``, each over all slices.  Without queries or vectors there are no rows.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("dim", F.size("v")), "topk-vectors")
    queries = materialize(queries.withColumn("dim", F.size("v")), "topk-queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in sorted(queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        d, own = r["dim"], queries.where(F.col("dim") == r["dim"])
        here = vectors.where(F.col("dim") == d).drop("dim")
        # A node is one slice of the dimensions: its rows hold that slice of the vectors and no more.
        cuts = _cuts(d, parts if d >= parts else 1)
        sliced = F.posexplode(F.array(*[F.slice("v", lo + 1, hi - lo) for lo, hi in cuts])).alias("part", "s")
        nodes = materialize(here.select("row", sliced).select("part", "row", "s"), "topk-nodes")
        passes = max(1, -(-r["n"] * d * 8 // query_bytes))
        for i in range(passes):
            some = own.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).orderBy("vec_id", "row").toArrow()
            if some.num_rows:
                column = lambda c: some.column(c).to_numpy().astype(np.int64)  # noqa: E731, B023
                m = _matrix(some.column("v").combine_chunks())
                with scratch():
                    found = _search(here, nodes, column("row"), column("vec_id"), m, top, len(cuts))
                    out = out.unionByName(materialize(found, "topk-found", keep=True))
    return out


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best vectors for every row of ``embeddings`` whose vec_id is divisible by 50.

    Rows with a null id, a null vector, or null or non-finite components take no part.  Rows that
    repeat a vec_id are candidates of their own, also for each other; as queries each has its
    results.  A component or score beyond a long is an error.  No rows: no results.
    """
    v = materialize(quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "quantized")
    return top_k(v, v.where("vec_id % 50 = 0"))


ORACLE = {
    "op3_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, vec_id, len(q) AS dim, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM v),
s AS (
  SELECT a.r AS qr, a.vec_id AS query_id, b.r AS br, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.dim = b.dim AND a.r <> b.r
  WHERE a.vec_id % 50 = 0
  GROUP BY 1, 2, 3, 4),
k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
}
