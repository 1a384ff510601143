"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full sets decide.

An odd sketch folds a document's MinHash samples into a bitmap of parities.  Samples that
two documents share cancel in the XOR of their bitmaps, so its population count estimates
how many differ, most precisely where few do.

No bucket's pairs are ever written out: in each round a bucket's leader, the open member
that meets most others over all its buckets, is compared with the members of other
components; found links join components, and a bucket whose members are one component is
closed.  Members of different components in buckets that stay open after ``ROUNDS`` are
compared by sketch in blocks of bounded size, inside tasks that give only likely pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, materialize, mix64, only, per_batch, random64, scratch, slices, table, word_hashes

#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8**6)**48 < 1e-6.
BANDS, ROWS = 48, 6
#: MinHash samples folded into a sketch of SKETCH_BITS bits.
SAMPLES, SKETCH_BITS = BANDS * ROWS, 1024
#: Sketches estimating a similarity more than this below the threshold (over 5 standard deviations) end a candidate.
MARGIN = 0.16
PERCENT = 80
ROUNDS = 3
#: Samples, bits and margin of the finer sketches that members of buckets still open get.
FINE_SAMPLES, FINE_BITS, FINE_MARGIN = 2048, 8192, 0.05
#: Members of a block that are compared with each other in one task.
BLOCK = 1024
#: Members that a part of a bucket holds on average, where buckets meet a row of their own.
PART = 512

_A32 = (random64(FINE_SAMPLES, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = random64(BANDS * ROWS, 37)
_SHINGLE = random64(64, 41) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of fewer words, the whole
    sequence is one shingle; no words give an empty set."""
    h, rows, _, _ = word_hashes(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n + 1))
    if len(h) >= width:
        count = len(h) - width + 1
        s = np.zeros(count, np.uint64)
        for k in range(width):
            s += h[k : k + count] * _SHINGLE[k]
        s = mix64(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(s: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """32-bit minima of a set; every odd multiplier permutes the 32-bit hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    factors = _A32[:samples]
    best = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = max(16, (1 << 16) // samples)
    for lo in range(0, len(x), step):
        np.minimum(best, (x[lo : lo + step, None] * factors).min(0), out=best)
    return best


def odd_sketch(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """``bits`` parities of the (place, minimum) pairs, as 64-bit words."""
    at = mix64(mins.astype(np.uint64) + (np.arange(len(mins), dtype=np.uint64) << np.uint64(40)))
    odd = np.bincount((at % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)


def fine_sketches(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, fine array<long>) of (doc_id, text)."""

    def run(b: pa.RecordBatch):
        for lo, hi, data, offs in slices(b.column(1)):
            fine = [odd_sketch(minhash(s, FINE_SAMPLES), FINE_BITS).view(np.int64) for s in shingle_sets(data, offs, width)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(fine, pa.list_(pa.int64()))], ["doc_id", "fine"])

    return per_batch(texts.select("doc_id", "text"), run, "doc_id long, fine array<long>")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, own, n, set1, set2, bands array<long>, sketch array<long>) of (doc_id, text, own);
    set1, set2 tell sets apart."""

    def run(b: pa.RecordBatch):
        for lo, hi, data, offs in slices(b.column(1)):
            n, s1, s2, bands, sketch = [], [], [], [], []
            for s in shingle_sets(data, offs, width):
                n.append(len(s))
                s1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int((mix64(s ^ np.uint64(0x5DEECE66D)) * _SHINGLE[0]).sum(dtype=np.uint64).view(np.int64)))
                if len(s):
                    m = minhash(s)
                    keys = mix64((m.astype(np.uint64) * _BAND).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                    bands.append(keys.view(np.int64))
                    sketch.append(odd_sketch(m).view(np.int64))
                else:
                    bands.append([])
                    sketch.append([])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "own", "n", "set1", "set2", "bands", "sketch"])

    return per_batch(docs, run, "doc_id long, own long, n long, set1 long, set2 long, bands array<long>, sketch array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the links (a, b) reaches.

    Labels spread over links and then along themselves until nothing changes; every step
    is a join and a partially aggregated minimum.  Labels only fall, so the steps end.
    """
    with scratch():
        both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
        labels = materialize(labels, "labels")
        while True:
            near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
            step = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("new"))
            # What the own root has learnt holds for the node as well.
            step = materialize(step, "labels")
            root = step.where("new < comp").groupBy(F.col("comp").alias("r")).agg(F.min("new").alias("low"))
            jump = step.join(root, step["comp"] == root["r"], "left").select("node", "comp", F.least("new", F.coalesce("low", "new")).alias("new"))
            at = jump.select(F.col("node").alias("r"), F.col("new").alias("further")).where("r <> further")
            jump = jump.join(at, jump["new"] == at["r"], "left").select("node", "comp", F.least("new", F.coalesce("further", "new")).alias("new"))
            jump = materialize(jump, "labels")
            labels = jump.select("node", F.col("new").alias("comp"))
            if jump.where("new <> comp").isEmpty():
                return materialize(labels, "components", keep=True)


#: Odd bits of two sketches up to which their estimate of the similarity leaves the threshold possible.
def _most_odd(samples: int, bits: int, margin: float) -> int:
    return int(bits / 2 * (1 - np.exp((PERCENT / 100 - margin - 1) * 4 * samples / bits)))


MOST_ODD = _most_odd(SAMPLES, SKETCH_BITS, MARGIN)
FINE_MOST_ODD = _most_odd(FINE_SAMPLES, FINE_BITS, FINE_MARGIN)


def sifted(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and odd sketches leave the threshold possible."""
    left = sigs.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    p = pairs.join(right, "b").join(left, "a").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    odd = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return p.where(odd <= MOST_ODD).select("a", "b")


def by_part(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (key, part, ...) with the one row of their bucket in ``buckets`` (key, parts, ...), which
    is copied once for each of its parts: no task gathers the members of a large bucket."""
    return rows.join(buckets.withColumn("part", F.explode(F.sequence(F.lit(1), "parts"))).drop("parts"), ["key", "part"])


def block_pairs(open_: DataFrame, sigs: DataFrame, fine: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one bucket of (key, part, parts, doc_id, n, comp) that sizes
    and odd sketches leave possible.

    A bucket of more than ``BLOCK`` members falls into blocks; each pair of blocks is a group
    of its own, so no task gathers a bucket and only likely pairs leave a task.  A pair leaves at the
    first band that it shares: had a leader settled that bucket for it, it would be tested, and
    had the bucket been closed, it would be of one component."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.max("parts").alias("parts"))
    d = by_part(open_, sizes).withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    sketches = sigs.select("doc_id", "sketch", "bands").join(fine, "doc_id")
    d = d.join(sketches, "doc_id").select("key", "lo", "hi", "own", "doc_id", "n", "comp", "sketch", "fine", "bands")

    def compare(key: int, g: list[np.ndarray]):
        lo, hi, own, doc, n, comp, sketch, fine, bands = g
        key = np.int64(key).view(np.uint64)
        left, right = (np.flatnonzero(own == lo[0]), np.flatnonzero(own == hi[0]))
        for at in range(0, len(left), 64):
            i = left[at : at + 64]
            odd = np.bitwise_count(sketch[i][:, None, :] ^ sketch[right][None]).sum(-1, dtype=np.int32)
            small, large = np.minimum(n[i][:, None], n[right]), np.maximum(n[i][:, None], n[right])
            ok = (odd <= MOST_ODD) & (comp[i][:, None] != comp[right]) & (100 * small >= PERCENT * large)
            if lo[0] == hi[0]:
                ok &= doc[i][:, None] < doc[right]
            x, y = np.nonzero(ok)
            sure = np.zeros(len(x), bool)
            for c in range(0, len(x), 4096):
                part = slice(c, c + 4096)
                a, b = i[x[part]], right[y[part]]
                apart = np.bitwise_count(fine[a] ^ fine[b]).sum(1, dtype=np.int32)
                first = (bands[a] == bands[b]).argmax(1)
                sure[part] = (apart <= FINE_MOST_ODD) & (bands[a, first] == key)
            x, y = x[sure], y[sure]
            yield np.minimum(doc[i[x]], doc[right[y]]), np.maximum(doc[i[x]], doc[right[y]])

    def run(batches):
        held: list[np.ndarray] | None = None
        key = None

        def close():
            for a, b in compare(key[0], held):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(7)]
            bits = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64) for c in (7, 8, 9)]
            change = np.zeros(batch.num_rows, bool)
            for c in cols[:3]:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                this = (cols[0][a], cols[1][a], cols[2][a])
                part = [*(c[a:b] for c in cols[1:]), *(x[a:b] for x in bits)]
                if this == key:
                    held = [np.concatenate(x) for x in zip(held, part, strict=True)]
                else:
                    if held is not None and len(held[0]) > 1:
                        yield from close()
                    key, held = this, part
        if held is not None and len(held[0]) > 1:
            yield from close()

    d = d.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return d.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs that reach the threshold on their full shingle sets, made from the whole texts.

    Texts of the right sides come to the pairs first, then those of the left sides, so a
    left side that many pairs share is stored once; its set is kept while its rows last.
    """
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    p = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(batches):
        last: tuple = (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                a_ids, ok = b.column(0).to_pylist(), []
                firsts = [i for i, a in enumerate(a_ids) if i == 0 or a != a_ids[i - 1]]
                sets_a = {}
                fresh = [i for i in firsts if a_ids[i] != last[0]]
                if fresh:
                    texts = b.column(2).take(pa.array(fresh))
                    got = [s for _, _, d, o in slices(texts) for s in shingle_sets(d, o, width)]
                    sets_a = dict(zip((a_ids[i] for i in fresh), got, strict=True))
                if last[0] is not None:
                    sets_a.setdefault(*last)
                i = 0
                for _, _, d, o in slices(b.column(3)):
                    for s in shingle_sets(d, o, width):
                        t = sets_a[a_ids[i]]
                        common = len(np.intersect1d(s, t, assume_unique=True))
                        ok.append(100 * common >= PERCENT * (len(s) + len(t) - common))
                        i += 1
                last = (a_ids[-1], sets_a[a_ids[-1]])
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return p.mapInArrow(run, "a long, b long")


def row_key() -> Column:
    """64-bit hash of a row's doc_id and text: the document that near duplicates are found by."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def near_duplicates(docs: DataFrame, width: int = 4, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, row_key, kept_key, kept) of ``docs`` (doc_id, text).

    Links join documents whose sets of ``width``-word shingles have a Jaccard similarity of
    0.8 or more; a component's id is its smallest doc_id.  Words are lower-cased for A-Z.
    Texts without words (or null) link with nothing.  Every row is a document of its own, also
    where a doc_id is null or repeats; a component of null doc_ids alone has a null id.  One
    row of a component is ``kept``, of its smallest doc_id; ``kept_key`` is that row's key.
    An empty table gives no rows.
    """
    # From here to the end doc_id is the row's key and own is its doc_id.
    known = docs.select(row_key().alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own"))
    sigs = materialize(signatures(known, width).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # Equal sets are one class; only the row of its smallest doc_id goes on.
    first = F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id", "row"))
    classes = sigs.where("n > 0").groupBy("set1", "set2", "n").agg(first.alias("first"))
    classes = materialize(classes.withColumn("rep", F.col("first.doc_id")), "classes")
    one = sigs.join(classes.select(F.col("first.row").alias("row")), "row", "left_semi")
    members = one.select(F.explode("bands").alias("key"), "doc_id", "n")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    shared = materialize(shared, "shared")
    # The few large buckets tell their members how many parts there are; the others have one.
    members = members.join(checked(shared.where("parts > 1")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("part", (F.pmod(F.xxhash64("doc_id"), "parts") + 1).cast("int"))
    members = materialize(by_part(members, shared), "members")
    used = materialize(members.select("doc_id").distinct(), "used")
    texts = materialize(only(known.select("doc_id", "text"), used, "doc_id").dropDuplicates(["doc_id"]), "texts")
    small = materialize(only(sigs.select("doc_id", "n", "sketch", "bands"), used, "doc_id").dropDuplicates(["doc_id"]), "sketches")

    spark = docs.sparkSession
    with scratch():
        comp = spark.createDataFrame([], "node long, comp long")
        links = spark.createDataFrame([], "a long, b long")
        open_ = members.withColumn("comp", F.col("doc_id"))
        tested = spark.createDataFrame([], "a long, b long")
        for k in range(rounds + 1):
            if k < rounds:
                # Weight: how many members a document meets over all its open buckets.
                met = open_.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others"), F.max("parts").alias("parts"))
                weights = by_part(open_, met).groupBy("doc_id").agg(F.sum("others").alias("w"))
                weighed = materialize(open_.join(weights, "doc_id"), "weighed")
                lead = materialize(weighed.groupBy("key").agg(F.max(F.struct("w", F.bitwise_not("doc_id").alias("m"), "doc_id", "comp")).alias("lead"), F.max("parts").alias("parts")), "leaders")
                pairs = by_part(open_, lead).where("doc_id <> lead.doc_id and comp <> lead.comp")
                pairs = pairs.select(F.least("doc_id", "lead.doc_id").alias("a"), F.greatest("doc_id", "lead.doc_id").alias("b"))
            else:
                left = open_.select("doc_id").distinct()
                pairs = block_pairs(open_, small, materialize(fine_sketches(only(texts, left, "doc_id"), width), "fine"))
            pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.union(pairs)
            likely = materialize(sifted(pairs, small), "sifted") if k < rounds else pairs
            found = materialize(confirmed(likely, texts, width), "found")
            fresh = not found.isEmpty()
            if fresh:
                links = links.union(found)
                comp = components(links)
            if k == rounds:
                break
            # The leader's pairs are settled; members that its component holds need no pair among themselves.
            rest = by_part(open_, lead).where("doc_id <> lead.doc_id").select("key", "part", "parts", "doc_id", "n")
            rest = rest.join(comp, rest["doc_id"] == comp["node"], "left").select("key", "part", "parts", "doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"))
            rest = materialize(rest, "open")
            mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("parts").alias("parts")).where("lo < hi").select("key", "parts")
            open_ = materialize(by_part(rest, mixed), "open")
            if open_.isEmpty():
                break
        comp = materialize(comp, "components", keep=True)

    # A component's kept row is the first one of its classes.
    firsts = classes.join(comp, classes["rep"] == comp["node"]).groupBy("comp").agg(F.min("first").alias("lowest"))
    lowest = comp.join(checked(materialize(firsts, "firsts")), "comp").select("node", "lowest")
    classes = classes.join(lowest, classes["rep"] == lowest["node"], "left").select("set1", "set2", F.col("n").alias("cn"), F.coalesce("lowest", "first").alias("first"))
    out = sigs.select("doc_id", "own", "row", "n", "set1", "set2")
    linked = out.where("n > 0").join(classes, (out["set1"] == classes["set1"]) & (out["set2"] == classes["set2"]) & (out["n"] == classes["cn"]), "left")
    names = ("doc_id", "n_shingles", "component_id", "row_key", "kept_key", "kept")
    linked = linked.select("own", "n", "first.own", "doc_id", "first.doc_id", F.col("row") == F.col("first.row")).toDF(*names)
    return linked.union(out.where("n = 0").select("own", "n", "own", "doc_id", "doc_id", F.lit(True)).toDF(*names))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates on 4-word shingles; one row of each, of the smallest doc_id, is kept.

    Null, empty and blank texts link with nothing and are kept; rows that repeat a doc_id or lack
    one are documents of their own; an empty table gives no rows.  ``kept`` goes by doc_id, so rows
    that share the smallest one are all kept; ``row_kept`` has a single row of each component.  Extra
    columns are not read.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"))
    by_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", by_id.alias("kept"), F.col("kept").alias("row_kept"))
