"""Repeated substrings by enhanced suffix arrays over content-defined anchors.

A string of ``length`` bytes holds one anchor that its own bytes determine: the k-gram of
least hash in it (the last of equals).  Equal strings so have equal anchors at equal
offsets, and every repeat of ``length`` bytes is found among the suffixes at occurrences of
one anchor.  Each anchor's occurrences form a small enhanced suffix array: their right
contexts in order with common-prefix lengths.  A stack scan yields its interval tree;
within an interval (all occurrences with a common right context, not just neighbours) the
left contexts are scanned the same way, and where left extensions differ an interval ends:
its members are a maximal repeat group.

Most anchors need none of this.  One that occurs once repeats nothing; occurrences whose
whole contexts are equal repeat in full.  Both are decided by counts of hashes (64 bits of
the anchor and 64 of the context, so 128 that agree), summed before they are shuffled, and
only distinct contexts go to a suffix array.

An anchor with more distinct contexts than one array takes is split: its windows start from
0 to length - gram bytes before it, and those of either half of this range share more bytes on
one side, so contexts that differ there part.  Members of a part that agree in all its windows
are an interval already, and one of them goes on for all; so a passage shared by many contexts
leaves only the halves that its edge crosses, eight at most.  Parts are split on until an array
takes them; a part of a single string always is one interval.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import materialize, mix64, only, per_batch, random64, scratch, table, without

LENGTH, GRAM = 200, 32
#: Distinct contexts that one suffix array takes; wider anchors are split.
MAX_CONTEXTS = 1_000
#: Bytes of a text that are worked on at a time.
BLOCK = 1 << 19
_BYTE = random64(256, 51)
_STEP = [int(x) | 1 for x in random64(16, 53)]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of ``width`` bytes: sums for powers of two, doubled and joined."""
    h, size, out, done = _BYTE[data], 1, None, 0
    level = 0
    while True:
        if width & size:
            n = len(data) - done - size + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = h[done : done + n].copy() if out is None else out[:n] * np.uint64(_STEP[level + 8 & 15]) + h[done : done + n]
            done += size
        if size * 2 > width:
            return mix64(out)
        if len(h) <= size:
            return np.zeros(0, np.uint64)
        h = h[:-size] * np.uint64(_STEP[level]) + h[size:]
        size *= 2
        level += 1


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """[hash, context hash, place, first window, last window] of the anchors of one text.

    The windows (strings of ``length`` bytes, by start) that an anchor belongs to are
    consecutive; its context is all their bytes and its place among them."""
    parts = []
    n, width = len(data) - length + 1, length - gram + 1
    for lo in range(0, max(n, 0), BLOCK):
        hi = min(n, lo + BLOCK)
        block = data[lo : hi + length - 1]
        h = gram_hashes(block, gram)
        # High bits are the hash's, low bits tell the last of equals.
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        best, size = key, 1
        while size * 2 <= width:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        best = np.minimum(best[: hi - lo], best[width - size :][: hi - lo])
        at = (low - (best & low)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:] - 1, hi - lo - 1)
        at = at[first]
        # Running sums of bytes times powers of an odd number: any substring's hash in constant time.
        power, inverse = _powers()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[block] * power[: len(block)])])
        ctx = (sums[last + length] - sums[first]) * inverse[first]
        ctx = mix64(ctx + (at - first).astype(np.uint64) * np.uint64(_STEP[9]) + (last - first).astype(np.uint64))
        parts.append((h[at].view(np.int64), ctx.view(np.int64), at + lo, first + lo, last + lo))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5


_kept_powers: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as a block has bytes."""
    if not _kept_powers:
        base = 0xD1342543DE82EF95
        for step in (base, pow(base, -1, 2**64)):
            p = np.ones(1, np.uint64)
            while len(p) < BLOCK + LENGTH * 4:
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step % 2**64
            _kept_powers.append(p)
    return _kept_powers


def _texts(column) -> Iterator[tuple[int, np.ndarray]]:
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield i, data[offs[i] : offs[i + 1]] if valid[i] else data[:0]


def anchor_rows(packed: DataFrame, length: int) -> DataFrame:
    """(row, anchor, ctx, at, lo, hi) of every anchor of the packed texts."""
    gram = min(GRAM, length)

    def run(b: pa.RecordBatch):
        un = zstandard.ZstdDecompressor()
        cols: list[list] = [[] for _ in range(6)]
        size = 0
        for i, row in enumerate(b.column(0).to_pylist()):
            found = anchors(np.frombuffer(un.decompress(b.column(1)[i].as_py()), np.uint8), length, gram)
            for c, x in zip(cols, (np.full(len(found[0]), row), *found), strict=True):
                c.append(x)
            size += len(found[0])
            if size > 100_000 or i + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["row", "anchor", "ctx", "at", "lo", "hi"])
                cols, size = [[] for _ in range(6)], 0

    return per_batch(packed.select("row", "packed"), run, "row long, anchor long, ctx long, at long, lo long, hi long")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of depth ``least`` or more: the
    nodes of the suffix tree, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > depth:
            d, start = stack.pop()
            if d >= least:
                yield d, start, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def repeat_groups(befores: list[bytes], afters: list[bytes], least: int, total: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeat groups among the occurrences of one anchor.

    ``afters`` are the bytes from the anchor on, ``befores`` those before it, reversed.
    Yields (bytes to the left, bytes to the right, occurrences) for every group whose
    repeat has ``total`` bytes or more.
    """
    order = sorted(range(len(afters)), key=afters.__getitem__)
    lcp = [common_prefix(afters[i], afters[j]) for i, j in zip(order[:-1], order[1:], strict=True)]
    # No repeat reaches further to the left than the second longest left context.
    reach = sorted(map(len, befores))[-2]
    for depth, first, last in intervals(lcp, max(least, total - reach)):
        rows = sorted(order[first : last + 1], key=befores.__getitem__)
        back = [common_prefix(befores[i], befores[j]) for i, j in zip(rows[:-1], rows[1:], strict=True)]
        # Left extensions that differ end an interval; equal ones reach further to the left.
        for left, a, b in intervals(back, max(0, total - depth)):
            yield left, depth, rows[a : b + 1]


def group_windows(ctxs: list[int], befores: list[bytes], afters: list[bytes], spans: list[tuple[int, int]], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(ctx, first offset, last offset): windows of the distinct contexts of one anchor that
    start so many bytes before it and are repeated in another context.

    spans are the offsets of the windows that count for each context."""
    found: dict[int, set] = {}
    if len(ctxs) > 1:
        for reach, depth, rows in repeat_groups(befores, afters, gram, length):
            for i in rows:
                a, b = max(spans[i][0], length - depth), min(spans[i][1], reach)
                if a <= b:
                    found.setdefault(i, set()).add((a, b + 1))
    return [(ctxs[i], a, b - 1) for i, runs in found.items() for a, b in merged(runs)]


def repeated_windows(packed: DataFrame, length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(row, lo, hi): runs of starts of the strings of ``length`` bytes that start elsewhere
    too, in texts (row, packed)."""
    gram = min(GRAM, length)
    every = materialize(anchor_rows(packed, length), "anchors")
    # Counts are written before they are joined: the join then is a plain one, whose hot keys the
    # engine splits.  Anchors that occur again are a share of all at any size: both sides are shuffled.
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("anchor")
    met = materialize(every.join(materialize(again, "again"), "anchor", "left_semi"), "met")
    ctx = met.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "lo", "hi")).alias("rep"))
    ctx = materialize(ctx, "contexts")
    # Full: the whole context occurs again.  Open: it meets other contexts of its anchor.
    twice = materialize(ctx.where("n > 1").select("anchor", "ctx"), "full")
    full = met.join(twice, ["anchor", "ctx"], "left_semi").select("row", "lo", "hi")
    kinds = materialize(ctx.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    open_ = materialize(ctx.join(kinds, "anchor").select("anchor", "ctx", "n", "kinds", "rep.*"), "open")
    # Bytes of one representative for each open context, cut from the texts.
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("anchor", "ctx", "n", "kinds", "at", "lo", "hi")).alias("asks"))
    asked = open_.select("row").distinct()
    cut = only(packed.select("row", "packed"), asked, "row").join(wanted, "row").select("packed", "asks")

    def contexts(b: pa.RecordBatch):
        un = zstandard.ZstdDecompressor()
        asks = b.column(1)
        ends = np.cumsum(pa.compute.list_value_length(asks).to_numpy())
        flat = asks.flatten()
        at, lo, hi = (flat.field(k).to_numpy() for k in ("at", "lo", "hi"))
        done = 0
        before, after = [], []
        for i in range(b.num_rows):
            data = un.decompress(b.column(0)[i].as_py())
            for k in range(int(ends[i - 1]) if i else 0, int(ends[i])):
                before.append(data[lo[k] : at[k]][::-1])
                after.append(data[at[k] : hi[k] + length])
            if len(before) > 5000 or i + 1 == b.num_rows:
                some = slice(done, done + len(before))
                cols = [*(flat.field(c).slice(done, len(before)) for c in ("anchor", "ctx", "n", "kinds")), pa.array(at[some] - hi[some]), pa.array(at[some] - lo[some]), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "ctx", "n", "kinds", "first", "last", "before", "after"])
                done, before, after = done + len(before), [], []

    cut = materialize(per_batch(cut, contexts, "anchor long, ctx long, n long, kinds long, first long, last long, before binary, after binary"), "cut")

    def suffix_arrays(batches):
        group: dict[str, list] = {}
        key = None

        def close():
            yield from group_windows(group["ctx"], group["before"], group["after"], list(zip(group["first"], group["last"], strict=True)), length, gram)

        out: list = []
        for b in batches:
            cols = {name: b.column(i).to_pylist() for i, name in enumerate(("part", "anchor", "ctx", "first", "last", "before", "after"))}
            for i, a in enumerate(cols["part"]):
                if a != key:
                    if key is not None:
                        out.extend((group["anchor"][0], *x) for x in close())
                    key, group = a, {n: [] for n in ("anchor", "ctx", "first", "last", "before", "after")}
                for n, v in group.items():
                    v.append(cols[n][i])
                if len(out) > 20_000:
                    yield _offsets(out)
                    out = []
        if key is not None:
            out.extend((group["anchor"][0], *x) for x in close())
        if out:
            yield _offsets(out)

    # Parts (lo, hi) of an anchor: its windows that start lo to hi bytes before it.
    whole = cut.withColumns({"part": F.unhex(F.hex("anchor")), "lo": F.lit(0), "hi": F.lit(length - gram)})
    small, wide = whole.where(F.col("kinds") <= max_contexts), whole.where(F.col("kinds") > max_contexts)
    ready, known = [small], []
    while not wide.isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        # Members share the bytes that all windows of their part have: lo before, length - hi after.
        halves = wide.select("*", F.explode(F.array(F.struct(F.col("lo").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("hi").alias("h")))).alias("half"))
        halves = halves.select("part", "anchor", "ctx", "n", "first", "last", "before", "after", F.col("half.l").alias("lo"), F.col("half.h").alias("hi"))
        own = {"a": F.greatest("first", "lo"), "b": F.least("last", "hi")}
        halves = halves.withColumns(own).where("a <= b")
        # 128 bits of the part above and the shared bytes, and 128 of all bytes of the member's own windows here.
        shared = F.md5(F.concat("part", *_sides("lo", "hi", F.col("lo"), F.lit(length) - F.col("hi"))))
        every_byte = F.md5(F.concat(*_sides("a", "b", F.col("b"), F.lit(length) - F.col("a"))))
        halves = materialize(halves.withColumns({"part": F.unhex(shared), "whole": F.unhex(every_byte)}), "halves")
        # Members whose windows here are all equal repeat each other, and one of them meets the others.
        one = F.min(F.struct("anchor", "ctx", "n", "first", "last", "before", "after", "lo", "hi"))
        classes = materialize(halves.groupBy("part", "whole").agg(F.count(F.lit(1)).alias("members"), one.alias("one")), "classes")
        known.append(halves.where("n = 1").join(classes.where("members > 1").select("part", "whole"), ["part", "whole"], "left_semi"))
        sizes = materialize(classes.groupBy("part").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "sizes")
        met_here = materialize(classes.select("part", "one.*").join(sizes, "part"), "split")
        ready.append(met_here.where(F.col("kinds") <= max_contexts))
        wide = met_here.where(F.col("kinds") > max_contexts)
    columns = ("part", "anchor", "ctx", F.greatest("first", "lo").alias("first"), F.least("last", "hi").alias("last"), "before", "after")
    arrays = ready[0].select(*columns)
    for r in ready[1:]:
        arrays = arrays.unionByName(r.select(*columns))
    part = arrays.repartition("part").sortWithinPartitions("part").mapInArrow(suffix_arrays, _OFFSETS)
    for x in known:
        part = part.unionByName(x.select("anchor", "ctx", F.col("a").cast("long"), F.col("b").cast("long")))
    part = materialize(part.distinct(), "parts")
    # A context that occurs again is full already, so a part's context has one occurrence: its representative.
    alone = open_.where("n = 1").select("anchor", "ctx", "row", "at")
    part = part.join(alone, ["anchor", "ctx"]).select("row", (F.col("at") - F.col("b")).alias("lo"), (F.col("at") - F.col("a")).alias("hi"))
    return full.union(part)


_OFFSETS = "anchor long, ctx long, a long, b long"


def _sides(first: str, last: str, before, after) -> tuple:
    """Binary columns to hash: two offsets, and so many bytes on either side of the anchor, whose lengths the offsets tell."""
    offsets = F.encode(F.concat_ws(",", F.lit(""), first, last, F.lit("")), "utf-8")
    return offsets, F.substring(F.col("before"), F.lit(1), before), F.substring(F.col("after"), F.lit(1), after)


def _offsets(rows: list) -> pa.RecordBatch:
    x = np.array(rows, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, i].copy()) for i in range(4)], ["anchor", "ctx", "a", "b"])


def pack(docs: DataFrame) -> DataFrame:
    """(row, key, packed): every row of ``docs`` (key, text) with a number of its own and its
    text compressed, for the shuffles that carry it."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "key", F.coalesce("text", F.lit("")).alias("text"))

    def run(b: pa.RecordBatch):
        z = zstandard.ZstdCompressor(level=1)
        lo, out, size = 0, [], 0
        for i, data in _texts(b.column(2)):
            out.append(z.compress(data.tobytes()))
            size += len(data)
            if size > 4 << 20 or i + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, i + 1 - lo), b.column(1).slice(lo, i + 1 - lo), pa.array(out, pa.binary())], ["row", "key", "packed"])
                lo, out, size = i + 1, [], 0

    return per_batch(docs, run, docs.select("row", "key").schema.add("packed", "binary"))


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cleaned(docs: DataFrame, length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(key, kept binary, spans array<struct<start,end>>, n_bytes) of ``docs`` (key, text):
    the bytes of every text without those that a repeated string of ``length`` bytes covers,
    and the removed runs (bytes, end exclusive).

    Null texts are empty.  Every row is a text of its own, whatever its key: equal rows of
    ``length`` bytes or more remove each other.
    """
    packed = materialize(pack(docs), "packed")
    with scratch():
        runs = repeated_windows(packed, length, max_contexts)
        runs = materialize(runs.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs", keep=True)
    hit = runs.select("row")
    # Only texts that lose something meet their runs.
    touched = only(packed, hit, "row").join(runs, "row").select("key", "packed", "runs")
    rest = without(packed, hit, "row").select("key", "packed", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    todo = touched.union(rest)

    def run(b: pa.RecordBatch):
        un = zstandard.ZstdDecompressor()
        rows, kept, spans, sizes, size, lo = b.column(0), [], [], [], 0, 0
        runs = b.column(2)
        flat = runs.flatten()
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(runs), 0).to_numpy())
        starts, stops = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        for i in range(b.num_rows):
            data = un.decompress(b.column(1)[i].as_py())
            a, e = (int(ends[i - 1]) if i else 0), int(ends[i])
            cut = merged(zip(starts[a:e].tolist(), (stops[a:e] + length).tolist(), strict=True))
            at, left = 0, []
            for s, t in cut:
                left.append(data[at:s])
                at = t
            left.append(data[at:])
            kept.append(b"".join(left))
            spans.append([{"start": s, "end": t} for s, t in cut])
            sizes.append(len(data))
            size += len(data)
            if size > 4 << 20 or i + 1 == b.num_rows:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([rows.slice(lo, i + 1 - lo), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(sizes, pa.int64())], ["key", "kept", "spans", "n_bytes"])
                kept, spans, sizes, size, lo = [], [], [], 0, i + 1

    schema = todo.select("key").schema.add("kept", "binary")
    return per_batch(todo, run, schema.add("spans", ArrayType(StructType().add("start", "long").add("end", "long"))).add("n_bytes", "long"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document's bytes without strings of 200 bytes that start twice.

    Null texts are empty and lose nothing; rows that repeat, with or without a doc_id, are texts of
    their own and remove each other; an empty table gives no rows.  Extra columns are not read.
    """
    out = cleaned(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("key").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
