"""Collocations of two to five words, by counting Apriori-safe candidates in double-array tries.

1. Words are counted for each language; frequent ones get numbers, and texts become runs of numbers, broken
   where a piece ends or a rare word stands.
2. Level by level, a phrase of k words can be frequent only if its first and its last k - 1 words are.  Places where
   both are so hash the phrase into buckets whose sums bound its count from above; the distinct
   phrases of heavy buckets are the candidates, and none that is frequent is missing.
3. The candidates become a double-array trie, which is broadcast.  numpy advances the states of all
   places of a task at once, word by word, and drops those that leave the trie; accepting states are counted by
   bincount, and the tasks' counts are summed.
4. Frequent phrases are cut in two in every way and joined with the counts of the parts.

Everything that is broadcast or comes to the driver is bounded: dictionaries of ``WORDS`` words, bitmaps of
2**``BITS`` buckets and tries of ``CANDIDATES`` phrases.  What is more comes in further blocks, each
with a pass of its own over the numbered texts, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import checked, materialize, mix64, scratch, table

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Words of a dictionary, buckets of a bitmap (as a power of two), phrases of a trie.
WORDS, BITS, CANDIDATES = 500_000, 27, 500_000
#: Entries that a task gathers before it sends them, places that it works on at a time, and words of a row of
#: numbered text (more without a break).
HELD, PLACES, ROW = 2_000_000, 1 << 18, 512
#: Phrases whose counts travel together, and groups of buckets whose keys do (as a power of two).
COUNTS, GROUPS = 1024, 10

_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with a break where a piece ends."""
    return text.translate(_FOLD).replace(_BREAK, b" \xff ").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text), and n of all words where word is null."""

    def run(batches):
        found: dict[str, Counter] = {}
        total: Counter = Counter()

        def out():
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for b in batches:
            text = b.column(1).cast(pa.large_binary())
            for lang, t in zip(b.column(0).to_pylist(), text, strict=True):
                words = tokens(t.as_py() or b"")
                c = found.setdefault(lang, Counter())
                c.update(words)
                total[lang] += len(words) - c.pop(_BREAK, 0)
                if sum(map(len, found.values())) > HELD // 8:
                    yield out()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def cut_rows(*columns: np.ndarray) -> pa.RecordBatch:
    """Arrays of equal length as rows of about ``ROW`` entries, cut after breaks (0 in the first)."""
    n = len(columns[0])
    breaks = np.flatnonzero(columns[0] == 0) + 1
    at = np.searchsorted(breaks, np.arange(ROW, n, ROW))
    ends = np.unique(np.append(breaks[at[at < len(breaks)]], n)) if n else np.zeros(0, np.int64)
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in columns], ["ids", "prev"][: len(columns)])


def kept_runs(keep: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Entries to be kept, with one 0 after each run of them."""
    keep = np.append(keep, False)
    after = ~keep & np.concatenate([[False], keep[:-1]])
    take = keep | after
    return [np.where(keep, np.append(c, 0), 0)[take] for c in columns]


def numbered(docs: DataFrame, vocabulary: list[DataFrame]) -> DataFrame:
    """(ids array<int>): the numbers of neighbouring frequent words, 0 where a run of them ends.

    vocabulary holds blocks (id, lang, word, n); each is broadcast for a pass of its own."""
    spark = docs.sparkSession
    now = docs.select("lang", "text", F.lit(None).cast("array<int>").alias("ids"))
    for k, block in enumerate(vocabulary):
        rows = block.select("id", "lang", "word").toArrow()
        shipped, last = spark.sparkContext.broadcast(rows), k + 1 == len(vocabulary)

        def run(batches, shipped=shipped, last=last):
            class Numbers(dict):
                def __missing__(self, _):
                    return 0

            number: dict[str, Numbers] = {}
            rows = shipped.value
            for i, lang, w in zip(rows["id"].to_pylist(), rows["lang"].to_pylist(), rows["word"].cast(pa.binary()).to_pylist(), strict=True):
                number.setdefault(lang, Numbers())[w] = i
            none, held, size = Numbers(), [], 0
            for b in batches:
                text = b.column(1).cast(pa.large_binary())
                each = []
                for j, (lang, t) in enumerate(zip(b.column(0).to_pylist(), text, strict=True)):
                    ids = np.array(list(map(number.get(lang, none).__getitem__, tokens(t.as_py() or b""))), np.int32)
                    if b.column(2)[j].is_valid:
                        had = np.array(b.column(2)[j].as_py(), np.int32)
                        ids = np.where(had > 0, had, ids)
                    if not last:
                        each.append(ids)
                        continue
                    pair = (ids[:-1] > 0) & (ids[1:] > 0)
                    if pair.any():
                        keep = np.append(pair, False) | np.append(False, pair)
                        held += kept_runs(keep, ids)
                        size += len(held[-1])
                    if size > HELD:
                        yield cut_rows(np.concatenate(held))
                        held, size = [], 0
                if not last:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in each], pa.list_(pa.int32()))], ["lang", "text", "ids"])
            if held:
                yield cut_rows(np.concatenate(held))

        now = materialize(now.mapInArrow(run, "ids array<int>" if last else now.schema), "numbered")
    return now


class Trie:
    """A double-array trie of phrases of k numbers, each in ``digits`` bytes: from state s, byte c leads to
    base[s] + c if check there is s.  A final state has -1 - (the phrase's row) for base."""

    def __init__(self, phrases: np.ndarray, most: int):
        """phrases: distinct rows of numbers from 1 to ``most``."""
        self.k, self.digits = phrases.shape[1], max(1, (int(most).bit_length() + 7) // 8)
        shifts = np.arange(self.digits - 1, -1, -1) * 8
        syms = ((phrases[:, :, None] >> shifts) & 255).reshape(len(phrases), -1)
        order = np.lexsort(syms.T[::-1])
        syms = syms[order]
        # Nodes are distinct prefixes: one more wherever a sorted row leaves the prefix of the row above.
        parents, symbols, children = [], [], []
        above, new, count = np.zeros(len(syms), np.int64), np.zeros(len(syms), bool), 1
        for d in range(syms.shape[1]):
            new[0] = True
            new[1:] |= syms[1:, d] != syms[:-1, d]
            here = count + np.cumsum(new) - 1
            parents.append(above[new])
            symbols.append(syms[new, d])
            children.append(here[new])
            above, count = here, here[-1] + 1
        parent, symbol, child = map(np.concatenate, (parents, symbols, children))
        base = self._placed(parent, symbol)
        slot = np.zeros(count, np.int64)
        slot[child] = base[parent] + symbol
        size = int(slot.max()) + 257
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.base[slot[: len(base)]] = base
        self.base[slot[above]] = -1 - order
        self.check[slot[child]] = slot[parent]

    @staticmethod
    def _placed(parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A base for each inner node (0 to the largest parent), so that no two children share a slot.

        Nodes of many children get 256 slots of their own; the others are tried all at once at random
        bases, and those that meet no other stay."""
        first = np.flatnonzero(np.diff(parent, prepend=-1))
        degree = np.diff(np.append(first, len(parent)))
        base = np.zeros(len(first), np.int64)
        wide = np.flatnonzero(degree >= 16)
        base[wide] = 256 * (1 + np.arange(len(wide)))
        size = 256 * (len(wide) + 2) + 4 * int(degree[degree < 16].sum())
        used = np.zeros(size + 256, bool)
        used[0] = True  # the root's own slot
        used[base[parent] + symbol] |= np.isin(parent, wide)
        rng = np.random.default_rng(7)
        todo = np.flatnonzero(degree < 16)
        todo = todo[np.argsort(-degree[todo], kind="stable")]
        while len(todo):
            trial = rng.integers(0, size, len(todo))
            starts = np.cumsum(degree[todo]) - degree[todo]
            node = np.repeat(np.arange(len(todo)), degree[todo])
            edge = np.arange(len(node)) - starts[node] + first[todo][node]
            at = trial[node] + symbol[edge]
            owner = np.empty(len(used), np.int64)
            owner[at[::-1]] = node[::-1]  # the node that comes first, of more children
            fits = np.logical_and.reduceat(~used[at] & (owner[at] == node), starts)
            base[todo[fits]] = trial[fits]
            used[at[fits[node]]] = True
            if fits.sum() * 20 < len(todo):
                used, size = np.concatenate([used, np.zeros(size, bool)]), size * 2
            todo = todo[~fits]
        return base

    def walk(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, phrase rows): where in ``ids``, of the places ``at``, phrases of the trie start."""
        state = np.zeros(len(at), np.int32)
        for j in range(self.k):
            word = ids[at + j]
            for d in range(self.digits - 1, -1, -1):
                step = self.base[state] + ((word >> (8 * d)) & 255)
                live = self.check[step] == state
                at, word, state = at[live], word[live], step[live]
        return at, -1 - self.base[state]


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PLACES`` words together."""
    for b in batches:
        # The offsets of a slice are those of the whole column: they need not begin at 0.
        offsets, lo = b.column(0).offsets.to_numpy(), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PLACES, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _columns(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, prev, places whose phrase of one word more may be frequent) of every part of rows (ids[, prev])."""
    return map(_part_columns, _parts(batches))


def _part_columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one part as a whole."""
    ids = b.column(0).flatten().to_numpy()
    prev = b.column(1).flatten().to_numpy() if b.num_columns > 1 else ids
    return ids, prev, np.flatnonzero((prev[:-1] > 0) & (prev[1:] > 0)) if len(prev) else np.zeros(0, np.int64)


def _key(prev: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phrases by the numbers of their first and last k - 1 words: 64 bits, equal for equal phrases only."""
    return prev[at].astype(np.uint64) << np.uint64(32) | prev[at + 1].astype(np.uint64)


def heavy_buckets(texts: DataFrame, support: int, bits: int, rounds: int, turn: int) -> DataFrame:
    """(bucket, lo, hi): buckets whose phrases occur ``support`` times together, and their least and largest key.

    Keys travel as arrays, one for each group of neighbouring buckets of what a task gathered; buckets follow from keys."""

    def count(batches):
        held, size = [], 0
        for _, prev, at in _columns(batches):
            key = _key(prev, at)
            if rounds > 1:
                key = key[mix64(key) % np.uint64(rounds) == turn]
            held.append(key)
            size += len(key)
            if size > HELD:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    top = min(GROUPS, bits)

    def out(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        group = (mix64(key) >> np.uint64(64 - top)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        key, n, group = key[order].view(np.int64), n[order].astype(np.int32), group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        offsets = pa.array(np.append(first, len(group)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (key, n)]
        return pa.RecordBatch.from_arrays([pa.array(group[first]), *lists], ["group", "key", "n"])

    def heavy(keys, counts):
        key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        bucket = (mix64(key.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, n, bucket = key[order], n[order], bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        use = np.add.reduceat(n, first) >= support
        lo, hi = np.minimum.reduceat(key, first)[use], np.maximum.reduceat(key, first)[use]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first][use]), pa.array(lo), pa.array(hi)], ["bucket", "lo", "hi"])

    def added(batches):
        keys, counts, now = [], [], None
        for b in batches:
            group = b.column(0).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                if lo < hi and keys and group[lo] != now:
                    yield heavy(keys, counts)
                    keys, counts = [], []
                if lo < hi:
                    now = group[lo]
                    part = b.slice(lo, hi - lo)
                    # Copies, as a batch's memory is not to be held.
                    keys.append(part.column(1).flatten().to_numpy().copy())
                    counts.append(part.column(2).flatten().to_numpy().copy())
        if keys:
            yield heavy(keys, counts)

    counts = texts.mapInArrow(count, "group int, key array<long>, n array<int>").repartition("group").sortWithinPartitions("group")
    return materialize(counts.mapInArrow(added, "bucket int, lo long, hi long"), "heavy")


def bitmap_of(buckets: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2**bits buckets, packed by tasks in blocks of 2**16."""

    def packed(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            block, bucket = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(block):
                found.setdefault(int(k), np.zeros(1 << 16, bool))[bucket[block == k] & 0xFFFF] = True
        for k, bit in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bit).tobytes()], pa.binary())], ["block", "bits"])

    bitmap = np.zeros(max(1 << bits >> 3, 1 << 13), np.uint8)
    blocks = buckets.select(F.shiftright("bucket", 16).alias("block"), "bucket").repartition("block")
    for r in blocks.mapInArrow(packed, "block int, bits binary").collect():
        bitmap[r["block"] << 13 : r["block"] + 1 << 13] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def candidates(texts: DataFrame, shorter: list[DataFrame], k: int, support: int, occurrences: int, most_bits: int) -> list[DataFrame]:
    """Tables (w1 .. wk) of distinct phrases, among them all that occur ``support`` times; ``shorter`` has the
    frequent phrases of k - 1 words (id, w1 ..), if these are not words themselves.

    There are about as many buckets as occurrences, up to 2**most_bits; beyond that, hashes take turns.  A
    heavy bucket of one phrase names it by its key; only for those that phrases share the texts are
    searched again.
    """
    bits = min(most_bits, max(16, int(occurrences).bit_length()))
    rounds = max(1, int(occurrences) >> (bits + 3))
    names, out = [f"w{j + 1}" for j in range(k)], []
    for turn in range(rounds):
        heavy = heavy_buckets(texts, support, bits, rounds, turn)
        first, last = F.shiftright("lo", 32), F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF))
        found = heavy.where("lo = hi").select(first.cast("int").alias("w1"), last.cast("int").alias(f"w{k}"))
        if k > 2:
            every = shorter[0]
            for part in shorter[1:]:
                every = every.unionByName(part)
            begin = every.select(F.col("id").alias("begin"), *[F.col(n).cast("int").alias(n) for n in names[:-1]])
            end = every.select(F.col("id").alias("end"), F.col(names[-2]).cast("int").alias(names[-1]))
            pair = found.select(F.col("w1").alias("begin"), F.col(f"w{k}").alias("end"))
            found = pair.join(checked(begin), "begin").join(checked(end), "end").select(*names)
        shared = heavy.where("lo <> hi")
        if not shared.isEmpty():
            found = found.unionByName(_searched(texts, k, bitmap_of(shared, bits), bits, rounds, turn).distinct())
        out.append(materialize(found, f"candidates-{k}"))
    return out


def _searched(texts: DataFrame, k: int, bitmap: np.ndarray, bits: int, rounds: int, turn: int) -> DataFrame:
    """(w1 .. wk) of the phrases in the buckets of a bitmap, some more than once."""
    shipped, names = texts.sparkSession.sparkContext.broadcast(bitmap), [f"w{j + 1}" for j in range(k)]

    def run(batches):
        bit = shipped.value
        seen = np.zeros(0, np.uint64)
        for ids, prev, at in _columns(batches):
            key = _key(prev, at)
            h = mix64(key)
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            use = (bit[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool)
            if rounds > 1:
                use &= h % np.uint64(rounds) == turn
            key, where = np.unique(key[use], return_index=True)
            new = ~np.isin(key, seen)
            key, at = key[new], at[use][where[new]]
            seen = np.concatenate([seen if len(seen) < HELD else seen[:0], key])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + j]) for j in range(k)], names)

    return texts.mapInArrow(run, ", ".join(f"{n} int" for n in names))


def _matrix(rows: pa.Table, k: int) -> np.ndarray:
    return np.stack([rows[f"w{j + 1}"].to_numpy() for j in range(k)], 1).astype(np.int64)


def counted(texts: DataFrame, trie: Trie) -> DataFrame:
    """(row, n): occurrences of every phrase of the trie that occurs.

    A task sends its bincount in blocks of ``COUNTS`` phrases, at most one number for each phrase of the trie
    however much text it has read; the blocks of all tasks are added up as they come in."""
    shipped = texts.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        total = np.zeros(0, np.int64)
        for ids, _, at in _columns(batches):
            n = np.bincount(shipped.value.walk(ids, at)[1])
            if len(total) < len(n):
                total, n = n, total
            total[: len(n)] += n
        for lo in range(0, len(total), COUNTS):
            some = total[lo : lo + COUNTS]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // COUNTS], pa.int32()), pa.array([some], pa.list_(pa.int64()))], ["block", "n"])

    def added(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                n = b.column(1).slice(i, 1).flatten().to_numpy()
                had = found.setdefault(block, np.zeros(COUNTS, np.int64))
                had[: len(n)] += n
        for block, n in found.items():
            row = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array((row + block * COUNTS).astype(np.int32)), pa.array(n[row])], ["row", "n"])

    return texts.mapInArrow(run, "block int, n array<long>").repartition("block").mapInArrow(added, "row int, n long")


def frequent(texts: DataFrame, some: list[DataFrame], k: int, support: int, most: int, most_candidates: int) -> list[DataFrame]:
    """Tables (id, w1 .. wk, n) of the candidates that occur ``support`` times; ids count from 1."""
    spark, out, done = texts.sparkSession, [], 0
    names = [f"w{j + 1}" for j in range(k)]
    for table_ in some:
        blocks = -(-table_.count() // most_candidates)
        for i in range(blocks):
            mine = _matrix(table_.where(F.pmod(F.xxhash64(*names), F.lit(blocks)) == i).toArrow(), k)
            if not len(mine):
                continue
            n = counted(texts, Trie(mine, most)).where(F.col("n") >= support).toArrow()
            mine, n = mine[n["row"].to_numpy()], n["n"].to_numpy()
            if len(n):
                columns = [np.arange(done + 1, done + 1 + len(n)), *mine.T, n]
                rows = pa.table([pa.array(c.astype(np.int64)) for c in columns], ["id", *names, "n"])
                out.append(materialize(spark.createDataFrame(rows), f"phrases-{k}"))
                done += len(n)
    return out


def advanced(texts: DataFrame, found: list[DataFrame], k: int, most: int) -> DataFrame:
    """(ids, prev): the texts' stretches that hold frequent phrases of k words; prev has the phrase's
    number where one starts."""
    spark = texts.sparkSession
    for i, block in enumerate(found):
        rows = block.toArrow()
        shipped = spark.sparkContext.broadcast((Trie(_matrix(rows, k), most), rows["id"].to_numpy().astype(np.int32)))
        last = i + 1 == len(found)

        def run(batches, shipped=shipped, last=last, first=i == 0):
            trie, number = shipped.value
            for b in _parts(batches):
                had = b.column(b.num_columns - 1).flatten().to_numpy() if not first else None
                ids, prev, at = _part_columns(b)
                state = had.copy() if had is not None else np.zeros(len(ids), np.int32)
                at, row = trie.walk(ids, at)
                state[at] = number[row]
                if not last:
                    of = b.column(0).offsets
                    of = pa.array(of.to_numpy() - of[0].as_py())
                    cols = [pa.ListArray.from_arrays(of, pa.array(c)) for c in (ids, prev, state)]
                    yield pa.RecordBatch.from_arrays(cols, ["ids", "prev", "state"])
                    continue
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, np.flatnonzero(state), 1)
                np.add.at(edge, np.flatnonzero(state) + k, -1)
                ids, state = kept_runs(np.cumsum(edge[:-1]) > 0, ids, state)
                if len(ids):
                    yield cut_rows(ids, state)

        texts = materialize(texts.mapInArrow(run, "ids array<int>, prev array<int>" + ("" if last else ", state array<int>")), f"texts-{k}")
    return texts


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, words: int = WORDS, bits: int = BITS, most_candidates: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(lang, words array<string>, f) of all phrases of up to ``longest`` words that occur ``support`` times in a language,
    and (lang, n) of all its words.  Null texts are empty; documents without a language are ``und``."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(word_counts(docs).where(F.col("word").isNull() | (F.col("n") >= support)), "words")
    totals = counts.where(F.col("word").isNull()).select("lang", "n")
    common = counts.where(F.col("word").isNotNull())
    many = common.count()
    blocks, vocabulary, done = -(-many // words), [], 0
    for i in range(blocks):
        rows = common.where(F.pmod(F.xxhash64("lang", "word"), F.lit(blocks)) == i).toArrow()
        rows = rows.append_column("id", pa.array(np.arange(done + 1, done + 1 + rows.num_rows), pa.int32()))
        vocabulary.append(materialize(spark.createDataFrame(rows), "vocabulary"))
        done += rows.num_rows
    out = common.select("lang", F.array("word").alias("words"), F.col("n").alias("f"))
    if not blocks:
        return out, totals
    known = vocabulary[0]
    for v in vocabulary[1:]:
        known = known.unionByName(v)
    names = checked(known.select("id", "lang", "word"))
    texts = numbered(docs, vocabulary)
    occurrences, found = common.agg(F.sum("n")).first()[0], []
    for k in range(2, longest + 1):
        found = frequent(texts, candidates(texts, found, k, support, occurrences, bits), k, support, many, most_candidates)
        if not found:
            break
        for part in found:
            d = part
            for j in range(1, k + 1):
                # The first word tells the language, as numbers differ between languages.
                d = d.join(names.select(F.col("id").alias(f"w{j}"), F.col("word").alias(f"s{j}"), *(["lang"] if j == 1 else [])), f"w{j}")
            out = out.unionByName(d.select("lang", F.array(*[f"s{j}" for j in range(1, k + 1)]).alias("words"), F.col("n").alias("f")))
        if k < longest:
            occurrences = sum(part.agg(F.sum("n")).first()[0] for part in found)
            texts = advanced(texts, found, k, many)
    return out, totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, **bounds) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the frequent phrases of two words or more of (lang, text).

    score is floor(1000 a n / (l r)) of the cut in two with the least score (then the shortest first part), in
    decimals of 38 digits.  Phrases inside a longer frequent one that occurs as often are dropped.
    """
    found, totals = frequent_phrases(docs, support, longest, **bounds)
    text = lambda c: F.array_join(c, " ")
    found = materialize(found.select("lang", text("words").alias("phrase"), "words", "f"), "frequent")
    phrases = found.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    f = checked(found.select("lang", F.col("phrase").alias("part"), "f"))
    k, cut = F.size("words"), F.col("cut")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", text(F.slice("words", F.lit(1), cut)).alias("first"), text(F.slice("words", cut + 1, k - cut)).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(checked(totals), "lang")
    big = lambda c: c.cast("decimal(19,0)")
    above, below = (big(F.col("a")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * big(F.col("n")), big(F.col("l")) * big(F.col("r"))
    cuts = cuts.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    # A phrase of k words that occurs as often within a longer one does so within one of k + 1 words, which then is frequent.
    inner = phrases.where(k > 2).select("lang", F.explode(F.array(F.slice("words", F.lit(1), k - 1), F.slice("words", F.lit(2), k - 1))).alias("part"), "a")
    longer = inner.groupBy("lang", text("part").alias("phrase")).agg(F.max("a").alias("longer"))
    alone = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return alone.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 collocations with the highest score in each language of ``documents``.

    Null and empty texts have no words; documents without a language are ``und``.  Equal scores go by a, then
    by the phrase.  Repeated rows count each; languages without a phrase of 100 occurrences, and an
    empty table, give no rows.  Extra columns are not read.
    """
    with scratch():
        out = materialize(collocations(table(spark, sf_dir, "documents").select("lang", "text")), "collocations", keep=True)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = {
    "op12_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
pieces AS (
  SELECT doc, lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, len(g) AS k, array_to_string(g, ' ') AS phrase FROM (
  SELECT lang, unnest([w[i:i + k] FOR k IN range(0, 5) IF i + k <= len(w)]) AS g FROM spots)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, j, l.f AS l, r.f AS r, n.n,
         (1000::HUGEINT * a::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.first
  JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rest JOIN n ON n.lang = cuts.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
  SELECT lang, a, k, array_to_string(w[s:s + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
longer AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY 1, 2),
ranked AS (
  SELECT low.lang, low.phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
}
