"""Removal of repeated word passages by automata of the phrases that recur.

1. Windows of ``length`` words share an anchor that their own words determine (the run of ``gram``
   words of least hash).  Tasks count anchors and their contexts, the words of all windows of an
   anchor, once for each bucket of texts; nothing is emitted for each window.
2. A context that occurs twice is a recurring phrase.  Where one anchor has several contexts, the
   windows in them are counted, and those that occur twice are recurring phrases as well.  The words of each
   phrase are cut from one text that has it, neighbours as one passage.
3. Every bucket of texts gets the passages that its own anchors ask for, compiles their phrases
   into Aho-Corasick automata over words, and streams all its texts through them: every
   place where the words of a recurring phrase stand is found by the words themselves.  An automaton
   holds the first words of a phrase, and the others are compared in place.

So a phrase goes to a bucket once, however often it occurs there, and no text meets automata of phrases that it
cannot hold.  What recurs is counted under keys of 128 bits; what is removed has equal words.
"""

from __future__ import annotations

from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, only, per_batch, random64, scratch, slices, table, word_hashes

LENGTH, GRAM = 35, 6
#: Bytes of the texts of a bucket; a longer text is a bucket of its own.
BUCKET = 1 << 19
#: Bytes of texts, and words of a text, that are hashed at a time.
CHUNK, BLOCK = 1 << 20, 1 << 18
#: Words of a passage, but for what its last phrase adds.
PASSAGE = 256
#: Words of a phrase that an automaton holds, and phrases of one automaton.
HEAD, SHARD = 12, 50_000
#: Words that can be told apart as characters; with more, an automaton reads sequences of numbers.
SYMBOLS = 0x10FFFF - 0x800
#: A row's number is its bucket's, and its place there in so many bits.
ROW_BITS = 20

_GRAM = random64(64, 71) | np.uint64(1)
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)


def _powers(base: int, n: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number modulo 2**64, and of its inverse, n or more."""
    if base not in kept or len(kept[base][0]) < n:
        up = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))])
        kept[base] = up(base), up(pow(base, -1, 2**64))
    return kept[base]


def pack(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(row, key, packed) of ``docs`` (key, text): texts compressed, rows numbered by buckets."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        at, index, size = TaskContext.get().partitionId() << 22, 0, 0
        for b in batches:
            text = b.column(1).cast(pa.large_binary())
            rows, out, lo, held = [], [], 0, 0
            for i in range(b.num_rows):
                data = text[i].as_py() or b""
                if index and (size + len(data) > bucket or index + 1 >> ROW_BITS):
                    at, index, size = at + 1, 0, 0
                rows.append(at << ROW_BITS | index)
                out.append(z.compress(data))
                index, size, held = index + 1, size + len(data), held + len(data)
                if held > 4 << 20 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0).slice(lo, i + 1 - lo), pa.array(out, pa.binary())], ["row", "key", "packed"])
                    rows, out, lo, held = [], [], i + 1, 0

    docs = docs.select("key", F.coalesce("text", F.lit("")).alias("text"))
    schema = docs.select(F.lit(0).cast("long").alias("row"), "key").schema.add("packed", "binary")
    return docs.mapInArrow(run, schema)


def anchored(h: np.ndarray, text: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """[anchor, context, first, last] of word hashes: for each anchor its windows, by their first
    word, and the hash of all their words.  text tells the words of different texts apart."""
    out = []
    width = length - gram + 1
    for lo in range(0, max(len(h) - length + 1, 0), BLOCK):
        hi = min(len(h) - length + 1, lo + BLOCK)
        words = h[lo : hi + length - 1]
        start = np.flatnonzero(text[lo:hi] == text[lo + length - 1 : hi + length - 1])
        if not len(start):
            continue
        n = len(words) - gram + 1
        g = np.zeros(n, np.uint64)
        for j in range(gram):
            g += words[j : j + n] * _GRAM[j]
        g = mix64(g)
        # High bits are the hash's, low bits tell the last of equals.
        low = np.uint64((1 << ROW_BITS) - 1)
        best, size = (g & ~low) | (low - np.arange(n, dtype=np.uint64)), 1
        while size * 2 <= width:
            best, size = np.minimum(best[:-size], best[size:]), size * 2
        best = np.minimum(best[: hi - lo], best[width - size :][: hi - lo])
        at = (low - (best[start] & low)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        first, last, at = start[new], start[np.append(new[1:] - 1, len(start) - 1)], at[new]
        power, inverse = _powers(_BASES[0], BLOCK + length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])])
        ctx = (sums[last + length] - sums[first]) * inverse[first]
        ctx = mix64(ctx + (at - first).astype(np.uint64) * _GRAM[62] + (last - first).astype(np.uint64) * _GRAM[63])
        out.append((g[at].view(np.int64), ctx.view(np.int64), first + lo, last + lo))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def window_keys(h: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of word hashes."""
    out = []
    for k, base in enumerate(_BASES):
        power, inverse = _powers(base, len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ np.uint64(k)) * power[: len(h)])])
        out.append(mix64((sums[starts + length] - sums[starts]) * inverse[starts]).view(np.int64))
    return out[0], out[1]


def contexts(packed: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, first, last, anchor, ctx, n): contexts, once for each chunk of a bucket's texts, with a place of theirs."""

    def summed(rows: list, texts: list):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        h, text, _, _ = word_hashes(data, offsets, fold=False)
        anchor, ctx, first, last = anchored(h, text, length, gram)
        row, own = np.array(rows)[text[first]], np.searchsorted(text, text[first])
        first, last, bucket = first - own, last - own, row >> ROW_BITS
        order = np.lexsort((row, ctx, anchor, bucket))
        same = [x[order] for x in (bucket, anchor, ctx)]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0)
        at = order[new]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        cols = [row[at], first[at].astype(np.int32), last[at].astype(np.int32), anchor[at], ctx[at], n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "first", "last", "anchor", "ctx", "n"])

    def run(batches):
        un = zstandard.ZstdDecompressor()
        rows, texts, size = [], [], 0
        for b in batches:
            for row, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = un.decompress(p.as_py())
                if texts and size + len(data) > CHUNK:
                    yield summed(rows, texts)
                    rows, texts, size = [], [], 0
                rows.append(row)
                texts.append(data)
                size += len(data)
        if texts:
            yield summed(rows, texts)

    return packed.select("row", "packed").mapInArrow(run, "row long, first int, last int, anchor long, ctx long, n int")


_ASK = "anchor long, ctx long, n long, open boolean, first int, last int"


def passages(asked: DataFrame, length: int) -> DataFrame:
    """(pid, bucket, text, cuts) of (row, packed, asks): the words of the asked contexts of a row, neighbours
    as one passage, and the contexts' windows in it."""

    def run(batches):
        un = zstandard.ZstdDecompressor()
        pid = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[], [], [], []]
            size = 0
            for i in range(b.num_rows):
                words = un.decompress(b.column(1)[i].as_py()).split()
                group: list[dict] = []
                asks = sorted(b.column(2)[i].as_py(), key=lambda a: a["first"])
                for a in [*asks, None]:
                    if group and (a is None or a["first"] > group[-1]["last"] + length or a["last"] + length > group[0]["first"] + PASSAGE):
                        start = group[0]["first"]
                        text = b" ".join(words[start : group[-1]["last"] + length])
                        cuts = [c | {"first": c["first"] - start, "last": c["last"] - start} for c in group]
                        for c, x in zip(out, (pid, b.column(0)[i].as_py() >> ROW_BITS, text, cuts), strict=True):
                            c.append(x)
                        pid, size, group = pid + 1, size + len(text), []
                    if a is not None:
                        group.append(a)
                if size > 4 << 20 or i + 1 == b.num_rows:
                    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], kind)], ["pid", "bucket", "text", "cuts"])
                    out, size = [[], [], [], []], 0

    return asked.mapInArrow(run, f"pid long, bucket long, text binary, cuts array<struct<{_ASK.replace(' ', ': ')}>>".replace(",: ", ", "))


def windows(found: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n, bucket, pid, at): windows of those contexts of passages whose anchor has several."""

    def run(whole: pa.RecordBatch):
        for lo, hi, data, offsets in slices(whole.column(2), CHUNK // 4):
            yield keyed(whole.slice(lo, hi - lo), data, offsets)

    def keyed(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        h, text, _, _ = word_hashes(data, offsets, fold=False)
        cuts = b.column(3)
        flat = cuts.flatten()
        of = np.repeat(np.arange(b.num_rows), np.diff(cuts.offsets.to_numpy()))
        use = flat.field("open").to_numpy(zero_copy_only=False)
        of, first, last, n = (x[use] for x in (of, *(flat.field(c).to_numpy() for c in ("first", "last", "n"))))
        begin = np.searchsorted(text, of)
        counts = last - first + 1
        which = np.repeat(np.arange(len(of)), counts)
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]
        keys = window_keys(h, begin[which] + at, length)
        pick = lambda c: pa.array(b.column(c).to_numpy()[of[which]])
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(n[which]), pick(1), pick(0), pa.array(at.astype(np.int32))], ["k1", "k2", "n", "bucket", "pid", "at"])

    return per_batch(found.where(F.exists("cuts", lambda c: c["open"])), run, "k1 long, k2 long, n long, bucket long, pid long, at int")


def recurring(packed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(bucket, text, cuts): passages for each bucket of texts (row, packed), and in them the recurring
    phrases (first, n words) that some text of the bucket may hold."""
    gram = min(gram, length)
    every = materialize(contexts(packed, length, gram), "contexts")
    # Counts are written before they are joined: the join then is a plain one, whose hot keys the engine splits.
    again = materialize(every.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"), "again")
    met = materialize(every.join(again, "anchor", "left_semi"), "met")
    ctx = materialize(met.groupBy("anchor", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("row", "first", "last")).alias("at")), "distinct")
    several = materialize(ctx.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("open")), "several")
    wanted = ctx.join(several, "anchor", "left").withColumn("open", F.coalesce("open", F.lit(False))).where("n > 1 OR open")
    wanted = materialize(wanted.select("anchor", "ctx", "n", "open", "at.*"), "wanted")
    asks = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "ctx", "n", "open", "first", "last")).alias("asks"))  # at most as long as the row's text
    asked = only(packed.select("row", "packed"), wanted.select("row").distinct(), "row").join(asks, "row").select("row", "packed", "asks")
    found = materialize(passages(asked, length), "passages")

    each = found.select("pid", F.explode("cuts").alias("c")).where("c.n > 1")
    full = materialize(each.select("c.anchor", "c.ctx", "pid"), "full")
    by_context = met.join(full, ["anchor", "ctx"]).select(F.shiftright("row", ROW_BITS).alias("bucket"), "pid")
    near = materialize(windows(found, length), "windows")
    twice = near.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min(F.struct("pid", "at")).alias("rep")).where("n > 1")
    twice = materialize(twice.select("k1", "k2", F.col("rep.pid").alias("rep"), F.col("rep.at").alias("at")), "twice")
    # A context with a second occurrence is a phrase as a whole: its windows need not ask.
    by_window = near.where("n = 1").select("k1", "k2", "bucket").join(twice, ["k1", "k2"]).select("bucket", F.col("rep").alias("pid"))
    wants = materialize(by_context.unionByName(by_window).distinct(), "wants")
    single = twice.groupBy(F.col("rep").alias("pid")).agg(F.collect_set("at").alias("ats"))  # at most as long as the passage
    whole = F.transform(F.filter("cuts", lambda c: c["n"] > 1), lambda c: F.struct(c["first"].alias("first"), (c["last"] - c["first"] + length).alias("n")))
    alone = F.transform(F.coalesce("ats", F.array().cast("array<int>")), lambda a: F.struct(a.alias("first"), F.lit(length).alias("n")))
    ready = materialize(found.join(single, "pid", "left").select("pid", "text", F.concat(whole, alone).alias("cuts")).where(F.size("cuts") > 0), "ready")
    return wants.join(ready, "pid").select("bucket", "text", "cuts")


def located(phrases: list[tuple[bytes, list[tuple[int, int]]]], texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text (a list of words) which words stand in an occurrence of a phrase; phrases are runs
    (first, n words) of passages.

    An automaton holds the first ``HEAD`` words of its phrases; where it finds them, the longest phrase whose other
    words follow is marked.  It takes ``SHARD`` heads, and all texts run through each."""
    marks = [np.zeros(len(t) + 1, np.int64) for t in texts]

    class Numbers(dict):
        def __missing__(self, _):
            return 0  # a word of no phrase

    held = [text.split() for text, _ in phrases]
    number = Numbers((w, i) for i, w in enumerate(dict.fromkeys(chain.from_iterable(held)), 1))
    as_text = len(number) < SYMBOLS

    def symbols(words: list[bytes]):
        if not as_text:
            return tuple(map(number.__getitem__, words))
        x = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
        x[x >= 0xD800] += 0x800  # no character has a surrogate's number
        return x.astype("<u4", copy=False).tobytes().decode("utf-32-le")

    heads: dict = {}
    for words, (_, cuts) in zip(held, phrases, strict=True):
        passage = symbols(words)
        for first, n in cuts:
            heads.setdefault(passage[first : first + min(n, HEAD)], set()).add(passage[first : first + n])
    read = [symbols(t) for t in texts]
    every = [(head, sorted(own, key=len, reverse=True)) for head, own in heads.items()]
    for at in range(0, len(every), SHARD):
        some = every[at : at + SHARD]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING if as_text else ahocorasick.KEY_SEQUENCE)
        for i, (head, _) in enumerate(some):
            automaton.add_word(head, i)
        automaton.make_automaton()
        for mark, text in zip(marks, read, strict=True):
            for end, i in automaton.iter(text) if len(text) else ():
                head, own = some[i]
                start = end + 1 - len(head)
                for phrase in own:
                    stop = start + len(phrase)
                    if text.startswith(phrase, start) if as_text else text[start:stop] == phrase:
                        mark[start] += 1
                        mark[stop] -= 1
                        break
    return [np.cumsum(m[:-1]) > 0 for m in marks]


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(key, n_words, kept binary, spans array<struct<start,end>>) of ``docs`` (key, text): the words of every text
    without those that a repeated window of ``length`` words covers, joined by one space, and the removed
    runs (words, end exclusive).

    Null texts are empty.  Every row is a text of its own, whatever its key: equal rows of
    ``length`` words or more remove each other.
    """
    packed = materialize(pack(docs, bucket), "packed")
    with scratch():
        found = materialize(recurring(packed, length, gram), "phrases", keep=True)
    key = packed.schema["key"]
    mine = packed.select(F.shiftright("row", ROW_BITS).alias("bucket"), F.lit(1).alias("is_text"), "key", F.col("packed").alias("data"), F.lit(None).cast(found.schema["cuts"].dataType).alias("cuts"))
    theirs = found.select("bucket", F.lit(0).alias("is_text"), F.lit(None).cast(key.dataType).alias("key"), F.col("text").alias("data"), "cuts")
    # A bucket is BUCKET bytes of text or a single text, and passages that its words ask for.
    todo = mine.unionByName(theirs).repartition("bucket").sortWithinPartitions("bucket", "is_text")

    def done(keys: list, phrases: list, texts: list):
        hit = located(phrases, texts)
        kept, spans = [], []
        for t, h in zip(texts, hit, strict=True):
            kept.append(b" ".join(compress(t, (~h).tolist())) if h.any() else b" ".join(t))
            edges = np.flatnonzero(np.diff(h.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
            spans.append([{"start": a, "end": b} for a, b in edges])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["key", "n_words", "kept", "spans"])

    def run(batches):
        un = zstandard.ZstdDecompressor()
        now, keys, phrases, texts = None, [], [], []
        for b in batches:
            for i, (bucket, is_text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if bucket != now:
                    if texts:
                        yield done(keys, phrases, texts)
                    now, keys, phrases, texts = bucket, [], [], []
                data = b.column(3)[i].as_py()
                if is_text:
                    keys.append(b.column(2).slice(i, 1))
                    texts.append(un.decompress(data).split())
                else:
                    phrases.append((data, [(c["first"], c["n"]) for c in b.column(4)[i].as_py()]))
        if texts:
            yield done(keys, phrases, texts)

    schema = packed.select("key", F.lit(0).cast("long").alias("n_words"), F.col("packed").alias("kept"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")).schema
    return todo.mapInArrow(run, schema)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document's words without windows of 35 words that start twice.

    Null and empty texts have no words; texts of fewer than 35 words lose none.  Rows that repeat, with or without
    a doc_id, are texts of their own and remove each other; an empty table gives no rows.  Extra
    columns are not read.
    """
    out = cleaned(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("key").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op11_phrases": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT r, i FROM win JOIN twice USING (g)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
m AS (SELECT words.r, p, word, max(starts.i) OVER (PARTITION BY words.r ORDER BY p) AS s FROM words LEFT JOIN starts ON starts.r = words.r AND starts.i = p),
k AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE p - s < 35) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (WHERE s IS NULL OR p - s >= 35) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
}
