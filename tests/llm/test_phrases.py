"""Repeated word windows against brute force over all windows."""

import collections
import hashlib
import random

import pytest

from millrace.llm import phrases

SMALL = "/root/testdata/sf0.001"


def brute(rows, length):
    """(key, words, kept) of every row."""
    texts = [(key, (text or "").encode().split()) for key, text in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for _, w in texts for i in range(len(w) - length + 1))
    out = []
    for key, w in texts:
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                hit[i : i + length] = [True] * length
        out.append((key, len(w), b" ".join(x for x, h in zip(w, hit, strict=True) if not h)))
    return out


def found(spark, rows, *args):
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    return [(r["key"], r["n_words"], bytes(r["kept"])) for r in phrases.cleaned(df, *args).collect()]


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = sorted((k, n, n - len(kept.split()), hashlib.sha256(kept).hexdigest()) for k, n, kept in brute(rows, 35))
    got = sorted(map(tuple, phrases.op11_phrases(spark, SMALL).collect()))
    assert got == want and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("block, shard, symbols, bucket", [(1 << 18, 2_000_000, 1 << 20, 1 << 19), (64, 50, 1 << 20, 200), (1 << 18, 2_000_000, 1, 1)])
def test_short_windows_small_blocks_and_shards(spark, monkeypatch, block, shard, symbols, bucket):
    """Few words, so that windows overlap, repeat within a text, and share anchors in many contexts."""
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "SYMBOLS", symbols)
    rng = random.Random(block + shard)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        while len(w) < 60:
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))]
        rows.append((i, "  ".join(w)))
    rows += [(100, "a " * 300), (101, "a b " * 90), (None, None), (102, ""), (103, "x y"), (103, "x y")]
    assert sorted(found(spark, rows, 9, 3, bucket), key=repr) == sorted(brute(rows, 9), key=repr)


def test_words_are_told_apart_as_they_are(spark):
    """Case, all white space but the six ASCII kinds, and symbols beyond the surrogates count."""
    base = [f"w{i}" for i in range(40)]
    other = [*base[:20], "W20", *base[21:]]
    rows = [(1, " ".join(base)), (2, "\n".join(other)), (3, " ".join(base)), (4, "\t".join(base[3:39]))]
    assert sorted(found(spark, rows)) == sorted(brute(rows, 35))


def test_anchor_with_many_contexts(spark):
    """One common passage in a hundred settings, each different around it, and copies of one of them."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(50)]
    rows = [(i, " ".join([f"a{rng.random()}" for _ in range(30)] + common + [f"b{rng.random()}" for _ in range(30)])) for i in range(100)]
    rows += [(200 + i, rows[5][1]) for i in range(20)]
    got = found(spark, rows)
    assert sorted(got) == sorted(brute(rows, 35))
    assert {len(k.split()) for i, _, k in got if i < 100 and i != 5} == {60}


def test_many_symbols_in_one_bucket():
    words = [f"w{i}".encode() for i in range(70_000)]
    hit = phrases.located([(b" ".join(words), [(60_000, 40)])], [words, words[60_010:], []])
    assert hit[0].nonzero()[0].tolist() == list(range(60_000, 60_040)) and not hit[1].any() and not len(hit[2])


def test_a_phrase_goes_to_a_bucket_once(spark):
    """Texts of one bucket that repeat a passage ask for it once."""
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(i, text) for i in range(50)], "key long, text string").coalesce(1)
    packed = phrases.pack(df)
    got = phrases.recurring(packed).collect()
    assert len(got) == len({r["text"] for r in got}) and {r["bucket"] for r in got} == {0}
