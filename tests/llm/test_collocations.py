"""Collocations against brute force over all phrases; the query's SQL is tested with the others."""

import collections
import random
import re

import numpy as np
import pytest

from millrace.llm import collocations

SMALL = "/root/testdata/sf0.001"


def brute(rows, support, longest=5):
    """Rows (lang, phrase, a, l, r, n, score) of all collocations, from all phrases of all texts."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    inside = collections.defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in candidates.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if inside[lang, w] < a:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(3, 9))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("ABab c,\t.!\n") for _ in range(20)) for _ in range(6)]
        texts.append((rng.choice(["en", "de", None]), rng.choice([" ", "; ", "\n", "\x0b"]).join(parts)))
    return texts + [("en", None), (None, ""), ("xx", " \t "), ("xx", "Ää 日本 \U0001f600 " * 9), ("xx", "-".join("q" for _ in range(400)) + " z " * 40)]


def found(spark, rows, support, **bounds):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(map(tuple, collocations.collocations(df, support, **bounds).collect()))


@pytest.mark.parametrize("seed, bounds", [(1, {}), (2, {"words": 20, "most_candidates": 150}), (3, {"bits": 9})])
def test_collocations_equal_brute_force(spark, seed, bounds):
    """Also in many blocks of words and candidates, and with few buckets in turns."""
    rows = made(seed)
    want = brute(rows, 6)
    assert found(spark, rows, 6, **bounds) == want and max(len(r[1].split()) for r in want) == 5


def test_documents_equal_brute_force(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(rows, 12)
    assert found(spark, rows, 12) == want and len(want) > 50


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2**63 in between; the floor is exact."""
    a, n, l, r = 4_000_000_007, 9_000_000_011, 4_000_000_009, 4_000_000_021
    d = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    big = "CAST({} AS DECIMAL(19,0))"
    got = d.selectExpr(f"({big.format('1000 * a')} * {big.format('n')}) div ({big.format('l')} * {big.format('r')}) AS s").first()["s"]
    assert got == 1000 * a * n // (l * r)


@pytest.mark.parametrize("most, k, n", [(5, 2, 20), (300, 3, 3000), (70_000, 2, 5000), (70_000, 5, 200)])
def test_trie_accepts_its_phrases_alone(most, k, n):
    rng = np.random.default_rng(most + k)
    phrases = np.unique(rng.integers(1, most + 1, (n, k)) if most > 5 else rng.integers(1, most + 1, (n, k)), axis=0)
    phrases[: len(phrases) // 3, 0] = 1  # a node with many children
    phrases = np.unique(phrases, axis=0)
    rng.shuffle(phrases)
    trie = collocations.Trie(phrases, most)
    ids = np.concatenate([rng.integers(0, most + 1, 5000), phrases.ravel(), rng.integers(1, most + 1, 50)]).astype(np.int32)
    at, row = trie.walk(ids, np.arange(len(ids) - k + 1))
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    want = {(i, known[tuple(ids[i : i + k].tolist())]) for i in range(len(ids) - k + 1) if tuple(ids[i : i + k].tolist()) in known}
    assert set(zip(at.tolist(), row.tolist(), strict=True)) == want and len(want) >= len(phrases)


def test_rows_of_numbers_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(collocations, "ROW", 5)
    ids = np.array([1, 2, 0, 3, 4, 5, 6, 7, 8, 0, 9, 1, 0, 2, 2, 0])
    rows = collocations.cut_rows(ids).column(0).to_pylist()
    assert sum(rows, []) == ids.tolist() and all(r[-1] == 0 for r in rows) and len(rows) == 2


def test_tasks_of_many_words(spark):
    """One batch of more words than a task works on at a time: no stretch is lost between the levels."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    passages = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(40)]
    rows = [("en", ", ".join(rng.choice(passages) for _ in range(40))) for _ in range(2600)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = brute(rows, 100)
    assert sum(len(t.split()) for _, t in rows) > 2 * collocations.PLACES and max(len(r[1].split()) for r in want) == 5
    assert sorted(map(tuple, collocations.collocations(df).collect())) == want
