"""Queries against SQL or brute force over the whole sf0.001 or sf0.01 tables, and awkward input."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import bpe, common, entry, mixing, neardup, pii, quality, repeats, sharding, tokenfiles, topk, toxicity
from oracle import SF, assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def documents(spark, sf=SMALL):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(entry.QUERIES[name](spark, SF), entry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_awkward_and_empty_tables(spark, odd, empty, stored, tmp_path, name):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(0, [0.5, 1.0]), (50, [0.5, None]), (100, None), (3, [float("nan"), 1.0]), (4, []), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = entry.QUERIES[name](spark, stored(documents=odd, labels=labels, embeddings=vectors)).collect()
    if name == "op13_whitening":  # three vectors of two dimensions, of them two equal, and the one vector of one
        assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == sorted([(0, k, 4) for k in (1, 2)] * 2 + [(5, k, 4) for k in (1, 2)] * 2 + [(6, 1, 1)])
    elif name == "op12_collocations":  # no phrase occurs a hundred times but in the long text
        assert {r["lang"] for r in got} <= {"en"}
    elif name != "op3_top_k":
        assert len(got) == odd.count()
    else:
        assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, k, 5, 128 * 256 + 256 * 256) for k in (1, 2)]
    for t, df in (("documents", empty), ("labels", labels.limit(0)), ("embeddings", vectors.limit(0))):
        df.write.mode("overwrite").parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert entry.QUERIES[name](spark, str(tmp_path / "none")).count() == 0


def brute_components(rows, width):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    shared = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            shared[g].append(d)
    both = collections.Counter(p for ds in shared.values() for p in itertools.combinations(sorted(ds), 2))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("rounds, part", [(0, 512), (3, 512), (0, 2), (3, 2)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, part):
    """With and without rounds of leaders; with buckets of one part and of many."""
    monkeypatch.setattr(neardup, "PART", part)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, rounds=rounds).collect()}
    assert got == brute_components(documents(spark, SF), 4)


def test_chain_is_one_component(spark):
    """Links reach further than the threshold: ends of a chain differ, but share a component."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(30):
        w = list(base)
        w[3 * k : 3 * k + 3] = [f"x{k}a", f"x{k}b", f"x{k}c"]
        base = w
        rows.append((100 - k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows, 4) and {c for _, c in got.values()} == {71}


def test_rows_that_repeat_or_lack_a_doc_id(spark, stored):
    """Copies go by row: without a doc_id, with an equal one, and with one that stands on two texts."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [
        (1, text("a"), "x"), (None, text("a"), "x"), (1, text("a"), "x"), (1, text("a"), "w"),
        (7, text("a"), "x"), (7, text("b"), "x"), (8, text("b") + " more", "x"),
        (None, text("c"), "x"), (None, text("c") + " more", "x"), (None, text("d"), "x"), (None, None, "x"), (9, "", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = neardup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    key = lambda r: (r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0)
    assert sorted(map(key, found)) == sorted([(1, 57, 1)] * 3 + [(0, 57, 1), (7, 57, 1), (7, 57, 7), (8, 58, 7), (0, 57, 0), (0, 58, 0), (0, 57, 0), (0, 0, 0), (9, 0, 9)])
    kept = [key(r) for r in found if r["kept"]]
    assert len(kept) == 6 and {(1, 57, 1), (7, 57, 7), (0, 0, 0), (9, 0, 9)} <= set(kept)
    query = lambda *rows: sorted((tuple(r) for r in neardup.op2_near_duplicates(spark, stored(documents=spark.createDataFrame(rows, "doc_id long, text string"))).collect()), key=repr)
    a, b = text("a"), text("b")
    got = query((1, a), (1, a), (2, a + " z"), (3, b), (3, b), (None, None), (4, "x"))
    # kept by doc_id, as the query's rule has it; row_kept tells the one row of each component.
    assert [r[:4] for r in got] == sorted([(1, 57, 1, True)] * 2 + [(2, 58, 1, False)] + [(3, 57, 3, True)] * 2 + [(None, 0, None, True), (4, 1, 4, True)], key=repr)
    assert sum(r[4] for r in got) == 4
    left = sorted(((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()), key=repr)
    c = [r for r in left if r[1] and r[1].startswith("c")]
    assert len(c) == 1 and sorted([r for r in left if r not in c], key=repr) == sorted([(1, text("a"), "w"), (7, text("b"), "x"), rows[9], rows[10], rows[11]], key=repr)


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    for share, samples, bits, margin in itertools.product((0.95, 0.9), (neardup.SAMPLES, neardup.FINE_SAMPLES), (0,), (0,)):
        bits, margin = (neardup.SKETCH_BITS, neardup.MARGIN) if samples == neardup.SAMPLES else (neardup.FINE_BITS, neardup.FINE_MARGIN)
        miss = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
            n = int(2000 * share)
            y = np.concatenate([x[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.int64).astype(np.uint64)])
            a, b = (neardup.odd_sketch(neardup.minhash(s, samples), bits) for s in (np.unique(x), np.unique(y)))
            odd = sum(int(v).bit_count() for v in a ^ b)
            est = 1 + bits / (4 * samples) * np.log(1 - 2 * odd / bits)
            miss.append(est - n / (4000 - n))
        assert abs(np.mean(miss)) < 0.02 and np.max(np.abs(miss)) < 0.8 * margin


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), int(cover.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark):
    got = sorted(map(tuple, repeats.op4_repeats(spark, SMALL).collect()), key=repr)
    assert got == brute_repeats(documents(spark), 200)


@pytest.mark.parametrize("most", [2, 20_000])
@pytest.mark.parametrize("block", [64, 1 << 19])
def test_short_repeats_and_blocks(spark, monkeypatch, most, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = [(i, t[:1500]) for i, t in documents(spark)[:60]] + [(900, "ab" * 150), (901, "z" * 200), (902, None), (903, "xabababababababababababababababababababababy")]
    df = spark.createDataFrame(rows, "key long, text string")
    got = []
    for r in repeats.cleaned(df, 40, most).collect():
        got.append((r["key"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    assert sorted(got, key=repr) == brute_repeats(rows, 40)


@pytest.mark.parametrize("line", ["this very line stands in every one of these texts", "a passage of many words, none of them twice: " + " ".join(f"{i * i:x}" for i in range(20, 70))])
def test_hot_anchor_is_split(spark, line):
    """One line or a passage of several windows in all texts, with neighbours that differ or agree by groups: every width gives the same."""
    rows = [(i, f"{'left' * (i % 3)} {i % 7} {i // 7} {line} {i % 5} {'right' * (i % 4)} {i // 5} and more of it to the end {i % 2}") for i in range(150)]
    df = spark.createDataFrame(rows, "key long, text string")
    want = brute_repeats(rows, 60)
    for most in (3, 20, 20_000):
        got = [(r["key"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.cleaned(df, 60, most).collect()]
        assert sorted(got, key=repr) == want


def test_maximal_repeat_groups_hold_all_occurrences():
    before = [b"cba", b"cbx", b"czz", b"qqq"]
    after = [b"GRAM12345", b"GRAM12399", b"GRAM1z", b"GRAM12377"]
    got = {(left, right, tuple(sorted(rows))) for left, right, rows in repeats.repeat_groups(before, after, 4, 5)}
    assert got == {(0, 5, (0, 1, 2, 3)), (1, 5, (0, 1, 2)), (2, 5, (0, 1)), (0, 7, (0, 1, 3)), (2, 7, (0, 1))}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encoder_equals_the_tokenizer(spark, odd, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = bpe.encoded(docs.withColumn("ids", docs["doc_id"])).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want


ODD_TEXTS = ["", "  ", "a<|endoftext|>b c", "<|ENDOFTEXT|>\u00e9 x", "H\u0331ello \u00e9 \u0301x", "a \u0301 e\u0301. \u0301.", "don't  WE'LL it's 'sabc x'y.", "\u0130stanbul \u03a3\u0391\u03a3. \u03a9, \u00e4, \u00c9. \u00c0\u00c9.", "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8\u3002\u3053\u308c\u306f, test. \uc548\ub155 \u1112\u1161\u11ab", "a\x00b\x1fc\x85d e.\x85f", "!!, a). b\". c'. d-, e. . , f", "\ufb01 \u00bd \u00b2 \u00b3. \u00aa. \u00ba, \u00b5.", "\u00df. \u1e9e, \u0149. \u01c6, \u01c5. \u00ff, \u0178.", "\u201cquoted\u201d \u2013 dash\u2026 \u20ac5 \U0001f600", "\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440. \u0391\u03b2\u03b3 \u05e9\u05dc\u05d5\u05dd \u0939\u093f\u0928\u094d\u0926\u0940.\u3000x\u2003y\u00a0z"]


def test_odd_texts_encode_exactly(tokenizer):
    import pyarrow as pa

    c = bpe.Codec(bpe.tokenizer_path())
    for text in ODD_TEXTS:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert [i for _, i in c.encode_batch(pa.array([text, None, text]))] == [want, b"", want], text


def test_units_are_bounded_and_still_exact(spark, tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "MAX_UNITS", 50)
    monkeypatch.setattr(bpe, "MAX_CHUNK_BYTES", 3000)
    c = bpe.Codec(bpe.tokenizer_path())
    texts = [t for _, t in documents(spark)[:50]]
    for row, ids in c.encode_batch(pa.array(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(texts[row], add_special_tokens=False).ids


def test_joins_are_repaired(spark, tokenizer, monkeypatch):
    """Cuts inside words: parts encode otherwise than the whole, joins give the whole's ids, also over many chunks."""
    import pyarrow as pa

    c = bpe.Codec(bpe.tokenizer_path())
    whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    text = "tokenization of internationalization, \u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8 and \u00e9t\u00e9."
    data, differ = text.encode(), 0
    for step in (1, 2, 3, 7, 11):
        cuts = list(range(step, len(data), step))
        assert np.frombuffer(c.encode(data, cuts), "<u4").tolist() == whole(text)
    for at in range(1, 30):
        differ += whole(text[:at]) + whole(text[at:]) != whole(text)
    assert differ > 10
    monkeypatch.setattr(bpe, "cut_points", lambda d: np.arange(3, len(d), 3))
    texts = [t for _, t in documents(spark)[:20]] + [t for t in ODD_TEXTS]
    for row, ids in bpe.Codec(bpe.tokenizer_path()).encode_batch(pa.array(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(texts[row])


def test_chunks_are_reused_across_documents(spark):
    import pyarrow as pa

    passage = " ".join(t for _, t in documents(spark)[:12])
    texts = [f"{'x' * k} own words {k} {passage} end {k}" for k in range(20)]
    c = bpe.Codec(bpe.tokenizer_path())
    for _ in c.encode_batch(pa.array(texts)):
        pass
    assert c.reused > 0.85 * c.seen


def test_tokenizers_that_do_not_fit_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Codec(bpe.tokenizer_path("byte_bpe_50k.json"))
    changes = {
        "split": lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(pattern={"String": " "}),
        "invert": lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(invert=False),
        "prefix": lambda t: t["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        "replace": lambda t: t["normalizer"]["normalizers"][1].update(content=""),
        "suffix": lambda t: t["model"].update(end_of_word_suffix=""),
        "dropout": lambda t: t["model"].update(dropout=0.5),
        "strip": lambda t: t["added_tokens"][0].update(lstrip=True),
        "decoder": lambda t: t.update(decoder={"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}),
    }
    for name, change in changes.items():
        with open(bpe.tokenizer_path(), encoding="utf-8") as f:
            parts = json.load(f)
        change(parts)
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(parts), encoding="utf-8")
        with pytest.raises(ValueError, match=name):
            bpe.Codec(str(path))


def test_no_text_leaves_the_chunks(tokenizer):
    """Typographic signs, other scripts, marks and special tokens: chunks are read, and reused, in all of them."""
    import pyarrow as pa

    words = [
        "I\u2019m sure", "\u201cX\u201d A\u2014B", "\u041f\u0440\u0438\u0432\u0435\u0442 \u041c\u0438\u0440.", "A\u65e5\u672c B\u8a9e", "H\u0331x Ho\u0331. a\u0301 E\u0301", "x<|endoftext|>Y <|EndOfText|>.",
        "H\u05b0\u0331 Q\u20dd\u0331 \u212a\u0331 I\u0307. H\u3000\u0331x",
    ]
    for word in words:
        text = " ".join(f"{word} plain words number {i * i}," for i in range(300))
        c = bpe.Codec(bpe.tokenizer_path())
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert [i for _, i in c.encode_batch(pa.array([text, text]))] == [want, want], word
        assert c.seen > 4 and 2 * c.reused >= c.seen, word


def test_chunks_are_cut_by_content():
    text = np.frombuffer(" ".join(f"w{i * i * 7919 % 10_007}" for i in range(4000)).encode(), np.uint8)
    a = bpe.cut_points(text, mean=128)
    b = bpe.cut_points(np.concatenate([np.frombuffer(b"shifted by this ", np.uint8), text]), mean=128)
    assert len(a) and set(a + 16) <= set(b)


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, tokenizer, encoding):
    import glob

    import pyarrow.parquet as pq

    path = common.new_path(spark, "test-tokens")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokenfiles.write_tokens(docs, path, encoding=encoding)
    rows = tokenfiles.read_tokens(spark, path, "ids").orderBy("doc_id").collect()
    start = 0
    for (d, t), r in zip(sorted(documents(spark)), rows, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d, start, len(ids), ids)
        start += len(ids)
    last = -1
    for f in sorted(glob.glob(path.removeprefix("file://") + "/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        if meta.num_rows:
            stats = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
            assert stats[0].min > last
            last = stats[-1].max
            column = meta.row_group(0).column(meta.num_columns - 1)
            assert column.has_column_index and column.has_offset_index
            assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


def test_no_row_with_ids_moves(spark, stored):
    path = common.new_path(spark, "test-tokens")
    tokenfiles.write_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan(tokenfiles.read_tokens(spark, path, "ids"))
    # Metadata alone, or a range of doc_ids, is pruned and pushed down to the scan.
    meta = tokenfiles.read_tokens(spark, path).where("doc_id between 40 and 60")
    assert "ids" not in plan(meta) and "GreaterThanOrEqual(doc_id,40)" in plan(meta)
    whole = {r["doc_id"]: r["start"] for r in tokenfiles.read_tokens(spark, path).collect()}
    assert {r["doc_id"]: r["start"] for r in meta.collect()} == {k: v for k, v in whole.items() if 40 <= k <= 60}


def test_token_file_digests(spark, odd, stored, tokenizer):
    got = tokenfiles.op6_token_files(spark, stored(documents=odd)).collect()
    from pyspark.sql import functions as F

    texts = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, (r["h"], r["text"])) for r in texts.collect()))
    start = 0
    rows = sorted(got, key=lambda r: r["start"])
    for (_, _, (_, text)), r in zip(want, rows, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_targets_and_apportionment():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([10, 1000], [5, 2]) == [20.0, 1495.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []
    rng = np.random.default_rng(2)
    for _ in range(50):
        v = rng.integers(1, 1000, rng.integers(1, 80)).tolist() + [20_000] * int(rng.integers(0, 2))
        seats = int(rng.integers(0, 200))
        won = [0] * len(v)
        for _ in range(seats):
            i = max(range(len(v)), key=lambda k: (v[k] / (2 * won[k] + 1), -k))
            won[i] += 1
        assert mixing.apportion(v, seats) == won
    assert mixing.apportion([5, 5], 10, caps=[2, 3]) == [2, 3]


def test_mix_meets_its_targets(spark):
    d = mixing.op7_mixing(spark, SF).toPandas()
    s = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").toPandas()
    d = d.merge(s, on="doc_id")
    assert (d["size"] == d.text.map(lambda t: len(WORD.findall(t)))).all() and (d.taken <= 2 * d["size"]).all()
    by = d.groupby("source").agg(size=("size", "sum"), seen=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    names = sorted(by.index)
    assert (by["size"] == by.seen).all() and (abs(by.taken - by.target) <= 0.01 * by.target + 2 * mixing.BLOCK_WORDS).all()
    want = mixing.targets([int(by["size"][n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert np.allclose([by.target[n] for n in names], want)
    again = mixing.op7_mixing(spark, SF).toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(d.doc_id, d.taken))


def test_mix_of_many_cells_equals_sql(spark):
    """Sources of several cells: the same SQL with the same cells."""
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    got = mixing.taken(mixing.quotas(docs, cell_rows=40)).select("doc_id", "size", "source_size", "target", "taken")
    assert_same(got, mixing.mixing_sql(cell_rows=40))
    # Groups of cells move a block or two between cells, never words between sources.
    two = mixing.taken(mixing.quotas(docs, cell_rows=40, groups=3)).groupBy("source").agg({"taken": "sum"}).collect()
    one = mixing.taken(mixing.quotas(docs, cell_rows=40)).groupBy("source").agg({"taken": "sum"}).collect()
    assert all(abs(dict(two)[k] - v) <= 16 * 40 for k, v in dict(one).items())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    assert con.sql(mixing.mixing_sql()).fetchall() == []


def test_mixed_rows_hold_the_taken_words(spark, odd):
    out = mixing.mixed(odd)
    taken = mixing.taken(mixing.quotas(odd)).toPandas()
    assert out.columns == odd.columns
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert words == taken.taken.sum()


def test_toxicity_on_held_out_labels(spark):
    d = toxicity.op8_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (d.held_out == d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    j = d.merge(labels[labels.toxic.notna()], on="doc_id")
    assert (j.predicted == j.toxic).mean() > 0.95 and d.score.between(0, 1).all()
    assert j[(j.toxic == 1)].predicted.mean() > 0.7


def test_field_marginals_equal_enumeration():
    m = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.3, np.array([0.2, -0.7]), np.array([[0.1, -0.9], [-0.4, 0.3]]))
    at, odds, n = np.array([1, 4]), np.array([1.5, -0.2]), 7
    total, on = 0.0, np.zeros(2)
    for tags in itertools.product((0, 1), repeat=n):
        s = m.start[tags[0]] + sum(m.trans[a, b] for a, b in zip(tags, tags[1:]))
        s += sum((dict(zip(at.tolist(), odds)).get(i, m.bias)) * y for i, y in enumerate(tags))
        w = np.exp(s)
        total += w
        on += w * np.array([tags[i] for i in at])
    assert np.allclose(toxicity.marginals(m, n, at, odds, {}), on / total)


def brute_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


TRICKY = ["a@b.c@d.e x@y z@w.q.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "+1 (017) 555-7713 4111 1111 1111 1111", "4111-1111-1111-1111 5", "a" * 400 + "@ex.com", "@@a@b.c", "+49 30 1234567+1 555 123 4567", "%+x@a-b.c--d é@ü.de 1@2.3"]


def test_base_spans_equal_the_patterns(spark):
    for text in [*TRICKY, *(t for _, t in documents(spark, SF))]:
        assert pii.base_spans(text) == brute_base(text), text[:80]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 3000 + "." * 100, "1" * 200_000, "@" * 100_000, "+" * 100_000, "1.1." * 50_000, "a.b-" * 50_000 + "@x"):
        pii.base_spans(text)


def test_personal_data(spark):
    rows = pii.op1_personal_data(spark, SF).collect()
    texts, added = dict(documents(spark, SF)), 0
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans) and len(spans) == r["n_spans"] == len(base) + r["n_added"]
        for k, a, b in (x.split(":") for x in set(spans) - {f"{k}:{a}:{b}" for k, a, b in base}):
            piece = texts[r["doc_id"]][int(a) : int(b)]
            added += bool(re.fullmatch(r"[0-9 -]{12,24}|[0-9a-fA-F]{32,64}", piece)) if k in ("card", "secret") else -1
    # Long numbers and tokens that no pattern finds.
    assert added >= 10


@pytest.fixture(scope="module")
def network(spark):
    texts = [t for _, t in documents(spark, SF) if re.search("[0-9@]", t) and len(t) <= pii.MAX_CHARS][: pii.MAX_DOCS]
    return pii.train(texts), texts


def test_network_finds_made_spans(network):
    """Precision and recall on spans made with another seed, which training never saw."""
    net, texts = network
    r = random.Random(99)
    made = [pii.made_text(r, texts, 60) for _ in range(150)]
    got = pii.added_spans(net, [t for t, _ in made], [[] for _ in made])
    right = sum(len(set(g) & set(w)) for g, (_, w) in zip(got, made, strict=True))
    assert right / sum(map(len, got)) > 0.96 and right / sum(len(w) for _, w in made) > 0.96


def test_network_adds_what_patterns_miss(network):
    net, _ = network
    added = lambda t: [(k, t[a:b]) for k, a, b in sorted(pii.added_spans(net, [t], [pii.base_spans(t)])[0], key=lambda s: s[1])]
    # The pattern takes two cards as one run of 32 digits and drops it; both pass Luhn.
    pair = ["7536784127813050", "4845168114407329"]
    assert all(map(pii.luhn, pair))
    assert added(f"de la banque de mentle \u00e7re. \u00c9\u00e7an {pair[0]} {pair[1]} \u00e8aique tre oile tionai \u00e9tre") == [("card", c) for c in pair]
    assert added("write to jo.doe [at] example.com about the rest of it") == [("email", "jo.doe [at] example.com")]
    assert added('then they set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and went on') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    wide = "".join(chr(0xFF10 + int(c)) for c in pair[0])
    assert added(f"the number was {wide} and no other") == [("card", wide)]
    assert added("a plain text of 12 words, version 3.4, written on 2020-01-02 at 10:30 by hand") == []


def test_windows_are_reconciled(network):
    """A span is found whole wherever the windows' edges fall on it."""
    net, _ = network
    for at in range(150, 280, 7):
        text = ("lorem ipsum dolor sit amet " * 20)[:at] + " 7536784127813051 " + "lorem ipsum dolor sit amet " * 20
        assert pii.added_spans(net, [text], [[]])[0] == [("card", at + 1, at + 17)]


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    k = pii.TAGS
    net = pii.Net(*(rng.normal(0, 0.3, s) for s in ((2, 6, 8), (2, 2, 8), (2, 2, k), (k,), (k, k))))
    x, y, mask = rng.integers(0, 6, (3, 7)), rng.integers(0, k, (3, 7)), np.ones((3, 7), bool)
    mask[1, 4:] = False

    def loss():
        s, kept = net.forward(x, keep=True)
        p, _, z = net.posterior(s.astype(float), mask)
        gold = sum(s[i, j, y[i, j]] for i in range(3) for j in range(7) if mask[i, j])
        gold += sum(net.a[y[i, j], y[i, j + 1]] for i in range(3) for j in range(6) if mask[i, j + 1])
        return z.sum() - gold, p, kept

    _, p, kept = loss()
    grads = net.backward(p - np.eye(k)[y] * mask[:, :, None], kept)
    for param, g in zip((net.e, net.w, net.u, net.b), grads):
        at = tuple(rng.integers(0, n) for n in param.shape)
        old = param[at]
        param[at] = old + 1e-3
        up = loss()[0]
        param[at] = old - 1e-3
        down = loss()[0]
        param[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-2
    # Reading gives the same scores, marginals and probability of any tag as training.
    s, _ = net.forward(x)
    fast = net.scores(x)
    assert np.allclose(fast.transpose(2, 0, 1), s, atol=1e-4)
    assert np.allclose(net.marginals(fast, mask)[mask], net.posterior(s.astype(float), mask)[0][mask], atol=1e-4)
    none = [sum(s[i, j, 0] for j in range(7) if mask[i, j]) + net.a[0, 0] * (mask[i].sum() - 1) for i in range(3)]
    assert np.allclose(net.chance(fast, mask), 1 - np.exp(none - net.posterior(s.astype(float), mask)[2]), atol=1e-3)


def test_redaction(spark, odd):
    net = pii.Net(*(np.zeros(s, np.float32) for s in ((2, pii.CLASSES, 48), (2, 12, 48), (2, 12, pii.TAGS), (pii.TAGS,), (pii.TAGS, pii.TAGS))))
    out = {r["text"] for r in pii.redacted(odd, net).where("doc_id is null").collect()}
    assert "Write to <EMAIL> or <PHONE> now please, it is urgent for us all" in out and None in out


def test_sharding_moves_rows_only_into_a_new_shard(spark):
    d = sharding.op10_sharding(spark, SF).toPandas()
    assert ((d.shard == d.grown_shard) | (d.grown_shard == 8)).all() and set(d.shard) == set(range(8))
    for _, g in d.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = dict(documents(spark, SF))
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 1 == n for i, c, n in zip(d.doc_id, d.text_crc32, d["size"]))


def test_shards_equal_the_highest_scores(spark):
    """Every shard and every grown shard, computed again from the MD5 of key and shard."""
    import math

    def best(key, n):
        u = lambda i: (int(hashlib.md5(f"{i}|={key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(n), key=lambda i: (-1 / math.log(u(i)), -i))

    for r in sharding.op10_sharding(spark, SF).collect():
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 8), best(r["doc_id"], 9))


def test_sharding_sql_on_awkward_rows(spark, odd, stored):
    import duckdb

    path = stored(documents=odd)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = [tuple(r[c] for c in names) for r in sharding.op10_sharding(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(con.sql(sharding.sharding_sql()).select(*names).fetchall(), key=repr)
    con.execute("CREATE TABLE none AS SELECT * FROM documents LIMIT 0")
    assert con.sql(sharding.sharding_sql("none")).fetchall() == []


def test_weighted_shards_and_groups(spark):
    d = sharding.assign(spark.range(20_000).withColumnRenamed("id", "k"), "k", [1.0, 3.0])
    n = {r["shard"]: r["count"] for r in d.groupBy("shard").count().collect()}
    assert 0.72 < n[1] / 20_000 < 0.78
    slots = sharding.numbered(d, "shard", ["k"], group_rows=500).groupBy("shard").agg({"slot": "max"}).collect()
    assert {r[0]: r[1] + 1 for r in slots} == n
    with pytest.raises(ValueError):
        sharding.assign(d, "k", [])


def brute_top_k(rows, every, top):
    """(query_id, rank, vec_id, score) of rows (vec_id, ints), each row a candidate of its own."""
    out = []
    for i, (q, a) in enumerate(rows):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), v) for j, (v, b) in enumerate(rows) if j != i and len(a) == len(b))[:top]
            out += [(q, k + 1, v, -s) for k, (s, v) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("case", ["passes", "repeats", "large", "few"])
def test_top_k_equals_brute_force(spark, case):
    rng = np.random.default_rng(4)
    high = 2**40 if case == "large" else 9
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(rng.integers(-high, high, (4 if case == "few" else 300, 2 if case == "large" else 7)))]
    if case == "large":  # beyond what float64 holds, within a long
        rows = [(i, [x % 2**31 - 2**30, y % 2**31 - 2**30]) for i, (x, y) in rows]
    if case == "repeats":  # rows with an equal id: copies, and other vectors; also of queries
        rows += [rows[10], rows[10], (20, rows[21][1]), (7, rows[8][1]), (7, [1] * 5), (30, [2] * 5)]
    df = common.materialize(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, vec_id long, v array<long>").repartition(3), "test-vectors")
    found = topk.top_k(df, df.where("vec_id % 10 = 0"), top=3, query_bytes=500 if case == "passes" else 1 << 20).collect()
    assert sorted(map(tuple, found)) == brute_top_k(rows, 10, 3)


def test_scores_beyond_a_long_are_errors(spark):
    big = np.array([[2**40, 2**40]])
    with pytest.raises(OverflowError):
        topk.product(big, big)
    assert topk.product(big, -big // 2**20).tolist() == [[-(2**61)]]
    with pytest.raises(Exception, match="beyond a long"):
        topk.quantized(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()


def test_repeated_rows_in_sql_and_query(spark, stored):
    rows = [(0, [0.5, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.25, 0.5]), (50, [0.1, 0.2]), (50, [0.1, 0.2])]
    path = stored(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    got = topk.op3_top_k(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(topk.ORACLE["op3_top_k"]).project("query_id, rank, vec_id, score").fetchall())
    assert got.where("query_id = 0 and vec_id = 7").count() == 2


def test_quality_keeps_clean_documents(spark):
    d = quality.op9_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    j = d.merge(labels, on="doc_id")
    assert j[(j.quality == 1) & ~j.base_failed].kept.mean() > 0.99
    assert j[j.quality == 0].kept.mean() < 0.2


def test_every_language_has_its_own_reference(spark, monkeypatch):
    """A hundred languages: the smallest, in another script, keeps its clean document."""
    latin = [f"{k:02d}" for k in range(98)]
    text = lambda letters, k: " ".join("".join(letters[(i * 7 + j * k) % len(letters)] for j in range(4 + i % 5)) + str(i) for i in range(90))
    rows = [(2 * i + k, text("abcdefghijklmnopqrstuvwxyz", 3 + i + k), lang) for i, lang in enumerate(latin) for k in range(2)]
    rows += [(900, text("กขคงจฉชซฌญฎฏฐฑ", 3), "th"), (901, text("აბგდევზთიკლმ", 5), "ka"), (902, text("abcdefghijklmnop", 3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(quality.judged(docs).collect())
    assert {r["doc_id"] for r in got if r["kept"]} >= {900, 901}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SMALL).collect()} >= {900, 901}
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 3)
    assert sorted(quality.judged(docs).collect()) == got


def test_pipeline_stages(spark, odd):
    """Each stage against what its operator must do, on awkward rows and on sf0.001."""
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), spark.read.parquet(f"{SMALL}/documents.parquet")):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.collect()
            docs = common.materialize(stage(spark, docs, SMALL), "stage")
            assert docs.columns == names
            if name == "near duplicates":
                known = [(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None]
                if len({d for d, _ in known}) == len(known):
                    keep = {d for d, (_, c) in brute_components(known, 5).items() if d == c}
                    assert {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None} == keep
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.count() == docs.count()
