"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are
compared with those of its language over the whole corpus, by Jensen-Shannon distance
(base 2, square root).  Texts below the minimum lengths are not judged by a distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to a in is that it for was on "
    "der die und den von das zu mit sich für des auf "
    "de la le et les en un du une pour que est "
    "el y los se las del por con no para su al"
).split()

#: Words of ASCII punctuation alone (table rules, ornaments) have a bin of their own.
BARE = r"^[!-/:-@\[-`{-~]+$"
CHAR_CLASSES = ("lower", "upper", "digit", "space", "symbol", "other_ascii", "non_ascii")
#: A distance from here on rejects a document that is long enough for it.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.32, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.42, 20
#: References of up to so many languages are broadcast, of the largest first; others are shuffled.
BROADCAST_LANGUAGES = 10_000


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def with_repeated_words(d: DataFrame, w: str, into: str, width: int = 5) -> DataFrame:
    """Adds the number of words that lie in a window of ``width`` words found twice or more
    in the array column ``w``.

    Windows are compared by 64-bit hash.  Equal windows become neighbours by sorting
    (hash, place), so a text costs n log n; texts without a repeat stop at a hash set.
    Every step is a column of its own: a lambda would evaluate an expression per element.
    """
    d = d.withColumn("__h", F.transform(w, lambda x: F.xxhash64(x)))
    at = F.sequence(F.lit(0), F.size("__h") - width)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(width)]))
    d = d.withColumn("__win", F.when(F.size("__h") >= width, hashes))
    pairs = F.array_sort(F.transform("__win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("__pairs", F.when(F.size(F.array_distinct("__win")) < F.size("__win"), pairs))
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("__pairs"), j)["h"], F.lit(False))
    again = F.filter("__pairs", lambda x, i: same(x, i - 1) | same(x, i + 1))
    d = d.withColumn("__at", F.array_sort(F.transform(again, lambda x: x["i"])))
    gaps = F.transform("__at", lambda x, i: F.least(F.lit(width), F.coalesce(F.get(F.col("__at"), i + 1) - x, F.lit(width))))
    n = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return d.withColumn(into, F.coalesce(n, F.lit(0)).cast("long")).drop("__h", "__win", "__pairs", "__at")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common).

    chars and common are the histograms, common with a bin for words of punctuation alone
    and one for all other words.
    """
    d = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.select("*", words(F.col("t")).alias("w"), F.split(F.col("t"), "\n").alias("lines"))
    d = with_repeated_words(d, "w", "n_repeat_words")
    has_word = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "w",
        F.length("t").cast("long").alias("n"),
        _kept_chars(F.col("t"), "[^a-z]+").alias("lower"),
        _kept_chars(F.col("t"), "[^A-Z]+").alias("upper"),
        _kept_chars(F.col("t"), "[^0-9]+").alias("digit"),
        _kept_chars(F.col("t"), "[^#*$%&|<>]+").alias("n_symbols"),
        _kept_chars(F.col("t"), r"[\x00-\x7F]+").alias("non_ascii"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        has_word.alias("lines"),
        F.filter("w", lambda x: x.isin(*COMMON_WORDS)).alias("hits"),
        F.size(F.filter("w", lambda x: x.rlike(BARE))).cast("long").alias("bare"),
        "n_repeat_words",
    )
    space = F.col("n") - F.col("word_chars")
    known = [F.col(c) for c in ("lower", "upper", "digit")]
    rest = F.col("n") - space - F.col("n_symbols") - F.col("non_ascii")
    for c in known:
        rest = rest - c
    counts = F.transform(F.array(*[F.lit(x) for x in COMMON_WORDS]), lambda v: (F.size("hits") - F.size(F.array_remove(F.col("hits"), v))).cast("long"))
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*known, space, F.col("n_symbols"), rest, F.col("non_ascii")).alias("chars"),
        F.concat(counts, F.array(F.col("bare"), F.col("n_words") - F.size("hits") - F.col("bare"))).alias("common"),
    )


def references(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms of every language with its number of documents, and of all documents (one row)."""
    bins = (("chars", len(CHAR_CLASSES)), ("common", len(COMMON_WORDS) + 2))
    sums = [F.coalesce(F.sum(F.get(F.col(c), F.lit(i))), F.lit(0)).alias(f"{c}_{i}") for c, n in bins for i in range(n)]
    pack = lambda to: [F.array(*[F.col(f"{c}_{i}") for i in range(n)]).alias(f"{to}_{c}") for c, n in bins]
    by_lang = f.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums)
    return by_lang.select(F.col("lang").alias("ref_lang"), "n", *pack("lang")), f.agg(*sums).select(*pack("all"))


def with_reference(f: DataFrame, by_lang: DataFrame) -> DataFrame:
    """Adds the histograms of each row's language; null for a null language.

    ``by_lang`` is broadcast after its rows were counted.  Of more than ``BROADCAST_LANGUAGES``
    only the largest are; those that are shuffled then hold a small share of the rows each.
    """
    by_lang = materialize(by_lang, "languages")
    own = F.col("lang") == F.col("ref_lang")
    if by_lang.count() <= BROADCAST_LANGUAGES:
        return f.join(F.broadcast(by_lang.drop("n")), own, "left").drop("ref_lang")
    large = materialize(by_lang.orderBy(F.desc("n"), "ref_lang").limit(BROADCAST_LANGUAGES), "languages").drop("n")
    names = F.broadcast(large.select("ref_lang"))
    small = by_lang.join(names, "ref_lang", "left_anti").drop("n")
    rest = f.where("lang is not null").join(names, own, "left_anti")
    parts = [f.join(F.broadcast(large), own), rest.join(small.hint("merge"), own)]
    none = f.where("lang is null").select("*", *[F.lit(None).cast("array<bigint>").alias(c) for c in ("lang_chars", "lang_common")])
    return parts[0].union(parts[1]).drop("ref_lang").union(none)


def with_js_distance(d: DataFrame, p: Column, q: Column, into: str) -> DataFrame:
    """Adds the Jensen-Shannon distance of two count arrays of equal length; null if one is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = d.withColumns({"__p": p, "__q": q})
    d = d.withColumns({"__ps": total(F.col("__p")), "__qs": total(F.col("__q"))})
    share = lambda a, s: F.transform(a, lambda x: x / F.nullif(F.col(s), F.lit(0.0)))
    both = F.arrays_zip(share("__p", "__ps").alias("a"), share("__q", "__qs").alias("b"))
    half = lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0) / 2
    term = lambda z: half(z["a"], z["b"]) + half(z["b"], z["a"])
    js = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, z: s + term(z))))
    return d.withColumn(into, F.when((F.col("__ps") > 0) & (F.col("__qs") > 0), js)).drop("__p", "__q", "__ps", "__qs")


def judged(docs: DataFrame) -> DataFrame:
    """The rules' figures and verdict for every document.

    Null and empty texts have no words and fail the base rule.  A null language is compared
    with all documents.  Repeated rows get a row each; an empty table gives none.
    """
    f = materialize(features(docs), "quality")
    by_lang, everything = references(f)
    j = with_reference(f, by_lang).crossJoin(F.broadcast(everything))
    j = with_js_distance(j, F.col("chars"), F.coalesce("lang_chars", "all_chars"), "char_distance")
    j = with_js_distance(j, F.col("common"), F.coalesce("lang_common", "all_common"), "word_distance")
    j = j.withColumn("n_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = (F.col("n_chars") >= MIN_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) >= MAX_CHAR_DISTANCE)
    odd = odd | (F.col("n_words") >= MIN_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) >= MAX_WORD_DISTANCE)
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~odd).alias("kept"), "char_distance", "word_distance",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of the quality rules for every document.

    Null, empty and blank texts have no words and fail the base rule; null languages are compared
    with all documents; repeated rows get a row each; an empty table gives no rows.  Extra columns
    are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(docs).drop("char_distance", "word_distance")


_LIST = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"
_NC, _NW = len(CHAR_CLASSES), len(COMMON_WORDS) + 2


def _sql_js(p: str, q: str, n: int) -> str:
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    m = f"(({a} + {b}) / 2)"
    one = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: ({one(a)} + {one(b)}) / 2)))) ELSE 0 END"


def judged_sql(documents: str = "documents") -> str:
    """DuckDB SQL with the columns of ``op9_quality``, doc_id unique in ``documents``."""
    ch = lambda c: f"length(regexp_replace(t, '{c}', '', 'g'))"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) GROUP BY 1),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (
  SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {ch("[^#*$%&|<>]+")} AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, length(t) AS n,
    {ch("[^a-z]+")} AS lo, {ch("[^A-Z]+")} AS up, {ch("[^0-9]+")} AS dg, {ch(r"[\x00-\x7F]+")} AS na,
    list_transform({_LIST}, lambda v: len(list_filter(w, lambda x: x = v))) AS cw,
    len(list_filter(w, lambda x: regexp_matches(x, '{BARE}'))) AS bare
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
h AS (
  SELECT *, [lo, up, dg, n - word_chars, n_symbols, word_chars - n_symbols - na - lo - up - dg, na]::DOUBLE[] AS chars,
    (cw || [bare, n_words - list_sum(cw) - bare])::DOUBLE[] AS common FROM f),
refs AS (
  SELECT lang, {sums("chars", _NC)} AS rc, {sums("common", _NW)} AS rw FROM h WHERE lang IS NOT NULL GROUP BY lang),
pooled AS (SELECT {sums("chars", _NC)} AS ac, {sums("common", _NW)} AS aw FROM h),
j AS (SELECT h.*, coalesce(rc, ac) AS qc, coalesce(rw, aw) AS qw FROM h LEFT JOIN refs USING (lang) CROSS JOIN pooled),
s AS (SELECT *, {_sql_js("chars", "qc", _NC)} AS cd, {_sql_js("common", "qw", _NW)} AS wd,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n >= {MIN_CHARS} AND cd >= {MAX_CHAR_DISTANCE}) AND NOT (n_words >= {MIN_WORDS} AND wd >= {MAX_WORD_DISTANCE}) AS kept
FROM s"""


ORACLE = {"op9_quality": judged_sql()}
