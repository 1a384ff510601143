"""From raw ``documents`` to encoded training rows, by five of the corpus operators.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's documents.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, neardup, pii, quality
from millrace.llm.common import checked, materialize, only, scratch, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Verdicts belong to a row's language and text, so rows need no unique id: repeated rows stay or go together.
    Null and empty texts have no words and go; a null language has a reference of its own; an empty
    table stays empty.  Columns whose names the operator uses are carried along, not read.
    """
    keyed = docs.withColumns({"__k1": F.xxhash64("lang", "text"), "__k2": F.xxhash64(F.lit(1), "text", "lang")})
    judged = quality.judged(keyed.select(F.struct("__k1", "__k2").alias("doc_id"), "lang", "text"))
    # Verdicts are written first: a filter on them would be pushed into the distances and repeat those.
    judged = materialize(judged.select("doc_id.__k1", "doc_id.__k2", "kept"), "verdicts")
    # Keys of rejected texts: partial aggregation makes a text's copies one row.
    bad = materialize(judged.where(~F.col("kept")).select("__k1", "__k2").distinct(), "bad")
    return keyed.join(checked(bad), ["__k1", "__k2"], "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near duplicates on five-word shingles, of its smallest doc_id.

    Every row is a document of its own, also where a doc_id is null or repeats; of rows equal in doc_id and text
    the smallest stays.  Ties go to the smallest doc_id, nulls last.  Null, empty and blank texts are linked with
    nothing and stay; an empty table stays empty.  Other columns, whatever their names, are carried along.
    """
    found = materialize(neardup.near_duplicates(docs.select("doc_id", "text"), width=5).where("n_shingles > 0").select("row_key", "kept_key"), "found")
    gone = materialize(found.where("row_key <> kept_key").select(F.col("row_key").alias("__key")).distinct(), "gone")
    keyed = docs.withColumn("__key", neardup.row_key())
    # Rows that are equal in doc_id and text share a key; one of them stays.
    twice = found.where("row_key = kept_key").groupBy(F.col("row_key").alias("__key")).agg(F.count(F.lit(1)).alias("c"))
    twice = materialize(twice.where("c > 1").select("__key"), "twice")
    if twice.isEmpty():
        return without(keyed, gone, "__key").select(*docs.columns)
    once = without(keyed, gone.union(twice), "__key").select(*docs.columns)
    row = F.min(F.struct(*docs.columns)).alias("row")
    return once.union(only(keyed, twice, "__key").groupBy("__key").agg(row).select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in place of every span of personal data.

    Rows stay, one for one, repeated ones too; null texts stay null, empty ones empty; spans that overlap become one mark,
    of the kind that starts first.  n_chars follows the text; a column named spans gets the spans; others are carried along.
    """
    return pii.redacted(docs, pii.trained(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts or drops documents as the mix of sources takes them.

    Null, empty and blank texts are never taken; a null source is one of its own, the last; equal rows are taken one
    after the other; an empty table stays empty.  n_chars follows the text; other columns are carried along.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of every row: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no tokens; repeated rows get a row each; an empty table gives no rows.  Other
    columns are not read.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: MinHash candidates, a trained network and a tokenizer have no SQL; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's intermediate tables go once its result is written.

    Null texts, and those that the quality rules reject, leave at the first stage; an empty table
    gives no rows; columns other than the stages' own are carried along.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
