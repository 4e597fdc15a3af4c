"""A pipeline over documents: language ID, one document of each near-duplicate group, secrets out, the mix, packing.

Cases, in every stage: a null text has no language and goes at the first stage, as do texts without letters; null sources are a source of
their own; null ids are ids like others, and rows of equal ids are documents of their own; rows that are equal in all
columns are near duplicates if they have words; very long texts are single rows; ties go to the smallest id, then to the smallest hash of the
row; empty tables give empty ones; further columns of any names are carried along unread, up to the packed result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import common, jaccard, language, mixing, packing, secrets

#: Below this posterior a text is taken for no learned language.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay, with the predicted one as lang."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = language.learn(typed)
    return language.keep_known(docs, model, LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join one row stays: that of the smallest id (null ids come last), then of the smallest
    hash. What has no words stays too."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    tie = F.xxhash64(*names)
    join = jaccard.Join(docs, tie=tie)
    labels = join.labels.withColumnRenamed("node", "sid")
    rows = join.documents.where("sid IS NOT NULL").join(labels, "sid", "left").groupBy(F.coalesce("label", "sid").alias("label"))
    first = rows.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_first"))
    first = common.materialize(first, "first")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD)
    kept = docs.where(words).select(F.struct(*names).alias("row"), F.col("doc_id").alias("doc_id"), tie.alias("tie"))
    same = (kept["tie"] == F.col("_first")) & kept["doc_id"].eqNullSafe(F.col("_id"))
    kept = kept.join(first.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "tie"])
    kept = kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where(~words))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text becomes a mark, and n_chars follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the language model nor the mix's draws nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
