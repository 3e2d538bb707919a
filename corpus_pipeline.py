"""Corpus preparation: named stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents, and any others that come with them; the last returns token ids.

A null text is an empty one: the classifier grades it like any other, it is nobody's
copy, loses no window, weighs nothing in the mixture and has no ids.  Null ids are
ids of their own.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, pieces, quality, queries, simhash, windows
from palimpsest.llm.shared import Scratch

#: Kept if good and clean with at least this probability.
KEEP = 0.5


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality and toxic ones go; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.graded_labels(labels), 3)
    return quality.grade(docs, model).filter(F.col("tail")[1] >= KEEP).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles overlap by 0.8 or more, the smallest id stays.

    SimHash and Golay keys, as in operator 8, find the links of two bits or fewer, which
    the shingles confirm; an exact filter adds the pairs that lie further apart.  An id may have several texts, so rows go by id and text.  Of rows that repeat in
    full one stays.  Rows with a null id, a null text or no words stay.
    """
    groups = simhash.near_duplicates(docs)
    gone = groups.filter("not first").select("id", "node").distinct()
    # the row is held as one column, so that names cannot clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = (F.col("row.doc_id") == F.col("id")) & (simhash.text_node(F.col("row.text")) == F.col("node"))
    left = rows.join(gone, own, "left_anti")
    # only rows whose id repeats are compared as a whole
    again = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again")
    same = F.col("row.doc_id").eqNullSafe(F.col("again"))
    whole = left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates())
    return whole.select("row.*")


def cut_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 35 words that occur again are cut; texts without any stay as they are."""
    cut = windows.remove_repeated_windows(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": chars.cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch toward the target weights, 0.9 of the tokens."""
    mixed = mixing.mix_sources(docs, queries.mix_weights(spark), queries.mix_domain(F.col("source")), fraction=0.9, epochs=1)
    return mixed.select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document by the public 32k vocabulary."""
    ids = pieces.tokenize(docs, queries.file_content("piece_bpe_32k.model"))
    return ids.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids")


STAGES = [
    ("quality classifier", judge_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated windows", cut_repeated_windows),
    ("source mixture", mix_sources),
    ("token ids", tokenize),
]

#: The classifier, the fingerprints and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.save(out)
    return docs
