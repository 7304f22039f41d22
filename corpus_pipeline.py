"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import language_id, near_dup, packing, pii, quality
from lattica.llm.common import stored, table
from lattica.llm.queries import pii_key, tokenizer

#: A text is in no known language if the best one's probability isn't that much
#: above chance, or if less than this share of its words is known (whole, or by
#: n-grams of three letters or more).
ABOVE_CHANCE, LEAST_KNOWN = 0.05, 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in no known language; ``lang`` is filled in where null."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    chance = 1 / max(1, len(model.languages))
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= min(1.0, chance + ABOVE_CHANCE)) & (F.col("n_known") >= LEAST_KNOWN * F.col("n_words"))
    found = language_id.predict(docs, model).where(sure)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier predicts to be of low quality."""
    model = quality.fit(quality.labelled(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group (5-word shingles, 80 %).

    Rows go one by one: of rows that share a doc_id those go whose text is a
    copy of another document's, and of rows that also share their words one
    stays. Rows without a doc_id or without words all stay. Rows are numbered
    in a stored table, as a scan that is read twice may number them anew.
    """
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    gone = near_dup.link(docs, words=5, percent=80, row="_row").where("not kept or repeats").select(F.col("row").alias("_row"))
    return docs.join(stored(gone, "gone"), "_row", "left_anti").drop("_row")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, pii_key(), with_counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", judge_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", pseudonymise),
    ("best-fit packing", pack),
]

#: Learned models, components and packing have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k + 1}")
    return docs
