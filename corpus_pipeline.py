"""From documents to token ids: language ID, near-duplicates, personal data, mixing, byte-pair encoding.

Every stage is (spark, docs, sf_dir) -> DataFrame, works on all rows that its predecessor kept and, but for the last,
returns the columns of documents. Null texts have no language and go in the first stage; a null id is a document like any
other; repeated rows are exact copies and fall to the second; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import bpe, components, langid, mixing, near_copies, pii
from kinelake.runtime import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose language is less certain than this goes; two undecided machines give a quarter.
MIN_SCORE = 0.3
text_key = F.xxhash64


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with no letter or no certain language go; lang is what was found."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.train(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word similarity of 0.8 or more stays: that with the smallest id (one without an id only if none has one).

    Candidates are the SimHash operator's links and, since 4 bits of 64 find few pairs at 0.8, MinHash bands; every link is verified by its true similarity.
    """
    row = F.struct(F.isnull("doc_id").alias("_none"), "doc_id", "lang", "source", "n_chars")
    # equal texts are one node; the hash comes first in the order of grouping, the text itself decides
    equal = docs.select(*COLUMNS, text_key(F.col("text")).alias("_key")).groupBy("_key", "text").agg(F.min(row).alias("_row"))
    one = cut(equal.select(F.monotonically_increasing_id().alias("node"), "_key", "_row.*", "text"))
    tied = cut(near_copies.components(one.select("node", "text")))
    first = F.min(F.struct("_none", "doc_id", "_key", "node"))
    stays = one.select("node", "_none", "doc_id", "_key").join(tied, "node").groupBy("component").agg(first.alias("_first")).select("_first.node")
    goes = components.counted(tied.select("node").join(stays, "node", "left_anti"))
    return one.join(goes, "node", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind."""
    found = pii.find_pii(docs.select(*COLUMNS))
    return found.withColumn("text", pii.redacted(F.col("text"), F.col("pii_spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that a document's source target gives it."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    return mixing.repetitions(mixed).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    ids = bpe.encode_texts(docs, bpe.load_tables(bpe.default_vocabulary()))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: No SQL expresses trained machines, similarities or byte-pair encoding; tests/llm holds run() against rows made by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
