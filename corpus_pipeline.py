"""The corpus pipeline: toxicity, near duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.

Defined cases: a stage keeps rows with null columns (a null text counts as the empty text); an empty table passes through
all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, near_duplicates, packing, repeats, toxicity
from tracewell.llm.common import new_path
from tracewell.llm.tokens import vocabulary
from tracewell.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field doesn't reject (score below 0.7)."""
    docs = docs.select(*COLUMNS)
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, field, spans=False).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest key."""
    return near_duplicates.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that an earlier document has; a text that loses nothing stays as it is."""
    rows = docs.select(*COLUMNS).withColumn("no_text", F.col("text").isNull())
    found = repeats.cut(*repeats.repeated_spans(rows, carry=("lang", "source", "n_chars", "no_text")))
    text = F.when(~F.col("no_text"), repeats.decode(F.col("kept")))
    cut = found.withColumn("text", text)
    n = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: A field fitted here, random registers and a tokenizer: SQL expresses none of these; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
