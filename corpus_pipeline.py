"""Five stages from raw documents to packed sequences.

quality rules -> near duplicates -> secrets -> mixing -> packing. Every stage reads what the one before kept and returns the columns of
``documents``; the last returns a row for each piece of a document with its place in a sequence.

Nulls: a null text is rejected by the quality rules (it has fewer than 50 words); a null doc_id passes near-dedup unlinked and is carried to the end.
Rows that repeat a doc_id are one document: near-dedup keeps the one of smallest text. Empty tables give empty results, and columns
besides those of ``documents`` are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.op3_hyperminhash import near_duplicates
from skerry.llm.op6_secrets import redact, train
from skerry.llm.op8_packing import pack
from skerry.llm.op9_mixing import mix_sources
from skerry.llm.op10_quality import quality_verdict
from skerry.llm.shared import Scratch
from skerry.llm.sift import marked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express the forest of the secret scan or the token ids of packing; tests hold the stages against brute force.
ORACLE_SQL = None
#: Similarity of word shingles that makes near copies, in hundredths; op3_hyperminhash alone is set to 85.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    judged = docs.select(*COLUMNS, quality_verdict(F.col("text")).alias("verdict"))
    return judged.filter("verdict.kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group; texts are linked from a similarity of PERCENT on.

    Ids that go or repeat are few. Rows that a map of bits rules out from them stay as they are, and only the others are shuffled to be told apart.
    """
    scratch, docs = Scratch(spark, "dedup"), docs.select(*COLUMNS)
    verdict = scratch.keep(near_duplicates(docs, percent=PERCENT), "verdict")
    special = verdict.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).filter("n > 1 or not kept")
    special = scratch.keep(special.select("doc_id", "kept"), "special")
    rows = marked(docs, special, ["doc_id"], "maybe")
    told = rows.filter("maybe").drop("maybe").join(special.hint("merge"), "doc_id", "left").filter("kept is null or kept")
    repeats = told.filter("kept").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.*")
    return rows.filter("not maybe").select(*COLUMNS).union(told.filter("kept is null").select(*COLUMNS)).union(repeats.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    clean = docs.withColumn("text", redact(F.col("text"), train()))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities."""
    return mix_sources(docs).filter("mix.sampled").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing sources to target weights", mixing), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
