"""From raw documents to token ids: operators of ``tracelume.llm`` in a row.

Each stage takes what its predecessor kept as ``docs``; ``run`` writes and rereads
the documents between stages in the folder that all executors share.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume.llm import decontaminate, jaccard, mixing, quality_rules, scratch, simhash, tokens
from tracelume.llm.queries import label_domains, tokenizer_path

#: Target shares of tokens. The anchor's tokens stay as they are, so clean documents do; what a soft classifier leaves
#: with the others in clean documents is within their shares, so all three targets can be met.
WEIGHTS, ANCHOR = {"clean": 0.985, "low": 0.01, "toxic": 0.005}, "clean"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    scratch.release(spark)
    return quality_rules.judged(docs).where("q_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of those that SimHash links, then of those of five-word similarity 0.8 or more.

    Texts of that similarity lie up to fourteen bits apart, so what the radius of four
    misses is found by a MinHash of shingles and compared exactly.
    """
    scratch.release(spark)
    return jaccard.keep_one(docs, radius=simhash.RADIUS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    scratch.release(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, rounded at random, so that expected tokens are the targets."""
    scratch.release(spark)
    labelled = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, model = mixing.mixed(docs, labelled, WEIGHTS, anchor=ANCHOR)
    if not model.fit.met:
        warnings.warn(f"no rates meet the targets: expected tokens of {model.domains} are {model.fit.expected}", stacklevel=2)
    several = out.where("mix_copies >= 1").withColumn("mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return several.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document: doc_id, start, n_tokens, ids_crc32."""
    scratch.release(spark)
    path = scratch.new_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokenizer_path())
    return tokens.digests(spark, path)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mix),
    ("token output", tokenize),
]

#: Fingerprints, robust estimates and tokens have no SQL; a test holds run() against a pipeline in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and reread; what a stage and its operators wrote goes when the next is done."""
    docs, older = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        with scratch.recorded() as made:
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                tables = scratch.Scratch(spark)
                docs = tables.table(docs, "stage")
        if k < len(STAGES) - 1:
            scratch.delete(spark, *older, *[p for p in made if p != tables.last])
            older = [tables.last]
    return docs
