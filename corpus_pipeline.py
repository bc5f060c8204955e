"""A corpus through five operators of tallysheaf.llm: toxicity, repeated lines, near copies, benchmark passages, packing.

Each stage is a function of (spark, docs, sf_dir). All but the last give back the columns of the documents; the last
gives the pieces of packed sequences. Documents that a stage has nothing against come out of it as they went in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheaf.llm.decontaminate import decontaminate
from tallysheaf.llm.line_dedup import dedup_lines
from tallysheaf.llm.near_duplicates import near_duplicates
from tallysheaf.llm.packing import pack
from tallysheaf.llm.queries import TOKENIZER, toxicity_model
from tallysheaf.llm.shared import stored
from tallysheaf.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones that aren't held out, doesn't call toxic."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines met before, at any place in any document; n_chars counts what is left."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    copies = stored(near_duplicates(docs).where("doc_id <> component_id").select("doc_id"), "near-copies")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth stands in the benchmark."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), end=2)


STAGES = [
    ("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated), ("packing", pack_sequences),
]
#: No SQL for the classifier, the edit join and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, written to the shared folder and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
