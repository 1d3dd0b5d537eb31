"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage works on all rows its predecessor kept and returns the columns of documents (the
last one adds the mixing columns ``mix_...``, with underscores behind where the input has such a
column). Documents are told apart by row, not by doc_id: of near
copies one row stays, whether their doc_ids are null, repeated or neither (smallest doc_id,
null last, then smallest text hash), and of rows that repeat doc_id and text one stays; an
empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainset.llm import decontamination, line_dedup, mixing, simhash_dedup, toxicity
from grainset.session import _track_table, ensure_checkpoint_dir, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.mark(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("rest.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    out = line_dedup.line_dedup(docs, carry=True)
    return out.select(*[(new[c] if c in new else F.col("rest")[c]).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component (``simhash_dedup.keep_one``)."""
    ship_package(spark)
    return simhash_dedup.keep_one(docs, shingle=simhash_dedup.SHINGLE, distance=simhash_dedup.DISTANCE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    index = decontamination.build_index(docs, _table(spark, sf_dir, "benchmark"))
    return decontamination.mark(docs, index).where(F.size("matches") == 0).select("rest.*")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mixed(docs, _table(spark, sf_dir, "labels"), carry=True)
    taken, extra = {c.lower() for c in docs.columns}, {}
    for c in ("n_tokens", "domain", "posterior", "rate", "expected_tokens"):
        name = f"mix_{c}"
        while name in taken:  # a corpus that was mixed before keeps its columns
            name += "_"
        taken.add(name)
        extra[name] = F.col(c)
    return out.select("rest.*", *[c.alias(name) for name, c in extra.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
]

# Classifiers, hashing and iteration: no stage is expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    _track_table(spark, folder)  # removed by cleanup_checkpoints
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
