"""From raw documents to token ids: five stages, each on all that the one before kept.

Each stage is (name, function of (spark, docs, sf_dir)); ``run`` writes each result as a
Parquet table in the shared folder and hands the table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callboard import session
from callboard.llm import decontam, langid, linededup, queries, simhash, workspace
from callboard.sources.tables import driver_path


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a letter."""
    return langid.keep_identified(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many pages of their site leave the text; all documents stay."""
    return linededup.without_boilerplate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash, the one with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    return decontam.clean(docs, spark.read.parquet(driver_path(sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text decoded from them."""
    return queries.encoded(docs, "doc_id", "lang", "source")


def tuned(stage):
    """The stage under this library's session settings, as far as the cluster leaves them open."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(session.tune(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", tuned(drop_unidentified)),
    ("line_dedup", tuned(drop_boilerplate)),
    ("simhash_near_dedup", tuned(drop_near_copies)),
    ("decontamination", tuned(drop_contaminated)),
    ("bpe_tokens", tuned(tokenise)),
]

#: XXH64 fingerprints, the language model and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = workspace.folder(spark, "pipeline")
    docs = spark.read.parquet(driver_path(sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
