"""Pipeline over ``documents``: toxicity, near-duplicates, secrets, source mix, tokens. A part of the ``llm`` subpackage, whose ``stages`` it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.shared import stage, table
from glyphmill.llm.stages import STAGES, drop_near_duplicates, drop_toxic, encode, mix_sources, redact_secrets

__all__ = ["ORACLE_SQL", "STAGES", "drop_near_duplicates", "drop_toxic", "encode", "mix_sources", "redact_secrets", "run"]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
