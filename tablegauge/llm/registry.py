"""All queries of this subpackage and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tablegauge.llm import oracles as _oracles
from tablegauge.llm import queries as _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return _oracles.oracle_sql() | sql
