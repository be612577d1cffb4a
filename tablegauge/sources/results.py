"""Writing results: one folder per check, or one long metrics table over all runs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import col, quoted

# The output folder of each group of checks.
GROUPS = {
    "overview": "datenueberblick",
    "kpis": "kpis",
    "checks": "reporter",
    "normal_forms": "normalisierungsanalyse",
    "panels": "dashboard",
}

_GROUP_OF_CHECK = {
    "table_overview": "overview",
    "column_profile": "overview",
    "missing_share": "overview",
    "completeness": "kpis",
    "uniqueness": "kpis",
    "pair_consistency": "kpis",
    "unit_consistency": "kpis",
    "unit_consistency_values": "kpis",
    "unit_consistency_invalid": "kpis",
    "atomicity_counts": "normal_forms",
    "atomicity_flags": "normal_forms",
    "candidate_key_scan": "normal_forms",
    "decomposition_summary": "normal_forms",
    "entity_counts": "normal_forms",
    "repeated_rows": "normal_forms",
    "key_conflict_columns": "normal_forms",
    "scorecard": "panels",
    "panel_completeness": "panels",
    "panel_consistency": "panels",
    "panel_prices": "panels",
    "panel_references": "panels",
    "row_count_notice": "panels",
}

# The column names of the published result tables.
RESULT_LABELS = {
    "table_overview": {"metric": "Merkmal", "value": "Wert", "percent": "Prozent"},
    "column_profile": {
        "column": "Spalte",
        "type": "Datentyp",
        "missing": "Fehlend",
        "missing_percent": "% Fehlend",
        "distinct": "Eindeutige Werte",
        "distinct_percent": "% Eindeutig",
    },
    "completeness": {
        "field": "feld",
        "missing": "fehlend",
        "completeness": "vollstaendigkeit",
    },
    "uniqueness": {
        "field": "feld",
        "total": "gesamt",
        "missing": "fehlend",
        "distinct": "eindeutig",
        "duplicates": "duplikate",
        "uniqueness": "eindeutig_rate",
    },
    "pair_consistency": {
        "pairs": "paare_gesamt",
        "excluded": "ausgeschlossen",
        "comparable": "vergleichbar",
        "consistent": "konsistent",
        "consistent_rate": "konsistent_rate",
        "inconsistent": "inkonsistent",
        "inconsistent_rate": "inkonsistent_rate",
        "accounting_ok": "_sanity_check",
    },
    "unit_consistency": {
        "table": "tabelle",
        "column": "spalte",
        "allowed": "gueltig",
        "total": "gesamt",
        "missing": "fehlend",
        "uniform": "einheitlich",
    },
    "vocabulary_validity": {
        "table": "tabelle",
        "column": "spalte",
        "allowed": "gueltig",
        "total": "gesamt",
        "missing": "fehlend",
    },
    "plausible_range": {
        "table": "tabelle",
        "columns": "spalten",
        "maximum": "impl_max_threshold",
        "total": "gesamt",
        "missing": "fehlend",
        "too_low": "impl_min_n",
        "too_high": "impl_max_n",
        "implausible": "tot_implausibel",
        "implausible_rate": "tot_implausibel_rate",
        "plausible": "plausibel",
        "plausible_rate": "plausibel_rate",
    },
    "identifier_format": {
        "table": "tabelle",
        "column": "spalte",
        "total": "gesamt",
        "missing": "fehlend",
        "total_invalid": "tot_invalid",
        "total_invalid_rate": "tot_invalid_rate",
    },
    "price_validity": {
        "total": "gesamt",
        "out_of_range": "ausserhalb_range",
        "bad_currency": "ungueltige_waehrung",
        "invalid": "invalid_gesamt",
    },
    "referential_integrity": {
        "keys": "eindeutige_artikel",
        "referenced": "referenziert",
        "orphaned": "verwaist",
        "orphan_rate": "verwaist_rate",
    },
    "key_conflicts": {
        "rows": "zeilen_roh",
        "exact_duplicates": "exakte_duplikate",
        "conflicts": "konflikte",
        "rows_after_cleaning": "zeilen_nach_bereinigung",
    },
    "missing_children": {
        "keys": "artikel_gesamt",
        "with_child": "mit_werksdaten",
        "without_child": "ohne_werksdaten",
        "without_child_rate": "ohne_werksdaten_rate",
    },
    "key_conflict_columns": {"conflict_in": "konflikt_in"},
}


def with_result_labels(check: str, result: DataFrame) -> DataFrame:
    """Renames the columns of a result to those of the published result tables."""
    return result.withColumnsRenamed(RESULT_LABELS.get(check, {}))


def result_path(base: str, check: str) -> str:
    """``base/<group>/<check>``; the results of one table, such as ``atomicity_flags_plants``,
    go to the group of their check."""
    of_table = next((g for c, g in _GROUP_OF_CHECK.items() if check.startswith(f"{c}_")), "checks")
    group = GROUPS[_GROUP_OF_CHECK.get(check, of_table)]
    return f"{base.rstrip('/')}/{group}/{check}"


def _schema_path(path: str) -> str:
    base, _, check = path.rsplit("/", 2)
    return f"{base}/schemas/{check}"


# Text comes back as it was: quotes doubled, line ends inside cells, outer spaces kept.
_CSV = {
    "header": True,
    "escape": '"',
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_results(
    results: Mapping[str, DataFrame],
    base: str,
    *,
    format: str = "parquet",
    mode: str = "overwrite",
    labels: bool = False,
) -> dict[str, str]:
    """Writes each result to ``base/<group>/<check>``; returns the paths.

    Results stay distributed: each is a folder of part files. ``labels`` writes the
    published column names, ``format="csv"`` adds a header. Names and types of the columns
    go to ``base/schemas/<check>``, from where :func:`read_results` takes them.
    """
    paths = {}
    for check, result in results.items():
        paths[check] = result_path(base, check)
        writer = (with_result_labels(check, result) if labels else result).write.mode(mode)
        if format == "csv":
            writer = writer.options(**_CSV)
        writer.format(format).save(paths[check])
        schema = result.sparkSession.createDataFrame([(result.schema.json(),)], "value string")
        schema.coalesce(1).write.mode("overwrite").text(_schema_path(paths[check]))
    return paths


def read_results(
    spark: SparkSession, paths: Mapping[str, str], *, format: str = "parquet"
) -> dict[str, DataFrame]:
    """Results read back from the paths :func:`write_results` returned, with the names and
    types they had, whatever the format and labels.

    Dashboard datasets made from these do not compute the checks again.
    """
    results = {}
    for check, path in paths.items():
        schema = T.StructType.fromJson(
            json.loads(spark.read.text(_schema_path(path), wholetext=True).first()[0])
        )
        reader = spark.read.format(format)
        if format == "csv":  # by position: the header may hold labels
            results[check] = reader.options(**_CSV).schema(schema).load(path)
        else:
            results[check] = reader.load(path).toDF(*schema.names)
    return results


_FIELD_NAMES = ("field", "column", "columns", "rule", "metric", "segment", "kpi")
_METRIC_TYPES = (T.NumericType, T.BooleanType)


def long_metrics(check: str, result: DataFrame, *, table: str | None = None) -> DataFrame:
    """``check, table, field, metric, value`` rows of one metrics result."""
    field = next((n for n in _FIELD_NAMES if n in result.columns), None)
    metrics = [f.name for f in result.schema if isinstance(f.dataType, _METRIC_TYPES)]
    none = F.lit(None).cast("string")
    wide = result.select(
        F.lit(check).alias("check"),
        (col("table") if "table" in result.columns else F.lit(table).cast("string")).alias("table"),
        (col(field) if field else none).alias("field"),
        *[col(n).cast("double").alias(f"\t{n}") for n in metrics],
    )
    return wide.unpivot(
        ["check", "table", "field"], [quoted(f"\t{n}") for n in metrics], "metric", "value"
    ).withColumn("metric", F.ltrim(F.col("metric"), F.lit("\t")))


def metrics_of(results: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`long_metrics` of several results in one frame."""
    return reduce(
        DataFrame.unionByName, [long_metrics(name, df) for name, df in results.items()]
    )


def append_metrics(
    results: Mapping[str, DataFrame], path: str, run_id: str, *, format: str = "parquet"
) -> None:
    """Adds the metrics of a run to a history, one partition per run.

    Writing a run again replaces its partition only, so a retry leaves no copies.
    """
    (
        metrics_of(results)
        .withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .format(format)
        .save(path)
    )
