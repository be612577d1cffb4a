"""Reading a set of named tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tablegauge.functions.columns import col, comparable_column
from tablegauge.functions.missing import null_tokens_to_null
from tablegauge.functions.text_types import inferred, parsed

_SUFFIXES = (".parquet", ".csv", ".json", ".orc")


def check_table_names(declared: Iterable[str], found: Iterable[str]) -> None:
    """Raises ``ValueError`` listing both differences unless the two sets are equal."""
    declared, found = set(declared), set(found)
    if declared != found:
        raise ValueError(
            f"table names differ: only declared {sorted(declared - found)}, "
            f"only found {sorted(found - declared)}"
        )


def datasets_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the datasets directly under a folder on any file system Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def tables_in(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def load_tables(
    spark: SparkSession,
    spec: Mapping[str, str | Mapping],
    *,
    folder: str | None = None,
    database: str | None = None,
    check_names: bool = True,
    null_tokens: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Logical name -> table.

    A spec entry is the name of a dataset in ``folder`` or of a table in ``database``,
    or a mapping with ``name``, or ``path``, and optionally ``format``, ``schema`` and
    ``options``. The format defaults to the name's suffix, then Parquet. With
    ``check_names`` the folder or database must hold exactly the declared names.

    CSV without a schema is read as text and gets the types its cells spell
    (:mod:`tablegauge.functions.text_types`), which reads the data twice; give a schema for
    large files. ``null_tokens`` become null first, so tokens in number columns do as well;
    tokens that do not occur change nothing. Cells that do not fit their declared type are
    null, with or without tokens.
    """
    entries = {k: {"name": v} if isinstance(v, str) else dict(v) for k, v in spec.items()}
    named = [e["name"] for e in entries.values() if "name" in e]
    if check_names and named:
        if folder is not None:
            check_table_names(named, datasets_in(spark, folder))
        elif database is not None:
            check_table_names(named, tables_in(spark, database))
    return {
        logical: _load(spark, entry, folder, database, list(null_tokens))
        for logical, entry in entries.items()
    }


def _load(
    spark: SparkSession, entry: Mapping, folder: str | None, database: str | None, tokens: list[str]
) -> DataFrame:
    if "path" not in entry and folder is None:
        name = entry["name"]
        df = spark.read.table(f"{database}.{name}" if database else name)
        return null_tokens_to_null(df, tokens) if tokens else df

    path = entry.get("path") or f"{folder.rstrip('/')}/{entry['name']}"
    suffix = next((s for s in _SUFFIXES if path.endswith(s)), ".parquet")
    kind = entry.get("format", suffix[1:])
    schema = entry.get("schema")
    options = entry.get("options", {})
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    reader = reader.options(**options)
    if schema is None and kind == "csv":
        texts = reader.option("inferSchema", False).load(path)
        return inferred(null_tokens_to_null(texts, tokens) if tokens else texts, options)
    if schema is None:
        df = reader.load(path)
        return null_tokens_to_null(df, tokens) if tokens else df
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not (tokens and kind == "csv"):
        df = reader.schema(schema).load(path)
        return null_tokens_to_null(df, tokens) if tokens else df
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    texts = null_tokens_to_null(reader.schema(as_text).load(path), tokens)
    return texts.select(*[parsed(col(f.name), f.dataType, options).alias(f.name) for f in schema])


def preview(
    df: DataFrame, order_by: Sequence[str | Column], rows: int = 10
) -> DataFrame:
    """First rows in a stated order, ties broken on all columns; a top-k, not a full sort."""
    order = [
        comparable_column(df, o).asc_nulls_first() if isinstance(o, str) else o for o in order_by
    ]
    named = [o for o in order_by if isinstance(o, str)]
    ties = [comparable_column(df, n).asc_nulls_first() for n in df.columns if n not in named]
    return df.orderBy(*order, *ties).limit(rows)
