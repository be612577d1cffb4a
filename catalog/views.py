"""Views over the given tables with defects planted in them.

The given tables have no nulls, blanks or orphan keys, so checks would find nothing.
Each view keeps every row of its table and changes values in some of them. The text is
the same for Spark and for SQL; ``{name}`` stands for a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

VIEWS = {
    "v_articles": """
SELECT
  CASE WHEN p_partkey % 97 = 0 THEN p_partkey - 1 ELSE p_partkey END AS article_id,
  CASE WHEN p_partkey % 29 = 0 THEN NULL
       WHEN p_partkey % 31 = 0 THEN ''
       WHEN p_partkey % 37 = 0 THEN '   ' ELSE p_name END AS name,
  CASE WHEN p_partkey % 41 = 0 THEN 'mm (falsch)'
       WHEN p_partkey % 43 = 0 THEN ' '
       WHEN p_partkey % 47 = 0 THEN NULL ELSE 'cm' END AS unit,
  CASE WHEN p_partkey % 71 = 0 THEN CAST(NULL AS BIGINT)
       WHEN p_partkey % 73 = 0 THEN CAST(9999999999999 AS BIGINT)
       WHEN p_partkey % 79 = 0 THEN CAST(40000000000000 AS BIGINT) + p_partkey
       WHEN p_partkey % 83 = 0 THEN p_partkey
       ELSE CAST(4000000000000 AS BIGINT) + p_partkey END AS gtin,
  CASE WHEN p_partkey % 53 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN p_partkey % 59 = 0 THEN CAST(0 AS DOUBLE)
       WHEN p_partkey % 61 = 0 THEN CAST(-1 AS DOUBLE)
       WHEN p_partkey % 67 = 0 THEN CAST(250 AS DOUBLE)
       ELSE CAST(p_size AS DOUBLE) END AS length_cm,
  CAST(p_size * 2 AS DOUBLE) AS width_cm,
  CAST(p_size * 3 AS DOUBLE) AS height_cm
FROM {part}
""",
    # Every 11th article has no plants: its plant rows carry a key no article has.
    "v_plants": """
SELECT
  CASE WHEN l_partkey % 11 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END AS article_id,
  CAST(l_suppkey % 4 AS INT) AS plant,
  CASE WHEN l_suppkey % 13 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN l_suppkey % 5 = 0 THEN CAST(p_size AS DOUBLE) * CAST(1.5 AS DOUBLE)
       ELSE CAST(p_size AS DOUBLE) END AS length_cm_plant,
  CASE WHEN l_suppkey % 7 = 0 THEN CAST(p_size * 2 AS DOUBLE) * CAST(1.05 AS DOUBLE)
       ELSE CAST(p_size * 2 AS DOUBLE) END AS width_cm_plant,
  CAST(p_size * 3 AS DOUBLE) AS height_cm_plant,
  l_returnflag AS status
FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey
""",
    "v_prices": """
SELECT
  o_orderkey AS price_id,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST(9999.99 AS DOUBLE)
       WHEN o_orderkey % 103 = 0 THEN CAST(0.01 AS DOUBLE)
       WHEN o_orderkey % 107 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN o_orderkey % 109 = 0 THEN CAST(0.05 AS DOUBLE)
       WHEN o_orderkey % 113 = 0 THEN CAST(1500 AS DOUBLE)
       ELSE CAST(1 + o_orderkey % 900 AS DOUBLE) END AS price,
  CASE WHEN o_orderkey % 17 = 0 THEN 'INR'
       WHEN o_orderkey % 19 = 0 THEN NULL
       WHEN o_orderkey % 2 = 0 THEN 'CHF' ELSE 'EUR' END AS currency
FROM {orders}
""",
    "v_categories": """
SELECT
  CASE WHEN event_id % 23 = 0 THEN CAST(NULL AS BIGINT)
       WHEN event_id % 3 = 0 THEN user_id + 1000000 ELSE user_id END AS article_id,
  event_type AS category,
  CAST(event_id % 4 AS INT) AS season
FROM {events}
""",
}


class Inputs:
    """Given tables and views of one folder, by name, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir
        self._loaded: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            if name in VIEWS:
                text = VIEWS[name]
                used = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", text)}
                self._loaded[name] = self._spark.sql(text, **used)
            elif name in TABLES:
                self._loaded[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._loaded[name]


def with_views(sql: str) -> str:
    """A SQL query with the views it names put in front of it."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = [
        f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[v]).strip()})" for v in names
    ]
    sql = sql.strip()
    if not views:
        return sql
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(views) + "\n" + sql
