"""One query per operator over the given tables and the defect views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import TABLES, Inputs
from tablegauge import operators as op
from tablegauge import plans, sources

# Parameters shared by queries and their SQL.
ARTICLE_FIELDS = ["article_id", "name", "unit", "gtin", "length_cm", "width_cm", "height_cm"]
PLANT_KEYS = ["article_id", "plant"]
PLANT_ORDER = ["length_cm_plant", "width_cm_plant", "height_cm_plant", "status"]
PAIRS = [
    ("length_cm", "length_cm_plant"),
    ("width_cm", "width_cm_plant"),
    ("height_cm", "height_cm_plant"),
]
UNITS = ["cm"]
CURRENCIES = ["EUR", "CHF"]
EVENT_TYPES = ["signup", "purchase", "view", "click"]
DELIMITERS = [",", ";", "/", "(", ")"]
SENTINEL_CODES = [9999999999999]
SENTINEL_PRICES = [9999.99, 0.01]
LINEITEM_SETS = [
    ["l_orderkey"],
    ["l_orderkey", "l_linenumber"],
    ["l_orderkey", "l_partkey"],
    ["l_orderkey", "l_linenumber", "l_partkey"],
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
]
PRICE_SETS = [["price_id"], ["price", "currency"], ["currency"], ["price_id", "currency"]]
PROJECTIONS = {
    "article_category": ["article_id", "category"],
    "article_season": ["article_id", "season"],
    "category_season": ["category", "season"],
}
PROJECTION_KEYS = {"article_category": ["article_id"]}
NULL_TOKENS = ["MACHINERY", "NA", ""]
WIDE_COLUMNS = [
    "price_id", "price", "currency", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
    "o_orderdate", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
]
DETAILS = [
    "unit_consistency_values",
    "unit_consistency_invalid",
    "price_bad_currencies",
    "key_conflict_rows",
    "key_conflict_columns",
    "missing_children_keys",
    "atomicity_flags_articles",
    "atomicity_flags_prices",
    "repeated_rows_plants",
    "candidate_key_scan",
    "decomposition_summary",
    "entity_counts",
]

SUITE_RULES = {
    "vocabularies": {"unit": UNITS, "currency": CURRENCIES, "category": EVENT_TYPES},
    "completeness": {"articles": ARTICLE_FIELDS, "prices": ["price", "currency"]},
    "uniqueness": {"articles": ["article_id", "gtin"]},
    "pair_consistency": {
        "parent": "articles",
        "child": "plants",
        "keys": PLANT_KEYS,
        "pairs": PAIRS,
        "max_deviation": 0.10,
        "order_by": PLANT_ORDER,
    },
    "unit_consistency": [
        {"table": "articles", "column": "unit", "allowed": "vocabularies.unit"},
        {"table": "prices", "column": "currency", "allowed": "vocabularies.currency"},
    ],
    "vocabulary_validity": [
        {"table": "categories", "column": "category", "allowed": "vocabularies.category"}
    ],
    "plausible_range": [
        {
            "table": "articles",
            "columns": ["length_cm", "width_cm", "height_cm"],
            "maximum": 200,
        }
    ],
    "identifier_format": {
        "table": "articles",
        "column": "gtin",
        "length": 13,
        "sentinels": SENTINEL_CODES,
    },
    "price_validity": {
        "table": "prices",
        "price": "price",
        "currency": "currency",
        "sentinels": SENTINEL_PRICES,
        "low": 0.10,
        "high": 999.99,
        "currencies": "vocabularies.currency",
    },
    "referential_integrity": [
        {
            "table": "categories",
            "column": "article_id",
            "parent": "customer",
            "parent_column": "c_custkey",
        }
    ],
    "key_conflicts": {"table": "plants", "keys": PLANT_KEYS},
    "missing_children": {"parent": "articles", "child": "plants", "keys": PLANT_KEYS},
    "atomicity": {"delimiters": DELIMITERS},
}


def _tables(t: Inputs) -> dict[str, DataFrame]:
    return {
        "articles": t.v_articles,
        "plants": t.v_plants,
        "prices": t.v_prices,
        "categories": t.v_categories,
        "customer": t.customer,
        "documents": t.documents,
    }


def _pairs(t: Inputs, zero_baseline: str = "row_consistent") -> DataFrame:
    return op.pair_consistency(
        t.v_articles,
        t.v_plants,
        PAIRS,
        PLANT_KEYS,
        0.10,
        order_by=PLANT_ORDER,
        zero_baseline=zero_baseline,
    )


def _units(t: Inputs) -> DataFrame:
    return op.vocabulary(
        {"articles": t.v_articles, "prices": t.v_prices},
        [("articles", "unit", UNITS), ("prices", "currency", CURRENCIES)],
    )


def _prices(t: Inputs) -> DataFrame:
    return op.price_validity(
        t.v_prices, "price", "currency", SENTINEL_PRICES, 0.10, 999.99, CURRENCIES
    )


def _references(t: Inputs) -> DataFrame:
    return op.referential_integrity(t.v_categories, t.customer, "article_id", "c_custkey")


def _null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = sources.load_tables(
        spark,
        {"customer": "customer.parquet"},
        folder=sf_dir,
        check_names=False,
        null_tokens=NULL_TOKENS,
    )
    return tables["customer"]


def _declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of the folder, which must hold just the declared ones."""
    tables = sources.load_tables(spark, {n: f"{n}.parquet" for n in TABLES}, folder=sf_dir)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


# A rule file in its German keys, and flags that switch one of its checks off.
GERMAN_RULES = {
    "vokabulare": {"waehrung": CURRENCIES},
    "pflichtfelder": {"articles": ARTICLE_FIELDS},
    "schwellenwerte": {"preis_min": 0.10, "preis_max": 999.99},
    "preisvalidierung": {
        "tabelle": "prices",
        "uvp_spalte": "price",
        "waehrung_spalte": "currency",
        "sentinel_werte": SENTINEL_PRICES,
        "gueltige_werte": "vokabulare.waehrung",
    },
    "plausibilitaet_masse": [
        {
            "tabelle": "articles",
            "spalten": ["length_cm", "width_cm", "height_cm"],
            "implausibel_max": 200,
        }
    ],
    "gtin_check": {"tabelle": "articles", "spalte": "gtin", "laenge": 13},
}
FLAGS = {"extra_checks": {"plausibilitaet_masse": True, "gtin_format": False}}


def _german_suite(t: Inputs) -> DataFrame:
    rules = plans.article_rules(GERMAN_RULES, FLAGS) | {"overview": False}
    return sources.metrics_of(plans.run_suite(_tables(t), rules))


def _suite(t: Inputs, **options) -> dict[str, DataFrame]:
    return plans.run_suite(_tables(t), SUITE_RULES, **options)


def _panel(name: str) -> Callable[[Inputs], DataFrame]:
    """A panel from a run of just the checks it shows."""

    def query(t: Inputs) -> DataFrame:
        results = plans.run_suite(_tables(t), plans.panel_rules(SUITE_RULES, [name]))
        return plans.report_panels(results)[name]

    return query


# Rules across fields, in the German keys of a rule file.
FIELD_RULES = {
    "schwellenwerte": {"vollstaendigkeit_min": 0.95},
    "pflichtfelder": {"articles": ["article_id", "name", "unit"]},
    "gtin_check": {
        "tabelle": "articles",
        "spalte": "gtin",
        "laenge": 13,
        "sentinel_werte": SENTINEL_CODES,
        "pruefziffer": True,
    },
    "schluesselformat": [{"tabelle": "articles", "spalte": "gtin", "muster": "4[0-9]{12}"}],
    "einheiten": UNITS,
    "feldabhaengigkeiten": [
        {
            "name": "centimetres need a length",
            "tabelle": "articles",
            "wenn": {"unit": {"in": "einheiten"}},
            "dann": {"length_cm": {"ueber": 0, "max": 200}},
        },
        {
            "name": "sentinel codes have no name",
            "tabelle": "articles",
            "wenn": {"gtin": 9999999999999},
            "dann": {"oder": [{"name": None}, {"unit": ["mm (falsch)"]}]},
        },
        {
            "name": "width is twice the size",
            "tabelle": "articles",
            "wenn": {"nicht": {"unit": None}, "width_cm": {"min": 20}},
            "dann": {"height_cm": {"ueber": 25}, "length_cm": {"ungleich": 250}},
            "fehlend": "auslassen",
        },
        {
            "name": "francs are whole",
            "tabelle": "prices",
            "wenn": {"currency": {"gleich": "CHF"}},
            "dann": {"price": {"min": 1, "fehlt": False}},
        },
    ],
}
FIELD_DETAILS = [
    "implication_rows_articles",
    "implication_rows_prices",
    "check_digits_rows_articles_gtin",
    "key_format_rows_articles_gtin",
]


def _field_rules(t: Inputs) -> list:
    return plans.article_rules(FIELD_RULES)["implications"]


def _field_suite(t: Inputs, details: bool = False) -> dict[str, DataFrame]:
    rules = plans.article_rules(FIELD_RULES) | {"overview": False}
    return plans.run_suite({"articles": t.v_articles, "prices": t.v_prices}, rules, details=details)


def _field_details(t: Inputs) -> DataFrame:
    results = _field_suite(t, details=True)
    return reduce(
        DataFrame.unionByName,
        [
            results[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("result"), "rows")
            for name in FIELD_DETAILS
        ],
    )


def _history(t: Inputs) -> DataFrame:
    """Verdicts per run over a history of two runs: articles with even and with odd numbers."""
    spark = t.v_articles.sparkSession
    path = f"{sources.use_checkpoint_folder(spark)}/history-{uuid.uuid4().hex}"
    for run, rest in (("even", 0), ("odd", 1)):
        part = t.v_articles.where(F.col("article_id") % 2 == rest)
        results = {"completeness": op.completeness(part, ARTICLE_FIELDS), "uniqueness": op.uniqueness(part, ["gtin"])}
        sources.append_metrics(results, path, run)
    thresholds = [
        {"check": "completeness", "metric": "completeness", "min": 0.96},
        {"check": "uniqueness", "metric": "uniqueness", "field": "gtin", "min": 0.5, "max": 0.98},
    ]
    return plans.run_verdicts(plans.verdicts(spark.read.parquet(path), thresholds))


def _sketches(t: Inputs) -> DataFrame:
    """Distinct values by sketches of two parts of a table, merged, next to the exact counts."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]
    parts = [op.distinct_sketches(t.lineitem.where(F.col("l_linenumber") % 2 == i), names) for i in (0, 1)]
    merged = op.sketch_counts(op.merge_sketches(parts[0].unionByName(parts[1])))
    exact = op.column_profile(t.lineitem, names).select("column", F.col("distinct").alias("exact"))
    off = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * op.sketch_error()
    joined = merged.join(exact.hint("merge"), "column")
    return joined.select("column", "rows", "present", "exact", off.alias("within"))


def _approximate_profile(t: Inputs) -> DataFrame:
    """Approximate distinct counts of a profile next to the exact ones, within three errors."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]
    rough = op.column_profile(t.lineitem, names, approximate=0.02).select("column", "missing", "distinct")
    exact = op.column_profile(t.lineitem, names).select("column", F.col("distinct").alias("exact"))
    off = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 0.06
    return rough.hint("merge").join(exact, "column").select("column", "missing", "exact", off.alias("within"))


# What a CSV file holds as text, some of which only looks like a value of another type.
CSV_CELLS = """CAST(s_suppkey AS STRING) AS key,
  CASE s_suppkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'NA' END AS flag,
  concat(lpad(s_suppkey % 50, 2, '0'), 'D') AS code,
  CASE WHEN s_suppkey % 7 = 0 THEN 'NA' ELSE concat('2024-01-', lpad(1 + s_suppkey % 28, 2, '0')) END AS day,
  concat(lpad(s_suppkey % 24, 2, '0'), ':30') AS clock,
  lpad(s_suppkey, 6, '0') AS zeros,
  CASE WHEN s_suppkey % 5 = 0 THEN 'NA' ELSE CAST(s_acctbal AS STRING) END AS amount,
  CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'FALSE' END AS even"""


def _csv_types(t: Inputs) -> DataFrame:
    """A CSV written from a given table and read back in the types its cells spell."""
    spark = t.supplier.sparkSession
    path = f"{sources.use_checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    spark.sql(f"SELECT {CSV_CELLS} FROM {{s}}", s=t.supplier).write.option("header", True).csv(path)
    spec = {"suppliers": {"path": path, "format": "csv"}}
    found = sources.load_tables(spark, spec, check_names=False, null_tokens=["NA"])["suppliers"]
    # One more column with the types, so that they are compared with the SQL side as well.
    kinds = ", ".join(f"{n}:{kind}" for n, kind in found.dtypes)
    return found.withColumn("kinds", F.lit(kinds))


def _key_kinds(t: Inputs) -> DataFrame:
    """Decimal keys against doubles that read the same, some of them shifted."""
    child = t.orders.selectExpr(
        "CAST(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 0.005D ELSE o_totalprice END AS DECIMAL(20,4)) AS amount"
    )
    parent = t.orders.selectExpr("o_totalprice * 1D AS amount").unionByName(t.orders.selectExpr("1e8D + o_orderkey AS amount"))
    return op.referential_integrity(child, parent, "amount", "amount")


def _nested_conflicts(t: Inputs) -> DataFrame:
    """Rows in conflict whose cells are structs of maps, laid out flat."""
    nested = t.lineitem.selectExpr(
        "l_orderkey AS k",
        "named_struct('q', l_linenumber % 2, 'm', CASE l_linenumber % 3"
        " WHEN 0 THEN map('a', l_suppkey % 2, 'b', 1L) ELSE map('b', 1L, 'a', l_suppkey % 2) END) AS s",
    )
    found = op.key_conflict_columns(nested, ["k"])
    return found.selectExpr("k", "conflict_in", "s.q AS q", "s.m['a'] AS a", "s.m['b'] AS b")


def _nested(t: Inputs) -> DataFrame:
    """Orders with a struct of a time, a number and a map each, equal for some orders."""
    return t.orders.selectExpr(
        "named_struct('at', timestampadd(MICROSECOND, o_orderkey % 3, timestamp_micros(0)),"
        " 'd', CAST(CASE o_orderkey % 2 WHEN 0 THEN 0.0D ELSE -0.0D END AS DOUBLE),"
        " 'm', CASE o_orderkey % 5 WHEN 0 THEN map('a', o_orderkey % 7, 'b', 1L)"
        " ELSE map('b', 1L, 'a', o_orderkey % 7) END) AS s"
    )


def _wide(t: Inputs) -> DataFrame:
    """Every price beside its customer and nation: more than 30 columns, four times over."""
    joined = t.v_prices.join(t.orders, F.col("price_id") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(*[F.col(n).alias(f"{n}_{i}") for i in range(4) for n in WIDE_COLUMNS])


def _decompose(t: Inputs) -> DataFrame:
    """The tables of a decomposition one below the other, under one set of columns."""
    parts = op.decompose(t.v_categories, PROJECTIONS)
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("projection", F.lit(name)) for name, df in parts.items()],
    )


def _suite_round_trip(t: Inputs) -> DataFrame:
    """The suite's results written and read back as labelled CSV."""
    spark = t.v_articles.sparkSession
    base = f"{sources.use_checkpoint_folder(spark)}/suite-{uuid.uuid4().hex}"
    results = _suite(t, details=False)
    few = {name: results[name] for name in ("completeness", "unit_consistency", "key_conflicts")}
    paths = sources.write_results(few, base, format="csv", labels=True)
    return sources.metrics_of(sources.read_results(spark, paths, format="csv"))


def _suite_details(t: Inputs) -> DataFrame:
    """How many offending rows each check of the suite with its diagnostics lists."""
    rules = SUITE_RULES | {
        "atomicity": {"delimiters": DELIMITERS, "keys": {"prices": ["price_id"]}},
        "candidate_key_scan": {"table": "prices", "key_sets": PRICE_SETS},
        "decomposition_summary": {
            "table": "categories",
            "projections": PROJECTIONS,
            "keys": PROJECTION_KEYS,
        },
        "entity_counts": {"table": "categories", "columns": ["article_id", "category"]},
        "repeated_rows": {"table": "plants", "keys": PLANT_KEYS, "order_by": PLANT_ORDER},
    }
    results = plans.run_suite(_tables(t), rules, details=True)
    return reduce(
        DataFrame.unionByName,
        [
            results[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("result"), "rows")
            for name in DETAILS
        ],
    )


def _on(query: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Inputs(spark, sf_dir))


QUERIES_BY_NAME: dict[str, Callable[[Inputs], DataFrame]] = {
    # missing values
    "blank_counts": lambda t: op.blank_count(t.v_articles),
    "missing_counts": lambda t: op.missing_count(t.v_articles),
    "missing_total": lambda t: op.missing_total(t.v_articles),
    "blank_to_null": lambda t: op.blank_to_null(t.v_articles),
    # profiles
    "table_overview": lambda t: op.table_overview(t.v_articles),
    "column_profile": lambda t: op.column_profile(t.v_articles),
    "column_profile_nested": lambda t: op.column_profile(_nested(t)),
    "duplicate_rows": lambda t: op.duplicate_row_count(t.v_plants),
    "duplicate_rows_digest": lambda t: op.duplicate_row_count(t.v_plants, digest=True),
    "duplicate_documents_digest": lambda t: op.duplicate_row_count(
        t.documents.select("text", "lang"), digest=True
    ),
    "missing_share": lambda t: op.missing_share(t.v_articles),
    "profile_tables": lambda t: op.profile_tables(_tables(t)),
    "profile_columns": lambda t: op.profile_columns(
        {"lineitem": t.lineitem, "orders": t.orders, "documents": t.documents}, digest=True
    ),
    # core measures
    "completeness_wide": lambda t: op.completeness(_wide(t), _wide(t).columns),
    "completeness": lambda t: op.completeness(t.v_articles, ARTICLE_FIELDS),
    "uniqueness": lambda t: op.uniqueness(t.v_articles, ["article_id", "gtin", "name"]),
    "dedupe_keep_first": lambda t: op.dedupe_keep_first(t.v_plants, PLANT_KEYS, PLANT_ORDER),
    "pair_consistency": _pairs,
    "pair_consistency_default_order": lambda t: op.pair_consistency(
        t.v_articles, t.v_plants, PAIRS, PLANT_KEYS, 0.10
    ),
    "pair_consistency_skip_pair": lambda t: _pairs(t, "skip_pair"),
    "vocabulary": _units,
    "vocabulary_validity": lambda t: op.vocabulary_validity(
        {"prices": t.v_prices, "categories": t.v_categories, "articles": t.v_articles},
        [
            ("prices", "currency", CURRENCIES),
            ("categories", "category", EVENT_TYPES),
            ("articles", "unit", UNITS),
        ],
    ),
    "vocabulary_values": lambda t: op.vocabulary_values(t.v_articles, ["unit"]),
    "vocabulary_invalid": lambda t: op.vocabulary_invalid(t.v_articles, "unit", UNITS),
    # row checks
    "plausible_range": lambda t: op.plausible_range(
        {"articles": t.v_articles, "plants": t.v_plants},
        [
            ("articles", ["length_cm", "width_cm", "height_cm"], 200),
            ("articles", ["length_cm"], None),
            ("plants", ["length_cm_plant", "width_cm_plant", "height_cm_plant"], 100),
        ],
    ),
    "identifier_format": lambda t: op.identifier_format(
        t.v_articles, "gtin", 13, SENTINEL_CODES, table="articles"
    ),
    "identifier_format_strict": lambda t: op.identifier_format(
        t.v_articles, "gtin", 13, SENTINEL_CODES, pad=False, table="articles"
    ),
    "price_validity": _prices,
    "price_bad_currencies": lambda t: op.price_bad_currencies(t.v_prices, "currency", CURRENCIES),
    # keys
    "referential_integrity": _references,
    "referential_integrity_rules": lambda t: op.referential_integrity_rules(
        {
            "categories": t.v_categories,
            "customer": t.customer,
            "lineitem": t.lineitem,
            "orders": t.orders,
            "documents": t.documents,
            "labels": t.labels,
        },
        [
            ("categories", "article_id", "customer", "c_custkey"),
            ("lineitem", "l_orderkey", "orders", "o_orderkey"),
            ("documents", "doc_id", "labels", "doc_id"),
        ],
    ),
    "missing_children": lambda t: op.missing_children(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey"
    ),
    "missing_children_keys": lambda t: op.missing_children_keys(
        t.v_articles, t.v_plants, "article_id"
    ),
    "key_conflicts": lambda t: op.key_conflicts(t.v_plants, PLANT_KEYS),
    "key_conflicts_digest": lambda t: op.key_conflicts(t.v_plants, PLANT_KEYS, digest=True),
    "key_conflict_rows": lambda t: op.key_conflict_rows(t.v_plants, PLANT_KEYS),
    "key_conflict_columns": lambda t: op.key_conflict_columns(t.v_plants, PLANT_KEYS),
    "key_conflict_columns_lineitem": lambda t: op.key_conflict_columns(
        t.lineitem, ["l_orderkey", "l_linenumber"]
    ),
    "repeated_rows": lambda t: op.repeated_rows(t.v_plants, PLANT_KEYS, PLANT_ORDER),
    # normal forms
    "atomicity_flags": lambda t: op.atomicity_flags(t.documents, DELIMITERS, ["doc_id"]),
    "atomicity_counts": lambda t: op.atomicity_counts(
        {
            "documents": t.documents,
            "pages": t.pages,
            "conversations": t.conversations,
            "articles": t.v_articles,
            "labels": t.labels,
        },
        DELIMITERS,
    ),
    "candidate_key_scan": lambda t: op.candidate_key_scan(t.lineitem, LINEITEM_SETS),
    "candidate_key_scan_raw": lambda t: op.candidate_key_scan(
        t.v_prices, PRICE_SETS, dedupe=False
    ),
    "decompose": _decompose,
    "decomposition_summary": lambda t: op.decomposition_summary(
        t.v_categories, PROJECTIONS, PROJECTION_KEYS
    ),
    "entity_counts": lambda t: op.entity_counts(t.v_categories, ["article_id", "category"]),
    # rules across fields, codes, sketches
    "implications": lambda t: op.implications(
        {"articles": t.v_articles, "prices": t.v_prices}, _field_rules(t)
    ),
    "implication_rows": lambda t: op.implication_rows(
        t.v_articles, [r for r in _field_rules(t) if r["table"] == "articles"]
    ),
    "check_digits": lambda t: op.check_digits(t.v_articles, "gtin", 13, SENTINEL_CODES, table="articles"),
    "check_digit_rows": lambda t: op.check_digit_rows(t.v_articles, "gtin", 13, SENTINEL_CODES),
    "key_format": lambda t: op.key_format(t.v_articles, "gtin", "4[0-9]{12}", table="articles"),
    "value_shapes": lambda t: op.value_shapes(t.v_articles, ["name", "unit", "gtin"]),
    "value_shapes_runs": lambda t: op.value_shapes(t.customer, ["c_name", "c_mktsegment"], runs=True),
    "unusual_shape_rows": lambda t: op.unusual_shape_rows(t.v_articles, "gtin", 0.05),
    "distinct_sketches": _sketches,
    "column_profile_approximate": _approximate_profile,
    "key_kinds": _key_kinds,
    "key_conflict_columns_nested": _nested_conflicts,
    # report datasets
    "scorecard": _panel("scorecard"),
    "traffic_light": lambda t: plans.with_level(
        op.uniqueness(t.v_articles, ARTICLE_FIELDS).select("field", "uniqueness"), "uniqueness"
    ),
    "panel_completeness": _panel("panel_completeness"),
    "panel_consistency": _panel("panel_consistency"),
    "panel_prices": _panel("panel_prices"),
    "panel_references": _panel("panel_references"),
    "row_count_notice": _panel("row_count_notice"),
    # tables and suites
    "preview": lambda t: sources.preview(t.v_articles, ["name", "article_id"]),
    "suite_metrics": lambda t: sources.metrics_of(_suite(t)),
    "suite_details": _suite_details,
    "suite_of_field_rules": lambda t: sources.metrics_of(
        {n: df for n, df in _field_suite(t).items() if n != "verdicts"}
    ),
    "suite_field_details": _field_details,
    "verdicts": lambda t: _field_suite(t)["verdicts"],
    "verdicts_of_history": _history,
    "csv_types": _csv_types,
    "suite_of_rule_file": _german_suite,
    "suite_round_trip": _suite_round_trip,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _on(query) for name, query in QUERIES_BY_NAME.items()}
    return found | {"null_tokens": _null_tokens, "declared_tables": _declared_tables}
