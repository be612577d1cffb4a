"""The SQL counterpart of each registered query, written independently of the operators."""

from __future__ import annotations

from catalog.views import TABLES, with_views

# How a present value is told from a missing one, per column of the article view.
_BLANK = {
    "article_id": "false",
    "name": "trim(name) = ''",
    "unit": "trim(unit) = ''",
    "gtin": "false",
    "length_cm": "false",
    "width_cm": "false",
    "height_cm": "false",
}
_MISSING = {c: f"({c} IS NULL OR coalesce({b}, false))" for c, b in _BLANK.items()}
_TYPES = {
    "article_id": "bigint",
    "name": "string",
    "unit": "string",
    "gtin": "bigint",
    "length_cm": "double",
    "width_cm": "double",
    "height_cm": "double",
}


def _n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


def _rate(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _completeness(table: str, missing: dict[str, str]) -> str:
    rows = [
        f"SELECT '{c}' AS field, {_n(m)} AS missing, "
        f"1 - {_rate(_n(m), 'count(*)')} AS completeness FROM {table}"
        for c, m in missing.items()
    ]
    total = " + ".join(_n(m) for m in missing.values())
    rows.append(
        f"SELECT '_gesamt' AS field, {total} AS missing, "
        f"1 - {_rate(f'({total})', f'(count(*) * {len(missing)})')} AS completeness FROM {table}"
    )
    return _union(rows)


def _uniqueness(table: str, fields) -> str:
    return _union(
        f"""SELECT '{c}' AS field, count(*) AS total, {_n(_MISSING[c])} AS missing,
  count(DISTINCT {c}) FILTER (WHERE NOT {_MISSING[c]}) AS "distinct",
  {_n("NOT " + _MISSING[c])} - count(DISTINCT {c}) FILTER (WHERE NOT {_MISSING[c]}) AS duplicates,
  {_rate(f"count(DISTINCT {c}) FILTER (WHERE NOT {_MISSING[c]})", "count(*)")} AS uniqueness
FROM {table}"""
        for c in fields
    )


def _profile(table: str, types: dict[str, str], missing: dict[str, str]) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", '{kind}' AS type, {_n(missing[c])} AS missing,
  {_rate(_n(missing[c]), "count(*)")} * 100 AS missing_percent,
  count(DISTINCT {c}) FILTER (WHERE NOT {missing[c]}) AS "distinct",
  {_rate(f"count(DISTINCT {c}) FILTER (WHERE NOT {missing[c]})", "count(*)")} * 100
    AS distinct_percent
FROM {table}"""
        for c, kind in types.items()
    )


def _strings(*names: str) -> dict[str, str]:
    return {n: f"({n} IS NULL OR trim({n}) = '')" for n in names}


def _others(*names: str) -> dict[str, str]:
    return {n: f"({n} IS NULL)" for n in names}


def _overview(table: str, nulls: dict[str, str], blanks: dict[str, str], label: str = "") -> str:
    k = len(nulls)
    front = f"'{label}' AS \"table\", " if label else ""
    null_cells = " + ".join(_n(x) for x in nulls.values())
    blank_cells = " + ".join(_n(x) for x in blanks.values())
    duplicates = f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))"
    none = "CAST(NULL AS DOUBLE)"
    cells = f"(count(*) * {k})"
    return _union(
        f"SELECT {front}'{name}' AS metric, CAST({value} AS BIGINT) AS value, "
        f"{percent} AS percent FROM {table}"
        for name, value, percent in (
            ("rows", "count(*)", none),
            ("columns", f"any_value({k})", none),
            ("null_cells", null_cells, f"{_rate(f'({null_cells})', cells)} * 100"),
            ("blank_cells", blank_cells, f"{_rate(f'({blank_cells})', cells)} * 100"),
            ("duplicate_rows", duplicates, f"{_rate(f'({duplicates})', 'count(*)')} * 100"),
        )
    )


def _plain_overview(label: str, table: str, strings=(), others=()) -> str:
    names = [*strings, *others]
    return _overview(
        table,
        {n: f"{n} IS NULL" for n in names},
        {n: f"trim({n}) = ''" if n in strings else "false" for n in names},
        label,
    )


_ARTICLE_NULLS = {c: f"{c} IS NULL" for c in _BLANK}

_FIRST = """SELECT article_id, plant, length_cm_plant, width_cm_plant, height_cm_plant, status
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY article_id, plant
    ORDER BY length_cm_plant NULLS FIRST, width_cm_plant NULLS FIRST,
             height_cm_plant NULLS FIRST, status NULLS FIRST) AS rn
  FROM v_plants)
WHERE rn = 1"""

_DEVIATES = {
    p: f"coalesce(abs({p} - {p}_plant) / nullif({p}, 0) > CAST(0.1 AS DOUBLE), false)"
    for p in ("length_cm", "width_cm", "height_cm")
}


def _pairs(skip_pair: bool) -> str:
    deviates = " OR ".join(_DEVIATES.values())
    if not skip_pair:
        deviates = f"({deviates}) AND length_cm <> 0 AND width_cm <> 0 AND height_cm <> 0"
    return f"""
WITH first_rows AS ({_FIRST}),
judged AS (
  SELECT (length_cm IS NULL OR width_cm IS NULL OR height_cm IS NULL OR length_cm_plant IS NULL
          OR width_cm_plant IS NULL OR height_cm_plant IS NULL) AS excluded,
         ({deviates}) AS bad
  FROM v_articles a JOIN first_rows f ON a.article_id IS NOT DISTINCT FROM f.article_id),
counted AS (
  SELECT count(*) AS pairs, {_n("excluded")} AS excluded, {_n("NOT excluded")} AS comparable,
         {_n("NOT excluded AND NOT bad")} AS consistent,
         {_n("NOT excluded AND bad")} AS inconsistent
  FROM judged)
SELECT pairs, excluded, comparable, consistent,
  {_rate("consistent", "comparable")} AS consistent_rate,
  inconsistent,
  {_rate("inconsistent", "comparable")} AS inconsistent_rate,
  (excluded + consistent + inconsistent = pairs) AS accounting_ok
FROM counted"""


def _vocabulary(
    label: str, view: str, column: str, values: list[str], uniform: bool, blanks: bool = True
) -> str:
    allowed = ", ".join(f"'{v}'" for v in values)
    missing = f"({column} IS NULL OR trim({column}) = '')"
    valid, invalid = f"{column} IN ({allowed})", f"NOT {missing} AND {column} NOT IN ({allowed})"
    flag = (
        f", ({_n(invalid)} = 0 AND {_n(missing)} = 0) AS uniform" if uniform else ""
    )
    return f"""SELECT '{label}' AS "table", '{column}' AS "column",
  '{", ".join(values)}' AS allowed,
  count(*) AS total, {_n(missing)} AS missing,
  {_n(valid)} AS valid, {_rate(_n(valid), "count(*)")} AS valid_rate,
  {_n(invalid)} AS invalid, {_rate(_n(invalid), "count(*)")} AS invalid_rate{flag}
FROM {view}"""


def _plausible(label: str, view: str, columns: list[str], maximum: float | None) -> str:
    missing = "(" + " OR ".join(f"{c} IS NULL" for c in columns) + ")"
    low = "(" + " OR ".join(f"{c} <= 0" for c in columns) + ")"
    high = (
        "(" + " OR ".join(f"{c} > {maximum}" for c in columns) + ")"
        if maximum is not None
        else "false"
    )
    bad = f"NOT {missing} AND ({low} OR {high})"
    good = f"NOT {missing} AND NOT ({low} OR {high})"
    bound = "NULL" if maximum is None else str(maximum)
    return f"""SELECT '{label}' AS "table", '{", ".join(columns)}' AS columns,
  CAST({bound} AS DOUBLE) AS maximum, count(*) AS total, {_n(missing)} AS missing,
  {_n(f"NOT {missing} AND {low}")} AS too_low, {_n(f"NOT {missing} AND {high}")} AS too_high,
  {_n(bad)} AS implausible, {_rate(_n(bad), "count(*)")} AS implausible_rate,
  {_n(good)} AS plausible, {_rate(_n(good), "count(*)")} AS plausible_rate
FROM {view}"""


def _identifier(wrong: str) -> str:
    sentinel = "gtin = 9999999999999"
    bad = f"gtin <> 9999999999999 AND {wrong}"
    invalid = f"({sentinel} OR ({bad}))"
    good = f"gtin IS NOT NULL AND NOT {invalid}"
    return f"""SELECT 'articles' AS "table", 'gtin' AS "column", count(*) AS total,
  {_n("gtin IS NULL")} AS missing, {_n(sentinel)} AS sentinel,
  {_n(bad)} AS format_invalid, {_rate(_n(bad), "count(*)")} AS format_invalid_rate,
  CAST(0 AS BIGINT) AS unparseable,
  {_n(invalid)} AS total_invalid, {_rate(_n(invalid), "count(*)")} AS total_invalid_rate,
  {_n(good)} AS valid, {_rate(_n(good), "count(*)")} AS valid_rate
FROM v_articles"""


_SENTINEL = "coalesce(price IN (CAST(9999.99 AS DOUBLE), CAST(0.01 AS DOUBLE)), false)"
_RANGE = (
    f"(NOT {_SENTINEL} AND coalesce(price < CAST(0.10 AS DOUBLE) "
    "OR price > CAST(999.99 AS DOUBLE), false))"
)
_CURRENCY = "NOT coalesce(currency IN ('EUR', 'CHF'), false)"
_BAD_PRICE = f"({_SENTINEL} OR {_RANGE} OR {_CURRENCY})"
_PRICES = f"""
SELECT count(*) AS total, {_n(_SENTINEL)} AS sentinel, {_n(_RANGE)} AS out_of_range,
  {_n(_CURRENCY)} AS bad_currency,
  {_n(_BAD_PRICE)} AS invalid, {_rate(_n(_BAD_PRICE), "count(*)")} AS invalid_rate,
  {_n("NOT " + _BAD_PRICE)} AS valid, {_rate(_n("NOT " + _BAD_PRICE), "count(*)")} AS valid_rate
FROM v_prices"""


def _references(child: str, column: str, parent: str, parent_column: str, label: str = "") -> str:
    front = f"'{label}' AS \"table\", " if label else ""
    orphan = f"k NOT IN (SELECT {parent_column} FROM {parent} WHERE {parent_column} IS NOT NULL)"
    return f"""SELECT {front}count(*) AS keys, {_n(f"NOT ({orphan})")} AS referenced,
  {_n(orphan)} AS orphaned, {_rate(_n(orphan), "count(*)")} AS orphan_rate
FROM (SELECT DISTINCT {column} AS k FROM {child} WHERE {column} IS NOT NULL)"""


def _children(parent: str, key: str, child: str, child_key: str) -> str:
    has = f"k IN (SELECT {child_key} FROM {child} WHERE {child_key} IS NOT NULL)"
    return f"""SELECT count(*) AS keys, {_n(has)} AS with_child,
  {_n(f"NOT ({has})")} AS without_child,
  {_rate(_n(f"NOT ({has})"), "count(*)")} AS without_child_rate
FROM (SELECT DISTINCT {key} AS k FROM {parent} WHERE {key} IS NOT NULL)"""


_CONFLICTS = """
SELECT (SELECT count(*) FROM v_plants) AS rows,
  (SELECT count(*) FROM v_plants) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_plants))
    AS exact_duplicates,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM v_plants))
    - (SELECT count(*) FROM (SELECT DISTINCT article_id, plant FROM v_plants)) AS conflicts,
  (SELECT count(*) FROM (SELECT DISTINCT article_id, plant FROM v_plants)) AS rows_after_cleaning
"""


def _conflict_columns(view: str, keys: list[str], others: list[str]) -> str:
    by = ", ".join(keys)
    flags = ", ".join(f"count(DISTINCT {c}) > 1 AS differs_{c}" for c in others)
    same = " AND ".join(f"d.{k} = g.{k}" for k in keys)
    listed = ", ".join(f"CASE WHEN differs_{c} THEN '{c}' END" for c in others)
    values = ", ".join(f"CASE WHEN differs_{c} THEN d.{c} END AS {c}" for c in others)
    return f"""
WITH rows_once AS (SELECT DISTINCT * FROM {view}),
groups AS (SELECT {by}, {flags} FROM rows_once GROUP BY {by} HAVING count(*) > 1)
SELECT {", ".join(f"d.{k}" for k in keys)}, concat_ws(', ', {listed}) AS conflict_in, {values}
FROM rows_once d JOIN groups g ON {same}"""


def _contains(column: str) -> str:
    return (
        "(" + " OR ".join(f"contains({column}, '{d}')" for d in (",", ";", "/", "(", ")")) + ")"
    )


def _flagged(label: str, table: str, columns: list[str]) -> str:
    total = " + ".join(_n(_contains(c)) for c in columns) or "any_value(0)"
    return (
        f"SELECT '{label}' AS \"table\", CAST({len(columns)} AS BIGINT) AS text_columns, "
        f"CAST({total} AS BIGINT) AS flagged FROM {table}"
    )


def _key_scan(table: str, sets: list[list[str]], dedupe: bool) -> str:
    base = f"(SELECT DISTINCT * FROM {table})" if dedupe else table
    parts = []
    for s in sets:
        by = ", ".join(s)
        rows, keys = f"(SELECT count(*) FROM {base})", f"(SELECT DISTINCT {by} FROM {base})"
        parts.append(
            f"SELECT '{by}' AS key_columns, {rows} AS rows, "
            f"(SELECT count(*) FROM {keys}) AS distinct_keys, "
            f"{rows} - (SELECT count(*) FROM {keys}) AS duplicates"
        )
    return _union(parts)


def _projection(name: str, columns: str, key: str) -> str:
    rows = f"(SELECT count(*) FROM (SELECT DISTINCT {columns} FROM v_categories))"
    keys = f"(SELECT count(*) FROM (SELECT DISTINCT {key} FROM v_categories))"
    return (
        f"SELECT '{name}' AS projection, {rows} AS rows, {keys} AS distinct_keys, "
        f"{rows} - {keys} AS key_conflicts"
    )


def _level(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN {value} >= 1.0 THEN 'dark_green' "
        f"WHEN {value} >= CAST(0.98 AS DOUBLE) THEN 'light_green' "
        f"WHEN {value} >= CAST(0.95 AS DOUBLE) THEN 'yellow' "
        f"WHEN {value} >= CAST(0.90 AS DOUBLE) THEN 'orange' ELSE 'red' END AS level"
    )


_UNITS = _union(
    [
        _vocabulary("articles", "v_articles", "unit", ["cm"], uniform=True),
        _vocabulary("prices", "v_prices", "currency", ["EUR", "CHF"], uniform=True),
    ]
)
_PRICE_FIELDS = _completeness("v_prices", _others("price") | _strings("currency"))
_EVENT_TYPES = ["signup", "purchase", "view", "click"]


def _inner(sql: str) -> str:
    """A query as a subquery: its own WITH stays inside."""
    return "(" + sql.strip() + ")"


def _long(check: str, sql: str, metrics: list[str], field: str, table: str) -> str:
    return _union(
        f"SELECT '{check}' AS \"check\", {table} AS \"table\", {field} AS field, "
        f"'{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {_inner(sql)}"
        for m in metrics
    )


_NO_FIELD = "CAST(NULL AS VARCHAR)"


def _prices_long() -> str:
    metrics = [
        "total",
        "sentinel",
        "out_of_range",
        "bad_currency",
        "invalid",
        "invalid_rate",
        "valid",
        "valid_rate",
    ]
    return _long("price_validity", _PRICES, metrics, _NO_FIELD, "'prices'")


def _plausible_long() -> str:
    metrics = [
        "maximum",
        "total",
        "missing",
        "too_low",
        "too_high",
        "implausible",
        "implausible_rate",
        "plausible",
        "plausible_rate",
    ]
    sql = _plausible("articles", "v_articles", ["length_cm", "width_cm", "height_cm"], 200)
    return _long("plausible_range", sql, metrics, "columns", '"table"')


def _articles_long() -> str:
    sql = _completeness("v_articles", _MISSING)
    return _long("completeness", sql, ["missing", "completeness"], "field", "'articles'")


def _suite_metrics() -> str:
    vocabulary = ["total", "missing", "valid", "valid_rate", "invalid", "invalid_rate"]
    parts = [
        _articles_long(),
        _long(
            "completeness",
            _PRICE_FIELDS,
            ["missing", "completeness"],
            "field",
            "'prices'",
        ),
        _long(
            "uniqueness",
            _uniqueness("v_articles", ["article_id", "gtin"]),
            ["total", "missing", '"distinct"', "duplicates", "uniqueness"],
            "field",
            "'articles'",
        ).replace("'\"distinct\"'", "'distinct'"),
        _long(
            "pair_consistency",
            _pairs(skip_pair=False),
            [
                "pairs",
                "excluded",
                "comparable",
                "consistent",
                "consistent_rate",
                "inconsistent",
                "inconsistent_rate",
                "accounting_ok",
            ],
            _NO_FIELD,
            _NO_FIELD,
        ),
        _long("unit_consistency", _UNITS, [*vocabulary, "uniform"], '"column"', '"table"'),
        _long(
            "vocabulary_validity",
            _vocabulary("categories", "v_categories", "category", _EVENT_TYPES, uniform=False),
            vocabulary,
            '"column"',
            '"table"',
        ),
        _plausible_long(),
        _long(
            "identifier_format",
            _identifier("length(CAST(gtin AS VARCHAR)) > 13"),
            [
                "total",
                "missing",
                "sentinel",
                "format_invalid",
                "format_invalid_rate",
                "unparseable",
                "total_invalid",
                "total_invalid_rate",
                "valid",
                "valid_rate",
            ],
            '"column"',
            '"table"',
        ),
        _prices_long(),
        _long(
            "referential_integrity",
            _references("v_categories", "article_id", "customer", "c_custkey"),
            ["keys", "referenced", "orphaned", "orphan_rate"],
            _NO_FIELD,
            "'categories'",
        ),
        _long(
            "key_conflicts",
            _CONFLICTS,
            ["rows", "exact_duplicates", "conflicts", "rows_after_cleaning"],
            _NO_FIELD,
            _NO_FIELD,
        ),
        _long(
            "missing_children",
            _children("v_articles", "article_id", "v_plants", "article_id"),
            ["keys", "with_child", "without_child", "without_child_rate"],
            _NO_FIELD,
            _NO_FIELD,
        ),
    ]
    for label, view, columns in (
        ("articles", "v_articles", ["name", "unit"]),
        ("plants", "v_plants", ["status"]),
        ("prices", "v_prices", ["currency"]),
        ("categories", "v_categories", ["category"]),
        ("customer", "customer", ["c_name", "c_mktsegment"]),
        ("documents", "documents", ["text", "lang", "source"]),
    ):
        parts.append(
            _long(
                "atomicity_counts",
                _flagged(label, view, columns),
                ["text_columns", "flagged"],
                _NO_FIELD,
                '"table"',
            )
        )
    return _union(parts)


_DUPLICATES = """
SELECT (SELECT count(*) FROM {rows}) AS rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM {rows})) AS distinct_rows,
  (SELECT count(*) FROM {rows}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {rows}))
    AS duplicate_rows"""


def _wide() -> str:
    texts = ["currency", "o_orderstatus", "c_name", "c_mktsegment"]
    others = [
        "price_id", "price", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
        "c_nationkey", "c_acctbal",
    ]
    missing = _strings(*texts) | _others(*others)
    fields = {f"{n}_{i}": m for i in range(4) for n, m in missing.items()}
    table = "v_prices JOIN orders ON price_id = o_orderkey JOIN customer ON o_custkey = c_custkey"
    counts = ", ".join(f"{_n(m)} AS {n}" for n, m in fields.items())
    rows = [
        f"SELECT '{n}' AS field, {n} AS missing, 1 - {_rate(n, 'rows')} AS completeness FROM c"
        for n in fields
    ]
    total = f"({' + '.join(fields)})"
    rows.append(
        f"SELECT '_gesamt', {total}, 1 - {_rate(total, f'(rows * {len(fields)})')} FROM c"
    )
    return f"WITH c AS (SELECT count(*) AS rows, {counts} FROM {table})\n{_union(rows)}"


def _suite_details() -> str:
    def count(name: str, rows: str) -> str:
        return f"SELECT '{name}' AS result, count(*) AS rows FROM {rows}"

    keys = "article_id, plant"
    filled = "article_id IS NOT NULL AND plant IS NOT NULL"
    once = "(SELECT DISTINCT * FROM v_plants)"
    several = f"(SELECT {keys}, count(*) AS n FROM {once} GROUP BY {keys} HAVING count(*) > 1)"
    return _union(
        [
            "SELECT 'unit_consistency_values' AS result, "
            "(SELECT count(DISTINCT unit) FROM v_articles WHERE trim(unit) <> '')"
            " + (SELECT count(DISTINCT currency) FROM v_prices WHERE trim(currency) <> '') AS rows",
            "SELECT 'unit_consistency_invalid', (SELECT count(DISTINCT unit) FROM v_articles"
            " WHERE trim(unit) <> '' AND unit <> 'cm') + (SELECT count(DISTINCT currency)"
            " FROM v_prices WHERE trim(currency) <> '' AND currency NOT IN ('EUR', 'CHF'))",
            count("price_bad_currencies", _inner(_ORACLES["price_bad_currencies"])),
            count("key_conflict_rows", _inner(_ORACLES["key_conflict_rows"])),
            f"SELECT 'key_conflict_columns', coalesce(CAST(sum(n) AS BIGINT), 0) FROM {several} WHERE {filled}",
            count("missing_children_keys", _inner(_ORACLES["missing_children_keys"])),
            f"SELECT 'atomicity_flags_articles', {_n(_contains('name'))} + {_n(_contains('unit'))} FROM v_articles",
            f"SELECT 'atomicity_flags_prices', {_n(_contains('currency'))} FROM v_prices",
            f"SELECT 'repeated_rows_plants', coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM {several}",
            "SELECT 'candidate_key_scan', CAST(4 AS BIGINT)",
            "SELECT 'decomposition_summary', CAST(3 AS BIGINT)",
            "SELECT 'entity_counts', CAST(2 AS BIGINT)",
        ]
    )


def _suite_round_trip() -> str:
    vocabulary = ["total", "missing", "valid", "valid_rate", "invalid", "invalid_rate", "uniform"]
    measures = ["missing", "completeness"]
    return _union(
        [
            _long("completeness", _completeness("v_articles", _MISSING), measures, "field", "'articles'"),
            _long("completeness", _PRICE_FIELDS, measures, "field", "'prices'"),
            _long("unit_consistency", _UNITS, vocabulary, '"column"', '"table"'),
            _long(
                "key_conflicts",
                _CONFLICTS,
                ["rows", "exact_duplicates", "conflicts", "rows_after_cleaning"],
                _NO_FIELD,
                _NO_FIELD,
            ),
        ]
    )


_ORACLES = {
    "blank_counts": _union(
        f"SELECT '{c}' AS \"column\", {_n(b)} AS blank FROM v_articles"
        for c, b in _BLANK.items()
    ),
    "missing_counts": _union(
        f"SELECT '{c}' AS \"column\", {_n(m)} AS missing FROM v_articles"
        for c, m in _MISSING.items()
    ),
    "missing_total": f"SELECT {' + '.join(_n(m) for m in _MISSING.values())} AS missing "
    "FROM v_articles",
    "blank_to_null": """
SELECT article_id, CASE WHEN trim(name) = '' THEN NULL ELSE name END AS name,
  CASE WHEN trim(unit) = '' THEN NULL ELSE unit END AS unit, gtin, length_cm, width_cm, height_cm
FROM v_articles""",
    "table_overview": _overview("v_articles", _ARTICLE_NULLS, _BLANK),
    "column_profile": _profile("v_articles", _TYPES, _MISSING),
    "duplicate_rows": """
SELECT count(*) AS rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM v_plants)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_plants)) AS duplicate_rows
FROM v_plants""",
    "column_profile_nested": """
WITH s AS (
  SELECT count(*) AS n, count(DISTINCT (o_orderkey % 3, o_orderkey % 7)) AS d FROM orders)
SELECT 's' AS "column", 'struct<at:timestamp,d:double,m:map<string,bigint>>' AS type,
  CAST(0 AS BIGINT) AS missing, CAST(0 AS DOUBLE) / nullif(n, 0) * 100 AS missing_percent,
  d AS "distinct", CAST(d AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0) * 100 AS distinct_percent
FROM s""",
    "duplicate_rows_digest": _DUPLICATES.format(rows="v_plants"),
    "duplicate_documents_digest": _DUPLICATES.format(rows="(SELECT text, lang FROM documents)"),
    "missing_share": f"""
SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns,
  {" + ".join(_n(m) for m in _MISSING.values())} AS missing,
  {_rate("(" + " + ".join(_n(m) for m in _MISSING.values()) + ")", "(count(*) * 7)")} * 100
    AS missing_percent,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_articles)) AS duplicate_rows
FROM v_articles""",
    "profile_tables": _union(
        [
            _overview("v_articles", _ARTICLE_NULLS, _BLANK, "articles"),
            _plain_overview(
                "plants",
                "v_plants",
                ["status"],
                ["article_id", "plant", "length_cm_plant", "width_cm_plant", "height_cm_plant"],
            ),
            _plain_overview("prices", "v_prices", ["currency"], ["price_id", "price"]),
            _plain_overview("categories", "v_categories", ["category"], ["article_id", "season"]),
            _plain_overview(
                "customer",
                "customer",
                ["c_name", "c_mktsegment"],
                ["c_custkey", "c_nationkey", "c_acctbal"],
            ),
            _plain_overview(
                "documents", "documents", ["text", "lang", "source"], ["doc_id", "n_chars"]
            ),
        ]
    ),
    "profile_columns": _union(
        f"SELECT '{label}' AS \"table\", * FROM {_inner(_profile(label, types, missing))}"
        for label, types, missing in (
            (
                "lineitem",
                {
                    "l_orderkey": "bigint",
                    "l_partkey": "bigint",
                    "l_suppkey": "bigint",
                    "l_linenumber": "int",
                    "l_quantity": "double",
                    "l_extendedprice": "double",
                    "l_discount": "double",
                    "l_tax": "double",
                    "l_returnflag": "string",
                    "l_linestatus": "string",
                    "l_shipdate": "timestamp_ntz",
                },
                _strings("l_returnflag", "l_linestatus")
                | _others(
                    "l_orderkey",
                    "l_partkey",
                    "l_suppkey",
                    "l_linenumber",
                    "l_quantity",
                    "l_extendedprice",
                    "l_discount",
                    "l_tax",
                    "l_shipdate",
                ),
            ),
            (
                "orders",
                {
                    "o_orderkey": "bigint",
                    "o_custkey": "bigint",
                    "o_orderstatus": "string",
                    "o_totalprice": "double",
                    "o_orderdate": "timestamp_ntz",
                    "o_orderpriority": "string",
                },
                _strings("o_orderstatus", "o_orderpriority")
                | _others("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"),
            ),
            (
                "documents",
                {
                    "doc_id": "bigint",
                    "text": "string",
                    "lang": "string",
                    "source": "string",
                    "n_chars": "bigint",
                },
                _strings("text", "lang", "source") | _others("doc_id", "n_chars"),
            ),
        )
    ),
    "completeness": _completeness("v_articles", _MISSING),
    "uniqueness": _uniqueness("v_articles", ["article_id", "gtin", "name"]),
    "dedupe_keep_first": _FIRST,
    "pair_consistency": _pairs(skip_pair=False),
    "pair_consistency_skip_pair": _pairs(skip_pair=True),
    "pair_consistency_default_order": _pairs(skip_pair=False),
    "vocabulary": _UNITS,
    "vocabulary_validity": _union(
        [
            _vocabulary("prices", "v_prices", "currency", ["EUR", "CHF"], uniform=False),
            _vocabulary("categories", "v_categories", "category", _EVENT_TYPES, uniform=False),
            _vocabulary("articles", "v_articles", "unit", ["cm"], uniform=False),
        ]
    ),
    "vocabulary_values": f"""
SELECT 'unit' AS "column", unit AS value, count(*) AS rows
FROM v_articles WHERE NOT {_MISSING["unit"]} GROUP BY unit""",
    "vocabulary_invalid": f"""
SELECT 'unit' AS "column", unit AS value, count(*) AS rows
FROM v_articles WHERE NOT {_MISSING["unit"]} AND unit NOT IN ('cm') GROUP BY unit""",
    "plausible_range": _union(
        [
            _plausible("articles", "v_articles", ["length_cm", "width_cm", "height_cm"], 200),
            _plausible("articles", "v_articles", ["length_cm"], None),
            _plausible(
                "plants",
                "v_plants",
                ["length_cm_plant", "width_cm_plant", "height_cm_plant"],
                100,
            ),
        ]
    ),
    "identifier_format": _identifier("length(CAST(gtin AS VARCHAR)) > 13"),
    "identifier_format_strict": _identifier("length(CAST(gtin AS VARCHAR)) <> 13"),
    "price_validity": _PRICES,
    "price_bad_currencies": f"""
SELECT currency, count(*) AS rows FROM v_prices WHERE {_CURRENCY} GROUP BY currency""",
    "referential_integrity": _references("v_categories", "article_id", "customer", "c_custkey"),
    "referential_integrity_rules": _union(
        [
            _references("v_categories", "article_id", "customer", "c_custkey", "categories"),
            _references("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem"),
            _references("documents", "doc_id", "labels", "doc_id", "documents"),
        ]
    ),
    "missing_children": _children("orders", "o_orderkey", "lineitem", "l_orderkey"),
    "missing_children_keys": """
SELECT DISTINCT article_id FROM v_articles
WHERE article_id IS NOT NULL
  AND article_id NOT IN (SELECT article_id FROM v_plants WHERE article_id IS NOT NULL)""",
    "key_conflicts": _CONFLICTS,
    "key_conflicts_digest": _CONFLICTS,
    "key_conflict_rows": """
WITH rows_once AS (SELECT DISTINCT * FROM v_plants),
numbered AS (SELECT *, count(*) OVER (PARTITION BY article_id, plant) AS variants FROM rows_once)
SELECT article_id, plant, length_cm_plant, width_cm_plant, height_cm_plant, status
FROM numbered WHERE variants > 1""",
    "key_conflict_columns": _conflict_columns(
        "v_plants",
        ["article_id", "plant"],
        ["length_cm_plant", "width_cm_plant", "height_cm_plant", "status"],
    ),
    "key_conflict_columns_lineitem": _conflict_columns(
        "lineitem",
        ["l_orderkey", "l_linenumber"],
        [
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            "l_shipdate",
        ],
    ),
    "repeated_rows": """
WITH rows_once AS (SELECT DISTINCT * FROM v_plants),
numbered AS (
  SELECT *, row_number() OVER (
    PARTITION BY article_id, plant
    ORDER BY length_cm_plant NULLS FIRST, width_cm_plant NULLS FIRST,
             height_cm_plant NULLS FIRST, status NULLS FIRST) AS rn
  FROM rows_once)
SELECT article_id, plant, length_cm_plant, width_cm_plant, height_cm_plant, status
FROM numbered WHERE rn > 1""",
    "atomicity_flags": _union(
        f"SELECT doc_id, '{c}' AS \"column\", {c} AS value FROM documents WHERE {_contains(c)}"
        for c in ("text", "lang", "source")
    ),
    "atomicity_counts": _union(
        [
            _flagged("documents", "documents", ["text", "lang", "source"]),
            _flagged("pages", "pages", ["url", "html"]),
            _flagged("conversations", "conversations", ["role", "text"]),
            _flagged("articles", "v_articles", ["name", "unit"]),
            _flagged("labels", "labels", []),
        ]
    ),
    "candidate_key_scan": _key_scan(
        "lineitem",
        [
            ["l_orderkey"],
            ["l_orderkey", "l_linenumber"],
            ["l_orderkey", "l_partkey"],
            ["l_orderkey", "l_linenumber", "l_partkey"],
            ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        ],
        dedupe=True,
    ),
    "candidate_key_scan_raw": _key_scan(
        "v_prices",
        [["price_id"], ["price", "currency"], ["currency"], ["price_id", "currency"]],
        dedupe=False,
    ),
    "decompose": """
SELECT DISTINCT article_id, category, CAST(NULL AS INTEGER) AS season,
  'article_category' AS projection FROM v_categories
UNION ALL SELECT DISTINCT article_id, NULL, season, 'article_season' FROM v_categories
UNION ALL SELECT DISTINCT NULL, category, season, 'category_season' FROM v_categories""",
    "decomposition_summary": _union(
        [
            _projection("article_category", "article_id, category", "article_id"),
            _projection("article_season", "article_id, season", "article_id, season"),
            _projection("category_season", "category, season", "category, season"),
        ]
    ),
    "entity_counts": _union(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS entities "
        "FROM v_categories"
        for c in ("article_id", "category")
    ),
    "scorecard": f"""
WITH cards AS (
  SELECT 'completeness' AS kpi, 'articles' AS "table", 'all mandatory fields' AS scope,
    completeness AS rate
  FROM {_inner(_completeness("v_articles", _MISSING))} WHERE field = '_gesamt'
  UNION ALL
  SELECT 'completeness', 'prices', 'all mandatory fields', completeness
  FROM {_inner(_PRICE_FIELDS)} WHERE field = '_gesamt'
  UNION ALL
  SELECT 'uniqueness', 'articles', field, uniqueness
  FROM {_inner(_uniqueness("v_articles", ["article_id", "gtin"]))}
  UNION ALL
  SELECT 'pair_consistency', NULL, 'comparable pairs', consistent_rate
  FROM {_inner(_pairs(skip_pair=False))}
  UNION ALL
  SELECT 'unit_validity', "table", "column", valid_rate FROM {_inner(_UNITS)})
SELECT kpi, "table", scope, rate, {_level("rate")} FROM cards""",
    "traffic_light": f"""
SELECT field, uniqueness, {_level("uniqueness")}
FROM {_inner(_uniqueness("v_articles", list(_BLANK)))}""",
    "panel_completeness": f"""
SELECT 'articles' AS "table", field, missing, completeness, {_level("completeness")}
FROM {_inner(_completeness("v_articles", _MISSING))} WHERE field <> '_gesamt'
UNION ALL
SELECT 'prices', field, missing, completeness, {_level("completeness")}
FROM {_inner(_PRICE_FIELDS)} WHERE field <> '_gesamt'""",
    "panel_consistency": f"""
WITH p AS {_inner(_pairs(skip_pair=False))}, u AS {_inner(_UNITS)}
SELECT CAST(NULL AS VARCHAR) AS "table", 'pairs' AS bar, 'consistent' AS segment,
  consistent AS rows, {_rate("consistent", "pairs")} AS share FROM p
UNION ALL SELECT NULL, 'pairs', 'inconsistent', inconsistent, {_rate("inconsistent", "pairs")} FROM p
UNION ALL SELECT NULL, 'pairs', 'not_comparable', excluded, {_rate("excluded", "pairs")} FROM p
UNION ALL SELECT "table", "column", 'valid', valid, {_rate("valid", "(valid + invalid)")} FROM u
UNION ALL
SELECT "table", "column", 'invalid', invalid, {_rate("invalid", "(valid + invalid)")} FROM u""",
    "panel_prices": f"""
WITH p AS {_inner(_PRICES)}
SELECT 'valid' AS segment, valid AS rows, valid_rate AS share, false AS overlapping FROM p
UNION ALL SELECT 'invalid', invalid, invalid_rate, false FROM p
UNION ALL SELECT 'sentinel', sentinel, {_rate("sentinel", "total")}, true FROM p
UNION ALL SELECT 'bad_currency', bad_currency, {_rate("bad_currency", "total")}, true FROM p""",
    "panel_references": f"""
WITH r AS {_inner(_references("v_categories", "article_id", "customer", "c_custkey"))}
SELECT 'categories' AS bar, 'referenced' AS segment, referenced AS rows,
  {_rate("referenced", "keys")} AS share FROM r
UNION ALL SELECT 'categories', 'orphaned', orphaned, {_rate("orphaned", "keys")} FROM r""",
    "row_count_notice": f"""
WITH p AS {_inner(_pairs(skip_pair=False))}, u AS {_inner(_UNITS)}, k AS {_inner(_CONFLICTS)}
SELECT "table", "column", valid + invalid <> pairs AS mismatch, valid + invalid AS unit_rows,
  pairs AS pair_rows, exact_duplicates, conflicts FROM u, p, k""",
    "preview": """
SELECT * FROM v_articles
ORDER BY name NULLS FIRST, article_id NULLS FIRST, unit NULLS FIRST, gtin NULLS FIRST,
  length_cm NULLS FIRST, width_cm NULLS FIRST, height_cm NULLS FIRST
LIMIT 10""",
    "suite_metrics": _suite_metrics(),
    "null_tokens": """
SELECT c_custkey, CASE WHEN c_name IN ('MACHINERY', 'NA', '') THEN NULL ELSE c_name END AS c_name,
  c_nationkey, c_acctbal,
  CASE WHEN c_mktsegment IN ('MACHINERY', 'NA', '') THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""",
}


_ORACLES |= {
    "completeness_wide": _wide(),
    "suite_details": _suite_details(),
    "suite_round_trip": _suite_round_trip(),
    "suite_of_rule_file": _union([_articles_long(), _prices_long(), _plausible_long()]),
    "declared_tables": _union(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES),
}


_LENGTH_OK = "coalesce(length_cm > 0 AND length_cm <= 200, false)"
_FIELD_RULES = (
    # table, rule, where it applies, where it cannot be decided, what it demands
    ("articles", "centimetres need a length", "coalesce(unit = 'cm', false)", "false", _LENGTH_OK),
    (
        "articles",
        "sentinel codes have no name",
        "coalesce(gtin = 9999999999999, false)",
        "false",
        f"({_MISSING['name']} OR coalesce(unit = 'mm (falsch)', false))",
    ),
    (
        "articles",
        "width is twice the size",
        f"(NOT {_MISSING['unit']} AND coalesce(width_cm >= 20, false))",
        "(height_cm IS NULL OR length_cm IS NULL)",
        "(coalesce(height_cm > 25, false) AND coalesce(length_cm <> 250, false))",
    ),
    ("prices", "francs are whole", "coalesce(currency = 'CHF', false)", "false", "coalesce(price >= 1, false)"),
)


def _violated(applies: str, undecided: str, demanded: str) -> str:
    return f"({applies} AND NOT {undecided} AND NOT {demanded})"


def _implications() -> str:
    parts = []
    for table, rule, applies, undecided, demanded in _FIELD_RULES:
        decided = _n(f"{applies} AND NOT {undecided}")
        violated = _n(_violated(applies, undecided, demanded))
        parts.append(
            f"""SELECT '{table}' AS "table", '{rule}' AS rule, count(*) AS total, {_n(applies)} AS applicable,
  {_n(f"{applies} AND {undecided}")} AS undecided, {decided} - {violated} AS fulfilled,
  {violated} AS violated, {_rate(violated, decided)} AS violated_rate FROM v_{table}"""
        )
    return _union(parts)


def _implication_rows(table: str) -> str:
    return _union(
        f"SELECT '{rule}' AS rule, * FROM v_{t} WHERE {_violated(*conditions)}"
        for t, rule, *conditions in _FIELD_RULES
        if t == table
    )


# The thirteenth digit that the other twelve ask for, and the one that is there.
_EXPECTED = (
    "(10 - ("
    + " + ".join(f"(gtin // {10**k}) % 10 * {3 if k % 2 else 1}" for k in range(1, 13))
    + ") % 10) % 10"
)
_WRONG = f"(gtin % 10 <> {_EXPECTED})"
_FULL = "(gtin BETWEEN 1000000000000 AND 9999999999998)"
_CHECK_DIGITS = f"""
SELECT 'articles' AS "table", 'gtin' AS "column", count(*) AS total, {_n("gtin IS NULL")} AS missing,
  CAST(0 AS BIGINT) AS unparseable, {_n("gtin = 9999999999999")} AS sentinel,
  {_n("gtin >= 10000000000000")} AS too_long,
  {_n(f"gtin < 1000000000000 AND {_WRONG}")} AS short_check_digit_invalid,
  {_n(f"gtin < 1000000000000 AND NOT {_WRONG}")} AS short_valid,
  {_n(f"{_FULL} AND {_WRONG}")} AS check_digit_invalid, {_n(f"{_FULL} AND NOT {_WRONG}")} AS valid,
  {_rate(_n(f"{_FULL} AND {_WRONG}"), _n(_FULL))} AS check_digit_invalid_rate
FROM v_articles"""
_CHECK_DIGIT_ROWS = f"""
SELECT *, CAST({_EXPECTED} AS INTEGER) AS expected_digit FROM v_articles WHERE {_FULL} AND {_WRONG}"""
_FORMAT = "regexp_full_match(CAST(gtin AS VARCHAR), '4[0-9]{12}')"
_KEY_FORMAT = f"""
SELECT 'articles' AS "table", 'gtin' AS "column", '4[0-9]{{12}}' AS pattern, count(*) AS total,
  {_n("gtin IS NULL")} AS missing, {_n(_FORMAT)} AS matching, {_n(f"NOT {_FORMAT}")} AS not_matching,
  {_rate(_n(_FORMAT), "count(gtin)")} AS matching_rate
FROM v_articles"""


def _shape(text: str, runs: bool = False) -> str:
    for pattern, sign in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "9")):
        text = f"regexp_replace({text}, '{pattern}{'+' if runs else ''}', '{sign}', 'g')"
    return text


def _value_shapes(table: str, missing: dict[str, str]) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", {_shape(f"CAST({c} AS VARCHAR)")} AS shape, count(*) AS rows,
  {_rate("count(*)", f"(SELECT count(*) FROM {table} WHERE NOT {m})")} AS share, min(CAST({c} AS VARCHAR)) AS example
FROM {table} WHERE NOT {m} GROUP BY ALL"""
        for c, m in missing.items()
    )


# With runs: one sign stays alone, more get a plus.
_RUNS = "regexp_replace(regexp_replace(regexp_replace({}, 'aa+', 'a+', 'g'), 'AA+', 'A+', 'g'), '99+', '9+', 'g')"


def _value_shapes_runs() -> str:
    parts = []
    for c in ("c_name", "c_mktsegment"):
        shape = _RUNS.format(_shape(c))
        parts.append(
            f"""SELECT '{c}' AS "column", {shape} AS shape, count(*) AS rows,
  {_rate("count(*)", "(SELECT count(*) FROM customer)")} AS share, min({c}) AS example FROM customer GROUP BY ALL"""
        )
    return _union(parts)


_UNUSUAL = f"""
WITH s AS (
  SELECT {_shape("CAST(gtin AS VARCHAR)")} AS shape, count(*) AS rows FROM v_articles WHERE gtin IS NOT NULL GROUP BY ALL
)
SELECT v.*, s.shape FROM v_articles AS v JOIN s ON s.shape = {_shape("CAST(gtin AS VARCHAR)")}
WHERE CAST(s.rows AS DOUBLE) / (SELECT count(gtin) FROM v_articles) <= 0.05"""

_SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]
_DISTINCT_SKETCHES = _union(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS exact, true AS within
FROM lineitem"""
    for c in _SKETCHED
)
_KEY_KINDS = """
WITH c AS (
  SELECT DISTINCT CAST(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + CAST(0.005 AS DOUBLE) ELSE o_totalprice END
                       AS DECIMAL(20,4)) AS amount FROM orders
), p AS (
  SELECT CAST(o_totalprice AS DECIMAL(20,4)) AS amount FROM orders
  UNION SELECT CAST(100000000 + o_orderkey AS DECIMAL(20,4)) FROM orders
), k AS (SELECT c.amount IN (SELECT amount FROM p) AS met FROM c WHERE amount IS NOT NULL)
SELECT count(*) AS keys, count(*) FILTER (met) AS referenced, count(*) FILTER (NOT met) AS orphaned,
  CAST(count(*) FILTER (NOT met) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) AS orphan_rate FROM k"""
_NESTED_CONFLICTS = """
WITH d AS (
  SELECT DISTINCT l_orderkey AS k, l_linenumber % 2 AS q, l_suppkey % 2 AS a, CAST(1 AS BIGINT) AS b FROM lineitem
)
SELECT k, 's' AS conflict_in, q, a, b FROM d
WHERE k IN (SELECT k FROM d GROUP BY k HAVING count(*) > 1)"""
_CSV_TYPES = """
SELECT CAST(s_suppkey AS INTEGER) AS key,
  CASE s_suppkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS flag,
  lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0') || 'D' AS code,
  CASE WHEN s_suppkey % 7 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER) END AS day,
  lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || ':30' AS clock,
  lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS zeros,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS amount,
  s_suppkey % 2 = 0 AS even,
  'key:int, flag:string, code:string, day:date, clock:string, zeros:string, amount:double, even:boolean' AS kinds
FROM supplier"""


def _field_metrics() -> str:
    fields = {c: _MISSING[c] for c in ("article_id", "name", "unit")}
    rules = ["total", "applicable", "undecided", "fulfilled", "violated", "violated_rate"]
    digits = [
        "total",
        "missing",
        "unparseable",
        "sentinel",
        "too_long",
        "short_check_digit_invalid",
        "short_valid",
        "check_digit_invalid",
        "valid",
        "check_digit_invalid_rate",
    ]
    lengths = [
        "total",
        "missing",
        "sentinel",
        "format_invalid",
        "format_invalid_rate",
        "unparseable",
        "total_invalid",
        "total_invalid_rate",
        "valid",
        "valid_rate",
    ]
    formats = ["total", "missing", "matching", "not_matching", "matching_rate"]
    lengths_sql = _identifier("length(CAST(gtin AS VARCHAR)) > 13")
    return _union(
        [
            _long("completeness", _completeness("v_articles", fields), ["missing", "completeness"], "field", "'articles'"),
            _long("implications", _implications(), rules, "rule", '"table"'),
            _long("check_digits", _CHECK_DIGITS, digits, '"column"', '"table"'),
            _long("identifier_format", lengths_sql, lengths, '"column"', '"table"'),
            _long("key_format", _KEY_FORMAT, formats, '"column"', '"table"'),
        ]
    )


_FIELD_DETAILS = _union(
    f"SELECT '{name}' AS result, count(*) AS rows FROM {_inner(sql)}"
    for name, sql in (
        ("implication_rows_articles", _implication_rows("articles")),
        ("implication_rows_prices", _implication_rows("prices")),
        ("check_digits_rows_articles_gtin", _CHECK_DIGIT_ROWS),
        ("key_format_rows_articles_gtin", f"SELECT * FROM v_articles WHERE NOT {_FORMAT}"),
    )
)
_VERDICTS = f"""
SELECT "check", "table", field, metric, value, CAST(0.95 AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS maximum,
  value >= 0.95 AS passed
FROM {_inner(_field_metrics())} WHERE metric = 'completeness'"""


def _history() -> str:
    parts = []
    for run, rest in (("even", 0), ("odd", 1)):
        view = f"(SELECT * FROM v_articles WHERE article_id % 2 = {rest})"
        complete = f"SELECT completeness BETWEEN 0.96 AND 1 AS fine FROM {_inner(_completeness(view, _MISSING))}"
        unique = f"SELECT uniqueness BETWEEN 0.5 AND 0.98 AS fine FROM {_inner(_uniqueness(view, ['gtin']))}"
        parts.append(
            f"""SELECT '{run}' AS run_id, {_n("fine")} AS passed, {_n("NOT fine")} AS failed,
  {_n("fine IS NULL")} AS undecided, {_n("NOT fine")} = 0 AS all_passed FROM ({complete} UNION ALL {unique})"""
        )
    return _union(parts)


_ORACLES |= {
    "implications": _implications(),
    "implication_rows": _implication_rows("articles"),
    "check_digits": _CHECK_DIGITS,
    "check_digit_rows": _CHECK_DIGIT_ROWS,
    "key_format": _KEY_FORMAT,
    "value_shapes": _value_shapes("v_articles", {c: _MISSING[c] for c in ("name", "unit", "gtin")}),
    "value_shapes_runs": _value_shapes_runs(),
    "unusual_shape_rows": _UNUSUAL,
    "distinct_sketches": _DISTINCT_SKETCHES,
    "column_profile_approximate": _union(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS exact, true AS within
FROM lineitem"""
        for c in _SKETCHED
    ),
    "key_kinds": _KEY_KINDS,
    "key_conflict_columns_nested": _NESTED_CONFLICTS,
    "suite_of_field_rules": _field_metrics(),
    "suite_field_details": _FIELD_DETAILS,
    "verdicts": _VERDICTS,
    "verdicts_of_history": _history(),
    "csv_types": _CSV_TYPES,
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
