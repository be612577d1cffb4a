import pytest

from catalog.queries import SUITE_RULES, _tables
from catalog.views import Inputs
from tablegauge import operators as op
from tablegauge import plans, sources
from tablegauge.sources import work

SF_DIR = "/root/testdata/sf0.001"

# A rule file and flags as a user of the German rule format has them, parsed.
ARTICLE_RULES = {
    "pflichtfelder": {"grund": ["Artikelnummer", "Nettogewicht in kg", "GTIN", "Mengeneinheit"]},
    "atomicity_delimiters": [",", "("],
    "eindeutigkeit_felder": {"grund": ["Artikelnummer", "GTIN"]},
    "gueltige_werte": {
        "mengeneinheit": ["g", "kg"],
        "waehrung": ["EUR", "CHF"],
        "mass_einheit": ["cm"],
    },
    "konsistenz_masse": {
        "tabellen": {"grund": "grund", "werk": "werk"},
        "join_key": ["Artikelnummer", "Werk"],
        "vergleichspaare": [{"grund": "Laenge_cm", "werk": "Laenge_cm_werk"}],
    },
    "schwellenwerte": {
        "konsistenz_abweichung_max": 0.10,
        "preis_min": 0.10,
        "preis_max": 999.99,
    },
    "konsistenz_einheit_masse": [
        {
            "tabelle": "werk",
            "spalte": "Mass_Einheit",
            "gueltige_werte": "gueltige_werte.mass_einheit",
        }
    ],
    "plausibilitaet_masse": [
        {"tabelle": "grund", "spalten": ["Laenge_cm"], "implausibel_max": 200},
        {"tabelle": "werk", "spalten": ["Laenge_cm_werk"]},
    ],
    "gtin_check": {
        "tabelle": "grund",
        "spalte": "GTIN",
        "laenge": 13,
        "sentinel_werte": [9999999999999],
    },
    "validitaet_vokabular": [
        {
            "tabelle": "grund",
            "spalte": "Mengeneinheit",
            "gueltige_werte": "gueltige_werte.mengeneinheit",
        }
    ],
    "preisvalidierung": {
        "tabelle": "preise",
        "uvp_spalte": "UVP",
        "waehrung_spalte": "Währung",
        "gueltige_werte": "gueltige_werte.waehrung",
        "sentinel_werte": [9999.99, 0.01],
    },
    "referenzintegritaet": [
        {
            "tabelle": "kategorien",
            "spalte": "Artikelnummer",
            "referenz_tabelle": "grund",
            "referenz_spalte": "Artikelnummer",
        }
    ],
}


@pytest.fixture(scope="module")
def articles(spark):
    return {
        "grund": spark.createDataFrame(
            [
                ("A1", 1.0, 4000000000001.0, "g", 10.0),
                ("A2", None, None, " ", 0.0),
                ("A3", 2.0, 9999999999999.0, "stk", 10.0),
                ("A3", 2.0, 40000000000012.0, "kg", 300.0),
            ],
            "Artikelnummer string, `Nettogewicht in kg` double, GTIN double, "
            "Mengeneinheit string, Laenge_cm double",
        ),
        "werk": spark.createDataFrame(
            [
                ("A1", "Nord", 10.5, "cm", "frei"),
                ("A1", "Nord", 10.5, "cm", "frei"),
                ("A1", "Süd", 12.0, "mm (falsch)", "frei"),
                ("A2", "Nord", 1.0, "cm", "frei"),
                ("A2", "Nord", 1.0, "cm", "weg"),
            ],
            "Artikelnummer string, Werk string, Laenge_cm_werk double, Mass_Einheit string, "
            "Status string",
        ),
        "preise": spark.createDataFrame(
            [("A1", 1.0, "EUR"), ("A1", 9999.99, "INR"), ("A2", None, None)],
            "Artikelnummer string, UVP double, `Währung` string",
        ),
        "kategorien": spark.createDataFrame(
            [("A1", "x"), ("A9", "x,y"), ("A9", "z"), (None, "x")],
            "Artikelnummer string, Kategorie string",
        ),
    }


def test_article_rules_run_as_they_are(articles, rows):
    results = plans.run_suite(articles, plans.article_rules(ARTICLE_RULES), details=True)

    def get(check, *columns):
        return rows(results[check], *columns)

    assert get("completeness", "table", "field", "missing") == [
        ("grund", "Artikelnummer", 0),
        ("grund", "GTIN", 1),
        ("grund", "Mengeneinheit", 1),
        ("grund", "Nettogewicht in kg", 1),
        ("grund", "_gesamt", 3),
    ]
    assert get("uniqueness", "field", "distinct", "duplicates") == [
        ("Artikelnummer", 3, 1),
        ("GTIN", 3, 0),
    ]
    assert get("pair_consistency", "pairs", "excluded", "consistent", "inconsistent") == [
        (3, 0, 2, 1)
    ]
    assert get("unit_consistency", "column", "valid", "invalid", "uniform") == [
        ("Mass_Einheit", 4, 1, False)
    ]
    assert get("unit_consistency_invalid", "value") == [("mm (falsch)",)]
    assert get("vocabulary_validity", "missing", "valid", "invalid") == [(1, 2, 1)]
    assert get("vocabulary_validity_values", "value", "rows") == [("g", 1), ("kg", 1), ("stk", 1)]
    assert get("plausible_range", "table", "too_low", "too_high", "plausible") == [
        ("grund", 1, 1, 2),
        ("werk", 0, 0, 5),
    ]
    assert get("identifier_format", "missing", "sentinel", "format_invalid", "valid") == [
        (1, 1, 1, 1)
    ]
    assert get("price_validity", "sentinel", "bad_currency", "invalid", "valid") == [(1, 2, 2, 1)]
    assert get("price_bad_currencies") == [("INR", 1), (None, 1)]
    assert get("referential_integrity", "keys", "referenced", "orphaned") == [(2, 1, 1)]
    assert get("key_conflicts") == [(5, 1, 1, 3)]
    assert len(get("key_conflict_rows")) == 2
    assert get("key_conflict_columns", "Artikelnummer", "Werk", "conflict_in", "Status") == [
        ("A2", "Nord", "Status", "frei"),
        ("A2", "Nord", "Status", "weg"),
    ]
    assert get("missing_children", "keys", "with_child", "without_child") == [(3, 2, 1)]
    assert get("missing_children_keys") == [("A3",)]
    assert get("atomicity_counts", "table", "flagged") == [
        ("grund", 0),
        ("kategorien", 1),
        ("preise", 0),
        ("werk", 1),
    ]
    assert ("werk", "duplicate_rows", 1) in get("table_overview", "table", "metric", "value")
    assert get("column_profile").__len__() == 5 + 5 + 3 + 2


def test_flags_switch_checks_off():
    config = {"extra_checks": {"gtin_format": True, "plausibilitaet_masse": False}}
    suite = plans.article_rules(ARTICLE_RULES, config)
    assert "identifier_format" in suite
    off = {"plausible_range", "vocabulary_validity", "missing_children", "atomicity"}
    assert not off & set(suite)
    assert off <= set(plans.article_rules(ARTICLE_RULES))


def test_switched_off_blocks_do_not_run(articles):
    rules = {"completeness": {"grund": ["GTIN"]}, "overview": False, "uniqueness": None}
    assert set(plans.run_suite(articles, rules)) == {"completeness"}
    assert plans.run_suite(articles, {}) == {}


def test_overview_of_some_tables(articles, rows):
    rules = {"overview": {"tables": ["werk"], "approximate": 0.01}}
    results = plans.run_suite(articles, rules)
    assert set(results) == {"table_overview", "column_profile"}
    exact = op.column_profile(articles["werk"])
    assert rows(results["column_profile"].drop("table")) == rows(exact)


def test_vocabulary_paths():
    rules = {"a": {"b": ["x"]}}
    assert plans.lookup(rules, "a.b") == ["x"]
    assert plans.allowed_values(rules, "a.b") == ["x"]
    assert plans.allowed_values(rules, ["y"]) == ["y"]
    with pytest.raises(ValueError, match="a.c"):
        plans.lookup(rules, "a.c")


def test_each_table_is_scanned_once_for_all_row_checks(spark):
    t = Inputs(spark, SF_DIR)
    tables = _tables(t)
    plain = {"overview", "uniqueness", "pair_consistency", "referential_integrity"}
    plain |= {"key_conflicts", "missing_children"}
    rules = {k: v for k, v in SUITE_RULES.items() if k not in plain}
    seen = []
    plans.run_suite(tables, rules, settle=lambda df: seen.append(df) or df)
    (counted,) = seen
    plan = counted._jdf.queryExecution().executedPlan().toString()
    # part and orders once each; plants joins lineitem and part; events, customer, documents.
    assert plan.count("FileScan parquet") == 7
    assert counted.count() == 6


def test_suite_equals_single_checks(spark, rows):
    t = Inputs(spark, SF_DIR)
    results = plans.run_suite(_tables(t), SUITE_RULES)
    single = op.completeness(t.v_articles, SUITE_RULES["completeness"]["articles"])
    assert rows(results["completeness"].filter("table = 'articles'").drop("table")) == rows(single)
    by_digest = plans.run_suite(_tables(t), SUITE_RULES | {"digest": True})
    for check in ("uniqueness", "key_conflicts"):
        assert rows(by_digest[check]) == rows(results[check])
    lazy = plans.run_suite(_tables(t), SUITE_RULES, settle=None)
    for check in ("completeness", "price_validity", "identifier_format"):
        assert rows(lazy[check]) == rows(results[check])


def test_panels_of_a_suite(articles, rows):
    results = plans.run_suite(articles, plans.article_rules(ARTICLE_RULES))
    panels = plans.report_panels(results)
    assert set(panels) == {
        "scorecard",
        "panel_completeness",
        "panel_consistency",
        "panel_prices",
        "panel_references",
        "row_count_notice",
    }
    cards = {(r.kpi, r.scope): r.level for r in panels["scorecard"].collect()}
    assert cards[("uniqueness", "Artikelnummer")] == "red"
    assert len(cards) == 5
    completeness = panels["panel_completeness"].collect()
    assert completeness[-1].field == "Artikelnummer" and completeness[-1].level == "dark_green"
    assert rows(panels["row_count_notice"]) == [("werk", "Mass_Einheit", True, 5, 3, 1, 1)]
    shares = {(r.bar, r.segment): r.share for r in panels["panel_consistency"].collect()}
    assert shares[("pairs", "consistent")] == 2 / 3
    assert shares[("Mass_Einheit", "invalid")] == 1 / 5
    assert rows(panels["panel_prices"].filter("overlapping"), "segment", "rows") == [
        ("bad_currency", 2),
        ("sentinel", 1),
    ]
    assert rows(panels["panel_references"], "segment", "share") == [
        ("orphaned", 0.5),
        ("referenced", 0.5),
    ]
    assert plans.report_panels({}) == {}


def test_results_are_written_and_read_back(spark, articles, rows, tmp_path):
    results = plans.run_suite(articles, plans.article_rules(ARTICLE_RULES))
    paths = sources.write_results(results, str(tmp_path / "out"))
    assert paths["completeness"].endswith("/out/kpis/completeness")
    assert paths["table_overview"].endswith("/out/datenueberblick/table_overview")
    back = sources.read_results(spark, paths)
    assert rows(back["completeness"]) == rows(results["completeness"])
    panels = plans.report_panels(back)
    assert rows(panels["row_count_notice"]) == [("werk", "Mass_Einheit", True, 5, 3, 1, 1)]
    assert sources.write_results(panels, str(tmp_path / "out"))["scorecard"].endswith(
        "/out/dashboard/scorecard"
    )

    few = {k: results[k] for k in ("completeness", "key_conflicts")}
    paths = sources.write_results(few, str(tmp_path / "csv"), format="csv", labels=True)
    back = spark.read.csv(paths["key_conflicts"], header=True, inferSchema=True)
    assert back.columns == [
        "zeilen_roh",
        "exakte_duplikate",
        "konflikte",
        "zeilen_nach_bereinigung",
    ]
    assert rows(back) == [(5, 1, 1, 3)]

    paths = sources.write_results(results, str(tmp_path / "all"), format="csv", labels=True)
    back = sources.read_results(spark, paths, format="csv")
    assert {n: df.columns for n, df in back.items()} == {n: df.columns for n, df in results.items()}
    panels = plans.report_panels(back)
    assert rows(panels["row_count_notice"]) == [("werk", "Mass_Einheit", True, 5, 3, 1, 1)]
    flagged = sources.result_path("/out", "atomicity_flags_werk")
    assert flagged == "/out/normalisierungsanalyse/atomicity_flags_werk"


def test_rule_files_flag_cells(articles):
    rules = plans.article_rules(
        ARTICLE_RULES, order_by={"werk": ["Laenge_cm_werk"]}, keys={"grund": ["Artikelnummer"]}
    )
    assert rules["pair_consistency"]["order_by"] == ["Laenge_cm_werk"]
    results = plans.run_suite(articles, rules, details=True)
    counts = {r.table: r.flagged for r in results["atomicity_counts"].collect()}
    for table, n in counts.items():
        assert results[f"atomicity_flags_{table}"].count() == n
    assert results["atomicity_flags_grund"].columns == ["Artikelnummer", "column", "value"]


def test_csv_tokens_and_formats(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "part.csv").write_text("a,b,c,d\n1,1.5,31.12.2020,x\nNA,NA,NA,NA\n3,2,oops,y\n")

    def load(**entry):
        spec = {"t": {"path": str(folder), **entry}}
        return sources.load_tables(spark, spec, null_tokens=["NA"])["t"]

    inferred = load()
    assert [k for _, k in inferred.dtypes] == ["int", "double", "string", "string"]
    assert inferred.agg({"a": "sum"}).first()[0] == 4
    options = {"dateFormat": "dd.MM.yyyy"}
    declared = load(schema="a int, b double, c date, d int", options=options)
    assert [tuple(map(str, r)) for r in declared.orderBy("b").collect()] == [
        ("None", "None", "None", "None"),
        ("1", "1.5", "2020-12-31", "None"),
        ("3", "2.0", "None", "None"),
    ]


def test_metric_history_replaces_a_run(spark, articles, rows, tmp_path):
    results = plans.run_suite(articles, {"key_conflicts": {"table": "werk", "keys": ["Werk"]}})
    path = str(tmp_path / "history")
    for run in ("r1", "r2", "r1"):
        sources.append_metrics(results, path, run)
    history = spark.read.parquet(path)
    assert history.count() == 8
    assert rows(history.filter("run_id = 'r1'"), "check", "metric", "value") == [
        ("key_conflicts", "conflicts", 2.0),
        ("key_conflicts", "exact_duplicates", 1.0),
        ("key_conflicts", "rows", 5.0),
        ("key_conflicts", "rows_after_cleaning", 2.0),
    ]


def test_tables_must_match_their_declaration(spark):
    names = {n: f"{n}.parquet" for n in ("part", "nowhere")}
    with pytest.raises(ValueError, match="nowhere.*lineitem"):
        sources.load_tables(spark, names, folder=SF_DIR)
    some = sources.load_tables(spark, {"p": "part.parquet"}, folder=SF_DIR, check_names=False)
    assert some["p"].count() == 200
    sources.check_table_names(["a"], ["a"])


def test_csv_json_and_catalog_tables(spark, rows, tmp_path):
    folder = tmp_path / "data"
    (folder / "a.csv").mkdir(parents=True)
    (folder / "a.csv" / "part.csv").write_text("id,size,name\n1,NA,x\n2,5, \n3,7,N/A\n")
    (folder / "b.json").mkdir()
    (folder / "b.json" / "part.json").write_text('{"k": 1, "t": "NA"}\n{"k": 2, "t": "ok"}\n')
    spec = {"a": {"name": "a.csv", "schema": "id long, size int, name string"}, "b": "b.json"}
    tables = sources.load_tables(spark, spec, folder=str(folder), null_tokens=["NA", "N/A"])
    assert rows(tables["a"]) == [(1, None, "x"), (2, 5, " "), (3, 7, None)]
    assert rows(tables["b"]) == [(1, None), (2, "ok")]

    inferred = sources.load_tables(spark, {"a": {"path": str(folder / "a.csv")}})
    assert inferred["a"].schema["id"].dataType.simpleString() == "int"

    spark.sql("CREATE DATABASE IF NOT EXISTS quality")
    spark.sql("DROP TABLE IF EXISTS quality.things")
    spark.range(3).write.saveAsTable("quality.things")
    tables = sources.load_tables(spark, {"t": "things"}, database="quality")
    assert tables["t"].count() == 3
    with pytest.raises(ValueError, match="other"):
        sources.load_tables(spark, {"t": "other"}, database="quality")
    spark.sql("DROP TABLE quality.things")


def test_preview_is_a_top_k(spark, rows):
    df = spark.createDataFrame([(i % 7, -i) for i in range(50)], "a int, b int")
    top = sources.preview(df, ["a"], 3)
    assert rows(top) == sorted([(0, -49), (0, -42), (0, -35)], key=lambda r: tuple(map(repr, r)))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_settled_rows_are_kept_in_the_named_folder(spark):
    assert work.use_checkpoint_folder(spark).startswith(
        "file:" + spark.conf.get("spark.checkpoint.dir")
    )
    settled = sources.settle(spark.range(5).selectExpr("id * 2 AS x"))
    assert "Scan ExistingRDD" in settled._jdf.queryExecution().executedPlan().toString()
    assert settled.count() == 5
