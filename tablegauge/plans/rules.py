"""Rule dictionaries: dotted vocabulary paths, and rules of article master data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any


def lookup(rules: Mapping[str, Any], path: str) -> Any:
    """Value at a dotted path such as ``vocabularies.unit``."""
    found: Any = rules
    for part in path.split("."):
        if not isinstance(found, Mapping) or part not in found:
            raise ValueError(f"rules have no entry {path!r}")
        found = found[part]
    return found


def allowed_values(rules: Mapping[str, Any], allowed: str | Sequence[object]) -> list[object]:
    """A vocabulary given as a list or as a dotted path into the rules."""
    return list(lookup(rules, allowed) if isinstance(allowed, str) else allowed)


# The words of conditions in a German rule file.
_CONDITION_WORDS = {
    "und": "and",
    "oder": "or",
    "nicht": "not",
    "gleich": "equals",
    "ungleich": "differs",
    "in": "in",
    "nicht_in": "not_in",
    "min": "min",
    "max": "max",
    "ueber": "above",
    "unter": "below",
    "muster": "matches",
    "wie_spalte": "column",
    "fehlt": "missing",
}


def article_condition(block: Mapping[str, Any], rules: Mapping[str, Any]) -> dict[str, Any]:
    """A condition of :mod:`tablegauge.functions.conditions` from its German form; the values of
    ``in`` and ``nicht_in`` may be a path into the rules."""
    found: dict[str, Any] = {}
    for name, test in block.items():
        word = _CONDITION_WORDS.get(name)
        if word in ("and", "or"):
            found[word] = [article_condition(part, rules) for part in test]
        elif word == "not":
            found[word] = article_condition(test, rules)
        elif isinstance(test, Mapping):
            unknown = [t for t in test if t not in _CONDITION_WORDS]
            if unknown:
                raise ValueError(f"column {name!r}: no tests {unknown}; there are {[*_CONDITION_WORDS]}")
            tests = {_CONDITION_WORDS[t]: value for t, value in test.items()}
            for listed in {"in", "not_in"} & tests.keys():
                tests[listed] = allowed_values(rules, tests[listed])
            found[name] = tests
        else:
            found[name] = test
    return found


def article_rules(
    rules: Mapping[str, Any],
    config: Mapping[str, Any] | None = None,
    *,
    order_by: Mapping[str, Sequence[Any]] | None = None,
    keys: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, Any]:
    """Suite rules from a parsed rule file for article master data, in its German keys.

    The German keys below are fixed values: they are the format of that file. ``config``
    holds the on/off flags: ``normalization.check_1nf`` and those under ``extra_checks``.
    Checks whose flag is absent or false are left out; without a ``config``, every check
    the rules name is kept.

    Tables have no row order: ``order_by`` says per table which row of a key is the first;
    without it ties are broken on all columns, nulls first. ``keys`` names, per table, the
    columns that stand for a row where its cells are flagged.
    """
    order_by, row_keys = dict(order_by or {}), dict(keys or {})

    def flag(group: str, name: str) -> bool:
        return config is None or bool(config.get(group, {}).get(name))

    def vocabularies(block: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
        return [
            {
                "table": check["tabelle"],
                "column": check["spalte"],
                "allowed": allowed_values(rules, check["gueltige_werte"]),
            }
            for check in block
        ]

    suite: dict[str, Any] = {"overview": True}
    if "pflichtfelder" in rules:
        suite["completeness"] = dict(rules["pflichtfelder"])
    if "eindeutigkeit_felder" in rules:
        suite["uniqueness"] = dict(rules["eindeutigkeit_felder"])
    limits = rules.get("schwellenwerte", {})
    if "konsistenz_masse" in rules:
        block = rules["konsistenz_masse"]
        parent, child = block["tabellen"]["grund"], block["tabellen"]["werk"]
        keys = list(block["join_key"])
        suite["pair_consistency"] = {
            "parent": parent,
            "child": child,
            "keys": keys,
            "pairs": [(pair["grund"], pair["werk"]) for pair in block["vergleichspaare"]],
            "max_deviation": limits["konsistenz_abweichung_max"],
            "order_by": list(order_by.get(child, ())),
        }
        row_keys.setdefault(child, keys)
        suite["key_conflicts"] = {"table": child, "keys": keys}
        if flag("extra_checks", "artikel_ohne_werksdaten"):
            suite["missing_children"] = {"parent": parent, "child": child, "keys": keys}
    if "konsistenz_einheit_masse" in rules:
        suite["unit_consistency"] = vocabularies(rules["konsistenz_einheit_masse"])
    if "preisvalidierung" in rules:
        block = rules["preisvalidierung"]
        suite["price_validity"] = {
            "table": block["tabelle"],
            "price": block["uvp_spalte"],
            "currency": block["waehrung_spalte"],
            "sentinels": block["sentinel_werte"],
            "low": limits["preis_min"],
            "high": limits["preis_max"],
            "currencies": allowed_values(rules, block["gueltige_werte"]),
        }
    if "referenzintegritaet" in rules:
        suite["referential_integrity"] = [
            {
                "table": rule["tabelle"],
                "column": rule["spalte"],
                "parent": rule["referenz_tabelle"],
                "parent_column": rule["referenz_spalte"],
            }
            for rule in rules["referenzintegritaet"]
        ]
    if "plausibilitaet_masse" in rules and flag("extra_checks", "plausibilitaet_masse"):
        suite["plausible_range"] = [
            {
                "table": check["tabelle"],
                "columns": check["spalten"],
                "maximum": check.get("implausibel_max"),
            }
            for check in rules["plausibilitaet_masse"]
        ]
    if "gtin_check" in rules and flag("extra_checks", "gtin_format"):
        block = rules["gtin_check"]
        suite["identifier_format"] = {
            "table": block["tabelle"],
            "column": block["spalte"],
            "length": block["laenge"],
            "sentinels": block.get("sentinel_werte", []),
        }
        if block.get("pruefziffer"):
            suite["check_digits"] = dict(suite["identifier_format"])
    if "schluesselformat" in rules:
        suite["key_format"] = [
            {"table": check["tabelle"], "column": check["spalte"], "pattern": check["muster"]}
            for check in rules["schluesselformat"]
        ]
    if "feldabhaengigkeiten" in rules:
        suite["implications"] = [
            {
                "name": rule["name"],
                "table": rule["tabelle"],
                "if": article_condition(rule["wenn"], rules),
                "then": article_condition(rule["dann"], rules),
                "missing": "skip" if rule.get("fehlend") == "auslassen" else "violation",
            }
            for rule in rules["feldabhaengigkeiten"]
        ]
    if "vollstaendigkeit_min" in limits:
        suite["thresholds"] = [
            {"check": "completeness", "metric": "completeness", "min": limits["vollstaendigkeit_min"]}
        ]
    if "validitaet_vokabular" in rules and flag("extra_checks", "validitaet_vokabular"):
        suite["vocabulary_validity"] = vocabularies(rules["validitaet_vokabular"])
    if "atomicity_delimiters" in rules and flag("normalization", "check_1nf"):
        suite["atomicity"] = {"delimiters": rules["atomicity_delimiters"], "keys": row_keys}
    return suite
