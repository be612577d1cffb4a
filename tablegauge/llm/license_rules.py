"""Signature rules of licences: names and versions below, times the phrases that name them.

Rules are matched over words in lower case, with runs of anything else as one space. A rule is
(label, kind, keywords, pattern): only texts that hold all keywords are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

BASE, MENTION, TITLE, GRANT, SENTENCE, IDENTIFIER = "base", "mention", "title", "grant", "sentence", "identifier"

# How much a kind says: what a stronger kind covers is left out; and how likely it is right.
PRIORITY = {IDENTIFIER: 5, SENTENCE: 4, GRANT: 3, TITLE: 2, MENTION: 1, BASE: 0}
CONFIDENCE = {IDENTIFIER: 0.99, SENTENCE: 0.95, GRANT: 0.9, TITLE: 0.7, MENTION: 0.4, BASE: 0.5}


class Rule(NamedTuple):
    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str  # a space stands for a break between words


# Phrases and labels of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

L = "licen[cs]e"
# Label, keywords, name, versions. The label of a version is <label>-<version>.
VERSIONED = [
    ("gpl", "gnu general", f"gnu general public {L}", "1.0 2.0 3.0"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "general public", f"(?:gnu )?(?:lesser|library) general public {L}", "2.0 2.1 3.0"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero", f"(?:gnu )?affero general public {L}", "1.0 3.0"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {L}", "1.1 1.2 1.3"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl", "1.1 1.2 1.3"),
    ("apache", "apache licen", f"apache (?:software )?{L}", "1.0 1.1 2.0"),
    ("mpl", "mozilla", f"mozilla public {L}", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", f"eclipse public {L}", "1.0 2.0"),
    ("cddl", "common development", f"common development and distribution {L}", "1.0 1.1"),
    ("cpl", "common public", f"common public {L}", "1.0"),
    ("ipl", "ibm public", f"ibm public {L}", "1.0"),
    ("osl", "open software", f"open software {L}", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free", f"academic free {L}", "1.1 1.2 2.0 2.1 3.0"),
    ("eupl", "european union", f"european union public {L}", "1.0 1.1 1.2"),
    ("artistic", "artistic", f"artistic {L}", "1.0 2.0"),
    ("bsl", "boost", f"boost software {L}", "1.0"),
    ("ofl", "font", f"(?:sil )?open font {L}", "1.0 1.1"),
    ("zpl", "zope", f"zope public {L}", "1.1 2.0 2.1"),
    ("php", "php", f"php {L}", "3.0 3.01"),
    ("lppl", "latex", f"latex project public {L}", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill", f"cecill(?: free software)?(?: {L})?(?: agreement)?", "1.0 1.1 2.0 2.1"),
    ("upl", "universal permissive", f"universal permissive {L}", "1.0"),
    ("ecl", "educational community", f"educational community {L}", "1.0 2.0"),
    ("apsl", "apple public", f"apple public source {L}", "1.0 1.1 1.2 2.0"),
    ("npl", "netscape", f"netscape public {L}", "1.0 1.1"),
    ("qpl", "public", f"q public {L}", "1.0"),
    ("rpl", "reciprocal", f"reciprocal public {L}", "1.1 1.5"),
    ("ms-pl", "microsoft public", f"microsoft public {L}", ""),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {L}", ""),
    ("elastic", "elastic", f"elastic {L}", "2.0"),
    ("sspl", "server side", f"server side public {L}", "1.0"),
    ("busl", "business source", f"business source {L}", "1.0 1.1"),
    ("polyform-noncommercial", "polyform", f"polyform noncommercial {L}", "1.0.0"),
    ("mulan-psl", "mulan", f"mulan permissive software {L}", "1.0 2.0"),
    ("odbl", "open database", f"open database {L}", "1.0"),
    ("odc-by", "open data", f"open data commons attribution {L}", "1.0"),
    ("pddl", "domain", f"(?:open data commons )?public domain dedication and {L}", "1.0"),
    ("cdla-permissive", "community data", f"community data {L} agreement permissive", "1.0 2.0"),
    ("cdla-sharing", "community data", f"community data {L} agreement sharing", "1.0"),
    ("openrail-m", "openrail", f"(?:creativeml )?openrail(?: )?m(?: {L})?", ""),
    ("mit", "mit licen", f"mit {L}", ""),
    ("mit", "expat", f"expat {L}", ""),
    ("mit-0", "attribution", f"mit no attribution(?: {L})?", ""),
    ("bsd", "bsd", f"bsd(?: style)? {L}", ""),
    ("bsd-2-clause", "bsd", f"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?", ""),
    ("bsd-3-clause", "bsd", f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?", ""),
    ("bsd-4-clause", "bsd", f"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {L})?", ""),
    ("0bsd", "bsd", f"(?:0bsd|zero clause bsd)(?: {L})?", ""),
    ("isc", "isc", f"isc {L}", ""),
    ("zlib", "zlib", f"zlib(?: libpng)? {L}", ""),
    ("libpng", "libpng", f"libpng {L}", ""),
    ("unlicense", "unlicen", "(?:the )?unlicen[cs]e", ""),
    ("wtfpl", "wtfpl", "wtfpl", "2.0"),
    ("ncsa", "illinois", f"university of illinois(?: ncsa)?(?: open source)? {L}", ""),
    ("postgresql", "postgresql", f"postgresql {L}", ""),
    ("python", "python", f"python(?: software foundation)? {L}", "2.0"),
    ("openssl", "openssl", f"openssl {L}", ""),
    ("ruby", "ruby", f"ruby {L}", ""),
    ("x11", "x11", f"x11 {L}", ""),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {L}", ""),
    ("json", "json", f"json {L}", ""),
    ("curl", "curl", f"curl {L}", ""),
    ("ftl", "freetype", f"freetype(?: project)? {L}", ""),
    ("ijg", "jpeg", f"independent jpeg group {L}", ""),
    ("imagemagick", "imagemagick", f"imagemagick {L}", ""),
    ("unicode", "unicode", f"unicode(?: terms of use| {L})", ""),
    ("vim", "vim", f"vim {L}", ""),
    ("beerware", "beer", f"beer(?: )?ware(?: {L})?", "42"),
    ("hippocratic", "hippocratic", f"hippocratic {L}", "2.1"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", ""),
]
# The parts of Creative Commons licences, in short and in words.
COMMONS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
# Sentences of the licences themselves.
SENTENCES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of [^ ]+(?: [^ ]+){0,12} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl-2.0", "free software", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "free software", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "free software", "lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl-3.0", "affero", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", "do what the (?:fuck|f[^ ]*) you want to public licen[cs]e"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("cc0-1.0", "waiv", "has (?:dedicated the work to the public domain by waiving|waived all copyright)"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "prior written", "without (?:the )?(?:express )?prior written (?:permission|consent)"),
]
GRANTS = (
    "(?:re)?(?:licen[cs]ed|released|distributed|available|published|provided|covered|shared|governed)"
    " (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
)
SPDX = f"spdx {L} identifier"


def _version(version: str) -> str:
    """A version in words: its trailing zeros may be left out."""
    parts = version.split(".")
    while len(parts) > 1 and parts[-1] == "0":
        parts.pop()
    dropped = version.count(".") + 1 - len(parts)
    return f"(?: {L})?(?: version| ver)?(?: v)? ?v?" + " ".join(parts) + "(?: 0)?" * dropped


def _words(label: str) -> str:
    return label.replace("-", " ").replace(".", " ")


def _signatures(label: str, keywords: str, name: str, versions: str) -> Iterator[Rule]:
    keys = tuple(keywords.split())
    later = "(?: only| or(?: at your option)?(?: any)? later(?: version)?)?"
    for version in versions.split():
        full = f"{label}-{version}"
        yield Rule(full, GRANT, keys, GRANTS + name + _version(version) + later)
        yield Rule(full, TITLE, keys, name + _version(version) + later)
    yield Rule(label, GRANT, keys, GRANTS + name)
    yield Rule(label, MENTION, keys, name)


def rules() -> list[Rule]:
    """All rules: the stronger kinds first, each kind in the order of its tables."""
    found = [Rule(label, BASE, tuple(phrase.split()), phrase) for phrase, label in BASE_PHRASES.items()]
    labels: dict[str, None] = {}
    for label, keywords, name, versions in VERSIONED:
        found += _signatures(label, keywords, name, versions)
        labels |= dict.fromkeys([f"{label}-{v}" for v in versions.split()] or [label])
    for short, words in COMMONS.items():
        found += _signatures(f"cc-{short}", "cc by", f"cc {_words(short)}", COMMONS_VERSIONS)
        found += _signatures(f"cc-{short}", "creative commons", f"creative commons {words}(?: {L})?", COMMONS_VERSIONS)
        found += _signatures(f"cc-{short}", "creativecommons", f"creativecommons org licenses {_words(short)}", COMMONS_VERSIONS)
        labels |= dict.fromkeys(f"cc-{short}-{v}" for v in COMMONS_VERSIONS.split())
    found += _signatures("cc0", "cc0", "cc0", "1.0")
    labels["cc0-1.0"] = None
    later = "(?: only| or later)?"
    found += [Rule(label, IDENTIFIER, ("spdx",), f"{SPDX} {_words(label)}{later}") for label in labels]
    found += [Rule(label, SENTENCE, tuple(keys.split()), text) for label, keys, text in SENTENCES]
    return sorted(found, key=lambda r: -PRIORITY[r.kind])
