"""License scans: ordered signature rules over normalised words.

Texts become their lower-cased words, joined by single blanks. One automaton
over the keywords of all rules decides which rules can match at all; only those
regexes run. Detections of overlapping text are resolved by priority: a
detection inside one of a higher priority, or inside a longer one of the same
priority, is suppressed.

Defined results: null or empty text has no words and no detection, score 0;
rows are judged one by one, so ties, repeated rows and the order of rows don't
matter; an empty table gives no rows; other columns are kept, whatever their
names, except the struct `licenses`.
"""

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from postmill.llm.text import as_before, beside_text, plain_words, slices

#: Phrases that are reported wherever their words stand together.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label stem -> (keywords, how the name is written, versions). Fixed values.
#: Every way to write the name has one of the keywords, as whole words.
FAMILIES = {
    "mit": ("mit|expat|x11", "mit(?: x11)?|expat|x11", ()),
    "apache": ("apache", "apache(?: software)?", ("1.0", "1.1", "2.0")),
    "gpl": ("gpl|general public", "gnu gpl|gpl|gnu general public|general public", ("1.0", "2.0", "3.0")),
    "lgpl": ("lgpl|lesser general|library general", "gnu lgpl|lgpl|gnu lesser general public|lesser general public|library general public", ("2.0", "2.1", "3.0")),
    "agpl": ("agpl|affero", "gnu agpl|agpl|gnu affero general public|affero general public", ("1.0", "3.0")),
    "bsd": ("bsd|berkeley software", "bsd|berkeley software distribution", ("1", "2", "3", "4")),
    "mpl": ("mpl|mozilla", "mpl|mozilla public", ("1.0", "1.1", "2.0")),
    "epl": ("epl|eclipse", "epl|eclipse public", ("1.0", "2.0")),
    "eupl": ("eupl|european union", "eupl|european union public", ("1.0", "1.1", "1.2")),
    "cddl": ("cddl|common development", "cddl|common development and distribution", ("1.0", "1.1")),
    "artistic": ("artistic", "(?:perl )?artistic", ("1.0", "2.0")),
    "osl": ("osl|open software", "osl|open software", ("1.0", "2.0", "2.1", "3.0")),
    "afl": ("afl|academic free", "afl|academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "gfdl": ("gnu fdl|gfdl|free documentation", "gnu fdl|gfdl|gnu free documentation|free documentation", ("1.1", "1.2", "1.3")),
    "zlib": ("zlib", "zlib(?: libpng)?", ()),
    "isc": ("isc|internet systems", "isc|internet systems consortium", ()),
    "boost": ("bsl|boost", "bsl|boost software", ("1.0",)),
    "unlicense": ("unlicense", "unlicense", ()),
    "wtfpl": ("wtfpl", "wtfpl", ("1.0", "2.0")),
    "cecill": ("cecill", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    "python": ("python software|psf", "python software foundation|psf", ("2.0",)),
    "openssl": ("openssl", "openssl", ()),
    "postgresql": ("postgresql", "postgresql", ()),
    "ofl": ("ofl|open font", "sil ofl|ofl|sil open font|open font", ("1.0", "1.1")),
    "odbl": ("odbl|open database", "odbl|open database", ("1.0",)),
}
#: Creative Commons clauses: label -> how they are written.
CLAUSES = {
    "by": "by|attribution",
    "by-sa": "by sa|attribution share ?alike",
    "by-nc": "by nc|attribution non ?commercial",
    "by-nd": "by nd|attribution no ?deriv(?:ative)?s(?: works)?",
    "by-nc-sa": "by nc sa|attribution non ?commercial share ?alike",
    "by-nc-nd": "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences of license texts: label -> (keyword, which is part of the wording, wording).
SENTENCES = {
    "mit": ("free of charge to any", "permission is hereby granted free of charge to any person obtaining a copy"),
    "isc": ("with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    "bsd": ("source and binary forms", "redistribution and use in source and binary forms with or without modification"),
    "zlib": ("as is without any express", "this software is provided as is without any express or implied warranty"),
    "unlicense": ("into the public domain", "free and unencumbered software released into the public domain"),
    "boost": ("person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    "gpl": ("redistribute it", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
}


@dataclass(frozen=True)
class Rule:
    """`weight`: how sure a match makes of the label, 0 to 1. Each possible match has one of the keywords as whole words."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules, highest priority first."""
    made = [Rule(label, text, (word,), 5, 0.95) for label, (word, text) in SENTENCES.items()]
    for stem, (keys, name, versions) in FAMILIES.items():
        keywords = tuple(keys.split("|"))
        for version in versions:
            major, _, minor = version.partition(".")
            number = f"(?:version |v ?)?{major}" + (f" {minor}" if minor not in ("", "0") else "(?: 0)?")
            clause = f"|{major} clauses?(?: (?:{name}))?" if stem == "bsd" else ""
            clauses = ("clause", "clauses") if clause else ()
            label = f"{stem}-{version}" + ("-clause" if stem == "bsd" else "")
            made += [
                Rule(label, f"spdx license identifier (?:{name}) {number}(?: clause)?(?: only| or later)?", keywords, 4, 0.99),
                Rule(label, f"(?:(?:{name})(?: licen[cs]e)? {number}(?: clause)?{clause})(?: licen[cs]e)", keywords + clauses, 3, 0.9),
                Rule(label, f"(?:{name}) licen[cs]e (?:version |v ?){number}(?: or (?:any )?later)?", keywords, 3, 0.9),
                Rule(label, f"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)? {number}", keywords, 3, 0.9),
            ]
        made += [
            Rule(stem, f"spdx license identifier (?:{name})", keywords, 2, 0.9),
            Rule(stem, f"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?", keywords, 2, 0.8),
            Rule(stem, f"(?:under|see|of) (?:the |an )?(?:{name}) licen[cs]e", keywords, 1, 0.7),
            Rule(stem, f"(?:{name}) licen[cs]e", keywords, 0, 0.6),
        ]
    for clause, written in CLAUSES.items():
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            made += [
                Rule(f"cc-{clause}-{version}", f"(?:cc|creative commons) (?:{written}) {number}", ("cc by", "cc attribution", "creative commons"), 4, 0.95),
            ]
        made.append(Rule(f"cc-{clause}", f"(?:cc|creative commons) (?:{written})", ("cc by", "cc attribution", "creative commons"), 1, 0.7))
    made.append(Rule("cc0", "cc0|creative commons zero", ("cc0", "creative commons"), 4, 0.9))
    return sorted(made, key=lambda r: -r.priority)


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


class Scanner:
    def __init__(self):
        self.rules = [(r, re.compile(rf"(?<= )(?:{r.pattern})(?= )")) for r in rules()]
        gated: dict[str, list[int]] = {}
        for k, (rule, _) in enumerate(self.rules):
            for word in rule.keywords:
                gated.setdefault(word, []).append(k)
        self.gate = ahocorasick.Automaton()
        for word, numbers in gated.items():
            self.gate.add_word(f" {word} ", numbers)
        self.gate.make_automaton()

    def detect(self, line: str) -> list[Detection]:
        """`line`: words with a blank before, between and after them."""
        open_rules = {k for _, numbers in self.gate.iter(line) for k in numbers}
        found = [
            Detection(*m.span(), rule)
            for rule, regex in (self.rules[k] for k in sorted(open_rules))
            for m in regex.finditer(line)
        ]
        return resolve(found)


def resolve(found: list[Detection]) -> list[Detection]:
    """Without those contained in one that ranks before: higher priority, then longer, then earlier rule.

    Kept intervals of the ranks so far that lie in no other are disjoint in
    their order by start and by end, so one look-up finds a container.
    """
    from bisect import bisect_right, insort

    kept: list[Detection] = []
    hull: list[tuple[int, int]] = []  # (start, end), both rising
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label)):
        k = bisect_right(hull, (d.start, float("inf"))) - 1
        if k >= 0 and hull[k][1] >= d.end:
            continue
        kept.append(d)
        first = bisect_right(hull, (d.start, -1))
        past = first
        while past < len(hull) and hull[past][1] <= d.end:
            past += 1
        del hull[first:past]
        insort(hull, (d.start, d.end))
    return sorted(kept, key=lambda d: (d.start, d.end))


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def phrase_places(line: str) -> list[tuple[int, str]]:
    """(position of the blank before, label) of each place of a phrase."""
    places = []
    for phrase, label in PHRASES.items():
        at = line.find(f" {phrase} ")
        while at >= 0:
            places.append((at, label))
            at = line.find(f" {phrase} ", at + 1)
    return sorted(places)


RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>,"
    " labels array<string>, score double,"
    " detections array<struct<label:string,priority:int,first_word:bigint,n_words:bigint>>"
)


def scan_text(text: str | None) -> dict:
    found = plain_words(text)
    line = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    places = phrase_places(line)
    detections = scanner().detect(line)
    base = sorted({label for _, label in places})
    # Places of the blanks, so that a detection's words are found by binary search.
    blanks = [k for k, c in enumerate(line) if c == " "] if places or detections else []
    doubt = 1.0
    for weight in {d.rule.label: d.rule.weight for d in detections}.values():
        doubt *= 1 - weight
    if base and not detections:
        doubt = 0.5
    return {
        "n_words": len(found),
        "n_base": len(places),
        "first_word": bisect_left(blanks, places[0][0]) if places else None,
        "last_word": bisect_left(blanks, places[-1][0]) if places else None,
        "base_labels": base,
        "labels": sorted({*base, *(d.rule.label for d in detections)}),
        "score": round(1 - doubt, 6),
        "detections": [
            {
                "label": d.rule.label,
                "priority": d.rule.priority,
                "first_word": bisect_left(blanks, d.start - 1),
                "n_words": bisect_left(blanks, d.end) - bisect_left(blanks, d.start) + 1,
            }
            for d in detections
        ],
    }


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with the struct `licenses`: counts, labels, score and the detections with their words."""
    kept = beside_text(docs, "licenses")
    out = T.StructType([*kept.schema.fields, T.StructField("licenses", T.StructType.fromDDL(RESULT))])
    arrow = to_arrow_type(out.fields[-1].dataType)

    def scan_batches(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [scan_text(text) for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, "licenses"])

    return as_before(kept.mapInArrow(scan_batches, out), docs, "licenses")
