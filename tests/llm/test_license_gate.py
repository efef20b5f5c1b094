"""The keyword gate of the license scan against all regexes, on texts made from every alternative."""

import re
from re import _constants as ops
from re import _parser

import pytest

from postmill.llm import licenses


def written(parsed) -> list[str]:
    """All strings of a pattern of literals, sets, groups, alternatives and optional parts."""
    texts = [""]
    for op, value in parsed:
        if op is ops.LITERAL:
            ways = [chr(value)]
        elif op is ops.IN:
            ways = [chr(v) for _, v in value]
        elif op is ops.BRANCH:
            ways = [w for branch in value[1] for w in written(branch)]
        elif op is ops.SUBPATTERN:
            ways = written(value[3])
        else:
            assert op is ops.MAX_REPEAT and value[:2] == (0, 1)
            ways = ["", *written(value[2])]
        texts = [t + w for t in texts for w in ways]
    return texts


RULES = licenses.rules()
WRITTEN = {rule: list(dict.fromkeys(written(_parser.parse(rule.pattern)))) for rule in RULES}


def test_each_possible_match_has_a_keyword():
    for rule, texts in WRITTEN.items():
        for text in texts:
            assert re.fullmatch(rule.pattern, text)
            assert any(f" {word} " in f" {text} " for word in rule.keywords), (rule.label, text)


def test_gated_scan_equals_all_regexes():
    assert len(RULES) == 344
    every = [(rule, re.compile(rf"(?<= )(?:{rule.pattern})(?= )")) for rule in RULES]
    # Of the texts of a rule that differ in nothing but a number's and a license's spelling, one is enough here.
    lines = {re.sub("licence", "license", t).replace(" v ", " v") for texts in WRITTEN.values() for t in texts}
    lines = [f" some {t} words " for t in sorted(lines)]
    for k in range(0, len(lines), 50):
        line = " ".join(lines[k : k + 50]).replace("  ", " ")
        found = [licenses.Detection(*m.span(), rule) for rule, regex in every for m in regex.finditer(line)]
        assert licenses.scanner().detect(line) == licenses.resolve(found)
    for line in lines[::40]:  # alone, so that no other text opens a rule
        found = [licenses.Detection(*m.span(), rule) for rule, regex in every for m in regex.finditer(line)]
        assert found and licenses.scanner().detect(line) == licenses.resolve(found)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("X11 license", "mit"), ("Expat license", "mit"), ("SPDX-License-Identifier: X11", "mit"),
        ("Berkeley Software Distribution license", "bsd"), ("the 3-clause license", "bsd-3-clause"),
        ("Internet Systems Consortium license", "isc"), ("PSF license", "python"), ("GNU FDL 1.2 license", "gfdl-1.2"),
        ("SPDX-License-Identifier: PSF-2.0", "python-2.0"), ("CC Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "boost"),
        ("the 3-clause Berkeley Software Distribution license", "bsd-3-clause"),
    ],
)
def test_names_without_the_label_in_them(text, label):
    assert label in licenses.scan_text(text)["labels"]
