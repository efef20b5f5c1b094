"""Scalar functions: case tables, and differential tests against the standard library."""

import html
import random
import re
import unicodedata
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.functions import keys, text
from postmill.functions.urls import normalize_url


def apply(spark, fn, values, *more):
    rows = [(i, *row) if isinstance(row, tuple) else (i, row) for i, row in enumerate(values)]
    n = len(rows[0]) - 1
    schema = "i int, " + ", ".join(f"c{k} string" for k in range(n))
    df = spark.createDataFrame(rows, schema)
    out = df.select("i", fn(*[F.col(f"c{k}") for k in range(n)]).alias("r")).collect()
    return [r.r for r in sorted(out, key=lambda r: r.i)]


def random_strings(n, alphabet, seed, longest=24):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


UNICODE = (
    list("abcXYZ 019-_/&%+.") + list("éüñçøßŁıİ") + ["ﬁ", "™", "½", "Å", "①", "ａ", "🄐", "𝔸", "🆐", "中", "́", "한", "…"]
)


def test_fold_ascii_equals_unicode_database(spark):
    values = random_strings(300, UNICODE, 1) + [chr(c) * 2 for c in range(0x80, 0x3000, 7)]
    expected = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert apply(spark, text.fold_ascii, values) == expected


def test_strip_tags_equals_html_unescape(spark):
    pieces = ["<b>", "</p>", "<a href='x'>", "&amp;", "&lt;i&gt;", "&nbsp;", "&#39;", "&#x2014;", "&copy", "&notanentity;", "a", " ", "\n", "é", "<", "&"]
    values = random_strings(300, pieces, 2)
    expected = [html.unescape(re.sub(r"<[^>]+>", " ", v)).strip() for v in values]
    assert apply(spark, text.strip_tags, values) == expected


def test_strip_tags_comes_back_done(spark, monkeypatch):
    """Texts with references are stripped where these are resolved, and Python spells out no `&amp;`."""
    values = ["<p>a &amp; b</p>", "&amp;lt; &amp;amp;", "\u2003<i>&amp;\x1f", "&&amp;amp;", "<a href='?x=1&y'>&nbsp;b", "& &ampx", None, "<br> c\xa0", "", "&"]
    expected = [v if v is None else html.unescape(re.sub(r"<[^>]+>", " ", v)).strip() for v in values]
    assert apply(spark, text.strip_tags, values) == expected
    spelled = []
    monkeypatch.setattr(text.html, "unescape", lambda value: spelled.append(value) or "")
    text.resolve.func(pa.array(["<p>a &amp; b</p>", None, "&amp;&amp;amp;"]))
    assert spelled == []
    text.resolve.func(pa.array(["<p>a &amp; &lt;</p>", None]))
    assert spelled == [" a &amp; &lt; "]


def test_strip_tags_of_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT cast(unhex('3C623E61FF26616D703B') AS string) AS c")
    assert [r[0] for r in df.select(text.strip_tags(F.col("c"))).collect()] == ["a\ufffd&"]


def test_strip_and_line_ends(spark):
    values = [c + "x y" + c for c in text.SPACE] + ["", " ", "​x"]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]
    assert {c for c in map(chr, range(0x3001)) if c.isspace()} == set(text.SPACE)
    lines = "a\rb\r\nc\x0bd\x1ce\x85f g\n\nh"
    assert apply(spark, lambda c: F.split(c, text.LINE_END), [lines])[0] == lines.splitlines()


def test_whole_words_equal_python_word_rules(spark):
    values = random_strings(400, ["c++", "c/c++", "mis", "api", " ", "-", "x", "é", "_", "2", "(", "中"], 3, 8)
    for word in ("c++", "c/c++", "mis", "api"):
        expected = [bool(re.search(r"(?<!\w)" + re.escape(word) + r"(?!\w)", v)) for v in values]
        assert apply(spark, lambda c: text.has_word(c, word), values) == expected


def test_title_case(spark):
    values = ["acme", "acme-labs", "3m", "a1b2", "o'neil", "x_y z", "ÉCOLE"]
    assert apply(spark, text.title_case, values) == [v.title() for v in values]


@pytest.mark.parametrize("title,yes", [
    ("Plant Co-Op, Fall", True), ("Factory Coop", True), ("INTERN", True), ("Design internship", True),
    ("International Trade Analyst", False), ("Internal Auditor", False), ("co op", False), ("éintern", False),
])
def test_internship_predicate(spark, title, yes):
    assert apply(spark, text.is_internship, [title]) == [yes]


@pytest.mark.parametrize("a,b,same", [
    ("Plant Engineer Intern (Req#55012)", "Plant Engineer Intern", True),
    ("Plant Engineering Intern - Fall 2027", "Plant Engineering Intern", True),
    ("Welding Intern [Remote]", "Welding Intern", True),
    ("Intern, Plant Design", "Plant Design Intern", True),
    ("Plant Design Co-Op", "Plant Design Internship", True),
    ("Plant Intern (Summer 2031)", "Plant Intern", True),
    ("Plant Engineer Intern", "Field Engineer Intern", False),
    ("Plant Intern I", "Plant Intern II", False),
    ("Plant (North) Intern", "Plant (South) Intern", False),
])
def test_title_pairs(spark, a, b, same):
    left, right = apply(spark, keys.normalize_title, [a, b])
    assert (left == right) is same


def test_title_details(spark):
    got = apply(spark, keys.normalize_title, ["R&D Intern", "R & D Intern", "Intern - JR-12345", None, "", "x2019y co op"])
    assert got == ["intern-randd", "d-intern-r", "intern", "", "", "intern-x-y"]


def test_company_keys(spark):
    values = ["Borealis, Inc.", "BOREALIS", "The Borealis Company", "Borealis Technologies LLC", "Borealis Labs, Inc.",
              "Borealis Robotics", "Inc", "The ", "Co Co Co", "Café Zürich GmbH", None, "  the Borealis"]
    assert apply(spark, keys.normalize_company, values) == [
        "borealis"] * 5 + ["borealisrobotics", "inc", "the", "co", "cafezurich", "", "borealis"]


def test_location_keys(spark):
    values = ["Reno, Nevada", "Reno, NV", "Remote", "Hybrid / remote-first", "", None, "  ,  , ", "Nevada",
              "St. Louis,  Missouri", "New York, New York", "Zürich", "Nevada, Reno"]
    assert apply(spark, keys.normalize_location, values) == [
        "reno-nv", "reno-nv", "remote", "remote", "", "", "", "nv", "st-louis-mo", "new-york-ny", "zurich", "nevada-reno"]


def test_fingerprint_keeps_cities_apart(spark):
    got = apply(spark, keys.fingerprint, [("Vale, Inc.", "Civil Intern", "Reno, NV"), ("Vale", "Civil Intern", "Elko, NV")])
    assert got == ["vale|civil-intern|reno-nv", "vale|civil-intern|elko-nv"]


def test_source_priority(spark):
    values = ["Greenhouse/x", "lever/y", "org/repo", "GitHub", "Adzuna", "adzuna/z", "other", "", None]
    assert apply(spark, keys.source_priority, values) == [0, 0, 1, 1, 2, 1, 1, 1, 1]


URLS = [
    "https://WWW.Ads.example.com/land/7?se=aB-9&utm_medium=api&UTM_source=q&v=F0",
    "HTTPS://www.Example.org/Path/", "https://example.org/", "https://example.org", "", None, "not a url", "::::", "   ",
    "https://e.org/a?b=2&a=1&a=0&&c", "https://e.org/a?x=1#frag", "//host/p", "mailto:a@b.c", "http:///x", "file:/etc",
    "https://e.org/a b?q=x+y&z=%zz&p=100%&t=~*é", "http://[::1]/x?", "http://[::1/x", "http://[zz]/x", "http://[v1.a]/",
    "http://[1:2:3:4:5:6:7:8]/", "http://[1::2:3:4:5:6:7:8]/", "http://[::ffff:1.2.3.4]/", "http://[1.2.3.4]/", "http://a℀b/x/",
    "\thttp://x.y/\nz", "1a:b", "a:b/", "https://e.org//", "https:?a=1", "http://www.www.x/", "x?se=1", "http://h?SE=2&Utm_x=3",
]


def python_url_steps(url):
    """Independent restatement with the standard library, used as the oracle."""
    if not url:
        return url
    try:
        split = urlsplit(url)
    except ValueError:
        return url
    from urllib.parse import urlencode
    query = urlencode(sorted(
        pair for pair in parse_qsl(split.query, keep_blank_values=True)
        if pair[0].lower() != "se" and not pair[0].lower().startswith("utm_")
    ))
    path = split.path[:-1] if len(split.path) > 1 and split.path[-1] == "/" else split.path
    return split._replace(
        scheme=split.scheme.lower(), netloc=split.netloc.lower().removeprefix("www."), path=path, query=query, fragment=""
    ).geturl()


def test_normalize_url_equals_standard_library(spark):
    alphabet = ["http", "https", ":", "//", "www.", "Ex", ".org", "/", "?", "#", "&", "=", "se", "utm_a", "%20", "%", "+", "~", "*", "é", "[", "]", " ", "@", "q"]
    values = URLS + random_strings(600, alphabet, 4, 12)
    got = apply(spark, normalize_url, values)
    assert got == [python_url_steps(v) for v in values]
    # Idempotence holds for well-formed URLs (the reader's input).
    for value in (v for v, g in zip(URLS, got) if g and g.startswith("http")):
        once = got[URLS.index(value)]
        assert apply(spark, normalize_url, [once]) == [python_url_steps(once)]


def test_area_location(spark):
    cases = [
        (["US", "Nevada", "Washoe County", "Reno"], "x", "Reno, NV"),
        (["US", "Louisiana", "Caddo Parish", "Shreveport"], "x", "Shreveport, LA"),
        (["US", "Nevada", "Washoe County"], "x", "NV"),
        (["US", "Alaska", "Sitka Borough"], "x", "AK"),
        (["US", "New York", "New York"], "x", "NY"),
        (["US", "District of Columbia", "Washington"], "x", "Washington, DC"),
        (["US", "Ohio"], "x", "OH"), (["UK", "Kent", "Dover"], "x", "Dover, KENT"),
        (["US"], "US", "US"), ([], "", ""), (None, None, ""),
    ]
    df = spark.createDataFrame([(i, a, d) for i, (a, d, _) in enumerate(cases)], "i int, a array<string>, d string")
    out = df.select("i", keys.format_area_location(F.col("a"), F.col("d")).alias("r")).orderBy("i").collect()
    assert [r.r for r in out] == [c[2] for c in cases]


def test_lists_links_defaults(spark):
    assert apply(spark, text.split_list, ["a,,b", "", None]) == [["a", "b"], [], []]
    cells = ["**[*Vale*](http://v)**", "none", "[a](b) [c](d)", "[ ** x ](y)"]
    assert apply(spark, text.link_text, cells) == ["Vale", "", "a", "x"]
    assert apply(spark, text.link_url, cells) == ["http://v", "", "b", "y"]
    assert apply(spark, lambda c: text.default_if_empty(c, "N/A"), ["", None, "z"]) == ["N/A", "N/A", "z"]
    assert apply(spark, lambda c: text.truncate(c, 2), ["éèx"]) == ["éè"]
