"""Canonical keys for company, title, location; fingerprint; source priority."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.dims import state_map
from postmill.functions.text import fold_ascii, let, strip, text_or_empty
from postmill.functions.urls import normalize_url

# --- Fixed values. ----------------------------------------------------------
LEGAL_SUFFIXES = [
    "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company",
    "plc", "gmbh", "ag", "sa", "nv", "holdings", "group", "technologies",
    "technology", "labs",
]
TITLE_STOP_WORDS = [
    "the", "a", "an", "of", "and", "for", "in", "at", "to", "on", "with",
    "our", "us", "usa", "united", "states", "remote", "hybrid", "onsite",
    "student", "students", "paid", "opportunity", "program", "position",
    "role", "hiring", "now", "full", "time", "parttime",
]
TITLE_BRACKETS = "()[]"
TITLE_RULES = [
    (r"(?<!\w)(?:req|job|jr|r)?[-#_]?\d{4,}(?!\w)", " "),
    (r"(19|20)\d{2}", " "),
    (r"\b(summer|fall|autumn|winter|spring)\b", " "),
    (r"\b(internship|intern)\b", "intern"),
    (r"\b(co-op|coop|co op)\b", "intern"),
]
COUNTY_SUFFIXES = ["county", "parish", "borough", "census area", "municipality"]
# --- End of fixed values. ---------------------------------------------------

NOT_ALNUM = "[^a-z0-9]+"


def folded_lower(col: Column) -> Column:
    return F.lower(fold_ascii(text_or_empty(col)))


def normalize_company(company: Column) -> Column:
    name = F.regexp_replace(strip(folded_lower(company)), "^the ", "")
    words = F.btrim(F.regexp_replace(name, NOT_ALNUM, " "))
    # A suffix needs a blank in front, so the last remaining word always stays.
    core = F.regexp_replace(words, "( (?:" + "|".join(LEGAL_SUFFIXES) + "))+$", "")
    return F.replace(core, F.lit(" "), F.lit(""))


def title_tokens(title: Column) -> Column:
    """Sorted distinct tokens of a title."""
    text = F.translate(folded_lower(title), TITLE_BRACKETS, " " * len(TITLE_BRACKETS))
    for pattern, replacement in TITLE_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.replace(text, F.lit("&"), F.lit("and"))
    noise = F.array(*[F.lit(w) for w in ["", *TITLE_STOP_WORDS]])
    return F.array_sort(F.array_except(F.split(text, NOT_ALNUM), noise))


def normalize_title(title: Column) -> Column:
    return F.array_join(title_tokens(title), "-")


def normalize_location(location: Column) -> Column:
    text = folded_lower(location)
    cleaned = F.regexp_replace(text, "[^a-z0-9,\\s\\x1c-\\x1f]+", " ")
    squeezed = F.transform(
        F.split(cleaned, ","), lambda p: F.btrim(F.regexp_replace(p, "[\\s\\x1c-\\x1f]+", " "))
    )

    def join_parts(parts: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        named = F.concat(
            F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
            F.array(F.coalesce(F.try_element_at(state_map(), last), last)),
        )
        key = F.replace(F.array_join(named, "-"), F.lit(" "), F.lit("-"))
        return F.when(F.size(parts) == 0, "").otherwise(key)

    parts = F.filter(squeezed, lambda p: p != "")
    return F.when(text.contains("remote"), "remote").otherwise(let(parts, join_parts))


def fingerprint(company: Column, title: Column, location: Column | None = None) -> Column:
    place = F.lit("") if location is None else normalize_location(location)
    return F.concat_ws("|", normalize_company(company), normalize_title(title), place)


def source_priority(source: Column) -> Column:
    """0 for company boards, 1 for repository lists and unknown, 2 for search."""
    low = F.lower(text_or_empty(source))
    return (
        F.when(low.startswith("greenhouse") | low.startswith("lever"), 0)
        .when(low.contains("github") | low.contains("/"), 1)
        .when(low.startswith("adzuna"), 2)
        .otherwise(1)
    )


def format_area_location(area: Column, display: Column) -> Column:
    """"City, ST" from an area hierarchy, skipping county-like levels."""
    levels = F.coalesce(area, F.array().cast("array<string>"))
    county = "(" + "|".join(COUNTY_SUFFIXES) + ")$"

    def place(names: Column) -> Column:
        state_name = F.get(names, F.lit(1))
        state_key = F.lower(strip(state_name))
        state = F.upper(F.coalesce(F.try_element_at(state_map(), state_key), state_name))
        below = F.reverse(F.slice(names, F.lit(3), F.greatest(F.size(names) - 2, F.lit(0))))
        cities = F.filter(
            F.transform(below, strip),
            lambda n: (F.lower(n) != state_key) & ~F.lower(n).rlike(county),
        )
        return F.concat_ws(", ", F.get(cities, F.lit(0)), state)

    return F.when(F.size(levels) < 2, text_or_empty(display)).otherwise(let(levels, place))


def with_keys(df: DataFrame) -> DataFrame:
    """Adds the key columns used by dedup and history checks, in one pass."""
    keyed = df.withColumns(
        {
            "company_key": normalize_company(F.col("company")),
            "title_key": normalize_title(F.col("title")),
            "location_key": normalize_location(F.col("location")),
            "normalized_url": normalize_url(F.col("url")),
        }
    )
    return keyed.withColumn(
        "fingerprint", F.concat_ws("|", "company_key", "title_key", "location_key")
    )
