"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans follow from patterns and their checks (octets, Luhn, digit counts)
and always stay. Candidates for further spans are loose matches. Three labelers
vote on each (1, 0: abstains, -1): its shape, gazetteers of prefixes and names,
and cue words in the text before it. Expectation-maximisation over the counts of
vote patterns estimates the labelers' reliabilities and each pattern's
probability. With these as soft labels a naive Bayes classifier over features of
the span and its surroundings is fitted, and spans it finds probable are added.

Only column expressions run. Spans are found inside a document's row; the single
shuffle counts vote patterns and features, whose numbers are bounded by the
kinds, votes and buckets, and only those counts come to the driver.

Quantifiers that need no way back are possessive, so a long run of matching
characters neither deepens the matcher's stack nor costs quadratic time; the
matches are those of the plain patterns. Positions are code points: the lengths
of the pieces between matches and of the matches themselves, summed up.

Defined results: null text is empty and has no spans; rows are searched one by
one, so ties and repeated rows don't matter (but each counts as evidence); an
empty table gives no rows; positions are summed up and spans compared in blocks and
sweeps, so a text with very many spans costs no product of them; without candidates nothing is fitted or added; other
columns are kept, whatever their names, except the struct `pii`.
"""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import let
from postmill.llm.text import in_row
from postmill.session import materialize

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
GATES = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SECRET = "(?i:token|password|passwd|secret|api[_-]?key)"
ADDED = {
    "secret": SECRET + r"""["']?\x20{0,2}[=:]\x20{0,2}["']?[A-Za-z0-9+/_=-]{8,}+""",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{2,30}+(?![.@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = [*PATTERNS, *ADDED]
#: Gazetteers: values that speak for a kind. Fixed values.
GAZETTEERS = {
    "secret": r"^(?:sk|pk|ghp|gho|xox[abp]|AKIA|eyJ)|[0-9a-f]{16,}",
    "handle": r"(?i)^@(?:anna|alex|ali|ben|chris|dan|david|emma|eva|jan|john|jose|juan|julia|kim|laura|lena|lisa|luis|maria|marie|mark|max|mike|nina|paul|peter|sam|sara|tom)",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "national": r"^\(?(?:2[0-9][1-9]|3[0-9][1-9]|4[0-9][1-9]|5[0-9][1-9]|6[0-9][1-9]|7[0-9][1-9]|8[0-9][1-9]|9[0-9][1-9])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
#: Words before a span that speak for or against personal data. Fixed values.
FOR = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|telefon|téléphone|teléfono|call|fax|mobile|card|visa|account|konto|iban|token|password|passwd|secret|key|ssn|social|name|user|follow|author)\b"
AGAINST = r"(?i)\b(?:isbn|issn|version|page|pages|article|fig|figure|table|total|price|year|chapter|section|vol|order|invoice|part)\b"
CONTEXT = 30
VOTES = (-1, 0, 1)
#: Items summed up one by one; a longer list is summed up in blocks.
BLOCK = 128
LAST = 2**31 - 1
SPAN = "array<struct<start:int,end:int,value:string>>"
AROUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
FEATURES = ("length", "digits", "letters", "left", "right", "cue")


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or what `add` gives) of an array; `add` is associative.

    Appending copies an array, so blocks are summed up by themselves and moved by the blocks before them.
    """

    def small(part: Column, kind: str = "array<int>") -> Column:
        def put(done: Column, x: Column) -> Column:
            return F.array_append(done, F.when(F.size(done) == 0, x).otherwise(add(F.element_at(done, -1), x)))

        return F.aggregate(part, F.array().cast(kind), put)

    def move(blocks: Column) -> Column:
        ends = small(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(ends, lambda e: F.flatten(F.transform(
            blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: add(F.get(e, k - 1), x)))
        )))

    def of(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_values), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: small(F.slice(all_values, at, BLOCK)))
        return F.when(F.size(all_values) == 0, F.array().cast("array<int>")).otherwise(let(blocks, move))

    return let(values, of)


def last_chars(text: Column) -> Column:
    return F.right(text, F.lit(CONTEXT))


def located(text: Column, pattern: str, around: bool = False) -> Column:
    """Array of (start, end, value) of a pattern's matches, from left to right.

    `around` adds `before` (up to `CONTEXT` characters) and `after` (one); a
    match must then have at least four characters.
    """

    def sum_up(parts: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda hit, k: F.length(F.get(parts, k)) + F.length(hit))

        def span(hit: Column, k: Column, ends: Column) -> Column:
            place = [(F.get(ends, k) - F.length(hit)).alias("start"), F.get(ends, k).alias("end"), hit.alias("value")]
            if not around:
                return F.struct(*place)
            pieces = [last_chars(F.get(parts, k))]
            for back in range(1, CONTEXT // 4 + 2):  # so many matches fill the context
                pieces = [*(F.when(k >= back, last_chars(F.get(of, k - back))) for of in (parts, hits)), *pieces]
            after = F.substring(F.concat(F.get(parts, k + 1), F.coalesce(F.get(hits, k + 1), F.lit(""))), 1, 1)
            return F.struct(*place, last_chars(F.concat_ws("", *pieces)).alias("before"), after.alias("after"))

        return let(running(sizes, lambda a, b: a + b), lambda ends: F.transform(hits, lambda hit, k: span(hit, k, ends)))

    def of(hits: Column) -> Column:
        parts = F.split(text, pattern, -1)
        none = F.array().cast(AROUND if around else SPAN)
        return F.when(F.size(hits) == 0, none).otherwise(let(parts, lambda p: sum_up(p, hits)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def untouched(spans: Column, others: Column) -> Column:
    """The `spans` (in order, apart from each other) that none of `others` overlaps: one sweep by start."""

    def sweep(items: Column) -> Column:
        ends = F.transform(items, lambda s: F.when(s["k"] < 0, s["end"]).otherwise(0))
        starts = F.transform(F.reverse(items), lambda s: F.when(s["k"] < 0, s["start"]).otherwise(LAST))
        last_end = running(ends, F.greatest)
        next_start = F.reverse(running(starts, F.least))

        def free(last_end: Column, next_start: Column) -> Column:
            def judged(s: Column, i: Column) -> Column:
                return F.when((s["k"] >= 0) & (F.get(last_end, i) <= s["start"]) & (F.get(next_start, i) >= s["end"]), s["k"])

            return F.transform(F.array_compact(F.transform(items, judged)), lambda k: F.get(spans, k))

        return let(last_end, lambda e: let(next_start, lambda n: free(e, n)))

    def item(s: Column, k: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), k.cast("int").alias("k"))

    items = F.concat(F.transform(spans, item), F.transform(others, lambda s: item(s, F.lit(-1))))
    none = (F.size(spans) == 0) | (F.size(others) == 0)
    return F.when(none, spans).otherwise(let(F.sort_array(items), sweep))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Every second digit from the right counts twice, by its digit sum; the sum is a multiple of ten."""

    def worth(k: Column) -> Column:
        digit = F.substring(number, F.length(number) - k + 1, 1).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(digit > 9, digit - 9).otherwise(digit)

    worths = F.transform(F.sequence(F.lit(1), F.length(number)), worth)
    return F.aggregate(worths, F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    size = F.length(digits(value))
    if kind == "ip":
        octets = F.transform(F.split(value, r"\."), lambda o: F.ltrim(o, F.lit("0")))
        return F.forall(octets, lambda o: (F.length(o) < 3) | ((F.length(o) == 3) & (o <= "255")))
    if kind == "card":
        return F.when(size.between(12, 19), passes_luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    spans = F.filter(located(text, PATTERNS[kind]), lambda s: holds(kind, s["value"]))
    gate = F.contains(text, F.lit(GATES[kind])) & text.rlike("[0-9]" if kind != "email" else "@")
    return F.when(gate, spans).otherwise(F.array().cast(SPAN))


def _loose(text: Column) -> Column:
    """Candidates: one pass of all loose patterns, so that they don't overlap."""
    pattern = "|".join(f"(?:{p})" for p in ADDED.values())
    # Each alternative needs a digit, an @ or a word before a secret.
    return F.when(text.rlike(f"[0-9@]|{SECRET}"), located(text, pattern, around=True)).otherwise(F.array().cast(AROUND))


def _kind(value: Column) -> Column:
    """Kind of a candidate, by its first characters and shape."""
    return (
        F.when(value.rlike("^(?i:token|password|passwd|secret|api)"), "secret")
        .when(value.startswith("@"), "handle")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-"), "ssn")
        .otherwise("national")
    )


def _one_of(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    return reduce(lambda a, b: a | b, [(kind == k) & value.rlike(p) for k, p in patterns.items()])


def _candidate(span: Column) -> Column:
    """Struct of kind, positions, votes and features of a loose match."""
    kind = _kind(span["value"])
    value = F.when(kind == "secret", F.regexp_extract(span["value"], r"[A-Za-z0-9+/_=-]{8,}$", 0)).otherwise(span["value"])
    size = F.length(value)
    number = F.length(digits(value))
    start = span["end"] - size
    before = last_chars(F.concat(span["before"], F.left(span["value"], F.length(span["value"]) - size)))
    left, right = F.right(before, F.lit(1)), span["after"]
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    shape = (
        F.when(kind == "secret", F.when(mixed & (size >= 12), 1).when(~mixed, -1).otherwise(0))
        .when(kind == "handle", F.when(value.rlike("[0-9]{4,}"), -1).otherwise(0))
        .when(kind == "iban", F.when(size.between(15, 42) & (number >= 8), 1).otherwise(-1))
        .otherwise(F.when(F.length(F.regexp_replace(digits(value), F.substring(digits(value), 1, 1), "")) == 0, -1).otherwise(1))
    )
    gazetteer = F.when(_one_of(kind, GAZETTEERS, value), 1).otherwise(F.when(kind == "handle", 0).otherwise(-1))
    cues = F.when(before.rlike(FOR), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    char = lambda c: F.when(c.rlike("^[A-Za-z]"), "a").when(c.rlike("^[0-9]"), "0").when(c.rlike(r"^\s"), "_").when(c == "", "^").otherwise(".")
    return F.struct(
        start.alias("start"), span["end"].alias("end"), kind.alias("kind"),
        shape.alias("shape"), gazetteer.alias("gazetteer"), cues.alias("context"),
        F.least(F.floor(F.log2(size + F.lit(1))), F.lit(7)).cast("string").alias("length"),
        F.floor(4 * number / size).cast("string").alias("digits"),
        F.floor(4 * F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / size).cast("string").alias("letters"),
        char(F.coalesce(left, F.lit(""))).alias("left"), char(F.coalesce(right, F.lit(""))).alias("right"),
        cues.cast("string").alias("cue"),
    )


def find(docs: DataFrame) -> DataFrame:
    """`docs` without text, with `base` (arrays per kind) and `loose` (candidates that no base span overlaps)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.struct(*[
        F.transform(base_spans(text, k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in PATTERNS
    ])
    every = F.concat(*[F.col("__base").getField(k) for k in PATTERNS])
    found = docs.withColumn("__base", base).withColumn("__loose", F.transform(_loose(text), _candidate))
    return found.withColumn("__loose", untouched(F.col("__loose"), every)).drop("text")


def vote_counts(found: DataFrame) -> list:
    """Rows (kind, shape, gazetteer, context, feature, bucket, n): counts, bounded by kinds, votes and buckets."""
    one = found.select(F.explode("__loose").alias("c"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c.{f}").alias("bucket")) for f in FEATURES])
    spread = one.select("c.kind", "c.shape", "c.gazetteer", "c.context", F.explode(pairs).alias("p"))
    return spread.groupBy("kind", "shape", "gazetteer", "context", "p.feature", "p.bucket").agg(F.count("*").alias("n")).collect()


def reliabilities(counts: dict[tuple, float], rounds: int = 50) -> tuple[dict[tuple, float], list[dict]]:
    """Probability of each (kind, votes) and, per labeler, P(vote | personal or not), by EM.

    Starts from the share of votes in favour; each kind has its own prior.
    """
    chance = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:]))) for p in counts}
    tables: list[dict] = []
    for _ in range(rounds):
        tables = []
        for k in range(3):
            table = {(v, y): 0.1 for v in VOTES for y in (0, 1)}
            for p, n in counts.items():
                table[p[k + 1], 1] += n * chance[p]
                table[p[k + 1], 0] += n * (1 - chance[p])
            sums = {y: sum(table[v, y] for v in VOTES) for y in (0, 1)}
            tables.append({(v, y): table[v, y] / sums[y] for v in VOTES for y in (0, 1)})
        prior = {}
        for kind in {p[0] for p in counts}:
            own = [(n, chance[p]) for p, n in counts.items() if p[0] == kind]
            prior[kind] = (1 + sum(n * c for n, c in own)) / (2 + sum(n for n, _ in own))
        for p in counts:
            yes, no = prior[p[0]], 1 - prior[p[0]]
            for k in range(3):
                yes, no = yes * tables[k][p[k + 1], 1], no * tables[k][p[k + 1], 0]
            chance[p] = yes / (yes + no)
    return chance, tables


def fit(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds of each kind, and what each `feature=bucket` of a kind adds."""
    rows = vote_counts(found)
    patterns: dict[tuple, float] = {}
    for r in sorted(rows):
        if r["feature"] == FEATURES[0]:
            key = (r["kind"], r["shape"], r["gazetteer"], r["context"])
            patterns[key] = patterns.get(key, 0) + r["n"]
    chance, _ = reliabilities(patterns)
    total = {(k, y): 1.0 for k in ADDED for y in (0, 1)}
    for p, n in patterns.items():
        total[p[0], 1] += n * chance[p]
        total[p[0], 0] += n * (1 - chance[p])
    seen: dict[tuple, float] = {}
    for r in sorted(rows):
        p = chance[r["kind"], r["shape"], r["gazetteer"], r["context"]]
        for y, share in ((1, p), (0, 1 - p)):
            key = (r["kind"], r["feature"], r["bucket"], y)
            seen[key] = seen.get(key, 1.0) + r["n"] * share
    prior = {k: math.log(total[k, 1] / total[k, 0]) for k in ADDED}
    weight = {
        f"{k}|{f}={b}": math.log(seen[k, f, b, 1] / (total[k, 1] + 8)) - math.log(seen[k, f, b, 0] / (total[k, 0] + 8))
        for k, f, b, y in seen if y
    }
    return prior, weight


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.lit(None).cast("map<string,double>")


def detect(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """`docs` without text, with the struct `pii`: base (arrays per kind), spans (kind, start, end, in order)."""
    rows = docs.select(in_row(docs, "text", "pii"), F.col("text").cast("string").alias("text"))
    found = materialize(find(rows), "spans")
    prior, weight = fit(found)

    def log_odds(c: Column) -> Column:
        add = [F.coalesce(F.try_element_at(_map(weight), F.concat(c["kind"], F.lit(f"|{f}="), c[f])), F.lit(0.0)) for f in FEATURES]
        return sum(add, F.try_element_at(_map(prior), c["kind"]))

    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])

    def span(s: Column, kind: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.try_element_at(order, kind).alias("rank"), s["end"].alias("end"), kind.alias("kind")
        )

    def of_kind(kind: str) -> Column:
        return F.transform(f"__base.{kind}", lambda s: span(s, F.lit(kind)))

    chosen = F.filter("__loose", lambda c: log_odds(c) >= math.log(least / (1 - least)))
    base = F.concat(*[of_kind(kind) for kind in PATTERNS])
    added = F.transform(chosen, lambda c: span(c, c["kind"]))
    pii = F.struct(
        F.col("__base").alias("base"), F.sort_array(base).alias("base_spans"), F.sort_array(F.concat(base, added)).alias("spans")
    )
    return found.select("row", pii.alias("pii")).select("row.*", "pii")


def spelled(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
