"""Quality rules: rules per document, and verdicts per host with shrunk failure rates.

Each document is measured and judged by a few rules. Failures are counted per
host; a host's failure rate of a rule is drawn towards the rate of all hosts by
a beta prior that is estimated from the hosts themselves (empirical Bayes), so
that hosts with few documents are judged by the corpus and large ones by their
own documents. A host where the shrunk rate of a rule exceeds `most_failing` is
rejected, and the verdict is joined back to its documents.

Only column expressions run. A document is measured inside its row; hosts are
aggregated with map-side sums, so a hot host is a few partial rows.

Defined results: null text has no words and so fails `short`; a null host is a
host of its own; repeated rows are judged and counted each; an empty table
gives no rows; other columns are kept, whatever their names.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import let
from postmill.llm.text import BLANKS, quoted, words
from postmill.session import materialize

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "dup_lines")


@dataclass(frozen=True)
class Limits:
    """Thresholds; percentages are of the document's words or lines."""

    least_words: int = 50
    repeats_pct: int = 50
    symbols_pct: int = 10
    dup_lines_pct: int = 30
    most_failing: float = 0.5


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur twice or more.

    Windows are sorted by hash to find equal ones, then the positions of those
    are sorted, and each adds its words up to the next one: n log n, however
    often something repeats.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda at, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - at, F.lit(width)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def equal_neighbours(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["at"])), covered)

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - width),
            lambda at: F.struct(
                F.xxhash64(*[F.get(hashes, at + k) for k in range(width)]).alias("h"), at.alias("at")
            ),
        )

    def enough(hashes: Column) -> Column:
        return let(F.sort_array(windows(hashes)), equal_neighbours)

    hashed = F.transform(tokens, lambda word: F.xxhash64(word))
    return F.when(F.size(tokens) <= width, F.lit(0)).otherwise(let(hashed, enough))


def measures(text: Column) -> Column:
    """Struct of the measures of a text, with `n_lines`, its lines with a word."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")

    def counted(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("bigint").alias("n_words"),
            # `translate` takes many times as long as these two.
            F.length(F.array_join(tokens, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(tokens).cast("bigint").alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    return let(words(whole), counted)


def failures(m: Column, limits: Limits) -> dict[str, Column]:
    """Rule -> whether a document with the measures `m` fails it."""
    return {
        "short": m["n_words"] < limits.least_words,
        "repeats": 100 * m["n_repeat_words"] > limits.repeats_pct * m["n_words"],
        "symbols": 100 * m["n_symbols"] > limits.symbols_pct * m["n_words"],
        "dup_lines": 100 * m["n_dup_lines"] > limits.dup_lines_pct * m["n_lines"],
    }


def own_failure(m: Column, limits: Limits) -> Column:
    """A document fails by itself if it is short or mostly repeats; the other rules only count for hosts."""
    rules = failures(m, limits)
    return rules["short"] | rules["repeats"]


def host_counts(measured: DataFrame, host: str, limits: Limits, m: str = "m") -> DataFrame:
    """(host, n, one count per rule)."""
    sums = [F.sum(bad.cast("bigint")).alias(rule) for rule, bad in failures(F.col(m), limits).items()]
    return measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *sums)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Rule -> (alpha, beta), by the method of moments over all hosts; one row comes to the driver."""
    sums = [F.sum(r).alias(r) for r in RULES]
    squares = [F.sum(F.col(r) * F.col(r) / F.col("n")).alias(r + "_sq") for r in RULES]
    row = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *sums, *squares).first()
    found = {}
    for rule in RULES:
        total = row["n"] or 0
        mean = row[rule] / total if total else 0.0
        spread = mean * (1 - mean)
        between = row[rule + "_sq"] / total - mean * mean - spread * row["hosts"] / total if total else 0.0
        weight = min(max(spread / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6 if spread else 1.0
        found[rule] = (mean * weight, (1 - mean) * weight)
    return found


def rejected_hosts(measured: DataFrame, host: str, limits: Limits, m: str = "m") -> DataFrame:
    """One column `host`: those with a shrunk failure rate above the limit."""
    hosts = materialize(host_counts(measured, host, limits, m), "hosts")
    rates = [
        (F.col(rule) + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)) > limits.most_failing
        for rule, (alpha, beta) in beta_priors(hosts).items()
    ]
    return hosts.where(reduce(lambda a, b: a | b, rates)).select("host")


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """(doc_id, host, measures, base_failed, kept) per document.

    The measured table is narrow and written once; verdicts of hosts are
    joined to it null-safe. Spark broadcasts the rejected hosts if they are
    few, else it splits hot hosts of the join.
    """
    measured = materialize(
        docs.select("doc_id", F.col(host).alias("host"), measures(F.col("text")).alias("m")), "measures"
    )
    bad = rejected_hosts(measured, "host", limits).select(F.col("host").alias("bad"), F.lit(True).alias("out"))
    failed = own_failure(F.col("m"), limits)
    return measured.join(bad, F.col("host").eqNullSafe(F.col("bad")), "left").select(
        "doc_id", "host", *[F.col(f"m.{x}").alias(x) for x in MEASURES],
        failed.alias("base_failed"), (~failed & F.col("out").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The rows of `docs` that pass their own rules and whose host isn't rejected.

    Rows are written once beside their measures, as measuring costs far more than writing; the counts of
    hosts read the measures only.
    """
    whole = F.struct(*map(quoted, docs.columns)).alias("row")
    measured = materialize(docs.select(whole, F.col(host).alias("host"), measures(F.col("text")).alias("m")), "measures")
    bad = rejected_hosts(measured, "host", limits).select(F.col("host").alias("bad"))
    fine = measured.where(~own_failure(F.col("m"), limits))
    return fine.join(bad, F.col("host").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
