"""Secret scan: all rules in one deterministic automaton over bytes.

1. The regexes of the rules are compiled by subset construction. Within a rule the
   subsets are kept in order of where their matches started; once one accepts, the
   later ones go. So a state says where the leftmost match ends, and rules don't
   disturb each other: the combined state holds one such list per rule.
2. Equal states are merged by partition refinement. What is left is one array of
   transitions by state and class of bytes, and one of the rules that accept.
3. A text is read once, byte by byte, for all rules. Where a rule stops accepting, a
   match has ended. Its start is found by the rule's own automaton, reversed, read
   back from the end, not further than that rule's last match.
4. A match's checks follow (length, value, entropy); what fails is dropped and not
   tried again. Spans of the rules `assign`, `access` and `hex` are the base; spans
   of the other rules are added, and never take a base span away.

Rules must accept until they die, and no rule may accept the byte that ends its own
match; `Automaton` refuses others. So no byte is read again for a later match. The
automaton is compiled on the driver, a few hundred kB, and goes to the tasks.

Defined results: null text is empty and has no spans; texts are read whole, one at
a time, in time that grows with their length; rows are judged one by one, so ties
and repeated rows don't matter; an empty table gives no rows; other columns are
kept, whatever their names, except a column `secrets` (any case), which is replaced.
"""

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.text import slices


@dataclass(frozen=True)
class Form:
    """A kind of secret: its pattern, and the check that a match has to pass."""

    kind: str
    pattern: str
    holds: Callable[[bytes], bool] = lambda match: True


@dataclass(frozen=True)
class Rule:
    """Forms that are looked for together; their matches don't overlap."""

    forms: tuple[Form, ...]

    @property
    def pattern(self) -> str:
        return "|".join(f"(?:{form.pattern})" for form in self.forms)

    def kind_of(self, match: bytes) -> str | None:
        """Kind of a match that passes its check."""
        for form in self.forms:
            if len(self.forms) == 1 or re.fullmatch(form.pattern.encode(), match):
                return form.kind if form.holds(match) else None
        return None


def value_of(match: bytes) -> bytes:
    """What is assigned: names, quotes and blanks before it hold no : or =."""
    value = re.split(rb"[:=]", match, maxsplit=1)[1].lstrip(b" ")
    return value[1:] if value[:1] in (b'"', b"'") else value


def entropy(value: bytes) -> float:
    """Bits per byte of the value's own bytes."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def longer(least: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= least


def mixed(least: int, bits: float) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= least and entropy(match) >= bits


def signed(match: bytes) -> bool:
    """Header and claims of a web token are objects in base64, and a signature follows."""
    parts = match.split(b".")
    return len(parts) == 3 and parts[1].startswith(b"eyJ") and len(match) >= 40


#: Fixed values of the base rules: patterns and least lengths.
BASE = (
    Rule((Form(
        "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        lambda match: len(value_of(match)) >= 8,
    ),)),
    Rule((Form("access", r"AKIA[A-Z0-9]+", longer(16)),)),
    Rule((Form("hex", r"[0-9a-f]{32,}"),)),
)
#: Forms of well-known credentials: a fixed prefix, then what providers issue.
ADDED = Rule((
    Form("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", longer(40)),
    Form("github_fine", r"github_pat_[A-Za-z0-9_]+", longer(60)),
    Form("gitlab", r"glpat-[A-Za-z0-9_-]+", longer(26)),
    Form("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", longer(24)),
    Form("google", r"AIza[A-Za-z0-9_-]+", mixed(39, 3.0)),
    Form("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", longer(24)),
    Form("npm", r"npm_[A-Za-z0-9]+", longer(40)),
    Form("sendgrid", r"SG\.[A-Za-z0-9_.-]+", lambda match: len(match) >= 40 and match.count(b".") == 2),
    Form("web_token", r"eyJ[A-Za-z0-9_.-]+", signed),
    Form("bearer", r"(?i:bearer)\x20[A-Za-z0-9+/_.~=-]+", lambda match: len(match) >= 27 and entropy(match[7:]) >= 3.0),
    Form("url_login", r"://[A-Za-z0-9._~%!$&*+=:@-]+", lambda match: re.match(rb"://[^:@]+:[^@]+@[^@]", match) is not None),
    Form("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
))
RULES = (*BASE, ADDED)
KINDS = [form.kind for rule in RULES for form in rule.forms]


class Nfa:
    """States of one rule over bytes: edges by byte, and free edges."""

    def __init__(self, pattern: str):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.start = self.state()
        self.end = self._build(_parser.parse(pattern), self.start, False)

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _bytes(self, chars: set[int], any_case: bool) -> frozenset[int]:
        if any_case:
            chars = {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())}
        if max(chars) > 127:
            raise ValueError("rules are ASCII")
        return frozenset(chars)

    def _build(self, items, at: int, any_case: bool) -> int:
        """Adds what a parsed pattern matches behind state `at`; the state behind it."""
        for op, arg in items:
            if op is C.LITERAL:
                at = self._step(at, self._bytes({arg}, any_case))
            elif op is C.IN:
                chars = set()
                for kind, value in arg:
                    if kind not in (C.LITERAL, C.RANGE):
                        raise ValueError(f"not in rules: {kind}")
                    chars |= {value} if kind is C.LITERAL else set(range(value[0], value[1] + 1))
                at = self._step(at, self._bytes(chars, any_case))
            elif op is C.SUBPATTERN:
                at = self._build(arg[3], at, any_case or bool(arg[1] & re.IGNORECASE))
            elif op is C.BRANCH:
                after = self.state()
                for branch in arg[1]:
                    self.free[self._build(branch, at, any_case)].append(after)
                at = after
            elif op is C.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self._build(inner, at, any_case)
                if most is C.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self._build(inner, loop, any_case)].append(loop)
                    at = loop
                else:
                    after = self.state()
                    for _ in range(most - least):
                        self.free[at].append(after)
                        at = self._build(inner, at, any_case)
                    self.free[at].append(after)
                    at = after
            else:
                raise ValueError(f"not in rules: {op}")
        return at

    def _step(self, at: int, chars: frozenset[int]) -> int:
        after = self.state()
        self.edges[at].append((chars, after))
        return after

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for s in states for chars, to in self.edges[s] if byte in chars})

    def reversed(self) -> "Nfa":
        back = Nfa("")
        back.edges, back.free = [[] for _ in self.edges], [[] for _ in self.edges]
        for s, edges in enumerate(self.edges):
            for chars, to in edges:
                back.edges[to].append((chars, s))
            for to in self.free[s]:
                back.free[to].append(s)
        back.start, back.end = self.end, self.start
        return back


def byte_classes(nfas: list[Nfa]) -> tuple[bytes, list[int]]:
    """Class of each byte, and a byte of each class: bytes of a class are on the same edges."""
    sets = list({chars for nfa in nfas for edges in nfa.edges for chars, _ in edges})
    marks = [tuple(byte in s for s in sets) for byte in range(256)]
    numbers: dict[tuple, int] = {}
    table = bytes(numbers.setdefault(mark, len(numbers)) for mark in marks)
    return table, [table.index(k) for k in range(len(numbers))]


def subsets(first, step, n_classes: int) -> tuple[list, np.ndarray]:
    """Subset construction: all states reached from `first`, and their transitions by class."""
    numbers, states, rows = {first: 0}, [first], []
    for state in states:  # grows on the way
        row = []
        for k in range(n_classes):
            after = step(state, k)
            if after not in numbers:
                numbers[after] = len(states)
                states.append(after)
            row.append(numbers[after])
        rows.append(row)
    return states, np.array(rows)


def minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no text tells apart: refines the partition by marks until it is stable."""
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        seen = np.column_stack([part, part[table]])
        finer = np.unique(seen, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    # The first state keeps number 0.
    order = {int(p): k for k, p in enumerate(dict.fromkeys(part.tolist()))}
    part = np.array([order[int(p)] for p in part])
    first = np.unique(part, return_index=True)[1]
    return part[table[first]], marks[first]


class Automaton:
    """Transition arrays of all rules together, and of each rule reversed."""

    def __init__(self, rules: tuple[Rule, ...]):
        nfas = [Nfa(rule.pattern) for rule in rules]
        self.classes, samples = byte_classes(nfas)
        starts = [nfa.closure({nfa.start}) for nfa in nfas]
        if any(nfa.end in start for nfa, start in zip(nfas, starts, strict=True)):
            raise ValueError("a rule matches nothing")

        @lru_cache(None)
        def one(rule: int, groups: tuple, k: int) -> tuple:
            """A rule's next list of (states with one start), oldest first."""
            nfa, byte = nfas[rule], samples[k]
            found, seen, accepted = [], set(), groups and nfa.end in groups[-1]
            for group in (*groups, *(() if accepted else (starts[rule],))):
                after = nfa.step(group, byte) - seen
                if after:
                    found.append(after)
                    seen |= after
                    if nfa.end in after:
                        break
            if accepted and not found:  # the match has ended before this byte, which may begin another
                again = one(rule, (), k)
                if again and nfa.end in again[-1]:
                    raise ValueError(f"{rules[rule].pattern} accepts the byte that ends it")
                return again
            if accepted and nfa.end not in found[-1]:
                raise ValueError(f"{rules[rule].pattern} can go on without accepting")
            return tuple(found)

        def step(state: tuple, k: int) -> tuple:
            return tuple(one(rule, groups, k) for rule, groups in enumerate(state))

        states, table = subsets(tuple(() for _ in rules), step, len(samples))
        marks = [sum(1 << r for r, groups in enumerate(s) if groups and nfas[r].end in groups[-1]) for s in states]
        self.n_states = len(states)
        self.table, self.marks = minimised(table, np.array(marks, dtype=np.int64))
        self.back = []
        for nfa in nfas:
            other = nfa.reversed()
            sets, back = subsets(other.closure({other.start}), lambda s, k, n=other: n.step(s, samples[k]), len(samples))
            kinds = np.array([2 if other.end in s else 1 if s else 0 for s in sets])
            self.back.append(minimised(back, kinds))

    def scanner(self, rules: tuple[Rule, ...]) -> Callable[[bytes], list[tuple[int, int, str]]]:
        """Finds the spans of all rules that hold, as (start, end, kind) in bytes."""
        marks = self.marks.tolist()
        # A state is its row of next states, by class, with its mark behind them.
        rows: list[list] = [[] for _ in marks]
        for row, numbers, mark in zip(rows, self.table.tolist(), marks, strict=True):
            row += [*(rows[n] for n in numbers), mark]
        back = [(table.tolist(), kinds.tolist()) for table, kinds in self.back]
        classes = self.classes

        def begin(rule: int, text: bytes, end: int, least: int) -> int:
            table, kinds = back[rule]
            state, start = 0, end
            for at in range(end - 1, least - 1, -1):
                state = table[state][text[at]]
                if kinds[state] == 2:
                    start = at
                elif kinds[state] == 0:
                    break
            return start

        def scan(text: bytes) -> list[tuple[int, int, str]]:
            found: list[tuple[int, int, str]] = []
            last = [0] * len(rules)
            coded = text.translate(classes)
            state, held = rows[0], 0
            for at, k in enumerate(coded):
                state = state[k]
                if state[-1] != held:
                    ended, held = held & ~state[-1], state[-1]
                    if ended:
                        close(ended, text, coded, at, found, last)
            if held:
                close(held, text, coded, len(text), found, last)
            return found

        def close(ended: int, text: bytes, coded: bytes, end: int, found: list, last: list) -> None:
            for rule in range(len(rules)):
                if ended >> rule & 1:
                    start = begin(rule, coded, end, last[rule])
                    last[rule] = end
                    kind = rules[rule].kind_of(text[start:end])
                    if kind:
                        found.append((start, end, kind))

        return scan


@lru_cache(4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton(rules)


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of bytes as spans of code points, by one pass over their ends in order."""
    if text.isascii():
        return spans
    at, chars, places = 0, 0, {}
    for end in sorted({e for span in spans for e in span[:2]}):
        chars += len(text[at:end].decode("utf-8", "surrogatepass"))
        at = end
        places[end] = chars
    return [(places[start], places[end], kind) for start, end, kind in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("base", SPANS), T.StructField("spans", SPANS)])
ARROW_SPANS = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))


def _scanned(rows: DataFrame, rules: tuple[Rule, ...], n_base: int) -> DataFrame:
    compiled = automaton(rules)
    kinds = [form.kind for rule in rules for form in rule.forms]
    base_kinds = {form.kind for rule in rules[:n_base] for form in rule.forms}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = compiled.scanner(rules)
        for whole in batches:
            for batch in slices(whole, "text"):
                base, every = [], []
                for text in batch.column("text").to_pylist():
                    data = (text or "").encode("utf-8", "surrogatepass")
                    found = in_code_points(data, spans_of(data))
                    found.sort(key=lambda span: (span[0], kinds.index(span[2])))
                    listed = [{"kind": kind, "start": start, "end": end} for start, end, kind in found]
                    base.append([span for span in listed if span["kind"] in base_kinds])
                    every.append(listed)
                columns = [pa.array(base, ARROW_SPANS), pa.array(every, ARROW_SPANS)]
                secrets = pa.StructArray.from_arrays(columns, names=["base", "spans"])
                yield pa.RecordBatch.from_arrays([batch.column("row"), secrets], names=["row", "secrets"])

    schema = T.StructType([rows.schema["row"], T.StructField("secrets", FOUND)])
    return rows.mapInArrow(scan, schema)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE)) -> DataFrame:
    """`docs` with `secrets`: struct of `base` and `spans`, arrays of (kind, start, end) in code points.

    Both are ordered by start, then by the rules' order; the first `n_base` rules give the base.
    """
    keep = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() != "secrets"]
    # Other columns travel inside a struct, where no name can clash.
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    return _scanned(rows, rules, n_base).select("row.*", "secrets")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
