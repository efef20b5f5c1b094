"""Plain Python versions of the operators' contracts, and a fixture with awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

SAME = "the quick brown fox jumps over the lazy dog and runs far away from here"
#: doc_id, text, source; no id twice.
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\x0b\n", None), (4, "one", "a"), (5, "one two", "a"),
    (6, SAME, "a"), (7, SAME, "b"), (8, SAME.upper(), "b"),
    (9, "# heading\nMIT License\nReleased under the MIT License, see mit license mit license", "c"),
    (10, "\n".join([SAME, "x", SAME, "", SAME]), "c"), (11, "  " + SAME + "\t\nshort", "c"),
    (12, "mail a@b.c_d@e.f 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (212) 555-1234 +12", "d"),
    (13, "é漢字 𝄞 ▁mark  two   spaces \r\nİstanbul’s Σς it's <|endoftext|> 12345", "d"),
    (14, "w " * 3000, "d"), (15, "x" * 5000, "e"), (16, " ".join(f"n{k}" for k in range(4000)), "e"),
    (17, "Licensed under the Apache License, Version 2.0. GNU General Public License", None),
    (18, "1" * 3000 + " " + "a" * 3000 + "@", "e"),
    (19, " ".join(f"n{k}" for k in range(5, 4000)), "e"), (20, "a a a a a a", "a"),
    (21, "\n" * 50, "a"), (22, SAME + " " + SAME, "a"),
]
SCHEMA = "doc_id bigint, text string, source string"
ITEMS = [
    (1, "n100 n101 n102 n103 n104 n105 n106 n107 n108 n109 n110 n111 n112 n113"), (2, "quick brown"), (3, ""), (4, None),
    (10, "Quick, brown!"), (11, "lazy dog and"), (None, "one two"),
]
ITEM_SCHEMA = "item_id bigint, text string"


def frame(spark, rows=ROWS):
    """The rows with further columns, named as the operators name theirs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("key", "gone", "h1", "cid", "n_words", "level", "label", "host", "contamination", "pieces"):
        df = df.withColumn(name, F.lit("x"))
    return df


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def line_dedup(rows, least=40, docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and i != max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def jaccard(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set()
    least = {i: i for i in sets}
    changed = True
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {i: (len(sets[i]), least[i]) for i in sets}


def measures(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    found = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(o) <= 255 for o in m[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(n) <= 19 and luhn(n),  # noqa: B023
                "phone": lambda: 9 <= len(n) <= 15,  # noqa: B023
            }[kind]()
            if fine:
                found.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def contamination(rows, items, width=13):
    windows = []
    for item, text in items:
        w = plain_words(text)
        if item is not None and w:
            n = min(width, len(w))
            windows += [(item, tuple(w[k : k + n])) for k in range(len(w) - n + 1)]
    out = {}
    for i, t, *_ in rows:
        w = plain_words(t)
        hit, ids = set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(item)
        out[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def phrases(text):
    w = plain_words(text)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
