"""Text helpers: folding, stripping, tag removal, links, casing."""

import html
import json
import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that Python's str.strip() and str.splitlines() treat as white
# space / line ends; Java's \s and trim() know only some of them.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TAG = "<[^>]+>"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NON_ASCII = r"[^\x00-\x7F]"
# A word character in the Unicode sense, for Java patterns.
WORD = r"[\p{L}\p{N}_]"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def default_if_empty(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE))


@lru_cache(maxsize=1)
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Non-ASCII characters whose compatibility decomposition has ASCII parts,
    split into one-to-one and one-to-many. Built from the Unicode database."""
    single, several = {}, {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        ascii_part = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if ascii_part:
            (single if len(ascii_part) == 1 else several)[char] = ascii_part
    return single, several


def char_class(chars) -> str:
    """Character class of the given characters, written as code point ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ranges) + "]"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_ascii(col: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII.

    Decomposition works per character, so `translate` handles one-to-one
    characters and a map the few one-to-many ones. ASCII rows skip both.
    """
    single, several = fold_tables()
    mapping = F.from_json(F.lit(json.dumps(several)), "map<string,string>")

    def spell_out(one: Column) -> Column:
        # Split between code points, never inside a surrogate pair.
        chars = F.regexp_extract_all(one, F.lit("(?s)."), F.lit(0))
        spelled = F.transform(chars, lambda c: F.coalesce(F.try_element_at(mapping, c), c))
        return F.when(~one.rlike(NON_ASCII), one).otherwise(
            F.regexp_replace(
                F.when(one.rlike(char_class(several)), F.array_join(spelled, "")).otherwise(one),
                NON_ASCII + "+",
                "",
            )
        )

    one = F.translate(col, "".join(single), "".join(single.values()))
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, col).otherwise(let(one, spell_out))


def valid_texts(texts: pa.Array) -> pa.Array:
    """Bytes that are no UTF-8 as replacement characters, which is how the JVM reads them."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        spelled = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([one if one is None else one.decode(errors="replace") for one in spelled], texts.type)


@F.arrow_udf(StringType())
def resolve(texts: pa.Array) -> pa.Array:
    """Tags to blanks, HTML character references to characters (no such built-in in Spark), and strip.

    Arrow does all of it for texts whose only references are `&amp;`; a tag never begins or ends inside of one.
    """
    plain = pc.replace_substring_regex(valid_texts(texts), TAG, " ")
    resolved = pc.replace_substring(plain, "&amp;", "&")
    rest = pc.replace_substring(plain, "&amp;", "")  # two replacements cost less than a count
    others = pc.less(pc.binary_length(pc.replace_substring(rest, "&", "")), pc.binary_length(rest))
    if pc.any(others).as_py():
        spelled = [html.unescape(text) for text in plain.filter(others).to_pylist()]
        resolved = pc.replace_with_mask(resolved, pc.fill_null(others, False), pa.array(spelled, plain.type))
    return pc.utf8_trim(resolved, SPACE)


def strip_tags(col: Column) -> Column:
    """Tags become blanks, then character references are resolved, then strip.

    Only text with a `&` travels to Python, and comes back done; the rest is passed as null.
    """
    resolved = resolve(F.when(col.contains("&"), col))
    return F.coalesce(resolved, strip(F.regexp_replace(col, TAG, " ")))


# Fixed value: Markdown link pattern.
LINK = r"\[([^\]]*)\]\(([^)]+)\)"


def link_text(cell: Column) -> Column:
    return F.btrim(F.regexp_extract(cell, LINK, 1), F.lit("* "))


def link_url(cell: Column) -> Column:
    return F.regexp_extract(cell, LINK, 2)


def title_case(col: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    pieces = F.split(F.lower(col), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def truncate(col: Column, chars: int) -> Column:
    return F.substring(col, 1, chars)


def split_list(col: Column) -> Column:
    """Comma list -> array without empty items."""
    return F.filter(F.split(text_or_empty(col), ","), lambda x: x != "")


def join_list(col: Column) -> Column:
    return F.array_join(col, ",")


def alternatives(words) -> str:
    """Pattern of any of the words, with their common beginnings written once."""
    branches = []
    for char, group in groupby(sorted(set(words)), key=lambda word: word[0]):
        rests = [word[1:] for word in group]
        longer = [rest for rest in rests if rest]
        branches.append(char + (alternatives(longer) + ("?" if "" in rests else "") if longer else ""))
    return "(?:" + "|".join(branches) + ")"


def words_among(low: Column, words) -> Column:
    """The given words that lower-cased text has as whole words, in order, found in one pass."""
    return F.regexp_extract_all(low, F.lit(f"(?<!{WORD}){alternatives(words)}(?!{WORD})"), F.lit(0))


def first_word(keyword: str) -> str | None:
    """The first word of a keyword, which a text that has the keyword has as a whole word, too."""
    found = re.search(r"[a-z0-9_]+", keyword.lower())
    return found[0] if found and keyword.isascii() else None


def has_word(text: Column, keyword: str) -> Column:
    """Whole-word match of a literal keyword in lower-cased text.

    The byte search in `contains` rejects most rows before the pattern runs.
    """
    low = keyword.lower()
    pattern = rf"(?<!{WORD})\Q{low}\E(?!{WORD})"
    return text.contains(low) & text.rlike(pattern)


# Fixed value: words that mark an internship.
INTERNSHIP = "intern(ship)?|co-?op"


def is_internship(col: Column) -> Column:
    # What comes before is looked at only where a word could begin.
    return text_or_empty(col).rlike(rf"(?iu)(?=[ic])(?<!{WORD})({INTERNSHIP})(?!{WORD})")
