"""Text dialects, n-gram sets and predicates as Catalyst expressions.

The normalisers differ on purpose: each family of operators compares texts in its own dialect.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KEEP = r"[^0-9a-zA-Z一-鿿]+"
_COMMON = " ,.\n"
_KEEP_EXT = r"[^0-9a-zA-Z㐀-䶿一-鿿]+"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(col(x), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def norm_text(x: str | Column) -> Column:
    """ASCII letters, digits and CJK ideographs only, in lower case; no compatibility composition."""
    t = blank(x)
    for mark in _COMMON:  # plain replacements are cheaper than a match for each of the many
        t = F.replace(t, F.lit(mark), F.lit(""))
    return F.lower(F.regexp_replace(t, _KEEP, ""))


def norm_question(x: str | Column, extended: bool = False) -> Column:
    """Compatibility composition, lower case, then ASCII letters, digits and CJK; ``extended`` keeps Extension A too."""
    return F.regexp_replace(F.lower(nfkc(blank(x))), _KEEP_EXT if extended else _KEEP, "")


def norm_evidence(x: str | Column) -> Column:
    """Letters and numbers of any script, in lower case."""
    return F.lower(F.regexp_replace(blank(x), r"[^\p{L}\p{N}]", ""))


def stem(x: str | Column) -> Column:
    """A file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(blank(x), r"(?<=.)\.[^.]*$", "")


def norm_source(x: str | Column) -> Column:
    return F.lower(F.replace(stem(x), F.lit(" "), F.lit("")))


def norm_source_keepspace(x: str | Column) -> Column:
    return F.lower(stem(F.trim(blank(x))))


def norm_source_full(x: str | Column) -> Column:
    return F.lower(blank(x))


def norm_ws(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(blank(x), r"\s+", " "))


def norm_id(x: str | Column) -> Column:
    return norm_ws(F.lower(F.trim(nfkc(blank(x)))))


def stable_id(x: str | Column, prefix: str = "", digits: int = 16) -> Column:
    """A prefix and the first hex digits of the digest of a normalised id."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(norm_id(x), 256), 1, digits))


def slug(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(x)), r"[^a-z0-9]+", "_"), F.lit("_"))


def dedup_signature(x: str | Column, chars: int = 120) -> Column:
    """The first ``chars`` non-space characters: the key by which retrieved evidence counts as the same."""
    return F.substring(F.regexp_replace(blank(x), r"\s+", ""), 1, chars)


def compact_text(x: str | Column, limit: int) -> Column:
    """Collapsed white space; beyond ``limit``, cut and ended by three dots."""
    t = norm_ws(x)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def tokens(x: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(blank(x)), F.lit("([a-z0-9]+)"), 1)


def char_ngrams(x: str | Column, n: int = 3) -> Column:
    """The distinct character n-grams; a shorter text is its own only gram, an empty one has none."""
    t = col(x)
    size = F.length(t)
    # an empty match at every place, with the gram as its group: one pass, where substrings would start over each time
    many = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(t)).otherwise(F.array_distinct(many))


def jaccard(a: str | Column, b: str | Column, both_empty: float = 1.0) -> Column:
    """Similarity of two arrays of distinct values; ``both_empty`` is that of two empty ones."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(both_empty)).otherwise(both / union)


def overlap_coefficient(a: str | Column, b: str | Column) -> Column:
    """Shared values over the smaller size; 0 with an empty side."""
    a, b = col(a), col(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def contains_any(x: str | Column, terms: Iterable[str], ignore_case: bool = False) -> Column:
    """Whether the text holds any of the terms; false for none."""
    t = F.lower(blank(x)) if ignore_case else blank(x)
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(t, F.lit(term.lower() if ignore_case else term))
    return found


def count_terms(x: str | Column, terms: Iterable[str]) -> Column:
    """How many of the distinct lower-case terms the text holds."""
    t = F.lower(blank(x))
    return sum((F.contains(t, F.lit(term)).cast("int") for term in dict.fromkeys(w.lower() for w in terms if w)), F.lit(0))


def question_char_overlap(a: str | Column, b: str | Column) -> Column:
    """Distinct characters of the normalised first text that the second has too, over the first's."""
    chars = lambda x: F.array_distinct(F.filter(F.split(norm_text(x), ""), lambda c: c != ""))
    left = chars(a)
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, chars(b))) / F.size(left))


def split_sentences(x: str | Column) -> Column:
    """Sentences with the mark that ends them; bodies are trimmed before the mark returns, empty ones dropped."""
    parts = F.split(F.regexp_replace(blank(x), r"([。；;.!！?？\n])", "$1\u0001"), "\u0001")

    def sentence(p: Column) -> Column:
        mark = F.regexp_extract(p, r"([。；;.!！?？\n])\z", 1)
        return F.trim(F.concat(strip(F.regexp_replace(p, r"[。；;.!！?？\n]\z", "")), F.when(mark == "\n", "").otherwise(mark)))

    return F.filter(F.transform(parts, sentence), lambda s: s != "")


def strip(x: Column) -> Column:
    """Without white space at both ends, as the wider Unicode meaning has it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_claims(x: str | Column) -> Column:
    """Atomic claims of an answer: split at sentence marks other than the full stop, commas and spaces trimmed."""
    parts = F.split(nfkc(blank(x)), r"[。！？!?；;\n]+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ，,]+|[ ，,]+$", "")), lambda p: p != "")


def tokens_by_chars(x: str | Column, per_token: float = 1.5) -> Column:
    """The chunker's estimate: characters over 1.5, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(blank(x)) / F.lit(per_token)).cast("int"))


def tokens_by_pages(x: str | Column) -> Column:
    """The parser's estimate: characters times 1.5."""
    return F.floor(F.length(blank(x)) * F.lit(1.5)).cast("int")


def tokens_by_prompt(x: str | Column) -> Column:
    """The prompt budget's estimate: characters over 1.8 rounded up; 0 for an empty text."""
    n = F.length(blank(x))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(1.8)).cast("int")))


def canonical_number(x: str | Column) -> Column:
    """A decimal as text without a needless fraction."""
    v = col(x).cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_number(v, 5), r"\.?0+$|,", ""))


def strip_code_fence(x: str | Column) -> Column:
    """A model's JSON answer without the fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(blank(x)), r"(?s)^```(?:json)?\s*", ""), r"(?s)\s*```$", ""))


def is_iso_timestamp(x: str | Column) -> Column:
    return F.try_to_timestamp(col(x)).isNotNull()


def canonical_json(fields: str | Column) -> Column:
    """A map of texts as JSON with its keys in order and no spaces: what digests of rows are taken from."""
    entries = F.array_sort(F.map_entries(col(fields)))
    return F.to_json(F.map_from_entries(entries))
