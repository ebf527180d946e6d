r"""Quality rules as a short-circuit cascade.

Each rule's cost and the documents that it rejects are measured on a bounded sample; the cascade then runs the rules
in the order of rejection per cost, each next rule judged on what the ones before it leave, and stops at a document's
first rejection. The verdict is the same for every order; only the work differs. A rule's cost is what it adds to the
work that is done for every document anyway.

Words are ``[^\x20\x09-\x0D]+``; lines are split at \n and count if they hold a word. Defined results: a null text
counts as empty, has no words and fails the base rule; repeated rows get equal results; a document passes a rule whose
ratio has a zero denominator. Extra columns are kept.
"""

from __future__ import annotations

import copy
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import add_by_text, map_arrow, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents that costs and selectivities are measured on; they only set the order of the rules.
SAMPLE_ROWS = 400


class Text:
    """A document's text as UTF-8; what rules share is computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        joined = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        return int(((joined & 0xC0) != 0x80).sum())  # bytes that begin a code point

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight words that occur twice or more, the first occurrence included."""
        words = self.words
        if len(words) <= WINDOW:
            return 0
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        n = len(h) - WINDOW + 1
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        _, inverse, counts = np.unique(rolled, return_inverse=True, return_counts=True)
        found = np.flatnonzero(counts[inverse] > 1)
        if not len(found):
            return 0
        seen: dict[tuple, list[int]] = {}
        for i in found.tolist():  # the words themselves decide, not their hashes
            seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for starts in seen.values():
            if len(starts) > 1:
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.array(starts) + WINDOW, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())

    @cached_property
    def upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def ascii_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER + _UPPER.lower()))

    @cached_property
    def n_wordless(self) -> int:
        """Words without a letter; every character beyond ASCII counts as one."""
        return sum(1 for w in self.words if not _LETTER.search(w))

    @cached_property
    def top_word(self) -> int:
        """How often the most frequent word occurs."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip().startswith(_BULLETS) for x in self.lines)

    @cached_property
    def n_unfinished(self) -> int:
        return sum(x.rstrip().endswith(_ELLIPSES) for x in self.lines)


_UPPER = bytes(range(65, 91))
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_BULLETS = (b"-", b"*", "•".encode())
_ELLIPSES = (b"...", "…".encode())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Ratios are compared in whole numbers, so that SQL and Python agree to the last bit.
RULES = (
    Rule("word_length", lambda t: t.word_chars < 2 * len(t.words) or t.word_chars > 20 * len(t.words)),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * len(t.words)),
    Rule("dup_lines", lambda t: 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("shouting", lambda t: 2 * t.upper > t.ascii_letters),
    Rule("wordless", lambda t: 5 * t.n_wordless > len(t.words)),
    Rule("one_word", lambda t: 10 * t.top_word > 3 * len(t.words)),
    Rule("bullets", lambda t: 10 * t.n_bullets > 9 * len(t.lines)),
    Rule("unfinished", lambda t: 10 * t.n_unfinished > 3 * len(t.lines)),
)


def base_failed(t: Text) -> bool:
    return len(t.words) < 20 or 100 * t.n_repeat_words > 30 * len(t.words)


@dataclass(frozen=True)
class Measured:
    """A rule's place in the cascade: seconds a document, and the share of what reaches it that it rejects."""

    name: str
    seconds: float
    rejected: float


def judged(t: Text) -> bool:
    """Does what the query does for every document, and tells whether the cascade sees it."""
    return not base_failed(t) and bool((t.word_chars, t.n_symbols, t.n_dup_lines))


def seen(t: Text) -> bool:
    """Every document, with nothing done before."""
    return True


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, before: Callable[[Text], bool] = judged) -> list[Measured]:
    """Measure the rules on the documents whose id hashes lowest, after ``before``, and order them greedily."""
    sample = docs.select("doc_id", "text").join(F.broadcast(docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()), "doc_id").select("text")

    def measurer():
        def work(b: pa.RecordBatch):
            texts = [t for t in map(Text, utf8(b.column(0))) if before(t)]
            if not texts:
                return
            spent, hits = [], []
            for r in rules:
                fresh = [copy.copy(t) for t in texts]  # with what is shared by all, and nothing of the rules before
                start = time.perf_counter()
                hits.append([r.rejects(t) for t in fresh])
                spent.append((time.perf_counter() - start) / len(texts))
            yield pa.record_batch([pa.array([len(texts)], pa.int64()), pa.array([spent]), pa.array([hits])], names=["n", "spent", "hits"])

        return work

    rows = map_arrow(sample, measurer, "n long, spent array<double>, hits array<array<boolean>>").limit(sample_rows).collect()
    if not rows:
        return [Measured(r.name, 0.0, 0.0) for r in rules]
    n = np.array([r.n for r in rows], dtype=float)
    cost = np.maximum((np.array([r.spent for r in rows]) * n[:, None]).sum(0) / n.sum(), 1e-9)
    hits = np.concatenate([np.array(r.hits, dtype=bool).reshape(len(rules), -1) for r in rows], axis=1)
    alive, left, order = np.ones(hits.shape[1], dtype=bool), list(range(len(rules))), []
    while left:
        share = {i: float(hits[i][alive].mean()) if alive.any() else 0.0 for i in left}
        best = max(left, key=lambda i: (share[i] / cost[i], -cost[i]))
        order.append(Measured(rules[best].name, float(cost[best]), share[best]))
        alive &= ~hits[best]
        left.remove(best)
    return order


def apply_cascade(docs: DataFrame, plan: list[Measured], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with rejected_by, the first rule of the plan that rejects the text, or null, and rules_run."""
    ordered = _in_order(plan, rules)

    def judge():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = [next(((r.name, k) for k, r in enumerate(ordered, 1) if r.rejects(t)), (None, len(ordered))) for t in map(Text, utf8(texts))]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())]

        return work

    return add_by_text(docs, {"rejected_by": "string", "rules_run": "int"}, judge)


def _in_order(plan: list[Measured], rules: tuple[Rule, ...]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[m.name] for m in plan]


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_documents(docs: DataFrame, plan: list[Measured], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the statistics, base_failed and kept; the cascade runs only on what the base rule leaves."""
    ordered = _in_order(plan, rules)

    def judge():
        def work(b: pa.RecordBatch):
            rows = []
            for t in map(Text, utf8(b.column(1))):
                failed = base_failed(t)
                kept = not failed and not any(r.rejects(t) for r in ordered)
                rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            columns = list(zip(*rows))
            numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
            yield pa.record_batch([b.column(0), *numbers, *(pa.array(c, pa.bool_()) for c in columns[5:])], names=["doc_id", *STATISTICS, "base_failed", "kept"])

        return work

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in STATISTICS) + ", base_failed boolean, kept boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), judge, schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda w: w <> '') AS ws
  FROM documents
), line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\x09-\x0D ]*[-*•]')) AS n_bullets, count(*) FILTER (regexp_matches(line, '([.][.][.]|…)[\x09-\x0D ]*$')) AS n_unfinished
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x09-\x0D ]')
  GROUP BY doc_id
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice)
  GROUP BY doc_id
), word AS (
  SELECT doc_id, max(c) AS top_word, sum(CASE WHEN regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]') THEN 0 ELSE c END) AS n_wordless
  FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_bullets, 0) AS n_bullets, coalesce(n_unfinished, 0) AS n_unfinished, coalesce(top_word, 0) AS top_word, coalesce(n_wordless, 0) AS n_wordless,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_n,
         length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS ascii_n
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN word USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 2 * upper_n > ascii_n OR 5 * n_wordless > n_words OR 10 * top_word > 3 * n_words
            OR 10 * n_bullets > 9 * n_lines OR 10 * n_unfinished > 3 * n_lines) AS kept
FROM b
"""
