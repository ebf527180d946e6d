"""From chunks to reviewed anchors and candidate questions: topics, candidates, review queue, promotion, roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.rules import PICTURE_PLACEHOLDER, REFERENCE_HEADING
from evidrill.functions.text import blank, contains_any, norm_ws
from evidrill.operators.contracts import quarantine

# Signals that a short text is more than a title.
SENTENCE_SIGNAL = r"[。；;.!！?？：:]"
DOSE_SIGNAL = r"(?i)\d+(?:\.\d+)?\s*(?:mg|g|ml|μg|ug)(?:\s*/\s*kg)?"
DOT_LEADERS = r"(?:\.{3,}|…{2,}|·{3,})"
ROLES = ("supported", "boundary")
# End of the fixed values.


def title_only(text: str | Column, most_chars: int = 160) -> Column:
    """A short text of at most two lines with neither sentence marks nor a dose, after its heading marks."""
    t = blank(text)
    plain = F.trim(F.regexp_replace(t, r"^\s{0,3}#{1,6}\s*", ""))
    lines = F.size(F.filter(F.split(plain, r"\R"), lambda x: F.trim(x) != ""))
    return (F.length(t) <= most_chars) & (lines <= 2) & ~plain.rlike(SENTENCE_SIGNAL) & ~plain.rlike(DOSE_SIGNAL)


def low_information(text: str | Column, page: str | Column, least: int = 30, most: int = 6000) -> Column:
    """Nothing to review: no page, too short or long, leftovers of pictures, reference lists, tables of contents, titles."""
    t = blank(text)
    p = F.col(page) if isinstance(page, str) else page
    contents = F.regexp_count(t, F.lit(DOT_LEADERS)) >= 2
    return F.coalesce(p <= 0, F.lit(True)) | (F.length(t) < least) | (F.length(t) > most) | t.rlike(PICTURE_PLACEHOLDER) | t.rlike(REFERENCE_HEADING) | contents | title_only(t)


def match_topics(text: str | Column, topics: Mapping[str, Sequence[str]]) -> Column:
    """Matched topics in the order of their names, each with its matched terms; one pass over the text."""
    t = F.lower(blank(text))
    entries = []
    for topic in sorted(topics):
        terms = sorted({w for w in topics[topic] if w.strip()}, key=str.lower)
        hits = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w.lower())), F.lit(w)) for w in terms])) if terms else F.array().cast("array<string>")
        entries.append(F.struct(F.lit(topic).alias("topic"), hits.alias("terms")))
    return F.filter(F.array(*entries), lambda e: F.size(e["terms"]) > 0)


def candidate_id(source: str, page: str, text: str) -> Column:
    return F.concat(F.lit("CAND-"), F.substring(F.sha2(F.concat_ws("|", F.col(source).cast("string"), F.col(page).cast("string"), F.col(text)), 256), 1, 20))


def anchor_candidates(chunks: DataFrame, topics: Mapping[str, Sequence[str]]) -> DataFrame:
    """C11: Informative chunks with a topic, first of each (source, page, text) by granularity, under content-bound ids.

    ``chunks(source_id, page_number, granularity, block_type, content)``.
    """
    rows = chunks.withColumn("raw_text", norm_ws("content")).where(~low_information("raw_text", "page_number"))
    rows = rows.withColumn("topics", match_topics("raw_text", topics)).where(F.size("topics") > 0).withColumn("candidate_id", candidate_id("source_id", "page_number", "raw_text"))
    w = Window.partitionBy("candidate_id").orderBy("granularity", "block_type")
    first = rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return first.select("candidate_id", "source_id", "page_number", "granularity", "block_type", "raw_text", F.array_join(F.transform("topics", lambda e: e["topic"]), ",").alias("matched_topics"), F.lit("candidate_unverified").alias("review_status"))


def source_status(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates of each source of the coverage matrix, and whether it has any."""
    n = candidates.groupBy("source_id").agg(F.count("*").alias("candidate_count"))
    return sources.select("source_id").join(n, "source_id", "left").na.fill(0).withColumn("status", F.when(F.col("candidate_count") > 0, "candidates_ready").otherwise("no_candidates"))


def split_overlap(candidates: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible, overlapping): candidates off and on the (source, page) pairs of the development set."""
    keys = ["source_id", "page_number"]
    pairs = used.select(*keys).distinct()
    return candidates.join(pairs, keys, "left_anti"), candidates.join(pairs, keys, "left_semi")


def provenance_failures(candidates: DataFrame, coverage: DataFrame, fields: Sequence[str], key: str = "source_id") -> DataFrame:
    """Candidates with the fields in which they differ from their source's row; an unknown source fails as a whole."""
    c = coverage.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields], F.lit(True).alias("_known"))
    df = candidates.join(c, key, "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_c_{f}")), F.lit(f)) for f in fields]))
    return df.withColumn("failed", F.when(F.col("_known").isNull(), F.array(F.lit("unknown_source"))).otherwise(wrong)).drop("_known", *[f"_c_{f}" for f in fields])


def promotion(reviews: DataFrame, least_chars: int = 10) -> DataFrame:
    """Decision on each reviewed anchor: the first reason that rejects it, or ``promoted``.

    ``reviews(source_id, candidate_id, decision, anchor_text, raw_text)``; of equal anchors the first by source and
    candidate stays.
    """
    text = norm_ws("anchor_text")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    w = Window.partitionBy(F.col("_t"), F.col("_ok")).orderBy("source_id", "candidate_id")
    checks = [
        ("not_accepted", F.coalesce(F.col("decision") != "accepted", F.lit(True))),
        ("too_short", F.length(text) < least_chars),
        ("garbled", F.contains(text, F.lit("�")) | text.rlike(r"\?{2,}")),
        ("unreadable", letters < F.lit(0.25) * F.length(text)),
        ("not_traceable", ~F.contains(norm_ws("raw_text"), text)),
    ]
    df = quarantine(reviews, checks, ok="promoted").withColumn("_t", text).withColumn("_ok", F.col("reason") == "promoted")
    df = df.withColumn("reason", F.when(F.col("_ok") & (F.row_number().over(w) > 1), "duplicate_anchor").otherwise(F.col("reason")))
    return df.drop("_t", "_ok")


def boundary_decision(claim_types: Column, scope: Column, boundary: Column, insufficient_types: Sequence[str], insufficient_terms: Sequence[str], refusal_terms: Sequence[str]) -> Column:
    """Expected decision of a boundary question; insufficient evidence goes before refusal, refusal before review."""
    lacking = F.arrays_overlap(claim_types, F.array(*[F.lit(t) for t in insufficient_types])) | contains_any(F.concat_ws(" ", scope, boundary), insufficient_terms)
    return F.when(lacking, "insufficient_evidence").when(contains_any(boundary, refusal_terms), "boundary_refusal").otherwise("review_required")


def candidate_roles(anchors: DataFrame, decision: Column) -> DataFrame:
    """C14: Two candidates of each anchor: one that its scope supports and one beyond it, with their expected decisions."""
    rows = anchors.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES])))
    rows = rows.withColumn("expected_decision", F.when(F.col("role") == "supported", "allow_supported_answer").otherwise(decision))
    return rows.withColumn("question_id", F.concat(F.lit("Q-"), F.substring(F.sha2(F.concat_ws("|", "anchor_id", "role"), 256), 1, 20)))


def reviewed_pool(candidates: DataFrame, decisions: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates that the author accepted, with the decision; a candidate without one is pending, not lost."""
    return candidates.join(decisions.select(key, "author_decision"), key, "left").withColumn("pool_status", F.when(F.col("author_decision") == "accept", "accepted").when(F.col("author_decision").isNull(), "pending").otherwise("rejected"))


# Words that name the parts of a text which is no evidence, or a patient whom evidence is for.
CITATION_MARKER = r"(?:\[|［)\s*\d+\s*(?:\]|］)"
LEADERS = r"(?:\.{3,}|…{3,})"
REFERENCE_TERMS = ("参考文献", "references", "bibliography")


def shortlist_noise(text: str | Column) -> Column:
    """two dot leaders or more, as tables of contents have."""
    return F.regexp_count(norm_ws(text), F.lit(LEADERS)) >= 2


def is_relevant(text: str | Column, title: str | Column, terms: Sequence[str] = (), max_citations: int = 1, reference_terms: Sequence[str] = REFERENCE_TERMS) -> Column:
    """F8: no noise, no list of references, few citation marks, and, where ``terms`` are given, one in title or text."""
    t = norm_ws(text)
    cited = F.regexp_count(t, F.lit(CITATION_MARKER)) > max_citations
    about = contains_any(norm_ws(title), terms, ignore_case=True) | contains_any(t, terms, ignore_case=True) if terms else F.lit(True)
    return ~shortlist_noise(text) & ~contains_any(t, reference_terms, ignore_case=True) & ~cited & about


def scope_limited(evidence_types: Column, limited: Sequence[str]) -> Column:
    """a source all of whose evidence types, one at least, are limited in scope."""
    return (F.size(evidence_types) > 0) & (F.size(F.array_except(evidence_types, F.array(*map(F.lit, limited)))) == 0)


def context_of_page(candidates: DataFrame) -> DataFrame:
    """For each candidate the longest text of its page, ties by granularity, then id: (id, context_id).

    ``candidates(id, source_id, page_number, granularity, text)``.
    """
    key = F.struct(F.length(norm_ws("text")), "granularity", "id")
    pages = candidates.groupBy("source_id", "page_number").agg(F.max_by("id", key).alias("context_id"))
    return candidates.select("id", "source_id", "page_number").join(pages, ["source_id", "page_number"]).select("id", "context_id")
