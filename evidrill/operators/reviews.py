"""Second looks at an evaluation set: scope flags, overlap audits, batches, challenge candidates, judge outputs, gates.

Every audit is a plan over whole tables; what must not happen comes out as rows, which ``require_none`` turns into an
error where a stage has to stop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.text import contains_any, norm_ws, strip_code_fence
from evidrill.operators.curation import best_match, canonical_duplicates, grams_of, similar_pairs, similar_texts
from evidrill.operators.retrieval import numbered, ranked
from evidrill.sources.scratch import write_once

# What a judge's answer must hold.
SCORE_FIELDS = ("evidence_support", "safety_boundary", "refusal_correctness")
FLAG_FIELDS = ("unsupported_claim", "unsafe_suggestion", "under_refusal")
WINNERS = ("A", "B", "tie")
DRY_RUN = ("dry_run_not_executed", "planned_not_executed")
# The parts of a usage ledger.
USAGE_FIELDS = ("external_model_calls", "input_tokens", "output_tokens", "estimated_cost")
# Confidence in falling order.
CONFIDENCE = ("high", "medium", "low")
# End of the fixed values.


def scope_flags(rows: DataFrame, medication_terms: Sequence[str], other_claims: Sequence[str], reject_terms: Sequence[str], promotable: Sequence[str]) -> DataFrame:
    """Promotable rows whose question may lie outside the scope, with reasons; nothing is changed.

    ``rows(id, unit, outcome, question, reason, claim_types array, evidence_types array, risk_labels array)``. A row
    without a medication term is flagged for a claim of another kind, or for a sibling of its unit that was rejected
    for its scope.
    """
    rejected = rows.where((F.col("outcome") == "reject") & contains_any("reason", reject_terms)).select("unit").distinct().withColumn("sibling", F.lit(True))
    said = F.concat_ws(" ", "question", "claim_types", "evidence_types", "risk_labels")
    df = rows.where(F.col("outcome").isin(*promotable)).join(rejected, "unit", "left").withColumn("unlinked", ~contains_any(said, medication_terms))
    other = F.arrays_overlap(F.concat("claim_types", "evidence_types"), F.array(*map(F.lit, other_claims)))
    sibling = F.coalesce("sibling", F.lit(False))
    reasons = F.array_compact(F.array(F.when(other | sibling, F.lit("no_explicit_medication_link")), F.when(other, F.lit("non_medication_claim_type")), F.when(sibling, F.lit("sibling_scope_inconsistency"))))
    return df.where("unlinked").withColumn("reasons", reasons).where(F.size("reasons") > 0).select("id", "unit", "reasons")


def method_pairs(outputs: DataFrame, identity: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(all pairs of two usable outputs of a sample in the order of methods, samples with fewer than two).

    ``outputs(sample_id, method_id, cache_key, status, raw_output)``; a pair's key is the digest of the sample, the
    methods, their cache keys and ``identity``. Methods of a sample are few, so pairs are as many as the outputs' square
    within a sample only.
    """
    usable = outputs.where(F.col("status").isin("success", "cache_hit") & (F.trim(F.coalesce("raw_output", F.lit(""))) != ""))
    side = lambda s: usable.select("sample_id", F.col("method_id").alias(f"method_{s}"), F.col("cache_key").alias(f"key_{s}"))
    pairs = side("a").join(side("b"), "sample_id").where("method_a < method_b")
    key = F.sha2(F.concat_ws("|", F.col("sample_id").cast("string"), "method_a", "method_b", "key_a", "key_b", *map(F.lit, identity)), 256)
    few = usable.groupBy("sample_id").agg(F.count("*").alias("usable_outputs")).where("usable_outputs < 2")
    return pairs.withColumn("judge_cache_key", key), few


def parent_by_anchor(parents: DataFrame) -> DataFrame:
    """(anchor_id, parent_id): the first parent that stands on one anchor alone; ``parents(parent_id, anchor_ids)``."""
    single = parents.where(F.size("anchor_ids") == 1).select(F.col("anchor_ids")[0].alias("anchor_id"), "parent_id")
    return single.groupBy("anchor_id").agg(F.min("parent_id").alias("parent_id"))


def challenge_candidates(specs: DataFrame, anchors: DataFrame, parents: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(candidates for explicit specifications, specifications that cannot be met and why).

    ``specs(anchor_id, question, decision)``, ``anchors(anchor_id, ...)``. A candidate takes the anchor's provenance and
    its parent's unit; an anchor is used once.
    """
    times = specs.withColumn("uses", F.count("*").over(Window.partitionBy("anchor_id")))
    df = times.join(anchors.withColumn("_anchor", F.lit(True)), "anchor_id", "left").join(parent_by_anchor(parents), "anchor_id", "left")
    problem = F.when(F.col("uses") > 1, "anchor_used_again").when(F.col("_anchor").isNull(), "unknown_anchor").when(F.col("parent_id").isNull(), "no_parent").when(norm_ws("question") == "", "empty_question")
    df = df.withColumn("problem", problem)
    ident = F.concat(F.lit("BV1S-"), F.substring(F.sha2(F.concat_ws("|", F.col("anchor_id").cast("string"), norm_ws("question"), F.lit(version)), 256), 1, 16))
    scenario = F.when(F.col("decision") == "boundary_refusal", "prescription-boundary").otherwise("evidence-scope")
    good = df.where("problem IS NULL").withColumn("candidate_id", ident).withColumn("scenario", scenario)
    return good.drop("problem", "uses", "_anchor"), df.where("problem IS NOT NULL").select("anchor_id", "problem")


def overlap_decision(questions: DataFrame, others: DataFrame, threshold: float, n: int = 3, name: str = "parent", same_unit: bool = True) -> DataFrame:
    """Exact, near or no repetition of each question among ``others``: (id, decision, reason, other_id).

    ``questions(id, norm[, unit])``, ``others(id, norm[, unit])`` with normalised texts. Without ``same_unit``, rows of
    the question's own unit are not compared. Exact comes before near, near before keep.
    """
    unit = [] if same_unit else ["unit"]
    asked = write_once(questions.select("id", "norm", *unit), "questions")
    given = write_once((others if same_unit else others.where("unit IS NOT NULL")).select("id", "norm", *unit), "others")
    # equal texts are compared once: of a text's rows the first stands for it, and the first of any unit but that one's
    if same_unit:
        held = given.groupBy("norm").agg(F.min("id").alias("first"))
        other = F.col("first")
    else:
        units = given.groupBy("norm", "unit").agg(F.min("id").alias("id"))
        first = units.groupBy("norm").agg(F.min(F.struct("id", "unit")).alias("of"))
        held = units.join(first, "norm").groupBy("norm").agg(F.first("of.id").alias("first"), F.first("of.unit").alias("first_unit"), F.min(F.when(F.col("unit") != F.col("of.unit"), F.col("id"))).alias("second"))
        other = F.when(F.col("first_unit") != F.col("unit"), F.col("first")).when(F.col("first_unit") == F.col("unit"), F.col("second"))
    held = write_once(held, "other-texts")
    texts = write_once(asked.groupBy("norm").agg(F.min("id").alias("text_id")), "question-texts")
    # from here on rows go by the ids of their texts, and no join shuffles a text again
    asked_ids = write_once(asked.join(texts.withColumnRenamed("norm", "_norm"), F.col("norm").eqNullSafe(F.col("_norm"))).select("id", *unit, "text_id"), "question-rows")
    exact = texts.join(held, "norm").drop("norm")
    links = similar_pairs(grams_of(texts, "text_id", "norm", n), grams_of(held, "first", "norm", n), threshold, n=n)
    linked = links.join(held.drop("norm").withColumn("right_id", F.col("first")), "right_id").withColumnRenamed("left_id", "text_id")
    keys = asked_ids.groupBy("text_id", *unit).agg(F.min("id").alias("left_id"))
    near = keys.join(linked, "text_id").select("left_id", other.alias("right_id"), "similarity").where("right_id IS NOT NULL")
    best = keys.join(best_match(near), "left_id").select(*[F.col(c).alias(f"_{c}") for c in ("text_id", *unit)], F.col("right_id").alias("near_id"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("text_id", *unit)])
    df = asked_ids.join(exact, "text_id", "left").withColumn("exact_id", other).join(best, same, "left").withColumnRenamed("id", "left_id")
    decision = F.when(F.col("exact_id").isNotNull(), "reject").when(F.col("near_id").isNotNull(), "needs_review").otherwise("keep")
    reason = F.when(F.col("exact_id").isNotNull(), f"exact_question_{name}").when(F.col("near_id").isNotNull(), f"near_duplicate_{name}")
    return df.select(F.col("left_id").alias("id"), decision.alias("decision"), reason.alias("reason"), F.coalesce("exact_id", "near_id").alias("other_id"))


def near_other_units(candidates: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """(id): rows (id, norm, unit) with an equal or a near text in another unit.

    Equal texts are compared once; whether a unit other than a row's own holds a linked text is seen from the least and
    the greatest of their units.
    """
    rows = write_once(candidates.where("norm <> ''").select("id", "norm", "unit"), "texts")
    texts = write_once(rows.groupBy("norm").agg(F.min("id").alias("text_id"), F.min("unit").alias("lo"), F.max("unit").alias("hi")), "distinct-texts")
    grams = grams_of(texts, "text_id", "norm", n)
    links = write_once(similar_pairs(grams, grams, threshold, self_join=True, n=n), "links")
    both = reduce(DataFrame.unionByName, [links.select(F.col(a).alias("at"), F.col(b).alias("text_id")) for a, b in (("left_id", "right_id"), ("right_id", "left_id"))])
    met = both.join(texts, "text_id").select("at", "lo", "hi").unionByName(texts.select(F.col("text_id").alias("at"), "lo", "hi"))
    reach = met.groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = texts.select("norm", "text_id").join(reach.withColumnRenamed("at", "text_id"), "text_id")
    return rows.join(known, "norm").where("unit <> lo OR unit <> hi").select("id").distinct()


def overlap_audit(candidates: DataFrame, dev: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """(id, decision, reasons) of candidates against a development set and one another, and who stands for them.

    ``candidates(id, norm, unit)``, ``dev(id, norm)``. An exact question of the development set rejects; of equal
    candidates the least id stays and the others are rejected; near questions of the set, or of another unit, need a
    review. ``canonical_id`` is the least id of the equal ones.
    """
    against = overlap_decision(candidates.select("id", "norm"), dev, threshold, n, "dev")
    same = canonical_duplicates(candidates.select("id", "norm"), "id", F.col("norm")).select("id", "canonical_id")
    close = near_other_units(candidates, threshold, n).withColumn("_near", F.lit(True))
    df = against.join(same, "id").join(close, "id", "left")
    copy = F.col("canonical_id") != F.col("id")
    review = F.coalesce("_near", F.lit(False))
    decision = F.when((F.col("decision") == "reject") | copy, "reject").when((F.col("decision") == "needs_review") | review, "needs_review").otherwise("keep")
    reasons = F.array_compact(F.array(F.col("reason"), F.when(copy, F.lit("duplicate_candidate")), F.when(review & ~copy, F.lit("near_duplicate_candidate"))))
    return df.select("id", decision.alias("decision"), reasons.alias("reasons"), "canonical_id")


def reaudit(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(id, decision, reasons) of revised questions from their decisions against several sets, worst first."""
    worst = {"keep": 0, "needs_review": 1, "reject": 2}
    rank = reduce(lambda w, kv: F.when(F.col("decision") == kv[0], kv[1]).otherwise(w), worst.items(), F.lit(0))
    rows = reduce(DataFrame.unionByName, [p.withColumn("place", F.lit(i)) for i, p in enumerate(parts.values())])
    reasons = F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct((-rank).alias("w"), "place", "reason")))), lambda x: x["reason"])
    g = rows.groupBy("id").agg(F.max(rank).alias("w"), reasons.alias("reasons"))
    return g.select("id", F.when(F.col("w") == 2, "reject").when(F.col("w") == 1, "needs_review").otherwise("clear").alias("decision"), "reasons")


def decision_coverage(drafts: DataFrame, decisions: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """What keeps a review from covering its drafts exactly once: (id, problem), no rows where it does.

    ``drafts(id, ...)``, ``decisions(id, decision)``. A draft may be without a decision or have several, a decision may
    be of no draft or not one of those allowed.
    """
    given = decisions.groupBy("id").agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(F.col("decision").isin(*allowed), F.lit(False))).alias("_good"))
    both = drafts.select("id", F.lit(True).alias("_draft")).distinct().join(given, "id", "full_outer")
    problem = F.when(F.col("_draft").isNull(), "unknown_id").when(F.col("_n").isNull(), "not_decided").when(F.col("_n") > 1, "decided_again").when(~F.col("_good"), "decision_not_allowed")
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def author_batches(drafts: DataFrame, by: str, order: Sequence[str], size: int) -> DataFrame:
    """Drafts in batches of at most ``size`` that hold one source's each, numbered through in the sources' order."""
    rows = ranked(drafts, [by], [F.col(o) for o in order], name="_nth").withColumn("_part", F.floor((F.col("_nth") - 1) / size))
    batches = rows.groupBy(by).agg(F.max("_part").alias("_last"))
    first = numbered(batches, [F.col(by)], name="_n").withColumn("_start", F.sum(F.col("_last") + 1).over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.join(first.select(F.col(by).alias("_by"), "_start"), F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn("batch", (F.coalesce("_start", F.lit(0)) + F.col("_part") + 1).cast("int")).select(*drafts.columns, "batch")


def after_review(audited: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates that stay after manual decisions, rows of the review that are not decided).

    ``audited(id, decision, ...)``, ``review(id, manual_decision)``. Rejected candidates go; one that needs review stays
    only if it was kept by hand.
    """
    manual = review.groupBy("id").agg(F.max(F.when(F.col("manual_decision").isin("keep", "reject"), F.col("manual_decision"))).alias("manual"))
    open_rows = review.where(~F.coalesce(F.col("manual_decision").isin("keep", "reject"), F.lit(False)))
    df = audited.join(manual, "id", "left")
    stays = (F.col("decision") != "reject") & ~F.coalesce(F.col("manual") == "reject", F.lit(False)) & ((F.col("decision") != "needs_review") | F.coalesce(F.col("manual") == "keep", F.lit(False)))
    return df.where(stays).drop("manual"), open_rows


def apply_batch(queue: DataFrame, batch: DataFrame, fields: Sequence[str], key: str = "id", order: str = "place", done: str = "outcome") -> tuple[DataFrame, DataFrame]:
    """C17: (queue with the batch's fields filled in, rows of the batch that may not be applied and why).

    A batch may only append: ids are known and unique, no finished row is overwritten, and the batch is exactly the
    next pending rows of the queue.
    """
    pending = numbered(queue.where(F.trim(F.coalesce(F.col(done).cast("string"), F.lit(""))) == "").select(key, order), [F.col(order)], name="_next")
    size = batch.agg(F.count("*").alias("_size"))
    given = batch.withColumn("_uses", F.count("*").over(Window.partitionBy(key)))
    state = given.join(queue.select(key, F.col(done).alias("_done")), key, "left").join(pending.select(key, "_next"), key, "left").join(queue.select(key, F.lit(True).alias("_known")), key, "left").crossJoin(F.broadcast(size))
    problem = F.when(F.col("_uses") > 1, "repeated_id").when(F.col("_known").isNull(), "unknown_id").when(F.col("_next").isNull(), "already_done").when(F.col("_next") > F.col("_size"), "not_next_in_order")
    state = state.withColumn("problem", problem)
    good = state.where("problem IS NULL").select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = queue.join(good, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_{f}"), F.col(f)))
    return out.select(*queue.columns), state.where("problem IS NOT NULL").select(key, "problem")


def apply_reaudit(rows: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the re-audit's status and digest, reports that may not be applied and why).

    ``rows(id, outcome, question, final_question, reaudit_status, reaudit_sha256)``, ``reports(id, question,
    final_question, decision, payload, sha256)``. Write once: only revised rows without a result, questions as they
    are, the digest that of the payload, and the decision clear.
    """
    own = rows.select("id", "outcome", "question", "final_question", "reaudit_status", F.lit(True).alias("_known"))
    theirs = reports.select("id", *[F.col(c).alias(f"_{c}") for c in ("question", "final_question", "decision", "payload", "sha256")])
    state = theirs.join(own, "id", "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown_id")
        .when(F.coalesce(F.col("outcome"), F.lit("")) != "revise", "not_revised")
        .when(F.coalesce("reaudit_status", F.lit("")) != "", "already_audited")
        .when(F.sha2("_payload", 256) != F.col("_sha256"), "digest_differs")
        .when((norm_ws("_question") != norm_ws("question")) | (norm_ws("_final_question") != norm_ws("final_question")), "question_differs")
        .when(F.coalesce("_decision", F.lit("")) != "clear", "not_clear")
    )
    state = state.withColumn("problem", problem)
    good = state.where("problem IS NULL").select("id", F.col("_sha256").alias("_digest"))
    out = rows.join(good, "id", "left").withColumn("reaudit_status", F.when(F.col("_digest").isNotNull(), "clear").otherwise(F.col("reaudit_status"))).withColumn("reaudit_sha256", F.coalesce("_digest", "reaudit_sha256"))
    return out.select(*rows.columns), state.where("problem IS NOT NULL").select("id", "problem")


def judge_errors(rows: DataFrame, allow_empty_dry_run: bool = True) -> DataFrame:
    """(row_id, status, skipped, valid, errors) of judge outputs: JSON objects with a winner, two answers, a reason.

    ``rows(row_id, status, raw_output)``. A field must be there with its own kind: scores are whole numbers from 1 to 3,
    flags booleans.
    """
    text = strip_code_fence("raw_output")
    empty = F.trim(F.coalesce("raw_output", F.lit(""))) == ""
    df = rows.withColumn("v", F.try_parse_json(text)).withColumn("empty", empty)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("NONE"))
    value = lambda path: F.try_variant_get("v", path, "string")
    errors = [F.when(~F.coalesce(value("$.winner").isin(*WINNERS) & (kind("$.winner") == "STRING"), F.lit(False)), F.lit("winner_invalid"))]
    for answer in ("answer_a", "answer_b"):
        there = kind(f"$.{answer}").startswith("OBJECT")
        errors.append(F.when(~there, F.lit(f"{answer}_missing_or_not_object")))
        for f in SCORE_FIELDS:
            good = (kind(f"$.{answer}.{f}") == "BIGINT") & F.try_variant_get("v", f"$.{answer}.{f}", "bigint").between(1, 3)
            errors.append(F.when(there & ~F.coalesce(good, F.lit(False)), F.lit(f"{answer}.{f}_not_int_1_to_3")))
        for f in FLAG_FIELDS:
            errors.append(F.when(there & (kind(f"$.{answer}.{f}") != "BOOLEAN"), F.lit(f"{answer}.{f}_not_bool")))
    reason = (kind("$.rationale") == "STRING") & (F.trim(F.coalesce(value("$.rationale"), F.lit(""))) != "")
    errors.append(F.when(~reason, F.lit("rationale_missing_or_not_string")))
    skipped = F.col("empty") & F.lit(allow_empty_dry_run) & F.coalesce(F.col("status").isin(*DRY_RUN), F.lit(False))
    found = (
        F.when(skipped, F.array(F.lit("dry_run_empty_output_skipped")))
        .when(F.col("empty"), F.array(F.lit("empty_output")))
        .when(F.col("v").isNull(), F.array(F.lit("json_decode_error")))
        .when(~kind("$").startswith("OBJECT"), F.array(F.lit("parse_error")))
        .otherwise(F.array_compact(F.array(*errors)))
    )
    out = df.select("row_id", F.coalesce("status", F.lit("unknown")).alias("status"), skipped.alias("skipped"), found.alias("errors"))
    return out.withColumn("valid", F.size("errors") == 0)


def over_budget(plan: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """(name, actual, maximum) of the planned calls and sums of columns that exceed their limits; no rows is a pass.

    ``limits`` maps ``calls`` or a column to its maximum.
    """
    sums = plan.agg(*[(F.count("*") if n == "calls" else F.coalesce(F.sum(n), F.lit(0))).cast("double").alias(n) for n in limits])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("actual"), F.lit(float(m)).alias("maximum")) for n, m in limits.items()])
    return sums.select(F.explode(rows).alias("x")).select("x.*").where("actual > maximum")


def method_matrix(plan: DataFrame, methods: Sequence[str]) -> DataFrame:
    """K9: samples that lack a method, have another one, or one twice: (sample_id, missing, unexpected, repeated)."""
    per = plan.groupBy("sample_id", "method_id").agg(F.count("*").alias("n"))
    g = per.groupBy("sample_id").agg(F.collect_set("method_id").alias("m"), F.count_if(F.col("n") > 1).alias("repeated"))
    want = F.array(*map(F.lit, methods))
    g = g.select("sample_id", F.size(F.array_except(want, "m")).alias("missing"), F.size(F.array_except("m", want)).alias("unexpected"), "repeated")
    return g.where("missing + unexpected + repeated > 0")


def frozen_drift(settings: DataFrame, frozen: Mapping[str, str]) -> DataFrame:
    """K6: (name, expected, actual) of frozen settings that another value stands for now; ``settings(name, value)``."""
    want = settings.sparkSession.createDataFrame(sorted(frozen.items()), "name string, expected string")
    both = want.join(settings.select("name", F.col("value").cast("string").alias("actual")), "name", "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def with_usage(df: DataFrame) -> DataFrame:
    """K8: ``df`` with a ledger that says that no model was called."""
    return df.withColumn("usage", F.struct(*[F.lit(0.0 if f == "estimated_cost" else 0).cast("double" if f == "estimated_cost" else "long").alias(f) for f in USAGE_FIELDS]))


def used(df: DataFrame) -> DataFrame:
    """K8: rows whose ledger is missing or not zero."""
    return df.where(reduce(Column.__or__, [~F.coalesce(F.col(f"usage.{f}") == 0, F.lit(False)) for f in USAGE_FIELDS]))


def sample_limit(plan: DataFrame, limit: int, order: str) -> DataFrame:
    """The rows of the first ``limit`` samples in the order in which the plan names them first."""
    first = plan.groupBy("sample_id").agg(F.min(order).alias("_first")).orderBy("_first", "sample_id").limit(limit)
    return plan.join(F.broadcast(first.select("sample_id")), "sample_id")


def by_confidence(drafts: DataFrame, confidence: str = "confidence", order: str = "draft_order") -> DataFrame:
    """Place in the review: high before medium before low before all else, then the drafts' order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col(confidence)), F.lit(0))
    return numbered(drafts, [F.when(rank == 0, len(CONFIDENCE) + 1).otherwise(rank), F.col(order)], name="review_place")


def preselect(candidates: DataFrame, priority: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` candidates of each source by topic priority, granularity near 512, length near 600, page, id.

    ``candidates(source_id, id, page_number, granularity, length, topics array)``.
    """
    places = F.array(*[F.when(F.array_contains("topics", t), F.lit(i)) for i, t in enumerate(priority)])
    topic = F.coalesce(F.array_min(F.array_compact(places)), F.lit(len(priority)))
    return ranked(candidates, ["source_id"], [topic, F.abs(F.col("granularity") - 512), F.abs(F.col("length") - 600), F.col("page_number"), F.col("id")], limit, "place")


def config_winner(summaries: DataFrame, metrics: Sequence[str], order: str = "method_id") -> DataFrame:
    """The row with the greatest metrics in turn, those with a leading minus least; ties go to the first by ``order``."""
    keys = [(F.col(m[1:]).asc() if m[0] == "-" else F.col(m).desc()) for m in metrics]
    return summaries.orderBy(*keys, order).limit(1)


def merge_pools(first: DataFrame, second: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(both pools as one, keys that both or either hold twice); a merge is valid where the second has no rows."""
    both = first.unionByName(second)
    return both.orderBy(key), both.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def selection_violations(split: DataFrame, pool: DataFrame, quarantine: DataFrame, targets: Mapping[str, Mapping[str, int]], immutable: Sequence[str], units: Sequence[str], threshold: float, dev: DataFrame | None = None, n: int = 3) -> DataFrame:
    """Every broken rule of a selection and its split, as (violation, what).

    ``split(id, dataset_split, decision, norm, ...)``, ``pool(id, ...)``, ``quarantine(id)``. Checked are: unique ids;
    selected rows stand in the pool with the same immutable fields and not in quarantine; decisions of each split meet
    their target; no unit (fact, anchor group, page, ...) and no near-duplicate question stands on both sides; nothing
    is shared with a development set ``dev(id, ...)``.
    """
    said = lambda df, name, what: df.select(F.lit(name).alias("violation"), what.cast("string").alias("what"))
    ident = F.col("id")
    # every rule reads them: plans of the inputs would be planned and run again for each
    split, pool = write_once(split, "split"), write_once(pool.select("id", *immutable), "pool")
    out = [
        said(split.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL"), "repeated_id", ident),
        said(split.join(pool.select("id"), "id", "left_anti"), "not_in_pool", ident),
        said(split.join(quarantine.select("id"), "id", "left_semi"), "quarantined", ident),
    ]
    parent = pool.select("id", *[F.col(c).alias(f"_{c}") for c in immutable])
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in immutable])
    out.append(said(split.join(parent, "id").where(differs), "label_drift", ident))
    wanted = split.sparkSession.createDataFrame([(s, d, int(k)) for s, t in targets.items() for d, k in t.items()] or [("", "", 0)], "dataset_split string, decision string, wanted long")
    counts = split.groupBy("dataset_split", "decision").agg(F.count("*").alias("n"))
    off = wanted.join(counts, ["dataset_split", "decision"], "full_outer").na.fill(0, ["wanted", "n"]).where("wanted <> n")
    out.append(said(off, "decision_drift", F.concat_ws(":", "dataset_split", "decision")))
    for u in units:
        both = split.where(F.col(u).isNotNull()).groupBy(u).agg(F.count_distinct("dataset_split").alias("n")).where("n > 1")
        out.append(said(both, f"shared_{u}", F.col(u)))
        if dev is not None and u in dev.columns:
            out.append(said(split.select(u).distinct().join(dev.select(u).distinct(), u), f"dev_{u}", F.col(u)))
    near = similar_texts(split, threshold, n)
    side = lambda k, s: split.select(F.col("id").alias(k), F.col("dataset_split").alias(s))
    across = near.join(side("left_id", "ls"), "left_id").join(side("right_id", "rs"), "right_id").where("ls <> rs")
    out.append(said(across, "near_duplicate_across", F.concat_ws("|", "left_id", "right_id")))
    if dev is not None:
        out.append(said(split.join(dev.select("id"), "id", "left_semi"), "dev_id", ident))
    return reduce(DataFrame.unionByName, out)
