"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall in cells of source, language and topic. Token weights of the cells are raked in turn to the target
marginals of each dimension for a fixed number of sweeps; a cell's weight per token, scaled so
that the sample meets a token budget and cut at 1, is the probability that a document of it is taken. Everything is a DataFrame expression: cells are aggregated, raked by
window sums and joined back.

Targets default to the tempered token shares of the data. Defined results: null sources, languages and topics are
cells of their own; a null or empty text has no tokens, weighs nothing and keeps its cell's probability (1 if the whole
cell has no tokens); repeated rows with one id are taken or left together; an empty table gives an empty result. Extra
columns of the input are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.llm.common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Cells up to this number are broadcast (three short texts and three numbers each); more are joined by shuffle.
BROADCAST_CELLS = 50_000


@dataclass(frozen=True)
class MixSettings:
    temperature: float = 0.5  #: default target shares are token shares to this power
    sweeps: int = 6
    budget: float = 0.5  #: expected tokens of the sample as a share of all
    fills: int = 8  #: rounds that find the scale at which the sample, cells taken whole included, meets the budget
    seed: str = "mix"


def topic_of(text: str = "text") -> Column:
    """A document's kind of content by what it holds, first match wins: the third dimension of the mixture."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("@"), "contact").when(t.contains("http"), "web").when(t.contains("\n"), "prose").otherwise("line")


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_draw(seed: str) -> Column:
    """A number in [0, 1) from the id: the same for every run, engine and partitioning."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _keys(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{d}") for d in DIMENSIONS]


def rake(cells: DataFrame, settings: MixSettings, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells (source, lang, topic, tokens) with weight: tokens raked to the marginals, and share_<dim> targets.

    ``targets`` may give (value, share) for a dimension; shares of values that are not in the data are left out and
    the rest is scaled to 1.
    """
    whole = Window.partitionBy()
    for d in DIMENSIONS:
        if targets and d in targets:
            own = targets[d].select(F.col("value").alias("v"), F.col("share").cast("double").alias(f"raw_{d}"))
            cells = cells.join(own, cells[d].eqNullSafe(own["v"]), "left").drop("v").withColumn(f"raw_{d}", F.coalesce(f"raw_{d}", F.lit(0.0)))
        else:
            cells = cells.withColumn(f"raw_{d}", F.pow(F.sum("tokens").over(Window.partitionBy(d)).cast("double"), F.lit(settings.temperature)))
        # each value of the dimension counts once, however many cells it has
        first = F.row_number().over(Window.partitionBy(d).orderBy(*[F.col(x).asc_nulls_first() for x in DIMENSIONS])) == 1
        cells = cells.withColumn("first", first)
        cells = cells.withColumn(f"share_{d}", F.col(f"raw_{d}") / F.sum(F.when(F.col("first"), F.col(f"raw_{d}")).otherwise(0.0)).over(whole)).drop("first", f"raw_{d}")
    cells = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(whole).cast("double"))
    for _ in range(settings.sweeps):
        for d in DIMENSIONS:
            total = F.sum("weight").over(Window.partitionBy(d))
            cells = cells.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"share_{d}") / total).otherwise(0.0))
    return cells


def mixture(docs: DataFrame, settings: MixSettings = MixSettings(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells with tokens, weight and probability, written once to the shared folder."""
    named = docs.select("source", "lang", topic_of().alias("topic"), token_count().alias("n"))
    cells = materialize(named.groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens"), F.count("*").alias("documents")), "cells")
    return materialize(calibrate(rake(cells, settings, targets), settings), "mixture")


def calibrate(cells: DataFrame, settings: MixSettings) -> DataFrame:
    """Cells with probability min(1, scale * weight / tokens); the scale spreads the budget over cells not taken whole."""
    whole = Window.partitionBy()
    left = F.lit(settings.budget) * F.sum("tokens").over(whole)
    cells = cells.withColumn("scale", left)
    for _ in range(settings.fills):
        full = F.coalesce(F.col("scale") * F.col("weight") >= F.col("tokens"), F.lit(True))
        room = left - F.coalesce(F.sum(F.when(full, F.col("tokens"))).over(whole), F.lit(0))
        cells = cells.withColumn("scale", F.try_divide(room, F.sum(F.when(~full, F.col("weight"))).over(whole)))
    p = F.least(F.lit(1.0), F.when(F.col("tokens") > 0, F.col("scale") * F.col("weight") / F.col("tokens")))
    return cells.withColumn("probability", F.when((F.col("tokens") > 0) & F.col("scale").isNotNull(), p).otherwise(1.0))


def fit_report(cells: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """(dimension, value, target, reached, missed) of a mixture's marginals, and the budget as dimension ``budget``.

    Shares of the raked weights, and of the tokens that the sample is expected to have; raking leaves a marginal off its
    target where the sweeps were too few or no weights meet all targets, sampling where cells are taken whole.
    """
    whole = cells.agg(F.sum("weight").alias("all_weight"), F.sum("tokens").alias("all_tokens"))
    both = cells.crossJoin(F.broadcast(whole))
    parts = [both.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.first(f"share_{d}").alias("target"), F.sum(F.col("weight") / F.col("all_weight")).alias("reached")) for d in DIMENSIONS]
    parts.append(both.agg(F.lit("budget").alias("dimension"), F.lit(None).cast("string").alias("value"), F.lit(settings.budget).alias("target"), (F.sum(F.col("tokens") * F.col("probability")) / F.max("all_tokens")).alias("reached")))
    return reduce(DataFrame.unionByName, parts).withColumn("missed", F.abs(F.col("reached") - F.col("target")))


def add_probability(docs: DataFrame, settings: MixSettings = MixSettings(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with topic, probability, draw and kept (draw < probability)."""
    cells = mixture(docs, settings, targets)
    right = cells.select(*[F.col(d).alias(f"__mix_{d}") for d in DIMENSIONS], "probability")
    if cells.count() <= BROADCAST_CELLS:
        right = F.broadcast(right)
    left = docs.drop("probability", "draw", "kept", "topic").withColumn("topic", topic_of())
    same = F.lit(True)
    for d in DIMENSIONS:  # nulls are equal; still an equi-join to Catalyst
        same = same & left[d].eqNullSafe(right[f"__mix_{d}"])
    joined = left.join(right, same).drop(*[f"__mix_{d}" for d in DIMENSIONS])
    return joined.withColumn("draw", unit_draw(settings.seed)).withColumn("kept", F.col("draw") < F.col("probability"))


def sample_documents(docs: DataFrame, settings: MixSettings = MixSettings(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities take, with their own columns only."""
    return add_probability(docs, settings, targets).where("kept").select(*docs.columns)


def oracle_sql(settings: MixSettings = MixSettings(), documents: str = "documents", final: str | None = None) -> str:
    """DuckDB SQL for the query's rows, with the sweeps written out."""
    topic = "CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '@') THEN 'contact' WHEN contains(t, 'http') THEN 'web' WHEN contains(t, chr(10)) THEN 'prose' ELSE 'line' END"
    steps = [
        f"WITH d AS MATERIALIZED (SELECT *, {topic} AS topic, len(list_filter(regexp_split_to_array(t, '[\\x09-\\x0D ]+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM {documents}))",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        steps.append(f"t_{x} AS MATERIALIZED (SELECT {x}, r / sum(r) OVER () AS share FROM (SELECT {x}, pow(sum(tokens), {settings.temperature}) AS r FROM c GROUP BY {x}))")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c)")
    k = 0
    for _ in range(settings.sweeps):
        for x in DIMENSIONS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN sum(w.weight) OVER (PARTITION BY w.{x}) > 0 THEN w.weight * t.share / sum(w.weight) OVER (PARTITION BY w.{x}) ELSE 0 END AS weight) FROM w{k} w JOIN t_{x} t ON w.{x} IS NOT DISTINCT FROM t.{x})")
            k += 1
    steps.append(f"f0 AS MATERIALIZED (SELECT *, {settings.budget} * sum(tokens) OVER () AS scale FROM w{k})")
    full = "coalesce(scale * weight >= tokens, true)"
    for i in range(settings.fills):
        steps.append(f"f{i + 1} AS MATERIALIZED (SELECT * REPLACE (({settings.budget} * sum(tokens) OVER () - coalesce(sum(CASE WHEN {full} THEN tokens END) OVER (), 0)) / nullif(sum(CASE WHEN NOT {full} THEN weight END) OVER (), 0) AS scale) FROM f{i})")
    steps.append(f"p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 AND scale IS NOT NULL THEN least(1.0, scale * weight / tokens) ELSE 1.0 END AS probability FROM f{settings.fills})")
    draw = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{settings.seed}'), 1, 8)) AS BIGINT) / 4294967296.0"
    last = final or f"SELECT d.doc_id, d.topic, round(p.probability, 9) AS probability, {draw} < p.probability AS kept FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"
    return ",\n".join(steps) + "\n" + last
