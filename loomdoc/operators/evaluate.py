"""Scoring of question-answer pairs: syntax, judged triad, completeness, failure classes, final score and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lengths allowed in each field, in characters.
LENGTHS = {"q": (5, 500), "a": (2, 2000), "context": (50, 50000)}
# Weights of relevance, groundedness and context relevance.
TRIAD = {"relevance": 0.3, "groundedness": 0.5, "context_relevance": 0.2}
# Weights of syntax, statistics, triad and completeness in the final score, and scores of absent layers.
FINAL = {"syntax": 0.05, "stats": 0.05, "rag": 0.65, "quality": 0.25}
ABSENT = {"syntax": 100.0, "stats": 5.0, "rag": 0.65, "quality": 0.65}
# Least score of each grade.
GRADES = [("A+", 0.95), ("A", 0.85), ("B+", 0.75), ("B", 0.65), ("C", 0.50)]
# Failure classes in the order of priority for the primary one.
PRIORITY = ["hallucination", "faithfulness_error", "retrieval_miss", "ambiguous_question", "bad_chunk", "evaluation_error", "low_quality"]
PASS = 0.70


def syntax_errors(fields: dict[str, tuple[int, int]] = LENGTHS) -> Column:
    """Errors of fields q, a and context in that order: missing, too short or too long."""
    found = []
    for name, (least, most) in fields.items():
        c, n = F.col(name), F.length(name)
        found.append(F.when(c.isNull(), f"{name} missing").when(n < least, f"{name} too short").when(n > most, f"{name} too long"))
    return F.array_compact(F.array(*found))


def triad_average() -> Column:
    return F.round(sum((F.col(k) * F.lit(w) for k, w in TRIAD.items()), F.lit(0.0)), 3)


def failure_types() -> Column:
    """Failure classes from relevance, groundedness, context_relevance, context and avg_quality; missing scores count as 1."""
    r, g, c = (F.coalesce(F.col(k), F.lit(1.0)) for k in ("relevance", "groundedness", "context_relevance"))
    middle = (g >= 0.4) & (g < 0.6) & (r >= 0.6)
    first = F.array_compact(
        F.array(
            F.when(g < 0.4, "hallucination"),
            F.when(middle | ((r >= 0.6) & (g < 0.6)), "faithfulness_error"),
            F.when(~middle & ((r < 0.6) | (g < 0.6)), "retrieval_miss"),
            F.when(c < 0.6, "poor_context"),
            F.when(F.length(F.regexp_replace(F.coalesce("context", F.lit("")), r"(?U)^\s+|\s+$", "")) < 100, "bad_chunk"),
        )
    )
    poor = F.coalesce(F.col("avg_quality"), F.lit(1.0)) < PASS
    return F.when((F.size(first) == 0) & poor, F.array(F.lit("low_quality"))).otherwise(first)


def primary_failure(types: Column) -> Column:
    """The class of highest priority, else the first."""
    ranked = F.filter(F.array(*[F.lit(p) for p in PRIORITY]), lambda p: F.array_contains(types, p))
    return F.coalesce(F.try_element_at(ranked, F.lit(1)), F.try_element_at(types, F.lit(1)))


def passes(types: Column) -> Column:
    """Completeness passes, unless the answer is made up or unfaithful."""
    hard = F.arrays_overlap(types, F.array(F.lit("hallucination"), F.lit("faithfulness_error")))
    return (F.col("avg_quality") >= PASS) & ~hard


def final_score(syntax: Column, stats: Column, rag: Column, quality: Column) -> Column:
    """Weighted score of the layers: syntax in percent, statistics out of ten, the others out of one."""
    s, t, r, q = (F.coalesce(c, F.lit(ABSENT[k])) for c, k in ((syntax, "syntax"), (stats, "stats"), (rag, "rag"), (quality, "quality")))
    return s / 100 * FINAL["syntax"] + F.least(t, F.lit(10.0)) / 10 * FINAL["stats"] + r * FINAL["rag"] + q * FINAL["quality"]


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][1], GRADES[0][0])
    for name, least in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("F")


def score_summary(scores: DataFrame, columns: dict[str, float]) -> DataFrame:
    """``metric, mean, std, below_pct`` (population deviation) of score columns, given the threshold of each."""
    tall = scores.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v"), F.lit(t).alias("t")) for k, t in columns.items()])).alias("x")).select("x.*").filter("v is not null")
    return tall.groupBy("metric").agg(F.round(F.avg("v"), 3).alias("mean"), F.round(F.stddev_pop("v"), 3).alias("std"), F.round(100.0 * F.count_if(F.col("v") < F.col("t")) / F.count(F.lit(1)), 1).alias("below_pct"))


def entropy(rows: DataFrame, column: str, name: str = "entropy") -> DataFrame:
    """One row: Shannon entropy (bits) of a column's distribution, three places; 0 without rows."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # sum(-p log p) = log N - sum(n log n) / N: sums only, so partial sums are made before the shuffle
    return counts.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(F.coalesce(F.round(F.log2("all") - F.col("s") / F.col("all"), 3), F.lit(0.0)).alias(name))


def dimension_severities(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``dimension, pct_below, std_dev, severity, rank``: critical over 30 % of the rows below the threshold, warning over 15 %; rank of these by share."""
    one = score_summary(scores, thresholds).select(F.col("metric").alias("dimension"), F.col("below_pct").alias("pct_below"), F.col("std").alias("std_dev"))
    p = F.col("pct_below")
    # a row a dimension, so the window is over a handful of rows
    rank = F.row_number().over(Window.orderBy(F.desc("pct_below"), "dimension"))
    return one.withColumn("severity", F.when(p > 30, "critical").when(p > 15, "warning").otherwise("ok")).withColumn("rank", F.when(p > 15, rank))


def dataset_messages(syntax: Column, stats: Column, rag: Column, quality: Column) -> Column:
    """Keys of the messages about a dataset, from the layers' scores (absent ones count as 1); ``good`` if there is none."""
    r, q = F.coalesce(rag, F.lit(1.0)), F.coalesce(quality, F.lit(1.0))
    best = (syntax >= 95) & (stats >= 7) & (r >= 0.80) & (q >= 0.80)
    found = F.array_compact(F.array(F.when(syntax < 90, "syntax"), F.when(stats < 6, "diversity"), F.when(r < 0.70, "rag"), F.when(q < 0.70, "quality"), F.when(best, "excellent")))
    return F.when(F.size(found) == 0, F.array(F.lit("good"))).otherwise(found)


def failing_items(scores: DataFrame, key: str, thresholds: dict[str, float], n: int) -> DataFrame:
    """``key, mean_score, issues``: the ``n`` worst rows with a mean of ``rag`` and ``avg_quality`` below 0.7 and a dimension below its threshold, lowest first."""
    mean = (F.coalesce("rag", F.lit(1.0)) + F.coalesce("avg_quality", F.lit(1.0))) / 2
    issues = F.array_compact(F.array(*[F.when(F.col(c) < t, F.struct(F.round(c, 3).alias("score"), F.lit(c).alias("dimension"))) for c, t in thresholds.items()]))
    rows = scores.select(key, F.round(mean, 3).alias("mean_score"), mean.alias("_mean"), F.array_sort(issues).alias("issues")).filter((F.col("_mean") < PASS) & (F.size("issues") > 0))
    return rows.orderBy("mean_score", key).limit(n).select(key, "mean_score", F.array_join(F.transform("issues", lambda x: x["dimension"]), ",").alias("issues"))


def status() -> Column:
    """fail, hold or success of a scored row (``avg_quality, rag, pass, types``); missing scores count as 0."""
    q, r = F.coalesce("avg_quality", F.lit(0.0)) < PASS, F.coalesce("rag", F.lit(0.0)) < PASS
    return F.when(q & r, "fail").when(~F.col("pass") | (F.size("types") > 0) | q | r, "hold").otherwise("success")


def with_judge_errors(scores: DataFrame, failed: Column, absent: Column) -> DataFrame:
    """Scores of rows whose judge ``failed`` (0.65 each, not passed) or is ``absent`` (0.65 for the triad, 0.5 for completeness), with ``passed``."""
    triad = [F.when(failed | absent, 0.65).otherwise(F.col(c)).alias(c) for c in TRIAD]
    quality = F.when(failed, ABSENT["quality"]).when(absent, 0.5).otherwise(F.col("avg_quality"))
    passed = F.when(failed, False).otherwise(quality >= PASS)
    return scores.select(*[c for c in scores.columns if c not in TRIAD and c not in ("avg_quality", "passed")], *triad, quality.alias("avg_quality"), passed.alias("passed"))


def layer_summary(scores: DataFrame) -> DataFrame:
    """One row: means of the layers. A missing score of the triad counts as its constant; rows without completeness don't count for its mean."""
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(ABSENT["rag"]))), 5).alias(f"avg_{c}")
    passed = F.round(F.try_divide(100.0 * F.count_if(F.col("completeness") >= PASS), F.count(F.lit(1))), 2)
    return scores.agg(F.count(F.lit(1)).alias("evaluated"), mean("relevance"), mean("groundedness"), F.round(F.avg("completeness"), 5).alias("avg_completeness"), F.count("completeness").alias("with_completeness"), passed.alias("pass_rate"))
