"""Mixing sources to target weights by Poisson replication.

A source with ``n`` documents and target weight ``w`` (a share of the output) gets the mean repetition rate
``w * size / n``. Each document's count is the Poisson distribution with that mean, inverted at a uniform number that a
seeded hash of the document gives; the document is exploded into that many rows, and all rows are sorted by another
seeded hash, which shuffles them globally. Built-in functions only; the same rows come out at any partitioning.

Cases: null sources are a source of their own; null ids and texts are hashed as empty; repeated rows get the same count
and stay apart; a source without target weight (when weights are given) has weight 0. Empty tables give no rows. Other
columns are kept; of clashing names the added columns get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

SEED = "mix-1"
#: Hex digits of md5 that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Numbers of all sources' steps together (8 bytes each) that may be broadcast; a source has 30 to 60 at usual rates.
BROADCAST_STEPS = 2_000_000
SALTS = 32


def uniform(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def source_rates(documents: DataFrame, source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0) -> DataFrame:
    """``_source, _rate``: mean repetitions of each source. Without weights a source's weight is its count to the power ``alpha``.
    ``size`` is the rows wanted, as a multiple of the input. Only the sources are read, and counted before they are shuffled."""
    counts = documents.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if weights is None:
        weight = F.pow("_n", F.lit(float(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce("_source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = counts.select("_source", "_n", weight.alias("_w"))
    total = weighed.agg(F.sum("_w").alias("_sum"), F.sum("_n").alias("_all"))
    # the right side is one row
    return weighed.crossJoin(F.broadcast(total)).select("_source", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum") * F.col("_all") * F.lit(float(size)) / F.col("_n")).otherwise(F.lit(0.0)).alias("_rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``_source, _steps``: the cumulative Poisson distribution of each source's rate, as far as doubles tell it from 1.

    A row a step and running sums, so the work is in proportion to the steps (rate + 12 sqrt(rate) + 30)."""
    rate = F.col("_rate")
    steps = rates.select("_source", "_rate", F.explode(F.sequence(F.lit(0), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))).alias("_k"))
    upto = Window.partitionBy("_source").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.log(F.greatest(F.col("_k"), F.lit(1)).cast("double"))).over(upto)
    chance = F.when(rate > 0, F.exp(F.col("_k") * F.log(F.greatest(rate, F.lit(1e-300))) - rate - factorial)).otherwise(F.when(F.col("_k") == 0, 1.0).otherwise(0.0))
    summed = steps.withColumn("_p", chance).select("_source", F.sum("_p").over(upto).alias("_c"))
    return summed.groupBy("_source").agg(F.array_sort(F.collect_list("_c")).alias("_steps"))


def with_steps(documents: DataFrame, steps: DataFrame, source: str, id_col: str, name: str) -> DataFrame:
    """``documents`` and column ``name``, the steps of their source.

    The steps are measured first: up to ``BROADCAST_STEPS`` numbers they are broadcast, and no text is shuffled. Beyond that (many
    thousands of sources) they are joined by source and a salt of the id, so a hot source's rows are dealt over ``SALTS`` tasks and more."""
    steps = written(steps, "steps")
    total = steps.agg(F.coalesce(F.sum(F.size("_steps")), F.lit(0))).first()[0]
    key, salt, dealt = (free_name(documents, x) for x in ("_source", "_salt", "_dealt"))
    steps = steps.select(F.col("_source").alias(key), F.col("_steps").alias(name))
    if total <= BROADCAST_STEPS:
        return documents.join(F.broadcast(steps), documents[source].eqNullSafe(F.col(key)))
    salted = documents.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    copies = steps.withColumn(dealt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, salted[source].eqNullSafe(F.col(key)) & (F.col(salt) == F.col(dealt)))


def replicate(documents: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """Every row as often as its Poisson count says, with ``copy`` (from 1) and ``mix_key`` (the order of the mixed rows).

    The rows are sorted by ``mix_key``. It is a hash, evenly spread, so a row's partition follows from its first digits; no sample is
    taken, and the texts are shuffled once."""
    steps, copy, key = (free_name(documents, x) for x in ("_steps", "copy", "mix_key"))
    joined = with_steps(documents, poisson_steps(source_rates(documents, source, weights, alpha, size)), source, id_col, steps)
    # the count is the number of steps at or below the uniform number, which is bound once a row
    copies = F.flatten(F.transform(F.array(uniform(F.lit(seed), F.col(id_col))), lambda u: F.transform(F.filter(steps, lambda c: c <= u), lambda c, i: i + 1)))
    rows = joined.select(*[F.col(f"`{c}`") for c in documents.columns], F.explode(copies).alias(copy))
    rows = rows.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy).cast("string"))))
    if not shuffle:
        return rows
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * parts / F.lit(2**32)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions(key, id_col)
