"""Aggregates by position in the sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


ACCURACY = 1000


def latency_summary(df: DataFrame, value: str, by: list[str], points: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Count, mean and the values at index ``floor(n * p)`` (the last at most) of each group; nulls don't count.

    A first pass gives bounds between which each value must lie: approximate percentiles, whose rank is off by no more
    than ``n / accuracy``, four such errors to either side. Only values between them, some hundredths of a group and
    each once with its count, are shuffled and ranked, so a group that holds most rows isn't sorted in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    edge, names = 4 / accuracy, list(points)
    around = [q for p in points.values() for q in (max(0.0, p - edge), min(1.0, p + edge))]
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", around, accuracy).alias("cuts"))
    own = groups.select(*(F.col(c).alias(f"g_{c}") for c in by), "n", "cuts")
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in by]
    held = rows.join(own, same) if by else rows.crossJoin(own)
    at = [F.least(F.floor(F.col("n") * p), F.col("n") - 1) for p in points.values()]
    cut = [(F.col("cuts")[2 * j], F.col("cuts")[2 * j + 1]) for j in range(len(names))]
    kinds = [F.struct(F.lit(j).alias("point"), at[j].alias("target"), F.when(F.col("v") >= low, F.col("v")).alias("v")) for j, (low, _) in enumerate(cut)]
    # a row for each point it isn't above; those below the bounds have no value and are only counted
    kept = F.filter(F.array(*kinds), lambda x: x["v"].isNull() | ~F.element_at(F.array(*(F.col("v") > high for _, high in cut)), x["point"] + 1))
    counted = held.select(*by, F.inline(kept)).groupBy(*by, "point", "target", F.col("v").alias("found")).agg(F.count("*").alias("many"))
    upto = F.sum("many").over(Window.partitionBy(*by, "point").orderBy(F.col("found").asc_nulls_first()))
    placed = counted.withColumn("upto", upto).where((F.col("upto") > F.col("target")) & (F.col("upto") - F.col("many") <= F.col("target")))
    picked = placed.groupBy(*(F.col(c).alias(f"p_{c}") for c in by)).agg(*(F.max(F.when(F.col("point") == j, F.col("found"))).alias(name) for j, name in enumerate(names)))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in by]
    both = groups.join(picked, same) if by else groups.crossJoin(picked)
    return both.select(*by, "n", "mean", "least", "most", *(F.coalesce(F.col(n), F.raise_error(F.lit("a percentile lies outside its bounds")).cast("double")).alias(n) for n in names))


def ratio(long: Column, short: Column) -> Column:
    return F.when(short != 0, long / short)


def linear_cost(short_ms: Column, short_words: int, long_ms: Column, long_words: int) -> Column:
    """(per_word, fixed): cost of a word and of a call, from two lengths."""
    per_word = (long_ms - short_ms) / (long_words - short_words)
    return F.struct(per_word.alias("per_word"), (short_ms - per_word * short_words).alias("fixed"))
