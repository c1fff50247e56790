"""Mixing sources to target weights.

``source_rates`` adds up the words of each source (combined on the map side, so a source that holds a third of all
rows sends one row per task) and turns weights into targets and repetition rates. ``mix`` then gives each document
``floor(rate)`` copies and one more with probability ``rate - floor(rate)``, drawn from a seeded hash of the document,
so reruns and retries agree. Documents never shuffle when the rates table is small enough for the planner to
broadcast (it is written first, so its size is known); otherwise the planner joins by source and splits hot sources.

Defined cases: null and empty texts have size 0 and still get copies; a null source is a source of its own, last in
order; sources without words get target 0 and rate 0; repeated rows draw the same coin; an empty table gives an empty
result. Columns of the input that clash with ``source_size``, ``target``, ``rate``, ``size`` or ``copies`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import cut, unused, word_count

#: Weights by the order of source names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words; most repetitions of a source.
TOTAL_SHARE, MOST_REPEATS = 1.5, 2.0


def source_rates(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """One row per source: ``_source``, ``source_size``, ``target``, ``rate``.

    Targets share ``total_share`` of all words by weight. A target above ``most`` times its source is cut to that and
    the excess goes to the others by weight. Sources are cut in the order of size per weight, so the final level is
    found by running sums over the table of sources, which has one row for each.
    """
    sizes = documents.groupBy(F.col("source").alias("_source")).agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("*", weight.cast("double").alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("_source").asc_nulls_last())
    before, whole = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # level: words per weight if this source and all after it were not cut
    level = (F.sum("source_size").over(whole) * F.lit(total_share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(final, F.lit(float("inf"))) * F.col("w"))
    return levels.withColumn("target", target).select(
        "_source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def coin(seed: int, key: str) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(documents: DataFrame, seed: int = 11, key: str = "doc_id", **rules) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``, the times each is taken."""
    rates = cut(source_rates(documents, **rules))
    mine = documents.select(*[c for c in documents.columns if c.lower() not in ("source_size", "target", "rate", "size", "copies")])
    (own,) = unused(mine.columns, "_source")
    rates = rates.withColumnRenamed("_source", own)
    joined = mine.join(rates, mine["source"].eqNullSafe(rates[own])).drop(own)
    extra = F.when(coin(seed, key) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumns({"size": word_count(F.col("text")), "copies": (F.floor("rate") + extra).cast("int")})


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy."""
    (own,) = unused(columns, "_copy")
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(own)).drop(own)
