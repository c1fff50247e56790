"""Two-level running aggregates.

``Window.partitionBy(document)`` puts a whole document in one task.  A document
can be arbitrarily long, so every running aggregate here works in two levels:
rows are windowed inside bounded segments of a key (for example blocks of
pages), one small row per segment is scanned over the key, and the carried-in
value is joined back on the same (key, segment) partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_SEGMENT = 256
ROWS_PER_SEGMENT = 4096
SEGMENT = "__segment"


def page_segment(page: str | Column = "page_number") -> Column:
    """Segment id for page-ordered rows."""
    column = F.col(page) if isinstance(page, str) else page
    return F.floor(column / F.lit(PAGES_PER_SEGMENT)).cast("bigint")


def ordinal_segment(ordinal: str | Column) -> Column:
    """Segment id for rows numbered by a dense ordinal."""
    column = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(column / F.lit(ROWS_PER_SEGMENT)).cast("bigint")


def grouped_segment(group: Column, ordinal: Column) -> Column:
    """Segment id for rows ordered by a small group number, then by a dense ordinal."""
    return group.cast("bigint") * 1_000_000_000 + ordinal_segment(ordinal)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    carries: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over ``keys`` in ``order``.

    sums     inclusive running sum
    carries  last non-null value so far, current row included
    mins     running minimum
    lags     value of the previous row (null on the first)
    totals   sum over the whole key

    ``segment`` must be non-decreasing along ``order``.
    """
    sums, carries, mins = dict(sums or {}), dict(carries or {}), dict(mins or {})
    lags, totals = dict(lags or {}), dict(totals or {})
    within = [*keys, SEGMENT]
    by_order = Window.partitionBy(*within).orderBy(*order)
    so_far = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    inputs = {
        **{f"__sum_{n}": c for n, c in sums.items()},
        **{f"__carry_{n}": c for n, c in carries.items()},
        **{f"__min_{n}": c for n, c in mins.items()},
        **{f"__lag_{n}": F.struct(c.alias("v")) for n, c in lags.items()},
        **{f"__total_{n}": c for n, c in totals.items()},
    }
    base = df.withColumns({SEGMENT: segment, **inputs})
    position = F.struct(*[F.col(o) for o in order])

    per_segment = base.groupBy(*within).agg(
        *[F.sum(f"__sum_{n}").alias(f"__sum_{n}") for n in sums],
        *[
            F.max_by(f"__carry_{n}", F.when(F.col(f"__carry_{n}").isNotNull(), position)).alias(f"__carry_{n}")
            for n in carries
        ],
        *[F.min(f"__min_{n}").alias(f"__min_{n}") for n in mins],
        *[F.max_by(f"__lag_{n}", position).alias(f"__lag_{n}") for n in lags],
        *[F.sum(f"__total_{n}").alias(f"__total_{n}") for n in totals],
        F.lit(1).alias("__one"),
    )
    over_key = Window.partitionBy(*keys)
    before = over_key.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    entering = per_segment.select(
        *within,
        *[F.sum(f"__sum_{n}").over(before).alias(f"__in_sum_{n}") for n in sums],
        *[F.last(f"__carry_{n}", ignorenulls=True).over(before).alias(f"__in_carry_{n}") for n in carries],
        *[F.min(f"__min_{n}").over(before).alias(f"__in_min_{n}") for n in mins],
        *[F.last(f"__lag_{n}").over(before).alias(f"__in_lag_{n}") for n in lags],
        *[F.sum(f"__total_{n}").over(over_key).alias(f"__all_{n}") for n in totals],
    )

    local = base.withColumns(
        {
            **{f"__sum_{n}": F.sum(f"__sum_{n}").over(so_far) for n in sums},
            **{f"__carry_{n}": F.last(f"__carry_{n}", ignorenulls=True).over(so_far) for n in carries},
            **{f"__min_{n}": F.min(f"__min_{n}").over(so_far) for n in mins},
            **{f"__lag_{n}": F.lag(f"__lag_{n}").over(by_order) for n in lags},
        }
    )
    joined = _join_null_safe(local, entering, within)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.coalesce(F.col(f"__in_sum_{n}"), F.lit(0)) + F.coalesce(F.col(f"__sum_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.coalesce(F.col(f"__carry_{n}"), F.col(f"__in_carry_{n}")).alias(n) for n in carries],
        *[F.least(F.col(f"__min_{n}"), F.col(f"__in_min_{n}")).alias(n) for n in mins],
        *[F.coalesce(F.col(f"__lag_{n}"), F.col(f"__in_lag_{n}"))["v"].alias(n) for n in lags],
        *[F.col(f"__all_{n}").alias(n) for n in totals],
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on never-null keys (documents, pages and ordinals are required fields)."""
    return left.join(right, list(keys), "left")
