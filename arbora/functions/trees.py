"""Small arithmetic of tree and cluster planning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V


def plan_tree_levels(n: Column, compression: int = V.TREE_COMPRESSION, min_nodes: int = V.TREE_MIN_NODES) -> Column:
    """Planned node count per level: divide (rounding up) while enough nodes remain, then one root."""
    if compression < 2:
        raise ValueError("compression must be at least 2, otherwise levels never shrink")
    current = F.lit(n).cast("bigint") if not isinstance(n, Column) else n.cast("bigint")

    def step(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        following = F.ceil(last / F.lit(float(compression))).cast("bigint")
        return F.when((last >= min_nodes) & (following < last), F.concat(levels, F.array(following))).otherwise(levels)

    shrinking = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.array(current), step)
    rooted = F.when(
        (F.size(shrinking) > 1) & (F.element_at(shrinking, -1) > 1),
        F.concat(shrinking, F.array(F.lit(1).cast("bigint"))),
    ).otherwise(shrinking)
    return F.when(current <= 0, F.array().cast("array<bigint>")).otherwise(rooted)


def default_cluster_count(n: Column) -> Column:
    guess = F.ceil(F.sqrt(n.cast("double") / F.lit(2.0)))
    return F.greatest(F.lit(2), F.least(F.lit(5), guess)).cast("int")


def resolve_target_clusters(n: Column, requested: Column) -> Column:
    return (
        F.when(n <= 1, n.cast("int"))
        .when(requested.isNotNull(), F.greatest(F.lit(1), F.least(requested.cast("int"), n.cast("int"))))
        .otherwise(default_cluster_count(n))
    )


def page_distance(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Gap between two page spans, 0 when they touch; zero pages count as missing."""

    def span(start: Column, end: Column) -> tuple[Column, Column]:
        first = F.coalesce(F.nullif(start, F.lit(0)), F.nullif(end, F.lit(0)), F.lit(0))
        return first, F.coalesce(F.nullif(end, F.lit(0)), first)

    a0, a1 = span(start_a, end_a)
    b0, b1 = span(start_b, end_b)
    return F.when(a1 < b0, b0 - a1).when(b1 < a0, a0 - b1).otherwise(F.lit(0))


def path_of(hierarchy: Column) -> Column:
    """Section path: the non-empty keys of a heading hierarchy."""
    keys = F.transform(hierarchy, lambda item: item["key"])
    return F.coalesce(
        F.filter(keys, lambda k: k.isNotNull() & (k != "")), F.array().cast("array<string>")
    )


def shared_hierarchy(sample: Column, path: Column) -> Column:
    """Leading part of ``sample`` that ends at the last key of ``path``."""
    empty = F.slice(sample, 1, 0)
    last_key = F.try_element_at(path, F.lit(-1))
    at = F.array_position(F.transform(sample, lambda item: item["key"]), last_key)
    return F.when(F.size(path) == 0, empty).when(at > 0, F.slice(sample, F.lit(1), at.cast("int"))).otherwise(sample)


def shared_value(column: str | Column, *, allow_null: bool) -> Column:
    """Aggregate: the value all members share, else null.

    With ``allow_null`` a group whose members are all null "shares" null, which is
    the same result; the flag matters to callers that test for presence.
    """
    value = F.col(column) if isinstance(column, str) else column
    same = F.min(value).eqNullSafe(F.max(value))
    complete = F.count(value) == F.count(F.lit(1))
    if allow_null:
        return F.when(same & (complete | (F.count(value) == 0)), F.min(value))
    return F.when(same & complete, F.min(value))
