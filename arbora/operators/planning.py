"""Cluster diagnostics, merge targets and merging of undersized clusters.

Members: document_id, id, ord, cluster_no, content, page_start, page_end,
layout_partition (and optionally party_enclave).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import text, trees
from arbora.operators.clustering import cluster_labels
from arbora.operators.scan import grouped_segment, ordinal_segment, prefix_scan
from arbora.session import cut_lineage

CLUSTER = ["document_id", "cluster_no"]


def leaf_cards(nodes: DataFrame) -> DataFrame:
    """Snippet, word count and partition of each node."""
    return nodes.select(
        "id",
        "document_id",
        "chunk_index",
        "page_start",
        "page_end",
        text.word_count(F.coalesce("content", F.lit(""))).alias("n_words"),
        text.snippet(F.col("content")).alias("snippet"),
        "layout_partition",
    )


def _zero_is_null(column):
    return F.nullif(column, F.lit(0))


def cluster_diagnostics(members: DataFrame) -> DataFrame:
    """Counts, page span, partition and status of every cluster."""
    shared = trees.shared_value(F.nullif("layout_partition", F.lit("")), allow_null=False)
    options = [shared]
    if "party_enclave" in members.columns:
        options.append(trees.shared_value(F.nullif("party_enclave", F.lit("")), allow_null=False))
    sums = members.groupBy(*CLUSTER).agg(
        F.sum(text.word_count(F.coalesce("content", F.lit("")))).alias("word_count"),
        F.count(F.lit(1)).alias("node_count"),
        _zero_is_null(F.min(F.coalesce("page_start", F.lit(0)))).alias("page_start"),
        _zero_is_null(F.max(F.coalesce("page_end", F.lit(0)))).alias("page_end"),
        F.coalesce(*options, F.lit("mixed")).alias("layout_partition"),
        F.min("ord").alias("first_ord"),
    )
    tiny = F.col("word_count") < V.TINY_GROUP_WORDS
    enough = F.col("word_count") >= V.MIN_SUMMARY_WORDS
    return sums.withColumns(
        {
            "cluster_id": cluster_labels(F.col("cluster_no")),
            "is_tiny": tiny,
            "is_summarizable": enough,
            "is_below_summary_minimum": ~enough,
            "status": F.when(~enough, "invalid").when(tiny, "tiny").otherwise("summarizable"),
        }
    )


def cluster_members(members: DataFrame) -> DataFrame:
    """Member cards in order, the flat form of a cluster's node list."""
    cards = leaf_cards(members).drop("document_id")
    return members.select(*CLUSTER, "id", "ord").join(cards, "id")


def merge_candidates(diagnostics: DataFrame) -> DataFrame:
    """The one pool of partners each tiny cluster chooses from, and its size.

    Partition beats size class beats distance, so only one pool can hold the
    best partner: large clusters of the own partition, else tiny ones of it,
    else any large cluster, else any tiny one.  No pairs are formed.
    """
    counts = diagnostics.groupBy("document_id", "layout_partition").agg(
        F.count_if(~F.col("is_tiny")).alias("__big"), F.count_if("is_tiny").alias("__small")
    )
    totals = counts.groupBy("document_id").agg(F.sum("__big").alias("__all_big"), F.sum("__small").alias("__all_small"))
    tiny = diagnostics.where("is_tiny").join(counts, ["document_id", "layout_partition"]).join(totals, "document_id")
    own = F.concat(F.lit("="), F.col("layout_partition"))
    choice = (
        F.when(F.col("__big") > 0, F.struct(own.alias("pool"), F.lit(False).alias("pool_tiny"), F.col("__big").alias("n")))
        .when(F.col("__small") > 1, F.struct(own.alias("pool"), F.lit(True).alias("pool_tiny"), (F.col("__small") - 1).alias("n")))
        .when(F.col("__all_big") > 0, F.struct(F.lit("*").alias("pool"), F.lit(False).alias("pool_tiny"), F.col("__all_big").alias("n")))
        .when(F.col("__all_small") > 1, F.struct(F.lit("*").alias("pool"), F.lit(True).alias("pool_tiny"), (F.col("__all_small") - 1).alias("n")))
    )
    first = F.coalesce("page_start", "page_end", F.lit(0))
    last = F.coalesce("page_end", first)
    return tiny.withColumn("c", choice).select(
        *CLUSTER,
        F.least(first, last).alias("first_page"),
        F.greatest(first, last).alias("last_page"),
        F.col("c.pool").alias("pool"),
        F.col("c.pool_tiny").alias("pool_tiny"),
        F.coalesce("c.n", F.lit(0).cast("bigint")).alias("n_candidates"),
    )


def best_merge_target(diagnostics: DataFrame) -> DataFrame:
    """``merge_target`` of every tiny cluster: nearest pages, then fewest words, then lowest number.

    Overlapping partners are found through the pages both touch, the nearest
    disjoint ones by carrying the last seen span end (or start) along the pages.
    """
    sources = cut_lineage(merge_candidates(diagnostics).where(F.col("pool").isNotNull()))
    first = F.coalesce("page_start", "page_end", F.lit(0))
    last = F.coalesce("page_end", first)
    partners = diagnostics.select(
        "document_id",
        F.explode(F.array(F.concat(F.lit("="), F.col("layout_partition")), F.lit("*"))).alias("pool"),
        F.col("is_tiny").alias("pool_tiny"),
        F.least(first, last).alias("p_first"),
        F.greatest(first, last).alias("p_last"),
        F.struct("word_count", F.col("cluster_no").alias("partner")).alias("rank_key"),
    )
    pool = ["document_id", "pool", "pool_tiny"]

    # Partners sharing a page: the two best per page are enough, one may be the source itself.
    on_page = partners.select(*pool, "rank_key", F.explode(F.sequence("p_first", "p_last")).alias("page"))
    two_best = Window.partitionBy(*pool, "page").orderBy("rank_key")
    kept = on_page.withColumn("__r", F.row_number().over(two_best)).where("__r <= 2").drop("__r")
    pages = sources.select(*CLUSTER, "pool", "pool_tiny", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    touching = (
        pages.join(kept, [*pool, "page"])
        .where(F.col("rank_key.partner") != F.col("cluster_no"))
        .groupBy(*CLUSTER)
        .agg(F.min(F.struct(F.lit(0).alias("distance"), "rank_key")).alias("found"))
    )

    def nearest(edge: str, side: str, sign: int):
        """Closest partner wholly before (sign 1) or after (sign -1) each source."""
        edges = partners.groupBy(*pool, F.col(edge).alias("at")).agg(F.min("rank_key").alias("rank_key"))
        marks = edges.select(
            *pool, (F.col("at") * sign).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("cluster_no"), "rank_key"
        ).unionByName(
            sources.select(*pool, (F.col(side) * sign).alias("at"), F.lit(0).alias("kind"), "cluster_no"),
            allowMissingColumns=True,
        )
        seen = prefix_scan(
            marks,
            pool,
            ["at", "kind", "cluster_no"],
            ordinal_segment("at"),
            carries={"seen": F.when(F.col("kind") == 1, F.struct("at", "rank_key"))},
        )
        return seen.where((F.col("kind") == 0) & F.col("seen").isNotNull()).select(
            *CLUSTER,
            F.struct((F.col("at") - F.col("seen.at")).cast("int").alias("distance"), F.col("seen.rank_key").alias("rank_key")).alias("found"),
        )

    options = touching.unionByName(nearest("p_last", "first_page", 1)).unionByName(nearest("p_first", "last_page", -1))
    best = options.groupBy(*CLUSTER).agg(F.min("found").alias("found"))
    return best.select(*CLUSTER, F.col("found.rank_key.partner").alias("merge_target"), F.col("found.distance").alias("distance"))


def merge_components(diagnostics: DataFrame, targets: DataFrame) -> DataFrame:
    """Map every cluster to its merged cluster, numbered by smallest member.

    A tiny cluster points at its target, all others at themselves; doubling the
    pointers follows every chain in a logarithmic number of rounds.  Chains of
    tiny clusters may end in a ring; a ring is named by its smallest number.
    """
    start = diagnostics.join(targets.select(*CLUSTER, "merge_target"), CLUSTER, "left").select(
        *CLUSTER, F.coalesce(F.when(F.col("is_tiny"), F.col("merge_target")), F.col("cluster_no")).alias("ptr")
    )
    links = cut_lineage(start.withColumn("low", F.least("cluster_no", "ptr")))
    # A chain of n clusters is followed in log2(n) doublings: pointers and lows of all rows after 2^r steps, each round
    # cut. Rows stop to change once every walk has been round its ring; the walk of a document needs its width, no more.
    width = Window.partitionBy("document_id")
    moving, settled, steps = links.withColumn("n", F.count(F.lit(1)).over(width)), [], 1
    while True:
        moving = cut_lineage(moving)
        if moving.isEmpty():
            break
        step = moving.select("document_id", F.col("cluster_no").alias("ptr"), F.col("ptr").alias("__p"), F.col("low").alias("__l"))
        moving = cut_lineage(
            moving.join(step, ["document_id", "ptr"]).select(
                *CLUSTER, F.col("__p").alias("ptr"), F.least("low", "__l").alias("low"), "n"
            )
        )
        steps *= 2
        settled.append(moving.where(F.col("n") <= steps).select(*CLUSTER, "ptr", "low"))
        moving = moving.where(F.col("n") > steps)
    links = cut_lineage(reduce(DataFrame.unionByName, settled, links.limit(0)))
    ends = links.select("document_id", F.col("cluster_no").alias("ptr"), F.col("low").alias("root"))
    rooted = links.join(ends, ["document_id", "ptr"]).select(*CLUSTER, "root")
    smallest = rooted.groupBy("document_id", "root").agg(F.min("cluster_no").alias("__first"))
    numbered = prefix_scan(
        smallest, ["document_id"], ["__first"], ordinal_segment("__first"), sums={"__n": F.lit(1)}
    )
    names = numbered.select("document_id", "root", (F.col("__n") - 1).cast("int").alias("merged_no"))
    return rooted.join(names, ["document_id", "root"]).select(*CLUSTER, "merged_no")


def merge_tiny_clusters(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members under their merged cluster number."""
    return members.join(components, CLUSTER).drop("cluster_no").withColumnRenamed("merged_no", "cluster_no")


def build_cluster_plan(members: DataFrame) -> dict[str, DataFrame]:
    """Diagnostics, merge targets and normalised clusters for labelled members."""
    raw = cut_lineage(cluster_diagnostics(members))
    targets = cut_lineage(best_merge_target(raw))
    marked = raw.join(targets.select(*CLUSTER, "merge_target"), CLUSTER, "left")
    normalized = merge_tiny_clusters(members, cut_lineage(merge_components(raw, targets)))
    return {
        "raw_diagnostics": marked,
        "normalized_members": normalized,
        "normalized_diagnostics": cut_lineage(cluster_diagnostics(normalized)),
        "tiny_merge_diagnostics": marked.where("is_tiny").select(
            *CLUSTER, "cluster_id", "word_count", cluster_labels(F.col("merge_target")).alias("merge_target_id")
        ),
    }


def ordered_members(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """``ord`` renumbered densely per document along ``by``: a cluster number and a position."""
    segment = grouped_segment(F.col(by[0]), F.col(by[1]))
    numbered = prefix_scan(members, ["document_id"], list(by), segment, sums={"__n": F.lit(1)})
    return numbered.withColumn("ord", F.col("__n") - 1).drop("__n")
