"""Cluster preview of stored leaves: no writes, diagnostics only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import labels, trees
from arbora.operators import clustering, planning


def embedding_missing(leaves: DataFrame) -> DataFrame:
    """Per document: whether any leaf lacks its embedding, and the number of leaves."""
    absent = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return leaves.groupBy("document_id").agg(F.bool_or(absent).alias("missing"), F.count(F.lit(1)).alias("leaves"))


def preview_targets(leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """Cluster target per requested document (``requested`` may be null)."""
    counts = leaves.groupBy("document_id").agg(F.count(F.lit(1)).alias("leaf_count"))
    joined = requests.join(counts, "document_id", "left").withColumn("leaf_count", F.coalesce("leaf_count", F.lit(0)))
    target = trees.resolve_target_clusters(F.col("leaf_count"), F.col("requested"))
    return joined.withColumns(
        {"target": target, "layout_strategy": labels.normalize_strategy(F.col("layout_strategy"))}
    )


def preview_stats(targets: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Header of the preview; documents without leaves get zeros."""
    counts = diagnostics.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("cluster_count"), F.count_if("is_tiny").alias("tiny_cluster_count")
    )
    return targets.join(counts, "document_id", "left").select(
        "document_id",
        "layout_strategy",
        "leaf_count",
        F.coalesce("cluster_count", F.lit(0).cast("bigint")).alias("cluster_count"),
        F.coalesce("tiny_cluster_count", F.lit(0).cast("bigint")).alias("tiny_cluster_count"),
        F.lit(V.MIN_SUMMARY_WORDS).alias("min_summary_words"),
        F.lit(V.TINY_GROUP_WORDS).alias("tiny_group_words"),
        F.col("target").alias("target_clusters"),
    )


def cluster_preview(leaves: DataFrame, requests: DataFrame, cluster=None) -> dict[str, DataFrame]:
    """Cluster decrypted leaves of the requested documents and describe the result.

    Adversarial documents cluster inside their partitions, all others freely.
    ``cluster(nodes, targets)`` overrides both.  Documents with a leaf lacking
    its embedding come back in ``rejects``.
    """
    missing = embedding_missing(leaves).where("missing")
    rejects = requests.join(missing.select("document_id"), "document_id", "left_semi").withColumn(
        "reject_reason", F.lit(V.NO_EMBEDDINGS)
    )
    accepted = requests.join(rejects.select("document_id"), "document_id", "left_anti")
    targets = preview_targets(leaves, accepted)
    wanted = leaves.join(targets.select("document_id", F.col("layout_strategy").alias("__strategy")), "document_id")
    pairs = targets.select("document_id", "target")
    if cluster is not None:
        labels_of = cluster(wanted, pairs)
    else:
        disputed = wanted.where(F.col("__strategy") == "ADVERSARIAL")
        others = wanted.where(F.col("__strategy") != "ADVERSARIAL")
        labels_of = clustering.cluster_by_partition(disputed, pairs).unionByName(
            clustering.cluster_globally(others, pairs)
        )
    members = wanted.drop("cluster_no", "__strategy").join(
        labels_of.select("document_id", "id", "cluster_no"), ["document_id", "id"]
    )
    plan = planning.build_cluster_plan(members)
    return {
        "stats": preview_stats(targets, plan["raw_diagnostics"]),
        "clusters": plan["raw_diagnostics"],
        "members": planning.cluster_members(members),
        "tiny_merges": plan["tiny_merge_diagnostics"],
        "rejects": rejects,
    }
