"""Summary trees: building them level by level for all documents at once, and reading them.

A level is one plan over every document still growing.  Documents drop out by
their own stop rule; the loop ends when none is left.  Between levels the rows
go through ``cut_lineage`` so that plans stay small and a lost executor only
repeats the current level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import text, trees
from arbora.functions.labels import truthy
from arbora.functions.protection import stable_id
from arbora.operators import clustering, planning
from arbora.operators.providers import extractive_summaries, hashed_embeddings
from arbora.operators.scan import grouped_segment, ordinal_segment, prefix_scan
from arbora.session import cut_lineage

HIERARCHY = "array<struct<key:string,title:string,depth:int>>"
ClusterFn = Callable[[DataFrame, DataFrame], DataFrame]
SummarizeFn = Callable[[DataFrame, list[str]], DataFrame]
EmbedFn = Callable[[DataFrame], DataFrame]

NODE_COLUMNS = {
    "id": "string",
    "document_id": "string",
    "owner_id": "string",
    "node_type": "string",
    "level": "int",
    "parent_id": "string",
    "member_no": "int",
    "content": "string",
    "embedding": "array<float>",
    "page_start": "int",
    "page_end": "int",
    "chunk_index": "int",
    "cluster_id": "string",
    "layout_strategy": "string",
    "layout_partition": "string",
    "section_hierarchy": HIERARCHY,
    "section_key": "string",
    "section_parent_key": "string",
    "structural_depth": "int",
}
CURRENT = [
    "document_id", "owner_id", "id", "ord", "content", "page_start", "page_end", "layout_strategy",
    "layout_partition", "section_hierarchy", "embedding",
]


def conform(nodes: DataFrame) -> DataFrame:
    """All node columns in order, absent ones null."""
    return nodes.select(
        *[
            (F.col(n) if n in nodes.columns else F.lit(None)).cast(kind).alias(n)
            for n, kind in NODE_COLUMNS.items()
        ]
    )


def leaf_nodes_from_chunks(chunks: DataFrame, owners: DataFrame | None = None, run_id: str = "run") -> DataFrame:
    """Chunks with embeddings as level-0 nodes with stable ids."""
    owned = chunks.join(owners, "document_id") if owners is not None else chunks
    return conform(
        owned.withColumns(
            {
                "id": stable_id(F.col("document_id"), F.lit(run_id), F.lit(0), F.col("chunk_index")),
                "node_type": F.lit("leaf"),
                "level": F.lit(0),
            }
        )
    )


def leaf_union_summary(leaves: DataFrame, summaries: DataFrame) -> DataFrame:
    return conform(leaves).unionByName(conform(summaries))


def carryover_union(summaries: DataFrame, carried: DataFrame) -> DataFrame:
    """Next level: new summaries and the nodes no summary took in."""
    return summaries.select(*CURRENT).unionByName(carried.select(*CURRENT))


def summarize_groups(members: DataFrame, keys: list[str], summarize: SummarizeFn) -> DataFrame:
    """One row per group: summary text, page span, first member's hierarchy, shared metadata."""
    hierarchy = F.to_json("section_hierarchy")
    shapes = members.groupBy(*keys).agg(
        F.first("owner_id").alias("owner_id"),
        F.nullif(F.min(F.coalesce("page_start", F.lit(0))), F.lit(0)).alias("page_start"),
        F.nullif(F.max(F.coalesce("page_end", F.lit(0))), F.lit(0)).alias("page_end"),
        F.count(F.lit(1)).alias("n_members"),
        F.min("ord").alias("first_ord"),
        F.min_by("section_hierarchy", "ord").alias("first_hierarchy"),
        trees.shared_value("layout_partition", allow_null=True).alias("layout_partition"),
        trees.shared_value("layout_strategy", allow_null=True).alias("layout_strategy"),
        F.from_json(trees.shared_value(hierarchy, allow_null=True), HIERARCHY).alias("section_hierarchy"),
    )
    return shapes.join(summarize(members, keys), keys, "left").withColumn("content", F.coalesce("summary", F.lit(""))).drop("summary")


def _start(leaves: DataFrame) -> DataFrame:
    """Leaves with a dense position per document."""
    chunk = F.coalesce("chunk_index", F.lit(0))
    ordered = prefix_scan(conform(leaves).withColumn("__c", chunk), ["document_id"], ["__c", "id"], ordinal_segment("__c"), sums={"__n": F.lit(1)})
    return cut_lineage(ordered.withColumn("ord", F.col("__n") - 1).select(*CURRENT))


def _edges(members: DataFrame, parent: Column, group: list[str]) -> DataFrame:
    """(document, child, parent, member_no): the parent of every member and its place among siblings."""
    segment = ordinal_segment("ord")
    numbered = prefix_scan(members, group, ["ord"], segment, sums={"__n": F.lit(1)})
    return numbered.select("document_id", "id", parent.alias("parent_id"), (F.col("__n") - 1).cast("int").alias("member_no"))


def _with_parents(nodes: DataFrame, edges: list[DataFrame]) -> DataFrame:
    if not edges:
        return nodes
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    return conform(nodes.drop("parent_id", "member_no").join(every, ["document_id", "id"], "left"))


def _all(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    result = like.limit(0)
    for frame in frames:
        result = result.unionByName(frame)
    return result


# --- clustered trees ---------------------------------------------------------------------------


def build_summary_tree_levels(
    leaves: DataFrame,
    cluster: ClusterFn = clustering.cluster_globally,
    summarize: SummarizeFn = extractive_summaries,
    embed: EmbedFn | None = None,
    run_id: str = "run",
    max_levels: int = V.MAX_CLUSTER_LEVELS,
) -> DataFrame:
    """Leaves and summaries of clustered trees.

    Per level: cluster to the planned count, merge undersized clusters, turn
    every cluster with enough words into a summary and carry the rest over.  A
    document stops at one node, when the plan ends or would not shrink it, or
    when everything falls into one cluster before the root is due.  A level that
    does not shrink a document is not kept.
    """
    leaves = cut_lineage(conform(leaves))
    current = _start(leaves)
    width = current.select(F.max(F.size("embedding")).alias("w")).first()["w"] or 64
    embed = embed or (lambda df: hashed_embeddings(df, width=width))
    plans = current.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_leaves")).withColumn(
        "plan", trees.plan_tree_levels(F.col("n_leaves"))
    )
    plans = cut_lineage(plans.where(F.size("plan") > 1))
    summaries: list[DataFrame] = []
    edges: list[DataFrame] = []

    for level in range(1, max_levels + 1):
        counts = current.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        growing = counts.join(plans.select("document_id", F.try_element_at("plan", F.lit(level + 1)).alias("target")), "document_id")
        growing = cut_lineage(growing.where((F.col("n") > 1) & (F.col("target") < F.col("n"))))
        if growing.isEmpty():
            break
        active = cut_lineage(current.join(growing.select("document_id"), "document_id", "left_semi"))
        labels = cluster(active, growing.select("document_id", "target")).select("document_id", "id", "cluster_no")
        labelled = cut_lineage(active.join(labels, ["document_id", "id"]))
        plan = planning.build_cluster_plan(labelled)
        shapes = plan["normalized_diagnostics"].groupBy("document_id").agg(
            F.count(F.lit(1)).alias("n_clusters"),
            F.sum(F.when(F.col("is_summarizable"), 1).otherwise(F.col("node_count"))).alias("n_next"),
        )
        kept = cut_lineage(
            growing.join(shapes, "document_id").where(
                ((F.col("n_clusters") > 1) | (F.col("target") == 1)) & (F.col("n_next") < F.col("n"))
            ).select("document_id")
        )
        if kept.isEmpty():
            break
        verdicts = plan["normalized_diagnostics"].select("document_id", "cluster_no", "is_summarizable")
        members = cut_lineage(
            plan["normalized_members"].join(kept, "document_id", "left_semi").join(verdicts, ["document_id", "cluster_no"])
        )
        group = ["document_id", "cluster_no"]
        taken = members.where("is_summarizable")
        cluster_id = F.format_string(f"level-{level}-cluster-%d", "cluster_no")
        parent = stable_id(F.col("document_id"), F.lit(run_id), F.lit(level), cluster_id)
        made = summarize_groups(taken, group, summarize).withColumns(
            {"id": parent, "cluster_id": cluster_id, "level": F.lit(level), "node_type": F.lit("summary")}
        )
        made = cut_lineage(embed(made.withColumn("ord", F.col("first_ord"))))
        summaries.append(conform(made))
        edges.append(_edges(taken, parent, group))
        following = made.select("cluster_no", *CURRENT).unionByName(
            members.where("NOT is_summarizable").select("cluster_no", *CURRENT)
        )
        current = cut_lineage(planning.ordered_members(following, ["cluster_no", "ord"]).select(*CURRENT))

    return _with_parents(leaf_union_summary(leaves, _all(summaries, leaves)), edges)


# --- structural trees ----------------------------------------------------------------------------


def path_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per section path of a document."""
    path = F.array_join(trees.path_of(F.col("section_hierarchy")), "\x1f")
    return nodes.withColumn("path", path).groupBy("document_id", "path").agg(F.count(F.lit(1)).alias("n_nodes"))


def structural_groups(nodes: DataFrame) -> DataFrame:
    """``group_path`` of every node; null means carried over.

    Shared paths group at the path, single ones at their parent.  A document
    without any group puts all its nodes under one document root.
    """
    keys = trees.path_of(F.col("section_hierarchy"))
    pathed = nodes.withColumns({"path_keys": keys, "path": F.array_join(keys, "\x1f")})
    counted = pathed.join(path_counts(nodes), ["document_id", "path"])
    parent = F.slice(F.col("path_keys"), F.lit(1), F.greatest(F.size("path_keys") - 1, F.lit(0)))
    own = F.when(F.col("n_nodes") > 1, F.col("path_keys")).when(F.size("path_keys") > 1, parent)
    chosen = counted.withColumn("group_path", own)
    grouped = chosen.where(F.col("group_path").isNotNull()).select("document_id").distinct().withColumn("__grouped", F.lit(True))
    rooted = chosen.join(grouped, "document_id", "left")
    fallback = F.when(F.col("__grouped").isNull(), F.array(F.lit("document-root")))
    return rooted.withColumn("group_path", F.coalesce("group_path", fallback)).drop("__grouped", "n_nodes", "path_keys", "path")


def _section_metadata(made: DataFrame, hierarchy: Column) -> DataFrame:
    known = made.withColumn("section_hierarchy", hierarchy)
    path = F.col("section_hierarchy")
    some = F.size(path) > 0
    root = F.lit("document-root")
    return known.withColumns(
        {
            "layout_strategy": F.lit("HIERARCHICAL"),
            "layout_partition": F.when(some, F.try_element_at(path, F.lit(1))["key"]).otherwise(root),
            "section_key": F.when(some, F.try_element_at(path, F.lit(-1))["key"]).otherwise(root),
            "section_parent_key": F.when(F.size(path) > 1, F.try_element_at(path, F.lit(-2))["key"]),
            "structural_depth": F.size(path),
        }
    )


def build_structural_tree(
    leaves: DataFrame,
    summarize: SummarizeFn = extractive_summaries,
    embed: EmbedFn | None = None,
    run_id: str = "run",
    max_levels: int = V.MAX_STRUCTURAL_LEVELS,
) -> DataFrame:
    """Leaves and summaries of trees that follow the section hierarchy."""
    leaves = cut_lineage(conform(leaves))
    current = _start(leaves)
    width = current.select(F.max(F.size("embedding")).alias("w")).first()["w"] or 64
    embed = embed or (lambda df: hashed_embeddings(df, width=width))
    empty = F.array().cast(HIERARCHY)
    summaries: list[DataFrame] = []
    edges: list[DataFrame] = []

    for level in range(1, max_levels + 2):
        several = current.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("document_id")
        active = cut_lineage(current.join(several, "document_id", "left_semi"))
        if active.isEmpty():
            break
        last = level > max_levels
        if last:  # whatever is left goes under one root
            grouped = active.withColumn("group_path", F.array(F.lit("document-root")))
        else:
            grouped = structural_groups(active)
        named = cut_lineage(grouped.withColumn("group_key", F.array_join("group_path", "\x1f")))
        taken = named.where(F.col("group_path").isNotNull())
        firsts = taken.groupBy("document_id", "group_key").agg(F.min("ord").alias("first_ord"), F.first("group_path").alias("path"))
        numbered = prefix_scan(firsts, ["document_id"], ["first_ord"], ordinal_segment("first_ord"), sums={"__n": F.lit(1)})
        groups = numbered.select("document_id", "group_key", "path", (F.col("__n") - 1).cast("int").alias("cluster_no"))
        members = cut_lineage(taken.join(groups, ["document_id", "group_key"]))
        group = ["document_id", "cluster_no"]
        if last:
            cluster_id = F.lit(f"structural-level-{level}-root")
        else:
            cluster_id = F.format_string(f"structural-level-{level}-cluster-%d", "cluster_no")
        parent = stable_id(F.col("document_id"), F.lit(run_id), F.lit(level), cluster_id)
        shaped = summarize_groups(members, group, summarize).join(groups.select(*group, "path"), group)
        first = F.coalesce("first_hierarchy", empty)
        hierarchy = empty if last else trees.shared_hierarchy(first, F.col("path"))
        made = _section_metadata(shaped, hierarchy).withColumns(
            {
                "id": parent, "cluster_id": cluster_id, "level": F.lit(level), "node_type": F.lit("summary"),
                "ord": F.col("cluster_no").cast("bigint"),
            }
        )
        made = cut_lineage(embed(made))
        summaries.append(conform(made))
        edges.append(_edges(members, parent, group))
        if last:
            break
        following = made.select(F.lit(0).alias("__kind"), *CURRENT).unionByName(
            named.where(F.col("group_path").isNull()).select(F.lit(1).alias("__kind"), *CURRENT)
        )
        segment = grouped_segment(F.col("__kind"), F.col("ord"))
        placed = prefix_scan(following, ["document_id"], ["__kind", "ord"], segment, sums={"__n": F.lit(1)})
        current = cut_lineage(placed.withColumn("ord", F.col("__n") - 1).select(*CURRENT))

    return _with_parents(leaf_union_summary(leaves, _all(summaries, leaves)), edges)


# --- reading trees --------------------------------------------------------------------------------------


def tree_edges(nodes: DataFrame) -> DataFrame:
    """(document, parent, child, member_no) for children whose parent exists."""
    parents = nodes.where(F.col("node_type") == "summary").select("document_id", F.col("id").alias("parent_id"))
    children = nodes.where(F.col("parent_id").isNotNull()).select(
        "document_id", "parent_id", F.col("id").alias("child_id"), "member_no"
    )
    return children.join(parents, ["document_id", "parent_id"])


def edges_from_child_ids(nodes: DataFrame) -> DataFrame:
    """The same edges from stored ordered ``child_ids``; ids without a node are dropped."""
    listed = nodes.where(F.col("node_type") == "summary").select(
        "document_id", F.col("id").alias("parent_id"), F.posexplode("child_ids").alias("member_no", "child_id")
    )
    known = nodes.select("document_id", F.col("id").alias("child_id"))
    return listed.join(known, ["document_id", "child_id"])


def tree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Summaries nobody lists as a child; all leaves where a document has none."""
    summaries = nodes.where(F.col("node_type") == "summary")
    roots = summaries.join(
        edges.select("document_id", F.col("child_id").alias("id")), ["document_id", "id"], "left_anti"
    )
    leaves = nodes.where(F.col("node_type") == "leaf").join(roots.select("document_id"), "document_id", "left_anti")
    return roots.unionByName(leaves)


def order_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("document_id", F.desc("level"), F.asc_nulls_last("chunk_index"), "created_at", "id")


def node_sort_key() -> Column:
    """Root order inside a document: level down, chunk index with 0 and null both first, id."""
    return F.struct(
        (-F.col("level")).alias("a"), F.coalesce(F.nullif("chunk_index", F.lit(0)), F.lit(-1)).alias("b"), F.col("id").alias("c")
    )


def order_roots(roots: DataFrame) -> DataFrame:
    """``root_no``: position of each root in its document."""
    key = F.col("__key")
    segment = grouped_segment(F.coalesce(-F.col("level"), F.lit(0)), key["b"])
    numbered = prefix_scan(roots.withColumn("__key", node_sort_key()), ["document_id"], ["__key"], segment, sums={"__n": F.lit(1)})
    return numbered.withColumn("root_no", (F.col("__n") - 1).cast("int")).drop("__n", "__key")


def tree_stats(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Leaf and summary counts and the top level; zeros for documents without nodes."""
    stats = nodes.groupBy("document_id").agg(
        F.count_if(F.col("node_type") == "leaf").alias("leaf_count"),
        F.count_if(F.col("node_type") == "summary").alias("summary_count"),
        F.max("level").alias("max_level"),
    )
    return documents.select("document_id").join(stats, "document_id", "left").na.fill(0)


def serialize_nodes(nodes: DataFrame) -> DataFrame:
    """Node projection of the tree API, metadata never null."""
    shown = (
        "id", "document_id", "node_type", "level", "content", "encrypted_content", "content_iv", "crypto_version",
        "page_start", "page_end", "chunk_index", "cluster_id", "parent_id",
    )
    columns = [(F.col(n) if n in nodes.columns else F.lit(None).cast("string")).alias(n) for n in shown]
    metadata = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in nodes.columns else F.lit("{}")
    return nodes.select(*columns, metadata.alias("metadata"))


def summary_tree(nodes: DataFrame) -> dict[str, DataFrame]:
    """Flat tree: nodes, ordered edges, ordered roots and statistics."""
    edges = tree_edges(nodes)
    return {
        "nodes": serialize_nodes(nodes),
        "edges": edges,
        "roots": order_roots(tree_roots(nodes, edges)),
        "stats": tree_stats(nodes, nodes.select("document_id").distinct()),
    }


def _no_ring(level: int, edges: int) -> None:
    """A walk with more steps than there are edges goes round in a ring."""
    if level > edges:
        raise ValueError("the edges of a document form a ring, which no tree has")


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Every (start, descendant) with depth and sibling path, one join per tree level until none is left.

    ``starts``: document_id, id.  The path of sibling numbers gives pre-order.
    """
    frontier = starts.select(
        "document_id", F.col("id").alias("start_id"), "id", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")
    )
    frontier = cut_lineage(frontier)
    edges = cut_lineage(edges.select("document_id", "parent_id", "child_id", "member_no"))
    found, depth, limit = [frontier], 0, edges.count()
    while True:
        depth += 1
        _no_ring(depth - 1, limit)
        step = frontier.join(edges.withColumnRenamed("parent_id", "id"), ["document_id", "id"]).select(
            "document_id", "start_id", F.col("child_id").alias("id"), F.lit(depth).alias("depth"),
            F.concat("path", F.array("member_no")).alias("path"),
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        found.append(frontier)
    return _all(found[1:], found[0]).unionByName(found[0])


def leaf_evidence(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Leaf sources below each start node, in pre-order."""
    reached = descendants(edges, starts)
    leaves = nodes.where(F.col("node_type") == "leaf").drop("parent_id", "member_no")
    return reached.join(leaves, ["document_id", "id"])


def leaf_source_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of leaf sources per node, rolled up one level at a time.

    Counts travel from child to parent, so no (ancestor, leaf) pairs are formed.
    """
    counts = cut_lineage(
        nodes.select("document_id", "id", (F.col("node_type") == "leaf").cast("bigint").alias("n"))
    )
    edges = cut_lineage(edges.select("document_id", "parent_id", "child_id"))
    moving = counts.where("n > 0")
    totals, limit = [moving], edges.count()
    while True:
        _no_ring(len(totals) - 1, limit)
        lifted = moving.join(edges.withColumnRenamed("child_id", "id"), ["document_id", "id"]).groupBy("document_id", "parent_id").agg(
            F.sum("n").alias("n")
        )
        moving = cut_lineage(lifted.select("document_id", F.col("parent_id").alias("id"), "n"))
        if moving.isEmpty():
            break
        totals.append(moving)
    summed = _all(totals[1:], totals[0]).unionByName(totals[0]).groupBy("document_id", "id").agg(F.sum("n").alias("source_count"))
    return nodes.select("document_id", "id").join(summed, ["document_id", "id"], "left").withColumn(
        "source_count", F.coalesce("source_count", F.lit(0).cast("bigint"))
    )


def node_heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest way down from every node, again lifted level by level."""
    edges = cut_lineage(edges.select("document_id", "parent_id", "child_id"))
    moving = nodes.select("document_id", "id").join(
        edges.select("document_id", F.col("parent_id").alias("id")), ["document_id", "id"], "left_anti"
    ).withColumn("height", F.lit(0))
    seen, height, limit = [cut_lineage(moving)], 0, edges.count()
    while True:
        height += 1
        _no_ring(height - 1, limit)
        lifted = seen[-1].join(edges.withColumnRenamed("child_id", "id"), ["document_id", "id"]).select(
            "document_id", F.col("parent_id").alias("id"), F.lit(height).alias("height")
        )
        step = cut_lineage(lifted.distinct())
        if step.isEmpty():
            break
        seen.append(step)
    return _all(seen[1:], seen[0]).unionByName(seen[0]).groupBy("document_id", "id").agg(F.max("height").alias("height"))


def synthesize_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One root per document: the only root itself, or a virtual one over several."""
    roots = order_roots(tree_roots(nodes, edges))
    stats = tree_stats(nodes, nodes.select("document_id").distinct())
    shown = truthy(F.col("content"))
    named = [truthy(F.col(n)) for n in ("clause_title", "section_key", "section_parent_key") if n in roots.columns]
    roots = roots.withColumn("__title", F.coalesce(*named, text.title_from_content(F.col("content"))))
    grouped = roots.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_roots"),
        F.min_by(F.struct("id", "node_type", "level", "content", "page_start", "page_end", "__title"), "root_no").alias("first"),
        F.min_by(shown, F.when(shown.isNotNull(), F.col("root_no"))).alias("content"),
        F.min(F.nullif("page_start", F.lit(0))).alias("page_start"),
        F.max(F.nullif("page_end", F.lit(0))).alias("page_end"),
        F.max("level").alias("top_level"),
    ).join(stats, "document_id")
    only = F.col("n_roots") == 1
    kind = F.when(F.col("first.node_type") == "summary", "root_summary").otherwise(F.col("first.node_type"))
    top = F.coalesce(F.nullif("max_level", F.lit(0)), F.greatest(F.lit(0), F.col("top_level")))
    return grouped.select(
        "document_id",
        F.when(only, F.col("first.id")).otherwise(F.concat(F.lit("root-"), F.col("document_id"))).alias("id"),
        F.when(only, kind).otherwise("root_summary").alias("node_type"),
        F.when(only, F.col("first.level")).otherwise(top + 1).alias("level"),
        F.when(only, F.col("first.__title")).otherwise(V.VIRTUAL_ROOT_TITLE).alias("title"),
        F.when(only, F.col("first.content"))
        .otherwise(F.coalesce("content", F.lit(V.VIRTUAL_ROOT_TEXT)))
        .alias("content"),
        F.when(only, F.col("first.page_start")).otherwise(F.col("page_start")).alias("page_start"),
        F.when(only, F.col("first.page_end")).otherwise(F.col("page_end")).alias("page_end"),
        F.col("leaf_count").alias("source_count"),
    )


def evidence_highlights(evidence: DataFrame) -> DataFrame:
    """Page and box of evidence rows that have a box; the node's page fills a missing one."""
    return evidence.where(F.col("bbox").isNotNull()).withColumn(
        "page", F.coalesce(F.nullif("page_start", F.lit(0)), F.col("node_page"))
    )


