"""Clustering, planning, tree and provider queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import trees as TF
from arbora.operators import chunking as K
from arbora.operators import clustering as C
from arbora.operators import planning as P
from arbora.operators import providers as PR
from arbora.operators import retrieval as R
from arbora.operators import trees as T
from arbora.plans import preview
from arbora.session import work_folder
from arbora.sources.vector_lists import write_lists
from suite import sql_exprs as S
from suite.chunk_queries import C22_SQL
from suite.registry import query
from suite.sql_views import view
from suite.views import HIERARCHY

c = F.col
DOC = "document_id"


def members_of(v):
    """Leaves with the given label as their cluster."""
    return v.nodes.withColumn("ord", c("chunk_index").cast("bigint"))


# --- diagnostics and merging ---------------------------------------------------------------

view(
    "v_diag",
    f"""SELECT *, words < 200 AS is_tiny, words >= 100 AS is_summarizable, CASE WHEN words < 100 THEN 'invalid' WHEN words < 200 THEN 'tiny' ELSE 'summarizable' END AS status FROM (
          SELECT document_id, cluster_no, CAST(sum({S.n_words('content')}) AS BIGINT) AS words, count(*) AS node_count, nullif(min(page_start), 0) AS page_start, nullif(max(page_end), 0) AS page_end,
                 CASE WHEN min(layout_partition) = max(layout_partition) AND count(layout_partition) = count(*) THEN min(layout_partition) ELSE 'mixed' END AS layout_partition
          FROM v_nodes GROUP BY document_id, cluster_no)""",
)
DIAG = ("document_id", "cluster_no", "word_count", "node_count", "page_start", "page_end", "layout_partition", "is_tiny",
        "is_summarizable", "status")
DIAG_SQL = "document_id, cluster_no, words AS word_count, node_count, page_start, page_end, layout_partition, is_tiny, is_summarizable, status"


@query("G9_cluster_diagnostics", f"SELECT {DIAG_SQL} FROM v_diag")
def g9(v):
    return P.cluster_diagnostics(members_of(v)).select(*DIAG)


@query("W17_cluster_numbering", """SELECT id, 'cluster-' || CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY first_no) - 1 AS VARCHAR) AS cluster_id
  FROM (SELECT id, document_id, min(chunk_index) OVER (PARTITION BY document_id, cluster_no) AS first_no FROM v_nodes)""")
def w17(v):
    labelled = members_of(v).withColumnRenamed("cluster_no", "label")
    numbered = C.number_clusters(labelled, [DOC], ["label"])
    return numbered.select("id", C.cluster_labels(c("cluster_no")).alias("cluster_id"))


@query("J16_positions_to_members", f"SELECT document_id, cluster_no, id, chunk_index, left({S.strip('content')}, 220) AS snippet, CAST({S.n_words('content')} AS INTEGER) AS n_words FROM v_nodes")
def j16(v):
    return P.cluster_members(members_of(v)).select(DOC, "cluster_no", "id", "chunk_index", "snippet", "n_words")


@query(
    "G11_shared_value",
    """SELECT document_id, CASE WHEN count(DISTINCT layout_partition) = 1 AND count(layout_partition) = count(*) THEN min(layout_partition) END AS shared_partition,
         CASE WHEN count(DISTINCT maybe) = 1 AND count(maybe) = count(*) THEN min(maybe) END AS shared_maybe FROM (
         SELECT document_id || '-' || cluster_no AS document_id, layout_partition, CASE WHEN cluster_no % 2 = 0 OR chunk_index % 5 > 0 THEN 'x' END AS maybe FROM v_nodes) GROUP BY document_id""",
)
def g11(v):
    rows = v.nodes.select(
        F.concat_ws("-", DOC, c("cluster_no").cast("string")).alias(DOC), "layout_partition",
        F.when((c("cluster_no") % 2 == 0) | (c("chunk_index") % 5 > 0), F.lit("x")).alias("maybe"),
    )
    return rows.groupBy(DOC).agg(
        TF.shared_value("layout_partition", allow_null=False).alias("shared_partition"),
        TF.shared_value("maybe", allow_null=True).alias("shared_maybe"),
    )


@query(
    "J9_cluster_pairs",
    """SELECT d.document_id, d.cluster_no, CASE WHEN same_big > 0 OR same_small > 1 THEN '=' || layout_partition WHEN all_big > 0 OR all_small > 1 THEN '*' END AS pool,
         CASE WHEN same_big > 0 THEN same_big WHEN same_small > 1 THEN same_small - 1 WHEN all_big > 0 THEN all_big WHEN all_small > 1 THEN all_small - 1 ELSE 0 END AS n_candidates
       FROM (SELECT *, count(CASE WHEN NOT is_tiny THEN 1 END) OVER (PARTITION BY document_id, layout_partition) AS same_big, count(CASE WHEN is_tiny THEN 1 END) OVER (PARTITION BY document_id, layout_partition) AS same_small,
               count(CASE WHEN NOT is_tiny THEN 1 END) OVER (PARTITION BY document_id) AS all_big, count(CASE WHEN is_tiny THEN 1 END) OVER (PARTITION BY document_id) AS all_small FROM v_diag) d WHERE is_tiny""",
)
def j9(v):
    return P.merge_candidates(P.cluster_diagnostics(members_of(v))).select(DOC, "cluster_no", "pool", "n_candidates")


view(
    "v_targets",
    """SELECT document_id, cluster_no, partner AS merge_target, distance FROM (
         SELECT *, row_number() OVER (PARTITION BY document_id, cluster_no ORDER BY other_part, other_tiny, distance, words, partner) AS rn FROM (
           SELECT a.document_id, a.cluster_no, b.cluster_no AS partner, CASE WHEN a.layout_partition = b.layout_partition THEN 0 ELSE 1 END AS other_part, CASE WHEN b.is_tiny THEN 1 ELSE 0 END AS other_tiny, b.words,
             CASE WHEN a.page_end < b.page_start THEN b.page_start - a.page_end WHEN b.page_end < a.page_start THEN a.page_start - b.page_end ELSE 0 END AS distance
           FROM v_diag a JOIN v_diag b ON a.document_id = b.document_id AND a.cluster_no <> b.cluster_no WHERE a.is_tiny)) WHERE rn = 1""",
)


@query("T8_best_merge_target", "SELECT document_id, cluster_no, merge_target, CAST(distance AS INTEGER) AS distance FROM v_targets")
def t8(v):
    return P.best_merge_target(P.cluster_diagnostics(members_of(v)))


COMPONENTS = """link AS (SELECT document_id, cluster_no AS a, merge_target AS b FROM v_targets UNION SELECT document_id, merge_target, cluster_no FROM v_targets UNION SELECT document_id, cluster_no, cluster_no FROM v_diag),
  reach AS (SELECT document_id, a, b FROM link UNION SELECT r.document_id, r.a, l.b FROM reach r JOIN link l ON l.document_id = r.document_id AND l.a = r.b),
  comp AS (SELECT document_id, a AS cluster_no, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY root) - 1 AS INTEGER) AS merged_no FROM (SELECT document_id, a, min(b) AS root FROM reach GROUP BY document_id, a))"""


@query("C7_merge_tiny_clusters", f"WITH RECURSIVE {COMPONENTS} SELECT document_id, cluster_no, merged_no FROM comp")
def c7(v):
    raw = P.cluster_diagnostics(members_of(v))
    return P.merge_components(raw, P.best_merge_target(raw))


@query("U3_union_distinct_members", f"WITH RECURSIVE {COMPONENTS} SELECT n.document_id, merged_no AS cluster_no, string_agg(id, ',' ORDER BY chunk_index) AS members FROM v_nodes n JOIN comp USING (document_id, cluster_no) GROUP BY n.document_id, merged_no")
def u3(v):
    raw = P.cluster_diagnostics(members_of(v))
    merged = P.merge_tiny_clusters(members_of(v), P.merge_components(raw, P.best_merge_target(raw)))
    lists = merged.groupBy(DOC, "cluster_no").agg(F.array_sort(F.collect_set(F.struct("ord", "id"))).alias("m"))
    return lists.select(DOC, "cluster_no", F.array_join(F.transform("m", lambda m: m["id"]), ",").alias("members"))


@query(
    "C6_build_cluster_plan",
    f"""WITH RECURSIVE {COMPONENTS} SELECT document_id, cluster_no, word_count, node_count, page_start, page_end, layout_partition, word_count < 200 AS is_tiny FROM (
          SELECT n.document_id, merged_no AS cluster_no, CAST(sum({S.n_words('content')}) AS BIGINT) AS word_count, count(*) AS node_count, min(page_start) AS page_start, max(page_end) AS page_end,
            CASE WHEN min(layout_partition) = max(layout_partition) THEN min(layout_partition) ELSE 'mixed' END AS layout_partition FROM v_nodes n JOIN comp USING (document_id, cluster_no) GROUP BY n.document_id, merged_no)""",
)
def c6(v):
    plan = P.build_cluster_plan(members_of(v))
    return plan["normalized_diagnostics"].select(*[d for d in DIAG if d not in ("is_summarizable", "status")])


@query("C6_tiny_merge_diagnostics", "SELECT d.document_id, d.cluster_no, words AS word_count, 'cluster-' || merge_target AS merge_target_id FROM v_diag d LEFT JOIN v_targets t USING (document_id, cluster_no) WHERE is_tiny")
def c6t(v):
    plan = P.build_cluster_plan(members_of(v))
    return plan["tiny_merge_diagnostics"].select(DOC, "cluster_no", "word_count", "merge_target_id")


@query("C5_cluster_structurally", "SELECT id, 0 AS cluster_no FROM v_nodes")
def c5(v):
    return C.cluster_structurally(v.nodes).select("id", "cluster_no")


# --- clustering ------------------------------------------------------------------------------------


def quarter_targets(v):
    return v.nodes.groupBy(DOC).agg(F.ceil(F.count("*") / 4).cast("int").alias("target"))


INVARIANT = """SELECT document_id, count(*) AS n_nodes, count(*) AS n_distinct, TRUE AS within_target, {extra} FROM v_nodes GROUP BY document_id"""


def invariants(clusters, v, *extra):
    """Cover, disjointness and size of a clustering, per document."""
    counts = clusters.groupBy(DOC).agg(
        F.count("*").alias("n_nodes"), F.countDistinct("id").alias("n_distinct"),
        (F.max("cluster_no") + 1).alias("k"), F.countDistinct("cluster_no").alias("n_clusters"), *extra,
    )
    rows = counts.join(quarter_targets(v), DOC)
    return rows.withColumn("within_target", (c("k") == c("n_clusters")) & (c("k") <= c("target")))


@query("C1_cluster_embeddings", INVARIANT.format(extra="TRUE AS first_is_zero"))
def c1(v):
    clusters = C.cluster_embeddings(members_of(v), quarter_targets(v))
    first = F.min_by("cluster_no", "ord").alias("first_no")
    return invariants(clusters, v, first).select(
        DOC, "n_nodes", "n_distinct", "within_target", (c("first_no") == 0).alias("first_is_zero")
    )


@query("C1_cluster_embeddings_blocks", INVARIANT.format(extra="TRUE AS first_is_zero"))
def c1b(v):
    """The same through blocks of eight vectors, as very long documents are fitted."""
    clusters = C.cluster_embeddings(members_of(v), quarter_targets(v), block_rows=8)
    first = F.min_by("cluster_no", "ord").alias("first_no")
    return invariants(clusters, v, first).select(
        DOC, "n_nodes", "n_distinct", "within_target", (c("first_no") == 0).alias("first_is_zero")
    )


@query(
    "C1_cluster_embeddings_planted",
    """SELECT document_id, id, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY first) - 1 AS INTEGER) AS cluster_no
       FROM (SELECT *, min(chunk_index) OVER (PARTITION BY document_id, cluster_no % 3) AS first FROM v_nodes)""",
)
def c1p(v):
    """Vectors moved apart by their label's remainder fall into just these groups."""
    group = c("cluster_no") % 3
    moved = F.transform("embedding", lambda x, i: (x * F.lit(0.01) + F.when(i == group, 10.0).otherwise(0.0)).cast("float"))
    members = members_of(v).withColumn("embedding", moved).drop("cluster_no")
    targets = v.nodes.groupBy(DOC).agg(F.countDistinct(group).cast("int").alias("target"))
    return C.cluster_embeddings(members, targets).select(DOC, "id", "cluster_no")


@query("C2_cluster_globally", INVARIANT.format(extra="count(*) AS n_members"))
def c2(v):
    return invariants(C.cluster_globally(members_of(v), quarter_targets(v)), v).select(
        DOC, "n_nodes", "n_distinct", "within_target", c("n_nodes").alias("n_members")
    )


@query("C3_cluster_by_partition", "SELECT document_id, count(*) AS n_nodes, count(*) AS n_distinct, TRUE AS within_target, 0 AS mixed_clusters FROM v_nodes GROUP BY document_id")
def c3(v):
    """No cluster mixes partitions as long as more than one cluster is asked for."""
    members = members_of(v)
    clusters = C.cluster_by_partition(members, quarter_targets(v)).join(members.select("id", "layout_partition"), "id")
    mixed = clusters.groupBy(DOC, "cluster_no").agg((F.countDistinct("layout_partition") > 1).cast("int").alias("mixed"))
    per_doc = mixed.groupBy(DOC).agg(F.sum("mixed").cast("int").alias("mixed_clusters"))
    n_parts = members.groupBy(DOC).agg(F.countDistinct("layout_partition").alias("n_parts"))
    rows = invariants(clusters, v).join(per_doc, DOC).join(n_parts, DOC)
    fits = (c("k") == c("n_clusters")) & (c("k") <= F.greatest("target", "n_parts"))
    return rows.select(DOC, "n_nodes", "n_distinct", fits.alias("within_target"), "mixed_clusters")


@query(
    "C4_allocate_cluster_counts",
    """WITH parts AS (SELECT document_id, cluster_no AS part, count(*) AS size, min(chunk_index) AS first_ord FROM v_nodes GROUP BY document_id, cluster_no),
         sized AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n_parts, sum(size) OVER (PARTITION BY document_id) AS n, row_number() OVER (PARTITION BY document_id ORDER BY size DESC, first_ord) AS size_rank FROM parts),
         slots AS (SELECT document_id, part, n, n_parts, row_number() OVER (PARTITION BY document_id ORDER BY r, size_rank) AS slot_no FROM (SELECT *, unnest(generate_series(1, size - 2)) AS r FROM sized))
       SELECT document_id, part AS partition, CAST(1 + count(CASE WHEN slot_no <= CAST(ceil(s.n * CAST(0.6 AS DOUBLE)) AS BIGINT) - s.n_parts THEN 1 END) AS INTEGER) AS quota FROM sized s LEFT JOIN slots USING (document_id, part) GROUP BY document_id, part""",
)
def c4(v):
    parts = v.nodes.groupBy(DOC, c("cluster_no").alias("partition")).agg(
        F.count("*").alias("size"), F.min("chunk_index").alias("first_ord")
    )
    targets = v.nodes.groupBy(DOC).agg(F.ceil(F.count("*") * F.lit(0.6)).alias("target"))
    return C.allocate_cluster_counts(parts, targets).select(DOC, "partition", "quota")


@query("S11_build_ivf", "SELECT id, TRUE AS in_range, 16 AS n_lists FROM v_nodes")
def s11(v):
    listed, centroids = C.build_ivf(v.nodes, lists=16)
    return listed.select("id", c("list_id").between(0, len(centroids) - 1).alias("in_range"), F.lit(len(centroids)).alias("n_lists"))


@query("T12_ivf_probe")
def t12(v):
    """Approximate matches with their recall against the exact ones."""
    listed, centroids = C.build_ivf(v.nodes, lists=16)
    near = C.ivf_probe(v.questions, listed, centroids, nprobe=6)
    exact = R.match_nodes_batch(v.questions, v.nodes, scope=("owner_id",)).select("question_id", "id")
    hits = near.join(exact, ["question_id", "id"], "left_semi").groupBy("question_id").agg(F.count("*").alias("hits"))
    return exact.groupBy("question_id").agg(F.count("*").alias("wanted")).join(hits, "question_id", "left").select(
        "question_id", "wanted", F.coalesce("hits", F.lit(0)).alias("hits")
    )


@query("T12_ivf_probe_all_lists", """SELECT question_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT q.question_id, n.id, list_dot_product(CAST(n.embedding AS DOUBLE[]), CAST(question_embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(n.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(question_embedding AS DOUBLE[]), CAST(question_embedding AS DOUBLE[])))) AS similarity
  FROM v_nodes n JOIN v_questions q USING (owner_id))) WHERE rank <= 10""")
def t12all(v):
    """Probing every list gives the exact answer."""
    listed, centroids = C.build_ivf(v.nodes, lists=8)
    return C.ivf_probe(v.questions, listed, centroids, nprobe=8).select("question_id", "id", "rank")


@query("T12_probe_stored_lists", """SELECT owner_id, CAST(sum(least(10, n_nodes)) AS BIGINT) AS wanted, TRUE AS recall_reached FROM v_questions
  JOIN (SELECT owner_id, count(*) AS n_nodes FROM v_nodes GROUP BY owner_id) USING (owner_id) GROUP BY owner_id""")
def t12stored(v):
    """Lists read from storage, only those that questions probe: at least nine of ten exact matches are found for every owner."""
    listed, centroids = C.build_ivf(v.nodes, lists=16)
    path = work_folder(v.spark, "lists")
    write_lists(listed, centroids, path)
    near = C.probe_stored(v.questions, path, nprobe=1, share=0.8).select("question_id", "id", F.lit(1).alias("hit"))
    exact = R.match_nodes_batch(v.questions, v.nodes, scope=("owner_id",)).select("owner_id", "question_id", "id")
    return exact.join(near, ["question_id", "id"], "left").groupBy("owner_id").agg(
        F.count("*").alias("wanted"), (F.count("hit") >= F.count("*") * F.lit(0.9)).alias("recall_reached")
    )


# --- providers ------------------------------------------------------------------------------------------

view(
    "v_sentences",
    f"""SELECT document_id, cluster_no, chunk_index, i, sentence, {S.words('lower(sentence)')} AS ws FROM (
          SELECT document_id, cluster_no, chunk_index, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM (
            SELECT *, list_filter(list_transform(regexp_extract_all(content, '[^.?!]+[.?!]*'), lambda s: {S.collapse('s')}), lambda s: s <> '') AS ss FROM v_nodes))""",
)
view(
    "v_summaries",
    """WITH tok AS (SELECT document_id, cluster_no, chunk_index, i, unnest(ws) AS w FROM v_sentences),
         tf AS (SELECT document_id, cluster_no, w, count(*) AS tf FROM tok GROUP BY document_id, cluster_no, w),
         sc AS (SELECT document_id, cluster_no, chunk_index, i, CAST(sum(tf) AS DOUBLE) / count(*) AS score, count(*) AS n FROM tok JOIN tf USING (document_id, cluster_no, w) GROUP BY document_id, cluster_no, chunk_index, i),
         rk AS (SELECT *, row_number() OVER (PARTITION BY document_id, cluster_no ORDER BY score DESC, chunk_index, i) AS pick FROM sc),
         cut AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id, cluster_no ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk)
       SELECT document_id, cluster_no, string_agg(sentence, ' ' ORDER BY chunk_index, i) AS summary FROM cut JOIN v_sentences USING (document_id, cluster_no, chunk_index, i) WHERE before < 160 GROUP BY document_id, cluster_no""",
)


@query("C11_summarize", "SELECT document_id, cluster_no, summary FROM v_summaries")
def c11(v):
    return PR.extractive_summaries(members_of(v), [DOC, "cluster_no"])


@query("C12_embed", f"SELECT doc_id, 64 AS width, CAST(CASE WHEN {S.n_words('text')} > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length, TRUE AS sparse_enough FROM documents")
def c12(v):
    """Unit length, and no more used dimensions than distinct words."""
    from arbora.functions import text as X
    from arbora.functions import vectors

    rows = PR.hashed_embeddings(v.documents, "text")
    used = F.size(F.filter("embedding", lambda x: x != 0))
    distinct = F.size(F.array_distinct(X.words(F.lower("text"))))
    return rows.select(
        "doc_id", F.size("embedding").alias("width"), F.round(vectors.norm(c("embedding")), 5).alias("length"),
        (used <= distinct).alias("sparse_enough"),
    )


@query("C13_batch_by_token_budget", "SELECT doc_id, TRUE AS within_budget FROM documents")
def c13(v):
    batches = PR.batch_numbers(v.documents, "doc_id", "text")
    return batches.select("doc_id", ((c("items") == 1) | ((c("items") <= 15) & (c("tokens") <= 7000))).alias("within_budget"))


@query(
    "C14_retry_with_split",
    f"""SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN CAST({S.n_words('text')} AS DOUBLE) END AS first_value, doc_id % 7 = 3 AS refused
        FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'refuse ' || doc_id ELSE text END AS text FROM documents)""",
)
def c14(v):
    """A provider that takes four texts per call and refuses some for good: the others are all answered."""

    def call(texts):
        if len(texts) > 4 or any(t.startswith("refuse ") for t in texts):
            raise RuntimeError("429 too many requests")
        return [[float(len(t.split()))] for t in texts]

    refused = F.when(c("doc_id") % 7 == 3, F.concat(F.lit("refuse "), c("doc_id"))).otherwise(c("text"))
    rows = PR.provider_embeddings(v.documents.withColumn("text", refused), call, "text", width=1)
    return rows.select("doc_id", c("embedding")[0].cast("double").alias("first_value"), c("embedding_error").isNotNull().alias("refused"))


@query(
    "J4_attach_embeddings",
    """SELECT id AS chunk_id, CASE WHEN page_start % 5 <> 0 AND page_start % 7 <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first_value,
         CAST(CASE WHEN page_start % 5 = 0 THEN 0 WHEN page_start % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS found FROM v_nodes""",
)
def j4(v):
    """Chunks without a vector and with two of them are reported, not fatal."""
    chunks = v.nodes.select(c("id").alias("chunk_id"), "page_start")
    vectors = v.nodes.where("page_start % 5 <> 0").select(
        c("id").alias("chunk_id"), "embedding", F.explode(F.sequence(F.lit(1), F.when(c("page_start") % 7 == 0, 2).otherwise(1)))
    )
    good, bad = PR.attach_embeddings(chunks, vectors)
    first = F.round(c("embedding")[0].cast("double"), 6).alias("first_value")
    return good.select("chunk_id", first, F.lit(1).cast("bigint").alias("found")).unionByName(
        bad.select("chunk_id", F.lit(None).cast("double").alias("first_value"), "found")
    )


# --- building ---------------------------------------------------------------------------------------------


@query(
    "G10_summarize_group",
    """SELECT document_id, cluster_no, summary AS content, page_start, page_end, n_members, layout_partition, layout_strategy FROM (
         SELECT document_id, cluster_no, nullif(min(page_start - 1), 0) AS page_start, max(page_end) AS page_end, count(*) AS n_members,
           CASE WHEN min(layout_partition) = max(layout_partition) THEN min(layout_partition) END AS layout_partition, min(layout_strategy) AS layout_strategy FROM v_nodes GROUP BY document_id, cluster_no)
       JOIN v_summaries USING (document_id, cluster_no)""",
)
def g10(v):
    """Pages count from zero here, so groups on the first page lose their start."""
    members = members_of(v).withColumns({"page_start": c("page_start") - 1, "section_hierarchy": F.lit(None).cast(HIERARCHY)})
    made = T.summarize_groups(members, [DOC, "cluster_no"], PR.extractive_summaries)
    return made.select(DOC, "cluster_no", "content", "page_start", "page_end", "n_members", "layout_partition", "layout_strategy")


@query("C10_leaf_nodes_from_chunks", "SELECT sha256(document_id || '|run|0|' || chunk_index) AS id, document_id, owner_id, 'leaf' AS node_type, 0 AS level, content, page_start, chunk_index FROM v_nodes")
def c10(v):
    leaves = T.leaf_nodes_from_chunks(v.nodes.drop("id", "node_type", "level"))
    return leaves.select("id", DOC, "owner_id", "node_type", "level", "content", "page_start", "chunk_index")


@query("U1_leaf_union_summary", "SELECT id, document_id, node_type, level FROM v_tree")
def u1(v):
    tree = v.tree
    return T.leaf_union_summary(tree.where("node_type = 'leaf'"), tree.where("node_type = 'summary'")).select("id", DOC, "node_type", "level")


@query("U2_carryover_union", "SELECT 'sum-' || document_id || '-' || cluster_no AS id, CAST(min(chunk_index) AS BIGINT) AS ord FROM v_nodes WHERE cluster_no < 5 GROUP BY document_id, cluster_no UNION ALL SELECT id, chunk_index FROM v_nodes WHERE cluster_no >= 5")
def u2(v):
    members = T.conform(v.nodes).join(v.nodes.select("id", "cluster_no"), "id").withColumn("ord", c("chunk_index").cast("bigint"))
    taken = members.where("cluster_no < 5")
    made = T.summarize_groups(taken, [DOC, "cluster_no"], PR.extractive_summaries)
    named = F.concat_ws("-", F.lit("sum"), DOC, c("cluster_no").cast("string"))
    ready = made.withColumns({"id": named, "ord": c("first_ord"), "embedding": F.lit(None).cast("array<float>")})
    return T.carryover_union(ready, members.where("cluster_no >= 5")).select("id", "ord")


view("v_section_nodes", "SELECT document_id, chunk_index AS ord, string_split(path, '/') AS path FROM (" + C22_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ")")


def section_leaves(v):
    """Hierarchical chunks as leaves with a hashed embedding."""
    chunks = K.hierarchical_chunks(v.headed.withColumnRenamed("line_no", "block_no"))
    return T.leaf_nodes_from_chunks(PR.hashed_embeddings(chunks.withColumn("owner_id", F.lit("owner-1"))))


@query("G12_path_counts", "SELECT document_id, array_to_string(path, '/') AS path, count(*) AS n_nodes FROM v_section_nodes GROUP BY document_id, path")
def g12(v):
    return T.path_counts(section_leaves(v)).withColumn("path", F.replace("path", F.lit("\x1f"), F.lit("/")))


def structural_sql(levels: int) -> str:
    """One block of tables per tree level, from positions and paths alone."""
    parts = ["s0 AS (SELECT document_id, CAST(ord AS BIGINT) AS ord, path FROM v_section_nodes)"]
    for level in range(1, levels + 1):
        src = f"s{level - 1}"
        parts += [
            f"""a{level} AS (SELECT *, count(*) OVER (PARTITION BY document_id, path) AS c FROM {src}
                  WHERE document_id IN (SELECT document_id FROM {src} GROUP BY document_id HAVING count(*) > 1))""",
            f"b{level} AS (SELECT *, CASE WHEN c > 1 THEN path WHEN len(path) > 1 THEN path[:-2] END AS gp FROM a{level})",
            f"""d{level} AS (SELECT document_id, ord, path, CASE WHEN bool_or(gp IS NOT NULL) OVER (PARTITION BY document_id) THEN gp ELSE ['document-root'] END AS gp FROM b{level})""",
            f"""g{level} AS (SELECT document_id, gp, count(*) AS n, arg_min(path, ord) AS fp, row_number() OVER (PARTITION BY document_id ORDER BY min(ord)) - 1 AS gno
                  FROM d{level} WHERE gp IS NOT NULL GROUP BY document_id, gp)""",
            f"""n{level} AS (SELECT document_id, {level} AS level, gno, n, CASE WHEN len(gp) = 0 THEN CAST([] AS VARCHAR[]) WHEN list_contains(fp, gp[-1]) THEN fp[1:list_position(fp, gp[-1])] ELSE fp END AS path FROM g{level})""",
            f"""s{level} AS (SELECT document_id, gno AS ord, path FROM n{level} UNION ALL
                  SELECT document_id, 1000000 + ord, path FROM d{level} WHERE gp IS NULL)""",
        ]
    rows = " UNION ALL ".join(f"SELECT * FROM n{level}" for level in range(1, levels + 1))
    return f"""WITH {", ".join(parts)} SELECT document_id, CAST(level AS INTEGER) AS level, 'structural-level-' || level || '-cluster-' || gno AS cluster_id, n AS n_members,
      array_to_string(path, '/') AS path, coalesce(path[-1], 'document-root') AS section_key, CASE WHEN len(path) > 1 THEN path[-2] END AS section_parent_key, CAST(len(path) AS INTEGER) AS structural_depth FROM ({rows})"""


@query(
    "G13_structural_groups",
    """SELECT document_id, CAST(ord AS INTEGER) AS chunk_index, array_to_string(CASE WHEN bool_or(gp IS NOT NULL) OVER (PARTITION BY document_id) THEN gp ELSE ['document-root'] END, '/') AS group_path FROM (
         SELECT *, CASE WHEN count(*) OVER (PARTITION BY document_id, path) > 1 THEN path WHEN len(path) > 1 THEN path[:-2] END AS gp FROM v_section_nodes)""",
)
def g13(v):
    groups = T.structural_groups(section_leaves(v))
    return groups.select(DOC, "chunk_index", F.array_join("group_path", "/").alias("group_path"))


@query("C9_build_structural_tree", structural_sql(7))
def c9(v):
    tree = T.build_structural_tree(section_leaves(v))
    sizes = tree.groupBy(DOC, c("parent_id").alias("id")).agg(F.count("*").alias("n_members"))
    made = tree.where("node_type = 'summary'").join(sizes, [DOC, "id"])
    return made.select(
        DOC, "level", "cluster_id", "n_members", F.array_join(F.transform("section_hierarchy", lambda h: h["key"]), "/").alias("path"),
        "section_key", "section_parent_key", "structural_depth",
    )


@query("C8_build_summary_tree_levels")
def c8(v):
    tree = T.build_summary_tree_levels(v.nodes.drop("cluster_id", "cluster_no"))
    return tree.select(DOC, "id", "node_type", "level", "cluster_id", "parent_id", "member_no", "page_start", "page_end")


view(
    "v_plan",
    """SELECT document_id, CASE WHEN len(shrink) > 1 AND shrink[-1] > 1 THEN shrink || [CAST(1 AS BIGINT)] ELSE shrink END AS plan FROM (
         SELECT document_id, list(size ORDER BY step) AS shrink FROM (
           SELECT document_id, step, CASE WHEN step = 0 THEN n ELSE CAST(ceil(n / CAST(power(4, step) AS DOUBLE)) AS BIGINT) END AS size,
             CASE WHEN step = 0 THEN n ELSE CAST(ceil(n / CAST(power(4, step - 1) AS DOUBLE)) AS BIGINT) END AS before
           FROM (SELECT document_id, count(*) AS n FROM v_nodes GROUP BY document_id), (SELECT unnest(generate_series(0, 12)) AS step))
         WHERE step = 0 OR before >= 4 GROUP BY document_id)""",
)


def level_sql(n: int) -> str:
    """Tables of one tree level: runs of neighbours as clusters, merging, summaries, next nodes."""
    p = f"cur{n - 1}"
    words = S.n_words("content")
    return f"""
    grow{n} AS (SELECT document_id, n, plan[{n + 1}] AS target FROM (SELECT document_id, count(*) AS n FROM {p} GROUP BY document_id) JOIN v_plan USING (document_id) WHERE n > 1 AND plan[{n + 1}] < n),
    lab{n} AS (SELECT c.*, ord * target // n AS cluster_no FROM {p} c JOIN grow{n} USING (document_id)),
    dia{n} AS (SELECT *, words < 200 AS is_tiny FROM (SELECT document_id, cluster_no, sum({words}) AS words, nullif(min(coalesce(page_start, 0)), 0) AS ps, nullif(max(coalesce(page_end, 0)), 0) AS pe,
        CASE WHEN min(part) = max(part) AND count(part) = count(*) THEN min(part) ELSE 'mixed' END AS part FROM lab{n} GROUP BY document_id, cluster_no)),
    tar{n} AS (SELECT document_id, cluster_no, partner FROM (SELECT *, row_number() OVER (PARTITION BY document_id, cluster_no ORDER BY other_part, other_tiny, distance, words, partner) AS rn FROM (
        SELECT a.document_id, a.cluster_no, b.cluster_no AS partner, CASE WHEN a.part = b.part THEN 0 ELSE 1 END AS other_part, CASE WHEN b.is_tiny THEN 1 ELSE 0 END AS other_tiny, b.words,
          CASE WHEN a.pe < b.ps THEN b.ps - a.pe WHEN b.pe < a.ps THEN a.ps - b.pe ELSE 0 END AS distance
        FROM dia{n} a JOIN dia{n} b ON a.document_id = b.document_id AND a.cluster_no <> b.cluster_no WHERE a.is_tiny)) WHERE rn = 1),
    lnk{n} AS (SELECT document_id, cluster_no AS a, partner AS b FROM tar{n} UNION SELECT document_id, partner, cluster_no FROM tar{n} UNION SELECT document_id, cluster_no, cluster_no FROM dia{n}),
    rea{n} AS (SELECT document_id, a, b FROM lnk{n} UNION SELECT r.document_id, r.a, l.b FROM rea{n} r JOIN lnk{n} l ON l.document_id = r.document_id AND l.a = r.b),
    com{n} AS (SELECT document_id, a AS cluster_no, dense_rank() OVER (PARTITION BY document_id ORDER BY root) - 1 AS no FROM (SELECT document_id, a, min(b) AS root FROM rea{n} GROUP BY document_id, a)),
    mem{n} AS (SELECT l.*, no FROM lab{n} l JOIN com{n} USING (document_id, cluster_no)),
    ver{n} AS (SELECT document_id, no, sum({words}) >= 100 AS enough, count(*) AS n_members FROM mem{n} GROUP BY document_id, no),
    kep{n} AS (SELECT document_id FROM (SELECT document_id, count(*) AS k, sum(CASE WHEN enough THEN 1 ELSE n_members END) AS following FROM ver{n} GROUP BY document_id) JOIN grow{n} USING (document_id)
        WHERE (k > 1 OR target = 1) AND following < n),
    act{n} AS (SELECT m.*, enough FROM mem{n} m JOIN kep{n} USING (document_id) JOIN ver{n} USING (document_id, no)),
    sen{n} AS (SELECT document_id, no, ord, i, sentence, {S.words('lower(sentence)')} AS ws FROM (SELECT document_id, no, ord, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM (
        SELECT *, list_filter(list_transform(regexp_extract_all(content, '[^.?!]+[.?!]*'), lambda s: {S.collapse('s')}), lambda s: s <> '') AS ss FROM act{n} WHERE enough))),
    tok{n} AS (SELECT document_id, no, ord, i, unnest(ws) AS w FROM sen{n}),
    frq{n} AS (SELECT document_id, no, w, count(*) AS tf FROM tok{n} GROUP BY document_id, no, w),
    sco{n} AS (SELECT document_id, no, ord, i, CAST(sum(tf) AS DOUBLE) / count(*) AS score, count(*) AS n FROM tok{n} JOIN frq{n} USING (document_id, no, w) GROUP BY document_id, no, ord, i),
    ran{n} AS (SELECT *, row_number() OVER (PARTITION BY document_id, no ORDER BY score DESC, ord, i) AS pick FROM sco{n}),
    cut{n} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id, no ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ran{n}),
    tex{n} AS (SELECT document_id, no, string_agg(sentence, ' ' ORDER BY ord, i) AS content FROM cut{n} JOIN sen{n} USING (document_id, no, ord, i) WHERE before < 160 GROUP BY document_id, no),
    sum{n} AS (SELECT document_id, no, {n} AS level, coalesce(content, '') AS content, ps, pe, part, n_members, first_ord FROM (
        SELECT document_id, no, nullif(min(coalesce(page_start, 0)), 0) AS ps, nullif(max(coalesce(page_end, 0)), 0) AS pe, CASE WHEN min(part) = max(part) AND count(part) = count(*) THEN min(part) END AS part,
          count(*) AS n_members, min(ord) AS first_ord FROM act{n} WHERE enough GROUP BY document_id, no) LEFT JOIN tex{n} USING (document_id, no)),
    cur{n} AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY no, ord) - 1 AS ord, content, page_start, page_end, part FROM (
        SELECT document_id, no, first_ord AS ord, content, ps AS page_start, pe AS page_end, part FROM sum{n}
        UNION ALL SELECT document_id, no, ord, content, page_start, page_end, part FROM act{n} WHERE NOT enough))"""


def tree_sql(levels: int) -> str:
    first = "cur0 AS (SELECT document_id, CAST(chunk_index AS BIGINT) AS ord, content, page_start, page_end, layout_partition AS part FROM v_nodes)"
    rows = " UNION ALL ".join(f"SELECT * FROM sum{n}" for n in range(1, levels + 1))
    return f"""WITH RECURSIVE {first}, {", ".join(level_sql(n) for n in range(1, levels + 1))}
    SELECT document_id, level, 'level-' || level || '-cluster-' || no AS cluster_id, content, ps AS page_start, pe AS page_end, part AS layout_partition, n_members FROM ({rows})"""


def neighbour_runs(nodes, targets):
    """Clusters of neighbouring nodes: position times target over size."""
    sizes = nodes.groupBy(DOC).agg(F.count("*").alias("n")).join(targets, DOC)
    run = F.floor(c("ord") * c("target") / c("n")).cast("int")
    return nodes.join(sizes, DOC).withColumn("cluster_no", run).select(DOC, "id", "ord", "cluster_no")


@query("C8_build_summary_tree_levels_runs", tree_sql(4))
def c8r(v):
    """Whole trees on a clustering SQL can state: merging, carrying over, summaries and stop rules at every level."""
    tree = T.build_summary_tree_levels(v.nodes.drop("cluster_id", "cluster_no"), cluster=neighbour_runs)
    sizes = tree.groupBy(DOC, c("parent_id").alias("id")).agg(F.count("*").alias("n_members"))
    made = tree.where("node_type = 'summary'").join(sizes, [DOC, "id"])
    return made.select(DOC, "level", "cluster_id", "content", "page_start", "page_end", "layout_partition", "n_members")


# --- reading ----------------------------------------------------------------------------------------------------


def partial_trees(v):
    """Owner 1 lost its roots, owner 2 all its summaries."""
    lost = ((c("owner_id") == "owner-1") & (c("level") == 2)) | ((c("owner_id") == "owner-2") & (c("level") > 0))
    return v.tree.where(~lost)


view("v_partial", "SELECT * FROM v_tree WHERE NOT ((owner_id = 'owner-1' AND level = 2) OR (owner_id = 'owner-2' AND level > 0))")
view("v_edges", "SELECT c.document_id, c.parent_id, c.id AS child_id, c.member_no FROM v_partial c JOIN v_partial p ON p.document_id = c.document_id AND p.id = c.parent_id WHERE p.node_type = 'summary'")
view(
    "v_roots",
    """WITH r AS (SELECT * FROM v_partial n WHERE node_type = 'summary' AND NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.document_id = n.document_id AND e.child_id = n.id))
       SELECT * FROM r UNION ALL SELECT * FROM v_partial WHERE node_type = 'leaf' AND document_id NOT IN (SELECT document_id FROM r)""",
)


@query("J5_tree_children", "SELECT document_id, parent_id, child_id, CAST(row_number() OVER (PARTITION BY document_id, parent_id ORDER BY member_no) - 1 AS INTEGER) AS member_no FROM v_edges")
def j5(v):
    """Edges from stored child lists; one unknown id at the end of each list is dropped."""
    tree = partial_trees(v)
    lists = tree.where("parent_id IS NOT NULL").groupBy(DOC, c("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("member_no", "id"))).alias("m")
    )
    child_ids = F.array_append(F.transform("m", lambda m: m["id"]), F.lit("gone"))
    stored = tree.join(lists.select(DOC, "id", child_ids.alias("child_ids")), [DOC, "id"], "left")
    return T.edges_from_child_ids(stored).select(DOC, "parent_id", "child_id", "member_no")


@query("J6_tree_roots", "SELECT document_id, id FROM v_roots")
def j6(v):
    tree = partial_trees(v)
    return T.tree_roots(tree, T.tree_edges(tree)).select(DOC, "id")


@query("T7_order_roots", "SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY -level, coalesce(nullif(chunk_index, 0), -1), id) - 1 AS INTEGER) AS root_no FROM v_roots")
def t7(v):
    tree = partial_trees(v)
    return T.order_roots(T.tree_roots(tree, T.tree_edges(tree))).select(DOC, "id", "root_no")


@query("T6_order_nodes", "SELECT id, level, chunk_index FROM v_tree ORDER BY level DESC, chunk_index NULLS LAST")
def t6(v):
    return T.order_nodes(v.tree.withColumn("created_at", F.lit(0))).select("id", "level", "chunk_index")


CLOSURE = "down AS (SELECT document_id, id AS start_id, id, 0 AS depth, CAST('' AS VARCHAR) AS path FROM v_partial WHERE node_type = 'summary' UNION ALL SELECT d.document_id, d.start_id, e.child_id, d.depth + 1, d.path || '/' || e.member_no FROM down d JOIN v_edges e ON e.document_id = d.document_id AND e.parent_id = d.id)"


@query("J13_descendants", f"WITH RECURSIVE {CLOSURE} SELECT document_id, start_id, id, depth, path FROM down")
def j13(v):
    tree = partial_trees(v)
    found = T.descendants(T.tree_edges(tree), tree.where("node_type = 'summary'"))
    path = F.array_join(F.transform("path", lambda p: F.concat(F.lit("/"), p.cast("string"))), "")
    return found.select(DOC, "start_id", "id", "depth", path.alias("path"))


@query("J13_leaf_evidence", f"WITH RECURSIVE {CLOSURE} SELECT d.document_id, start_id, d.id, n.page_start, n.page_end FROM down d JOIN v_partial n ON n.document_id = d.document_id AND n.id = d.id WHERE n.node_type = 'leaf'")
def j13e(v):
    tree = partial_trees(v)
    rows = T.leaf_evidence(tree, T.tree_edges(tree), tree.where("node_type = 'summary'"))
    return rows.select(DOC, "start_id", "id", "page_start", "page_end")


@query("P12_evidence_highlights", f"WITH RECURSIVE {CLOSURE} SELECT start_id, d.id, coalesce(nullif(n.page_start - 1, 0), s.page_start) AS page, n.chunk_index * 10 AS top FROM down d JOIN v_partial n ON n.document_id = d.document_id AND n.id = d.id JOIN v_partial s ON s.document_id = d.document_id AND s.id = d.start_id WHERE n.node_type = 'leaf' AND n.chunk_index % 2 = 0")
def p12(v):
    """Even chunks carry a box; pages count from zero, so the first page falls back to the node's."""
    tree = partial_trees(v)
    leaves = tree.withColumns(
        {
            "bbox": F.when(c("chunk_index") % 2 == 0, F.struct((c("chunk_index") * 10).alias("top"))),
            "page_start": c("page_start") - 1,
        }
    )
    starts = tree.where("node_type = 'summary'")
    pages = starts.select(DOC, c("id").alias("start_id"), c("page_start").alias("node_page"))
    evidence = T.leaf_evidence(leaves, T.tree_edges(tree), starts).join(pages, [DOC, "start_id"])
    return T.evidence_highlights(evidence).select("start_id", "id", "page", c("bbox.top").alias("top"))


@query("G17_leaf_source_count", f"WITH RECURSIVE {CLOSURE} SELECT n.document_id, n.id, CASE WHEN n.node_type = 'leaf' THEN 1 ELSE count(l.id) END AS source_count FROM v_partial n LEFT JOIN down d ON d.document_id = n.document_id AND d.start_id = n.id LEFT JOIN v_partial l ON l.document_id = d.document_id AND l.id = d.id AND l.node_type = 'leaf' GROUP BY n.document_id, n.id, n.node_type")
def g17(v):
    tree = partial_trees(v)
    return T.leaf_source_counts(tree, T.tree_edges(tree))


@query("G20_tree_depth", f"WITH RECURSIVE {CLOSURE} SELECT n.document_id, n.id, CAST(coalesce(max(d.depth), 0) AS INTEGER) AS height FROM v_partial n LEFT JOIN down d ON d.document_id = n.document_id AND d.start_id = n.id GROUP BY n.document_id, n.id")
def g20(v):
    tree = partial_trees(v)
    return T.node_heights(tree, T.tree_edges(tree))


@query("G14_tree_stats", "SELECT j.document_id, count(CASE WHEN node_type = 'leaf' THEN 1 END) AS leaf_count, count(CASE WHEN node_type = 'summary' THEN 1 END) AS summary_count, coalesce(max(level), 0) AS max_level FROM v_jobs j LEFT JOIN v_partial n USING (document_id) GROUP BY j.document_id")
def g14(v):
    from suite.catalog_queries import jobs_of

    return T.tree_stats(partial_trees(v), jobs_of(v))


@query(
    "G16_synthesize_root",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY -level, coalesce(nullif(chunk_index, 0), -1), id) AS rn FROM v_roots),
         agg AS (SELECT document_id, count(*) AS n, min(nullif(page_start, 0)) AS ps, max(nullif(page_end, 0)) AS pe, arg_min(nullif(content, ''), rn) AS content FROM ranked GROUP BY document_id),
         st AS (SELECT document_id, max(level) AS max_level, count(CASE WHEN node_type = 'leaf' THEN 1 END) AS leaves FROM v_partial GROUP BY document_id)
       SELECT a.document_id, CASE WHEN n = 1 THEN r.id ELSE 'root-' || a.document_id END AS id, 'root_summary' AS node_type, CASE WHEN n = 1 THEN r.level ELSE max_level + 1 END AS level,
         CASE WHEN n = 1 THEN {S.title('r.content')} ELSE 'Document Summary' END AS title, CASE WHEN n = 1 THEN r.page_start ELSE ps END AS page_start, CASE WHEN n = 1 THEN r.page_end ELSE pe END AS page_end,
         CASE WHEN n = 1 THEN r.content ELSE a.content END AS content, leaves AS source_count
       FROM agg a JOIN ranked r ON r.document_id = a.document_id AND r.rn = 1 JOIN st ON st.document_id = a.document_id""",
)
def g16(v):
    tree = partial_trees(v)
    return T.synthesize_root(tree, T.tree_edges(tree))


@query("P13_serialize_node", "SELECT id, document_id, node_type, level, content, CAST(NULL AS VARCHAR) AS encrypted_content, CAST(NULL AS VARCHAR) AS content_iv, CAST(NULL AS VARCHAR) AS crypto_version, page_start, page_end, chunk_index, CAST(NULL AS VARCHAR) AS cluster_id, parent_id, '{}' AS metadata FROM v_tree")
def p13(v):
    return T.serialize_nodes(v.tree)


@query(
    "C19_summary_tree",
    "SELECT n.document_id, n.id, n.level, e.parent_id, e.member_no, r.id IS NOT NULL AS is_root FROM v_partial n LEFT JOIN v_edges e ON e.document_id = n.document_id AND e.child_id = n.id LEFT JOIN v_roots r ON r.document_id = n.document_id AND r.id = n.id",
)
def c19(v):
    tree = T.summary_tree(partial_trees(v))
    edges = tree["edges"].withColumnRenamed("child_id", "id")
    roots = tree["roots"].select(DOC, "id", F.lit(True).alias("is_root"))
    nodes = tree["nodes"].select(DOC, "id", "level")
    return nodes.join(edges, [DOC, "id"], "left").join(roots, [DOC, "id"], "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))


# --- preview ------------------------------------------------------------------------------------------------------


def preview_requests(v):
    """Every document asks for a preview; some with a target, some unknown."""
    n = c("doc_id")
    return v.table("documents").select(
        F.concat(F.lit("doc-"), n.cast("string")).alias(DOC),
        F.when(n % 3 == 0, "adversarial").when(n % 3 == 1, "other").alias("layout_strategy"),
        F.when(n % 2 == 0, (n % 40).cast("int")).alias("requested"),
    )


view("v_preview", """SELECT 'doc-' || doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'ADVERSARIAL' ELSE 'TRANSACTIONAL' END AS layout_strategy, CASE WHEN doc_id % 2 = 0 THEN doc_id % 40 END AS requested FROM documents""")
PREVIEW_SQL = """SELECT p.document_id, p.layout_strategy, n AS leaf_count, n_clusters AS cluster_count, n_tiny AS tiny_cluster_count, 100 AS min_summary_words, 200 AS tiny_group_words,
    CAST(CASE WHEN n <= 1 THEN n WHEN requested IS NOT NULL THEN greatest(1, least(requested, n)) ELSE greatest(2, least(5, ceil(sqrt(n / CAST(2 AS DOUBLE))))) END AS INTEGER) AS target_clusters
  FROM (SELECT p.*, coalesce(n, 0) AS n, coalesce(n_clusters, 0) AS n_clusters, coalesce(n_tiny, 0) AS n_tiny FROM v_preview p LEFT JOIN (SELECT document_id, count(*) AS n FROM v_nodes GROUP BY document_id) USING (document_id)
    LEFT JOIN (SELECT document_id, count(*) AS n_clusters, count(CASE WHEN is_tiny THEN 1 END) AS n_tiny FROM v_diag GROUP BY document_id) USING (document_id)) p"""


@query("G15_preview_stats", PREVIEW_SQL)
def g15(v):
    targets = preview.preview_targets(v.nodes, preview_requests(v))
    return preview.preview_stats(targets, P.cluster_diagnostics(members_of(v)))


@query("C17_cluster_preview", PREVIEW_SQL)
def c17(v):
    """The whole preview on given labels."""
    labels = members_of(v).select(DOC, "id", "cluster_no")
    return preview.cluster_preview(members_of(v), preview_requests(v), cluster=lambda nodes, targets: labels)["stats"]


@query("C17_cluster_preview_fitted")
def c17f(v):
    """The preview with fitted clusters, partitions kept apart where the strategy asks for it."""
    return preview.cluster_preview(members_of(v), preview_requests(v))["clusters"].select(*DIAG, "merge_target")
