"""Clustering of node embeddings: mixture fits, partition quotas, coarse index lists.

Rows: document_id, id, ord (0-based position in the document), embedding.
Result rows carry ``cluster_no``, numbered from 0 by first appearance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import trees
from arbora.operators.scan import grouped_segment, ordinal_segment, prefix_scan
from arbora.session import bound_batches, cut_lineage

# Vectors in one task's matrix; how a document is cut into blocks does not change its fit.
BLOCK_ROWS = 4096
ROUNDS = 100
TOLERANCE = 1e-4
FLOOR = 1e-6
#: Rows per component that may be first means.
CANDIDATES = 16
SEED = 42


# --- mixture fits ---------------------------------------------------------------------------


def log_densities(x: np.ndarray, share: np.ndarray, means: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Log of share times diagonal Gaussian density, rows by components."""
    precision = 1.0 / spread
    distance = (x**2) @ precision.T - 2.0 * x @ (means * precision).T + (means**2 * precision).sum(axis=1)
    return np.log(share) - 0.5 * (distance + np.log(spread).sum(axis=1) + x.shape[1] * np.log(2 * np.pi))


def partial_sums(x: np.ndarray, state: np.ndarray, k: int) -> np.ndarray:
    """What a block adds to the next round: per component mass, sum and sum of squares; then the log likelihood."""
    log_p = log_densities(x, *unpacked(state, k))
    top = log_p.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
    resp = np.exp(log_p - total[:, None])
    return np.concatenate([resp.sum(axis=0), (resp.T @ x).ravel(), (resp.T @ x**2).ravel(), [total.sum()]])


def unpacked(state: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    share, rest = state[:k], state[k:].reshape(2, k, -1)
    return share, rest[0], rest[1]


def next_state(sums: np.ndarray, k: int) -> np.ndarray:
    """Shares, means and variances from the sums of all blocks."""
    mass, rest = sums[:k] + 1e-10, sums[k:-1].reshape(2, k, -1)
    means = rest[0] / mass[:, None]
    spread = np.maximum(rest[1] / mass[:, None] - means**2, 0.0) + FLOOR
    return np.concatenate([mass / mass.sum(), means.ravel(), spread.ravel()])


def first_state(candidates: np.ndarray, k: int, variance: np.ndarray) -> np.ndarray:
    """Means at candidates far from each other, from the first one on; ties go to the earlier one."""
    chosen = [0]
    nearest = ((candidates - candidates[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
    alike = np.full(candidates.shape[1], variance.mean() + FLOOR)  # the first round goes by plain distance
    return np.concatenate([np.full(k, 1.0 / k), candidates[chosen].ravel(), np.tile(alike, k)])


def _joined_rounds(blocks: DataFrame, states: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """Fit documents of several blocks: one job per round, sums combined map side; documents leave when they stand still."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    types = dict(blocks.dtypes)
    key_schema = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def add(frames):
        for f in frames:
            sums = [partial_sums(np.stack(list(v)).astype(float), np.asarray(s), k) for v, s, k in zip(f["vectors"], f["state"], f["k"])]
            yield f[keys].assign(sums=sums)

    def step(frames):
        for f in frames:
            states_ = [next_state(np.asarray(s), k) for s, k in zip(f["sums"], f["k"])]
            now = [s[-1] / n for s, n in zip(f["sums"], f["n"])]
            done = [abs(a - b) < TOLERANCE for a, b in zip(now, f["before"])]
            yield f[[*keys, "k", "n"]].assign(state=states_, before=now, converged=done)

    active, done = states.withColumns({"before": F.lit(float("-inf")), "converged": F.lit(False)}), []
    for _ in range(rounds):
        active = cut_lineage(active)
        if active.isEmpty():
            break
        sums = blocks.select(*keys, "vectors").join(active.select(*keys, "k", "state"), keys)
        added = sums.mapInPandas(add, f"{key_schema}, sums array<double>")
        total = added.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        joined = total.join(active.select(*keys, "k", "n", "before"), keys)
        moved = cut_lineage(joined.mapInPandas(step, f"{key_schema}, k int, n bigint, state array<double>, before double, converged boolean"))
        done.append(moved.where("converged"))
        active = moved.where("NOT converged")
    return reduce(DataFrame.unionByName, done, active)


def fit_mixtures(vectors_of: DataFrame, keys: Sequence[str], rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``label`` and ``converged`` of every row by a diagonal Gaussian mixture per key.

    Rows: keys, id, ord, embedding, ``k`` components. Means start at candidates
    evenly spread along ``ord``, variances at the key's own. Expectation and
    maximisation are sums over blocks; a key with one block adds them up in
    its task, others in a job per round. A key still moving after ``rounds``
    keeps its state and says ``converged = false``.
    """
    keys = list(keys)
    bound_batches(vectors_of.sparkSession)  # a row is a block of vectors
    types = dict(vectors_of.dtypes)
    key_schema = ", ".join(f"`{c}` {types[c]}" for c in keys)
    placed = prefix_scan(vectors_of, keys, ["ord"], ordinal_segment("ord"), sums={"at": F.lit(1)}, totals={"n": F.lit(1)})
    at, k, n = F.col("at") - 1, F.col("k"), F.col("n")
    spread = F.least(n, k * CANDIDATES)
    seed = F.floor((at + 1) * spread / n) > F.floor(at * spread / n)
    marked = placed.select(*keys, "id", "ord", "embedding", k.cast("int").alias("k"), n.cast("bigint").alias("n"), F.floor(at / block_rows).alias("block"), seed.alias("seed"))
    row = F.struct("ord", "id", F.col("embedding").cast("array<double>").alias("v"), "seed")
    packed = marked.groupBy(*keys, "k", "n", "block").agg(F.sort_array(F.collect_list(row)).alias("r"))
    fields = {"ids": "id", "ords": "ord", "vectors": "v", "seeds": "seed"}
    blocks = cut_lineage(packed.select(*keys, "k", "n", "block", *(F.col(f"r.{f}").alias(name) for name, f in fields.items())))

    def whole(frames):
        for f in frames:
            labels, done = [], []
            for vectors, seeds, k_ in zip(f["vectors"], f["seeds"], f["k"]):
                x = np.stack(list(vectors)).astype(float)
                state, before, still = first_state(x[np.asarray(seeds, bool)], k_, x.var(axis=0)), -np.inf, False
                for _ in range(rounds):
                    sums = partial_sums(x, state, k_)
                    state, now = next_state(sums, k_), sums[-1] / len(x)
                    if abs(now - before) < TOLERANCE:
                        still = True
                        break
                    before = now
                labels.append(log_densities(x, *unpacked(state, k_)).argmax(axis=1).astype(np.int32))
                done.append(still)
            yield f[[*keys, "ids", "ords"]].assign(labels=labels, converged=done)

    def label(frames):
        for f in frames:
            labels = [log_densities(np.stack(list(v)).astype(float), *unpacked(np.asarray(s), k_)).argmax(axis=1).astype(np.int32) for v, s, k_ in zip(f["vectors"], f["state"], f["k"])]
            yield f[[*keys, "ids", "ords"]].assign(labels=labels, converged=f["converged"])

    out = f"{key_schema}, ids array<{types['id']}>, ords array<{types['ord']}>, labels array<int>, converged boolean"
    one, several = blocks.where(F.col("n") <= block_rows), blocks.where(F.col("n") > block_rows)
    states = _first_states(several, keys, key_schema)
    fitted = _joined_rounds(several, states, keys, rounds)
    labelled = one.mapInPandas(whole, out).unionByName(several.join(fitted.select(*keys, "state", "converged"), keys).mapInPandas(label, out))
    each = labelled.select(*keys, F.explode(F.arrays_zip("ids", "ords", "labels")).alias("z"), "converged")
    return cut_lineage(each.select(*keys, F.col("z.ids").alias("id"), F.col("z.ords").alias("ord"), F.col("z.labels").alias("label"), "converged"))


def _first_states(blocks: DataFrame, keys: list[str], key_schema: str) -> DataFrame:
    """Seeds in their order and the variance of the key, from one row per block."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def moments(frames):
        for f in frames:
            xs = [np.stack(list(v)).astype(float) for v in f["vectors"]]
            seeds = [x[np.asarray(s, bool)].ravel() for x, s in zip(xs, f["seeds"])]
            yield f[[*keys, "k", "n", "block"]].assign(sums=[np.r_[x.sum(axis=0), (x**2).sum(axis=0)] for x in xs], seeds=seeds)

    def start(frames):
        for f in frames:
            states = []
            for sums, seeds, k, n in zip(f["sums"], f["seeds"], f["k"], f["n"]):
                mean, square = np.asarray(sums).reshape(2, -1) / n
                states.append(first_state(np.asarray(seeds).reshape(-1, len(mean)), k, np.maximum(square - mean**2, 0.0)))
            yield f[[*keys, "k", "n"]].assign(state=states)

    parts = blocks.mapInPandas(moments, f"{key_schema}, k int, n bigint, block bigint, sums array<double>, seeds array<double>")
    total = parts.groupBy(*keys, "k", "n").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "seeds"))), lambda b: b["seeds"])).alias("seeds"),
    )
    return total.mapInPandas(start, f"{key_schema}, k int, n bigint, state array<double>")


# --- numbering -------------------------------------------------------------------------------


def number_clusters(labelled: DataFrame, keys: Sequence[str], labels: Sequence[str], lead: str | None = None) -> DataFrame:
    """``cluster_no`` per key in order of each cluster's first member.

    ``lead`` names a leading sort column (for example the partition's own first member).
    """
    extra = [lead] if lead else []
    firsts = labelled.groupBy(*keys, *labels).agg(
        F.min("ord").alias("__first"), *[F.min(lead).alias(lead) for _ in extra]
    )
    segment = grouped_segment(F.col(lead), F.col("__first")) if lead else ordinal_segment("__first")
    numbered = prefix_scan(firsts, keys, [*extra, "__first"], segment, sums={"__n": F.lit(1)})
    names = numbered.select(*keys, *labels, (F.col("__n") - 1).cast("int").alias("cluster_no"))
    return labelled.join(names, [*keys, *labels])


def cluster_labels(cluster_no: Column, prefix: str = "cluster-") -> Column:
    return F.concat(F.lit(prefix), cluster_no.cast("string"))


# --- clustering --------------------------------------------------------------------------------


def cluster_embeddings(
    nodes: DataFrame,
    targets: DataFrame,
    keys: Sequence[str] = ("document_id",),
    rounds: int = ROUNDS,
    block_rows: int = BLOCK_ROWS,
    report: bool = False,
) -> DataFrame:
    """Cluster every key's vectors into at most ``target`` groups.

    Up to two vectors, a target of one, or a target not below the number of
    vectors give one cluster.  Returns keys, id, ord, cluster_no, and with
    ``report`` whether the key's fit stood still within ``rounds``.
    """
    keys = list(keys)
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    wanted = F.coalesce(F.nullif(F.col("target").cast("int"), F.lit(0)), trees.default_cluster_count(F.col("__size")))
    k = F.greatest(F.lit(1), F.least(wanted, F.col("__size").cast("int")))
    single = (F.col("__size") <= 2) | (k <= 1) | (k >= F.col("__size"))
    plan = sizes.join(targets.select(*keys, "target"), keys, "left").select(*keys, F.when(single, 1).otherwise(k).alias("k"))
    planned = cut_lineage(nodes.select(*keys, "id", "ord", "embedding").join(plan, keys))
    whole = planned.where(F.col("k") == 1).select(*keys, "id", "ord", F.lit(0).alias("label"), F.lit(True).alias("converged"))
    labelled = whole.unionByName(fit_mixtures(planned.where(F.col("k") > 1), keys, rounds, block_rows))
    numbered = number_clusters(labelled, keys, ["label"])
    return numbered.select(*keys, "id", "ord", "cluster_no", *(["converged"] if report else []))


def cluster_globally(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Cluster each document's nodes regardless of partition."""
    return cluster_embeddings(nodes, targets)


def cluster_structurally(nodes: DataFrame) -> DataFrame:
    """One cluster per document."""
    return nodes.withColumn("cluster_no", F.lit(0))


def partition_of(partition: Column, enclave: Column | None = None) -> Column:
    options = [F.nullif(partition, F.lit(""))]
    if enclave is not None:
        options.append(F.nullif(enclave, F.lit("")))
    return F.coalesce(*options, F.lit("UNKNOWN"))


def allocate_cluster_counts(partitions: DataFrame, targets: DataFrame) -> DataFrame:
    """``quota`` of clusters per (document, partition).

    ``partitions``: document_id, partition, size, first_ord.  Every partition
    gets one; extra clusters go round by size, never beyond size - 1.  After r
    full rounds the extras dealt are sum(min(cap, r)), so the last full round
    and the remainder follow from prefix sums over the sorted caps.
    """
    doc = Window.partitionBy("document_id")
    by_cap = doc.orderBy("cap", "partition").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = partitions.withColumn("cap", F.greatest(F.lit(0), F.col("size") - 2)).join(
        targets.select("document_id", "target"), "document_id"
    )
    extra = F.greatest(F.lit(0), F.col("target") - F.count(F.lit(1)).over(doc))
    summed = capped.withColumns(
        {
            "extra": extra,
            "sum_cap": F.sum("cap").over(by_cap),
            "above": F.count(F.lit(1)).over(doc) - F.row_number().over(doc.orderBy("cap", "partition")),
        }
    )
    # Extras used when every cap is cut at this row's cap.
    cut = summed.withColumn("used", F.col("sum_cap") + F.col("above") * F.col("cap"))
    below = cut.withColumns(
        {
            "base_cap": F.coalesce(F.max(F.when(F.col("used") <= F.col("extra"), F.col("cap"))).over(doc), F.lit(0)),
            "base_used": F.coalesce(F.max(F.when(F.col("used") <= F.col("extra"), F.col("used"))).over(doc), F.lit(0)),
        }
    ).withColumn("taking", F.count_if(F.col("cap") > F.col("base_cap")).over(doc))
    rounds = F.when(
        F.col("taking") > 0, F.col("base_cap") + F.floor((F.col("extra") - F.col("base_used")) / F.col("taking"))
    ).otherwise(F.col("base_cap"))
    left = F.when(F.col("taking") > 0, (F.col("extra") - F.col("base_used")) % F.col("taking")).otherwise(0)
    dealt = below.withColumns({"rounds": rounds, "left": left})
    open_rank = F.sum(F.when(F.col("cap") > F.col("rounds"), 1).otherwise(0)).over(
        doc.orderBy(F.desc("size"), "first_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    got = F.least(F.col("cap"), F.col("rounds")) + F.when(
        (F.col("cap") > F.col("rounds")) & (open_rank <= F.col("left")), 1
    ).otherwise(0)
    return dealt.select("document_id", "partition", "size", "first_ord", (got + 1).cast("int").alias("quota"))


def cluster_by_partition(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Cluster inside layout partitions; nodes need ``layout_partition``."""
    enclave = F.col("party_enclave") if "party_enclave" in nodes.columns else None
    parted = nodes.withColumn("partition", partition_of(F.col("layout_partition"), enclave))
    sizes = cut_lineage(
        parted.groupBy("document_id", "partition").agg(
            F.count(F.lit(1)).alias("size"), F.min("ord").alias("first_ord")
        )
    )
    many = sizes.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_partitions")).join(targets, "document_id")
    quotas = allocate_cluster_counts(sizes, targets).join(many.select("document_id", "n_partitions", "target"), "document_id")
    merged = F.col("target") <= 1
    groups = quotas.select(
        "document_id",
        "partition",
        F.when(merged, F.lit("*")).otherwise(F.col("partition")).alias("group"),
        F.when(merged, 0).otherwise(F.col("first_ord")).alias("lead"),
        F.when(merged, 1).when(F.col("n_partitions") <= 1, F.col("target")).otherwise(F.col("quota")).alias("k"),
    )
    groups = cut_lineage(groups)  # a handful of rows per document
    grouped = parted.join(groups.drop("k"), ["document_id", "partition"]).drop("partition")
    inner = groups.select("document_id", "group", F.col("k").alias("target")).distinct()
    fitted = cluster_embeddings(grouped, inner, ["document_id", "group"]).withColumnRenamed("cluster_no", "label")
    leads = groups.select("document_id", "group", "lead").distinct()
    ordered = fitted.join(leads, ["document_id", "group"])
    return number_clusters(ordered, ["document_id"], ["group", "label"], "lead").select(
        "document_id", "id", "ord", "cluster_no"
    )


# --- coarse index lists ------------------------------------------------------------------------------


def build_ivf(nodes: DataFrame, lists: int = V.IVF_LISTS, seed: int = SEED):
    """Assign every node to one of ``lists`` cosine centroids.

    Returns (nodes with ``list_id``, centroid matrix).  Write the nodes with
    ``partitionBy("list_id")`` and a probe reads only the lists it needs.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors_of = nodes.withColumn("__v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(
        k=lists, distanceMeasure="cosine", seed=seed, featuresCol="__v", predictionCol="list_id", maxIter=10
    ).fit(vectors_of)
    listed = model.transform(vectors_of).drop("__v")
    return listed, np.asarray(model.clusterCenters(), dtype=np.float64)


def nearest_lists(questions: DataFrame, centroids: np.ndarray, sizes: Sequence[int], nprobe: int, share: float = 0.0) -> DataFrame:
    """Every question once per list to probe (``list_id``), by cosine of the centroid.

    The ``nprobe`` nearest lists, and further ones until the lists together hold ``share`` of all rows: lists differ
    in size, and a few short ones would miss more than their number tells. Centroids and sizes are one small matrix.
    """
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    held, wanted = np.asarray(sizes, dtype=np.float64), share * float(sum(sizes))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        order = np.argsort(-(np.stack(vectors.to_numpy()) @ unit.T), axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        needed = np.maximum(nprobe, (before < wanted).sum(axis=1))
        return pd.Series([o[:n].astype(np.int32) for o, n in zip(order, needed)])

    return questions.withColumn("list_id", F.explode(nearest("question_embedding")))


def ivf_probe(questions: DataFrame, listed: DataFrame, centroids: np.ndarray, nprobe: int, k: int = 10) -> DataFrame:
    """Approximate owner-scoped top k: only nodes of each question's nearest lists are scored.

    ``centroids`` is one small matrix, one row per list, and travels with the task.
    """
    from arbora.operators.retrieval import best_matches, describe_matches

    probes = nearest_lists(questions, centroids, [0] * len(centroids), nprobe)
    found = best_matches(probes, listed, ("owner_id", "list_id"), k, False)
    return describe_matches(found, questions, listed, ("owner_id",))


def probe_stored(questions: DataFrame, path: str, nprobe: int, share: float = 0.0, k: int = 10) -> DataFrame:
    """``ivf_probe`` on lists that ``vector_lists.write_lists`` stored: folders of other lists are not read."""
    from arbora.operators.retrieval import best_matches, describe_matches
    from arbora.sources.vector_lists import probed_rows, read_lists

    rows, lists = read_lists(questions.sparkSession, path)
    kept = lists.orderBy("list_id").collect()  # one row per list
    centroids = np.array([r["centroid"] for r in kept], dtype=np.float64)
    probes = cut_lineage(nearest_lists(questions, centroids, [r["size"] for r in kept], nprobe, share))
    near = probed_rows(rows, probes)
    found = best_matches(probes, near, ("owner_id", "list_id"), k, False)
    return describe_matches(found, questions, near, ("owner_id",))
