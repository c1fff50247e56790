"""Random inputs against plain models of the rules, with scans cut into tiny segments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import chunking, clustering, providers, retrieval, trees
from arbora.sources import nodes as N

RNG = random.Random(7)


def model_windows(pages, target, overlap):
    """pages: [(page, [words])] -> [(words, first page, last page)] by filling one buffer."""
    out, buffer = [], []
    for page, words in pages:
        for word in words:
            buffer.append((word, page))
            if len(buffer) == target:
                out.append(list(buffer))
                buffer = buffer[-overlap:] if overlap else []
    if buffer:
        out.append(list(buffer))
    return [(" ".join(w for w, _ in c), min(p for _, p in c), max(p for _, p in c)) for c in out]


@pytest.mark.parametrize("target,overlap", [(5, 2), (4, 0), (7, 6), (1, 0)])
def test_windows(spark, small_segments, target, overlap):
    docs = {f"d{i}": [(p, [f"w{p}.{k}" for k in range(RNG.randint(0, 9))]) for p in range(1, RNG.randint(2, 7))] for i in range(12)}
    docs["exact"] = [(1, [f"w{k}" for k in range(target)])]
    rows = [(d, p, " ".join(ws)) for d, pages in docs.items() for p, ws in pages]
    df = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    got = {}
    for r in chunking.transactional_chunks(df, target, overlap).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append((r["content"], r["page_start"], r["page_end"]))
    want = {d: w for d, pages in docs.items() if (w := model_windows(pages, target, overlap))}
    assert got == want


def test_overlap_is_checked(spark):
    df = spark.createDataFrame([("d", 1, "a")], "document_id string, page_number int, text string")
    with pytest.raises(ValueError):
        chunking.transactional_chunks(df, 5, 5)


def model_parties(rows):
    state, out = None, []
    for leaders in rows:
        if not leaders:
            state = "NEUTRAL"
        elif len(leaders) == 1:
            state = leaders[0]
        elif state not in leaders:
            state = "NEUTRAL"
        out.append(state)
    return out


def test_carried_parties_and_enclaves(spark, small_segments):
    names = ["CLAIMANT", "RESPONDENT", "TRIBUNAL"]
    docs = {f"d{i}": [RNG.sample(names, RNG.choice([0, 1, 2, 2, 3, 3])) for _ in range(RNG.randint(1, 25))] for i in range(25)}
    rows = [(d, n // 3 + 1, n, ls) for d, lists in docs.items() for n, ls in enumerate(lists)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, block_no int, leaders array<string>")
    carried = chunking.party_enclaves(chunking.carry_party(df)).orderBy("document_id", "block_no").collect()
    for d, lists in docs.items():
        mine = [r for r in carried if r["document_id"] == d]
        want = model_parties(lists)
        assert [r["party"] for r in mine] == want
        runs = [0]
        for a, b in zip(want, want[1:]):
            runs.append(runs[-1] + (a != b))
        assert [r["enclave_index"] for r in mine] == runs


def test_heading_stack(spark, small_segments):
    docs = {f"d{i}": [RNG.randint(1, 5) for _ in range(RNG.randint(1, 15))] for i in range(25)}
    docs["fixed"] = [3, 2, 1, 4]
    rows = [(d, n + 1, level, None if n % 2 else f"k{n}", f"t{n}") for d, levels in docs.items() for n, level in enumerate(levels)]
    df = spark.createDataFrame(rows, "document_id string, section_no int, heading_level int, heading_slug string, text string")
    got = chunking.heading_stack(chunking.synthetic_heading_keys(df)).orderBy("document_id", "section_no").collect()
    for d, levels in docs.items():
        stack, unmarked, want = [], {}, []
        for n, level in enumerate(levels):
            if n % 2:
                unmarked[level] = unmarked.get(level, 0) + 1
                key = f"level-{level}-{unmarked[level]}"
            else:
                key = f"k{n}"
            stack = stack[: level - 1] + [(key, f"t{n}", level)]
            want.append(list(stack))
        mine = [[tuple(h) for h in r["section_hierarchy"]] for r in got if r["document_id"] == d]
        assert mine == want


def test_long_section_splits(spark, small_segments):
    lines = [("d", 1, 0, "Section 1 Scope")] + [("d", n // 4 + 1, n, " ".join(f"w{n}.{k}" for k in range(50))) for n in range(1, 24)]
    df = spark.createDataFrame(lines, "document_id string, page_number int, block_no int, text string")
    chunks = chunking.hierarchical_chunks(df).orderBy("chunk_index").collect()
    words = " ".join(c["content"] for c in chunks).split()
    assert [len(c["content"].split()) for c in chunks] == [500, 500, 153]
    assert words == " ".join(t for *_, t in lines).split()
    assert [c["section_fragment"] for c in chunks] == [0, 1, 2]


def model_quotas(sizes, target):
    quota = {k: 1 for k in sizes}
    left = max(0, target - len(sizes))
    order = sorted((k for k in sizes if sizes[k] > 1), key=lambda k: -sizes[k])
    while left:
        before = left
        for k in order:
            if left and quota[k] < max(1, sizes[k] - 1):
                quota[k] += 1
                left -= 1
        if left == before:
            break
    return quota


def test_quotas(spark):
    docs = {f"d{i}": ({f"p{k}": RNG.randint(1, 9) for k in range(RNG.randint(1, 5))}, RNG.randint(1, 25)) for i in range(60)}
    rows = [(d, k, n, i) for d, (sizes, _) in docs.items() for i, (k, n) in enumerate(sizes.items())]
    parts = spark.createDataFrame(rows, "document_id string, partition string, size long, first_ord long")
    targets = spark.createDataFrame([(d, t) for d, (_, t) in docs.items()], "document_id string, target int")
    got = {(r["document_id"], r["partition"]): r["quota"] for r in clustering.allocate_cluster_counts(parts, targets).collect()}
    for d, (sizes, target) in docs.items():
        assert {k: got[d, k] for k in sizes} == model_quotas(sizes, target)


def vectors(spark, sizes, width=6):
    rng = np.random.default_rng(3)
    rows = [(d, f"{d}-{i}", i, [float(x) for x in rng.normal(size=width)], f"P{i % 3}") for d, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "document_id string, id string, ord long, embedding array<float>, layout_partition string")


@pytest.mark.parametrize("limit", [4096, 5])
def test_clusters_cover_and_keep_the_target(spark, small_segments, limit):
    sizes = {"one": 1, "two": 2, "three": 3, "many": 23}
    for target in (1, 2, 4, 30):
        df = vectors(spark, sizes)
        targets = spark.createDataFrame([(d, target) for d in sizes], "document_id string, target int")
        first = clustering.cluster_embeddings(df, targets, block_rows=limit).collect()
        again = clustering.cluster_embeddings(df.repartition(3), targets, block_rows=limit).collect()
        assert sorted(first) == sorted(again)
        for d, n in sizes.items():
            mine = sorted((r["ord"], r["cluster_no"]) for r in first if r["document_id"] == d)
            assert len(mine) == n == len({o for o, _ in mine})
            numbers = [k for _, k in mine]
            assert set(numbers) == set(range(max(numbers) + 1)) and len(set(numbers)) <= max(1, target)
            assert [k for i, k in enumerate(numbers) if k not in numbers[:i]] == sorted(set(numbers))
            if target >= n or n <= 2:
                assert set(numbers) == {0}


def test_fits_do_not_depend_on_blocks(spark):
    df = vectors(spark, {"a": 60, "b": 41})
    targets = spark.createDataFrame([("a", 4), ("b", 3)], "document_id string, target int")

    def fit(rows):
        return sorted((r["id"], r["cluster_no"]) for r in clustering.cluster_embeddings(df, targets, block_rows=rows).collect())

    assert fit(4096) == fit(7) and len({n for _, n in fit(7)}) > 2
    late = clustering.cluster_embeddings(df, targets, rounds=1, report=True).collect()
    assert not any(r["converged"] for r in late)
    assert all(r["converged"] for r in clustering.cluster_embeddings(df, targets, report=True).collect())


def test_long_chains_and_rings_merge(spark):
    from arbora.operators import planning

    n = 300  # a chain that ends in a ring of three, and one cluster apart
    rows = [("d", i, i < n) for i in range(n + 1)]
    diagnostics = spark.createDataFrame(rows, "document_id string, cluster_no int, is_tiny boolean")
    targets = spark.createDataFrame([("d", i, i + 1 if i + 1 < n else n - 3) for i in range(n)], "document_id string, cluster_no int, merge_target int")
    merged = {r["cluster_no"]: r["merged_no"] for r in planning.merge_components(diagnostics, targets).collect()}
    assert {merged[i] for i in range(n)} == {0} and merged[n] == 1


def test_deep_trees_are_walked_to_the_end(spark):
    from arbora.operators import chunking, trees

    deep = 20
    nodes = spark.createDataFrame([("d", f"n{i}", "leaf" if i == deep else "summary") for i in range(deep + 1)], "document_id string, id string, node_type string")
    edges = spark.createDataFrame([("d", f"n{i}", f"n{i + 1}", 0) for i in range(deep)], "document_id string, parent_id string, child_id string, member_no int")
    starts = nodes.where("id = 'n0'")
    assert trees.descendants(edges, starts).count() == deep + 1
    assert {r["source_count"] for r in trees.leaf_source_counts(nodes, edges).collect()} == {1}
    assert max(r["height"] for r in trees.node_heights(nodes, edges).collect()) == deep
    ring = edges.union(spark.createDataFrame([("d", f"n{deep}", "n0", 0)], edges.schema))
    with pytest.raises(ValueError):
        trees.descendants(ring, starts)
    headings = spark.createDataFrame([("d", i, i, f"k{i}", f"t{i}") for i in range(1, deep + 1)], "document_id string, section_no int, heading_level int, section_key string, text string")
    tall = {r["section_no"]: r["section_hierarchy"] for r in chunking.heading_stack(headings).collect()}
    assert [h["key"] for h in tall[deep]] == [f"k{i}" for i in range(1, deep + 1)]


def test_matches_in_blocks_equal_the_join(spark, monkeypatch):
    nodes = vectors(spark, {"d": 40, "e": 7}).withColumn("owner_id", F.lit("o")).withColumn(
        "node_type", F.when(F.col("ord") % 4 == 0, "summary").otherwise("leaf")
    )
    questions = nodes.select(F.col("id").alias("question_id"), "owner_id", "document_id", F.col("embedding").alias("question_embedding"))
    for scope in (("owner_id",), ("owner_id", "document_id")):
        def answer():
            return sorted((r["question_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in retrieval.match_nodes_batch(questions, nodes, 5, scope).collect())

        def context():
            return sorted((r["question_id"], r["node_type"], r["rank"], r["id"]) for r in retrieval.retrieve_context(questions, nodes, 2, 3, scope).collect())

        joined, joined_context = answer(), context()
        with monkeypatch.context() as patch:
            patch.setattr(retrieval, "QUESTION_BLOCK", 9)
            patch.setattr(retrieval, "NODE_BLOCK", 8)
            assert answer() == joined
            assert context() == joined_context


def test_token_batches():
    texts = [(i, "w " * RNG.randint(0, 3000)) for i in range(200)]
    batches = list(providers.token_batches(texts))
    assert [k for b in batches for k, _ in b] == [k for k, _ in texts]

    def tokens(t):
        return max(1, int(np.ceil(len(t.split()) * 1.33)))

    for batch, following in zip(batches, batches[1:]):
        used = sum(tokens(t) for _, t in batch)
        assert len(batch) == 1 or (len(batch) <= 15 and used <= 7000)
        assert len(batch) == 15 or used + tokens(following[0][1]) > 7000


def test_provider_rows():
    def picky(texts):
        if len(texts) > 2 or "e" in texts:
            raise RuntimeError("too many requests")
        return [t.upper() for t in texts]

    rows = list(providers.provider_rows(picky, list(enumerate("abcdefg")), attempts=3))
    assert [r[:2] for r in rows] == [(i, None if t == "e" else t.upper()) for i, t in enumerate("abcdefg")]
    assert [k for k, _, error in rows if error] == [4]
    assert list(providers.provider_rows(picky, [])) == []
    assert [v for _, v, _ in providers.provider_rows(lambda t: t[:-1], [(1, "a"), (2, "b")], attempts=2)] == [None, None]


def test_provider_texts_and_summaries(spark):
    df = spark.createDataFrame([(0, 0, "One text. More."), (0, 1, "refuse this"), (1, 0, "Another text.")], "g int, ord int, content string")

    def call(texts):
        if any("refuse" in t for t in texts):
            raise RuntimeError("no")
        return [f"about {t}" for t in texts]

    rows = {r.content: (r.told, r.told_error) for r in providers.provider_texts(df, call, "content", "told").collect()}
    assert rows["Another text."] == ("about Another text.", None) and rows["refuse this"] == (None, "RuntimeError: no")
    made = {r.g: r.summary for r in providers.provider_summaries(call)(df, ["g"]).collect()}
    assert made[1] == "about Another text." and "One text." in made[0]


def leaf_rows(spark, sizes, words=60):
    data = []
    for d, n in sizes.items():
        for i in range(n):
            body = " ".join(f"Sentence {i} {k} about topic{i % 3}." for k in range(words // 4))
            data.append((f"{d}-{i}", d, "o", "leaf", 0, body, [float(i % 3 == k) + 0.01 * i for k in range(4)], i // 3 + 1, i // 3 + 1, i, "TRANSACTIONAL", f"P{i % 2}"))
    return spark.createDataFrame(
        data,
        "id string, document_id string, owner_id string, node_type string, level int, content string, embedding array<float>,"
        " page_start int, page_end int, chunk_index int, layout_strategy string, layout_partition string",
    )


def test_clustered_tree_shape(spark, small_segments):
    sizes = {"flat": 3, "four": 4, "deep": 21}
    tree = trees.build_summary_tree_levels(leaf_rows(spark, sizes)).collect()
    by_id = {(r["document_id"], r["id"]): r for r in tree}
    assert len(by_id) == len(tree)
    for d, n in sizes.items():
        mine = [r for r in tree if r["document_id"] == d]
        assert sum(r["node_type"] == "leaf" for r in mine) == n
        roots = [r for r in mine if r["node_type"] == "summary" and r["parent_id"] is None]
        if d == "flat":
            assert len(mine) == 3
        else:
            assert len(roots) == 1
            assert all(r["parent_id"] for r in mine if r is not roots[0])
        for r in mine:
            if r["parent_id"]:
                parent = by_id[d, r["parent_id"]]
                assert parent["level"] > r["level"]
                assert parent["page_start"] <= r["page_start"] and parent["page_end"] >= r["page_end"]
        for r in mine:
            assert r["embedding"] is not None and r["layout_strategy"] == "TRANSACTIONAL"


def test_short_content_carries_over(spark):
    """Clusters below the summary minimum pass their members on; nothing is lost."""
    tree = trees.build_summary_tree_levels(leaf_rows(spark, {"d": 9}, words=4)).collect()
    assert sum(r["node_type"] == "leaf" for r in tree) == 9


def model_structure(paths):
    """Parents by path for one document: (level, group no, members) per summary."""
    current, made, level = [list(p) for p in paths], [], 1
    while len(current) > 1 and level <= 12:
        groups, carried = {}, []
        for p in current:
            shared = current.count(p) > 1
            key = tuple(p) if shared else tuple(p[:-1])
            if shared or key:
                groups.setdefault(key, []).append(p)
            else:
                carried.append(p)
        if not groups:
            groups, carried = {("document-root",): current}, []
        following = []
        for n, (key, group) in enumerate(groups.items()):
            made.append((level, n, len(group)))
            if not key:
                following.append([])
            elif key[-1] in group[0]:
                following.append(group[0][: group[0].index(key[-1]) + 1])
            else:
                following.append(list(group[0]))
        current = following + carried
        level += 1
    return made


def test_structural_tree(spark, small_segments):
    docs = {}
    for i in range(8):
        tops = [f"s{k}" for k in range(RNG.randint(1, 4))]
        docs[f"d{i}"] = [[t] + [f"{t}.{RNG.randint(1, 3)}"] * RNG.randint(0, 1) for t in tops for _ in range(RNG.randint(1, 3))]
    rows = [
        (f"{d}-{i}", d, "o", "leaf", 0, "A short line. Another one.", [1.0, 0.0], 1, 1, i, "HIERARCHICAL", [(k, k, n + 1) for n, k in enumerate(path)])
        for d, paths in docs.items()
        for i, path in enumerate(paths)
    ]
    leaves = spark.createDataFrame(
        rows,
        "id string, document_id string, owner_id string, node_type string, level int, content string, embedding array<float>, page_start int,"
        " page_end int, chunk_index int, layout_strategy string, section_hierarchy array<struct<key:string,title:string,depth:int>>",
    )
    tree = trees.build_structural_tree(leaves)
    sizes = tree.groupBy("document_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    got = {}
    for r in tree.where("node_type = 'summary'").join(sizes, ["document_id", "id"]).collect():
        number = int(r["cluster_id"].rsplit("-", 1)[1])
        got.setdefault(r["document_id"], []).append((r["level"], number, r["n"]))
    for d, paths in docs.items():
        assert sorted(got.get(d, [])) == sorted(model_structure(paths))


def test_encryption_round_trip(spark):
    rows = [(f"n{i}", "d", t) for i, t in enumerate(["plain", "", "ünï\ncode", "x" * 5000])]
    nodes = spark.createDataFrame(rows, "id string, document_id string, content string")
    keys = spark.createDataFrame([("d", bytearray(range(32)))], "document_id string, key binary")
    sealed = N.protect_nodes(nodes, keys, "r")
    assert sealed.where("content IS NOT NULL").count() == 0
    assert len({r["content_iv"] for r in sealed.collect()}) == 4
    back = {r["id"]: r["content"] for r in N.decrypt_nodes(sealed, keys).collect()}
    assert back == {i: t for i, _, t in rows}
    other = spark.createDataFrame([("d", bytearray(32))], "document_id string, key binary")
    assert all(r["content"] is None for r in N.decrypt_nodes(sealed, other).collect())
