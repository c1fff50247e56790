import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import mixing, packing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return target
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: per * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            fixed.add(s)


def test_mixing(documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    sizes = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] += r.size
    want = level(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert int(r.rate) <= r.copies <= int(r.rate) + 1 and r.copies <= 2
    key = lambda r: (str(r.doc_id), r.text or "", r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(documents.repartition(2)).collect()))
    assert mixing.emit(mixing.mix(documents), documents.columns).count() == sum(r.copies for r in rows)


def test_mixing_comes_near_targets(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 5).alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.05


def test_mixing_edges(empty, clashing):
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(clashing)
    assert mixed.schema["copies"].dataType.simpleString() == "int" and mixed.filter("score = 'kept'").count() == clashing.count()


def test_sharding(documents):
    for shards in (1, 5, 24):
        rows = sharding.shuffle_into_shards(documents, shards, bucket_bytes=1 << 16).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in documents.collect())
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(slots.get(s, [])) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    again = sharding.shuffle_into_shards(documents.repartition(5), 24, bucket_bytes=1 << 16).collect()
    assert sorted((str(r.doc_id), zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in rows) == sorted((str(r.doc_id), zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in again)


def test_shards_are_runs_of_buckets(documents):
    """Against a plain program: places by bucket, shards and slots by place."""
    n, shards, of_bucket = documents.count(), 4, {}
    total = sum(len((r.text or "").encode()) + 8 * len(documents.columns) for r in documents.collect())
    buckets = -(-total // (1 << 14))
    for r in sharding.scatter(documents, buckets, 7).collect():
        assert r.bucket == r.record.place % buckets
        of_bucket[r.record.row.doc_id, r.record.row.text] = r.bucket
    held = Counter(of_bucket[r.doc_id, r.text] for r in documents.collect())
    starts = {b: sum(held[x] for x in held if x < b) for b in held}
    for r in sharding.shuffle_into_shards(documents, shards, bucket_bytes=1 << 14).collect():
        place, b = -(-r.shard * n // shards) + r.slot, of_bucket[r.doc_id, r.text]
        assert place * shards // n == r.shard and starts[b] <= place < starts[b] + held[b]


def test_copies_of_a_record_spread(spark):
    from pyspark.sql import functions as F

    names = ["place", "row", "record", "bucket", "start", "i", "held", "copies", "number", "c0", "_place", "of"]
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("text").alias("text"), *(F.lit("kept").alias(c) for c in names))
    sizes = {r.bucket: r["count"] for r in sharding.scatter(rows, 50, 7, hot_copies=100).groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 30_000 and max(sizes.values()) < 900
    sharded = sharding.shuffle_into_shards(rows, 6, bucket_bytes=1 << 17)
    assert sharded.columns == [*rows.columns, "shard", "slot"]
    assert sharded.filter("doc_id IS NULL").count() == 10_000 and sharded.filter("start = 'kept' AND c0 = 'kept'").count() == 30_000
    assert sharded.select("shard", "slot").distinct().count() == 30_000
    assert all(abs(r["count"] - 10_000 / 6) < 250 for r in sharded.filter("doc_id IS NULL").groupBy("shard").count().collect())


def test_sharding_edges(empty, clashing, documents, tmp_path):
    assert sharding.shuffle_into_shards(empty, 4).count() == 0
    assert sharding.shuffle_into_shards(clashing, 4).filter("score = 'kept' AND slot >= 0").count() == clashing.count()
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shuffle_into_shards(documents, 3), path)
    assert documents.sparkSession.read.parquet(path).count() == documents.count()


def test_sharding_is_native(documents):
    plan = sharding.shuffle_into_shards(documents, 3)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.data())
def test_best_fit(row, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, row), min_size=1, max_size=60)))
    where, start = packing.best_fit(lengths, row)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fit = [r for r in rooms if r >= lengths[i]]
        rooms.append((rooms.pop(rooms.index(min(fit))) if fit else row) - lengths[i])
    assert sorted(rooms) == sorted((row - np.bincount(where, weights=lengths)).astype(int).tolist())
    for r in range(where.max() + 1):
        mine = np.flatnonzero(where == r)
        mine = mine[np.argsort(start[mine])]
        assert (start[mine] == np.r_[0, np.cumsum(lengths[mine])[:-1]]).all()


def test_packing_is_lossless(documents, empty, clashing):
    from pyspark.sql import functions as F

    data = lambda d: d.select("doc_id", F.encode("text", "UTF-8").alias("data"))
    found = Counter()
    parts = {}
    for r in packing.pack(data(documents), "data", 256, 257, width=1, row=512, pool_tokens=1 << 16).collect():
        ids, positions = (np.frombuffer(x, packing.STORED) for x in (r.ids, r.positions))
        assert len(ids) == 512 and r.cumulative[-1] == r.n_tokens and (ids[r.n_tokens :] == 257).all()
        for doc, part, of, a, b in zip(r.doc_ids, r.parts, r.of_parts, r.cumulative, r.cumulative[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            parts.setdefault((doc, of), {}).setdefault(part, []).append(ids[a:b])
    for (doc, of), mine in parts.items():
        copies = {len(v) for v in mine.values()}
        assert set(mine) == set(range(of)) and len(copies) == 1
        if doc is not None:
            whole = np.concatenate([mine[i][0] for i in range(of)])
            assert whole[-1] == 256
            found[doc, bytes(whole[:-1].astype(np.uint8))] += copies.pop()
    want = Counter((r.doc_id, (r.text or "").encode()) for r in documents.collect() if r.doc_id is not None)
    assert found == want
    assert packing.pack(data(empty), "data", 256, 257, width=1).count() == 0
    assert packing.pack(data(clashing), "data", 256, 257, width=1).count() > 0


def test_stored_sizes_pack_alike(documents):
    from pyspark.sql import functions as F

    data = documents.select("doc_id", F.encode("text", "UTF-8").alias("data"), F.octet_length("text").alias("bytes"))
    rows = [sorted(packing.pack(data, "data", 256, 257, width=1, row=512, pool_tokens=1 << 16, **given).collect(), key=str) for given in ({}, {"size": "bytes"})]
    assert rows[0] == rows[1]
