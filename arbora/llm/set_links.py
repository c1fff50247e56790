"""Links between similar sets of a group, enough to connect all that are connected, without meeting all pairs.

Sets x and y of sizes n and m link when ``100 * common >= percent * union``. Against any base set B, x is told by its
difference D(x) from B, and with ``weight(x) = (100 + percent) * |D(x)| - (100 - percent) * n`` the rule reads

    weight(x) + weight(y) <= 2 * (100 + percent) * |D(x) & D(y)|.

A set may be told by part of itself, as long as the size n is whole and the number of untold elements, ``extra``, is known
and no other set has these: they are part of the difference. And since differences of two sets from one base differ
where the sets do, a difference can stand for its set.

So pairs whose differences share nothing link exactly when their weights add up to 0 at most, and then both link with
the set of least weight: one link each stands for all of them. Every other link shares a token of both differences. As
base serve the tokens of more than half of the sets: then no token is in more than half of the differences, whatever
the sets are.

A group of up to ``MOST_SETS`` sets and ``MOST_TOKENS`` tokens, a bound of a task's memory, is linked in one task that
counts common tokens of differences. A larger one gets its base, differences and star by joins and sums; its sets
then meet in smaller groups, one per token of a prefix of their difference that every link must share, and those are
treated alike. Each round halves the groups at least. Nothing is sampled or dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut

MOST_SETS, MOST_TOKENS = 2_048, 1 << 21
#: Pairs of equal tokens that a task lays out at once.
AT_ONCE = 1 << 21
#: ``id`` names a set of ``n`` elements; ``tokens`` are 64-bit hashes of all but ``extra`` of them, sorted and distinct, in bytes.
MEMBERS = "group long, id long, n long, extra long, tokens binary"


def weight(difference, size, percent: int):
    return (100 + percent) * difference - (100 - percent) * size


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


def differences(tokens: np.ndarray, of: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets that have ``tokens`` (numbers from 0): the tokens, and their sets, by which each differs from the base."""
    often = np.bincount(tokens)
    base = np.flatnonzero(2 * often > sets)
    inside = np.full(len(often), -1)
    inside[base] = np.arange(len(base))
    extra = inside[tokens] < 0
    has = np.zeros((sets, len(base)), bool)
    has[of[~extra], inside[tokens[~extra]]] = True
    lacking, missing = np.nonzero(~has)
    return np.concatenate([tokens[extra], base[missing]]), np.concatenate([of[extra], lacking])


def groups_of(sets: list[np.ndarray], size: np.ndarray, extra: np.ndarray, percent: int) -> np.ndarray:
    """For each of the sets the smallest number of a set that links lead to."""
    n = len(sets)
    if n == 2:
        differ = extra.sum() + len(np.setxor1d(*sets, assume_unique=True))
        return np.array([0, 0 if weight(differ, size.sum(), percent) <= 0 else 1])
    token, of = differences(np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(n), [len(s) for s in sets]), n)
    heavy = weight(np.bincount(of, minlength=n) + extra, size, percent)
    centre = int(heavy.argmin())
    star = heavy + heavy[centre] <= 0
    label = np.arange(n)
    if star.sum() > 1:
        label[star] = np.flatnonzero(star)[0]
    # all others against all sets, by the tokens they share
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    start = np.searchsorted(token, np.arange(token[-1] + 2 if len(token) else 1))
    asking = np.flatnonzero(~star[of])
    asking = asking[np.argsort(of[asking], kind="stable")]
    spread = np.diff(start)[token[asking]]
    total = np.cumsum(spread)
    us, vs, at = [], [], 0
    while at < len(asking):
        # whole sets, as many as fit
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right"))
        end = int(np.searchsorted(of[asking], of[asking[min(end, len(asking) - 1)]])) if end < len(asking) else end
        if end <= at:
            end = int(np.searchsorted(of[asking], of[asking[at]], side="right"))
        some = asking[at:end]
        run = spread[at:end]
        place = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run) + np.repeat(start[token[some]], run)
        pair, common = np.unique(np.repeat(of[some], run) * n + of[place], return_counts=True)
        u, v = pair // n, pair % n
        linked = (u != v) & (heavy[u] + heavy[v] <= 2 * (100 + percent) * common)
        us.append(u[linked])
        vs.append(v[linked])
        at = end
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    while True:  # smaller numbers spread along links and along what is known of labels
        before = label.copy()
        np.minimum.at(label, label[u], label[v])
        np.minimum.at(label, label[v], label[u])
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _linked(percent: int):
    """Links of the sets of each group; rows come in order of their groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                names, size, extra = (np.array(c, np.int64) for c in list(zip(*rows))[:3])
                label = groups_of([np.frombuffer(r[3], np.uint64) for r in rows], size, extra, percent)
                moved = np.flatnonzero(label != np.arange(len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["u", "v"])

        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now:
                    yield from links()
                    now, rows = group, []
                rows.append(row)
        yield from links()

    return run


SPLIT = f"{MEMBERS}, weight long, base long"


def _split(percent: int):
    """Sets as differences from their group's base, with weight and size of the base."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, name, n, extra, tokens, base in zip(*(c.to_pylist() for c in batch.columns)):
                known = np.sort(np.array(base or [], np.int64).view(np.uint64))
                differ = np.setxor1d(np.frombuffer(tokens, np.uint64), known, assume_unique=True)
                rows.append((group, name, n, extra, differ.tobytes(), weight(len(differ) + extra, n, percent), len(known)))
            yield batch_of(rows, SPLIT)

    return run


def prefix(differ: np.ndarray, mine: int, least: int, percent: int) -> np.ndarray:
    """Tokens of a difference of which any link that shares a token shares one; smallest hashes first."""
    common = max(1, -(-(mine + least) // (2 * (100 + percent))))
    return differ[: max(0, len(differ) - common + 1)]


def _dealt(percent: int):
    """Tokens under which a set meets others. ``plain``: the group's sets are told by themselves, not by differences yet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, name, n, tokens, mine, base, least, plain in zip(*(c.to_pylist() for c in batch.columns)):
                if plain:  # the smallest partner has this size, and its difference what the base can't cover
                    smallest = -(-percent * n // 100)
                    least = max(least, weight(max(0, smallest - base), smallest, percent))
                rows.append((group, name, prefix(np.frombuffer(tokens, np.uint64), mine, least, percent).view(np.int64)))
            yield batch_of(rows, "group long, id long, prefix array<long>")

    return run


def _flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the sets with the number of the sets in this task that have them, a few sets at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(t, np.uint64) for t in part.column(1).to_pylist()]
            if sets:
                group = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                pairs, n = np.unique(np.stack([group, np.concatenate(sets).view(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], ["group", "token", "n"])


def links_within(members: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v``: links of sets that share a group (``MEMBERS``); the sets they connect are those that links connect.

    A set comes once in a group; it may be in several groups.
    """
    found, plain = None, True
    columns = ["group", "id", "n", "extra", "tokens"]
    members = cut(members.select(*columns))
    while True:
        sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("of"), F.sum(F.octet_length("tokens") / 8).alias("words"))
        large = cut(sizes.filter((F.col("of") > MOST_SETS) | (F.col("words") > MOST_TOKENS) & (F.col("of") > 2)).select("group", "of"))
        some = not large.isEmpty()
        small = members.join(large, "group", "left_anti") if some else members
        together = small.repartition("group").sortWithinPartitions("group", "id")
        links = together.mapInArrow(_linked(percent), "u long, v long")
        found = links if found is None else found.union(links)
        if not some:
            return found
        rest = cut(members.join(large.select("group"), "group", "left_semi"))
        often = rest.select("group", "tokens").mapInArrow(_flat, "group long, token long, n long").groupBy("group", "token").agg(F.sum("n").alias("n"))
        # at most two of the base's tokens for each token of an average set
        base = often.join(large, "group").filter("2 * n > of").groupBy("group").agg(F.collect_list("token").alias("base"))
        split = cut(rest.join(base, "group", "left").select(*columns, "base").mapInArrow(_split(percent), SPLIT))
        centres = split.groupBy("group").agg(F.min(F.struct("weight", "id")).alias("centre"))
        centred = split.join(centres.select("group", F.col("centre.weight").alias("least"), F.col("centre.id").alias("centre")), "group")
        found = found.union(centred.filter("weight + least <= 0 AND id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")))
        dealt = centred.select("group", "id", "n", "tokens", "weight", "base", "least", F.lit(int(plain)).cast("long").alias("plain"))
        postings = cut(dealt.mapInArrow(_dealt(percent), "group long, id long, prefix array<long>").select("group", "id", F.explode("prefix").alias("token")))
        shared = postings.groupBy("group", "token").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("group", "token")
        met = postings.join(shared, ["group", "token"]).join(split.select(*columns), ["group", "id"])
        members = cut(met.select(F.xxhash64("group", "token").alias("group"), "id", "n", "extra", "tokens"))
        plain = False
