"""N-gram Jaccard self-join by token-combination prefixes, and its connected groups.

A document's tokens are hashes of its distinct word n-grams; two documents link when ``100 * intersection >= 75 *
union``. Equal sets are one class from the start. The steps, each exact:

1. A similar pair shares tokens among the smallest hashes of both sets. These prefixes are counted over all documents
   (tasks send packed arrays, one entry per distinct set), and a set goes on only if enough of its prefix is shared.
2. Frequencies of all tokens of the sets that go on are counted the same way. A token of one set only can't be in an
   intersection; a set whose shared tokens are fewer than 75 % has no partner.
3. Shared tokens are ordered from rare to frequent. Rare ones are indexed by themselves. Frequent ones are dealt to
   classes, and combinations of two of a class are indexed; the prefix is extended until a pair that misses the overlap
   by as much as allowed still shares a rare token or two of a class. Sizes decide the number of classes, in bands.
4. Every set is verified against the smallest and the most typical set it shares an entry with; contraction leaves
   few groups per entry. Sets of entries with several groups are joined to groups of candidates, and all links that are
   still missing to connect them are found there by their differences from a common base (``set_links``).

Frequent entries never pair their sets with each other inside a group, and no step drops candidates.
Defined cases: null and empty texts and texts without words have no tokens and link with nothing; texts of fewer words
than n are one token; documents without id link with nothing and have a null component; rows that repeat an id are
told apart by their sets; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import Words, by_bytes, cut
from arbora.llm.components import components
from arbora.llm.set_links import links_within

N, PERCENT = 5, 75
#: Tokens in more sets than this are indexed in combinations.
RARE = 32
ROWS_AT_ONCE = 256
#: Text of so many bytes is read at once; a longer text is read by itself.
BYTES_AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sorted distinct hashes of the word n-grams of each of many texts."""

    def __init__(self, n: int = N):
        self.n, self.words = n, Words(lower=True)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        word, of, _ = self.words([t or "" for t in texts])
        ends = np.searchsorted(of, np.arange(len(texts) + 1))
        grams = self.grams(word, self.n)
        found = []
        for start, end in zip(ends.tolist(), ends[1:].tolist()):
            size = min(self.n, end - start)
            found.append(np.unique(grams[start : end - size + 1] if size == self.n else self.grams(word[start:end], size)))
        return found

    @staticmethod
    def grams(word: np.ndarray, size: int) -> np.ndarray:
        """Hash of the run of ``size`` words from each place on."""
        if not size or len(word) < size:
            return word[:0]
        h = np.full(len(word) - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                h = (h ^ word[j : len(word) - size + 1 + j]) * _MIX
                h ^= h >> np.uint64(29)
        return h


def overlap(n: np.ndarray | int):
    """Tokens of a set of size n that any similar set shares at least."""
    return -(-PERCENT * n // 100)


def errors(n):
    return n - overlap(n)


def share(n):
    """Shared tokens asked of the counted prefix: a third of the plain prefix, at the size of the smallest partner."""
    return -(-(errors(overlap(n)) + 1) // 3)


def prefix_length(n: int) -> int:
    return errors(n) + -(-(errors(n) + 1) // 3)


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def _slices(batches: Iterable[pa.RecordBatch], size: int = ROWS_AT_ONCE) -> Iterator[list[list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield [c.to_pylist() for c in batch.slice(at, size).columns]


SETS = "doc long, version long, n int, a long, b long, part int, tokens binary, owners binary, of binary"


def describe(documents: DataFrame, parts: int) -> DataFrame:
    """Rows of two kinds: each text's set size and fingerprint; packed prefix tokens by part (``doc`` null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for part in by_bytes(batches, BYTES_AT_ONCE):
            ids, versions, texts = (c.to_pylist() for c in part.columns)
            rows, prefixes, seen = [], [], {}
            for doc, version, tokens in zip(ids, versions, shingles(texts)):
                mark = xxhash.xxh3_128_intdigest(tokens.tobytes())
                a, b = (int(np.uint64(x).astype(np.int64)) for x in (mark >> 64, mark & (1 << 64) - 1))
                rows.append((doc, version, len(tokens), a, b, -1, None, None, None))
                if len(tokens) > 2 and doc is not None and a not in seen:  # smaller sets are similar to equal ones only
                    seen[a] = len(prefixes)
                    prefixes.append(tokens[: prefix_length(len(tokens))])
            if prefixes:
                tokens = np.concatenate(prefixes)
                of = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
                owners = np.fromiter(seen, np.int64)
                part = (tokens % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in range(parts):
                    i = order[edges[p] : edges[p + 1]]
                    if len(i):
                        mine, local = np.unique(of[i], return_inverse=True)
                        rows.append((None, None, None, None, None, p, tokens[i].tobytes(), owners[mine].tobytes(), local.astype(np.uint16).tobytes()))
            yield _rows(SETS, list(zip(*rows)) or [[]] * 9)

    return documents.mapInArrow(run, SETS)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


def shared_counts(packed: DataFrame, parts: int) -> DataFrame:
    """``a`` and ``shared``: how many of a set's prefix tokens are in another set's prefix too.

    A task counts the sets of its tokens and sends packed counts by set; these are added up.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sets = [], []
        for batch in batches:
            for t, o, of in zip(*(c.to_pylist() for c in batch.columns)):
                tokens.append(np.frombuffer(t, np.uint64))
                sets.append(np.frombuffer(o, np.int64)[np.frombuffer(of, np.uint16)])
        if not tokens:
            return
        token, owner = np.concatenate(tokens), np.concatenate(sets)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        token, owner = token[new], owner[new]
        _, length = _runs(token)
        found, n = np.unique(owner[np.repeat(length > 1, length)], return_counts=True)
        to = found % parts
        rows = [(int(p), found[to == p].tobytes(), n[to == p].astype(np.int64).tobytes()) for p in np.unique(to)]
        yield _rows("part int, sets binary, n binary", list(zip(*rows)) or [[]] * 3)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c for batch in batches for c in zip(*(x.to_pylist() for x in batch.columns))]
        if columns:
            sets, n = (np.concatenate([np.frombuffer(c[k], np.int64) for c in columns]) for k in (0, 1))
            found, at = np.unique(sets, return_inverse=True)
            total = np.bincount(at, weights=n).astype(np.int64)
            for k in range(0, len(found), 100_000):
                yield _rows("a long, shared long", [found[k : k + 100_000], total[k : k + 100_000]])

    dealt = packed.repartition(parts, "part").select("tokens", "owners", "of")
    counted = dealt.mapInArrow(run, "part int, sets binary, n binary")
    return counted.repartition(parts, "part").select("sets", "n").mapInArrow(add, "a long, shared long")


BATCH = "batch long, ids binary, sizes binary, tokens binary"


def batches_of(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Whole sets of the chosen classes (``doc``, ``version``, ``a``) in packed batches.

    A set is named by ``a``, half of its fingerprint, and a batch by its first set: ids may repeat with other texts.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in by_bytes(batches, BYTES_AT_ONCE):
            ids, versions, texts = (c.to_pylist() for c in part.columns)
            yield _rows("doc long, version long, packed binary", [ids, versions, [squeeze((t or "").encode("utf-8", "replace")) for t in texts]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, unpack = Shingles(), zstandard.ZstdDecompressor().decompress
        for marks, packed in _slices(batches):
            sets = shingles([unpack(data).decode() for data in packed])
            yield _rows(BATCH, [[marks[0]], [np.array(marks, np.int64).tobytes()], [np.array([len(s) for s in sets], np.int64).tobytes()], [np.concatenate(sets).tobytes()]])

    texts = documents.filter("doc IS NOT NULL").mapInArrow(pack, "doc long, version long, packed binary")
    # rows equal in id and text are one
    wanted = texts.join(chosen, ["doc", "version"]).select("doc", "version", "a", "packed").dropDuplicates(["doc", "version"])
    return wanted.select("a", "packed").mapInArrow(run, BATCH)


def frequencies(batches_: DataFrame, parts: int) -> DataFrame:
    """``batch`` and ``known``, (tokens, frequencies) of those of its tokens that are in two sets or more."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, data in _slices(batches, 8):
            rows = []
            for b, d in zip(batch, data):
                tokens, n = np.unique(np.frombuffer(d, np.uint64), return_counts=True)
                part = (tokens % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    i = order[edges[p] : edges[p + 1]]
                    rows.append((int(p), b, tokens[i].tobytes(), n[i].astype(np.int64).tobytes()))
            yield _rows("part int, batch long, tokens binary, n binary", list(zip(*rows)) or [[]] * 4)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens, counts = [], [], []
        for batch in batches:
            for b, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                names.append(b)
                tokens.append(np.frombuffer(t, np.uint64))
                counts.append(np.frombuffer(n, np.int64))
        if not names:
            return
        token = np.concatenate(tokens)
        of = np.repeat(np.arange(len(names)), [len(t) for t in tokens])
        order = np.argsort(token, kind="stable")
        starts, length = _runs(token[order])
        total = np.empty(len(token), np.int64)
        total[order] = np.repeat(np.add.reduceat(np.concatenate(counts)[order], starts), length)
        many = total > 1
        token, of, total = token[many], of[many], total[many]
        edges = np.searchsorted(of, np.arange(len(names) + 1))
        for at in range(0, len(names), 1_000):
            some = [j for j in range(at, min(at + 1_000, len(names))) if edges[j] < edges[j + 1]]
            parts_ = [slice(edges[j], edges[j + 1]) for j in some]
            yield _rows("batch long, tokens binary, n binary", [[names[j] for j in some], [token[s].tobytes() for s in parts_], [total[s].tobytes() for s in parts_]])

    dealt = batches_.mapInArrow(count, "part int, batch long, tokens binary, n binary").repartition(parts, "part").select("batch", "tokens", "n")
    added = dealt.mapInArrow(add, "batch long, tokens binary, n binary")
    return added.groupBy("batch").agg(F.collect_list(F.struct("tokens", "n")).alias("known"))


def band(n: int) -> int:
    """Sizes of similar sets are in the same band or neighbours."""
    return int(np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9))


def classes(level: int) -> int:
    """Classes of frequent tokens for sets of a level: about half of the smallest size of the band below, one at least."""
    return max(1, int((100 / PERCENT) ** (level - 1) / 2) - 3)


def entries(tokens: np.ndarray, frequency: np.ndarray, n: int) -> np.ndarray:
    """Index entries of a set of size n with these shared tokens: single rare tokens, pairs of frequent ones."""
    order = np.lexsort((tokens, frequency))
    tokens, rare = tokens[order], frequency[order] <= RARE
    need = errors(n) + 1 - (n - len(tokens))  # tokens of no other set come first in the order of frequency
    singles = tokens[rare]
    if len(singles) >= need:
        return singles[:need]
    found, frequent = [singles], tokens[~rare]
    with np.errstate(over="ignore"):
        for level in (band(n), band(n) + 1):
            groups = classes(level)
            group = ((frequent * _MIX) >> np.uint64(33)) % np.uint64(groups)
            # a class with m tokens so far still shares two when m - 1 are missed
            first = np.zeros(len(frequent), bool)
            first[np.unique(group, return_index=True)[1]] = True
            enough = np.flatnonzero(np.cumsum(~first) >= need - len(singles))
            length = enough[0] + 1 if len(enough) else len(frequent)
            for g in np.unique(group[:length]):
                mine = np.sort(frequent[:length][group[:length] == g])
                i, j = np.triu_indices(len(mine), 1)
                pair = (mine[i] * _MIX ^ mine[j]) * _MIX ^ np.uint64(level)
                found.append(pair ^ pair >> np.uint64(31))
    return np.unique(np.concatenate(found))


INDEX = "id long, n int, band int, typical int, tokens binary, entries array<long>"


def index(batches_: DataFrame, known: DataFrame) -> DataFrame:
    """Each set that may have a partner: its size, its shared tokens and its entries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, tokens, parts_ in zip(*(c.to_pylist() for c in batch.columns)):
                known_tokens = np.concatenate([np.frombuffer(p["tokens"], np.uint64) for p in parts_])
                known_n = np.concatenate([np.frombuffer(p["n"], np.int64) for p in parts_])
                order = np.argsort(known_tokens)
                known_tokens, known_n = known_tokens[order], known_n[order]
                sizes = np.frombuffer(sizes, np.int64)
                rows, ends = [], np.cumsum(sizes)
                for mark, n, end in zip(np.frombuffer(ids, np.int64).tolist(), sizes.tolist(), ends.tolist()):
                    mine = np.frombuffer(tokens, np.uint64)[end - n : end]
                    at = np.minimum(np.searchsorted(known_tokens, mine), len(known_tokens) - 1)
                    shared = known_tokens[at] == mine
                    if shared.sum() >= overlap(n):
                        often = known_n[at[shared]]
                        # how often others have its tokens: the middle of a group of copies has the most
                        typical = int(min(often.sum() // n, (1 << 31) - 1))
                        rows.append((mark, n, band(n), typical, mine[shared].tobytes(), entries(mine[shared], often, n).view(np.int64)))
                yield _rows(INDEX, list(zip(*rows)) or [[]] * 6)

    return batches_.join(known, "batch").select("ids", "sizes", "tokens", "known").mapInArrow(run, INDEX)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` that link."""
    right = sets.select(F.col("id").alias("v"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2"))
    both = pairs.join(sets.select(F.col("id").alias("u"), "n", "tokens"), "u").join(right, "v").select("u", "v", "n", "n2", "tokens", "tokens2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for us, vs, ns, n2s, xs, ys in _slices(batches):
            common = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(xs, ys)], np.int64)
            linked = common * 100 >= PERCENT * (np.array(ns, np.int64) + np.array(n2s, np.int64) - common)
            yield _rows("u long, v long", [np.array(us, np.int64)[linked], np.array(vs, np.int64)[linked]])

    return both.mapInArrow(run, "u long, v long")


def similar_sizes(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def linked_groups(sets: DataFrame) -> DataFrame:
    """``node`` and ``component`` of the sets that link with another."""
    postings = cut(sets.select("id", "n", "band", "typical", F.explode("entries").alias("entry")))
    lists = postings.groupBy("entry").agg(F.count(F.lit(1)).alias("of"), F.min(F.struct("n", "id")).alias("least")).filter("of > 1")
    listed = cut(postings.join(lists.select("entry", F.col("least.n").alias("n0"), F.col("least.id").alias("id0")), "entry"))

    # each set against the smallest set it shares an entry with, and the most typical one of its band
    smallest = listed.filter((F.col("id") != F.col("id0")) & similar_sizes("n", "n0")).groupBy("id").agg(F.min(F.struct("n0", "id0"))["id0"].alias("v"))
    middles = listed.groupBy("entry", "band").agg(F.max(F.struct("typical", "id")).alias("middle"))
    typical = listed.select("entry", "band", "id").join(middles, ["entry", "band"]).groupBy("id").agg(F.max("middle")["id"].alias("v"))
    centres = smallest.union(typical.filter("id <> v")).select(F.col("id").alias("u"), "v").distinct()
    links = cut(verified(centres, sets))

    # entries whose sets are not one group yet: the sets they connect are candidates of each other
    named = listed.select("entry", "id", "id0").join(components(links), F.col("id") == F.col("node"), "left").select("entry", "id", "id0", F.coalesce("component", "id").alias("component"))
    several = named.groupBy("entry").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one <> other")
    open_ = named.join(several.select("entry"), "entry").filter("id <> id0").select(F.col("id").alias("u"), F.col("id0").alias("v")).distinct()
    members = components(open_).join(sets, F.col("node") == F.col("id")).select(
        F.col("component").alias("group"), "id", F.col("n").cast("long").alias("n"), (F.col("n") - F.octet_length("tokens") / 8).cast("long").alias("extra"), "tokens"
    )
    return components(links.union(links_within(members, PERCENT)))


def similar_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: ``doc``, ``n`` (tokens) and ``component``, the smallest id that links lead to.

    ``version`` is a hash of the text; ``first`` tells the smallest id and version of each group.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = documents.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    described = cut(describe(given, parts))
    marks = described.filter("part < 0").select("doc", "version", "n", "a", "b")
    shared = shared_counts(described.filter("part >= 0").select("part", "tokens", "owners", "of"), parts)
    least_row = F.min(F.struct("doc", "version")).alias("least")
    classes_ = cut(marks.filter("doc IS NOT NULL AND n > 0").groupBy("a", "b", "n").agg(least_row))
    # the smallest share asked for, as in ``share``
    least = F.expr(f"(overlap - ({PERCENT} * overlap + 99) div 100 + 3) div 3")
    going = classes_.withColumn("overlap", F.expr(f"({PERCENT} * n + 99) div 100")).join(shared, "a").filter(F.col("shared") >= least)
    chosen = going.select("least.doc", "least.version", "a")
    packed = cut(batches_of(given, chosen))
    sets = cut(index(packed, frequencies(packed, parts)))
    # groups are of fingerprints; each is named by the smallest id and version of its rows
    linked = linked_groups(sets).join(classes_.select("a", "least"), F.col("node") == F.col("a")).select("a", "component", "least")
    groups = linked.groupBy("component").agg(F.min("least").alias("group"))
    grouped = linked.select("a", "component").join(groups, "component").select(F.col("a").alias("node"), "group")
    named = classes_.join(grouped, F.col("node") == F.col("a"), "left").select("a", "b", F.coalesce("group", "least").alias("group"))
    linking = (F.col("n") > 0) & F.col("doc").isNotNull()
    return marks.join(named, ["a", "b"], "left").select(
        "doc",
        F.col("n").cast("long").alias("n"),
        F.when(linking, F.col("group.doc")).otherwise(F.col("doc")).alias("component"),
        "version",
        F.when(linking, F.struct("doc", "version") == F.col("group")).otherwise(F.lit(True)).alias("first"),
    )
