"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours are the encoding of their own
concatenation. That makes encoding a rational relation: a nondeterministic transducer reads bytes along the trie of
tokens and, where a token ends, may emit it if it goes with the token before. ``Transducer`` determinises it while
texts are read: a state is the set of readings that are still open, and the token that ends at each byte is noted. A note
is final once the open readings agree on it, a few longest tokens later: at the end of a piece, and every ``BLOCK`` bytes
of a longer one, what they agree on is emitted and its notes are let go. Transitions are kept in a table.

Texts are taken in blocks of some ``TEXT_BYTES``. The pieces of a block are cut and told apart all at once; those
not seen before go through the transducer side by side, a byte each at a time, and are kept with their tokens. Kept states are
dropped when there are too many, and so is the half of the kept pieces that was not met for longest: that costs time and changes nothing.

Tasks read the rank file from its path parameter (a small public file that every machine holds). Null texts count as
empty: no tokens, empty decoding. An empty table gives no rows. Very long texts and pieces take time in proportion to their length. Repeated rows are encoded alike;
other columns stay, and ones named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arbora.llm.common import by_bytes, mixed, release_memory, unused

#: States and pieces of an encoder that ends with its task, and of one that a worker keeps over tasks.
MOST_STATES, MOST_PIECES = 40_000, 150_000
KEPT_STATES, KEPT_PIECES = 120_000, 200_000
#: Bytes of a piece between two emissions.
BLOCK = 4_096
#: Bytes (of one text: characters) that are cut into pieces at once.
TEXT_BYTES = 1 << 21
#: Bytes of pieces that are read side by side: at most so many states are made before they are counted again.
SIDE_BYTES = 1 << 16
#: Pieces of more bytes are not kept.
KEPT_BYTES = 39
#: Pieces of more bytes are read alone.
LONG = 1_024
ROWS_AT_ONCE = 64
#: Later than every rank.
LAST = 1 << 40
#: Below a trie node with so few tokens, readings that cannot end are dropped and needless memory of the last token is.
FEW = 12


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Numbers:
    """Numbers by key, from 0 on: an open hash table in two arrays, asked for many keys at once."""

    MIX = 0x1E3779B97F4A7C15

    def __init__(self, places: int = 1 << 12):
        self.size, self.keys, self.numbers = 0, np.full(places, -1, np.int64), np.empty(places, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for unknown ones."""
        most = len(self.keys) - 1
        at = keys * self.MIX >> 32 & most
        held = self.keys[at]
        found = np.where(held == keys, self.numbers[at], np.int32(-1))
        others = np.flatnonzero((held != keys) & (held >= 0))
        while len(others):
            at[others] = after = (at[others] + 1) & most
            held = self.keys[after]
            same = held == keys[others]
            found[others[same]] = self.numbers[after[same]]
            others = others[~same & (held >= 0)]
        return found

    def get_one(self, key: int) -> int:
        most = len(self.keys) - 1
        at = key * self.MIX >> 32 & most
        while (held := self.keys.item(at)) >= 0:
            if held == key:
                return self.numbers.item(at)
            at = (at + 1) & most
        return -1

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Of new keys; of equal ones, one stays."""
        while 5 * (self.size + len(keys)) > 2 * len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.numbers[held]
            self.__init__(2 * len(self.keys))
            self.put(*old)
        self.size, most = self.size + len(keys), len(self.keys) - 1
        at = keys * self.MIX >> 32 & most
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.numbers[at[here]] = numbers[here]
            keys, numbers, at = keys[~here], numbers[~here], (at[~here] + 1) & most

    def put_one(self, key: int, number: int) -> None:
        if 5 * self.size >= 2 * len(self.keys):
            return self.put(np.array([key]), np.array([number], np.int32))
        self.size, most = self.size + 1, len(self.keys) - 1
        at = key * self.MIX >> 32 & most
        while self.keys.item(at) >= 0:
            at = (at + 1) & most
        self.keys[at], self.numbers[at] = key, number


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth = array("i", [0])
        for piece, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(piece, 1):
                node = self.next[node].setdefault(byte, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.token.append(-1)
                    self.depth.append(depth)
            self.token[node] = rank
        self.below: list[list[int]] = [[] for _ in self.next]
        for piece, rank in ranks.items():
            node = 0
            for byte in piece[:-1]:
                node = self.next[node][byte]
                if len(self.below[node]) <= FEW:
                    self.below[node].append(rank)
        self.length = {rank: len(piece) for piece, rank in ranks.items()}
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.edges: dict[int, dict[int, list[tuple[bytes, int]]]] = {0: {}, -1: {}}
        self.clear()

    def clear(self) -> None:
        """Forget determinised states; the start has one reading, at the trie's root."""
        self.number: dict[tuple, int] = {}
        self.readings: list[tuple] = []
        self.moves = Numbers()  # the state after a state and a byte (256 * state + byte)
        self.ended = np.full(256, -1, np.int32)  # the token that ends where the state is, if any does
        self.state(((0, -1),), -1)

    def state(self, readings: tuple, ended: int) -> int:
        key = (readings, ended)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.readings)
            if found == len(self.ended):
                self.ended = np.append(self.ended, np.full(found, -1, np.int32))
            self.readings.append(readings)
            self.ended[found] = ended
        return found

    def parts(self, piece: bytes) -> list[bytes]:
        """The two tokens whose merge makes ``piece``: merge pairs of lowest rank until two parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one side (0: left, -1: right) of a token while it is merged, from its byte to the whole.

        Each part comes with the rank of the merge that makes it the next one.
        """
        found = self.edges[side].get(token)
        if found is None:
            piece = self.pieces[token]
            found = [(piece, LAST)]
            if len(piece) > 1:
                grown = self.edge(self.ranks[self.parts(piece)[side]], side)
                found = [*grown[:-1], (grown[-1][0], token), *found]
            self.edges[side][token] = found
        return found

    def goes_with(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left`` (-1: nothing) in an encoding.

        Parts grow in the order of ranks on both sides of the border; no pair that meets there may be due before
        the next merge on either side.
        """
        if left < 0:
            return True
        xs, ys = self.edges[-1].get(left) or self.edge(left, -1), self.edges[0].get(right) or self.edge(right, 0)
        merge = self.ranks.get
        (x, due_x), (y, due_y) = xs[0], ys[0]
        i = j = 0
        while True:
            across = merge(x + y, LAST)
            if across < due_x and across <= due_y:
                return False
            if due_x <= due_y:
                if due_x == LAST:
                    return True
                i += 1
                x, due_x = xs[i]
            else:
                j += 1
                y, due_y = ys[j]

    def needed(self, node: int, last: int) -> int | None:
        """What a reading must remember of its last token: None if no token below fits it, -1 if all (of a few) do."""
        below = self.below[node]
        if not below:
            return None
        if last < 0 or len(below) > FEW:
            return last
        fits = self.goes_with(last, below[0])
        for token in below[1:]:
            if self.goes_with(last, token) != fits:
                return last
        return -1 if fits else None

    def move(self, state: int, byte: int) -> int:
        """Determinise one transition."""
        after, ended = [], -1
        for node, last in self.readings[state]:
            node = self.next[node].get(byte)
            if node is not None:
                token = self.token[node]
                if token >= 0 and ended < 0 and self.goes_with(last, token):
                    ended = token
                last = self.needed(node, last)
                if last is not None:
                    after.append((node, last))
        if ended >= 0:
            after.append((0, ended))
        found = self.state(tuple(after), ended)
        self.moves.put_one(state << 8 | byte, found)
        return found

    def settled(self, state: int, ended: list[int]) -> int:
        """How many of the noted bytes no open reading can still change: where the readings' pasts meet."""
        starts = {len(ended) - self.depth[node] for node, _ in self.readings[state]}
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(latest - self.length[ended[latest - 1]])
        return starts.pop()

    def before(self, ended: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` noted bytes."""
        out = []
        while at:
            token = ended[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Read forward, noting the token that ends at each byte; notes that are final are emitted."""
        if len(self.readings) > self.most_states:
            self.clear()
        state = 0
        out: list[int] = []
        ended: list[int] = []
        for start in range(0, len(piece), BLOCK):
            if start:
                final = self.settled(state, ended)
                out += self.before(ended, final)
                del ended[:final]
                if len(self.readings) > self.most_states:
                    readings, last = self.readings[state], self.ended.item(state)
                    self.clear()
                    state = self.state(readings, last)
            for byte in piece[start : start + BLOCK]:
                after = self.moves.get_one(state << 8 | byte)
                state = self.move(state, byte) if after < 0 else after
                ended.append(self.ended.item(state))
        return out + self.before(ended, len(ended))

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The states after a byte each; unknown transitions are determinised once."""
        keys = states.astype(np.int64) << 8 | bytes_
        after = self.moves.get(keys)
        if after.min() < 0:
            unknown = after < 0
            for key in np.unique(keys[unknown]).tolist():
                self.move(key >> 8, key & 255)
            after[unknown] = self.moves.get(keys[unknown])
        return after

    def encode_many(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of at least a byte, read side by side: the tokens of all, and how many each has."""
        if len(self.readings) > self.most_states:
            self.clear()
        order = np.argsort(-length, kind="stable")  # those that have ended are behind the others
        first, at = start[order], length[order]
        longer = np.searchsorted(-at, -np.arange(at[0])).tolist()
        states, ended = np.zeros(len(order), np.int32), np.empty((len(longer), len(order)), np.int32)
        for place, n in enumerate(longer):
            states = self.step(states[:n], data[first[:n] + place])
            ended[place, :n] = self.ended[states]
        found, count, open_ = [], np.zeros(len(order), np.int32), np.arange(len(order))
        while len(open_):  # back from the ends, a token each at a time
            tokens = ended[at[open_] - 1, open_]
            if tokens.min() < 0:
                raise KeyError("a byte that no token has")
            found.append((open_, tokens))
            count[open_] += 1
            at[open_] -= self.lengths[tokens]
            open_ = open_[at[open_] > 0]
        counts = np.empty_like(count)
        counts[order] = count
        last, out = np.cumsum(counts)[order] - 1, np.empty(count.sum(), np.int32)
        for back, (pieces, tokens) in enumerate(found):
            out[last[pieces] - back] = tokens
        return out, counts


LETTER, NUMBER, SPACE, OTHER = range(4)


@cache
def character_kinds() -> np.ndarray:
    """The kind of each code point, as the pattern module has it."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    characters = np.arange(0x110000, dtype="<u4")
    characters[0xD800:0xE000] = ord("?")  # surrogates are none
    text = characters.tobytes().decode("utf-32-le")
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(name, text):
            kinds[run.start() : run.end()] = kind
    return kinds


class Splitter:
    """The matches of a pattern in texts, in order: their UTF-8 bytes, and how many precede each text and the end.

    For the pattern that most byte-level vocabularies use, a block of texts is cut at once by the kinds of its
    characters; other patterns are matched text by text.
    """

    GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str):
        self.matches = regex.compile(pattern).findall
        self.kinds = character_kinds() if pattern == self.GENERAL else None
        self.gap = regex.compile(r"(?<=\S)\s")

    def __call__(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        if self.kinds is None:
            found = [[m for m in self.matches(text) if m] for text in texts]
            return pa.array([m.encode("utf-8", "replace") for f in found for m in f], pa.binary()), np.cumsum([0, *map(len, found)])
        text = "".join(texts)
        data = text.encode("utf-8", "replace")
        begins, where = self.begins(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), np.cumsum([0, *map(len, texts)]))
        if len(data) > len(text):
            begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[begins]
        offsets = np.append(begins, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), where

    def begins(self, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where matches begin in texts that follow each other, and how many do before each edge of a text."""
        n, kind = len(points), self.kinds[points]
        edge = np.zeros(n + 3, bool)
        edge[edges] = True
        begin = edge.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])  # white space before another character: a match
        begin[last] = True
        begin[last[points[last] == 0x20] + 1] = False  # or, if it is a blank, with what follows
        quote = np.flatnonzero(points == ord("'"))
        quote = quote[begin[quote] & ~edge[quote + 1]]
        after = np.append(points, np.zeros(2, points.dtype))
        one, two = after[quote + 1], after[quote + 2]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~edge[quote + 2]
        begin[quote[short | long] + 1] = False
        begin[quote[short] + 2] = True
        begin[quote[long] + 3] = True
        found = np.flatnonzero(begin[:n])
        return found, np.searchsorted(found, edges)

    def stretches(self, text: str) -> Iterator[str]:
        """A long text in stretches, each from white space that follows another character: no match goes over that."""
        at = 0
        while self.kinds is not None and len(text) - at > 2 * TEXT_BYTES:
            gap = self.gap.search(text, at + TEXT_BYTES)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]


def begins(count: np.ndarray) -> np.ndarray:
    """Where runs of so many places begin that follow each other."""
    return np.cumsum(count, dtype=count.dtype) - count


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begin`` and hold ``count`` places, one run after the other."""
    ends = np.cumsum(count, dtype=count.dtype)
    return np.arange(ends[-1] if len(ends) else 0, dtype=count.dtype) + np.repeat(begin - ends + count, count)


class Pieces:
    """Token ids of pieces; each short piece met is kept with its tokens and the turn in which it was met last."""

    WORDS = KEPT_BYTES // 8 + 1
    FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, transducer: Transducer, most: int):
        self.transducer, self.most, self.turn, self.number = transducer, most, 0, Numbers()
        self.tokens, self.begin, self.count, self.met = (np.zeros(0, np.int32) for _ in range(4))
        self.words = np.zeros((0, self.WORDS), np.uint64)

    def spelled(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Short pieces as numbers of eight bytes each; the last byte is the length, so that different pieces differ."""
        eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
        out = np.zeros((len(start), self.WORDS), np.uint64)
        for word in range(self.WORDS):
            left = length - 8 * word
            has = np.flatnonzero(left > 0)
            out[has, word] = eights[start[has] + 8 * word] & self.FIRST[np.minimum(left[has], 8)]
        out[:, -1] |= length.astype(np.uint64) << np.uint64(56)
        return out

    def keys(self, words: np.ndarray) -> np.ndarray:
        return (mixed(*words.T) >> np.uint64(1)).astype(np.int64)

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, and how many each has."""
        coded = pieces.dictionary_encode()
        own, of = coded.dictionary, coded.indices.to_numpy()
        if not len(own):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
        data, start, length = np.frombuffer(own.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)
        number, others = np.empty(len(own), np.int32), np.ones(len(own), bool)
        short = np.flatnonzero(length <= KEPT_BYTES)
        words = self.spelled(data, start[short], length[short])
        keys = self.keys(words)
        found = self.number.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.count) + np.arange(len(new))
            self.number.put(keys[new], found[new])
            self.keep(self.encoded(data, start, length, short[new]), words[new])
        same = (self.words[found] == words).all(axis=1)  # not so where keys of two pieces are equal
        self.turn += 1
        self.met[found[same]] = self.turn
        number[short], others[short[same]] = found, False
        begin, count, tokens = self.begin, self.count, self.tokens
        if others.any():  # they stand behind those kept for this time only
            others = np.flatnonzero(others)
            others = others[np.argsort(length[others] > LONG, kind="stable")]
            parts = self.encoded(data, start, length, others)
            counts = np.concatenate([counts for _, counts in parts])
            number[others] = len(count) + np.arange(len(others))
            begin, count = np.append(begin, len(tokens) + begins(counts)), np.append(count, counts)
            tokens = np.concatenate([tokens, *(ids for ids, _ in parts)])
        own_counts = count[number]
        own_tokens = tokens[runs(begin[number], own_counts)]
        counts = own_counts[of]
        out = own_tokens[runs(begins(own_counts)[of], counts)]
        self.age()
        return out, counts

    def encoded(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, pieces: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens and their numbers of pieces, in groups of some ``SIDE_BYTES`` bytes; long ones, which come last, alone."""
        many, alone = pieces[length[pieces] <= LONG], pieces[length[pieces] > LONG]
        groups = np.split(many, np.flatnonzero(np.diff(np.cumsum(length[many]) // SIDE_BYTES)) + 1)
        found = [self.transducer.encode_many(data, start[g], length[g]) for g in groups if len(g)]
        for i in alone.tolist():
            ids = self.transducer.encode(data[start[i] : start[i] + length[i]].tobytes())
            found.append((np.array(ids, np.int32), np.array([len(ids)], np.int32)))
        return found

    def keep(self, parts: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray) -> None:
        self.tokens = np.concatenate([self.tokens, *(tokens for tokens, _ in parts)])
        self.count = np.concatenate([self.count, *(count for _, count in parts)])
        self.begin = begins(self.count)
        self.met = np.append(self.met, np.zeros(len(words), np.int32))
        self.words = np.concatenate([self.words, words])

    def age(self) -> None:
        if len(self.count) > self.most:
            kept = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
            self.tokens = self.tokens[runs(self.begin[kept], self.count[kept])]
            self.count, self.met, self.words = self.count[kept], self.met[kept], self.words[kept]
            self.begin = begins(self.count)
            self.number = Numbers()
            self.number.put(self.keys(self.words), np.arange(len(kept), dtype=np.int32))


class Encoder:
    """Texts to token ids, each piece of the pattern by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = MOST_PIECES, most_states: int = MOST_STATES):
        self.split, self.pieces = Splitter(pattern), Pieces(Transducer(ranks, most_states), most_pieces)

    def __call__(self, text: str) -> bytes:
        """The ids as 32-bit integers in bytes."""
        return self.many([text])[0].tobytes()

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many precede each text and the end."""
        if len(texts) == 1 and len(texts[0]) > 2 * TEXT_BYTES:
            ids = np.concatenate([self.pieces(self.split([part])[0])[0] for part in self.split.stretches(texts[0])])
            return ids, np.array([0, len(ids)])
        pieces, where = self.split(texts)
        ids, counts = self.pieces(pieces)
        return ids, np.append(0, np.cumsum(counts))[where]


class Utf8Stream:
    """Bytes in, text out as soon as it is complete: the state is the unfinished character at the end."""

    def __init__(self) -> None:
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        n = len(data)
        keep = 0
        for back in range(1, min(3, n) + 1):
            byte = data[n - back]
            if byte >= 0xC0:  # a lead byte: how many bytes its character has
                keep = back if (2 + (byte >= 0xE0) + (byte >= 0xF0)) > back else 0
                break
            if byte < 0x80:
                break
        self.held = data[n - keep :]
        return data[: n - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Token ids to text: the bytes of a row's tokens are laid out at once and streamed through the state machine."""

    def __init__(self, ranks: dict[bytes, int], run: int = 1 << 16):
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.run, self.bytes = run, np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(piece) for piece in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, ids: np.ndarray) -> str:
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + length, length)
        data, stream = self.bytes[at].tobytes(), Utf8Stream()
        parts = [stream.push(data[i : i + self.run]) for i in range(0, len(data), self.run)]
        return "".join([*parts, stream.end()])


_MADE: dict[tuple, object] = {}


def _made(kind, *args):
    """One encoder or decoder per worker, until it is dropped."""
    key = (kind.__name__, *args)
    if key not in _MADE:
        _MADE[key] = kind(read_ranks(args[0]), *args[1:])
    return _MADE[key]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [*batch.schema.names[:-1], name]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=names)


def _by_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _by_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return by_bytes(batches, TEXT_BYTES)


def _mapped(documents: DataFrame, source: str, name: str, kind: T.DataType, column: Callable[[pa.Array], pa.Array], keep: bool, parts=_by_rows) -> DataFrame:
    """Replace the last column of ``kept + source`` by ``column(values)``, a few rows at a time."""
    kept = [c for c in documents.columns if c.lower() != name.lower()]
    rows = documents.select(*kept, documents[source].alias(*unused(kept, "_source")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in parts(batches):
                yield _with(part, name, column(part.column(part.num_columns - 1)))
        finally:
            if not keep:  # workers are used again by other steps
                _MADE.clear()
                release_memory()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, kind)]))


def _ids(texts: pa.Array, path: str, pattern: str, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    limits = (KEPT_PIECES, KEPT_STATES) if keep else (MOST_PIECES, MOST_STATES)
    return _made(Encoder, path, pattern, *limits).many([text or "" for text in texts.to_pylist()])


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: bool = False) -> DataFrame:
    """The documents with ``ids``, the tokens of their whole texts.

    ``keep``: workers hold the encoder for their later tasks, for jobs with no other heavy step.
    """

    def ids(texts: pa.Array) -> pa.Array:
        found, ends = _ids(texts, path, pattern, keep)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))

    return _mapped(documents, text, "ids", T.ArrayType(T.IntegerType()), ids, keep, _by_text)


def encode_packed(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: bool = False) -> DataFrame:
    """The documents with ``ids``, the tokens of their whole texts as 32-bit integers in bytes."""

    def ids(texts: pa.Array) -> pa.Array:
        found, ends = _ids(texts, path, pattern, keep)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(found)])

    return _mapped(documents, text, "ids", T.BinaryType(), ids, keep, _by_text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: bool = False) -> DataFrame:
    """The rows with ``decoded``, the text of their token ids; null ids count as none."""

    def texts(column: pa.ListArray) -> pa.Array:
        decoder = _made(Decoder, path)
        none = np.zeros(0, np.int32)
        return pa.array([decoder(value.values.to_numpy() if value.is_valid else none) for value in column], pa.string())

    return _mapped(encoded, ids, "decoded", T.StringType(), texts, keep)
