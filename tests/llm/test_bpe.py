import base64
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from arbora.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(encoded):
    return np.frombuffer(encoded, np.int32).tolist()


def test_ranks():
    assert base64.b64encode(next(iter(RANKS))) and len(RANKS) == 50_256


@pytest.mark.parametrize("most_states", [30, 100_000])
def test_encoder_on_random_texts(most_states):
    encode, decode, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), bpe.Decoder(RANKS, run=7), random.Random(4)
    encode.pieces.transducer.most_states = most_states
    letters = "abcdefghi jklm nop'st \n\t  019éüñß€漢字😀²½x\x1f\x85 "
    for n in range(600):
        text = "".join(rng.choice(letters if n % 2 else "estrandio") for _ in range(rng.randrange(70)))
        found = ids(encode(text))
        assert found == OTHER.encode_ordinary(text)
        assert decode(np.array(found, np.int32)) == text


def ids_of_block(encode, texts):
    found, ends = encode.many(texts)
    return [found[a:b].tolist() for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("most_pieces, most_states", [(20, 30), (100_000, 100_000)])
def test_blocks_of_texts(most_pieces, most_states):
    """No match goes from a text to the next, and pieces are as they are alone, whatever is kept of others."""
    encode, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN, most_pieces, most_states), random.Random(5)
    parts = ["'", "s", "'s", "'re", "'ll", "l", "'v", "e", "'S", " ", "  ", "\n", "\t ", "a", "word", "12", "²", "é", "漢字", "😀", "\0", "\u3000", "\x1f", "!", "?'", "m"]
    for _ in range(150):
        texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(rng.randrange(30))]
        assert ids_of_block(encode, texts) == [OTHER.encode_ordinary(t) for t in texts]
    long = ["".join(rng.choices("ethan漢", k=n)) for n in (*range(36, 44), *range(1_020, 1_030)) for _ in range(2)]
    texts = ["a", "a\0", "\0", "\0" * 39, "\0" * 40, "", *long]
    for block in (texts, texts[::-1], [" ".join(texts)] * 2):
        assert ids_of_block(encode, block) == [OTHER.encode_ordinary(t) for t in block]


def test_pieces_with_equal_keys(monkeypatch):
    monkeypatch.setattr(bpe.Pieces, "keys", lambda self, words: (words[:, 0] & np.uint64(3)).astype(np.int64))
    encode, texts = bpe.Encoder(RANKS, public_tokenizers.PATTERN), [f"word{i} x{i % 7} end" for i in range(200)]
    for _ in range(3):
        assert ids_of_block(encode, texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_a_long_text_is_cut_where_matches_begin(monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_BYTES", 20)
    encode, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(6)
    for n in range(200):
        text = "".join(rng.choices("ab's  \n\t\u3000 é", k=rng.randrange(300)))
        assert ids(encode(text)) == OTHER.encode_ordinary(text)
        assert "".join(encode.split.stretches(text)) == text
    assert max(map(len, encode.split.stretches("ab " * 500))) < 50


def test_other_patterns():
    encode = bpe.Encoder(RANKS, r"[a-z]*")
    assert ids_of_block(encode, ["ab, cd", "", "!"]) == [OTHER.encode_ordinary("ab") + OTHER.encode_ordinary("cd"), [], []]


def test_pieces_are_read_side_by_side(monkeypatch):
    """A block takes as many steps as its longest piece has bytes, not as all have; nothing is read twice."""
    encode, steps = bpe.Encoder(RANKS, public_tokenizers.PATTERN), []
    step = bpe.Transducer.step
    monkeypatch.setattr(bpe.Transducer, "step", lambda self, *given: steps.append(1) or step(self, *given))
    texts = [f"qu{i} wor{chr(97 + i % 26)}d{chr(97 + i // 26)}" for i in range(600)]
    assert ids_of_block(encode, texts) == [OTHER.encode_ordinary(t) for t in texts]
    assert 0 < len(steps) <= 8
    assert ids_of_block(encode, texts[::-1]) == [OTHER.encode_ordinary(t) for t in texts[::-1]] and len(steps) <= 8


def test_long_pieces():
    encode = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("ab" * 20_000, "é" * 9_000, " " * 5_000):
        assert ids(encode(text)) == OTHER.encode_ordinary(text)


@pytest.mark.parametrize("block", [3, 50, 4_096])
def test_tokens_leave_before_the_end_of_a_piece(monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    transducer, rng = bpe.Transducer(RANKS, 200), random.Random(block)
    for letters in ("ab", "ethanors", "abcdefghijklmnopqrstuvwxyz"):
        piece = "".join(rng.choices(letters, k=5_000))
        assert transducer.encode(piece.encode()) == OTHER.encode_ordinary(piece)


def test_stream_is_incremental():
    data = "aé漢😀z".encode()
    for size in (1, 2, 3, 5):
        stream = bpe.Utf8Stream()
        parts = [stream.push(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join([*parts, stream.end()]) == data.decode()
    stream = bpe.Utf8Stream()
    assert stream.push(b"\xe6\xbc") == "" and stream.end() == "�"


def test_documents(documents, empty, clashing):
    for table in (documents, clashing):
        encoded = bpe.encode(table, PATH, public_tokenizers.PATTERN)
        for r in bpe.decode(encoded, PATH).collect():
            assert r.ids == OTHER.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    assert bpe.decode(bpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_packed_rows_hold_token_ids(spark, tmp_path):
    """The query's rows are token ids, not bytes: one row of known contents, and a document of several rows."""
    import hashlib

    from arbora.llm.queries import QUERIES

    texts = {1: "lorem ipsum dolor " * 40, 2: "the quick brown fox", 3: None, 4: " ".join(f"ünï{i} 漢字" for i in range(3_000))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "all/documents.parquet"))
    encoded = {doc: OTHER.encode_ordinary(text or "") for doc, text in texts.items()}
    got = {}
    for r in QUERIES["op10_pack_tokens"](spark, str(tmp_path / "all")).collect():
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cumulative, r.cumulative[1:]):
            got.setdefault(doc, {})[part] = b - a
    assert {d: sum(p.values()) for d, p in got.items()} == {d: len(ids) + 1 for d, ids in encoded.items()} and len(got[4]) > 1

    spark.createDataFrame([(2, texts[2])], "doc_id long, text string").write.parquet(str(tmp_path / "one/documents.parquet"))
    (row,) = QUERIES["op10_pack_tokens"](spark, str(tmp_path / "one")).collect()
    want = np.full(4096, len(RANKS) + 1, "<u4")
    want[: row.n_tokens] = [*encoded[2], len(RANKS)]
    assert row.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
