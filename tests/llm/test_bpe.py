import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks()


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return bpe.Tokenizer(ranks)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_tokens_as_the_vocabularys_own_library(tokenizer, reference):
    rng = random.Random(5)
    alphabet = "abcdefghij      éèß日本語🙂\t\n 0123456789²½Ⅷ'sdll_-.,!\x1c\x85٣"
    texts = ["", " ", "a", "<|endoftext|>", "it's we'll", "a" * 3000, "=" * 2000, "the" * 900, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(600))]
    got = tokenizer.encode_many(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert tokenizer.decode(ids.tolist()) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    tokenizer = _cached()
    assert tokenizer.decode(tokenizer.encode(text)) == text


_kept = []


def _cached():
    if not _kept:
        _kept.append(bpe.Tokenizer(bpe.load_ranks()))
    return _kept[0]


def test_streaming_emits_final_tokens_only_and_keeps_a_bounded_buffer(ranks, tokenizer):
    rng = random.Random(2)
    data = "".join(rng.choice(["the", "tion", "a", "e", "ing", "xq"]) for _ in range(9000)).encode()
    whole = [ranks[p] for p in bpe.merge(data, ranks)]
    encoder, out, at = bpe.Encoder(ranks, tokenizer.sufficient), [], 0
    while at < len(data):
        step = rng.randint(1, 700)
        out += encoder.feed(data[at : at + step])
        at += step
        assert out == whole[: len(out)]
        assert len(encoder.buffer) <= tokenizer.sufficient + 2 * bpe._BLOCK
    assert out + encoder.finish() == whole and len(out) > len(whole) // 2


def _plain(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_against_a_plain_version(ranks):
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 17, 200, 900):
        for alphabet in ("a", "ab", "etaoinshrdlu ", "日本語"):
            piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert bpe.merge(piece, ranks) == _plain(piece, ranks)


def test_a_stream_of_any_portions_gives_the_same_tokens(tokenizer, reference):
    rng = random.Random(4)
    runs = ["a" * 9000, " " * 9000, "\n" * 5000 + "x", "7" * 5000, "=" * 4500, "'" * 5000 + "s", "日本" * 3000, " " * 5000 + "!", "\t" * 4200 + " y", "²" * 4300]
    for case in range(60):
        parts = [rng.choice([*runs, "it's we'll they've", " the cat", "é", "  ", "\n\n", "'", "'l", "12", "\u3000", "x\x1c"]) for _ in range(rng.randint(1, 9))]
        text = "".join(parts)
        stream, out, at = bpe.Stream(tokenizer), [], 0
        while at < len(text):
            step = rng.choice([1, 2, 3, 700, 5000])
            out.append(stream.feed(text[at : at + step]))
            at += step
            assert len(stream.tail) <= bpe.RUN + 5000
        ids = np.frombuffer(b"".join(out) + stream.finish(), np.int32)
        assert ids.tolist() == reference.encode_ordinary(text), case
        assert tokenizer.decodes_to(ids, text) and not tokenizer.decodes_to(ids, text + "x") and not tokenizer.decodes_to(ids, text[:-1])


def test_unbroken_runs_take_linear_time(tokenizer, reference):
    rng = random.Random(9)
    n = 1 << 20
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "a" * n, "".join(rng.choice("日本語中文字") for _ in range(n // 3)), " " * n):
        began = time.process_time()
        ids = tokenizer.encode_many([text])[0]
        assert time.process_time() - began < 12
        assert tokenizer.decodes_to(ids, text)
        assert ids[: bpe.RUN].tolist() == reference.encode_ordinary(text[: 8 * bpe.RUN])[: bpe.RUN]


def _tiny(merges):
    ranks = {bytes([b]): b for b in range(256)}
    for m in merges:
        ranks[m] = len(ranks)
    return ranks


def test_lookahead_suffices_for_small_vocabularies():
    rng = random.Random(11)
    for _ in range(60):
        ranks = _tiny([])
        tokens = [b"a", b"b", b"c"]
        for _ in range(rng.randint(1, 9)):
            t = rng.choice(tokens) + rng.choice(tokens)
            if t not in ranks:
                ranks[t] = len(ranks)
                tokens.append(t)
        need = bpe.lookahead(ranks)
        for _ in range(25):
            x = bytes(rng.choice(b"abc") for _ in range(need + 12))
            runs = [bpe.merge(x + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))), ranks) for _ in range(4)]
            safe = []
            for run in runs:
                at, own = 0, []
                for t in run:
                    at += len(t)
                    if at > len(x) - need:
                        break
                    own.append(t)
                safe.append(own)
            assert all(s == safe[0] for s in safe)


def test_lookahead_of_known_lists():
    assert bpe.lookahead(_tiny([])) == 0
    assert bpe.lookahead(_tiny([b"ab"])) == 1
    # bc, then ab: whether c comes after ab decides about b and then about a
    assert bpe.lookahead(_tiny([b"bc", b"ab"])) == 2


def test_decoder_holds_back_unfinished_characters():
    tokens = {b: bytes([b]) for b in range(256)}
    decoder, text = bpe.Decoder(tokens), "aé日🙂z"
    assert "".join(decoder.feed([b]) for b in text.encode()) + decoder.finish() == text
    broken = bpe.Decoder(tokens)
    assert broken.feed([0xE6, 0x97]) == "" and broken.finish() == "�"
    assert bpe.Decoder(tokens).feed([0xFF, 0x41]) == "�A"


def test_memory_of_pieces_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    t = bpe.Tokenizer(ranks, 843)
    rng = random.Random(1)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
        assert t.decode(t.encode(text)) == text
        assert len(t.young) + len(t.old) <= 110


def test_column(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (None, "x"), (1, "the cat"), (4, "été " * 5000)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id bigint, text string, n_tokens int, tokens string")
    out = bpe.round_trip(df)
    got = {(r.doc_id, r.n_tokens, r.round_trip) for r in out.collect()}
    assert (2, None, None) in got and (3, 0, True) in got and (None, 1, True) in got and (1, 2, True) in got
    assert out.count() == 6 and out.filter("round_trip = false").count() == 0
    back = {(r.doc_id, r.text) for r in bpe.decode_column(out).collect()}
    assert back == set(rows)
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_the_other_vocabulary(spark):
    path = bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    if not os.path.exists(path):
        pytest.skip("not there")
    df = spark.createDataFrame([(1, "Beverbe in dieentzäsch ä")], "doc_id bigint, text string")
    assert bpe.round_trip(df, vocabulary=path).first().round_trip
