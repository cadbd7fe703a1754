"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A rank table gives each token a rank; in a piece of text the adjacent pair whose bytes form the token of the lowest rank is
merged, the leftmost first, until none is left. ``lookahead`` computes from the table how many bytes behind a point can
still change the tokens before it:

    Say two texts agree on their first n bytes, and let D be the last place where both have a token boundary and the same
    tokens before it, as the ranks are worked through from the lowest. D starts at n. A merge of (u, v) moves D only if v
    begins at D in one of the texts alone, and then to the beginning of u, len(u) bytes to the left. A later merge
    (u', v') that moves D again has a higher rank, and its v' begins where u did: v' has u as a prefix. So D never moves
    further than the largest sum of len(u) over such chains of rising rank, which a pass over the table in rank
    order finds.

Tokens that end at least that many bytes before the end of what was read are final. ``Encoder`` emits them, keeps the rest
and reads on, so a piece of any length takes memory by the lookahead only. As no merge crosses a token boundary of the
result, encoding goes on from a boundary as from the start. Within a block the pairs wait in a heap, so its time is n log n.

The pieces are those of the vocabulary's pattern. ``Stream`` finds them as characters arrive: a piece is settled once a further
one follows and the three characters that a contraction may need are there; an unbroken run that gets long goes to an
``Encoder`` as it comes. Texts are fed in portions of ``PORTION`` characters, so beside the text itself and its tokens memory doesn't grow with it.
Short pieces come back often and are remembered in a table of bounded size.

``Decoder`` turns tokens to text as they come, holding back the at most three bytes of an unfinished character.

Defined results. A null text has null tokens, an empty one none. Special tokens in a text are ordinary text. A lone surrogate
can't occur in a string column. Rows repeating an id are encoded each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this many bytes are remembered, and so many of them.
REMEMBERED_BYTES, REMEMBERED = 64, 200_000
#: Characters that a text is fed by, characters after which an unbroken run is encoded as it comes, tokens that are decoded at once.
PORTION, RUN, DECODED = 1 << 16, 1 << 12, 1 << 12
_BLOCK = 1 << 12
# the same pattern for the standard library's faster engine, for texts without the characters on which the two differ:
# numbers that aren't decimal digits, and the four separators that only Python takes for white space
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SLOW = regex.compile(PATTERN)


@functools.cache
def unlike_characters() -> frozenset[str]:
    """All characters that ``_FAST`` and ``_SLOW`` don't treat alike."""
    letter, number, space = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match, regex.compile(r"\s").match
    own_letter, own_number, own_space, own_rest = re.compile(r"[^\W\d_]").match, re.compile(r"\d").match, re.compile(r"\s").match, re.compile(r"[^\s\w]|_").match
    found = []
    for c in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
        x = chr(c)
        a = 1 if letter(x) else 2 if number(x) else 3 if space(x) else 4
        b = 1 if own_letter(x) else 2 if own_number(x) else 3 if own_space(x) else 4 if own_rest(x) else 5
        if a != b:
            found.append(x)
    return frozenset(found)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes behind a point that suffice to know all tokens before it (see the module)."""
    reach: dict[bytes, int] = {}
    most = 0
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        new: dict[bytes, int] = {}
        for i in range(1, len(token)):
            u, v = token[:i], token[i:]
            if u in ranks and v in ranks:
                chain = i + max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
                new[u] = max(new.get(u, 0), chain)
                most = max(most, chain)
        for u, chain in new.items():
            if chain > reach.get(u, 0):
                reach[u] = chain
    return most


class Pairs:
    """The ranks of all mergeable pairs of tokens, to be looked up in arrays: open addressing in two numpy arrays."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        key, rank = np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int32)
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, self.NONE)
        at, left = self._home(key), np.arange(len(key))
        while len(left):
            free = self.keys[at[left]] == ~np.uint64(0)
            _, first = np.unique(at[left], return_index=True)
            put = left[first[free[first]]]
            self.keys[at[put]], self.ranks[at[put]] = key[put], rank[put]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids; ``NONE`` if they don't merge or one is -1."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        at = self._home(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((held != key) & (held != ~np.uint64(0)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held != ~np.uint64(0))]
        out[(a < 0) | (b < 0)] = self.NONE
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of a piece by repeatedly merging the leftmost pair of the lowest rank, for pieces of bounded length."""
    n = len(piece)
    if n < 2:
        return [piece] if piece else []
    get = ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    # a pair waits as (rank, where it begins, where it ends) in one number; one whose tokens have changed is out of date
    heap = [rank << 64 | i << 32 | i + 2 for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        top = pop(heap)
        i, end = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[i], after[middle] = end, -1
        if end < n:
            before[end] = i
            last = after[end]
            if (rank := get(piece[i:last])) is not None:
                push(heap, rank << 64 | i << 32 | last)
        first = before[i]
        if first >= 0 and (rank := get(piece[first:end])) is not None:
            push(heap, rank << 64 | first << 32 | end)
    out, i = [], 0
    while i < n:
        out.append(piece[i : after[i]])
        i = after[i]
    return out


def merge_many(pieces: list[bytes], singles: np.ndarray, pairs: Pairs) -> list[bytes]:
    """``merge`` of many short pieces at once: token ids of each, as int32 bytes. ``singles`` are the ids of single bytes."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
    for width, chosen in by_width.items():
        rows = np.array(chosen)
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in chosen), np.uint8).reshape(len(chosen), width)
        length = np.array([len(pieces[i]) for i in chosen])
        ids = np.full((len(chosen), width + 1), -1, np.int32)
        columns = np.arange(width + 1)
        ids[:, :width] = np.where(columns[:width] < length[:, None], singles[raw], -1)
        rank = np.full((len(chosen), width + 1), Pairs.NONE, np.int32)
        rank[:, :width] = pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(chosen), width)
        while len(rows):
            at = rank.argmin(1)
            every = np.arange(len(rows))
            low = rank[every, at]
            live = low != Pairs.NONE
            if not live.all():
                for i in np.flatnonzero(~live):
                    out[rows[i]] = ids[i, : length[i]].tobytes()
                rows, ids, rank, length, at, low = rows[live], ids[live], rank[live], length[live], at[live], low[live]
                every = np.arange(len(rows))
            if not len(rows):
                break
            ids[every, at] = low  # a token's id is its rank
            source = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, source, 1)
            source = np.minimum(columns + (columns >= at[:, None]), width)
            rank = np.take_along_axis(rank, source, 1)
            length -= 1
            rank[every, at] = pairs.rank(ids[every, at], ids[every, np.minimum(at + 1, width)])
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = pairs.rank(ids[inner, at[inner] - 1], ids[inner, at[inner]])
    return out


class Encoder:
    """Encodes one piece that arrives in any portions; memory is bounded by the lookahead and the longest token."""

    def __init__(self, ranks: dict[bytes, int], sufficient: int):
        self.ranks, self.sufficient, self.buffer = ranks, sufficient, b""

    def feed(self, data: bytes) -> list[int]:
        """Tokens that became final with these bytes."""
        out: list[int] = []
        for at in range(0, len(data), _BLOCK):
            self.buffer += data[at : at + _BLOCK]
            if len(self.buffer) > self.sufficient + _BLOCK:
                out += self._emit(len(self.buffer) - self.sufficient)
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.buffer))
        self.buffer = b""
        return out

    def _emit(self, limit: int) -> list[int]:
        out, at = [], 0
        for part in merge(self.buffer, self.ranks):
            if at + len(part) > limit:
                break
            at += len(part)
            out.append(self.ranks[part])
        self.buffer = self.buffer[at:]
        return out


_CLASSES = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]


class Stream:
    """Encodes a text that arrives in any portions of characters."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.tail, self.run, self.encoder = tokenizer, "", None, None

    def feed(self, text: str) -> bytes:
        """Tokens, as int32 bytes, that became final with these characters."""
        out = []
        if self.run is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            out.append(self._on(text[:end]))
            if end == len(text):
                return b"".join(out)
            out.append(self._ended())
            text = text[end:]
        text = self.tail + text
        pieces = self.tokenizer.pieces(text)
        held, at = len(pieces), len(text)
        while held and (at == len(text) or at - len(pieces[held - 1]) + 3 > len(text)):
            held -= 1
            at -= len(pieces[held])
        out.append(self.tokenizer.tokens_of(pieces[:held]))
        self.tail = text[at:]
        if len(self.tail) > RUN:  # then it is one piece, and its last character tells of what
            self.run = next(c for c in _CLASSES if c.match(self.tail[-1]))
            self.encoder = Encoder(self.tokenizer.ranks, self.tokenizer.sufficient)
            run, self.tail = self.tail, ""
            out.append(self._on(run))
        return b"".join(out)

    def finish(self) -> bytes:
        if self.run is not None:
            if self.run is _CLASSES[-1]:  # white space to the end is one piece
                out = array("i", self.encoder.feed(self.tail.encode())).tobytes()
                self.tail = ""
                return out + self._ended()
            return self._ended()
        out, self.tail = self.tokenizer.tokens_of(self.tokenizer.pieces(self.tail)), ""
        return out

    def _on(self, text: str) -> bytes:
        if self.run is _CLASSES[-1] and text:  # the last white space before other characters isn't the run's
            text, self.tail = self.tail + text[:-1], text[-1]
        return array("i", self.encoder.feed(text.encode())).tobytes()

    def _ended(self) -> bytes:
        out = array("i", self.encoder.finish()).tobytes()
        self.run = self.encoder = None
        return out


class Decoder:
    """Text of tokens as they come. An unfinished character waits for its next bytes; what can't be text becomes U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.pending = tokens, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.pending + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            b = data[-back]
            if b & 0xC0 != 0x80:  # the last character begins here; does it end here?
                need = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 1
                cut = len(data) - back if need > back else len(data)
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Tokenizer:
    """A vocabulary with its lookahead and a bounded memory of short pieces."""

    def __init__(self, ranks: dict[bytes, int], sufficient: int | None = None, unlike: frozenset[str] | None = None):
        self.ranks, self.unlike = ranks, unlike_characters() if unlike is None else unlike
        self.sufficient = lookahead(ranks) if sufficient is None else sufficient
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = Pairs(ranks)
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Token ids (as int32 bytes) of pieces that aren't in the young memory; short ones are put there."""
        short, new, out = [], [], {}
        for piece in pieces:
            ids = self.old.get(piece)
            if ids is not None:
                out[piece] = ids
                continue
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = array("i", (whole,)).tobytes()
            elif len(data) <= REMEMBERED_BYTES:
                short.append(piece)
                new.append(data)
            else:
                encoder = Encoder(self.ranks, self.sufficient)
                out[piece] = array("i", (*encoder.feed(data), *encoder.finish())).tobytes()
        out.update(zip(short, merge_many(new, self.singles, self.pairs)))
        if len(self.young) + len(out) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in out.items() if len(k) <= REMEMBERED_BYTES)
        return out

    def pieces(self, text: str) -> list[str]:
        return (_FAST if self.unlike.isdisjoint(text) else _SLOW).findall(text)

    def _found(self, split: list[list[str]]) -> list[bytes]:
        found = [list(map(self.young.get, pieces)) for pieces in split]
        missing = {piece for pieces, ids in zip(split, found) if None in ids for piece, own in zip(pieces, ids) if own is None}
        if missing:
            learnt = self._learn(missing)
            found = [[own if own is not None else learnt[piece] for piece, own in zip(pieces, ids)] if None in ids else ids for pieces, ids in zip(split, found)]
        return [b"".join(ids) for ids in found]

    def tokens_of(self, pieces: list[str]) -> bytes:
        return self._found([pieces])[0] if pieces else b""

    def _streamed(self, text: str) -> bytes:
        stream = Stream(self)
        return b"".join([*(stream.feed(text[at : at + PORTION]) for at in range(0, len(text), PORTION)), stream.finish()])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; those of one portion are split at once."""
        short = [i for i, text in enumerate(texts) if len(text) <= PORTION]
        out = dict(zip(short, self._found([self.pieces(texts[i]) for i in short])))
        return [np.frombuffer(out[i] if i in out else self._streamed(text), np.int32) for i, text in enumerate(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decoded(self, ids: np.ndarray) -> Iterator[str]:
        """The text of tokens, as it becomes known."""
        decoder = Decoder(self.tokens)
        for at in range(0, len(ids), DECODED):
            yield decoder.feed(ids[at : at + DECODED].tolist())
        yield decoder.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decoded(np.asarray(ids, np.int32)))

    def decodes_to(self, ids: np.ndarray, text: str) -> bool:
        at = 0
        for part in self.decoded(ids):
            if not text.startswith(part, at):
                return False
            at += len(part)
        return at == len(text)


_made: dict[str, Tokenizer] = {}


class _Shared:
    """What workers make their tokenizer from, once a process: ranks and lookahead come from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        ranks = load_ranks(path)
        self.value, self.key = spark.sparkContext.broadcast((ranks, lookahead(ranks), unlike_characters())), uuid.uuid4().hex

    def __call__(self) -> Tokenizer:
        if self.key not in _made:
            _made.clear()
            _made[self.key] = Tokenizer(*self.value.value)
        return _made[self.key]


def _encode(make: Callable[[], Tokenizer]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            column = batch.column(1)
            _, offsets = text_bytes(column)
            for i, j in slices(offsets):
                texts = column.slice(i, j - i).to_pylist()
                ids = tokenizer.encode_many([text or "" for text in texts])
                null = np.array([text is None for text in texts])
                ok = [None if text is None else tokenizer.decodes_to(own, text) for text, own in zip(texts, ids)]
                sizes = np.array([len(own) for own in ids])
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int32(), mask=null), lists, pa.array(ok, pa.bool_())], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return run


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip): each text's tokens, and whether they decode to the text again."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(_Shared(docs.sparkSession, vocabulary)), "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean")


def decode_column(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of a column of token ids; null for null."""
    make = _Shared(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            texts = [None if ids is None else tokenizer.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, "doc_id bigint, text string")
