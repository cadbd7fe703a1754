"""Near-duplicate search: b-bit MinHash signatures joined by a multi-index Hamming join.

A signature has 48 symbols of 8 bits, one for each of 48 hash functions over a document's set of word pairs. It is
split into 8 chunks of 6 symbols, each kept in one BIGINT. Two signatures that differ in at most 15 symbols differ in
at most one symbol of some chunk (8 chunks of two errors would be 16). So every such pair shares a whole chunk, or else a key made of a
chunk with one symbol left out, and differs in that symbol. Each signature emits its 8 chunks and its 48 keys. Those that can make a pair
are brought together, and all rows of one are compared with each other in numpy. A pair counts only under the first chunk, or else
the first key, that it shares. No pair within the distance is missed, and none is found through a cap or a sample.

Equal signatures are first folded into one representative (the smallest id), so a group of identical copies costs its
size and not its square. ``near_duplicates`` gives one row a document: its group and the number of its links, which are
counted between signatures and weighed by how many documents stand behind them. Near copies that all differ are compared pair by pair,
but what leaves a key is a row for each of its signatures (the smallest id it is connected to there, and its links), never a row a pair.

Defined results: a document whose text is null, empty or without any letter or digit has no signature, is nobody's
duplicate and is a group of its own. Rows with a null id are left out. Rows repeating an id are one document: it has the
links of all its texts, each text counts as a document behind its representative, and an id is never paired with itself.
Ties between possible representatives go to the smallest id. An empty table gives no rows.
Further columns of any name are ignored by the search and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, sized, slices, text_bytes, written
from .words import shingle_hashes, word_hashes

CHUNKS, WIDTH, BITS = 8, 6, 8
SYMBOLS = CHUNKS * WIDTH
#: Symbols in which a near copy may differ: the most for which one error a chunk is sure to suffice.
MAX_DISTANCE = 2 * CHUNKS - 1
SHINGLE_WORDS = 2
#: Pairs under keys of at most so many rows are listed and compared, so many at a time; under larger keys, rows against rows in blocks of so many pairs.
LISTED_ROWS, LISTED_PAIRS, BLOCK_PAIRS = 64, 1 << 16, 1 << 19
_ONES = int.from_bytes(b"\x01" * WIDTH, "little")
_rng = np.random.default_rng(20240611)
_FLIP = _rng.integers(0, 1 << 32, SYMBOLS, np.uint32)
_ODD = _rng.integers(0, 1 << 31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)
_COLUMNS = [f"s{c}" for c in range(CHUNKS)]


def signatures(raw: np.ndarray, offsets: np.ndarray, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows x chunks, int64) of some rows of text, and which rows have one."""
    words, first = word_hashes(raw, offsets)
    hashes, at = shingle_hashes(words, first, shingle_words)
    has = np.diff(at) > 0
    out = np.zeros((len(has), CHUNKS), np.int64)
    if has.any():
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        begin = at[:-1][has]
        low = np.empty((SYMBOLS, len(begin)), np.uint32)
        v = np.empty_like(h)
        for k in range(SYMBOLS):
            np.bitwise_xor(h, _FLIP[k], out=v)
            np.multiply(v, _ODD[k], out=v)
            low[k] = np.minimum.reduceat(v, begin)
        symbols = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        for c in range(CHUNKS):
            for p in range(WIDTH):
                out[has, c] |= symbols[c * WIDTH + p] << (BITS * p)
    return out, has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        parts = [signatures(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
        if parts:
            sig, has = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has)), *(pa.array(sig[has, c]) for c in range(CHUNKS))], names=["id", *_COLUMNS])


def signature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0..s7): the signature of every document that has words."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(text_col).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(_sign, "id bigint, " + ", ".join(f"{c} bigint" for c in _COLUMNS))


def _chunk_keys() -> list[Column]:
    """The whole chunks; a key's number goes into the two bytes that its chunk leaves free, so a key is one BIGINT."""
    return [F.struct(F.col(_COLUMNS[c]).bitwiseOR(F.lit(c << (BITS * WIDTH))).alias("key"), F.lit(0).alias("symbol")) for c in range(CHUNKS)]


def _keys() -> list[Column]:
    """The chunks with one symbol left out, and that symbol; they are numbered behind the whole chunks."""
    keys = []
    for at in range(SYMBOLS):
        c, p = divmod(at, WIDTH)
        rest = F.col(_COLUMNS[c]).bitwiseAND(F.lit(~(((1 << BITS) - 1) << (BITS * p)) & ((1 << (BITS * WIDTH)) - 1)))
        symbol = F.shiftright(_COLUMNS[c], BITS * p).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        keys.append(F.struct(rest.bitwiseOR(F.lit((CHUNKS + at) << (BITS * WIDTH))).alias("key"), symbol.alias("symbol")))
    return keys


def _buckets(rows: DataFrame, max_distance: int) -> DataFrame:
    """(key, h, id, n, s0..s7): rows of (h, id, n, s0..s7) under each key that can make a pair, a key's rows together and by id."""
    keys = _chunk_keys() + (_keys() if max_distance >= CHUNKS else [])  # below that some chunk is whole
    keyed = rows.select("h", F.explode(F.array(*keys)).alias("k")).select("h", "k.key", "k.symbol")
    # counted where they are filtered: a second, joined side would make and move all keys again
    own = Window.partitionBy("key")
    keyed = keyed.select("h", "key", F.count(F.lit(1)).over(own).alias("met"), F.min("symbol").over(own).alias("low"), F.max("symbol").over(own).alias("high"))
    shared = keyed.filter((F.col("low") < F.col("high")) | ((F.col("met") > 1) & (F.col("key") < F.lit(CHUNKS << (BITS * WIDTH)))))
    met = shared.select("h", "key").join(rows, "h")
    return met.select("key", "h", "id", "n", *_COLUMNS).repartition("key").sortWithinPartitions("key", "id")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their first column again, no key in two parts."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and last != key[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _pairs_listed(number: np.ndarray, end: np.ndarray, words: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i < j and their distance, of ``rows`` and those behind them up to ``end``, compared one by one."""
    partners = end[rows] - rows - 1
    for u, v in slices(np.concatenate([np.zeros(1, np.int64), np.cumsum(partners)]), LISTED_PAIRS):
        n = partners[u:v]
        i = np.repeat(rows[u:v], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        x = words[i] ^ words[j]
        for bits in (4, 2, 1):
            x |= x >> np.uint64(bits)
        wrong = np.bitwise_count(x & np.uint64(_ONES))
        distance = wrong.sum(1)
        own = number[i]
        whole = own < CHUNKS
        at = np.where(whole, own, (own - CHUNKS) // WIDTH)
        first = distance <= most
        for c in range(CHUNKS):
            first &= np.where(whole, (c >= at) | (wrong[:, c] > 0), wrong[:, c] > (c < at))
        yield i[first], j[first], distance[first]


def _pairs_in_blocks(number: int, symbols: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows of one key (symbols x rows): where the run begins, which rows from there on are its pairs, and the distances."""
    m = symbols.shape[1]
    step = max(1, BLOCK_PAIRS // m)
    at = number if number < CHUNKS else (number - CHUNKS) // WIDTH
    for s in range(0, m, step):
        left, right = symbols[:, s : s + step, None], symbols[:, None, s:]
        distance = np.zeros((left.shape[1], m - s), np.uint8)
        first = np.ones(distance.shape, np.bool_)
        for c in range(CHUNKS):
            wrong = np.zeros(distance.shape, np.uint8)
            for k in range(c * WIDTH, (c + 1) * WIDTH):
                wrong += (left[k] != right[k]).view(np.uint8)
            distance += wrong
            if number >= CHUNKS:
                first &= wrong > (c < at)
            elif c < at:
                first &= wrong > 0
        first &= distance <= most
        b = left.shape[1]
        first[:, :b] = np.triu(first[:, :b], 1)
        yield s, first, distance


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the lowest row of a component, after the pairs (i, j) are joined."""
    while len(i):
        old, low = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, old):
            break
    return label


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's key number, the end of its key's rows, id, documents and signature."""
    key, ids, n = (table.column(k).to_numpy() for k in ("key", "id", "n"))
    begin = np.flatnonzero(np.concatenate([np.ones(1, np.bool_), key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    words = np.ascontiguousarray(np.column_stack([table.column(c).to_numpy() for c in _COLUMNS])).view(np.uint64)
    return key >> (BITS * WIDTH), np.repeat(begin + size, size), ids, n, words


def _large(number: np.ndarray, end: np.ndarray, words: np.ndarray, listed: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Beginning, end, number and symbols of the keys of more than ``listed`` rows."""
    begin = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(end[1:] != end[:-1]) + 1])
    for s in begin[end[begin] - begin > listed]:
        e = int(end[s])
        symbols = words[s:e].view(np.uint8).reshape(e - s, CHUNKS, 8)[:, :, :WIDTH].reshape(e - s, SYMBOLS)
        yield int(s), e, int(number[s]), np.ascontiguousarray(symbols.T)


def _few(end: np.ndarray, listed: int) -> np.ndarray:
    """The rows of keys of at most ``listed`` rows."""
    _, at, size = np.unique(end, return_inverse=True, return_counts=True)
    return np.flatnonzero(size[at] <= listed)


def pairs_met(table: pa.Table, most: int, listed: int = 0) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) with a < b: pairs of different ids that meet first under one of these whole keys."""
    number, end, ids, _, words = _columns(table)
    listed = listed or LISTED_ROWS
    found = list(_pairs_listed(number, end, words, _few(end, listed), most))
    for s, _, own, symbols in _large(number, end, words, listed):
        for t, first, distance in _pairs_in_blocks(own, symbols, most):
            i, j = np.nonzero(first)
            found.append((i + s + t, j + s + t, distance[first]))
    for i, j, distance in found:
        a, b = ids[i], ids[j]
        other = a != b
        yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (np.minimum(a, b), np.maximum(a, b), distance.astype(np.int32))], names=["a", "b", "distance"])


def links_met(table: pa.Table, most: int, listed: int = 0) -> pa.RecordBatch:
    """(h, id, root, links) of the rows that are in such a pair: the smallest id that they are connected to within the key, and the documents behind their partners."""
    number, end, ids, n, words = _columns(table)
    listed = listed or LISTED_ROWS
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j, _ in _pairs_listed(number, end, words, _few(end, listed), most):
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        label = _joined(label, i, j)
    for s, e, own, symbols in _large(number, end, words, listed):
        for t, first, _ in _pairs_in_blocks(own, symbols, most):
            t += s
            b = len(first)
            first &= ids[t : t + b, None] != ids[None, t:e]
            if not first.any():
                continue
            weights = first.astype(np.float64)  # sums below 2^53 are exact
            links[t : t + b] += (weights @ n[t:e].astype(np.float64)).astype(np.int64)
            links[t:e] += (n[t : t + b].astype(np.float64) @ weights).astype(np.int64)
            for r in np.flatnonzero(first.any(1)):
                around = label[t:e][first[r]]
                if (around != label[t + r]).any():
                    roots = np.unique(np.append(around, label[t + r]))
                    own_labels = label[s:e]
                    own_labels[np.isin(own_labels, roots)] = roots[0]
    paired = links > 0
    return pa.RecordBatch.from_arrays([table.column("h").combine_chunks().filter(pa.array(paired)), pa.array(ids[paired]), pa.array(ids[label[paired]]), pa.array(links[paired])], names=["h", "id", "root", "links"])


def _pairs(rows: DataFrame, max_distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            yield from pairs_met(table, max_distance)

    return _buckets(rows, max_distance).mapInArrow(run, "a bigint, b bigint, distance int")


def _links(rows: DataFrame, max_distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            yield links_met(table, max_distance)

    return _buckets(rows, max_distance).mapInArrow(run, "h bigint, id bigint, root bigint, links bigint")


def distinct_pairs(sigs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b, distance) with a < b: all pairs of rows of (id, s0..s7) within the distance."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the key scheme guarantees distances of 0 to {MAX_DISTANCE}")
    rows, _ = written(sigs.select(F.monotonically_increasing_id().alias("h"), "id", F.lit(1).cast("bigint").alias("n"), *_COLUMNS), "rows")
    return _pairs(rows, max_distance)


def _folded(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """(id, h, head, n) of every signature of an id, and (h, id, n, s0..s7) of every signature: its number, its smallest id, its documents; both written."""
    sigs, path = written(signature_table(docs, id_col, text_col).distinct(), "signatures")
    heads = sigs.groupBy(*_COLUMNS).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    heads, heads_path = written(heads.select(F.monotonically_increasing_id().alias("h"), "id", "n", *_COLUMNS), "heads")
    member, _ = written(sigs.join(heads.withColumnRenamed("id", "head"), _COLUMNS).select("id", "h", "head", "n"), "members")
    drop_path(docs.sparkSession, path)
    return member, heads, heads_path


def _copies(member: DataFrame) -> DataFrame:
    return member.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))


def _linked(docs: DataFrame, id_col: str, text_col: str, max_distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, h, head, n) of every signature of an id, (h, links) of those near others, and edges (a, b) that connect what is near; rows in proportion to the documents."""
    member, heads, path = _folded(docs, id_col, text_col)
    found, _ = written(_links(heads, max_distance), "links")
    drop_path(docs.sparkSession, path)
    edges = found.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    return member, found.groupBy("h").agg(F.sum("links").alias("links")), edges.unionByName(_copies(member))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b, distance) with a < b: all near-duplicate pairs.

    Documents with equal signatures stand behind the smallest id among them: they have one row each, to that id, with
    distance 0, and the other rows are between such representatives. All pairs follow from these rows, as many as there are.
    """
    member, heads, path = _folded(docs, id_col, text_col)
    near, _ = written(_pairs(heads, max_distance), "pairs")
    drop_path(docs.sparkSession, path)
    # an id of several texts may head several signatures: the smallest distance counts
    return near.unionByName(_copies(member).withColumn("distance", F.lit(0))).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id in each connected component of edges (a, b).

    Every round gives a node the smallest label around it and then that label's own label, until nothing changes; each
    round's labels are a written table.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct()
    labels, old = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("label")), "labels")
    while True:
        around = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("label").alias("near"))
        best = labels.join(around, labels.id == around.x).select("id", "label", F.least("label", "near").alias("best"))
        up = labels.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        step = best.join(up, best.best == up.up_id).select("id", F.least("best", "up").alias("label"), (F.least("best", "up") != F.col("label")).alias("moved"))
        step, path = written(step, "labels")
        moved = step.filter("moved").limit(1).count()
        labels = step.select("id", "label")
        drop_path(spark, old)
        old = path
        if not moved:
            return labels.select("id", F.col("label").alias("group_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id, n_links) of every id: the smallest id of its group, and how many other documents are within the distance."""
    member, links, edges = _linked(docs, id_col, text_col, max_distance)
    groups = components(edges)
    own = member.join(links, "h", "left").groupBy("id").agg(F.sum(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).filter("id is not null").distinct()
    out = ids.join(own, "id", "left").join(groups, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _one_of_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one of the rows that repeat both id and text (the one whose row hashes lowest), a null id being like another."""
    row = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null"))
    one, two = F.xxhash64(row, text_col), F.xxhash64(F.lit(1), text_col, row)
    keyed = docs.filter(F.col(text_col).isNotNull()).select(one.alias("_lodestone_one"), two.alias("_lodestone_two"))
    again = sized(keyed.groupBy("_lodestone_one", "_lodestone_two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "again")
    named = docs.withColumns({"_lodestone_one": one, "_lodestone_two": two})
    keys = ["_lodestone_one", "_lodestone_two"]
    # only the rows that repeat are moved
    first = named.join(again, keys, "left_semi").withColumn("_lodestone_at", F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))))
    order = Window.partitionBy(*keys).orderBy("_lodestone_at")
    first = first.withColumn("_lodestone_at", F.row_number().over(order)).filter("_lodestone_at = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.join(again, keys, "left_anti").select(*columns).union(first.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` without the near copies: of each group the row of the smallest id stays, with all its columns.

    Of rows that repeat both id and text one stays, also where the id is null. Other rows with a null id, and rows with a null text, stay.
    Of rows that repeat an id with several texts all stay or all go.
    """
    _, _, edges = _linked(docs, id_col, text_col, max_distance)
    groups = components(edges)
    side = sized(groups.filter("id <> group_id").select(F.col("id").alias("_lodestone_copy")), "copies")
    return _one_of_repeats(docs, id_col, text_col).join(side, F.col(id_col).cast("bigint") == side["_lodestone_copy"], "left_anti")
