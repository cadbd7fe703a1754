"""Document fingerprints: threshold-scaled sketches and the containment between very unequal documents.

A sketch keeps every hash of a document's five-word shingles below 2**64 / ``scale``. The same hashes are kept whatever
the document's length, so sketches merge by union, and the share of a short document's kept hashes that a long one also
has estimates how much of the short one is in the long one.

A document of fewer than ``least`` kept hashes has a floor as well: its smallest further hashes, up to ``least`` in all or all
that it has. Which documents have these is looked up among all their shingles, behind a bitmap of a fixed size that passes over
most others. So every document with words is searched for, by ``least`` hashes or all of its own, and no length is left out.

``contained`` finds all pairs in which one document is contained to at least ``threshold``. Of a document with n
hashes, a container at ``threshold`` must have one of any n - ceil(threshold * n) + 1 of them; the rarest in the corpus
are looked up, so passages that many documents share are looked up only by documents made of little else. Pairs found are
then compared by all the hashes of the contained one. Documents of the same words in the same order are one class, which stands
behind its smallest id; links are between different classes. ``containments`` gives one row a document.

Defined results. A null text has a null sketch, and one without words an empty one; such documents are classes of their own
without links. A document of fewer than five words has one shingle. Rows with a null id have a sketch and no row here; rows repeating
an id are one document with the union of their hashes. Of containers alike the smallest id is named. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, slices, text_bytes, written
from .words import mix, shingle_hashes, word_hashes

SCALE, SHINGLE_WORDS, THRESHOLD, LEAST = 16, 5, 0.8, 8
#: The bitmap has this many bits, whatever the data; it is made and collected in blocks of 4 KB.
MAP_BITS, BLOCK_BITS = 27, 15


def _below(scale: int) -> np.uint64:
    return np.uint64(((1 << 64) - 1) // scale)


def _distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values distinct and ascending within their rows."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), np.bool_)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], row[new]


def _list(value: np.ndarray, row: np.ndarray, rows: int, mask: pa.Array | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(value.view(np.int64)), mask=mask)


def _floor(hashes: np.ndarray, at: np.ndarray, kept: np.ndarray, limit: np.uint64, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The floors of the rows that have fewer than ``least`` ``kept`` hashes: values and rows."""
    values, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero((kept < least) & (np.diff(at) > kept)):
        own = np.unique(hashes[at[i] : at[i + 1]])
        own = own[own > limit][: least - kept[i]]
        values.append(own)
        rows.append(np.full(len(own), i))
    return np.concatenate(values), np.concatenate(rows)


def _fingerprints(scale: int, k: int, least: int):
    """(id, m1, m2, n_shingles, sketch, floor); m1 and m2 add up two hashes of every shingle."""
    limit = _below(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            null = batch.column(1).is_null()
            for i, j in slices(offsets):
                rows = j - i
                hashes, at = shingle_hashes(*word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=sums[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0x5BD1E995)), out=sums[1, 1:])
                marks = (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)
                kept = np.flatnonzero(hashes <= limit)
                value, row = _distinct(hashes[kept], np.searchsorted(at, kept, side="right") - 1)
                floor, of = _floor(hashes, at, np.bincount(row, minlength=rows), limit, least)
                mask = null.slice(i, rows) if null.slice(i, rows).true_count else None
                columns = [batch.column(0).slice(i, rows), pa.array(marks[0]), pa.array(marks[1]), pa.array(np.diff(at), pa.int64()), _list(value, row, rows, mask), _list(floor, of, rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "m1", "m2", "n_shingles", "sketch", "floor"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(text_col).alias("text"))


_SCHEMA = "id bigint, m1 bigint, m2 bigint, n_shingles bigint, sketch array<bigint>, floor array<bigint>"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n_shingles, sketch): the kept hashes of every document, distinct and in ascending unsigned order."""
    return _texts(docs, id_col, text_col).mapInArrow(_fingerprints(scale, shingle_words, 0), _SCHEMA).select("id", "n_shingles", "sketch")


def merge(table: DataFrame, *by: str) -> DataFrame:
    """(by..., sketch): the sketch of all documents of each group, made from their sketches alone."""
    return table.select(*by, F.explode("sketch").alias("h")).distinct().groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


# ---- floors among all shingles


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.bool_)


def _bitmap(hashes: DataFrame):
    """A broadcast bitmap of the leading bits of ``h``, of a fixed size of 2**MAP_BITS bits; it may say yes wrongly, never no."""

    def block(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, np.bool_)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = F.shiftrightunsigned("h", 64 - MAP_BITS)
    # a block has 2**BLOCK_BITS distinct bits at most, so its group is bounded
    blocks = hashes.select(F.shiftright(at, BLOCK_BITS).cast("int").alias("block"), at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for row in blocks.groupBy("block").applyInArrow(block, "block int, bits binary").toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _others(wanted, scale: int, k: int, least: int):
    """(id, extra): those of a row's shingles, beyond its sketch and floor, that ``wanted`` may have."""
    limit = _below(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                hashes, at = shingle_hashes(*word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)
                met = np.flatnonzero((hashes > limit) & _in(wanted.value, hashes))
                value, row = _distinct(hashes[met], np.searchsorted(at, met, side="right") - 1)
                kept = np.flatnonzero(hashes <= limit)
                _, own = _distinct(hashes[kept], np.searchsorted(at, kept, side="right") - 1)
                n = np.bincount(own, minlength=j - i)
                if (n < least).any():  # a short document's floor is in the bitmap too
                    floor, of = _floor(hashes, at, n, limit, least)
                    last = np.zeros(j - i, np.uint64)
                    np.maximum.at(last, of, floor)
                    beyond = value > last[row]
                    value, row = value[beyond], row[beyond]
                some = np.unique(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), _list(value, np.searchsorted(some, row), len(some))], names=["id", "extra"])

    return run


# ---- search


def _documents(raw: DataFrame, least: int) -> DataFrame:
    """One row an id of written ``_fingerprints``: rows that repeat an id are united."""
    again = sized(raw.groupBy("id").count().filter("count > 1").select("id"), "again")
    flip = lambda c: F.transform(c, lambda h: h.bitwiseXOR(F.lit(-(1 << 63))))
    union = lambda c: F.array_sort(flip(F.array_distinct(F.flatten(F.collect_list(c)))))
    many = raw.join(again, "id", "left_semi").dropDuplicates(["id", "m1", "m2", "n_shingles"]).groupBy("id").agg(
        F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"), F.sum("n_shingles").alias("n_shingles"), flip(union("sketch")).alias("sketch"), union("floor").alias("floor")
    )
    many = many.withColumn("floor", flip(F.slice("floor", F.lit(1), F.greatest(F.lit(least) - F.size("sketch"), F.lit(0)))))
    return raw.join(again, "id", "left_anti").unionByName(many)


def contained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, threshold: float = THRESHOLD, least: int = LEAST, shingle_words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, class_id, n_hashes), written, and (a, b, shared, n): class a is in class b by ``shared`` of its n hashes."""
    rows = _texts(docs, id_col, text_col).filter("id is not null")
    raw, _ = written(rows.mapInArrow(_fingerprints(scale, shingle_words, least), _SCHEMA), "fingerprints")
    table = _documents(raw, least)
    named = table.select("id", "m1", "m2", "n_shingles", (F.size("sketch") + F.size("floor")).alias("n_hashes"), F.when(F.col("n_shingles") > 0, F.lit(-1)).otherwise(F.col("id")).alias("alone"), F.col("sketch").isNull().alias("none"))
    keys = ["m1", "m2", "n_shingles", "alone"]
    heads = named.groupBy(*keys).agg(F.min("id").alias("class_id"))
    members, _ = written(named.join(heads, keys).select("id", "class_id", F.when(~F.col("none"), F.col("n_hashes")).alias("n_hashes")), "members")
    copies = sized(members.filter("id <> class_id").select("id"), "copies")
    single = table.filter("n_shingles > 0").select("id", "sketch", "floor").join(copies, "id", "left_anti")
    wanted = _bitmap(single.select(F.explode("floor").alias("h")))
    extra, _ = written(rows.mapInArrow(_others(wanted, scale, shingle_words, least), "id bigint, extra array<bigint>"), "extra")
    extra = extra.join(copies, "id", "left_anti")
    own = F.concat("sketch", "floor")
    kept = single.select("id", F.size(own).alias("n"), F.explode(own).alias("h")).unionByName(extra.select("id", F.lit(0).alias("n"), F.explode("extra").alias("h")))
    # counted before they are moved, so a hash of very many documents is one row a partition
    df = kept.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = kept.filter("n > 0").join(df, "h")
    # a hash that one document alone has finds nothing, but comes first in that document's order: the rarest are
    # these, and what is left of the prefix goes to the rarest of the others
    rarest = Window.partitionBy("id").orderBy("df", "h")
    need = F.ceil(F.lit(threshold) * F.col("n"))
    probes = common.withColumn("rank", F.row_number().over(rarest)).withColumn("in_common", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter(F.col("rank") <= F.col("in_common") - need + 1)
    found = probes.select("h", F.col("id").alias("a")).join(kept.select("h", F.col("id").alias("b")), "h").filter("a <> b").select("a", "b").distinct()
    placed = single.repartition("id")
    left = placed.select(F.col("id").alias("a"), own.alias("x"))
    unions = extra.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("extra"))).alias("extra"))
    right = placed.join(unions, "id", "left").select(F.col("id").alias("b"), F.concat("sketch", "floor", F.coalesce("extra", F.array().cast("array<bigint>"))).alias("y"))
    pairs = found.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size("x").alias("n"))
    return members, pairs.filter(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("n")))


def containments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(doc_id, class_id, n_hashes, n_containers, n_contained, container_id, containment) of every id.

    ``n_containers`` is the number of other classes that have at least ``threshold`` of the document's, ``n_contained`` that of those
    that are so in it; ``container_id`` is the container with the largest ``containment``.
    """
    members, pairs = contained(docs, id_col, text_col, scale, threshold, least)
    best = F.struct("shared", (-F.col("b")).alias("b"), "n")
    none = F.lit(None).cast("struct<shared:int,b:bigint,n:int>")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("class_id"), F.lit(1).alias("into"), F.lit(0).alias("of"), best.alias("best")), F.struct(F.col("b").alias("class_id"), F.lit(0).alias("into"), F.lit(1).alias("of"), none.alias("best"))
    )).alias("s")).select("s.*")
    links = sides.groupBy("class_id").agg(F.sum("into").alias("n_containers"), F.sum("of").alias("n_contained"), F.max("best").alias("best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return members.join(links, "class_id", "left").select(
        F.col("id").alias("doc_id"), "class_id", "n_hashes", zero("n_containers"), zero("n_contained"), (-F.col("best.b")).alias("container_id"), (F.col("best.shared") / F.col("best.n")).alias("containment")
    )
