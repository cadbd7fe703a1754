"""Best-fit packing of documents into training sequences by minimum bin slack.

For each bin a subset-sum over the lengths still there finds the fullest combination that fits: a Python integer is the
bitset of reachable sums, a length is added by shifting it, and the walk stops once the capacity itself is reachable.
Lengths are added from the longest down and taken back preferring the longer ones. The combination is taken out and the
next bin is filled.

A length is the number of words between white space, plus one for the separator that ends a document. Documents longer
than a bin are cut: their full pieces are bins of their own and the rest is packed. Packing goes on within groups of
about ``group_docs`` documents, split by a hash of a row's place in the table of lengths, so that it needs no order over the whole
corpus and no id, length or text makes a group larger; each group is a task of its own, and what it wastes is less than its last
few bins. The place is that of the rows as they are read, so other files of the same rows may give other groups.

Defined results. A null or empty text has length 1. Rows repeating an id are packed as rows of their own. Rows with a
null id are packed too. Equal lengths go by id. An empty table gives no bins. Further columns are ignored.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_partitions, written

CAPACITY = 2048
GROUP_DOCS = 32768
SCHEMA = "bin_id bigint, slot int, doc_id bigint, piece int, start bigint, length int, bin_fill int"


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination with the largest sum up to ``capacity``; ``lengths`` descend."""
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    goal = 1 << capacity
    for length in lengths:
        left = min(counts[length], capacity // length)
        n = 1
        while left > 0:
            n = min(n, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & full
            if reach & goal:
                break
            left -= n
            n *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for before, length, n in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + n
            total -= length * n
    return sorted(taken.items(), reverse=True)


def pack_lengths(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes`` (each 1 to ``capacity``), in the order in which they are filled."""
    pool: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        pool.setdefault(size, []).append(i)
    for own in pool.values():
        own.reverse()
    counts = {length: len(own) for length, own in pool.items()}
    lengths = sorted(pool, reverse=True)
    bins = []
    while lengths:
        chosen = []
        for length, n in fullest(counts, lengths, capacity):
            chosen += [pool[length].pop() for _ in range(n)]
            counts[length] -= n
        lengths = [x for x in lengths if counts[x]]
        bins.append(chosen)
    return bins


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "id"], ascending=[False, True], kind="stable", na_position="first")
    group = int(pdf["part"].iloc[0])
    pieces = []
    whole = []
    for key, length in zip(pdf["id"].astype(object).where(pdf["id"].notna(), None), pdf["length"]):
        cut, length = 0, int(length)
        while length - cut * capacity > capacity:
            whole.append((key, cut, cut * capacity, capacity))
            cut += 1
        pieces.append((key, cut, cut * capacity, length - cut * capacity))
    rows = []
    for bin_no, members in enumerate([[x] for x in whole] + [[pieces[i] for i in own] for own in pack_lengths([p[3] for p in pieces], capacity)]):
        fill = sum(m[3] for m in members)
        rows += [((group << 32) + bin_no, slot, *m, fill) for slot, m in enumerate(members)]
    return pd.DataFrame(rows, columns=["bin_id", "slot", "doc_id", "piece", "start", "length", "bin_fill"]).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(bin_id, slot, doc_id, piece, start, length, bin_fill): every piece of every document in a bin of ``capacity`` words."""
    length = (F.coalesce(F.regexp_count(text_col, F.lit(r"\S+")), F.lit(0)) + 1).cast("bigint")
    sizes, _ = written(docs.select(F.col(id_col).cast("bigint").alias("id"), length.alias("length"), F.monotonically_increasing_id().alias("place")), "lengths")
    groups = max(1, -(-sizes.count() // group_docs))
    parted = sizes.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int"))
    # partition i is group i: groups neither share a task nor are coalesced into one
    return parted.repartitionById(groups, "part").select("id", "length", "part").mapInPandas(whole_partitions(functools.partial(_pack_group, capacity=capacity)), SCHEMA)
