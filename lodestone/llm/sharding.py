"""Sharding by Karmarkar-Karp differencing: whole groups of documents go to shards of nearly equal bytes.

A partial partition is a tuple of k sums. The two partial partitions with the largest spread are combined, the largest
sum of one with the smallest of the other, until one is left. That needs all of them in one heap. Up to ``fan_in`` groups
are differenced so; of more, the ``fan_in`` largest are first, and the rest are dealt by hash into nodes of about ``fan_in``.
Each node differences its groups together with its share of the largest groups' sums, as one more partial partition, and
so levels its part of what they left uneven. A node's state is bounded by ``fan_in``, at any size.

Defined results. Groups are documents with one key; by default the key is a hash of the whole text, so identical copies
share a shard. A null text has 0 bytes, and all null texts are one group. Ties in spread go to the lower member id. Rows
repeating an id are rows of their own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_partitions, written

SHARDS = 64
FAN_IN = 8192


def difference(sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The k sums after differencing the given partial partitions, and for each of these the final slot of its own slots."""
    n, k = len(sums), len(sums[0])
    nodes = [np.asarray(s, np.int64) for s in sums]
    joined: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    heap = [(int(s.min()) - int(s.max()), i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        down, up = np.argsort(-nodes[a], kind="stable"), np.argsort(nodes[b], kind="stable")
        total = nodes[a][down] + nodes[b][up]
        joined.append((a, down, b, up))
        nodes.append(total)
        nodes[a] = nodes[b] = None
        heapq.heappush(heap, (int(total.min()) - int(total.max()), len(nodes) - 1))
    top = heap[0][1]
    where: dict[int, np.ndarray] = {top: np.arange(k)}
    for i in range(len(joined) - 1, -1, -1):
        own = where.pop(n + i)
        a, down, b, up = joined[i]
        for child, order in ((a, down), (b, up)):
            slots = np.empty(k, np.int64)
            slots[order] = own
            where[child] = slots
    return nodes[top], [where[i] for i in range(n)]


SCHEMA = "id bigint, shard int, sums array<bigint>"


def _node(shards: int, carried: list[int] | None):
    """Differences a node's groups; what is ``carried`` keeps its slots, and without it a row of the sums comes along."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        members = np.zeros((len(pdf), shards), np.int64)
        members[:, 0] = pdf["size"]
        first = [] if carried is None else [np.array(carried, np.int64)]
        sums, slots = difference([*first, *members])
        named = np.arange(shards)
        if first:  # final slot -> the slot of what was carried that ended there
            named = np.argsort(slots[0])
            slots = slots[1:]
        out = pd.DataFrame({"id": pdf["id"].to_numpy(), "shard": [int(named[s[0]]) for s in slots], "sums": None}).astype({"id": "Int64", "shard": "Int32"})
        if carried is None:
            out = pd.concat([out, pd.DataFrame({"id": [None], "shard": [None], "sums": [sums.tolist()]}).astype({"id": "Int64", "shard": "Int32"})])
        return out

    return combine


def assign(groups: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, shard) for groups (id, size) with distinct ids."""
    count = groups.count()
    large = groups if count <= fan_in else groups.orderBy(F.desc("size"), "id").limit(fan_in)
    done, _ = written(large.select("id", "size").repartition(1).mapInPandas(whole_partitions(_node(shards, None)), SCHEMA), "large")
    out = done.filter("id is not null").select("id", "shard")
    if count <= fan_in:
        return out
    sums = done.filter("id is null").first()["sums"]
    least = out.join(groups, "id").agg(F.max_by(F.struct("size", "id"), F.struct(-F.col("size"), F.col("id"))).alias("m")).select("m.*").first()
    rest = groups.filter((F.col("size") < least["size"]) | ((F.col("size") == least["size"]) & (F.col("id") > least["id"])))
    nodes = -(-(count - fan_in) // fan_in)
    share = [s // nodes for s in sums]
    dealt = rest.withColumn("node", F.pmod(F.xxhash64("id"), F.lit(nodes)).cast("int"))
    return out.unionByName(dealt.repartitionById(nodes, "node").mapInPandas(whole_partitions(_node(shards, share)), SCHEMA).select("id", "shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, group_key, n_bytes, shard): each document's shard; documents of one key are never parted."""
    key = F.xxhash64(text_col) if key is None else key
    rows, _ = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.cast("bigint").alias("group_key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")), "sizes")
    rows = rows.withColumn("id", F.coalesce("group_key", F.lit(0)))
    groups, _ = written(rows.groupBy("id").agg(F.sum("n_bytes").alias("size")), "groups")
    return rows.join(assign(groups, shards, fan_in), "id").select("doc_id", "group_key", "n_bytes", "shard")
