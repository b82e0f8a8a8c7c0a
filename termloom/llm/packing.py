"""Filling containers: variable-capacity best fit over token counts of a public tokenizer."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.runtime import checkpointed, shared_path, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items packed together by one task; a larger table is dealt into so many more shards.
ITEMS_PER_SHARD = 50_000
#: What a container costs besides its capacity, in tokens: of sizes that can be filled alike, the larger is opened.
BIN_COST = 8


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(tokenizer).encode_ordinary
    for b in batches:
        n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of the whole text; 0 for null and empty texts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_count, tokenizer=tokenizer), f"id {kind}, n_tokens long").withColumnRenamed("id", doc_id)


def _fill(room: int, rank: int, sizes: list[int], negative: list[int]) -> int:
    """How much of ``room`` the items from ``rank`` on would take, the largest that fits first; ``sizes`` descend."""
    left = room
    while left:
        rank = max(rank, bisect_left(negative, -left))
        if rank >= len(sizes) or not sizes[rank]:
            break
        left -= sizes[rank]
        rank += 1
    return room - left


def best_fit(sizes: np.ndarray, permitted: list[int], bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item (size at most the largest permitted capacity), capacities of the bins.

    Largest items first; each goes into the open bin that it leaves fullest. If none has room, a bin of the permitted
    size that costs least for each token it will hold is opened: its capacity and ``bin_cost``, over the item and what
    the items still to come would fill of its room (ties: the largest). In the end every bin shrinks to the smallest
    permitted capacity that holds its contents.
    """
    order = np.argsort(-sizes, kind="stable")
    descending = sizes[order].tolist()
    negative = [-s for s in descending]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    for rank, (item, size) in enumerate(zip(order.tolist(), descending)):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
        else:
            costs = [((c + bin_cost) / max(1, size + _fill(c - size, rank + 1, descending, negative)), -c) for c in permitted if c >= size]
            room, b = -min(costs)[1], len(used)
            used.append(0)
        bins[item], offsets[item] = b, used[b]
        used[b] += size
        room -= size
        if room:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append(b)
    return bins, offsets, [min(c for c in permitted if c >= u) for u in used]


def _placed(kind: str, label: str, ids, piece: np.ndarray, size: np.ndarray, permitted: list[int]) -> pd.DataFrame:
    bins, offsets, capacity = best_fit(size, permitted)
    room = np.array(capacity, np.int64) - np.bincount(bins, size, len(capacity)).astype(np.int64) if len(bins) else np.empty(0, np.int64)
    # The bin with most room of each size is what a shard may leave badly filled.
    loose = {max((int(r), b) for b, (r, c) in enumerate(zip(room, capacity)) if c == own)[1] for own in set(capacity)}
    return pd.DataFrame(
        {
            "container_kind": kind,
            "id": ids,
            "piece": piece.astype(np.int32),
            "piece_tokens": size,
            "bin": [f"{kind}-{label}-{b}" for b in bins],
            "bin_capacity": np.array(capacity, np.int64)[bins] if len(bins) else np.empty(0, np.int64),
            "bin_offset": offsets,
            "loose": np.isin(bins, list(loose)) if len(bins) else np.empty(0, bool),
        }
    )


def _pack(group: pd.DataFrame, capacities: list[int]) -> pd.DataFrame:
    kind, limit, shard = group["container_kind"].iloc[0], int(group["capacity"].iloc[0]), int(group["shard"].iloc[0])
    group = group.sort_values("row")
    n = group["n_tokens"].to_numpy()
    pieces = np.maximum(1, -(-n // limit))
    at = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(n[at] - piece * limit, limit)
    return _placed(kind, str(shard), group["id"].to_numpy()[at], piece, size, [c for c in capacities if c <= limit])


def _repack(group: pd.DataFrame, capacities: dict[str, list[int]]) -> pd.DataFrame:
    kind, shard = group["container_kind"].iloc[0], int(group["shard"].iloc[0])
    group = group.sort_values(["bin", "bin_offset", "piece_tokens"])
    return _placed(kind, f"loose{shard}", group["id"].to_numpy(), group["piece"].to_numpy(), group["piece_tokens"].to_numpy(), capacities[kind])


def pack(counts: DataFrame, doc_id: str, n_tokens: str, containers: DataFrame, kind: str = "container_kind", capacity: str = "capacity") -> DataFrame:
    """container_kind, doc_id, piece, piece_tokens, bin, bin_capacity, bin_offset: all items for each capacity.

    For a capacity, the permitted bin sizes are it and the smaller ones. An item is cut only if it exceeds the
    capacity: into full pieces and a rest. Empty items take part with 0 tokens; repeated rows are items of their own;
    null or non-positive capacities are no containers. Items are dealt evenly into shards by their place in the written
    table, so no id or size makes a shard hot. Of each shard the bin of each size with most room is then emptied, and
    the items of these bins of all shards are packed together, so shards leave no room of their own.
    """
    spark = counts.sparkSession
    boxes = [(r[0], r[1]) for r in containers.where(F.col(capacity) > 0).select(kind, F.col(capacity).cast("long")).distinct().orderBy(capacity, kind).collect()]
    id_kind = counts.schema[doc_id].dataType.simpleString()
    items = checkpointed(counts.select(F.col(doc_id).alias("id"), F.col(n_tokens).cast("long").alias("n_tokens"))).withColumn("row", F.monotonically_increasing_id())
    shards = max(1, -(-items.count() // ITEMS_PER_SHARD))
    wanted = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in boxes]) if boxes else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).select("*", F.inline(wanted))
    schema = f"container_kind string, id {id_kind}, piece int, piece_tokens long, bin string, bin_capacity long, bin_offset long, loose boolean"
    sizes = sorted({c for _, c in boxes})
    packed = dealt.groupBy("container_kind", "capacity", "shard").applyInPandas(partial(_pack, capacities=sizes), schema)
    if shards > 1:
        packed = written(packed, shared_path(spark, "packed"))
        loose = packed.where("loose")
        groups = max(1, -(-loose.count() // ITEMS_PER_SHARD))
        # A bin may hold many empty or tiny items; these groups are bounded as the shards are.
        gathered = loose.withColumn("shard", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        permitted = {k: [s for s in sizes if s <= c] for k, c in boxes}
        packed = packed.where("not loose").unionByName(gathered.groupBy("container_kind", "shard").applyInPandas(partial(_repack, capacities=permitted), schema))
    return packed.drop("loose").withColumnRenamed("id", doc_id)


def fill_report(packed: DataFrame) -> DataFrame:
    """container_kind, bin_capacity, bins, tokens, fill: how full the bins of each size are."""
    per = packed.groupBy("container_kind", "bin_capacity").agg(F.count_distinct("bin").alias("bins"), F.sum("piece_tokens").alias("tokens"))
    return per.withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("bin_capacity")), 4))


def kept_rules(packed: DataFrame, doc_id: str, containers: DataFrame, kind: str = "container_kind", capacity: str = "capacity") -> DataFrame:
    """container_kind, doc_id, kept: whether an item's pieces are numbered from 0, full but for the last, more than one
    only if the item exceeds the capacity, and lie in bins of permitted size whose contents neither overlap nor exceed
    it. For tables in which doc_id is unique."""
    bins = packed.groupBy("bin").agg(F.sum("piece_tokens").alias("held"), F.max(F.col("bin_offset") + F.col("piece_tokens")).alias("end"), F.max("bin_capacity").alias("size"), F.count(F.when(F.col("piece_tokens") > 0, 1)).alias("items"), F.count_distinct(F.when(F.col("piece_tokens") > 0, F.col("bin_offset"))).alias("starts"))
    good = bins.select("bin", ((F.col("held") == F.col("end")) & (F.col("held") <= F.col("size")) & (F.col("items") == F.col("starts"))).alias("good"))
    limits = containers.select(F.col(kind).alias("container_kind"), F.col(capacity).cast("long").alias("limit")).distinct()
    rows = packed.join(good, "bin").join(F.broadcast(limits), "container_kind")  # containers are a handful of kinds
    per = rows.groupBy("container_kind", doc_id).agg(
        F.min("good").alias("good"), F.count("*").alias("n"), F.count_distinct("piece").alias("numbers"), F.max("piece").alias("last"),
        F.sum("piece_tokens").alias("tokens"), F.max("limit").alias("limit"), F.sum((F.col("piece_tokens") == F.col("limit")).cast("int")).alias("full"),
    )
    whole = (F.col("n") == F.col("numbers")) & (F.col("n") == F.col("last") + 1) & (F.col("full") >= F.col("n") - 1) & ((F.col("n") == 1) | (F.col("tokens") > F.col("limit")))
    return per.select("container_kind", doc_id, (F.col("good") & whole).alias("kept"))
