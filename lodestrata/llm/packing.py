"""Containers of fixed capacity filled with documents, none of them divided unless it is too long.

Linear grouping: the large lengths are rounded up to the greatest of their group,
groups of equal size being cut from the sorted lengths. For so few lengths the
best mix of container layouts is a small linear programme (column generation).
Documents take the places of the layouts by their rank, then the small documents
are put where they leave the least room. The driver sees the histogram of lengths
(at most as many rows as the capacity) and the layouts, never the documents.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.session import materialize, ship, spread

#: Folder of the public tokenizers and the vocabulary that lengths are measured in.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Groups of large lengths, and the part of the capacity up to which a document is small.
GROUPS, SMALL = 64, 1 / 12
#: Documents and containers that one task fills at most, on average.
SHARD_ROWS = 40_000
#: Parts that the documents of one length are ranked in.
RANK_PARTS = 64


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, tokens): the whole text's length in tokens; 0 for null and empty texts. The vocabulary file ``path`` goes to the workers."""
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(os.path.basename(path))).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=[key, "tokens"])

    return spread(df.select(key, text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, tokens INT")


def group_lengths(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """(rounded length, documents) of each group, longest first; groups hold equally many but for the last."""
    order = np.argsort(-lengths)
    lengths, counts = lengths[order], counts[order].copy()
    size = max(1, -(-int(counts.sum()) // groups))
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(lengths):
        top, need = int(lengths[i]), size
        while i < len(lengths) and need:
            taken = min(need, int(counts[i]))
            counts[i] -= taken
            need -= taken
            i += not counts[i]
        out.append((top, size - need))
    return out


def layouts(groups: list[tuple[int, int]], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(containers, places for each group) so that every document has a place, in close to the fewest containers."""
    sizes, wanted = np.array([s for s, _ in groups]), np.array([n for _, n in groups], float)
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[g] * (capacity // int(sizes[g])) for g in range(k)]
    basis = list(range(k))
    inverse = np.linalg.inv(np.array([columns[b] for b in basis], float).T)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        column, worth = _best_layout(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        direction, level = inverse @ column, inverse @ wanted
        ratios = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        columns.append(column)
        basis[leaving] = len(columns) - 1
        inverse = np.linalg.inv(np.array([columns[b] for b in basis], float).T)
    amounts = inverse @ wanted
    chosen = [(int(np.floor(x + 1e-9)), columns[b].tolist()) for b, x in zip(basis, amounts, strict=True) if x >= 1 - 1e-9]
    left = wanted.astype(int) - sum((n * np.array(c) for n, c in chosen), np.zeros(k, int))
    return chosen + [(1, c) for c in _first_fit(sizes, left, capacity)]


def _best_layout(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The layout worth most at the given prices: a knapsack over the capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist(), strict=True)):
        if price <= 0:
            continue
        for _ in range(capacity // size):  # one more document of the group each time
            with_it = value[:-size] + price
            better = np.flatnonzero(with_it > value[size:] + 1e-12)
            if not len(better):
                break
            value[size + better] = with_it[better]
            last[size + better] = g
    column, c = np.zeros(len(sizes), int), int(value.argmax())
    worth = float(value[c])
    while last[c] >= 0:
        column[last[c]] += 1
        c -= int(sizes[last[c]])
    return column, worth


def _first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[list[int]]:
    """Layouts for the few documents that whole layouts leave over, longest first."""
    open_: list[tuple[int, list[int]]] = []
    for g in np.argsort(-sizes):
        for _ in range(max(0, int(left[g]))):
            at = next((i for i, (room, _) in enumerate(open_) if room >= sizes[g]), None)
            if at is None:
                open_.append((capacity, [0] * len(sizes)))
                at = len(open_) - 1
            room, places = open_[at]
            places[g] += 1
            open_[at] = (room - int(sizes[g]), places)
    return [places for _, places in open_]


def pack(sizes: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """(key, piece, container, tokens): every document's container, of its pieces where it exceeds the capacity.

    A document longer than the capacity fills containers of its own and its rest
    is packed like a document. Documents without tokens are packed too. Keys must
    be unique; an empty table gives an empty result.
    """
    spark = sizes.sparkSession
    own = sizes.select(F.col(key), F.coalesce(F.col(tokens).cast("int"), F.lit(0)).alias("n"))
    whole, rest = F.floor(F.col("n") / capacity).cast("int"), F.col("n") % capacity
    full = own.where(whole > 0).select(key, F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select(key, "piece", F.concat_ws("-", F.lit("f"), F.col(key).cast("string"), F.col("piece").cast("string")).alias("container"), F.lit(capacity).alias("tokens"))
    items = own.where((rest > 0) | (whole == 0)).select(key, whole.alias("piece"), rest.cast("int").alias("tokens"))
    least = int(capacity * SMALL) + 1
    histogram = items.groupBy("tokens").count().toPandas()  # at most as many rows as the capacity
    large = histogram[histogram["tokens"] >= least].sort_values("tokens", ascending=False)
    small = items.where(F.col("tokens") < least)
    n_small = int(histogram["count"].sum() - large["count"].sum())
    placed, bins = _place_large(items.where(F.col("tokens") >= least), large, key, capacity)
    if n_small == 0:
        return full if placed is None else full.unionByName(placed)
    filled = _fill_small(small, placed, key, capacity, max(1, -(-(n_small + bins) // SHARD_ROWS)))
    return full.unionByName(filled) if placed is None else full.unionByName(placed).unionByName(filled)


def _place_large(items: DataFrame, large: pd.DataFrame, key: str, capacity: int) -> tuple[DataFrame | None, int]:
    if large.empty:
        return None, 0
    spark = items.sparkSession
    groups = group_lengths(large["tokens"].to_numpy(), large["count"].to_numpy(), GROUPS)
    places, bins, taken = [], 0, [0] * len(groups)
    for count, layout in layouts(groups, capacity):
        for g, n in enumerate(layout):
            if n:
                places.append((g, taken[g], taken[g] + n * count, bins, n))
                taken[g] += n * count
        bins += count
    first = np.concatenate([[0], np.cumsum(large["count"].to_numpy())])[:-1]
    # rank among all large documents, longest first: place of the length, of the part, and in the part
    positions = spark.createDataFrame([(int(t), int(f)) for t, f in zip(large["tokens"], first, strict=True)], "tokens INT, first BIGINT")
    parted = items.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string"), "piece"), F.lit(RANK_PARTS)))
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("tokens", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("tokens", "part").orderBy(key)) - 1
    ranked = parted.withColumn("within", within).join(offsets, ["tokens", "part"]).join(F.broadcast(positions), "tokens")
    ranked = ranked.withColumn("rank", F.col("first") + F.col("offset") + F.col("within"))
    equal = groups[0][1]  # every group but the last holds so many
    ranked = ranked.withColumns({"group": F.floor(F.col("rank") / equal).cast("int"), "at": F.col("rank") % equal})
    table = spark.createDataFrame([tuple(map(int, p)) for p in places], "place_group INT, low BIGINT, high BIGINT, bin BIGINT, n INT")
    fits = (F.col("group") == F.col("place_group")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    container = F.concat(F.lit("c-"), (F.col("bin") + F.floor((F.col("at") - F.col("low")) / F.col("n"))).cast("string"))
    placed = ranked.join(F.broadcast(table), fits).select(key, "piece", container.alias("container"), "tokens")
    return materialize(placed, "placed"), bins


def _fill_small(small: DataFrame, placed: DataFrame | None, key: str, capacity: int, shards: int) -> DataFrame:
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    kind = small.schema[key].dataType.simpleString()
    rows = small.select(shard(F.concat_ws("-", F.col(key).cast("string"), "piece")).alias("shard"), key, "piece", "tokens", F.lit(None).cast("string").alias("container"))
    if placed is not None:
        room = placed.groupBy("container").agg((capacity - F.sum("tokens")).cast("int").alias("tokens")).where(F.col("tokens") > 0)
        rows = rows.unionByName(room.select(shard(F.col("container")).alias("shard"), F.lit(None).cast(kind).alias(key), F.lit(None).cast("int").alias("piece"), "tokens", "container"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        bins, todo = group[group["container"].notna()], group[group["container"].isna()].sort_values(["tokens", key, "piece"], ascending=[False, True, True])
        number, out, opened = int(group["shard"].iloc[0]), [], 0
        rooms = sorted(zip(bins["tokens"].astype(int), bins["container"], strict=True))
        for n in todo["tokens"].astype(int):
            at = bisect_left(rooms, (n, ""))  # the least room that is enough
            if at == len(rooms):
                room, name = capacity, f"s-{number}-{opened}"
                opened += 1
            else:
                room, name = rooms.pop(at)
            out.append(name)
            if room > n:
                insort(rooms, (room - n, name))
        return pd.DataFrame({key: todo[key].to_numpy(), "piece": todo["piece"].to_numpy(), "container": out, "tokens": todo["tokens"].to_numpy()})

    return rows.groupBy("shard").applyInPandas(fill, f"{key} {kind}, piece INT, container STRING, tokens INT")
