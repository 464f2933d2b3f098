"""Problem 9: filling containers of fixed capacity by vector best-fit.

Every item has a demand in three resources: tokens, one document slot and attention cost (the square of its tokens).
A container has a capacity in each. Items are dealt to shards by a hash, so that a shard holds about ``per_shard``
items whatever the corpus; within a shard items are placed in order of falling size into the open container that fits
under EVERY constraint and leaves the smallest weighted residual norm. The containers that a shard leaves half empty are
opened again and their items dealt to fewer shards, until one shard is left; so sharding costs a few containers in all,
not a few per shard. Only ids and sizes are shuffled, never texts.

The attention capacity is a share of C², the cost of one text that fills a container. A text that by itself costs more
is alone in its container, as it may not be split; all other containers keep to the capacity.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.runtime import Scratch

PLACED = "window_id int, doc_id long, piece int, n_tokens int, c int, shard int, bin int, open boolean"


def best_fit(sizes: np.ndarray, capacity: int, slots: int, attention: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item, and room in tokens of each container (0 if its slots are used up); sizes must not exceed the capacity.

    The choice minimises the weighted squared norm of what would be left of (tokens, slots, attention), each as a
    share of its capacity; ties go to the older container. Open containers are kept in order of their room in tokens,
    so the search starts at the tightest one and ends where the tokens alone leave more than the best found.
    """
    out = np.empty(len(sizes), np.int64)
    smallest = int(sizes.min()) if len(sizes) else 0
    w_tokens, w_slots, w_cost = weights
    rooms: list[tuple[int, int]] = []
    room: list[int] = []
    slot: list[int] = []
    cost: list[float] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        square = float(s * s)
        best, at = math.inf, -1
        for k in range(bisect_left(rooms, (s, -1)), len(rooms)):
            r, n = rooms[k]
            tokens = w_tokens * ((r - s) / capacity) ** 2
            if tokens > best:
                break
            if cost[n] < square:
                continue
            norm = tokens + w_slots * ((slot[n] - 1) / slots) ** 2 + w_cost * ((cost[n] - square) / attention) ** 2
            if norm < best or norm == best and n < rooms[at][1]:
                best, at = norm, k
        if at < 0:
            n = len(room)
            room.append(capacity)
            slot.append(slots)
            cost.append(attention)
        else:
            n = rooms.pop(at)[1]
        out[i] = n
        room[n] -= s
        slot[n] -= 1
        cost[n] -= square
        if room[n] >= smallest and slot[n] > 0 and cost[n] >= smallest * smallest:
            insort(rooms, (room[n], n))
    return out, np.array([r if k and a > 0 else 0 for r, k, a in zip(room, slot, cost, strict=True)], np.int64)


def fill_containers(sizes: DataFrame, windows: DataFrame, *, per_shard: int = 6000, tokens_per_slot: int = 16, attention_share: float = 0.9, reopen: float = 0.05) -> DataFrame:
    """Place every text, or piece of a text longer than a capacity, into a container of each capacity.

    sizes: (doc_id, n_tokens); windows: (window_id, capacity_tokens); other columns are ignored. A container of
    capacity C takes at most C tokens, max(1, C / tokens_per_slot) texts or pieces, and attention cost of
    attention_share * C², unless it holds a single text. A text longer than C is cut into full pieces, each a container
    of its own, and a rest that is packed like any text. Containers with more than a share of ``reopen`` of their tokens
    unused are packed again across shards. Texts without tokens, null sizes included, need no room: they get a null
    container. Windows with a null or non-positive capacity are ignored; repeated windows count once; repeated doc_ids
    are packed each. Returns (window_id, doc_id, piece, n_tokens, container), one row per text or piece and window.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark)
    docs = scratch.cut(sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n")))
    wins = windows.where("capacity_tokens > 0").select(F.col("window_id").cast("int").alias("window_id"), F.col("capacity_tokens").cast("int").alias("c")).distinct()
    # every text meets every capacity: that is the task, and the capacities are the stated, small set
    pairs = docs.crossJoin(wins)
    empty = pairs.where("n = 0").select("window_id", "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"))
    full = pairs.where("n >= c").select("window_id", "doc_id", "n", "c", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / F.col("c")) - 1).cast("int"))).alias("piece"))
    full = full.select("window_id", "doc_id", "piece", F.col("c").alias("n_tokens"), F.concat(F.lit("w"), "window_id", F.lit("-d"), "doc_id", F.lit("-p"), "piece").alias("container"))
    rest = pairs.where("n % c > 0").select("window_id", "doc_id", F.floor(F.col("n") / F.col("c")).cast("int").alias("piece"), (F.col("n") % F.col("c")).cast("int").alias("n_tokens"), "c")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        c = int(group["c"].iloc[0])
        bins, room = best_fit(group["n_tokens"].to_numpy(), c, max(1, c // tokens_per_slot), attention_share * c * c)
        group["bin"], group["open"] = bins.astype(np.int32), room[bins] > reopen * c
        return group[["window_id", "doc_id", "piece", "n_tokens", "c", "shard", "bin", "open"]]

    done, left, before, turn = [full, empty], rest, None, 0
    while True:
        n = docs.count() if turn == 0 else left.groupBy("window_id").count().agg(F.max("count")).first()[0] or 0
        shards = max(1, math.ceil(n / per_shard))
        if n == 0 and turn:
            break
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(shards)).cast("int"))
        placed = scratch.cut(dealt.groupBy("window_id", "shard").applyInPandas(pack, PLACED))
        named = placed.withColumn("container", F.concat(F.lit("w"), "window_id", F.lit(f"-r{turn}-s"), "shard", F.lit("-b"), "bin"))
        # the last round, or one that no longer brings the shards together, keeps what is half empty
        last = shards == 1 or before is not None and shards >= before
        done.append((named if last else named.where("NOT open")).select("window_id", "doc_id", "piece", "n_tokens", "container"))
        if last:
            break
        left, before, turn = placed.where("open").select("window_id", "doc_id", "piece", "n_tokens", "c"), shards, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fill_report(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, containers, filled, least_containers, most_tokens, most_texts): how well the containers of :func:`fill_containers` are filled.

    filled is the share of all capacity that is used, least_containers what the tokens alone would need at least.
    """
    one = placed.where("container IS NOT NULL").groupBy("window_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    cap = windows.groupBy("window_id").agg(F.max("capacity_tokens").alias("c"))
    total = one.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"), F.max("texts").alias("most_texts")).join(cap, "window_id")
    return total.select("window_id", "containers", F.round(F.col("tokens") / (F.col("containers") * F.col("c")), 4).alias("filled"), F.ceil(F.col("tokens") / F.col("c")).alias("least_containers"), "most_tokens", "most_texts")
