"""Filling containers of fixed capacity with items of varying length, by sum-of-squares packing.

An item goes where the sum, over all residual gaps, of the squared number of
open containers with that gap becomes smallest. Items are dealt to shards by a
hash of their key; a shard is packed on its own, so the work scales with the
number of shards and the loss is at most the open containers of each shard.
Items above the capacity are cut into full containers and a rest.

Defined results: items of size 0 or null (empty texts) need no space and are
put into no container (container null, size 0); ties go to the largest gap
filled, then to an existing container; rows repeated by delivery count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialized, spread, table
from .tokens import count_tokens

#: Items a shard is to hold; shards grow in number, not in size.
SHARD_ITEMS = 25_000
#: Budgets at most, as each multiplies the items.
BUDGETS = 64


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0 < size <= capacity), in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; a gap of 0 isn't open
    stacks: dict[int, list[int]] = {}
    gaps = np.empty(0, np.int64)  # gaps with open containers, in order
    out, made = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # moving a container from gap g to g - s changes the sum by 2 (N[g-s] - N[g] + 1), or by 1 - 2 N[g] if it gets full
        fits = gaps[np.searchsorted(gaps, s) :]
        best, at = (2 * count[capacity - s] + 1 if s < capacity else 0), capacity
        if len(fits):
            to = fits - s
            change = np.where(to > 0, 2 * (count[to] - count[fits] + 1), 1 - 2 * count[fits])
            k = int(change.argmin())
            if change[k] <= best:
                at = int(fits[k])
        if at == capacity and not stacks.get(capacity):
            bin_, made = made, made + 1
        else:
            bin_ = stacks[at].pop()
            count[at] -= 1
            if not count[at]:
                gaps = np.delete(gaps, np.searchsorted(gaps, at))
        out[i] = bin_
        if left := at - s:
            stacks.setdefault(left, []).append(bin_)
            count[left] += 1
            if count[left] == 1:
                gaps = np.insert(gaps, np.searchsorted(gaps, left), left)
    return out


def pack(items: DataFrame, budgets: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget_name, item_id, piece_no, size, container) for items (item_id, size) and budgets (budget_name, capacity).

    `budgets` is a small table of fixed rows; each of its rows packs all items.
    """
    budgets = budgets.select("budget_name", F.col("capacity").cast("int").alias("capacity")).distinct()
    if (n := budgets.count()) > BUDGETS:
        raise ValueError(f"{n} budgets; each packs all items, so at most {BUDGETS} are taken at once")
    items = items.select("item_id", F.coalesce("size", F.lit(0)).alias("size")).dropDuplicates(["item_id"])
    shards = max(1, -(-items.count() // shard_items))
    each = items.crossJoin(F.broadcast(budgets))
    pieces = each.select(
        "budget_name", "capacity", "item_id",
        F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"),
        F.posexplode(
            F.expr("transform(sequence(0, greatest(0, cast(floor((size - 1) / capacity) as int))), i -> least(capacity, size - i * capacity))")
        ).alias("piece_no", "size"),
    )

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("item_id", "ascending"), ("piece_no", "ascending")])
        sizes = t["size"].to_numpy().astype(np.int64)
        capacity, some = int(t["capacity"][0].as_py()), sizes > 0
        box = np.full(len(sizes), -1, np.int64)
        box[some] = sum_of_squares(sizes[some], capacity)
        shard = t["shard"][0].as_py()
        names = pa.array([None if b < 0 else f"{shard}-{b}" for b in box.tolist()], pa.string())
        return pa.table({"budget_name": t["budget_name"], "item_id": t["item_id"], "piece_no": t["piece_no"], "size": t["size"], "container": names})

    kind = items.schema["item_id"].dataType.simpleString()
    return pieces.groupBy("budget_name", "shard").applyInArrow(one, f"budget_name string, item_id {kind}, piece_no int, size int, container string")


def document_sizes(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", tokenizer).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or piece of one, for each budget. Each tokenizer encodes the documents once."""
    budgets = table(spark, sf_dir, "pack_budget")
    out = None
    for (name,) in budgets.select("tokenizer").distinct().orderBy("tokenizer").collect():  # a fixed table of a few rows
        own = budgets.where(F.col("tokenizer") == name).select("budget_name", F.col("capacity_tokens").alias("capacity"))
        one = pack(materialized(document_sizes(spark, sf_dir, name)), own)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("item_id", "doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers, tokens, and the share of their space that is used."""
    capacity = table(spark, sf_dir, "pack_budget").select("budget_name", F.col("capacity_tokens").alias("capacity"))
    boxes = p9_packed(spark, sf_dir).where("container is not null").groupBy("budget_name", "container").agg(F.sum("size").alias("used"))
    return (
        boxes.groupBy("budget_name").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .join(F.broadcast(capacity), "budget_name")
        .select("budget_name", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used_share"))
    )
