"""Splits that keep related records together.

Records that share a key (author, source, entity) belong to one group, also
through other records. Groups are the connected components of the graph of
keys, found by random-mate contraction: each round every vertex draws a coin,
tails join a neighbouring head, edges between heads and tails collapse, until
none is left; then labels are unwound. Each round is a few joins over distinct
edges, so a hub with a third of all records is one vertex with distinct edges.
Groups then take splits by cumulative weight.

Defined results: null keys join nothing; a record without keys is a group of
its own; rows repeated by delivery count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialized, table

#: A group heavier than this share of the smallest split is placed on its own; there are at most 1 / (share * LARGE) such groups.
LARGE = 0.1


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of each vertex of `edges` (a, b); root is a vertex of its component. Strings; self-loops name single vertices."""
    pairs = edges.where("a is not null and b is not null")
    vertices = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    live = materialized(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        coin = lambda v, r=len(steps): F.pmod(F.xxhash64(v, F.lit(r)), F.lit(2)) == 1
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a tail joins its smallest head
        merge = materialized(both.where(~coin(F.col("a")) & coin(F.col("b"))).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")))
        steps.append(merge)
        x = live.join(merge, F.col("a") == F.col("v"), "left").select(F.coalesce("to", "a").alias("a"), "b")
        x = x.join(merge, F.col("b") == F.col("v"), "left").select("a", F.coalesce("to", "b").alias("b"))
        live = materialized(x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # unwind: what a head became later holds for its tails
    root = None
    for merge in reversed(steps):
        if root is not None:
            merge = merge.join(root.withColumnRenamed("v", "to").withColumnRenamed("root", "later"), "to", "left").select("v", F.coalesce("later", "to").alias("root")).unionByName(root)
            merge = materialized(merge)
        else:
            merge = merge.withColumnRenamed("to", "root")
        root = merge
    if root is None:
        return vertices.select("v", F.col("v").alias("root"))
    return vertices.join(root, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def groups(records: DataFrame, key: str, families: list[str]) -> DataFrame:
    """(key, root) of each record: records of one root belong together. Keys of different columns are kept apart."""
    named = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(families)]
    own = F.concat(F.lit("r:"), F.col(key).cast("string"))
    held = F.array_compact(F.array(*named))
    linked = materialized(records.where(F.col(key).isNotNull()).select(key, F.when(F.size(held) > 0, held).otherwise(F.array(own)).alias("keys")).distinct())
    first = F.col("keys")[0]
    edges = linked.select("keys").distinct().select(first.alias("a"), F.explode("keys").alias("b")).distinct()
    root = components(edges)
    # a record that came with different keys has several rows; all of them are linked to its first key
    many = linked.groupBy(key).agg(F.min(first).alias("k"), F.count_distinct(first).alias("n"))
    if not many.where("n > 1").isEmpty():
        more = linked.join(many, key).select(F.col("k").alias("a"), first.alias("b"))
        root = components(edges.unionByName(more).distinct())
    return many.select(key, F.col("k").alias("v")).join(root, "v").select(key, "root")


def assign_splits(grouped: DataFrame, targets: list[tuple[str, float]], weight: str = "weight", salt: int = 0) -> DataFrame:
    """(root, split) for groups (root, weight) and target shares: large groups first, each where most is missing; the rest by cumulative weight in hashed order."""
    total_share = sum(s for _, s in targets) or 1.0
    targets = [(n, s / total_share) for n, s in targets]
    size = grouped.agg(F.sum(weight)).first()[0] or 0
    least = min(s for _, s in targets if s > 0)
    bound = LARGE * least * size
    large = grouped.where(F.col(weight) > bound).orderBy(F.desc(weight), "root").collect()  # fewer than 1 / (LARGE * least)
    left = {n: s * size for n, s in targets}
    placed = []
    for row in large:
        name = max(left, key=lambda n: (left[n], n))
        left[name] -= row[weight]
        placed.append((row["root"], name))
    spark = grouped.sparkSession
    small = grouped.where(F.col(weight) <= bound).withColumn("at", F.xxhash64("root", F.lit(salt)))
    # running sum over hashed order without a single task: sums of 1,024 ranges of the hash, then within each
    small = materialized(small.withColumn("range", F.shiftright("at", 54)))
    from pyspark.sql import Window

    sums = small.groupBy("range").agg(F.sum(weight).alias("w"))  # 1,024 rows at most
    sums = sums.withColumn("before", F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("w"))
    inside = F.sum(weight).over(Window.partitionBy("range").orderBy("at", "root"))
    middle = F.col("before") + inside - F.col(weight) / 2
    rest = sum(max(0.0, x) for x in left.values()) or 1.0
    amount = (small.agg(F.sum(weight)).first()[0] or 0) / rest
    upto, choice = 0.0, F.lit(targets[-1][0])
    cuts = []
    for n, _ in targets:
        upto += max(0.0, left[n]) * amount
        cuts.append((n, upto))
    for n, cut in reversed(cuts[:-1]):
        choice = F.when(F.col("middle") < cut, F.lit(n)).otherwise(choice)
    out = small.join(F.broadcast(sums.select("range", "before")), "range").withColumn("middle", middle).select("root", choice.alias("split"))
    if placed:
        out = out.unionByName(spark.createDataFrame(placed, "root string, split string"))
    return out


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with all three kinds of family; one delivered again counts once."""
    src = table(spark, sf_dir, "benchmark_source").select("source_id", "insurer_family", "product_family").distinct()
    own = table(spark, sf_dir, "document_split_assignment").select("source_id", "near_duplicate_family").distinct()
    return src.join(own, "source_id", "left")


FAMILIES = ["insurer_family", "product_family", "near_duplicate_family"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = materialized(_sources(spark, sf_dir))
    g = groups(src, "source_id", FAMILIES)
    names = src.select("source_id", "insurer_family").distinct().join(g, "source_id")
    least = names.groupBy("root").agg(F.min("insurer_family").alias("group_key")).where("group_key is not null")
    return g.join(least, "root").select("source_id", "group_key").distinct()


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every source; groups stay whole, shares are counted in sources."""
    targets = [(r[0], r[1]) for r in table(spark, sf_dir, "split_target").orderBy(F.desc("share"), "split_name").collect()]  # a fixed table of a few rows
    g = materialized(groups(_sources(spark, sf_dir), "source_id", FAMILIES))
    weights = g.groupBy("root").agg(F.count("*").alias("weight"))
    return g.join(assign_splits(weights, targets), "root").select("source_id", F.col("root").alias("group_id"), "split")


SQL = {
    "p3_found": """
        with recursive src as (
            select distinct b.source_id, b.insurer_family, b.product_family, a.near_duplicate_family
            from benchmark_source b left join document_split_assignment a using (source_id)),
        key as (
            select distinct source_id, unnest(list_filter(['i' || insurer_family, 'p' || product_family, 'n' || near_duplicate_family], lambda x: x is not null)) k from src),
        kk as (select distinct a.k, b.k l from key a join key b using (source_id)),
        reach(k, l) as (select k, k from kk union select reach.k, kk.l from reach join kk on reach.l = kk.k),
        least as (select k, min(l) root from reach group by k),
        grp as (select distinct source_id, root from key join least using (k)),
        name as (select root, min(insurer_family) group_key from grp join src using (source_id) where insurer_family is not null group by root)
        select distinct source_id, group_key from grp join name using (root)"""
}
