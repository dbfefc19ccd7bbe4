"""Exact nearest neighbours of sparse vectors, without shuffling all pairs that share a dimension.

Vectors are long tables ``(user_id, item_id, weight)`` with positive weights. Similarity is the cosine.

Users with identical vectors are searched once; only the first k+1 of them (by id) can be anybody's neighbours. Distinct
vectors are dealt into blocks of like ones. Each is searched in its own block, and then only in blocks whose bound reaches its k-th
similarity; products are added up inside one task, which hands on no more than the best k+1 of every vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.operators.blocks import CANDIDATE, CELLS, ENTRIES, QUERY, sparse_task
from basketry.operators.distributed import sorted_index, top_rows
from basketry.runtime import cut, require_positive


# Vectors in a block; smaller blocks have closer bounds, larger ones fewer of them. Blocks grow with the number of vectors up to
# ``MOST``, as every vector hands on k others from each block that it is sent to.
BLOCK, MOST, BLOCKS = 2048, 32_768, 16


def unit_vectors(vec: DataFrame, dim: str = "item_id") -> DataFrame:
    """Weights divided by the length of the user's vector, to 12 places; users without weight have no rows."""
    positive = vec.filter(F.col("weight") > 0)
    norms = positive.groupBy("user_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return positive.join(norms, "user_id").select(
        "user_id", F.col(dim).alias("dim"), F.round(F.col("weight") / F.col("_norm"), 12).alias("w")
    )


def identical_groups(unit: DataFrame) -> DataFrame:
    """``(user_id, rep)``: users with the same vector share the smallest of their ids.

    The vector is summarised by two independent 64-bit hashes and its length, which do not depend on row order.
    """
    marks = unit.groupBy("user_id").agg(
        F.bit_xor(F.xxhash64("dim", "w")).alias("_a"),
        F.bit_xor(F.xxhash64("w", "dim", F.lit(17))).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    key = ["_a", "_b", "_n"]
    reps = marks.groupBy(*key).agg(F.min("user_id").alias("rep"))
    return marks.join(reps, key).select("user_id", "rep")


def block_size(unit: DataFrame) -> int:
    """Vectors in a block where nobody says so: a sixteenth of them, while the dense form of a block stays small. Runs a count."""
    n, width = unit.agg(F.countDistinct("user_id"), F.countDistinct("dim")).first()
    return max(BLOCK, min(MOST, -(-n // BLOCKS), CELLS // max(1, width)))


def numbered_dims(unit: DataFrame) -> DataFrame:
    """The same vectors with numbers for dimensions; tasks sort and compare those faster than texts."""
    codes = sorted_index(unit.select("dim").distinct(), ["dim"], "_code")
    return unit.join(codes, "dim").select("user_id", F.col("_code").alias("dim"), "w")


def dealt_blocks(unit: DataFrame, block: int) -> DataFrame:
    """``(user_id, dim, w, block)``: vectors in blocks of ``block``, those with the same largest dimensions next to each other.

    Blocks are smaller where vectors are so long that one would have more than ``ENTRIES`` entries. Runs a count.
    """
    n, rows = unit.agg(F.countDistinct("user_id"), F.count(F.lit(1))).first()
    block = max(1, min(block, ENTRIES * n // max(1, rows)))
    entry = F.struct((-F.col("w")).alias("w"), "dim")
    leads = unit.groupBy("user_id").agg(F.min(entry).alias("lead")).select("user_id", F.col("lead.dim").alias("lead"), F.col("lead.w").alias("heavy"))
    placed = sorted_index(leads, ["lead", "heavy", "user_id"], "place").select("user_id", F.floor(F.col("place") / block).cast("int").alias("block"))
    return unit.join(placed, "user_id")


def reachable_blocks(dealt: DataFrame, least: DataFrame) -> DataFrame:
    """``(user_id, target, least)``: the other blocks that may hold a vector with a similarity of the user's ``least`` or more.

    A block is known by the largest weight of each of its dimensions. No vector of it can be closer to a user than the product with these
    weights, nor, as vectors have length one, than the length of the user's vector on the block's dimensions.
    """
    tops = dealt.groupBy("block", "dim").agg(F.max("w").alias("top"))
    met = dealt.select("user_id", "dim", "w", F.col("block").alias("own")).join(tops, "dim").filter(F.col("own") != F.col("block"))
    bounds = met.groupBy("user_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("by_top"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("by_length"))
    # Similarities are rounded to nine places.
    enough = F.least("by_top", "by_length") + 2e-9 >= F.coalesce(F.col("least"), F.lit(0.0))
    return bounds.join(least, "user_id", "left").filter(enough).select("user_id", F.col("block").alias("target"), "least")


def similar_vectors(unit: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Exact best ``k`` vectors (itself included) for each vector: ``(user_id, other, sim, place)``. Runs jobs.

    A vector is searched in its own block first. Its k-th similarity there says which other blocks it need be sent to; the rest, all
    of whose vectors are farther, are skipped.
    """
    require_positive(k=k, block=1 if block is None else block)
    unit = cut(unit if unit.schema["dim"].dataType.typeName() in ("integer", "long") else numbered_dims(unit))
    block = block_size(unit) if block is None else block
    dealt = cut(dealt_blocks(unit, block))
    kind, task = dealt.schema["user_id"].dataType.simpleString(), sparse_task(k, 0.0)
    none = F.lit(None).cast(kind)
    query = lambda df, *at: df.select(F.lit(QUERY).alias("kind"), F.col("user_id").alias("query_id"), none.alias("candidate_id"), "dim", "w", *at)
    candidate = lambda df, *at: df.select(F.lit(CANDIDATE).alias("kind"), none.alias("query_id"), F.col("user_id").alias("candidate_id"), "dim", "w", *at)
    found = f"query_id {kind}, candidate_id {kind}, score double"
    own = cut(query(dealt, "block").unionByName(candidate(dealt, "block")).groupBy("block").applyInArrow(task, found))
    if (dealt.agg(F.max("block")).first()[0] or 0) > 0:
        least = top_rows(own, ["query_id"], [F.desc("score"), F.asc("candidate_id")], k).filter(F.col("rank") == k)
        targets = cut(reachable_blocks(dealt, least.select(F.col("query_id").alias("user_id"), F.col("score").alias("least"))))
        # A block that many vectors are sent to meets them in groups of about a block.
        groups = targets.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
        sent = dealt.drop("block").join(targets, "user_id").join(groups, "target").withColumn("part", F.pmod(F.xxhash64("user_id"), "groups").cast("int"))
        offered = dealt.join(groups, F.col("block") == F.col("target")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        # The k-th similarity so far goes along, so that a task looks closely at the few pairs above it.
        others = query(sent, F.col("least").alias("floor"), "target", "part").unionByName(candidate(offered, F.lit(None).cast("double").alias("floor"), "target", "part")).groupBy("target", "part").applyInArrow(task, found)
        own = own.unionByName(others)
    best = top_rows(own, ["query_id"], [F.desc("score"), F.asc("candidate_id")], k)
    return best.select(F.col("query_id").alias("user_id"), F.col("candidate_id").alias("other"), F.col("score").alias("sim"), F.col("rank").alias("place"))


def user_knn(vec: DataFrame, k: int = 300, dim: str = "item_id", block: int | None = None) -> DataFrame:
    """Exact ``k`` most similar other users: ``(user_id, neighbor, sim, rank)``; only positive similarity counts."""
    return unit_knn(unit_vectors(vec, dim), k, block)


def unit_knn(unit: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """The same for unit vectors ``(user_id, dim, w)``."""
    unit = cut(unit)
    groups = cut(identical_groups(unit))
    distinct = unit.join(groups.select(F.col("rep").alias("user_id")).distinct(), "user_id", "left_semi")
    return _expand(similar_vectors(distinct, k + 1, block), groups, k)


def _expand(similar: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """From similar distinct vectors to neighbours of every user.

    A user can need k+1 candidates at most (itself is among them), so each group of copies offers its first k+1 users
    and each distinct vector keeps its first k+1 candidates before they are handed to the users that share it.
    """
    members = top_rows(groups, ["rep"], [F.asc("user_id")], k + 1, "_m").select(
        F.col("rep").alias("other"), F.col("user_id").alias("neighbor")
    )
    sizes = members.groupBy("other").agg(F.count(F.lit(1)).alias("_members"))
    closer = W.partitionBy("user_id").orderBy(F.desc("sim")).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("user_id", "sim")
    # Groups behind k+1 members that are strictly closer cannot matter; at most k+1 groups per vector are looked at.
    needed = (
        similar.join(sizes, "other")
        .withColumn("_before", F.sum("_members").over(closer) - F.sum("_members").over(same))
        .filter(F.col("_before") < k + 1)
    )
    shared = needed.select(F.col("user_id").alias("rep"), "other", "sim").join(members, "other")
    candidates = top_rows(
        shared.select("rep", "neighbor", "sim"), ["rep"], [F.desc("sim"), F.asc("neighbor")], k + 1, "_c"
    )
    mine = groups.join(candidates.drop("_c"), "rep").filter(F.col("user_id") != F.col("neighbor"))
    return top_rows(mine.select("user_id", "neighbor", "sim"), ["user_id"], [F.desc("sim"), F.asc("neighbor")], k)


def cf_from_neighbors(knn: DataFrame, items: DataFrame, n: int | Column = 50) -> DataFrame:
    """Items that neighbours bought (3 each) or carted (1 each) and the user has not seen; best ``n`` per user.

    ``items`` has one row per (user, item) seen with flags ``carted`` and ``purchased``; ``n`` may differ by user.
    """
    value = 3.0 * F.col("purchased").cast("double") + F.col("carted").cast("double")
    liked = items.select(F.col("user_id").alias("neighbor"), "item_id", value.alias("_v")).filter(F.col("_v") > 0)
    scored = (
        knn.select("user_id", "neighbor").join(liked, "neighbor").groupBy("user_id", "item_id").agg(F.sum("_v").alias("score"))
    )
    unseen = scored.join(items.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_rows(unseen, ["user_id"], [F.desc("score"), F.asc("item_id")], n)
