"""Dense vectors: best items by inner product, profile vectors and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import lookup
from basketry.operators.blocks import BLOCK, TILE, dense_top
from basketry.operators.features import vocabularies
from basketry.operators.neighbors import unit_knn, unit_vectors
from basketry.runtime import cut

# Weight of an event in a profile vector.
PROFILE_WEIGHTS = {"view": 0.05, "cart": 1.0, "purchase": 2.0}
DIGITS = 9


def embedding_topn(
    queries: DataFrame, items: DataFrame, n: int, block: int = BLOCK, tile: int = TILE, exclude: DataFrame | None = None
) -> DataFrame:
    """Exact best ``n`` items per query by inner product: ``(query_id, item_id, score, rank)``.

    ``queries`` is ``(query_id, vector)``, ``items`` is ``(item_id, vector)``. ``exclude`` lists ``(query_id, item_id)`` pairs that
    must not come out; each is sent to the pair of blocks it belongs to and hidden there. Both inputs are written first,
    and their ids are counted.
    """
    queries, items = cut(queries), cut(items.withColumnRenamed("item_id", "candidate_id"))
    if exclude is not None:
        exclude = exclude.select("query_id", F.col("item_id").alias("candidate_id"))
    return dense_top(queries, items, n, exclude, block, tile).withColumnRenamed("candidate_id", "item_id")


def profile_vectors(events: DataFrame, catalog: DataFrame, top_brands: int = 20) -> DataFrame:
    """Unit vectors over categories and popular brands: ``(user_id, dim, w)``; users without weight have none.

    Events are summed per user and item first, so the catalog is joined to that smaller table.
    """
    weighted = events.withColumn("_w", lookup(F.col("event_type"), PROFILE_WEIGHTS, 0.0)).filter(F.col("_w") > 0)
    per_item = weighted.groupBy("user_id", "item_id").agg(F.sum("_w").alias("_w"))
    _, brands = vocabularies(catalog, top_brands)
    known = catalog.select("item_id", "category_l2", "brand").join(
        brands.select("brand", F.lit(True).alias("_popular")), "brand", "left"
    )
    dims = F.array_compact(
        F.array(
            F.when(F.col("category_l2").isNotNull(), F.concat(F.lit("category:"), F.col("category_l2"))),
            F.when(F.col("_popular"), F.concat(F.lit("brand:"), F.col("brand"))),
        )
    )
    summed = (
        per_item.join(known, "item_id")
        .select("user_id", F.explode(dims).alias("dim"), "_w")
        .groupBy("user_id", "dim")
        .agg(F.round(F.sum("_w"), DIGITS).alias("weight"))
    )
    return unit_vectors(summed, "dim")


def profile_knn(unit: DataFrame, k: int = 20, block: int | None = None) -> DataFrame:
    """Exact ``k`` most similar other users by inner product: ``(user_id, neighbor, sim, rank)``."""
    return unit_knn(unit, k, block)
