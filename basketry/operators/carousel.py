"""Sections of a user's page: model list, neighbours' items, matching content, recent items and items to revisit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import age_in_days, lookup
from basketry.operators.blocks import TILE, best_per_row
from basketry.operators.distributed import top_rows
from basketry.operators.neighbors import cf_from_neighbors
from basketry.runtime import cut, require_positive, scalar

# Weight of an event for revisiting, decay in days, days after a purchase in which an item is left out.
REVISIT_WEIGHTS = {"cart": 1.0, "view": 0.2, "purchase": 0.3}
REVISIT_OTHER = 0.1
REVISIT_DECAY_DAYS = 14
REVISIT_PAUSE_DAYS = 7
REVISIT_MIN_SEEN = 3
SECTIONS = ["submission", "collaborative", "content", "recency", "revisit"]


def model_top(pred: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` of each user's model list."""
    return pred.filter(F.col("rank") <= n).select("user_id", "item_id", "rank")


def _as_list(df: DataFrame, name: str) -> DataFrame:
    """Ranked rows of a user as one array; callers have limited the ranks."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return df.groupBy("user_id").agg(F.transform(pairs, lambda p: p["item_id"]).alias(name))


def recency_pool(catalog: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` items with most recent events, with their place."""
    require_positive(n=n)
    best = catalog.filter(F.col("recent14_events") > 0).orderBy(F.desc("recent14_events"), F.asc("item_id")).limit(n)
    key = F.struct((-F.col("recent14_events")).alias("m"), "item_id", "category_l2", "recent14_events")
    return best.agg(F.array_sort(F.collect_list(key)).alias("a")).select(F.posexplode("a").alias("place", "r")).select(
        F.col("r.item_id").alias("item_id"),
        F.col("r.category_l2").alias("category_l2"),
        F.col("r.recent14_events").alias("recent14_events"),
        (F.col("place") + 1).alias("rank"),
    )


def content_candidates(
    profiles: DataFrame,
    seen: DataFrame,
    catalog: DataFrame,
    model_lists: DataFrame,
    n: int = 5,
    user_block: int = 8192,
    item_block: int = 8192,
) -> DataFrame:
    """Unseen items that fit a user's profile: ``(user_id, item_id, score, rank)``.

    Two points each for a favourite category and brand, one for the usual price band, and up to one for a place in the
    model list. Without any fitting item the unseen catalog is listed in item order. (An unseen item of the model list
    always scores, so the model order can never matter there.)

    Users and items are dealt into blocks, and a task scores one block of users against one block of the catalog. The items
    that a user has seen are sent to the block they belong to and hidden there, so every block hands on ``n`` items per user
    at most. Scores of a tile of users are computed as arrays; memory is set by the block sizes. Runs two counts.
    """
    require_positive(n=n)
    profiles, catalog = cut(profiles), cut(catalog)
    lists = _as_list(model_lists, "_listed")
    user_kind = profiles.schema["user_id"].dataType.simpleString()
    item_kind = catalog.schema["item_id"].dataType.simpleString()
    u_blocks = max(1, -(-profiles.count() // user_block))
    i_blocks = max(1, -(-catalog.count() // item_block))
    item_place = F.pmod(F.xxhash64("item_id"), F.lit(i_blocks)).cast("int").alias("_i")
    hidden = seen.select("user_id", "item_id", item_place).groupBy("user_id", "_i").agg(F.collect_set("item_id").alias("_hidden"))
    none = F.array().cast(f"array<{item_kind}>")
    users = (
        profiles.join(lists, "user_id", "left")
        .select(
            "user_id",
            "top_categories",
            F.array_union("top_brands", "carted_brands").alias("brands"),
            F.col("price_median").cast("double").alias("price_median"),
            F.col("price_iqr").cast("double").alias("price_iqr"),
            F.coalesce(F.col("_listed"), none).alias("listed"),
            F.pmod(F.xxhash64("user_id"), F.lit(u_blocks)).cast("int").alias("_u"),
            F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1))).alias("_i"),
        )
        .join(hidden, ["user_id", "_i"], "left")
        .withColumn("hidden", F.coalesce(F.col("_hidden"), none))
        .drop("_hidden")
    )
    items = catalog.select(
        "item_id", "category_l2", "brand", F.col("price").cast("double").alias("price"), item_place,
        F.explode(F.sequence(F.lit(0), F.lit(u_blocks - 1))).alias("_u"),
    )

    def flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and place of every entry of the lists, and the entries."""
        sizes = np.array([len(x) for x in lists], int)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return rows, places, np.concatenate([np.asarray(x) for x in lists]) if len(rows) else np.zeros(0)

    def points_of(lists: pd.Series, names: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Two points where an item's code is among a user's names; code -1 reads the last column, which stays empty."""
        table = np.zeros((len(lists), len(names) + 1))
        rows, _, entries = flat(lists)
        at = pd.Index(names).get_indexer(entries) if len(rows) else np.zeros(0, int)
        table[rows[at >= 0], at[at >= 0]] = 2.0
        return table[:, codes]

    def score(u: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if u.empty or i.empty:
            return pd.DataFrame({"user_id": [], "item_id": [], "score": []})
        i = i.sort_values("item_id", kind="stable")
        ids, prices = i["item_id"].to_numpy(), i["price"].to_numpy(dtype=float)
        category, categories = pd.factorize(i["category_l2"])
        brand, brands = pd.factorize(i["brand"])
        out = []
        for low in range(0, len(u), TILE):
            part = u.iloc[low : low + TILE]
            points = points_of(part["top_categories"], categories, category) + points_of(part["brands"], brands, brand)
            median, width = (part[c].to_numpy(dtype=float)[:, None] for c in ("price_median", "price_iqr"))
            points += (width > 0) & (np.abs(prices - median) <= 1.5 * width)  # a missing value compares as false
            for column in ("listed", "hidden"):
                rows, places, entries = flat(part[column])
                at = pd.Index(ids).get_indexer(entries) if len(rows) else np.zeros(0, int)
                known = at >= 0
                sizes = np.bincount(rows, minlength=len(part))[rows]
                if column == "listed":
                    np.add.at(points, (rows[known], at[known]), 1.0 - places[known] / sizes[known])
                    points = np.round(points, 9)
                else:
                    points[rows[known], at[known]] = -np.inf
            rows, columns = best_per_row(points, n, None)
            out.append(pd.DataFrame({"user_id": part["user_id"].to_numpy()[rows], "item_id": ids[columns], "score": points[rows, columns]}))
        return pd.concat(out, ignore_index=True)

    scored = (
        users.groupBy("_u", "_i")
        .cogroup(items.groupBy("_u", "_i"))
        .applyInPandas(score, f"user_id {user_kind}, item_id {item_kind}, score double")
    )
    ranked = top_rows(scored, ["user_id"], [F.desc("score"), F.asc("item_id")], n)
    # Rank 1 has the user's best score: if that is zero nothing fits and the list is the fallback.
    fits = ranked.filter(F.col("rank") == 1).select("user_id", (F.col("score") > 0).alias("_fits"))
    return ranked.join(fits, "user_id").filter(~F.col("_fits") | (F.col("score") > 0)).drop("_fits")


def unseen_recent(
    users: DataFrame, profiles: DataFrame, seen: DataFrame, pool: DataFrame, model_lists: DataFrame, n: int = 5
) -> DataFrame:
    """Recent items the user has not seen: favourite categories first, then by place in the model list and in the pool.

    The pool is bounded by its definition, so it travels as one array in the plan; each user carries only the pool
    items it has seen. Users without profile get the pool in its own order.
    """
    require_positive(n=n)
    shelf = pool.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "category_l2")))).scalar()
    known = seen.join(pool.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(
        F.collect_set("item_id").alias("_seen")
    )
    lists = _as_list(model_lists, "_listed")
    liked = profiles.select("user_id", F.col("top_categories").alias("_categories"))
    joined = (
        users.select("user_id").distinct()
        .join(liked, "user_id", "left")
        .join(known, "user_id", "left")
        .join(lists, "user_id", "left")
        .withColumn("_shelf", shelf)
    )

    def entry(x: Column) -> Column:
        place = F.array_position(F.col("_listed"), x["item_id"])
        listed = F.coalesce(F.when(place > 0, place - 1), F.size(F.coalesce(F.col("_listed"), F.array())).cast("long"))
        match = F.coalesce(F.array_contains("_categories", x["category_l2"]), F.lit(False))
        points = F.when(match, 200).otherwise(0) - listed
        return F.struct(
            F.when(F.col("_categories").isNull(), F.lit(0).cast("long")).otherwise(-points).alias("k"),
            x["rank"].alias("place"),
            x["item_id"].alias("item_id"),
        )

    fresh = F.filter("_shelf", lambda x: ~F.coalesce(F.array_contains("_seen", x["item_id"]), F.lit(False)))
    best = F.slice(F.array_sort(F.transform(fresh, entry)), 1, n)
    return joined.select("user_id", F.posexplode(best).alias("_p", "e")).select(
        "user_id", F.col("e.item_id").alias("item_id"), (-F.col("e.k") / 100).alias("score"), (F.col("_p") + 1).alias("rank")
    )


def revisit(events: DataFrame, n: int = 3, tie: str = "event_id", latest: Column | None = None) -> DataFrame:
    """Seen items worth another look, with score (scaled to the user's best), last event and counts.

    Everything is aggregated per (user, item); the user's best score is that of the first of its ``n`` rows.
    """
    require_positive(n=n)
    latest = scalar(events, F.max("event_time")) if latest is None else latest
    rows = events.select(
        "user_id", "item_id", "event_type", "event_time", F.col(tie).alias("_tie"),
        age_in_days(F.col("event_time"), latest, whole=True).alias("days"),
    )
    bought = F.col("event_type") == "purchase"
    weight = lookup(F.col("event_type"), REVISIT_WEIGHTS, REVISIT_OTHER)
    items = rows.groupBy("user_id", "item_id").agg(
        F.sum(weight / (1.0 + F.col("days") / REVISIT_DECAY_DAYS)).alias("_sum"),
        F.count(F.lit(1)).alias("revisit_event_count"),
        F.min(F.struct("days", "event_time", "_tie", "event_type")).alias("_last"),
        F.bool_or(bought).alias("_bought"),
        F.bool_or(bought & (F.col("days") <= REVISIT_PAUSE_DAYS)).alias("_just_bought"),
    )
    boost = 1.0 + 0.25 * F.least(F.col("revisit_event_count") - 1, F.lit(3))
    scored = items.filter(~F.col("_just_bought")).withColumn("_score", F.round(F.col("_sum") * boost, 9))
    best = top_rows(scored, ["user_id"], [F.desc("_score"), F.asc("item_id")], n)
    top = best.filter(F.col("rank") == 1).select("user_id", F.col("_score").alias("_max"))
    return best.join(top, "user_id").select(
        "user_id",
        "item_id",
        "rank",
        F.bround(F.col("_score") / F.col("_max"), 3).alias("revisit_score"),
        F.col("_last.event_type").alias("last_event_type"),
        F.col("_last.days").alias("last_interaction_days"),
        "revisit_event_count",
        ((F.col("_last.event_type") == "cart") & ~F.col("_bought")).alias("cart_without_purchase"),
    )


def carousel(
    pred: DataFrame,
    profiles: DataFrame,
    seen: DataFrame,
    events: DataFrame,
    catalog: DataFrame,
    pool: DataFrame,
    knn: DataFrame | None,
    n: int = 5,
) -> DataFrame:
    """Five sections for every user with a profile: ``(user_id, section, position, item_id)``.

    A section leaves out what earlier ones show. Sections before it show at most ``n`` items each, so lists of that
    much extra length always suffice. The revisit section stands alone and needs three seen items.
    """
    require_positive(n=n)
    listed = model_top(pred, 10)
    users = profiles.select("user_id")
    lists = {"submission": listed}
    if knn is not None:
        lists["collaborative"] = cf_from_neighbors(knn, seen, 2 * n)
    lists["content"] = content_candidates(profiles, seen, catalog, listed, 3 * n)
    lists["recency"] = unseen_recent(users, profiles, seen, pool, listed, 4 * n)
    enough = seen.groupBy("user_id").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") >= REVISIT_MIN_SEEN)
    lists["revisit"] = revisit(events, n).join(enough.select("user_id"), "user_id", "left_semi")
    wide = users
    for name, rows in lists.items():
        wide = wide.join(_as_list(rows.select("user_id", "item_id", "rank"), name), "user_id", "left")
    item_list = f"array<{catalog.schema['item_id'].dataType.simpleString()}>"
    shown = F.array().cast(item_list)
    for name in SECTIONS:
        raw = F.coalesce(F.col(name), F.array().cast(item_list)) if name in lists else F.array().cast(item_list)
        wide = wide.withColumn(name, F.slice(raw if name == "revisit" else F.array_except(raw, shown), 1, n))
        if name != "revisit":
            shown = F.concat(shown, F.col(name))
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("items")) for s in SECTIONS])
    return wide.select("user_id", F.inline(sections)).select(
        "user_id", "section", F.posexplode("items").alias("_p", "item_id")
    ).select("user_id", "section", (F.col("_p") + 1).alias("position"), "item_id")
