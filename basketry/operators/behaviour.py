"""Descriptive statistics of an event log: distributions, calendar, sessions and repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import bucketize, category_path, category_token, with_calendar
from basketry.operators.distributed import exact_quantiles, gaps_to_previous, most_frequent, sorted_index, top_rows
from basketry.runtime import count_of, cut, scalar

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
TAIL = {**QUARTILES, "p90": 0.9, "p95": 0.95, "p99": 0.99}
TYPES = ("view", "cart", "purchase")
# Minutes between sessions.
SESSION_GAP_EDGES = [-1, 5, 15, 30, 60, 120, 360, 1440, 60 * 24 * 7, 10**9]
SESSION_GAP_LABELS = ["0-5min", "5-15", "15-30", "30-60", "1-2h", "2-6h", "6-24h", "1-7d", ">7d"]


def describe(df: DataFrame, value: str, quantiles: dict[str, float] = TAIL, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quantiles and maximum of a column, per key or in all."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    placed = exact_quantiles(df, keys, value, quantiles)
    if keys:
        return moments.join(placed, keys, "left")
    row = placed.select(F.struct("*").alias("q")).scalar()
    return moments.withColumn("_q", row).select("*", "_q.*").drop("_q")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Size, sparsity, nulls, distinct values and time range of the log in one row.

    Rows are first counted by user, item, session, category, brand and type. Distinct values of each column are counted by a
    grouping of that smaller table, one column at a time, so that no row is multiplied.
    """
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("category_code", "brand", "price")]
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        *nulls,
    )
    grain = cut(df.select("user_id", "item_id", "user_session", "category_code", "brand", "event_type").distinct())
    distinct = {
        "n_users": ["user_id"], "n_items": ["item_id"], "n_sessions": ["user_session"], "n_pairs": ["user_id", "item_id"],
        "n_categories": ["category_code"], "n_brands": ["brand"], "n_event_types": ["event_type"],
    }
    for name, columns in distinct.items():
        known = grain.dropna(subset=columns).select(*columns).distinct()
        counts = counts.withColumn(name, scalar(known, F.count(F.lit(1))))
    cells = F.col("n_users") * F.col("n_items")
    return counts.select(
        "*",
        (1 - F.col("n_rows") / cells).alias("sparsity"),
        (F.col("n_pairs") / cells).alias("density"),
        F.timestamp_diff("DAY", F.col("first_time"), F.col("last_time")).alias("n_days"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value of a column occurs, nulls included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def daily_event_counts(df: DataFrame) -> DataFrame:
    """Views, carts, purchases and their total per date, and the share of purchases in percent."""
    counts = df.groupBy(F.to_date("event_time").alias("date")).agg(*[count_of(t).alias(t) for t in TYPES])
    total = F.col("view") + F.col("cart") + F.col("purchase")
    return counts.withColumn("total", total).withColumn(
        "purchase_share_pct", F.col("purchase") / F.nullif(F.col("total"), F.lit(0)) * 100
    )


def daily_purchase_price(df: DataFrame) -> DataFrame:
    """Number, mean, median, lowest and highest price of purchases per date."""
    bought = df.filter(F.col("event_type") == "purchase").withColumn("date", F.to_date("event_time"))
    stats = bought.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_purch"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    return stats.join(exact_quantiles(bought, ["date"], "price", {"median_price": 0.5}), "date", "left")


def session_mix(df: DataFrame) -> DataFrame:
    """Per event type: its share of all events, its mean and median share inside sessions, sessions it dominates.

    A tie for the most frequent type of a session goes to the type first in the alphabet. ``single_type_sessions``
    counts the sessions that hold only this type.
    """
    counts = df.groupBy("user_session").agg(*[count_of(t).alias(t) for t in TYPES])
    total = F.col("view") + F.col("cart") + F.col("purchase")
    sessions = counts.filter(total > 0)
    most = F.greatest(*[F.col(t) for t in TYPES])
    dominant = F.when(F.col("cart") == most, "cart").when(F.col("purchase") == most, "purchase").otherwise("view")
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("event_type"),
                F.col(t).alias("events"),
                (F.col(t) / total).alias("share"),
                (dominant == t).alias("dominant"),
                (F.col(t) == total).alias("only"),
            )
            for t in TYPES
        ]
    )
    long = sessions.select(F.inline(rows))
    stats = long.groupBy("event_type").agg(
        F.sum("events").alias("n_events"),
        F.avg("share").alias("mean_share"),
        F.count_if("dominant").alias("dominant_sessions"),
        F.count_if("only").alias("single_type_sessions"),
        F.count(F.lit(1)).alias("n_sessions"),
    )
    return stats.join(exact_quantiles(long, ["event_type"], "share", {"median_share": 0.5}), "event_type")


def repeat_rate(df: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Mean over users of one minus distinct items over events, and shares of users above 0 and above one half."""
    rows = df if types is None else df.filter(F.col("event_type").isin(list(types)))
    users = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("d"))
    rate = F.when(F.col("n") > 1, 1 - F.col("d") / F.col("n")).otherwise(F.lit(0.0))
    return users.select(rate.alias("r")).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("r").alias("mean_rate"),
        F.avg((F.col("r") > 0).cast("double")).alias("share_any"),
        F.avg((F.col("r") > 0.5).cast("double")).alias("share_above_half"),
    )


def pair_repeat_histogram(df: DataFrame) -> DataFrame:
    """Number of (user, item) pairs by number of events, two and more, and their share of all pairs."""
    times = df.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("events")).groupBy("events").agg(
        F.count(F.lit(1)).alias("pairs")
    )
    every = scalar(times, F.sum("pairs"))
    return times.filter(F.col("events") > 1).withColumn("share", F.col("pairs") / every)


def count_distribution(df: DataFrame, key: str, distinct: str | None = None) -> DataFrame:
    """Distribution of the number of events (or of distinct values of a column) per key, with three shares."""
    size = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    counts = df.groupBy(key).agg(size.alias("size"))
    n = F.col("size")
    shares = counts.agg(
        F.avg((n == 1).cast("double")).alias("share_1"),
        F.avg((n <= 5).cast("double")).alias("share_le5"),
        F.avg((n > 50).cast("double")).alias("share_gt50"),
    )
    row = shares.select(F.struct("*").alias("s")).scalar()
    return describe(counts, "size").withColumn("_s", row).select("*", "_s.*").drop("_s")


def head_coverage(df: DataFrame, shares: Sequence[float] = (0.01, 0.1)) -> DataFrame:
    """Share of all events that fall on the most popular items, for several shares of the catalog."""
    counts = df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = sorted_index(counts, [F.desc("n"), F.asc("item_id")], "place")
    items = scalar(ranked, F.count(F.lit(1)))
    sums = ranked.agg(
        F.sum("n").alias("all"),
        *[
            F.sum(F.when(F.col("place") < F.floor(items * F.lit(p)), F.col("n")).otherwise(0)).alias(f"s{i}")
            for i, p in enumerate(shares)
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(p)).alias("item_share"), (F.col(f"s{i}") / F.col("all")).alias("coverage"))
            for i, p in enumerate(shares)
        ]
    )
    return sums.select(F.inline(rows))


def time_gaps(df: DataFrame) -> DataFrame:
    """Days between consecutive events of a user: distribution, coefficient of variation and four classes."""
    hour = F.date_trunc("hour", F.col("event_time"))
    gaps = gaps_to_previous(df, ["user_id"], "event_time", "event_time", hour).select(
        (F.col("gap_us") / 86400e6).alias("gap")
    )
    g = F.col("gap")
    classes = gaps.agg(
        F.count_if(g < 1).alias("lt_1d"),
        F.count_if((g >= 1) & (g < 7)).alias("d1_7"),
        F.count_if((g >= 7) & (g < 30)).alias("d7_30"),
        F.count_if(g >= 30).alias("ge_30d"),
    )
    row = classes.select(F.struct("*").alias("c")).scalar()
    return (
        describe(gaps, "gap")
        .withColumn("cv", F.col("std") / F.col("mean"))
        .withColumn("_c", row)
        .select("*", "_c.*")
        .drop("_c")
    )


def calendar_profile(df: DataFrame, by: str = "hour", exclude: tuple[str, str] | None = None) -> DataFrame:
    """Events by type and purchase rate per hour or weekday; empty slots are kept, dates can be left out.

    The slots are the 24 hours or 7 weekdays, so the final join is between two tiny tables.
    """
    if by not in ("hour", "dow"):
        raise ValueError("by must be 'hour' or 'dow'")
    rows = with_calendar(df)
    if exclude is not None:
        rows = rows.filter(~F.col("date").between(F.lit(exclude[0]).cast("date"), F.lit(exclude[1]).cast("date")))
    counts = rows.groupBy(by).agg(*[count_of(t).alias(t) for t in TYPES])
    slots = df.sparkSession.range(24 if by == "hour" else 7).select(F.col("id").cast("int").alias(by))
    filled = slots.join(counts, by, "left").fillna(0, list(TYPES))
    total = F.col("view") + F.col("cart") + F.col("purchase")
    peak = scalar(counts, F.max_by(by, F.struct("purchase", -F.col(by))))
    return filled.withColumn("total", total).select(
        "*",
        (F.col("purchase") / F.nullif(F.col("total"), F.lit(0))).alias("purchase_rate"),
        F.coalesce(F.col(by) == peak, F.lit(False)).alias("is_peak"),
    )


def period_lift(df: DataFrame, start: str, end: str, baseline_start: str | None = None) -> DataFrame:
    """Daily mean per event type in a period against the seven days before it, and the median day of the baseline."""
    daily = daily_event_counts(df)
    date = F.col("date")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = date.between(first, last)
    week_before = (date >= F.date_sub(first, 7)) & (date < first)
    baseline = date < first
    if baseline_start:
        baseline = baseline & (date >= F.lit(baseline_start).cast("date"))
    rows = daily.select(
        "date", F.inline(F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(t).alias("n")) for t in TYPES]))
    )
    stats = rows.groupBy("event_type").agg(
        F.avg(F.when(week_before, F.col("n"))).alias("prior_mean"),
        F.avg(F.when(inside, F.col("n"))).alias("period_mean"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("period_total"),
        F.sum("n").alias("total"),
        # One value per day of the log at most, so this list is bounded by its length in days.
        F.median(F.when(baseline, F.col("n"))).alias("baseline_median"),
    )
    return stats.select(
        "*",
        (F.col("period_mean") / F.nullif(F.col("prior_mean"), F.lit(0.0))).alias("lift"),
        (F.col("period_total") / F.nullif(F.col("total"), F.lit(0))).alias("period_share"),
    )


def price_bins(df: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Purchases per price bin; empty bins are not listed."""
    binned = bucketize(F.col("price"), edges, labels, right=False)
    return df.filter(F.col("event_type") == "purchase").groupBy(binned.alias("price_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def price_by_category(df: DataFrame) -> DataFrame:
    """Number, mean and median price of purchases per second category token."""
    bought = df.filter(F.col("event_type") == "purchase").withColumn("cat_l2", category_token(F.col("category_code"), 2))
    bought = bought.filter(F.col("cat_l2").isNotNull())
    stats = bought.groupBy("cat_l2").agg(F.count("price").alias("n"), F.avg("price").alias("mean_price"))
    return stats.join(exact_quantiles(bought, ["cat_l2"], "price", {"median_price": 0.5}), "cat_l2", "left")


def price_by_type(df: DataFrame) -> DataFrame:
    """Number, mean and quantiles of the price per event type."""
    return describe(df, "price", {"median": 0.5, "p90": 0.9}, ["event_type"])


def price_distribution(df: DataFrame) -> DataFrame:
    """Number, mean, quantiles and zeros of purchase prices in one row."""
    bought = df.filter((F.col("event_type") == "purchase") & F.col("price").isNotNull())
    zero = scalar(bought, F.count_if(F.col("price") == 0))
    return describe(bought, "price", {"p10": 0.1, **TAIL}).withColumn("zero_price", zero)


def category_purchase_rate(df: DataFrame) -> DataFrame:
    """Events, purchases and purchases per hundred events of each second category token."""
    counts = (
        df.withColumn("cat_l2", category_token(F.col("category_code"), 2))
        .filter(F.col("cat_l2").isNotNull())
        .groupBy("cat_l2")
        .agg(F.count(F.lit(1)).alias("n_events"), count_of("purchase").alias("n_purchases"))
    )
    return counts.withColumn("rate_pct", F.col("n_purchases") / F.col("n_events") * 100)


def top_purchased(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The ``n`` values of a column with most purchases."""
    return (
        df.filter((F.col("event_type") == "purchase") & F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_purchases"))
        .orderBy(F.desc("n_purchases"), F.asc(column))
        .limit(n)
    )


def top_values_by_period(df: DataFrame, column: str, start: str, n: int = 10) -> DataFrame:
    """Most purchased values before and from ``start`` on; nulls count as a value."""
    period = F.when(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"), "during").otherwise("before")
    counts = (
        df.filter(F.col("event_type") == "purchase")
        .groupBy(period.alias("period"), F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_rows(counts, ["period"], [F.desc("n"), F.asc_nulls_last("value")], n)


def brand_category_diversity(df: DataFrame) -> DataFrame:
    """Distinct two-token categories per brand: number of brands, brands with one category, median, p90 and maximum."""
    known = df.filter(F.col("brand").isNotNull() & F.col("category_code").isNotNull())
    brands = known.groupBy("brand").agg(F.countDistinct(category_path(F.col("category_code"))).alias("n"))
    single = scalar(brands, F.count_if(F.col("n") == 1))
    return describe(brands, "n", {"median": 0.5, "p90": 0.9}).select(
        F.col("n").alias("n_brands"),
        single.alias("single_category"),
        (single / F.col("n")).alias("single_share"),
        "median",
        "p90",
        "max",
    )


def brand_set_categories(df: DataFrame, brands: Sequence[str], n: int = 3) -> DataFrame:
    """Most frequent first category token of some brands, per event type."""
    token = F.coalesce(category_token(F.col("category_code"), 1), F.lit("(none)"))
    counts = (
        df.filter(F.col("brand").isin(list(brands)))
        .groupBy("event_type", token.alias("l1"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_rows(counts, ["event_type"], [F.desc("n"), F.asc("l1")], n)


def price_band_hit(df: DataFrame, min_views: int = 5) -> DataFrame:
    """Of users with enough views and a purchase, how many buy within their usual price band."""
    views, buys = (df.filter((F.col("event_type") == t) & F.col("price").isNotNull()) for t in ("view", "purchase"))
    active = views.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_views)
    bands = exact_quantiles(views, ["user_id"], "price", QUARTILES)
    bought = exact_quantiles(buys, ["user_id"], "price", {"bought": 0.5})
    users = active.join(bands, "user_id").join(bought, "user_id")
    width = 1.5 * (F.col("p75") - F.col("p25"))
    return users.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("bought").between(F.col("p25"), F.col("p75"))).alias("in_iqr"),
        F.count_if(F.col("bought").between(F.col("p50") - width, F.col("p50") + width)).alias("in_band"),
    ).select(
        "*",
        (F.col("in_iqr") / F.nullif(F.col("n_users"), F.lit(0))).alias("in_iqr_share"),
        (F.col("in_band") / F.nullif(F.col("n_users"), F.lit(0))).alias("in_band_share"),
    )


def affinity_match(df: DataFrame, column: str, buyers_only: bool = False) -> DataFrame:
    """How often the value a buyer views most is the one bought most, against one over the median number of values."""
    known = df.filter(F.col(column).isNotNull())
    views = most_frequent(known.filter(F.col("event_type") == "view"), ["user_id"], [column])
    buys = most_frequent(known.filter(F.col("event_type") == "purchase"), ["user_id"], [column])
    both = views.withColumnRenamed(column, "_v").join(buys.withColumnRenamed(column, "_b"), "user_id")
    base = known.join(buys.select("user_id"), "user_id", "left_semi") if buyers_only else known
    distinct = base.groupBy("user_id").agg(F.countDistinct(column).alias("d"))
    median = exact_quantiles(distinct, [], "d", {"m": 0.5}).select("m").scalar()
    return both.agg(
        F.count(F.lit(1)).alias("n_buyers"), F.count_if(F.col("_v") == F.col("_b")).alias("n_match")
    ).select(
        "*",
        (F.col("n_match") / F.nullif(F.col("n_buyers"), F.lit(0))).alias("match_rate"),
        median.alias("median_distinct"),
        (1 / median).alias("random_rate"),
    )


def user_conversion_zero(df: DataFrame, min_views: int = 10) -> DataFrame:
    """Of users with enough views, how many never bought and how many never carted."""
    users = df.groupBy("user_id").agg(*[count_of(t).alias(t) for t in TYPES]).filter(F.col("view") >= min_views)
    return users.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("purchase") == 0).alias("zero_v2p"),
        F.count_if(F.col("cart") == 0).alias("zero_v2c"),
    )


def _session_gap_minutes(df: DataFrame) -> DataFrame:
    sessions = df.groupBy("user_id", "user_session").agg(
        F.min("event_time").alias("start"), F.max("event_time").alias("end")
    )
    hour = F.date_trunc("hour", F.col("start"))
    return gaps_to_previous(sessions, ["user_id"], "start", "end", hour).select((F.col("gap_us") / 60e6).alias("minutes"))


def session_gaps(df: DataFrame) -> DataFrame:
    """Minutes from the end of a session to the start of the user's next one: number, mean and median."""
    return describe(_session_gap_minutes(df), "minutes", {"median": 0.5}).select("n", "mean", "median")


def session_gap_buckets(df: DataFrame) -> DataFrame:
    """Number of such gaps per class."""
    label = bucketize(F.col("minutes"), SESSION_GAP_EDGES, SESSION_GAP_LABELS)
    return _session_gap_minutes(df).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sequence_lengths(train: DataFrame, low: int = 20, high: int = 200) -> DataFrame:
    """Percentiles of events per user with the share of users they cover, and the advised length from the 90th."""
    counts = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    levels = {"50": 0.5, "75": 0.75, "90": 0.9, "95": 0.95, "99": 0.99}
    row = exact_quantiles(counts, [], "size", {f"q{k}": p for k, p in levels.items()}).select(F.struct("*").alias("q")).scalar()
    covered = counts.withColumn("_q", row).agg(
        F.first("_q").alias("_q"),
        *[F.avg((F.col("size") <= F.floor(F.col(f"_q.q{k}"))).cast("double")).alias(f"c{k}") for k in levels],
    )
    advised = F.least(F.greatest(F.floor(F.col("_q.q90")), F.lit(low)), F.lit(high)).cast("int")
    rows = F.array(
        *[
            F.struct(
                F.lit(int(k)).alias("percentile"),
                F.floor(F.col(f"_q.q{k}")).cast("int").alias("length"),
                F.col(f"c{k}").alias("coverage"),
            )
            for k in levels
        ]
    )
    return covered.select(F.explode(rows).alias("r"), advised.alias("advised_length")).select("r.*", "advised_length")


def length_coverage(train: DataFrame, thresholds: Sequence[int] = tuple(range(5, 201, 5))) -> DataFrame:
    """Share of users with at most so many events, for several thresholds."""
    counts = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    sums = counts.agg(*[F.avg((F.col("size") <= t).cast("double")).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(int(t)).alias("threshold"), F.col(f"t{t}").alias("coverage")) for t in thresholds])
    return sums.select(F.inline(rows))


def active_users(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` users with most carts and purchases."""
    return (
        df.filter(F.col("event_type").isin("cart", "purchase"))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("activity"))
        .orderBy(F.desc("activity"), F.asc("user_id"))
        .limit(n)
    )
