"""Train and validation splits, evaluable users and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.distributed import sorted_index, top_rows
from basketry.runtime import days, require_columns, require_positive, scalar

PURCHASE = ("purchase",)


def cutoff_time(df: DataFrame, val_days: int = 7) -> Column:
    """Start of the validation period: the latest event minus ``val_days``."""
    require_positive(val_days=val_days)
    return scalar(df, F.max("event_time")) - days(val_days)


def time_based_split(
    df: DataFrame, val_days: int = 7, gt_types: Sequence[str] = PURCHASE
) -> tuple[DataFrame, DataFrame]:
    """Events up to the cutoff, and the later events of the target types."""
    require_columns(df, "user_id", "item_id", "event_time", "event_type")
    cutoff = cutoff_time(df, val_days)
    train = df.filter(F.col("event_time") <= cutoff)
    truth = df.filter((F.col("event_time") > cutoff) & F.col("event_type").isin(list(gt_types)))
    return train, truth


def leave_one_out_split(
    df: DataFrame, gt_types: Sequence[str] = PURCHASE, row_id: str = "event_id"
) -> tuple[DataFrame, DataFrame]:
    """Each user's last event of the target types, and everything else. ``row_id`` is unique and breaks ties.

    The last event is found by an aggregate and joined back on the row id, so no user is gathered in one task.
    """
    require_columns(df, "user_id", "event_time", "event_type", row_id)
    last = (
        df.filter(F.col("event_type").isin(list(gt_types)))
        .groupBy("user_id")
        .agg(F.max(F.struct("event_time", row_id))[row_id].alias(row_id))
        .select(row_id)
    )
    return df.join(last, row_id, "left_anti"), df.join(last, row_id, "left_semi")


def loo_sequence_split(df: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Label each event: the user's last is ``test``, the one before ``valid``, all others ``train``."""
    ends = top_rows(
        df.select("user_id", "event_time", row_id), ["user_id"], [F.desc("event_time"), F.desc(row_id)], 2, "_back"
    ).select(row_id, "_back")
    part = F.when(F.col("_back") == 1, "test").when(F.col("_back") == 2, "valid").otherwise("train")
    return df.join(ends, row_id, "left").withColumn("part", part).drop("_back")


def slice_by_date(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events in ``[start, end)``; an open side keeps everything."""
    return df.filter(_in_window(start, end))


def _in_window(start: str | Column | None, end: str | Column | None) -> Column:
    inside = F.lit(True)
    for bound, late in ((start, True), (end, False)):
        if bound is None:
            continue
        moment = (F.lit(bound) if isinstance(bound, str) else bound).cast("timestamp_ntz")
        inside = inside & (F.col("event_time") >= moment if late else F.col("event_time") < moment)
    return inside


def default_windows(spike_start: str | Column) -> dict[str, tuple]:
    """The whole period, the part before the spike and the spike itself."""
    return {"full": (None, None), "no_spike": (None, spike_start), "spike_only": (spike_start, None)}


def val_slices(truth: DataFrame, windows: dict[str, tuple]) -> DataFrame:
    """Truth rows labelled with every window they fall in, in one scan. Names without rows simply have none."""
    labels = [F.when(_in_window(start, end), F.lit(name)) for name, (start, end) in windows.items()]
    return truth.withColumn("slice", F.explode(F.array_compact(F.array(*labels))))


def eval_users(truth: DataFrame, train: DataFrame) -> DataFrame:
    """Users that have truth and were seen in training."""
    return truth.select("user_id").distinct().join(train.select("user_id").distinct(), "user_id", "left_semi")


def restrict(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the given users."""
    return df.join(users.select("user_id"), "user_id", "left_semi")


def ground_truth(truth: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct (user, item) truth of the evaluable users."""
    return restrict(truth.select("user_id", "item_id").distinct(), eval_users(truth, train))


def user_folds(df: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Balanced folds: users in the order of the md5 of ``seed:user_id``, dealt round robin."""
    require_positive(n=n)
    marked = F.md5(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")).cast("binary"))
    hashed = df.select("user_id").distinct().withColumn("_h", marked)
    dealt = sorted_index(hashed, ["_h", "user_id"], "_position")
    return dealt.select("user_id", F.pmod(F.col("_position"), F.lit(n)).cast("int").alias("fold"))


def user_coverage(df: DataFrame, cutoff: Column, target: DataFrame) -> DataFrame:
    """Numbers of users before the cutoff, from it on, in all and in the target list, and those absent after it."""
    per_user = df.groupBy("user_id").agg(
        F.bool_or(F.col("event_time") < cutoff).alias("_train"), F.bool_or(F.col("event_time") >= cutoff).alias("_val")
    )
    wanted = target.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_user.agg(
        F.count_if("_train").alias("train_users"),
        F.count_if("_val").alias("val_users"),
        F.count(F.lit(1)).alias("all_users"),
        F.count_if(~F.col("_val")).alias("missing_in_val"),
    ).select("*", wanted.alias("target_users"), (F.col("missing_in_val") / F.col("all_users")).alias("missing_share"))


def known_vs_cold(target: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target users with history, and those to be served from popularity."""
    have = known.select("user_id").distinct()
    return target.join(have, "user_id", "left_semi"), target.join(have, "user_id", "left_anti")
