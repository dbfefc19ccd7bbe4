"""The flagship job: ten items for every user for the week after the log, or after a training period."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketry.operators import neighbors, splits, submission, tifu
from basketry.runtime import cut
from basketry.sources.events import target_users


def next_week_top10(log: DataFrame, val_days: int | None = None, k: int = 10, near: int = 300, alpha: float = 0.7) -> DataFrame:
    """Decayed item frequencies of each user and of the ``near`` most similar users, best ``k``, filled up with popular items.

    The whole log is used. With ``val_days`` its last days are held out, as an evaluation needs it. Runs jobs.
    """
    train = log if val_days is None else splits.time_based_split(log, val_days)[0]
    vectors = cut(tifu.tifu_vectors(train))
    scores = tifu.tifu_scores(vectors, neighbors.user_knn(vectors, near), alpha, near, k)
    return submission.fill_with_popularity(scores, target_users(log), submission.popularity(train, 50), k)
