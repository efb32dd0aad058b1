"""Preparation of a learning set as one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .impute import mean_impute
from .scale import Moments, moments, zscore
from .split import random_split, stratified_split


def split_impute_scale(df: DataFrame, row_id: str, columns: Sequence[str], ratio: float = 0.8, seed: str = "42",
                       label: str | None = None, epsilon: float = 1e-8) -> tuple[DataFrame, DataFrame, Moments]:
    """(train, held out, statistics): split, fill nulls with train means, then scale.

    With ``label`` the split keeps the shares of its classes.  Nothing of the
    held-out rows enters a statistic.
    """
    if label is None:
        marked, train_side = random_split(df, row_id, ratio, seed), "is_train"
        train, held = marked.filter(train_side), marked.filter(f"not {train_side}")
    else:
        marked = stratified_split(df, row_id, label, 1 - ratio, seed)
        train, held = marked.filter("not is_test"), marked.filter("is_test")
    train, held = train.select(*df.columns), held.select(*df.columns)
    held, train = mean_impute(held, columns, train), mean_impute(train, columns)
    stats = moments(train, columns)
    return zscore(train, columns, stats, epsilon), zscore(held, columns, stats, epsilon), stats
