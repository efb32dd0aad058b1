"""Model selection: grid search over folds, splits and rebalancing strategies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import many
from .metrics import accuracy, binary_scores, confusion, labels_of, precision_recall_f1
from .resample import class_weights, oversample, smote, undersample


def score(df: DataFrame, truth: str, prediction: str, metric: str = "f1") -> float:
    """accuracy; or precision, recall, f1: binary for two labels, else macro."""
    if metric == "accuracy":
        return df.transform(lambda d: accuracy(d, truth, prediction)).first()[0]
    labels = labels_of(df, truth, truth)
    row = binary_scores(df, truth, prediction).first() if len(labels) == 2 else precision_recall_f1(confusion(df, truth, prediction), ["macro"]).first()
    return float(row[metric]) if row else 0.0


def grid_search(df: DataFrame, fold: str, truth: str, configs: Sequence[dict], fit: Callable, metric: str = "f1", prepare: Callable | None = None):
    """(best config, results, refitted model).

    ``fit(train, **config)`` returns an object with ``predict() -> Column``;
    ``prepare(train, validation)`` may preprocess both.  Results are (config,
    mean, population std, fold scores); the first best mean wins.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] >= 0)
    results = []
    for config in configs:
        scores = []
        for i in folds:
            train, held = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
            if prepare:
                train, held = prepare(train, held)
            model = fit(train, **config)
            scores.append(score(held.withColumn("_p", model.predict()), truth, "_p", metric))
        results.append((config, float(np.mean(scores)), float(np.std(scores)), scores))
    best = max(results, key=lambda r: r[1])
    return best[0], results, fit(df, **best[0])


def cross_validate(df: DataFrame, xs: Sequence[str], y: str, train: Column, held: Column, configs: Sequence[tuple[float, float]], splits: int,
                   rounds: int, metric: str = "f1", scale: bool = False) -> tuple[list, many.Models]:
    """Logistic models of every (rate, penalty) on every split, in as many jobs as rounds.

    ``train`` and ``held`` are arrays with a flag for each split.  Returns
    (config, mean, population std, scores) for each config, and the config with
    the first best mean fitted to all rows (as the last of the models).  With
    ``scale`` every split has a scaler of its own training rows.
    """
    every = F.concat(F.transform(train, lambda t: t.cast("boolean")), F.array(F.lit(True)))
    members = [many.Config(i, *c) for c in configs for i in range(splits)] + [many.Config(splits, *c) for c in configs]
    models = many.fit(df, xs, y, every, members, rounds, scale)
    judged = F.concat(F.transform(held, lambda h: h.cast("boolean")), F.array(F.lit(False)))
    found = many.scores(many.confusions(df, models, y, judged), metric)[: len(configs) * splits].reshape(len(configs), splits)
    results = [(c, float(np.mean(f)), float(np.std(f)), list(f)) for c, f in zip(configs, found, strict=True)]
    best = max(range(len(configs)), key=lambda i: (round(results[i][1], 12), -i))
    whole = len(configs) * splits + best
    return results, many.Models(models.features, models.classes, (members[whole],), models.weights[:, [whole]])


STRATEGIES = ("none", "undersample", "oversample", "smote", "cost")


def rebalanced(train: DataFrame, row_id: str, xs: Sequence[str], y: str, k: int = 5, seed: str = "42") -> DataFrame:
    """(xs, y, sets): the rows of all ``STRATEGIES`` together, with their weight in each.

    none: as they are; undersample: classes cut to the smallest; oversample:
    drawn copies; smote: synthetic rows; cost: n / (2 n of the class).
    """
    cost = {r[0]: r[2] for r in class_weights(train, y).select("label", "n", "weight").collect()}
    weight = F.coalesce(*[F.when(F.col(y) == F.lit(c), F.lit(float(w))) for c, w in cost.items()])
    one, zero = F.lit(1.0), F.lit(0.0)
    few = undersample(train, row_id, y, seed).select(F.col(row_id).alias("_kept"))
    own = train.join(few, F.col(row_id) == F.col("_kept"), "left")
    own = own.select(*xs, y, F.array(one, F.col("_kept").isNotNull().cast("double"), one, one, weight).alias("sets"))
    copies = oversample(train, row_id, y, seed).filter("copy > 0").select(*xs, y, F.array(zero, zero, one, zero, zero).alias("sets"))
    made = smote(train.withColumn("_v", F.array(*[F.col(c).cast("double") for c in xs])), row_id, y, "_v", k, seed)
    made = made.select(*[F.col("vector")[i].alias(c) for i, c in enumerate(xs)], F.col("label").alias(y), F.array(zero, zero, zero, one, zero).alias("sets"))
    return own.unionByName(copies).unionByName(made)


def compare_rebalancing(train: DataFrame, held: DataFrame, row_id: str, xs: Sequence[str], y: str, rate: float, penalties: Sequence[float], rounds: int,
                        metric: str = "f1", k: int = 5, seed: str = "42") -> list[tuple[str, float, float, bool]]:
    """(strategy, penalty, score on ``held``, whether it is the strategy's best) of every strategy and penalty.

    All models are fitted together; of equal scores the first penalty is best.
    """
    members = [many.Config(i, rate, p) for i in range(len(STRATEGIES)) for p in penalties]
    models = many.fit(rebalanced(train, row_id, xs, y, k, seed), xs, y, F.col("sets"), members, rounds)
    judged = F.array(*[F.lit(True)] * len(STRATEGIES))
    found = many.scores(many.confusions(held, models, y, judged), metric).reshape(len(STRATEGIES), len(penalties))
    return [(s, p, float(found[i, j]), j == int(np.round(found[i], 12).argmax())) for i, s in enumerate(STRATEGIES) for j, p in enumerate(penalties)]
