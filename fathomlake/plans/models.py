"""Models: linear, logistic, discriminant, trees, clusters, components, networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dbscan, gmm, kmeans, lda, linear, logistic, metrics, mlp, pca, select, silhouette, split, tree, vae
from ..operators.gram import gram, moments_of
from ..sources.readers import table
from .base import finish, key_sql, query, r, rows, uniform_sql

# ---------------------------------------------------------------- regression

_REG = "(select l_quantity / 50 as q, l_discount * 10 as d, l_extendedprice / 1000 as y, l_orderkey % 4 as g, l_orderkey from lineitem)"


def _reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 4).alias("g"))


@query(f"select 'intercept' as term, {r('regr_intercept(y, q)', 4)} as weight from {_REG} union all select 'q', {r('regr_slope(y, q)', 4)} from {_REG}")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(linear.fit_ols(_reg(spark, sf_dir), ["q"], "y").coefficients(spark), 4)


_CRAMER = f"""m as (select avg(q) mq, avg(d) md, avg(y) my, covar_pop(q, q) a, covar_pop(q, d) b, covar_pop(d, d) c, covar_pop(q, y) e, covar_pop(d, y) f from {_REG}),
  w as (select (e * c - b * f) / (a * c - b * b) w1, (a * f - b * e) / (a * c - b * b) w2, mq, md, my from m)"""


@query(f"with {_CRAMER} select 'intercept' as term, {r('my - w1 * mq - w2 * md', 4)} as weight from w union all select 'q', {r('w1', 4)} from w union all select 'd', {r('w2', 4)} from w")
def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(linear.fit_ols(_reg(spark, sf_dir), ["q", "d"], "y").coefficients(spark), 4)


@query(f"""with {_CRAMER.replace(_REG, '(select q, q * q as d, y from ' + _REG + ')')} select 0::bigint as place, {r('my - w1 * mq - w2 * md', 4)} as weight from w
  union all select 1, {r('w1', 4)} from w union all select 2, {r('w2', 4)} from w""")
def basis_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = linear.fit_basis(_reg(spark, sf_dir), [F.col("q"), F.col("q") * F.col("q")], "y")
    return finish(rows(spark, [(i, float(v)) for i, v in enumerate(w)], "place bigint, weight double"), 4)


_SUMS = "s as (select count(*)::double n, sum({x})::double sx, sum({x} * {x})::double sxx, sum(y)::double sy, sum({x} * y)::double sxy, sum(y * y)::double syy from {src})"


def _fold_sql(rounds: int, rate: str, l1: str = "0", l2: str = "0") -> str:
    """One-feature gradient descent as a fold over the sums of ``s``."""
    return (f"list_reduce(list_transform(range({rounds}), lambda i: [0.0::double, 0.0::double]), lambda w, i: [" + ", ".join(
        f"w[{k}] - {rate} * ({g} + {l1} * sign(w[{k}]) + {l2} * w[{k}])" for k, g in
        ((1, "(-2 / n * (sy - n * w[1] - sx * w[2]))"), (2, "(-2 / n * (sxy - sx * w[1] - sxx * w[2]))"))) + "], [0.0::double, 0.0::double])")


@query(f"""with {_SUMS.format(x='q', src=_REG)}, w as (select {_fold_sql(200, '0.05::double')} w from s)
  select 'intercept' as term, {r('w[1]', 4)} as weight from w union all select 'q', {r('w[2]', 4)} from w""")
def gd_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = linear.fit_gd(_reg(spark, sf_dir), ["q"], "y", rate=0.05, rounds=200, tolerance=0.0)
    return finish(model.coefficients(spark), 4)


_PENALTIES = [0.0, 0.1, 1.0]


def _path_sql(kind: str) -> str:
    parts = []
    for p in _PENALTIES:
        fold = _fold_sql(100, "0.05::double", **{"l2" if kind == "ridge" else "l1": f"{p}::double"})
        parts += [f"select {p}::double as penalty, 'intercept' as term, {r(f'({fold})[1]', 4)} as weight from s", f"select {p}::double, 'q', {r(f'({fold})[2]', 4)} from s"]
    return f"with {_SUMS.format(x='q', src=_REG)} " + " union all ".join(parts)


def _path(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = linear.penalty_path(gram(_reg(spark, sf_dir), ["q"], "y"), _PENALTIES, kind, rate=0.05, rounds=100, tolerance=0.0)
    return finish(rows(spark, [(p, t, float(v)) for p, w in found.items() for t, v in zip(["intercept", "q"], w, strict=True)], "penalty double, term string, weight double"), 4)


@query(_path_sql("ridge"))
def ridge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, "ridge")


@query(_path_sql("lasso"))
def lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, "lasso")


def _holdout_sql() -> str:
    train = _SUMS.format(x="q", src=f"(select * from {_REG} where g <> 0)")
    held = _SUMS.format(x="q", src=f"(select * from {_REG} where g = 0)").replace("s as", "h as", 1)
    held = held.replace(" n,", " hn,").replace(" sx,", " hx,").replace(" sxx,", " hxx,").replace(" sy,", " hy,").replace(" sxy,", " hxy,").replace(" syy from", " hyy from")
    error = "(hyy - 2 * (w[1] * hy + w[2] * hxy) + w[1] * w[1] * hn + 2 * w[1] * w[2] * hx + w[2] * w[2] * hxx) / hn"
    parts = [f"select {p}::double as penalty, {r(error, 4)} as mse from (select {_fold_sql(100, '0.05::double', l2=f'{p}::double')} w from s), h" for p in _PENALTIES]
    return f"with {train}, {held} " + " union all ".join(parts)


@query(_holdout_sql())
def lambda_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _reg(spark, sf_dir)
    found = gram(d.withColumn("held", (F.col("g") == 0).cast("int")), ["q"], "y", "held")
    scores = linear.holdout_penalty(found[0], found[1], _PENALTIES, rate=0.05, rounds=100, tolerance=0.0)
    return finish(rows(spark, [(p, float(e)) for p, e in scores], "penalty double, mse double"), 4)


def _cv_sql() -> str:
    ctes, selects = [], []
    for k in range(4):
        src = f"(select (q - m) / sd as x, y, g from {_REG}, (select avg(q) m, stddev_samp(q) sd from {_REG} where g <> {k}) where g {{op}} {k})"
        t = _SUMS.format(x="x", src=src.format(op="<>")).replace("s as", f"t{k} as", 1)
        ctes.append(t)
        ctes.append(f"h{k} as (select count(*)::double hn, sum(x) hx, sum(x * x) hxx, sum(y) hy, sum(x * y) hxy, sum(y * y) hyy from {src.format(op='=')})")
        error = "(hyy - 2 * (w[1] * hy + w[2] * hxy) + w[1] * w[1] * hn + 2 * w[1] * w[2] * hx + w[2] * w[2] * hxx) / hn"
        for p in _PENALTIES:
            selects.append(f"select {p}::double penalty, {error} e from (select {_fold_sql(60, '0.05::double', l2=f'{p}::double')} w from t{k}), h{k}")
    return f"with {', '.join(ctes)}, u as ({' union all '.join(selects)}) select penalty, {r('avg(e)', 4)} as mse from u group by penalty"


@query(_cv_sql())
def lambda_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = gram(_reg(spark, sf_dir), ["q"], "y", "g")
    scores = linear.cross_validated_penalty(folds, _PENALTIES, rate=0.05, rounds=60, tolerance=0.0)
    return finish(rows(spark, [(p, float(e)) for p, e in scores], "penalty double, mse double"), 4)


@query(f"select p_partkey, {r('(select regr_intercept(p_retailprice, p_size) from part) + (select regr_slope(p_retailprice, p_size) from part) * p_size', 4)} as price from part")
def predict_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))
    model = linear.fit_ols(p, ["size"], "p_retailprice")
    return finish(p.select("p_partkey", model.predict().alias("price")), 4)


@query(f"select {r('avg(l_extendedprice / l_quantity)')} as price_per_unit from lineitem where l_returnflag = 'N'")
def price_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'")
    return finish(d.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_unit")))


# ------------------------------------------------------------ classification

_LOG = "(select (c_acctbal - 4500) / 3000 as a, (c_custkey % 17) / 17.0::double as b, (c_acctbal + (c_custkey % 17) * 300 > 7000)::int as y, c_custkey from customer)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(((F.col("c_acctbal") - 4500) / 3000).alias("a"), ((F.col("c_custkey") % 17) / F.lit(17.0)).alias("b"),
                    (F.col("c_acctbal") + (F.col("c_custkey") % 17) * 300 > 7000).cast("int").alias("y"), "c_custkey")


def _logistic_sql(rounds: int, rate: float, penalty: float, weighted: bool, source: str = _LOG) -> str:
    weight = "(case when y = 1 then n / (2.0::double * n1) else n / (2.0::double * (n - n1)) end)" if weighted else "1.0::double"
    ctes = [f"d as (select * from {source})", "c as (select count(*)::double n, sum(y)::double n1 from d)", "w0 as (select 0.0::double w, 0.0::double u, 0.0::double v)"]
    for i in range(rounds):
        ctes.append(f"""w{i + 1} as (select any_value(w) - {rate} * sum(e) / any_value(n) as w, any_value(u) - {rate} * (sum(e * a) / any_value(n) + {penalty} / any_value(n) * any_value(u)) as u,
          any_value(v) - {rate} * (sum(e * b) / any_value(n) + {penalty} / any_value(n) * any_value(v)) as v
          from (select a, b, w, u, v, n, (1 / (1 + exp(-(w + u * a + v * b))) - y) * {weight} as e from d, c, w{i}))""")
    return f"with {', '.join(ctes)} select 'intercept' as term, {r('w', 4)} as weight from w{rounds} union all select 'a', {r('u', 4)} from w{rounds} union all select 'b', {r('v', 4)} from w{rounds}"


def _terms(spark: SparkSession, model) -> DataFrame:
    names = ["intercept", *model.features]
    return finish(rows(spark, [(t, float(w)) for t, w in zip(names, model.weights[:, 0], strict=True)], "term string, weight double"), 4)


@query(_logistic_sql(8, 0.5, 0.1, False))
def logistic_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, logistic.fit(_log(spark, sf_dir), ["a", "b"], "y", 0.5, 8, 0.1))


@query(_logistic_sql(8, 0.5, 0.0, True))
def logistic_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, logistic.fit(_log(spark, sf_dir), ["a", "b"], "y", 0.5, 8, 0.0, "balanced"))


def _fitted_sql(rounds: int, rate: float, penalty: float, source: str) -> str:
    return _logistic_sql(rounds, rate, penalty, False, source).rsplit(" select 'intercept'", 1)[0]


@query(_fitted_sql(8, 0.5, 0.1, _LOG) + f" select c_custkey, {r('1 / (1 + exp(-(w + u * a + v * b)))', 4)} as probability, (w + u * a + v * b >= 0)::int as prediction from d, w8")
def logistic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _log(spark, sf_dir)
    model = logistic.fit(d, ["a", "b"], "y", 0.5, 8, 0.1)
    return finish(d.select("c_custkey", model.probabilities()[1].alias("probability"), model.predict().cast("int").alias("prediction")), 4)


def _grid_sql(rates: tuple, penalties: tuple, rounds: int, folds: int) -> str:
    cells = []
    for rate in rates:
        for penalty in penalties:
            for k in range(folds):
                fitted = _fitted_sql(rounds, rate, penalty, f"(select * from {_LOG} where c_custkey % {folds} <> {k})")
                cells.append(f"""select {rate}::double rate, {penalty}::double penalty, {k} k, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from ({fitted}
                  select count(*) filter (p = 1 and y = 1) tp, count(*) filter (p = 1 and y = 0) fp, count(*) filter (p = 0 and y = 1) fn
                  from (select h.y, (w + u * h.a + v * h.b >= 0)::int p from {_LOG} h, w{rounds} where h.c_custkey % {folds} = {k}))""")
    cells = " union all ".join(cells)
    return f"""with s as ({cells}), m as (select rate, penalty, avg(f1) mean, stddev_pop(f1) std from s group by 1, 2)
      select rate, penalty, {r('mean')} as mean_f1, {r('std')} as std_f1, row_number() over (order by round(mean, 12) desc, rate, penalty) = 1 as is_best from m"""


def _softmax_sql(rounds: int, rate: float) -> str:
    src = "(select a, (case when a < -0.5 then 0 when a < 0.5 then 1 else 2 end) as y from " + _LOG + ")"
    ctes = [f"d as (select * from {src})", "c as (select count(*)::double n from d)", "w0 as (select " + ", ".join(f"0.0::double w{k}, 0.0::double u{k}" for k in range(3)) + ")"]
    for i in range(rounds):
        zs = ", ".join(f"exp(w{k} + u{k} * a) as e{k}" for k in range(3))
        keep = ", ".join(f"w{k}, u{k}" for k in range(3))
        sums = ", ".join(f"any_value(w{k}) - {rate} * sum(e{k} / (e0 + e1 + e2) - (y = {k})::int) / any_value(n) as w{k}, any_value(u{k}) - {rate} * sum((e{k} / (e0 + e1 + e2) - (y = {k})::int) * a) / any_value(n) as u{k}" for k in range(3))
        ctes.append(f"w{i + 1} as (select {sums} from (select a, y, n, {keep}, {zs} from d, c, w{i}))")
    selects = [f"select {k} as class, 'intercept' as term, {r(f'w{k}', 4)} as weight from w{rounds} union all select {k}, 'a', {r(f'u{k}', 4)} from w{rounds}" for k in range(3)]
    return f"with {', '.join(ctes)} " + " union all ".join(selects)


@query(_softmax_sql(6, 0.5))
def softmax_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _log(spark, sf_dir).withColumn("y", F.when(F.col("a") < -0.5, 0).when(F.col("a") < 0.5, 1).otherwise(2))
    w = logistic.fit(d, ["a"], "y", 0.5, 6).weights
    return finish(rows(spark, [(k, t, float(w[i, k])) for k in range(3) for i, t in enumerate(["intercept", "a"])], "class int, term string, weight double"), 4)


@query(_grid_sql((0.1, 1.0), (0.0, 1.0), 4, 3))
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, fold = _log(spark, sf_dir), F.col("c_custkey") % 3
    configs = [(rate, p) for rate in (0.1, 1.0) for p in (0.0, 1.0)]
    results, best = select.cross_validate(d, ["a", "b"], "y", F.array(*[fold != i for i in range(3)]), F.array(*[fold == i for i in range(3)]), configs, 3, 4)
    chosen = (best.configs[0].rate, best.configs[0].penalty)
    out = [(float(c[0]), float(c[1]), mean, std, c == chosen) for c, mean, std, _ in results]
    return finish(rows(spark, out, "rate double, penalty double, mean_f1 double, std_f1 double, is_best boolean"))


_CV = "(select c_custkey, c_acctbal as a, (c_custkey % 17)::double as b, (c_acctbal + (c_custkey % 17) * 300 > 7000)::int as y from customer)"


def _repeated_sql(rate: float, penalties: tuple, rounds: int, repeats: int) -> str:
    """Every split scaled by its own training rows; all models of a round in one statement."""
    ctes = [f"src as (select * from {_CV})", f"k as (select *, unnest(range({repeats})) as split from src)",
            f"ranked as (select *, row_number() over (partition by split order by {key_sql("c_custkey::varchar || '-' || split::varchar")}) <= floor(0.8::double * (select count(*) from src)) as train from k)",
            "mom as (select split, avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb, count(*)::double n from ranked where train group by split)",
            "d as (select split, train, y, n, (a - ma) / sa as a, (b - mb) / sb as b from ranked join mom using (split))",
            f"w0 as (select split, penalty, 0.0::double w, 0.0::double u, 0.0::double v from mom, (values {', '.join(f'({p}::double)' for p in penalties)}) p(penalty))"]
    for i in range(rounds):
        ctes.append(f"""w{i + 1} as (select split, penalty, any_value(w) - {rate} * sum(e) / any_value(n) as w, any_value(u) - {rate} * (sum(e * a) / any_value(n) + penalty / any_value(n) * any_value(u)) as u,
          any_value(v) - {rate} * (sum(e * b) / any_value(n) + penalty / any_value(n) * any_value(v)) as v
          from (select split, penalty, a, b, w, u, v, n, 1 / (1 + exp(-(w + u * a + v * b))) - y as e from d join w{i} using (split) where train) group by split, penalty)""")
    ctes.append(f"f as (select split, penalty, coalesce(2.0::double * count(*) filter (p = 1 and y = 1) / nullif(2 * count(*) filter (p = 1 and y = 1) + count(*) filter (p <> y), 0), 0) f1 from (select split, penalty, y, (w + u * a + v * b >= 0)::int p from d join w{rounds} using (split) where not train) group by split, penalty)")
    return f"with {', '.join(ctes)} select penalty, {r('avg(f1)')} as mean_f1, {r('stddev_pop(f1)')} as std_f1, count(*) as n_splits from f group by penalty"


@query(_repeated_sql(1.0, (0.0, 10.0), 5, 4))
def repeated_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    d = c.select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 17).cast("double").alias("b"), (F.col("c_acctbal") + (F.col("c_custkey") % 17) * 300 > 7000).cast("int").alias("y"))
    marked = split.split_flags(d, "c_custkey", 4)
    held = F.transform("is_train", lambda t: ~t)
    results, _ = select.cross_validate(marked, ["a", "b"], "y", F.col("is_train"), held, [(1.0, 0.0), (1.0, 10.0)], 4, 5, scale=True)
    out = [(float(c[1]), mean, std, len(found)) for c, mean, std, found in results]
    return finish(rows(spark, out, "penalty double, mean_f1 double, std_f1 double, n_splits long"))


def _rebalancing_sql(rate: float, penalties: tuple, rounds: int, k: int = 5) -> str:
    def pick(n: str, at: int = 1) -> str:
        return f"least(floor({uniform_sql('key', at)} * {n}) + 1, {n})"

    ctes = [
        "base as (select doc_id, toxic as y, ln(1 + n_chars::double) as x, quality::double as q from labels join (select doc_id, n_chars from documents) using (doc_id))",
        f"t as (select *, row_number() over (partition by y order by {key_sql('doc_id::varchar')}) rn, count(*) over (partition by y) n from base where doc_id % 4 > 0)",
        "m as (select max(n) mx, min(n) mn from t)", "c as (select distinct y as label, n from t)",
        "dr as (select label, n, unnest(range(1, (mx - n + 1)::bigint)) as draw from c, m where n < mx)",
        "kk as (select *, md5(label::varchar || '-' || draw::varchar || '-42') as key from dr)",
        f"copies as (select t.x, t.q, t.y from kk join t on t.y = kk.label and t.rn = {pick('kk.n')})",
        f"p as (select label, draw, {uniform_sql('key', 17)} as alpha, {pick('n')} as b, {pick(f'greatest(1, least({k}, n - 1))', 9)} as j from kk)",
        "small as (select t.* from t, m where t.n < m.mx)",
        "nn as (select a.doc_id f, b.doc_id id, row_number() over (partition by a.doc_id order by sqrt((b.x - a.x) * (b.x - a.x) + (b.q - a.q) * (b.q - a.q)), b.doc_id) rk from small a join small b on a.y = b.y and a.doc_id <> b.doc_id)",
        "made as (select t.x + alpha * (o.x - t.x) as x, t.q + alpha * (o.q - t.q) as q, t.y from p join t on t.y = p.label and t.rn = p.b join nn on nn.f = t.doc_id and nn.rk = p.j join t o on o.doc_id = nn.id)",
        "one as (select x, q, y, n, rn from t)",
        """tr as (select 'none' s, x, q, y, 1.0::double wt from one union all select 'undersample', x, q, y, 1.0 from one, m where rn <= mn
          union all select 'oversample', x, q, y, 1.0 from one union all select 'oversample', x, q, y, 1.0 from copies
          union all select 'smote', x, q, y, 1.0 from one union all select 'smote', x, q, y, 1.0 from made
          union all select 'cost', x, q, y, (select count(*) from one) / (2.0::double * n) from one)""",
        "sizes as (select s, count(*)::double n from tr group by s)",
        f"w0 as (select s, penalty, 0.0::double w, 0.0::double u, 0.0::double v from sizes, (values {', '.join(f'({p}::double)' for p in penalties)}) z(penalty))"]
    for i in range(rounds):
        ctes.append(f"""w{i + 1} as (select s, penalty, any_value(w) - {rate} * sum(e) / any_value(n) as w, any_value(u) - {rate} * (sum(e * x) / any_value(n) + penalty / any_value(n) * any_value(u)) as u,
          any_value(v) - {rate} * (sum(e * q) / any_value(n) + penalty / any_value(n) * any_value(v)) as v
          from (select s, penalty, x, q, w, u, v, n, (1 / (1 + exp(-(w + u * x + v * q))) - y) * wt as e from tr join w{i} using (s) join sizes using (s)) group by s, penalty)""")
    ctes.append(f"""f as (select s, penalty, coalesce(2.0::double * count(*) filter (p = 1 and y = 1) / nullif(2 * count(*) filter (p = 1 and y = 1) + count(*) filter (p <> y), 0), 0) f1
      from (select s, penalty, y, (w + u * x + v * q >= 0)::int p from base, w{rounds} where doc_id % 4 = 0) group by s, penalty)""")
    return f"with {', '.join(ctes)} select s as strategy, penalty, {r('f1')} as f1, row_number() over (partition by s order by round(f1, 12) desc, penalty) = 1 as is_best from f"


@query(_rebalancing_sql(1.0, (0.0, 1.0, 10.0), 20))
def rebalancing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select("doc_id", F.col("toxic").alias("y"), F.log1p(F.col("n_chars").cast("double")).alias("x"), F.col("quality").cast("double").alias("q"))
    train, held = d.filter("doc_id % 4 > 0"), d.filter("doc_id % 4 = 0")
    found = select.compare_rebalancing(train, held, "doc_id", ["x", "q"], "y", 1.0, (0.0, 1.0, 10.0), 20)
    return finish(rows(spark, found, "strategy string, penalty double, f1 double, is_best boolean"))


_LDA = "(select vec_id, embedding[1]::double as x, embedding[2]::double as y, label from embeddings)"
_LDA_CTES = f"""d as (select * from {_LDA}), g as (select label, count(*)::double n, avg(x) mx, avg(y) my from d group by label),
  t as (select sum(n) n, count(*) k from g), s as (select sum((x - mx) ** 2) / (any_value(t.n) - any_value(k)) a, sum((x - mx) * (y - my)) / (any_value(t.n) - any_value(k)) b, sum((y - my) ** 2) / (any_value(t.n) - any_value(k)) c from d join g using (label), t)"""


def _lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


@query(f"with {_LDA_CTES} select label, {r('g.n / t.n')} as prior, {r('mx')} as mean_x, {r('my')} as mean_y, {r('a')} as var_x, {r('b')} as cov_xy, {r('c')} as var_y from g, t, s")
def lda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lda.fit(_lda(spark, sf_dir), ["x", "y"], "label")
    c = m.covariance
    out = [(int(k), float(p), *map(float, mean), float(c[0, 0]), float(c[0, 1]), float(c[1, 1])) for k, p, mean in zip(m.classes, m.priors, m.means, strict=True)]
    return finish(rows(spark, out, "label int, prior double, mean_x double, mean_y double, var_x double, cov_xy double, var_y double"))


@query(f"""with {_LDA_CTES}, f as (select vec_id, g.label k, g.n / t.n * exp(-0.5::double * (c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b)) p from d, g, t, s)
  select vec_id, {r('max(p) / sum(p)')} as probability, arg_max(k, p)::int as prediction from f group by vec_id""")
def lda_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lda(spark, sf_dir)
    m = lda.fit(d, ["x", "y"], "label")
    return finish(d.select("vec_id", F.array_max(m.probabilities()).alias("probability"), m.predict().alias("prediction")))


_TREE = "(select o_orderkey, (o_orderkey % 50)::double as f0, (o_custkey % 30)::double as f1, ((o_orderkey % 50) > 20 and (o_custkey % 30) < 12 or o_orderkey % 11 = 0)::int as y from orders)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    y = ((F.col("o_orderkey") % 50 > 20) & (F.col("o_custkey") % 30 < 12)) | (F.col("o_orderkey") % 11 == 0)
    return o.select("o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("f0"), (F.col("o_custkey") % 30).cast("double").alias("f1"), y.cast("int").alias("y"))


def _split_sql(source: str) -> str:
    h = "-(({a}) / ({n}) * log2(({a}) / ({n}) + 1e-15) + (({n}) - ({a})) / ({n}) * log2((({n}) - ({a})) / ({n}) + 1e-15))"
    return f"""(with t as (select 0 as feature, f0 as v, y from {source} union all select 1, f1, y from {source}), c as (select feature, v, count(*)::double n, sum(y)::double p from t group by 1, 2),
      k as (select feature, v, sum(n) over w ln, sum(p) over w lp, sum(n) over z n, sum(p) over z p from c window w as (partition by feature order by v), z as (partition by feature)),
      g as (select feature, v as threshold, round({h.format(a='p', n='n')} - ln / n * ({h.format(a='lp', n='ln')}) - (n - ln) / n * ({h.format(a='p - lp', n='n - ln')}), 12) gain from k where ln < n)
      select feature, threshold, gain from g order by gain desc, feature, threshold limit 1)"""


@query(f"select feature::int as feature, threshold, {r('gain')} as gain from {_split_sql(_TREE)}")
def tree_root_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tree(spark, sf_dir).select(F.lit(0).alias("tree"), F.lit(1).alias("node"), "f0", "f1", F.col("y").alias("_y"), F.lit(1.0).alias("_w"))
    return finish(tree.best_splits(d, ["f0", "f1"], [0, 1]).select("feature", "threshold", "gain"))


def _side(root: str, op: str) -> str:
    return f"(select d.* from {_TREE} d, {root} s where (case when s.feature = 0 then f0 else f1 end) {op} s.threshold)"


@query(f"""with root as (select * from {_split_sql(_TREE)}), a as (select * from {_side('root', '<=')}), b as (select * from {_side('root', '>')}), lft as (select * from {_split_sql('a')}), rgt as (select * from {_split_sql('b')}),
  n as (select d.o_orderkey, d.y, case when (case when root.feature = 0 then f0 else f1 end) <= root.threshold then 4 + ((case when lft.feature = 0 then f0 else f1 end) > lft.threshold)::int else 6 + ((case when rgt.feature = 0 then f0 else f1 end) > rgt.threshold)::int end as node from {_TREE} d, root, lft, rgt),
  m as (select node, (sum(y) * 2 > count(*))::int p from n group by node) select o_orderkey, p as prediction from n join m using (node)""")
def tree_depth2_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tree(spark, sf_dir)
    return d.select("o_orderkey", tree.fit_tree(d, ["f0", "f1"], "y", 2).predict().alias("prediction"))


@query(f"""with root as (select * from {_split_sql(_TREE)}), a as (select * from {_side('root', '<=')}), b as (select * from {_side('root', '>')}), lft as (select * from {_split_sql('a')}), rgt as (select * from {_split_sql('b')}),
  i as (select feature, gain * (select count(*) from orders) v from root union all select feature, gain * (select count(*) from a) from lft union all select feature, gain * (select count(*) from b) from rgt)
  select 'f' || f as feature, {r('coalesce(sum(v), 0) / (select sum(v) from i)')} as importance from range(2) x(f) left join i on f = feature group by f""")
def tree_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.fit_tree(_tree(spark, sf_dir), ["f0", "f1"], "y", 2).importances()
    return finish(rows(spark, list(found.items()), "feature string, importance double"))


@query()
def forest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tree(spark, sf_dir)
    forest = tree.fit_forest(d, ["f0", "f1"], "y", "o_orderkey", 5, 3, feature_share=2)
    return finish(d.select("o_orderkey", forest.probabilities()[1].alias("vote"), forest.predict().alias("prediction")))


# ------------------------------------------------------- clusters, components

_KM = "(select p_partkey, p_size::double as x, p_retailprice / 20 as y from part)"


def _km(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 20).alias("v"))


def _kmeans_ctes(k: int, rounds: int, seed: str = "42", prefix: str = "") -> str:
    p = prefix
    ctes = [f"{p}c0 as (select row_number() over (order by {key_sql('p_partkey::varchar', seed)}) - 1 as k, x, y from d qualify k < {k})"]
    for i in range(rounds):
        ctes.append(f"{p}a{i} as (select p_partkey, d.x, d.y, arg_min(c.k, (sqrt((d.x - c.x) ** 2 + (d.y - c.y) ** 2), c.k)) as k from d, {p}c{i} c group by 1, 2, 3)")
        ctes.append(f"{p}c{i + 1} as (select c.k, coalesce(m.x, c.x) x, coalesce(m.y, c.y) y from {p}c{i} c left join (select k, avg(x) x, avg(y) y from {p}a{i} group by k) m using (k))")
    return ", ".join(ctes)


def _loss_sql(centres: str) -> str:
    return f"(select sum(m) from (select min(sqrt((d.x - c.x) ** 2 + (d.y - c.y) ** 2)) m from d, {centres} c group by p_partkey))"


@query(f"with d as (select * from {_KM}), {_kmeans_ctes(4, 5)} select k::int as cluster, {r('x', 4)} as x, {r('y', 4)} as y from c5")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kmeans.fit(_km(spark, sf_dir), "p_partkey", "v", 4, 5, 0.0).centres
    return finish(rows(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(c)], "cluster int, x double, y double"), 4)


@query(f"with d as (select * from {_KM}), {_kmeans_ctes(4, 6)} select p_partkey, k::int as cluster from a5")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _km(spark, sf_dir)
    return d.select("p_partkey", kmeans.fit(d, "p_partkey", "v", 4, 5, 0.0).predict("v").alias("cluster"))


@query(f"with d as (select * from {_KM}), {', '.join(_kmeans_ctes(k, 3, prefix=f'k{k}') for k in (2, 3, 5))} " + " union all ".join(f"select {k} as k, {r(_loss_sql(f'k{k}c3'), 4)} as loss" for k in (2, 3, 5)))
def elbow_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(rows(spark, [(k, float(v)) for k, v in kmeans.elbow(_km(spark, sf_dir), "p_partkey", "v", [2, 3, 5], 3)], "k int, loss double"), 4)


@query(f"with d as (select * from {_KM}), {', '.join(_kmeans_ctes(3, 3, s, prefix=f's{s}') for s in ('1', '2', '3'))} " + " union all ".join(f"select '{s}' as seed, {r(_loss_sql(f's{s}c3'), 4)} as loss" for s in ("1", "2", "3")))
def best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(rows(spark, [(s, float(v)) for s, v in kmeans.best_seed(_km(spark, sf_dir), "p_partkey", "v", 3, ["1", "2", "3"], 3)], "seed string, loss double"), 4)


@query(f"""with d as (select * from {_KM}), {_kmeans_ctes(4, 4)}, j as (select k, p_type, count(*) n from a3 join part using (p_partkey) group by 1, 2), m as (select k, p_type, n from j qualify row_number() over (partition by k order by n desc, p_type) = 1)
  select {r('(select sum(n) from m) / (select count(*) from d)::double')} as accuracy""")
def cluster_majority_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _km(spark, sf_dir)
    labelled = d.withColumn("cluster", kmeans.fit(d, "p_partkey", "v", 4, 3, 0.0).predict("v")).join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    return finish(metrics.mapped_accuracy(labelled, "cluster", "p_type"))


def _gmm_sql(rounds: int) -> str:
    start = "(select 0 k, 0.5::double w, 10.0::double x, 50.0::double y union all select 1, 0.5::double, 40.0::double, 60.0::double)"
    ctes = [f"d as (select * from {_KM})", "g as (select var_samp(x) + 1e-6 a, covar_samp(x, y) b, var_samp(y) + 1e-6 c from d)", f"m0 as (select s.*, a, b, c from {start} s, g)"]
    for i in range(rounds):
        ctes.append(f"""r{i} as (select p_partkey, d.x px, d.y py, m.k, greatest(m.w * exp(-0.5::double * (m.c * (d.x - m.x) ** 2 - 2 * m.b * (d.x - m.x) * (d.y - m.y) + m.a * (d.y - m.y) ** 2) / (m.a * m.c - m.b * m.b)) / (2 * pi() * sqrt(m.a * m.c - m.b * m.b)), 1e-300) p from d, m{i} m)""")
        ctes.append(f"q{i} as (select px, py, k, p / sum(p) over (partition by p_partkey) r from r{i})")
        ctes.append(f"e{i} as (select k, sum(r) n, sum(r * px) / sum(r) x, sum(r * py) / sum(r) y from q{i} group by k)")
        ctes.append(f"""m{i + 1} as (select q.k, any_value(e.n) / (select count(*) from d) w, any_value(e.x) x, any_value(e.y) y, sum(r * (px - e.x) ** 2) / any_value(e.n) + 1e-9 a, sum(r * (px - e.x) * (py - e.y)) / any_value(e.n) b,
          sum(r * (py - e.y) ** 2) / any_value(e.n) + 1e-9 c from q{i} q join e{i} e using (k) group by q.k)""")
    return f"with {', '.join(ctes)} select k::int as component, {r('w', 4)} as weight, {r('x', 4)} as mean_x, {r('y', 4)} as mean_y, {r('a', 3)} as var_x from m{rounds}"


@query(_gmm_sql(3))
def gmm_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    m = gmm.fit(p, ["x", "y"], np.array([[10.0, 50.0], [40.0, 60.0]]), 3, 0.0)
    out = rows(spark, [(k, float(m.weights[k]), float(m.means[k, 0]), float(m.means[k, 1]), float(m.covariances[k, 0, 0])) for k in range(2)], "component int, weight double, mean_x double, mean_y double, var_x double")
    return finish(out, 4).withColumn("var_x", F.round("var_x", 3))


_DB = "(select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
_EPS, _MIN = 0.03, 6


def _dbscan_ctes(eps: float, least: int, tag: str = "") -> str:
    """CTEs up to ``fit``: vec_id, x, y, cluster."""
    t = tag
    return f"""e{t} as (select a.vec_id a, b.vec_id b from p a, p b where a.vec_id <> b.vec_id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {eps}::double),
  core{t} as (select vec_id from p left join e{t} on a = vec_id group by vec_id having count(b) + 1 >= {least}), link{t} as (select a, b from e{t} where a in (from core{t}) and b in (from core{t})),
  reach{t} as (select vec_id a, vec_id root from core{t} union select l.b, root from reach{t} r join link{t} l on l.a = r.a), lab{t} as (select a vec_id, min(root) root from reach{t} group by a),
  num{t} as (select root, row_number() over (order by root) - 1 cluster from (select distinct root from lab{t})), cl{t} as (select vec_id, cluster from lab{t} join num{t} using (root)),
  near{t} as (select b vec_id, min(cluster) cluster from e{t} join cl{t} c on c.vec_id = e{t}.a group by b),
  fit{t} as (select p.vec_id, x, y, coalesce(cl{t}.cluster, near{t}.cluster, -1)::int as cluster from p left join cl{t} using (vec_id) left join near{t} using (vec_id))"""


def _dbscan_score(eps: float, least: int, t: str) -> str:
    """CTEs that end in ``score``, a row of the grid."""
    return f"""{_dbscan_ctes(eps, least, t)}, d{t} as (select a.vec_id, a.cluster own, b.cluster other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) t, count(*) n from fit{t} a, fit{t} b where a.cluster >= 0 and b.cluster >= 0 group by 1, 2, 3),
  m{t} as (select vec_id, max(case when own = other then coalesce(t / nullif(n - 1, 0), 0) end) a, min(case when own <> other then t / n end) b from d{t} group by vec_id),
  score{t} as (select {eps}::double as eps, {least}::int as min_samples, (select count(distinct cluster) from fit{t} where cluster >= 0)::int as clusters,
    case when (select count(distinct cluster) from fit{t} where cluster >= 0) < 2 then -1.0 else (select avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) from m{t}) end * (select avg((cluster >= 0)::int) from fit{t}) as score)"""


@query(f"with recursive p as (select * from {_DB}), {_dbscan_ctes(_EPS, _MIN)} select vec_id, cluster from fit")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return dbscan.fit_predict(p, "vec_id", ["x", "y"], _EPS, _MIN).select(F.col("id").alias("vec_id"), "cluster")


_GRID = [(0.02, 4), (0.02, 6), (0.03, 4), (0.03, 6)]


@query(f"with recursive p as (select * from {_DB}), {', '.join(_dbscan_score(e, m, f'_{i}') for i, (e, m) in enumerate(_GRID))} "
       + " union all ".join(f"select eps, min_samples, clusters, {r('score')} as score from score_{i}" for i in range(len(_GRID))))
def dbscan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    found = dbscan.explore(p, "vec_id", ["x", "y"], [0.02, 0.03], [4, 6])
    return finish(rows(spark, found, "eps double, min_samples int, clusters int, score double"))


_SIL = """d as (select a.vec_id, a.label own, b.label other, sum(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]) ** 2)))) t, count(*) n from embeddings a, embeddings b group by 1, 2, 3),
  p as (select vec_id, max(case when own = other then coalesce(t / nullif(n - 1, 0), 0) end) a, min(case when own <> other then t / n end) b from d group by vec_id), s as (select coalesce((b - a) / nullif(greatest(a, b), 0), 0) s from p)"""


@query(f"with {_SIL} select {r('avg(s)')} as silhouette from s")
def silhouette_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = silhouette.silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return finish(rows(spark, [(value,)], "silhouette double"))


@query(f"with e0 as (from embeddings), {_SIL.replace('from embeddings a, embeddings b group', 'from embeddings a, embeddings b where a.label > 0 and b.label > 0 group')} select {r('avg(s) * (select avg((label > 0)::int) from embeddings)')} as silhouette from s")
def silhouette_penalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").withColumn("c", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return finish(rows(spark, [(silhouette.penalised_silhouette(d, "vec_id", "embedding", "c"),)], "silhouette double"))


_P2 = "(select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
_EIG = f"""m as (select avg(x) mx, avg(y) my, var_samp(x) a, covar_samp(x, y) b, var_samp(y) c, count(*)::double n from {_P2}),
  v as (select *, ((a + c) + sqrt((a - c) ** 2 + 4 * b * b)) / 2 l1, ((a + c) - sqrt((a - c) ** 2 + 4 * b * b)) / 2 l2 from m)"""


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("v"))


@query(" union all ".join(f"select {i} as i, {j} as j, {r(f'covar_samp(embedding[{i + 1}]::double, embedding[{j + 1}]::double)')} as covariance from embeddings" for i in range(3) for j in range(3)))
def pca_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 3).alias("v"))
    _, _, c = moments_of(d, vector="v")
    return finish(rows(spark, [(i, j, float(c[i, j])) for i in range(3) for j in range(3)], "i int, j int, covariance double"))


@query(f"with {_EIG} select 1 as component, {r('l1 / (l1 + l2)')} as ratio, {r('l1 / (l1 + l2)')} as cumulative from v union all select 2, {r('l2 / (l1 + l2)')}, 1.0::double from v")
def pca_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = pca.fit(_p2(spark, sf_dir), "v").variance_ratio()
    return finish(rows(spark, [(i + 1, float(x), float(c)) for i, (x, c) in enumerate(zip(ratio, np.cumsum(ratio), strict=True))], "component int, ratio double, cumulative double"))


@query(f"""with {_EIG}, w as (select *, b / sqrt(b * b + (l1 - a) ** 2) wx, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) wy from v), f as (select *, case when (abs(wx) >= abs(wy) and wx < 0) or (abs(wy) > abs(wx) and wy < 0) then -1 else 1 end s from w)
  select vec_id, {r('s * (wx * (x - mx) + wy * (y - my))')} as pc1 from {_P2}, f""")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _p2(spark, sf_dir)
    return finish(d.select("vec_id", pca.fit(d, "v").project("v", 1)[0].alias("pc1")))


@query(f"with {_EIG} select {r('l2 * (n - 1) / (n * 2)')} as mse from v")
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(rows(spark, [(pca.fit(_p2(spark, sf_dir), "v").reconstruction_error(1),)], "mse double"))


@query()
def pca_kmeans_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    model = pca.fit(d, "embedding")
    k = model.components_for(0.9)
    projected = d.select("vec_id", "label", model.project("embedding", k).alias("v"))
    placed = projected.withColumn("cluster", kmeans.fit(projected, "vec_id", "v", 10, 20).predict("v"))
    return finish(metrics.mapped_accuracy(placed, "cluster", "label").withColumn("components", F.lit(k)))


# ------------------------------------------------------------------ networks


@query()
def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    o = mlp.Options(hidden=(16,), rate=0.01, epochs=6, optimiser="adam", l2=0.01, patience=3)
    net = mlp.fit(d.filter("vec_id % 5 > 0"), "embedding", "label", "vec_id", o, d.filter("vec_id % 5 = 0"))
    return finish(rows(spark, [(e, m, float(v)) for e, m, v in net.history], "epoch int, metric string, value double"), 4)


@query()
def mlp_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    net = mlp.fit(d, "embedding", "label", "vec_id", mlp.Options(hidden=(16,), rate=0.05, epochs=5, optimiser="adam", dropout=0.1, batch_norm=True, batches=2))
    return finish(mlp.predict(d, net, "embedding").select("vec_id", F.array_max("probabilities").alias("probability"), "prediction"), 4)


@query(f"select epoch::int as epoch, {r('0.1 / (1 + epoch / 10.0)')} as linear, {r('0.1 * exp(-0.1 * epoch / 10.0)')} as exponential from range(10) x(epoch)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(rows(spark, [(e, mlp.learning_rate(0.1, e, 10, "linear"), mlp.learning_rate(0.1, e, 10, "exponential")) for e in range(10)], "epoch int, linear double, exponential double"))


@query(f"""with g as (select avg(p_retailprice / 1000 - 1) g from part), a as (select 0.1 * g m, 0.001 * g * g v from g) select {r('0.5::double - 0.01 * (m / (1 - 0.9::double)) / (sqrt(v / (1 - 0.999::double)) + 1e-8)')} as w, {r('m')} as m, {r('v', 9)} as v from a""")
def adam_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").agg(F.avg(F.col("p_retailprice") / 1000 - 1)).first()[0]
    w, m, v = mlp.adam_step(0.5, g, 0.0, 0.0, 1, 0.01)
    return rows(spark, [(round(float(w), 6), round(float(m), 6), round(float(v), 9))], "w double, m double, v double")


@query("select 3 as best_epoch, 5 as last_epoch")
def early_stop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, last = mlp.early_stop([0.9, 0.7, 0.8, 0.6, 0.61, 0.6, 0.2], 2)
    return rows(spark, [(best, last)], "best_epoch int, last_epoch int")


@query()
def vae_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double") * 4))).alias("v"))
    net = vae.fit(d, "v", "vec_id", 2, 8, 5)
    z = vae.latents(d, net, "v", "vec_id")
    return finish(z.select("vec_id", F.col("latent")[0].alias("z0"), F.col("latent")[1].alias("z1")), 4)

