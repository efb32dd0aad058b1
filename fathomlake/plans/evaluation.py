"""Splits, rebalancing, metrics and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import argmax, softmax
from ..operators import curves, metrics, prepare, resample, split
from ..sources.readers import table
from .base import LINES_SQL, SCORED_SQL, finish, key_sql, lines, query, r, scored, uniform_sql

_KEY = key_sql("o_orderkey::varchar")


def _ranked(table_name: str, row_id: str, label: str) -> str:
    return (f"select {row_id}, {label}, row_number() over (partition by {label} order by {key_sql(row_id + '::varchar')}) rn, "
            f"count(*) over (partition by {label}) n from {table_name}")


@query(f"""select o_orderkey, row_number() over (order by {_KEY}) <= floor(0.8::double * count(*) over ()) as is_train from orders""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.random_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "is_train")


_CELLS = ["quantity", "price", "discount", "tax"]
_PREPARED = f"""with s as (select *, row_number() over (order by {key_sql('line_id::varchar')}) <= floor(0.8::double * count(*) over ()) as is_train from {LINES_SQL}),
  m as (select {', '.join(f'avg({c}) {c}' for c in _CELLS)} from s where is_train), i as (select s.line_id, s.is_train, {', '.join(f'coalesce(s.{c}, m.{c}) {c}' for c in _CELLS)} from s, m),
  z as (select {', '.join(f'avg({c}) m_{c}, stddev_samp({c}) s_{c}' for c in _CELLS)} from i where is_train)"""


@query(f"{_PREPARED} select line_id, is_train, {', '.join(r(f'({c} - m_{c}) / (s_{c} + 1e-8)') + f' as {c}' for c in _CELLS)} from i, z")
def split_impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held, _ = prepare.split_impute_scale(lines(spark, sf_dir), "line_id", _CELLS)
    return finish(train.withColumn("is_train", F.lit(True)).unionByName(held.withColumn("is_train", F.lit(False))).select("line_id", "is_train", *_CELLS))


@query(f"""with t as ({_ranked('orders', 'o_orderkey', 'o_orderstatus')})
  select o_orderkey, rn <= (case when n > 1 then least(greatest(1, round_even(n * 0.2::double, 0)), n - 1) else greatest(1, round_even(n * 0.2::double, 0)) end) as is_test from t""")
def stratified_split2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "is_test")


@query(f"""with t as ({_ranked('orders', 'o_orderkey', 'o_orderstatus')}) select o_orderkey, rn <= round_even(n * 0.7::double, 0) as is_train from t""")
def stratified_split_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split_train_rounded(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 0.7).select("o_orderkey", "is_train")


@query(f"""with t as ({_ranked('labels', 'doc_id', 'toxic')}),
  a as (select *, case when n >= 3 then greatest(1, least(round_even(n * 0.6::double, 0), n - 2)) else round_even(n * 0.6::double, 0) end a from t),
  b as (select *, case when n >= 3 then greatest(1, least(round_even(n * 0.2::double, 0), n - a - 1)) else least(round_even(n * 0.2::double, 0), n - a) end b from a)
  select doc_id, case when rn <= a then 'train' when rn <= a + b then 'validation' else 'test' end as part from b""")
def stratified_split3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split3(table(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "part")


@query(f"""with t as ({_ranked('orders', 'o_orderkey', 'o_orderstatus')}) select o_orderkey, ((rn - 1) % 5)::int as fold from t""")
def kfold_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_folds(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "fold")


@query("""with t as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () // 7 size from orders)
  select o_orderkey, case when i // size < 7 then (i // size)::int else -1 end as fold from t""")
def kfold_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.contiguous_folds(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "fold")


@query(f"""with s as (select p_partkey, split from part, (select unnest([0, 1, 2]) as split)),
  t as (select *, row_number() over (partition by split order by md5(p_partkey::varchar || '-' || split::varchar || '-42')) rn, count(*) over (partition by split) n from s)
  select p_partkey, split::int as split, rn <= floor(0.8::double * n) as is_train from t""")
def repeated_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.repeated_splits(table(spark, sf_dir, "part"), "p_partkey", 3).select("p_partkey", "split", "is_train")


@query("""select o_orderkey, epoch_us(o_orderdate)::double <= (select quantile_cont(epoch_us(o_orderdate)::double, 0.8) from orders) as is_train from orders""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.time_split(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "is_train")


@query(f"select o_orderkey, {uniform_sql(key_sql('o_custkey::varchar'))} < 0.8::double as is_train from orders")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "is_train")


@query("select min(doc_id) as doc_id from documents group by text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.deduplicate_first(table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id")


@query(f"select o_orderkey, o_orderstatus from ({_ranked('orders', 'o_orderkey', 'o_orderstatus')}) where rn <= 5")
def sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample_per_class(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 5).select("o_orderkey", "o_orderstatus")


@query(f"""with t as ({_ranked('labels', 'doc_id', 'toxic')}) select doc_id, toxic from t where rn <= (select min(n) from t)""")
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.undersample(table(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "toxic")


_DRAWS = """m as (select max(n) m from t), c as (select distinct {label} as label, n from t),
  d as (select label, n, unnest(range(1, (m - n + 1)::bigint)) as draw from c, m where n < m),
  k as (select *, md5(label::varchar || '-' || draw::varchar || '-42') as key from d)"""


def _pick(n: str, at: int = 1) -> str:
    return f"least(floor({uniform_sql('key', at)} * {n}) + 1, {n})"


@query(f"""with t as ({_ranked('labels', 'doc_id', 'toxic')}), {_DRAWS.format(label='toxic')}
  select doc_id, toxic, 0::bigint as copy from labels union all
  select t.doc_id, t.toxic, draw as copy from k join t on t.toxic = k.label and t.rn = {_pick('k.n')}""")
def oversample_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.oversample(table(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "copy")


_SMOTE_ROWS = "(select vec_id, (label < 1)::int as cls, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


@query(f"""with src as (select * from {_SMOTE_ROWS}), t as (select vec_id, cls, x, y, row_number() over (partition by cls order by {key_sql('vec_id::varchar')}) rn, count(*) over (partition by cls) n from src),
  {_DRAWS.format(label='cls')}, p as (select key, label, draw, {uniform_sql('key', 17)} as alpha, {_pick('n')} as b, {_pick('greatest(1, least(5, n - 1))', 9)} as j from k),
  nn as (select a.vec_id q, b.vec_id id, row_number() over (partition by a.vec_id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) rk from t a join t b on a.cls = b.cls and a.vec_id <> b.vec_id)
  select p.label::int as label, draw, t.vec_id as base, nn.id as neighbour, {r('t.x + alpha * (o.x - t.x)')} as x, {r('t.y + alpha * (o.y - t.y)')} as y
  from p join t on t.cls = p.label and t.rn = p.b join nn on nn.q = t.vec_id and nn.rk = p.j join t o on o.vec_id = nn.id""")
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = e.select("vec_id", (F.col("label") < 1).cast("int").alias("cls"), F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("v"))
    made = resample.smote(d, "vec_id", "cls", "v")
    return finish(made.select("label", F.col("draw").cast("bigint"), "base", "neighbour", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y")))


@query(f"select toxic as label, count(*) as n, {r('sum(count(*)) over () / (count(*) over () * count(*))')} as weight from labels group by toxic")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(resample.class_weights(table(spark, sf_dir, "labels"), "toxic"))


@query(f"""select {r('avg((p_retailprice - (900 + p_size)) ** 2)')} as mse, {r('sqrt(avg((p_retailprice - (900 + p_size)) ** 2))')} as rmse, {r('avg(abs(p_retailprice - (900 + p_size)))')} as mae,
  {r('1 - avg((p_retailprice - (900 + p_size)) ** 2) / var_pop(p_retailprice)')} as r2 from part""")
def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").withColumn("p", F.col("p_size").cast("double") + 900)
    return finish(metrics.regression_metrics(d, "p_retailprice", "p"))


_GRID = f"s as (select * from {SCORED_SQL}), l as (select toxic as x from s union select pred from s), c as (select t.x as true_label, p.x as pred_label, count(s.doc_id) as n from l t cross join l p left join s on s.toxic = t.x and s.pred = p.x group by 1, 2)"
_SCORES = _GRID + """, k as (select x as label, (select sum(n) from c where true_label = x) support, (select sum(n) from c where pred_label = x) predicted, (select sum(n) from c where true_label = x and pred_label = x) tp from l),
  v as (select *, coalesce(tp / nullif(predicted, 0)::double, 0) p, coalesce(tp / nullif(support, 0)::double, 0) rc from k), f as (select *, coalesce(2 * p * rc / nullif(p + rc, 0), 0) f1 from v)"""


@query(f"with {_GRID} select true_label, pred_label, n from c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), "toxic", "pred")


@query(f"select {r('avg((toxic = pred)::int)')} as accuracy from {SCORED_SQL}")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(metrics.accuracy(scored(spark, sf_dir), "toxic", "pred"))


@query(f"with {_SCORES} select label, {r('p')} as precision, {r('rc')} as recall, {r('f1')} as f1 from f order by label desc limit 1")
def prf_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(metrics.binary_scores(scored(spark, sf_dir), "toxic", "pred"))


@query(f"""with {_SCORES}, a as (select 'micro' as average, sum(tp) / sum(predicted)::double p, sum(tp) / sum(support)::double rc from f union all select 'macro', avg(p), avg(rc) from f
  union all select 'weighted', sum(p * support) / sum(support), sum(rc * support) / sum(support) from f)
  select average, {r('p')} as precision, {r('rc')} as recall, {r('coalesce(2 * p * rc / nullif(p + rc, 0), 0)')} as f1 from a""")
def prf_micro_macro_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(metrics.precision_recall_f1(metrics.confusion(scored(spark, sf_dir), "toxic", "pred")))


_PLAIN = "coalesce(2 * p * rc / nullif(p + rc, 0), 'nan'::double)"


@query(f"""with {_SCORES} select 'none' as average, label, {r('p')} as precision, {r('rc')} as recall, {r(_PLAIN)} as f1 from f
  union all select 'macro', null, {r('p')}, {r('rc')}, {r(_PLAIN)} from (select avg(p) p, avg(rc) rc from f)
  union all select 'binary', case when n = 2 then label end, {r('case when n = 2 then p else mp end')}, {r('case when n = 2 then rc else mr end')}, {r('case when n = 2 then f1 else coalesce(2 * mp * mr / nullif(mp + mr, 0), 0) end')}
  from (select *, count(*) over () n, avg(p) over () mp, avg(rc) over () mr, row_number() over (order by label desc) k from f) where k = 1""")
def prf_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.confusion(scored(spark, sf_dir), "toxic", "pred")
    found = [metrics.plain_scores(counts, a).select(F.lit(a).alias("average"), "label", "precision", "recall", "f1") for a in ("none", "macro", "binary")]
    return finish(found[0].unionByName(found[1]).unionByName(found[2]))


def _areas_sql(scores: dict) -> str:
    """Rows (scope, metric, value) of the areas of each class of ``scored`` and of all, class 1 being positive."""
    area = "select {x} x, arg_max({y}, coalesce(score, 1e300)) y from {c} group by 1"
    total = "select coalesce(sum((x - px) * (y + py) / 2), 0) from (select x, y, lag(x) over (order by x) px, lag(y) over (order by x) py from ({d}))"
    out = []
    for label, score in scores.items():
        ctes = f"""with s as (select (toxic = {label})::int y, {score} as score from {SCORED_SQL}), b as (select score, sum(y) pos, sum(1 - y) neg from s group by score),
          c as (select score, sum(pos) over (order by score desc) tp, sum(neg) over (order by score desc) fp, (select sum(pos) from b) p, (select sum(neg) from b) n from b),
          roc as (select score, fp / n::double x, tp / p::double y from c union all select null, 0, 0),
          pr as (select score, tp / p::double x, tp / (tp + fp)::double y from c), q as (select * from pr union all select null, 0, (select y from pr order by score desc limit 1))"""
        for metric, c in (("auc_roc", "roc"), ("auc_pr", "q")):
            value = f"({ctes} {total.format(d=area.format(x='x', y='y', c=c))})"
            out += [f"select '{scope}', '{metric}', {value}" for scope in ([label, "all"] if label == 1 else [label])]
    return " union all ".join(out)


@query(f"""with {_SCORES}, o as (select label::varchar as scope, unnest(['precision', 'recall', 'f1', 'support']) as metric, unnest([p, rc, f1, support::double]) as value from f union all
  select 'all', 'accuracy', sum(tp) / sum(support)::double from f union all
  select 'macro', unnest(['precision', 'recall', 'f1']), unnest([avg(p), avg(rc), avg(f1)]) from f union all
  select 'weighted', unnest(['precision', 'recall', 'f1']), unnest([sum(p * support) / sum(support), sum(rc * support) / sum(support), sum(f1 * support) / sum(support)]) from f union all {_areas_sql({0: '1 - score', 1: 'score'})})
  select scope, metric, {r('value')} as value from o""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).withColumn("other", 1 - F.col("score"))
    return finish(metrics.class_report_with_areas(d, "toxic", "pred", {0: "other", 1: "score"}))


_CURVE = f"""s as (select * from {SCORED_SQL}), b as (select score, sum((toxic = 1)::int) pos, sum((toxic <> 1)::int) neg from s group by score),
  c as (select score, sum(pos) over (order by score desc) tp, sum(neg) over (order by score desc) fp, (select sum(pos) from b) n_pos, (select sum(neg) from b) n_neg from b),
  roc as (select score, fp / n_neg::double fpr, tp / n_pos::double tpr from c union all select null, 0, 0),
  pr as (select score, tp / n_pos::double recall, tp / (tp + fp)::double as prec from c)"""


@query(f"with {_CURVE} select score, {r('fpr')} as fpr, {r('tpr')} as tpr from roc")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.roc_points(scored(spark, sf_dir), "toxic", "score"))


@query(f"with {_CURVE} select score, {r('recall')} as recall, {r('prec')} as precision from pr union all select null, 0.0::double, {r('(select prec from pr order by score desc limit 1)')}")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.pr_points(scored(spark, sf_dir), "toxic", "score"))


_AREA = "select {x} x, arg_max({y}, coalesce(score, 1e300)) y, arg_min({y}, coalesce(score, 1e300)) z from {c} group by 1"


@query(f"with {_CURVE} select score, {r('fpr')} as fpr, {r('tpr')} as tpr, {r('prec')} as precision from roc join pr using (score)")
def threshold_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.threshold_points(scored(spark, sf_dir), "toxic", "score"))


_ALONG = "select '{c}' as curve, sum(a) * case when arg_min(x, score) > arg_max(x, score) then 1 else -1 end as auc from (select score, x, (x - lag(x) over w) * (y + lag(y) over w) / 2 as a from (select score, {x} x, {y} y from {t}) window w as (order by score desc))"


@query(f"""with {_CURVE}, e as ({_ALONG.format(c='roc', x='fpr', y='tpr', t='roc where score is not null')} union all {_ALONG.format(c='pr', x='recall', y='prec', t='pr')})
  select curve, {r('coalesce(auc, 0)')} as auc from e""")
def auc_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = curves.threshold_points(scored(spark, sf_dir), "toxic", "score")
    areas = [curves.auc_along(points, x, y).select(F.lit(name).alias("curve"), "auc") for name, x, y in (("roc", "fpr", "tpr"), ("pr", "tpr", "precision"))]
    return finish(areas[0].unionByName(areas[1]))


@query(f"""with {_CURVE}, d as ({_AREA.format(x='fpr', y='tpr', c='roc')}), e as (select (x - lag(x) over (order by x)) * (y + lag(y) over (order by x)) / 2 as a from d)
  select {r('coalesce(sum(a), 0)')} as auc from e""")
def auc_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.auc_collapsed(curves.roc_points(scored(spark, sf_dir), "toxic", "score"), "fpr", "tpr"))


@query(f"""with {_CURVE}, d as ({_AREA.format(x='fpr', y='tpr', c='roc')}), e as (select (x - lag(x) over (order by x)) * (y + lag(z) over (order by x)) / 2 as a from d)
  select {r('coalesce(sum(a), 0)')} as auc from e""")
def auc_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.auc_standard(curves.roc_points(scored(spark, sf_dir), "toxic", "score"), "fpr", "tpr"))


@query(f"""with {_CURVE}, q as (select * from pr union all select null, 0, (select prec from pr order by score desc limit 1)), d as ({_AREA.format(x='recall', y='prec', c='q')}),
  e as (select (x - lag(x) over (order by x)) * (y + lag(y) over (order by x)) / 2 as a from d) select {r('coalesce(sum(a), 0)')} as auc from e""")
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.auc_collapsed(curves.pr_points(scored(spark, sf_dir), "toxic", "score"), "recall", "precision"))


def _ovr_sql() -> str:
    parts = []
    for k in range(3):
        parts.append(f"""(with s as (select (l.quality + l.toxic = {k})::int y, ((d.n_chars * {k + 2}) % 97)::double / 97 score from labels l join documents d using (doc_id)),
          b as (select score, sum(y) pos, sum(1 - y) neg from s group by score),
          roc as (select score, sum(neg) over (order by score desc) / (select sum(neg) from b)::double fpr, sum(pos) over (order by score desc) / (select sum(pos) from b)::double tpr from b union all select null, 0, 0),
          d as ({_AREA.format(x='fpr', y='tpr', c='roc')}), e as (select (x - lag(x) over (order by x)) * (y + lag(y) over (order by x)) / 2 as a from d) select coalesce(sum(a), 0) from e)""")
    return f"select {r('(' + ' + '.join(parts) + ') / 3')} as auc"


@query(_ovr_sql())
def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.withColumn("cls", F.col("quality") + F.col("toxic")).withColumns({f"s{k}": ((F.col("n_chars") * (k + 2)) % 97).cast("double") / 97 for k in range(3)})
    value = curves.auc_one_vs_rest(d, "cls", {k: f"s{k}" for k in range(3)})
    return finish(spark.createDataFrame([(value,)], "auc double"))


@query(f"""with s as (select * from {SCORED_SQL}), t as (select i * (1.0::double / 20) as threshold from range(21) x(i)),
  c as (select threshold, sum((score >= threshold and toxic = 1)::int)::bigint tp, sum((score >= threshold and toxic <> 1)::int)::bigint fp, sum((score < threshold and toxic = 1)::int)::bigint fn,
  sum((score < threshold and toxic <> 1)::int)::bigint tn from t, s group by 1)
  select {r('threshold')} as threshold, tp, fp, fn, tn, {r('coalesce(fp / nullif(fp + tn, 0)::double, 0)')} as fpr, {r('coalesce(tp / nullif(tp + fn, 0)::double, 0)')} as tpr, {r('coalesce(tp / nullif(tp + fp, 0)::double, 0)')} as precision from c""")
def roc_fixed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(curves.fixed_threshold_curve(scored(spark, sf_dir), "toxic", "score", 21))


_SOFT = """x as (select vec_id, label, [embedding[1]::double * 10, embedding[2]::double * 10, embedding[3]::double * 10] as v from embeddings),
  e as (select vec_id, label, [exp(v[1] - list_max(v)), exp(v[2] - list_max(v)), exp(v[3] - list_max(v))] as e from x), p as (select vec_id, label, [e[1] / list_sum(e), e[2] / list_sum(e), e[3] / list_sum(e)] as p from e)"""


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    v = F.array(*[e[i].cast("double") * 10 for i in range(3)])
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v")).withColumn("p", softmax("v"))


@query(f"with {_SOFT} select vec_id, {r('p[1]')} as p0, {r('p[2]')} as p1, {r('p[3]')} as p2, (list_position(p, list_max(p)) - 1)::int as best from p")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return finish(_soft(spark, sf_dir).select("vec_id", *[p[i].alias(f"p{i}") for i in range(3)], argmax("p").alias("best")))


@query(f"with {_SOFT} select {r('avg(-ln(greatest(least(p[label % 3 + 1], 1 - 1e-10), 1e-10)))')} as cross_entropy from p")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(metrics.cross_entropy(_soft(spark, sf_dir).withColumn("t", F.col("p")[F.col("label") % 3]), "t"))
