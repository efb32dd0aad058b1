"""Profiling, cleaning, encoding, imputation, scaling and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import haversine as haversine_km
from ..operators import clean, encode, features, impute, profile, scale
from ..sources.readers import table
from .base import LINES_SQL, PARTS_SQL, finish, lines, parts, query, r

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(items: list[str]) -> str:
    return "\nunion all\n".join(items)


def _describe_sql(columns: list[str], source: str) -> str:
    return _union([
        f"select '{c}' as column_name, count({c}) as n, count(*) - count({c}) as nulls, {r(f'avg({c})')} as mean, {r(f'stddev_samp({c})')} as std, "
        f"{r(f'min({c})')} as min, {r(f'quantile_cont({c}::double, 0.25)')} as q25, {r(f'quantile_cont({c}::double, 0.5)')} as q50, "
        f"{r(f'quantile_cont({c}::double, 0.75)')} as q75, {r(f'max({c})')} as max from {source}" for c in columns])


@query(_describe_sql(["quantity", "price", "discount", "tax"], LINES_SQL))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(profile.describe(lines(spark, sf_dir), ["quantity", "price", "discount", "tax"]))


@query(_union([f"select '{c}' as column_name, count(*) - count({c}) as nulls from {LINES_SQL}" for c in ("quantity", "price", "discount", "tax")]))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(lines(spark, sf_dir), ["quantity", "price", "discount", "tax"])


@query(f"""select o_orderstatus as label, count(*) as n, {r('count(*) / sum(count(*)) over ()')} as share,
  {r('max(count(*)) over () / count(*)')} as imbalance from orders group by o_orderstatus""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(profile.class_balance(table(spark, sf_dir, "orders"), "o_orderstatus"))


@query("""select sum(n)::bigint as n_rows, count(*) as n_distinct, (sum(n) - count(*))::bigint as n_duplicates,
  sum((n > 1)::int)::bigint as n_repeated from (select count(*) n from documents group by text, lang)""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query(_union([f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as r from lineitem" for a, b in _PAIRS]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(profile.correlations(table(spark, sf_dir, "lineitem"), NUMERIC))


_NET = "(select *, l_extendedprice * (1 - l_discount) as net from lineitem)"
_NET_PAIRS = [*_PAIRS, *[(a, "net") for a in NUMERIC]]


@query("select * from (" + _union([f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as r from {_NET}" for a, b in _NET_PAIRS]) + ") where abs(r) > 0.75 and abs(r) < 1")
def strong_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return finish(profile.strong_correlations(d, [*NUMERIC, "net"]))


@query("select * from (" + _union([f"select '{c}' as column_name, {r(f'corr({c}, l_extendedprice)')} as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]) + ") order by abs(r) desc, column_name limit 2")
def top_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(profile.top_correlated(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", 2))


@query("""select (case when hi = lo then 0 else least(29, floor((o_totalprice - lo) / ((hi - lo) / 30))) end)::int as bin, count(*) as n
  from orders, (select min(o_totalprice) lo, max(o_totalprice) hi from orders) group by 1""")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 30)


@query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
  count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = profile.pivot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return wide.na.fill(0)


@query(f"""select label, place - 1 as place, {r('avg(x::double)')} as mean from
  (select label, unnest(embedding) as x, generate_subscripts(embedding, 1)::int as place from embeddings) group by label, place""")
def class_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(profile.class_mean_vector(table(spark, sf_dir, "embeddings"), "label", "embedding"))


@query(f"""select p_partkey, case when p_size % 3 = 0 then 1 when p_size % 3 = 1 then 0 end as units,
  {r('case when p_size % 3 = 1 then p_retailprice else p_retailprice * 0.092903::double end')} as area_m2 from part""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_size") % 3 == 0, "sqft").when(F.col("p_size") % 3 == 1, "m2").otherwise("acre")
    df = table(spark, sf_dir, "part").withColumn("units", unit)
    return finish(clean.convert_units(df, "p_retailprice", "units").select("p_partkey", "units", "area_m2"))


@query(f"""select line_id, case when quantity between 2 and 40 then quantity end as quantity, case when discount <= 0.05 then discount end as discount from {LINES_SQL}""")
def limits_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.limits_to_null(lines(spark, sf_dir), {"quantity": (2, 40), "discount": (None, 0.05)}).select("line_id", "quantity", "discount")


@query(f"select line_id, quantity, case when tax >= 0 then tax end as tax from {LINES_SQL}")
def negatives_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.negatives_to_null(lines(spark, sf_dir), ["quantity", "tax"], ["quantity"]).select("line_id", "quantity", "tax")


_IQR = f"""with src as (select * from {LINES_SQL}), q as (select quantile_cont(price, 0.15) a, quantile_cont(price, 0.85) b,
  quantile_cont(tax, 0.15) c, quantile_cont(tax, 0.85) d from src)"""


@query(_IQR + """ select line_id, case when price between a - 0.1::double * (b - a) and b + 0.1::double * (b - a) then price end as price,
  case when tax between c - 0.1::double * (d - c) and d + 0.1::double * (d - c) then tax end as tax from src, q""")
def iqr_outliers_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.outliers_to_null(lines(spark, sf_dir), ["price", "tax"], width=0.1).select("line_id", "price", "tax")


@query(f"""with src as (select * from {LINES_SQL}), q as (select quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) b from src)
  select line_id, coalesce(not (price between a - 0.5::double * (b - a) and b + 0.5::double * (b - a)), false) as price_outlier from src, q""")
def iqr_outlier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.outlier_mask(lines(spark, sf_dir), ["price"], width=0.5).select("line_id", "price_outlier")


_NULLS = "((quantity is null)::int + (price is null)::int + (discount is null)::int + (tax is null)::int)"


@query(f"select line_id, quantity, price, discount, tax from {LINES_SQL} where {_NULLS} < 2")
def drop_high_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_high_null_rows(lines(spark, sf_dir), ["quantity", "price", "discount", "tax"], 2).select("line_id", "quantity", "price", "discount", "tax")


@query(f"""with a as (select line_id, case when quantity between 2 and 45 then quantity end as quantity, price, discount, case when tax >= 0 then tax end as tax from {LINES_SQL}),
  q as (select {', '.join(f"quantile_cont({c}, 0.15) {c}_a, quantile_cont({c}, 0.85) {c}_b" for c in ("quantity", "price", "discount", "tax"))} from a),
  b as (select line_id, {', '.join(f"case when {c} between {c}_a - 1.5::double * ({c}_b - {c}_a) and {c}_b + 1.5::double * ({c}_b - {c}_a) then {c} end as {c}" for c in ("quantity", "price", "discount", "tax"))} from a, q)
  select * from b where {_NULLS} < 2""")
def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["quantity", "price", "discount", "tax"]
    return clean.clean(lines(spark, sf_dir), {"quantity": (2, 45)}, columns, ["price"], 2).select("line_id", *columns)


@query("""select c_custkey, (c_mktsegment = 'BUILDING')::int as is_building, (c_mktsegment = 'MACHINERY')::int as is_machinery,
  coalesce((c_mktsegment = 'FURNITURE')::int, 0) as furniture from customer""")
def flag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("segment", F.lower("c_mktsegment"))
    flagged = encode.flag_levels(c, "segment", ["building", "machinery"], "is_")
    return encode.present_flag(flagged, "c_mktsegment", "FURNITURE", "furniture").select("c_custkey", "is_building", "is_machinery", "furniture")


@query("""select o_orderkey, (o_orderstatus = 'F')::int as "o_orderstatus_F", (o_orderstatus = 'O')::int as "o_orderstatus_O", (o_orderstatus = 'P')::int as "o_orderstatus_P" from orders""")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.one_hot(table(spark, sf_dir, "orders"), "o_orderstatus").select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P")


@query("select p_partkey, (dense_rank() over (order by p_type) - 1)::int as code from part")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.label_encode(table(spark, sf_dir, "part"), "p_type", "code").select("p_partkey", F.col("code").cast("int"))


@query("""select o_orderkey, case substr(o_orderpriority, 1, 1) when '1' then 5 when '2' then 4 when '3' then 3 end as priority from orders""")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1))
    return encode.ordinal_encode(d, "level", {"1": 5, "2": 4, "3": 3}, "priority").select("o_orderkey", "priority")


@query("select p_partkey, format('{:b}', dense_rank() over (order by p_type) - 1) as code from part")
def binary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.binary_encode(table(spark, sf_dir, "part"), "p_type", "code").select("p_partkey", "code")


@query("select p_partkey, count(*) over (partition by p_brand) as brand_count from part")
def count_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.count_encode(table(spark, sf_dir, "part"), "p_brand", "brand_count").select("p_partkey", "brand_count")


@query(f"select p_partkey, {r('avg(p_retailprice) over (partition by p_brand)')} as brand_price from part")
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(encode.target_encode(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "brand_price").select("p_partkey", "brand_price"))


@query(f"""select p_partkey, {r('(sum(p_retailprice) over (partition by p_brand) - sum(p_retailprice) over (partition by p_brand, p_partkey % 5)) / nullif(count(*) over (partition by p_brand) - count(*) over (partition by p_brand, p_partkey % 5), 0)', 4)} as brand_price from part""")
def target_encode_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").withColumn("fold", F.col("p_partkey") % 5)
    return finish(encode.target_encode_out_of_fold(d, "p_brand", "p_retailprice", "fold", "brand_price").select("p_partkey", "brand_price"), 4)


@query("select p_partkey, (('0x' || substr(md5(p_brand), 1, 8))::bigint % 16)::int as bucket from part")
def hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", encode.hash_bucket("p_brand", 16).alias("bucket"))


@query("select o_orderkey, o_orderstatus || '_' || o_orderpriority as crossed from orders")
def feature_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", encode.cross("o_orderstatus", "o_orderpriority").alias("crossed"))


@query("""select p_partkey, case when p_brand in (select distinct p_brand from part where p_partkey % 40 = 0) then p_brand else 'UNKNOWN' end as brand from part""")
def unknown_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return encode.unknown_level(p, "p_brand", p.filter(F.col("p_partkey") % 40 == 0), "brand").select("p_partkey", "brand")


@query(f"""select line_id, {r('coalesce(quantity, avg(quantity) over ())')} as quantity, {r('coalesce(price, avg(price) over ())')} as price from {LINES_SQL}""")
def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(impute.mean_impute(lines(spark, sf_dir), ["quantity", "price"]).select("line_id", "quantity", "price"))


@query(f"select p_partkey, {r('coalesce(price_n, avg(price_n) over (partition by p_brand))')} as price from {PARTS_SQL}")
def group_mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(impute.group_mean_impute(parts(spark, sf_dir), "price_n", "p_brand").select("p_partkey", F.col("price_n").alias("price")))


@query(f"""with p as (select * from {PARTS_SQL}), g as (select p_type, median(size_n) m from p group by p_type)
  select p_partkey, {r('coalesce(size_n, m)')} as size from p join g using (p_type)""")
def group_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(impute.group_median_impute(parts(spark, sf_dir), "size_n", "p_type").select("p_partkey", F.col("size_n").alias("size")))


@query(f"""with p as (select * from {PARTS_SQL}), m as (select median(price_n) med from p),
  o as (select size_n as mode from p where size_n is not null group by size_n order by count(*) desc, size_n limit 1)
  select p_partkey, {r('coalesce(price_n, med)')} as price_n, coalesce(size_n, mode)::int as size_n from p, m, o""")
def strategy_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(impute.strategy_impute(parts(spark, sf_dir), {"price_n": "median", "size_n": "mode"}).select("p_partkey", "price_n", "size_n"))


_KNN = f"""with p as (select p_partkey id, p_retailprice x, size_n t from {PARTS_SQL}),
  n as (select a.id q, b.id, b.t, row_number() over (partition by a.id order by abs(a.x - b.x), b.id) rk from p a, p b where a.t is null {{more}})"""


@query(_KNN.format(more="") + """, m as (select q, t, row_number() over (partition by q order by count(*) desc, t) rn from n where rk <= 5 and t is not null group by q, t)
  select id as p_partkey, coalesce(p.t, m.t)::int as size from p left join m on q = id and rn = 1""")
def knn_mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.knn_mode_impute(parts(spark, sf_dir), "size_n", ["p_retailprice"], "p_partkey").select("p_partkey", F.col("size_n").alias("size"))


@query(_KNN.format(more="and b.t is not null") + f""", m as (select q, avg(t) t from n where rk <= 5 group by q)
  select id as p_partkey, {r('coalesce(p.t, m.t)')} as size from p left join m on q = id""")
def knn_mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(impute.knn_mean_impute(parts(spark, sf_dir), "size_n", ["p_retailprice"], "p_partkey").select("p_partkey", F.col("size_n").alias("size")))


@query(_KNN.format(more="") + f""", m as (select q, t, row_number() over (partition by q order by count(*) desc, t) rn from n where rk <= 5 and t is not null group by q, t),
  f as (select id, coalesce(p.t, m.t)::int as size from p left join m on q = id and rn = 1)
  select p_partkey, size, {r('coalesce(price_n, avg(price_n) over (partition by p_type))')} as price from {PARTS_SQL} s join f on s.p_partkey = f.id""")
def impute_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = impute.impute_in_order(parts(spark, sf_dir), "size_n", "p_retailprice", "price_n", "p_type", "p_partkey")
    return finish(d.select("p_partkey", F.col("size_n").alias("size"), F.col("price_n").alias("price")))


_STATS = f"with d as (select * from {LINES_SQL}), s as (select avg(quantity) mq, stddev_samp(quantity) sq, avg(price) mp, stddev_samp(price) sp from d)"


@query(_STATS + f" select line_id, {r('(quantity - mq) / sq')} as quantity, {r('(price - mp) / sp')} as price from d, s")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(scale.zscore(lines(spark, sf_dir), ["quantity", "price"]).select("line_id", "quantity", "price"))


@query(_STATS + f" select line_id, {r('(quantity - mq) / (sq + 1e-8::double)')} as quantity, price from d, s")
def zscore_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(scale.zscore(lines(spark, sf_dir), ["quantity"], epsilon=1e-8).select("line_id", "quantity", "price"))


@query(f"""with d as (select * from {LINES_SQL}) select line_id, {r('(quantity - min(quantity) over ()) / (max(quantity) over () - min(quantity) over ()) * 2 - 1')} as quantity from d""")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(scale.minmax(lines(spark, sf_dir), ["quantity"], -1.0, 1.0).select("line_id", "quantity"))


@query(f"select line_id, case when price > 0 then {r('ln(price)')} end as price, case when tax > 0 then {r('ln(tax)')} end as tax from {LINES_SQL}")
def log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(scale.log_scale(lines(spark, sf_dir), ["price", "tax"]).select("line_id", "price", "tax"))


@query(f"""with d as (select * from {LINES_SQL}), s as (select median(price) m, stddev_samp(price) s from d) select line_id, {r('(price - m) / s')} as price from d, s""")
def median_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(scale.median_scale(lines(spark, sf_dir), ["price"]).select("line_id", "price"))


@query(f"""with d as (select *, line_id % 5 = 0 as held from {LINES_SQL}), s as (select avg(price) m, stddev_samp(price) + 1e-8::double s from d where not held),
  z as (select line_id, held, (price - m) / s as z from d, s), f as (select coalesce(avg(z), 0) f from z where not held)
  select line_id, held, {r('coalesce(z, f)')} as price from z, f""")
def fold_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).withColumn("held", F.col("line_id") % 5 == 0)
    train, held = scale.fold_preprocess(d.filter("not held"), ["price"], d.filter("held"))
    return finish(train.unionByName(held).select("line_id", "held", "price"))


@query(f"""select p_partkey, {r('sqrt((p_size - avg(p_size) over w) ** 2 + (p_retailprice - avg(p_retailprice) over w) ** 2)')} as distance from part window w as (partition by p_type)""")
def center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(features.center_distance(table(spark, sf_dir, "part"), "p_type", "p_size", "p_retailprice", "distance").select("p_partkey", "distance"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then o_totalprice else 0 end as o_totalprice_1, case when o_orderstatus <> 'F' then o_totalprice else 0 end as o_totalprice_0 from orders""")
def interaction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("flag", (F.col("o_orderstatus") == "F").cast("int"))
    return features.interaction_split(d, "o_totalprice", "flag").select("o_orderkey", "o_totalprice_1", "o_totalprice_0")


@query("select p_partkey, p_size::double ** 2 as p_size_pow2, p_size::double ** 3 as p_size_pow3 from part")
def poly_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.powers(table(spark, sf_dir, "part"), ["p_size"], [2, 3]).select("p_partkey", "p_size_pow2", "p_size_pow3")


@query(f"select line_id, {r('price / nullif(tax, 0)')} as ratio from {LINES_SQL}")
def ratio_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(lines(spark, sf_dir).select("line_id", features.ratio("price", "tax").alias("ratio")))


@query("""select o_orderkey, min(year(o_orderdate)) over (partition by o_custkey)::int as first_year, (year(o_orderdate) - min(year(o_orderdate)) over (partition by o_custkey))::int as delta from orders""")
def first_seen_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return features.first_seen_delta(d, "o_custkey", "year", "first_year", "delta").select("o_orderkey", "first_year", "delta")


@query("""select p_partkey, case when p_size between 1 and 12 then 1 when p_size between 8 and 30 then 2 when p_size between 25 and 45 then 3 end as class from part""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.interval_lookup(table(spark, sf_dir, "part"), "p_size", [(1, 1, 12), (2, 8, 30), (3, 25, 45)], "class").select("p_partkey", "class")


_POINTS = "(select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


@query(f"""with p as (select * from {_POINTS}) select a.vec_id, (select count(*) from p b where b.vec_id <> a.vec_id and
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05) as n_neighbours from p a""")
def radius_neighbor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return features.radius_neighbour_count(p, "vec_id", ["x", "y"], 0.05).select("vec_id", "n_neighbours")


@query(f"""with p as (select vec_id, embedding[1]::double * 40 as la, embedding[2]::double * 90 as lo from embeddings),
  h as (select vec_id, sin(radians(10 - la) / 2) ** 2 + cos(radians(la)) * cos(radians(10.0::double)) * sin(radians(20 - lo) / 2) ** 2 as h from p)
  select vec_id, {r('6371.0::double * 2 * atan2(sqrt(h), sqrt(1 - h))')} as km from h""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    km = haversine_km(e[0].cast("double") * 40, e[1].cast("double") * 90, F.lit(10.0), F.lit(20.0))
    return finish(table(spark, sf_dir, "embeddings").select("vec_id", km.alias("km")))


_TERMS = {"size1": "s", "price1": "p", "size2": "s * s", "size1_price1": "s * p", "price2": "p * p", "size3": "s * s * s",
          "size2_price1": "s * s * p", "size1_price2": "s * p * p", "price3": "p * p * p"}


@query(f"select p_partkey, {', '.join(f'{r(e)} as {n}' for n, e in _TERMS.items())} from (select p_partkey, p_size::double / 10 as s, p_retailprice / 1000 as p from part)")
def polynomial_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10).alias("size"), (F.col("p_retailprice") / 1000).alias("price"))
    return finish(p.select("p_partkey", *[c.alias(n) for n, c in features.monomials(["size", "price"], 3).items()]))
