"""N-grams, tracking and streaming."""

from __future__ import annotations

import datetime
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear, text, tracking
from ..sources.readers import table
from .base import finish, query, r, rows

_GRAMS = """t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from documents),
  g as (select doc_id, unnest(w) gram from t union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from t where len(w) > 1),
  c as (select doc_id, gram, count(*) n from g group by 1, 2), v as (select gram, count(*) documents, sum(n)::bigint total, row_number() over (order by sum(n) desc, gram) - 1 as "index" from c group by gram)"""


@query(f"""with {_GRAMS} select gram, documents, total, "index" from v""")
def ngram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = text.gram_postings(table(spark, sf_dir, "documents"), "doc_id", "text", cells=False)
    return text.posted_vocabulary(postings).select("gram", "documents", "total", F.col("index").cast("bigint"))


@query(f"""with {_GRAMS} select doc_id, "index", n from c join v using (gram)""")
def ngram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.posted_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("index").cast("bigint"), "n")


# A generated table of runs: one a nation, with a metric at three steps.
_RUNS = "(select 'run' || n_nationkey as run_id, step, ((n_nationkey * 37 + step * 11) % 100)::double / 100 as value from nation, range(3) x(step))"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return n.select(F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run_id"), F.lit("f1").alias("key"), "step",
                    (((F.col("n_nationkey") * 37 + F.col("step") * 11) % 100).cast("double") / 100).alias("value"))


@query(f"select run_id, {r('arg_max(value, step)')} as value from {_RUNS} group by run_id order by value desc, run_id limit 5")
def tracking_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(tracking.best_runs(_metrics(spark, sf_dir), "f1", 5))


@query(f"select run_id, step::int as step, {r('value')} as value, {r('max(value) over (partition by run_id order by step)')} as best from {_RUNS}")
def tracking_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(tracking.history(_metrics(spark, sf_dir), "f1"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("model"), (F.col("n_nationkey") % 4).cast("string")).alias("model"), (F.floor(F.col("n_nationkey") / 4) + 1).cast("int").alias("version"),
                    F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run_id"))


@query("select 'model' || (n_nationkey % 4) as model, max(n_nationkey // 4 + 1)::int as version, arg_max('run' || n_nationkey, n_nationkey) as run_id from nation group by 1")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.latest_versions(_registry(spark, sf_dir))


@query("""select 'model' || (n_nationkey % 4) as model, case when n_nationkey % 3 = 0 then 'champion' else 'challenger' end as alias, arg_max((n_nationkey // 4 + 1)::int, n_nationkey) as version from nation group by 1, 2""")
def registry_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _registry(spark, sf_dir).withColumn("number", F.substring("run_id", 4, 9).cast("int"))
    aliases = n.select("model", F.when(F.col("number") % 3 == 0, "champion").otherwise("challenger").alias("alias"), "version", F.timestamp_seconds("number").alias("changed"))
    return tracking.current_aliases(aliases)


@query("select 'champion' as alias, 2 as version, 'b' as run_id")
def tracking_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log, register and read back through tables in the warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = None if folder else tempfile.mkdtemp()
    when = datetime.datetime(2024, 1, 1)
    t = tracking.Tracker(spark, f"{folder or local}/tracking-{spark.sparkContext.applicationId}-{id(spark)}-{datetime.datetime.now().timestamp()}")
    for run_id, value in (("a", 0.5), ("b", 0.7)):
        t.start(run_id, "fit", when)
        t.params(run_id, {"rate": 0.1})
        t.metrics(run_id, {"f1": value})
        t.set_alias("m", "champion", t.register("m", run_id), when + datetime.timedelta(days=ord(run_id)))
    version = t.by_alias("m", "champion")
    row = t.table("registry").filter(F.col("version") == version).first()
    if local:
        shutil.rmtree(local)
    return rows(spark, [("champion", row["version"], row["run_id"])], "alias string, version int, run_id string")


@query(f"""select event_id, {r('(select regr_intercept(value, event_id % 10) from events) + (select regr_slope(value, event_id % 10) from events) * (event_id % 10)', 4)} as prediction from events""")
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same expression scores a batch here and a stream in ``streaming``."""
    e = table(spark, sf_dir, "events").withColumn("x", (F.col("event_id") % 10).cast("double"))
    model = linear.fit_ols(e, ["x"], "value")
    return finish(e.select("event_id", model.predict().alias("prediction")), 4)
