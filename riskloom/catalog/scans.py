"""Sources and sinks."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import EXACT, query, rounded, sql_rnd
from riskloom.functions.scalar import downcast
from riskloom.operators import predictions as P
from riskloom.operators.contracts import split_or_reuse
from riskloom.operators.summaries import split_summary
from riskloom.session import scratch_path
from riskloom.sources import sinks, tables

CSV_COLUMNS = "SK_ID_CURR, TARGET, CODE_GENDER, AMT_CREDIT, AMT_ANNUITY, DAYS_BIRTH, EXT_SOURCE_2"


@query("s01_csv_scan", f"select SK_ID_CURR, cast(TARGET as bigint) as TARGET, CODE_GENDER, AMT_CREDIT, AMT_ANNUITY, DAYS_BIRTH, EXT_SOURCE_2 from application")
def csv_scan(t):
    path = scratch_path(t.spark, "application-csv")
    t.application.write.option("header", True).csv(path)
    return rounded(tables.read_csv(t.spark, path, t.application.schema, CSV_COLUMNS.split(", ")), EXACT)


@query("s02_downcast", """
select SK_ID_CURR, cast(TARGET as int) as TARGET, cast(cast(AMT_CREDIT as float) as double) as AMT_CREDIT,
  cast(cast(EXT_SOURCE_2 as float) as double) as EXT_SOURCE_2, cast(cast(AMT_ANNUITY as float) as double) as AMT_ANNUITY from application""")
def downcast_columns(t):
    small = downcast(t.application.select("SK_ID_CURR", F.col("TARGET").cast("bigint").alias("TARGET"), "AMT_CREDIT", "EXT_SOURCE_2", "AMT_ANNUITY"))
    return small.withColumns({c: F.col(c).cast("double") for c in ["AMT_CREDIT", "EXT_SOURCE_2", "AMT_ANNUITY"]})


@query("s03_column_subset", """
select SK_ID_CURR, REGION_POPULATION_RELATIVE, cast(REGION_RATING_CLIENT as bigint) as REGION_RATING_CLIENT, AMT_INCOME_TOTAL,
  EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3, DAYS_BIRTH from application""")
def column_subset(t):
    cols = ["SK_ID_CURR", "REGION_POPULATION_RELATIVE", "REGION_RATING_CLIENT", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH"]
    return t.application.select(cols).withColumn("REGION_RATING_CLIENT", F.col("REGION_RATING_CLIENT").cast("bigint"))


@query("s04_parquet_sink", "select SK_ID_CURR, cast(TARGET as bigint) as TARGET, split, cast(client as bigint) as client from assignment")
def parquet_sink(t):
    path = scratch_path(t.spark, "assignment")
    sinks.write_parquet(t.assignment, path, partition_by=["client"])
    return rounded(tables.read_parquet(t.spark, path, ["SK_ID_CURR", "TARGET", "split", "client"]))


@query("s05_client_partitions", "select cast(client as bigint) as client, count(*) as n, cast(sum(TARGET) as bigint) as positives from assignment group by client")
def client_partitions(t):
    path = scratch_path(t.spark, "clients")
    sinks.write_client_partitions(t.assignment, path)
    back = t.spark.read.option("header", True).schema("SK_ID_CURR bigint, TARGET int, split string, client int").csv(path)
    return rounded(back.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.sum("TARGET").alias("positives")))


@query("s06_json_report", """
select cast(client as bigint) as client, '{"n":'||cast(count(*) as varchar)||',"positives":'||cast(cast(sum(TARGET) as bigint) as varchar)||'}' as report
from assignment group by client""")
def json_report(t):
    per = t.assignment.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.sum("TARGET").alias("positives"))
    path = scratch_path(t.spark, "report")
    sinks.write_json(sinks.json_rows(per, ["client"]), path)
    return t.spark.read.schema("client bigint, report string").json(path)


@query("s07_formatted_report", f"""
select cast(client as bigint) as client,
  printf('%+.4f [%+.4f, %+.4f]', {sql_rnd('avg(prob_a)-avg(prob_b)', 4)}, {sql_rnd('min(prob_a-prob_b)', 4)}, {sql_rnd('max(prob_a-prob_b)', 4)}) as delta,
  printf('%.4f ± %.4f', {sql_rnd('avg(prob_a)', 4)}, {sql_rnd('stddev_samp(prob_a)', 4)}) as summary
from scores group by client""")
def formatted_report(t):
    d = F.col("prob_a") - F.col("prob_b")
    per = t.scores.groupBy(F.col("client").cast("bigint").alias("client")).agg(
        (F.avg("prob_a") - F.avg("prob_b")).alias("d"), F.min(d).alias("lo"), F.max(d).alias("hi"),
        F.avg("prob_a").alias("m"), F.stddev_samp("prob_a").alias("s"),
    )
    per = rounded(per, 4)
    out = per.select("client", sinks.delta_cell("d", "lo", "hi").alias("delta"), sinks.mean_std_cell("m", "s").alias("summary"))
    path = scratch_path(t.spark, "report-csv")
    sinks.write_csv_report(out, path)
    return tables.read_csv(t.spark, path, "client bigint, delta string, summary string")


@query("s08_reuse_split", f"select split, count(*) as n, {sql_rnd('avg(TARGET)')} as default_rate from assignment group by split")
def reuse_split(t):
    kept = split_or_reuse(t.assignment, t.application, lambda: t.assignment, ["SK_ID_CURR"])
    return rounded(split_summary(kept))


@query("s09_merge_predictions", f"""
select SK_ID_CURR, cast(client as bigint) as client, split, cast(TARGET as bigint) as TARGET, prob_a,
  case when split <> 'train' then prob_c end as prob_b from scores""")
def merge_predictions(t):
    long = P.to_long(t.scores.drop("prob_c"))
    renewed = t.scores.filter("split <> 'train'").select(*P.KEYS, F.col("prob_c").alias("prob"))
    return rounded(P.to_wide(P.merge_method(long, renewed, "b"), ["a", "b"]), EXACT)


@query("s10_cached_predictions", "select split, count(*) as n from scores group by split")
def cached_predictions(t):
    path = scratch_path(t.spark, "predictions")
    P.cached(t.spark, path, lambda: t.scores)
    return P.cached(t.spark, path, lambda: t.scores.limit(0)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
