"""Splits, institution assignment, diagnostics."""

from pyspark.sql import functions as F

from riskloom.catalog.ordering import sql_u
from riskloom.catalog.registry import query, rounded, sql_rnd
from riskloom.catalog.rollups import SEGMENT_SQL, SEGMENTS
from riskloom.functions.scalar import remap
from riskloom.operators import diagnostics as D
from riskloom.operators import partition as P
from riskloom.operators.summaries import crosstab_share
from riskloom.plans import credit as C
from riskloom.sources.sinks import json_rows


@query("pt01_stratified_split", f"""
with c as (select TARGET, count(*) as k, (select count(*) from application) as n from application group by TARGET),
q1 as (select *, n - cast(ceil(0.15e0*n) as bigint) as rest from c),
q2 as (select *, cast(floor(k*rest/cast(n as double)) as bigint) as f1, k*rest/cast(n as double) - floor(k*rest/cast(n as double)) as r1 from q1),
q3 as (select *, f1 + case when row_number() over (order by r1 desc, TARGET) <= rest - sum(f1) over () then 1 else 0 end as kept from q2),
q4 as (select *, rest - cast(ceil(0.15e0/(1-0.15e0)*rest) as bigint) as tr from q3),
q5 as (select *, cast(floor(kept*tr/cast(rest as double)) as bigint) as f2, kept*tr/cast(rest as double) - floor(kept*tr/cast(rest as double)) as r2 from q4),
q6 as (select *, f2 + case when row_number() over (order by r2 desc, TARGET) <= tr - sum(f2) over () then 1 else 0 end as train from q5),
r as (select SK_ID_CURR, TARGET, row_number() over (partition by TARGET order by {sql_u('split42', 'SK_ID_CURR')}, SK_ID_CURR) as rn from application)
select SK_ID_CURR, cast(r.TARGET as bigint) as TARGET, case when rn <= k - kept then 'test' when rn <= k - train then 'val' else 'train' end as split from r join q6 on q6.TARGET = r.TARGET""")
def stratified_split(t):
    return rounded(P.stratified_split(t.application))


def cuts_sql(stratum: str, shares: dict, salt: str, source: str) -> str:
    whens = []
    for s, p in shares.items():
        c, parts = 0.0, []
        for x in p[:-1]:
            c += x
            parts.append(f"case when rn > floor({c!r}::double * n) then 1 else 0 end")
        lit = f"'{s}'" if isinstance(s, str) else s
        whens.append(f"when {lit} then " + " + ".join(parts))
    return f"""select SK_ID_CURR, cast(case {stratum} {' '.join(whens)} end as bigint) as client from (
 select SK_ID_CURR, {stratum}, count(*) over (partition by {stratum}) as n, row_number() over (partition by {stratum} order by {sql_u(salt, 'SK_ID_CURR')}, SK_ID_CURR) as rn from {source} s) x"""


LABEL_SHARES = P.dirichlet_shares([0, 1], 5, 0.5, P.np.random.default_rng(42))
SEGMENT_SHARES = P.dirichlet_shares(SEGMENTS, 5, 0.5, P.np.random.default_rng(42), 0.1)


@query("pt02_label_partition", cuts_sql("TARGET", LABEL_SHARES, "label", "application"))
def label_partition(t):
    return rounded(P.share_partition(t.application.select("SK_ID_CURR", "TARGET"), "TARGET", LABEL_SHARES, "label").select("SK_ID_CURR", "client"))


TERRITORY_SHARES = P.drawn_shares(5, 0.5, P.np.random.default_rng(42))
REGION_SQL = "cast(round(REGION_POPULATION_RELATIVE*1000)-1 as int)"


@query("pt03_territory_partition", f"""
with recursive counted as (select {REGION_SQL} as region, count(*) as n from application group by 1),
drawn as (select region, n, row_number() over (order by sha256('territory42|'||region), region) as turn from counted),
walk as (select 0::bigint as turn, -1 as region, -1::bigint as client, [{', '.join(f'{q!r}::double*(select sum(n) from counted)' for q in TERRITORY_SHARES)}] as lacks
 union all select d.turn, d.region, list_position(lacks, list_max(lacks)) - 1, list_transform(lacks, lambda x, i: case when i = list_position(lacks, list_max(lacks)) then x - d.n else x end)
 from walk w join drawn d on d.turn = w.turn + 1)
select SK_ID_CURR, w.client from application a join walk w on w.region = cast(round(a.REGION_POPULATION_RELATIVE*1000)-1 as int)""")
def territory_partition(t):
    """Regions counted, drawn in hash order and walked: each goes to the institution furthest below its drawn share."""
    regions = t.application.select("SK_ID_CURR", (F.round(F.col("REGION_POPULATION_RELATIVE") * 1000) - 1).cast("int").alias("region"))
    return rounded(P.territory_partition(regions, "region", TERRITORY_SHARES, "territory42").select("SK_ID_CURR", "client"))


def segmented(t):
    return t.application.select("SK_ID_CURR", "TARGET", remap("NAME_INCOME_TYPE", C.SEGMENT_MAP).alias("segment"))


@query("pt04_segment_partition", cuts_sql("segment", SEGMENT_SHARES, "segment", f"(select SK_ID_CURR, {SEGMENT_SQL} as segment from application)"))
def segment_partition(t):
    return rounded(P.share_partition(segmented(t), "segment", SEGMENT_SHARES, "segment").select("SK_ID_CURR", "client"))


@query("pt05_semantic_hash", """
select SK_ID_CURR, partition_group, cast(('0x'||substr(sha256(partition_group),1,16))::ubigint % 10 as bigint) as client_id from (
 select SK_ID_CURR, concat_ws('|', coalesce(cast(REGION_RATING_CLIENT_W_CITY as varchar),'UNKNOWN'), coalesce(OCCUPATION_TYPE,'UNKNOWN')) as partition_group from application) x""")
def semantic_hash(t):
    out = P.semantic_hash_partition(t.application, ["REGION_RATING_CLIENT_W_CITY", "OCCUPATION_TYPE"], 10)
    return rounded(out.select("SK_ID_CURR", "partition_group", "client_id"))


@query("pt06_constraints", f"""
with g as (select k, s, y from (select unnest(range(0,5)) as k) a, (select unnest(['train','val','test']) as s) b, (select unnest([0,1]) as y) c),
n as (select g.k, g.s, g.y, count(a.SK_ID_CURR) as n from g left join assignment a on a.client = g.k and a.split = g.s and a.TARGET = g.y group by 1,2,3),
p as (select k, sum(n) as size, min(n) as cell from n group by k)
select {sql_rnd('min(size)/sum(size)')} as min_share, min(cell) as min_cell, min(size)/sum(size) >= 0.03e0 and min(cell) >= 1 as satisfied from p""")
def constraints(t):
    return rounded(P.constraint_check(t.assignment, 5, 0.03, 1))


@query("pt07_rejection_search")
def rejection_search(t):
    region = t.application.select("SK_ID_CURR", "REGION_POPULATION_RELATIVE", remap("NAME_INCOME_TYPE", C.SEGMENT_MAP).alias("segment"))
    splits = t.assignment.drop("client").join(region, "SK_ID_CURR")
    out = None
    for method, attribute in [("region_territory", "REGION_POPULATION_RELATIVE"), ("segment_mix", "segment"), ("dirichlet_label", None)]:
        found, info = P.partition_clients(splits, method, 4, 5.0, 42, attribute, 0.1, 0.05, 0)
        per = found.groupBy("client", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("TARGET").alias("positives"))
        per = per.select(F.lit(method).alias("method"), F.lit(info["attempts"]).alias("attempts"), "*")
        out = per if out is None else out.unionByName(per)
    return rounded(out)


# --------------------------------------------------------------------------------------------------------- diagnostics
PROFILE = ["SK_ID_CURR", "REGION_POPULATION_RELATIVE", "REGION_RATING_CLIENT", "AMT_INCOME_TOTAL", "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH"]


def profiled(t):
    return D.with_profile(t.assignment, t.application.select(PROFILE))


@query("d01_client_sizes", f"""
select cast(client as bigint) as client, count(*) as n, cast(sum(TARGET) as bigint) as positives, {sql_rnd('avg(TARGET)')} as default_rate, {sql_rnd('count(*)/cast((select count(*) from assignment) as double)')} as share
from assignment group by client""")
def client_sizes(t):
    return rounded(D.client_sizes(t.assignment))


@query("d01_split_sizes", "select cast(client as bigint) as client, split, count(*) as n, cast(sum(TARGET) as bigint) as positives from assignment group by client, split")
def split_sizes(t):
    return rounded(D.split_sizes(t.assignment))


def kl(a, b):
    return f"case when {a} > 0 then ({a})*log2(({a})/({b})) else 0e0 end"


@query("d02_label_divergence", f"""
select cast(client as bigint) as client, {sql_rnd('(' + ' + '.join([kl('p1', '((p1+q1)/2e0)'), kl('q1', '((p1+q1)/2e0)'), kl('(1e0-p1)', '((2e0-p1-q1)/2e0)'), kl('(1e0-q1)', '((2e0-p1-q1)/2e0)')]) + ')/2e0', 8)} as label_js_divergence
from (select client, avg(TARGET) as p1, (select avg(TARGET) from assignment) as q1 from assignment group by client) x""")
def label_divergence(t):
    return rounded(D.label_divergence(t.assignment), 8)


SHIFT_LONG = """(select client, 'EXT_SOURCE_2' as feature, EXT_SOURCE_2 as v from assignment join application using (SK_ID_CURR) where EXT_SOURCE_2 is not null
 union all select client, 'EXT_SOURCE_3', EXT_SOURCE_3 from assignment join application using (SK_ID_CURR) where EXT_SOURCE_3 is not null
 union all select client, 'LOG_INCOME', ln(1e0+AMT_INCOME_TOTAL) from assignment join application using (SK_ID_CURR)
 union all select client, 'AGE_YEARS', -DAYS_BIRTH/365.25e0 from assignment join application using (SK_ID_CURR))"""


@query("d03_feature_shift", f"""
with l as (select * from {SHIFT_LONG} z), g as (select feature, v, count(*) as c from l group by feature, v),
k as (select distinct client, feature from l), m as (select k.client, g.feature, g.v, g.c, count(l.v) as own from k join g using (feature) left join l on l.feature = g.feature and l.v = g.v and l.client = k.client group by k.client, g.feature, g.v, g.c),
r as (select client, feature, lead(v) over w - v as dx, abs(sum(c) over w/cast(sum(c) over (partition by client, feature) as double) - sum(own) over w/cast(sum(own) over (partition by client, feature) as double)) as d from m window w as (partition by client, feature order by v))
select cast(r.client as bigint) as client, r.feature, {sql_rnd('sum(d*dx)/max(s.sd)')} as distance from r join (select feature, stddev_samp(v) as sd from l group by feature) s on s.feature = r.feature group by r.client, r.feature""")
def feature_shift(t):
    return rounded(D.feature_shift(profiled(t), D.SHIFT_COLUMNS, range(5)))


@query("d04_client_profile", f"""
select cast(client as bigint) as client, count(distinct REGION_POPULATION_RELATIVE) as n_regions, {sql_rnd('quantile_cont(AMT_INCOME_TOTAL,0.5)', 3)} as median_income, {sql_rnd('avg(EXT_SOURCE_2)')} as mean_ext_source_2, {sql_rnd('avg(EXT_SOURCE_3)')} as mean_ext_source_3
from assignment join application using (SK_ID_CURR) group by client""")
def client_profile(t):
    return rounded(D.client_profile(profiled(t)), 6, median_income=3)


@query("d04_rating_shares", f"""
select cast(client as bigint) as client, cast(REGION_RATING_CLIENT as bigint) as REGION_RATING_CLIENT, count(*) as n, {sql_rnd('count(*)/cast(sum(count(*)) over (partition by client) as double)')} as share
from assignment join application using (SK_ID_CURR) group by client, REGION_RATING_CLIENT""")
def rating_shares(t):
    return rounded(D.rating_shares(profiled(t)))


@query("d05_overall", f"""
select {sql_rnd('sum(p)/cast(sum(n) as double)')} as global_default_rate, {sql_rnd('max(n)/cast(min(n) as double)')} as size_max_min_ratio, {sql_rnd('min(r)')} as min_default_rate, {sql_rnd('max(r)')} as max_default_rate
from (select client, count(*) as n, sum(TARGET) as p, avg(TARGET) as r from assignment group by client) x""")
def overall(t):
    return rounded(D.overall(D.client_sizes(t.assignment)))


@query("d05_report_json")
def report_json(t):
    """The whole report as one JSON object per client."""
    return json_rows(D.partition_report(t.assignment, t.application.select(PROFILE), range(5)), ["client"])


@query("d06_segment_mix", "select cast(client as bigint) as client, " + ", ".join(f"""{sql_rnd(f"avg(case when segment = '{s}' then 1e0 else 0e0 end)", 4)} as "{s}" """ for s in SEGMENTS)
       + " from (" + cuts_sql("segment", SEGMENT_SHARES, "segment", f"(select SK_ID_CURR, {SEGMENT_SQL} as segment from application)").replace("select SK_ID_CURR, cast(case", "select SK_ID_CURR, segment, cast(case", 1) + ") y group by client")
def segment_mix(t):
    assigned = P.share_partition(segmented(t), "segment", SEGMENT_SHARES, "segment")
    return rounded(crosstab_share(assigned, "client", "segment", SEGMENTS), 4)
