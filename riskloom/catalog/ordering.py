"""Ordering, ranks, cuts, curves, argmax, early stopping."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import EXACT, query, rounded, sql_rnd
from riskloom.functions.hashing import uniform
from riskloom.operators import metrics as M
from riskloom.operators import ordered as O


def sql_u(salt: str, key: str) -> str:
    return f"(cast(cast('0x'||substr(md5(concat('{salt}:', cast({key} as varchar))),1,8) as bigint) as double)/4294967296e0)"


@query("w01_csr_offsets", """
select SK_ID_PREV, n_children, cast(sum(n_children) over (order by SK_ID_PREV) - n_children as bigint) as ptr from (
 select p.SK_ID_PREV, count(c.SK_ID_PREV) as n_children from previous_application p left join pos_cash_balance c on p.SK_ID_PREV = c.SK_ID_PREV group by p.SK_ID_PREV) x""")
def csr(t):
    return O.csr_offsets(t.pos_cash_balance, t.previous_application, "SK_ID_PREV", "SK_ID_PREV")


CUTS = {0: [0.4, 0.25, 0.2, 0.1, 0.05], 1: [0.1, 0.1, 0.3, 0.3, 0.2]}


def cut_case() -> str:
    """Number of cuts at or above which a rank lies, per stratum."""
    whens = []
    for s, p in CUTS.items():
        c, parts = 0.0, []
        for x in p[:-1]:
            c += x
            parts.append(f"case when rn > floor({c!r}::double * n) then 1 else 0 end")
        whens.append(f"when {s} then " + " + ".join(parts))
    return "case TARGET " + " ".join(whens) + " end"


@query("w02_prefix_cuts", f"""
select SK_ID_CURR, cast({cut_case()} as bigint) as client from (
 select SK_ID_CURR, TARGET, count(*) over (partition by TARGET) as n, row_number() over (partition by TARGET order by {sql_u('cut', 'SK_ID_CURR')}, SK_ID_CURR) as rn from assignment) x""")
def prefix_cuts(t):
    from riskloom.operators.partition import share_partition

    return rounded(share_partition(t.assignment.select("SK_ID_CURR", "TARGET"), "TARGET", CUTS, "cut").select("SK_ID_CURR", "client"))


@query("w03_top_k", """
select feature, gain, row_number() over (order by gain desc, feature) as rank from (
 select cast(REGION_POPULATION_RELATIVE as varchar) as feature, count(*) as gain from application group by 1) x order by gain desc, feature limit 10""")
def top_k(t):
    gains = t.application.groupBy(F.col("REGION_POPULATION_RELATIVE").cast("string").alias("feature")).agg(F.count(F.lit(1)).alias("gain"))
    return rounded(O.top_k(gains, "gain", "feature", 10))


@query("w04_argmax_first", """
select cast(client as bigint) as client, prob_a as best, cast(n as bigint) as n from (
 select client, prob_a, n, row_number() over (partition by client order by n desc, prob_a) as r from (select client, prob_a, count(*) as n from scores group by client, prob_a) x) y where r = 1""")
def argmax(t):
    per = t.scores.groupBy("client", "prob_a").agg(F.count(F.lit(1)).alias("n"))
    return rounded(per.groupBy("client").agg(O.argmax_first("n", "prob_a", "prob_a").alias("best"), F.max("n").alias("n")), EXACT)


@query("w05_early_stop", f"""
with h as (select client, cast(month as bigint) as step, {sql_rnd('avg(prob_a)', 4)} as value from (
  select client, prob_a, floor({sql_u('step', 'SK_ID_CURR')}*12) as month from scores) s group by client, month),
f as (select *, coalesce(value > max(value) over (partition by client order by step rows between unbounded preceding and 1 preceding), true) as up,
  row_number() over (partition by client order by step) as pos from h),
g as (select *, pos - max(case when up then pos end) over (partition by client order by step) as gap from f),
e as (select client, min(step) as stop_step from g where gap >= 3 group by client),
k as (select g.* from g left join e using (client) where stop_step is null or step <= stop_step)
select cast(k.client as bigint) as client, max(case when up then step end) as best_step, max(case when up then value end) as best_value, min(e.stop_step) as stop_step
from k left join e using (client) group by k.client""")
def early_stop(t):
    step = F.floor(uniform("step", "SK_ID_CURR") * 12)
    history = rounded(t.scores.groupBy("client", step.alias("step")).agg(F.avg("prob_a").alias("value")), 4)
    return O.early_stop(history, ["client"], "step", "value", 3)


@query("w06_score_curve", """
select client, prob, cast(sum(pos) over w as double) as tp, cast(sum(neg) over w as double) as fp, cast(sum(pos) over (partition by client) as double) as p,
  cast(sum(neg) over (partition by client) as double) as n from (
 select cast(client as bigint) as client, prob_b as prob, sum(TARGET) as pos, sum(1-TARGET) as neg from scores group by client, prob_b) x
window w as (partition by client order by prob desc)""")
def score_curve(t):
    curve = M.score_curve(M.score_cells(t.scores, ["client"], "prob_b"), ["client"])
    return rounded(curve.select("client", F.col("score").alias("prob"), "tp", "fp", "p", "n"), EXACT)


@query("w07_sorted_vocabulary", "select value, row_number() over (order by value)-1 as position from (select distinct ORGANIZATION_TYPE||'/'||CODE_GENDER as value from application) x")
def sorted_vocabulary(t):
    words = t.application.select(F.concat_ws("/", "ORGANIZATION_TYPE", "CODE_GENDER").alias("word"))
    return rounded(O.sorted_vocabulary(words, "word"))


@query("w08_exact_quantiles", "select column_name, prob, " + sql_rnd("case prob when 0.01 then a when 0.5 then b else c end", 4) + """ as value from (
 select 'AMT_INSTALMENT' as column_name, unnest([0.01, 0.5, 0.99])::double as prob, quantile_cont(AMT_INSTALMENT, 0.01) as a, quantile_cont(AMT_INSTALMENT, 0.5) as b, quantile_cont(AMT_INSTALMENT, 0.99) as c from installments_payments
 union all select 'DAYS_ENTRY_PAYMENT', unnest([0.01, 0.5, 0.99])::double, quantile_cont(DAYS_ENTRY_PAYMENT, 0.01), quantile_cont(DAYS_ENTRY_PAYMENT, 0.5), quantile_cont(DAYS_ENTRY_PAYMENT, 0.99) from installments_payments) x""")
def exact_quantiles(t):
    q = O.group_quantiles(t.installments_payments, [], ["AMT_INSTALMENT", "DAYS_ENTRY_PAYMENT"], [0.01, 0.5, 0.99])
    return rounded(q.drop("n").withColumnRenamed("column", "column_name"), 4, prob=EXACT)


@query("w09_hashed_rank", f"select SK_ID_CURR, row_number() over (order by {sql_u('rank', 'SK_ID_CURR')}, SK_ID_CURR) as rank from application")
def hashed_rank(t):
    keyed = t.application.select("SK_ID_CURR", uniform("rank", "SK_ID_CURR").alias("u"))
    return rounded(O.hashed_rank(keyed, [], "u", "SK_ID_CURR").select("SK_ID_CURR", "rank"))
