"""Join forms and their contracts."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import EXACT, query, rounded, sql_rnd
from riskloom.operators import contracts as K
from riskloom.operators import forest as G
from riskloom.operators import predictions as P
from riskloom.operators.rollup import attach
from riskloom.operators.shift import blend_grid
from riskloom.plans import credit as C

PROFILE = ["SK_ID_CURR", "AMT_INCOME_TOTAL", "EXT_SOURCE_2", "DAYS_BIRTH"]


@query("j01_left_join_rollup", f"""
select a.SK_ID_CURR, r.INSTAL_COUNT, r.INSTAL_DPD_SUM from application a left join
 (select SK_ID_CURR, count(*) as INSTAL_COUNT, {sql_rnd('coalesce(sum(case when DAYS_ENTRY_PAYMENT is not null then greatest(DAYS_ENTRY_PAYMENT-DAYS_INSTALMENT,0) end),0)', 2)} as INSTAL_DPD_SUM
  from installments_payments group by SK_ID_CURR) r using (SK_ID_CURR)""")
def left_join_rollup(t):
    rolled = C.rollup_installments(t.installments_payments).select("SK_ID_CURR", "INSTAL_COUNT", "INSTAL_DPD_SUM")
    return rounded(attach(t.application.select("SK_ID_CURR"), rolled, "SK_ID_CURR"), 2)


@query("j02_one_to_one_join", "select a.SK_ID_CURR, a.AMT_CREDIT, s.split from application a join assignment s using (SK_ID_CURR)")
def one_to_one(t):
    return K.join_one_to_one(t.application.select("SK_ID_CURR", "AMT_CREDIT"), t.assignment.select("SK_ID_CURR", "split"), ["SK_ID_CURR"])


@query("j03_predictions_assignment", "select SK_ID_CURR, s.prob_a, cast(a.client as bigint) as client from scores s join assignment a using (SK_ID_CURR) where s.split = 'test'")
def predictions_assignment(t):
    out = t.scores.filter("split = 'test'").select("SK_ID_CURR", "prob_a").join(t.assignment.select("SK_ID_CURR", "client"), "SK_ID_CURR")
    return rounded(out, EXACT)


@query("j04_assignment_profile", "select SK_ID_CURR, cast(client as bigint) as client, AMT_INCOME_TOTAL, EXT_SOURCE_2, DAYS_BIRTH from assignment left join application using (SK_ID_CURR)")
def assignment_profile(t):
    return t.assignment.select("SK_ID_CURR", F.col("client").cast("bigint").alias("client")).join(t.application.select(PROFILE), "SK_ID_CURR", "left")


@query("j05_outer_merge", """
select coalesce(x.SK_ID_CURR, y.SK_ID_CURR) as SK_ID_CURR, coalesce(x.split, y.split) as split, x.prob_a, y.prob_b from
 (select SK_ID_CURR, client, split, TARGET, prob_a from scores where split <> 'train') x full outer join
 (select SK_ID_CURR, client, split, TARGET, prob_b from scores where split <> 'test') y
 on x.SK_ID_CURR = y.SK_ID_CURR and x.client = y.client and x.split = y.split and x.TARGET = y.TARGET""")
def outer_merge(t):
    left = t.scores.filter("split <> 'train'").select(*P.KEYS, "prob_a")
    right = t.scores.filter("split <> 'test'").select(*P.KEYS, "prob_b")
    return P.outer_merge(left, right, "prob_b").select("SK_ID_CURR", "split", "prob_a", "prob_b")


@query("j06_semi_join", "select SK_ID_PREV, SK_ID_CURR, AMT_INSTALMENT from installments_payments where SK_ID_PREV in (select SK_ID_PREV from previous_application where NAME_CONTRACT_STATUS = 'Approved')")
def semi_join(t):
    approved = t.previous_application.filter("NAME_CONTRACT_STATUS = 'Approved'")
    return C.of_customers(t.installments_payments, approved, "SK_ID_PREV").select("SK_ID_PREV", "SK_ID_CURR", "AMT_INSTALMENT")


@query("j07_anti_join", "select SK_ID_PREV from previous_application where SK_ID_PREV not in (select SK_ID_PREV from pos_cash_balance)")
def anti_join(t):
    return t.previous_application.select("SK_ID_PREV").join(t.pos_cash_balance, "SK_ID_PREV", "left_anti")


@query("j08_owner_lookup", """
select case when p.SK_ID_CURR is null then 'missing' when p.SK_ID_CURR <> i.SK_ID_CURR then 'mismatch' else 'ok' end as state, count(*) as n
from installments_payments i left join previous_application p on i.SK_ID_PREV = p.SK_ID_PREV group by 1""")
def owner_lookup(t):
    looked = G.with_owner(t.installments_payments, t.previous_application)
    return looked.groupBy(G.parent_state().alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("j09_link_to_parent", """
select client_rank, count(*) as n_children from (
 select p.rk as client_rank from previous_application c join (select SK_ID_CURR, row_number() over (order by SK_ID_CURR)-1 as rk from application) p using (SK_ID_CURR)) x
group by client_rank""")
def link_to_parent(t):
    linked = G.dense_links(t.previous_application, t.application, "SK_ID_CURR", "SK_ID_CURR")
    return linked.groupBy(F.col("parent_index").alias("client_rank")).agg(F.count(F.lit(1)).alias("n_children"))


@query("j10_coverage", """
select (select count(*) from scores where split='test') as expected_rows, (select count(*) from scores s join assignment a using (SK_ID_CURR) where s.split='test') as joined_rows,
  cast(0 as bigint) as missing_keys, cast(0 as bigint) as extra_keys""")
def coverage(t):
    test = t.scores.filter("split = 'test'")
    joined = test.join(t.assignment.select("SK_ID_CURR"), "SK_ID_CURR")
    return rounded(K.coverage(test, joined, ["SK_ID_CURR"]))


@query("j11_weight_grid", f"""
select cast(client as bigint) as client, w, {sql_rnd("avg(w*ln(a/(1e0-a))+(1e0-w)*ln(b/(1e0-b)))", 5)} as mean_logit from (
 select client, least(greatest(prob_a,1e-6),1e0-1e-6) as a, least(greatest(prob_b,1e-6),1e0-1e-6) as b, unnest(range(0,21))/20e0 as w from scores where split = 'val') x
group by client, w""")
def weight_grid(t):
    grid = blend_grid(t.scores.filter("split = 'val'"), "prob_a", "prob_b")
    return rounded(grid.groupBy("client", "w").agg(F.avg("score").alias("mean_logit")), 5, w=EXACT)
