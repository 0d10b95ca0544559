"""Set operations over rows and columns."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import EXACT, query, rounded
from riskloom.operators import contracts as K
from riskloom.operators import predictions as P
from riskloom.operators import summaries as M


@query("u01_union_differing", """
select SK_ID_PREV, SK_ID_CURR, AMT_CREDIT, cast(PH_FROM_POS as bigint) as PH_FROM_POS, cast(PH_FROM_CC as bigint) as PH_FROM_CC from (
 select SK_ID_PREV, SK_ID_CURR, AMT_CREDIT, 0 as PH_FROM_POS, 0 as PH_FROM_CC from previous_application
 union all select distinct SK_ID_PREV, SK_ID_CURR, null, 1, 0 from pos_cash_balance where SK_ID_PREV not in (select SK_ID_PREV from previous_application)) x""")
def union_differing(t):
    prev = t.previous_application.select("SK_ID_PREV", "SK_ID_CURR", "AMT_CREDIT")
    extra = t.pos_cash_balance.join(prev, "SK_ID_PREV", "left_anti").select("SK_ID_PREV", "SK_ID_CURR").dropDuplicates()
    out = M.union_schemas([prev, extra.withColumn("PH_FROM_POS", F.lit(1))], ["PH_FROM_POS", "PH_FROM_CC"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ["PH_FROM_POS", "PH_FROM_CC"]})


@query("u02_union_predictions", "select SK_ID_CURR, split, prob_a as prob from scores where split in ('val', 'test')")
def union_predictions(t):
    parts = [t.scores.filter(F.col("split") == s).select("SK_ID_CURR", "split", F.col("prob_a").alias("prob")) for s in ("val", "test")]
    return P.collect_clients(parts)


@query("u03_drop_duplicates", "select distinct SK_ID_PREV, SK_ID_CURR from installments_payments")
def drop_duplicates(t):
    return t.installments_payments.select("SK_ID_PREV", "SK_ID_CURR").dropDuplicates()


@query("u04_id_difference", "select SK_ID_BUREAU from bureau_balance except select SK_ID_BUREAU from bureau")
def id_difference(t):
    return t.bureau_balance.select("SK_ID_BUREAU").subtract(t.bureau.select("SK_ID_BUREAU"))


@query("u05_id_equality", """
select coalesce(a.SK_ID_CURR, b.SK_ID_CURR) as SK_ID_CURR, case when b.SK_ID_CURR is null then 'left' else 'right' end as side
from (select distinct SK_ID_CURR from application) a full outer join (select distinct SK_ID_CURR from pos_cash_balance) b on a.SK_ID_CURR = b.SK_ID_CURR
where a.SK_ID_CURR is null or b.SK_ID_CURR is null""")
def id_equality(t):
    return K.key_difference(t.application, t.pos_cash_balance, ["SK_ID_CURR"])


@query("u06_union_columns", """
select SK_ID_CURR, SK_DPD, AMT_BALANCE, CNT_INSTALMENT from (
 select SK_ID_CURR, cast(SK_DPD as bigint) as SK_DPD, AMT_BALANCE, null::double as CNT_INSTALMENT from credit_card_balance
 union all select SK_ID_CURR, cast(SK_DPD as bigint), null, CNT_INSTALMENT from pos_cash_balance) x""")
def union_columns(t):
    cc = t.credit_card_balance.select("SK_ID_CURR", "SK_DPD", "AMT_BALANCE")
    pos = t.pos_cash_balance.select("SK_ID_CURR", "SK_DPD", "CNT_INSTALMENT")
    return rounded(M.union_schemas([cc, pos]), EXACT)
