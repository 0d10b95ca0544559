"""Row-level cleaning and derivations."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import query, rounded, sql_rnd
from riskloom.functions import scalar as S
from riskloom.operators.contracts import require_no_null, restrict_to
from riskloom.operators.rollup import varying_columns
from riskloom.plans import credit as C


@query("p01_sentinel_flag", """
select SK_ID_CURR, cast(coalesce(DAYS_EMPLOYED = 365243, false) as bigint) as DAYS_EMPLOYED_ANOM, nullif(DAYS_EMPLOYED, 365243) as DAYS_EMPLOYED from application""")
def sentinel(t):
    return t.application.select(
        "SK_ID_CURR", S.sentinel_flag("DAYS_EMPLOYED", 365243).cast("bigint").alias("DAYS_EMPLOYED_ANOM"), S.null_if("DAYS_EMPLOYED", 365243).alias("DAYS_EMPLOYED")
    )


@query("p02_sentinel_columns", "select SK_ID_PREV, " + ", ".join(f"nullif({c}, 365243) as {c}" for c in C.PREVIOUS_DAYS) + " from previous_application")
def sentinels(t):
    return t.previous_application.select("SK_ID_PREV", *[S.null_if(c, C.DAYS_SENTINEL).alias(c) for c in C.PREVIOUS_DAYS])


@query("p03_placeholders", """
select SK_ID_CURR, nullif(CODE_GENDER, 'XNA') as CODE_GENDER, nullif(NAME_FAMILY_STATUS, 'Unknown') as NAME_FAMILY_STATUS,
  nullif(ORGANIZATION_TYPE, 'XNA') as ORGANIZATION_TYPE, nullif(DAYS_LAST_PHONE_CHANGE, 0) as DAYS_LAST_PHONE_CHANGE from application""")
def placeholders(t):
    cols = ["SK_ID_CURR", "CODE_GENDER", "NAME_FAMILY_STATUS", "ORGANIZATION_TYPE", "DAYS_LAST_PHONE_CHANGE"]
    return C.clean_application(t.application).select(cols)


@query("p04_yes_no", """
select SK_ID_CURR, case FLAG_OWN_CAR when 'Y' then 1e0 when 'N' then 0e0 end as FLAG_OWN_CAR,
  case FLAG_OWN_REALTY when 'Y' then 1e0 when 'N' then 0e0 end as FLAG_OWN_REALTY from application""")
def yes_no(t):
    return t.application.select("SK_ID_CURR", *[S.yes_no(c).alias(c) for c in C.FLAGS])


@query("p05_safe_ratio", "select SK_ID_CURR, AMT_CREDIT/nullif(AMT_INCOME_TOTAL, 0) as ratio from application")
def safe_ratio(t):
    return t.application.select("SK_ID_CURR", S.safe_ratio("AMT_CREDIT", "AMT_INCOME_TOTAL").alias("ratio"))


@query("p06_application_ratios", """
select SK_ID_CURR, AMT_CREDIT/nullif(AMT_INCOME_TOTAL,0) as CREDIT_INCOME_RATIO, AMT_ANNUITY/nullif(AMT_INCOME_TOTAL,0) as ANNUITY_INCOME_RATIO,
  AMT_ANNUITY/nullif(AMT_CREDIT,0) as PAYMENT_RATE, AMT_GOODS_PRICE/nullif(AMT_CREDIT,0) as GOODS_CREDIT_RATIO,
  nullif(DAYS_EMPLOYED,365243)/nullif(DAYS_BIRTH,0) as EMPLOYED_BIRTH_RATIO, AMT_INCOME_TOTAL/nullif(CNT_FAM_MEMBERS,0) as INCOME_PER_PERSON,
  OWN_CAR_AGE/nullif(DAYS_BIRTH,0) as CAR_AGE_BIRTH_RATIO from application""")
def application_ratios(t):
    return C.clean_application(t.application).select("SK_ID_CURR", *C.APPLICATION_RATIOS)


@query("p07_bureau_ratios", """
select SK_ID_BUREAU, AMT_CREDIT_SUM_DEBT/nullif(AMT_CREDIT_SUM,0) as DEBT_CREDIT_RATIO,
  AMT_CREDIT_SUM_OVERDUE/nullif(AMT_CREDIT_SUM_DEBT,0) as OVERDUE_DEBT_RATIO from bureau""")
def bureau_ratios(t):
    return C.with_ratios(t.bureau, C.BUREAU_RATIOS).select("SK_ID_BUREAU", *C.BUREAU_RATIOS)


@query("p08_previous_ratios", """
select SK_ID_PREV, AMT_APPLICATION/nullif(AMT_CREDIT,0) as APP_CREDIT_RATIO, AMT_CREDIT/nullif(AMT_GOODS_PRICE,0) as CREDIT_GOODS_RATIO,
  AMT_ANNUITY/nullif(AMT_CREDIT,0) as ANNUITY_CREDIT_RATIO, nullif(DAYS_LAST_DUE_1ST_VERSION,365243)-nullif(DAYS_LAST_DUE,365243) as DAYS_LAST_DUE_DIFF
from previous_application""")
def previous_ratios(t):
    return C.clean_previous(t.previous_application).select("SK_ID_PREV", *C.PREVIOUS_RATIOS, "DAYS_LAST_DUE_DIFF")


INSTALLMENT_SQL = """
  select *, AMT_PAYMENT/nullif(AMT_INSTALMENT,0) as PAYMENT_RATIO, AMT_INSTALMENT-AMT_PAYMENT as PAYMENT_DIFF,
    case when DAYS_ENTRY_PAYMENT is not null then greatest(DAYS_ENTRY_PAYMENT-DAYS_INSTALMENT, 0) end as DPD,
    case when DAYS_ENTRY_PAYMENT is not null then greatest(DAYS_INSTALMENT-DAYS_ENTRY_PAYMENT, 0) end as DBD,
    case when DAYS_ENTRY_PAYMENT-DAYS_INSTALMENT > 0 then 1 else 0 end as IS_LATE,
    case when AMT_INSTALMENT-AMT_PAYMENT > 0 then 1 else 0 end as IS_UNDERPAID,
    case when AMT_PAYMENT is null then 1 else 0 end as IS_PAYMENT_MISSING from installments_payments"""


@query("p09_installment_derivations", f"""
select SK_ID_PREV, SK_ID_CURR, AMT_INSTALMENT, PAYMENT_RATIO, PAYMENT_DIFF, DPD, DBD, cast(IS_LATE as bigint) as IS_LATE,
  cast(IS_UNDERPAID as bigint) as IS_UNDERPAID, cast(IS_PAYMENT_MISSING as bigint) as IS_PAYMENT_MISSING from ({INSTALLMENT_SQL}) x""")
def installment_derivations(t):
    flags = ["IS_LATE", "IS_UNDERPAID", "IS_PAYMENT_MISSING"]
    out = C.derive_installments(t.installments_payments).withColumns({c: F.col(c).cast("bigint") for c in flags})
    return out.select("SK_ID_PREV", "SK_ID_CURR", "AMT_INSTALMENT", "PAYMENT_RATIO", "PAYMENT_DIFF", "DPD", "DBD", *flags)


@query("p10_card_ratios", """
select SK_ID_PREV, cast(MONTHS_BALANCE as bigint) as MONTHS_BALANCE, AMT_BALANCE/nullif(AMT_CREDIT_LIMIT_ACTUAL,0) as UTILIZATION,
  AMT_PAYMENT_CURRENT/nullif(AMT_INST_MIN_REGULARITY,0) as PAYMENT_MIN_RATIO from credit_card_balance""")
def card_ratios(t):
    return C.derive_card(t.credit_card_balance).select("SK_ID_PREV", F.col("MONTHS_BALANCE").cast("bigint").alias("MONTHS_BALANCE"), *C.CARD_RATIOS)


@query("p11_row_statistics", f"""
select SK_ID_CURR, {sql_rnd('list_avg(l)')} as EXT_SOURCE_MEAN, {sql_rnd('case when len(l) > 1 then list_stddev_samp(l) end')} as EXT_SOURCE_STD,
  list_min(l) as EXT_SOURCE_MIN, {sql_rnd('p')} as EXT_SOURCE_PROD
from (select SK_ID_CURR, EXT_SOURCE_1*EXT_SOURCE_2*EXT_SOURCE_3 as p, list_filter([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], lambda x: x is not null) as l from application) x""")
def row_statistics(t):
    e = C.EXTERNAL
    return t.application.select(
        "SK_ID_CURR", S.tie_safe_round(S.row_mean(e), 6).alias("EXT_SOURCE_MEAN"), S.tie_safe_round(S.row_std(e), 6).alias("EXT_SOURCE_STD"),
        S.row_min(e).alias("EXT_SOURCE_MIN"), S.tie_safe_round(S.row_product(e), 6).alias("EXT_SOURCE_PROD"),
    )


@query("p12_prefix_sum", "select SK_ID_CURR, cast(FLAG_DOCUMENT_3+FLAG_DOCUMENT_6+FLAG_DOCUMENT_10 as double) as DOCUMENT_COUNT from application")
def prefix_row_sum(t):
    return C.clean_application(t.application).select("SK_ID_CURR", "DOCUMENT_COUNT")


@query("p13_finite", "select SK_ID_CURR, case when DAYS_EMPLOYED = 365243 then null when AMT_INCOME_TOTAL = 0 then null else AMT_CREDIT/AMT_INCOME_TOTAL end as ratio from application")
def finite(t):
    raw = t.application.select(
        "SK_ID_CURR",
        F.when(F.col("DAYS_EMPLOYED") == 365243, F.lit(float("nan"))).when(F.col("AMT_INCOME_TOTAL") == 0, F.lit(float("inf")))
        .otherwise(S.safe_ratio("AMT_CREDIT", "AMT_INCOME_TOTAL")).alias("ratio"),
    )
    return S.finite_all(raw)


@query("p14_constant_columns", """
select 'FLAG_DOCUMENT_10' as column_name where (select count(distinct FLAG_DOCUMENT_10) from application) <= 1
union all select 'DAYS_INSTALMENT' where (select count(distinct DAYS_INSTALMENT) from installments_payments) <= 1
union all select 'CODE_GENDER' where (select count(distinct CODE_GENDER) from application) <= 1""")
def constant_columns(t):
    found = []
    for df, cols in [(t.application, ["FLAG_DOCUMENT_10", "CODE_GENDER", "TARGET"]), (t.installments_payments, ["DAYS_INSTALMENT", "AMT_PAYMENT"])]:
        kept = varying_columns(df.select(cols))
        found += [c for c in cols if c not in kept]
    return t.spark.createDataFrame([(c,) for c in found], "column_name string")


def filled_cells(df, cols):
    """(column_name, filled): non-null cells per column, one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(cols)])))


RATIOS_SQL = ", ".join(f"{a}/nullif({b},0) as {name}" for name, (a, b) in C.APPLICATION_RATIOS.items())
PLACEHOLDERS_SQL = ", ".join(f"nullif({c},'{p}') as {c}" for c, p in C.PLACEHOLDERS.items())
FLAGS_SQL = ", ".join(f"case {c} when 'Y' then 1 when 'N' then 0 end as {c}" for c in C.FLAGS)


@query("p15_column_types", rf"""
with base as (select * replace (nullif(DAYS_EMPLOYED,365243) as DAYS_EMPLOYED, nullif(DAYS_LAST_PHONE_CHANGE,0) as DAYS_LAST_PHONE_CHANGE, {PLACEHOLDERS_SQL}, {FLAGS_SQL}),
  cast(coalesce(DAYS_EMPLOYED = 365243, false) as int) as DAYS_EMPLOYED_ANOM, list_filter([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], lambda x: x is not null) as l from application),
clean as (select * exclude (SK_ID_CURR, TARGET, l), {RATIOS_SQL}, list_avg(l) as EXT_SOURCE_MEAN, case when len(l) > 1 then list_stddev_samp(l) end as EXT_SOURCE_STD, list_min(l) as EXT_SOURCE_MIN,
  EXT_SOURCE_1*EXT_SOURCE_2*EXT_SOURCE_3 as EXT_SOURCE_PROD, cast(FLAG_DOCUMENT_3+FLAG_DOCUMENT_6+FLAG_DOCUMENT_10 as double) as DOCUMENT_COUNT from base),
counts as (select count(columns('^(.*)$')) as "\1" from clean), kinds as (select any_value(typeof(columns('^(.*)$'))) as "\1" from clean)
select column_name, case when kind = 'VARCHAR' then 'categorical' else 'numeric' end as kind, filled
from (unpivot counts on columns(*) into name column_name value filled) join (unpivot kinds on columns(*) into name column_name value kind) using (column_name)""")
def column_types(t):
    df = C.clean_application(t.application)
    num, cat = S.split_feature_types(df)
    kind = F.when(F.col("column_name").isin(cat), "categorical").otherwise("numeric")
    return filled_cells(df, num + cat).select("column_name", kind.alias("kind"), "filled")


@query("p16_segment_map", """
select SK_ID_CURR, case NAME_INCOME_TYPE when 'Working' then 'Working' when 'Commercial associate' then 'Commercial' when 'Businessman' then 'Commercial'
  when 'State servant' then 'State servant' else 'Pensioner' end as segment from application""")
def segment_map(t):
    out = t.application.select("SK_ID_CURR", S.remap("NAME_INCOME_TYPE", C.SEGMENT_MAP).alias("segment"))
    return require_no_null(out, ["segment"])


@query("p17_key_filter", """
select SK_ID_PREV, SK_ID_CURR, AMT_CREDIT from previous_application where SK_ID_CURR in (select SK_ID_CURR from assignment where split = 'train')""")
def key_filter(t):
    return C.of_customers(t.previous_application, t.assignment.filter("split = 'train'")).select("SK_ID_PREV", "SK_ID_CURR", "AMT_CREDIT")


@query("p18_restrict_to_ids", "select a.SK_ID_CURR, a.AMT_CREDIT from application a join assignment s on a.SK_ID_CURR = s.SK_ID_CURR where s.split = 'val'")
def restrict_ids(t):
    return restrict_to(t.application.select("SK_ID_CURR", "AMT_CREDIT"), t.assignment.filter("split = 'val'"), "SK_ID_CURR")


@query("p19_profile_units", f"select SK_ID_CURR, {sql_rnd('ln(1e0+AMT_INCOME_TOTAL)')} as LOG_INCOME, {sql_rnd('-DAYS_BIRTH/365.25e0')} as AGE_YEARS from application")
def profile_units(t):
    return t.application.select(
        "SK_ID_CURR", S.tie_safe_round(F.log1p("AMT_INCOME_TOTAL"), 6).alias("LOG_INCOME"), S.tie_safe_round(S.age_years("DAYS_BIRTH"), 6).alias("AGE_YEARS")
    )


@query("p20_clean_names", """
select n as column_name, count(*) as customers from (select distinct SK_ID_CURR from bureau) x,
  (select unnest(['BURO_CREDIT_CURRENCY_CURRENCY_1_MEAN', 'BURO_CREDIT_CURRENCY_CURRENCY_2_MEAN', 'BURO_CREDIT_CURRENCY_NAN_MEAN']) as n) y group by n""")
def clean_names(t):
    """Names of the currency shares after cleaning; of the two colliding codes the first is kept."""
    out = C.rollup_bureau(t.bureau, t.bureau_balance)
    cols = [c for c in out.columns if c.startswith("BURO_CREDIT_CURRENCY")]
    return filled_cells(out, cols).withColumnRenamed("filled", "customers")


@query("p21_logit", f"""
select SK_ID_CURR, {sql_rnd('ln(q/(1e0-q))')} as logit, {sql_rnd('1e0/(1e0+exp(-ln(q/(1e0-q))))')} as back
from (select SK_ID_CURR, least(greatest(coalesce(EXT_SOURCE_3, 0e0), 1e-6), 1e0-1e-6) as q from application) x""")
def logit(t):
    p = F.coalesce("EXT_SOURCE_3", F.lit(0.0))
    return rounded(t.application.select("SK_ID_CURR", S.logit(p).alias("logit"), S.sigmoid(S.logit(p)).alias("back")))
