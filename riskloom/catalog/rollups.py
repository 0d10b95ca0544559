"""Aggregations. The SQL side is generated from its own column lists, one aggregate text per output column."""

from pyspark.sql import functions as F

from riskloom.catalog.projections import INSTALLMENT_SQL
from riskloom.catalog.registry import query, rounded, sql_rnd
from riskloom.functions.scalar import clean_name
from riskloom.operators import summaries as M
from riskloom.operators.encoding import unpivot
from riskloom.operators.ordered import group_quantiles
from riskloom.operators.rollup import Rollup, vocabularies
from riskloom.plans import credit as C


def digits_for(name: str) -> int:
    amount = ("AMT_" in name or "_DIFF" in name or "INCOME_PER_PERSON" in name) and "RATIO" not in name
    return 2 if amount or name.endswith("_SUM") else 5


def round_named(df):
    """Doubles rounded by name; other integers as bigint."""
    return rounded(df, **{c: digits_for(c) for c in df.columns})


def sql_stat(col: str, stat: str, where: str | None = None) -> str:
    flt = f" filter (where {where})" if where else ""
    if stat in ("min", "max"):
        return f"cast({stat}({col}){flt} as double)"
    if stat == "mean":
        return f"avg({col}){flt}"
    if stat == "var":
        return f"var_samp({col}){flt}"
    if stat == "sum":
        s = f"cast(coalesce(sum({col}){flt},0) as double)"
        return f"case when count(*){flt} > 0 then {s} end" if where else s
    if stat == "size":
        return "count(*)"
    if stat == "nunique":
        return f"count(distinct {col})"
    raise ValueError(stat)


def sql_items(prefix, spec, where=None, infix=""):
    return [(clean_name(f"{prefix}{infix}_{c}_{s}"), sql_stat(c, s, where), s in ("size", "nunique")) for c, ss in spec.items() for s in ss]


def sql_shares(prefix, vocab):
    out = []
    for c, values in vocab.items():
        out += [(clean_name(f"{prefix}_{c}_{v}_MEAN"), f"avg(case when {c} = '{v}' then 1e0 else 0e0 end)", False) for v in values]
        out.append((clean_name(f"{prefix}_{c}_nan_MEAN"), f"avg(case when {c} is null then 1e0 else 0e0 end)", False))
    return out


def sql_select(items, key, source, rounding=True):
    seen, cols = set(), []
    for name, expr, count in items:
        if name in seen:
            continue
        seen.add(name)
        cols.append(f"{expr} as {name}" if count or not rounding else f"{sql_rnd(expr, digits_for(name))} as {name}")
    return f"select {key}, " + ",\n ".join(cols) + f"\nfrom {source} where {key} is not null group by {key}"


VOCAB = {
    "STATUS": ["0", "1", "2", "C"],
    "CREDIT_ACTIVE": ["Active", "Closed", "Sold"],
    "CREDIT_CURRENCY": ["currency 1", "currency 2", "currency/2"],
    "CREDIT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}
PREV_VOCAB = {
    "NAME_CONTRACT_TYPE": ["Cash loans", "Consumer loans", "Revolving loans"],
    "NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused"],
    "NAME_PAYMENT_TYPE": ["Cash through the bank", "XNA"],
    "CODE_REJECT_REASON": ["HC", "LIMIT", "XAP"],
    "NAME_CLIENT_TYPE": ["New", "Repeater"],
    "NAME_PORTFOLIO": ["Cards", "Cash", "POS"],
    "NAME_PRODUCT_TYPE": ["XNA", "walk-in", "x-sell"],
    "CHANNEL_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "NAME_YIELD_GROUP": ["high", "low_normal", "middle"],
    "PRODUCT_COMBINATION": ["Cash", "POS household with interest", "POS mobile, other"],
    "NAME_GOODS_CATEGORY": ["Furniture", "Mobile", "XNA"],
    "NAME_CASH_LOAN_PURPOSE": ["Repairs", "XAP"],
    "NAME_SELLER_INDUSTRY": ["Auto technology", "Connectivity", "XNA"],
}
POS_VOCAB = {"NAME_CONTRACT_STATUS": ["click", "error", "purchase", "signup", "view"]}
CARD_VOCAB = {"NAME_CONTRACT_STATUS": ["Active", "Completed", "Signed"]}
CARD_COLUMNS = [
    "MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY", "SK_DPD",
    "UTILIZATION", "PAYMENT_MIN_RATIO",
]

INSTALLMENT_ROLLUP = sql_select([*sql_items("INSTAL", C.INSTALLMENT_SPEC), ("INSTAL_COUNT", "count(*)", True)], "SK_ID_CURR", f"({INSTALLMENT_SQL}) x")
BB_ITEMS = [
    *sql_items("BB", {"MONTHS_BALANCE": ["min", "max", "size"]}),
    *sql_shares("BB", {"STATUS": VOCAB["STATUS"]}),
    ("BB_DPD_RATE", "avg(case when STATUS = '1' then 1e0 else 0e0 end)+avg(case when STATUS = '2' then 1e0 else 0e0 end)", False),
]


def bureau_source(bureau="bureau", bb="bureau_balance"):
    return f"""(select b.*, AMT_CREDIT_SUM_DEBT/nullif(AMT_CREDIT_SUM,0) as DEBT_CREDIT_RATIO, AMT_CREDIT_SUM_OVERDUE/nullif(AMT_CREDIT_SUM_DEBT,0) as OVERDUE_DEBT_RATIO,
  r.BB_MONTHS_BALANCE_MIN, r.BB_MONTHS_BALANCE_SIZE, r.BB_DPD_RATE from {bureau} b left join ({sql_select(BB_ITEMS, 'SK_ID_BUREAU', bb, rounding=False)}) r using (SK_ID_BUREAU)) x"""


BUREAU_ITEMS = [
    *sql_items("BURO", C.BUREAU_SPEC),
    *sql_shares("BURO", {c: VOCAB[c] for c in C.BUREAU_CATEGORIES}),
    ("BURO_COUNT", "count(*)", True),
    *sql_items("BURO", C.BUREAU_SPEC, "CREDIT_ACTIVE = 'Active'", "_ACTIVE"),
    *sql_items("BURO", C.BUREAU_SPEC, "CREDIT_ACTIVE = 'Closed'", "_CLOSED"),
]
PREV_DERIVED = """(select * replace (nullif(DAYS_FIRST_DUE,365243) as DAYS_FIRST_DUE, nullif(DAYS_LAST_DUE,365243) as DAYS_LAST_DUE, nullif(DAYS_TERMINATION,365243) as DAYS_TERMINATION),
  AMT_APPLICATION/nullif(AMT_CREDIT,0) as APP_CREDIT_RATIO, AMT_CREDIT/nullif(AMT_GOODS_PRICE,0) as CREDIT_GOODS_RATIO, AMT_ANNUITY/nullif(AMT_CREDIT,0) as ANNUITY_CREDIT_RATIO,
  nullif(DAYS_LAST_DUE_1ST_VERSION,365243)-nullif(DAYS_LAST_DUE,365243) as DAYS_LAST_DUE_DIFF from previous_application) x"""
PREV_ITEMS = [
    *sql_items("PREV", C.PREVIOUS_SPEC),
    *sql_shares("PREV", PREV_VOCAB),
    ("PREV_COUNT", "count(*)", True),
    *sql_items("PREV", C.PREVIOUS_SPEC, "NAME_CONTRACT_STATUS = 'Approved'", "_APPROVED"),
    *sql_items("PREV", C.PREVIOUS_SPEC, "NAME_CONTRACT_STATUS = 'Refused'", "_REFUSED"),
]
POS_ITEMS = [*sql_items("POS", C.POS_SPEC), *sql_shares("POS", POS_VOCAB), ("POS_COUNT", "count(*)", True)]
CARD_SOURCE = "(select *, AMT_BALANCE/nullif(AMT_CREDIT_LIMIT_ACTUAL,0) as UTILIZATION, AMT_PAYMENT_CURRENT/nullif(AMT_INST_MIN_REGULARITY,0) as PAYMENT_MIN_RATIO from credit_card_balance) x"
CARD_ITEMS = [
    *sql_items("CC", {c: ["min", "max", "mean"] for c in CARD_COLUMNS}),
    *sql_shares("CC", CARD_VOCAB),
    ("CC_COUNT", "count(*)", True),
]


@query("a01_spec_aggregate", sql_select(sql_items("PREV", {"AMT_CREDIT": ["min", "max", "mean", "sum", "var"], "AMT_ANNUITY": ["sum", "size", "nunique"]}), "SK_ID_CURR", "(select * replace (AMT_CREDIT/1e3 as AMT_CREDIT) from previous_application) x"))
def spec_aggregate(t):
    spec = {"AMT_CREDIT": ["min", "max", "mean", "sum", "var"], "AMT_ANNUITY": ["sum", "size", "nunique"]}
    scaled = t.previous_application.withColumn("AMT_CREDIT", F.col("AMT_CREDIT") / F.lit(1e3))
    return round_named(Rollup("SK_ID_CURR", "PREV", spec).apply(scaled))


@query("a02_one_hot_share", sql_select(sql_shares("PREV", {"NAME_CONTRACT_TYPE": PREV_VOCAB["NAME_CONTRACT_TYPE"], "PRODUCT_COMBINATION": PREV_VOCAB["PRODUCT_COMBINATION"]}), "SK_ID_CURR", "previous_application"))
def one_hot_share(t):
    words = vocabularies(t.previous_application, ["NAME_CONTRACT_TYPE", "PRODUCT_COMBINATION"])
    return round_named(Rollup("SK_ID_CURR", "PREV", {}, words).apply(t.previous_application))


@query("a03_row_count", "select SK_ID_CURR, count(*) as POS_COUNT from pos_cash_balance where SK_ID_CURR is not null group by SK_ID_CURR")
def row_count(t):
    return Rollup("SK_ID_CURR", "POS", {}, count_name="POS_COUNT").apply(t.pos_cash_balance)


@query("a04_filtered_subsets", sql_select([
    *sql_items("BURO", {"AMT_CREDIT_SUM_DEBT": ["sum", "max"], "AMT_ANNUITY": ["sum"]}, "CREDIT_ACTIVE = 'Active'", "_ACTIVE"),
    *sql_items("BURO", {"AMT_CREDIT_SUM_DEBT": ["sum", "max"], "AMT_ANNUITY": ["sum"]}, "CREDIT_ACTIVE = 'Sold'", "_SOLD")], "SK_ID_CURR", "bureau"))
def filtered_subsets(t):
    spec = {"AMT_CREDIT_SUM_DEBT": ["sum", "max"], "AMT_ANNUITY": ["sum"]}
    subsets = {"ACTIVE": "CREDIT_ACTIVE <=> 'Active'", "SOLD": "CREDIT_ACTIVE <=> 'Sold'"}
    return round_named(Rollup("SK_ID_CURR", "BURO", {}, subsets=subsets, subset_spec=spec).apply(t.bureau))


@query("a05_bureau_balance_rollup", sql_select(BB_ITEMS, "SK_ID_BUREAU", "bureau_balance"))
def bureau_balance_rollup(t):
    return round_named(C.rollup_bureau_balance(t.bureau_balance))


@query("a06_bureau_rollup", sql_select(BUREAU_ITEMS, "SK_ID_CURR", bureau_source()))
def bureau_rollup(t):
    return round_named(C.rollup_bureau(t.bureau, t.bureau_balance))


@query("a07_previous_rollup", sql_select(PREV_ITEMS, "SK_ID_CURR", PREV_DERIVED))
def previous_rollup(t):
    return round_named(C.rollup_previous(t.previous_application))


@query("a08_installment_rollup", f"select a.SK_ID_CURR, r.* exclude (SK_ID_CURR) from application a left join ({INSTALLMENT_ROLLUP}) r using (SK_ID_CURR)")
def installment_rollup(t):
    rolled = C.rollup_installments(t.installments_payments)
    return round_named(C.attach(t.application.select("SK_ID_CURR"), rolled, "SK_ID_CURR"))


@query("a09_pos_rollup", sql_select(POS_ITEMS, "SK_ID_CURR", "pos_cash_balance"))
def pos_rollup(t):
    return round_named(C.rollup_pos(t.pos_cash_balance))


@query("a10_card_rollup", sql_select(CARD_ITEMS, "SK_ID_CURR", CARD_SOURCE))
def card_rollup(t):
    return round_named(C.rollup_card(t.credit_card_balance))


APPLICATION_CLEAN = f"""select SK_ID_CURR, TARGET, nullif(CODE_GENDER,'XNA') as CODE_GENDER, cast(coalesce(DAYS_EMPLOYED = 365243, false) as int) as DAYS_EMPLOYED_ANOM,
  {sql_rnd('AMT_CREDIT/nullif(AMT_INCOME_TOTAL,0)', 5)} as CREDIT_INCOME_RATIO, {sql_rnd('AMT_INCOME_TOTAL/nullif(CNT_FAM_MEMBERS,0)', 2)} as INCOME_PER_PERSON from application"""


@query("a11_feature_table", f"""
select a.SK_ID_CURR, cast(a.TARGET as bigint) as TARGET, a.CODE_GENDER, cast(a.DAYS_EMPLOYED_ANOM as bigint) as DAYS_EMPLOYED_ANOM, a.CREDIT_INCOME_RATIO, a.INCOME_PER_PERSON,
  b.* exclude (SK_ID_CURR), p.* exclude (SK_ID_CURR), i.* exclude (SK_ID_CURR), s.* exclude (SK_ID_CURR), c.* exclude (SK_ID_CURR)
from ({APPLICATION_CLEAN}) a
left join ({sql_select(BUREAU_ITEMS, 'SK_ID_CURR', bureau_source())}) b using (SK_ID_CURR)
left join ({sql_select(PREV_ITEMS, 'SK_ID_CURR', PREV_DERIVED)}) p using (SK_ID_CURR)
left join ({INSTALLMENT_ROLLUP}) i using (SK_ID_CURR)
left join ({sql_select(POS_ITEMS, 'SK_ID_CURR', 'pos_cash_balance')}) s using (SK_ID_CURR)
left join ({sql_select(CARD_ITEMS, 'SK_ID_CURR', CARD_SOURCE)}) c using (SK_ID_CURR)""")
def feature_table(t):
    full = C.feature_table(t.loan_tables)
    app = ["SK_ID_CURR", "TARGET", "CODE_GENDER", "DAYS_EMPLOYED_ANOM", "CREDIT_INCOME_RATIO", "INCOME_PER_PERSON"]
    rolled = [c for c in full.columns if c.split("_")[0] in ("BURO", "PREV", "INSTAL", "POS", "CC")]
    return round_named(full.select(app + rolled))


@query("a11_model_features")
def model_features(t):
    return C.model_features(t.loan_tables)


APPLICATION_NUMBERS = """select SK_ID_CURR, TARGET, coalesce(DAYS_EMPLOYED = 365243, false) as DAYS_EMPLOYED_ANOM, AMT_CREDIT/nullif(AMT_INCOME_TOTAL,0) as CREDIT_INCOME_RATIO,
  AMT_INCOME_TOTAL/nullif(CNT_FAM_MEMBERS,0) as INCOME_PER_PERSON from application"""
ROLLED = [
    (BUREAU_ITEMS, bureau_source()), (PREV_ITEMS, PREV_DERIVED), ([*sql_items("INSTAL", C.INSTALLMENT_SPEC), ("INSTAL_COUNT", "count(*)", True)], f"({INSTALLMENT_SQL}) x"),
    (POS_ITEMS, "pos_cash_balance"), (CARD_ITEMS, CARD_SOURCE),
]


@query("a11_model_columns", f"""
with wide as (select a.* exclude (SK_ID_CURR), {', '.join(f'r{i}.* exclude (SK_ID_CURR)' for i in range(len(ROLLED)))} from ({APPLICATION_NUMBERS}) a
 {' '.join(f"left join ({sql_select(items, 'SK_ID_CURR', source, rounding=False)}) r{i} using (SK_ID_CURR)" for i, (items, source) in enumerate(ROLLED))}),
cells as (unpivot (select cast(columns(*) as double) from wide) on columns(*) into name column_name value v)
select column_name, count(*) as non_null, count(*) filter (where v > 0) as positive from cells group by column_name having min(v) < max(v) or column_name = 'TARGET'""")
def model_columns(t):
    """Which numbers of the feature table vary, and how many of their cells are filled and positive."""
    df = C.model_features(t.loan_tables)
    app = ["TARGET", "DAYS_EMPLOYED_ANOM", "CREDIT_INCOME_RATIO", "INCOME_PER_PERSON"]
    names = [c for c in df.columns if c in app or c.split("_")[0] in ("BURO", "PREV", "INSTAL", "POS", "CC")]
    cells = unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in names]), names).filter("value is not null")
    return cells.groupBy(F.col("column").alias("column_name")).agg(F.count(F.lit(1)).alias("non_null"), F.count_if(F.col("value") > 0).alias("positive"))


@query("a12_split_summary", f"select split, count(*) as n, {sql_rnd('avg(TARGET)')} as default_rate from assignment group by split")
def split_summary(t):
    return rounded(M.split_summary(t.assignment))


@query("a13_value_counts", f"""
select cast(client as bigint) as client, REGION_RATING_CLIENT, count(*) as n, {sql_rnd('count(*)/cast(sum(count(*)) over (partition by client) as double)')} as share
from (select client, cast(REGION_RATING_CLIENT as bigint) as REGION_RATING_CLIENT from assignment join application using (SK_ID_CURR)) x group by client, REGION_RATING_CLIENT""")
def value_counts(t):
    df = t.assignment.select("SK_ID_CURR", "client").join(t.application.select("SK_ID_CURR", "REGION_RATING_CLIENT"), "SK_ID_CURR")
    return rounded(M.value_counts(df, "REGION_RATING_CLIENT", ["client"]))


@query("a13_value_counts_overall", f"select OCCUPATION_TYPE, count(*) as n, {sql_rnd('count(*)/cast(sum(count(*)) over () as double)')} as share from application where OCCUPATION_TYPE is not null group by OCCUPATION_TYPE")
def value_counts_overall(t):
    return rounded(M.value_counts(t.application, "OCCUPATION_TYPE"))


@query("a14_dense_counts", """
select cast(k.client as bigint) as client, s.split, cast(y.TARGET as bigint) as TARGET, count(a.SK_ID_CURR) as n
from (select unnest(range(0,6)) as client) k, (select unnest(['train','val','test']) as split) s, (select unnest([0,1]) as TARGET) y
left join assignment a on a.client = k.client and a.split = s.split and a.TARGET = y.TARGET group by 1, 2, 3""")
def dense_counts(t):
    domains = {"client": range(6), "split": ["train", "val", "test"], "TARGET": [0, 1]}
    return rounded(M.dense_counts(t.assignment, domains))


SEGMENTS = ["Commercial", "Pensioner", "State servant", "Working"]
SEGMENT_SQL = """case NAME_INCOME_TYPE when 'Working' then 'Working' when 'Commercial associate' then 'Commercial' when 'Businessman' then 'Commercial'
  when 'State servant' then 'State servant' else 'Pensioner' end"""


@query("a15_crosstab", "select cast(client as bigint) as client, " + ", ".join(f"""{sql_rnd(f"avg(case when segment = '{s}' then 1e0 else 0e0 end)")} as "{s}" """ for s in SEGMENTS)
       + f" from (select client, {SEGMENT_SQL} as segment from assignment join application using (SK_ID_CURR)) x group by client")
def crosstab(t):
    seg = t.application.select("SK_ID_CURR", C.S.remap("NAME_INCOME_TYPE", C.SEGMENT_MAP).alias("segment"))
    return rounded(M.crosstab_share(t.assignment.join(seg, "SK_ID_CURR"), "client", "segment", SEGMENTS))


@query("a16_group_median", f"""
select cast(client as bigint) as client, {sql_rnd('quantile_cont(AMT_INCOME_TOTAL, 0.5)', 4)} as median_income, {sql_rnd('avg(AMT_INCOME_TOTAL)', 2)} as mean_income,
  {sql_rnd('quantile_cont(EXT_SOURCE_1, 0.5)')} as median_ext_source_1 from assignment join application using (SK_ID_CURR) group by client""")
def group_median(t):
    df = t.assignment.select("SK_ID_CURR", "client").join(t.application.select("SK_ID_CURR", "AMT_INCOME_TOTAL", "EXT_SOURCE_1"), "SK_ID_CURR")
    q = group_quantiles(df, ["client"], ["AMT_INCOME_TOTAL", "EXT_SOURCE_1"], [0.5])
    med = q.groupBy("client").agg(
        F.max(F.when(F.col("column") == "AMT_INCOME_TOTAL", F.col("value"))).alias("median_income"),
        F.max(F.when(F.col("column") == "EXT_SOURCE_1", F.col("value"))).alias("median_ext_source_1"),
    )
    mean = df.groupBy("client").agg(F.avg("AMT_INCOME_TOTAL").alias("mean_income"))
    return rounded(med.join(mean, "client"), 6, median_income=4, mean_income=2)


@query("a17_distinct_per_group", """
select cast(client as bigint) as client, count(distinct REGION_POPULATION_RELATIVE) as n_REGION_POPULATION_RELATIVE, count(distinct OCCUPATION_TYPE) as n_OCCUPATION_TYPE
from assignment join application using (SK_ID_CURR) group by client""")
def distinct_per_group(t):
    cols = ["REGION_POPULATION_RELATIVE", "OCCUPATION_TYPE"]
    df = t.assignment.select("SK_ID_CURR", "client").join(t.application.select("SK_ID_CURR", *cols), "SK_ID_CURR")
    return rounded(M.distinct_per_group(df, "client", cols))


@query("a18_weighted_average", f"""
select {sql_rnd('sum(n*rate)/sum(n)')} as weighted_rate, {sql_rnd('min(rate)')} as worst_rate, {sql_rnd('avg(rate)')} as plain_rate
from (select client, count(*) as n, avg(TARGET) as rate from assignment group by client) x""")
def weighted_average(t):
    per = t.assignment.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.avg("TARGET").alias("rate"))
    return rounded(per.agg(M.weighted_mean("rate", "n").alias("weighted_rate"), F.min("rate").alias("worst_rate"), F.avg("rate").alias("plain_rate")))


@query("a19_over_seeds", f"""
select cast(client as bigint) as client, {sql_rnd('avg(d)')} as mean, {sql_rnd('coalesce(stddev_samp(d),0)')} as std, count(*) filter (where d > 0) as n_positive, count(d) as n_seeds
from (select client, seed, avg(fedavg)-avg(local) as d from seed_scores group by client, seed) x group by client""")
def over_seeds(t):
    per = t.seed_scores.groupBy("client", "seed").agg((F.avg("fedavg") - F.avg("local")).alias("d"))
    return rounded(M.over_seeds(per, ["client"], "d"))
