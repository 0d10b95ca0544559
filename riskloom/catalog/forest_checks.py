"""Record forest: nodes, orphans, structure, edges, validation, propagation."""

from pyspark.sql import functions as F

from riskloom.catalog.ordering import sql_u
from riskloom.catalog.projections import INSTALLMENT_SQL
from riskloom.catalog.registry import EXACT, query, rounded, sql_rnd
from riskloom.operators import forest as G
from riskloom.operators.contracts import restrict_to
from riskloom.plans import credit as C
from riskloom.session import materialise

EVENT_TABLES = {"installment": "installments_payments", "pos": "pos_cash_balance", "cc": "credit_card_balance"}


def nodes_of(t, ids=None):
    return G.node_tables(t.loan_tables, t.assignment if ids is None else ids)


def plain_nodes(t):
    """Node tables without row derivations (they do not change which rows are nodes)."""
    return {
        G.CUSTOMER: t.application, G.BUREAU: t.bureau, G.PREV: t.previous_application.withColumn("IS_PLACEHOLDER", F.lit(0)),
        **{k: t[v] for k, v in EVENT_TABLES.items()},
    }


OWN = {G.CUSTOMER: "SK_ID_CURR", G.BUREAU: "SK_ID_BUREAU"}
DERIVED = {
    G.CUSTOMER: ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "PAYMENT_RATE", "GOODS_CREDIT_RATIO", "EXT_SOURCE_PROD", "DOCUMENT_COUNT"],
    G.BUREAU: ["DEBT_CREDIT_RATIO", "OVERDUE_DEBT_RATIO", "HAS_BUREAU_BALANCE"],
    G.PREV: list(C.PREVIOUS_RATIOS),
    "installment": ["PAYMENT_RATIO", "PAYMENT_DIFF", "DPD", "DBD", "IS_PAYMENT_MISSING"],
    "pos": ["CNT_INSTALMENT"],
    "cc": list(C.CARD_RATIOS),
}


def total_of(columns):
    """SQL of the sum of columns over all rows, missing cells as 0."""
    return "sum(" + " + ".join(f"coalesce(cast({c} as double), 0e0)" for c in columns) + ")" if columns else "0e0"


def sums_sql(own="SK_ID_PREV"):
    """Which rows are there, not only how many: sums over customers and over pairs of customer and own id."""
    return f"cast(sum(SK_ID_CURR) as bigint) as root_sum, cast(sum((SK_ID_CURR % 9973) * ({own} % 9973)) as bigint) as pair_sum"


def row_sums(nodes, by=(), counted="nodes", derived=None):
    """Per node type: rows, ``sums_sql`` and, if named, the total of the derived columns."""
    out = None
    for k, df in nodes.items():
        own = OWN.get(k, "SK_ID_PREV")
        extra = [F.expr(total_of(derived[k])).alias("derived_sum")] if derived else []
        pair = (F.col("SK_ID_CURR") % 9973) * (F.col(own) % 9973)
        part = df.groupBy(*by).agg(F.count(F.lit(1)).alias(counted), F.sum("SK_ID_CURR").alias("root_sum"), F.sum(pair).alias("pair_sum"), *extra)
        part = part.withColumn("node_type", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 2)


@query("g01_node_tables", " union all ".join(
    f"select '{k}' as node_type, count(*) as nodes, {sums_sql(OWN.get(k, 'SK_ID_PREV'))}, {sql_rnd(total_of(DERIVED[k]), 2)} as derived_sum from ({source}) x where SK_ID_CURR in (select SK_ID_CURR from assignment where split = 'val')"
    for k, source in {
        "customer": """select *, AMT_CREDIT/nullif(AMT_INCOME_TOTAL,0) as CREDIT_INCOME_RATIO, AMT_ANNUITY/nullif(AMT_INCOME_TOTAL,0) as ANNUITY_INCOME_RATIO, AMT_ANNUITY/nullif(AMT_CREDIT,0) as PAYMENT_RATE,
            AMT_GOODS_PRICE/nullif(AMT_CREDIT,0) as GOODS_CREDIT_RATIO, EXT_SOURCE_1*EXT_SOURCE_2*EXT_SOURCE_3 as EXT_SOURCE_PROD, FLAG_DOCUMENT_3+FLAG_DOCUMENT_6+FLAG_DOCUMENT_10 as DOCUMENT_COUNT from application""",
        "bureau": """select *, AMT_CREDIT_SUM_DEBT/nullif(AMT_CREDIT_SUM,0) as DEBT_CREDIT_RATIO, AMT_CREDIT_SUM_OVERDUE/nullif(AMT_CREDIT_SUM_DEBT,0) as OVERDUE_DEBT_RATIO,
            SK_ID_BUREAU in (select SK_ID_BUREAU from bureau_balance) as HAS_BUREAU_BALANCE from bureau""",
        "prev": "select *, AMT_APPLICATION/nullif(AMT_CREDIT,0) as APP_CREDIT_RATIO, AMT_CREDIT/nullif(AMT_GOODS_PRICE,0) as CREDIT_GOODS_RATIO, AMT_ANNUITY/nullif(AMT_CREDIT,0) as ANNUITY_CREDIT_RATIO from previous_application",
        "installment": INSTALLMENT_SQL,
        "pos": "select * from pos_cash_balance",
        "cc": "select *, AMT_BALANCE/nullif(AMT_CREDIT_LIMIT_ACTUAL,0) as UTILIZATION, AMT_PAYMENT_CURRENT/nullif(AMT_INST_MIN_REGULARITY,0) as PAYMENT_MIN_RATIO from credit_card_balance",
    }.items()))
def node_tables(t):
    """Rows of every node type and the totals of their derived columns."""
    return row_sums(nodes_of(t, t.assignment.filter("split = 'val'")), derived=DERIVED)


@query("g02_bureau_reach", """
select (select count(*) from bureau_balance where SK_ID_BUREAU not in (select SK_ID_BUREAU from bureau)) as bureau_balance_rows_without_bureau,
 (select count(distinct SK_ID_BUREAU) from bureau_balance where SK_ID_BUREAU not in (select SK_ID_BUREAU from bureau)) as bureau_balance_ids_without_bureau,
 (select count(*) from bureau where SK_ID_CURR in (select SK_ID_CURR from assignment where split = 'train') and SK_ID_BUREAU not in (select SK_ID_BUREAU from bureau_balance)) as bureau_without_bureau_balance""")
def bureau_reach(t):
    return G.bureau_reach(t.bureau, t.bureau_balance, C.of_customers(t.bureau, t.assignment.filter("split = 'train'")))


@query("g03_history_flag", "select SK_ID_BUREAU, cast(SK_ID_BUREAU in (select SK_ID_BUREAU from bureau_balance) as bigint) as HAS_BUREAU_BALANCE from bureau")
def history_flag(t):
    return rounded(nodes_of(t)[G.BUREAU].select("SK_ID_BUREAU", "HAS_BUREAU_BALANCE"))


LOOKED = " union all ".join(f"select '{k}' as node_type, e.SK_ID_PREV, e.SK_ID_CURR, p.SK_ID_CURR as owner from {v} e left join previous_application p on p.SK_ID_PREV = e.SK_ID_PREV" for k, v in EVENT_TABLES.items())


@query("g04_orphan_report", f"""
select node_type, count(*) as rows, count(*) filter (where owner is null) as rows_missing_prev, {sql_rnd('avg(case when owner is null then 1e0 else 0e0 end)')} as share_missing_prev,
  count(distinct case when owner is null then SK_ID_PREV end) as distinct_missing_prev, count(distinct case when owner is null then SK_ID_CURR end) as customers_affected,
  count(*) filter (where owner <> SK_ID_CURR) as rows_curr_mismatch from ({LOOKED}) x group by node_type""")
def orphan_report(t):
    return rounded(G.orphan_report(plain_nodes(t)))


SCOPED = " union all ".join(
    f"select '{k}' as node_type, a.client, e.SK_ID_PREV, e.SK_ID_CURR, p.SK_ID_CURR as owner from {v} e join assignment a on a.SK_ID_CURR = e.SK_ID_CURR left join (select q.*, b.client from previous_application q join assignment b using (SK_ID_CURR)) p on p.SK_ID_PREV = e.SK_ID_PREV and p.client = a.client"
    for k, v in EVENT_TABLES.items())


@query("g04_orphan_report_by_client", f"""
select cast(client as bigint) as client, node_type, count(*) as rows, count(*) filter (where owner is null) as rows_missing_prev, {sql_rnd('avg(case when owner is null then 1e0 else 0e0 end)')} as share_missing_prev,
  count(distinct case when owner is null then SK_ID_PREV end) as distinct_missing_prev, count(distinct case when owner is null then SK_ID_CURR end) as customers_affected,
  count(*) filter (where owner <> SK_ID_CURR) as rows_curr_mismatch from ({SCOPED}) x group by client, node_type""")
def orphan_report_by_client(t):
    return rounded(G.orphan_report(G.add_client(plain_nodes(t), t.assignment), ["client"]))


@query("g05_drop_mismatch", f"select node_type, count(*) as rows, {sums_sql()} from ({LOOKED}) x where owner is null or owner = SK_ID_CURR group by node_type")
def drop_mismatch(t):
    fixed = G.resolve_orphans(plain_nodes(t))
    return row_sums({k: fixed[k] for k in G.EVENTS}, counted="rows")


PLACEHOLDER_SQL = f"""select SK_ID_PREV, SK_ID_CURR, max(cast(node_type = 'installment' as bigint)) as PH_FROM_INSTALLMENT, max(cast(node_type = 'pos' as bigint)) as PH_FROM_POS,
  max(cast(node_type = 'cc' as bigint)) as PH_FROM_CC, cast(1 as bigint) as IS_PLACEHOLDER from ({LOOKED}) x where owner is null group by SK_ID_PREV, SK_ID_CURR"""


@query("g06_placeholders", PLACEHOLDER_SQL)
def placeholders(t):
    return rounded(G.placeholders(plain_nodes(t)))


@query("g06_repaired_loans", f"""
select IS_PLACEHOLDER, count(*) as n, cast(sum(PH_FROM_INSTALLMENT) as bigint) as from_installment, cast(sum(PH_FROM_POS) as bigint) as from_pos, cast(sum(PH_FROM_CC) as bigint) as from_cc, count(AMT_CREDIT) as with_credit from (
 select IS_PLACEHOLDER, PH_FROM_INSTALLMENT, PH_FROM_POS, PH_FROM_CC, null as AMT_CREDIT from ({PLACEHOLDER_SQL}) p
 union all select 0, 0, 0, 0, AMT_CREDIT from previous_application) x group by IS_PLACEHOLDER""")
def repaired_loans(t):
    prev = G.resolve_orphans(plain_nodes(t))[G.PREV]
    return rounded(prev.groupBy("IS_PLACEHOLDER").agg(
        F.count(F.lit(1)).alias("n"), F.sum("PH_FROM_INSTALLMENT").alias("from_installment"), F.sum("PH_FROM_POS").alias("from_pos"),
        F.sum("PH_FROM_CC").alias("from_cc"), F.count("AMT_CREDIT").alias("with_credit"),
    ))


@query("g07_drop_orphans", f"select node_type, count(*) as rows, {sums_sql()} from ({LOOKED}) x where owner = SK_ID_CURR group by node_type")
def drop_orphans(t):
    fixed = G.resolve_orphans(plain_nodes(t), "drop")
    return row_sums({k: fixed[k] for k in G.EVENTS}, counted="rows")


KEPT = f"(select node_type, SK_ID_PREV, SK_ID_CURR from ({LOOKED}) x where owner is null or owner = SK_ID_CURR)"
BARE = f"(select SK_ID_PREV, NAME_CONTRACT_STATUS, SK_ID_PREV in (select SK_ID_PREV from {KEPT} k) as hit from previous_application)"


@query("g08_childless_report", f"""
select (select count(*) from {BARE} b where not hit) as prev_without_any_payment_record, (select count(*) from {BARE} b where not hit and NAME_CONTRACT_STATUS = 'Approved') as approved_prev_without_payment_record,
 (select count(*) from application where SK_ID_CURR not in (select SK_ID_CURR from bureau)) as customers_without_bureau,
 (select count(*) from application where SK_ID_CURR not in (select SK_ID_CURR from previous_application) and SK_ID_CURR not in (select SK_ID_CURR from ({PLACEHOLDER_SQL}) p)) as customers_without_prev,
 (select count(*) from application where SK_ID_CURR not in (select SK_ID_CURR from previous_application) and SK_ID_CURR not in (select SK_ID_CURR from ({PLACEHOLDER_SQL}) p) and SK_ID_CURR not in (select SK_ID_CURR from bureau)) as customers_without_any_history""")
def childless_report(t):
    return G.childless_report(G.resolve_orphans(plain_nodes(t)))


@query("g08_coverage_by_status", f"select NAME_CONTRACT_STATUS as status, count(*) as n, {sql_rnd('avg(case when hit then 1e0 else 0e0 end)')} as share_with_payment_record from {BARE} b group by 1")
def coverage_by_status(t):
    return rounded(G.childless_by_status(G.resolve_orphans(plain_nodes(t))))


LOANS = f"(select SK_ID_PREV, SK_ID_CURR, 0 as ph from previous_application union all select SK_ID_PREV, SK_ID_CURR, 1 from ({PLACEHOLDER_SQL}) p)"


def structure_sql(kind, fmt=sql_rnd):
    if kind == G.CUSTOMER:
        return f"""
select a.SK_ID_CURR, {fmt('ln(1e0+coalesce(b.n,0))')} as N_BUREAU, cast(coalesce(b.n,0) > 0 as bigint) as HAS_BUREAU, {fmt('ln(1e0+coalesce(p.n,0))')} as N_PREV, cast(coalesce(p.n,0) > 0 as bigint) as HAS_PREV,
 {fmt('ln(1e0+coalesce(p.ph,0))')} as N_PREV_PLACEHOLDER from application a left join (select SK_ID_CURR, count(*) as n from bureau group by 1) b using (SK_ID_CURR)
 left join (select SK_ID_CURR, count(*) as n, sum(ph) as ph from {LOANS} l group by 1) p using (SK_ID_CURR)"""
    columns = ", ".join(f"{fmt(f'ln(1e0+coalesce({k}.n,0))')} as N_{k.upper()}, cast(coalesce({k}.n,0) > 0 as bigint) as HAS_{k.upper()}" for k in EVENT_TABLES)
    counts = " ".join(f"left join (select SK_ID_PREV, SK_ID_CURR, count(*) as n from {KEPT} k where node_type = '{k}' group by 1,2) {k} on {k}.SK_ID_PREV = l.SK_ID_PREV and {k}.SK_ID_CURR = l.SK_ID_CURR" for k in EVENT_TABLES)
    return f"""
select l.SK_ID_PREV, l.SK_ID_CURR, {columns} from {LOANS} l {counts}"""


STRUCTURE = {G.CUSTOMER: ["N_BUREAU", "HAS_BUREAU", "N_PREV", "HAS_PREV", "N_PREV_PLACEHOLDER"], G.PREV: [f"{p}_{k.upper()}" for k in EVENT_TABLES for p in ("N", "HAS")]}


@query("g09_structural_customer", structure_sql(G.CUSTOMER))
def structural_customer(t):
    out = G.add_structural_features(G.resolve_orphans(plain_nodes(t)))[G.CUSTOMER]
    return rounded(out.select("SK_ID_CURR", *STRUCTURE[G.CUSTOMER]))


@query("g09_structural_loan", structure_sql(G.PREV))
def structural_loan(t):
    out = G.add_structural_features(G.resolve_orphans(plain_nodes(t)))[G.PREV]
    return rounded(out.select("SK_ID_PREV", "SK_ID_CURR", *STRUCTURE[G.PREV]))


@query("g10_root_customer", f"select node_type, SK_ID_CURR as root_id, count(*) as nodes from {KEPT} k group by 1, 2")
def root_customer(t):
    nodes = G.with_roots(G.resolve_orphans(plain_nodes(t)), walk=True)
    return G.node_counts({k: nodes[k] for k in G.EVENTS}, ["root_id"]).select("node_type", "root_id", "nodes")


def edge_nodes(t, policy="placeholder"):
    """Events are keyed and cut to their keys once, before the repair, which then moves narrow rows only."""
    nodes = plain_nodes(t)
    keyed = {k: materialise(G.with_event_keys(nodes[k]).select(G.LOAN, G.ROOT, "event_id"), f"keyed-{k}") for k in G.EVENTS}
    fixed = G.resolve_orphans({**nodes, **keyed}, policy)
    events = {k: materialise(fixed[k], k) for k in G.EVENTS}
    return {**fixed, G.PREV: materialise(fixed[G.PREV].select(G.LOAN, G.ROOT), "prev"), **events}


@query("g11_edges", f"""
with f as (select 'has_bureau' as rel, SK_ID_CURR as src, SK_ID_CURR as root from bureau union all select 'has_prev', SK_ID_CURR, SK_ID_CURR from {LOANS} l
 union all select 'has_'||node_type, SK_ID_PREV, SK_ID_CURR from {KEPT} k)
select rel, count(*) as edges, count(distinct src) as sources, cast(sum(root) as bigint) as root_sum from f group by rel
union all select 'rev_'||rel, count(*), count(distinct src), cast(sum(root) as bigint) from f group by rel""")
def edges(t):
    e = G.edges(edge_nodes(t))
    parent = F.when(F.col("rel").startswith("rev_"), F.col("dst")).otherwise(F.col("src"))
    return rounded(e.groupBy("rel").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(parent).alias("sources"), F.sum("root_id").alias("root_sum")))


@query("g12_validate", f"""
with f as (select 'customer->bureau' as relation, SK_ID_BUREAU % 97 = 0 as one_way, false as moved, false as lost from bureau
 union all select 'customer->prev', false, SK_ID_PREV % 101 = 0, false from {LOANS} l
 union all select 'prev->'||node_type, false, false, node_type = 'installment' and SK_ID_PREV % 89 = 0 from {KEPT} k)
select relation, count_if(not lost)::bigint as edges, count_if(moved)::bigint as edges_without_parent, count_if(one_way)::bigint as reverse_differences, count_if(lost)::bigint as children_without_one_parent, count_if(moved)::bigint as cross_customer_edges from f group by relation""")
def validate(t):
    """With injected faults: edges that miss, edges to a parent that does not exist, edges without their reverse."""
    nodes = edge_nodes(t)
    forward = G.edges(nodes, reverse=False).filter("not (rel = 'has_installment' and src % 89 = 0)")
    moved = forward.withColumn("src", F.when((F.col("rel") == "has_prev") & (F.col("dst") % 101 == 0), F.lit(-1)).otherwise(F.col("src")))
    return rounded(G.validate_forest(nodes, G.with_reverse(moved).filter("not (rel = 'rev_has_bureau' and src % 97 = 0)")))


@query("g13_subgraph", f"""
with c as (select SK_ID_CURR from assignment where client = 3)
select 'customer' as node_type, count(*) as nodes, {sums_sql('SK_ID_CURR')} from c union all select 'bureau', count(*), {sums_sql('SK_ID_BUREAU')} from bureau where SK_ID_CURR in (select * from c)
union all select 'prev', count(*), {sums_sql()} from {LOANS} l where SK_ID_CURR in (select * from c) union all select node_type, count(*), {sums_sql()} from {KEPT} k where SK_ID_CURR in (select * from c) group by node_type""")
def subgraph(t):
    nodes = G.resolve_orphans(plain_nodes(t))
    return row_sums(G.subgraph(nodes, t.assignment.filter("client = 3")))


@query("g14_batches", f"select SK_ID_CURR, cast(floor((row_number() over (order by {sql_u('batch42', 'SK_ID_CURR')}, SK_ID_CURR) - 1)/128e0) as bigint) as batch_id from application")
def batches(t):
    return rounded(G.customer_batches(t.application, 128, 42))


@query("g15_split_by_client", f"""
select cast(a.client as bigint) as client, node_type, count(*) as nodes, {sums_sql('own')} from (
 select 'customer' as node_type, SK_ID_CURR, SK_ID_CURR as own from application union all select 'bureau', SK_ID_CURR, SK_ID_BUREAU from bureau union all select 'prev', SK_ID_CURR, SK_ID_PREV from previous_application
 union all select node_type, SK_ID_CURR, SK_ID_PREV from ({LOOKED}) x) n join assignment a using (SK_ID_CURR) group by 1, 2""")
def split_by_client(t):
    return row_sums(G.add_client(plain_nodes(t), t.assignment), ["client"])


@query("g16_node_report")
def node_report(t):
    """Node and feature counts per client and node type after repair."""
    nodes = G.add_structural_features(G.resolve_orphans(G.add_client(nodes_of(t), t.assignment), scope=["client"]))
    widths = {k: len(G.feature_columns(k, df, ["client"])[0]) + len(G.feature_columns(k, df, ["client"])[1]) for k, df in nodes.items()}
    width = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])
    return rounded(G.node_counts(nodes, ["client"]).withColumn("feature_columns", F.element_at(width, F.col("node_type"))))


@query("g17_prepared_forest", f"""
select 'customer' as node_type, count(*) as nodes, {sums_sql('SK_ID_CURR')}, {sql_rnd(total_of(STRUCTURE[G.CUSTOMER]), 2)} as derived_sum from ({structure_sql(G.CUSTOMER, str)}) x
union all select 'bureau', count(*), {sums_sql('SK_ID_BUREAU')}, 0e0 from bureau
union all select 'prev', count(*), {sums_sql()}, {sql_rnd(total_of(STRUCTURE[G.PREV]), 2)} from ({structure_sql(G.PREV, str)}) x
union all select node_type, count(*), {sums_sql()}, 0e0 from {KEPT} k group by node_type""")
def prepared_forest(t):
    """Rows by root, and the totals of the structural features."""
    nodes, _, _ = G.prepare_forest(nodes_of(t))
    return row_sums({k: df.withColumn("SK_ID_CURR", F.col("root_id")) for k, df in nodes.items()}, derived={k: STRUCTURE.get(k, []) for k in nodes})


def propagation_sql() -> str:
    kept = {k: f"(select e.* from ({src}) e left join previous_application p on p.SK_ID_PREV = e.SK_ID_PREV where p.SK_ID_CURR is null or p.SK_ID_CURR = e.SK_ID_CURR)" for k, src in {
        "installment": "select SK_ID_PREV, SK_ID_CURR, coalesce(AMT_PAYMENT,0)/1e5 as f0, coalesce(DAYS_ENTRY_PAYMENT,0)/1e3 as f1 from installments_payments",
        "pos": "select SK_ID_PREV, SK_ID_CURR, coalesce(CNT_INSTALMENT,0)/1e2 as f0, MONTHS_BALANCE/1e2 as f1 from pos_cash_balance",
        "cc": "select SK_ID_PREV, SK_ID_CURR, coalesce(AMT_BALANCE,0)/1e5 as f0, MONTHS_BALANCE/1e2 as f1 from credit_card_balance"}.items()}
    loans = f"(select SK_ID_PREV, SK_ID_CURR, AMT_CREDIT/1e5 as f0, DAYS_DECISION/1e3 as f1 from previous_application union all select SK_ID_PREV, SK_ID_CURR, 0e0, 0e0 from ({PLACEHOLDER_SQL}) q)"
    means = " ".join(f"left join (select SK_ID_PREV, SK_ID_CURR, avg(f0) as f0, avg(f1) as f1 from {src} s group by 1, 2) {k} on {k}.SK_ID_PREV = l.SK_ID_PREV and {k}.SK_ID_CURR = l.SK_ID_CURR" for k, src in kept.items())
    loan_sum = {f: f"l.{f} + coalesce(c.{f},0) + " + " + ".join(f"coalesce({k}.{f},0)" for k in kept) for f in ("f0", "f1")}
    return f"""with c as (select SK_ID_CURR, coalesce(EXT_SOURCE_2,0) as f0, DAYS_BIRTH/1e4 as f1 from application), b as (select SK_ID_CURR, AMT_CREDIT_SUM/1e5 as f0, DAYS_CREDIT/1e3 as f1 from bureau), l as (select * from {loans} z),
l1 as (select l.SK_ID_CURR, {loan_sum['f0']} as f0, {loan_sum['f1']} as f1 from l left join c on c.SK_ID_CURR = l.SK_ID_CURR {means}),
b1 as (select b.SK_ID_CURR, b.f0 + coalesce(c.f0,0) as f0, b.f1 + coalesce(c.f1,0) as f1 from b left join c on c.SK_ID_CURR = b.SK_ID_CURR),
mb as (select SK_ID_CURR, avg(f0) as f0, avg(f1) as f1 from b group by 1), ml as (select SK_ID_CURR, avg(f0) as f0, avg(f1) as f1 from l group by 1),
mb1 as (select SK_ID_CURR, avg(f0) as f0, avg(f1) as f1 from b1 group by 1), ml1 as (select SK_ID_CURR, avg(f0) as f0, avg(f1) as f1 from l1 group by 1)
select c.SK_ID_CURR, {sql_rnd('c.f0 + coalesce(mb.f0,0) + coalesce(ml.f0,0) + coalesce(mb1.f0,0) + coalesce(ml1.f0,0)', 5)} as f0, {sql_rnd('c.f1 + coalesce(mb.f1,0) + coalesce(ml.f1,0) + coalesce(mb1.f1,0) + coalesce(ml1.f1,0)', 5)} as f1
from c left join mb using (SK_ID_CURR) left join ml using (SK_ID_CURR) left join mb1 using (SK_ID_CURR) left join ml1 using (SK_ID_CURR)"""


@query("g18_mean_propagation", propagation_sql())
def mean_propagation(t):
    fixed = G.resolve_orphans(plain_nodes(t))
    two = {
        G.CUSTOMER: ("EXT_SOURCE_2", 1.0, "DAYS_BIRTH", 1e4), G.BUREAU: ("AMT_CREDIT_SUM", 1e5, "DAYS_CREDIT", 1e3), G.PREV: ("AMT_CREDIT", 1e5, "DAYS_DECISION", 1e3),
        "installment": ("AMT_PAYMENT", 1e5, "DAYS_ENTRY_PAYMENT", 1e3), "pos": ("CNT_INSTALMENT", 1e2, "MONTHS_BALANCE", 1e2), "cc": ("AMT_BALANCE", 1e5, "MONTHS_BALANCE", 1e2),
    }
    nodes = {k: fixed[k].withColumns({"f0": F.col(a) / F.lit(x), "f1": F.col(b) / F.lit(y)}) for k, (a, x, b, y) in two.items()}
    return rounded(G.propagate(nodes, ["f0", "f1"]), 5)
