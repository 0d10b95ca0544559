"""Loan-shaped views over the driver tables, written once as SQL text for two engines.

Customers stand in for applicants, orders for bureau records and previous loans, line items and events for their
children. Missing values, sentinels, orphans and owner mismatches are injected by hashes of the keys; no view drops a
row of its base table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


class SparkText:
    def t(self, name: str) -> str:
        return "{" + name + "}"

    def u(self, salt: str, key: str, slot: int = 0) -> str:
        k = f"concat('{salt}:', cast({key} as string))"
        return f"(cast(conv(substr(md5({k}),{1 + 8 * slot},8),16,10) as bigint)/4294967296e0)"

    def h32(self, salt: str, key: str, slot: int = 0) -> str:
        k = f"concat('{salt}:', cast({key} as string))"
        return f"cast(conv(substr(md5({k}),{1 + 8 * slot},8),16,10) as bigint)"

    def days(self, a: str, b: str) -> str:
        return f"datediff(cast({a} as date), cast({b} as date))"

    def div(self, a: str, b: str) -> str:
        return f"try_divide({a}, {b})"


class DuckText:
    def t(self, name: str) -> str:
        return name

    def u(self, salt: str, key: str, slot: int = 0) -> str:
        return f"(cast({self.h32(salt, key, slot)} as double)/4294967296e0)"

    def h32(self, salt: str, key: str, slot: int = 0) -> str:
        k = f"concat('{salt}:', cast({key} as varchar))"
        return f"cast('0x'||substr(md5({k}),{1 + 8 * slot},8) as bigint)"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', cast({b} as date), cast({a} as date))"

    def div(self, a: str, b: str) -> str:
        return f"(({a})/nullif({b},0))"


def _pick(u: str, *choices: tuple[float, str | None]) -> str:
    """CASE over cumulative cut-offs."""
    whens = " ".join(f"when {u} < {cut}e0 then " + (f"'{v}'" if v is not None else "null") for cut, v in choices[:-1])
    last = choices[-1][1]
    return f"case {whens} else " + (f"'{last}'" if last is not None else "null") + " end"


def application(d) -> str:
    u = lambda n, s=0: d.u(n, "c_custkey", s)
    return f"""
select c_custkey as SK_ID_CURR, case when c_acctbal < 0 then 1 else 0 end as TARGET,
  {_pick(u('a0', 0), (0.62, 'F'), (0.97, 'M'), (1, 'XNA'))} as CODE_GENDER,
  {_pick(u('a0', 1), (0.6, 'Married'), (0.96, 'Single'), (1, 'Unknown'))} as NAME_FAMILY_STATUS,
  case when {u('a0', 2)} < 0.18e0 then 'XNA' else c_mktsegment end as ORGANIZATION_TYPE,
  case when {u('a0', 2)} < 0.18e0 then 365243e0 else -cast(floor(10000e0*{u('a0', 3)}) as double) end as DAYS_EMPLOYED,
  -(7000e0+cast(floor(18000e0*{u('a1', 0)}) as double)) as DAYS_BIRTH,
  case when {u('a1', 1)} < 0.1e0 then 0e0 else -cast(floor(3000e0*{u('a1', 1)}) as double) end as DAYS_LAST_PHONE_CHANGE,
  {_pick(u('a1', 2), (0.33, 'Y'), (0.95, 'N'), (1, 'XNA'))} as FLAG_OWN_CAR,
  {_pick(u('a1', 3), (0.69, 'Y'), (1, 'N'))} as FLAG_OWN_REALTY,
  45000e0+cast(floor(3000e0*{u('a2', 0)}) as double)*1000e0 as AMT_CREDIT,
  case when {u('a2', 1)} < 0.01e0 then 0e0 else 27000e0+cast(floor(400e0*{u('a2', 1)}) as double)*900e0 end as AMT_INCOME_TOTAL,
  case when {u('a2', 2)} < 0.05e0 then null else 2000e0+cast(floor(800e0*{u('a2', 2)}) as double)*75e0 end as AMT_ANNUITY,
  45000e0+cast(floor(2500e0*{u('a2', 3)}) as double)*1000e0 as AMT_GOODS_PRICE,
  1e0+cast(floor(4e0*{u('a3', 0)}) as double) as CNT_FAM_MEMBERS,
  case when {u('a3', 1)} < 0.66e0 then null else cast(floor(40e0*{u('a3', 2)}) as double) end as OWN_CAR_AGE,
  case when {u('a4', 0)} < 0.5e0 then null else cast(floor(1000e0*(0.8e0*{u('a4', 1)}+case when c_acctbal < 0 then 0e0 else 0.15e0 end)) as double)/1000e0 end as EXT_SOURCE_1,
  case when {u('a4', 2)} < 0.05e0 then null else cast(floor(1000e0*(0.75e0*{u('a4', 3)}+case when c_acctbal < 0 then 0e0 else 0.2e0 end)) as double)/1000e0 end as EXT_SOURCE_2,
  case when {u('a5', 0)} < 0.2e0 then null else cast(floor(1000e0*{u('a5', 1)}) as double)/1000e0 end as EXT_SOURCE_3,
  case when {u('a5', 2)} < 0.7e0 then 1 else 0 end as FLAG_DOCUMENT_3,
  case when {u('a5', 3)} < 0.1e0 then 1 else 0 end as FLAG_DOCUMENT_6,
  cast(0 as int) as FLAG_DOCUMENT_10,
  cast(c_nationkey+1 as double)/1000e0 as REGION_POPULATION_RELATIVE,
  n_regionkey+1 as REGION_RATING_CLIENT,
  case when {u('a3', 3)} < 0.9e0 then n_regionkey+1 else 1 end as REGION_RATING_CLIENT_W_CITY,
  {_pick(u('a6', 0), (0.5, 'Working'), (0.72, 'Commercial associate'), (0.9, 'Pensioner'), (0.96, 'State servant'), (0.97, 'Student'), (0.98, 'Unemployed'), (0.99, 'Businessman'), (1, 'Maternity leave'))} as NAME_INCOME_TYPE,
  case when {u('a6', 1)} < 0.3e0 then null else c_mktsegment end as OCCUPATION_TYPE
from {d.t('customer')} join {d.t('nation')} on c_nationkey = n_nationkey"""


def bureau(d) -> str:
    u = lambda n, s=0: d.u(n, "o_orderkey", s)
    return f"""
select o_orderkey as SK_ID_BUREAU, o_custkey as SK_ID_CURR,
  case o_orderstatus when 'O' then 'Active' when 'F' then 'Closed' else case when {u('b0', 0)} < 0.9e0 then 'Sold' end end as CREDIT_ACTIVE,
  {_pick(u('b0', 1), (0.95, 'currency 1'), (0.99, 'currency 2'), (1, 'currency/2'))} as CREDIT_CURRENCY,
  o_orderpriority as CREDIT_TYPE,
  -cast(floor(2900e0*{u('b0', 2)}) as double) as DAYS_CREDIT,
  case when {u('b0', 3)} < 0.06e0 then null else cast(floor(4000e0*{u('b0', 3)}) as double)-2000e0 end as DAYS_CREDIT_ENDDATE,
  case when o_orderstatus = 'F' then -cast(floor(2000e0*{u('b1', 0)}) as double) end as DAYS_ENDDATE_FACT,
  -cast(floor(600e0*{u('b1', 1)}) as double) as DAYS_CREDIT_UPDATE,
  case when {u('b1', 2)} < 0.95e0 then 0e0 else cast(floor(300e0*{u('b1', 3)}) as double) end as CREDIT_DAY_OVERDUE,
  case when {u('b2', 0)} < 0.65e0 then null else cast(floor(900e0*{u('b2', 0)}) as double)*10e0 end as AMT_CREDIT_MAX_OVERDUE,
  case when {u('b2', 1)} < 0.98e0 then 0 else 1 end as CNT_CREDIT_PROLONG,
  case when {u('b2', 2)} < 0.04e0 then 0e0 else o_totalprice end as AMT_CREDIT_SUM,
  case when {u('b2', 3)} < 0.15e0 then null when {u('b2', 3)} < 0.5e0 then 0e0 else o_totalprice*{u('b2', 3)} end as AMT_CREDIT_SUM_DEBT,
  case when {u('b3', 0)} < 0.9e0 then 0e0 else cast(floor(5000e0*{u('b3', 1)}) as double) end as AMT_CREDIT_SUM_OVERDUE,
  case when {u('b3', 2)} < 0.35e0 then null else cast(floor(9000e0*{u('b3', 2)}) as double) end as AMT_CREDIT_SUM_LIMIT,
  case when {u('b3', 3)} < 0.7e0 then null else cast(floor(40000e0*{u('b3', 3)}) as double) end as AMT_ANNUITY
from {d.t('orders')}"""


def bureau_balance(d) -> str:
    return f"""
select case when {d.u('bo', 'l_orderkey')} < 0.06e0 then l_orderkey + 5000000000 else l_orderkey end as SK_ID_BUREAU,
  -cast(floor({d.days('l_shipdate', 'o_orderdate')}/30e0) as int) as MONTHS_BALANCE,
  case when l_linestatus = 'O' and l_quantity = 1 then null when l_returnflag = 'A' then '1'
       when l_returnflag = 'R' and l_quantity < 10 then '2' when l_returnflag = 'R' then '0' else 'C' end as STATUS
from {d.t('lineitem')} join {d.t('orders')} on l_orderkey = o_orderkey"""


def previous_application(d) -> str:
    u = lambda n, s=0: d.u(n, "o_orderkey", s)

    def days(n, s, share=0.3):
        return f"case when {u(n, s)} < {share}e0 then 365243e0 else -cast(floor(2800e0*{u(n, s)}) as double) end"

    return f"""
select o_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR,
  {_pick(u('p0', 0), (0.45, 'Cash loans'), (0.88, 'Consumer loans'), (0.998, 'Revolving loans'), (1, None))} as NAME_CONTRACT_TYPE,
  case o_orderstatus when 'F' then 'Approved' when 'P' then 'Refused' else 'Canceled' end as NAME_CONTRACT_STATUS,
  {_pick(u('p0', 1), (0.6, 'Cash through the bank'), (1, 'XNA'))} as NAME_PAYMENT_TYPE,
  {_pick(u('p0', 2), (0.8, 'XAP'), (0.9, 'HC'), (1, 'LIMIT'))} as CODE_REJECT_REASON,
  {_pick(u('p0', 3), (0.7, 'Repeater'), (1, 'New'))} as NAME_CLIENT_TYPE,
  {_pick(u('p1', 0), (0.5, 'POS'), (0.8, 'Cash'), (1, 'Cards'))} as NAME_PORTFOLIO,
  {_pick(u('p1', 1), (0.6, 'XNA'), (0.9, 'x-sell'), (1, 'walk-in'))} as NAME_PRODUCT_TYPE,
  o_orderpriority as CHANNEL_TYPE,
  {_pick(u('p1', 2), (0.4, 'middle'), (0.7, 'high'), (1, 'low_normal'))} as NAME_YIELD_GROUP,
  {_pick(u('p1', 3), (0.3, 'Cash'), (0.6, 'POS household with interest'), (0.95, 'POS mobile, other'), (1, None))} as PRODUCT_COMBINATION,
  {_pick(u('p2', 0), (0.6, 'XNA'), (0.8, 'Mobile'), (1, 'Furniture'))} as NAME_GOODS_CATEGORY,
  {_pick(u('p2', 1), (0.9, 'XAP'), (1, 'Repairs'))} as NAME_CASH_LOAN_PURPOSE,
  {_pick(u('p2', 2), (0.5, 'XNA'), (0.8, 'Connectivity'), (1, 'Auto technology'))} as NAME_SELLER_INDUSTRY,
  {_pick(u('p2', 3), (0.5, 'Family'), (0.6, 'Children'), (1, None))} as NAME_TYPE_SUITE,
  {_pick(u('p3', 0), (0.2, 'MONDAY'), (0.6, 'TUESDAY'), (1, 'FRIDAY'))} as WEEKDAY_APPR_PROCESS_START,
  {_pick(u('p3', 1), (0.99, 'Y'), (1, 'N'))} as FLAG_LAST_APPL_PER_CONTRACT,
  case when {u('p3', 2)} < 0.22e0 then null else cast(floor(900e0*{u('p3', 2)}) as double)*50e0 end as AMT_ANNUITY,
  case when {u('p3', 3)} < 0.2e0 then 0e0 else o_totalprice*{u('p3', 3)} end as AMT_APPLICATION,
  case when {u('p4', 0)} < 0.02e0 then 0e0 else o_totalprice end as AMT_CREDIT,
  case when {u('p4', 1)} < 0.5e0 then null else cast(floor(20000e0*{u('p4', 1)}) as double) end as AMT_DOWN_PAYMENT,
  case when {u('p4', 2)} < 0.2e0 then null else o_totalprice*{u('p4', 2)} end as AMT_GOODS_PRICE,
  case when {u('p4', 1)} < 0.5e0 then null else {u('p4', 3)} end as RATE_DOWN_PAYMENT,
  cast(floor(24e0*{u('p5', 0)}) as int) as HOUR_APPR_PROCESS_START,
  -cast(floor(2900e0*{u('p5', 1)}) as int) as DAYS_DECISION,
  case when {u('p5', 2)} < 0.2e0 then null else cast(floor(60e0*{u('p5', 2)}) as double) end as CNT_PAYMENT,
  case when {u('p5', 3)} < 0.4e0 then null when {u('p5', 3)} < 0.6e0 then 1 else 0 end as NFLAG_INSURED_ON_APPROVAL,
  {days('p6', 0, 0.9)} as DAYS_FIRST_DRAWING, {days('p6', 1)} as DAYS_FIRST_DUE,
  {days('p6', 2)} as DAYS_LAST_DUE_1ST_VERSION, {days('p6', 3)} as DAYS_LAST_DUE, {days('p7', 0)} as DAYS_TERMINATION
from {d.t('orders')}"""


def installments_payments(d) -> str:
    return f"""
select case when {d.u('io', 'l_orderkey')} < 0.09e0 then l_orderkey + 5000000000 else l_orderkey end as SK_ID_PREV,
  case when l_linenumber = 1 and {d.u('im', 'l_orderkey')} < 0.01e0 then case when o_custkey = 0 then 1 else 0 end else o_custkey end as SK_ID_CURR,
  cast(l_linenumber as double) as NUM_INSTALMENT_VERSION, cast(30 as double) as DAYS_INSTALMENT,
  case when l_returnflag = 'R' and l_linestatus = 'O' then null else cast({d.days('l_shipdate', 'o_orderdate')} as double) end as DAYS_ENTRY_PAYMENT,
  l_extendedprice as AMT_INSTALMENT,
  case when l_returnflag = 'R' and l_linestatus = 'O' then null when l_quantity >= 48 then 0e0 else l_extendedprice*(1e0-l_discount) end as AMT_PAYMENT
from {d.t('lineitem')} join {d.t('orders')} on l_orderkey = o_orderkey"""


def pos_cash_balance(d) -> str:
    return f"""
select case when {d.u('po', 'event_id')} < 0.035e0 then o_orderkey + 5000000000 else o_orderkey end as SK_ID_PREV,
  case when {d.u('pm', 'event_id')} < 0.005e0 then case when o_custkey = 0 then 1 else 0 end else o_custkey end as SK_ID_CURR,
  -cast(floor(96e0*{d.u('pq', 'event_id', 0)}) as int) as MONTHS_BALANCE,
  case when {d.u('pq', 'event_id', 1)} < 0.1e0 then null else cast(floor(value) as double) end as CNT_INSTALMENT,
  cast(floor(24e0*{d.u('pq', 'event_id', 2)}) as double) as CNT_INSTALMENT_FUTURE,
  case when {d.u('pq', 'event_id', 3)} < 0.03e0 then null else event_type end as NAME_CONTRACT_STATUS,
  case when event_type = 'error' then cast(floor(value) as int) else 0 end as SK_DPD,
  case when event_type = 'error' and value > 20 then cast(floor(value) as int) else 0 end as SK_DPD_DEF
from {d.t('events')} join {d.t('orders')} on o_orderkey = cast(floor(event_id/3e0) as bigint)"""


def credit_card_balance(d) -> str:
    return f"""
select case when {d.u('co', 'o.o_orderkey')} < 0.27e0 then p.o_orderkey + 5000000000 else p.o_orderkey end as SK_ID_PREV,
  p.o_custkey as SK_ID_CURR, -cast(floor(96e0*{d.u('cq', 'o.o_orderkey', 0)}) as int) as MONTHS_BALANCE,
  case when {d.u('cq', 'o.o_orderkey', 1)} < 0.05e0 then null else o.o_totalprice*{d.u('cq', 'o.o_orderkey', 1)} end as AMT_BALANCE,
  case when {d.u('cq', 'o.o_orderkey', 2)} < 0.1e0 then 0e0 else o.o_totalprice end as AMT_CREDIT_LIMIT_ACTUAL,
  case when {d.u('cq', 'o.o_orderkey', 3)} < 0.2e0 then null else cast(floor(9000e0*{d.u('cq', 'o.o_orderkey', 3)}) as double) end as AMT_PAYMENT_CURRENT,
  case when {d.u('cr', 'o.o_orderkey', 0)} < 0.3e0 then 0e0 else cast(floor(7000e0*{d.u('cr', 'o.o_orderkey', 0)}) as double) end as AMT_INST_MIN_REGULARITY,
  case when o.o_orderstatus = 'F' then 0 else cast(floor(40e0*{d.u('cr', 'o.o_orderkey', 1)}) as int) end as SK_DPD,
  case o.o_orderstatus when 'O' then 'Active' when 'F' then 'Completed' else 'Signed' end as NAME_CONTRACT_STATUS
from {d.t('orders')} o join {d.t('orders')} p on p.o_orderkey = cast(floor(o.o_orderkey/4e0) as bigint)"""


def assignment(d) -> str:
    u = d.u("split", "c_custkey")
    return f"""
select c_custkey as SK_ID_CURR, case when c_acctbal < 0 then 1 else 0 end as TARGET,
  case when {u} < 0.15e0 then 'test' when {u} < 0.3e0 then 'val' else 'train' end as split,
  case when c_nationkey < 11 then 0 when c_nationkey < 16 then 1 when c_nationkey < 20 then 2 when c_nationkey < 23 then 3 else 4 end as client
from {d.t('customer')}"""


def scores(d) -> str:
    """Predictions of several methods; two decimals in prob_a / prob_b force ties, prob_c is nearly continuous."""
    return f"""
select SK_ID_CURR, client, split, TARGET,
  cast(floor(100e0*(0.02e0+0.7e0*{d.u('sa', 'SK_ID_CURR', 0)}+0.25e0*TARGET)) as double)/100e0 as prob_a,
  cast(floor(100e0*(0.02e0+0.8e0*{d.u('sa', 'SK_ID_CURR', 1)}+0.15e0*TARGET)) as double)/100e0 as prob_b,
  0.05e0+0.6e0*{d.u('sa', 'SK_ID_CURR', 2)}+0.2e0*TARGET as prob_c
from {d.t('assignment')}"""


def seed_scores(d) -> str:
    """Long predictions of three methods under three training seeds."""
    arr = "explode(array(42, 1, 2))" if isinstance(d, SparkText) else "unnest([42, 1, 2])"
    return f"""
select seed, SK_ID_CURR, client, split, TARGET, fedavg, local, hgnn from (
  select seed, SK_ID_CURR, client, split, TARGET,
    cast(floor(200e0*(0.02e0+0.7e0*{d.u('ss', "SK_ID_CURR*100+seed", 0)}+0.25e0*TARGET)) as double)/200e0 as fedavg,
    cast(floor(200e0*(0.02e0+0.8e0*{d.u('ss', "SK_ID_CURR*100+seed", 1)}+0.15e0*TARGET)) as double)/200e0 as local,
    cast(floor(200e0*(0.02e0+0.7e0*{d.u('ss', "SK_ID_CURR*100+seed", 2)}+0.26e0*TARGET)) as double)/200e0 as hgnn
  from (select SK_ID_CURR, client, split, TARGET, {arr} as seed from {d.t('assignment')}) s) x"""


def params(d) -> str:
    """Model parameters per institution: two blocks keyed by name, derived from the institution's customers."""
    arr = "explode(sequence(0, 7))" if isinstance(d, SparkText) else "unnest(range(0, 8))"
    return f"""
select client, key, cast(idx as int) as idx, {d.u('pv', "client*1000+idx", 0)} + case when key = 'head.w' then 1e0 else 0e0 end as value, n
from (select client, key, n, {arr} as idx from (
  select client, split_key as key, count(*) as n from (
    select client, case when split = 'train' then 'enc.w' else 'head.w' end as split_key from {d.t('assignment')}) a
  group by client, split_key) b) c"""


# view -> (text builder, inputs)
VIEWS = {
    "application": (application, ["customer", "nation"]),
    "bureau": (bureau, ["orders"]),
    "bureau_balance": (bureau_balance, ["lineitem", "orders"]),
    "previous_application": (previous_application, ["orders"]),
    "installments_payments": (installments_payments, ["lineitem", "orders"]),
    "pos_cash_balance": (pos_cash_balance, ["events", "orders"]),
    "credit_card_balance": (credit_card_balance, ["orders"]),
    "assignment": (assignment, ["customer"]),
    "scores": (scores, ["assignment"]),
    "seed_scores": (seed_scores, ["assignment"]),
    "params": (params, ["assignment"]),
}


class Tables:
    """Driver tables and views of one scale folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                build, inputs = VIEWS[name]
                self._made[name] = self.spark.sql(build(SparkText()), **{i: self[i] for i in inputs})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    @cached_property
    def loan_tables(self) -> dict[str, DataFrame]:
        return {
            n: self[n]
            for n in [
                "application", "bureau", "bureau_balance", "previous_application", "installments_payments",
                "pos_cash_balance", "credit_card_balance",
            ]
        }


def duck_ctes(names: list[str]) -> str:
    """``name as (...)`` list with the views the query needs, inputs first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in order:
            for i in VIEWS[n][1]:
                visit(i)
            order.append(n)

    for n in names:
        visit(n)
    return ",\n".join(f"{n} as ({VIEWS[n][0](DuckText())})" for n in order)
