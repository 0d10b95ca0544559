"""Prediction metrics, thresholds, comparisons, bootstrap, seed summaries."""

from pyspark.sql import functions as F

from riskloom.catalog.registry import EXACT, query, rounded, sql_rnd
from riskloom.functions.hashing import MASK, MIX_A, MIX_B, POISSON1_CDF, ROUND_STEP
from riskloom.operators import bootstrap as B
from riskloom.operators import metrics as M
from riskloom.operators import predictions as P

LONG = """(select SK_ID_CURR, client, split, TARGET, 'a' as method, prob_a as prob from scores
 union all select SK_ID_CURR, client, split, TARGET, 'b', prob_b from scores union all select SK_ID_CURR, client, split, TARGET, 'c', prob_c from scores)"""


def auc_sql(groups: str, source: str, score: str = "prob") -> str:
    """Rank-sum form over tied scores."""
    return f"""(select {groups}, sum(pos*(below + neg/2e0))/nullif(max(p*n),0) as roc_auc from (
  select *, coalesce(sum(neg) over (partition by {groups} order by s rows between unbounded preceding and 1 preceding),0) as below,
    cast(sum(pos) over (partition by {groups}) as double) as p, cast(sum(neg) over (partition by {groups}) as double) as n from (
   select {groups}, {score} as s, sum(TARGET) as pos, sum(1-TARGET) as neg from {source} src group by {groups}, {score}) c0) c1 group by {groups})"""


def curve_sql(groups: str, source: str) -> str:
    return f"""(select *, cast(sum(pos) over (partition by {groups} order by s desc) as double) as tp, cast(sum(neg) over (partition by {groups} order by s desc) as double) as fp,
  cast(sum(pos) over (partition by {groups}) as double) as p, cast(sum(neg) over (partition by {groups}) as double) as n from (
   select {groups}, prob as s, sum(TARGET) as pos, sum(1-TARGET) as neg from {source} src group by {groups}, prob) c0)"""


def long_scores(t):
    return P.to_long(t.scores)


@query("m01_roc_auc", f"select method, cast(client as bigint) as client, {sql_rnd('roc_auc')} as roc_auc from {auc_sql('method, client', LONG)} x")
def roc_auc(t):
    return rounded(M.auc(long_scores(t), ["method", "client"]))


@query("m01_roc_auc_pooled", f"select method, {sql_rnd('roc_auc')} as roc_auc from {auc_sql('method', LONG)} x")
def roc_auc_pooled(t):
    return rounded(M.auc(long_scores(t), ["method"]))


@query("m02_average_precision", f"select method, cast(client as bigint) as client, {sql_rnd('sum(pos/p*tp/(tp+fp))')} as pr_auc from {curve_sql('method, client', LONG)} x group by method, client")
def average_precision(t):
    g = ["method", "client"]
    return rounded(M.ranking_metrics(M.score_curve(M.score_cells(long_scores(t), g), g), g).select(*g, "pr_auc"))


@query("m03_ks", f"select method, cast(client as bigint) as client, {sql_rnd('greatest(max(tp/p-fp/n),0)')} as ks from {curve_sql('method, client', LONG)} x group by method, client")
def ks(t):
    g = ["method", "client"]
    return rounded(M.ranking_metrics(M.score_curve(M.score_cells(long_scores(t), g), g), g).select(*g, "ks"))


LOSS = "-(case when TARGET = 1 then ln(q) else ln(1e0-q) end)"


@query("m04_brier_logloss", f"""
select method, cast(client as bigint) as client, {sql_rnd('avg((TARGET-prob)*(TARGET-prob))')} as brier, {sql_rnd(f'avg({LOSS})')} as log_loss, count(*) as n, {sql_rnd('avg(TARGET)')} as positive_rate
from (select *, least(greatest(prob,1e-7),1e0-1e-7) as q from {LONG} l) x group by method, client""")
def brier(t):
    g = ["method", "client"]
    return rounded(M.error_metrics(M.score_cells(long_scores(t), g), g))


CONF = "cast(sum(case when TARGET=1 and prob>=threshold then 1 else 0 end) as bigint) as tp, cast(sum(case when TARGET=0 and prob>=threshold then 1 else 0 end) as bigint) as fp, cast(sum(case when TARGET=0 and prob<threshold then 1 else 0 end) as bigint) as tn, cast(sum(case when TARGET=1 and prob<threshold then 1 else 0 end) as bigint) as fn"


def rates_sql() -> str:
    pr, re, sp = "tp/cast(greatest(tp+fp,1) as double)", "tp/cast(greatest(tp+fn,1) as double)", "tn/cast(greatest(tn+fp,1) as double)"
    return (f"{sql_rnd(pr)} as precision, {sql_rnd(re)} as recall, {sql_rnd(sp)} as specificity, "
            f"{sql_rnd(f'2e0*({pr})*({re})/greatest(({pr})+({re}),1e-12)')} as f1, {sql_rnd(f'(({re})+({sp}))/2e0')} as balanced_accuracy")


@query("m05_confusion", f"select method, cast(client as bigint) as client, threshold, tp, fp, tn, fn, {rates_sql()} from (select method, client, threshold, {CONF} from (select *, 0.4e0 as threshold from {LONG} l) a group by method, client, threshold) b")
def confusion(t):
    g = ["method", "client"]
    long = long_scores(t)
    return rounded(M.with_rates(M.confusion(M.score_cells(long, g), M.fixed_threshold(long, g, 0.4), g)), 6, threshold=EXACT)


VAL = f"(select * from {LONG} l where split = 'val')"
F1_SQL = f"(select method, client, s as threshold from (select *, row_number() over (partition by method, client order by 2e0*tp/(tp+fp+p) desc, s) as r from {curve_sql('method, client', VAL)} c) d where r = 1)"


@query("m06_f1_threshold", f"select method, cast(client as bigint) as client, threshold from {F1_SQL} x")
def f1_threshold(t):
    return rounded(M.select_thresholds(long_scores(t).filter("split = 'val'"), ["method", "client"]), EXACT)


@query("m07_youden_threshold", f"""
select method, cast(client as bigint) as client, threshold from (
 select method, client, case when tp/p-fp/n > 0 then s else 'infinity'::double end as threshold, row_number() over (partition by method, client order by tp/p-fp/n desc, s desc) as r
 from {curve_sql('method, client', VAL)} c) d where r = 1""")
def youden_threshold(t):
    out = M.select_thresholds(long_scores(t).filter("split = 'val'"), ["method", "client"], "youden")
    return out.withColumn("client", F.col("client").cast("bigint"))


TEST = f"(select * from {LONG} l where split = 'test')"


@query("m08_per_client_metrics", f"""
select c.method, cast(c.client as bigint) as client, c.threshold, tp, fp, tn, fn, {rates_sql()}, {sql_rnd('a.roc_auc')} as roc_auc, {sql_rnd('e.brier')} as brier, e.n
from (select method, client, threshold, {CONF} from {TEST} s join {F1_SQL} h using (method, client) group by method, client, threshold) c
join {auc_sql('method, client', TEST)} a on a.method = c.method and a.client = c.client
join (select method, client, count(*) as n, avg((TARGET-prob)*(TARGET-prob)) as brier from {TEST} s group by method, client) e on e.method = c.method and e.client = c.client""")
def per_client_metrics(t):
    long = long_scores(t)
    thresholds = M.select_thresholds(long.filter("split = 'val'"), ["method", "client"])
    per, _ = M.evaluate_by_client(long.filter("split = 'test'"), thresholds)
    cols = ["method", "client", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "specificity", "f1", "balanced_accuracy", "roc_auc", "brier", "n"]
    return rounded(per.select(cols), 6, threshold=EXACT)


@query("m09_pooled_metrics", f"""
with c as (select method, client, {CONF} from {TEST} s join {F1_SQL} h using (method, client) group by method, client),
s as (select method, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(tn) as bigint) as tn, cast(sum(fn) as bigint) as fn from c group by method),
a as (select x.method, x.client, x.roc_auc, n.n from {auc_sql('method, client', TEST)} x join (select method, client, count(*) as n from {TEST} q group by method, client) n on n.method = x.method and n.client = x.client)
select s.method, tp, fp, tn, fn, {rates_sql()}, {sql_rnd('p.roc_auc')} as roc_auc, {sql_rnd('w.client_avg')} as client_avg_roc_auc, {sql_rnd('w.plain')} as client_plain_avg_roc_auc, {sql_rnd('w.worst')} as client_worst_roc_auc
from s join {auc_sql('method', TEST)} p on p.method = s.method
join (select method, sum(n*roc_auc)/sum(n) as client_avg, avg(roc_auc) as plain, min(roc_auc) as worst from a group by method) w on w.method = s.method""")
def pooled_metrics(t):
    long = long_scores(t)
    thresholds = M.select_thresholds(long.filter("split = 'val'"), ["method", "client"])
    _, pooled = M.evaluate_by_client(long.filter("split = 'test'"), thresholds)
    cols = ["method", "tp", "fp", "tn", "fn", "precision", "recall", "specificity", "f1", "balanced_accuracy", "roc_auc", "client_avg_roc_auc", "client_plain_avg_roc_auc", "client_worst_roc_auc"]
    return rounded(pooled.select(cols))


@query("m10_client_auc_table", "select method, " + ", ".join(f"{sql_rnd(f'max(case when client = {k} then roc_auc end)')} as C{k}" for k in range(5)) + f""",
 {sql_rnd('sum(n*roc_auc)/sum(n)')} as client_avg, {sql_rnd('min(roc_auc)')} as worst
from {auc_sql('method, client', TEST)} x join (select client, count(*) as n from scores where split = 'test' group by client) n using (client) group by method""")
def client_auc_table(t):
    return rounded(M.auc_table(long_scores(t).filter("split = 'test'"), range(5)))


def seed_long(t):
    return P.to_long(t.seed_scores.filter("split = 'test'").withColumnsRenamed({m: f"prob_{m}" for m in ["fedavg", "local", "hgnn"]}), ["seed", *P.KEYS])


SEED_LONG = """(select seed, client, TARGET, 'fedavg' as method, fedavg as prob from seed_scores where split = 'test'
 union all select seed, client, TARGET, 'local', local from seed_scores where split = 'test' union all select seed, client, TARGET, 'hgnn', hgnn from seed_scores where split = 'test')"""
PAIRS_SQL = "(select 'fedavg' as a, 'local' as b union all select 'fedavg', 'hgnn' union all select 'local', 'hgnn')"


@query("m11_comparison_pairs", f"""
select p.a, p.b, cast(x.client as bigint) as client, {sql_rnd('x.roc_auc - y.roc_auc')} as delta from {PAIRS_SQL} p
join {auc_sql('seed, method, client', SEED_LONG)} x on x.method = p.a join {auc_sql('seed, method, client', SEED_LONG)} y on y.method = p.b and y.client = x.client and y.seed = x.seed where x.seed = 42""")
def comparison_pairs(t):
    long = seed_long(t).filter("seed = 42")
    pairs = M.comparison_pairs(["local", "fedavg", "hgnn"])
    return rounded(M.pair_rows(M.auc(long, ["method", "client"]), pairs, ["client"]))


ROUNDS = 1000


def mix_sql(source: str) -> str:
    """Two nested mixer passes over column x, first over s1, then over the result xor s2."""

    def pass_(src):
        a = f"select * replace (xor(x, x >> 16) as x) from ({src}) t"
        a = f"select * replace ((x * {MIX_A}) & {MASK} as x) from ({a}) t"
        a = f"select * replace (xor(x, x >> 15) as x) from ({a}) t"
        a = f"select * replace ((x * {MIX_B}) & {MASK} as x) from ({a}) t"
        return f"select * replace (xor(x, x >> 15) as x) from ({a}) t"

    first = pass_(f"select *, (s1 + round * {ROUND_STEP}) & {MASK} as x from ({source}) t")
    return pass_(f"select * replace (xor(x, s2) as x) from ({first}) t")


def boot_sql(seed: int, columns: str, source: str, rounds: int) -> str:
    h = f"md5(concat('boot{seed}:', cast(SK_ID_CURR as varchar)))"
    base = f"select {columns}, cast('0x'||substr({h},1,8) as bigint) as s1, cast('0x'||substr({h},9,8) as bigint) as s2, unnest(range(0,{rounds})) as round from {source} src"
    weight = " + ".join(f"case when x >= ceil({c!r}::double*4294967296e0) then 1 else 0 end" for c in POISSON1_CDF)
    return f"(select {columns}, round, {weight} as wt from ({mix_sql(base)}) m)"


def weighted_auc_sql(groups: str, source: str) -> str:
    return f"""(select {groups}, sum(pos*(below + neg/2e0))/(max(p)*max(n)) as roc_auc from (
  select *, coalesce(sum(neg) over (partition by {groups} order by prob rows between unbounded preceding and 1 preceding),0) as below,
    cast(sum(pos) over (partition by {groups}) as double) as p, cast(sum(neg) over (partition by {groups}) as double) as n from (
   select {groups}, prob, sum(wt*TARGET) as pos, sum(wt*(1-TARGET)) as neg from {source} src group by {groups}, prob) c0) c1 where p > 0 and n > 0 group by {groups})"""


BOOT = boot_sql(42, "SK_ID_CURR, client, TARGET, method, prob", TEST, ROUNDS)


@query("m12_paired_bootstrap", f"""
with b as (select * from {weighted_auc_sql('method, client, round', BOOT)} w), a as (select * from {auc_sql('method, client', TEST)} w),
ci as (select y.method as b, x.client, quantile_cont(x.roc_auc - y.roc_auc, 0.025) as lo, quantile_cont(x.roc_auc - y.roc_auc, 0.975) as hi, avg(case when x.roc_auc <= y.roc_auc then 1e0 else 0e0 end) as le
  from b x join b y on x.client = y.client and x.round = y.round where x.method = 'a' and y.method in ('b','c') group by y.method, x.client)
select 'a' as a, py.method as b, cast(px.client as bigint) as client, {sql_rnd('px.roc_auc - py.roc_auc', 5)} as delta_auc, {sql_rnd('lo', 5)} as ci_low, {sql_rnd('hi', 5)} as ci_high, {sql_rnd('le', 5)} as p_delta_le_0
from a px join a py on py.client = px.client left join ci on ci.b = py.method and ci.client = px.client where px.method = 'a' and py.method in ('b','c')""")
def paired_bootstrap(t):
    long = long_scores(t).filter("split = 'test'")
    return rounded(B.paired_bootstrap(long, [("a", "b"), ("a", "c")], ROUNDS, 42), 5)


@query("m13_seed_summary", f"""
with x as (select * from {auc_sql('seed, method, client', SEED_LONG)} w)
select p.a, p.b, cast(x.client as bigint) as client, {sql_rnd('avg(x.roc_auc-y.roc_auc)')} as mean, {sql_rnd('stddev_samp(x.roc_auc-y.roc_auc)')} as std,
  count(*) filter (where x.roc_auc > y.roc_auc) as n_positive, count(*) as n_seeds
from {PAIRS_SQL} p join x on x.method = p.a join x y on y.method = p.b and y.client = x.client and y.seed = x.seed group by p.a, p.b, x.client""")
def seed_summary(t):
    aucs = M.auc(seed_long(t), ["seed", "method", "client"])
    return rounded(M.seed_deltas(aucs, M.comparison_pairs(["local", "fedavg", "hgnn"])))


SEED_COLUMNS = f"""(with x as (select z.*, n.n from {auc_sql('seed, method, client', SEED_LONG)} z join (select client, count(*) as n from seed_scores where split = 'test' and seed = 42 group by client) n on n.client = z.client)
 select seed, method, 'C'||cast(client as varchar) as col, roc_auc from x union all select seed, method, 'client-avg', sum(n*roc_auc)/sum(n) from x group by seed, method
 union all select seed, method, 'worst', min(roc_auc) from x group by seed, method)"""


@query("m13_seed_table", f"""
select p.a, p.b, x.col as auc_column, {sql_rnd('avg(x.roc_auc-y.roc_auc)')} as mean, {sql_rnd('stddev_samp(x.roc_auc-y.roc_auc)')} as std, count(*) filter (where x.roc_auc > y.roc_auc) as n_positive, count(*) as n_seeds
from {PAIRS_SQL} p join {SEED_COLUMNS} x on x.method = p.a join {SEED_COLUMNS} y on y.method = p.b and y.col = x.col and y.seed = x.seed group by p.a, p.b, x.col""")
def seed_table(t):
    """Differences over seeds per institution, for the weighted average and for the worst institution."""
    long = M.auc_columns(seed_long(t), ["seed", "method"])
    return rounded(M.seed_deltas(long, M.comparison_pairs(["local", "fedavg", "hgnn"]), "column").withColumnRenamed("column", "auc_column"))
