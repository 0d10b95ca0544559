"""Cross-institution matrix, calibration shift, blending."""

from pyspark.sql import functions as F

from riskloom.catalog.metric_checks import CONF, auc_sql, curve_sql, rates_sql
from riskloom.catalog.model_checks import own_and_pooled, variant_forest, variant_scores
from riskloom.catalog.registry import EXACT, query, rounded, sql_rnd
from riskloom.operators import boosting as T
from riskloom.operators import bootstrap as B
from riskloom.operators import metrics as M
from riskloom.operators import predictions as P
from riskloom.operators import shift as S
from riskloom.operators.summaries import over_seeds
from riskloom.session import materialise, small_table
from riskloom.sources.sinks import mean_std_cell, starred_delta_cell

CLIENTS = range(5)


def model_expr(k: int) -> str:
    """Score of client k's stand-in model: its own customers get the sharper score."""
    return f"case when client = {k} then prob_a else prob_b*{0.5 + 0.1 * k}e0 + prob_a*{0.5 - 0.1 * k:.1f}e0 end"


LONG_SQL = "(" + " union all ".join(f"select SK_ID_CURR, {k} as model, client, split, TARGET, {model_expr(k)} as prob from scores where split = 'test'" for k in CLIENTS) + ")"


def by_model(t):
    cells = ", ".join(f"struct({k} as model, {model_expr(k)} as prob)" for k in CLIENTS)
    return t.scores.filter("split = 'test'").selectExpr("SK_ID_CURR", "client", "split", "TARGET", f"inline(array({cells}))")


MATRIX = f"(select model, client, round(roc_auc, 12) as roc_auc from {auc_sql('model, client', LONG_SQL)} z)"


@query("c01_cross_matrix", "select cast(model as bigint) as model, " + ", ".join(f"{sql_rnd(f'max(case when client = {k} then roc_auc end)')} as C{k}" for k in CLIENTS) + f" from {MATRIX} m group by model")
def cross_matrix(t):
    return rounded(S.wide_matrix(S.cross_matrix(by_model(t)), CLIENTS))


@query("c02_cross_summary", f"""
with m as (select * from {MATRIX} z), h as (select model, roc_auc as home from m where model = client)
select cast(client as bigint) as client, {sql_rnd('max(case when model = client then roc_auc end)')} as own, {sql_rnd('avg(case when model <> client then roc_auc end)')} as foreign_mean,
 {sql_rnd('max(case when model <> client then roc_auc end)')} as foreign_best, {sql_rnd('max(case when model = client then roc_auc end) - avg(case when model <> client then roc_auc end)')} as own_minus_foreign_mean,
 {sql_rnd('avg(case when model <> client then roc_auc - home end)')} as drop_when_applied_here from m join h using (model) group by client""")
def cross_summary(t):
    return rounded(S.cross_summary(S.cross_matrix(by_model(t))))


def calibration_rows(t, test):
    return t.spark.createDataFrame([(m, name, float(v)) for m, d in test for name, v in d.items()], "method string, name string, value double")


@query("c03_calibration_test")
def calibration_test(t):
    """Likelihood-ratio tests of own intercepts and own slopes for two methods."""
    tests = [(m, S.calibration_test(t.scores, score=f"prob_{m}")[0]) for m in ("a", "c")]
    return rounded(calibration_rows(t, tests), 4)


@query("c04_client_calibration")
def client_calibration(t):
    _, per = S.calibration_test(t.scores, score="prob_c")
    return rounded(t.spark.createDataFrame([tuple(r.values()) for r in per], "client int, intercept double, slope double, observed_rate double, mean_predicted double, n bigint"), 5)


@query("c04_client_rates", f"select cast(client as bigint) as client, {sql_rnd('avg(TARGET)')} as observed_rate, {sql_rnd('avg(prob_c)')} as mean_predicted, count(*) as n from scores group by client")
def client_rates(t):
    return rounded(S.calibration_rates(t.scores, score="prob_c"))


@query("c05_bootstrap_slopes")
def bootstrap_slopes(t):
    rows = S.bootstrap_slopes(t.scores, 250, score="prob_c")
    return rounded(t.spark.createDataFrame([tuple(r.values()) for r in rows], "client int, slope_low double, slope_high double, rounds_used int"), 4)


@query("c06_own_predictions", f"select SK_ID_CURR, cast(client as bigint) as client, {sql_rnd('prob', 9)} as prob from {LONG_SQL} l where model = client")
def own_predictions(t):
    return rounded(S.own_predictions(by_model(t)).select("SK_ID_CURR", "client", "prob"), 9)


@query("c06_local_cross_matrix")
def local_cross_matrix(t):
    """Per institution its own trees against the other institutions' on its test rows."""
    data, forest = own_and_pooled(t)
    return rounded(S.cross_summary(S.cross_matrix(T.scores(data, forest, ["own"], ["test"], every_model=True))))


@query("c06_own_against_pooled")
def own_against_pooled(t):
    """Test AUC of every institution's trees and of the pooled trees on every institution, beside the difference of own and
    pooled on its rows with a paired bootstrap interval."""
    data, forest = own_and_pooled(t)
    every = T.scores(data, forest, splits=["test"], every_model=True).withColumn("method", F.coalesce(F.concat(F.lit("C"), F.col("model").cast("string")), F.lit("pooled")))
    every = materialise(every, "cross-scores")
    matrix = S.cross_matrix(every, model="method")
    pair = every.filter("role = 'pooled' or model = client").withColumn("method", F.col("role"))
    delta = B.paired_bootstrap(pair, [("own", "pooled")], 500).select("client", "delta_auc", "ci_low", "ci_high", "p_delta_le_0")
    return rounded(matrix.withColumnRenamed("method", "model").join(delta, "client"), 5)


@query("c07_interaction_test")
def interaction_test(t):
    """AUC differences of variants with and without institution id and region columns."""
    long = variant_scores(t)
    pairs = [("full+client", "full"), ("no_region+client", "no_region"), ("full", "no_region")]
    return rounded(B.paired_bootstrap(long, pairs, 500), 5)


@query("c07_variant_report")
def variant_report(t):
    """Trees kept, columns used, gain rank of the institution id and per-institution test AUC of each variant."""
    data, forest = variant_forest(t)
    facts = []
    for i, role in enumerate(forest.layout.roles):
        rank = next((r for name, g, r in forest.importance(i) if name == "CLIENT_ID" and g > 0), None)
        facts.append((role.name, int(forest.rounds[i]), len(role.features), rank))
    known = small_table(t.spark, facts, "variant string, rounds int, n_features int, client_id_gain_rank int")
    per = M.auc(T.scores(data, forest, splits=["test"]), ["role", "client"]).select(F.col("role").alias("variant"), "client", "roc_auc")
    return rounded(known.join(per, "variant"), 4)


PAIRS = [("a", "b"), ("a", "c"), ("b", "c")]
LOGIT = {m: f"ln(least(greatest(prob_{m},1e-6),1e0-1e-6)/(1e0-least(greatest(prob_{m},1e-6),1e0-1e-6)))" for m in "abc"}
BLENDED = "(" + " union all ".join(f"select 'hyb_{a}_{b}' as hybrid, client, TARGET, w, w*{LOGIT[a]}+(1e0-w)*{LOGIT[b]} as score from (select *, unnest(range(0,21))/20e0 as w from scores where split = 'val') s" for a, b in PAIRS) + ")"
WEIGHTS = f"(select hybrid, client, w, roc_auc from (select *, row_number() over (partition by hybrid, client order by round(roc_auc, 12) desc, w) as r from {auc_sql('hybrid, client, w', BLENDED, 'score')} z) y where r = 1)"


@query("h01_blend_weights", f"select hybrid, cast(client as bigint) as client, w, {sql_rnd('roc_auc')} as val_auc from {WEIGHTS} x")
def blend_weights(t):
    return rounded(S.choose_blend_weights(t.scores, PAIRS), w=EXACT)


HYBRID_SQL = "select s.SK_ID_CURR, s.client, s.split, s.TARGET, " + ", ".join(
    f"1e0/(1e0+exp(-(max(case when hybrid='hyb_{a}_{b}' then w end)*any_value({LOGIT[a]})+(1e0-max(case when hybrid='hyb_{a}_{b}' then w end))*any_value({LOGIT[b]})))) as prob_hyb_{a}_{b}" for a, b in PAIRS
) + f" from scores s join {WEIGHTS} x on x.client = s.client group by s.SK_ID_CURR, s.client, s.split, s.TARGET"


@query("h01_hybrid_scores", "select SK_ID_CURR, cast(client as bigint) as client, split, " + ", ".join(f"{sql_rnd(f'prob_hyb_{a}_{b}')} as prob_hyb_{a}_{b}" for a, b in PAIRS) + f" from ({HYBRID_SQL}) h")
def hybrid_scores(t):
    wide, _ = S.add_hybrids(t.scores, PAIRS)
    return rounded(wide.select("SK_ID_CURR", "client", "split", *[f"prob_{S.hybrid_name(a, b)}" for a, b in PAIRS]))


@query("h02_hybrid_evaluation", f"""
with h as ({HYBRID_SQL}), l as (select client, TARGET, 'hyb_a_c' as method, prob_hyb_a_c as prob from h where split = 'test' union all select client, TARGET, 'a', prob_a from scores where split = 'test'
 union all select client, TARGET, 'c', prob_c from scores where split = 'test'),
x as (select * from {auc_sql('method, client', 'l')} z)
select m.b, cast(p.client as bigint) as client, {sql_rnd('p.roc_auc - q.roc_auc', 5)} as delta_auc from (select 'a' as b union all select 'c') m join x p on p.method = 'hyb_a_c' join x q on q.method = m.b and q.client = p.client""")
def hybrid_evaluation(t):
    wide, _ = S.add_hybrids(t.scores, [("a", "c")])
    long = P.to_long(wide.filter("split = 'test'"))
    return rounded(M.pair_rows(M.auc(long, ["method", "client"]), [("hyb_a_c", "a"), ("hyb_a_c", "c")], ["client"]).select("b", "client", F.col("delta").alias("delta_auc")), 5)


HYBRID_LONG = f"(select client, split, TARGET, 'hyb_a_b' as method, prob_hyb_a_b as prob from ({HYBRID_SQL}) h union all select client, split, TARGET, 'hyb_a_c', prob_hyb_a_c from ({HYBRID_SQL}) h)"
HYBRID_THRESHOLDS = f"(select method, client, s as threshold from (select *, row_number() over (partition by method, client order by 2e0*tp/(tp+fp+p) desc, s) as r from {curve_sql('method, client', f'(select * from {HYBRID_LONG} l where split = {chr(39)}val{chr(39)})')} c) d where r = 1)"


@query("h02_hybrid_metrics", f"""select method, cast(client as bigint) as client, {sql_rnd('threshold')} as threshold, tp, fp, tn, fn, {rates_sql()} from (
  select method, client, threshold, {CONF} from {HYBRID_LONG} l join {HYBRID_THRESHOLDS} h using (method, client) where split = 'test' group by method, client, threshold) c""")
def hybrid_metrics(t):
    """Blended methods at thresholds chosen on each institution's validation rows."""
    pairs = [("a", "b"), ("a", "c")]
    wide, _ = S.add_hybrids(t.scores, PAIRS)
    long = P.to_long(wide.select(*P.KEYS, *[f"prob_{S.hybrid_name(a, b)}" for a, b in pairs]))
    per, _ = M.evaluate_by_client(long.filter("split = 'test'"), M.select_thresholds(long.filter("split = 'val'"), ["method", "client"]))
    return rounded(per.select("method", "client", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "specificity", "f1", "balanced_accuracy"))


@query("h02_hybrid_table")
def hybrid_table(t):
    """Formatted difference cells with a star when the interval leaves out 0."""
    wide, _ = S.add_hybrids(t.scores, [("a", "c")])
    boot = B.paired_bootstrap(P.to_long(wide.filter("split = 'test'")), [("hyb_a_c", "a"), ("hyb_a_c", "c")], 1000)
    return rounded(boot.select("a", "b", "client", starred_delta_cell("delta_auc", "ci_low", "ci_high").alias("cell")))


SEED_SHARED = """(select seed, SK_ID_CURR, client, split, TARGET, fedavg as prob_a, local as prob_b from seed_scores)"""
SEED_LOGIT = {m: f"ln(least(greatest(prob_{m},1e-6),1e0-1e-6)/(1e0-least(greatest(prob_{m},1e-6),1e0-1e-6)))" for m in "ab"}
SEED_WEIGHTS = f"""(select seed, client, w from (select *, row_number() over (partition by seed, client order by round(roc_auc, 12) desc, w) as r from {auc_sql('seed, client, w', f"(select seed, client, TARGET, w, w*{SEED_LOGIT['a']}+(1e0-w)*{SEED_LOGIT['b']} as score from (select *, unnest(range(0,21))/20e0 as w from {SEED_SHARED} q where split = 'val') s)", 'score')} z) y where r = 1)"""


@query("h03_hybrid_seed_summary", f"""
with p as (select s.*, w*{SEED_LOGIT['a']}+(1e0-w)*{SEED_LOGIT['b']} as prob from {SEED_SHARED} s join {SEED_WEIGHTS} x on x.seed = s.seed and x.client = s.client where s.split = 'test'),
d as (select h.seed, h.client, h.roc_auc - a.roc_auc as delta from {auc_sql('seed, client', 'p')} h join {auc_sql('seed, client', "(select seed, client, TARGET, prob_a as prob from p)")} a on a.seed = h.seed and a.client = h.client)
select cast(client as bigint) as client, {sql_rnd('avg(delta)', 5)} as mean, {sql_rnd('coalesce(stddev_samp(delta),0)', 5)} as std, count(*) filter (where delta > 0) as n_positive, count(*) as n_seeds from d group by client""")
def hybrid_seed_summary(t):
    """Blend chosen per seed and client, difference to the shared model summarised over seeds."""
    wide = t.seed_scores.select("seed", "SK_ID_CURR", F.struct("seed", "client").alias("place"), "client", "split", "TARGET", F.col("fedavg").alias("prob_a"), F.col("local").alias("prob_b"))
    mixed, _ = S.add_hybrids(wide, [("a", "b")], client="place")
    test = mixed.filter("split = 'test'")
    hyb = M.auc(test, ["seed", "client"], "prob_hyb_a_b").withColumnRenamed("roc_auc", "_h")
    ref = M.auc(test, ["seed", "client"], "prob_a")
    delta = hyb.join(ref, ["seed", "client"]).withColumn("delta", F.col("_h") - F.col("roc_auc"))
    return rounded(over_seeds(delta, ["client"], "delta"), 5)


SEED_LONG = " union all ".join(f"select seed, client, TARGET, '{m}' as method, {m} as prob from seed_scores where split = 'test'" for m in ["fedavg", "local", "hgnn"])


@query("h03_seed_cells", f"""select method, cast(client as bigint) as client, printf('%.4f ± %.4f', avg(roc_auc), coalesce(stddev_samp(roc_auc), 0e0)) as cell from {auc_sql('seed, method, client', f'({SEED_LONG})')} a group by method, client""")
def seed_cells(t):
    long = P.to_long(t.seed_scores.filter("split = 'test'").withColumnsRenamed({m: f"prob_{m}" for m in ["fedavg", "local", "hgnn"]}), ["seed", *P.KEYS])
    per = over_seeds(M.auc(long, ["seed", "method", "client"]), ["method", "client"], "roc_auc")
    return rounded(per.select("method", "client", mean_std_cell("mean", "std").alias("cell")))
