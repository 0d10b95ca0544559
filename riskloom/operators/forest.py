"""The record forest: customers own bureau records and previous loans, previous loans own payment events.

Node tables are DataFrames keyed by natural keys. A previous loan is identified by (SK_ID_PREV, SK_ID_CURR), because one
unknown loan id may be used by two customers and then gets one placeholder per customer. ``scope`` columns (usually the
institution) are added to every lookup key, so that all institutions are handled in one job while none sees another's
parents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from riskloom.functions.hashing import uniform
from riskloom.operators.contracts import ContractError
from riskloom.operators.ordered import hashed_prefix, hashed_rank, prefix_sums
from riskloom.operators.summaries import union_schemas
from riskloom.plans import credit as C
from riskloom.session import materialise, small_table

CUSTOMER, BUREAU, PREV = "customer", "bureau", "prev"
EVENTS = ["installment", "pos", "cc"]
NODE_TYPES = [CUSTOMER, BUREAU, PREV, *EVENTS]
ROOT, LOAN = "SK_ID_CURR", "SK_ID_PREV"
IDS = ["SK_ID_CURR", "SK_ID_PREV", "SK_ID_BUREAU", "TARGET"]


@dataclass(frozen=True)
class Relation:
    parent: str
    name: str
    child: str
    keys: tuple[str, ...]


RELATIONS = [
    Relation(CUSTOMER, "has_bureau", BUREAU, (ROOT,)),
    Relation(CUSTOMER, "has_prev", PREV, (ROOT,)),
    Relation(PREV, "has_installment", "installment", (LOAN, ROOT)),
    Relation(PREV, "has_pos", "pos", (LOAN, ROOT)),
    Relation(PREV, "has_cc", "cc", (LOAN, ROOT)),
]

# Categorical columns of the non-customer node types.
CATEGORICAL = {
    BUREAU: C.BUREAU_CATEGORIES,
    PREV: [*C.PREVIOUS_CATEGORIES, "NAME_TYPE_SUITE", "WEEKDAY_APPR_PROCESS_START", "FLAG_LAST_APPL_PER_CONTRACT"],
    "installment": [],
    "pos": ["NAME_CONTRACT_STATUS"],
    "cc": ["NAME_CONTRACT_STATUS"],
}

Nodes = dict[str, DataFrame]


# -------------------------------------------------------------------------------------------------------- node tables
def bureau_reach(bureau: DataFrame, bb: DataFrame, chosen: DataFrame) -> DataFrame:
    """Monthly rows and ids without any bureau record, and chosen bureau records without monthly rows (one row)."""
    months = bb.groupBy("SK_ID_BUREAU").agg(F.count(F.lit(1)).alias("n_rows"))
    known = bureau.select("SK_ID_BUREAU").distinct().withColumn("known", F.lit(1))
    mine = chosen.groupBy("SK_ID_BUREAU").agg(F.count(F.lit(1)).alias("n_chosen"))
    lost = F.col("known").isNull() & F.col("n_rows").isNotNull()
    return (
        months.join(known, "SK_ID_BUREAU", "full_outer")
        .join(mine, "SK_ID_BUREAU", "left")
        .agg(
            F.coalesce(F.sum(F.when(lost, F.col("n_rows"))), F.lit(0)).alias("bureau_balance_rows_without_bureau"),
            F.count_if(lost).alias("bureau_balance_ids_without_bureau"),
            F.coalesce(F.sum(F.when(F.col("n_rows").isNull(), F.col("n_chosen"))), F.lit(0)).alias("bureau_without_bureau_balance"),
        )
    )


def node_tables(tables: Mapping[str, DataFrame], ids: DataFrame, vocab=None) -> Nodes:
    """Node tables of any set of customers, with row derivations."""
    app = C.of_customers(C.clean_application(tables["application"]), ids)
    bureau = C.of_customers(tables["bureau"], ids)
    bb = C.of_customers(tables["bureau_balance"], bureau, "SK_ID_BUREAU")
    return {
        CUSTOMER: app,
        BUREAU: C.bureau_with_history(bureau, bb, vocab).withColumn(
            "HAS_BUREAU_BALANCE", F.col("BB_MONTHS_BALANCE_SIZE").isNotNull().cast("int")
        ),
        PREV: C.clean_previous(C.of_customers(tables["previous_application"], ids))
        .drop("DAYS_LAST_DUE_DIFF")
        .withColumn("IS_PLACEHOLDER", F.lit(0)),
        "installment": C.derive_installments(C.of_customers(tables["installments_payments"], ids)).drop("IS_LATE", "IS_UNDERPAID"),
        "pos": C.S.finite_all(C.of_customers(tables["pos_cash_balance"], ids)),
        "cc": C.derive_card(C.of_customers(tables["credit_card_balance"], ids)),
    }


def feature_columns(kind: str, df: DataFrame, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of a node type; customers by type, the rest by the fixed list."""
    out = {*IDS, *skip}
    cat = [c for c in (C.S.string_columns(df) if kind == CUSTOMER else CATEGORICAL[kind]) if c not in out]
    return [c for c in df.columns if c not in out and c not in cat], cat


def add_client(nodes: Nodes, assignment: DataFrame, client: str = "client") -> Nodes:
    """Institution column on every node, by the customer each row names; nothing is physically split."""
    owner = assignment.select(ROOT, client)
    return {t: df.join(owner, ROOT) for t, df in nodes.items()}


# ------------------------------------------------------------------------------------------------------------- orphans
def with_owner(events: DataFrame, prev: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Events with ``_owner``: the customer of the parent loan, NULL when the loan is unknown."""
    owners = prev.select(LOAN, *scope, F.col(ROOT).alias("_owner"))
    return events.join(owners, [LOAN, *scope], "left")


def parent_state() -> Column:
    return (
        F.when(F.col("_owner").isNull(), "missing").when(F.col("_owner") != F.col(ROOT), "mismatch").otherwise("ok")
    )


def pair_states(nodes: Mapping[str, DataFrame], scope: Sequence[str] = ()) -> DataFrame:
    """(node_type, loan, customer, scope, n, state): event rows counted per (loan, customer) before the parent lookup, so
    a loan with very many events is one row in the join."""
    union = None
    for t in EVENTS:
        pairs = nodes[t].groupBy(LOAN, ROOT, *scope).agg(F.count(F.lit(1)).alias("n")).withColumn("node_type", F.lit(t))
        union = pairs if union is None else union.unionByName(pairs)
    return with_owner(union, nodes[PREV], scope).withColumn("state", parent_state()).drop("_owner")


def orphan_report(nodes: Mapping[str, DataFrame], scope: Sequence[str] = ()) -> DataFrame:
    """Per event type (and scope): rows, rows with unknown parent and their share, distinct unknown parents, customers
    affected, rows whose parent belongs to someone else."""
    lost = F.col("state") == "missing"

    def rows(state: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("state") == state, F.col("n"))), F.lit(0))

    return pair_states(nodes, scope).groupBy(*scope, "node_type").agg(
        F.sum("n").alias("rows"),
        rows("missing").alias("rows_missing_prev"),
        (rows("missing") / F.sum("n")).alias("share_missing_prev"),
        F.count_distinct(F.when(lost, F.col(LOAN))).alias("distinct_missing_prev"),
        F.count_distinct(F.when(lost, F.col(ROOT))).alias("customers_affected"),
        rows("mismatch").alias("rows_curr_mismatch"),
    )


def flag_of(event_type: str) -> str:
    return f"PH_FROM_{event_type.upper()}"


def placeholders(nodes: Mapping[str, DataFrame], scope: Sequence[str] = (), states: DataFrame | None = None) -> DataFrame:
    """One row per unknown (loan, customer) with the event types that mention it."""
    states = pair_states(nodes, scope) if states is None else states
    flags = [F.max((F.col("node_type") == e).cast("int")).alias(flag_of(e)) for e in EVENTS]
    return states.filter("state = 'missing'").groupBy(LOAN, ROOT, *scope).agg(*flags).withColumn("IS_PLACEHOLDER", F.lit(1))


def resolve_orphans(nodes: Nodes, policy: str = "placeholder", scope: Sequence[str] = ()) -> Nodes:
    """Drop events of a foreign parent; give unknown parents a placeholder loan, or drop their events.

    The (loan, customer) pairs that are not in order are written once; events are then filtered by an anti join against
    the pairs to drop. These are written by event type, so Spark knows their size (without the many unknown parents) and
    broadcasts them when they are few: event rows usually stay where they are."""
    if policy not in ("placeholder", "drop"):
        raise ValueError(f"unknown policy: {policy}")
    wrong = materialise(pair_states(nodes, scope).filter("state <> 'ok'"), "wrong-parents")
    dropped = wrong if policy == "drop" else wrong.filter("state = 'mismatch'")
    out = dict(nodes)
    for t in EVENTS:
        pairs = materialise(dropped.filter(F.col("node_type") == t).select(LOAN, ROOT, *scope), f"dropped-{t}")
        out[t] = nodes[t].join(pairs, [LOAN, ROOT, *scope], "left_anti")
    prev = [nodes[PREV]] + ([placeholders(nodes, scope, wrong)] if policy == "placeholder" else [])
    out[PREV] = union_schemas(prev, [flag_of(e) for e in EVENTS])
    return out


# ----------------------------------------------------------------------------------------------------------- childless
def loan_coverage(nodes: Mapping[str, DataFrame], scope: Sequence[str] = ()) -> DataFrame:
    """Loans with ``has_record``: some event names the loan id."""
    keys = [LOAN, *scope]
    named = nodes[EVENTS[0]].select(*keys)
    for t in EVENTS[1:]:
        named = named.unionByName(nodes[t].select(*keys))
    return (
        nodes[PREV].select(*keys, ROOT, "NAME_CONTRACT_STATUS", "IS_PLACEHOLDER")
        .join(named.distinct().withColumn("_hit", F.lit(1)), keys, "left")
        .withColumn("has_record", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def childless_by_status(nodes: Mapping[str, DataFrame], scope: Sequence[str] = ()) -> DataFrame:
    real = loan_coverage(nodes, scope).filter("IS_PLACEHOLDER = 0 and NAME_CONTRACT_STATUS is not null")
    return real.groupBy(*scope, F.col("NAME_CONTRACT_STATUS").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("has_record").cast("double")).alias("share_with_payment_record")
    )


def childless_report(nodes: Mapping[str, DataFrame], scope: Sequence[str] = (), approved: str = "Approved") -> DataFrame:
    """Loans without any event (real ones only) and customers without bureau record, loan, or both."""
    loans = loan_coverage(nodes, scope)
    bare = ~F.col("has_record") & (F.col("IS_PLACEHOLDER") == 0)
    loan_part = loans.groupBy(*scope).agg(
        F.count_if(bare).alias("prev_without_any_payment_record"),
        F.count_if(bare & F.coalesce(F.col("NAME_CONTRACT_STATUS") == approved, F.lit(False))).alias("approved_prev_without_payment_record"),
    )
    keys = [ROOT, *scope]
    b = nodes[BUREAU].select(*keys).distinct().withColumn("_b", F.lit(1))
    p = nodes[PREV].select(*keys).distinct().withColumn("_p", F.lit(1))
    no_b, no_p = F.col("_b").isNull(), F.col("_p").isNull()
    customer_part = (
        nodes[CUSTOMER].select(*keys).join(b, keys, "left").join(p, keys, "left").groupBy(*scope).agg(
            F.count_if(no_b).alias("customers_without_bureau"),
            F.count_if(no_p).alias("customers_without_prev"),
            F.count_if(no_b & no_p).alias("customers_without_any_history"),
        )
    )
    if scope:
        return customer_part.join(loan_part, list(scope), "full_outer")
    return customer_part.select(
        "*",
        *[loan_part.select(c).scalar().alias(c) for c in ["prev_without_any_payment_record", "approved_prev_without_payment_record"]],
    )


# ------------------------------------------------------------------------------------------------------------ structure
def child_counts(nodes: Mapping[str, DataFrame], r: Relation, *extra: Column) -> DataFrame:
    return nodes[r.child].groupBy(*r.keys).agg(F.count(F.lit(1)).alias(f"_n_{r.child}"), *extra)


def add_structural_features(nodes: Nodes) -> Nodes:
    """N_<CHILD> = ln(1 + children), HAS_<CHILD>, and on customers N_PREV_PLACEHOLDER."""
    out = dict(nodes)
    for r in RELATIONS:
        n = f"_n_{r.child}"
        extra = [F.sum("IS_PLACEHOLDER").alias("_ph")] if r.child == PREV else []
        counts = child_counts(nodes, r, *extra)
        number = F.coalesce(F.col(n), F.lit(0))
        df = out[r.parent].join(counts, list(r.keys), "left").withColumns(
            {f"N_{r.child.upper()}": F.log1p(number.cast("double")), f"HAS_{r.child.upper()}": (number > 0).cast("int")}
        )
        if extra:
            df = df.withColumn("N_PREV_PLACEHOLDER", F.log1p(F.coalesce("_ph", F.lit(0)).cast("double"))).drop("_ph")
        out[r.parent] = df.drop(n)
    return out


def with_roots(nodes: Nodes, walk: bool = False) -> Nodes:
    """``root_id`` on every node. After ``resolve_orphans`` an event's own customer is its loan's customer, so the column is
    simply that; ``walk`` derives it along the keys instead (event -> loan -> customer) and keeps linked events only."""
    out = {t: df.withColumn("root_id", F.col(ROOT)) for t, df in nodes.items()}
    if walk:
        loans = out[PREV].select(LOAN, ROOT, "root_id")
        for t in EVENTS:
            out[t] = nodes[t].join(loans, [LOAN, ROOT])
    return out


ID_CHUNK = 100_000


def event_ids(events: DataFrame) -> DataFrame:
    """``event_id`` for an export: dense number from 1 in the order of a row hash. Identical rows are counted first and numbered by
    expanding the count, in chunks spread over tasks, so that a large group of copies is never sorted or expanded in one
    place."""
    cols = events.columns
    cells = events.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_u": F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52)), "_t": F.xxhash64(F.lit(1), *cols)}
    )
    placed = hashed_prefix(cells, "_u", "_t", "_n", "_start")
    few = placed.filter(F.col("_n") <= ID_CHUNK).select(*cols, F.explode(F.sequence(F.col("_start") + 1, F.col("_start") + F.col("_n"))).alias("event_id"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / ID_CHUNK)))
    many = placed.filter(F.col("_n") > ID_CHUNK).withColumn("_chunk", chunk).repartition("_u", "_chunk")
    low = F.col("_start") + F.col("_chunk") * ID_CHUNK
    high = F.least(low + ID_CHUNK, F.col("_start") + F.col("_n"))
    return few.unionByName(many.select(*cols, F.explode(F.sequence(low + 1, high)).alias("event_id")))


def with_event_keys(events: DataFrame) -> DataFrame:
    """``event_id``: a hash of the whole row, so identical rows share it. Needs no shuffle; edges and their validation
    count multiplicities. For an export with one number per row use ``event_ids``."""
    return events.withColumn("event_id", F.xxhash64(*events.columns))


def edges(nodes: Mapping[str, DataFrame], reverse: bool = True) -> DataFrame:
    """(src_type, rel, dst_type, src, dst, root_id) for every relation, with the ``rev_`` twins. Event tables need an
    ``event_id`` (see ``with_event_keys``, ``event_ids``)."""
    ident = {CUSTOMER: ROOT, BUREAU: "SK_ID_BUREAU", PREV: LOAN, **dict.fromkeys(EVENTS, "event_id")}
    parts = []
    for r in RELATIONS:
        parent_id = ROOT if r.parent == CUSTOMER else LOAN
        parts.append(
            nodes[r.child].select(
                F.lit(r.parent).alias("src_type"), F.lit(r.name).alias("rel"), F.lit(r.child).alias("dst_type"),
                F.col(parent_id).alias("src"), F.col(ident[r.child]).alias("dst"), F.col(ROOT).alias("root_id"),
            )
        )
    forward = parts[0]
    for p in parts[1:]:
        forward = forward.unionByName(p)
    return with_reverse(forward) if reverse else forward


def with_reverse(forward: DataFrame) -> DataFrame:
    """Each edge and its twin, from one pass over the forward edges."""
    twin = F.struct(
        F.col("dst_type").alias("src_type"), F.concat(F.lit("rev_"), "rel").alias("rel"), F.col("src_type").alias("dst_type"),
        F.col("dst").alias("src"), F.col("src").alias("dst"), "root_id",
    )
    return forward.select(F.inline(F.array(F.struct("src_type", "rel", "dst_type", "src", "dst", "root_id"), twin)))


EDGE_CHECKS = ["edges", "edges_without_parent", "reverse_differences", "cross_customer_edges", "children_without_one_parent"]


def _signed_hashes(sign: Column, *key: str) -> list[Column]:
    """Aggregates that are all 0 if every key occurs as often with sign 1 as with -1: additive hashes of multisets. NULL
    (an overflow) counts as a difference."""
    h = F.xxhash64(*key)
    halves = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return [F.sum(sign).alias("h0"), *(F.try_sum(sign * x).alias(f"h{i}") for i, x in enumerate(halves, 1))]


def _unequal(row: Row) -> bool:
    return any(row[f"h{i}"] != 0 for i in range(3))


def validate_forest(nodes: Mapping[str, DataFrame], edge: DataFrame) -> DataFrame:
    """Per relation: edges, edges with an unknown parent, children without exactly one parent, edges that differ from
    their reverse, and edges that connect two customers' trees.

    Forward edges are held against reverse ones, and edges against children, by additive hashes per relation in one scan
    each, without grouping by edge; only relations whose hashes differ are grouped to count the violations. Identical
    events share a key, so what is compared is how often each edge and each child occurs. Edges and
    parents meet, like edges and children, as one grouping of their union, without a join."""
    backward = F.col("rel").startswith("rev_")
    oriented = edge.select(
        F.when(backward, F.substring("rel", 5, 1000)).otherwise(F.col("rel")).alias("rel"),
        F.when(backward, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(backward, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        "root_id", F.when(backward, F.lit(-1)).otherwise(F.lit(1)).alias("sign"),
    )
    forward = oriented.filter("sign = 1")
    parents = children = None
    for r in RELATIONS:
        pid = ROOT if r.parent == CUSTOMER else LOAN
        cid = {BUREAU: "SK_ID_BUREAU", PREV: LOAN}.get(r.child, "event_id")
        up = nodes[r.parent].select(F.lit(r.name).alias("rel"), F.col(pid).alias("src"), F.col(ROOT).alias("root_id"))
        down = nodes[r.child].select(F.lit(r.name).alias("rel"), F.col(cid).alias("dst"), F.col(ROOT).alias("root_id"))
        parents = up if parents is None else parents.unionByName(up)
        children = down if children is None else children.unionByName(down)
    to_customer = [r.name for r in RELATIONS if r.parent == CUSTOMER]
    crossing = F.col("rel").isin(to_customer) & (F.col("src") != F.col("root_id"))
    both = {r["rel"]: r for r in oriented.groupBy("rel").agg(
        F.count_if(F.col("sign") == 1).alias("edges"), F.count_if((F.col("sign") == 1) & crossing).alias("cross_customer_edges"), *_signed_hashes(F.col("sign"), "src", "dst", "root_id")
    ).collect()}  # a row per relation, here and below
    ends = ["rel", "src", "root_id"]
    met = forward.select(*ends, F.lit(1).alias("n"), F.lit(0).alias("known")).unionByName(parents.select(*ends, F.lit(0).alias("n"), F.lit(1).alias("known")))
    met = met.groupBy(*ends).agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    asked = met.filter("n > 0 and (known = 0 or src is null or root_id is null)")  # a missing key has no parent
    lost = {r["rel"]: r["n"] for r in asked.groupBy("rel").agg(F.sum("n").alias("n")).collect()}
    against = forward.select("rel", "dst", "root_id", F.lit(1).alias("sign")).unionByName(children.withColumn("sign", F.lit(-1)))
    held = {r["rel"]: r for r in against.groupBy("rel").agg(*_signed_hashes(F.col("sign"), "dst", "root_id")).collect()}
    single = [r.name for r in RELATIONS if r.child not in EVENTS]
    repeated = {r["rel"] for r in children.filter(F.col("rel").isin(single)).groupBy("rel", "dst").count().filter("count > 1").select("rel").distinct().collect()}

    differing = [rel for rel, r in both.items() if _unequal(r)]
    reverse = _reverse_differences(oriented.filter(F.col("rel").isin(differing))) if differing else {}
    odd = [rel for rel, r in held.items() if _unequal(r) or rel in repeated]
    orphans = _wrong_children(forward.filter(F.col("rel").isin(odd)), children.filter(F.col("rel").isin(odd))) if odd else {}
    rows = []
    for r in RELATIONS:
        if r.name in held:
            own = both.get(r.name)
            counts = (own["edges"], lost.get(r.name, 0), reverse.get(r.name, 0), own["cross_customer_edges"]) if own else (None,) * 4
            rows.append((f"{r.parent}->{r.child}", *counts, orphans.get(r.name, 0)))
    return small_table(edge.sparkSession, rows, "relation string, " + ", ".join(f"{c} bigint" for c in EDGE_CHECKS))


def _reverse_differences(oriented: DataFrame) -> dict[str, int]:
    per_edge = oriented.groupBy("rel", "src", "dst", "root_id").agg(F.sum("sign").alias("d"))
    return {r["rel"]: r["n"] for r in per_edge.groupBy("rel").agg(F.sum(F.abs("d")).alias("n")).collect()}


def _wrong_children(forward: DataFrame, children: DataFrame) -> dict[str, int]:
    keys = ["rel", "dst", "root_id"]
    edge_end = forward.select(*keys, "src", F.lit(0).alias("n"), F.lit(1).alias("d"))
    child = children.select(*keys, F.lit(None).alias("src"), F.lit(1).alias("n"), F.lit(0).alias("d"))
    met = edge_end.unionByName(child).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("src").alias("a"), F.max("src").alias("b"))
    event = F.col("rel").isin([r.name for r in RELATIONS if r.child in EVENTS])
    n, d, one_source = F.col("n"), F.col("d"), F.coalesce(F.col("a") == F.col("b"), F.lit(True))

    def wrong(n: Column, d: Column, one_source: Column) -> Column:
        # identical events have one source, so only the numbers can differ; any other child is unique and has one edge
        single = F.when((n == 1) & (d == 1), F.lit(0)).otherwise(F.greatest(n, F.lit(1)))
        return F.when(event & one_source, F.abs(n - d)).otherwise(single)

    # a missing key names nothing, so neither its edges nor its children belong together
    apart = F.when(n > 0, wrong(n, F.lit(0), F.lit(True))).otherwise(0) + F.when(d > 0, wrong(F.lit(0), d, one_source)).otherwise(0)
    unnamed = F.col("dst").isNull() | F.col("root_id").isNull()
    counted = met.groupBy("rel").agg(F.sum(F.when(unnamed, apart).otherwise(wrong(n, d, one_source))).alias("n"))
    return {r["rel"]: r["n"] for r in counted.collect()}


def require_valid_forest(nodes: Mapping[str, DataFrame], edge: DataFrame) -> DataFrame:
    report = validate_forest(nodes, edge)
    bad = report.filter(
        "edges_without_parent + children_without_one_parent + reverse_differences + cross_customer_edges > 0"
    ).collect()
    if bad:
        raise ContractError(f"forest checks failed: {[r.asDict() for r in bad]}")
    return report


def dense_links(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Children with ``parent_index``, the parent's 0-based position in key order; a dangling key is an error."""
    if not child.join(parent.select(F.col(key).alias(fk)), fk, "left_anti").isEmpty():
        raise ContractError(f"dangling foreign key {fk}")
    index = prefix_sums(parent.select(F.col(key).alias(fk)).withColumn("_one", F.lit(1)), [], fk, ["_one"])
    return child.join(index.select(fk, (F.col("_one_cum") - 1).alias("parent_index")), fk)


# ------------------------------------------------------------------------------------------------- subgraphs, batches
def subgraph(nodes: Mapping[str, DataFrame], customers: DataFrame) -> Nodes:
    """All nodes below the given customers: the forest carries the customer on every node, so one semi join per type."""
    return {t: C.of_customers(df, customers) for t, df in nodes.items()}


def customer_batches(customers: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """(SK_ID_CURR, batch_id): fixed-size batches in a hashed order."""
    u = customers.select(ROOT).withColumn("_u", uniform(f"batch{seed}", ROOT))
    return hashed_rank(u, [], "_u", ROOT).select(ROOT, F.floor((F.col("rank") - 1) / size).alias("batch_id"))


def node_counts(nodes: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    parts = [df.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes")).withColumn("node_type", F.lit(t)) for t, df in nodes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prepare_forest(nodes: Nodes, policy: str = "placeholder", scope: Sequence[str] = ()) -> tuple[Nodes, DataFrame, DataFrame]:
    """Orphans -> childless report -> structural features -> roots. The repaired tables are written once, since every
    later step reads them several times."""
    report = orphan_report(nodes, scope)
    fixed = {t: materialise(df, t) for t, df in resolve_orphans(nodes, policy, scope).items()}
    childless = childless_report(fixed, scope)
    return with_roots(add_structural_features(fixed)), report, childless


# --------------------------------------------------------------------------------------------------- mean propagation
def propagate(nodes: Mapping[str, DataFrame], features: Sequence[str], hops: int = 2) -> DataFrame:
    """Typed mean message passing without weights: at every node, the mean over each relation's neighbours is summed over
    relations and added to the node's own vector. The last hop only updates customers."""
    h: Nodes = {}
    for t in NODE_TYPES:
        ids = [ROOT] + ([LOAN] if t in (PREV, *EVENTS) else [])
        h[t] = nodes[t].select(*ids, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    for hop in range(1, hops + 1):
        last = hop == hops
        new: Nodes = {}
        for t in [CUSTOMER] if last else NODE_TYPES:
            df = h[t]
            incoming: list[str] = []
            for i, r in enumerate(RELATIONS):
                tag = f"_m{i}_"
                if r.parent == t:
                    msg = h[r.child].groupBy(*r.keys).agg(*[F.avg(f).alias(tag + f) for f in features])
                elif r.child == t:
                    msg = h[r.parent].select(*r.keys, *[F.col(f).alias(tag + f) for f in features])
                else:
                    continue
                df = df.join(msg, list(r.keys), "left")
                incoming.append(tag)
            new[t] = df.select(
                *[c for c in h[t].columns if c not in features],
                *[_plus(f, incoming).alias(f) for f in features],
            )
        h = {**h, **new}
    return h[CUSTOMER]


def _plus(feature: str, tags: Sequence[str]) -> Column:
    total = F.col(feature)
    for tag in tags:
        total = total + F.coalesce(F.col(tag + feature), F.lit(0.0))
    return total
