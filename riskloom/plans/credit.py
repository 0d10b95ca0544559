"""Customer feature plans over the loan tables: cleaning, ratios, five child rollups, one wide feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.rollup import Rollup, attach, drop_constant_columns, gathered, generic_spec, vocabularies

KEY, TARGET = "SK_ID_CURR", "TARGET"

# Sentinel for "no date", placeholder strings, ratio definitions, rolled-up columns and their statistics.
DAYS_SENTINEL = 365243
PLACEHOLDERS = {"CODE_GENDER": "XNA", "NAME_FAMILY_STATUS": "Unknown", "ORGANIZATION_TYPE": "XNA"}
FLAGS = ["FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
APPLICATION_RATIOS = {
    "CREDIT_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "ANNUITY_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
    "GOODS_CREDIT_RATIO": ("AMT_GOODS_PRICE", "AMT_CREDIT"),
    "EMPLOYED_BIRTH_RATIO": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "CAR_AGE_BIRTH_RATIO": ("OWN_CAR_AGE", "DAYS_BIRTH"),
}
EXTERNAL = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
DOCUMENT_PREFIX = "FLAG_DOCUMENT_"
BUREAU_RATIOS = {
    "DEBT_CREDIT_RATIO": ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
    "OVERDUE_DEBT_RATIO": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_DEBT"),
}
BUREAU_CATEGORIES = ["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"]
BUREAU_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_ENDDATE_FACT": ["min", "max"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["max", "sum"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "DEBT_CREDIT_RATIO": ["max", "mean"],
    "OVERDUE_DEBT_RATIO": ["max"],
    "BB_MONTHS_BALANCE_MIN": ["min"],
    "BB_MONTHS_BALANCE_SIZE": ["mean", "sum"],
    "BB_DPD_RATE": ["max", "mean"],
}
OVERDUE_GRADES = "12345"
PREVIOUS_DAYS = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]
PREVIOUS_RATIOS = {
    "APP_CREDIT_RATIO": ("AMT_APPLICATION", "AMT_CREDIT"),
    "CREDIT_GOODS_RATIO": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "ANNUITY_CREDIT_RATIO": ("AMT_ANNUITY", "AMT_CREDIT"),
}
PREVIOUS_CATEGORIES = [
    "NAME_CONTRACT_TYPE", "NAME_CONTRACT_STATUS", "NAME_PAYMENT_TYPE", "CODE_REJECT_REASON", "NAME_CLIENT_TYPE",
    "NAME_PORTFOLIO", "NAME_PRODUCT_TYPE", "CHANNEL_TYPE", "NAME_YIELD_GROUP", "PRODUCT_COMBINATION",
    "NAME_GOODS_CATEGORY", "NAME_CASH_LOAN_PURPOSE", "NAME_SELLER_INDUSTRY",
]
PREVIOUS_SPEC = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "AMT_DOWN_PAYMENT": ["max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["max", "mean"],
    "HOUR_APPR_PROCESS_START": ["mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
    "DAYS_FIRST_DUE": ["min", "max"],
    "DAYS_LAST_DUE": ["max"],
    "DAYS_TERMINATION": ["max"],
    "DAYS_LAST_DUE_DIFF": ["mean"],
    "NFLAG_INSURED_ON_APPROVAL": ["mean"],
    "APP_CREDIT_RATIO": ["min", "max", "mean", "var"],
    "CREDIT_GOODS_RATIO": ["mean"],
    "ANNUITY_CREDIT_RATIO": ["mean"],
}
INSTALLMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "IS_LATE": ["mean", "sum"],
    "IS_UNDERPAID": ["mean"],
    "PAYMENT_RATIO": ["min", "max", "mean", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean"],
}
POS_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "CNT_INSTALMENT": ["mean"],
    "CNT_INSTALMENT_FUTURE": ["mean"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}
CARD_RATIOS = {
    "UTILIZATION": ("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
    "PAYMENT_MIN_RATIO": ("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY"),
}
SEGMENT_MAP = {
    "Working": "Working",
    "Commercial associate": "Commercial",
    "Businessman": "Commercial",
    "Pensioner": "Pensioner",
    "Unemployed": "Pensioner",
    "Maternity leave": "Pensioner",
    "Student": "Pensioner",
    "State servant": "State servant",
}

Vocab = Mapping[str, Sequence[str]]


def with_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: S.safe_ratio(a, b) for name, (a, b) in ratios.items()})


def clean_application(df: DataFrame) -> DataFrame:
    """Sentinels and placeholders to NULL, Y/N flags, ratios, external-score summaries, document count."""
    documents = [c for c in df.columns if c.startswith(DOCUMENT_PREFIX)]
    df = S.finite_all(df).withColumns(
        {
            "DAYS_EMPLOYED_ANOM": S.sentinel_flag("DAYS_EMPLOYED", DAYS_SENTINEL),
            "DAYS_EMPLOYED": S.null_if("DAYS_EMPLOYED", DAYS_SENTINEL),
            "DAYS_LAST_PHONE_CHANGE": S.null_if("DAYS_LAST_PHONE_CHANGE", 0),
            **{c: S.null_if(c, p) for c, p in PLACEHOLDERS.items()},
            **{c: S.yes_no(c) for c in FLAGS},
        }
    )
    return with_ratios(df, APPLICATION_RATIOS).withColumns(
        {
            "EXT_SOURCE_MEAN": S.row_mean(EXTERNAL),
            "EXT_SOURCE_STD": S.row_std(EXTERNAL),
            "EXT_SOURCE_MIN": S.row_min(EXTERNAL),
            "EXT_SOURCE_PROD": S.row_product(EXTERNAL),
            "DOCUMENT_COUNT": S.row_sum(documents),
        }
    )


def clean_previous(df: DataFrame) -> DataFrame:
    df = S.finite_all(df).withColumns({c: S.null_if(c, DAYS_SENTINEL) for c in PREVIOUS_DAYS})
    return with_ratios(df, PREVIOUS_RATIOS).withColumn(
        "DAYS_LAST_DUE_DIFF", F.col("DAYS_LAST_DUE_1ST_VERSION") - F.col("DAYS_LAST_DUE")
    )


def derive_installments(df: DataFrame) -> DataFrame:
    """Payment ratio and gap, days late / early (missing payment date stays missing), late / underpaid / unpaid flags."""
    df = S.finite_all(df)
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return df.withColumns(
        {
            "PAYMENT_RATIO": S.safe_ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "DPD": S.clip(delay, lower=0.0),
            "DBD": S.clip(-delay, lower=0.0),
            "IS_LATE": S.is_positive(delay),
            "IS_UNDERPAID": S.is_positive(F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")),
            "IS_PAYMENT_MISSING": S.is_missing("AMT_PAYMENT"),
        }
    )


def derive_card(df: DataFrame) -> DataFrame:
    return with_ratios(S.finite_all(df), CARD_RATIOS)


def _vocab(df: DataFrame, columns: Sequence[str], given: Vocab | None) -> Vocab:
    given = given or {}
    missing = [c for c in columns if c not in given]
    return {**vocabularies(df, missing), **{c: given[c] for c in columns if c in given}}


def rollup_bureau_balance(bb: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    """One row per bureau record: month range and count, status shares, share of months overdue (grades 1-5)."""
    words = _vocab(bb, ["STATUS"], vocab)
    out = Rollup("SK_ID_BUREAU", "BB", {"MONTHS_BALANCE": ["min", "max", "size"]}, words).apply(bb)
    graded = [f"BB_STATUS_{g}_MEAN" for g in OVERDUE_GRADES if f"BB_STATUS_{g}_MEAN" in out.columns]
    return out.withColumn("BB_DPD_RATE", S.row_sum(graded))


def bureau_with_history(bureau: DataFrame, bb: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    """Bureau records with their monthly rollup and ratios; the grandchild is reduced before the join."""
    return with_ratios(_with_months(bureau, bb, vocab), BUREAU_RATIOS)


def _with_months(bureau: DataFrame, bb: DataFrame, vocab: Vocab | None) -> DataFrame:
    return attach(S.finite_all(bureau), rollup_bureau_balance(bb, vocab), "SK_ID_BUREAU")


def rollup_bureau(bureau: DataFrame, bb: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    words = _vocab(bureau, BUREAU_CATEGORIES, vocab)
    rolled = Rollup(
        KEY, "BURO", BUREAU_SPEC, words, "BURO_COUNT",
        {"ACTIVE": "CREDIT_ACTIVE <=> 'Active'", "CLOSED": "CREDIT_ACTIVE <=> 'Closed'"},
    )
    return rolled.apply(with_ratios(gathered(_with_months(bureau, bb, vocab), KEY), BUREAU_RATIOS))


def rollup_previous(prev: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    words = _vocab(prev, PREVIOUS_CATEGORIES, vocab)
    subsets = {"APPROVED": "NAME_CONTRACT_STATUS <=> 'Approved'", "REFUSED": "NAME_CONTRACT_STATUS <=> 'Refused'"}
    rolled = Rollup(KEY, "PREV", PREVIOUS_SPEC, words, "PREV_COUNT", subsets)
    return rolled.apply(clean_previous(gathered(prev, KEY)))


def rollup_installments(ins: DataFrame) -> DataFrame:
    return Rollup(KEY, "INSTAL", INSTALLMENT_SPEC, count_name="INSTAL_COUNT").apply(derive_installments(gathered(ins, KEY)))


def rollup_pos(pos: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    words = _vocab(pos, ["NAME_CONTRACT_STATUS"], vocab)
    return Rollup(KEY, "POS", POS_SPEC, words, "POS_COUNT").apply(S.finite_all(gathered(pos, KEY)))


def rollup_card(cc: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    """Min, max and mean of every numeric column, derived ratios included."""
    words = _vocab(cc, ["NAME_CONTRACT_STATUS"], vocab)
    df = derive_card(gathered(cc, KEY))
    spec = generic_spec(S.numeric_columns(df, exclude=["SK_ID_PREV", KEY]))
    return Rollup(KEY, "CC", spec, words, "CC_COUNT").apply(df)


def of_customers(df: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is among the ids (a semi join placed before any aggregation)."""
    return df.join(ids.select(key).distinct() if key != KEY else ids.select(key), key, "left_semi")


def feature_table(tables: Mapping[str, DataFrame], vocab: Vocab | None = None, prefilter: bool = False) -> DataFrame:
    """Cleaned applications with all five rollups left-joined. Every rollup is grouped by the customer key, so the joins
    reuse one hash partitioning. NaN and infinite cells are removed when each table is read and ratios by 0 are NULL, so
    the result holds none.

    The left joins already drop the rollups of customers without an application. Child rows are shuffled raw, once, by the
    customer (see ``gathered``). ``prefilter`` adds the semi joins first; worth it only when the applications
    are a small part of the customers in the child tables. Without it the discovered categories may include ones seen
    only for other customers; their shares are 0 everywhere and ``drop_constant_columns`` removes them."""
    app = clean_application(tables["application"])
    ids = tables["application"].select(KEY)

    def mine(name: str) -> DataFrame:
        return of_customers(tables[name], ids) if prefilter else tables[name]

    bureau, bb = mine("bureau"), tables["bureau_balance"]
    if prefilter:
        bb = of_customers(bb, bureau, "SK_ID_BUREAU")
    rolled = [
        rollup_bureau(bureau, bb, vocab),
        rollup_previous(mine("previous_application"), vocab),
        rollup_installments(mine("installments_payments")),
        rollup_pos(mine("pos_cash_balance"), vocab),
        rollup_card(mine("credit_card_balance"), vocab),
    ]
    for r in rolled:
        app = attach(app, r, KEY)
    return app


def model_features(tables: Mapping[str, DataFrame], vocab: Vocab | None = None) -> DataFrame:
    """The feature table without constant columns, narrowed for storage."""
    return S.downcast(drop_constant_columns(feature_table(tables, vocab)))
