"""Assembly of the default-probability feature matrix: one DataFrame per loan book."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.operators import features as ft
from loanloom.operators.governance import PD_FORBIDDEN_FEATURES
from loanloom.operators.joins import (
    DUPLICATE_FAMILY,
    asof_backward,
    date_range,
    key_census,
    salted_left_join,
)
from loanloom.operators.partitions import spread_book
from loanloom.sources.bureau import BureauLoader
from loanloom.sources.tables import TabularSource

META_COLUMNS = ["loan_id", "borrower_id", "observation_date"]
DEFAULT_TARGET = "default_flag_12m"


@dataclass(frozen=True)
class PDFeatureMatrix:
    """Keys, features and target side by side, plus the two feature-name lists."""

    df: DataFrame = field(repr=False)
    continuous: list[str]
    categorical: list[str]
    target: str

    @property
    def feature_names(self) -> list[str]:
        return [*self.continuous, *self.categorical]

    @property
    def X(self) -> DataFrame:
        return self.df.select(*self.feature_names)

    @property
    def y(self) -> DataFrame:
        return self.df.select(self.target)

    @property
    def meta(self) -> DataFrame:
        return self.df.select(*META_COLUMNS)


@dataclass(frozen=True)
class _Family:
    name: str
    rows: DataFrame
    raw_columns: list[str]
    expressions: Callable[[], dict[str, Column]]
    continuous: list[str]
    categorical: list[str]


_ACCOUNT_RAW = [
    "avg_monthly_balance_3m",
    "salary_credit_months_12m",
    "nach_bounce_count_12m",
    "cash_withdrawal_ratio",
    "debit_credit_ratio_3m",
]
_GST_RAW = [
    "gstr1_revenue_monthly",
    "filing_on_time_flag",
    "itc_to_output_ratio",
    "revenue_trend_slope_3m",
    "revenue_trend_slope_12m",
]


def borrower_profile(families: Sequence[_Family]) -> DataFrame:
    """All family inputs of a borrower in one row.

    The families are stacked and grouped once by borrower, so however many
    there are, they cost one shuffle of family rows and the loans are joined
    a single time. ``max`` picks the only value there is (rows are unique per
    family) and, being numeric, stays a hash aggregate. The raw values travel,
    since they are narrower than the features computed from them.
    """
    types = {
        (f.name, c): f.rows.schema[c].dataType for f in families for c in f.raw_columns
    }
    stacked = [
        f.rows.select(
            F.col("borrower_id").cast("string").alias("borrower_id"),
            *[F.lit(True if g is f else None).cast("boolean").alias(f"_in_{g.name}") for g in families],
            *[
                (F.col(c) if g is f else F.lit(None)).cast(types[g.name, c]).alias(c)
                for g in families
                for c in g.raw_columns
            ],
        )
        for f in families
    ]
    columns = [f"_in_{f.name}" for f in families] + [c for f in families for c in f.raw_columns]
    return (
        reduce(DataFrame.unionByName, stacked)
        .groupBy("borrower_id")
        .agg(*[F.max(c).alias(c) for c in columns])
    )


def assemble_pd_feature_matrix(
    source: TabularSource,
    bureau_loader: BureauLoader | None = None,
    *,
    target_column: str = DEFAULT_TARGET,
    forbidden_features: Sequence[str] = PD_FORBIDDEN_FEATURES,
    drop_forbidden: bool = True,
    check_loan_ids: bool = True,
) -> PDFeatureMatrix:
    """Loans with bureau, account, tax-filing and macro features attached.

    Families join by borrower only; a family without any row for the loans of
    this book is skipped and its columns are absent. Macro state is the latest
    reading at or before the observation date. The target rides along with the
    loan row; a null target raises when the matrix is computed.

    ``check_loan_ids`` verifies that loan ids are unique (one key-only
    shuffle); switch it off where the loan table already guarantees that.
    """
    loans = source.loans()
    if target_column not in loans.columns:
        raise ValueError(f"Loan portfolio has no target column {target_column!r}.")

    continuous, categorical = list(ft.LOAN_CONTINUOUS), list(ft.LOAN_CATEGORICAL)

    families = []
    if bureau_loader is not None:
        families.append(
            _Family(
                "bureau",
                bureau_loader.load(loans),
                ft.BUREAU_CONTINUOUS,
                ft.bureau_expressions,
                ft.BUREAU_CONTINUOUS,
                ft.BUREAU_CATEGORICAL,
            )
        )
    families += [
        _Family(
            "account",
            source.transactions(),
            _ACCOUNT_RAW,
            ft.account_expressions,
            ft.ACCOUNT_CONTINUOUS,
            ft.ACCOUNT_CATEGORICAL,
        ),
        _Family(
            "gst",
            source.gst(),
            _GST_RAW,
            ft.gst_expressions,
            ft.GST_CONTINUOUS,
            ft.GST_CATEGORICAL,
        ),
    ]
    keyed = loans.select(*[F.col(c).cast("string").alias(c) for c in ("loan_id", "borrower_id")])
    census = key_census(
        keyed,
        {f.name: f.rows for f in families},
        "borrower_id",
        unique_id="loan_id" if check_loan_ids else None,
    )
    if census.ids_repeat:
        raise ValueError("Loan portfolio has duplicate loan_id rows; the target is ambiguous.")
    used, repeated = [], []
    for f in families:
        seen = census.families[f.name]
        # the bureau loader hands out borrowers of this book only; other tables come whole
        most = seen.most_matched if f.name == "bureau" else seen.most
        if most > 0:
            used.append(f)
        if most > 1:
            repeated.append(f.name)
    if repeated:
        raise ValueError(f"{DUPLICATE_FAMILY} Families: {repeated}")
    no_target = F.raise_error(F.lit(f"{target_column} is null for a loan")).cast("int")
    target = F.when(F.col(target_column).isNull(), no_target).otherwise(
        F.col(target_column).cast("int")
    )
    loan_exprs = {
        c: e
        for c, e in ft.loan_expressions().items()
        if not (drop_forbidden and c in forbidden_features)
    }
    # the census knows the size: a book often is a single file split
    base = spread_book(loans, census.rows).select(
        F.col("loan_id").cast("string").alias("loan_id"),
        F.col("borrower_id").cast("string").alias("borrower_id"),
        "observation_date",
        target.alias("_target"),
        *[e.alias(c) for c, e in loan_exprs.items()],
    )
    if used:
        joined = salted_left_join(
            base, borrower_profile(used), "borrower_id", census.hot_keys, spread_by="loan_id"
        )
        derived = []
        for f in used:
            known = F.col(f"_in_{f.name}")
            # columns of a borrower without a row stay null instead of turning into 0/1 flags
            derived += [F.when(known, e).alias(c) for c, e in f.expressions().items()]
            continuous += f.continuous
            categorical += f.categorical
        base = joined.select(*base.columns, *derived)

    macro = source.macro()
    readings = date_range(macro, ft.MACRO_DATE)
    if readings.rows:
        macro_features = ft.build_macro_features(macro)
        base = asof_backward(
            base, macro_features, "observation_date", ft.MACRO_DATE, dates=readings
        )
        continuous += ft.MACRO_CONTINUOUS

    banned = set(forbidden_features) if drop_forbidden else set()
    continuous = [c for c in continuous if c not in banned and c in base.columns]
    categorical = [c for c in categorical if c not in banned and c in base.columns]
    df = base.select(
        *META_COLUMNS, *continuous, *categorical, F.col("_target").alias(target_column)
    )
    return PDFeatureMatrix(df, continuous, categorical, target_column)
