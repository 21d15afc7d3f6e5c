"""The query registry: every operator of the package run over whole stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators import features as ft
from loanloom.operators import joins, metrics
from loanloom.operators.preprocess import IQRClipper, build_pd_feature_pipeline
from loanloom.operators.splits import TEST, TRAIN, VALIDATION, fold_counts, oot_split
from loanloom.operators.woe import WOEModel
from loanloom.plans import calibration, models, monitoring, portfolio
from loanloom.plans import driver_views as views
from loanloom.plans.assemble import DEFAULT_TARGET, PDFeatureMatrix, assemble_pd_feature_matrix
from loanloom.session import configure
from loanloom.sources.bureau import (
    StoredReportBureauLoader,
    keep_first_identity,
    missing_identities,
    semi_by_borrower,
)
from loanloom.sources.reports import bureau_rows, response_class

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

DIGITS = 6


def query(function: Query) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return function(configure(spark), directory)

    _REGISTRY[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def rounded(column: str | Column, digits: int = DIGITS) -> Column:
    """Double rounded half up by plain arithmetic (``round`` goes through decimals)."""
    c = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def published(df: DataFrame, digits: int | dict[str, int] = DIGITS) -> DataFrame:
    """Doubles rounded, counts as bigint, timestamps and dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = digits.get(f.name, DIGITS) if isinstance(digits, dict) else digits
            c = rounded(c, d)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


# ------------------------------------------------------------------ feature builders


@query
def loan_features(spark, directory):
    return published(ft.build_loan_features(views.loan_portfolio(spark, directory)))


@query
def bureau_features(spark, directory):
    return published(ft.build_bureau_features(views.bureau(spark, directory)))


@query
def account_features(spark, directory):
    return published(ft.build_account_features(views.account_transactions(spark, directory)))


@query
def gst_features(spark, directory):
    return published(ft.build_gst_features(views.gst_data(spark, directory)))


@query
def business_features(spark, directory):
    return published(ft.build_business_features(views.financials(spark, directory)))


@query
def macro_features(spark, directory):
    return published(ft.build_macro_features(views.macroeconomic(spark, directory)))


# ------------------------------------------------------------------------------ joins


def _dated_loans(spark, directory) -> DataFrame:
    return views.loan_portfolio(spark, directory).select("loan_id", "observation_date")


@query
def asof_macro(spark, directory):
    macro = ft.build_macro_features(views.macroeconomic(spark, directory))
    return published(joins.asof_backward(_dated_loans(spark, directory), macro))


@query
def asof_macro_scan(spark, directory):
    """The same join by the strategy for right sides too large to broadcast."""
    macro = ft.build_macro_features(views.macroeconomic(spark, directory))
    return published(
        joins.asof_backward(_dated_loans(spark, directory), macro, broadcast_rows=0)
    )


@query
def family_left_join(spark, directory):
    loans = views.loan_portfolio(spark, directory).select("loan_id", "borrower_id")
    family = ft.build_account_features(views.account_transactions(spark, directory))
    return published(joins.left_join_by_borrower(loans, family).select("loan_id", "borrower_id", *ft.ACCOUNT_CONTINUOUS, *ft.ACCOUNT_CATEGORICAL))


@query
def bureau_semi_join(spark, directory):
    loans = views.loan_portfolio(spark, directory)
    return published(semi_by_borrower(views.bureau(spark, directory), loans))


@query
def missing_identities_of_loans(spark, directory):
    return missing_identities(
        views.loan_portfolio(spark, directory), views.identities(spark, directory)
    )


@query
def identities_keep_first(spark, directory):
    first = keep_first_identity(views.identities(spark, directory), "seq")
    return published(first.select("borrower_id", "mobile", "name", "seq"))


# --------------------------------------------------------------------- bureau reports


def _report_rows(spark, directory) -> DataFrame:
    reports = views.bureau_reports(spark, directory).withColumn(
        "observation_date", F.lit(views.OBSERVED).cast("timestamp")
    )
    return bureau_rows(reports, part="part")


@query
def bureau_report_dpd(spark, directory):
    return published(
        _report_rows(spark, directory).select(
            "borrower_id",
            "dpd_30_count_24m",
            "dpd_60_count_24m",
            "dpd_90_count_24m",
            "months_since_last_delinquency",
        )
    )


@query
def bureau_report_utilisation(spark, directory):
    return published(_report_rows(spark, directory).select("borrower_id", "revolving_utilisation"))


@query
def bureau_report_trades(spark, directory):
    return published(
        _report_rows(spark, directory).select("borrower_id", "open_trade_count", "oldest_trade_months")
    )


@query
def bureau_report_enquiries(spark, directory):
    return published(_report_rows(spark, directory).select("borrower_id", "enquiry_count_6m"))


@query
def bureau_report_score(spark, directory):
    return published(_report_rows(spark, directory).select("borrower_id", "cibil_score", "score_type"))


@query
def bureau_report_rows(spark, directory):
    """Stored JSON reports resolved through the identities of the loans' borrowers."""
    stored = views.bureau_reports(spark, directory).select(
        "borrower_id", "part", F.to_json("report").alias("raw")
    )
    loader = StoredReportBureauLoader(
        stored,
        views.identities(spark, directory),
        tiebreak="seq",
        observation_date=views.OBSERVED,
    )
    return published(loader.load(views.loan_portfolio(spark, directory)))


@query
def report_classes(spark, directory):
    reports = views.bureau_reports(spark, directory)
    per_report = reports.groupBy("borrower_id").agg(F.min(response_class()).alias("response_class"))
    return per_report.groupBy("response_class").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- assembly


def _matrix(spark, directory, bureau: bool = True) -> PDFeatureMatrix:
    loader = views.DriverBureauLoader(spark, directory) if bureau else None
    return assemble_pd_feature_matrix(views.DriverSource(spark, directory), loader)


@query
def pd_matrix(spark, directory):
    return published(_matrix(spark, directory).df)


@query
def pd_matrix_no_bureau(spark, directory):
    return published(_matrix(spark, directory, bureau=False).df)


@query
def default_rate_by_product(spark, directory):
    return published(portfolio.default_rate_by_product(views.loan_portfolio(spark, directory)))


@query
def oot_fold_counts(spark, directory):
    return fold_counts(oot_split(_dated_loans(spark, directory), *views.CUTOFFS))


# --------------------------------------------------------------------------- encoders


def _woe(spark, directory) -> tuple[WOEModel, DataFrame]:
    matrix = _matrix(spark, directory)
    encoder = build_pd_feature_pipeline("scorecard", matrix.continuous, matrix.categorical)
    return encoder.fit(matrix.df), matrix.df


@query
def woe_bins_continuous(spark, directory):
    model, _ = _woe(spark, directory)
    names = [f.name for f in model.features if f.kind == "continuous"]
    bins = model.bin_table(spark).where(F.col("feature").isin(names))
    return published(bins.select("feature", "bin", "events", "non_events", "woe", "iv"))


@query
def woe_bins_categorical(spark, directory):
    model, _ = _woe(spark, directory)
    names = [f.name for f in model.features if f.kind == "categorical"]
    level = F.when(F.col("kind") == "missing", "__MISSING__").otherwise(F.col("level"))
    bins = model.bin_table(spark).where(F.col("feature").isin(names)).withColumn("level", level)
    return published(bins.select("feature", "level", "events", "non_events", "woe", "iv"))


@query
def woe_transform(spark, directory):
    model, df = _woe(spark, directory)
    return published(model.transform(df).select("loan_id", *model.output_names))


@query
def iv_summary(spark, directory):
    model, _ = _woe(spark, directory)
    return published(model.iv_summary(spark))


@query
def iqr_clip(spark, directory):
    matrix = _matrix(spark, directory)
    clipped = IQRClipper(matrix.continuous).fit(matrix.df).transform(matrix.df)
    return published(clipped.select("loan_id", *matrix.continuous))


def _preprocessed(kind: str, spark, directory) -> DataFrame:
    matrix = _matrix(spark, directory)
    fold = matrix.df.select("loan_id", *matrix.feature_names)
    model = build_pd_feature_pipeline(kind, matrix.continuous, matrix.categorical).fit(fold)
    return published(model.transform(fold).select("loan_id", *model.output_names))


@query
def tree_preprocess(spark, directory):
    return _preprocessed("tree", spark, directory)


@query
def neural_preprocess(spark, directory):
    return _preprocessed("neural", spark, directory)


# ----------------------------------------------------------------------------- models


def _folds(spark, directory) -> tuple[PDFeatureMatrix, dict[str, DataFrame]]:
    matrix = _matrix(spark, directory)
    split = oot_split(matrix.df, *views.CUTOFFS)
    return matrix, {f: split.where(F.col("fold") == f) for f in (TRAIN, VALIDATION, TEST)}


def _scorecard(spark, directory):
    matrix, folds = _folds(spark, directory)
    return models.PDScorecard(matrix.continuous, matrix.categorical).fit(folds[TRAIN]), folds


@query
def scorecard_scores(spark, directory):
    model, folds = _scorecard(spark, directory)
    scored = model.score_points(folds[TEST])
    return published(scored.select("loan_id", DEFAULT_TARGET, "pd", "points"))


@query
def scorecard_coefficients(spark, directory):
    model, _ = _scorecard(spark, directory)
    return published(model.coefficients(spark))


@query
def scorecard_metrics(spark, directory):
    """Metrics of the scorecard on the out-of-time fold, with the development gates enforced."""
    model, folds = _scorecard(spark, directory)
    found = model.evaluate(folds[TEST])
    metrics.enforce_pd_gates(found, **metrics.GATES["development"])
    return _one_row(spark, found.as_dict())


@query
def scorecard_points(spark, directory):
    loans = views.scored_loans(spark, directory)
    return published(
        loans.select("loan_id", models.points_from_probability(F.col("p")).alias("points"))
    )


@query
def scorecard_reason_codes(spark, directory):
    model, folds = _scorecard(spark, directory)
    reasons = calibration.reason_codes(model, folds[TEST])
    return reasons.select("loan_id", F.concat_ws(",", "reasons").alias("reasons"))


def _forest(matrix: PDFeatureMatrix, **options) -> models.PDRandomForest:
    return models.PDRandomForest(matrix.continuous, matrix.categorical, **options)


@query
def forest_scores(spark, directory):
    matrix, folds = _folds(spark, directory)
    model = _forest(matrix, use_smote=False, class_weight="balanced").fit(folds[TRAIN])
    return published(model.predict_proba(folds[TEST]).select("loan_id", DEFAULT_TARGET, "pd"))


@query
def forest_smote_scores(spark, directory):
    matrix, folds = _folds(spark, directory)
    model = _forest(matrix).fit(folds[TRAIN])
    return published(model.predict_proba(folds[TEST]).select("loan_id", DEFAULT_TARGET, "pd"))


@query
def smote_train(spark, directory):
    """Class sizes of the oversampled training fold, real and synthetic rows apart."""
    matrix, folds = _folds(spark, directory)
    rows = _forest(matrix).training_rows(folds[TRAIN])
    return published(rows.groupBy(DEFAULT_TARGET, "synthetic").agg(F.count(F.lit(1)).alias("n")))


def _boosted(matrix: PDFeatureMatrix) -> models.PDBoostedTrees:
    return models.PDBoostedTrees(matrix.continuous, matrix.categorical)


@query
def gbt_scores(spark, directory):
    matrix, folds = _folds(spark, directory)
    model = _boosted(matrix).fit(folds[TRAIN], folds[VALIDATION])
    return published(model.predict_proba(folds[TEST]).select("loan_id", DEFAULT_TARGET, "pd"))


@query
def importances(spark, directory):
    matrix, folds = _folds(spark, directory)
    model = _boosted(matrix).fit(folds[TRAIN])
    return published(model.feature_importances(spark))


@query
def tuned_params(spark, directory):
    """Every trial of the search over the whole space, with its validation Gini."""
    matrix, folds = _folds(spark, directory)
    model = _boosted(matrix)
    model.tune(folds[TRAIN], folds[VALIDATION])
    rows = [
        (t.number, name, float(value), t.gini)
        for t in model.study_.trials
        for name, value in t.params.items()
    ]
    return published(
        spark.createDataFrame(rows, "trial int, parameter string, value double, gini double")
    )


# ---------------------------------------------------------------------------- metrics


def _one_row(spark, values: dict, digits: int = DIGITS) -> DataFrame:
    schema = ", ".join(
        f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()
    )
    return published(spark.createDataFrame([tuple(values.values())], schema), digits)


@query
def auc_gini(spark, directory):
    loans = views.scored_loans(spark, directory)
    auc = metrics.auc_roc(loans, "y", "p")
    return _one_row(spark, {"auc": auc, "gini": 2.0 * auc - 1.0}, 9)


@query
def ks(spark, directory):
    return _one_row(spark, {"ks": metrics.ks_statistic(views.scored_loans(spark, directory), "y", "p")}, 9)


@query
def brier(spark, directory):
    return _one_row(spark, {"brier": metrics.brier_score(views.scored_loans(spark, directory), "y", "p")}, 9)


@query
def hosmer_lemeshow(spark, directory):
    found = metrics.hosmer_lemeshow(views.scored_loans(spark, directory), "y", "p")
    return _one_row(
        spark,
        {
            "statistic": found.statistic,
            "p_value": found.p_value,
            "dof": found.dof,
            "n_groups": found.n_groups,
        },
    )


@query
def pd_metrics(spark, directory):
    return _one_row(spark, metrics.evaluate_pd(views.scored_loans(spark, directory), "y", "p").as_dict())


# -------------------------------------------------------------------------- portfolio


def _exposures(spark, directory) -> DataFrame:
    return views.scored_loans(spark, directory).withColumn("ead", portfolio.exposure_at_default())


@query
def exposure_at_default(spark, directory):
    return published(_exposures(spark, directory).select("loan_id", "ead"))


@query
def expected_loss_rollup(spark, directory):
    rolled = portfolio.expected_loss_rollup(_exposures(spark, directory), pd="p")
    return published(rolled, {"ead": 1, "expected_loss": 1})


@query
def stressed_expected_loss(spark, directory):
    stressed = portfolio.stressed_expected_loss(_exposures(spark, directory), pd="p")
    return published(stressed, {"expected_loss": 1})


@query
def downturn_parameters(spark, directory):
    loans = views.scored_loans(spark, directory).withColumn(
        "ccf", F.col("months_on_book").cast("double") / 120.0
    )
    windows = [("slump", "1997-07-01", "1998-12-31"), ("shock", "1998-08-01", "1998-10-31")]
    return published(
        portfolio.downturn_parameters(
            loans, date="observation_date", ccf="ccf", lgd="lgd", windows=windows
        )
    )


@query
def credit_conversion_factors(spark, directory):
    loans = views.scored_loans(spark, directory).select(
        "borrower_segment",
        F.col("outstanding_principal").alias("drawn"),
        F.col("sanctioned_limit").alias("limit"),
        (
            F.col("outstanding_principal")
            + (F.col("sanctioned_limit") - F.col("outstanding_principal")) * F.col("lgd")
        ).alias("drawn_at_default"),
    )
    return published(portfolio.credit_conversion_factors(loans))


@query
def sma_transitions(spark, directory):
    loans = views.loan_portfolio(spark, directory).withColumn("stage", portfolio.stage())
    return published(portfolio.stage_transitions(loans))


@query
def default_within_a_year(spark, directory):
    return published(portfolio.default_within_a_year(views.loan_portfolio(spark, directory)))


@query
def vintage_curves(spark, directory):
    return published(portfolio.vintage_curves(views.loan_portfolio(spark, directory)))


@query
def disparate_impact(spark, directory):
    return published(
        portfolio.disparate_impact(
            views.scored_loans(spark, directory), group="state_code", favourable=F.col("p") < 0.10
        )
    )


# ------------------------------------------------------------------------- monitoring

PSI_FEATURES = ["p", "lgd", "ltv_at_origination", "months_on_book"]


def _populations(spark, directory) -> monitoring.Populations:
    boundary = F.lit("2000-01-01").cast("timestamp")
    return monitoring.Populations(
        views.scored_loans(spark, directory), F.col("observation_date") < boundary
    )


@query
def psi(spark, directory):
    shares = monitoring.share_table(_populations(spark, directory), PSI_FEATURES)
    return published(monitoring.stability_index(shares))


@query
def jensen_shannon(spark, directory):
    shares = monitoring.share_table(_populations(spark, directory), PSI_FEATURES)
    return published(monitoring.jensen_shannon(shares))


def _feature_shares(spark, directory) -> DataFrame:
    """Bins of the score and of every continuous feature of the matrix, in one pass."""
    matrix = _matrix(spark, directory)
    scores = views.scored_loans(spark, directory).select("loan_id", "p")
    boundary = F.lit("2000-01-01").cast("timestamp")
    populations = monitoring.Populations(matrix.df.join(scores, "loan_id"), F.col("observation_date") < boundary)
    return monitoring.share_table(populations, ["p", *matrix.continuous])


@query
def feature_psi(spark, directory):
    """Stability of the score and of every continuous feature."""
    return published(monitoring.stability_index(_feature_shares(spark, directory)))


@query
def feature_jensen_shannon(spark, directory):
    return published(monitoring.jensen_shannon(_feature_shares(spark, directory)))


@query
def drift_ks(spark, directory):
    return published(monitoring.two_sample_ks(_populations(spark, directory), "p"), 9)


@query
def cohort_performance(spark, directory):
    return published(
        monitoring.cohort_performance(
            views.scored_loans(spark, directory),
            target="y",
            probability="p",
            cohort=F.date_format("observation_date", "yyyy-MM"),
            baseline_gini=0.55,
        )
    )


@query
def calibration_by_grade(spark, directory):
    grade = F.when(F.col("p") < 0.05, "A").when(F.col("p") < 0.16, "B").otherwise("C")
    return published(
        monitoring.calibration_by_grade(
            views.scored_loans(spark, directory), target="y", probability="p", grade=grade
        )
    )


@query
def feature_correlation(spark, directory):
    """Every pair of continuous features."""
    matrix = _matrix(spark, directory)
    pairs, _ = monitoring.correlation_and_vif(matrix.df, matrix.continuous)
    return published(pairs)


@query
def feature_vif(spark, directory):
    """Every continuous feature; infinite where others determine it."""
    matrix = _matrix(spark, directory)
    _, vif = monitoring.correlation_and_vif(matrix.df, matrix.continuous)
    infinite = F.col("vif") == float("inf")
    return vif.select("feature", F.when(infinite, F.col("vif")).otherwise(rounded("vif")).alias("vif"))


# ------------------------------------------------------------------------ calibration


@query
def calibrated_pd(spark, directory):
    """Platt, isotonic and long-run calibration of a distorted probability."""
    loans = views.scored_loans(spark, directory).select(
        "loan_id", "y", (F.col("p") * 0.5).alias("raw")
    )
    platt = calibration.PlattCalibrator().fit(loans, "y", "raw")
    isotonic = calibration.IsotonicCalibrator().fit(loans, "y", "raw")
    long_run = calibration.LongRunCalibrator(0.10).fit(loans, "raw")
    scored = isotonic.transform(loans, "raw", "isotonic").withColumns(
        {"platt": platt.apply(F.col("raw")), "long_run": long_run.apply(F.col("raw"))}
    )
    return published(scored.select("loan_id", "raw", "platt", "isotonic", "long_run"))


@query
def two_stage_lgd(spark, directory):
    """Two-stage loss model on the tree-preprocessed matrix with the state allowed."""
    loader = views.DriverBureauLoader(spark, directory)
    matrix = assemble_pd_feature_matrix(views.DriverSource(spark, directory), loader, drop_forbidden=False)
    encoder = build_pd_feature_pipeline("tree", matrix.continuous, matrix.categorical, forbidden_features=())
    fold = matrix.df.select("loan_id", *matrix.feature_names)
    encoded = encoder.fit(fold)
    losses = views.scored_loans(spark, directory).select(
        "loan_id", F.greatest(F.col("ltv_at_origination") - F.col("lgd"), F.lit(0.0)).alias("loss")
    )
    loans = encoded.transform(fold).join(losses, "loan_id")
    scored = calibration.TwoStageLGD(encoded.output_names).fit(loans, "loss").predict(loans)
    return published(scored.select("loan_id", "p_loss", "severity", "lgd"))


# registered under the name used for its reference statement
_REGISTRY["missing_identities"] = _REGISTRY.pop("missing_identities_of_loans")

__all__ = ["published", "queries", "rounded"]
