"""Portfolio measures: default rates, expected loss, stress, exposure, migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.quantiles import grouped_quantile

# Products drawn against a limit.
REVOLVING_PRODUCTS = ["credit_card", "overdraft", "working_capital", "cash_credit"]
# Stress scenario, default multiplier, collateral haircut.
STRESS_SCENARIOS = [("baseline", 1.0, 0.0), ("moderate", 1.5, 0.0), ("severe", 3.0, 0.35)]
# Name, first and last day of each downturn window.
DOWNTURN_WINDOWS = [
    ("COVID Stress", "2020-03-01", "2021-03-31"),
    ("NBFC Liquidity Crisis", "2018-09-01", "2019-09-30"),
]
FAIRNESS_MINIMUM = 0.80
# Sub-standard account stage by days-past-due flag.
STAGES = {0: "SMA-0", 1: "SMA-1", 2: "SMA-2"}


def default_rate_by_product(loans: DataFrame, target: str = "default_flag_12m") -> DataFrame:
    """Default rate in percent and loan count per product, and for the whole book.

    The overall row has product ``ALL``. One aggregate; partial counts per task.
    """
    y = F.col(target).cast("int")
    return (
        loans.rollup("product_type")
        .agg(
            F.grouping("product_type").alias("_all"),
            (F.avg(y) * 100.0).alias("default_rate"),
            F.count(F.lit(1)).alias("n_loans"),
        )
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col("product_type")).alias("product_type"),
            "default_rate",
            "n_loans",
        )
    )


# ---------------------------------------------------------------- exposure and loss


def exposure_at_default(
    ccf_by_segment: dict[str, float] | None = None,
    *,
    default_ccf: float = 0.75,
    outstanding: str = "outstanding_principal",
    limit: str = "sanctioned_limit",
) -> Column:
    """Term loans: the outstanding amount. Revolving: drawn plus CCF times undrawn."""
    ccf = F.lit(default_ccf)
    for segment, value in (ccf_by_segment or {}).items():
        ccf = F.when(F.col("borrower_segment") == segment, F.lit(value)).otherwise(ccf)
    drawn = F.col(outstanding)
    undrawn = F.greatest(F.coalesce(F.col(limit), drawn) - drawn, F.lit(0.0))
    return F.when(F.col("product_type").isin(REVOLVING_PRODUCTS), drawn + ccf * undrawn).otherwise(drawn)


def credit_conversion_factors(
    facilities: DataFrame,
    *,
    drawn: str = "drawn",
    limit: str = "limit",
    at_default: str = "drawn_at_default",
    by: Sequence[str] = ("borrower_segment",),
) -> DataFrame:
    """Observed CCF per group: mean, and an upper percentile as the cautious choice.

    A facility without undrawn amount says nothing and is left out. The
    percentile is exact, and no group is gathered in one task.
    """
    undrawn = F.col(limit) - F.col(drawn)
    ccf = F.least(F.greatest((F.col(at_default) - F.col(drawn)) / undrawn, F.lit(0.0)), F.lit(1.0))
    observed = facilities.where(undrawn > 0).select(*by, ccf.alias("ccf"))
    means = observed.groupBy(F.struct(*by).alias("g")).agg(F.avg("ccf").alias("mean_ccf"), F.count(F.lit(1)).alias("n"))
    upper = grouped_quantile(observed, by, "ccf", 0.9).select(F.struct(*by).alias("g"), F.col("quantile").alias("p90_ccf"))
    return means.join(upper, "g", "left").select("g.*", "mean_ccf", "p90_ccf", "n")


def expected_loss_rollup(
    exposures: DataFrame,
    *,
    pd: str = "pd",
    lgd: str = "lgd",
    ead: str = "ead",
    by: Sequence[str] = ("borrower_segment", "product_type"),
) -> DataFrame:
    """EL = PD x LGD x EAD summed per group, subtotal and portfolio (``ALL``)."""
    loss = F.col(pd) * F.col(lgd) * F.col(ead)
    rolled = exposures.rollup(*by).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in by],
        F.count(F.lit(1)).alias("n_loans"),
        F.sum(ead).alias("ead"),
        F.sum(loss).alias("expected_loss"),
    )
    return rolled.select(
        *[F.when(F.col(f"_g_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c) for c in by],
        "n_loans",
        "ead",
        "expected_loss",
        F.when(F.col("ead") > 0, F.col("expected_loss") / F.col("ead")).alias("loss_rate"),
    )


def stressed_expected_loss(
    exposures: DataFrame,
    scenarios: Sequence[tuple[str, float, float]] = tuple(STRESS_SCENARIOS),
    *,
    pd: str = "pd",
    lgd: str = "lgd",
    ead: str = "ead",
    by: str = "borrower_segment",
) -> DataFrame:
    """Expected loss per segment and scenario.

    PD is multiplied (at most 1), LGD rises by the lost share of collateral. All
    scenarios are columns of one aggregate, turned into rows afterwards, so the
    exposures are neither joined nor repeated.
    """
    sums = []
    for i, (_, multiplier, haircut) in enumerate(scenarios):
        worse_pd = F.least(F.col(pd) * multiplier, F.lit(1.0))
        worse_lgd = F.least(F.col(lgd) + (F.lit(1.0) - F.col(lgd)) * haircut, F.lit(1.0))
        sums.append(F.sum(worse_pd * worse_lgd * F.col(ead)).alias(f"el_{i}"))
    per_segment = exposures.groupBy(by).agg(*sums)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("scenario"), F.col(f"el_{i}").alias("expected_loss"))
                for i, (name, _, _) in enumerate(scenarios)
            ]
        )
    ).alias("r")
    return per_segment.select(by, rows).select(by, "r.scenario", "r.expected_loss")


def downturn_parameters(
    observations: DataFrame,
    *,
    date: str,
    ccf: str,
    lgd: str,
    windows: Sequence[tuple[str, str, str]] = tuple(DOWNTURN_WINDOWS),
) -> DataFrame:
    """Largest CCF and mean LGD of the observations inside each stress window.

    The few windows are literals of a filter, so dates outside never leave the
    scan; an observation in two windows counts in both.
    """
    day = F.to_date(date)
    hits = [
        F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(name))
        for name, first, last in windows
    ]
    inside = None
    for _, first, last in windows:
        one = F.col(date).between(F.lit(first).cast("timestamp"), F.lit(f"{last} 23:59:59.999999").cast("timestamp"))
        inside = one if inside is None else inside | one
    tagged = observations.where(inside).select(
        F.explode(F.array_compact(F.array(*hits))).alias("window"), ccf, lgd
    )
    return tagged.groupBy("window").agg(
        F.max(ccf).alias("downturn_ccf"),
        F.avg(lgd).alias("downturn_lgd"),
        F.count(F.lit(1)).alias("n"),
    )


# --------------------------------------------------------------- stages and cohorts


def stage(npa: str = "npa_flag", sma: str = "sma_flag") -> Column:
    out = F.when(F.coalesce(F.col(npa), F.lit(False)), "NPA")
    for code, label in STAGES.items():
        out = out.when(F.col(sma) == code, label)
    return out


def stage_transitions(
    observations: DataFrame,
    *,
    key: str = "borrower_id",
    date: str = "observation_date",
    stage_column: str = "stage",
) -> DataFrame:
    """Quarter-to-quarter transition counts and rates between stages.

    First the worst stage per borrower and quarter (map-side combined, so a
    borrower with very many loans becomes one row per quarter), then a join of
    each quarter to the next one: a bounded number of rows per borrower.
    """
    order = [*STAGES.values(), "NPA"]
    rank = F.coalesce(*[F.when(F.col(stage_column) == s, F.lit(i)) for i, s in enumerate(order)])
    quarter = (F.year(date) * 4 + F.quarter(date) - 1).alias("quarter")
    worst = observations.groupBy(key, quarter).agg(F.max(rank).alias("rank"))
    following = Window.partitionBy(key).orderBy("quarter")
    labels = F.array(*[F.lit(s) for s in order])
    pairs = (
        worst.withColumns(
            {"next_quarter": F.lead("quarter").over(following), "next_rank": F.lead("rank").over(following)}
        )
        .where(F.col("next_quarter") == F.col("quarter") + 1)
        .select(
            F.get(labels, F.col("rank")).alias("from_stage"),
            F.get(labels, F.col("next_rank")).alias("to_stage"),
        )
    )
    counts = pairs.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))
    # 16 cells at most from here on
    total = F.sum("n").over(Window.partitionBy("from_stage"))
    return counts.withColumn("rate", F.col("n") / total)


def default_within_a_year(
    observations: DataFrame,
    *,
    key: str = "borrower_id",
    date: str = "observation_date",
    defaulted: str = "npa_flag",
    by: str = "loan_id",
) -> DataFrame:
    """Flag every observation whose borrower defaults in the following 12 months.

    The observations are reduced to one row per borrower and day first, so the
    window is bounded by the calendar. The first default after the day is the
    smallest default date in the rows that follow. The flag of a day is then joined
    back to its observations, one row for each of them: an observation with a null
    borrower or date cannot be followed and gets 0, and is kept like any other.
    """
    day = F.to_date(date)
    days = observations.groupBy(key, day.alias("day")).agg(
        F.bool_or(F.coalesce(F.col(defaulted), F.lit(False))).alias("hit")
    )
    after = Window.partitionBy(key).orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col("hit"), F.col("day"))).over(after)
    flags = days.select(
        key,
        "day",
        F.coalesce(following <= F.add_months("day", 12), F.lit(False)).cast("int").alias("default_next_12m"),
    )
    return observations.select(by, key, day.alias("day")).join(flags, [key, "day"], "left").select(
        by, key, "day", F.coalesce("default_next_12m", F.lit(0)).alias("default_next_12m")
    )


def vintage_curves(
    loans: DataFrame,
    *,
    opened: str = "disbursement_date",
    age: str = "months_on_book",
    target: str = "default_flag_12m",
) -> DataFrame:
    """Cumulative default rate per disbursement month over months on book."""
    y = F.col(target).cast("int")
    cells = loans.groupBy(
        F.date_format(opened, "yyyy-MM").alias("vintage"), F.col(age).alias("age")
    ).agg(F.count(F.lit(1)).alias("n_loans"), F.sum(y).alias("n_default"))
    # at most one row per vintage and month of age
    so_far = Window.partitionBy("vintage").orderBy("age").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy("vintage")
    return cells.withColumns(
        {
            "cum_default": F.sum("n_default").over(so_far),
            "cum_default_rate": F.sum("n_default").over(so_far) / F.sum("n_loans").over(whole),
        }
    )


def disparate_impact(
    decisions: DataFrame, *, group: str, favourable: Column, minimum: float = FAIRNESS_MINIMUM
) -> DataFrame:
    """Favourable rate of each group over the best group's rate."""
    rates = decisions.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(favourable.cast("int")).alias("favourable_rate")
    )
    # one row per group
    best = F.max("favourable_rate").over(Window.partitionBy(F.lit(0)))
    impact = F.when(best > 0, F.col("favourable_rate") / best)
    return rates.withColumn("impact_ratio", impact).withColumn(
        "passes", F.coalesce(F.col("impact_ratio") >= minimum, F.lit(False))
    )
