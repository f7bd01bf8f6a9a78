"""The single-factor run: eligible sample, preprocessing, and every statistic of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.columns import KEYS
from crossgrain.operators import factor_stats as S
from crossgrain.operators.calendar import calendar_index
from crossgrain.operators.cross_section import mad_winsorize, neutralize, zscore
from crossgrain.operators.labels import eligible_sample, forward_returns
from crossgrain.sources.scratch import materialize


@dataclass(frozen=True)
class Settings:
    windows: tuple[int, ...] = (1, 5, 10)
    quantiles: int = 5
    width: float = 5.0
    min_listing_days: int = 60
    direction: int = 1


@dataclass
class Run:
    sample: DataFrame
    ic: DataFrame
    ic_summary: DataFrame
    quantile_daily: DataFrame
    quantile_summary: DataFrame
    nav: DataFrame
    turnover: DataFrame
    yearly: DataFrame
    variants: Sequence[str] = field(default_factory=tuple)


def preprocess(sample: DataFrame, width: float) -> DataFrame:
    """sample with `standardized` and `neutralized` of factor_value."""
    x = mad_winsorize(sample, "factor_value", "_w", width).withColumn("standardized", zscore("_w"))
    return neutralize(x, "standardized", "neutralized").drop("_w")


def single_factor(panel: DataFrame, factor: DataFrame, settings: Settings = Settings()) -> Run:
    """Every table of the run; the preprocessed sample and its quantiles are written once, as eight statistics read them.

    The neutralized variant counts only where it has a value at all.
    """
    s = settings
    eligible = eligible_sample(panel, calendar_index(panel), s.min_listing_days).where("eligible").select(*KEYS, "industry", "market_cap")
    rows = eligible.join(factor, KEYS).join(forward_returns(panel, s.windows), KEYS, "left")
    sample = materialize(preprocess(rows, s.width), "sample")
    has_neutral = sample.where("neutralized is not null").limit(1).count() > 0
    variants = ["standardized", "neutralized"] if has_neutral else ["standardized"]
    long = S.long_sample(sample, variants, s.windows).where("value is not null")
    grouped = materialize(S.with_quantiles(long, s.quantiles), "grouped")
    ic = materialize(S.daily_ic(grouped), "ic")
    daily = materialize(S.quantile_daily_returns(grouped), "daily")
    nav = S.long_short_nav(daily, s.quantiles, s.direction)
    members = grouped.where((F.col("window") == s.windows[0]) & F.col("quantile").isNotNull())
    turnover = S.rank_turnover(members).join(S.membership_turnover(members, s.quantiles), ["date", "variant"], "left")
    return Run(sample, S.cumulative_ic(ic), S.ic_summary(ic), daily, S.quantile_summary(daily), nav, turnover, S.yearly_performance(ic, nav, turnover), variants)
