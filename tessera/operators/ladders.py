"""Labels by fixed thresholds, in order of priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_interpretation(raw: Column, filtered: Column, low: Column, high: Column) -> Column:
    """reversal, ambiguity, attenuation or survival of a gap after filtering."""
    return F.when(raw * filtered < 0, "reversal").when((low <= 0) & (high >= 0), "ambiguity").when(F.abs(filtered) < F.abs(raw), "attenuation").otherwise("survival")


def gap_category(raw: Column, adjusted: Column, low: Column, high: Column, varies: Column) -> Column:
    excluded = (low > 0) | (high < 0)
    return F.when(varies, "heterogeneous").when((raw * adjusted < 0) & excluded, "reversed").when(~excluded | (F.abs(adjusted) < 0.02), "eliminated").when(F.abs(adjusted) < 0.8 * F.abs(raw), "attenuated").otherwise("persistent")


def share_band(difference: Column) -> Column:
    return F.when(difference <= -0.05, "less").when(difference >= 0.05, "more").otherwise("similar")


def span_band(ratio: Column) -> Column:
    return F.when(ratio <= 0.8, "narrower").when(ratio >= 1.25, "broader").otherwise("similar")


def shape(mode_share: Column, edge_share: Column, bin_share: Column, dynamic_range: Column) -> Column:
    """A distribution's shape: mass point, boundary or clumped first, then by its effective dynamic range."""
    return F.when(mode_share >= 0.1, "mass_point").when(edge_share >= 0.2, "boundary").when(bin_share >= 0.2, "clumped").when(dynamic_range >= 0.7, "broad").when(dynamic_range < 0.4, "narrow").otherwise("moderate")


def consistency(distinct_categories: Column) -> Column:
    return F.when(distinct_categories == 1, "consistent").otherwise("heterogeneous")


def reproduction(difference: Column, published_sd: Column) -> Column:
    """match within two published standard deviations, shift beyond four, indeterminate between."""
    d = F.abs(difference)
    return F.when(d <= 2 * published_sd, "match").when(d > 4 * published_sd, "shift").otherwise("indeterminate")
