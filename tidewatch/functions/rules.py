"""Decision lists and predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: reviewers' shorthand and the class that it stands for.
REVIEW_LABELS = {
    "eq": "seismic", "t": "seismic", "tphase": "seismic", "t-phase": "seismic",
    "fw": "fin_whale",
    "iq": "icequake", "iq?": "icequake", "ice quake": "icequake", "icequake": "icequake", "ic": "icequake",
    "hb": "humpback", "hb2": "humpback",
    "wc": "whale_unknown", "wc50": "whale_unknown", "wc97": "whale_unknown",
    "?": "unknown", "lf": "unknown_lf", "not sure": "unknown", "unsure": "unknown",
    "lshaped": "l_shaped", "ls": "l_shaped",
    "ship noise": "vessel",
}


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def is_tphase() -> Column:
    return (F.col("spectral_slope") < -0.5) & (F.col("peak_freq_hz") < 30) & (F.col("peak_power_db") > 48) & (F.col("duration_s") <= 3)


def is_icequake() -> Column:
    return (F.col("duration_s") > 3) & (F.col("peak_power_db") > 48) & (F.col("peak_freq_hz") < 30) & (F.col("spectral_slope") < -0.2)


def is_vessel(peak_freq: float = 100) -> Column:
    return (F.col("spectral_slope") > 0) & (F.col("peak_freq_hz") > peak_freq) & (F.col("bandwidth_hz") > 150) & (F.col("freq_modulation") > 30)


def rule_label(cluster: Column | None = None, peak_freq: float = 100) -> Column:
    """T-phase before icequake before vessel; a cluster may decide for the first two."""
    t, i = is_tphase(), is_icequake()
    if cluster is not None:
        t, i = t | F.coalesce(cluster.isin("low_0", "low_1", "mid_0"), F.lit(False)), i | F.coalesce(cluster == "high_2", F.lit(False))
    return F.when(t, "tphase").when(i, "icequake").when(is_vessel(peak_freq), "vessel")


def grade(quality: Column) -> Column:
    return F.when(quality >= 0.7, "A").when(quality >= 0.4, "B").otherwise("C")


def tier(stations: Column, residual_s: Column, centroid_km: Column, stable: Column) -> Column:
    """A to D; an unstable A or B is a C."""
    good = F.when((residual_s <= 1) & stable & (stations >= 4), "A").when(residual_s <= 2, F.when(stable, "B").otherwise("C"))
    return F.when((stations < 3) | (centroid_km > 150), "D").otherwise(F.coalesce(good, F.when(residual_s <= 5, "C").otherwise("D")))


def quality_bin(tier_: Column, stations: Column, residual_s: Column) -> Column:
    return (
        F.when((tier_ == "A") & (stations >= 5) & (residual_s < 1), "excellent")
        .when(tier_ == "A", "very good")
        .when((stations >= 4) & (residual_s < 2), "good")
        .when(stations >= 4, "fair")
        .when((stations == 3) & (residual_s < 0.5), "moderate")
        .when((stations == 3) & (residual_s < 2), "uncertain")
        .otherwise("poor")
    )


def recode(value: Column, to: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value if default is None else default)


def sector(azimuth: Column) -> Column:
    """Of eight, from degrees in [-180, 180]: each begins 22.5 degrees before its middle."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.floor((azimuth + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def valid_pick(shift_s: Column, quality: Column, pre_window_s: Column) -> Column:
    return F.coalesce((quality >= 0.15) & (shift_s <= 0) & (F.abs(shift_s) <= 0.95 * pre_window_s), F.lit(False))


def jaccard(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def first_class(column: Column, order: tuple[str, ...] = ("tphase", "icequake", "vessel")) -> Column:
    """Aggregate: the class of the group that comes first in order; null for a group that has none of them."""
    rank = reduce(lambda acc, i: acc.when(column == order[i], i), range(1, len(order)), F.when(column == order[0], 0))
    first = F.min(rank)
    return reduce(lambda acc, i: acc.when(first == i, order[i]), range(1, len(order)), F.when(first == 0, order[0]))
