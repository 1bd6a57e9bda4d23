"""Mergeable moments, calibration with gates, quality metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Gates of a calibration, in the order in which they are tried.
VARIANCE_LEAST = 1e-12
SCALE_LEAST = 1e-8
CORRELATION_LEAST = 0.50
CONTRAST_LEAST = 0.50
DRIFT_MOST = 0.01
OUTSIDE_MOST = 0.01


def interpolated(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles of each group's values, as an array ``q``: of the two values next to a share's place, weighted and added with one rounding.

    ``percentile`` of Spark rounds each product, so that a value right between two codes may get another one. Values are ranked in their sort; no group is held at once.
    """
    w, v = Window.partitionBy(*by), F.col(value)
    ranked = df.select(*by, v.alias("__v"), (F.row_number().over(w.orderBy(v.asc_nulls_last())) - 1).alias("__rank"), F.count(v).over(w).alias("__n"))
    place = [(F.col("__n") - 1) * F.lit(float(s)) for s in shares]
    at = lambda rank: F.max(F.when(F.col("__rank") == rank, F.col("__v")))
    picked = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *[c for i, p in enumerate(place) for c in (at(F.floor(p)).alias(f"__low{i}"), at(F.ceil(p)).alias(f"__high{i}"))])

    def mixed(i: int) -> Column:
        low, high, d = F.col(f"__low{i}"), F.col(f"__high{i}"), place[i] - F.floor(place[i])
        sum_ = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - d, high * d).cast("double")
        return F.when(d > 0, sum_).otherwise(low)

    return picked.select(*by, F.array(*[F.when(F.col("__n") > 0, mixed(i)) for i in range(len(shares))]).alias("q"))


def tile_moments(df: DataFrame, by: list[str], tile: str, x: str, eligible: Column) -> DataFrame:
    """(n, mean, m2) of each tile's eligible values."""
    v = F.when(eligible, F.col(x))
    return df.groupBy(*by, tile).agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))


def merge_moments(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles' moments as one: the squares inside of tiles, and those of their means' deviations from the pooled mean, so that large means cancel nothing."""
    pooled = tiles.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")), F.lit(0.0)).alias("__pooled")).withColumnsRenamed({c: f"__{c}" for c in by})
    alike = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    apart = F.col("mean") - F.col("__pooled")
    return tiles.join(pooled, alike).groupBy(*by).agg(F.sum("n").alias("n"), F.first("__pooled").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"))


def pair_statistics(df: DataFrame, by: list[str], raw: str, source: str, eligible: Column) -> DataFrame:
    """Counts, means, population variances and covariance of eligible pairs, and the least-squares fit source ~ raw."""
    x, y = F.when(eligible, F.col(raw)), F.when(eligible, F.col(source))
    out = df.groupBy(*by).agg(F.count(x).alias("pair_count"), F.avg(x).alias("raw_mean"), F.avg(y).alias("source_mean"), F.var_pop(x).alias("raw_variance"), F.var_pop(y).alias("source_variance"), F.covar_pop(x, y).alias("covariance"))
    scale = F.try_divide(F.col("covariance"), F.when(F.col("raw_variance") > 0, F.col("raw_variance")))
    return out.withColumns({"scale": scale, "correlation": F.try_divide(F.col("covariance"), F.sqrt(F.col("raw_variance") * F.col("source_variance")))}).withColumn("shift", F.col("source_mean") - F.col("scale") * F.col("raw_mean"))


def candidate_quality(df: DataFrame, fits: DataFrame, by: list[str], raw: str, eligible: Column) -> DataFrame:
    """Mean and deviation of the fitted and clipped values, and the shares that were clipped at either end."""
    fitted = F.col(raw) * F.col("scale") + F.col("shift")
    joined = df.join(fits.select(*by, "scale", "shift"), by).filter(eligible).withColumn("__v", fitted)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__v")))
    return joined.groupBy(*by).agg(F.avg(clipped).alias("candidate_mean"), F.stddev_pop(clipped).alias("candidate_std"), F.avg((F.col("__v") < 0).cast("double")).alias("low_share"), F.avg((F.col("__v") > 1).cast("double")).alias("high_share"))


def gate(df: DataFrame, source_range: Column) -> DataFrame:
    """Adds mode (ols or base_fallback) and the first gate that fails, from the columns of the two passes."""
    c = F.col
    drift, contrast = F.abs(c("candidate_mean") - c("source_mean")), F.try_divide(c("candidate_std"), F.sqrt("source_variance"))
    tests = (
        ("source_no_range", ~source_range),
        ("too_few_pairs", c("pair_count") < 2),
        ("nonfinite_statistics", F.isnan("covariance") | c("covariance").isNull()),
        ("source_variance", c("source_variance") <= VARIANCE_LEAST),
        ("raw_variance", c("raw_variance") <= VARIANCE_LEAST),
        ("nonfinite_fit", c("scale").isNull() | F.isnan("scale") | F.isnan("shift")),
        ("scale_below_minimum", c("scale") < SCALE_LEAST),
        ("correlation", c("correlation") < CORRELATION_LEAST),
        ("contrast", contrast < CONTRAST_LEAST),
        ("mean_drift", drift > DRIFT_MOST),
        ("preclip_out_of_range", c("low_share") + c("high_share") > OUTSIDE_MOST),
    )
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests])
    return df.withColumn("fallback_reason", reason).withColumn("mode", F.when(F.col("fallback_reason").isNull(), "ols").otherwise("base_fallback"))


def depth_quality(df: DataFrame, by: list[str], pixel: list[str], frame: str, predicted: str, truth: str, valid: Column | None = None) -> DataFrame:
    """tgse: mean squared error of frame-to-frame changes; abs_rel; delta1: share within a ratio of 1.25.

    All are taken where the mask ``valid`` holds: unless it is given, where truth is positive. Shares of a truth of 0 are infinite, or no number.
    """
    w = Window.partitionBy(*by, *pixel).orderBy(frame)
    p, t = F.col(predicted), F.col(truth)
    step = df.withColumn("__ok", t > 0 if valid is None else valid)
    step = step.withColumns({"__p": F.lag(predicted).over(w), "__t": F.lag(truth).over(w), "__before": F.lag("__ok").over(w)})
    ok = F.col("__ok")
    change = F.when(ok & F.col("__before"), F.pow((p - F.col("__p")) - (t - F.col("__t")), F.lit(2.0)))
    off = F.when(t != 0, F.abs(p - t) / t).when(p == 0, float("nan")).when(p != 0, float("inf"))
    ratio = F.when(p * t > 0, F.greatest(p / t, t / p)).when(p.isNotNull() & t.isNotNull(), float("inf"))
    return step.groupBy(*by).agg(F.avg(change).alias("tgse"), F.avg(F.when(ok, off)).alias("abs_rel"), F.avg(F.when(ok, (ratio < 1.25).cast("double"))).alias("delta1"))


def run_gates(runs: DataFrame, seeds: list[int]) -> DataFrame:
    """Medians over seeds, then over sequences, of a baseline and a candidate, and whether the candidate passes.

    ``runs``: backend, sequence, seed, variant (baseline or candidate), tgse, abs_rel, delta1. A sequence without exactly the seeds is an error.
    """
    names = ("tgse", "abs_rel", "delta1")
    runs = runs.groupBy("backend", "sequence", "variant").agg(*[F.median(m).alias(m) for m in names], F.array_sort(F.collect_list("seed")).alias("seeds"))
    wrong = F.col("seeds") != F.array(*[F.lit(s) for s in sorted(seeds)])
    runs = runs.withColumn("tgse", F.when(wrong, F.raise_error(F.concat(F.lit("wrong seeds in "), "sequence")).cast("double")).otherwise(F.col("tgse")))
    wide = runs.groupBy("backend").pivot("variant", ["baseline", "candidate"]).agg(*[F.median(m).alias(m) for m in names])
    c = F.col
    passed = (c("candidate_tgse") <= 0.99 * c("baseline_tgse")) & (c("candidate_abs_rel") <= 1.02 * c("baseline_abs_rel")) & (c("candidate_delta1") >= c("baseline_delta1") - 0.02)
    return wide.withColumn("passed", passed)
