"""Synthetic telemetry with known truth: deterministic in the seed, computed in columns, nothing held on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.numeric import hour_of_week_profile, pareto_quantile


def uniform(seed: int, *of: Column) -> Column:
    """A number in (0, 1) for each row, from a hash of what identifies it."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *of: Column) -> Column:
    """A standard normal number for each row (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *of))) * F.cos(2 * math.pi * uniform(seed + 1, *of))


def world(spark: SparkSession, *, groups: int = 300, instances: int = 20, windows: int = 60, seed: int = 1, base: float = 100.0, noise: float = 0.05, hot: int = 0, hot_added: float = 0.0, drifting: int = 0, drift: float = 0.0, churn: float = 0.0) -> DataFrame:
    """(w, grp, instance, value) of groups of instances around a base.

    The first instance of the first ``hot`` groups is higher by ``hot_added``; all of the last ``drifting`` groups grow by
    ``drift`` a window; a share ``churn`` of the instances is replaced in every window by one of a new number."""
    ids = spark.range(groups * instances * windows)
    rows = ids.select((F.col("id") % windows).alias("w"), (F.floor(F.col("id") / windows) % groups).alias("grp"), F.floor(F.col("id") / (windows * groups)).alias("instance"))
    value = base * (1 + noise * normal(seed, F.col("w"), F.col("grp"), F.col("instance")))
    value = value + F.when((F.col("grp") < hot) & (F.col("instance") == 0), hot_added).otherwise(0.0) + F.when(F.col("grp") >= groups - drifting, drift * F.col("w")).otherwise(0.0)
    rows = rows.withColumn("value", value)
    if not churn:
        return rows
    # An instance's number is the one it had plus a new thousand for each window in which its place was dealt anew.
    replaced = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("w")), F.lit(0).cast("bigint"), lambda n, w: n + F.when((w > 0) & (uniform(seed + 90, w, F.col("grp"), F.col("instance")) < churn), 1).otherwise(0))
    return rows.withColumn("instance", F.col("instance") + instances * replaced)


def lifecycle_truth(values: DataFrame, key: list[str], windows: int) -> DataFrame:
    """Truth rows of type birth and tombstone: the first window of each series, if not the first of all, and the window
    after its last, if there is one."""
    seen = values.groupBy(*key).agg(F.min("w").alias("first"), F.max("w").alias("last"))
    born = seen.where("first > 0").select(*key, F.lit("birth").alias("type"), F.col("first").alias("window_start"), F.col("first").alias("window_end"))
    gone = seen.where(F.col("last") < windows - 1).select(*key, F.lit("tombstone").alias("type"), (F.col("last") + 1).alias("window_start"), (F.col("last") + 1).alias("window_end"))
    return born.unionByName(gone)


def drift_truth(spark: SparkSession, *, groups: int, drifting: int, windows: int, drift: float, base: float) -> DataFrame:
    """A truth row of type drift for each drifting group, over the whole run: what it has grown by at its end."""
    rows = spark.range(groups - drifting, groups).withColumnRenamed("id", "grp")
    return rows.select("grp", F.lit("drift").alias("type"), F.lit(0).cast("bigint").alias("window_start"), F.lit(windows - 1).cast("bigint").alias("window_end"), F.lit(base + drift * (windows - 1)).alias("expected_value"), F.lit(drift * (windows - 1)).alias("magnitude"))


def hot_truth(spark: SparkSession, *, hot: int, windows: int, hot_added: float) -> DataFrame:
    """A truth row of type anomaly for each hot instance, over the whole run."""
    return spark.range(hot).select(F.col("id").alias("grp"), F.lit(0).cast("bigint").alias("instance"), F.lit("anomaly").alias("type"), F.lit(0).cast("bigint").alias("window_start"), F.lit(windows - 1).cast("bigint").alias("window_end"), F.lit(hot_added).alias("magnitude"))


def anomalies(spark: SparkSession, *, groups: int, windows: int, count: int = 20, magnitude: float = 60.0, seed: int = 2) -> DataFrame:
    """Truth rows: jumps of two windows spread over the middle of a run."""
    rows = spark.range(count).withColumnRenamed("id", "ix")
    start = F.floor(windows * (0.15 + 0.6 * (F.col("ix") + 0.5) / count)).cast("long")
    grp = F.floor(uniform(seed, F.col("ix")) * groups).cast("long")
    return rows.select("ix", F.lit("anomaly").alias("type"), grp.alias("grp"), start.alias("window_start"), (start + 1).alias("window_end"), F.lit(magnitude).alias("magnitude"))


def applied(values: DataFrame, truth: DataFrame) -> DataFrame:
    """Values with the jumps of truth rows added to all instances of their group."""
    t = truth.select(F.col("grp").alias("__g"), F.explode(F.sequence("window_start", "window_end")).alias("__w"), "magnitude").groupBy("__g", "__w").agg(F.sum("magnitude").alias("__m"))
    joined = values.join(t, (values.grp == F.col("__g")) & (values.w == F.col("__w")), "left")
    return joined.withColumn("value", F.col("value") + F.coalesce("__m", F.lit(0.0))).drop("__g", "__w", "__m")


def weak_observers(spark: SparkSession, *, agents: int, series: int, shifted: int, windows: int, shift: float = 1.0, seed: int = 3) -> DataFrame:
    """(w, agent, series, value): every agent sees a shift about as large as its own noise."""
    rows = spark.range(agents * series * windows).select((F.col("id") % windows).alias("w"), (F.floor(F.col("id") / windows) % agents).alias("agent"), F.floor(F.col("id") / (windows * agents)).alias("series"))
    return rows.withColumn("value", normal(seed, F.col("w"), F.col("agent"), F.col("series")) + F.when((F.col("series") < shifted) & (F.col("w") >= windows // 2), shift).otherwise(0.0))


def month(spark: SparkSession, *, groups: int, days: int, per_day: int = 24, seed: int = 4, incidents: list[tuple] | None = None, emitters: int = 1, life_days: int = 0) -> DataFrame:
    """(w, grp, emitter, pod, value) with a daily season. A group reports through one of ``emitters``; its pod is replaced
    every ``life_days`` days, groups at different times. Incidents are (first window, last window, share of groups,
    added value, kind), the kind ``mass`` (all at once, the default), ``ramp`` (growing to the end) or ``spike`` (the
    first window alone)."""
    n = days * per_day
    rows = spark.range(groups * n).select((F.col("id") % n).alias("w"), F.floor(F.col("id") / n).alias("grp"))
    value = 100 * (1 + 0.25 * F.sin(2 * math.pi * F.col("w") / per_day)) + 5 * normal(seed, F.col("w"), F.col("grp"))
    for k, (a, b, share, added, *kind) in enumerate(incidents or []):
        shape = {"mass": F.lit(1.0), "ramp": (F.col("w") - a + 1) / float(b - a + 1), "spike": F.when(F.col("w") == a, 1.0).otherwise(0.0)}[kind[0] if kind else "mass"]
        value = value + F.when(F.col("w").between(a, b) & (uniform(seed + 10 + k, F.col("grp")) < share), added * shape).otherwise(0.0)
    shifted = F.col("w") + F.floor(uniform(seed + 5, F.col("grp")) * max(1, life_days * per_day))
    pod = F.floor(shifted / (life_days * per_day)) if life_days else F.lit(0).cast("bigint")
    return rows.withColumn("value", value).withColumn("emitter", F.col("grp") % emitters).withColumn("pod", pod)


def background_and_target(spark: SparkSession, *, series: int = 900, windows: int = 120, seed: int = 13, low: float = 50.0, high: float = 150.0, spread: float = 0.2, season: float = 0.25, per_day: int = 48, target_spread: float = 0.02, bursts: list[tuple[int, int, float]] | None = None) -> DataFrame:
    """(w, series, value): seasonal background series with bases between two values, and series 0, the target, with a
    small spread of its own and bursts of (first window, last window, added share of its base)."""
    rows = spark.range((series + 1) * windows).select((F.col("id") % windows).alias("w"), F.floor(F.col("id") / windows).alias("series"))
    base = low + (high - low) * uniform(seed, F.col("series"))
    wave = 1 + season * F.sin(2 * math.pi * F.col("w") / per_day + 2 * math.pi * uniform(seed + 2, F.col("series")))
    spread_of = F.when(F.col("series") == 0, target_spread).otherwise(spread)
    value = base * wave * (1 + spread_of * normal(seed + 3, F.col("w"), F.col("series")))
    for a, b, added in bursts or []:
        value = value + F.when((F.col("series") == 0) & F.col("w").between(a, b), added * base).otherwise(0.0)
    return rows.withColumn("value", value)


def seasonal_latency(spark: SparkSession, *, weeks: int = 8, seed: int = 5, noise: float = 0.05, base: float = 100.0, sigma: float = 0.15) -> DataFrame:
    """(t, p50, p95, p99) by the hour with a weekly profile."""
    rows = spark.range(weeks * 168).withColumnRenamed("id", "t")
    mid = base * hour_of_week_profile(F.col("t")) * (1 + noise * normal(seed, F.col("t")))
    return rows.withColumn("p50", mid).withColumn("p95", F.col("p50") * math.exp(1.645 * sigma)).withColumn("p99", F.col("p50") * math.exp(2.326 * sigma))


def gamma_shaped(shape: int, seed: int, *of: Column) -> Column:
    """A gamma number of a whole shape, as a sum of exponential ones."""
    out = F.lit(0.0)
    for k in range(shape):
        out = out - F.log(uniform(seed + k, *of))
    return out


def beta_2_5(seed: int, *of: Column) -> Column:
    a, b = gamma_shaped(2, seed, *of), gamma_shaped(5, seed + 20, *of)
    return a / (a + b)


def heavy_tail(spark: SparkSession, *, n: int = 2000, window: int = 100, xi: float = 0.2, sigma: float = 1.0, threshold: float = 10.0, exceed: float = 0.05, seed: int = 6) -> DataFrame:
    """(t, i, value): mostly a beta body under a threshold, beyond it with a Pareto tail. Its windows' quantiles are
    ``conformal.window_quantiles`` by t."""
    rows = spark.range(n).select(F.floor(F.col("id") / window).alias("t"), F.col("id").alias("i"))
    tail = pareto_quantile(uniform(seed, F.col("i")), xi, sigma, threshold)
    return rows.withColumn("value", F.when(uniform(seed + 1, F.col("i")) < exceed, tail).otherwise(threshold * beta_2_5(seed + 100, F.col("i"))))


def heteroscedastic_pair(spark: SparkSession, *, n: int = 500, base: float = 100.0, sigma: float = 2.0, ratio: float = 10.0, seed: int = 7) -> DataFrame:
    rows = spark.range(2 * n).select((F.col("id") % n).alias("t"), F.when(F.col("id") < n, "a").otherwise("b").alias("entity"))
    return rows.withColumn("p50", base + F.when(F.col("entity") == "a", sigma).otherwise(sigma * math.sqrt(ratio)) * normal(seed, F.col("t"), F.col("entity")))


def regime_shift(spark: SparkSession, *, at: int, kind: str = "step", target: str = "scores", n: int = 400, magnitude: float = 2.0, ramp: int = 40, features: int = 3, concentration: int = 5, seed: int = 8) -> DataFrame:
    """(t, input_features, score): from ``at`` on inputs or scores move, at once or over ``ramp`` windows. Inputs are
    shares of a mix (Dirichlet), which moves towards its first part; scores are standard normal numbers."""
    rows = spark.range(n).withColumnRenamed("id", "t")
    moved = F.when(F.col("t") < at, 0.0).otherwise(F.lit(magnitude) if kind == "step" else magnitude * F.least(F.lit(1.0), (F.col("t") - at + 1) / ramp))
    parts = F.array(*[gamma_shaped(concentration, seed + 30 * k, F.col("t")) * (1.0 + (moved if target == "inputs" and k == 0 else 0.0)) for k in range(features)])
    rows = rows.withColumn("__p", parts).withColumn("__s", F.aggregate("__p", F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("input_features", F.transform("__p", lambda x: x / F.col("__s"))).drop("__p", "__s")
    return rows.withColumn("score", normal(seed + 500, F.col("t")) + (moved if target == "scores" else 0.0))


def slow_burn(spark: SparkSession, *, rate: float, n: int = 300, base: float = 100.0, seed: int = 9) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "t").withColumn("p50", base + rate * F.col("t") + normal(seed, F.col("t")))


def bimodal_fleet(spark: SparkSession, *, hosts: int, mix: float, per_host: int = 200, base: float = 100.0, slow: float = 3.0, seed: int = 10) -> DataFrame:
    """(host, i, value): a share ``mix`` of the hosts is slow, so that averages of their p95 mislead."""
    rows = spark.range(hosts * per_host).select((F.col("id") % hosts).alias("host"), F.floor(F.col("id") / hosts).alias("i"))
    is_slow = F.col("host") < round(hosts * mix)
    return rows.withColumn("value", F.when(is_slow, base * slow).otherwise(base) * F.exp(F.when(is_slow, 0.5).otherwise(0.2) * normal(seed, F.col("host"), F.col("i"))))


def with_incidents(series: DataFrame, *, count: int, length: int = 5, magnitude: float = 5.0, n: int, value: str = "p50", seed: int = 11) -> DataFrame:
    """``incident`` marks ``count`` stretches, in which the value is larger by ``magnitude`` spreads of noise."""
    hit = F.lit(False)
    for k in range(count):
        start = F.floor(uniform(seed + k, F.lit(k)) * (n - length)).cast("long")
        hit = hit | F.col("t").between(start, start + length - 1)
    return series.withColumn("incident", hit).withColumn(value, F.col(value) + F.when(hit, magnitude).otherwise(0.0))


def impaired(frames: DataFrame, *, seed: int = 12, late: float = 0.1, most_late: int = 3, twice: float = 0.05, at: str = "arrival", key: str = "frame_id", skew: dict[str, float] | None = None, emitter: str = "emitter", cut_off: tuple[str, float, float] | None = None) -> DataFrame:
    """Frames delivered late, out of order and sometimes twice; by clocks that run ahead by ``skew`` of each emitter; and,
    with ``cut_off`` (emitter, from, to), held back while the emitter can't be reached and then all delivered at the
    end of that, in any order (``__shuffle`` breaks ties of arrival)."""
    delay = F.when(uniform(seed, F.col(key)) < late, 1 + F.floor(uniform(seed + 1, F.col(key)) * most_late)).otherwise(0)
    moved = frames.withColumn(at, F.col(at) + delay)
    for name, ahead in (skew or {}).items():
        moved = moved.withColumn(at, F.when(F.col(emitter) == name, F.col(at) + ahead).otherwise(F.col(at)))
    if cut_off:
        name, start, end = cut_off
        held = (F.col(emitter) == name) & (F.col(at) >= start) & (F.col(at) < end)
        moved = moved.withColumn("__shuffle", F.when(held, uniform(seed + 3, F.col(key))).otherwise(0.0)).withColumn(at, F.when(held, F.lit(end)).otherwise(F.col(at)))
    return moved.unionByName(moved.where(uniform(seed + 2, F.col(key)) < twice))
