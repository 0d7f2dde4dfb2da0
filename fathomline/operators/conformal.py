"""Quantile sketches, conformal bands and adaptive miscoverage control."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import array_median, let

LEAST_ALPHA = 1e-6


def sketch_bins(df: DataFrame, keys: list[str], value: str, accuracy: float = 0.01, weight: Column | None = None) -> DataFrame:
    """(keys, sign, bin, weight): logarithmic bins of relative error ``accuracy``; merging is summing the weights."""
    gamma = (1 + accuracy) / (1 - accuracy)
    sign = F.signum(value).cast("int")
    bin_ = F.when(sign == 0, 0).otherwise(F.ceil(F.log(F.greatest(F.abs(F.col(value)), F.lit(5e-324))) / math.log(gamma))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, sign.alias("sign"), bin_.alias("bin")).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("weight"))


def merged_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys, "sign", "bin").agg(F.sum("weight").alias("weight"))


def sketch_quantile(bins: DataFrame, keys: list[str], q: float, accuracy: float = 0.01) -> DataFrame:
    """(keys, quantile) of bins: the middle of the first bin past rank q * (total - 1); no positive weight, no row."""
    return sketch_quantile_at(bins.withColumn("level", F.lit(q)), keys, accuracy)


def ring_weights(buckets: DataFrame, bucket: str, *, capacity: int, decay: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """The newest ``capacity`` buckets, each weighing decay to the power of its age."""
    part = Window.partitionBy(*(keys or []))
    rows = buckets.withColumn("__r", F.row_number().over(part.orderBy(F.col(bucket).desc())))
    rows = rows.where(F.col("__r") <= capacity).drop("__r")
    return rows.withColumn("weight", F.pow(F.lit(decay), (F.max(bucket).over(part) - F.col(bucket)).cast("double")))


def masked(weights: DataFrame, bucket: str, incidents: list[tuple[int, int]], factor: float = 0.0) -> DataFrame:
    """Weights of buckets in an incident's interval multiplied by ``factor``; reversible, nothing is deleted."""
    hit = F.lit(False)
    for a, b in incidents:
        hit = hit | F.col(bucket).between(a, b)
    return weights.withColumn("weight", F.when(hit, F.col("weight") * factor).otherwise(F.col("weight")))


def effective_n(weights: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    return weights.groupBy(*keys).agg(F.sum(F.col("weight") * F.col(n)).alias("effective_n"))


def split_radius(bins: DataFrame, sizes: DataFrame, keys: list[str], alpha: float, accuracy: float = 0.01) -> DataFrame:
    """(keys, n, level, radius): the quantile at ceil((n+1)(1-alpha))/n, widened by the sketch's error; infinite if the
    level is over 1. ``bins`` carry weights; ``sizes`` (keys, n) count only buckets of positive weight."""
    level = F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n")
    levels = sizes.withColumn("level", level)
    low = bins.join(levels.where("level <= 1").select(*keys, "level"), keys) if keys else bins.crossJoin(levels.where("level <= 1").select("level"))
    q = sketch_quantile_at(low, keys, accuracy)
    joined = levels.join(q, keys, "left") if keys else levels.join(q, F.lit(True), "left")  # one row by one row
    return joined.withColumn("radius", F.when(F.col("level") > 1, F.lit(float("inf"))).otherwise(F.col("quantile") + accuracy * F.abs("quantile"))).drop("quantile")


def sketch_quantile_at(bins: DataFrame, keys: list[str], accuracy: float) -> DataFrame:
    """As ``sketch_quantile`` with the level in a column."""
    gamma = (1 + accuracy) / (1 - accuracy)
    part = Window.partitionBy(*keys)
    position = F.col("sign") * F.when(F.col("sign") == 0, 0).otherwise(F.col("bin") + F.lit(100_000))
    rows = bins.where("weight > 0").withColumn("__p", position)
    rows = rows.withColumn("__c", F.sum("weight").over(part.orderBy("__p"))).withColumn("__t", F.sum("weight").over(part))
    first = rows.where(F.col("__c") > F.col("level") * (F.col("__t") - 1)).groupBy(*keys).agg(F.min_by(F.struct("sign", "bin"), "__p").alias("s")).where("s is not null")
    middle = F.col("s.sign") * 2 * F.pow(F.lit(gamma), F.col("s.bin").cast("double")) / (gamma + 1)
    return first.select(*keys, F.when(F.col("s.sign") == 0, 0.0).otherwise(middle).alias("quantile"))


def rolling_mad(df: DataFrame, keys: list[str], order: str, value: str, span: int = 64) -> DataFrame:
    """``mad``: median absolute deviation of the last ``span`` values, the current one included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(span - 1), Window.currentRow)
    rows = df.withColumn("__v", F.collect_list(value).over(w))
    med = array_median(F.col("__v"))
    return rows.withColumn("mad", array_median(F.transform("__v", lambda v: F.abs(v - med)))).drop("__v")


def mad_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sigma by the median absolute deviation of all values of a key, with two exact percentiles."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    off = df.join(med, keys) if keys else df.crossJoin(med)
    return off.groupBy(*keys).agg((F.percentile(F.abs(F.col(value) - F.col("__m")), F.lit(0.5)) / 0.6745).alias("sigma"))


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, span: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(span - 1), Window.currentRow)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def constant_band(train: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return train.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("q_lo"), F.col("q")[1].alias("q_hi"))


def window_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def adaptive_alphas(df: DataFrame, keys: list[str], order: str, miss: str, *, target: float, gamma: float, most: float = 0.999) -> DataFrame:
    """(keys, alphas): adaptive conformal inference, alpha += gamma * (target - miss), clipped, after each row in order."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.col(miss).cast("double").alias("__e")))).alias("__r"))
    start = F.array(F.lit(float(target)))

    def step(a: Column, r: Column) -> Column:
        new = F.element_at(a, -1) + gamma * (target - r["__e"])
        return F.concat(a, F.array(F.least(F.greatest(new, F.lit(LEAST_ALPHA)), F.lit(most))))

    return rows.select(*keys, F.aggregate("__r", start, step, lambda a: F.slice(a, 2, F.size(a) - 1)).alias("alphas"))


def _expert_radius(held: Column, n: Column, alpha: Column) -> Column:
    """The held-out quantile at ceil((n+1)(1-alpha))/n, between the two nearest values; infinite beyond the largest."""

    def at(place: Column) -> Column:
        low = F.floor(place).cast("int")
        below = F.get(held, low)
        return below + (F.get(held, F.least(low + 1, (n - 1).cast("int"))) - below) * (place - low)

    return let(F.ceil((n + 1) * (1 - alpha)) / n, lambda level: F.when((n == 0) | (level > 1), F.lit(float("inf"))).otherwise(at(level * (n - 1))))


def tuned_alphas(df: DataFrame, keys: list[str], order: str, score: str, *, target: float, interval: int, calibration: int, gammas: tuple[float, ...] = (0.002, 0.008, 0.032, 0.128), most: float = 0.999) -> DataFrame:
    """(keys, order, alpha) after each score past the first ``calibration`` of a key, whose quantiles give the radii.

    Dynamically tuned adaptive conformal inference (Gibbs and Candes, 2022) as one ordered fold: experts, one for each
    step size, each follow their own misses; the answer is their mean, weighed by how small their pinball losses were,
    every weight kept above a fixed share. A loss of an infinite radius says nothing and leaves its expert's weight."""
    k, tau = len(gammas), 1 - target
    share, rate = 1 / (2 * interval), math.sqrt(3 / interval * (math.log(k * interval) + 2)) / (target * tau)
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, score))).alias("__r"))
    rows = rows.select(*keys, F.slice("__r", F.lit(calibration + 1), F.greatest(F.size("__r") - calibration, F.lit(0))).alias("__r"), F.sort_array(F.slice("__r", 1, calibration)[score].cast("array<double>")).alias("__held"))
    experts = F.array(*[F.struct(F.lit(g).alias("step"), F.lit(float(target)).alias("alpha"), F.lit(1 / k).alias("weight")) for g in gammas])
    steps = F.array().cast(f"array<struct<at: {dict(df.dtypes)[order]}, alpha: double>>")

    def clipped(a: Column) -> Column:
        return F.least(F.greatest(a, F.lit(LEAST_ALPHA)), F.lit(most))

    def seen(e: Column, over: Column) -> Column:
        """An expert after a score that was ``over`` its radius (or under it, negative)."""
        loss = F.greatest(tau * over, (tau - 1) * over)
        kept = F.when(F.abs(loss) < F.lit(float("inf")), F.exp(-rate * loss)).otherwise(1.0)
        missed = F.when(over > 0, 1.0).otherwise(0.0)
        return F.struct(e["step"].alias("step"), clipped(e["alpha"] + e["step"] * (target - missed)).alias("alpha"), (e["weight"] * kept).alias("weight"))

    def step(s: Column, r: Column) -> Column:
        held, n = F.col("__held"), F.size("__held").cast("double")
        after = F.transform(s["experts"], lambda e: let(r[score].cast("double") - _expert_radius(held, n, e["alpha"]), lambda over: seen(e, over)))

        def shared(s: Column) -> Column:
            weight = lambda e: (1 - share) * F.when(s["total"] > 0, e["weight"] / s["total"]).otherwise(1 / k) + share / k
            return F.transform(s["after"], lambda e: F.struct(e["step"].alias("step"), e["alpha"].alias("alpha"), weight(e).alias("weight")))

        def answered(experts: Column) -> Column:
            mean = F.aggregate(experts, F.lit(0.0), lambda t, e: t + e["weight"] * e["alpha"])
            return F.struct(experts.alias("experts"), F.concat(s["out"], F.array(F.struct(r[order].alias("at"), clipped(mean).alias("alpha")))).alias("out"))

        summed = let(after, lambda a: F.struct(a.alias("after"), F.aggregate(a, F.lit(0.0), lambda t, e: t + e["weight"]).alias("total")))
        return let(let(summed, shared), answered)

    folded = rows.select(*keys, F.aggregate("__r", F.struct(experts.alias("experts"), steps.alias("out")), step, lambda s: s["out"]).alias("__o"))
    return folded.select(*keys, F.explode("__o").alias("__o")).select(*keys, F.col("__o.at").alias(order), F.col("__o.alpha").alias("alpha"))


class Forecaster(Protocol):
    """What a band needs of a forecaster: fit a series in order, then say the band of coming steps."""

    def fit(self, y: np.ndarray) -> None: ...

    def band(self, steps: int) -> tuple[np.ndarray, np.ndarray]: ...


class Constant:
    """The quantiles of what was seen, the same at all times."""

    def __init__(self, alpha: float = 0.1):
        self.alpha = alpha

    def fit(self, y: np.ndarray) -> None:
        self.low, self.high = np.quantile(y, [self.alpha / 2, 1 - self.alpha / 2])

    def band(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full(steps, self.low), np.full(steps, self.high)


def _responses(y: np.ndarray, period: int, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors, states) of additive smoothing for pairs of rates at once, as (pairs, steps, start) and (pairs, state,
    start): errors and last states are linear in the start, so the last column starts from nothing and sees ``y``, and
    each other sees nothing and starts with one of level and seasons at 1."""
    wide = period + 2
    level, season = np.zeros((len(rates), wide)), np.zeros((len(rates), period, wide))
    level[:, 0], season[:, range(period), range(1, period + 1)] = 1, 1
    out = np.empty((len(rates), len(y), wide))
    a, g = rates[:, :1], rates[:, 1:]
    for t, v in enumerate(y):
        e = -level - season[:, t % period]
        e[:, -1] += v
        out[:, t] = e
        level = level + a * e
        season[:, t % period] += g * e
    return out, np.concatenate([level[:, None], season], axis=1)


def holt_winters(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(fitted, season, level, rates) of additive seasonal smoothing without trend: the two rates and the start that leave
    the least squared error. For given rates the best start is a linear least-squares problem; the rates are searched
    on a grid that is drawn closer around its best point."""
    low, high, best = np.zeros(2), np.ones(2), None
    for size in (7, 7, 7, 7):
        axes = [np.linspace(a, b, size) for a, b in zip(low, high, strict=True)]
        rates = np.array([(a, g) for a in axes[0] for g in axes[1] if a + g <= 1 + 1e-12])
        errors, states = _responses(y, period, rates)
        for k, r in enumerate(rates):
            start = np.linalg.lstsq(-errors[k, :, :-1], errors[k, :, -1], rcond=None)[0]
            rest = errors[k] @ np.append(start, 1.0)
            if best is None or rest @ rest < best[0] * (1 - 1e-12):
                best = (float(rest @ rest), rest, states[k] @ np.append(start, 1.0), r)
        step = (high - low) / (size - 1)
        low, high = np.clip(best[3] - step, 0, 1), np.clip(best[3] + step, 0, 1)
    _, rest, state, rates = best
    return y - rest, state[1:], float(state[0]), rates


class Seasonal:
    """Seasonal smoothing, widened by quantiles of all its errors in training. Refuses under two seasons."""

    def __init__(self, period: int = 168, alpha: float = 0.1):
        self.period, self.alpha = period, alpha

    def fit(self, y: np.ndarray) -> None:
        if len(y) < 2 * self.period:
            raise ValueError(f"{len(y)} values are less than two seasons of {self.period}")
        fitted, self.season, self.level, _ = holt_winters(y, self.period)
        self.n, self.off = len(y), np.quantile(y - fitted, [self.alpha / 2, 1 - self.alpha / 2])

    def band(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        mean = self.level + self.season[(self.n + np.arange(steps)) % self.period]
        return mean + self.off[0], mean + self.off[1]


def forecast_bands(df: DataFrame, keys: list[str], order: str, value: str, make: Callable[[], Forecaster], *, train: int) -> DataFrame:
    """(keys, order, y, q_lo, q_hi) past the first ``train`` rows of each key by any forecaster; a key that it refuses gets
    no rows. A key's series is one task's: a series of values is small beside the rows it was folded from."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rest, forecaster = pdf.iloc[train:], make()
        try:
            forecaster.fit(pdf[value].to_numpy(float)[:train])
            low, high = forecaster.band(len(rest))
        except ValueError:
            rest, low, high = rest.iloc[:0], np.empty(0), np.empty(0)
        return pd.DataFrame({**{k: rest[k] for k in keys}, order: rest[order], "y": rest[value].astype(float), "q_lo": low, "q_hi": high})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{order}` {kinds[order]}", "y double, q_lo double, q_hi double"])
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def seasonal_band(df: DataFrame, keys: list[str], order: str, value: str, *, period: int = 168, train: int, alpha: float = 0.1) -> DataFrame:
    return forecast_bands(df, keys, order, value, lambda: Seasonal(period, alpha), train=train)


def provenance(buckets: DataFrame, keys: list[str], bucket: str, decay: float, n: str = "n") -> DataFrame:
    """(keys, provenance): which buckets with which weights a quantile rests on, of how many values, oldest first; those
    of no weight or no value take no part."""
    used = buckets.where((F.col("weight") > 0) & (F.col(n) > 0))
    rows = used.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(bucket, "weight"))).alias("b"), F.sum(F.col("weight") * F.col(n)).alias("e"))
    return rows.select(*keys, F.struct(F.col(f"b.{bucket}").alias("buckets"), F.col("b.weight").alias("weights"), F.col("e").alias("effective_n"), F.lit("bucket_local").alias("tier"), F.lit(float(decay)).alias("decay")).alias("provenance"))


def paired_seeds(experiment: str, n: int) -> list[tuple[int, int]]:
    """(window seed, draw seed) of ``n`` runs of an experiment: every policy compared under its name gets the same."""
    if n < 0:
        raise ValueError("a negative number of runs")
    seed = lambda k, branch: int.from_bytes(hashlib.sha256(f"{experiment}\0{k}\0{branch}".encode()).digest()[:8], "big")
    return [(seed(k, "window"), seed(k, "draw")) for k in range(n)]


def coverage(df: DataFrame, keys: list[str], score: str, radius: str, width: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(score) <= F.col(radius)).cast("int")).alias("coverage"), F.percentile(width, F.lit(0.5)).alias("median_width"), F.count("*").alias("n"))
