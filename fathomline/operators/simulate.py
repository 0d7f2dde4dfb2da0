"""Trials of the whole detection path on made-up residuals: how large a jump must be to be found through the sketch.

A trial fills a sketch with noise for some quiet windows, then adds a jump to one series, takes the window's sketch
through the wire's quantization and solves it. Trials are independent rows, so a grid of them spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import frames, hashing
from fathomline.operators import recovery

_FLAGS = ("storm", "in_top_k", "supported", "gated", "recovered", "detected")
_NUMBERS = ("headroom", "value_error", "residual", "spurious", "quiet_sigma")


@dataclass
class Setup:
    series: int = 901
    m: int = 2000
    d: int = 6
    bits: int = 8
    quiet: int = 30
    storm_multiple: float = 3.0
    top_k: int = 50
    threshold: float = 1.0
    most_residual: float = 5.0
    #: L1 weight as kappa * sigma * sqrt(2 ln n) and the gate as c * sqrt(n) * sigma, with sigma from quiet sketches;
    #: none: the fixed share and the fixed gate.
    kappa: float | None = None
    gate: float | None = None


def _columns(setup: Setup, seed: int) -> recovery.Columns:
    """Buckets and signs of made-up series, as the hash of their names would deal them."""
    rng = np.random.default_rng(seed)
    return recovery.Columns(rng.integers(0, setup.m, (setup.series, setup.d)), rng.choice([-1.0, 1.0], (setup.series, setup.d)), setup.m)


def trial(setup: Setup, a: recovery.Columns, noise: float, magnitude: float, rng: np.random.Generator) -> dict:
    """One trial: the target is the last series. Detected means in the heaviest residuals if the window's energy is a
    storm's, since then those are sent, else found by a solve that passes its gate."""
    quiet, sigmas = [], []
    for _ in range(setup.quiet):
        y = a.forward(rng.normal(0, noise, setup.series)) if noise else np.zeros(setup.m)
        quiet.append(float(y @ y) / setup.m)
        sigmas.append(float(np.median(np.abs(y - np.median(y)))) / 0.6745 * np.sqrt(setup.m / setup.series))
    x = rng.normal(0, noise, setup.series) if noise else np.zeros(setup.series)
    x[-1] += magnitude
    y = a.forward(x)
    energy, usual, sigma = float(y @ y) / setup.m, float(np.median(quiet)), float(np.median(sigmas))
    storm = energy > setup.storm_multiple * usual
    scale = float(np.float32(np.abs(y).max() / ((1 << setup.bits - 1) - 1))) or 1e-6
    y = frames.dequantize(frames.quantize(y, setup.bits, scale), setup.bits, scale)
    weight = setup.kappa * sigma * np.sqrt(2 * np.log(setup.series)) if setup.kappa is not None else 0.0
    s = recovery.recover(a, y, None, recovery.Options(threshold=setup.threshold, weight=weight))
    residual = s.residual * float(np.linalg.norm(y))
    most = setup.most_residual if setup.gate is None else setup.gate * np.sqrt(setup.series) * sigma
    supported, gated = bool((s.support == setup.series - 1).any()), residual > most
    in_top_k = int((np.abs(x[:-1]) > abs(x[-1])).sum()) < setup.top_k
    recovered = supported and not gated
    return {
        "storm": storm, "in_top_k": in_top_k, "supported": supported, "gated": gated, "recovered": recovered, "detected": in_top_k if storm else recovered,
        "headroom": energy / (usual * setup.storm_multiple) if usual > 0 else None, "value_error": abs(float(s.values[-1] - x[-1])) if supported else None,
        "residual": residual, "spurious": float(len(s.support) - supported), "quiet_sigma": sigma,
    }


def dead_zone(spark: SparkSession, noises: list[float], magnitudes: list[float], trials: int, setup: Setup | None = None, seed: int = 1) -> DataFrame:
    """A row for each trial of a grid of noises and magnitudes; ``analyze.cell_rates`` and ``analyze.recovery_floor`` sum
    them up. A trial's numbers follow from the seed, its cell and its own number alone."""
    setup = setup or Setup()
    grid = spark.range(len(noises) * len(magnitudes) * trials).select(
        F.array(*map(F.lit, map(float, noises)))[(F.col("id") % len(noises)).cast("int")].alias("noise"),
        F.array(*map(F.lit, map(float, magnitudes)))[(F.floor(F.col("id") / len(noises)) % len(magnitudes)).cast("int")].alias("magnitude"),
        F.floor(F.col("id") / (len(noises) * len(magnitudes))).alias("trial"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _columns(setup, seed)
        for batch in batches:
            rows = [trial(setup, a, n, x, np.random.default_rng([seed, int(n * 1e6), int(x * 1e6), t])) for n, x, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            out = {c: batch.column(k) for k, c in enumerate(("noise", "magnitude", "trial"))}
            out |= {c: pa.array([r[c] for r in rows], pa.bool_()) for c in _FLAGS} | {c: pa.array([r[c] for r in rows], pa.float64()) for c in _NUMBERS}
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(["noise double, magnitude double, trial long", *(f"{c} boolean" for c in _FLAGS), *(f"{c} double" for c in _NUMBERS)])
    return grid.repartition(max(1, min(len(noises) * len(magnitudes) * trials, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def cells(rows: DataFrame) -> DataFrame:
    """(noise, magnitude, trials, rates and means) of trials."""
    rates = [F.avg(F.col(c).cast("int")).alias(f"{c}_rate") for c in _FLAGS]
    return rows.groupBy("noise", "magnitude").agg(F.count("*").alias("trials"), *rates, *[F.avg(c).alias(f"mean_{c}") for c in _NUMBERS])


def quiet_sigmas(sketches: DataFrame, keys: list[str], m: int, active: int, history: int = 30, seq: str = "w") -> DataFrame:
    """(keys, sigma, rolling): the noise of a series by each quiet window's sketch, from the median absolute deviation of
    its ``m`` buckets (those without a row are 0) scaled to ``active`` series, and the median of the last ``history``."""
    from pyspark.sql import Window

    # Buckets without a row stand in the sorted sketch as zeros; they are put in as an array of what is missing.
    full = sketches.groupBy(*keys).agg(F.collect_list("y").alias("__y"))
    full = full.withColumn("__y", F.concat("__y", F.array_repeat(F.lit(0.0), F.lit(m) - F.size("__y"))))
    from fathomline.functions.numeric import median_abs_deviation

    out = full.withColumn("sigma", median_abs_deviation("__y") * float(np.sqrt(m / active))).drop("__y")
    order = Window.partitionBy(*[k for k in keys if k != seq]).orderBy(seq).rowsBetween(-(history - 1), Window.currentRow)
    return out.withColumn("rolling", F.percentile("sigma", F.lit(0.5)).over(order))


def column_table(names: DataFrame, name: str, *, seed: int, m: int, d: int) -> DataFrame:
    """(name, bucket, sign) of every distinct name, to be kept: a sketch or a query then joins it and hashes nothing."""
    return hashing.sketch_columns(names.select(name).distinct(), name, seed, m, d)
