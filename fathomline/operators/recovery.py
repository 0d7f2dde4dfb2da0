"""Sparse recovery of residuals from a sketch: one solve for each (view, window), spread over the cluster.

numpy only inside a grouped map; the sketch arrives as (bucket, y) rows and the dictionary as rows of many series each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import hashing


#: Standard deviations by which a group must stand out, and the part of the buckets that a plain support may take before
#: groups are looked at. Fixed values.
STANDS_OUT, CONTEXT = 6.0, 5
#: Rows that a dictionary is dealt out to, so that none grows beyond what a row can hold. Fixed value.
PARTS = 64


@dataclass
class Options:
    #: L1 weight: absolute if positive, else a share of the largest correlation.
    weight: float = 0.0
    weight_share: float = 0.05
    most_steps: int = 350
    #: Coefficients beyond this count as found.
    threshold: float = 1.0
    #: Relative residual above which groups of series are tried.
    escalate: float = 0.3
    rounds: int = 3
    ridge: float = 1e-6


@dataclass
class Solution:
    values: np.ndarray
    support: np.ndarray
    residual: float
    steps: int
    fallback: bool
    grouped: bool


class Columns:
    """The measurement matrix, from bucket and sign arrays of shape (series, d). Held by hash, as places in a list of the
    m buckets and after them the same buckets with the other sign."""

    def __init__(self, buckets: np.ndarray, signs: np.ndarray, m: int):
        self.at = np.ascontiguousarray((buckets + m * (signs < 0)).T, np.intp)
        self.m, self.value = m, 1 / np.sqrt(buckets.shape[1])

    def __len__(self) -> int:
        return self.at.shape[1]

    def forward(self, x: np.ndarray) -> np.ndarray:
        both = sum(np.bincount(k, x, 2 * self.m) for k in self.at)
        return self.value * (both[: self.m] - both[self.m :])

    def back(self, r: np.ndarray) -> np.ndarray:
        both = self.value * np.concatenate([r, -r])
        out = both[self.at[0]]
        for k in self.at[1:]:
            out += both[k]
        return out

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.m, len(rows)))
        for k in self.at[:, rows]:
            np.add.at(out, (k % self.m, np.arange(len(rows))), np.where(k < self.m, self.value, -self.value))
        return out

    def overlaps(self, rows: np.ndarray) -> np.ndarray:
        """``dense(rows) @ dense(rows).T`` of shape (m, m), without the dense form."""
        out = np.zeros(self.m * self.m)
        at = self.at[:, rows]
        for i in at:
            for j in at:
                out += np.bincount(i % self.m * self.m + j % self.m, np.where((i < self.m) == (j < self.m), 1.0, -1.0), len(out))
        return out.reshape(self.m, self.m) * self.value**2

    def lipschitz(self, steps: int = 30, seed: int = 1) -> float:
        """Largest eigenvalue of the normal matrix, by power iteration."""
        x = np.random.default_rng(seed).normal(size=len(self))
        top = 1.0
        for _ in range(steps):
            x /= np.linalg.norm(x) or 1.0
            y = self.back(self.forward(x))
            top, x = float(x @ y), y
        return max(top, 1e-12) * 1.01


def shrunk(a: Columns, y: np.ndarray, weight: float, most: int) -> tuple[np.ndarray, int]:
    """Least squares with an L1 weight by accelerated proximal steps that restart when the objective grows."""
    step = 1 / a.lipschitz()
    x = z = np.zeros(len(a))
    t, last, flat = 1.0, np.inf, 0
    for n in range(1, most + 1):
        g = z - step * a.back(a.forward(z) - y)
        new = np.sign(g) * np.maximum(np.abs(g) - step * weight, 0)
        tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / tn * (new - x), new, tn
        if n % 5 == 0:
            value = 0.5 * float(((a.forward(x) - y) ** 2).sum()) + weight * float(np.abs(x).sum())
            if value > last * (1 + 1e-6):
                z, t = x, 1.0
            flat = flat + 1 if abs(last - value) <= 1e-6 * max(abs(last), 1e-12) else 0
            last = value
            if flat >= 5:
                break
    return x, n


def refit(a: Columns, y: np.ndarray, support: np.ndarray, ridge: float) -> np.ndarray:
    """Least squares on the support alone, which takes the L1 weight's pull off the values. A support of more series than
    buckets is solved by bucket: D' (D D' + ridge)^-1 y is the same as (D' D + ridge)^-1 D' y and has m unknowns."""
    x = np.zeros(len(a))
    if len(support) > a.m:
        x[support] = a.back(np.linalg.solve(a.overlaps(support) + ridge * np.eye(a.m), y))[support]
    elif len(support):
        d = a.dense(support)
        x[support] = np.linalg.solve(d.T @ d + ridge * np.eye(len(support)), d.T @ y)
    return x


def capped(x: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Where |x| is over the threshold, the ``most`` largest of them; of series with the same buckets, which can't be told
    apart, the first."""
    found = np.flatnonzero(np.abs(x) > threshold)
    if len(found) > most:
        found = found[np.argsort(-np.abs(x[found]), kind="stable")[:most]]
    return np.sort(found)


def _noise(a: Columns, r: np.ndarray) -> float:
    return float(np.linalg.norm(r) / np.sqrt(a.m))


def by_groups(a: Columns, y: np.ndarray, groups: np.ndarray, support: np.ndarray, o: Options) -> tuple[np.ndarray, list[int]]:
    """(support, groups added): whole groups whose correlation with what is unexplained stands out of noise, at most
    ``o.rounds``. Of a group the rows that aren't in yet are scored; it must beat its threshold, which is lower for many
    rows, by more than any other. In the first round only groups of sqrt(m) series or more are looked at."""
    _, groups = np.unique(groups, return_inverse=True)
    sizes, added = np.bincount(groups), []
    for k in range(o.rounds):
        r = y - a.forward(refit(a, y, support, o.ridge))
        sigma = _noise(a, r)
        if sigma == 0:
            break
        fresh = np.ones(len(groups), bool)
        fresh[support] = False
        n = np.bincount(groups[fresh], minlength=len(sizes))
        power = np.bincount(groups[fresh], a.back(r)[fresh] ** 2, len(sizes))
        some = np.maximum(n, 1)
        excess = np.sqrt(power / some) - sigma * (1 + STANDS_OUT / np.sqrt(2 * some))
        excess[(n == 0) | (sizes < (max(2, int(np.sqrt(a.m))) if k == 0 else 1))] = 0
        best = int(excess.argmax())
        if excess[best] <= 0:
            break
        added.append(best)
        support = np.union1d(support, np.flatnonzero(groups == best))
    return support, added


def group_score(a: Columns, y: np.ndarray, members: np.ndarray, o: Options) -> float:
    """How many standard deviations a group's correlation with what a plain solve leaves is above noise; 0 for no members
    or a perfect fit."""
    if not len(members) or not len(a):
        return 0.0
    support = plain_support(a, y, o, a.m // CONTEXT)[0]
    r = y - a.forward(refit(a, y, support, o.ridge))
    sigma = _noise(a, r)
    if sigma == 0:
        return 0.0
    return float((np.sqrt((a.back(r)[members] ** 2).mean()) - sigma) / (sigma / np.sqrt(2 * len(members))))


def plain_support(a: Columns, y: np.ndarray, o: Options, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(support of at most ``most`` series, coefficients, steps) of the solve without groups."""
    weight = o.weight if o.weight > 0 else o.weight_share * float(np.abs(a.back(y)).max())
    raw, steps = shrunk(a, y, weight, o.most_steps)
    return capped(raw, o.threshold, most), raw, steps


def recover_groups(a: Columns, y: np.ndarray, groups: np.ndarray, o: Options) -> Solution:
    """A solve that goes to groups at once, from a wider plain support than escalation starts with."""
    if not len(a):
        return Solution(np.zeros(0), np.empty(0, int), 1.0, 0, True, False)
    plain, _, steps = plain_support(a, y, o, a.m // CONTEXT)
    support, added = by_groups(a, y, groups, plain, o)
    x = refit(a, y, support, o.ridge)
    return Solution(x, support, float(np.linalg.norm(y - a.forward(x)) / (np.linalg.norm(y) or 1.0)), steps, False, bool(added))


def recover(a: Columns, y: np.ndarray, groups: np.ndarray | None, o: Options) -> Solution:
    n = len(a)
    size = float(np.linalg.norm(y))
    if not n or not size:
        return Solution(np.zeros(n), np.empty(0, int), 0.0, 0, False, False)
    most = max(1, a.m // 10)
    support, raw, steps = plain_support(a, y, o, most)
    wide = int((np.abs(raw) > o.threshold).sum()) > most
    x = refit(a, y, support, o.ridge)
    residual = float(np.linalg.norm(y - a.forward(x))) / size
    grouped = False
    if groups is not None and (residual > o.escalate or wide):
        more, _ = by_groups(a, y, groups, support, o)
        x2 = refit(a, y, more, o.ridge)
        again = float(np.linalg.norm(y - a.forward(x2))) / size
        if again < residual:
            x, support, residual, grouped = x2, more, again, True
    return Solution(x, support, residual, steps, residual > o.escalate, grouped)


def recovered(sketches: DataFrame, names: DataFrame, keys: list[str], *, seed: int, m: int, d: int, name: str = "name", group: str | None = None, options: Options | None = None, emitters: int = 0) -> DataFrame:
    """(keys, name, value, residual, fallback, steps): the series found in each window's sketch.

    ``names`` has the view's active series, by those of ``keys`` that it has. Each window is one solve; windows are dealt
    out to as many runs as there are shuffle partitions, and a task holds a run's buckets, its view's dictionary (in
    ``PARTS`` rows) and what one window finds. Windows whose dictionary or sketch is empty find nothing. With ``emitters``
    expected and a ``coverage`` column in ``sketches``, a window that none took part in is not solved.
    """
    o = options or Options()
    kinds = dict(sketches.dtypes)
    shared = [k for k in keys if k in names.columns]
    more = [group] if group else []
    present = sketches.where(F.col("coverage") > 0) if emitters and "coverage" in sketches.columns else sketches
    runs = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    present = present.withColumn("__run", F.pmod(F.hash(*keys), F.lit(runs)))
    columns = hashing.sketch_columns(names.select(*shared, name, *more), name, seed, m, d)
    per_name = columns.groupBy(*shared, name, *more).agg(F.collect_list(F.col("bucket") + F.when(F.col("sign") < 0, m).otherwise(0)).alias("__at"))
    parts = per_name.groupBy(*shared, F.pmod(F.hash(name), F.lit(PARTS)).alias("__part")).agg(F.collect_list(F.struct(F.col(name).alias("name"), "__at", *(F.col(g).alias("group") for g in more))).alias("__book"))
    parts = parts.select(*shared, F.col("__book.name").alias("__names"), F.flatten("__book.__at").alias("__at"), *(F.col("__book.group").alias("__groups") for _ in more))
    used = present.select(*shared, "__run").distinct()
    book = used.join(parts, shared) if shared else parts.crossJoin(F.broadcast(used))
    frames = present.groupBy(*keys, "__run").agg(F.collect_list("bucket").alias("__buckets"), F.collect_list("y").alias("__y"))
    frames = frames.select(*shared, "__run", F.struct(*keys).alias("__window"), "__buckets", "__y")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asked = table.filter(table["__window"].is_valid()).select(["__window", "__buckets", "__y"])
        flat = {c: pc.list_flatten(table[c]).combine_chunks() for c in ("__names", "__at", *(["__groups"] if group else []))}
        if not len(flat["__names"]):
            return
        order = pc.sort_indices(flat["__names"], null_placement="at_start").to_numpy()
        at = flat["__at"].to_numpy().reshape(-1, d)[order]
        a = Columns(at % m, np.where(at < m, 1, -1), m)
        groups = flat["__groups"].dictionary_encode("encode").indices.to_numpy()[order] if group else None
        found = flat["__names"].cast(pa.string())
        del table, at, flat
        for window, buckets, values in zip(*(asked[c] for c in asked.column_names), strict=True):
            y = np.zeros(m)
            y[buckets.values.to_numpy()] = values.values.to_numpy()
            s = recover(a, y, groups, o)
            n = len(s.support)
            same = {c: pa.repeat(window[c], n) for c in keys}
            yield pa.RecordBatch.from_pydict({**same, "name": found.take(pa.array(order[s.support])), "value": pa.array(s.values[s.support], pa.float64()), "residual": pa.array(np.full(n, s.residual)), "fallback": pa.array(np.full(n, s.fallback)), "steps": pa.array(np.full(n, s.steps, np.int32))})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "name string, value double, residual double, fallback boolean, steps int"])
    return frames.unionByName(book, allowMissingColumns=True).groupBy(*shared, "__run").applyInArrow(solve, schema)


def deviations(solves: DataFrame, most_residual: float) -> DataFrame:
    """An event for each series that a gated solve found: the gate first, then one row a series."""
    ok = ~F.coalesce(F.col("fallback"), F.lit(False)) & (F.col("residual") <= most_residual)
    return solves.where(ok).withColumn("substrate", F.lit("deviation")).withColumn("confidence", F.lit("recovered"))
