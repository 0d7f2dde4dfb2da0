"""From metric points to series, residuals, keyframes and sketches. Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import hashing, identity, numeric

EXACT, SKETCHED, MERGED = "exact", "sketched", "merged"


def tier(metric: Column, rules: list[tuple[str, str]], kind: Column | None = None) -> Column:
    """Tier of a metric: summaries are exact; else the first rule (pattern found anywhere, tier); else sketched."""
    out = F.lit(SKETCHED)
    for pattern, name in reversed(rules):
        out = F.when(metric.rlike(pattern), name).otherwise(out)
    return F.when(kind == "summary", EXACT).otherwise(out) if kind is not None else out


def passed_on(points: DataFrame, tier_col: str = "tier", shadow: bool = False) -> DataFrame:
    """What goes on downstream: all but sketched points, or everything in shadow mode."""
    return points if shadow else points.where(F.col(tier_col) != SKETCHED)


def flattened_points(samples: DataFrame) -> DataFrame:
    """Gauges, sums and summaries (which ``tier`` sends on as exact) as they are, histograms as a point for each bucket with
    an ``le`` attribute; other kinds go."""
    plain = samples.where(F.col("type").isin("gauge", "sum", "summary")).withColumn("le", F.lit(None).cast("string"))
    bounds = F.concat(F.coalesce("bounds", F.array().cast("array<double>")), F.array(F.lit(float("inf"))))
    buckets = samples.where("type = 'histogram'").withColumn("__b", F.explode(F.arrays_zip(F.col("bucket_counts").alias("c"), bounds.alias("b"))))
    buckets = buckets.where("__b.c is not null").withColumn("value", F.col("__b.c").cast("double")).withColumn("le", identity.bound_label(F.col("__b.b"))).drop("__b")
    return plain.unionByName(buckets.select(plain.columns))


def views(points: DataFrame, names: list[str]) -> DataFrame:
    """A row for each view of each point; no shuffle."""
    return points.withColumn("view", F.explode(F.array(*map(F.lit, names))))


def window_index(ts: Column, seconds: int) -> Column:
    """Index of the window of a time without zone, counted from 1970."""
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / seconds).cast("bigint")


def latest_by_instance(points: DataFrame, keys: list[str], instance: str, order: list[str], value: str = "value") -> DataFrame:
    """The last value of each instance in each window; ties of time are broken by the rest of ``order``."""
    return points.groupBy(*keys, instance).agg(F.max_by(value, F.struct(*order)).alias(value))


def window_fold(points: DataFrame, keys: list[str], instance: str, order: list[str], value: str = "value") -> DataFrame:
    """Sum and maximum of the instances' last values and how many instances there are; the maximum is at least 0."""
    last = latest_by_instance(points, keys, instance, order, value)
    return last.groupBy(*keys).agg(F.sum(value).alias("sum"), F.count("*").alias("count"), F.greatest(F.max(value), F.lit(0.0)).alias("max"))


def logical_series(folded: DataFrame, keys: list[str], group: str) -> DataFrame:
    """A row for each aggregate of each group: (keys, name, value)."""
    pairs = ", ".join(f"'{a}', cast(`{a}` as double)" for a in ("sum", "count", "max"))
    return folded.selectExpr(*[f"`{k}`" for k in keys if k != group], f"`{group}`", f"stack(3, {pairs}) as (agg, value)").withColumn("name", identity.logical_name(F.col(group), F.col("agg"))).drop(group, "agg")


def lifetimes(series: DataFrame, ttl: int, key: list[str], seq: str = "w") -> DataFrame:
    """``life`` numbers a series' lifetimes: a gap of ``ttl`` windows or more starts a new one."""
    order = Window.partitionBy(*key).orderBy(seq)
    born = F.when(F.coalesce(F.col(seq) - F.lag(seq).over(order), F.lit(ttl)) >= ttl, 1).otherwise(0)
    return series.withColumn("__born", born).withColumn("life", F.sum("__born").over(order)).withColumn("birth", F.col("__born") == 1).drop("__born")


def hold_residual(series: DataFrame, every: int, key: list[str], seq: str = "w", value: str = "value") -> DataFrame:
    """``baseline`` and ``residual``: the baseline is the last value that the series had at the last keyframe before,
    seen in the keyframe's window or not, and until the first keyframe its value at birth. Births have no baseline and
    a residual of 0. Expects ``life`` and ``birth`` from ``lifetimes``."""
    life = Window.partitionBy(*key, "life")
    # A value is loaded by the first keyframe at or after it; a row sees the values of all keyframes before its own next.
    rows = series.withColumn("__next", F.ceil(F.col(seq) / every))
    held = F.max_by(value, seq).over(life.orderBy("__next").rangeBetween(Window.unboundedPreceding, -1))
    first = F.first(value).over(life.orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("baseline", F.when(~F.col("birth"), F.coalesce(held, first))).drop("__next")
    return rows.withColumn("residual", F.when(F.col("birth"), 0.0).otherwise(F.col(value) - F.col("baseline")))


def held_until(series: DataFrame, ttl: int, key: list[str], until: int, seq: str = "w") -> DataFrame:
    """``life`` and ``end``: the last window in which a row's value is its series' latest, not after window ``until``. A
    series counts as active until it was silent for ``ttl`` windows."""
    rows = series if "life" in series.columns else lifetimes(series, ttl, key, seq)
    after = F.lead(seq).over(Window.partitionBy(*key).orderBy(seq))
    return rows.withColumn("end", F.least(F.coalesce(after - 1, F.lit(until)), F.col(seq) + (ttl - 1), F.lit(until)))


def keyframe_values(series: DataFrame, every: int, ttl: int, key: list[str], until: int, seq: str = "w", value: str = "value") -> DataFrame:
    """(key, life, seq, value): the last value of every active series at each keyframe, also of silent ones."""
    rows = held_until(series, ttl, key, until, seq).withColumn("__first", F.ceil(F.col(seq) / every) * every)
    rows = rows.where(F.col("__first") <= F.col("end")).withColumn("__k", F.explode(F.sequence("__first", "end", F.lit(every).cast("bigint"))))
    return rows.select(*key, "life", F.col("__k").alias(seq), value)


def active_at_each_window(series: DataFrame, ttl: int, key: list[str], until: int, seq: str = "w") -> DataFrame:
    """Every row once for each window in which its value is its active series' latest; ``seq`` is that window."""
    rows = held_until(series, ttl, key, until, seq).withColumn("__w", F.explode(F.sequence(seq, "end")))
    return rows.drop(seq, "end").withColumnRenamed("__w", seq)


def tombstones(series: DataFrame, ttl: int, key: list[str], until: int | None = None, seq: str = "w") -> DataFrame:
    """(key, last seen, window of the tombstone): series silent for ``ttl`` windows, within the run if ``until`` is given."""
    order = Window.partitionBy(*key).orderBy(seq)
    gaps = series.withColumn("next_seen", F.lead(seq).over(order)).withColumn("tombstone", F.col(seq) + ttl)
    gone = F.col("next_seen") >= F.col("tombstone")
    ended = F.col("next_seen").isNull() & (F.col("tombstone") <= until) if until is not None else F.lit(False)
    return gaps.where(gone | ended).select(*key, F.col(seq).alias("last_seen"), "tombstone")


def keyframe_drift(frames: DataFrame, threshold: float, key: list[str], seq: str = "w", value: str = "value") -> DataFrame:
    """Of ``keyframe_values``, those that moved by more than ``threshold`` since the keyframe before, in one lifetime."""
    moved = frames.withColumn("prev", F.lag(value).over(Window.partitionBy(*key, "life").orderBy(seq)))
    return moved.where(F.abs(F.col(value) - F.col("prev")) > threshold)


def changed_at_keyframes(frames: DataFrame, key: list[str], seq: str = "w", value: str = "value") -> DataFrame:
    """What a delta keyframe carries of ``keyframe_values``: new series, or values that differ as FLOAT from the last keyframe's."""
    order = Window.partitionBy(*key, "life").orderBy(seq)
    frames = frames.withColumn("__f", F.col(value).cast("float")).withColumn("prev", F.lag(F.col(value).cast("float")).over(order))
    return frames.where(F.col("prev").isNull() | (F.col("__f") != F.col("prev"))).drop("__f")


def delta_keyframe_scale(frames: DataFrame, key: list[str], frame: list[str], seq: str = "w", value: str = "value") -> DataFrame:
    """(frame, scale): the step at which the largest change of a keyframe's FLOAT values since the last keyframe fits 16
    bits; a new series counts from 0. ``frame`` says which rows make a keyframe."""
    now = F.col(value).cast("float")
    before = F.coalesce(F.lag(now).over(Window.partitionBy(*key, "life").orderBy(seq)), F.lit(0.0).cast("float"))
    moved = frames.withColumn("__m", F.abs((now - before).cast("double")))
    return moved.groupBy(*frame).agg(numeric.adaptive_scale(F.max("__m"), 16).alias("scale"))


def keyframe_dictionary(active: DataFrame, tombstones: DataFrame, births: DataFrame, golden: Column, seq: str = "w") -> DataFrame:
    """(seq, name, init_value, tombstone) of each keyframe: a golden one announces every active series and then its own
    window's tombstones, any other the window's births and then its tombstones. All three have seq and name, the first
    and the last value."""
    gone = tombstones.select(seq, "name", F.lit(0.0).alias("init_value"), F.lit(True).alias("tombstone"))
    whole = active.where(golden).select(seq, "name", F.col("value").alias("init_value"), F.lit(False).alias("tombstone"))
    new = births.where(~golden).select(seq, "name", F.col("value").alias("init_value"), F.lit(False).alias("tombstone"))
    return whole.unionByName(new).unionByName(gone)


def rotated(series: DataFrame, per_epoch: int, ttl: int, key: list[str], until: int, seq: str = "w", value: str = "value") -> DataFrame:
    """``epoch``, ``epoch_seq`` and ``reborn``: rows of an epoch of ``per_epoch`` windows are counted from its start, and
    every series active just before the rotation is born again in its first window with its last known value, unless
    it has a value there. The first window of an epoch is a golden keyframe."""
    plain = series.withColumn("epoch", F.floor(F.col(seq) / per_epoch)).withColumn("reborn", F.lit(False))
    last = held_until(series, ttl, key, until + 1, seq).withColumn("__start", (F.floor(F.col(seq) / per_epoch) + 1) * per_epoch)
    carried = last.where((F.col("end") >= F.col("__start") - 1) & (F.col("__start") <= until)).select(*key, F.col("__start").alias(seq), value, (F.col("__start") / per_epoch).cast("bigint").alias("epoch"), F.lit(True).alias("reborn"))
    carried = carried.join(plain.select(*key, seq), [*key, seq], "left_anti")
    out = plain.select(*carried.columns).unionByName(carried)
    return out.withColumn("epoch_seq", F.col(seq) - F.col("epoch") * per_epoch)


def sketch(residuals: DataFrame, keys: list[str], *, name: str = "name", residual: str = "residual", seed: int, m: int, d: int) -> DataFrame:
    """(keys, bucket, y): each residual spread over its buckets; buckets without a series aren't stored."""
    return sketch_sum(hashing.sketch_columns(residuals, name, seed, m, d), keys, residual, d)


def sketch_sum(spread: DataFrame, keys: list[str], residual: str, d: int) -> DataFrame:
    return spread.groupBy(*keys, "bucket").agg(F.sum(F.col("sign") * F.col(residual) / F.sqrt(F.lit(float(d)))).alias("y"))


def merged_sketch(sketches: DataFrame, keys: list[str], emitter: str) -> DataFrame:
    """Sum over emitters with how many took part; sketches are linear, so partial sums are exact."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("y").alias("y"), F.count_distinct(emitter).alias("coverage"))


def energy(sketches: DataFrame, keys: list[str], m: int) -> DataFrame:
    return sketches.groupBy(*keys).agg((F.sum(F.col("y") * F.col("y")) / m).alias("energy"))


def point_query(names: DataFrame, sketches: DataFrame, keys: list[str], *, name: str = "name", seed: int, m: int, d: int) -> DataFrame:
    """(keys, name, estimate, error): the median of a series' signed buckets, and the noise level of one bucket."""
    columns = hashing.sketch_columns(names, name, seed, m, d)
    wide = sketches.groupBy(*keys).agg((F.sqrt(F.sum(F.col("y") * F.col("y")) / m)).alias("error"))
    frames = wide.select(*keys, "error")
    asked = columns.join(frames, on=[k for k in keys if k in columns.columns] or None, how="inner" if any(k in columns.columns for k in keys) else "cross")
    found = asked.join(sketches.select(*keys, "bucket", "y"), [*keys, "bucket"], "left")
    estimate = F.percentile(F.col("sign") * F.coalesce("y", F.lit(0.0)) * F.sqrt(F.lit(float(d))), F.lit(0.5))
    return found.groupBy(*keys, name).agg(estimate.alias("estimate"), F.first("error").alias("error"))


def storms(energies: DataFrame, keys: list[str], *, history: int = 30, multiple: float = 3.0, every: int = 6, seq: str = "w") -> DataFrame:
    """``storm``: energy over ``multiple`` times the median of the last ``history`` windows; no history, no storm.
    Keyframe windows take no part."""
    order = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-history, -1)
    rows = energies.where(F.col(seq) % every != 0).withColumn("median", F.percentile("energy", F.lit(0.5)).over(order))
    return rows.withColumn("storm", F.coalesce(F.col("energy") > multiple * F.col("median"), F.lit(False)))


def frame_kinds(energies: DataFrame, keys: list[str], *, golden: int, every: int, history: int = 30, multiple: float = 3.0, seq: str = "w") -> DataFrame:
    """What each window ships: a golden or delta keyframe, a fallback during a storm, else a residual frame."""
    hit = storms(energies, keys, history=history, multiple=multiple, every=every, seq=seq).select(*keys, seq, "storm")
    kind = F.when(F.col(seq) % golden == 0, "golden").when(F.col(seq) % every == 0, "kdelta").when(F.col("storm"), "fallback").otherwise("residual")
    return energies.join(hit, [*keys, seq], "left").withColumn("kind", kind)


def top_residuals(residuals: DataFrame, keys: list[str], k: int, *, order: Column, residual: str = "residual") -> DataFrame:
    """The ``k`` largest residuals of each window, ties by ``order``; ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(residual)).desc(), order)
    return residuals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fallback_totals(active: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum of the last values of all active series and how many there are, of rows as ``active_at_each_window`` gives."""
    return active.groupBy(*keys).agg(F.sum(value).alias("total_sum"), F.count("*").alias("total_count"))


def snapshot_scores(samples: DataFrame, key: list[str], order: list[str], value: str = "value") -> DataFrame:
    """z-score of each sample against the mean and population variance of those before it; without variance it is 0,
    or the largest number with the sign of the deviation. A first sample's is 0."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumn("__m", F.avg(value).over(before)).withColumn("__v", F.var_pop(value).over(before))
    off = F.col(value) - F.col("__m")
    flat = F.when(F.coalesce(off, F.lit(0.0)) == 0, 0.0).otherwise(F.signum(off) * 1.7976931348623157e308)
    return rows.withColumn("z", F.when(F.col("__v") > 0, off / F.sqrt("__v")).otherwise(flat)).drop("__m", "__v")


def lookback(samples: DataFrame, key: list[str], ts: str, minutes: int, value: str = "value") -> DataFrame:
    """How many samples the ring of the last ``minutes`` holds at each sample, and their largest value."""
    frame = f"over (partition by {', '.join(key)} order by {ts} range between interval '{minutes}' minute preceding and current row)"
    return samples.selectExpr("*", f"count(*) {frame} as held", f"max({value}) {frame} as peak")


def staged_snapshots(flagged: DataFrame, keys: list[str], order: list[str], flush: str, most: int, ttl: int) -> DataFrame:
    """(keys, order, flush, shipped): when each staged snapshot goes out. A flush first drops what was staged more than
    ``ttl`` flushes before, then ships the oldest ``most``; the rest waits. ``shipped`` is null for what was dropped.

    How many flushes a snapshot waits depends on what waits before it: with at most ``most`` in a flush and none
    older than ``ttl`` flushes, an ordered fold over each key's flushes carries no more than that many counts."""
    counted = flagged.groupBy(*keys, flush).agg(F.count("*").alias("__n"))
    kind = "array<struct<at: bigint, left: bigint>>"
    zero = F.struct(F.array().cast(kind).alias("queue"), F.lit(None).cast("bigint").alias("now"), F.array().cast("array<struct<at: bigint, shipped: bigint, n: bigint>>").alias("out"))

    def ship(state: Column, now: Column) -> Column:
        """One flush: what is too old goes, then the oldest are shipped."""
        live = F.filter(state["queue"], lambda q: now - q["at"] <= ttl)
        start = F.struct(F.lit(most).cast("bigint").alias("room"), F.array().cast(kind).alias("queue"), state["out"].alias("out"))

        def take(s: Column, q: Column) -> Column:
            n = F.least(s["room"], q["left"])
            rest = F.when(q["left"] > n, F.concat(s["queue"], F.array(F.struct(q["at"].alias("at"), (q["left"] - n).alias("left"))))).otherwise(s["queue"])
            out = F.when(n > 0, F.concat(s["out"], F.array(F.struct(q["at"].alias("at"), now.alias("shipped"), n.alias("n"))))).otherwise(s["out"])
            return F.struct((s["room"] - n).alias("room"), rest.alias("queue"), out.alias("out"))

        return F.aggregate(live, start, take, lambda s: F.struct(s["queue"].alias("queue"), now.alias("now"), s["out"].alias("out")))

    def step(s: Column, r: Column) -> Column:
        at = r[flush].cast("bigint")
        # Flushes without a new snapshot ship what waits; after ``ttl`` of them nothing does.
        idle = F.filter(F.sequence(F.lit(1), F.lit(ttl)), lambda k: s["now"] + k < at)
        caught_up = F.when(s["now"].isNull(), s).otherwise(F.aggregate(idle, s, lambda t, k: ship(t, s["now"] + k)))
        added = F.struct(F.concat(caught_up["queue"], F.array(F.struct(at.alias("at"), r["__n"].alias("left")))).alias("queue"), at.alias("now"), caught_up["out"].alias("out"))
        return ship(added, at)

    def finish(s: Column) -> Column:
        idle = F.sequence(F.lit(1), F.lit(ttl))
        return F.when(s["now"].isNotNull(), F.aggregate(idle, s, lambda t, k: ship(t, s["now"] + k))).otherwise(s)["out"]

    out = ordered_fold(counted, keys, [flush], zero, step, finish, ["__n"], "out")
    runs = out.select(*keys, F.explode("out").alias("o")).select(*keys, F.col("o.at").alias(flush), F.col("o.shipped").alias("shipped"), F.col("o.n").alias("__n"))
    ends = F.sum("__n").over(Window.partitionBy(*keys, flush).orderBy("shipped"))
    runs = runs.withColumn("__to", ends).withColumn("__from", ends - F.col("__n"))
    placed = flagged.withColumn("__p", F.row_number().over(Window.partitionBy(*keys, flush).orderBy(*order)))
    hit = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, flush]] + [F.col("__p") > F.col("__from"), F.col("__p") <= F.col("__to")]
    return placed.alias("a").join(runs.alias("b"), hit, "left").select(*[F.col(f"a.{c}") for c in flagged.columns], "shipped")


def routed(residuals: DataFrame, keys: list[str], name: str, share: float = 0.05, residual: str = "residual") -> DataFrame:
    """The ``share`` of series (rounded up) whose residuals vary most."""
    by = residuals.groupBy(*keys, name).agg(F.var_pop(residual).alias("variance"))
    part = Window.partitionBy(*keys)
    ranked = by.withColumn("rank", F.row_number().over(part.orderBy(F.col("variance").desc(), name))).withColumn("__n", F.count("*").over(part))
    return ranked.where(F.col("rank") <= F.ceil(F.col("__n") * share)).drop("__n")


def birth_rate(births: DataFrame, keys: list[str], ts: str, seconds: int = 60, most: int = 0) -> DataFrame:
    """Births in the last ``seconds`` at each birth, and whether they exceed ``most``."""
    frame = f"over (partition by {', '.join(keys)} order by {ts} range between interval '{seconds}' second preceding and current row)"
    return births.selectExpr("*", f"count(*) {frame} as rate").withColumn("tripped", F.col("rate") > most)


def ordered_fold(df: DataFrame, key: list[str], order: list[str], start: Column, step, finish=None, items: list[str] | None = None, name: str = "folded") -> DataFrame:
    """A recursion over each key's rows in order, for decisions that feed back: the key's rows become one array."""
    rows = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *(items or [])))).alias("__rows"))
    return rows.select(*key, F.aggregate("__rows", start, step, finish).alias(name))


def breaker(births: DataFrame, key: list[str], seq: str, most: int, span: int) -> DataFrame:
    """(key, accepted, rejected, tripped): a birth is rejected while the ``span`` windows up to its own hold ``most``
    accepted births; births are accepted again once old ones are out of that. That it ever rejected one stays known."""
    zero = F.struct(F.array().cast("array<bigint>").alias("recent"), F.lit(0).cast("bigint").alias("ok"), F.lit(0).cast("bigint").alias("no"))

    def step(s: Column, r: Column) -> Column:
        recent = F.filter(s["recent"], lambda x: x >= r[seq] - span)
        full = F.size(recent) >= most
        return F.struct(F.when(full, recent).otherwise(F.concat(recent, F.array(r[seq].cast("bigint")))).alias("recent"), (s["ok"] + F.when(full, 0).otherwise(1)).alias("ok"), (s["no"] + F.when(full, 1).otherwise(0)).alias("no"))

    out = ordered_fold(births, key, [seq], zero, step)
    return out.select(*key, F.col("folded.ok").alias("accepted"), F.col("folded.no").alias("rejected"), (F.col("folded.no") > 0).alias("tripped"))


def frame_sizes(frames: DataFrame) -> DataFrame:
    """``encoded_size`` of frames: the fixed part, 15 bytes and the name for each dictionary entry, blob and payload."""
    entries = F.aggregate(F.coalesce("dict_deltas", F.array().cast("array<struct<id: bigint, flags: smallint, init_value: float, name: string>>")), F.lit(0), lambda n, e: n + 15 + F.octet_length(F.coalesce(e["name"], F.lit(""))))
    return frames.withColumn("encoded_size", F.lit(78) + entries + F.coalesce(F.octet_length("snapshot_blob"), F.lit(0)) + F.coalesce(F.octet_length("payload"), F.lit(0)))


def cadence_drift(values: DataFrame, key: list[str], every: int, threshold: float, seq: str = "w", value: str = "value", calm: int = 3) -> DataFrame:
    """Drift on a cadence of its own: each ``every``-th window against a reference, the value on that cadence before,
    which freezes as ``frozen_references`` says."""
    return frozen_references(values.where(F.col(seq) % every == 0), key, seq, value, threshold, calm).where("out")


def frozen_references(values: DataFrame, key: list[str], seq: str, value: str, threshold: float, calm: int = 3) -> DataFrame:
    """(key, w, value, reference, out): the reference that each value is held against. A value beyond ``threshold``
    freezes the reference; after ``calm`` values in a row within it, it follows again. Decisions feed back, so the rows
    are folded in order."""
    kind = "array<struct<w: bigint, value: double, reference: double, out: boolean>>"
    zero = F.struct(F.lit(None).cast("double").alias("ref"), F.lit(False).alias("frozen"), F.lit(0).alias("calm"), F.array().cast(kind).alias("steps"))

    def step(s: Column, r: Column) -> Column:
        v = r[value].cast("double")
        ref = F.coalesce(s["ref"], v)
        out = F.abs(v - ref) > threshold
        quiet = F.when(out, 0).otherwise(s["calm"] + 1)
        frozen = out | (s["frozen"] & (quiet < calm))
        row = F.struct(r[seq].cast("bigint").alias("w"), v.alias("value"), ref.alias("reference"), out.alias("out"))
        return F.struct(F.when(frozen, ref).otherwise(v).alias("ref"), frozen.alias("frozen"), quiet.alias("calm"), F.concat(s["steps"], F.array(row)).alias("steps"))

    out = ordered_fold(values, key, [seq], zero, step, lambda s: s["steps"], [value], "steps")
    return out.select(*key, F.explode("steps").alias("__s")).select(*key, "__s.*")


def active_values(series: DataFrame, key: list[str], seq: str, value: str, at: int, ttl: int) -> DataFrame:
    """The last value of each series that isn't expired at window ``at``."""
    last = series.where(F.col(seq) <= at).groupBy(*key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias("last_seen"))
    return last.where(at - F.col("last_seen") < ttl)


def hinted(points: DataFrame, group: Column, name: str = "logical_series") -> DataFrame:
    """Points with the name of the logical series that they go into, to drill down from."""
    return points.withColumn(name, group)


def instance_samples(samples: DataFrame, group: str, wanted: str, ts: str, since: Column) -> DataFrame:
    """The samples of one group's instances from ``since`` on: what a pull for a drill-down gets."""
    return samples.where((F.col(group) == wanted) & (F.col(ts) >= since))


def instance_buffers(samples: DataFrame, group: list[str], instance: str, order: list[Column], *, most_instances: int, most_samples: int) -> DataFrame:
    """(group, instance, held): each instance's newest ``most_samples`` rows, of the ``most_instances`` instances of a
    group that were seen first. ``order`` are the columns that order samples in time."""
    first = samples.groupBy(*group, instance).agg(F.min(F.struct(*order)).alias("__first"))
    seen = first.withColumn("__i", F.row_number().over(Window.partitionBy(*group).orderBy("__first", instance))).where(F.col("__i") <= most_instances)
    newest = Window.partitionBy(*group, instance).orderBy(*[c.desc() for c in order])
    return samples.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most_samples).join(seen.select(*group, instance), [*group, instance], "left_semi")


def shard(labels: dict[str, Column]) -> Column:
    """The shard of a point: the hash of its ``k=v`` labels, 0 if none are configured."""
    return hashing.series_id(identity.joined_labels(labels)) if labels else F.lit(0).cast("bigint")


def request_bytes(series: DataFrame, labels: list[str], value: str, ts_ms: str) -> Column:
    """Bytes that each series takes in a remote-write request: labels by name and value, a value and a time, each part
    with its tag and length."""

    def framed(n: Column) -> Column:
        return n + varint_bytes(n) + 1

    pairs = [F.lit(len(k)) + varint_bytes(F.lit(len(k))) + 1 + framed(F.octet_length(F.col(k).cast("string"))) for k in labels]
    sample = F.lit(9 + 1) + varint_bytes(F.col(ts_ms))
    total = framed(sample)
    for p in pairs:
        total = total + framed(p)
    return framed(total)


def varint_bytes(n: Column) -> Column:
    """Bytes of a number of seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n.cast("bigint"))) / 7)).cast("int")


def integrated(sampled: DataFrame, every: int, until: int, per_day: int, seq: str = "w", size: str = "bytes") -> DataFrame:
    """(day, bytes): sizes of every ``every``-th window stand for the windows up to the next one, day by day."""
    rows = sampled.where(F.col(seq) % every == 0).withColumn("__w", F.explode(F.sequence(F.col(seq), F.least(F.col(seq) + (every - 1), F.lit(until).cast("bigint")))))
    return rows.groupBy(F.floor(F.col("__w") / per_day).alias("day")).agg(F.sum(size).alias("bytes"))
