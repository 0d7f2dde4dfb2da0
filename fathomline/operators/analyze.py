"""From frames to events, and events against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def late_epochs_dropped(frames: DataFrame, emitter: str, arrival: list[str], epoch: str = "epoch") -> DataFrame:
    """Frames of an epoch that their emitter had already left when they arrived go."""
    order = Window.partitionBy(emitter).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("__top", F.max(epoch).over(order)).where(F.col(epoch) >= F.col("__top")).drop("__top")


def contributors_once(frames: DataFrame, window: list[str], emitter: str, arrival: list[Column]) -> DataFrame:
    """The first arrival of each emitter in each window."""
    first = F.row_number().over(Window.partitionBy(*window, emitter).orderBy(*arrival))
    return frames.withColumn("__n", first).where("__n = 1").drop("__n")


def degraded_dropped(frames: DataFrame, view: list[str], order: list[str], degrades: str, heals: str, residual: str) -> DataFrame:
    """Residual frames go while their view is degraded: from a row that ``degrades`` until after one that ``heals``."""
    before = Window.partitionBy(*view).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col(degrades), True).when(F.col(heals), False), ignorenulls=True).over(before)
    return frames.withColumn("__d", F.coalesce(state, F.lit(False))).where(~(F.col("__d") & F.col(residual))).drop("__d")


def clock_skew(frames: DataFrame, view: list[str], window: str, emitter: list[str], at: str, order: list[str], tolerance: float) -> DataFrame:
    """Frames that arrive more than ``tolerance`` after the first frame of their view's window, with ``skew``, where the
    emitter's frame before did not. First frames of a window set the time and tell nothing about their emitter."""
    part = Window.partitionBy(*view, window)
    rows = frames.withColumn("__n", F.row_number().over(part.orderBy(at, *order))).withColumn("skew", F.col(at) - F.min(at).over(part))
    later = rows.where("__n > 1").withColumn("__over", F.abs("skew") > tolerance)
    was = F.lag("__over", 1, False).over(Window.partitionBy(*emitter).orderBy(at, *order))
    return later.withColumn("__was", was).where("__over and not __was").drop("__n", "__over", "__was")


def coverage(frames: DataFrame, window: list[str], emitter: str, expected: int) -> DataFrame:
    """Emitters present of those expected."""
    return frames.groupBy(*window).agg(F.count_distinct(emitter).alias("present")).withColumn("expected", F.lit(expected)).withColumn("share", F.col("present") / expected)


def dictionary(deltas: DataFrame, key: list[str], order: list[str], tombstone: str = "tombstone") -> DataFrame:
    """The last delta of each id that isn't a tombstone."""
    rest = [c for c in deltas.columns if c not in key]
    last = deltas.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*key, "s.*")
    return last.where(~F.col(tombstone))


def evicted(claims: DataFrame, view: list[str], series: str, emitter: str, released: str) -> DataFrame:
    """Series that all of their owners have released."""
    live = claims.where(~F.col(released)).select(*view, series).distinct()
    return claims.select(*view, series).distinct().join(live, [*view, series], "left_anti")


def implicit_tombstones(mirror: DataFrame, announced: DataFrame, key: list[str]) -> DataFrame:
    """What the mirror holds and a golden keyframe no longer announces."""
    return mirror.join(announced.select(*key).distinct(), key, "left_anti")


def heal_times(roots: DataFrame, view: list[str], seq: str, matches: str, golden: str) -> DataFrame:
    """(view, broken, healed, windows): each run from a mismatched root to the next verified golden keyframe."""
    order = Window.partitionBy(*view).orderBy(seq)
    heals = F.col(matches) & F.col(golden)
    runs = roots.withColumn("__h", heals.cast("int")).withColumn("__run", F.sum("__h").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("__run", F.coalesce("__run", F.lit(0)))
    out = runs.groupBy(*view, "__run").agg(F.min(F.when(~F.col(matches), F.col(seq))).alias("broken"), F.max(F.when(heals, F.col(seq))).alias("healed"))
    return out.where("broken is not null and healed > broken").withColumn("windows", F.col("healed") - F.col("broken")).drop("__run")


def canonical_detections(events: DataFrame) -> DataFrame:
    """One detection for each (shard, view, series, window): the substrate of the earliest, the value of the highest
    revision; absences aren't detections."""
    keys = ["shard_id", "view_id", "series", "w"]
    return events.where("substrate != 'absence'").groupBy(*keys).agg(
        F.min_by("substrate", F.struct("detected_at", "substrate")).alias("substrate"), F.min("detected_at").alias("detected_at"),
        F.max_by("value", F.struct("revision", "detected_at", "value")).alias("value"), F.max("revision").alias("revision"),
    )


#: Kinds of truth that a detection can match.
ANOMALY_LIKE = ("anomaly", "drift")


def matched_truth(detections: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Each detection with the first anomaly or drift (by ``ix``) of its series whose interval holds its window, or
    nulls. An interval that ends before it starts is its start alone."""
    end = F.greatest("window_start", "window_end")
    more = [c for c in ("at",) if c in truth.columns]
    t = truth.where(F.col("type").isin(*ANOMALY_LIKE)).select(*[F.col(k).alias(f"__{k}") for k in key], "window_start", end.alias("window_end"), "ix", "type", "magnitude", "expected_value", *[F.col(c).alias(f"truth_{c}") for c in more])
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [F.col("w").between(F.col("window_start"), F.col("window_end"))]
    joined = detections.join(t, on, "left")
    cols = [c for c in detections.columns]
    return joined.groupBy(*cols).agg(F.min_by(F.struct("ix", "type", "window_start", "window_end", "magnitude", "expected_value", *[f"truth_{c}" for c in more]), "ix").alias("t")).select(*cols, "t.*")


def near_lifecycle(unmatched: DataFrame, lifecycle: DataFrame, key: list[str], within: int = 1) -> DataFrame:
    """Deviations within a window of a birth or tombstone of their series."""
    l = lifecycle.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("at"))
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [(F.col("w") - F.col("at")).between(-within, within)]
    return unmatched.where("substrate = 'deviation'").join(l, on, "left_semi")


#: How close a repaired detection's value must come, relative to the true one.
REVISION_TOLERANCE = 0.10


def scores(matched: DataFrame, truth: DataFrame, lifecycle: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """One row: precision, recall, mean absolute percentage error, revision accuracy and how many of each; null where
    there is nothing. Values are compared for anomalies alone: a keyframe's with the expected value, any other's with
    the magnitude, since it is a residual. ``lifecycle`` (key, at) tells which unmatched deviations are births or ends."""
    true = F.when(F.col("substrate") == "keyframe", F.col("expected_value")).otherwise(F.col("magnitude"))
    expected = F.when(F.col("type") == "anomaly", true)
    off = F.abs(F.col("value") - expected)
    slack = F.abs(expected) * REVISION_TOLERANCE
    revised = expected.isNotNull() & (F.col("revision") > 0)
    d = matched.agg(
        F.count("*").alias("detections"), F.count("ix").alias("true_detections"), F.count_distinct("ix").alias("found"),
        F.avg(F.when(expected != 0, off / F.abs(expected))).alias("mape"), F.count_if(expected != 0).alias("mape_samples"),
        F.avg(F.when(revised, (off <= F.when(slack == 0, 1e-9).otherwise(slack)).cast("int"))).alias("revision_accuracy"), F.count_if(revised).alias("revision_samples"),
    )
    out = d.crossJoin(truth.where(F.col("type").isin(*ANOMALY_LIKE)).agg(F.count("*").alias("truths")))  # one row by one row
    if lifecycle is not None:
        out = out.crossJoin(near_lifecycle(matched.where("ix is null"), lifecycle, key or []).agg(F.count("*").alias("lifecycle_false")))  # one row by one row
    return out.withColumn("precision", F.try_divide("true_detections", "detections")).withColumn("recall", F.try_divide("found", "truths"))


def recall_by_type(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """(type, truths, recalled, recall) of anomalies and drifts."""
    found = matched.where("ix is not null").select("ix").distinct().withColumn("__hit", F.lit(1))
    rows = truth.where(F.col("type").isin(*ANOMALY_LIKE)).join(found, "ix", "left")
    return rows.groupBy("type").agg(F.count("*").alias("truths"), F.count("__hit").alias("recalled")).withColumn("recall", F.col("recalled") / F.col("truths"))


def latency_summary(latencies: DataFrame, key: list[str], latency: str) -> DataFrame:
    """Count, mean and the element at int(0.95 n) of the sorted latencies, counted by distinct value first, so that no
    task sorts all rows."""
    by = latencies.where(F.col(latency).isNotNull()).groupBy(*key, latency).agg(F.count("*").alias("__c"))
    part = Window.partitionBy(*key)
    rows = by.withColumn("__to", F.sum("__c").over(part.orderBy(latency))).withColumn("__n", F.sum("__c").over(part))
    at = F.least(F.floor(F.col("__n") * 0.95).cast("bigint"), F.col("__n") - 1)
    mean = F.sum(F.col(latency) * F.col("__c")) / F.sum("__c")
    return rows.groupBy(*key).agg(F.sum("__c").alias("n"), mean.alias("mean"), F.min(F.when(F.col("__to") > at, F.col(latency))).alias("p95"))


def byte_ledger(frames: DataFrame, day: str, kind: str, size: str, kinds: list[str]) -> DataFrame:
    """Bytes of each day by kind of frame."""
    return frames.groupBy(day).agg(*[F.sum(F.when(F.col(kind) == k, F.col(size)).otherwise(0)).alias(f"{k}_bytes") for k in kinds], F.sum(size).alias("total_bytes"))


def detector_scores(bursts: DataFrame, hits: DataFrame, grace: int = 6, persist: int = 0) -> DataFrame:
    """For each burst and detector: whether it hit from the start until ``grace`` windows after the end, the lag, in how
    many of these windows, and whether in at least ``persist`` of the burst's own."""
    detectors = hits.select("detector").distinct()
    pairs = bursts.crossJoin(detectors)  # a handful of detectors
    h = hits.select(F.col("detector").alias("__d"), F.col("series").alias("__s"), F.col("w").alias("__w")).distinct()
    on = (F.col("detector") == F.col("__d")) & (F.col("series") == F.col("__s")) & (F.col("__w") >= F.col("start")) & (F.col("__w") < F.col("end") + grace)
    out = pairs.join(h, on, "left").groupBy(*pairs.columns).agg(F.min(F.col("__w") - F.col("start")).alias("lag"), F.count("__w").alias("hits"), F.count_if(F.col("__w") <= F.col("end")).alias("__own"))
    return out.withColumn("detected", F.col("lag").isNotNull()).withColumn("persisted", F.col("detected") & (F.col("__own") >= persist)).drop("__own")


def spurious_hits(bursts: DataFrame, hits: DataFrame, per_day: int, grace: int = 6) -> DataFrame:
    """(detector, day, spurious): distinct hits of each day in no burst of their series, ``grace`` windows behind it included."""
    b = bursts.select(F.col("series").alias("__s"), F.col("start").alias("__a"), (F.col("end") + grace).alias("__b"))
    on = (F.col("series") == F.col("__s")) & (F.col("w") >= F.col("__a")) & (F.col("w") < F.col("__b"))
    none = hits.select("detector", "series", "w").distinct().join(b, on, "left_anti")
    return none.groupBy("detector", F.floor(F.col("w") / per_day).alias("day")).agg(F.count("*").alias("spurious"))


def cell_rates(trials: DataFrame, cell: list[str], flags: list[str]) -> DataFrame:
    return trials.groupBy(*cell).agg(F.count("*").alias("trials"), *[F.avg(F.col(f).cast("int")).alias(f"{f}_rate") for f in flags])


def recovery_floor(rates: DataFrame, noise: str, magnitude: str, rate: str, least: float = 0.9) -> DataFrame:
    """The smallest magnitude of each noise level from which on every rate is at least ``least``; null if none."""
    onward = Window.partitionBy(noise).orderBy(magnitude).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kept = rates.withColumn("__low", F.min(rate).over(onward))
    return kept.groupBy(noise).agg(F.min(F.when(F.col("__low") >= least, F.col(magnitude))).alias("floor"))


def threshold_grid(values: DataFrame, value: str, days: float, grid: list[float]) -> DataFrame:
    """Events a day at each threshold of a grid."""
    rows = values.select(F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"), F.col(value).alias("__v"))
    return rows.groupBy("threshold").agg((F.count_if(F.col("__v") > F.col("threshold")) / days).alias("events_per_day"))


def flagged_snapshots(entries: DataFrame, support: DataFrame, key: list[str]) -> DataFrame:
    """The entries of a frame's snapshot whose series the solve of that frame flagged."""
    return entries.join(support.select(*key).distinct(), key, "left_semi")


def kept_snapshots(captures: DataFrame, series: str, at: str, order: list[str], now: float | Column, ttl_s: float, most: int) -> DataFrame:
    """What a store holds at ``now``: the last capture of each series, none older than ``ttl_s`` seconds, and of these
    the ``most`` captured last."""
    now = now if isinstance(now, Column) else F.lit(now)
    rest = [c for c in captures.columns if c != series]
    last = captures.where(F.col(at) <= now).groupBy(series).agg(F.max_by(F.struct(*rest), F.struct(at, *order)).alias("s")).select(series, "s.*")
    live = last if ttl_s <= 0 else last.where(now - F.col(at) <= ttl_s)
    return live if most <= 0 else live.orderBy(F.col(at).desc(), *[F.col(c).desc() for c in order], series).limit(most)


def snapshots_of(events: DataFrame, snapshots: DataFrame, series: str, at: str, ttl_s: int) -> DataFrame:
    """Events with the latest snapshot of their series taken at most ``ttl_s`` seconds before, and how old it was
    (``latency_s``), or nulls."""
    s = snapshots.select(F.col(series).alias("__s"), F.col("taken_at"), F.col("snapshot_value"))
    on = (F.col(series) == F.col("__s")) & (F.col("taken_at") <= F.col(at)) & (F.col(at) - F.col("taken_at") <= ttl_s)
    cols = events.columns
    out = events.join(s, on, "left").groupBy(*cols).agg(F.max_by(F.struct("taken_at", "snapshot_value"), F.struct("taken_at", "snapshot_value")).alias("s")).select(*cols, "s.*")
    return out.withColumn("latency_s", F.col(at) - F.col("taken_at"))


def fallback_events(fallbacks: DataFrame) -> DataFrame:
    """An event for each top entry of a decoded fallback frame."""
    return fallbacks.select("*", F.explode("top").alias("e")).select(*[c for c in fallbacks.columns if c != "top"], F.lit("fallback").alias("substrate"), F.lit("aggregate").alias("confidence"), F.col("e.id").alias("series_id"), F.col("e.value").alias("value"))


def counters(log: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean and largest bytes of a frame log, by labels."""
    return log.groupBy(*by).agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), F.avg("bytes").alias("mean_bytes"), F.max("bytes").alias("max_bytes"))


#: What happens to a frame or an event, as (name of the counter, kind of the log row). Fixed values.
COUNTED = (
    ("frames_total", "frame"), ("gated_frames", "gated"), ("births_applied", "birth"), ("tombstones_applied", "tombstone"),
    ("emitters_reaped", "reaped"), ("anomalies_fired", "anomaly"), ("snapshots_captured", "snapshot"), ("breaker_trips", "breaker"),
    ("late_frames_dropped", "late"), ("duplicate_frames_dropped", "duplicate"), ("keyring_miss", "no_key"),
    ("unregistered_codec", "no_codec"), ("merged_windows", "merged"), ("dict_root_mismatches", "root"),
)


def engine_counters(log: DataFrame, by: list[str]) -> DataFrame:
    """Every counter, mean and gauge of an engine by labels, in one pass over a log of (kind, n, bytes, ns, ms): counts
    of each kind of row, mean nanoseconds of solves, snapshots and healed roots, the longest heal, bytes on the wire,
    those of golden keyframes' dictionaries and of dictionary blocks plain, packed and by entry, the largest skew, and
    how many shards ended degraded (the last ``degrade`` or ``heal`` row by ``at``)."""

    def of(kind: str, what: Column) -> Column:
        return F.when(F.col("kind") == kind, what)

    counts = [F.coalesce(F.sum(of(kind, F.col("n"))), F.lit(0)).cast("bigint").alias(name) for name, kind in COUNTED]
    means = [F.floor(F.avg(of(kind, F.col("ns")))).alias(name) for name, kind in (("recover_seconds_avg_ns", "solve"), ("snapshots_latency_avg_ns", "snapshot"), ("dict_root_heal_avg_ns", "heal"))]
    sizes = [F.coalesce(F.sum(of(kind, F.col("bytes"))), F.lit(0)).cast("bigint").alias(name) for name, kind in (("wire_bytes_total", "frame"), ("full_dict_keyframe_bytes", "full_dict"), ("dict_block_raw_bytes", "block"), ("dict_block_gzip_bytes", "packed"))]
    entries = F.coalesce(F.sum(of("block", F.col("n"))), F.lit(0)).cast("bigint").alias("dict_block_entries")
    heal, skew = F.max(of("heal", F.col("ns"))).alias("dict_root_heal_max_ns"), F.max_by(of("skew", F.col("ms")), of("skew", F.col("at"))).alias("clock_skew_ms")
    state = F.max_by(F.when(F.col("kind").isin("degrade", "heal"), F.col("kind") == "degrade"), F.when(F.col("kind").isin("degrade", "heal"), F.col("at")))
    return log.groupBy(*by).agg(*counts, *means, *sizes, entries, heal, skew, F.coalesce(state, F.lit(False)).alias("degraded"))


def keyed(frames: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(frames with the key of their version, frames whose key is unknown)."""
    return frames.join(keys, on), frames.join(keys.select(*on).distinct(), on, "left_anti")


def stamped(events: DataFrame, names: DataFrame, series: str = "series_id", frames: DataFrame | None = None, frame: str = "frame_id", snapshots: DataFrame | None = None, at: str = "detected_at", ttl_s: int = 600) -> DataFrame:
    """Events with the name of their series; a series that the dictionary lacks has none. With ``frames`` also shard,
    emitter, epoch, view and window of the frame they came from, with ``snapshots`` the series' last snapshot."""
    out = events.join(names.select(series, F.col("name").alias("series_name")).dropDuplicates([series]), series, "left")
    if frames is not None:
        out = out.join(frames.select(frame, "shard_id", "emitter_id", "epoch", "view_id", F.col("seq").alias("window_id")).dropDuplicates([frame]), frame, "left")
    return out if snapshots is None else snapshots_of(out, snapshots, series, at, ttl_s)


def shadow_gauges(log: DataFrame, by: list[str]) -> DataFrame:
    """What compressing dictionary blocks would save: bytes an entry, and the share of all bytes that would go."""
    g = log.groupBy(*by).agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"), F.sum("entries").alias("entries"), F.sum("total").alias("total"))
    return g.select(*by, F.try_divide("raw", "entries").alias("raw_per_entry"), F.try_divide("packed", "entries").alias("packed_per_entry"), (F.try_divide(F.col("raw") - F.col("packed"), F.col("total")) * 100).alias("saved_percent"))


def newest_alerts(alerts: DataFrame, at: list[str], most: int = 256) -> DataFrame:
    return alerts.orderBy(*[F.col(c).desc() for c in at]).limit(most)


def any_degraded(states: DataFrame, shard: list[str], flag: str = "degraded") -> DataFrame:
    return states.groupBy(*shard).agg(F.bool_or(flag).alias(flag))


def pooled_rates(results: DataFrame, by: list[str], found: str, tried: str) -> DataFrame:
    """Rates pooled over runs: the sum of what was found over the sum of what was tried."""
    return results.groupBy(*by).agg(F.sum(found).alias("found"), F.sum(tried).alias("tried")).withColumn("rate", F.try_divide("found", "tried"))


def gated(solves: DataFrame, most_residual: float) -> tuple[DataFrame, DataFrame]:
    """(solves that pass, solves that degrade their view): a fallback or a residual over ``most_residual`` degrades."""
    bad = F.coalesce(F.col("fallback"), F.lit(False)) | (F.col("residual") > most_residual)
    return solves.where(~bad), solves.where(bad)


def keyframe_states(log: DataFrame, view: list[str], order: list[str]) -> DataFrame:
    """``degraded`` (after each row), ``mismatch`` (the first of a run of wrong roots), ``healed`` and ``dropped`` of a
    view's log of solves and frames in order, a row each with ``kind``:

    * ``gate``: a solve that failed its gate; the view is degraded.
    * ``golden``, ``kdelta``: keyframes with ``root_ok`` (the dictionary's root is the one announced) and ``readable``
      (codec and payload). An unreadable one, a wrong root, or a delta keyframe before the first verified golden one
      degrades; of those only a verified golden one heals.
    * ``residual``: dropped while the view is degraded.
    """
    w = Window.partitionBy(*view).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    golden, delta = F.col("kind") == "golden", F.col("kind") == "kdelta"
    verified = golden & F.col("readable") & F.col("root_ok")
    seen = F.coalesce(F.max(verified.cast("int")).over(before), F.lit(0)) == 1
    usable = F.col("readable") & (golden | seen)
    wrong = (golden | delta) & usable & ~F.col("root_ok")
    rows = log.withColumn("__heal", verified).withColumn("__wrong", wrong)
    rows = rows.withColumn("__bad", (F.col("kind") == "gate") | (golden | delta) & (~usable | wrong))
    state = lambda frame: F.coalesce(F.last(F.when(F.col("__bad"), True).when(F.col("__heal"), False), ignorenulls=True).over(frame), F.lit(False))
    episode = lambda frame: F.coalesce(F.last(F.when(F.col("__wrong"), True).when(F.col("__heal"), False), ignorenulls=True).over(frame), F.lit(False))
    rows = rows.withColumn("degraded", state(upto)).withColumn("__was", state(before)).withColumn("__open", episode(before))
    rows = rows.withColumn("mismatch", F.col("__wrong") & ~F.col("__open")).withColumn("healed", F.col("__heal") & F.col("__open")).withColumn("dropped", (F.col("kind") == "residual") & F.col("__was"))
    return rows.drop("__heal", "__wrong", "__bad", "__was", "__open")


def incident_report(incidents: DataFrame, hits: DataFrame, solves: DataFrame, grace: int) -> DataFrame:
    """(incident columns, detector, lag, gated_solves, solves): how long each detector took from an incident's start to its
    first hit before ``grace`` windows after its end, and how many of the solves in it were gated."""
    detectors = hits.select("detector").distinct()
    pairs = incidents.crossJoin(detectors)  # a handful of detectors
    h = hits.select(F.col("detector").alias("__d"), F.col("w").alias("__w")).distinct()
    on = (F.col("detector") == F.col("__d")) & (F.col("__w") >= F.col("start")) & (F.col("__w") < F.col("end") + grace)
    lags = pairs.join(h, on, "left").groupBy(*pairs.columns).agg(F.min(F.col("__w") - F.col("start")).alias("lag"))
    s = solves.select(F.col("w").alias("__w"), F.col("gated").alias("__g"))
    inside = incidents.join(s, F.col("__w").between(F.col("start"), F.col("end")), "left").groupBy(*incidents.columns).agg(F.count("__w").alias("solves"), F.count_if("__g").alias("gated_solves"))
    return lags.join(inside, incidents.columns)


def confidence_interval(rates: DataFrame, key: list[str], rate: str, quantile: float) -> DataFrame:
    """(key, n, mean, low, high): mean of rates with ``quantile`` standard errors to each side; a single rate has none.
    ``t_quantile`` gives the quantile of a number of rates."""
    by = rates.groupBy(*key).agg(F.count(rate).alias("n"), F.avg(rate).alias("mean"), F.coalesce(F.stddev_samp(rate), F.lit(0.0)).alias("__s"))
    half = quantile * F.col("__s") / F.sqrt("n")
    return by.select(*key, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def lag_correlation(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, acf1): autocorrelation with the value before, 0 for a constant."""
    part = Window.partitionBy(*key)
    rows = df.withColumn("__c", F.col(value) - F.avg(value).over(part))
    rows = rows.withColumn("__p", F.lag("__c").over(part.orderBy(*order)))
    return rows.groupBy(*key).agg(F.coalesce(F.try_divide(F.sum(F.col("__c") * F.col("__p")), F.sum(F.col("__c") * F.col("__c"))), F.lit(0.0)).alias("acf1"))


def side_tasks(log: DataFrame, at: str, periods: dict[str, int]) -> DataFrame:
    """(task, due, rows): when tasks of fixed periods (seconds) fall due over a log, and how many rows each sees anew."""
    out = None
    for task, seconds in sorted(periods.items()):
        due = log.groupBy((F.floor(F.col(at) / seconds) + 1).alias("__k")).agg(F.count("*").alias("rows")).select(F.lit(task).alias("task"), (F.col("__k") * seconds).alias("due"), "rows")
        out = due if out is None else out.unionByName(due)
    return out
