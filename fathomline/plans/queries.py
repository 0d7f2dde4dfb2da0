"""Queries of the telemetry operators over the ``events`` table, and the SQL that checks them.

Event types stand for metric groups, users for instances; windows are of six hours, every sixth is a keyframe.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import hashing, identity, numeric
from fathomline.operators import analyze, conformal, encode, recovery
from fathomline.streaming import windows

HOURS, EVERY, GOLDEN, TTL = 6, 6, 24, 3
SEED, BUCKETS, HASHES = 99, 64, 4
TYPES, NAMED_USERS = ("click", "error", "purchase", "signup", "view"), 200
RULES = [("^(purchase|signup)$", "exact"), ("err", "merged")]

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | Callable[[], str] | None]] = {}


def query(sql: str | Callable[[], str] | None = None):
    def put(f):
        _found[f.__name__] = (f, sql)
        return f

    return put


def _all() -> None:
    """The other module's queries are in the same table."""
    from fathomline.plans import more_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _all()
    return {k: sql() if callable(sql) else sql for k, (_, sql) in _found.items() if sql}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "events.parquet"))


def points(spark: SparkSession, sf_dir: str, hours: int = HOURS) -> DataFrame:
    return events(spark, sf_dir).withColumn("w", encode.window_index(F.col("ts"), 3600 * hours))


def folded(spark: SparkSession, sf_dir: str, hours: int = HOURS) -> DataFrame:
    return encode.window_fold(points(spark, sf_dir, hours), ["w", "event_type"], "user_id", ["ts", "event_id"])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.logical_series(folded(spark, sf_dir), ["w", "event_type"], "event_type")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily last values of each user and event type: series that come and go."""
    p = points(spark, sf_dir, 24).withColumn("name", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    return p.groupBy("w", "name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def last_window(rows: DataFrame) -> int:
    return rows.agg(F.max("w")).first()[0] or 0


def user_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.hold_residual(encode.lifetimes(user_series(spark, sf_dir), TTL, ["name"]), EVERY, ["name"])


def rounded(c: str | Column) -> Column:
    return F.round(c, 6)


S = f"""s AS (SELECT CAST(floor(epoch(ts) / {3600 * HOURS}) AS BIGINT) AS w, event_type AS g, user_id AS i, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL),
f AS (SELECT w, g, sum(v) AS sum, count(*) AS n, greatest(max(v), 0.0) AS max FROM s GROUP BY ALL),
l AS (SELECT w, g || '|agg=sum' AS name, sum AS value FROM f UNION ALL SELECT w, g || '|agg=count', n::DOUBLE FROM f UNION ALL SELECT w, g || '|agg=max', max FROM f)"""
U = f"""u AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS w, event_type || '|' || user_id AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
b0 AS (SELECT *, coalesce(w - lag(w) OVER (PARTITION BY name ORDER BY w), {TTL}) >= {TTL} AS birth FROM u),
b1 AS (SELECT *, sum(birth::INT) OVER (PARTITION BY name ORDER BY w) AS life FROM b0),
b2 AS (SELECT b.*, CASE WHEN NOT b.birth THEN coalesce(k.value, f.value) END AS baseline FROM b1 b
       ASOF LEFT JOIN b1 k ON b.name = k.name AND b.life = k.life AND ((b.w - 1) // {EVERY}) * {EVERY} >= k.w
       JOIN (SELECT name, life, value FROM b1 WHERE birth) f ON f.name = b.name AND f.life = b.life),
r AS (SELECT w, name, value, life, birth, baseline, CASE WHEN birth THEN 0.0 ELSE value - baseline END AS residual FROM b2)"""
#: Every active series' last value in every window, and at every keyframe, by joining windows to lifetimes.
A = f"""lf AS (SELECT name, life, min(w) AS a, max(w) + {TTL} - 1 AS z FROM b1 GROUP BY ALL),
al AS (SELECT v.w, lf.name, lf.life, b.value FROM (SELECT unnest(range((SELECT min(w) FROM u), (SELECT max(w) + 1 FROM u))) AS w) v JOIN lf ON v.w BETWEEN lf.a AND lf.z
       ASOF JOIN b1 b ON b.name = lf.name AND b.life = lf.life AND v.w >= b.w),
kf AS (SELECT *, lag(value) OVER (PARTITION BY name, life ORDER BY w) AS prev, lag(w) OVER (PARTITION BY name, life ORDER BY w) AS before FROM al WHERE w % {EVERY} = 0)"""


def hashes_sql(m: int = BUCKETS, d: int = HASHES, seed: int = SEED) -> str:
    """What names hash to, by another implementation of the hash: a table of the names that the small tables can have."""
    import xxhash

    rows = []
    for name in (f"{kind}|{user}" for kind in TYPES for user in range(NAMED_USERS)):
        h1, h2 = xxhash.xxh64_intdigest(name, seed), xxhash.xxh64_intdigest(name, seed ^ hashing.SECOND) | 1
        buckets, signs = [(h1 + i * h2) % 2**64 % m for i in range(d)], [1 if h1 >> i + 1 & 1 else -1 for i in range(d)]
        rows.append(f"('{name}', {xxhash.xxh64_intdigest(name, 0)}, {buckets}, {signs})")
    return "hx(name, id, bs, ss) AS (VALUES " + ", ".join(rows) + ")"


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^(purchase|signup)$') THEN 'exact' WHEN regexp_matches(event_type, 'err') THEN 'merged' ELSE 'sketched' END AS tier FROM events")
def tier_route(spark, d):
    return events(spark, d).select("event_id", encode.tier(F.col("event_type"), RULES).alias("tier"))


@query("SELECT event_id, event_type, value FROM events WHERE regexp_matches(event_type, '^(purchase|signup)$|err')")
def downstream_pass(spark, d):
    rows = events(spark, d).withColumn("tier", encode.tier(F.col("event_type"), RULES))
    return encode.passed_on(rows).select("event_id", "event_type", "value")


@query("SELECT view, user_id % 4 AS shard, count(*) AS points, round(sum(value), 6) AS total FROM events, (VALUES ('by_type'), ('by_user')) AS t(view) GROUP BY ALL")
def view_fanout(spark, d):
    rows = encode.views(events(spark, d).select("user_id", "value"), ["by_type", "by_user"])
    return rows.groupBy("view", (F.col("user_id") % 4).alias("shard")).agg(F.count("*").alias("points"), rounded(F.sum("value")).alias("total"))


@query("""SELECT event_id, event_type || '|k=' || coalesce(json_extract_string(props, '$.k'), '') || ',user=' || user_id || '|agg=sum' AS name,
          regexp_replace(event_type || '.' || user_id, '[^a-zA-Z0-9_:]', '_', 'g') AS metric FROM events""")
def series_names(spark, d):
    group = identity.group_key(F.col("event_type"), {"k": F.get_json_object("props", "$.k"), "user": F.col("user_id")})
    return events(spark, d).select("event_id", identity.logical_name(group, F.lit("sum")).alias("name"), identity.metric_name(F.concat_ws(".", "event_type", F.col("user_id").cast("string"))).alias("metric"))


@query("""SELECT event_id, le, c::DOUBLE AS value FROM (SELECT event_id, unnest(['1e-05', '10', '100', '1e+06', '+Inf']) AS le,
            unnest([(value <= 0.00001)::INT, (value > 0.00001 AND value <= 10)::INT, (value > 10 AND value <= 100)::INT, (value > 100 AND value <= 1000000)::INT, (value > 1000000)::INT]) AS c FROM events WHERE event_id % 3 <> 0)
          UNION ALL SELECT event_id, NULL, value FROM events WHERE event_id % 3 = 0""")
def histogram_series(spark, d):
    v, bounds = F.col("value"), [0.00001, 10.0, 100.0, 1000000.0]
    edges = [float("-inf"), *bounds, float("inf")]
    counts = F.array(*[((v > a) & (v <= b)).cast("bigint") for a, b in zip(edges, edges[1:], strict=False)])
    kind = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "summary").otherwise("gauge")).otherwise("histogram")
    rows = events(spark, d).select("event_id", kind.alias("type"), v, counts.alias("bucket_counts"), F.array(*map(F.lit, bounds)).alias("bounds"))
    return encode.flattened_points(rows).select("event_id", "le", "value")


@query(f"WITH {S} SELECT w, g AS event_type, round(sum, 6) AS sum, n AS count, round(max, 6) AS max FROM f")
def window_fold(spark, d):
    return folded(spark, d).select("w", "event_type", rounded("sum").alias("sum"), "count", rounded("max").alias("max"))


@query(f"WITH {S} SELECT w, name, round(value, 6) AS value FROM l")
def logical_series(spark, d):
    return series(spark, d).select("w", "name", rounded("value").alias("value"))


@query(f"WITH {U} SELECT w, name, round(value, 6) AS value, life::BIGINT AS life, birth, round(baseline, 6) AS baseline, round(residual, 6) AS residual FROM r")
def hold_residual(spark, d):
    return user_residuals(spark, d).select("w", "name", rounded("value").alias("value"), "life", "birth", rounded("baseline").alias("baseline"), rounded("residual").alias("residual"))


@query(f"WITH {U}, {A} SELECT name, w, round(value, 6) AS cur, round(prev, 6) AS prev FROM kf WHERE abs(value - prev) > 20")
def keyframe_drift(spark, d):
    rows = user_series(spark, d)
    frames = encode.keyframe_values(rows, EVERY, TTL, ["name"], last_window(rows))
    return encode.keyframe_drift(frames, 20.0, ["name"]).select("name", "w", rounded("value").alias("cur"), rounded("prev").alias("prev"))


@query(f"WITH {U}, {A} SELECT w, name, round(value, 6) AS value FROM kf WHERE prev IS NULL OR prev::FLOAT <> value::FLOAT")
def kdelta_changed_rows(spark, d):
    rows = user_series(spark, d)
    frames = encode.keyframe_values(rows, EVERY, TTL, ["name"], last_window(rows))
    return encode.changed_at_keyframes(frames, ["name"]).select("w", "name", rounded("value").alias("value"))


@query(f"WITH {U}, {A}, m AS (SELECT w, max(abs((value::FLOAT - coalesce(prev::FLOAT, 0::FLOAT))::FLOAT)) / 32767 AS s FROM kf GROUP BY w) SELECT w, CASE WHEN s::FLOAT > 0 THEN s::FLOAT ELSE 1e-6::FLOAT END::DOUBLE AS scale FROM m")
def kdelta_scales(spark, d):
    rows = user_series(spark, d)
    frames = encode.keyframe_values(rows, EVERY, TTL, ["name"], last_window(rows))
    return encode.delta_keyframe_scale(frames, ["name"], ["w"]).select("w", F.col("scale").cast("double").alias("scale"))


@query(f"""WITH {U}, {A}, n AS (SELECT w, name, lead(w) OVER (PARTITION BY name ORDER BY w) AS nxt FROM u),
           t AS (SELECT w + {TTL} AS w, name FROM n WHERE nxt >= w + {TTL} OR (nxt IS NULL AND w + {TTL} <= (SELECT max(w) FROM u))),
           k AS (SELECT DISTINCT w FROM al WHERE w % {EVERY} = 0)
           SELECT al.w, name, round(value, 6) AS init_value, false AS tombstone FROM al WHERE w % {GOLDEN} = 0
           UNION ALL SELECT w, name, round(value, 6), false FROM b1 WHERE birth AND w % {EVERY} = 0 AND w % {GOLDEN} <> 0
           UNION ALL SELECT w, name, 0.0, true FROM t JOIN k USING (w)""")
def keyframe_dictionary(spark, d):
    rows = user_series(spark, d)
    until = last_window(rows)
    lives = encode.lifetimes(rows, TTL, ["name"])
    gone = encode.tombstones(rows, TTL, ["name"], until).select(F.col("tombstone").alias("w"), "name")
    at_keyframe = F.col("w") % EVERY == 0
    out = encode.keyframe_dictionary(encode.keyframe_values(rows, EVERY, TTL, ["name"], until), gone.where(at_keyframe), lives.where(F.col("birth") & at_keyframe), F.col("w") % GOLDEN == 0)
    return out.select("w", "name", rounded("init_value").alias("init_value"), "tombstone")


@query(f"""WITH {U}, {A}, g AS (SELECT unnest(range((SELECT min(w) // 10 + 1 FROM u), (SELECT max(w) // 10 + 1 FROM u))) * 10 AS w)
           SELECT name, w, w // 10 AS epoch, w % 10 AS epoch_seq, round(value, 6) AS value, false AS reborn FROM u
           UNION ALL SELECT p.name, g.w, g.w // 10, 0, round(p.value, 6), true FROM g JOIN al p ON p.w = g.w - 1 WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.name = p.name AND u.w = g.w)""")
def epoch_rotation(spark, d):
    rows = user_series(spark, d)
    out = encode.rotated(rows, 10, TTL, ["name"], last_window(rows))
    return out.select("name", "w", "epoch", "epoch_seq", rounded("value").alias("value"), "reborn")


@query(f"""WITH {U}, n AS (SELECT w, name, lead(w) OVER (PARTITION BY name ORDER BY w) AS nxt FROM u)
           SELECT name, w AS last_seen, w + {TTL} AS tombstone FROM n WHERE nxt >= w + {TTL} OR (nxt IS NULL AND w + {TTL} <= (SELECT max(w) FROM u))""")
def absence_gaps(spark, d):
    rows = user_series(spark, d)
    return encode.tombstones(rows, TTL, ["name"], last_window(rows))


_Y = f"""y AS (SELECT w, bucket, sum(sgn * residual / sqrt({HASHES}::DOUBLE)) AS y, count(DISTINCT emitter) AS coverage FROM
            (SELECT w, residual, length(r.name) % 3 AS emitter, unnest(bs) AS bucket, unnest(ss) AS sgn FROM r JOIN hx ON hx.name = r.name WHERE w % {EVERY} <> 0) GROUP BY ALL)"""


@query(lambda: f"WITH {U}, {hashes_sql()}, {_Y} SELECT w, round(sum(y * y) / {BUCKETS}, 3) AS energy FROM y GROUP BY w")
def sketch_energy(spark, d):
    return encode.energy(hashed_sketch(spark, d), ["w"], BUCKETS).select("w", F.round("energy", 3).alias("energy"))


def energies(spark, d) -> DataFrame:
    return folded(spark, d).select("w", "event_type", (F.col("sum") * F.col("sum") / math.tau).alias("energy"))


@query(f"""WITH {S}, e AS (SELECT w, g, sum * sum / {math.tau!r}::DOUBLE AS energy FROM f),
           m AS (SELECT w, g, energy, quantile_cont(energy, 0.5) OVER (PARTITION BY g ORDER BY w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS median FROM e WHERE w % {EVERY} <> 0)
           SELECT w, g AS event_type, round(energy, 3) AS energy, round(median, 3) AS median, coalesce(energy > 1.2 * median, false) AS storm FROM m""")
def storm_windows(spark, d):
    return encode.storms(energies(spark, d), ["event_type"], multiple=1.2, every=EVERY).select("w", "event_type", F.round("energy", 3).alias("energy"), F.round("median", 3).alias("median"), "storm")


@query(f"""WITH {S}, e AS (SELECT w, g, sum * sum / {math.tau!r}::DOUBLE AS energy FROM f),
           m AS (SELECT w, g, energy > 1.2 * quantile_cont(energy, 0.5) OVER (PARTITION BY g ORDER BY w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS storm FROM e WHERE w % {EVERY} <> 0)
           SELECT e.w, e.g AS event_type, CASE WHEN e.w % {GOLDEN} = 0 THEN 'golden' WHEN e.w % {EVERY} = 0 THEN 'kdelta' WHEN storm THEN 'fallback' ELSE 'residual' END AS kind FROM e LEFT JOIN m USING (w, g)""")
def frame_kinds(spark, d):
    return encode.frame_kinds(energies(spark, d), ["event_type"], golden=GOLDEN, every=EVERY, multiple=1.2).select("w", "event_type", "kind")


@query(lambda: f"WITH {U}, {hashes_sql()} SELECT w, name, round(value, 6) AS value, rank::INT AS rank FROM (SELECT r.*, row_number() OVER (PARTITION BY w ORDER BY abs(residual) DESC, id) AS rank FROM r JOIN hx USING (name)) WHERE rank <= 10")
def topk_residuals(spark, d):
    """What a fallback carries: the last values of the series with the largest residuals, ties by unsigned id."""
    out = encode.top_residuals(user_residuals(spark, d), ["w"], 10, order=hashing.unsigned_order(hashing.series_id(F.col("name"))))
    return out.select("w", "name", rounded("value").alias("value"), "rank")


@query(f"WITH {U}, {A} SELECT w, round(sum(value), 6) AS total_sum, count(*) AS total_count FROM al GROUP BY w")
def fallback_totals(spark, d):
    rows = user_series(spark, d)
    active = encode.active_at_each_window(rows, TTL, ["name"], last_window(rows))
    return encode.fallback_totals(active, ["w"]).select("w", rounded("total_sum").alias("total_sum"), "total_count")


@query("""WITH z AS (SELECT event_id, value, avg(value) OVER w AS m, var_pop(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          SELECT event_id, CASE WHEN v > 0 THEN round((value - m) / sqrt(v), 4) ELSE 0.0 END AS z, CASE WHEN v > 0 THEN 0 ELSE coalesce(sign(value - m), 0) END::INT AS beyond FROM z""")
def snapshot_zscore(spark, d):
    """Every event; ``beyond`` is the sign of a score that is as large as a number can be."""
    out = encode.snapshot_scores(events(spark, d), ["user_id"], ["ts", "event_id"])
    huge = F.abs("z") > 1e300
    return out.select("event_id", F.when(huge, 0.0).otherwise(F.round("z", 4)).alias("z"), F.when(huge, F.signum("z")).otherwise(0).cast("int").alias("beyond"))


@query("SELECT event_id, count(*) OVER r AS held, max(value) OVER r AS peak FROM events WINDOW r AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW)")
def ring_lookback(spark, d):
    return encode.lookback(events(spark, d), ["user_id"], "ts", 15).select("event_id", "held", "peak")


@query(f"""WITH RECURSIVE p AS (SELECT event_type AS g, CAST(floor(epoch(ts) / {3600 * HOURS}) AS BIGINT) AS w, event_id, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts) / {3600 * HOURS}), ts, event_id) AS k FROM events),
           f(g, t, ids) AS (SELECT g, min(w) - 1, []::BIGINT[] FROM p GROUP BY g
             UNION ALL SELECT f.g, f.t + 1, coalesce((SELECT list(p.k ORDER BY p.k) FROM p WHERE p.g = f.g AND p.w <= f.t + 1 AND p.w >= f.t + 1 - 2 AND NOT list_contains(f.ids, p.k)), [])[:20] || f.ids[:400] FROM f WHERE f.t < (SELECT max(w) + 3 FROM p)),
           s AS (SELECT g, t, unnest(ids[:20]) AS k FROM f), o AS (SELECT g, k, min(t) AS shipped FROM s GROUP BY ALL)
           SELECT p.g AS event_type, p.event_id, p.w, CASE WHEN o.shipped <= p.w + 2 THEN o.shipped END AS shipped FROM p LEFT JOIN o ON o.g = p.g AND o.k = p.k""")
def snapshot_staging(spark, d):
    """Twenty snapshots of each type go out with a window; what waits longer than two windows is dropped."""
    rows = points(spark, d).select("event_type", "event_id", "w", "ts")
    return encode.staged_snapshots(rows, ["event_type"], ["ts", "event_id"], "w", 20, 2).select("event_type", "event_id", "w", "shipped")


@query(f"WITH {U}, v AS (SELECT split_part(name, '|', 1) AS g, name, var_pop(residual) AS variance FROM r GROUP BY ALL) SELECT g AS event_type, name, round(variance, 6) AS variance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY variance DESC, name) AS rank, count(*) OVER (PARTITION BY g) AS n FROM v) WHERE rank <= ceil(n * 0.05)")
def routed_series(spark, d):
    out = encode.routed(user_residuals(spark, d).withColumn("event_type", F.split_part("name", F.lit("|"), F.lit(1))), ["event_type"], "name")
    return out.select("event_type", "name", rounded("variance").alias("variance"), "rank")


@query(f"""WITH {U}, b AS (SELECT min(ts) AS ts, event_type, user_id FROM events GROUP BY ALL)
           SELECT event_type, user_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS rate, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) > 3 AS tripped FROM b""")
def birth_rate(spark, d):
    born = events(spark, d).groupBy("event_type", "user_id").agg(F.min("ts").alias("ts"))
    return encode.birth_rate(born, ["event_type"], "ts", 3600, 3).select("event_type", "user_id", "rate", "tripped")


@query("""WITH RECURSIVE b AS (SELECT event_type AS g, user_id, CAST(floor(epoch(min(ts)) / 3600) AS BIGINT) AS w FROM events GROUP BY ALL),
          o AS (SELECT g, w, row_number() OVER (PARTITION BY g ORDER BY w) AS k FROM b),
          a(g, k, recent, ok, no) AS (SELECT DISTINCT g, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT FROM o
            UNION ALL SELECT g, k, CASE WHEN len(kept) >= 10 THEN kept ELSE list_append(kept, w) END, ok + (len(kept) < 10)::INT, no + (len(kept) >= 10)::INT
            FROM (SELECT a.g, o.k, o.w, a.ok, a.no, list_filter(a.recent, lambda x: x >= o.w - 24) AS kept FROM a JOIN o ON o.g = a.g AND o.k = a.k + 1))
          SELECT g AS event_type, max(ok) AS accepted, max(no) AS rejected, max(no) > 0 AS tripped FROM a GROUP BY g""")
def churn_breaker(spark, d):
    born = points(spark, d, 1).groupBy("event_type", "user_id").agg(F.min("w").alias("w"))
    return encode.breaker(born, ["event_type"], "w", 10, 24)


@query("""WITH e AS (SELECT event_id, user_id % 3 AS emitter, ts, (day(ts) - 1) // 7 - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS epoch FROM events)
          SELECT event_id, emitter, epoch FROM (SELECT *, max(epoch) OVER (PARTITION BY emitter ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM e) WHERE epoch >= top""")
def late_epoch_drop(spark, d):
    epoch = F.floor((F.dayofmonth("ts") - 1) / 7) - F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    rows = events(spark, d).select("event_id", (F.col("user_id") % 3).alias("emitter"), "ts", epoch.cast("long").alias("epoch"))
    return analyze.late_epochs_dropped(rows, "emitter", ["ts", "event_id"]).select("event_id", "emitter", "epoch")


@query(f"SELECT w, emitter, min(event_id) AS event_id FROM (SELECT CAST(floor(epoch(ts) / {3600 * HOURS}) AS BIGINT) AS w, user_id % 3 AS emitter, event_id FROM events) GROUP BY ALL")
def dedup_contributors(spark, d):
    rows = points(spark, d).select("w", (F.col("user_id") % 3).alias("emitter"), "event_id")
    return analyze.contributors_once(rows, ["w"], "emitter", [F.col("event_id")])


@query(f"""WITH e AS (SELECT event_id, user_id % 4 AS shard, CAST(floor(epoch(ts) / {3600 * HOURS}) AS BIGINT) AS w, ts, value > 95 AS bad, event_type = 'signup' AS heal, event_type = 'view' AS residual FROM events),
           g AS (SELECT *, last_value(CASE WHEN bad THEN true WHEN heal THEN false END IGNORE NULLS) OVER (PARTITION BY shard ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deg FROM e)
           SELECT event_id, shard FROM g WHERE NOT (coalesce(deg, false) AND residual)""")
def degraded_gate(spark, d):
    rows = events(spark, d).select("event_id", (F.col("user_id") % 4).alias("shard"), "ts", (F.col("value") > 95).alias("bad"), (F.col("event_type") == "signup").alias("heal"), (F.col("event_type") == "view").alias("residual"))
    return analyze.degraded_dropped(rows, ["shard"], ["ts", "event_id"], "bad", "heal", "residual").select("event_id", "shard")


@query("""WITH a AS (SELECT event_id, user_id % 4 AS shard, user_id % 3 AS emitter, floor(epoch(ts) / 21600)::BIGINT AS w, floor(epoch(ts)) AS t FROM events),
          f AS (SELECT shard, w, arg_min(event_id, (t, event_id)) AS first_id, min(t) AS first_t FROM a GROUP BY ALL),
          o AS (SELECT a.*, t - first_t AS skew, row_number() OVER (PARTITION BY shard, emitter ORDER BY t, event_id) AS k FROM a JOIN f USING (shard, w) WHERE event_id <> first_id)
          SELECT o.event_id, o.shard, o.emitter, o.w, o.skew FROM o LEFT JOIN o p ON p.shard = o.shard AND p.emitter = o.emitter AND p.k = o.k - 1 WHERE o.skew > 9000 AND (p.skew IS NULL OR p.skew <= 9000)""")
def clock_skew(spark, d):
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("double")
    rows = points(spark, d).select("event_id", (F.col("user_id") % 4).alias("shard"), (F.col("user_id") % 3).alias("emitter"), "w", at.alias("at"))
    return analyze.clock_skew(rows, ["shard"], "w", ["shard", "emitter"], "at", ["event_id"], 9000.0).select("event_id", "shard", "emitter", "w", "skew")


@query(f"SELECT w, count(DISTINCT user_id % 8) AS present, 8 AS expected, round(count(DISTINCT user_id % 8) / 8.0, 6) AS share FROM (SELECT CAST(floor(epoch(ts) / {3600 * HOURS}) AS BIGINT) AS w, user_id FROM events) GROUP BY w")
def emitter_coverage(spark, d):
    rows = points(spark, d).select("w", (F.col("user_id") % 8).alias("emitter"))
    return analyze.coverage(rows, ["w"], "emitter", 8).withColumn("share", rounded("share"))


@query("SELECT user_id, event_type, value FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id) WHERE event_type <> 'error'")
def dictionary_state(spark, d):
    rows = events(spark, d).select("user_id", "ts", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("tombstone"))
    return analyze.dictionary(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT user_id % 4 AS shard, event_type || '|' || user_id AS name FROM events GROUP BY ALL HAVING bool_and(value > 2)")
def ownership_eviction(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 4).alias("shard"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("name"), (F.col("user_id") % 3).alias("emitter"), (F.col("value") > 2).alias("released"))
    return analyze.evicted(rows, ["shard"], "name", "emitter", "released")


@query("SELECT DISTINCT event_type, user_id FROM events WHERE day(ts) <= 15 EXCEPT SELECT event_type, user_id FROM events WHERE day(ts) > 15 AND value > 40")
def golden_reconcile(spark, d):
    e = events(spark, d)
    mirror = e.where(F.dayofmonth("ts") <= 15).select("event_type", "user_id").distinct()
    return analyze.implicit_tombstones(mirror, e.where((F.dayofmonth("ts") > 15) & (F.col("value") > 40)), ["event_type", "user_id"])


@query(f"""WITH {S}, k AS (SELECT w, g, n % 3 <> 0 AS matches, w % 4 = 0 AS golden FROM f),
           h AS (SELECT *, coalesce(sum((matches AND golden)::INT) OVER (PARTITION BY g ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k),
           o AS (SELECT g, run, min(CASE WHEN NOT matches THEN w END) AS broken, max(CASE WHEN matches AND golden THEN w END) AS healed FROM h GROUP BY ALL)
           SELECT g AS event_type, broken, healed, healed - broken AS windows FROM o WHERE broken IS NOT NULL AND healed > broken""")
def root_heal_times(spark, d):
    rows = folded(spark, d).select("w", "event_type", (F.col("count") % 3 != 0).alias("matches"), (F.col("w") % 4 == 0).alias("golden"))
    return analyze.heal_times(rows, ["event_type"], "w", "matches", "golden")


_W = f"CAST(floor(epoch(ts) / {3600 * HOURS}) AS BIGINT)"
_DET = f"""det AS (SELECT user_id % 4 AS shard_id, (event_id % 2)::INT AS view_id, event_type || '|' || user_id % 10 AS series, {_W} AS w,
            CASE WHEN event_id % 7 = 0 THEN 'absence' WHEN event_id % 3 = 0 THEN 'keyframe' ELSE 'deviation' END AS substrate, (event_id % 3)::INT AS revision, floor(epoch(ts)) AS detected_at, value FROM events),
       can AS (SELECT shard_id, view_id, series, w, arg_min(substrate, (detected_at, substrate)) AS substrate, min(detected_at) AS detected_at, arg_max(value, (revision, detected_at, value)) AS value, max(revision) AS revision FROM det WHERE substrate <> 'absence' GROUP BY ALL),
       tr AS (SELECT event_id AS ix, event_type || '|' || user_id % 10 AS series, CASE event_id % 4 WHEN 0 THEN 'drift' WHEN 1 THEN 'birth' ELSE 'anomaly' END AS type, {_W} AS ws, {_W} + event_id % 3 AS we, value AS magnitude, value + 10 AS expected_value, floor(epoch(ts)) AS since FROM events WHERE event_id % 5 = 0),
       hit AS (SELECT c.shard_id, c.view_id, c.series, c.w, t.*, row_number() OVER (PARTITION BY c.shard_id, c.view_id, c.series, c.w ORDER BY t.ix) AS rn FROM can c JOIN (SELECT ix, series AS s2, type, ws, we, magnitude, expected_value, since FROM tr WHERE type IN ('anomaly', 'drift')) t ON c.series = t.s2 AND c.w BETWEEN t.ws AND t.we),
       mat AS (SELECT can.*, ix, type, magnitude, expected_value, since FROM can LEFT JOIN (SELECT * FROM hit WHERE rn = 1) USING (shard_id, view_id, series, w)),
       lif AS (SELECT DISTINCT m.shard_id, m.view_id, m.series, m.w FROM mat m JOIN tr l ON l.type = 'birth' AND l.series = m.series AND m.w - l.ws BETWEEN -1 AND 1 WHERE m.ix IS NULL AND m.substrate = 'deviation')"""


def seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("double")


def named_series() -> Column:
    return F.concat_ws("|", "event_type", (F.col("user_id") % 10).cast("string"))


def detections(spark, d):
    e = F.col("event_id")
    rows = points(spark, d).select(
        (F.col("user_id") % 4).alias("shard_id"), (e % 2).cast("int").alias("view_id"), named_series().alias("series"), "w",
        F.when(e % 7 == 0, "absence").when(e % 3 == 0, "keyframe").otherwise("deviation").alias("substrate"), (e % 3).cast("int").alias("revision"), seconds(F.col("ts")).alias("detected_at"), "value")
    return analyze.canonical_detections(rows)


def truth(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "drift").when(e % 4 == 1, "birth").otherwise("anomaly")
    return points(spark, d).where(e % 5 == 0).select(e.alias("ix"), named_series().alias("series"), kind.alias("type"), F.col("w").alias("window_start"), (F.col("w") + e % 3).alias("window_end"), F.col("value").alias("magnitude"), (F.col("value") + 10).alias("expected_value"), seconds(F.col("ts")).alias("at"))


def matched(spark, d):
    return analyze.matched_truth(detections(spark, d), truth(spark, d), ["series"])


@query(f"WITH {_DET} SELECT shard_id, view_id, series, w, substrate, round(detected_at, 6) AS detected_at, value, revision FROM can")
def canonical_detections(spark, d):
    return detections(spark, d).withColumn("detected_at", rounded("detected_at"))


@query(f"WITH {_DET} SELECT shard_id, view_id, series, w, ix, type FROM mat")
def truth_interval_match(spark, d):
    return matched(spark, d).select("shard_id", "view_id", "series", "w", "ix", "type")


def births(spark, d):
    return truth(spark, d).where("type = 'birth'").select("series", F.col("window_start").alias("at"))


@query(f"WITH {_DET} SELECT shard_id, view_id, series, w FROM lif")
def lifecycle_band_match(spark, d):
    return analyze.near_lifecycle(matched(spark, d).where("ix is null"), births(spark, d), ["series"]).select("shard_id", "view_id", "series", "w")


@query(f"""WITH {_DET}, x AS (SELECT *, CASE WHEN substrate = 'keyframe' THEN expected_value ELSE magnitude END AS e FROM mat WHERE type = 'anomaly')
           SELECT (SELECT count(*) FROM mat) AS detections, (SELECT count(ix) FROM mat) AS true_detections, (SELECT count(DISTINCT ix) FROM mat) AS found, (SELECT count(*) FROM tr WHERE type <> 'birth') AS truths,
           (SELECT round(count(ix) / count(*), 6) FROM mat) AS "precision", (SELECT round(count(DISTINCT ix) / (SELECT count(*) FROM tr WHERE type <> 'birth'), 6) FROM mat) AS recall,
           (SELECT round(avg(abs(value - e) / abs(e)), 6) FROM x WHERE e <> 0) AS mape, (SELECT count(*) FROM x WHERE e <> 0) AS mape_samples,
           (SELECT round(avg((abs(value - e) <= CASE WHEN e = 0 THEN 1e-9 ELSE 0.1::DOUBLE * abs(e) END)::INT), 6) FROM x WHERE revision > 0) AS revision_accuracy, (SELECT count(*) FROM x WHERE revision > 0) AS revision_samples,
           (SELECT count(*) FROM lif) AS lifecycle_false""")
def precision_recall(spark, d):
    out = analyze.scores(matched(spark, d), truth(spark, d), births(spark, d), ["series"])
    shares = ("precision", "recall", "mape", "revision_accuracy")
    return out.select("detections", "true_detections", "found", "truths", "mape_samples", "revision_samples", "lifecycle_false", *[rounded(c).alias(c) for c in shares])


@query(f"WITH {_DET} SELECT t.type, count(*) AS truths, count(m.ix) AS recalled, round(count(m.ix) / count(*), 6) AS recall FROM tr t LEFT JOIN (SELECT DISTINCT ix FROM mat WHERE ix IS NOT NULL) m ON m.ix = t.ix WHERE t.type <> 'birth' GROUP BY t.type")
def recall_by_type(spark, d):
    return analyze.recall_by_type(matched(spark, d), truth(spark, d)).withColumn("recall", rounded("recall"))


@query(f"""WITH {_DET}, l AS (SELECT substrate, detected_at - since AS s, row_number() OVER (PARTITION BY substrate ORDER BY detected_at - since) - 1 AS k, count(*) OVER (PARTITION BY substrate) AS c FROM mat WHERE ix IS NOT NULL)
           SELECT substrate, count(*) AS n, round(avg(s), 6) AS mean, max(CASE WHEN k = least(floor(c * 0.95::DOUBLE)::BIGINT, c - 1) THEN s END) AS p95 FROM l GROUP BY substrate""")
def detection_latency(spark, d):
    rows = matched(spark, d).where("ix is not null").withColumn("latency", F.col("detected_at") - F.col("truth_at"))
    return analyze.latency_summary(rows, ["substrate"], "latency").withColumn("mean", rounded("mean"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events)
          SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN k = least(floor(c * 0.95::DOUBLE)::BIGINT, c - 1) + 1 THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_p95(spark, d):
    return analyze.latency_summary(events(spark, d), ["event_type"], "value").withColumn("mean", rounded("mean"))


@query("""SELECT day(ts)::INT AS day, sum(CASE WHEN event_type = 'view' THEN 78 + length(props) ELSE 0 END)::BIGINT AS view_bytes, sum(CASE WHEN event_type = 'click' THEN 78 + length(props) ELSE 0 END)::BIGINT AS click_bytes, sum(78 + length(props))::BIGINT AS total_bytes FROM events GROUP BY day(ts)""")
def byte_ledger_by_day(spark, d):
    rows = events(spark, d).select(F.dayofmonth("ts").alias("day"), "event_type", F.col("props").cast("binary").alias("payload"), F.lit(None).cast("binary").alias("snapshot_blob"), F.lit(None).cast("array<struct<id: bigint, flags: smallint, init_value: float, name: string>>").alias("dict_deltas"))
    sized = encode.frame_sizes(rows).withColumn("encoded_size", F.col("encoded_size").cast("long"))
    return analyze.byte_ledger(sized, "day", "event_type", "encoded_size", ["view", "click"])


@query("SELECT event_type, user_id % 4 AS shard, count(*) AS frames, sum(length(props))::BIGINT AS bytes, round(avg(length(props)), 6) AS mean_bytes, max(length(props))::BIGINT AS max_bytes FROM events GROUP BY ALL")
def frame_counters(spark, d):
    rows = events(spark, d).select("event_type", (F.col("user_id") % 4).alias("shard"), F.length("props").cast("long").alias("bytes"))
    return analyze.counters(rows, ["event_type", "shard"]).withColumn("mean_bytes", rounded("mean_bytes"))


@query("SELECT t AS threshold, round(count_if(value > t) / 30.0, 6) AS events_per_day FROM events, (VALUES (10.0::DOUBLE), (30.0), (60.0), (90.0)) AS g(t) GROUP BY t")
def calibration_grid(spark, d):
    return analyze.threshold_grid(events(spark, d), "value", 30.0, [10, 30, 60, 90]).withColumn("events_per_day", rounded("events_per_day"))


_BU = f"""bu AS (SELECT event_id AS ix, event_type AS series, {_W} AS start, {_W} + event_id % 3 AS "end" FROM events WHERE event_id % 97 = 0),
           hi AS (SELECT 'sum' AS detector, g AS series, w FROM f WHERE sum > 300 UNION ALL SELECT 'count', g, w FROM f WHERE n > 15)"""


def detector_hits(spark, d):
    f = folded(spark, d)
    return f.where("sum > 300").select(F.lit("sum").alias("detector"), F.col("event_type").alias("series"), "w").unionByName(f.where("count > 15").select(F.lit("count").alias("detector"), F.col("event_type").alias("series"), "w"))


def bursts(spark, d):
    return points(spark, d).where("event_id % 97 = 0").select(F.col("event_id").alias("ix"), F.col("event_type").alias("series"), F.col("w").alias("start"), (F.col("w") + F.col("event_id") % 3).alias("end"))


@query(f"""WITH {S}, {_BU}, p AS (SELECT * FROM bu, (SELECT DISTINCT detector FROM hi))
           SELECT p.ix, p.detector, min(hi.w - p.start) AS lag, min(hi.w - p.start) IS NOT NULL AS detected, count(hi.w) AS hits, coalesce(count_if(hi.w <= p."end") >= 2, false) AS persisted
           FROM p LEFT JOIN hi ON hi.detector = p.detector AND hi.series = p.series AND hi.w >= p.start AND hi.w < p."end" + 6 GROUP BY p.ix, p.detector""")
def detector_scores(spark, d):
    return analyze.detector_scores(bursts(spark, d), detector_hits(spark, d), persist=2).select("ix", "detector", "lag", "detected", "hits", "persisted")


@query(f"""WITH {S}, {_BU} SELECT detector, w // 4 AS day, count(*) AS spurious FROM hi WHERE NOT EXISTS (SELECT 1 FROM bu WHERE bu.series = hi.series AND hi.w >= bu.start AND hi.w < bu."end" + 6) GROUP BY ALL""")
def spurious_hits(spark, d):
    return analyze.spurious_hits(bursts(spark, d), detector_hits(spark, d), 24 // HOURS)


@query("""WITH c AS (SELECT user_id % 4 AS noise, (day(ts) // 6)::INT AS magnitude, avg((value > 2)::INT) AS rate, count(*) AS n FROM events GROUP BY ALL),
          o AS (SELECT *, min(rate) OVER (PARTITION BY noise ORDER BY magnitude ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM c)
          SELECT noise, min(CASE WHEN low >= 0.9 THEN magnitude END) AS floor FROM o GROUP BY noise""")
def deadzone_floors(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 4).alias("noise"), F.floor(F.dayofmonth("ts") / 6).cast("int").alias("magnitude"), (F.col("value") > 2).alias("found"))
    return analyze.recovery_floor(analyze.cell_rates(rows, ["noise", "magnitude"], ["found"]), "noise", "magnitude", "found_rate")


@query("""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE value > 80), s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS taken_at, value AS snapshot_value FROM events WHERE event_type = 'error')
          SELECT e.event_id, e.user_id, taken_at, snapshot_value, t - taken_at AS latency_s FROM (SELECT e.*, s.taken_at, s.snapshot_value, row_number() OVER (PARTITION BY event_id ORDER BY taken_at DESC NULLS LAST, snapshot_value DESC) AS rn FROM e LEFT JOIN s ON s.user_id = e.user_id AND taken_at <= t AND taken_at >= t - 86400) e WHERE rn = 1""")
def forensic_snapshots(spark, d):
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    rows = events(spark, d).withColumn("at", at)
    snaps = rows.where("event_type = 'error'").select("user_id", F.col("at").alias("taken_at"), F.col("value").alias("snapshot_value"))
    return analyze.snapshots_of(rows.where("value > 80").select("event_id", "user_id", "at"), snaps, "user_id", "at", 86400).select("event_id", "user_id", "taken_at", "snapshot_value", "latency_s")


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) SELECT event_type, round(quantile_cont(abs(value - m), 0.5) / 0.6745, 6) AS sigma FROM events JOIN m USING (event_type) GROUP BY event_type""")
def mad_sigma(spark, d):
    return conformal.mad_sigma(events(spark, d), ["event_type"], "value").withColumn("sigma", rounded("sigma"))


@query(f"WITH {S} SELECT w, g AS event_type, round(quantile_cont(sum, 0.5) OVER (PARTITION BY g ORDER BY w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS median FROM f")
def rolling_quiet_sigma(spark, d):
    return conformal.rolling_median(folded(spark, d), ["event_type"], "w", "sum", 20).select("w", "event_type", rounded("median").alias("median"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def window_quantiles(spark, d):
    return conformal.window_quantiles(events(spark, d), ["event_type"], "value").select("event_type", *[rounded(c).alias(c) for c in ("p50", "p95", "p99")])


@query("WITH h AS (SELECT user_id, quantile_cont(value, 0.95) AS p FROM events GROUP BY 1) SELECT round((SELECT quantile_cont(value, 0.95) FROM events), 6) AS pooled, round(avg(p), 6) AS averaged FROM h")
def pooled_vs_avg_p95(spark, d):
    e = events(spark, d)
    each = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.95)).alias("p")).agg(rounded(F.avg("p")).alias("averaged"))
    return e.agg(rounded(F.percentile("value", F.lit(0.95))).alias("pooled")).crossJoin(each)  # one row by one row


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q_lo, round(quantile_cont(value, 0.95), 6) AS q_hi FROM events WHERE day(ts) <= 20 GROUP BY 1")
def constant_band(spark, d):
    return conformal.constant_band(events(spark, d).where(F.dayofmonth("ts") <= 20), ["event_type"], "value", 0.1).select("event_type", rounded("q_lo").alias("q_lo"), rounded("q_hi").alias("q_hi"))


_MAD = """v AS (SELECT g, w, sum AS y, array_agg(sum) OVER (PARTITION BY g ORDER BY w ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS a FROM f),
          md AS (SELECT g, w, y, a, list_aggregate(a, 'quantile_cont', 0.5) AS med FROM v), ma AS (SELECT g, w, y, list_aggregate(list_transform(a, lambda x: abs(x - med)), 'quantile_cont', 0.5) AS mad FROM md)"""


@query(f"WITH {S}, {_MAD} SELECT g AS event_type, w, round(mad, 6) AS mad FROM ma")
def rolling_mad(spark, d):
    return conformal.rolling_mad(folded(spark, d), ["event_type"], "w", "sum").select("event_type", "w", rounded("mad").alias("mad"))


@query(f"WITH {S}, {_MAD}, q AS (SELECT g, quantile_cont(sum, 0.05) AS lo, quantile_cont(sum, 0.95) AS hi FROM f GROUP BY g) SELECT g AS event_type, w, round(greatest(lo - y, y - hi) / greatest(mad, 1.0), 6) AS score FROM ma JOIN q USING (g)")
def cqr_score(spark, d):
    f = folded(spark, d)
    rows = conformal.rolling_mad(f, ["event_type"], "w", "sum").join(conformal.constant_band(f, ["event_type"], "sum", 0.1), "event_type")
    return rows.select("event_type", "w", rounded(numeric.interval_score(F.col("sum"), F.col("q_lo"), F.col("q_hi"), F.col("mad"), 1.0)).alias("score"))


_BINS = """SELECT event_type, sign(value)::INT AS sign, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / ln((1 + 0.01::DOUBLE) / (1 - 0.01::DOUBLE)))::INT END AS bin, {w} AS weight FROM events{x} GROUP BY 1, 2, 3"""
_QUANTILE = """c AS (SELECT *, sum(weight) OVER (PARTITION BY event_type ORDER BY sign * CASE WHEN sign = 0 THEN 0 ELSE bin + 100000 END) AS cum, sum(weight) OVER (PARTITION BY event_type) AS tot FROM b WHERE weight > 0),
               q AS (SELECT event_type, arg_min(sign, sign * (bin + 100000)) AS sign, arg_min(bin, sign * (bin + 100000)) AS bin FROM c WHERE cum > {q} * (tot - 1) GROUP BY 1)
               SELECT event_type, round(CASE WHEN sign = 0 THEN 0.0::DOUBLE ELSE sign * 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, bin) / (1.01::DOUBLE / 0.99::DOUBLE + 1) END, 6) AS quantile FROM q"""


@query(f"WITH b AS ({_BINS.format(w='count(*)::DOUBLE', x='')}), {_QUANTILE.format(q='0.95::DOUBLE')}")
def sketch_quantiles(spark, d):
    bins = conformal.sketch_bins(events(spark, d), ["event_type"], "value")
    return conformal.sketch_quantile(bins, ["event_type"], 0.95).withColumn("quantile", rounded("quantile"))


@query(f"WITH b AS ({_BINS.format(w='sum(pow(0.9::DOUBLE, 30 - day(ts)))', x=' WHERE day(ts) BETWEEN 11 AND 30')}), {_QUANTILE.format(q='0.9::DOUBLE')}")
def decay_weighted_quantile(spark, d):
    rows = events(spark, d).withColumn("day", F.dayofmonth("ts"))
    ring = conformal.ring_weights(rows.select("day").distinct().where("day <= 30"), "day", capacity=20, decay=0.9)
    bins = conformal.sketch_bins(rows.join(F.broadcast(ring.withColumnRenamed("weight", "wt")), "day"), ["event_type"], "value", weight=F.col("wt"))  # a row for each day of a month
    return conformal.sketch_quantile(bins, ["event_type"], 0.9).withColumn("quantile", rounded("quantile"))


@query(f"""WITH n AS (SELECT event_type, count(*) AS n, ceil((count(*) + 1) * (1 - 0.1::DOUBLE)) / count(*) AS level FROM events GROUP BY 1), b AS ({_BINS.format(w='count(*)::DOUBLE', x='')}),
           c AS (SELECT b.*, level, sum(weight) OVER (PARTITION BY event_type ORDER BY sign * CASE WHEN sign = 0 THEN 0 ELSE bin + 100000 END) AS cum, sum(weight) OVER (PARTITION BY event_type) AS tot FROM b JOIN n USING (event_type)),
           q AS (SELECT event_type, arg_min(sign, sign * (bin + 100000)) AS sign, arg_min(bin, sign * (bin + 100000)) AS bin FROM c WHERE cum > level * (tot - 1) GROUP BY 1),
           v AS (SELECT event_type, sign * 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, bin) / (1.01::DOUBLE / 0.99::DOUBLE + 1) AS quantile FROM q)
           SELECT event_type, n, round(level, 6) AS level, round(quantile + 0.01 * abs(quantile), 6) AS radius FROM n JOIN v USING (event_type)""")
def split_conformal_radius(spark, d):
    e = events(spark, d)
    out = conformal.split_radius(conformal.sketch_bins(e, ["event_type"], "value"), e.groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"], 0.1)
    return out.select("event_type", "n", rounded("level").alias("level"), rounded("radius").alias("radius"))


@query("SELECT event_type, round(sum(CASE WHEN day(ts) BETWEEN 10 AND 12 THEN 0.0::DOUBLE ELSE pow(0.9::DOUBLE, (SELECT max(day(ts)) FROM events) - day(ts)) END), 6) AS effective_n FROM events GROUP BY 1")
def effective_sample_size(spark, d):
    per = events(spark, d).groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))
    days = conformal.ring_weights(per.select("day").distinct(), "day", capacity=31, decay=0.9)
    w = per.join(conformal.masked(days, "day", [(10, 12)]), "day")
    return conformal.effective_n(w, ["event_type"]).withColumn("effective_n", rounded("effective_n"))


@query(f"""WITH RECURSIVE {S}, m AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY w) AS k, (sum > 400)::INT AS miss FROM f),
           a(g, k, alpha) AS (SELECT g, 0::BIGINT, 0.1::DOUBLE FROM (SELECT DISTINCT g FROM m) UNION ALL SELECT a.g, m.k, least(greatest(alpha + 0.05 * (0.1 - miss), 1e-6), 0.999) FROM a JOIN m ON m.g = a.g AND m.k = a.k + 1)
           SELECT g AS event_type, k::INT AS step, round(alpha, 6) AS alpha FROM a WHERE k > 0""")
def adaptive_alphas(spark, d):
    rows = folded(spark, d).select("event_type", "w", (F.col("sum") > 400).cast("int").alias("miss"))
    out = conformal.adaptive_alphas(rows, ["event_type"], "w", "miss", target=0.1, gamma=0.05)
    return out.select("event_type", F.posexplode("alphas").alias("step", "alpha")).select("event_type", (F.col("step") + 1).alias("step"), rounded("alpha").alias("alpha"))


def _tuned_sql() -> str:
    """The same recursion step by step, with the experts in columns."""
    rate = math.sqrt(3 / 50 * (math.log(4 * 50) + 2)) / (0.1 * 0.9)
    k4 = range(4)
    place = [f"(ceil(41 * (1 - a{k}::DOUBLE)) / 40 * 39)" for k in k4]
    radius = [f"CASE WHEN ceil(41 * (1 - a{k}::DOUBLE)) / 40 > 1 THEN 'infinity'::DOUBLE ELSE h[floor({place[k]})::INT + 1] + (h[least(floor({place[k]})::INT + 2, 40)] - h[floor({place[k]})::INT + 1]) * ({place[k]} - floor({place[k]})) END" for k in k4]
    over = ", ".join(f"y - {radius[k]} AS o{k}" for k in k4)
    loss = ", ".join(f"w{k} * CASE WHEN isinf(o{k}) THEN 1.0 ELSE exp(-{rate!r}::DOUBLE * greatest(0.9::DOUBLE * o{k}, -0.1::DOUBLE * o{k})) END AS v{k}, least(greatest(a{k} + {g}::DOUBLE * (0.1::DOUBLE - (o{k} > 0)::INT), 1e-6::DOUBLE), 0.999::DOUBLE) AS n{k}" for k, g in zip(k4, (0.002, 0.008, 0.032, 0.128), strict=True))
    total = "+".join(f"v{k}" for k in k4)
    shared = ", ".join(f"n{k} AS a{k}, 0.99::DOUBLE * CASE WHEN {total} > 0 THEN v{k} / ({total}) ELSE 0.25::DOUBLE END + 0.0025::DOUBLE AS w{k}" for k in k4)
    start = ", ".join(f"0.1::DOUBLE AS a{k}, 0.25::DOUBLE AS w{k}" for k in k4)
    return f"""WITH RECURSIVE {S}, m AS (SELECT g, w, sum AS y, row_number() OVER (PARTITION BY g ORDER BY w) AS k FROM f),
        hh AS (SELECT g, list(y ORDER BY y) AS h FROM m WHERE k <= 40 GROUP BY g),
        t AS (SELECT g, 40::BIGINT AS k, NULL::BIGINT AS w, {start} FROM hh
              UNION ALL SELECT g, k, w, {shared} FROM (SELECT *, {loss} FROM (SELECT t.g, m.k, m.w, {", ".join(f"a{k}, w{k}" for k in k4)}, {over} FROM t JOIN m ON m.g = t.g AND m.k = t.k + 1 JOIN hh ON hh.g = t.g)))
        SELECT g AS event_type, w, round(ln(least(greatest({"+".join(f"a{k} * w{k}" for k in k4)}, 1e-6), 0.999)), 6) AS log_alpha FROM t WHERE k > 40"""


@query(_tuned_sql)
def tuned_alphas(spark, d):
    rows = folded(spark, d).select("event_type", "w", "sum")
    return conformal.tuned_alphas(rows, ["event_type"], "w", "sum", target=0.1, interval=50, calibration=40).select("event_type", "w", rounded(F.log("alpha")).alias("log_alpha"))


@query()
def seasonal_band(spark, d):
    """Exponential smoothing with searched rates; not for SQL."""
    rows = folded(spark, d).select("event_type", "w", "sum")
    return conformal.seasonal_band(rows, ["event_type"], "w", "sum", period=4, train=60)


@query(f"SELECT g AS shard, k AS support, n AS active, CASE WHEN k / n * 5 * 1.5 * 1.5 >= 3.0 THEN 'full' ELSE 'partial' END AS trust FROM (SELECT user_id % 4 AS g, count(DISTINCT CASE WHEN value > 90 THEN user_id END) AS k, count(DISTINCT user_id) AS n FROM events GROUP BY 1)")
def merged_trust(spark, d):
    rows = events(spark, d).groupBy((F.col("user_id") % 4).alias("shard")).agg(F.count_distinct(F.when(F.col("value") > 90, F.col("user_id"))).alias("support"), F.count_distinct("user_id").alias("active"))
    return rows.withColumn("trust", numeric.merged_trust(F.col("support"), F.col("active"), F.lit(5), 1.5))


@query("""WITH q AS (SELECT event_type, greatest(max(abs(value)) / 127, 1e-6)::FLOAT::DOUBLE AS s FROM events GROUP BY 1)
          SELECT event_id, least(greatest(round(value / s), -128), 127)::INT AS step, round(least(greatest(round(value / s), -128), 127) * s, 6) AS back FROM events JOIN q USING (event_type)""")
def quantized_values(spark, d):
    e = events(spark, d)
    scale = e.groupBy("event_type").agg(numeric.adaptive_scale(F.max(F.abs("value"))).alias("scale"))
    step = numeric.quantized(F.col("value"), F.col("scale"))
    return e.join(scale, "event_type").withColumn("step", step).select("event_id", "step", rounded(numeric.dequantized(F.col("step"), F.col("scale"))).alias("back"))


@query("SELECT event_id, round(sign(value - 50) * greatest(abs(value - 50) - 10, 0.0), 6) + 0.0 AS shrunk, round(10 + 1.0 / 0.2 * (pow(1 - (event_id % 1000 + 0.5) / 1000.0::DOUBLE, -0.2) - 1), 6) AS tail FROM events")
def scalar_functions(spark, d):
    p = (F.col("event_id") % 1000 + 0.5) / 1000.0
    return events(spark, d).select("event_id", (rounded(numeric.soft_threshold(F.col("value") - 50, F.lit(10.0))) + 0.0).alias("shrunk"), rounded(numeric.pareto_quantile(p, 0.2, 1.0, 10.0)).alias("tail"))


@query("SELECT event_id, CAST(floor((epoch(ts) - 1800) / 604800) AS BIGINT) AS epoch FROM events")
def epoch_indexes(spark, d):
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return events(spark, d).select("event_id", hashing.epoch_index(at, 604800, 1800).alias("epoch"))


@query(lambda: f"WITH {hashes_sql()} SELECT DISTINCT name, CASE WHEN id >= 9223372036854775808 THEN (id - 18446744073709551616::HUGEINT)::BIGINT ELSE id::BIGINT END AS series_id FROM events JOIN hx ON hx.name = event_type || '|' || user_id")
def series_ids(spark, d):
    return user_series(spark, d).select("name").distinct().withColumn("series_id", hashing.series_id(F.col("name")))


def hashed_sketch(spark, d):
    rows = user_residuals(spark, d).where(F.col("w") % EVERY != 0).withColumn("emitter", F.length("name") % 3)
    per = encode.sketch(rows, ["w", "emitter"], seed=SEED, m=BUCKETS, d=HASHES)
    return encode.merged_sketch(per, ["w"], "emitter")


@query(lambda: f"WITH {U}, {hashes_sql()}, {_Y} SELECT w, bucket, round(y, 6) AS y, coverage FROM y")
def merged_sketches(spark, d):
    return hashed_sketch(spark, d).select("w", "bucket", rounded("y").alias("y"), "coverage")


@query(lambda: f"""WITH {U}, {hashes_sql()}, {_Y}, e AS (SELECT w, sqrt(sum(y * y) / {BUCKETS}) AS error FROM y GROUP BY w),
                   q AS (SELECT w, r.name, unnest(bs) AS bucket, unnest(ss) AS sgn FROM r JOIN hx ON hx.name = r.name WHERE w % {EVERY} <> 0)
                   SELECT q.w, q.name, round(quantile_cont(sgn * coalesce(y, 0) * sqrt({HASHES}::DOUBLE), 0.5), 6) + 0.0 AS estimate, round(any_value(error), 6) AS error FROM q JOIN e ON e.w = q.w LEFT JOIN y ON y.w = q.w AND y.bucket = q.bucket GROUP BY q.w, q.name""")
def point_queries(spark, d):
    names = user_residuals(spark, d).where(F.col("w") % EVERY != 0).select("w", "name").distinct()
    out = encode.point_query(names, hashed_sketch(spark, d), ["w"], seed=SEED, m=BUCKETS, d=HASHES)
    return out.select("w", "name", (rounded("estimate") + 0.0).alias("estimate"), rounded("error").alias("error"))


@query()
def sparse_recovery(spark, d):
    """Iterative solves over all residuals; tests hold them against planted signals."""
    rows = user_residuals(spark, d).where(F.col("w") % EVERY != 0)
    s = encode.sketch(rows, ["w"], seed=SEED, m=256, d=HASHES)
    names = user_series(spark, d).select("name").distinct().withColumn("grp", F.split_part("name", F.lit("|"), F.lit(1)))
    return recovery.recovered(s, names, ["w"], seed=SEED, m=256, d=HASHES, group="grp")


def frames_of(spark, d) -> DataFrame:
    """Frames of each shard's views by hour from three emitters, some a few windows late or twice."""
    emitter = F.col("user_id") % 3
    p = points(spark, d, 1).groupBy((F.col("user_id") % 2).cast("string").alias("shard"), (F.col("user_id") % 4).cast("string").alias("view"), "w", emitter.alias("e")).agg(rounded(F.sum("value")).alias("value"))
    late = F.when((F.col("w") * 7 + F.col("e") * 3) % 10 == 0, 1 + (F.col("w") + F.col("e")) % 4).otherwise(0)
    p = p.withColumn("arrival", F.concat_ws("/", F.lpad((F.col("w") + late).cast("string"), F.lit(12), F.lit("0")), "shard", "view", F.col("w").cast("string"), F.col("e").cast("string")))
    p = p.select("shard", "view", "w", F.col("e").cast("string").alias("emitter"), "value", "arrival")
    return p.unionByName(p.where("(w + cast(emitter as int)) % 13 = 0"))


@query("""WITH p AS (SELECT (user_id % 2)::VARCHAR AS shard, (user_id % 4)::VARCHAR AS view, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w, user_id % 3 AS e, round(sum(value), 6) AS value FROM events GROUP BY ALL),
          o AS (SELECT *, row_number() OVER (PARTITION BY shard, view ORDER BY w + CASE WHEN (w * 7 + e * 3) % 10 = 0 THEN 1 + (w + e) % 4 ELSE 0 END, w::VARCHAR, e::VARCHAR) AS k FROM p),
          t AS (SELECT *, max(w) OVER (PARTITION BY shard, view ORDER BY k) AS top FROM o),
          f AS (SELECT shard, view, w, min(k) AS k0 FROM o GROUP BY ALL),
          s AS (SELECT f.shard, f.view, f.w, min(t.k) AS k1 FROM f JOIN t ON t.shard = f.shard AND t.view = f.view AND t.k >= f.k0 AND t.top > f.w GROUP BY ALL),
          r AS (SELECT shard, view, w, greatest(k, k1) AS solved, count(*) AS n, sum(value) AS v FROM o JOIN s USING (shard, view, w) GROUP BY ALL)
          SELECT shard, view, w, (row_number() OVER z - 1)::INT AS revision, (sum(n) OVER z)::INT AS coverage, round(sum(v) OVER z, 6) AS total FROM r WINDOW z AS (PARTITION BY shard, view, w ORDER BY solved)""")
def repaired_windows(spark, d):
    """What a stream with repairs gives over a finished log."""
    return windows.replayed(frames_of(spark, d)).withColumn("total", rounded("total"))


_FREEZE = """WITH RECURSIVE {S}, m AS (SELECT g, w, sum AS v, row_number() OVER (PARTITION BY g ORDER BY w) AS k FROM f{where}),
           z(g, k, w, v, used, ref, frozen, calm, out) AS (SELECT g, 1::BIGINT, w, v, v, v, false, 1, false FROM m WHERE k = 1
             UNION ALL SELECT z.g, m.k, m.w, m.v, z.ref, CASE WHEN abs(m.v - z.ref) > {t} OR (z.frozen AND z.calm + 1 < 3) THEN z.ref ELSE m.v END,
                              abs(m.v - z.ref) > {t} OR (z.frozen AND z.calm + 1 < 3), CASE WHEN abs(m.v - z.ref) > {t} THEN 0 ELSE z.calm + 1 END, abs(m.v - z.ref) > {t} FROM z JOIN m ON m.g = z.g AND m.k = z.k + 1)"""


@query(f"{_FREEZE.format(S=S, where=' WHERE w % 3 = 0', t=150)} SELECT g AS event_type, w, round(v - used, 6) AS moved FROM z WHERE out")
def cadence_drift(spark, d):
    return encode.cadence_drift(folded(spark, d), ["event_type"], 3, 150.0, value="sum").select("event_type", "w", rounded(F.col("value") - F.col("reference")).alias("moved"))


@query(f"WITH {U} SELECT name, arg_max(value, w) AS value, max(w) AS last_seen FROM u WHERE w <= 19740 GROUP BY name HAVING 19740 - max(w) < 5")
def active_values(spark, d):
    return encode.active_values(user_series(spark, d), ["name"], "w", "value", 19740, 5)


@query("SELECT event_type, round(sum(length(props) * 3) / sum(2), 6) AS raw_per_entry, round(sum(length(props)) / sum(2), 6) AS packed_per_entry, round(sum(length(props) * 2) / sum(78 + length(props) * 3) * 100, 6) AS saved_percent FROM events GROUP BY 1")
def shadow_gauges(spark, d):
    n = F.length("props").cast("long")
    log = events(spark, d).select("event_type", (n * 3).alias("raw"), n.alias("packed"), F.lit(2).alias("entries"), (n * 3 + 78).alias("total"))
    out = analyze.shadow_gauges(log, ["event_type"])
    return out.select("event_type", *[rounded(c).alias(c) for c in ("raw_per_entry", "packed_per_entry", "saved_percent")])


@query("SELECT user_id, event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 256")
def newest_alerts(spark, d):
    return analyze.newest_alerts(events(spark, d).select("user_id", "event_id", "ts"), ["ts", "event_id"])


@query("SELECT event_type, count_if(value > 50)::BIGINT AS found, count(*) AS tried, round(count_if(value > 50) / count(*), 6) AS rate FROM events GROUP BY 1")
def pooled_rates(spark, d):
    runs = events(spark, d).groupBy("event_type", (F.col("user_id") % 5).alias("run")).agg(F.count_if(F.col("value") > 50).alias("hit"), F.count("*").alias("n"))
    return analyze.pooled_rates(runs, ["event_type"], "hit", "n").withColumn("rate", rounded("rate"))


@query("SELECT e.event_id, p.p_name AS series_name FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id * 20")
def stamped_events(spark, d):
    names = spark.read.parquet(os.path.join(d, "part.parquet")).select(F.col("p_partkey").alias("series_id"), F.col("p_name").alias("name"))
    return analyze.stamped(events(spark, d).select("event_id", (F.col("user_id") * 20).alias("series_id")), names).select("event_id", "series_name")


@query(f"{_FREEZE.format(S=S, where='', t=200)} SELECT g AS event_type, w, round(used, 6) AS reference, out FROM z")
def frozen_references(spark, d):
    return encode.frozen_references(folded(spark, d), ["event_type"], "w", "sum", 200.0).select("event_type", "w", rounded("reference").alias("reference"), "out")
