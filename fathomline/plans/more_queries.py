"""More queries over the ``events`` table: states of keyframes, counters, snapshots, sizes, calibration, generators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fathomline.functions import hashing, numeric
from fathomline.operators import analyze, conformal, encode, recovery, simulate
from fathomline.plans.queries import BUCKETS, EVERY, GOLDEN, SEED, S, TTL, U, A, HASHES, _W, _Y, events, folded, hashed_sketch, hashes_sql, last_window, points, query, rounded, seconds, user_residuals, user_series
from fathomline.sources import synthetic

_LOG = """lg AS (SELECT event_id, user_id % 4 AS shard, ts, CASE event_type WHEN 'error' THEN 'gate' WHEN 'signup' THEN 'golden' WHEN 'purchase' THEN 'kdelta' ELSE 'residual' END AS kind,
            event_id % 5 <> 0 AS root_ok, event_id % 11 <> 0 AS readable FROM events)"""


def frame_log(spark, d):
    kind = F.when(F.col("event_type") == "error", "gate").when(F.col("event_type") == "signup", "golden").when(F.col("event_type") == "purchase", "kdelta").otherwise("residual")
    return events(spark, d).select("event_id", (F.col("user_id") % 4).alias("shard"), "ts", kind.alias("kind"), (F.col("event_id") % 5 != 0).alias("root_ok"), (F.col("event_id") % 11 != 0).alias("readable"))


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, event_id) AS k FROM lg),
           z(shard, k, event_id, seen, degraded, open, mismatch, healed, dropped) AS (SELECT DISTINCT shard, 0::BIGINT, NULL::BIGINT, false, false, false, false, false, false FROM o
             UNION ALL SELECT shard, k, event_id, seen OR verified, CASE WHEN bad THEN true WHEN verified THEN false ELSE degraded END, CASE WHEN wrong THEN true WHEN verified THEN false ELSE open END,
                              wrong AND NOT open, verified AND open, kind = 'residual' AND degraded
             FROM (SELECT *, kind = 'gate' OR (kf AND (NOT usable OR wrong)) AS bad FROM (SELECT *, kf AND usable AND NOT root_ok AS wrong, kind = 'golden' AND readable AND root_ok AS verified FROM
                  (SELECT z.shard, o.k, o.event_id, o.kind, o.root_ok, z.seen, z.degraded, z.open, o.kind IN ('golden', 'kdelta') AS kf, o.readable AND (o.kind = 'golden' OR z.seen) AS usable, o.readable
                   FROM z JOIN o ON o.shard = z.shard AND o.k = z.k + 1))))
           SELECT event_id, degraded, mismatch, healed, dropped FROM z WHERE k > 0""")
def keyframe_states(spark, d):
    return analyze.keyframe_states(frame_log(spark, d), ["shard"], ["ts", "event_id"]).select("event_id", "degraded", "mismatch", "healed", "dropped")


@query("SELECT event_id, user_id, value, event_type = 'error' OR value > 50 AS gated FROM events")
def residual_gate(spark, d):
    solves = events(spark, d).select("event_id", "user_id", "value", (F.col("event_type") == "error").alias("fallback"), F.col("value").alias("residual"))
    ok, bad = analyze.gated(solves, 50.0)
    return ok.withColumn("gated", F.lit(False)).unionByName(bad.withColumn("gated", F.lit(True))).select("event_id", "user_id", "value", "gated")


_KINDS = [k for _, k in analyze.COUNTED] + ["solve", "heal", "full_dict", "block", "packed", "skew", "degrade"]
_COUNTERS = ", ".join([f"coalesce(sum(n) FILTER (WHERE kind = '{k}'), 0)::BIGINT AS {name}" for name, k in analyze.COUNTED])
_MEANS = ", ".join(f"floor(avg(ns) FILTER (WHERE kind = '{k}'))::BIGINT AS {name}" for name, k in (("recover_seconds_avg_ns", "solve"), ("snapshots_latency_avg_ns", "snapshot"), ("dict_root_heal_avg_ns", "heal")))
_SUMS = ", ".join(f"coalesce(sum(bytes) FILTER (WHERE kind = '{k}'), 0)::BIGINT AS {name}" for name, k in (("wire_bytes_total", "frame"), ("full_dict_keyframe_bytes", "full_dict"), ("dict_block_raw_bytes", "block"), ("dict_block_gzip_bytes", "packed")))


@query(f"""WITH k AS (SELECT user_id % 4 AS shard, [{", ".join(f"'{k}'" for k in _KINDS)}][(event_id % {len(_KINDS)})::INT + 1] AS kind, event_id % 3 + 1 AS n, length(props) AS bytes, event_id % 1000 AS ns, event_id % 77 AS ms, event_id AS t FROM events)
           SELECT shard, {_COUNTERS}, {_MEANS}, {_SUMS}, coalesce(sum(n) FILTER (WHERE kind = 'block'), 0)::BIGINT AS dict_block_entries, max(ns) FILTER (WHERE kind = 'heal') AS dict_root_heal_max_ns,
                  arg_max(ms, t) FILTER (WHERE kind = 'skew') AS clock_skew_ms, coalesce(arg_max(kind = 'degrade', t) FILTER (WHERE kind IN ('degrade', 'heal')), false) AS degraded FROM k GROUP BY shard""")
def engine_counters(spark, d):
    e = F.col("event_id")
    log = events(spark, d).select((F.col("user_id") % 4).alias("shard"), F.array(*map(F.lit, _KINDS))[(e % len(_KINDS)).cast("int")].alias("kind"), (e % 3 + 1).alias("n"), F.length("props").cast("long").alias("bytes"), (e % 1000).alias("ns"), (e % 77).alias("ms"), e.alias("at"))
    return analyze.engine_counters(log, ["shard"])


@query("""WITH n AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'view'), l AS (SELECT user_id, max(t) AS t, arg_max(event_id, (t, event_id)) AS event_id FROM n GROUP BY user_id)
          SELECT user_id, t, event_id FROM l WHERE (SELECT max(t) FROM n) - t <= 86400 ORDER BY t DESC, event_id DESC LIMIT 40""")
def kept_snapshots(spark, d):
    """What a store of forty snapshots of at most a day holds at the end."""
    rows = events(spark, d).where("event_type = 'view'").select("user_id", seconds(F.col("ts")).cast("long").alias("t"), "event_id")
    now = rows.agg(F.max("t")).first()[0] or 0
    return analyze.kept_snapshots(rows, "user_id", "t", ["event_id"], now, 86400, 40)


@query("SELECT e.event_id, e.user_id, e.value FROM events e WHERE EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.value > 95)")
def flagged_snapshots(spark, d):
    e = events(spark, d)
    return analyze.flagged_snapshots(e.select("event_id", "user_id", "value"), e.where("value > 95"), ["user_id"])


def _moving_t(n: int) -> float:
    return numeric.t_quantile(0.975, n - 1)


@query(lambda: f"""WITH c AS (SELECT event_type, user_id % 10 AS run, avg((value <= 50)::INT) AS rate FROM events GROUP BY ALL)
           SELECT event_type, count(*) AS n, round(avg(rate), 6) AS mean, round(avg(rate) - {_moving_t(10)!r} * stddev_samp(rate) / sqrt(10), 6) AS low, round(avg(rate) + {_moving_t(10)!r} * stddev_samp(rate) / sqrt(10), 6) AS high FROM c GROUP BY event_type""")
def coverage_interval(spark, d):
    runs = events(spark, d).groupBy("event_type", (F.col("user_id") % 10).alias("run")).agg(F.avg((F.col("value") <= 50).cast("int")).alias("rate"))
    return analyze.confidence_interval(runs, ["event_type"], "rate", _moving_t(10)).select("event_type", "n", *[rounded(c).alias(c) for c in ("mean", "low", "high")])


@query(f"WITH {S}, c AS (SELECT g, w, sum - avg(sum) OVER (PARTITION BY g) AS c FROM f), p AS (SELECT g, c, lag(c) OVER (PARTITION BY g ORDER BY w) AS b FROM c) SELECT g AS event_type, round(sum(c * b) / sum(c * c), 6) AS acf1 FROM p GROUP BY g")
def lag_correlation(spark, d):
    return analyze.lag_correlation(folded(spark, d), ["event_type"], ["w"], "sum").withColumn("acf1", rounded("acf1"))


@query("SELECT event_type, avg((value <= 60)::INT)::DOUBLE AS coverage, quantile_cont(value * 2, 0.5) AS median_width, count(*) AS n FROM events GROUP BY 1")
def coverage_rates(spark, d):
    rows = events(spark, d).select("event_type", F.col("value").alias("score"), F.lit(60.0).alias("radius"), (F.col("value") * 2).alias("width"))
    return conformal.coverage(rows, ["event_type"], "score", "radius", "width")


@query("""WITH b AS (SELECT event_type, day(ts)::INT AS day, count(*) AS n, CASE WHEN day(ts) BETWEEN 10 AND 12 THEN 0.0 ELSE pow(0.9::DOUBLE, 30 - day(ts)) END AS weight FROM events GROUP BY ALL)
          SELECT event_type, string_agg(day, ',' ORDER BY day) FILTER (WHERE weight > 0) AS buckets, round(sum(weight * n), 6) AS effective_n FROM b GROUP BY event_type""")
def band_provenance(spark, d):
    per = events(spark, d).groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))
    weight = F.when(F.col("day").between(10, 12), 0.0).otherwise(F.pow(F.lit(0.9), (30 - F.col("day")).cast("double")))
    out = conformal.provenance(per.withColumn("weight", weight), ["event_type"], "day", 0.9)
    return out.select("event_type", F.array_join(F.col("provenance.buckets").cast("array<string>"), ",").alias("buckets"), rounded("provenance.effective_n").alias("effective_n"))


def _vb(x: str) -> str:
    return f"greatest(1, ceil((floor(log2(greatest({x}, 1))) + 1) / 7))::INT"


def _framed(x: str) -> str:
    return f"(({x}) + 1 + {_vb(x)})"


@query(f"""WITH p AS (SELECT event_id, {_W} AS w, floor(epoch(ts) * 1000)::BIGINT AS ms, octet_length(encode(event_type)) AS lt, octet_length(encode(user_id::VARCHAR)) AS lu FROM events),
           l AS (SELECT event_id, w, 2 + 10 + {_framed("lt")} AS l1, 2 + 7 + {_framed("lu")} AS l2, 10 + {_vb("ms")} AS sm FROM p),
           t AS (SELECT event_id, w, {_framed("l1")} + {_framed("l2")} + {_framed("sm")} AS body FROM l),
           b AS (SELECT w, sum({_framed("body")}) AS bytes FROM t GROUP BY w),
           e AS (SELECT unnest(range(w, least(w + 4, (SELECT max(w) + 1 FROM b)))) AS v, bytes FROM b WHERE w % 4 = 0)
           SELECT v // 4 AS day, sum(bytes)::BIGINT AS bytes FROM e GROUP BY 1""")
def remote_write_ledger(spark, d):
    """What a remote-write request of each window's samples takes, measured every fourth window and integrated by day."""
    rows = points(spark, d).select("w", "event_type", F.col("user_id").alias("user_id"), "value", F.floor(seconds(F.col("ts")) * 1000 + F.date_format("ts", "SSS").cast("int")).alias("ms"))
    sized = rows.withColumn("size", encode.request_bytes(rows, ["event_type", "user_id"], "value", "ms")).groupBy("w").agg(F.sum("size").alias("bytes"))
    return encode.integrated(sized, 4, last_window(sized), 4).withColumn("bytes", F.col("bytes").cast("long"))


@query(f"SELECT event_id, event_type || '|user=' || user_id AS logical_series FROM events")
def drilldown_hints(spark, d):
    from fathomline.functions import identity

    return encode.hinted(events(spark, d), identity.group_key(F.col("event_type"), {"user": F.col("user_id")})).select("event_id", "logical_series")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15'")
def instance_pull(spark, d):
    return encode.instance_samples(events(spark, d), "event_type", "view", "ts", F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "user_id", "value")


@query("""WITH f AS (SELECT event_type, user_id, min((ts, event_id)) AS first FROM events GROUP BY ALL), s AS (SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first, user_id) AS i FROM f) WHERE i <= 20),
          p AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS place FROM events JOIN s USING (event_type, user_id)) SELECT event_id, event_type, user_id, place::INT AS place FROM p WHERE place <= 5""")
def instance_buffers(spark, d):
    out = encode.instance_buffers(events(spark, d), ["event_type"], "user_id", [F.col("ts"), F.col("event_id")], most_instances=20, most_samples=5)
    return out.select("event_id", "event_type", "user_id", "place")


@query(lambda: "WITH hx(name, id) AS (VALUES " + _shards_sql() + ") SELECT event_id, CASE WHEN id >= 9223372036854775808 THEN (id - 18446744073709551616::HUGEINT)::BIGINT ELSE id::BIGINT END AS shard FROM events JOIN hx ON hx.name = 'event_type=' || event_type")
def shard_ids(spark, d):
    return events(spark, d).select("event_id", encode.shard({"event_type": F.col("event_type")}).alias("shard"))


def _shards_sql() -> str:
    import xxhash

    from fathomline.plans.queries import TYPES

    return ", ".join(f"('event_type={t}', {xxhash.xxh64_intdigest(f'event_type={t}', 0)})" for t in TYPES)


@query("""WITH a AS (SELECT 'audit' AS task, (floor(epoch(ts) / 3600) + 1)::BIGINT * 3600 AS due FROM events UNION ALL SELECT 'heartbeat', (floor(epoch(ts) / 7200) + 1)::BIGINT * 7200 FROM events) SELECT task, due, count(*) AS rows FROM a GROUP BY ALL""")
def side_tasks(spark, d):
    return analyze.side_tasks(events(spark, d).select(seconds(F.col("ts")).alias("t")), "t", {"audit": 3600, "heartbeat": 7200})


@query(f"""WITH {S}, inc AS (SELECT * FROM (VALUES ('a', 78900, 78910), ('b', 78950, 78954), ('c', 10, 12)) v(name, start, "end")), hi AS (SELECT DISTINCT g AS detector, w FROM f WHERE sum > 300), so AS (SELECT w, max(sum) > 500 AS gated FROM f GROUP BY w),
           sg AS (SELECT name, count(so.w) AS solves, coalesce(count_if(gated), 0) AS gated_solves FROM inc LEFT JOIN so ON so.w BETWEEN start AND "end" GROUP BY name)
           SELECT inc.name, d.detector, min(hi.w - start)::BIGINT AS lag, any_value(sg.solves) AS solves, any_value(sg.gated_solves)::BIGINT AS gated_solves FROM inc CROSS JOIN (SELECT DISTINCT detector FROM hi) d LEFT JOIN hi ON hi.detector = d.detector AND hi.w >= start AND hi.w < "end" + 6 JOIN sg USING (name) GROUP BY inc.name, d.detector""")
def incident_report(spark, d):
    f = folded(spark, d)
    incidents = spark.createDataFrame([("a", 78900, 78910), ("b", 78950, 78954), ("c", 10, 12)], "name string, start long, end long")
    solves = f.groupBy("w").agg((F.max("sum") > 500).alias("gated"))
    return analyze.incident_report(incidents, f.where("sum > 300").select(F.col("event_type").alias("detector"), "w"), solves, 6).select("name", "detector", "lag", "solves", "gated_solves")


@query(lambda: f"""WITH {U}, {hashes_sql()}, {_Y}, q AS (SELECT w, list(y) AS l FROM y GROUP BY w), f AS (SELECT w, list_concat(l, list_transform(range({BUCKETS} - len(l)), lambda i: 0.0::DOUBLE)) AS v FROM q),
           m AS (SELECT w, v, list_aggregate(v, 'quantile_cont', 0.5) AS med FROM f), s AS (SELECT w, list_aggregate(list_transform(v, lambda x: abs(x - med)), 'quantile_cont', 0.5) / 0.6745 * sqrt({BUCKETS} / 100.0::DOUBLE) AS sigma FROM m)
           SELECT w, round(sigma, 6) AS sigma, round(quantile_cont(sigma, 0.5) OVER (ORDER BY w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling FROM s""")
def quiet_sigmas(spark, d):
    out = simulate.quiet_sigmas(hashed_sketch(spark, d).withColumn("view", F.lit(0)), ["view", "w"], BUCKETS, 100, history=10)
    return out.select("w", rounded("sigma").alias("sigma"), rounded("rolling").alias("rolling"))


@query(f"WITH {S} SELECT w, round(0.5 * max / 10 * sqrt(2 * ln(n + 1)), 6) AS weight, round(2.0 * sqrt(n) * max / 10, 6) AS gate, g AS event_type FROM f")
def solve_settings(spark, d):
    sigma = F.col("max") / 10
    return folded(spark, d).select("w", "event_type", rounded(numeric.shrinkage_weight(0.5, sigma, F.col("count") + 1)).alias("weight"), rounded(numeric.gate(2.0, F.col("count"), sigma)).alias("gate"))


@query()
def dead_zone(spark, d):
    """Trials of the whole path on made-up residuals; tests hold their rates against what must be found."""
    return simulate.cells(simulate.dead_zone(spark, [0.0, 0.05], [0.5, 5.0], 4, simulate.Setup(series=201, m=400)))


@query(lambda: "WITH RECURSIVE " + _world_sql())
def synthetic_world(spark, d):
    values = synthetic.world(spark, groups=30, instances=5, windows=40, hot=2, hot_added=50.0, drifting=3, drift=1.5, noise=0.0)
    jumped = synthetic.applied(values, synthetic.anomalies(spark, groups=30, windows=40).withColumn("grp", F.col("ix") % 30))
    return jumped.groupBy("w", "grp").agg(rounded(F.sum("value")).alias("value"))


def _world_sql() -> str:
    return """w AS (SELECT unnest(range(40)) AS w), g AS (SELECT unnest(range(30)) AS grp), i AS (SELECT unnest(range(5)) AS instance),
        t AS (SELECT ix, ix % 30 AS grp, floor(40 * (0.15::DOUBLE + 0.6::DOUBLE * (ix + 0.5::DOUBLE) / 20))::BIGINT AS a FROM (SELECT unnest(range(20)) AS ix)),
        v AS (SELECT w, grp, instance, 100.0 + CASE WHEN grp < 2 AND instance = 0 THEN 50.0 ELSE 0.0 END + CASE WHEN grp >= 27 THEN 1.5 * w ELSE 0.0 END AS value FROM w, g, i),
        j AS (SELECT grp, w, 60.0 * count(*) AS m FROM t JOIN w ON w.w BETWEEN a AND a + 1 GROUP BY ALL)
        SELECT v.w, v.grp, round(sum(value + coalesce(m, 0)), 6)::DOUBLE AS value FROM v LEFT JOIN j ON j.grp = v.grp AND j.w = v.w GROUP BY ALL"""
