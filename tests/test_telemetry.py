"""Telemetry operators: SQL side by side, published vectors, streams against their batch form, solvers on planted signals."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.functions import frames, hashing, identity, numeric
from fathomline.operators import analyze, conformal, encode, recovery
from fathomline.plans import queries
from fathomline.sources import readers, synthetic, writers
from fathomline.streaming import windows


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "part"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(str([normal(v) for v in r]) for r in df.select(*[f"`{c}`" for c in want.columns]).collect())
    assert got == sorted(str([normal(v) for v in r]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0 or name in ("seasonal_band", "sparse_recovery", "tuned_alphas")


def test_seeded_hashes(spark):
    names = ["", "a", "cpu_usage|region=us-east,cluster=prod|agg=sum", "é" * 40]
    for seed in (0, 1, 42, 2**63 + 5, 2**64 - 1):
        got = spark.createDataFrame([(n,) for n in names], "n string").select("n", hashing.seeded(F.col("n"), seed).alias("h")).collect()
        assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.n.encode(), seed) for r in got)
    h = spark.createDataFrame([(names[2],)], "n string").select(hashing.unsigned(hashing.series_id(F.col("n"))).alias("h")).first().h
    assert int(h) == 13716017466272225171


def test_sketch_columns(spark):
    df = spark.createDataFrame([(f"s{k}",) for k in range(50)], "name string")
    for r in hashing.sketch_columns(df, "name", 99, 64, 4).groupBy("name").agg(F.collect_list("bucket").alias("b"), F.collect_list("sign").alias("s")).collect():
        h1 = xxhash.xxh64_intdigest(r.name.encode(), 99)
        h2 = xxhash.xxh64_intdigest(r.name.encode(), 99 ^ hashing.SECOND) | 1
        assert sorted(r.b) == sorted((h1 + i * h2) % 2**64 % 64 for i in range(4))
        assert sorted(r.s) == sorted(1 if h1 >> i + 1 & 1 else -1 for i in range(4))


def test_wire_vectors():
    """Values of the published format; see the wire format's layout."""
    assert frames.dict_root([]) == 17241709254077376921 and frames.dict_root([42]) == 13066772586158965587
    assert hashing.view_seed(b"test-vector-key", 1, 0, 0) == 14280488303727161635 and hashing.view_seed(b"test-vector-key", 2**64 - 1, 2**32 - 1, 65535) == 9718342330319355967
    assert frames.quantize([0.0, 1.2, -1.2, 6.0, -6.0, 0.001, -0.001, 3.14159], 8, 0.05).hex() == "0018e8788800003f"
    assert frames.quantize([1e9, -1e9, 200.0, -200.0], 8, 1.0).hex() == "7f807f80"
    raw = bytes.fromhex("504c4d50020200080000cdab000000002a00000000000000070000000000000003000000000010000000040000000000a0408542a13c5b055d5d2b20ce810000000000000000100000000000000000007f00007f000081000081b3cfa5cc")
    f = frames.decode(raw)
    assert f["frame_type"] == frames.RESIDUAL and f["m"] == 16 and f["energy"] == 5.0 and frames.encode(f) == raw
    ids = [3327097841107003917, 11700781113966624968, 13716017466272225171, 14197310116720301820, 14337050298409450808]
    before = {ids[0]: 20.0, ids[1]: 40.0, ids[2]: 10.0, ids[4]: 30.0}
    after = before | {ids[2]: 11.0, ids[3]: 50.0}
    payload = frames.delta_keyframe(ids, after, before, 0.1)
    assert payload.hex() == "0c14e807" and frames.read_delta_keyframe(payload, ids, before, 0.1) == pytest.approx(after)
    with pytest.raises(frames.FrameError):
        frames.read_delta_keyframe(b"\0", ids, {}, 0.1)


def test_codec_round_trips_and_rejects(spark, tmp_path):
    delta = [{"id": -5, "flags": 0, "init_value": 1.5, "name": "né"}, {"id": 7, "flags": 1, "init_value": 0.0, "name": ""}]
    f = dict.fromkeys("frame_type flags bits emitter_id shard_id epoch seq view_id m d predictor key_version codec dict_root".split(), 1) | {"energy": 2.0, "quant_scale": 0.5, "dict_deltas": delta, "snapshot_blob": frames.snapshot([(1, 2, 3.0)], frames.ZSTD), "payload": frames.fallback([(9, 1.0)], 4.5, 6)}
    raw = frames.encode(f)
    back = frames.decode(raw)
    assert back["dict_deltas"] == delta and frames.read_snapshot(back["snapshot_blob"], frames.ZSTD) == [(1, 2, 3.0)] and frames.read_fallback(back["payload"]) == ([(9, 1.0)], 4.5, 6)
    assert len(raw) == 78 + 15 * 2 + 3 + len(f["snapshot_blob"]) + len(f["payload"])
    assert frames.read_keyframe(frames.keyframe({-1: 2.0, 5: 1.0})) == {5: 1.0, -1: 2.0}
    for codec in (frames.NONE, frames.GZIP, frames.ZSTD):
        assert frames.decompress(frames.compress(b"x" * 99, codec), codec) == b"x" * 99
    with pytest.raises(frames.FrameError):
        frames.decompress(frames.compress(b"x" * 99, frames.ZSTD), frames.ZSTD, 50)
    with pytest.raises(frames.FrameError):
        frames.compress(b"", 9)
    for k, data in enumerate([raw, raw[:-1], b"nothing", raw[:4] + b"\x09" + raw[5:]]):
        (tmp_path / f"{k}.plmp").write_bytes(data)
    good, bad = readers.split_errors(readers.frame_folder(spark, str(tmp_path)))
    assert good.count() == 1 and bad.count() == 3 and good.first().dict_deltas[0].name == "né"
    again = frames.encoded(good).first().content
    assert bytes(again) == raw
    sized = encode.frame_sizes(good).first()
    assert sized.encoded_size == len(raw)


def test_names_and_sizes(spark):
    df = spark.createDataFrame([({"k": "a"}, {"k": "r", "z": "w"}, 0.5, "1x y"), (None, None, 10.0, "ok")], "attrs map<string,string>, res_attrs map<string,string>, b double, n string")
    got = df.select(identity.attribute("k").alias("k"), identity.attribute("z").alias("z"), identity.bound_label(F.col("b")).alias("le"), identity.metric_name(F.col("n")).alias("m"), identity.group_of_series(F.lit("m|a=1|agg=sum")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("a", "w", "0.5", "_1x_y", "a=1"), ("", "", "10", "ok", "a=1")]
    assert identity.byte_size("16MB") == 16 << 20 and identity.byte_size("3 B") == 3
    with pytest.raises(ValueError):
        identity.byte_size("x")


def test_fold_floors_the_maximum(spark):
    rows = [(0, "g", 1, 1, -5.0), (0, "g", 1, 2, -3.0), (0, "g", 2, 1, -1.0)]
    r = encode.window_fold(spark.createDataFrame(rows, "w int, g string, i int, t int, value double"), ["w", "g"], "i", ["t"]).first()
    assert (r["sum"], r["count"], r["max"]) == (-4.0, 2, 0.0)


def test_point_query_and_merge(spark):
    rows = [(1, e, f"s{k}", 10.0 * (k == 3) + 0.01 * k) for e in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "w int, emitter int, name string, residual double")
    y = encode.merged_sketch(encode.sketch(df, ["w", "emitter"], seed=5, m=512, d=4), ["w"], "emitter")
    assert y.agg(F.max("coverage")).first()[0] == 3
    got = {r.name: r.estimate for r in encode.point_query(df.select("w", "name").distinct(), y, ["w"], seed=5, m=512, d=4).collect()}
    assert got["s3"] == pytest.approx(30.09, abs=0.5) and abs(got["s5"]) < 1.5


def test_recovery_of_planted_signals(spark):
    names = spark.createDataFrame([(f"g{k % 10}|i{k}", f"g{k % 10}") for k in range(600)], "name string, grp string")
    truth = {"g1|i1": 40.0, "g7|i107": -25.0, "g3|i333": 60.0}
    hit = names.join(spark.createDataFrame(list(truth.items()), "name string, residual double"), "name").withColumn("w", F.lit(4))
    noise = names.select("name", (synthetic.normal(1, F.col("name")) * 0.05).alias("residual"), F.lit(4).alias("w"))
    y = encode.sketch(hit.select("w", "name", "residual").unionByName(noise.select("w", "name", "residual")), ["w"], seed=9, m=400, d=6)
    got = {r.name: r.value for r in recovery.recovered(y, names, ["w"], seed=9, m=400, d=6, group="grp", options=recovery.Options(threshold=3.0)).collect()}
    assert set(got) == set(truth) and all(abs(got[n] - v) < 1 for n, v in truth.items())
    assert recovery.recovered(y.where("w = 0"), names, ["w"], seed=9, m=400, d=6).count() == 0


def test_group_escalation():
    rng = np.random.default_rng(3)
    a = recovery.Columns(rng.integers(0, 300, (500, 6)), rng.choice([-1.0, 1.0], (500, 6)), 300)
    groups = np.arange(500) // 100
    x = np.where(groups == 2, 8.0, 0.0)
    s = recovery.recover(a, a.forward(x), groups, recovery.Options(threshold=2.0, escalate=0.05))
    assert s.grouped and set(np.flatnonzero(groups == 2)) <= set(s.support.tolist()) and abs(s.values[groups == 2].mean() - 8) < 0.5


def test_groups_of_more_series_than_buckets():
    rng = np.random.default_rng(8)
    a = recovery.Columns(rng.integers(0, 300, (200_000, 6)), rng.choice([-1.0, 1.0], (200_000, 6)), 300)
    groups, y = np.arange(200_000) // 100_000, rng.normal(size=300)
    for _ in range(20):  # towards what the second group stands out by
        y = a.forward(np.where(groups == 1, a.back(y), 0.0))
        y /= np.linalg.norm(y)
    s = recovery.recover(a, y, groups, recovery.Options(threshold=50.0, most_steps=5))
    assert s.grouped and set(np.flatnonzero(groups == 1)) <= set(s.support.tolist()) and s.residual < 1e-6 and np.allclose(a.forward(s.values), y)
    some = np.sort(rng.choice(200_000, 900, replace=False))
    dense = a.dense(some)
    assert np.allclose(a.overlaps(some), dense @ dense.T)
    got = recovery.refit(a, y, some, 1e-3)
    assert np.allclose(got[some], np.linalg.solve(dense.T @ dense + 1e-3 * np.eye(900), dense.T @ y)) and not np.delete(got, some).any()


def test_equal_coefficients_are_taken_in_order():
    x = np.tile([2.0, -3.0, 3.0, 0.5], 500)
    assert recovery.capped(x, 1.0, 7).tolist() == [1, 2, 5, 6, 9, 10, 13] and not len(recovery.capped(x, 1.0, 0)) and len(recovery.capped(x, 1.0, 2000)) == 1500


def test_recovery_by_view(spark):
    names = spark.createDataFrame([(v, f"v{v}|i{k}", f"g{k % 3}" if k else None) for v in (1, 2) for k in range(80)], "view int, name string, grp string")
    hit = spark.createDataFrame([(v, w, f"v{v}|i{10 * w + v}", 30.0 + w) for v in (1, 2, 3) for w in range(7)], "view int, w long, name string, residual double")
    y = encode.sketch(hit, ["view", "w"], seed=9, m=200, d=6)
    got = {(r.view, r.w, r.name): r.value for r in recovery.recovered(y, names, ["view", "w"], seed=9, m=200, d=6, group="grp").collect()}
    assert got == {(v, w, f"v{v}|i{10 * w + v}"): pytest.approx(30.0 + w, abs=0.1) for v in (1, 2) for w in range(7)}  # view 3 has no dictionary


def test_sketch_error_bound_and_merge(spark):
    df = spark.range(4000).select((F.col("id") % 7).alias("b"), (synthetic.normal(2, F.col("id")) * 50).alias("v"))
    bins = conformal.sketch_bins(df, ["b"], "v")
    merged = conformal.merged_bins(bins, [])
    exact = df.select("v").toPandas()["v"].sort_values().to_numpy()
    for q in (0.01, 0.3, 0.5, 0.9, 0.999):
        got = conformal.sketch_quantile(merged, [], q).first()["quantile"]
        want = exact[math.floor(q * (len(exact) - 1))]
        assert abs(got - want) <= 0.0101 * abs(want) + 1e-9
    assert conformal.sketch_quantile(merged.withColumn("weight", F.lit(0.0)), [], 0.5).count() == 0


def test_radius_is_infinite_for_few_scores(spark):
    bins = conformal.sketch_bins(spark.createDataFrame([("a", float(k)) for k in range(1, 4)], "k string, v double"), ["k"], "v")
    sizes = spark.createDataFrame([("a", 3)], "k string, n long")
    assert conformal.split_radius(bins, sizes, ["k"], 0.1).first().radius == math.inf
    assert conformal.split_radius(bins, sizes, ["k"], 0.5).first().radius == pytest.approx(2.0, rel=0.03)


def test_adaptive_alphas_hold_coverage(spark):
    rows = synthetic.regime_shift(spark, at=600, n=1500, magnitude=1.5).select(F.lit("e").alias("e"), "t", "score")
    got = conformal.tuned_alphas(rows, ["e"], "t", "score", target=0.1, interval=200, calibration=300).toPandas()
    assert len(got) == 1200 and got.alpha.between(1e-6, 0.999).all()
    assert got.alpha[(got.t > 700)].mean() < got.alpha[got.t < 550].mean()  # wider bands after the shift


def test_seasonal_band_covers(spark):
    rows = synthetic.seasonal_latency(spark, weeks=6).select(F.lit("e").alias("e"), "t", "p50")
    got = conformal.seasonal_band(rows, ["e"], "t", "p50", period=168, train=672).toPandas()
    assert len(got) == 336 and ((got.y >= got.q_lo) & (got.y <= got.q_hi)).mean() > 0.75
    assert conformal.seasonal_band(rows, ["e"], "t", "p50", period=168, train=200).count() == 0


def test_breaker_and_heal(spark):
    births = spark.createDataFrame([("v", k // 5) for k in range(30)], "v string, w long")
    r = encode.breaker(births, ["v"], "w", 12, 10).first()
    assert (r.accepted, r.rejected, r.tripped) == (12, 18, True)
    later = spark.createDataFrame([("v", w) for w in (0, 0, 0, 100, 101)] + [("u", w) for w in (0, 10, 20)], "v string, w long")
    got = {r.v: (r.accepted, r.rejected, r.tripped) for r in encode.breaker(later, ["v"], "w", 2, 10).collect()}
    assert got == {"v": (4, 1, True), "u": (3, 0, False)}  # accepts again; a birth on the edge of the span still counts
    edge = spark.createDataFrame([("v", w) for w in (0, 10)], "v string, w long")
    assert encode.breaker(edge, ["v"], "w", 1, 10).first().rejected == 1
    roots = spark.createDataFrame([("v", k, k not in (2, 3, 4), k % 4 == 0) for k in range(12)], "v string, w long, ok boolean, golden boolean")
    assert [tuple(r) for r in analyze.heal_times(roots, ["v"], "w", "ok", "golden").collect()] == [("v", 2, 8, 6)]


def frame_rows(seed):
    rng = random.Random(seed)
    rows = [(v, w, e, float(rng.randint(1, 9)), w + (rng.randint(1, 5) if rng.random() < 0.25 else 0)) for v in "ab" for w in range(25) for e in "xyz"]
    rows += [r for r in rows if rng.random() < 0.1]
    return sorted(rows, key=lambda r: (r[4], r[0], r[1], r[2]))


def test_stream_repairs_as_the_batch_form(spark, tmp_path):
    rows = [(*r[:4], k) for k, r in enumerate(frame_rows(1))]
    schema = "view string, w long, emitter string, value double, arrival long"
    want = {tuple(r) for r in windows.replayed(spark.createDataFrame(rows, schema), lateness=1, horizon=4).collect()}
    src = tmp_path / "in"
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).sortWithinPartitions("arrival").write.mode("append").parquet(str(src))
        import time

        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = windows.revised_windows(stream, lateness=1, horizon=4).writeStream.outputMode("update").format("memory").queryName("revised").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.sql("select * from revised").collect()}
    finally:
        q.stop()
    assert got == want and max(r[2] for r in got) > 0
    last = {(v, w): (r, c) for v, w, r, c, _ in sorted(got)}
    assert all(c <= 3 for _, c in last.values())


def test_ownership_expires():
    book = windows.Ownership(ttl=3)
    assert book.add([(0, "a", 1, False), (0, "b", 1, False), (1, "a", 1, True)]) == []
    assert book.add([(2, "b", 2, False), (3, "b", 2, False)]) == [(1, 3)]
    assert book.add([(4, "b", 2, True)]) == [(2, 4)]


def test_truth_file_and_writers(spark, tmp_path):
    assert readers.truth_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "t.jsonl").write_text('{"type":"birth","series_id":4,"window_start":1,"window_end":1}\n')
    assert readers.truth_lines(spark, str(tmp_path / "t.jsonl")).first().series_id == 4
    rows = writers.remote_write_rows(spark.createDataFrame([("a.b", "x", 1.5, 1000)], "name string, shard string, value double, timestamp_ms long"), labels={"shard": "shard"}).collect()
    assert [tuple(x) for x in rows[0].labels] == [("__name__", "a_b"), ("shard", "x")]
    data = writers.remote_write_request(rows)
    assert b"__name__" in data and data[0] == 0x0A
    block = writers.snappy_block(b"z" * 100_000)
    assert block[:3] == bytes([0xA0, 0x8D, 0x06]) and len(block) == 100_000 + 3 + 6


def test_each_batch_tries_every_sink(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = writers.each_batch(stream, str(tmp_path / "cp"), lambda b, n: seen.append(b.count()), lambda b, n: seen.append(n))
    q.processAllAvailable()
    q.stop()
    assert seen == [3, 0]


def test_generators(spark):
    assert synthetic.world(spark, groups=3, instances=2, windows=4).count() == 24
    a, b = (synthetic.world(spark, groups=3, instances=2, windows=4).orderBy("w", "grp", "instance").collect() for _ in range(2))
    assert a == b
    t = synthetic.anomalies(spark, groups=5, windows=40, count=6).collect()
    assert all(6 <= r.window_start <= 30 and r.window_end == r.window_start + 1 for r in t)
    fleet = synthetic.bimodal_fleet(spark, hosts=10, mix=0.3)
    pooled = fleet.agg(F.percentile("value", F.lit(0.95))).first()[0]
    assert pooled > fleet.groupBy("host").agg(F.percentile("value", F.lit(0.95)).alias("p")).agg(F.avg("p")).first()[0] * 1.3
    shift = synthetic.regime_shift(spark, at=200, kind="ramp", target="inputs")
    share = lambda when: shift.where(when).agg(F.avg(F.col("input_features")[0])).first()[0]
    assert share("t < 200") < 0.4 and share("t >= 300") > 0.5 and shift.where("abs(aggregate(input_features, 0d, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    assert synthetic.with_incidents(synthetic.slow_burn(spark, rate=0.1), count=3, n=300).where("incident").count() >= 5
    assert synthetic.heavy_tail(spark).where("value > 10").count() > 50
    assert synthetic.month(spark, groups=4, days=2, incidents=[(3, 9, 0.5, 50.0)]).count() == 4 * 48
    assert synthetic.heteroscedastic_pair(spark).groupBy("entity").agg(F.stddev("p50").alias("s")).count() == 2
    assert synthetic.weak_observers(spark, agents=3, series=4, shifted=2, windows=10).where("series < 2 and w >= 5").agg(F.avg("value")).first()[0] > 0.4
    frames_ = spark.range(200).select(F.col("id").cast("string").alias("frame_id"), F.col("id").alias("arrival"))
    assert 200 < synthetic.impaired(frames_).count() < 240


def test_scalar_pieces(spark):
    assert numeric.LIMITS[8] == 127
    r = spark.range(1).select(numeric.quantized(F.lit(2.5), F.lit(1.0)).alias("a"), numeric.quantized(F.lit(-2.5), F.lit(1.0)).alias("b"), numeric.pareto_quantile(F.lit(0.5), 0.0, 1.0).alias("c"), numeric.array_median(F.array(F.lit(3.0), F.lit(1.0))).alias("d"), numeric.array_median(F.array().cast("array<double>")).alias("e"), numeric.gate(3.0, F.lit(100), F.lit(0.5)).alias("f")).first()
    assert (r.a, r.b, r.d, r.e, r.f) == (3, -3, 2.0, None, 15.0) and r.c == pytest.approx(math.log(2))
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7),)], "ts timestamp_ntz").select(encode.window_index(F.col("ts"), 21600).alias("w")).first()
    assert e.w == 19723 * 4 + 1
    rows = spark.createDataFrame([("b", "sketched"), ("c", "merged"), ("d", "exact")], "n string, tier string")
    assert encode.passed_on(rows).count() == 2 and encode.passed_on(rows, shadow=True).count() == 3
    t = spark.createDataFrame([("summary", "zz"), ("gauge", "up_err"), ("gauge", "other")], "kind string, metric string").select(encode.tier(F.col("metric"), queries.RULES, F.col("kind")).alias("t")).collect()
    assert [r.t for r in t] == ["exact", "merged", "sketched"]


def test_late_and_repeated_rows(spark):
    frames_ = spark.createDataFrame([("e", 1, 0), ("e", 2, 1), ("e", 3, 0), ("e", 4, 1)], "emitter string, t int, epoch int")
    assert [r.t for r in analyze.late_epochs_dropped(frames_, "emitter", ["t"]).orderBy("t").collect()] == [1, 2, 4]
    state = spark.createDataFrame([("v", 1, False, False, True), ("v", 2, True, False, False), ("v", 3, False, False, True), ("v", 4, False, True, False), ("v", 5, False, False, True)], "view string, t int, bad boolean, heal boolean, res boolean")
    assert [r.t for r in analyze.degraded_dropped(state, ["view"], ["t"], "bad", "heal", "res").orderBy("t").collect()] == [1, 2, 4, 5]
    empty = spark.createDataFrame([], "emitter string, t int, epoch int")
    assert analyze.late_epochs_dropped(empty, "emitter", ["t"]).count() == 0


def test_absence_stream(spark, tmp_path):
    schema = "view string, w long, emitter string, series long, released boolean"
    spark.createDataFrame([("v", 0, "a", 1, False), ("v", 1, "a", 1, True), ("v", 1, "b", 2, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windows.absences(stream, ttl=5).writeStream.outputMode("append").format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.sql("select * from gone").collect()] == [("v", 1, 1)]
    finally:
        q.stop()


def test_ring_and_masks(spark):
    days = spark.createDataFrame([(k,) for k in range(10)], "day int")
    ring = conformal.ring_weights(days, "day", capacity=4, decay=0.5)
    assert {r.day: r.weight for r in ring.collect()} == {9: 1.0, 8: 0.5, 7: 0.25, 6: 0.125}
    off = {r.day: r.weight for r in conformal.masked(ring, "day", [(7, 8)]).collect()}
    assert off == {9: 1.0, 8: 0.0, 7: 0.0, 6: 0.125}
    assert conformal.effective_n(ring.withColumn("n", F.lit(8)), []).first()[0] == 15.0


def test_settings_report_all_faults():
    from fathomline.operators.config import Encoder, View

    ok = Encoder(["region"], ["pod"], golden_s=600).checked()
    assert ok.golden_windows() == 60 and ok.resolved_views()[0].keys == ["region"]
    with pytest.raises(ValueError) as e:
        Encoder([], ["pod"], m=0, bits=9, rules=[("(", "none")], views=[View("a"), View("a")], golden_every=7, golden_s=600).checked()
    assert all(x in str(e.value) for x in ("logical_key", "m must", "bits", "unknown tier", "pattern", "one name", "disagree"))


def test_references_freeze(spark):
    rows = [("s", k, v) for k, v in enumerate([10.0, 11.0, 50.0, 52.0, 11.0, 11.5, 12.0, 12.5])]
    got = encode.frozen_references(spark.createDataFrame(rows, "s string, w long, value double"), ["s"], "w", "value", 5.0).orderBy("w").collect()
    assert [r.reference for r in got] == [10.0, 10.0, 11.0, 11.0, 11.0, 11.0, 11.0, 12.0] and [r.out for r in got] == [False, False, True, True, False, False, False, False]


def test_keys_and_states(spark):
    f = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "frame int, key_version int")
    have, lack = analyze.keyed(f, spark.createDataFrame([(0, "a"), (1, "b")], "key_version int, tenant_key string"), ["key_version"])
    assert have.count() == 2 and lack.first().frame == 3
    assert analyze.any_degraded(spark.createDataFrame([(1, True), (1, False)], "shard int, degraded boolean"), ["shard"]).first().degraded
    events_ = analyze.fallback_events(spark.createDataFrame([(1, [(5, 2.0), (6, 1.0)])], "w int, top array<struct<id: long, value: double>>"))
    assert sorted((r.series_id, r.value) for r in events_.collect()) == [(5, 2.0), (6, 1.0)]


def test_silent_series_are_reloaded_at_keyframes(spark):
    rows = spark.createDataFrame([("s", 1, 10.0), ("s", 4, 20.0), ("s", 7, 25.0), ("s", 30, 1.0), ("s", 31, 2.0)], "name string, w long, value double")
    lives = encode.lifetimes(rows, 9, ["name"])
    got = {r.w: (r.life, r.baseline, r.residual) for r in encode.hold_residual(lives, 6, ["name"]).collect()}
    assert got == {1: (1, None, 0.0), 4: (1, 10.0, 10.0), 7: (1, 20.0, 5.0), 30: (2, None, 0.0), 31: (2, 1.0, 1.0)}
    frames_ = encode.keyframe_values(rows, 6, 9, ["name"], 36)
    assert sorted((r.w, r.life, r.value) for r in frames_.collect()) == [(6, 1, 20.0), (12, 1, 25.0), (30, 2, 1.0), (36, 2, 2.0)]
    assert [(r.w, r.prev) for r in encode.keyframe_drift(frames_, 4.0, ["name"]).collect()] == [(12, 20.0)]  # not over lifetimes
    totals = {r.w: (r.total_sum, r.total_count) for r in encode.fallback_totals(encode.active_at_each_window(rows, 9, ["name"], 36), ["w"]).collect()}
    assert totals[3] == (10.0, 1) and totals[15] == (25.0, 1) and 16 not in totals and totals[36] == (2.0, 1)
    again = encode.rotated(rows, 10, 9, ["name"], 36).orderBy("w").collect()
    assert [(r.w, r.epoch, r.epoch_seq, r.value) for r in again if r.reborn] == [(10, 1, 0, 25.0)]


def test_skew_is_told_once_for_each_emitter(spark):
    rows = [("v", 1, "a", 0.0), ("v", 1, "b", 9.0), ("v", 2, "a", 10.0), ("v", 2, "b", 19.0), ("v", 3, "b", 20.0), ("v", 3, "a", 21.0), ("v", 4, "a", 30.0), ("v", 4, "b", 31.0), ("v", 5, "a", 40.0), ("v", 5, "b", 48.0)]
    got = analyze.clock_skew(spark.createDataFrame(rows, "view string, w long, emitter string, at double"), ["view"], "w", ["emitter"], "at", ["emitter"], 5.0)
    assert sorted((r.emitter, r.w, r.skew) for r in got.collect()) == [("b", 1, 9.0), ("b", 5, 8.0)]  # alerts once, and again after it was well


def test_audit_compares_what_can_be_compared(spark):
    truth = spark.createDataFrame([(0, "s", "anomaly", 5, 6, 60.0, 160.0, 0.0), (1, "d", "drift", 0, 50, 30.0, 130.0, 0.0), (2, "b", "birth", 9, 9, 0.0, 0.0, 0.0), (3, "z", "anomaly", 8, 2, 10.0, 20.0, 0.0)], "ix long, series string, type string, window_start long, window_end long, magnitude double, expected_value double, at double")
    found = spark.createDataFrame([("s", 5, "deviation", 57.0, 1), ("s", 6, "keyframe", 168.0, 2), ("d", 7, "deviation", 1.0, 1), ("b", 10, "deviation", 5.0, 0), ("q", 1, "keyframe", 5.0, 0), ("z", 8, "deviation", 20.0, 1)], "series string, w long, substrate string, value double, revision int")
    m = analyze.matched_truth(found, truth, ["series"])
    r = analyze.scores(m, truth, truth.where("type = 'birth'").select("series", F.col("window_start").alias("at")), ["series"]).first()
    assert (r.detections, r.true_detections, r.found, r.truths, r.lifecycle_false) == (6, 4, 3, 3, 1)
    assert r.mape == pytest.approx((0.05 + 0.05 + 1.0) / 3) and r.mape_samples == 3 and r.revision_accuracy == pytest.approx(2 / 3) and r.revision_samples == 3
    assert {x.type: x.recall for x in analyze.recall_by_type(m, truth).collect()} == {"anomaly": 1.0, "drift": 1.0}


def test_group_tests_choose_by_excess_over_noise():
    rng = np.random.default_rng(3)
    a = recovery.Columns(rng.integers(0, 300, (500, 6)), rng.choice([-1.0, 1.0], (500, 6)), 300)
    groups = np.repeat(np.arange(25), 20)
    x = np.where(groups == 4, 6.0, 0.0) + rng.normal(0, 0.05, 500)
    y, o = a.forward(x), recovery.Options(threshold=2.0)
    support, added = recovery.by_groups(a, y, groups, np.empty(0, int), o)
    assert added[0] == 4 and set(np.flatnonzero(groups == 4)) <= set(support.tolist())
    small = np.arange(500) // 5
    assert recovery.by_groups(a, a.forward(np.where(small == 4, 6.0, 0.0)), small, np.empty(0, int), o)[1] == []  # too few for the first round
    s = recovery.recover_groups(a, y, groups, recovery.Options(threshold=50.0))
    assert s.grouped and abs(s.values[groups == 4].mean() - 6) < 0.2
    assert recovery.group_score(a, y, np.flatnonzero(groups == 4), recovery.Options(threshold=50.0)) > 6 > recovery.group_score(a, y, np.flatnonzero(groups == 9), recovery.Options(threshold=50.0))
    assert recovery.group_score(a, y, np.empty(0, int), o) == 0.0


def test_coverage_gate_and_deviations(spark):
    names = spark.createDataFrame([(f"s{k}",) for k in range(50)], "name string")
    hit = spark.createDataFrame([("s7", 30.0, 1), ("s7", 30.0, 2)], "name string, residual double, w int")
    y = encode.sketch(hit, ["w"], seed=9, m=200, d=6).withColumn("coverage", F.when(F.col("w") == 1, 2).otherwise(0))
    got = recovery.recovered(y, names, ["w"], seed=9, m=200, d=6, emitters=3)
    assert [(r.w, r.name) for r in got.collect()] == [(1, "s7")]
    assert recovery.deviations(got, 0.5).first().substrate == "deviation" and recovery.deviations(got, -1.0).count() == 0


def test_checksums_of_long_data():
    slow = lambda d: __import__("functools").reduce(lambda c, b: frames._CRC_LIST[(c ^ b) & 255] ^ c >> 8, d, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert frames.crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 2047, 2048, 2049, 4097, 65536, 100_001):
        data = random.Random(n).randbytes(n)
        assert frames.crc32c(data) == slow(data)


def test_frames_are_built_in_one_step(spark):
    full = [{"id": 5, "flags": 0, "init_value": 2.0, "name": "a"}]
    gone = [{"id": 9, "flags": 1, "init_value": 0.0, "name": ""}]
    golden = frames.built_keyframe({5: 2.0, -1: 4.0}, {}, True, frames.GZIP, [], full, gone)
    assert golden["dict_deltas"] == full + gone and golden["flags"] == 0 and frames.read_keyframe(frames.decompress(golden["payload"], frames.GZIP)) == {5: 2.0, -1: 4.0}
    delta = frames.built_keyframe({5: 2.5, -1: 4.0}, golden["values"], False, frames.NONE, full, [], [])
    assert delta["quant_scale"] == pytest.approx(0.5 / 32767) and frames.read_delta_keyframe(delta["payload"], [5, -1], golden["values"], delta["quant_scale"]) == pytest.approx({5: 2.5, -1: 4.0}, abs=1e-4)
    r = frames.built_residual(np.array([1.27, -0.5]), 8, [5], [])
    assert frames.dequantize(r["payload"], 8, r["quant_scale"]) == pytest.approx([1.27, -0.5], abs=0.006) and frames.built_residual(np.zeros(3), 8, [], [])["quant_scale"] == 1e-6
    rows = spark.createDataFrame([([(5, 0, 2.0, "abc" * 50)] * 3, None, b"xy"), (None, None, None)], "dict_deltas array<struct<id: bigint, flags: smallint, init_value: float, name: string>>, snapshot_blob binary, payload binary")
    got = sorted(tuple(r) for r in frames.shadow_sizes(rows).collect())
    assert got[0] == (0, 0, 0, 78) and got[1][0] == 3 * 165 and got[1][1] < 200 and got[1][2:] == (3, 78 + 495 + 2)


def test_numbers_as_their_fewest_digits(spark):
    want = {0.0: "0", 10.0: "10", 0.5: "0.5", 100000.0: "100000", 1e6: "1e+06", 1234567.0: "1.234567e+06", 0.0001: "0.0001", 0.00001: "1e-05", 1.5e-7: "1.5e-07", -2.25: "-2.25", 1e100: "1e+100", 123456.789: "123456.789", float("inf"): "+Inf", 2.5e21: "2.5e+21", 0.000123: "0.000123"}
    got = spark.createDataFrame([(x,) for x in want], "b double").select("b", identity.bound_label(F.col("b")).alias("l")).collect()
    assert {r.b: r.l for r in got} == want
    for text in ("16 mib", " 16MB", "16  MB", "1.5MB", "16mb"):
        with pytest.raises(ValueError):
            identity.byte_size(text)


def test_forecasters():
    rng = np.random.default_rng(1)
    season = np.array([0.0, 5.0, -3.0, 2.0])
    y = 50 + np.tile(season, 30) + rng.normal(0, 0.3, 120)
    fitted, s, level, rates = conformal.holt_winters(y, 4)
    assert np.abs(y - fitted).max() < 1.5 and level + s == pytest.approx(50 + season, abs=0.4) and (rates >= 0).all() and rates.sum() <= 1
    f = conformal.Seasonal(4)
    f.fit(y)
    low, high = f.band(8)
    assert ((low < 50 + np.tile(season, 2)) & (50 + np.tile(season, 2) < high)).all()
    with pytest.raises(ValueError):
        conformal.Seasonal(168).fit(y)
    c = conformal.Constant(0.2)
    c.fit(np.arange(101.0))
    assert c.band(2)[0].tolist() == [10.0, 10.0] and c.band(1)[1].tolist() == [90.0]
    assert conformal.paired_seeds("a", 3) == conformal.paired_seeds("a", 5)[:3] != conformal.paired_seeds("b", 3)
    assert numeric.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5) and numeric.t_quantile(0.05, 30) == pytest.approx(-1.697261, abs=1e-5)


def test_trials_find_large_jumps_only(spark):
    from fathomline.operators import simulate

    rows = simulate.dead_zone(spark, [0.0, 0.1], [0.02, 20.0], 3, simulate.Setup(series=201, m=400)).cache()
    rates = {(r.noise, r.magnitude): r for r in simulate.cells(rows).collect()}
    assert rates[0.0, 20.0].detected_rate == 1.0 and rates[0.1, 0.02].recovered_rate == 0.0 and rates[0.1, 20.0].storm_rate == 1.0
    again = simulate.dead_zone(spark, [0.0, 0.1], [0.02, 20.0], 3, simulate.Setup(series=201, m=400))
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))
    floors = {r.noise: r.floor for r in analyze.recovery_floor(analyze.cell_rates(rows, ["noise", "magnitude"], ["detected"]), "noise", "magnitude", "detected_rate").collect()}
    assert floors[0.0] in (0.02, 20.0)


def test_pushed_frames_land_and_are_drained(spark, tmp_path):
    import urllib.error
    import urllib.request

    from fathomline.sources import push

    raw = frames.encode(dict.fromkeys("frame_type flags bits emitter_id shard_id epoch seq view_id m d predictor key_version codec dict_root".split(), 1) | {"energy": 2.0, "quant_scale": 0.5})
    folder = tmp_path / "in"

    def ask(url, data=None, method=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, method=method), timeout=5) as r:
                return r.status
        except urllib.error.HTTPError as e:
            return e.code

    with push.FrameServer(str(folder)) as server:
        assert [ask(server.url, raw), ask(server.url, b"junk"), ask(server.url), ask(server.url + "x", raw)] == [204, 400, 405, 404]
        request = urllib.request.Request(server.url, b"x", {"Content-Length": str(push.LARGEST + 1)})
        with pytest.raises(urllib.error.HTTPError, match="413"):
            urllib.request.urlopen(request, timeout=5)
    (folder / "0bad.plmp").write_bytes(b"bad")
    seen = []
    assert readers.drained_folder(spark, str(folder), lambda df: seen.extend(df.collect())) == (1, 1)
    assert len(seen) == 1 and seen[0].frame_type == 1 and (folder / ".processed" / "0bad.plmp.invalid").exists() and not list(folder.glob("*.plmp"))
    assert readers.drained_folder(spark, str(folder), lambda df: None) == (0, 0)


def test_spool_keeps_order_and_budget(spark, tmp_path):
    up, got = [False], []

    def sink(batch, number):
        if not up[0]:
            raise OSError("down")
        got.append((number, batch.count()))

    spool = writers.Spool(sink, str(tmp_path / "spool"), 1 << 20)
    for k in range(3):
        spool(spark.range(k + 1), k)
    assert got == [] and len(spool.waiting()) == 3
    (tmp_path / "spool" / f"{1:020d}").rename(tmp_path / "spool" / f"{9:020d}")
    for f in (tmp_path / "spool" / f"{9:020d}").glob("*.parquet"):
        f.write_bytes(b"broken")
    up[0] = True
    spool(spark.range(9), 10)
    assert got == [(0, 1), (2, 3), (10, 9)] and spool.unreadable == 1 and spool.waiting() == []
    up[0], small = False, writers.Spool(sink, str(tmp_path / "small"), 10)
    small(spark.range(5), 1)
    assert small.dropped == 1 and small.waiting() == []


def test_states_reports_and_frame_files(spark, tmp_path):
    folder = str(tmp_path / "state")
    (tmp_path / "state").mkdir()
    assert writers.load_state(spark, folder, "id long").count() == 0
    writers.save_state(spark.range(3), folder)
    writers.save_state(spark.range(5), folder)
    assert writers.load_state(spark, folder, "id long").count() == 5
    writers.report_json(spark.range(1).select(F.lit(0.5).alias("recall")), str(tmp_path / "r.json"))
    assert __import__("json").loads((tmp_path / "r.json").read_text()) == {"recall": 0.5}
    raw = frames.encode(dict.fromkeys("frame_type flags bits emitter_id shard_id epoch seq view_id m d predictor key_version codec dict_root".split(), 1) | {"energy": 2.0, "quant_scale": 0.5})
    batch = frames.decoded(spark.createDataFrame([(bytearray(raw),)], "content binary")).drop("error")
    writers.frame_files(batch, str(tmp_path / "out"))
    writers.frame_files(batch, str(tmp_path / "out"))
    assert [f.read_bytes() for f in (tmp_path / "out").iterdir()] == [raw]


def test_snapshots_wait_their_turn(spark):
    rows = spark.createDataFrame([("g", 1, k) for k in range(5)] + [("g", 2, 9), ("g", 7, 10)], "g string, w long, i long")
    got = {r.i: r.shipped for r in encode.staged_snapshots(rows, ["g"], ["i"], "w", 2, 1).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: None, 9: 3, 10: 7}


def test_window_book_closes_after_its_last_solve():
    book = windows.WindowBook(lateness=1, horizon=3)
    assert book.add([(0, "a", 1.0), (1, "a", 1.0)]) == [(0, 0, 1, 1.0)]
    assert book.add([(4, "a", 1.0)])[0] == (1, 0, 1, 1.0)
    assert book.add([(1, "b", 2.0), (0, "b", 2.0)]) == [(1, 1, 2, 3.0), (0, 1, 2, 3.0)]  # repairs keep a window open
    assert book.add([(9, "a", 1.0)])[0][0] == 4 and book.add([(0, "c", 1.0)]) == []


def test_settings_cover_keys_and_outputs():
    from fathomline.operators.config import Encoder, View

    Encoder(["r"], ["p"], tenant="t", keys=[(1, b"k")], active_key=1, output="topic", servers=["a:1"], topic="x", spool_folder="s").checked()
    with pytest.raises(ValueError) as e:
        Encoder(["r"], ["p"], keys=[(1, b""), (1, b"k")], active_key=2, codec="lz4", aggregates=["avg"], storm_multiple=1.0, output="topic", spool_bytes="x", pull_address=":1", views=[View("")], buffer_bytes="1 mb", snapshots=True, snapshots_per_flush=0).checked()
    for x in ("key 1 is empty", "one version", "version 2", "tenant", "codec", "aggregate avg", "over 1", "servers", "spool_bytes", "certificate", "token", "no name", "no label", "buffer_bytes", "snapshots_per_flush"):
        assert x in str(e.value), x


def test_generated_worlds_carry_their_truth(spark):
    w = synthetic.world(spark, groups=4, instances=3, windows=10, churn=0.2, noise=0.0, hot=1, hot_added=9.0)
    assert w.count() == 120 and w.where("instance >= 3").count() > 0 and w.where("grp = 0 and value > 100").count() > 0
    t = synthetic.lifecycle_truth(w, ["grp", "instance"], 10)
    assert t.where("type = 'birth'").count() > 0 and t.where("type = 'tombstone' and window_start > 9").count() == 0
    assert synthetic.drift_truth(spark, groups=4, drifting=1, windows=10, drift=2.0, base=100.0).first().magnitude == 18.0 and synthetic.hot_truth(spark, hot=2, windows=9, hot_added=5.0).count() == 2
    g = synthetic.background_and_target(spark, series=20, windows=30, bursts=[(5, 6, 1.0)])
    assert g.count() == 21 * 30 and g.where("series = 0 and w = 5").first().value > 1.3 * g.where("series = 0 and w = 4").first().value
    m = synthetic.month(spark, groups=3, days=4, emitters=2, life_days=1, incidents=[(5, 9, 1.0, 50.0, "ramp")])
    assert m.select("grp", "pod").distinct().count() > 3 and m.select("emitter").distinct().count() == 2
    f = spark.range(60).select(F.col("id").cast("string").alias("frame_id"), F.col("id").cast("double").alias("arrival"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("emitter"))
    got = synthetic.impaired(f, late=0.0, twice=0.0, skew={"a": 0.5}, cut_off=("b", 10.0, 20.0))
    assert got.where("emitter = 'b' and arrival = 20.0").count() == 5 and got.where("emitter = 'a' and arrival = 0.5").count() == 1
