"""Explicit schemas of what flows between operators; nothing is inferred."""

SAMPLES = "metric string, type string, res_attrs map<string,string>, attrs map<string,string>, value double, bucket_counts array<bigint>, bounds array<double>, ts timestamp"
DICT_DELTAS = "array<struct<id: bigint, flags: smallint, init_value: float, name: string>>"
FRAME = f"version smallint, frame_type smallint, flags smallint, bits smallint, emitter_id bigint, shard_id bigint, epoch bigint, seq bigint, view_id int, m bigint, d smallint, predictor smallint, key_version smallint, codec smallint, energy float, quant_scale float, dict_root bigint, dict_deltas {DICT_DELTAS}, snapshot_blob binary, payload binary"
SNAPSHOT = "array<struct<id: bigint, ts_ms: bigint, value: float>>"
ANOMALY = f"substrate string, confidence string, shard_id bigint, emitter_id bigint, epoch bigint, view_id int, window_id bigint, series_id bigint, series_name string, value double, residual double, coverage int, coverage_total int, revision int, merged_trust string, detected_at timestamp, snapshot {SNAPSHOT}"
SAMPLE_OUT = "series_id bigint, name string, shard_id bigint, emitter_id bigint, view_id int, value double, timestamp_ms bigint"
TRUTH = "type string, series_id bigint, series_name string, shard_id bigint, view_id int, window_start bigint, window_end bigint, expected_value double, magnitude double, timestamp timestamp"
