"""Settings of an encoder, validated on the driver before a plan is built; all faults are reported together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fathomline.functions.identity import byte_size

TIERS = ("exact", "sketched", "merged")


@dataclass
class View:
    name: str
    keys: list[str] = field(default_factory=list)


@dataclass
class Encoder:
    logical_key: list[str]
    instance_key: list[str]
    shard_by: list[str] = field(default_factory=list)
    views: list[View] = field(default_factory=list)
    rules: list[tuple[str, str]] = field(default_factory=list)
    m: int = 2000
    d: int = 6
    bits: int = 8
    flush_s: float = 10.0
    keyframe_every: int = 6
    golden_every: int = 0
    golden_s: float = 0.0
    ttl_s: float = 90.0
    rotate_s: float = 0.0
    jitter_s: float = 0.0
    storm_multiple: float = 3.0
    top_k: int = 50
    tenant: str = ""
    aggregates: list[str] = field(default_factory=lambda: ["sum", "count", "max"])
    #: Keys by version, and the version that new frames are keyed with; no keys: frames aren't keyed.
    keys: list[tuple[int, bytes]] = field(default_factory=list)
    active_key: int = 0
    codec: str = "none"
    snapshots: bool = False
    snapshot_threshold: float = 3.0
    snapshots_per_flush: int = 5
    snapshot_ttl_s: float = 60.0
    buffer_s: float = 900.0
    buffer_instances: int = 1000
    buffer_bytes: str = "64MB"
    births_per_minute: int = 100
    output: str = "file"
    output_folder: str = "frames"
    servers: list[str] = field(default_factory=list)
    topic: str = ""
    spool_folder: str = ""
    spool_bytes: str = "64MB"
    drain_s: float = 5.0
    #: A pull address is answered only to clients with a certificate and a token.
    pull_address: str = ""
    pull_certificates: tuple[str, str, str] = ("", "", "")
    pull_token: str = ""

    def resolved_views(self) -> list[View]:
        """The configured views, else one of the logical key."""
        return self.views or [View("default", self.logical_key)]

    def golden_windows(self) -> int:
        """How many windows are between golden keyframes; the two ways to say it must agree."""
        by_time = round(self.golden_s / self.flush_s) if self.golden_s else 0
        if self.golden_every and by_time and self.golden_every != by_time:
            raise ValueError(f"golden keyframes every {self.golden_every} windows and every {self.golden_s} s disagree")
        return self.golden_every or by_time or 10 * self.keyframe_every

    def checked(self) -> Encoder:
        """Itself, or one ValueError with every fault."""
        faults = []
        if not self.logical_key:
            faults.append("logical_key is empty")
        if set(self.logical_key) & set(self.instance_key):
            faults.append("a label is in the logical and the instance key")
        positive = ["m", "d", "flush_s", "keyframe_every", "ttl_s", "top_k", "buffer_s", "buffer_instances", "births_per_minute"]
        positive += ["snapshot_threshold", "snapshots_per_flush", "snapshot_ttl_s"] if self.snapshots else []
        positive += ["drain_s"] if self.output == "topic" else []
        faults += [f"{name} must be positive" for name in positive if getattr(self, name) <= 0]
        if self.storm_multiple <= 1:
            faults.append("storm_multiple must be over 1")
        if not self.aggregates:
            faults.append("aggregates is empty")
        faults += [f"unknown aggregate {a}" for a in self.aggregates if a not in ("sum", "count", "max")]
        if self.keys:
            versions = [v for v, _ in self.keys]
            faults += [f"key {v} is empty" for v, key in self.keys if not key]
            if len(set(versions)) < len(versions):
                faults.append("two keys have one version")
            if self.active_key not in versions:
                faults.append(f"there is no key of version {self.active_key}")
            if not self.tenant:
                faults.append("keys need a tenant")
        if self.codec not in ("none", "gzip", "zstd"):
            faults.append(f"unknown codec {self.codec}")
        sizes = [("buffer_bytes", self.buffer_bytes)] + ([("spool_bytes", self.spool_bytes)] if self.output == "topic" else [])
        for name, size in sizes:
            try:
                byte_size(size)
            except ValueError as e:
                faults.append(f"{name}: {e}")
        if self.output == "file":
            faults += [] if self.output_folder else ["output_folder is empty"]
        elif self.output == "topic":
            faults += [f"{name} is empty" for name in ("servers", "topic", "spool_folder") if not getattr(self, name)]
        else:
            faults.append(f"unknown output {self.output}")
        if self.pull_address:
            faults += [] if all(self.pull_certificates) else ["a pull address needs a certificate, its key and the clients' authority"]
            faults += [] if self.pull_token else ["a pull address needs a token"]
        if self.d > self.m > 0:
            faults.append("d is larger than m")
        if self.bits not in (8, 16):
            faults.append("bits must be 8 or 16")
        if self.rotate_s < 0 or self.jitter_s < 0 or self.jitter_s and self.jitter_s >= self.rotate_s:
            faults.append("jitter must be under the rotation, neither negative")
        names = [v.name for v in self.views]
        faults += ["a view has no name"] if "" in names else []
        faults += [f"view {v.name} has no label" for v in self.views if not v.keys]
        if len(names) != len(set(names)):
            faults.append("two views have one name")
        for pattern, tier in self.rules:
            if tier not in TIERS:
                faults.append(f"unknown tier {tier}")
            try:
                re.compile(pattern)
            except re.error as e:
                faults.append(f"pattern {pattern!r}: {e}")
        try:
            if self.flush_s > 0 and self.golden_windows() % max(self.keyframe_every, 1):
                faults.append("golden keyframes aren't keyframes")
        except ValueError as e:
            faults.append(str(e))
        if faults:
            raise ValueError("; ".join(faults))
        return self
