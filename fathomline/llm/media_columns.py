"""Media columns as ISO base media containers (MP4 family).

``container`` writes samples of one size into a container; ``described`` walks the nested boxes of any container,
decodes its sample tables and those of its fragments and gives codec, duration and the byte ranges of keyframes
without decoding a payload; ``samples`` reads the payload back through the sample tables. Sizes and counts are taken
from tables only as far as the file can hold them, so a hostile table costs no more than its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import per_row, utf8_values

#: Box types that hold boxes. Fixed values of the format.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: A frame of 8-bit samples, frames from one keyframe to the next, frames in a chunk and frames a second.
WIDTH, HEIGHT, GROUP, CHUNK, RATE = 24, 24, 12, 10, 25
SAMPLE = WIDTH * HEIGHT
PAD = b"\xff"
_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of a frame."""
    return data + PAD * (-len(data) % SAMPLE) if data else PAD * SAMPLE


def container(payload: bytes) -> bytes:
    """A container with one track of uncompressed 8-bit grey frames that holds ``payload``, a multiple of a frame."""
    if not payload or len(payload) % SAMPLE:
        raise ValueError("the payload isn't a positive number of whole frames")
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    rest = n % CHUNK
    keys = range(1, n + 1, GROUP)
    to_chunk = [(1, CHUNK, 1)] if n >= CHUNK else []
    if rest:
        to_chunk.append((chunks, rest, 1))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def head(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = [first + k * CHUNK * SAMPLE for k in range(chunks)]
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", *x) for x in to_chunk)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), _UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
        return ftyp + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    long = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head(0)) + len(mdat)
    return head(first) + mdat + payload


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the body, end) of the boxes from ``start`` to ``end``."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} reaches beyond what holds it")
        yield kind, body, stop
        start = stop


#: Flags of fragments: which fields are there, and the sample flag of one that needs others. Fixed values of the format.
BASE, FIRST_FLAGS, DURATION, SIZE, FLAGS, SHIFT, NEEDS_OTHERS = 1, 4, 0x100, 0x200, 0x400, 0x800, 0x10000


@dataclass
class Track:
    ident: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    chunks: list[int] = field(default_factory=list)
    per_chunk: list[tuple[int, int, int]] = field(default_factory=list)
    same_size: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    n: int = 0
    sync: list[int] | None = None
    ticks: int = 0
    #: Least and largest shift of a sample's time of showing, and the length of the edits in the movie's time scale.
    shifts: tuple[int, int] = (0, 0)
    edited: int | None = None
    #: Defaults of fragments (duration, size, flags), and the samples of fragments as (offset, sizes, keyframes).
    defaults: tuple[int, int, int] = (0, 0, 0)
    fragments: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def frames(self) -> int:
        return self.n + sum(len(sizes) for _, sizes, _ in self.fragments)

    def seconds(self) -> float:
        return self.ticks / max(self.timescale, 1)

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(offset, first sample counted from 0, samples) of every chunk."""
        sample, k = 0, 0
        for chunk, offset in enumerate(self.chunks, 1):
            while k + 1 < len(self.per_chunk) and self.per_chunk[k + 1][0] <= chunk:
                k += 1
            held = min(self.per_chunk[k][1], self.n - sample) if self.per_chunk else 0
            yield offset, sample, held
            sample += held

    def span(self, first: int, count: int) -> int:
        return self.same_size * count if self.same_size else int(self.sizes[first : first + count].sum())

    def check(self, size: int) -> None:
        """Refuses tables that a file of ``size`` bytes can't have."""
        if self.same_size and self.n * self.same_size > size:
            raise ValueError(f"{self.n} samples of {self.same_size} bytes don't fit the file")
        held = 0
        for offset, first, count in self.runs():
            held += count
            if offset + self.span(first, count) > size:
                raise ValueError("a chunk reaches beyond the end")
        if held < self.n:
            raise ValueError(f"the chunks hold {held} of {self.n} samples")
        for offset, sizes, _ in self.fragments:
            if offset + int(sizes.sum()) > size:
                raise ValueError("a fragment reaches beyond the end")

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges of the samples that need no other; without a table all of them."""
        wanted = iter(range(1, self.n + 1) if self.sync is None else self.sync)
        found, want = [], next(wanted, None)
        for offset, first, held in self.runs():
            at, last = offset, first
            while want is not None and want - 1 < first + held:
                at += self.span(last, want - 1 - last)
                last = want - 1
                found.append((at, at + self.span(last, 1)))
                want = next(wanted, None)
        for offset, sizes, keys in self.fragments:
            ends = offset + np.cumsum(sizes)
            found += [(int(ends[k] - sizes[k]), int(ends[k])) for k in np.flatnonzero(keys)]
        return found


def tracks(media: bytes) -> list[Track]:
    """The tracks of a container, from its sample tables and fragments alone."""
    data = memoryview(media)
    found: list[Track] = []
    scale = [0]
    moof = [0]
    current: list = [None, None, (0, 0, 0)]  # of a fragment: its track, base offset and defaults

    def table(at: int, kind: str, stop: int) -> list[int]:
        (count,) = struct.unpack_from(">I", data, at + 4)
        if at + 8 + count * struct.calcsize(f">{kind}") > stop:
            raise ValueError("a table is longer than its box")
        return list(struct.unpack_from(f">{count * len(kind)}{kind[0]}", data, at + 8))

    def sample_sizes(at: int, stop: int, bits: int, n: int) -> np.ndarray:
        if n * bits > (stop - at) * 8:
            raise ValueError("a table is longer than its box")
        raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), at)
        if bits == 4:
            return np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:n].astype(np.int64)
        return raw.view(f">u{bits // 8}").astype(np.int64)

    def header(at: int) -> None:
        """A fragment's track and defaults."""
        flags, ident = struct.unpack_from(">II", data, at)
        track = next((t for t in found if t.ident == ident), None)
        if track is None:
            raise ValueError(f"a fragment of track {ident}, which isn't there")
        at += 8
        base, defaults = moof[0], list(track.defaults)
        if flags & 1:
            (base,) = struct.unpack_from(">Q", data, at)
            at += 8
        at += 4 if flags & 2 else 0
        for k, bit in enumerate((8, 16, 32)):
            if flags & bit:
                (defaults[k],) = struct.unpack_from(">I", data, at)
                at += 4
        current[:] = [track, base, tuple(defaults)]

    def run(at: int, stop: int) -> None:
        """A fragment's samples."""
        track, base, (duration, size, sample_flags) = current
        if track is None:
            raise ValueError("a fragment without a header")
        flags, count = struct.unpack_from(">II", data, at)
        at += 8
        if flags & BASE:
            base += struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & FIRST_FLAGS:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        fields = [bit for bit in (DURATION, SIZE, FLAGS, SHIFT) if flags & bit]
        if at + 4 * len(fields) * count > stop or not flags & SIZE and size * count > len(data):
            raise ValueError("a fragment's samples don't fit")
        if not fields and not size and count > len(data):
            raise ValueError("a fragment has more samples than the file bytes")
        rows = np.frombuffer(data, ">u4", len(fields) * count, at).reshape(count, len(fields)).astype(np.int64)
        each = {bit: rows[:, k] for k, bit in enumerate(fields)}
        sizes = each.get(SIZE, np.full(count, size, np.int64))
        kinds = each.get(FLAGS, np.full(count, sample_flags, np.int64)).copy()
        if first is not None and count:
            kinds[0] = first
        track.ticks += int(each[DURATION].sum()) if DURATION in each else duration * count
        track.fragments.append((base, sizes, kinds & NEEDS_OTHERS == 0))
        current[1] = base + int(sizes.sum())

    def walk(start: int, end: int, depth: int) -> None:
        if depth > 16:
            raise ValueError("boxes are nested too deeply")
        for kind, at, stop in boxes(data, start, end):
            if kind == b"trak":
                found.append(Track())
            elif kind == b"moof":
                moof[0] = at - 8
            if kind in NESTS:
                walk(at, stop, depth + 1)
            elif kind == b"mvhd":
                (scale[0],) = struct.unpack_from(">I", data, at + (20 if data[at] else 12))
            elif kind == b"trex":
                ident, _, *defaults = struct.unpack_from(">IIIII", data, at + 4)
                for t in found:
                    if t.ident == ident:
                        t.defaults = tuple(defaults)
            elif kind == b"tfhd":
                header(at)
            elif kind == b"trun":
                run(at, stop)
            elif found:
                described_by(found[-1], kind, at, stop)

    def described_by(t: Track, kind: bytes, at: int, stop: int) -> None:
        if kind == b"tkhd":
            (t.ident,) = struct.unpack_from(">I", data, at + (20 if data[at] else 12))
        elif kind == b"hdlr":
            t.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        elif kind == b"elst":
            wide = bool(data[at])
            (count,) = struct.unpack_from(">I", data, at + 4)
            step = 20 if wide else 12
            if at + 8 + count * step > stop:
                raise ValueError("a table is longer than its box")
            t.edited = sum(struct.unpack_from(">Q" if wide else ">I", data, at + 8 + k * step)[0] for k in range(count))
        elif kind == b"stsd":
            t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
            if t.handler == "vide":
                t.width, t.height = struct.unpack_from(">HH", data, at + 40)
        elif kind == b"stts":
            flat = table(at, "II", stop)
            t.ticks = sum(c * d for c, d in zip(flat[::2], flat[1::2], strict=True))
        elif kind == b"ctts":
            shifts = table(at, "II" if not data[at] else "ii", stop)[1::2]
            t.shifts = (min(shifts, default=0), max(shifts, default=0))
        elif kind == b"stss":
            t.sync = table(at, "I", stop)
        elif kind == b"stsc":
            flat = table(at, "III", stop)
            t.per_chunk = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
        elif kind == b"stsz":
            t.same_size, t.n = struct.unpack_from(">II", data, at + 4)
            t.sizes = np.empty(0, np.int64) if t.same_size else sample_sizes(at + 12, stop, 32, t.n)
        elif kind == b"stz2":
            bits, t.n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            if bits not in (4, 8, 16):
                raise ValueError(f"sample sizes of {bits} bits")
            t.sizes = sample_sizes(at + 12, stop, bits, t.n)
        elif kind in (b"stco", b"co64"):
            t.chunks = table(at, "I" if kind == b"stco" else "Q", stop)

    walk(0, len(data), 0)
    for t in found:
        t.check(len(media))
        if t.edited is not None:
            t.edited = t.edited * max(t.timescale, 1) // max(scale[0], 1)
    return found


def samples(media: bytes, track: Track) -> bytes:
    """The bytes of all samples of a track in order."""
    parts = [media[offset : offset + track.span(first, held)] for offset, first, held in track.runs()]
    return b"".join(parts + [media[offset : offset + int(sizes.sum())] for offset, sizes, _ in track.fragments])


def _feature(t: Track) -> str:
    return f"{t.codec.strip()} {t.width}x{t.height} {t.n} frames {t.ticks / max(t.timescale, 1):.2f} s keys " + ",".join(f"{a}-{b}" for a, b in t.keyframes())


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes (null: none), padded to whole frames, as a container."""

    def rows(batch: pa.RecordBatch) -> dict:
        data = utf8_values(batch, text_col)
        return {id_col: batch.column(0), "n_bytes": pa.array(map(len, data), pa.int64()), "media": pa.array([container(padded(x)) for x in data], pa.binary())}

    return per_row(docs, [id_col, text_col], f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, media binary", rows)


_KEYS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACK = pa.struct([("kind", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int64()), ("duration_s", pa.float64()), ("presented_s", pa.float64()), ("keyframes", _KEYS)])


def _described(t: Track) -> dict:
    presented = (t.edited if t.edited is not None else t.ticks) / max(t.timescale, 1)
    return {"kind": t.handler, "codec": t.codec.strip(), "width": t.width, "height": t.height, "frames": t.frames, "duration_s": t.seconds(), "presented_s": presented, "keyframes": [{"start": a, "end": b} for a, b in t.keyframes()]}


def described(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per row codec, size, frames, duration in seconds and keyframe byte ranges of the first track of pictures (else of
    the first track), and the same of all ``tracks`` with the time that edits leave (``presented_s``).

    A null, empty or broken container, or one whose tables point beyond its end, gives nulls and the reason in
    ``error``; a row is never dropped.
    """
    names = ("codec", "width", "height", "frames", "duration_s", "keyframes")

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in (*names, "tracks", "error")}
        for data in batch.column(1).to_pylist():
            try:
                every = [_described(t) for t in tracks(data or b"")]
                if not every:
                    raise ValueError("no track")
                first = next((t for t in every if t["kind"] == "vide"), every[0])
                got = (*(first[k] for k in names), every, None)
            except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
                got = (*(None for _ in names), None, str(e) or type(e).__name__)
            for k, v in zip(out, got, strict=True):
                out[k].append(v)
        kinds = {"codec": pa.string(), "width": pa.int32(), "height": pa.int32(), "frames": pa.int64(), "duration_s": pa.float64(), "keyframes": _KEYS, "tracks": pa.list_(_TRACK), "error": pa.string()}
        return {id_col: batch.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()}

    keys = "array<struct<start: long, end: long>>"
    track = f"struct<kind: string, codec: string, width: int, height: int, frames: long, duration_s: double, presented_s: double, keyframes: {keys}>"
    schema = f"codec string, width int, height int, frames long, duration_s double, keyframes {keys}, tracks array<{track}>, error string"
    return per_row(media, [id_col, media_col], f"`{id_col}` {dict(media.dtypes)[id_col]}, {schema}", rows)


def round_trips(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's stored container and of the payload read back from it, in one pass without a shuffle."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in utf8_values(batch, text_col):
            media = container(padded(data))
            track = tracks(media)[0]
            back = samples(media, track)
            got = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), _feature(track))
            for k, v in zip(out, got, strict=True):
                out[k].append(v)
        return {id_col: batch.column(0)} | {k: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for k, v in out.items()}

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return per_row(docs, [id_col, text_col], f"`{id_col}` {dict(docs.dtypes)[id_col]}, {schema}", rows)
