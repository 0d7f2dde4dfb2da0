"""Removal of repeated passages through longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. For the
suffixes of all documents in suffix order, the previous and the next suffix of a smaller document give the longest
match with an earlier document; a match of ``length`` bytes or more marks the suffix. No machine holds that array, so
it is built in slices that can be taken apart:

1. Every window of ``length`` bytes is named by its minimizer, the smallest hash of its ``GRAM``-byte strings; equal
   windows have equal names wherever they are, and neighbouring windows mostly share one, so windows travel as runs.
2. Each task first builds the suffix slices of its own batch: what has an earlier copy there is settled and isn't
   sent on (the earlier copy stands for it), so passages of many copies shrink to one run a batch.
3. Runs that are left send their names, positions and no text. Names of a single document go no further.
4. Runs whose name two documents share send their bytes to the slice of that name. There the windows are put in
   suffix order, and LPF values mark what is a later copy. Names of very many runs are dealt out by the windows' own
   bytes instead, so that no slice grows with the number of copies.
5. The marked ranges meet their documents, and the bytes left are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import slices, utf8_values, written

#: Bytes of the strings whose smallest hash names a window.
GRAM = 16
#: Bytes of text hashed in one go, windows sorted in one go and bytes of a batch (unless one text is longer): they
#: bound a task's memory, not its results.
STEP, SORTED, BATCH = 1 << 20, 200_000, 8 << 20
#: Runs of one name in a batch, and in all, beyond which its windows are dealt out by their own bytes.
HOT_IN_BATCH, HOT = 512, 20_000

#: Bytes of text for each slice of the corpus.
PER_BUCKET = 16 << 20

def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buffer: np.ndarray) -> np.ndarray:
    """The little-endian number of 8 bytes at every position but the last 7."""
    n = len(buffer) - 7
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        part = buffer[k : k + (n - k + 7) // 8 * 8]
        out[k::8] = part.view("<u8")
    return out


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, index of text, start, windows) of the runs of neighbouring windows with one name in ``texts``."""
    found: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not pieces:
            return
        sizes = np.array([len(p[2]) for p in pieces])
        buffer = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(8), np.uint8)
        words = _words(buffer)
        low = _mixed(words[: len(words) - 8] + np.uint64(0x9E3779B97F4A7C15) * _mixed(words[8:]))
        spread, span = low[: int(sizes.sum()) - GRAM + 1], length - GRAM + 1
        done = 1
        while done * 2 <= span:
            spread = np.minimum(spread[:-done], spread[done:])
            done *= 2
        if rest := span - done:
            spread = np.minimum(spread[:-rest], spread[rest:])
        counts = sizes - length + 1
        first = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(pieces)), counts)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        names = spread[inside + first[piece]]
        cuts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (piece[1:] != piece[:-1])])
        owner = piece[cuts]
        text = np.array([p[0] for p in pieces])[owner]
        found.append((names[cuts], text, np.array([p[1] for p in pieces])[owner] + inside[cuts], np.diff(np.r_[cuts, len(piece)])))
        pieces.clear()

    held = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, STEP):
            pieces.append((k, at, text[at : at + STEP + length - 1]))
            held += len(pieces[-1][2])
            if held >= STEP:
                flush()
                held = 0
    flush()
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _window_words(buffer: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The bytes of each window as big-endian numbers of 8, one row for each place, zeros after the window's end."""
    wide = -(-length // 8)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    each = np.ndarray((len(padded) - wide * 8 + 1,), f"V{wide * 8}", padded, strides=(1,))
    words = np.ascontiguousarray(each[starts].view(">u8").reshape(len(starts), wide).T.astype(np.uint64))
    words[-1] &= np.uint64((1 << 64) - (1 << 8 * (wide * 8 - length)))
    return words


def _ordered(words: np.ndarray) -> np.ndarray:
    """The order of columns by their numbers from first to last; each place sorts only what those before left tied."""
    order = np.argsort(words[0], kind="stable")
    fresh = np.r_[True, words[0][order][1:] != words[0][order][:-1]][: len(order)]
    for place in words[1:]:
        tied = np.flatnonzero(~fresh | np.r_[~fresh[1:], False])
        if not len(tied):
            break
        group, some = np.cumsum(fresh)[tied], order[tied]
        value = place[some]
        by = np.lexsort((value, group))
        order[tied], value = some[by], value[by]
        fresh[tied] = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]
    return order


def suffix_order(buffer: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes at ``starts`` by their first ``length`` bytes, equal ones as given, and how many
    leading bytes each shares with the one before it, at most ``length``."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = _window_words(buffer, starts, length)
    # Copies are many here: equal suffixes are brought together first, so that the order is made of different ones.
    hashes = np.zeros(len(starts), np.uint64)
    for place in words:
        hashes = _mixed(hashes ^ place)
    near = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(near), bool)
    fresh[1:] = np.logical_or.reduce([place[near[1:]] != place[near[:-1]] for place in words])
    heads = np.flatnonzero(fresh)
    words = words[:, near[heads]]
    unlike = _ordered(words)
    counts = np.diff(np.r_[heads, len(near)])[unlike]
    order = near[np.repeat(heads[unlike] - (np.cumsum(counts) - counts), counts) + np.arange(len(near))]
    words = words[:, unlike]
    between, word = np.zeros(len(unlike) - 1, np.int64), np.zeros(len(unlike) - 1, np.uint64)
    for place in words:  # the first place that differs
        differ = place[1:] ^ place[:-1]
        between += 8 * ((word == 0) & (differ == 0))
        word = np.where(word == 0, differ, word)
    for byte in range(7, 0, -1):  # and its leading bytes without a difference
        between += word >> np.uint64(8 * byte) == 0
    lcp = np.full(len(order), length, np.int64)
    lcp[np.cumsum(counts)[:-1]] = np.minimum(between, length)
    lcp[0] = 0
    return order, lcp


def _one_way(docs: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Match length with the nearest suffix before that is of a smaller document; 0 once it is under ``least``.

    Pointers jump over what they have already passed, so chains of equal documents take logarithmic time."""
    n = len(docs)
    at, low = np.arange(n) - 1, lcp.copy()
    active = np.flatnonzero((at >= 0) & (low >= least))
    low[(at < 0) | (low < least)] = 0
    while len(active := active[(at[active] >= 0) & (low[active] >= least)]):
        active = active[docs[at[active]] >= docs[active]]
        over = at[active]
        low[active] = np.minimum(low[active], np.where(at[over] >= 0, low[over], 0))
        at[active] = at[over]
        low[active[low[active] < least]] = 0
    return low


def longest_previous(docs: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in suffix order: the longest match of ``least`` bytes or more with a smaller document, else 0."""
    before = _one_way(docs, lcp, least)
    backwards = np.r_[lcp[1:], 0][::-1]
    return np.maximum(before, _one_way(docs[::-1], backwards, least)[::-1])


#: Multipliers of the two hashes that tell windows apart, and their numbers for each byte.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = tuple(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES)


def window_hashes(text: np.ndarray, length: int) -> list[np.ndarray]:
    """Two 64-bit hashes of every window of a text, by running sums of powers."""
    out = []
    for base, numbers in zip(_BASES, _BYTES, strict=True):
        powers = np.full(len(text), base, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(numbers[text] * powers, dtype=np.uint64)]
        undo = np.cumprod(np.r_[np.uint64(1), np.full(len(text) - length, pow(base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        out.append(_mixed((sums[length:] - sums[:-length]) * undo))
    return out


def _window_starts(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at, counts)


def _marked(buffer: np.ndarray, window: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Whether each window has a copy in a smaller document, by suffix order and longest previous factors."""
    order, lcp = suffix_order(buffer, window, length)
    out = np.zeros(len(window), bool)
    out[order] = longest_previous(owner[order], lcp, length) >= length
    return out


def later_copies(buffer: np.ndarray, at: np.ndarray, docs: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of the runs (first byte in ``buffer``, document, windows) has a copy in a smaller document.

    Runs come ordered by name; slices end between names, so that equal windows are in one slice. A name of more than
    ``SORTED`` windows is cut further: of equal windows of one document (by 128 bits of hashes) one is sorted, and
    different ones are sorted in parts by their hashes, so that memory doesn't grow with repetition inside of texts."""
    total = int(counts.sum())
    if total <= SORTED:
        return _marked(buffer, _window_starts(at, counts), np.repeat(docs, counts), length)
    # Runs longer than a part are cut, so that parts of about SORTED windows can be gone through one by one.
    cuts = -(-counts // SORTED)
    run = np.repeat(np.arange(len(counts)), cuts)
    inside = (np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * SORTED
    at, docs, counts = at[run] + inside, docs[run], np.minimum(counts[run] - inside, SORTED)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first hash, second hash, document, first byte) of the windows, run by run."""
        sums, start = np.cumsum(counts), 0
        while start < len(counts):
            end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + SORTED, "right")))
            hashes = [window_hashes(buffer[a : a + c + length - 1], length) for a, c in zip(at[start:end].tolist(), counts[start:end].tolist(), strict=True)]
            yield np.concatenate([h[0] for h in hashes]), np.concatenate([h[1] for h in hashes]), np.repeat(docs[start:end], counts[start:end]), _window_starts(at[start:end], counts[start:end])
            start = end

    def different(columns: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort(columns[2::-1])
        columns = [c[order] for c in columns]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])]
        return [c[new] for c in columns]

    seen: list[np.ndarray] | None = None
    waiting: list[list[np.ndarray]] = []
    for part in parts():
        waiting.append(different(list(part)))
        if sum(len(w[0]) for w in waiting) >= max(SORTED, len(seen[0]) if seen else 0):
            seen, waiting = different([np.concatenate(c) for c in zip(*waiting, *([seen] if seen else []), strict=True)]), []
    if waiting:
        seen = different([np.concatenate(c) for c in zip(*waiting, *([seen] if seen else []), strict=True)])
    marks = np.zeros(len(seen[0]), bool)
    edges = np.flatnonzero(np.r_[True, seen[0][1:] != seen[0][:-1], True])  # equal windows stay together
    start = 0
    while start < len(marks):
        end = int(edges[max(np.searchsorted(edges, start, "right"), np.searchsorted(edges, start + SORTED, "right") - 1)])
        marks[start:end] = _marked(buffer, seen[3][start:end], seen[2][start:end], length)
        start = end
    held = _Held(*(c[marks] for c in seen[:3]))
    return np.concatenate([held.has(first, second, doc) for first, second, doc, _ in parts()])


class _Held:
    """Windows of documents, found again by their hashes."""

    def __init__(self, first: np.ndarray, second: np.ndarray, doc: np.ndarray):
        self.first, self.doc = np.unique(first), np.unique(doc)
        pair = np.searchsorted(self.first, first) * max(1, len(self.doc)) + np.searchsorted(self.doc, doc)
        order = np.argsort(pair)
        self.pair, self.second = pair[order], second[order]

    def has(self, first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), bool)
        if len(self.pair):
            i = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
            j = np.minimum(np.searchsorted(self.doc, doc), len(self.doc) - 1)
            asked = np.flatnonzero((self.first[i] == first) & (self.doc[j] == doc))
            pair = i[asked] * len(self.doc) + j[asked]
            k = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            out[asked] = (self.pair[k] == pair) & (self.second[k] == second[asked])
        return out


def _slices(names: np.ndarray, counts: np.ndarray) -> Iterator[slice]:
    """Parts of runs ordered by name of about ``SORTED`` windows, cut between names."""
    ends = np.flatnonzero(np.r_[names[1:] != names[:-1], True]) + 1
    sums = np.cumsum(counts)[ends - 1]
    start = 0
    while start < len(names):
        base = sums[np.searchsorted(ends, start, "right") - 1] if start else 0
        k = max(int(np.searchsorted(sums, base + SORTED, "right")) - 1, int(np.searchsorted(ends, start, "right")))
        yield slice(start, int(ends[k]))
        start = int(ends[k])


def _split(marks: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where the mark of their windows changes: (index of run, start, windows, mark)."""
    run = np.repeat(np.arange(len(counts)), counts)
    cuts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]) | (run[1:] != run[:-1])]) if len(run) else np.empty(0, np.int64)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    return run[cuts], starts[run[cuts]] + inside[cuts], np.diff(np.r_[cuts, len(run)]), marks[cuts]


def _planes(kinds: list[tuple[str, str]], n: int, columns: dict[str, np.ndarray]) -> np.ndarray:
    """Columns as the bytes of their rows, one row after another."""
    rows = np.empty(n, np.dtype(kinds))
    for name, values in columns.items():
        rows[name] = values
    return rows.view(np.uint8).reshape(n, -1)


def _packed(kinds: list[tuple[str, str]], starts: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[bytes]:
    """The rows from each of ``starts`` to the next, byte planes together, compressed; ``doc`` as differences within them.

    All is worked out for the rows together: a batch has as many parts as the corpus has slices, so what each part costs
    grows with the square of the input."""
    doc = columns["doc"].astype("<i8")
    columns = columns | {"doc": np.diff(doc, prepend=np.zeros(1, doc.dtype))}
    columns["doc"][starts] = doc[starts]
    planes = _planes(kinds, len(doc), columns)
    pack = zstandard.ZstdCompressor(level=1).compress
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True):
        yield pack(planes[s:e].T.tobytes())


def _rows_of(data: bytes, kind: np.dtype, unpack: Callable[[bytes], bytes]) -> np.ndarray:
    return np.frombuffer(unpack(data), np.uint8).reshape(kind.itemsize, -1).T


def _unpacked(data: bytes, kinds: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The columns of one part, ``doc`` still as differences."""
    kind = np.dtype(kinds)
    rows = np.ascontiguousarray(_rows_of(data, kind, zstandard.ZstdDecompressor().decompress)).view(kind)[:, 0]
    return {name: np.ascontiguousarray(rows[name]) for name, _ in kinds}


def _all_unpacked(parts: list[bytes], kinds: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The columns of all rows of the parts."""
    kind, unpack = np.dtype(kinds), zstandard.ZstdDecompressor().decompress
    each = [_rows_of(p, kind, unpack) for p in parts]
    rows = np.concatenate([np.empty((0, kind.itemsize), np.uint8), *each]).view(kind)[:, 0]
    sizes = np.array([len(p) for p in each], np.int64)
    out = {name: np.ascontiguousarray(rows[name]) for name, _ in kinds}
    sums = np.r_[0, np.cumsum(out["doc"])]
    out["doc"] = sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
    return out


_NAMES = [("name", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("start", "<i8"), ("count", "<i4"), ("hot", "u1")]
_SENT = [("name", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("start", "<i8"), ("count", "<i4")]
_RANGE = [("doc", "<i8"), ("copy", "<i4"), ("start", "<i8"), ("end", "<i8")]
#: What a row of packed columns holds.
NAMES, BYTES, RANGES = 0, 1, 2


def _row(kind: int, bucket: int, data: bytes, text: bytes = b"") -> tuple[int, int, bytes, bytes]:
    return kind, bucket, data, text


def _as_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary()), "text": pa.array([r[3] for r in rows], pa.binary())})


_PACKED = "kind int, bucket int, data binary, text binary"


def _batches(rows: Iterator[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about a megabyte."""
    held: list[tuple[int, int, bytes, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + len(row[3]) + 32
        if size >= 1 << 20:
            yield _as_batch(held)
            held, size = [], 0
    if held:
        yield _as_batch(held)


def _ranges_row(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int = 1) -> tuple[int, int, bytes, bytes]:
    order = np.lexsort((start, copy, doc))
    columns = {"doc": doc[order], "copy": copy[order], "start": start[order], "end": end[order]}
    return _row(RANGES, int(doc[0]) % buckets, next(_packed(_RANGE, np.zeros(1, np.int64), columns)))


def _bytes_rows(texts: list[bytes], index: np.ndarray, name: np.ndarray, doc: np.ndarray, copy: np.ndarray, start: np.ndarray, count: np.ndarray, hot: np.ndarray, length: int, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Runs with their bytes, by bucket; each window of a hot name goes by itself, named by a hash of its own bytes."""
    if hot.any():
        at = np.flatnonzero(hot)
        each = np.repeat(at, count[at])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        own_start = start[each] + inside
        own = np.array([int.from_bytes(hashlib.blake2b(texts[i][s : s + length], digest_size=8).digest(), "little") for i, s in zip(index[each].tolist(), own_start.tolist(), strict=True)], np.uint64)
        cold = np.flatnonzero(~hot)
        index, name, doc, copy = np.r_[index[cold], index[each]], np.r_[name[cold], own], np.r_[doc[cold], doc[each]], np.r_[copy[cold], copy[each]]
        start, count = np.r_[start[cold], own_start], np.r_[count[cold], np.ones(len(each), count.dtype)]
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, copy, doc, bucket))
    bucket, index, start, count = bucket[order], index[order], start[order], count[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    packed = _packed(_SENT, starts, {"name": name[order], "doc": doc[order], "copy": copy[order], "start": start, "count": count})
    pack = zstandard.ZstdCompressor(level=1).compress
    index, start, end = index.tolist(), start.tolist(), (start + count + length - 1).tolist()
    for b, s, e, data in zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], packed, strict=True):
        yield _row(BYTES, b, data, pack(b"".join([texts[index[k]][start[k] : end[k]] for k in range(s, e)])))


def _batch_rows(texts: list[bytes], ids: np.ndarray, copies: np.ndarray, length: int, buckets: int, most: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Steps 1 to 3 for a batch: settled ranges, the names of what is left, and the windows of names hot in the batch."""
    name, index, start, count = runs(texts, length)
    if not len(name):
        return
    order = np.argsort(name, kind="stable")
    edge = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    doc = ids[index]
    group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(order)]))
    by_name = doc[order]
    several = np.minimum.reduceat(by_name, edge) != np.maximum.reduceat(by_name, edge)
    shared = order[several[group]]
    left = [np.setdiff1d(np.arange(len(name)), shared, assume_unique=True)]
    if len(shared):
        for part in _slices(name[shared], count[shared]):
            o = shared[part]
            cut = [texts[i][s : s + c + length - 1] for i, s, c in zip(index[o].tolist(), start[o].tolist(), count[o].tolist(), strict=True)]
            sizes = count[o] + length - 1
            marks = later_copies(np.frombuffer(b"".join(cut), np.uint8), np.cumsum(sizes) - sizes, doc[o], count[o], length)
            run, at, n, marked = _split(marks, count[o], start[o])
            if marked.any():
                r = o[run[marked]]
                yield _ranges_row(doc[r], copies[index[r]], at[marked], at[marked] + n[marked] + length - 1, buckets)
            r = o[run[~marked]]
            left.append(np.arange(len(name), len(name) + len(r)))
            name, index, doc = np.r_[name, name[r]], np.r_[index, index[r]], np.r_[doc, doc[r]]
            start, count = np.r_[start, at[~marked]], np.r_[count, n[~marked]]
    keep = np.concatenate(left)
    name, index, doc, start, count = name[keep], index[keep], doc[keep], start[keep], count[keep]
    copy = copies[index]
    order = np.argsort(name, kind="stable")
    edge = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    size = np.diff(np.r_[edge, len(order)])
    hot = np.zeros(len(name), bool)
    hot[order] = np.repeat(size > most, size)
    if hot.any():
        yield from _bytes_rows(texts, index[hot], name[hot], doc[hot], copy[hot], start[hot], count[hot], np.ones(int(hot.sum()), bool), length, buckets)
    # A hot name sends one run more, to tell the others; its windows are already under way.
    told = order[edge[size > most]]
    send = np.r_[np.flatnonzero(~hot), told]
    flag = np.r_[np.zeros(len(send) - len(told), np.uint8), np.ones(len(told), np.uint8)]
    bucket = (name[send] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start[send], copy[send], doc[send], bucket))
    bucket, flag, o = bucket[order], flag[order], send[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    short = (name[o] // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
    packed = _packed(_NAMES, starts, {"name": short, "doc": doc[o], "copy": copy[o], "start": start[o], "count": count[o], "hot": flag})
    for b, data in zip(bucket[starts].tolist(), packed, strict=True):
        yield _row(NAMES, b, data)


def _first_pass(length: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            texts = utf8_values(batch, "text")
            ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield from _batches(_batch_rows(texts, ids, copies, length, buckets, most))

    return run


#: A run's start, windows and whether it is hot, in one number.
_COUNT_BITS = 23
_NAMED = "kind int, bucket int, doc long, copy int, name long, place long, data binary, text binary"


def _shared_names(most: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Of a bucket's names those of two documents or more, or hot somewhere: their runs as rows for their documents.

        Rows of other kinds go through as they are."""
        kinds = group.column("kind").to_numpy()
        name, doc, copy, start, count, hot = _all_unpacked(group.column("data").filter(pa.array(kinds == NAMES)).to_pylist(), _NAMES).values()
        if len(name):
            order = np.argsort(name, kind="stable")
            edge = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
            size = np.diff(np.r_[edge, len(order)])
            flagged = np.maximum.reduceat(hot[order], edge) > 0
            several = (np.minimum.reduceat(doc[order], edge) != np.maximum.reduceat(doc[order], edge)) | flagged
            own = np.zeros(len(name), bool)
            own[order] = np.repeat(flagged | (size > most), size)
            o = order[np.repeat(several, size)]
            o = o[hot[o] == 0]
        else:
            o, own = np.empty(0, np.int64), np.empty(0, bool)
        whole = name[o] * np.uint64(buckets) + np.uint64(key[0].as_py())
        place = (start[o] << (_COUNT_BITS + 1)) | (count[o].astype(np.int64) << 1) | own[o]
        n = len(o)
        out = pa.table({"kind": pa.array(np.full(n, NAMES, np.int32)), "bucket": pa.array(np.full(n, key[0].as_py(), np.int32)), "doc": pa.array(doc[o]), "copy": pa.array(copy[o]), "name": pa.array(whole.view(np.int64)), "place": pa.array(place), "data": pa.nulls(n, pa.binary()), "text": pa.nulls(n, pa.binary())})
        rest = group.filter(pa.array(kinds != NAMES))
        if not len(rest):
            return out
        n = len(rest)
        more = {"kind": rest["kind"], "bucket": rest["bucket"], "doc": pa.nulls(n, pa.int64()), "copy": pa.nulls(n, pa.int32()), "name": pa.nulls(n, pa.int64()), "place": pa.nulls(n, pa.int64()), "data": rest["data"].cast(pa.binary()), "text": rest["text"].cast(pa.binary())}
        return pa.concat_tables([out, pa.table(more)])

    return run


def _second_pass(length: int, buckets: int):
    """Rows (doc, copy, text, ..., runs) to their runs with bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            texts = utf8_values(batch, "text")
            lists = batch.column(batch.num_columns - 1)
            n = np.diff(lists.offsets.to_numpy())
            index = np.repeat(np.arange(len(n)), n)
            name, place = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            start, count, hot = place >> (_COUNT_BITS + 1), (place >> 1) & ((1 << _COUNT_BITS) - 1), (place & 1).astype(bool)
            ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield from _batches(_bytes_rows(texts, index, name.view(np.uint64), ids[index], copies[index], start, count, hot, length, buckets))

    return run


def _slice_ranges(length: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Step 4: the marked ranges of the windows of a bucket."""
        name, doc, copy, start, count = _all_unpacked(group.column("data").to_pylist(), _SENT).values()
        unpack = zstandard.ZstdDecompressor().decompress
        buffer = np.frombuffer(b"".join([unpack(t) for t in group.column("text").to_pylist()]), np.uint8)
        at = np.cumsum(count + length - 1) - (count + length - 1)
        order = np.lexsort((doc, name))
        rows = []
        for part in _slices(name[order], count[order]):
            o = order[part]
            marks = later_copies(buffer, at[o], doc[o], count[o], length)
            r, s, n, marked = _split(marks, count[o], start[o])
            r = o[r[marked]]
            if len(r):
                rows.append(_ranges_row(doc[r], copy[r], s[marked], s[marked] + n[marked] + length - 1))
        return pa.Table.from_batches([_as_batch(rows)])

    return run


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict(_all_unpacked([data], _RANGE))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges put together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of UTF-8 widened so that no character is split."""
    out = []
    for a, b in spans:
        while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return merged(out)


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def with_ranges(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, hot_in_batch: int = HOT_IN_BATCH, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with ``__ranges``, the unmerged byte ranges that go from each text (null: none).

    Rows of one id are not earlier than each other; rows with a null id lose nothing and take nothing from others.
    ``buckets`` sets into how many slices the corpus is cut: by default one for ``PER_BUCKET`` bytes of text, and four to
    a shuffle partition at least, so that slices stay of one size as the corpus grows.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_BUCKET))
    ids = docs.groupBy(id_col).count().where(f"`{id_col}` is not null and count > 1")
    copy = F.lit(0)
    if not ids.isEmpty():  # rows of one id are told apart by their order
        copy = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    rows = docs.withColumn("__copy", F.when(F.col(id_col).isNotNull(), copy).cast("int"))
    rest = [c for c in docs.columns if c != text_col]
    # Both joins take these rows whole, so that one exchange of the texts serves both.
    base = rows.select(F.col(id_col).cast("long").alias("doc"), F.col("__copy").alias("copy"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(rest)])
    alone, base = base.where("doc is null or copy is null"), base.where("doc is not null and copy is not null")
    first = base.select("doc", "copy", "text").mapInArrow(_first_pass(length, buckets, hot_in_batch), _PACKED)
    named = written(first.groupBy("bucket").applyInArrow(_shared_names(hot, buckets), _NAMED), "passage-names")
    # Dealt out by document before they are listed: lists of a part of a document's runs would be larger than the runs.
    wanted = named.where(f"kind = {NAMES}").select("doc", "copy", "name", "place").repartition("doc", "copy").groupBy("doc", "copy").agg(F.collect_list(F.struct("name", "place")).alias("runs"))
    sent = base.join(wanted.withColumnsRenamed({"doc": "__d", "copy": "__c"}), (base.doc == F.col("__d")) & (base["copy"] == F.col("__c"))).select(*base.columns, "runs").mapInArrow(_second_pass(length, buckets), _PACKED)
    slices = sent.select("bucket", "data", "text").unionByName(named.where(f"kind = {BYTES}").select("bucket", "data", "text")).groupBy("bucket").applyInArrow(_slice_ranges(length), _PACKED)
    packed = slices.select("data").unionByName(named.where(f"kind = {RANGES}").select("data"))
    found = packed.mapInArrow(_range_rows, "doc long, copy int, start long, end long").repartition("doc", "copy")
    by_doc = found.groupBy(F.col("doc").alias("__d"), F.col("copy").alias("__c")).agg(F.collect_list(F.struct("start", "end")).alias("__ranges"))
    joined = base.join(by_doc, (base.doc == F.col("__d")) & (base["copy"] == F.col("__c")), "left").select(*base.columns, "__ranges")
    joined = joined.unionByName(alone.withColumn("__ranges", F.lit(None).cast("array<struct<start: bigint, end: bigint>>")))
    back = {c: F.col(f"__{k}") for k, c in enumerate(rest)} | {text_col: F.col("text")}
    return joined.select(*[back[c].alias(c) for c in docs.columns], "__ranges")


def _spans(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    lists = batch.column(batch.schema.get_field_index("__ranges"))
    return [merged([(r["start"], r["end"]) for r in x]) if x else [] for x in lists.to_pylist()]


def digests(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, repeated rows included; ``limits`` as in ``with_ranges``."""
    marked = with_ranges(docs.select(id_col, text_col), length=length, id_col=id_col, text_col=text_col, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            data, spans = utf8_values(batch, text_col), _spans(batch)
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0), "n_bytes": pa.array(map(len, data), pa.int64()), "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                "n_spans": pa.array(map(len, spans), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(kept_bytes(d, s)).hexdigest() for d, s in zip(data, spans, strict=True)], pa.string()),
            })

    return marked.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_copies(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed passages cut out of each text; a character that a cut would split goes whole.

    Other columns and the number of rows stay; a null text stays null."""
    marked = with_ranges(docs, length=length, id_col=id_col, text_col=text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            new = [kept_bytes(d := t.encode(), whole_characters(d, s)).decode() if s else t for t, s in zip(texts, _spans(batch), strict=True)]
            cols = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], "__ranges").mapInArrow(run, docs.schema)
