"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages. Every passage is encoded; gated attention, learned from labels of whole documents,
weighs the passages; the weighted sum is scored. So a label needs no passage labels, and the weights tell which
passages a score rests on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import slices, utf8_values

#: Bytes of a passage; kinds of bytes that features count, by themselves and in pairs.
PASSAGE, KINDS = 600, 15
FEATURES = KINDS + KINDS * KINDS + 3
#: Text featurised in one go.
STEP = 1 << 20


def _kinds() -> np.ndarray:
    """The kind of each byte: letters by case, digits, kinds of white space and of marks, parts of longer characters."""
    kind = np.full(256, 14, np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    for k, chars in enumerate((b" ", b"\n\r\t\v\f", b".", b",", b"!", b"?", b"|", b"\"'()[]{}<>", b"#$%&*+/:;=@\\^_`~-"), 3):
        kind[list(chars)] = k
    kind[128:192], kind[192:] = 12, 13
    return kind


_KIND = _kinds()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each text). An empty text is one passage of zeros."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), FEATURES), np.float32)
    row, block, size, first = 0, [], 0, 0
    for k, t in enumerate(texts):
        for part in range(0, max(len(t), 1), STEP - STEP % PASSAGE):
            block.append(t[part : part + STEP - STEP % PASSAGE])
            size += len(block[-1])
            row += max(1, -(-len(block[-1]) // PASSAGE))
            if size >= STEP or k == len(texts) - 1 and part + STEP - STEP % PASSAGE >= len(t):
                _features(block, out[first:row])
                block, size, first = [], 0, row
    return out, counts


def _features(texts: list[bytes], out: np.ndarray) -> None:
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = np.repeat(np.cumsum(n) - n, sizes) + place // PASSAGE
    kind = _KIND[data].astype(np.int64)
    total = np.bincount(of, minlength=len(out)).astype(np.float32)
    base = np.maximum(total, 1)[:, None]
    out[:, :KINDS] = np.sqrt(np.bincount(of * KINDS + kind, minlength=len(out) * KINDS).reshape(-1, KINDS) / base)
    same = of[1:] == of[:-1]
    pair = (of[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
    out[:, KINDS : KINDS + KINDS * KINDS] = np.sqrt(np.bincount(pair[same], minlength=len(out) * KINDS * KINDS).reshape(-1, KINDS * KINDS) / base)
    # Words by their first seven bytes: how long they are, how many are there and how many of them differ.
    gap = (kind == 3) | (kind == 4)
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1] | (of[1:] != of[:-1])])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.zeros(len(start), np.uint64)
    for k in range(7):
        head = (head << np.uint64(8)) | padded[start + k].astype(np.uint64)
    word = (head * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) | (of[start].astype(np.uint64) << np.uint64(32))
    words = np.bincount(of[start], minlength=len(out))
    distinct = np.bincount((np.unique(word) >> np.uint64(32)).astype(np.int64), minlength=len(out))
    out[:, -3] = distinct / np.maximum(words, 1)
    out[:, -2] = np.log1p(total / np.maximum(words, 1))
    out[:, -1] = np.log1p(total)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale).clip(-6, 6) @ self.w["e"] + self.w["eb"], 0)

    def scores(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage)."""
        first = np.cumsum(counts) - counts
        h = np.concatenate([self.encoded(x[k : k + 16_384]) for k in range(0, len(x), 16_384)]) if len(x) else np.zeros((0, len(self.w["eb"])))
        a, _, _ = _attention(h, self.w, first, counts)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return 1 / (1 + np.exp(-(z @ self.w["o"] + self.w["ob"]).clip(-30, 30))), a


def _attention(h: np.ndarray, w: dict[str, np.ndarray], first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gated attention, one softmax for each bag."""
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"]).clip(-30, 30)))
    s = (t * g) @ w["a"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
    return s / np.repeat(np.add.reduceat(s, first), counts), t, g


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, *, width: int = 32, hidden: int = 16, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Model:
    """Gradient descent (Adam) on the log loss of the bags' labels, in mini-batches of bags."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    shape = {"e": (x.shape[1], width), "v": (width, hidden), "u": (width, hidden)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()} | {"eb": np.zeros(width), "a": rng.normal(0, 0.3, hidden), "o": rng.normal(0, 0.3, width), "ob": np.zeros(())}
    x = ((x - mean) / scale).clip(-6, 6)
    start = np.cumsum(counts) - counts
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(counts))
        for k in range(0, len(order), 128):
            bags = order[k : k + 128]
            n = counts[bags]
            first = np.cumsum(n) - n
            rows = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(start[bags], n)
            xb = x[rows]
            pre = xb @ w["e"] + w["eb"]
            h = np.maximum(pre, 0)
            a, t, g = _attention(h, w, first, n)
            z = np.add.reduceat(h * a[:, None], first, axis=0)
            p = 1 / (1 + np.exp(-(z @ w["o"] + w["ob"]).clip(-30, 30)))
            d = (p - labels[bags]) / len(bags)
            dz = np.repeat(d[:, None] * w["o"], n, axis=0)
            da = (dz * h).sum(axis=1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
            dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
            dh = (dz * a[:, None] + dt @ w["v"].T + dg @ w["u"].T) * (pre > 0)
            grad = {"o": z.T @ d, "ob": d.sum(), "a": (t * g).T @ ds, "v": h.T @ dt, "u": h.T @ dg, "e": xb.T @ dh, "eb": dh.sum(axis=0)}
            step += 1
            now = rate * (1 - epoch / epochs)
            for key in w:
                g_ = grad[key] + decay * w[key]
                m[key] = 0.9 * m[key] + 0.1 * g_
                v[key] = 0.999 * v[key] + 0.001 * g_ * g_
                w[key] = w[key] - now * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), {k: np.asarray(p, np.float32) for k, p in w.items()})


def constant(share: float) -> Model:
    """What is learned from labels of one kind or none: the same score for all."""
    odds = np.log((share + 1e-3) / (1 - share + 1e-3))
    zero = {"e": np.zeros((FEATURES, 1)), "eb": np.zeros(1), "v": np.zeros((1, 1)), "u": np.zeros((1, 1)), "a": np.zeros(1), "o": np.zeros(1), "ob": np.array(odds)}
    return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), {k: v.astype(np.float32) for k, v in zero.items()})


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 4000, most_passages: int = 60_000, **how) -> Model:
    """Learn from a bounded sample of labelled rows, whole texts each: pairs of a document and a label (0 or 1; nulls
    ignored) in the order of a hash of the id, ``most_rows`` of them at most, and of these as many as together have
    ``most_passages`` passages at most, which is what the driver holds (about 1 KB each).

    A pair that occurs several times counts once. Contradicting labels of one id all count, and all texts of one id.
    """
    wanted = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label")).where("__id is not null and __label in (0.0, 1.0)").distinct()
    wanted = wanted.orderBy(F.xxhash64("__id"), "__id", "__label").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(wanted), F.col("__doc") == F.col("__id"))  # at most most_rows rows
    named = rows.select("__id", "__label", F.xxhash64("text").alias("__text"), F.octet_length("text").alias("size")).distinct()
    sample, held = [], 0
    for r in named.orderBy(F.xxhash64("__id"), "__id", "__label", "__text", "size").limit(most_rows).collect():
        n = max(1, -(-r["size"] // PASSAGE))
        if held + n <= most_passages:
            sample.append((r["__id"], r["__label"], r["__text"]))
            held += n
    kind = dict(docs.dtypes)[id_col]
    chosen = docs.sparkSession.createDataFrame(sample, f"__id {dict(labels.dtypes)[id_col]}, __label double, __text long")
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), (F.col("__doc") == F.col("__id")) & (F.xxhash64("text") == F.col("__text"))).select("__doc", "__label", "text")  # as many rows as the sample has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, counts = passages(utf8_values(batch, "text"))
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(1), "x": pa.array([x[f : f + c].tobytes() for f, c in zip(first.tolist(), counts.tolist(), strict=True)], pa.binary())})

    got = rows.mapInArrow(run, f"id {kind}, label double, x binary").dropDuplicates().limit(len(sample)).collect() if sample else []
    got.sort(key=lambda r: (r["id"], r["label"], r["x"]))
    y = np.array([r["label"] for r in got])
    if len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), y, **how)


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, top_passage, n_passages) of every row: the score of the whole text, null as empty, and the passage
    of the highest attention with how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            if part.num_rows:
                x, counts = passages(utf8_values(part, text_col))
                score, a = shared.value.scores(x, counts)
                first = np.cumsum(counts) - counts
                top = [int(a[f : f + c].argmax()) for f, c in zip(first.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "score": pa.array(score.astype(np.float64)), "top_passage": pa.array(top, pa.int64()), "n_passages": pa.array(counts)})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, top_passage long, n_passages long")
