"""Language identification by words first, backing off to ever shorter character n-grams.

A word of the model scores by the logarithm of its frequency in each language. A word that the model doesn't know
scores by its longest character n-grams that the model knows (their mean), from ``max_gram`` characters down to one.
A text scores by the mean over its words. Counts cover all training rows. The model keeps the most frequent words and
n-grams of each language, each with its counts in all languages, up to documented bounds, so that what is sent to the
executors has a proven size.

A word is a run of letters and of the marks that belong to them, in lower case. N-grams are told apart by 64-bit
hashes, so that all of a batch are made and looked up at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import give_back, slices, written

UNDETERMINED = "und"
_BETWEEN, _LETTER = r"[^\p{L}\p{M}]+", r"\p{L}"
#: Characters whose n-grams are made at once.
STEP = 1 << 20
_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of every word in order as indexes, and the different words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _BETWEEN)
    offsets = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    codes, each = words.indices.to_numpy(), words.dictionary
    # What is between has no letter; runs of marks alone aren't words either.
    good = pc.match_substring_regex(each, _LETTER).to_numpy(zero_copy_only=False)[codes]
    return np.repeat(np.arange(len(texts)), np.diff(offsets))[good], codes[good], each


def gram_hash(gram: str) -> int:
    """What an n-gram is known by."""
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * _MIX & _MASK
        h ^= h >> 29
    return h


def grams(words: list[str], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word, hash) of the n-grams of up to ``most`` characters of words, part by part. Those of two characters or
    more see a space before and after the word."""
    if not words:
        return
    chars, before = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32), 0
    for start in range(0, len(chars) - 1, STEP):
        part = chars[start : start + STEP + most - 1]
        n = min(STEP, len(part))
        space = part == 32
        word = before + np.cumsum(space[:n]) - 1
        # How far the next space is, behind which another word begins.
        gaps, place = np.flatnonzero(space), np.arange(n)
        after = np.r_[gaps, len(part) + most][np.searchsorted(gaps, place, "right")] - place
        h = np.zeros(n, np.uint64)
        for size in range(1, most + 1):
            m = min(n, len(part) - size + 1)
            if m <= 0:
                break
            h = (h[:m] ^ part[size - 1 : size - 1 + m]) * np.uint64(_MIX)
            h ^= h >> np.uint64(29)
            at = np.flatnonzero(~space[:m] if size == 1 else after[:m] >= size - 1)
            yield size, word[at], h[at]
        before += int(space[:n].sum())


@dataclass
class LanguageModel:
    """Log frequencies by language: of ``words`` in ``word_table``, of n-grams (by size and hash) in ``gram_table``."""

    languages: list[str]
    words: pa.Array
    word_table: np.ndarray
    #: For each size the sorted hashes and their rows.
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    gram_table: np.ndarray
    max_gram: int
    #: What a language scores for a word of which nothing is known.
    floor: float

    def back_off(self, words: list[str]) -> np.ndarray:
        """Scores of words that aren't in the model: for each the mean of its longest n-grams that are."""
        out = np.full((len(words), len(self.languages)), self.floor)
        if not words:
            return out
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, word, hashes in grams(words, self.max_gram):
            keys, rows = self.grams.get(size, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            known = keys[at] == hashes
            word, row = word[known], rows[at[known]]
            count, total = sums.setdefault(size, (np.zeros(len(words)), np.zeros_like(out)))
            count += np.bincount(word, minlength=len(words))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(word, self.gram_table[row, k], len(words))
        for size, (count, total) in sorted(sums.items()):
            found = count > 0
            out[found] = total[found] / count[found, None]
        return out

    def word_scores(self, words: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(words.cast(self.words.type), self.words), -1).to_numpy(zero_copy_only=False)
        out = np.empty((len(words), len(self.languages)))
        out[at >= 0] = self.word_table[at[at >= 0]]
        unknown = np.flatnonzero(at < 0)
        out[unknown] = self.back_off(words.take(pa.array(unknown)).to_pylist())
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1) of each text; ``und`` and 0 for a text without letters or a model without languages."""
        text, word, each = tokenized(texts)
        n = np.bincount(text, minlength=len(texts))
        if not len(word) or not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        used, word = np.unique(word, return_inverse=True)
        scores = self.word_scores(each.take(pa.array(used)))
        mean = np.stack([np.bincount(text, scores[word, k], len(texts)) for k in range(len(self.languages))], axis=1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1)[:, None]) * np.minimum(n, 10)[:, None])
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, 1 / odds.sum(axis=1), 0.0)


def _by_language(lang: np.ndarray, key: np.ndarray, kinds: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, key, sum of n) of pairs of small numbers."""
    pairs, at = np.unique(lang * kinds + key, return_inverse=True)
    return pairs // kinds, pairs % kinds, np.bincount(at, n, len(pairs)).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, key, n) of the words of (text, lang): each task sums its own before Spark sums all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, word, each = tokenized(batch.column(0))
            langs = batch.column(1).dictionary_encode()
            lang, word, n = _by_language(langs.indices.to_numpy().astype(np.int64)[text], word, len(each))
            yield pa.RecordBatch.from_pydict({"lang": langs.dictionary.take(pa.array(lang)), "key": each.take(pa.array(word)), "n": pa.array(n)})

    return rows.mapInArrow(run, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, most: int) -> DataFrame:
    """(lang, size, key, n) of the n-grams of counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "key"):
            langs, n = batch.column(0).dictionary_encode(), batch.column(2).to_numpy()
            lang = langs.indices.to_numpy().astype(np.int64)
            for size, word, hashes in grams(batch.column(1).to_pylist(), most):
                each, at = np.unique(hashes, return_inverse=True)
                owner, key, total = _by_language(lang[word], at, max(1, len(each)), n[word])
                yield pa.RecordBatch.from_pydict({"lang": langs.dictionary.take(pa.array(owner)), "size": pa.array(np.full(len(owner), size, np.int32)), "key": pa.array(each[key].view(np.int64)), "n": pa.array(total)})
        give_back()

    # Dealt out anew: a few large files of words would be a few long tasks.
    spread = words.select("lang", "key", "n").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "key")
    return spread.mapInArrow(run, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


#: Frequencies are binned by so many steps an octave, boundary bins by so many parts of a hash.
_BINS, _PARTS = 16, 1 << 20


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Of each language the keys of about ``most`` rows of the highest n, with their counts in all languages.

    A histogram of a few hundred bins a language tells where to cut; of the bin that doesn't fit whole, a part is
    taken by a hash of the key."""
    keys = [c for c in counts.columns if c not in ("lang", "n")]
    bin_, part = F.floor(F.log2("n") * _BINS).cast("long"), F.pmod(F.xxhash64(*keys), F.lit(_PARTS))
    room, cut = {}, {}
    for r in sorted(counts.groupBy("lang", bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        left = room.setdefault(r["lang"], most)
        if left > 0:
            cut[r["lang"]] = (r["bin"], _PARTS if r["count"] <= left else left * _PARTS // r["count"])
            room[r["lang"]] = left - r["count"]
    edges = counts.sparkSession.createDataFrame([(lang, b, p) for lang, (b, p) in cut.items()], "lang string, cut long, part long")
    kept = counts.join(F.broadcast(edges), "lang").where((bin_ > F.col("cut")) | (bin_ == F.col("cut")) & (part < F.col("part")))  # a row a language
    return counts.join(written(kept.select(*keys).distinct(), "language-kept"), keys)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = 120_000, max_grams: int = 120_000, max_gram: int = 5, max_languages: int = 200) -> LanguageModel:
    """Learn from all rows whose language is not null.

    The model keeps about ``max_words`` words and ``max_grams`` n-grams, the same number of each language's most
    frequent, with their counts in every language: those bound the driver's and each worker's memory. More than
    ``max_languages`` languages are refused. An empty training table gives a model that answers ``und``.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    words = written(word_counts(rows), "language-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    n_grams = written(gram_counts(words, max_gram), "language-grams")
    column = {lang: k for k, lang in enumerate(languages)}
    share = max(1, len(languages))

    def table(counts: DataFrame, most: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """(rows kept, index of their keys, counts of keys by language)."""
        got = most_frequent(counts, -(-most // share)).toArrow().sort_by([(c, "ascending") for c in counts.columns])
        keys = got.select([c for c in counts.columns if c not in ("lang", "n")])
        new = np.ones(len(got), bool)
        if len(got):
            new[1:] = np.logical_or.reduce([np.asarray(c[1:]) != np.asarray(c[:-1]) for c in (x.to_numpy() for x in keys.columns)])
        index = np.cumsum(new) - 1
        n = np.zeros((int(new.sum()), len(languages)))
        n[index, [column[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
        return keys.filter(pa.array(new)), n

    def logs(n: np.ndarray, totals: np.ndarray, kinds: int) -> np.ndarray:
        # Half an occurrence stands for what a language was not seen to have.
        return np.log((n + 0.5) / (totals + 0.5 * max(1, kinds))).astype(np.float32)

    sums = {(r["lang"], 0): r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    sums |= {(r["lang"], r["size"]): r["n"] for r in n_grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([[sums.get((lang, size), 0) for lang in languages] for size in range(max_gram + 1)], float)
    keys, n = table(words.select("key", "lang", "n"), max_words)
    word_table = logs(n, totals[0], len(n))
    gram_keys, gram_n = table(n_grams.select("size", "key", "lang", "n"), max_grams)
    sizes, hashes = gram_keys.column("size").to_numpy(), gram_keys.column("key").to_numpy().view(np.uint64)
    gram_table, index = np.zeros(gram_n.shape, np.float32), {}
    for size in range(1, max_gram + 1):
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(hashes[at])]
        gram_table[at] = logs(gram_n[at], totals[size], len(at))
        index[size] = (hashes[at], at)
    floor = min((float(t.min()) for t in (word_table, gram_table) if t.size), default=0.0)
    found = LanguageModel(languages, pa.array(keys.column("key").to_pylist(), pa.string()), word_table, index, gram_table, max_gram, floor)
    del keys, n, gram_keys, gram_n
    give_back()  # the driver lives on for other operators
    return found


def predicted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """All columns of ``docs`` with the language of each whole text and a score from 0 to 1.

    Null texts and texts without a letter give ``und`` and 0. Ties go to the language that sorts first.
    Columns of those names are replaced.
    """
    docs = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words, max_grams and max_languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            langs, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.append_column(pred_col, pa.array(langs, pa.string())).append_column(score_col, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def accepted(docs: DataFrame, model: LanguageModel, *, min_score: float = 0.4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is told, with their own columns; a null ``lang`` is filled in with the prediction.

    Rows whose text is null or has no letter go, and those whose language scores under ``min_score``.
    """
    marked = predicted(docs, model, text_col=text_col, pred_col="__pred", score_col="__score")
    kept = marked.where((F.col("__pred") != UNDETERMINED) & (F.col("__score") >= min_score))
    return kept.select(*[F.coalesce(lang_col, "__pred").alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
