"""Quality classifier: supervised subword embeddings.

A document is the average of its tokens' vectors. A token is a word, and its vector the average over hashed features:
the word, its character n-grams and, where a three-word window has come before in the text, a feature that says so.
A softmax layer reads the average. Vectors and layer are trained together by stochastic gradient descent in numpy, on
a bounded sample of the labelled rows. Since the layer is linear, a trained model is one number per feature; scoring
hashes each distinct word of a batch once and averages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash as H

#: Hashed features, width of vectors, character n-grams, and SGD's epochs, batch and rate.
FEATURES, WIDTH, GRAMS, EPOCHS, BATCH, RATE = 1 << 17, 8, (2, 3, 4), 12, 32, 2.0
#: Labelled rows that training reads at most, those with the smallest hash of their id; and their characters at most
#: (whole texts, as many as fit).
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 16_000_000
#: Rows whose crc32(doc_id as text) is 0 modulo this are held out.
FOLDS = 5
THRESHOLD = 0.3
#: Distinct words whose scores a task remembers.
REMEMBERED = 300_000
#: Words' scores are whole multiples of 1 / POINT, so that their sums don't depend on the order or the neighbours.
POINT = 1 << 28
_REPEAT = 0  # the feature of repeated windows
_EMPTY = 1  # the feature of a text without words


def _hashed(flat: list[bytes]) -> np.ndarray:
    tokens = np.empty(len(flat), dtype=object)
    tokens[:] = flat
    return (pd.util.hash_array(tokens, categorize=False) % np.uint64(FEATURES - 2)).astype(np.int32) + 2


def word_features(words: list[bytes], at_once: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Features of each word and the offsets of each word's: itself and the n-grams of <word>, of words of any length.
    N-grams are hashed in parts, also inside a word: as objects they take twenty times the room of their features."""
    ends = np.zeros(len(words) + 1, dtype=np.int64)
    parts, flat = [np.zeros(0, dtype=np.int32)], []
    done = 0
    for i, w in enumerate(words):
        flat.append(b"w" + w)
        s = "<" + w.decode("utf-8", "surrogateescape") + ">"
        for n in GRAMS:
            for begin in range(0, len(s) - n + 1, at_once):
                flat += [s[k : k + n].encode("utf-8", "surrogateescape") for k in range(begin, min(begin + at_once, len(s) - n + 1))]
                if len(flat) >= at_once:
                    parts.append(_hashed(flat))
                    done, flat = done + len(flat), []
        ends[i + 1] = done + len(flat)
    if flat:
        parts.append(_hashed(flat))
    return np.concatenate(parts), ends


def _repeats(codes: np.ndarray) -> int:
    """How many three-word windows have come before in the text."""
    if len(codes) < 4:
        return 0
    windows = codes[:-2] * H._ODD[0] + codes[1:-1] * H._ODD[1] + codes[2:] * H._ODD[2]
    return len(windows) - len(np.unique(windows))


def bags(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts; for each text the words' numbers and counts (flat, with offsets), the words in all
    and the repeated windows."""
    vocabulary: dict[bytes, int] = {}
    ids, counts, ends, totals, again = [], [], [0], [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split() if t else []
        own = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), dtype=np.int64, count=len(words))
        again.append(_repeats(H.mixed(own.astype(np.uint64))))
        distinct, n = np.unique(own, return_counts=True)
        ids.append(distinct)
        counts.append(n)
        ends.append(ends[-1] + len(distinct))
        totals.append(len(words))
    return list(vocabulary), np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64), np.array(ends), np.array(totals), np.array(again)


class Model:
    """One number per feature, and the bias: the log odds of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, texts: list, known: dict[bytes, float] | None = None) -> np.ndarray:
        """known: scores of words met before, which this adds to."""
        known = {} if known is None else known
        words, ids, counts, ends, totals, again = bags(texts)
        new = [w for w in words if w not in known]
        if new:
            features, at = word_features(new)
            means = np.add.reduceat(self.weights[features].astype(np.float64), at[:-1]) / np.diff(at)
            known.update(zip(new, np.rint(means * POINT).astype(np.int64).tolist(), strict=True))
        own = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))
        if len(known) > REMEMBERED:
            known.clear()
        run = np.concatenate([[0], np.cumsum(own[ids] * counts)])
        n = totals + again
        logit = ((run[ends[1:]] - run[ends[:-1]]) / POINT + again * float(self.weights[_REPEAT])) / np.maximum(1, n)
        logit = np.where(n == 0, self.weights[_EMPTY], logit) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list, labels: np.ndarray, seed: int = 1) -> Model:
    """Minibatch SGD on the softmax loss; the rate falls linearly to nothing. A class alone gives its share as score."""
    labels = np.asarray(labels, dtype=np.int64)
    if len(labels) == 0:
        return Model(np.zeros(FEATURES), 0.0)
    rng = np.random.default_rng(seed)
    words, ids, counts, ends, totals, again = bags(texts)
    features, at = word_features(words)
    per_word = np.diff(at)
    vectors = ((rng.random((FEATURES, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer = np.zeros((WIDTH, 2), dtype=np.float32)
    bias = np.log(np.bincount(labels, minlength=2) + 1.0).astype(np.float32)
    bias -= bias.mean()
    share = counts / np.repeat(np.maximum(1, totals + again), np.diff(ends))
    order, step, steps = np.arange(len(labels)), 0, EPOCHS * -(-len(labels) // BATCH)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            sizes = ends[rows + 1] - ends[rows]
            pick = np.repeat(ends[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            w, weight, doc = ids[pick], share[pick], np.repeat(np.arange(len(rows)), sizes)
            n = per_word[w]
            f = features[np.repeat(at[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            value = np.repeat(weight / n, n)
            where = np.repeat(doc, n)
            extra = again[rows] / np.maximum(1, totals[rows] + again[rows])
            empty = (totals[rows] == 0).astype(float)
            f = np.concatenate([f, np.full(len(rows), _REPEAT), np.full(len(rows), _EMPTY)])
            value = np.concatenate([value, extra, empty]).astype(np.float32)
            where = np.concatenate([where, np.arange(len(rows)), np.arange(len(rows))])
            # features of the batch, once each: a sparse (rows, features) product in both directions
            distinct, inverse = np.unique(f, return_inverse=True)
            mat = np.zeros((len(rows), len(distinct)), dtype=np.float32)
            np.add.at(mat.reshape(-1), where * len(distinct) + inverse, value)
            hidden = mat @ vectors[distinct]
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - step / steps)
            step += 1
            grad_hidden = p @ layer.T
            layer -= rate / len(rows) * (hidden.T @ p)
            bias -= 0.1 * rate / len(rows) * p.sum(axis=0)
            # a feature's share of an average is small, so its vector moves by the gradient over the batch's mean share
            vectors[distinct] -= rate * 50 / len(rows) * (mat.T @ grad_hidden)
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list, np.ndarray]:
    """Whole texts and labels of the training rows: those not held out, in order of a hash of the id, at most `rows` and
    no more than come before the first text that takes them over `chars` characters. Of several labels of a document
    the smallest stands."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    open_ = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = open_.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)  # at most `rows` small rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.join(F.broadcast(chosen), "doc_id").orderBy("h", "doc_id", "text").select("text", "label")
    texts, marks, size = [], [], 0
    for r in got.toLocalIterator():
        size += len(r["text"] or "")
        if size > chars and texts:
            break
        texts.append(r["text"])
        marks.append(r["label"])
    return texts, np.array(marks, dtype=np.int64)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in H.blocks(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(model.scores(texts[a:b], known), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    The model is fitted on a bounded sample of the labelled rows (see sample: SAMPLE_ROWS rows and SAMPLE_CHARS
    characters); every text is scored whole, words of any length included. Null and empty texts are scored by a feature
    of their own; a null doc_id counts as held out; equal texts get equal scores, whatever stands beside them; an empty
    table gives an empty result; without labels all scores are one half. Only text is scored.
    """
    model = train(*sample(docs, labels, label))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(shared), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
