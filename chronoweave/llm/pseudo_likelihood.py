"""Language-model scoring by masked pseudo-likelihood.

A window network predicts every token from the tokens on both sides, the token itself masked: vectors of the
neighbours, one table per position, are summed, squashed, and read by a two-level softmax (a class of words, then the
word in its class). The sum of the tokens' conditional log-probabilities scores a document.

Everything the model knows is gathered from all documents. Words are counted over the corpus; the most frequent make
the vocabulary, the others share buckets, and a bucket's mass is spread over its words by their counts in the corpus:
a bounded number of the most frequent are known to every task, all others are joined to the texts' words. Every position of every text is a training example, in one of the rounds. Texts
are read into tokens once, as a table that training and scoring share. Pieces of them are dealt evenly to replicas,
more of them for more tokens, by a hash of the document, and a replica takes its pieces in the order of that hash: the
model depends on the rows alone, not on how they are partitioned. Each replica is trained by numpy SGD (Adagrad) on the
examples of its pieces as they stream by, then the replicas' parameters are averaged row by row in Spark, in whole
multiples of a small unit, and the next round starts from the average.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_hash as H
from .shared import Scratch

#: Classes and words per class (the last class holds the buckets of rarer words), neighbours on either side, width.
CLASSES, PER_CLASS, SIDE, WIDTH = 64, 64, 2, 24
VOCABULARY, TOKENS = (CLASSES - 1) * PER_CLASS, CLASSES * PER_CLASS
#: Positions per replica, about; rounds; rate of Adagrad; positions of a piece (a multiple of the rounds), and examples
#: that are mixed before they are used.
PER_REPLICA, ROUNDS, RATE, PIECE, MIXED = 12_000_000, 2, 0.15, 2048, 1 << 16
#: A batch grows with the examples seen (a GROWTH-th of them) between these bounds.
LEAST_BATCH, MOST_BATCH, GROWTH = 512, 8192, 64
#: Parameters are averaged as whole multiples of 1 / POINT: sums don't depend on their order.
POINT = 1 << 30
OFFSETS = tuple(k for k in range(-SIDE, SIDE + 1) if k)


#: Further words, the most frequent outside the vocabulary, whose counts go to every task; those of others are joined.
COUNTED = 1 << 16


class Places:
    """Where hashes are in a list of distinct hashes, found by their first bits."""

    def __init__(self, hashes: np.ndarray, bits: int = 16):
        self.sorted, self.place, self.shift = np.sort(hashes), np.argsort(hashes).astype(np.int32), np.uint64(64 - bits)
        # where the hashes begin that have the same first bits, and how many they are at most
        self.begins = np.searchsorted(self.sorted, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(np.append(self.begins, len(hashes))).max())

    def find(self, hashes: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Their places in the list; for those that aren't there, what `other` says."""
        if not len(self.sorted):
            return other
        begins = self.begins[(hashes >> self.shift).astype(np.int32)]
        for k in range(self.most):
            at = np.minimum(begins + k, len(self.sorted) - 1)
            other = np.where(self.sorted[at] == hashes, self.place[at], other)
        return other


class Words:
    """Tokens of words: the vocabulary's by hash, others by bucket; what a word of a bucket costs, its own count left out;
    and of further words the logarithms of their counts."""

    def __init__(self, hashes: np.ndarray, bucket_counts: np.ndarray, further: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.places = Places(hashes)
        self.further = Places(np.zeros(0, dtype=np.uint64) if further is None else further, 18)
        self.gains = np.append(np.zeros(0) if counts is None else np.log(counts), 0.0)  # the last: of words not there
        self.cost = np.zeros(TOKENS)
        self.cost[VOCABULARY:] = np.log(np.maximum(1, bucket_counts))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        return self.places.find(hashes, VOCABULARY + (hashes % np.uint64(PER_CLASS)).astype(np.int32))


#: Parts of a score are whole multiples of 1 / GRID; positions scored at once, and of these by one product.
GRID, BLOCK, SCORED = float(1 << 20), 1 << 16, 2048


class Net:
    """tables: (neighbours, TOKENS + 1, WIDTH), the last row for beyond the text; classes and words read the hidden
    layer, with a bias as their last column."""

    def __init__(self, rows: np.ndarray | None = None, seed: int = 3):
        n = len(OFFSETS) * (TOKENS + 1)
        if rows is None:
            rng = np.random.default_rng(seed)
            rows = np.zeros((n + CLASSES + TOKENS, WIDTH + 1), dtype=np.float32)
            rows[:n, :WIDTH] = (rng.random((n, WIDTH)) - 0.5) * 0.2
            rows[n:, :WIDTH] = (rng.random((CLASSES + TOKENS, WIDTH)) - 0.5) * 0.1
        self.rows = rows
        self.tables = rows[:n].reshape(len(OFFSETS), TOKENS + 1, WIDTH + 1)
        self.classes, self.words = rows[n : n + CLASSES], rows[n + CLASSES :].reshape(CLASSES, PER_CLASS, WIDTH + 1)
        self.held: dict[str, np.ndarray] = {}

    def room(self, what: str, n: int, m: int) -> np.ndarray:
        """Memory for n by m numbers, the same at each call: to get new memory costs as much as what is done in it."""
        if what not in self.held or self.held[what].size < n * m:
            self.held[what] = np.empty(n * m, dtype=self.rows.dtype)
        return self.held[what][: n * m].reshape(n, m)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """The hidden layer, until the next call."""
        total, more = (self.room(what, context.shape[1], WIDTH + 1) for what in ("hidden", "neighbour"))
        self.tables[0].take(context[0], axis=0, mode="clip", out=total)
        for k in range(1, len(OFFSETS)):
            self.tables[k].take(context[k], axis=0, mode="clip", out=more)
            total += more
        np.tanh(total, out=total)
        total[:, WIDTH] = 1  # reads the biases
        return total

    def log_likelihood(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, edges = _by_class(target)
        target = target[order]
        hidden = self.hidden(context[:, order])
        told, which = np.empty(len(target)), target // PER_CLASS
        small = self.bounded()
        for k in range(0, len(target), SCORED):
            part = slice(k, k + SCORED)
            told[part] = _picked(self.classes @ hidden[part].T, which[part], small)
        for c in np.flatnonzero(np.diff(edges)):
            rows = slice(edges[c], edges[c + 1])
            told[rows] += _picked(self.words[c] @ hidden[rows].T, target[rows] % PER_CLASS, small)
        out = np.empty(len(target))
        out[order] = told
        return out

    def bounded(self) -> bool:
        """Whether no logit can be so large that its exponential would need the largest taken off: hidden values are
        within 1, so a logit is within the sum of its weights."""
        return float((np.abs(self.rows[len(OFFSETS) * (TOKENS + 1) :]) @ np.ones(WIDTH + 1, dtype=self.rows.dtype)).max()) < 80

    def step(self, context: np.ndarray, target: np.ndarray, power: np.ndarray) -> None:
        """One Adagrad step; power: sums of squared gradients by row."""
        n, small = len(target), self.bounded()
        order, edges = _by_class(target)
        context, target = context[:, order], target[order]
        present = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges))]
        hidden, error = self.hidden(context), self.room("error", CLASSES, n)
        back, more = (self.room(what, n, WIDTH) for what in ("back", "neighbour"))  # the biases are no neighbour's
        base = len(OFFSETS) * (TOKENS + 1)
        told = np.zeros((CLASSES + TOKENS, WIDTH + 1), dtype=self.rows.dtype)  # gradients of what reads the hidden layer
        np.matmul(self.classes, hidden.T, out=error)
        _error(error, target // PER_CLASS, small)
        np.matmul(error.T, self.classes[:, :WIDTH], out=back)
        np.matmul(error, hidden, out=told[:CLASSES])
        error, words = self.room("error", PER_CLASS, n), told[CLASSES:].reshape(self.words.shape)
        for c, rows in present:
            np.matmul(self.words[c], hidden[rows].T, out=error[:, rows])
        _error(error, target % PER_CLASS, small)
        for c, rows in present:
            np.matmul(error[:, rows].T, self.words[c, :, :WIDTH], out=more[rows])
            np.matmul(error[:, rows], hidden[rows], out=words[c])
        back += more
        np.multiply(hidden[:, :WIDTH], hidden[:, :WIDTH], out=more)
        np.subtract(1, more, out=more)
        back *= more
        grads = []
        for k in range(len(OFFSETS)):
            order = np.argsort(context[k].astype(np.int16), kind="stable")  # 16 bits are sorted by radix
            ids = context[k].take(order)
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            back.take(order, axis=0, mode="clip", out=more)
            # two columns are summed at once, as the parts of complex numbers
            grads.append((k * (TOKENS + 1) + ids[first], np.add.reduceat(more.view(np.complex64), first).view(np.float32)))
        self._moved(slice(base, None), told, n, power)
        for rows, g in grads:
            self._moved(rows, g, n, power)

    def _moved(self, rows, g: np.ndarray, n: int, power: np.ndarray) -> None:
        g /= n
        now = power[rows] + np.einsum("ij,ij->i", g, g) * (1e4 / (WIDTH + 1))
        power[rows] = now
        g *= (RATE * 100 / np.sqrt(now + 1)).astype(np.float32)[:, None]
        own = self.rows[rows]
        own[:, : g.shape[1]] -= g
        self.rows[rows] = own


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts targets by class, and where each class begins in it."""
    order = np.argsort((target // PER_CLASS).astype(np.int16), kind="stable")
    return order, np.searchsorted(target[order] // PER_CLASS, np.arange(CLASSES + 1))


def _picked(logits: np.ndarray, which: np.ndarray, small: bool = False) -> np.ndarray:
    """Logarithms of the softmax over the first axis, which is the fast one to reduce, at one row for each column. small:
    no logit is so large that its exponential would need the largest taken off."""
    own = logits[which, np.arange(len(which))]
    if not small:
        top = logits.max(axis=0)
        logits -= top
        own -= top
    np.exp(logits, out=logits)
    return (own - np.log(logits.sum(axis=0))).astype(np.float64)


def _error(logits: np.ndarray, which: np.ndarray, small: bool = False) -> np.ndarray:
    """Softmax over the first axis less the one at `which`, in place. small: as for _picked."""
    if not small:
        logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits *= 1 / logits.sum(axis=0)
    logits[which, np.arange(len(which))] -= 1
    return logits


def _neighbours(tokens: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens around the positions `at`, TOKENS beyond the text's ends."""
    owner = np.searchsorted(ends, at, side="right") - 1
    low, high = ends[owner], ends[owner + 1]
    out = np.empty((len(OFFSETS), len(at)), dtype=np.int32)
    for k, o in enumerate(OFFSETS):
        there = at + o
        inside = (there >= low) & (there < high)
        out[k] = np.where(inside, tokens[np.where(inside, there, at)], TOKENS)
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words in order, each once, and their counts of all parts."""
    words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(words)
    words, n = words[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, dtype=int)
    return words[first], np.add.reduceat(n, first) if len(first) else n


#: Distinct words that a task counts before it tells them, and words of blocks that wait to be summed.
_DISTINCT, _WAITING = 200_000, 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes, summed over a task's batches as long as they fit."""

    def told(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n)], ["word", "n"])

    parts, held = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))], 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in H.blocks(texts):
            parts.append(np.unique(H.word_hashes(texts[a:b])[0], return_counts=True))
            held += len(parts[-1][0])
            if held > _WAITING:
                parts = [_summed(parts)]
                held = 0
                if len(parts[0][0]) > _DISTINCT:
                    yield told(*parts[0])
                    parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    yield told(*_summed(parts))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words more frequent than all others, the vocabulary's and COUNTED more at most, and their counts. The
    driver gets the numbers of words of each count, then no more than these words."""
    sizes = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for n, words in sizes:
        held += words
        if held > VOCABULARY + COUNTED:
            break
        least = n
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    return np.array([r["word"] for r in rows], dtype=np.int64).astype(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)


def vocabulary(docs: DataFrame, scratch: Scratch) -> tuple[Words, DataFrame]:
    """Counts of all words of all documents, as a table; the driver gets the most frequent and a number per bucket."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.table(counts, "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    hashes = np.array([r["word"] for r in top], dtype=np.int64).astype(np.uint64)
    buckets = counts.groupBy(F.col("word").bitwiseAND(F.lit(PER_CLASS - 1)).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    left = np.zeros(PER_CLASS, dtype=np.int64)
    for r in buckets:
        left[r["bucket"]] = r["n"]
    np.subtract.at(left, (hashes % np.uint64(PER_CLASS)).astype(int), np.array([r["n"] for r in top], dtype=np.int64))
    return Words(hashes, left, *_frequent(counts)), counts


TEXTS = "doc_id long, text_key long, tokens binary, rare binary, gain double, counted long"


def _tokenised(words):
    """Texts as tokens (16 bits each); of their words outside the vocabulary, what the counts known here give, of how many
    words, and the hashes of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in H.blocks(texts):
                hashes, ends = H.word_hashes(texts[a:b])
                tokens = known.tokens(hashes)
                at = np.flatnonzero(tokens >= VOCABULARY)
                owner = np.searchsorted(ends, at, side="right") - 1
                rare = hashes[at]
                place = known.further.find(rare, np.full(len(rare), -1, dtype=np.int32))
                gain = np.bincount(owner, weights=known.gains[place], minlength=b - a).astype(np.float64)  # of none: whole numbers
                counted = np.bincount(owner[place >= 0], minlength=b - a)
                rare = rare[place < 0]
                others = np.concatenate([[0], np.cumsum(np.bincount(owner[place < 0], minlength=b - a))])
                tokens = tokens.astype(np.int16)
                columns = [
                    pa.array([_text_key(t) for t in texts[a:b]], pa.int64()),
                    pa.array([tokens[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    pa.array([rare[i:j].tobytes() for i, j in zip(others[:-1], others[1:], strict=True)], pa.binary()),
                    pa.array(gain),
                    pa.array(counted.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], ["doc_id", "text_key", "tokens", "rare", "gain", "counted"])

    return run


def _pieces(tokens: np.ndarray) -> list[bytes]:
    """A text's tokens in pieces of PIECE positions and their neighbours on either side, TOKENS beyond the text's ends."""
    if not len(tokens):
        return []
    edge = np.full(SIDE, TOKENS, dtype=np.int16)
    line = np.concatenate([edge, tokens.astype(np.int16), edge])
    return [line[k : k + PIECE + 2 * SIDE].tobytes() for k in range(0, len(tokens), PIECE)]


def _examples(piece: bytes, rnd: int) -> np.ndarray:
    """The examples of a piece in a round, a column each: neighbours, then the token."""
    line = np.frombuffer(piece, dtype=np.int16)
    at = np.arange(SIDE + rnd % ROUNDS, len(line) - SIDE, ROUNDS)
    return np.stack([*(line[at + o] for o in OFFSETS), line[at]])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, parts = [], []
        for doc, key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = _pieces(np.frombuffer(tokens, dtype=np.int16))
            keys += [xxhash.xxh3_64_intdigest(f"{doc} {key} {k}") - (1 << 63) for k in range(len(own))]
            parts += own
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["key", "piece"])


ROW = "row int, " + ", ".join(f"c{k} long" for k in range(WIDTH + 1))


class _Replica:
    """A copy of the net that examples stream by."""

    def __init__(self, start: np.ndarray, rnd: int):
        self.start, self.net, self.rnd = start, Net(start.copy()), rnd
        self.power, self.rng = np.zeros(len(start)), np.random.default_rng(rnd)
        self.waiting, self.held, self.seen = [], 0, 0

    def add(self, piece: bytes) -> None:
        self.waiting.append(_examples(piece, self.rnd))
        self.held += self.waiting[-1].shape[1]
        if self.held >= MIXED:
            self.train(False)

    def train(self, last: bool) -> None:
        if not self.held:
            return
        rows = np.concatenate(self.waiting, axis=1)
        rows = rows[:, self.rng.permutation(rows.shape[1])]
        at = 0
        while at < rows.shape[1]:
            batch = min(MOST_BATCH, max(LEAST_BATCH, self.seen // GROWTH))
            if at + batch > rows.shape[1] and not last:
                break
            part = rows[:, at : at + batch].astype(np.int32)
            self.net.step(part[:-1], part[-1], self.power)
            at, self.seen = at + batch, self.seen + part.shape[1]
        self.waiting, self.held = [rows[:, at:]], max(0, rows.shape[1] - at)

    def told(self) -> pa.RecordBatch:
        """The rows that training has changed."""
        self.train(True)
        changed = np.flatnonzero((self.net.rows != self.start).any(axis=1))
        whole = np.rint(self.net.rows[changed].astype(np.float64) * POINT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(changed.astype(np.int32)), *[pa.array(whole[:, k]) for k in range(WIDTH + 1)]], ["row", *[f"c{k}" for k in range(WIDTH + 1)]])


def _trained(start, rnd: int):
    """A task may hold several replicas, one after the other, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replica = None, None
        for batch in batches:
            for which, piece in zip(batch.column("replica").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if which != now:
                    if replica:
                        yield replica.told()
                    now, replica = which, _Replica(start.value, rnd)
                replica.add(piece)
        if replica:
            yield replica.told()

    return run


def fit(texts: DataFrame, scratch: Scratch) -> Net:
    spark: SparkSession = texts.sparkSession
    n = texts.agg(F.sum(F.length("tokens"))).first()[0] or 0
    net = Net()
    replicas = max(1, math.ceil(n / 2 / PER_REPLICA))
    for r in range(ROUNDS if n else 0):
        start = spark.sparkContext.broadcast(net.rows)  # TOKENS times WIDTH numbers, about
        pieces = texts.select("doc_id", "text_key", "tokens").mapInArrow(_dealt, "key long, piece binary")
        pieces = pieces.withColumn("replica", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(replicas)).cast("int"))
        dealt = pieces.repartition(replicas, "replica").sortWithinPartitions("replica", "key").select("replica", "piece")
        trained = dealt.mapInArrow(_trained(start, r), ROW)
        # rows that a replica left alone aren't sent; an average over those that changed a row learns rare words
        # from the few replicas that met them
        mean = scratch.table(trained.groupBy("row").agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(WIDTH + 1)]), "parameters")
        rows = net.rows.copy()
        for m in mean.collect():  # the model's rows at most
            rows[m["row"]] = np.array(m[2:], dtype=np.float64) / m["n"] / POINT
        net = Net(rows)
    return net


def _text_key(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word whose count isn't known to the tasks is in a text."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        hashes = np.frombuffer(b"".join(raw), dtype=np.int64)
        owner = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(hashes) else np.zeros(0, dtype=int)
        times = np.diff(np.append(first, len(hashes))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[first])), pa.array(hashes[first]), pa.array(times)], ["text_key", "word", "times"])


def _scored(words, rows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, net = words.value.cost, Net(rows.value)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            tokens = np.frombuffer(b"".join(raw), dtype=np.int16).astype(np.int32)
            each = np.zeros(len(tokens))
            for k in range(0, len(tokens), BLOCK):
                at = np.arange(k, min(k + BLOCK, len(tokens)))
                each[at] = np.rint((net.log_likelihood(_neighbours(tokens, ends, at), tokens[at]) - cost[tokens[at]]) * GRID) / GRID
            pll, others = np.zeros(len(raw)), np.zeros(len(raw), dtype=np.int64)
            if some := np.flatnonzero(sizes).tolist():  # a text's sum is its own: no neighbour has a part in it
                pll[some] = np.add.reduceat(each, ends[some])
                others[some] = np.add.reduceat((tokens >= VOCABULARY).astype(np.int64), ends[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(pll), batch.column(1), pa.array(others)], ["doc_id", "n_tokens", "base", "text_key", "others"])

    return run


def score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, pll (sum of log-probabilities) and mean_pll (per token; null without tokens) for every row of
    docs (doc_id, text). Null and empty texts have no tokens and a pll of 0; repeated rows score alike; an empty table
    gives an empty result; other columns aren't read. The same rows give the same scores, up to float32's rounding,
    however they are partitioned. A token's part is rounded to a 2^-20th, so that a sum doesn't depend on its order; texts are
    scored with 32 bits, as the net is trained, and equal texts are given one score."""
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    words, counts = vocabulary(docs, scratch)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(words)  # TOKENS numbers
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = scratch.table(narrow.mapInArrow(_tokenised(known), TEXTS), "texts")
    net = fit(texts, scratch)
    rows = spark.sparkContext.broadcast(net.rows)
    # what the counts of a text's words outside the vocabulary give; repeated texts come in together, and in equal parts
    own = texts.select("text_key", "rare").mapInArrow(_rare, "text_key long, word long, times long").join(counts, "word")
    own = own.select("text_key", (F.col("times") * F.log("n")).alias("gain"), "times")
    own = own.unionByName(texts.select("text_key", "gain", F.col("counted").alias("times")))
    own = own.groupBy("text_key").agg(F.sum("gain").alias("gain"), F.sum("times").alias("all"))
    scored = texts.select("doc_id", "text_key", "tokens").mapInArrow(_scored(known, rows), "doc_id long, n_tokens long, base double, text_key long, others long")
    return _told(scratch.table(scored, "scored"), own)


def _told(scored: DataFrame, own: DataFrame) -> DataFrame:
    """The least score of a text's copies is that of all: their own may differ by float32's rounding, which may follow
    where in a block, or on what kind of processor, each was scored."""
    alike = scored.groupBy("text_key").agg(F.min("base").alias("base"), F.min("others").alias("others")).join(own, "text_key", "left")
    pll = F.col("base") + F.when(F.col("others") > 0, F.col("gain") * (F.col("others") / F.col("all"))).otherwise(0.0)
    told = scored.select("doc_id", "n_tokens", "text_key").join(alike.select("text_key", pll.alias("pll")), "text_key").select("doc_id", "n_tokens", "pll")
    return told.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))
