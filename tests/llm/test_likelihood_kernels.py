"""Counts, tokens and likelihoods of the window network against plain loops."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from chronoweave.llm import pseudo_likelihood as P
from chronoweave.llm import text_hash as H


def test_counts_are_summed_as_arrays(monkeypatch):
    monkeypatch.setattr(P, "_DISTINCT", 40)
    monkeypatch.setattr(P, "_WAITING", 60)
    monkeypatch.setattr(H, "BLOCK", 200)
    rng = np.random.default_rng(4)
    texts = [None, "", *(" ".join(f"w{k}" for k in rng.zipf(1.4, rng.integers(0, 30)) % 300) for _ in range(120))]
    told = list(P._counted(pa.record_batch([pa.array(texts[k : k + 50], pa.string())], ["text"]) for k in range(0, len(texts), 50)))
    assert len(told) > 2
    got = Counter()
    for batch in told:
        got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    assert got == Counter(int(h) for h in H.word_hashes(texts)[0].astype(np.int64))
    assert [b.num_rows for b in P._counted(iter([]))] == [0]


def test_tokens_by_the_first_bits():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    hashes[:9] = (np.uint64(0xFFFF) << np.uint64(48)) + np.arange(9, dtype=np.uint64)  # one bin, the last
    hashes[9] = 0
    words = P.Words(hashes, np.ones(P.PER_CLASS, dtype=np.int64))
    asked = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64)])
    at = {int(h): k for k, h in enumerate(hashes)}
    assert words.tokens(asked).tolist() == [at.get(int(h), P.VOCABULARY + int(h) % P.PER_CLASS) for h in asked]


def test_softmax_over_the_fast_axis():
    rng = np.random.default_rng(6)
    for scale, small in ((3, True), (3, False), (400, False)):
        z = rng.normal(size=(P.PER_CLASS, 500)) * scale
        which = rng.integers(0, P.PER_CLASS, 500)
        top = z.max(axis=0)
        want = z - top - np.log(np.exp(z - top).sum(axis=0))
        assert np.allclose(P._picked(z.copy(), which, small), want[which, np.arange(500)], atol=1e-9)
        error = P._error(z.copy(), which)
        assert np.allclose(error, np.exp(want) - (np.arange(P.PER_CLASS)[:, None] == which))
    net = P.Net()
    context, target = rng.integers(0, P.TOKENS + 1, (len(P.OFFSETS), 3 * P.SCORED)).astype(np.int32), rng.integers(0, P.TOKENS, 3 * P.SCORED).astype(np.int32)
    plain = net.log_likelihood(context, target)
    net.rows[-P.TOKENS :, P.WIDTH] += 200  # the same of every word: large weights, equal likelihoods
    assert np.allclose(net.log_likelihood(context, target), plain, atol=1e-3)


def _made(work) -> int:
    """Most bytes that a piece of work holds beyond what was held before, the second time it is done."""
    work()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_steps_use_their_memory_again():
    """No array of a batch's logits is made anew: getting its memory took as long as the step's own work."""
    rng = np.random.default_rng(7)
    net, n = P.Net(), P.MOST_BATCH
    context, target = rng.integers(0, 50, (len(P.OFFSETS), n)).astype(np.int32), rng.integers(0, P.TOKENS, n).astype(np.int32)
    power = np.zeros(len(net.rows))
    assert _made(lambda: net.step(context, target, power)) < 4 * P.PER_CLASS * n


def test_scores_have_the_precision_of_the_net(monkeypatch):
    """Texts are scored by the trained 32 bits, as 64 bits from the same parameters score them."""
    rng = np.random.default_rng(8)
    net = P.Net()
    net.rows[:] = rng.normal(size=net.rows.shape) * 0.4
    words = P.Words(np.zeros(0, dtype=np.uint64), np.full(P.PER_CLASS, 9))
    texts = [rng.integers(0, P.TOKENS, k).astype(np.int16) for k in (0, 1, 700, 3, 5000)]
    batch = pa.record_batch([pa.array(range(5), pa.int64()), pa.array(range(5), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], ["doc_id", "text_key", "tokens"])
    known, seen, plain = type("Known", (), {"value": words}), [], P.Net.log_likelihood
    monkeypatch.setattr(P.Net, "log_likelihood", lambda self, *a: seen.append(self.rows.dtype) or plain(self, *a))
    (got,) = P._scored(known, type("Rows", (), {"value": net.rows}))(iter([batch]))
    assert set(seen) == {np.dtype(np.float32)}
    (want,) = P._scored(known, type("Rows", (), {"value": net.rows.astype(np.float64)}))(iter([batch]))
    assert got.column(1).to_pylist() == want.column(1).to_pylist() == [len(t) for t in texts]
    assert np.allclose(got.column(2), want.column(2), rtol=1e-6, atol=1e-5)


def test_a_step_is_that_of_plain_loops():
    """Adagrad by single examples in 64 bits, with contexts that occur once, often and never, and small and large weights."""
    rng = np.random.default_rng(9)
    for scale in (0.3, 8):
        net, n = P.Net(), 40
        net.rows[:] = rng.normal(size=net.rows.shape) * scale / (1 + 9 * (scale > 1) * (np.arange(len(net.rows)) < len(P.OFFSETS) * (P.TOKENS + 1)))[:, None]
        net.tables[:, :, P.WIDTH] = 0
        assert net.bounded() == (scale < 1)
        context, target = rng.choice([0, 5, 5, 9, P.TOKENS], (len(P.OFFSETS), n)).astype(np.int32), rng.choice([0, 1, 70, P.TOKENS - 1], n).astype(np.int32)
        start = net.rows.astype(np.float64)
        base, grad = len(P.OFFSETS) * (P.TOKENS + 1), np.zeros(start.shape)
        for i in range(n):
            at = [k * (P.TOKENS + 1) + context[k, i] for k in range(len(P.OFFSETS))]
            hidden = np.tanh(start[at].sum(axis=0))
            hidden[P.WIDTH] = 1
            back = np.zeros(P.WIDTH + 1)
            for first, many, own in ((base, P.CLASSES, target[i] // P.PER_CLASS), (base + P.CLASSES + target[i] // P.PER_CLASS * P.PER_CLASS, P.PER_CLASS, target[i] % P.PER_CLASS)):
                z = start[first : first + many] @ hidden
                p = np.exp(z - z.max())
                p /= p.sum()
                p[own] -= 1
                back += p @ start[first : first + many]
                grad[first : first + many] += np.outer(p, hidden) / n
            for row in at:
                grad[row] += back * (1 - hidden**2) / n
        power = (grad**2).sum(axis=1) * 1e4 / (P.WIDTH + 1)
        got = np.zeros(len(start))
        net.step(context, target, got)
        assert np.allclose(got, power, rtol=1e-3, atol=1e-6)
        assert np.allclose(net.rows, start - P.RATE * 100 / np.sqrt(power + 1)[:, None] * grad, atol=2e-3 if scale > 1 else 1e-5)


def test_copies_are_given_one_score(spark):
    """Scores of a text's copies that rounding has set apart come out equal."""
    scored = spark.createDataFrame([(1, 4, -9.5, 77, 1), (2, 4, -9.5000009, 77, 1), (2, 4, -9.5, 77, 1), (None, 0, 0.0, 5, 0), (3, 2, -1.25, 6, 0)], "doc_id long, n_tokens long, base double, text_key long, others long")
    own = spark.createDataFrame([(77, 6.0, 3)], "text_key long, gain double, all long")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["pll"], r["mean_pll"]) for r in P._told(scored, own).collect()), key=str)
    assert got == [(0, 0, 0.0, None), (1, 4, -7.5000009, -7.5000009 / 4), (2, 4, -7.5000009, -7.5000009 / 4), (2, 4, -7.5000009, -7.5000009 / 4), (3, 2, -1.25, -0.625)]


def test_counts_known_to_tasks_and_joined_ones_give_the_same(spark, monkeypatch):
    """What a text's words outside the vocabulary give is theirs by the whole corpus, wherever a count is looked up; the
    frequent ones aren't joined. Words of equal counts stay together."""
    monkeypatch.setattr(P, "VOCABULARY", 0)
    monkeypatch.setattr(P, "TOKENS", P.PER_CLASS)
    counts = Counter({f"w{k}": 1 + 90 // (k + 1) for k in range(60)})
    texts = [None, "", " ".join(counts.elements()), "w0 w0 w59 w3", "w58"]
    flat = Counter(w for t in texts for w in (t or "").split())
    hashed = {w: int(H.word_hashes([w])[0].astype(np.int64)[0]) for w in flat}
    table = spark.createDataFrame([(hashed[w], n) for w, n in flat.items()], "word long, n long")
    for most in (0, 7, 20, 1000):
        monkeypatch.setattr(P, "COUNTED", most)
        further, n = P._frequent(table)
        assert len(further) <= most and (len(further) == len(flat) or max([0, *(c for w, c in flat.items() if hashed[w] not in further.astype(np.int64))]) < min([*n, 1 << 40]))
        words = P.Words(np.zeros(0, dtype=np.uint64), np.ones(P.PER_CLASS, dtype=np.int64), further, n)
        batch = pa.record_batch([pa.array(range(5), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        (got,) = P._tokenised(type("Known", (), {"value": words}))(iter([batch]))
        by_hash = {h: flat[w] for w, h in hashed.items()}
        for t, row in zip(texts, got.to_pylist(), strict=True):
            rest = np.frombuffer(row["rare"], dtype=np.int64).tolist()
            assert row["counted"] + len(rest) == len((t or "").split()) and not set(rest) & set(further.astype(np.int64).tolist())
            assert np.isclose(row["gain"] + sum(np.log(by_hash[h]) for h in rest), sum(np.log(flat[w]) for w in (t or "").split()))
        (none,) = P._tokenised(type("Known", (), {"value": words}))(iter([batch.slice(0, 2)]))
        assert none.schema == got.schema and none.column("gain").to_pylist() == [0.0, 0.0]
