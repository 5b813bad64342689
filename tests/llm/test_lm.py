"""Gradients and scores of the language model against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from loudframe.llm import lm


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    head = [(w, int(c), i % lm.OPEN) for i, (w, c) in enumerate(zip([lm.END, *(f"w{i}" for i in range(70))], rng.integers(5, 90, 71)))]
    vocabulary = lm.Vocabulary(head, 90_000, {k: (900, 40) for k in range(lm.OPEN)})
    p = {k: v + rng.normal(0, 0.2, v.shape) * (np.abs(v) < 1e3) for k, v in lm._start(3, vocabulary).items()}
    every = np.append(np.arange(vocabulary.n), lm.CLASS_SIZE * lm.CLASSES + np.arange(lm.OPEN))
    return p, every


def told(p, h, y):
    """Natural log-probability of word y after state h, by the definition."""
    own = y < lm.CLASS_SIZE * lm.CLASSES
    k = y // lm.CLASS_SIZE if own else lm.CLASSES + y - lm.CLASS_SIZE * lm.CLASSES
    z = h @ p["wc"] + p["bc"]
    out = z[k] - np.log(np.exp(z).sum())
    if own:
        z = h @ p["ww"][k] + p["bw"][k]
        out += z[y % lm.CLASS_SIZE] - np.log(np.exp(z).sum())
    return out


def step(p, h, read):
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    g, n = p["x"][read] + p["b"], lm.HIDDEN
    z, r = sigmoid(g[:n] + h @ p["u"][:, :n]), sigmoid(g[n:2 * n] + h @ p["u"][:, n:])
    return h + z * (np.tanh(g[2 * n:] + (r * h) @ p["s"]) - h)


def walked(p, starts, reads, x, new):
    """The lanes' negative log-probability, lane by lane and word by word."""
    loss = 0.0
    for lane in range(x.shape[1]):
        h = starts[lane]
        for t in range(len(x)):
            h = step(p, h * 0 if new[t, lane] else h, reads[t, lane])
            loss -= told(p, h, x[t, lane])
    return loss


def test_gradients_through_time(model):
    p, every = model
    rng = np.random.default_rng(6)
    x = rng.choice(every, (7, 3))
    new = rng.random((7, 3)) < 0.2
    reads = np.where(new, 0, np.concatenate([rng.choice(every, (1, 3)), x[:-1]]))
    starts = rng.normal(size=(3, lm.HIDDEN))
    grads, _ = lm._window(p, starts, reads, x, new)
    for name in ("x", "u", "s", "b", "wc", "bc", "ww", "bw"):
        flat = np.argsort(-np.abs(grads[name]).ravel())[:3].tolist() + [int(rng.integers(grads[name].size))]
        for at in flat:
            where = np.unravel_index(at, grads[name].shape)
            if abs(p[name][where]) > 1e3:
                continue
            sides = []
            for e in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][where] += e
                sides.append(walked(moved, starts, reads, x, new))
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(grads[name][where], rel=1e-4, abs=1e-6), name


def test_scores_against_a_plain_walk(model):
    p, every = model
    rng = np.random.default_rng(7)
    sizes = np.array([1, 40, 3, 0, 40])
    numbers = rng.choice(every, sizes.sum())
    numbers[np.cumsum(sizes)[sizes > 0] - 1] = 0
    got = lm._score({k: v.astype(np.float32) for k, v in p.items()}, sizes, numbers)
    at = 0
    for i, n in enumerate(sizes):
        h, read, want = np.zeros(lm.HIDDEN), 0, 0.0
        for y in numbers[at:at + n]:
            h = step(p, h, read)
            want, read = want + told(p, h, y), y
        at += n
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_training_beats_the_shares_it_starts_from():
    """A language in which each word tells the next one is learnt, at any number of lanes."""
    rng = np.random.default_rng(8)
    head = [(lm.END, 50, 0)] + [(f"w{i}", 50, 0) for i in range(1, 40)]
    vocabulary = lm.Vocabulary(head, 5000, {0: (2000, 40)})
    follow = rng.permutation(40)
    docs = []
    for _ in range(400):
        words = [int(rng.integers(1, 40))]
        while len(words) < 60:
            words.append(int(follow[words[-1]]) or 1)
        docs.append(np.array([*words, 0]))
    p = lm._start(0, vocabulary)
    sizes, numbers = np.array([len(d) for d in docs[:20]]), np.concatenate(docs[:20])
    before = lm._score({k: v.astype(np.float32) for k, v in p.items()}, sizes, numbers).sum()
    for _ in range(3):
        p, n = lm._train(p, docs)
    after = lm._score(p, sizes, numbers).sum()
    assert n > 0.9 * sum(map(len, docs)) and after > 0.75 * before


@pytest.mark.parametrize("shift", [0, 500, -500])
def test_softmax_of_rows_far_apart(shift):
    """Rows that would overflow or vanish beside others are as exact as by the definition."""
    z = np.random.default_rng(9).normal(0, 3, (6, 8)).astype(np.float32) + np.float32(shift) * np.arange(6, dtype=np.float32)[:, None]
    own, exact = np.arange(6) % 8, z.astype(np.float64)
    top = exact.max(axis=1, keepdims=True)
    share = np.exp(exact - top) / np.exp(exact - top).sum(axis=1, keepdims=True)
    e, total, told = lm._softmax(z.copy(), own)
    assert e / total[:, None] == pytest.approx(share, rel=1e-3, abs=1e-30)
    assert told == pytest.approx(np.log(share[np.arange(6), own]), rel=1e-4, abs=1e-4)


def test_scoring_holds_few_states_at_a_time(model, monkeypatch):
    """States are told in portions that fit a core's cache, with the same result."""
    p, every = model
    p = {k: v.astype(np.float32) for k, v in p.items()}
    sizes = np.full(50, 60)
    numbers = np.random.default_rng(10).choice(every, sizes.sum())
    want, held, outputs = lm._score(p, sizes, numbers), [], lm._outputs
    monkeypatch.setattr(lm, "STATES", 400)
    monkeypatch.setattr(lm, "_outputs", lambda p, h, y: held.append(len(h)) or outputs(p, h, y))
    assert lm._score(p, sizes, numbers) == pytest.approx(want, rel=1e-5)
    assert max(held) <= 450 and sum(held) == sizes.sum()
