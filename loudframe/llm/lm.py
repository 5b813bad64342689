"""Language-model scores: a gated recurrent network with class-factored softmax beside smoothed counts.

Counts run over all training documents. Frequent words are outputs of the network, grouped in
classes; every other word belongs to one of a fixed number of open classes by its first letters and
its end. The network gives the probability of a class after all words so far, a second softmax that
of a frequent word within its class; within an open class words have their smoothed share of its
counts, with one place for a word that was never seen. So the probabilities of all words add up.

The network is trained in rounds: each task follows the texts of its part of a round's documents
with truncated backpropagation, states carried from window to window, and the tasks' weights are
averaged. Scoring carries the state through each whole document.

Most words' counts are looked up in a bounded table of frequent ones; the rest meet their counts
in a join, after they were counted within each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import one_thread, split_words, stored, text_parts

HIDDEN, CLASS_SIZE, CLASSES, OPEN = 16, 32, 32, 32
#: Words whose counts travel to the workers.
FREQUENT = 131_072
ROUNDS, WINDOW, RATE = 6, 16, 0.01
#: Texts that a fitting task follows side by side: as many as get LANE_WORDS each, within these bounds.
LEAST_LANES, MOST_LANES, LANE_WORDS = 32, 512, 2_000
#: Text handled at a time in a worker.
PART_BYTES = 6 << 20
#: States that a scoring worker holds before it tells their words.
STATES = 30_000
#: Fitting tasks get about this many words a round.
TASK_WORDS = 1_000_000
END = ""
LOG10 = float(np.log(10))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sizes of the texts with their end token, the tokens' numbers, and the distinct tokens; number 0 is the end."""
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    ends = np.cumsum(sizes + 1) - 1
    codes = np.zeros(sizes.sum() + len(texts), np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = coded.indices.to_numpy() + 1
    return sizes + 1, codes, pa.concat_arrays([pa.array([END], pa.large_string()), coded.dictionary])


def open_class(words: pa.Array) -> np.ndarray:
    """0..OPEN-1 by the first two characters and by whether the last one is a letter."""
    first = pc.utf8_slice_codeunits(words, 0, 2).dictionary_encode()
    last = pc.utf8_slice_codeunits(words, -1, 1 << 30).dictionary_encode()
    a = np.array([zlib.crc32(x.encode()) % (OPEN // 2) for x in first.dictionary.to_pylist()] + [0])
    b = np.array([int(not x.isalpha()) for x in last.dictionary.to_pylist()] + [0])
    return (a[first.indices.to_numpy()] + OPEN // 2 * b[last.indices.to_numpy()]) if len(words) else np.empty(0, int)


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c, open): how often each token occurs in all documents, and its open class. The end of a text is the empty token."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 0, PART_BYTES):
                _, codes, words = _words(part.column(0))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], names=["token", "c"])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(open_class(batch.column(0)).astype(np.int32))], names=["token", "c", "open"])

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c > 0")
    return stored(counted.mapInArrow(classed, "token string, c long, open int"), "counts")


class Vocabulary:
    """Numbers of the network's words: outputs 0..K-1 in classes by rank, K.. for open classes."""

    def __init__(self, head: list[tuple[str, int, int]], size: int, open_sizes: dict[int, tuple[int, int]]):
        """head: (token, c, open) of frequent tokens; size: training tokens plus types plus one; open_sizes: sum of c and types of each open class, all tokens."""
        head = sorted(head, key=lambda x: (x[0] != END, -x[1], x[0]))
        own = head[:CLASS_SIZE * CLASSES]
        self.n, self.size = len(own), size
        self.tokens = pa.array([h[0] for h in head], pa.large_string())
        self.counts = np.array([h[1] for h in head] + [0], np.float64)
        left = {k: [0, 0] for k in range(OPEN)} | {k: list(v) for k, v in open_sizes.items()}
        for _, c, k in own:
            left[k][0], left[k][1] = left[k][0] - c, left[k][1] - 1
        # Add-one shares: every word that was seen, and one more.
        self.open_total = np.array([left[k][0] + left[k][1] + 1 for k in range(OPEN)], np.float64)
        own_counts = self.counts[:self.n]
        weights = np.append(np.bincount(np.arange(self.n) // CLASS_SIZE, own_counts, CLASSES), self.open_total)
        self.class_share = np.log((weights + 0.1) / (weights + 0.1).sum())
        self.word_share = np.full((CLASSES, CLASS_SIZE), -np.inf)
        flat = self.word_share.ravel()
        flat[:self.n] = np.log(own_counts)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent tokens (-1: none) and number for the network, of distinct tokens."""
        place = pc.fill_null(pc.index_in(words, value_set=self.tokens), -1).to_numpy().astype(np.int64)
        number = np.where((place >= 0) & (place < self.n), place, CLASS_SIZE * CLASSES + open_class(words))
        return place, number


def _start(seed: int, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    rng, v = np.random.default_rng(seed), CLASS_SIZE * CLASSES + OPEN
    word = np.where(np.isfinite(vocabulary.word_share), vocabulary.word_share, -1e4)
    return {"x": rng.normal(0, 0.3, (v, 3 * HIDDEN)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN)), "s": rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)),
            "b": np.concatenate([np.full(HIDDEN, -1.0), np.zeros(2 * HIDDEN)]), "wc": np.zeros((HIDDEN, CLASSES + OPEN)), "bc": vocabulary.class_share.copy(),
            "ww": np.zeros((CLASSES, HIDDEN, CLASS_SIZE)), "bw": word}


def _softmax(z: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of rows z (overwritten), their sums, and the log-probability of each row's column ``own``.

    Rows need their own largest value taken away only where exponentials could overflow or a sum could vanish.
    """
    rows, ones = np.arange(len(z)), np.ones(z.shape[1], z.dtype)
    if z.max(initial=0) > 60:
        z -= z.max(axis=1, keepdims=True)
    told = z[rows, own]
    e = np.exp(z)
    total = e @ ones  # sums of short rows are faster as a product
    if total.min(initial=1) < 1e-25:
        top = z.max(axis=1, keepdims=True)
        e, told = np.exp(z - top), told - top[:, 0]
        total = e @ ones
    return e, total, told - np.log(total)


def _outputs(p: dict, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability (natural) of numbers y after states h: class, then word within it. With grads also the states' gradients."""
    k = np.where(y < CLASS_SIZE * CLASSES, y // CLASS_SIZE, CLASSES + y - CLASS_SIZE * CLASSES)
    # In order of the classes, so that each class is one slice.
    order = np.argsort(k.astype(np.uint8), kind="stable")
    borders = np.searchsorted(k[order], np.arange(CLASSES + 1))
    k, h, word = k[order], h[order], y[order] % CLASS_SIZE
    z = h @ p["wc"]
    z += p["bc"]
    e, total, told = _softmax(z, k)
    back = None
    if grads is not None:
        e *= (1 / total)[:, None]
        e[np.arange(len(y)), k] -= 1
        grads["wc"], grads["bc"], back = h.T @ e, np.ones(len(e), e.dtype) @ e, e @ p["wc"].T
        grads["ww"], grads["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
    for c in range(CLASSES):
        at = slice(borders[c], borders[c + 1])
        if at.start == at.stop:
            continue
        z = h[at] @ p["ww"][c]
        z += p["bw"][c]
        e, total, inner = _softmax(z, word[at])
        told[at] += inner
        if grads is not None:
            e *= (1 / total)[:, None]
            e[np.arange(len(e)), word[at]] -= 1
            grads["ww"][c], grads["bw"][c] = h[at].T @ e, np.ones(len(e), e.dtype) @ e
            back[at] += e @ p["ww"][c].T
    out = np.empty_like(told)
    out[order] = told
    if back is not None:
        given = np.empty_like(back)
        given[order] = back
        back = given
    return out, back


def _window(p: dict, h: np.ndarray, reads: np.ndarray, x: np.ndarray, new: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the lanes' negative log-probability over one window, and the states at its end.

    Rows are steps, columns lanes: ``reads`` are the words read before each step, ``x`` the words to be
    told, ``new`` marks the first word of a document, whose state starts anew. States that come into the window are constants.
    """
    steps, lanes = x.shape
    table = p["x"] + p["b"]
    table[:, :2 * HIDDEN] *= 0.5  # a sigmoid is half a tanh of half
    u, live = p["u"] * h.dtype.type(0.5), (~new).astype(h.dtype)[:, :, None]
    prevs, gates, inner, states = (np.empty((steps, lanes, n * HIDDEN), h.dtype) for n in (1, 2, 1, 1))
    for t in range(steps):
        prev, gate, n = prevs[t], gates[t], inner[t]
        np.multiply(h, live[t], out=prev)
        g = table[reads[t]]
        np.matmul(prev, u, out=gate)
        gate += g[:, :2 * HIDDEN]
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        np.matmul(gate[:, HIDDEN:] * prev, p["s"], out=n)
        n += g[:, 2 * HIDDEN:]
        np.tanh(n, out=n)
        h = states[t]
        np.subtract(n, prev, out=h)
        h *= gate[:, :HIDDEN]
        h += prev
    grads: dict = {}
    _, back = _outputs(p, states.reshape(-1, HIDDEN), x.ravel(), grads)
    back = back.reshape(steps, lanes, HIDDEN)
    z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
    kept = r * prevs
    # What the gradients of a step's outputs are multiplied by, for all steps at once.
    by_n, by_z, by_r, stay = z * (1 - inner * inner), (inner - prevs) * z * (1 - z), kept * (1 - r), 1 - z
    inputs = np.empty((steps, lanes, 3 * HIDDEN), h.dtype)
    dh, ut, st = np.zeros_like(h), np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["s"].T)
    for t in reversed(range(steps)):
        dh += back[t]
        d, dn = inputs[t, :, :2 * HIDDEN], inputs[t, :, 2 * HIDDEN:]
        np.multiply(dh, by_n[t], out=dn)
        drh = dn @ st
        np.multiply(dh, by_z[t], out=d[:, :HIDDEN])
        np.multiply(drh, by_r[t], out=d[:, HIDDEN:])
        dh *= stay[t]
        drh *= r[t]
        dh += drh
        dh += d @ ut
        dh *= live[t]
    # Gradients of a word that was read several times are added up in order of the words.
    words, inputs = reads.ravel(), inputs.reshape(-1, 3 * HIDDEN)
    grads["u"] = prevs.reshape(-1, HIDDEN).T @ inputs[:, :2 * HIDDEN]
    grads["s"] = kept.reshape(-1, HIDDEN).T @ inputs[:, 2 * HIDDEN:]
    order = np.argsort(words.astype(np.int16), kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(words[order]) > 0))
    grads["x"] = np.zeros_like(p["x"])
    grads["x"][words[order[starts]]] = np.add.reduceat(inputs[order], starts)
    grads["b"] = np.ones(len(inputs), inputs.dtype) @ inputs
    return grads, states[-1]


def _train(p: dict, docs: list[np.ndarray]) -> tuple[dict, int]:
    """One pass with truncated backpropagation: lanes read documents one after another, states start anew with each."""
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    flat = np.concatenate(docs)
    fresh = np.zeros(len(flat), bool)
    fresh[np.cumsum([0, *(len(d) for d in docs[:-1])])] = True
    steps = max(1, len(flat) // min(MOST_LANES, max(LEAST_LANES, len(flat) // LANE_WORDS)))
    lanes = max(1, len(flat) // steps)
    x, new = flat[:lanes * steps].reshape(lanes, steps).T, fresh[:lanes * steps].reshape(lanes, steps).T.copy()
    new[0] = True
    # The state before a document's first word has read its end mark.
    reads = np.where(new, 0, np.concatenate([np.zeros((1, lanes), np.int64), x[:-1]]))
    h, done = np.zeros((lanes, HIDDEN), np.float32), 0
    for lo in range(0, steps, WINDOW):
        grads, h = _window(p, h, reads[lo:lo + WINDOW], x[lo:lo + WINDOW], new[lo:lo + WINDOW])
        done += 1
        for k, v in p.items():
            g = np.clip(grads[k] / np.float32(lanes), -5, 5)
            m1[k] += np.float32(0.1) * (g - m1[k])
            m2[k] += np.float32(0.01) * (g * g - m2[k])
            v -= np.float32(RATE / (1 - 0.9**done)) * m1[k] / (np.sqrt(m2[k] * np.float32(1 / (1 - 0.99**done))) + np.float32(1e-6))
    return p, lanes * steps


def dealt_to_rounds(docs: DataFrame, rounds: int) -> DataFrame:
    """All rows with ``round`` and ``place``, a hash that deals and orders the rows of a round; both follow from the row, not from its text."""
    place = F.xxhash64(F.lit("place"), F.monotonically_increasing_id())
    return docs.withColumn("place", place).withColumn("round", F.pmod(F.xxhash64(F.lit("round"), "place"), F.lit(rounds)).cast("int"))


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, dict] | None:
    """Vocabulary and weights; None where there is no training document.

    All documents are read once. They are dealt to rounds and tasks by a hash of their row, so copies
    of one text spread like any others.
    """
    totals = counts.groupBy("open").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # one row per open class
    if not totals:
        return None
    n, v = sum(r["c"] for r in totals), sum(r["v"] for r in totals)
    by_size = counts.groupBy(F.floor(F.log2(F.col("c").cast("double"))).alias("b")).count().orderBy(F.desc("b")).collect()  # at most 64 rows
    least, some = 1 << 62, 0
    for r in by_size:
        some += r["count"]
        if some > FREQUENT:
            break
        least = 1 << r["b"]
    head = counts.where((F.col("c") >= least) | (F.col("token") == END)).collect()
    vocabulary = Vocabulary([tuple(r) for r in head], n + v + 1, {r["open"]: (r["c"], r["v"]) for r in totals})
    weights = _start(0, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 1, PART_BYTES):
                sizes, codes, words = _words(part.column(1))
                numbers = vocabulary.of(words)[1].astype(np.int16)[codes]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(numbers)), part.column(2)],
                                                 names=["round", "numbers", "place"])

    dealt = dealt_to_rounds(docs.select(F.col(text_col).alias("text")), rounds)
    texts = stored(dealt.select("round", "text", "place").mapInArrow(encode, "round int, numbers array<short>, place long"), "lm-texts")
    words = texts.agg(F.sum(F.size("numbers"))).first()[0] or 0
    tasks = max(1, round(words / rounds / TASK_WORDS))
    slots = math.isqrt(tasks)
    names = sorted(weights)

    def one_round(now: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one_thread()
            own = [x.astype(np.int64) for b in batches for x in b["numbers"]]
            if own:
                new, n = _train(now, own)
                # Weights are trained in single precision and travel in it; means are taken in doubles.
                parts = np.array_split(np.concatenate([new[k].ravel() for k in names]), 64)
                slot = TaskContext.get().partitionId() % slots
                yield pd.DataFrame({"part": range(64), "slot": [slot] * 64, "n": [n] * 64, "weights": parts})
        return run

    def add(key, rows):
        n = rows["n"].to_numpy(np.float64)
        mean = (np.stack(rows["weights"].to_numpy()).astype(np.float64) * n[:, None]).sum(axis=0) / n.sum()
        return pd.DataFrame({"part": [key[0]], "slot": [key[1] if len(key) > 1 else 0], "n": [int(n.sum())], "weights": [mean.astype(np.float32)]})

    schema = "part int, slot int, n long, weights array<float>"
    for k in range(rounds):
        of_round = texts.where(F.col("round") == k)
        dealt = of_round.repartition(tasks, "place").sortWithinPartitions("place")
        sums = dealt.select("numbers").mapInPandas(one_round(weights), schema)
        # In two steps, so that no task adds up the weights of all others.
        got = sums.groupBy("part", "slot").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).collect()  # 64 rows
        if got:
            flat = np.concatenate([np.array(r["weights"], np.float64) for r in sorted(got)])
            at = 0
            for name in names:
                size = weights[name].size
                weights[name] = flat[at:at + size].reshape(weights[name].shape)
                at += size
    return vocabulary, weights


def _score(p: dict, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text's classes and frequent words, all texts side by side, states carried to their ends."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    n = sizes[order]
    longest = int(n[0]) if len(n) else 0
    live = len(n) - np.searchsorted(n[::-1], np.arange(longest), side="right")
    h, read = np.zeros((len(n), HIDDEN), np.float32), np.zeros(len(n), np.int64)
    table = p["x"] + p["b"]
    table[:, :2 * HIDDEN] *= 0.5  # a sigmoid is half a tanh of half
    u = p["u"] * np.float32(0.5)
    out, states, targets, owners, held = np.zeros(len(sizes)), [], [], [], 0

    def flush() -> None:
        nonlocal states, targets, owners, held
        if held:
            got, _ = _outputs(p, np.concatenate(states), np.concatenate(targets))
            out[:] += np.bincount(np.concatenate(owners), got, len(sizes))
            states, targets, owners, held = [], [], [], 0

    for t in range(longest):
        k = int(live[t])
        h = h[:k]
        g = table[read[:k]]
        gates = np.tanh(g[:, :2 * HIDDEN] + h @ u)
        gates *= 0.5
        gates += 0.5
        new = (gates[:, HIDDEN:] * h) @ p["s"]
        new += g[:, 2 * HIDDEN:]
        np.tanh(new, out=new)
        new -= h
        new *= gates[:, :HIDDEN]
        h = h + new
        read = numbers[first[:k] + t]
        states.append(h)
        targets.append(read)
        owners.append(order[:k])
        held += k
        if held > STATES:
            flush()
    flush()
    return out


def score(docs: DataFrame, counts: DataFrame, model: tuple[Vocabulary, dict] | None, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``columns`` with n_tokens, n_known, base_score and score of every document; a null text is an end alone.

    Without any training document no token is known, every token has base log10(1/1) and the model gives the same.
    """
    if model is None:
        n = F.size(F.array_remove(F.split(F.coalesce(docs[text_col], F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1
        return docs.select(*columns, n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    vocabulary, weights = model
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    log_counts = np.log10(vocabulary.counts + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for part in text_parts(batch, batch.num_columns - 1, PART_BYTES):
                sizes, codes, words = _words(part.column(part.num_columns - 1))
                place, number = vocabulary.of(words)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                rare = place[codes] < 0
                known = np.bincount(owner[~rare], minlength=len(sizes))
                common = np.bincount(owner, log_counts[place[codes]], len(sizes))  # place -1 is a count of zero
                inside = number[codes] >= CLASS_SIZE * CLASSES
                # Words of open classes: their share, less the count of the rare ones, which the join adds.
                each = log_counts[place] - np.log10(vocabulary.open_total)[np.maximum(number - CLASS_SIZE * CLASSES, 0)]
                share = np.bincount(owner[inside], each[codes[inside]], len(sizes))
                model_score = _score(weights, sizes, number[codes]) / LOG10 + share
                pairs, tf = np.unique(owner[rare] * np.int64(len(words)) + codes[rare], return_counts=True)
                of, token = pairs // len(words), words.take(pa.array(pairs % len(words))).cast(pa.string())
                n, m = len(sizes), len(pairs)
                nothing = np.zeros(m, np.int64)
                pick = pa.array(np.concatenate([np.arange(n), np.full(m, -1)]), mask=np.arange(n + m) >= n)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.append(np.arange(n), of))), *(c.take(pick) for c in part.columns[1:-1]),
                    pa.array(np.append(sizes, tf)), pa.array(np.append(known, nothing)),
                    pa.array(np.append(common - sizes * np.log10(vocabulary.size), nothing)), pa.array(np.append(model_score, nothing)),
                    pa.concat_arrays([pa.nulls(n, pa.string()), token])], names=["row", *(f"c{i}" for i in range(len(columns))), "n", "known", "base", "model", "token"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), *(docs[c].alias(f"c{i}") for i, c in enumerate(columns)), docs[text_col].alias("text"))
    types = ", ".join(f"{c} {t}" for c, t in slim.dtypes[:-1])
    both = stored(slim.mapInArrow(run, f"{types}, n long, known long, base double, model double, token string"), "lm-scores")
    whole = both.where("token IS NULL")
    rare = (both.where("token IS NOT NULL").select("row", "token", "n").join(counts.select("token", "c"), "token")
            .groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_sum")))
    more = F.coalesce("rare_sum", F.lit(0.0))
    return whole.join(rare, "row", "left").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
