"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Only documents are labelled, so token labels are derived: a feature of a word (the word itself, its
first four or five characters) that occurs in many toxic and hardly any clean documents marks the
word as toxic wherever it stands in a toxic document. The field then learns how much each feature
and each neighbour say, and forward-backward gives every word's probability of lying in a toxic
span. A document's score is a logistic function of its words' marginals.

Document counts of features run over the whole labelled sample on Spark; the driver gets only the
lexicon and windows of feature numbers around lexicon words. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import bounded_sample, releasing, split_words, stored, text_parts

#: Bytes of text that a worker cuts into words at a time.
PART_BYTES = 1 << 20
#: Labelled documents that the field is fitted on, chosen by a hash of the id.
MAX_LABELLED = 10_000
MAX_LEXICON = 20_000
#: Windows, of 2 * REACH + 1 words, that each labelled document gives to the fit of the weights at most, chosen by a hash of text and position.
DOCUMENT_WINDOWS = 8
REACH = 4
PREFIXES = (4, 5)
MIN_TOXIC = 3
#: How much likelier a feature must be in toxic documents to enter the lexicon, and to mark a word as toxic.
MIN_LIFT, MARK_LIFT = 4.0, 8.0
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def features_of(word: str) -> list[str]:
    """The word without punctuation around it, in small letters, and its first characters."""
    word = EDGE.sub("", word).lower()
    return [f"w:{word}", *(f"p{k}:{word[:k]}" for k in PREFIXES if len(word) >= k)] if word else []


def _parts(batches: Iterator[pa.RecordBatch], column: str | int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded text, so that a worker's memory doesn't follow the size of a batch."""
    for batch in batches:
        yield from text_parts(batch, batch.schema.get_field_index(column) if isinstance(column, str) else column, PART_BYTES)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word borders of each text, each word's number, and the distinct words. A null text has none."""
    words, sizes = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    return np.append(0, np.cumsum(sizes)), coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many documents of a batch each feature occurs."""
    for batch in _parts(batches, "text"):
        borders, codes, words = _tokens(batch.column("text"))
        names: dict[str, int] = {}
        own = [[names.setdefault(f, len(names)) for f in features_of(w)] for w in words]
        width = 1 + len(PREFIXES)
        table = np.array([f + [-1] * (width - len(f)) for f in own] or np.empty((0, width)), dtype=np.int64).reshape(-1, width)
        owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        pairs = np.unique(np.concatenate([(owner * (len(names) + 1) + table[codes, k])[table[codes, k] >= 0] for k in range(width)] or [np.empty(0, np.int64)]))
        toxic = batch.column("label").to_numpy(zero_copy_only=False).astype(bool)[pairs // (len(names) + 1)]
        found = pairs % (len(names) + 1)
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(list(names), pa.string()),
            "toxic": pa.array(np.bincount(found[toxic], minlength=len(names)).astype(np.int64)),
            "clean": pa.array(np.bincount(found[~toxic], minlength=len(names)).astype(np.int64))})


def _feature_table(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """For each distinct word its lexicon numbers, -1 where there is none."""
    width, none = 1 + len(PREFIXES), len(lexicon)
    out = np.full((len(words), width), none)
    for i, w in enumerate(words):
        for k, f in enumerate(features_of(w)):
            out[i, k] = lexicon.get(f, none)
    return out


def _windows_of(lexicon: dict[str, int], strong: np.ndarray):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, none = 1 + len(PREFIXES), len(lexicon)
        for batch in _parts(batches, "text"):
            texts = batch.column("text")
            borders, codes, words = _tokens(texts)
            table = _feature_table(words, lexicon)
            hit = (table < none).any(axis=1)
            marks = np.append(strong, False)[table].any(axis=1)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            rows = []
            for d in range(len(labels)):
                own = codes[borders[d]:borders[d + 1]]
                at = np.flatnonzero(hit[own])
                if len(at) >= DOCUMENT_WINDOWS:
                    seed = np.uint64(xxhash.xxh64_intdigest(texts[d].as_py()))
                    drawn = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                    at = np.sort(at[np.argsort(drawn ^ (drawn >> np.uint64(32)), kind="stable")[:DOCUMENT_WINDOWS - 1]])
                if len(own):
                    at = np.append(at, len(own) // 2)  # one window from elsewhere
                for i in at:
                    w = np.full((2 * REACH + 1, width), -1)
                    lo, hi = max(0, i - REACH), min(len(own), i + REACH + 1)
                    w[lo - i + REACH:hi - i + REACH] = table[own[lo:hi]]
                    y = np.zeros(2 * REACH + 1, int)
                    y[lo - i + REACH:hi - i + REACH] = marks[own[lo:hi]] & (labels[d] == 1)
                    rows.append((w.ravel().tolist(), y.tolist()))
            yield pa.RecordBatch.from_pydict({"x": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                                              "y": pa.array([r[1] for r in rows], pa.list_(pa.int32()))})
    return cut


def _fit_field(x: np.ndarray, y: np.ndarray, n_features: int, steps: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> dict:
    """Weights of the field by gradient ascent on the windows' conditional log-likelihood. x: windows, words, features."""
    theta, bias, trans = np.zeros(n_features + 1), -3.0, np.zeros((2, 2))
    inside = x[:, :, 0] >= 0
    n, length = inside.shape
    g2 = [np.full_like(theta, 1e-8), 1e-8, np.full_like(trans, 1e-8)]
    idx = np.where(x >= 0, x, n_features)
    for _ in range(steps):
        theta[-1] = 0
        u = np.where(inside, bias + theta[idx].sum(axis=2), 0.0)
        e1, t = np.exp(np.clip(u, -30, 30)), np.exp(trans)
        pot = np.stack([np.ones_like(e1), e1], axis=2)
        alpha, beta = np.zeros((length, n, 2)), np.ones((length, n, 2))
        for i in range(length):
            prev = np.full((n, 2), 0.5) if i == 0 else np.where((inside[:, i - 1] & inside[:, i])[:, None], alpha[i - 1] @ t, 0.5)
            a = prev * pot[:, i]
            alpha[i] = a / a.sum(axis=1, keepdims=True)
        for i in range(length - 2, -1, -1):
            b = (pot[:, i + 1] * beta[i + 1]) @ t.T
            b = np.where((inside[:, i + 1] & inside[:, i])[:, None], b, 1.0)
            beta[i] = b / b.sum(axis=1, keepdims=True)
        m = alpha * beta
        m = (m / m.sum(axis=2, keepdims=True))[:, :, 1].T
        miss = np.where(inside, y - m, 0.0)
        d_theta = np.bincount(idx.ravel(), weights=np.repeat(miss.ravel(), idx.shape[2]), minlength=n_features + 1) / n - ridge * theta
        d_trans = np.zeros((2, 2))
        for i in range(length - 1):
            both = inside[:, i] & inside[:, i + 1]
            p = alpha[i][:, :, None] * t[None] * (pot[:, i + 1] * beta[i + 1])[:, None, :]
            p = p[both] / p[both].sum(axis=(1, 2), keepdims=True)
            d_trans -= p.sum(axis=0) / n
            np.add.at(d_trans, (y[both, i], y[both, i + 1]), 1.0 / n)
        for k, (w, d) in enumerate(((theta, d_theta), (None, miss.sum() / n), (trans, d_trans - ridge * trans))):
            g2[k] = g2[k] + np.square(d)
            if w is None:
                bias += rate * d / np.sqrt(g2[k])
            else:
                w += rate * d / np.sqrt(g2[k])
    theta[-1] = 0
    return {"theta": theta, "bias": float(bias), "trans": trans}


def _marginals(field: dict, table: np.ndarray, codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position, marginal) of every lexicon word, from forward-backward over whole texts.

    All other words look alike, so a run of g of them is the g-th power of one 2x2 matrix. Documents
    are walked side by side, one lexicon word at a time.
    """
    none = len(field["theta"]) - 1
    hit = (table < none).any(axis=1)
    at = np.flatnonzero(hit[codes])
    doc = np.searchsorted(borders, at, side="right") - 1
    if not len(at):
        return doc, at, np.empty(0)
    t = np.exp(field["trans"])
    null = t * np.array([1.0, np.exp(field["bias"])])
    values, left = np.linalg.eig(null)
    values, left = np.real(values), np.real(left)
    values = values / np.abs(values).max()
    right = np.linalg.inv(left)

    def runs(g: np.ndarray) -> np.ndarray:
        return np.einsum("ik,gk,kj->gij", left, values[None, :] ** g[:, None], right)

    e1 = np.exp(np.clip(field["bias"] + field["theta"][table[codes[at]]].sum(axis=1), -30, 30))
    pot = np.stack([np.ones_like(e1), e1], axis=1)
    docs, first, count = np.unique(doc, return_index=True, return_counts=True)
    alpha, beta = np.zeros((len(at), 2)), np.zeros((len(at), 2))
    order = np.argsort(-count, kind="stable")
    docs, first, count = docs[order], first[order], count[order]
    for k in range(count[0]):
        live = first[count > k] + k
        if k == 0:
            # Nothing goes before a text's first word, as in the windows of the fit.
            gap = at[live] - borders[doc[live]]
            prev = np.einsum("i,gij->gj", np.array([1.0, np.exp(field["bias"])]), runs(np.maximum(gap - 1, 0)))
            prev = np.where((gap > 0)[:, None], prev, 1.0)
        else:
            prev = np.einsum("gi,gij->gj", alpha[live - 1], runs(at[live] - at[live - 1] - 1))
        inner = (at[live] - borders[doc[live]] > 0)[:, None]
        a = np.where(inner, prev @ t, prev) * pot[live]
        alpha[live] = a / a.sum(axis=1, keepdims=True)
    for k in range(count[0]):
        live = (first + count - 1)[count > k] - k
        if k == 0:
            b = runs(borders[doc[live] + 1] - at[live] - 1).sum(axis=2)
        else:
            nxt = (pot[live + 1] * beta[live + 1]) @ t.T
            b = np.einsum("gij,gj->gi", runs(at[live + 1] - at[live] - 1), nxt)
        beta[live] = b / b.sum(axis=1, keepdims=True)
    m = alpha * beta
    return doc, at, m[:, 1] / m.sum(axis=1)


def _summary(doc: np.ndarray, m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Columns for the document score: logit of the largest marginal, logs of the expected number and density of toxic words."""
    top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    np.maximum.at(top, doc, m)
    np.add.at(total, doc, m)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(sizes)), np.log(top / (1 - top)), np.log1p(total), np.log((total + 0.1) / (sizes + 20))], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -2, 2)
    return w


def _summaries(model: dict):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "text"):
            borders, codes, words = _tokens(batch.column("text"))
            doc, _, m = _marginals(model, _feature_table(words, model["lexicon"]), codes, borders)
            x = _summary(doc, m, np.diff(borders))
            yield pa.RecordBatch.from_pydict({"top": pa.array(x[:, 1]), "total": pa.array(x[:, 2]), "density": pa.array(x[:, 3]), "label": batch.column("label")})
    return per_batch


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED) -> dict:
    """Fit lexicon, field and document score on at most ``max_labelled`` labelled documents.

    Rows without id or label are left out, and rows equal in id, text and label count once. A document with
    several labels counts once for each.
    Without a toxic or without a clean document every score is the known share of toxic ones.
    """
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("__id"), "label").limit(max_labelled))
    met = (docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
           .join(F.broadcast(chosen), "__id"))
    # An id may be repeated in the documents: the bound holds for the rows that are met, too.
    sample = stored(bounded_sample(met, max_labelled).select("text", "label"), "toxicity-sample")
    n_clean, n_toxic = (sample.where(F.col("label") == k).count() for k in (0, 1))
    model = {"lexicon": {}, "theta": np.zeros(1), "bias": -5.0, "trans": np.zeros((2, 2)),
             "score": np.array([np.log((n_toxic + 0.5) / (n_clean + 0.5)), 0.0, 0.0, 0.0])}
    if not n_clean or not n_toxic:
        return model
    lift = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    rows = (sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("lift", lift)
            .where((F.col("toxic") >= MIN_TOXIC) & (F.col("lift") >= MIN_LIFT))
            .orderBy(F.desc("toxic"), "feature").limit(MAX_LEXICON).collect())
    model["lexicon"] = {r["feature"]: i for i, r in enumerate(rows)}
    strong = np.array([r["lift"] >= MARK_LIFT for r in rows], bool)
    cut = sample.mapInArrow(_windows_of(model["lexicon"], strong), "x array<int>, y array<int>").toArrow()  # at most max_labelled * DOCUMENT_WINDOWS rows
    if rows and cut.num_rows:
        size = 2 * REACH + 1
        x = cut["x"].combine_chunks().flatten().to_numpy().reshape(-1, size, 1 + len(PREFIXES))
        y = cut["y"].combine_chunks().flatten().to_numpy().reshape(-1, size)
        model |= _fit_field(x, y, len(rows))
    else:
        model["theta"] = np.zeros(len(rows) + 1)
    got = sample.mapInArrow(_summaries(model), "top double, total double, density double, label int").toPandas()
    model["score"] = _fit_logistic(np.stack([np.ones(len(got)), got["top"], got["total"], got["density"]], axis=1), got["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: dict, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The ``columns`` of every document with score, predicted and spans.

    ``spans`` are (start, end, marginal) in characters of each word whose marginal is at least one
    half. A null text counts as empty and gets the score of a text without any toxic word, no spans.
    """
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model["lexicon"]
        for batch in _parts(batches, len(columns)):
            texts = batch.column(batch.num_columns - 1)
            borders, codes, words = _tokens(texts)
            doc, at, m = _marginals(model, _feature_table(words, lexicon), codes, borders)
            p = 1 / (1 + np.exp(-np.clip(_summary(doc, m, np.diff(borders)) @ model["score"], -30, 30)))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            marked = m >= 0.5
            for d in np.unique(doc[marked]):
                where = [x.span() for x in TOKEN.finditer(texts[int(d)].as_py())]
                lo, hi = np.searchsorted(doc, [d, d + 1])  # in order of documents
                pick = lo + np.flatnonzero(marked[lo:hi])
                spans[d] = [{"start": where[at[i] - borders[d]][0], "end": where[at[i] - borders[d]][1], "marginal": float(m[i])} for i in pick]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))],
                names=[*batch.schema.names[:-1], "score", "predicted", "spans"])

    slim = docs.select(*(docs[c] for c in columns), docs[text_col].alias("__text"))
    types = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes[:-1])
    return slim.mapInArrow(per_batch, f"{types}, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>")


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they are.

    A null text counts as empty and stays, as it has no toxic word; texts of any length are read whole, in slices of a
    batch; repeated rows are judged alike, an empty table stays empty, and columns may have any names.
    """
    at = docs.columns.index(text_col)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, at):
            borders, codes, words = _tokens(batch.column(at))
            doc, _, m = _marginals(model, _feature_table(words, model["lexicon"]), codes, borders)
            p = 1 / (1 + np.exp(-np.clip(_summary(doc, m, np.diff(borders)) @ model["score"], -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(releasing(per_batch), docs.schema)
