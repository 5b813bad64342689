"""Text quality by a sparse ensemble of rules over statistics of the text.

Trees are grown on the statistics of a labelled sample, every path from a root becomes a rule (a
conjunction of comparisons), a lasso logistic regression keeps few of them, and those are compiled
into one column expression. Scoring is a projection: no shuffle, no Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import bounded_sample, unique_name

#: Labelled documents that rules are fitted on, chosen by a hash of the id.
MAX_LABELLED = 8_000
TREES, DEPTH, BINS, MIN_LEAF = 40, 3, 32, 10
#: Proximal gradient steps of the lasso.
STEPS = 1_500
LASSO = 0.002
SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts; a null text counts as empty, ratios of nothing are zero."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.array_remove(F.split(text, "\n"), "")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def without(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(text, pattern, ""))

    return {
        "chars": n.cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": ratio(without(r"[^\x20\x09-\x0D]+"), F.size(words)),
        "distinct_words": ratio(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": ratio(n, F.size(lines)),
        "capitals": ratio(without(r"\p{Lu}+"), n),
        "digits": ratio(without("[0-9]+"), n),
        "symbols": ratio(without(r"[^\p{L}\p{N}\s.,]+"), n),
        "stops": ratio(without("[.]+"), F.size(words)),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("double"),
    }


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple = ()) -> tuple[list, np.ndarray]:
    """Rules of one regression tree, and its prediction for the rows."""
    n = len(grad)
    value = np.full(n, grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or n < 2 * MIN_LEAF:
        return [path] if path else [], value
    best, base = (1e-6, None, None), grad.sum() ** 2 / (hess.sum() + 1)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        bins = np.searchsorted(cut, x[:, j], side="left")  # x <= cut[b] for bins <= b
        g, h, c = (np.bincount(bins, w, len(cut) + 1).cumsum()[:-1] for w in (grad, hess, None))
        gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - base
        gain[(c < MIN_LEAF) | (n - c < MIN_LEAF)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, float(cut[k]))
    if best[1] is None:
        return [path] if path else [], value
    _, j, at = best
    low = x[:, j] <= at
    rules = [path] if path else []
    for side, less in ((low, True), (~low, False)):
        more, value[side] = _grow(x[side], grad[side], hess[side], cuts, depth - 1, (*path, (j, less, at)))
        rules += more
    return rules, value


def _simple(path: tuple) -> tuple:
    """The tightest bound for each statistic and side, in a fixed order."""
    bounds: dict[tuple, float] = {}
    for j, less, at in path:
        bounds[j, less] = min(bounds.get((j, less), at), at) if less else max(bounds.get((j, less), at), at)
    return tuple(sorted((j, less, at) for (j, less), at in bounds.items()))


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, less, at in rule:
        out &= x[:, j] <= at if less else x[:, j] > at
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, lasso: float = LASSO) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]): boosted trees give the rules, proximal gradient steps the sparse weights."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    at, rules = np.zeros(len(y)), {}
    for k in range(TREES):
        p = 1 / (1 + np.exp(-at))
        pick = np.random.default_rng(k).random(len(y)) < 0.5
        paths, _ = _grow(x[pick], (y - p)[pick], (p * (1 - p))[pick], cuts, DEPTH)
        # The rules of a tree share no weights yet: a leaf's step is refitted on all rows.
        step, leaves = np.zeros(len(y)), [r for r in paths if not any(len(o) > len(r) and o[:len(r)] == r for o in paths)]
        for leaf in leaves:
            inside = _holds(leaf, x)
            step[inside] = (y - p)[inside].sum() / ((p * (1 - p))[inside].sum() + 1)
        at = at + 0.3 * np.clip(step, -3, 3)
        rules |= dict.fromkeys(map(_simple, paths))
    rules = list(rules)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    if not rules:
        return bias, []
    # Of rules that hold on the same rows the first one stays.
    rules = list({_holds(r, x).tobytes(): r for r in reversed(rules)}.values())[::-1]
    m = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float32)
    w = np.zeros(len(rules))
    v, b, vb, t = w.copy(), bias, bias, 1.0
    rate = 4.0 / max(np.linalg.norm(m.T @ m / len(y), 2) + 1, 1e-9)
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-np.clip(m @ v + vb, -30, 30))) - y
        new = v - rate * (m.T @ miss) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        nb, nt = vb - rate * miss.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-4]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED) -> dict:
    """Fit on at most ``max_labelled`` labelled documents; the driver gets their statistics, not their texts.

    Rows without id or label are left out, and rows equal in id, text and label count once; texts may be empty or
    of any length, since only their statistics are kept. Without documents of both labels the model has no rules
    and every score is the share of good ones (one half without any label).
    """
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
              .orderBy(F.xxhash64("__id"), "__label").limit(max_labelled))
    met = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).join(F.broadcast(chosen), "__id")
    stats = statistics(F.col("__text"))
    # An id may be repeated in the documents: the bound holds for the rows that are met, too.
    sample = bounded_sample(met, max_labelled)
    got = sample.select("__label", *(c.alias(k) for k, c in stats.items())).toPandas().sort_values(["__label", *stats])
    y = got["__label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return {"bias": float(np.log(share / (1 - share))), "rules": []}
    bias, rules = fit_rules(got[list(stats)].to_numpy(float), y)
    names = list(stats)
    return {"bias": bias, "rules": [(tuple((names[j], less, at) for j, less, at in r), w) for r, w in rules]}


def rule_column(rule: tuple, stats: str) -> Column:
    """A rule as a condition over the fields of a struct of statistics."""
    out = F.lit(True)
    for name, less, at in rule:
        out = out & (F.col(stats)[name] <= at if less else F.col(stats)[name] > at)
    return out


def _compiled(docs: DataFrame, model: dict, text_col: str) -> tuple[DataFrame, Column]:
    """The documents with a struct of the statistics that the rules use, and the log-odds as a column over it.

    The statistics are projected, where Spark computes what they share once, and pass through a
    generator of one row. Without it a filter would be pushed below the projection, and every
    comparison of every rule would compute its statistic anew.
    """
    used = {name for rule, _ in model["rules"] for name, _, _ in rule}
    fields = [c.alias(k) for k, c in statistics(docs[text_col]).items() if k in used]
    stats, made = unique_name(docs, "__stats"), unique_name(docs, "__made")
    linear = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        linear = linear + F.when(rule_column(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
    if not fields:
        return docs, linear
    return docs.withColumn(made, F.struct(*fields)).select(*docs.columns, F.explode(F.array(made)).alias(stats)), linear


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, all columns as they are.

    A null text counts as empty, whose statistics are zero; texts of any length are measured whole; repeated rows
    are judged alike, an empty table stays empty, and columns may have any names.
    """
    rows, linear = _compiled(docs, model, text_col)
    return rows.where(1 / (1 + F.exp(-linear)) >= threshold).select(*docs.columns)


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of every document, then score and predicted (a column of that name is replaced).

    Nulls, empty and long texts, repeated rows and empty tables are treated as in ``keep_good``.
    """
    rows, linear = _compiled(docs, model, text_col)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = rows.select(*kept, (1 / (1 + F.exp(-linear))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
