"""Near-duplicate vectors by product quantisation: inverted lists, table-lookup distances, exact rerank.

Unit vectors fall into the list of their nearest coarse centroid; what is left of them is coded in
subspaces. A vector probes its own list and every other list into which a linked vector could
reach: crossing the border between two lists by more than ``margin`` is what a link of cosine
``threshold`` can't do but by far outliers (``margin=None`` probes whatever geometry allows, and
then no link at all can be missed). A code's distance is off by at most its stored error, so the
filter on table-lookup distances loses nothing, and the exact cosine in double precision decides.

Quantisers are fitted on a bounded sample; every vector is indexed. Equal vectors are one entry
with a count. Large lists are dealt out in blocks, queries are streamed past the entries of a
block, and a task gives back counts and a spanning forest instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import stored
from loudframe.llm.components import components, local_forest

#: Vectors that the quantisers are fitted on, chosen by a hash of the vector.
SAMPLE = 10_000
SUBSPACES, CODES = 8, 256
MAX_LISTS, BLOCK = 1024, 20_000
MARGIN = 0.15


def _assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (2 * x @ centroids.T - np.square(centroids).sum(axis=1)).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centroids = x[np.random.default_rng(k).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _assign(x, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.stack([np.bincount(at, x[:, j], len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled by the largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centroids and the codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = _kmeans(sample, lists)
        rest = sample - self.coarse[_assign(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]
        self.between = np.sqrt(np.maximum(np.square(self.coarse[:, None] - self.coarse[None]).sum(axis=2), 1e-18))

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the distance between each vector and its code."""
        home = _assign(x, self.coarse)
        rest = x - self.coarse[home]
        codes = np.stack([_assign(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return home, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """vectors x lists: whether the border with a list is nearer than ``reach``. The own list always is."""
        d = np.square(x).sum(axis=1)[:, None] - 2 * x @ self.coarse.T + np.square(self.coarse).sum(axis=1)
        beyond = (d - d[np.arange(len(x)), home][:, None]) / (2 * self.between[home])
        out = beyond <= reach
        out[np.arange(len(x)), home] = True
        return out

    def distances(self, q: np.ndarray, centroid: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the codes of a list, by one table per query and subspace."""
        rest, out = q - self.coarse[centroid], np.zeros((len(q), len(codes)), np.float32)
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            table = np.square(rest[:, p]).sum(axis=1)[:, None] - 2 * rest[:, p] @ b.T + np.square(b).sum(axis=1)
            out += table.astype(np.float32)[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _entries(index: Index, reach: float, blocks: dict[int, int] | None):
    """Rows of the inverted lists: an entry for each vector (query false), and a query for each list that it probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                cls, raw = part.column("cls").to_numpy(), _vectors(part.column("embedding"))
                x = _unit(raw)
                home, codes, error = index.code(x)
                # One of two lists finds a pair: the one with the larger number.
                at, where = np.nonzero(index.probes(x, home, reach) & (np.arange(len(index.coarse)) >= home[:, None]))
                n = np.array([blocks[int(c)] if int(c) in blocks else 0 for c in range(len(index.coarse))])[where]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, where = np.repeat(at, n), np.repeat(where, n)
                mine = np.array([blocks[int(c)] for c in home])
                own = (cls * 2654435761 % (1 << 31)) % mine
                pick = np.concatenate([np.arange(len(x)), at])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([home, where]).astype(np.int32)), pa.array(np.concatenate([own, block]).astype(np.int32)),
                    pa.array(np.arange(len(pick)) >= len(x)), pa.array(cls[pick]), part.column("copies").take(pa.array(pick)),
                    part.column("embedding").take(pa.array(pick)),
                    pa.array([c.tobytes() for c in codes] + [None] * len(at), pa.binary()),
                    pa.array(np.concatenate([error, np.zeros(len(at))]))], names=["list", "block", "query", "cls", "copies", "embedding", "code", "error"])
    return run


def _search(index: Index, threshold: float):
    far = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5

    def links(entries: dict, q: dict, centroid: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of linked (query, entry) pairs."""
        found_q, found_x = [], []
        rows = max(1, 2_000_000 // max(1, len(entries["cls"])))
        for lo in range(0, len(q["cls"]), rows):
            near = index.distances(q["unit"][lo:lo + rows], centroid, entries["codes"]) <= far + entries["error"]
            i, j = np.nonzero(near)
            i += lo
            # Inside a list a pair is met from both sides.
            once = (q["home"][i] != centroid) | (q["cls"][i] < entries["cls"][j])
            i, j = i[once], j[once]
            for at in range(0, len(i), 200_000):
                a, b = i[at:at + 200_000], j[at:at + 200_000]
                ok = np.einsum("ij,ij->i", q["unit"][a], entries["unit"][b]) >= threshold
                found_q.append(a[ok])
                found_x.append(b[ok])
        return np.concatenate(found_q or [np.empty(0, int)]), np.concatenate(found_x or [np.empty(0, int)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, entries = None, [], None
        for batch in batches:
            at = 0
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            borders = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            for to in borders[borders > 0]:
                part, key, query = batch.slice(at, to - at), tuple(keys[at, :2]), keys[at, 2]
                at = int(to)
                if key != here:
                    here, parts, entries = key, [], None
                if not query:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if entries is None:
                    whole = pa.Table.from_batches(parts).combine_chunks()
                    entries = {"cls": whole["cls"].to_numpy(), "copies": whole["copies"].to_numpy(), "unit": _unit(_vectors(whole["embedding"].combine_chunks())),
                               "codes": np.frombuffer(b"".join(whole["code"].to_pylist()), np.uint8).reshape(whole.num_rows, -1),
                               "error": whole["error"].to_numpy().astype(np.float32)}
                x = _unit(_vectors(part.column("embedding")))
                q = {"cls": part.column("cls").to_numpy(), "copies": part.column("copies").to_numpy(), "unit": x, "home": _assign(x, index.coarse)}
                i, j = links(entries, q, here[0])
                if not len(i):
                    continue
                ids = np.concatenate([q["cls"][i], entries["cls"][j]])
                n = np.concatenate([entries["copies"][j], q["copies"][i]])
                nodes, flat = np.unique(ids, return_inverse=True)
                a, b = local_forest(q["cls"][i], entries["cls"][j])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([nodes, a])), pa.array(np.concatenate([np.bincount(flat, n).astype(np.int64), np.zeros(len(a), np.int64)])),
                    pa.array([None] * len(nodes) + b.tolist(), pa.int64())], names=["a", "n", "b"])

    return run


def class_links(classes: DataFrame, n: int, threshold: float, margin: float | None, sample: int = SAMPLE) -> DataFrame:
    """(a, n, b) over a stored table (cls, copies, embedding) of distinct vectors of one length: links of a (rows with b null), and edges a-b."""
    fitted = classes.orderBy(F.xxhash64("embedding"), "cls").limit(sample).select("embedding").toArrow()
    units = _unit(_vectors(fitted["embedding"].combine_chunks()))
    index = Index(units, max(1, min(MAX_LISTS, len(units), int(math.sqrt(n) / 2))))
    # Rounding moves a border by far less than this.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9 if margin is None else margin

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, count = np.unique(_assign(_unit(_vectors(batch.column(0))), index.coarse), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(count.astype(np.int64))], names=["list", "n"])

    sizes = classes.select("embedding").mapInArrow(homes, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()  # MAX_LISTS rows
    blocks = {r["list"]: -(-r["n"] // BLOCK) for r in sizes}
    rows = classes.mapInArrow(_entries(index, reach, blocks),
                              f"list int, block int, query boolean, cls long, copies long, embedding {dict(classes.dtypes)['embedding']}, code binary, error double")
    return (rows.repartition("list", "block").sortWithinPartitions("list", "block", "query")
            .mapInArrow(_search(index, threshold), "a long, n long, b long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, margin: float | None = MARGIN, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    no link joins vectors of different lengths. Repeated ids are vectors of their own; a null id
    takes part in links, and is a component's id only if all ids of the component are null.
    """
    usable = (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(
        vector_col, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, F.col(vector_col)).alias("embedding"))
    classes = stored(rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
                     .withColumn("cls", F.monotonically_increasing_id()), "vectors")
    found = None
    for size, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("embedding")).count().collect()):
        part = class_links(classes.where(F.size("embedding") == size).select("cls", "copies", "embedding"), n, threshold, margin)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counted = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    known = (classes.join(roots, classes["cls"] == roots["node"], "left").join(counted, F.col("cls") == F.col("a"), "left")
             .select("embedding", "low", F.coalesce("root", "cls").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    known = stored(known, "classes")
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = known.join(lowest, "root").select(F.col("embedding").alias("__same"), "n_links", "component_id")
    met = rows.join(by_class, rows["embedding"] == by_class["__same"], "left")
    lone = F.col("__same").isNull()
    component = F.when(lone, F.col("vec_id")).otherwise(F.col("component_id"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
