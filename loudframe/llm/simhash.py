"""Near-duplicate texts by SimHash fingerprints, found with multi-index hashing.

A fingerprint is cut into segments. Two that differ in at most r bits differ in at most r // m bits
of one of m segments, so each fingerprint looks up the small Hamming ball around each of its
segments in the table of segments, and every match is verified on all bits. No link is missed.

Only fingerprints and ids move. Equal fingerprints are one entry; a table cell with many different
fingerprints is compared in blocks inside a task and leaves it as a spanning forest, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import split_words, stored, text_parts
from loudframe.llm.components import components, local_forest

SHINGLE, RADIUS, SEGMENTS, SEED = 3, 3, 2, 42
BITS = 64
#: Words hashed at a time in a worker, and comparisons made at a time.
CHUNK_WORDS, CHUNK_PAIRS = 200_000, 2_000_000

#: Each byte's bits as the bytes of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(words: pa.Array, sizes: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of texts given as one array of words and the words of each text."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes >= shingle)
    ends = np.cumsum(sizes)
    if len(full):
        columns = [words.slice(k, len(words) - shingle + 1) for k in range(shingle)]
        joined = pc.binary_join_element_wise(*columns, pa.scalar(" ", words.type)) if shingle > 1 else words
        inside = np.ones(len(joined), bool)
        for d in range(1, shingle):  # windows that reach into the next text
            at = ends - d
            inside[at[(at >= 0) & (at < len(joined))]] = False
        short = np.flatnonzero((sizes > 0) & (sizes < shingle))
        for d in short:
            inside[ends[d] - sizes[d]:ends[d]] = False
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(x, seed) for x in joined.filter(pa.array(inside)).cast(pa.large_binary()).to_numpy(zero_copy_only=False)], np.uint64)
        n = sizes[full] - shingle + 1
        # Ones are counted eight at a time, in the bytes of a word, over runs too short to overflow one.
        first = np.cumsum(n) - n
        runs = np.unique(np.append(first, np.arange(0, len(hashes), 200)))
        some = np.add.reduceat(SPREAD[hashes.view(np.uint8).reshape(-1, 8)], runs, axis=0).view(np.uint8)
        ones = np.add.reduceat(some, np.searchsorted(runs, first), axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    for d in np.flatnonzero((sizes > 0) & (sizes < shingle)):
        # A single hash: the bits set in over half of the hashes are its own.
        out[d] = xxhash.xxh64_intdigest(" ".join(words.slice(ends[d] - sizes[d], sizes[d]).to_pylist()).encode(), seed)
    return out


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The ``columns`` and ``fp`` (the 64 bits as a long) of every row; null texts and texts without words have 0."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in text_parts(batch, batch.num_columns - 1, CHUNK_WORDS * 6):
                words, sizes = split_words(part.column(part.num_columns - 1))
                found.append(fingerprints_of(words, sizes, shingle, seed))
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    slim = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(columns)), docs[text_col].alias("__text"))
    types = ", ".join(f"{c} {t}" for c, t in slim.dtypes[:-1])
    got = slim.mapInArrow(per_batch, f"{types}, fp long" if types else "fp long")
    return got.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "fp")


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in at) for k in range(radius + 1) for at in combinations(range(bits), k)]


def _cell_links(key: np.ndarray, own: np.ndarray, node: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells; rows are sorted by cell, with the table's own entries first in each."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    table = np.add.reduceat(own.astype(np.int64), first)
    left, right = [], []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        near = (np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= radius) & (node[i] != node[j])
        left.append(node[i[near]])
        right.append(node[j[near]])

    pairs = size * table
    some = (pairs >= 2) & (size > 1)
    small = np.flatnonzero(some & (pairs <= CHUNK_PAIRS))
    while len(small):
        take = max(1, int(np.searchsorted(np.cumsum(pairs[small]), CHUNK_PAIRS, side="right")))
        now, small = small[:take], small[take:]
        n = pairs[now]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, width = np.repeat(first[now], n), np.repeat(size[now], n)
        verify(start + k // width, start + k % width)
    for c in np.flatnonzero(some & (pairs > CHUNK_PAIRS)):
        here, rows = np.arange(first[c], first[c] + size[c]), max(1, CHUNK_PAIRS // int(size[c]))
        for at in range(0, int(table[c]), rows):
            mine = here[at:min(at + rows, int(table[c]))]
            verify(np.repeat(mine, len(here)), np.tile(here, len(mine)))
            a, b = local_forest(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return local_forest(np.concatenate(left), np.concatenate(right))


def links(nodes: DataFrame, lanes: list[str], radius: int, width: int, ball: int) -> DataFrame:
    """(a, b): enough links between nodes, whose fingerprints (columns ``lanes``) differ in ``radius`` or fewer bits together, to join what they join.

    Segments of ``width`` bits are looked up with up to ``ball`` bits flipped. All links are found if
    (ball + 1) * number of segments > radius.
    """
    mask, balls, rows, number = (1 << width) - 1, _ball(width, ball), None, 0
    for lane in lanes:
        for s in range(BITS // width):
            own = F.shiftrightunsigned(lane, s * width).bitwiseAND(F.lit(mask).cast("long"))
            cells = F.transform(F.array(*(F.lit(m).cast("long") for m in balls)), lambda m, i: F.struct(
                own.bitwiseXOR(m).alias("key"), (i == 0).alias("own")))
            part = nodes.select(F.lit(number).cast("long").alias("segment"), "node", *lanes, F.explode(cells).alias("cell"))
            rows, number = part if rows is None else rows.union(part), number + 1
    # The segment's number goes above its bits.
    key = F.col("cell.key") + F.shiftleft("segment", width)
    dealt = (rows.select(key.alias("key"), F.col("cell.own").alias("own"), "node", *lanes)
             .repartition("key").sortWithinPartitions("key", F.desc("own")))

    def cells_of(held: list[np.ndarray]) -> pa.RecordBatch:
        # As unsigned numbers: of a negative one, numpy counts the bits of its absolute value.
        return _batch(*_cell_links(held[0], held[1], held[2], np.stack(held[3:], axis=1).view(np.uint64), radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1], side="left")) if len(now[0]) else 0
            held = [x[last:] for x in now]  # its cell may go on in the next batch
            if last:
                yield cells_of([x[:last] for x in now])
        if held is not None and len(held[0]):
            yield cells_of(held)

    return dealt.mapInArrow(run, "a long, b long")


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): enough links between nodes of a table (node, fp), whose fingerprints differ in at most ``radius`` bits, to join what they join."""
    return links(distinct, ["fp"], radius, BITS // segments, radius // segments)


def group_by_fingerprint(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Rows of ``prints`` (id and fp) with ``component_id``, the smallest id reachable by links, the row's own included.

    Rows without an id take part in links; a component of such rows only has a null id.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "fingerprints")
    roots = components(near_links(distinct.select(F.col("fp").alias("node"), "fp"), radius, segments))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.where("root <> fp OR low IS NOT NULL").groupBy("root").agg(F.min("low").alias("component_id"))
    ids = rooted.join(lowest, "root", "left").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(ids, prints["fp"] == ids["__fp"]).drop("__fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = stored(fingerprints(docs, (id_col,), text_col, shingle).withColumnRenamed(id_col, "doc_id"), "prints")
    return group_by_fingerprint(prints, "doc_id", radius, segments).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
