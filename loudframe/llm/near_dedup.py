"""One document of each group of near-duplicate texts, by SimHash fingerprints, minimum hashes and exact verification.

Groups are joined by similarity (Jaccard) of ``similarity`` or more on sets of ``shingle`` words.
Texts whose fingerprints of these shingles differ in few bits are candidates, all of them, found by
multi-index hashing as in ``simhash``. Pairs at the bound lie further apart than that: two texts
have equal minimum hashes with just the probability of their similarity, whatever their length,
vocabulary or the size of the table, so texts that agree in all hashes of a band are candidates,
too. Their exact similarity decides. Equal texts are one entry. Candidate groups are
verified in blocks of bounded size and, where a group has several, in pairs of blocks; only
verified links decide, all together, which text of a component stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm import simhash
from loudframe.llm.common import TEXT_ROWS, arrow_rows, one_thread, releasing, split_words, stored, text_parts
from loudframe.llm.components import components, local_forest

SHINGLE, SIMILARITY = 5, 0.8
#: Share of pairs at the similarity bound itself that must become candidates; pairs above it are found with more.
FOUND = 0.999
#: Share of such pairs that one band finds, at least; and hashes of a band, at most.
BAND_FOUND, BAND_ROWS = 0.25, 16
#: Texts of a candidate group that are compared at a time; more are compared block against block.
BLOCK = 512
#: Bytes of shingle hashes that a block of usual texts may have; a text with more than its share of them counts as several.
BLOCK_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a worker cuts into shingles at a time.
PART_BYTES = 1 << 19


def band_plan(similarity: float) -> tuple[int, int]:
    """(bands, hashes in each) that find their share of the pairs at the bound, for tables of any size."""
    rows = BAND_ROWS if similarity >= 1 else max(1, min(BAND_ROWS, int(math.log(BAND_FOUND) / math.log(similarity))))
    one = min(similarity**rows, 1 - 1e-9)
    return math.ceil(math.log(1 - FOUND) / math.log(1 - one)), rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _shingle_sets(words: pa.Array, sizes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's different shingles, text after text, and their numbers; a shorter text is one shingle, an empty one has none."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    word = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    n = np.where(sizes > 0, np.maximum(1, sizes - shingle + 1), 0)
    owner = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
    end = np.cumsum(sizes)[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(shingle):  # a place beyond the text's end counts as a word of its own
        inside = at + k < end
        value = value * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, word[np.where(inside, at + k, 0)] if len(word) else 0, np.uint64(0x5851F42D4C957F2D))
    value = _mixed(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[:len(value)]
    return value[new], np.bincount(owner[new], minlength=len(sizes))


def _band_keys(shingle: int, bands: int, rows: int):
    """For each text its fingerprint and one key per band, of the minimum hashes of its shingles. Texts without words share theirs."""
    odd = np.random.default_rng(3).integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 2, PART_BYTES):
                words, sizes = split_words(part.column(2))
                value, n = _shingle_sets(words, sizes, shingle)
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                keys = np.zeros((len(n), bands), np.uint64)
                for b in range(bands):
                    key = np.full(len(some), b, np.uint64)
                    for r in range(rows):
                        if len(some):
                            key = _mixed(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(value * odd[b, r], first))
                    keys[:, b] = b
                    keys[some, b] = key
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands)
                prints = simhash.fingerprints_of(words, sizes, shingle)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())), pa.array(prints.view(np.int64))],
                                                 names=["doc_id", "digest", "bands", "fp"])
    return run


def _shingles(shingle: int):
    """The last column's texts become their sorted shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, batch.num_columns - 1, PART_BYTES):
                value, n = _shingle_sets(*split_words(part.column(part.num_columns - 1)), shingle)
                out = [x.tobytes() for x in np.split(value, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])
    return run


def _resolve(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the position of the first set of its component of pairs at the similarity bound."""
    n, root = len(sets), np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    a, b = [], []
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        if common >= similarity * (size.sum() - common):
            a, b = [0], [1]
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        names, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[code] > 1
        place = np.cumsum(count > 1) - 1
        common = np.zeros((n, n), np.float32)
        column, rows = place[code[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, rows = column[order], rows[order]
        for lo in range(0, int((count > 1).sum()), 8192):
            i, j = np.searchsorted(column, [lo, lo + 8192])
            m = np.zeros((n, 8192), np.float32)
            m[rows[i:j], column[i:j] - lo] = 1
            common += m @ m.T
        near = common >= similarity * (size[:, None] + size[None] - common)
        a, b = np.nonzero(np.triu(near, 1))
    if len(a):
        node, low = local_forest(np.asarray(a), np.asarray(b))
        root[node] = low
    return root


def _verified(similarity: float):
    """Links (a, b) that join what the pairs within each block join. Rows are sorted by two block columns; then come cls and shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        here, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            root = _resolve(sets, similarity) if len(sets) > 1 else np.zeros(len(sets), int)
            own = np.array(ids, np.int64)
            more = root != np.arange(len(own))
            return pa.RecordBatch.from_arrays([pa.array(own[more]), pa.array(own[root[more]])], names=["a", "b"])

        for batch in batches:
            group, block, cls = (batch.column(k).to_pylist() for k in range(3))
            for i in range(batch.num_rows):
                if (group[i], block[i]) != here:
                    if ids:
                        yield done()
                    here, ids, sets = (group[i], block[i]), [], []
                ids.append(cls[i])
                sets.append(np.frombuffer(batch.column(3)[i].as_py(), np.uint64))
        if ids:
            yield done()
    return run


def verified_links(sets: DataFrame, similarity: float, block: int | None = None) -> DataFrame:
    """(a, b) for a table (group, cls, shingles): verified links that join all texts of a group that pairs at the bound join.

    Blocks of about ``block`` texts of a group are compared first. Where a larger group isn't joined
    by that, every two of its blocks are compared, except pairs whose texts are joined already: the
    parts of a component of more than a block meet all other texts, but not each other.
    """
    block = block or BLOCK
    # What a text takes of a block: one place, or more if it is long.
    sets = sets.withColumn("units", F.greatest(F.lit(1.0), F.length("shingles") * (block / BLOCK_BYTES)))

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = dealt.toDF("k1", "k2", "cls", "shingles").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "cls")
        with arrow_rows(dealt.sparkSession, TEXT_ROWS):
            return stored(dealt.mapInArrow(releasing(_verified(similarity)), "a long, b long"), "verified")

    sizes = sets.groupBy("group").agg(F.sum("units").alias("n"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    first = compare(sets.join(sizes, "group").select("group", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / block)), "cls", "shingles"))
    large = sizes.where(F.col("n") > block).select("group")
    if not large.head(1):
        return first
    roots = components(first)
    members = stored(sets.select("group", "cls", "units").join(large, "group", "left_semi").join(roots, F.col("cls") == roots["node"], "left")
                     .select("group", "cls", "units", F.coalesce("root", "cls").alias("comp")), "members")
    parted = members.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("group")
    members = members.join(parted, "group", "left_semi")
    comps = stored(members.groupBy("group", "comp").agg(F.sum("units").alias("size"))
                   .withColumn("part", F.when(F.col("size") > block, F.col("comp")).otherwise(-1)), "parts")
    if not comps.head(1):
        return first
    # Small components share the blocks of part -1 and stay whole, a large one has blocks of its own.
    spaces = comps.groupBy("group", "part").agg(F.ceil(F.sum("size") / block).alias("blocks"))
    own = F.when(F.col("part") == -1, F.xxhash64("comp")).otherwise(F.xxhash64("cls"))
    members = stored(members.join(comps, ["group", "comp"]).join(spaces, ["group", "part"])
                     .select("group", "part", F.pmod(own, F.col("blocks")).alias("block"), "cls"), "members")
    blocks = members.select("group", "part", "block").distinct()
    other = blocks.toDF("group", "part2", "block2")
    pairs = stored(blocks.join(other, "group").where(
        "part < part2 OR part = part2 AND part = -1 AND block <= block2").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = pairs.select("pair", "group", "part", "block").union(
        pairs.where("part <> part2 OR block <> block2").select("pair", "group", F.col("part2"), F.col("block2")))
    second = compare(members.join(sides, ["group", "part", "block"]).select("pair", "cls").join(sets.drop("units"), "cls").select("pair", F.lit(0), "cls", "shingles"))
    return first.union(second)


def _fingerprint_links(classes: DataFrame) -> DataFrame:
    """(a, b): links that join all texts whose fingerprints differ in a few bits, directly or by others."""
    distinct = stored(classes.groupBy("fp").agg(F.min("cls").alias("node")), "fingerprints")
    near = simhash.near_links(distinct)
    same = classes.join(distinct, "fp").where("cls <> node").select(F.col("cls").alias("a"), F.col("node").alias("b"))
    return same.union(near)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(digest, doc_id) keys of the documents that go, and keys that stay but occur on several rows.

    The smallest id of a group's first text stays; null ids come last. A null text counts as empty.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        prints = stored(slim.mapInArrow(releasing(_band_keys(shingle, *band_plan(similarity))), "doc_id long, digest string, bands array<long>, fp long"), "prints")
    classes = stored(prints.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
                     .withColumn("cls", F.monotonically_increasing_id()), "texts")
    # All texts of a band's cell are linked to its first, which makes them one group of candidates.
    cells = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    lowest = cells.groupBy("band", "key").agg(F.min("cls").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    banded = cells.join(lowest, ["band", "key"]).where("cls <> b").select(F.col("cls").alias("a"), "b")
    groups = components(banded.union(_fingerprint_links(classes)))
    texts = (slim.join(classes.join(groups, classes["cls"] == groups["node"]).select(
        F.col("digest").alias("same"), "low", "cls", F.col("root").alias("group")).transform(lambda x: _checked(stored(x, "groups"))),
        (F.col("digest") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("low"))).select("group", "cls", "low", "text"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        sets = stored(texts.dropDuplicates(["cls"]).mapInArrow(releasing(_shingles(shingle)), "group long, cls long, low long, shingles binary"), "shingles")
    roots = components(verified_links(sets.select("group", "cls", "shingles"), similarity))
    rooted = stored(classes.select("cls", "low").join(roots, F.col("cls") == roots["node"]).select("cls", "low", "root"), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "cls")).alias("best")).select("root", F.col("best.cls").alias("stays"))
    gone = rooted.join(first, "root").where("cls <> stays").select("cls")
    dropped = classes.join(gone, "cls", "left_semi").select("digest")
    keys = prints.groupBy("digest", "doc_id").agg(F.count("*").alias("rows")).join(classes.select("digest", "low"), "digest")
    marked = keys.join(dropped.withColumn("other", F.lit(True)), "digest", "left").withColumn(
        "goes", F.col("other").isNotNull() | ~F.col("doc_id").eqNullSafe(F.col("low")))
    marked = stored(marked.where("goes OR rows > 1").select("digest", "doc_id", "goes"), "removed")
    return marked.where("goes").select("digest", "doc_id"), marked.where("NOT goes").select("digest", "doc_id")


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a count of the rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, one of each group. Rows equal in id and text are copies like any others.

    Null and empty texts are one text; null ids come after all others; texts of any length are compared whole, long ones in
    smaller blocks; of rows equal in id and text one stays; an empty table stays empty, and columns may have any names.
    """
    gone, repeated = removed(docs, id_col, text_col, shingle, similarity)

    def match(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        keys = _checked(keys.select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id")))
        digest = F.sha2(F.coalesce(rows[text_col], F.lit("")), 256)
        return rows.join(keys, (digest == keys["__digest"]) & rows[id_col].eqNullSafe(keys["__id"]), how)

    kept = match(gone, "left_anti", docs)
    if not repeated.head(1):
        return kept
    return match(repeated, "left_anti", kept).union(match(repeated, "left_semi", kept).dropDuplicates([id_col, text_col]))
