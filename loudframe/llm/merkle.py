"""Merkle manifest of a dataset: one digest for all rows, and a proof of inclusion for each row.

Rows of a group are leaves in order; a level's nodes meet their siblings in an equijoin on computed
sibling indices, and the node in slot zero of each run emits the parent. Groups' roots are the leaves
of one more tree. Proofs are built from the roots down, so a level joins each node with one parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loudframe.llm.common import stored
from loudframe.functions.levels import int_div

#: (before, after) of each level: the digests of a node's siblings on its left and on its right.
PROOF = "array<struct<before:binary,after:binary>>"
#: Nodes up to which a level is one file of one task: it has some MB, and the levels above it still less.
SMALL = 32_768


def digest(data: Column) -> Column:
    """Lower-case hex SHA-256 of text or bytes."""
    return F.sha2(data.cast("binary"), 256)


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def field(value: Column) -> Column:
    """A value that can be told from any other when fields are put together: byte count, colon, value; null is a dash."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*(field(v) for v in values)))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """Rows with their place from 0 in their key's order; keys may be null, and rows equal in ``order`` are interchangeable.

    Rows are range-partitioned by key and order and stored with their place in the partition, so
    a key with a third of all rows is many partitions; only one row for each key and
    partition meets in a window.
    """
    # Every row's own columns end the sort, so that a task that runs again gives the same places.
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, *(c for c in df.columns if c not in {*keys, *order}))
    placed = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranged")
    starts = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), "__first",
                           F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__ahead"))
    met = F.col("__part") == F.col("__p")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.join(starts, met).select(*df.columns, (F.col("__ahead") + F.col("__at") - F.col("__first")).alias(name))


def with_siblings(nodes: DataFrame, arity: int = 2) -> DataFrame:
    """Nodes (tree, n, idx, node) of a level with the digests of their siblings ``before`` and ``after`` them, put together.

    A binary run has one sibling, at the index with the last bit flipped; wider runs are met by one
    equijoin for each slot offset. A sibling that does not exist is left out.
    """
    def other(idx: Column, name: str) -> DataFrame:
        return nodes.select(F.col("tree").alias("__tree"), idx.alias("__idx"), F.col("node").alias(name))

    none, slot = F.unhex(F.lit("")), F.col("idx") % arity
    if arity == 2:
        met = nodes.join(other(F.col("idx").bitwiseXOR(F.lit(1).cast("long")), "__s"), (F.col("tree") == F.col("__tree")) & (F.col("idx") == F.col("__idx")), "left")
        sibling = F.coalesce("__s", none)
        return met.select(*nodes.columns, F.when(slot == 1, sibling).otherwise(none).alias("before"), F.when(slot == 0, sibling).otherwise(none).alias("after"))
    met, offsets = nodes, [o for o in range(1 - arity, arity) if o]
    for o in offsets:
        # The right side is keyed by the place of the node that looks for it; a look across the run's border finds nothing.
        right = other(F.col("idx") - o, f"__s{o + arity}").withColumnsRenamed({"__tree": f"__t{o + arity}", "__idx": f"__i{o + arity}"})
        met = met.join(right, (F.col("tree") == F.col(f"__t{o + arity}")) & (F.col("idx") == F.col(f"__i{o + arity}"))
                       & (slot + o >= 0) & (slot + o < arity), "left")

    def put(side: list[int]) -> Column:
        return F.concat(*(F.coalesce(f"__s{o + arity}", none) for o in side))

    return met.select(*nodes.columns, put([o for o in offsets if o < 0]).alias("before"), put([o for o in offsets if o > 0]).alias("after"))


def _sized(level: DataFrame, nodes: int) -> DataFrame:
    return level.coalesce(1) if nodes <= SMALL else level


def levels(leaves: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees, leaves first, and the roots (tree, node, height).

    ``leaves``: (tree long, n long, idx long, node binary) and further columns, which stay on the lowest level;
    ``n`` is the number of nodes of the tree. All trees climb together, and one that has come to a
    single node is done. Each level has an ``arity``-th of the nodes of the last.
    """
    def root(level: DataFrame, height: int) -> DataFrame:
        return level.where("n = 1").select("tree", "node", F.lit(height).alias("height"))

    rows = [stored(with_siblings(leaves, arity), "level")]
    roots = root(rows[0], 0)
    most, nodes, trees = rows[0].agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*"), F.count_if(F.col("idx") == 0)).first()
    while most > 1:
        up = rows[-1].where((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
            "tree", F.ceil(F.col("n") / arity).alias("n"), int_div(F.col("idx"), arity).alias("idx"),
            F.unhex(digest(F.concat(hexed(F.col("node")), hexed(F.col("after"))))).alias("node"))
        roots = roots.union(root(up, len(rows)))
        most, nodes = -(-most // arity), -(-nodes // arity) + trees
        if most > 1:
            rows.append(stored(_sized(with_siblings(up.where("n > 1"), arity), nodes), "level"))
    return rows, roots


def proofs(rows: list[DataFrame], roots: DataFrame, arity: int = 2) -> DataFrame:
    """The lowest level with ``proof`` for every leaf; ``roots`` (tree, height, proof) says how each tree's root goes on to the top.

    Proofs grow from the roots down: a node's is its own siblings and its parent's.
    """
    below = roots.select("tree", F.lit(0).cast("long").alias("idx"), "proof", "height")
    here = below
    for i, level in reversed(list(enumerate(rows))):
        up = here.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), "proof")
        # A tree of one leaf is its own root: index 0, no siblings.
        own = F.concat(F.array(F.struct("before", "after")), "proof").cast(PROOF)
        met = level.join(up, (F.col("tree") == F.col("__tree")) & (int_div(F.col("idx"), arity) == F.col("__idx"))).withColumn(
            "proof", F.when(F.col("n") > 1, own).otherwise(F.col("proof"))).drop("__tree", "__idx")
        if not i:
            return met
        # Lower trees join further down, from their roots.
        lower = below.where(F.col("height") <= i).drop("height")
        here = met.select("tree", "idx", "proof").union(lower)
        here = stored(_sized(here, level.count()), "proofs")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf (hex) and its proof."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(hexed(s["before"]), node, hexed(s["after"]))))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return digest(F.aggregate(proof, F.lit(""), lambda all_, s: F.concat(all_, hexed(s["before"]), hexed(s["after"]))))


def manifest(entries: DataFrame, key: str, order: str, leaf: str = "leaf", arity: int = 2) -> DataFrame:
    """``entries`` with idx, subroot, root and proof.

    ``leaf`` holds each row's hex digest. Leaves of a key ascend by ``order``, then by their digest and the
    row's other columns; keys ascend as well, null first, as do null orders. Rows equal in all of them are
    leaves of their own. An empty table gives no rows. Columns may not be named like those,
    nor n, tree, node, before or after.
    """
    placed = stored(numbered(entries, [key], [order, leaf]), "leaves")
    trees = numbered(placed.groupBy(key).agg(F.count("*").alias("n")).withColumn("top", F.lit(0).cast("long")), ["top"], [key], "tree")
    trees = stored(trees.select(F.col(key).alias("__key"), "n", "tree"), "trees")
    leaves = stored(placed.join(trees, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").withColumn("node", F.unhex(leaf)), "leaves")
    rows, subroots = levels(leaves, arity)
    subroots = stored(subroots, "subroots")
    n = subroots.count()
    top, roots = levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("idx"), "node", F.col("height").alias("tall")), arity)
    root = roots.first()
    start = roots.select("tree", "height", F.array().cast(PROOF).alias("proof"))
    ends = stored(proofs(top, start, arity).select(F.col("idx").alias("tree"), F.col("tall").alias("height"), "proof", hexed(F.col("node")).alias("subroot")), "ends")
    found = proofs(rows, ends.select("tree", "height", "proof"), arity)
    return (found.join(ends.select("tree", "subroot"), "tree").withColumn("root", F.lit(root.node.hex() if root else None).cast("string"))
            .drop("n", "tree", "node", "before", "after"))


def document_manifest(docs: DataFrame, tampered: Column | None = None, arity: int = 2) -> DataFrame:
    """(doc_id, lang, idx, leaf, seen_leaf, subroot, root, proof) for every document: a leaf of doc_id, source, lang, n_chars and text.

    ``tampered`` is a condition on documents whose n_chars is seen one higher by a verifier; ``seen_leaf`` is then
    the leaf of what is seen (a null n_chars stays null). Null fields are dashes in the leaf, empty and very long
    texts are hashed whole, repeated rows are leaves of their own, null ids lie before all others, and
    further columns are ignored.
    """
    def leaf(n: Column) -> Column:
        return leaf_of(docs["doc_id"], docs["source"], docs["lang"], n, docs["text"])

    seen = F.when(tampered, leaf(docs["n_chars"] + 1)) if tampered is not None else F.lit(None).cast("string")
    entries = docs.select("doc_id", "lang", leaf(docs["n_chars"]).alias("leaf"), seen.alias("seen"))
    return manifest(entries, "lang", "doc_id", arity=arity).withColumn("seen_leaf", F.coalesce("seen", "leaf")).drop("seen")
