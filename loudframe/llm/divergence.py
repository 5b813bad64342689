"""Source divergence audit: how far the word use of each source lies from the others of its language.

In-mapper stripes: a task folds whole documents into a hash table of stripes, one for each language
and term, that hold the document frequency and the counts by source. Full tables are spilled as
rows, stripes of one term meet by key and are merged as a stream, and blocks of merged stripes emit
the divergences. Texts never move, and a term moves once for each spilled table, however frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loudframe.llm.common import stored

#: A term is kept if so many documents of its language have it; occurrences are smoothed by PRIOR.
LEAST_DOCUMENTS, PRIOR, SCALE = 30, 5, 1_000_000_000
#: Terms of the report for each group.
TOP_TERMS = 50
#: A table of stripes is spilled at so many stripe entries or bytes of terms.
TABLE_ENTRIES, TABLE_BYTES = 250_000, 32 << 20
#: Bytes of a text that are cut into words at a time.
PIECE_BYTES = 1 << 20
#: Cells, terms by sources, of a block of merged stripes.
BLOCK_CELLS = 1 << 20

#: Letters keep their byte, A-Z in small letters, as do the bytes of all characters above DEL; the rest parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
STRIPE = "lang string, term binary, df long, sources array<string>, counts array<long>"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, cut where a term ends after each ``PIECE_BYTES``."""
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE_BYTES)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


class Stripes:
    """The hash table of one task. The stripe of term None marks which sources a language has."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.langs, self.entries, self.bytes = {}, 0, 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        table = self.langs.setdefault(lang, {})
        words = Counter()
        for piece in _pieces(text.translate(_FOLD)):
            words.update(piece)
        words[None] = 0
        for term, n in words.items():
            stripe = table.get(term)
            if stripe is None:
                table[term] = [1, {source: n}]
                self.entries += 1
                self.bytes += len(term or b"")
            else:
                stripe[0] += 1
                counts = stripe[1]
                if source in counts:
                    counts[source] += n
                else:
                    counts[source] = n
                    self.entries += 1

    def full(self) -> bool:
        return self.entries >= TABLE_ENTRIES or self.bytes >= TABLE_BYTES

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, table in self.langs.items():
            terms = list(table)
            for lo in range(0, len(terms), 50_000):
                part = [table[t] for t in terms[lo:lo + 50_000]]
                yield _stripe_batch(
                    pa.array([lang] * len(part), pa.string()), pa.array(terms[lo:lo + 50_000], pa.binary()), pa.array([s[0] for s in part], pa.int64()),
                    np.cumsum([0] + [len(s[1]) for s in part]), pa.array([k for s in part for k in s[1]], pa.string()),
                    pa.array([n for s in part for n in s[1].values()], pa.int64()))
        self.clear()


def _stripe_batch(lang, term, df, offsets, sources, counts) -> pa.RecordBatch:
    at = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays([lang, term, df, pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, counts)],
                                      names=["lang", "term", "df", "sources", "counts"])


def _plain(column: pa.Array, kind: pa.DataType, fill) -> pa.Array:
    return pc.fill_null(column.cast(kind), fill)


def fold(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Spilled stripes of whole documents: (lang, term, df, sources, counts); several for a term, one for each spilled table.

    A table is spilled between documents, so a document's terms, however long it is, are counted once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            texts = _plain(batch.column(2), pa.large_string(), "").cast(pa.large_binary())
            langs, sources = (_plain(batch.column(i), pa.string(), "").to_pylist() for i in (0, 1))
            for i in range(batch.num_rows):
                stripes.add(langs[i], sources[i], texts[i].as_py())
                if stripes.full():
                    yield from stripes.spill()
        yield from stripes.spill()

    return docs.select(*(docs[c].cast("string") for c in (lang, source, text))).mapInArrow(run, STRIPE)


def _merged(batch: pa.Table) -> pa.RecordBatch:
    """One stripe for each language and term of a batch that is sorted by them."""
    keys = [batch.column(i).combine_chunks() for i in (0, 1)]
    new = np.ones(batch.num_rows, bool)
    same = pc.and_(pc.equal(keys[0][1:], keys[0][:-1]),
                   pc.or_(pc.fill_null(pc.equal(keys[1][1:], keys[1][:-1]), False), pc.and_(pc.is_null(keys[1][1:]), pc.is_null(keys[1][:-1]))))
    new[1:] = ~same.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    lists = batch.column(3).combine_chunks()
    flat, sizes = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
    counts = batch.column(4).combine_chunks().flatten().to_numpy()
    # Entries by stripe and source; a source's place in the dictionary stands for its name.
    width = max(1, len(flat.dictionary))
    entry = np.repeat(np.cumsum(new) - 1, sizes) * width + flat.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    starts = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], starts) if len(entry) else counts
    stripe, which = np.divmod(entry[starts], width)
    return _stripe_batch(
        keys[0].take(first), keys[1].take(first), pa.array(np.add.reduceat(batch.column(2).to_numpy(), first)),
        np.searchsorted(stripe, np.arange(len(first) + 1)), flat.dictionary.take(pa.array(which)), pa.array(total))


def merge(stripes: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One stripe for each language and term: those that ``least`` documents have, and those of the marks (term null).

    Stripes of a term lie together after one shuffle and a sort, and are merged batch by batch; only
    the stripe that is open at the end of a batch is carried on, so memory holds a batch and a stripe.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.RecordBatch) -> pa.RecordBatch:
            return part.filter(pc.or_(pc.is_null(part.column(1)), pc.greater_equal(part.column(2), least)))

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            part = _merged(whole if rest is None else pa.concat_tables([pa.Table.from_batches([rest]).cast(whole.schema), whole]))
            rest = part.slice(part.num_rows - 1)
            yield done(part.slice(0, part.num_rows - 1))
        if rest is not None:
            yield done(rest)

    return stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, STRIPE)


def _shares(counts: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / (total + PRIOR * v)), exactly, for totals below 9e15.

    The quotient is found by three digits to the base 1000, since the product may need more than 63 bits.
    """
    below = total + PRIOR * v
    whole, rest = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Divergences within a block of merged stripes: partial sums of pairs and the block's own best terms."""
    sources = right.column("source").combine_chunks()
    by_name = pc.sort_indices(sources.cast(pa.binary()))
    sources, totals = sources.take(by_name), right.column("n").combine_chunks().take(by_name).to_numpy()
    lang, v, s = right.column("lang")[0], right.column("v")[0].as_py(), len(sources)
    left = left.take(pc.sort_indices(left.column("term").combine_chunks()))
    lists = left.column("sources").combine_chunks()
    where = pc.index_in(lists.flatten(), value_set=sources).to_numpy()
    row = np.repeat(np.arange(left.num_rows), np.diff(lists.offsets.to_numpy()))
    counts = np.zeros((left.num_rows, s), np.int64)
    counts[row, where] = left.column("counts").combine_chunks().flatten().to_numpy()
    p = _shares(counts, totals, v)
    q = _shares(counts.sum(1), np.int64(totals.sum()), v)
    out = []

    def put(part: str, group: np.ndarray, items: pa.Array, value: np.ndarray) -> None:
        out.append(pa.table({"lang": pa.array([lang.as_py()] * len(value), pa.string()), "source": sources.take(pa.array(group)),
                             "part": pa.array([part] * len(value), pa.string()), "item": items, "value": pa.array(value, pa.int64())}))

    names = left.column("term").combine_chunks().cast(pa.string())
    for a in range(s):
        apart = np.abs(p - p[:, a:a + 1]).sum(0)
        others = np.flatnonzero(np.arange(s) != a)
        put("pair", np.full(s - 1, a), sources.take(pa.array(others)), apart[others])
        over = np.where((counts[:, a] > 0) & (p[:, a] > q), p[:, a] - q, 0)
        # Terms ascend, and the sort is stable: ties keep their order. No term outside a block's best can be among the best of all.
        best = np.argsort(-over, kind="stable")[:TOP_TERMS]
        best = best[over[best] > 0]
        put("term", np.full(len(best), a), names.take(pa.array(best)), over[best])
    return pa.concat_tables(out)


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language, all in whole numbers.

    Part ``pair`` has each other source of the language and the summed difference of their term
    shares; part ``term`` the ``TOP_TERMS`` terms that a source uses more than its language does.

    A null text, language or source counts as the empty one; a text without terms still makes its
    group occur; a text of any length is counted once in the document frequencies, and memory grows with
    its distinct terms; repeated rows and ids count as often as they occur; ties in value are ordered by
    the item's bytes; an empty table gives no rows, a language without kept terms its pairs with value 0;
    further columns, whatever their names, are ignored.
    """
    merged = stored(merge(fold(docs, text, lang, source), least), "stripes")
    marks = merged.where("term IS NULL").select("lang", F.explode("sources").alias("source"))
    kept = merged.where("term IS NOT NULL")
    summed = (kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
              .groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n")))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    # One row for each group, whole numbers, as many as the report has groups.
    groups = stored(marks.join(summed, ["lang", "source"], "left").join(vocabulary, "lang", "left")
                    .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "groups")
    sized = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("s"))
    blocks = sized.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("s") / BLOCK_CELLS)).cast("int").alias("blocks"))
    cut = kept.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    spread = groups.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Both sides come from the same tables; new names of columns tell them apart.
    spread = spread.select(*(F.col(c).alias(c) for c in ("lang", "source", "n", "v", "block")))
    found = cut.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(
        _block, "lang string, source string, part string, item string, value long")
    summed = stored(found, "divergences")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = summed.where("part = 'term'")
    return pairs.withColumn("rank", F.row_number().over(by)).union(
        terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP_TERMS))
