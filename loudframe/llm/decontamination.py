"""Removal of benchmark passages: windows of benchmark words, looked up in every text.

The windows' hashes and words form a table that is broadcast while its counted size allows it and
shuffled beyond that. A text is cut into words once, its windows are hashed in place, and only
windows whose hash is in the table and whose words are really equal leave the scan. All of it is
column expressions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loudframe.llm.common import lower_ascii

#: Everything but digits, small letters and characters outside ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of a text that are looked up from one piece of it.
SEGMENT = 256
#: Windows up to which the table is broadcast; at about 150 bytes each it stays below 150 MB.
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _windows(words: Column, length: int) -> Column:
    """How many windows of ``length`` words begin in a segment; its words go on for as long as the last of them needs."""
    return F.least(F.greatest(F.size(words) - length + 1, F.lit(0)), F.lit(SEGMENT))


def _hashes(hashes: Column, length: int) -> Column:
    """Hash of every window of ``length`` words that begins in a segment, in order, from the words' hashes."""
    n = F.size(hashes)
    one = F.transform(F.sequence(F.lit(0), F.least(n - length, F.lit(SEGMENT - 1))), lambda i: F.xxhash64(
        F.lit(length), *(F.get(hashes, i + k) for k in range(length))))
    return F.when(n >= length, one).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w_hash, w_text, w_length, items): each distinct window of the items with the sorted ids of the items that have it.

    An item of fewer words than the window, but not none, is one window. Items without an id are
    looked for like others; their id is left out of ``items``.
    """
    items = (benchmark.select(benchmark[id_col].cast("string").alias("item"), words_of(benchmark[text_col]).alias("words"))
             .where(F.size("words") > 0)
             .withColumn("length", F.least(F.size("words"), F.lit(window))))
    cut = items.select("item", "length", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("length") + 1),
        lambda i: F.slice("words", i, F.col("length")))).alias("w"))
    return (cut.groupBy("length", "w").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select(F.array_join("w", " ").alias("w_text"), F.col("length").alias("w_length"), "items",
                    F.transform("w", lambda x: F.xxhash64(x)).alias("hashes")))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",),
         text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: the ``keep`` columns, n_words, n_hit, hits, items.

    ``hits`` are the occurring windows as (start, end) word positions, sorted; ``n_hit`` counts the
    words that lie in any of them; ``items`` are the sorted ids of the items they come from. A null
    text has no words; texts of any length are scanned whole, in segments; repeated rows and null ids stay rows of
    their own; an empty table gives no rows and an empty benchmark no hits; other columns are ignored.
    """
    lengths = benchmark_windows(benchmark, window, item_col, item_text)
    sizes = {r[0]: r[1] for r in lengths.groupBy("w_length").count().collect()}  # at most ``window`` rows
    table = lengths.select("w_text", "w_length", "items", reduce(
        lambda rest, k: F.when(F.col("w_length") == k, F.xxhash64(F.lit(k), *(F.get("hashes", F.lit(i)) for i in range(k)))).otherwise(rest),
        sizes, F.lit(None).cast("long")).alias("w_hash"))
    if sum(sizes.values()) <= broadcast_windows:
        table = F.broadcast(table)
    lengths = sorted(sizes)

    cut = (docs.select(*(docs[c].alias(f"__{c}") for c in keep), words_of(docs[text_col]).alias("words"))
           .withColumn("row", F.monotonically_increasing_id()))
    # A window's row carries the words of its segment, not those of the document: work stays in proportion to the text.
    longest = max(lengths, default=1)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(SEGMENT)), lambda i: F.struct(
        i.alias("base"), F.slice("words", i + 1, SEGMENT + longest - 1).alias("words")))
    parted = cut.select(*(f"__{c}" for c in keep), "row", F.size("words").alias("n"), F.explode(parts).alias("part"))
    hashed = parted.select(*(f"__{c}" for c in keep), "row", "n", "part.base", "part.words").withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # The first element stands for the document itself, so that one without a hit has a row as well.
    every = F.concat(F.array(F.lit(None).cast("long")), *(_hashes(F.col("hashes"), k) for k in lengths))
    flat = hashed.select(*(f"__{c}" for c in keep), "row", "base", "words", "n", F.posexplode(every).alias("at", "hash"))
    start, length, ahead = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in lengths:
        here = (F.col("at") >= ahead) & (F.col("at") < ahead + _windows(F.col("words"), k))
        start, length = F.when(here, F.col("at") - ahead).otherwise(start), F.when(here, F.lit(k)).otherwise(length)
        ahead = ahead + _windows(F.col("words"), k)
    equal = (F.col("hash") == F.col("w_hash")) & (F.col("length") == F.col("w_length")) & (
        F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ") == F.col("w_text"))
    met = (flat.withColumns({"start": start, "length": length}).join(table, equal, "left")
           .where("at = 0 AND base = 0 OR w_text IS NOT NULL"))
    first = F.col("base") + F.col("start")
    hit = F.when(F.col("w_text").isNotNull(), F.struct(first.alias("start"), (first + F.col("length")).alias("end"), "items"))
    grouped = (met.select(*(f"__{c}" for c in keep), "row", "n", hit.alias("hit"))
               .groupBy("row").agg(*(F.first(f"__{c}").alias(f"__{c}") for c in keep), F.first("n").alias("n"),
                                   F.array_sort(F.collect_list("hit")).alias("found")))
    covered = F.aggregate("found", F.struct(F.lit(0).alias("words"), F.lit(0).alias("to")), lambda a, h: F.struct(
        (a["words"] + F.greatest(h["end"] - F.greatest(h["start"], a["to"]), F.lit(0))).alias("words"),
        F.greatest(h["end"], a["to"]).alias("to")))["words"]
    return grouped.select(
        *(F.col(f"__{c}").alias(c) for c in keep), F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
        F.transform("found", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda h: h["items"])))).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, all columns and repeated rows kept.

    Whether a document goes depends on its text alone, so the scan moves digests instead of texts:
    the digests of contaminated texts are few, are written once and taken out with an anti join.
    """
    return _without(docs, contaminated_texts(docs, benchmark, **options))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(text_digest, hits) of each distinct text that holds a benchmark window."""
    from loudframe.llm.common import stored

    text_col = options.get("text_col", "text")
    slim = docs.select(docs[text_col].alias("text"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("text_digest"))
    found = scan(slim, benchmark, **(options | {"keep": ("text_digest",), "text_col": "text"})).where("n_hit > 0")
    return stored(found.groupBy("text_digest").agg(F.first("hits").alias("hits")), "contaminated")


def _without(docs: DataFrame, found: DataFrame, text_col: str = "text", broadcast_texts: int = BROADCAST_WINDOWS) -> DataFrame:
    gone = found.select(F.col("text_digest").alias("__digest"))
    if found.count() <= broadcast_texts:
        gone = F.broadcast(gone)
    return docs.join(gone, F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["__digest"], "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, broadcast_texts: int = BROADCAST_WINDOWS, **options) -> DataFrame:
    """The documents with the words inside benchmark windows cut out, together with the separators before them."""
    text_col = options.get("text_col", "text")
    found = contaminated_texts(docs, benchmark, **options).select(F.col("text_digest").alias("__digest"), F.col("hits").alias("__hits"))
    if found.count() <= broadcast_texts:
        found = F.broadcast(found)
    text = F.coalesce(docs[text_col], F.lit(""))
    met = docs.join(found, F.sha2(text, 256) == found["__digest"], "left")
    # Words as written, each with the separators before it; lower-casing A-Z moves no border.
    separator, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{separator}*{word}+"), F.lit(0))
    tail = F.regexp_extract(F.col(text_col), f"({separator}*)$", 1)
    left = F.filter(F.transform(pieces, lambda p, i: F.when(~F.exists("__hits", lambda h: (h["start"] <= i) & (i < h["end"])), p)),
                    lambda p: p.isNotNull())
    cleaned = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(left, ""), tail))
    return met.select(*(cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns))
