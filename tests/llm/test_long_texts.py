"""Long texts and repeated labelled ids: borders of segments, what is cut out, and bounds that hold."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loudframe.llm import common, decontamination, near_dedup, quality, toxicity


def plain_hits(words, items):
    """(start, end) of every window of the items in a text's words, and the words that lie in any."""
    hits, covered = set(), set()
    for item in items:
        k = min(10, len(item))
        for i in range(len(item) - k + 1):
            w = item[i:i + k]
            for s in [s for s in range(len(words) - k + 1) if words[s] == w[0] and words[s:s + k] == w]:
                hits.add((s, s + k))
                covered |= set(range(s, s + k))
    return sorted(hits), len(covered)


@pytest.fixture(scope="module")
def long_case(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [[f"b{j}x{i}" for i in range(n)] for j, n in enumerate((14, 10, 4, 1))]
    docs = []
    for n in (3000, 256, 257, 266, 511, 30):
        words = [rng.choice(vocabulary) for _ in range(n)]
        for at in (0, 250, 252, 255, 256, 500, 505, n - 12, n - 5, n - 1):
            if 0 <= at < n:
                item = rng.choice(items)
                words[at:at + len(item)] = item
        docs.append(words[:max(n, 1)])
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    return docs, items, bench


def test_windows_across_segments(spark, long_case):
    docs, items, bench = long_case
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(table, bench).collect()}
    for i, words in enumerate(docs):
        hits, covered = plain_hits(words, items)
        assert [tuple(h) for h in got[i].hits] == hits and (got[i].n_hit, got[i].n_words) == (covered, len(words)), i


def test_what_is_cut_out(spark, long_case):
    docs, items, bench = long_case
    rng = random.Random(2)
    texts = ["".join(w.upper() + rng.choice((" ", ", ", "\n")) for w in d) for d in docs] + [None, "", "no hit here"]
    got = {r.n: r.text for r in decontamination.remove_spans(
        spark.createDataFrame(list(enumerate(texts)), "n long, text string"), bench).collect()}
    for i, words in enumerate(docs):
        gone = {p for s, e in plain_hits(words, items)[0] for p in range(s, e)}
        left = [w.upper() for p, w in enumerate(words) if p not in gone]
        assert re.findall(r"\w+", got[i]) == left, i
    assert [got[len(docs) + k] for k in range(3)] == texts[-3:]


def test_work_grows_with_the_text_and_not_with_its_square(spark, long_case):
    rng = random.Random(3)

    def seconds(n):
        table = spark.createDataFrame([(1, " ".join(f"v{rng.randrange(5000)}" for _ in range(n)) + " " + " ".join(long_case[1][0]))], "doc_id long, text string")
        begin = time.time()
        row = decontamination.scan(table, long_case[2]).first()
        assert (row.n_words, row.n_hit) == (n + 14, 14)
        return time.time() - begin

    seconds(1000)
    assert seconds(320_000) < 40  # with a copy of the whole text for each window this does not end in minutes


def test_a_labelled_id_on_a_third_of_all_rows(spark):
    rows = [(i, f"good words {i} and more of them") for i in range(200)] + [(7, f"copy {i} of seven") for i in range(300)] + [(8, "the same text")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    met = docs.join(labels, "doc_id").select("doc_id", "text", "quality")
    assert common.bounded_sample(met, 50).count() == 50
    everything = common.bounded_sample(met, 10_000)
    assert everything.count() == met.distinct().count() and common.bounded_sample(met.limit(0), 5).count() == 0
    assert {tuple(r) for r in common.bounded_sample(met, 50).collect()} == {tuple(r) for r in common.bounded_sample(met.repartition(9), 50).collect()}
    assert quality.score(docs, quality.fit(docs, labels, max_labelled=40)).count() == len(rows)
    assert toxicity.score(docs, toxicity.fit(docs, labels, max_labelled=40)).count() == len(rows)


def test_long_texts_are_compared_in_smaller_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"x{rng.randrange(10 ** 6)}" for _ in range(400)]
    texts = [" ".join(base[:-1] + [f"y{i}"]) for i in range(30)] + [" ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", near_dedup.BLOCK * 8 * 4)  # each long text fills a block of its own
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()}
    assert kept == {0, *range(30, 50)}
    assert docs.where(F.col("doc_id") >= 30).count() == 20
