"""Corpus operators against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loudframe.llm import chat, components, decontamination, embeddings, lm, near_dedup, packing, quality, sharding, simhash, toxicity, warc
from loudframe.llm.queries import tokenizer_path
from loudframe.session import fresh_path

DOCS = "doc_id long, text string, score double, label string, row string"
WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz école über naïve".split()


def texts(n=60, seed=1):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    out += [None, "", " \n\t", "A B", out[0], out[0], "LONG " * 3000, "Don't <|endoftext|> Σx 12%", "a\x0bb"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 13 else None, t, 1.0, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], rows[len(rows) - 9]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


# --- sharding ------------------------------------------------------------------------------


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).select("id", sharding.place_of(F.col("id"), n, 5).alias("p"))
        df = df.withColumn("back", sharding.row_at(F.col("p") % 4, ((F.col("p") - F.col("p") % 4) / 4).cast("long"), n, 4, 5))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards(spark, docs, empty):
    rows = sharding.shard_assignment(docs, 8).collect()
    given = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == given
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard_assignment(docs.repartition(5), 8)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    assert sharding.shard_assignment(empty).count() == 0
    assert sharding.shard_rows(docs, 4).count() == docs.count()


# --- decontamination -----------------------------------------------------------------------


def brute_hits(text, items, window=10):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(own) - k + 1):
                if own[j:j + k] == w[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(own), len(hit), found


def test_decontamination(spark, docs, empty):
    given = docs.collect()
    some = [r.text for r in given if r.text and len(words(r.text)) > 20][:3]
    items = [(1, " ".join(words(some[0])[3:18])), (2, "Gh ij"), (10, " ".join(words(some[1])[:10])), (11, " ".join(words(some[1])[:10])), (3, None), (4, "  ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        rows = decontamination.scan(docs, bench, keep=("doc_id", "text"), broadcast_windows=limit).collect()
        assert len(rows) == len(given)
        for r in rows:
            n, hit, found = brute_hits(r.text, items)
            assert (r.n_words, r.n_hit, set(r.items)) == (n, hit, {str(x) for x in found})
            assert list(r["items"]) == sorted(r["items"])
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(brute_hits(r.text, items)[1] == 0 for r in given)
    cleaned = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).where("doc_id IS NOT NULL").collect()}
    for r in given:
        if r.doc_id is not None and not brute_hits(r.text, items)[1]:
            assert cleaned[r.doc_id] == r.text
    assert decontamination.scan(empty, bench).count() == 0
    assert decontamination.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# --- SimHash and near duplicates -------------------------------------------------------------


def fingerprint(text, k=3):
    w = words(text)
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the deep wood ".split() * 6
    more = [(1000 + i, " ".join(base[:60 + i % 2] + [f"w{i}"]), 0.0, "", "") for i in range(8)]
    table = docs.union(spark.createDataFrame(more, DOCS))
    given = [(r.doc_id, fingerprint(r.text)) for r in table.collect()]
    group = list(range(len(given)))
    for _ in given:
        for i, (_, a) in enumerate(given):
            for j, (_, b) in enumerate(given):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min((d for (d, _), x in zip(given, group) if x == g and d is not None), default=None) for g in group}
    want = Counter((d, f"{fp:016x}", low[g]) for (d, fp), g in zip(given, group))
    assert Counter(map(tuple, simhash.near_duplicates(table).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in fps[:60] for k in (1, 2, 3, 4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.group_by_fingerprint(table).collect()}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(fps))}


def test_near_duplicates_are_dropped(spark, docs, empty):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copies = [(2000 + i, " ".join(base[:i * 20] + ["other"] + base[i * 20 + 1:]), 0.0, "", "") for i in range(1, 9)]
    far = [(3000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(100)), 0.0, "", "") for i in range(10)]
    table = docs.union(spark.createDataFrame([(1999, " ".join(base), 0.0, "", ""), *copies, *far], DOCS))
    kept = near_dedup.drop_near_duplicates(table)
    rows = kept.collect()
    assert kept.columns == table.columns
    assert [r.doc_id for r in rows if r.doc_id and 1999 <= r.doc_id < 3000] == [1999]
    assert {r.doc_id for r in rows if r.doc_id and r.doc_id >= 3000} == {3000 + i for i in range(10)}
    real = Counter(" ".join(words(r.text)) for r in rows)
    assert max(real.values()) == 1 and set(real) >= {" ".join(words(r.text)) for r in docs.collect() if len(words(r.text)) < 8}
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_pairs_with_one_inserted_passage_are_found(spark):
    rng, rows = random.Random(9), []
    for i in range(300):
        # Half of the texts have few different words.
        own = [f"{i}w{k}" for k in range(24)] if i % 2 else None
        base = [rng.choice(own) if own else f"w{rng.randrange(10**6)}" for _ in range(400)]
        at, n = rng.randrange(401), rng.randrange(60, 92)
        rows += [(2 * i, base), (2 * i + 1, base[:at] + [f"{i}n{k}" for k in range(n)] + base[at:])]
    sets = {i: {tuple(t[k:k + 5]) for k in range(len(t) - 4)} for i, t in rows}
    near = [i for i in range(0, 600, 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.87]
    assert len(near) > 250
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert kept >= set(range(0, 600, 2))
    assert sum(i + 1 not in kept for i in near) >= len(near) - 2


def test_large_groups_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{i}" for i in range(1000)]
    # Copies are near to one text (0.91), not to each other (0.83); that text isn't the first.
    rows = [(i, " ".join(base[:45 * i] + [f"n{i}x{k}" for k in range(45)] + base[45 * i + 45:])) for i in range(20)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame([*rows, (50, " ".join(base))], "doc_id long, text string"), similarity=0.9).collect()
    assert [r.doc_id for r in kept] == [0]
    # One true pair, and one component larger than a block with a single link to another text, among 100 candidates.
    sets = {i: {1000 * i + k for k in range(20)} for i in range(100)}
    sets[97] = set(list(sorted(sets[3]))[:19]) | {5}
    for i in range(10, 20):
        sets[i] = set(range(10_000, 10_040)) | {1000 * i + 500}
    sets[80] = set(range(10_000, 10_040)) - set(range(10_000, 10_004)) | {10_500, 80_000}
    given = [(0, i, np.sort(np.array(list(x), np.uint64)).tobytes()) for i, x in sets.items()]
    table = spark.createDataFrame(given, "group long, cls long, shingles binary")
    near = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.node: r.root for r in components.components(near_dedup.verified_links(table, 0.8, 6)).collect()}
    assert {i: got.get(i, i) for i in sets} == label and label[97] == 3 and label[80] == 10


def test_components_and_forest(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (100, 105)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}
    a, b = components.local_forest(np.arange(50), np.arange(1, 51))
    assert (b == 0).all() and len(a) == 50


# --- embeddings ------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = base[:20] + rng.normal(size=(20, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, base[:2], base[:1] * 3]).astype(np.float32))]
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 0.0]), (907, [1.0, 0.1])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(5))
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    for margin in (0.15, None):
        got = {r.vec_id: r for r in embeddings.near_duplicates(table, margin=margin).collect()}
        assert len(got) == len(rows) + len(bad)
        assert [got[i].n_links for i in range(len(rows))] == (link.sum(axis=1) - 1).tolist()
        for i in range(len(rows)):
            assert got[i].component_id <= np.flatnonzero(link[i])[0] and got[i].kept == (got[i].component_id == i)
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
        assert got[907].component_id == 906
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


# --- classifiers -----------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 40))]
        toxic, junk = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty!", "Foulish"])
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(None, None), (9001, ""), (9001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0 OR doc_id IS NULL"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    assert np.mean([(r.predicted == 1) == (r.doc_id % 5 == 0) for r in held]) > 0.95
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in held:
        assert all(re.match("vile|nasty|foulish", text[r.doc_id][s.start:s.end].lower()) for s in r.spans)
    assert toxicity.drop_toxic(docs, model).count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 403
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_one_long_document_does_not_fill_the_fit_of_the_field(spark):
    docs, labels = labelled(spark)
    first = spark.createDataFrame([(6001, "vile nice plain word " * 25_000)], "doc_id long, text string")
    docs = first.union(docs).coalesce(1)
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(6001, 1, 0)], labels.schema)))
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert np.mean([len(r.spans) > 0 for r in rows]) > 0.9


def test_marginals_equal_those_of_the_whole_sequence():
    rng = np.random.default_rng(4)
    field = {"theta": np.append(rng.normal(size=3) * 2, 0.0), "bias": -1.0, "trans": rng.normal(size=(2, 2))}
    table = np.array([[3, 3, 3], [0, 3, 3], [1, 2, 3], [3, 3, 3]])
    codes, borders = rng.integers(0, 4, 60), np.array([0, 0, 20, 21, 60])
    doc, at, m = toxicity._marginals(field, table, codes, borders)
    t = np.exp(field["trans"])
    for d in range(4):
        own = codes[borders[d]:borders[d + 1]]
        pot = [np.array([1, np.exp(field["bias"] + field["theta"][table[c]].sum())]) for c in own]
        for i, p in zip(at[doc == d] - borders[d], m[doc == d]):
            f = pot[0]
            for k in range(1, i + 1):
                f = (f @ t) * pot[k]
            b = np.ones(2)
            for k in range(len(own) - 1, i, -1):
                b = t @ (pot[k] * b)
            assert p == pytest.approx((f * b)[1] / (f * b).sum(), rel=1e-9)


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0 OR doc_id IS NULL"))
    scored = quality.score(docs.withColumn("score", F.lit("old")), model)
    rows = scored.collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    assert np.mean([(r.predicted == 1) == (r.doc_id % 4 != 1) for r in held]) > 0.95
    assert quality.keep_good(docs, model).count() == sum(r.predicted for r in rows)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


# --- language model --------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    counts = lm.token_counts(docs)
    rows = lm.score(docs, counts, lm.fit(docs, counts, rounds=2), columns=("doc_id", "text")).collect()
    c = Counter(t for r in docs.collect() for t in [*words(r.text), ""])
    n, v = sum(c.values()), len(c)
    assert {r.token: r.c for r in counts.collect()} == c and len(rows) == docs.count()
    for r in rows:
        own = [*words(r.text), ""]
        assert (r.n_tokens, r.n_known) == (len(own), len(own))
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score(empty, counts, lm.fit(docs, counts, rounds=1)).count() == 0
    none = lm.token_counts(empty)
    assert lm.score(docs, none, lm.fit(empty, none)).count() == docs.count()


def test_all_documents_train_and_copies_spread_over_rounds(spark):
    docs = spark.createDataFrame([("one text",)] * 600 + [(f"text {i}",) for i in range(300)], "text string").repartition(3)
    dealt = lm.dealt_to_rounds(docs, 6).collect()
    copies = Counter(r["round"] for r in dealt if r.text == "one text")
    assert len(dealt) == 900 and len({r.place for r in dealt}) == 900
    assert set(copies) == set(range(6)) and max(copies.values()) < 150


def test_probabilities_of_all_words_add_up_and_gradients_are_right():
    head = [("", 50, 0), ("a", 40, 1), ("b", 30, 2), ("c", 5, 3)]
    vocabulary = lm.Vocabulary(head, 200, {k: (100, 4) for k in range(lm.OPEN)})
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.05, v.shape) for k, v in lm._start(1, vocabulary).items()}
    every = np.append(np.arange(4), lm.CLASS_SIZE * lm.CLASSES + np.arange(lm.OPEN))
    h = np.repeat(rng.normal(size=(1, lm.HIDDEN)), len(every), axis=0)
    out, _ = lm._outputs(p, h, every)
    unused = 1 - np.exp(out).sum()  # classes without a word
    assert -1e-9 < unused < 0.2
    grads = {}
    _, back = lm._outputs(p, h, every, grads)
    for k, at in (("wc", (3, 1)), ("ww", (0, 2, 1)), ("bw", (0, 1))):
        moved = {**p, k: p[k].copy()}
        moved[k][at] += 1e-6
        assert (lm._outputs(moved, h, every)[0].sum() - out.sum()) / 1e-6 == pytest.approx(-grads[k][at], rel=1e-3, abs=1e-5)
    # States are carried: scoring two texts side by side equals scoring each alone.
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    numbers = rng.choice(every, 50)
    both = lm._score(p32, np.array([20, 30]), numbers)
    assert both[1] == pytest.approx(lm._score(p32, np.array([30]), numbers[20:])[0], rel=1e-4)


# --- packing ---------------------------------------------------------------------------------


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(docs, tokenizer_path(), window=256, shard_tokens=2000, task_tokens=4000).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids), sum(ids))] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter((d, n) for d, n, _ in want.elements())
    assert sum(r.length for r in rows) == sum(n for _, n, _ in want.elements())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 256
        short += at < 256
    assert short <= -(-sum(n for _, n, _ in want.elements()) // 4000)  # one for each task
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_token_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    tokens, own = packing.Tokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    given = [t or "" for t in texts(200, 9)] + ["É'S we'll x''s ...a,!b 3.14", "\x01\x00 x", "ﬁ ×÷ ª", "naïvé"]
    array = pa.array(["skip", *given, None]).slice(1)
    for text, ids in zip([*given, ""], tokens.encode(array), strict=True):
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids
    vocab = own.get_vocab()
    for token, number in list(vocab.items())[::37]:
        if token.endswith("</w>"):
            assert [t.id for t in own.model.tokenize(token[:-4])] == [number]


def test_windows_hold_neighbours_of_their_own_seed():
    rng = np.random.default_rng(11)
    given = []
    for i in range(300):  # 20 subjects with words of their own besides common ones
        own, common = 100 + 50 * (i % 20) + rng.integers(0, 50, 40), 5000 + rng.integers(0, 30, 20)
        given.append((i, np.append(np.append(own, common), packing.END_ID).astype(np.uint16)))
    words = [Counter(int(x) for x in ids[:-1]) for _, ids in given]
    df = Counter(w for c in words for w in c)
    mean = sum(sum(c.values()) for c in words) / len(words)

    def bm25(q, d):
        norm = packing.K1 * (1 - packing.B + packing.B * sum(words[d].values()) / mean)
        return sum(math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * words[d][w] * (packing.K1 + 1) / (words[d][w] + norm) for w in words[q] if w in words[d])

    windows = {}
    for doc_id, *_, sequence, _ in packing.pack(iter(given), 256, 10**9):
        windows.setdefault(sequence, []).append(doc_id)
    used = set()
    for sequence in sorted(windows):
        seed, *rest = windows[sequence]
        used.add(seed)
        for d in rest:
            best = max((bm25(seed, x) for x in range(len(given)) if x not in used), default=0)
            assert bm25(seed, d) == pytest.approx(best, rel=1e-4)
            used.add(d)
    assert len(used) == len(given)


def test_pieces_hold_their_ids():
    rng = np.random.default_rng(2)
    given = [(i, rng.integers(0, 300, n).astype(np.uint16)) for i, n in enumerate(rng.integers(1, 700, 80))]
    out = list(packing.pack(iter(given), 256, 5000))
    for d, start, length, crc, total, _, _ in out:
        assert crc == zlib.crc32(given[d][1][start:start + length].astype("<u4").tobytes()) and total == len(given[d][1])
    for d, ids in given:
        pieces = sorted((s, n) for i, s, n, *_ in out if i == d)
        assert [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) == len(ids)


# --- archives --------------------------------------------------------------------------------


def test_archives(spark):
    big, wide = "<p>" + "x" * 1200, "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/ü\r\nX: y", big), (5, None, big), (3, "u", wide), (4, "u", wide), (6, "u", "small"), (7, "u", "small"),
            (8, "u", None), (None, "u", big), (9, "u", "HTTP\r\n\r\nContent-Length: 5\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    for limit in (10**6, 0):
        folder, twin = fresh_path(spark, "warc"), fresh_path(spark, "warc")
        files = warc.write_archives(warc.record_plan(pages, broadcast_payloads=limit), folder, shards=2, file_bytes=500).collect()
        again = warc.write_archives(warc.record_plan(pages.repartition(4)), twin, shards=2, file_bytes=500).collect()
        assert sorted(map(tuple, files)) == sorted(map(tuple, again)) and len(files) > 2
        got = warc.read_archives(spark, folder).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r for r in got}
        for page, _, html in rows:
            raw = (html or "").encode()
            assert (by[page].payload_bytes, by[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            if by[page].record_type == "response":
                assert bytes(by[page].payload) == raw
        assert {p: r.refers_to for p, r in by.items() if r.record_type == "revisit"} == {1: 5, 2: 5, 3: 4}
    folder = fresh_path(spark, "warc")
    assert warc.write_archives(warc.record_plan(pages.limit(0)), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


# --- chat ------------------------------------------------------------------------------------


def test_chat(spark):
    tricky = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", tricky), (1, 2, "assistant", "é\\</turn>\n### User: x"), (2, 1, "assistant", None), (2, 0, "user", ""),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, "to:ol\n#", "x\\"), (None, 5, None, "z"), (5, 0, "user", "####</turn></turn"), (5, 1, "assistant", "<" * 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_segments(chat.ordered(table))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: False, 5: True}
    assert chat.read_back(chat.format_segments(chat.ordered(table.limit(0)))).count() == 0
