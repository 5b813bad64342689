"""Source divergences, sentence pieces and Merkle manifests against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loudframe.llm import divergence, merkle, pieces
from loudframe.llm.queries import piece_path

# --- source divergences -----------------------------------------------------------------------


def audited(rows, least):
    """The contract of the audit, word for word, over (lang, source, text)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate({i: i + 32 for i in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = {s: counts[lang, s] for g, s in groups if g == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, whole = shares(mine[source]), shares(sum(mine.values(), Counter()))
        pairs = [(sum(abs(p[t] - q[t]) for t in kept), s) for s, q in ((s, shares(c)) for s, c in mine.items()) if s != source]
        terms = [(p[t] - whole[t], t) for t in kept if mine[source][t] > 0 and p[t] > whole[t]]
        for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, 50)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered[:top])}
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [rng.choice(("ab", "Été", "ßa", "X", "日本", "q")) + chr(97 + i % 26) + chr(97 + i // 26) for i in range(120)]
    rows = []
    for i in range(220):
        lang, source = rng.choice(("en", "en", "de", None, "")), rng.choice(("s0", "s0", "s0", "s1", "é2", None))
        at = rng.randrange(60)
        rows.append((lang, source, rng.choice((" ", "-", "9", "\x00")).join(rng.choice(vocabulary[at:at + 60]) for _ in range(rng.randrange(40)))))
    rows += [("fr", "only", "a b c"), ("xx", "none", None), ("xx", "blank", " 1 2 "), ("en", "s1", "LONG word-" * 40000), rows[5], rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(corpus())], "doc_id long, lang string, source string, text string, df string, block int").repartition(5)


def test_divergences_match_the_contract(docs):
    found = divergence.divergences(docs, least=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    want = audited(corpus(), 4)
    assert len(got) == len(set(got)) and set(got) == want and {p for _, _, p, *_ in want} == {"pair", "term"}


def test_small_tables_blocks_and_pieces_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE_ENTRIES", 7)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 11)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 20)
    assert {tuple(r) for r in divergence.divergences(docs, least=4).collect()} == audited(corpus(), 4)


def test_no_term_is_kept_and_no_row(spark, docs):
    rows = divergence.divergences(docs, least=10 ** 6).collect()
    assert rows and {r.value for r in rows} == {0} and {r.part for r in rows} == {"pair"}
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_a_term_moves_once_for_each_table_and_texts_never(spark):
    rows = spark.createDataFrame([("en", f"s{i % 3}", "same words again " * 50) for i in range(400)], "lang string, source string, text string").repartition(4)
    stripes = divergence.fold(rows).collect()
    assert len(stripes) == 4 * 4  # three terms and the mark, for each of four tasks
    assert sum(r.df for r in stripes if r.term == b"same") == 400


def test_shares_are_exact_beyond_63_bits():
    counts, total = np.array([0, 7, 10 ** 13, 3 * 10 ** 14]), np.int64(4 * 10 ** 14)
    got = divergence._shares(counts, total, 12345)
    assert got.tolist() == [1 + 1000000000 * (int(c) + 5) // (int(total) + 5 * 12345) for c in counts]


# --- sentence pieces --------------------------------------------------------------------------


def wire(number, value):
    def var(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    return var(number << 3) + var(value) if isinstance(value, int) else var(number << 3 | 2) + var(len(value)) + value


STRANGE = ["", " ", "a", "  a  b ", "Héllo  wörld 𝔘x\n\t a ", "▁▁ ▁x", "ｶﾞ À ①  ﬁ Å", "À́ é", "日本語 テキスト", "­​　x",
           "ΑΣ ς ŉ Ǆ", "\x00\x01 <s> </s> <unk> <0x41>", "한국어 각", "é" * 40, "x" * 500, " " * 70, "a " * 300, "Ⅷ½ ﬃ️"]


def texts(seed=5):
    rng = random.Random(seed)
    letters = "abcde  ABC\n\t.,é ßñ日本①ﬁｶﾞ̀́▁𝔘😀‍　"
    return STRANGE + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(200)]


def library(sp, text):
    found = sp.encode(text.encode(), return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The given model, and ones with compiled character maps, trimming, kept symbols and without a prefix."""
    import sentencepiece

    raw, folder = open(piece_path(), "rb").read(), tmp_path_factory.mktemp("models")
    paths = {"given": piece_path()}
    for rule in ("nmt_nfkc", "nmt_nfkc_cf", "nfkc"):
        spec = dict(pieces.wire_fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
        paths[rule] = folder / f"{rule}.model"
        paths[rule].write_bytes(raw + wire(3, spec))
    plain = dict(pieces.wire_fields(dict(pieces.wire_fields(paths["nfkc"].read_bytes()[len(raw):]))[3]))[2]
    for name, spec in {"trim": wire(4, 1), "bare": wire(3, 0) + wire(2, plain), "open": wire(4, 0) + wire(2, plain)}.items():
        paths[name] = folder / f"{name}.model"
        paths[name].write_bytes(raw + wire(3, spec))
    paths["kept"] = folder / "kept.model"
    symbols = b"".join(wire(1, wire(1, s.encode()) + wire(3, 4)) for s in ("b①", "①", "①日", "ﬁx"))
    paths["kept"].write_bytes(raw + symbols + wire(3, wire(2, plain)))
    return {k: str(v) for k, v in paths.items()}


@pytest.mark.parametrize("name", ["given", "nmt_nfkc", "nmt_nfkc_cf", "nfkc", "trim", "bare", "open", "kept"])
def test_pieces_and_their_bytes_are_the_library_s(models, name):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=models[name]), pieces.Model(models[name])
    for text, got in zip(texts(), own.encode(texts())):
        assert tuple(x.tolist() for x in got) == library(sp, text), (name, text)
        assert tuple(x.tolist() for x in own.encode([text])[0]) == library(sp, text)
        assert own.normalise(text)[0].decode() == sp.normalize(text)


def test_long_texts_in_slices_and_a_small_memory(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "SLICE", 50)
    monkeypatch.setattr(pieces, "KNOWN_UNITS", 40)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=piece_path()), pieces.Model(piece_path())
    long = " ".join(texts()) + " ▁ a  b" * 30
    assert len(list(own.slices(long))) > 100 and "".join(own.slices(long)) == long
    assert tuple(x.tolist() for x in own.encode([long])[0]) == library(sp, long)
    for part in (1, 60, 400):  # parts of few texts, parts that end inside a text
        monkeypatch.setattr(pieces, "PART_BYTES", part)
        assert [tuple(x.tolist() for x in f) for f in own.encode([long, "", "a b", long[:300]])] == [library(sp, t) for t in (long, "", "a b", long[:300])]


def test_spans_give_back_the_text(models):
    own = pieces.Model(models["nmt_nfkc"])
    for text in texts():
        _, begins, ends = own.encode([text])[0]
        raw, at = text.encode(), 0
        for b, e in zip(begins.tolist(), ends.tolist()):
            assert at <= b <= e <= len(raw)  # ranges ascend, and none overlaps the one before
            raw[b:e].decode()
            at = e


def test_encode_and_decode_tables(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    rows = [(i if i % 5 else None, t, "mine", 1.5) for i, t in enumerate([*texts(), None, "word " * 60000, "a b", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `odd name` double").repartition(3)
    out = pieces.encode(docs, piece_path(), decoded=True)
    assert out.columns == ["doc_id", "text", "odd name", "ids", "begins", "ends", "decoded"]
    got = Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in out.collect())
    want = Counter((i, t, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t, *_ in rows)
    assert got == want
    assert pieces.decode(out.drop("decoded"), piece_path()).where(F.col("decoded") != F.col("text")).count() == out.where(F.col("decoded") != F.col("text")).count()
    assert pieces.encode(docs.limit(0), piece_path()).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), piece_path()).collect() == [(None, ""), ([], "")]


# --- Merkle manifests -------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, arity):
    """(root, proofs of the nodes as lists of (before, after))."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        for leaf, at in enumerate(places):
            run = runs[at // arity]
            proofs[leaf].append(("".join(run[:at % arity]), "".join(run[at % arity + 1:])))
            places[leaf] = at // arity
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], proofs


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def table(rows, arity):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        groups[lang].append((doc_id, h("".join(map(part, (doc_id, source, lang, n, text)))), h("".join(map(part, (doc_id, source, lang, None if n is None else n + 1, text))))))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    subs = []
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs.append(climb([r[1] for r in groups[lang]], arity))
    root, over = climb([s for s, _ in subs], arity)
    out = []
    for k, lang in enumerate(langs):
        for i, (doc_id, leaf, other) in enumerate(groups[lang]):
            proof = subs[k][1][i] + over[k]
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = other if bad else leaf
            for before, after in proof:
                node = h(before + node + after)
            out.append((doc_id, leaf, subs[k][0], root, h("".join(b + a for b, a in proof)), node, i))
    return Counter(out)


def manifest_rows(docs, arity):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.document_manifest(docs, bad, arity)
    return Counter(tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")),
                                              merkle.folded(F.col("seen_leaf"), F.col("proof")), "idx").collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n int"


def merkle_rows():
    rng = random.Random(2)
    rows = [(i, "t%d é" % i, rng.choice(("en", "en", "en", "de", None, "")), rng.choice(("a", None)), rng.choice((i, None))) for i in range(97)]
    return rows + [(500, "alone", "Zz", "s", 5), (None, None, None, None, None), (None, "", "en", "", 0), (7, "again", "en", "a", 1), (7, "again", "en", "a", 1),
                   (600, "long " * 100_000, "en", "a", 500_000)]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_matches_brute_force(spark, arity):
    rows = merkle_rows()
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(4)
    got, want = manifest_rows(docs, arity), table(rows, arity)
    assert got == want
    assert sum(n for r, n in got.items() if r[5] != r[3]) == sum(
        1 for i, _, _, _, n in rows if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0)


def test_manifest_of_one_row_of_single_leaves_and_of_none(spark):
    def of(rows):
        return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)

    for rows in ([(7, "x", "en", "a", 1)], [(i, "x", f"l{i}", "a", 1) for i in range(5)]):
        assert manifest_rows(of(rows), 2) == table(rows, 2)
    assert merkle.document_manifest(of([])).count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(300)], "k string, v long")
    for parts in (1, 7):
        got = merkle.numbered(df.repartition(parts), ["k"], ["v"]).collect()
        assert len(got) == 900 and all(r.idx == r.v for r in got)
