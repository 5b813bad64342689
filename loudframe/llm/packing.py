"""Packing of documents into training sequences by lexical retrieval.

Texts become token ids once. Documents are sorted by a minimum hash of their vocabulary, so that
texts with much the same words lie together, and cut into shards of about a million tokens. Each
shard has an inverted index with BM25 weights. A document that is not used yet seeds a window, its
best matching unused neighbours fill it, and one that doesn't fit is cut; its rest opens the next
window, which is filled with neighbours of that document. Only the last sequence of a task has padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import arrow_rows, release_memory, stored, text_parts, worker_cache

WINDOW, END_ID = 4096, 2
#: Tokens of one retrieval shard, and of one task.
SHARD_TOKENS, TASK_TOKENS = 1_000_000, 6_000_000
#: Different words whose ids a worker remembers, and words it learns at a time.
CACHED_WORDS, LEARNT_WORDS = 400_000, 20_000
#: Text tokenized at a time, and rows that a worker is handed at a time.
PART_BYTES, BATCH_ROWS = 1 << 20, 1_000
K1, B = 1.2, 0.75

#: Characters for which the tokenizer's normalisation is just lower-casing. Texts with others take the library's own path.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: Pieces of a lower-cased text without white space; \x01 stands between words and belongs to none.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x01]+")


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Tokens:
    """Token ids of texts, word by word with a memory, equal to the library's ids.

    The merges are handed to a second library that is faster on single words. It merges whatever
    pair gives the best-ranked known string, the first one only listed pairs. Both agree because
    a known string that is not built from its own letters alone is left out: inside any text the
    merges within a stretch of letters run in the same order as for the stretch alone.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = _byte_letters(), model["end_of_word_suffix"]
        vocab = model["vocab"]

        def raw(token: str) -> bytes | None:
            end = token.endswith(suffix)
            body = token[:-len(suffix)] if end else token
            return bytes(letters[c] for c in body) + b"\0" * end if body and all(c in letters for c in body) else None

        ranks, ids = {}, {}

        def put(key: bytes, token_id: int) -> None:
            if key not in ranks:
                ids[len(ranks)] = token_id
                ranks[key] = len(ranks)

        for letter, b in letters.items():  # a word's last letter joins the end mark before all else
            put(bytes([b, 0]), vocab[letter + suffix])
        for merge in model["merges"]:
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            key = raw(token)
            if key and key[:-1].find(b"\0") < 0 and self._alone(token, suffix) == [vocab[token]]:
                put(key, vocab[token])
        for letter, b in letters.items():
            put(bytes([b]), vocab[letter])
        self.border = ranks[b"\1"]
        self.ids = np.array([ids[i] for i in range(len(ids))], np.uint16)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00\x01]*\x00|\x01", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.first = np.empty(1 << 20, np.uint16), np.zeros(1 << 16, np.int64)

    def _alone(self, token: str, suffix: str) -> list[int]:
        """The library's ids for the letters of a token; a token inside a word is tried with a word end that can't merge."""
        if token.endswith(suffix):
            return [t.id for t in self.own.model.tokenize(token[:-len(suffix)])]
        return [self.own.token_to_id(token)]

    def _learn(self, words: list[str]) -> None:
        text = PIECES.sub("\\g<0>\0", "\1".join(words) + "\1")
        ranks = np.array(self.fast.encode_ordinary(text), np.int64)
        border = ranks == self.border
        ids, n, used = self.ids[ranks[~border]], len(self.known), self.first[len(self.known)]
        while used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.empty_like(self.pool))
        while n + len(words) >= len(self.first):
            self.first = np.append(self.first, np.zeros_like(self.first))
        self.pool[used:used + len(ids)] = ids
        self.first[n + 1:n + 1 + len(words)] = used + np.cumsum(~border)[border]
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """16-bit ids of each text; null counts as empty."""
        plain = texts.to_pylist()
        other = [i for i, t in enumerate(plain) if t and ("<|" in t or not PLAIN.fullmatch(t))]
        if other:
            mask = np.zeros(len(texts), bool)
            mask[other] = True
            texts = pc.if_else(pa.array(mask), None, texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.ascii_split_whitespace(texts)
        coded = pc.utf8_lower(cut.flatten()).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) + len(words) > CACHED_WORDS:
            self._forget()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        place[new] = np.arange(len(self.known), len(self.known) + len(new))
        for lo in range(0, len(new), LEARNT_WORDS):
            self._learn(words[new[lo:lo + LEARNT_WORDS]].tolist())
        place = place[coded.indices.to_numpy()]
        start = self.first[place]
        n = self.first[place + 1] - start
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.append(0, ends)[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = [ids[lo:hi] for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        for i in other:
            out[i] = np.array(self.own.encode(plain[i], add_special_tokens=False).ids, np.uint16)
        return out


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, ids, n, near): 16-bit ids with the end id, their number, and a minimum hash of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # what earlier jobs left to a worker that is used again
        kept = worker_cache("packing-tokens")
        if path not in kept:
            kept[path] = Tokens(path)
        tokens, order = kept[path], np.random.default_rng(7).permutation(1 << 16).astype(np.int64)
        end = np.array([END_ID], np.uint16)
        for batch in batches:
            # Parts of many thousand words: few enough for the memory, many enough to repeat words.
            for part in text_parts(batch, 2, PART_BYTES):
                ids = [np.append(x, end) for x in tokens.encode(part.column(2))]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(order[x].min()) for x in ids], pa.int64())], names=["row", "doc_id", "ids", "n", "near"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return stored(slim.mapInArrow(run, "row long, doc_id long, ids binary, n long, near long"), "tokens")


class Shard:
    """An inverted index over the documents of a shard, with BM25 weights in its postings."""

    def __init__(self, docs: list[np.ndarray]):
        # The end id is in every document and says nothing.
        counts = [np.unique(d[d != END_ID], return_counts=True) for d in docs]
        term = np.concatenate([c[0] for c in counts])
        doc = np.repeat(np.arange(len(docs)), [len(c[0]) for c in counts])
        tf = np.concatenate([c[1] for c in counts]).astype(np.float32)
        length = np.array([c[1].sum() for c in counts], np.float32)
        order = np.argsort(term, kind="stable")
        self.terms, self.doc = counts, doc[order]
        self.first = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        df = np.diff(self.first)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * length / max(1, length.mean()))
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order]
        self.live = len(docs)

    def scores(self, d: int) -> np.ndarray:
        """BM25 score of every document for the different words of document ``d``."""
        terms = self.terms[d][0]
        lo, hi = self.first[terms], self.first[terms.astype(np.int64) + 1]
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.terms))

    def ranked(self, d: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that have a word of document ``d``, best first."""
        left = int(unused.sum())
        if 2 * left < self.live:  # postings of used documents are left out now and then; weights stay
            keep = unused[self.doc]
            self.first = np.append(0, np.cumsum(keep))[self.first]
            self.doc, self.weight, self.live = self.doc[keep], self.weight[keep], left
        score = np.where(unused, self.scores(d), 0)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: Iterator[tuple], window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> Iterator[tuple]:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence, offset) for a stream of (doc_id, ids)."""
    sequence = filled = 0

    def put(doc_id, ids: np.ndarray) -> Iterator[tuple]:
        nonlocal sequence, filled
        at = 0
        while at < len(ids):
            take = min(window - filled, len(ids) - at)
            yield doc_id, at, take, zlib.crc32(ids[at:at + take].astype("<u4").tobytes()), len(ids), sequence, filled
            at, filled = at + take, filled + take
            if filled == window:
                sequence, filled = sequence + 1, 0

    def shard(held: list[tuple]) -> Iterator[tuple]:
        index, unused = Shard([x[1] for x in held]), np.ones(len(held), bool)
        seed, after = None, 0
        while True:
            if seed is None:
                while after < len(held) and not unused[after]:
                    after += 1
                if after == len(held):
                    return
                seed, unused[after] = after, False
                yield from put(*held[seed])
            neighbours = index.ranked(seed, unused) if filled else []
            window_now, seed = sequence, None
            for d in neighbours:
                unused[d] = False
                yield from put(*held[d])
                if sequence != window_now:
                    # The rest of a cut document opens the next window and seeks neighbours of its own.
                    seed = d if filled else None
                    break

    held, size = [], 0
    for doc in docs:
        held.append(doc)
        size += len(doc[1])
        if size >= shard_tokens:
            yield from shard(held)
            held, size = [], 0
    if held:
        yield from shard(held)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    A null text is the end id alone. Rows with equal or null ids are documents of their own, other
    columns are ignored, an empty table gives no rows. Sequence ids hold the task's number above
    their own.
    """
    tokens = tokenized(docs, path, id_col, text_col)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    dealt = (tokens.repartitionByRange(max(1, -(-total // task_tokens)), "near", "row").sortWithinPartitions("near", "row")
             .select("doc_id", "ids", F.spark_partition_id().alias("task")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("packing-tokens").clear()  # all texts are tokenized: the memory is for the index
        release_memory()
        task = 0

        def rows() -> Iterator[tuple]:
            nonlocal task
            for batch in batches:
                if batch.num_rows:
                    task = batch.column(2)[0].as_py()
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc_id, np.frombuffer(ids.as_buffer(), np.uint16)

        held = []
        for piece in pack(rows(), window, shard_tokens):
            held.append(piece)
            if len(held) >= 20_000:
                yield _pieces(held, task)
                held = []
        yield _pieces(held, task)
        release_memory()

    return dealt.mapInArrow(run, OUT)


def _pieces(rows: list[tuple], task: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    columns[5] = [(task << 32) + s for s in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in OUT.split(", ")])
