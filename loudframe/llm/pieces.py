"""Encoding into sentence pieces that keeps where each piece comes from, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, which
records for every normalised byte the place in the text it stands for. The normalised text is
encoded by merges, and each piece's range is projected to the bytes of the text as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.llm.common import text_parts, unique_name, worker_cache

MARK = "▁"
#: Different units, and bytes of such units, after which a worker begins to remember anew.
KNOWN_UNITS, KNOWN_BYTES = 400_000, 16 << 20
#: Bytes of text that are encoded at a time.
PART_BYTES = 4 << 20
#: Characters of a long text that are encoded at a time, and where it is cut: before a space behind another character.
SLICE, SEAM = 1 << 20, re.compile(f"[^ {MARK}](?= )")


def wire_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in wire format; numbers of fixed width are left as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else number()
            yield tag >> 3, raw[at:at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double array over the bytes of source strings, and their replacements.

    ``longest`` walks the array from a place of a text and gives the longest known prefix.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.pool = blob[4 + size:]
        self.starts = self._starts() if self.units else None

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest prefix of ``raw`` from ``at`` that the map knows, 0 if none, and what replaces it."""
        units, node, length, value = self.units, self._children(self.units[0]), 0, 0
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= self._children(unit)
            if unit >> 8 & 1:
                length, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return length, self.pool[value:self.pool.index(0, value)] if length else b""

    def _starts(self) -> re.Pattern:
        """What the first two bytes of a known prefix can be; places of a text where nothing can begin are passed over at C speed."""
        alone, pairs = set(), {}
        root = self._children(self.units[0])

        def below(node: int) -> Iterator[tuple[int, int]]:
            for byte in range(1, 256):
                child = node ^ byte
                if child < len(self.units) and self.units[child] & 0x800000FF == byte:
                    yield byte, child

        for first, node in below(root):
            unit = self.units[node]
            if unit >> 8 & 1:
                alone.add(first)
            else:
                pairs[first] = bytes(b for b, _ in below(node ^ self._children(unit)))
        # A first byte that is a whole prefix may also begin longer ones; ``longest`` decides.
        parts = [b"[" + b"".join(re.escape(bytes([b])) for b in sorted(alone)) + b"]"] if alone else []
        parts += [re.escape(bytes([a])) + b"(?=[" + b"".join(re.escape(bytes([b])) for b in second) + b"])" for a, second in sorted(pairs.items())]
        return re.compile(b"|".join(parts))


class Model:
    """What a model file says, and its merges without its own normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        raw = open(path, "rb").read()
        self.path, kinds = path, {}
        spec, suffix = {}, False
        lengths, values, self.unknown = [], [], -1
        for number, value in wire_fields(raw):
            if number == 1:
                piece = dict(wire_fields(value))
                kind = piece.get(3, 1)
                kinds.setdefault(kind, set()).add(piece[1])
                if kind == 2:
                    self.unknown = len(lengths)
                lengths.append(1 if kind == 6 else len(piece[1]))
                values.append(int(piece[1][3:-1], 16) if kind == 6 else -1)
            elif number == 2:
                suffix = bool(dict(wire_fields(value)).get(24, 0))
            elif number == 3:
                spec.update(wire_fields(value))
        # Bytes that a piece stands for, and the value of one that is a single byte.
        self.lengths, self.byte_values = np.array(lengths), np.array(values)
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        own = sorted(kinds.get(4, ()), key=len, reverse=True)  # symbols that pass unchanged
        self.kept = re.compile(b"|".join(re.escape(s) for s in own)) if own else None
        # A later value of a field holds: no map, no prefix, no trimming, no escaping.
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a\x08" + b"\x12\x00" + b"\x18\x00" + b"\x20\x00" + b"\x28\x00")
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = MARK.encode()
        words = {p.decode() for k in (1, 4, 5) for p in kinds.get(k, ())}
        # Where no piece holds a mark behind another character, no merge crosses the place before a mark.
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if MARK in words and not any(MARK in w.lstrip(MARK) for w in words) else None
        self.plain = not self.map.units and self.kept is None and not self.trim and self.escape and not self.suffix
        self.forget()

    # --- normalisation -----------------------------------------------------------------------

    def chunks(self, raw: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        """(from, to, replacement, unchanged run) in order: what a kept symbol or the map takes, and the runs between them."""
        at, end, kept = 0, len(raw), None
        while at < end:
            if self.kept is not None and (kept is None or kept[0] < at):
                m = self.kept.search(raw, at)
                kept = (m.start(), m.end(), m.group()) if m else (end, end, b"")
            spot = kept or (end, end, b"")
            if self.map.units:
                for m in self.map.starts.finditer(raw, at, spot[0]):
                    length, to = self.map.longest(raw, m.start())
                    if length:
                        spot = m.start(), m.start() + length, to
                        break
            start, stop, to = spot
            if start > at:
                yield at, start, raw[at:start], True
            if stop > start:
                yield start, stop, to, False
            at = stop

    def normalise(self, text: str, prefix: bool = True) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of the text it stands for.

        Bytes of a character, and of what replaces a prefix, stand for the place where that begins.
        ``prefix=False``: what goes before each text is left out.
        """
        raw, mark = text.encode(), MARK.encode() if self.escape else b" "
        if not raw:
            return b"", np.zeros(1, np.int32)
        if self.plain:
            pieces = [(raw, _char_starts(raw))]
        else:
            pieces = [(to, start + _char_starts(to) if run else np.full(len(to), start, np.int32)) for start, _, to, run in self.chunks(raw)]
        out = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        place = np.concatenate([a for _, a in pieces] or [np.zeros(0, np.int32)])
        end, put = len(raw), self.prefix and prefix
        if self.trim:
            # Of the spaces in a row the first stays, and none at the head; those at the end go below.
            space = out == 32
            keep = ~space | np.append(False, ~space[:-1])
            out, place = out[keep], place[keep]
            if not len(out):
                return b"", np.zeros(1, np.int32)
        if put and not self.suffix:
            # The prefix stands for where the rest begins.
            out, place = np.append(np.uint8(32), out), np.append(place[:1] if self.trim else np.int32(0), place)
        text, place = self._escaped(out, place)
        if self.trim:
            left = len(text)
            while text.endswith(mark, 0, left):
                left -= len(mark)
            if left < len(text):
                text, place, end = text[:left], place[:left], int(place[left])
        if put and self.suffix:
            text, place = text + mark, np.append(place, np.full(len(mark), end))
        return text, np.append(place, end).astype(np.int32)

    def _escaped(self, out: np.ndarray, place: np.ndarray) -> tuple[bytes, np.ndarray]:
        text = out.astype(np.uint8).tobytes()
        if not self.escape:
            return text, place
        mark = MARK.encode()
        return text.replace(b" ", mark), np.repeat(place, np.where(out == 32, len(mark), 1))

    # --- encoding ----------------------------------------------------------------------------

    def forget(self) -> None:
        self.known, self.used, self.held = {}, 0, 0
        self.first, self.bytes = [0], []
        self.pool = np.zeros((3, 1 << 16), np.int32)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, list[int], list[int]]:
        """ids, begins and ends of the pieces of all units, ranges in bytes of the unit; the pieces and the bytes of each unit."""
        found = self.merges.encode(units, num_threads=1)
        sizes, n = np.array([len(u.encode()) for u in units]), np.array([len(f) for f in found])
        ids = np.fromiter(chain.from_iterable(found), np.int32, n.sum())
        if (ids == self.unknown).any():  # such a piece has no length of its own
            exact = [self.merges.encode(u.encode(), return_type="proto").pieces for u in units]
            flat = [q for e in exact for q in e]
            return np.array([[q.id for q in flat], [q.begin for q in flat], [q.end for q in flat]], np.int32).reshape(3, -1), [len(e) for e in exact], sizes.tolist()
        length, value = self.lengths[ids], self.byte_values[ids]
        ends = np.cumsum(length)
        begins = ends - length
        # Bytes of one character: all begin where it begins, and only the last ends where it ends.
        goes_on = (value & 0xC0) == 0x80
        goes_on[value < 0] = False
        begins = np.maximum.accumulate(np.where(goes_on, 0, begins))
        ends = np.where(np.append(goes_on[1:], False), begins, ends)
        before = np.repeat(np.cumsum(sizes) - sizes, n)
        return np.stack([ids, begins - before, ends - before]).astype(np.int32), n.tolist(), sizes.tolist()

    def _learn(self, units: list[str]) -> None:
        if not units:
            return
        fresh, n, sizes = self._encoded(units)
        while self.used + fresh.shape[1] > self.pool.shape[1]:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)], axis=1)
        self.pool[:, self.used:self.used + fresh.shape[1]] = fresh
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.first.extend((self.used + np.cumsum(n)).tolist())
        self.bytes.extend(sizes)
        self.used += fresh.shape[1]
        self.held += sum(sizes)

    def _parts(self, parts: list[str], heads: list[bool]) -> list[np.ndarray]:
        """ids, begins and ends of the pieces of each part, which are normalised with or without a prefix; ranges in the part's own bytes."""
        norms = [self.normalise(t, h) for t, h in zip(parts, heads)]
        cut = [(self.units.findall(n.decode()) if self.units else [n.decode()] if n else []) for n, _ in norms]
        if len(self.known) > KNOWN_UNITS or self.held > KNOWN_BYTES:
            self.forget()
        units = list(chain.from_iterable(cut))
        self._learn([u for u in dict.fromkeys(units) if u not in self.known])
        k = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        first = np.array(self.first, np.int64) if len(units) > 1000 else None
        start = first[k] if first is not None else np.array([self.first[i] for i in k], np.int64)
        stop = first[k + 1] if first is not None else np.array([self.first[i + 1] for i in k], np.int64)
        size = np.array(self.bytes, np.int64)[k] if first is not None else np.array([self.bytes[i] for i in k], np.int64)
        n = stop - start
        ends = np.cumsum(n)
        out = self.pool[:, np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        # A place in all normalised texts, each with one more place for its end.
        per_part = np.array([len(c) for c in cut])
        at = np.cumsum(size) - size + np.repeat(np.arange(len(cut)), per_part)
        out[1:] += np.repeat(at, n).astype(np.int32)
        out[1:] = np.concatenate([p for _, p in norms])[out[1:]]
        borders = np.append(0, ends)[np.append(0, np.cumsum(per_part))]
        return [out[:, lo:hi] for lo, hi in zip(borders[:-1], borders[1:])]

    def slices(self, text: str) -> Iterator[str]:
        """A long text in parts that are encoded apart: no merge crosses the place before a space behind another character."""
        at = 0
        while self.plain and self.units and len(text) - at > SLICE:
            m = SEAM.search(text, at + SLICE)
            if not m:
                break
            yield text[at:m.end()]
            at = m.end()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids, begins and ends of the pieces of each text, ranges in its own bytes. Units that texts share are encoded once."""
        parts = [(i, j, p) for i, t in enumerate(texts) for j, p in enumerate(self.slices(t))]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        before, at = [0] * len(texts), 0
        while at < len(parts):
            to, held = at + 1, len(parts[at][2])
            while to < len(parts) and held + len(parts[to][2]) <= PART_BYTES:
                held += len(parts[to][2])
                to += 1
            for (i, _, p), out in zip(parts[at:to], self._parts([p for *_, p in parts[at:to]], [not j for _, j, _ in parts[at:to]])):
                out[1:] += before[i]
                before[i] += len(p.encode())
                found[i].append(out)
            at = to
        return [np.concatenate(f, axis=1) if len(f) > 1 else f[0] for f in found]


def _char_starts(raw: bytes) -> np.ndarray:
    """For each byte the place where its character begins."""
    at = np.arange(len(raw), dtype=np.int32)
    if raw.isascii():
        return at
    return np.maximum.accumulate(np.where(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80, at, 0))


def model(path: str) -> Model:
    """The model at a path of this machine, kept by the worker."""
    kept = worker_cache("pieces")
    if path not in kept:
        kept[path] = Model(path)
    return kept[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Documents with ``ids``, ``begins`` and ``ends``: a piece's id and the bytes [begin, end) of the text it stands for; with ``decoded``, the text that the ids give.

    A null text counts as the empty one, which has no pieces; a text of any length is encoded whole (memory
    grows with the longest text); repeated rows are encoded alike; an empty table gives no rows; columns of
    the documents with one of the new names are replaced. A character that the pieces don't know becomes its
    bytes, of which the last stands for the character and the others for the empty range before it.
    """
    new = ["ids", "begins", "ends", *(["decoded"] if decoded else [])]
    kept = [c for c in docs.columns if c.lower() not in new]
    name = unique_name(docs, "encoded_text")
    slim = docs.select(*(docs[c] for c in kept), docs[text_col].cast("string").alias(name))
    schema = ", ".join(["%s %s" % ("`" + f.name.replace("`", "``") + "`", f.dataType.simpleString()) for f in slim.schema.fields[:-1]]
                       + [f"{n} array<int>" for n in new[:3]] + (["decoded string"] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            last = batch.num_columns - 1
            for part in text_parts(batch, last, PART_BYTES):
                texts = pc.fill_null(part.column(last).cast(pa.large_string()), "").to_pylist()
                found = own.encode(texts)
                at = pa.array(np.cumsum([0] + [f.shape[1] for f in found]), pa.int32())
                flat = np.concatenate([np.zeros((3, 0), np.int32), *found], axis=1)
                columns = [pa.ListArray.from_arrays(at, pa.array(flat[i], pa.int32())) for i in range(3)]
                if decoded:
                    columns.append(pa.array([own.whole.decode(f[0].tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *columns], names=[*kept, *new])

    return slim.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Rows with the text that their ids give. Null and empty ids give the empty text."""
    schema = df.drop(name).schema.add(name, "string")
    slim = df.drop(name)
    place = slim.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [own.whole.decode(i or []) for i in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return slim.mapInArrow(run, schema)
