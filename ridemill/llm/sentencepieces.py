"""SentencePiece encoding that keeps every piece's place in the original text, and decoding.

The normaliser is run here: at each place the longest prefix that the model's compiled
character map knows is replaced, and every normalised byte remembers the source byte it came
from. The normalised text is cut where no piece of the vocabulary can reach across, each
distinct chunk is encoded once per worker by the library (with its own normaliser off), and
the pieces' normalised lengths are projected through the alignment to spans of source bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemill.llm import pretokens, spans

SLICE = 2 << 20  # bytes of text that are worked on at once
MARK = "▁".encode()  # stands for a space in pieces
MARK_BYTES = np.frombuffer(MARK, np.uint8)
#: Field numbers of the model file, and its kinds of pieces.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_ID, BEGIN_ID, END_ID, UNKNOWN_SURFACE, AS_SUFFIX = 3, 35, 40, 41, 42, 44, 24
CHARACTER_MAP, DUMMY_PREFIX, COLLAPSE, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
BPE = 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """Field number, value, and where the field starts and ends, of one message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value, start, at


class CharacterMap:
    """The compiled map: a double-array trie of source strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = np.frombuffer(blob[4 + size :], np.uint8)
        self.ends = np.flatnonzero(self.texts == 0)

    def longest(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest known prefix at each start (0: none), and where its replacement is."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = np.arange(len(starts))
        node = np.full(len(starts), self._offset(self.units[:1])[0])
        deep = 0
        while len(active):
            inside = starts[active] + deep < limits[active]
            active, node = active[inside], node[inside]
            byte = data[starts[active] + deep].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            same = (node < len(self.units)) & ((unit & (0x80000000 | 0xFF)) == byte)
            active, node, unit = active[same], node[same], unit[same]
            node = node ^ self._offset(unit)
            deep += 1
            leaf = (unit >> 8) & 1 > 0
            length[active[leaf]] = deep
            value[active[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def sizes(self, value: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, value)] - value


class Normal(NamedTuple):
    """Normalised texts; ``source`` has the source byte of each normalised byte, ``close`` the last one's end per text."""

    data: np.ndarray
    offsets: np.ndarray
    source: np.ndarray
    close: np.ndarray


class _Chunks(pretokens.Encoder):
    """Ids of chunks of normalised text, each distinct one encoded once per worker."""

    def __init__(self, processor):
        self.processor = processor
        self.slot = {}
        self.size, self.place = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _single(self, texts: list[bytes]) -> np.ndarray:
        return np.zeros(len(texts), bool)

    def _whole(self, texts: list[bytes], single: np.ndarray) -> list[list[int]]:
        return self.processor.encode([text.decode() for text in texts], num_threads=1)


class Model:
    """A sentencepiece model file with byte fallback; user-defined symbols and suffixed spaces are refused."""

    def __init__(self, proto: bytes):
        import sentencepiece

        kept, pieces, kinds = bytearray(), [], []
        trainer, normalizer, denormalizer = {}, {}, {}
        for number, value, start, end in _fields(proto):
            if number == PIECES:
                piece = {n: v for n, v, _, _ in _fields(value)}
                pieces.append(piece[1])
                kinds.append(piece.get(3, NORMAL))
            elif number in (TRAINER, NORMALIZER, DENORMALIZER):
                {TRAINER: trainer, NORMALIZER: normalizer, DENORMALIZER: denormalizer}[number].update((n, v) for n, v, _, _ in _fields(value))
            if number != NORMALIZER:
                kept += proto[start:end]
        off = b"".join(bytes([number << 3, 0]) for number in (DUMMY_PREFIX, COLLAPSE, ESCAPE))
        kept += bytes([NORMALIZER << 3 | 2, len(off)]) + off
        self.kinds = np.array(kinds)
        if not trainer.get(BYTE_FALLBACK) or trainer.get(AS_SUFFIX) or (self.kinds == USER_DEFINED).any():
            raise ValueError("only models with byte fallback, prefixed spaces and no user-defined symbols")
        self.map = CharacterMap(normalizer[CHARACTER_MAP]) if normalizer.get(CHARACTER_MAP) else None
        self.prefix, self.collapse, self.escape = (bool(normalizer.get(n, 1)) for n in (DUMMY_PREFIX, COLLAPSE, ESCAPE))
        self.begin, self.end = trainer.get(BEGIN_ID, 1), trainer.get(END_ID, 2)
        #: Whether no piece reaches from another character into a mark, so that chunks that start with marks are independent.
        self.chunked = trainer.get(MODEL_TYPE) == BPE and not any(MARK in p.decode().lstrip("▁").encode() for p, k in zip(pieces, kinds) if k in (NORMAL, UNUSED))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.chunks = _Chunks(sentencepiece.SentencePieceProcessor(model_proto=bytes(kept)))
        self.width = np.array([1 if k == BYTE else len(p) for p, k in zip(pieces, kinds)], np.int64)  # normalised bytes of a piece
        unknown = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
        shown = [b"" if k == CONTROL else unknown if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, b" ") for p, k in zip(pieces, kinds)]
        self.shown, self.shown_ends = np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)])
        self.opens = np.array([p.startswith(MARK) for p in pieces]) & (self.kinds != BYTE)
        self.plain = self.prefix and not self.collapse and not denormalizer.get(CHARACTER_MAP)

    def normalise(self, data: np.ndarray, offsets: np.ndarray, first: bool = True) -> Normal:
        """``first``: whether texts begin here (if not, they are later parts of a text, without the prefix)."""
        if self.map is None:
            sizes, begin, pool, origin = np.ones(len(data), np.int64), np.arange(len(data)), data, np.arange(len(data))
            if len(data) and data.max() >= 0x80:  # every byte of a character stems from its first
                origin = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, origin, 0))
            out = pool
        else:
            pool = np.concatenate([data, self.map.texts])
            starts, sizes, begin = self._replaced(data, offsets)
            origin = np.repeat(starts, sizes)
            out = pool[spans.places(begin, sizes)]
        ends = np.searchsorted(origin, offsets)  # normalised bytes before each text
        close = offsets[1:].copy()
        if self.collapse:
            out, origin, ends, close = self._collapsed(out, origin, ends, close)
        filled = np.diff(ends) > 0
        space = (out == 32) & self.escape
        width = np.where(space, 3, 1)
        if self.prefix and first:  # one more mark before the first byte of each text
            lead = ends[:-1][filled]
            width[lead] += 3 if self.escape else 1
        at = np.concatenate([[0], np.cumsum(width)])
        final = np.repeat(out, width)
        source = np.repeat(origin, width)
        marks = at[1:][space] - 3
        for k in range(3):
            final[marks + k] = MARK_BYTES[k]
        if self.prefix and first:
            for k in range(3 if self.escape else 1):
                final[at[lead] + k] = MARK_BYTES[k] if self.escape else 32
        return Normal(final, at[ends], source, close)

    def _replaced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source place of each matched prefix or single character, and its replacement's size and place."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        own = np.diff(np.append(starts, len(data)))
        limits = offsets[np.searchsorted(offsets, starts, side="right")]
        length, value = self.map.longest(data, starts, limits)
        used, reach = np.ones(len(starts), bool), 0
        for i in np.flatnonzero(length > own):  # a prefix of several characters takes the later ones with it
            if starts[i] < reach:
                continue
            reach = starts[i] + length[i]
            used[i + 1 : np.searchsorted(starts, reach)] = False
        known = length > 0
        sizes, begin = own, starts.copy()
        sizes[known] = self.map.sizes(value[known])
        begin[known] = len(data) + value[known]
        return starts[used], sizes[used], begin[used]

    def _collapsed(self, out: np.ndarray, origin: np.ndarray, ends: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, ...]:
        """Without spaces at either end of a text, and one for each run of them."""
        blank = out == 32
        before = np.ones(len(out), bool)
        before[1:] = blank[:-1]
        before[ends[:-1][ends[:-1] < len(out)]] = True
        keep = ~(blank & before)
        text = np.searchsorted(ends, np.arange(len(out)), side="right") - 1
        last = np.full(len(close), -1)
        tail = blank.copy()  # a mark that stands in the text itself also goes at its end
        for place in np.flatnonzero((out[:-2] == MARK_BYTES[0]) & (out[1:-1] == MARK_BYTES[1]) & (out[2:] == MARK_BYTES[2])) if self.escape else ():
            tail[place : place + 3] = True
        solid = np.flatnonzero(~tail)
        np.maximum.at(last, text[solid], solid)
        trailing = np.flatnonzero(keep & tail & (np.arange(len(out)) > last[text]))
        np.minimum.at(close, text[trailing], origin[trailing])
        keep[trailing] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], origin[keep], kept[ends], close

    def _cut(self, normal: Normal) -> np.ndarray:
        """First byte of each chunk."""
        data, starts = normal.data, normal.offsets[:-1][np.diff(normal.offsets) > 0]
        if not self.chunked or not len(data):
            return starts
        mark = np.zeros(len(data) + 3, bool)
        mark[3:-2] = (data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2])
        cut = mark[3:] & ~mark[:-3]
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray, first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end, ids per text, and the span of source bytes of each id."""
        normal = self.normalise(data, offsets, first)
        cut = self._cut(normal)
        chunks = spans.strings(normal.data, np.append(cut, len(normal.data)), pa.large_binary() if len(normal.data) >> 31 else pa.binary()).dictionary_encode()
        size, place, ids = self.chunks.look_up(chunks.dictionary)
        which = chunks.indices.to_numpy()
        lengths = size[which]
        found = ids[spans.places(place[which], lengths)].astype(np.int64)
        per_text = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(cut, normal.offsets)])
        ends = np.cumsum(self.width[found])
        begins = ends - self.width[found]
        start = normal.source[begins] if len(begins) else begins
        follow = np.append(normal.source, 0)[ends]
        last = np.cumsum(per_text)[per_text > 0] - 1
        follow[last] = normal.close[per_text > 0]
        text_start = np.repeat(offsets[:-1], per_text)
        return found, per_text, start - text_start, follow - text_start

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> pa.Array:
        """Text of each run of ids as the library decodes it."""
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        if self.plain:
            begin, size = self.shown_ends[ids], np.diff(self.shown_ends)[ids]
            solid = np.flatnonzero(self.kinds[ids] != CONTROL)
            head = np.searchsorted(solid, bounds[:-1])
            head = solid[head[(head < len(solid))]][: len(per_text)] if len(solid) else solid
            head = np.unique(head)
            head = head[self.opens[ids[head]]]
            begin = begin.copy()
            begin[head] += 1
            size[head] -= 1
            ends = np.concatenate([[0], np.cumsum(size)])
            try:
                out = spans.strings(self.shown[spans.places(begin, size)], ends[bounds], pa.large_binary()).cast(pa.large_string())
                return out.cast(pa.string()) if ends[-1] < 1 << 31 else out
            except pa.ArrowInvalid:  # bytes that are no character: the library has its own sign for them
                pass
        return pa.array([self.library.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


@cache
def model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def _parts(own: Model, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in runs of about ``SLICE`` bytes that begin with a space after another sign, where that is safe."""
    start = 0
    while start < len(data):
        end = len(data)
        if own.chunked and own.map is None and not own.collapse and own.escape and end - start > SLICE:
            at = start + SLICE
            while at < end:
                window = data[at - 1 : min(at + (1 << 16), end)]
                hit = np.flatnonzero((window[1:] == 32) & (window[:-1] != 32) & (window[:-1] != MARK_BYTES[2]))
                if len(hit):
                    end = at + int(hit[0])
                    break
                at += 1 << 16
        yield start, end
        start = end


def encode_batch(own: Model, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """[ids, starts, ends] of all texts with begin and end ids, ids per text, and the decoded texts."""
    data, offsets = spans.flat(texts)
    if len(texts) == 1 and len(data) > SLICE:
        parts = [(a, *own.encode(data[a:b], np.array([0, b - a]), first=a == 0)) for a, b in _parts(own, data)]
        inner = [np.concatenate([p[1] for p in parts]), *(np.concatenate([p[k] + p[0] for p in parts]) for k in (3, 4))]
        per_text = np.array([len(inner[0])])
    else:
        ids, per_text, starts, ends = own.encode(data, offsets)
        inner = [ids, starts, ends]
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    sizes = np.diff(offsets)
    ring = [(own.begin, own.end), (np.zeros(len(sizes), np.int64), sizes), (np.zeros(len(sizes), np.int64), sizes)]
    place = np.stack([bounds[:-1], bounds[1:]], 1).ravel()
    out = [np.insert(x, place, np.stack(np.broadcast_arrays(a, b, sizes)[:2], 1).ravel()) for x, (a, b) in zip(inner, ring)]
    return out, per_text + 2, own.decode(out[0], per_text + 2)


def encode(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ids, starts, ends and decoded for every row of ``docs``.

    ``ids`` are the library's ids of the whole text with begin and end ids, as little-endian
    unsigned 32-bit integers in one binary value; ``starts`` and ``ends`` likewise hold the span of
    source bytes of each id (of a character's byte-fallback ids the last one spans it, begin and
    end ids are empty spans); ``decoded`` is the library's decoding of the ids. A null text counts
    as empty: two ids. Repeated rows and null keys are kept, other columns left out. No shuffle.

    Works on a few MB of text at once; a longer text is cut at a space, unless the model's
    character map or its rules for spaces may reach across one.
    """
    model(path)  # refuse a model here rather than in a task
    rows = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in spans.slices(batch, "__text", SLICE):
                columns, per_text, decoded = encode_batch(own, part.column("__text"))
                bounds = 4 * np.concatenate([[0], np.cumsum(per_text)])
                packed = [spans.strings(x.astype("<u4").view(np.uint8), bounds, pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *packed, decoded], names=[*keys, "ids", "starts", "ends", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, ids binary, starts binary, ends binary, decoded string")
