"""Exact encoding with the tokenizers library, each distinct pre-token encoded once per worker.

A byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in
order. ``split`` finds the pre-tokens of a whole batch in numpy; the library encodes those
that the worker has not met yet. Texts with special strings, or with characters whose class
depends on the library's Unicode version, are handed to the library whole. The pre-tokeniser
must be the one ``split`` knows; any other one makes every text go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ridemill.llm import spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Pre-tokens kept per worker (about 50 MB), and the longest one kept; later ones are encoded each time.
MEMO, KEPT_BYTES = 200_000, 64
#: The contractions that the pre-tokeniser splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_signs() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position of each pre-token, and whether each text has characters of unsure class.

    Texts are the ranges of ``offsets``. Pre-tokens are contractions, runs of letters, of
    numbers or of other signs with one leading space, and runs of white space of which the
    last character is left to what follows.
    """
    points, at = spans.code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, bool)
    kind = spans.classes()[points]
    first = np.zeros(n, bool)
    bounds = np.searchsorted(at, offsets)
    first[bounds[:-1][bounds[:-1] < n]] = True
    unsure = np.zeros(len(offsets) - 1, bool)
    unsure[np.searchsorted(bounds, np.flatnonzero(kind == spans.UNSURE), side="right") - 1] = True

    space, blank = kind == spans.SPACE, points == 32
    start = first.copy()
    start[1:] |= (kind[1:] != kind[:-1]) & (space[1:] | ~blank[:-1])
    leaves = space[:-1] & ~space[1:] & ~first[1:]  # the last white space before something else
    start[:-1] |= leaves
    marks = np.flatnonzero(start & (points == 39))
    if len(marks):
        ends = bounds[np.searchsorted(bounds, marks, side="right")]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        for letters in CONTRACTIONS:
            hit = marks + len(letters) < ends
            for k, letter in enumerate(letters):
                hit &= padded[marks + 1 + k] == ord(letter)
            found = marks[hit]
            start[found + 1] = False
            after = found + 1 + len(letters)
            start[after[after < n]] = True
    return at[start], unsure


class Encoder:
    """Ids of whole texts as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str, whole: dict[bytes, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in config["added_tokens"]]
        pre = config["pre_tokenizer"] or {}
        self.known = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                      and not config["normalizer"] and config["model"].get("type") == "BPE" and not config["model"].get("dropout"))
        self.slot = {}
        self.size = np.zeros(1024, np.int64)
        self.place = np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0
        for text, token in (whole or {}).items():
            self._store([text], [[token]])

    def _store(self, texts: list[bytes], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        joined = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        at, to = len(self.slot), self.used + len(joined)
        while at + len(texts) > len(self.size):
            self.size, self.place = np.resize(self.size, 2 * len(self.size)), np.resize(self.place, 2 * len(self.place))
        while to > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[at : at + len(texts)] = sizes
        self.place[at : at + len(texts)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : to] = joined
        self.used = to
        self.slot.update(zip(texts, range(at, at + len(texts))))

    def _whole(self, texts: list[bytes], single: np.ndarray) -> list[list[int]]:
        """Ids of each text; single pre-tokens go straight to the library's model in its byte alphabet."""
        tokenize, signs = self.tokenizer.model.tokenize, BYTE_SIGNS
        return [
            [token.id for token in tokenize(text.decode("latin-1").translate(signs))] if one
            else self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
            for text, one in zip(texts, single)
        ]

    def _single(self, texts: list[bytes]) -> np.ndarray:
        """Which texts are one pre-token for sure."""
        if not self.known:
            return np.zeros(len(texts), bool)
        column = pa.array(texts, pa.binary())
        data, offsets = spans.flat(column)
        starts, unsure = split(data, offsets)
        single = (np.diff(np.searchsorted(starts, offsets)) == 1) & ~unsure
        for text in self.special:
            single &= ~pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        return single

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Pre-tokens per text, the distinct pre-tokens, and the one at each place."""
        data, offsets = spans.flat(column)
        filled = np.diff(offsets) > 0
        if self.known:
            starts, alone = split(data, offsets)
            for text in self.special:
                alone |= pc.fill_null(pc.match_substring(column, text), False).to_numpy(zero_copy_only=False)
        else:
            starts, alone = offsets[:-1][filled], np.zeros(len(column), bool)
        if alone.any():
            text = np.searchsorted(offsets, starts, side="right") - 1
            starts = starts[~alone[text] | (starts == offsets[text])]
        per_text = np.diff(np.searchsorted(starts, offsets))
        tokens = spans.strings(data, np.append(starts, len(data)), pa.binary()).dictionary_encode() if len(starts) else pa.array([], pa.binary()).dictionary_encode()
        return per_text, tokens.dictionary, tokens.indices.to_numpy()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids per text."""
        per_text, distinct, which = self.pieces(column)
        size, place, ids = self.look_up(distinct)
        lengths = size[which]
        out = ids[spans.places(place[which], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return out, np.diff(ends[bounds])

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids and their place in the third array, for each distinct pre-token."""
        values = distinct.to_pylist()
        slots = np.fromiter((self.slot.get(v, -1) for v in values), np.int64, len(values))
        missing = np.flatnonzero(slots < 0)
        if not len(missing):
            return self.size[slots], self.place[slots], self.ids
        fresh = [values[i] for i in missing]
        found = self._whole(fresh, self._single(fresh))
        room = max(0, MEMO - len(self.slot))
        kept = [i for i, v in enumerate(fresh) if len(v) <= KEPT_BYTES][:room]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        more = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        size, place = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        old = slots >= 0
        size[old], place[old] = self.size[slots[old]], self.place[slots[old]]
        size[missing], place[missing] = sizes, self.used + np.cumsum(sizes) - sizes
        ids = np.concatenate([self.ids[: self.used], more])
        if kept:
            self._store([fresh[i] for i in kept], [found[i] for i in kept])
        return size, place, ids


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
