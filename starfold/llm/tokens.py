"""Token ids of many texts at once, for a byte-level BPE vocabulary file.

The vocabulary's rule splits a text into pre-tokens that are encoded independently of each other.
Here the split is done by array operations over the code points of a block of texts, equal
pre-tokens are found by a 64-bit hash, and the library encodes each distinct one once per worker.
Texts that hold the literal of an added token go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from starfold.llm.shingles import mixed

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LONGEST_HASHED = 256
#: Bytes of remembered pre-tokens in a worker, about; beyond them all are forgotten.
KEPT_BYTES = 16 << 20
#: A longer text is encoded in slices of about so many bytes, cut where a pre-token surely starts.
SLICE = 1_000_000
_CUT = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
_PLACE = np.random.default_rng(20_240_307).integers(0, 1 << 63, LONGEST_HASHED, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def splits(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mark where pre-tokens start. ``first`` marks the first code point of each text."""
    kind = classes()[points]
    white = kind == SPACE
    new = np.empty(len(points), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= first
    blank = np.zeros(len(points), bool)
    blank[1:] = (points[:-1] == 0x20) & ~first[1:]
    start = new & (white | ~blank)
    # the last of a run of white space stands alone, or goes to what follows if it is a blank
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:]
    quote = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & (kind[1:] == LETTER) & ~first[1:])
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = np.concatenate([~first, np.zeros(2, bool)])[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1])) & inside
        start[quote[short | long] + 1] = False
        for at in (quote[short] + 2, quote[long] + 3):
            start[at[at < len(points)]] = True
    return start


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    return x if used + more <= len(x) else np.concatenate([x, np.zeros(max(len(x), more), x.dtype)])


class Encoder:
    """Ids of texts; remembers the ids of pre-tokens seen so far, in arrays of about ``KEPT_BYTES``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.alphabet = np.array([letters[b] for b in range(256)], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of known pre-tokens, sorted, and their entries
        self.ids = np.zeros(1 << 14, np.uint32)
        self.begins, self.lengths = np.zeros(1 << 12, np.int32), np.ones(1 << 12, np.int32)  # entry 0 is the lone id 0 that ends a document
        self.used, self.entries = 1, 1

    def kept_bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.slots, self.ids, self.begins, self.lengths))

    def _add(self, tokens: list[str]) -> int:
        """Encode pre-tokens; their entries follow each other from the one returned."""
        data = [t.encode() for t in tokens]
        letters = self.alphabet[np.frombuffer(b"".join(data), np.uint8)].tobytes().decode("utf-32-le")
        flat, lengths, at, tokenize = [], [], 0, self.model.tokenize
        for piece in data:
            found = tokenize(letters[at : at + len(piece)])
            at += len(piece)
            lengths.append(len(found))
            flat += [t.id for t in found]
        self.ids = _room(self.ids, self.used, len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begins, self.lengths = _room(self.begins, self.entries, len(data)), _room(self.lengths, self.entries, len(data))
        own = slice(self.entries, self.entries + len(data))
        self.lengths[own] = lengths
        self.begins[own] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.entries += len(data)
        return own.start

    def encode(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``data``: UTF-8 texts one after the other, ``ends``: where each ends. Returns all ids, each text's followed by 0, and where each ends."""
        if not (self.added and self.added.search(data)):
            return self._plain(data, ends)
        bounds = [0, *ends.tolist()]
        each = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        held = [i for i, t in enumerate(each) if self.added.search(t)]
        own = [self.whole.encode(each[i].decode("utf-8"), add_special_tokens=False).ids for i in held]
        for i in held:
            each[i] = b""
        ids, stops = self._plain(b"".join(each), np.cumsum([len(t) for t in each]))
        sizes = np.zeros(len(each), np.int64)
        sizes[held] = [len(x) for x in own]
        at = np.repeat(stops[held] - 1, sizes[held])  # before the 0 that ends the text
        return np.insert(ids, at, np.array([x for found in own for x in found], ids.dtype)), stops + np.cumsum(sizes)

    def _slices(self, data: bytes, ends: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
        """``data`` as it is, or else one text after the other in slices; the last end of a slice inside a text is no end of a text."""
        if len(data) <= 2 * SLICE:
            yield data, ends
            return
        a = 0
        for end in ends.tolist():
            while end - a > 2 * SLICE and (cut := _CUT.search(data, a + SLICE, end)):
                yield data[a : cut.start()], np.zeros(0, np.int64)
                a = cut.start()
            yield data[a:end], np.array([end - a])
            a = end

    def _plain(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        ids, stops, at = [], [], 0
        for part, own in self._slices(data, ends):
            got, upto = self._block(part, own)
            ids.append(got)
            stops.append(upto + at)
            at += len(got)
        return (ids[0], stops[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(stops)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _block(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kept_bytes() > KEPT_BYTES:
            self.clear()
        text = data.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        if n == len(data):
            stops = ends
        else:
            whole = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            stops = np.concatenate([[0], np.cumsum(whole)])[ends]
        begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        first = np.zeros(n, bool)
        first[begins[begins < n]] = True
        start = np.flatnonzero(splits(points, first)) if n else np.zeros(0, np.int64)
        stop = np.concatenate([start[1:], [n]]) if n else start
        size = stop - start
        place = np.arange(n, dtype=np.int32) - np.repeat(start.astype(np.int32), size)
        value = (points.astype(np.uint64) + np.uint64(1)) * _PLACE[np.minimum(place, LONGEST_HASHED - 1)]
        key = mixed(np.add.reduceat(value, start) + size.astype(np.uint64)) if n else np.zeros(0, np.uint64)
        del place, value
        lone = np.flatnonzero(size > LONGEST_HASHED)
        distinct, at, which = np.unique(key, return_index=True, return_inverse=True)
        near = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = near < len(self.keys)
        new[inside] = self.keys[near[inside]] != distinct[inside]
        slots = np.zeros(len(distinct), np.int32)
        slots[~new] = self.slots[near[~new]]
        if new.any():
            a, b = start[at[new]].tolist(), stop[at[new]].tolist()
            slots[new] = self._add([text[i:j] for i, j in zip(a, b, strict=True)]) + np.arange(len(a))
            self.keys, self.slots = np.insert(self.keys, near[new], distinct[new]), np.insert(self.slots, near[new], slots[new])
        token = slots[which]
        if len(lone):
            token[lone] = self._add([text[start[i] : stop[i]] for i in lone.tolist()]) + np.arange(len(lone))
        counts = np.searchsorted(start, stops)  # pre-tokens up to the end of each text
        token = np.insert(token, counts, 0)
        begin, length = self.begins[token].astype(np.int64), self.lengths[token]
        upto = np.cumsum(length)
        flat = self.ids[np.repeat(begin - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]
        return flat, upto[counts + np.arange(len(counts))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
