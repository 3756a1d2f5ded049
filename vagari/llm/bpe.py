"""Byte-level BPE ids of whole texts by the tokenizers library, with a memory of units.

A byte-level pre-tokenizer always starts a new piece where a space follows a
character that isn't white space, and where ASCII punctuation follows a letter.
Texts are cut there; each distinct unit is encoded once by the library and its
ids are looked up after that, so ids equal those of whole texts. A unit of
letters is one piece and goes straight to the library's model; the others pass
its pre-tokenizer. Texts with white space beyond ASCII are encoded whole. Where
a text has the string of one of the vocabulary's added tokens, it is cut before
and after it, as the library does. Units are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .kernels import SPACES, U, chunks, edges, span_hashes

KEEP = 1 << 19  # units that a worker remembers
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_open: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, added: bool = True) -> "Encoder":
    """One per Python worker and file. With added=False the strings of added tokens are ordinary text."""
    if (path, added) not in _open:
        _open[path, added] = Encoder(path, added)
    return _open[path, added]


def _byte_chars() -> np.ndarray:
    """The code point that byte-level vocabularies write for a byte: its own if printable in Latin-1, else the next from U+0100 on."""
    out = np.arange(256, dtype="<u4")
    rest = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    out[rest] = 256 + np.arange(len(rest))
    return out


def _letters(buf: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF without the two signs among these."""
    out = ASCII_LETTER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def odd_space(buf: np.ndarray) -> np.ndarray:
    """Where a white-space character beyond ASCII begins (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000)."""
    if len(buf) < 2:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero(((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))[:-1])
    a, b, c = buf[lead], buf[lead + 1], buf[np.minimum(lead + 2, len(buf) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    rest = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return lead[two | general | rest]


class Encoder:
    def __init__(self, path: str, added: bool = True):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        tokens = self.tok.get_added_tokens_decoder().values()
        apart = [t for t in tokens if added or not t.special]
        if any(t.lstrip or t.rstrip or t.single_word for t in apart):
            raise ValueError("an added token takes white space or asks for word ends around it: texts can't be cut there")
        strings = sorted((t.content.encode() for t in apart), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        n = self.tok.get_vocab_size()
        self.bytes_of = np.array([len(self.tok.id_to_token(i) or "") for i in range(n)], np.int64)
        self.byte_chars = _byte_chars()
        self.kind = np.uint16 if n <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n, self.pool = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, letters: np.ndarray, s: np.ndarray, e: np.ndarray, whole: np.ndarray) -> None:
        """Encode the units that aren't known and remember their ids."""
        dark = ~SPACES[buf]
        spaced = (buf[s] == 0x20) & (e - s > 1) & dark[np.minimum(s + 1, len(buf) - 1)]
        upto = np.concatenate(([0], np.cumsum(letters)))
        pure = ~whole & (upto[e] - upto[s] == e - s - spaced) & (e - s > spaced)
        easy = ~whole & ~pure & dark[e - 1] & (spaced | dark[s])
        order = np.flatnonzero(easy)
        starts, counts = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        pools, base = [], len(self.pool)
        if len(order):
            extra = (~spaced[order]).astype(np.int64)  # a line end before a unit that begins without a space
            size = (e - s)[order]
            ends = np.cumsum(size + extra)
            joined = np.full(ends[-1], 10, np.uint8)
            to = np.repeat(ends - size - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            joined[to] = buf[np.repeat(s[order] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            ids = self._ids(joined.tobytes().decode())
            upto = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(upto, ends)
            first = np.concatenate(([0], last[:-1] + 1)) + extra
            if upto[-1] != ends[-1] or (upto[last] != ends).any():
                raise ValueError("the vocabulary is not byte-level: units can't be told apart")
            starts[order], counts[order] = base + first, last + 1 - first
            pools.append(ids)
            base += len(ids)
        if pure.any():
            chars, model, ids, ends = self.byte_chars[buf].tobytes().decode("utf-32-le"), self.tok.model.tokenize, [], []
            for a, b in zip(s[pure].tolist(), e[pure].tolist(), strict=True):
                ids += [t.id for t in model(chars[a:b])]
                ends.append(len(ids))
            first = np.array([0, *ends])
            starts[pure], counts[pure] = base + first[:-1], np.diff(first)
            pools.append(np.array(ids, self.kind))
            base += len(ids)
        for i in np.flatnonzero(~easy & ~pure):
            ids = self._ids(buf[s[i] : e[i]].tobytes().decode())
            starts[i], counts[i] = base, len(ids)
            pools.append(ids)
            base += len(ids)
        self.pool = np.concatenate([self.pool, *pools])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, starts), np.insert(self.n, place, counts)

    def _parts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the texts and of the added tokens in them, and which of these parts are tokens. No token crosses the end of a text."""
        spans = [m.span() for m in self.added.finditer(buf.tobytes())] if self.added else []
        if spans:
            a, b = np.array(spans, np.int64).T
            inside = np.searchsorted(offs, a, "right") == np.searchsorted(offs, b, "left")
            if not inside.all():  # the last bytes of one text and the first of the next look like a token
                return self._parts_by_text(buf, offs)
            parts = np.union1d(offs, np.concatenate([a, b]))
            return parts, np.searchsorted(parts, a)
        return np.unique(offs), np.zeros(0, np.int64)

    def _parts_by_text(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = [(lo + m.start(), lo + m.end()) for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in self.added.finditer(buf[lo:hi].tobytes())]
        parts = np.union1d(offs, np.array(spans, np.int64).ravel())
        return parts, np.searchsorted(parts, np.array([a for a, _ in spans], np.int64))

    def encode_chunk(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        n = len(buf)
        if not n:
            return np.zeros(0, self.kind), np.zeros(len(offs) - 1, np.int64)
        parts, apart = self._parts(buf, offs)
        first = edges(parts, n)
        cut = buf == 0x20
        cut[1:] &= ~SPACES[buf[:-1]]
        letters = _letters(buf)
        cut[1:] |= PUNCT[buf[1:]] & letters[:-1]
        cut[0] = False
        odd = np.union1d(np.searchsorted(parts, odd_space(buf), "right") - 1, apart)
        for d in odd:
            cut[parts[d] : parts[d + 1]] = False
        s = np.flatnonzero(cut | first[:-1])
        e = np.append(s[1:], n)
        keys, where, back = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.keys) > KEEP:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if new.any():
            w = where[new]
            whole = np.isin(np.searchsorted(parts, s[w], "right") - 1, odd)
            self._learn(keys[new], buf, letters, s[w], e[w], whole)
            place = np.searchsorted(self.keys, keys)
        at, count = self.at[place][back].astype(np.int64), self.n[place][back].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(at - (ends - count), count) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))
        by_text = upto[np.searchsorted(s, offs)]
        return ids, np.diff(by_text)

    def encode(self, column: pa.Array):
        """(first row, ids, counts) for consecutive rows of a string column; null is empty."""
        for lo, _, buf, offs in chunks(column):
            yield lo, *self.encode_chunk(buf, offs)
