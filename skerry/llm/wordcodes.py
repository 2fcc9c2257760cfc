"""Token ids of whole texts, by encoding each different piece of a word once.

A tokenizer whose normaliser and splitter treat text between ASCII white space independently gives the ids of a text as its words' ids in order.
This one also splits letters from signs, so a word of Latin letters (up to U+017F, but for one whose lower case holds a mark) followed by ASCII signs (no digit, apostrophe or
control string among them) is taken as two pieces, and words that differ only in what follows them share the first. Every other word is one piece. New pieces of letters alone are encoded many at a
time, one text for all, and cut after the tokens that close a word; where their number is not that of the pieces, each is encoded by itself. Pieces are told
apart by a 64-bit hash; ids of known ones stay in one flat array of bounded size in each Python worker.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from skerry.llm.blocks import Block

KNOWN_PIECES, TOGETHER = 1_000_000, 4096
_BYTES = np.arange(256)
LETTER = (_BYTES >= 128) | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
#: Lead bytes of characters other than U+00C0 to U+017F.
FAR = (_BYTES >= 0xC0) & ~np.isin(_BYTES, (0xC3, 0xC4, 0xC5))
#: Two-byte characters among these that are no letters, or whose lower case is more than a letter: U+00D7, U+00F7, U+0130.
ODD = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
SIGN = np.isin(_BYTES, np.frombuffer(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~', np.uint8))


class WordEncoder:
    _open: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def clear(self) -> None:
        self.known, self.keys, self.recent = pd.Index(np.zeros(0, np.uint64)), np.zeros(1 << 16, np.uint64), {}
        self.start, self.ids, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the texts, their ids in that order one after another, and how many each has."""
        plain = np.fromiter((t.isalpha() and t.lower().isalpha() for t in texts), bool, len(texts))
        order, out, sizes = [], [], []
        for s in range(0, int(plain.sum()), TOGETHER):
            part = np.flatnonzero(plain)[s : s + TOGETHER]
            ids = np.array(self._encode([" ".join([texts[i] for i in part])])[0], np.uint32)
            cut = np.flatnonzero(self.closes[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                got = self._encode([texts[i] for i in part])
                ids, cut = np.concatenate([np.array(x, np.uint32) for x in got]), np.cumsum([len(x) for x in got])
            order.append(part), out.append(ids), sizes.append(np.diff(cut, prepend=0))
        alone = np.flatnonzero(~plain)
        got = self._encode([texts[i] for i in alone]) if len(alone) else []
        out += [np.array(x, np.uint32) for x in got]
        return np.concatenate([*order, alone]), np.concatenate([*out, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.fromiter(map(len, got), np.int64, len(got))])

    def _places(self, b: Block, different: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the ids of pieces stand, encoding those not known yet. ``start``, ``end``: where each is found in the block."""
        at = self.known.get_indexer(different)
        miss = np.flatnonzero(at < 0)
        at[miss] = np.fromiter((self.recent.get(h, -1) for h in different[miss].tolist()), np.int64, len(miss))
        new = miss[at[miss] < 0]
        if len(new):
            raw = b.data.tobytes()
            order, ids, size = self._ids_of([raw[s:e].decode("utf-8", "replace") for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            new = new[order]
            at[new] = np.arange(self.count, self.count + len(new))
            while len(self.keys) <= self.count + len(new) + 1:
                self.keys, self.start = (np.concatenate((x, np.zeros_like(x))) for x in (self.keys, self.start))
            while len(self.ids) < self.used + len(ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.keys[at[new]], self.start[at[new] + 1] = different[new], self.used + np.cumsum(size)
            self.ids[self.used : self.used + len(ids)] = ids
            self.used, self.count = self.used + len(ids), self.count + len(new)
            self.recent.update(zip(different[new].tolist(), at[new].tolist(), strict=True))
            if len(self.recent) > max(1 << 16, len(self.known) // 4):
                self.known, self.recent = pd.Index(self.keys[: self.count].copy()), {}
        return at

    def encode(self, b: Block, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``last`` after each, and where each text begins."""
        words = len(b.start)
        other = np.append(np.flatnonzero(~LETTER[b.data]), len(b.data))
        middle = np.minimum(other[np.searchsorted(other, b.start)], b.end) if words else b.end
        signs = np.zeros(len(b.data) + 1, np.int32)
        np.cumsum(SIGN[b.data], out=signs[1:])
        far = FAR[b.data]
        for lead, follow in ODD:
            far[:-1] |= (b.data[:-1] == lead) & (b.data[1:] == follow)
        beyond = np.zeros(len(b.data) + 1, np.int32)
        np.cumsum(far, out=beyond[1:])
        two = (beyond[middle] == beyond[b.start]) & (middle > b.start) & (middle < b.end) & (signs[b.end] - signs[middle] == b.end - middle)
        middle = np.where(two, middle, b.end)
        tail = np.flatnonzero(two)
        start, end = np.concatenate((b.start, middle[tail])), np.concatenate((middle, b.end[tail]))
        codes, different = pd.factorize(b.span(b.prefix(False), start, end))
        if self.count + len(different) > KNOWN_PIECES:
            self.clear()
        first = np.zeros(len(different), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        place = self._places(b, different, start[first], end[first])[codes]
        # Pieces in the order of the text: a word's tail after its first piece.
        order = np.empty(len(place), np.int64)
        order[np.arange(words) + np.cumsum(two) - two] = place[:words]
        order[tail + np.arange(len(tail)) + 1] = place[words:]
        doc = np.repeat(b.word_doc, 1 + two)
        size = self.start[order + 1] - self.start[order]
        before = np.cumsum(size) - size
        total = int(size.sum())
        tokens = self.ids[np.repeat(self.start[order] - before, size) + np.arange(total)]
        out = np.full(total + b.docs, last, np.uint32)
        out[np.arange(total) + np.repeat(doc, size)] = tokens
        per_doc = np.bincount(doc, size, minlength=b.docs).astype(np.int64) + 1
        return out, np.r_[0, np.cumsum(per_doc)]
