"""Token ids of a byte-level BPE vocabulary, whole batches at a time.

The texts' code points are classed and cut into pieces with array operations that follow the vocabulary's splitting
pattern; each distinct piece is merged once and kept, and the ids of a batch are gathered from that store. Texts with
characters above U+052F go through the tokenizer itself.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np

from velum.llm.arrays import byte_spans

#: Code points that end the table of classes; the splitting pattern's classes: 0 other, 1 letter, 2 number, 3 white space.
TABLE_END = 0x530
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
#: Endings that the pattern takes together with an apostrophe before them, in its order.
CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    out = np.zeros(TABLE_END, np.uint8)
    for c in range(TABLE_END):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 3 if c in WHITE else 1 if kind == "L" else 2 if kind == "N" else 0
    return out


CLASS = _classes()


class Encoder:
    """Ids of whole texts under the vocabulary file at ``path`` (a tokenizers JSON of a byte-level BPE)."""

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self._merger(path)
        self.keep = keep
        self._forget()

    @staticmethod
    def _merger(path: str):
        """Merges one piece of bytes. Such a vocabulary numbers its tokens in the order of its merges, so an id is its token's rank."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and not (token[:2] == "<|" and token[-2:] == "|>")}
        return tiktoken.Encoding("pieces", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _forget(self):
        self.known = np.zeros(0, np.uint64)  # sorted hashes of pieces
        self.first = np.zeros(0, np.int64)  # where the ids of each are in self.ids
        self.many = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def pieces(self, points: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where each piece begins, for code points of texts that begin at ``offs[:-1]``; every text's begin is one."""
        n = len(points)
        kind = CLASS[points]
        begin = np.ones(n + 1, bool)
        begin[1:n] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begin |= edge
        # White space before a text's other characters leaves its last one to them: joined if it is a space, alone if not.
        last = np.flatnonzero((kind == 3) & begin[1:] & ~edge[1:])
        begin[last] = True
        begin[last[points[last] == 32] + 1] = False
        # An apostrophe that stands alone takes an ending from the letters after it.
        quote = np.flatnonzero((points == 39) & begin[:-1] & begin[1:] & ~edge[1:])
        if len(quote):
            at = lambda i: np.where(i < n, points[np.minimum(i, n - 1)], 0)
            same = np.zeros(len(quote), np.int64)
            for end in reversed(CLITICS):
                hit = at(quote + 1) == ord(end[0])
                if len(end) == 2:
                    hit &= (at(quote + 2) == ord(end[1])) & ~edge[np.minimum(quote + 2, n)]
                same[hit] = len(end)
            took, size = quote[same > 0], same[same > 0]
            begin[took + 1] = False
            begin[took + size + 1] = True
        return np.flatnonzero(begin[:n])

    def _learn(self, pieces: list[bytes], hashes: np.ndarray):
        got = [self.merge(p) for p in pieces]
        many = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(many.sum()))
        first = len(self.ids) + np.concatenate([[0], np.cumsum(many)[:-1]])
        known = np.concatenate([self.known, hashes])
        by = np.argsort(known)
        self.known, self.first, self.many = known[by], np.concatenate([self.first, first])[by], np.concatenate([self.many, many])[by]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, one after another, and the offset of each text's ids."""
        nd = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(nd + 1, np.int64)
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data >= 0xD5, out=odd[1:])  # lead bytes from U+0540 on; U+0500 to U+052F begin with D4
        odd_row = np.diff(odd[offs]) > 0
        np.cumsum(data == 0xD4, out=odd[1:])
        odd_row |= np.diff(odd[offs]) > 0
        if odd_row.any():
            return self._mixed(data, offs, odd_row)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = data[lead].astype(np.uint32)
        two = points >= 0xC0
        points[two] = ((points[two] & 0x1F) << 6) | (data[lead[two] + 1] & 0x3F)
        doc_at = np.searchsorted(lead, offs)
        begin = self.pieces(points, doc_at)
        s = lead[begin]
        e = np.concatenate([s[1:], [len(data)]])
        h = byte_spans(data).of(s, e)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(s[first[new]], e[first[new]], strict=True)], uniq[new])
        at = np.searchsorted(self.known, uniq)[inverse]
        many, src = self.many[at], self.first[at]
        ends = np.cumsum(many)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(src - (ends - many), many)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(s, offs)]

    def _mixed(self, data: np.ndarray, offs: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, raw = [], data.tobytes()
        for i in range(len(offs) - 1):
            a, b = offs[i], offs[i + 1]
            if odd[i]:
                parts.append(np.asarray(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self.encode(data[a:b], np.asarray([0, b - a]))[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
