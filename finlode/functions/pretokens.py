"""Byte-level BPE of many texts at once, by the tokenizers library.

A byte-level BPE first cuts a text at a fixed pattern and then encodes each piece by itself. The cuts
are found here for a whole block of texts in numpy; only pieces not seen before go through the library.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from .hashing import mix, weights

#: Texts with a character from here on go through the library whole: their classes differ between Unicode versions.
FIRST_RARE = 0x3000
#: Pieces remembered by a worker; beyond that it starts anew.
REMEMBERED = 1 << 20

LETTER, NUMBER, OTHER, SPACE = range(4)
_TABLE: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point below FIRST_RARE in the cutting pattern."""
    global _TABLE
    if _TABLE is None:
        spaces = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, *range(0x2000, 0x200B)}
        kinds = {"L": LETTER, "N": NUMBER}
        _TABLE = np.array(
            [SPACE if c in spaces else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(FIRST_RARE)], np.uint8
        )
    return _TABLE


def cuts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts of code points laid end to end; offsets are the texts' bounds.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+`` for letters L, numbers N
    and other solid characters O.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[offsets] = True  # the last entry is the end of the block
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[head[:-1]] = 255
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 255, kind[1:]
    after[head[1:]] = 255
    blank = points == 32
    blank_before = np.zeros(n, bool)
    blank_before[1:] = blank[:-1]
    blank_before &= before == SPACE
    solid, space = kind != SPACE, kind == SPACE
    # a run of solid characters begins with the blank before it, if there is one
    begin = solid & (kind != before) & ~blank_before
    # a run of white space begins where it does, and its last character is apart if something solid follows
    begin |= space & ((before != SPACE) | ((after != SPACE) & (after != 255)))
    # contractions
    quote = np.flatnonzero((points == 39) & begin & (after == LETTER))
    if len(quote):
        one = points[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~head[far], points[far], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[(rest < n) & ~head[np.minimum(rest, n)]]
        begin[rest] |= kind[rest] == LETTER
    return np.flatnonzero(begin)


def _stand_ins() -> dict[int, int]:
    """Printable Latin-1 bytes stand for themselves, the others for characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


STAND_IN = _stand_ins()


class Encoder:
    """Texts to ids: exactly what the tokenizer's ``encode(text, add_special_tokens=False)`` gives.

    The tokenizer must be a byte-level BPE with the pattern of ``cuts`` and no normaliser.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: What the library looks for in a text before it cuts it; a text with any of these goes through it whole.
        self.added = [x.content for x in added]
        #: Whether a text can be cut at white space: no added token has any in it or takes any beside it.
        self.cuttable = not any(x.lstrip or x.rstrip or x.content.split() != [x.content] for x in added)
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that are cut already; the library's model takes each byte as its printable stand-in."""
        model = self.tokenizer.model
        return [[y.id for y in model.tokenize(x.encode().decode("latin-1").translate(STAND_IN))] for x in pieces]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and the texts' bounds."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) for x in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(points >= FIRST_RARE), "right") - 1)
        if added := [x for x in self.added if x in joined]:
            rows = np.union1d(rows, [i for i, x in enumerate(texts) if any(a in x for a in added)]).astype(np.int64)
        if len(rows):
            whole = dict(zip(rows.tolist(), self.plain([texts[i] for i in rows]), strict=True))
            ids, bounds = self.encode(["" if i in whole else x for i, x in enumerate(texts)])
            parts = [np.array(whole[i], np.uint32) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        begin = cuts(points, offsets)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        size = np.diff(np.append(begin, len(points)))
        place = np.arange(len(points)) - np.repeat(begin, size)
        terms = mix(points.astype(np.uint64) + np.uint64(1)) * weights(place)
        hashes, first, which = np.unique(mix(np.add.reduceat(terms, begin)), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero((at == len(self.known)) | (np.append(self.known, np.uint64(0))[at] != hashes))
        if len(new):
            pieces = [joined[b : b + s] for b, s in zip(begin[first[new]].tolist(), size[first[new]].tolist(), strict=True)]
            found = self.pieces(pieces)
            old = len(self.bounds) - 1
            lengths = np.array([len(x) for x in found], np.int64)
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            self.place = np.insert(self.place, at[new], old + np.arange(len(new)))
            self.known = np.insert(self.known, at[new], hashes[new])
        entry = self.place[np.searchsorted(self.known, hashes)][which]
        lengths = self.bounds[entry + 1] - self.bounds[entry]
        total = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(self.bounds[entry] - total[:-1], lengths) + np.arange(total[-1])
        return self.ids[source], total[np.searchsorted(begin, offsets)]


    def parts(self, text: str, limit: int) -> Iterator[str]:
        """The text in parts of about ``limit`` characters, which encode by themselves to what the whole text encodes to.

        A part ends at a solid character before white space: no piece holds both, and what follows is cut the same
        way whatever is before it. Only where there is no such place within ``limit`` is a part longer.
        """
        low, size = 0, limit
        while self.cuttable and len(text) - low > size:
            points = np.frombuffer(text[low : low + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = classes()[np.minimum(points, FIRST_RARE - 1)]
            plain = points < FIRST_RARE
            ends = np.flatnonzero((kind[:-1] != SPACE) & (kind[1:] == SPACE) & plain[:-1] & plain[1:])
            if len(ends):
                yield text[low : low + int(ends[-1]) + 1]
                low, size = low + int(ends[-1]) + 1, limit
            else:
                size *= 2
        yield text[low:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


assert sys.byteorder == "little", "ids are written as they lie in memory"
