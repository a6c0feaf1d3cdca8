"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, documents, table

#: Bits of a fingerprint, and blocks of 16 bits that it is cut into.
BITS, CHUNKS = 64, 4
#: Chance that a window just similar enough is farther from its item than the item's radius, and the largest radius that is
#: looked up: beyond it a fifth of all fingerprints would be near, so such items are compared with every window.
MISSED, RADIUS = 1e-6, 28
#: Bytes of items in one pass over the documents; a larger benchmark is taken in several passes.
ITEM_BYTES = 32 << 20
#: Places that are fingerprinted at a time, if an item has not more, and windows that are looked up at a time.
STRETCH, LOOKUPS = 4096, 256


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Each shingle's 64 signs, one row each."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(signs: np.ndarray, heads: np.ndarray, size: int) -> np.ndarray:
    """SimHash of windows of ``size`` shingles that begin at ``heads``, by sums over prefixes."""
    total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
    return np.packbits(total[heads + size] - total[heads] > 0, axis=1, bitorder="little").view("<u8").ravel()


def _block(prints: np.ndarray, chunk: int) -> np.ndarray:
    return (prints >> np.uint64(16 * chunk)).astype(np.uint16)


def radii(sums: np.ndarray, size: int, most: np.ndarray, percent: int, missed: float = MISSED) -> np.ndarray:
    """For items of ``size`` shingles, by the sums of their 64 bits: the distance that similar windows' fingerprints keep.

    A window of as many shingles that is similar enough lacks at most r of an item's and has as many others. So each sum
    moves by r random signs of the item's own, ``most`` of one kind at most, and by r of others; a bit flips if that
    outweighs the sum. The distance is the sum of 64 such chances, and the radius the least that it exceeds with a chance
    of ``missed`` at most. Where r is 0, only the same shingles are similar enough, and the radius is 0.
    """
    r = (100 - percent) * size // (100 + percent)
    if not r:
        return np.zeros(len(sums), np.int64)
    spread = np.sqrt(r * np.minimum(most, r) + r)[:, None]
    over = np.abs(sums) * (1 - r / size) / spread
    flips = np.array([math.erfc(x) for x in (over / math.sqrt(2)).ravel()]).reshape(over.shape) / 2
    chance = np.zeros((len(sums), BITS + 1))
    chance[:, 0] = 1
    for bit in range(BITS):
        q = flips[:, bit : bit + 1]
        chance[:, 1:] = chance[:, 1:] * (1 - q) + chance[:, :-1] * q
        chance[:, :1] *= 1 - q
    more = 1 - np.cumsum(chance, axis=1)
    return np.minimum((more > missed).sum(1) + 1, BITS)


class HammingIndex:
    """Fingerprints of items, each with its radius, sorted by each of their four blocks of 16 bits.

    Fingerprints at most ``radius`` bits apart have some block at most ``radius // 4`` bits apart, so looking every
    block up with all its neighbours up to that distance finds all of them. Where the items are fewer than these lookups
    would be, a fingerprint is compared with each of them.
    """

    def __init__(self, prints: np.ndarray, radius: int | np.ndarray):
        self.prints, self.radius = prints, np.broadcast_to(np.asarray(radius, np.int64), prints.shape)
        values = np.arange(1 << 16, dtype=np.uint16)
        self.masks = values[np.bitwise_count(values) <= int(self.radius.max(initial=0)) // CHUNKS]
        self.few = len(prints) <= CHUNKS * len(self.masks)
        if not self.few:
            self.orders = [np.argsort(_block(prints, c), kind="stable") for c in range(CHUNKS)]
            self.values = [_block(prints, c)[order] for c, order in enumerate(self.orders)]

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``prints``, item) of all items within their radius of each."""
        if self.few:
            return np.nonzero(np.bitwise_count(self.prints ^ prints[:, None]) <= self.radius)
        windows, items = [], []
        for c in range(CHUNKS):
            wanted = _block(prints, c)[:, None] ^ self.masks
            low, high = (np.searchsorted(self.values[c], wanted.ravel(), side) for side in ("left", "right"))
            n = high - low
            hit = np.flatnonzero(n)
            at = np.repeat(low[hit] - np.cumsum(n[hit]) + n[hit], n[hit]) + np.arange(n[hit].sum())
            windows.append(np.repeat(hit // len(self.masks), n[hit]))
            items.append(self.orders[c][at])
        window, item = np.concatenate(windows), np.concatenate(items)
        near = np.bitwise_count(self.prints[item] ^ prints[window]) <= self.radius[item]
        pairs = np.unique(np.stack([window[near], item[near]]), axis=1)
        return pairs[0], pairs[1]


def repeats(hashes: np.ndarray, most: np.ndarray, size: int, windows: int) -> np.ndarray:
    """Flags of windows of ``size`` places that have a shingle more often than ``most`` says of it."""
    order = np.argsort(hashes, kind="stable")
    own, limit = hashes[order], most[order]
    later = np.minimum(np.arange(len(own)) + limit, len(own) - 1)
    again = (np.arange(len(own)) + limit < len(own)) & (own[later] == own)
    low, high = order[later][again] - size + 1, order[again]
    low = np.maximum(low, 0)
    keep = low <= np.minimum(high, windows - 1)
    change = np.bincount(low[keep], minlength=windows + 1) - np.bincount(np.minimum(high[keep], windows - 1) + 1, minlength=windows + 1)
    return np.cumsum(change[:windows]) > 0


def shared_counts(places: np.ndarray, hashes: np.ndarray, most: np.ndarray, size: int, windows: int) -> tuple[int, np.ndarray]:
    """For windows of ``size`` places the sum over an item's shingles of the smaller count: (first window, sums from there on).

    ``places`` are ascending places of the item's shingles in a text, ``hashes`` which ones, ``most`` how often the item has
    them. A place counts in the windows that hold it but not the place of the same shingle ``most`` times before. So each
    adds one to a range of windows, and all sums come from one pass over the ranges' ends.
    """
    order = np.argsort(hashes, kind="stable")
    at, own = places[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    limit = most[order]
    earlier = np.where(rank >= limit, at[np.maximum(np.arange(len(at)) - limit, 0)], -1)
    low = np.maximum(np.maximum(earlier + 1, at - size + 1), 0)
    high = np.minimum(at, windows - 1)
    low, high = low[low <= high], high[low <= high]
    if not len(low):
        return 0, np.zeros(1, np.int64)
    begin, end = int(low.min()), int(high.max())
    change = np.bincount(low - begin, minlength=end - begin + 2) - np.bincount(high + 1 - begin, minlength=end - begin + 2)
    return begin, np.cumsum(change[:-1])


class Benchmark:
    """Items of a benchmark, prepared for search; items without words are left out."""

    def __init__(self, items: list[tuple], k: int, percent: int, radius: int):
        self.k, self.percent = k, percent
        raw = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        found = W.find(np.frombuffer(b"".join(raw), np.uint8), offsets, W.ALNUM)
        counts = np.diff(found.first)
        self.ids = [i for (i, _), n in zip(items, counts, strict=True) if n]
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        sizes, sums = [], []
        # items by (words in a shingle, shingles); short items are one shingle of all their words
        groups: dict[tuple[int, int], list[int]] = {}
        owned: dict[int, list[tuple[np.ndarray, int]]] = {}
        for row in np.flatnonzero(counts).tolist():
            a, b = found.first[row], found.first[row + 1]
            one = W.Words(found.start[a:b], found.end[a:b], np.zeros(b - a, int), np.array([0, b - a]), found.hash[a:b])
            width = min(k, int(b - a))
            hashes, _ = W.shingles(one, width)
            item = len(self.bags)
            self.bags.append(np.unique(hashes, return_counts=True))
            sizes.append(len(hashes))
            groups.setdefault((width, len(hashes)), []).append(item)
            owned.setdefault(width, []).append((self.bags[-1][0], item))
            sums.append(_sums(hashes))
        self.sizes = np.array(sizes, np.int64)
        self.groups = {key: np.array(members) for key, members in groups.items()}
        #: Items whose radius is beyond the largest one; they are compared with every window that shares enough places.
        self.wide = np.zeros(len(sizes), bool)
        self.index = {}
        for (width, size), members in self.groups.items():
            own = np.array([sums[i] for i in members])
            heaviest = np.array([self.bags[i][1].max() for i in members])
            far = radii(own, size, heaviest, percent)
            self.wide[members] = far > radius
            prints = np.packbits(own > 0, axis=1, bitorder="little").view("<u8").ravel()
            self.index[width, size] = HammingIndex(prints, np.where(far > radius, -1, far))
        #: By width: all items' shingles in order, and the items that have each, laid end to end with their bounds.
        self.anchors = {}
        for width, own in owned.items():
            hashes, items_ = np.concatenate([h for h, _ in own]), np.repeat([i for _, i in own], [len(h) for h, _ in own])
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            counts_ = np.concatenate([self.bags[i][1] for _, i in own])[order]
            self.anchors[width] = known, items_[order], np.append(first, len(order)), np.maximum.reduceat(counts_, first)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple]]:
        """By row: (item, similarity, first word of the best window, words in it) of each item found in the text.

        A window that is similar enough shares shingles with its item, so only windows with as many places of items'
        shingles as the similarity takes are fingerprinted; no other window could be verified.
        """
        found = W.find(data, offsets, W.ALNUM)
        out: dict[int, dict[int, tuple]] = {}
        for width, (known, _, _, _) in self.anchors.items():
            hashes, heads = W.shingles(found, width)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes)
            if not len(hit):
                continue
            rows = found.row[heads]
            first = np.searchsorted(rows, np.arange(len(offsets)))
            cut = np.flatnonzero(np.concatenate([[True], rows[hit[1:]] != rows[hit[:-1]]]))
            for own in np.split(hit, cut[1:]):
                row = int(rows[own[0]])
                a, b = int(first[row]), int(first[row + 1])
                self._search(width, hashes[a:b], own - a, at[own], out.setdefault(row, {}))
        return {row: [(self.ids[i], *best) for i, best in sorted(items.items())] for row, items in out.items() if items}

    def _search(self, width: int, hashes: np.ndarray, hit: np.ndarray, which: np.ndarray, best: dict[int, tuple]) -> None:
        """Items found in one text of shingles; its places ``hit`` have the items' shingles ``which``."""
        _, owners, bounds, often = self.anchors[width]
        n = len(hashes)
        most = np.ones(n, np.int64)
        most[hit] = often[which]
        many = bounds[which + 1] - bounds[which]
        total = np.cumsum(many)
        item = owners[np.repeat(bounds[which] - total + many, many) + np.arange(total[-1])]
        place = np.repeat(hit, many)
        order = np.argsort(item, kind="stable")  # by item, places ascending
        item, place = item[order], place[order]
        size_of = self.sizes[item]
        for m in np.unique(size_of).tolist():
            own = size_of == m
            size = min(m, n)  # a shorter text is one window
            # both and either sum up to size + m, so a similar window has so many places with the item's shingles
            need = -(-self.percent * (size + m) // (100 + self.percent))
            held = np.zeros(n + 1, np.int64)
            held[place[own] + 1] = 1
            held = np.cumsum(held)
            starts = np.flatnonzero(held[size:] - held[: n - size + 1] >= need)
            if not len(starts):
                continue
            items, first, counts = np.unique(item[own], return_index=True, return_counts=True)
            wide = self.wide[items]
            # the radius holds for windows as long as the item that repeat no shingle but as items do; others are all verified
            if size < m or repeats(hashes, most, size, n - size + 1)[starts].any():
                wide[:] = True
            if not wide.all():
                wide |= np.isin(items, self._near(width, m, hashes, starts, size))
            for i in np.flatnonzero(wide & (counts >= need)).tolist():
                places = place[own][first[i] : first[i] + counts[i]]
                self._verify(int(items[i]), width, hashes, places, size, m, best)

    def _near(self, width: int, m: int, hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Items of m shingles whose fingerprints are within the radius of those of windows."""
        found = [np.empty(0, np.int64)]
        index, members = self.index[width, m], self.groups[width, m]
        low = 0
        while low < len(starts):
            # signs only of the stretch that these windows need
            high = int(np.searchsorted(starts, starts[low] + max(STRETCH, size)))
            some = starts[low:high]
            prints = fingerprints(_signs(hashes[some[0] : some[-1] + size]), some - some[0], size)
            found += [members[index.search(prints[i : i + LOOKUPS])[1]] for i in range(0, len(prints), LOOKUPS)]
            low = high
        return np.unique(np.concatenate(found))

    def _verify(self, item: int, width: int, hashes: np.ndarray, places: np.ndarray, size: int, m: int, best: dict[int, tuple]) -> None:
        """Takes the best window of an item, if it is similar enough."""
        own, counts = self.bags[item]
        begin, both = shared_counts(places, hashes[places], counts[np.searchsorted(own, hashes[places])], size, len(hashes) - size + 1)
        top = int(both.argmax())
        same, either = int(both[top]), size + m - int(both[top])
        if 100 * same >= self.percent * either:
            best[item] = (same / either, begin + top, size + width - 1)


def _sums(hashes: np.ndarray) -> np.ndarray:
    """The sums of these shingles' signs; a fingerprint's bits are the positive ones."""
    total = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), STRETCH):
        total += _signs(hashes[low : low + STRETCH]).sum(0)
    return total


def _passes(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The items in parts of about ``limit`` bytes, each small enough for every task."""
    items = benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // limit))
    for part in range(parts):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_id").collect()]


#: A worker's latest prepared benchmark, by the name that its call gave it.
_LATEST: dict[str, Benchmark] = {}


def _prepared(options: tuple) -> Callable[[], Benchmark]:
    """Makes the index once in a worker, whatever the number of its tasks."""
    name = uuid.uuid4().hex

    def get() -> Benchmark:
        if name not in _LATEST:
            _LATEST.clear()
            _LATEST[name] = Benchmark(*options)
        return _LATEST[name]

    return get


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    radius: int = RADIUS,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word, n_words.

    Words are runs of letters, digits and characters that are not ASCII, A-Z lower-cased. A window has as many k-word
    shingles as the item. Candidates are the windows whose SimHash, weighted by how often a shingle occurs, is within the
    item's radius, by a multi-index over the fingerprints' blocks; the radius follows from the item's weights and from
    ``percent``, so that a similar window is beyond it with a chance of 1e-6 at most (``radii``). Where that does not hold,
    all windows that share as many places as the similarity takes are candidates: items whose radius is above ``radius``,
    windows that repeat a shingle more often than items do, and texts shorter than the item. The weighted Jaccard
    similarity of the shingles, sum of smaller counts over sum of larger
    ones, must be ``percent`` or more; it is computed for all windows of an item in time linear in the text. Of an item's
    windows in a document the best is returned, ties by the first. Documents are scanned once per ``item_bytes`` of
    benchmark, without a shuffle. Rows of the benchmark that repeat an id are items of their own.

    Items of fewer than k words have all their words as their only shingle; a text that is shorter than an item is one
    window. Null or empty texts, on either side, match nothing. Null ids and repeated rows or ids are kept as they
    are; other columns are ignored, whatever their names. If either table is empty, so is the result.
    """
    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    out = None
    for items in _passes(benchmark, item_id_col, item_text_col, item_bytes):
        use = _prepared((items, k, percent, radius))

        def scan(batches: Iterator[pa.RecordBatch], use=use) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in blocks(batch):
                    found = [(row, *hit) for row, hits in sorted(use().hits(data, offsets).items()) for hit in hits]
                    if found:
                        rows, ids, shares, firsts, sizes = zip(*found, strict=True)
                        values = [part.column(0).take(pa.array(rows)), pa.array(ids), pa.array(shares), pa.array(firsts), pa.array(sizes)]
                        yield pa.RecordBatch.from_arrays(values, names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        one = source.mapInArrow(scan, f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80, radius: int = RADIUS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with all its columns, without the rows in which ``benchmark_hits`` finds an item; one scan, no join."""
    out = docs
    at = docs.columns.index(text_col)
    for items in _passes(benchmark, item_id_col, item_text_col, item_bytes):
        use = _prepared((items, k, percent, radius))

        def clean(batches: Iterator[pa.RecordBatch], use=use) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in blocks(batch, batch.schema.names[at]):
                    hit = use().hits(data, offsets)
                    yield part.take(pa.array([i for i in range(part.num_rows) if i not in hit], pa.int64()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: a row for each document and item found in it."""
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
