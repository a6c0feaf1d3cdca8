"""Tables of questions against blocks of documents: a task reads whole blocks and keeps only the best of each question.

A block is a row that holds all lists of its documents, packed. Tasks scan blocks where they lie, a shelf of some
thousand documents at a time, so no pair of a question and a document, and no list, is ever a row that is shuffled. What
leaves a task are the k best of each question over all that the task reads.

Scores are whole numbers below 2^53, kept as doubles, so that sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents and words of a shelf, which ends with the block that reaches one; cells (question, document) of one pass; bytes of the dense rows of a shelf's common terms.
SHELF, WORDS, CELLS, DENSE = 8192, 1 << 22, 1 << 21, 1 << 26
#: Pairs that are looked up at once. A term is common if it is in a document of this many.
PAIRS, COMMON = 1 << 20, 32
#: Terms whose bounds together are below this share of what a question needs give no candidates.
SHARE = 0.35


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def packed(**columns: pa.Array | np.ndarray) -> bytes:
    """Columns of one length as a compressed stream."""
    batch = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(narrow(x)) for x in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes | pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(data.as_py() if isinstance(data, pa.Scalar) else data)).read_next_batch()


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 and so on, ``size`` of each."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place, values, n).astype(np.float64, copy=False)


def stretches(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes are ``most`` together, or little more than that."""
    if len(size):
        ends = np.cumsum(size)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, max(int(ends[-1]), 1), most))).tolist()
        yield from zip(cuts, [*cuts[1:], len(size)], strict=True)


@dataclass
class Questions:
    """Questions as numbers of terms; each one's terms lie together, the most common first.

    ``limits``: for each facet, the number of a question's list of values (-1 without one), all values that lists have, and
    sorted keys list * values + value.
    """

    keys: pa.Array
    vocabulary: pa.Array
    idf: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    limits: list[tuple[np.ndarray, pa.Array, np.ndarray]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.keys)


def limit(lists: list[list[str] | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A facet of questions from the values that each allows."""
    known: dict[tuple, int] = {}
    own = np.array([-1 if x is None else known.setdefault(tuple(x), len(known)) for x in lists], np.int64)
    values = sorted({v for x in known for v in x if v is not None})
    place = {v: i for i, v in enumerate(values)}
    keys = np.array(sorted({n * len(values) + place[v] for x, n in known.items() for v in x if v is not None}), np.int64)
    return own, pa.array(values, pa.string()), keys


def _named(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist())


class Shelf:
    """Some blocks' documents: the lists of the terms that questions have, in order of terms and documents."""

    def __init__(self, blocks: list[dict], asked: Questions):
        codes, rows, counts, places, ids, lengths, facts, base = [], [], [], [], [], [], [], 0
        for block in blocks:
            docs, terms, entries = unpacked(block["ids"]), unpacked(block["terms"]), unpacked(block["entries"])
            size = numbers(terms, "size")
            code = pc.fill_null(pc.index_in(terms.column("term"), value_set=asked.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            own = np.flatnonzero(code >= 0)
            take = expanded(start[own], size[own])
            codes.append(np.repeat(code[own], size[own]))
            rows.append(numbers(entries, "row")[take] + base)
            counts.append(numbers(entries, "count"))
            if "places" in block:
                many = counts[-1]
                first = np.cumsum(many) - many
                places.append(numbers(unpacked(block["places"]), "place")[expanded(first[take], many[take])])
            counts[-1] = counts[-1][take]
            ids.append(docs.column("id"))
            lengths.append(numbers(docs, "length"))
            facts.append(block.get("facts"))
            base += docs.num_rows
        self.docs = base
        self.ids, self.length = _named(pa.concat_arrays(ids)), np.concatenate(lengths)
        code, row, count = np.concatenate(codes), np.concatenate(rows), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        self.row, self.count = row[order], count[order]
        code = code[order]
        if places:
            first = np.cumsum(count) - count
            self.places = np.concatenate(places)[expanded(first[order], count[order])]
            self.first = np.cumsum(self.count) - self.count
        #: By term of the vocabulary: where its list begins and its length.
        self.size = np.bincount(code, minlength=len(asked.vocabulary))
        self.start = np.cumsum(self.size) - self.size
        self.code = code
        self.facts = facts if facts[0] is not None else None
        self.sizes = [x["docs"] for x in blocks]
        self.shown: list[np.ndarray] | None = None

    def scored(self, asked: Questions, mean: float, k1: float, b: float, unit: int) -> None:
        """Each entry's part of a score, each term's largest, and dense rows of the common terms."""
        tf, idf = self.count.astype(np.float64), asked.idf[self.code]
        self.part = np.floor(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * self.length[self.row] / mean)) * unit + 0.5)
        self.most = np.zeros(len(asked.vocabulary))
        own = np.flatnonzero(self.size)
        if len(own):
            self.most[own] = np.maximum.reduceat(self.part, self.start[own])
        self.dense_of = np.full(len(asked.vocabulary), -1, np.int64)
        common = np.flatnonzero(self.size * COMMON >= max(self.docs, COMMON))
        common = common[np.argsort(-self.size[common], kind="stable")][: min(1 << 14, max(1, DENSE // (8 * max(self.docs, 1))))]
        self.dense_of[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.docs))
        take = expanded(self.start[common], self.size[common])
        self.dense[np.repeat(np.arange(len(common)), self.size[common]), self.row[take]] = self.part[take]
        self.key = self.code * self.docs + self.row

    def parts(self, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """What terms add to documents' scores, 0 for those that a document lacks."""
        out = np.zeros(len(code))
        near = self.dense_of[code]
        own = np.flatnonzero(near >= 0)
        out[own] = self.dense[near[own], doc[own]]
        own = np.flatnonzero((near < 0) & (self.size[code] > 0))
        at = self.entry(code[own], doc[own])
        out[own[at >= 0]] = self.part[at[at >= 0]]
        return out

    def entry(self, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where the lists have documents, -1 where they lack them."""
        want = code * self.docs + doc
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == want, at, -1) if len(self.key) else np.full(len(want), -1)

    def allowed(self, asked: Questions, question: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which pairs the questions' limits allow; a document without facts is never allowed."""
        if self.facts is None:
            return np.ones(len(question), bool)
        if self.shown is None:
            rows = pa.concat_arrays([x.field("row") for x in self.facts]).to_numpy().astype(np.int64)
            base = np.repeat(np.cumsum([0, *self.sizes[:-1]]), [len(x) for x in self.facts])
            self.shown = [np.zeros(self.docs, bool)]
            self.shown[0][rows + base] = True
            for n, (_, values, _) in enumerate(asked.limits):
                own = pa.concat_arrays([x.field(n + 1) for x in self.facts])
                found = np.full(self.docs, -1, np.int64)
                found[rows + base] = pc.fill_null(pc.index_in(own, value_set=values), -1).to_numpy(zero_copy_only=False)
                self.shown.append(found)
        out = self.shown[0][doc]
        for (lists, values, keys), found in zip(asked.limits, self.shown[1:], strict=True):
            wanted, value = lists[question], found[doc]
            want = wanted * len(values) + value
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            out &= (wanted < 0) | ((value >= 0) & (keys[at] == want if len(keys) else False))
        return out


class Best:
    """The k best of each question so far, by score and then by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -1.0)
        self.ids: np.ndarray | None = None

    @property
    def need(self) -> np.ndarray:
        """The score of each question's last one, -1 as long as there are fewer."""
        return self.score[:, -1]

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(score >= self.need[question])
        if not len(keep):
            return
        question, score, ids = question[keep], score[keep], ids[keep]
        if self.ids is None:
            self.ids = np.zeros(self.score.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        own = np.unique(question)
        old = self.score[own] >= 0
        q, s, i = np.concatenate([question, np.repeat(own, old.sum(1))]), np.concatenate([score, self.score[own][old]]), np.concatenate([ids, self.ids[own][old]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.score[own] = -1
        self.score[q[keep], rank[keep]], self.ids[q[keep], rank[keep]] = s[keep], i[keep]

    def rows(self, keys: pa.Array, kind: pa.DataType) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        q, at = np.nonzero(self.score >= 0)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(q)), pa.array(self.ids[q, at].tolist(), kind), pa.array(self.score[q, at])], names=["question", "id", "units"])


def _chunks(asked: Questions, docs: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(docs, 1))
    for low in range(0, len(asked), step):
        yield low, min(low + step, len(asked))


def _kth(rows: np.ndarray, k: int) -> np.ndarray:
    """Places of k columns of each row that have large values, in no order: of parts of the row the largest, of these the k largest."""
    width = max(1, rows.shape[1] // max(64, 4 * k))
    parts = rows.shape[1] // width
    first = rows[:, : parts * width].reshape(len(rows), parts, width).argmax(2) + np.arange(parts) * width
    best = np.argpartition(np.take_along_axis(rows, first, 1), parts - k, axis=1)[:, parts - k :]
    return np.take_along_axis(first, best, 1)


def any_terms(shelf: Shelf, asked: Questions, best: Best) -> None:
    """Documents with any of a question's terms. Terms so common that all of them together cannot reach what a question needs give no candidates.

    Common terms are first summed as steps of 16 bits, rounded up; only what can reach the need by these is scored.
    """
    docs, k = shelf.docs, best.k
    common = np.flatnonzero(shelf.dense_of[asked.terms] >= 0)
    owner = np.repeat(np.arange(len(asked)), np.diff(asked.at))[common]
    most_terms, reach = np.bincount(owner).max(initial=1), np.bincount(owner, shelf.most[asked.terms[common]]).max(initial=1.0)
    # a shelf has 2^14 common terms at most, so steps are never coarser than that
    scale = max(reach / (65535 - most_terms), 1e-9)
    steps = np.ceil(shelf.dense / scale).astype(np.uint16)
    for low, high in _chunks(asked, docs):
        a, b = asked.at[low], asked.at[high]
        code = asked.terms[a:b]
        own = np.repeat(np.arange(high - low), np.diff(asked.at[low : high + 1]))
        there = np.flatnonzero(shelf.size[code] > 0)
        code, own = code[there], own[there]
        if not len(code):
            continue
        near, most, size, start = shelf.dense_of[code], shelf.most[code], shelf.size[code], shelf.start[code]
        need = best.need[low:high].copy()

        def summed(pairs: np.ndarray, own=own, size=size, start=start, n=high - low) -> np.ndarray:
            at = expanded(start[pairs], size[pairs])
            return sums(np.repeat(own[pairs] * docs, size[pairs]) + shelf.row[at], shelf.part[at], n * docs).reshape(n, docs)

        def whole(question: np.ndarray, doc: np.ndarray, pairs: np.ndarray, code=code, own=own, n=high - low) -> np.ndarray:
            """What some terms, in order of their questions, add to documents."""
            many = np.bincount(own[pairs], minlength=n)
            begin, out = np.cumsum(many) - many, np.zeros(len(question))
            for x, y in stretches(many[question], PAIRS):
                size = many[question[x:y]]
                pair = pairs[expanded(begin[question[x:y]], size)]
                out[x:y] = sums(np.repeat(np.arange(y - x), size), shelf.parts(code[pair], np.repeat(doc[x:y], size)), y - x)
            return out

        fresh = np.flatnonzero(need < 0) if docs >= k else np.zeros(0, np.int64)
        rare = None
        if len(fresh):
            # k documents that have much by rare terms: the least that one of them has by all terms is reached by k documents
            rare = summed(np.flatnonzero(near < 0))
            place = _kth(rare[fresh], k)
            last = whole(np.repeat(fresh, k), place.ravel(), np.arange(len(code))).reshape(-1, k).min(1)
            need[fresh] = np.where(last > 0, last, -1)
        # how much a question's terms can add, from the most common on
        reach = np.cumsum(most)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        reach -= np.repeat(reach[first] - most[first], np.diff(np.append(first, len(own))))
        left = reach < need[own] * SHARE
        if rare is not None:
            left &= near >= 0
        bound = sums(own[left], most[left], high - low)
        got = summed(np.flatnonzero(~left & (near < 0))) if rare is None else rare
        leads = np.flatnonzero(~left & (near >= 0))
        floor = np.maximum(need - bound, 0.5)
        ends = np.searchsorted(own[leads], np.arange(high - low + 1)).tolist()
        rows, found, new = near[leads].tolist(), [], set(fresh.tolist())
        row = np.empty(docs, np.uint16)
        for q in range(high - low):
            if ends[q] < ends[q + 1]:
                np.copyto(row, steps[rows[ends[q]]])
                for c in rows[ends[q] + 1 : ends[q + 1]]:
                    row += steps[c]
                reached = row * scale
                reached += got[q]
                if q in new:
                    # what k documents have by these terms at the least
                    need[q] = max(need[q], reached[_kth(reached[None], k)[0]].min() - (ends[q + 1] - ends[q]) * scale)
                    floor[q] = max(need[q] - bound[q], 0.5)
            else:
                reached = got[q]
            # rounded sums may lie a little below the true ones
            found.append(np.flatnonzero(reached >= floor[q] * (1 - 1e-9)))
        doc = np.concatenate(found)
        q = np.repeat(np.arange(high - low), [len(x) for x in found])
        score = got[q, doc] + whole(q, doc, np.flatnonzero(left | (near >= 0)))
        keep = np.flatnonzero((score > 0) & (score >= need[q]))
        best.add(q[keep] + low, score[keep], shelf.ids[doc[keep]])


def _met(shelf: Shelf, asked: Questions, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(questions, terms in order of their lists' lengths, documents of the shortest list), some pairs at a time, of questions whose terms the shelf has.

    Pairs come as question, document; terms as a function of the pair's question and a place.
    """
    many = np.diff(asked.at)
    own = np.repeat(np.arange(len(asked)), many)
    size = shelf.size[asked.terms]
    there = np.bincount(own[size > 0], minlength=len(asked)) == many
    there &= many > 0
    if skip is not None:
        there &= ~skip
    order = np.lexsort((size, own))
    terms, lead = asked.terms[order], asked.at[:-1]
    questions = np.flatnonzero(there)
    if not len(questions):
        return
    size = shelf.size[terms[lead[questions]]]
    for x, y in stretches(size, PAIRS):
        some = questions[x:y]
        at = expanded(shelf.start[terms[lead[some]]], size[x:y])
        yield np.repeat(some, size[x:y]), terms, at


def all_terms(shelf: Shelf, asked: Questions, best: Best) -> None:
    """Documents that have all of a question's terms, from the list of its rarest; questions whose bound is below what they need are passed over."""
    many = np.diff(asked.at)
    own = np.repeat(np.arange(len(asked)), many)
    low = sums(own, shelf.most[asked.terms], len(asked)) < best.need
    for question, terms, at in _met(shelf, asked, low):
        doc, score = shelf.row[at], shelf.part[at]
        if asked.limits:
            keep = np.flatnonzero(shelf.allowed(asked, question, doc))
            question, doc, score = question[keep], doc[keep], score[keep]
        for n in range(1, int(many[question].max()) if len(question) else 0):
            more = np.flatnonzero(many[question] > n)
            part = shelf.parts(terms[asked.at[question[more]] + n], doc[more])
            score[more] += part
            keep = np.ones(len(question), bool)
            keep[more[part <= 0]] = False
            question, doc, score = question[keep], doc[keep], score[keep]
        best.add(question, score, shelf.ids[doc])


def near_terms(shelf: Shelf, asked: Questions, best: Best, single, closeness) -> None:
    """Documents that have all of a question's terms, by their places: ``single`` of the number of places, ``closeness`` of the sums over pairs (see ``pair_sums``)."""
    many = np.diff(asked.at)
    shelf.key = shelf.code * shelf.docs + shelf.row
    for question, terms, at in _met(shelf, asked):
        doc, entries = shelf.row[at], [at]
        for n in range(1, int(many[question].max()) if len(question) else 0):
            more = np.flatnonzero(many[question] > n)
            found = np.full(len(question), -2)
            found[more] = shelf.entry(terms[asked.at[question[more]] + n], doc[more])
            keep = found != -1
            entries = [*(e[keep] for e in entries), found[keep]]
            question, doc = question[keep], doc[keep]
        if not len(question):
            continue
        score = np.zeros(len(question))
        alone = many[question] == 1
        score[alone] = single(shelf.count[entries[0][alone]])
        units = np.zeros(len(question), np.int64)
        for i in range(len(entries)):
            for j in range(i + 1, len(entries)):
                both = np.flatnonzero(entries[j] >= 0)
                for low in range(0, len(both), PAIRS >> 4):
                    some = both[low : low + (PAIRS >> 4)]
                    units[some] += pair_sums(shelf, entries[i][some], entries[j][some], closeness)
        score[~alone] = closeness.score(units[~alone])
        best.add(question, score, shelf.ids[doc])


def pair_sums(shelf: Shelf, a: np.ndarray, b: np.ndarray, closeness) -> np.ndarray:
    """For pairs of entries, the sum of the units of all pairs of their places that are not too far apart."""
    na, nb = shelf.count[a], shelf.count[b]
    far = closeness.farthest
    # places of each pair lie in a stretch of its own, farther from others than any pair that counts
    wide = int(max(shelf.length.max(), 1)) + 2 * far + 2
    left = np.repeat(np.arange(len(a)) * wide, na) + shelf.places[expanded(shelf.first[a], na)]
    right = np.repeat(np.arange(len(b)) * wide, nb) + shelf.places[expanded(shelf.first[b], nb)]
    low, high = np.searchsorted(right, left - far), np.searchsorted(right, left + far, "right")
    own, out = np.repeat(np.arange(len(a)), na), np.zeros(len(a), np.int64)
    for x, y in stretches(high - low, PAIRS):
        n = high[x:y] - low[x:y]
        gap = np.abs(np.repeat(left[x:y], n) - right[expanded(low[x:y], n)])
        np.add.at(out, np.repeat(own[x:y], n), closeness.units[gap])
    return out


def kept(asked: Questions, k: int, id_kind: pa.DataType, answer):
    """For Arrow batches of packed blocks: the task's k best of every question, a shelf at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, docs, words = Best(len(asked), k), [], 0, 0

        def done() -> None:
            shelf = Shelf(held, asked)
            if shelf.docs and len(shelf.code):
                answer(shelf, asked, best)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(n)[i] for n, name in enumerate(batch.schema.names)}
                row["docs"], row["n"] = row["docs"].as_py(), row["n"].as_py()
                if "facts" in row:
                    row["facts"] = row["facts"].values
                held.append(row)
                docs, words = docs + row["docs"], words + row["n"]
                if docs >= SHELF or words >= WORDS:
                    done()
                    held, docs, words = [], 0, 0
        if held:
            done()
        if (rows := best.rows(asked.keys, id_kind)) is not None:
            yield rows

    return scan
