"""Targets of references: the codes of a document are looked for in one pass over each of its sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import snippet

#: Sections of a document that are scanned together, or as many as it has codes; a document with more takes part in more tasks.
SECTIONS = 256

_NOTE, _SCHEDULE = re.compile(r"note\s+(\d+)"), re.compile(r"schedule\s+([ivxlcdm]+|[a-z])")


class Codes:
    """An automaton of a document's codes, in lower case.

    Each pattern stands for codes and where it counts: ``code`` in a path or heading, ``note`` and ``schedule`` in the text
    of a section of that type, ``part`` in a path part of a schedule.
    """

    def __init__(self, codes: list[str]):
        uses: dict[str, list[tuple[str, str]]] = {}
        for code in codes:
            uses.setdefault(code, []).append(("code", code))
            if note := _NOTE.match(code):
                uses.setdefault(f"note {note[1]}", []).append(("note", code))
            if schedule := _SCHEDULE.match(code):
                uses.setdefault(f"schedule {schedule[1]}", []).append(("schedule", code))
                uses.setdefault(schedule[1], []).append(("part", code))
        blank = uses.pop("", [])
        #: By use, so that a long text is only read for what counts there.
        self.automata = {}
        self.blank = {use: {code for own, code in blank if own == use} for use in ("code", "note", "schedule", "part")}
        for use in self.blank:
            automaton = ahocorasick.Automaton()
            for pattern, own in uses.items():
                if codes := tuple(code for u, code in own if u == use):
                    automaton.add_word(pattern, (len(pattern), codes))
            if len(automaton):
                automaton.make_automaton()
                self.automata[use] = automaton

    def found(self, use: str, text: str, whole_words: bool) -> set[str]:
        """Codes of all patterns of a use in a text; with ``whole_words``, no letter, digit or _ before or after."""
        out = set(self.blank[use])
        if use in self.automata:
            for end, (size, own) in self.automata[use].iter(text):
                if not whole_words or not (_word(text, end - size) or _word(text, end + 1)):
                    out.update(own)
        return out

    def strategies(self, kind: str | None, path: list[str], headings: list[str], text: str, whole_words: bool) -> dict[str, int]:
        """The first strategy by which a section is a code's target."""
        out: dict[str, int] = {}

        def take(strategy: int, use: str, where: str) -> None:
            for code in self.found(use, where, whole_words):
                out[code] = min(strategy, out.get(code, strategy))

        for part in path:
            take(1, "code", part)
            if kind == "schedule":
                take(4, "part", part)
        for heading in headings:
            take(2, "code", heading)
        if kind == "note_to_accounts":
            take(3, "note", text)
        elif kind == "schedule":
            take(4, "schedule", text)
        return out


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and bool(re.match(r"[A-Za-z0-9_]", text[at]))


def _scan(whole_words: bool):
    """(doc_id, code, section, strategy) of rows (doc_id, part, mark, code, section, kind, path, headings, text): a document's codes come first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, automaton = None, [], None
        for batch in batches:
            out = []
            for doc, part, mark, code, section, kind, path, headings, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, part) != key:
                    key, codes, automaton = (doc, part), [], None
                if mark == 0:
                    codes.append(code)
                    continue
                automaton = automaton or Codes(codes)
                found = automaton.strategies(kind, [p for p in path or [] if p is not None], [h for h in headings or [] if h is not None], text, whole_words)
                out += [(doc, c, section, s) for c, s in found.items()]
            columns = zip(*out, strict=True) if out else [[], [], [], []]
            kinds = (batch.schema.field(0).type, pa.string(), batch.schema.field(4).type, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "code", "section", "strategy"])

    return scan


def resolved(refs: DataFrame, sections: DataFrame, whole_words: bool = False) -> DataFrame:
    """(doc_id, ref_code, section, strategy, resolved_text): each code's target; codes without one are left out.

    ``refs`` (doc_id, ref_code); ``sections`` (doc_id, section, section_type, section_path, headings, content_markdown),
    numbered within their document. Strategies in order: the code in a path part; in a heading; a note's number in the text
    of notes; a schedule's id in a path part or text of a schedule. Within one, the first section counts. Letters' case does
    not matter. ``whole_words`` asks for a word's end before and after the code, so that Note 5 is not found in Note 50.

    Codes and sections of a document meet in parts of 256 sections, or of as many as it has codes, so that codes are not
    repeated more often than there are sections: first the codes, which become one automaton for each use, then each
    section, read once. What goes on is (code, section, strategy); only the targets' snippets are joined, at the end.
    Sizes that Spark guesses of tables made in a query say little, so nothing is left to it to broadcast.
    """
    doc_kind, section_kind = (sections.schema[c].dataType.simpleString() for c in ("doc_id", "section"))
    codes = refs.select("doc_id", F.lower("ref_code").alias("code")).where("code IS NOT NULL").distinct()
    asked = codes.groupBy("doc_id").agg(F.count("*").alias("codes"))
    sizes = sections.groupBy("doc_id").agg(F.count("*").alias("sections")).join(asked.hint("merge"), "doc_id")
    sizes = sizes.select("doc_id", F.ceil(F.col("sections") / F.greatest(F.lit(SECTIONS), "codes")).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("section"), F.col("parts")).cast("int").alias("part")
    lower = lambda c: F.transform(c, lambda x: F.lower(x)).alias(c)
    read = sections.join(sizes.hint("merge"), "doc_id")
    own = read.select("doc_id", part, F.lit(1).alias("mark"), F.lit(None).cast("string").alias("code"), "section", "section_type", lower("section_path"), lower("headings"), F.lower(F.coalesce("content_markdown", F.lit(""))).alias("text"))
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns[4:]]
    first = codes.join(sizes.hint("merge"), "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("mark"), "code", *none)
    n = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.unionByName(own).repartition(n, "doc_id", "part").sortWithinPartitions("doc_id", "part", "mark")
    hits = both.mapInArrow(_scan(whole_words), f"doc_id {doc_kind}, code string, section {section_kind}, strategy int")
    best = hits.groupBy("doc_id", "code").agg(F.min(F.struct("strategy", "section")).alias("at")).select("doc_id", "code", "at.strategy", "at.section")
    named = refs.select("doc_id", "ref_code").distinct().withColumn("code", F.lower("ref_code")).join(best.hint("merge"), ["doc_id", "code"])
    texts = sections.select("doc_id", "section", snippet(F.col("content_markdown")).alias("resolved_text"))
    return named.join(texts.hint("merge"), ["doc_id", "section"]).select("doc_id", "ref_code", "section", "strategy", "resolved_text")


def heading_tree(headings: DataFrame, levels: int = 6, width: int = 1 << 16) -> DataFrame:
    """(doc_id, pos, level, title, parent, depth, end): the tree that headings of levels 1 to ``levels`` make.

    ``headings`` has doc_id, pos, a whole number in order, level and title. A heading's parent is the nearest one before it of
    a lower level, null if there is none; its subtree is all from ``pos`` up to but not including ``end``, null for up to
    the end; so what is below a heading is a condition on a range. ``depth`` counts its ancestors, skipped levels not.

    For each level, the nearest heading before and after is a running maximum and minimum. These are taken of ranges of
    ``width`` places first and within them then, so a document is never one task's, however long it is.
    """
    names = range(1, levels + 1)
    rows = headings.select("doc_id", "pos", "level", "title").withColumn("part", F.floor(F.col("pos") / width))
    at = {n: F.when(F.col("level") == n, F.col("pos")) for n in names}
    sums = rows.groupBy("doc_id", "part").agg(*(F.max(at[n]).alias(f"max{n}") for n in names), *(F.min(at[n]).alias(f"min{n}") for n in names))
    parts = Window.partitionBy("doc_id").orderBy("part")
    # what follows is what precedes in the other order: a frame up to the end is summed anew for every row
    last, past = Window.partitionBy("doc_id").orderBy(F.desc("part")), (Window.unboundedPreceding, -1)
    before, after = parts.rowsBetween(*past), last.rowsBetween(*past)
    sums = sums.select("doc_id", "part", *(F.max(f"max{n}").over(before).alias(f"base{n}") for n in names), *(F.min(f"min{n}").over(after).alias(f"next{n}") for n in names))
    inside = Window.partitionBy("doc_id", "part").orderBy("pos")
    earlier, later = inside.rowsBetween(*past), Window.partitionBy("doc_id", "part").orderBy(F.desc("pos")).rowsBetween(*past)
    rows = rows.join(sums, ["doc_id", "part"])
    rows = rows.withColumns({f"last{n}": F.coalesce(F.max(at[n]).over(earlier), F.col(f"base{n}")) for n in names} | {f"then{n}": F.coalesce(F.min(at[n]).over(later), F.col(f"next{n}")) for n in names})
    lower = [F.when(F.col("level") > n, F.col(f"last{n}")) for n in names]
    follows = [F.when(F.col("level") >= n, F.col(f"then{n}")) for n in names]
    # a level is among the ancestors if its last heading came after those of all levels below it
    depth = F.lit(0)
    for n in names:
        below = F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(lower[m - 1], F.lit(-1)) for m in range(1, n)))
        depth = depth + F.coalesce(lower[n - 1] > below, F.lit(False)).cast("int")
    parent = F.greatest(F.lit(None).cast("bigint"), *lower)
    end = F.least(F.lit(None).cast("bigint"), *follows)
    return rows.select("doc_id", "pos", "level", "title", parent.alias("parent"), depth.alias("depth"), end.alias("end"))


def subtrees(tree: DataFrame, tops: DataFrame, width: int = 256) -> DataFrame:
    """(doc_id, top, pos): everything below the headings (doc_id, pos) of ``tops`` and these themselves, as a range of places.

    A subtree meets the headings in ranges of ``width`` places that have any, so not all headings of a document meet. Of
    the subtrees that reach into a range from before, each is within the next, so there are no more than levels.
    """
    placed = tree.select("doc_id", "pos", "end", F.floor(F.col("pos") / width).alias("part"))
    # ranges that have headings are numbered in order, so that empty ones cost nothing
    numbers = placed.select("doc_id", "part").distinct()
    own = Window.partitionBy("doc_id")
    numbers = numbers.withColumn("number", F.row_number().over(own.orderBy("part"))).withColumn("most", F.count("*").over(own).cast("int"))
    rows = placed.join(numbers, ["doc_id", "part"])
    wanted = tops.select("doc_id", "pos").join(rows, ["doc_id", "pos"]).select("doc_id", F.col("pos").alias("top"), "end", F.col("number").alias("from"), "most", F.floor(F.col("end") / width).alias("part"))
    wanted = wanted.join(numbers.select("doc_id", "part", F.col("number").alias("to")), ["doc_id", "part"], "left")
    ranges = wanted.select("doc_id", "top", "end", F.explode(F.sequence("from", F.coalesce("to", "most"))).alias("number"))
    inside = (F.col("pos") >= F.col("top")) & (F.col("end").isNull() | (F.col("pos") < F.col("end")))
    return ranges.join(rows.select("doc_id", "number", "pos"), ["doc_id", "number"]).where(inside).select("doc_id", "top", "pos")
