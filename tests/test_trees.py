"""Targets of references and heading trees against brute force."""

import random
import re

from pyspark.sql import functions as F

from finlode.operators import resolve

SECTIONS = "doc_id string, section long, section_type string, section_path array<string>, headings array<string>, content_markdown string"


def brute_target(code, sections, whole_words=False):
    """The first section by the first strategy that has one."""
    code = code.lower()

    def has(text, what):
        if text is None:
            return False
        text = text.lower()
        return bool(re.search(rf"(?<![A-Za-z0-9_]){re.escape(what)}(?![A-Za-z0-9_])", text)) if whole_words else what in text

    note, schedule = re.match(r"note\s+(\d+)", code), re.match(r"schedule\s+([ivxlcdm]+|[a-z])", code)
    best = []
    for _, number, kind, path, headings, text in sections:
        if any(has(p, code) for p in path or []):
            best.append((1, number))
        elif any(has(h, code) for h in headings or []):
            best.append((2, number))
        elif note and kind == "note_to_accounts" and has(text, f"note {note[1]}"):
            best.append((3, number))
        elif schedule and kind == "schedule" and (any(has(p, schedule[1]) for p in path or []) or has(text, f"schedule {schedule[1]}")):
            best.append((4, number))
    return min(best, default=None)


def random_sections(rng, doc, n):
    codes = ["Note 1", "note 12", "Note 5", "schedule v", "Schedule IV", "(1)", "(a)", "**", "*", "#3", "#31", "nothing"]
    kinds = ["note_to_accounts", "schedule", "other", None]
    some = lambda k: rng.choice([None, [], [rng.choice(["x " + rng.choice(codes), "Plain", None]) for _ in range(k)]])
    return [(doc, i, rng.choice(kinds), some(2), some(1), rng.choice([None, "", "text of " + rng.choice(codes) + " and " + rng.choice(codes)])) for i in range(n)]


def test_targets_of_references(spark):
    rng = random.Random(3)
    sections = [s for d in range(30) for s in random_sections(rng, f"d{d}", rng.choice([0, 1, 4, 12]))]
    codes = ["Note 1", "note 1", "Note 12", "Note 5", "Schedule V", "SCHEDULE IV", "(1)", "(a)", "*", "***", "#3", "missing", None]
    refs = [(f"d{d}", c) for d in range(31) for c in codes]
    left, right = spark.createDataFrame(refs, "doc_id string, ref_code string"), spark.createDataFrame(sections, SECTIONS)
    for whole in (False, True):
        got = {(r["doc_id"], r["ref_code"]): (r["strategy"], r["section"]) for r in resolve.resolved(left, right, whole_words=whole).collect()}
        want = {}
        for doc, code in refs:
            found = brute_target(code, [s for s in sections if s[0] == doc], whole) if code else None
            if found:
                want[doc, code] = found
        assert got == want and len(want) > 25


def test_a_document_of_many_sections(spark, monkeypatch):
    """10,000 sections of one document, in ranges; and no join of references with sections' texts in the plan."""
    n = 10_000
    sections = spark.range(n).select(
        F.lit("big").alias("doc_id"), F.col("id").alias("section"), F.lit("note_to_accounts").alias("section_type"), F.array().cast("array<string>").alias("section_path"),
        F.when(F.col("id") % 1000 == 999, F.array(F.concat(F.lit("About Schedule "), F.lit("X")))).alias("headings"), F.concat(F.lit("see note "), F.col("id").cast("string"), F.lit(". " + "words " * 100)).alias("content_markdown"),
    )
    refs = spark.createDataFrame([("big", f"Note {i}") for i in (7, 4321, 9999, 10_000)] + [("big", "Schedule X"), ("other", "Note 7")], "doc_id string, ref_code string")
    found = resolve.resolved(refs, sections, whole_words=True)
    got = {r["ref_code"]: (r["strategy"], r["section"]) for r in found.collect()}
    assert got == {"Note 7": (3, 7), "Note 4321": (3, 4321), "Note 9999": (3, 9999), "Schedule X": (2, 999)}
    assert found.first()["resolved_text"].endswith("...")
    part = resolve.resolved(refs, sections)._jdf.queryExecution().optimizedPlan().toString()
    for line in part.splitlines():
        assert not ("Join" in line and "content_markdown" in line)


def test_targets_of_nothing(spark):
    refs = spark.createDataFrame([], "doc_id string, ref_code string")
    sections = spark.createDataFrame([("a", 0, "other", ["x"], None, "t")], SECTIONS)
    assert resolve.resolved(refs, sections).count() == 0
    assert resolve.resolved(spark.createDataFrame([("a", "x")], "doc_id string, ref_code string"), sections.limit(0)).count() == 0


def test_heading_trees(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(12):
        pos, stack, own = 0, [], []
        for _ in range(rng.choice([0, 1, 5, 60])):
            pos += rng.randint(1, 9)
            level = rng.randint(1, 6)
            own.append((pos, level))
            rows.append((doc, pos, level, f"t{pos}"))
        for i, (p, level) in enumerate(own):
            while stack and stack[-1][1] >= level:
                stack.pop()
            end = next((q for q, m in own[i + 1 :] if m <= level), None)
            want[doc, p] = (stack[-1][0] if stack else None, len(stack), end)
            stack.append((p, level))
    headings = spark.createDataFrame(rows, "doc_id long, pos long, level int, title string").repartition(5)
    for width in (1 << 16, 7):
        tree = resolve.heading_tree(headings, width=width)
        assert {(r["doc_id"], r["pos"]): (r["parent"], r["depth"], r["end"]) for r in tree.collect()} == want
    below = {}
    for r in resolve.subtrees(tree, tree.where("level <= 2")).collect():
        below.setdefault((r["doc_id"], r["top"]), set()).add(r["pos"])
    levels = {(d, p): level for d, p, level, _ in rows}
    for (doc, top), found in below.items():
        end = want[doc, top][2]
        assert found == {p for d, p in want if d == doc and p >= top and (end is None or p < end)} and levels[doc, top] <= 2
    assert resolve.heading_tree(headings.limit(0)).count() == 0


def test_subtrees_in_short_ranges(spark):
    """Ranges of a few places, most of them empty, give what one range gives; no heading meets all of its document."""
    rng = random.Random(6)
    rows = [(d, p, rng.randint(1, 6), "t") for d in range(3) for p in sorted(rng.sample(range(2000), 120))]
    tree = resolve.heading_tree(spark.createDataFrame(rows, "doc_id int, pos long, level int, title string"), width=64).cache()
    got = {(r["doc_id"], r["top"], r["pos"]) for r in resolve.subtrees(tree, tree.where("level <= 3"), width=8).collect()}
    ends = {(r["doc_id"], r["pos"]): r["end"] for r in tree.collect()}
    want = {(d, t, p) for d, t, level, _ in rows if level <= 3 for e, p, *_ in rows if e == d and p >= t and (ends[d, t] is None or p < ends[d, t])}
    assert got == want


def test_no_frame_runs_to_the_end(spark):
    """A frame up to the end of its partition is summed anew for each row, the square of a document's ranges."""
    rows = spark.createDataFrame([(1, p, 1 + p % 3, "t") for p in range(9)], "doc_id int, pos long, level int, title string")
    assert "unboundedfollowing" not in resolve.heading_tree(rows)._jdf.queryExecution().toString().lower().replace(" ", "")


def test_codes_are_not_repeated_for_every_few_sections(spark):
    """A document whose sections' numbers are far apart: its codes go to as many parts as its sections fill; nothing is broadcast."""
    sections = [("d", i * 1000, "note_to_accounts", [f"p{i}"], [], "note 7 of many") for i in range(300)]
    refs = spark.createDataFrame([("d", c) for c in ("Note 7", "p299", "p3")], "doc_id string, ref_code string")
    found = resolve.resolved(refs, spark.createDataFrame(sections, SECTIONS))
    assert {(r["ref_code"], r["section"], r["strategy"]) for r in found.collect()} == {("Note 7", 0, 3), ("p299", 299000, 1), ("p3", 3000, 1)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
