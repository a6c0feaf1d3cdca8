"""Labels, spans and score of the licence scan against matches and chains found without the automaton."""

import random
import re

import pytest

from finlode.llm import license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("one", "a b c d e f g h i j k l"),
    ("two", "a b c d x y z a b c d q"),
    ("three", "permission is granted to any person permission is granted to copy the mit license notice"),
    ("rep", "r r r r r r s r r r"),
)


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


def matches_of(run, texts):
    """(place, size, [(text, begin)]) of each match that neither the next word nor the run carries on: the longest one that ends at its last word."""
    def longest(end):
        for begin in range(end + 1):
            own = run[begin : end + 1]
            found = [(t, i) for t, w in enumerate(texts) for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own]
            if found:
                return begin, found
        return end + 1, []

    ends = [longest(i) for i in range(len(run))]
    for i, (begin, found) in enumerate(ends):
        size = i + 1 - begin
        following = i + 2 - ends[i + 1][0] if i + 1 < len(run) else 0
        if size and following <= size:
            yield begin, size, found


def brute(text, min_match, max_gap, min_share):
    words = words_of(text)
    texts = [p.split() for p, _ in PHRASES] + [words_of(t) for _, t in TEMPLATES]
    labels = [label for _, label in PHRASES] + [label for label, _ in TEMPLATES]
    base = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    known = {x for w in texts for x in w}
    found, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and words[j] in known:
            j += 1
        found += [(i + a, n, at) for a, n, at in matches_of(words[i:j], texts) if n >= min_match]
        i = max(j, i + 1)
    chains = []  # template, first word, end in the document, end in the template, words covered
    for place, size, at in found:
        new = []
        for t, begin in sorted(at):
            fits = [c for c in chains if c["t"] == t and 0 <= place - c["end"] <= max_gap and 0 <= begin - c["own"] <= max_gap]
            top = max(fits, key=lambda c: c["covered"], default=None)
            new.append({"t": t, "first": top["first"] if top else place, "end": place + size, "own": begin + size, "covered": (top["covered"] if top else 0) + size})
        chains += new
    score, spans = float(bool(base)), {}
    for c in chains:
        share = min(1.0, c["covered"] / len(texts[c["t"]]))
        score = max(score, share)
        key = labels[c["t"]], c["first"]
        if share >= min_share and c["t"] >= len(PHRASES) and spans.get(key, 0) < share:
            spans[key] = share
    both = ",".join(sorted({x for _, x in base} | {x for x, _ in spans}))
    return both, round(score, 9), {k: round(v, 9) for k, v in spans.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_matches(spark, seed):
    rng = random.Random(seed)
    pool = "a b c d e f g h i j k l x y z q r s permission is granted to any person copy the mit license notice apache cc by gnu general public".split()
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = words_of(rng.choice(TEMPLATES)[1])
            a = rng.randrange(len(own))
            parts += own[a : a + rng.randint(1, 14)]
            parts += rng.choices([*pool, "other", "noise"], k=rng.randint(0, 4))
        rows.append((i, " ".join(parts)))
    rows += [(900, "r " * 60), (901, "a b c d " * 30), (902, "permission is granted to " * 40), (903, None), (904, "Other words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_match, max_gap, min_share in ((4, 8, 0.6), (2, 2, 0.3)):
        got = {}
        for r in license_scan.license_scan(df, phrases=PHRASES, templates=TEMPLATES, min_match=min_match, max_gap=max_gap, min_share=min_share).collect():
            got[r["doc_id"]] = r["labels"], round(r["score"], 9), {(s["label"], s["first_word"]): round(s["covered"], 9) for s in r["spans"]}
        bad = [(rows[i], got[d], brute(t, min_match, max_gap, min_share)) for i, (d, t) in enumerate(rows) if got[d] != brute(t, min_match, max_gap, min_share)]
        assert not bad, bad[:2]
