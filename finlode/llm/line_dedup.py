"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Pieces of half a line, one of which must hold the edit once the other half is equal.
PIECES = 8


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, line_no, line, one, two): every line with its place and its 128-bit name."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).select(
        "doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return rows.withColumn("one", F.xxhash64("line")).withColumn("two", F.xxhash64(F.lit(1), "line"))


def _place() -> Column:
    """A line's place in the corpus, as it sorts; null ids come after all others."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "line_no")


def _suffix(line: Column, size: Column, n: Column) -> Column:
    """The last n characters of a line of ``size`` characters."""
    return F.substring(line, size - n + 1, n)


def _half_keys(line: Column, size: Column) -> dict[str, Column]:
    """For a shorter length n of a pair, this line's length or one less: the keys that an edit leaves equal.

    If lines of n and n or n + 1 characters are one edit apart, the edit is after the first n div 2 characters,
    which are then equal, or before the last n - n div 2. The names tell the length and the side.
    """
    keys = {}
    for less in (0, 1):
        n = size - less
        head = F.floor(n / 2)
        keys[f"head{less}"] = F.xxhash64(n, F.lit(0), F.substring(line, F.lit(1), head))
        keys[f"tail{less}"] = F.xxhash64(n, F.lit(1), _suffix(line, size, n - head))
    return keys


def _halves() -> Column:
    """A line's keys as rows (n, side, key)."""
    rows = [F.struct((F.col("size") - less).alias("n"), F.lit(side).alias("side"), F.col(f"{name}{less}").alias("key")) for less in (0, 1) for side, name in enumerate(("head", "tail"))]
    return F.inline(F.array(*rows))


def _pieces() -> Column:
    """Keys without one piece of the half that may hold the edit, with the piece's bounds in this line.

    The bounds come from the shorter length n, so both lines of a pair have the same: what is before the piece and
    what is after it are equal in both, and the piece of a line of n + 1 characters is one longer.
    """
    n, size, line = F.col("n"), F.col("size"), F.col("line")
    head = F.floor(n / 2)
    low = F.when(F.col("side") == 0, head).otherwise(F.lit(0))
    width = F.when(F.col("side") == 0, n - head).otherwise(head)

    def piece(i: Column) -> Column:
        begin = low + F.floor(width * i / PIECES)
        rest = n - (low + F.floor(width * (i + 1) / PIECES))
        key = F.xxhash64(n, F.lit(2), i, F.col("side"), F.substring(line, F.lit(1), begin), F.lit("\n"), _suffix(line, size, rest))
        return F.struct(key.alias("key"), begin.alias("begin"), (size - rest).alias("end"))

    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece)


def _deletions() -> Column:
    """The piece's key with the piece as it is (place -1) and with each of its characters deleted.

    A piece in a line of n characters takes part as it is and with deletions; in a line of n + 1, with deletions only.
    """
    piece = F.substring("line", F.col("begin") + 1, F.col("end") - F.col("begin"))
    size = F.col("end") - F.col("begin")

    def without(i: Column) -> Column:
        rest = F.concat(F.substring(piece, F.lit(1), i), F.substring(piece, i + 2, size))
        return F.struct(F.xxhash64("key", rest).alias("variant"), i.alias("gone"))

    whole = F.struct(F.xxhash64("key", piece).alias("variant"), F.lit(-1).cast("bigint").alias("gone"))
    gone = F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), without)).otherwise(F.array(whole).cast("array<struct<variant:bigint,gone:bigint>>"))
    return F.when(F.col("size") == F.col("n"), F.when(size > 0, F.concat(F.array(whole), gone)).otherwise(F.array(whole))).otherwise(gone)


def _part_keys(line: Column, size: Column, edits: int, min_long: int) -> Column:
    """Keys that two lines of ``min_long`` characters or more share if they are at most ``edits`` edits apart.

    The shorter line, of n characters, is cut into ``edits`` + 1 parts by n, one of which no edit touches. The edits before
    and after it bound how far it can move, so the longer line, of n to n + ``edits`` characters, has it at one of a few
    places. The first ``edits`` + 1 keys are a line's own parts, the others what it may have of other lines' parts.
    """
    keys = {True: [], False: []}
    for more in range(edits + 1):
        n = size - more
        for i in range(edits + 1):
            begin = F.floor(n * i / (edits + 1))
            width = F.floor(n * (i + 1) / (edits + 1)) - begin
            for move in range(max(-i, more - (edits - i)), min(i, more + (edits - i)) + 1):
                key = F.xxhash64(n, F.lit(3), F.lit(i), F.substring(line, begin + move + 1, width))
                keys[more == 0 and move == 0].append(F.when(n >= min_long, key))
    return F.when(size >= min_long, F.array(*keys[True], *keys[False]))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key two different lines have."""
    seen = rows.groupBy(key).agg(F.min("one").alias("low"), F.max("one").alias("high")).where("low != high").select(key)
    return rows.join(seen, key)


def _sharing_parts(distinct: DataFrame, edits: int) -> DataFrame:
    """(one, key, own): the part keys that two different lines have, one of them as its own part."""
    keys = distinct.where("parts IS NOT NULL").select("one", F.posexplode("parts").alias("slot", "key")).where("key IS NOT NULL")
    group = Window.partitionBy("key")
    keys = keys.select("one", "key", (F.col("slot") <= edits).alias("own"))
    seen = keys.select("*", F.min("one").over(group).alias("low"), F.max("one").over(group).alias("high"), F.max("own").over(group).alias("any"))
    return seen.where("low != high AND any").select("one", "key", "own")


def _held(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(one, two, near) of the pairs (one, two, near, other_one, other_two) that are at most ``edits`` edits apart."""
    mine = texts.select("one", "two", "line")
    other = texts.select(F.col("one").alias("other_one"), F.col("two").alias("other_two"), F.col("line").alias("other"))
    apart = F.levenshtein("line", "other", edits)  # -1 beyond the bound
    return pairs.distinct().join(mine, ["one", "two"]).join(other, ["other_one", "other_two"]).where(apart >= 0).select("one", "two", "near")


def _farther_lines(parts: DataFrame, texts: DataFrame, near: DataFrame, edits: int) -> DataFrame:
    """(one, two, near): for lines not in ``near``, a place of an earlier line at most ``edits`` edits away.

    Each line is verified against the earliest owner of each of its parts; only those that this leaves open are compared
    with all earlier lines that share a part, so a large group of near copies is not taken pair by pair.
    """
    rows = saved(parts.join(texts.select("one", "two", "place"), "one"))
    at = F.struct("place", "one", "two")
    first = rows.where("own").groupBy("key").agg(F.min(at).alias("first"))
    open_ = rows.join(near.select("one", "two"), ["one", "two"], "left_anti")
    led = open_.join(first, "key").where("first.place < place")
    led = led.select("one", "two", F.col("first.place").alias("near"), F.col("first.one").alias("other_one"), F.col("first.two").alias("other_two"))
    found = saved(_held(led, texts, edits).groupBy("one", "two").agg(F.min("near").alias("near")))
    open_ = open_.join(found.select("one", "two"), ["one", "two"], "left_anti")
    other = rows.select("key", F.col("own").alias("other_own"), F.col("place").alias("near"), F.col("one").alias("other_one"), F.col("two").alias("other_two"))
    pairs = open_.join(other, "key").where("near < place AND (own OR other_own)").select("one", "two", "near", "other_one", "other_two")
    return found.unionByName(_held(pairs, texts, edits))


def near_lines(lines: DataFrame, distinct: DataFrame, min_near: int, edits: int = 1) -> DataFrame:
    """(one, two, near): for distinct lines with an earlier one at most one edit away, the earliest such place.

    With ``edits`` above one, lines with part keys have as many edits, and those found by these have some such place.

    Emitting every line's deletion variants at once would make as many rows as the corpus has characters. An edit
    leaves half of a line equal, and of the other half all pieces but one, so lines are first joined by halves, those
    that share a half by pieces, and only for a shared piece are its deletion variants emitted. No pair is lost. Lines
    that share a variant with the same character deleted differ in that character; a line that equals another's
    variant lacks that character. So each line needs only the earliest place of its variant, never a list, and the
    edit distance of the pair is then verified on the texts.
    """
    long = distinct.where(F.col("size") >= min_near)
    halves = long.select("one", _halves()).where(F.col("n") >= min_near)
    halves = saved(_shared(halves, "key").select("one", "n", "side").distinct())
    # the texts of lines that share a half, each from its first place
    ones = halves.select("one")
    if edits > 1:
        parts = saved(_sharing_parts(distinct, edits))
        ones = ones.unionByName(parts.select("one"))
    wanted = distinct.join(ones.distinct(), "one", "left_semi").select("one", "two", "place", "size", "place.tie", "place.line_no")
    here = lines.withColumn("own", _place())
    texts = saved(
        here.join(wanted, ["one", "two", "tie", "line_no"]).where("own = place").select("one", "two", "place", "size", "line").dropDuplicates(["one", "two"])
    )
    pieces = texts.join(halves, "one").select("one", "two", "place", "line", "size", "n", F.inline(_pieces()))
    shared = _shared(pieces.select("one", "key"), "key").select("one", "key").distinct()
    pieces = pieces.join(shared, ["one", "key"]).dropDuplicates(["one", "two", "key"])
    variants = saved(pieces.select("one", "two", "place", "n", F.inline(_deletions())))
    at = F.struct("place", "one", "two")
    both = variants.groupBy("variant").agg(
        F.min(F.when(F.col("gone") < 0, at)).alias("whole"), F.min(F.when(F.col("gone") >= 0, at)).alias("cut"), F.min("one").alias("low"), F.max("one").alias("high")
    ).where("low != high")
    same = variants.where("gone >= 0").groupBy("variant", "gone", "n").agg(F.min(at).alias("same"))
    rows = variants.join(both, "variant").join(same, ["variant", "gone", "n"], "left")
    earliest = F.when(F.col("gone") < 0, F.col("cut")).otherwise(F.least("whole", "same"))
    pairs = rows.select("one", "two", "place", earliest.alias("first")).where(F.col("first.place") < F.col("place"))
    pairs = pairs.select("one", "two", F.col("first.place").alias("near"), F.col("first.one").alias("other_one"), F.col("first.two").alias("other_two")).distinct()
    near = _held(pairs, texts, 1)
    if edits > 1:
        near = saved(near)
        near = near.unionByName(_farther_lines(parts, texts, near, edits))
    return near.groupBy("one", "two").agg(F.min("near").alias("near"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_near: int = 1, edits: int = 2, min_long: int = 200) -> DataFrame:
    """One row per document: doc_id, n_lines, n_repeated, n_near, n_kept, dropped (numbers of lines that go, from 0).

    Lines are what newlines separate. Places are ordered by doc_id, then line number. A line of ``min_chars``
    characters or more goes if the same line is at an earlier place (repeated), or else if a line at an earlier place
    is one insertion, deletion or substitution of a character away (near), whatever its length; a larger ``min_near``
    leaves lines of fewer characters out of the latter. Where both have ``min_long`` characters or more, up to ``edits`` of these are near.
    The earlier line counts whether or not it goes itself.

    A null or empty text is one empty line, and shorter lines than ``min_chars``, with the default the empty ones, all
    stay. Null ids come after all others; of rows that share an id, the order is that of a hash of their texts, and
    rows that repeat both id and text are one document with one result row. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    lines = _lines(docs, id_col, text_col)
    size = F.length("line")
    counted = lines.withColumn("size", size).where(F.col("size") >= min_chars)
    keys = _half_keys(F.col("line"), F.col("size"))
    if edits > 1:
        keys["parts"] = _part_keys(F.col("line"), F.col("size"), edits, max(min_long, min_near))
    # a line's size and keys follow from its text, so any of equal lines has them
    distinct = saved(
        counted.select("one", "two", _place().alias("place"), "size", *(v.alias(k) for k, v in keys.items()))
        .groupBy("one", "two")
        .agg(F.min("place").alias("place"), *(F.max(k).alias(k) for k in ("size", *keys)))
    )
    near = saved(near_lines(lines, distinct, min_near, edits))
    first = distinct.select("one", "two", "place").join(near.select("one", "two", F.lit(True).alias("is_near")), ["one", "two"], "left")
    # lines that do not count, such as the empty ones, are no keys of the join; each document's last line stands for them
    found = lines.where(size >= min_chars).select("doc_id", "tie", "line_no", "one", "two").join(first, ["one", "two"])
    is_near = (_place() == F.col("place")) & F.coalesce("is_near", F.lit(False))
    marked = found.select("doc_id", "tie", "line_no", (_place() != F.col("place")).alias("repeated"), is_near.alias("near"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    last = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("tie"), (F.size(F.split(text, "\n")) - 1).alias("line_no"), F.lit(False).alias("repeated"), F.lit(False).alias("near"))
    return (
        marked.unionByName(last)
        .groupBy("doc_id", "tie")
        .agg(
            (F.max("line_no") + 1).cast("long").alias("n_lines"),
            F.collect_set(F.when(F.col("repeated"), F.col("line_no"))).alias("again"),
            F.collect_set(F.when(F.col("near"), F.col("line_no"))).alias("close"),
        )
        .select(
            "doc_id",
            "n_lines",
            F.size("again").cast("long").alias("n_repeated"),
            F.size("close").cast("long").alias("n_near"),
            (F.col("n_lines") - F.size("again") - F.size("close")).alias("n_kept"),
            F.array_sort(F.concat("again", "close")).alias("dropped"),
        )
    )


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts without the lines that ``line_dedup`` dropped; ids must be unique."""
    kept = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains("dropped", i))
    rows = docs.join(dropped.select(F.col("doc_id").alias(id_col), "dropped"), id_col, "left")
    return rows.withColumn(text_col, F.when(F.size("dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))).drop("dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_dedup`` of all documents, with the one edit of its SQL; the dropped lines' numbers joined by commas."""
    found = line_dedup(table(spark, sf_dir, "documents"), edits=1)
    return found.withColumn("dropped", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ","))


OP10_SQL = """
WITH t AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
    SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM t
), d AS (
    SELECT line, length(line) AS size, row_number() OVER (ORDER BY min((doc_id, line_no))) AS place, min((doc_id, line_no)) AS spot
    FROM l WHERE line <> '' GROUP BY line
), v AS (
    SELECT place, size, i, hash(left(line, i) || substr(line, i + 2)) AS h
    FROM (SELECT *, unnest(range(size)) AS i FROM d)
), n AS (
    SELECT a.place AS later FROM v a JOIN v b ON a.h = b.h AND a.i = b.i AND a.size = b.size AND b.place < a.place
    UNION
    SELECT greatest(a.place, b.place) FROM v a JOIN d b ON a.h = hash(b.line) AND a.size = b.size + 1
), m AS (
    SELECT l.doc_id, l.line_no, l.line <> '' AND d.spot <> (l.doc_id, l.line_no) AS repeated,
           l.line <> '' AND d.spot = (l.doc_id, l.line_no) AND n.later IS NOT NULL AS near
    FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN n ON n.later = d.place
)
SELECT doc_id, count(*) AS n_lines, count_if(repeated)::BIGINT AS n_repeated, count_if(near)::BIGINT AS n_near,
       count_if(NOT coalesce(repeated, false) AND NOT coalesce(near, false))::BIGINT AS n_kept,
       coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (WHERE repeated OR near), '') AS dropped
FROM m GROUP BY doc_id
"""
