"""English stems by the rules of the public Snowball ("Porter2") stemmer, as columns over a table of distinct words.

Each step is a table of endings and what they become; the longest ending that a word has decides. Regions are places in
the word: the first begins after the first consonant that follows a vowel, the second is the same within the first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stemmer's exceptions and its endings, by step, with what they become.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
HEADS = ("gener", "commun", "arsen")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end: a vowel between two consonants, the last not w, x or Y; or a vowel that begins the word.
SHORT = r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def ending(suffixes) -> str:
    """A pattern of the longest of some endings: the leftmost match that reaches the end."""
    return f"({'|'.join(sorted(suffixes, key=lambda s: (-len(s), s)))})$"


def _in(word: Column, suffix: Column, region: Column) -> Column:
    return F.length(word) - F.length(suffix) >= region


def _cut(word: Column, suffix: Column, by: Column | str = "") -> Column:
    end = by if isinstance(by, Column) else F.lit(by)
    return F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(suffix)), end)


def _table(rules: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[key]


def stemmed(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """``words`` with their stems. Words are lower-case; those of two characters or less, and null, stay as they are."""
    w, s = F.col("its word"), F.col("its suffix")
    one, two = F.col("its first"), F.col("its second")

    def step(df: DataFrame, suffixes, new: Column) -> DataFrame:
        return df.withColumn("its suffix", F.regexp_extract(w, ending(suffixes), 1)).withColumn("its word", F.when((s != "") & ~F.col("its end"), new).otherwise(w))

    given = F.col(word)
    df = words.withColumn("its word", F.regexp_replace(given, "^'", ""))
    # a y that begins the word or follows a vowel is a consonant, Y
    df = df.withColumn("its word", F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y"))
    head = F.regexp_extract(w, f"^({'|'.join(HEADS)}|.*?{VOWEL}{OTHER})", 0)
    df = df.withColumn("its first", F.when(head == "", F.length(w)).otherwise(F.length(head)))
    rest = F.regexp_extract(F.substring(w, one + 1, F.length(w)), f"^.*?{VOWEL}{OTHER}", 0)
    df = df.withColumn("its second", F.when(rest == "", F.length(w)).otherwise(one + F.length(rest))).withColumn("its end", F.lit(False))
    df = step(df, ("'", "'s", "'s'"), _cut(w, s))
    before = F.substring(w, F.lit(1), F.length(w) - F.length(s))
    plain = F.when(before.rlike(f"{VOWEL}.+$"), before).otherwise(w)
    first = F.when(s == "sses", _cut(w, s, "ss")).when(s.isin("ied", "ies"), F.concat(before, F.when(F.length(before) > 1, "i").otherwise("ie"))).when(s == "s", plain).otherwise(w)
    df = step(df, ("sses", "ied", "ies", "us", "ss", "s"), first)
    df = df.withColumn("its end", w.isin(*KEPT))
    # -ed and -ing: what is left may need its e again, or has one letter too many
    df = df.withColumn("its suffix", F.regexp_extract(w, ending(("eed", "eedly", "ed", "edly", "ing", "ingly")), 1))
    gone = ~F.col("its end") & s.isin("ed", "edly", "ing", "ingly") & before.rlike(VOWEL)
    df = df.withColumn("its word", F.when(~F.col("its end") & s.isin("eed", "eedly") & _in(w, s, one), _cut(w, s, "ee")).when(gone, F.concat(before, F.lit("-"))).otherwise(w))
    left = F.regexp_replace(w, "-$", "")
    more = F.when(left.rlike("(at|bl|iz)$"), F.concat(left, F.lit("e"))).when(left.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(left, F.lit(1), F.length(left) - 1))
    more = more.when(left.rlike(SHORT) & (one >= F.length(left)), F.concat(left, F.lit("e"))).otherwise(left)
    df = df.withColumn("its word", F.when(w.endswith("-"), more).otherwise(w))
    df = df.withColumn("its word", F.when(~F.col("its end"), F.regexp_replace(w, "(.[^aeiouy])[yY]$", "$1i")).otherwise(w))
    second = F.when(_in(w, s, one) & F.when(s == "ogi", before.endswith("l")).when(s == "li", before.rlike("[cdeghkmnrt]$")).otherwise(True), F.concat(before, _table(SECOND, s))).otherwise(w)
    df = step(df, SECOND, second)
    df = step(df, THIRD, F.when(_in(w, s, one) & ((s != "ative") | _in(w, s, two)), F.concat(before, _table(THIRD, s))).otherwise(w))
    df = step(df, FOURTH, F.when(_in(w, s, two) & ((s != "ion") | before.rlike("[st]$")), before).otherwise(w))
    fifth = F.when((s == "e") & (_in(w, s, two) | (_in(w, s, one) & ~before.rlike(SHORT))), before).when((s == "l") & _in(w, s, two) & before.endswith("l"), before).otherwise(w)
    df = step(df, ("e", "l"), fifth)
    found = F.when(F.length(given) <= 2, given).when(given.isin(*WHOLE), _table(WHOLE, given)).otherwise(F.translate(w, "Y", "y"))
    return df.withColumn(stem, found).drop("its word", "its suffix", "its first", "its second", "its end")


_STEPS = [re.compile(ending(x)) for x in (("'", "'s", "'s'"), ("sses", "ied", "ies", "us", "ss", "s"), ("eed", "eedly", "ed", "edly", "ing", "ingly"), SECOND, THIRD, FOURTH, ("e", "l"))]
_HEAD, _REGION, _PLAIN, _SHORT, _VOWEL = (re.compile(x) for x in (f"(?:{'|'.join(HEADS)}|.*?{VOWEL}{OTHER})", f".*?{VOWEL}{OTHER}", f"{VOWEL}.+$", SHORT, VOWEL))


def stem_of(word: str) -> str:
    """The stem of one word, by the same rules as ``stemmed`` has for columns."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + w[1:] if w.startswith("y") else w)
    m = _HEAD.match(w)
    one = m.end() if m else len(w)
    m = _REGION.match(w[one:])
    two = one + m.end() if m else len(w)

    def parted(n: int) -> tuple[str, str]:
        m = _STEPS[n].search(w)
        return (w[: m.start()], m[1]) if m else (w, "")

    left, s = parted(0)
    w = left
    left, s = parted(1)
    if s == "sses":
        w = left + "ss"
    elif s in ("ied", "ies"):
        w = left + ("i" if len(left) > 1 else "ie")
    elif s == "s" and _PLAIN.search(left):
        w = left
    if w not in KEPT:
        left, s = parted(2)
        if s in ("eed", "eedly"):
            w = left + "ee" if len(left) >= one else w
        elif s and _VOWEL.search(left):
            w = left
            if re.search("(?:at|bl|iz)$", w):
                w += "e"
            elif re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _SHORT.search(w) and one >= len(w):
                w += "e"
        w = re.sub("(.[^aeiouy])[yY]$", r"\1i", w)
        left, s = parted(3)
        if s and len(left) >= one and (s != "ogi" or left.endswith("l")) and (s != "li" or re.search("[cdeghkmnrt]$", left)):
            w = left + SECOND[s]
        left, s = parted(4)
        if s and len(left) >= one and (s != "ative" or len(left) >= two):
            w = left + THIRD[s]
        left, s = parted(5)
        if s and len(left) >= two and (s != "ion" or re.search("[st]$", left)):
            w = left
        left, s = parted(6)
        if (s == "e" and (len(left) >= two or (len(left) >= one and not _SHORT.search(left)))) or (s == "l" and len(left) >= two and left.endswith("l")):
            w = left
    return w.replace("Y", "y")
