"""English stems (the Snowball English algorithm) as a column expression.

Words are best stemmed as a table of different words, not where they stand in texts: a vocabulary grows far more slowly than its corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words with stems of their own; those that stay as they are; those that stay once the plural is off.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings of the second and third step and what they become; endings that the fourth one takes off; beginnings that count as a first region.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
BEGINNINGS = ("gener", "commun", "arsen")

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
#: A vowel between consonants, the last no w, x or Y; or a vowel that begins the word, and a consonant.
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _cut(word: Column, ending: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending))


def _becomes(ending: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[ending]


def _step(word: Column, endings, rule) -> Column:
    """``rule`` (word, its longest ending of these, what is before it), or the word if it has none."""
    found = F.regexp_extract(word, f"({'|'.join(sorted(endings, key=len, reverse=True))})$", 1)
    parts = lambda x: F.struct(x["w"].alias("w"), x["e"].alias("e"), _cut(x["w"], x["e"]).alias("c"))
    whole = lambda x: F.when(x["e"] == "", x["w"]).otherwise(rule(x["w"], x["e"], x["c"]))
    return _let(_let(F.struct(word.alias("w"), found.alias("e")), parts), whole)


def _region(word: Column) -> Column:
    """The place behind the first consonant that follows a vowel; the word's end if there is none."""
    size = F.length(F.regexp_extract(word, f"^.*?{_VOWEL}{_OTHER}", 0))
    return F.when(size > 0, size).otherwise(F.length(word))


def _plural(w: Column, e: Column, c: Column) -> Column:
    y = F.concat(c, F.when(F.length(c) > 1, "i").otherwise("ie"))
    s = F.when(F.substring(c, F.lit(1), F.length(c) - 1).rlike(_VOWEL), c).otherwise(w)
    return F.when(e == "sses", F.concat(c, F.lit("ss"))).when(e.isin("ied", "ies"), y).when(e == "s", s).otherwise(w)


def _stemmed(word: Column, r1: Column, r2: Column) -> Column:
    first, second = (lambda c: F.length(c) >= r1), (lambda c: F.length(c) >= r2)

    def participle(w: Column, e: Column, c: Column) -> Column:
        after = F.when(c.rlike("(at|bl|iz)$"), F.concat(c, F.lit("e"))).when(c.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(c, F.lit("x")))
        after = after.when(c.rlike(_SHORT) & (r1 >= F.length(c)), F.concat(c, F.lit("e"))).otherwise(c)
        return F.when(e.isin("eed", "eedly"), F.when(first(c), F.concat(c, F.lit("ee"))).otherwise(w)).when(c.rlike(_VOWEL), after).otherwise(w)

    def derived(w: Column, e: Column, c: Column) -> Column:
        rule = F.when(e == "ogi", F.when(c.rlike("l$"), F.concat(c, F.lit("og"))).otherwise(w)).when(e == "li", F.when(c.rlike("[cdeghkmnrt]$"), c).otherwise(w))
        return F.when(first(c), rule.otherwise(F.concat(c, _becomes(e, SECOND)))).otherwise(w)

    def shorter(w: Column, e: Column, c: Column) -> Column:
        rule = F.when(e == "ative", F.when(second(c), c).otherwise(w))
        return F.when(first(c), rule.otherwise(F.concat(c, _becomes(e, THIRD)))).otherwise(w)

    def off(w: Column, e: Column, c: Column) -> Column:
        return F.when(second(c) & ((e != "ion") | c.rlike("[st]$")), c).otherwise(w)

    def last(w: Column, e: Column, c: Column) -> Column:
        e_goes = second(c) | (first(c) & ~c.rlike(_SHORT))
        return F.when(F.when(e == "e", e_goes).otherwise(second(c) & c.rlike("l$")), c).otherwise(w)

    out = _step(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"), participle)
    out = F.regexp_replace(out, f"(?<=.{_OTHER})[yY]$", "i")
    out = _step(out, (*SECOND, "ogi", "li"), derived)
    out = _step(out, (*THIRD, "ative"), shorter)
    out = _step(out, (*FOURTH, "ion"), off)
    return F.translate(_step(out, ("e", "l"), last), "Y", "y")


def stem(word: Column) -> Column:
    """The stem of a word in small letters; words of one or two letters, and whatever has other than letters, stay as they are."""
    own = F.when((F.length(word) < 3) | ~word.rlike("^[a-z]+$"), word).otherwise(_becomes(word, OWN | {x: x for x in SAME}))
    # a y that begins the word or follows a vowel is a consonant
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")

    def regions(x: Column) -> Column:
        start = F.length(F.regexp_extract(x["w"], f"^({'|'.join(BEGINNINGS)})", 1))
        return F.struct(x["w"].alias("w"), F.when(start > 0, start).otherwise(_region(x["w"])).alias("r1"))

    def both(x: Column) -> Column:
        rest = F.substring(x["w"], x["r1"] + 1, F.length(x["w"]))
        return F.struct(_step(x["w"], ("sses", "ied", "ies", "us", "ss", "s"), _plural).alias("w"), x["r1"].alias("r1"), (x["r1"] + _region(rest)).alias("r2"))

    stemmed = lambda x: F.when(x["w"].isin(*KEPT), x["w"]).otherwise(_stemmed(x["w"], x["r1"], x["r2"]))
    return F.coalesce(own, _let(_let(_let(F.struct(marked.alias("w")), regions), both), stemmed))


def with_stems(words: DataFrame, column: str = "token", name: str = "stem") -> DataFrame:
    """``words`` with the stem of each."""
    return words.withColumn(name, stem(F.col(column)))
