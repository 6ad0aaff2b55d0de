"""English words brought to their stems, and stop words left out, for full-text search.

The rules are those of the published English stemmer of the Snowball family, written as tables: a step looks for the longest
ending it knows and applies it if the ending lies in the step's region.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# fixed values: words that say nothing about a text
STOP = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down
    during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my
    myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your
    yours yourself yourselves""".split()
)
# fixed values: words with stems of their own
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
VOWEL, NO_VOWEL = "[aeiouy]", "[^aeiouy]"
# fixed values: endings of the steps, with what replaces them
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = {e: "" for e in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()}


def _longest(word: str, endings: dict[str, str]) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the word's first and second region begin."""
    whole = re.match("gener|commun|arsen", word)
    first = whole or re.search(VOWEL + NO_VOWEL, word)
    at = first.end() if first else len(word)
    second = re.compile(VOWEL + NO_VOWEL).search(word, at)
    return at, second.end() if second else len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return re.search(rf"(?:{NO_VOWEL}{VOWEL}[^aeiouywxY]|^{VOWEL}{NO_VOWEL})$", word) is not None


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        return w[:-1]
    return w


def _past(w: str, first: int) -> str:
    ending = _longest(w, dict.fromkeys(("eed", "eedly", "ed", "edly", "ing", "ingly"), ""))
    body = w[: len(w) - len(ending)]
    if ending.startswith("eed"):
        return body + "ee" if len(body) >= first else w
    if not ending or not re.search(VOWEL, body):
        return w
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", body):
        return body[:-1]
    return body + "e" if _short(body) and first >= len(body) else body


@functools.lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in WHOLE:
        return WHOLE.get(word, word)
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.lstrip("'"))
    first, second = _regions(w)
    w = _plural(re.sub(r"'s?'?$", "", w))
    if w in KEPT:
        return w
    w = _past(w, first)
    w = re.sub(rf"(?<=.{NO_VOWEL})[yY]$", "i", w)
    for step, endings in enumerate((SECOND, THIRD, FOURTH)):
        ending = _longest(w, endings)
        body = w[: len(w) - len(ending)]
        fits = len(body) >= (first if step < 2 else second)
        if ending == "ogi":
            fits = fits and body.endswith("l")
        elif ending == "li":
            fits = fits and body.endswith(tuple("cdeghkmnrt"))
        elif ending == "ative":
            fits = fits and len(body) >= second
        elif ending == "ion":
            fits = fits and body.endswith(("s", "t"))
        if ending and fits:
            w = body + endings[ending]
    if w.endswith("e") and (len(w) > second or len(w) > first and not _short(w[:-1])) or w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.lower()


@pandas_udf(T.ArrayType(T.StringType()))
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of an array of lower-case words, stop words left out; null stays null."""
    for part in words:
        yield part.map(lambda row: None if row is None else [stem(w) for w in row if w not in STOP])


def analysed(text: Column) -> Column:
    """The stems of a text's words in order: runs of letters a-z, digits and inner apostrophes."""
    return stems(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+(?:'[a-z]+)?)")))
