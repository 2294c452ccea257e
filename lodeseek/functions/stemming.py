"""English stemming by the published Porter2 (Snowball English) algorithm, once for each distinct word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T

VOWELS = "aeiouy"
#: Words with stems of their own, and words left alone once their plural is off.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings with a first region of their own, double letters, letters before -li, suffixes and what they become.
REGION_STARTS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _ending(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _region(word: str, start: int) -> int:
    """Behind the first consonant that follows a vowel."""
    m = re.compile(rf"[{VOWELS}][^{VOWELS}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """A short syllable at the end: a vowel between consonants, the last not w, x or Y; or a vowel that begins the word."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Of a lower-case word."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.removeprefix("'")
    word = re.sub(rf"(^|[{VOWELS}])y", lambda m: m[1] + "Y", word)  # a y that is a consonant
    start = next((len(p) for p in REGION_STARTS if word.startswith(p)), None)
    r1 = start if start is not None else _region(word, 0)
    r2 = _region(word, r1)
    has_vowel = lambda part: any(c in VOWELS for c in part)

    suffix = _ending(word, ("'s'", "'s", "'"))
    if suffix:
        word = word[: -len(suffix)]
    # step 1a: plurals
    suffix = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        word = word[:-2]
    elif suffix in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif suffix == "s" and has_vowel(word[:-2]):
        word = word[:-1]
    if word in INVARIANT:
        return word
    # step 1b: past and participle
    suffix = _ending(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and has_vowel(word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    # step 1c: y to i
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # steps 2 and 3
    suffix = _ending(word, STEP_2)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)]
        if not (suffix == "ogi" and not before.endswith("l") or suffix == "li" and before[-1:] not in tuple(LI_ENDINGS)):
            word = before + STEP_2[suffix]
    suffix = _ending(word, STEP_3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + STEP_3[suffix]
    # step 4: suffixes go
    suffix = _ending(word, STEP_4)
    if suffix and len(word) - len(suffix) >= r2 and not (suffix == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(suffix)]
    # step 5: a last e or l
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def english_tokens(text: Column) -> Column:
    """The tokens of functions.text, stemmed: plurals and inflected forms are one term."""
    return _stems(T.tokens(text))
