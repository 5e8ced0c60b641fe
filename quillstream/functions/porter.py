"""The suffix stripping of Porter (1980), and expressions for full-text search over its stems.

Words are stemmed once each: a column of texts is exploded to distinct words by its caller, or passed through `stems`,
which remembers the words of a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values of the published algorithm: suffix and replacement; the longest that fits decides. Steps 2 and 3 ask for a
#: vowel-consonant sequence before the suffix, step 4 for two.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
LONGEST, SHORTEST = 64, 3


def _shape(word: str) -> str:
    """Vowels as v and all else as c; a y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(part: str) -> int:
    return len(re.findall("v+c+", _shape(part)))


def _closed(part: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(part)[-3:] == "cvc" and part[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _replaced(word: str, table: dict[str, str]) -> str:
    end = _longest(word, table)
    if end is None or _measure(word[: -len(end)]) < 1:
        return word
    return word[: -len(end)] + table[end]


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    end = _longest(word, ("ed", "ing"))
    root = word[: -len(end)] if end else ""
    if "v" not in _shape(root):
        return word
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if len(root) > 1 and root[-1] == root[-2] and _shape(root)[-1] == "c" and root[-1] not in "lsz":
        return root[:-1]
    return root + "e" if _measure(root) == 1 and _closed(root) else root


def _bare(word: str) -> str:
    end = _longest(word, STEP_4)
    root = word[: -len(end)] if end else word
    if end is None or _measure(root) < 2 or (end == "ion" and not root.endswith(("s", "t"))):
        return word
    return root


def _tidy(word: str) -> str:
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _closed(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    """The stem of a lower-case word; what is shorter than SHORTEST, longer than LONGEST bytes or not all of a-z stays."""
    if not SHORTEST <= len(word) <= LONGEST or not re.fullmatch("[a-z]+", word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_bare(_replaced(_replaced(word, STEP_2), STEP_3)))


@F.pandas_udf(ArrayType(StringType()))
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrays of lower-case words as stems, in order; null stays null. A batch's distinct words are stemmed once."""
    for batch in words:
        known: dict[str, str] = {}
        out = []
        for row in batch:
            if row is not None:
                for w in row:
                    if w not in known:
                        known[w] = stem(w)
            out.append(None if row is None else [known[w] for w in row])
        yield pd.Series(out, dtype=object)


def match_expression(terms: Column) -> Column:
    """Terms as one full-text expression, quoted and joined by OR; null where there are none."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(quoted, " OR "))
