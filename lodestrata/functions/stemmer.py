"""Suffix stripping after Porter, "An algorithm for suffix stripping" (1980).

The rules are tables; with the two customary revisions (bli to ble, logi to
log).  Words of one or two letters stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffixes and their replacements, by step of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def replaced(word: str, rules: dict[str, str], holds: Callable[[str], bool]) -> str:
    end = longest(word, rules)
    if end is None:
        return word
    base = word[: -len(end)]
    return base + rules[end] if holds(base) else word


def plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    end = longest(word, ("ed", "ing"))
    if end is None or "v" not in shape(word[: -len(end)]):
        return word
    base = word[: -len(end)]
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if double_end(base) and base[-1] not in "lsz":
        return base[:-1]
    return base + "e" if measure(base) == 1 and short_end(base) else base


def final_y(word: str) -> str:
    return word[:-1] + "i" if word.endswith("y") and "v" in shape(word[:-1]) else word


def dropped(word: str) -> str:
    end = longest(word, STEP_4)
    if end is None:
        return word
    base = word[: -len(end)]
    return base if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))) else word


def tidy(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = final_y(past(plural(word)))
    word = replaced(word, STEP_2, lambda base: measure(base) > 0)
    word = replaced(word, STEP_3, lambda base: measure(base) > 0)
    return tidy(dropped(word))


@F.pandas_udf(StringType())
def stem_words(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(stem, na_action="ignore")


def with_stems(words: DataFrame, word_col: str = "word") -> DataFrame:
    """words with their stem.  Each distinct word is stemmed once and joined back."""
    stems = words.select(word_col).where(F.col(word_col).isNotNull()).distinct().withColumn("stem", stem_words(word_col))
    return words.join(stems, word_col, "left")
