"""English stemming (Porter, 1980) and stop words as an option for keyword search."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Frequent English words that say nothing about a topic.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these "
    "they this to was we were what when where which who will with would you your"
).split()
# The published suffix rules of steps 2 to 4, each tried in order.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
PAIRS_2, PAIRS_3 = ([tuple(p.split(":")) for p in s.split()] for s in (STEP_2, STEP_3))


def vowels(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant changes."""
    return vowels(stem).count("vc")


def ends_short(word: str) -> bool:
    """consonant, vowel, consonant other than w, x, y."""
    return vowels(word)[-3:] == "cvc" and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and vowels(word)[-1] == "c"


def replaced(word: str, pairs: list[tuple[str, str]]) -> str:
    """The longest ending of the list that fits is replaced where the rest has a measure above 0."""
    for end, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            rest = word[: -len(end)]
            return rest + new if measure(rest) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    tail = None
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in vowels(word[:-2]):
        tail = word[:-2]
    elif word.endswith("ing") and "v" in vowels(word[:-3]):
        tail = word[:-3]
    if tail is not None:
        word = tail
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and ends_short(word):
            word += "e"
    if word.endswith("y") and "v" in vowels(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, PAIRS_2), PAIRS_3)
    for end in sorted(STEP_4.split(), key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not ends_short(rest)):
            word = rest
    return word[:-1] if measure(word) > 1 and doubled(word) and word.endswith("l") else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Stems of token arrays without stop words; Arrow batches, each distinct word once a worker."""
    stop = set(STOP_WORDS)
    return tokens.map(lambda ts: [stem(t) for t in ts if t not in stop] if ts is not None else None)


def index_text(text: Column) -> Column:
    """Text as stems, ready for the keyword search."""
    from weftline.functions.text import tokens

    return F.array_join(stemmed(tokens(text)), " ")


def query_text(query: str) -> str:
    """A query prepared as ``index_text`` prepares the chunks."""
    import re

    return " ".join(stem(t) for t in re.findall("[a-z]+", query.lower()) if t not in STOP_WORDS)
