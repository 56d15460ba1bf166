"""Consonant skeletons that spellings of a name share across scripts."""

from __future__ import annotations

from itertools import product

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rowgraph.functions.text import collapse_repeats

#: Readings kept of one word, and combinations kept while words are joined.
READINGS, COMBINATIONS = 8, 32

_DIGRAPHS = {"kh": "X", "gh": "Q", "sh": "C", "ch": "C", "zh": "J", "ph": "F"}


def _table(spec: str) -> dict[str, tuple[str, ...]]:
    out = {}
    for part in spec.split():
        letters, sounds = part.split("=")
        for letter in letters:
            out[letter] = tuple(s.replace("0", "") for s in sounds.split("/"))
    return out


_PERSIAN = _table(
    "ب=b پ=p تط=t ثسص=s ج=j چ=c حهة=h خ=x د=d ذزضظ=z ر=r ژ=j ش=c ف=f کك=k گ=g ل=l م=m ن=n قغ=q عءئأإؤاآ=0 و=v/0 یي=y/0"
)
_CYRILLIC = _table(
    "б=b в=v г=g д=d ж=j з=z к=k л=l м=m н=n п=p р=r с=s т=t ф=f х=x ц=ts чшщ=c й=y/0 аоуыэиеёяюіїєьъ=0"
)


def _squeeze(s: str) -> str:
    return "".join(c for i, c in enumerate(s) if i == 0 or s[i - 1] != c)


def _readings(classes: list[tuple[str, ...]]) -> list[str]:
    """Skeletons from the choices of each letter, the first few of them."""
    forms = [""]
    for choices in classes:
        forms = list(dict.fromkeys(f + c for f, c in product(forms, choices)))[:READINGS]
    return [k for k in dict.fromkeys(map(_squeeze, forms)) if k][:READINGS]


def _latin(word: str) -> list[str]:
    s = word.replace("'", "")
    for pair, mark in _DIGRAPHS.items():
        s = s.replace(pair, mark)
    sounds = []
    for i, c in enumerate(s):
        if "A" <= c <= "Z":
            sounds.append(c.lower())
        elif "a" <= c <= "z" and c not in "aeiou" and not (c in "yw" and i):
            sounds.append({"w": "v", "c": "k"}.get(c, c))
    key = _squeeze("".join(sounds))
    bare = "".join(c for c in s if not "A" <= c <= "Z")
    if key.endswith("h") and bare[-1:] == "h" and bare[-2:-1] in tuple("aeiou"):
        return [k for k in (key, key[:-1]) if k]
    return [key] if key else []


def _persian(word: str) -> list[str]:
    classes = []
    for i, c in enumerate(word):
        choices = _PERSIAN.get(c)
        if choices is None:
            continue
        if i == 0 and c in "ویي":
            choices = choices[:1]
        elif i == len(word) - 1 and c in "هة":
            choices = ("h", "")
        classes.append(choices)
    return _readings(classes)


def _cyrillic(word: str) -> list[str]:
    classes = []
    for i, c in enumerate(word):
        if i == 0 and c in "яюёеєї":
            classes.append(("y", ""))
        elif i == 0 and c == "й":
            classes.append(("y",))
        elif c in _CYRILLIC:
            classes.append(_CYRILLIC[c])
    return _readings(classes)


def _word(word: str) -> list[str]:
    if any("؀" <= c <= "ۿ" for c in word):
        return _persian(word)
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return _cyrillic(word)
    return _latin(word) if any("a" <= c <= "z" for c in word) else []


def phonetic_keys(name: str | None) -> list[str]:
    """The skeletons of a name, words joined by a space; none if no script fits."""
    words = regex.findall(r"[\p{Alphabetic}']+", (name or "").lower())
    keys: list[str] = []
    for found in filter(None, map(_word, words)):
        keys = [f"{k} {w}" for k, w in product(keys, found)][:COMBINATIONS] if keys else found
    return list(dict.fromkeys(keys))


@F.pandas_udf(ArrayType(StringType()))
def phonetic_keys_udf(name: pd.Series) -> pd.Series:
    return name.map(lambda s: [] if s is None else phonetic_keys(s))


def latin_keys(word: Column) -> Column:
    """The skeletons of one word of ``a-z`` only, as a JVM expression."""
    s = word
    for pair, mark in _DIGRAPHS.items():
        s = F.replace(s, F.lit(pair), F.lit(mark))
    head = F.regexp_replace(F.substring(s, 1, 1), "[aeiou]", "")
    tail = F.regexp_replace(s.substr(F.lit(2), F.length(s)), "[aeiouyw]", "")
    key = collapse_repeats(F.lower(F.translate(F.concat(F.translate(head, "w", "v"), tail), "c", "k")))
    fork = F.regexp_replace(s, "[A-Z]", "").rlike("[aeiou]h$") & key.endswith("h")
    keys = F.when(fork, F.array(key, F.regexp_replace(key, "h$", ""))).otherwise(F.array(key))
    return F.array_remove(keys, "")
