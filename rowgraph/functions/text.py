"""Text scalars as column expressions: tokens, names, entropy, shingles, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Texts of these characters only are the same after NFKC.
_PLAIN = r"^[\x00-\x7FÀ-ľŁ-ňŊ-žЀ-ӿ؀-ْٖ-ٴٹ-ۿ‌‍]*$"


#: Names of these characters only are their own keys.
_KEY = r"^[a-z0-9ß-öø-ÿ]*$"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, each once, in order of appearance."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{_ALNUM}]+")
    return F.array_distinct(F.array_remove(parts, ""))


def fold_characters(name: Column) -> Column:
    """Arabic letter variants folded to Persian ones; marks, tatweel and joiners dropped."""
    folded = F.translate(name, "يكآأإة", "یکاااه")
    return F.regexp_replace(folded, r"[ً-ٰۖ-ۭـ‌‍]", "")


@F.pandas_udf(StringType())
def _nfkc(name: pd.Series) -> pd.Series:
    return name.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(names: pd.Series) -> pd.Series:
    """The compatibility step for all names of an array."""
    return names.map(lambda a: None if a is None else [None if s is None else unicodedata.normalize("NFKC", s) for s in a])


def normalize_name(name: Column, nfkc: bool = True) -> Column:
    """The key under which spellings of one name meet; empty if nothing is left.

    With ``nfkc`` false the compatibility step is skipped and the expression
    stays in the JVM; only for text known not to need it.
    """
    made = F.coalesce(_nfkc(F.when(~name.rlike(_PLAIN), name)), name) if nfkc else name
    lower = F.lower(fold_characters(made))
    trimmed = F.regexp_replace(lower, f"^[^{_ALNUM}]+|[^{_ALNUM}]+$", "")
    return F.when(name.rlike(_KEY), name).otherwise(F.btrim(F.regexp_replace(trimmed, r"\p{IsWhite_Space}+", " ")))


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def entropy(text: Column) -> Column:
    """Shannon entropy over the characters of a text, in bits."""
    sizes = F.transform(
        F.array_distinct(characters(text)), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")
    )
    n = F.length(text).cast("double")
    return F.aggregate(sizes, F.lit(0.0), lambda h, k: h - k / n * F.log2(k / n))


def passes_gate(norm: Column, least: float = 2.0) -> Column:
    """Whether a name is distinctive enough; exactly ``least`` bits pass."""
    return entropy(norm) >= least - 1e-9


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct character n-grams; a text no longer than one is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: text.substr(i, F.lit(size)))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) > size, F.array_distinct(grams)).when(F.length(text) > 0, F.array(text)).otherwise(none)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and zero ones."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z
        )

    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(same & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))
