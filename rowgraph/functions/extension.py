"""Pluggable extraction, vetting, relations and embeddings.

A point is a function from columns to a column, the name of a registered SQL
function, or None for the default.  ``python_point`` wraps a Python function
so that its errors cost one row, not the job.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowgraph.functions.columns import let
from rowgraph.functions.text import tokenize

Point = str | Callable[..., Column] | None


def _call(point: Point, *columns: Column) -> Column:
    return F.call_function(point, *columns) if isinstance(point, str) else point(*columns)


def _blank(point: Point) -> bool:
    return point is None or (isinstance(point, str) and not point.strip())


def python_point(f: Callable, kind: str = "array<string>", on_error=None) -> Callable[..., Column]:
    """A vectorised wrapper; a row on which ``f`` raises gives ``on_error`` and a warning."""

    def run(*series: pd.Series) -> pd.Series:
        out = []
        for row in zip(*series):
            try:
                out.append(f(*[list(x) if hasattr(x, "tolist") else x for x in row]))
            except Exception as e:  # noqa: BLE001 - the row's failure is the contract
                warnings.warn(f"an extension point failed on a row: {e}", stacklevel=1)
                out.append(on_error)
        return pd.Series(out)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return lambda *c: F.pandas_udf(one if len(c) == 1 else two, kind)(*c)


def extract(text: Column, extractor: Point = None) -> Column:
    """The surfaces of a text; null results are empty, null elements dropped."""
    if _blank(extractor):
        return tokenize(text)
    return F.coalesce(F.array_compact(_call(extractor, text)), F.array().cast("array<string>"))


def vet(text: Column, surfaces: Column, judge: Point = None) -> Column:
    """What the judge keeps; a null verdict keeps everything."""
    if _blank(judge):
        return surfaces
    return F.coalesce(F.array_compact(_call(judge, text, surfaces)), surfaces)


def relations(text: Column, extractor: Point) -> Column:
    """``(subject, predicate, object)`` from a flat array; nulls go first, a rest is dropped."""

    def chunks(flat: Column) -> Column:
        n = F.floor(F.size(flat) / 3).cast("int")
        triples = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.get(flat, 3 * i).alias("subject"), F.get(flat, 3 * i + 1).alias("predicate"), F.get(flat, 3 * i + 2).alias("object")
            ),
        )
        return F.when(n > 0, triples)

    return let(F.array_compact(_call(extractor, text)), chunks)


def embed(norm: Column, embedder: Point) -> Column:
    """A vector of doubles without its null elements, or null if nothing is left."""
    made = F.array_compact(_call(embedder, norm))
    return F.when(F.size(made) > 0, made)
