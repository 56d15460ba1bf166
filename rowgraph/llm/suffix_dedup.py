"""Repeated passages through sparse suffix arrays.

A text is its words, lower-cased and hashed.  Of the suffixes only those at
minimiser positions are kept: in every stretch of ``min_words`` words the
leftmost 8-gram of least hash, a choice that depends on the content alone, so
the same passage keeps the same suffixes in every document.  Kept suffixes are
sorted by their 8-gram and compared with their neighbours.  How far a match
reaches to the left and right is read off hashes instead of words: every
stretch that chose a position travels beside it, as 64 bits and its place, and
neighbours in the order of 8-gram with place and of hash that agree in both, 128
bits together, are one passage; stretches that follow each other join up.
Shipping the words themselves would be over three times as much.

Result: one row per document that shares a passage of ``min_words`` words or
more with another document: the maximal word spans (end exclusive), how many
words they cover, and the spans and words that repeat a document of smaller id
(those to remove if the first occurrence is to stay).

An 8-gram kept more than ``HOT`` times is split by the hash of its stretches,
so equal stretches still meet while no task holds the whole of it.  A task
takes its sorted 8-grams in portions of about ``PORTION`` stretches.

Defined results: null, empty and short texts have no span; repetition within
one document, or within rows of the same id, does not count; a row with a null
id is left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.runtime import cut, ship_package

GRAM = 8
HOT = 20_000
#: Hot 8-grams that may be broadcast (12 bytes each).
HOT_BROADCAST = 10_000
CHUNK = 1_000_000
#: Stretches compared at once, some 100 bytes each; one part of an 8-gram stays whole.
PORTION = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


class Roller:
    """Hashes of all stretches of a given length by prefix sums of powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, np.uint64)
            power[0] = 1
            self.power = np.multiply.accumulate(power)
            inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.inverse = np.multiply.accumulate(inverse)
            self.sums = np.concatenate([[np.uint64(0)], np.add.accumulate(words * self.power[:n])])

    def hashes(self, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            d = self.sums[length:] - self.sums[:-length]
            return _mix(d * self.inverse[: len(d)] + np.uint64(length))


def kept_suffixes(words: np.ndarray, starts: np.ndarray, min_words: int):
    """The kept positions of texts laid end to end.

    ``starts`` has the first word of each text and the end of the last.  Gives
    for each run of stretches with the same kept position: its 8-gram's hash,
    the text, the run's first stretch, the position relative to it, and where
    its stretches begin in the array of their hashes, which comes last.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < min_words:
        return none.view(np.uint64), none, none, none, np.zeros(1, np.int64), none
    roller = Roller(words)
    grams, stretches = roller.hashes(GRAM), roller.hashes(min_words)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.flatnonzero(np.arange(n - min_words + 1) + min_words <= starts[1:][text[: n - min_words + 1]])
    if not len(first):
        return none.view(np.uint64), none, none, none, np.zeros(1, np.int64), none
    width = min_words - GRAM + 1
    # least value over each width by doubling, then the leftmost place that has it
    least, span = grams.copy(), 1
    place = np.arange(len(grams))
    while span < width:
        step = min(span, width - span)
        take = least[step:] < least[:-step]
        place = np.where(take, place[step:], place[:-step])
        least = np.where(take, least[step:], least[:-step])
        span += step
    at = place[first]
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[first[1:]] != text[first[:-1]])
    runs = np.flatnonzero(new)
    begin = first[runs]
    return (
        grams[at[runs]],
        text[begin],
        begin - starts[text[begin]],
        at[runs] - begin,
        np.append(runs, len(first)),
        stretches[first].view(np.int64),
    )


_KEPT = "gram long, id long, begin int, lead int, stretches array<long>"


def _keep(docs: DataFrame, min_words: int, grams_only: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            words = batch.column(1)
            offsets = np.asarray(words.offsets)
            flat = np.asarray(words.values).view(np.uint64)
            ids, low = batch.column(0), 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
                starts = offsets[low : high + 1].astype(np.int64)
                gram, text, begin, lead, edges, hashes = kept_suffixes(flat[starts[0] : starts[-1]], starts - starts[0], min_words)
                if len(gram) and grams_only:
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])
                elif len(gram):
                    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(hashes))
                    columns = [pa.array(gram.view(np.int64)), ids.slice(low).take(pa.array(text)), pa.array(begin.astype(np.int32)), pa.array(lead.astype(np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "id", "begin", "lead", "stretches"])
                low = high

    return docs.mapInArrow(run, "gram long" if grams_only else _KEPT)


def _portions(batches):
    """Tables of whole 8-gram parts from sorted batches, of about ``PORTION`` stretches each."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, part = batch.column("gram").to_numpy(), batch.column("part").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.asarray(batch.column("stretches").offsets).astype(np.int64)
        at = 0
        for cut_at in starts:
            if cut_at:
                size += int(sizes[cut_at] - sizes[at])
                held.append(batch.slice(at, cut_at - at))
                at = cut_at
            new = not held or (gram[cut_at], part[cut_at]) != tuple(held[-1].column(c)[-1].as_py() for c in ("gram", "part"))
            if new and size >= PORTION:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        size += int(sizes[batch.num_rows] - sizes[at])
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _repeated(table: pa.Table, min_words: int):
    """Spans from whole 8-grams: sort, compare neighbours, join up."""
    table = table.combine_chunks()
    lists = table.column("stretches").chunk(0)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    hashes = np.asarray(lists.flatten()).view(np.uint64)
    row = np.repeat(np.arange(table.num_rows), np.diff(offsets))
    # stretches of a row follow each other unless their places are named
    places = np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]
    named = table.column("places").chunk(0)
    places[np.asarray(named.is_valid())[row]] = np.asarray(named.flatten())
    gram = table.column("gram").to_numpy().view(np.uint64)[row]
    ids, begin = table.column("id").to_numpy()[row], table.column("begin").to_numpy()[row] + places
    rel = (table.column("lead").to_numpy()[row] - places).astype(np.uint64)
    with np.errstate(over="ignore"):
        where = _mix(gram + _mix(rel))
    order = np.lexsort((hashes, where))
    k, h = where[order], hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
    low, high = np.minimum.reduceat(ids[order], heads), np.maximum.reduceat(ids[order], heads)
    sizes = np.diff(np.append(heads, len(k)))
    several, least = np.empty(len(k), bool), np.empty(len(k), np.int64)
    several[order], least[order] = np.repeat(low < high, sizes), np.repeat(low, sizes)
    hit = np.flatnonzero(several)
    if not len(hit):
        return
    later = ids[hit] > least[hit]
    # neighbouring stretches of one run that agree join up
    joined = (row[hit][1:] == row[hit][:-1]) & (begin[hit][1:] == begin[hit][:-1] + 1) & (later[1:] == later[:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
    tails = np.append(heads[1:], len(hit)) - 1
    columns = [ids[hit][heads], begin[hit][heads], begin[hit][tails] + min_words, later[heads]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "start", "stop", "later"])


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, with those that touch or overlap joined."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[heads], reach[np.append(heads[1:], len(start)) - 1] if len(start) else reach


_SPANS = "n_words long, spans array<struct<start:int,stop:int>>, later_words long, later_spans array<struct<start:int,stop:int>>"


def _joined(batches):
    """One row a document from all its spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        out = {"n_words": [], "spans": [], "later_words": [], "later_spans": []}
        for found in batch.column("found"):
            start, stop, later = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop", "later"))
            for words, spans, rows in (("n_words", "spans", slice(None)), ("later_words", "later_spans", later)):
                a, b = _merged(start[rows], stop[rows])
                out[words].append(int((b - a).sum()))
                out[spans].append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())])
        kinds = (pa.int64(), kind, pa.int64(), kind)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["id", *out])


def repeated_passages(
    docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows ``(id, n_words, spans, later_words, later_spans)`` of documents that share a passage."""
    if min_words < GRAM:
        raise ValueError(f"min_words is {GRAM} at least")
    ship_package(docs.sparkSession)
    hashed = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), word_hashes(F.col(text_col)).alias("w"))
    hot = cut(
        _keep(hashed, min_words, grams_only=True).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
        .select("gram", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    )
    kept, many = _keep(hashed, min_words), hot.count()
    whole = F.struct(F.lit(0).alias("part"), F.col("stretches"), F.lit(None).cast("array<int>").alias("places"))
    if many:
        # a few rows of two numbers, or else a join
        rows = kept.join(F.broadcast(hot) if many <= HOT_BROADCAST else hot, "gram", "left")
        at = F.sequence(F.lit(0), F.size("stretches") - 1)

        def piece(p: Column) -> Column:
            mine = F.filter(at, lambda k: F.pmod(F.hash(F.get("stretches", k)), F.col("parts")) == p)
            return F.struct(p.alias("part"), F.transform(mine, lambda k: F.get("stretches", k)).alias("stretches"), mine.alias("places"))

        pieces = F.filter(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), piece), lambda x: F.size(x["places"]) > 0)
        rows = rows.select("gram", "id", "begin", "lead", F.explode(F.when(F.col("parts").isNull(), F.array(whole)).otherwise(pieces)).alias("x"))
        rows = rows.select("gram", "x.part", "id", "begin", "lead", "x.stretches", "x.places")
    else:
        rows = kept.select("gram", "id", "begin", "lead", whole.alias("x")).select("gram", "x.part", "id", "begin", "lead", "x.stretches", "x.places")
    found = rows.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(
        lambda b: (x for t in _portions(b) for x in _repeated(t, min_words)), "id long, start int, stop int, later boolean"
    )
    grouped = found.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "later")).alias("found"))
    made = grouped.mapInArrow(_joined, f"id long, {_SPANS}")
    return made.select(F.col("id").alias(id_col), "n_words", "spans", "later_words", "later_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")

    return found.select("doc_id", "n_words", joined("spans").alias("spans"), "later_words", joined("later_spans").alias("later_spans"))
