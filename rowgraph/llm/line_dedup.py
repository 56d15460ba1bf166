"""Line deduplication through a sharded minimal perfect hash.

One pass counts, for every distinct line key, the documents that hold it (a
document is a row).  The keys go to shards by hash; each shard becomes a
minimal perfect hash over its keys (displacements found bucket by bucket,
largest first) that indexes two arrays, a fingerprint and a count for each
slot.  A second pass probes the arrays with the documents' line hashes; lines
are never joined, and texts never leave the JVM.

The shards are written as a table in the shared folder, so that a lost
executor's work can be done again, and Spark hands its files to the executors, from whatever file system it knows and also to an executor
that joins later.  A worker maps the arrays of a shard into memory from its
executor's copy, so workers share the pages, a shard is unpacked once an
executor, and nothing is read again from batch to batch.  Every shard is
written, an empty one too; one that is missing is an error.

Only keys found in ``index_from`` documents or more get a slot.  A key below
that can never be dropped, and the 64-bit fingerprint, from a hash independent
of the one that picks shard and slot, tells it from the keys that have a slot.

Defined results: a null or empty text is one empty line; a row is a document,
so repeated rows count each for itself; a line's key is the line without
``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; empty keys are
never counted.  Other columns pass through, but for those that share the name
of a result (replaced; ``names`` gives the results other names); helper columns
carry a prefix that no table should use (``_line_dedup``).
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.runtime import ensure_checkpoint_dir, ship_package

#: Keys a shard has on average; a shard's arrays take 12 bytes a key and its displacements about one.
KEYS_PER_SHARD = 200_000
#: Keys a bucket has on average while displacements are searched.
BUCKET = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\f\r"


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line):
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _hash(key, seed: int):
    return F.xxhash64(key, F.lit(seed))


def _mix(h: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser over unsigned words."""
    with np.errstate(over="ignore"):
        h = h ^ (np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of 64-bit words: one displacement a bucket."""

    def __init__(self, n: int, displacements: np.ndarray):
        self.n, self.displacements = n, displacements

    @classmethod
    def build(cls, words: np.ndarray) -> "PerfectHash":
        """``words`` are distinct; the result maps them onto ``range(len(words))``."""
        n = len(words)
        buckets = max(1, -(-n // BUCKET))
        where = (_mix(words, 1) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        sizes = np.bincount(where, minlength=buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, dtype=bool)
        found = np.zeros(buckets, dtype=np.uint32)
        for b in np.argsort(-sizes, kind="stable"):
            k = sizes[b]
            if not k:
                break
            mine = words[order[starts[b] : starts[b + 1]]]
            seed, step = 0, 64
            while True:
                tries = np.arange(seed, seed + step, dtype=np.uint64) + np.uint64(2)
                slots = (_mix(mine[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(axis=1)
                if k > 1 and good.any():
                    s = np.sort(slots[good], axis=1)
                    good[np.flatnonzero(good)] = (np.diff(s, axis=1) > 0).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    found[b] = seed + at
                    taken[slots[at]] = True
                    break
                seed, step = seed + step, min(step * 2, 1 << 16)
        return cls(n, found)

    def slots(self, words: np.ndarray) -> np.ndarray:
        bucket = (_mix(words, 1) % np.uint64(len(self.displacements))).astype(np.int64)
        seeds = self.displacements[bucket].astype(np.uint64) + np.uint64(2)
        return (_mix(words, seeds) % np.uint64(self.n)).astype(np.int64)


_SHARD = "shard long, n long, displacements binary, fingerprints binary, counts binary"


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[rows["n"] > 0]  # each shard has a row of its own without a key
    words = rows["h"].to_numpy(np.int64).view(np.uint64)
    table = PerfectHash.build(words)
    slots = table.slots(words)
    prints, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    prints[slots], counts[slots] = rows["f"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    return pd.DataFrame(
        {
            "shard": [int(key[0])],
            "n": [len(words)],
            "displacements": [table.displacements.tobytes()],
            "fingerprints": [prints.tobytes()],
            "counts": [np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()],
        }
    )


_PARTS = {"displacements": np.uint32, "fingerprints": np.int64, "counts": np.uint32}


class Shards:
    """The shards that Spark has handed to this executor, mapped into memory on demand.

    ``files`` has the name of each shard's file.
    """

    def __init__(self, files: list[str]):
        self.files, self.shards = files, len(files)
        self._held: dict[int, tuple] = {}

    def _unpack(self, file: Path, shard: int) -> None:
        import pyarrow.parquet as pq

        found = pq.read_table(file, filters=[("shard", "=", shard)]).to_pylist()
        if len(found) != 1:
            raise FileNotFoundError(f"shard {shard} in {file}: {len(found)} rows")
        for name, kind in _PARTS.items():
            # each worker writes its own file; the last rename of equal content wins
            own = f"{file}.{shard}.{name}.{uuid.uuid4().hex}"
            np.save(own, np.frombuffer(found[0][name], kind))
            os.replace(f"{own}.npy", f"{file}.{shard}.{name}.npy")

    def _get(self, shard: int) -> tuple:
        if shard not in self._held:
            file = Path(SparkFiles.get(self.files[shard]))
            if not Path(f"{file}.{shard}.{list(_PARTS)[-1]}.npy").exists():
                self._unpack(file, shard)
            displacements, prints, counts = (np.load(f"{file}.{shard}.{name}.npy", mmap_mode="r") for name in _PARTS)
            self._held[shard] = PerfectHash(len(prints), displacements), prints, counts
        return self._held[shard]

    def counts(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The document counts of keys by their two hashes; 0 for keys without a slot."""
        out = np.zeros(len(h), np.int64)
        where = (h.view(np.uint64) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order])) + 1
        for part in np.split(order, edges):
            if not len(part):
                continue
            table, prints, counts = self._get(int(where[part[0]]))
            if not table.n:
                continue
            slots = table.slots(h[part].view(np.uint64))
            out[part] = np.where(prints[slots] == f[part], counts[slots], 0)
        return out


def count_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows ``(h, f, n)``: two hashes of each non-empty key, and its documents."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), key_of), lambda k: k != ""))
    return (
        docs.select(F.explode(F.transform(keys, lambda k: F.struct(_hash(k, 0).alias("h"), _hash(k, 1).alias("f")))).alias("k"))
        .groupBy("k.h", "k.f")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def index_lines(counted: DataFrame, index_from: int = 2) -> Shards:
    """Write the shards of the keys found in ``index_from`` documents or more."""
    spark = counted.sparkSession
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    # the counted keys are read twice, for their number and for the shards
    counted.filter(F.col("n") >= index_from).write.parquet(f"{folder}/counted")
    kept = spark.read.parquet(f"{folder}/counted")
    # a shard is one row of binary arrays; the number of shards follows the number of keys
    shards = max(1, -(-kept.count() // KEYS_PER_SHARD))
    shard = F.expr(f"cast(pmod(cast(h as decimal(20,0)) + if(h < 0, 18446744073709551616BD, 0BD), {shards}) as long)")
    zero = F.lit(0).cast("long")
    each = spark.range(shards).select(zero.alias("h"), zero.alias("f"), zero.alias("n"), F.col("id").alias("shard"))
    kept.withColumn("shard", shard).unionByName(each).groupBy("shard").applyInPandas(_build_shard, _SHARD).write.parquet(f"{folder}/shards")
    # a name a shard, and a shard has many thousand keys
    written = spark.read.parquet(f"{folder}/shards").select("shard", F.input_file_name().alias("file")).collect()
    place = {r["shard"]: r["file"] for r in written}
    if sorted(place) != list(range(shards)):
        raise RuntimeError(f"{shards} shards were to be written, not {len(place)}")
    for file in sorted(set(place.values())):
        spark.sparkContext.addFile(file)
    return Shards([unquote(place[k]).rsplit("/", 1)[-1] for k in range(shards)])


def probe(docs: DataFrame, shards: Shards, min_docs: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_line_dedup``: an array of the lines and whether each goes."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<boolean>")
    def frequent(h: pd.Series, f: pd.Series) -> pd.Series:
        sizes = np.fromiter((len(x) for x in h), np.int64, len(h))
        if not sizes.sum():
            return pd.Series([np.zeros(0, bool)] * len(h))
        flags = shards.counts(np.concatenate(h.to_list()).astype(np.int64), np.concatenate(f.to_list()).astype(np.int64)) >= min_docs
        return pd.Series(np.split(flags, np.cumsum(sizes)[:-1]))

    lines = docs.withColumn("_line_dedup_lines", lines_of(F.col(text_col)))
    keyed = lines.withColumn("_line_dedup_keys", F.transform("_line_dedup_lines", key_of))
    hashed = keyed.withColumn(
        "_line_dedup_hit",
        frequent(F.transform("_line_dedup_keys", lambda k: _hash(k, 0)), F.transform("_line_dedup_keys", lambda k: _hash(k, 1))),
    )
    # an empty key has no slot, but says so here for every input
    flags = F.zip_with("_line_dedup_hit", "_line_dedup_keys", lambda hit, k: hit & (k != ""))
    made = F.zip_with("_line_dedup_lines", flags, lambda line, gone: F.struct(line.alias("line"), gone.alias("gone")))
    return hashed.withColumn("_line_dedup", made).drop("_line_dedup_lines", "_line_dedup_keys", "_line_dedup_hit")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, text_col: str = "text", names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")
) -> DataFrame:
    """``docs`` with the kept text, the number of lines and that of those dropped added.

    Lines whose key is in ``min_docs`` documents or more go from all documents;
    the others stay in order, joined by a newline.
    """
    shards = index_lines(count_lines(docs, text_col), index_from=min_docs)
    found = probe(docs, shards, min_docs, text_col)
    kept = F.filter("_line_dedup", lambda x: ~x["gone"])
    values = (
        F.array_join(F.transform(kept, lambda x: x["line"]), "\n"),
        F.size("_line_dedup").cast("long"),
        F.size(F.filter("_line_dedup", lambda x: x["gone"])).cast("long"),
    )
    return found.select(*[F.col(c) for c in docs.columns if c not in names], *[v.alias(k) for k, v in zip(names, values)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, r, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), often AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY r
"""
