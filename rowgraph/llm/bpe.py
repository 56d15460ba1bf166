"""Byte-level BPE by prefix dynamic programming.

For a byte string every prefix has exactly one BPE encoding, and that encoding
is the encoding of a shorter prefix plus one token.  It therefore suffices to
store, for each prefix, its last token: a token ``t`` that ends at position
``i`` is the last one exactly if it may follow the last token of the prefix
before it, that is if encoding the bytes of the two tokens together gives the
two tokens back.  The table makes appending exact (older entries never change)
and re-encoding after an edit local: the prefix before the edit is kept.

Text is first cut into the matches of a pattern, each encoded separately.

Defined results: a null or empty text has no tokens; decoding gives the UTF-8
bytes of the text; rows repeat as they do in the input; columns other than the
id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.runtime import ship_package

#: Entries a worker keeps of words and of pieces already encoded; the oldest half goes when one is full.
PIECE_CACHE = 500_000
#: A space beside other white space: one match of the pattern may hold both.
SPACES = regex.compile(r" \s|\s ")
#: Token pairs a vocabulary remembers as joinable or not.
PAIR_CACHE = 1_000_000


class Vocabulary:
    """Ranks of byte strings, with the pair test the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        # A token that its own merges never produce occurs only as a whole piece.
        self.inner = {b: i for b, i in ranks.items() if self.merge(b) == [i]}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    def merge(self, data: bytes) -> list[int]:
        """Encoding by repeatedly joining the pair of least rank, leftmost first.

        Quadratic: used on the bytes of one or two tokens only.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may directly follow token ``a`` inside a piece."""
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add to ``last`` the last tokens of the prefixes of ``data`` that it lacks."""
        token_of, known, longest, bytes_of = self.inner.get, self.pairs.get, self.longest, self.bytes_of
        for end in range(len(last) + 1, len(data) + 1):
            # only one token fits, so the order of trials is free: the last token one byte longer is likeliest
            likely = end - 1 - len(bytes_of[last[-1]]) if last else 0
            token = token_of(data[likely:end])
            if token is not None:
                if not likely:
                    last.append(token)
                    continue
                pair = last[likely - 1] << 32 | token
                fits = known(pair)
                if fits or (fits is None and self.follows(last[likely - 1], token)):
                    last.append(token)
                    continue
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = token_of(data[start:end])
                if token is None or start == likely:
                    continue
                if not start:
                    break
                before = last[start - 1]
                fits = known(before << 32 | token)
                if fits or (fits is None and self.follows(before, token)):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def backtrack(self, last: list[int]) -> list[int]:
        out, at, bytes_of = [], len(last), self.bytes_of
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(bytes_of[token])
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; no older entry changes."""
        self.data += more
        self.vocabulary.extend(bytes(self.data), self.last)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Replace ``data[start:stop]``; the entries before ``start`` are kept."""
        tail = bytes(self.data[stop:])
        del self.data[start:]
        del self.last[start:]
        self.append(new + tail)

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(bytes(self.data))
        if whole is not None:
            return [whole]
        return self.vocabulary.backtrack(self.last)


class Encoder:
    """Whole texts: pieces by a pattern, each through a prefix table."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self._pieces: dict[str, tuple[int, bytes, bytes]] = {}
        self._words: dict[str, tuple[int, bytes, bytes]] = {}

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.vocabulary.extend(data, last)
        return self.vocabulary.backtrack(last)

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pattern.findall(text or "") for i in self.piece(p)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.vocabulary.decode(ids)

    def rendered(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of tokens, decimal ids joined by spaces, and the decoded bytes.

        No match of the pattern has a space after its first character unless it
        is a run of white space.  So a text without a space next to other white
        space may be cut before every space, and whole words are looked up
        instead of cut.
        """
        if SPACES.search(text):
            found = self._cut(text)
        else:
            first, *words = text.split(" ")
            known, missing = self._words.get, self._word
            found = self._cut(first)
            found += [known(w) or missing(w) for w in words]
        if not found:
            return 0, b"", b""
        counts, ids, decoded = zip(*found)
        return sum(counts), b" ".join(ids), b"".join(decoded)

    def _cut(self, text: str) -> list[tuple[int, bytes, bytes]]:
        known, missing = self._pieces.get, self._piece
        return [known(p) or missing(p) for p in self.pattern.findall(text)]

    @staticmethod
    def _keep(cache: dict, key: str, value: tuple) -> tuple:
        if len(key) <= 64:
            if len(cache) >= PIECE_CACHE:
                for old in list(islice(cache, PIECE_CACHE // 2)):
                    del cache[old]
            cache[key] = value
        return value

    def _piece(self, piece: str) -> tuple[int, bytes, bytes]:
        ids = self.piece(piece)
        return self._keep(
            self._pieces, piece, (len(ids), " ".join(map(str, ids)).encode(), self.vocabulary.decode(ids))
        )

    def _word(self, word: str) -> tuple[int, bytes, bytes]:
        counts, ids, decoded = zip(*self._cut(" " + word))
        return self._keep(self._words, word, (sum(counts), b" ".join(ids), b"".join(decoded)))


class EditableText:
    """A text and its tokens under appends and edits.

    Only the pieces that an edit can reach are cut and encoded again: a match
    of the pattern looks at most two characters past its end, so cutting
    restarts at the first piece that ends within two characters of the edit
    and stops where a new cut meets an old one beyond it.
    """

    LOOKAHEAD = 2

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.text = ""
        self.pieces: list[tuple[int, int, PrefixTable]] = []
        self.encoded_bytes = 0
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] + self.LOOKAHEAD <= start:
            keep += 1
        head, old = self.pieces[:keep], self.pieces[keep:]
        by_start = {a + shift: k for k, (a, _, _) in enumerate(old) if a >= stop}
        reusable = {a: table for a, _, table in old}
        fresh, tail = [], []
        at = head[-1][1] if head else 0
        for match in self.encoder.pattern.finditer(text, at):
            a, b = match.span()
            if a in by_start and a >= start + len(new):
                tail = [(x + shift, y + shift, t) for x, y, t in old[by_start[a] :]]
                break
            data = match.group().encode("utf-8", "surrogatepass")
            table = reusable.get(a) if a < start else None
            if table is None:
                table = PrefixTable(self.encoder.vocabulary, data)
                self.encoded_bytes += len(data)
            else:
                same = 0
                for x, y in zip(table.data, data):
                    if x != y:
                        break
                    same += 1
                table.replace(same, len(table.data), data[same:])
                self.encoded_bytes += len(data) - same
            fresh.append((a, b, table))
        self.text = text
        self.pieces = head + fresh + tail

    def ids(self) -> list[int]:
        return [i for _, _, table in self.pieces for i in table.ids()]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process and vocabulary, so that its caches last."""
    return Encoder(Vocabulary.load(path), pattern)


def _each_text(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 256):
            part = texts.slice(at, 256)
            yield work(ids.slice(at, 256), [t.as_py() or "" for t in part])


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows ``(id, n_tokens, ids)`` with ``ids`` as ``array<int>``, one per input row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path, pattern)

        def work(ids, texts):
            coded = [enc.encode(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([len(c) for c in coded], pa.int64()), pa.array(coded, pa.list_(pa.int32()))],
                [id_col, "n_tokens", "ids"],
            )

        yield from _each_text(batches, work)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def decode_documents(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Rows ``(id, decoded)`` with the bytes that ``ids`` stand for."""
    ship_package(coded.sparkSession)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            out = [enc.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    return coded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, decode and digest every text in one pass; ids never leave the worker."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path, pattern)
        sha = hashlib.sha256

        def work(ids, texts):
            counts, coded, decoded = [], [], []
            for text in texts:
                n, i, d = enc.rendered(text)
                counts.append(n)
                coded.append(sha(i).hexdigest())
                decoded.append(sha(d).hexdigest())
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        yield from _each_text(batches, work)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digests(docs.select(F.col("doc_id").cast("long"), "text"), path, public_tokenizers.PATTERN)
