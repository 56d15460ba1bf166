"""Secret scanning with inferred grammars.

Three fixed patterns give the base spans.  Beyond them, every candidate run
``[A-Za-z0-9+/_.=-]{16,}`` but for those that a base span holds whole is scored by probabilistic
automata: from labelled credentials, kind by kind, a prefix tree is built and
its statistically compatible states are merged (red-blue order, Hoeffding
bound), and the same is done for ordinary strings.  The score is the greatest
gain in log-likelihood per symbol of a credential automaton over the ordinary
one; a candidate beyond the calibrated threshold is a span of kind
``inferred``.

The automata are learned on the driver from a bounded set of labelled strings
and are a few kilobytes.  Every text is scanned whole.

Defined results: a null or empty text has no spans; offsets are code points,
the end exclusive; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.runtime import ship_package

KINDS = ("assign", "access", "hex", "inferred")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short holds no long enough one
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def render(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_CLASS = {c: "9" for c in "0123456789"}
_CLASS |= {c: "f" for c in "abcdef"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: "F" for c in "ABCDEF"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}
ALPHABET = sorted(set(_CLASS.values()) | set("+/_.=-"))
STOP = "$"


def symbols(s: str) -> list[str]:
    return [_CLASS.get(c, c) for c in s]


class Automaton:
    """A deterministic probabilistic automaton merged from a prefix tree."""

    def __init__(self, samples: Iterable[str], alpha: float = 0.05):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        for s in samples:
            at = 0
            for x in symbols(s):
                self.seen[at][x] += 1
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                at = self.next[at][x]
            self.seen[at][STOP] += 1
        self._merge_states()
        self._log = self._logs()

    def _close(self, a: int, b: int) -> bool:
        """Whether the outgoing frequencies of two states agree within the bound."""
        na, nb = sum(self.seen[a].values()), sum(self.seen[b].values())
        if not na or not nb:
            return True
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        keys = self.seen[a].keys() | self.seen[b].keys()
        return all(abs(self.seen[a].get(k, 0) / na - self.seen[b].get(k, 0) / nb) <= bound for k in keys)

    def _compatible(self, red: int, blue: int) -> bool:
        todo, done = [(red, blue)], set()
        while todo:
            pair = todo.pop()
            if pair in done:
                continue
            done.add(pair)
            a, b = pair
            if not self._close(a, b):
                return False
            todo += [(self.next[a][k], y) for k, y in self.next[b].items() if k in self.next[a]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            for k, n in self.seen[b].items():
                self.seen[a][k] += n
            for k, y in self.next[b].items():
                if k in self.next[a]:
                    todo.append((self.next[a][k], y))
                else:
                    self.next[a][k] = y

    def _merge_states(self) -> None:
        red, is_red = [0], {0}
        while True:
            # the states just outside the merged ones, heaviest first
            blue = [(-sum(self.seen[y].values()), i, k) for i, r in enumerate(red) for k, y in self.next[r].items() if y not in is_red]
            if not blue:
                break
            _, i, k = min(blue)
            parent, state = red[i], self.next[red[i]][k]
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][k] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                is_red.add(state)
        number = {r: i for i, r in enumerate(red)}
        self.seen = [self.seen[r] for r in red]
        self.next = [{k: number[y] for k, y in self.next[r].items()} for r in red]

    def _logs(self):
        size, out = len(ALPHABET) + 1, []
        for seen in self.seen:
            total = sum(seen.values()) + 0.1 * size
            out.append({k: math.log2((seen.get(k, 0) + 0.1) / total) for k in [*ALPHABET, STOP]})
        return out

    def log_likelihood(self, s: str) -> float:
        """Bits; a step without a transition stays, at the smoothed probability."""
        at, total = 0, 0.0
        for x in symbols(s):
            total += self._log[at][x]
            at = self.next[at].get(x, at)
        return total + self._log[at][STOP]


def labelled_credentials(per_kind: int = 150, seed: int = 11) -> dict[str, list[str]]:
    """Invented credentials by kind, in the shapes of widespread services."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum, hexa = lower + upper + digits, digits + "abcdef"

    def of(chars: str, n: int) -> str:
        return "".join(rng.choices(chars, k=n))

    shapes = {
        "access": lambda: "AKIA" + of(upper + digits, 16),
        "hex": lambda: of(hexa, rng.choice((32, 40, 64))),
        "prefixed": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + of(alnum, 36),
        "live": lambda: rng.choice(("sk_live_", "pk_live_", "rk_live_", "sk_test_")) + of(alnum, 24),
        "chat": lambda: f"{rng.choice(('xoxb', 'xoxp'))}-{of(digits, 11)}-{of(digits, 11)}-{of(alnum, 24)}",
        "web": lambda: f"eyJ{of(alnum + '_-', 17)}.eyJ{of(alnum + '_-', rng.randint(40, 80))}.{of(alnum + '_-', 43)}",
        "cloud": lambda: "AIza" + of(alnum + "_-", 35),
        "base64": lambda: of(alnum + "+/", 40),
    }
    return {k: [make() for _ in range(per_kind)] for k, make in shapes.items()}


def ordinary_strings(count: int = 600, seed: int = 12) -> list[str]:
    """Long runs that are no credentials: words, names, numbers, paths, dates."""
    rng = random.Random(seed)
    parts = "the and ing tion er an on re at en nd st es or ti hi as te et ng of al de se le sa si ar ve ra ld ur th ed ch ung keit eau oi que".split()

    def word(n: int) -> str:
        return "".join(rng.choices(parts, k=n))

    def some() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return word(rng.randint(6, 12))
        if kind == 1:
            return word(rng.randint(6, 12)).capitalize() + rng.choice((".", "", "..."))
        if kind == 2:
            return word(rng.randint(6, 12)).upper()
        if kind == 3:
            return rng.choice("-_./").join(word(rng.randint(2, 4)) for _ in range(rng.randint(2, 5)))
        if kind == 4:
            return "".join(rng.choices("0123456789", k=rng.randint(16, 20)))
        if kind == 5:
            return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word(4)}"
        if kind == 6:
            return rng.choice("=-_.") * rng.randint(16, 60)
        return "".join(word(2).capitalize() for _ in range(rng.randint(3, 5)))

    return [s for s in (some() for _ in range(count * 2)) if len(s) >= 16][:count]


class Grammars:
    """The automata and the threshold between credentials and ordinary strings."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str], margin: float = 0.3):
        self.ordinary = Automaton(ordinary[::2] + ordinary[1::4])
        self.kinds = {k: Automaton(v[::2]) for k, v in sorted(credentials.items())}
        # the other halves calibrate: the threshold is above every ordinary string held back
        held = [self.score(s) for s in ordinary[3::4]]
        self.threshold = max([margin, *(x + 0.1 for x in held)])

    def score(self, s: str) -> float:
        base = self.ordinary.log_likelihood(s)
        return max(a.log_likelihood(s) - base for a in self.kinds.values()) / (len(s) + 1)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, at, reach = [], 0, 0
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            # both are sorted: how far the base spans that begin no later reach
            while at < len(base) and base[at][0] <= a:
                reach = max(reach, base[at][2])
                at += 1
            if reach >= b:
                continue
            if self.score(m.group()) >= self.threshold:
                out.append((a, 3, b))
        return out


def learn(per_kind: int = 150) -> Grammars:
    return Grammars(labelled_credentials(per_kind), ordinary_strings())


def scan(docs: DataFrame, grammars: Grammars | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, spans)``: ``spans`` is an array of ``(kind, start, end, found)``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(grammars or learn())
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, out = batch.column(0).slice(at, 256), []
                for t in batch.column(1).slice(at, 256):
                    text = t.as_py() or ""
                    base = base_spans(text)
                    spans = sorted(base + model.spans(text, base))
                    out.append([{"kind": KINDS[k], "start": a, "end": b, "found": text[a:b]} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(struct))], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,found:string>>"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs.select("doc_id", "text"))

    def many(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "inferred")
    return found.select(
        "doc_id",
        many("assign").alias("n_assign"),
        many("access").alias("n_access"),
        many("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
