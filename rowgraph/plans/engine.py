"""Watches, maintenance, review, and the sessions that read the graph.

An ``Engine`` belongs to the owner: it sees every row, builds the graph and
applies decisions.  A ``Session`` belongs to one user and has the read
accessors only; what it returns is joined with the rows the watch's policy
lets that user read at that moment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.functions import extension, text
from rowgraph.operators import graph as graphs
from rowgraph.operators import resolve, visibility
from rowgraph.runtime import cut
from rowgraph.sources.storage import ExtractionStore

Policy = Callable[[DataFrame, str], DataFrame]

DECISION = "norm_a string, norm_b string, verdict string, decided_by string, decided_at timestamp"
OVERRIDE = "source_pk string, surface_norm string, tag string, decided_by string, decided_at timestamp"


@dataclass
class Watch:
    """A text column whose graph is derived."""

    watch_id: int
    name: str
    read: Callable[[], DataFrame]
    text_col: str
    pk_cols: list[str]
    visibility: str | None = None
    policy: Policy | None = None
    decisions: dict[tuple[str, str], tuple] = field(default_factory=dict)
    overrides: dict[tuple[str, str], tuple] = field(default_factory=dict)
    dirty: list[tuple[str, str]] = field(default_factory=list)

    def pk(self):
        return F.concat_ws("|", *[F.col(c).cast("string") for c in self.pk_cols]) if len(self.pk_cols) > 1 else F.col(self.pk_cols[0])


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        extractor: extension.Point = None,
        judge: extension.Point = None,
        relation_extractor: extension.Point = None,
        embedder: extension.Point = None,
        embedding_threshold: float = 0.83,
        resolution: str = "full",
        nfkc: bool = True,
        store: str | None = None,
    ):
        if not 0 <= embedding_threshold <= 1:
            raise ValueError("embedding_threshold is between 0 and 1")
        if resolution not in ("full", "exact"):
            raise ValueError("resolution is full or exact")
        self.spark = spark
        self.extractor, self.judge, self.relation_extractor, self.embedder = extractor, judge, relation_extractor, embedder
        self.embedding_threshold, self.resolution, self.nfkc = embedding_threshold, resolution, nfkc
        self.store = ExtractionStore(spark, store)
        self.watches: dict[tuple[str, str], Watch] = {}
        self.graphs: dict[int, graphs.Graph] = {}

    # --- registry

    def watch(
        self,
        name: str,
        read: Callable[[], DataFrame],
        text_col: str,
        pk_cols: str | list[str],
        visibility: str | None = None,
        policy: Policy | None = None,
    ) -> int:
        """Register a column, or update the registration of one; returns its id."""
        if visibility not in (None, "union", "intersection"):
            raise ValueError("visibility is union or intersection")
        keys = [pk_cols] if isinstance(pk_cols, str) else list(pk_cols)
        known = self.watches.get((name, text_col))
        if known:
            known.read, known.pk_cols, known.visibility, known.policy = read, keys, visibility, policy
            return known.watch_id
        made = Watch(len(self.watches) + 1, name, read, text_col, keys, visibility, policy)
        self.watches[name, text_col] = made
        return made.watch_id

    def find(self, name: str, text_col: str | None = None) -> Watch:
        found = [w for (n, c), w in self.watches.items() if n == name and text_col in (None, c)]
        if len(found) != 1:
            raise LookupError(f"{name}: {len(found)} watched columns; name one")
        return found[0]

    def _by_id(self, watch_id: int) -> Watch:
        return next(w for w in self.watches.values() if w.watch_id == watch_id)

    # --- extraction

    def _extracted(self, w: Watch, rows: DataFrame) -> DataFrame:
        body = F.coalesce(F.col(w.text_col).cast("string"), F.lit(""))
        surfaces = extension.vet(body, extension.extract(body, self.extractor), self.judge)
        made = graphs.extraction(rows, w.pk(), body, surfaces)
        return made.withColumn("print", F.xxhash64("body"))

    def extract_pending(self, w: Watch) -> int:
        """Extract rows that are new or changed; forget rows that are gone."""
        source = w.read().withColumn("_pk", w.pk().cast("string")).withColumn("_print", F.xxhash64(F.coalesce(F.col(w.text_col).cast("string"), F.lit(""))))
        stored = self.store.read(w.watch_id)
        alive = source.select(F.col("_pk").alias("source_pk"), F.col("_print").alias("print"))
        kept = stored.join(alive, ["source_pk", "print"], "left_semi")
        fresh = source.join(kept.select(F.col("source_pk").alias("_pk")), "_pk", "left_anti")
        added = cut(self._extracted(w, fresh).select(*stored.columns))
        many = added.count()
        if many or kept.count() != stored.count():
            self.store.replace(w.watch_id, kept.unionByName(added))
        return many

    def index_dump(self, name: str, text_col: str | None = None) -> DataFrame:
        return self.store.read(self.find(name, text_col).watch_id).select("source_pk", "surfaces")

    # --- resolution

    def _decisions(self, w: Watch) -> DataFrame:
        return self.spark.createDataFrame([(a, b, *rest) for (a, b), rest in sorted(w.decisions.items())], DECISION)

    def _overrides(self, w: Watch) -> DataFrame:
        return self.spark.createDataFrame([(p, n, *rest) for (p, n), rest in sorted(w.overrides.items())], OVERRIDE)

    def canon(self, w: Watch, names: DataFrame) -> DataFrame:
        """``(norm, canon)`` by all lanes and decisions."""
        decided = self._decisions(w)
        merges = decided.filter("verdict = 'merge'").select(F.col("norm_a").alias("a"), F.col("norm_b").alias("b"))
        splits = decided.filter("verdict = 'split'") if any(v[0] == "split" for v in w.decisions.values()) else None
        pairs = merges.unionAll(resolve.phonetic_edges(names, splits)).unionAll(resolve.fuzzy_pairs(names).select("a", "b"))
        if self.embedder is not None:
            vectors = names.select("norm", extension.embed(F.col("norm"), self.embedder).alias("vector")).filter("vector is not null")
            pairs = pairs.unionAll(resolve.embedding_pairs(vectors, self.embedding_threshold).select("a", "b"))
        return resolve.canonical_map(names, pairs, splits)

    def resolve(self, w: Watch) -> graphs.Graph:
        """Build the graph again from what is stored."""
        stored = self.store.read(w.watch_id)
        canon = None
        if self.resolution == "full":
            names = cut(graphs.tokens(stored, self.nfkc).select("norm").distinct())
            canon = cut(self.canon(w, names))
        overrides = self._overrides(w) if w.overrides else None
        triples = extension.relations(F.col("body"), self.relation_extractor) if self.relation_extractor is not None else None
        made = graphs.build(stored, canon, overrides, triples, self.nfkc, kept=True)
        self.graphs[w.watch_id] = made
        return made

    def reindex(self, watch_id: int) -> int:
        """Extract every row again and rebuild; returns the number of mentions."""
        w = self._by_id(watch_id)
        self.store.replace(watch_id, self._extracted(w, w.read()).select(*self.store.read(watch_id).columns))
        w.dirty.clear()
        return self.resolve(w).tokens().count()

    def maintain(self) -> int:
        """Bring every watch up to date; returns watches resolved plus changes applied."""
        touched = 0
        for w in self.watches.values():
            noted = len(w.dirty)
            self.extract_pending(w)
            self.resolve(w)
            # only what was noted before the work, and only once it is done
            del w.dirty[:noted]
            touched += 1 + noted
        return touched

    # --- changes

    def enqueue(self, watch_id: int, changes: list[tuple[str, str]]) -> None:
        """Note ``(source_pk, op)`` changes, oldest first; op is upsert or delete."""
        if any(op not in ("upsert", "delete") for _, op in changes):
            raise ValueError("op is upsert or delete")
        self._by_id(watch_id).dirty.extend((str(pk), op) for pk, op in changes)

    def process_changes(self, watch_id: int, changes: DataFrame | None = None) -> int:
        """Apply noted changes, or a frame ``(seq, source_pk, op)``; the last per row wins."""
        w, noted = self._by_id(watch_id), 0
        if changes is None:
            noted = len(w.dirty)
            changes = self.spark.createDataFrame([(i, pk, op) for i, (pk, op) in enumerate(w.dirty[:noted])], "seq long, source_pk string, op string")
        many = changes.count()
        if not many:
            return 0
        last = changes.groupBy("source_pk").agg(F.max_by("op", "seq").alias("op"))
        stored = self.store.read(watch_id)
        kept = stored.join(last, "source_pk", "left_anti")
        upserts = last.filter("op = 'upsert'").select(F.col("source_pk").alias("_pk"))
        rows = w.read().withColumn("_pk", w.pk().cast("string")).join(upserts, "_pk", "left_semi")
        self.store.replace(watch_id, kept.unionByName(self._extracted(w, rows).select(*stored.columns)))
        self.resolve(w)
        # a run that fails loses no change
        del w.dirty[:noted]
        return many

    def gc(self, name: str, text_col: str | None = None) -> int:
        """Forget the extraction of rows that are gone; returns how many."""
        w = self.find(name, text_col)
        stored = self.store.read(w.watch_id)
        alive = w.read().select(w.pk().cast("string").alias("source_pk"))
        kept = cut(stored.join(alive, "source_pk", "left_semi"))
        gone = stored.count() - kept.count()
        if gone:
            self.store.replace(w.watch_id, kept)
        return gone

    # --- review

    def norm(self, surface: str) -> str:
        one = self.spark.createDataFrame([(surface,)], "s string")
        return one.select(text.normalize_name(F.col("s"), self.nfkc)).first()[0] or ""

    def _decide(self, name: str, a: str, b: str, verdict: str, by: str) -> bool:
        a, b = sorted((self.norm(a), self.norm(b)))
        if not a or a == b:
            return False
        w = self.find(name)
        w.decisions[a, b] = (verdict, by, datetime.now(timezone.utc))
        self._again(w)
        return True

    def _again(self, w: Watch) -> None:
        self.extract_pending(w)
        self.resolve(w)

    def merge(self, name: str, a: str, b: str, by: str = "owner") -> bool:
        return self._decide(name, a, b, "merge", by)

    def split(self, name: str, a: str, b: str, by: str = "owner") -> bool:
        return self._decide(name, a, b, "split", by)

    def unmerge(self, name: str, a: str, b: str) -> bool:
        w = self.find(name)
        w.decisions.pop(tuple(sorted((self.norm(a), self.norm(b)))), None)
        self._again(w)
        return True

    def split_mention(self, name: str, pk: object, surface: str, tag: str | None = None, by: str = "owner") -> bool:
        norm = self.norm(surface)
        if not norm:
            return False
        w = self.find(name)
        w.overrides[str(pk), norm] = (str(pk) if tag is None else tag, by, datetime.now(timezone.utc))
        self._again(w)
        return True

    def unsplit_mention(self, name: str, pk: object, surface: str) -> bool:
        w = self.find(name)
        w.overrides.pop((str(pk), self.norm(surface)), None)
        self._again(w)
        return True

    # --- reading

    def graph(self, w: Watch) -> graphs.Graph:
        return self.graphs.get(w.watch_id) or graphs.build(self.store.read(w.watch_id), nfkc=self.nfkc, kept=True)

    def session(self, user: str | None = None) -> "Session":
        """The accessors as ``user`` sees them; None is the owner, who sees all rows."""
        return Session(self, user)


class Session:
    """Read accessors bound to one principal."""

    def __init__(self, engine: Engine, user: str | None):
        self.__engine, self._user = engine, user

    def _at(self, name: str, text_col: str | None):
        w = self.__engine.find(name, text_col)
        rows = w.read()
        if self._user is not None and w.policy is not None:
            rows = w.policy(rows, self._user)
        return w, self.__engine.graph(w), rows.select(w.pk().cast("string").alias("source_pk"))

    def entities(self, name: str, text_col: str | None = None) -> DataFrame:
        _, g, pks = self._at(name, text_col)
        return visibility.visible_entities(g, pks).select("entity_id", "surface").orderBy("surface")

    def mentions(self, name: str, text_col: str | None = None) -> DataFrame:
        _, g, pks = self._at(name, text_col)
        seen = visibility.visible_mentions(g, pks).join(g.entity.select("entity_id", "surface"), "entity_id")
        return seen.select("entity_id", "surface", "source_pk", "surface_form").orderBy("surface", "source_pk", "surface_form")

    def edges(self, name: str, text_col: str | None = None) -> DataFrame:
        w, g, pks = self._at(name, text_col)
        return visibility.named_edges(g, visibility.visible_edges(g, pks, w.visibility)).orderBy("src", "dst")

    def proposals(self, name: str, text_col: str | None = None, exclude_decided: bool = False) -> DataFrame:
        w, g, pks = self._at(name, text_col)
        decided = self.__engine._decisions(w) if exclude_decided else None
        return visibility.visible_proposals(g, pks, decided).orderBy("surface_a", "surface_b")

    def decisions(self, name: str, text_col: str | None = None) -> DataFrame:
        w, g, pks = self._at(name, text_col)
        seen = visibility.visible_decisions(self.__engine._decisions(w), g, pks)
        return seen.select("norm_a", "norm_b", "verdict").orderBy("norm_a", "norm_b")

    def most_connected(self, name: str, text_col: str | None = None) -> DataFrame:
        return visibility.most_connected(self.edges(name, text_col)).orderBy(F.desc("times_together"), "person")

    def catalog(self, name: str, relation: str, text_col: str | None = None) -> DataFrame:
        """A relation of the graph, filtered like the accessors."""
        w, g, pks = self._at(name, text_col)
        if relation == "entity":
            return visibility.visible_entities(g, pks)
        if relation == "mention":
            return visibility.visible_mentions(g, pks)
        if relation == "edge":
            return visibility.visible_edges(g, pks, w.visibility)
        if relation == "edge_support":
            return visibility.visible_support(g, pks)
        if relation == "entity_phonetic":
            return visibility.visible_phonetic(g, pks)
        if relation == "mention_override":
            return visibility.visible_overrides(self.__engine._overrides(w), pks)
        if relation == "decision":
            return visibility.visible_decisions(self.__engine._decisions(w), g, pks)
        raise LookupError(relation)

    def views(self, name: str, prefix: str = "my_", text_col: str | None = None) -> None:
        """Temporary views ``<prefix>people``, ``circle`` and ``review_queue`` for SQL."""
        self.entities(name, text_col).select(F.col("surface").alias("person")).createOrReplaceTempView(f"{prefix}people")
        self.edges(name, text_col).select(F.col("src").alias("person"), F.col("dst").alias("also")).createOrReplaceTempView(f"{prefix}circle")
        self.proposals(name, text_col).select(F.col("surface_a").alias("person"), F.col("surface_b").alias("maybe")).createOrReplaceTempView(f"{prefix}review_queue")
