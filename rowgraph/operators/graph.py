"""The graph from extracted surfaces: mentions, entities, edges and their support."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowgraph.functions import text
from rowgraph.operators.ids import with_dense_ids, with_group_ids
from rowgraph.operators.resolve import phonetic_keyed
from rowgraph.runtime import cut, filed

SEPARATOR = "\x1f"
#: A place is a row's number times this, plus the position in the row.
POSITIONS = 1 << 31
#: Numbers of rows that are sent to where the rows are.
CARRIED = 2_000_000


def extraction(source: DataFrame, pk: Column, body: Column, surfaces: Column) -> DataFrame:
    """Rows ``(source_pk, row_ord, surfaces)``; numeric keys order as numbers."""
    return source.select(pk.cast("string").alias("source_pk"), F.struct(pk.try_cast("long").alias("number"), pk.cast("string").alias("name")).alias("row_ord"), surfaces.alias("surfaces"), body.alias("body"))


def tokens(extracted: DataFrame, nfkc: bool = True) -> DataFrame:
    """Rows ``(source_pk, row_ord, pos, surface, norm)``; empty names are gone."""
    each = extracted.select("source_pk", "row_ord", F.posexplode("surfaces").alias("pos", "surface"))
    return each.withColumn("norm", text.normalize_name(F.col("surface"), nfkc)).filter("norm <> ''")


def numbered_rows(extracted: DataFrame) -> DataFrame:
    """``extracted`` with ``row``, a number that orders the rows as ``row_ord`` does."""
    number, name = F.col("row_ord.number"), F.col("row_ord.name")
    own = number.between(0, (1 << 32) - 1) & (name == number.cast("string"))
    if extracted.filter(~F.coalesce(own, F.lit(False))).isEmpty():
        return extracted.withColumn("row", number)
    ids = with_dense_ids(extracted.select("source_pk", "row_ord").distinct(), "row", "row_ord").select(F.col("source_pk").alias("_pk"), "row")
    return extracted.join(ids, F.col("source_pk").eqNullSafe(F.col("_pk"))).drop("_pk")


class Graph:
    """The derived relations of one watched column, each made when it is first asked for.

    ``kept``: the rows are computed once and at once, and so is each relation
    that is asked for, because many readers follow.  Otherwise rows are read
    again where that is less work than to write and read what is made of them.

    entity: entity_id, surface, norm.  mention: entity_id, source_pk, pos,
    surface_form, mention_norm.  edge: edge_id, src, dst, predicate.
    edge_support: edge_id, source_pk.  entity_phonetic: entity_id, key.
    """

    def __init__(
        self, extracted: DataFrame, canon: DataFrame | None = None, overrides: DataFrame | None = None, triples: Column | None = None, nfkc: bool = True, kept: bool = False
    ):
        rows = numbered_rows(extracted)
        self.canon, self.tagged, self.triples, self.nfkc, self.kept = canon, overrides is not None, triples, nfkc, kept
        if self.tagged:
            tags = overrides.groupBy("source_pk").agg(F.collect_list(F.struct(F.col("surface_norm").alias("norm"), "tag")).alias("tags"))
            rows = rows.join(tags, "source_pk", "left")
        if triples is not None:
            rows = rows.withColumn("triples", triples)
        wanted = ["source_pk", "row", "surfaces", *(["tags"] if self.tagged else []), *(["triples"] if triples is not None else [])]
        self.rows = cut(rows.select(*wanted)) if kept else rows.select(*wanted)
        self._keep = cut if kept else filed

    def _tag(self, norm: str) -> Column:
        return F.get(F.filter("tags", lambda t: t["norm"] == F.col(norm)), F.lit(0))["tag"]

    def _occurrences(self, rows: DataFrame) -> DataFrame:
        """Rows ``(source_pk, row, ..., pos, surface, tag)``; ``norm`` only where a tag needs it."""
        each = rows.select(*[c for c in rows.columns if c not in ("surfaces", "triples")], F.posexplode("surfaces").alias("pos", "surface"))
        if not self.tagged:
            return each.withColumn("tag", F.lit(None).cast("string"))
        return each.withColumn("norm", text.normalize_name(F.col("surface"), self.nfkc)).withColumn("tag", self._tag("norm")).drop("norm", "tags")

    def tokens(self, rows: DataFrame | None = None) -> DataFrame:
        """One row per mention, duplicates within a row included; empty names are gone."""
        each = self._occurrences(self.rows if rows is None else rows)
        return each.withColumn("norm", text.normalize_name(F.col("surface"), self.nfkc)).filter("norm <> ''")

    @cached_property
    def _numbered(self) -> DataFrame:
        """Rows ``(entity_id, canon, tag, surface)``, numbered by first mention.

        Surfaces are grouped as they are found, by a number, and normalised
        after that, when few are left.
        """
        place = F.col("row") * F.lit(POSITIONS) + F.col("pos")
        first = self._occurrences(self.rows).groupBy("surface", "tag").agg(F.min(place).alias("first"))
        named = first.withColumn("norm", text.normalize_name(F.col("surface"), self.nfkc)).filter("norm <> ''")
        keyed = named.withColumn("canon", F.col("norm")) if self.canon is None else named.join(self.canon, "norm")
        one = keyed.groupBy("canon", "tag").agg(F.min("first").alias("first"), F.min_by("surface", "first").alias("surface"))
        return with_dense_ids(one, "entity_id", "first").drop("first")

    @property
    def entity(self) -> DataFrame:
        return self._numbered.select("entity_id", "surface", F.concat_ws(SEPARATOR, "canon", "tag").alias("norm"))

    def _identified(self, named: DataFrame, norm: str = "norm", tag: str = "tag", as_: str = "entity_id") -> DataFrame:
        """``named`` with the entity of each row's name and tag."""
        lookup = self._numbered.select(F.col("entity_id").alias(as_), F.col("canon").alias("_canon"), F.col("tag").alias("_tag"))
        if self.canon is None:
            lookup = lookup.withColumnRenamed("_canon", "_norm")
        elif not self.tagged:
            lookup = self.canon.select(F.col("norm").alias("_norm"), F.col("canon").alias("_canon")).join(lookup, "_canon").drop("_canon")
        else:
            named = named.join(self.canon.select(F.col("norm").alias(norm), F.col("canon").alias("_norm_canon")), norm)
            lookup = lookup.withColumnRenamed("_canon", "_norm")
        same = F.col("_norm") == F.col("_norm_canon" if self.canon is not None and self.tagged else norm)
        if self.tagged:
            same = same & F.col("_tag").eqNullSafe(F.col(tag))
        return named.join(lookup.hint("shuffle_hash"), same).drop("_norm", "_tag", "_norm_canon")

    def _mentions(self, rows: DataFrame) -> DataFrame:
        return self._identified(self.tokens(rows))

    def _rows_of(self, pks: DataFrame) -> DataFrame:
        """The numbers of some rows; up to ``CARRIED`` go to the rows, more would be too much for one memory."""
        found = self.rows.select("source_pk", "row").join(pks, "source_pk", "left_semi").select("row").distinct()
        return F.broadcast(found) if found.limit(CARRIED + 1).count() <= CARRIED else found

    @cached_property
    def mention(self) -> DataFrame:
        made = self._mentions(self.rows).select("entity_id", "source_pk", "pos", F.col("surface").alias("surface_form"), F.col("norm").alias("mention_norm"))
        return cut(made) if self.kept else made

    def mentions_of(self, pks: DataFrame) -> DataFrame:
        """The mentions of some rows."""
        if self.kept:
            return self.mention.join(pks, "source_pk", "left_semi")
        made = self._mentions(self.rows.join(self._rows_of(pks), "row", "left_semi"))
        return made.select("entity_id", "source_pk", "pos", F.col("surface").alias("surface_form"), F.col("norm").alias("mention_norm"))

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Directed pairs whose two ends were extracted in the same row."""

        def norms(names: Column) -> Column:
            return F.transform(text.nfkc_all(names) if self.nfkc else names, lambda s: text.normalize_name(s, False))

        parts = rows.select(
            *[c for c in rows.columns if c not in ("surfaces", "triples")], norms(F.col("surfaces")).alias("_known"),
            *[norms(F.transform("triples", lambda t: t[c])).alias(c[0]) for c in ("subject", "object")], F.transform("triples", lambda t: t["predicate"]).alias("p"),
        )
        both = F.filter(F.arrays_zip("s", "o", "p"), lambda t: (t["s"] != "") & (t["o"] != "") & F.array_contains("_known", t["s"]) & F.array_contains("_known", t["o"]))
        each = parts.select(*[c for c in parts.columns if c not in ("_known", "s", "o", "p")], F.explode(both).alias("t"))
        each = each.select("*", F.col("t.s").alias("s"), F.col("t.o").alias("o"), F.col("t.p").alias("predicate")).drop("t")
        none = F.lit(None).cast("string")
        each = each.withColumn("st", self._tag("s") if self.tagged else none).withColumn("ot", self._tag("o") if self.tagged else none)
        ends = self._identified(self._identified(each, "s", "st", "src"), "o", "ot", "dst")
        return ends.filter("src <> dst").drop("s", "o", "st", "ot", "tags")

    def _pairs(self, rows: DataFrame) -> DataFrame:
        """``(src, dst, source_pk)`` and other columns of the rows, of neighbouring mentions in a row; with ``predicate`` if typed."""
        if self.triples is not None:
            return self._typed(rows)
        others = [c for c in rows.columns if c not in ("surfaces", "tags")]
        follows = F.lead("entity_id").over(Window.partitionBy("row").orderBy("pos"))
        pairs = self._mentions(rows).select("pos", "entity_id", *others).withColumn("next", follows).filter("next <> entity_id")
        return pairs.select(F.least("entity_id", "next").alias("src"), F.greatest("entity_id", "next").alias("dst"), *others)

    @property
    def _ends(self) -> list[str]:
        return ["src", "dst"] if self.triples is None else ["src", "dst", "predicate"]

    def _as_edges(self, edges: DataFrame) -> DataFrame:
        return edges.select("edge_id", "src", "dst", "predicate" if self.triples is not None else F.lit("co_mentioned").alias("predicate"))

    def _alone(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The rows without what the pairs are not asked for."""
        return rows.select(*[c for c in rows.columns if c in ("row", "surfaces", "tags", "triples", *columns)])

    @cached_property
    def _support(self) -> DataFrame:
        """Rows ``(edge_id, src, dst, source_pk)``, numbered by the ends; with ``predicate`` if typed."""
        pairs = self._pairs(self._alone(self.rows, "source_pk")).select(*self._ends, "source_pk", "row").dropDuplicates([*self._ends, "row"])
        return with_group_ids(pairs.drop("row"), "edge_id", *self._ends, keep=self._keep)

    @cached_property
    def edge(self) -> DataFrame:
        if self.kept or "_support" in self.__dict__:
            return self._as_edges(self._support.filter("first"))
        return self._as_edges(with_group_ids(self._pairs(self._alone(self.rows)).select(*self._ends), "edge_id", *self._ends, firsts=True, keep=self._keep))

    @property
    def edge_support(self) -> DataFrame:
        return self._support.select("edge_id", "source_pk")

    def edges_of(self, pks: DataFrame, mode: str) -> DataFrame:
        """Union: any support readable.  Intersection: no support hidden, judged on all support."""
        if self.kept:
            if mode == "union":
                return self.edge.join(self.edge_support.join(pks, "source_pk", "left_semi"), "edge_id", "left_semi")
            return self.edge.join(self.edge_support.join(pks, "source_pk", "left_anti"), "edge_id", "left_anti")
        shown = self._rows_of(pks).withColumn("seen", F.lit(True))
        seen = self.rows.join(shown, "row", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
        best = F.desc("seen") if mode == "union" else F.asc("seen")
        pairs = self._pairs(self._alone(seen, "seen")).select(*self._ends, "seen")
        return self._as_edges(with_group_ids(pairs, "edge_id", *self._ends, within=best, firsts=True, keep=self._keep).filter("seen"))

    def pairs_of(self, pks: DataFrame) -> DataFrame:
        """``(src, dst, predicate)`` of the edges that some rows support, without the edges' numbers."""
        pairs = self._pairs(self._alone(self.rows.join(self._rows_of(pks), "row", "left_semi"))).select(*self._ends).distinct()
        return pairs if self.triples is not None else pairs.withColumn("predicate", F.lit("co_mentioned"))

    @cached_property
    def entity_phonetic(self) -> DataFrame:
        spelled = self.tokens().select("surface", "norm", "tag").distinct()
        spelled = self._identified(spelled).select(F.lower("surface").alias("norm"), "entity_id").distinct()
        made = spelled.join(phonetic_keyed(spelled.select("norm").distinct()), "norm").select("entity_id", "key").distinct()
        return cut(made) if self.kept else made


def build(
    extracted: DataFrame, canon: DataFrame | None = None, overrides: DataFrame | None = None, triples: Column | None = None, nfkc: bool = True, kept: bool = False
) -> Graph:
    """The whole graph of one watched column."""
    return Graph(extracted, canon, overrides, triples, nfkc, kept)
