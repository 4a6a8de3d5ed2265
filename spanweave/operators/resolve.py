"""Entity resolution: surfaces to normal keys, keys to clusters, clusters to numbered entities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import settle
from .ordering import numbered


def resolution_key() -> Column:
    """Key of exact clustering; persons are keyed by last name and folded further."""
    kind, surface = F.col("type"), F.col("text")
    basic = kind.isin("ADDRESS", "DOB", "MEDICAL", "OTHER")
    return F.when(kind == "PERSON", text.person_last(surface)).when(kind == "ORG", text.org_core(surface)).when(basic, text.norm_basic(surface)).otherwise(text.norm_structured(kind, surface))


def order_key() -> Column:
    """Place of a span in the list of all spans: document, then detection order, then offset."""
    return F.struct("doc_id", "ord", "start")


class GivenNames:
    """Clusters of the given names of one last name and initial, in order of mention.

    A name joins the earliest cluster whose name begins with it or which it begins with, and the longer of both stands for
    the cluster. Names that stand for clusters are never prefixes of each other, so at most one begins a given name: what
    is held is that name's cluster, and for each beginning of these names the earliest cluster that has it.
    """

    def __init__(self):
        self.whole: dict[str, int] = {}
        self.least: dict[str, int] = {}
        self.size = 0

    def _stand(self, name: str, at: int) -> None:
        self.whole[name] = at
        for k in range(len(name), 0, -1):
            if self.least.setdefault(name[:k], at) < at:
                break  # so have all shorter ones
            self.least[name[:k]] = at

    def place(self, name: str) -> int:
        """The cluster of the next name."""
        if (at := self.least.get(name)) is not None:
            return at
        for k in range(len(name) - 1, 0, -1):
            if (at := self.whole.get(name[:k])) is not None:
                del self.whole[name[:k]]
                self._stand(name, at)
                return at
        self.size += 1
        self._stand(name, self.size - 1)
        return self.size - 1


def _fold_first_names(names: DataFrame) -> DataFrame:
    """(key, first, pos) to (key, first, cluster): see ``GivenNames``; a missing given name fits all, and so joins the first
    cluster of its last name.

    Names of unlike initials never meet, so they are dealt by last name and initial, sorted by mention and folded as they
    pass by; what a missing given name joins is that of the first mention, whatever its initial.
    """

    def run(batches):
        now, folded = None, None
        for b in batches:
            labels = []
            for key, initial, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (key, initial) != now:
                    now, folded = (key, initial), GivenNames()
                labels.append(f"{initial}{folded.place(first)}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(labels, pa.string())], names=["key", "first", "cluster"])

    given = names.where("first <> ''").withColumn("initial", F.col("first").substr(1, 1))
    dealt = given.repartition("key", "initial").sortWithinPartitions("key", "initial", "pos", "first").select("key", "initial", "first")
    folded = dealt.mapInArrow(run, "key string, first string, cluster string")
    earliest = names.groupBy("key").agg(F.min(F.when(F.col("first") == "", True)).alias("missing"), F.min_by("first", F.when(F.col("first") != "", F.struct("pos", "first"))).alias("one"))
    joined = F.coalesce(F.concat(F.col("one").substr(1, 1), F.lit("0")), F.lit(""))
    return folded.unionByName(earliest.where("missing").select("key", F.lit("").alias("first"), joined.alias("cluster")))


def _clustered(rows: DataFrame) -> DataFrame:
    """Rows (type, text, pos) with ``key`` and ``cluster``, which hang on type and text alone."""
    keyed = rows.withColumn("key", resolution_key())
    persons = keyed.where("type = 'PERSON'").withColumn("first", text.person_first(F.col("text")))
    names = persons.groupBy("key", "first").agg(F.min("pos").alias("pos"))
    folded = persons.join(_fold_first_names(names), ["key", "first"]).drop("first")
    return keyed.where("type <> 'PERSON'").withColumn("cluster", F.lit("")).unionByName(folded)


def cluster(spans: DataFrame) -> DataFrame:
    """Spans with ``key`` and ``cluster``: equal where two spans of a type name one entity."""
    return _clustered(spans.withColumn("pos", order_key()))


def resolved(spans: DataFrame, numbered_after: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, edges): type, key, cluster, number, place, canonical_id, canonical_text, aliases, n_spans of each entity,
    and (canonical_id, doc_id) of each document that names it.

    Numbers count clusters of a type by first mention; places, those of the new entities of a type by canonical_id as text. Spans are combined to surfaces first, which then get keys and
    clusters: an entity's one array holds its distinct surfaces; its documents are rows. numbered_after: (type, base) to
    start numbers at.
    """
    spans = settle(spans, "spans")  # read for surfaces and for documents
    by = ["type", "key", "cluster"]
    mentioned = settle(spans.groupBy("type", "text").agg(F.min(order_key()).alias("pos"), F.count(F.lit(1)).alias("n")), "mentioned")
    surfaces = settle(_clustered(mentioned), "surfaces")
    comma = F.when(F.col("type") == "PERSON", F.contains("text", F.lit(","))).otherwise(F.lit(False))
    found = surfaces.groupBy(*by).agg(
        F.min("pos").alias("pos"),
        F.min_by("text", F.struct(comma, -F.length("text"), F.col("pos"))).alias("canonical_text"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("aliases"),
        F.sum("n").alias("n_spans"),
    )
    out = numbered(found, "type", ["pos"], "number", "size")
    out = out.withColumn("base", F.lit(0).cast("bigint")) if numbered_after is None else out.join(F.broadcast(numbered_after), "type", "left").withColumn("base", F.coalesce("base", F.lit(0)).cast("bigint"))
    out = out.withColumn("number", F.col("number") + F.col("base")).withColumn("place", text.text_place(F.col("number"), F.col("base"), F.col("size")))
    named = out.withColumn("canonical_id", F.format_string("%s-%04d", "type", "number")).drop("pos", "base", "size")
    owners = surfaces.select(*by, "text").join(named.select(*by, "canonical_id"), by).select("type", "text", "canonical_id")
    return named, spans.select("type", "text", "doc_id").join(owners, ["type", "text"]).select("canonical_id", "doc_id").distinct()


def entities(spans: DataFrame, numbered_after: DataFrame | None = None) -> DataFrame:
    """The entities of ``resolved``."""
    return resolved(spans, numbered_after)[0]


def with_documents(named: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with ``doc_ids``, the documents of each in order, as one array: for exports, whose format has it so."""
    return named.join(edges.groupBy("canonical_id").agg(F.array_sort(F.array_distinct(F.collect_list("doc_id"))).alias("doc_ids")), "canonical_id", "left")


def entity_spans(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Every span with its entity's canonical_id."""
    return cluster(spans).join(found.select("type", "key", "cluster", "canonical_id"), ["type", "key", "cluster"]).drop("key", "cluster", "pos")
