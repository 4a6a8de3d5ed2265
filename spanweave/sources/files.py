"""Document files: plain text, DOCX, and words that a PDF extractor delivers; memory snapshots and personas as JSON."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.utils import AnalysisException

PAGES = "doc_id string, page_no int, width double, height double, text string"
MEMORY = "key string, canonical_id string, type string, canonical_text string, aliases array<string>, doc_ids array<string>, pseudonym string"
_ENTITY = "struct<canonical_id:string,type:string,canonical_text:string,aliases:array<string>,doc_ids:array<string>,pseudonym:string>"
PERSONAS = "persona_id string, full_name string, name_variants array<string>, email string, phone string, address string, ni_number string, dob string, org string, iban string, credit_card string, ssn string, medical_note string, other_id string, recurring boolean"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _stem(path):
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One page per .txt file, without geometry; line ends become \\n."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    return rows.select(_stem(F.col("p")).alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def docx_paragraphs(data: bytes) -> str:
    """Texts of the body's paragraphs, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p"))


def docx_images(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of the images that the document itself refers to, in the order of its relationships."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "word/_rels/document.xml.rels" not in names:
            return []
        found = []
        for rel in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
            target = rel.get("Target", "")
            name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"word/{target}")
            if "image" in rel.get("Type", "") and rel.get("TargetMode") != "External" and name in names:
                found.append((name, z.read(name)))
        return found


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """One page per .docx file, without geometry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "page_no": 1, "width": 0.0, "height": 0.0, "text": [docx_paragraphs(bytes(c)) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("doc_id"), "content").mapInPandas(run, PAGES)


def read_docx_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, doc_id, page_no, content of a .docx file's images."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(f"{d}_img{i}", d, 1, b) for d, c in zip(f["doc_id"], f["content"]) for i, (_, b) in enumerate(docx_images(bytes(c)))]
            yield pd.DataFrame(rows, columns=["image_id", "doc_id", "page_no", "content"])

    return spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("doc_id"), "content").mapInPandas(run, "image_id string, doc_id string, page_no int, content binary")


WORDS = "doc_id string, page_no int, block_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double"
IMAGES = "image_id string, doc_id string, page_no int, content binary, x0 double, y0 double, x1 double, y1 double"


def extract_words(spark: SparkSession, path: str, extractor: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words of paginated files. extractor: a file's bytes to pages, each with ``words`` (block_no, line_no, word_no, word,
    x0, y0, x1, y1) and ``images`` (xref, content, box or None); it runs on the executors, with whatever library it wraps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, n, *w) for d, c in zip(f["doc_id"], f["content"]) for n, page in enumerate(extractor(bytes(c)), 1) for w in page.get("words", ())]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in WORDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("doc_id"), "content").mapInPandas(run, WORDS)


def extract_images(spark: SparkSession, path: str, extractor: Callable[[bytes], list[dict]]) -> DataFrame:
    """Images of paginated files (see ``extract_words``): image_id is <doc>_p<page>_x<xref>, the box that of the first placement."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (f"{d}_p{n}_x{xref}", d, n, content, *(box or (None,) * 4))
                for d, c in zip(f["doc_id"], f["content"]) for n, page in enumerate(extractor(bytes(c)), 1) for xref, content, box in page.get("images", ())
            ]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in IMAGES.split(", ")])

    return spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("doc_id"), "content").mapInPandas(run, IMAGES)


def read_documents(spark: SparkSession, paths: list[str], extractor: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """Pages of files by suffix; any other suffix is refused. PDF needs an ``extractor`` (see ``extract_words``)."""
    from ..operators import chunking

    def paged(spark: SparkSession, path: str) -> DataFrame:
        words = extract_words(spark, path, extractor)
        sizes = words.groupBy("doc_id", "page_no").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
        return chunking.page_texts(words).join(sizes, ["doc_id", "page_no"]).select("doc_id", "page_no", "width", "height", "text")

    readers = {".txt": read_text, ".docx": read_docx, **({".pdf": paged} if extractor else {})}
    out = None
    for path in paths:
        suffix = path[path.rfind(".") :].lower() if "." in path else ""
        if suffix not in readers:
            raise ValueError(f"unsupported file type {suffix!r}: words of other formats come through an extractor's words table")
        pages = readers[suffix](spark, path)
        out = pages if out is None else out.unionByName(pages)
    return out if out is not None else spark.createDataFrame([], PAGES)


def preview(pages: DataFrame, chars: int = 200) -> DataFrame:
    """doc_id, page_no, n_chars and the first characters of each page."""
    return pages.select("doc_id", "page_no", F.length("text").alias("n_chars"), F.substring("text", 1, chars).alias("preview"))


def first_boxes(words: DataFrame, count: int = 5) -> DataFrame:
    """The first words of each page with their boxes."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("block_no", "line_no", "word_no")
    return words.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).select("doc_id", "page_no", "word", "x0", "y0", "x1", "y1")


def entities_from_json(rows: DataFrame, column: str = "entity") -> DataFrame:
    """Entities (see MEMORY) of JSON texts as ``sinks.entity_json`` makes them; a malformed one is dropped."""
    parsed = rows.select(F.from_json(column, _ENTITY).alias("e")).where("e.canonical_id IS NOT NULL")
    return parsed.select(F.col("e.canonical_id").alias("key"), "e.*")


def read_memory_json(spark: SparkSession, path: str) -> DataFrame:
    """A memory snapshot in JSON, as one object or as a line for each entity; a missing or malformed file is an empty memory."""
    kind = f"struct<entities:map<string,{_ENTITY}>>"
    try:
        lines = spark.read.text(path)
        by_line = bool(lines.where("trim(value) <> ''").limit(1).where(F.from_json("value", kind)["entities"].isNotNull()).head(1))
        raw = lines if by_line else spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], MEMORY)
    parsed = raw.select(F.from_json("value", kind).alias("m")).where("m.entities IS NOT NULL")
    return parsed.select(F.explode("m.entities").alias("key", "e")).select("key", F.col("key").alias("canonical_id"), "e.type", "e.canonical_text", "e.aliases", "e.doc_ids", "e.pseudonym")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """A memory table in Parquet; a missing one is empty."""
    try:
        return spark.read.schema(MEMORY).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], MEMORY)


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """Personas from JSON: an array, on one line or many, or a line for each persona."""
    first = spark.read.text(path).where("trim(value) <> ''").head()
    head = first[0].strip() if first else ""
    return spark.read.schema(PERSONAS).json(path, multiLine=head.startswith("[") and not head.endswith("]"))
