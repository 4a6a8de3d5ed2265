"""Sinks: rewritten texts, pseudonym tables, memory snapshots, and plans for writers outside Spark."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_texts(redacted: DataFrame, path: str) -> None:
    """Rewritten texts as a table (doc_id, redacted, replacements)."""
    redacted.select("doc_id", "redacted", "replacements").write.mode("overwrite").parquet(path)


def _put(root: str, name: str, data: bytes) -> None:
    """Write a file by way of another name, so that a task that runs again leaves a whole file."""
    store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{base}/{name}")


def safe_name(name: str) -> str:
    """A file name for an id: characters that a path or a shell gives a meaning are written as %XX, so that unlike ids keep
    unlike names; a long one is cut and told apart by a digest."""
    plain = re.sub(r'[\x00-\x1f\x7f/\\%:*?"<>|]|^\.', lambda m: f"%{ord(m[0]):02X}", name)
    data = plain.encode("utf-8", "surrogatepass")
    if len(data) <= 180:
        return plain
    return data[:120].decode("utf-8", "ignore") + "%" + hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _reachable(spark: SparkSession, root: str) -> None:
    """A folder without a scheme lies on each executor's own disk, which is one place in a local session only."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{root} has no scheme: each executor would write to its own disk")


def write_text_files(redacted: DataFrame, root: str, suffix: str = "_redacted.txt", column: str = "redacted") -> None:
    """One file per document, <doc_id>_redacted.txt (see ``safe_name``), in a folder that all executors reach."""
    _reachable(redacted.sparkSession, root)

    def run(rows):
        for r in rows:
            _put(root, f"{safe_name(r[0] or '')}{suffix}", (r[1] or "").encode("utf-8", "surrogatepass"))

    redacted.select(F.col("doc_id").cast("string"), column).foreachPartition(run)


def write_pseudonyms(scoped: DataFrame, named: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """One JSON line per document: doc_id, original_filename, entities with pseudonyms, redacted_path.

    files: (doc_id, original_filename, redacted_path); null for documents that it lacks.
    """
    entity = F.struct("canonical_id", "type", "canonical_text", "aliases", "pseudonym")
    rows = scoped.join(named, "canonical_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    if files is None:
        rows = rows.withColumns({"original_filename": F.lit(None).cast("string"), "redacted_path": F.lit(None).cast("string")})
    else:
        rows = rows.join(files.select("doc_id", "original_filename", "redacted_path"), "doc_id", "left")
    rows.select("doc_id", "original_filename", "entities", "redacted_path").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def rewrite_files(files: DataFrame, plan: DataFrame, writer: Callable[[bytes, list[dict]], bytes]) -> DataFrame:
    """(doc_id, content, error): every file (doc_id, content) as ``writer`` rewrites it by its rows of the plan.

    plan: rectangles with what to print over them (``redact.rectangles_to_print``) or images to put back
    (``vision.composites``), in the order of their page. The writer wraps a library for the format and runs on the
    executors; a file that it fails on keeps its error and has no content. A file without a plan passes through it too.
    """
    fields = [c for c in plan.columns if c != "doc_id"]
    marks = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*sorted(fields, key=lambda c: c != "page_no")))).alias("marks"))
    joined = files.select("doc_id", "content").join(marks, "doc_id", "left")

    def run(batches):
        for b in batches:
            contents, errors = [], []
            for data, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    contents.append(writer(data, rows or []))
                    errors.append(None)
                except (RuntimeError, ValueError) as e:
                    contents.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "content", "error"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, content binary, error string")


def write_memory(memory: DataFrame, root: str, version: int) -> str:
    """A new snapshot beside the older ones; the snapshot being read is never overwritten."""
    path = f"{root}/version={version:06d}"
    memory.write.mode("errorifexists").parquet(path)
    return path


def send(rows: DataFrame, writer: Callable) -> None:
    """Give partitions of rows to a writer (a graph store, a PDF library) on the executors."""
    rows.foreachPartition(writer)


def remember(rows: DataFrame, connect: Callable, text: str = "payload", reset: bool = False) -> None:
    """Give a graph store one call of ``remember(text, tags)`` for each row (``text`` and node_set); with ``reset`` its
    ``forget()`` comes first, once. connect makes a client wherever it is called, on the driver and on executors."""
    if reset:
        connect().forget()

    def run(part):
        client = None
        for r in part:
            client = client or connect()
            client.remember(r[0], list(r[1]))

    rows.select(text, "node_set").foreachPartition(run)


def write_personas(personas: DataFrame, path: str) -> None:
    """Personas as JSON lines, which ``files.read_personas`` reads."""
    personas.write.mode("overwrite").json(path)


def docx_bytes(text: str) -> bytes:
    """A text as a DOCX file, a paragraph for each line."""
    space = "http://schemas.openxmlformats.org"
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{space}/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


#: An A4 page in points, its margin, and a fixed-pitch font: 6 points a character, 17 a line.
_PAGE, _MARGIN, _SIZE, _PITCH, _LEADING = (595, 842), 71, 10, 6, 17


def pdf_pages(text: str) -> list[list[str]]:
    """Lines of a text as they stand on pages: broken at spaces to the width of the column; a longer word is cut."""
    width, height = ((side - 2 * _MARGIN) // step for side, step in zip(_PAGE, (_PITCH, _LEADING)))
    lines: list[str] = []
    for line in text.expandtabs(4).split("\n"):
        own = ""
        for word in line.split(" "):
            grown = f"{own} {word}" if own else word
            if len(grown) > width and own:
                lines.append(own)
                grown = word
            while len(grown) > width:
                lines.append(grown[:width])
                grown = grown[width:]
            own = grown
        lines.append(own)
    return [lines[k : k + height] for k in range(0, len(lines), height)]


def pdf_bytes(text: str) -> bytes:
    """A text as a PDF file of plain lines; what the Windows code page lacks is a question mark."""
    shown = lambda line: re.sub(rb"([\\()])", rb"\\\1", re.sub("[\x00-\x1f\x7f]", " ", line).encode("cp1252", "replace"))
    pages = pdf_pages(text)
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, lines in enumerate(pages):
        drawn = b"\n".join(b"(%s) Tj T*" % shown(x) for x in lines)
        content = b"BT /F1 %d Tf %d TL %d %d Td\n%s\nET" % (_SIZE, _LEADING, _MARGIN, _PAGE[1] - _MARGIN - _SIZE, drawn)
        parts.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*_PAGE, 5 + 2 * k))
        parts.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    end = b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, table, len(parts) + 1, len(out))
    return bytes(out + end)


def write_documents(made: DataFrame, root: str) -> DataFrame:
    """Made documents (doc_id, doc_type, persona_ids, text, spans) as <doc_id>.txt, .docx, .pdf and .labels.json, whose offsets
    are those of the text; returns the manifest."""
    _reachable(made.sparkSession, root)

    def run(rows):
        for r in rows:
            name = safe_name(str(r.doc_id))
            for kind, data in (("txt", r.text.encode()), ("docx", docx_bytes(r.text)), ("pdf", pdf_bytes(r.text)), ("labels.json", r.labels.encode())):
                _put(f"{root}/{name}", f"{name}.{kind}", data)

    labels = F.to_json(F.struct("doc_id", "doc_type", "persona_ids", "spans", F.expr("cast(array() as array<string>)").alias("images")))
    made.select("doc_id", "text", labels.alias("labels")).foreachPartition(run)
    return manifest(made)


def manifest(made: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_type, n_spans, n_images, n_regions. images: (doc_id, image_id, regions: array)."""
    rows = made.select("doc_id", "doc_type", F.size("spans").cast("bigint").alias("n_spans"))
    if images is None:
        return rows.withColumns({"n_images": F.lit(0).cast("bigint"), "n_regions": F.lit(0).cast("bigint")})
    counts = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.greatest(F.size("regions"), F.lit(0))).alias("n_regions"))
    return rows.join(counts, "doc_id", "left").fillna(0, ["n_images", "n_regions"])


def entity_json(memory: DataFrame) -> DataFrame:
    """(key, entity): each entity as a JSON text; its spans are not part of it."""
    return memory.select("key", F.to_json(F.struct("canonical_id", "type", "canonical_text", "aliases", "doc_ids", "pseudonym")).alias("entity"))


def write_memory_json(memory: DataFrame, path: str) -> None:
    """A snapshot with its version on a line for each entity, which ``files.read_memory_json`` reads."""
    entity = F.struct(*[c for c in memory.columns if c != "key"])
    memory.select(F.create_map("key", entity).alias("entities"), F.lit("1.0").alias("version")).write.mode("overwrite").json(path)


def export_spans(spans: DataFrame) -> DataFrame:
    """Spans as they are shown: confidence to two places, halves to even."""
    return spans.withColumn("confidence", F.bround("confidence", 2))


def reset_memory(spark: SparkSession, root: str) -> bool:
    """Remove all snapshots under ``root`` on whatever file system it lies; False if there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
