import json
import re
import zipfile

import numpy as np
import pytest

from spanweave.operators import vision
from spanweave.sources import files, sinks

R = "http://schemas.openxmlformats.org/package/2006/relationships"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_text_and_docx(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo é".encode())
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("First", "Second"))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/image1.png", b"png")
        z.writestr("word/media/unused.png", b"not referred to")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{R}"><Relationship Id="r1" Type="http://x/image" Target="media/image1.png"/><Relationship Id="r2" Type="http://x/styles" Target="styles.xml"/><Relationship Id="r3" Type="http://x/image" Target="http://else/i.png" TargetMode="External"/></Relationships>')
    pages = files.read_documents(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.docx")])
    assert {r.doc_id: r.text for r in pages.collect()} == {"a": "one\ntwo é", "b": "First\nSecond"}
    assert [(r.image_id, bytes(r.content)) for r in files.read_docx_images(spark, str(tmp_path / "b.docx")).collect()] == [("b_img0", b"png")]
    with pytest.raises(ValueError):
        files.read_documents(spark, ["x.exe"])


def test_memory_files(spark, tmp_path):
    entity = {"canonical_id": "PERSON-0000", "type": "PERSON", "canonical_text": "A B", "aliases": ["A B"], "doc_ids": ["d"], "pseudonym": "Agent A"}
    (tmp_path / "m.json").write_text(json.dumps({"entities": {"PERSON-0000": entity}, "version": "1.0"}))
    (tmp_path / "bad.json").write_text("{nope")
    memory = files.read_memory_json(spark, str(tmp_path / "m.json"))
    assert memory.first().aliases == ["A B"]
    assert files.read_memory_json(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.read_memory_json(spark, str(tmp_path / "none.json")).count() == 0
    path = sinks.write_memory(memory, str(tmp_path / "store"), 1)
    assert files.read_memory(spark, path).count() == 1
    assert files.read_memory(spark, str(tmp_path / "nowhere")).count() == 0


def test_vision(spark):
    image = np.arange(400, dtype=np.uint8).reshape(20, 20, 1).repeat(3, axis=2)
    out = vision.pixelate(image, (0, 0, 20, 20))
    assert out.shape == image.shape and (out[:10, :10] == out[0, 0]).all() and (vision.pixelate(image, (5, 5, 5, 9)) == image).all()
    flat = np.full((30, 30, 1), 90, dtype=np.uint8)
    assert (vision.pixelate(flat, (-5, 2, 99, 28)) == flat).all() and (vision.blur(flat) == 90).all()
    spot = flat.copy()
    spot[15, 15] = 250
    small = vision.pixelate(spot, (12, 12, 18, 18))
    assert small.max() < 130 and (small[:12] == 90).all() and (small[:, 18:] == 90).all()
    images = spark.createDataFrame([("a", 500.0, 100.0), ("b", 100.0, 100.0)], "image_id string, width double, height double")
    regions = spark.createDataFrame([("a", 1.0, 1.0, 9.0, 9.0, "ID", 0.6), ("b", -5.0, 2.0, 200.0, 50.0, "ID", 0.6), ("b", 120.0, 0.0, 130.0, 5.0, "ID", 0.6)], "image_id string, x0 double, y0 double, x1 double, y1 double, label string, confidence double")
    clamped = vision.clamp(regions, images).where("image_id = 'b'").collect()
    assert [(r.x0, r.x1) for r in clamped] == [(0.0, 100.0)]
    assert {(r.image_id, r.label) for r in vision.signature_strips(regions, images).collect()} == {("a", "SIGNATURE"), ("b", "ID")}
    assert vision.stand_in_regions(images).count() == 4


def pgm(values):
    return b"P5\n# made\n%d %d\n255\n" % (len(values[0]), len(values)) + bytes(v for row in values for v in row)


def test_redacted_images(spark):
    checks = [[255 * ((x + y) % 2) for x in range(24)] for y in range(24)]
    images = spark.createDataFrame([("a", pgm(checks)), ("b", pgm(checks)), ("bad", b"nonsense")], "image_id string, content binary")
    regions = spark.createDataFrame([("a", 0.0, 0.0, 12.0, 24.0), ("bad", 0.0, 0.0, 1.0, 1.0)], "image_id string, x0 double, y0 double, x1 double, y1 double")
    rows = {r.image_id: r for r in vision.redact_images(images, regions).collect()}
    a, b = vision.read_netpbm(bytes(rows["a"].content))[:, :, 0], vision.read_netpbm(bytes(rows["b"].content))[:, :, 0]
    assert (b == np.array(checks)).all() and (a[:, 12:] == b[:, 12:]).all() and abs(a[:, :12].astype(int) - 127).max() <= 2
    assert rows["bad"].content is None and rows["bad"].error and rows["a"].n_regions == 1
    found = vision.detect_regions(images, {"one": lambda x: [(0, 0, 1, 1, "FACE", 0.75)], "none": lambda x: [], "two": lambda x: [(0, 0, 2, 2, "ID", 0.6)] * 2})
    assert [(r.image_id, bool(r.error)) for r in found.where("source IS NULL").collect()] == [("bad", True)]
    assert sorted((r.image_id, r.source) for r in found.where("source IS NOT NULL").collect()) == [("a", "one"), ("a", "two"), ("a", "two"), ("b", "one"), ("b", "two"), ("b", "two")]
    found = found.where("error IS NULL")
    assert vision.union_regions(found, found).count() == 12
    paged = vision.page_regions(found, spark.createDataFrame([("a", "d", 1), ("b", "d", 1)], "image_id string, doc_id string, page_no int"))
    assert {r.n_on_page for r in paged.collect()} == {6}
    words = spark.createDataFrame([("i", "ab", 80.0, 1.0, 2.0, 3.0, 4.0), ("i", " ", 90.0, 0.0, 0.0, 1.0, 1.0), ("i", "cd", 29.0, 0.0, 0.0, 1.0, 1.0)], "image_id string, text string, conf double, x double, y double, w double, h double")
    assert [(r.x0, r.y0, r.x1, r.y1, r.label, r.confidence) for r in vision.word_regions(words).collect()] == [(1.0, 2.0, 4.0, 6.0, "TEXT_PII", 0.8)]


def test_extractor_and_rewritten_files(spark, tmp_path):
    """A made format: a line for each word, a page break between pages."""

    def extract(data):
        pages = []
        for body in data.decode().split("\f"):
            words = [(0, k, 0, w, 0.0, 10.0 * k, 5.0 * len(w), 10.0 * k + 8) for k, w in enumerate(body.split())]
            pages.append({"words": words, "images": [(7, b"img", (1.0, 2.0, 3.0, 4.0)), (8, b"img", None)] if "pic" in body else []})
        return pages

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"John pic\fSmith")
    path = str(tmp_path / "in" / "x.pdf")
    pages = {r.page_no: (r.text, r.width) for r in files.read_documents(spark, [path], extract).collect()}
    assert pages == {1: ("John\npic", 20.0), 2: ("Smith", 25.0)}
    with pytest.raises(ValueError):
        files.read_documents(spark, [path])
    assert sorted((r.image_id, r.x0) for r in files.extract_images(spark, path, extract).collect()) == [("x_p1_x7", 1.0), ("x_p1_x8", None)]
    words = files.extract_words(spark, path, extract)
    assert [r.word for r in files.first_boxes(words, 1).orderBy("page_no").collect()] == ["John", "Smith"]
    made = spark.createDataFrame([("x", bytearray(b"one")), ("y", bytearray(b"two")), ("z", bytearray(b"bad"))], "doc_id string, content binary")
    plan = spark.createDataFrame([("x", 2, 1.0, "B"), ("x", 1, 5.0, "A")], "doc_id string, page_no int, x0 double, label string")

    def writer(data, marks):
        if data == b"bad":
            raise RuntimeError("no pages")
        return data + "".join(m["label"] for m in marks).encode()

    rows = {r.doc_id: (r.content and bytes(r.content), r.error) for r in sinks.rewrite_files(made, plan, writer).collect()}
    assert rows == {"x": (b"oneAB", None), "y": (b"two", None), "z": (None, "no pages")}
    sinks.write_text_files(spark.createDataFrame([("a", "é x"), ("b", None)], "doc_id string, redacted string"), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a_redacted.txt": "é x", "b_redacted.txt": ""}


def test_memory_round_trip(spark, tmp_path):
    rows = [("PERSON-0000", "PERSON-0000", "PERSON", "Ann É", ["Ann É", "A."], ["d1", "d2"], "Agent A"), ("ORG-0001", "ORG-0001", "ORG", "X", ["X"], [], "Organization 2")]
    memory = spark.createDataFrame(rows, files.MEMORY)
    sinks.write_memory_json(memory, str(tmp_path / "m"))
    back = files.read_memory_json(spark, str(tmp_path / "m"))
    assert sorted(back.collect()) == sorted(memory.select(*back.columns).collect())
    (tmp_path / "flat.json").write_text(json.dumps({"entities": {"K": {"canonical_id": "K", "type": "ORG", "canonical_text": "X", "aliases": [], "doc_ids": [], "pseudonym": "p"}}, "version": "1.0"}, indent=2))
    assert [r.key for r in files.read_memory_json(spark, str(tmp_path / "flat.json")).collect()] == ["K"]
    texts = sinks.entity_json(memory)
    again = files.entities_from_json(texts.unionByName(spark.createDataFrame([("bad", "{nope")], "key string, entity string")))
    assert sorted((r.key, r.pseudonym, tuple(r.aliases)) for r in again.collect()) == [("ORG-0001", "Organization 2", ("X",)), ("PERSON-0000", "Agent A", ("Ann É", "A."))]
    scoped = spark.createDataFrame([("d1", "PERSON-0000"), ("d2", "PERSON-0000"), ("d2", "ORG-0001")], "doc_id string, canonical_id string")
    named = memory.drop("doc_ids")
    sinks.write_pseudonyms(scoped, named, str(tmp_path / "p"), spark.createDataFrame([("d1", "in.txt", "out.txt")], "doc_id string, original_filename string, redacted_path string"))
    got = {r.doc_id: (len(r.entities), r.original_filename, r.redacted_path) for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got == {"d1": (1, "in.txt", "out.txt"), "d2": (2, None, None)}
    sinks.write_texts(spark.createDataFrame([("d", "r", 1)], "doc_id string, redacted string, replacements int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_names_of_files(spark, tmp_path):
    """Ids with paths, dots, long ids and ids that differ in one such character have files of their own inside the folder."""
    ids = ["a/b", "a%2Fb", "a_b", "../up", "..", ".", "x" * 300, "x" * 299 + "y", "é:ß", "", "a\\b"]
    sinks.write_text_files(spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id string, redacted string"), str(tmp_path / "out"))
    names = [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    assert len(names) == len(ids) == len({sinks.safe_name(i) for i in ids}) and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    assert (tmp_path / "out" / "a%2Fb_redacted.txt").read_text() == "text 0"


def test_pdf_of_a_text():
    """Every object stands where the table says; the lines drawn are the text's, broken to the column, page by page."""
    text = "Dear Zoë (see \\ below),\n\n" + "word " * 400 + "\n" + "x" * 200 + "\n中文 end\ttab"
    data = sinks.pdf_bytes(text)
    table = data[int(re.search(rb"startxref\n(\d+)", data)[1]) :]
    assert table.startswith(b"xref")
    places = [int(m) for m in re.findall(rb"(\d{10}) 00000 n", table)]
    assert all(data[p:].startswith(b"%d 0 obj" % n) for n, p in enumerate(places, 1))
    assert all(len(m[2]) == int(m[1]) for m in re.finditer(rb"/Length (\d+) >>\nstream\n(.*?)\nendstream", data, re.S))
    pages = sinks.pdf_pages(text)
    drawn = [re.sub(rb"\\(.)", rb"\1", m).decode("cp1252") for m in re.findall(rb"\((.*)\) Tj", data)]
    assert drawn == [x.replace("中文", "??") for page in pages for x in page] and len(pages) == 1 and max(map(len, drawn)) == 75
    assert " ".join(" ".join(drawn).split()).replace("??", "中文").replace(" ", "") == "".join(text.split())
    assert data.count(b"/Type /Page ") == len(pages) and len(sinks.pdf_pages("line\n" * 200)) == 5
    assert sinks.pdf_pages("") == [[""]]
