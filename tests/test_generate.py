import json

from pyspark.sql import functions as F

from spanweave.operators import detect, quality, vision
from spanweave.sources import files, generate, options, sinks


def test_letters_have_true_offsets(spark, tmp_path):
    people = generate.personas(spark, 12)
    made = generate.letters(people, 30, least_words=80)
    for r in made.collect():
        assert all(r.text[s.start : s.end] == s.text for s in r.spans) and len(r.spans) == 9 and len(r.text.split()) >= 80
    assert made.collect() == generate.letters(generate.personas(spark, 12), 30, least_words=80).collect()
    gold = generate.gold_spans(made).where("type IN ('EMAIL', 'PHONE', 'NI_NUMBER', 'IBAN', 'CREDIT_CARD', 'DOB')")
    found = detect.detect_patterns(made.select("doc_id", "text"))
    rows = {r.type: r for r in quality.precision_recall(found, gold).collect()}
    assert all(rows[k].hits == rows[k].gold == 30 for k in ("EMAIL", "NI_NUMBER", "IBAN", "DOB"))
    sinks.write_personas(people, str(tmp_path / "people"))
    back = files.read_personas(spark, str(tmp_path / "people"))
    assert back.where("name_variants[3] LIKE '%, %' AND name_variants[2] LIKE 'Mr %'").count() == 12
    for indent in (None, 2):
        (tmp_path / f"list{indent}.json").write_text(json.dumps([r.asDict(recursive=True) for r in back.collect()], indent=indent))
        assert sorted(files.read_personas(spark, str(tmp_path / f"list{indent}.json")).collect()) == sorted(back.collect())


def test_documents_of_all_types(spark, tmp_path):
    people = generate.personas(spark, 9)
    made = generate.documents(people, 14)
    rows = made.collect()
    assert {r.doc_type for r in rows} == set(generate.TEMPLATES) - {"LETTER"}
    assert all(r.text[s.start : s.end] == s.text for r in rows for s in r.spans)
    manifest = {r.doc_id: r for r in sinks.write_documents(made, str(tmp_path / "docs")).collect()}
    assert all(manifest[r.doc_id].n_spans == len(r.spans) and manifest[r.doc_id].n_regions == 0 for r in rows)
    one = rows[3]
    folder = tmp_path / "docs" / one.doc_id
    assert (folder / f"{one.doc_id}.txt").read_text() == one.text
    labels = json.loads((folder / f"{one.doc_id}.labels.json").read_text())
    assert labels["doc_type"] == one.doc_type and [s["text"] for s in labels["spans"]] == [s.text for s in one.spans]
    assert files.read_docx(spark, str(folder / f"{one.doc_id}.docx")).first().text == one.text
    images = spark.createDataFrame([(one.doc_id, "i", ["r", "s"]), (one.doc_id, "j", [])], "doc_id string, image_id string, regions array<string>")
    found = {r.doc_id: (r.n_images, r.n_regions) for r in sinks.manifest(made, images).collect()}
    assert found[one.doc_id] == (2, 2) and found[rows[0].doc_id] == (0, 0)
    chosen = generate.get_persona(people, people.limit(2), made, 0.5).collect()
    assert len(chosen) == 14 and chosen == generate.get_persona(people, people.limit(2), made, 0.5).collect()
    ids = people.select("driver_number", "ni_number", "other_id", generate.without_honorific(F.lit("Mrs Ann Lee")).alias("bare")).collect()
    assert all(len(r.driver_number) == 16 and len(r.ni_number) == 9 and len(r.other_id) == 9 and r.bare == "Ann Lee" for r in ids)


def test_wrap(spark):
    row = spark.createDataFrame([("aa bb cc dddddddd e\n\nf",)], "t string").select(generate.wrap(F.col("t"), 5).alias("w")).first()
    assert row.w == "aa bb\ncc\ndddddddd\ne\n\nf"


def test_options(tmp_path):
    (tmp_path / "env").write_text("# note\nA=1\nB = 'two'\n\nnothing\n")
    assert options.load(str(tmp_path / "env"), {"A": "0"}) == {"A": "0", "B": "two"}
    assert options.load(str(tmp_path / "none"), {}) == {}
    assert [options.flag("X", env={"X": v}) for v in ("Yes", "1", "TRUE", "no", "")] == [True, True, True, False, False] and options.flag("Y", True, {})
    assert options.endpoint([None, "a", "b"], lambda x: x == "b") == "b" and options.endpoint([], bool) is None


def test_metrics_composites_and_exports(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 9.0), ("e", 1, 5.0)], "doc_id string, page_no int, width double")
    chunks = spark.createDataFrame([("d",), ("d",)], "doc_id string")
    images = spark.createDataFrame([("d", "i", 2, 0.0), ("d", "j", 3, 0.0), ("e", "k", 1, None)], "doc_id string, image_id string, page_no int, x0 double").selectExpr("*", "x0 AS y0", "x0 AS x1", "x0 AS y1")
    got = {r.doc_id: (r.pages, r.chunks, r.images, r.has_geometry) for r in quality.ingest_metrics(pages, chunks, images).collect()}
    assert got == {"d": (2, 2, 2, False), "e": (1, 0, 1, True)}
    done = spark.createDataFrame([("i", "p"), ("j", "p"), ("k", "p")], "image_id string, path string")
    assert [r.image_id for r in vision.composites(images, done, pages).collect()] == ["i"]
    total = spark.range(1).select(quality.stage_total(F.create_map(F.lit("a"), F.lit(1.5), F.lit("total"), F.lit(9.0), F.lit("b"), F.lit(2.0))).alias("t")).first().t
    assert total == 3.5
    rows = sinks.export_spans(spark.createDataFrame([(0.125,), (0.875,)], "confidence double")).collect()
    assert [r.confidence for r in rows] == [0.12, 0.88]
    memory = spark.createDataFrame([("k", "x")], "key string, type string")
    sinks.write_memory_json(memory, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().version == "1.0"
    assert sinks.reset_memory(spark, str(tmp_path / "m")) and not sinks.reset_memory(spark, str(tmp_path / "m"))
