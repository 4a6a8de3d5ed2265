"""Folds, resolution, memory and rewriting on small fixtures with known answers."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.functions import text
from spanweave.operators import chunking, detect, memory, pseudonyms, quality, redact, resolve, spans
from spanweave.plans import pipeline
from spanweave.sources import sinks
from spanweave.streaming import memory_stream

SCHEMA = "doc_id string, type string, text string, start long, end long, source string, confidence double, ord long"
TEXTS = {
    "D1": "Dear John Smith,\nWe are pleased to offer you a position at Acme Corporation. Please confirm via j.smith@acme.com or call +44 7700 900123. For payroll we hold your National Insurance number QQ123456C.",
    "D2": "Invoice 4471 issued to J. Smith (Acme Corp).\nRemittance confirmation sent to j.smith@acme.com. Approved by Jane Doe. Card on file ending 4111 1111 1111 1111.",
    "D3": "HR memo re: Smith, John.\nCc: Jane Doe (jane.doe@acme.com). Home address on record: 221B Baker Street, London. Employer: Acme.",
}
FOUND = {
    "D1": [("PERSON", "John Smith"), ("ORG", "Acme Corporation"), ("EMAIL", "j.smith@acme.com"), ("PHONE", "+44 7700 900123"), ("NI_NUMBER", "QQ123456C")],
    "D2": [("PERSON", "J. Smith"), ("ORG", "Acme Corp"), ("EMAIL", "j.smith@acme.com"), ("PERSON", "Jane Doe"), ("CREDIT_CARD", "4111 1111 1111 1111")],
    "D3": [("PERSON", "Smith, John"), ("PERSON", "Jane Doe"), ("EMAIL", "jane.doe@acme.com"), ("ADDRESS", "221B Baker Street, London"), ("ORG", "Acme")],
}


def rows_of(docs):
    out = []
    for doc, items in docs.items():
        for i, (kind, surface) in enumerate(items):
            at = TEXTS[doc].rindex(surface) if surface == "Acme" else TEXTS[doc].index(surface)
            out.append((doc, kind, surface, at, at + len(surface), "regex", 0.95, i))
    return out


@pytest.fixture(scope="module")
def three(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    found = spark.createDataFrame(rows_of(FOUND), SCHEMA)
    return docs, found, pipeline.run(docs, found)


def test_three_documents(three):
    docs, found, result = three
    named = {r.canonical_id: r for r in result.entities.collect()}
    assert len(named) == 9
    smith = named["PERSON-0000"]
    told = {r.canonical_id: r.doc_ids for r in result.exported.collect()}
    assert told.keys() == named.keys() and "doc_ids" not in result.entities.columns
    assert smith.canonical_text == "John Smith" and smith.aliases == ["John Smith", "J. Smith", "Smith, John"] and told["PERSON-0000"] == ["D1", "D2", "D3"] and smith.pseudonym == "Agent A"
    assert named["ORG-0000"].aliases == ["Acme Corporation", "Acme Corp", "Acme"] and named["ORG-0000"].pseudonym == "Organization 1"
    assert named["PERSON-0001"].pseudonym == "Agent B" and named["CREDIT_CARD-0000"].pseudonym == "[CARD-1]"
    texts = {r.doc_id: r for r in result.redacted.collect()}
    assert texts["D2"].redacted == "Invoice 4471 issued to Agent A (Organization 1).\nRemittance confirmation sent to [EMAIL-1]. Approved by Agent B. Card on file ending [CARD-1]."
    assert texts["D3"].redacted == "HR memo re: Agent A.\nCc: Agent B ([EMAIL-2]). Home address on record: [ADDRESS-1]. Employer: Organization 1."
    assert [texts[d].replacements for d in ("D1", "D2", "D3")] == [5, 5, 5]
    assert redact.leaks(result.redacted, result.spans).count() == 0
    row = quality.consistency(result.entities).first()
    assert row.entities == row.pseudonyms == 9 and row.surfaces == 13 and row.shared == 0


def test_unmapped_spans_and_spanless_documents_stay(spark, three):
    docs, found, result = three
    none = redact.redact(docs, found, result.surfaces.where("type = 'EMAIL'"))
    assert {r.doc_id: r.replacements for r in none.collect()} == {"D1": 1, "D2": 1, "D3": 1}
    empty = redact.redact(docs, found.where("false"), result.surfaces)
    assert {r.doc_id: r.redacted for r in empty.collect()} == TEXTS


def test_given_names_fold_in_order(spark):
    names = ["J Doe", "Jane Doe", "John Doe", "Doe", "J Doe", "Bob Doe"]
    rows = [("d", "PERSON", n, 10 * i, 10 * i + len(n), "llm", 0.8, i) for i, n in enumerate(names)]
    got = [r.aliases for r in resolve.entities(spark.createDataFrame(rows, SCHEMA)).orderBy("number").collect()]
    assert got == [["J Doe", "Jane Doe", "Doe"], ["John Doe"], ["Bob Doe"]]


def spans_df(spark, items):
    return spark.createDataFrame([("d", k, "x", a, b, s, 0.9, i) for i, (k, a, b, s) in enumerate(items)], SCHEMA)


def ranges(df):
    return sorted((r.start, r.end, r.source) for r in df.collect())


def test_folds(spark):
    abc = spans_df(spark, [("A", 0, 10, "regex"), ("A", 5, 20, "regex"), ("A", 12, 15, "regex")])
    assert ranges(spans.merge_spans(abc)) == [(0, 10, "regex"), (12, 15, "regex")]
    assert ranges(spans.memory_overlap_dedup(spans_df(spark, [("A", 0, 4, "memory"), ("A", 2, 9, "memory"), ("A", 9, 12, "memory")]))) == [(2, 9, "memory"), (9, 12, "memory")]
    tie = spans_df(spark, [("A", 3, 8, "llm"), ("A", 3, 8, "regex"), ("A", 3, 8, "memory")])
    assert ranges(spans.dedup_by_region(tie)) == [(3, 8, "memory")]
    assert ranges(spans.merge_spans(tie.where("source <> 'memory'"))) == [(3, 8, "regex")]


def test_region_fold_is_greedy(spark):
    r = random.Random(4)
    items = [("A", a := r.randint(0, 60), a + r.randint(1, 12), r.choice(["regex", "llm", "memory"])) for _ in range(60)]
    rank = {"memory": 0, "regex": 1, "llm": 2}
    want, end = [], 0
    for i, (_, a, b, s) in sorted(enumerate(items), key=lambda x: (x[1][1], x[1][1] - x[1][2], rank[x[1][3]], x[0])):
        if not want or a >= end:
            want.append((a, b, s))
            end = b
    assert ranges(spans.dedup_by_region(spans_df(spark, items))) == sorted(want)


def test_drop_contained(spark):
    df = spans_df(spark, [("ADDRESS", 0, 30, "regex"), ("ADDRESS", 20, 28, "regex"), ("PHONE", 20, 28, "regex"), ("EMAIL", 40, 50, "regex"), ("EMAIL", 40, 50, "regex")])
    assert sorted((r.type, r.start) for r in spans.drop_contained(df).collect()) == [("ADDRESS", 0), ("EMAIL", 40), ("EMAIL", 40), ("PHONE", 20)]


def test_model_answers(spark):
    fence = "```"
    cases = [
        (f'{fence}json\n[{{"type":"person","text":"Al","char_start":"3"}}]\n{fence}', [("PERSON", "Al", 3)]),
        ('{"results":[{"type":"foo","text":"b"}]}', [("OTHER", "b", 0)]),
        ('Sure: [{"type":"email","text":"c@d.e"}] done', [("EMAIL", "c@d.e", 0)]),
        ('[{"type":"email","text":"  "}]', []),
        ('{"note":"two","found":[{"type":"org","text":"Acme"}],"more":[{"type":"org","text":"no"}]}', [("ORG", "Acme", 0)]),
        ('{"results":"none","pii":[{"type":"dob","text":"x"}]}', [("DOB", "x", 0)]),
        ("nonsense", []),
    ]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").select("i", detect.parse_answer(F.col("a")).alias("x")).orderBy("i").collect()
    assert [[(x.type, x.text, x.char_start) for x in r.x] for r in rows] == [w for _, w in cases]
    found = spark.createDataFrame([("call 07700\n900123 now", "07700 900123"), ("abc", "zz"), ("a.b", "a.b")], "c string, s string").select(detect.find_in_chunk(F.col("c"), F.col("s")).alias("p")).collect()
    assert [r.p for r in found] == [5, -1, 0]


def test_failing_detector_keeps_its_error(spark):
    def bad(texts):
        raise RuntimeError("no answer")

    chunks = spark.createDataFrame([("c", "d", "text", 0)], "chunk_id string, doc_id string, text string, char_start long")
    row = detect.detect_model(chunks, bad).first()
    assert row.answer is None and row.error == "no answer"


def counting(folder, fails=()):
    """A model that notes each text it is asked about, one file a call, and fails on batches with one of ``fails``."""

    def model(texts):
        (folder / uuid.uuid4().hex).write_text("\n".join(texts))
        if set(texts) & set(fails):
            raise RuntimeError("no answer to " + " ".join(texts))
        return [f"[{t}]" for t in texts]

    return model


def test_a_model_is_asked_once_for_each_text(spark, tmp_path):
    """Repeated texts are one call, a rerun asks for what is new, failures keep their error and don't spoil their batch."""
    calls = lambda: sorted(t for f in (tmp_path / "calls").iterdir() for t in f.read_text().split("\n"))
    (tmp_path / "calls").mkdir()
    kind, store = "chunk_id string, doc_id string, text string, char_start long", str(tmp_path / "answers")
    rows = [(f"c{i}", f"d{i}", f"t{i % 7}", i) for i in range(60)] + [("n", None, None, 0)]
    first = detect.detect_model(spark.createDataFrame(rows, kind).repartition(5), counting(tmp_path / "calls"), store)
    assert first.count() == 61 and first.columns == ["chunk_id", "doc_id", "text", "char_start", "answer", "error"]
    assert {(r.text, r.answer) for r in first.collect()} == {(f"t{i}", f"[t{i}]") for i in range(7)} | {(None, "[]")}
    assert calls() == sorted(["", *(f"t{i}" for i in range(7))])
    more = [*rows, *[(f"m{i}", "d", f"u{i % 3}", 0) for i in range(9)]]
    again = detect.detect_model(spark.createDataFrame(more, kind).coalesce(1), counting(tmp_path / "calls", ["u1"]), store, together=50)
    assert again.count() == 70 and again.where("error IS NOT NULL").select("text", "answer", "error").distinct().collect() == [("u1", None, "no answer to u1")]
    assert {r.answer for r in again.where("text = 'u0'").collect()} == {"[u0]"}
    asked = calls()
    third = detect.detect_model(spark.createDataFrame(more, kind), counting(tmp_path / "calls"), store)
    assert third.count() == 70 and calls() == asked
    assert detect.detect_model(spark.createDataFrame([], kind), counting(tmp_path / "calls")).count() == 0


def test_memory_rows(spark, three):
    """Entities and edges as rows: keys follow the merged entities, repeated runs add nothing."""
    docs, found, result = three
    kind = "key string, canonical_id string, type string, canonical_text string, aliases array<string>, pseudonym string"
    old = spark.createDataFrame([("EMAIL-0000", "EMAIL-0000", "EMAIL", "x@y.org", ["x@y.org"], "[EMAIL-1]"), ("PERSON-0003", "PERSON-0003", "PERSON", "Jane Doe", ["Jane"], "Agent Q")], kind)
    held = spark.createDataFrame([("PERSON-0003", "D0"), ("PERSON-0003", "D2")], "key string, doc_id string")
    after, edges = memory.upsert_rows(old, held, result.entities, result.edges)
    keys = {r.canonical_text: (r.key, r.pseudonym, r.aliases) for r in after.collect()}
    assert len(keys) == 10 and keys["Jane Doe"] == ("PERSON-0003", "Agent Q", ["Jane", "Jane Doe"]) and keys["j.smith@acme.com"][0] == "EMAIL-0001" and keys["John Smith"][0] == "PERSON-0000"
    told = sorted((r.key, r.doc_id) for r in edges.collect())
    assert [d for k, d in told if k == "PERSON-0003"] == ["D0", "D2", "D3"] and [d for k, d in told if k == "EMAIL-0001"] == ["D1", "D2"] and len(told) == len(set(told))
    again = memory.upsert_rows(after, edges, result.entities, result.edges)
    assert sorted(map(str, again[0].collect())) == sorted(map(str, after.collect())) and sorted((r.key, r.doc_id) for r in again[1].collect()) == told


def test_memory_round(spark, three):
    docs, found, result = three
    first = pipeline.remember(spark.createDataFrame([], "key string, canonical_id string, type string, canonical_text string, aliases array<string>, doc_ids array<string>, pseudonym string"), result)
    assert first.count() == 9
    assert memory.stats(first).where("type IS NULL").first().n == 9
    again = memory.mapping(found, first)
    assert again[0].count() == 0
    same = redact.redact(docs, found, again[1])
    assert {r.redacted for r in same.collect()} == {r.redacted for r in result.redacted.collect()}
    scanned = memory.scan(docs, first)
    assert scanned.where("text = 'Jane Doe'").count() == 2
    grown = memory.upsert(first.where("key <> 'EMAIL-0000'"), result.exported.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")))
    assert grown.count() == 9 and grown.where("type = 'EMAIL' AND key = 'EMAIL-0000'").count() == 1


def test_page_words(spark):
    words = [("d", 1, 0, 0, 0, "Dear"), ("d", 1, 0, 0, 1, "John"), ("d", 1, 0, 1, 0, "Smith"), ("d", 1, 1, 0, 0, "Hello")]
    df = spark.createDataFrame(words, "doc_id string, page_no int, block_no int, line_no int, word_no int, word string")
    assert [(r.char_start, r.char_end) for r in chunking.page_words(df).orderBy("char_start").collect()] == [(0, 4), (5, 9), (10, 15), (17, 22)]
    assert chunking.page_texts(df).first().text == "Dear John\nSmith\n\nHello"


def test_chunks_slice_the_document(spark):
    body = "One two three. Four five.\n\nSix seven eight nine ten. Eleven!\n \nTwelve."
    pages = spark.createDataFrame([("d", 1, "Page one. "), ("d", 2, body)], "doc_id string, page_no int, text string")
    full = "Page one. " + body
    got = chunking.chunk(pages).where("page_no = 2").orderBy("idx").collect()
    assert all(full[r.char_start : r.char_end] == r.text for r in got)
    assert [r.text for r in got] == ["One two three. Four five.\n\nSix seven eight nine ten.", "Four five.\n\nSix seven eight nine ten. Eleven!\n \nTwelve.", "Six seven eight nine ten. Eleven!\n \nTwelve."]
    with pytest.raises(ValueError):
        chunking.chunk(pages, overlap=1.0)


def test_statements_and_edges(three):
    result = three[2]
    assert pseudonyms.edges(result.exported).where("canonical_id = 'PERSON-0000'").count() == 3
    line = pseudonyms.statements(result.exported).where("canonical_id = 'PERSON-0001'").first().statement
    assert line == "Jane Doe is a PERSON known as Agent B (aliases: Jane Doe; documents: D2, D3)."
    assert {r.type: r.next for r in pseudonyms.next_counters(result.entities).collect()}["PERSON"] == 2


def test_trimmed_surfaces_are_rewritten(spark):
    docs = spark.createDataFrame([("d", "by  Bob Ray .")], "doc_id string, text string")
    found = spark.createDataFrame([("d", "PERSON", " Bob Ray ", 3, 12, "llm", 0.9, 0)], SCHEMA)
    surfaces = spark.createDataFrame([("Bob Ray", "Agent A", "PERSON-0000", "PERSON")], "surface string, pseudonym string, canonical_id string, type string")
    assert redact.redact(docs, found, surfaces).first().redacted == "by Agent A."
    assert spark.createDataFrame([(" x ",)], "t string").select(text.strip(F.col("t"))).first()[0] == "x"


def test_fold_crosses_batches(spark):
    """A sweep over a document that is longer than an Arrow batch, against the same sweep in one piece."""
    r = random.Random(11)
    items = [("A", a := r.randint(0, 90_000), a + r.randint(1, 40), "regex") for _ in range(12_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got, moved = ranges(spans.dedup_by_region(spans_df(spark, items))), ranges(spans.memory_overlap_dedup(spans_df(spark, items)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, end = [], 0
    for _, a, b, s in sorted(items, key=lambda x: (x[1], x[1] - x[2])):
        if not want or a >= end:
            want.append((a, b, s))
            end = b
    assert got == sorted(want)
    want = []
    for _, a, b, s in [x for _, x in sorted(enumerate(items), key=lambda x: (x[1][1], x[0]))]:
        if not want or a >= want[-1][1]:
            want.append((a, b, s))
        elif b > want[-1][1]:
            want[-1] = (a, b, s)
    assert moved == sorted(want)


def test_drop_contained_against_all_pairs(spark):
    r = random.Random(5)
    items = [(r.choice("AB"), a := r.randint(0, 80), a + r.randint(1, 20), "regex") for _ in range(300)]
    want = [(a, b, s) for t, a, b, s in items if not any(u == t and c <= a and d >= b and d - c > b - a for u, c, d, _ in items)]
    assert ranges(spans.drop_contained(spans_df(spark, items))) == sorted(want)


#: Surfaces of eight documents, and where they stand: (document, [(type, start, surface)] in the order of patterns).
GOLDEN = [
    (1, [("EMAIL", 353, "priya.patel@meridian-health.co.uk"), ("PHONE", 402, "07700 900261"), ("NI_NUMBER", 309, "WK112233C"), ("DOB", 270, "1987-09-15"), ("ADDRESS", 217, "5 Elmwood Court, Birmingham, B15 3DH")]),
    (2, [("EMAIL", 278, "john.smith@meridian-health.co.uk"), ("PHONE", 326, "07700 900142"), ("DOB", 188, "1984-03-12"), ("ADDRESS", 135, "14 Carlisle Road, Manchester, M20 4PL")]),
    (3, [("EMAIL", 613, "daniel.walsh@northgate-finance.com"), ("PHONE", 656, "07700 900775"), ("CREDIT_CARD", 245, "6011527601895556"), ("IBAN", 203, "GB07OLJH23194875749118"), ("DOB", 186, "1978-06-04"), ("ADDRESS", 143, "27 Kingsway, Leeds, LS1 2HQ")]),
    (4, [("EMAIL", 658, "priya.patel@meridian-health.co.uk"), ("PHONE", 695, "07700 900261"), ("NI_NUMBER", 242, "WK112233C"), ("DOB", 147, "1987-09-15"), ("ADDRESS", 172, "5 Elmwood Court, Birmingham, B15 3DH")]),
    (5, [("EMAIL", 707, "stefan.novak@northgate-finance.com"), ("PHONE", 622, "07924402685"), ("PHONE", 745, "07700 900503"), ("NI_NUMBER", 154, "PR445566A"), ("CREDIT_CARD", 619, "4330792440268592"), ("IBAN", 663, "GB22MPCF76842684656321"), ("ADDRESS", 99, "92 Harbour View, Liverpool, L3 4BG")]),
    (6, [("EMAIL", 818, "a.okafor@brightside-legal.co.uk"), ("EMAIL", 918, "a.okafor@brightside-legal.co.uk"), ("PHONE", 863, "07700 900318"), ("NI_NUMBER", 797, "AB654321A"), ("DOB", 761, "1990-11-27"), ("ADDRESS", 129, "8 Foundry Lane, Bristol, BS1 6RT")]),
    (7, [("EMAIL", 643, "john.smith@meridian-health.co.uk"), ("PHONE", 684, "07700 900142"), ("IBAN", 559, "GB17KEMU01815908301661"), ("ADDRESS", 9356, "NE1 1XX"), ("ADDRESS", 169, "14 Carlisle Road, Manchester, M20 4PL")]),
    (8, [("EMAIL", 710, "priya.patel@meridian-health.co.uk"), ("PHONE", 747, "07700 900261"), ("NI_NUMBER", 159, "WK112233C"), ("IBAN", 666, "GB73TPSZ71147104974650"), ("ADDRESS", 102, "5 Elmwood Court, Birmingham, B15 3DH")]),
]


def test_golden_offsets(spark):
    """All eight patterns over texts that hold the golden surfaces at their places, and nothing else that they find."""
    texts = []
    for doc, rows in GOLDEN:
        body = list("; " * 5000)
        for _, at, surface in rows:
            body[at : at + len(surface)] = surface
        texts.append((doc, "".join(body)))
    found = detect.detect_patterns(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "ord", "start").collect()
    got = [(r.doc_id, r.type, r.start, r.text) for r in found]
    assert got == [(doc, *row) for doc, rows in GOLDEN for row in rows]


def test_line_ends_inside_surfaces(spark):
    cases = ["07700\n900142", "+44\t7700 900\n123", "4111\t1111 1111\n1111", "M20\n4PL", "14  Carlisle  Road,\nManchester,  M20\x0b4PL"]
    df = spark.createDataFrame(list(enumerate(f"see {c} now" for c in cases)), "doc_id long, text string")
    got = {r.doc_id: (r.type, r.text, r.start) for r in detect.detect_patterns(df).collect()}
    assert got == {i: (k, c, 4) for i, (k, c) in enumerate(zip(["PHONE", "PHONE", "CREDIT_CARD", "ADDRESS", "ADDRESS"], cases))}


def test_ids_and_answers(spark):
    rows = spans.dedup_by_id(detect.with_span_ids(spans_df(spark, [("A", 0, 4, "regex"), ("A", 0, 4, "regex"), ("A", 1, 4, "regex")])).withColumn("seq", F.col("ord")))
    assert rows.count() == 2 and all(r.span_id.startswith("sp-") for r in rows.collect())
    bodies = ['{"choices":[{"message":{"content":"a"}}]}', '{"response":"b"}', '{"message":{"content":"c"}}', '{"content":"d"}', "plain\nmore"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    assert [r.x for r in df.select("i", detect.answer_content(F.col("b")).alias("x")).orderBy("i").collect()] == ["a", "b", "c", "d", "plain"]


def test_page_searches_and_likeness(spark):
    words = spark.createDataFrame([("d", 1, "known", 0, 5, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page_no int, word string, char_start long, char_end long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, "Known"), ("d", 2, "the LOST one"), ("e", 1, "lost")], "doc_id string, page_no int, text string")
    found = spark.createDataFrame([("d", "PERSON", "known", 0, 5), ("d", "PERSON", "Lost", 40, 44)], "doc_id string, type string, text string, start long, end long")
    assert [(r.text, r.page_no) for r in redact.page_searches(found, words, pages).collect()] == [("Lost", 2)]
    pairs = spark.createDataFrame([("d", "abcd", "abxd"), ("e", None, "")], "doc_id string, a string, b string")
    assert {r.doc_id: (r.len_a, r.len_b, r.delta, r.ratio) for r in quality.likeness(pairs).collect()} == {"d": (4, 4, 0, 0.75), "e": (0, 0, 0, 1.0)}


def test_entity_spans(spark, three):
    docs, found, result = three
    rows = resolve.entity_spans(found, result.entities)
    assert rows.count() == found.count() and rows.where("text = 'J. Smith' AND canonical_id = 'PERSON-0000'").count() == 1


def store_in(root):
    """A maker of clients of a graph store in a folder; the class travels with it."""

    class Store:
        def forget(self):
            for f in root.iterdir():
                f.unlink()

        def remember(self, text, tags):
            (root / "-".join(tags)).write_text(text)

    return Store


def test_graph_store(spark, three, tmp_path):
    (tmp_path / "old").write_text("x")
    docs, found, result = three
    sinks.remember(pseudonyms.payloads(found), store_in(tmp_path), reset=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["D1", "D2", "D3"] and (tmp_path / "D1").read_text().startswith("Document D1\n- PERSON: John Smith\n")
    sinks.remember(pseudonyms.statements(result.exported), store_in(tmp_path), "statement")
    assert (tmp_path / "PERSON-0001-Agent B").exists() and len(list(tmp_path.iterdir())) == 12


def test_a_batch_touches_what_it_names(spark, tmp_path):
    """Six batches of ten new addresses beside known ones: state and files written for each stay the same while the memory
    grows, and every text is rewritten as one run over all texts does."""
    text_of = lambda i: f"from new{i:03d}@mail.org to old{i % 3}@site.org, see 'new{max(i - 25, 0):03d}@mail.orgx'"
    rows = [(i, text_of(i)) for i in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    query = memory_stream.start(spark, memory_stream.documents(spark, str(tmp_path / "in"), 1), str(out))
    query.processAllAvailable()
    progress = {p["batchId"]: p for p in query.recentProgress}
    query.stop()
    batches = sorted(int(p.name[6:]) for p in (out / "redacted").iterdir())
    assert len(batches) == 6
    updated = [progress[n]["stateOperators"][0]["numRowsUpdated"] for n in batches[1:]]
    assert max(updated) <= 1.5 * min(updated) and progress[batches[-1]]["stateOperators"][0]["numRowsTotal"] > 3 * max(updated)
    size = lambda n, name: sum(f.stat().st_size for f in (out / name / f"batch={n:06d}").glob("*.parquet"))
    for name in ("entities", "edges", "redacted"):
        first, last = size(batches[1], name), size(batches[-1], name)
        assert abs(last - first) < 0.3 * first
    whole = pipeline.run(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.redacted for r in spark.read.parquet(str(out / "redacted")).collect()}
    assert got == {r.doc_id: r.redacted for r in whole.redacted.collect()}
    snapshot = {r.canonical_text: r for r in memory_stream.snapshot(spark, str(out)).collect()}
    assert snapshot.keys() == {r.canonical_text for r in whole.entities.collect()} and len(snapshot["old0@site.org"].doc_ids) == 20


def test_texts_ask_for_heads_that_the_filter_has(spark, tmp_path):
    """Heads of aliases of every length and script, held against a filter; without one a text asks for all of its heads."""
    texts = spark.createDataFrame([("to anna@x.org, 北京市朝阳区 or é 😀😀",), ("",)], "text string")
    asked = lambda: {r.key[1:] for r in texts.mapInArrow(lambda batches: memory_stream._heads(batches, str(tmp_path)), memory_stream._IN).collect()}
    known = spark.createDataFrame([(["anna@x.org", "北京市朝阳", ""],), (["é", "😀😀", "none"],), (None,)], "aliases array<string>")
    (tmp_path / "heads").mkdir()
    held = memory_stream._with_heads(np.zeros(memory_stream._BITS // 8, dtype=np.uint8), known)
    (tmp_path / "heads" / "batch=000007").write_bytes(held.tobytes())
    spark.sparkContext.setLocalProperty("streaming.sql.batchId", "7")
    try:
        assert asked() == {"anna@", "北京市朝阳", "é", "😀😀"}
        spark.sparkContext.setLocalProperty("streaming.sql.batchId", "8")
        assert len(asked()) > 80 and {"anna@", "nna@x", "t", "to"} <= asked()
    finally:
        spark.sparkContext.setLocalProperty("streaming.sql.batchId", None)


def test_stream_passes_over_known_ids(spark, tmp_path):
    """Two batches: an id that comes twice in one counts once, one that an earlier batch has had is passed over."""
    source = tmp_path / "in"
    for k, rows in enumerate([[(1, "see b@x.org"), (1, "see a@x.org")], [(1, "see c@x.org"), (2, "see a@x.org, 07700 900142")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        memory_stream.drain(memory_stream.start(spark, stream, str(tmp_path / "out")))
        assert len(list((tmp_path / "out" / "redacted").glob("batch=*"))) == k + 1
    got = {(r.doc_id, r.redacted) for r in spark.read.parquet(str(tmp_path / "out" / "redacted")).collect()}
    assert got == {(1, "see [EMAIL-1]"), (2, "see [EMAIL-1], [PHONE-1]")}
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.txt").write_text("x")
    (tmp_path / "drop" / "b.exe").write_text("x")
    q = memory_stream.uploads(spark, str(tmp_path / "drop")).writeStream.format("memory").queryName("uploads").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.path.rsplit("/", 1)[1] for r in spark.table("uploads").collect()] == ["a.txt"]


def test_the_fold_goes_on_over_batches(spark):
    """Kept spans of documents that begin in one batch and end in another, against a plain walk."""
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(3)}", "OTHER", "x", a := rng.randrange(900), a + rng.randrange(0, 9), "llm", 0.5, i) for i in range(900)]
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[3] - r[4], r[7])):
        if r[0] not in last or r[3] >= last[r[0]]:
            want.append(r)
            last[r[0]] = r[4]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in spans.dedup_by_region(spark.createDataFrame(rows, SCHEMA)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)


def test_surfaces_are_keyed_once(spark, monkeypatch):
    """Keys and clusters are made for each distinct surface, however often it is mentioned."""
    tables = {}
    monkeypatch.setattr(resolve, "settle", lambda df, name, plain=resolve.settle: tables.setdefault(name, plain(df, name)))
    rows = [(f"d{i}", "PERSON", ("John Smith", "J. Smith")[i % 2], 0, 9, "llm", 0.5, 0) for i in range(40)]
    named, edges = resolve.resolved(spark.createDataFrame(rows, SCHEMA))
    assert tables["surfaces"].count() == 2 and named.first().n_spans == 40 and edges.count() == 40


def test_places_are_those_of_the_ids_in_order(spark):
    """Pseudonyms by an entity's place are those of sorting its ids, after a memory's numbers too."""
    spans = spark.createDataFrame([(i, "OTHER" if i % 3 else "ORG", f"thing {i * 7919 % 1009}", i, i + 5, "regex", 0.9, 0) for i in range(300)], "doc_id long, type string, text string, start long, end long, source string, confidence double, ord long")
    bases = spark.createDataFrame([("ORG", 9950)], "type string, base long")
    for after in (None, bases):
        found = resolve.entities(spans, after)
        by_place, by_order = ({(r.canonical_id, r.pseudonym) for r in pseudonyms.assign(f).collect()} for f in (found, found.drop("place")))
        assert by_place == by_order and len(by_place) > 200


def test_places_need_no_further_sort(spark):
    spans = spark.createDataFrame([(1, "ORG", "Acme", 0, 4, "regex", 0.9, 0)], "doc_id long, type string, text string, start long, end long, source string, confidence double, ord long")
    found = resolve.entities(spans)
    assert "place" in found.columns
    named = pseudonyms.assign(found)._jdf.queryExecution().optimizedPlan().toString()
    assert named.count("Window") == found._jdf.queryExecution().optimizedPlan().toString().count("Window")


def test_only_edged_surfaces_are_looked_up_trimmed(spark):
    spans = spark.createDataFrame([(1, "ORG", "Acme", 0, 4), (1, "ORG", " Acme ", 5, 11), (2, "ORG", " Bolt", 0, 5), (2, "ORG", "Cove", 6, 10)], "doc_id long, type string, text string, start long, end long")
    surfaces = spark.createDataFrame([("Acme", "O1"), ("Bolt", "O2"), (" Bolt", "O3")], "surface string, pseudonym string")
    out = redact.replacements(spans, surfaces)
    assert {(r.doc_id, r.start, r.pseudonym) for r in out.collect()} == {(1, 0, "O1"), (1, 5, "O1"), (2, 0, "O3")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_documents_of_an_entity_are_distinct(spark):
    named = spark.createDataFrame([("ORG-0000",), ("ORG-0001",)], "canonical_id string")
    edges = spark.createDataFrame([("ORG-0000", 3), ("ORG-0000", 1), ("ORG-0000", 3)], "canonical_id string, doc_id long")
    assert {r.canonical_id: r.doc_ids for r in resolve.with_documents(named, edges).collect()} == {"ORG-0000": [1, 3], "ORG-0001": None}
    from spanweave.plans import catalog, corpus

    assert "doc_ids" not in catalog._memory(corpus.letters(spark, "/root/testdata/sf0.001")).columns
