"""Column builders against plain Python."""

import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.functions import patterns, text
from spanweave.operators import detect
from spanweave.plans import corpus

TEXTS = st.lists(st.text(alphabet="ab@.1 -é😀\n", max_size=30), min_size=1, max_size=20)


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_match_spans_are_code_points(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.match_spans(F.col("t"), r"[a1]+@?").alias("m")).collect()
    for r in rows:
        assert [(m.start, m.end, m.text) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a1]+@?", r.t)]
        assert all(r.t[m.start : m.end] == m.text for m in r.m)


def test_non_bmp_offset(spark):
    assert one(spark, text.match_spans(F.col("t"), "@"), t="a😀b@")[0].start == 3


def test_literal_spans(spark):
    got = lambda t, lit: [m.start for m in one(spark, text.literal_spans(F.col("t"), F.col("l")), t=t, l=lit)]
    assert got("aaaa", "aa") == [0, 2]
    assert got("a.b.c", ".") == [1, 3]
    assert got("x\\Ey", "\\E") == [1]
    assert got("abc", "") == []


def test_letters_and_back(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 25, 26, 701, 702, 18277, 18278)], "n long").select("n", text.letters(F.col("n")).alias("s")).select("n", "s", text.letters_index(F.col("s")).alias("back")).collect()
    assert [r.s for r in rows] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert all(r.n == r.back for r in rows)


def test_pseudonyms_and_indices(spark):
    cases = [("PERSON", 2, "Agent C"), ("ORG", 0, "Organization 1"), ("NI_NUMBER", 0, "[NI-1]"), ("CREDIT_CARD", 4, "[CARD-5]"), ("OTHER", 1, "[REDACTED-2]"), ("EMAIL", 9, "[EMAIL-10]")]
    rows = spark.createDataFrame(cases, "k string, n long, want string").select("*", text.pseudonym(F.col("k"), F.col("n")).alias("p")).select("*", text.pseudonym_index(F.col("k"), F.col("p")).alias("i")).collect()
    assert all(r.p == r.want and r.i == r.n for r in rows)
    assert one(spark, text.pseudonym_index(F.col("k"), F.col("p")), k="EMAIL", p="[EMAIL]") is None


def test_org_core_and_person_parts(spark):
    for surface, core in (("Acme Corporation", "acme"), ("ACME Corp", "acme"), ("Acme", "acme"), ("Holdings Ltd", "")):
        assert one(spark, text.org_core(F.col("t")), t=surface) == core
    for surface, last, first in (("John Smith", "smith", "john"), ("J. Smith", "smith", "j"), ("Smith, John", "smith", "john"), ("Cher", "cher", ""), (" Mr Smith ", "smith", "mr")):
        assert one(spark, text.person_last(F.col("t")), t=surface) == last
        assert one(spark, text.person_first(F.col("t")), t=surface) == first


def test_sentences_and_overlap(spark):
    got = [s.text for s in one(spark, text.sentences(F.col("t")), t="Hi there. Ok? v1.2 is Dr. X! tail")]
    assert got == ["Hi there.", "Ok?", "v1.2 is Dr.", "X!", "tail"]
    rows = spark.createDataFrame([(0,), (1,), (5,), (6,)], "n int").select(text.overlap_words(F.col("n"), 0.2).alias("x")).collect()
    assert [r.x for r in rows] == [0, 1, 1, 2]


def test_patterns(spark):
    def hits(pattern, t):
        return [m.text for m in one(spark, text.match_spans(F.col("t"), pattern), t=t)]

    assert hits(patterns.NI_NUMBER, "no QQ123456C but WK112233C") == ["WK112233C"]
    assert hits(patterns.PHONE, "card 4330792440268592") == ["07924402685"]
    assert hits(patterns.STREET, "5 Elmwood Court, Birmingham, B15 3DH and 1 Power Station Way, X, B1 1AA") == ["5 Elmwood Court, Birmingham, B15 3DH"]
    assert hits(patterns.IBAN, "GB07OLJH23194875749118") == ["GB07OLJH23194875749118"]


def test_a_pattern_is_evaluated_once(spark):
    """Matches are bound to a variable: the optimised plan has one extraction and one split for each pattern."""
    docs = spark.createDataFrame([("d", "x")], "doc_id string, text string")
    plan = detect.detect_patterns(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("split(") == len(patterns.SCAN)
    one = docs.select(text.literal_spans(F.col("text"), F.lit("a")).alias("a"), text.sentences(F.col("text")).alias("b"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_many_matches(spark):
    """Runs of matches meet without a gap or an overlap, at and beside the runs' size."""
    for n in (0, 1, 255, 256, 257, 513, 1000):
        t = "a1" + "é22 x" * n
        df = spark.createDataFrame([(t,)], "text string")
        got = [(s.start, s.end, s.text) for s in df.select(text.match_spans(F.col("text"), "[0-9]+").alias("m")).first().m]
        assert got == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t)]
        got = [(s.start, s.end) for s in df.select(text.literal_spans(F.col("text"), F.lit("22 x")).alias("m")).first().m]
        assert got == [(m.start(), m.end()) for m in re.finditer("22 x", t)]


def test_a_lone_match_is_told_by_its_gaps(spark):
    """None, one and several matches, also beside the mark that stands for them; one match is never extracted."""
    pattern = "[0-9]+"
    for t in ("", "no", "7", "é7", "7é", "a\U0001f600b12c", "1 2", "\x01", "\x01 5", "\x015\x01", "3\x01é44 5"):
        got = [(m.start, m.end, m.text) for m in one(spark, text.match_spans(F.col("t"), pattern), t=t)]
        assert got == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)]
        got = [(m.start, m.end) for m in one(spark, text.literal_spans(F.col("t"), F.lit("5")), t=t)]
        assert got == [(m.start(), m.end()) for m in re.finditer("5", t)]
    plan = spark.range(1).select(text.match_spans(F.col("id").cast("string"), pattern))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan


def test_addresses_are_found_in_one_reading(spark):
    """Matches beside each other stay; a run without an @ is not tried again from each of its characters."""
    plain = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    for t in ("a@b.com_x@y.org", "a@b.com.c@d.net", "éa@b.co", "@a@b.cd", "%a.b+c@d-e.fg h@i", "a@b.c1x@y.zz", "A@B.CDEé@x.yz"):
        got = [(m.start, m.end) for m in one(spark, text.match_spans(F.col("t"), patterns.EMAIL), t=t)]
        assert got == [(m.start(), m.end()) for m in re.finditer(plain, t)]
    began = time.time()
    assert one(spark, text.match_spans(F.col("t"), patterns.EMAIL), t="@" + "a" * 300_000) == []
    assert time.time() - began < 20


def test_place_in_text_order(spark):
    """Numbers written with four digits at least, as canonical ids are, put in the order of their texts without a sort."""
    for base, size in ((0, 1), (0, 9999), (0, 10011), (0, 123457), (9990, 20), (95000, 7000), (10**18 - 3, 6)):
        n = spark.range(size).select((F.col("id") + base).alias("n"))
        rows = n.select(text.text_place(F.col("n"), F.lit(base), F.lit(size)).alias("place"), F.format_string("%04d", "n").alias("s"))
        assert [r.place for r in rows.orderBy("s").collect()] == list(range(size)), (base, size)


def test_texts_are_made_after_rows_are_dealt(spark):
    """A filter of texts would be moved to where few tasks read the customers."""
    letters = corpus.letters(spark, "/root/testdata/sf0.001")
    for found in (detect.detect_patterns(letters), detect.scan_pattern(letters, "DOB", patterns.DOB)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan and "Filter" not in plan[plan.index("Repartition") :]


def test_digits_begin_at_a_words_edge(spark):
    texts = ["1999-12-03", "x1999-12-03", "é12/03/1999", "112/03/1999 12/03/1999", "(03-12-1999)", "03-12-19991"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.text, r.start) for r in detect.scan_pattern(df, "DOB", patterns.DOB).collect()}
    assert got == {(0, "1999-12-03", 0), (3, "12/03/1999", 12), (4, "03-12-1999", 1)}
    cards = spark.createDataFrame([(0, "4111 1111 1111 1111, 14111111111111111 5500-0000-0000-0004 x340000000000009")], "doc_id long, text string")
    assert [(r.text, r.start) for r in detect.scan_pattern(cards, "CREDIT_CARD", patterns.CREDIT_CARD).collect()] == [("4111 1111 1111 1111", 0), ("5500-0000-0000-0004", 39)]
    streets = spark.createDataFrame([(0, "112 Elm Road, Leeds, M1 0AB; 3a 7 Elm Road, Bath, M2 1AB")], "doc_id long, text string")
    assert [(r.text, r.start) for r in detect.scan_pattern(streets, "ADDRESS", patterns.STREET).collect()] == [("112 Elm Road, Leeds, M1 0AB", 0), ("7 Elm Road, Bath, M2 1AB", 32)]


def test_first_classes_do_not_change_matches(spark):
    """E-mail addresses and phone numbers of made texts, as the plain forms of their patterns find them."""
    rng = random.Random(5)
    bits = ["ab", "Q", "12", "3", "07", "+44", "7", "(", ")", " ", "\n", "-", ".", "@", "_", "%", "co", "é", "😀", "07123", "456", "789", "a.b@c.de", "a@b.co", "+447123456789", "(07123) 456 789"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(3000)] + ["a" * 200_000, "a@b.co1@c.de"]
    s = r"[ \t\n\x0b\f\r]"
    plain = {patterns.EMAIL: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", patterns.PHONE: rf"(?:\+44{s}?7[0-9]{{3}}|\(?07[0-9]{{3}}\)?){s}?[0-9]{{3}}{s}?[0-9]{{3}}"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for own, form in plain.items():
        want = [re.findall(form, t) if len(t) < 1000 else [] for t in texts]
        got = [[m.text for m in r[0]] for r in df.select(text.match_spans(F.col("text"), own)).collect()]
        assert got == want and sum(map(len, got)) > 500
