"""Made personas and letters with gold spans, for trials without real data. Every value follows from its row's number."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .shared import settle

FIRST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hal", "Iris", "Jon"]
LAST = ["Archer", "Bloom", "Carter", "Dale", "Ellis", "Frost", "Grant", "Hale", "Innes", "Judd", "Kerr"]
TOWN = ["Leeds", "Bath", "York", "Derby", "Truro"]
ORG = ["Harbour Ltd", "Northfield Group", "Quill Inc", "Orchard plc"]
NOTES = ["type 2 diabetes", "seasonal asthma", "a healed fracture", "high blood pressure"]
#: Letters of a National Insurance number's prefix and suffix.
NI_PREFIX, NI_SUFFIX = "ABCEGHJKLMNOPRSTWXYZ", "ABCD"
#: Honorifics that are no part of a name.
HONORIFICS = ["Dr", "Mr", "Mrs", "Ms", "Miss"]
FILLER = ["Please keep this letter for your files.", "Our office is open on working days.", "We will write again when the matter is settled."]


def _pick(values: list[str], salt: str, seed: int) -> Column:
    at = F.pmod(F.xxhash64("n", F.lit(salt), F.lit(seed)), F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def _digits(width: int, salt: str, seed: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64("n", F.lit(salt), F.lit(seed)), F.lit(10**width)).cast("string"), width, "0")


def _letter(values: str, salt: str, seed: int) -> Column:
    return _pick(list(values), salt, seed)


def ni_number(n: str, seed: int) -> Column:
    """Two letters, six digits, a letter."""
    return F.concat(_letter(NI_PREFIX, "ni1", seed), _letter(NI_PREFIX, "ni2", seed), _digits(6, "ni", seed), _letter(NI_SUFFIX, "ni3", seed))


def passport_number(n: str, seed: int) -> Column:
    return _digits(9, "passport", seed)


def without_honorific(name: Column) -> Column:
    """A name without the one title that it begins with."""
    return F.regexp_replace(name, f"^(?:{'|'.join(HONORIFICS)}) ", "")


def name_variants(name: Column) -> Column:
    """The name, its initial with the last name, the last name with a title, and last name first."""
    words = F.split(name, " ")
    first, last = words[0], F.element_at(words, -1)
    return F.array(name, F.concat(F.substring(first, 1, 1), F.lit(". "), last), F.concat(F.lit("Mr "), last), F.concat(last, F.lit(", "), first))


def driver_number(last: Column, first: Column, born: Column) -> Column:
    """16 characters: five of the last name, decade, month, day, year's last digit, two initials, a nine and a check."""
    year = F.year(born)
    return F.concat(
        F.rpad(F.upper(F.substring(last, 1, 5)), 5, "9"), (F.floor(year / 10) % 10).cast("string"), F.date_format(born, "MMdd"), (year % 10).cast("string"),
        F.rpad(F.upper(F.substring(first, 1, 1)), 2, "9"), F.lit("99A"),
    )


def personas(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """``count`` personas: persona_id, full_name, name_variants, email, phone, ni_number, dob, iban, credit_card, org,
    medical_note, other_id, ssn, recurring, driver_number, address."""
    base = spark.range(count).withColumnRenamed("id", "n").withColumns({"first": _pick(FIRST, "first", seed), "last": _pick(LAST, "last", seed)})
    day = F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(F.xxhash64("n", F.lit("dob"), F.lit(seed)), F.lit(18000)).cast("int"))
    return base.select(
        F.format_string("p_gen_%04d", "n").alias("persona_id"),
        F.concat_ws(" ", "first", "last").alias("full_name"),
        name_variants(F.concat_ws(" ", "first", "last")).alias("name_variants"),
        F.lower(F.format_string("%s.%s%d@example.org", "first", "last", "n")).alias("email"),
        F.concat(F.lit("07"), _digits(3, "a", seed), F.lit(" "), _digits(3, "b", seed), F.lit(" "), _digits(3, "c", seed)).alias("phone"),
        ni_number("n", seed).alias("ni_number"),
        F.date_format(day, "yyyy-MM-dd").alias("dob"),
        F.concat(F.lit("GB"), _digits(2, "i", seed), F.lit("ABCD"), _digits(14, "iban", seed)).alias("iban"),
        F.concat(F.lit("4"), _digits(15, "card", seed)).alias("credit_card"),
        _pick(ORG, "org", seed).alias("org"),
        _pick(NOTES, "note", seed).alias("medical_note"),
        passport_number("n", seed).alias("other_id"),
        F.concat(_digits(3, "s1", seed), F.lit("-"), _digits(2, "s2", seed), F.lit("-"), _digits(4, "s3", seed)).alias("ssn"),
        F.lit(False).alias("recurring"),
        driver_number(F.col("last"), F.col("first"), day).alias("driver_number"),
        F.concat(F.lit("1"), _digits(1, "no", seed), F.lit(" Elm Road, "), _pick(TOWN, "town", seed), F.lit(", M"), _digits(1, "p", seed), F.lit(" "), _digits(1, "q", seed), F.lit("AB")).alias("address"),
    )


def with_gold(parts: Column) -> Column:
    """An array of (text, type or null) as (text, spans): texts joined, a span (type, text, start, end) for each typed part."""
    kind = "array<struct<type:string,text:string,start:bigint,end:bigint>>"

    def step(acc, p):
        end = acc["at"] + F.length(p["text"])
        span = F.struct(p["type"].alias("type"), p["text"].alias("text"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(F.concat(acc["text"], p["text"]).alias("text"), end.alias("at"), F.when(p["type"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {kind})").alias("spans"))
    return F.aggregate(parts, zero, step, lambda acc: F.struct(acc["text"].alias("text"), acc["spans"].alias("spans")))


def pad_to_words(text: Column, least: int, filler: list[str] | None = None) -> Column:
    """Append filler paragraphs in turn until a text has ``least`` words."""
    filler = filler or FILLER
    sizes = [len(f.split()) for f in filler]
    have = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    turns = -(-least // min(sizes))
    lines = F.array(*[F.lit(filler[i % len(filler)]) for i in range(turns)])
    before = F.array(*[F.lit(sum(sizes[k % len(sizes)] for k in range(i))) for i in range(turns)])
    used = F.transform(F.filter(F.arrays_zip(before.alias("b"), lines.alias("l")), lambda x: have + x["b"] < least), lambda x: x["l"])
    return F.concat_ws("\n\n", F.array(text), used)


def letters(people: DataFrame, count: int, seed: int = 42, least_words: int = 0) -> DataFrame:
    """``count`` letters about personas chosen by hash: doc_id, text, spans (gold)."""
    return documents(people, count, seed, least_words, ["LETTER"]).select("doc_id", "text", "spans")


#: Documents by type: plain text, and <column:TYPE> where a persona's value stands.
TEMPLATES = {
    "LETTER": "Dear <name:PERSON>,\n\nYour post at <org:ORG> begins soon. Write to <email:EMAIL> or call <phone:PHONE>.\n\nWe hold number <ni_number:NI_NUMBER>, account <iban:IBAN> and card <credit_card:CREDIT_CARD>. Born <dob:DOB>, living at <address:ADDRESS>.",
    "EMPLOYMENT_LETTER": "<org:ORG>\n\nTo <name:PERSON>, <address:ADDRESS>\n\nWe are glad to offer you a post. Our payroll has your date of birth as <dob:DOB> and your number as <ni_number:NI_NUMBER>.\n\nPlease accept by mail to <email:EMAIL> or by phone on <phone:PHONE>.",
    "HR_ONBOARDING": "New starter form\n\nName: <name:PERSON>\nHome: <address:ADDRESS>\nBorn: <dob:DOB>\nEmployer: <org:ORG>\n\nPassport seen: <other_id:OTHER>. National Insurance: <ni_number:NI_NUMBER>.\n\nReach the starter at <email:EMAIL>, <phone:PHONE>.",
    "BANK_STATEMENT": "Statement of account\n\n<name:PERSON>, <address:ADDRESS>, born <dob:DOB>\n\nAccount <iban:IBAN>, card <credit_card:CREDIT_CARD>, tax number <ssn:SSN>.\n\nSalary from <org:ORG> was paid in. Questions go to <email:EMAIL> or <phone:PHONE>.",
    "MEDICAL_RECORD": "Patient <name:PERSON>, born <dob:DOB>, of <address:ADDRESS>\n\nHealth number <ni_number:NI_NUMBER>. The patient lives with <medical_note:MEDICAL>.\n\nReferred by <org:ORG>. Results go to <email:EMAIL> or <phone:PHONE>.",
    "INVOICE": "Invoice from <org:ORG>\n\nBilled to <name:PERSON>, <address:ADDRESS>\n\nPay from <iban:IBAN> or by card <credit_card:CREDIT_CARD>. Reference <ni_number:NI_NUMBER>.\n\nAsk <email:EMAIL> or <phone:PHONE> about this bill.",
    "LEGAL_DISCOVERY": "Matter against <org:ORG>\n\nWitness <name:PERSON> (born <dob:DOB>) of <address:ADDRESS> states as follows. Messages from <email:EMAIL> were kept, calls from <phone:PHONE> were not.\n\nIdentity was shown by passport <other_id:OTHER>.",
    "UTILITY_BILL": "Supply to <address:ADDRESS>\n\nAccount holder <name:PERSON>. We take the sum from <iban:IBAN>.\n\nWrite to <email:EMAIL> or ring <phone:PHONE>. Your supplier is <org:ORG>.",
}


def documents(people: DataFrame, count: int, seed: int = 42, least_words: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """``count`` documents of all types in turn: doc_id, doc_type, persona_ids, text, spans (gold).

    A document's persona and which form of the name it uses follow from its number, so the same call gives the same rows.
    """
    kinds = kinds or [k for k in TEMPLATES if k != "LETTER"]
    n = people.agg(F.count(F.lit(1))).first()[0]
    ids = F.format_string("p_gen_%04d", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))))
    docs = people.sparkSession.range(count).select("id", F.format_string("doc_%06d", "id").alias("doc_id"), ids.alias("persona_id"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int")).alias("doc_type"))
    rows = docs.join(people, "persona_id").withColumn("name", F.element_at("name_variants", (F.col("id") % 3 + 1).cast("int")))

    def part(piece: str) -> Column:
        field, _, kind = piece[1:-1].partition(":") if piece[:1] == "<" else ("", "", "")
        return F.struct((F.col(field) if kind else F.lit(piece)).alias("text"), F.lit(kind or None).cast("string").alias("type"))

    parts = None
    for kind in kinds:
        own = F.array(*[part(p) for p in re.split(r"(<\w+:\w+>)", TEMPLATES[kind]) if p])
        parts = F.when(F.col("doc_type") == kind, own) if parts is None else parts.when(F.col("doc_type") == kind, own)
    made = rows.select("doc_id", "doc_type", F.array("persona_id").alias("persona_ids"), with_gold(parts).alias("m"))
    text = pad_to_words(F.col("m.text"), least_words) if least_words else F.col("m.text")
    return made.select("doc_id", "doc_type", "persona_ids", text.alias("text"), F.col("m.spans").alias("spans"))


def get_persona(people: DataFrame, cast: DataFrame, docs: DataFrame, recurring: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, persona_id): for a share ``recurring`` of documents one of the ``cast``, dealt in turn so that it spreads,
    for the others one of ``people``. Choices follow from hashed ids."""
    place = lambda rows: settle(numbered(rows.select(F.lit(0).alias("_all"), "persona_id").distinct(), "_all", ["persona_id"], "slot").drop("_all"), "slots")
    known, fresh = place(cast), place(people)
    sizes = known.count(), fresh.count()
    hashed = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)).alias("h"))
    often = (F.col("h") < int(recurring * (1 << 20))) if sizes[0] else F.lit(False)
    chosen = hashed.withColumn("own", often).withColumn("slot", F.when(often, F.pmod("h", F.lit(max(sizes[0], 1)))).otherwise(F.pmod("h", F.lit(max(sizes[1], 1)))))
    both = known.withColumn("own", F.lit(True)).unionByName(fresh.withColumn("own", F.lit(False)))
    return chosen.join(both, ["own", "slot"]).select("doc_id", "persona_id")


def gold_spans(made: DataFrame) -> DataFrame:
    """(doc_id, type, text, start, end) of ``letters``."""
    return made.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.type", "s.text", "s.start", "s.end")


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, broken at spaces; a longer word has a line of its own."""

    def one(line):
        def step(acc, w):
            fits = F.length(acc["last"]) + 1 + F.length(w) <= width
            grown = F.struct(acc["done"].alias("done"), F.concat(acc["last"], F.lit(" "), w).alias("last"), F.lit(True).alias("open"))
            fresh = F.struct(F.concat(acc["done"], acc["last"], F.lit("\n")).alias("done"), w.alias("last"), F.lit(True).alias("open"))
            first = F.struct(acc["done"].alias("done"), w.alias("last"), F.lit(True).alias("open"))
            return F.when(~acc["open"], first).when(fits, grown).otherwise(fresh)

        zero = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit(False).alias("open"))
        return F.aggregate(F.split(line, " "), zero, step, lambda acc: F.concat(acc["done"], acc["last"]))

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")
