"""The driver's queries: every operator of the engine over its tables or the derived corpus, beside the same in DuckDB."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..operators import chunking, detect, memory, pseudonyms, quality, redact, resolve, spans, vector_index, vision
from ..sources import files
from ..sources.shared import dealt, fresh_path, settle, shared_dir
from . import corpus, pipeline

_COLUMNS = ["doc_id", "type", "text", "start", "end", "source", "confidence", "ord"]
#: The eight patterns written out once more for the oracle, in scan order, so that a slip in the library's own shows.
_SQL_SCAN = [
    ("EMAIL", r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE", r"(?:\+44[\s\x0b]?7\d{3}|\(?07\d{3}\)?)[\s\x0b]?\d{3}[\s\x0b]?\d{3}"),
    ("NI_NUMBER", r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b"),
    ("CREDIT_CARD", r"\b(?:4\d{3}[-\s\x0b]?\d{4}[-\s\x0b]?\d{4}[-\s\x0b]?\d{4}|5[1-5]\d{2}[-\s\x0b]?\d{4}[-\s\x0b]?\d{4}[-\s\x0b]?\d{4}|3[47]\d{2}[-\s\x0b]?\d{6}[-\s\x0b]?\d{5}|6(?:011|5\d{2})[-\s\x0b]?\d{4}[-\s\x0b]?\d{4}[-\s\x0b]?\d{4})\b"),
    ("IBAN", r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b"),
    ("DOB", r"\b(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})\b"),
    ("ADDRESS", r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?[\s\x0b]?\d[A-Z]{2}\b"),
    ("ADDRESS", r"(?i)\d+[\s\x0b]+[A-Z]{2,}(?:[\s\x0b]+[A-Z]{2,})?,[\s\x0b]*(?:[A-Z]{2,}[\s\x0b]*)+,?[\s\x0b]*[A-Z]{1,2}\d[A-Z\d]?[\s\x0b]?\d[A-Z]{2}\b"),
]
_SQL_PATTERN = {"detect_email": 0, "detect_phone": 1, "detect_ni": 2, "detect_card": 3, "detect_iban": 4, "detect_dob": 5, "detect_postcode": 6, "detect_street": 7}
_LETTERS = f"letters AS ({corpus.LETTERS})"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "type", F.col("text").alias("surface"), F.col("start").alias("char_start"), F.col("end").alias("char_end"))


# --- SQL building blocks of the oracles ------------------------------------------------------------------------------
def _scan_sql(source: str, kind: str, pattern: str, order: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS type, m[i] AS text,
  CAST(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT) AS s,
  CAST(list_sum([length(x) for x in g[1:i]]) + list_sum([length(x) for x in m[1:i]]) AS BIGINT) AS e, 'regex' AS source, {order} AS ord
FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM {source}) a) b"""


def _raw_sql(source: str, scan) -> str:
    return " UNION ALL ".join(_scan_sql(source, k, p, i) for i, (k, p) in enumerate(scan))


def _found(source: str, scan) -> str:
    """CTEs raw and found (without contained spans)."""
    return f"""raw AS ({_raw_sql(source, scan)}),
found AS (SELECT * FROM raw r WHERE NOT EXISTS (SELECT 1 FROM raw o WHERE o.doc_id = r.doc_id AND o.type = r.type AND o.s <= r.s AND o.e >= r.e AND o.e - o.s > r.e - r.s))"""


_MODEL = "model AS (SELECT doc_id, 'PERSON' AS type, person AS text, CAST(strpos(text, person) - 1 AS BIGINT) AS s, CAST(strpos(text, person) - 1 + length(person) AS BIGINT) AS e, 'llm' AS source, 20 AS ord FROM letters UNION ALL SELECT doc_id, 'ORG', org, strpos(text, org) - 1, strpos(text, org) - 1 + length(org), 'llm', 21 FROM letters UNION ALL SELECT doc_id, 'OTHER', 'call 07', strpos(text, 'call 07') - 1, strpos(text, 'call 07') + 6, 'llm', 22 FROM letters)"
_ALL = "every AS (SELECT * FROM found UNION ALL SELECT * FROM model)"


def _greedy(source: str, order: str, name: str = "kept") -> str:
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM {source}),
walk AS (SELECT doc_id, rn, e AS last_end, true AS keep FROM o WHERE rn = 1 UNION ALL
  SELECT o.doc_id, o.rn, CASE WHEN o.s >= w.last_end THEN o.e ELSE w.last_end END, o.s >= w.last_end FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
{name} AS (SELECT o.* FROM o JOIN walk w ON o.doc_id = w.doc_id AND o.rn = w.rn AND w.keep)"""


_MERGE = "s, -e, CASE source WHEN 'regex' THEN 0 ELSE 1 END, ord"
_REGION = "s, -(e - s), CASE source WHEN 'memory' THEN 0 WHEN 'regex' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END, ord"
_SHOW = "SELECT doc_id, type, text AS surface, s AS char_start, e AS char_end FROM {}"
_KEY = r"""CASE WHEN type = 'PERSON' THEN lower(CASE WHEN contains(text, ',') THEN split_part(text, ',', 1) || '|' || left(trim(split_part(text, ',', 2)), 1) ELSE regexp_extract(text, '([A-Za-z]+)$', 1) || '|' || left(text, 1) END)
  WHEN type = 'ORG' THEN lower(split_part(text, ' ', 1))
  WHEN type IN ('ADDRESS', 'DOB', 'MEDICAL', 'OTHER') THEN regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[.,]+$', '')
  WHEN type = 'EMAIL' THEN lower(trim(text)) ELSE regexp_replace(lower(trim(text)), '[\s\-.()]', '', 'g') END"""


def _label(n: str) -> str:
    return f"CASE WHEN {n} < 26 THEN chr(CAST(65 + {n} AS INT)) WHEN {n} < 702 THEN chr(CAST(65 + ({n} - 26) // 26 AS INT)) || chr(CAST(65 + ({n} - 26) % 26 AS INT)) ELSE chr(CAST(65 + ({n} - 702) // 676 AS INT)) || chr(CAST(65 + (({n} - 702) // 26) % 26 AS INT)) || chr(CAST(65 + ({n} - 702) % 26 AS INT)) END"


def _pseudonym(n: str) -> str:
    return f"CASE type WHEN 'PERSON' THEN 'Agent ' || ({_label(n)}) WHEN 'ORG' THEN 'Organization ' || CAST({n} + 1 AS STRING) ELSE '[' || CASE type WHEN 'NI_NUMBER' THEN 'NI' WHEN 'CREDIT_CARD' THEN 'CARD' WHEN 'OTHER' THEN 'REDACTED' ELSE type END || '-' || CAST({n} + 1 AS STRING) || ']' END"


def _entities(source: str, x: str = "", base: str = "") -> str:
    """CTEs keyed, ents (numbered, with canonical text), named and smap, with suffix x; numbers go on after those of ``base``."""
    after = f" + (SELECT count(*) FROM {base} m WHERE m.type = t.type)" if base else ""
    return f"""keyed{x} AS (SELECT *, {_KEY} AS k, doc_id * 1000000000 + ord * 10000000 + s AS pos FROM {source}),
surf{x} AS (SELECT type, k, text, min(pos) AS pos, count(*) AS n FROM keyed{x} GROUP BY ALL),
ents{x} AS (SELECT type, k, row_number() OVER (PARTITION BY type ORDER BY min(pos)) - 1 AS number, arg_min(text, row(type = 'PERSON' AND contains(text, ','), -length(text), pos)) AS canonical_text,
  array_to_string(list(text ORDER BY pos), '|') AS aliases, sum(n) AS n_spans FROM surf{x} GROUP BY type, k),
shifted{x} AS (SELECT * EXCLUDE (number), number{after} AS number FROM ents{x} t),
ids{x} AS (SELECT *, type || '-' || CASE WHEN number < 10000 THEN lpad(CAST(number AS STRING), 4, '0') ELSE CAST(number AS STRING) END AS canonical_id FROM shifted{x}),
ranked{x} AS (SELECT t.*, row_number() OVER (PARTITION BY type ORDER BY canonical_id) - 1{after} AS place FROM ids{x} t),
named{x} AS (SELECT *, {_pseudonym("place")} AS pseudonym FROM ranked{x}),
smap{x} AS (SELECT text AS surface, arg_max(pseudonym, canonical_id) AS pseudonym, max(canonical_id) AS canonical_id FROM surf{x} JOIN named{x} USING (type, k) GROUP BY text)"""


def _redacted(docs: str, source: str) -> str:
    return f"""marks AS (SELECT doc_id, s, e, pseudonym, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_, max(e) OVER (PARTITION BY doc_id) AS tail FROM {source} JOIN smap ON text = surface),
redacted AS (SELECT d.doc_id, coalesce(string_agg(substr(d.text, CAST(from_ + 1 AS INT), CAST(s - from_ AS INT)) || pseudonym, '' ORDER BY s) || substr(any_value(d.text), CAST(max(tail) + 1 AS INT)), any_value(d.text)) AS redacted, count(s) AS replacements
  FROM {docs} d LEFT JOIN marks m ON d.doc_id = m.doc_id GROUP BY d.doc_id)"""


# --- inputs ----------------------------------------------------------------------------------------------------------
def _model_spans(letters: DataFrame) -> DataFrame:
    """What a model would find: persons, organisations, and a span that overlaps the phone number."""
    part = lambda kind, literal, order: F.transform(text.literal_spans(F.col("text"), literal), lambda m: F.struct(F.lit(kind).alias("type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(order).cast("bigint").alias("ord")))
    rows = letters.select("doc_id", F.explode(F.concat(part("PERSON", F.col("person"), 20), part("ORG", F.col("org"), 21), part("OTHER", F.lit("call 07"), 22))).alias("m"))
    return rows.select("doc_id", "m.type", "m.text", "m.start", "m.end", F.lit("llm").alias("source"), F.lit(0.85).alias("confidence"), "m.ord")


def _letter_spans(letters: DataFrame) -> DataFrame:
    return detect.detect_patterns(letters).select(*_COLUMNS).unionByName(_model_spans(letters))


def _letter_run(spark, sf_dir) -> tuple[DataFrame, pipeline.Run]:
    letters = corpus.letters(spark, sf_dir)
    return letters, pipeline.run(letters, _letter_spans(letters))


def _memory(letters: DataFrame, documents: bool = False) -> DataFrame:
    """Persons and organisations of the even letters, as a memory; only what merges documents needs theirs."""
    even = _model_spans(letters).select(*_COLUMNS).where("doc_id % 2 = 0 AND type IN ('PERSON', 'ORG')")
    fresh, edges = resolve.resolved(even)
    named = pseudonyms.assign(fresh)
    if documents:
        named = resolve.with_documents(named, edges)
    lists = [F.col("doc_ids").cast("array<string>").alias("doc_ids")] if documents else []
    return settle(named.select(F.col("canonical_id").alias("key"), "canonical_id", "type", "canonical_text", "aliases", *lists, "pseudonym"), "memory")


_MEMORY = "model_even AS (SELECT * FROM model WHERE doc_id % 2 = 0 AND type IN ('PERSON', 'ORG'))"
_WITH = f"WITH RECURSIVE {_LETTERS}, {_found('letters', _SQL_SCAN)}, {_MODEL}, {_ALL}"
_RUN = f"{_WITH}, {_greedy('every', _REGION)}, {_entities('kept')}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pipeline.run(docs, detect.detect_patterns(docs)).redacted.select("doc_id", "redacted", "replacements")


# --- sources and pages -----------------------------------------------------------------------------------------------
@query("SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def scan_documents_fulltext(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    return chunking.full_texts(pages).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("SELECT conv_id AS doc_id, turn AS page_no, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM conversations")
def page_offsets(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return chunking.page_offsets(pages).select("doc_id", "page_no", "page_start")


_WORDS = """words AS (SELECT doc_id, 1 AS page_no, CAST(floor((b - 1) / 2.0) AS BIGINT) AS block_no, b AS line_no, w AS word_no, word FROM (
  SELECT doc_id, b, unnest(range(1, len(ws) + 1)) AS w, unnest(ws) AS word FROM (
    SELECT doc_id, b, string_split(line, ' ') AS ws FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS b, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM letters) a) c) d) e WHERE word <> '')"""


def _words(letters: DataFrame) -> DataFrame:
    """Letters as a page of words: a block for two lines, a box for each word."""
    lines = letters.select("doc_id", F.posexplode(F.split("text", "\n")).alias("b", "line"))
    words = lines.select("doc_id", "b", F.posexplode(F.split("line", " ")).alias("w", "word")).where("word <> ''")
    rows = words.select("doc_id", F.lit(1).alias("page_no"), F.floor(F.col("b") / 2).cast("bigint").alias("block_no"), (F.col("b") + 1).cast("bigint").alias("line_no"), (F.col("w") + 1).cast("bigint").alias("word_no"), "word")
    placed = chunking.page_words(rows)
    x = (F.col("char_start") % 80).cast("double")
    y = (F.col("line_no") * 12).cast("double")
    return placed.withColumns({"x0": x, "y0": y, "x1": x + F.length("word"), "y1": y + F.lit(10.0)})


_PLACED = """seps AS (SELECT *, CASE WHEN lag(word) OVER w IS NULL THEN '' WHEN lag(block_no) OVER w <> block_no THEN chr(10) || chr(10) WHEN lag(line_no) OVER w <> line_no THEN chr(10) ELSE ' ' END AS sep FROM words WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY block_no, line_no, word_no)),
placed AS (SELECT *, ce - length(word) AS cs, CAST((ce - length(word)) % 80 AS DOUBLE) AS x0, CAST(line_no * 12 AS DOUBLE) AS y0, CAST((ce - length(word)) % 80 + length(word) AS DOUBLE) AS x1, CAST(line_no * 12 + 10 AS DOUBLE) AS y1
  FROM (SELECT *, CAST(sum(length(sep) + length(word)) OVER (PARTITION BY doc_id, page_no ORDER BY block_no, line_no, word_no) AS BIGINT) AS ce FROM seps) z)"""


@query(f"WITH {_LETTERS}, {_WORDS}, {_PLACED} SELECT doc_id, page_no, string_agg(sep || word, '' ORDER BY cs) AS text FROM placed GROUP BY doc_id, page_no")
def page_text_from_words(spark, sf_dir):
    return chunking.page_texts(_words(corpus.letters(spark, sf_dir)).drop("char_start", "char_end", "sep"))


@query(f"WITH {_LETTERS}, {_WORDS}, {_PLACED}, pages AS (SELECT doc_id, string_agg(sep || word, '' ORDER BY cs) AS text FROM placed GROUP BY doc_id), {_found('pages', _SQL_SCAN)} SELECT f.doc_id, type, s AS char_start, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM found f JOIN placed p ON f.doc_id = p.doc_id AND p.cs < f.e AND f.s < p.ce GROUP BY f.doc_id, type, s, e")
def span_page_rect(spark, sf_dir):
    words = _words(corpus.letters(spark, sf_dir))
    pages = chunking.page_texts(words.drop("char_start", "char_end", "sep"))
    return redact.span_rectangles(detect.detect_patterns(pages), words).select("doc_id", "type", F.col("start").alias("char_start"), "x0", "y0", "x1", "y1")


@query(f"WITH {_LETTERS}, {_WORDS}, {_PLACED}, pages AS (SELECT doc_id, string_agg(sep || word, '' ORDER BY cs) AS text FROM placed GROUP BY doc_id), {_found('pages', _SQL_SCAN)} SELECT f.doc_id, type, s AS char_start, cs AS word_start, word FROM found f JOIN placed p ON f.doc_id = p.doc_id AND p.cs < f.e AND f.s < p.ce")
def span_word_overlap(spark, sf_dir):
    words = _words(corpus.letters(spark, sf_dir))
    pages = chunking.page_texts(words.drop("char_start", "char_end", "sep"))
    return redact.span_words(detect.detect_patterns(pages), words).select("doc_id", "type", F.col("start").alias("char_start"), F.col("ws").alias("word_start"), "word")


# --- detection -------------------------------------------------------------------------------------------------------
def _one(name: str, kind: str, pattern: str, letters: bool):
    source = "letters" if letters else "documents"
    head = f"WITH {_LETTERS}, " if letters else "WITH "

    def f(spark, sf_dir):
        docs = corpus.letters(spark, sf_dir) if letters else table(spark, sf_dir, "documents")
        return _out(detect.scan_pattern(docs, kind, pattern))

    f.__name__ = name
    query(f"{head}raw AS ({_scan_sql(source, *_SQL_SCAN[_SQL_PATTERN[name]])}) {_SHOW.format('raw')}")(f)


for _name, _kind, _pattern, _own in (
    ("detect_email", "EMAIL", patterns.EMAIL, False), ("detect_phone", "PHONE", patterns.PHONE, False), ("detect_card", "CREDIT_CARD", patterns.CREDIT_CARD, False), ("detect_ni", "NI_NUMBER", patterns.NI_NUMBER, True),
    ("detect_iban", "IBAN", patterns.IBAN, True), ("detect_dob", "DOB", patterns.DOB, True), ("detect_postcode", "ADDRESS", patterns.POSTCODE, True), ("detect_street", "ADDRESS", patterns.STREET, True),
):
    _one(_name, _kind, _pattern, _own)


@query(f"WITH {_LETTERS}, {_found('letters', _SQL_SCAN)} {_SHOW.format('found')}")
def detect_regex_all(spark, sf_dir):
    return _out(detect.detect_patterns(corpus.letters(spark, sf_dir)))


@query(f"WITH {_found('documents', _SQL_SCAN)} {_SHOW.format('found')}")
def detect_documents(spark, sf_dir):
    return _out(detect.detect_patterns(table(spark, sf_dir, "documents")))


#: Letters whose spaces are line ends, tabs, or two of both.
_BROKEN = "broken AS (SELECT doc_id, replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(9) ELSE ' ' END) AS text FROM letters)"


@query(f"WITH {_LETTERS}, {_BROKEN}, {_found('broken', _SQL_SCAN)} {_SHOW.format('found')}")
def detect_across_lines(spark, sf_dir):
    gap = F.when(F.col("doc_id") % 3 == 0, "\n").when(F.col("doc_id") % 3 == 1, "\t").otherwise(" ")
    letters = corpus.letters(spark, sf_dir)
    return _out(detect.detect_patterns(letters.select("doc_id", F.replace("text", F.lit(" "), gap).alias("text"))))


@query(f"WITH {_LETTERS}, {_found('letters', _SQL_SCAN)} SELECT doc_id, type, text AS surface, s AS char_start, e AS char_end FROM found UNION ALL SELECT doc_id, type, text, s, e FROM found WHERE type = 'EMAIL'")
def drop_contained_rows(spark, sf_dir):
    """Over rows: every span beside its own first part, which goes, and e-mail addresses twice, which stay."""
    raw = detect.detect_patterns(corpus.letters(spark, sf_dir), contained=True)
    inner = raw.where("end - start > 4").withColumn("end", F.col("end") - 1)
    return _out(spans.drop_contained(raw.unionByName(inner).unionByName(raw.where("type = 'EMAIL'"))))


@query(f"WITH {_LETTERS}, {_found('letters', _SQL_SCAN)} SELECT type, (SELECT count(*) FROM raw r WHERE r.type = f.type) AS before, count(*) AS after FROM found f GROUP BY type")
def drop_contained(spark, sf_dir):
    raw = detect.detect_patterns(corpus.letters(spark, sf_dir), contained=True)
    after = spans.drop_contained(raw).groupBy("type").agg(F.count(F.lit(1)).alias("after"))
    return raw.groupBy("type").agg(F.count(F.lit(1)).alias("before")).join(after, "type")


@query(f"{_WITH}, {_greedy('every', _MERGE)} {_SHOW.format('kept')}")
def merge_spans(spark, sf_dir):
    return _out(spans.merge_spans(_letter_spans(corpus.letters(spark, sf_dir))))


@query(f"{_WITH}, {_greedy('every', _REGION)} {_SHOW.format('kept')}")
def dedup_by_region(spark, sf_dir):
    return _out(spans.dedup_by_region(_letter_spans(corpus.letters(spark, sf_dir))))


@query(f"""{_WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, ord) AS rn FROM every),
walk AS (SELECT doc_id, rn, rn AS pick, 1 AS slot, e AS last_end FROM o WHERE rn = 1 UNION ALL
  SELECT o.doc_id, o.rn, CASE WHEN o.s >= w.last_end OR o.e > w.last_end THEN o.rn ELSE w.pick END, CASE WHEN o.s >= w.last_end THEN w.slot + 1 ELSE w.slot END, CASE WHEN o.s >= w.last_end OR o.e > w.last_end THEN o.e ELSE w.last_end END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
kept AS (SELECT o.* FROM o JOIN (SELECT doc_id, slot, arg_max(pick, rn) AS pick FROM walk GROUP BY doc_id, slot) p ON o.doc_id = p.doc_id AND o.rn = p.pick) {_SHOW.format('kept')}""")
def memory_overlap_dedup(spark, sf_dir):
    return _out(spans.memory_overlap_dedup(_letter_spans(corpus.letters(spark, sf_dir))))


@query("SELECT span_id, arg_max(event_type, event_id) AS value, min(event_id) AS seq FROM (SELECT CAST(user_id AS STRING) AS span_id, event_id, event_type FROM events) e GROUP BY span_id")
def dedup_by_id_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("span_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return spans.dedup_by_id(rows).select("span_id", "value", "seq")


# --- memory ----------------------------------------------------------------------------------------------------------
_ALIAS = "aliases AS (SELECT DISTINCT text AS alias FROM model_even)"


@query(f"WITH {_LETTERS}, {_MODEL}, {_MEMORY}, {_ALIAS}, hits AS (SELECT doc_id, alias, string_split(text, alias) AS g FROM letters, aliases WHERE contains(text, alias)) SELECT doc_id, alias, len(g) - 1 AS n, CAST(length(g[1]) AS BIGINT) AS first_at FROM hits")
def literal_alias_scan(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    return memory.scan(letters, _memory(letters), resolved=False).groupBy("doc_id", F.col("text").alias("alias")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_at"))


@query(f"WITH {_LETTERS}, {_MODEL}, {_MEMORY}, {_ALIAS} SELECT doc_id, type, text AS surface, s AS char_start, e AS char_end FROM model WHERE text IN (SELECT alias FROM aliases)")
def known_spans(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    return _out(memory.known(_model_spans(letters), _memory(letters)))


@query(f"WITH {_LETTERS}, {_MODEL}, {_MEMORY}, {_ALIAS} SELECT doc_id, type, text AS surface, s AS char_start, e AS char_end FROM model WHERE text NOT IN (SELECT alias FROM aliases)")
def unknown_spans(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    return _out(memory.unknown(_model_spans(letters), _memory(letters)))


@query(f"WITH {_LETTERS}, {_MODEL}, {_MEMORY}, {_entities('model_even')} SELECT type, count(*) AS n FROM named GROUP BY ROLLUP (type)")
def memory_stats(spark, sf_dir):
    return memory.stats(_memory(corpus.letters(spark, sf_dir)))


@query(f"WITH {_LETTERS}, {_MODEL}, {_MEMORY}, {_entities('model_even')} SELECT type, count(*) AS next FROM named GROUP BY type")
def next_counters(spark, sf_dir):
    return pseudonyms.next_counters(_memory(corpus.letters(spark, sf_dir)))


@query(f"{_WITH}, {_MEMORY}, {_entities('model_even', '_m')}, fresh AS (SELECT * FROM every WHERE text NOT IN (SELECT text FROM model_even)), {_entities('fresh', '_n', 'named_m')} SELECT surface, pseudonym, canonical_id FROM smap_m UNION ALL SELECT surface, pseudonym, canonical_id FROM smap_n")
def mapping_with_memory(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    return memory.mapping(settle(_letter_spans(letters), "spans"), _memory(letters))[1].select("surface", "pseudonym", "canonical_id")


_SORTED = "array_to_string(list_sort(string_split(aliases, '|')), '|')"
_DOCS = "docs{x} AS (SELECT type, k, count(DISTINCT doc_id) AS n_docs FROM keyed{x} GROUP BY type, k)"
# no new entity has the canonical text of a known one, and the memory's numbers have no gaps: new ones go on after them
_UPSERT = f"""{_WITH}, {_MEMORY}, {_entities('model_even', '_m')}, fresh AS (SELECT * FROM every WHERE text NOT IN (SELECT text FROM model_even)), {_entities('fresh', '_n', 'named_m')}, {_DOCS.format(x='_m')}, {_DOCS.format(x='_n')},
added AS (SELECT *, (SELECT count(*) FROM named_m m WHERE m.type = n.type) + row_number() OVER (PARTITION BY type ORDER BY canonical_id) - 1 AS free FROM named_n n)
SELECT canonical_id AS key, type, canonical_text, {_SORTED} AS aliases, CAST(n_docs AS INT) AS n_docs, pseudonym FROM named_m JOIN docs_m USING (type, k)
UNION ALL SELECT type || '-' || CASE WHEN free < 10000 THEN lpad(CAST(free AS STRING), 4, '0') ELSE CAST(free AS STRING) END, type, canonical_text, {_SORTED}, CAST(n_docs AS INT), pseudonym FROM added JOIN docs_n USING (type, k)"""


@query(_UPSERT)
def memory_upsert(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    known = _memory(letters, documents=True)
    named, _, edges = memory.mapped(settle(_letter_spans(letters), "spans"), known)
    return memory.upsert(known, resolve.with_documents(named, edges)).select("key", "type", "canonical_text", F.array_join("aliases", "|").alias("aliases"), F.size("doc_ids").alias("n_docs"), "pseudonym")


_KIND = "CASE WHEN p_partkey % 2 = 0 THEN 'ORG' ELSE 'PERSON' END"
_NUMBERED = "CASE WHEN {n} < 10000 THEN lpad(CAST({n} AS STRING), 4, '0') ELSE CAST({n} AS STRING) END"
#: A memory whose numbers have gaps and whose canonical texts come twice, and new entities of which most are known by theirs.
_GAPS_OLD = f"""SELECT type || '-' || {_NUMBERED.format(n='n')} AS key, type, n, text AS canonical_text FROM (
  SELECT {_KIND} AS type, p_partkey AS n, 'part ' || CAST(p_partkey AS STRING) AS text FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT {_KIND}, p_partkey + 30000, 'part ' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey % 7 = 0) x"""
_GAPS_NEW = f"SELECT {_KIND} AS type, {_KIND} || '-' || lpad(CAST(p_partkey AS STRING), 6, '0') AS canonical_id, 'part ' || CAST(p_partkey AS STRING) AS canonical_text, 'alias ' || CAST(p_partkey AS STRING) AS alias FROM part WHERE p_partkey % 5 = 0"


@query(f"""WITH old AS ({_GAPS_OLD}), new AS ({_GAPS_NEW}), firsts AS (SELECT type, canonical_text, min(key) AS key FROM old GROUP BY ALL),
kept AS (SELECT o.key, o.type, o.canonical_text, CASE WHEN n.alias IS NULL THEN 'old ' || o.key ELSE n.alias || '|old ' || o.key END AS aliases, 'P' || o.key AS pseudonym
  FROM old o LEFT JOIN firsts f ON f.key = o.key LEFT JOIN new n ON n.type = f.type AND n.canonical_text = f.canonical_text),
free AS (SELECT type, k, row_number() OVER (PARTITION BY type ORDER BY k) AS place FROM (SELECT DISTINCT type FROM new) t, (SELECT unnest(range(0, 60000)) AS k) r WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.type = t.type AND o.n = r.k)),
fresh AS (SELECT n.*, row_number() OVER (PARTITION BY n.type ORDER BY n.canonical_id) AS place FROM new n LEFT JOIN firsts f USING (type, canonical_text) WHERE f.key IS NULL)
SELECT key, type, canonical_text, aliases, pseudonym FROM kept
UNION ALL SELECT type || '-' || {_NUMBERED.format(n='k')}, type, canonical_text, alias, 'N' || canonical_id FROM fresh JOIN free USING (type, place)""")
def memory_upsert_gaps(spark, sf_dir):
    """Merges by known canonical texts, under the first of two keys, and the smallest free numbers of a memory with gaps."""
    part = table(spark, sf_dir, "part")
    old = spark.sql(_GAPS_OLD.replace("FROM part", "FROM {part}"), part=part)
    known = old.select("key", F.col("key").alias("canonical_id"), "type", "canonical_text", F.array(F.concat(F.lit("old "), "key")).alias("aliases"), F.concat(F.lit("P"), "key").alias("pseudonym"))
    named = spark.sql(_GAPS_NEW.replace("FROM part", "FROM {part}"), part=part).withColumns({"aliases": F.array("alias"), "pseudonym": F.concat(F.lit("N"), "canonical_id")})
    return memory.upsert(settle(known, "memory"), named).select("key", "type", "canonical_text", F.array_join("aliases", "|").alias("aliases"), "pseudonym")


# --- resolution and pseudonyms ---------------------------------------------------------------------------------------
@query(rf"WITH {_LETTERS}, {_found('letters', _SQL_SCAN)} SELECT DISTINCT type, text AS surface, {_KEY} AS norm FROM found WHERE type IN ('EMAIL', 'PHONE', 'NI_NUMBER', 'CREDIT_CARD', 'IBAN')")
def normalize_structured(spark, sf_dir):
    rows = detect.detect_patterns(corpus.letters(spark, sf_dir)).where("type IN ('EMAIL', 'PHONE', 'NI_NUMBER', 'CREDIT_CARD', 'IBAN')")
    return rows.select("type", F.col("text").alias("surface"), text.norm_structured(F.col("type"), F.col("text")).alias("norm")).distinct()


@query(rf"WITH {_LETTERS}, {_found('letters', _SQL_SCAN)} SELECT DISTINCT type, text AS surface, {_KEY} AS norm FROM found WHERE type IN ('ADDRESS', 'DOB')")
def normalize_basic(spark, sf_dir):
    rows = detect.detect_patterns(corpus.letters(spark, sf_dir)).where("type IN ('ADDRESS', 'DOB')")
    return rows.select("type", F.col("text").alias("surface"), text.norm_basic(F.col("text")).alias("norm")).distinct()


@query(f"WITH {_LETTERS} SELECT DISTINCT person, lower(last_name) AS last, lower(CASE WHEN person LIKE '%. %' THEN left(first_name, 1) ELSE first_name END) AS first FROM letters")
def person_signature(spark, sf_dir):
    p = F.col("person")
    return corpus.letters(spark, sf_dir).select("person", text.person_last(p).alias("last"), text.person_first(p).alias("first")).distinct()


@query(f"WITH {_LETTERS} SELECT DISTINCT org, lower(split_part(org, ' ', 1)) AS core FROM letters")
def org_core(spark, sf_dir):
    return corpus.letters(spark, sf_dir).select("org", text.org_core(F.col("org")).alias("core")).distinct()


def _resolved(kinds: str):
    sql = f"{_RUN} SELECT canonical_id, canonical_text, aliases, CAST(n_spans AS BIGINT) AS n_spans FROM named WHERE type IN ({kinds})"

    def f(spark, sf_dir):
        found = _letter_run(spark, sf_dir)[1].entities.where(f"type IN ({kinds})")
        return found.select("canonical_id", "canonical_text", F.array_join("aliases", "|").alias("aliases"), "n_spans")

    return sql, f


for _name, _kinds in (("resolve_structured", "'EMAIL', 'PHONE', 'NI_NUMBER', 'CREDIT_CARD', 'IBAN', 'DOB', 'ADDRESS', 'OTHER'"), ("resolve_org", "'ORG'"), ("resolve_person", "'PERSON'")):
    _sql, _f = _resolved(_kinds)
    _f.__name__ = _name
    query(_sql)(_f)


@query(f"{_RUN} SELECT canonical_id, pseudonym FROM named")
def assign_pseudonyms(spark, sf_dir):
    return _letter_run(spark, sf_dir)[1].entities.select("canonical_id", "pseudonym")


@query(f"{_RUN} SELECT canonical_id, canonical_text FROM named")
def canonical_text(spark, sf_dir):
    return _letter_run(spark, sf_dir)[1].entities.select("canonical_id", "canonical_text")


@query(f"{_RUN} SELECT n.canonical_id, k2.doc_id, n.pseudonym FROM (SELECT DISTINCT doc_id, type, k FROM keyed) k2 JOIN named n USING (type, k)")
def entity_doc_edges(spark, sf_dir):
    result = _letter_run(spark, sf_dir)[1]
    return result.edges.join(result.entities.select("canonical_id", "pseudonym"), "canonical_id")


@query(f"{_RUN} SELECT surface, pseudonym, canonical_id FROM smap")
def surface_map(spark, sf_dir):
    return _letter_run(spark, sf_dir)[1].surfaces.select("surface", "pseudonym", "canonical_id")


@query(f"SELECT c_custkey AS n, {_label('c_custkey')} AS label FROM customer")
def agent_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), text.letters(F.col("c_custkey")).alias("label"))


@query(f"{_RUN} SELECT k2.doc_id, n.canonical_id FROM (SELECT DISTINCT doc_id, type, k FROM keyed) k2 JOIN named n USING (type, k)")
def entity_docs(spark, sf_dir):
    return _letter_run(spark, sf_dir)[1].edges.select("doc_id", "canonical_id")


@query(f"{_RUN} SELECT (SELECT count(*) FROM named) AS entities, (SELECT count(DISTINCT pseudonym) FROM named) AS pseudonyms, count(*) AS surfaces, count(*) FILTER (n > 1) AS shared FROM (SELECT text, count(DISTINCT type || k) AS n FROM surf GROUP BY text) x")
def cross_doc_consistency(spark, sf_dir):
    return quality.consistency(_letter_run(spark, sf_dir)[1].entities)


@query(f"{_RUN}, docs AS (SELECT type, k, string_agg(CAST(doc_id AS STRING), ', ' ORDER BY p) AS d FROM (SELECT type, k, doc_id, min(pos) AS p FROM keyed GROUP BY ALL) z GROUP BY type, k) SELECT canonical_id, pseudonym, canonical_text || ' is a ' || type || ' known as ' || pseudonym || ' (aliases: ' || replace(aliases, '|', ', ') || '; documents: ' || d || ').' AS statement FROM named JOIN docs USING (type, k)")
def entity_statements(spark, sf_dir):
    return pseudonyms.statements(_letter_run(spark, sf_dir)[1].exported).select("canonical_id", "pseudonym", "statement")


@query(f"{_WITH}, {_greedy('every', _REGION)} SELECT doc_id, 'Document ' || CAST(doc_id AS STRING) || chr(10) || string_agg('- ' || type || ': ' || text, chr(10) ORDER BY s, ord) AS payload, count(*) AS n_spans, CAST(doc_id AS STRING) AS node FROM kept GROUP BY doc_id")
def graph_payloads(spark, sf_dir):
    return pseudonyms.payloads(spans.dedup_by_region(_letter_spans(corpus.letters(spark, sf_dir)))).select("doc_id", "payload", "n_spans", F.col("node_set")[0].alias("node"))


@query(f"{_WITH}, {_greedy('every', _REGION)} SELECT doc_id, count(*) FILTER (source = 'regex') AS regex, count(*) FILTER (source = 'memory') AS memory, count(*) FILTER (source = 'llm') AS llm FROM kept GROUP BY doc_id")
def source_counts(spark, sf_dir):
    return quality.source_counts(spans.dedup_by_region(_letter_spans(corpus.letters(spark, sf_dir))))


@query(f"WITH {_LETTERS}, {_MODEL}, {_MEMORY}, {_entities('model_even')} SELECT DISTINCT l.doc_id, n.canonical_id FROM letters l JOIN surf s ON contains(l.text, s.text) JOIN named n USING (type, k)")
def entity_scope(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    known = _memory(letters)
    return memory.scope(known, _model_spans(letters).where("doc_id % 2 = 0 AND type IN ('PERSON', 'ORG')"), letters)


# --- rewriting -------------------------------------------------------------------------------------------------------
@query(f"WITH RECURSIVE {_found('documents', _SQL_SCAN)}, {_greedy('found', _REGION)}, {_entities('kept')}, {_redacted('documents', 'kept')} SELECT doc_id, redacted, replacements FROM redacted")
def redact_text(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"{_RUN}, {_redacted('letters', 'kept')} SELECT doc_id, redacted, replacements FROM redacted")
def redact_letters(spark, sf_dir):
    return _letter_run(spark, sf_dir)[1].redacted.select("doc_id", "redacted", "replacements")


@query(f"{_RUN}, {_redacted('letters', 'kept')} SELECT CAST(sum(replacements) AS BIGINT) AS total FROM redacted")
def replacement_counts(spark, sf_dir):
    return _letter_run(spark, sf_dir)[1].redacted.agg(F.sum("replacements").alias("total"))


@query(f"{_RUN}, {_redacted('letters', 'kept')} SELECT count(*) AS leaked FROM (SELECT DISTINCT k.doc_id, k.text FROM kept k JOIN redacted r ON k.doc_id = r.doc_id WHERE contains(r.redacted, k.text)) x")
def leak_check(spark, sf_dir):
    _, result = _letter_run(spark, sf_dir)
    return redact.leaks(result.redacted, result.spans).agg(F.count(F.lit(1)).alias("leaked"))


@query(f"{_WITH}, {_greedy('every', _REGION)}, gold AS (SELECT * FROM model UNION ALL SELECT * FROM found WHERE type IN ('EMAIL', 'PHONE')) SELECT coalesce(a.type, b.type) AS type, count(*) FILTER (a.type IS NOT NULL AND b.type IS NOT NULL) AS hits, count(a.type) AS found, count(b.type) AS gold FROM (SELECT DISTINCT doc_id, type, s, e FROM kept) a FULL JOIN (SELECT DISTINCT doc_id, type, s, e FROM gold) b ON a.doc_id = b.doc_id AND a.type = b.type AND a.s = b.s AND a.e = b.e GROUP BY ALL")
def precision_recall(spark, sf_dir):
    letters = corpus.letters(spark, sf_dir)
    every = _letter_spans(letters)
    gold = _model_spans(letters).unionByName(detect.detect_patterns(letters).select(*_COLUMNS).where("type IN ('EMAIL', 'PHONE')"))
    return quality.precision_recall(spans.dedup_by_region(every), gold)


# --- chunks ----------------------------------------------------------------------------------------------------------
_PARAS = "paras AS (SELECT doc_id, idx, ps[idx + 1] AS text, CAST(coalesce(list_sum([length(x) + 2 for x in ps[1:idx]]), 0) AS BIGINT) AS s FROM (SELECT doc_id, ps, unnest(range(0, len(ps))) AS idx FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM letters) a) b)"
# overlap: every paragraph's last or first sentence is what a fifth of its words is led back (on) to, except where that fifth reaches over more
_CHUNKS = f"""{_PARAS}, parts AS (SELECT doc_id, idx, text, s, s + length(text) AS e, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss, string_split(text, ' ') AS ws, greatest(1, CAST(ceil(len(string_split(text, ' ')) * 0.2::DOUBLE) AS BIGINT)) AS k FROM paras),
edges AS (SELECT *, s + length(text) - list_sum([length(x) + 1 for x in ws[len(ws) - k + 1:]]) + 1 AS tail_at, s + list_sum([length(x) + 1 for x in ws[1:k]]) - 1 AS head_at,
  list_transform(range(1, len(ss) + 1), lambda i: s + coalesce(list_sum([length(x) + 1 for x in ss[1:i - 1]]), 0)) AS sa, list_transform(range(1, len(ss) + 1), lambda i: s + list_sum([length(x) + 1 for x in ss[1:i]]) - 1) AS se FROM parts),
snaps AS (SELECT *, list_max(list_filter(sa, lambda x: x <= tail_at)) AS tail, list_min(list_filter(se, lambda x: x >= head_at)) AS head FROM edges),
chunks AS (SELECT doc_id, idx, CAST(coalesce(lag(tail) OVER w, s) AS BIGINT) AS a, CAST(coalesce(lead(head) OVER w, e) AS BIGINT) AS b FROM snaps WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""


@query(f"WITH {_LETTERS}, {_PARAS} SELECT doc_id, idx, s AS char_start, s + length(text) AS char_end, text FROM paras")
def chunk_paragraphs(spark, sf_dir):
    rows = chunking.paragraphs(_pages(spark, sf_dir))
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), "text")


def _pages(spark, sf_dir):
    return corpus.letters(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), "text")


@query(f"WITH {_LETTERS}, {_CHUNKS} SELECT doc_id, idx, a AS char_start, b AS char_end, substr(text, CAST(a + 1 AS INT), CAST(b - a AS INT)) AS text FROM chunks JOIN letters USING (doc_id)")
def chunk_overlap(spark, sf_dir):
    return chunking.chunk(_pages(spark, sf_dir)).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "char_start", "char_end", "text")


@query(f"WITH {_LETTERS}, {_CHUNKS} SELECT doc_id, idx FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM chunks WHERE b - a > 30) x WHERE rn <= 3")
def chunk_gate_top3(spark, sf_dir):
    return chunking.gate(chunking.chunk(_pages(spark, sf_dir))).select("doc_id", F.col("idx").cast("bigint").alias("idx"))


@query(f"WITH {_LETTERS}, {_WORDS}, {_PLACED}, pages AS (SELECT doc_id, string_agg(sep || word, '' ORDER BY cs) AS text FROM placed GROUP BY doc_id), {_CHUNKS.replace('FROM letters', 'FROM pages')} SELECT CAST(c.doc_id AS STRING) || '_p1_c' || CAST(idx AS STRING) AS chunk_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM chunks c LEFT JOIN placed p ON c.doc_id = p.doc_id AND cs >= a AND ce <= b GROUP BY c.doc_id, idx")
def chunk_bbox(spark, sf_dir):
    words = _words(corpus.letters(spark, sf_dir))
    pages = chunking.page_texts(words.drop("char_start", "char_end", "sep"))
    return chunking.chunk_boxes(chunking.chunk(pages), words)


# --- models ----------------------------------------------------------------------------------------------------------
def _answers(letters: DataFrame) -> DataFrame:
    """A stand-in model: fenced, wrapped or bare JSON by document."""
    item = F.format_string('[{"type": "person", "text": "%s", "char_start": "%s"}, {"type": "widget", "text": "%s"}]', "person", F.col("doc_id").cast("string"), "org")
    k = F.col("doc_id") % 3
    fence = F.lit("```")
    answer = F.when(k == 0, F.concat(fence, F.lit("json\n"), item, F.lit("\n"), fence)).when(k == 1, F.concat(F.lit('{"results": '), item, F.lit("}"))).otherwise(F.concat(F.lit("Found: "), item, F.lit(" as asked")))
    return letters.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.lit(0).cast("bigint").alias("char_start"), answer.alias("answer"))


@query(f"WITH {_LETTERS} SELECT doc_id, 'PERSON' AS type, person AS surface, doc_id AS char_start FROM letters UNION ALL SELECT doc_id, 'OTHER', org, 0 FROM letters")
def llm_parse(spark, sf_dir):
    rows = _answers(corpus.letters(spark, sf_dir)).select("doc_id", F.explode(detect.parse_answer(F.col("answer"))).alias("a"))
    return rows.select("doc_id", "a.type", F.col("a.text").alias("surface"), "a.char_start")


@query(f"WITH {_LETTERS} SELECT doc_id, 'PERSON' AS type, person AS surface, CAST(strpos(text, person) - 1 AS BIGINT) AS char_start, CAST(strpos(text, person) - 1 + length(person) AS BIGINT) AS char_end FROM letters UNION ALL SELECT doc_id, 'OTHER', org, strpos(text, org) - 1, strpos(text, org) - 1 + length(org) FROM letters")
def llm_offset_repair(spark, sf_dir):
    return _out(detect.spans_from_answers(_answers(corpus.letters(spark, sf_dir))))


_UNSEEN = "unseen AS (SELECT DISTINCT doc_id FROM every WHERE text NOT IN (SELECT text FROM every WHERE doc_id % 4 = 0))"


@query(f"""{_WITH}, {_UNSEEN}, {_CHUNKS},
shown AS (SELECT doc_id, a, substr(l.text, CAST(a + 1 AS INT), CAST(b - a AS INT)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM chunks WHERE b - a > 30) x JOIN letters l USING (doc_id) WHERE rn <= 3 AND doc_id IN (SELECT doc_id FROM unseen))
SELECT doc_id, 'ORG' AS type, left(text, 5) AS surface, a AS char_start, a + 5 AS char_end, (SELECT count(DISTINCT text) FROM shown) AS calls FROM shown""")
def model_answers(spark, sf_dir):
    """A model beside a memory of every fourth letter: letters without an unknown span are not shown to it, and each distinct
    chunk of the others is one call. The stand-in calls the first five characters an organisation."""
    letters = corpus.letters(spark, sf_dir)
    found = settle(_letter_spans(letters), "spans")
    quarter = found.where("doc_id % 4 = 0")
    known = pseudonyms.assign(resolve.entities(quarter)).withColumn("key", F.col("canonical_id"))
    model = lambda texts: [json.dumps([{"type": "ORG", "text": t[:5]}]) for t in texts]
    store = fresh_path(spark, "answers")
    spans_ = pipeline.model_spans(_pages(spark, sf_dir), found, known, model, store)
    calls = detect.answers_of(spark, store).agg(F.count(F.lit(1)).alias("calls"))
    return _out(spans_).join(F.broadcast(calls))  # one row


# --- images, vectors, streams ----------------------------------------------------------------------------------------
@query("SELECT image_id, x AS x0, y AS y0, x + w AS x1, y + h AS y1, CASE WHEN w / greatest(h, 1) BETWEEN 1.5 AND 1.8 THEN 'ID' ELSE 'SIGNATURE' END AS label FROM (SELECT p_partkey AS image_id, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey % 40 AS DOUBLE) AS y, CAST(p_size * 4 AS DOUBLE) AS w, CAST(20 + p_partkey % 60 AS DOUBLE) AS h FROM part) c WHERE w * h >= 500 AND w >= 20 AND h >= 20 AND (w / greatest(h, 1) BETWEEN 1.5 AND 1.8 OR w / greatest(h, 1) BETWEEN 2.5 AND 3.5)")
def region_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 50).cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"), (F.col("p_size") * 4).cast("double").alias("w"), (F.lit(20) + F.col("p_partkey") % 60).cast("double").alias("h"))
    return vision.shape_regions(c.withColumn("area", F.col("w") * F.col("h"))).drop("confidence")


_QUERY_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


@query(f"SELECT vec_id, round(sim, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])) AS sim FROM embeddings) x ORDER BY sim DESC, vec_id LIMIT 10")
def embedding_recall_topk(spark, sf_dir):
    return vision.similar_vectors(table(spark, sf_dir, "embeddings"), _QUERY_VECTOR, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id, round(sim, 6) AS similarity FROM s QUALIFY rank <= 10""")
def embedding_index_search(spark, sf_dir):
    """Queries are the rows whose id is divisible by 100, against all rows, through the index."""
    vectors = table(spark, sf_dir, "embeddings")
    found = vector_index.search(vector_index.build(vectors), vectors.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH RECURSIVE {_LETTERS}, {_found('letters', _SQL_SCAN)}, {_greedy('found', _REGION)}, {_entities('kept')}, {_redacted('letters', 'kept')} SELECT doc_id, redacted, replacements FROM redacted")
def streaming_memory(spark, sf_dir):
    """Letters arrive as six files, in their order, each a batch of its own; the rewritten texts of all batches are those of
    one run over all letters, from 10,000 entities of a type on but for their numbers, which follow the batches."""
    from ..streaming import memory_stream

    root = os.path.join(shared_dir(spark), "spanweave", f"stream-{uuid.uuid4().hex}")
    letters = corpus.letters(spark, sf_dir).select("doc_id", "text")
    bounds = letters.agg(F.min("doc_id"), F.max("doc_id") + 1).first()
    for k in range(6):
        low, high = ((bounds[1] - bounds[0]) * (k + i) // 6 + bounds[0] for i in (0, 1))
        letters.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    memory_stream.drain(memory_stream.start(spark, memory_stream.documents(spark, f"{root}/in", 1), root))
    return spark.read.parquet(f"{root}/redacted").select("doc_id", "redacted", "replacements")


# --- files, sinks and images over made rows ----------------------------------------------------------------------------
@query(f"WITH {_LETTERS} SELECT 1 AS page_no, doc_id, length(text) AS n_chars, left(text, 60) AS preview FROM letters")
def page_previews(spark, sf_dir):
    return files.preview(_pages(spark, sf_dir), 60).withColumn("n_chars", F.col("n_chars").cast("bigint"))


@query(f"{_RUN}, {_WORDS}, {_PLACED}, boxed AS (SELECT k.doc_id, page_no, k.type, k.s, k.e, k.text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM kept k JOIN placed p ON k.doc_id = p.doc_id AND p.cs < k.e AND k.s < p.ce GROUP BY ALL) SELECT doc_id, page_no, x0, y0, x1, y1, pseudonym AS label FROM boxed JOIN smap ON text = surface")
def rectangles_to_print(spark, sf_dir):
    """Words stand where their letter has them, as a page of words would be laid out."""
    letters, result = _letter_run(spark, sf_dir)
    return redact.rectangles_to_print(result.spans, _words(letters), result.surfaces)


@query(f"{_RUN} SELECT DISTINCT text AS surface FROM kept WHERE text NOT IN (SELECT surface FROM smap WHERE canonical_id LIKE 'E%')")
def unmapped_surfaces(spark, sf_dir):
    _, result = _letter_run(spark, sf_dir)
    return redact.unmapped(result.spans, result.surfaces.where("canonical_id LIKE 'E%'"))


@query(f"{_RUN}, mentions AS (SELECT DISTINCT CAST(doc_id % 8 AS STRING) AS group_id, doc_id, person AS text FROM letters), own AS (SELECT DISTINCT doc_id, text, canonical_id FROM kept JOIN smap ON text = surface) SELECT group_id, count(*) AS members, count(DISTINCT coalesce(canonical_id, '?#' || CAST(doc_id AS STRING) || '#' || text)) AS entities FROM mentions LEFT JOIN own USING (doc_id, text) GROUP BY group_id")
def gold_groups(spark, sf_dir):
    letters, result = _letter_run(spark, sf_dir)
    groups = letters.select((F.col("doc_id") % 8).cast("string").alias("group_id"), "doc_id", F.col("person").alias("text"))
    found = result.spans.join(result.surfaces.select(F.col("surface").alias("text"), "canonical_id"), "text")
    return quality.one_entity(groups, found).drop("same")


@query("SELECT p_partkey AS image_id, source, count(*) AS n FROM (SELECT p_partkey, 'faces' AS source FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'text' FROM part UNION ALL SELECT p_partkey, 'text' FROM part WHERE p_partkey % 3 = 0) x GROUP BY ALL")
def detector_union(spark, sf_dir):
    """Made images whose grey value is their number; two stand-in detectors look at it."""
    made = dealt(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("image_id"), F.concat(F.encode(F.lit("P5\n4 4\n255\n"), "utf-8"), F.unhex(F.repeat(F.lpad(F.hex(F.col("p_partkey") % 6), 2, "0"), 16))).alias("content"))
    faces = lambda image: [(0, 0, 2, 2, "FACE", 0.75)] if image[0, 0, 0] % 2 == 0 else []
    words = lambda image: [(0, 0, 4, 1, "TEXT_PII", 0.5)] * (2 if image[0, 0, 0] % 3 == 0 else 1)
    found = vision.detect_regions(made, {"faces": faces, "text": words})
    return found.groupBy(F.col("image_id").cast("bigint").alias("image_id"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS image_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_regions, CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE 0 END AS changed FROM part")
def redacted_images(spark, sf_dir):
    """Made images, two pixels high, one row of 0 and one of 14: the blurred box of even ones is 7 throughout."""
    head = F.encode(F.lit("P5\n8 2\n255\n"), "utf-8")
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("image_id"), F.concat(head, F.unhex(F.lit("00" * 8 + "0E" * 8))).alias("content"))
    boxes = made.where("CAST(image_id AS BIGINT) % 2 = 0").selectExpr("image_id", "0D AS x0", "0D AS y0", "8D AS x1", "2D AS y1")
    out = vision.redact_images(made, boxes)
    first = F.conv(F.hex(F.substring("content", 12, 1)), 16, 10).cast("int")
    return out.select(F.col("image_id").cast("bigint").alias("image_id"), "n_regions", first.alias("changed"))


@query("""SELECT image_id, 9.0::DOUBLE AS x0, 9.0::DOUBLE AS y0, 10.0 + w AS x1, 10.0 + h AS y1, CASE WHEN (w + 1) / (h + 1) BETWEEN 1.5 AND 1.8 THEN 'ID' ELSE 'SIGNATURE' END AS label
FROM (SELECT p_partkey AS image_id, CAST(p_size * 2 + 30 AS DOUBLE) AS w, CAST(p_partkey % 40 + 30 AS DOUBLE) AS h FROM part) x WHERE (w + 1) / (h + 1) BETWEEN 1.5 AND 1.8 OR (w + 1) / (h + 1) BETWEEN 2.5 AND 3.5""")
def contour_regions(spark, sf_dir):
    """Images drawn from rows: a card of the row's size ten pixels from the edges, for even rows with a panel on it, whose
    contour lies inside the card's. An edge between two pixels counts for the one before, so a contour is a pixel larger."""
    p = dealt(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 2 + 30).alias("w"), (F.col("p_partkey") % 40 + 30).cast("int").alias("h"))
    fill = lambda value, n: F.repeat(F.lit(value), n)
    wide, card = fill("00", F.col("w") + 20), F.concat(fill("00", F.lit(10)), fill("C8", F.col("w")), fill("00", F.lit(10)))
    panel = F.concat(fill("00", F.lit(10)), fill("C8", F.lit(10)), fill("32", F.col("w") - 20), fill("C8", F.lit(10)), fill("00", F.lit(10)))
    inner = F.when(F.col("image_id") % 2 == 0, panel).otherwise(card)
    rows = F.concat(F.repeat(wide, F.lit(10)), F.repeat(card, F.lit(10)), F.repeat(inner, F.col("h") - 20), F.repeat(card, F.lit(10)), F.repeat(wide, F.lit(10)))
    head = F.format_string("P5\n%d %d\n255\n", F.col("w") + 20, F.col("h") + 20)
    images = p.select(F.col("image_id").cast("string").alias("image_id"), F.concat(F.encode(head, "utf-8"), F.unhex(rows)).alias("content"))
    return vision.shape_regions(vision.image_contours(images)).drop("confidence").withColumn("image_id", F.col("image_id").cast("long"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
