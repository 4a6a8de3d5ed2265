"""A derived corpus: one letter per customer, by the same SQL text in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import dealt

_FIRST = "John,Mary,Peter,Alan,Rita,Omar,Lucy,Tom"
_LAST = "Smith,Okafor,Walsh,Patel,Novak,Brown,Clarke,Davies,Evans,Foster,Green,Hughes,Irwin,Jones,King,Lewis,Moore,Nolan,Owens,Price,Quinn,Reed,Stone,Turner,Young"
_TOWN = "Leeds,Bristol,York,Bath,Derby"
_ORG = "Acme Corporation,ACME Corp,Globex Ltd,Globex Group"


def _pick(values: str, index: str) -> str:
    return f"split_part('{values}', ',', CAST(1 + {index} AS INT))"


def _pad(value: str, width: int) -> str:
    return f"lpad(CAST({value} AS STRING), {width}, '0')"


#: doc_id, first_name, last_name, person, org, text
LETTERS = f"""
SELECT doc_id, first_name, last_name, person, org, address,
  'Dear ' || person || ',' || chr(10) || chr(10)
  || 'We write on behalf of ' || org || '. Please reply to ' || lower(first_name) || '.' || lower(last_name) || '@mail' || CAST(doc_id % 7 AS STRING) || '.example.com or call 07'
  || {_pad("doc_id % 1000", 3)} || ' ' || {_pad("(doc_id * 7) % 1000", 3)} || ' ' || {_pad("(doc_id * 13) % 1000", 3)} || '. Is that in order?' || chr(10) || chr(10)
  || 'Our file has number AB' || {_pad("doc_id % 300", 6)} || 'C and account GB' || {_pad("doc_id % 90 + 10", 2)} || 'ABCD' || {_pad("doc_id * 37", 14)} || '. The card is 4' || {_pad("doc_id * 9973", 15)} || '.' || chr(10) || chr(10)
  || 'Born on 19' || {_pad("doc_id % 60 + 40", 2)} || '-' || {_pad("doc_id % 12 + 1", 2)} || '-' || {_pad("doc_id % 28 + 1", 2)} || ', living at ' || address || '. With kind regards.' AS text
FROM (
  SELECT doc_id, first_name, last_name, org, address,
    CASE doc_id % 3 WHEN 0 THEN first_name || ' ' || last_name WHEN 1 THEN substr(first_name, 1, 1) || '. ' || last_name ELSE last_name || ', ' || first_name END AS person
  FROM (
    SELECT c_custkey AS doc_id, {_pick(_FIRST, "c_custkey % 8")} AS first_name, {_pick(_LAST, "CAST(floor(c_custkey / 8.0) AS BIGINT) % 25")} AS last_name,
      {_pick(_ORG, "c_custkey % 4")} AS org,
      CAST(c_custkey % 200 + 1 AS STRING) || ' Elm Road, ' || {_pick(_TOWN, "c_custkey % 5")} || ', M' || CAST(c_custkey % 9 + 1 AS STRING) || ' ' || CAST(c_custkey % 9 AS STRING) || 'AB' AS address
    FROM customer
  ) a
) b
"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters, dealt out to all cores where the customers' files are fewer."""
    customers = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return spark.sql(LETTERS.replace("FROM customer", "FROM {customer}"), customer=customers)
