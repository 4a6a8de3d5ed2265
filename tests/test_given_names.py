"""Given names of one last name against the plain rule, and a last name with very many of them."""

import random
import time

from pyspark.sql import functions as F

from spanweave.operators import resolve


def plain(names):
    """Labels of names in order: the earliest compatible cluster takes a name and keeps the longer."""
    held, out = [], {}
    for n in names:
        at = next((i for i, s in enumerate(held) if s == "" or n == "" or s.startswith(n) or n.startswith(s)), None)
        if at is None:
            held.append(n)
            at = len(held) - 1
        elif len(n) > len(held[at]):
            held[at] = n
        out[n] = at
    return out


def parts(labels):
    found = {}
    for n, c in labels.items():
        found.setdefault(c, set()).add(n)
    return sorted(map(sorted, found.values()))


def test_against_the_plain_rule(spark):
    r = random.Random(8)
    orders = {}
    for k in range(60):
        pool = list({"".join(r.choice("ab" if k % 2 else "abc") for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(1, 40))})
        r.shuffle(pool)
        orders[f"last{k}"] = pool
    orders["only"] = [""]
    orders["astral"] = ["", "😀é", "😀", "é", "éa"]
    rows = [(key, n, (f"d{i:04d}", 0, i)) for key, names in orders.items() for i, n in enumerate(names)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, first string, pos struct<doc_id:string,ord:long,start:long>").repartition(4)
    got = {}
    for x in resolve._fold_first_names(df).collect():
        got.setdefault(x.key, {})[x.first] = x.cluster
    assert got.keys() == orders.keys()
    for key, names in orders.items():
        assert parts(got[key]) == parts(plain(names)), key


def test_a_last_name_with_200000_given_names(spark):
    """The plain rule compares each name with every cluster; here each costs its own length."""
    n = 200_000
    first = F.concat(F.element_at(F.array(*map(F.lit, "abcdefgh")), (F.col("id") % 8 + 1).cast("int")), F.lower(F.hex(F.xxhash64("id"))))
    rows = spark.range(n).select(F.lit("smith").alias("key"), first.alias("first"), F.struct(F.col("id").cast("string").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.col("id").alias("start")).alias("pos"))
    began = time.time()
    out = resolve._fold_first_names(rows).agg(F.count(F.lit(1)), F.count_distinct("cluster")).first()
    assert tuple(out) == (n, n) and time.time() - began < 120
