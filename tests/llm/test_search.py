"""Ranked search against a plain version, with few and many dictionaries and blocks."""

import math
import random
import re
from collections import Counter

import duckdb

from starloom.llm import search

RANDOM = random.Random(5)
SCHEMA, ITEMS = "doc_id long, text string, score long, item long, block int", "item_id string, text string, doc_id int"


def text(n, words=60):
    return " ".join(RANDOM.choice(("w%d", "W%d", "é%d,", "ß-%d")) % min(RANDOM.randrange(words), RANDOM.randrange(words)) for _ in range(n))


DOCS = [(i, text(RANDOM.randrange(1, 60)), 0, 0, 0) for i in range(300)]
DOCS += [(1000, None, 0, 0, 0), (1001, "", 0, 0, 0), (1002, " ,.-", 0, 0, 0), (None, DOCS[5][1], 0, 0, 0), (7, DOCS[7][1], 0, 0, 0), (7, DOCS[7][1], 0, 0, 0), (2000, text(20000), 0, 0, 0), (2001, DOCS[9][1].upper(), 0, 0, 0)]
DOCS += [(3000 + i, DOCS[11][1], 0, 0, 0) for i in range(30)]
NEEDS = [("a", DOCS[7][1], 1), ("b", text(30), 2), ("b", text(30), 3), ("c", DOCS[11][1] + " " + DOCS[11][1], 4), ("d", None, 5), ("e", "..", 6), ("f", "nowhere", 7), (None, "w1", 8), ("g", "w1 nowhere é2", 9)]


def terms(t):
    lower = (t or "").translate(str.maketrans(search.UPPER, search.LOWER))
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def plain(docs, items, k=10):
    held = [(d[0], terms(d[1])) for d in docs]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, t, *_ in items:
        scored = []
        for d, c, size in held:
            m = 25 + (75 * size * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in Counter(terms(t)).items() if c[w])
            scored += [(-s, d is None, d or 0, d)] * (s > 0)
        out += [(item, i + 1, x[3], -x[0], len(terms(t))) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_ranks_equal_the_plain_version_and_sql(spark):
    documents, benchmark = spark.createDataFrame(DOCS, SCHEMA).repartition(5), spark.createDataFrame(NEEDS, ITEMS)
    want = plain(DOCS, NEEDS)
    assert sorted(map(tuple, search.ranked(documents, benchmark).collect()), key=str) == want
    # several dictionaries, many blocks
    assert sorted(map(tuple, search.ranked(documents, benchmark, dictionary=25, cells=1).collect()), key=str) == want
    documents, benchmark = documents.toPandas(), benchmark.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    assert sorted(duckdb.sql(search.SQL).fetchall(), key=str) == want


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(DOCS[:5], SCHEMA)
    assert search.ranked(none, spark.createDataFrame(NEEDS, ITEMS)).collect() == []
    assert search.ranked(some, spark.createDataFrame([], ITEMS)).collect() == []
    assert search.ranked(some, spark.createDataFrame([("f", "nowhere", 1)], ITEMS)).collect() == []
