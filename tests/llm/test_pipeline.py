"""The pipeline's stages on a small table against plain Python, with nulls, repeated rows, clashing columns and an empty table."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import components, decontaminate, mixing, quality, scratch, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out, base = [], words(120)
    for i in range(60):
        text = words(80) if i % 3 else [w.upper() + "!!" for w in words(80)]
        out.append((i, " ".join(text), "en", f"s{i % 4}", 0))
    for i in range(100, 112):  # near copies
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        out.append((i, " ".join(copy), "en", "s1", 0))
    out += [(200, out[1][1] + " \n", "en", "s2", 0), (201, out[2][1].replace(" ", "\t"), None, None, 0), out[4], (300, None, "en", None, 0), (301, "", "en", "s1", 0), (None, " ".join(words(60)), "en", "s3", 0)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passage = " ".join(rows[7][1].split()[20:45])
    spark.createDataFrame([(1, passage.upper()), (2, None), (3, "never to be found anywhere in this")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_each_stage_does_its_whole_job(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard", "decontamination", "mix_sources"]

    kept = scratch.written(stages["quality_classifier"](spark, docs, folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    refused = Counter((r["doc_id"], r["key"]) for r in quality.quality(docs, labels).where("not accepted").collect())
    of = docs.withColumn("key", scratch.row_key("doc_id", "text")).collect()
    assert bag(kept) == Counter(tuple(r)[:-1] for r in of if (r["doc_id"], r["key"]) not in refused) and kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & set(range(0, 60, 3)) and {i for i in range(60) if i % 3} <= left

    whole = scratch.written(stages["exact_dedup"](spark, docs, folder))
    best = {}
    for r in rows:
        k = re.sub("[\x20\x09-\x0d]", "", r[1] or "")
        order = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if k not in best or order < best[k][0]:
            best[k] = (order, r)
    assert bag(whole) == Counter(r for _, r in best.values())

    near = scratch.written(stages["ngram_jaccard"](spark, whole, folder))
    assert {r["doc_id"] for r in near.collect()} == {r[0] for _, r in best.values()} - set(range(101, 112))

    clean = scratch.written(stages["decontamination"](spark, near, folder))
    assert {r["doc_id"] for r in near.collect()} - {r["doc_id"] for r in clean.collect()} == {rows[7][0]}

    mixed = stages["mix_sources"](spark, clean, folder)
    expected = {r["doc_id"]: r["taken"] for r in mixing.mix(clean).where("taken > 0").collect()}
    assert {r["doc_id"]: r["taken"] for r in mixed.where("taken > 0").collect()} == expected
    ran = corpus_pipeline.run(spark, folder)
    assert ran.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    again = {r["doc_id"] for r in ran.collect()}
    assert again and not again & (set(range(0, 60, 3)) | set(range(101, 112)) | {rows[7][0]})


def test_an_empty_table_stays_empty(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.written(stage(spark, docs, folder))
        assert docs.count() == 0


def test_columns_of_any_name_pass(spark, folder):
    names = ["size", "draw", "target", "key", "id", "sig", "row", "hash", "bucket", "_row", "_key", "low", "comp", "copies"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.written(stage(spark, docs, folder))
        assert all(r[c] == c for r in docs.select(*names).collect() for c in names), name
    assert {"mix_size", "mix_target", "mix_copies", "source_size", "taken"} <= set(docs.columns)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    of = lambda xs: spark.createDataFrame(xs, "a long, b long")
    for labels in (components.components(of(edges)), components.joined(components.components(of(edges[:90])), of(edges[90:]))):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r["comp"], set()).add(r["node"])
        expected = {}
        for n in parent:
            if any(n in e and e[0] != e[1] for e in edges):
                expected.setdefault(root(n), set()).add(n)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_token_counts_of_a_table(spark):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.5, "▁ab": -5.0, "▁a": -4.0}
    texts = [None, "", "ab ab", "ab ab", " ", "a" * 100_000, "x", "é ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n_tokens", "n_chars")})

    def brute(text):
        text = "▁" + text.replace(" ", "▁") if text else ""
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            found = [(best[s][0] + pieces[text[s:end]], s) for s in range(max(0, end - 3), end) if text[s:end] in pieces]
            if text[end - 1] not in pieces:
                found.append((best[end - 1][0] + min(pieces.values()) - 10, end - 1))
            top = max(x for x, _ in found)
            start = min(s for x, s in found if x == top)
            best[end] = (top, best[start][1] + 1)
        return best[-1][1]

    vocabulary = tokens.Vocabulary(pieces, False)
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, vocabulary=vocabulary).collect()}
    assert found == {i: brute(t or "") for i, t in enumerate(texts)}
    other = tokens.Vocabulary(pieces | {"ab": -4.5}, False)
    assert vocabulary.digest() != other.digest() and tokens.token_counts(docs.limit(0), vocabulary=other).count() == 0


def test_winnowing_keeps_few_grams(spark):
    import numpy as np

    hashes = np.random.default_rng(4).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    places, _ = decontaminate.selected(hashes, np.zeros(len(hashes), np.int64), decontaminate.SPAN)
    assert 0.25 < len(places) / len(hashes) < 0.33  # 2 / 7 expected
    assert np.diff(places).max() <= decontaminate.SPAN - decontaminate.GRAM + 1  # every run has one


def test_site_posteriors_are_the_closed_form(spark):
    sites = [("a", "x", 3, 0.9), ("a", "y", 1, 0.2), ("b", "x", 5, 0.5), (None, "x", 2, 0.7)]
    rows = [(i, "t " * (i + 1), p, h) for i, (h, p) in enumerate((h, p) for h, p, n, _ in sites for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (7, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality(docs, labels).collect()
    assert len(found) == len(rows)
    total = sum(r["classifier"] for r in found)
    hosts, paths = {}, {}
    for r in found:
        hosts.setdefault(r["host"], []).append(r["classifier"])
        paths.setdefault((r["host"], r["path"]), []).append(r["classifier"])
    top = min(1 - 1e-6, max(1e-6, total / len(found)))

    def strength(groups):  # (values, mean above) of each site
        between = sum(len(v) * (sum(v) / len(v) - p) ** 2 for v, p in groups)
        within = sum(p * (1 - p) for _, p in groups)
        spread = sum(len(v) * p * (1 - p) for v, p in groups)
        if not sum(len(v) - 1 for v, _ in groups) or not spread:
            return 10_000.0
        return min(10_000.0, max(1.0, 1 / max(1e-9, (between - within) / max(1e-9, spread - within)) - 1))

    k_host = strength([(v, top) for v in hosts.values()])
    mean = {h: (sum(v) + k_host * top) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength([(v, mean[h]) for (h, _), v in paths.items()])
    for r in found:
        p, h, w = r["classifier"], hosts[r["host"]], paths[r["host"], r["path"]]
        above = (sum(h) - p + k_host * top) / (len(h) - 1 + k_host)
        site = min(1 - 1e-6, max(1e-6, (sum(w) - p + k_path * above) / (len(w) - 1 + k_path)))
        assert abs(site - r["site"]) < 1e-6 and r["accepted"] == (r["quality"] >= quality.THRESHOLD)
