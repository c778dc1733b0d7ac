"""Fitted operators on small tables: accuracy, missing labels, empty tables."""

import random

import pytest

from starloom.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None, None, None, 0), (901, "", "en", "s", 0), (0, rows[0][1], "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_toxicity(made):
    docs, labels = made
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 243 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 900]
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)


def test_quality(made):
    docs, labels = made
    found = quality.quality(docs, labels).collect()
    assert len(found) == 243
    own = [r for r in found if r["doc_id"] < 900]
    assert sum(r["accepted"] == (r["doc_id"] % 3 != 0) for r in own) >= 0.95 * len(own)


def test_without_labels_or_rows(made):
    docs, labels = made
    for x, y in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        assert toxicity.toxicity(x, y).count() == quality.quality(x, y).count() == x.count()
