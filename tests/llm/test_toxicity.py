"""Label model and classifier on planted signals."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm.toxicity import fit_linear, fit_toxicity, held_out, label_model, score_toxicity


def planted(seed, n, first=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(first, first + n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(15, 150))]
        if toxic:
            for at in rng.sample(range(len(text)), max(2, len(text) // 30)):
                text[at] = rng.choice(["badword", "vileness", "Nasty!"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_scores_on_held_out_rows(spark, docs_of):
    docs, labels = planted(1, 900)
    known = labels + [(10_000, None), (None, 1), labels[0]]
    df = docs_of(docs + [(20_000, ""), (20_001, None), (None, "badword vileness")], score=0.5, counts="clash")
    model = fit_toxicity(df, spark.createDataFrame(known, "doc_id long, toxic int").withColumn("text", F.lit("clash")), least=15)
    assert {e.rstrip("$")[:4] for e in model.lexicon} >= {"badw", "vile", "nast"}
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(df, model).collect()}
    truth = dict(labels)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 100
    assert np.mean([(scored[i] >= 0.5) == truth[i] for i in out]) > 0.97
    assert scored[20_000] < 0.5 and scored[20_001] == scored[20_000] and scored[None] > 0.5
    assert all(0 <= s <= 1 for s in scored.values())


def test_held_out_labels_are_never_read(spark, docs_of):
    docs, labels = planted(2, 400)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    both = [fit_toxicity(docs_of(docs), spark.createDataFrame(x, "doc_id long, toxic int"), least=15) for x in (labels, flipped)]
    assert both[0].lexicon == both[1].lexicon and np.array_equal(both[0].weights, both[1].weights)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0), (3, 0)]])
def test_without_toxic_labels_nothing_is_toxic(spark, docs_of, labels):
    df = docs_of([(1, "a"), (2, None), (3, "b b")])
    model = fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r["score"] < 0.01 for r in score_toxicity(df, model).collect()] == [True] * 3
    assert score_toxicity(docs_of([]), model).count() == 0


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    right = [0.95, 0.8, 0.6]
    votes = [np.where(rng.random(4000) < p, np.where(y, 1, -1), np.where(y, -1, 1)) for p in right]
    given = np.column_stack([*votes, votes[2], votes[2]]).astype(np.int8)
    posterior, found = label_model(given, y)
    assert ((posterior >= 0.5) == y).mean() > 0.93
    assert np.abs(found["accuracy"][:3] - right).max() < 0.06
    assert found["correlation"][2, 3] > 0.9 and found["weight"][2] < 0.5 < found["weight"][0]


def test_linear_classifier_separates():
    rng = np.random.default_rng(6)
    x = np.column_stack((rng.normal(size=(500, 2)), np.ones(500)))
    target = (x[:, 0] - x[:, 1] > 0.3).astype(float)
    w = fit_linear(x, target, penalty=0.1)
    assert (((x @ w) > 0) == target).mean() > 0.97


def test_a_rare_kind_of_abuse_is_learnt(spark, docs_of):
    """Its markers stand in fewer than 2 % of the toxic rows each, and more entries pass than there are voters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common, rare = [f"{c}nasty" for c in "ijklmn"], [f"{c}scherzo" for c in "opqr"]
    docs, labels = [], []
    for i in range(3200):
        kind = common if i < 900 else rare if i < 960 else None
        text = [word() for _ in range(30)]
        if kind:
            text[3] = text[9] = kind[i % len(kind)]
        docs.append((i, " ".join(text)))
        labels.append((i, int(kind is not None)))
    df = docs_of(docs)
    model = fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), most_voters=4)
    assert len(model.lexicon) >= 10
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(df, model).collect()}
    held = [i for i in range(3200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scored[i] >= 0.5) == (i < 960) for i in held) and any(900 <= i < 960 for i in held)
