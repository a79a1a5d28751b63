import random

import numpy as np

from quernel.llm import quality
from quernel.llm.ngrams import word_ngrams
from quernel.llm.quality import op9_quality
from tests.llm.fixtures import DOCS, documents, text

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = text(rng, ["en", "de", "fr", "es"][i % 3], rng.randint(15, 80))
        if bad:
            body = rng.choice([body.upper().replace(" ", "!! "), body.replace(" ", " | "), " ".join(w + " " + w + " " + w for w in body.split())])
        rows.append((i, body, "en", "s", len(body)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in op9_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    right = [got[i].predicted == q for i, q, _ in labels if got[i].held_out]
    assert len(right) > 60 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_odd_rows_and_labels(spark):
    rows = documents(60)
    labels = [(i, i % 2, 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (2, None, 0), (9999, 1, 0)]
    out = op9_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    empty = {r.doc_id: r.score for r in out if r.doc_id in (60, 61)}
    assert empty[60] == empty[61] and 0 <= empty[60] <= 1


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame(documents(5), DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in op9_quality(docs, none).collect()} == {0.5}
    assert op9_quality(spark.createDataFrame([], DOCS), none).collect() == []


def test_ngrams_are_of_words_and_shapes():
    one = word_ngrams(b"the cat", 18)
    assert len(one) == 2 + 2 + 1 + 1
    assert set(word_ngrams(b"the  cat", 18).tolist()) == set(one.tolist())
    upper = word_ngrams(b"THE CAT", 18)
    assert set(upper.tolist()) & set(one.tolist()) and set(upper.tolist()) != set(one.tolist())
    assert len(word_ngrams(b"", 18)) == len(word_ngrams(b" \n", 18)) == 0


def test_updates_are_follow_the_regularised_leader():
    model = quality.Ftrl(4)
    at, value = np.array([0, 4]), np.array([1.0, 1.0])
    for _ in range(200):
        model.learn(at, value, 1)
        model.learn(np.array([1, 4]), value, 0)
    weights = model.weights(slice(None))
    assert weights[0] > 0.5 and weights[1] < -0.5 and weights[2] == weights[3] == 0


def test_an_id_that_very_many_rows_share_is_learned_from_once(spark):
    rows, labels = corpus(80)
    hot = spark.range(100_000).selectExpr("3L AS doc_id", "concat('the hot text ', id % 5) AS text")
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    known = spark.createDataFrame(labels, LABELS)
    one = docs.where("doc_id <> 3").union(spark.createDataFrame([(3, "the hot text 1")], "doc_id long, text string"))
    many = quality.fit(docs.where("doc_id <> 3").union(hot), known)
    # the same as with one of those rows, whichever it is
    singles = [quality.fit(one.where("doc_id <> 3").union(hot.where(f"text = 'the hot text {i}'").limit(1)), known) for i in range(5)]
    assert any(np.array_equal(many, w) for w in singles)


def test_scores_are_what_the_weights_say(spark):
    rows, labels = corpus(120)
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    for r in quality.score_quality(docs, weights).collect():
        slots = word_ngrams((r.text or "").encode(), quality.FEATURE_BITS).tolist()
        margin = float(weights[-1]) + sum(float(weights[s]) for s in slots) * quality.SCALE / max(len(slots), 1)
        assert abs(r.quality_score - 1 / (1 + np.exp(-margin))) < 1e-5


def test_pieces_end_with_a_word():
    text = "ab cde\tf" * 9 + "x" * 60
    parts = list(quality._pieces(text, 10))
    assert "".join(parts) == text
    assert all(p[-1:].isspace() or n[:1].isspace() or len(p) == 20 for p, n in zip(parts, parts[1:]))


def test_clashing_columns(spark):
    rows, labels = corpus(40)
    docs = spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t, *_ in rows], "doc_id long, text string, quality_score double, label string, __id int")
    known = spark.createDataFrame([(i, q, "y") for i, q, _ in labels], "doc_id long, quality int, label string")
    out = quality.score_quality(docs, quality.fit(docs, known))
    assert out.columns == ["doc_id", "text", "label", "__id", "quality_score"] and out.count() == 40
