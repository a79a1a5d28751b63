import tracemalloc

import numpy as np

from quernel.llm import language_id
from quernel.llm.language_id import codewords, op3_language_id
from tests.llm.fixtures import DOCS, documents


def test_codewords_are_far_apart():
    for count in (1, 2, 4, 30):
        code = codewords(count)
        assert code.shape[0] == count and set(np.unique(code)) <= {-1.0, 1.0}
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert not apart or min(apart) >= (6 if count <= 4 else 3)


def test_decoding_corrects_wrong_bits():
    code = codewords(4)
    model = language_id.Model(["a", "b", "c", "d"], code, np.zeros((1, code.shape[1])))
    margins = code.copy()
    margins[:, :2] *= -0.5  # two weak errors
    best, score, unsure = model.decode(margins)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.5).all() and not unsure.any()
    _, score, unsure = model.decode(((code[0] + code[1]) / 2)[None])
    assert unsure[0] and score[0] <= 0.51


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents(400)
    got = {r.doc_id: r for r in op3_language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(op3_language_id(spark.createDataFrame(rows, DOCS)).collect()) == len(rows)
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows[:400] if got[i].held_out]
    assert len(right) > 40 and np.mean(right) >= 0.98
    for i in (400, 401, 402):
        assert got[i].lang_pred == "und" and got[i].score == 0 and not got[i].ambiguous
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labels_and_empty_table(spark):
    rows = [(1, "some text", None, "s", 1), (2, None, None, None, None)]
    assert {r.lang_pred for r in op3_language_id(spark.createDataFrame(rows, DOCS)).collect()} == {"und"}
    assert op3_language_id(spark.createDataFrame([], DOCS)).collect() == []


def test_other_columns_are_kept(spark):
    docs = spark.createDataFrame([(i, t, lang, s, n, "x") for i, t, lang, s, n in documents(40)], DOCS + ", lang_pred string")
    out = language_id.language_id(docs, language_id.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "lang_score", "lang_ambiguous"]
    assert out.count() == docs.count()


def test_an_id_that_very_many_rows_share_is_learned_from_once(spark, monkeypatch):
    rows = documents(60)
    hot = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('the hot text ', id % 7) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    same = spark.range(50_000).selectExpr("7L AS doc_id", "'der andere Text' AS text", "'de' AS lang", "'s' AS source", "1L AS n_chars")
    docs = spark.createDataFrame(rows, DOCS).union(hot).union(same)
    learned = []
    whole = language_id.features
    monkeypatch.setattr(language_id.np.linalg, "solve", lambda gram, y, solve=np.linalg.solve: learned.append(len(gram)) or solve(gram, y))
    model = language_id.fit(docs)
    assert whole is language_id.features and 40 < learned[0] <= 64 and model.languages == ["de", "en", "es", "fr"]


def test_scores_are_what_the_model_says(spark):
    """Every prediction again from the text alone: profile, margins, losses, the least."""
    docs = spark.createDataFrame(documents(80), DOCS)
    model = language_id.fit(docs)
    for r in language_id.language_id(docs, model).collect():
        profile = language_id.features(r.text)
        if profile is None:
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
            continue
        margins = [sum(float(a) * float(b) for a, b in zip(profile[profile > 0], w[profile > 0])) for w in model.weights.T]
        losses = [sum(np.log1p(np.exp(-language_id.SHARPNESS * m * c)) for m, c in zip(margins, code)) for code in model.code]
        assert r.lang_pred == model.languages[int(np.argmin(losses))]
        assert abs(r.lang_score - 1 / sum(np.exp(min(losses) - x) for x in losses)) < 1e-9


def test_pieces_of_a_very_long_text(monkeypatch):
    text = "the rain in Spain stays mainly in the plain " * 50
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "_PIECE", 97)
    # n-grams that cross a cut are counted in the piece before it, and short ones of its overlap twice
    assert np.abs(language_id.features(text) - whole).max() < 0.02


def test_a_full_sample_leaves_the_driver_room(spark):
    """Of 2,400 profiles (39 MB) and their products (46 MB) the driver holds no second copy beside the two."""
    rows = [(i, f"{text} {i}", lang, source, n) for i, text, lang, source, n in documents(4000) if text and lang]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).cache()
    docs.count()
    tracemalloc.start()
    try:
        model = language_id.fit(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        docs.unpersist()
    assert model.weights.shape == (4096, language_id.BITS) and most < 98e6
