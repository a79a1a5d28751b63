import re
from collections import Counter

import corpus_pipeline
from quernel.llm import common
from quernel.llm.common import word_count
from quernel.llm.mixing import plan
from pyspark.sql import functions as F
from tests.llm.fixtures import DOCS, brute_repeats, documents
from tests.llm.test_packing import verify
from tests.llm.test_near_copies import brute_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_against_brute_repeats(spark):
    rows = [r for r in documents(300) if r[0] is not None]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    docs = spark.createDataFrame(rows, DOCS)

    kept = stage("language_id")(spark, docs, "")
    assert kept.columns == COLUMNS
    kept_rows = [tuple(r) for r in kept.collect()]
    gone = {r[0] for r in rows} - {r[0] for r in kept_rows}
    assert {300, 301, 302} <= gone and len(gone) < 0.03 * len(rows) + 4

    one = stage("simhash_near_dedup")(spark, kept, "")
    one_rows = [tuple(r) for r in one.collect()]
    # all links that the keys find are links, so each group of the brute force keeps its least id; few keep more
    least = {min(kept_rows[i][0] for i in members) for members in brute_kept(kept_rows).values()}
    assert least <= {r[0] for r in one_rows} and len(one_rows) <= 1.01 * len(least) + 1
    assert one.columns == COLUMNS

    cut = stage("suffix_array_dedup")(spark, one, "")
    cut_rows = {r.doc_id: r for r in cut.collect()}
    seen = {}
    for doc, size, removed, *_ in brute_repeats(sorted((r[0], r[1].encode()) for r in one_rows)):
        seen[doc] = size - removed
    assert {d for d, left in seen.items() if left} == set(cut_rows)
    lost = {d: seen[d] - len(r.text.encode()) for d, r in cut_rows.items()}
    assert all(0 <= n <= 12 for n in lost.values())  # bytes of characters that a cut has halved
    assert cut.columns == COLUMNS

    mixed = stage("mixing")(spark, cut, "")
    words = Counter()
    for r in mixed.select("doc_id", word_count(F.col("text")).alias("n")).collect():
        words[r.doc_id] += r.n
    assert +words == +Counter({r.doc_id: r["__taken"] for r in plan(cut).collect()})
    assert mixed.columns == COLUMNS
    mixed_rows = [tuple(r) for r in mixed.collect()]

    packed = stage("packing")(spark, mixed, "")
    verify(packed.collect(), mixed_rows)


def test_run_and_names(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert out.count() > 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, one in corpus_pipeline.STAGES:
        docs = one(spark, docs, "")
        assert docs.collect() == []


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert [n for k in range(1, 11) for n in names if re.match(rf"op{k}_", n)] == [n for n in names if n.startswith("op")]
    assert len([n for n in names if n.startswith("op")]) == 10


def test_the_driver_gives_memory_back(spark):
    """What the JVM holds beside its heap goes back too; the JVM here has the command."""
    assert "Trim native heap" in common.tidy(spark)
