"""The corpus pipeline on a small generated corpus: each stage on what the one before kept."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice("tree house sky water run walk blue green red".split()) + str(rnd.randint(0, 300)) for _ in range(80))
    rows = [(i, good(), "en", f"s{i % 4}", 0) for i in range(150)]
    rows += [(200 + i, "BUY!! NOW!! $$$ " * 20 + str(i), "en", "s1", 0) for i in range(60)]
    rows += [(300, rows[0][1].upper(), "en", "s0", 0), (301, rows[1][1] + " extra", "en", None, 0), (302, rows[5][1], None, "s2", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert not [i for i in kept["quality"] if 200 <= i < 300] and len(kept["quality"]) >= 150
    assert 302 in kept["exact"] and 5 not in kept["exact"] and 0 not in kept["exact"]
    assert (1 in kept["near"]) and 301 not in kept["near"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing names; and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, h1 string, component_id int, row string, kept boolean"
    long = " ".join(f"word{i}" for i in range(60))
    more = ("x", "s", 5, 1, "h", 2, "r", True)
    rows = [(None,) * 10, (1, long, *more), (1, long, *more), (1, "other words", *more), (2, "", *more), (3, None, *more), (None, long + " end", *more), (4, long.upper(), *more)]
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, str(tmp_path)).collect()
        assert name == "pack" or stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    texts = lambda name: sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "")[:5]) for r in out[name]))
    # of equal texts (nulls and empty ones, too) the largest doc_id stays
    assert texts("exact") == [(False, 0, "word0"), (True, 1, "other"), (True, 3, ""), (True, 4, "WORD0")]
    # documents that share an id stay or go together; null ids and empty texts are alike to nothing
    assert {r.doc_id for r in out["near"]} == {None, 1, 2, 3} and len(out["near"]) == 7
    words = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(len((r.text or "").split()) for r in out["mix"]) - words) <= 62
    assert {(r.doc_id, r.doc_tokens) for r in out["pack"] if r.doc_tokens == 1} == {(None, 1), (2, 1), (3, 1)}
