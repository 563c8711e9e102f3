"""The fallback by words reads the memories of users that have an unserved question, and no others."""

from memloom.operators import retrieval as R


def test_fallback_reads_users_it_serves(spark, monkeypatch):
    texts = "user_id long, key long, text string, embedding array<float>"
    memories = spark.createDataFrame([(u, i, f"alpha{u} beta{i} gamma", None) for u in range(6) for i in range(4)], texts)
    asked = [(0, 0, "beta1 alpha0", None), (1, 0, "unknown", None), (2, 0, "beta2", None)]
    questions = spark.createDataFrame(asked, texts.replace("key", "qid"))
    seen, lexical = [], R.lexical_topk
    monkeypatch.setattr(R, "lexical_topk", lambda q, m, k: seen.append({r.user_id for r in m.collect()}) or lexical(q, m, k))
    got = R.hybrid_recall(questions, memories, 2).collect()
    assert seen == [{1}]
    assert sorted((r.key, r["rank"], r.rrf) for r in got if r.user_id == 1) == [(0, 1, 0.0), (1, 2, 0.0)]
    assert {r.key for r in got if r.user_id == 2} == {2} and (0, 1, 1) in {(r.user_id, r.key, r["rank"]) for r in got}
