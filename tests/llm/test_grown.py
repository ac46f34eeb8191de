"""Plans of rounds."""

from __future__ import annotations

from sonoweft.llm import collocation


def test_plans_of_phrase_rounds_do_not_grow(spark, monkeypatch):
    seen = []
    plain = collocation._quads

    def noted(counts, triples):
        seen.append([d._jdf.queryExecution().optimizedPlan().collectLeaves().size() for d in (counts, triples)])
        return plain(counts, triples)

    monkeypatch.setattr(collocation, "_quads", noted)
    docs = spark.createDataFrame([(i, "de", " ".join(f"w{(i * 7 + k * k) % 9}" for k in range(40))) for i in range(40)], "doc_id long, lang string, text string")
    collocation.collocations(docs, limit=2, least=5).count()
    assert len(seen) > 1
    assert all(leaves == [1, 1] for leaves in seen)
