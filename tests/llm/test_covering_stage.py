"""The pipeline's near-duplicate stage: covering fingerprints first, the rest by MinHash, parities before texts."""

from __future__ import annotations

import numpy as np

from sonoweft.llm import similar, simhash


def rows_of_all_distances() -> list[tuple[int, str]]:
    """Copies with one changed word to a third of them changed, some of them moved only (equal sets, other fingerprints)."""
    rng = np.random.default_rng(17)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, 260)]
        rows.append((1000 + 10 * k, " ".join(words)))
        for at in rng.choice(260, 1 + k % 12, replace=False):
            words[at] = f"other{at}"
        rows.append((1001 + 10 * k, " ".join(words)))
    return rows


def test_stage_links_by_covering_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline

    rows = rows_of_all_distances()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, radius: asked.append(radius) or links(distinct, radius))
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert asked == [similar.RADIUS]
    sets = {d: set(similar.shingles(t).tolist()) for d, t in rows}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert got == {d for d, _ in rows if d % 10 == 0 or not alike(d, d - 1)}


def test_covering_pairs_connect_all_fingerprints_within_the_radius(spark):
    rows = rows_of_all_distances()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = similar._sketches(docs).withColumnRenamed("text_hash", "t")
    table = [(r.t, r.fp) for r in classes.collect()]
    near = {(max(a, b), min(a, b)) for a, x in table for b, y in table if a != b and ((x ^ y) & (1 << 64) - 1).bit_count() <= similar.RADIUS}
    got = {(r.a, r.b) for r in similar._covering_pairs(classes).collect()}
    assert near and got == near


def test_parities_never_forbid_similar_texts(spark):
    rng = np.random.default_rng(3)
    for n in (1, 7, 90, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        x, y = similar._parities([a, b])
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
        if n < 1000:
            assert x.view(np.uint8).any() and set(np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))) == {c for c, k in zip(*np.unique(a >> np.uint64(55), return_counts=True)) if k % 2}


def test_prefix_join_lists_few_pairs_of_a_template(spark):
    """Texts of one template far below the threshold: the join on the rarest shingles listed all of their pairs."""
    base = [f"t{x}" for x in range(120)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in np.random.default_rng(k).choice(120, 9, replace=False):
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = similar._sketches(docs).selectExpr("doc_id", "text_hash AS t", "n", *[c for c in similar._WORDS]).join(docs, "doc_id").drop("doc_id")
    nothing = spark.createDataFrame([], "node long, root long")
    got = {(r.a, r.b) for r in similar._prefix_pairs(texts, nothing).collect()}
    sets = {r.t: set(similar.shingles(r.text).tolist()) for r in texts.collect()}
    alike = {(a, b) for a, x in sets.items() for b, y in sets.items() if a > b and 5 * len(x & y) >= 4 * len(x | y)}
    assert alike <= got and len(got) < 120 * 119 // 2 // 20
