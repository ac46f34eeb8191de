"""The queries on tones: what a task holds at once, and results against plain loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sonoweft.operators import features
from sonoweft.plans import training


def tones(n: int, seed: int = 1) -> pa.RecordBatch:
    rng = np.random.default_rng(seed)
    events = [[{"phone": str(rng.choice([*training.TONES, "error"])), "ms": int(rng.integers(60, 140))} for _ in range(int(rng.integers(1, 20)))] for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([f"{i}-1" for i in range(n)]), pa.array(events)], names=["utt", "e"])


def test_a_batch_of_any_size_is_sounded_a_few_rows_at_a_time():
    made = list(training.sounded(iter([tones(100)])))
    assert max(b.num_rows for b in made) <= features.AT_ONCE and sum(b.num_rows for b in made) == 100
    parts = list(features.mfcc_batches(iter([b.select(["utt", "words", "samples"]) for b in made])))
    assert max(b.num_rows for b, _ in parts) <= features.AT_ONCE
    rows = dict(zip(tones(100).column(0).to_pylist(), tones(100).column(1).to_pylist(), strict=True))
    for b, feats in parts:
        for utt, words, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), feats, strict=True):
            assert words == [[[e["phone"]]] for e in rows[utt] if e["phone"] != "error"]
            n = 1600 + sum(16 * e["ms"] for e in rows[utt])
            assert len(x) == (n + 80) // 160


def test_the_task_of_tone_mfcc_sends_a_row_an_utterance(spark, data):
    got = training.tone_mfcc(spark, data).collect()
    audio = training.tone_audio(training.tone_words(spark, data)).limit(5).collect()
    by = {(r.utt, r.dim): r for r in got}
    assert len(by) == len(got) == 13 * 75
    for a in audio:
        x = features.mfcc(np.array(a.samples, float))
        for k, mean in enumerate(x.mean(0)):
            assert by[a.utt, k].frames == len(x) and abs(by[a.utt, k]["mean"] - mean) < 6e-4


def some_words(rng, phones, empty):
    pron = lambda: [str(p) for p in rng.choice(phones, int(rng.integers(0 if empty else 1, 4)))]
    return [[pron() for _ in range(int(rng.integers(0, 4)))] for _ in range(int(rng.integers(0, 5)))]


def test_paths_found_side_by_side_are_those_of_each_graph(monkeypatch):
    from sonoweft.plans import aligner

    rng = np.random.default_rng(5)
    phones = ("sil", "a", "b", "c")
    model = aligner.Model(phones, rng.normal(size=(12, 2)), rng.uniform(0.5, 2, (12, 2)))
    index = {p: i for i, p in enumerate(phones)}
    for cells in (aligner.CELLS, 500):
        monkeypatch.setattr(aligner, "CELLS", cells)
        texts = [some_words(rng, phones[1:], k % 5 == 0) for k in range(200)]
        frames = [np.round(rng.normal(size=(int(rng.integers(0, 60)), 2)), 1) for _ in texts]
        got = {k: (cost, pdf, unit, word) for k, cost, pdf, unit, word in aligner.best_paths(texts, frames, model, aligner.Pieces(phones, most=30))}
        reached = 0
        for k, (t, x) in enumerate(zip(texts, frames, strict=True)):
            graph = aligner.Graph(t, index)
            path = graph.best_path(model.costs(x)) if len(x) else None
            assert (path is None) == (k not in got)
            if path is not None:
                reached += 1
                cost, pdf, unit, word = got[k]
                assert abs(cost - path[0]) < 1e-9
                assert pdf.tolist() == [graph.pdf[s] for s in path[1]]
                assert word.tolist() == [graph.unit[s][2] for s in path[1]]
                changes = [graph.unit[a][0] != graph.unit[b][0] for a, b in zip(path[1], path[1][1:], strict=False)]
                assert (np.diff(unit) != 0).tolist() == changes
        assert reached > 80


def test_packed_frames_align_as_lists_do(spark):
    from sonoweft.plans import aligner

    rng = np.random.default_rng(6)
    m = aligner.Model(("sil", "a"), np.vstack([np.full((3, 2), -8.0), np.full((3, 2), 8.0)]), np.ones((6, 2)))
    frames = [np.vstack([rng.normal(-8, 1, (20, 2)), rng.normal(8, 1, (60, 2)), rng.normal(-8, 1, (20, 2))]).astype(np.float32).astype(float) for _ in range(6)]
    batch = pa.RecordBatch.from_arrays([features.pack([*frames, np.zeros((0, 2))])], names=["x"])
    assert [x.tolist() for x in features.frames_of(batch.slice(2, 3).column(0))] == [x.tolist() for x in frames[2:5]]
    nested = features.nested([*frames, np.zeros((0, 2))])
    assert [x.tolist() for x in features.frames_of(nested.slice(2, 3))] == [x.tolist() for x in frames[2:5]]
    words = [[["a"]]]
    lists = spark.createDataFrame([(f"s-{k}", "s", x.tolist(), words) for k, x in enumerate(frames)], "utt string, speaker string, feats array<array<double>>, words array<array<array<string>>>")
    packed = spark.createDataFrame([(f"s-{k}", "s", features.pack([x])[0].as_py(), words) for k, x in enumerate(frames)], "utt string, speaker string, feats binary, words array<array<array<string>>>")
    by = lambda df: sorted((r.utt, r.tier, r.idx, r.label, r.word, r.start_frame, r.end_frame) for r in df.collect())
    for of in (aligner.aligned, lambda u, m: aligner.aligned_twice(u, m, 50)):
        assert by(of(lists, m)) == by(of(packed, m)) and by(of(lists, m))
    assert [r.tier for r in aligner.aligned(lists, m).where("utt = 's-0'").collect()].count("phones") == 3


def test_refinement_makes_only_the_frames_it_needs(monkeypatch):
    from sonoweft.plans import aligner

    rng = np.random.default_rng(8)
    samples = rng.normal(size=16_000) * 0.1
    whole = features.mfcc(samples, features.Mfcc(shift=16))
    some = rng.permutation(len(whole))[:150]
    assert np.abs(features.mfcc(samples, features.Mfcc(shift=16), some) - whole[some]).max() < 1e-9
    made = []
    monkeypatch.setattr(aligner, "mfcc", lambda *a: made.append(features.mfcc(*a)) or made[-1])
    model = aligner.Model(("sil", "a"), rng.normal(size=(6, 13)), np.ones((6, 13)))
    spans = [(0, 30, "sil"), (30, 60, "a"), (60, 62, "a"), (62, 100, "sil")]
    assert len(aligner.refined_times(samples, spans, model)) == 3
    assert sum(map(len, made)) <= 2 * 2 * aligner.REACH
