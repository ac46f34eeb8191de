"""End to end on tones, and the numeric parts against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from sonoweft.operators import estimation, features, statistics
from sonoweft.plans import aligner, speech
from sonoweft.sources import audio, dictionary, model
from sonoweft.streaming import watch

RATE, TONES = 16_000, {"a": 220, "b": 660, "c": 1320}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Six transcripts of three words, each word a tone of 0.3 s at 0.4 with noise of 0.01, 0.05 s of silence around."""
    top = tmp_path_factory.mktemp("tones")
    rng = np.random.default_rng(11)
    for i, text in enumerate(["a b a", "b a b", "a c a", "c b c", "b c a", "a b c"]):
        t = np.arange(int(0.3 * RATE)) / RATE
        tones = np.concatenate([0.4 * np.sin(2 * np.pi * TONES[w] * t) for w in text.split()])
        x = np.concatenate([np.zeros(RATE // 20), tones, np.zeros(RATE // 20)])
        folder = top / f"speaker{i % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"u{i}.wav").write_bytes(audio.encoded_wav(x + 0.01 * rng.normal(size=len(x)), RATE))
        (folder / f"u{i}.lab").write_text(text)
    (top / "lexicon.dict").write_text("a aa\nb bb\nc cc\n")
    return f"file://{top}"


def test_tones_are_aligned(spark, corpus, tmp_path):
    lexicon = dictionary.read(spark, f"{corpus}/lexicon.dict")
    utts = speech.utterances(spark, corpus, lexicon).persist()
    trained, likes = aligner.trained(utts, 8)
    assert likes[-1] > likes[0] and trained.phones == ("sil", "aa", "bb", "cc")
    model.save(spark, trained, f"file://{tmp_path}/m")
    back = model.load(spark, f"file://{tmp_path}/m")
    assert np.array_equal(back.mean, trained.mean)
    spans = speech.align(utts, back).persist()
    words = [r for r in spans.collect() if r.tier == "words"]
    assert len(words) == 18
    for r in words:
        k = int(r.label)
        assert abs(r.xmin - (0.05 + 0.3 * k)) <= 0.03 and abs(r.xmax - (0.35 + 0.3 * k)) <= 0.03
    row = speech.summary(utts, spans).first()
    assert (row.utterances, row.aligned, row.failed, row.oov) == (6, 6, [], 0)
    grids = speech.write_textgrids(spans, f"file://{tmp_path}/g")
    assert grids.count() == 6
    utts.write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{k} {t}" for k, t in utts.dtypes)
    watch.aligned_stream(spark, f"{tmp_path}/in", schema, back, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("tier = 'words'").count() == 18


def test_model_version_is_checked(spark, tmp_path):
    m = aligner.Model(("sil", "a"), np.zeros((6, 2)), np.ones((6, 2)))
    model.save(spark, m, f"file://{tmp_path}/m")
    spark.createDataFrame([(model.KIND, 9, ["sil"], 3)], "kind string, version int, phones array<string>, states int").write.mode("overwrite").json(f"file://{tmp_path}/m/meta")
    with pytest.raises(model.ModelError, match="version 9"):
        model.load(spark, f"file://{tmp_path}/m")


def test_too_few_frames_give_no_rows(spark):
    m = aligner.Model(("sil", "a"), np.zeros((6, 2)), np.ones((6, 2)))
    utts = spark.createDataFrame([("u", [[0.0, 0.0]], [[["a"]]])], "utt string, feats array<array<double>>, words array<array<array<string>>>")
    assert aligner.aligned(utts, m).count() == 0


def test_best_path_takes_the_likelier_pronunciation():
    index = {"sil": 0, "a": 1, "b": 2}
    costs = np.full((9, 9), 9.0)
    costs[:, 6:] = 0.0
    graph = aligner.Graph([[["a"], ["b"]]], index)
    _, states = graph.best_path(costs)
    assert {graph.unit[s][1] for s in states} == {"b"}


def test_mfcc_of_silence_and_of_tones():
    o = features.Mfcc()
    assert features.mfcc(np.zeros(0)).shape == (0, 13)
    assert len(features.mfcc(np.zeros(1600))) == 10
    t = np.arange(RATE) / RATE
    low, high = (features.mfcc(0.4 * np.sin(2 * np.pi * f * t)).mean(0) for f in (220, 1320))
    assert low[1] > high[1]
    assert features.mel_filters(o).shape == (23, 256)
    assert features.mirrored(np.array([-2, -1, 0, 4, 5, 6]), 5).tolist() == [1, 0, 0, 4, 4, 3]


def test_wav_round_trip_and_resampling():
    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 200 * t)
    rate, back = audio.decoded_wav(audio.encoded_wav(x, 8000))
    assert rate == 8000 and np.abs(back - x).max() < 1e-3
    up = features.resampled(back, 8000)
    want = 0.5 * np.sin(2 * np.pi * 200 * np.arange(16000) / 16000)
    assert np.abs(up - want)[200:-200].max() < 0.01


def test_lda_finds_the_dimension_that_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(0, 1, 3) + (5 if k else -5) * np.eye(3)[1]).tolist()) for k in (0, 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    p = estimation.lda_projection(statistics.scatter(df, "k", "x", 3, augmented=True), 3, 1)
    assert abs(p[0]).argmax() == 1 and abs(p[0][1]) > 5 * abs(p[0][0])


def test_fmllr_raises_the_objective_and_undoes_a_shift():
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(0, 1, (800, 3)) * [1, 2, 0.5] + [3, -1, 2], np.ones((800, 1))])
    k, g = np.tile(np.zeros(4), (3, 1)), np.stack([x.T @ x] * 3)
    w = estimation.fmllr_transform(800.0, k, g)
    start = np.hstack([np.eye(3), np.zeros((3, 1))])
    assert estimation.fmllr_objective(w, 800.0, k, g) > estimation.fmllr_objective(start, 800.0, k, g)
    assert np.abs((x @ w.T).mean(0)).max() < 0.05 and np.abs((x @ w.T).var(0) - 1).max() < 0.1


def test_tree_and_mixture_pieces():
    stats = [({"left": a, "label": b}, np.array([50.0, 50.0 * m, 50.0 * (m * m + 1)])) for (a, b, m) in (("x", "p", 0.0), ("y", "p", 9.0), ("x", "q", 0.1), ("y", "q", 9.1))]
    nodes = estimation.grown_tree(stats, [("label", frozenset("p")), ("left", frozenset("x"))], 1.0, 8)
    assert nodes[0]["key"] == "left" and sum("leaf" in n for n in nodes) == 2
    assert estimation.split_targets({0: 1000.0, 1: 30.0, 2: 1000.0}, 7) == {0: 3, 1: 1, 2: 3}
    one = [{"g": 0, "weight": 1.0, "mean": [0.0, 1.0], "var": [1.0, 4.0]}]
    two = estimation.split_heaviest(one)
    assert [m["weight"] for m in two] == [0.5, 0.5]
    back = estimation.merged_cheapest(two, 1)[0]
    assert np.allclose(back["mean"], [0.0, 1.0])
    assert estimation.refined_boundary(np.array([1.0, 1, 1, -1, -1]), 2, 2) == 3


def test_refinement_brings_boundaries_closer(spark, data):
    from sonoweft.plans import training

    got = {r["pass"]: r for r in training.tone_refinement(spark, data).collect()}
    assert got["refined"].within_0_01 > got["frames"].within_0_01
    assert got["refined"].within_0_01 > 0.95


def test_mllt_raises_the_objective():
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(3, 3)) + 3 * np.eye(3)
    x = rng.normal(size=(500, 3)) @ mix.T
    g = np.stack([x.T @ x / v for v in x.var(0)])
    a = estimation.mllt_transform(500.0, g)
    assert estimation.mllt_objective(a, 500.0, g) > estimation.mllt_objective(np.eye(3), 500.0, g)


def test_adaptation_undoes_a_speakers_shift(spark):
    rng = np.random.default_rng(6)
    m = aligner.Model(("sil", "a"), np.vstack([np.full((3, 2), -8.0), np.full((3, 2), 8.0)]), np.ones((6, 2)))
    rows = []
    for speaker, shift in (("s0", 0.0), ("s1", 1.5)):
        for u in range(8):
            x = np.vstack([rng.normal(-8, 1, (20, 2)), rng.normal(8, 1, (60, 2)), rng.normal(-8, 1, (20, 2))]) + shift
            rows.append((f"{speaker}-{u}", speaker, x.tolist(), [[["a"]]]))
    utts = spark.createDataFrame(rows, "utt string, speaker string, feats array<array<double>>, words array<array<array<string>>>")
    t = aligner.speaker_transforms(aligner.aligned_frames(utts, m), m, 50)
    moved = aligner.adapted(utts, t)
    middle = {}
    for r in moved.collect():
        middle.setdefault(r.speaker, []).append(np.mean(r.feats[30:70], axis=0))
    assert all(np.abs(np.mean(v, axis=0) - 8).max() < 0.3 for v in middle.values())
    assert aligner.aligned_twice(utts, m, 50).where("tier = 'words'").count() == 16


def test_questions_and_merged_leaves():
    flat = lambda m, n=50.0: np.array([n, n * m, n * (m * m + 1)])
    sets = estimation.question_sets({"a": flat(0), "b": flat(0.2), "c": flat(9), "d": flat(9.3)})
    assert frozenset("ab") in sets and frozenset("cd") in sets and frozenset("bc") not in sets
    merged = estimation.merged_leaves({k: flat(m) for k, m in enumerate((0, 5, 0.1, 9, 30))}, 4)
    assert merged == {0: 0, 2: 0, 1: 1, 3: 2, 4: 3}
    assert estimation.merged_leaves({0: flat(0), 1: flat(1)}, 8) == {0: 0, 1: 1}
