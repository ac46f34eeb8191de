"""Durations, schedules of rounds, single utterances, slices of audio and listings with durations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoweft import __main__ as command
from sonoweft.functions.durations import human_duration, real_time_factor
from sonoweft.operators.schedules import effective_rounds
from sonoweft.plans import graph, speech, stages
from sonoweft.sources import audio, dictionary, interval_files, listing, model

RATE, TONES = 16_000, {"a": 220, "b": 660, "c": 1320}


def test_durations(spark):
    want = {0.0: "0.0s", 3.44: "3.4s", 59.96: "60.0s", 60.0: "1m 00s", 123.9: "2m 03s", 3599.0: "59m 59s", 3723.0: "1h 02m 03s", 90_061.5: "25h 01m 01s", None: None}
    rows = spark.createDataFrame([(s,) for s in want], "s double").select("s", human_duration(F.col("s")).alias("t"), real_time_factor(F.lit(31.0), F.col("s")).alias("r")).collect()
    assert {r.s: r.t for r in rows} == want
    assert {r.r for r in rows if not r.s} == {"—"} and {r.r for r in rows if r.s == 60.0} == {"0.517x"}


def brute_rounds(n, rounds, disabled):
    out = []
    for k, (kind, subset, optional) in enumerate(rounds):
        if kind in disabled:
            continue
        if optional and subset > n:
            break
        out.append((n, k, kind, subset if subset < n else 0, optional))
    return out


def test_rounds(spark):
    rounds = [("mono", 5, False), ("tri", 50, False), ("lda", 7, True), ("sat", 20, True), ("probs", 0, True), ("sat", 80, True), ("tri", 0, False)]
    sizes = spark.createDataFrame([(n,) for n in (0, 5, 6, 7, 20, 21, 50, 80, 1000)], "utts long")
    for disabled in ((), ("lda",), ("mono", "sat")):
        got = [tuple(r) for r in effective_rounds(sizes, rounds, disabled).orderBy("utts", "nth").collect()]
        assert got == [x for n in (0, 5, 6, 7, 20, 21, 50, 80, 1000) for x in brute_rounds(n, rounds, disabled)]
    assert effective_rounds(sizes, []).count() == 0
    unknown = spark.createDataFrame([(None,)], "utts long")
    assert [r.kind for r in effective_rounds(unknown, rounds).orderBy("nth").collect()] == ["mono", "tri"]
    assert effective_rounds(sizes.where("utts < 0"), rounds).count() == 0


def test_audio_arguments(spark, tmp_path):
    file = tmp_path / "x.wav"
    file.write_bytes(audio.encoded_wav(np.zeros(1600), RATE))
    with pytest.raises(TypeError, match="not with a path"):
        audio.given(spark, file, RATE)
    with pytest.raises(TypeError, match="need a sample_rate"):
        audio.given(spark, [0.0, 0.1])
    with pytest.raises(TypeError, match="one dimension"):
        audio.given(spark, np.zeros((2, 3)), RATE)
    for bad in (b"abc", ["x"], None):
        with pytest.raises(TypeError):
            audio.given(spark, bad, RATE)
    with pytest.raises(ValueError, match="positive"):
        audio.given(spark, [0.0], 0)
    assert len(audio.given(spark, file).first().samples) == 1600
    for kind in (np.float32, np.float64, np.int64):
        assert len(audio.given(spark, np.zeros(800, kind), 8000).first().samples) == 1600
    assert audio.given(spark, [], RATE).first().samples == []


def test_slices(spark):
    sound = spark.createDataFrame([("x", 100, [float(i) for i in range(100)], None)], audio.AUDIO)
    spans = spark.createDataFrame([("x", 0.1, 0.2), ("x", 0.9, 5.0), ("x", -1.0, 0.02), ("x", 0.5, 0.4), ("x", 7.0, 9.0), ("y", 0.0, 1.0)], "path string, start double, end double")
    got = {r.start: r.samples for r in audio.slices(sound, spans).collect()}
    assert got == {0.1: list(range(10, 20)), 0.9: list(range(90, 100)), -1.0: [0, 1], 0.5: [], 7.0: []}


def test_listing_with_durations(spark, tmp_path):
    top, other = tmp_path / "top", tmp_path / "other"
    for d in (top / "s1", top / ".hidden", other / "deep"):
        d.mkdir(parents=True)
    wav = audio.encoded_wav(np.zeros(160), RATE)
    for p in (top / "s1" / "a.wav", top / "s1" / "a.mp3", top / "b.flac", top / ".hidden" / "z.wav", other / "deep" / "c.wav", other / "deep" / "lone.wav"):
        p.write_bytes(wav)
    (top / "b.lab").write_text("not intervals")
    grid = [("words", [(0.0, 1.25, "7 of 9")])]
    (top / "s1" / "a.TextGrid").write_text(interval_files.textgrid_text(grid, 1.25))
    (top / "c.TextGrid").write_text(interval_files.short_textgrid_text(grid, 2.5), encoding="utf-16")
    (top / "d.TextGrid").write_text("broken 1 2 3")
    rows = [tuple(r) for r in listing.with_durations(spark, f"file://{top}").collect()]
    assert rows == [("b", "b.flac", None, None), ("s1/a", "s1/a.wav", "s1/a.TextGrid", 1.25)]
    rows = [tuple(r) for r in listing.with_durations(spark, f"file://{top}", f"file://{other}").collect()]
    assert rows == [("b", "b.flac", None, None), ("c", "deep/c.wav", "c.TextGrid", 2.5), ("s1/a", "s1/a.wav", "s1/a.TextGrid", 1.25)]


@pytest.fixture(scope="module")
def tones(tmp_path_factory):
    """Tones of 0.3 s each for six transcripts, in a folder for each speaker."""
    top = tmp_path_factory.mktemp("single")
    rng = np.random.default_rng(5)
    for i, text in enumerate(["a b a", "b a b", "a c a", "c b c", "b c a", "a b c"]):
        t = np.arange(int(0.3 * RATE)) / RATE
        x = np.concatenate([np.zeros(RATE // 20), *[0.4 * np.sin(2 * np.pi * TONES[w] * t) for w in text.split()], np.zeros(RATE // 20)])
        (top / f"sp{i % 2}").mkdir(exist_ok=True)
        (top / f"sp{i % 2}" / f"u{i}.wav").write_bytes(audio.encoded_wav(x + 0.01 * rng.normal(size=len(x)), RATE))
        (top / f"sp{i % 2}" / f"u{i}.lab").write_text(text)
    (top / "lexicon.dict").write_text("a aa\nb bb\nc cc\nd dd\n")
    return top


def test_single_utterances(spark, tones, tmp_path, capsys):
    lexicon = dictionary.read(spark, f"file://{tones}/lexicon.dict")
    trained, _ = speech.train(spark, f"file://{tones}", f"file://{tones}/lexicon.dict", 6)
    wav = tones / "sp0" / "u4.wav"
    by_text = speech.single(spark, wav, "b c a", lexicon, known=trained.phones)
    by_file = speech.single(spark, str(wav), f"{tones}/sp0/u4.lab", lexicon, known=trained.phones)
    whole = speech.utterances(spark, f"file://{tones}", lexicon)
    assert by_text.dtypes == whole.dtypes
    a, b = by_text.first(), by_file.first()
    assert (a.utt, a.speaker, a.words, a.oov, a.seconds) == ("u4", "sp0", [[["bb"]], [["cc"]], [["aa"]]], 0, 1.0)
    assert a == b
    rate, x = audio.decoded_wav(wav.read_bytes())
    c = speech.single(spark, x, "b c a", lexicon, sample_rate=rate).first()
    assert (c.utt, c.speaker) == ("utt", "speaker") and np.allclose(c.feats, a.feats)
    words = [r for r in speech.align(by_text, trained).orderBy("tier", "idx").collect() if r.tier == "words"]
    assert [r.label for r in words] == ["0", "1", "2"] and all(abs(r.xmin - (0.05 + 0.3 * k)) <= 0.03 for k, r in enumerate(words))
    with pytest.raises(ValueError, match="doesn't have: dd"):
        speech.single(spark, wav, "a d", lexicon, known=trained.phones)
    with pytest.raises(ValueError, match="no words"):
        speech.single(spark, wav, " \n ", lexicon)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    with pytest.raises(ValueError, match="can't be read"):
        speech.single(spark, tmp_path / "bad.wav", "a", lexicon)
    assert not any(speech.is_file(spark, t) for t in ("", "a\nb", "no:such thing", "well:then", "a b", f"{tones}"))
    model.save(spark, trained, f"file://{tmp_path}/m")
    assert command.main(["align-one", str(wav), "b c a", f"file://{tones}/lexicon.dict", f"file://{tmp_path}/m", f"file://{tmp_path}/out", "--ctm"]) == 0
    said = capsys.readouterr().out
    assert "1 of 1 utterances aligned, 0 unknown words, 1.0s of audio" in said and "x of real time" in said
    assert (tmp_path / "out" / "textgrids" / "u4.TextGrid").exists()


def test_curriculum(spark, data):
    corpus, at = graph.corpus_of(spark, data), stages.new_folder(spark)
    once = stages.Schedule(iterations=1, realign=frozenset(), gaussians=20, grow=1)
    rounds = [stages.Round("mono", once, subset=6), stages.Round("other", once), stages.Round("tri", once, subset=10, leaves=16), stages.Round("tri", once, subset=10**6, optional=True, leaves=16)]
    with pytest.raises(ValueError, match="unknown kind"):
        stages.curriculum(corpus, rounds, at)
    mono = spark.read.parquet(f"{at}/0/mono/0/log").inputFiles()
    done = stages.curriculum(corpus, rounds, at, disabled={"other"})
    assert [line[:2] for line in done.log] == [("mono", 0), ("tri", 0)]
    assert spark.read.parquet(f"{at}/0/mono/0/log").inputFiles() == mono  # the first round was stored and isn't run again
    small = stages.part_of(corpus, 6, f"{at}/0").utts
    assert [r.utt for r in small.orderBy("utt").collect()] == sorted(r.utt for r in corpus.utts.orderBy("n", "utt").limit(6).collect())
    assert done.aligned.select("utt").distinct().count() <= 10
    with pytest.raises(ValueError, match="no round"):
        stages.curriculum(corpus, rounds[-1:], at)
    with pytest.raises(ValueError, match="before it"):
        stages.curriculum(corpus, rounds[2:3], at)
