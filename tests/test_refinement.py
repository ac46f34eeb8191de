"""Energy onset, level and split of boundary refinement against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sonoweft.operators import estimation as e


def plain_energy(samples, ms):
    c = max(ms, 0) * 16
    part = samples[max(0, c - 40) : c + 40] if c - 40 < len(samples) else []
    return math.log(sum(x * x for x in part) / max(len(part), 1) + 1e-10)


@pytest.mark.parametrize("seed", range(6))
def test_energies(seed):
    rng = np.random.default_rng(seed)
    samples = rng.normal(size=int(rng.integers(0, 900))) * 0.1
    for first in (-12, 0, 20, 70):
        np.testing.assert_allclose(e.energies(samples, first, 30), [plain_energy(samples, first + i) for i in range(30)], atol=1e-6)


@pytest.mark.parametrize("seed", range(40))
def test_onset_level_and_split(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 61))
    energy = np.round(rng.normal(size=n + 20), 1) + 4 * (np.arange(n + 20) > rng.integers(0, n + 20))
    rises = {i: np.mean(energy[i + 10 : i + 20]) - np.mean(energy[i : i + 10]) for i in range(10, n)}
    top = max(rises.values(), default=-1)
    want = next((i for i, r in rises.items() if r >= top - 1e-12), None) if top >= 2.3 else None
    assert e.energy_onset(energy) == want
    inner = energy[10:-10]
    step = np.mean(inner[n // 2 :]) - np.mean(inner[: n // 2])
    level = e.crossing_level(energy)
    assert level == pytest.approx(0.5 + max(-0.15, min(0.15, 0.1 * step)))
    ratio = rng.integers(-5, 6, n).astype(float)
    mid = ratio.min() + level * (ratio.max() - ratio.min())
    scores = [sum(ratio[:i] - mid) - sum(ratio[i:] - mid) for i in range(n + 1)]
    best = max(scores)
    want = None if ratio.min() == ratio.max() else min(next(i for i, s in enumerate(scores) if s >= best - 1e-9), n - 1)
    assert e.split_at_level(ratio, level) == want


# ---- interval files


def test_textgrid_files_in_both_forms(spark, tmp_path):
    from sonoweft.plans import speech
    from sonoweft.sources import interval_files as files

    rows = [("a/b ü", "words", 0.0, 0.25, 'say "hi"', 1.5), ("a/b ü", "words", 0.25, 1.5, "", 1.5), ("a/b ü", "phones", 0.0, 1.5, "x", 1.5), ("..", "words", 0.0, 2.0, None, 2.0)]
    spans = spark.createDataFrame(rows, "utt string, tier string, xmin double, xmax double, label string, duration double")
    want = sorted((files.file_name(u), t, a, b, label or "") for u, t, a, b, label, _ in rows)
    for short in (False, True):
        folder = f"file://{tmp_path}/{short}"
        made = speech.write_textgrids(spans, folder, short=short).collect()
        assert sorted(r.utt for r in made) == ["..", "a/b ü"]
        assert sorted(p.name for p in (tmp_path / str(short)).glob("*.TextGrid")) == sorted(files.file_name(r.utt) for r in made)
        assert all((tmp_path / str(short) / files.file_name(r.utt)).stat().st_size == r.bytes for r in made)
        back = files.read(spark, folder).collect()
        assert sorted((r.path.rsplit("/", 1)[1].replace("%25", "%"), r.tier, r.xmin, r.xmax, r.label) for r in back) == want
    assert files.file_name("..") == "%2E%2E.TextGrid"


def test_audio_of_another_rate_raises(spark):
    from sonoweft.operators.features import mfcc_rows

    audio = spark.createDataFrame([("u", 8000, [0.0] * 800)], "utt string, rate int, samples array<float>")
    with pytest.raises(Exception, match="resampled to 16000"):
        mfcc_rows(audio).collect()
