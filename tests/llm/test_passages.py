"""Decontamination at every passage length, and near-duplicates in keys of any size, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from sonoweft.llm import decontam, similar

LETTERS = np.array(list("abcdefghijklmno p"))


def fewest_edits(pattern: str, text: str) -> int:
    """Of the pattern against any part of the text."""
    line = np.array(list(text))
    row, column = np.zeros(len(line) + 1, np.int64), np.arange(len(line) + 1)
    for i, c in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (line != c), row[1:] + 1)
        row = np.minimum.accumulate(new - column) + column
    return int(row.min())


def drawn(rng, n: int) -> str:
    return "x" + " ".join("".join(rng.choice(LETTERS, n)).split()).ljust(n, "q")[1 : n - 1] + "z"


def edited(rng, text: str, edits: int) -> str:
    t = list(text)
    for _ in range(edits):
        at, kind = int(rng.integers(1, len(t) - 1)), rng.integers(3)
        if kind == 0:
            t[at] = "y"
        elif kind == 1:
            t.insert(at, "y")
        else:
            t.pop(at)
    return "".join(t)


@pytest.mark.parametrize("size", [1, 7, 9, 10, 12, 20, 30, 39, 40, 513, 1020, 2099])
def test_a_tenth_of_every_length(size):
    rng = np.random.default_rng(size)
    passage = drawn(rng, size) if size > 2 else "w"
    texts = [drawn(rng, 60 + size)]
    for e in [0, size // 20, size // 10, size // 10, size // 10 + 1, size // 10 + 2, size // 5]:
        around = drawn(rng, 80), drawn(rng, 70)
        texts.append(f"{around[0]} {edited(rng, passage, min(e, max(0, size - 3)))} {around[1]}")
    texts += [passage[: size // 2 + 1], passage[size // 2 :], passage, drawn(rng, 40)]
    items = [(5, passage)]
    got = {k for k, *_ in decontam._hits(texts, decontam.Passages(items))}
    form = lambda s: "".join(map(chr, decontam.normal_form(s)[0]))
    p = form(passage).strip()
    want = {k for k, t in enumerate(texts) if fewest_edits(p, form(t)) <= len(p) // 10}
    assert got == want
    assert len(texts) - 2 in got


@pytest.mark.parametrize("size", [30, 513, 1020, 2099])
def test_a_row_for_each_occurrence(size):
    rng = np.random.default_rng(size)
    passage = drawn(rng, size)
    text = f"{drawn(rng, 90)} {passage} {drawn(rng, 55)} {edited(rng, passage, size // 12)} end"
    rows = sorted(decontam._hits(["nothing", text, passage], decontam.Passages([(1, passage)])), key=lambda r: (r[0], r[2]))
    assert [(k, i) for k, i, *_ in rows] == [(1, 1), (1, 1), (2, 1)]
    assert (rows[0][2], rows[0][3], rows[0][4]) == (91, 91 + size, 0) and rows[2][2:] == (0, size, 0)
    assert 0 < rows[1][4] <= size // 10


def test_halves_in_neighbouring_texts_are_no_occurrence():
    rng = np.random.default_rng(1)
    passage = drawn(rng, 800)
    p = decontam.Passages([(1, passage)])
    assert decontam._hits([passage[:400], passage[400:]], p) == []
    assert [r[0] for r in decontam._hits([passage[:60], passage[60:], "z"], p)] == [1]


def test_both_alignments_agree():
    rng = np.random.default_rng(4)
    passage = drawn(rng, 1500)
    p = decontam.Passages([(1, passage)])
    for edits in (0, 3, 9):
        codes = decontam.normal_form(f"{drawn(rng, 300)} {edited(rng, passage, edits)} {drawn(rng, 200)}")[0]
        owner, diagonal = p.candidates(codes)
        assert len(owner)
        for d in diagonal.tolist():
            (best,), (end,) = p._aligned(codes, np.array([0]), np.array([d]))
            near = p._near(codes, 0, d)
            assert near == (best, end) if best <= p.edits[0] // 8 else near is None


def template_rows(n: int, pairs: int) -> list[tuple[int, str]]:
    """Texts of one template at a similarity of about 0.786, and pairs of them at about 0.802."""
    rng = np.random.default_rng(11)
    base = [f"t{x}" for x in rng.integers(0, 9000, 420)]
    rows = []
    for k in range(n):
        rows.append((k, " ".join(base + [f"own{k}x{i}" for i in range(57)])))
    for k in range(pairs):
        shared = [f"both{k}x{i}" for i in range(4)]
        for side in (0, 1):
            rows.append((100_000 + 2 * k + side, " ".join(base + shared + [f"side{k}x{side}x{i}" for i in range(52)])))
    return rows


@pytest.mark.parametrize("most", [similar.ALL_PAIRS, 4])
def test_template_texts_link_only_where_similar(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "ALL_PAIRS", most)
    rows = template_rows(300, 30)
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t in (rows[0], rows[1], rows[-2], rows[-1])]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert 0.77 < alike(sets[0], sets[1]) < 0.8 <= alike(sets[2], sets[3]) < 0.82
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == {d: d if d < 100_000 else d - d % 2 for d, _ in rows}
