"""Models of the binary format, written here by hand and read back."""

from __future__ import annotations

import struct
import zipfile

import numpy as np
import pytest

from sonoweft.operators import transitions, trees
from sonoweft.sources import binary_models as bm


def whole(n):
    return b"\4" + struct.pack("<i", n)


def wholes(ns):
    return b"\4" + struct.pack(f"<i{len(ns)}i", len(ns), *ns)


def vector(x, kind="f"):
    return kind.upper().encode() + b"V " + whole(len(x)) + np.asarray(x, f"<f{4 if kind == 'f' else 8}").tobytes()


def matrix(x, kind="f"):
    return kind.upper().encode() + b"M " + whole(x.shape[0]) + whole(x.shape[1]) + np.asarray(x, f"<f{4 if kind == 'f' else 8}").tobytes()


#: Two shapes: one state with a loop and an exit; two states, the first with a way past the second.
SHAPES = [[[(0, 0.5), (1, 0.5)]], [[(0, 0.5), (1, 0.25), (2, 0.25)], [(1, 0.5), (2, 0.5)]]]
TUPLES = [(1, 0, 0, 3), (2, 0, 1, 1), (2, 1, 2, 2)]


def model(kind="f", own_loops=True, constants=True):
    rng = np.random.default_rng(4)
    topo = b"<Topology> " + wholes([1, 2]) + wholes([-1, 0, 1]) + (whole(-1) if own_loops else b"") + whole(2)
    for states in SHAPES:
        topo += whole(len(states))
        for n, out in enumerate(states):
            topo += whole(n) * (1 + own_loops) + whole(len(out)) + b"".join(whole(to) + b"\4" + struct.pack("<f", p) for to, p in out)
    topo += b"</Topology> "
    tag = b"Tuples" if own_loops else b"Triples"
    tuples = b"<" + tag + b"> " + whole(3) + b"".join(whole(x) for t in TUPLES for x in t[: 4 if own_loops else 3]) + b"</" + tag + b"> "
    p = np.array([1.0, 0.7, 0.3, 0.2, 0.5, 0.3, 0.9, 0.1])
    data = b"\0B<TransitionModel> " + topo + tuples + b"<LogProbs> " + vector(np.log(p), kind) + b"</LogProbs> </TransitionModel> "
    data += b"<DIMENSION> " + whole(3) + b"<NUMPDFS> " + whole(2)
    want = []
    for pdf, n in enumerate((1, 2)):
        mean, var, w = rng.normal(size=(n, 3)), rng.uniform(0.5, 2, (n, 3)), np.full(n, 1 / n)
        data += b"<DiagGMM> " + (b"<GCONSTS> " + vector(np.zeros(n)) if constants else b"") + b"<WEIGHTS> " + vector(w, kind)
        data += b"<MEANS_INVVARS> " + matrix(mean / var, kind) + b"<INV_VARS> " + matrix(1 / var, kind) + b"</DiagGMM> "
        want += [(pdf, g, w[g], mean[g], var[g]) for g in range(n)]
    return data, p[1:], want


@pytest.mark.parametrize("kind, own_loops, constants", [("f", True, True), ("d", True, False), ("f", False, False)])
def test_values(kind, own_loops, constants):
    data, p, want = model(kind, own_loops, constants)
    v = bm.Values(data, "m")
    rows = bm.transitions_of(v)
    shape = {1: SHAPES[0], 2: SHAPES[1]}
    expected = [(ph, s, pdf, loop if own_loops else pdf, i, to) for ph, s, pdf, loop in TUPLES for i, (to, _) in enumerate(shape[ph][s])]
    assert [r[:7] for r in rows] == [(n, *e) for n, e in enumerate(expected, 1)]
    np.testing.assert_allclose([r[7] for r in rows], p, rtol=1e-6)
    got = bm.gaussians_of(v)
    assert v.at == len(data) and [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        np.testing.assert_allclose(g[3], w[3], rtol=1e-5)
        np.testing.assert_allclose(g[4], w[4], rtol=1e-5)


def test_damaged_bytes_are_named():
    data, _, _ = model()
    for bad in (b"", b"<TransitionModel> ", b"\0B<DIMENSION> ", *[data[:n] for n in range(2, len(data), 7)], data.replace(b"<LogProbs>", b"<LogProbz>")):
        with pytest.raises(bm.FormatError, match="^m: "):
            bm._all_gaussians("m", bad)
    with pytest.raises(bm.FormatError, match="isn't a phone"):
        bm._symbols("m", b"a 1\nb\n")


def test_folders_and_archives(spark, tmp_path):
    data, p, want = model()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "final.mdl").write_bytes(data)
    (tmp_path / "one" / "phones.txt").write_text("<eps> 0\naa 1\nbb 2\n")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("m/final.mdl", data)
        z.writestr("m/phones.txt", "<eps> 0\naa 1\nbb 2\n")
        z.writestr("m/deeper/final.mdl", b"not this one")
    every = bm.gaussians(spark, f"file://{tmp_path}").orderBy("path", "pdf", "g").collect()
    assert [(r.pdf, r.g) for r in every] == [w[:2] for w in want] * 2
    np.testing.assert_allclose([r.mean for r in every[:3]], [w[3] for w in want], rtol=1e-5)
    for at in (f"file://{tmp_path}/one", f"file://{tmp_path}/two.zip"):
        foreign = bm.probabilities(bm.transitions(spark, at), bm.phones(spark, at))
        assert foreign.count() == 7
        mine = [({1: "aa", 2: "bb"}[ph], s, pdf, i, to) for ph, s, pdf, _ in TUPLES for i, (to, _) in enumerate({1: SHAPES[0], 2: SHAPES[1]}[ph][s])]
        trans = spark.createDataFrame([(*m, 0.5) for m in mine], "phone string, state int, pdf int, idx int, to int, p double")
        got = {(r.phone, r.state, r.pdf, r.idx): r.p for r in transitions.imported(trans, foreign).collect()}
        np.testing.assert_allclose([got[m[:4]] for m in mine], p, rtol=1e-6)
    with zipfile.ZipFile(tmp_path / "bare.zip", "w") as z:
        z.writestr("readme", "nothing")
    with pytest.raises(Exception, match="no final.mdl in the archive"):
        bm.gaussians(spark, f"file://{tmp_path}/bare.zip").collect()


def leaf(n):
    return b"CE " + whole(n)


def split(key, yes, a, b):
    return b"SE " + whole(key) + wholes(yes) + b"{ " + a + b + b"} "


def table(key, children):
    return b"TE " + whole(key) + b"\xfc" + struct.pack("<I", len(children)) + b"( " + b"".join(children) + b") "


def context_tree():
    """Phone 1 by its neighbours and state, phone 2 by its state."""
    one = split(0, [2], leaf(0), split(2, [1, 2], table(-1, [leaf(1), leaf(2)]), leaf(3)))
    return b"\0BContextDependency " + whole(3) + whole(1) + b"ToPdf " + table(1, [b"NULL ", one, table(-1, [leaf(4), leaf(5)])]) + b"EndContextDependency "


def hand_answer(left, phone, right, state):
    if phone == 1:
        if left == 2:
            return 0
        return {0: 1, 1: 2}.get(state) if right in (1, 2) else 3
    return {0: 4, 1: 5}.get(state) if phone == 2 else None


def test_trees_and_matrices(spark, tmp_path):
    (tmp_path / "tree").write_bytes(context_tree())
    m = np.arange(6.0).reshape(2, 3)
    (tmp_path / "lda.mat").write_bytes(b"\0B" + matrix(m, "d"))
    assert [r["values"] for r in bm.matrices(spark, f"file://{tmp_path}").orderBy("row").collect()] == m.tolist()
    nodes = bm.nodes(bm.tree(spark, f"file://{tmp_path}"))
    assert nodes == bm.tree_of(bm.Values(context_tree()))
    every = [(a, b, c, s) for a in range(4) for b in range(4) for c in range(4) for s in range(3)]
    events = spark.createDataFrame([*every, *every[:7], (None, 1, None, 0)], "left int, phone int, right int, state int")
    got = trees.walked(events, nodes).collect()
    assert len(got) == len(every) + 8
    for r in got:
        assert r.pdf == hand_answer(r.left, r.phone, r.right, r.state)
    values = {k: [str(i) for i in range(4)] for k in trees.KEYS}
    joined = trees.answered(events.where("left IS NOT NULL"), trees.tables(spark, nodes, values)).collect()
    assert sorted(joined, key=str) == sorted((r for r in got if r.left is not None), key=str)
    assert trees.walked(events.where("left > 9"), nodes).count() == 0
    data = context_tree()
    for bad in (data[:n] for n in range(2, len(data), 5)):
        with pytest.raises(bm.FormatError):
            bm.tree_of(bm.Values(bad))
    alone = b"\0BContextDependency " + whole(1) + whole(0) + b"ToLength NULL ToPdf " + split(0, [1], leaf(0), leaf(1)) + b"EndContextDependency "
    assert bm.tree_of(bm.Values(alone))[0]["key"] == "phone"
    with pytest.raises(bm.FormatError, match="context of 5"):
        bm.tree_of(bm.Values(alone.replace(whole(1) + whole(0), whole(5) + whole(2), 1)))
