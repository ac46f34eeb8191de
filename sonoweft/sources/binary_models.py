"""Acoustic models in the common binary format of tagged values, read into tables: Gaussians, transitions,
phone names, trees and matrices.

Such a file has words in angle brackets, each with a blank behind it, and between them values that
say their own width: whole numbers (4 bytes), and vectors and matrices of single or double precision.
A model is a file, or the member ``final.mdl`` of a zip file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_FILE, PHONES_FILE, TREE_FILE, MATRIX_FILE = "final.mdl", "phones.txt", "tree", "lda.mat"
GAUSSIANS = pa.schema([("path", pa.string()), ("pdf", pa.int32()), ("g", pa.int32()), ("weight", pa.float64()), ("mean", pa.list_(pa.float64())), ("var", pa.list_(pa.float64()))])
TRANSITIONS = pa.schema([("path", pa.string()), ("tid", pa.int32()), ("phone_id", pa.int32()), ("state", pa.int32()), ("pdf", pa.int32()), ("loop_pdf", pa.int32()), ("idx", pa.int32()), ("to", pa.int32()), ("p", pa.float64())])
SYMBOLS = pa.schema([("path", pa.string()), ("phone", pa.string()), ("phone_id", pa.int32())])
TREE = pa.schema([("path", pa.string()), ("node", pa.int32()), ("key", pa.string()), ("yes_set", pa.list_(pa.string())), ("yes", pa.int32()), ("no", pa.int32()), ("leaf", pa.int32())])
MATRIX = pa.schema([("path", pa.string()), ("row", pa.int32()), ("values", pa.list_(pa.float64()))])
_TYPES = {pa.list_(pa.string()): "array<string>", pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}


class FormatError(ValueError):
    """Bytes that aren't a model of this format; says where."""


class Values:
    """The values of a binary file, one after the other."""

    def __init__(self, data: bytes, name: str = ""):
        if data[:2] != b"\0B":
            raise FormatError(f"{name}: not a binary model (text form, or another format)")
        self.data, self.at, self.name = memoryview(data), 2, name

    def fail(self, what: str) -> FormatError:
        return FormatError(f"{self.name}: {what} at byte {self.at}")

    def array(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        if n < 0 or self.at + size > len(self.data):
            raise self.fail(f"{n} values of {kind} don't fit")
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += size
        return out

    def word(self, *expected: str) -> str:
        window = bytes(self.data[self.at : self.at + 64])
        text, blank, _ = window.partition(b" ")
        found = text.decode("latin-1")
        if not blank or (expected and found not in expected):
            raise self.fail(f"expected {' or '.join(expected) or 'a word'}, found {found[:20]!r}")
        self.at += len(text) + 1
        return found

    def sized(self, width: int) -> None:
        if (got := int(self.array("u1", 1)[0])) != width:
            raise self.fail(f"a value of {got} bytes where {width} are expected")

    def whole(self) -> int:
        self.sized(4)
        return int(self.array("<i4", 1)[0])

    def real(self) -> float:
        width = int(self.array("u1", 1)[0])
        if width not in (4, 8):
            raise self.fail(f"a number of {width} bytes")
        return float(self.array(f"<f{width}", 1)[0])

    def wholes(self) -> np.ndarray:
        self.sized(4)
        return self.array("<i4", int(self.array("<i4", 1)[0]))

    def vector(self) -> np.ndarray:
        width = {"FV": 4, "DV": 8}[self.word("FV", "DV")]
        return self.array(f"<f{width}", self.whole()).astype(float)

    def matrix(self) -> np.ndarray:
        width = {"FM": 4, "DM": 8}[self.word("FM", "DM")]
        rows, columns = self.whole(), self.whole()
        if min(rows, columns) < 0:
            raise self.fail(f"a matrix of {rows} by {columns}")
        return self.array(f"<f{width}", rows * columns).astype(float).reshape(rows, columns)


def _topology(v: Values) -> dict[int, list[list[int]]]:
    """Where the transitions of each state of each phone lead."""
    v.word("<Topology>")
    phones, entry = v.wholes(), v.wholes()
    kinds = v.whole()
    own_loops = kinds == -1  # then each state has a class for its loop too
    shapes = []
    for _ in range(v.whole() if own_loops else kinds):
        states = []
        for _ in range(v.whole()):
            for _ in range(1 + own_loops):
                v.whole()
            states.append([(v.whole(), v.real())[0] for _ in range(v.whole())])
        shapes.append(states)
    v.word("</Topology>")
    if any(not 0 <= p < len(entry) or not 0 <= entry[p] < len(shapes) for p in phones):
        raise v.fail("a phone without a topology")
    return {int(p): shapes[entry[p]] for p in phones}


def transitions_of(v: Values) -> list[tuple]:
    """tid, phone_id, state, pdf, loop_pdf, idx, to, p: one for each transition of each tuple, in the file's order."""
    v.word("<TransitionModel>")
    shapes = _topology(v)
    fields = 4 if v.word("<Tuples>", "<Triples>") == "<Tuples>" else 3
    tuples = [tuple(v.whole() for _ in range(fields)) for _ in range(v.whole())]
    v.word("</Tuples>" if fields == 4 else "</Triples>")
    v.word("<LogProbs>")
    logs = v.vector()
    v.word("</LogProbs>")
    v.word("</TransitionModel>")
    out = []
    for phone, state, pdf, *loop in tuples:
        if phone not in shapes or not 0 <= state < len(shapes[phone]):
            raise v.fail(f"state {state} of phone {phone} isn't in the topology")
        out += [(phone, state, pdf, loop[0] if loop else pdf, i, to) for i, to in enumerate(shapes[phone][state])]
    if len(logs) != len(out) + 1:  # ids begin at 1
        raise v.fail(f"{len(logs) - 1} probabilities for {len(out)} transitions")
    return [(n, *row, float(np.exp(logs[n]))) for n, row in enumerate(out, 1)]


def gaussians_of(v: Values) -> list[tuple]:
    """pdf, g, weight, mean, var of the part behind the transitions; stored constants are left out, since they follow from these."""
    v.word("<DIMENSION>")
    dim = v.whole()
    v.word("<NUMPDFS>")
    out = []
    for pdf in range(v.whole()):
        v.word("<DiagGMM>", "<DiagGMMBegin>")
        if v.word("<GCONSTS>", "<WEIGHTS>") == "<GCONSTS>":
            v.vector()
            v.word("<WEIGHTS>")
        weights = v.vector()
        v.word("<MEANS_INVVARS>")
        scaled = v.matrix()
        v.word("<INV_VARS>")
        inverse = v.matrix()
        v.word("</DiagGMM>", "<DiagGMMEnd>")
        if not scaled.shape == inverse.shape == (len(weights), dim):
            raise v.fail(f"pdf {pdf} has parts of unlike sizes")
        out += [(pdf, g, float(w), (scaled[g] / inverse[g]).tolist(), (1 / inverse[g]).tolist()) for g, w in enumerate(weights)]
    return out


def tree_of(v: Values) -> list[dict]:
    """A tree's nodes as ``operators.trees`` has them, the root first; values are numbers as text.

    A node that has a child for each value becomes a chain of questions for one value each; a value
    without a child comes to a leaf of None.
    """
    v.word("ContextDependency")
    width, centre = v.whole(), v.whole()
    if not 0 <= centre < width <= 3 or (width > 1 and (width, centre) != (3, 1)):
        raise v.fail(f"a context of {width} phones around the one at {centre}")
    keys = {-1: "state", **({0: "phone"} if width == 1 else dict(enumerate(("left", "phone", "right"))))}
    nodes: list[dict] = []

    def key() -> str:
        if (k := v.whole()) not in keys:
            raise v.fail(f"a question about {k}")
        return keys[k]

    def add(**node: object) -> int:
        nodes.append({"id": len(nodes), **node})
        return len(nodes) - 1

    def child() -> int:
        kind = v.word("NULL", "CE", "TE", "SE")
        if kind == "NULL":
            return add(leaf=None)
        if kind == "CE":
            return add(leaf=v.whole())
        asked = key()
        if kind == "SE":
            at = add(key=asked, yes_set=frozenset(map(str, v.wholes())))
            v.word("{")
            nodes[at]["yes"], nodes[at]["no"] = child(), child()
            v.word("}")
            return at
        v.sized(252)  # a count without a sign has the width -4
        size = int(v.array("<u4", 1)[0])
        v.word("(")
        first = last = None
        for value in range(size):
            at = add(key=asked, yes_set=frozenset([str(value)]))
            nodes[at]["yes"] = child()
            if last is not None:
                nodes[last]["no"] = at
            first, last = at if first is None else first, at
        v.word(")")
        other = add(leaf=None)
        if last is not None:
            nodes[last]["no"] = other
        return other if first is None else first

    if v.word("ToPdf", "ToLength") == "ToLength":
        child()
        nodes.clear()
        v.word("ToPdf")
    child()
    v.word("EndContextDependency")
    return nodes


def _tree_rows(name: str, data: bytes) -> list[tuple]:
    return [(n["id"], n.get("key"), sorted(n["yes_set"]) if "key" in n else None, n.get("yes"), n.get("no"), n.get("leaf")) for n in tree_of(Values(data, name))]


def _all_gaussians(name: str, data: bytes) -> list[tuple]:
    v = Values(data, name)
    transitions_of(v)
    return gaussians_of(v)


def _symbols(name: str, data: bytes) -> list[tuple]:
    pairs = [line.split() for line in data.decode("utf-8").splitlines() if line.strip()]
    if any(len(p) != 2 or not p[1].lstrip("-").isdigit() for p in pairs):
        raise FormatError(f"{name}: a line that isn't a phone and its number")
    return [(phone, int(n)) for phone, n in pairs]


def _member(data: bytes, wanted: str, path: str) -> bytes:
    """The bytes of a file, or of the member of that name of a zip file (the one of least depth, then first by name)."""
    if data[:4] != b"PK\3\4":
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if n.rsplit("/", 1)[-1] == wanted), key=lambda n: (n.count("/"), n))
        if not names:
            raise FormatError(f"{path}: no {wanted} in the archive")
        return z.read(names[0])


def _read(spark: SparkSession, path: str, wanted: str, schema: pa.Schema, rows_of: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(name, *r) for r in rows_of(name, _member(data.as_py(), wanted, name))]
                columns = zip(*rows, strict=True) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{wanted},*.zip}}").load(path)
    return files.select("path", "content").mapInArrow(task, ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema))


def gaussians(spark: SparkSession, path: str) -> DataFrame:
    """path, pdf, g, weight, mean, var of every model at or below a path."""
    return _read(spark, path, MODEL_FILE, GAUSSIANS, _all_gaussians)


def transitions(spark: SparkSession, path: str) -> DataFrame:
    """path, tid, phone_id, state, pdf, loop_pdf, idx, to and p of every model at or below a path."""
    return _read(spark, path, MODEL_FILE, TRANSITIONS, lambda name, data: transitions_of(Values(data, name)))


def phones(spark: SparkSession, path: str) -> DataFrame:
    """path, phone and phone_id of every table of phones at or below a path."""
    return _read(spark, path, PHONES_FILE, SYMBOLS, _symbols)


def tree(spark: SparkSession, path: str) -> DataFrame:
    """path, node, key, yes_set, yes, no and leaf of every tree at or below a path."""
    return _read(spark, path, TREE_FILE, TREE, _tree_rows)


def nodes(found: DataFrame) -> list[dict]:
    """The nodes of one tree, as large as its file."""
    rows = found.orderBy("node").collect()
    return [{"id": r.node, "leaf": r.leaf} if r.key is None else {"id": r.node, "key": r.key, "yes_set": frozenset(r.yes_set), "yes": r.yes, "no": r.no} for r in rows]


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """path, row and values of every matrix of features at or below a path."""
    return _read(spark, path, MATRIX_FILE, MATRIX, lambda name, data: [(i, row.tolist()) for i, row in enumerate(Values(data, name).matrix())])


def probabilities(found: DataFrame, names: DataFrame) -> DataFrame:
    """phone, state, pdf, idx and p of one model's transitions, as ``operators.transitions.imported`` takes them."""
    return found.join(F.broadcast(names.select("phone_id", "phone")), "phone_id").select("phone", "state", "pdf", "idx", "p")
