"""Interval files: CTM lines and TextGrid texts, written and read."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVALS = "path string, tier string, idx int, xmin double, xmax double, label string"


def _seconds(ms: str) -> Column:
    """A column of whole milliseconds as seconds with three decimals, without binary rounding."""
    return F.concat(F.expr(f"{ms} div 1000").cast("string"), F.lit("."), F.lpad((F.col(ms) % 1000).cast("string"), 3, "0"))


def ctm(spans: DataFrame) -> DataFrame:
    """One column ``line``: ``utt 1 start duration label``, from (utt, xmin, xmax, label) in whole milliseconds."""
    rows = spans.withColumn("_length", F.col("xmax") - F.col("xmin"))
    return rows.select(F.concat_ws(" ", "utt", F.lit("1"), _seconds("xmin"), _seconds("_length"), "label").alias("line"))


def number_text(x: float) -> str:
    """A number as interval files write it: whole ones without a point, others as short as they read back."""
    if x == int(x) and abs(x) < 1e16:
        return str(int(x))
    return repr(float(x))


def textgrid_text(tiers: list[tuple[str, list[tuple[float, float, str]]]], duration: float) -> str:
    """The long form of interval tiers (the format is a fixed value)."""
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0 ", f"xmax = {number_text(duration)} ", "tiers? <exists> ", f"size = {len(tiers)} ", "item []: "]
    for k, (name, spans) in enumerate(tiers, 1):
        out += [f"    item [{k}]:", '        class = "IntervalTier" ', f"        name = {quote(name)} ", "        xmin = 0 ", f"        xmax = {number_text(duration)} ", f"        intervals: size = {len(spans)} "]
        for i, (a, b, label) in enumerate(spans, 1):
            out += [f"        intervals [{i}]:", f"            xmin = {number_text(a)} ", f"            xmax = {number_text(b)} ", f"            text = {quote(label)} "]
    return "\n".join(out) + "\n"


def short_textgrid_text(tiers: list[tuple[str, list[tuple[float, float, str]]]], duration: float) -> str:
    """The short form: the values of the long one in the same order, one a line (the format is a fixed value)."""
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "0", number_text(duration), "<exists>", str(len(tiers))]
    for name, spans in tiers:
        out += ['"IntervalTier"', quote(name), "0", number_text(duration), str(len(spans))]
        for a, b, label in spans:
            out += [number_text(a), number_text(b), quote(label)]
    return "\n".join(out) + "\n"


_TOKEN = re.compile(r'"((?:[^"]|"")*)"|<[a-z]+>|(?<![\w.\[])(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w\]])')


def decoded_text(data: bytes) -> str:
    """UTF-8, or UTF-16 where a byte-order mark says so."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    return data.decode("utf-8-sig", "replace")


def parsed_textgrid(text: str) -> list[tuple[str, int, float, float, str]]:
    """(tier, idx, xmin, xmax, label) of all interval tiers of a long or short file; point tiers are left out."""
    values = [m[1].replace('""', '"') if m[1] is not None else float(m[2]) if m[2] else None for m in _TOKEN.finditer(text)]
    values = [v for v in values if v is not None]
    if values[:2] != ["ooTextFile", "TextGrid"]:
        raise ValueError("not a TextGrid")
    at, out = 5, []
    for _ in range(int(values[4])):
        kind, name, n = values[at], values[at + 1], int(values[at + 4])
        at += 5
        step = 3 if kind == "IntervalTier" else 2
        for i in range(n):
            if step == 3:
                out.append((name, i, *values[at : at + 3]))
            at += step
    return out


def written(spans: DataFrame, duration: str = "duration", short: bool = False) -> DataFrame:
    """(utt, text): a TextGrid per utterance from (utt, tier, xmin, xmax, label, duration), in the long or the short form."""
    form = short_textgrid_text if short else textgrid_text
    grouped = spans.groupBy("utt").agg(F.max(duration).alias("d"), F.sort_array(F.collect_list(F.struct("tier", "xmin", "xmax", "label"))).alias("s"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for d, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tiers: dict[str, list] = {}
                for r in rows:
                    tiers.setdefault(r["tier"], []).append((r["xmin"], r["xmax"], r["label"] or ""))
                texts.append(form(list(tiers.items()), d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["utt", "text"])

    return grouped.mapInArrow(task, "utt string, text string")


def file_name(utt: str) -> str:
    """A file name for an utterance: other characters than letters, digits, ``.``, ``_`` and ``-`` as ``%`` and their code."""
    return re.sub(r"[^A-Za-z0-9._-]|^\.+$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), utt) + ".TextGrid"


def saved(texts: DataFrame, folder: str) -> DataFrame:
    """Writes each (utt, text) as a file below ``folder``, a URI that all executors see; returns utt, path, bytes when it is run.

    A file is written under another name and then moved to its place, so a task that is
    repeated leaves the same files and no reader sees half of one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for utt, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, name = text.encode("utf-8", "surrogatepass"), file_name(utt)
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part, compression=None) as f:
                    f.write(data)
                files.move(part, f"{root}/{name}")
                out.append((utt, f"{folder.rstrip('/')}/{name}", len(data)))
            kinds = [pa.string(), pa.string(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["utt", "path", "bytes"])

    return texts.select("utt", "text").mapInArrow(task, "utt string, path string, bytes long")


def read_back(texts: DataFrame) -> DataFrame:
    """The intervals of (path, content), content a binary or text column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(path, *r) for r in parsed_textgrid(decoded_text(data))]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INTERVALS.split(", ")])

    path, content = texts.columns
    return texts.select(path, F.col(content).cast("binary")).mapInArrow(task, INTERVALS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_back(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def ends(texts: DataFrame) -> DataFrame:
    """(path, duration) of (path, content): where the file says that it ends, null for one that can't be read."""
    path, content = texts.columns

    def end(data: bytes) -> float | None:
        text = decoded_text(data)
        numbers = (float(m[2]) for m in _TOKEN.finditer(text) if m[2])
        return next(itertools.islice(numbers, 1, None), None) if "ooTextFile" in text[:64] else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([end(x or b"") for x in b.column(1).to_pylist()], pa.float64())], names=[path, "duration"])

    return texts.select(path, F.col(content).cast("binary")).mapInArrow(task, f"{path} string, duration double")
