"""Exact copies, periodic runs and phrases against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sonoweft.llm import collocation, exact, queries, runs

from ..oracle import rows, sql_rows, views

DOCS = "doc_id long, text string, lang string, group long, rest string, carried string, rank long, f long"
EMPTY = "doc_id long, text string, lang string"


def table(spark, some):
    return spark.createDataFrame([(d, t, lang, 1, "x", None, 2, 3) for d, t, lang in some], DOCS).repartition(3)


# ---- exact copies

LONG = "".join(f"word{i % 977} " for i in range(30_000))
TEXTS = ["", None, "a", "ab", "ab ", "b" * 64, "b" * 65, "b" * 63, "b" * 64 + "c", LONG, LONG, LONG + "x", "é" * 40, "é" * 40, "é" * 40, "a", "\0", " "]


def test_exact_classes_equal_brute_force(spark):
    some = [(i, t, None) for i, t in enumerate(TEXTS)] + [(3, "ab", None), (3, "ab", None), (None, "a", None), (None, "alone", None), (None, "pair", None), (None, "pair", None)]
    members = defaultdict(list)
    for d, t, _ in some:
        members[t or ""].append(d)
    want = Counter()
    for t, ids in members.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, d in enumerate(sorted(ids, key=lambda i: i == keep, reverse=True)):
            want[(d, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    docs = table(spark, some)
    got = exact.classes(docs, {"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}).select("doc_id", "keep_id", "group_size", "kept", "carried.sha").collect()
    assert Counter(map(tuple, got)) == want
    left = exact.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == sorted(members)


def test_exact_of_a_hot_group_and_of_nothing(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same " * 100).otherwise(F.concat(F.lit("same " * 99), F.col("id"))).alias("text"))
    got = exact.classes(docs).where("group_size > 1").groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert [tuple(r) for r in got] == [(2997, 1000, 1, 1000)]
    assert exact.classes(docs.where("doc_id < 0")).count() == 0


# ---- periodic runs


def brute_runs(words):
    found, n = [], len(words)
    for q in range(1, n // runs.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(runs.LEAST, runs.TIMES * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digests(d, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if d is None else zlib.crc32(str(d).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        words: list[bytes] = []
        while len(words) < rng.randrange(1, 120):
            part = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 9))]
            words += part * rng.randrange(1, 9) + part[: rng.randrange(len(part) + 1)]
        texts.append(words)
    texts += [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"a", b"b"] * 3 + [b"a"]]
    assert [list(map(tuple, f.tolist())) for f in runs.find(texts)] == [brute_runs(t) for t in texts]


def test_branching_squares_are_all_found():
    rng = random.Random(1)
    for _ in range(60):
        line = [rng.randrange(3) for _ in range(rng.randrange(2, 60))]
        symbols = runs.np.array([*line, 9])
        start, half = runs.branching_squares(runs.suffix_ranks(symbols), len(symbols))
        s = [*line, 9]
        want = {(i, d) for d in range(1, len(line)) for i in range(len(line) - 2 * d + 1) if s[i : i + d] == s[i + d : i + 2 * d] and s[i + d] != s[i + 2 * d]}
        assert set(zip(start.tolist(), half.tolist(), strict=True)) == want


def test_a_long_text_of_one_word():
    found = runs.find([[b"na"] * 200_000, [b"a", b"b", b"c"] * 50_000])
    assert [f.tolist() for f in found] == [[[0, 200_000, 1]], [[0, 150_000, 3]]]


def test_periodic_runs_of_documents(spark, data):
    plain = [(d, t, None) for d, t in [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n "), (4, "x\x0by\x0cx\x0by x y x y x y"), (5, "n n n n " * 9), (5, "n n n n " * 9)]]
    plain += [(d, "the river ran on " * 3 + f"and on {d}", None) for d in range(100, 160)]
    got = runs.digests(runs.periodic_runs(runs.planted(table(spark, plain)))).collect()
    assert Counter(map(tuple, got)) == Counter(brute_digests(d, t) for d, t, _ in plain)
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    some = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 700}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, data).collect()}
    assert len(got) == len(docs) and {d: got[d] for d in some} == {d: brute_digests(d, t) for d, t in some.items()}
    assert runs.periodic_runs(spark.createDataFrame([], EMPTY)).count() == 0


# ---- phrases


def brute_phrases(docs, limit, least):
    counts: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, p, left, right))
        dropped = {p[i : i + m] for _, fp, p, _, _ in found for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * fp >= 80 * f[p[i : i + m]]}
        left_over = sorted((-s, -a, " ".join(p).encode(), le, r) for s, a, p, le, r in found if p not in dropped)
        out += [(lang, k + 1, p.decode(), -a, le, r, n, -s) for k, (s, a, p, le, r) in enumerate(left_over[:limit])]
    return sorted(out)


def phrase_docs(seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "delta", "ÉTÉ", "été", "nu nu", "x\x1cy", "zeta", "eta", "\0", "-"]
    fixed = [" ".join(rng.choices(vocabulary, k=rng.randrange(2, 6))) for _ in range(12)]
    out = []
    for i in range(400):
        text = "".join(rng.choice([*fixed, *vocabulary]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(0, 60)))
        out.append((i if i % 7 else None, text, rng.choice(["en", "en", None, "und", "fr", ""])))
    return out + [(1, None, "en"), (2, "", None), (3, "only once here", "de"), (4, "one two " * 4000, "en")]


@pytest.mark.parametrize("seed, limit", [(0, 5), (1, 2000)])
def test_phrases_equal_brute_force(spark, seed, limit):
    docs = phrase_docs(seed)
    got = collocation.collocations(table(spark, docs), limit=limit, least=10)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, limit, 10)


def test_phrases_in_many_small_rounds(spark):
    docs = phrase_docs(3)
    got = collocation.collocations(table(spark, docs), limit=3, least=40, batch=25)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, 3, 40)
    assert collocation.collocations(spark.createDataFrame([], EMPTY)).count() == 0


# ---- SQL


@pytest.mark.parametrize("name", ["op11_radix_exact_dedup", "op13_phrase_collocations"])
def test_equals_sql(spark, data, name):
    folder = data if name.startswith("op11") else "/root/testdata/sf0.01"
    assert rows(queries.queries()[name](spark, folder)) == sql_rows(views(folder), queries.oracle_sql()[name])


# ---- WARC members that begin with something else


def _member_record(n):
    from sonoweft.llm import warc

    block = b"payload %d" % n
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Block-Digest: sha1:{warc.base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("first", [b"junk before the records\r\n", _member_record(0).replace(b"payload 0", b"damaged 0"), b""])
@pytest.mark.parametrize("around", [b"", b"WARC/1.1 broken\r\n"])
def test_a_member_whose_first_bytes_are_no_good_record(first, around):
    import gzip

    from sonoweft.llm import warc

    data = around + gzip.compress(first + _member_record(1) + _member_record(2)) + around
    got = list(warc.salvage(data))
    assert [r["record_id"] for _, _, r, _ in got if r] == ["<urn:x:1>", "<urn:x:2>"]
    assert sum(n for _, n, _, _ in got) == len(data)
    assert any(why and "in a member" in why for *_, why in got) == bool(first)
