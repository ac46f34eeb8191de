"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonoweft.llm import chat, components, decontam, lm, media, packing, queries, sharding, shared, similar, simhash, tokenfile, tokens, toxicity, warc

DOCS = "doc_id long, text string, score double, fp string, _hash long, shard int"
LONG = "".join(f"word{i % 977} " for i in range(30_000))
RIVER = "the river ran over stone 7 and the mill turned " * 3000
ROWS = [
    (1, "The quick brown fox. Jumps over it!\nAnd on", 1.0, "x", 1, 1),
    (2, None, None, None, None, None),
    (3, "", 0.0, "", 0, 0),
    (4, "  \t\n ", 0.0, "", 0, 0),
    (5, LONG, 0.0, "", 0, 0),
    (1, "The quick brown fox. Jumps over it!\nAnd on", 1.0, "x", 1, 1),
    (None, "no id here, at all", 0.0, "", 0, 0),
    (7, "ÀÉ ñandú Straße \U0001f600 <|endoftext|> it's  two  blanks \0 nul", 0.0, "", 0, 0),
    (8, "fox", 0.0, "", 0, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("file, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_encode_like_whole_texts(spark, data, file, kind):
    path = queries.vocabulary(file)
    whole = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(150).collect()] + [r[1] for r in ROWS]
    texts += ["a  b", "a \n b", "\n\na", "x.\ny", "a b ́c", "don't we'll 's", "end. ", "A.B., C:;", "　a b", "a<|endoftext|>b <|endoftext|>\nc.<|startoftext|>", "é.. ñ-(x) ʃ. a.'s b!!'", "\0", "x \0<|endoftext|> y", "a\x1cb c\x85 d", " a b ", "\ufeffx y\u200b z"]
    flat, starts = tokens.encoder(path, kind).encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    folder = shared.new_path(spark, "t")
    manifest = tokenfile.write(docs, folder, path)
    got = tokenfile.read_digests(manifest, folder).collect()
    assert len(got) == len(ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    assert next(r for r in got if r.doc_id == 2).n_tokens == 1
    whole, ends = Tokenizer.from_file(path), {}
    for d, ids in sorted(((r[0], whole.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in ROWS), key=lambda x: (x[0] is not None, x[0])):
        ends.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d, want in ends.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == d) == sorted(want)
    some = tokenfile.read_documents(manifest, folder, spark.createDataFrame([(8,), (99,)], "doc_id long")).collect()
    want = Tokenizer.from_file(path).encode("fox", add_special_tokens=False).ids + [2]
    assert [(r.doc_id, r.ids) for r in some] == [(8, want)]
    assert tokenfile.round_trip(spark, none, path).count() == 0


def test_token_files_equal_the_library(spark, data):
    path = queries.vocabulary("byte_bpe_50k.json")
    whole, at = Tokenizer.from_file(path), 0
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op9_token_files(spark, data).collect()}
    assert len(got) == len(table)
    for r in table:
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_a_damaged_frame_is_noticed(tmp_path):
    import pyarrow.fs as pafs

    files = pafs.LocalFileSystem()
    w = tokenfile.FrameWriter(files.open_output_stream(str(tmp_path / "x"), compression=None))
    for i in range(3):
        w.add(i, np.arange(i * 50 + 1, dtype="<u4").tobytes())
    w.close()
    data = bytearray((tmp_path / "x").read_bytes())
    reader = tokenfile.FrameReader(files.open_input_file(str(tmp_path / "x")))
    assert [len(b) // 4 for _, b in reader.frames(np.array([0, 2]))] == [1, 101]
    data[int(reader.at[1]) + 12] ^= 255
    (tmp_path / "x").write_bytes(data)
    reader = tokenfile.FrameReader(files.open_input_file(str(tmp_path / "x")))
    assert len(list(reader.frames(np.array([0, 2])))) == 2
    with pytest.raises(Exception):
        list(reader.frames(np.array([1])))


def test_packing(spark, docs, none):
    path = queries.vocabulary("word_bpe_49k.json")
    got = packing.pack(packing.cut(docs, path)).collect()
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == math.ceil(sum(r.length for r in got) / 2048)
    assert packing.pack(packing.cut(none, path)).count() == 0
    whole = packing.sequences(packing.pack(packing.cut(docs, path))).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in got) and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_best_two_fit_replaces_the_smallest():
    # greedy takes 6, then 3; 3 gives way to 2 and 2, which fill the bin
    bins = packing.pack_counts({6: 1, 3: 1, 2: 2}, 10)
    assert bins[0] == (1, [(6, 1), (2, 2)])


@pytest.mark.parametrize("seed", range(6))
def test_packing_counts_keeps_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 12, 300), strict=True)}
    bins = packing.pack_counts(counts, 2048)
    used = Counter()
    for n, held in bins:
        assert sum(k * m for k, m in held) <= 2048
        for k, m in held:
            used[k] += n * m
    assert used == Counter(counts)
    gaps: list[int] = []  # best fit, longest first
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits)[1]] -= length
        else:
            gaps.append(2048 - length)
    assert sum(n for n, _ in bins) <= 1.005 * len(gaps) + 1


def brute_fingerprint(text, width=3, seed=42):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    want = Counter((r[0], brute_fingerprint(r[1])) for r in ROWS)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == want
    of = {r.doc_id: r.component_id for r in got}
    assert of[2] == of[3] == of[4] == 2 and of[None] is None and of[1] == 1
    assert simhash.near_duplicates(none).count() == 0
    stay = simhash.one_of_each(docs, replicas=3)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter([1, 2, None, 5, 7, 8])


def test_covering_masks_miss_no_pair():
    for radius in (2, 4):
        masks = simhash.covering_masks(radius)
        rng = np.random.default_rng(radius)
        for _ in range(500):
            flips = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(not (flips & m) for m in masks)


@pytest.mark.parametrize("radius", [2, 4])
def test_links_equal_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    values = set(base)
    for b in base[:20]:
        for _ in range(12):
            x = b
            for i in rng.choice(64, int(rng.integers(1, radius + 2)), replace=False):
                x = (x ^ 1 << int(i)) & (1 << 64) - 1
            values.add(x - (1 << 64) if x >= 1 << 63 else x)
    values = sorted(values)
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert all(got.get(v, v) == root(v) for v in values)


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components.connected_components(links).collect()} == {0}
    assert components.connected_components(links.where("a < 0")).count() == 0


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in ROWS)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none).count() == 0


def test_a_hot_group_is_shared_out_and_small_groups_stay_together(spark):
    rows = [(i, "the same text over and over") for i in range(3000)] + [(10_000 + i, f"text number {i // 2} of these") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, n = Counter(), Counter()
    for r in got:
        size[r.shard] += r.size
        n[r.shard] += 1
    assert len(n) == 16
    assert max(size.values()) < 1.03 * sum(size.values()) / 16 and max(n.values()) < 1.03 * len(rows) / 16
    groups: dict[int, set] = {}
    for r in got:
        if r.doc_id >= 10_000:
            groups.setdefault((r.doc_id - 10_000) // 2, set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_ranks(spark):
    df = spark.createDataFrame([(k, i) for k in (None, 1, 2) for i in range(50)] + [(1, 3)], "k int, o int").repartition(5)
    got = shared.ranked(df, ["k"], ["o"], "r").collect()
    for k, n in ((None, 50), (1, 51), (2, 50)):
        assert [r["rank"] for r in sorted((r for r in got if r.k == k), key=lambda r: r["rank"])] == list(range(n))
        ordered = [r.o for r in sorted((r for r in got if r.k == k), key=lambda r: r["rank"])]
        assert ordered == sorted(ordered)


PASSAGE = "Near the old mill a grey heron waited all morning for the river to clear, and nobody in the village saw it leave again."


def test_decontamination(spark, docs, none):
    edited = PASSAGE.replace("grey", "gray").replace("nobody", "no body").upper()
    rows = [(11, f"before {PASSAGE} after"), (12, f"x {edited}. y"), (13, PASSAGE[:60]), (14, LONG + PASSAGE), (None, PASSAGE), (15, "clean words only")]
    d = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "too short"), (5, PASSAGE)], "item_id long, text string")
    got = decontam.hits(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, i) for k in (11, 12, 14, None) for i in (1, 5)}
    exact = next(r for r in got if r.doc_id == 11)
    assert exact.edits == 0 and rows[0][1][exact.start : exact.end].strip(" .") == PASSAGE.strip(" .")
    assert next(r for r in got if r.doc_id == 12).edits == 2
    kept = decontam.clean(d, bench)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 13, 15, None}
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.hits(d, bench.limit(0)).count() == 0 and decontam.hits(none, bench).count() == 0


def test_short_long_and_repeated_passages(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(200_000)]
    whole = " ".join(words)  # 1.4 M characters
    edited = list(whole)
    for at in rng.choice(len(edited), 40_000, replace=False):
        edited[at] = "z"
    bench = spark.createDataFrame([(1, "the heron left at noon."), (2, whole), (3, "oh oh oh " * 40), (4, "tiny")], "item_id long, text string")
    rows = [(1, "So: the HERON left, at noon!"), (2, "x " + "".join(edited)), (3, "oh " * 10_000), (4, "a tiny thing"), (5, "nothing of it"), (6, "and " + " ".join(words[1000:3000]) + " on")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.hits(d, bench).collect()} == {(1, 1), (2, 2), (3, 3), (6, 2)}
    monkeypatch.setattr(decontam, "POSTINGS", 500)
    p = decontam.Passages([(3, "oh oh oh " * 40), (1, "the heron left at noon.")])
    assert {i for _, i, *_ in decontam._hits([t for _, t in rows[:1]] + ["oh " * 3000], p)} == {1, 3}


def edit_distance(a, text):
    row = [0] * (len(text) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcde fghi jklm")
    items = [(i, "".join(rng.choice(letters, 90)).strip()) for i in range(6)]
    texts = []
    for k in range(60):
        t = list(items[k % 6][1])
        for _ in range(int(rng.integers(0, 16))):
            at = int(rng.integers(len(t)))
            kind = rng.integers(3)
            if kind == 0:
                t[at] = str(rng.choice(letters))
            elif kind == 1:
                t.insert(at, str(rng.choice(letters)))
            else:
                t.pop(at)
        texts.append("".join(rng.choice(letters, 50)) + "".join(t) + "".join(rng.choice(letters, 50)))
    p = decontam.Passages(items)
    got = {(k, i) for k, i, *_ in decontam._hits(texts, p)}
    form = lambda s: "".join(map(chr, decontam.normal_form(s)[0]))
    want = {(k, i) for k, t in enumerate(texts) for n, (i, s) in enumerate(items) if edit_distance(form(s), form(t)) <= p.edits[n]}
    assert got == want


def test_every_block_of_a_benchmark_is_searched(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(i, " ".join("".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(12))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string").coalesce(1)
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(pickle.dumps(value)) or send(value))
    got = decontam.hits(d, bench, block_bytes=300).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i, _ in items]
    # a worker that is used again drops each block before it opens the next
    searched = [i for block in sent for i, _ in decontam._passages(pickle.loads(block), (8, 0.1)).items]
    assert len(sent) > 5 and sorted(searched) == [i for i, _ in items]


def test_language_model(spark, docs, none):
    held = toxicity.remainder("doc_id", 10) == 0
    for order in (1, 2, 3, 4):
        got = lm.score(docs, held, order=order, block_size=2000).collect()
        assert len(got) == len(ROWS)
        is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        cut = [[w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) if w] for r in ROWS]
        grams, before = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for r, words in zip(ROWS, cut, strict=True):
            if not is_held(r[0]):
                line = ["<s>", *words, "</s>"]
                for i in range(len(line)):
                    for k in range(min(order, i + 1)):
                        if i or k:
                            grams[k][tuple(line[i - k : i + 1])] += 1
                        if i < len(line) - 1:
                            before[k][tuple(line[i - k : i + 1])] += 1
        n, v = sum(grams[0].values()), len(grams[0])

        def p(context, word):
            if not context:
                return (grams[0][(word,)] + 0.1) / (n + 0.1 * (v + 1))
            return (grams[len(context)][(*context, word)] + 4 * p(context[1:], word)) / (before[len(context) - 1][context] + 4)

        want = Counter()
        for r, words in zip(ROWS, cut, strict=True):
            line = ["<s>", *words, "</s>"]
            s = sum(math.log10(p(tuple(line[max(0, i - order + 1) : i]), line[i])) for i in range(1, len(line)))
            b = sum(math.log10(p((), w)) for w in line[1:])
            want[r[0], is_held(r[0]), len(line) - 1, sum(grams[0][(w,)] > 0 for w in line[1:]), n, round(b, 4), round(s, 4)] += 1
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert lm.score(none, held).count() == 0


def test_toxicity(spark, docs, none):
    clean = [f"the river ran over stone {i} and the mill turned" for i in range(60)]
    toxic = [f"the river you foul vermin{'abcdefg'[i % 7]} ran over stone {i}" for i in range(60)]
    net = toxicity.train(clean + toxic, [0] * 60 + [1] * 60, rounds=2, steps=30)
    got = toxicity.score(docs, net)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3] == by[4] and by[2] < 0.3
    fresh = spark.createDataFrame([(1, RIVER + "you foul verminx " + RIVER), (2, RIVER)], "doc_id long, text string")
    far = {r.doc_id: r.score for r in toxicity.score(fresh, net).collect()}
    assert far[1] > 0.5 > 0.3 > far[2]
    assert toxicity.score(none, net).count() == 0
    one_class = toxicity.fit(docs, spark.createDataFrame([(1, 0), (1, 0), (8, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, one_class).collect()} == {1 / (1 + math.exp(30))}


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        start, _ = toxicity.windows_of(np.array([n]))
        seen = {w for s in start for w in range(s, min(n, s + toxicity.WINDOW))}
        assert len(seen) == n and len(start) >= 1


def test_network_gradients_are_right():
    net = toxicity.train(["a b c", "d e f"], [0, 1], rounds=1, steps=1)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (5, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    ids = rng.integers(-1, 5, (3, toxicity.WINDOW))
    y = np.array([0, 1, 1], np.float32)

    def loss():
        p = toxicity._sigmoid(net.logits(ids, net.project(x)).astype(np.float64))
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads, dx = toxicity._backward(net, x, ids, y)
    for name in ("f_u", "b_x", "att", "query", "out", "f_b"):
        flat, g = net.w[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(flat.size, 3):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(float(g[i]), rel=0.1, abs=2e-4)


def test_chats(spark):
    rows = [(1, 0, "user", "Hi \\# </turn> <\\/turn> ###"), (1, 1, "assistant", "a\n### user: b</turn>\n"), (2, 0, None, None), (3, 1, "assistant", "two"), (3, 0, "a:b \\", "one"), (3, 1, "assistant", "two"), (None, 0, "user", "x"), (4, 0, "system", ""), (4, 1, "user", "q"), (4, 2, "assistant", "r" * 50_000), (5, 0, "user\nassistant", "one role"), (6, 0, "r:\\" * 40_000, "long role"), (7, 0, "user", "x" * 25_000_000), (7, 1, "assistant", '\\"{#' * 200_000), (8, 0, "user assistant", "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string")
    chats = chat.formatted(chat.canonical(chat.records_of(df)))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for key in (1, 2, 3, 4, 5, 6, 7, 8, None):
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == key)
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = next(r.formatted for r in chats.collect() if r.conv_id == 1)
    assert text.count("</turn>") == 2 and text.count("### ") == 2
    assert chat.digests(chat.formatted(chat.canonical(chat.records_of(df.limit(0))))).count() == 0


def test_fingerprints_go_by_nested_paths(spark):
    rows = ['{"messages":[{"role":"user","content":"x"},{"content":null,"role":"y"}]}', '{"messages":[{"role":"user","text":"x"}]}', "not json", None, "[]", '{"prompt":1,"completion":"b"}', '{"completion":"b","prompt":"a"}', '{ "messages" : [ {"role" : "a, [\\"]: {", "content" : ""} , {"role":"u","content":"}"}] }', '{"messages":[]}', '{"messages":["x",""]}', '{"prompt":"a","completion":"b']
    got = chat.canonical(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, record string")).orderBy("i").collect()
    assert [r.layout for r in got] == ["messages", None, None, None, None, "prompt", "prompt", "messages", None, None, None]
    assert [(t.role, t.text) for t in got[7].turns] == [('a, ["]: {', ""), ("u", "}")]
    assert [t.text for t in got[0].turns] == ["x", ""] and got[1].turns is None and got[6].turns[0].text == "a"


def test_formatting_stays_in_the_jvm(spark, data):
    plan = queries.op3_schema_chats(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_warc(spark, none):
    pages = [(1, "u\r\nv", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (4, "u", ""), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000), (None, "u", "alone"), (6, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\x1f\x8b\x08")]
    df = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, record_id string")
    for compress in (True, False):
        folder = shared.new_path(spark, "w")
        files = warc.write(warc.page_records(df), folder, compress=compress)
        back = warc.read(spark, warc.written(files, folder))
        assert warc.gaps(back).count() == 0
        got = Counter((r.page, r.record_type, r.payload_bytes, r.payload_digest, r.to) for r in warc.records(back).select("*", warc.page_id(F.col("record_id")).alias("page"), warc.page_id(F.col("refers_to")).alias("to")).collect())
        want = Counter()
        for page, _, html in pages:
            data = (html or "").encode()
            top = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
            response = page == top or top is None
            want[page, "response" if response else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if response else top] += 1
        assert got == want
    assert warc.write(warc.page_records(df.limit(0)), shared.new_path(spark, "w")).count() == 0
    assert warc.read(spark, []).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_what_follows_damage(compress):
    made = []
    for i in range(12):
        body = b"body %d WARC/1.0 \x1f\x8b\x08 " % i * 30
        made.append(warc.record_bytes("response", f"<urn:{i}>", "http://x", body, warc.base32_sha1(body), len(body), None))
    parts = [gzip.compress(m) for m in made] if compress else made
    data, starts = b"".join(parts), np.cumsum([0, *map(len, parts)])
    rng = np.random.default_rng(4)
    for _ in range(60):
        hurt = bytearray(data)
        at = int(rng.integers(len(data)))
        kind = rng.integers(3)
        if kind == 0:
            hurt[at] ^= int(rng.integers(1, 256))
            touched = {int(np.searchsorted(starts, at, "right")) - 1}
        elif kind == 1:
            hurt = hurt[:at]
            touched = set(range(int(np.searchsorted(starts, at, "right")) - 1, 12))
        else:
            hurt[at:at] = rng.bytes(40)
            touched = {int(np.searchsorted(starts, at, "right")) - 1}
        out = list(warc.salvage(bytes(hurt)))
        assert sum(length for _, length, _, _ in out) == len(hurt)
        ids = {r["record_id"] for _, _, r, _ in out if r}
        assert {f"<urn:{i}>" for i in range(12) if i not in touched} <= ids
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk")) == [(0, 4, None, "no version line")]


@pytest.mark.parametrize("compress", [True, False])
def test_headers_of_any_length_are_read(compress):
    url, body = "http://x/" + "long" * 25_000 + "\x01" * 20_000, b"page"
    digest = warc.base32_sha1(body)
    made = [warc.record_bytes(kind, f"<urn:page:{i}>", url, body, digest, len(body), to) for i, (kind, to) in enumerate([("response", None), ("revisit", "<urn:page:0>"), ("response", None)])]
    out = list(warc.salvage(b"".join(gzip.compress(m) if compress else m for m in made)))
    assert [(r["record_id"], r["payload_bytes"], r["refers_to"]) for _, _, r, reason in out if not reason] == [("<urn:page:0>", 4, None), ("<urn:page:1>", 4, "<urn:page:0>"), ("<urn:page:2>", 4, None)]
    assert all(r["target"] == "http://x/" + "long" * 25_000 + "%01" * 20_000 for _, _, r, _ in out)


def test_members_of_many_records_and_damaged_ones():
    made = []
    for i in range(6):
        body = b"body %d " % i * 400 + bytes(np.random.default_rng(i).integers(0, 256, 3000, dtype=np.uint8))
        made.append(warc.record_bytes("response", f"<urn:{i}>", "http://x", body, warc.base32_sha1(body), len(body), None))
    ids = lambda out: [r["record_id"] for _, _, r, _ in out if r]
    whole = gzip.compress(b"".join(made))
    out = list(warc.salvage(whole + whole))
    assert ids(out) == [f"<urn:{i}>" for i in range(6)] * 2 and sum(n for _, n, _, _ in out) == 2 * len(whole)
    out = list(warc.salvage(gzip.compress(made[0] + b"junk" + made[1][:-9] + b"x" + made[1][-8:] + made[2])))
    assert ids(out) == ["<urn:0>", "<urn:2>"] and [bool(reason) for *_, reason in out] == [False, True, False]
    hurt = bytearray(whole)
    hurt[len(whole) * 2 // 3] ^= 255
    for data in (bytes(hurt), whole[: len(whole) * 2 // 3]):
        out = list(warc.salvage(data + gzip.compress(made[5])))
        assert ids(out)[:3] == ["<urn:0>", "<urn:1>", "<urn:2>"] and ids(out)[-1] == "<urn:5>"
        assert sum(n for _, n, _, _ in out) == len(data) + len(gzip.compress(made[5])) and any(reason for *_, reason in out)


def test_media(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").limit(30)
    images = shared.materialize(media.rendered(e), "i")
    first = images.orderBy("image_id").limit(4)
    extra = first.withColumn("image_id", F.col("image_id") + 10_000)
    odd = spark.createDataFrame([(20_000, None), (20_001, b""), (20_002, b"P5 9 9 255 x"), (20_003, media.pgm(np.zeros((90, 90)))), (20_003, media.pgm(np.zeros((90, 90))))], "image_id long, image binary")
    table = images.unionByName(extra).unionByName(odd)
    got = media.copies(table, media.edited(first)).collect()
    by = {r.image_id: r for r in got}
    assert len(got) == table.count()
    for r in first.collect():
        assert by[r.image_id + 10_000].class_id == r.image_id
        assert [q.query_id for q in by[r.image_id].queries] == [r.image_id] == [q.query_id for q in by[r.image_id + 10_000].queries]
    assert all(by[k].queries is None for k in (20_000, 20_001, 20_002, 20_003))
    assert media.copies(table.limit(0), first).count() == 0


def _agreeing(q, x, pairs):
    bins = {}
    for i, j in pairs:
        a, scale = (x[j][3] - q[i][3]) % media.TURNS, 2 ** ((x[j][2] - q[i][2]) / 2)
        c, s = math.cos(a * 2 * math.pi / media.TURNS), math.sin(a * 2 * math.pi / media.TURNS)
        where = (a / 4, (x[j][0] - scale * (c * q[i][0] - s * q[i][1])) / 16, (x[j][1] - scale * (s * q[i][0] + c * q[i][1])) / 16)
        for shift in np.ndindex(2, 2, 2):
            bins.setdefault((x[j][2] - q[i][2], shift, *(math.floor(w + h / 2) for w, h in zip(where, shift))), set()).add(i)
    return max(map(len, bins.values()), default=0)


def test_media_recall_against_brute_force(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    images = {r.image_id: media.decode(bytes(r.image)) for r in media.rendered(e).collect()}
    rng, queries = np.random.default_rng(1), {}
    for k in [k for k in images if k % 100 == 0]:
        p = images[k]
        h, w = p.shape
        crop = p[h // 10 : h - h // 12, w // 12 : w - w // 10]
        made = [crop * 0.85 + 20, np.rot90(crop), np.rot90(p, 2), p * 0.6 + 60, p + rng.normal(0, 4, p.shape), p[20:110, 20:110], media._shrunk(p, 2**-0.5), media._shrunk(p, 0.85)]
        queries |= {k * 10 + i: np.ascontiguousarray(np.clip(x, 0, 255)) for i, x in enumerate(made)}
    table, asked = {k: media.describe(p) for k, p in images.items()}, {k: media.describe(p) for k, p in queries.items()}
    kind = "image_id long, corner int, x float, y float, level int, turn int, d0 long, d1 long"
    frame = lambda of: spark.createDataFrame([(k, c, *p) for k, points in of.items() for c, p in enumerate(points)], kind)
    got = {(r.query_id, r.image_id) for r in media.search(frame(asked), frame(table)).collect()}
    monkeypatch.setattr(media, "SENT_ROWS", 0)  # the way of many queries gives the same pairs
    assert got == {(r.query_id, r.image_id) for r in media.search(frame(asked), frame(table)).collect()}
    words = lambda points: np.array([p[4:] for p in points], np.int64).reshape(-1, 2).view(np.uint64)
    every, owner = words([p for points in table.values() for p in points]), np.repeat(list(table), [len(x) for x in table.values()])
    place = np.concatenate([np.arange(len(x)) for x in table.values()])
    want = set()
    for k, q in asked.items():
        i, j = np.nonzero(np.bitwise_count(words(q)[:, None] ^ every).sum(2) <= media.NEAR)
        for image in np.unique(owner[j]):
            here = owner[j] == image
            if _agreeing(q, table[int(image)], zip(i[here].tolist(), place[j[here]].tolist())) >= 4:
                want.add((k, int(image)))
    copies = {(k, k // 10) for k in asked}
    print(f"copies: {len(copies & got)} of {len(copies)}; all pairs: {len(want & got)} of {len(want)}")
    assert len(copies & got) >= 0.9 * len(copies) and len(want & got) >= 0.9 * len(want)


def test_near_duplicate_stage_equals_brute_force(spark, data, docs, none):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):  # copies by themselves, from similarity 1 to below 0.7
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((10_000 + 2 * k, " ".join(words)))
        for at in rng.choice(300, k % 15, replace=False):
            words[at] = "other"
        rows.append((10_001 + 2 * k, " ".join(words)))
    base = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    for k in range(90):  # a group that one key can hold
        words = list(base)
        words[int(rng.integers(200))] = f"x{k}"
        rows.append((20_000 + k, " ".join(words)))
    whole = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")).unionByName(docs.select("doc_id", "text"))
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, whole, data).collect()}
    table = [(r.doc_id, r.text) for r in whole.collect()]

    def cut(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [cut(t) for _, t in table]
    parent = list(range(len(table)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(table):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    assert got == {*least.values(), None}
    assert corpus_pipeline.drop_near_duplicates(spark, none, data).count() == 0


def test_media_of_large_images_and_of_changed_corners(spark):
    large = np.random.default_rng(2).integers(0, 255, (64, 64)).repeat(8, 0).repeat(8, 1)
    assert sum(p[2] == 0 for p in media.describe(large.astype(np.float32))) > media.CORNERS
    kept = [int(a) & (1 << 64) - 1 for a in media._KEY_MASKS[0]]
    flips = sum(1 << i for i in [i for i in range(64) if not kept[0] >> i & 1][:20])
    flips -= (flips >> 63) << 64
    kind = "image_id long, corner int, x float, y float, level int, turn int, d0 long, d1 long"
    corners = [(1, k, 10.0 * k, 7.0 * k, 0, 0, 1 << k, k) for k in range(6)]
    changed = [(2, *c[1:6], c[6] ^ flips, c[7]) for c in corners]
    got = media.search(spark.createDataFrame(corners, kind), spark.createDataFrame(changed, kind)).collect()
    assert [(r.query_id, r.image_id) for r in got] == [(1, 2)]


def test_pipeline_stages_keep_clashing_columns_repeats_and_nulls(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7_000_001, None, None, None, 3), (7_000_002, LONG, "x", "y", 5), (7_000_002, LONG, "x", "y", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.unionByName(odd).withColumns({"score": F.col("n_chars") / 7, "_score": F.lit("s"), "_HASH": F.col("n_chars"), "_nth": F.lit(9), "fp": F.lit("f"), "root": F.lit(1), "key": F.lit("k"), "keep": F.lit(True), "Score_": F.lit(2)})
    want = {tuple(r) for r in extra.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, data)
        assert out.columns == extra.columns
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= want and (None, None) in {r[:2] for r in rows}
        if name == "near-duplicates":
            assert len([r for r in rows if r[0] is not None]) == len({r[0] for r in rows} - {None})
    pieces = corpus_pipeline.pack(spark, extra, data).collect()
    assert len({(r.doc_id, r.piece) for r in pieces if r.doc_id is not None and r.doc_id < 7_000_000}) == len([r for r in pieces if r.doc_id is not None and r.doc_id < 7_000_000])
    assert sum(r.doc_id == 7_000_002 and r.piece == 0 for r in pieces) == 2


def test_training_collects_one_text_a_document(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} of it") for i in range(400)] + [(50, "x" * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = []
    try:
        original, toxicity.train = toxicity.train, lambda texts, y, *a: seen.append((texts, y)) or original(["a", "b"], [0, 0])
        toxicity.fit(docs, labels, sample=10, longest=200)
    finally:
        toxicity.train = original
    texts, y = seen[0]
    assert y.count(0) <= 10 and y.count(1) <= 10 and len(texts) == len(y) > 5 and all(len(t) < 300 for t in texts)


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = shared.materialize(stage(spark, docs, data), "s")
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            assert out.join(docs, docs.columns, "left_anti").count() == 0
            docs = out
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontam.hits(docs, bench).count() == 0
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
