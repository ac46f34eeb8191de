"""The packing query against one plain call of the tokenizer for each whole text."""

from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from sonoweft.llm import queries


def test_pieces_have_the_ids_of_whole_texts(spark, data):
    whole = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r.doc_id, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op2_best_two_fit_packing(spark, data).collect()
    assert len(rows) == len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in placed.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist()
        assert sum(n for _, n in places) <= 2048
    # no two sequences could be one, and the number is within one in a hundred of the least possible
    used = sorted(sum(n for _, n in p) for p in placed.values())
    assert len(used) < 2 or used[0] + used[1] > 2048
    assert len(used) <= 1.01 * -(-sum(used) // 2048) + 1
