"""Token ids of whole texts, with the tokenizers library.

A text is cut where no token can span, the distinct units of a batch are looked
up or encoded by the library, and their ids are laid out in order by Arrow and
numpy. Words are cut once more, before the marks that follow a letter, and their
new parts are encoded many at once with a mark between them. Natural text repeats its words, so most units come from the cache; the
result equals that of one plain call of the library on each whole text.
"""

from __future__ import annotations

import functools
import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units after which a worker's cache begins a new generation; units that the last one held are carried over when met.
GENERATION = 700_000

#: Before a space or line feed that stands alone between two other characters, and after such a line feed.
_BYTE_LEVEL_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: White space other than single spaces and line feeds inside a text (RE2 syntax; its own \s is ASCII only).
_ODD_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: A run of these after a letter begins a token (the apostrophe may begin a contraction and is left out).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The same inside a word (RE2 syntax). Small letters of the capital I with a dot end in a combining mark, so it is left out.
_BEFORE_MARKS = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-&(-/:-@\[-`{-~])"
#: Composing changes none of these characters, so capitals may be made small before it.
_COMPOSED = r"\A[\x{0}-\x{2ff}]*\z"
#: Stands between words that are encoded at once; words that hold it are encoded by themselves.
_BETWEEN, _AT_ONCE = "\x01", 256


def _units_by_space(texts: pa.Array) -> pa.ListArray:
    """The word BPE drops white space: the words of a text (empty ones are encoded as nothing)."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def _units_with_space(texts: pa.Array) -> pa.ListArray:
    """Byte-level BPE keeps a space with the word after it. Texts must be free of the code point 0."""
    odd = pc.match_substring_regex(texts, _ODD_SPACE)
    cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
    if pc.any(odd).as_py():
        by_rule = pa.array(["\0".join(_BYTE_LEVEL_CUT.split(t)) for t in texts.filter(odd).to_pylist()], texts.type)
        cut = pc.replace_with_mask(cut, odd, by_rule)
    return pc.split_pattern(cut, "\0")


#: How texts may be cut, by the kind of pre-tokenizer.
CUTS = {"byte": _units_with_space, "word": _units_by_space}

_open: dict[str, "UnitEncoder"] = {}


def _in_order(ids: np.ndarray, size: np.ndarray, indices: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units as ``indices`` has them, and where each one's end; ``ids`` are those of the distinct ones."""
    at = indices.to_numpy(zero_copy_only=False)
    first, many = np.cumsum(size) - size, size[at]
    ends = np.cumsum(many)
    # the place of each id among those of the distinct units
    place = np.repeat(first[at] - (ends - many), many)
    place += np.arange(len(place))
    return ids[place], ends


class UnitEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, kind: str, generation: int = GENERATION):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.cut = CUTS[kind]
        self.words = kind == "word"
        self.names = [a.lower() for a in added]
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if self.words and len(between) == 1 else None
        self.generation = generation
        self.cache: dict[str, bytes] = {"": b""}
        self.past: dict[str, bytes] = {}

    def _ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        if len(self.cache) > self.generation:
            self.cache, self.past = {"": b""}, self.cache
        cache, past = self.cache, self.past
        known = list(map(cache.get, units))
        missing = [i for i, ids in enumerate(known) if ids is None]
        parts, new = [], set()
        for i in missing:
            u = units[i]
            if (ids := past.get(u)) is not None:
                cache[u] = ids
                continue
            stem = "" if self.words else u.rstrip(_MARKS)
            if stem and len(stem) < len(u) and stem[-1].isalpha() and stem[-1] < "ɐ" and not self.added.search(u):
                parts.append((u, stem, u[len(stem) :]))
            else:
                new.add(u)
        for x in {x for _, *some in parts for x in some}:
            if x not in cache:
                if (ids := past.get(x)) is not None:
                    cache[x] = ids
                else:
                    new.add(x)
        todo = list(new)
        for i in range(0, len(todo), 4096):
            some = todo[i : i + 4096]
            cache.update(self._joined(some) if self.between is not None else self._one_by_one(some))
        for u, stem, marks in parts:
            cache[u] = cache[stem] + cache[marks]
        for i in missing:
            known[i] = cache[units[i]]
        return known

    def _one_by_one(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Units with their ids."""
        for unit, e in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False), strict=True):
            yield unit, array("I", e.ids).tobytes()

    def _joined(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids; one call for many of them."""
        yield from self._one_by_one([w for w in words if _BETWEEN in w])
        words = [w for w in words if _BETWEEN not in w]
        groups = [words[i : i + _AT_ONCE] for i in range(0, len(words), _AT_ONCE)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.between), len(ids)).tolist()
            flat, starts = ids.tobytes(), [0, *(i + 1 for i in ends[:-1])]
            for word, a, b in zip(some, starts, ends, strict=True):
                yield word, flat[4 * a : 4 * b]

    def _parts(self, words: pa.Array) -> pa.ListArray:
        """The parts of distinct words, in small letters where that changes no id; words with added tokens stay whole."""
        named = functools.reduce(pc.or_, (pc.match_substring(words, n, ignore_case=True) for n in self.names), pa.repeat(False, len(words)))
        if self.folds:
            words = pc.if_else(pc.and_not(pc.match_substring_regex(words, _COMPOSED), named), pc.ascii_lower(words), words)
        return pc.split_pattern(pc.if_else(named, words, pc.replace_substring_regex(words, _BEFORE_MARKS, r"\1 \2")), " ")

    def _laid(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, one after another, and how many each has."""
        if self.words:
            listed = self._parts(units)
            parts = listed.flatten().dictionary_encode()
            ids, ends = _in_order(*self._laid_whole(parts.dictionary), parts.indices)
            offsets = listed.offsets.to_numpy()
            return ids, np.diff(np.append(0, ends)[offsets - offsets[0]])
        return self._laid_whole(units)

    def _laid_whole(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = self._ids(units.to_numpy(zero_copy_only=False).tolist())
        return np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) >> 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring(texts, "\0")
        listed = self.cut(pc.if_else(whole, "", texts) if pc.any(whole).as_py() else texts)
        units = listed.flatten().dictionary_encode()
        flat, ends = _in_order(*self._laid(units.dictionary), units.indices)
        offsets = listed.offsets.to_numpy()
        starts = np.append(0, ends)[offsets - offsets[0]]
        if not pc.any(whole).as_py():
            return flat, starts
        pieces = [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            pieces[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])


def encoder(path: str, kind: str, generation: int = GENERATION) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; tasks of one worker share it."""
    if (key := f"{kind}:{generation}:{path}") not in _open:
        _open[key] = UnitEncoder(path, kind, generation)
    return _open[key]


def slices(batches: Iterable[pa.RecordBatch], text_at: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of about ``size`` bytes of text; a longer text stands alone."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends, i = np.cumsum(length), 0
        while i < b.num_rows:
            before = ends[i] - length[i]
            j = max(i + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(i, j - i)
            i = j


def rows_of(batches: Iterable, step: int = 512) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few at a time."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield from zip(*(c.slice(i, step).to_pylist() for c in b.columns), strict=True)


def chunks(rows: Iterable[tuple], text_at: int, size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in lists of about ``size`` characters of text; a longer text stands alone."""
    held, n = [], 0
    for row in rows:
        length = len(row[text_at] or "") + 64
        if held and n + length > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += length
    if held:
        yield held
