"""Words, phones and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks cut off both ends of a word (fixed values).
EDGE_MARKS = "、。।，？！!@<>→\"”()“„–,.:;—¿?¡：）|؟\\&%#*،~【】，…‥「」『』〝〟″⟨⟩♪・‚‘‹›«»～′$+=‘۔―"

#: Marks that stay inside a word; a word of only these is empty (fixed values).
CLITIC_MARKS = "'’‘"

#: Position tags of a phone: begin, inside, end, single (fixed values).
TAGS = ("_B", "_I", "_E", "_S")


def normalize_word(word: Column) -> Column:
    """Lower case, without edge marks; empty if only clitic marks are left."""
    bare = F.btrim(F.lower(word), F.lit(EDGE_MARKS))
    return F.when(F.translate(bare, CLITIC_MARKS, "") == "", "").otherwise(bare)


def strip_variant(word: Column) -> Column:
    """``word(2)`` as ``word``; a bare ``(2)`` is an empty word."""
    return F.regexp_replace(word, r"\([0-9]+\)$", "")


def untag_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, "_[BIES]$", "")


def tag_phones(phones: Column) -> Column:
    """Each phone of a pronunciation with its position in the word."""
    n = F.size(phones)
    tag = lambda i: F.when(n == 1, "_S").when(i == 0, "_B").when(i == n - 1, "_E").otherwise("_I")
    return F.transform(phones, lambda p, i: F.concat(p, tag(i)))


def words_of(text: Column) -> Column:
    """The normalised, nonempty words of a transcript, in order."""
    return F.filter(F.transform(F.split(text, r"[ \t\n\r]+"), normalize_word), lambda w: w != "")


def phone_words(text: Column) -> Column:
    """A phone string as words of phones, at ``|``, a tab or two blanks; without any of these each phone is a word."""
    phones = lambda x: F.filter(F.split(x, r"[ \n\r]+"), lambda p: p != "")
    parts = F.filter(F.transform(F.split(text, r"\||\t| {2,}"), phones), lambda w: F.size(w) > 0)
    single = F.transform(phones(text), lambda p: F.array(p))
    return F.when(text.rlike(r"\||\t| {2,}"), parts).otherwise(single)


def parent_folder(path: Column) -> Column:
    """The speaker of a path: its folder, or ``speaker`` for a file at the top."""
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), -2)).otherwise("speaker")


def speaker_name(path: Column, source: str | int = "folder") -> Column:
    """The speaker of a path: its ``folder``, the first n characters of the file's stem, or one for all (``single``)."""
    if source == "folder":
        return parent_folder(path)
    if source == "single":
        return F.lit("speaker")
    stem = without_extension(F.element_at(F.split(path, "/"), -1))
    return F.when(F.lit(int(source)) > 0, F.substring(stem, 1, int(source))).otherwise(stem)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
