"""Licence notices and tags in documents: Aho-Corasick over words, and expressions behind tags.

A text becomes its words in lower case, joined by single spaces, and one pass of an
Aho-Corasick automaton over it finds every place of every phrase: the base phrases, which
are reported as they stand, further notices, and tags. Behind a tag (found again in the raw
text, where punctuation counts) a licence expression is read by a shunting yard
(license_expression.py). Of notices of which one lies within another only the longer gives a
label; labels of base phrases always stay.

Rows are worked on where they are read: nothing is shuffled, and a text costs time and memory
in proportion to its length.

score: 1 less the product over the labels of how weak their strongest evidence is: a tag's
expression 0.1, a notice of six words or more 0.2, a shorter one 0.4; 0 without a label.
burden: the heaviest of all expressions and notices (license_expression.py); null without one.

Defined results: a null text is an empty one; very long texts are scanned whole; ids may be
null or repeated, equal texts get equal values; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import license_expression
from tidewheel.session import table

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices, the identifier whose label and burden they have, in words as the texts' own.
NOTICES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "cc0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "expat license": "expat",
    "general public license": "gpl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "licensed under the apache license": "apache",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "sil open font license": "ofl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
}
#: Tags, and what must stand between their last word and an expression in the raw text.
TAGS = {"spdx license identifier": ":", "spdx license expression": ":", "license": ":", "licence": ":", "licenses": ":", "license expression": ":"}
#: Weakness of evidence: an expression behind a tag, a long notice, a short one.
WEAK_TAG, WEAK_LONG, WEAK_SHORT = 0.1, 0.2, 0.4
LONG = 6
#: Rows of an Arrow batch that are worked on at once.
SLICE = 256

#: Bytes of words stay, A-Z lower-cased; all other ASCII becomes a space.
WORDS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


class Found(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    burden: int | None
    expressions: list[str]


@cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    return automaton


def places(words: str) -> Iterator[tuple[int, str]]:
    """(first word, phrase) of every place, by where they end, of words with a space before and after each."""
    seen = spaces = 0
    for end, phrase in _automaton().iter(words):
        spaces += words.count(" ", seen, end)
        seen = end
        yield spaces - 1 - phrase.count(" "), phrase


def _outer(found: list[tuple[int, str]]) -> list[str]:
    """The notices that lie within no longer one."""
    spans = sorted({(at, -(at + phrase.count(" ") + 1), phrase) for at, phrase in found})
    reach, out = -1, []
    for _, end, phrase in spans:
        if -end > reach:
            reach = -end
            out.append(phrase)
    return out


def scan(text: str | None) -> Found:
    """All that a text says about its licence."""
    text = text or ""
    words = text.encode().translate(WORDS).split()
    found = list(places(" " + b" ".join(words).decode() + " ")) if words else []
    base = [(at, phrase) for at, phrase in found if phrase in BASE]
    weak: dict[str, float] = {}
    burdens, said = [], []

    def label(name: str, burden: int, weakness: float) -> None:
        weak[name] = min(weak.get(name, 1.0), weakness)
        burdens.append(burden)

    notices = _outer([f for f in found if f[1] in NOTICES])
    for phrase in set(notices) | {p for _, p in base}:
        name, burden = license_expression.family(NOTICES[phrase])
        weakness = WEAK_LONG if phrase.count(" ") + 1 >= LONG else WEAK_SHORT
        weak[name] = min(weak.get(name, 1.0), weakness)
        if phrase in notices:
            burdens.append(burden)
    tags = sorted({(at + phrase.count(" "), TAGS[phrase]) for at, phrase in found if phrase in TAGS})
    if tags:
        for postfix in _expressions(text, tags):
            value = license_expression.evaluate(postfix)
            for name in value.labels:
                label(name, value.burden, WEAK_TAG)
            said.append(" ".join(postfix))
    score = 1.0
    for name in sorted(weak):
        score *= weak[name]
    starts = [at for at, _ in base]
    return Found(
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({BASE[p] for _, p in base})),
        ",".join(sorted(weak)), 1 - score if weak else 0.0, max(burdens, default=None), sorted(set(said)),
    )


def _expressions(text: str, tags: list[tuple[int, str]]) -> Iterator[list[str]]:
    """The expressions behind the tags (last word, mark), in postfix order."""
    lower = text.translate({c: c | 0x20 for c in range(0x41, 0x5B)})
    at = 0
    for number, word in enumerate(WORD.finditer(lower)):
        if number == tags[at][0]:
            mark = re.compile(r"[ \t]*" + re.escape(tags[at][1])).match(lower, word.end())
            if mark and (postfix := license_expression.postfix(lower, mark.end())):
                yield postfix
            at = bisect_left(tags, (number + 1,))
            if at == len(tags):
                return


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, what scan() finds) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int32(), pa.list_(pa.string())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                found = [scan(text.as_py()) for text in part.column(1)]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.record_batch([part.column(0), *columns], ["doc_id", *Found._fields])

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, burden int, expressions array<string>"
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, {fields}")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and expressions of every document."""
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op11_license_scan": op11_license_scan}
#: Labels and expressions are outside SQL; tests hold the base columns to SQL and the rest to plain versions.
ORACLE_SQL: dict[str, str] = {}
