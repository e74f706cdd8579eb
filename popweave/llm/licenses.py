"""License scans: short notices found in whole texts, small edits allowed.

A text is lower-cased (A-Z) and cut into words (runs of letters, digits and characters beyond ASCII), which are joined by
single spaces. A notice may have up to ``edits`` inserted, missing or changed characters; it is split into one
piece more than that, so any place that is within the edits holds a piece unchanged (the pigeonhole principle). One
Aho-Corasick automaton finds all pieces of all notices in one pass over a text; hits of a notice that point to about
the same start share a window; the regex library's bounded-error match takes the best place in the window, counts its edits and
reports its span. Notices without edits are whole words and need no check beyond the piece itself.

Every place is reported; of overlapping places of one notice the one of fewest edits, of equal ones the first.

Defined cases: a null text is empty, an empty text has no words and no places; texts are scanned whole, in one task each,
with memory in proportion to the longest text of a task; repeated rows are rows of their own; an empty table
gives no rows; null ids stay null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import lean, letters_only, slices

#: Characters of a notice per edit, and the most edits of one: longer pieces are rarer, more edits cost the match more.
CHARS_PER_EDIT, MOST_EDITS = 20, 4


class Notice(NamedTuple):
    label: str
    phrase: str
    edits: int
    base: bool = False


#: Names that count as they stand, as whole words.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of the licenses' own notices and customary short references, as words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "spdx license identifier mit": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may obtain a copy of the license at http www apache org licenses": "apache",
    "spdx license identifier apache 2 0": "apache",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1 0": "boost",
    "under the terms of the eclipse public license": "epl",
    "this software is provided as is without any express or implied warranty": "zlib",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "released under cc0": "cc0",
}


def notices(base: dict[str, str] = BASE, further: dict[str, str] = NOTICES) -> list[Notice]:
    """The base phrases, word for word, and further ones with an edit per ``CHARS_PER_EDIT`` characters where they have over as many."""
    return [Notice(v, f" {k} ", 0, True) for k, v in base.items()] + [Notice(v, f" {k} ", 0) if len(k) <= CHARS_PER_EDIT else Notice(v, k, min(len(k) // CHARS_PER_EDIT, MOST_EDITS)) for k, v in further.items()]


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(place, text) of edits + 1 parts of about equal length."""
    n = notice.edits + 1
    cut = [len(notice.phrase) * k // n for k in range(n + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    """Finds the notices in texts of words joined by single spaces."""

    def __init__(self, wanted: list[Notice]):
        import ahocorasick
        import regex

        self.wanted, by_piece = wanted, {}
        for i, notice in enumerate(wanted):
            for at, text in pieces(notice):
                by_piece.setdefault(text, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for text, uses in by_piece.items():
            self.automaton.add_word(text, (len(text), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}") if n.edits else None for n in wanted]

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, stop, edits, notice), ordered; ``text`` begins and ends with a space."""
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for i, at in uses:
                starts.setdefault(i, []).append(end + 1 - size - at)
        out = []
        for i, found in starts.items():
            notice = self.wanted[i]
            if notice.edits:
                out += self._verified(text, i, sorted(set(found)))
            else:
                out += [(a + 1, a + len(notice.phrase) - 1, 0, i) for a in found]
        return sorted(out)

    def _verified(self, text: str, i: int, starts: list[int]) -> Iterator[tuple[int, int, int, int]]:
        size, edits, last, k = len(self.wanted[i].phrase), self.wanted[i].edits, None, 0
        while k < len(starts):
            first = starts[k]
            while k + 1 < len(starts) and starts[k + 1] - first <= edits:
                k += 1
            hit = self.patterns[i].search(text, max(0, first - edits), min(len(text), starts[k] + size + edits))
            k += 1
            if hit:
                place = (hit.start(), hit.end(), sum(hit.fuzzy_counts), i)
                if last and place[0] < last[1]:
                    last = min(last, place, key=lambda p: (p[2], p[0]))
                else:
                    if last:
                        yield last
                    last = place
        if last:
            yield last


def scanned(docs: DataFrame, wanted: Iterable[Notice] | None = None) -> DataFrame:
    """(doc_id, n_words, places) of every row; a place has label, base, word (its first, from 0), words, edits, score (1 less edits per character) and text."""
    wanted, table = list(notices() if wanted is None else wanted), letters_only()
    kinds = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int32()), ("score", pa.float64()), ("text", pa.string())])

    def described(scanner: Scanner, text: str) -> list[dict]:
        out, at, before = [], 0, 0  # ``before`` spaces in text[:at]
        for start, stop, edits, i in scanner.places(text):
            notice = wanted[i]
            first = start + (text[start] == " ")
            before, at = before + text.count(" ", at, first), first
            size = len(notice.phrase.strip())
            out.append({"label": notice.label, "base": notice.base, "word": before - 1, "words": text.count(" ", first, stop - (text[stop - 1] == " ")) + 1, "edits": edits, "score": max(0.0, 1 - edits / size), "text": text[start:stop].strip()})
        return out

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        for some in slices(batches):
            counts, places = [], []
            for raw in some.column("text").cast(pa.large_binary()):
                words = (raw.as_py() or b"").translate(table).split()
                counts.append(len(words))
                places.append(described(scanner, f" {b' '.join(words).decode()} "))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(kinds))], names=["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<label string, base boolean, word long, words long, edits int, score double, text string>>")


def op12_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of every text of ``documents``; places has the notices' spans."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    words = F.transform(base, lambda p: p["word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"), F.size("places").cast("long").alias("n_places"))


QUERIES = {"op12_licenses": op12_licenses}
ORACLE_SQL: dict[str, str] = {}  # SQL has no bounded-error search: tests/llm compares with an edit-distance table over whole texts
