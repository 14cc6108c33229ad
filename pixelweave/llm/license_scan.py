"""License scans: phrases by words, and short notices with edits.

Words are runs of letters, digits and non-ASCII bytes of the text in lower case (A-Z only). A phrase's places are
those where its words stand consecutively. Short notices are searched with up to k errors: a notice of w words is
split into k + 1 stretches of characters, of which any text within k errors holds one unchanged (the pigeonhole principle); the
stretches are found exactly, and around each find the regex library's bounded-error matching of the whole notice over the
words' text verifies the edits and gives the span. A notice's stretches are long enough to be rare; regions that meet
are one, so nothing is matched or reported twice. Words are numbered by bisection in the places of the spaces, found once.

Cases: null text is empty, without words, places or labels, score 0; rows that repeat are scanned each; an empty
table gives an empty result; columns of the input other than the named two are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices, in words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "reserved",
}
#: A notice may have one error (a character put in, left out or changed) for so many characters.
CHARS_PER_ERROR = 20
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(notice: str, errors: int) -> list[tuple[str, int]]:
    """errors + 1 stretches of a notice, of about equal length, with their starts."""
    n, k = len(notice), errors + 1
    at = [n * i // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(at, at[1:], strict=False)]


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows in order, those that meet joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices.items()):
            errors = max(1, len(notice) // CHARS_PER_ERROR)
            self.notices.append((notice, label, errors, regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={errors}}}")))
            for seed, at in pieces(notice, errors):
                by_seed.setdefault(seed, []).append((i, at))
        for seed, of in by_seed.items():
            self.seeds.add_word(seed, (len(seed), of))
        self.seeds.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, int, int]]]:
        """Words in all; phrase places (first word, last word, label); notices (first word, last word, label, errors, length)."""
        words = text.encode().translate(LETTERS).split()
        body = b" " + b" ".join(words) + b" "
        places, spaces = [], None
        for phrase, label in self.phrases:
            at = body.find(phrase)
            while at >= 0:
                spaces = np.flatnonzero(np.frombuffer(body, np.uint8) == 32) if spaces is None else spaces
                first = int(np.searchsorted(spaces, at))
                places.append((first, first + phrase.count(b" ") - 2, label))
                at = body.find(phrase, at + 1)
        return len(words), sorted(places), self.fuzzy(body.decode())

    def fuzzy(self, body: str) -> list[tuple[int, int, str, int, int]]:
        """Windows around the seeds, joined where they meet, each matched with bounded errors."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, of) in self.seeds.iter(body):
            for i, at in of:
                notice, _, errors, _ = self.notices[i]
                start = end + 1 - length - at
                low, high = max(0, start - errors), min(len(body), start + len(notice) + errors)
                windows.setdefault(i, []).append((low, high))
        out, spaces = [], None
        for i, own in windows.items():
            notice, label, _, pattern = self.notices[i]
            for low, high in merged(own):
                for m in pattern.finditer(body, low, high):
                    if spaces is None:
                        spaces = np.flatnonzero(np.frombuffer(body.encode("utf-32-le"), np.uint32) == 32)
                    first, last = np.searchsorted(spaces, (m.start() + (body[m.start()] == " "), m.end() - (body[m.end() - 1] == " "))) - 1
                    out.append((int(first), int(last), label, sum(m.fuzzy_counts), len(notice)))
        return sorted(out)


@functools.cache
def _scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(notices))


SPAN = "struct<first_word:bigint,last_word:bigint,label:string,errors:bigint>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    score: the largest share of a find that is as it should be: 1 for a phrase, 1 - errors / length for a notice.
    """
    small_batches(docs.sparkSession)
    key = (tuple(phrases.items()), tuple(notices.items()))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("errors", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(*key)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                n, places, found = s.scan(text or "")
                base = {x[2] for x in places}
                spans = [(*x, 0) for x in places] + [x[:4] for x in found]
                rows.append((
                    n, len(places), places[0][0] if places else None, max(x[0] for x in places) if places else None,
                    ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in found})),
                    1.0 if places else max((1 - x[3] / x[4] for x in found), default=0.0),
                    [dict(zip(("first_word", "last_word", "label", "errors"), x, strict=True)) for x in sorted(spans)],
                ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
