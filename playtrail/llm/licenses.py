"""License scans: fuzzy search for short notices.

Texts are reduced to lower-case words joined by single spaces.  A notice that may differ by
k edits is cut into k + 1 pieces: one of them must occur unchanged (pigeonhole), so exact
finds of the pieces give all candidates.  Around each, the regex library's bounded-error
matching verifies the whole notice and gives span and edits.  Exact phrases are the base.

* Null or empty text: no words, no spans, empty labels, score 0, null first and last word.
* Every place of a phrase counts, overlapping ones too; of a notice, places that a match has
  covered are not matched again.  Whole texts are searched.
* Rows are independent, so repeated rows repeat; result columns replace input columns.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from playtrail.llm.common import WORDS, over, row_and, slices, whole_rows, with_columns

#: Exact phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices, their labels and the edits (characters) each may differ by.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person", "mit", 5),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("gnu general public license", "gpl", 2),
    ("general public license", "gpl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
)
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: bigint, last_word: bigint, edits: int>>"
)


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 pieces of about equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def finds(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


class Notice:
    """One notice's seeds and verifier."""

    def __init__(self, phrase: str, label: str, edits: int) -> None:
        import regex

        self.phrase, self.label, self.edits = phrase.encode(), label, edits
        self.seeds = pieces(self.phrase, edits)
        self.match = regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(self.phrase), edits))

    def spans(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """Begin, end and edits of the matches; places a match covers aren't tried again."""
        at = sorted({p - offset for offset, seed in self.seeds for p in finds(text, seed)})
        covered, k = 0, self.edits
        for start in at:
            if start + len(self.phrase) - k <= covered:
                continue
            found = self.match.search(text, max(covered, start - k), max(0, start) + len(self.phrase) + 2 * k)
            if found:
                covered = found.end()
                yield found.start(), found.end(), sum(found.fuzzy_counts)


def scan_text(raw: bytes, phrases: list[tuple[bytes, str]], notices: list[Notice]) -> tuple:
    """The result columns of one text."""
    words = raw.translate(WORDS).split()
    text = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in phrases for at in finds(text, phrase)]
    fuzzy = [(n, *span) for n in notices for span in n.spans(text)]
    if not base and not fuzzy:
        return len(words), 0, None, None, "", "", 0.0, []
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    starts = [bisect_right(spaces, at) - 1 for at, _ in base]
    base_labels = {label for _, label in base}
    spans = [
        {
            "label": n.label,
            "first_word": max(0, bisect_right(spaces, begin) - 1),
            "last_word": max(0, bisect_right(spaces, end - 1) - 1),
            "edits": edits,
        }
        for n, begin, end, edits in fuzzy
    ]
    score = max([float(bool(base)), *(1 - edits / len(n.phrase) for n, _, _, edits in fuzzy)])
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {n.label for n, *_ in fuzzy})),
        score,
        spans,
    )


def scan_licenses(
    docs: DataFrame,
    notices: tuple[tuple[str, str, int], ...] = NOTICES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
) -> DataFrame:
    """Adds counts, labels, score and ``spans`` (label, first and last word, edits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [Notice(*n) for n in notices]
        exact = [(f" {p} ".encode(), label) for p, label in phrases]
        for batch, texts in slices(batches, "row.text"):
            columns = list(zip(*(scan_text(t, exact, wanted) for t in texts)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(SPAN)]
            yield with_columns(
                batch, "", **{n: pa.array(c, t) for n, c, t in zip(RESULTS, columns, types)}
            )

    rows = whole_rows(docs)
    return over(rows.mapInArrow(scan, row_and(rows, _DDL)), RESULTS)
