"""License scans: exact phrases by words, and short notices with a few errors.

A notice that may have k errors is split into k + 1 seeds, of which one must stand unchanged. Where
a seed stands, the regex library's bounded-error matching verifies the notice and gives its span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Label by phrase, found as consecutive words.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label by notice, found with errors.
NOTICES = {
    "licensed under the apache license version": "apache",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "released into the public domain": "public-domain",
}
#: One error for so many letters.
LETTERS_PER_ERROR = 9

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

#: A-Z lower-cased; what is no word byte becomes a space. Bytes of other letters are word bytes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], letters_per_error: int):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        for notice, label in notices.items():
            raw, k = notice.encode(), len(notice) // letters_per_error
            cuts = [len(raw) * i // (k + 1) for i in range(k + 2)]
            seeds = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            pattern = regex.compile(rb"(?b)(?:" + regex.escape(notice).encode() + b"){e<=%d}" % k)
            self.notices.append((seeds, pattern, len(raw), k, label))

    def exact(self, line: bytes) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: bytes) -> list[tuple[int, int, int, str]]:
        """(begin, end, errors, label) of notices; of overlapping matches of a notice the first that is best."""
        found = []
        for seeds, pattern, length, k, label in self.notices:
            near = []
            for shift, seed in seeds:
                at = line.find(seed)
                while at >= 0:
                    near.append((max(0, at - shift - k), min(len(line), at - shift + length + k)))
                    at = line.find(seed, at + 1)
            done = -1
            for begin, end in sorted(set(near)):
                if begin < done:
                    begin = done
                if end - begin < length - k:
                    continue
                m = pattern.search(line, begin, end)
                if m:
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts), label))
                    done = m.end()
        return found


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, letters_per_error: int = LETTERS_PER_ERROR) -> DataFrame:
    """A row for each row of `docs`, over its whole text (null: empty, 0 words, no labels, score 0).

    n_words; n_base, first_word, last_word and base_labels: places of phrases, by word. labels: those of
    notices too. score: 1 minus the errors for each letter of the best match, 1 for a phrase. spans:
    `label:first word-last word:errors`, joined by `;`, of the notices found. Equal texts get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, letters_per_error)
        for rb in batches:
            rows = []
            for text in rb.column("text"):
                words = (text.as_py() or "").encode().translate(_FOLD).split()
                line = b" %s " % b" ".join(words)
                base, near = scanner.exact(line), scanner.fuzzy(line)
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if base or near else None
                place = lambda at: int(np.searchsorted(spaces, at))  # noqa: B023, E731  the word that begins after the space at `at`
                at = sorted(p for p, _ in base)
                labels = {x for _, x in base}
                score = 1.0 if base else max((1 - e / max(1, end - begin) for begin, end, e, _ in near), default=0.0)
                spans = ";".join(f"{x}:{max(0, place(begin + 1) - 1)}-{max(0, place(end) - 1)}:{e}" for begin, end, e, x in sorted(near))
                rows.append((len(words), len(base), place(at[0]) if at else None, place(at[-1]) if at else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x[3] for x in near})), score, spans))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
