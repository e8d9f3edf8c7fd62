"""License scans: base phrases by words, short notices by bounded-error search.

A notice may be found with up to one error in ten characters.  By the pigeonhole
principle, a place with at most k errors holds one of the k + 1 pieces of the
notice without any; exact seeds (an Aho-Corasick automaton over all pieces) give
windows of bounded length, and the regex library's fuzzy matching verifies them
and counts errors.  The work grows in proportion to a text's length and seeds.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.shingles import utf8
from corpusq.llm.tables import read_table

# Phrases whose words must stand consecutively, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Short notices as lower-case words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "the above copyright notice and this permission notice shall be included": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache software license version 1 1": "apache-1.1",
    "redistribution and use in source and binary forms": "bsd",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "redistributions in binary form must reproduce the above copyright notice": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "all advertising materials mentioning features or use of this software": "bsd-4-clause",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "mozilla public license version 1 1": "mpl-1.1",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "eclipse public license version 1 0": "epl-1.0",
    "eclipse public license version 2 0": "epl-2.0",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license version 1 0": "bsl-1.0",
    "academic free license version 3 0": "afl-3.0",
    "sil open font license version 1 1": "ofl-1.1",
    "open data commons attribution license": "odc-by",
    "open data commons open database license": "odbl",
    "python software foundation license": "psf",
    "the artistic license 2 0": "artistic-2.0",
    "microsoft public license": "ms-pl",
    "do what the fuck you want to public license": "wtfpl",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "proprietary and confidential": "proprietary",
}
ERROR_RATE = 0.1
#: Searched windows that a task remembers; notices repeat from text to text.
SEEN = 50_000

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = bytes(c if _WORD[c] else 32 for c in _LOWER)
_IN, _OUT = rb"[\x30-\x39\x61-\x7a\x80-\xff]", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"


def errors_allowed(notice: str) -> int:
    return max(1, int(len(notice) * ERROR_RATE))


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice in errors_allowed + 1 pieces of near equal length, with their starts."""
    n = errors_allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds base phrases and notices in one text."""

    def __init__(self) -> None:
        import ahocorasick
        import regex

        self.base = re.compile(
            rb"(?<!" + _IN + rb")(?:" + b"|".join(b"(" + (_OUT + b"+").join(p.encode().split()) + b")" for p in BASE) + rb")(?!" + _IN + rb")")
        self.base_labels = list(BASE.values())
        self.notices = [
            (n, label, errors_allowed(n), regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={errors_allowed(n)}}}")) for n, label in NOTICES.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, *_) in enumerate(self.notices):
            for at, piece in pieces(n):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def phrases(self, raw: bytes) -> list[tuple[int, str]]:
        """Byte start and label of each place of a base phrase."""
        return [(m.start(), self.base_labels[m.lastindex - 1]) for m in self.base.finditer(raw.translate(_LOWER))]

    def places(self, words: str) -> list[tuple[int, int, int, int]]:
        """Notice, start, end and errors of each match, in characters of space-joined words.

        A seed names the place where its notice would begin without errors; each
        such place is searched once, in a window of the notice's length and its
        errors on both sides, too short to hold two matches apart.
        """
        begins: dict[int, set[int]] = {}
        for end, (size, seeds) in self.seeds.iter(words):
            for i, at in seeds:
                begins.setdefault(i, set()).add(end + 1 - size - at)
        found = set()
        for i, starts in begins.items():
            n, _, k, pattern = self.notices[i]
            for at in starts:
                low = max(0, at - k)
                window = words[low : at + len(n) + k]
                if (i, window) not in self.seen:
                    m = pattern.search(window)
                    self.seen[i, window] = m and (*m.span(), sum(m.fuzzy_counts))
                match = self.seen[i, window]
                if match:
                    start, end = match[0] + low, match[1] + low
                    while start < end and words[start] == " ":
                        start += 1
                    while end > start and words[end - 1] == " ":
                        end -= 1
                    found.add((i, start, end, match[2]))
        if len(self.seen) > SEEN:
            self.seen.clear()
        return sorted(found)

    def fuzzy(self, raw: bytes) -> list[tuple[str, int, int, int, float]]:
        """Label, first word, last word, errors and score of each notice found.

        Of notices that share words, the better ones stay; of equally good ones
        with one label, the first.
        """
        words = b" ".join(raw.translate(_BLANK).split()).decode(errors="replace")
        places = self.places(words)
        if not places:
            return []
        gaps = np.flatnonzero(np.frombuffer(words.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
        first = np.searchsorted(gaps, [p[1] for p in places]).tolist()
        last = np.searchsorted(gaps, [p[2] for p in places]).tolist()
        found = sorted({
            (self.notices[i][1], a, b, errors, 1 - errors / len(self.notices[i][0])) for (i, _, _, errors), a, b in zip(places, first, last, strict=True)},
            key=lambda f: (-f[4], f[1], -f[2], f[0]))
        taken = np.zeros(len(gaps) + 1, dtype=bool)
        kept: list[tuple[str, int, int, int, float]] = []
        for _, equal in itertools.groupby(found, key=lambda f: f[4]):
            until: dict[str, int] = {}
            level = []
            for f in equal:
                if f[1] > until.get(f[0], -1) and not taken[f[1] : f[2] + 1].any():
                    until[f[0]] = f[2]
                    level.append(f)
            for f in level:
                taken[f[1] : f[2] + 1] = True
            kept += level
        return sorted(kept)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


_SPANS = "array<struct<label:string,first_word:long,last_word:long,errors:int,score:double>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    use = scanner()
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        raw, at, valid = utf8(batch.column("text"))
        n_words, n_base, first, last, base, labels, score, spans = [], [], [], [], [], [], [], []
        for row in range(batch.num_rows):
            own = raw[at[row] : at[row + 1]] if valid[row] else raw[:0]
            text = own.tobytes()
            word = _WORD[np.frombuffer(text.translate(_LOWER), dtype=np.uint8)]
            start = word.copy()
            start[1:] &= ~word[:-1]
            n_words.append(int(start.sum()))
            places = use.phrases(text)
            n_base.append(len(places))
            if places:
                first.append(int(start[: places[0][0]].sum()))
                last.append(int(start[: places[-1][0]].sum()))
            else:
                first.append(None)
                last.append(None)
            found = use.fuzzy(text)
            named = {label for _, label in places}
            base.append(",".join(sorted(named)))
            labels.append(",".join(sorted(named | {f[0] for f in found})))
            score.append(1.0 if places else max((f[4] for f in found), default=0.0))
            spans.append([dict(zip(("label", "first_word", "last_word", "errors", "score"), f, strict=True)) for f in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)],
             pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, spans_type)],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """License phrases and notices of every text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (starts of the first and last of them, in words from 0), base_labels
    and labels (with the notices found with errors), score (1 for a base phrase,
    else 1 - errors / length of the best notice, else 0) and spans (the notices).

    Nulls and edge cases: null text is empty; a text without words has no
    labels (empty strings), null places and score 0; rows, repeated ones too,
    stay as they are, and null ids stay null; very long texts take time in
    proportion to their length; an empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scanned, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {_SPANS}")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return scan(read_table(spark, sf_dir, "documents")).drop("spans")
