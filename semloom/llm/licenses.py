"""License scans: base phrases of the contract, and fuzzy search for short notices.

Method. A notice that occurs with at most k edits must hold one of its k + 1 pieces unchanged (pigeonhole),
so an automaton over the pieces of all notices finds the places worth a look in one pass. Around each
such seed the regex library's bounded-error matching verifies the edits and reports the span.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, read_table
from .textvec import ALNUM, texts, words

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices in lower case, with the label they carry; the usual wording of each license's own notice.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("redistribute it and/or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by-nc 4.0", "cc-by-nc"),
    ("licensed under cc by-sa 4.0", "cc-by-sa"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)


def edits_allowed(notice: str) -> int:
    """One edit for every fifteen characters, none for the shortest."""
    return len(notice) // 15 if len(notice) >= 24 else 0


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of near equal length, with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(4)
def _search(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for number, (notice, _) in enumerate(notices):
        k = edits_allowed(notice)
        patterns.append((k, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
        for at, piece in pieces(notice, k):
            seeds.setdefault(piece, []).append((number, at))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), tuple(uses)))
    automaton.make_automaton()
    return automaton, patterns


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text: str) -> str:
    return text.translate(_FOLD) if not text.isascii() else text.lower()


def find_notices(text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of the notices in a lower-cased text, in code points; of each notice the best at each place.

    Every seed's window is verified on its own: a place lies whole in the window of any piece it holds unchanged.
    Of places of one notice that overlap the one of fewest edits stays, the first of equal ones.
    """
    automaton, patterns = _search(notices)
    windows: set[tuple[int, int, int]] = set()
    for last, (size, uses) in automaton.iter(text):
        start = last + 1 - size
        for number, at in uses:
            k = patterns[number][0]
            windows.add((number, max(0, start - at - k), min(len(text), start - at + len(notices[number][0]) + k)))
    places: dict[int, set[tuple[int, int, int]]] = {}
    for number, lo, hi in windows:
        if m := patterns[number][1].search(text, lo, hi):
            places.setdefault(number, set()).add((sum(m.fuzzy_counts), m.start(), m.end()))
    found = []
    for number, spans in places.items():
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for edits, start, end in sorted(spans):
            at = bisect_left(taken, (end,))
            if not at or taken[at - 1][1] <= start:
                taken.insert(at, (start, end))
                found.append((start, end, notices[number][1], edits))
    return sorted(found)


def _word_codes(phrase: str) -> np.ndarray:
    import pyarrow as pa

    return words(pa.array([phrase]), ALNUM).hashes()


def base_places(w) -> list[list[tuple[int, int]]]:
    """Of each text: (word number, phrase number) of every place of a base phrase."""
    h, owner = w.hashes(), w.owner()
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(w.bounds) - 1)]
    for number, (phrase, _) in enumerate(PHRASES):
        codes = _word_codes(phrase)
        at = np.flatnonzero(h == codes[0])
        for j, c in enumerate(codes[1:], 1):
            at = at[at + j < len(h)]
            at = at[(h[at + j] == c) & (owner[at + j] == owner[at])]
        for i in at:
            out[owner[i]].append((int(i - w.first[owner[i]]), number))
    return out


def _scan(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.string()] * 3 + [pa.float64()], strict=True)))
    for batch in batches:
        column = texts(batch.column(1))
        for lo, hi in by_bytes(column, 1 << 19):
            part = column.slice(lo, hi - lo)
            w = words(part, ALNUM)
            rows = []
            for doc_id, text, n, places in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), part.to_pylist(), np.diff(w.first).tolist(), base_places(w), strict=True):
                notices = find_notices(fold(text))
                base = sorted({PHRASES[p][1] for _, p in places})
                labels = sorted({*base, *(label for _, _, label, _ in notices)})
                starts = [s for s, _ in places]
                score = max([1.0 if places else 0.0, *(1 - e / (b - a) for a, b, _, e in notices if b > a)])
                rows.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in notices), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, notices string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """License phrases and notices of each text of ``docs(doc_id, text)``.

    ``notices`` lists label:start:end:edits in code points; ``score`` is 1 for a base phrase, else 1 less
    the share of edits of the best notice, else 0. Null and empty texts have no words and score 0. Texts
    are scanned whole where they lie, however long; repeated rows give equal rows; a null doc_id is kept; an
    empty table gives an empty one; other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))
