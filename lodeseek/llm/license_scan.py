"""License scans: fuzzy search for short notices.

Texts are lower-cased in A-Z and reduced to words with single spaces between. A notice of n characters may hold k errors, k a tenth of n at most:
cut into k + 2 pieces, at least two stand unchanged in any such match, at most k characters out of line with each other (pigeonhole). One automaton finds
the pieces of all notices; where two of them agree, the regex library's bounded-error matching verifies the notice in a window of bounded
size: the leftmost match first, then the best within it gives span and edits.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Phrases whose exact places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are searched with errors, with their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache software license version 1 1": "apache-1.1",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this work is licensed under the gnu general public license version": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the bsd license": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
    "subject to the terms of the mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "boost software license": "bsl",
    "open software license version 3 0": "osl",
    "artistic license 2 0": "artistic",
    "academic free license": "afl",
    "sil open font license": "ofl",
    "open data commons open database license": "odbl",
    "python software foundation license": "psf",
    "do what the fuck you want to public license": "wtfpl",
    "this software is provided as is without warranty of any kind": "as-is",
    "all rights reserved": "reserved",
}
ERRORS_PER_CHAR = 0.1

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], errors_per_char: float):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices.items()):
            k = int(len(notice) * errors_per_char)
            cuts = [len(notice) * j // (k + 2) for j in range(k + 3)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.setdefault(notice[a:b], []).append((i, a))
            body = f"(?:{regex.escape(notice)}){{e<={k}}}"
            self.notices.append((notice, label, k, regex.compile(body).search, regex.compile(f"(?b){body}").search))
        for piece, places in at.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def windows(self, plain: str) -> dict[int, list[list[int]]]:
        """For each notice the windows that may hold it, in order of their begin: places where it would begin, with room for its errors."""
        hits: dict[int, list[tuple[int, int]]] = {}
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(plain):
            for i, offset in places:
                hits.setdefault(i, []).append((end + 1 - size - offset, offset))
        for i, found in hits.items():
            if len(found) < 2:
                continue
            notice, _, k, _, _ = self.notices[i]
            found.sort()
            spans: list[list[int]] = []
            for (begin, offset), (after, other) in zip(found, found[1:], strict=False):
                # Of sorted places any two within k have neighbours within k between them; two of one piece don't agree by themselves, but others do with them.
                if after - begin > k:
                    continue
                if spans and begin - spans[-1][0] <= k:
                    spans[-1][1] = after
                    spans[-1][2] |= offset != other
                else:
                    spans.append([begin, after, offset != other])
            windows[i] = [[max(0, a - k), min(len(plain), b + len(notice) + k)] for a, b, agree in spans if agree]
        return windows

    def fuzzy(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(begin, end, notice, edits) of the notices in a text of words with single spaces: of each notice the leftmost, then the next behind it."""
        found = []
        for i, spans in self.windows(plain).items():
            _, _, _, first, best = self.notices[i]
            done = 0
            for a, b in spans:
                while done < b and (m := first(plain, max(a, done), b)):
                    m = best(plain, m.start(), m.end()) or m
                    found.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                    done = m.end()
        return sorted(found)

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        padded = b" " + b" ".join(words) + b" "
        places, labels, spans = [], set(), []
        gaps = None
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                gaps = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20) if gaps is None else gaps
                first = int(np.searchsorted(gaps, at))
                places.append(first)
                labels.add(label)
                spans.append((label, first, first + phrase.count(b" ") - 2, 0))
                at = padded.find(phrase, at + 1)
        base = ",".join(sorted(labels))
        plain = padded[1:-1].decode("utf-8", "surrogatepass")
        score = 1.0 if places else 0.0
        fuzzy = self.fuzzy(plain) if words else []
        gaps = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) == 0x20) if fuzzy else None
        for begin, end, i, edits in fuzzy:
            notice, label = self.notices[i][:2]
            labels.add(label)
            score = max(score, 1.0 - edits / len(notice))
            spans.append((label, int(np.searchsorted(gaps, begin, "right")), int(np.searchsorted(gaps, max(begin + 1, end - 1))), edits))
        spans.sort()
        return len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), score, [dict(zip(("label", "first_word", "last_word", "edits"), s, strict=True)) for s in spans]


@lru_cache(4)
def _scanner(phrases: tuple, notices: tuple, errors_per_char: float) -> Scanner:
    return Scanner(dict(phrases), dict(notices), errors_per_char)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def scan(df: DataFrame, text: str = "text", out: str = "license", *, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, errors_per_char: float = ERRORS_PER_CHAR) -> DataFrame:
    """df with a struct column `out`.

    n_words; n_base, first_word and last_word of the phrases' exact places (null without one); base_labels, and labels with those of
    notices found with errors, distinct, sorted, joined by commas (empty: none); score, 1 less the share of edits of the best match, 0 without one;
    matches with label, first and last word and edits. Null and empty texts have no words. Each notice is matched without overlaps, leftmost first; where
    notices share a place each gives its match. Repeated rows get equal results, an empty table gives an empty one. Other columns stay as they are, whatever their
    names (one called like `out` is replaced). Whole texts are searched, in time that grows with their length.
    """
    key = tuple(phrases.items()), tuple(notices.items()), errors_per_char

    @F.pandas_udf(FIELDS)
    def scanned(column: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([_scanner(*key).scan(t) for t in column], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return df.withColumn(out, scanned(column(text)))
