"""Licence scan by a positional rare-token index.

The index holds for each word of the templates its postings (template, position) and its IDF over the templates. Of each template the words of
highest IDF are its rare words: so many that a file without any of them falls short of ``MIN_COVERAGE`` of the template's IDF.
A file is looked up by the rare words it holds, the rarest first, for the templates all of whose key words it holds somewhere; each occurrence
gives candidates (template, relative position: file position minus template position). The postings of the candidates' templates are then
intersected by relative position: the IDF of all words that stand at one relative position is summed, and those at ``MIN_COVERAGE`` or
more stay. Last, the mandatory key phrase is verified in place. Nothing that reaches the coverage and holds its key phrase is lost.

Defined results: null text is empty text; no words give ``n_words`` 0, null first and last word, empty labels, score 0.
Every place counts, repeated rows give repeated rows, extra columns are ignored whatever their names, an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches

# Phrases that are a licence's name wherever they stand, and the label each gives.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices of well-known public licences as they stand in files: label, notice, mandatory key phrase.
NOTICES = (
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache license version 2 0"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "version 2 of the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "version 3 of the license"),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lesser general public license"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "merge publish distribute sublicense and or sell copies"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("odbl-1.0", "this database is made available under the open database license", "open database license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "publish use compile sell or distribute this software"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
)

# Identifiers that may follow the tag of a licence identifier; each gives its own name as label.
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()


def tagged(names=SPDX) -> tuple:
    """A notice for each identifier: the tag and the identifier's words, all of them mandatory."""
    said = [(n.lower(), " ".join(["spdx", "license", "identifier", *re.findall("[0-9a-z]+", n.lower())])) for n in names]
    return tuple((label, text, text) for label, text in said)


#: Share of a notice's IDF that has to stand at one relative position.
MIN_COVERAGE = 0.7

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long"

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and all that isn't ASCII. UTF-8 keeps these apart bytewise."""
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key_at: int
    key_len: int
    base: bool
    needed: float


class Index:
    """Postings of all templates, and the rare words that each is looked up by."""

    def __init__(self, base: dict[str, str] = BASE_PHRASES, notices=None):
        self.templates: list[Template] = []
        for phrase, label in base.items():
            w = tuple(phrase.encode().split())
            self.templates.append(Template(label, w, 0, len(w), True, 1.0))
        for label, notice, key in (*NOTICES, *tagged()) if notices is None else notices:
            w, k = tuple(notice.encode().split()), tuple(key.encode().split())
            at = next((i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k), None)
            if at is None:
                raise ValueError(f"the key phrase {key!r} doesn't stand in its notice")
            self.templates.append(Template(label, w, at, len(k), False, MIN_COVERAGE))
        df = Counter(w for t in self.templates for w in set(t.words))
        n = len(self.templates)
        self.idf = {w: math.log((n + 1) / c) for w, c in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.rare: dict[bytes, list[tuple[int, int]]] = {}
        self.weight: list[float] = []
        self.key_words = [frozenset(t.words[t.key_at : t.key_at + t.key_len]) for t in self.templates]
        for i, t in enumerate(self.templates):
            for q, w in enumerate(t.words):
                self.postings.setdefault(w, []).append((i, q))
            self.weight.append(sum(self.idf[w] for w in t.words))
            for q in self._lookup(t, self.weight[-1]):
                self.rare.setdefault(t.words[q], []).append((i, q))

    def _lookup(self, t: Template, weight: float) -> list[int]:
        """Positions of the rare words: those of highest IDF, so many that the coverage can't be reached without all of them."""
        without, out = weight, []
        for q in sorted(range(len(t.words)), key=lambda q: (-self.idf[t.words[q]], q)):
            if without < t.needed * weight - 1e-9:
                break
            out.append(q)
            without -= self.idf[t.words[q]]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float, int]:
        """Starts of base places, base labels, the method's labels, the best coverage, notices found."""
        starts: list[int] = []
        base: set[str] = set()
        own: set[str] = set()
        best, notices = 0.0, 0
        present = self.postings.keys() & set(words)
        able = {t for t, key in enumerate(self.key_words) if key <= present}
        found = {w for w in present & self.rare.keys() if any(t in able for t, _ in self.rare[w])}
        if not found:
            return starts, base, own, best, notices
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in present:
                at.setdefault(w, []).append(i)
        # rarest words first: each occurrence gives a template and its relative position
        candidates = {(t, i - q) for w in sorted(found, key=lambda w: (-self.idf[w], w)) for t, q in self.rare[w] if t in able for i in at[w]}
        for (t_no, start), covered in self._intersected(candidates, at).items():
            t = self.templates[t_no]
            lo, hi = start + t.key_at, start + t.key_at + t.key_len
            if covered < t.needed * self.weight[t_no] - 1e-9 or lo < 0 or tuple(words[lo:hi]) != t.words[t.key_at : t.key_at + t.key_len]:
                continue
            best = max(best, covered / self.weight[t_no])
            if t.base:
                starts.append(start)
                base.add(t.label)
            else:
                own.add(t.label)
                notices += 1
        return starts, base, own, min(best, 1.0), notices

    def _intersected(self, candidates: set[tuple[int, int]], at: dict[bytes, list[int]]) -> dict[tuple[int, int], float]:
        """For each candidate the IDF of its template's words that stand at the relative position."""
        wanted: dict[int, list[int]] = {}
        for t_no, start in candidates:
            wanted.setdefault(t_no, []).append(start)
        places = {w: np.array(i) for w, i in at.items()}
        out: dict[tuple[int, int], float] = {}
        for t_no, starts in wanted.items():
            relative, covered = np.sort(np.array(starts)), np.zeros(len(starts))
            for q, w in enumerate(self.templates[t_no].words):
                if w in places:
                    covered[np.isin(relative, places[w] - q, assume_unique=True)] += self.idf[w]
            out |= {(t_no, s): c for s, c in zip(relative.tolist(), covered.tolist(), strict=True)}
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=None, notices=None) -> DataFrame:
    """One row per document with its places, labels and score; no shuffle, one pass over the texts."""
    text_batches(docs)
    base = dict(base or BASE_PHRASES)

    def run(batches):
        index = Index(base, notices)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                starts, labels, own, score, n_notices = index.scan(words)
                out.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), score, n_notices))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
