"""License scan by a positional rare-token index.

The licence words are those of the templates, weighed by their IDF over these. Each template's highest-IDF words are the rare
ones; a rare word is posted with every (template, position) that holds it. A file's rare words are looked up, their
postings intersected by relative position into (template, place), and a place counts once enough of the template's words
by IDF stand where they should and its mandatory key phrases stand there. Words: A-Z lowered, runs of 0-9, a-z and all
characters beyond ASCII.

Null or empty text: no words, no labels, score 0. Null doc_id: kept as it is. Repeated rows: one result row each. Very long
texts: taken in pieces that overlap by a template's length. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, map_batches, pieces

#: Phrases of the base scan and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Licence statements and standard notices as they stand in files (label, template, mandatory key phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]

#: Identifiers that stand after "SPDX-License-Identifier:" and their labels.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 3 0": "gpl-3", "gpl 2 0": "gpl-2", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc": "isc", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by nc 4 0": "cc-by-nc", "cc by sa 4 0": "cc-by-sa",
}
TEMPLATES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for name, label in SPDX.items()]

#: Words so common in any text that a file's are never looked up.
COMMON = {b"a", b"all", b"and", b"any", b"are", b"as", b"at", b"by", b"for", b"in", b"is", b"of", b"or", b"the", b"this", b"to", b"with", b"you"}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Index:
    """Postings of the templates' rare words: word -> [(template, position)]."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES, anchors: int = 3):
        """anchors: how many of a template's highest-IDF words are rare ones (one of a base phrase: every place holds it)."""
        entries = [(label, t.encode().split(), [k.encode().split() for k in keys], False) for label, t, keys in templates]
        entries += [(label, p.encode().split(), [p.encode().split()], True) for p, label in base.items()]
        df = Counter(w for _, words, _, _ in entries for w in set(words))
        self.idf = {w: math.log(1 + len(entries) / n) for w, n in df.items()}
        self.entries = entries
        self.total = [sum(self.idf[w] for w in words) for _, words, _, _ in entries]
        self.longest = max((len(words) for _, words, _, _ in entries), default=0)
        rare = {w for _, words, _, is_base in entries for w in sorted(set(words) - COMMON, key=lambda w: (-self.idf[w], w))[: 1 if is_base else anchors]}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _, _) in enumerate(entries):
            for p, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, p))

    def scan(self, text: bytes, least: float = 0.6) -> dict:
        """least: IDF-weighted share of a template's words that must stand in place."""
        out: dict = {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        labels: set[str] = set()
        base: set[str] = set()
        words: list[bytes] = []
        start, parts = 0, list(pieces(text))  # start: the place of the window's first word
        for number, piece in enumerate(parts):
            words = words + WORD.findall(piece.lower())
            last = number == len(parts) - 1
            if not self.postings.keys().isdisjoint(words):
                self._window(words, start, last, least, labels, base, out)
            if not last:  # places so near to the end are looked at with the next piece
                gone = max(0, len(words) - self.longest + 1)
                start, words = start + gone, words[gone:]
        out["n_words"] = start + len(words)
        return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": min(1.0, out["score"])}

    def _window(self, words: list[bytes], start: int, last: bool, least: float, labels: set, base: set, out: dict) -> None:
        votes = {(t, i - p) for i, w in enumerate(words) if w in self.postings for t, p in self.postings[w]}
        for t, at in votes:
            if (at < 0 and start) or (not last and at > len(words) - self.longest):
                continue  # looked at with the piece before, or with the next
            label, template, keys, is_base = self.entries[t]
            near = words[max(0, at) : max(0, at + len(template))]
            if is_base:
                if at >= 0 and near == template:
                    out["n_base"] += 1
                    out["first_word"] = start + at if out["first_word"] is None else min(out["first_word"], start + at)
                    out["last_word"] = start + at if out["last_word"] is None else max(out["last_word"], start + at)
                    out["score"] = 1.0
                    base.add(label)
                continue
            share = sum(self.idf[w] for p, w in enumerate(template) if 0 <= at + p < len(words) and words[at + p] == w) / self.total[t]
            if share >= least and all(any(near[i : i + len(k)] == k for i in range(len(near) - len(k) + 1)) for k in keys):
                labels.add(label)
                out["score"] = max(out["score"], share)
                out["spans"].append((label, start + max(0, at), start + min(len(words), at + len(template))))


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): one narrow pass, no shuffle."""
    index = index or Index()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batch):
        found = [index.scan(t) for t in column_bytes(batch.column(1))]
        return {"doc_id": batch.column(0)} | {k: [x[k] for x in found] for k in names[1:]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, SCHEMA)
