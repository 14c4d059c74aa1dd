"""Licence scans: positional index of rare licence words.

1. index: every template is a word sequence; each of its words posts (template, position).  The words' document
   frequencies are counted over the whole corpus (one narrow pass, a bounded row per template word);
2. search: a file's template words are ranked by inverse document frequency; the rarest PROBES of a template look up
   their postings, and postings at the same distance (file position minus template position, within the template's
   slack) vote for one placement of one template;
3. verify: the template's words are matched in order within that slack of the placement, so words may be added or
   missing between them; every key phrase must stand inside the matched stretch.  The score is the matched share of the
   template's words, and a label's score that of its best template (names are ``label`` or ``label#which``).

The phrases of the base rule are found on the words themselves and give labels of their own.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import alnum_words, batch, id_and_text, map_arrow, pylist, table

# fixed values: the base rule's phrases and labels
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GNU = ("This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License "
        "as published by the Free Software Foundation{either} version {n} of the License, or (at your option) any later version.")
_CC = ("This work is licensed under {article} Creative Commons {kind} 4.0 International License. To view a copy of this license, visit "
       "http://creativecommons.org/licenses/{path}/4.0/")


def _text(name: str) -> str:
    return pkgutil.get_data("newsloom.llm", f"licenses/{name}.txt").decode()


# fixed values: short licence lines, the notices that the licences' authors publish for use in files, and whole licence
# texts (licenses/), each with the key phrases that must be present
TEMPLATES = {
    "mit-notice": ("Released under the MIT License.", ["mit license"]),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted", "free of charge"]),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    "lgpl": ("licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    "agpl-3.0": ("licensed under the GNU Affero General Public License, version 3", ["affero general public license"]),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ["redistribution and use in source and binary forms"]),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", ["cc by 4 0"]),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    "cc-by-nc-sa-4.0": ("Licensed under CC BY-NC-SA 4.0.", ["cc by nc sa 4 0"]),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0.", ["cc by nd 4 0"]),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright, CC0 1.0 Universal", ["cc0 1 0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    "all-rights-reserved": ("All rights reserved.", ["all rights reserved"]),
    "apache-2.0#notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.", ["apache license", "version 2 0"]),
    "gpl-2.0#notice": (_GNU.format(colon=";", kind="", either="; either", n=2), ["gnu general public license", "version 2 of the license"]),
    "gpl-3.0#notice": (_GNU.format(colon=":", kind="", either=", either", n=3), ["gnu general public license", "version 3 of the license"]),
    "agpl-3.0#notice": (_GNU.format(colon=":", kind="Affero ", either=", either", n=3), ["gnu affero general public license", "version 3 of the license"]),
    "lgpl#notice": (_GNU.format(colon=":", kind="Lesser ", either=", either", n=3), ["gnu lesser general public license", "of the license"]),
    "mpl-2.0#notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                       "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mozilla public license", "v 2 0"]),
    "cc-by-4.0#notice": (_CC.format(article="the", kind="Attribution", path="by"), ["creative commons attribution 4 0"]),
    "cc-by-sa-4.0#notice": (_CC.format(article="the", kind="Attribution-ShareAlike", path="by-sa"), ["creative commons attribution sharealike 4 0"]),
    "cc-by-nc-4.0#notice": (_CC.format(article="the", kind="Attribution-NonCommercial", path="by-nc"), ["creative commons attribution noncommercial 4 0"]),
    "cc-by-nc-sa-4.0#notice": (_CC.format(article="the", kind="Attribution-NonCommercial-ShareAlike", path="by-nc-sa"),
                               ["creative commons attribution noncommercial sharealike 4 0"]),
    "cc-by-nd-4.0#notice": (_CC.format(article="the", kind="Attribution-NoDerivatives", path="by-nd"), ["creative commons attribution noderivatives 4 0"]),
    "gpl-2.0#text": (_text("GPL-2"), ["gnu general public license", "version 2 june 1991"]),
    "gpl-3.0#text": (_text("GPL-3"), ["gnu general public license", "version 3 29 june 2007"]),
    "lgpl#text-2.1": (_text("LGPL-2.1"), ["gnu lesser general public license", "version 2 1 february 1999"]),
    "lgpl#text-3": (_text("LGPL-3"), ["gnu lesser general public license", "version 3 29 june 2007"]),
    "apache-2.0#text": (_text("Apache-2.0"), ["apache license", "version 2 0 january 2004"]),
    "mpl-2.0#text": (_text("MPL-2.0"), ["mozilla public license", "version 2 0"]),
    "bsd#text": (_text("BSD"), ["redistribution and use in source and binary forms"]),
    "cc0-1.0#text": (_text("CC0-1.0"), ["cc0 1 0 universal"]),
}

PROBES = 4       # rarest words of a file-template pair that vote
SLACK = 2        # words by which one placement's votes may differ, and one more for every SLACK_SHARE words of a template
SLACK_SHARE = 8


def _words(text: str) -> list[bytes]:
    return alnum_words(text.encode())


def find_phrase(words: list[bytes], places: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Starts at which the phrase's words stand consecutively; ``places``: positions of template words."""
    anchor = min(range(len(phrase)), key=lambda k: len(places.get(phrase[k], ())))
    n = len(phrase)
    return [p - anchor for p in places.get(phrase[anchor], ()) if p >= anchor and words[p - anchor:p - anchor + n] == phrase]


def ordered_match(places: dict[bytes, list[int]], template: dict[bytes, list[int]], shift: int, slack: int) -> list[int]:
    """File positions of the longest common subsequence of the file and the template (both as positions of each word)
    that keeps within ``slack`` of the placement at ``shift``."""
    pairs = []
    for word, own in template.items():
        at = places.get(word)
        if at:
            for k in own:
                j = bisect_left(at, shift + k - slack)
                while j < len(at) and at[j] <= shift + k + slack:
                    pairs.append((k, -at[j]))
                    j += 1
    # longest increasing subsequence of file positions; a template position is used once, as its pairs descend
    ends: list[int] = []
    nodes: list[int] = []
    before: list[int] = []
    pairs.sort()
    for i, (_, p) in enumerate(pairs):
        n = bisect_left(ends, -p)
        before.append(nodes[n - 1] if n else -1)
        ends[n:n + 1], nodes[n:n + 1] = [-p], [i]
    out, i = [], nodes[-1] if nodes else -1
    while i >= 0:
        out.append(-pairs[i][1])
        i = before[i]
    return out[::-1]


class Index:
    """Postings of the templates' words and their inverse document frequencies."""

    def __init__(self, templates: dict, frequency: dict[bytes, int], documents: int):
        self.templates = {k: (_words(text), [_words(p) for p in keys]) for k, (text, keys) in templates.items()}
        self.base = [(_words(p), label) for p, label in BASE_PHRASES.items()]
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, (words, _) in self.templates.items():
            for k, w in enumerate(words):
                self.postings[w].append((name, k))
        self.places: dict[str, dict[bytes, list[int]]] = {name: defaultdict(list) for name in self.templates}
        for name, (words, _) in self.templates.items():
            for k, w in enumerate(words):
                self.places[name][w].append(k)
        self.key_words = {name: {w for key in keys for w in key} for name, (_, keys) in self.templates.items()}
        self.base_words = [set(p) for p, _ in self.base]
        self.vocabulary = set(self.postings) | {w for p, _ in self.base for w in p}
        self.idf = {w: float(np.log((1 + documents) / (1 + frequency.get(w, 0)))) for w in self.vocabulary}
        self.rarest = {name: sorted(own, key=lambda w: (-self.idf[w], w)) for name, own in self.places.items()}

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], dict[str, float]]:
        """(starts of base phrases, base labels, score of each template found)."""
        held = self.vocabulary.intersection(words)
        candidates = [name for name, own in self.key_words.items() if own <= held]
        if not candidates and not any(own <= held for own in self.base_words):
            return [], set(), {}
        places: dict[bytes, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            if w in held:
                places[w].append(k)
        starts, labels = [], set()
        for phrase, label in self.base:
            at = find_phrase(words, places, phrase)
            starts += at
            if at:
                labels.add(label)
        scores: dict[str, float] = {}
        for name in candidates:
            template, keys = self.templates[name]
            found = [find_phrase(words, places, key) for key in keys]
            if not all(found):
                continue
            own, slack, chosen = self.places[name], SLACK + len(template) // SLACK_SHARE, []
            for w in self.rarest[name]:
                if w in held:
                    chosen += [(w, k) for k in own[w]]
                    if len(chosen) >= PROBES:
                        break
            votes = Counter(p - k for w, k in chosen for p in places[w])
            shifts = sorted(votes)
            totals = [0]
            for shift in shifts:
                totals.append(totals[-1] + votes[shift])
            best, tried = 0.0, []
            for shift, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
                near = totals[bisect_left(shifts, shift + slack + 1)] - totals[bisect_left(shifts, shift - slack)]
                place = bisect_left(tried, shift)
                if near < min(2, len(template)) or any(abs(shift - x) <= slack // 4 for x in tried[max(0, place - 1):place + 1]):
                    continue
                tried.insert(place, shift)
                match = ordered_match(places, own, shift, slack)
                if len(match) <= best * len(template):
                    continue
                lo, hi = max(0, match[0] - slack), match[-1] + 1 + slack
                if all(any(lo <= p and p + len(key) <= hi for p in at) for key, at in zip(keys, found)):
                    best = len(match) / len(template)
                    if best == 1.0:
                        break
            if best > 0.5:
                label = name.split("#")[0]
                scores[label] = max(best, scores.get(label, 0.0))
        return starts, labels, scores


def word_frequencies(data: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Document frequency of every template word over all documents, and the number of documents."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for data in pylist(b, "data"):
                seen.update(vocabulary.intersection(alnum_words(data)))
            seen[b""] += b.num_rows
        yield batch(schema, {"word": list(seen), "n": list(seen.values())})

    rows = map_arrow(data, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES) -> DataFrame:
    """One row per document row: doc_id, n_words, starts (of base phrases), base_labels, found (template -> score).

    Null or empty texts have no words and no labels; words are compared after lower-casing A-Z; several places of a
    template give its best score; repeated rows and null ids are each scanned.
    """
    data = id_and_text(docs, id_col, text_col)
    counts, n = word_frequencies(data, Index(templates, {}, 0).vocabulary)
    held = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())),
                        ("base_labels", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, held.value, n)
        for b in batches:
            cols: dict = {c: [] for c in ("n_words", "starts", "base_labels", "names", "scores")}
            for x in pylist(b, "data"):
                words = alnum_words(x)
                starts, labels, found = index.scan(words)
                cols["n_words"].append(len(words))
                cols["starts"].append(sorted(starts))
                cols["base_labels"].append(sorted(labels))
                cols["names"].append(sorted(found))
                cols["scores"].append([found[k] for k in sorted(found)])
            yield batch(schema, {"doc_id": b.column(0)} | cols)

    out = map_arrow(data, run, "doc_id long, n_words long, starts array<long>, base_labels array<string>, names array<string>, scores array<double>")
    return out.select("doc_id", "n_words", "starts", "base_labels", F.map_from_arrays("names", "scores").alias("found"))


def op7_license_scan(spark, sf_dir):
    """Licence phrases and templates in all documents by a positional rare-word index (see module).
    score: the best template's score, 1 where a base phrase stands without one, 0 where nothing was found."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.map_values("found"))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.map_keys("found"))), ",").alias("labels"),
        F.coalesce(best, F.when(F.size("starts") > 0, 1.0).otherwise(0.0)).alias("score"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict[str, str] = {}
