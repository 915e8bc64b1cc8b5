"""License scans: phrases that stand word by word, and an exact set-similarity join of text blocks with templates.

A block is a line, or any run of consecutive words (over line ends) of `SLACK` times a template's length. A template is
met where a block holds a share THRESHOLD of its distinct words or more, its key words among them. Candidates come from
prefixes: with a template's words in the order of their frequency over all documents, rarest first, any block that
meets the threshold holds one of the first few. Only templates' words are counted, as no other word's place in that
order matters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NOT_WORD, hashed_words, record_batch, slices, table

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, notice or licence text, words that a block must hold.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("mit-notice", "Released under the MIT License", "mit"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "",
    ),
    (
        "apache-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
)
THRESHOLD, SLACK = 0.8, 1.25


def words_of(text: str):
    raw = text.encode("utf-8", "surrogatepass")
    return raw, *hashed_words(raw, NOT_WORD)


def frequencies(docs: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many blocks each of the templates' words occurs, over all documents."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    raw, start, _, h = words_of(t)
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    hit = wanted[at] == h
                    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), start[hit])
                    total += np.bincount(np.unique(np.stack((line, at[hit])), axis=1)[1], minlength=len(wanted))
        yield record_batch(schema, [wanted.view(np.int64), total])

    return {r.h: r.n for r in docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()}


class Prefixes:
    """Templates as word sets ordered from the rarest word on, and the index of their prefixes."""

    def __init__(self, templates, frequency: dict[int, int], threshold: float):
        self.sets, self.need, self.label, self.at, self.width, self.key = [], [], [], {}, [], []
        for label, text, key in templates:
            all_words = words_of(text)[3].view(np.int64).tolist()
            words = sorted(set(all_words), key=lambda x: (frequency.get(x, 0), x))
            if not words:
                continue
            need = math.ceil(threshold * len(words) - 1e-9)
            for i, w in enumerate(words[: len(words) - need + 1]):
                self.at.setdefault(w, []).append((len(self.sets), i))
            self.sets.append(words)
            self.need.append(need)
            self.label.append(label)
            self.width.append(math.ceil(SLACK * len(all_words)))
            self.key.append(set(words_of(key)[3].view(np.int64).tolist()))
        self.keys = np.array(sorted(self.at), np.int64)

    def match(self, block: set[int]) -> list[tuple[int, int]]:
        """Templates that a block meets, with the number of their words in it."""
        found, seen = [], set()
        for w in block & self.at.keys():
            for k, i in self.at[w]:
                words, need = self.sets[k], self.need[k]
                # length filter, then the positional one: what may still follow this word in the template
                if k in seen or len(block) < need:
                    continue
                before = sum(x in block for x in words[:i])
                if before + 1 + min(len(words) - i - 1, len(block) - before - 1) < need:
                    continue
                seen.add(k)
                n = sum(x in block for x in words)
                if n >= need and self.key[k] <= block:
                    found.append((k, n))
        return found

    def runs(self, words: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
        """Templates that some run of consecutive words meets, with the most words in one. Only runs around prefix
        words (places `hit`) are looked at; there, all of them, by a window over the places of the template's words."""
        zones: dict[int, list[list[int]]] = {}
        for p, w in zip(hit.tolist(), words[hit].tolist()):
            for k, _ in self.at[w]:
                lo, hi = max(0, p - self.width[k] + 1), p + self.width[k]
                z = zones.setdefault(k, [])
                if z and lo <= z[-1][1]:
                    z[-1][1] = hi
                else:
                    z.append([lo, hi])
        found = []
        for k, parts in zones.items():
            of, best = set(self.sets[k]), 0
            for lo, hi in parts:
                part = words[lo:hi].tolist()
                if len(of.intersection(part)) < self.need[k]:
                    continue
                at = [(n, w) for n, w in enumerate(part) if w in of]
                inside: dict[int, int] = {}
                first = 0
                for n, w in at:
                    inside[w] = inside.get(w, 0) + 1
                    while at[first][0] <= n - self.width[k]:
                        old = at[first][1]
                        inside[old] -= 1
                        if not inside[old]:
                            del inside[old]
                        first += 1
                    if len(inside) > best and len(inside) >= self.need[k] and self.key[k] <= inside.keys():
                        best = len(inside)
            if best:
                found.append((k, best))
        return found


def scan(docs: DataFrame, templates: DataFrame | tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    templates: (label, text) or (label, text, key words), as a table of a size that every worker can hold, or a tuple.
    score: the largest containment of a template met in a block, 0 if none is. Null texts count as empty: no words,
    empty labels. Templates that tie give all their labels. Repeated rows stay; other columns are ignored."""
    if isinstance(templates, DataFrame):
        key = F.coalesce("key", F.lit("")) if "key" in templates.columns else F.lit("")
        templates = [tuple(r) for r in templates.where("label is not null and text is not null").select("label", "text", key).collect()]
    wanted = np.unique(np.concatenate([words_of(t)[3] for _, t, *_ in templates] or [np.zeros(0, np.uint64)]))
    templates = [(*t, "")[:3] for t in templates]
    freq = frequencies(docs, wanted) if len(wanted) else {}
    phrases = [(words_of(p)[3], label) for p, label in PHRASES]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def one(doc_id, text, prefixes):
        raw, start, _, h = words_of(text or "")
        base, places = set(), []
        for p, label in phrases:
            at = np.flatnonzero(h[: max(0, len(h) - len(p) + 1)] == p[0])
            for k in range(1, len(p)):
                at = at[h[at + k] == p[k]]
            if len(at):
                base.add(label)
                places.append(at)
        labels, met = set(base), []
        signed = h.view(np.int64)
        hit = np.flatnonzero(np.isin(signed, prefixes.keys))
        if len(hit):
            ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            line = np.searchsorted(ends, start)
            for n in np.unique(line[hit]):
                lo, hi = np.searchsorted(line, n, "left"), np.searchsorted(line, n, "right")
                met += prefixes.match(set(signed[lo:hi].tolist()))
            met += prefixes.runs(signed, hit)
        labels.update(prefixes.label[k] for k, _ in met)
        score = max((n / len(prefixes.sets[k]) for k, n in met), default=0.0)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        return doc_id, len(h), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(base)), ",".join(sorted(labels)), score

    def run(batches):
        prefixes = Prefixes(templates, freq, threshold)
        for b in slices(batches):
            out = [one(d, t, prefixes) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield record_batch(schema, list(zip(*out)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
