"""License scans: MinHash bands over overlapping text windows retrieve templates; exact shingle containment verifies them.

Words are lower-cased runs of letters, digits and non-ASCII characters; shingles have SHINGLE words (a shorter template is one
shingle of its own length). A template of n words is sought in windows of 2 * m words that start every m words, where m is
the power of two from n up, so every passage of its length lies whole in a window. A window's signature is BANDS bands of one MinHash row each; it
retrieves the templates that agree with it in a band. A window that holds a share CONTAINED of a template's shingles has a Jaccard likeness of 0.12 or
more with it, whatever n is (4 of 29 shingles at worst), so one row a band and 160 bands retrieve it with a probability of over 1 - 2e-9. A template of
one shingle would be less alike to such a window, so it is sought in windows of one shingle. A window that holds no shingle of any template agrees with
none in any band and is not signed. A template retrieved is verified by the share of its shingles that the window holds; CONTAINED or more is a finding.
Templates with the same findings (ties) are all given.

Nulls: a null or empty text has no findings. Repeated rows get equal results. Input columns that clash with the added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import U, Words, letter_words, mixed, text_slices, window_hash

SHINGLE = 5
BANDS = 160
CONTAINED = 0.8
ADDED = "licenses array<struct<license:string,containment:double,start:int,end:int>>"

# Short public license notices and statements.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
_SALT = mixed(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))

#: Templates are held by every task.
MOST_TEMPLATES = 20_000


def signature(shingles: np.ndarray) -> np.ndarray:
    """The BANDS MinHash values of a set of shingle hashes."""
    return mixed(shingles[None, :] ^ _SALT[:, None]).min(1)


class Group:
    """Templates that are sought in the same windows: which of them a band's value retrieves, and all their shingles."""

    def __init__(self, k: int, m: int, single: bool):
        self.k, self.m, self.single = k, m, single
        self.rows: list[dict] = []
        self.bands: dict[tuple[int, int], list[dict]] = {}
        self.shingles = np.empty(0, U)

    def add(self, name: str, shingles: np.ndarray) -> None:
        row = {"name": name, "shingles": shingles}
        self.rows.append(row)
        for band in enumerate(signature(shingles).tolist()):
            self.bands.setdefault(band, []).append(row)
        self.shingles = np.union1d(self.shingles, shingles)

    def retrieved(self, window: np.ndarray) -> list[dict]:
        """The templates that agree in a band with a window (its distinct shingles), each once."""
        parts = window[np.isin(window, self.shingles)][:, None] if self.single else [window]
        found = {id(r): r for part in parts for band in enumerate(signature(part).tolist()) for r in self.bands.get(band, ())}
        return list(found.values())


class Templates:
    """The templates in groups by size of shingle and of window."""

    def __init__(self, templates: list[tuple[str, str]]):
        data = [t.encode() for _, t in templates]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(data), np.uint8), offsets, letter_words(), lower=True)
        groups: dict[tuple, Group] = {}
        for i, (name, _) in enumerate(templates):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h):
                k, m = min(SHINGLE, len(h)), 1 << max(3, (len(h) - 1).bit_length())
                shingles = np.unique(window_hash(h, k))
                key = k, m, len(shingles) == 1
                groups.setdefault(key, Group(*key)).add(name, shingles)
        self.groups = list(groups.values())
        self.shingles = {k: np.unique(np.concatenate([g.shingles for g in self.groups if g.k == k])) for k in sorted({g.k for g in self.groups})}


def _scan(t: Templates, hashes: np.ndarray) -> list[dict]:
    """Findings in one text's word hashes."""
    found: dict[str, dict] = {}
    for g in t.groups:
        s = window_hash(hashes, g.k)
        at = np.flatnonzero(np.isin(s, g.shingles)) // g.m
        for start in np.unique(np.concatenate([at, at - 1])) * g.m:
            window = s[max(0, start) : start + 2 * g.m - g.k + 1]
            if start < 0 or not len(window):
                continue
            held = np.unique(window)
            for r in g.retrieved(held):
                share = np.isin(r["shingles"], held).sum() / len(r["shingles"])
                if share >= CONTAINED and (r["name"] not in found or share > found[r["name"]]["containment"]):
                    places = np.flatnonzero(np.isin(window, r["shingles"])) + start
                    found[r["name"]] = {"license": r["name"], "containment": float(share), "start": int(places[0]), "end": int(places[-1] + g.k)}
    return sorted(found.values(), key=lambda x: (x["start"], x["license"]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES) -> DataFrame:
    """docs' columns, then licenses: each template found, its containment and the words it spans, in order of place.

    templates: (name, text) pairs, or a table with columns name and text of MOST_TEMPLATES rows at most (a larger one is refused).
    """
    if isinstance(templates, DataFrame):
        rows = templates.select("name", "text").where("name is not null and text is not null").distinct().orderBy("name", "text").limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = [(r["name"], r["text"]) for r in rows]
    kept = [f for f in docs.schema if f.name.lower() != "licenses"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, is_word = Templates(templates), letter_words()
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets, is_word, lower=True)
                doc = w.doc_of()
                near = np.zeros(b - a, bool)
                for k, shingles in t.shingles.items():
                    near[doc[np.flatnonzero(np.isin(window_hash(w.hash, k), shingles))]] = True
                found = [_scan(t, w.hash[w.first[i] : w.first[i + 1]]) if near[i] else [] for i in range(b - a)]
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in kept), pa.array(found, kind)], [*(f.name for f in kept), "licenses"])

    return docs.mapInArrow(run, schema)
