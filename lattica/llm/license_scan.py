"""License scans by MinHash bands over overlapping windows.

For each template of m shingles, windows of 2m shingles start every m shingles, so any copy of the
template lies whole inside one of them: the window's resemblance s to the template is 1/2 at least
for an exact copy and 0.8 / 2.2 at least for a containment of 0.8. Signatures of ``HASHES``
independent minima are cut into bands of one row: a window meets a template in some band with
probability 1 - (1 - s)**HASHES, which misses fewer than one in 10**12. The retrieved template's
shingles are then counted exactly in the window: containment of 0.8 or more is a match.

A shingle is five words; a template of fewer words is one shingle of all its words and is found by
that shingle itself. A band is met in a shingle that window and template share, so signatures are
made only for windows that hold a shingle of the template, which one look at each shingle of the
text finds. Nothing is shuffled.

Defined cases: null text matches nothing. Repeated rows keep one row each. Ties of containment keep
every template. Very long texts are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import Filter, Hashes, runs, words_of

SHINGLE = 5
HASHES = 64
CONTAINED = 0.8

#: License notices, by name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

_SEEDS = np.frombuffer(b"".join(hashlib.blake2b(b"license %d" % i, digest_size=8).digest() for i in range(HASHES)), "<u8")[:, None]


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each of ``HASHES`` hash functions over shingles."""
    x = h ^ _SEEDS
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(33))).min(1)


class Templates:
    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.hashes = Hashes()
        self.names, self.sets, self.steps = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # words -> shingle -> templates
        self.long: list[int] = []
        for name, text in templates:
            w = words_of(text)
            if not w:
                continue
            h = runs(self.hashes.of(w), SHINGLE)
            t = len(self.names)
            self.names.append(name), self.sets.append(np.unique(h)), self.steps.append(len(h))
            if len(w) <= SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(h[0]), []).append(t)
            else:
                self.long.append(t)
        self.signatures = {t: minima(self.sets[t]) for t in self.long}
        self.filter = Filter(np.unique(np.concatenate([np.zeros(0, np.uint64), *(self.sets[t] for t in self.long)])))
        self.holds = {t: np.isin(self.filter.keys, self.sets[t]) for t in self.long}  # by place in the filter's keys

    def scan(self, text: str | None) -> list[tuple[str, int, float]]:
        """(name, first word of the window, containment), one for each name: the best."""
        words = words_of(text)
        best: dict[str, tuple[float, int]] = {}
        if not words:
            return []
        wh = self.hashes.of(words)
        for k, known in self.short.items():
            if len(words) >= k:
                h = runs(wh, k)
                for at in np.flatnonzero(np.isin(h, np.fromiter(known, np.uint64, len(known)))):
                    for t in known[int(h[at])]:
                        self._better(best, t, int(at), 1.0)
        h = runs(wh, SHINGLE) if len(words) >= SHINGLE else wh[:0]
        places, keys = self.filter.find(h)
        for t in self.long if len(places) else ():
            m = self.steps[t]
            b = places[self.holds[t][keys]] // m  # this block begins a window, and so does the one before
            for b in np.unique(np.concatenate([b, b[b > 0] - 1])).tolist():
                own = h[b * m : (b + 2) * m]
                if (minima(own) == self.signatures[t]).any():
                    share = float(np.isin(self.sets[t], own).mean())
                    if share >= CONTAINED:
                        self._better(best, t, b * m, share)
        return [(name, at, share) for name, (share, at) in sorted((n, (s, -neg)) for n, (s, neg) in best.items())]

    def _better(self, best: dict[str, tuple[float, int]], t: int, at: int, share: float) -> None:
        name = self.names[t]
        best[name] = max(best.get(name, (0.0, 0)), (share, -at))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses, licenses, containment) for each row: names in order, the containment of
    each."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    templates = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            found = [known.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([",".join(n for n, _, _ in x) for x in found], pa.string()), pa.array([[s for _, _, s in x] for x in found], pa.list_(pa.float64()))],
                ["doc_id", "n_licenses", "licenses", "containment"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_licenses int, licenses string, containment array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
