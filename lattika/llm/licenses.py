"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The units of a file are its lines that hold a word, the sentences of a line, its paragraphs (lines between ones without words), its comment blocks, and the file as a
whole; each is compared with licence templates by the cosine of TF-IDF vectors, term counts by 1 + log. Templates are notices, standard headers and, for units of
more than a line, the full texts. An SPDX line names its licence and scores 1. Tokens are runs of ASCII letters (case folded), digits, dots inside them, and non-ASCII bytes. Document frequencies count all lines of all files; only
the templates' terms, a fixed number, are kept, and every other term weighs like one that no line has. A unit below the threshold is no notice.

A directory's licence is that of its least path among files that declare one. A file without a notice takes the licence of its nearest
ancestor directory that has one: directories, not files, are expanded into their ancestors, so a crowded directory is one row.

Null text has no units. A null path has no directory and inherits nothing. Repeated rows get equal results. Ties between templates go to the first by name, between
lines to the earliest; a block counts as its first line and loses ties to lines, the file as a whole as line -1 and loses ties to all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, aside, byte_table, cut, slices, small_batches

THRESHOLD = 0.6
# Short notices of common licences; HEADERS has their standard headers and grants, license_texts their full texts.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause": "Released under the 2-Clause BSD License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
}


def _gnu(what: str, name: str, version: str) -> list[str]:
    """The header of a GNU licence: its grant alone, and whole; for the version alone and for later ones too."""
    grant = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
    rest = f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    grants = [grant + f"either version {version} of the License, or (at your option) any later version.", grant + f"version {version} of the License."]
    return [x + y for x in grants for y in ("", rest)]


_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD = "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."
HEADERS = {
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3") + ["GNU Affero General Public License, Version 3"],
    "Apache-2.0": [_APACHE, _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-3-Clause": [_BSD],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3") + _gnu("program", "Lesser General Public License", "3"),
    "MIT": [_MIT, "Licensed under the MIT License. See the LICENSE file in the project root for license information.", "The MIT License (MIT)"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
_SPDX = re.compile(rb"SPDX-License-Identifier:\s*([^\r\n]+)", re.I)
_COMMENT = (b"//", b"#", b"*", b"/*", b"--", b";", b"%", b"<!--")


def all_templates() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Short templates and full texts of each licence."""
    short = {k: [v, *HEADERS.get(k, [])] for k, v in TEMPLATES.items()}
    return short, {f.stem: [f.read_text(encoding="utf-8")] for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


_PARTS = bytes(b for b in range(1, 128) if not chr(b).isalnum())
_TABLE = byte_table(_PARTS, lower=True)


class Templates:
    """Terms of the templates, and each template's weighted vector once document frequencies are known."""

    def __init__(self, templates: dict[str, str | list[str]], full: dict[str, list[str]] | None = None):
        """templates: one or several texts a licence; full: further ones, which aren't compared with lines."""
        each = [(k, x, i > 0) for i, some in enumerate((templates, full or {})) for k, v in some.items() for x in ([v] if isinstance(v, str) else v)]
        each.sort(key=lambda x: x[0])
        self.names, self.full = [x[0] for x in each], np.array([x[2] for x in each])
        w = Words([x[1].encode() for x in each], _TABLE)
        self.terms = np.unique(w.hash)
        self.tf = np.zeros((len(self.terms), len(self.names)))
        np.add.at(self.tf, (np.searchsorted(self.terms, w.hash), w.text_of()), 1.0)

    def place(self, h: np.ndarray) -> np.ndarray:
        """The term of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf, self.other = np.log((1 + n) / (1 + df)) + 1, np.log(1 + n) + 1
        x = np.where(self.tf > 0, 1 + np.log(np.maximum(self.tf, 1)), 0) * self.idf[:, None]
        self.vectors = x / np.linalg.norm(x, axis=0)


def _units(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of all lines, the text of each line and its number there."""
    lines = [t.split(b"\n") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    number = np.concatenate([np.arange(len(x)) for x in lines]) if lines else np.empty(0, np.int64)
    return Words([x for t in lines for x in t], _TABLE), owner, number


def _cosines(t: Templates, unit: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """units x templates, for words h of units"""
    place = t.place(h)
    inside = place >= 0
    k = len(t.terms)
    cell, count = np.unique(unit[inside] * k + place[inside], return_counts=True)
    weight = (1 + np.log(count)) * t.idf[cell % k]
    dots = np.zeros((n, len(t.names)))
    rows, first = np.unique(cell // k, return_index=True)  # units without a term stay 0
    ends = np.append(first, len(cell))
    a = 0
    while a < len(rows):  # some cells at a time, whole units
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 16), "right")) - 1)
        own = slice(ends[a], ends[b])
        dots[rows[a:b]] = np.add.reduceat(weight[own, None] * t.vectors[cell[own] % k], ends[a:b] - ends[a], axis=0)
        a = b
    square = np.bincount(cell // k, weight**2, minlength=n)
    pair = np.stack([unit[~inside], h[~inside].view(np.int64)], axis=1) if (~inside).any() else np.empty((0, 2), np.int64)
    # words outside the templates matter only where there is something to divide
    pair = pair[square[pair[:, 0]] > 0]
    if len(pair):
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)]))
        times = np.diff(np.append(first, len(pair)))
        square += np.bincount(pair[first, 0], ((1 + np.log(times)) * t.other) ** 2, minlength=n)
    return dots / np.sqrt(np.maximum(square, 1e-300))[:, None]


def _runs(on: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of lines with ``on`` in a text that each line is in (-1: none), and each run's first line."""
    follows = np.concatenate([[False], on[:-1] & (owner[1:] == owner[:-1])]) if len(on) else on
    starts = on & ~follows
    return np.where(on, np.cumsum(starts) - 1, -1), np.flatnonzero(starts)


def _spdx(line: bytes, names: set[str]) -> str | None:
    """The first known licence of an SPDX line."""
    if (m := _SPDX.search(line)) is None:
        return None
    ids = {k.lower(): k for k in names}
    for x in re.findall(r"[a-z0-9.+-]+", m.group(1).decode("utf-8", "replace").lower()):
        if (k := ids.get(re.sub(r"(-only|-or-later|\+)$", "", x))) is not None:
            return k
    return None


def best_of(t: Templates, texts: list[bytes], threshold: float) -> list[tuple]:
    """licence, score and line of the best unit of each text, nulls below the threshold."""
    lines = [x.split(b"\n") for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    number = np.concatenate([np.arange(len(x)) for x in lines])
    flat = [x for some in lines for x in some]
    parts = [x.split(b". ") for x in flat]
    n_parts = np.array([len(x) for x in parts])
    line_of = np.repeat(np.arange(len(flat)), n_parts)
    w = Words([x for some in parts for x in some], _TABLE)
    piece = w.text_of()
    line = line_of[piece]
    top: dict[int, tuple] = {}

    def offer(cosines: np.ndarray, text: np.ndarray, at: np.ndarray) -> None:
        best, name = cosines.max(axis=1, initial=0), cosines.argmax(axis=1)
        for i in np.flatnonzero(best >= threshold).tolist():
            d = int(text[i])
            if d not in top or best[i] > top[d][1] + 1e-12:
                top[d] = (t.names[name[i]], float(best[i]), int(at[i]))

    def compare(unit: np.ndarray, on: np.ndarray, n: int, full: bool) -> np.ndarray:
        got = _cosines(t, unit[on], w.hash[on], n)
        if not full:
            got[:, t.full] = 0
        return got

    known = set(t.names)
    for i in [i for i, x in enumerate(flat) if b"dentifier:" in x or b"DENTIFIER:" in x]:
        if (k := _spdx(flat[i], known)) is not None:
            top.setdefault(int(owner[i]), (k, 1.0, int(number[i])))
    every = np.ones(len(line), bool)
    offer(compare(line, every, len(flat), False), owner, number)
    several = n_parts[line] > 1
    if several.any():
        own, unit = np.unique(piece[several], return_inverse=True)
        got = _cosines(t, unit, w.hash[several], len(own))
        got[:, t.full] = 0
        offer(got, owner[line_of[own]], number[line_of[own]])
    has = np.bincount(line, minlength=len(flat)) > 0
    comment = np.array([x.lstrip().startswith(_COMMENT) for x in flat], bool)
    for on in (has, comment):
        run, first = _runs(on, owner)
        inside = run[line] >= 0
        if inside.any():
            offer(compare(run[line], inside, len(first), True), owner[first], number[first])
    if len(line):
        offer(compare(owner[line], every, len(texts), True), np.arange(len(texts)), np.full(len(texts), -1))
    return [top.get(d, (None, None, None)) for d in range(len(texts))]


def match_files(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``files`` but text, with own_license, own_score and own_line (null: no notice) of each row. Columns that had these names end in an underscore."""
    spark = files.sparkSession
    small_batches(spark)
    base = Templates(templates) if templates else Templates(*all_templates())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, k = np.zeros(len(base.terms), np.int64), 0, len(base.terms)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in slices(texts):
                w, _, _ = _units(texts[a:b])
                place, line = base.place(w.hash), w.text_of()
                df += np.bincount(np.unique(line[place >= 0] * k + place[place >= 0]) % k, minlength=k)
                n += int((np.diff(w.at) > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), pa.array(np.append(df, n))], names=["term", "n"])

    got = {r["term"]: r["n"] for r in files.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a template term
    base.weigh(np.array([got.get(i, 0) for i in range(len(base.terms))], float), got.get(len(base.terms), 0))
    shared = spark.sparkContext.broadcast(base)  # its size is the templates'

    @F.pandas_udf("own_license string, own_score double, own_line long")
    def match(series):
        import pandas as pd

        t, out = shared.value, []
        texts = [x.encode() if x else b"" for x in series]
        for a, b in slices(texts):
            out += best_of(t, texts[a:b], threshold)
        return pd.DataFrame({"own_license": pd.array([x[0] for x in out], dtype="object"), "own_score": pd.array([x[1] for x in out], dtype="Float64"), "own_line": pd.array([x[2] for x in out], dtype="Int64")})

    files = aside(files, ["own_license", "own_score", "own_line"])
    return files.select(F.struct(*[c for c in files.columns if c != "text"]).alias("_row"), match(F.col("text")).alias("_m")).select("_row.*", "_m.*")


def directory(path: Column) -> Column:
    """A path without its last part; "" at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, declares: Column) -> DataFrame:
    """``files`` (path, own_license, ...) with license and inherited_from: the directory it comes from, null for an own notice or none.

    Columns that had these names end in an underscore.
    """
    files = aside(files, ["license", "inherited_from"])
    kept = files.select(F.struct(*files.columns).alias("_row"), "path", "own_license", directory(F.col("path")).alias("_dir"), declares.alias("_declares"))
    declared = kept.filter(F.col("_declares") & F.col("own_license").isNotNull() & F.col("_dir").isNotNull())
    of_dir = declared.groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct("path", "own_license"))["own_license"].alias("_dir_license"))
    dirs = kept.select("_dir").filter("_dir is not null").distinct()
    parts = F.filter(F.split("_dir", "/"), lambda x: x != "")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    up = dirs.select("_dir", F.explode(F.array_distinct(above)).alias("_at")).join(of_dir, "_at")
    nearest = up.groupBy("_dir").agg(F.max(F.struct(F.length("_at").alias("n"), "_at", "_dir_license")).alias("_up")).withColumnRenamed("_dir", "_of")
    rows = kept.join(nearest, kept["_dir"] == nearest["_of"], "left")
    own = F.col("own_license").isNotNull()
    return rows.select("_row.*", F.coalesce("own_license", "_up._dir_license").alias("license"), F.when(~own, F.col("_up._at")).alias("inherited_from"))


def scan(files: DataFrame, declares: Column | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Own notices and inherited licences of ``files`` (path, text, ...). By default files named LICENSE, LICENCE, COPYING or NOTICE declare for their directory."""
    declares = F.col("path").rlike(r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$") if declares is None else declares
    return inherit(cut(match_files(files, templates, threshold)), declares)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, own_line, license and inherited_from of each row of ``docs``.

    A document's path is its source, its number over 1,000, for odd numbers also over 100, and the number. As documents have no file names, any with a notice declares for its directory.
    """
    id_ = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("_")), F.floor(id_ / 1000).cast("string"), F.when(id_ % 2 == 1, F.floor(id_ / 100).cast("string")), id_.cast("string"))
    return scan(docs.select(id_.alias("doc_id"), F.when(id_.isNotNull(), path).alias("path"), "text"), F.lit(True))
