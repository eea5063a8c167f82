"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fields, join_bounded, materialize, table
from .licence_texts import FULL

#: Notices and opening words of public licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
#: Short names that notices use, and identifiers of the SPDX list that count as one licence here.
SHORT: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Licensed under Apache 2.0"),
    "MIT": ("MIT License", "Licensed under MIT"),
    "GPL-3.0": ("Licensed under GPLv3", "Licensed under the GPL, version 3"),
    "GPL-2.0": ("Licensed under GPLv2", "Licensed under the GPL, version 2"),
    "LGPL-3.0": ("Licensed under LGPLv3",),
    "AGPL-3.0": ("Licensed under AGPLv3",),
    "MPL-2.0": ("Licensed under MPL 2.0", "Mozilla Public License 2.0"),
}
IDENTIFIERS = {n: (f"{n}-only", f"{n}-or-later") if "GPL" in n else (n,) for n in TEMPLATES if n != "Proprietary"}
TEMPLATES = {n: (*own, *SHORT.get(n, ()), *(f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS.get(n, ()))) for n, own in TEMPLATES.items()}
#: Least cosine of a notice and a template; share of a line's words that templates must have for it to be part of a notice.
LEAST, SHARE = 0.8, 0.5
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_FILE = re.compile(r"(?:^|/)(?:un)?(?:licen[sc]e|copying|copyright|notice)[^/]*$", re.IGNORECASE)


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


#: Terms of notices, and of notices and whole licences.
NOTICE = frozenset(t for texts in TEMPLATES.values() for x in texts for t in terms(x))
VOCABULARY = NOTICE.union(*(terms(x) for x in FULL.values()))
#: A term that a licence without a whole text here has more often than the one that it resembles.
OTHERS = {"GPL-3.0": "affero"}


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and of files that have each template term, over all whole texts. The driver gets one count a term of the fixed vocabulary."""
    bounded_batches(files.sparkSession)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[""] += 1
                seen.update(VOCABULARY.intersection(_TERM.findall(t.lower())) if t else ())
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    rows = files.select("text").mapInArrow(task, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop("", 0), found


class Matcher:
    def __init__(self, total: int, df: dict[str, int]):
        self.idf = {t: log((1 + total) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.rare = log(1 + total) + 1  # of a term that no template has
        self.templates = [(name, *self.vector(x)) for name in sorted(TEMPLATES) for x in TEMPLATES[name]]
        self.full = [(name, *self.vector(x)) for name, x in sorted(FULL.items())]
        self.number = {t: i for i, t in enumerate(sorted(VOCABULARY))}
        self.square = np.array([*(self.idf[t] ** 2 for t in sorted(VOCABULARY)), self.rare**2])
        self.spans = []
        sizes = [len(terms(x)) for name in sorted(TEMPLATES) for x in TEMPLATES[name]]
        self.share = np.zeros((len(self.number), len(self.templates) + len(self.full)))  # of each term in a template's squared norm
        for k, (name, w, m) in enumerate([*self.templates, *self.full]):
            for t, x in w.items():
                self.share[self.number[t], k] = (x / m) ** 2
            if k < len(sizes):
                weight = np.zeros(len(self.square))
                for t, x in w.items():
                    weight[self.number[t]] = x * self.idf[t]
                self.spans.append((name, sizes[k], weight, m))

    def vector(self, text: str) -> tuple[dict[str, float], float]:
        v = {t: n * self.idf.get(t, self.rare) for t, n in Counter(terms(text)).items()}
        return v, sqrt(sum(x * x for x in v.values()))

    def reachable(self, words: set[str]) -> tuple[list[int], list[int]]:
        """Numbers of the notices and of the whole licences that a text of these terms can come to LEAST with: no span's cosine passes the norm that the template keeps in them."""
        kept = self.share[[self.number[t] for t in VOCABULARY.intersection(words)]].sum(axis=0) >= LEAST**2 - 1e-9
        n = len(self.templates)
        return np.flatnonzero(kept[:n]).tolist(), np.flatnonzero(kept[n:]).tolist()

    def best(self, text: str, use: list[int]) -> tuple[float, str]:
        """Highest cosine and its licence; ties go to the first by name."""
        v, norm = self.vector(text)
        if not norm:
            return 0.0, ""
        found = [(sum(x * v.get(t, 0.0) for t, x in w.items()) / (norm * m), name) for name, w, m in map(self.templates.__getitem__, use)]
        top = max(s for s, _ in found)
        return top, min(name for s, name in found if s == top)

    def whole(self, words: list[str], use: list[int]) -> tuple[float, str]:
        """Highest cosine of a whole text and a whole licence, and that licence."""
        counts = Counter(words)
        v = {t: n * self.idf.get(t, self.rare) for t, n in counts.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        found = [(sum(x * v.get(t, 0.0) for t, x in w.items()) / (norm * m), name) for name, w, m in map(self.full.__getitem__, use) if name not in OTHERS or counts[OTHERS[name]] * self.idf[OTHERS[name]] <= w.get(OTHERS[name], 0.0)]
        return max(found, default=(0.0, ""))

    def within(self, words: list[str], use: list[int]) -> list[tuple[float, int, str, int]]:
        """(cosine, words, licence, place) of the spans as long as a notice, at any place, that reach LEAST."""
        ids = np.array([self.number.get(t, len(self.number)) for t in words])
        total = np.concatenate([[0.0], np.cumsum(self.square[ids])])
        out = []
        for name, size, weight, m in map(self.spans.__getitem__, use):
            if len(ids) < size:
                continue
            dot = np.concatenate([[0.0], np.cumsum(weight[ids])])
            dot = dot[size:] - dot[:-size]
            # a span's norm is least if no word repeats
            for at in np.flatnonzero(dot >= (LEAST - 1e-9) * m * np.sqrt(total[size:] - total[:-size])).tolist():
                norm = sqrt(sum((n * self.idf.get(t, self.rare)) ** 2 for t, n in Counter(words[at : at + size]).items()))
                if dot[at] >= LEAST * norm * m:
                    out.append((round(float(dot[at]) / (norm * m), 9), size, name, at))
        return out

    def scan(self, text: str | None) -> tuple[str | None, float, int | None]:
        """(licence, cosine, line): the whole licence that the text is, else its best notice; (None, 0, None) if none reaches LEAST. A notice is a run of lines most of whose words notices have, any one line of it, or a span of words of the whole text; of equal cosines the longest counts."""
        every = terms(text or "")
        notices, whole = self.reachable(set(every))
        if not every or not (notices or whole):
            return None, 0.0, None
        score, name = self.whole(every, whole)
        if score >= LEAST:
            return name, score, 0
        if not notices:
            return None, 0.0, None
        lines = text.split("\n")
        by_line = [terms(x) for x in lines]
        top: tuple = (0.0, 0, "", 0)
        run: list[str] = []
        for i, (line, words) in enumerate(zip([*lines, ""], [*by_line, []], strict=True)):
            if words and sum(w in NOTICE for w in words) >= SHARE * len(words):
                run.append(line)
                continue
            if run:
                for x, at in [(" ".join(run), i - len(run))] + [(x, i - len(run) + k) for k, x in enumerate(run) if len(run) > 1]:
                    score, name = self.best(x, notices)
                    top = max(top, (round(score, 9), len(terms(x)), name, -at))
                run = []
        ends = np.cumsum([len(words) for words in by_line])
        for score, size, name, at in self.within(every, notices):
            top = max(top, (score, size, name, -int(np.searchsorted(ends, at, side="right"))))
        return (top[2], top[0], -top[3]) if top[0] >= LEAST else (None, 0.0, None)

    def alone(self, text: str, name: str) -> bool:
        """Whether a text as a whole, every word of it counted, is that licence or one of its notices."""
        every = terms(text)
        notices, whole = self.reachable(set(every))
        score, full = self.whole(every, whole)
        own = [k for k in notices if self.templates[k][0] == name]
        return score >= LEAST and full == name or bool(own) and self.best(text, own)[0] >= LEAST


def scan(files: DataFrame, keep: tuple[str, ...] = (), by_text: bool = False) -> DataFrame:
    """(*keep, path, own, cosine, line, licence, via): licences of files (*keep, path, text).

    own is the licence whose whole text the file is, else that which its text states anywhere, by the best cosine of 0.8 or more. A file that states one
    has it as its licence (via 'own'); any other inherits that of the licence file in the nearest directory above (via
    that file's path); else none. A directory with several licence files takes the one of highest cosine, then first path.
    Licence files are told by their names; with by_text, where names say nothing, also by their texts: those that as a
    whole are a licence or a notice (Matcher.alone). A notice at the end of a longer text is that text's alone.

    Defined cases: null or empty text states nothing; a null path inherits nothing; equal paths give equal rows apart
    from their texts; a text of any length is scanned whole; an empty table gives no rows; columns not in keep are
    ignored (keep the result's names out of it).
    """
    spark = files.sparkSession
    bounded_batches(spark)
    weights = spark.sparkContext.broadcast(frequencies(files))  # one count a template term

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(*weights.value)
        for b in batches:
            got = []
            for t in b.column(len(keep) + 1).to_pylist():
                name, cosine, line = own.scan(t)
                got.append((name, cosine, line, by_text and name is not None and own.alone(t, name)))
            cols = list(zip(*got, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, "path", "own", "cosine", "line", "_alone"])

    rows = files.select(*keep, F.col("path").cast("string").alias("path"), "text")
    shape = T.StructType([*rows.schema.fields[:-1], *fields("own string, cosine double, line int, _alone boolean").fields])
    found = materialize(rows.mapInArrow(task, shape), "licences")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    named = F.col("path").rlike(_FILE.pattern.replace("(?:^|/)", "(?i)(?:^|/)", 1))
    above = found.where(F.col("own").isNotNull() & (named | (F.col("_alone") & F.col("path").isNotNull())))
    above = above.groupBy(folder.alias("dir")).agg(F.min(F.struct(-F.col("cosine"), "path", "own")).alias("x")).select("dir", F.col("x.path").alias("from"), F.col("x.own").alias("held"))
    number = above.count()
    parts = F.split(folder, "/")
    depths = F.sequence(F.lit(0), F.size(parts) - 1)
    dirs = F.transform(depths, lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    bare = found.where(F.col("own").isNull() & F.col("path").isNotNull()).select("path").distinct().select("path", F.posexplode(dirs).alias("depth", "dir"))
    near = join_bounded(bare, above, ["dir"], number).groupBy("path").agg(F.max(F.struct("depth", "from", "held")).alias("x"))
    near = near.select(F.col("path").alias("_path"), F.col("x.from").alias("_from"), F.col("x.held").alias("_held"))
    out = found.join(near, F.col("own").isNull() & (F.col("path") == F.col("_path")), "left")
    return out.select(*keep, "path", "own", "cosine", "line", F.coalesce("own", "_held").alias("licence"), F.when(F.col("own").isNotNull(), "own").otherwise(F.col("_from")).alias("via"))


def op3_licences(spark, sf_dir):
    """Documents as files source/language/id. Their names tell no licence file, so texts do; what has no source has no path, as unknown sources aren't one folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    out = scan(docs.select("doc_id", path.alias("path"), "text"), ("doc_id",), by_text=True)
    return out.select("doc_id", "path", "licence", "cosine", "line", "via")
