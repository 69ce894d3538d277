"""License scans: sparse TF-IDF cosine of licence lines to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import map_texts, staged

# Usual licence notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the 3-Clause BSD License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "BSD-2-Clause": ("Licensed under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ),
    "EPL-2.0": ("This program is made available under the terms of the Eclipse Public License 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. Licensed under the zlib License.",),
}
#: Lines that a notice may run over.
LINES = 3
_TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_NOTICE = re.compile(r"licen[sc]|permission|redistribut|spdx|released (?:under|into)|(?:subject to|under) the terms", re.I)
#: File names that hold a directory's licence.
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


class Matcher:
    """Best template of a line, by cosine of TF-IDF vectors. IDF is that of the templates, so it doesn't drift with the
    corpus; a term that no template has weighs as one that a single template has."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        notices = [(name, Counter(_TERM.findall(t.lower()))) for name, ts in templates.items() for t in ts]
        df = Counter(term for _, terms in notices for term in terms)
        self.rarest = math.log(1 + len(notices))
        self.idf = {term: math.log(1 + len(notices) / n) for term, n in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in notices]
        for i, (_, terms) in enumerate(notices):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in terms.items()))
            for t, n in terms.items():
                self.postings.setdefault(t, []).append((i, n * self.idf[t] / norm))

    def line(self, line: str) -> tuple[str | None, float]:
        terms = Counter(_TERM.findall(line.lower()))
        scores: dict[int, float] = {}
        norm = 0.0
        for t, n in terms.items():
            w = n * self.idf.get(t, self.rarest)
            norm += w * w
            for i, v in self.postings.get(t, ()):
                scores[i] = scores.get(i, 0.0) + w * v
        if not scores:
            return None, 0.0
        best = min(scores, key=lambda i: (-scores[i], i))
        return self.names[best], scores[best] / math.sqrt(norm)

    def text(self, text: str | None, least: float) -> tuple[str | None, float]:
        """The best match of any notice: a line that reads like one, alone or with the one or two lines after it. None
        under the least cosine; of equal matches the first. Each line is scored at most three times."""
        best: tuple[str | None, float] = (None, 0.0)
        text = text or ""
        at = 0
        while m := _NOTICE.search(text, at):
            start, ends = text.rfind("\n", 0, m.start()) + 1, [m.end() - 1]
            while len(ends) <= LINES and ends[-1] < len(text):
                end = text.find("\n", ends[-1] + 1)
                ends.append(len(text) if end < 0 else end)
            for end in ends[1:]:
                name, score = self.line(text[start:end])
                if score >= least and score > best[1]:
                    best = (name, score)
            at = ends[1]
        return best


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory_col: Column) -> Column:
    """A directory and those above it, down from the root ''."""
    parts = F.split(directory_col, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(
    files: DataFrame,
    *,
    id_col: str = "path",
    path_col: str = "path",
    text_col: str = "text",
    licence_file: Column | None = None,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    least_cosine: float = 0.8,
) -> DataFrame:
    """id_col, path, license (null: none), score, origin: 'own' notice, 'inherited', or 'none'; licence_dir, where an
    inherited one lies. One row for each row of files.

    A file with a notice of its own keeps it. Others take the licence of the nearest ancestor directory, its own one
    first, that has a licence file with a recognised notice (licence_file: which files count; by default by name). Of
    several in one directory the best score wins, then the first name. Null and empty texts have no notice; a null path
    has no directory and inherits nothing. Long texts are read whole, each notice line once. Repeated rows are answered
    alike, no rows give none. Other columns are ignored.

    The corpus is read once; only ids, paths and findings are staged. Directories, not files, are joined to their
    ancestors' licences, so a directory with a third of all files is one row there.
    """
    matcher = Matcher(templates)
    is_file = licence_file if licence_file is not None else F.col(path_col).rlike(LICENCE_FILE)
    keyed = files.select(
        F.struct(
            F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(is_file, F.lit(False)).alias("is_file")
        ).alias("key"),
        F.col(text_col).alias("text"),
    )

    def match(texts: list[str | None]) -> dict[str, list]:
        found = [matcher.text(t, least_cosine) for t in texts]
        return {"license": [n for n, _ in found], "score": [s for _, s in found]}

    found = staged(
        map_texts(keyed, "key", "text", "license string, score double", match).select(
            "key.*", "license", "score", directory(F.col("key.path")).alias("dir")
        )
    )
    by_dir = staged(
        found.where("is_file and license is not null and dir is not null")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
        .select("dir", F.col("best.license").alias("license"), (-F.col("best.score")).alias("score"))
    )
    dirs = found.where("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "up"))
    source = by_dir.select(F.col("dir").alias("up"), F.col("license").alias("l"), F.col("score").alias("s"))
    nearest = staged(
        above.join(source, "up")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "up", "l", "s")).alias("n"))
        .select("dir", F.col("n.up").alias("licence_dir"), F.col("n.l").alias("inherited"), F.col("n.s").alias("from_score"))
    )
    own = F.col("license").isNotNull()
    return found.join(nearest, "dir", "left").select(
        F.col("id").alias(id_col),
        *([] if id_col == "path" else ["path"]),
        F.coalesce("license", "inherited").alias("license"),
        F.when(own, F.col("score")).otherwise(F.coalesce("from_score", F.lit(0.0))).alias("score"),
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("licence_dir")).alias("licence_dir"),
    )
