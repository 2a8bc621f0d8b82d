"""Licences: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Every line of every text that holds a telling word of a template is compared, alone and together with the lines around it
that hold one too, so headers count wherever they stand. A file without a licence of its own takes that of the licence file
in its nearest ancestor directory, found by joins of directories with the ancestors of the directories in use.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import map_texts, only, pieces, words

# fixed values: what the licences' usual notices say
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: A line is compared only if it has one of these.
TELLING = frozenset("license licence licensed licenced spdx-license-identifier mit apache gpl lgpl bsd mozilla commons cc cc0 "
                    "permission redistribution redistribute rights proprietary copyright".split())
SIMILAR = 0.6  # least cosine
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
FILE_SHARE = 0.5  # of its words that a licence file without such a name has in licence lines


def terms(line: str) -> list[str]:
    return [t for t in (w.strip(b".,;:!?\"'()*%#$&|/<>[]{}=+~`").decode("utf-8", "replace") for w in words(line)) if t]


VOCABULARY = frozenset(t for texts in TEMPLATES.values() for text in texts for t in terms(text)) | TELLING


def document_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """How many documents there are, and in how many each word of the templates occurs."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for piece in pieces(batches):
            for text in piece["text"]:
                found.update(VOCABULARY.intersection(terms(text)))
            found[""] += len(piece)
        yield pd.DataFrame(found.items(), columns=["term", "n"])
    rows = only(docs, "text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}  # as many as the templates have words
    return counts.pop("", 0), counts


class Matcher:
    """Weighted templates. A word that no template has weighs as one that no document has."""

    def __init__(self, total: int, counts: dict[str, int]) -> None:
        self.weight = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY}
        self.other = math.log(1 + total) + 1
        self.templates = [(name, self.vector(terms(text))) for name, texts in TEMPLATES.items() for text in texts]

    def vector(self, found: list[str]) -> dict[str, float]:
        v = {t: n * self.weight.get(t, self.other) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def best(self, found: list[str]) -> tuple[float, str]:
        v = self.vector(found)
        return max(((sum(x * v[t] for t, x in other.items() if t in v), name) for name, other in self.templates), key=lambda p: (p[0], p[1]))

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """Best licence of a text, its cosine, and the share of the text's words in licence lines."""
        best, total, inside, block = (0.0, ""), 0, 0, []
        for line in [*text.split("\n"), ""]:
            found = terms(line)
            total += len(found)
            if not TELLING.isdisjoint(found):
                block.append(found)
                continue
            if block:
                tried = [self.best(b) for b in block]
                if len(block) > 1:
                    tried.append(self.best([t for b in block for t in b]))
                    if tried[-1][0] >= SIMILAR:
                        inside += sum(map(len, block))
                        best = max(best, *tried)
                        block = []
                        continue
                inside += sum(len(b) for b, t in zip(block, tried) if t[0] >= SIMILAR)
                best = max(best, *tried)
                block = []
        return (best[1], best[0], inside / total) if best[0] >= SIMILAR else (None, best[0], 0.0)


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, path, text. Returns doc_id, path, licence (null: none), cosine, share for every whole text."""
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(*document_counts(docs)))  # as large as the templates

    def work(texts: list[str]) -> tuple[list, None]:
        return list(zip(*(matcher.value.scan(t) for t in texts))), None

    return map_texts(docs, ["doc_id", "path"], "text", [("licence", "string", pa.string()), ("cosine", "double", pa.float64()),
                                                        ("share", "double", pa.float64())], work)


def licensed(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_licence, cosine, licence_file, licence and licence_dir (null: its own or none) for every row.

    A licence file has the name of one, or most of its words in licence lines. Of several in a directory the best match
    counts, then the first path. Null texts are empty; rows without a path inherit nothing; the root directory is ''.
    """
    found = scan(docs).withColumn("parts", F.split("path", "/"))
    found = found.withColumn("dir", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/")).withColumn(
        "licence_file", F.coalesce(F.col("licence").isNotNull() & (F.element_at("parts", -1).rlike(FILE_NAME) | (F.col("share") >= FILE_SHARE)), F.lit(False)))
    best = F.max_by(F.struct("licence"), F.struct("cosine", F.col("share"), F.col("licence"))).alias("l")
    given = found.where("licence_file and path is not null").groupBy("dir").agg(best).select(F.col("dir").alias("from"), F.col("l.licence").alias("from_licence"))
    # every directory in use with its ancestors, nearest first by depth
    steps = F.expr("transform(sequence(0, size(d)), i -> struct(i as depth, array_join(slice(d, 1, i), '/') as up))")
    used = found.where("path is not null").select("dir").distinct().withColumn("d", F.expr("filter(split(dir, '/'), x -> x <> '')"))
    ancestors = used.select("dir", F.explode(steps).alias("s")).select("dir", "s.depth", "s.up")
    nearest = ancestors.join(given, F.col("up") == F.col("from")).groupBy("dir").agg(
        F.max_by(F.struct("from", "from_licence"), "depth").alias("n")).select("dir", "n.*")
    out = found.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select("doc_id", "path", F.col("licence").alias("own_licence"), "cosine", "licence_file",
                      F.coalesce("licence", "from_licence").alias("licence"), F.when(~own, F.col("from")).alias("licence_dir"))
