"""License scans by diagonal voting.

Word 3-grams of documents that some license text holds are joined in Spark with their places in the templates; each pair votes for the
diagonal (place in the document less place in the template), neighbouring diagonals merge, and a span is verified by the share of
the template that it holds and by how densely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import grams, id_out, ship, staged, texts, word_hashes

GRAM = 3
#: Diagonals this near are one span; share of a template's grams, or number of them, that makes a label; grams a word of span.
NEAR = 2
SHARE = 0.6
VOTES = 12
DENSITY = 0.5

# The phrases that every scan reports, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License notices by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "GNU General Public License version 3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())


def template_places() -> list[tuple[int, str, int, int, int]]:
    """(gram hash, label, template, place, grams of the template)."""
    out, number = [], 0
    for label, some in TEMPLATES.items():
        for text in some:
            h = grams(word_hashes(words(text))[0], GRAM).view(np.int64).tolist()
            out += [(x, label, number, i, len(h)) for i, x in enumerate(h)]
            number += 1
    return out


_SCAN = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("places", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])
_SCAN_DDL = "doc_id long, row_key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, places array<long>, hashes array<long>"


def _scan(batches):
    phrases = [(label, word_hashes(p.encode())[0]) for p, label in PHRASES.items()]
    known = np.array(sorted({x for x, *_ in template_places()}), np.int64).view(np.uint64)
    known.sort()
    for batch in batches:
        out = []
        for d, row, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"]):
            h, _ = word_hashes(words(text.as_py()))
            starts, labels = [], set()
            for label, p in phrases:
                at = np.flatnonzero(h == p[-1]) - (len(p) - 1)
                at = at[at >= 0]
                for j in range(len(p) - 1):
                    at = at[h[at + j] == p[j]]
                if len(at):
                    starts += at.tolist()
                    labels.add(label)
            g = grams(h, GRAM)
            to = np.searchsorted(known, g)
            hit = np.flatnonzero(known[np.minimum(to, len(known) - 1)] == g)
            out.append((d, row, len(h), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), hit.tolist(), g[hit].view(np.int64).tolist()))
        cols = list(zip(*out)) or [[]] * len(_SCAN)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCAN.types)], schema=_SCAN)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label and first and last word of each found).

    Base places are those where a phrase's words stand one after the other. score is the largest share of a template found; a base
    place counts as 0.5 at least. Null and empty texts have no words; repeated rows each come back. Texts are taken whole, however long; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scanned = staged(texts(docs).withColumn("row_key", F.xxhash64("text")).mapInArrow(_scan, _SCAN_DDL), "scan")
    places = F.broadcast(spark.createDataFrame(template_places(), "hash long, label string, template int, place long, n long"))  # as many rows as the templates above have grams
    key = ["doc_id", "row_key"]
    hits = scanned.where(F.size("places") > 0).dropDuplicates(key).select(*key, F.explode(F.arrays_zip("places", "hashes")).alias("h")).select(*key, F.col("h.places").alias("at"), F.col("h.hashes").alias("hash"))
    votes = hits.join(places, "hash").groupBy(*key, "label", "template", "n", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("a"), F.max("at").alias("z"))
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    votes = votes.withColumn("group", F.sum((F.col("diagonal") - F.lag("diagonal", 1, None).over(line) > NEAR).cast("int")).over(line))
    spans = votes.groupBy(*key, "label", "template", "n", F.coalesce("group", F.lit(0)).alias("group")).agg(F.sum("votes").alias("votes"), F.min("a").alias("a"), (F.max("z") + GRAM - 1).alias("z"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("n"))
    spans = spans.where(((share >= SHARE) | (F.col("votes") >= VOTES)) & (F.col("votes") >= DENSITY * (F.col("z") - F.col("a") - GRAM + 2)))
    found = spans.groupBy(*key).agg(F.collect_set("label").alias("more"), F.max(share).alias("share"), F.array_sort(F.collect_list(F.struct("a", "z", "label"))).alias("spans"))
    out = scanned.drop("places", "hashes").join(found, key, "left")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return out.select(
        id_out("doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"),
        joined(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "spans",
    )
