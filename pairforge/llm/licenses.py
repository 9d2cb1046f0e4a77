"""License scan by diagonal voting.

Every rolling GRAM-word hash of a document that some template holds is joined with the template's positions; a hit at
document word p and template word q votes for the diagonal p - q. Votes are summed by diagonal, neighbouring diagonals
(at most SLACK apart, for words put in or left out) are merged, and a merged span is verified by the weight of its votes and
the share of its template words that hits cover. Templates are a fixed, small table, so their positions may be broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .base import chunks, cut, id_text, tuned

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notice texts by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
GRAM, SLACK = 4, 3
#: A span counts with so many votes, and so large a share of the template words between its first and last hit. A gram that
#: several templates hold is divided among them, as it tells little about which of them stands there.
VOTES, SHARE = 5, 0.6


def template_positions() -> list[tuple[str, int, int, float]]:
    """(label, position, hash, weight) of every rolling gram of the templates; weight: one over the number of templates that hold it."""
    out = []
    for label, text in TEMPLATES.items():
        g = tk.grams(tk.words([text], "alnum").hash, GRAM)
        out += [(label, k, int(h)) for k, h in enumerate(g.view(np.int64))]
    held = Counter(h for _, h in {(label, h) for label, _, h in out})
    return [(label, k, h, 1 / held[h]) for label, k, h in out]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs with a doc_id.

    Words: A-Z lower-cased, runs of a-z, 0-9 and non-ASCII. n_base counts all places where a phrase stands; first_word and
    last_word are the smallest and largest, else null. labels adds those of verified template spans. score: the largest
    share of a verified span's template, 1 with a base phrase, else 0. Null text has no words; repeated rows are scanned
    each; other columns are ignored.
    """
    spark = docs.sparkSession
    tuned(spark)
    docs = id_text(docs).withColumn("tag", F.xxhash64("text"))
    positions = template_positions()
    known = np.unique(np.array([h for _, _, h, _ in positions], np.int64).view(np.uint64))
    phrases = [(tk.grams(tk.words([p], "alnum").hash, len(p.split()))[0], len(p.split()), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            w = tk.words(t["text"].to_pylist(), "alnum")
            n = len(w.first) - 1
            found = []
            for h, k, label in phrases:
                at = np.flatnonzero((tk.grams(w.hash, k) == h) & tk.within(w, k))
                found += [(int(d), int(p), label) for d, p in zip(np.searchsorted(w.first, at, "right") - 1, at, strict=True)]
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for d, p, label in found:
                base[d].append((p - int(w.first[d]), label))
            g = tk.grams(w.hash, GRAM)
            at = np.flatnonzero(np.isin(g, known) & tk.within(w, GRAM)) if len(g) else np.empty(0, int)
            doc = np.searchsorted(w.first, at, "right") - 1
            hits: list[list[dict]] = [[] for _ in range(n)]
            for d, p, h in zip(doc.tolist(), at.tolist(), g[at].view(np.int64).tolist(), strict=True):
                hits[d].append({"p": p - int(w.first[d]), "h": h})
            yield pa.RecordBatch.from_arrays(
                [
                    t["doc_id"].combine_chunks(), t["tag"].combine_chunks(), pa.array(np.diff(w.first), pa.int64()), pa.array(map(len, base), pa.int64()),
                    pa.array([min(b)[0] if b else None for b in base], pa.int64()), pa.array([max(b)[0] if b else None for b in base], pa.int64()),
                    pa.array([sorted({x[1] for x in b}) for b in base], pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("p", pa.int64()), ("h", pa.int64())]))),
                ],
                ["doc_id", "tag", "n_words", "n_base", "first_word", "last_word", "base", "hits"],
            )

    facts = cut(docs.mapInArrow(run, "doc_id long, tag long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<p:bigint,h:bigint>>"))
    table = spark.createDataFrame(positions, "label string, q long, h long, weight double")
    hits = facts.where("size(hits) > 0").dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", F.explode("hits").alias("hit")).select("doc_id", "tag", "hit.p", "hit.h")
    votes = hits.join(F.broadcast(table), "h").withColumn("diagonal", F.col("p") - F.col("q"))
    key = ["doc_id", "tag", "label"]
    by_diagonal = votes.groupBy(*key, "diagonal").agg(F.collect_set(F.struct("q", "weight")).alias("hits"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal", 1, -(10**15)).over(along) > SLACK).cast("int")
    spans = by_diagonal.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(along)).groupBy(*key, "span").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    spans = spans.select(*key, F.col("hits.q").alias("qs"), F.aggregate("hits.weight", F.lit(0.0), lambda a, x: a + x).alias("votes"))
    # Each gram covers GRAM template words.
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + GRAM - 1)))))
    length = F.array_max("qs") - F.array_min("qs") + GRAM
    sizes = F.create_map(*(F.lit(x) for label, text in TEMPLATES.items() for x in (label, len(text.split()))))
    spans = spans.withColumn("covered", covered).where((F.col("votes") >= VOTES - 1e-9) & (F.col("covered") >= SHARE * length))
    labels = spans.groupBy("doc_id", "tag").agg(F.collect_set("label").alias("own"), F.max(F.least(F.lit(1.0), F.col("covered") / sizes[F.col("label")])).alias("share"))
    out = facts.drop("hits").join(labels, ["doc_id", "tag"], "left")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
