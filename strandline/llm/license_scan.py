"""License scans by diagonal voting: rolling word k-grams meet template positions, and votes on one diagonal are one copy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, mix64, portions, word_hashes

K = 2
#: Neighbouring diagonals whose votes count together: an inserted or dropped word or two.
DRIFT = 2
#: Share of a template's k-grams that a span has to hold.
COVER = 0.8

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# License notices and passages, by label; up to 64 k-grams each.
PASSAGES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
# Whole license texts and notices, by label, as words.
TEXTS = (
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright "
        "holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
        "general public license along with this program",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
        "of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
        "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
        "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
)
#: Words of a part of a whole text, at least; each is a passage of its own, so a text that holds one part of a license is found.
PART_WORDS = 32


def parts_of(texts: tuple[tuple[str, str], ...], words: int = PART_WORDS) -> tuple[tuple[str, str], ...]:
    """Whole texts cut into passages of equal length, of `words` to less than twice as many words."""
    out = []
    for label, text in texts:
        all_words = text.split(" ")
        n = max(len(all_words) // words, 1)
        cuts = [i * len(all_words) // n for i in range(n + 1)]
        out += [(label, " ".join(all_words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return tuple(out)

_NO_WORD = np.zeros(256, dtype=bool)
_NO_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
# A-Z are lower-cased before words are cut, so they lie within words.
_NO_WORD[65:91] = True


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all k consecutive words."""
    n = len(words) - K + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(K):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)]
    return mix64(out, 3)


def template_grams(templates: list[tuple[str, str]]) -> list[tuple[int, str, int, int, str, int]]:
    """Rows (template, label, grams in it, position, the gram's words, hash) for each k-gram of each (text, label)."""
    rows = []
    for t, (text, label) in enumerate(templates):
        words = text.split(" ")
        hashes = grams(word_hashes([text], _NO_WORD)[0]).view(np.int64).tolist()
        rows += [(t, label, len(hashes), i, " ".join(words[i : i + K]), h) for i, h in enumerate(hashes)]
    return rows


def _document_grams(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_words", "place", "hash", "words"]
        task = TaskContext.get().partitionId() << 36
        done = 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                words, owner, starts, ends, raw = word_hashes(texts[a:b], _NO_WORD)
                n = np.bincount(owner, minlength=b - a)[: b - a]
                ids, row = batch.column(0).slice(a, b - a), task + done + np.arange(b - a)
                done += b - a
                yield pa.record_batch([pa.array(row), ids, pa.array(n), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.string())], names)
                rolled = grams(words)
                if not len(rolled):
                    continue
                at = np.minimum(np.searchsorted(wanted, rolled), len(wanted) - 1)
                hit = np.flatnonzero((wanted[at] == rolled) & (owner[: len(rolled)] == owner[K - 1 :]))
                place = hit - np.concatenate([[0], np.cumsum(n)[:-1]])[owner[hit]]
                said = [" ".join(raw[starts[i + j] : ends[i + j]].decode("utf-8", "replace") for j in range(K)) for i in hit.tolist()]
                said = ["".join(c.lower() if c.isascii() else c for c in s) for s in said]
                none = pa.nulls(len(hit), pa.int64())
                yield pa.record_batch([pa.array(row[owner[hit]]), none, none, pa.array(place), pa.array(rolled[hit].view(np.int64)), pa.array(said, pa.string())], names)

    return run


def scan_licenses(
    docs: DataFrame, base: dict[str, str] = BASE, passages: tuple[tuple[str, str], ...] = PASSAGES, texts: tuple[tuple[str, str], ...] = TEXTS, cover: float = COVER
) -> DataFrame:
    """License phrases, notices and parts of license texts in every document's whole text.

    Takes any frame with doc_id and text. Returns doc_id, n_words, n_base (places of the base phrases), first_word, last_word (their
    smallest and largest start), base_labels, labels (with those of passages), score (1 with a base phrase, else the best passage's
    share of its k-grams, to 1).

    Only k-grams with a template's hash leave the tasks. They join the template positions by hash, and by their words, so no chance
    collision votes. Votes are counted by document, template and diagonal (place in the document less place in the template); of a
    base phrase all k-grams must vote on one diagonal, of a passage neighbouring diagonals merge, and a merged span with `cover` of the
    template's k-grams is a find.

    Null texts have no words. Null ids and repeated rows are rows of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    passages = (*passages, *parts_of(texts))
    if any(t.count(" ") >= 64 + K - 1 for _, t in passages):
        raise ValueError("a passage has over 64 k-grams")
    templates = [(t, label) for t, label in base.items()] + [(t, label) for label, t in passages]
    rows = template_grams(templates)
    known = spark.createDataFrame(rows, "template int, label string, grams int, position int, words string, hash long")
    wanted = np.unique(np.array([r[-1] for r in rows], dtype=np.int64).view(np.uint64))
    met = bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_document_grams(wanted), "row long, doc_id long, n_words long, place long, hash long, words string")

    # The templates are constants of this module or of the call, a few hundred k-grams.
    votes = met.join(F.broadcast(known), ["hash", "words"], "left")
    # A diagonal's votes are the set of the template's positions it holds, one bit each, so merged diagonals count no position twice.
    diagonals = votes.groupBy("row", "template", "label", "grams", (F.col("place") - F.col("position")).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, position))").alias("held"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words")
    )
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT).cast("int"), F.lit(0))
    is_base = F.col("template") < len(base)
    runs = diagonals.withColumn("opens", F.when(is_base, 1).otherwise(starts)).withColumn("span", F.sum("opens").over(by))
    spans = runs.groupBy("row", "template", "label", "grams", "span").agg(
        F.expr("bit_count(bit_or(held))").alias("votes"), F.min("diagonal").alias("start"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words")
    )
    share = F.col("votes") / F.col("grams")
    exact = is_base & (F.col("votes") == F.col("grams"))
    passage = ~is_base & (share >= cover)
    joined = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    out = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).alias("first_word"),
        F.max(F.when(exact, F.col("start"))).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(exact | passage).alias("labels"),
        F.coalesce(F.max(F.when(exact, F.lit(1.0)).when(~is_base, share)), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
