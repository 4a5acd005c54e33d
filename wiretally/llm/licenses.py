"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a text are hashed and joined with the positions at which license templates
have the same k-gram. Matches of one offset (document place minus template place) are on one diagonal and vote
for the template; neighbouring diagonals are merged, so a few words may be missing or added. Each gram is verified
word by word in the join, and each merged span as a whole: enough distinct places of its template must stand in it, and
so must the words that tell the license from its relatives, in no more than twice its words. Where spans of notices
overlap, the best one counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretally.llm import license_texts
from wiretally.llm.common import text_or_empty

#: Words of a gram; the shortest phrase has three.
K = 3
#: Diagonals up to this far apart belong to one span.
DRIFT = 3
#: Part of a template's grams that a span must hold, and how many times the template's words a span may have.
COVERAGE, STRETCH = 0.6, 2

# The phrases to be found word for word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that licenses ask to be reproduced, lower case, words only.
NOTICES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

# Words by which a notice differs from those of related licenses; a span must hold them all in their place.
# They have K words at most in all spellings, so that one gram shows them. Notices that aren't listed read alike in their relatives.
DECIDING = {
    "released under the mit license": ("the mit license",),
    "licensed under the apache license version 2 0": ("apache license", "version 2"),
    "licensed under cc by nc 4 0": ("by nc 4",),
    "licensed under a creative commons attribution noncommercial 4 0 international license": ("attribution noncommercial", "noncommercial 4"),
    "licensed under a creative commons attribution 4 0 international license": ("attribution 4",),
    "this work is licensed under the gnu general public license version 3": ("gnu general public", "version 3"),
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by"
    " the free software foundation": ("gnu general public",),
    "this source code form is subject to the terms of the mozilla public license v 2 0": ("mozilla public license", "v 2"),
}
# Whole texts stand beside the notices; a text that holds both goes by the longer one.
for _label, _texts in license_texts.TEXTS.items():
    for _text in _texts:
        _words = " ".join(re.findall(r"[a-z0-9]+", _text.lower()))
        NOTICES.setdefault(_label, []).append(_words)
        if _label in license_texts.DECIDING:
            DECIDING[_words] = license_texts.DECIDING[_label]
# Spellings of one thing; a notice may be written with any of a line.
SPELLINGS = [[r"\b(?:version|v) (\d+)\b", r"version \1", r"v \1", r"v\1"], [r"\bnoncommercial\b", "noncommercial", "non commercial"]]
#: Places of a template that one mask tells apart.
MASK_BITS = 62

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower case for A-Z, then the words. lower() turns one other character, the kelvin sign, into an
    ASCII letter; a neighbour stands in for it, which is no ASCII letter either."""
    low = F.lower(F.replace(text, F.lit("K"), F.lit("℩")))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def spelled(words_: str) -> list[str]:
    """The words in all their spellings, as they are first."""
    out = [words_]
    for pattern, *ways in SPELLINGS:
        out += [x for w in ways for x in [re.sub(pattern, w, words_)] if x not in out]
    return out


def template_grams(phrase: str, deciding: tuple[str, ...] = (), spellings: bool = False) -> dict[tuple[str, int], int]:
    """(gram, place) of a template in all its spellings, and a bit for each of the deciding words that the gram holds.

    The grams of another spelling stand at the places of those that they replace.
    """
    ws, out = phrase.split(), {}
    last = len(ws) - K
    for way in spelled(phrase) if spellings else [phrase]:
        other = way.split()
        same = next((i for i, (a, b) in enumerate(zip(ws, other, strict=False)) if a != b), len(ws))
        longer = len(other) - len(ws)
        for i in range(len(other) - K + 1):
            gram = " ".join(other[i : i + K])
            at = i if i <= same else max(same, i - longer)
            bits = sum(1 << d for d, x in enumerate(deciding) if any(f" {y} " in f" {gram} " for y in spelled(x)))
            out[gram, min(at, last)] = out.get((gram, min(at, last)), 0) | bits
    return out


def templates(
    spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES, deciding: dict[str, tuple[str, ...]] = DECIDING
) -> DataFrame:
    """One row for each gram place of each template: gram, template number, place, label, grams, base, bits of the deciding
    words that the gram holds, and those that a span needs."""
    rows, listed = [], [(p, x, True) for p, x in phrases.items()]
    listed += [(n, x, False) for x, ns in notices.items() for n in ns]
    for number, (phrase, label, base) in enumerate(listed):
        n, needs = len(phrase.split()) - K + 1, () if base else deciding.get(phrase, ())
        for (gram, i), bits in template_grams(phrase, needs, not base).items():
            rows.append(f"('{gram}', {number}, {i}L, '{label}', {n}L, {str(base).lower()}, {bits}, {(1 << len(needs)) - 1})")
    found = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(t_gram, template, t_at, label, t_grams, base, t_bits, t_needs)")
    return found.withColumn("t_hash", F.xxhash64("t_gram"))


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, list[str]] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
    deciding: dict[str, tuple[str, ...]] = DECIDING,
) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places where a phrase stands word for word; first_word and last_word are the smallest and
    largest such start, counted in words from 0 (null: none). labels adds those of notices found by voting and verified.
    spans is an array of (label, first, end, coverage) in words, end exclusive. coverage is the part of the template's
    places that stand in the span. score is the best coverage of any span, also one that lacks deciding words, 1 for a phrase. A null or empty text has no words, empty labels and score 0. Null ids are allowed; rows that
    repeat id and text are scanned together and returned as often as they came. Further columns are ignored. An
    empty table gives an empty table. Only matches and one row for each document are shuffled.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_th"), words(text).alias("_w"))
    grams = F.transform("_w", lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1), F.get("_w", i + 2)))
    # The first element carries the number of words, so that a document without a match has a row too.
    rows = rows.select(
        "doc_id", "_th", F.posexplode(F.concat(F.array(F.size("_w").cast("string")), grams)).alias("_at", "_gram")
    )
    rows = rows.withColumn("_hash", F.xxhash64("_gram"))
    t = F.broadcast(templates(docs.sparkSession, phrases, notices, deciding))
    hit = (F.col("_hash") == F.col("t_hash")) & (F.col("_gram") == F.col("t_gram")) & (F.col("_at") > 0)
    rows = rows.join(t, hit, "left").where((F.col("_at") == 0) | F.col("template").isNotNull())
    at = F.col("_at").cast("long") - 1
    # Distinct places of a span, as bits of as many numbers as the longest template needs.
    longest = max((len(x.split()) - K + 1 for x in [*phrases, *(n for ns in notices.values() for n in ns)]), default=1)
    masks = [f"m{i}" for i in range(-(-longest // MASK_BITS))]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("t_at") % MASK_BITS).cast("int"))
    kind = ["doc_id", "_th", "template", "label", "t_grams", "base", "t_needs"]
    diagonals = rows.groupBy(*kind, (at - F.col("t_at")).alias("_diag")).agg(
        F.size(F.collect_set(at)).cast("long").alias("votes"),  # at most one for each template gram
        F.min(at).alias("lo"),
        F.max(at).alias("hi"),
        F.max(F.when(F.col("_at") == 0, F.col("_gram").cast("long"))).alias("n_words"),
        F.count(F.when(F.col("_at") == 0, 1)).alias("copies"),
        F.bit_or("t_bits").alias("bits"),
        *(F.bit_or(F.when(F.floor(F.col("t_at") / MASK_BITS) == i, bit)).alias(m) for i, m in enumerate(masks)),
    )
    w = Window.partitionBy("doc_id", "_th", "template").orderBy("_diag")
    whole = F.col("base") & (F.col("votes") == F.col("t_grams"))
    parts = diagonals.withColumn("_new", (F.col("_diag") - F.lag("_diag").over(w) > DRIFT).cast("int"))
    # On one diagonal only for phrases, which stand word for word or not at all.
    parts = parts.withColumn("_span", F.when(F.col("base"), F.col("_diag")).otherwise(F.sum(F.coalesce("_new", F.lit(0))).over(w)))
    spans = parts.groupBy(*kind, "_span").agg(
        sum((F.coalesce(F.bit_count(F.bit_or(m)), F.lit(0)) for m in masks), F.lit(0)).alias("places_hit"),
        F.bit_or("bits").alias("bits"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count(F.when(whole, 1)).alias("places"),
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
    )
    # Verified: distinct places, deciding words, and no wider than a notice with words put in.
    coverage = F.when(F.col("template").isNotNull(), F.col("places_hit") / F.col("t_grams"))
    fits = F.col("hi") - F.col("lo") + K <= STRETCH * (F.col("t_grams") + K - 1)
    good = ~F.col("base") & (coverage >= COVERAGE) & (F.col("bits") == F.col("t_needs")) & fits
    spans = spans.select("*", coverage.alias("coverage"), F.coalesce(good, F.lit(False)).alias("good"), (F.col("hi") + K).alias("end"))
    # Runs of overlapping spans of notices; in each the best spans that don't overlap count.
    w = Window.partitionBy("doc_id", "_th").orderBy("lo", "template")
    before = F.max(F.when(F.col("good"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_apart", (F.col("good") & (F.col("lo") >= before)).cast("int"))
    spans = spans.withColumn("_run", F.sum(F.coalesce("_apart", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct(F.col("lo").alias("first"), "end", "label", "coverage")
    ranked = F.struct((-F.col("coverage")).alias("c"), (-F.col("places_hit")).alias("p"), F.col("lo").alias("l"), F.col("template").alias("t"), span.alias("span"))
    phrase = F.col("places") > 0
    runs = spans.groupBy("doc_id", "_th", "_run").agg(
        F.max("n_words").alias("n_words"),
        F.sum("places").alias("places"),
        F.min(F.when(phrase, F.col("lo"))).alias("first_word"),
        F.max(F.when(phrase, F.col("lo"))).alias("last_word"),
        F.collect_set(F.when(phrase, F.col("label"))).alias("base_labels"),
        F.max(F.when(phrase | ~F.col("base"), F.col("coverage"))).alias("score"),
        F.collect_list(F.when(phrase, span)).alias("stand"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("good"), ranked))), lambda x: x["span"]).alias("voted"),
        F.max("copies").alias("copies"),
    )
    overlap = lambda x: lambda y: (y["first"] < x["end"]) & (x["first"] < y["end"])
    # Sorted from the best: a span counts unless a better one that counts overlaps it.
    best = F.aggregate("voted", F.slice("voted", 1, 0), lambda kept, x: F.when(F.exists(kept, overlap(x)), kept).otherwise(F.concat(kept, F.array(x))))
    runs = runs.withColumn("_spans", F.concat("stand", best))
    out = runs.groupBy("doc_id", "_th").agg(
        F.max("n_words").alias("n_words"),
        F.sum("places").alias("n_base"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("base_labels")))), ",").alias("base_labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.array_sort(F.flatten(F.collect_list("_spans"))).alias("spans"),
        F.max("copies").alias("_copies"),
    )
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["label"]))), ",")
    out = out.select(
        "doc_id", "_th", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), "score", "spans", "_copies"
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copy", "_copies", "_th")
