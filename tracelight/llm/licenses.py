"""License scan by diagonal voting, with DataFrame functions only.

Every text's words are hashed; the rolling hashes of all its word k-grams (k = 2 for short phrases, 4 for longer templates)
are exploded and joined to the positions of the templates that hold the same k-gram. A hit votes for the diagonal (place
in the text minus place in the template). Votes are aggregated by text, template and diagonal before anything is shuffled
on; neighbouring diagonals (an inserted or lost word) are merged; a span is verified by the share of the template's k-grams
that its diagonals hold - for the base phrases all of them, on one diagonal, which is equality of the words.

The templates are fixed in this module or given by the caller: up to MOST_POSITIONS of their positions are broadcast, more
are joined by a shuffle. The texts are read once and never shuffled: only hits and one short row a text are.

Defined results. Null text: as empty, no words, no labels, score 0. Repeated rows each get their row. Null doc_id: treated
like any value. Very long texts are whole rows of word hashes. Ties: a label found in several ways stands once. Empty
table: empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words of widely used licenses and notices, and our label for each.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SHORT, LONG, SHARE, NEAR, MOST_POSITIONS = 2, 4, 0.6, 3, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrase_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def positions(spark, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """gram (hash, k), template number, its label and size, place of the gram, whether a base phrase."""
    rows = []
    for number, (text, label, is_base) in enumerate([*((t, x, True) for t, x in base.items()), *((t, x, False) for t, x in templates.items())]):
        w = phrase_words(text)
        k = SHORT if is_base else LONG
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(number, label, is_base, len(w) - k + 1, i, w[i : i + k]) for i in range(len(w) - k + 1)]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, place int, w array<string>")
    h = [F.xxhash64(F.get("w", F.lit(i))) for i in range(LONG)]
    return t.select("template", "label", "base", "grams", "place", F.when(F.col("base"), F.xxhash64(F.lit(SHORT), *h[:SHORT])).otherwise(F.xxhash64(F.lit(LONG), *h)).alias("gram"))


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, share: float = SHARE, near: int = NEAR) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, n_words)."""
    spark = docs.sparkSession
    table = positions(spark, BASE if base is None else base, TEMPLATES if templates is None else templates)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.transform(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)).alias("w"))

    # All rolling k-grams: k shifted copies of the word hashes, zipped; an extra first entry carries the text's own row.
    n = F.size("w")
    shifted = [F.slice("w", i + 1, n) for i in range(LONG)]
    zipped = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    rows = rows.select("doc_id", "h1", "h2", n.alias("n_words"), F.posexplode_outer(F.concat(F.array(F.struct(*[F.lit(None).cast("long").alias(f"w{i}") for i in range(LONG)])), zipped)).alias("at", "g"))
    rows = rows.select("doc_id", "h1", "h2", "n_words", (F.col("at") - 1).alias("at"), *[F.col("g")[f"w{i}"].alias(f"w{i}") for i in range(LONG)])
    # Both k's of a place are looked up: the shorter against base phrases, the longer against templates.
    two = F.when(F.col("w1").isNotNull(), F.xxhash64(F.lit(SHORT), "w0", "w1"))
    four = F.when(F.col("w3").isNotNull(), F.xxhash64(F.lit(LONG), "w0", "w1", "w2", "w3"))
    found = rows.select("doc_id", "h1", "h2", "n_words", "at", two.alias("two"), four.alias("four"))
    hits = table.groupBy("gram").agg(F.collect_list(F.struct("template", "label", "base", "grams", "place")).alias("hits"))
    few = table.limit(MOST_POSITIONS + 1).count() <= MOST_POSITIONS
    short, long = (hits.select(F.col("gram").alias(k), F.col("hits").alias(f"hits_{k}")) for k in ("two", "four"))
    if few:
        short, long = F.broadcast(short), F.broadcast(long)
    found = found.join(short, "two", "left").join(long, "four", "left").where("at < 0 or hits_two is not null or hits_four is not null")
    none = F.array().cast("array<struct<template:int,label:string,base:boolean,grams:int,place:int>>")
    found = found.select("doc_id", "h1", "h2", "n_words", "at", F.explode_outer(F.concat(F.coalesce("hits_two", none), F.coalesce("hits_four", none))).alias("hit"))

    # Votes by diagonal. Rows alike in id and text share a key; their number is the count of first entries.
    key = ["doc_id", "h1", "h2", "n_words"]
    votes = found.groupBy(*key, F.col("hit.template").alias("template"), F.col("hit.label").alias("label"), F.col("hit.base").alias("base"), F.col("hit.grams").alias("grams"), (F.col("at") - F.col("hit.place")).alias("diagonal")).agg(
        F.sum(F.when(F.col("at") < 0, 1)).alias("copies"), F.countDistinct("hit.place").alias("places")
    )
    # A base phrase stands where its one diagonal has all places.
    votes = votes.where("template is null or not base or places = grams")
    per = votes.groupBy(*key).agg(
        F.max("copies").alias("copies"),
        F.sort_array(F.collect_list(F.when(F.col("base"), F.struct("diagonal", "label")))).alias("base_hits"),
        F.sort_array(F.collect_list(F.when(~F.col("base"), F.struct("template", "diagonal", "places", "grams", "label")))).alias("long_hits"),
    )
    # Neighbouring diagonals of one template: a run of gaps up to `near` is one span; its votes add up.
    kind = "array<struct<template:int,start:int,last:int,votes:bigint,grams:int,label:string>>"

    def merge(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (last["template"] == x["template"]) & (x["diagonal"] - last["last"] <= near)
        grown = F.struct(last["template"].alias("template"), last["start"].alias("start"), x["diagonal"].alias("last"), (last["votes"] + x["places"]).alias("votes"), last["grams"].alias("grams"), last["label"].alias("label"))
        fresh = F.struct(x["template"].alias("template"), x["diagonal"].alias("start"), x["diagonal"].alias("last"), x["places"].alias("votes"), x["grams"].alias("grams"), x["label"].alias("label"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    spans = F.aggregate("long_hits", F.array().cast(kind), merge)
    spans = F.filter(spans, lambda s: s["votes"] >= F.lit(share) * s["grams"])
    per = per.select(*key, "copies", "base_hits", spans.alias("spans"))
    starts = F.transform("base_hits", lambda x: x["diagonal"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base_hits", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("spans", lambda s: s["label"]))))
    covered = F.aggregate("spans", F.lit(0.0), lambda acc, s: F.greatest(acc, F.least(s["votes"] / s["grams"], F.lit(1.0))))
    out = per.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base_hits").cast("long").alias("n_base"),
        F.when(F.size(starts) > 0, F.array_min(starts)).alias("first_word"),
        F.when(F.size(starts) > 0, F.array_max(starts)).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base_hits") > 0, F.lit(1.0)).otherwise(covered).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), F.greatest(s["start"], F.lit(0)).cast("long").alias("start"), (s["grams"] + LONG - 1).cast("long").alias("n_words"))).alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
