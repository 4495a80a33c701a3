"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined, by hash, to the positions it
has in the templates.  Hits on one diagonal (text position less template
position) vote for one placement of the template; neighbouring diagonals are one
placement with words put in or left out.  The templates are a fixed list and are
broadcast; only hits are shuffled.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.settle import settle
from corpuskit.llm.rows import whole_text

# What a word is, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"),
)
# Opening words of public license notices, and short references to licenses.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except "
                      "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the "
                   "gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
# Templates of up to so many words are looked up by two words at a time, longer ones by three.
SHORT = 6
# Placements whose diagonals are so near to one another are one.
NEAR = 2
# Share of a notice's k-grams that must be there; a base phrase must be whole.
ENOUGH = 0.8


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(label, base, k, grams, place, hash): one row for each k-gram of each template."""
    rows = []
    for base, group in ((True, phrases), (False, notices)):
        for number, (label, text) in enumerate(group):
            words = re.findall(WORD, text)
            k = 2 if len(words) <= SHORT else 3
            grams = len(words) - k + 1
            rows += [(f"{label}/{number}", label, base, k, grams, at, *words[at:at + k], *[None] * (3 - k))
                     for at in range(grams)]
    df = spark.createDataFrame(
        rows, "template string, label string, base boolean, k int, grams int, place int, w0 string, w1 string, "
              "w2 string")
    return df.withColumn("hash", F.when(F.col("k") == 2, F.xxhash64("w0", "w1")).otherwise(
        F.xxhash64("w0", "w1", "w2"))).drop("w0", "w1", "w2")


def _in_order(hits: Column) -> Column:
    """Places of the template that a span has in the template's order, each once.

    Going through the span, a place counts if it lies behind all places before it.
    """
    return F.aggregate(
        F.sort_array(hits), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
        lambda acc, hit: F.struct(
            F.greatest(acc["last"], hit["place"]).alias("last"),
            (acc["n"] + (hit["place"] > acc["last"]).cast("int")).alias("n")),
        lambda acc: acc["n"])


def placements(rolled: DataFrame, keys: list[str], grams: DataFrame) -> DataFrame:
    """Placements of templates: keys, template, label, base, ``coverage``, ``start``, ``end``.

    ``rolled`` holds a ``position`` and a ``hash`` per row; a row without a hash
    stands for its document and comes out once without a template.  Neighbouring
    diagonals are one span, which is verified: only places that follow one another
    as in the template count, so a place that several diagonals hit counts once.
    """
    grams = grams.withColumnRenamed("hash", "_gram")
    hits = rolled.join(F.broadcast(grams), F.col("hash") == F.col("_gram"), "left")
    hits = hits.filter(F.col("template").isNotNull() | F.col("hash").isNull())
    votes = hits.groupBy(
        *keys, "template", "label", "base", "k", "grams", (F.col("position") - F.col("place")).alias("diagonal")
    ).agg(F.collect_list(F.struct("position", "place")).alias("hits"), F.min("position").alias("start"),
          (F.max("position") + F.max("k")).alias("end"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    # A whole phrase stands on one diagonal; only notices are merged.
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(
        F.col("base"), 0).otherwise(NEAR), F.lit(True))
    votes = votes.withColumn("_island", F.sum(apart.cast("int")).over(order))
    return votes.groupBy(*keys, "template", "label", "base", "grams", "_island").agg(
        _in_order(F.flatten(F.collect_list("hits"))).alias("votes"), F.min("start").alias("start"),
        F.max("end").alias("end")
    ).withColumn("coverage", F.col("votes") / F.col("grams")).drop("_island", "votes", "grams")


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(labels), ",")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", enough: float = ENOUGH) -> DataFrame:
    """Per row: its key, ``n_words``, the base phrases' places, labels and a score.

    A placement holds if all k-grams of a phrase, or the share ``enough`` of a
    notice's, are in place.  ``score`` is the best coverage of any template, 1
    with a base phrase.  ``spans`` lists the placements that hold.  Null and
    empty texts have none; equal rows are results of their own.
    """
    lowered = F.translate(whole_text(text), string.ascii_uppercase, string.ascii_lowercase)
    df = docs.select(F.col(key), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("_words"))
    df = settle(df.withColumn("_uid", F.monotonically_increasing_id()), "_words")
    n = F.size("_words")

    def word(i: Column) -> Column:
        return F.get("_words", i)

    rolled = F.transform(F.when(n >= 2, F.sequence(F.lit(0), n - 2)), lambda i: F.struct(
        i.alias("position"), F.xxhash64(word(i), word(i + 1)).alias("two"),
        F.when(i + 2 < n, F.xxhash64(word(i), word(i + 1), word(i + 2))).alias("three")))
    own = F.array(F.struct(F.lit(-1).alias("position"), F.lit(None).cast("long").alias("two"),
                           F.lit(None).cast("long").alias("three")))
    keys = ["_uid", key, "n_words"]
    df = df.select(
        "_uid", key, n.cast("long").alias("n_words"),
        F.explode(F.concat(own, F.coalesce(rolled, F.array().cast(
            "array<struct<position:int,two:bigint,three:bigint>>")))).alias("_at"))
    df = df.select(*keys, "_at.position", F.explode(F.array("_at.two", "_at.three")).alias("hash"))
    df = df.filter(F.col("hash").isNotNull() | (F.col("position") == -1))
    found = placements(df, keys, template_grams(docs.sparkSession))
    base = F.col("base") & (F.col("coverage") == 1.0)
    holds = base | (~F.col("base") & (F.col("coverage") >= enough))
    span = F.struct("start", "end", "label", "coverage")
    out = found.groupBy(*keys).agg(
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        _joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        _joined(F.collect_set(F.when(holds, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(~F.col("base") | base, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(holds, span))).alias("spans"))
    return out.drop("_uid")
