"""License scans by diagonal voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower, id_and_text

#: The base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Opening words of public licenses and notices, with labels of our own.
NOTICES = (
    ("agpl-notice", "the terms of the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-notice", "this work is licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-notice", "this work is licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "no part of this publication may be reproduced or transmitted in any form without prior written permission"),
    ("public-domain", "dedicated to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
)
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram of the long templates, offsets that neighbouring diagonals may differ by, the least share of a
#: template's grams that a span must hold, and the greatest length of a span against its template's.
GRAM, NEAR, LEAST, LONGEST = 3, 6, 0.6, 1.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAK), "")


def template_positions(spark: SparkSession, base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row per gram of each template: (t_key, t0, t1, t2, template, t_pos), with t2 null for phrases of two words.

    Its size is that of the template list alone, so it may be broadcast. The row without words meets a document's own row.
    """
    rows = [(None, None, None, -1, 0)]
    for k, (_, phrase) in enumerate((*base, *notices)):
        w = phrase.split()
        n = min(GRAM, len(w))
        rows += [(*w[i : i + n], *[None] * (3 - n), k, i) for i in range(len(w) - n + 1)]
    df = spark.createDataFrame(rows, "t0 string, t1 string, t2 string, template int, t_pos int")
    return df.withColumn("t_key", F.when(F.col("template") >= 0, F.xxhash64("t0", "t1")).otherwise(0))


def license_scan(df: DataFrame, base: tuple = BASE, notices: tuple = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The hashes of all rolling word grams of every text are joined with the templates' positions (two words hashed, the
    third compared in the join, and all words compared themselves, so that a hit is exact). Hits vote for their diagonal,
    the offset between text and template; diagonals a few words apart are merged, so that a word put in or left out
    doesn't break a notice; a span counts if it holds enough of its template in a length like the template's, and a
    longer one if a stretch of such a length in it does. A base
    phrase counts only whole. score is the greatest share of a template found. Only hits and one row per document are
    shuffled, by document. Null and empty texts have no words and no labels; repeated rows (same id, same text) each get
    their row; a null id stays null; an empty table gives no rows.
    """
    spark = df.sparkSession
    texts = id_and_text(df, id_col, text_col)
    rows = texts.select("doc_id", F.xxhash64("text").alias("row_key"), words_of(F.col("text")).alias("words"))
    # The null behind the last word makes one row per document that meets the templates' row without words.
    grams = rows.select("doc_id", "row_key", "words", F.size("words").cast("long").alias("n_words"), F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "w0"))
    grams = grams.select("doc_id", "row_key", "n_words", "pos", "w0", F.get("words", F.col("pos") + 1).alias("w1"), F.get("words", F.col("pos") + 2).alias("w2"))
    grams = grams.withColumn("key", F.when(F.col("w0").isNull(), 0).otherwise(F.xxhash64("w0", "w1")))
    same = (F.col("key") == F.col("t_key")) & F.col("w0").eqNullSafe(F.col("t0")) & F.col("w1").eqNullSafe(F.col("t1")) & (F.col("t2").isNull() | F.col("w2").eqNullSafe(F.col("t2")))
    hits = grams.join(F.broadcast(template_positions(spark, base, notices)), same).select("doc_id", "row_key", "n_words", "template", "pos", "t_pos")

    doc = ["doc_id", "row_key", "n_words"]
    hits = hits.repartition("doc_id", "row_key").groupBy(*doc, "template", "pos", "t_pos").agg(F.count("*").alias("copies"))
    diagonals = hits.groupBy(*doc, "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("start"), F.max("pos").alias("last"), F.max("copies").alias("copies"), F.collect_list("pos").alias("at")
    )
    known = [*base, *notices]
    sizes = [len(p.split()) for _, p in known]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.col("template") + 1, F.lit(1)))
    order = W.partitionBy(*doc, "template").orderBy("diagonal")
    # A base phrase must be whole, on one diagonal; notices merge.
    fresh = (F.col("template") < len(base)) | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR)
    diagonals = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(order))
    spans = diagonals.groupBy(*doc, "template", "part").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("last").alias("last"), F.max("copies").alias("copies"))
    grams_in = [max(1, n - min(GRAM, n) + 1) for n in sizes]
    longest = [LONGEST * max(n, GRAM) for n in sizes]
    # A merged span that is too long, as of a notice that is repeated, counts by each stretch of a fitting length in it.
    part = W.partitionBy(*doc, "template", "part")
    long = diagonals.where(F.col("template") >= len(base)).withColumn("span", F.max("last").over(part) - F.min("start").over(part) + GRAM).where(F.col("span") > pick(longest))
    placed = long.select(*doc, "template", "part", "copies", "diagonal", F.explode("at").alias("start"))
    ahead = F.collect_list(F.struct("start", (F.col("start") - F.col("diagonal")).alias("t_pos"))).over(part.orderBy("start").rangeBetween(0, int(max(longest))))
    fits = placed.withColumn("ahead", ahead).withColumn("end", F.col("start") + pick(longest) - GRAM)
    votes = F.size(F.array_distinct(F.transform(F.filter("ahead", lambda x: x["start"] <= F.col("end")), lambda x: x["t_pos"])))
    fits = fits.withColumn("votes", votes.cast("long")).groupBy(*doc, "template").agg(F.max("votes").alias("votes"), F.max("copies").alias("copies"))
    fits = fits.select(*doc, "template", F.lit(0).alias("part"), "votes", F.lit(0).alias("start"), F.lit(0).alias("last"), "copies")
    spans = spans.unionByName(fits)
    spans = spans.select(*doc, "template", "start", "copies", pick([label for label, _ in known]).alias("label"), F.least(F.lit(1.0), F.col("votes") / pick(grams_in)).alias("share"), ((F.col("last") - F.col("start") + GRAM) <= pick(longest)).alias("short"))
    is_base = F.col("template").between(0, len(base) - 1)
    found = (is_base & (F.col("share") == 1)) | ((F.col("template") >= len(base)) & (F.col("share") >= LEAST) & F.col("short"))
    base_hit = is_base & (F.col("share") == 1)
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = spans.groupBy(*doc).agg(
        F.count_if(base_hit).alias("n_base"), F.min(F.when(base_hit, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base_hit, F.col("start"))).cast("long").alias("last_word"),
        names(base_hit).alias("base_labels"), names(found).alias("labels"), F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"), F.max("copies").alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
