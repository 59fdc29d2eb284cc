"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory.

The statements of a file are its lines that hold a licence word, and the whole text of a licence
file (by its name). Each distinct statement is scored once: its tokens are joined with the sparse
weights of the templates, products are summed per template, and the best template of at least
``SIMILAR`` stands for it. A file's own licence is that of its best statement. A directory has the
licence of its licence files; a file without one of its own gets that of the nearest directory
above it, found by joining each directory's ancestors with the licensed ones. DataFrame functions
only.

Cases: a null text holds no statement; a null path is a file without a directory, which inherits
nothing; rows that share a path are one file whose statements are united, and each gets the file's
result; statements that score alike for two templates take the one listed first; a directory's
licence is that of its best licence file, of the smallest path among equals. Other columns are
ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import SEPARATORS, table

SIMILAR = 0.6
#: a statement holds one of these, in lower case
WORDS = ("licen", "copyright", "rights reserved", "permission", "warrant", "redistribut", "public domain", "creative commons", "free software", "spdx")
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([.-][^/]*)?$"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"

#: fixed values: notices as their licences give them, and short forms in common use
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def weights(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, float]:
    """(token, idf, at): ``at`` lists (template, weight) with weights of unit length; idf of other tokens."""
    rows = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, (_, t) in enumerate(templates))
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, text)")
    tf = listed.select("template", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("template", "token").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("token").agg((F.log((1 + len(templates)) / (1 + F.count("*"))) + 1).alias("idf"))
    w = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    at = F.collect_list(F.struct("template", (F.col("w") / F.col("norm")).alias("w"))).alias("at")
    return w.join(norm, "template").groupBy("token").agg(F.first("idf").alias("idf"), at), log(1 + len(templates)) + 1


def has_word(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in WORDS:
        out = out | low.contains(w)
    return out


def statements(files: DataFrame) -> DataFrame:
    """(path, statement): trimmed lines with a licence word; licence files also their whole text."""
    text = F.coalesce("text", F.lit(""))
    some = files.select("path", text.alias("text")).filter(has_word(F.col("text")))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS))), has_word)
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array(F.btrim("text", F.lit(SEPARATORS)))).otherwise(F.array().cast("array<string>"))
    return some.select("path", F.explode(F.array_distinct(F.concat(lines, whole))).alias("statement"))


def scored(distinct: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(statement, template, similarity) of the best template of at least ``SIMILAR``."""
    table_, other = weights(distinct.sparkSession, templates)
    key = F.sha2(F.encode("statement", "utf-8"), 256).alias("s")
    tf = distinct.select(key, F.explode(_tokens(F.col("statement"))).alias("token")).groupBy("s", "token").agg(F.count("*").alias("tf"))
    # the table has a few hundred tokens, fixed by the list of templates
    w = tf.join(F.broadcast(table_.withColumnRenamed("token", "t")), F.col("token") == F.col("t"), "left")
    w = w.select("s", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("w"), "at")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    # one row per token and template; the statement's length comes along as a row of template -1
    each = w.select("s", "w", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("template"), F.col("w"))), F.coalesce("at", F.array().cast("array<struct<template:int,w:double>>")))).alias("x"))
    dot = each.groupBy("s", F.col("x.template").alias("template")).agg(F.sum(F.col("w") * F.col("x.w")).alias("dot"))
    length = F.max(F.when(F.col("template") == -1, F.sqrt("dot")))
    top = F.max(F.when(F.col("template") >= 0, F.struct(F.round("dot", 9).alias("dot"), (-F.col("template")).alias("minus"))))
    best = dot.groupBy("s").agg(length.alias("length"), top.alias("top")).select("s", (-F.col("top.minus")).alias("template"), (F.col("top.dot") / F.col("length")).alias("similarity"))
    return best.filter(F.col("similarity") >= SIMILAR)


def _licence(template: Column, templates: list[tuple[str, str]]) -> Column:
    return F.get(F.array(*(F.lit(n) for n, _ in templates)), template)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: path, own (licence) and its similarity, inherited and from_directory, licence."""
    files = files.select(F.col("path").cast("string"), F.col("text").cast("string"))
    held = statements(files)
    found = scored(held.select("statement").distinct(), templates).hint("rebalance")
    s = F.sha2(F.encode("statement", "utf-8"), 256)
    told = held.select("path", s.alias("k")).join(found, F.col("k") == F.col("s"))
    top = F.max(F.struct("similarity", (-F.col("template")).alias("minus"))).alias("top")
    own = told.groupBy("path").agg(top).select(F.col("path").alias("p"), _licence(-F.col("top.minus"), templates).alias("own"), F.round("top.similarity", 6).alias("similarity"))
    licensed = (
        own.filter(F.col("p").rlike(LICENCE_FILE))
        .groupBy(directory(F.col("p")).alias("licensed"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("p"), F.col("own"))).alias("best"))
        .select("licensed", F.col("best.own").alias("inherited"))
    )
    # ancestors of each directory once, however many files it holds
    places = files.select(directory(F.col("path")).alias("dir")).filter("dir is not null").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("up")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))
    climbed = places.select("dir", F.explode(F.when(F.col("dir") == "", root).otherwise(F.concat(root, above))).alias("a")).select("dir", "a.depth", "a.up")
    near = (
        climbed.join(licensed, F.col("up") == F.col("licensed"))
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "up", "inherited")).alias("n"))
        .select("dir", F.col("n.inherited").alias("inherited"), F.col("n.up").alias("from_directory"))
        .hint("rebalance")
    )
    out = files.select("path").join(own.hint("rebalance"), F.col("path") == F.col("p"), "left").withColumn("d", directory(F.col("path")))
    out = out.join(near, F.col("d") == F.col("dir"), "left")
    return out.select("path", "own", "similarity", "inherited", "from_directory", F.coalesce("own", "inherited").alias("licence"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: directories by source, thousand and fifty; the first of each is its LICENSE."""
    i = F.col("doc_id")
    up = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000).cast("string"))
    deep = F.concat_ws("/", up, F.floor(i / 50).cast("string"))
    name = F.when(i % 1000 == 0, F.concat(up, F.lit("/LICENSE"))).when(i % 50 == 0, F.concat(deep, F.lit("/LICENSE"))).otherwise(F.concat(deep, F.lit("/doc"), i.cast("string")))
    return docs.select("doc_id", name.alias("path"), "text")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents"))
    return scan(files)


def _op7_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES))
    word = " or ".join(f"contains(lower(l), '{w}')" for w in WORDS)
    trim = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    name = f"regexp_matches(path, '{LICENCE_FILE}')"
    dir_ = "case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '' end"
    n = len(TEMPLATES)
    return f"""
with tpl(template, name, body) as (values {rows}),
     f as (select coalesce(source, 'none') || '/' || cast(doc_id // 1000 as varchar) || case when doc_id % 1000 = 0 then '/LICENSE'
             else '/' || cast(doc_id // 50 as varchar) || case when doc_id % 50 = 0 then '/LICENSE' else '/doc' || cast(doc_id as varchar) end end as path,
             coalesce(text, '') as text from documents),
     ln as (select path, {trim} as statement from (select path, unnest(string_split(text, chr(10))) as l from f) where {word}
            union select path, {trim} from (select path, text as l from f) where ({word}) and {name}),
     d as (select distinct statement from ln),
     tt as (select template, token, count(*) as tf from (select template, unnest(regexp_extract_all(lower(body), '{TOKEN}')) as token from tpl) group by 1, 2),
     idf as (select token, ln((1 + {n}) / (1 + count(*)::double)) + 1 as idf from tt group by 1),
     tw as (select template, token, tf * idf as w from tt join idf using (token)),
     tn as (select template, sqrt(sum(w * w)) as norm from tw group by 1),
     st as (select statement, token, count(*) as tf from (select statement, unnest(regexp_extract_all(lower(statement), '{TOKEN}')) as token from d) group by 1, 2),
     sw as (select statement, token, tf * coalesce(idf, ln(1.0 + {n}) + 1) as w from st left join idf using (token)),
     sn as (select statement, sqrt(sum(w * w)) as norm from sw group by 1),
     dot as (select statement, template, round(sum(sw.w * tw.w / tn.norm), 9) as dot from sw join tw using (token) join tn using (template) group by 1, 2),
     best as (select statement, template, dot / norm as similarity from dot join sn using (statement)
              qualify row_number() over (partition by statement order by dot desc, template) = 1),
     own as (select path, name as own, round(similarity, 6) as similarity from ln join best using (statement) join tpl using (template) where similarity >= {SIMILAR}
             qualify row_number() over (partition by path order by similarity desc, template) = 1),
     dirs as (select {dir_.format('path')} as licensed, own as inherited from own where {name}
              qualify row_number() over (partition by {dir_.format('path')} order by similarity desc, path) = 1),
     p as (select path, {dir_.format('path')} as dir from f),
     up as (select dir, k, array_to_string(string_split(dir, '/')[1:k], '/') as up from (select dir, unnest(range(0, len(string_split(dir, '/')) + 1)) as k from (select distinct dir from p))),
     near as (select dir, inherited, up as from_directory from up join dirs on up = licensed qualify row_number() over (partition by dir order by k desc) = 1)
select p.path, own, similarity, inherited, from_directory, coalesce(own, inherited) as licence
from p left join own using (path) left join near using (dir)
"""


OP7_SQL = _op7_sql()
