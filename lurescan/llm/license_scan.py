"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates.

Blocks are the lines of a text, longer ones in overlapping windows, and such windows over the whole text,
so a notice may be wrapped. A block must have the words that name the license of a template, and none
of those that name a rival. Tokens are ordered by their frequency over all blocks, rarest first. A
block that has the wanted share of a template's tokens must share one of the template's first
``size - needed + 1`` tokens (prefix), have ``needed`` template tokens at all (length), and still have
enough of them from the first shared token on (position). What passes is verified by intersection.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescan.functions.url import let
from lurescan.llm.text import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that are looked for as token sets: the label, which a license may share over several notices,
#: the words, those of them that must not be missing, and words of rivals that must not stand beside
#: them. A label counts only where no longer one of its family (``gpl`` of ``gpl-3``) was found.
_GNU = "gnu general public license"
_TERMS = f"you can redistribute it and or modify it under the terms of the {_GNU} as published by the free software foundation"
_OTHER_GNU = "lesser affero library"
TEMPLATES = [
    ("mit", "released under the mit license", "mit", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction", "granted charge", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2", ""),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at www apache org", "apache", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc", ""),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative noncommercial", ""),
    ("cc-by-nc", "licensed under a creative commons attribution non commercial 4 0 international license", "creative commercial", ""),
    ("gpl", f"this work is licensed under the {_GNU}", "gnu general", _OTHER_GNU),
    ("gpl-2", f"this work is licensed under the {_GNU} version 2", "gnu general 2", _OTHER_GNU),
    ("gpl-3", f"this work is licensed under the {_GNU} version 3", "gnu general 3", _OTHER_GNU),
    ("gpl", _TERMS, "gnu general", _OTHER_GNU),
    ("gpl-2", f"{_TERMS} either version 2 of the license", "gnu general 2", f"{_OTHER_GNU} 3"),
    ("gpl-3", f"{_TERMS} either version 3 of the license", "gnu general 3", _OTHER_GNU),
    ("lgpl", "this work is licensed under the gnu lesser general public license", "gnu lesser", ""),
    ("agpl", "this work is licensed under the gnu affero general public license", "gnu affero", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met", "redistribution binary", ""),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission", "neither endorse", ""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", "eclipse 2", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "permission fee", ""),
    ("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
]

Template = tuple[str, str, str, str]

#: Share of a template's tokens that a block must have.
CONTAINMENT = 0.8

#: The index is broadcast up to so many template tokens; beyond, the join is shuffled.
BROADCAST_TOKENS = 200_000


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z only)."""
    parts = F.split(F.translate(text, UPPER, LOWER), BREAKS)
    return F.filter(parts, lambda w: w != "")


def starts(found: Column, wanted: list[str]) -> Column:
    """Places where the words stand consecutively."""
    def here(i: Column) -> Column:
        same = F.get(found, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            same = same & (F.get(found, i + k) == w)
        return F.coalesce(same, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(found) - 1), here)


def labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))


def phrase_places(found: Column, phrases: dict[str, str]) -> Column:
    """``(at, label)`` of every place where a phrase's words stand consecutively."""
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.concat(*[
        F.when(F.array_contains(found, max(p.split(), key=len)), labelled(starts(found, p.split()), label)).otherwise(none)
        for p, label in phrases.items()
    ])


def template_index(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``(template, label, tokens, names, rivals)``: distinct tokens, those that must and those that must not stand."""
    rows = [(i, label, sorted({*text.split(), *names.split()}), names.split(), rivals.split())
            for i, (label, text, names, rivals) in enumerate(templates)]
    return spark.createDataFrame(
        rows, "template int, label string, tokens array<string>, names array<string>, rivals array<string>")


def span(templates: list[Template]) -> int:
    """The words of the longest template."""
    return max((len(t[1].split()) for t in templates), default=1)


def windows(found: Column, size: int) -> Column:
    """Words in blocks of at most ``2 * size``, one every ``size``, so that ``size`` next words share a block."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - size, F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.slice(found, i, 2 * size))


def contained(profiles: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """``(row, line, template, label, share)`` for each block that holds the share of a template.

    ``profiles`` has ``row, line, tokens``: the distinct template tokens of each block of each row.
    """
    counts = profiles.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    vocabulary = templates.select(F.explode(F.concat("tokens", "rivals")).alias("token")).distinct()
    ranked = vocabulary.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    ranks = stored(ranked.withColumn("rank", F.row_number().over(W.orderBy("n", "token"))).select("token", "rank"))
    small = ranks.count() <= BROADCAST_TOKENS
    offered = F.broadcast if small else (lambda df: df)

    size, needed = F.size("tokens"), F.ceil(F.size("tokens") * threshold - 1e-9).cast("int")
    ordered = templates.select("template", "label", "names", F.explode("tokens").alias("token")).join(offered(ranks), "token")
    named = F.collect_list(F.when(F.array_contains("names", F.col("token")), F.col("rank")))
    ordered = ordered.groupBy("template", "label").agg(F.array_sort(F.collect_list("rank")).alias("tokens"), named.alias("names"))
    rivals = templates.select("template", F.explode("rivals").alias("token")).join(offered(ranks), "token")
    rivals = rivals.groupBy("template").agg(F.collect_list("rank").alias("rivals"))
    ordered = ordered.join(rivals, "template", "left").select(
        "template", "label", "tokens", "names", F.coalesce("rivals", F.array().cast("array<int>")).alias("rivals"),
        size.alias("size"), needed.alias("needed"))
    index = ordered.select("*", F.posexplode("tokens").alias("place", "rank")).filter("place <= size - needed")

    least = ordered.agg(F.min("needed")).first()[0] or 1
    blocks = profiles.filter(F.size("tokens") >= least)
    tokens = blocks.select("row", "line", F.explode("tokens").alias("token")).join(offered(ranks), "token")
    probes = tokens.join(offered(index.select("rank").distinct()), "rank", "left_semi")
    # the whole ordered token list of the few blocks that have a prefix token at all
    held = tokens.join(probes.select("row", "line").distinct(), ["row", "line"], "left_semi")
    lists = held.groupBy("row", "line").agg(F.array_sort(F.collect_list("rank")).alias("block"))
    near = lists.select("row", "line", "block", F.posexplode("block").alias("at", "rank"))
    near = near.join(offered(index), "rank").filter(
        (F.size("block") >= F.col("needed"))
        & (F.size("block") - F.col("at") >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("block", "tokens"))
    checked = near.withColumn("shared", shared).filter(
        (F.col("shared") >= F.col("needed")) & (F.size(F.array_except("names", "block")) == 0)
        & ~F.arrays_overlap("rivals", "block"))
    return checked.select("row", "line", "template", "label", (F.col("shared") / F.col("size")).alias("share")).distinct()


def scan(
    documents: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES,
    threshold: float = CONTAINMENT,
) -> DataFrame:
    """Per row: words, places of the fixed phrases, labels of both kinds, and the best share.

    ``score`` is the largest share of a template that a block of the text holds, 1 where a phrase
    stands, else 0. NULL and empty texts have no words; repeated rows are each scanned; other columns
    are dropped. Texts are read once; what is stored is the numbers of each row and, of each line that
    could hold a template, its template tokens.
    """
    spark = documents.sparkSession
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for part in t[1:] for w in part.split()})])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def profile(line: Column) -> Column:
        return F.transform(windows(line, span(templates)), lambda block: F.array_intersect(block, vocabulary))

    lines = F.flatten(F.transform(F.split(text, "\n"), lambda line: let(words(line), profile)))
    across = F.when(text.contains("\n"), let(words(text), profile)).otherwise(F.array().cast("array<array<string>>"))
    lines = F.concat(lines, across)
    rows = documents.select("doc_id", words(text).alias("words"), lines.alias("lines"))
    rows = stored(rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("bigint").alias("n_words"),
        phrase_places(F.col("words"), phrases).alias("places"), "lines"))
    profiles = rows.select("row", F.posexplode("lines").alias("line", "tokens")).filter(F.size("tokens") > 0)
    found = contained(profiles, template_index(spark, templates), threshold)
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = rows.drop("lines").join(by_row, "row", "left")
    at, base = F.transform("places", lambda p: p.at), F.array_distinct(F.transform("places", lambda p: p.label))
    every = F.coalesce("more", F.array().cast("array<string>"))
    more = F.filter(every, lambda x: ~F.exists(every, lambda y: F.startswith(y, F.concat(x, F.lit("-")))))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle_sql(
    templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = CONTAINMENT
) -> str:
    """The same result in SQL: every block is compared with every template."""
    def literal(items) -> str:
        return "CAST([" + ", ".join("'" + x + "'" for x in items) + "] AS VARCHAR[])"

    def row(label: str, text: str, names: str, rivals: str) -> str:
        tokens = sorted({*text.split(), *names.split()})
        needed = math.ceil(len(tokens) * threshold - 1e-9)
        return f"({literal(tokens)}, '{label}', {len(tokens)}, {needed}, {literal(names.split())}, {literal(rivals.split())})"

    split = (
        "list_filter(regexp_split_to_array(translate({t}, '" + UPPER + "', '" + LOWER + "'), "
        "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    )
    kinds = ", ".join(row(*t) for t in templates)
    wanted = ", ".join(f"({literal(p.split())}, '{label}')" for p, label in phrases.items())
    size = span(templates)
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, r, t, {split.format(t="t")} AS words FROM d
), phrase(p, label) AS (VALUES {wanted}),
spot AS (
  SELECT r, i - 1 AS pos, label
  FROM (SELECT w.r, words, p, label, unnest(range(1, len(words) + 1)) AS i FROM w, phrase
        WHERE list_contains(words, p[1]))
  WHERE words[i:i + len(p) - 1] = p
), base AS (
  SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_distinct(list(label)) AS labels FROM spot GROUP BY r
), part AS (
  SELECT r, {split.format(t="l")} AS words FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  UNION ALL SELECT r, words FROM w WHERE contains(t, chr(10))
), block AS (
  SELECT r, list_distinct(words[i:i + {2 * size} - 1]) AS b
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - {size}, 1) + 1, {size})) AS i FROM part WHERE len(words) > 0)
), template(tokens, label, size, needed, names, rivals) AS (VALUES {kinds}),
hit AS (
  SELECT r, label, len(list_intersect(b, tokens)) / size AS share FROM block, template
  WHERE len(b) >= needed AND len(list_intersect(names, b)) = len(names) AND len(list_intersect(b, tokens)) >= needed
    AND len(list_intersect(rivals, b)) = 0
), every AS (
  SELECT r, list_distinct(list(label)) AS labels, max(share) AS share FROM hit GROUP BY r
), more AS (
  SELECT r, share, list_filter(labels, lambda x: len(list_filter(labels, lambda y: starts_with(y, x || '-'))) = 0) AS labels FROM every
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '')
    AS labels,
  CAST(greatest(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0)) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""
