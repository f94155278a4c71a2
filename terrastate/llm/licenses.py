"""License scans: an exact set-similarity join of text blocks with license templates.

DataFrame functions only.  A block is any run of consecutive words, whatever
lines they stand on, a quarter longer than the template it is held against
(``notice_scan``), of one length for all templates (``license_scan`` with
``run``), or a line of a document, as a set of words; a template meets it if at
least ``threshold`` of the template's words stand in the block, and with
``notice_scan`` those among them that name the license.  Words are ordered by their frequency over all blocks, rarest first.
Such a pair shares at least ``need`` words, so both prefixes (all but need - 1
of the words in that order) share a word; the block has at least ``need`` words;
and a shared word at places i and j leaves room for ``need`` shared words.  The
join is on prefix words, the other filters prune it, and the pairs left are
counted exactly.  Templates are a parameter of the job, of at most ``MOST_WORDS``
different words, so what is broadcast (their words) has a bound; only words that
templates use are counted.  Runs are joined as stretches of two runs, one
beginning at every run's length, so that each run lies in a stretch; a pair left
is counted in every run of its stretch.

Beside it, phrases are places where certain words stand consecutively.

Results: a null or empty text has no words, no places and no labels; repeated
rows and null ids get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import materialize, text_rows

#: Words of lower-cased texts, phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of well-known licenses and notices.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "copyright": "copyright all rights reserved",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
}


#: Wordings of licenses and notices, with the words that must not be missing.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met", "redistribution binary"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("copyright", "copyright all rights reserved", "copyright reserved"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies", "permission granted fee"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
             "as published by the free software foundation", "gnu lesser license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction", "permission granted charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
             "damages arising from the use of this software", "warranty liable authors"),
]
MOST_WORDS = 20_000  # different words of all templates of a job


def lower_ascii(text: Column) -> Column:
    """Lower case for matching ASCII words.  Other letters may change too, which
    matters to no word boundary and no ASCII word, but for the Kelvin sign,
    whose lower case is a k: it is replaced first.  (Much faster than a
    translation of 26 letters.)"""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u03ba")))


def words_of(lowered: Column) -> Column:
    """Words in order: what stands between runs of other characters."""
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def phrase_starts(words: Column, phrases: dict[str, str]) -> Column:
    """(label, start) of every place of a phrase, in order of start."""
    first = sorted({p.split()[0] for p in phrases})
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(first))

    def places(phrase: list[str], label: str) -> Column:
        there = F.filter(at, lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
        return F.transform(there, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return F.concat(*[places(p.split(), label) for p, label in phrases.items()])


def longest(templates: dict[str, str]) -> int:
    """Words of the longest template: the length of a run."""
    return max(len(words.split()) for words in templates.values())


def prefix_index(spark: SparkSession, sets: dict[str, list[str]], ranked: list[str], threshold: float) -> tuple[list[tuple], DataFrame]:
    """The prefix words of each template (all but need - 1, rarest first), as rows and as a broadcast table."""
    index = [(label, w, i, len(words), need(len(words), threshold), sorted(words, key=ranked.index))
             for label, words in sets.items() for i, w in enumerate(sorted(words, key=ranked.index)) if i <= len(words) - need(len(words), threshold)]
    return index, F.broadcast(spark.createDataFrame(index, "label string, word string, t_at int, t_size int, need int, t_words array<string>"))


def filtered_pairs(seeds: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs of a block's template words (rarest first; each with its place ``b_at``) and a template that pass the filters."""
    return (seeds.join(prefixes, "word")
            .filter(F.col("size") >= F.col("need"))  # length
            .filter(F.col("b_at") <= F.size("words") - F.col("need"))  # prefix of the block
            .filter(F.least("b_at", "t_at") + 1 + F.least(F.size("words") - F.col("b_at") - 1, F.col("t_size") - F.col("t_at") - 1)
                    >= F.col("need")))  # position


def block_matches(spark: SparkSession, rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(key, label, containment): best block of each document for each template it meets.  ``rows``: key, lowered."""
    sets = {label: sorted(set(words.split())) for label, words in templates.items()}
    used = sorted({w for words in sets.values() for w in words})
    vocabulary = F.array(*map(F.lit, used))
    blocks = (rows.select("key", F.explode(F.split("lowered", "\n")).alias("line"))
              .select("key", F.array_distinct(words_of(F.col("line"))).alias("words"))
              .select("key", F.size("words").alias("size"), F.array_intersect("words", vocabulary).alias("words")))
    blocks = blocks.filter(F.size("words") > 0).withColumn("block", F.xxhash64("words", "size"))
    # a block with fewer template words than the least need can meet none; equal blocks are joined once
    least = min(need(len(words), threshold) for words in sets.values())
    blocks = materialize(spark, blocks.filter(F.size("words") >= least), "blocks")
    frequency = {r.w: r.n for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = sorted(used, key=lambda w: (frequency.get(w, 0), w))
    order = F.array(*map(F.lit, ranked))  # rarest first; as many as the templates' words

    _, prefixes = prefix_index(spark, sets, ranked, threshold)
    # words of no template match nothing, so a block's order is that of its template words
    ordered = blocks.select("block", "size", "words").distinct().withColumn("words", F.array_intersect(order, "words"))
    seeds = ordered.select("block", "size", "words", F.posexplode("words").alias("b_at", "word"))
    pairs = filtered_pairs(seeds, prefixes).select("block", "label", "words", "t_words", "t_size", "need").dropDuplicates(["block", "label"])
    met = (pairs.withColumn("shared", F.size(F.array_intersect("words", "t_words"))).filter("shared >= need")
           .select("block", "label", (F.col("shared") / F.col("t_size")).alias("containment")))
    return (blocks.select("key", "block").join(met, "block")
            .groupBy("key", "label").agg(F.max("containment").alias("containment")))


def run_matches(spark: SparkSession, rows: DataFrame, templates: dict[str, str], threshold: float, run: int) -> DataFrame:
    """(key, label, containment): best run of ``run`` consecutive words of each document for each template it meets."""
    sets = {label: sorted(set(words.split())) for label, words in templates.items()}
    used = sorted({w for words in sets.values() for w in words})
    texts = rows.select("key", words_of(F.col("lowered")).alias("all"))
    frequency = {r.w: r.n for r in texts.select(F.explode(F.array_intersect("all", F.array(*map(F.lit, used)))).alias("w"))
                 .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = sorted(used, key=lambda w: (frequency.get(w, 0), w))
    order = F.array(*map(F.lit, ranked))
    index, prefixes = prefix_index(spark, sets, ranked, threshold)
    first = F.array(*map(F.lit, sorted({w for _, w, *_ in index})))

    # only texts, and then stretches, with a prefix word can meet a template
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("all") / run).cast("int") - 1, F.lit(0))),
                            lambda k: F.slice("all", k * run + 1, 2 * run))
    blocks = (texts.select("key", F.explode(F.when(F.arrays_overlap("all", first), stretches)).alias("stretch"))
              .filter(F.arrays_overlap("stretch", first))
              .withColumn("words", F.array_intersect(order, "stretch")))
    seeds = blocks.select("key", "stretch", F.size(F.array_distinct("stretch")).alias("size"), "words", F.posexplode("words").alias("b_at", "word"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("stretch") - run + 1, F.lit(1)))
    shared = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("stretch", s, run), F.col("t_words")))))
    met = filtered_pairs(seeds, prefixes).filter(F.size(F.array_intersect("words", "t_words")) >= F.col("need"))
    return (met.select("key", "label", "t_size", "need", shared.alias("shared")).filter("shared >= need")
            .groupBy("key", "label").agg(F.max(F.col("shared") / F.col("t_size")).alias("containment")))


def run_length(words: str) -> int:
    """Words of a block that is held against this notice."""
    n = len(words.split())
    return n + n // 4


def notice_matches(spark: SparkSession, rows: DataFrame, notices: list[tuple[str, str, str]], threshold: float) -> DataFrame:
    """(doc_id, key, label, containment): best block of each document for each label it meets."""
    sets = [(label, sorted(set(text.split())), sorted(set(must.split())), run_length(text)) for label, text, must in notices]
    used = sorted({w for _, words, *_ in sets for w in words})
    if len(used) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} different words; scan with parts of them")
    if not all(set(must) <= set(words) and must for _, words, must, _ in sets):
        raise ValueError("a notice needs words that must not be missing, of its own")
    run = max(n for *_, n in sets)
    # a text that lacks a word of every notice's naming words, even as part of a word, meets none
    named = F.lit(False)
    for must in sorted({tuple(m) for _, _, m, _ in sets}):
        there = F.lit(True)
        for w in must:
            there = there & F.contains(F.col("lowered"), F.lit(w))
        named = named | there
    texts = materialize(spark, rows.filter(named).select("doc_id", "key", words_of(F.col("lowered")).alias("all")), "license-texts")
    frequency = {r.w: r.n for r in texts.select(F.explode(F.array_intersect("all", F.array(*map(F.lit, used)))).alias("w"))
                 .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {w: k for k, w in enumerate(sorted(used, key=lambda w: (frequency.get(w, 0), w)))}
    order = F.array(*map(F.lit, sorted(used, key=rank.get)))
    prefixes = []
    for label, words, must, length in sets:
        least, ordered = need(len(words), threshold), sorted(words, key=rank.get)
        prefixes += [(label, w, i, len(words), least, ordered, must, length) for i, w in enumerate(ordered) if i <= len(words) - least]
    table = spark.createDataFrame(prefixes, "label string, word string, t_at int, t_size int, need int, t_words array<string>, must array<string>, run int")
    first = F.array(*map(F.lit, sorted({w for _, w, *_ in prefixes})))

    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("all") / run).cast("int") - 1, F.lit(0))),
                            lambda k: F.slice("all", k * run + 1, 2 * run))
    blocks = (texts.select("doc_id", "key", F.explode(stretches).alias("stretch")).filter(F.arrays_overlap("stretch", first))
              .withColumn("words", F.array_intersect(order, "stretch")))
    seeds = blocks.select("doc_id", "key", "stretch", F.size(F.array_distinct("stretch")).alias("size"), "words", F.posexplode("words").alias("b_at", "word"))
    whole = lambda words: F.size(F.array_intersect(words, F.col("must"))) == F.size("must")
    pairs = filtered_pairs(seeds, F.broadcast(table)).filter((F.size(F.array_intersect("words", "t_words")) >= F.col("need")) & whole(F.col("words")))
    pairs = pairs.dropDuplicates(["doc_id", "key", "stretch", "label", "run", "t_words"])  # of several prefix words
    starts = F.sequence(F.lit(1), F.greatest(F.size("stretch") - F.col("run") + 1, F.lit(1)))

    def shared(s: Column) -> Column:
        block = F.slice("stretch", s, F.col("run"))
        return F.when(whole(block), F.size(F.array_intersect(block, F.col("t_words")))).otherwise(0)

    met = pairs.select("doc_id", "key", "label", "t_size", "need", F.array_max(F.transform(starts, shared)).alias("shared")).filter("shared >= need")
    return met.groupBy("doc_id", "key", "label").agg(F.max(F.col("shared") / F.col("t_size")).alias("containment"))


def notice_scan(spark: SparkSession, docs: DataFrame, notices: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None,
                threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, places (label, start of each phrase place), matches (label, containment of each label met) of each row.

    ``notices``: (label, wording, words of it that must not be missing); a label may have several."""
    notices, phrases = NOTICES if notices is None else notices, PHRASES if phrases is None else phrases
    rows = _lowered(docs)
    found, matches = phrase_places(rows, phrases), notice_matches(spark, rows.select("doc_id", "key", "lowered").distinct(), notices, threshold)
    by_text = matches.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches"))
    met = found.join(by_text, (found.key == by_text.key) & found.doc_id.eqNullSafe(by_text.doc_id), "left")
    return met.select(found.doc_id, "n_words", "places", F.coalesce("matches", F.array().cast("array<struct<label:string,containment:double>>")).alias("matches"))


def _lowered(docs: DataFrame) -> DataFrame:
    return text_rows(docs).withColumn("key", F.xxhash64("text", "doc_id")).withColumn("lowered", lower_ascii(F.col("text")))


def phrase_places(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, key, n_words and the places of the phrases."""
    # the words are looked at one by one only in texts that hold a phrase's words in a row
    maybe = F.lit(False)
    for p in phrases:
        maybe = maybe | (F.contains(F.col("lowered"), F.lit(p.split()[0])) & F.contains(F.col("lowered"), F.lit(p.split()[-1])))
    near = "|".join("[^a-z0-9]+".join(p.split()) for p in phrases)
    return (rows.select("doc_id", "key", F.regexp_count("lowered", F.lit(WORD)).cast("long").alias("n_words"),
                        F.when(maybe & F.col("lowered").rlike(near), words_of(F.col("lowered"))).otherwise(F.array().cast("array<string>")).alias("words"))
            .select("doc_id", "key", "n_words", phrase_starts(F.col("words"), phrases).alias("places")))


def license_scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
                 threshold: float = 0.8, run: int | None = None) -> DataFrame:
    """doc_id, n_words, places (label, start of each phrase place), matches (label, containment of each template met) of each row.

    ``run``: templates are looked for in all runs of so many consecutive words (``longest``), not in lines.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    rows = _lowered(docs)
    found = phrase_places(rows, phrases)
    texts = rows.select("key", "lowered")
    matches = block_matches(spark, texts, templates, threshold) if run is None else run_matches(spark, texts, templates, threshold, run)
    by_text = matches.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches"))
    return found.join(by_text, "key", "left").select(
        "doc_id", "n_words", "places", F.coalesce("matches", F.array().cast("array<struct<label:string,containment:double>>")).alias("matches"))


def digest(scan: DataFrame) -> DataFrame:
    """The registered query's columns of a scan."""
    labels = lambda *parts: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*parts))))
    return scan.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"), labels(F.col("places.label")).alias("base_labels"),
        labels(F.col("places.label"), F.col("matches.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"))


def notices_sql(notices: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """``notice_scan``'s query in plain SQL: every run of every length against every notice of that length."""
    phrases = PHRASES if phrases is None else phrases
    sets = ", ".join(f"('{label}', {sorted(set(text.split()))!r}, {sorted(set(must.split()))!r}, {run_length(text)})"
                     for label, text, must in (NOTICES if notices is None else notices))
    met = f"""met AS (
      SELECT r, label, max(len(list_intersect(block, words)) / len(words)) AS containment FROM (
        SELECT r, label, words, must, list_distinct(w[i + 1:i + run]) AS block FROM (
          SELECT p.r, p.w, t.*, unnest(range(greatest(len(p.w) - t.run + 1, 1))) AS i FROM p JOIN templates t ON list_has_all(p.w, t.must)))
      WHERE list_has_all(block, must) AND len(list_intersect(block, words)) >= ceil({threshold} * len(words) - 1e-9) GROUP BY r, label)"""
    return _scan_sql(f"(VALUES {sets}) AS v(label, words, must, run)", met, phrases)


def oracle_sql(templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8,
               run: int | None = None) -> str:
    """The registered query in plain SQL: every line (or run of words) against every template."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    word = WORD.replace("'", "''")
    sets = ", ".join(f"('{label}', {sorted(set(x.split()))!r})" for label, x in templates.items())
    blocks = f"list_distinct(regexp_extract_all(line, '{word}')) AS words FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)"
    if run is not None:
        blocks = f"list_distinct(w[i + 1:i + {run}]) AS words FROM (SELECT r, w, unnest(range(greatest(len(w) - {run} + 1, 1))) AS i FROM p)"
    met = f"""lines AS (SELECT DISTINCT r, {blocks}),
    met AS (SELECT r, label, max(len(list_intersect(l.words, t.words)) / len(t.words)) AS containment FROM lines l, templates t
            WHERE len(list_intersect(l.words, t.words)) >= ceil({threshold} * len(t.words) - 1e-9) GROUP BY r, label)"""
    return _scan_sql(f"(VALUES {sets}) AS v(label, words)", met, phrases)


def _scan_sql(templates: str, met: str, phrases: dict[str, str]) -> str:
    word, out = WORD.replace("'", "''"), []
    for p, label in phrases.items():
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        out.append(f"[{{'label': '{label}', 'start': i}} for i in range(len(w)) if {same}]")
    places = out[0]
    for o in out[1:]:
        places = f"list_concat({places}, {o})"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents),
    p AS (SELECT r, doc_id, w, len(w) AS n_words, {places} AS places FROM (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS w FROM d)),
    templates AS (SELECT * FROM {templates}),
    {met},
    m AS (SELECT r, list(label) AS labels, max(containment) AS best FROM met GROUP BY r)
    SELECT doc_id, n_words, len(places) AS n_base, list_min([x.start for x in places]) AS first_word, list_max([x.start for x in places]) AS last_word,
           array_to_string(list_sort(list_distinct([x.label for x in places])), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat([x.label for x in places], coalesce(labels, [])))), ',') AS labels,
           CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM p LEFT JOIN m USING (r)"""
