"""License scans by an exact set-similarity join, on DataFrame functions alone.

Texts are cut into overlapping blocks of words, templates are sets of words, and a block meets a template if it
holds the template's share of words. Words are ordered by how often they occur in all texts,
rare ones first. A block that holds o of the m words of a template holds one of its m - o + 1 rarest (prefix
filter), has o template words at least (length filter), and from the first common word on enough
words are left on both sides (positional filter). So blocks and templates are joined on the rarest words
only, and the few pairs that pass the filters are counted word by word. Nothing but template words is kept of a
text, so no text is shuffled.

Phrases are templates whose words must all be there; a join pair is then looked through for the places
where they stand one after the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import check_columns
from cohortlake.llm.decontaminate import words_of
from cohortlake.session import settle

STRIDE = 32  # words from one block's start to the next; a block is two strides long
CONTAINMENT = 0.85
MAX_BROADCAST_ROWS = 100_000  # rows of the template index, one per template and prefix word, of 2 KB at most


@dataclass(frozen=True)
class Template:
    """A label and the words that call for it; a phrase must stand in one piece."""

    label: str
    text: str
    phrase: bool = False


# phrases and opening words of notices as they stand in public license texts (fixed values)
PHRASES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
]
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
]


def template_words(t: Template) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t.text)) if w]


def needed(t: Template, containment: float) -> int:
    """Words of a template that a block must hold."""
    size = len(set(template_words(t)))
    return size if t.phrase else max(1, math.ceil(round(containment * size, 9)))


def _marks(docs: DataFrame, vocabulary: list[str], stride: int, id_col: str, text_col: str) -> DataFrame:
    """(id, _tie, n_words, parts): the template words of every ``stride`` words with their places."""
    body = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("_tie"), words_of(body).alias("w"))

    def part(s: Column) -> Column:
        placed = F.transform(F.slice("w", s * stride + 1, F.lit(stride)), lambda x, i: F.struct((s * stride + i).cast("int").alias("at"), x.alias("x")))
        return F.filter(placed, lambda h: h["x"].isin(vocabulary))

    n = F.size("w")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / stride), F.lit(0)).cast("int")), part)
    return settle(rows.select("id", "_tie", n.cast("long").alias("n_words"), parts.alias("parts")), "license-words")


def _index(spark, templates: list[Template], often: dict[str, int], containment: float) -> tuple[DataFrame, list[str], list[str]]:
    """The prefix words of all templates with what the filters need; all template words and the prefix words, rare first."""
    order = sorted({w for t in templates for w in template_words(t)}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows, first = [], set()
    for number, t in enumerate(templates):
        own, need = sorted({rank[w] for w in template_words(t)}), needed(t, containment)
        for i, r in enumerate(own[: len(own) - need + 1]):
            rows.append((r, number, t.label, t.phrase, i, need, own, [rank[w] for w in template_words(t)]))
            first.add(order[r])
    kinds = "word int, template int, label string, phrase boolean, i int, need int, own array<int>, said array<int>"
    index = spark.createDataFrame(rows, kinds)
    return (F.broadcast(index) if len(rows) <= MAX_BROADCAST_ROWS else index), order, sorted(first)


def _joined(marks: DataFrame, index: DataFrame, order: list[str], first: list[str], stride: int) -> DataFrame:
    """(id, _tie, block, template, label, phrase, share, places): every block and template that meet, once."""
    ranks = F.map_from_arrays(F.array(*[F.lit(w) for w in order]), F.array(*[F.lit(i) for i in range(len(order))]))
    nothing = F.array().cast("array<struct<at:int,x:string>>")
    cut = F.transform("parts", lambda p, s: F.struct(s.alias("block"), F.concat(p, F.coalesce(F.get("parts", s + 1), nothing)).alias("hits")))
    rare = F.filter(cut, lambda b: F.exists(b["hits"], lambda h: h["x"].isin(first)))
    blocks = marks.select("id", "_tie", F.explode(rare).alias("b")).select("id", "_tie", "b.block", "b.hits")
    hits = F.transform("hits", lambda h: F.struct(h["at"].alias("at"), F.element_at(ranks, h["x"]).alias("r")))
    blocks = blocks.select("id", "_tie", "block", hits.alias("hits")).withColumn("words", F.array_sort(F.array_distinct(F.col("hits.r"))))
    probes = blocks.select("*", F.posexplode("words").alias("j", "word"))
    left = F.least(F.size("words") - F.col("j"), F.size("own") - F.col("i"))  # common words at most, from this one on
    near = probes.join(index, "word").where((F.size("words") >= F.col("need")) & (left >= F.col("need")))
    common = F.array_intersect("words", "own")
    near = near.where((F.size(common) >= F.col("need")) & (F.array_min(common) == F.col("word")))  # a pair stands at its first common word only
    follows = lambda k: F.forall(F.sequence(F.lit(1), F.size("said")), lambda t: (F.get("hits.r", k + t - 1) == F.get("said", t - 1)) & (F.get("hits.at", k + t - 1) == F.get("hits.at", k) + t - 1))
    begins = F.filter(F.transform("hits", lambda h, k: F.when(F.coalesce(follows(k), F.lit(False)), h["at"])), lambda p: p.isNotNull() & (F.floor(p / stride) == F.col("block")))
    share = F.size(common) / F.size("own")
    places = F.when(F.col("phrase"), begins).otherwise(F.array().cast("array<int>"))
    return near.select("id", "_tie", "block", "template", "label", "phrase", share.alias("share"), places.alias("places"))


def license_scan(
    docs: DataFrame,
    templates: list[Template] | None = None,
    containment: float = CONTAINMENT,
    stride: int = STRIDE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest start (null without
    any), base_labels names them. labels adds those of templates of whose words some block, ``stride`` words twice from
    every ``stride``-th word on, holds the share ``containment``; blocks lists these as (block, template, share), and score is
    the largest share, 1 with a phrase, 0 with neither. Labels are distinct, sorted and joined by commas. Words are
    lower-cased in ASCII; null and empty texts have none and no labels. A template of no words, or of more than ``stride`` + 1,
    is an error. Rows that repeat an id are told apart by a hash of their text, equal rows get equal results, null
    ids are ids like others, other columns are not read. An empty table gives an empty table.
    """
    check_columns(docs, id_col, text_col)
    templates = PHRASES + NOTICES if templates is None else templates
    if not 0 < containment <= 1:
        raise ValueError("containment must be above 0 and at most 1")
    for t in templates:
        if not 0 < len(template_words(t)) <= stride + 1:
            raise ValueError(f"a template must have 1 to {stride + 1} words: {t.text!r}")
    vocabulary = sorted({w for t in templates for w in template_words(t)})
    marks = _marks(docs, vocabulary, stride, id_col, text_col)
    counted = marks.select(F.explode(F.flatten("parts")).alias("h")).groupBy("h.x").count()
    often = Counter({r["x"]: r["count"] for r in counted.collect()})  # at most the template words
    index, order, first = _index(docs.sparkSession, templates, often, containment)
    pairs = _joined(marks, index, order, first, stride).where("not phrase or size(places) > 0")
    pairs = pairs.dropDuplicates(["id", "_tie", "block", "template"])  # rows that stand twice in the table
    per_block = pairs.groupBy("id", "_tie").agg(
        F.sum(F.size("places")).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"),
        F.sort_array(F.collect_set("label")).alias("all"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.when(~F.col("phrase"), F.struct("block", "template", "share")))).alias("blocks"),
    )
    found = settle(per_block.withColumnsRenamed({"id": "_id", "_tie": "_t"}), "license-found")
    whole = marks.select("id", "_tie", "n_words").join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")), "left")
    return whole.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("blocks", F.array().cast("array<struct<block:int,template:int,share:double>>")).alias("blocks"),
    )
