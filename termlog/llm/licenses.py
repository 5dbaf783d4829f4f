"""Licence scans by ordered signature rules.

Rules are regular expressions over a text's normalised words (lower case, one space between). Each rule is gated by the
longest literal that its matches must contain: a text without it never meets the rule. Rules come in priority order,
specific before general. A detection inside another's interval gives way to it; of those that partly overlap, the one of
higher priority stands. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slim

WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the contract: phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


#: Over a lower-case text, unnormalised: each way to match a rule of rules() or a phrase of BASE has one of these in it.
GATE = "licen[cs]|cc[^0-9a-z\\x80-\\uffff]|spdx|copyright|rights|permission|redistribution|public|gpl|bsd|proprietary|unauthorized|cc0|as[^0-9a-z]+is|wtfpl|evil|cecill|mpl|epl|eupl|cddl|odbl|freebsd|under[^0-9a-z]|commons|attribution|fdl|cpl|bsl|busl|warranty|endorse"


def longest_literal(pattern: str) -> str:
    """The longest text that each match of a rule's pattern must contain: what is neither optional nor a choice."""
    bare = re.sub(r"\[[^]]*\][?*]?|\\S[+*]?", "\0", pattern)
    last = None
    while bare != last:  # groups from the inside out
        last, bare = bare, re.sub(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[0-9,]+\})?", "\0", bare)
    return max(re.sub(r".[?*]", "\0", bare).split("\0"), key=len).strip()


@dataclass(frozen=True)
class Rule:
    priority: int  # less goes first
    label: str
    pattern: str  # over normalised words; word bounds are added
    confidence: float
    keyword: str = field(default="")  # must stand in the normalised text

    def __post_init__(self):
        object.__setattr__(self, "keyword", self.keyword or longest_literal(self.pattern))


CC = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: (label, ways to write the name, versions): families and the versions they have been published in.
FAMILIES = (
    ("agpl", ("affero general public licen[cs]e", "agpl"), ("1 0", "3 0")),
    ("lgpl", ("lesser general public licen[cs]e", "library general public licen[cs]e", "lgpl"), ("2 0", "2 1", "3 0")),
    ("gpl", ("general public licen[cs]e", "gpl"), ("1 0", "2 0", "3 0")),
    ("gfdl", ("free documentation licen[cs]e", "gfdl", "fdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache (?:software )?licen[cs]e",), ("1 0", "1 1", "2 0")),
    ("mpl", ("mozilla public licen[cs]e", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public licen[cs]e", "epl"), ("1 0", "2 0")),
    ("eupl", ("european union public licen[cs]e", "eupl"), ("1 0", "1 1", "1 2")),
    ("cddl", ("common development and distribution licen[cs]e", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public licen[cs]e", "cpl"), ("1 0",)),
    ("ipl", ("ibm public licen[cs]e",), ("1 0",)),
    ("artistic", ("artistic licen[cs]e",), ("1 0", "2 0")),
    ("osl", ("open software licen[cs]e",), ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", ("academic free licen[cs]e",), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("bsl", ("boost software licen[cs]e", "bsl"), ("1 0",)),
    ("busl", ("business source licen[cs]e", "busl"), ("1 0", "1 1")),
    ("psf", ("python software foundation licen[cs]e", "psf licen[cs]e"), ("2",)),
    ("php", ("php licen[cs]e",), ("3 0", "3 01")),
    ("zpl", ("zope public licen[cs]e",), ("1 1", "2 0", "2 1")),
    ("lppl", ("latex project public licen[cs]e",), ("1 0", "1 2", "1 3")),
    ("ofl", ("(?:sil )?open font licen[cs]e",), ("1 0", "1 1")),
    ("odbl", ("open (?:data commons )?database licen[cs]e", "odbl"), ("1 0",)),
    ("cecill", ("cecill",), ("1 0", "1 1", "2 0", "2 1")),
    ("ms-pl", ("microsoft public licen[cs]e",), ("1 0",)),
    ("apsl", ("apple public source licen[cs]e",), ("1 0", "1 1", "1 2", "2 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution non ?commercial share ?alike"), CC),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"), CC),
    ("cc-by-nc", ("cc by nc", "creative commons attribution non ?commercial"), CC),
    ("cc-by-nd", ("cc by nd", "creative commons attribution no ?deriv(?:ative)?s?"), CC),
    ("cc-by-sa", ("cc by sa", "creative commons attribution share ?alike"), CC),
    ("cc-by", ("cc by", "creative commons attribution"), CC),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
)
#: Families whose names may follow "gnu".
GNU = ("agpl", "lgpl", "gpl", "gfdl")

#: (label, pattern, confidence): notices and addresses without versions.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "(?:the )?mit licen[cs]e", 0.95),
    ("mit", "(?:the )?expat licen[cs]e", 0.95),
    ("mit", "(?:the )?x11 licen[cs]e", 0.95),
    ("mit", "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit", 0.9),
    ("mit", "released under (?:the )?(?:terms of (?:the )?)?mit", 0.9),
    ("mit", "distributed under (?:the )?(?:terms of (?:the )?)?mit", 0.9),
    ("mit", "available under (?:the )?(?:terms of (?:the )?)?mit", 0.9),
    ("mit-0", "mit no attribution", 0.95),
    ("bsd-2", "bsd 2 clause(?: licen[cs]e)?", 0.95),
    ("bsd-2", "2 clause bsd(?: licen[cs]e)?", 0.95),
    ("bsd-2", "simplified bsd(?: licen[cs]e)?", 0.95),
    ("bsd-2", "freebsd(?: licen[cs]e)?", 0.95),
    ("bsd-3", "bsd 3 clause(?: licen[cs]e)?", 0.95),
    ("bsd-3", "3 clause bsd(?: licen[cs]e)?", 0.95),
    ("bsd-3", "new bsd(?: licen[cs]e)?", 0.95),
    ("bsd-3", "modified bsd(?: licen[cs]e)?", 0.95),
    ("bsd-3", "revised bsd(?: licen[cs]e)?", 0.95),
    ("bsd-4", "bsd 4 clause(?: licen[cs]e)?", 0.95),
    ("bsd-4", "4 clause bsd(?: licen[cs]e)?", 0.95),
    ("bsd-4", "original bsd(?: licen[cs]e)?", 0.95),
    ("bsd", "bsd (?:style )?licen[cs]e", 0.85),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("isc", "isc licen[cs]e", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("zlib", "zlib(?: libpng)? licen[cs]e", 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty", 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "(?:the )?unlicen[cs]e", 0.9),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", 1.0),
    ("wtfpl", "wtfpl", 1.0),
    ("public-domain", "in the public domain", 0.8),
    ("public-domain", "into the public domain", 0.8),
    ("public-domain", "to the public domain", 0.8),
    ("public-domain", "dedicated to the public domain", 0.9),
    ("apache", "licen[cs]ed under (?:the )?apache", 0.9),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("all-rights-reserved", "all rights reserved", 0.7),
    ("proprietary", "proprietary and confidential", 0.9),
    ("proprietary", "confidential and proprietary", 0.9),
    ("proprietary", "unauthorized copying (?:of this \\S+ )?(?:\\S+ ){0,6}(?:strictly )?prohibited", 0.9),
    ("proprietary", "unauthorized reproduction (?:of this \\S+ )?(?:\\S+ ){0,6}(?:strictly )?prohibited", 0.9),
    ("proprietary", "unauthorized distribution (?:of this \\S+ )?(?:\\S+ ){0,6}(?:strictly )?prohibited", 0.9),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 0.6),
    ("beerware", "(?:the )?beer ?ware licen[cs]e", 0.95),
    ("openssl", "openssl licen[cs]e", 0.95),
    ("ruby", "ruby licen[cs]e", 0.9),
    ("vim", "vim licen[cs]e", 0.9),
    ("json", "the software shall be used for good not evil", 1.0),
    ("elastic", "elastic licen[cs]e(?: 2 0)?", 0.95),
    ("sspl", "server side public licen[cs]e", 0.95),
    ("mit", "opensource org licenses mit", 0.95),
    ("apache-2.0", "apache org licenses license 2 0", 1.0),
    ("gpl-3.0", "gnu org licenses gpl 3 0", 1.0),
    ("gpl-2.0", "gnu org licenses old licenses gpl 2 0", 1.0),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1", 1.0),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0", 1.0),
    ("agpl-3.0", "gnu org licenses agpl 3 0", 1.0),
    ("mpl-2.0", "mozilla org mpl 2 0", 1.0),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 1.0),
    ("unlicense", "unlicense org", 0.95),
    ("bsd-2", "opensource org licenses bsd 2 clause", 0.95),
    ("bsd-3", "opensource org licenses bsd 3 clause", 0.95),
    ("isc", "opensource org licenses isc", 0.95),
    ("bsl-1.0", "boost org license 1 0", 1.0),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("bsd-3", "neither the name of (?:\\S+ ){1,8}nor the names of its contributors may be used to endorse", 0.95),
    ("cc-by", "creativecommons org licenses by", 0.95),
    ("cc-by-sa", "creativecommons org licenses by sa", 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd", 0.95),
    ("cc-by-nc", "creativecommons org licenses by nc", 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", 0.95),
)


def rules() -> list[Rule]:
    """All rules in priority order: SPDX tags, versions with their scope, bare versions, notices, names, base phrases."""
    tags, scoped, versions, names = [], [], [], []
    for label, written, published in FAMILIES:
        short, gnu = label.replace("-", " "), "(?:gnu )?" if label in GNU else ""
        for v in published:
            tags.append((f"{label}-{v.replace(' ', '.')}", f"spdx licen[cs]e identifier {short} {v}(?: only| or later)?", 1.0))
        for way in written:
            names.append((label, f"{gnu}{way}(?: licen[cs]e)?", 0.85))
            for v in published:
                tag = f"{label}-{v.replace(' ', '.')}"
                number = f"(?:version |v )?v?{v.removesuffix(' 0')}(?: 0)?" if v.endswith(" 0") else f"(?:version |v )?v?{v}"
                versions.append((tag, f"{gnu}{way}(?: licen[cs]e)? {number}", 0.95))
                if label in GNU:
                    scoped.append((f"{tag}-or-later", f"{gnu}{way} {number} or (?:\\S+ ){{0,3}}later", 1.0))
                    scoped.append((f"{tag}-only", f"{gnu}{way} {number} only", 1.0))
    base = [(label, phrase, 0.8) for phrase, label in BASE]
    return [Rule(i, *x) for i, x in enumerate([*tags, *scoped, *versions, *NOTICES, *names, *base])]


def rule_table(spark: SparkSession, own: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.priority, r.label, r.keyword, f"(?<= ){r.pattern}(?= )", r.confidence) for r in own], "priority int, label string, keyword string, pattern string, confidence double")


def standing(found: DataFrame) -> DataFrame:
    """Of detections(key, key2, priority, label, confidence, lo, hi) those that stand.

    First those inside another go (of equal intervals all but the one of highest priority). What is left overlaps in
    runs; within a run detections are taken by priority, then place, and one that overlaps one taken goes."""
    by_text = Window.partitionBy("key", "key2")
    before = by_text.orderBy("lo", F.desc("hi"), "priority").rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("reach", F.max("hi").over(before)).where("reach is null or reach < hi").drop("reach")
    order = by_text.orderBy("lo")
    runs = outer.withColumn("run", F.sum(F.when(F.col("lo") >= F.lag("hi").over(order), 1).otherwise(0)).over(order))
    one = F.struct("priority", "lo", "hi", "label", "confidence")
    grouped = runs.groupBy("key", "key2", "run").agg(F.array_sort(F.collect_list(one)).alias("all"))
    nothing = F.filter("all", lambda x: F.lit(False))
    taken = F.aggregate("all", nothing, lambda held, x: F.when(F.exists(held, lambda y: (y["lo"] < x["hi"]) & (x["lo"] < y["hi"])), held).otherwise(F.concat(held, F.array(x))))
    return grouped.select("key", "key2", F.explode(taken).alias("d")).select("key", "key2", "d.*")


def scan(docs: DataFrame, own: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the confidence of the best detection that stands, or of the base phrases (0.8), or 0. A null or empty text
    has no words and no labels ('' for both); null ids and repeated rows stay; an empty table gives no rows; other
    columns are not read. A text that passes the gate is held as its normalised form and an array of its words, about 60
    bytes a word. Detections are gathered per text only, and only for texts that any keyword lets through.
    """
    spark = docs.sparkSession
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    low = F.lower("text")
    gate = low.rlike(GATE) if own is None else F.lit(True)  # a caller's rules may need other words
    own = rules() if own is None else own
    scratch = Scratch(spark, "licenses")
    n_words = F.size(F.array_remove(F.split("text", WORD_BREAK, -1), "")).cast("bigint")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), F.lit(WORD_BREAK), F.lit(" "))), F.lit(" "))
    counted = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.hash("doc_id", "text").alias("key2"), n_words.alias("n_words"), F.when(gate, norm).alias("norm"))
    normal = scratch.save(counted, "normal")

    words = F.col("words")

    def place(phrase: str):
        first, *rest = phrase.split(" ")

        def at(x, i):
            test = x == first
            for k, w in enumerate(rest, 1):
                test = test & F.coalesce(F.get(words, i + k) == w, F.lit(False))
            return F.when(test, i)

        return at

    gated = normal.where("norm is not null").withColumn("words", F.array_remove(F.split("norm", " ", -1), ""))
    places = [F.array_compact(F.transform(words, place(p))) for p, _ in BASE]
    based = gated.select("key", "key2", *(p.alias(f"p{k}") for k, p in enumerate(places)))
    every = F.concat(*(F.col(f"p{k}") for k in range(len(BASE))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    base = based.select("key", "key2", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), labels.alias("base")).where("n_base > 0").dropDuplicates(["key", "key2"])

    table = rule_table(spark, own)
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in own})))
    met = gated.select("key", "key2", "norm", F.explode(F.filter(keywords, lambda k: F.col("norm").contains(k))).alias("keyword")).join(F.broadcast(table), "keyword")
    # the places of all matches: the matches, and what stands between them, in turn
    matched = F.transform(F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)), lambda x: F.length(x))
    hit = met.withColumn("matched", matched).where(F.size("matched") > 0)
    sized = hit.select("key", "key2", "priority", "label", "confidence", F.transform(F.split("norm", F.col("pattern"), -1), lambda x: F.length(x)).alias("between"), "matched")
    ends = F.aggregate(F.sequence(F.lit(0), F.size("matched") - 1), F.array().cast("array<struct<lo:int,hi:int>>"), lambda a, i: F.concat(a, F.array(F.struct((F.coalesce(F.get(a, i - 1)["hi"], F.lit(0)) + F.get("between", i)).alias("lo"), (F.coalesce(F.get(a, i - 1)["hi"], F.lit(0)) + F.get("between", i) + F.get("matched", i)).alias("hi")))))
    found = sized.select("key", "key2", "priority", "label", "confidence", F.explode_outer(ends).alias("at")).select("key", "key2", "priority", "label", "confidence", "at.lo", "at.hi").distinct()
    labelled = standing(found).groupBy("key", "key2").agg(F.collect_set("label").alias("found"), F.max("confidence").alias("best"))
    out = normal.select("doc_id", "key", "key2", "n_words").join(base, ["key", "key2"], "left").join(labelled, ["key", "key2"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("found", none))), ",").alias("labels"), F.coalesce("best", F.when(F.col("n_base") > 0, 0.8), F.lit(0.0)).alias("score"))
