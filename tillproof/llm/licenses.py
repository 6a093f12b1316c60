"""License scans: ordered signatures over normalised words, in DataFrame functions only.

A text becomes its words (lower case, one space between them). Signatures are regular expressions over
them, composed by rule from the ways to name a license and the ways to grant it; each has a keyword
and a priority. Of each text only the signatures whose keyword stands there are looked for; a keyword
is part of every match of its signature, so that loses none. A detection is dropped if one of at least its
priority contains it (of equal spans the higher priority, then the first label, stays). All
of it is one projection: no shuffle, and a text's detections never leave its row.

Edge cases: null, empty and wordless texts have 0 words, null places, empty labels and score 0;
texts of any length are scanned whole; repeated texts get equal rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What isn't part of a word once A-Z are lower-cased; fixed value.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels; fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, keyword, ways to name it): words are separated by one space; V stands for "v", "version" or nothing.
NAMED = [
    ("mit", "mit", "mit|mit x11"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("isc", "internet systems", "internet systems consortium"),
    ("zlib", "zlib", "zlib|zlib libpng"),
    ("bsl-1.0", "boost", "boost software license(?: V1(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "do what the fuck", "do what the fuck you want to public license"),
    ("ofl-1.1", "ofl", "sil ofl(?: 1 1)?|ofl 1 1"),
    ("ofl-1.1", "open font", "sil open font license(?: V1 1)?"),
    ("psf-2.0", "python", "python software foundation license(?: V2)?"),
    ("psf-2.0", "psf", "psf license"),
    ("ruby", "ruby", "ruby license"),
    ("php-3.01", "php", "php license(?: V3(?: 0)?(?: ?1)?)?"),
    ("postgresql", "postgresql", "postgresql license"),
    ("openssl", "openssl", "openssl license"),
    ("ncsa", "ncsa", "ncsa|university of illinois ncsa open source license"),
    ("ms-pl", "microsoft public", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license"),
    ("eupl-1.2", "european union public", "european union public licen[cs]e(?: V1 2)?"),
    ("odbl-1.0", "open database", "open database license(?: V1 0)?"),
    ("mulan-2.0", "mulan", "mulan permissive software license(?: V2)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "public domain", "public domain"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2 clause|two clause)"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3 clause|three clause)"),
    ("bsd-4-clause", "bsd", "(?:original|4 clause|four clause) bsd|bsd (?:4 clause|four clause)"),
    ("bsd", "bsd", "bsd"),
    ("apache-1.0", "apache", "apache (?:software )?license V1 0"),
    ("apache-1.1", "apache", "apache (?:software )?license V1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license V2(?: 0)?|apache 2(?: 0)?|apache2"),
    ("artistic-1.0", "artistic", "artistic license V1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic license V2(?: 0)?"),
]
#: Families with versions: (label, keyword, name, versions).
VERSIONED = [
    ("gpl", "general public", "(?:gnu )?general public license", "1.0 2.0 3.0"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public license", "2.0 2.1 3.0"),
    ("lgpl", "library general", "(?:gnu )?library general public license", "2.0"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero general", "(?:gnu )?affero general public license", "1.0 3.0"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation license", "1.1 1.2 1.3"),
    ("mpl", "mozilla", "mozilla public license", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public license", "1.0 2.0"),
    ("cddl", "common development", "common development and distribution license", "1.0 1.1"),
    ("cpl", "common public", "common public license", "1.0"),
    ("osl", "open software", "open software license", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", "academic free license", "1.2 2.0 2.1 3.0"),
    ("lppl", "latex project", "latex project public license", "1.0 1.2 1.3"),
]
#: Creative Commons: the parts of the name in short and in words.
CC = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
#: Texts of their own: (label, priority, keyword, expression).
TEXTS = [
    ("mit", 4, "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 4, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 4, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", 4, "provided as is", "this software is provided as is without any express or implied warranty"),
    ("unlicense", 4, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("gpl", 3, "free software", "this program is free software you can redistribute it and or modify it"),
    ("all-rights-reserved", 2, "rights reserved", "all rights reserved"),
    ("proprietary", 2, "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("copyright", 1, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyleft", 1, "copyleft", "copyleft"),
]
GRANT = "(?:(?:this|the) (?:work|software|program|project|file|code|library|package|document|content|text)(?: and its documentation)? (?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|provided|made available|covered|redistributable|shared) (?:under|by|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: either)?(?: the)? "
#: Weight of a priority in the score.
WEIGHT = {1: 0.4, 2: 0.6, 3: 0.9, 4: 1.0}


@functools.lru_cache(1)
def signatures() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression), some hundreds: every name in every way of mentioning it."""
    names = [(label, keyword, name.replace("V", "(?:version |v ?)?")) for label, keyword, name in NAMED]
    for label, keyword, name, versions in VERSIONED:
        names.append((label, keyword, name))
        for v in versions.split():
            major, minor = v.split(".")
            number = f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"
            names.append((f"{label}-{v}", keyword, f"{name}(?: as published by the free software foundation)?(?: either)? ?(?:version |v ?)?{number}"))
    for kind, v in itertools.product(CC_KINDS, ("", "1.0", "2.0", "2.5", "3.0", "4.0")):
        parts = kind.split("-")
        number = f" (?:v ?)?{v.replace('.', ' ')}" if v else ""
        label = f"cc-{kind}" + f"-{v}" * bool(v)
        names.append((label, "cc by", "cc " + " ".join(parts) + number))
        names.append((label, "creative commons", "creative commons " + " ".join(CC[p] for p in parts) + number.replace(" (?:v", " (?:international |unported |license |version |v")))
    out = list(TEXTS)
    for label, keyword, name in names:
        out.append((label, 3, keyword, f"{GRANT}(?:{name})(?: licen[cs]e)?"))
        out.append((label, 1, keyword, f"(?:{name}) licen[cs]e" if "licen" not in name and keyword not in ("cc by", "creative commons", "cc0", "wtfpl", "unlicense", "public domain", "gpl", "lgpl", "agpl") else f"(?:{name})"))
    spdx = {(label, keyword) for label, keyword, _ in names if label[-1].isdigit() or label in ("mit", "isc", "zlib", "ncsa", "x11", "unlicense")}
    for label in sorted({label for label, _ in spdx}):
        words = label.replace("-", " ").replace(".", " ")
        out.append((label, 4, "spdx", f"spdx license identifier {words}(?: only| or later)?"))
    return [(label, priority, keyword, f"(?<![^ ])(?:{expression})(?![^ ])") for label, priority, keyword, expression in out]


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def places(words: Column, expression: Column, label: Column, priority: Column) -> Column:
    """Every match as (start, -end, -priority, label), in word numbers; end is after the last word."""
    kind = "array<struct<start:int,stop:int,rank:int,label:string>>"
    state = f"struct<at:int,found:{kind}>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")).cast(state)
    cut = F.struct(F.split(words, expression, -1).alias("piece"), F.regexp_extract_all(words, expression, F.lit(0)).alias("hit"))

    def fold(c: Column) -> Column:
        steps = F.transform(F.arrays_zip(F.transform(c["hit"], spaces).alias("inside"), F.transform(F.slice(c["piece"], 1, F.size(c["hit"])), spaces).alias("before")), lambda x: x)

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["before"]
            one = F.struct(first.alias("start"), (-(first + x["inside"] + 1)).alias("stop"), (-priority).alias("rank"), label.alias("label"))
            return F.struct((first + x["inside"]).alias("at"), F.concat(acc["found"], F.array(one)).alias("found")).cast(state)

        return F.aggregate(steps, start, step)["found"]

    return F.get(F.transform(F.array(cut), fold), F.lit(0))


def resolved(found: Column) -> Column:
    """Labels and best priority of the detections that no other one suppresses; found is sorted."""
    kind = "struct<m1:int,m2:int,m3:int,m4:int,labels:array<string>,best:int,kept:int>"
    start = F.struct(*(F.lit(0).alias(f"m{p}") for p in (1, 2, 3, 4)), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).alias("kept")).cast(kind)

    def step(acc: Column, d: Column) -> Column:
        stop, priority = -d["stop"], -d["rank"]
        over = F.element_at(F.array(acc["m1"], acc["m2"], acc["m3"], acc["m4"]), priority)
        free = over < stop
        ends = [F.when(priority >= p, F.greatest(acc[f"m{p}"], stop)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3, 4)]
        return F.struct(
            *ends,
            F.when(free, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(free, F.greatest(acc["best"], priority)).otherwise(acc["best"]).alias("best"),
            (acc["kept"] + free.cast("int")).alias("kept"),
        ).cast(kind)

    return F.aggregate(found, start, step)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and n_kept of every text."""
    lower = docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("_lower"))
    normal = lower.select(key, F.trim(F.regexp_replace("_lower", NOT_WORD, " ")).alias("_w"))
    w = F.col("_w")
    base = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(f"(?<![^ ]){phrase}(?![^ ])").alias("expression")) for phrase, label in BASE))
    found = F.flatten(F.transform(F.filter(base, lambda s: F.regexp_like(w, s["expression"])), lambda s: places(w, s["expression"], s["label"], F.lit(1))))
    of: dict[str, list[Column]] = {}
    for a, p, k, x in signatures():
        of.setdefault(k, []).append(F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.lit(x).alias("expression")))
    table = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("own")) for k, own in of.items()))
    near = F.flatten(F.transform(F.filter(table, lambda k: F.contains(w, k["keyword"])), lambda k: k["own"]))
    hits = F.filter(near, lambda s: F.regexp_like(w, s["expression"]))
    own = F.array_sort(F.flatten(F.transform(hits, lambda s: places(w, s["expression"], s["label"], s["priority"]))))
    looked = normal.select(
        key,
        F.when(w == "", 0).otherwise(spaces(w) + 1).cast("long").alias("n_words"),
        F.when(w.contains("licen"), found).alias("_base"),
        own.alias("_own"),
    ).withColumn("_kept", F.when(F.size("_own") > 0, resolved(F.col("_own"))))
    labels = F.array_sort(F.array_distinct(F.coalesce(F.transform("_base", lambda d: d["label"]), F.array().cast("array<string>"))))
    weight = F.create_map(*itertools.chain.from_iterable((F.lit(p), F.lit(x)) for p, x in WEIGHT.items()))
    return looked.withColumn("_labels", labels).select(
        key,
        "n_words",
        F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join("_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_labels", F.coalesce(F.col("_kept.labels"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce(weight[F.col("_kept.best")], F.lit(0.0)), F.when(F.size("_labels") > 0, 0.4).otherwise(0.0)).alias("score"),
        F.coalesce("_kept.kept", F.lit(0)).cast("long").alias("n_kept"),
    )
