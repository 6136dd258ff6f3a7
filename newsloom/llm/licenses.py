"""License scans: a positional index of template words. A file's licence words, rarest first, are looked up in the postings; places of
a second rare word at the same relative position confirm a start; the mandatory key phrase and the rest of the template are verified there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, ascii_lower, read_table

#: Base phrases and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices of the index: label, words of the notice, key phrase that must stand in it (fixed values).
TEMPLATES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "affero general public license along"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "apache license 2 0", "apache license 2 0"),
    ("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    ("bsd", "bsd license", "bsd license"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc0", "creative commons zero public domain dedication", "public domain dedication"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("cc0", "spdx license identifier cc0", "spdx license identifier cc0"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute"),
    ("isc", "isc license", "isc license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "mit license", "mit license"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "will the authors be held liable"),
)
#: Standard headers and whole licence texts: label, words, key phrase that tells the licence and its version (fixed values).
_GNU = "{what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version"
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
)
TEXTS = (
    ("agpl-3.0", _GNU.format(what="this program", kind="affero ", version="3"), "affero general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", "affero general public license version 3 19 november 2007"),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
     "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
     "governing permissions and limitations under the license", "licensed under the apache license version 2 0"),
    ("bsd-2-clause", _BSD + " " + _BSD_END, "materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("gpl-2.0", _GNU.format(what="this program", kind="", version="2"), "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", "general public license version 2 june 1991"),
    ("gpl-3.0", _GNU.format(what="this program", kind="", version="3"), "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "general public license version 3 29 june 2007"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is "
     "provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "this permission notice appear in all copies"),
    ("lgpl-2.1", _GNU.format(what="this library", kind="lesser ", version="2 1"), "lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", _GNU.format(what="this library", kind="lesser ", version="3"), "lesser general public license as published by the free software foundation either version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to "
     "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the software " + _AS_IS, "merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
     "commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software "
     "for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
)
#: A template of n words counts n / (n + DOUBT): a mention in two words is a weak sign, a whole text a sure one.
DOUBT = 4
#: Share of a template's words that must stand near their places.
LEAST = 0.6
#: Words that may have been put into a notice, or left out, before a word's place shifts out of reach.
SLACK = 3


def _vocabulary() -> list[str]:
    return sorted({w for _, text, _ in (*TEMPLATES, *TEXTS) for w in text.split()} | {w for p, _ in PHRASES for w in p.split()})


def weight(n: int) -> float:
    """What a template or phrase of n words counts."""
    return n / (n + DOUBT)


def license_words(text: Column) -> Column:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_index(df: DataFrame, n_docs: int) -> DataFrame:
    """One row: the postings as a map from a word to the templates that it is the rarest word of the key phrase of. df: rows (w, df), the
    document frequencies of the licence words; they and the index are as large as TEMPLATES and TEXTS, whatever the corpus. A posting holds
    the word's place q in its template and the second rarest word of the key phrase with its own (rare2, q2)."""
    spark = df.sparkSession
    rows = []
    for k, (label, text, key) in enumerate((*TEMPLATES, *TEXTS)):
        ws, ks = text.split(), key.split()
        at = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
        rows += [(k, label, ws, ks, at, w, at + ks.index(w)) for w in dict.fromkeys(ks)]
    words = spark.createDataFrame(rows, "k int, label string, ws array<string>, ks array<string>, key_at int, w string, q int")
    weighed = words.join(F.broadcast(df), "w", "left").withColumn("idf", F.log((F.lit(float(n_docs)) + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("cost"), F.col("w").alias("w"), F.col("q").alias("q"))))
    per = weighed.groupBy("k").agg(F.first("label").alias("label"), F.first("ws").alias("ws"), F.first("ks").alias("ks"), F.first("key_at").alias("key_at"), ranked.alias("r"))
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    posting = F.struct("k", "label", "ws", "ks", "key_at", one["q"].alias("q"), two["w"].alias("rare2"), two["q"].alias("q2"))
    per = per.select(one["w"].alias("w"), one["cost"].alias("cost"), posting.alias("p")).groupBy("w").agg(F.min("cost").alias("cost"), F.array_sort(F.collect_list("p")).alias("ps"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("cost", "ps")))).alias("index"))


def _places(ws: Column, phrase: list[str]) -> Column:
    """0-based starts of the phrase in ws, which appears elsewhere in the plan too and is therefore computed once."""

    def stands(k: int):
        return lambda i: F.get(ws, i + k) == phrase[k]

    starts = F.sequence(F.lit(0), F.size(ws) - len(phrase))
    for k in range(len(phrase)):
        starts = F.filter(starts, stands(k))
    holds = F.size(ws) >= len(phrase)
    for w in phrase:
        holds = holds & F.array_contains("_nl_held", w)
    return F.when(holds, starts).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, *, keep: list[str], least: float = LEAST) -> DataFrame:
    """The columns `keep` of every row of docs, and _nl_n_words, _nl_places (starts of base phrases, ascending), _nl_base and
    _nl_labels (sorted distinct labels) and _nl_score (the best share of a template's words in their places, or 1 of a base phrase,
    times the weight of its length, DOUBT; 0 without any).

    Every row is scanned in place, without a shuffle; only the document frequencies of the fixed licence vocabulary are
    aggregated first. Null and empty texts have no words, labels or places. Repeated rows have equal results. An empty table
    gives none. Very long texts are scanned whole, at every place. Other columns are only carried; names with the prefix _nl_ are
    reserved.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    vocabulary = F.array(*map(F.lit, _vocabulary()))
    held = docs.select(F.array_intersect(license_words(F.col("text")), vocabulary).alias("_nl_held"))
    df = held.select(F.explode("_nl_held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    index = scratch.keep(template_index(df, docs.select(F.lit(1)).count()), "index").scalar()

    out = docs.select(*[docs[c] for c in keep], docs["text"].alias("_nl_text")).withColumn("_nl_ws", license_words(F.col("_nl_text"))).drop("_nl_text")
    out = out.withColumn("_nl_held", F.array_intersect("_nl_ws", vocabulary)).withColumn("_nl_n_words", F.size("_nl_ws").cast("long"))
    for k, (phrase, _) in enumerate(PHRASES):
        out = out.withColumn(f"_nl_p{k}", _places(F.col("_nl_ws"), phrase.split()))
    # The file's licence words that have postings, rarest first; of their templates, those whose key words the file holds.
    out = out.withColumn("_nl_index", index)
    looked = F.filter(F.transform("_nl_held", lambda w: F.struct(F.try_element_at("_nl_index", w).alias("e"), w.alias("w"))), lambda x: x["e"].isNotNull())
    looked = F.array_sort(F.transform(looked, lambda x: F.struct(x["e"]["cost"].alias("cost"), x["w"].alias("w"), x["e"]["ps"].alias("ps"))))
    out = out.withColumn("_nl_looked", F.when(F.size("_nl_held") >= 2, looked)).drop("_nl_index")
    near = F.flatten(F.transform("_nl_looked", lambda x: F.transform(F.filter(x["ps"], lambda p: F.forall(p["ks"], lambda w: F.array_contains("_nl_held", w))), lambda p: F.struct(x["w"].alias("w"), p.alias("p")))))
    out = out.withColumn("_nl_near", near).drop("_nl_looked")
    # Places of a posting's word give starts; those with the second rare word at its relative position go on, and the key phrase is
    # verified there. The template's other words may stand up to SLACK places off.
    window = lambda at, n: F.slice("_nl_ws", F.greatest(at - SLACK, F.lit(0)) + 1, F.least(at, F.lit(SLACK)) + n + SLACK)
    starts = lambda x: F.filter(F.transform("_nl_ws", lambda w, i: F.when(w == x["w"], i - x["p"]["q"])), lambda s: s.isNotNull())
    crossed = lambda x: F.filter(starts(x), lambda s: (s + x["p"]["key_at"] >= 0) & F.coalesce(F.get("_nl_ws", s + x["p"]["q2"]) == x["p"]["rare2"], F.lit(False)))
    out = out.withColumn("_nl_near", F.filter(F.transform("_nl_near", lambda x: F.struct(x["p"].alias("p"), crossed(x).alias("starts"))), lambda x: F.size(x["starts"]) > 0))
    keyed = lambda p, s: F.slice("_nl_ws", s + p["key_at"] + 1, F.size(p["ks"])) == p["ks"]
    held = lambda p, s: F.filter(F.transform(p["ws"], lambda w, q: (s + q + SLACK >= 0) & F.array_contains(window(F.greatest(s + q, F.lit(0)), 1), w)), lambda x: x)
    best = lambda x: F.array_max(F.transform(F.filter(x["starts"], lambda s: keyed(x["p"], s)), lambda s: F.size(held(x["p"], s)) / F.size(x["p"]["ws"])))
    out = out.withColumn("_nl_found", F.filter(F.transform("_nl_near", lambda x: F.struct(x["p"]["label"].alias("label"), best(x).alias("share"), F.size(x["p"]["ws"]).alias("n"))), lambda x: x["share"] >= least))
    base = F.filter(F.array(*[F.when(F.size(f"_nl_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    out = out.withColumn("_nl_places", F.array_sort(F.concat(*[F.col(f"_nl_p{k}") for k in range(len(PHRASES))]))).withColumn("_nl_base", F.array_sort(base))
    found = F.coalesce(F.transform("_nl_found", lambda x: x["label"]), F.array().cast("array<string>"))
    out = out.withColumn("_nl_labels", F.array_sort(F.array_distinct(F.concat("_nl_base", found))))
    phrased = [F.when(F.size(f"_nl_p{k}") > 0, weight(len(p.split()))).otherwise(0.0) for k, (p, _) in enumerate(PHRASES)]
    known = F.array_max(F.transform("_nl_found", lambda x: x["share"] * x["n"] / (x["n"] + DOUBT)))
    score = F.greatest(F.coalesce(known, F.lit(0.0)), *phrased)
    return out.withColumn("_nl_score", score).select(*keep, "_nl_n_words", "_nl_places", "_nl_base", "_nl_labels", "_nl_score")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, places, labels and score of scan_licenses() for every row of documents."""
    out = scan_licenses(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    places = F.col("_nl_places")
    return out.select(
        "doc_id",
        F.col("_nl_n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.get(places, F.lit(0)).cast("long").alias("first_word"),
        F.get(places, F.size(places) - 1).cast("long").alias("last_word"),
        F.array_join("_nl_base", ",").alias("base_labels"),
        F.array_join("_nl_labels", ",").alias("labels"),
        F.col("_nl_score").alias("score"),
    )
