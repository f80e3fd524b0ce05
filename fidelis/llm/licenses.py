"""License scan by MinHash bands over overlapping text windows; DataFrame functions only.

Texts and license templates become token shingles. A template is represented by all its windows of two lengths: the
longest of ``LENGTHS`` that fits into it, and the longest run of shingles that is left whichever ones a text lacks
(``_run``), so short and cut notices have windows too. A text has windows of the same lengths, cut at neither of its
ends, from every shingle on that some template has, one token apart where they overlap: any other window shares nothing
with a template before its first such shingle. Windows are signed by ``BANDS`` bands of ``ROWS`` minima, and a text
window retrieves a template when a band of theirs is equal. With 12 bands of 2, windows with a Jaccard similarity of 0.6
meet with a probability of 99.5 %, at 0.8 of 99.9995 %; a run that is left meets in any case, so no notice is missed
from which tokens were cut, replaced or put between others. For each template retrieved, the share of its shingles that
the whole text has is taken exactly; from ``containment`` on it is a match.

Only a text's key leaves it with its windows. Texts that retrieve a template are read again to be verified, each
once however many of its windows met. Templates are broadcast where they are counted to have ``MOST_SHINGLES`` at most,
the retrieved pairs up to ``BROADCAST_HITS``; beyond that the same joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm.common import bounded, written
from fidelis.llm.decontam import tokens

SHINGLE, LENGTHS, BANDS, ROWS, MOST_SHINGLES, BROADCAST_HITS = 3, (3, 5, 8, 16, 32), 12, 2, 20_000, 500_000

#: Notices of common licenses (public texts).
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
        " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to"
        " this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}


def _hashed(df: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, h)``: hashes of the token shingles of each text, in their order.

    The tokens are shifted against each other rather than looked up by place: the optimiser may write the tokens' own
    expression where they are used, and inside a lambda it would cut the text again for every token.
    """
    words = tokens(F.col("text"))
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])
    return df.select(*keep, F.transform(shifted, lambda s: F.xxhash64(*[s[f"w{k}"] for k in range(SHINGLE)])).alias("h"))


def _bands(length: Column | int, at: Column) -> Column:
    """The bands of the window of ``length`` shingles of ``h`` from ``at`` on."""
    part = F.slice("h", at + 1, length)

    def least(n: int) -> Column:
        return F.array_min(F.transform(part, lambda x: F.xxhash64(F.lit(n), x)))

    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * ROWS + r) for r in range(ROWS)]).alias("value")) for b in range(BANDS)])


def _run(containment: float) -> Column:
    """The longest run of consecutive shingles that ``h`` keeps, however those that it may lack are spread over it."""
    left = F.ceil(F.size(F.array_distinct("h")) * containment - 1e-9)
    return F.ceil(left / (F.size("h") - left + 1)).cast("int")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = 0.8) -> DataFrame:
    """``(doc_id, license, containment, token)``: a row for each text and license whose template it contains.

    Takes ``docs(doc_id, text)``; other columns are ignored. Of a license's templates the best matched counts, of equal
    matches the first; ``token`` is about where it begins. Null, empty and very short texts match nothing, texts may be
    of any length; rows that repeat, or share a ``doc_id``, give one row per license; a null ``doc_id`` stays. An empty
    table gives no rows, and so do templates of fewer than three tokens.
    """
    spark: SparkSession = docs.sparkSession
    named = [(name, n, text) for name, texts in sorted((templates or TEMPLATES).items()) for n, text in enumerate(texts)]
    held = _hashed(spark.createDataFrame(named, "license string, template int, text string"), ["license", "template"]).filter(F.size("h") > 0)
    known = bounded(held.select(F.explode("h").alias("x")).distinct(), MOST_SHINGLES)
    longest = F.coalesce(*[F.when(F.size("h") >= n - SHINGLE + 1, F.lit(n - SHINGLE + 1)) for n in reversed(LENGTHS)])
    own = held.withColumn("m", F.explode(F.array_distinct(F.array(longest, _run(containment)))))
    sizes = sorted(r["m"] for r in own.select("m").distinct().collect())  # LENGTHS, and the few lengths that runs have
    own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("m"))))
    own = own.select("license", "template", "m", "q", F.inline(_bands(F.col("m"), F.col("q"))))

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    starts = _hashed(keyed, ["key"]).select("key", "h", F.posexplode_outer("h").alias("p", "x")).join(known, "x")
    fitting = F.filter(F.array(*map(F.lit, sizes)), lambda m: F.col("p") + m <= F.size("h"))
    windows = starts.select("key", "h", "p", F.explode(fitting).alias("m"))
    bands = windows.select("key", "m", "p", F.inline(_bands(F.col("m"), F.col("p"))))
    met = bands.join(bounded(own, MOST_SHINGLES * BANDS * 2), ["m", "band", "value"])
    place = F.greatest(F.lit(0), F.col("p") - F.col("q")).cast("long")
    met = met.groupBy("key", "license", "template").agg(F.min(place).alias("token"))
    hits = met.groupBy("key").agg(F.collect_list(F.struct("license", "template", "token")).alias("hits"))  # as many as templates
    hits = bounded(written(hits, "licenses"), BROADCAST_HITS)
    again = _hashed(keyed.join(hits, "key"), ["doc_id", "hits"]).withColumnRenamed("h", "text_h")
    each = again.select("doc_id", "text_h", F.inline("hits")).join(bounded(held, MOST_SHINGLES), ["license", "template"])
    wanted = F.array_distinct("h")
    shared = F.size(F.array_intersect(wanted, "text_h")) / F.size(wanted)
    found = each.select("doc_id", "license", shared.alias("containment"), "token").filter(F.col("containment") >= containment - 1e-9)
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("token")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("token"))
