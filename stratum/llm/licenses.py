"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a shingle is five words. A window is a run
of WINDOW shingles, and windows overlap by half; each of BANDS bands is one minimum hash of a window. A template of
WINDOW shingles or more has the bands of all its windows, at every offset, so that a passage of 1.5 * WINDOW + 4 words
copied without change has a window that agrees in every band; one that shares a share J of its shingles with a template
window agrees in some band with probability 1 - (1 - J) ** BANDS, 0.9997 at 2 / 3. Templates shorter than a window are
retrieved by windows of a single shingle, whose minimum hash is the shingle's: any common shingle agrees.

A retrieved template is a match if the document holds at least PERCENT of its distinct shingles. All of it is one map
stage of DataFrame expressions without a shuffle; the templates are literals of fixed size.

Defined cases: null, empty and short texts match nothing; a document has a row for each template that it matches, repeated
rows repeat theirs; templates of fewer than five words are one shingle of all their words and match only such texts; other
columns are dropped unless keep names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, hidden

SHINGLE, PERCENT = 5, 80
WINDOW, BANDS = 16, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are neither letters nor digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN, -1), lambda x: x != "")


def _shingles(w: Column) -> Column:
    """Hashes of the shingles of a column of words, in order; all words as one if they are fewer than five."""
    n = F.size(w)
    each = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(each, 1, F.greatest(n - SHINGLE + 1, F.lit(1))))


def _mixer(band: int) -> int:
    """An odd-looking constant of each band: its golden-ratio multiple, as a signed long."""
    x = (band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >= 1 << 63 else x


def _bands(h: Column, step: int) -> Column:
    """One key for each band of each full window of h that starts at a multiple of step."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1)), F.lit(step))
    windows = F.transform(F.when(F.size(h) >= WINDOW, starts).otherwise(F.array().cast("array<int>")), lambda s: F.slice(h, s, WINDOW))
    # x ^ constant permutes hashes; its least is a minimum hash, and the constant's number goes into the low bits
    least = lambda x, b: F.array_min(F.transform(x, lambda v: v.bitwiseXOR(F.lit(_mixer(b))))).bitwiseAND(F.lit(-16)) + b
    return F.flatten(F.transform(windows, lambda x: F.array(*[least(x, b) for b in range(BANDS)])))


def _literal(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(kind)


def compiled(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """name, shingles (hashes) and keys of each template."""
    d = spark.createDataFrame(list(templates.items()), "name string, text string").withColumn("w", _words(F.col("text")))
    d = d.withColumn("h", _shingles(F.col("w"))).withColumn("bands", _bands(F.col("h"), 1))
    return [{"name": r["name"], "shingles": sorted(set(r["h"])), "keys": sorted(set(r["bands"] if len(r["h"]) >= WINDOW else r["h"])), "long": len(r["h"]) >= WINDOW} for r in d.select("name", "h", "bands").collect()]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """keep (doc_id, if not given), license, n_shingles (of the template), n_found, containment and at_word (where the first found shingle starts, from 0) of every match."""
    keep = ["doc_id"] if keep is None else keep
    t = compiled(docs.sparkSession, templates)
    w, h, hit, m = hidden([*docs.columns, *keep], "w", "h", "hit", "m")
    short = _literal(sorted({k for x in t if not x["long"] for k in x["keys"]}), "array<bigint>")
    long = _literal(sorted({k for x in t if x["long"] for k in x["keys"]}), "array<bigint>")
    d = docs.select(*[F.col(f"`{c}`") for c in keep], _words(F.col(f"`{text}`")).alias(w))
    d = bound(d, h, _shingles(F.col(w))).drop(w)
    d = bound(d, hit, F.concat(F.array_intersect(F.col(h), short), F.array_intersect(_bands(F.col(h), WINDOW // 2), long))).where(F.size(hit) > 0)
    # retrieved templates, then those that hold
    each = [F.when(F.arrays_overlap(F.col(hit), _literal(x["keys"], "array<bigint>")), F.struct(F.lit(x["name"]).alias("license"), F.lit(len(x["shingles"])).cast("long").alias("n_shingles"), F.array_intersect(F.col(h), _literal(x["shingles"], "array<bigint>")).alias("found"))) for x in t]
    good = F.filter(F.array(*each), lambda x: x.isNotNull() & (100 * F.size(x["found"]) >= percent * x["n_shingles"]))
    d = d.select(*[F.col(f"`{c}`") for c in keep], F.col(h), F.explode(good).alias(m))
    found = F.size(F.col(m)["found"]).cast("long")
    return d.select(*[F.col(f"`{c}`") for c in keep], F.col(m)["license"].alias("license"), F.col(m)["n_shingles"].alias("n_shingles"), found.alias("n_found"), (found / F.col(m)["n_shingles"]).alias("containment"), (F.array_min(F.transform(F.col(m)["found"], lambda x: F.array_position(F.col(h), x))) - 1).alias("at_word"))
