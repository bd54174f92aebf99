"""Operator 2: licence scans.

Passages of a text that speak of a licence are compared with licence templates by the cosine of sparse TF-IDF vectors of
words and word pairs.  Document frequencies of all words and pairs of passages and templates are counted over all texts
of the table.  Files named like licence files, and long runs of lines in the words of licences, are also compared whole
with whole licence texts; such a match goes before those of notices.  An SPDX header names its licence by identifier; the first known one counts.  A file whose own passages match has that licence; a file named like a licence file, or half of whose text is such a
passage, also licenses its directory.  Files without a licence take that of the nearest ancestor directory that has
one, by joins on directory paths.

A notice that names another version than a licence has does not count for it.  A text under the title of a licence counts
only as a whole: if no whole text is near, or another licence's is as near, it has none, whatever notices it quotes.

Of several licence files of a directory the one with the highest cosine counts, then the first path; of several
passages of a file the highest cosine, then the template's name.  Null and empty texts have no passage.  A null path
is the empty path and inherits from the root only.  Rows that repeat are each reported; a path is returned
as it is.  Columns beside doc_id, path and text are not read.  An empty table gives no rows.  Files are dealt by directory
and a salt, so that a flat corpus is not one task's.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, scratch, written
from .license_texts import TEXTS

THRESHOLD = 0.5
#: Cosine from which a text is a whole licence text, and the fewest words it can have.
WHOLE, LONG = 0.9, 50
#: How much nearer a whole text must be than that of any other licence.
MARGIN = 0.005
#: Words from which a text under the title of a licence is taken for a whole licence text.
TITLED_WORDS = 300
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"

#: Customary notices and opening words of common licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

_CUE = re.compile(r"licen[cs]|copyright|spdx|public domain|permission is hereby|redistribut", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_SPDX = re.compile(r"spdx-license-identifier:([^\n]*)", re.IGNORECASE)
_EXCEPTION = re.compile(r"\bwith\s+[\w.+-]+", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[\w.+-]*[\w+]")
_VERSIONS = re.compile(r"(-only|-or-later|\+)$")
_BY_IDENTIFIER = {name.lower(): name for name in TEMPLATES}
#: Bits of the filter that thins out terms before they are counted; what it lets through is joined exactly.
FILTER_BITS = 1 << 23
#: A term of very many passages is dealt to so many tasks.
SALTS = 16
#: Pairs whose test is remembered by a worker.
REMEMBERED = 500_000


def terms(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


@lru_cache(maxsize=1)
def vocabulary() -> frozenset[str]:
    """The templates' words."""
    return frozenset(t for texts in TEMPLATES.values() for x in texts for t in _WORD.findall(x.lower()))


@lru_cache(maxsize=1)
def whole_vocabulary() -> frozenset[str]:
    """The words of notices and whole texts."""
    return vocabulary() | {t for x in TEXTS.values() for t in _WORD.findall(x.lower())}


@lru_cache(maxsize=1)
def template_terms() -> frozenset[str]:
    return frozenset(t for texts in TEMPLATES.values() for x in [*texts, *TEXTS.values()] for t in terms(x))


_TITLE = re.compile(r"^\W*(?:the |a )?(?!.*\b(?:under|licensed|released|dual)\b)[^\n]{0,60}?\b(?:public |documentation )?licen[cs]e\b\W*(?:,? *version[^\n]*)?$", re.IGNORECASE)
_VERSION = re.compile(r"(?:\bversion |\bversion\s+|\bv\.? ?|(?<=[a-z]) )(\d+(?:\.\d+)?)(?![\w-]|\.\d)", re.IGNORECASE)


def own_title(text: str) -> bool:
    """The first line that says something is the title of a licence, and a long text follows."""
    first = next((line for line in text.split("\n") if line.strip()), "")
    return len(first) < 90 and bool(_TITLE.match(first.strip())) and len(_WORD.findall(text)) >= TITLED_WORDS


def same_version(name: str, text: str) -> bool:
    """The text names the version of the licence ``name``, or none at all; a licence without versions has any."""
    own = re.search(r"-(\d+\.\d+)$", name)
    said = {v.removesuffix(".0") for v in _VERSION.findall(text)}
    return not own or not said or own[1].removesuffix(".0") in said


def titled(name: str, text: str) -> str | None:
    """The licence of a text that is nearest to the whole text of ``name``, where near texts of other licences are not in TEXTS."""
    low = text.lower()
    head = low[:300]
    if name.startswith("GPL") and ("lesser general" in head or "library general" in head) or not same_version(name, head):
        return None
    if name == "GPL-3.0" and "affero" in head:
        return "AGPL-3.0"
    if name == "CC-BY-SA-4.0":
        shared, sold, derived = "sharealike" in low, "noncommercial" not in low, "noderivatives" not in low
        return {(True, True, True): "CC-BY-SA-4.0", (False, False, True): "CC-BY-NC-4.0", (False, True, True): "CC-BY-4.0"}.get((shared, sold, derived))
    return name


def identified(text: str) -> str | None:
    """The template of the first known identifier in the text's SPDX headers; versions and exceptions do not matter."""
    for header in _SPDX.findall(text):
        for name in _IDENTIFIER.findall(_EXCEPTION.sub(" ", header)):
            if found := _BY_IDENTIFIER.get(_VERSIONS.sub("", name.lower())):
                return found
    return None


def _kin(line: str, known: frozenset[str]) -> bool:
    """Most of the line's words are known."""
    words = _WORD.findall(line.lower())
    return bool(words) and 2 * sum(w in known for w in words) > len(words)


def passages(text: str, named: bool = False) -> list[str]:
    """Each line with a cue, each run of lines that starts with one and goes on in the notices' words, each long run that
    goes on in the words of whole texts or without words, and the text itself if its file is named like a licence file."""
    if not _CUE.search(text):
        return [text] if named and text.strip() else []
    if own_title(text):
        return [text]
    out, run, long = [], [], []
    whole = {text: None} if named else {}
    for line in [*text.split("\n"), None]:
        cue = line is not None and _CUE.search(line)
        if cue:
            out.append(line)
        if cue or run and line is not None and _kin(line, vocabulary()):
            run.append(line)
        else:
            if len(run) > 1:
                out.append("\n".join(run))
            run = []
        if cue or long and line is not None and (not _WORD.search(line) or _kin(line, whole_vocabulary())):
            long.append(line)
        else:
            if len(long) > 1 and len(_WORD.findall(joined := "\n".join(long).rstrip())) >= LONG:
                whole[joined] = None
            long = []
    return [*out, *(x for x in whole if x not in out)]


class Weights:
    """Inverse document frequencies over ``n`` texts, from the numbers of texts that hold a term."""

    def __init__(self, n: int, seen: dict[str, int], floor: float):
        self.n, self.seen, self.floor = n, seen, floor

    def vector(self, text: str, seen: dict[str, int]) -> tuple[dict[str, float], float]:
        """TF-IDF of words and word pairs, and its length."""
        own = {t: c * (self.floor + math.log((self.n + 1) / (seen.get(t, 0) + 1)) / math.log(self.n + 2)) for t, c in Counter(terms(text)).items()}
        return own, math.sqrt(sum(v * v for v in own.values()))

    @cached_property
    def templates(self) -> list[tuple[str, int, dict[str, float], float]]:
        return [(name, k, *self.vector(x, self.seen)) for name, texts in sorted(TEMPLATES.items()) for k, x in enumerate(texts)]

    @cached_property
    def texts(self) -> list[tuple[str, dict[str, float], float]]:
        return [(name, *self.vector(x, self.seen)) for name, x in sorted(TEXTS.items())]


def best_match(texts: list[str], seen: dict[str, int], weights: Weights) -> tuple[str | None, float, int]:
    """Template, cosine and length in characters of the best passage at or over the threshold.

    Whole texts go before notices.  The opening of the 2-clause licence also opens the 3-clause one, so it does not count
    beside the latter's own clause."""
    found: list[tuple[bool, float, str, int, int]] = []
    for text in texts:
        if "\n" not in text and _SPDX.search(text):
            found += [(False, 1.0, name, 0, len(text)) for name in [identified(text)] if name]
            continue
        own, length = weights.vector(text, seen)
        cosine = lambda other, norm: sum(v * other[t] for t, v in own.items() if t in other) / (length * norm or 1)  # noqa: B023, E731
        if sum(" " not in t for t in own) >= LONG // 2:
            (near, name), (next_, _) = sorted(((cosine(other, norm), name) for name, other, norm in weights.texts), reverse=True)[:2]
            if near >= WHOLE and near - next_ >= MARGIN and (name := titled(name, text)):
                found.append((True, near, name, 0, len(text)))
        if not own_title(text):
            found += [(False, c, name, k, len(text)) for name, k, other, norm in weights.templates if (c := cosine(other, norm)) >= THRESHOLD and same_version(name, text)]
    if any(name == "BSD-3-Clause" and k == 1 for _, _, name, k, _ in found):
        found = [f for f in found if (f[2], f[3]) != ("BSD-2-Clause", 1)]
    if not found:
        return None, 0.0, 0
    _, c, name, _, chars = min(found, key=lambda f: (not f[0], -round(f[1], 12), f[2], -f[4]))
    return name, round(c, 9), chars  # sums of other orders are ties still


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root '' last."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def document_counts(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n: the number of texts that hold it, of each wanted term and of some others.

    Terms are thinned out by a filter of fixed size before they are counted; a pair passes only if its words do."""
    filled = wanted.groupBy(F.expr(f"crc32(cast(term as binary)) % {FILTER_BITS} div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(crc32(cast(term as binary)) % 64 as int))")).alias("bits")).collect()
    held = np.zeros(FILTER_BITS // 64, "<i8")
    for r in filled:
        held[r["word"]] = r["bits"]
    bits = files.sparkSession.sparkContext.broadcast(held.tobytes())
    arrow = pa.schema([("term", pa.string()), ("n", pa.int64())])
    known: dict = {}

    def count(ids: list, texts: list[str]) -> list:
        field, out = bits.value, Counter()

        def passes(key: str | tuple, term: str) -> bool:
            if key not in known:
                h = zlib.crc32(term.encode()) % FILTER_BITS
                known[key] = bool(field[h >> 3] >> (h & 7) & 1)
            return known[key]

        for text in texts:
            if len(known) > REMEMBERED:
                known.clear()
            words = _WORD.findall(text.lower())
            own = {w for w in set(words) if passes(w, w)}
            out.update(own)
            out.update(p for p in set(zip(words, words[1:], strict=False)) if p[0] in own and p[1] in own and passes(p, f"{p[0]} {p[1]}"))
        return [[t if isinstance(t, str) else " ".join(t) for t in out], list(out.values())]

    counted = map_text(files, count, "term string, n long", arrow)
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def scan(files: DataFrame, idf_floor: float = 1.0) -> DataFrame:
    """files: doc_id, path, text.  Returns doc_id, path, license, cosine, origin (own, inherited or none), licensed_by."""
    spark = files.sparkSession
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("terms", pa.list_(pa.string())), ("passages", pa.list_(pa.string())), ("chars", pa.int64()), ("path", pa.string())])

    named = re.compile(LICENSE_FILE)

    def read(ids: list, packed: list[str]) -> list:
        out = ([], [], [], [], [])
        for p in packed:
            n, _, rest = p.partition(":")
            path, text = rest[: int(n)], rest[int(n) :]
            found = passages(text, bool(named.search(path)))
            out[0].append(uuid.uuid4().hex if found else None)
            out[1].append(sorted({t for x in found for t in terms(x)}))
            out[2].append(found)
            out[3].append(len(text))
            out[4].append(path)
        return [ids, *out]

    path = F.coalesce(F.col("path"), F.lit(""))
    packed = files.select("doc_id", F.concat(F.length(path).cast("string"), F.lit(":"), path, F.coalesce("text", F.lit(""))).alias("text"))
    rows = written(map_text(packed, read, "doc_id long, key string, terms array<string>, passages array<string>, chars long, path string", arrow), scratch(spark, "licence-passages"))
    n = rows.count()
    in_passages = rows.filter("key IS NOT NULL").select("key", F.explode("terms").alias("term"))
    in_templates = spark.createDataFrame([(t,) for t in sorted(template_terms())], "term string")
    wanted = written(in_passages.select("term").union(in_templates).distinct(), scratch(spark, "licence-terms"))
    counts = written(document_counts(files.select("doc_id", "text"), wanted).join(wanted, "term", "left_semi"), scratch(spark, "licence-counts"))
    weights = Weights(n, {r["term"]: r["n"] for r in counts.join(F.broadcast(in_templates), "term").collect()}, idf_floor)  # one row a term of the templates
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = in_passages.withColumn("salt", (F.crc32("key") % SALTS).cast("int"))
    seen = dealt.join(salted, ["term", "salt"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("seen"))
    matched = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("chars", pa.int64()), ("license", pa.string()), ("cosine", pa.float64()), ("length", pa.int64())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, path, chars, found, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, cosine, length = best_match(found, dict(counts or ()), weights)
                if name:
                    out.append((doc_id, path, chars, name, cosine, length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), matched, strict=True)], schema=matched)

    spoken = rows.filter("key IS NOT NULL").join(seen, "key", "left").select("doc_id", "path", "chars", "passages", "seen")
    spoken = spoken.mapInArrow(match, "doc_id long, path string, chars long, license string, cosine double, length long")
    spoken = written(spoken, scratch(spark, "licence-matches"))
    of_directory = (
        spoken.filter(F.col("path").rlike(LICENSE_FILE) | (2 * F.col("length") >= F.col("chars")))
        .groupBy(parent(F.col("path")).alias("at"))
        .agg(F.min(F.struct(-F.col("cosine"), "path", "license")).alias("b"))
        .select("at", F.col("b.license").alias("license"), F.col("b.path").alias("licensed_by"))
    )
    directories = rows.select(parent(F.col("path")).alias("directory")).distinct()
    above = directories.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "at"))
    inherited = above.join(of_directory, "at").groupBy("directory").agg(F.min(F.struct("up", "license", "licensed_by")).alias("near")).select("directory", "near.license", "near.licensed_by")
    own = spoken.select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine")).groupBy("doc_id", "path").agg(F.min(F.struct(-F.col("cosine"), "license")).alias("b"))
    own = own.select("doc_id", "path", F.col("b.license").alias("own"), (-F.col("b.col1")).alias("cosine"))
    files_in = rows.select("doc_id", "path", parent(F.col("path")).alias("directory"), F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    inherited = inherited.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_own = files_in.join(own.withColumnRenamed("doc_id", "_d").withColumnRenamed("path", "_p"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("path") == F.col("_p")), "left").drop("_d", "_p")
    out = with_own.join(inherited, ["directory", "salt"], "left")
    by_own = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "license").alias("license"),
        F.when(by_own, F.col("cosine")).alias("cosine"),
        F.when(by_own, "own").when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(by_own, F.col("path")).otherwise(F.col("licensed_by")).alias("licensed_by"),
    )
