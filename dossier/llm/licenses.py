"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

DataFrame functions only, and no shuffle: every unit of a document (each line, each block of lines
without a blank one between, and the whole text) meets the templates inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import bound
from dossier.llm.license_texts import TEXTS

ALIKE, LONG = 0.8, 500

# How a licence is named and declared in one line.
_LEADS = tuple(f"{subject}{verb} under" for subject in ("", "This project is ", "This work is ", "This software is ") for verb in ("Licensed", "Released", "Distributed"))
_NAMES = (
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"),
    ("GPL-3.0", "the GNU General Public License, version 3"), ("GPL-3.0", "the GNU GPL v3"), ("GPL-3.0", "the GPL-3.0 License"),
    ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-2.0", "the GNU GPL v2"), ("GPL-2.0", "the GPL-2.0 License"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD", "the BSD License"), ("ISC", "the ISC License"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
# Notices by which public licences are declared, and the licences' own texts.
TEMPLATES = (
    *((name, f"{lead} {title}.") for name, title in _NAMES for lead in _LEADS),
    *TEXTS,
    *((name, f"This {what} {_GNU.format(title, version)}") for what in ("program", "library") for name, title, version in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
    )),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a lone word gives none."""
    pair = lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), pair)),
    )


def plain_bigrams(text: str) -> list[str]:
    """The same for a template, at plan time."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def units_of(text: Column) -> Column:
    """Each line, each block of lines without a blank one between, and the whole text; doubles once."""
    lines, blocks = F.split(text, "\\r?\\n|\\r"), F.split(text, "(?:\\r?\\n|\\r)[ \\t]*(?:\\r?\\n|\\r)[ \\t\\r\\n]*")
    return F.array_distinct(F.concat(lines, blocks, F.array(text)))


def best_match(unit: Column, templates: list[tuple[str, list[str]]], alike: float) -> Column:
    """Struct (dice, license) of the nearest template, null below ``alike``.

    |A| and |B| bigrams can only reach ``alike`` if alike/(2-alike) <= |A|/|B| <= (2-alike)/alike, so the number of words, which
    bounds |A| from above, and then |A| itself rule out templates before any set is compared. As many of the unit's own
    bigrams must be ones of the templates at all; a hash set of those of the short templates tells it for units that no
    long one (``LONG`` bigrams) can meet.
    """
    ratio = alike / (2 - alike) - 1e-9  # bounds are met by a hair, never missed by rounding
    least = ratio * min((len(b) for _, b in templates), default=1)
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"struct({quoted(name)} AS license, {len(b)} AS n, split({quoted('|'.join(b))}, '[|]') AS grams)" for name, b in templates]
    table = F.expr(f"array({', '.join(rows)})")  # one expression: a call per template and bigram would take seconds
    short = sorted({g for _, b in templates if len(b) < LONG for g in b})

    def against(pair: Column) -> Column:
        n, grams = pair["n"], pair["grams"]
        near = F.filter(table, lambda t: (n >= ratio * t["n"]) & (n <= t["n"] / ratio))
        dice = lambda t: (2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("dice")
        scored = F.filter(F.transform(near, lambda t: F.struct(dice(t), t["license"].alias("license"))), lambda s: s["dice"] >= alike)
        best = F.array_max(F.transform(scored, lambda s: s["dice"]))
        return F.get(F.array_sort(F.filter(scored, lambda s: s["dice"] == best)), F.lit(0))

    def known(grams: Column) -> Column:
        own = F.when(F.size(grams) < ratio * LONG, F.filter(grams, lambda g: g.isin(short))).otherwise(grams)
        pair = F.struct(F.size(grams).alias("n"), own.alias("grams"))
        return F.get(F.transform(F.filter(F.array(pair), lambda p: F.size(p["grams"]) >= ratio * p["n"]), against), F.lit(0))

    def sized(words: Column) -> Column:
        return F.when(F.size(words) - 1 >= least, F.get(F.transform(F.array(bigrams(words)), known), F.lit(0)))

    return F.get(F.transform(F.array(words_of(unit)), sized), F.lit(0))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, alike: float = ALIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, dice, n_matches, licenses`` for every row.

    ``license`` is that of the nearest unit (ties: first by name), ``licenses`` all that were found,
    ``n_matches`` the number of distinct units that matched. Null and empty texts, texts without a match and an empty
    template list give null, null, 0 and no licences. Templates are a small table of the plan.
    """
    known = [(name, plain_bigrams(text)) for name, text in templates]
    known = [(name, b) for name, b in known if b]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_llm_text"))
    if not known:
        return rows.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.lit(0).alias("n_matches"), F.array().cast("array<string>").alias("licenses"))
    found = F.filter(F.transform(units_of(F.col("_llm_text")), lambda u: best_match(u, known, alike)), lambda m: m.isNotNull())

    def report(hits: Column) -> Column:
        top = F.array_max(F.transform(hits, lambda h: h["dice"]))
        names = F.array_sort(F.transform(F.filter(hits, lambda h: h["dice"] == top), lambda h: h["license"]))
        return F.struct(
            F.get(names, F.lit(0)).alias("license"), top.alias("dice"), F.size(hits).alias("n_matches"),
            F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["license"]))).alias("licenses"),
        )

    return rows.select("doc_id", bound(found, report).alias("_llm_hit")).select("doc_id", "_llm_hit.*")
