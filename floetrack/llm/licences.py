"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised (A-Z lower-cased, everything but a-z and 0-9 one space)
and looked up in a fixed table of known licence sentences; the identifiers found, in their order, are
matched against rules, each an ordered sequence of identifiers. A sentence wrapped over lines is found across
single newlines; the SQL knows sentences on one line only. All of it happens within a row: no shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences, by identifier.
SENTENCES: dict[str, str] = {
    "arr": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-line2": "Licensed under the MIT License.",
    "mit-head": "The MIT License (MIT)",
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-short": "Licensed under the GNU General Public License v3.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

# Fixed values: (licence, identifiers in the order in which they have to appear).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line2",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-use", "apache-copy", "apache-basis")),
    ("GPL-3.0", ("gpl3-line",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("All-rights-reserved", ("arr",)),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences, and what normalisation turns into a space. ``|`` marks a cut.
CUT, NOISE = r"[.!?:;]+([ \t\r\n]+|$)|\n+", r"[^a-z0-9|]+"


def normalised(sentence: str) -> str:
    """The form under which a sentence without inner ends is looked up."""
    out = "".join(c if c in LOWER or c.isdigit() and c.isascii() else " " for c in sentence.translate(str.maketrans(UPPER, LOWER)))
    return " ".join(out.split())


def known() -> dict[str, str]:
    """Identifier by normalised sentence; of a sentence with inner ends, its longest part stands for it."""
    import re

    out: dict[str, str] = {}
    for name, text in SENTENCES.items():
        parts = [normalised(x) for x in re.sub(CUT, "|", text.translate(str.maketrans(UPPER, LOWER)), flags=re.A).split("|")]
        out.setdefault(max(parts, key=len), name)
    return out


#: As CUT, with blank lines apart from single newlines, which ``~`` marks; in ``_WRAPPED`` lines may be joined.
_HARD, _NOISE = r"[.!?:;]+([ \t\r\n]+|$)|\n([ \t\r]*\n)+", r"[^a-z0-9|~]+"
_WRAPPED = "(?:^|[|~])(" + "|".join(k.replace(" ", "[ ~]") for k in sorted(known(), key=len, reverse=True)) + ")(?=[|~]|$)"


def marked(text: Column) -> Column:
    """A text's normalised lines and sentences, cut by ``~`` at a single newline and ``|`` elsewhere; null for null."""
    low = F.translate(F.translate(text, "|~", "  "), UPPER, LOWER)
    cut = F.regexp_replace(F.regexp_replace(low, _HARD, "|"), r"\n", "~")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, _NOISE, " "), r" ?([|~]) ?", "$1"))


def _longer(ids: tuple[str, ...]) -> list[tuple[str, str]]:
    """What to replace in framed identifiers so that a rule does not end where a longer one goes on."""
    return sorted({(f",{ids[-1]},{x[len(ids)]},", f",{x[len(ids)]},") for _, x in RULES if len(x) > len(ids) and x[: len(ids)] == ids})


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_sentences, sentence_ids and licences (comma-joined); columns of these names are replaced.

    Null and empty texts have no sentences and no licence; a long text is scanned whole; repeated rows
    get equal results; licences come once each, in the order of the rules. Where a longer rule goes on from
    a shorter one's sentences, the longer one has them.
    """
    made = ("n_sentences", "sentence_ids", "licences")
    kept = docs.drop(*made)
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    rows = kept.withColumn("_marked", F.coalesce(marked(F.col(text)), F.lit("")))
    found = F.regexp_extract_all("_marked", F.lit(_WRAPPED), F.lit(1))
    rows = rows.withColumn("sentence_ids", F.array_join(F.transform(found, lambda s: table[F.translate(s, "~", " ")]), ","))
    framed = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))

    def left(ids: tuple[str, ...]) -> Column:
        return functools.reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _longer(ids), framed)

    hits = [F.when(left(ids).rlike("(,.*)?".join(f",{x}" for x in ids) + ","), F.lit(name)) for name, ids in RULES]
    rows = rows.withColumn("licences", F.array_join(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())), ","))
    return rows.withColumn("n_sentences", F.size(F.filter(F.split("_marked", "[|~]"), lambda s: F.trim(s) != "")).cast("long")).select(*kept.columns, *made)


def scan_sql() -> str:
    """The same result in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in known().items()) + "}"
    seen: list[str] = []
    for name, _ in RULES:
        if name not in seen:
            seen.append(name)
    left = lambda ids: functools.reduce(lambda c, pair: f"replace({c}, {quoted(pair[0])}, {quoted(pair[1])})", _longer(ids), "framed")
    hit = lambda name: " OR ".join(f"regexp_matches({left(ids)}, {quoted('(,.*)?'.join(f',{x}' for x in ids) + ',')})" for n, ids in RULES if n == name)
    names = ", ".join(f"CASE WHEN {hit(name)} THEN {quoted(name)} END" for name in seen)
    cut = CUT.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n")
    return f"""
        WITH cut AS (
          SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
              translate(translate(coalesce(text, ''), '|', ' '), '{UPPER}', '{LOWER}'), {quoted(cut)}, '|', 'g'), '{NOISE}', ' ', 'g'),
              ' ?\\| ?', '|', 'g'), '|'), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents),
        ids AS (
          SELECT doc_id, len(parts)::BIGINT AS n_sentences,
                 coalesce(array_to_string(list_filter(list_transform(parts, lambda s: {table}[s]), lambda x: x IS NOT NULL), ','), '') AS sentence_ids FROM cut),
        framed AS (SELECT *, ',' || sentence_ids || ',' AS framed FROM ids)
        SELECT doc_id, n_sentences, sentence_ids,
               coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ','), '') AS licences FROM framed"""
