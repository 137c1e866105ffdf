"""License scans by canonical digests.

A text is brought to a canonical form (lower case; copyright lines out;
equivalent spellings made one; anything but letters and digits a single
space) and its SHA-256 is joined to the digests of known license texts. Looked
up are whole documents and, as notices stand on lines of their own, each line.
Column expressions only: nothing is shuffled.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published guidelines for matching licenses count these pairs of spellings as one. Each is written as a rule that
# brings both sides to one form; a rule may go further than its pairs (any -ise becomes -ize), which both texts undergo alike.
#   acknowledgement acknowledgment, analogue analog, analyse analyze, artefact artifact, authorisation authorization, authorised
#   authorized, calibre caliber, cancelled canceled, capitalisations capitalizations, catalogue catalog, categorise categorize, centre
#   center, copyright owner copyright holder, emphasised emphasized, favour favor, favourite favorite, fulfil fulfill, fulfilment
#   fulfillment, initialise initialize, judgement judgment, labelling labeling, labour labor, licence license, maximise maximize,
#   modelled modeled, modelling modeling, non-commercial noncommercial, offence offense, optimise optimize, organisation
#   organization, organise organize, per cent percent, practise practice, programme program, realise realize, recognise recognize,
#   signalling signaling, sub-license sublicense, sub license sublicense, utilisation utilization, whilst while
#: Patterns and what they become, in this order, in lower-case text. Both Java and RE2 read them alike; $1 is the first group.
RULES = (
    (r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$", " "),
    (r"all rights reserved", " "),
    (r"(licen|offen)ce", "$1se"),
    (r"(non|sub)[- ](commercial|license)", "$1$2"),
    (r"copyright owner", "copyright holder"),
    (r"whilst", "while"),
    (r"programme", "program"),
    (r"per cent", "percent"),
    (r"practi[cs]e", "practice"),
    (r"([a-z])[iy][sz](e[ds]?|ing|ations?)", "$1iz$2"),
    (r"(fav|lab|hon|behavi|col)our", "$1or"),
    (r"(cent|calib)re", "$1er"),
    (r"(an|cat)alogue", "$1alog"),
    (r"(judg|acknowledg)ement", "$1ment"),
    (r"(fulfil|cancel|label|model|signal)l(ed|ing|ment)?", "$1$2"),
    (r"art[ei]fact", "artifact"),
    (r"https?://", "https "),
)
#: What is neither letter nor digit is a space; lines stay apart until they have been looked at.
_GAPS, _BREAKS = r"[^\p{L}\p{N}\n]+", r"[ \n]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_NOTICES = (
    ("MIT", "MIT License\n" + _MIT), ("MIT", _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "ISC License\n" + _ISC + _ISC_END), ("ISC", _ISC + _ISC_END), ("0BSD", _ZERO + _ISC_END), ("0BSD", "BSD Zero Clause License\n" + _ZERO + _ISC_END),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)

#: The name of a license, its SPDX identifiers besides, and what notices call it.
NAMES = {
    "MIT": ((), ("the MIT License", "the MIT License (MIT)", "the MIT")),
    "ISC": ((), ("the ISC License",)),
    "0BSD": ((), ("the BSD Zero Clause License", "the Zero-Clause BSD License")),
    "Apache-2.0": ((), ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0")),
    "BSD-2-Clause": ((), ("the BSD 2-Clause License", "the Simplified BSD License")),
    "BSD-3-Clause": ((), ("the BSD 3-Clause License", "the New BSD License")),
    "GPL-2.0": (("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"), ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2")),
    "GPL-3.0": (("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"), ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3")),
    "LGPL-2.1": (("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"), ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1", "the LGPLv2.1")),
    "LGPL-3.0": (("LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+"), ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3", "the LGPLv3")),
    "AGPL-3.0": (("AGPL-3.0-only", "AGPL-3.0-or-later"), ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3", "the AGPLv3")),
    "MPL-2.0": ((), ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0")),
    "BSL-1.0": ((), ("the Boost Software License, Version 1.0",)),
    "Unlicense": ((), ("the Unlicense",)),
    "Zlib": ((), ("the zlib License",)),
    "CC0-1.0": ((), ("CC0 1.0", "CC0 1.0 Universal")),
} | {
    f"CC-{kind}-4.0": ((), (f"CC {kind} 4.0", f"a Creative Commons {name} 4.0 International License", f"the Creative Commons {name} 4.0 International License"))
    for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
}
#: What stands before the name in a notice.
OPENINGS = tuple(f"{who}{how} under {terms}" for who, how in (("", "released"), ("", "licensed"), ("", "distributed"), ("this work is ", "licensed"), ("this software is ", "licensed"), ("this project is ", "licensed"), ("this file is ", "licensed")) for terms in ("", "the terms of "))

_FULL = ("Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSL-1.0", "Unlicense", "Zlib", "CC0-1.0")
#: Where the terms end: what follows is advice on applying them, which copies may leave out.
_END = "END OF TERMS AND CONDITIONS"
_BSD_TITLES = {"BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",)}


def _whole() -> list[tuple[str, str]]:
    """The full texts, each in the forms that its copies have."""
    texts = {k: pkgutil.get_data(__name__, f"license_texts/{k}.txt").decode() for k in _FULL}
    third = texts["BSD-3-Clause"].index("3. Neither")
    texts["BSD-2-Clause"] = texts["BSD-3-Clause"][:third] + texts["BSD-3-Clause"][texts["BSD-3-Clause"].index("THIS SOFTWARE", third) :]
    out = list(texts.items())
    out += [(k, t[: t.index(_END) + len(_END)]) for k, t in texts.items() if _END in t]
    out += [(k, f"{title}\n{texts[k]}") for k, titles in _BSD_TITLES.items() for title in titles]
    # Lists without numbers, as with bullets or dashes.
    out += [(k, t.replace("1. Red", "* Red").replace("2. Red", "* Red").replace("3. Neither", "* Neither")) for k, t in list(out) if k in _BSD_TITLES]
    head = texts["Apache-2.0"].index('Licensed under the Apache License, Version 2.0 (the "License")')
    out.append(("Apache-2.0", texts["Apache-2.0"][head:]))
    return out


def _lines() -> list[tuple[str, str]]:
    """SPDX lines, and openings of notices crossed with names."""
    out = [(k, f"SPDX-License-Identifier: {i}") for k, (more, _) in NAMES.items() for i in (k, *more)]
    out += [(k, f"{opening}{name}") for k, (_, names) in NAMES.items() for name in names for opening in OPENINGS]
    return [*out, ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]


#: (license, a text that is that license or its notice). Texts may share a license, not a digest.
KNOWN = (*_NOTICES, *_whole(), *_lines())

#: Known texts at most.
MOST = 1_000


def spelled(text: Column) -> Column:
    """The canonical text with its lines still apart."""
    out = F.lower(text)
    for pattern, by in RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    return F.regexp_replace(out, F.lit(_GAPS), F.lit(" "))


def joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, F.lit(_BREAKS), F.lit(" ")))


def canonical(text: Column) -> Column:
    return joined(spelled(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row per row: doc_id, text_sha256 (of the canonical text), text_license (of the whole text, or null), line_licenses, n_license_lines.

    line_licenses are the distinct licenses of lines, sorted and comma-joined.
    Null texts count as empty, which is no license. Rows with equal or null
    ids each keep their row; other columns are not read. ``known`` is a fixed
    table of the library of at most MOST texts, so its digests are broadcast
    for whole texts, and a literal map for lines.
    """
    if len(known) > MOST:
        raise ValueError(f"at most {MOST} known texts: their digests are broadcast")
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known), "license string, body string").select(digest(F.col("body")).alias("d"), "license")
    found = table.groupBy("d").agg(F.min("license").alias("license"))
    ours = found.orderBy("d").collect()
    by_digest = F.create_map(*(F.lit(x) for r in ours for x in r))  # as many as ``known``
    text = F.coalesce(F.col("text"), F.lit(""))
    # Rules are applied once, to the whole text: none reaches over a line's end but by a space, and gaps at line ends are trimmed.
    own = docs.select("doc_id", spelled(text).alias("__text"))
    own = own.select("doc_id", F.sha2(joined(F.col("__text")), 256).alias("text_sha256"), F.split("__text", "\n").alias("__lines"))
    own = own.join(F.broadcast(found), F.col("text_sha256") == F.col("d"), "left").withColumnRenamed("license", "text_license")
    # A set of literals is hashed, a map is searched from its start: only hits are looked up in it.
    hits = F.filter(F.transform("__lines", lambda x: F.sha2(F.trim(x), 256)), lambda x: x.isin([r.d for r in ours]))
    lines = F.transform(hits, lambda x: F.element_at(by_digest, x))
    own = own.withColumn("__of", lines)
    return own.select("doc_id", "text_sha256", "text_license", F.array_join(F.array_sort(F.array_distinct("__of")), ",").alias("line_licenses"), F.size("__of").cast("bigint").alias("n_license_lines"))


def scan_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same for DuckDB."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"lower({x})"
        for pattern, by in (*RULES, (r"[^\p{L}\p{N}]+", " ")):
            out = f"regexp_replace({out}, {q(pattern)}, {q(by.replace('$', chr(92)))}, 'g')"
        return f"trim({out})"

    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in known)
    return f"""
    WITH known AS (SELECT sha256({canon('body')}) AS d, min(license) AS license FROM (VALUES {rows}) AS v(license, body) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM lines JOIN known ON sha256({canon('line')}) = d GROUP BY doc_id),
    whole AS (SELECT doc_id, sha256({canon("coalesce(text, '')")}) AS text_sha256 FROM documents)
    SELECT w.doc_id, w.text_sha256, k.license AS text_license, coalesce(h.line_licenses, '') AS line_licenses, coalesce(h.n, 0)::BIGINT AS n_license_lines
    FROM whole w LEFT JOIN known k ON k.d = w.text_sha256 LEFT JOIN hits h USING (doc_id)
    """
