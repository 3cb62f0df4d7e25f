"""License scans by sentence rules, DataFrame functions only.

A text is cut into sentences, each sentence is normalised (lower case, runs of other characters than a-z and 0-9 become
one space), known licence sentences get their identifier and keep their position, and the sequence of identifiers is
matched against ordered rules. A rule's sentences must follow one another: between two neighbours at most GAP unknown
sentences may stand (list numbers and addresses are such). Rules of several sentences come first, in their order, and
what one has matched no later one sees; what is left is looked up sentence by sentence.

Sentences are cut in two ways, as licence texts come both as one sentence a line and as hard-wrapped paragraphs: "line"
ends sentences at line feeds too, "wrapped" only at punctuation and blank lines. A rule holds if it matches either.

Everything is row-local, so there is no shuffle and nothing to skew. Null and empty texts give no sentences and no
licences; repeated rows give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Unknown sentences that may stand between two neighbours of a rule.
GAP = 2

#: Sentences of public licence texts and notices, as they read, by identifier.
SENTENCES: dict[str, str] = {
    "MITgrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MITnotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MITwarranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MITliability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MITname": "Released under the MIT License.",
    "MITlicensed": "Licensed under the MIT License.",
    "MITwork": "This work is licensed under the MIT License.",
    "ISCgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSDgrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSDsource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSDbinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSDendorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDendorseorg": "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDendorseuniversity": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDendorseauthor": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDname": "Released under the BSD License.",
    "Apache2name": "Licensed under the Apache License, Version 2.0.",
    "Apache2header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Apache2comply": "you may not use this file except in compliance with the License.",
    "Apache2obtain": "You may obtain a copy of the License at",
    "Apache2unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache2obtainat": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache2see": "See the License for the specific language governing permissions and limitations under the License.",
    "GPLwork3": "This work is licensed under the GNU General Public License, version 3.",
    "GPLwork2": "This work is licensed under the GNU General Public License, version 2.",
    "GPLfree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPLfree2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPLhope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPLsee": "See the GNU General Public License for more details.",
    "LGPLwork3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPLwork3": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPLform": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPLcopy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache2licensemeans": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "Apache2licensormeans": "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "GPL3is": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "GPL3designed": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "GPL2designed": "The licenses for most software are designed to take away your freedom to share and change it.",
    "AGPL3is": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "LGPL3version": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "LGPL2applies": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "MPLcontributor": "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "MPLversion": "\"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
    "CC0": "Licensed under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Rules in their order; each is a licence and the identifiers that must follow one another.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MITgrant", "MITnotice", "MITwarranty", "MITliability")),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorseorg")),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorseuniversity")),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorseauthor")),
    ("Apache-2.0", ("Apache2header", "Apache2comply", "Apache2obtain", "Apache2unless", "Apache2see")),
    ("Apache-2.0", ("Apache2header", "Apache2comply", "Apache2obtainat", "Apache2unless", "Apache2see")),
    ("Apache-2.0", ("Apache2header", "Apache2comply", "Apache2unless", "Apache2see")),
    ("Apache-2.0", ("Apache2header", "Apache2comply")),
    ("Apache-2.0", ("Apache2licensemeans", "Apache2licensormeans")),
    ("GPL-3.0-or-later", ("GPLfree", "GPLhope", "GPLsee")),
    ("GPL-2.0-or-later", ("GPLfree2", "GPLhope", "GPLsee")),
    ("GPL-3.0", ("GPL3is", "GPL3designed")),
    ("BSD-2-Clause", ("BSDgrant", "BSDsource", "BSDbinary")),
    ("MPL-2.0", ("MPLform", "MPLcopy")),
    ("MPL-2.0", ("MPLcontributor", "MPLversion")),
    ("GPL-3.0-or-later", ("GPLfree",)),
    ("GPL-2.0-or-later", ("GPLfree2",)),
    ("AGPL-3.0", ("AGPL3is",)),
    ("LGPL-3.0", ("LGPL3version",)),
    ("LGPL-2.1", ("LGPL2applies",)),
    ("GPL-2.0", ("GPL2designed",)),
    ("ISC", ("ISCgrant",)),
    ("MIT", ("MITname",)),
    ("MIT", ("MITlicensed",)),
    ("MIT", ("MITwork",)),
    ("BSD", ("BSDname",)),
    ("Apache-2.0", ("Apache2name",)),
    ("Apache-2.0", ("Apache2header",)),
    ("GPL-3.0", ("GPLwork3",)),
    ("GPL-2.0", ("GPLwork2",)),
    ("LGPL-3.0", ("LGPLwork3",)),
    ("AGPL-3.0", ("AGPLwork3",)),
    ("MPL-2.0", ("MPLform",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("Unlicense",)),
]

#: Identifiers that a one-line notice may name, and the licence that each means here.
SPDX = {
    **{x: x for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", "0BSD", "Zlib", "EPL-2.0", "BSL-1.0")},
    **{f"{name}-{how}": f"{name}-or-later" if how == "or-later" else name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for how in ("only", "or-later")},
}
#: Creative Commons licences in short and long form, by version.
CC_KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _name, _licence in SPDX.items():
    SENTENCES[f"SPDX_{_name}"] = f"SPDX-License-Identifier: {_name}"
    RULES.append((_licence, (f"SPDX_{_name}",)))
for _kind, _words in CC_KINDS.items():
    for _version, _form in CC_VERSIONS.items():
        SENTENCES[f"CC_{_kind}_{_version}"] = f"Licensed under CC {_kind} {_version}."
        SENTENCES[f"CCwork_{_kind}_{_version}"] = f"This work is licensed under a Creative Commons {_words} {_version} {_form} License."
        RULES += [(f"CC-{_kind}-{_version}", (f"{_x}_{_kind}_{_version}",)) for _x in ("CC", "CCwork")]

CUTS = {"line": r"[\r\n]+|[.!?;:]+[\r\n\t ]+", "wrapped": r"[\r\n]+[\t ]*[\r\n]+|[.!?;:]+[\r\n\t ]+"}
OTHER = "[^a-z0-9]+"


def pieces(sentence: str) -> list[str]:
    """The normalised pieces into which a known sentence is cut itself."""
    cut = (" ".join(re.sub(OTHER, " ", x.lower()).split()) for x in re.split(CUTS["wrapped"], sentence))
    return [x for x in cut if x]


def known(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifier by normalised piece: the sentence's, with a number from its second piece on."""
    out: dict[str, str] = {}
    for name, sentence in sentences.items():
        for k, piece in enumerate(pieces(sentence)):
            out.setdefault(piece, f"{name}{k or ''}")
    return out


def expanded(rules: list[tuple[str, tuple[str, ...]]], sentences: dict[str, str]) -> list[tuple[str, list[str]]]:
    """The rules over pieces."""
    table = known(sentences)
    return [(name, [table[p] for s in sequence for p in pieces(sentences[s])]) for name, sequence in rules]


def split_rules(rules: list[tuple[str, list[str]]]) -> tuple[list[tuple[str, list[str]]], dict[str, str]]:
    """Rules of several pieces in their order, and the licence of each piece that is a rule of its own."""
    single: dict[str, str] = {}
    for name, sequence in rules:
        if len(sequence) == 1:
            single.setdefault(sequence[0], name)
    return [x for x in rules if len(x[1]) > 1], single


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The table's value; null for other keys."""
    keys, values = F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def identifiers(text: Column, how: str, sentences: dict[str, str] = SENTENCES) -> Column:
    """Position and identifier of the known sentences, in their order; empty sentences have no position."""
    table = known(sentences)
    cleaned = F.filter(F.transform(F.split(F.lower(text), CUTS[how]), lambda s: F.trim(F.regexp_replace(s, OTHER, " "))), lambda s: s != "")
    found = F.array_compact(F.transform(cleaned, lambda s, i: F.when(s.isin(*table), F.struct(i.alias("pos"), s.alias("id")))))  # a hash set, as there are more than ten
    return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), looked_up(x["id"], table).alias("id")))


def matched(found: Column, rules: list[tuple[str, list[str]]], gap: int = GAP) -> Column:
    """The licences whose rules match; each identifier is used once."""
    several, single = split_rules(rules)
    far = lambda x, i: F.when((i > 0) & (x["pos"] - F.get(found, i - 1)["pos"] > gap + 1), "|").otherwise("")
    # ",A,,B,|,C,": neighbours share no comma, so repeated matches side by side are all replaced
    rest = F.array_join(F.transform(found, lambda x, i: F.concat(far(x, i), F.lit(","), x["id"], F.lit(","))), "")
    hits = []
    for name, sequence in several:
        text = "".join(f",{x}," for x in sequence)
        hits.append(F.when(F.contains(rest, F.lit(text)), F.lit(name)))
        rest = F.replace(rest, F.lit(text), F.lit("|"))
    left = F.transform(F.split(rest, "[,|]+"), lambda x: looked_up(x, single))
    return F.array_distinct(F.array_compact(F.concat(F.array(*hits).cast("array<string>"), left)))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, gap: int = GAP) -> DataFrame:
    """id_col, line_ids and wrapped_ids (array of pos, id), licenses (array, sorted)."""
    text, rules = F.coalesce(F.col(text_col), F.lit("")), expanded(rules, sentences)
    ids = df.select(F.col(id_col), identifiers(text, "line", sentences).alias("line_ids"), identifiers(text, "wrapped", sentences).alias("wrapped_ids"))
    # most rows have no known sentence: the rules are not evaluated for them
    found = F.when(F.size("line_ids") + F.size("wrapped_ids") > 0, F.array_sort(F.array_union(matched(F.col("line_ids"), rules, gap), matched(F.col("wrapped_ids"), rules, gap))))
    return ids.withColumn("licenses", F.coalesce(found, F.array().cast("array<string>")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(documents(spark, sf_dir))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["pos"], x["id"])), ",")
    return out.select("doc_id", F.size("line_ids").cast("long").alias("n_sentences"), told("line_ids").alias("line_ids"), told("wrapped_ids").alias("wrapped_ids"), F.array_join("licenses", ",").alias("licenses"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    as_map = lambda t: "map([" + ", ".join(map(quote, t)) + "], [" + ", ".join(map(quote, t.values())) + "])"
    several, single = split_rules(expanded(RULES, SENTENCES))
    cut = {k: v.replace("\\r", "\r").replace("\\n", "\n").replace("\\t", "\t") for k, v in CUTS.items()}
    pieces_of = lambda how: f"list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), {quote(cut[how])}), lambda s: trim(regexp_replace(s, '{OTHER}', ' ', 'g'))), lambda s: s <> '')"
    ids = lambda c: f"list_filter(list_transform({c}, lambda s, i: struct_pack(pos := i - 1, id := names[s])), lambda x: x.id is not null)"
    joined = lambda c: f"array_to_string(list_transform({c}, lambda x, i: case when i > 1 and x.pos - {c}[i - 1].pos > {GAP + 1} then '|' else '' end || ',' || x.id || ','), '')"
    left = lambda c: f"list_filter(list_transform(string_split_regex({c}, '[,|]+'), lambda x: singles[x]), lambda x: x is not null)"
    told = lambda c: f"array_to_string(list_transform({c}, lambda x: x.pos || ':' || x.id), ',')"
    ctes = [f"r0 as (select doc_id, l, w, {joined('l')} as rl, {joined('w')} as rw, []::varchar[] as hits from ids)"]
    for n, (name, sequence) in enumerate(several):
        text = quote("".join(f",{x}," for x in sequence))
        ctes.append(f"r{n + 1} as (select doc_id, l, w, replace(rl, {text}, '|') as rl, replace(rw, {text}, '|') as rw, case when contains(rl, {text}) or contains(rw, {text}) then list_append(hits, {quote(name)}) else hits end as hits from r{n})")
    return f"""with t as (select {as_map(known())} as names, {as_map(single)} as singles), p as (select doc_id, {pieces_of('line')} as pl, {pieces_of('wrapped')} as pw from documents),
 ids as (select doc_id, {ids('pl')} as l, {ids('pw')} as w from p, t), {', '.join(ctes)}
 select doc_id, cast(len(l) as bigint) as n_sentences, {told('l')} as line_ids, {told('w')} as wrapped_ids,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(hits, {left('rl')}), {left('rw')}))), ',') as licenses from r{len(several)}, t"""
