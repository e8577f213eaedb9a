"""Operator 4: licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at line ends and after sentence punctuation (a line end inside a sentence, before a small letter,
is a space), sentences are normalised to small letters, digits and dots, and each known one is mapped to its identifier. A known
sentence may run over other line ends, comment signs, ``;`` and ``:``, but not over a blank line or another end of a sentence.
A holder's name inside a sentence may be any of up to
twelve words, and a line of short identifiers (SPDX) is a sentence for each of them. The sequence of identifiers of a document is matched
against ordered rules, long ones first: a rule holds where its identifiers occur in its order, with others between them or not, and takes them
away from shorter rules. One projection does all of this; nothing is shuffled or joined, so no document,
key or group is hot.

Defined results: null and empty texts have no sentences and no licence; sentences found but no complete rule leave ``licenses``
empty; null ids and repeated rows stay; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence notices and their identifiers. <holder> stands for a name of up to twelve words.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
_RIGHTS = "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
SENTENCES = {
    "MIT-1": "released under the mit license",
    "MIT-2": "licensed under the mit license",
    "MIT-3": f"{_GRANT} to deal in the software {_RIGHTS} subject to the following conditions",
    "MIT-4": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-5": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT-6": f"{_GRANT} to deal in the software {_RIGHTS}",
    "NCSA-1": f"{_GRANT} to deal with the software {_RIGHTS} subject to the following conditions",
    "NCSA-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",
    "X11-1": "except as contained in this notice the name of <holder> shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from <holder>",
    "APACHE-1": "licensed under the apache license version 2.0",
    "APACHE-2": "licensed under the apache license version 2.0 the license",
    "APACHE-3": "you may not use this file except in compliance with the license",
    "APACHE-4": "you may obtain a copy of the license at",
    "GPL-1": "this work is licensed under the gnu general public license version 3",
    "GPL-2": "this program is free software",
    "GPL-3": _GNU.format("general public license", "3"),
    "GPL-4": _GNU.format("general public license", "2"),
    "GPL-5": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPL-6": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "LGPL-1": "this library is free software",
    "LGPL-2": _GNU.format("lesser general public license", "2.1"),
    "LGPL-3": _GNU.format("lesser general public license", "3"),
    "LGPL-4": _GNU.format("library general public license", "2"),
    "AGPL-1": _GNU.format("affero general public license", "3"),
    "BSD-1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-4": "neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-5": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BSD-6": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "MPL-1": "this source code form is subject to the terms of the mozilla public license v",
    "MPL-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "MPL-3": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "MPL-4": "the contents of this file are subject to the mozilla public license version 1.1 the license",
    "ISC-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-3": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0BSD-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "EPL-1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at",
    "EPL-2": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl v10.html",
    "EPL-3": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "CC0-1": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "CC0-2": "this work is marked with cc0 1.0",
    "UNL-1": "this is free and unencumbered software released into the public domain",
    "UNL-2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "BSL-1": "distributed under the boost software license version 1.0",
    "BSL-2": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "ZLIB-1": "this software is provided as is without any express or implied warranty",
    "ZLIB-2": "in no event will the authors be held liable for any damages arising from the use of this software",
    "ZLIB-3": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "WTFPL-1": "do what the fuck you want to public license",
    "WTFPL-2": "you just do what the fuck you want to",
    "ART-1": "the artistic license 2.0",
    "ART-2": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "CDDL-1": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "EUPL-1": "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence",
    "EUPL-2": "you may not use this work except in compliance with the licence",
    "PG-1": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "OFL-1": "this font software is licensed under the sil open font license version 1.1",
    "MSPL-1": "microsoft public license ms pl",
    "MSPL-2": "this license governs use of the accompanying software",
    "UPL-1": "licensed under the universal permissive license v 1.0 as shown at https oss.oracle.com licenses upl",
    "AFL-1": "licensed under the academic free license version 3.0",
    "BEER-1": "as long as you retain this notice you can do whatever you want with this stuff",
    "CC-1": "licensed under cc by nc 4.0",
    "CC-2": "licensed under cc by 4.0",
    "CC-3": "licensed under cc by sa 4.0",
    "CC-4": "this work is licensed under a creative commons attribution 4.0 international license",
    "RIGHTS-1": "all rights reserved",
}

# Licences and the ordered sentences that state them; one of several rules is enough.
RULES = [
    ("Apache-2.0", ["APACHE-1"]),
    ("Apache-2.0", ["APACHE-2", "APACHE-3", "APACHE-4"]),
    ("BSD-2-Clause", ["BSD-1", "BSD-2", "BSD-3"]),
    ("BSD-3-Clause", ["BSD-1", "BSD-2", "BSD-3", "BSD-4"]),
    ("BSD-3-Clause", ["BSD-1", "BSD-2", "BSD-3", "BSD-6"]),
    ("BSD-4-Clause", ["BSD-1", "BSD-2", "BSD-3", "BSD-5", "BSD-4"]),
    ("CC-BY-4.0", ["CC-2"]),
    ("CC-BY-4.0", ["CC-4"]),
    ("CC-BY-NC-4.0", ["CC-1"]),
    ("CC-BY-SA-4.0", ["CC-3"]),
    ("GPL-2.0-only", ["GPL-2", "GPL-6"]),
    ("GPL-2.0-or-later", ["GPL-2", "GPL-4"]),
    ("GPL-3.0", ["GPL-1"]),
    ("GPL-3.0-or-later", ["GPL-2", "GPL-3"]),
    ("LGPL-2.0-or-later", ["LGPL-1", "LGPL-4"]),
    ("LGPL-2.1-or-later", ["LGPL-1", "LGPL-2"]),
    ("LGPL-3.0-or-later", ["LGPL-1", "LGPL-3"]),
    ("LGPL-3.0-or-later", ["GPL-2", "LGPL-3"]),
    ("AGPL-3.0-or-later", ["GPL-2", "AGPL-1"]),
    ("MIT", ["MIT-1"]),
    ("MIT", ["MIT-2"]),
    ("MIT", ["MIT-3", "MIT-4", "MIT-5"]),
    ("MIT-0", ["MIT-6", "MIT-5"]),
    ("X11", ["MIT-3", "MIT-4", "MIT-5", "X11-1"]),
    ("NCSA", ["NCSA-1", "NCSA-2"]),
    ("MPL-1.1", ["MPL-4", "APACHE-3"]),
    ("MPL-2.0", ["MPL-1", "MPL-2"]),
    ("MPL-2.0", ["MPL-1", "MPL-3"]),
    ("ISC", ["ISC-1", "ISC-3"]),
    ("ISC", ["ISC-2", "ISC-3"]),
    ("0BSD", ["0BSD-1", "ISC-3"]),
    ("EPL-1.0", ["EPL-1"]),
    ("EPL-1.0", ["EPL-2"]),
    ("EPL-2.0", ["EPL-3"]),
    ("CC0-1.0", ["CC0-1"]),
    ("CC0-1.0", ["CC0-2"]),
    ("Unlicense", ["UNL-1", "UNL-2"]),
    ("BSL-1.0", ["BSL-1"]),
    ("BSL-1.0", ["BSL-2"]),
    ("Zlib", ["ZLIB-1", "ZLIB-2", "ZLIB-3"]),
    ("WTFPL", ["WTFPL-1", "WTFPL-2"]),
    ("Artistic-2.0", ["ART-1", "ART-2"]),
    ("CDDL-1.0", ["CDDL-1", "APACHE-3"]),
    ("EUPL-1.2", ["EUPL-1", "EUPL-2"]),
    ("PostgreSQL", ["PG-1"]),
    ("OFL-1.1", ["OFL-1"]),
    ("MS-PL", ["MSPL-1", "MSPL-2"]),
    ("UPL-1.0", ["UPL-1"]),
    ("AFL-3.0", ["AFL-1"]),
    ("Beerware", ["BEER-1"]),
    ("proprietary", ["RIGHTS-1"]),
]

# Names of a licence behind "licensed under the" and "released under the".
_NAMED = {
    "AGPL-3.0": ["gnu affero general public license v3.0", "gnu affero general public license version 3"],
    "Apache-2.0": ["apache license 2.0", "apache 2.0 license"],
    "BSD-2-Clause": ["bsd 2 clause license"],
    "BSD-3-Clause": ["bsd 3 clause license"],
    "GPL-2.0": ["gnu general public license v2.0", "gnu general public license version 2"],
    "GPL-3.0": ["gnu general public license v3.0", "gnu general public license version 3"],
    "ISC": ["isc license"],
    "LGPL-2.1": ["gnu lesser general public license v2.1", "gnu lesser general public license version 2.1"],
    "LGPL-3.0": ["gnu lesser general public license v3.0", "gnu lesser general public license version 3"],
    "MPL-2.0": ["mozilla public license 2.0", "mozilla public license version 2.0"],
}
#: Short identifiers behind "SPDX-License-Identifier:", where an expression may join several by OR, AND or WITH.
_SPDX = sorted({name for name, _ in RULES if name not in ("proprietary", "Beerware")} | set(_NAMED) | {"GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"})
_SPDX_LINE = "spdx license identifier"

for _name, _written in _NAMED.items():
    for _i, _w in enumerate(_written):
        for _j, _verb in enumerate(("licensed", "released")):
            _id = f"{_name.upper()}-L{2 * _i + _j + 1}"
            SENTENCES[_id] = f"{_verb} under the {_w}"
            RULES.append((_name, [_id]))
for _terms in ("noncommercial", "sharealike", "noderivatives", "noncommercial sharealike", "noncommercial noderivatives"):
    _name = "CC-BY-" + {"noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND", "noncommercial sharealike": "NC-SA", "noncommercial noderivatives": "NC-ND"}[_terms] + "-4.0"
    SENTENCES[f"{_name}-W"] = f"this work is licensed under a creative commons attribution {_terms} 4.0 international license"
    RULES.append((_name, [f"{_name}-W"]))
for _name in _SPDX:
    RULES.append((_name, [f"SPDX-{_name}"]))
#: Longer rules come first and take their sentences from shorter ones.
RULES.sort(key=lambda r: -len(r[1]))

# What notices put before "licensed under ...", and the signs of a list.
_LEAD = r"(?:(?:[0-9]{1,2}|[a-d])[ \r\f]+)?(?:th(?:is|e) (?:project|software|program|library|package|code|file|repository|document|material) is )?"
_HOLDER = r"(?:[a-z0-9.]+[ \r\f\x01]+){1,12}?"

_WRAPPED = r"([^.!?;:\s])[ \t]*\n[ \t]*([a-z])"
_BLANK = r"\n[^\p{L}\p{N}\n\f\x01]*(?=\n)"
_OTHER = r"[^a-z0-9.\r\f\x01]+"


def cut(text: Column) -> Column:
    """A text in small letters, digits and dots with its ends of sentences as marks.

    0x01 ends a sentence; a form feed (after ``;`` and ``:``) and a carriage return (a line end that is no plain wrap: before a capital, a
    sign or a comment sign) may end one or stand inside one.
    """
    t = F.translate(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\r\n", "\n"), "\r\f\x01", "   ")
    t = F.regexp_replace(t, "(SPDX-License-Identifier:[^\\n]*)\\n", "$1\n\n")  # ends with its line
    t = F.lower(F.regexp_replace(t, _WRAPPED, "$1 $2"))
    t = F.regexp_replace(F.regexp_replace(t, r"[;:]\s+", "\f"), r"[.!?]\s+", "\x01")
    t = F.translate(F.regexp_replace(t, _BLANK, "\x01"), "\n", "\r")
    t = F.concat(F.lit("\x01"), F.regexp_replace(t, _OTHER, " "), F.lit("\x01"))
    return F.regexp_replace(t, r"[ .]*([\r\f\x01])[ .]*", "$1")


def _pattern(sentence: str) -> str:
    """A regular expression of a normalised sentence over any line ends, and ends of sentences within a holder's name."""
    words = [_HOLDER if w == "<holder>" else w.replace(".", r"\.") + r"[ \r\f]+" for w in sentence.split(" ")]
    out = "".join(words)
    if sentence.endswith("<holder>"):
        return out[: -len(_HOLDER)] + r"(?:[a-z0-9.]+[ \r\f\x01]+){0,11}?[a-z0-9.]+"
    return out.removesuffix(r"[ \r\f]+")


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order; a line of short identifiers gives one for each."""
    known = known or SENTENCES
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (v, k)])
    short = F.create_map(*[F.lit(x) for name in _SPDX for x in (name.lower().replace("-", " "), f"SPDX-{name}")])
    either = "|".join([*map(_pattern, sorted(known.values(), key=len, reverse=True)), _pattern(_SPDX_LINE) + r"[ \r\f]+[a-z0-9. ]+"])
    found = F.regexp_extract_all(cut(text), F.lit(rf"(?<=[\r\f\x01]){_LEAD}({either})(?=[\r\f\x01])"), 1)

    def name(x: Column) -> Column:
        plain = F.regexp_replace(x, r"[ \r\f\x01]+", " ")
        for v in known.values():
            if "<holder>" in v:
                head, *rest = v.split("<holder>")
                plain = F.when(F.startswith(plain, F.lit(head)), F.regexp_replace(plain, "^" + re.escape(head) + "".join(".+?" + re.escape(r) for r in rest) + "$", v)).otherwise(plain)
        parts = F.split(F.replace(plain, F.lit(_SPDX_LINE + " "), F.lit("")), " (?:or(?! later)|and|with) ")
        return F.when(F.startswith(plain, F.lit(_SPDX_LINE)), F.transform(parts, lambda p: F.try_element_at(short, F.trim(p)))).otherwise(F.array(F.try_element_at(table, plain)))

    return F.array_compact(F.flatten(F.transform(found, name)))


def matching(ids: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """Names of the licences of which a rule occurs in order in the identifiers, ascending, each once.

    Rules are tried in their order, and one that holds takes its sentences away from those behind it.
    """
    tagged = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_in_order(order)).alias("pattern"), F.lit("".join(f"${i}" for i in range(1, len(order)))).alias("rest")) for name, order in rules or RULES])
    none = F.array().cast("array<string>")
    start = F.struct(tagged.alias("tagged"), none.alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        holds = F.rlike(acc["tagged"], rule["pattern"])
        left = F.regexp_replace(acc["tagged"], rule["pattern"], rule["rest"])
        return F.struct(F.when(holds, left).otherwise(acc["tagged"]).alias("tagged"), F.when(holds, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    return F.when(F.size(ids) > 0, F.array_sort(F.array_distinct(F.aggregate(table, start, step)["names"]))).otherwise(none)


def _in_order(order: list[str]) -> str:
    return "(.*?)".join(f"<{re.escape(i)}>" for i in order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (joined by commas) of each document."""
    got = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("_ids"))
    return got.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join(matching(F.col("_ids")), ",").alias("licenses"))


def scan_sql() -> str:
    """The same for DuckDB over ``documents``: sentences by splitting, rules one after another."""
    plain = {k: v for k, v in SENTENCES.items() if "<holder>" not in v}
    values = ", ".join(f"'{v}'" for v in plain.values())
    pairs = ", ".join(f"'{v}': '{k}'" for k, v in plain.items())
    steps, last = [], "t"
    for i, (name, order) in enumerate(RULES):
        rest = "".join(f"\\{j}" for j in range(1, len(order)))
        steps.append(f"r{i} AS (SELECT doc_id, ids, regexp_replace(tagged, '{_in_order(order)}', '{rest}', 'g') AS tagged, CASE WHEN regexp_matches(tagged, '{_in_order(order)}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"r{i}"
    return rf"""
    WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(
        regexp_replace(coalesce(text, ''), '([^.!?;:\s])[ \t]*\r?\n[ \t]*([a-z])', '\1 \2', 'g')), '([.!?;:])\s+', E'\\1\n', 'g'), '[^a-z0-9.\n]+', ' ', 'g'), E'\n'),
        lambda x: trim(x, ' .')), lambda x: x IN ({values})) AS found FROM documents),
    i AS (SELECT doc_id, list_transform(found, lambda x: MAP {{{pairs}}}[x]) AS ids FROM s),
    t AS (SELECT *, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS tagged, CAST([] AS VARCHAR[]) AS names FROM i), {", ".join(steps)}
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(names)), ',') AS licenses
    FROM {last}"""
