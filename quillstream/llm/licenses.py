"""Licence scans by sentence-rule recognition.

Texts are split into pieces, runs of pieces are looked up among known licence sentences, and the sequence of the
identifiers found is matched against licence rules, which are ordered lists of identifiers that have to stand next to
each other in it. The longest rule goes first and consumes its sentences, so a licence that begins like another is named
once. Splitting, look-up and matching are row expressions: nothing is shuffled, and the known sentences are a fixed table
of this module.

A piece ends at a line end, or at `.`, `!` or `?` before white space. Normalised, it is lower case (ASCII) with every
run of other characters than letters and digits, so comment marks too, as one space. A known sentence is one piece or
several that follow each other without a blank line (or one of marks only), so it may be wrapped anywhere; of those
that start at a piece the longest counts. `*` in a known sentence stands for 1 to STAR words (a holder, an address).
n_sentences counts pieces. Sentences that a rule doesn't use still count as recognised. Null and empty texts have no
sentences, an empty table gives no rows; null ids and repeated rows get a row each; long texts are scanned whole; columns
but doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

#: Known sentences, normalised. Fixed values from the public licence texts.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-the-license": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-program": "this program is licensed under the gnu general public license version 3",
    "gpl2-program": "this program is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at *",
    "bsd-style": "use of this source code is governed by a bsd style license that can be found in the license file",
    "cc-by-sa-licensed": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc-by-licensed": "this work is licensed under the creative commons attribution 4 0 international license",
}
#: Most words that a `*` stands for.
STAR = 12
#: Rules: identifiers in order, and the licence that they state.
RULES = [
    (["mit-notice"], "MIT"),
    (["mit-licensed"], "MIT"),
    (["mit-title"], "MIT"),
    (["mit-grant", "mit-keep"], "MIT"),
    (["apache-notice"], "Apache-2.0"),
    (["apache-the-license"], "Apache-2.0"),
    (["apache-comply", "apache-copy", "apache-as-is"], "Apache-2.0"),
    (["gpl3-work"], "GPL-3.0"),
    (["gpl3-program"], "GPL-3.0"),
    (["gpl2-program"], "GPL-2.0"),
    (["gpl-free", "gpl-hope"], "GPL-3.0-or-later"),
    (["gpl2-free", "gpl-hope"], "GPL-2.0-or-later"),
    (["lgpl-free"], "LGPL-2.1-or-later"),
    (["agpl-free"], "AGPL-3.0-or-later"),
    (["bsd-redistribute", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    (["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"], "BSD-3-Clause"),
    (["isc-grant"], "ISC"),
    (["mpl-form"], "MPL-2.0"),
    (["unlicense"], "Unlicense"),
    (["cc-by"], "CC-BY-4.0"),
    (["cc-by-sa"], "CC-BY-SA-4.0"),
    (["cc-by-nc"], "CC-BY-NC-4.0"),
    (["cc-by-nd"], "CC-BY-ND-4.0"),
    (["cc-by-nc-sa"], "CC-BY-NC-SA-4.0"),
    (["cc-by-work"], "CC-BY-4.0"),
    (["cc-by-sa-work"], "CC-BY-SA-4.0"),
    (["cc-by-nc-work"], "CC-BY-NC-4.0"),
    (["cc0"], "CC0-1.0"),
    (["apache-header"], "Apache-2.0"),
    (["gpl2-only"], "GPL-2.0-only"),
    (["lgpl3-free"], "LGPL-3.0-or-later"),
    (["lgpl-free", "lgpl-hope"], "LGPL-2.1-or-later"),
    (["zero-bsd-grant"], "0BSD"),
    (["zlib-as-is", "zlib-grant"], "Zlib"),
    (["zlib-grant"], "Zlib"),
    (["boost-grant"], "BSL-1.0"),
    (["wtfpl"], "WTFPL"),
    (["epl2"], "EPL-2.0"),
    (["bsd-style"], "BSD-style"),
    (["cc-by-sa-licensed"], "CC-BY-SA-4.0"),
    (["cc-by-licensed"], "CC-BY-4.0"),
]
#: Identifier tags: a sentence and a rule for every licence that has an identifier.
for _licence in sorted({name for _, name in RULES} - {"BSD-style"}):
    SENTENCES[f"spdx-{_licence}"] = "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", _licence.lower()))
    RULES.append(([f"spdx-{_licence}"], _licence))


#: A known sentence holds one of these, so a text without any is not searched further.
GATE = "licen[cs]e|redistribut|permission|copyright|warranty|public domain|mpl|shall be included|the names? of"


_END, _BLANK = "\x01", "\x02"  # a sentence mark before white space, and a blank line


_STEPS = (
    (r"[.!?][\x20\x09\x0B-\x0D]+", _END),
    (r"[^a-z0-9\n\x01]+", " "),
    (r" ?\x01[ \x01]*", _END),
    (r" ?\n ?", "\n"),
    (r"[\n\x01]*\n\x01?\n[\n\x01]*", _BLANK),
    (r"[\n\x01]+", "\n"),
    (r"^[\n\x02 ]+|[\n\x02 ]+\z", ""),
    (r"\n", "\n\n"),
    (r"\x02", "\n\x02\n"),
)


_SIGNS = "".join(chr(c) for c in range(128) if not (chr(c).isalnum() or chr(c) in ("\n", _END)))


def pieces(text: Column) -> Column:
    """A text as normalised pieces, none empty: two line ends between them, _BLANK between those where a blank line
    stood. A text without a piece is empty."""
    out = F.translate(F.coalesce(text, F.lit("")), f"ABCDEFGHIJKLMNOPQRSTUVWXYZ{_END}{_BLANK}", "abcdefghijklmnopqrstuvwxyz  ")
    for k, (old, new) in enumerate(_STEPS):
        if k == 1:  # the same as the pattern, which would match at every single space
            out = F.regexp_replace(F.regexp_replace(F.translate(out, _SIGNS, " " * len(_SIGNS)), r"[^\x00-\x7F]+", " "), "  +", " ")
        else:
            out = F.regexp_replace(out, old, new)
    return out


def _pattern(sentence: str, space: str = " ") -> str:
    star = rf"[a-z0-9]+(?:{space}[a-z0-9]+){{0,{STAR - 1}}}"
    return space.join(star if w == "*" else w for w in sentence.split(" "))


def _any(known: dict[str, str]) -> str:
    """A known sentence as a run of pieces; the longest first, with the line ends about it."""
    return r"\n(?:" + "|".join(_pattern(s, r"(?: |\n\n)") for s in sorted(known.values(), key=lambda s: (-len(s), s))) + r")\n"


def _longest_first(rules: list[tuple[list[str], str]]) -> tuple[list[str], list[str]]:
    """Rules as strings to look for in a sequence, each identifier between two commas, and their licences."""
    order = sorted(rules, key=lambda r: -len(r[0]))
    return ["".join(f",{n}," for n in names) for names, _ in order], [licence for _, licence in order]


def recognise(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[list[str], str]] = RULES) -> DataFrame:
    """doc_id, n_sentences (pieces), n_known (recognised sentences), sequence (their identifiers, comma-joined), licences
    (those whose rule matches, by code point, comma-joined); a row per row of docs."""
    table = F.create_map(*[F.lit(x) for name, s in known.items() if "*" not in s for x in (s, name)])
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces(F.col("text").cast("string")).alias("said"))
    found = F.regexp_extract_all(F.concat(F.lit("\n"), "said", F.lit("\n")), F.lit(_any(known)), F.lit(0))
    found = F.when(F.col("said").rlike(GATE.replace(" ", "(?: |\n\n)")), found).otherwise(F.array().cast("array<string>"))
    n = F.regexp_count("said", F.lit(r"[^\n\x02]+"))

    def named(s: Column) -> Column:
        plain = F.btrim(F.replace(s, F.lit("\n\n"), F.lit(" ")), F.lit("\n"))
        stars = [F.when(plain.rlike(f"^{_pattern(x)}$"), F.lit(name)) for name, x in known.items() if "*" in x]
        return F.coalesce(F.try_element_at(table, plain), *stars)

    ids = said.select("doc_id", n.cast("long").alias("n_sentences"), F.transform(found, named).alias("ids"))
    looked, licences = _longest_first(rules)
    every = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(y).alias("licence")) for x, y in zip(looked, licences)])
    begin = F.struct(F.array_join(F.transform("ids", lambda i: F.concat(F.lit(","), i, F.lit(","))), "").alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(F.contains(acc["left"], r["rule"]), F.struct(F.replace(acc["left"], r["rule"], F.lit("~")).alias("left"), F.array_append(acc["found"], r["licence"]).alias("found"))).otherwise(acc)
    matched = F.when(F.size("ids") > 0, F.aggregate(every, begin, step)["found"]).otherwise(F.array().cast("array<string>"))
    return ids.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sequence"), F.array_join(F.array_sort(F.array_distinct(matched)), ",").alias("licences"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(common.table(spark, sf_dir, "documents"))


_SAID = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2), 'abcdefghijklmnopqrstuvwxyz  ')"
for _old, _new in _STEPS:
    _said = {_END: "chr(1)", _BLANK: "chr(2)", "\n": "chr(10)", "\n\n": "chr(10) || chr(10)", r"\n\x02\n": "chr(10) || chr(2) || chr(10)", "\n\x02\n": "chr(10) || chr(2) || chr(10)"}.get(_new, f"'{_new}'")
    _SAID = f"regexp_replace({_SAID}, '{_old}', {_said}, 'g')"
_VALUES = ", ".join(f"('{_pattern(s)}', '{n}')" for n, s in SENTENCES.items())
_STAGES, _FOUND = "", "''"
for _k, (_rule, _licence) in enumerate(zip(*_longest_first(RULES))):
    _STAGES += f"r{_k + 1} as (select *, contains(left{_k}, '{_rule}') as hit{_k}, replace(left{_k}, '{_rule}', '~') as left{_k + 1} from r{_k}),\n"
    _FOUND += f", case when hit{_k} then '{_licence}' end"
OP6_SQL = rf"""
with k(pat, id) as (values {_VALUES}),
d as materialized (select row_number() over () as rid, doc_id, {_SAID} as said from documents),
u as (select rid, unnest(f) as s, generate_subscripts(f, 1) as n from (select rid, regexp_extract_all(chr(10) || said || chr(10), '{_any(SENTENCES)}') as f from d)),
q as (select rid, count(*)::bigint as n_known, string_agg(id, ',' order by n) as sequence, string_agg(',' || id || ',', '' order by n) as left0
      from u join k on regexp_full_match(trim(replace(s, chr(10) || chr(10), ' '), chr(10)), pat) group by rid),
r0 as (select * from q),
{_STAGES}l as (select rid, n_known, sequence, list_sort(list_distinct(list_filter([{_FOUND}], lambda x: x <> ''))) as licences from r{len(RULES)})
select doc_id, case when said = '' then 0 else len(regexp_extract_all(said, '[^\n\x02]+')) end::bigint as n_sentences, coalesce(n_known, 0)::bigint as n_known, coalesce(sequence, '') as sequence, coalesce(array_to_string(licences, ','), '') as licences
from d left join l using (rid)
"""
