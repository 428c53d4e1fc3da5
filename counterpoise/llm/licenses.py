"""Licence scans by sentences: known sentences become identifiers, ordered rules match their sequence.

A text is cut into sentences, each is normalised (lower case, letters and digits only), and looked up
among the known sentences.  Rules are sequences of identifiers; other known sentences may stand between
them.  Rules are tried in order and use up what they match, so a full text is not reported again as the
short notice that it contains.  All of it is column functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Identifier of a sentence, and the sentence as licences and notices write it.
SENTENCES = (
    ("mit.notice", "Released under the MIT License"),
    ("mit.notice", "Licensed under the MIT License"),
    ("mit.notice", "This project is licensed under the MIT License"),
    ("mit.notice", "SPDX-License-Identifier: MIT"),
    ("mit.title", "The MIT License"),
    ("mit.title", "MIT License"),
    ("mit.title", "The MIT License (MIT)"),
    ("mit.grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                  "and associated documentation files (the \"Software\"), to deal in the Software without "
                  "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                  "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                  "Software is furnished to do so, subject to the following conditions"),
    ("mit.keep", "The above copyright notice and this permission notice shall be included in all copies or "
                 "substantial portions of the Software"),
    ("apache2.notice", "Licensed under the Apache License, Version 2.0"),
    ("apache2.notice", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache2.notice", "Released under the Apache License, Version 2.0"),
    ("apache2.notice", "SPDX-License-Identifier: Apache-2.0"),
    ("apache2.may", "You may not use this file except in compliance with the License"),
    ("apache2.may", "you may not use this file except in compliance with the License"),
    ("apache2.copy", "You may obtain a copy of the License at"),
    ("apache2.asis", "Unless required by applicable law or agreed to in writing, software distributed under the "
                     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                     "either express or implied"),
    ("apache2.see", "See the License for the specific language governing permissions and limitations under the "
                    "License"),
    ("gpl3.notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3.notice", "Licensed under the GNU General Public License, version 3"),
    ("gpl3.notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl2.notice", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl2.notice", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl.free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version"),
    ("gpl.hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                 "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl.see", "See the GNU General Public License for more details"),
    ("bsd.notice", "Licensed under the BSD License"),
    ("bsd.notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd.grant", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met"),
    ("bsd.source", "Redistributions of source code must retain the above copyright notice, this list of conditions "
                   "and the following disclaimer"),
    ("bsd.binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the "
                   "distribution"),
    ("ccbync4.notice", "Licensed under CC BY-NC 4.0"),
    ("ccbync4.notice", "This work is licensed under CC BY-NC 4.0"),
    ("ccby4.notice", "Licensed under CC BY 4.0"),
    ("ccbysa4.notice", "Licensed under CC BY-SA 4.0"),
    ("cc0.notice", "SPDX-License-Identifier: CC0-1.0"),
    ("mpl2.notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2.notice", "SPDX-License-Identifier: MPL-2.0"),
)

# Licence, and the identifiers that tell it, in their order; longer evidence first.
RULES = (
    ("MIT", ("mit.grant", "mit.keep")),
    ("Apache-2.0", ("apache2.notice", "apache2.may", "apache2.copy", "apache2.asis", "apache2.see")),
    ("Apache-2.0", ("apache2.notice", "apache2.may", "apache2.copy")),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope", "gpl.see")),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", ("mit.title", "mit.notice")),
    ("MIT", ("mit.notice",)),
    ("Apache-2.0", ("apache2.notice",)),
    ("GPL-3.0", ("gpl3.notice",)),
    ("GPL-2.0", ("gpl2.notice",)),
    ("BSD-3-Clause", ("bsd.notice",)),
    ("CC-BY-NC-4.0", ("ccbync4.notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)),
    ("CC-BY-4.0", ("ccby4.notice",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("MPL-2.0", ("mpl2.notice",)),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENDS = r"[.!?:;][ \t\r\n]+"


def plain(sentence: str) -> str:
    """A sentence in normal form: lower case ASCII letters and digits, one space between runs."""
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower())
    return " ".join(kept.split())


def known_sentences(sentences=SENTENCES) -> dict[str, str]:
    return {plain(text): name for name, text in sentences}


def _pattern(sentences) -> str:
    """Known sentences, longest first, between marks (H a sentence's or paragraph's end, a line feed the end of a
    line in a paragraph).  Words may stand on different lines; an entry that holds a sentence end may be cut there."""
    cut = {tuple(plain(part) for part in re.split(_ENDS, text)) for _, text in sentences}
    cut = sorted((tuple(filter(None, parts)) for parts in cut), key=lambda parts: (-len(" ".join(parts)), parts))
    texts = ["[ \nH]{1,3}".join(part.replace(" ", "[ \n]{1,2}") for part in parts) for parts in cut]
    return "(?<=[\nH])(?:" + "|".join(texts) + ")(?= ?[\nH])"


def _identifiers(text: Column, sentences) -> Column:
    """Identifiers of the known sentences in their order.  A lowered text has no capital letter, so H is free as a
    mark; what else is no letter or digit goes with the mark before it, or is a blank."""
    known = known_sentences(sentences)
    if not known:
        return F.array().cast("array<string>")
    lower = F.translate(text, _UPPER, _UPPER.lower())
    marked = F.concat(F.lit("H"), F.regexp_replace(lower, _ENDS + r"|\n\n+", "H"), F.lit("H"))
    clean = F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9\nH]+", " "), r"(?:H[ \n]*)+", "H")
    clean = F.regexp_replace(clean, r"\n[ \n]+", "\n")
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    hits = F.regexp_extract_all(clean, F.lit(_pattern(sentences)), F.lit(0))
    return F.transform(hits, lambda s: F.element_at(names, F.regexp_replace(s, r"[ \nH]+", " ")))


def scan(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """Adds ``sentence_ids`` (known sentences in their order) and ``licenses`` (by rule order, each once).

    A known sentence counts where it stands between two ends: punctuation before white space, line ends and
    blank lines.  It may go over line ends (wrapped lines), not over blank lines, so one-line notices and
    wrapped texts are told in one reading, in their order.  Null and empty texts have no sentences and
    no licences; repeated rows give repeated rows; other columns pass through.
    """
    out = docs.withColumn("sentence_ids", _identifiers(F.coalesce(F.col("text"), F.lit("")), sentences))
    rest = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    found = []
    out = out.withColumn("_rest", rest)
    for place, (name, sequence) in enumerate(rules):
        pattern = r"(?: [a-z0-9.]+ )*?".join(" " + step.replace(".", "[.]") + " " for step in sequence)
        out = out.withColumn(f"_hit{place}", F.when(F.col("_rest").rlike(pattern), F.lit(name)))
        out = out.withColumn("_rest", F.regexp_replace("_rest", pattern, ""))
        found.append(f"_hit{place}")
    return out.withColumn("licenses", F.array_distinct(F.array_compact(F.array(*found)))).drop("_rest", *found)


def report(docs: DataFrame) -> DataFrame:
    """Per document its licences, the number of known sentences, and their identifiers as texts."""
    seen = scan(docs.select("doc_id", "text"))
    return seen.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                       F.array_join("licenses", ",").alias("licenses"),
                       F.size("sentence_ids").cast("long").alias("n_sentences"),
                       F.array_join("sentence_ids", ",").alias("sentence_ids"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    listed = ", ".join(quote(s) for s in known)
    pairs = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known.items())
    cut = ("list_transform(string_split(regexp_replace(regexp_replace(translate({t}, '" + _UPPER + "', '"
           + _UPPER.lower() + r"'), '([.!?:;])[ \t\r\n]+', '\1' || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)),"
           " lambda s: trim(s))")
    ids = ("list_transform(list_filter(" + cut + f", lambda s: s in ({listed})), "
           "lambda s: (map {" + pairs + "})[s])")
    wrapped = "coalesce(text, '')"
    for _ in range(2):
        wrapped = f"regexp_replace({wrapped}, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g')"
    steps, source = [], "chosen"
    hits = []
    for place, (name, sequence) in enumerate(RULES):
        pattern = r"(?: [a-z0-9.]+ )*?".join(" " + step.replace(".", "[.]") + " " for step in sequence)
        steps.append(f"r{place} as (select *, case when regexp_matches(rest{place}, {quote(pattern)}) then {quote(name)} end "
                     f"as hit{place}, regexp_replace(rest{place}, {quote(pattern)}, '', 'g') as rest{place + 1} from {source})")
        hits.append(f"hit{place}")
        source = f"r{place}"
    in_order = " || ".join(
        f"case when {h} is not null and {' and '.join([f'{h} is distinct from {p}' for p in hits[:i]] or ['true'])} "
        f"then [{h}] else []::varchar[] end" for i, h in enumerate(hits))
    return (f"with both_ways as (select doc_id, {ids.replace('{t}', "coalesce(text, '')")} as by_line, "
            f"{ids.replace('{t}', wrapped)} as joined from documents), "
            "chosen as (select doc_id, sentence_ids, ' ' || array_to_string(sentence_ids, '  ') || ' ' as rest0 from ("
            "select doc_id, case when len(joined) > len(by_line) then joined else by_line end as sentence_ids from both_ways)), "
            + ", ".join(steps) + f", last as (select doc_id, sentence_ids, {in_order} as found from {source}) "
            "select doc_id, len(found)::bigint as n_licenses, array_to_string(found, ',') as licenses, "
            "len(sentence_ids)::bigint as n_sentences, array_to_string(sentence_ids, ',') as sentence_ids from last")


REPORT_SQL = _sql()
