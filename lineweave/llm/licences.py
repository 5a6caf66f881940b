"""Licence scans by sentence rules, from DataFrame functions alone.

Texts are split into sentences, which may run over lines; a sentence that is not known is split into its lines, as lines
need not have stops. Sentences are normalised (ASCII lower case, runs of other characters than letters and digits one
space) and looked up in a fixed dictionary of licence sentences. The identifiers that a document yields, in order,
are matched against ordered rules: a rule matches where its identifiers stand one after another, with nothing but
unknown sentences between them. The first matching rule names the licence, and all matching ones are listed.

Everything is a projection of one row: no shuffle, no Python, and memory bounded by one document. A cheap search for
words that every known sentence has spares other documents the splitting.

Defined cases: null and empty texts, and texts without known sentences, have no identifiers and a null licence;
repeated rows give equal rows; a very long text is one row, split whole; an empty table gives an empty result; columns
other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifier and text of known licence sentences.
SENTENCES = {
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache2-ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "cc-by-nc4-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by4-ref": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl2-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-sa4-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-waiver": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "reserved": ["All rights reserved."],
}

#: Licence and identifier sequence, the more specific rules first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("LGPL-2.1-or-later", ["lgpl2-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Apache-2.0", ["apache2-ref", "apache2-copy"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-ref"]),
    ("CC-BY-4.0", ["cc-by4-ref"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]

#: Each known sentence has one of these.
TRIGGERS = ["licen", "permission", "copyright", "warrant", "redistribut", "rights reserved", "public domain"]
#: A sentence ends at a stop, question or exclamation mark before white space or at a blank line; a line at its end.
ENDS = r"[.!?]+[ \t\r\n]+|\r?\n[ \t\r]*\n"
LINES = r"[.!?]+[ \t]+|[\r\n]+"


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _lookup() -> dict[str, str]:
    """Normalised sentence to identifier; of a sentence with a stop inside, what stands before that."""
    return {_normal(re.split(ENDS, text)[0]): ident for ident, texts in SENTENCES.items() for text in texts}


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_sentences (known ones), sentence_ids, license, licenses (comma-separated, in rule order)."""
    known = F.create_map(*(F.lit(x) for pair in sorted(_lookup().items()) for x in pair))
    text = F.col("text")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    normal = lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    of = lambda x: F.element_at(known, normal(x))
    each = F.transform(F.split(lower, ENDS), lambda x: F.coalesce(F.when(of(x).isNotNull(), F.array(of(x))), F.transform(F.split(x, LINES), of)))
    found = F.array_compact(F.flatten(each))
    likely = text.rlike("(?i)" + "|".join(TRIGGERS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.when(likely, found).otherwise(F.array().cast("array<string>")).alias("ids"))
    rows = rows.select("id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    hits = [F.when(F.contains(line, F.lit("," + ",".join(ids) + ",")), F.lit(name)) for name, ids in RULES]
    every = F.array_distinct(F.array_compact(F.array(*hits)))
    return rows.select(F.col("id").alias(id_col), "n_sentences", "sentence_ids", F.coalesce(*hits).alias("license"), F.array_join(every, ",").alias("licenses"))


def oracle() -> str:
    """DuckDB twin of `scan` over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = sorted(_lookup().items())
    known = f"MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in pairs)}}}"
    hits = [f"CASE WHEN contains(',' || sentence_ids || ',', ',{','.join(ids)},') THEN '{name}' END" for name, ids in RULES]
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    of = lambda x: f"known[trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))]"
    each = f"list_transform(regexp_split_to_array({lower}, '{ENDS}'), lambda x: CASE WHEN {of('x')} IS NOT NULL THEN [{of('x')}] ELSE list_transform(regexp_split_to_array(x, '{LINES}'), lambda y: {of('y')}) END)"
    return rf"""
WITH m AS (SELECT {known} AS known),
i AS (SELECT doc_id, list_filter(flatten({each}), lambda x: x IS NOT NULL) AS ids FROM documents, m),
d AS (SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids FROM i),
h AS (SELECT *, [{", ".join(hits)}] AS hits FROM d)
SELECT doc_id, n_sentences, sentence_ids, coalesce({", ".join(f"hits[{i + 1}]" for i in range(len(hits)))}) AS license,
  coalesce(array_to_string(list_filter(hits, lambda x, i: x IS NOT NULL AND list_position(hits, x) = i), ','), '') AS licenses
FROM h
"""
