"""Licence scans by sentence rules.

A table of known licence sentences gives each an identifier; a rule is the ordered sequence of
sentence identifiers of a licence. A text is cut into sentences, each is normalised to its lower-case
words and looked up, and what is recognised is a sequence of identifiers with places. A rule matches
where its identifiers occur in order, with at most ``gap`` characters between one and the next: of the
occurrences of an identifier, the first from which the rest of the rule can be reached is taken.

* Sentences end at sentence marks before white space, at semicolons and colons, and at empty lines;
  a line is also tried by itself, so that a licence line within running text is found. Sentences are
  compared by their words, whatever stands between these and however long the sentence is.
* A tag ``SPDX-License-Identifier: <id>`` is two sentences, the second one the identifier; it names
  one identifier of the table (an expression of several is not read).
* Sentences and rules are parameters; the default tables are fixed and small, so they travel with
  the tasks. Rules are tried at every occurrence of their first sentence; of the matches of
  one start the longest is kept, and a match within another of the same text is left out.
* A null or empty text has no match. Every row keeps its own result; the column ``licences`` is
  replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licence texts and notices, by identifier.
SENTENCES = {
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-free-2": "This program is free software;",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "cc-by-nc-name": "Licensed under CC BY-NC 4.0.",
    "cc-by-name": "Licensed under CC BY 4.0.",
    "cc-by-sa-name": "Licensed under CC BY-SA 4.0.",
    "cc0-name": "Released under CC0 1.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "lgpl-free": "This library is free software;",
    "lgpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
    "to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-name": "Distributed under the Boost Software License, Version 1.0.",
    "spdx-tag": "SPDX-License-Identifier:",
}
# Identifiers of the SPDX list that a tag may name.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
    "CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC "
    "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense Zlib"
).split()
SENTENCES |= {f"spdx-{name}": name for name in SPDX}
TAG_GAP = 40
"""Characters between a tag and the identifier it names."""
# Rules as (licence, ordered sentence identifiers).
RULES = (
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-2",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("Apache-2.0", ("apache-name",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy")),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-redistribute")),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl2-redistribute")),
    ("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("CC-BY-4.0", ("cc-by-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("MPL-2.0", ("mpl-copy",)),
    ("MPL-2.0", ("mpl-copy-2",)),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-redistribute")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-redistribute")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-redistribute")),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-name",)),
    *((name, ("spdx-tag", f"spdx-{name}")) for name in SPDX),
)
MATCH = "array<struct<licence:string,first:int,last:int,sentences:int>>"
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)|[;:](?=\s|$)|\n\s*\n")


def normalised(sentence: str) -> str:
    """The words in lower case; a comment sign or list number before the first is left out."""
    return " ".join(WORD.findall(re.sub(r"^[\s*#/;()0-9.-]*", "", sentence.lower())))


def pieces(text: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """Bounds of the sentences of a text."""
    for m in SENTENCE_END.finditer(text):
        if m.end() > at:
            yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


class Scanner:
    def __init__(self, sentences: dict[str, str], rules, gap: int):
        self.known: dict[str, list[str]] = {}
        for name, sentence in sentences.items():
            # what a sentence mark inside cuts off is not needed: the last piece tells the sentence
            a, b = list(pieces(sentence))[-1]
            self.known.setdefault(normalised(sentence[a:b]), []).append(name)
        self.rules, self.gap = rules, gap
        # a text has a match only with a word of the longest sentence of some rule
        telling = {max((normalised(sentences[n]) for n in sequence), key=len) for _, sequence in rules}
        self.signs = self.cover([set(k.split()) for k in sorted(telling)])

    @staticmethod
    def cover(sentences: list[set[str]]) -> list[str]:
        """A few words of which each sentence has at least one, long ones first."""
        chosen: list[str] = []
        left = [s for s in sentences if s]
        while left:
            count: dict[str, int] = {}
            for s in left:
                for w in s:
                    count[w] = count.get(w, 0) + (len(w) > 5)
            best = max(sorted(count), key=lambda w: (count[w], len(w)))
            chosen.append(best)
            left = [s for s in left if best not in s]
        return chosen

    def recognised(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Places of the known sentences, by identifier, in order."""
        low = text.lower()
        if not any(sign in low for sign in self.signs):
            return {}
        found: dict[str, set[tuple[int, int]]] = {}
        bounds = list(pieces(text))
        line_at = 0
        for line in text.split("\n"):
            if line.strip():
                bounds += [(line_at + a, line_at + b) for a, b in pieces(line)]
            line_at += len(line) + 1
        for a, b in bounds:
            for name in self.known.get(normalised(text[a:b]), ()):
                found.setdefault(name, set()).add((a, b))
        return {name: sorted(places) for name, places in found.items()}

    def scan(self, text: str | None) -> list[tuple[str, int, int, int]]:
        places = self.recognised(text) if text else {}
        if not places:
            return []
        found = []
        for licence, sequence in self.rules:
            # from the last sentence back: places from which the rule can be ended, and where it then ends
            reach = [(a, b, b) for a, b in places.get(sequence[-1], ())]
            for name in reversed(sequence[:-1]):
                later, reach = reach, []
                for a, b in places.get(name, ()):
                    k = bisect_left(later, (b, -1, -1))
                    if k < len(later) and later[k][0] - b <= (TAG_GAP if name == "spdx-tag" else self.gap):
                        reach.append((a, b, later[k][2]))
            found += [(first, -end, licence, len(sequence)) for first, _, end in reach]
        kept, reach = [], -1
        for first, end, licence, n in sorted(set(found)):
            if -end > reach:
                kept.append((licence, first, -end, n))
                reach = -end
        return kept


def scan_licences(
    docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, gap: int = 2_000, text_col: str = "text"
) -> DataFrame:
    """All rows with ``licences``: the matches in order of place, each with the licence, its first
    and last character (the last exclusive) and the number of its sentences."""
    keep = [c for c in docs.columns if c != "licences"]
    schema = docs.select(*keep, F.expr(f"cast(array() as {MATCH})").alias("licences")).schema
    fields = ("licence", "first", "last", "sentences")
    kind = pa.list_(pa.struct([("licence", pa.string()), *((n, pa.int32()) for n in fields[1:])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules, gap)
        for batch in batches:
            found = [[dict(zip(fields, m, strict=True)) for m in scanner.scan(t)] for t in batch[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(found, kind)], names=[*keep, "licences"]
            )

    return docs.mapInArrow(run, schema)
