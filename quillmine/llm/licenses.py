"""Licence detection by sentence rules.

Texts are cut into clauses, each clause is normalised (case, punctuation, years and white space), and a word tree
maps normalised sentences, which may span any number of clauses, to identifiers. The identifiers of a document, in order, are then matched
against ordered licence rules: a rule is a sequence of identifiers in which up to `gap` unknown sentences
may stand between two of them, and sentences of IGNORED too. Rules are tried in order at each place, so the longer comes before its
part; matched sentences are used up. An SPDX expression (AND, OR, WITH, brackets) gives a notice for each licence that it names.

The knowledge base has titles, notices and tags of the licences in LICENCES, made by the patterns in NOTICES, and
the sentences of the full texts and file headers in SENTENCES. Both are parameters of Scanner; a licence that is not in them is not found.

Defined results: a null or empty text has no match and no row in `matches`, and an empty list in `scan`. Repeated rows are
scanned each. A null doc_id is kept. Only doc_id and text are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmine.llm.common import slices, small_batches, utf8

#: Sentences of public licence texts and notices, as identifier and wording.
SENTENCES = [
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-2.0-condition", "you may not use this file except in compliance with the License"),
    ("apache-2.0-copy", "You may obtain a copy of the License at"),
    ("apache-2.0-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-2.0-language", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("isc-title", "ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("unlicense-release", "This is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-title", "Boost Software License - Version 1.0"),
    ("bsl-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("bsl-notice", "Distributed under the Boost Software License, Version 1.0"),
    ("wtfpl-title", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-notice", "Licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-notice", "Licensed under the GNU General Public License v3.0"),
    ("gpl-2.0-notice", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2.0-notice", "Licensed under the GNU General Public License, version 2"),
    ("gpl-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-redistribute-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-redistribute", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-redistribute-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-details", "See the GNU Lesser General Public License for more details"),
    ("agpl-details", "See the GNU Affero General Public License for more details"),
    ("gpl-received", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-details", "See the GNU General Public License for more details"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-notice", "Licensed under the BSD 3-Clause License"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0-1.0-notice", "Dedicated to the public domain under CC0 1.0"),
    ("rights-reserved", "All rights reserved"),
]
#: Licence and its identifiers in order; earlier rules win.
RULES = [
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-condition", "apache-2.0-copy", "apache-2.0-warranty", "apache-2.0-language")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-condition")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-title", "isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Unlicense", ("unlicense-release", "unlicense-grant")),
    ("Unlicense", ("unlicense-release",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("WTFPL", ("wtfpl-title",)),
    ("LGPL-2.1-or-later", ("lgpl-redistribute", "gpl-warranty", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl-redistribute-3", "gpl-warranty", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute-3",)),
    ("AGPL-3.0-or-later", ("agpl-redistribute", "gpl-warranty", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl-redistribute",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("GPL-3.0-only", ("gpl-3.0-notice",)),
    ("GPL-2.0-only", ("gpl-2.0-notice",)),
    ("BSD-3-Clause", ("notice-BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("notice-BSD-2-Clause", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("CC0-1.0", ("cc0-1.0-notice",)),
    ("LicenseRef-all-rights-reserved", ("rights-reserved",)),
]
#: SPDX identifiers and the names by which notices call the licences.
LICENCES = [
    ("MIT", ("MIT License", "MIT licence", "MIT")),
    ("Apache-2.0", ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause")),
    ("0BSD", ("0BSD",)),
    ("ISC", ("ISC License", "ISC")),
    ("Zlib", ("zlib License", "Zlib")),
    ("BSL-1.0", ("Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0")),
    ("Unlicense", ("Unlicense",)),
    ("WTFPL", ("WTFPL",)),
    ("GPL-2.0-only", ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPL-2.0-only", "GPL-2.0", "GPLv2")),
    ("GPL-2.0-or-later", ("GPL-2.0-or-later", "GPL-2.0+", "GPLv2+")),
    ("GPL-3.0-only", ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPL-3.0-only", "GPL-3.0", "GPLv3")),
    ("GPL-3.0-or-later", ("GPL-3.0-or-later", "GPL-3.0+", "GPLv3+")),
    ("LGPL-2.1-only", ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPL-2.1-only", "LGPL-2.1", "LGPLv2.1")),
    ("LGPL-2.1-or-later", ("LGPL-2.1-or-later",)),
    ("LGPL-3.0-only", ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPL-3.0-only", "LGPL-3.0", "LGPLv3")),
    ("LGPL-3.0-or-later", ("LGPL-3.0-or-later",)),
    ("AGPL-3.0-only", ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPL-3.0-only", "AGPL-3.0", "AGPLv3")),
    ("AGPL-3.0-or-later", ("AGPL-3.0-or-later",)),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0")),
    ("EPL-1.0", ("Eclipse Public License 1.0", "EPL-1.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0")),
]
CC_KINDS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CC_VERSIONS = [("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")]
LICENCES += [
    (f"CC-{kind}-{version}", (f"CC {kind} {version}", f"CC-{kind}-{version}", f"Creative Commons {name} {version} {scope} License", f"Creative Commons {name} {version} License", f"Creative Commons {name} {version} {scope}"))
    for kind, name in CC_KINDS
    for version, scope in CC_VERSIONS
]
#: How a notice names its licence.
NOTICES = (
    "Licensed under {}", "Licensed under the {}", "Licensed under the terms of the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}",
    "This project is licensed under the {}", "This project is licensed under {}", "This software is licensed under the {}", "This work is licensed under a {}", "This work is licensed under the {}",
    "The code is licensed under the {}", "SPDX-License-Identifier: {}",
)
GAP = 2
#: Sentences that may stand inside a rule: a copyright line often ends in them.
IGNORED = ("rights-reserved",)


def notices() -> tuple[list[tuple[str, str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of the notices of all LICENCES; a name gives one sentence for each pattern."""
    sentences = [(f"notice-{licence}", pattern.format(name)) for licence, names in LICENCES for name in names for pattern in NOTICES]
    # A long name is a notice by itself, as a title or a line of a list.
    sentences += [(f"notice-{licence}", name) for licence, names in LICENCES for name in names if "License" in name and name.count(" ") >= 2]
    return sentences, [(licence, (f"notice-{licence}",)) for licence, _ in LICENCES]


#: Clauses are cut at line ends, at a mark that white space follows, at a dash and before a bracket.
_SENTENCE = re.compile(r"(?<=[.!?:;,])\s+|\n+|\s+[-\u2013\u2014]\s+|\s+(?=\()")
_FIRST = re.compile(r"\W*([A-Za-z0-9.+]+)")
#: Clauses that end a sentence: their mark, or an empty line.
_FULL_STOP = re.compile(r"[.!?]\s*\Z")
_NOISE = re.compile(r"[^a-z0-9.+]+")
_YEARS = re.compile(r"\b(?:19|20)\d\d\b")
#: A line with an SPDX expression of more than one part.
_EXPRESSION = re.compile(r"\W*SPDX-License-Identifier:[ \t]*([^\n]*\b(?:AND|OR|WITH)\b[^\n]*)", re.IGNORECASE)
_OPERATORS = ("and", "or")


def normalised(sentence: str) -> str:
    s = _NOISE.sub(" ", _YEARS.sub(" ", sentence.lower()))
    return " ".join(w.strip(".") for w in s.split() if w.strip("."))


def clauses(text: str) -> list[tuple[int, int, bool]]:
    """Start and end of the clauses, and whether one ends its sentence."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start(), "\n\n" in m[0] or bool(_FULL_STOP.search(text, max(at, m.start() - 8), m.start()))))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text), True))
    return out


class Scanner:
    """The sentence table and the rules, ready for texts. A known sentence may span several clauses, so that wrapped lines and commas don't matter."""

    def __init__(self, sentences=None, rules=None, gap: int = GAP):
        own_sentences, own_rules = notices()
        sentences = SENTENCES + own_sentences if sentences is None else sentences
        self.gap, self.rules = gap, RULES + own_rules if rules is None else rules
        self.tree: dict = {}
        for name, wording in sentences:
            node = self.tree
            for word in normalised(wording).split():
                node = node.setdefault(word, {})
            node.setdefault(None, name)  # the first wording wins
        self.tags = {name.lower(): f"notice-{licence}" for licence, names in LICENCES for name in (licence, *names) if " " not in name}
        self.by_first: dict[str, list] = {}
        for number, (licence, wanted) in enumerate(self.rules):
            self.by_first.setdefault(wanted[0], []).append((number, licence, tuple(wanted)))

    def sentences(self, text: str) -> list[tuple[str | None, int, int, int]]:
        """(identifier, start, end, number of the sentence) of the known sentences in order; sentences between them have numbers too."""
        parts, number, held = clauses(text), 0, {}

        def may_begin(k: int) -> bool:
            first = _FIRST.match(text, *parts[k][:2])
            if first is None:
                return True
            word = first[1].lower().strip(".")
            return word in self.tree or not word or bool(_YEARS.fullmatch(word)) or not first[0].isascii()

        def words(k: int) -> list[str]:
            if k not in held:
                held[k] = normalised(text[parts[k][0] : parts[k][1]]).split()
            return held[k]

        out, i = [], 0
        tagged = "spdx-license-identifier" in text.lower()
        while i < len(parts):
            held.pop(i - 1, None)
            if tagged and (line := _EXPRESSION.match(text, parts[i][0])):
                out += [(name, parts[i][0], line.end(), number) for name in self.expression(line[1])]
                number += 1
                while i < len(parts) and parts[i][0] < line.end():
                    i += 1
                continue
            node, best, j = self.tree, None, i
            # The depth of the tree bounds the walk.
            while j < len(parts) and (j > i or may_begin(j)):
                for word in words(j):
                    node = node.get(word)
                    if node is None:
                        break
                if node is None:
                    break
                if None in node and words(j):
                    best = (node[None], j)
                j += 1
            if best:
                out.append((best[0], parts[i][0], parts[best[1]][1], number))
                held = {k: w for k, w in held.items() if k > best[1]}
                i, number = best[1] + 1, number + 1
            else:
                number += parts[i][2]
                i += 1
        return out

    def expression(self, text: str) -> list[str]:
        """Identifiers of the licences that an SPDX expression names; exceptions after WITH aren't licences."""
        words = re.findall(r"[A-Za-z0-9.+-]+", text)
        named = [w.lower() for w, before in zip(words, ["", *words]) if w.lower() not in (*_OPERATORS, "with") and before.lower() != "with"]
        return [self.tags[w] for w in named if w in self.tags]

    def _run(self, found: list, at: int, wanted: tuple[str, ...]) -> int | None:
        """The place after a rule that begins at a place, or None; ignored sentences inside it don't count as gaps."""
        last, skipped = found[at][3], 0
        at += 1
        for name in wanted[1:]:
            while at < len(found) and found[at][0] in IGNORED and found[at][0] != name:
                at, skipped = at + 1, skipped + 1
            if at == len(found) or found[at][0] != name or found[at][3] - last - 1 - skipped > self.gap:
                return None
            last, skipped = found[at][3], 0
            at += 1
        return at

    def scan(self, text: str) -> list[tuple[str, int, int, int, list[str]]]:
        """(licence, start, end, rule number, identifiers) of each match in order."""
        found = self.sentences(text)
        out, at = [], 0
        while at < len(found):
            for number, licence, wanted in self.by_first.get(found[at][0], ()):
                after = self._run(found, at, wanted)
                if after is not None:
                    out.append((licence, found[at][1], found[after - 1][2], number, list(wanted)))
                    at = after
                    break
            else:
                at += 1
        return out


_SCANNER: Scanner | None = None


def _scanner() -> Scanner:
    global _SCANNER
    _SCANNER = _SCANNER or Scanner()
    return _SCANNER


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and matches of every row: an array of (licence, start, end, rule, sentences), places in code points."""
    item = "struct<licence:string,start:int,end:int,rule:int,sentences:array<string>>"
    arrow = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32()), ("sentences", pa.list_(pa.string()))]))

    def run(batches):
        scanner = _scanner()
        for batch in slices(batches):
            rows = [[dict(zip(("licence", "start", "end", "rule", "sentences"), m)) for m in scanner.scan(t)] for t in utf8(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, arrow)], ["doc_id", "matches"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, matches array<{item}>")
