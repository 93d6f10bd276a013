"""Operator 7: licence scan by template-markup matching.

A template is a licence notice as running text with two kinds of markup: ``[[ ... ]]`` is an optional part, ``<<n>>`` stands
for up to n words of any kind (names, years, addresses). It is compiled into an automaton over words; a text is
accepted from a place on if all mandatory words follow in order, and the longest acceptance counts. Texts are read as
lower-cased words, so line breaks, comment marks and punctuation don't matter. Automata start only where the template's
first words stand (every template begins with ANCHOR mandatory words at least), so other places cost a substring search.

Beside the templates there are the base phrases, each with a label: all places where the words of one stand in a row.

Result, struct ``out``: ``n_words``, ``places`` (array of word offset, sorted), ``base_labels``, ``labels`` (sorted arrays), ``found`` (array
of label, start, end of accepted templates), ``score`` (share of the words inside phrases and accepted templates, 0 to 1).
Defined cases: a null or empty text has no words, no labels and score 0.0; a phrase or template that occurs
several times is listed at each place; overlapping templates of one label count by their own places.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import alnum_words, chunks, table, utf8

ANCHOR = 2
# Fixed by the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_TAIL = "this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed [[in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage]]"
_GNU_TAIL = "[[this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details [[you should have received a copy of the gnu general public license along with this program if not see <<8>>]]]]"
_GRANT = "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"
# Wording of public licence notices and bodies (fixed values).
TEMPLATES = (
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[{_WARRANTY}]]"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [[the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]]"),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause", f"{_BSD_HEAD} [[3]] neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [[{_BSD_TAIL}]]"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis]]"),
    ("gpl-2-or-later", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version {_GNU_TAIL}"),
    ("gpl-3-or-later", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version {_GNU_TAIL}"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license [[as published by the free software foundation]]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at <<6>>]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means]]"),
    ("apache-2", f"subject to the terms and conditions of this license {_GRANT} copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2", f"subject to the terms and conditions of this license {_GRANT} except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work"),
    ("apache-2", "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("mpl-2", "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights [[other than patent or trademark]] licensable by such contributor to use reproduce make available modify display perform distribute and otherwise exploit its contributions"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("gpl-2", "spdx license identifier gpl 2 0 [[only]]"),
    ("gpl-3", "spdx license identifier gpl 3 0 [[only]]"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("cc0", "cc0 1 0 [[universal]]"),
    ("cc-by", "cc by 4 0"),
    ("cc-by-sa", "cc by sa [[4 0]]"),
    ("cc-by-nc", "cc by nc [[4 0]]"),
    ("cc-by-nc-sa", "cc by nc sa [[4 0]]"),
    ("cc-by-nc-nd", "cc by nc nd [[4 0]]"),
    ("cc-by", "creative commons attribution [[4 0]] [[international]] license"),
    ("cc-by-nc", "creative commons attribution noncommercial [[4 0]] [[international]] license"),
    ("cc-by-sa", "creative commons attribution sharealike [[4 0]] [[international]] license"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("apache-2", "released under the [[terms of the]] apache license [[version]] 2 0"),
)


class Automaton:
    """States are numbers; state k waits for tokens[k] (a word, None for any word) and goes to k + 1, or skips to each of skips[k]."""

    def __init__(self, label: str, template: str):
        self.label, self.tokens = label, []
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        for part in template.replace("[[", " [[ ").replace("]]", " ]] ").split():
            if part == "[[":
                opened.append(len(self.tokens))
            elif part == "]]":
                skips.append((opened.pop(), len(self.tokens)))
            elif part.startswith("<<"):
                start, n = len(self.tokens), int(part[2:-2])
                self.tokens += [None] * n
                skips += [(start + k, start + n) for k in range(n)]
            else:
                self.tokens += alnum_words(part.encode())
        if opened or min((a for a, _ in skips), default=ANCHOR) < ANCHOR or len(self.tokens) < ANCHOR:
            raise ValueError(f"a template must close its markup and begin with {ANCHOR} mandatory words: {template}")
        self.skips: dict[int, list[int]] = {}
        for a, b in skips:
            self.skips.setdefault(a, []).append(b)
        first = min((a for a, _ in skips), default=len(self.tokens))
        self.anchor = b" " + b" ".join(self.tokens[:first]) + b" "

    def _open(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for b in self.skips.get(todo.pop(), ()):
                if b not in states:
                    states.add(b)
                    todo.append(b)
        return states

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from `start`, or None."""
        states, end, at = self._open({0}), None, start
        while states:
            if len(self.tokens) in states:
                end = at
            if at == len(words):
                break
            w = words[at]
            states = self._open({k + 1 for k in states if k < len(self.tokens) and self.tokens[k] in (None, w)})
            at += 1
        return end


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]):
        self.phrases = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases.items()]
        self.automata = [Automaton(*t) for t in templates]
        self.anchors: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            self.anchors.setdefault(a.anchor, []).append(a)

    @staticmethod
    def _places(line: bytes, what: bytes) -> list[int]:
        """Word offsets of `what`, given a line of words with one space around each."""
        out, at, word, seen = [], line.find(what), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            out.append(word)
            at = line.find(what, at + 1)
        return out

    def scan(self, text: bytes | None) -> dict:
        words = alnum_words(text or b"")
        line = b" " + b" ".join(words) + b" "
        places, base, found, covered = [], set(), [], []
        for phrase, size, label in self.phrases:
            for p in self._places(line, phrase):
                places.append(p)
                base.add(label)
                covered.append((p, p + size))
        for anchor, automata in self.anchors.items():
            for p in self._places(line, anchor):
                for a in automata:
                    end = a.accepts(words, p)
                    if end is not None:
                        found.append({"label": a.label, "start": p, "end": end})
                        covered.append((p, end))
        inside = last = 0
        for s, e in sorted(covered):
            inside += max(0, e - max(s, last))
            last = max(last, e)
        return {"n_words": len(words), "places": sorted(places), "base_labels": sorted(base), "labels": sorted(base | {f["label"] for f in found}), "found": sorted(found, key=lambda f: (f["start"], f["end"], f["label"])), "score": round(inside / len(words), 6) if words else 0.0}


_FOUND = T.StructType().add("label", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
_RESULT = T.StructType().add("n_words", T.LongType()).add("places", T.ArrayType(T.LongType())).add("base_labels", T.ArrayType(T.StringType())).add("labels", T.ArrayType(T.StringType())).add("found", T.ArrayType(_FOUND)).add("score", T.DoubleType())
_ARROW = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("score", pa.float64())])


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, out: str = "license") -> DataFrame:
    """`docs` with the struct column `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))  # as large as the templates

    @F.arrow_udf(_RESULT)
    def scanned(column: pa.Array) -> pa.Array:
        texts, found = utf8(column), []
        for a, b in chunks(texts):
            found += [shared.value.scan(t) for t in texts[a:b]]
        return pa.array(found, _ARROW)

    return docs.withColumn(out, scanned(F.col(text)))


def op7(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", "license.n_words", F.size("license.places").cast("long").alias("n_base"), F.array_min("license.places").alias("first_word"), F.array_max("license.places").alias("last_word"),
        F.array_join("license.base_labels", ",").alias("base_labels"), F.array_join("license.labels", ",").alias("labels"), "license.score",
    )
