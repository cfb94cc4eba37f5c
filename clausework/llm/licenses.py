"""Licence recognition by known sentences and ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licences and notices, as published.
SENTENCES: Mapping[str, str] = {
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-header-1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-header-3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-header-4": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-header-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-header-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-header-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-header-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "unlicense-release": "This is free and unencumbered software released into the public domain.",
    "unlicense-freedom": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights": "All rights reserved under license.",
    "all-rights-line": "All rights reserved.",
    "gpl-header-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-header-3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl3-text-1": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl3-text-2": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "gpl2-text-1": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl2-text-2": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl2.1-text": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "lgpl3-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "apache-text-1": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "apache-text-2": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "mpl-text-1": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
    "mpl-text-2": "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
    "classpath-1": "Linking this library statically or dynamically with other modules is making a combined work based on this library.",
    "classpath-2": "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules, and to copy and distribute the resulting executable under terms of your choice, provided that you also meet, for each linked independent module, the terms and conditions of the license of that module.",
    "gcc-runtime": "Under Section 7 of GPL version 3, you are granted additional permissions described in the GCC Runtime Library Exception, version 3.1, as published by the Free Software Foundation.",
}
#: (rule, licence, sentences in order); other sentences may stand between them.
RULES: Sequence[tuple[str, str, tuple[str, ...]]] = (
    ("apache-2.0-reference", "Apache-2.0", ("apache-line",)),
    ("apache-2.0-header", "Apache-2.0", ("apache-header-1", "apache-header-3", "apache-header-4")),
    ("mit-reference", "MIT", ("mit-line",)),
    ("mit-licensed-reference", "MIT", ("mit-licensed",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("gpl-3.0-reference", "GPL-3.0", ("gpl3-line",)),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-header-3", "gpl-warranty")),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("gpl-header-2", "gpl-warranty")),
    ("gpl-3.0-header-with-copy", "GPL-3.0-or-later", ("gpl-header-3", "gpl-warranty", "gpl-copy")),
    ("gpl-2.0-header-with-copy", "GPL-2.0-or-later", ("gpl-header-2", "gpl-warranty", "gpl-copy")),
    ("gpl-2.0-only-header", "GPL-2.0-only", ("gpl-header-2-only", "gpl-warranty")),
    ("gpl-3.0-only-header", "GPL-3.0-only", ("gpl-header-3-only", "gpl-warranty")),
    ("gpl-2.0-header-with-classpath", "GPL-2.0-or-later WITH Classpath-exception-2.0", ("gpl-header-2", "gpl-warranty", "classpath-1", "classpath-2")),
    ("gpl-2.0-only-header-with-classpath", "GPL-2.0-only WITH Classpath-exception-2.0", ("gpl-header-2-only", "gpl-warranty", "classpath-1", "classpath-2")),
    ("gpl-3.0-header-with-gcc-runtime", "GPL-3.0-or-later WITH GCC-exception-3.1", ("gpl-header-3", "gpl-warranty", "gcc-runtime")),
    ("gpl-3.0-text", "GPL-3.0", ("gnu-verbatim", "gpl3-text-1", "gpl3-text-2")),
    ("gpl-2.0-text", "GPL-2.0", ("gnu-verbatim", "gpl2-text-1", "gpl2-text-2")),
    ("lgpl-2.1-text", "LGPL-2.1", ("gnu-verbatim", "gpl2-text-1", "lgpl2.1-text")),
    ("lgpl-3.0-text", "LGPL-3.0", ("gnu-verbatim", "lgpl3-text")),
    ("agpl-3.0-text", "AGPL-3.0", ("gnu-verbatim", "agpl3-text", "gpl3-text-2")),
    ("apache-2.0-text", "Apache-2.0", ("apache-text-1", "apache-text-2")),
    ("mpl-2.0-text", "MPL-2.0", ("mpl-text-1", "mpl-text-2")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl-header-2.1", "lgpl-warranty")),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", ("lgpl-header-3",)),
    ("agpl-3.0-header", "AGPL-3.0-or-later", ("agpl-header-3",)),
    ("mpl-2.0-notice", "MPL-2.0", ("mpl-notice",)),
    ("mpl-2.0-notice-with-copy", "MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("epl-2.0-notice", "EPL-2.0", ("epl-notice",)),
    ("cc0-1.0-dedication", "CC0-1.0", ("cc0-dedication",)),
    ("unlicense-text", "Unlicense", ("unlicense-release", "unlicense-freedom")),
    ("zlib-text", "Zlib", ("zlib-warranty", "zlib-grant")),
    ("bsl-1.0-text", "BSL-1.0", ("bsl-grant",)),
    ("isc-text", "ISC", ("isc-grant",)),
    ("cc-by-nc-4.0-reference", "CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("cc-by-4.0-reference", "CC-BY-4.0", ("cc-by-line",)),
    ("cc-by-sa-4.0-reference", "CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("cc-by-work",)),
    ("all-rights-under-license-line", "All-Rights-Reserved", ("all-rights",)),
    ("all-rights-reserved-line", "All-Rights-Reserved", ("all-rights-line",)),
)


def cues(sentences: Mapping[str, str] = SENTENCES) -> str:
    """A pattern of words of which every known sentence holds one, so that a text without them is passed over."""
    left = {name: set(re.findall(r"[a-z0-9]+", text.lower())) for name, text in sentences.items()}
    chosen = []
    while left := {name: words for name, words in left.items() if words}:
        usable = [w for words in left.values() for w in words if len(w) >= min(7, max(map(len, words)))]
        chosen.append(max(sorted(set(usable)), key=lambda w: (usable.count(w), len(w))))
        left = {name: words for name, words in left.items() if chosen[-1] not in words}
    return "(?i)" + "|".join(chosen)


CUES = cues()
#: In the SQL a sentence ends at a stop, mark or colon before white space, and at a line's end.
END_MARK = r"([.!?:])[\x20\t\r\x0B\f]+"
#: Steps to words in lower case with one mark between them: \x01 where a sentence can end (a stop, mark
#: or colon before white space, or a blank line), else a line's end, else a space.
STEPS = (
    (r"[.!?:](?=[\x20\t\r\x0B\f\n])", "\x01"),
    (r"\n[^a-z0-9\x01]*\n", "\x01"),
    (r"[^a-z0-9\x01\n]+", " "),
    (r" ?\n ?", "\n"),
    (r"[ \n]*\x01[ \n\x01]*", "\x01"),
    (r"^[ \n\x01]+|[ \n\x01]+$", ""),
)


def longer_rules(rules: Sequence[tuple[str, str, tuple[str, ...]]]) -> dict[str, list[tuple[str, ...]]]:
    """For each rule the sequences of the rules that hold all of its sentences in order and more, the longest first."""

    def within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
        rest = iter(long)
        return len(short) < len(long) and all(i in rest for i in short)

    return {name: sorted((b for _, _, b in rules if within(ids, b)), key=len, reverse=True) for name, _, ids in rules}


def _marks(ids: tuple[str, ...]) -> str:
    """The identifiers in order, whatever stands between them, as a pattern."""
    return ".*?".join("<" + re.escape(i).replace("\\-", "-") + ">" for i in ids)


def normalized(sentence: str) -> str:
    """Lower-case letters and digits, single spaces."""
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(out.split())


def _pieces(sentence: str) -> list[str]:
    """A known sentence as the text's splitting cuts it."""
    return [normalized(p) for p in re.split(r"\n", re.sub(END_MARK, r"\1\n", sentence)) if normalized(p)]


def sentence_ids(sentences: Mapping[str, str] = SENTENCES) -> dict[str, str]:
    """For the SQL: normalized sentence -> identifier; of a sentence that splitting cuts, the last piece stands for all."""
    return {_pieces(text)[-1]: name for name, text in sentences.items()}


def _marked(sentence: str) -> str:
    """A known sentence after STEPS, its line ends as spaces."""
    out = sentence.lower()
    for pattern, mark in STEPS:
        out = re.sub(pattern, mark, out)
    return out.replace("\n", " ")


def _known(text: Column, sentences: Mapping[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; the longest where several begin.

    A sentence begins and ends at a line's or sentence's end, and can be wrapped between any words.
    """
    ids = {_marked(known): name for name, known in sentences.items()}
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    out = F.lower(text)
    for pattern, mark in STEPS:
        out = F.regexp_replace(out, pattern, mark)
    either = "|".join(s.replace(" ", "[ \n]") for s in sorted(ids, key=len, reverse=True))
    found = F.regexp_extract_all(out, F.lit(rf"(?<![^\x01\n])(?:{either})(?![^\x01\n])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))


def find_licenses(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES) -> DataFrame:
    """Licences stated in the texts of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row and rule that matches: doc_id, license, rule, n_sentences (known
    licence sentences in the text, of any licence), sentence_ids (their identifiers in order,
    joined by a space). A rule matches if its identifiers occur in its order, others may stand
    between them. The longest rule wins: a rule whose sentences are part of a longer rule has to match
    what is left without the longer rule's matches, so that a BSD-3 text is no BSD-2 text.

    Null and empty texts match nothing; repeated rows each give their rows; an empty table gives
    no rows. A map over the documents without Python and without a shuffle.
    """
    named = docs.where(F.col("text").rlike(cues(sentences))).select("doc_id", _known(F.col("text"), sentences).alias("ids")).where(F.size("ids") > 0)
    joined = named.select("doc_id", F.size("ids").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("_marked"))
    longer = longer_rules(rules)

    def matches(name: str, ids: tuple[str, ...]) -> Column:
        left = F.col("_marked")
        for other in longer[name]:
            left = F.regexp_replace(left, _marks(other), "")
        return left.like("%" + "%".join(f"<{i}>" for i in ids) + "%")

    hits = F.filter(F.array(*[F.when(matches(name, ids), F.struct(F.lit(name).alias("rule"), F.lit(license).alias("license"))) for name, license, ids in rules]), lambda x: x.isNotNull())
    return joined.withColumn("hit", F.explode(hits)).select("doc_id", F.col("hit.license").alias("license"), F.col("hit.rule").alias("rule"), "n_sentences", "sentence_ids")


def longer_marks(others: Sequence[tuple[str, ...]]) -> str:
    return "|".join(_marks(b) for b in others)


def oracle_sql(sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES) -> str:
    """The same over a table documents, in DuckDB's SQL."""
    known = ", ".join(f"('{s}', '{name}')" for s, name in sentence_ids(sentences).items())
    longer = longer_rules(rules)
    # what the longer rules take away, as one alternation in their order
    ruled = ", ".join(f"('{name}', '{license}', '%{'%'.join(f'<{i}>' for i in ids)}%', '{longer_marks(longer[name])}')" for name, license, ids in rules)
    return rf"""
with known(sentence, id) as (values {known}), rules(rule, license, pattern, longer) as (values {ruled}),
d as (
  select row_number() over () as r, doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?:])[ \t\r\x0B\f]+', '\1' || chr(10), 'g'), chr(10))) as s,
    generate_subscripts(string_split(regexp_replace(lower(text), '([.!?:])[ \t\r\x0B\f]+', '\1' || chr(10), 'g'), chr(10)), 1) as k
  from documents where regexp_matches(text, '{CUES}')),
n as (select r, doc_id, k, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) as s from d),
i as (select r, doc_id, count(*) as n_sentences, string_agg(id, ' ' order by k) as sentence_ids, string_agg('<' || id || '>', '' order by k) as marked from n join known on s = sentence group by r, doc_id)
select doc_id, license, rule, cast(n_sentences as integer) as n_sentences, sentence_ids from i join rules on (case when longer = '' then marked else regexp_replace(marked, longer, '', 'g') end) like pattern"""
