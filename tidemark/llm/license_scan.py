"""License detection by ordered signature rules.

A rule is (priority, label, confidence, keywords, regex). Over a hundred are sentences of license bodies and
notices (``BODIES``), each written by hand; the others combine the names and versions of each family in
``FAMILIES`` with the sentences that name a license. A rule's regex runs only over texts that hold one of its
keywords and, in a family, one of its names: without both it cannot match. A blank in a name, sentence or
body also stands for a line break with the comment marks around it. Matches of all rules are resolved in
order of priority: a match whose interval lies inside that of an accepted one, or around one, is dropped.

Base phrases (whole words, lower case) are counted beside the rules and always give their label.

Null and empty texts have no words, no places and no labels. Equal rows get equal results; other
columns than ``doc_id`` and ``text`` are not read. Without rows the result is empty.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textarrays import buffers

#: Base phrases and labels, as the contract of the query fixes them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What a blank in a pattern matches: white space, or the end of a line and what begins the next in a comment.
MARKS = r"#*/;%!>|<\-"
GAP = rf"(?:[^\S\n]*+(?:[{MARKS}]++[^\S\n]*+)?\n[\s{MARKS}]*+(?:(?:dnl|rem)\s++)?|\s++)"

#: label, names of the license as a regex, versions as regexes with the suffix each gives the label.
FAMILIES = (
    ("apache", r"apache(?: software)? licen[cs]e", "apache", {"": "", r"1\.0": "-1.0", r"1\.1": "-1.1", r"2(?:\.0)?": "-2.0"}),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|agpl", "affero agpl", {"": "", r"1(?:\.0)?": "-1.0", r"3(?:\.0)?": "-3.0"}),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|lgpl", "lesser library lgpl", {"": "", r"2(?:\.0)?": "-2.0", r"2\.1": "-2.1", r"3(?:\.0)?": "-3.0"}),
    ("gpl", r"gnu general public licen[cs]e|gnu gpl|gpl", "gpl gnu", {"": "", r"1(?:\.0)?": "-1.0", r"2(?:\.0)?": "-2.0", r"3(?:\.0)?": "-3.0"}),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", "documentation gfdl", {"": "", r"1\.1": "-1.1", r"1\.2": "-1.2", r"1\.3": "-1.3"}),
    ("mpl", r"mozilla public licen[cs]e|mpl", "mozilla mpl", {"": "", r"1\.0": "-1.0", r"1\.1": "-1.1", r"2(?:\.0)?": "-2.0"}),
    ("epl", r"eclipse public licen[cs]e|epl", "eclipse epl", {"": "", r"1(?:\.0)?": "-1.0", r"2(?:\.0)?": "-2.0"}),
    ("eupl", r"european union public licen[cs]e|eupl", "european eupl", {"": "", r"1\.1": "-1.1", r"1\.2": "-1.2"}),
    ("cddl", r"common development and distribution licen[cs]e|cddl", "distribution cddl", {"": "", r"1(?:\.0)?": "-1.0", r"1\.1": "-1.1"}),
    ("cpl", r"common public licen[cs]e", "common", {"": "", r"1(?:\.0)?": "-1.0"}),
    ("bsl", r"boost software licen[cs]e", "boost", {"": "", r"1(?:\.0)?": "-1.0"}),
    ("busl", r"business source licen[cs]e", "business", {"": "", r"1\.1": "-1.1"}),
    ("artistic", r"artistic licen[cs]e", "artistic", {"": "", r"1(?:\.0)?": "-1.0", r"2(?:\.0)?": "-2.0"}),
    ("osl", r"open software licen[cs]e", "open", {"": "", r"3(?:\.0)?": "-3.0"}),
    ("afl", r"academic free licen[cs]e", "academic", {"": "", r"3(?:\.0)?": "-3.0"}),
    ("zpl", r"zope public licen[cs]e", "zope", {"": "", r"2\.1": "-2.1"}),
    ("mit", r"mit(?:/x11)? licen[cs]e|expat licen[cs]e", "mit expat", {"": ""}),
    ("bsd-2-clause", r"(?:simplified|2-clause|two-clause|freebsd) bsd licen[cs]e|bsd-2-clause", "bsd", {"": ""}),
    ("bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause) bsd licen[cs]e|bsd-3-clause", "bsd", {"": ""}),
    ("bsd", r"bsd(?:-style)? licen[cs]e", "bsd", {"": ""}),
    ("isc", r"isc licen[cs]e", "isc", {"": ""}),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", {"": ""}),
    ("unlicense", r"the unlicense", "unlicense", {"": ""}),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", "wtfpl fuck", {"": "", "2": "-2"}),
    ("psf", r"python software foundation licen[cs]e", "python", {"": "", "2": "-2"}),
    ("cc-by-nc-nd", r"creative commons attribution.noncommercial.noderivatives|cc.by.nc.nd", "commons cc", {"": "", r"3\.0": "-3.0", r"4\.0": "-4.0"}),
    ("cc-by-nc-sa", r"creative commons attribution.noncommercial.sharealike|cc.by.nc.sa", "commons cc", {"": "", r"3\.0": "-3.0", r"4\.0": "-4.0"}),
    ("cc-by-nc", r"creative commons attribution.noncommercial|cc.by.nc", "commons cc", {"": "", r"3\.0": "-3.0", r"4\.0": "-4.0"}),
    ("cc-by-sa", r"creative commons attribution.sharealike|cc.by.sa", "commons cc", {"": "", r"2\.0": "-2.0", r"3\.0": "-3.0", r"4\.0": "-4.0"}),
    ("cc-by-nd", r"creative commons attribution.noderivatives|cc.by.nd", "commons cc", {"": "", r"3\.0": "-3.0", r"4\.0": "-4.0"}),
    ("cc-by", r"creative commons attribution|cc.by", "commons cc", {"": "", r"2\.0": "-2.0", r"3\.0": "-3.0", r"4\.0": "-4.0"}),
    ("cc0", r"creative commons zero|cc0", "commons cc0", {"": "", r"1\.0": "-1.0"}),
)
#: Sentences that name a license: priority, confidence, text before and after the name.
SENTENCES = (
    (10, 0.99, r"spdx-license-identifier:\s*", ""),
    (20, 0.98, r"(?:is |are )?(?:re)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?", ""),
    (20, 0.97, r"(?:re)?(?:leased|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?", ""),
    (30, 0.95, r"under the terms (?:and conditions )?of the ", ""),
    (30, 0.93, r"subject to the (?:terms of the )?", ""),
    (30, 0.93, r"(?:copy of|see) the ", ""),
    (40, 0.90, r"licen[cs]e\s*[:=]\s*(?:the )?[\"']?", ""),
)
#: Short names that stand for a license only after ``spdx-license-identifier:`` or ``license:``, and their labels.
SHORT = {
    "mit": "mit", "mit-0": "mit-0", "bsd": "bsd", "isc": "isc", "0bsd": "0bsd", "zlib": "zlib", "unlicense": "unlicense", "apache": "apache", "apache-1.1": "apache-1.1", "apache-2.0": "apache-2.0", "bsl-1.0": "bsl-1.0",
    "artistic-2.0": "artistic-2.0", "psf-2.0": "psf-2", "osl-3.0": "osl-3.0", "afl-3.0": "afl-3.0", "zpl-2.1": "zpl-2.1", "busl-1.1": "busl-1.1", "cpl-1.0": "cpl-1.0",
}
INTRODUCED = ((10, 0.99, "spdx-license-identifier", r"spdx-license-identifier:\s*"), (40, 0.90, "license", r"license\s*[:=]\s*[\"']?"), (40, 0.90, "licence", r"licence\s*[:=]\s*[\"']?"))
#: License bodies and notices: label, confidence, keyword, a sentence that only these texts have.
Q = "[\"'\u201c\u201d\u2018\u2019]{0,2}"
BODIES = (
    ("mit", 0.95, "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 0.90, "sublicense", r"to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", 0.80, "substantial", r"(?:this|the above copyright notice and this) permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 0.75, "warranty", rf"the software is provided {Q}as is{Q}, without warranty of any kind, express or implied"),
    ("mit-0", 0.85, "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the .{0,2}software.{0,2}\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software"),
    ("isc", 0.95, "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("isc", 0.85, "disclaims", rf"the software is provided {Q}as is{Q} and (?:the author|isc) disclaims all warranties"),
    ("0bsd", 0.90, "permission", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("bsd", 0.90, "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", 0.85, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 0.85, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 0.80, "warranties", rf"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? {Q}as is{Q} and any express or implied warranties"),
    ("bsd-3-clause", 0.95, "endorse", r"neither the name of [\s\S]{1,160}? nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", 0.95, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", 0.90, "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("apache-2.0", 0.95, "applicable", rf"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an {Q}as is{Q} basis"),
    ("apache-2.0", 0.95, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 0.95, "apache.org", r"www\.apache\.org/licenses/license-2\.0"),
    ("apache-2.0", 0.98, "january", r"apache license version 2\.0, january 2004"),
    ("apache-2.0", 0.85, "perpetual", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-1.1", 0.90, "foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", 0.92, "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 0.85, "received", r"you should have received a copy of the gnu general public licen[cs]e along with"),
    ("gpl", 0.80, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[cs]e"),
    ("gpl-1.0", 0.97, "february", r"gnu general public licen[cs]e version 1, february 1989"),
    ("gpl-2.0", 0.98, "june", r"gnu general public licen[cs]e version 2, june 1991"),
    ("gpl-3.0", 0.98, "june", r"gnu general public licen[cs]e version 3, 29 june 2007"),
    ("gpl-2.0", 0.90, "option", r"either version 2 of the licen[cs]e, or \(at your option\) any later version"),
    ("gpl-3.0", 0.90, "option", r"either version 3 of the licen[cs]e, or \(at your option\) any later version"),
    ("gpl-3.0", 0.85, "copyleft", r"the gnu general public licen[cs]e is a free, copyleft license for software and other kinds of works"),
    ("gpl-2.0", 0.85, "take", r"the licenses for most software are designed to take away your freedom to share and change it\. by contrast, the gnu general public"),
    ("gpl-2.0", 0.80, "linking", r"linking [\s\S]{1,80}? statically or dynamically with other modules is making a combined work"),
    ("lgpl", 0.92, "lesser", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("lgpl-2.0", 0.92, "library", r"you can redistribute it and/or modify it under the terms of the gnu library general public licen[cs]e"),
    ("lgpl-2.0", 0.98, "june", r"gnu library general public licen[cs]e version 2, june 1991"),
    ("lgpl-2.1", 0.98, "february", r"gnu lesser general public licen[cs]e version 2\.1, february 1999"),
    ("lgpl-3.0", 0.98, "june", r"gnu lesser general public licen[cs]e version 3, 29 june 2007"),
    ("lgpl-3.0", 0.85, "incorporates", r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("agpl", 0.92, "affero", r"you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("agpl-3.0", 0.98, "november", r"gnu affero general public licen[cs]e version 3, 19 november 2007"),
    ("agpl-3.0", 0.85, "remotely", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", 0.90, "invariant", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl-1.3", 0.97, "november", r"gnu free documentation licen[cs]e version 1\.3, 3 november 2008"),
    ("gfdl-1.2", 0.97, "november", r"gnu free documentation licen[cs]e version 1\.2, november 2002"),
    ("mpl-2.0", 0.97, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0"),
    ("mpl-1.1", 0.95, "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("mpl-2.0", 0.85, "incompatible", rf"this source code form is {Q}incompatible with secondary licenses{Q}"),
    ("mpl", 0.80, "mozilla.org", r"you can obtain one at https?://(?:www\.)?mozilla\.org/mpl"),
    ("epl-1.0", 0.95, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1\.0"),
    ("epl-2.0", 0.95, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v\. )?2\.0"),
    ("epl", 0.85, "accompanying", rf"accompanying program is provided under the terms of this eclipse public licen[cs]e \({Q}agreement{Q}\)"),
    ("cpl-1.0", 0.90, "common", rf"the accompanying program is provided under the terms of this common public licen[cs]e \({Q}agreement{Q}\)"),
    ("cddl-1.0", 0.92, "development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("bsl-1.0", 0.97, "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", 0.90, "machine-executable", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("busl-1.1", 0.85, "production", r"make non-production use of the licensed work"),
    ("artistic", 0.85, "artistic", r"the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", 0.90, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms under which a given free software package may be copied"),
    ("psf-2", 0.92, "psf", rf"psf is making python available to licensee on an {Q}as is{Q} basis"),
    ("psf-2", 0.90, "python", r"this license agreement is between the python software foundation"),
    ("zlib", 0.93, "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", 0.88, "warranty", rf"this software is provided {Q}as-is{Q}, without any express or implied warranty\. in no event will the authors be held liable"),
    ("zlib", 0.85, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("libpng", 0.88, "reference", r"the png reference library is supplied"),
    ("unlicense", 0.95, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", 0.90, "dedication", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs"),
    ("wtfpl", 0.95, "fuck", r"you just do what the fuck you want to"),
    ("cc0-1.0", 0.95, "waived", r"to the extent possible under law, [\s\S]{1,120}? has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 0.95, "universal", r"cc0 1\.0 universal"),
    ("cc-by-4.0", 0.92, "commons", r"this work is licensed under (?:a|the) creative commons attribution 4\.0 international license"),
    ("cc-by-sa-4.0", 0.92, "commons", r"this work is licensed under (?:a|the) creative commons attribution-sharealike 4\.0 international license"),
    ("cc-by-nc-4.0", 0.92, "commons", r"this work is licensed under (?:a|the) creative commons attribution-noncommercial 4\.0 international license"),
    ("cc-by", 0.85, "creativecommons.org", r"creativecommons\.org/licenses/by/[0-9.]+"),
    ("cc-by-sa", 0.85, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[0-9.]+"),
    ("cc-by-nc", 0.85, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[0-9.]+"),
    ("cc-by-nd", 0.85, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/[0-9.]+"),
    ("cc-by-nc-sa", 0.85, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/[0-9.]+"),
    ("cc-by-nc-nd", 0.85, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/[0-9.]+"),
    ("cc0-1.0", 0.85, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("ofl-1.1", 0.95, "font", r"this font software is licensed under the sil open font licen[cs]e, version 1\.1"),
    ("ofl-1.1", 0.90, "font", r"the fonts, including any derivative works, can be bundled, embedded, redistributed and/or sold with any software"),
    ("openssl", 0.92, "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0.90, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("ms-pl", 0.90, "governs", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("ncsa", 0.88, "illinois", r"university of illinois/ncsa open source licen[cs]e"),
    ("w3c", 0.90, "w3c", r"w3c software (?:notice and|and document) (?:license|notice)"),
    ("x11", 0.85, "consortium", r"the name of the x consortium shall not be used in advertising or otherwise to promote"),
    ("hpnd", 0.85, "permission", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("curl", 0.88, "permission", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", 0.88, "california", r"in no event shall the university of california be liable to any party for direct, indirect, special, incidental, or consequential damages"),
    ("ruby", 0.85, "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("vim", 0.85, "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("icu", 0.85, "icu", r"icu 1\.8\.1 and later"),
    ("unicode", 0.88, "unicode", r"unicode license v3"),
    ("json", 0.92, "evil", r"the software shall be used for good, not evil"),
    ("beerware", 0.92, "beer", r"you can buy me a beer in return"),
    ("sspl-1.0", 0.92, "server", r"server side public licen[cs]e version 1, october 16, 2018"),
    ("elastic-2.0", 0.92, "elastic", r"elastic licen[cs]e 2\.0"),
    ("commons-clause", 0.90, "clause", r"commons clause.{0,3} license condition"),
    ("llama", 0.85, "llama", r"llama [0-9.]+ community licen[cs]e agreement"),
    ("openrail", 0.85, "rail", r"(?:creativeml|bigscience|bigcode)(?: |-)open ?rail"),
    ("public-domain", 0.80, "domain", r"(?:is|placed|released) (?:in|into|to) the public domain"),
    ("proprietary", 0.70, "reserved", r"all rights reserved"),
    ("proprietary", 0.75, "confidential", r"proprietary and confidential"),
    ("proprietary", 0.85, "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|program|document),? (?:via any medium )?is (?:strictly )?prohibited"),
    ("proprietary", 0.80, "permission", r"may not be (?:reproduced|copied|distributed)[\s\S]{0,60}? without (?:the )?(?:prior )?(?:express )?written permission"),
)


class Rule(NamedTuple):
    priority: int
    label: str
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]
    family: str | None


class Group(NamedTuple):
    """Rules that share their keywords and a pattern that each of their matches holds."""

    keywords: tuple[str, ...]
    need: re.Pattern[str] | None
    rules: tuple[int, ...]


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    confidence: float


def loose(pattern: str) -> str:
    """The pattern with its blanks as gaps, and its optional blanks as optional gaps."""
    return pattern.replace(r"\s*", " ?").replace(" ", GAP)


def loose_names(names: str) -> str:
    """So too; their dots stand for a hyphen, a gap, both or any other sign."""
    return loose(names.replace(".", "(?:- | |.)"))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the most specific first: a sentence with a version before one without."""
    made = []
    for (label, names, keys, versions), (priority, confidence, before, after) in product(FAMILIES, (*SENTENCES, (60, 0.6, "", ""))):
        for version, suffix in versions.items():
            tail = rf",?{GAP}?(?:(?:\({GAP}?)?(?:version|ver\.?|v\.?){GAP}?|-{GAP}?)?{version}(?![0-9.]*[0-9])" if version else ""
            made.append(Rule(priority - 5 * bool(version), label + suffix, confidence, tuple(keys.split()), re.compile(rf"(?<![a-z0-9]){loose(before)}(?:{loose_names(names)}){tail}{after}(?![a-z0-9])"), label))
    made += [Rule(priority, label, confidence, (key,), re.compile(rf"(?<![a-z0-9]){loose(before)}{re.escape(name)}(?![a-z0-9]|[.+-][a-z0-9])"), None) for name, label in SHORT.items() for priority, confidence, key, before in INTRODUCED]
    made += [Rule(15, label, confidence, (key,), re.compile(loose(sentence)), None) for label, confidence, key, sentence in BODIES]
    return tuple(sorted(made, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def groups() -> tuple[Group, ...]:
    """A group for each family, and one for each body."""
    found = []
    for label, names, keys, _ in FAMILIES:
        found.append(Group(tuple(keys.split()), re.compile(rf"(?<![a-z0-9])(?:{loose_names(names)})"), tuple(k for k, r in enumerate(rules()) if r.family == label)))
    return (*found, *(Group(r.keywords, None, (k,)) for k, r in enumerate(rules()) if r.family is None))


@lru_cache(maxsize=1)
def prefilter() -> ahocorasick.Automaton:
    """Keyword to the numbers of its groups."""
    gates: dict[str, list[int]] = {}
    for k, group in enumerate(groups()):
        for word in group.keywords:
            gates.setdefault(word, []).append(k)
    machine = ahocorasick.Automaton()
    for word, numbers in gates.items():
        machine.add_word(word, tuple(numbers))
    machine.make_automaton()
    return machine


def open_rules(lowered: str) -> set[int]:
    """Numbers of the rules that can match in a lower-cased text."""
    hit = {k for numbers in {numbers for _, numbers in prefilter().iter(lowered)} for k in numbers}
    return {r for k in hit for group in [groups()[k]] if group.need is None or group.need.search(lowered) for r in group.rules}


def detect(lowered: str, numbers: set[int]) -> list[Detection]:
    """Accepted matches of these rules in a lower-cased text, by start.

    No accepted match holds another, so their ends ascend like their starts and two looks by bisection tell
    whether a match lies in an accepted one or around one.
    """
    accepted: list[Detection] = []
    for k in sorted(numbers):  # the order of rules() is that of priority
        rule, starts = rules()[k], [d.start for d in accepted]
        new = []
        for m in rule.pattern.finditer(lowered):
            before, after = bisect_right(starts, m.start()) - 1, bisect_left(starts, m.start())
            inside = before >= 0 and accepted[before].end >= m.end()
            around = after < len(accepted) and accepted[after].end <= m.end()
            if not (inside or around):
                new.append(Detection(m.start(), m.end(), rule.label, rule.confidence))
        if new:
            accepted = sorted(accepted + new)
    return accepted


#: Lower-cases A-Z; all other ASCII but digits and letters becomes a space.
WORDS = bytes.maketrans(bytes(range(128)), bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<start:long,end:long,label:string,confidence:double>>"
)


def places(words: list[bytes]) -> tuple[list[int], list[str]]:
    """Starts of the base phrases, and their labels."""
    starts, labels = [], []
    if b"license" in words:
        for phrase, label in PHRASES.items():
            parts = phrase.encode().split()
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    starts.append(at)
                    labels.append(label)
    return starts, labels


def scan_text(text: bytes) -> tuple:
    lowered = text.translate(LOWER)
    words = text.translate(WORDS).split()
    starts, base = places(words)
    plain = lowered.decode()
    found = detect(plain, open_rules(plain))
    missed = 1.0
    for d in found:
        missed *= 1 - d.confidence
    score = max(1 - missed, 0.9 if starts else 0.0)
    labels = sorted({*base, *(d.label for d in found)})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(set(base))), ",".join(labels), score, [d._asdict() for d in found]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
         ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])))]
    )
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        raw, offsets = memoryview(data), offsets.tolist()
        rows = [scan_text(bytes(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, base places and labels, labels of all rules, score and detections: a row for each row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
