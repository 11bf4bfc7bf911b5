"""License scanning by ordered signature rules.

A text becomes its lower-case words joined by single blanks. Rules are regular expressions over that line,
ordered by priority; a rule runs only where its keyword occurs, a part of every match, which most texts fail at once. Of two
detections, one inside the other's interval is suppressed, unless it alone has the higher priority.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillstack.llm.arrow_text import map_texts

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: License families: label, names (alternatives, each the keyword of its own rules), versions. Names are written as the line has them.
FAMILIES = [
    ("apache", ["apache", "apache software"], ["2 0", "1 1", "1 0"]),
    ("mit", ["mit", "expat"], []),
    ("bsd-3-clause", ["bsd 3 clause", "new bsd", "modified bsd", "revised bsd"], []),
    ("bsd-2-clause", ["bsd 2 clause", "simplified bsd", "freebsd"], []),
    ("bsd-4-clause", ["bsd 4 clause", "original bsd"], []),
    ("bsd", ["bsd"], []),
    ("gpl", ["gpl", "gnu gpl"], ["3 0", "2 0", "1 0", "3", "2", "1"]),
    ("lgpl", ["lgpl", "gnu lgpl"], ["3 0", "2 1", "2 0", "3", "2"]),
    ("agpl", ["agpl", "gnu agpl"], ["3 0", "1 0", "3"]),
    ("gpl", ["gnu general public", "general public"], ["3 0", "2 0", "1 0", "3", "2", "1"]),
    ("lgpl", ["gnu lesser general public", "lesser general public", "gnu library general public"], ["3 0", "2 1", "2 0", "3", "2"]),
    ("agpl", ["gnu affero general public", "affero general public"], ["3 0", "1 0", "3"]),
    ("gfdl", ["gnu free documentation", "free documentation"], ["1 3", "1 2", "1 1"]),
    ("mpl", ["mozilla public"], ["2 0", "1 1", "1 0"]),
    ("epl", ["eclipse public"], ["2 0", "1 0"]),
    ("cddl", ["common development and distribution"], ["1 1", "1 0"]),
    ("cpl", ["common public"], ["1 0"]),
    ("eupl", ["european union public"], ["1 2", "1 1", "1 0"]),
    ("artistic", ["artistic", "clarified artistic"], ["2 0", "1 0"]),
    ("bsl-1.0", ["boost software", "boost"], ["1 0"]),
    ("isc", ["isc"], []),
    ("zlib", ["zlib", "zlib libpng"], []),
    ("unlicense", ["unlicense", "the unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public"], ["2"]),
    ("psf", ["python software foundation", "psf"], ["2"]),
    ("ofl", ["sil open font", "open font"], ["1 1", "1 0"]),
    ("ncsa", ["university of illinois ncsa open source", "ncsa"], []),
    ("ms-pl", ["microsoft public"], []),
    ("ms-rl", ["microsoft reciprocal"], []),
    ("odbl", ["open database", "open data commons open database"], ["1 0"]),
    ("pddl", ["public domain dedication and", "open data commons public domain dedication and"], ["1 0"]),
    ("osl", ["open software"], ["3 0", "2 1", "2 0", "1 0"]),
    ("afl", ["academic free"], ["3 0", "2 1", "2 0", "1 2"]),
    ("ecl", ["educational community"], ["2 0", "1 0"]),
    ("cecill", ["cecill", "cecill free software"], ["2 1", "2 0"]),
    ("postgresql", ["postgresql"], []),
    ("openssl", ["openssl"], []),
    ("ruby", ["ruby"], []),
    ("php", ["php"], ["3 01", "3 0"]),
    ("vim", ["vim"], []),
    ("w3c", ["w3c software notice and", "w3c"], []),
    ("ssp", ["server side public"], ["1"]),
    ("busl", ["business source"], ["1 1"]),
    ("elastic", ["elastic"], ["2 0"]),
    ("openrail", ["openrail", "responsible ai"], []),
]
#: Short SPDX identifiers that are not a family's first name, without versions but where the version tells families apart.
SPDX = {"gfdl": ["gfdl"], "mpl": ["mpl"], "epl": ["epl"], "cddl": ["cddl"], "cpl": ["cpl"], "eupl": ["eupl"], "bsl-1.0": ["bsl 1 0"], "wtfpl": ["wtfpl"], "psf": ["psf", "python"], "ofl": ["ofl"], "ncsa": ["ncsa"], "ms-pl": ["ms pl"], "ms-rl": ["ms rl"], "odbl": ["odbl"], "pddl": ["pddl"], "osl": ["osl"], "afl": ["afl"], "ecl": ["ecl"], "ssp": ["sspl"], "busl": ["busl"]}
#: Creative Commons parts, as deeds and short forms name them.
CC_PARTS = {"cc-by": "attribution", "cc-by-sa": "attribution sharealike", "cc-by-nd": "attribution noderivatives", "cc-by-nc": "attribution noncommercial", "cc-by-nc-sa": "attribution noncommercial sharealike", "cc-by-nc-nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ["4 0", "3 0", "2 5", "2 0", "1 0"]
#: Family names that are everyday words too: they count in a grant or with a version, not before "license" alone.
EVERYDAY = {"ruby", "elastic", "boost", "artistic", "vim", "php", "open software", "open font", "common public", "business source", "server side public", "freebsd", "postgresql"}
#: Signatures written by hand, words as the line has them: titles, grants, conditions, disclaimers and headers. Label, keyword, pattern, weight.
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "to deal in the software without restriction", r"to deal in the software without restriction(?: including without limitation the rights)?", 0.9),
    ("mit", "shall be included in all copies", r"(?:copyright notice and this )?permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "the software is provided as is without warranty", r"the software is provided as is without warranty of any kind express or implied", 0.7),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("isc", "the author disclaims all warranties", r"the author disclaims all warranties with regard to this software", 0.8),
    ("isc", "use data or profits", r"loss of use data or profits whether in an action of contract negligence or other tortious action", 0.7),
    ("hpnd", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.9),
    ("hpnd", "used in advertising or publicity", r"not be used in advertising or publicity pertaining to distribution", 0.7),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 0.9),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3-clause", "endorse or promote products", r"(?:names? of (?:its|the) (?:copyright holder|contributors?|author)|neither the name) .{0,120}?endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("bsd", "this software is provided by the", r"this software is provided by the (?:copyright holders?(?: and contributors)?|regents and contributors|author) as is", 0.8),
    ("zlib", "this software is provided as is", r"this software is provided as is without any express or implied warranty", 0.7),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented", 0.95),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 0.9),
    ("zlib", "removed or altered", r"this notice may not be removed or altered from any source distribution", 0.8),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 0.95),
    ("bsl-1.0", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor", 0.9),
    ("apache-2.0", "licensed under the apache license", r"licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2.0", "except in compliance with the license", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "apache org licenses", r"(?:www )?apache org licenses license 2 0", 0.95),
    ("apache-2.0", "on an as is basis", r"distributed under the license is distributed on an as is basis without warranties or conditions", 0.8),
    ("apache-2.0", "for the specific language governing permissions", r"see the license for the specific language governing permissions and limitations", 0.8),
    ("apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution 1 definitions", 0.9),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.8),
    ("gpl", "redistribute it and or modify", r"(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.95),
    ("gpl", "received a copy of the gnu general public", r"you should have received a copy of the gnu general public licen[sc]e", 0.9),
    ("gpl-3.0-or-later", "either version 3", r"general public licen[sc]e as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version", 1.0),
    ("gpl-2.0-or-later", "either version 2", r"general public licen[sc]e as published by the free software foundation either version 2 (?:of the license )?or (?:at your option )?any later version", 1.0),
    ("gpl-2.0-only", "version 2 of the license", r"general public licen[sc]e as published by the free software foundation version 2 of the license", 0.95),
    ("gpl-2.0-only", "general public license version 2", r"general public license version 2 (?:only|as published by the free software foundation)", 0.95),
    ("gpl-1.0", "general public license version 1", r"gnu general public license version 1 february 1989", 1.0),
    ("gpl-2.0", "general public license version 2", r"gnu general public license version 2 june 1991", 1.0),
    ("gpl-3.0", "general public license version 3", r"gnu general public license version 3 29 june 2007", 1.0),
    ("gpl", "free copyleft license", r"is a free copyleft license for software and other kinds of works", 0.9),
    ("gpl", "take away your freedom", r"the licen[sc]es for most software (?:and other practical works )?are designed to take away your freedom", 0.9),
    ("gpl", "without even the implied warranty", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", 0.5),
    ("gpl", "to the extent permitted by applicable law", r"there is no warranty (?:for the program )?to the extent permitted by applicable law", 0.6),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e", 0.95),
    ("lgpl", "work based on the library", r"(?:a )?work based on the library", 0.6),
    ("lgpl", "incorporates the terms and conditions of version 3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 1.0),
    ("lgpl-2.1", "lesser general public license version 2 1", r"gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-3.0", "lesser general public license version 3", r"gnu lesser general public license version 3 29 june 2007", 1.0),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e", 0.95),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public licen[sc]e", 0.95),
    ("agpl-3.0", "affero general public license version 3", r"gnu affero general public license version 3 19 november 2007", 1.0),
    ("gfdl", "permission is granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1.0),
    ("gfdl", "front cover texts", r"no invariant sections no front cover texts and no back cover texts", 0.9),
    ("mpl-2.0", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "mozilla org mpl 2 0", r"mozilla org mpl 2 0", 0.95),
    ("mpl-1.1", "subject to the mozilla public license version", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-2.0", "incompatible with secondary licenses", r"incompatible with secondary licenses", 0.7),
    ("epl", "accompanying program is provided under", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e", 1.0),
    ("epl", "eclipse org legal epl", r"eclipse org legal epl (?:v10|2 0|v20)", 0.95),
    ("epl", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 1.0),
    ("cddl", "common development and distribution", r"subject to the terms of the common development and distribution licen[sc]e", 0.95),
    ("cpl", "accompanying program is provided under", r"the accompanying program is provided under the terms of this common public licen[sc]e", 1.0),
    ("ipl", "accompanying program is provided under", r"the accompanying program is provided under the terms of this ibm public licen[sc]e", 1.0),
    ("eupl", "licensed under the eupl", r"licensed under the eupl", 0.95),
    ("artistic", "the intent of this document is to state", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic", "same terms as perl itself", r"under the same terms as perl itself", 0.8),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "copy modify publish use compile sell", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("wtfpl", "you just do what the fuck", r"you just do what the fuck you want to", 0.95),
    ("psf", "psf license agreement", r"psf license agreement for python", 0.95),
    ("psf", "python software foundation all rights", r"python software foundation all rights reserved", 0.7),
    ("ofl", "sil open font license", r"this font software is licensed under the sil open font license", 1.0),
    ("ofl", "reserved font name", r"with reserved font name", 0.8),
    ("ncsa", "to deal with the software without restriction", r"to deal with the software without restriction including without limitation", 0.95),
    ("ms-pl", "if you use the software you accept this license", r"this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("odbl", "made available under the open database", r"made available under the open database licen[sc]e", 1.0),
    ("pddl", "dedicate the work to the public domain", r"dedicate the work to the public domain", 0.7),
    ("cc0", "all copyright and related or neighboring rights", r"(?:the person who associated a work with this deed has )?waives? all copyright and related or neighboring rights", 0.9),
    ("cc0", "dedicated the work to the public domain", r"dedicated the work to the public domain by waiving all", 0.95),
    ("cc0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.8),
    ("cc-by", "creativecommons org licenses by", r"creativecommons org licenses by [1-4] [0-9]", 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa", r"creativecommons org licenses by sa [1-4] [0-9]", 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd", r"creativecommons org licenses by nd [1-4] [0-9]", 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc", r"creativecommons org licenses by nc [1-4] [0-9]", 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa [1-4] [0-9]", 1.0),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd [1-4] [0-9]", 1.0),
    ("openssl", "openssl project for use in the openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("ssleay", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young", 0.95),
    ("php", "this product includes php", r"this product includes php(?: software)? freely available from", 0.8),
    ("postgresql", "without fee and without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted", 0.95),
    ("w3c", "w3c software and document", r"w3c software and document notice and license", 1.0),
    ("ssp", "offering the program as a service", r"offering the program as a service", 0.8),
    ("busl", "change date", r"on the change date .{0,80}?change license", 0.8),
    ("busl", "additional use grant", r"additional use grant", 0.7),
    ("elastic", "as a hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 0.95),
    ("commons-clause", "commons clause", r"commons clause licen[sc]e condition(?: v1 0)?", 1.0),
    ("openrail", "use based restrictions", r"use based restrictions as referenced in paragraph 5", 0.95),
    ("llama-community", "community license agreement", r"llama [0-9](?: [0-9])? community license agreement", 1.0),
    ("json", "used for good not evil", r"the software shall be used for good not evil", 1.0),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 0.95),
    ("reserved", "rights", r"(?:some|no) rights reserved", 0.5),
    ("reserved", "rights", r"all rights reserved", 0.6),
    ("copyright", "copyright", r"copyright (?:c |\S{1,3} )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0.5),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|content)", 0.5),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "public domain", r"in the public domain", 0.5),
    ("public-domain", "author disclaims copyright", r"the author disclaims copyright to this source code", 0.95),
    ("public-domain", "no copyright", r"no copyright is claimed", 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.7),
    ("proprietary", "copied", r"(?:may not|do not|not to) (?:be )?copied", 0.5),
    ("proprietary", "redistribute", r"(?:may not|do not|not to) (?:be )?redistributed?", 0.5),
    ("proprietary", "reproduce", r"(?:may not|do not|not to) (?:be )?reproduced?", 0.5),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|work|material) )?(?:via any medium )?is (?:strictly )?prohibited", 0.7),
    ("proprietary", "trade secret", r"(?:contains?|constitutes?) (?:valuable )?trade secrets?", 0.6),
    ("proprietary", "without", r"without (?:the )?(?:prior |express )*(?:written )?permission", 0.4),
    ("proprietary", "end user license agreement", r"end user license agreement", 0.6),
    ("terms", "terms of use", r"terms of use", 0.3),
    ("terms", "terms of service", r"terms of service", 0.3),
    ("trademark", "trademark", r"registered trademarks? of", 0.3),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    weight: float


def build_rules() -> list[Rule]:
    """All rules, highest priority first: identifiers, named versions, grants, names, notices."""
    edge = r"(?<![^ ]){}(?![^ ])"
    rows: list[tuple[int, str, str, str, float]] = []
    for label, names, versions in FAMILIES:
        for name in names:
            for v in versions:
                rows.append((40, f"{label}-{v.replace(' ', '.')}", name, rf"{name} licen[sc]e(?: \S+)? (?:version|v) ?{v}", 1.0))
                rows.append((38, f"{label}-{v.replace(' ', '.')}", name, rf"{name}(?: licen[sc]e)? v?{v}", 0.9))
            rows.append((30, label, name, rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{name}", 0.9))
            if name not in EVERYDAY:
                rows.append((20, label, name, rf"{name} licen[sc]e", 0.8))
        ident = names[0].replace(" ", "(?: )?")
        rows.append((50, label, "spdx", rf"spdx licen[sc]e identifier {ident}\S*", 1.0))
    for label, idents in SPDX.items():
        versions = next(v for family, _, v in FAMILIES if family == label)
        for ident in idents:
            rows.append((50, label, "spdx", rf"spdx licen[sc]e identifier {ident}", 1.0))
            rows += [(49, f"{label}-{v.replace(' ', '.')}", "spdx", rf"spdx licen[sc]e identifier {ident} {v}", 1.0) for v in versions if not ident.endswith(v)]
    # Short identifiers outside an SPDX line: after "license", and in a grant with or without a version.
    for label, idents in {**{family: [names[0]] for family, names, _ in FAMILIES if " " not in names[0] and names[0] not in EVERYDAY}, **SPDX}.items():
        versions = next(v for family, _, v in FAMILIES if family == label)
        for ident in idents:
            rows.append((28, label, ident, rf"licen[sc]e(?: is)? {ident}", 0.7))
            rows.append((30, label, ident, rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?{ident}", 0.9))
            rows += [(39, f"{label}-{v.replace(' ', '.')}", ident, rf"(?:licen[sc]e|(?:licen[sc]ed |released |distributed |available )?under)(?: the| is)? {ident} v?{v}", 0.9) for v in versions if not ident.endswith(v)]
    for label, deed in CC_PARTS.items():
        short = label.replace("-", " ")
        for v in CC_VERSIONS:
            rows.append((40, f"{label}-{v.replace(' ', '.')}", "cc by", rf"{short} {v}", 1.0))
            rows.append((40, f"{label}-{v.replace(' ', '.')}", "creative commons", rf"creative commons {deed} {v}", 1.0))
        rows.append((30, label, "cc by", short, 0.8))
        rows.append((30, label, "creative commons", rf"creative commons {deed}", 0.9))
    rows.append((10, "creative-commons", "creative commons", r"creative commons", 0.6))
    rows.append((15, "gpl", "general public", r"general public licen[sc]e", 0.8))
    rows += [(12, label, keyword, pattern, weight) for label, keyword, pattern, weight in NOTICES]
    made = [Rule(p, label, k, re.compile(edge.format(x)), w) for p, label, k, x, w in rows]
    return sorted(made, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) left after those inside an interval of equal or higher priority are suppressed.

    Sorted by start with the longest first, a stack of open intervals holds all that can contain the next one.
    """
    found = sorted(found, key=lambda d: (d[0], -d[1], -d[2].priority, d[2].label))
    kept: list[tuple[int, int, Rule]] = []
    open_: list[tuple[int, int, Rule]] = []
    for d in found:
        open_ = [o for o in open_ if o[1] > d[0]]
        if not any(o[1] >= d[1] and o[2].priority >= d[2].priority for o in open_):
            kept.append(d)
            open_.append(d)
    return kept


_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class LicenseScanner:
    def __init__(self):
        self.rules: dict[str, list[Rule]] = {}
        for r in build_rules():
            self.rules.setdefault(r.keyword, []).append(r)

    def scan(self, text: str) -> dict:
        """words, base (label, first word) places and detections (start, end, rule) of a text.

        Words are runs of digits, letters after A-Z became a-z, and everything beyond ASCII.
        """
        words = text.encode().translate(_WORD_BYTES).split()
        line = b" ".join(words)
        base: list[tuple[str, int]] = []
        for phrase, label in BASE:
            p = phrase.encode()
            at = line.find(p)
            seen, count = 0, 0
            while at >= 0:
                end = at + len(p)
                if (at == 0 or line[at - 1] == 32) and (end == len(line) or line[end] == 32):
                    count += line.count(b" ", seen, at)
                    seen = at
                    base.append((label, count))
                at = line.find(p, at + 1)
        decoded, found = None, []
        for keyword, rules in self.rules.items():
            if keyword.encode() not in line:
                continue
            decoded = line.decode() if decoded is None else decoded
            for r in rules:
                found += [(m.start(), m.end(), r) for m in r.pattern.finditer(decoded)]
        return {"words": len(words), "base": base, "found": resolve(found)}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License findings of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. labels has the base
    labels and those of the rules left standing; score is the largest weight among the rules, at least 0.5
    with a base place, 0 without any finding. A null text is empty and has none; texts of any length are
    scanned whole; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """

    def make():
        scanner = LicenseScanner()

        def f(texts):
            out = []
            for t in texts:
                s = scanner.scan(t)
                starts, names = [x[1] for x in s["base"]], {x[0] for x in s["base"]}
                every = names | {d[2].label for d in s["found"]}
                score = max([d[2].weight for d in s["found"]] + [0.5] * bool(starts), default=0.0)
                out.append((s["words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(every)), score))
            return [list(c) for c in zip(*out, strict=True)]

        return f

    return map_texts(docs, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)


def license_spans(docs: DataFrame) -> DataFrame:
    """doc_id and found: label, start, end and weight of each detection, as offsets in the line of words."""

    def make():
        scanner = LicenseScanner()
        return lambda texts: [[[{"label": r.label, "start": a, "end": b, "weight": r.weight} for a, b, r in scanner.scan(t)["found"]] for t in texts]]

    return map_texts(docs, "found array<struct<label:string,start:long,end:long,weight:double>>", make)
