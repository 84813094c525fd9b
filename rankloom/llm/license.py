"""Licence scan: ordered signature rules, gated by keywords, resolved by priority and containment.

Hand-written phrases of the licences' own texts are rules, and hand-written names, identifiers and addresses of licences
are put into hand-written sentence forms, each pair a rule: a regular expression with a priority and a weight. A form of
denial ("not licensed under ...") suppresses what it holds and has no label itself. A rule runs only on texts that pass a general gate and hold
one of the strings of which, by the rule's own expression, each of its matches holds one. Of the places found, one that lies within a place of a rule of the same or a higher priority is
suppressed. Labels are those of the places that stay; base phrases always keep theirs.

Each text is scanned by itself, in the task that reads it: no shuffle, no state, any text length.

Defined cases: null counts as empty; a text without words has no places (first and last null, score 0); repeated rows
and rows with null ids are kept as they are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
import re._parser as parser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of

BASE = ((b"gnu general public license", "gpl"), (b"apache license", "apache"), (b"cc by", "cc-by"), (b"mit license", "mit"))

#: label | keyword (for the reader; gates follow from the expressions) | name (regular expression) | identifier | address or empty
LICENCES = """
gpl-1.0 | gnu | (?:gnu )?(?:general public license|gpl),? ?-?\\(?(?:version |v\\.? ?)?1(?:\\.0)?\\b | gpl-1\\.0 | gnu\\.org/licenses/(?:old-licenses/)?gpl-1\\.0
gpl-2.0 | gnu | (?:gnu )?(?:general public license|gpl),? ?-?\\(?(?:version |v\\.? ?)?2(?:\\.0)?\\b | gpl-2\\.0 | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
gpl-3.0 | gnu | (?:gnu )?(?:general public license|gpl),? ?-?\\(?(?:version |v\\.? ?)?3(?:\\.0)?\\b | gpl-3\\.0 | gnu\\.org/licenses/gpl-3\\.0
gpl | gnu | gnu (?:general public license|gpl) | gpl | gnu\\.org/(?:licenses/gpl|copyleft/gpl)
lgpl-2.1 | lesser | (?:gnu )?(?:lesser general public license|lgpl),? ?-?\\(?(?:version |v\\.? ?)?2\\.1\\b | lgpl-2\\.1 | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-3.0 | lesser | (?:gnu )?(?:lesser general public license|lgpl),? ?-?\\(?(?:version |v\\.? ?)?3(?:\\.0)?\\b | lgpl-3\\.0 | gnu\\.org/licenses/lgpl-3\\.0
lgpl | lesser | gnu (?:lesser|library) general public license | lgpl | gnu\\.org/licenses/lgpl
agpl-3.0 | affero | (?:gnu )?(?:affero general public license|agpl),? ?-?\\(?(?:version |v\\.? ?)?3(?:\\.0)?\\b | agpl-3\\.0 | gnu\\.org/licenses/agpl-3\\.0
agpl | affero | gnu affero general public license | agpl | gnu\\.org/licenses/agpl
gfdl | documentation | gnu free documentation license | gfdl-1\\.[123] | gnu\\.org/licenses/fdl
apache-1.1 | apache | apache (?:software )?license,? ?(?:version |v\\.? ?)?1\\.1\\b | apache-1\\.1 | apache\\.org/licenses/license-1\\.1
apache-2.0 | apache | apache (?:software )?license,? ?\\(?(?:version |v\\.? ?)?2(?:\\.0)?\\b | apache-2\\.0 | apache\\.org/licenses/license-2\\.0
apache | apache | apache (?:software )?license | apache | apache\\.org/licenses
mit | mit | (?:mit|expat|x11) license | mit | opensource\\.org/licenses?/mit
mit-0 | mit | mit no attribution(?: license)? | mit-0 | opensource\\.org/licenses?/mit-0
bsd-2-clause | bsd | (?:simplified bsd|freebsd|bsd 2-clause|2-clause bsd)(?: license)? | bsd-2-clause | opensource\\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3-clause|3-clause bsd)(?: license)? | bsd-3-clause | opensource\\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd | (?:original bsd|bsd 4-clause|4-clause bsd)(?: license)? | bsd-4-clause |
0bsd | bsd | (?:zero-clause bsd|bsd zero clause|0bsd)(?: license)? | 0bsd | opensource\\.org/licenses?/0bsd
bsd | bsd | bsd(?:-style)? license | bsd | opensource\\.org/licenses?/bsd
isc | isc | isc license | isc | opensource\\.org/licenses?/isc
mpl-1.1 | mozilla | (?:mozilla public license|mpl),? ?-?(?:version |v\\.? ?)?1\\.1\\b | mpl-1\\.1 | mozilla\\.org/mpl/1\\.1
mpl-2.0 | mozilla | (?:mozilla public license|mpl),? ?-?(?:version |v\\.? ?)?2(?:\\.0)?\\b | mpl-2\\.0 | mozilla\\.org/(?:en-us/)?mpl/2\\.0
mpl | mozilla | mozilla public license | mpl | mozilla\\.org/(?:en-us/)?mpl
epl-1.0 | eclipse | (?:eclipse public license|epl),? ?(?:-|version |v\\.? ?)?1(?:\\.0)?\\b | epl-1\\.0 | eclipse\\.org/(?:legal|org/documents)/epl-v10
epl-2.0 | eclipse | (?:eclipse public license|epl),? ?(?:-|version |v\\.? ?)?2(?:\\.0)?\\b | epl-2\\.0 | eclipse\\.org/(?:legal|org/documents)/epl-(?:v20|2\\.0)
edl-1.0 | eclipse | eclipse distribution license(?:,? ?(?:-|version |v\\.? ?)?1\\.0)? | edl-1\\.0 | eclipse\\.org/org/documents/edl-v10
cddl-1.0 | development | common development and distribution license(?:,? ?(?:version |v\\.? ?)?1\\.0)? | cddl-1\\.0 | opensource\\.org/licenses?/cddl
cpl-1.0 | common | common public license(?:,? ?(?:version |v\\.? ?)?1\\.0)? | cpl-1\\.0 | opensource\\.org/licenses?/cpl
cc0-1.0 | cc0 | cc0(?:[ -]1\\.0)?(?: universal)? | cc0-1\\.0 | creativecommons\\.org/publicdomain/zero
cc-by | cc | (?:cc[ -]by|creative commons attribution)\\b(?![ -](?:nc|nd|sa|non|no |share)) | cc-by(?:-[1-4]\\.0)? | creativecommons\\.org/licenses/by/
cc-by-sa | cc | (?:cc[ -]by-sa|creative commons attribution-share ?alike)\\b | cc-by-sa(?:-[1-4]\\.0)? | creativecommons\\.org/licenses/by-sa/
cc-by-nc | cc | (?:cc[ -]by-nc|creative commons attribution-non ?commercial)\\b(?!-) | cc-by-nc(?:-[1-4]\\.0)? | creativecommons\\.org/licenses/by-nc/
cc-by-nd | cc | (?:cc[ -]by-nd|creative commons attribution-no ?deriv(?:ative)?s)\\b | cc-by-nd(?:-[1-4]\\.0)? | creativecommons\\.org/licenses/by-nd/
cc-by-nc-sa | cc | (?:cc[ -]by-nc-sa|creative commons attribution-non ?commercial-share ?alike)\\b | cc-by-nc-sa(?:-[1-4]\\.0)? | creativecommons\\.org/licenses/by-nc-sa/
cc-by-nc-nd | cc | (?:cc[ -]by-nc-nd|creative commons attribution-non ?commercial-no ?deriv(?:ative)?s)\\b | cc-by-nc-nd(?:-[1-4]\\.0)? | creativecommons\\.org/licenses/by-nc-nd/
unlicense | unlicense | the unlicense | unlicense | unlicense\\.org
wtfpl | what | do what the f\\w+ you want to public license | wtfpl | wtfpl\\.net
zlib | zlib | zlib(?:/libpng)? license | zlib | opensource\\.org/licenses?/zlib
libpng | libpng | libpng license | libpng(?:-2\\.0)? |
bsl-1.0 | boost | boost software license(?:,? ?(?:-|version |v\\.? ?)?1\\.0)? | bsl-1\\.0 | boost\\.org/license_1_0
artistic-1.0 | artistic | artistic license,? ?(?:version |v\\.? ?)?1\\.0\\b | artistic-1\\.0 | opensource\\.org/licenses?/artistic-license-1
artistic-2.0 | artistic | artistic license,? ?(?:version |v\\.? ?)?2(?:\\.0)?\\b | artistic-2\\.0 | opensource\\.org/licenses?/artistic-license-2
perl | perl | same terms as perl(?: itself)? | perl |
python-2.0 | python | (?:python software foundation|psf) license(?:,? ?(?:version |v\\.? ?)?2)? | (?:python|psf)-2\\.0 | docs\\.python\\.org/3/license
ruby | ruby | ruby(?:'s)? license | ruby | ruby-lang\\.org/en/about/license
php-3.01 | php | php license(?:,? ?(?:version |v\\.? ?)?3\\.0?1)? | php-3\\.01 | php\\.net/license
eupl-1.1 | european | european union public licen[cs]e,? ?(?:version |v\\.? ?)?1\\.1\\b | eupl-1\\.1 |
eupl-1.2 | european | european union public licen[cs]e,? ?(?:version |v\\.? ?)?1\\.2\\b | eupl-1\\.2 | joinup\\.ec\\.europa\\.eu/\\S*eupl
eupl | european | european union public licen[cs]e | eupl |
ofl-1.1 | font | (?:sil )?open font license(?:,? ?(?:version |v\\.? ?)?1\\.1)? | ofl-1\\.1 | (?:scripts\\.sil\\.org|openfontlicense\\.org)
odbl-1.0 | database | open (?:data commons open )?database license(?:,? ?(?:version |v\\.? ?)?1\\.0)? | odbl-1\\.0 | opendatacommons\\.org/licenses/odbl
odc-by-1.0 | commons | open data commons attribution license | odc-by-1\\.0 | opendatacommons\\.org/licenses/by
pddl-1.0 | commons | (?:open data commons )?public domain dedication and license | pddl-1\\.0 | opendatacommons\\.org/licenses/pddl
public-domain | public domain | (?:in|into|to) the public domain | public-domain | creativecommons\\.org/publicdomain/mark
ms-pl | microsoft | microsoft public license | ms-pl | opensource\\.org/licenses?/ms-pl
ms-rl | microsoft | microsoft reciprocal license | ms-rl | opensource\\.org/licenses?/ms-rl
ncsa | ncsa | (?:university of illinois/)?ncsa(?: open source)? license | ncsa | opensource\\.org/licenses?/ncsa
postgresql | postgresql | postgresql license | postgresql | opensource\\.org/licenses?/postgresql
vim | vim | vim license | vim |
openssl | openssl | openssl license | openssl | openssl\\.org/source/license
afl-3.0 | academic | academic free license(?:,? ?(?:version |v\\.? ?)?3\\.0)? | afl-3\\.0 | opensource\\.org/licenses?/afl
osl-3.0 | open software | open software license(?:,? ?(?:version |v\\.? ?)?3\\.0)? | osl-3\\.0 | opensource\\.org/licenses?/osl
upl-1.0 | universal permissive | universal permissive license(?:,? ?(?:version |v\\.? ?)?1\\.0)? | upl-1\\.0 | opensource\\.org/licenses?/upl
bsl-1.1 | business source | business source license(?:,? ?(?:version |v\\.? ?)?1\\.1)? | busl-1\\.1 | mariadb\\.com/bsl11
sspl-1.0 | server side | server side public license(?:,? ?(?:version |v\\.? ?)?1)? | sspl-1\\.0 | mongodb\\.com/licensing/server-side-public-license
elastic-2.0 | elastic | elastic license(?:,? ?(?:version |v\\.? ?)?2(?:\\.0)?)? | elastic-2\\.0 | elastic\\.co/licensing/elastic-license
mulan-2.0 | mulan | mulan (?:permissive software license|psl),? ?(?:version |v\\.? ?)?2\\b | mulanpsl-2\\.0 | license\\.coscl\\.org\\.cn/mulanpsl2
""".strip().splitlines()

#: Phrases of the licences' own texts and notices: label | expression, blanks as above
BODIES = """
mit | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice (?:\\(including the next paragraph\\) )?shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{0,20}to deal in the software without restriction, including .{0,200}and to permit persons to whom the software is furnished to do so\\. the software is provided
x11 | except as contained in this notice, the names? of .{1,80} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software
bsd | redistributions? and use in source and binary forms, with or without modification, (?:are|is) permitted provided that the following conditions are met
bsd | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
bsd-3-clause | neither the names? of .{1,100} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
0bsd | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\\.
postgresql | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
hpnd | permission to use, copy, modify, (?:and )?distribute,? (?:and sell )?this software and its documentation for any purpose is hereby granted without fee
ncsa | to deal with the software without restriction, including without limitation the rights to use, copy, modify
apache-2.0 | you may not use this file except in compliance with the license
apache-2.0 | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an ["']?as is["']? basis
apache-2.0 | grant of patent license\\. subject to the terms and conditions of this license, each contributor hereby grants to you
apache-1.1 | this product includes software developed by the apache (?:software foundation|group)
gpl | this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public license
gpl | everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
gpl-2.0 | either version 2(?: of the license)?,? or (?:\\(at your option\\)|at your option) any later version
gpl-3.0 | either version 3(?: of the license)?,? or (?:\\(at your option\\)|at your option) any later version
gpl-2.0 | the licenses for most software are designed to take away your freedom to share and change it\\. by contrast, the gnu general public license is intended to guarantee your freedom
gpl-3.0 | the gnu general public license is a free, copyleft license for software and other kinds of works
lgpl | this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | this license, the lesser general public license, applies to some specially designated software packages
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl-3.0 | the gnu affero general public license is a free, copyleft license for software and other kinds of works
agpl-3.0 | all users interacting with it remotely through a computer network
gfdl | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1\\.1
mpl-2.0 | this source code form is subject to the terms of the mozilla public license, v\\. 2\\.0
mpl-2.0 | if a copy of the mpl was not distributed with this file, you can obtain one at
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | the accompanying program is provided under the terms of this common public license
cc0-1.0 | to the extent possible under law, .{1,120} (?:has|have) (?:dedicated|waived) all copyright and related (?:and|or) neighboring rights
cc-by | you must give appropriate credit, provide a link to the license, and indicate if changes were made
cc-by-sa | if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix, transform, or build upon the material, you may not distribute the modified material
unlicense | this is free and unencumbered software released into the public domain
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
zlib | this software is provided ["']?as-is["']?, without any express or implied warranty\\. in no event will the authors be held liable
zlib | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
libpng | the png reference library is supplied ["']?as is["']?
bsl-1.0 | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
perl | is free software[:;,] you can redistribute it and/or modify it under the same terms as perl(?: itself)?
python-2.0 | psf is making python available to licensee on an ["']?as is["']? basis
ruby | you may redistribute it and/or modify it under either the terms of the (?:gpl|2-clause bsdl)
php-3.01 | products derived from this software may not be called ["']?php["']?
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1 | the fonts and derivatives, however, can be bundled, embedded, redistributed and/or sold with any software
odbl-1.0 | you are free to share, create and adapt the database as long as you attribute
ms-pl | this license governs use of the accompanying software\\. if you use the software, you accept this license
eupl | the work is a work in progress, which is continuously improved by numerous contributors
afl-3.0 | licensed under the academic free license
osl-3.0 | licensed under the open software license
upl-1.0 | subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data
bsl-1.1 | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
mulan-2.0 | you can use this software according to the terms and conditions of the mulan psl
vim | vim is charityware
beerware | as long as you retain this notice you can do whatever you want with this stuff
json | the software shall be used for good, not evil
curl | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\\. the software is provided
naumen | this file is subject to the naumen public license
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
intel | redistribution\\. redistribution and use in binary form, without modification, are permitted
freetype | portions of this software are copyright .{0,40}the freetype project
ijg | this software is based in part on the work of the independent jpeg group
""".strip().splitlines()
#: priority and weight of a licence's own text; and of a denial, which has no label and only suppresses what lies within it
BODY, DENIAL = (95, 0.97), (110, 0.0)

#: form | priority | weight; NAME, ID and ADDRESS stand for a licence's columns
FORMS = (
    (r"spdx-license-identifier: ?(?:ID)(?:-only|-or-later)?(?![\w.-])", 100, 0.99),
    (r"(?:is |are )?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:NAME)", 90, 0.95),
    (r"(?:released|distributed|published|provided|made available|available) under (?:the )?(?:terms of )?(?:the )?(?:NAME)", 85, 0.95),
    (r"(?:under|by|to) the (?:terms|conditions)(?: and conditions)? of (?:the )?(?:NAME)", 80, 0.9),
    (r"https?://(?:www\.)?(?:ADDRESS)", 70, 0.85),
    (r"licen[cs]e ?[:=] ?[\"']?(?:ID)[\"']?(?![\w.-])", 65, 0.8),
    (r"(?<![\w-])(?:NAME)", 40, 0.6),
    (r"(?:not|never|no longer|neither) (?:be |being |been )?(?:licen[cs]ed|released|distributed|published|provided|(?:made )?available|covered|offered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:NAME)", *DENIAL),
)
#: General gate: a text without any of these holds no place of any rule.
GATE = (b"licen", b"spdx", b"://", b"cc0", b"domain", b"bsd", b"gpl", b"mpl", b"epl", b"psl", b"perl", b"wtfpl",
        b"permission", b"permitted", b"redistribut", b"software", b"copyright", b"charityware", b"remix", b"credit",
        b"version", b"continuously", b"functionality", b"reference", b"interacting", b"commercial", b"whatever", b"attribut")
CC_BY = re.compile(rb"cc[\s*#/-]+by")


class Rule(NamedTuple):
    label: str
    needs: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    weight: float


def loose(text: str) -> str:
    """A blank stands for white space or comment marks."""
    return re.sub(r" (?!\?)", lambda _: r"[\s*#/]+", text.replace("[ -]", "(?: |-)")).replace(" ?", r"[\s*#/]*")


def needs(tree) -> tuple[bytes, ...]:
    """Strings of which each match of a parsed expression holds at least one; empty if it has none."""
    found, run = [], b""
    for kind, value in [*tree, (None, None)]:
        if kind is parser.LITERAL:
            run += bytes([value])
            continue
        found, run = [*found, (run,)] if run else found, b""
        if kind is parser.SUBPATTERN:
            found.append(needs(value[3]))
        elif kind is parser.BRANCH:
            ways = [needs(x) for x in value[1]]
            found.append(tuple(dict.fromkeys(y for x in ways for y in x)) if all(ways) else ())
        elif kind is parser.MAX_REPEAT and value[0]:
            found.append(needs(value[2]))
    return max(filter(None, found), key=lambda x: min(map(len, x)), default=())


@functools.cache
def rules() -> tuple[Rule, ...]:
    """Licences times forms, and the licences' own phrases, in order of priority; a blank in a rule stands for white space or comment marks."""
    out = []
    for row in LICENCES:
        label, _, name, ident, address = (x.strip() for x in row.split(" | ") + [""] * (4 - row.count(" | ")))
        ident, address = ident.removesuffix(" |").strip(), address.strip("| ")
        for form, priority, weight in FORMS:
            if "ADDRESS" in form and not address:
                continue
            text = loose(form.replace("NAME", name).replace("ID", ident).replace("ADDRESS", address))
            own = ident if "ID" in form else address if "ADDRESS" in form else name  # each match holds one of it
            out.append(Rule("" if (priority, weight) == DENIAL else label, needs(parser.parse(loose(own).encode())) or (b"",), re.compile(text.encode()), priority, weight))
    for row in BODIES:
        label, text = row.split(" | ")
        out.append(Rule(label, needs(parser.parse(loose(text).encode())), re.compile(loose(text).encode(), re.DOTALL), *BODY))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.cache
def _strings() -> tuple[bytes, ...]:
    return tuple({k for r in rules() for k in r.needs})


def scan(data: bytes, gated: bool = True) -> list[tuple[int, int, Rule]]:
    """The places in one text that stay: (start, end, rule), bytes. Without gates the same, slower."""
    low = data.lower()
    if gated and not any(k in low for k in GATE) and not (b"cc" in low and CC_BY.search(low)):
        return []
    kept: list[tuple[int, int, Rule]] = []
    held = {k: k in low for k in _strings()} if gated else {}
    for rule in rules():
        if not gated or any(held[k] for k in rule.needs):
            for m in rule.pattern.finditer(low):
                kept.append((m.start(), m.end(), rule))
    kept.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0]))
    return _outermost(kept)


def _outermost(kept: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Places, by priority, that do not lie within one before them. Those that count are kept by their starts, none within
    another, so that ends ascend too and one look at the last start at or before a place tells."""
    out, starts, ends = [], [], []
    for s, e, r in kept:
        at = bisect.bisect_right(starts, s)
        if at and ends[at - 1] >= e:
            continue
        out.append((s, e, r))
        upto = at - (at > 0 and starts[at - 1] == s)
        end = bisect.bisect_right(ends, e, upto)  # what lies within the new place tells nothing more
        starts[upto:end], ends[upto:end] = [s], [e]
    return [x for x in out if x[2].label]


def digest(data: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, places) of one text."""
    words = words_of(data)
    n_base, first, last, base, line = 0, None, None, set(), b""
    for phrase, label in BASE:
        if phrase.rpartition(b" ")[2] in words:
            line = line or b" " + b" ".join(words) + b" "
            upto, number, at = 0, 0, line.find(b" " + phrase + b" ")
            while at >= 0:
                number += line.count(b" ", upto, at)
                upto, n_base = at, n_base + 1
                first, last = number if first is None else min(first, number), number if last is None else max(last, number)
                base.add(label)
                at = line.find(b" " + phrase + b" ", at + 1)
    found = scan(data)
    missing = 0.5 if base else 1.0
    for _, _, r in found:
        missing *= 1 - r.weight
    places = ",".join(f"{r.label}:{s}:{e}" for s, e, r in sorted(found, key=lambda y: y[:2]))
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in found})), 1 - missing, places


def license_scan(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for each row; places holds
    label:start:end in bytes of the UTF-8 text, comma-joined, in order."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def each(batches):
        for b in batches:
            rows = list(zip(*(digest(x or b"") for x in b.column(1).to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(each, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string")
