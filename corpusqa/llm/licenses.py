"""License notices by ordered signature rules.

Rules are regular expressions over the words of a text: sentences of notices,
identifiers in a tag, a field or a grant, names with their versions, addresses.
A rule is tried only on texts that hold its keyword and fit the gate of that
keyword, one expression that fits wherever a rule of the keyword does; it is a
constant, so Spark compiles it once, while rules are data and are compiled where
they are tried. Texts without any keyword are done after one look. Each match is
an interval of words.

Where intervals overlap, one that lies within another of the same or a higher
priority is suppressed: a bare name inside a grant says nothing of its own.
Sorted by start and length, whatever contains an interval comes before it, so one
pass that remembers how far each priority has reached decides all of them; the
pass keeps labels, not intervals, so a text with thousands of notices is no
heavier than its length.

All is row by row in DataFrame functions: no shuffle and no Python.

Defined results: null is the empty text; without a match there are no labels and
the score is 0. Words are runs of ASCII letters and digits and of characters
beyond ASCII, A-Z counting as a-z. Matches of one rule don't overlap. Equal
intervals go to the higher priority, and to both where that is equal. Repeated
rows each get their result. Other columns stay as they are.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priority of each form of a notice, and the confidence it adds to the score.
FORMS = {"tag": (4, 1.0), "grant": (3, 0.95), "field": (2, 0.9), "address": (2, 0.9), "name": (1, 0.75)}

# Phrases that are always reported, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_CONFIDENCE = 0.5

V = r"(?: version| v)?"
# Label, keywords that all have to begin a word, name as words, versions (words after the name, "" for none).
FAMILIES = [
    ("apache", "apache", rf"apache(?: software)?(?: license)?{V}", ("1 0", "1 1", "2 0", "2")),
    ("gpl", "gpl", rf"(?:gnu )?gpl(?: license)?{V}", ("1 0", "2 0", "3 0", "2", "3", "v2", "v3")),
    ("gpl", "general public", rf"(?:gnu )?general public licen[sc]e{V}", ("1", "2", "3")),
    ("lgpl", "lgpl", rf"(?:gnu )?lgpl(?: license)?{V}", ("2 0", "2 1", "3 0", "3", "v2", "v3")),
    ("lgpl", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V}", ("2", "2 1", "3")),
    ("agpl", "agpl", rf"(?:gnu )?agpl(?: license)?{V}", ("1 0", "3 0", "3", "v3")),
    ("agpl", "affero", rf"(?:gnu )?affero general public licen[sc]e{V}", ("1", "3")),
    ("fdl", "documentation", rf"(?:gnu )?free documentation licen[sc]e{V}", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", rf"mozilla public licen[sc]e{V}", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", rf"eclipse public licen[sc]e{V}", ("1 0", "2 0")),
    ("edl", "eclipse", rf"eclipse distribution licen[sc]e{V}", ("1 0",)),
    ("cddl", "common development", rf"common development and distribution licen[sc]e{V}", ("1 0", "1 1")),
    ("cpl", "common public", rf"common public licen[sc]e{V}", ("1 0",)),
    ("eupl", "european", rf"european union public licen[sc]e{V}", ("1 1", "1 2")),
    ("osl", "open software", rf"open software licen[sc]e{V}", ("1 0", "2 0", "3 0")),
    ("afl", "academic", rf"academic free licen[sc]e{V}", ("2 1", "3 0")),
    ("artistic", "artistic", rf"artistic licen[sc]e{V}", ("1 0", "2 0")),
    ("psf", "python", rf"python software foundation licen[sc]e{V}", ("2",)),
    ("boost", "boost", rf"boost software licen[sc]e{V}", ("1 0",)),
    ("mit", "mit licen", r"mit(?: x11)?(?: expat)? licen[sc]e", ()),
    ("isc", "isc licen", r"isc licen[sc]e", ()),
    ("zlib", "zlib licen", r"zlib(?: libpng)? licen[sc]e", ()),
    ("unlicense", "unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl", rf"wtfpl{V}", ("2",)),
    ("ncsa", "ncsa licen", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", ()),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", ()),
    ("openssl", "openssl licen", r"openssl licen[sc]e", ()),
    ("php", "php licen", rf"php licen[sc]e{V}", ("3 0", "3 01")),
    ("ruby", "ruby licen", r"ruby licen[sc]e", ()),
    ("vim", "vim licen", r"vim licen[sc]e", ()),
    ("ofl", "open font", rf"(?:sil )?open font licen[sc]e{V}", ("1 0", "1 1")),
    ("odbl", "database", rf"open (?:data commons open )?database licen[sc]e{V}", ("1 0",)),
    ("odc-by", "data commons", r"open data commons attribution licen[sc]e", ()),
    ("pddl", "domain dedication", r"public domain dedication and licen[sc]e", ()),
    ("ogl", "government", rf"open government licen[sc]e{V}", ("1 0", "2 0", "3 0")),
    ("busl", "business", rf"business source licen[sc]e{V}", ("1 1",)),
    ("sspl", "server", rf"server side public licen[sc]e{V}", ("1",)),
    ("elastic", "elastic", rf"elastic licen[sc]e{V}", ("2 0",)),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ()),
    ("upl", "universal", rf"universal permissive licen[sc]e{V}", ("1 0",)),
    ("bsd-0", "bsd", r"(?:0|zero) clause bsd licen[sc]e", ()),
    ("bsd-2", "bsd", r"(?:(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2 clause)(?: licen[sc]e)?", ()),
    ("bsd-3", "bsd", r"(?:(?:3|three) clause bsd|new bsd|modified bsd|bsd 3 clause)(?: licen[sc]e)?", ()),
    ("bsd-4", "bsd", r"(?:(?:4|four) clause bsd|original bsd|bsd 4 clause)(?: licen[sc]e)?", ()),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", ()),
    ("cc0", "cc0", rf"cc0{V}", ("1 0",)),
    ("cc0", "creative", rf"creative commons zero{V}", ("1 0",)),
]

# Creative Commons: every combination of conditions, by code and by name.
CONDITIONS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|atives|s)"}
COMBINATIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
for _parts in COMBINATIONS:
    _names = r" ".join(CONDITIONS[p] for p in _parts.split())
    FAMILIES.append(("cc-" + _parts.replace(" ", "-"), "cc by", f"cc {_parts}", CC_VERSIONS))
    FAMILIES.append(("cc-" + _parts.replace(" ", "-"), "creative", f"creative commons {_names}(?: licen[sc]e)?", CC_VERSIONS))

# Licenses whose version is written as part of the name (`GPLv3`, `LGPLv2.1`), with such versions.
JOINED = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3"), "mpl": ("1 1", "2"), "epl": ("1", "2"), "eupl": ("1 1", "1 2")}
LATER = r" (?:or|and) (?:\(?at your option\)? )?(?:any )?(?:later|newer|above)"

GRANT = r"(?:(?:re)?licensed|released|available|distributed|published|provided|covered|governed|redistribut\w+|used?) (?:\w+ ){0,4}?(?:under|by)(?: the)?(?: terms of(?: the)?)?"
TAG = r"spdx license identifier"
FIELD = r"licen[sc]es?(?: is| type| name| id)?"

# Identifiers of the SPDX license list, without single words that are common in other texts.
IDENTIFIERS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later
Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6
CC0-1.0 CC-PDDC CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C
CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0
EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later
GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG
ImageMagick IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0-only LGPL-3.0-or-later Libpng libtiff LPPL-1.3c MIT MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0
MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NPL-1.1 NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1
OGL-UK-3.0 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PolyForm-Noncommercial-1.0.0
PolyForm-Small-Business-1.0.0 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SGI-B-2.0 SISSL Sleepycat SPL-1.0
SSPL-1.0 TCL UCL-1.0 Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C Watcom-1.0 WTFPL X11 Zend-2.0
Zlib ZPL-2.0 ZPL-2.1
""".split()

# Words of which each sentence below holds one; the first that it holds is its keyword.
KEYWORDS = (
    "gnu", "apache", "mozilla", "eclipse", "permission", "proprietary", "reproduced", "decompile", "trademark", "advertising",
    "commercial", "mpl", "copyright", "software", "licen", "redistribut", "distributed")

# Sentences of notices as they are written, by label.
NOTICES = """
gpl | This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
gpl | This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
gpl | You should have received a copy of the GNU General Public License along with this program
gpl | The GNU General Public License is a free, copyleft license for software and other kinds of works
gpl-2-0-or-later | either version 2 of the License, or (at your option) any later version
gpl-3-0-or-later | either version 3 of the License, or (at your option) any later version
gpl-2-0-only | under the terms of the GNU General Public License version 2 as published by the Free Software Foundation
lgpl | You should have received a copy of the GNU Lesser General Public License
lgpl | under the terms of the GNU Library General Public License
agpl | You should have received a copy of the GNU Affero General Public License
fdl | Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License
mpl-2-0 | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0
mpl-2-0 | If a copy of the MPL was not distributed with this file, You can obtain one at
mpl-1-1 | The contents of this file are subject to the Mozilla Public License Version 1.1
apache-2-0 | Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License
apache-2-0 | Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements
apache-1-1 | This product includes software developed by the Apache Software Foundation
mit | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
mit | THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT
x11 | Except as contained in this notice, the name of the X Consortium shall not be used in advertising
json | The Software shall be used for Good, not Evil
isc | Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted
isc | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
bsd | Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd | Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
bsd | THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
bsd-3 | Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-4 | All advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clear | No express or implied licenses to any party's patent rights are granted by this license
zlib | Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib | The origin of this software must not be misrepresented; you must not claim that you wrote the original software
boost-1-0 | Distributed under the Boost Software License, Version 1.0
unlicense | This is free and unencumbered software released into the public domain
unlicense | Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary
wtfpl | Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
cc0 | has waived all copyright and related or neighboring rights
cc-by | This work is licensed under a Creative Commons Attribution
cc-by | This work is licensed under the Creative Commons Attribution
ofl | This Font Software is licensed under the SIL Open Font License
ofl | The Font Software may not be sold by itself
bitstream-vera | Bitstream Vera is a trademark of Bitstream, Inc
epl-2-0 | This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
epl-1-0 | This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0
cddl | The contents of this file are subject to the terms of the Common Development and Distribution License
cpl-1-0 | This program and the accompanying materials are made available under the terms of the Common Public License v1.0
eupl | Licensed under the EUPL
cecill | This software is governed by the CeCILL license under French law
python | PSF is making Python available to Licensee on an "AS IS" basis
openssl | This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
ssleay | This product includes cryptographic software written by Eric Young
php | This product includes PHP software, freely available from
perl | This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself
vim | There are no restrictions on distributing unmodified copies of Vim except that they must include this license text
postgresql | Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
hpnd | Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted
ntp | Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted
tcl | The authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose
libtiff | Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee
curl | Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale
ijg | This software is based in part on the work of the Independent JPEG Group
ftl | Portions of this software are copyright The FreeType Project
unicode | Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files
w3c | This work is being provided by the copyright holders under the following license
zpl | This software is subject to the provisions of the Zope Public License
ms-pl | This source code is subject to the Microsoft Public License
upl | Licensed under the Universal Permissive License v 1.0
nasa-1-3 | This open source agreement defines the rights of use, reproduction, distribution, modification and redistribution of certain computer software
sissl | The contents of this file are subject to the Sun Industry Standards Source License
apsl | This file contains Original Code and/or Modifications of Original Code as defined in and that are subject to the Apple Public Source License
npl | The contents of this file are subject to the Netscape Public License
lppl | This work may be distributed and/or modified under the conditions of the LaTeX Project Public License
qpl | This file may be distributed under the terms of the Q Public License
mulan | You can use this software according to the terms and conditions of the Mulan PSL
odbl | This database is made available under the Open Database License
ogl | Contains public sector information licensed under the Open Government Licence
elastic | You may not provide the software to third parties as a hosted or managed service
busl | Use of the Licensed Work is governed by the Business Source License
commons-clause | The Software is provided to you by the Licensor under the License, as defined below, subject to the following condition
polyform | The licensor grants you a copyright license for the software to do everything you might do with the software
proprietary | This file contains confidential and proprietary information
proprietary | This software contains trade secrets and proprietary information
proprietary | No part of this publication may be reproduced, stored in a retrieval system, or transmitted
proprietary | may not be reproduced without the prior written consent
proprietary | Reproduction without permission is prohibited
proprietary | You may not redistribute this file without permission
proprietary | You may not reverse engineer, decompile, or disassemble
no-commercial | This work may not be used for commercial purposes
public-domain | This work has been identified as being free of known restrictions under copyright law
public-domain | The author disclaims copyright to this source code
public-domain | This software was developed by employees of the United States government
"""

# Notices without a family: label, keyword, form, pattern.
SINGLE = [
    ("public-domain", "domain", "name", r"(?:dedicated to|placed in(?:to)?|released (?:in)?to) the public domain"),
    ("public-domain", "domain", "grant", r"(?:this (?:work|file|code|software) is )in the public domain"),
    ("mit", "permission", "grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", "grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", "grant", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3", "endorse", "grant", r"be used to endorse or promote products derived from this software"),
    ("zlib", "implied", "grant", r"provided as is without any express or implied warranty in no event"),
    ("gpl", "redistribute", "grant", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("unlicense", "unencumbered", "grant", r"free and unencumbered software released into the public domain"),
    ("copyright", "copyright", "name", r"copyright(?: c| ©)? (?:19|20)\d\d"),
    ("proprietary", "proprietary", "name", r"(?:proprietary|confidential) and (?:proprietary|confidential)"),
    ("proprietary", "unauthorized", "grant", r"unauthori[sz]ed (?:copying|use|distribution) (?:of this file )?(?:\w+ ){0,4}?(?:is )?(?:strictly )?prohibited"),
    ("no-commercial", "commercial", "name", r"(?:for )?non ?commercial use only"),
    ("apache-2-0", "apache", "address", r"apache org licenses license 2 0"),
    ("mit", "opensource", "address", r"opensource org licenses mit"),
    ("bsd-3", "opensource", "address", r"opensource org licenses bsd 3 clause"),
    ("gpl", "gnu", "address", r"gnu org licenses (?:old licenses )?gpl(?: \d \d)?"),
    ("lgpl", "gnu", "address", r"gnu org licenses (?:old licenses )?lgpl(?: \d \d)?"),
    ("mpl-2-0", "mozilla", "address", r"mozilla org mpl 2 0"),
]
for _parts in COMBINATIONS:
    SINGLE.append(("cc-" + _parts.replace(" ", "-"), "creativecommons", "address", rf"creativecommons org licenses {_parts}(?: \d \d)?"))


def build_rules():
    """(label, keyword, priority, confidence, pattern) of every rule, the strongest forms first."""
    rules = []

    def add(label, keyword, form, pattern):
        priority, confidence = FORMS[form]
        rules.append((label, keyword, priority, confidence, pattern))

    for label, keyword, name, versions in FAMILIES:
        for version in ("", *versions):
            full = f"{name} {version}" if version else name
            of = f"{label}-{version.removeprefix('v').replace(' ', '-')}" if version else label
            add(of, keyword, "grant", f"{GRANT} (?:an? )?{full}")
            add(of, keyword, "name", full)
    for name, versions in JOINED.items():
        for version in versions:
            full = f"{name}v?{version}(?: 0)?"
            for of, shape in ((f"{name}-{version.replace(' ', '-')}", full), (f"{name}-{version.replace(' ', '-')}-or-later", full + LATER)):
                add(of, name, "grant", f"{GRANT} (?:gnu )?{shape}")
                add(of, name, "name", shape)
    for identifier in IDENTIFIERS + [f"CC-{p}-{v}".replace(" ", "-") for p in COMBINATIONS for v in CC_VERSIONS]:
        words = as_words(identifier)
        label = words.replace(" ", "-")
        add(label, "spdx", "tag", f"{TAG} {words}")
        add(label, "licen", "field", f"{FIELD} {words}")
        add(label, "under", "grant", f"{GRANT} (?:an? )?{words}")
    for line in NOTICES.strip().splitlines():
        label, sentence = line.split(" | ")
        words = as_words(sentence)
        add(label, next(k for k in KEYWORDS if f" {k}" in f" {words}"), "grant", words)
    for rule in SINGLE:
        add(*rule)
    return sorted(dict.fromkeys(rules), key=lambda r: -r[2])


def as_words(sentence):
    """The words of a sentence, as the texts are compared with."""
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def gate(patterns):
    """One expression that fits every text that one of `patterns` fits."""
    # What begins or ends with another whole pattern needs no place of its own.
    known = set(patterns)
    least = sorted(p for p in known if not any(
        p != q and (p.startswith(q + " ") or p.endswith(" " + q) or p.endswith(" )?" + q)) for q in known))
    parts = []
    for head in (GRANT, TAG, FIELD):
        tails = [p.removeprefix(head) for p in least if p.startswith(head)]
        least = [p for p in least if not p.startswith(head)]
        parts += [f"{head}(?:{'|'.join(tails)})"] if tails else []
    return f" (?:{'|'.join(parts + least)}) "


RULES = build_rules()
PRIORITIES = max(priority for priority, _ in FORMS.values())

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_words(text: Column) -> Column:
    """The words of a text, each with a blank before it and one after the last."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    words = F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def words_in(text: Column) -> Column:
    """Number of blanks."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _intervals(text: Column, pattern: Column) -> Column:
    """Matches of a rule as (start, end) in words, in time that grows with the text."""
    # A match begins after a blank and ends before one, so words of it stay whole.
    shape = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    marked = F.split(F.regexp_replace(text, shape, F.lit("\u0001$0\u0002")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit("\u0002")), i)), lambda i: i.isNotNull())
    # The blank in front makes an empty first piece, so word `n` is piece `n + 1`.
    return F.zip_with(starts, ends, lambda a, b: F.struct((a - 1).cast("long").alias("start"), b.cast("long").alias("end")))


def _holds(text: Column, keywords) -> Column:
    """Whether every keyword begins a word of the text."""
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(f" {k}")) for k in keywords.split()])


def detections(text: Column, rules=RULES) -> Column:
    """Matches of all rules whose keywords occur, sorted so that what contains comes before what it contains."""
    by_keyword = {}
    for label, keyword, priority, confidence, pattern in rules:
        by_keyword.setdefault(keyword, []).append((label, priority, confidence, pattern))
    groups = []
    for keyword, group in by_keyword.items():
        # One expression to parse: a thousand rules built column by column take half a minute.
        table = F.expr("array(%s)" % ", ".join(
            f"named_struct('label', '{n}', 'priority', {p}, 'confidence', {c}D, 'pattern', r'{r}')" for n, p, c, r in group))
        fits = _holds(text, keyword) & F.rlike(text, F.lit(gate([r for *_, r in group])))
        groups.append(F.when(fits, table).otherwise(F.slice(table, 1, 0)))
    tried = F.filter(F.flatten(F.array(*groups)), lambda rule: F.rlike(text, F.concat(F.lit(" (?:"), rule["pattern"], F.lit(") "))))
    found = F.flatten(F.transform(tried, lambda rule: F.transform(
        _intervals(text, rule["pattern"]),
        lambda at: F.struct(
            at["start"].alias("start"), (-at["end"]).alias("stop"), (-rule["priority"]).alias("rank"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence")))))
    return F.array_sort(found)


def surviving(found: Column) -> Column:
    """(labels, confidence) of the detections that lie in no earlier one of at least their priority."""
    levels = range(PRIORITIES + 1)
    none = F.array(*[F.lit(0).cast("long")] * (PRIORITIES + 1))

    def step(acc, x):
        reach = reduce(F.greatest, [F.when(-x["rank"] <= F.lit(p), acc["reach"][p]).otherwise(F.lit(-1)) for p in levels])
        # Equal intervals of equal priority both stay.
        same = (acc["start"] == x["start"]) & (acc["stop"] == x["stop"]) & (acc["rank"] == x["rank"])
        keep = (reach < -x["stop"]) | same
        reached = F.transform(acc["reach"], lambda r, p: F.when(p == -x["rank"], F.greatest(r, -x["stop"])).otherwise(r))
        return F.struct(
            reached.alias("reach"),
            F.when(keep, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(keep, F.greatest(acc["confidence"], x["confidence"])).otherwise(acc["confidence"]).alias("confidence"),
            F.when(keep, x["start"]).otherwise(acc["start"]).alias("start"),
            F.when(keep, x["stop"]).otherwise(acc["stop"]).alias("stop"),
            F.when(keep, x["rank"]).otherwise(acc["rank"]).alias("rank"))

    start = F.struct(
        none.alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"),
        F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit(0).alias("rank"))
    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"], acc["confidence"]))


def scan_licenses(docs: DataFrame, text="text", rules=RULES, into="license") -> DataFrame:
    """Add a struct of word counts, labels and the score to every row."""
    words = plain_words(F.col(text))
    keywords = sorted({k for _, k, *_ in rules} | {phrase for phrase, _ in BASE})
    rows = docs.withColumn("corpusqa words", words)
    candidate = reduce(lambda a, b: a | b, [_holds(F.col("corpusqa words"), k) for k in keywords])

    n_words = F.when(F.col("corpusqa words") == "  ", 0).otherwise(words_in(F.col("corpusqa words")) - 1)
    base = [_intervals(F.col("corpusqa words"), F.lit(phrase))["start"] for phrase, _ in BASE]
    base = [F.when(F.contains(F.col("corpusqa words"), F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<bigint>")) for (phrase, _), starts in zip(BASE, base)]
    none = F.array().cast("array<string>")
    rows = rows.withColumn("corpusqa starts", F.when(candidate, F.array(*base)))
    rows = rows.withColumn("corpusqa method", F.when(candidate, surviving(detections(F.col("corpusqa words"), rules))))
    places = F.coalesce(F.flatten(F.col("corpusqa starts")), F.array().cast("array<bigint>"))
    labels = F.concat(*[F.when(F.size(F.col("corpusqa starts")[i]) > 0, F.array(F.lit(label))).otherwise(none) for i, (_, label) in enumerate(BASE)])
    base_labels = F.array_sort(F.array_distinct(labels))
    every = F.array_sort(F.array_union(base_labels, F.coalesce(F.col("corpusqa method")["labels"], none)))
    score = F.greatest(F.coalesce(F.col("corpusqa method")["confidence"], F.lit(0.0)), F.when(F.size(base_labels) > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    result = F.struct(
        n_words.cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
    return rows.withColumn(into, result).drop("corpusqa words", "corpusqa starts", "corpusqa method")


def license_table(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places and labels, all labels, and the score."""
    scanned = scan_licenses(docs.select("doc_id", "text"))
    return scanned.select("doc_id", "license.*")
