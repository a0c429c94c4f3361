"""Signature rules for licence texts and notices, over lower-case words joined by single blanks.

Rules come in groups. One of a group's keywords, words that are rare outside of notices of that
licence, must be in the text before any of its patterns is tried. A rule has a label, a priority (a lower
number wins) and a confidence. Patterns start with the blank before the first word and look ahead
for the blank after the last. Clauses of licence texts are written by hand, one rule for each;
identifiers, addresses and notices are made from licence names and wordings.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    pattern: str
    label: str
    priority: int
    confidence: float


class Group(NamedTuple):
    keywords: tuple[str, ...]
    rules: tuple[Rule, ...]


# The phrases and labels that every result must have.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

_LICENSE = "(?:licen[cs]e|licence)"

# The author's choice: label, pattern of the name, keywords, identifier words, and address words.
FAMILIES = [
    ("mit", f"(?:mit|expat|mit x11|x11) {_LICENSE}", ("mit licen", "expat licen", "x11 licen", "identifier mit ", "licenses mit ",), "mit", "opensource org licenses mit"),
    ("mit-0", f"mit (?:no attribution|0)(?: {_LICENSE})?", ("mit no attribution", "mit 0 ",), "mit 0", "opensource org licenses mit 0"),
    ("apache-1.1", f"apache (?:software )?{_LICENSE}(?: v| version)? 1 1", ("apache",), "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", f"apache (?:software )?{_LICENSE}(?: v| version)? ?2(?: 0)?", ("apache",), "apache 2 0", "apache org licenses license 2 0"),
    ("apache", f"apache (?:software )?{_LICENSE}", ("apache",), "apache", "apache org licenses"),
    ("gpl-1.0", f"(?:gnu )?(?:general public {_LICENSE}|gpl) ?(?:v|version )?1(?: 0)?", ("gpl", "general public",), "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", f"(?:gnu )?(?:general public {_LICENSE}|gpl) ?(?:v|version )?2(?: 0)?", ("gpl", "general public",), "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", f"(?:gnu )?(?:general public {_LICENSE}|gpl) ?(?:v|version )?3(?: 0)?", ("gpl", "general public",), "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", f"(?:gnu general public {_LICENSE}|gnu gpl|gpl {_LICENSE})", ("gpl", "general public",), "gpl", "gnu org licenses gpl"),
    ("lgpl-2.0", f"(?:gnu )?(?:library general public {_LICENSE}|lgpl) ?(?:v|version )?2(?: 0)?", ("lgpl", "general public",), "lgpl 2 0(?: only| or later)?", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", f"(?:gnu )?(?:lesser general public {_LICENSE}|lgpl) ?(?:v|version )?2 1", ("lgpl", "general public",), "lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", f"(?:gnu )?(?:lesser general public {_LICENSE}|lgpl) ?(?:v|version )?3(?: 0)?", ("lgpl", "general public",), "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", f"(?:gnu (?:lesser|library) general public {_LICENSE}|gnu lgpl|lgpl {_LICENSE})", ("lgpl", "general public",), "lgpl", "gnu org licenses lgpl"),
    ("agpl-3.0", f"(?:gnu )?(?:affero general public {_LICENSE}|agpl) ?(?:v|version )?3(?: 0)?", ("agpl", "affero",), "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", f"(?:gnu affero general public {_LICENSE}|gnu agpl|agpl {_LICENSE})", ("agpl", "affero",), "agpl", "gnu org licenses agpl"),
    ("gfdl", f"(?:gnu )?free documentation {_LICENSE}", ("free documentation", "gfdl", "licenses fdl",), "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl"),
    ("bsd-2-clause", f"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: {_LICENSE})?", ("bsd",), "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", f"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)(?: {_LICENSE})?", ("bsd",), "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", f"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: {_LICENSE})?", ("bsd",), "bsd 4 clause", "opensource org licenses bsd 4 clause"),
    ("bsd-0-clause", f"(?:bsd zero clause|0bsd|zero clause bsd)(?: {_LICENSE})?", ("bsd",), "0bsd", "opensource org licenses 0bsd"),
    ("bsd", f"bsd(?: style)? {_LICENSE}", ("bsd",), "bsd", "opensource org licenses bsd license"),
    ("isc", f"isc {_LICENSE}", (" isc ",), "isc", "opensource org licenses isc"),
    ("mpl-1.1", f"(?:mozilla public {_LICENSE}|mpl)(?: v| version)? 1 1", ("mozilla", " mpl ",), "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", f"(?:mozilla public {_LICENSE}|mpl)(?: v| version)? 2(?: 0)?", ("mozilla", " mpl ",), "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", f"mozilla public {_LICENSE}", ("mozilla", " mpl ",), "mpl", "mozilla org mpl"),
    ("epl-1.0", f"(?:eclipse public {_LICENSE}|epl)(?: v| version)? 1(?: 0)?", ("eclipse", " epl ",), "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", f"(?:eclipse public {_LICENSE}|epl)(?: v| version)? 2(?: 0)?", ("eclipse", " epl ",), "epl 2 0", "eclipse org legal epl 2 0"),
    ("edl-1.0", f"eclipse distribution {_LICENSE}(?:(?: v| version)? 1(?: 0)?)?", ("eclipse", " edl ",), "edl 1 0", "eclipse org org documents edl v10"),
    ("cddl", f"(?:common development and distribution {_LICENSE}|cddl)", ("cddl", "common development",), "cddl 1 [01]", "opensource org licenses cddl"),
    ("eupl", f"(?:european union public {_LICENSE}|eupl)", ("eupl", "european union public",), "eupl 1 [12]", "joinup ec europa eu collection eupl"),
    ("cecill", f"cecill(?: free software)?(?: {_LICENSE}(?: agreement)?)?", ("cecill",), "cecill(?: 2 [01]| b| c)?", "cecill info licences"),
    ("artistic-2.0", f"artistic {_LICENSE}(?: v| version)? 2(?: 0)?", ("artistic",), "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("artistic", f"(?:perl )?artistic {_LICENSE}", ("artistic",), "artistic 1 0(?: perl)?", "opensource org licenses artistic"),
    ("bsl-1.0", f"boost software {_LICENSE}(?:(?: v| version)? 1(?: 0)?)?", ("boost", " bsl ",), "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", f"business source {_LICENSE}(?:(?: v| version)? 1(?: 1)?)?", ("business source", " busl ", "bsl11",), "busl 1 1", "mariadb com bsl11"),
    ("sspl", f"server side public {_LICENSE}", ("server side public", " sspl ",), "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", f"elastic {_LICENSE}(?:(?: v| version)? 2(?: 0)?)?", ("elastic",), "elastic 2 0", "elastic co licensing elastic license"),
    ("zlib", f"zlib(?: libpng)? {_LICENSE}", ("zlib",), "zlib", "opensource org licenses zlib"),
    ("libpng", f"libpng {_LICENSE}", ("libpng",), "libpng(?: 2 0)?", "libpng org pub png src libpng license"),
    ("unlicense", "(?:the )?unlicense", ("unlicense",), "unlicense", "unlicense org"),
    ("wtfpl", f"(?:wtfpl|do what the fuck you want to public {_LICENSE})", ("wtfpl", "want to public",), "wtfpl", "wtfpl net"),
    ("ofl-1.1", f"(?:sil )?open font {_LICENSE}(?:(?: v| version)? 1(?: 1)?)?", ("open font", " ofl ",), "ofl 1 1", "scripts sil org ofl"),
    ("psf", f"(?:python software foundation|psf) {_LICENSE}(?: agreement)?", ("python software foundation", " psf ", "python 2 0", "docs python org",), "(?:psf 2 0|python 2 0)", "docs python org license"),
    ("postgresql", f"postgresql {_LICENSE}", ("postgresql",), "postgresql", "opensource org licenses postgresql"),
    ("ruby", f"ruby {_LICENSE}", ("ruby",), "ruby", "ruby lang org en about license"),
    ("php", f"php {_LICENSE}", (" php ",), "php 3 01?", "php net license"),
    ("openssl", f"openssl {_LICENSE}", ("openssl",), "openssl", "openssl org source license"),
    ("odbl", f"open (?:data commons )?(?:open )?database {_LICENSE}", ("database", "odbl",), "odbl 1 0", "opendatacommons org licenses odbl"),
    ("cc0", "(?:cc0|creative commons zero|cc zero)(?: 1 0)?(?: universal)?", ("cc0", "commons zero", "cc zero", "publicdomain zero",), "cc0 1 0", "creativecommons org publicdomain zero"),
    ("cc-by", f"(?:cc by|creative commons attribution)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: {_LICENSE})?", (" cc by ", "commons attribution", "creativecommons",), "cc by [1-4] [05]", "creativecommons org licenses by"),
    ("cc-by-sa", f"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?(?: {_LICENSE})?", (" cc by ", "commons attribution", "creativecommons",), "cc by sa [1-4] [05]", "creativecommons org licenses by sa"),
    ("cc-by-nd", f"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?(?: {_LICENSE})?", (" cc by ", "commons attribution", "creativecommons",), "cc by nd [1-4] [05]", "creativecommons org licenses by nd"),
    ("cc-by-nc", f"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?(?: {_LICENSE})?", (" cc by ", "commons attribution", "creativecommons",), "cc by nc [1-4] [05]", "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", f"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?(?: {_LICENSE})?", (" cc by ", "commons attribution", "creativecommons",), "cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", f"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?(?: {_LICENSE})?", (" cc by ", "commons attribution", "creativecommons",), "cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd"),
    ("public-domain", "(?:in|into|to|as) the public domain", ("public domain", "publicdomain mark",), "public domain", "creativecommons org publicdomain mark"),
    ("proprietary", "all rights reserved", ("rights reserved", "licenseref proprietary",), "licenseref proprietary", "legal all rights reserved"),
]

# The author's choice: wordings around a name. Pattern, priority, confidence; {name} stands for the name's pattern.
WORDINGS = [
    ("(?:licensed|released|distributed|available|provided|published|issued|covered|shared|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", 3, 0.95),
    ("(?:dual|also|re|sub) ?licensed under (?:the )?{name}", 3, 0.95),
    ("subject to the (?:terms (?:and conditions )?of the )?{name}", 4, 0.9),
    ("(?:copy|terms|text|provisions|conditions) of the {name}", 5, 0.8),
    ("(?:see|governed by|compliance with|according to|refer to|use|uses) the {name}", 5, 0.8),
    ("{name}", 7, 0.6),
]

# The author's choice: a notice that a licence does not apply wins over the notice inside it and has a label of its own.
DENIED = "(?:not|never|neither|no longer|nor) (?:be )?(?:licensed|released|distributed|available|covered|provided) under (?:the )?(?:terms of (?:the )?)?{name}"

# Sentences of the public licence texts and of the notices they ask for, as words, with the
# keyword that leads to them. A clause that several licences share is labelled with the family.
TEXTS = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "warranties of merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "claim damages", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", "the software is provided as is and the (?:author|copyright holder|isc) disclaims all warranties with regard to this software"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:the )?(?:[^ ]+ ){1,12}(?:nor|or) the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse or promote", "the names? of the (?:author|authors|copyright holder|company) may not be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "exemplary or consequential", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-0-clause", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "permissions and limitations", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "grant of copyright license", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2", "terms and conditions for use", "apache license version 2 0 january 2004 (?:http |https )?(?:www apache org licenses )?terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl-2.0+", "general public", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0+", "general public", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1+", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0+", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0+", "library general public", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3.0+", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "general public", "under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-2.0+", " later", "(?:gnu )?(?:gpl|general public license)(?: v| version)? ?2(?: 0)? or (?:later|any later version)"),
    ("gpl-3.0+", " later", "(?:gnu )?(?:gpl|general public license)(?: v| version)? ?3(?: 0)? or (?:later|any later version)"),
    ("lgpl-2.1+", " later", "(?:gnu )?(?:lgpl|lesser general public license)(?: v| version)? ?2 1 or (?:later|any later version)"),
    ("lgpl-3.0+", " later", "(?:gnu )?(?:lgpl|lesser general public license)(?: v| version)? ?3(?: 0)? or (?:later|any later version)"),
    ("agpl-3.0+", " later", "(?:gnu )?(?:agpl|affero general public license)(?: v| version)? ?3(?: 0)? or (?:later|any later version)"),
    ("gpl", "general public", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "general public", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)"),
    ("lgpl", "lesser general public", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file|package)"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file|package)"),
    ("gpl", "copy and distribute verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("agpl-3.0", "remotely through a computer", "users interacting with it remotely through a computer network an opportunity to receive the corresponding source"),
    ("gpl-with-classpath-exception", "classpath exception", "classpath exception(?: 2 0)?"),
    ("gpl-with-classpath-exception", "combined work", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-with-gcc-exception", "runtime library exception", "gcc runtime library exception"),
    ("apache-2-with-llvm-exception", "llvm exception", "(?:with )?(?:the )?llvm exceptions?"),
    ("gpl-with-font-exception", "font exception", "(?:with )?(?:the )?(?:gpl )?font exception"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla", "if a copy of the mpl was not distributed with this file you can obtain one at (?:http |https )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "machine executable object", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "want to", "you just do what the fuck you want to"),
    ("cc0", "waived all copyright", "(?:has|have) waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "creative commons", "this work is licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))? license"),
    ("cc-by-sa", "creative commons", "this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))? license"),
    ("cc-by-nc", "creative commons", "this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))? license"),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("psf", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("artistic-2.0", "free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic", "artistic control", "such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("eupl", "eupl", "licensed under the eupl version 1 [12] or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("elastic-2.0", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "functionality of the program", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("odbl", "database", "this database is made available under the open database license"),
    ("public-domain", "public domain", "(?:has been |is )?(?:hereby )?(?:placed|dedicated|released) (?:in|into|to) the public domain"),
    ("proprietary", "confidential", "(?:this (?:software|document|work) (?:is|contains) (?:the )?)?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,12} strictly prohibited"),
    ("proprietary", "prior written", "no part of this (?:publication|work|document|book|software) may be reproduced(?: [^ ]+){0,25} without the prior written (?:permission|consent)"),
]


def groups() -> list[Group]:
    """All signatures in their order: by licence its identifier, address, denial and notices, then the clauses by keyword."""
    out = []
    for label, name, keywords, identifier, address in FAMILIES:
        rules = [
            Rule(f" spdx license identifier {identifier}(?= )", label, 0, 1.0),
            Rule(f" {address}(?= )", label, 2, 0.9),
            Rule(f" {DENIED.replace('{name}', name)}(?= )", f"not-{label}", 1, 0.9),
        ]
        for wording, priority, confidence in WORDINGS:
            rules.append(Rule(f" {wording.replace('{name}', name)}(?= )", label, priority, confidence))
        out.append(Group(keywords, tuple(rules)))
    clauses: dict[str, list[Rule]] = {}
    for label, keyword, words in TEXTS:
        clauses.setdefault(keyword, []).append(Rule(f" {words}(?= )", label, 1, 1.0))
    return out + [Group((keyword,), tuple(rules)) for keyword, rules in clauses.items()]


def rules() -> list[Rule]:
    return [rule for group in groups() for rule in group.rules]
