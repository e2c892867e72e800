"""Signature rules for licenses: hand-written expressions, each with the keywords that every match holds.

Expressions are read on texts with A-Z lower-cased. A space stands for any run of white space and
light punctuation, ``~`` for such a run or nothing. A rule is tried on a text only if all of its keywords occur there;
they are single words, whatever stands between them.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    form: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


#: Forms from the strongest to the weakest, with confidence; the stronger form has the higher priority.
FORMS = {"tag": 0.99, "grant": 0.95, "field": 0.9, "text": 0.9, "link": 0.85, "name": 0.7, "family": 0.5, "hint": 0.2}

#: Label; keyword; the license's full name; its short name, as tags, fields and grants have it.
LICENSES = r"""
mit | mit | (?:the )?mit~(?:x11 )?licen[sc]e | mit
mit-0 | mit | mit no attribution(?: licen[sc]e)? | mit-0
apache-1.0 | apache | apache(?: software)? licen[sc]e v?(?:ersion )?1\.0 | apache~(?:licen[sc]e~)?1\.0
apache-1.1 | apache | apache(?: software)? licen[sc]e v?(?:ersion )?1\.1 | apache~(?:licen[sc]e~)?1\.1
apache-2.0 | apache | apache(?: software)? licen[sc]e v?(?:ersion )?2(?:\.0)? | apache~(?:licen[sc]e~)?v?2(?:\.0)?
gpl-1.0 | gpl | gnu gpl v?(?:ersion )?1(?:\.0)? | gpl~v?1(?:\.0)?
gpl-2.0 | gpl | gnu gpl v?(?:ersion )?2(?:\.0)? | gpl~v?2(?:\.0)?
gpl-3.0 | gpl | gnu gpl v?(?:ersion )?3(?:\.0)? | gpl~v?3(?:\.0)?
gpl-1.0 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?v?(?:ersion )?1(?:\.0)? | gnu general public licen[sc]e v1
gpl-2.0 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?v?(?:ersion )?2(?:\.0)? | gnu general public licen[sc]e v2
gpl-3.0 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?v?(?:ersion )?3(?:\.0)? | gnu general public licen[sc]e v3
lgpl-2.0 | library general | gnu library general public licen[sc]e v?(?:ersion )?2(?:\.0)? | gnu library gpl
lgpl-2.1 | lgpl | gnu lgpl v?(?:ersion )?2\.1 | lgpl~v?2\.1
lgpl-3.0 | lgpl | gnu lgpl v?(?:ersion )?3(?:\.0)? | lgpl~v?3(?:\.0)?
lgpl-2.1 | lesser general | gnu lesser general public licen[sc]e(?: as published by the free software foundation)? (?:either )?v?(?:ersion )?2\.1 | gnu lesser general public licen[sc]e v2\.1
lgpl-3.0 | lesser general | gnu lesser general public licen[sc]e(?: as published by the free software foundation)? (?:either )?v?(?:ersion )?3(?:\.0)? | gnu lesser general public licen[sc]e v3
agpl-3.0 | agpl | gnu agpl(?: v?(?:ersion )?3(?:\.0)?)? | agpl~v?3(?:\.0)?
agpl-3.0 | affero | gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: (?:either )?v?(?:ersion )?3(?:\.0)?)? | gnu affero gpl
gfdl-1.1 | free documentation | gnu free documentation licen[sc]e v?(?:ersion )?1\.1 | gfdl~1\.1
gfdl-1.2 | free documentation | gnu free documentation licen[sc]e v?(?:ersion )?1\.2 | gfdl~1\.2
gfdl-1.3 | free documentation | gnu free documentation licen[sc]e v?(?:ersion )?1\.3 | gfdl~1\.3
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)? | bsd~2(?:~clause)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)? | bsd~3(?:~clause)?
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)? | bsd~4(?:~clause)?
0bsd | bsd | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)? | 0bsd
isc | isc | isc licen[sc]e | isc
mpl-1.0 | mozilla | mozilla public licen[sc]e v?(?:ersion )?1\.0 | mozilla public licen[sc]e 1\.0
mpl-1.1 | mozilla | mozilla public licen[sc]e v?(?:ersion )?1\.1 | mozilla public licen[sc]e 1\.1
mpl-2.0 | mozilla | mozilla public licen[sc]e v?(?:ersion )?2(?:\.0)? | mozilla public licen[sc]e v?2(?:\.0)?
mpl-2.0 | mpl | mpl v?(?:ersion )?2(?:\.0)? | mpl~v?2(?:\.0)?
epl-1.0 | eclipse | eclipse public licen[sc]e v?(?:ersion )?1(?:\.0)? | eclipse public licen[sc]e v1
epl-2.0 | eclipse | eclipse public licen[sc]e v?(?:ersion )?2(?:\.0)? | eclipse public licen[sc]e v2
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?: v?(?:ersion )?1(?:\.0)?)? | eclipse distribution licen[sc]e
cddl-1.0 | common development | common development and distribution licen[sc]e(?: v?(?:ersion )?1\.0)? | cddl~1\.0
cddl-1.1 | common development | common development and distribution licen[sc]e v?(?:ersion )?1\.1 | cddl~1\.1
cpl-1.0 | common public | common public licen[sc]e(?: v?(?:ersion )?1\.0)? | common public licen[sc]e
ipl-1.0 | ibm | ibm public licen[sc]e(?: v?(?:ersion )?1\.0)? | ibm public licen[sc]e
eupl-1.1 | european union | european union public licen[sc]e v?(?:ersion )?1\.1 | eupl~v?1\.1
eupl-1.2 | european union | european union public licen[sc]e(?: v?(?:ersion )?1\.2)? | eupl~v?1\.2
artistic-1.0 | artistic | artistic licen[sc]e v?(?:ersion )?1(?:\.0)? | artistic~1(?:\.0)?
artistic-2.0 | artistic | artistic licen[sc]e v?(?:ersion )?2(?:\.0)? | artistic~2(?:\.0)?
bsl-1.0 | boost | boost software licen[sc]e(?: v?(?:ersion )?1(?:\.0)?)? | boost(?: software)?(?: licen[sc]e)?
busl-1.1 | business source | business source licen[sc]e(?: v?(?:ersion )?1\.1)? | busl~1\.1
zlib | zlib | zlib(?: libpng)? licen[sc]e | zlib
libpng | libpng | libpng licen[sc]e | libpng
python-2.0 | python software foundation | python software foundation licen[sc]e(?: v?(?:ersion )?2)? | psf~2(?:\.0)?
php-3.01 | php | php licen[sc]e(?: v?(?:ersion )?3\.01)? | php~3\.01
ruby | ruby | ruby licen[sc]e | ruby
postgresql | postgresql | postgresql licen[sc]e | postgresql
openssl | openssl | openssl licen[sc]e | openssl
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?: v?(?:ersion )?1\.1)? | ofl~1\.1
ms-pl | microsoft public | microsoft public licen[sc]e | ms-pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e | ms-rl
upl-1.0 | universal permissive | universal permissive licen[sc]e(?: v?(?:ersion )?1\.0)? | upl~1\.0
unlicense | unlicense | the unlicense | unlicense
wtfpl | wtfpl | wtfpl(?: v?(?:ersion )?2)? | wtfpl
afl-3.0 | academic free | academic free licen[sc]e(?: v?(?:ersion )?3\.0)? | afl~3\.0
osl-3.0 | open software | open software licen[sc]e(?: v?(?:ersion )?3\.0)? | osl~3\.0
ecl-2.0 | educational community | educational community licen[sc]e(?: v?(?:ersion )?2\.0)? | ecl~2\.0
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa
cecill-2.1 | cecill | cecill(?: free software)? licen[sc]e(?: agreement)?(?: v?(?:ersion )?2\.1)? | cecill~2\.1
vim | vim | vim licen[sc]e | vim
w3c | w3c | w3c software(?: notice and)? licen[sc]e | w3c
odbl-1.0 | open database | open database licen[sc]e(?: v?(?:ersion )?1\.0)? | odbl~1\.0
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e(?: v?(?:ersion )?1\.0)? | odc-by~1\.0
pddl-1.0 | public domain dedication | (?:odc )?public domain dedication and licen[sc]e | pddl~1\.0
etalab-2.0 | etalab | (?:etalab open licen[sc]e|licence ouverte etalab)(?: v?(?:ersion )?2\.0)? | etalab~2\.0
ogl-3.0 | open government | open government licen[sc]e(?: v?(?:ersion )?3\.0)? | ogl~3\.0
sspl-1.0 | server side | server side public licen[sc]e(?: v?(?:ersion )?1)? | sspl~1\.0
elastic-2.0 | elastic | elastic licen[sc]e v?(?:ersion )?2(?:\.0)? | elastic~2\.0
llama-3 | llama | (?:meta )?llama 3 community licen[sc]e | llama3
openrail-m | open rail | (?:creativeml |bigscience )?open~rail m(?: licen[sc]e)? | openrail
cc0-1.0 | cc0 | cc0(?: v?(?:ersion )?1\.0)?(?: universal)? | cc0~1\.0
"""

#: Attribution licenses: parts after CC BY as short and as full names.
CREATIVE = {
    "": "attribution",
    "sa": "attribution share~alike",
    "nd": "attribution no~deriv(?:ative)?s?",
    "nc": "attribution non~commercial",
    "nc-sa": "attribution non~commercial share~alike",
    "nc-nd": "attribution non~commercial no~deriv(?:ative)?s?",
}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Label; form; keywords, all of which a match holds; expression: words of the licenses' own texts, links, families and hints.
SIGNATURES = r"""
mit | text | permission is hereby granted | permission is hereby granted,? free of charge,? to any person obtaining a copy
mit | text | the software is provided | the software is provided as is,? without warranty of any kind,? express or implied
mit | link | opensource.org/licen | opensource\.org/licen[sc]es?/mit
isc | text | permission to use | permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee
0bsd | text | permission to use | permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. the software
apache-2.0 | text | you may not use this file | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | text | apache | licensed under the apache licen[sc]e,? version 2\.0 \(?the licen[sc]e
apache-2.0 | link | apache.org/licen | apache\.org/licen[sc]es/licen[sc]e-2\.0
apache-1.1 | text | this product includes software | this product includes software developed by the apache software foundation
bsd-2-clause | text | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | text | endorse or promote | (?:neither the names? of|may not be used to) [^.]{0,120}endorse or promote products derived from this software
bsd-4-clause | text | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd-3-clause | link | opensource.org/licen | opensource\.org/licen[sc]es?/bsd-3-clause
bsd-2-clause | link | opensource.org/licen | opensource\.org/licen[sc]es?/bsd-2-clause
gpl-3.0 | link | gnu.org/licen | gnu\.org/licen[sc]es/gpl-3\.0
gpl-2.0 | link | gnu.org/licen | gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\.0
lgpl-3.0 | link | gnu.org/licen | gnu\.org/licen[sc]es/lgpl-3\.0
lgpl-2.1 | link | gnu.org/licen | gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?lgpl-2\.1
agpl-3.0 | link | gnu.org/licen | gnu\.org/licen[sc]es/agpl-3\.0
gpl | text | free software foundation | under the terms of the gnu general public licen[sc]e as published by the free software foundation
gpl | text | gnu general public | you should have received a copy of the gnu general public licen[sc]e
lgpl | text | gnu lesser general public | you should have received a copy of the gnu lesser general public licen[sc]e
agpl-3.0 | text | gnu affero | you should have received a copy of the gnu affero general public licen[sc]e
lgpl | family | gnu lesser general public | gnu lesser general public licen[sc]e
lgpl | family | gnu library general public | gnu library general public licen[sc]e
gpl | family | gnu general public | gnu general public licen[sc]e
gpl | family | gnu gpl | gnu gpl
apache | family | apache | apache(?: software)? licen[sc]e
bsd | family | bsd | bsd(?: style)? licen[sc]e
mozilla | family | mozilla | mozilla public licen[sc]e
eclipse | family | eclipse | eclipse public licen[sc]e
artistic | family | artistic | artistic licen[sc]e
gfdl | family | free documentation | gnu free documentation licen[sc]e
creative-commons | family | creative commons | creative commons(?: licen[sc]e)?
mpl-2.0 | text | mozilla public | this source code form is subject to the terms of the mozilla public licen[sc]e,? v\. ?2\.0
mpl-2.0 | link | mozilla.org/mpl | mozilla\.org/mpl/2\.0
epl-2.0 | link | eclipse.org/legal | eclipse\.org/legal/epl-2\.0
epl-1.0 | link | eclipse.org/legal | eclipse\.org/legal/epl-v10
bsl-1.0 | link | boost.org/licen | boost\.org/licen[sc]e_1_0\.txt
bsl-1.0 | text | permission is hereby granted | permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software
zlib | text | this software is provided | this software is provided as-is,? without any express or implied warranty\. in no event will the authors be held liable
zlib | text | altered source versions | altered source versions must be plainly marked as such
unlicense | text | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | link | unlicense.org | unlicense\.org
wtfpl | text | what the fuck | do what the fuck you want to public licen[sc]e
cc0-1.0 | text | waived all copyright | waived all copyright and related or neighboring rights
cc0-1.0 | link | creativecommons.org/publicdomain | creativecommons\.org/publicdomain/zero/1\.0
ofl-1.1 | link | scripts.sil.org | scripts\.sil\.org/ofl
artistic-2.0 | link | opensource.org/licen | opensource\.org/licen[sc]es?/artistic-2\.0
postgresql | text | permission to use | permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee
python-2.0 | text | psf is making python | psf is making python available to licensee on an as is basis
openssl | text | openssl project | this product includes software developed by the openssl project
php-3.01 | text | php software | this product includes php software
beerware | text | beer | the beer-ware licen[sc]e
json | text | good, not evil | the software shall be used for good, not evil
public-domain | text | public domain | (?:placed|released|dedicated|is|are) (?:in|into|to) the public domain
public-domain | hint | public domain | public domain
proprietary | text | all rights reserved | all rights reserved\.? (?:no part of|unauthori[sz]ed|confidential|do not (?:copy|distribute))
proprietary | text | proprietary and confidential | proprietary and confidential
proprietary | hint | all rights reserved | all rights reserved
"""

_RUN = r"""[\s"'(),;:*#>/_-]"""
_VERBS = "(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|shared|covered)"


def _compiled(text: str) -> re.Pattern:
    spaced = text.replace(" ", _RUN + "{1,16}").replace("~", _RUN + "{0,16}")
    return re.compile(rf"(?<!\w)(?:{spaced})(?!\w)")


def _rule(label: str, form: str, keywords: tuple[str, ...], text: str) -> Rule:
    words = tuple(sorted({w for k in keywords for w in k.split()}, key=len, reverse=True))
    return Rule(label, form, len(FORMS) - list(FORMS).index(form), FORMS[form], words, _compiled(text))


def _lines(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def _forms(label: str, keyword: str, full: str, short: str) -> list[Rule]:
    """A license's rules: its tag; grants and fields of metadata with either name; its full name."""
    tag = re.escape(label).replace(r"\-", "-")
    out = [_rule(label, "tag", ("spdx-licen", label.split("-")[0]), rf"spdx-licen[sc]e-identifier:[\x20\t]*{tag}(?:-only|-or-later)?")]
    for key, named in ((keyword, full), (re.match("[a-z0-9]+", short).group(), short)):
        out += [
            _rule(label, "grant", (key, "under"), rf"{_VERBS}(?: and \w+)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{named})"),
            _rule(label, "field", (key, "licen"), rf"licen[sc]es?~[=:]~(?:{named})"),
        ]
    return [*out, _rule(label, "name", (keyword,), full)]


def _creative() -> list[Rule]:
    rules = []
    for parts, full in CREATIVE.items():
        short = "cc by" + "".join(f" {p}" for p in parts.split("-") if p)
        path = "by" + (f"-{parts}" if parts else "")
        for version in VERSIONS:
            label, v = f"cc-{path}-{version}", version.replace(".", r"\.")
            rules += [
                _rule(label, "tag", ("spdx-licen", "cc-by"), rf"spdx-licen[sc]e-identifier:[\x20\t]*cc-{path}-{v}"),
                _rule(label, "grant", ("under", "cc", "by"), rf"{_VERBS}(?: and \w+)? under(?: an?| the)?(?: terms of the)? {short} v?{v}"),
                _rule(label, "link", ("creativecommons.org/licen",), rf"creativecommons\.org/licen[sc]es/{path}/{v}"),
                _rule(label, "name", ("creative commons",), rf"creative commons {full} (?:(?:international|unported|generic|licen[sc]e) )*(?:version )?v?{v}"),
            ]
        rules.append(_rule(f"cc-{path}", "family", ("creative commons",), rf"creative commons {full}"))
    return rules


def _creative_short() -> list[Rule]:
    """Short names such as CC BY-SA 4.0; with and without their versions."""
    rules = []
    for parts in CREATIVE:
        short = "cc by" + "".join(f" {p}" for p in parts.split("-") if p)
        label = "cc-by" + (f"-{parts}" if parts else "")
        rules += [_rule(f"{label}-{v}", "name", ("cc by",), rf"{short} v?{re.escape(v)}") for v in VERSIONS]
        rules.append(_rule(label, "family", ("cc by",), short))
    return rules


def rules() -> list[Rule]:
    """All rules, in order."""
    out = [rule for line in _lines(LICENSES) for rule in _forms(*line)]
    out += _creative() + _creative_short()
    out += [_rule(label, form, (keyword,), text) for label, form, keyword, text in _lines(SIGNATURES)]
    return list({(rule.label, rule.form, rule.pattern.pattern): rule for rule in out}.values())
