"""Signatures of licences: regular expressions over lower-cased words joined by single spaces.

Each licence is written by hand: the words of its name, of its SPDX identifier and of its address. ``rules`` makes a rule
of each form in which a licence is cited.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Label | words of which every citation has one | name | identifier | address, the last three as
# expressions over words. "#2 0" is a version: "2 0", "v2 0" or "version 2 0".
LICENCES = r"""
apache-1.0 | apache | apache (?:software )?licen[sc]e #1 0 | apache 1 0 | apache org licenses license 1 0
apache-1.1 | apache | apache (?:software )?licen[sc]e #1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache (?:software )?licen[sc]e #2(?: 0)? | apache 2 0 | apache org licenses license 2 0
mit | mit | mit(?: x11)? licen[sc]e | mit | opensource org licenses? mit
mit-0 | mit | mit no attribution | mit 0 | opensource org licenses? mit 0
x11 | x11 | x11 licen[sc]e | x11 | xfree86 org x11
bsd-2-clause | bsd | (?:simplified|freebsd|(?:2|two) clause) bsd | bsd 2 clause | opensource org licenses? bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised|(?:3|three) clause) bsd | bsd 3 clause | opensource org licenses? bsd 3 clause
bsd-4-clause | bsd | (?:original|old|(?:4|four) clause) bsd | bsd 4 clause | spdx org licenses bsd 4 clause
0bsd | 0bsd | 0bsd licen[sc]e | 0bsd | opensource org licenses? 0bsd
bsl-1.0 | boost bsl | boost software licen[sc]e | bsl 1 0 | boost org license 1 0
isc | isc | isc licen[sc]e | isc | opensource org licenses? isc
gpl-1.0 | general gpl | (?:gnu )?(?:general public licen[sc]e|gpl) #1(?: 0)? | gpl 1 0 | gnu org licenses old licenses gpl 1 0
gpl-2.0 | general gpl | (?:gnu )?(?:general public licen[sc]e|gpl) #2(?: 0)? | gpl 2 0 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | general gpl | (?:gnu )?(?:general public licen[sc]e|gpl) #3(?: 0)? | gpl 3 0 | gnu org licenses gpl 3 0
gpl-2.0-or-later | general gpl | (?:gnu )?(?:general public licen[sc]e|gpl) #2(?: 0)? or (?:at your option )?(?:any )?later(?: version)? | gpl 2 0 or later | gnu org licenses gpl 2 0 or later
gpl-3.0-or-later | general gpl | (?:gnu )?(?:general public licen[sc]e|gpl) #3(?: 0)? or (?:at your option )?(?:any )?later(?: version)? | gpl 3 0 or later | gnu org licenses gpl 3 0 or later
lgpl-2.0 | library lgpl | (?:gnu )?(?:library general public licen[sc]e|lgpl) #2(?: 0)? | lgpl 2 0 | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lesser lgpl | (?:gnu )?(?:lesser general public licen[sc]e|lgpl) #2 1 | lgpl 2 1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | lesser lgpl | (?:gnu )?(?:lesser general public licen[sc]e|lgpl) #3(?: 0)? | lgpl 3 0 | gnu org licenses lgpl 3 0
agpl-3.0 | affero agpl | (?:gnu )?(?:affero general public licen[sc]e|agpl) #3(?: 0)? | agpl 3 0 | gnu org licenses agpl 3 0
gfdl-1.2 | documentation fdl gfdl | (?:gnu )?free documentation licen[sc]e #1 2 | gfdl 1 2 | gnu org licenses old licenses fdl 1 2
gfdl-1.3 | documentation fdl gfdl | (?:gnu )?free documentation licen[sc]e #1 3 | gfdl 1 3 | gnu org licenses fdl 1 3
mpl-1.0 | mozilla mpl | (?:mozilla public licen[sc]e|mpl) #1 0 | mpl 1 0 | mozilla org mpl 1 0
mpl-1.1 | mozilla mpl | (?:mozilla public licen[sc]e|mpl) #1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0 | mozilla mpl | (?:mozilla public licen[sc]e|mpl) #2(?: 0)? | mpl 2 0 | mozilla org (?:en us )?mpl 2 0
epl-1.0 | eclipse epl | (?:eclipse public licen[sc]e|epl) #1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse epl | (?:eclipse public licen[sc]e|epl) #2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0
cddl-1.0 | cddl | (?:common development and distribution licen[sc]e )?cddl #1(?: 0)? | cddl 1 0 | opensource org licenses? cddl 1 0
cddl-1.1 | cddl | (?:common development and distribution licen[sc]e )?cddl #1 1 | cddl 1 1 | opensource org licenses? cddl 1 1
cpl-1.0 | common cpl | common public licen[sc]e(?: #1(?: 0)?)? | cpl 1 0 | opensource org licenses? cpl 1 0
ipl-1.0 | ibm ipl | ibm public licen[sc]e(?: #1(?: 0)?)? | ipl 1 0 | opensource org licenses? ipl 1 0
eupl-1.1 | european eupl | european union public licen[sc]e #1 1 | eupl 1 1 | opensource org licenses? eupl 1 1
eupl-1.2 | european eupl | european union public licen[sc]e #1 2 | eupl 1 2 | opensource org licenses? eupl 1 2
cecill-2.1 | cecill | cecill(?: free software)? licen[sc]e(?: agreement)? | cecill 2 1 | cecill info licences
artistic-1.0 | artistic | artistic licen[sc]e #1(?: 0)? | artistic 1 0 | opensource org licenses? artistic 1 0
artistic-2.0 | artistic | artistic licen[sc]e #2(?: 0)? | artistic 2 0 | opensource org licenses? artistic 2 0
unlicense | unlicense | the unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl | wtfpl | wtfpl net
zlib | zlib | zlib(?: libpng)? licen[sc]e | zlib | opensource org licenses? zlib
libpng-2.0 | libpng | libpng licen[sc]e | libpng 2 0 | libpng org pub png src libpng license
openssl | openssl | openssl licen[sc]e | openssl | openssl org source license
ofl-1.1 | sil ofl | sil open font licen[sc]e | ofl 1 1 | scripts sil org ofl
python-2.0 | python | python (?:software foundation )?licen[sc]e | python 2 0 | docs python org 3 license
php-3.01 | php | php licen[sc]e | php 3 01 | php net license
ruby | ruby | ruby licen[sc]e | ruby | ruby lang org en about license
postgresql | postgresql | postgresql licen[sc]e | postgresql | postgresql org about licence
ms-pl | microsoft ms | microsoft public licen[sc]e | ms pl | opensource org licenses? ms pl
ms-rl | microsoft ms | microsoft reciprocal licen[sc]e | ms rl | opensource org licenses? ms rl
upl-1.0 | universal upl | universal permissive licen[sc]e | upl 1 0 | oss oracle com licenses upl
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa | opensource org licenses? ncsa
curl | curl | curl licen[sc]e | curl | curl se docs copyright
json | json | json licen[sc]e | json | json org license
vim | vim vimhelp | vim licen[sc]e | vim | vimhelp org uganda
beerware | beerware beer | beer ?ware licen[sc]e | beerware | people freebsd org beerware
osl-3.0 | osl open | open software licen[sc]e #3(?: 0)? | osl 3 0 | opensource org licenses? osl 3 0
afl-3.0 | afl academic | academic free licen[sc]e #3(?: 0)? | afl 3 0 | opensource org licenses? afl 3 0
odbl-1.0 | database odbl | open (?:data commons open )?database licen[sc]e | odbl 1 0 | opendatacommons org licenses odbl
pddl-1.0 | dedication pddl | public domain dedication and licen[sc]e | pddl 1 0 | opendatacommons org licenses pddl
cc0-1.0 | cc0 cc zero | (?:cc0(?: #1 0)?|creative commons zero) | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by-2.0 | by | (?:cc|creative commons) by 2 0 | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | by | (?:cc|creative commons) by 2 5 | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-3.0 | by | (?:cc|creative commons) by 3 0 | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | by | (?:cc|creative commons) by 4(?: 0)? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa-2.0 | sa | (?:cc|creative commons) by sa 2 0 | cc by sa 2 0 | creativecommons org licenses by sa 2 0
cc-by-sa-3.0 | sa | (?:cc|creative commons) by sa 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | sa | (?:cc|creative commons) by sa 4(?: 0)? | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-nc-2.0 | nc | (?:cc|creative commons) by nc 2 0 | cc by nc 2 0 | creativecommons org licenses by nc 2 0
cc-by-nc-3.0 | nc | (?:cc|creative commons) by nc 3 0 | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | nc | (?:cc|creative commons) by nc 4(?: 0)? | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nd-3.0 | nd | (?:cc|creative commons) by nd 3 0 | cc by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | nd | (?:cc|creative commons) by nd 4(?: 0)? | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | sa | (?:cc|creative commons) by nc sa 3 0 | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | sa | (?:cc|creative commons) by nc sa 4(?: 0)? | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | nd | (?:cc|creative commons) by nc nd 4(?: 0)? | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
public-domain | domain publicdomain | (?:in|into|to) the public domain | cc pddc publicdomain | creativecommons org publicdomain mark 1 0
proprietary | proprietary | proprietary and confidential | licenseref proprietary | proprietary license
"""

# Label | words of which every citation has one | other names of licences above.
OTHER_NAMES = r"""
gpl-1.0 | gplv1 gpl1 | gplv?1(?: 0)?
gpl-2.0 | gplv2 gpl2 | gplv?2(?: 0)?
gpl-3.0 | gplv3 gpl3 | gplv?3(?: 0)?
gpl-2.0-or-later | gplv2 gpl2 | gplv?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later | gplv3 gpl3 | gplv?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-2.0 | lgplv2 lgpl2 | lgplv?2(?: 0)?(?! 1 )
lgpl-2.1 | lgplv2 lgpl2 lgplv21 | (?:lgplv?2 1|lgplv21)
lgpl-3.0 | lgplv3 lgpl3 | lgplv?3(?: 0)?
agpl-3.0 | agplv3 agpl3 | agplv?3(?: 0)?
apache-2.0 | apachev2 apache2 alv2 asl2 aslv2 | (?:apachev?2|alv2|aslv?2)(?: 0)?(?: licen[sc]e)?
apache-2.0 | apache | apache public licen[sc]e #2(?: 0)?
mpl-1.1 | mplv1 mpl1 | mplv?1 1
mpl-2.0 | mplv2 mpl2 | mplv?2(?: 0)?
epl-1.0 | eplv1 epl1 | eplv?1(?: 0)?
epl-2.0 | eplv2 epl2 | eplv?2(?: 0)?
gfdl-1.2 | gfdlv1 fdlv1 | g?fdlv1 2
gfdl-1.3 | gfdlv1 fdlv1 | g?fdlv1 3
bsd-2-clause | bsd | bsd (?:2|two) clause licen[sc]e
bsd-3-clause | bsd | bsd (?:3|three) clause licen[sc]e
mit | expat | expat licen[sc]e
"""

#: The parts of the long Creative Commons names, by the part of the identifier.
COMMONS = {"nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s(?: works)?"}

# Label | gate words | names without version, found as a whole | short names, found in notices only.
UNVERSIONED = r"""
apache | apache | apache (?:software )?licen[sc]e | apache
gpl | general gpl | (?:(?:gnu )?general public licen[sc]e|(?:gnu )?gpl licen[sc]e|gnu gpl) | gpl
lgpl | lesser library lgpl | (?:(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl licen[sc]e|gnu lgpl) | lgpl
agpl | affero agpl | (?:(?:gnu )?affero general public licen[sc]e|(?:gnu )?agpl licen[sc]e|gnu agpl) | agpl
gfdl | documentation gfdl | (?:(?:gnu )?free documentation licen[sc]e|gfdl licen[sc]e) | gfdl
mpl | mozilla mpl | (?:mozilla public licen[sc]e|mpl licen[sc]e) | mpl
epl | eclipse epl | (?:eclipse public licen[sc]e|epl licen[sc]e) | epl
cddl | cddl development | (?:common development and distribution licen[sc]e|cddl licen[sc]e) | cddl
eupl | european eupl | (?:european union public licen[sc]e|eupl licen[sc]e) | eupl
artistic | artistic | artistic licen[sc]e | artistic licen[sc]e
bsd | bsd | bsd(?: style)? licen[sc]e | bsd
mit | mit | mit style licen[sc]e | mit
isc | isc | isc style licen[sc]e | isc
bsl-1.0 | boost | boost licen[sc]e | boost software licen[sc]e
ofl | ofl | ofl licen[sc]e | ofl
cc-by | attribution | creative commons attribution(?: licen[sc]e)? | cc by
"""

VERSIONED_NOTICE = "general public licen[sc]e as published by the free software foundation either version {} of the licen[sc]e"
LATER = " or at your option any later version"

# Label | gate words | a sentence that only the text of the licence, or its notice, has.
BODIES = rf"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy
bsl-1.0 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy
isc | hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
postgresql | hereby | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd | redistribution redistributions | redistributions? (?:and use )?in source and binary forms(?: with or without modification)?
bsd-3-clause | endorse | neither the names? of (?:[^ ]+ ){{1,20}}may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
apache-2.0 | contributor | subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e
gpl | redistribute | this (?:program|library|software|file) is free software you can redistribute it and or modify it
gpl | licenses | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl-3.0 | copyleft | gnu general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | copyleft | gnu affero general public license is a free copyleft license for software and other kinds of works
gpl-2.0-or-later | published | gnu {VERSIONED_NOTICE.format("2(?: 0)?")}{LATER}
gpl-3.0-or-later | published | gnu {VERSIONED_NOTICE.format("3(?: 0)?")}{LATER}
lgpl-2.0 | published | gnu library {VERSIONED_NOTICE.format("2(?: 0)?")}{LATER}
lgpl-2.1 | published | gnu lesser {VERSIONED_NOTICE.format("2 1")}{LATER}
lgpl-3.0 | published | gnu lesser {VERSIONED_NOTICE.format("3(?: 0)?")}{LATER}
agpl-3.0 | published | gnu affero {VERSIONED_NOTICE.format("3(?: 0)?")}{LATER}
mpl-2.0 | mpl mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e #2 0
zlib | liable | in no event will the authors be held liable for any damages arising from the use of this software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to(?: public licen[sc]e)?
ofl-1.1 | sil ofl | this license is copied below and is also available with a faq at
"""

#: Identifiers that are words or names of their own: they count only where a licence field is before them.
FIELD_ONLY = {"mit", "mit 0", "x11", "isc", "unlicense", "zlib", "openssl", "python 2 0", "php 3 01", "ruby", "postgresql", "ncsa", "curl", "json", "vim"}

#: The phrases that count as places, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The forms of a citation, with the priority and strength of what they find.
VERB = "(?:licen[sc]ed|released|distributed|available|provided|published|covered)"
FORMS = (
    ("tag", "spdx license identifier {identifier}", 5, 1.0),
    ("notice", VERB + " under (?:the )?(?:terms of )?(?:the )?{name}", 4, 0.95),
    ("address", "(?:https? )?(?:www )?{address}", 3, 0.9),
    ("subject", "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 3, 0.85),
    ("name", "{name}", 2, 0.7),
)


@dataclass(frozen=True)
class Rule:
    """A signature. Any text that it matches has one of the words ``gates``."""

    label: str
    form: str
    gates: frozenset[str]
    priority: int
    strength: float
    pattern: re.Pattern[str]


def _rule(label: str, form: str, gates: str, priority: int, strength: float, body: str) -> Rule:
    body = re.sub(r"#(\d)", r"(?:v ?|ver(?:sion)? )?\1", body)
    return Rule(label, form, frozenset(gates.split()), priority, strength, re.compile(f"(?<= )(?:{body})(?= )"))


def _lines(table: str) -> list[list[str]]:
    return [line.split(" | ") for line in table.strip().splitlines()]


def _short(identifier: str) -> str:
    """The identifier as it is cited after a verb: "apache 2 0", "apache v2" or "apache version 2"."""
    *stem, major, minor = ["", *identifier.removesuffix(" or later").split()]
    later = " or (?:at your option )?(?:any )?later(?: version)?" if identifier.endswith(" or later") else ""
    if not (stem and major.isdigit() and minor.isdigit()):
        return identifier
    return " ".join(stem).strip() + (f" #{major}(?: 0)?" if minor == "0" else f" #{major} {minor}") + later


def family(label: str) -> str:
    """What the labels of a licence's versions have in common: gpl, apache, cc."""
    return label.split("-")[0]


def _long_commons(label: str) -> str | None:
    """The long name of a Creative Commons licence, from its label."""
    if not label.startswith("cc-by-"):
        return None
    *parts, version = label.removeprefix("cc-by-").split("-")
    kinds = "".join(f" {COMMONS[part]}" for part in parts)
    major, minor = version.split(".")
    return rf"(?:creative commons |cc )?attribution{kinds}(?: licen[sc]e)? #{major} {minor}(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"


def rules() -> list[Rule]:
    """Every form of every licence, by falling priority, then as written."""
    found = []
    for label, gates, name, identifier, address in _lines(LICENCES):
        first = identifier.split()[0]
        cited = name if identifier in FIELD_ONLY else f"{name}|{_short(identifier)}"
        for form, shape, priority, strength in FORMS:
            told, gated = (cited, f"{gates} {first}") if form in ("notice", "subject") else (name, gates)
            gated = f"{gates} {first}" if form == "tag" else gated
            found.append(_rule(label, form, gated, priority, strength, shape.format(name=f"(?:{told})", identifier=identifier, address=address)))
        field = rf"licen[sc]es?(?: (?:text|name|id|type|expression|file|is))? (?:{identifier})"
        found.append(_rule(label, "field", first, 3, 0.85, field))
        if identifier not in FIELD_ONLY:
            found.append(_rule(label, "identifier", first, 1, 0.6, identifier))
    named = [(label, gates, name) for label, gates, name in _lines(OTHER_NAMES)]
    named += [(label, "attribution", name) for label, *_ in _lines(LICENCES) if (name := _long_commons(label))]
    for label, gates, name in named:
        for form, shape, priority, strength in FORMS:
            if "{name}" in shape:
                found.append(_rule(label, form, gates, priority, strength, shape.format(name=f"(?:{name})")))
    for label, gates, name, short in _lines(UNVERSIONED):
        for form, shape, _, strength in FORMS:
            if form in ("notice", "subject"):
                found.append(_rule(label, form, f"{gates} {short.split()[0]}", 1, strength - 0.1, shape.format(name=f"(?:{name}|{short})")))
        found.append(_rule(label, "name", gates, 0, 0.6, name))
    for label, gates, sentence in _lines(BODIES):
        found.append(_rule(label, "text", gates, 4, 0.95, sentence))
    return sorted(found, key=lambda rule: -rule.priority)
