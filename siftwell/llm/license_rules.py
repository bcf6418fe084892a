"""Signature rules for licence texts: hand-written expressions over normalised words (lower case, one blank between words)."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    gate: str  # the rule is tried only on texts that contain this
    pattern: str
    priority: int  # a detection inside another of the same or a higher priority is dropped
    base: bool = False


#: label, gate, expression of the name, short identifier
_NAMES = [
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"(?:apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?|apache 2(?: 0)? licen[cs]e)", r"apache 2 0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache"),
    ("mit", "mit", r"(?:mit|expat|x11)(?: style)? licen[cs]e", r"mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two) clause|simplified|freebsd) bsd licen[cs]e", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause|new|revised|modified) bsd licen[cs]e", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause|original|old) bsd licen[cs]e", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", r"bsd"),
    ("0bsd", "0bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?", r"0bsd"),
    ("gpl-1.0", "general public licen", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?", r"gpl 1 0"),
    ("gpl-2.0", "general public licen", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", r"gpl 2 0"),
    ("gpl-2.0-or-later", "general public licen", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?", r"gpl 2 0 or later"),
    ("gpl-3.0", "general public licen", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"gpl 3 0"),
    ("gpl-3.0-or-later", "general public licen", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?", r"gpl 3 0 or later"),
    ("gpl", "gpl", r"gnu gpl", r"gpl"),
    ("lgpl-2.0", "library general public licen", r"(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?", r"lgpl 2 0"),
    ("lgpl-2.1", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", r"lgpl 2 1"),
    ("lgpl-3.0", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"lgpl 3 0"),
    ("lgpl", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e", r"lgpl"),
    ("agpl-3.0", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"agpl 3 0"),
    ("agpl", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e", r"agpl"),
    ("gfdl-1.1", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 1", r"gfdl 1 1"),
    ("gfdl-1.2", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 2", r"gfdl 1 2"),
    ("gfdl-1.3", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 3", r"gfdl 1 3"),
    ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e", r"gfdl"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl"),
    ("cddl-1.0", "common development and distribution", r"common development and distribution licen[cs]e(?: version)?(?: 1 0)?", r"cddl 1 0"),
    ("cpl-1.0", "common public licen", r"common public licen[cs]e(?: version| v)?(?: 1 0)?", r"cpl 1 0"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e(?: version| v)? ?1 1", r"eupl 1 1"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e(?: version| v)? ?1 2", r"eupl 1 2"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e 1 0", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e 2(?: 0)?", r"artistic 2 0"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"(?:do what the fuck you want to public licen[cs]e|wtfpl)", r"wtfpl"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", r"postgresql"),
    ("psf-2.0", "python software foundation", r"python software foundation licen[cs]e(?: version)?(?: 2)?", r"psf 2 0"),
    ("ofl-1.1", "open font licen", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", r"ofl 1 1"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("odbl-1.0", "open database licen", r"open database licen[cs]e(?: v)?(?: ?1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: v)?(?: ?1 0)?", r"odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication(?: and)? licen[cs]e", r"pddl 1 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", r"public domain"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", r"licenseref proprietary"),
]

#: The Creative Commons family: elements of the licence, with the long name of each.
_CC = {
    "by": r"attribution",
    "by-sa": r"attribution share ?alike",
    "by-nd": r"attribution no ?deriv(?:ative)?s",
    "by-nc": r"attribution non ?commercial",
    "by-nc-sa": r"attribution non ?commercial share ?alike",
    "by-nc-nd": r"attribution non ?commercial no ?deriv(?:ative)?s",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

_GRANT = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|made available|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_WORD_START, _WORD_END = r"(?<![^ ])", r"(?![^ ])"

#: Phrases that are always looked for and always reported: fixed values of the contract.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

#: Single rules without a family.
_OTHERS = [
    ("copyright-notice", "copyright", r"(?:copyright|copr)(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)*", 1),
    ("copyright-notice", "©", r"© ?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 1),
    ("no-warranty", "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?(?: express or implied)?", 1),
    ("as-is", "as is", r"(?:provided|distributed)(?: by the copyright holders and contributors)?(?: on an)? as is(?: basis)?", 1),
    ("permission-grant", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("bsd-grant", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 3),
    ("all-rights-waived", "waive", r"(?:waive|waived|waives) all (?:copyright and related or neighboring )?rights", 1),
    ("some-rights-reserved", "some rights reserved", r"some rights reserved", 1),
    ("no-rights-reserved", "no rights reserved", r"no rights reserved", 1),
    ("tous-droits-reserves", "droits réservés", r"tous droits réservés", 1),
    ("alle-rechte-vorbehalten", "rechte vorbehalten", r"alle rechte vorbehalten", 1),
    ("todos-los-derechos", "derechos reservados", r"todos los derechos reservados", 1),
]


def _family(label: str, gate: str, name: str, short: str) -> list[Rule]:
    """A name alone, in a grant, in an identifier line, and in a link or file mention."""
    wrap = lambda p: f"{_WORD_START}{p}{_WORD_END}"
    return [
        Rule(label, gate, wrap(name), 1),
        Rule(label, gate, wrap(_GRANT + name), 2),
        Rule(label, "spdx", wrap(rf"spdx licen[cs]e identifier {short}"), 3),
        Rule(label, gate, wrap(rf"(?:see|read|a copy of|accept|under) (?:the )?{name}"), 1),
    ]


def build_rules() -> list[Rule]:
    """All rules in their order; where all else is equal, the earlier one wins."""
    rules = [Rule(label, phrase, f"{_WORD_START}{phrase}{_WORD_END}", 0, True) for label, phrase in BASE]
    for row in _NAMES:
        rules += _family(*row)
    for kind, long_name in _CC.items():
        words = kind.replace("-", " ")
        for version in _CC_VERSIONS:
            number = version.replace(".", " ")
            short = version.removesuffix(".0").replace(".", " ")
            label, code = f"cc-{kind}-{version}", f"cc {words} {number}"
            rules += _family(label, "cc by", rf"cc {words} (?:{number}|{short})", code)
            rules += _family(label, "creative commons", rf"creative commons {long_name} (?:{number}|{short})", code)[:2]
    rules += [Rule(label, gate, f"{_WORD_START}{pattern}{_WORD_END}", level) for label, gate, pattern, level in _OTHERS]
    return rules
