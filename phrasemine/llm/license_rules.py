"""Signature rules of the license scan.

Patterns are for normalised text: lower-case words with one space before each
and one after the last. They start with the space before their first word.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A smaller ``priority`` is tried, and wins, first; ``keyword`` occurs in all that ``pattern`` matches."""

    priority: int
    label: str
    keyword: str
    pattern: str
    confidence: float


# Label, identifier as words, what the license is called, keyword of the name.
LICENSES = (
    ("apache-1.1", "apache 1 1", "apache(?: software)?(?: foundation)? licen[cs]e(?: version| v)? ?1 1", "apache"),
    ("apache-2.0", "apache 2 0", "apache(?: software)?(?: foundation)? licen[cs]e(?: version| v)? ?2 0", "apache"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?", "affero"),
    ("agpl", "agpl", "(?:gnu )?affero general public licen[cs]e", "affero"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", "lesser"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", "lesser"),
    ("lgpl", "lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?", "general public"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", "general public"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", "general public"),
    ("gpl", "gpl", "(?:gnu )?general public licen[cs]e", "general public"),
    ("gfdl", "gfdl(?: 1 [123])?", "(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?", "free documentation"),
    ("mit", "mit", "mit licen[cs]e", "mit"),
    ("mit-0", "mit 0", "mit no attribution(?: licen[cs]e)?", "mit"),
    ("expat", "expat", "expat licen[cs]e", "expat"),
    ("x11", "x11", "x11 licen[cs]e", "x11"),
    ("isc", "isc", "isc licen[cs]e", "isc"),
    ("bsd-1-clause", "bsd 1 clause", "(?:1|one) clause bsd licen[cs]e", "bsd"),
    ("bsd-2-clause", "bsd 2 clause", "(?:(?:2|two) clause|simplified|freebsd) bsd licen[cs]e", "bsd"),
    ("bsd-3-clause", "bsd 3 clause", "(?:(?:3|three) clause|new|revised|modified) bsd licen[cs]e", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(?:(?:4|four) clause|original|old) bsd licen[cs]e", "bsd"),
    ("0bsd", "0bsd", "(?:zero clause|free public) bsd licen[cs]e", "bsd"),
    ("bsd", "bsd", "bsd licen[cs]e", "bsd"),
    ("mpl-1.1", "mpl 1 1", "mozilla public licen[cs]e(?: version| v)? ?1 1", "mozilla"),
    ("mpl-2.0", "mpl 2 0", "mozilla public licen[cs]e(?: version| v)? ?2 0", "mozilla"),
    ("mpl", "mpl", "mozilla public licen[cs]e", "mozilla"),
    ("epl-1.0", "epl 1 0", "eclipse public licen[cs]e(?: version| v)? ?1 0", "eclipse"),
    ("epl-2.0", "epl 2 0", "eclipse public licen[cs]e(?: version| v)? ?2 0", "eclipse"),
    ("edl-1.0", "edl 1 0", "eclipse distribution licen[cs]e(?: version| v)? ?1 0", "eclipse"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution licen[cs]e", "common development"),
    ("cpl-1.0", "cpl 1 0", "common public licen[cs]e", "common public"),
    ("cpal-1.0", "cpal 1 0", "common public attribution licen[cs]e", "common public"),
    ("eupl-1.1", "eupl 1 1", "european union public licen[cs]e(?: version| v)? ?1 1", "european union"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: version| v)? ?1 2", "european union"),
    ("artistic-1.0", "artistic 1 0", "artistic licen[cs]e(?: version)? ?1 0", "artistic"),
    ("artistic-2.0", "artistic 2 0", "artistic licen[cs]e(?: version)? ?2 0", "artistic"),
    ("bsl-1.0", "bsl 1 0", "boost software licen[cs]e", "boost"),
    ("busl-1.1", "busl 1 1", "business source licen[cs]e", "business source"),
    ("sspl-1.0", "sspl 1 0", "server side public licen[cs]e", "server side"),
    ("elastic-2.0", "elastic 2 0", "elastic licen[cs]e", "elastic"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public licen[cs]e", "you want to public"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", "(?:png reference library|libpng) licen[cs]e", "png"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl"),
    ("python-2.0", "python 2 0", "python software foundation licen[cs]e", "python"),
    ("php-3.01", "php 3 01", "php licen[cs]e", "php"),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    ("osl-3.0", "osl 3 0", "open software licen[cs]e", "open software"),
    ("afl-3.0", "afl 3 0", "academic free licen[cs]e", "academic free"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font licen[cs]e", "open font"),
    ("ms-pl", "ms pl", "microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "ms rl", "microsoft reciprocal licen[cs]e", "microsoft"),
    ("upl-1.0", "upl 1 0", "universal permissive licen[cs]e", "universal permissive"),
    ("ecl-2.0", "ecl 2 0", "educational community licen[cs]e", "educational community"),
    ("qpl-1.0", "qpl 1 0", "q public licen[cs]e", "q public"),
    ("vim", "vim", "vim licen[cs]e", "vim"),
    ("cecill-2.1", "cecill 2 1", "cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill"),
    ("odbl-1.0", "odbl 1 0", "open database licen[cs]e", "open database"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution licen[cs]e", "open data commons"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and licen[cs]e", "public domain"),
    ("cc0-1.0", "cc0 1 0", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", "c0|creative"),
    ("cc-by-nc-nd", "cc by nc nd [1234] 0", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?derivatives)(?: [1234] [05])?", "cc|creative"),
    ("cc-by-nc-sa", "cc by nc sa [1234] 0", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1234] [05])?", "cc|creative"),
    ("cc-by-nc", "cc by nc [1234] 0", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1234] [05])?", "cc|creative"),
    ("cc-by-nd", "cc by nd [1234] 0", "(?:cc|creative commons) (?:by nd|attribution no ?derivatives)(?: [1234] [05])?", "cc|creative"),
    ("cc-by-sa", "cc by sa [1234] 0", "(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1234] [05])?", "cc|creative"),
    ("cc-by", "cc by [1234] 0", "(?:cc|creative commons) (?:by|attribution)(?: [1234] [05])?", "cc|creative"),
)

# Other signatures as label, keyword, pattern.
NOTICES = (
    ("public-domain", "public domain", " (?:is|are|released|dedicated|placed) (?:in|into|to) the public domain"),
    ("proprietary", "rights reserved", " all rights reserved"),
    ("proprietary", "confidential", " (?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "permission", " (?:may|must) not be (?:copied|reproduced|distributed) without (?:prior )?(?:written )?permission"),
    ("mit", "permission is hereby granted", " permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", " permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", " redistribution and use in source and binary forms"),
    ("gpl", "redistribute it", " you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute it", " you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("apache-2.0", "you may not use this file", " you may not use this file except in compliance with the licen[cs]e"),
    ("mpl-2.0", "this source code form", " this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("bsl-1.0", "boost", " distributed under the boost software licen[cs]e"),
    ("unlicense", "free and unencumbered", " this is free and unencumbered software released into the public domain"),
    ("zlib", "as is", " this software is provided as is without any express or implied warranty in no event"),
)

# The phrases that are always reported, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

GRANT = (
    " (?:licen[cs]ed|released|distributed|published|provided|available|made available|used)"
    " (?:solely |only )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
)


def rules() -> list[Rule]:
    """All rules by priority: identifiers, grants, notices, then names alone."""
    out = []
    for label, identifier, name, keyword in LICENSES:
        out.append(Rule(1, label, "spdx", f" spdx licen[cs]e identifier {identifier}", 1.0))
        for word in keyword.split("|"):
            out.append(Rule(2, label, word, f"{GRANT}{name}", 0.95))
            out.append(Rule(4, label, word, f" {name}", 0.8))
    out += [Rule(3, label, keyword, pattern, 0.9) for label, keyword, pattern in NOTICES]
    return sorted(set(out))
