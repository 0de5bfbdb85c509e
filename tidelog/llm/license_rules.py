"""The signature rules of the license scan, in the order of their priority within a family.

Patterns run over normalised text: words of letters, digits and non-ASCII characters, lower-cased and joined by one
space, so "Apache License, Version 2.0." reads "apache license version 2 0". A rule needs one of its keywords to
stand in the text before its pattern is tried. ``score`` is how sure a detection is; rules of higher ``priority``
suppress those whose words lie inside theirs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    score: float


#: Priorities: whole notices and texts, then names with a version, then names, then bare references.
TEXT, NOTICE, NAMED, BARE = 40, 30, 20, 10
_V = r"(?: version| v)?"

#: label; keywords; patterns of license texts; of notices and tags; of names; of bare references.
FAMILIES: list[tuple[str, str, list[str], list[str], list[str], list[str]]] = [
    ("mit", "mit expat x11 permission warranty", [r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"], [r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:mit|expat|x11) licen[sc]e", r"spdx license identifier mit(?! 0)\b", r"licen[sc]e mit\b"], [r"(?:the )?mit licen[sc]e", r"expat licen[sc]e"], [r"mit licensed"]),
    ("mit-0", "mit", [], [r"spdx license identifier mit 0"], [r"mit no attribution(?: licen[sc]e)?", r"mit 0 licen[sc]e"], []),
    ("apache-2", "apache apl asl", [r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"], [r"licensed under (?:the )?(?:terms of the )?apache(?: software)? licen[sc]e" + _V + r" 2(?: 0)?", r"spdx license identifier apache 2 0", r"www apache org licenses license 2 0"], [r"apache(?: software)? licen[sc]e" + _V + r" 2(?: 0)?", r"apache 2(?: 0)? licen[sc]e", r"apl ?2 0", r"asl 2 0"], [r"apache 2 0"]),
    ("apache-1.1", "apache", [r"this product includes software developed by the apache software foundation"], [r"spdx license identifier apache 1 1"], [r"apache(?: software)? licen[sc]e" + _V + r" 1 1"], []),
    ("apache-1.0", "apache", [], [r"spdx license identifier apache 1 0"], [r"apache(?: software)? licen[sc]e" + _V + r" 1 0"], []),
    ("apache", "apache", [], [r"licensed under (?:the )?apache licen[sc]e"], [r"apache(?: software)? licen[sc]e"], [r"apache licensed"]),
    ("gpl-3", "gpl gnu", [r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"], [r"licensed under (?:the )?(?:terms of the )?gnu general public licen[sc]e" + _V + r" 3(?: 0)?", r"spdx license identifier gpl 3 0(?: only| or later)?", r"www gnu org licenses gpl 3 0"], [r"gnu general public licen[sc]e" + _V + r" 3(?: 0)?", r"gnu gpl" + _V + r" ?3(?: 0)?", r"gpl" + _V + r" 3(?: 0)?"], [r"gplv3"]),
    ("gpl-2", "gpl gnu", [r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"], [r"licensed under (?:the )?(?:terms of the )?gnu general public licen[sc]e" + _V + r" 2(?: 0)?", r"spdx license identifier gpl 2 0(?: only| or later)?"], [r"gnu general public licen[sc]e" + _V + r" 2(?: 0)?", r"gnu gpl" + _V + r" ?2(?: 0)?", r"gpl" + _V + r" 2(?: 0)?"], [r"gplv2"]),
    ("gpl-1", "gpl gnu", [], [r"spdx license identifier gpl 1 0(?: only| or later)?"], [r"gnu general public licen[sc]e" + _V + r" 1(?: 0)?", r"gpl version 1"], []),
    ("gpl", "gpl gnu", [r"free software you can redistribute it and or modify it under the terms of the gnu general public license"], [r"licensed under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public licen[sc]e)"], [r"gnu general public licen[sc]e", r"gnu gpl"], [r"gpl licensed", r"under the gpl"]),
    ("lgpl-3", "lgpl lesser gnu", [], [r"spdx license identifier lgpl 3 0(?: only| or later)?", r"www gnu org licenses lgpl 3 0"], [r"gnu lesser general public licen[sc]e" + _V + r" 3(?: 0)?", r"lgpl" + _V + r" 3(?: 0)?"], [r"lgplv3"]),
    ("lgpl-2.1", "lgpl lesser gnu", [r"gnu lesser general public license as published by the free software foundation either version 2 1"], [r"spdx license identifier lgpl 2 1(?: only| or later)?"], [r"gnu lesser general public licen[sc]e" + _V + r" 2 1", r"lgpl" + _V + r" 2 1"], [r"lgplv2 1"]),
    ("lgpl-2", "lgpl library gnu", [], [r"spdx license identifier lgpl 2 0(?: only| or later)?"], [r"gnu library general public licen[sc]e(?:" + _V + r" 2(?: 0)?)?", r"lgpl" + _V + r" 2(?: 0)?"], []),
    ("lgpl", "lgpl lesser", [], [r"licensed under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|lesser general public licen[sc]e)"], [r"(?:gnu )?lesser general public licen[sc]e"], [r"lgpl licensed", r"under the lgpl"]),
    ("agpl-3", "agpl affero", [r"gnu affero general public license as published by the free software foundation either version 3"], [r"spdx license identifier agpl 3 0(?: only| or later)?", r"licensed under (?:the )?(?:terms of the )?gnu affero general public licen[sc]e"], [r"gnu affero general public licen[sc]e(?:" + _V + r" 3(?: 0)?)?", r"agpl" + _V + r" 3(?: 0)?", r"affero gpl"], [r"agplv3"]),
    ("gfdl", "gfdl documentation", [r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"], [r"spdx license identifier gfdl 1 [1-3](?: only| or later)?"], [r"gnu free documentation licen[sc]e(?:" + _V + r" 1 [1-3])?", r"gfdl" + _V + r" 1 [1-3]"], [r"gfdl licensed"]),
    ("bsd-3", "bsd redistribution", [r"redistribution and use in source and binary forms with or without modification are permitted.{0,900}neither the name"], [r"spdx license identifier bsd 3 clause", r"licensed under (?:the )?(?:3 clause|three clause|new|modified|revised) bsd"], [r"(?:3 clause|three clause|new|modified|revised) bsd licen[sc]e", r"bsd 3 clause(?: licen[sc]e)?"], []),
    ("bsd-2", "bsd freebsd redistribution", [], [r"spdx license identifier bsd 2 clause", r"licensed under (?:the )?(?:2 clause|two clause|simplified) bsd"], [r"(?:2 clause|two clause|simplified|freebsd) bsd licen[sc]e", r"bsd 2 clause(?: licen[sc]e)?", r"freebsd licen[sc]e"], []),
    ("bsd-4", "bsd advertising", [r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"], [r"spdx license identifier bsd 4 clause"], [r"(?:4 clause|four clause|original) bsd licen[sc]e", r"bsd 4 clause"], []),
    ("bsd-0", "bsd 0bsd", [], [r"spdx license identifier 0bsd"], [r"(?:zero|0) clause bsd(?: licen[sc]e)?", r"0bsd licen[sc]e"], []),
    ("bsd", "bsd redistribution", [r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"], [r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?bsd"], [r"bsd licen[sc]e", r"bsd style licen[sc]e"], [r"bsd licensed"]),
    ("isc", "isc internet permission", [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"], [r"spdx license identifier isc", r"licensed under (?:the )?isc"], [r"isc licen[sc]e", r"internet systems consortium licen[sc]e"], []),
    ("mpl-2", "mozilla mpl", [r"this source code form is subject to the terms of the mozilla public license v 2 0"], [r"spdx license identifier mpl 2 0", r"mozilla org mpl 2 0", r"licensed under (?:the )?mozilla public licen[sc]e" + _V + r" 2(?: 0)?"], [r"mozilla public licen[sc]e" + _V + r" 2(?: 0)?", r"mpl" + _V + r" 2(?: 0)?"], []),
    ("mpl-1.1", "mozilla mpl", [r"the contents of this file are subject to the mozilla public license version 1 1"], [r"spdx license identifier mpl 1 1"], [r"mozilla public licen[sc]e" + _V + r" 1 1", r"mpl" + _V + r" 1 1"], []),
    ("mpl", "mozilla mpl", [], [r"licensed under (?:the )?mozilla public licen[sc]e"], [r"mozilla public licen[sc]e"], []),
    ("epl-2", "eclipse epl", [r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"], [r"spdx license identifier epl 2 0"], [r"eclipse public licen[sc]e" + _V + r" 2(?: 0)?", r"epl" + _V + r" 2 0"], []),
    ("epl-1", "eclipse epl", [], [r"spdx license identifier epl 1 0"], [r"eclipse public licen[sc]e" + _V + r" 1(?: 0)?", r"epl" + _V + r" 1 0"], []),
    ("epl", "eclipse", [], [r"licensed under (?:the )?eclipse public licen[sc]e"], [r"eclipse public licen[sc]e"], []),
    ("cddl-1", "cddl common", [], [r"spdx license identifier cddl 1 [01]"], [r"common development and distribution licen[sc]e(?:" + _V + r" 1 [01])?", r"cddl(?: version| v)? 1 [01]"], [r"cddl licensed"]),
    ("eupl-1.2", "eupl union", [], [r"spdx license identifier eupl 1 [12]", r"licensed under (?:the )?eupl"], [r"european union public licen[sc]e(?:" + _V + r" 1 [12])?", r"eupl" + _V + r" 1 [12]"], []),
    ("cc0", "cc0 creative creativecommons waived", [r"has waived all copyright and related or neighboring rights to this work"], [r"spdx license identifier cc0 1 0", r"creativecommons org publicdomain zero 1 0"], [r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero(?: v?1 0)?(?: universal)?"], []),
    ("cc-by", "cc creative creativecommons", [], [r"spdx license identifier cc by [1-4] [05]", r"creativecommons org licenses by [1-4] [05]", r"licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e"], [r"creative commons attribution(?! ?(?:non|share|no))(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", r"cc by(?! (?:sa|nc|nd))(?: [1-4] [05])?"], []),
    ("cc-by-sa", "cc creative creativecommons", [], [r"spdx license identifier cc by sa [1-4] [05]", r"creativecommons org licenses by sa [1-4] [05]"], [r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", r"cc by sa(?: [1-4] [05])?"], []),
    ("cc-by-nd", "cc creative creativecommons", [], [r"spdx license identifier cc by nd [1-4] [05]", r"creativecommons org licenses by nd [1-4] [05]"], [r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", r"cc by nd(?: [1-4] [05])?"], []),
    ("cc-by-nc", "cc creative creativecommons", [], [r"spdx license identifier cc by nc [1-4] [05]", r"creativecommons org licenses by nc [1-4] [05]"], [r"creative commons attribution non ?commercial(?! (?:share|no))(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", r"cc by nc(?! (?:sa|nd))(?: [1-4] [05])?"], []),
    ("cc-by-nc-sa", "cc creative creativecommons", [], [r"spdx license identifier cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa [1-4] [05]"], [r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", r"cc by nc sa(?: [1-4] [05])?"], []),
    ("cc-by-nc-nd", "cc creative creativecommons", [], [r"spdx license identifier cc by nc nd [1-4] [05]", r"creativecommons org licenses by nc nd [1-4] [05]"], [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", r"cc by nc nd(?: [1-4] [05])?"], []),
    ("unlicense", "unlicense unencumbered", [r"this is free and unencumbered software released into the public domain"], [r"spdx license identifier unlicense", r"unlicense org"], [r"the unlicense", r"unlicense licen[sc]e"], []),
    ("wtfpl", "wtfpl fuck", [r"do what the fuck you want to public license"], [r"spdx license identifier wtfpl"], [r"wtfpl(?: licen[sc]e)?"], []),
    ("zlib", "zlib warranty", [r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"], [r"spdx license identifier zlib"], [r"zlib licen[sc]e", r"zlib libpng licen[sc]e"], []),
    ("boost-1", "boost bsl permission", [r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"], [r"spdx license identifier bsl 1 0", r"distributed under the boost software licen[sc]e"], [r"boost software licen[sc]e(?:" + _V + r" 1 0)?"], []),
    ("artistic-2", "artistic", [], [r"spdx license identifier artistic 2 0"], [r"artistic licen[sc]e" + _V + r" 2(?: 0)?"], []),
    ("artistic-1", "artistic perl", [r"same terms as perl itself"], [r"spdx license identifier artistic 1 0"], [r"artistic licen[sc]e(?:" + _V + r" 1(?: 0)?)?"], []),
    ("psf-2", "psf python", [], [r"spdx license identifier (?:psf|python) 2 0"], [r"python software foundation licen[sc]e(?:" + _V + r" 2)?", r"psf licen[sc]e"], []),
    ("postgresql", "postgresql", [], [r"spdx license identifier postgresql"], [r"postgresql licen[sc]e"], []),
    ("openssl", "openssl", [r"this product includes software developed by the openssl project"], [r"spdx license identifier openssl"], [r"openssl licen[sc]e"], []),
    ("php-3", "php", [], [r"spdx license identifier php 3 01?"], [r"php licen[sc]e(?:" + _V + r" 3 01?)?"], []),
    ("ruby", "ruby", [], [r"spdx license identifier ruby"], [r"ruby licen[sc]e"], []),
    ("ofl-1.1", "ofl font", [r"this font software is licensed under the sil open font license"], [r"spdx license identifier ofl 1 1"], [r"sil open font licen[sc]e(?:" + _V + r" 1 1)?", r"ofl" + _V + r" 1 1"], []),
    ("odbl-1", "odbl database", [], [r"spdx license identifier odbl 1 0"], [r"open database licen[sc]e(?:" + _V + r" 1 0)?", r"odbl(?: 1 0)?"], []),
    ("odc-by-1", "odc commons", [], [r"spdx license identifier odc by 1 0"], [r"open data commons attribution licen[sc]e(?:" + _V + r" 1 0)?", r"odc by(?: 1 0)?"], []),
    ("sspl-1", "sspl side", [], [r"spdx license identifier sspl 1 0"], [r"server side public licen[sc]e(?:" + _V + r" 1)?", r"sspl(?: 1 0)?"], []),
    ("busl-1.1", "busl business", [], [r"spdx license identifier busl 1 1"], [r"business source licen[sc]e(?:" + _V + r" 1 1)?"], []),
    ("elastic-2", "elastic", [], [r"spdx license identifier elastic 2 0"], [r"elastic licen[sc]e(?:" + _V + r" 2(?: 0)?)?"], []),
    ("ms-pl", "microsoft ms", [], [r"spdx license identifier ms pl"], [r"microsoft public licen[sc]e", r"ms pl licen[sc]e"], []),
    ("ms-rl", "microsoft ms", [], [r"spdx license identifier ms rl"], [r"microsoft reciprocal licen[sc]e"], []),
    ("ncsa", "ncsa illinois", [], [r"spdx license identifier ncsa"], [r"university of illinois ncsa open source licen[sc]e", r"ncsa licen[sc]e"], []),
    ("upl-1", "upl permissive", [], [r"spdx license identifier upl 1 0"], [r"universal permissive licen[sc]e(?:" + _V + r" 1 0)?"], []),
    ("blueoak-1", "blue blueoak", [], [r"spdx license identifier blueoak 1 0 0"], [r"blue oak model licen[sc]e(?: 1 0 0)?"], []),
    ("afl-3", "afl academic", [], [r"spdx license identifier afl 3 0"], [r"academic free licen[sc]e(?:" + _V + r" 3 0)?"], []),
    ("osl-3", "osl open", [], [r"spdx license identifier osl 3 0"], [r"open software licen[sc]e(?:" + _V + r" 3 0)?"], []),
    ("cecill", "cecill", [], [r"spdx license identifier cecill [12] [01]"], [r"cecill(?:" + _V + r" [12](?: [01])?)?(?: free software)? licen[sc]e"], []),
    ("beerware", "beer beerware", [r"buy me a beer in return"], [r"spdx license identifier beerware"], [r"beer ?ware licen[sc]e"], []),
    ("public-domain", "public domain", [r"placed in(?:to)? the public domain", r"dedicated to the public domain"], [r"released (?:in)?to the public domain"], [r"public domain dedication"], [r"(?:is|in) the public domain"]),
    ("proprietary", "rights proprietary confidential end commercial", [r"proprietary and confidential unauthorized copying"], [], [r"proprietary licen[sc]e", r"end user licen[sc]e agreement"], [r"commercial licen[sc]e", r"all rights reserved"]),
]


def rules() -> list[Rule]:
    """All rules, the highest priority first, then in the order of the table."""
    out = []
    for label, keywords, *groups in FAMILIES:
        for (priority, score), patterns in zip(((TEXT, 1.0), (NOTICE, 0.95), (NAMED, 0.8), (BARE, 0.5)), groups, strict=True):
            out += [Rule(label, p, tuple(keywords.split()), priority, score) for p in patterns]
    return sorted(out, key=lambda r: -r.priority)


#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def compiled(found: list[Rule]) -> list[tuple[Rule, re.Pattern, tuple[bytes, ...]]]:
    """Patterns over the bytes of normalised text, at word boundaries (spaces), with their keywords."""
    return [(r, re.compile(rb"(?<![^ ])(?:" + r.pattern.encode() + rb")(?![^ ])"), tuple(k.encode() for k in r.keywords)) for r in found]
