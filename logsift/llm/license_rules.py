"""The ordered license signatures: (label, priority, confidence, keywords, pattern).

Patterns run over a text's words (lower case, ``[a-z0-9]`` and all non-ASCII), joined by
one space, so punctuation such as in ``Apache-2.0`` is a space. Each family below names a
license by hand; the forms say how a license is granted. A rule is tried only where one of
its keywords occurs: every text that the pattern matches has at least one of them as a word
of its own, so a version or ``v`` that may be glued on gives keywords too.
"""

from __future__ import annotations

#: Fixed by contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, keywords (the first one names the rule in ``ALONE``), pattern of the name.
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("apache-1.1", "apache", r"apache (?:software )?(?:license )?(?:version )?v?1 1"),
    ("apache-2.0", "apache", r"(?:the )?apache (?:software )?(?:license )?(?:version )?v?2(?: 0)?"),
    ("apache", "apache", r"(?:the )?apache(?: software)?"),
    ("gpl-1.0", "general", r"gnu general public license (?:version |v ?)1"),
    ("gpl-2.0", "general", r"gnu general public license (?:version |v ?)2(?: 0)?"),
    ("gpl-2.0", "gpl gpl2 gplv gplv2 gplversion", r"(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "general", r"gnu general public license (?:version |v ?)3(?: 0)?"),
    ("gpl-3.0", "gpl gpl3 gplv gplv3 gplversion", r"(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license (?:version |v ?)2 1"),
    ("lgpl-2.1", "lgpl lgpl2 lgplv lgplv2 lgplversion", r"(?:gnu )?lgpl ?(?:version |v ?)?2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license (?:version |v ?)3(?: 0)?"),
    ("lgpl-3.0", "lgpl lgpl3 lgplv lgplv3 lgplversion", r"(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?"),
    ("lgpl-2.0", "library", r"gnu library general public license(?: version 2(?: 0)?)?"),
    ("agpl-3.0", "affero", r"gnu affero general public license(?: version 3(?: 0)?)?"),
    ("agpl-3.0", "agpl agpl3 agplv agplv3 agplversion", r"(?:gnu )?agpl(?: ?(?:version |v ?)?3)?(?: 0)?"),
    ("fdl", "documentation", r"gnu free documentation license(?: version 1 [123])?"),
    ("bsd-0", "bsd", r"(?:0 clause|zero clause) bsd"),
    ("bsd-2", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"(?:the )?bsd"),
    ("isc", "isc", r"(?:the )?isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: v2(?: 0)?|(?: version| v)?(?: 2(?: 0)?)?)"),
    ("mpl-2.0", "mpl mpl2 mplv mplv2 mplversion", r"mpl ?(?:version |v ?)?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: v2(?: 0)?|(?: version| v)?(?: 2(?: 0)?)?)"),
    ("cddl", "cddl", r"cddl(?: (?:version )?1 [01])?"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cpl", "common", r"common public license(?: version 1 0)?"),
    ("eupl", "eupl", r"eupl(?: (?:version |v ?)?1 [012])?"),
    ("eupl", "union", r"european union public licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)?(?: 2(?: 0)?)?"),
    ("artistic-1.0", "artistic", r"artistic license (?:version )?1 0"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?"),
    ("boost", "boost", r"boost software license(?: version 1 0)?"),
    ("boost", "bsl", r"bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("psf", "python", r"python software foundation(?: license)?(?: version 2)?"),
    ("openssl", "openssl", r"openssl(?: license)?"),
    ("php", "php", r"php license(?: version 3 0[01]?)?"),
    ("ruby", "ruby", r"ruby(?: s)? license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("ofl", "font", r"sil open font license(?: version 1 1)?"),
    ("odbl", "database", r"open (?:data commons )?database license"),
    ("odc-by", "commons", r"open data commons attribution license"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "zero", r"creative commons zero"),
    ("cc-by-nc-nd", "nd", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-4.0", "cc", r"cc by(?: (?:version )?4(?: 0)?)"),
    ("cc-by-3.0", "cc", r"cc by(?: (?:version )?3(?: 0)?)"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1234] [05])?(?: (?:international|unported))?"),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: [1234] [05])?"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1234] [05])?"),
    ("cc-by-nd", "noderivatives", r"creative commons attribution noderivatives(?: [1234] [05])?"),
    ("public-domain", "domain", r"(?:the )?public domain"),
    ("proprietary", "proprietary", r"(?:a )?proprietary"),
    ("commercial", "commercial", r"(?:a )?commercial"),
)

#: how a license is granted: priority (lower is stronger), confidence, pattern around the name.
FORMS = (
    (1, 0.99, r"spdx license identifier {name}"),
    (2, 0.95, r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?"),
    (3, 0.90, r"(?:use|redistribution|reproduction|usage) (?:of this \w+ )?is (?:governed|permitted|allowed) (?:by|under) (?:the )?{name}(?: licen[cs]e)?"),
    (4, 0.80, r"{name} licen[cs]e"),
    (4, 0.80, r"licen[cs]e {name}"),
)

#: Names that say enough alone.
ALONE = {"general", "lesser", "affero", "library", "documentation", "mozilla", "eclipse", "cddl", "eupl", "union",
         "cc0", "nd", "sa", "nc", "sharealike", "noncommercial", "noderivatives", "attribution", "gplv2", "gplv3",
         "unlicense", "wtfpl", "font", "database", "boost", "artistic"}

#: Notices without a license's name: label, priority, confidence, keywords, pattern.
NOTICES = (
    ("copyright", 6, 0.50, "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", 6, 0.40, "copyrighted", r"copyrighted (?:material|work)"),
    ("no-warranty", 6, 0.60, "warranty warranties", r"without warrant(?:y|ies) (?:or conditions )?of any kind"),
    ("no-warranty", 6, 0.60, "warranty", r"without (?:any )?warranty"),
    ("mit", 3, 0.95, "hereby", r"permission is hereby granted free of charge to any person"),
    ("isc", 3, 0.95, "distribute", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, 0.90, "redistribution", r"redistribution and use in source and binary forms"),
    ("gpl", 3, 0.90, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu"),
    ("no-redistribution", 5, 0.70, "redistribute", r"(?:may|must|do) not (?:be )?redistribute"),
    ("no-derivatives", 5, 0.60, "derivative", r"no derivative works"),
    ("non-commercial", 5, 0.70, "commercial", r"(?:non|not for) commercial (?:use|purposes)(?: only)?"),
    ("permission-required", 5, 0.60, "permission", r"(?:without|prior) (?:the )?(?:express |prior )?(?:written )?permission"),
)


def rules() -> list[tuple[str, int, float, str, str]]:
    """Every rule in order: base phrases (priority 0) first."""
    out = [(label, 0, 0.6, phrase.split()[0 if phrase == "cc by" else -1], phrase) for phrase, label in BASE]
    for label, keywords, name in FAMILIES:
        out += [(label, p, c, keywords, form.replace("{name}", f"(?:{name})")) for p, c, form in FORMS]
        if keywords.split()[0] in ALONE:
            out.append((label, 5, 0.7, keywords, name))
    return out + list(NOTICES)
