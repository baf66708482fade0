"""Signatures of license texts that need not name their license, written by hand.

An entry is (label, expression, keywords of every match). Expressions are over
words joined by single blanks, as in `licenses`; ` ... ` stands for up to
`GAP_WORDS` words. Where one text begins like another, the longer one decides.
"""

from __future__ import annotations

GAP_WORDS = 60

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software"
    " and associated documentation files the software to deal in the software without restriction"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification"
    " are permitted provided that the following conditions are met"
)
_BSD_BINARY = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions"
    " and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_ISC = (
    "permission to use copy modify and(?: or)? distribute this software for any purpose"
    " with or without fee is hereby granted"
)
_GNU = "you can redistribute it and or modify it under the terms of the gnu"
_FSF = (
    r" as published by the free software foundation(?: either)?(?: version \d(?: \d)?)?(?: of the license)?"
    r"(?: or(?: at your option)? any later version)?"
)

#: Passages of the license texts and of the notices in file headers.
BODIES = (
    ("mit", _MIT, ("hereby", "charge", "obtaining")),
    (
        "mit",
        _MIT + " ... the above copyright notice and this permission notice(?: including the next paragraph)?"
        " shall be included in all copies or substantial portions of the software",
        ("hereby", "charge", "obtaining", "substantial"),
    ),
    (
        "mit-0",
        _MIT + " ... to permit persons to whom the software is furnished to do so the software is provided as is",
        ("hereby", "charge", "obtaining", "furnished"),
    ),
    (
        "x11",
        "shall not be used in advertising or otherwise to promote the sale use or other dealings"
        " in this software without prior written authorization",
        ("advertising", "dealings", "authorization"),
    ),
    (
        "ncsa",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal with the software without restriction",
        ("hereby", "charge", "obtaining"),
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"
        " and accompanying documentation covered by this license",
        ("hereby", "organization", "accompanying"),
    ),
    (
        "upl",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " associated documentation and or data collectively the software",
        ("hereby", "obtaining", "collectively"),
    ),
    (
        "unicode",
        "permission is hereby granted free of charge to any person obtaining a copy of(?: the unicode)? data files"
        " and any associated documentation",
        ("hereby", "obtaining", "data"),
    ),
    (
        "ofl",
        "permission is hereby granted free of charge to any person obtaining a copy of the font software"
        " to use study copy merge embed modify redistribute and sell",
        ("hereby", "font", "embed"),
    ),
    ("ofl", "this font software is licensed under the sil open font license", ("font", "sil")),
    ("json", "the software shall be used for good not evil", ("good", "evil")),
    (
        "isc",
        _ISC + " provided that the above copyright notice and this permission notice appear in all copies",
        ("permission", "fee", "appear"),
    ),
    ("0bsd", _ISC + "(?! provided)", ("permission", "fee", "hereby")),
    (
        "curl",
        _ISC + " provided that the above copyright notice and this permission notice appear in all copies ..."
        " and noninfringement of third party rights",
        ("permission", "fee", "noninfringement"),
    ),
    (
        "hpnd",
        "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation"
        " for any purpose(?: and)? (?:is hereby granted )?without fee",
        ("permission", "documentation", "fee"),
    ),
    (
        "postgresql",
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee"
        " and without a written agreement is hereby granted",
        ("permission", "documentation", "agreement"),
    ),
    (
        "ntp",
        "permission to use copy modify and distribute this software and its documentation for any purpose"
        " with or without fee is hereby granted",
        ("permission", "documentation", "fee"),
    ),
    (
        "w3c",
        "permission to copy modify and distribute this (?:work|software and its documentation)"
        " with or without modification for any purpose and without fee or royalty is hereby granted",
        ("permission", "royalty", "hereby"),
    ),
    (
        "tcl",
        "the authors hereby grant permission to use copy modify distribute and license this software"
        " and its documentation for any purpose",
        ("authors", "hereby", "documentation"),
    ),
    ("bsd", _BSD, ("redistribution", "binary", "permitted")),
    (
        "bsd-2-clause",
        f"{_BSD} ... {_BSD_BINARY} this software is provided",
        ("redistribution", "redistributions", "materials"),
    ),
    (
        "bsd-3-clause",
        rf"{_BSD} ... {_BSD_BINARY}(?: \w)? (?:neither )?the names? of ... may(?: not)? be used to endorse or promote products",
        ("redistribution", "redistributions", "endorse"),
    ),
    (
        "bsd-4-clause",
        rf"{_BSD} ... {_BSD_BINARY}(?: \w)? all advertising materials mentioning features or use of this software"
        " must display the following acknowledge?ment",
        ("redistribution", "redistributions", "advertising"),
    ),
    (
        "bsd-3-clause-clear",
        "no express or implied licenses to any party s patent rights are granted by this license",
        ("implied", "patent", "party"),
    ),
    (
        "sleepycat",
        "redistributions in any form must be accompanied by information on how to obtain complete source code",
        ("redistributions", "accompanied", "obtain"),
    ),
    (
        "zlib",
        "in no event will the authors? be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose",
        ("liable", "arising", "anyone"),
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications"
        " and to alter it and redistribute it freely",
        ("anyone", "alter", "freely"),
    ),
    ("libpng", "the png reference library is supplied as is", ("png", "supplied")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        ("anyone", "compile", "publish"),
    ),
    ("wtfpl", "you just do what the fuck you want to", ("fuck",)),
    (
        "wtfpl",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document"
        " and changing it is allowed as long as the name is changed",
        ("everyone", "verbatim", "changing"),
    ),
    (
        "beerware",
        "as long as you retain this notice you can do whatever you want with this stuff",
        ("retain", "whatever", "stuff"),
    ),
    (
        "cc0",
        "the person who associated a work with this deed has dedicated the work to the public domain",
        ("associated", "deed", "dedicated"),
    ),
    (
        "cc0",
        "to the extent possible under law ... waived all copyright and related or neighbou?ring rights",
        ("extent", "waived", "law"),
    ),
    (
        "cc0",
        "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights",
        ("jurisdictions", "confer", "exclusive"),
    ),
    (
        "cc-by",
        r"terms and conditions of this creative commons attribution \d \d international public license",
        ("creative", "attribution", "international"),
    ),
    (
        "cc-by-sa",
        r"terms and conditions of this creative commons attribution share ?alike \d \d international public license",
        ("creative", "attribution", "international"),
    ),
    (
        "cc-by-nc",
        r"terms and conditions of this creative commons attribution non ?commercial \d \d international public license",
        ("creative", "attribution", "international"),
    ),
    (
        "cc-by-nd",
        r"terms and conditions of this creative commons attribution no ?derivatives \d \d international public license",
        ("creative", "attribution", "international"),
    ),
    (
        "cc-by-nc-sa",
        "terms and conditions of this creative commons attribution non ?commercial share ?alike"
        r" \d \d international public license",
        ("creative", "attribution", "international"),
    ),
    (
        "cc-by-nc-nd",
        "terms and conditions of this creative commons attribution non ?commercial no ?derivatives"
        r" \d \d international public license",
        ("creative", "attribution", "international"),
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file"
        " except in compliance with the license",
        ("apache", "except", "compliance"),
    ),
    (
        "apache",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        ("apache", "asf", "agreements"),
    ),
    ("apache", "apache license version 2 0 january 2004", ("apache", "january")),
    (
        "apache",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"
        "(?: except as stated in this section)? (?:copyright|patent) license",
        ("contributor", "perpetual", "irrevocable"),
    ),
    (
        "apache",
        "this product includes software developed by the apache software foundation",
        ("apache", "includes", "foundation"),
    ),
    ("gpl", f"{_GNU} general public license{_FSF}", ("redistribute", "gnu", "general")),
    ("lgpl", f"{_GNU} (?:lesser|library) general public license{_FSF}", ("redistribute", "gnu", "general")),
    ("agpl", f"{_GNU} affero general public license{_FSF}", ("redistribute", "gnu", "affero")),
    ("gpl", "you should have received a copy of the gnu general public license", ("received", "gnu", "general")),
    (
        "lgpl",
        "you should have received a copy of the gnu (?:lesser|library) general public license",
        ("received", "gnu", "general"),
    ),
    ("agpl", "you should have received a copy of the gnu affero general public license", ("received", "gnu", "affero")),
    ("gpl", r"gnu general public license version \d(?: \d)?(?: \d+)? june \d{4}", ("gnu", "general", "june")),
    ("lgpl", r"gnu lesser general public license version \d(?: \d)?(?: \d+)? (?:february|june) \d{4}", ("gnu", "lesser")),
    ("lgpl", r"gnu library general public license version \d(?: \d)?(?: \d+)? june \d{4}", ("gnu", "library", "june")),
    ("agpl", r"gnu affero general public license version \d(?: \d)?(?: \d+)? november \d{4}", ("gnu", "affero", "november")),
    (
        "gpl",
        "the licenses for most software(?: and other practical works)?"
        " are designed to take away your freedom to share and change",
        ("licenses", "designed", "freedom"),
    ),
    (
        "lgpl",
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3",
        ("gnu", "lesser", "incorporates"),
    ),
    (
        "agpl",
        "your modified version must prominently offer all users interacting with it remotely through a computer network",
        ("prominently", "interacting", "remotely"),
    ),
    (
        "gfdl",
        "permission is granted to copy distribute and or modify this document under the terms of"
        " the gnu free documentation license",
        ("permission", "gnu", "documentation"),
    ),
    (
        "gpl-classpath",
        "linking this library statically or dynamically with other modules is making a combined work based on this library",
        ("linking", "statically", "dynamically"),
    ),
    (
        "mpl",
        r"this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)?)?(?: \d \d)?",
        ("source", "subject", "mozilla"),
    ),
    ("mpl", "if a copy of the mpl was not distributed with this file", ("copy", "mpl", "distributed")),
    (
        "mpl",
        r"the contents of this file are subject to the mozilla public license(?: version)?(?: \d \d)?",
        ("contents", "subject", "mozilla"),
    ),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        ("accompanying", "materials", "eclipse"),
    ),
    (
        "epl",
        "the accompanying program is provided under the terms of this eclipse public license",
        ("accompanying", "eclipse"),
    ),
    (
        "cpl",
        "the accompanying program is provided under the terms of this common public license",
        ("accompanying", "common"),
    ),
    ("ipl", "the accompanying program is provided under the terms of this ibm public license", ("accompanying", "ibm")),
    (
        "cddl",
        "the contents of this file are subject to the terms of(?: either)? the common development and distribution license",
        ("contents", "subject", "distribution"),
    ),
    ("eupl", r"licensed under the eupl(?: (?:version |v)?\d \d)?", ("licensed", "eupl")),
    (
        "artistic",
        "the copyright holder maintains some semblance of artistic control over the development of the package",
        ("semblance", "artistic"),
    ),
    (
        "artistic",
        "redistribute it and or modify it under the same terms as (?:the )?perl(?: \\d)?(?: programming language system)? itself",
        ("redistribute", "perl"),
    ),
    (
        "python",
        "this license agreement is between the python software foundation psf and the individual or organization licensee",
        ("python", "psf", "licensee"),
    ),
    ("php", "this product includes php software freely available from", ("includes", "php", "freely")),
    (
        "openssl",
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        ("includes", "openssl", "toolkit"),
    ),
    ("ssleay", "this product includes cryptographic software written by eric young", ("cryptographic", "eric", "young")),
    (
        "ruby",
        "you may make and give away verbatim copies of the source form of the software without restriction",
        ("verbatim", "away", "restriction"),
    ),
    (
        "ms-rl",
        "reciprocal grants for any file you distribute that contains code from the software",
        ("reciprocal", "grants"),
    ),
    ("zpl", "this software is subject to the provisions of the zope public license", ("provisions", "zope")),
    (
        "lppl",
        "this work may be distributed and or modified under the conditions of the latex project public license",
        ("conditions", "latex"),
    ),
    (
        "bsl",
        "the licensor hereby grants you the right to copy modify create derivative works redistribute"
        " and make non production use of the licensed work",
        ("licensor", "derivative", "production"),
    ),
    (
        "sspl",
        "if you make the functionality of the program or a modified version available to third parties as a service",
        ("functionality", "parties", "service"),
    ),
    (
        "elastic",
        "you may not provide the software to third parties as a hosted or managed service",
        ("parties", "hosted", "managed"),
    ),
    (
        "commons-clause",
        "the grant of rights under the license will not include and the license does not grant to you"
        " the right to sell the software",
        ("grant", "include", "sell"),
    ),
    ("mulan", r"you can use this software according to the terms and conditions of the mulan psl v\d", ("according", "mulan")),
    (
        "odbl",
        "this (?:[^ ]+ ){0,5}(?:database|dataset) is made available under the open database license",
        ("open", "database"),
    ),
    (
        "cecill",
        "this software is governed by the cecill(?: [bc])? license under french law",
        ("governed", "cecill", "french"),
    ),
    (
        "public-domain",
        "(?:work|code|file|software|program|document) (?:has been|is) (?:hereby )?(?:placed|released|dedicated)"
        " (?:in|into|to) the public domain",
        ("public", "domain"),
    ),
    ("blessing", "in place of a legal notice here is a blessing", ("legal", "blessing")),
    ("vim", "vim is charityware", ("vim", "charityware")),
    (
        "ijg",
        "this software is based in part on the work of the independent jpeg group",
        ("independent", "jpeg"),
    ),
    ("ftl", "portions of this software are copyright ... the freetype project", ("portions", "freetype")),
    (
        "openrail",
        "you agree not to use the model or derivatives of the model",
        ("agree", "model", "derivatives"),
    ),
    (
        "proprietary",
        "unauthori[sz]ed copying of this file(?: via any medium)? is strictly prohibited",
        ("copying", "strictly", "prohibited"),
    ),
    (
        "proprietary",
        "this software is the confidential and proprietary information of",
        ("confidential", "proprietary"),
    ),
)

#: Addresses of license texts, as words.
LINKS = (
    ("mit", "opensource org licenses? mit", ("opensource", "mit")),
    ("isc", "opensource org licenses? isc", ("opensource", "isc")),
    ("bsd-2-clause", "opensource org licenses? bsd 2 clause", ("opensource", "bsd")),
    ("bsd-3-clause", "opensource org licenses? bsd 3 clause", ("opensource", "bsd")),
    ("bsd", "opensource org licenses? bsd(?: license)?", ("opensource", "bsd")),
    ("0bsd", "opensource org licenses? 0bsd", ("opensource", "0bsd")),
    ("apache", r"opensource org licenses? apache(?: \d \d)?", ("opensource", "apache")),
    ("zlib", "opensource org licenses? zlib", ("opensource", "zlib")),
    ("epl", r"opensource org licenses? epl(?: \d \d)?", ("opensource", "epl")),
    ("cddl", r"opensource org licenses? cddl(?: \d \d)?", ("opensource", "cddl")),
    ("mpl", r"opensource org licenses? mpl(?: \d \d)?", ("opensource", "mpl")),
    ("apache", r"apache org licenses(?: license \d \d)?", ("apache", "licenses")),
    ("gpl", r"gnu org (?:licenses|copyleft) (?:old licenses )?gpl(?: \d \d)?", ("gnu", "org", "gpl")),
    ("lgpl", r"gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lesser)(?: \d \d)?", ("gnu", "org", "copyleft")),
    ("agpl", r"gnu org licenses agpl(?: \d \d)?", ("gnu", "org", "agpl")),
    ("gfdl", r"gnu org licenses (?:old licenses )?fdl(?: \d \d)?", ("gnu", "org", "fdl")),
    ("mpl", r"mozilla org (?:en us )?mpl(?: \d \d)?", ("mozilla", "mpl")),
    ("epl", r"eclipse org legal epl(?: v ?\d\d)?", ("eclipse", "legal")),
    ("boost", r"boost org license \d \d", ("boost", "org")),
    ("unlicense", "unlicense org", ("unlicense", "org")),
    ("ofl", "scripts sil org ofl", ("sil", "ofl")),
    ("wtfpl", "wtfpl net", ("wtfpl", "net")),
    ("zlib", "zlib net zlib license", ("zlib", "net")),
    ("postgresql", "postgresql org about licen[sc]e", ("postgresql", "about")),
    ("php", r"php net license(?: \d \d\d)?", ("php", "net")),
    ("openssl", "openssl org source license", ("openssl", "source")),
    ("w3c", "w3 org consortium legal", ("w3", "consortium")),
    ("cc0", r"creativecommons org publicdomain zero(?: \d \d)?", ("creativecommons", "publicdomain")),
    ("public-domain", r"creativecommons org publicdomain mark(?: \d \d)?", ("creativecommons", "publicdomain")),
    ("cc-by", r"creativecommons org licenses by(?: \d \d)?", ("creativecommons", "by")),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: \d \d)?", ("creativecommons", "sa")),
    ("cc-by-nc", r"creativecommons org licenses by nc(?: \d \d)?", ("creativecommons", "nc")),
    ("cc-by-nd", r"creativecommons org licenses by nd(?: \d \d)?", ("creativecommons", "nd")),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: \d \d)?", ("creativecommons", "nc", "sa")),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: \d \d)?", ("creativecommons", "nc", "nd")),
    ("mit", "choosealicense com licenses mit", ("choosealicense", "mit")),
    ("apache", r"choosealicense com licenses apache(?: \d \d)?", ("choosealicense", "apache")),
    ("gpl", r"choosealicense com licenses gpl(?: \d \d)?", ("choosealicense", "gpl")),
)
