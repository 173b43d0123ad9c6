"""Signature rules of licenses, in order of priority: what stands first wins over what it covers.

A rule is (label, keywords, pattern, weight). Patterns run over lower-case words with one space between, so `4.0` is
`4 0` and `by-nc` is `by nc`. All keywords of a rule are words that any match of it holds; a text without them is not
searched. Weights say how much a match tells: a grant or a tag more than a bare name.
"""
from __future__ import annotations

GRANT, TAG, NAME, MENTION = 1.0, 0.95, 0.8, 0.5

Rule = tuple[str, tuple[str, ...], str, float]

LIC = "licen[sc]es?"
V = "(?:v|version|ver)?"
UNDER = "(?:licen[sc]ed|released|distributed|available|covered|published|provided|offered|made available)(?: \\S+){0,3} under"

#: Fixed phrases, found whatever other rules say; each is (label, words).
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Passages of license texts and notices: hand-written, longest and most telling first.
GRANTS: list[Rule] = [
    ("mit-0", ("permission", "charge", "furnished"),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
     "(?: \\S+){1,45} to permit persons to whom the software is furnished to do so the software is provided", GRANT),
    ("mit", ("permission", "charge"),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", GRANT),
    ("mit", ("copyright", "substantial"),
     "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", GRANT),
    ("boost-1", ("boost",), "boost software license version 1 0", GRANT),
    ("boost-1", ("permission", "organization"),
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", GRANT),
    ("isc", ("permission", "fee"),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", GRANT),
    ("0bsd", ("permission", "fee"),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", GRANT),
    ("isc", ("permission", "fee"),
     "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", GRANT),
    ("hpnd", ("permission", "fee"),
     "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", GRANT),
    ("bsd-4-clause", ("redistribution", "acknowledgement"),
     "redistribution and use in source and binary forms with or without modification are permitted(?: \\S+){1,90}"
     " must display the following acknowledgement", GRANT),
    ("bsd-3-clause", ("redistribution", "endorse"),
     "redistribution and use in source and binary forms with or without modification are permitted(?: \\S+){1,110}"
     " to endorse or promote products", GRANT),
    ("bsd-2-clause", ("redistribution", "binary"),
     "redistribution and use in source and binary forms with or without modification are permitted", GRANT),
    ("bsd-3-clause", ("endorse", "promote"), "be used to endorse or promote products derived from this software", GRANT),
    ("apache-2", ("apache", "compliance"),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", GRANT),
    ("apache-2", ("apache", "org"), "www apache org licenses license 2 0", GRANT),
    ("apache-1.1", ("apache", "foundation"),
     "this product includes software developed by the apache software foundation", GRANT),
    ("agpl-3", ("affero", "interact"),
     "gnu affero general public license(?: \\S+){1,200} interact with it remotely through a computer network", GRANT),
    ("agpl-3-or-later", ("affero", "redistribute", "later"),
     "redistribute it and or modify it under the terms of the gnu affero general public license as published by"
     " the free software foundation either version 3 of the license or at your option any later version", GRANT),
    ("lgpl-3-or-later", ("lesser", "redistribute", "later"),
     "redistribute it and or modify it under the terms of the gnu lesser general public license as published by"
     " the free software foundation either version 3 of the license or at your option any later version", GRANT),
    ("lgpl-2.1-or-later", ("lesser", "redistribute", "later"),
     "redistribute it and or modify it under the terms of the gnu lesser general public license as published by"
     " the free software foundation either version 2 1 of the license or at your option any later version", GRANT),
    ("lgpl-2-or-later", ("library", "redistribute", "later"),
     "redistribute it and or modify it under the terms of the gnu library general public license as published by"
     " the free software foundation either version 2 of the license or at your option any later version", GRANT),
    ("gpl-3-or-later", ("gnu", "redistribute", "later"),
     "redistribute it and or modify it under the terms of the gnu general public license as published by"
     " the free software foundation either version 3 of the license or at your option any later version", GRANT),
    ("gpl-2-or-later", ("gnu", "redistribute", "later"),
     "redistribute it and or modify it under the terms of the gnu general public license as published by"
     " the free software foundation either version 2 of the license or at your option any later version", GRANT),
    ("gpl-3-only", ("gnu", "redistribute"),
     "redistribute it and or modify it under the terms of the gnu general public license version 3", GRANT),
    ("gpl-2-only", ("gnu", "redistribute"),
     "redistribute it and or modify it under the terms of the gnu general public license version 2", GRANT),
    ("gfdl", ("gnu", "documentation"),
     "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", GRANT),
    ("gcc-exception", ("gcc", "runtime"), "gcc runtime library exception(?: version 3 1)?", GRANT),
    ("classpath-exception", ("classpath", "exception"), "(?:gnu )?classpath exception(?: 2 0)?", GRANT),
    ("classpath-exception", ("holders", "exception"),
     "as a special exception the copyright holders of this library give you permission to link this library", GRANT),
    ("mpl-2.0", ("mozilla", "subject"),
     "this source code form is subject to the terms of the mozilla public license v 2 0", GRANT),
    ("mpl-1.1", ("mozilla", "contents"),
     "the contents of this file are subject to the mozilla public license version 1 1", GRANT),
    ("epl-2.0", ("eclipse", "accompanying"),
     "accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", GRANT),
    ("epl-1.0", ("eclipse", "accompanying"),
     "accompanying materials are made available under the terms of the eclipse public license v1 0", GRANT),
    ("cddl-1.0", ("development", "distribution"), "common development and distribution license(?: cddl)? version 1 0", GRANT),
    ("zlib", ("origin", "misrepresented"),
     "the origin of this software must not be misrepresented you must not claim that you wrote the original software", GRANT),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain", GRANT),
    ("wtfpl", ("fuck",), "do what the fuck you want to public license", GRANT),
    ("cc0-1.0", ("cc0",), "cc0 1 0 universal(?: public domain dedication)?", GRANT),
    ("cc0-1.0", ("creativecommons", "zero"), "creativecommons org publicdomain zero 1 0", GRANT),
    ("cc-pdm-1.0", ("creativecommons", "mark"), "creativecommons org publicdomain mark 1 0", GRANT),
    ("cc0-1.0", ("waived", "neighboring"), "has waived all copyright and related or neighboring rights", GRANT),
    ("public-domain", ("disclaims", "author"), "the author disclaims copyright to this source code", GRANT),
    ("public-domain", ("domain", "placed"), "(?:has been |is |are |hereby )?placed (?:in|into) the public domain", GRANT),
    ("public-domain", ("domain", "dedicated"), "dedicated to the public domain", GRANT),
    ("public-domain", ("domain", "released"), "released (?:in|into|to) the public domain", GRANT),
    ("openssl", ("openssl", "project"), "this product includes software developed by the openssl project", GRANT),
    ("postgresql", ("postgresql", "permission"),
     "postgresql(?: \\S+){1,40} permission to use copy modify and distribute this software and its documentation for any purpose", GRANT),
    ("ncsa", ("deal", "restriction"),
     "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute", GRANT),
    ("json", ("evil",), "the software shall be used for good not evil", GRANT),
    ("beerware", ("beer",), "you can buy me a beer in return", GRANT),
    ("ofl-1.1", ("sil", "font"), "this font software is licensed under the sil open font license version 1 1", GRANT),
    ("openrail", ("model", "restrictions"),
     "you agree not to use the model or derivatives of the model(?: \\S+){1,20} use based restrictions", GRANT),
    ("research-only", ("research", "purposes"),
     "(?:for|to) (?:non commercial |academic |scientific |educational )*research purposes only", GRANT),
    ("non-commercial", ("commercial", "prohibited"), "commercial use (?:of \\S+(?: \\S+){0,3} )?is (?:strictly )?prohibited", GRANT),
    ("non-commercial", ("commercial", "only"), "for (?:personal and |personal or )?non commercial (?:use|purposes) only", GRANT),
    ("non-commercial", ("commercial", "permitted"), "commercial use is not permitted", GRANT),
    ("no-derivatives", ("derivative", "permitted"), "derivative works are not permitted", GRANT),
    ("proprietary", ("proprietary", "confidential"), "(?:proprietary and confidential|confidential and proprietary)", GRANT),
    ("proprietary", ("prohibited",),
     "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \\S+){0,16} prohibited", GRANT),
    ("proprietary", ("reproduced", "permission"),
     "no part of this (?:publication|document|book|work|site) may be reproduced(?: \\S+){0,30} permission", GRANT),
    ("proprietary", ("trade", "information"), "contains trade secrets? and proprietary information", GRANT),
    ("all-rights-reserved", ("rights", "reserved"), "all rights (?:are )?reserved", NAME),
    ("all-rights-reserved", ("rechte", "vorbehalten"), "alle rechte vorbehalten", NAME),
    ("all-rights-reserved", ("droits", "réservés"), "tous droits réservés", NAME),
    ("all-rights-reserved", ("derechos", "reservados"), "(?:todos los derechos reservados|reservados todos los derechos)", NAME),
    ("all-rights-reserved", ("diritti", "riservati"), "tutti i diritti (?:sono )?riservati", NAME),
    ("all-rights-reserved", ("direitos", "reservados"), "todos os direitos reservados", NAME),
]

#: Other licenses by name: hand-written, the named version before the bare name.
NAMES: list[Rule] = [
    ("apache-2", ("apache",), f"apache(?: software)?(?: {LIC})? {V} ?2(?: 0)?", NAME),
    ("apache-2", ("apache2",), f"(?:{LIC} )?apache2(?: {LIC})?", NAME),
    ("apache-1.1", ("apache",), f"apache(?: software)?(?: {LIC})? {V} ?1 1", NAME),
    ("apache-1.0", ("apache",), f"apache(?: software)?(?: {LIC})? {V} ?1 0", NAME),
    ("apache", ("apache",), f"(?:apache(?: software)? {LIC}|{UNDER} (?:the )?apache(?! (?:software|lic|v|2)))", MENTION),
    ("mit-0", ("mit", "attribution"), f"mit no attribution(?: {LIC})?", NAME),
    ("mit", ("mit",), f"{UNDER} (?:the |an )?mit(?: x11| expat)?(?: {LIC})?", NAME),
    ("mit", ("mit",), f"(?:{LIC} mit|mit {LIC}|mit style {LIC}|opensource org licenses mit)", NAME),
    ("mit", ("expat",), f"expat(?: mit)? {LIC}", NAME),
    ("x11", ("x11",), f"x11 {LIC}", NAME),
    ("isc", ("isc",), f"(?:isc {LIC}|{UNDER} (?:the )?isc|opensource org licenses isc)", NAME),
    ("0bsd", ("0bsd",), f"0bsd(?: {LIC})?", NAME),
    ("0bsd", ("bsd", "zero"), f"(?:bsd zero clause|zero clause bsd)(?: {LIC})?", NAME),
    ("bsd-4-clause", ("bsd", "4"), f"(?:bsd 4 clause|4 clause bsd)(?: {LIC})?", NAME),
    ("bsd-4-clause", ("bsd", "original"), f"original bsd {LIC}", NAME),
    ("bsd-3-clause", ("bsd", "3"), f"(?:bsd 3(?: clause)?|3 clause bsd)(?: {LIC})?", NAME),
    ("bsd-3-clause", ("bsd", "three"), f"three clause bsd(?: {LIC})?", NAME),
    ("bsd-3-clause", ("bsd",), f"(?:new|modified|revised) bsd {LIC}", NAME),
    ("bsd-2-clause", ("bsd", "2"), f"(?:bsd 2(?: clause)?|2 clause bsd)(?: {LIC})?", NAME),
    ("bsd-2-clause", ("bsd", "two"), f"two clause bsd(?: {LIC})?", NAME),
    ("bsd-2-clause", ("bsd",), f"simplified bsd {LIC}", NAME),
    ("bsd-2-clause", ("freebsd",), f"freebsd {LIC}", NAME),
    ("bsd", ("bsd",), f"(?:bsd(?: style)? {LIC}|{UNDER} (?:the |a )?bsd(?! (?:style|lic|\\d|zero)))", MENTION),
    ("mpl-2.0", ("mozilla",), f"mozilla public {LIC} {V} ?2(?: 0)?", NAME),
    ("mpl-1.1", ("mozilla",), f"mozilla public {LIC} {V} ?1 1", NAME),
    ("mpl-1.0", ("mozilla",), f"mozilla public {LIC} {V} ?1 0", NAME),
    ("mpl", ("mozilla",), f"mozilla public {LIC}", MENTION),
    ("mpl-2.0", ("mpl",), "mpl(?: v| version)? v?2(?: 0)?", NAME),
    ("mpl-1.1", ("mpl",), "mpl(?: v| version)? v?1 1", NAME),
    ("epl-2.0", ("eclipse",), f"eclipse public {LIC} {V} ?2(?: 0)?", NAME),
    ("epl-1.0", ("eclipse",), f"eclipse public {LIC} {V} ?1(?: 0)?", NAME),
    ("epl", ("eclipse",), f"eclipse public {LIC}", MENTION),
    ("edl-1.0", ("eclipse", "distribution"), f"eclipse distribution {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("cddl-1.1", ("cddl",), "cddl(?: v| version)? v?1 1", NAME),
    ("cddl-1.0", ("cddl",), "cddl(?: v| version)? v?1 0", NAME),
    ("cddl", ("development", "distribution"), f"common development and distribution {LIC}", MENTION),
    ("cpl-1.0", ("common", "public"), f"common public {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("cpal-1.0", ("attribution", "public"), f"common public attribution {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("ipl-1.0", ("ibm",), f"ibm public {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("eupl-1.2", ("european", "union"), f"european union public {LIC}(?: \\S+)? {V} ?1 2", NAME),
    ("eupl-1.1", ("european", "union"), f"european union public {LIC}(?: \\S+)? {V} ?1 1", NAME),
    ("eupl", ("european", "union"), f"european union public {LIC}", MENTION),
    ("eupl-1.2", ("eupl",), "eupl(?: v| version)? v?1 2", NAME),
    ("cecill-2.1", ("cecill",), "cecill(?: \\S+)? 2 1", NAME),
    ("cecill-b", ("cecill",), "cecill b", NAME),
    ("cecill-c", ("cecill",), "cecill c", NAME),
    ("cecill", ("cecill",), f"(?:cecill {LIC}|{LIC} cecill|licence cecill)", MENTION),
    ("ms-pl", ("microsoft", "public"), f"microsoft public {LIC}", NAME),
    ("ms-rl", ("microsoft", "reciprocal"), f"microsoft reciprocal {LIC}", NAME),
    ("artistic-2.0", ("artistic",), f"artistic {LIC} {V} ?2(?: 0)?", NAME),
    ("artistic-1.0", ("artistic",), f"artistic {LIC} {V} ?1(?: 0)?", NAME),
    ("artistic", ("artistic",), f"(?:perl )?artistic {LIC}", MENTION),
    ("boost-1", ("boost",), f"boost(?: software)? {LIC}", NAME),
    ("zlib", ("zlib",), f"(?:zlib(?: libpng)? {LIC}|{UNDER} (?:the )?zlib)", NAME),
    ("libpng", ("libpng",), f"libpng {LIC}", NAME),
    ("libpng", ("png",), f"png reference library {LIC}", NAME),
    ("unlicense", ("unlicense",), "(?:the )?unlicense", NAME),
    ("wtfpl", ("wtfpl",), "wtfpl", NAME),
    ("openssl", ("openssl",), f"openssl {LIC}", NAME),
    ("ssleay", ("ssleay",), f"(?:original )?ssleay {LIC}", NAME),
    ("psf-2.0", ("python",), f"python software foundation {LIC}(?: v| version)?(?: 2(?: 0)?)?", NAME),
    ("python-2.0", ("python",), f"python {LIC} 2 0", NAME),
    ("php-3.01", ("php",), f"php {LIC} {V} ?3 0?1", NAME),
    ("php", ("php",), f"php {LIC}", MENTION),
    ("ruby", ("ruby",), f"(?:ruby {LIC}|ruby s {LIC})", NAME),
    ("tcl", ("tcl",), f"tcl tk {LIC}|tcl {LIC}", NAME),
    ("vim", ("vim",), f"vim {LIC}", NAME),
    ("curl", ("curl",), f"curl {LIC}", NAME),
    ("icu", ("icu",), f"icu {LIC}", NAME),
    ("unicode-dfs", ("unicode",), f"unicode (?:data files and software|inc)(?: \\S+)? {LIC}", NAME),
    ("w3c", ("w3c",), f"w3c software(?: notice)?(?: and)?(?: document)? {LIC}", NAME),
    ("postgresql", ("postgresql",), f"postgresql {LIC}", NAME),
    ("ncsa", ("ncsa",), f"(?:university of illinois )?ncsa(?: open source)? {LIC}", NAME),
    ("upl-1.0", ("universal", "permissive"), f"universal permissive {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("afl-3.0", ("academic", "free"), f"academic free {LIC}(?: v| version)?(?: 3 0)?", NAME),
    ("osl-3.0", ("open", "software"), f"open software {LIC}(?: v| version)?(?: 3 0)?", NAME),
    ("ecl-2.0", ("educational", "community"), f"educational community {LIC}(?: v| version)?(?: 2 0)?", NAME),
    ("qpl-1.0", ("q", "public"), f"q public {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("sleepycat", ("sleepycat",), f"sleepycat {LIC}", NAME),
    ("bsl-1.1", ("business", "source"), f"business source {LIC}(?: v| version)?(?: 1 1)?", NAME),
    ("sspl-1.0", ("server", "side"), f"server side public {LIC}(?: v| version)?(?: 1(?: 0)?)?", NAME),
    ("elastic-2.0", ("elastic",), f"elastic {LIC}(?: v| version)?(?: 2 0)?", NAME),
    ("commons-clause", ("commons", "clause"), f"commons clause(?: {LIC})?(?: condition)?", NAME),
    ("polyform-nc-1.0", ("polyform", "noncommercial"), f"polyform noncommercial {LIC}(?: 1 0 0)?", NAME),
    ("polyform-sb-1.0", ("polyform", "small"), f"polyform small business {LIC}(?: 1 0 0)?", NAME),
    ("mulan-2", ("mulan",), f"mulan (?:psl|permissive software {LIC})(?: v| version)? ?2?", NAME),
    ("ofl-1.1", ("font",), f"(?:sil )?open font {LIC}(?: v| version)?(?: 1 1)?", NAME),
    ("ofl-1.1", ("ofl",), "ofl 1 1", NAME),
    ("ubuntu-font-1.0", ("ubuntu", "font"), f"ubuntu font {LIC}(?: v| version)?(?: 1 0)?", NAME),
    ("odbl-1.0", ("odbl",), "odbl(?:(?: v| version)? v?1 0)?", NAME),
    ("odbl-1.0", ("database", "open"), f"open (?:data commons open )?database {LIC}", NAME),
    ("odc-by-1.0", ("commons", "attribution"), f"open data commons attribution {LIC}", NAME),
    ("odc-by-1.0", ("odc",), "odc by(?: 1 0)?", NAME),
    ("pddl-1.0", ("pddl",), "pddl(?: 1 0)?", NAME),
    ("pddl-1.0", ("dedication", "domain"), f"public domain dedication and {LIC}", NAME),
    ("cdla-permissive-2.0", ("community", "data"), f"community data {LIC} agreement permissive(?: version)?(?: 2 0)?", NAME),
    ("cdla-sharing-1.0", ("community", "data"), f"community data {LIC} agreement sharing(?: version)?(?: 1 0)?", NAME),
    ("ogl-3.0", ("open", "government"), f"open government {LIC}(?: v| version)? ?3(?: 0)?", NAME),
    ("ogl", ("open", "government"), f"open government {LIC}", MENTION),
    ("etalab-2.0", ("etalab",), f"etalab(?: open)?(?: {LIC})?(?: 2 0)?", NAME),
    ("dl-de-by-2.0", ("datenlizenz",), "datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", NAME),
    ("dl-de-zero-2.0", ("datenlizenz", "zero"), "datenlizenz deutschland zero(?: version)?(?: 2 0)?", NAME),
    ("llama-2", ("llama",), f"llama 2 community {LIC}", NAME),
    ("llama-3", ("llama",), f"(?:meta )?llama 3(?: \\d)? community {LIC}", NAME),
    ("openrail", ("openrail",), "(?:bigscience |creativeml |bigcode )?openrail(?: m)?", NAME),
    ("openrail", ("rail",), f"bigscience rail {LIC}", NAME),
    ("openrail", ("responsible", "ai"), f"responsible ai {LIC}", NAME),
    ("gemma", ("gemma",), "gemma terms of use", NAME),
    ("cc0-1.0", ("cc0",), "cc0(?: 1 0)?", NAME),
    ("cc-sampling-plus", ("sampling", "plus"), "(?:creative commons|cc) sampling plus(?: 1 0)?", NAME),
    ("cc", ("creative", "commons"), f"creative commons(?: public)?(?: {LIC})?", MENTION),
    ("cc", ("kreative", "commons"), "kreative commons", MENTION),
    ("public-domain", ("domain",), "(?:is|are|in|into|under) (?:the )?public domain", NAME),
    ("public-domain", ("gemeinfrei",), "gemeinfrei", NAME),
    ("gnu", ("gnu",), f"gnu (?:public )?{LIC}", MENTION),
    ("open-source", ("osi",), f"osi approved(?: open source)?(?: {LIC})?", MENTION),
    ("creative-work", ("reuse", "permission"), "reuse without permission is not allowed", MENTION),
    ("fair-use", ("fair",), "(?:fair use|fair dealing) (?:exception|provision|doctrine)s?", MENTION),
    ("royalty-free", ("royalty",), f"royalty free {LIC}", MENTION),
    ("freeware", ("freeware",), f"freeware(?: {LIC})?", MENTION),
    ("shareware", ("shareware",), f"shareware(?: {LIC})?", MENTION),
    ("eula", ("eula",), "eula", MENTION),
    ("eula", ("end", "user"), f"end user {LIC} agreement", MENTION),
    ("copyright", ("copyright",), "copyright (?:c |© )?(?:19|20)\\d\\d", MENTION),
    ("copyright", ("©",), "© (?:copyright )?(?:19|20)\\d\\d", MENTION),
]

#: The parts of the Creative Commons family: short code and full name by words.
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_CODES = ("by nc sa", "by nc nd", "by nc", "by sa", "by nd", "by")
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 1", "2 0", "1 0")
#: The GNU family: name, short name, versions.
GNU = (
    ("agpl", "affero", "(?:gnu )?affero general public", ("3", "1")),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public", ("3", "2 1", "2")),
    ("gfdl", "documentation", "(?:gnu )?free documentation", ("1 3", "1 2", "1 1")),
    ("gpl", "general", "(?:gnu )?general public", ("3", "2", "1")),
)


def creative_commons() -> list[Rule]:
    """By address, full name and short name, each code with every version, and without one."""
    rules: list[Rule] = []
    for version in (*CC_VERSIONS, None):
        end, label_end = (f" {version}", "-" + version.replace(" ", ".")) if version else ("", "")
        for code in CC_CODES:
            label = "cc-" + code.replace(" ", "-") + label_end
            full = " ".join(CC_PARTS[x] for x in code.split())
            between = "(?: international| unported| generic)?" if version else ""
            license_ = f"(?: public)?(?: {LIC})?(?: \\S+)?" if version else ""
            rules += [
                (label, ("creativecommons",), f"creativecommons org licenses {code}{end}", GRANT if version else NAME),
                (label, ("attribution",), f"(?:creative commons |cc ){full}{license_}{end}{between}", TAG if version else NAME),
                (label, ("cc", code.split()[-1]), f"cc {code}{end}{between}", TAG if version else NAME),
            ]
    return rules


def gnu_family() -> list[Rule]:
    """By full and short name, each version with and without "or later" and "only", and without a version."""
    rules: list[Rule] = []
    number = "(?: v| version| ver)? v?"
    for short, word, full, versions in GNU:
        for version in versions:
            label, dot = f"{short}-{version.replace(' ', '.')}", "" if " " in version else "(?: 0)?"
            for suffix, end in (("-or-later", "(?: or(?: \\S+){0,3} later(?: version)?)"), ("-only", " only"), ("", "")):
                rules += [
                    (label + suffix, (word,), f"{full} {LIC}(?: {short})?{number}{version}{dot}{end}", TAG),
                    (label + suffix, (short,), f"(?:gnu )?{short}{number}{version}{dot}{end}", NAME),
                    *((label + suffix, (short + v + version.split()[0],), f"(?:gnu )?{short}{v}{version}{dot}{end}", NAME)
                      for v in ("v", "")),
                ]
            rules.append((label + "-or-later", (short,), f"{short} {version}{dot} plus", NAME))
        rules += [(short, (word,), f"{full} {LIC}", NAME), (short, (short,), f"(?:gnu )?{short}", MENTION)]
    return rules


#: Identifiers after an SPDX tag: label by the words of the identifier.
SPDX = ("mit", "mit 0", "isc", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "apache 1 1", "mpl 1 1", "mpl 2 0",
        "epl 1 0", "epl 2 0", "eupl 1 2", "cddl 1 0", "artistic 2 0", "zlib", "unlicense", "wtfpl", "cc0 1 0", "ofl 1 1",
        "odbl 1 0", "pddl 1 0", "postgresql", "ncsa", "ms pl", "ms rl", "python 2 0", "ecl 2 0", "upl 1 0", "bsl 1 1")


def spdx_tags() -> list[Rule]:
    def label(words: str) -> str:
        out = words.split()
        while len(out) > 2 and out[-1].isdigit() and out[-2].isdigit():
            out[-2:] = [f"{out[-2]}.{out[-1]}"]
        return "-".join(out)

    rules = [(label(x), ("spdx", x.split()[0]), f"spdx license identifier {x}", TAG)
             for x in sorted(SPDX, key=len, reverse=True)]
    return [("apache-2", ("spdx", "apache"), "spdx license identifier apache 2 0", TAG),
            ("boost-1", ("spdx", "bsl"), "spdx license identifier bsl 1 0", TAG), *rules]


#: Every rule, in order of priority.
RULES: list[Rule] = GRANTS + spdx_tags() + creative_commons() + gnu_family() + NAMES
