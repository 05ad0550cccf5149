"""Known licence sentences and the ordered rules over them, as a value that a scan takes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Sentence ends, in a lower-cased text; between them stand the parts that are looked up.
END = r"[.!?;:]+([ \t\r\n\f\x0B]|\z)"
OTHER = r"[^a-z0-9]+"

#: Licence sentences in their usual wording, by identifier. Capitals, signs and line ends don't count.
SENTENCES = {
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-name-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-copyright-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "mit-name": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl3-name": "This work is licensed under the GNU General Public License version 3.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-only-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-only-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-only-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "fsf-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "mpl2-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-grant": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-name": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "cc0-name": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-public-domain": "This work is dedicated to the public domain under CC0 1.0.",
    "artistic2-name": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "ofl-name": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "reserved": "All rights reserved.",
}
#: Parts of words; most sentences have one, and for each that hasn't its longest word is added.
ANCHORS = ("licen", "copyright", "reserved", "permission", "redistribut", "warrant", "unencumbered", "compiled", "advertising")
#: Identifiers that may follow "SPDX-License-Identifier:".
SPDX = (
    "Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0",
    "EPL-1.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "WTFPL", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Artistic-2.0", "OFL-1.1",
)
#: The variants of Creative Commons licences, in their short and long form, and their versions.
CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
#: Fixed values, in order: rule, licence, sentences in order, and the earlier rules that cover it.
RULES = (
    ("apache-full", "Apache-2.0", ("apache-copyright-grant",), ()),
    ("apache-header", "Apache-2.0", ("apache-name-the", "apache-may-not", "apache-as-is"), ("apache-full",)),
    ("apache-short", "Apache-2.0", ("apache-name-the",), ("apache-full", "apache-header")),
    ("apache-notice", "Apache-2.0", ("apache-name",), ("apache-full", "apache-header", "apache-short")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-as-is"), ()),
    ("mit0-text", "MIT-0", ("mit0-grant", "mit-as-is"), ()),
    ("mit-notice", "MIT", ("mit-name",), ("mit-text",)),
    ("mit-licensed", "MIT", ("mit-licensed",), ("mit-text", "mit-notice")),
    ("bsd-four", "BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"), ()),
    ("bsd-three", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ("bsd-four",)),
    ("bsd-two", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-four", "bsd-three")),
    ("isc-text", "ISC", ("isc-grant",), ()),
    ("isc-and-text", "ISC", ("isc-grant-and",), ("isc-text",)),
    ("0bsd-text", "0BSD", ("0bsd-grant",), ()),
    ("gpl3-text", "GPL-3.0-or-later", ("gpl3-grant",), ()),
    ("gpl3-only-text", "GPL-3.0-only", ("gpl3-only-grant",), ("gpl3-text",)),
    ("gpl3-notice", "GPL-3.0-only", ("gpl3-name",), ("gpl3-text", "gpl3-only-text")),
    ("gpl3-document", "GPL-3.0-only", ("gpl3-title", "fsf-verbatim"), ("gpl3-text", "gpl3-only-text", "gpl3-notice")),
    ("gpl2-text", "GPL-2.0-or-later", ("gpl2-grant",), ()),
    ("gpl2-only-text", "GPL-2.0-only", ("gpl2-only-grant",), ("gpl2-text",)),
    ("gpl2-document", "GPL-2.0-only", ("gpl2-title", "fsf-verbatim"), ("gpl2-text", "gpl2-only-text")),
    ("lgpl21-text", "LGPL-2.1-or-later", ("lgpl21-grant",), ()),
    ("lgpl21-only-text", "LGPL-2.1-only", ("lgpl21-only-grant",), ("lgpl21-text",)),
    ("lgpl21-document", "LGPL-2.1-only", ("lgpl21-title", "fsf-verbatim"), ("lgpl21-text", "lgpl21-only-text")),
    ("lgpl3-text", "LGPL-3.0-or-later", ("lgpl3-grant",), ()),
    ("lgpl3-document", "LGPL-3.0-only", ("lgpl3-title", "fsf-verbatim"), ("lgpl3-text",)),
    ("agpl3-text", "AGPL-3.0-or-later", ("agpl3-grant",), ()),
    ("agpl3-only-text", "AGPL-3.0-only", ("agpl3-only-grant",), ("agpl3-text",)),
    ("agpl3-document", "AGPL-3.0-only", ("agpl3-title", "fsf-verbatim"), ("agpl3-text", "agpl3-only-text")),
    ("mpl2-header", "MPL-2.0", ("mpl2-grant", "mpl2-copy"), ()),
    ("mpl2-http-header", "MPL-2.0", ("mpl2-grant", "mpl2-copy-http"), ("mpl2-header",)),
    ("mpl2-short", "MPL-2.0", ("mpl2-grant",), ("mpl2-header", "mpl2-http-header")),
    ("epl2-header", "EPL-2.0", ("epl2-grant",), ()),
    ("epl1-header", "EPL-1.0", ("epl1-grant",), ()),
    ("unlicense-text", "Unlicense", ("unlicense-domain", "unlicense-anyone"), ()),
    ("unlicense-short", "Unlicense", ("unlicense-domain",), ("unlicense-text",)),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-permission"), ()),
    ("bsl-text", "BSL-1.0", ("bsl-grant",), ()),
    ("bsl-notice", "BSL-1.0", ("bsl-name",), ("bsl-text",)),
    ("wtfpl-text", "WTFPL", ("wtfpl-title",), ()),
    ("cc0-deed", "CC0-1.0", ("cc0-dedication",), ()),
    ("cc0-waiver", "CC0-1.0", ("cc0-name",), ("cc0-deed",)),
    ("cc0-notice", "CC0-1.0", ("cc0-public-domain",), ("cc0-deed", "cc0-waiver")),
    ("artistic2-notice", "Artistic-2.0", ("artistic2-name",), ()),
    ("ofl-notice", "OFL-1.1", ("ofl-name",), ()),
)


def normal(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip()


def parts(sentence: str) -> tuple[str, ...]:
    """A sentence cut as texts are cut, as "free software: you can" is, and normalised."""
    cut = re.sub(END.replace(r"\z", r"\Z"), "\n", sentence.lower()).split("\n")
    return tuple(p for p in map(normal, cut) if p)


@dataclass(frozen=True)
class Library:
    """Sentences by identifier, rules over them, and what a scan derives from both.

    A library is of a fixed, small size: it becomes a part of the plan.
    """

    sentences: dict[str, str]
    rules: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]
    #: Each known part's mark; each sentence by its marks, longest first; what every sentence has one of within a word,
    #: where normalising changes nothing but case.
    marks: dict[str, str] = field(init=False)
    runs: dict[str, str] = field(init=False)
    anchors: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks: dict[str, str] = {}
        runs: dict[str, str] = {}
        for name, text in self.sentences.items():
            runs.setdefault("".join(marks.setdefault(p, f"<{len(marks)}>") for p in parts(text)), name)
        known = {s for _, _, sequence, _ in self.rules for s in sequence}
        if known - set(runs.values()):
            raise ValueError(f"rules name sentences that aren't known, or that read as others do: {sorted(known - set(runs.values()))}")
        object.__setattr__(self, "marks", marks)
        object.__setattr__(self, "runs", dict(sorted(runs.items(), key=lambda r: (-r[0].count("<"), r[0]))))
        anchors = list(ANCHORS)
        for words in (" ".join(parts(t)).split() for t in self.sentences.values()):
            if not any(a in w for a in anchors for w in words):
                anchors.append(max(words, key=len))
        object.__setattr__(self, "anchors", tuple(anchors))


def default_library() -> Library:
    """The sentences and rules above, with SPDX lines and Creative Commons licences made by rule."""
    sentences, rules = dict(SENTENCES), list(RULES)
    covers: dict[str, list[str]] = {}
    for rule, licence, _, _ in RULES:
        covers.setdefault(licence, []).append(rule)
    for variant, words in CC.items():
        for version, scope in CC_VERSIONS.items():
            short, licence = f"cc-{variant.lower()}-{version}", f"CC-{variant}-{version}"
            sentences[short] = f"Licensed under CC {variant} {version}."
            sentences[f"{short}-work"] = f"This work is licensed under a Creative Commons {words} {version} {scope} License."
            sentences[f"{short}-the-work"] = f"This work is licensed under the Creative Commons {words} {version} {scope} License."
            names = [short, f"{short}-work", f"{short}-the-work"]
            rules += [(n, licence, (n,), tuple(names[:k])) for k, n in enumerate(names)]
            covers[licence] = names
    for name in SPDX:
        sentences[f"spdx-{name}"] = f"SPDX-License-Identifier: {name}"
        rules.append((f"spdx-{name}", name, (f"spdx-{name}",), tuple(covers.get(name, ()))))
    return Library(sentences, (*rules, ("reserved", "Proprietary", ("reserved",), ("epl1-header",))))


LIBRARY = default_library()
