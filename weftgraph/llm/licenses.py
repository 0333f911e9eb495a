"""License scans by template-markup matching.

A template is a line of words with regions: ``[[ ... ]]`` may be left out, ``{{name:12}}`` stands
for up to 12 words of any kind, ``{{name=a|b c}}`` for one of the wordings given. Templates are
compiled into automata over words; a text is accepted from the place where a template's opening
words stand if every mandatory word follows in its place, disclaimers included.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftgraph.llm.textmap import add_columns

#: Phrases of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of the licences and of the notices that name them, with regions marked.
AS_IS_HOLDERS = "THIS SOFTWARE IS PROVIDED BY {{by:16}} ''AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{party:16}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED {{quoted=AS IS}} AND {{author:12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{party:12}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
GNU_NOTICE = "{{what=free software|is free software}} you can redistribute it and/or modify it under the terms of the GNU {{kind}} General Public License as published by the Free Software Foundation; {{version}} [[of the License]] [[, or (at your option) any later version]]. [[{{program:8}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.]]"
UNDER = "{{verb=licensed|released|distributed|available|published|shared|provided}} under [[the]] [[a]] [[terms of the]] [[terms of]] [[the]]"


def _gnu(kind: str, version: str) -> str:
    return GNU_NOTICE.replace("{{kind}}", kind).replace("{{version}}", f"[[either]] version {version}")


def _named(names: str) -> str:
    """A notice that names a licence in one of several ways."""
    return f"{UNDER} {{{{name={names}}}}}"


#: Names of the public list of licence identifiers.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0",
    "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "PostgreSQL", "PSF-2.0", "Ruby", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the {{thing=Software}}), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {{holders:8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-0-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the {{thing=Software}}), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + ISC_DISCLAIMER,
    "0bsd-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_DISCLAIMER,
    "bsd-2-clause-text": f"{BSD_CLAUSES} {AS_IS_HOLDERS}",
    "bsd-3-clause-text": f"{BSD_CLAUSES} [[3]] Neither the name of {{{{holder:16}}}} may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS_HOLDERS}",
    "bsd-4-clause-text": f"{BSD_CLAUSES} [[3]] All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {{{{holder:16}}}}. [[4]] Neither the name of {{{{owner:16}}}} may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS_HOLDERS}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the {{author:4}} be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3]] This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the {{thing=Software}}) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the {{thing=License}}); you may not use this file except in compliance with the License. You may obtain a copy of the License at {{place:12}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-heading": "Apache License Version 2.0, January 2004 [[http://www.apache.org/licenses/]] TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-2.0-notice": _gnu("", "2"),
    "gpl-3.0-notice": _gnu("", "3"),
    "lgpl-2.1-notice": _gnu("Lesser", "2.1"),
    "lgpl-3.0-notice": _gnu("Lesser", "3"),
    "agpl-3.0-notice": _gnu("Affero", "3"),
    "gpl-3.0-heading": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2.0-heading": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-2.1-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3.0-heading": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {{place:8}}",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License [[v]] [[version]] 2.0",
    "cc0-notice": "To the extent possible under law, {{who:16}} waived all copyright and related or neighboring rights to",
    "public-domain": "{{what=released into|placed into|placed in|dedicated to|in}} the public domain",
    "mit": _named("MIT license|MIT"),
    "apache-2.0": _named("Apache License Version 2.0|Apache License 2.0|Apache 2.0 license|Apache 2.0"),
    "gpl-3.0": _named("GNU General Public License version 3|GNU General Public License v3|GNU GPL version 3|GNU GPL v3|GPL v3|GPL version 3|GPLv3|GPL 3.0"),
    "gpl-2.0": _named("GNU General Public License version 2|GNU General Public License v2|GNU GPL version 2|GNU GPL v2|GPL v2|GPL version 2|GPLv2|GPL 2.0"),
    "lgpl-3.0": _named("GNU Lesser General Public License version 3|GNU Lesser General Public License v3|GNU LGPL v3|LGPL v3|LGPLv3|LGPL 3.0"),
    "lgpl-2.1": _named("GNU Lesser General Public License version 2.1|GNU Lesser General Public License v2.1|GNU LGPL v2.1|LGPL v2.1|LGPLv2.1|LGPL 2.1"),
    "agpl-3.0": _named("GNU Affero General Public License version 3|GNU Affero General Public License v3|GNU AGPL v3|AGPL v3|AGPLv3|AGPL 3.0"),
    "bsd": _named("BSD license|2-clause BSD license|3-clause BSD license|BSD 2-clause license|BSD 3-clause license|new BSD license|simplified BSD license|modified BSD license"),
    "isc": _named("ISC license"),
    "mpl-2.0": _named("Mozilla Public License version 2.0|Mozilla Public License 2.0|Mozilla Public License v2.0|Mozilla Public License v. 2.0|MPL 2.0"),
    "cc-by-4.0": _named("Creative Commons Attribution 4.0|Creative Commons CC BY 4.0|CC BY 4.0") + " [[International]] [[License]]",
    "cc-by-sa-4.0": _named("Creative Commons Attribution-ShareAlike 4.0|Creative Commons CC BY-SA 4.0|CC BY-SA 4.0") + " [[International]] [[License]]",
    "cc-by-sa-3.0": _named("Creative Commons Attribution-ShareAlike 3.0|Creative Commons CC BY-SA 3.0|CC BY-SA 3.0") + " [[Unported]] [[License]]",
    "cc-by-nc-4.0": _named("Creative Commons Attribution-NonCommercial 4.0|Creative Commons CC BY-NC 4.0|CC BY-NC 4.0") + " [[International]] [[License]]",
    "cc-by-nd-4.0": _named("Creative Commons Attribution-NoDerivatives 4.0|Creative Commons CC BY-ND 4.0|CC BY-ND 4.0") + " [[International]] [[License]]",
    "cc-by-nc-sa-4.0": _named("Creative Commons Attribution-NonCommercial-ShareAlike 4.0|Creative Commons CC BY-NC-SA 4.0|CC BY-NC-SA 4.0") + " [[International]] [[License]]",
    "cc0-1.0": _named("Creative Commons Zero|CC0 1.0|CC0"),
    "copyright-notice": "copyright [[c]] {{holder:12}} all rights reserved",
} | {f"spdx:{x.lower()}": f"SPDX-License-Identifier: {x}" for x in sorted(IDENTIFIERS)}

#: A-Z to a-z; ASCII that is neither letter nor digit to a space.
FOLD = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
PART = re.compile(r"\[\[(?P<optional>.*?)\]\]|\{\{(?P<name>\w+)(?:(?::(?P<most>\d+))|(?:=(?P<ways>[^}]*)))?\}\}|(?P<word>\S+)")


@dataclass
class Automaton:
    """States with word edges, edges for any word, and free moves; `progress` counts mandatory words before a state."""

    words: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    any_word: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    progress: list[int] = field(default_factory=lambda: [0])
    final: int = 0
    openings: list[bytes] = field(default_factory=list)

    def state(self, progress: int) -> int:
        for kind, empty in ((self.words, {}), (self.any_word, []), (self.free, [])):
            kind.append(empty)
        self.progress.append(progress)
        return len(self.words) - 1

    def chain(self, at: int, words: list[bytes], counted: bool) -> int:
        for w in words:
            to = self.state(self.progress[at] + counted)
            self.words[at].setdefault(w, []).append(to)
            at = to
        return at

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def run(self, words: list[bytes], start: int) -> tuple[bool, float]:
        """Whether the template is accepted from word `start` on, and the share of its mandatory words that were met."""
        states, best = self.closed({0}), 0
        for w in words[start:]:
            after = {to for s in states for to in (*self.words[s].get(w, ()), *self.any_word[s])}
            if not after:
                break
            states = self.closed(after)
            best = max(best, *(self.progress[s] for s in states))
            if self.final in states:
                return True, 1.0
        return False, best / max(1, self.progress[self.final])


def folded(wording: str) -> list[bytes]:
    """Words as they stand in a scanned text: in lower case, without marks."""
    return wording.encode().translate(FOLD).split()


def compile_template(template: str) -> Automaton:
    """The automaton of a template; it has to open with a word or with one of several given wordings."""
    out, at, leading = Automaton(), 0, True
    opening: list[bytes] = []
    for part in PART.finditer(template):
        if part["word"]:
            words = folded(part["word"])
            if leading:
                opening += words
            at = out.chain(at, words, True)
            continue
        if part["optional"] is not None:
            begin = at
            for inner in PART.finditer(part["optional"]):
                at = out.chain(at, folded(inner["word"]), False) if inner["word"] else _region(out, at, inner)
            end = out.state(out.progress[begin])
            out.free[at].append(end)
            out.free[begin].append(end)
            at = end
        else:
            if at == 0:
                out.openings = [b" ".join(folded(x)) for x in part["ways"].split("|")]
            at = _region(out, at, part)
        leading = False
    out.final = at
    out.openings = out.openings or [b" ".join(opening[:4])]
    return out


def _region(out: Automaton, at: int, part: re.Match) -> int:
    """A region that stands for words of any kind, or for one of several wordings, whose words count as mandatory at the end."""
    if part["ways"] is not None:
        end = out.state(out.progress[at] + 1)
        for way in part["ways"].split("|"):
            out.free[out.chain(at, folded(way), False)].append(end)
        return end
    end = out.state(out.progress[at])
    out.free[at].append(end)
    for _ in range(int(part["most"] or 10)):
        to = out.state(out.progress[at])
        out.any_word[at].append(to)
        out.free[to].append(end)
        at = to
    return end


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word indices at which the phrase starts in a line of words with a space before and after each."""
    found, at, index, seen = [], line.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        index += line.count(b" ", seen, at)
        seen = at
        found.append(index)
        at = line.find(b" " + phrase + b" ", at + 1)
    return found


def scanner(phrases: dict[str, str], templates: dict[str, str]) -> Callable[[], Callable[[bytes], tuple]]:
    def scan() -> Callable[[bytes], tuple]:
        opened: dict[bytes, list[tuple[str, Automaton]]] = {}  # each opening is looked for once, however many templates have it
        for label, template in templates.items():
            automaton = compile_template(template)
            for opening in automaton.openings:
                opened.setdefault(opening, []).append((label, automaton))
        base = [(p.encode(), label) for p, label in phrases.items()]

        def one(text: bytes) -> tuple:
            words = text.translate(FOLD).split()
            line = b" ".join([b"", *words, b""])
            n, first, last, own, labels, score = 0, None, None, set(), set(), 0.0
            for phrase, label in base:
                if at := places(line, phrase):
                    n += len(at)
                    first, last = min(at[0], at[0] if first is None else first), max(at[-1], -1 if last is None else last)
                    own.add(label)
                    score = max(score, 0.5)
            for opening, automata in opened.items():
                for start in places(line, opening):
                    for label, automaton in automata:
                        if label not in labels:
                            accepted, share = automaton.run(words, start)
                            score = max(score, share if accepted else share / 2)
                            if accepted:
                                labels.add(label)
            return len(words), n, first, last, ",".join(sorted(own)), ",".join(sorted(own | labels)), score

        return one

    return scan


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels and score for each whole text.

    score: 1 where a template is accepted; else the larger of half the best share of a template's
    mandatory words met in their places, and 0.5 where a base phrase stands. A null text counts as
    empty: no words, no labels, score 0. Repeated rows get the same result, no rows give no rows.
    Input columns named as an added one are replaced.
    """
    return add_columns(docs, text, scanner(phrases or PHRASES, TEMPLATES if templates is None else templates), RESULT)
