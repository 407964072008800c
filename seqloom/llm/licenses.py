"""License scans by sentence rules.

A text is normalised, with its lines kept apart, and the sentences that begin at a line or after a closing mark are
looked up among the known license sentences; the sequence of identifiers is then matched against ordered rules, the
longer before the shorter, each match taking its sentences.

Known are sentences of licenses themselves, and references: any sentence that says of something that it is licensed
(released, distributed, ...) under a license of a known name, and lines that are such a name alone.  Sentences may be
wrapped over lines and stand behind comment marks.  Work is linear in a text.

Defined results: null, empty and license-free texts give no row; a sentence that speaks of licenses without being known
makes an UNKNOWN row; repeated rows give their rows again; an empty table gives an empty result; other columns are
ignored.  A name that a sentence leaves open (a holder, a product) has up to 300 characters and no closing mark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import whole_text

LIC = "licen[sc]e"
# fixed values: names of licenses in references, as regular expressions over normalised text
NAMES = {
    "apache2-ref": ("Apache-2.0", rf"apache(?: software)? {LIC},? ?(?:version|v\.?)? ?2(?:\.0)?|apache[- ]2(?:\.0)?(?: {LIC})?"),
    "apache1-ref": ("Apache-1.1", rf"apache(?: software)? {LIC},? ?(?:version|v\.?)? ?1\.1"),
    "mit-ref": ("MIT", rf"(?:mit|expat) {LIC}(?: \(mit\))?|mit(?! [a-z])"),
    "bsd3-ref": ("BSD-3-Clause", rf"(?:new|revised|modified|3-clause|three-clause) bsd {LIC}|bsd[- ]3[- ]clause(?: {LIC})?"),
    "bsd2-ref": ("BSD-2-Clause", rf"(?:simplified|free|2-clause|two-clause) ?bsd {LIC}|bsd[- ]2[- ]clause(?: {LIC})?"),
    "bsd-ref": ("BSD", rf"bsd(?:-style)? {LIC}"),
    "isc-ref": ("ISC", rf"isc {LIC}"),
    "mpl2-name": ("MPL-2.0", rf"mozilla public {LIC},? ?(?:version|v\.?)? ?2\.0|mpl[- ]?2\.0"),
    "mpl1-name": ("MPL-1.1", rf"mozilla public {LIC},? ?(?:version|v\.?)? ?1\.1|mpl[- ]?1\.1"),
    "epl2-ref": ("EPL-2.0", rf"eclipse public {LIC},? ?(?:-|version|v\.?)? ?2\.0|epl[- ]?2\.0"),
    "epl1-ref": ("EPL-1.0", rf"eclipse public {LIC},? ?(?:-|version|v\.?)? ?1\.0|epl[- ]?1\.0"),
    "cddl-ref": ("CDDL-1.0", rf"common development and distribution {LIC}(?: \(cddl\))?(?:,? (?:version|v\.?)? ?1\.0)?"),
    "eupl-ref": ("EUPL-1.2", rf"european union public {LIC},? ?(?:version|v\.?)? ?1\.2|eupl[- ]?1\.2"),
    "boost-ref": ("BSL-1.0", rf"boost software {LIC},? ?-? ?(?:version|v\.?)? ?1\.0"),
    "zlib-ref": ("Zlib", rf"zlib(?:/libpng)? {LIC}"),
    "artistic2-ref": ("Artistic-2.0", rf"artistic {LIC},? ?(?:version|v\.?)? ?2\.0"),
    "unlicense-ref": ("Unlicense", r"unlicense"),
    "wtfpl-ref": ("WTFPL", r"wtfpl|do what the fuck you want to public license"),
    "postgresql-ref": ("PostgreSQL", rf"postgresql {LIC}"),
    "python-ref": ("PSF-2.0", rf"python software foundation {LIC}(?:,? (?:version|v\.?)? ?2)?|psf {LIC}"),
    "ofl-ref": ("OFL-1.1", rf"sil open font {LIC},? ?(?:version|v\.?)? ?1\.1"),
    "odbl-ref": ("ODbL-1.0", rf"open (?:data commons open )?database {LIC}(?: \(odbl\))?(?: v?1\.0)?"),
    "mspl-ref": ("MS-PL", rf"microsoft public {LIC}(?: \(ms-pl\))?"),
    "afl-ref": ("AFL-3.0", rf"academic free {LIC},? ?(?:version|v\.?)? ?3\.0"),
    "gfdl-ref": ("GFDL-1.3", rf"gnu free documentation {LIC},? ?(?:version|v\.?)? ?1\.3"),
    "cc0-name": ("CC0-1.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons (?:zero|cc0)(?: v?1\.0)?(?: universal)?"),
}
# a rule: the families of the GNU licenses by version, and of the Creative Commons licenses by terms and version
FAMILIES = {"AGPL": rf"(?:gnu )?affero general public {LIC}|(?:gnu )?agpl", "LGPL": rf"(?:gnu )?(?:lesser|library) general public {LIC}|(?:gnu )?lgpl", "GPL": rf"(?:gnu )?general public {LIC}|(?:gnu )?gpl"}
VERSIONS = {"AGPL": ("3",), "LGPL": ("3", "2.1", "2"), "GPL": ("3", "2", "1")}
LATER = r"(?:(?: of the licen[sc]e)?,? (?:or|and)(?:,? ?\(?at your option\)?,?)? (?:any )?(?:later|newer)(?: versions?)?|\+)"
TERMS = {"BY": "", "BY-SA": "[- ]sharealike", "BY-ND": "[- ]noderiv(?:ative)?s?", "BY-NC": "[- ]noncommercial", "BY-NC-SA": "[- ]noncommercial[- ]sharealike", "BY-NC-ND": "[- ]noncommercial[- ]noderiv(?:ative)?s?"}


def _families() -> Iterator[tuple[str, str, str]]:
    """(identifier, license, pattern) of the names that follow the rule."""
    for family, name in FAMILIES.items():
        for v in VERSIONS[family]:
            full, own = (v if "." in v else f"{v}.0"), f"{family.lower()}{v.replace('.', '')}"
            base = rf"(?:{name})(?: \([a-z]{{3,4}}\))?(?: as published by the free software foundation)?,? ?(?:either )?(?:version|v\.?)?[- ]?{re.escape(v)}(?:\.0)?(?!\.?\d)"
            yield f"{own}-later-ref", f"{family}-{full}-or-later", base + LATER
            yield f"{own}-only-ref", f"{family}-{full}-only", rf"{base}(?: of the {LIC})?,? only"
            yield f"{own}-ref", f"{family}-{full}", base
    for terms, long in sorted(TERMS.items(), key=lambda t: -len(t[0])):
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            name = rf"cc[- ]{terms.lower().replace('-', '[- ]')}(?:[- ]|,? v(?:ersion )?)?{re.escape(v)}|creative commons attribution{long} {re.escape(v)}(?: international| unported| generic)?(?: public)?(?: {LIC})?"
            yield f"cc{terms.replace('-', '').lower()}{v.removesuffix('.0').replace('.', '')}-ref", f"CC-{terms}-{v}", name


NAMES |= {own: (license_, pattern) for own, license_, pattern in _families()}

# fixed values: sentences of the licenses, as published, normalised; "..." is a name left open, at the end the rest of
# the sentence
SENTENCES = {
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": r"you may obtain a copy of the license at(?: https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?)?",
    "apache2-warranty": "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction, ...",
    "mit-notice": "the above copyright notice and this permission notice(?: \\(including the next paragraph\\))? shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is, without warranty of any kind, express or implied, ...",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, ...",
    "boost-grant": r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license \(the software\) to use, reproduce, display, distribute, ...",
    "gpl-hope": "(?:this|the) ... is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc0-ref": "to the extent possible under law, ... has waived all copyright and related or neighboring rights to ...",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": r"(?:\W?[1a][.)] )?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": r"(?:\W?[2b][.)] )?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": r"(?:\W?[3c][.)] )?neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advert": r"(?:\W?3[.)] )?all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment",
    "bsd-warranty": "this software is provided by ... as is and any express or implied warranties, ...",
    "bsd-liability": "in no event shall ... be liable for any direct, indirect, incidental, special, exemplary, or consequential damages ...",
    "isc-grant": "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and ... disclaims all warranties with regard to this software ...",
    "zlib-warranty": "this software is provided as-is, without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": r"(?:1\. )?the origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": r"(?:2\. )?altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": r"(?:3\. )?this notice may not be removed or altered from any source distribution",
    "mpl2-ref": rf"this source code form is subject to the terms of the mozilla public license, v\. 2\.0",
    "mpl2-copy": r"if a copy of the mpl was not distributed with this file, you can obtain one at https?://(?:www\.)?mozilla\.org/mpl/2\.0/?",
    "mpl1-ref": r"the contents of this file are subject to the mozilla public license version 1\.1 ...",
    "epl-made": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\.? ?)?1\.0 ...",
    "epl2-made": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\.? ?)?2\.0 ...",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, ...",
    "python-grant": "psf hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, ...",
    "public-domain": "(?:this|the) ... (?:is|are)(?: hereby)? (?:in|placed in|placed into|dedicated to|released into|released to) the public domain",
    "spdx": r"spdx-license-identifier: ?(?P<spdx>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)",
    "all-rights": r"(?:copyright (?:\(c\) )?... )?all rights reserved",
}


def _notices() -> Iterator[tuple[str, str]]:
    """The free software notices of the GNU families, by family and version; three have names of their own."""
    names = {"GPL": "gnu general public license", "LGPL": "gnu (?:lesser|library) general public license", "AGPL": "gnu affero general public license"}
    for family, name in names.items():
        for v in VERSIONS[family]:
            own = f"{family.lower()}{v.replace('.', '')}"
            start = rf"(?:this|the) ... is free software[:;] you can redistribute it and/or modify it under the terms of the {name}"
            yield {"gpl3": "gpl-free"}.get(own, f"{own}-free"), rf"{start},? as published by the free software foundation[,;:] either version {re.escape(v)}(?:\.0)? of the license, or \(at your option\) any later version"
            yield f"{own}-only", rf"{start},? (?:version {re.escape(v)}(?:\.0)?,? )?as published by the free software foundation(?:[,;:] version {re.escape(v)}(?:\.0)? of the license)?"
        yield {"GPL": "gpl-see"}.get(family, f"{family.lower()}-see"), rf"see the {name} for more details"
        yield f"{family.lower()}-copy", rf"you should have received a copy of the {name} along with (?:this|the) ..."


SENTENCES |= dict(_notices())

# fixed values: ordered rules; a license and its sentences in order, "?" marks one that may be missing
RULES = [
    ("Apache-2.0", "apache2-ref apache2-use apache2-copy? apache2-warranty? apache2-see?"),
    ("MIT", "mit-ref? mit-grant mit-notice? mit-warranty? mit-liability?"),
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse? bsd-warranty? bsd-liability?"),
    ("BSD-3-Clause", "bsd3-ref? bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty? bsd-liability?"),
    ("BSD-2-Clause", "bsd2-ref? bsd-grant bsd-source bsd-binary bsd-warranty? bsd-liability?"),
    ("Zlib", "zlib-ref? zlib-warranty zlib-liability? zlib-grant? zlib-origin? zlib-altered? zlib-notice?"),
    ("ISC", "isc-ref? isc-grant isc-warranty? bsd-liability?"),
    ("BSL-1.0", "boost-ref? boost-grant"),
    ("Unlicense", "unlicense unlicense-anyone?"),
    ("CC0-1.0", "cc0-ref"),
    ("MPL-2.0", "mpl2-ref mpl2-copy?"),
    ("MPL-1.1", "mpl1-ref"),
    ("EPL-2.0", "epl2-made"),
    ("EPL-1.0", "epl-made"),
    ("PSF-2.0", "python-grant"),
]
for _family in ("AGPL", "LGPL", "GPL"):
    _f = _family.lower()
    for _v in VERSIONS[_family]:
        _id, _full = f"{_f}{_v.replace('.', '')}", (_v if "." in _v else f"{_v}.0")
        RULES.append((f"{_family}-{_full}-or-later", f"{ {'gpl3': 'gpl'}.get(_id, _id) }-free gpl-hope? {_f}-see? {_f}-copy?"))
        RULES.append((f"{_family}-{_full}-only", f"{_id}-only gpl-hope? {_f}-see? {_f}-copy?"))
RULES += [(license_, own) for own, (license_, _) in NAMES.items()]
RULES += [("public-domain", "public-domain"), ("all-rights-reserved", "all-rights")]


#: White space, and what stands for it: comment marks and quotes.
_BLANK = re.compile(r"(?:\s|[\"'`*#“”‘’]|//|/\*|\*/|<!--|-->)+")


class Words:
    """Looks for any of some words, or of some phrases whose telling word is given, in any case and however wrapped."""

    def __init__(self, words: str, phrases: dict[str, str]) -> None:
        self.words = words.split()
        self.phrases = {w: re.compile(p.replace(" ", _BLANK.pattern)) for w, p in phrases.items()}

    def search(self, text: str) -> bool:
        text = text.lower()
        return any(w in text for w in self.words) or any(w in text and p.search(text) for w, p in self.phrases.items())


#: Every known sentence, every name and every sentence that speaks of licenses holds one of these.
SPEAKS = Words(
    "license licence copyright warrant redistribut permission liable governing misrepresented bsd gpl eupl apache cc-by cc0 wtfpl mozilla",
    {
        "domain": "public domain", "rights": "all rights|neighboring rights", "advertising": "advertising materials", "plainly": "plainly marked", "altered": "altered from any source", "anyone": "anyone is free",
        "psf": "psf hereby", "obtain": "you may obtain", "mit": "(?:under|by|of)(?: the| a| an)? (?:mit|expat)", "cc": "cc by", "commons": "creative commons", "mpl": "mpl-?[12]|mpl [12]", "epl": "epl-?[12]|epl [12]",
    },
)
_OTHER = re.compile(r"licen[sc]ed?[ \n]|copyright|permission[ \n]is")
_LOWER = {c: c + 32 for c in range(65, 91)}
_START = re.compile(r"\n|[.!?:;]+[)\]]*(?=[ \n])[ \n]")
_END = re.compile(r"[.!?:;,)\]-]*(?=\n|$)|[.!?:;]+[)\]]*(?=[ \n])")


def _blanks(pattern: str) -> str:
    """The pattern with a line's end wherever it has a space."""
    return re.sub(r"\\.|\[[^\]]*\]| ", lambda m: "[ \n]" if m[0] == " " else m[0].replace(" ", " \n") if m[0][0] == "[" else m[0], pattern)


def _pattern(text: str) -> str:
    """A sentence as a regular expression in which any blank may be a line's end."""
    open_end = text.endswith("...")
    body = text.removesuffix("...").rstrip() if open_end else text
    body = _blanks(body).replace("...", r"(?:(?![.!?:;][ \n]).){1,300}?")
    return body + ("" if open_end else r"(?=[.!?:;,)\]-]*(?:\n|$)|[.!?:;]+[)\]]*[ \n])")


_NAMES, _TEXTS = list(NAMES), list(SENTENCES)
_KNOWN = re.compile("|".join(f"(?P<s{i}>{_pattern(SENTENCES[n])})" for i, n in sorted(enumerate(_TEXTS), key=lambda x: -len(SENTENCES[x[1]]))), re.S)
_ANY_NAME = "|".join(f"(?P<n{i}>{_blanks(NAMES[n][1])})" for i, n in enumerate(_NAMES))
_REFERENCE = re.compile(
    rf"\b(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|covered|governed|offered|shared)[ \n](?:under|by)(?:[ \n](?:the|a|an))?(?:[ \n]terms(?:[ \n]and[ \n]conditions)?[ \n]of(?:[ \n](?:the|a|an))?)?[ \n](?:{_ANY_NAME})(?![a-z0-9])"
)
_TITLE = re.compile(rf"(?:the[ \n])?(?:{_ANY_NAME})(?:[ \n]?[.!?:;,)\]-]*(?:\n|$))")


class Normal:
    """A text in ASCII lower case with each run of blanks, quotes and comment marks made one space, or a line feed if it
    holds one; and the way back to the text's places."""

    def __init__(self, raw: str) -> None:
        out, self.here, self.there, at, n = [], [0], [0], 0, 0
        for m in _BLANK.finditer(raw):
            out.append(raw[at : m.start()])
            n += m.start() - at
            inner = raw[at : m.start()].endswith("(") or raw[m.end() : m.end() + 1] in (",", ")")  # (the "Software"),
            blank = "" if not n else "\n" if "\n" in m[0] else "" if inner else " "
            out.append(blank)
            n += len(blank)
            at = m.end()
            self.here.append(n)
            self.there.append(at)
        out.append(raw[at:])
        self.text = "".join(out).translate(_LOWER)

    def place(self, i: int) -> int:
        """The place in the text of the symbol at i."""
        k = bisect_right(self.here, i) - 1
        return self.there[k] + i - self.here[k]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.place(a), self.place(b - 1) + 1


def sentence_ids(raw: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences in order, and of those that are not known, as UNKNOWN."""
    normal = Normal(raw)
    text = normal.text
    starts = sorted({0, *(m.end() for m in _START.finditer(text))})
    found: list[tuple[int, int, str]] = []
    done = 0
    for at in starts:
        if at < done or at >= len(text):
            continue
        m = _KNOWN.match(text, at)
        name = m and _TEXTS[int(next(k for k, v in m.groupdict().items() if v is not None and k[1:].isdigit())[1:])]
        if not m and (m := _TITLE.match(text, at)):  # a bare word is no title
            name = _NAMES[int(m.lastgroup[1:])]
            m = m if re.search(r"licen|\d|wtfpl", m[0]) else None
        if m:
            end = _END.search(text, m.end())
            done = end.end() if SENTENCES.get(name, "").endswith("...") or end.start() == m.end() else m.end()
            done = max(done, at + len(text[at:done].rstrip()))
            found.append((at, at + len(text[at:done].rstrip()), f"spdx:{m['spdx']}" if name == "spdx" else name))
    # references stand anywhere in a sentence; those within a known sentence are its own
    taken, others = [f[0] for f in found], []
    for m in _REFERENCE.finditer(text):
        a = starts[bisect_right(starts, m.start()) - 1]
        end = _END.search(text, m.end()).end()
        k = bisect_right(taken, m.start()) - 1
        if k >= 0 and found[k][1] > m.start() or others and others[-1][1] > m.start():
            continue
        a = max([a, *(x[k][1] for x, k in ((found, k), (others, len(others) - 1)) if 0 <= k)])
        a += len(text[a:end]) - len(text[a:end].lstrip())
        others.append((a, end, _NAMES[int(m.lastgroup[1:])]))
    found = sorted(found + others)
    # what speaks of licenses and is in none of them
    taken = [f[0] for f in found]
    unknown = []
    for at, end in zip(starts, [*starts[1:], len(text)], strict=True):
        k = bisect_right(taken, at) - 1
        if (k < 0 or found[k][1] <= at) and (k + 1 >= len(found) or found[k + 1][0] >= end) and _OTHER.search(text, at, end):
            unknown.append((at, at + len(text[at:end].rstrip()), "UNKNOWN"))
    return [(*normal.span(a, b), name) for a, b, name in sorted(found + unknown) if a < b]


def match_rules(found: list[tuple[int, int, str]]) -> list[tuple[str, str, int, int]]:
    """(license, sentence identifiers, start, end): ordered rules over the sequence; what none takes is reported as it is."""
    out, free = [], list(found)
    for license_, said in RULES:
        steps = said.split()
        needed = {s for s in steps if not s.endswith("?")}
        if not needed <= {f[2] for f in free}:
            continue
        i, left = 0, []
        while i < len(free):
            j, taken = i, []
            for step in steps:
                if j < len(free) and free[j][2] == step.rstrip("?"):
                    taken.append(free[j])
                    j += 1
                elif not step.endswith("?"):
                    taken = []
                    break
            if taken:
                out.append((license_, ",".join(t[2] for t in taken), taken[0][0], taken[-1][1]))
                i = j
            else:
                left.append(free[i])
                i += 1
        free = left
    for a, b, name in free:
        out.append((name[5:] if name.startswith("spdx:") else "UNKNOWN", name, a, b))
    return sorted(out, key=lambda r: (r[2], r[3], r[0]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, sentences, start, end (code points): a row for each license that a document states."""
    names = ["doc_id", "license", "sentences", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if SPEAKS.search(text):
                    rows += [(doc, *r) for r in match_rules(sentence_ids(text))]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, license string, sentences string, start long, end long")
