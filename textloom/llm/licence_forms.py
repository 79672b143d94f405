"""The forms in which texts name licences: one-sentence notices, usual headers, and full texts.

A form has keys, terms that a match must hold all of: the words and version that tell its licence from
others. So a text without the first key of any form matches none, and CUE, made of these, loses nothing.
"""

from __future__ import annotations

from pathlib import Path

RESERVED = "All-Rights-Reserved"

# The notices by which files name these licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    RESERVED: "All rights reserved.",
}
_STYLE = ["license", "bsd", "style"]

#: Names in running text, with their keys; the first key is a cue.
NAMES = [
    ("MIT", "the MIT License", ["license", "mit"]),
    ("Apache-2.0", "the Apache License, Version 2.0", ["apache", "2.0"]),
    ("Apache-2.0", "the Apache 2.0 License", ["apache", "2.0"]),
    ("BSD-3-Clause", "the BSD 3-Clause License", ["bsd", "3", "clause"]),
    ("BSD-3-Clause", "the New BSD License", ["bsd", "new", "license"]),
    ("BSD-2-Clause", "the BSD 2-Clause License", ["bsd", "2", "clause"]),
    ("CC-BY-4.0", "CC BY 4.0", ["cc", "by", "4.0"]),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", ["creative", "commons", "attribution", "4.0"]),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", ["cc", "by", "nc", "4.0"]),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative", "commons", "attribution", "noncommercial", "4.0"]),
    ("CC0-1.0", "CC0 1.0 Universal", ["cc", "0", "1.0"]),
    ("GPL-2.0", "the GNU General Public License, version 2", ["gnu", "general", "public", "2"]),
    ("GPL-2.0", "the GNU GPL v2", ["gpl", "2"]),
    ("GPL-3.0", "the GNU General Public License, version 3", ["gnu", "general", "public", "3"]),
    ("GPL-3.0", "the GNU GPL v3", ["gpl", "3"]),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1", ["gnu", "lesser", "public", "2.1"]),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3", ["gnu", "lesser", "public", "3"]),
    ("MPL-2.0", "the Mozilla Public License, version 2.0", ["mozilla", "public", "2.0"]),
    ("MPL-2.0", "the Mozilla Public License, v. 2.0", ["mozilla", "public", "2.0"]),
]
_THINGS = ("document", "file", "library", "program", "project", "software", "work")
PHRASES = ["{}", "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under the terms of {}."]
PHRASES += [f"This {thing} is {verb} under {{}}." for thing in _THINGS for verb in ("licensed", "released", "distributed")]

_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
_COPY = " You should have received a copy of the GNU {}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MPL_REST = " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
HEADERS = [("Apache-2.0", _APACHE, ["apache", "2.0"]), ("Apache-2.0", _APACHE + _APACHE_REST, ["apache", "2.0"]), ("MPL-2.0", TEMPLATES["MPL-2.0"] + _MPL_REST, ["mozilla", "public", "2.0"])]
for _licence, _word, _version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3")):
    _keys = ["gnu", "public", _version, *_word.lower().split()]
    for _text in (_FREE.format(_word, _version), _FREE.format(_word, _version) + _NO_WARRANTY.format(_word), _FREE.format(_word, _version) + _NO_WARRANTY.format(_word) + _COPY.format(_word)):
        HEADERS.append((_licence, _text, _keys))

#: Keys of the full texts in licence_texts.
FULL_TEXTS = {
    "Apache-2.0": ["apache", "2.0"],
    "BSD-2-Clause": ["redistributions", "disclaimer"],
    "BSD-3-Clause": ["redistributions", "disclaimer", "endorse"],
    "CC0-1.0": ["waiver", "affirmer"],
    "GPL-2.0": ["gnu", "public", "2"],
    "GPL-3.0": ["gnu", "public", "3"],
    "LGPL-2.1": ["gnu", "lesser", "2.1"],
    "LGPL-3.0": ["gnu", "lesser", "3"],
    "MIT": ["sublicense", "noninfringement"],
    "MPL-2.0": ["mozilla", "2.0"],
}
_OWN_KEYS = {"BSD-3-Clause": _STYLE, RESERVED: ["reserved", "all", "rights"], **{name: next(k for n, _, k in NAMES if n == name) for name in TEMPLATES if name not in ("BSD-3-Clause", RESERVED)}}


def full_text(licence: str) -> str:
    return (Path(__file__).parent / "licence_texts" / f"{licence}.txt").read_text()


def forms() -> list[tuple[str, str, list[str]]]:
    """(licence, text, keys), no text twice."""
    out = [(name, text, _OWN_KEYS[name]) for name, text in TEMPLATES.items()]
    out += [(name, phrase.format(words), keys) for name, words, keys in NAMES for phrase in PHRASES]
    out += [(RESERVED, "Copyright. All rights reserved.", _OWN_KEYS[RESERVED])]
    out += HEADERS
    permission = full_text("MIT").split("\n\n")[1]
    out += [("MIT", permission, ["sublicense"]), *((name, full_text(name), keys) for name, keys in FULL_TEXTS.items())]
    return list({text: (name, text, keys) for name, text, keys in reversed(out)}.values())


#: SPDX identifiers, without -only and -or-later, in lower case.
SPDX = {name.lower(): name for name in [*TEMPLATES, *FULL_TEXTS] if name != RESERVED}
SPDX_LINE = r"(?i)SPDX-License-Identifier:\s*([^\n*]+)"

CUE = "(?i)(?<![a-z])(?:" + "|".join(sorted({keys[0].replace("license", "licen[sc]e") for _, _, keys in forms()} | {"licen[sc]e"})) + ")(?![a-z])"
