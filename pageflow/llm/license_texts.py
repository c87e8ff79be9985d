"""Whole notices and whole short licences, as templates of the licence scan.

A name may have several wordings, told apart by what follows a '#', which is not reported. Licences that share most of
their words are all here, so that a text is reported as the one it is and not as its neighbour. Long licences are found
by the notices that they ask to be put on a work.
"""

from __future__ import annotations

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_4 = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache": "Released under the Apache License.",
    "BSD": "Released under the BSD License.",
    "GPL": "Released under the GPL License.",
    "ISC-short": "Released under the ISC License.",
    "MIT": "Released under the MIT License.",
    "MPL": "Released under the MPL License.",
    "MIT-text": _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS.format("AUTHORS OR COPYRIGHT HOLDERS"),
    "MIT-0-text": _MIT + ". " + _AS_IS.format("AUTHORS OR COPYRIGHT HOLDERS"),
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END,
    "0BSD": _ISC + "." + _ISC_END,
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.format("AUTHORS") + " For more information, please refer to https://unlicense.org",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
}

# With and without a third (and fourth) condition, under both wordings of who disclaims.
for _n, (_who, _name) in enumerate((("COPYRIGHT HOLDERS AND CONTRIBUTORS", "copyright holder"), ("REGENTS AND CONTRIBUTORS", "University"))):
    _end = _BSD_END.format(_who, "COPYRIGHT HOLDER OR CONTRIBUTORS" if not _n else "REGENTS OR CONTRIBUTORS")
    TEMPLATES[f"BSD-2-Clause#{_n}"] = _BSD + _BSD_1 + _BSD_2 + _end
    TEMPLATES[f"BSD-3-Clause#{_n}"] = _BSD + _BSD_1 + _BSD_2 + _BSD_3.format(_name) + _end
    TEMPLATES[f"BSD-4-Clause#{_n}"] = _BSD + _BSD_1 + _BSD_2 + _BSD_4 + _BSD_3.format(_name) + _end

for _n, _kind in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    TEMPLATES[f"CC-{_n}-4.0" + ("#statement" if _n == "BY-NC" else "")] = f"This work is licensed under a Creative Commons {_kind} 4.0 International License."
    TEMPLATES[f"CC-{_n}-4.0" + ("" if _n == "BY-NC" else "#short")] = f"Licensed under CC {_n} 4.0."

# Work: the short line. Statement: the first paragraph of the notice. Header: the whole notice, with either ending.
for _n, _kind, _v in (("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Library ", "2"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3")):
    _id, _full = f"{_n}-{_v}" + ("" if "." in _v else ".0"), f"GNU {_kind}General Public License"
    TEMPLATES[_id] = f"This work is licensed under the {_full}, version {_v}."
    for _what in ("program", "library"):
        _say = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the {_full} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
        _more = f" This {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_full} for more details. You should have received a copy of the {_full} along with this {_what}"
        TEMPLATES[f"{_id}-statement#{_what}"] = _say
        TEMPLATES[f"{_id}-header#{_what}-url"] = _say + _more + ". If not, see <https://www.gnu.org/licenses/>."
        TEMPLATES[f"{_id}-header#{_what}-address"] = _say + _more + "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
