"""Licences that the scan knows: short ones as texts, long ones by their digests.

The texts are public and must be word for word; how lines break, copyright lines and titles don't matter.
"""

from __future__ import annotations

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
_MIT_WARRANTY = (
    _AS_IS + """THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
)
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:"""
_BSD_1 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""
_BSD_2 = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""


def _sections(*parts: str) -> str:
    return "\n\n".join(parts)


#: Whole licence texts, without titles and copyright lines; blank lines part their sections.
LICENSES = (
    (
        "MIT",
        _sections(
            _MIT_GRANT + ", subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            _MIT_WARRANTY,
        ),
    ),
    ("MIT-0", _sections(_MIT_GRANT + ".", _MIT_WARRANTY)),
    ("ISC", _sections(_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC_WARRANTY)),
    ("0BSD", _sections(_ISC_GRANT + ".", _ISC_WARRANTY)),
    (
        "Apache-2.0-header",
        _sections(
            """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at""",
            "http://www.apache.org/licenses/LICENSE-2.0",
            """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
        ),
    ),
    ("BSD-1-Clause", _sections(_BSD_HEAD, _BSD_1, _BSD_WARRANTY)),
    ("BSD-2-Clause", _sections(_BSD_HEAD, _BSD_1, _BSD_2, _BSD_WARRANTY)),
    ("BSD-3-Clause", _sections(_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY)),
    (
        "Unlicense",
        _sections(
            "This is free and unencumbered software released into the public domain.",
            """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
            """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.""",
            """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
            "For more information, please refer to <https://unlicense.org>",
        ),
    ),
    (
        "Zlib",
        _sections(
            """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.""",
            """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:""",
            """1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required.""",
            "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
            "3. This notice may not be removed or altered from any source distribution.",
        ),
    ),
    (
        "BSL-1.0",
        _sections(
            """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:""",
            """The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor.""",
            _AS_IS + """THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
        ),
    ),
    (
        "WTFPL",
        _sections(
            "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
            "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
            "0. You just DO WHAT THE FUCK YOU WANT TO.",
        ),
    ),
    (
        "PostgreSQL",
        _sections(
            """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee,
and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the
following two paragraphs appear in all copies.""",
            """IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL,
OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE
UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
            """THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND
THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
        ),
    ),
    (
        "FSFAP",
        """Copying and distribution of this file, with or without modification, are permitted in any medium without royalty
provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.""",
    ),
    (
        "curl",
        _sections(
            """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
            _AS_IS + """THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
            """Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise
to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.""",
        ),
    ),
    (
        "NTP",
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without
fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice and
this permission notice appear in supporting documentation, and that the name of the copyright holder not be used in advertising
or publicity pertaining to distribution of the software without specific, written prior permission. The copyright holder makes
no representations about the suitability this software for any purpose. It is provided "as is" without express or implied
warranty.""",
    ),
)

#: One-line notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)

#: Canonical lines that only give the name of a licence above its text.
TITLES = (
    "mit license",
    "the mit license",
    "the mit license mit",
    "mit no attribution",
    "isc license",
    "the isc license",
    "bsd 1 clause license",
    "bsd 2 clause license",
    "the 2 clause bsd license",
    "simplified bsd license",
    "bsd 3 clause license",
    "the 3 clause bsd license",
    "new bsd license",
    "bsd zero clause license",
    "the unlicense",
    "zlib license",
    "the zlib license",
    "the zlib libpng license",
    "boost software license version 1 0 august 17th 2003",
    "postgresql license",
    "the postgresql license",
)

#: (license_id, digest of the whole text, sections, digest of their sequence) of long licences; see licenses.describe.
DIGESTS: tuple[tuple[str, str, int, str], ...] = (
    ("Apache-2.0", "1c902a428939944ca881b724122529d5b423ece7fa6ce5708f4158425c0493b8", 32, "e63ac1ddd97c53c88d08968da1ef5321035690f8100f9f5f008f71a6f8680f27"),
    ("Artistic-1.0-Perl", "065afd054b7b3891100d80895d113a7c684cbc25122fa1c526244c852fe5a9ba", 29, "dc9968ec07261d6d0792f61831d1b62256cd7ef03adf488dfb3037c9c762ccc9"),
    ("BSD-3-Clause", "e8daa50c96df2ade9d116da144a66a3e46944a78c9ae7c49064074817a5d8988", 2, "ced06aab2160bcde0d0da118c0f2b0c43c5f1efd4c9eae38906cc51c964ff630"),
    ("CC0-1.0", "657a3d6f0aa604ea579e4db7326bc8ab4b3efd50c78123e21702a38dc6ffdaf1", 13, "9b4b0ed9bb7038c57d04b81b91bda6d09a5c42fc20bf4a4ac206132fd8609463"),
    ("GFDL-1.2", "7edf5e4e430fc5f52208d6ba916d124389666952f888bc7736cabd5cfcfcf71b", 57, "526710b13ff1f50e66dfd4f060c0132cf80c47eedf6fbd726360022ac396584d"),
    ("GFDL-1.3", "9da1a506366904594b2148297a3aacf6a10287c0bbf100504c6de910a14c3e39", 67, "328cda6b2f9e337a5ae77db08f2045edf90987a2afa4cd83823c6e6ae606b620"),
    ("GPL-1.0", "938beb16f8ebc4509ef2f1fbc862672c539d6cb6e373b5c4c9e1202b739ed740", 50, "967ef9dbb9ac4964bb70177be67ab8ec709d5b7c0b23902d72fa6a3af79d8c28"),
    ("GPL-2.0", "4e17c4ebaefa1ccad8f18d0681c18884508b4642be6f5621d8017ab65b99c7fb", 59, "efc8bb8badc381d8f30495b9f82a0a524e71f576191d0342c2c2924a326e649a"),
    ("GPL-3.0", "3b51ffc354894b75c1e74865c08cc73e2e37b62c2ff9a29a0b63eb889d5a3b4b", 122, "0f850a141c9eefb52e63a68a00304a29358bcadde238c2ab3ed4102d881a63ad"),
    ("LGPL-2.0", "fe4137135186f54987531d2889b286014e6628f86033fce3b12db2a979d0d813", 83, "b8759333df2a34c8979e7e21c4bf9c580c7fa0f015c38f43810de0c8e8ff175c"),
    ("LGPL-2.1", "eff97d5cecec1566811399644ac3211023c9ccd006c1d469daf18311199076b1", 85, "cc8c41e3703998252aa1ef88c302be6f7a973282821341d74b13035caf9b5d6f"),
    ("LGPL-3.0", "9111884d93a72b30a3d024876dab3d755949ac2cfab230268a4169a93b86560c", 37, "dc097b058a38d57df0e2efb610967789dec734436f8909f726219c55e58d3914"),
    ("MPL-1.1", "25774c732de388792e0be8cd3fbde1fc81a5914264f09ba353b6a548f31d5120", 73, "412d5f039aac89eaeb014f499cedf2fcdce645bde7d6eb618122a3ad5ac1ce02"),
    ("MPL-2.0", "a838501fc762b293b14797434f9dc1dd6b03fb613d6bd4142d9c086a14f27863", 83, "c3b4221e3b4db38f723edfc2e3f954e33619b83f6632ed0f03bf1f2a1e912e6f"),
)
