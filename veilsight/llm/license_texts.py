"""Wordings of public licences and their usual notices, as templates.

Fixed values: the words are those of the licences. Punctuation and case don't count. ``[ ... ]`` may be
absent, ``{n}`` stands for any words, ``n`` at most: the places where a licence lets names, years and titles
differ. Each entry is a label, how much a match says (0 to 1), and the template.
"""

_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {6} BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice [(including the next paragraph)] shall be included in all
copies or substantial portions of the Software.
"""

_BSD_GRANT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: [1.] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [2.]
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""

_BSD_NAMES = """
[3.] Neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
"""

_BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {12} BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.
"""

_GNU_NOTICE = """
is free software[:] you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation[,] [either] version {2} [of the License] [, or (at your option) any later version]. {12} is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
"""

#: Whole licences.
FULL = (
    ("mit", 1.0, _MIT_GRANT + _AS_IS),
    ("mit", 0.9, _MIT_GRANT),
    ("bsd-2-clause", 1.0, _BSD_GRANT + _BSD_AS_IS),
    ("bsd-3-clause", 1.0, _BSD_GRANT + _BSD_NAMES + _BSD_AS_IS),
    (
        "isc", 1.0,
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND {8} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL {8} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib", 1.0,
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: [1.] The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. [2.] Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. [3.] This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "bsl-1.0", 1.0,
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
        such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    (
        "unlicense", 1.0,
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law.""",
    ),
    (
        "wtfpl", 1.0,
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as
        the name is changed. {12} TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION [0.] You just DO WHAT THE {2} YOU WANT TO.""",
    ),
)

#: Notices that whole licences ask for.
NOTICES = (
    (
        "apache-2.0", 1.0,
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {4} except in compliance with the License. You may obtain
        a copy of the License at [https] [http] [www] apache org licenses LICENSE 2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("gpl", 1.0, _GNU_NOTICE.replace("{kind}", "")),
    ("lgpl", 1.0, _GNU_NOTICE.replace("{kind}", "Lesser ")),
    ("agpl", 1.0, _GNU_NOTICE.replace("{kind}", "Affero ")),
    (
        "mpl-2.0", 1.0,
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at [https] [http] mozilla org MPL 2.0.""",
    ),
    (
        "cc0", 1.0,
        """To the extent possible under law, {12} has waived all copyright and related or neighboring rights to {12}. [This work is published from
        {6}]""",
    ),
)

#: Short forms.
SHORT = (
    ("mit", 0.8, "released under [the terms of] the MIT license"),
    ("mit", 0.8, "licensed under [the terms of] the MIT license"),
    ("apache-2.0", 0.9, "licensed under the Apache License version 2.0 [the License]"),
    ("apache-2.0", 0.9, "you may not use this {3} except in compliance with the license"),
    ("gpl", 0.8, "licensed under [the terms of] the GNU [Lesser] [Affero] General Public License [version {2}]"),
    ("gpl-2.0", 0.9, "GNU General Public License version 2"),
    ("gpl-3.0", 0.9, "GNU General Public License version 3"),
    ("lgpl", 0.9, "GNU Lesser General Public License"),
    ("agpl", 0.9, "GNU Affero General Public License"),
    ("bsd", 0.9, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", 0.9, "subject to the terms of the Mozilla Public License v. 2.0"),
    ("cc0", 0.9, "dedicated to the public domain [under {6} CC0 [1.0]]"),
    ("cc-by", 0.8, "licensed under [a] [the] CC BY [{1} 0]"),
    ("cc-by-nc", 0.9, "licensed under [a] [the] CC BY-NC"),
    ("cc-by-sa", 0.9, "licensed under [a] [the] CC BY-SA"),
    ("cc-by-nd", 0.9, "licensed under [a] [the] CC BY-ND"),
    ("cc", 0.8, "licensed under a Creative Commons {8} license"),
    ("all-rights-reserved", 0.7, "all rights reserved"),
    ("proprietary", 0.9, "may not be reproduced {12} without [the] [prior] written permission"),
)

TEMPLATES = (*FULL, *NOTICES, *SHORT)
