"""Public licence names and notices, as text. The rules of the scan are made from them in licenses.py."""

#: SPDX name: names in prose; "licensed under the <name>" and the like is a notice of its own.
NAMES = {
    "0BSD": "Zero-Clause BSD License; 0BSD license; BSD Zero Clause License",
    "AFL-3.0": "Academic Free License version 3.0; Academic Free License 3.0",
    "AGPL-3.0": "GNU Affero General Public License, version 3; GNU AGPL v3; AGPLv3; GNU Affero General Public License v3.0",
    "Apache-2.0": "Apache License, Version 2.0; Apache License 2.0; Apache 2.0 license; Apache-2.0 license",
    "Artistic-2.0": "Artistic License 2.0; Artistic License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License; Simplified BSD License; FreeBSD License",
    "BSD-3-Clause": "BSD 3-Clause License; New BSD License; Modified BSD License; 3-clause BSD license",
    "BSL-1.0": "Boost Software License, Version 1.0; Boost Software License 1.0",
    "CC-BY-3.0": "CC BY 3.0; Creative Commons Attribution 3.0 Unported License; Creative Commons Attribution 3.0 License",
    "CC-BY-4.0": "CC BY 4.0; Creative Commons Attribution 4.0 International License; Creative Commons Attribution 4.0 License",
    "CC-BY-NC-4.0": "CC BY-NC 4.0; Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0; Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0; Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "CC BY-ND 4.0; Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-3.0": "CC BY-SA 3.0; Creative Commons Attribution-ShareAlike 3.0 Unported License; Creative Commons Attribution-ShareAlike 3.0 License",
    "CC-BY-SA-4.0": "CC BY-SA 4.0; Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "CC0 1.0; CC0 1.0 Universal license; Creative Commons Zero v1.0 Universal license; Creative Commons CC0 1.0 Universal Public Domain Dedication; CC0 license",
    "CDDL-1.0": "Common Development and Distribution License 1.0; Common Development and Distribution License (CDDL) Version 1.0",
    "CECILL-2.1": "CeCILL license version 2.1; CeCILL Free Software License Agreement v2.1",
    "CPL-1.0": "Common Public License Version 1.0; Common Public License 1.0",
    "ECL-2.0": "Educational Community License, Version 2.0; Educational Community License 2.0",
    "EPL-1.0": "Eclipse Public License v1.0; Eclipse Public License 1.0",
    "EPL-2.0": "Eclipse Public License v2.0; Eclipse Public License 2.0; Eclipse Public License v. 2.0",
    "EUPL-1.2": "European Union Public Licence v1.2; EUPL version 1.2; EUPL v1.2; European Union Public License 1.2",
    "GFDL-1.3": "GNU Free Documentation License, Version 1.3; GNU Free Documentation License 1.3",
    "GPL-2.0": "GNU General Public License, version 2; GNU General Public License v2.0; GNU GPL version 2; GNU GPL v2; GPLv2; GPL v2 license",
    "GPL-3.0": "GNU General Public License, version 3; GNU General Public License v3.0; GNU GPL version 3; GNU GPL v3; GPLv3; GPL v3 license",
    "ISC": "ISC License; ISC licence",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1; GNU Lesser General Public License v2.1; LGPLv2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3; GNU Lesser General Public License v3.0; LGPLv3",
    "LPPL-1.3c": "LaTeX Project Public License version 1.3c; LaTeX Project Public License v1.3c",
    "MIT": "MIT License; MIT licence; Expat license; terms of the MIT license",
    "MIT-0": "MIT No Attribution License; MIT-0 license",
    "MPL-1.1": "Mozilla Public License Version 1.1; Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License, Version 2.0; Mozilla Public License, v. 2.0; Mozilla Public License 2.0; MPL 2.0 license",
    "MS-PL": "Microsoft Public License; Microsoft Public License (Ms-PL)",
    "NCSA": "University of Illinois/NCSA Open Source License; NCSA Open Source License",
    "ODbL-1.0": "Open Database License; Open Database License v1.0; Open Data Commons Open Database License (ODbL) v1.0",
    "OFL-1.1": "SIL Open Font License, Version 1.1; SIL Open Font License 1.1",
    "OSL-3.0": "Open Software License version 3.0; Open Software License 3.0",
    "PDDL-1.0": "Open Data Commons Public Domain Dedication and License (PDDL) v1.0; Public Domain Dedication and License 1.0",
    "PHP-3.01": "PHP License, version 3.01; PHP License 3.01",
    "PostgreSQL": "PostgreSQL License; PostgreSQL licence",
    "PSF-2.0": "Python Software Foundation License Version 2; PSF License Version 2",
    "Unlicense": "Unlicense license; The Unlicense; Unlicense",
    "UPL-1.0": "Universal Permissive License (UPL), Version 1.0; Universal Permissive License v 1.0",
    "Vim": "Vim License; Vim licence",
    "WTFPL": "Do What The Fuck You Want To Public License, Version 2; WTFPL license",
    "Zlib": "zlib License; zlib/libpng license; zlib licence",
    "ZPL-2.1": "Zope Public License, Version 2.1; Zope Public License (ZPL) Version 2.1",
}
#: SPDX names that appear in tags only, besides those above.
MORE_TAGS = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-4-Clause", "X11", "CC-BY-2.0", "CC-BY-SA-2.0", "MS-RL", "OpenSSL", "Ruby", "BlueOak-1.0.0", "Beerware", "Classpath-exception-2.0", "LLVM-exception")

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so"
)
_MIT_AS_IS = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
_MIT_LIABLE = "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AD = "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
_BSD_LIABLE = (
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict "
    "liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."
_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_PROGRAM = "This {} is free software: "


def _gnu(name: str, version: str, later: bool) -> list[list[str]]:
    """The notice of a GNU licence, of a program or a library; marks between words make no difference."""
    out = []
    for what in ("program", "library"):
        free = _PROGRAM.format(what) + _GPL.format(name)
        ends = [f"; either version {version} of the License, or (at your option) any later version."]
        only = [f"; version {version}.", f"; version {version} of the License."]
        for end in ends if later else only:
            out.append([free + end, f"?This {what} {_HOPE}", f"?See the GNU {name} for more details.", f"?You should have received a copy of the GNU {name} along with this {what}."])
    return out


#: (SPDX name, identifier stem, sentences in order; "?": may be absent). Each wording of a notice is a rule.
NOTICES = [
    ("MIT", "mit", [_MIT_GRANT + ", subject to the following conditions:", "?The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _MIT_AS_IS, "?" + _MIT_LIABLE]),
    ("MIT", "mit.next", [_MIT_GRANT + ", subject to the following conditions:", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.", "?" + _MIT_AS_IS, "?" + _MIT_LIABLE]),
    ("MIT", "mit.grant_notice", [_MIT_GRANT + ", subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]),
    ("MIT-0", "mit0", [_MIT_GRANT + ".", "?" + _MIT_AS_IS, "?" + _MIT_LIABLE]),
    ("BSD-2-Clause", "bsd2", [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, "?" + _BSD_AS_IS, "?" + _BSD_LIABLE]),
    ("BSD-3-Clause", "bsd3", [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_ENDORSE, "?" + _BSD_AS_IS, "?" + _BSD_LIABLE]),
    ("BSD-4-Clause", "bsd4", [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_AD]),
    ("ISC", "isc", [_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", "?" + _ISC_AS_IS]),
    ("0BSD", "0bsd", [_ISC_GRANT + ".", "?" + _ISC_AS_IS]),
    ("Zlib", "zlib", [
        "This software is provided 'as-is', without any express or implied warranty.", "?In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ]),
    ("BSL-1.0", "boost", [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ]),
    ("BSL-1.0", "boost.short", ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"]),
    ("Apache-2.0", "apache2", [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "?You may obtain a copy of the License at",
        "?http://www.apache.org/licenses/LICENSE-2.0",
        "?Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "?See the License for the specific language governing permissions and limitations under the License.",
    ]),
    ("Apache-2.0", "apache2.url", [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "?Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "?See the License for the specific language governing permissions and limitations under the License.",
    ]),
    ("MPL-2.0", "mpl2", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "?If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ]),
    ("MPL-2.0", "mpl2.s", ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    ("EPL-2.0", "epl2", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"]),
    ("EPL-2.0", "epl2.s", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    ("CDDL-1.0", "cddl", ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", "?You may not use this file except in compliance with the License."]),
    ("Unlicense", "unlicense", [
        "This is free and unencumbered software released into the public domain.",
        "?Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ]),
    ("CC0-1.0", "cc0", [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "?This software is distributed without any warranty.",
    ]),
    ("CC0-1.0", "cc0.waived", ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."]),
    ("WTFPL", "wtfpl", ["?It comes without any warranty, to the extent permitted by applicable law.", "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."]),
    ("PostgreSQL", "postgres", ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."]),
    ("OFL-1.1", "ofl", ["This Font Software is licensed under the SIL Open Font License, Version 1.1."]),
    ("Artistic-2.0", "artistic2", ["You may redistribute it and/or modify it under the terms of the Artistic License 2.0."]),
    ("Perl", "perl", ["This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."]),
    ("Perl", "perl.program", ["This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself."]),
    ("Vim", "vim", ["There are no restrictions on distributing unmodified copies of Vim except that they must include this license text."]),
    ("Beerware", "beer", ["As long as you retain this notice you can do whatever you want with this stuff."]),
]
for _spdx, _stem, _name, _version, _later in (
    ("GPL-2.0-or-later", "gpl2l", "General Public License", "2", True), ("GPL-3.0-or-later", "gpl3l", "General Public License", "3", True),
    ("GPL-2.0-only", "gpl2", "General Public License", "2", False), ("GPL-3.0-only", "gpl3", "General Public License", "3", False),
    ("LGPL-2.1-or-later", "lgpl21l", "Lesser General Public License", "2.1", True), ("LGPL-3.0-or-later", "lgpl3l", "Lesser General Public License", "3", True),
    ("LGPL-2.1-only", "lgpl21", "Lesser General Public License", "2.1", False), ("AGPL-3.0-or-later", "agpl3l", "Affero General Public License", "3", True),
):
    NOTICES += [(_spdx, f"{_stem}.{k}", sentences) for k, sentences in enumerate(_gnu(_name, _version, _later))]
