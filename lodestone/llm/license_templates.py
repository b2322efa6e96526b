"""License notices to scan for, as data: SPDX id to names, titles and headers.

The wording is public: that of the licenses' own notices and titles. In the name
of a template, what follows ``/`` tells the wording.
"""

from __future__ import annotations

#: How short notices name a license.
NAMES = {
    "MIT": ["MIT License", "Expat License"],
    "Apache-2.0": ["Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL version 2", "GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL version 3", "GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "LGPL version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "LGPL version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "AGPL version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License Version 1.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}

#: First lines of full license texts.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions",
    "EPL-2.0": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}

_GPL = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

#: Headers of source files and whole short licenses.
HEADERS = {
    "GPL-2.0": _GPL.format(what="program", name="General Public License", version="2"),
    "LGPL-2.1": _GPL.format(what="library", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0": _GPL.format(what="program", name="Lesser General Public License", version="3"),
    "AGPL-3.0": _GPL.format(what="program", name="Affero General Public License", version="3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_SPDX = {"GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]}


def general_templates() -> dict[str, str]:
    out = {f"{name}/header": text for name, text in HEADERS.items()} | {f"{name}/title": text for name, text in TITLES.items()}
    for name, known in NAMES.items():
        # Words before "under" (licensed, released, distributed, available) are free.
        out |= {f"{name}/{form.strip()} {x}": f"{form}{x}" for x in known for form in ("under ", "under the ", "under a ", "terms of the ")}
        out |= {f"{name}/SPDX {x}": f"SPDX-License-Identifier: {x}" for x in _SPDX.get(name, [name])}
    return out
