"""Licenses and wordings of the registered templates."""

import pytest

from lodestone.llm import license_scan


@pytest.mark.parametrize("text, name", [
    ("This project is licensed under the MIT License - see LICENSE", "MIT"),
    ("made available under the terms of the Mozilla Public License 2.0", "MPL-2.0"),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n Everyone is permitted", "AGPL-3.0"),
    ("this code is distributed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Text is available under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("released under CC0 1.0", "CC0-1.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense"),
    ("licensed under the Eclipse Public License v2.0", "EPL-2.0"),
    ("licensed under the GNU General Public License version 2", "GPL-2.0"),
])
def test_wordings(text, name):
    (hits,) = license_scan.search(license_scan.build_index(license_scan.ALL_TEMPLATES), [f"some words first {text} and more".encode()], 0.8)
    assert name in {h[0].split("/")[0] for h in hits}
    assert name == max(hits, key=lambda h: h[1] * h[3])[0].split("/")[0]
