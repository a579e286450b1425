import re
import textwrap

import duckdb

from millrace.llm.licences import HINT, RULES, known_sentences, oracle, scan_licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ROWS = [
    (1, None), (2, ""), (3, "Some text. Released under the MIT License. More text."), (4, MIT), (5, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at\nhere"),
    (6, "Licensed under CC BY-NC 4.0."), (7, "the license of this is unknown"), (8, ("x " * 50_000) + "\nThis work is licensed under the GNU General Public License, version 3."), (8, "Released under the MIT License.\nLicensed under CC0 1.0."),
]


def test_licences(spark):
    got = sorted((r.doc_id, list(r.licenses)) for r in scan_licenses(spark.createDataFrame(ROWS, "doc_id long, text string")).collect())
    assert got == [(1, []), (2, []), (3, ["MIT"]), (4, ["MIT"]), (5, ["Apache-2.0"]), (6, ["CC-BY-NC-4.0"]), (7, []), (8, ["GPL-3.0"]), (8, ["MIT", "CC0-1.0"])]


def test_no_python_in_the_plan(spark):
    plan = scan_licenses(spark.createDataFrame(ROWS, "doc_id long, text string").where("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracle(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(oracle()).fetchall())
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, len(r.license_sentences), ",".join(r.licenses)) for r in found.collect()) == want


def test_rules_name_known_sentences():
    known = set(known_sentences().values())
    assert all(i in known for _, ids in RULES for i in ids)
    assert all(re.search(HINT, s) for s in known_sentences())


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string, licenses int")).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{other} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""


def _marked(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


def test_verbatim_wrapped_texts(spark):
    mit = "\n\n".join(textwrap.fill(p, 72) for p in MIT.split("\n\n")) + "\n" + WARRANTY
    gpl3, gpl2 = GPL.format(mark=":", other=",", n=3), GPL.format(mark=";", other=";", n=2)
    whole = {
        "MIT": (mit, 3), "ISC": (ISC, 1), "BSD-2-Clause": (BSD, 3), "BSD-3-Clause": (BSD + BSD_NAME, 4), "Apache-2.0": (APACHE, 3),
        "GPL-3.0-or-later": (gpl3, 2), "GPL-2.0-or-later": (gpl2, 2), "MPL-2.0": (MPL, 1),
    }
    rows, want = [], {}
    for licence, (text, n) in whole.items():
        for form in (text, text.replace("\n", "\r\n"), _marked(text, "//"), "/*\n" + _marked(text, " *") + "\n */\nint x;", _marked(text, "#"), _marked(text, "dnl"), "Some title\n" + textwrap.fill(text.split("\n\n")[0], 30) + "\n\n" + "\n\n".join(text.split("\n\n")[1:])):
            want[len(rows)] = (n, [licence])
            rows.append((len(rows), form))
    for text, found in (("Released under the Creative\nCommons Zero 1.0.", ["CC0-1.0"]), ("This work is\nlicensed under the MIT License.", ["MIT"]), ("Licensed under.\nMIT License", []), ("Licensed under\n\nMIT License", [])):
        want[len(rows)] = (len(found), found)
        rows.append((len(rows), text))
    got = {r.doc_id: (len(r.license_sentences), list(r.licenses)) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and oracle_rows(rows) == got


def oracle_rows(rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return {i: (n, found.split(",") if found else []) for i, n, found in con.execute(oracle()).fetchall()}


FREE = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {name}
as published by the Free Software Foundation; either
version {v} of the License, or (at your option) any later version.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."


def test_notices_spdx_and_clauses(spark):
    cases = {
        "This project is licensed under the MIT License - see the LICENSE file.": ["MIT"], "Copyright 2020 A. Person, licensed under the Apache License, Version 2.0 (the \"License\"); see below": ["Apache-2.0"],
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": ["GPL-2.0-only"],
        " * SPDX-License-Identifier: LGPL-3.0-or-later": ["LGPL-3.0-or-later"], "Released under the GNU General Public License, version 3 or later.": ["GPL-3.0-or-later"], "It is not licensed under the MIT License.": [],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"], "The code is made available under the terms of the Boost Software License, Version 1.0.": ["BSL-1.0"],
        FREE.format(what="library", name="Lesser General Public License", v="2.1"): ["LGPL-2.1-or-later"], FREE.format(what="program", name="Affero General Public License", v="3"): ["AGPL-3.0-or-later"], ZLIB: ["Zlib"], UNLICENSE: ["Unlicense"],
        "a plain line, permitted by nobody; express trains": [], "(": [], "\n\n": [],
    }
    rows = list(enumerate(cases))
    got = {r.doc_id: (len(r.license_sentences), sorted(r.licenses)) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: found for i, (_, found) in got.items()} == {i: sorted(f) for i, f in enumerate(cases.values())}
    assert {i: (n, sorted(f)) for i, (n, f) in oracle_rows(rows).items()} == got


NAMED = BSD + """
   * Neither the name of {org} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
#: Texts as they are published, and what they state; nothing here is made from the operator's table.
PUBLISHED = {
    NAMED.format(org="Google Inc."): ["BSD-3-Clause"], NAMED.format(org="the University of California, Berkeley"): ["BSD-3-Clause"], NAMED.format(org="Facebook, Inc.,\n"): ["BSD-3-Clause"],
    BSD + "\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n": ["BSD-3-Clause"], BSD: ["BSD-2-Clause"],
    '{\n  "name": "x",\n  "license": "MIT",\n  "version": "1"\n}': ["MIT"], "License: MIT": ["MIT"], "license = 'Apache-2.0'": ["Apache-2.0"], '"license": "(MIT OR Apache-2.0)"': ["Apache-2.0", "MIT"], "License: see below": [],
    "License :: OSI Approved :: MIT License": ["MIT"], "License: Apache License, Version 2.0": ["Apache-2.0"],
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE": ["Apache-2.0"],
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": ["GPL-3.0"], "  GNU LESSER GENERAL PUBLIC LICENSE\n    Version 2.1, February 1999\n": ["LGPL-2.1"],
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n": ["MPL-2.0"], "Mozilla Public License Version 2.0": ["MPL-2.0"], "The MIT License\n\nCopyright (c) 2020": ["MIT"],
    "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": ["ISC"],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    "Licensed under either of\n\n * Apache License, Version 2.0 ([LICENSE-APACHE](LICENSE-APACHE) or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license ([LICENSE-MIT](LICENSE-MIT) or http://opensource.org/licenses/MIT)\n\nat your option.": ["Apache-2.0", "MIT"],
    "jquery is MIT licensed": ["MIT"], "All code here is under the MIT license, so enjoy.": ["MIT"], "Use it under the Apache License, Version 2.0.": ["Apache-2.0"],
    "It is not under the MIT license.": [], "This is not licensed under the MIT License.": [], "Neither the name nor the licence matters, nor the names of others.": [],
    "This file is part of GNU Emacs.\n\nGNU Emacs is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nGNU Emacs is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": ["GPL-3.0-or-later"],
}


def test_published_texts_with_names_titles_and_fields(spark):
    rows = list(enumerate(PUBLISHED)) + [(1000 + i, _marked(t, " *")) for i, t in enumerate(PUBLISHED) if "{" not in t and "\n * " not in t and "Version 2.0\n====" not in t]
    got = {r.doc_id: (len(r.license_sentences), list(r.licenses)) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = list(PUBLISHED.values())
    assert {i: sorted(f) for i, (_, f) in got.items()} == {i: want[i % 1000] for i, _ in rows}
    assert oracle_rows(rows) == got
