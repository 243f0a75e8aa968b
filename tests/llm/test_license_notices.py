"""Verbatim notices, hard-wrapped, plain and in comments."""

import pytest

from seamount.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
WANT = [
    (MIT, "MITGRANT,MITNOTICE,ASIS", "MIT", 0), (BSD, "BSDGRANT", "BSD-style", 0), (GPL, "GPLANY,GPLNOWARR,GPLCOPY,GPLCOPY", "GPL-3.0-or-later", 1),
    (MPL, "MPL2", "MPL-2.0", 0), (APACHE, "APACHE2,APACHEUSE,APACHECOPY,APACHENOWARR", "Apache-2.0", 0),
]


@pytest.mark.parametrize("form", ["wrapped", "hash", "slash", "star", "line"])
def test_verbatim_notices(spark, form):
    def written(text):
        lines = text.splitlines()
        if form == "star":
            return "/*\n" + "".join(f" * {x}\n" for x in lines) + " */\nint x;\n"
        marks = {"wrapped": "", "hash": "# ", "slash": "// "}
        return " ".join(text.split()) if form == "line" else "Intro.\n" + "\n".join(marks[form] + x for x in lines)

    got = license_scan.scan(spark.createDataFrame([(i, written(w[0])) for i, w in enumerate(WANT)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.sentence_ids, r.licenses, r.n_unmatched) for r in got} == {i: w[1:] for i, w in enumerate(WANT)}


def test_no_part_of_another_sentence(spark):
    texts = ["It isn't licensed under the MIT License.", "licensed under the MIT License, unless said otherwise", "licensed under the MIT license.txt", "\x02MIT\x02 and \x02MIT\x02", "Licensed under\n# the MIT\n# License"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.sentence_ids for r in got] == ["", "", "", "", "MIT"]
