import textwrap

import pytest
from pyspark.sql import functions as F

from airmetrics.llm.licenses import SENTENCES, scan
from airmetrics.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import SF, documents
from tests.oracle_check import compare, connect

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
)
NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software."
)


@pytest.mark.parametrize(
    ("text", "licences", "sentences", "rest"),
    [
        ("Prose. Released under the MIT License.\nMore", ["MIT"], "<mit>", ""),
        ("The MIT License\n\n" + MIT + NOTICE, ["MIT"], "<mit_title><mit_grant><mit_notice>", ""),
        (MIT + "something else\n" + NOTICE, ["MIT"], "<mit_grant><mit_notice>", ""),
        ("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0", ["Apache-2.0", "CC-BY-NC-4.0"],
         "<cc_by_nc><apache_2>", ""),
        ("You may obtain a copy of the License at", [], "<apache_obtain>", "<apache_obtain>"),
        ("licensed under the MIT licensing terms", [], "", ""),
        (None, [], "", ""),
        ("", [], "", ""),
        ("x " * 500_000 + ". All rights reserved!", ["Proprietary"], "<reserved>", ""),
    ],
)
def test_sentences_and_rules(spark, text, licences, sentences, rest):
    docs = documents(spark, [(1, text), (1, text)]).withColumn("licences", F.lit(0))
    for row in scan(docs).collect():
        assert (row.licences, row.sentences, row.rest) == (licences, sentences, rest)


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GRANT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + textwrap.fill(MIT, 78) + "\n\n" + textwrap.fill(NOTICE, 78)


@pytest.mark.parametrize("mark", ["", " * ", "// ", "# ", ";; ", "! ", "    "])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_wrapped_notices(spark, mark, end):
    whole = [
        (GRANT, ["MIT"], "<mit_title><mit_grant><mit_notice>"),
        (GPL, ["GPL-3.0"], "<gpl_free><gpl_warranty>"),
        (BSD, ["BSD", "Proprietary"], "<reserved><bsd_grant>"),
        (APACHE, ["Apache-2.0"], "<apache_2><apache_comply><apache_obtain><apache_as_is><apache_limits>"),
        ("SPDX-License-Identifier: MIT\nint x;", ["MIT"], "<spdx_mit>"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"], "<spdx_gpl_3>"),
        ("SPDX-License-Identifier: Apache-2.0 */", ["Apache-2.0"], "<spdx_apache_2>"),
        ("x = 1\nSPDX-License-Identifier: BSD-3-Clause\n", ["BSD-3-Clause"], "<spdx_bsd_3>"),
        ("Released under\n\nthe MIT\nlicense of old", [], ""),
        ("Released under. Released under the MIT\nLicense", ["MIT"], "<mit>"),
    ]
    texts = [end.join(mark + line for line in text.split("\n")) for text, _, _ in whole]
    got = {r.doc_id: r for r in scan(documents(spark, list(enumerate(texts)))).collect()}
    for k, (text, licences, sentences) in enumerate(whole):
        assert (got[k].licences, got[k].sentences) == (licences, sentences), texts[k]


def test_long_runs_of_marks_are_read_in_one_go(spark):
    for run in ("; " * 200_000, "\u6587" * 400_000, ". " * 200_000, "\n* " * 100_000, "!" * 400_000):
        assert scan(documents(spark, [(1, run + "\nReleased under the\nMIT license")])).first().licences == ["MIT"]


def test_empty_table_and_known_sentences(spark):
    assert scan(documents(spark, [(1, "x")]).limit(0)).count() == 0
    for texts in SENTENCES.values():
        assert all(t == " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in texts)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF) is None


def test_plan_stays_native(spark):
    for name in ("op5_license_rules", "op6_path_templates"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
