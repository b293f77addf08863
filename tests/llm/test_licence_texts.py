"""Licence notices as they are printed."""

import pytest

from seqaudit.llm import license_rules


@pytest.fixture(scope="module")
def found(spark):
    def look(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        return [r.licences for r in license_rules.licences(rows).orderBy("doc_id").collect()]
    return look


def test_wrapped_notices(found):
    texts = ["All rights\nreserved.", "All  rights   reserved", "All rights, reserved", "x.\nThis work is dedicated to the public\ndomain.",
             "Released into the public  domain.", "no rights"]
    assert found(texts) == [["Proprietary"]] * 3 + [["CC0-1.0"]] * 2 + [[]]


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERT = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.
"""
GNU = """This {0} is free software; you can redistribute it and/or
modify it under the terms of the GNU {1}General Public
License as published by the Free Software Foundation{2} either
version {3} of the License, or (at your option) any later version.
"""
TEXTS = {
    "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + THIRD, "BSD-4-Clause": BSD + ADVERT + THIRD.replace("3.", "4."),
    "GPL-2.0-or-later": GNU.format("program", "", ";", "2"), "GPL-3.0-or-later": GNU.format("program", "", ",", "3"),
    "LGPL-2.1-or-later": GNU.format("library", "Lesser ", ";", "2.1"), "LGPL-3.0-or-later": GNU.format("library", "Lesser ", ",", "3"),
    "AGPL-3.0-or-later": GNU.format("program", "Affero ", ",", "3"),
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
           "provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\n"
               "which is available at https://www.eclipse.org/legal/epl-2.0/\n\nx",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed",
}


def test_standard_texts(found):
    assert dict(zip(TEXTS, found(TEXTS.values()))) == {name: [name] for name in TEXTS}


def test_standard_tags(spark):
    """The tag with a space after its colon, in comments, with choices, exceptions and text around it."""
    tag = "SPDX-License-Identifier:"
    want = {
        f"{tag} MIT": ["MIT"], f"// {tag} Apache-2.0\nint x;": ["Apache-2.0"], f"/* {tag}MIT */": ["MIT"], f"# {tag}  GPL-2.0-only\n#": ["GPL-2.0"],
        f"{tag} MIT OR Apache-2.0": ["MIT", "Apache-2.0"], f"{tag} (MIT AND BSD-3-Clause) OR GPL-3.0-only": ["MIT", "BSD-3-Clause", "GPL-3.0"],
        f"{tag} GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0-or-later"], f"Some words. Copyright me {tag} ISC\nmore words": ["ISC"],
        f"{tag} LGPL-2.1-or-later\n{tag} CC0-1.0": ["LGPL-2.1-or-later", "CC0-1.0"], f"{tag} Unheard-1.0": [], f"{tag}": [],
        "spdx license identifier mit": [],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "doc_id bigint, text string")
    got = {r.text: r.licences for r in license_rules.licences(df).collect()}
    assert {t: sorted(x) for t, x in got.items()} == {t: sorted(x) for t, x in want.items()}
