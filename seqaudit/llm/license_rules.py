"""License recognition by sentence rules, with DataFrame functions only.

A text is cut into sentences; each is normalised (a-z, digits and ``.+-`` only, single
spaces) and looked up among the known licence sentences. A sentence that is unknown as a
whole is looked up line by line, as headings and notices often lack a full stop. A standard
tag (``SPDX-License-Identifier: A OR B``) is made a line for each licence it names first. The
identifiers found, in order, are matched against ordered rules: a rule that finds its
identifiers next to each other claims them, so a later, more general rule cannot.

Texts that hold none of ``KEYWORDS`` cannot hold a known sentence and are not cut at all: each
known sentence holds one (checked when the module is loaded), and as keywords are single
words, line breaks or other separators that normalisation removes cannot split them. There is no shuffle and no user function.

Defined results. A null or empty text has no sentences and no licence. Sentences are found
anywhere in the whole text, and repeated sentences are repeated identifiers; a licence is
listed once, in rule order. Known sentences that no rule claims give the licence
``unrecognised``. Repeated rows and null ids keep their rows; extra columns are kept,
except columns named ``sentences``, ``licences`` and ``family``, which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Known sentences by identifier, normalised (fixed values: wordings of public licences).
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2": (
        "apache license version 2.0 january 2004 http www.apache.org licenses",
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license",
        "this project is licensed under the apache license 2.0",
        "released under the apache license 2.0",
        "spdx-license-identifier apache-2.0",
    ),
    "apache2-use": ("you may not use this file except in compliance with the license",),
    "apache2-copy": ("you may obtain a copy of the license at http www.apache.org licenses license-2.0",),
    "mit": (
        "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
        "this software is released under the mit license", "the mit license", "mit license", "spdx-license-identifier mit",
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software",
    ),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "bsd": ("licensed under the bsd license", "released under the bsd license"),
    "bsd3": ("licensed under the bsd 3-clause license", "spdx-license-identifier bsd-3-clause"),
    "bsd2": ("licensed under the bsd 2-clause license", "spdx-license-identifier bsd-2-clause"),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-advert": (
        "all advertising materials mentioning features or use of this software must display the following acknowledgement",
        "all advertising materials mentioning features or use of this software must display the following acknowledgment",
    ),
    "bsd-names": tuple(
        f"neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission"
        for holder in ("the copyright holder", "the copyright holders", "the copyright owner", "the organization", "the university",
                       "the author", "the project", "the company")) + (
        "neither the name of the copyright holder nor the names of the contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior "
        "written permission",
        "the names of its contributors may not be used to endorse or promote products derived from this software without specific "
        "prior written permission",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "isc license", "licensed under the isc license", "released under the isc license",
    ),
    "0bsd": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain", "licensed under the unlicense"),
    "epl2": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is "
        "available at https www.eclipse.org legal epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which "
        "accompanies this distribution and is available at https www.eclipse.org legal epl-v20.html",
        "eclipse public license - v 2.0", "licensed under the eclipse public license 2.0",
    ),
    "epl1": (
        "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public "
        "license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl-v10.html",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which "
        "accompanies this distribution and is available at http www.eclipse.org legal epl-v10.html",
        "eclipse public license - v 1.0",
    ),
    "gpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation",
    ),
    "lgpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation",
    ),
    "agpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation",
    ),
    "later-2": ("either version 2 of the license or at your option any later version",),
    "later-21": ("either version 2.1 of the license or at your option any later version",),
    "later-3": ("either version 3 of the license or at your option any later version",),
    "gpl2-grant": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 2 of the license or at your option any later version",
    ),
    "lgpl21-grant": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 2.1 of the license or at your option any later version",
    ),
    "lgpl3-grant": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version",
    ),
    "agpl3-grant": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl3": (
        "gnu general public license version 3 29 june 2007",
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "licensed under the gnu general public license v3.0",
        "licensed under the gplv3", "spdx-license-identifier gpl-3.0", "spdx-license-identifier gpl-3.0-only",
    ),
    "gpl2": (
        "gnu general public license version 2 june 1991",
        "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the "
        "free software foundation",
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2", "spdx-license-identifier gpl-2.0",
    ),
    "gpl-grant": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose",
    ),
    "lgpl21": ("gnu lesser general public license version 2.1 february 1999",),
    "lgpl3": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl": ("licensed under the gnu lesser general public license", "licensed under the gnu lesser general public license version 3"),
    "agpl": ("gnu affero general public license version 3 19 november 2007", "licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0"),
    "mpl2": (
        "this source code form is subject to the terms of the mozilla public license v", "mozilla public license version 2.0",
        "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0",),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "cc-by-nd": ("licensed under cc by-nd 4.0",),
    "cc0": ("licensed under cc0 1.0", "this work is dedicated to the public domain", "released into the public domain"),
    "reserved": ("all rights reserved", "copyright all rights reserved"),
}

#: Short identifiers of the standard licence tag, by the identifier above (fixed values: the SPDX list).
SPDX: dict[str, tuple[str, ...]] = {
    "isc": ("isc",), "0bsd": ("0bsd",), "unlicense": ("unlicense",), "epl2": ("epl-2.0",), "epl1": ("epl-1.0",), "gpl2": ("gpl-2.0-only",),
    "gpl2-grant": ("gpl-2.0-or-later",), "gpl-grant": ("gpl-3.0-or-later",), "lgpl21": ("lgpl-2.1", "lgpl-2.1-only"),
    "lgpl21-grant": ("lgpl-2.1-or-later",), "lgpl3": ("lgpl-3.0", "lgpl-3.0-only"), "lgpl3-grant": ("lgpl-3.0-or-later",),
    "agpl": ("agpl-3.0-only",), "agpl3-grant": ("agpl-3.0-or-later",), "cc0": ("cc0-1.0",), "cc-by": ("cc-by-4.0",),
    "cc-by-sa": ("cc-by-sa-4.0",), "cc-by-nc": ("cc-by-nc-4.0",), "cc-by-nd": ("cc-by-nd-4.0",),
}
TAG = "spdx-license-identifier "
SENTENCES |= {key: tuple(dict.fromkeys((*SENTENCES[key], *(TAG + name for name in names)))) for key, names in SPDX.items()}
#: What makes one line of each licence of a tag: (pattern, replacement with the groups as {1}), in this order. The tag begins a line,
#: exceptions go, and each ``or`` and ``and`` begins another tag; up to five operands.
TAG_STEPS: tuple[tuple[str, str], ...] = (
    (r"spdx-license-identifier[\x20\x09]*:[\x20\x09]*", "\n" + TAG),
    (r"(spdx-license-identifier [^\n]*?)[\x20\x09]+with[\x20\x09]+[a-z0-9.-]+", "{1}"),
    *[(r"(spdx-license-identifier )[(\x20]*([a-z0-9.+-]+)[)\x20]+(?:or|and)[\x20]+", "{1}{2}\n" + TAG)] * 4,
    (r"(spdx-license-identifier )[(\x20]+", "{1}"),
)

#: Every known sentence holds one of these.
KEYWORDS = ("licen", "warrant", "permission", "redistribut", "domain", "reserved", "advertising")


@dataclass(frozen=True)
class Rule:
    licence: str
    sentences: tuple[str, ...]
    family: str


#: Tried in order; a rule claims the identifiers it matches.
RULES = (
    Rule("MIT", ("mit", "mit-grant", "mit-notice", "as-is"), "permissive"),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is"), "permissive"),
    Rule("MIT", ("mit-grant", "mit-notice"), "permissive"),
    Rule("Apache-2.0", ("apache2", "apache2-use", "apache2-copy"), "permissive"),
    Rule("Apache-2.0", ("apache2", "apache2-use"), "permissive"),
    Rule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"), "permissive"),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "permissive"),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), "permissive"),
    Rule("ISC", ("isc", "isc"), "permissive"),
    Rule("ISC", ("isc",), "permissive"),
    Rule("0BSD", ("0bsd",), "permissive"),
    Rule("Unlicense", ("unlicense",), "permissive"),
    Rule("EPL-2.0", ("epl2",), "copyleft"),
    Rule("EPL-1.0", ("epl1",), "copyleft"),
    Rule("GPL-2.0-or-later", ("gpl-terms", "later-2"), "copyleft"),
    Rule("GPL-2.0-or-later", ("gpl2-grant",), "copyleft"),
    Rule("GPL-3.0-or-later", ("gpl-terms", "later-3"), "copyleft"),
    Rule("LGPL-2.1-or-later", ("lgpl-terms", "later-21"), "copyleft"),
    Rule("LGPL-2.1-or-later", ("lgpl21-grant",), "copyleft"),
    Rule("LGPL-3.0-or-later", ("lgpl-terms", "later-3"), "copyleft"),
    Rule("LGPL-3.0-or-later", ("lgpl3-grant",), "copyleft"),
    Rule("AGPL-3.0-or-later", ("agpl-terms", "later-3"), "copyleft"),
    Rule("AGPL-3.0-or-later", ("agpl3-grant",), "copyleft"),
    Rule("GPL", ("gpl-terms",), "copyleft"),
    Rule("LGPL", ("lgpl-terms",), "copyleft"),
    Rule("LGPL-2.1", ("lgpl21",), "copyleft"),
    Rule("LGPL-3.0", ("lgpl3",), "copyleft"),
    Rule("AGPL", ("agpl-terms",), "copyleft"),
    Rule("GPL-3.0-or-later", ("gpl-grant", "gpl-warranty"), "copyleft"),
    Rule("GPL-3.0-or-later", ("gpl-grant",), "copyleft"),
    Rule("MIT", ("mit",), "permissive"),
    Rule("Apache-2.0", ("apache2",), "permissive"),
    Rule("BSD-3-Clause", ("bsd3",), "permissive"),
    Rule("BSD-2-Clause", ("bsd2",), "permissive"),
    Rule("BSD", ("bsd",), "permissive"),
    Rule("GPL-3.0", ("gpl3",), "copyleft"),
    Rule("GPL-2.0", ("gpl2",), "copyleft"),
    Rule("LGPL", ("lgpl",), "copyleft"),
    Rule("AGPL-3.0", ("agpl",), "copyleft"),
    Rule("MPL-2.0", ("mpl2",), "copyleft"),
    Rule("CC-BY-NC-4.0", ("cc-by-nc",), "restricted"),
    Rule("CC-BY-ND-4.0", ("cc-by-nd",), "restricted"),
    Rule("CC-BY-SA-4.0", ("cc-by-sa",), "copyleft"),
    Rule("CC-BY-4.0", ("cc-by",), "permissive"),
    Rule("CC0-1.0", ("cc0",), "permissive"),
    Rule("Proprietary", ("reserved",), "restricted"),
)
UNRECOGNISED = "unrecognised"
#: The strictest family found names the document's.
FAMILIES = ("restricted", "copyleft", "permissive")


def normalised(sentence: str) -> str:
    """What ``_clean`` makes of a sentence."""
    return re.sub(r"[^a-z0-9.+-]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" .-+")


assert all(re.fullmatch("[a-z0-9]+", k) for k in KEYWORDS)
for _key, _all in SENTENCES.items():
    for _s in _all:
        assert normalised(_s) == _s and any(k in _s for k in KEYWORDS), (_key, _s)


def _clean(sentence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sentence, r"[^a-z0-9.+-]+", " "), r"^[ .+-]+|[ .+-]+$", "")


def licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentences`` (identifiers in order), ``licences`` and ``family`` (null without a licence)."""
    known = F.create_map(*[F.lit(x) for key, all_ in SENTENCES.items() for s in all_ for x in (s, key)])
    every = [s for all_ in SENTENCES.values() for s in all_]
    rules = F.array(*[F.struct(F.lit(f",{','.join(r.sentences)},").alias("ids"), F.lit(r.licence).alias("licence")) for r in RULES])
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    hinted = F.lit(False)
    for k in KEYWORDS:
        hinted = hinted | F.contains("__lower", F.lit(k))
    none = F.array().cast("array<string>")
    lined = F.col("__lower")
    for pattern, to in TAG_STEPS:
        lined = F.regexp_replace(lined, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    df = docs.withColumn("__lower", lower).withColumn("__lower", F.when(F.contains("__lower", F.lit(TAG.strip())), lined).otherwise(F.col("__lower")))
    df = df.withColumn("__parts", F.when(hinted, F.split("__lower", r"[.;:!?]+[\x20\x09-\x0D]+|\n[\x20\x09\x0D]*\n")).otherwise(none))

    def look_up(part: Column) -> Column:
        whole = F.array(_clean(part))
        return F.when(_clean(part).isin(every), whole).otherwise(F.transform(F.split(part, "\n"), _clean))

    found = F.filter(F.flatten(F.transform("__parts", look_up)), lambda s: s.isin(every))
    df = df.withColumn("__found", found)
    ids = F.when(F.size("__found") > 0, F.transform("__found", lambda s: F.element_at(known, s))).otherwise(none)
    df = df.withColumn("__ids", ids)
    # a claimed run leaves a gap; identifiers are doubled-comma separated so that neighbours do not share one
    start = F.struct(F.concat(F.lit(","), F.array_join("__ids", ","), F.lit(",")).alias("rest"), none.alias("names"))

    def claim(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(F.replace(acc["rest"], rule["ids"], F.lit(",~,")).alias("rest"),
                        F.when(hit, F.array_append(acc["names"], rule["licence"])).otherwise(acc["names"]).alias("names"))

    claimed = F.aggregate(rules, start, claim, lambda acc: F.array_distinct(acc["names"]))
    names = F.when(F.size("__ids") == 0, none).otherwise(claimed)
    df = df.withColumn("__names", names)
    names = F.when((F.size("__ids") > 0) & (F.size("__names") == 0), F.array(F.lit(UNRECOGNISED))).otherwise(F.col("__names"))
    family = F.when(F.size("__ids") > 0, F.lit("unknown"))
    for f in reversed(FAMILIES):
        members = sorted({r.licence for r in RULES if r.family == f})
        family = F.when(F.arrays_overlap("__names", F.array(*map(F.lit, members))), F.lit(f)).otherwise(family)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("sentences", "licences", "family")]
    return df.select(*own, F.col("__ids").alias("sentences"), names.alias("licences"), family.alias("family"))
