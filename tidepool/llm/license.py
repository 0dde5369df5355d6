"""Licence recognition by sentence rules.

A text is cut into sentences; each is normalised (lower case, runs of other
characters than a-z and 0-9 become one space) and looked up among the known
licence sentences.  The identifiers of a document, in order, form a sequence;
the licence rules, which are sequences of identifiers too, are tried in their
order, and each occurrence of a rule consumes its identifiers.  Identifiers
that no rule consumes are counted as unmatched.  All of it is SQL functions.

Defined results: null and empty texts have no sentences and no licence; a
sentence that stands twice is identified twice; a licence found twice is
listed twice, in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheGrant",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "spdx license identifier apache 2 0": "SpdxApache",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "spdx license identifier mit": "SpdxMit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "spdx license identifier gpl 3 0 only": "SpdxGpl3",
    "spdx license identifier gpl 3 0 or later": "SpdxGpl3Later",
    "spdx license identifier gpl 2 0 only": "SpdxGpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GnuWarranty",
    "see the gnu general public license for more details": "GnuDetails",
    "licensed under cc by nc 4 0": "CcByNcRef",
    "licensed under cc by 4 0": "CcByRef",
    "licensed under cc by sa 4 0": "CcBySaRef",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByRef",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNcRef",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySaRef",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MplRef",
    # the sentences above as the boundaries cut them in the standard notices
    "you may obtain a copy of the license at": "ApacheAt",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "this program is free software": "GnuFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GnuTerms",
    "either version 3 of the license or at your option any later version": "GnuV3Later",
    "either version 2 of the license or at your option any later version": "GnuV2Later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GnuHope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GnuImplied",
    "this source code form is subject to the terms of the mozilla public license v": "MplTerms",
    "2 0": "MplVersion",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MplCopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MplCopy",
    "spdx license identifier gpl 2 0 or later": "SpdxGpl2Later",
    "spdx license identifier bsd 2 clause": "SpdxBsd2",
    "spdx license identifier bsd 3 clause": "SpdxBsd3",
    "spdx license identifier mpl 2 0": "SpdxMpl",
    "spdx license identifier cc by 4 0": "SpdxCcBy",
    "spdx license identifier cc by sa 4 0": "SpdxCcBySa",
    "spdx license identifier cc by nc 4 0": "SpdxCcByNc",
    "spdx license identifier unlicense": "SpdxUnlicense",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
}
#: Licence rules in the order in which they are tried: name and identifiers.
RULES = [
    ("Apache-2.0", ["ApacheGrant", "ApacheComply", "ApacheAt", "ApacheUrl"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheComply", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheComply"]),
    ("MIT", ["MitGrant", "MitNotice", "MitWarranty"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GnuWarranty", "GnuDetails"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GnuWarranty", "GnuDetails"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GnuHope", "GnuImplied", "GnuDetails"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GnuHope", "GnuImplied", "GnuDetails"]),
    ("GPL-3.0-or-later", ["GnuFree", "GnuTerms", "GnuV3Later", "GnuHope", "GnuImplied", "GnuDetails"]),
    ("GPL-2.0-or-later", ["GnuFree", "GnuTerms", "GnuV2Later", "GnuHope", "GnuImplied", "GnuDetails"]),
    ("GPL-3.0-or-later", ["GnuFree", "GnuTerms", "GnuV3Later"]),
    ("GPL-2.0-or-later", ["GnuFree", "GnuTerms", "GnuV2Later"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("Apache-2.0", ["SpdxApache"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["SpdxMit"]),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-3.0-only", ["SpdxGpl3"]),
    ("GPL-3.0-or-later", ["SpdxGpl3Later"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("GPL-2.0-only", ["SpdxGpl2"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("MPL-2.0", ["MplTerms", "MplVersion", "MplCopy"]),
    ("MPL-2.0", ["MplTerms", "MplVersion"]),
    ("MPL-2.0", ["MplRef"]),
    ("GPL-2.0-or-later", ["SpdxGpl2Later"]),
    ("BSD-2-Clause", ["SpdxBsd2"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("MPL-2.0", ["SpdxMpl"]),
    ("CC-BY-4.0", ["SpdxCcBy"]),
    ("CC-BY-SA-4.0", ["SpdxCcBySa"]),
    ("CC-BY-NC-4.0", ["SpdxCcByNc"]),
    ("Unlicense", ["SpdxUnlicense"]),
    ("Unlicense", ["Unlicense"]),
]
#: An SPDX tag ends with its line.
SPDX = r"(SPDX-License-Identifier:[^\r\n]*)"
#: A sentence ends at a mark before white space or the end, or at a blank line.
BOUNDARY = r"[.!?;]+(?:\s+|$)|\r?\n[ \t]*\r?\n"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, without empty ones."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), SPDX, "\n\n$1\n\n")
    parts = F.transform(F.split(marked, BOUNDARY), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(parts, lambda s: s != "")


def match_rules(ids: Column) -> Column:
    """The identifier sequence as text, ``[k]`` where rule k has matched."""
    seq = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for k, (_, rule) in enumerate(RULES):
        seq = F.replace(seq, F.lit("".join(f"<{i}>" for i in rule)), F.lit(f"[{k}]"))
    return seq


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences, n_unmatched``."""
    known = F.create_map(*(F.lit(x) for kv in SENTENCES.items() for x in kv))
    names = F.array(*(F.lit(n) for n, _ in RULES))
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sentences(F.col(text)).alias("s"))
    found = found.select("doc_id", F.size("s").alias("n"), F.filter(F.transform("s", lambda s: F.try_element_at(known, s)),
                                                                     lambda i: i.isNotNull()).alias("ids"))
    found = found.withColumn("seq", match_rules(F.col("ids")))
    matched = F.regexp_extract_all("seq", F.lit(r"\[(\d+)\]"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_sentences"), F.col("ids").alias("sentence_ids"),
                        F.transform(matched, lambda k: F.get(names, k.cast("int"))).alias("licences"),
                        F.size(F.regexp_extract_all("seq", F.lit("<(\\w+)>"))).cast("long").alias("n_unmatched"))
