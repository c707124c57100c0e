"""Licence scans: known licence sentences as identifiers, and ordered rules over their sequence.

A text is normalised: lower case, letters and digits, and between two words one blank, one soft cut (``;``, ``:``
or a single line break, with any comment marks) or one hard cut (``.``, ``!``, ``?`` or an empty line). A known
sentence may run over soft cuts, so notices are found wrapped, indented, commented or on one line. Short
sentences begin and end at a cut of either kind. Whole sentences of published notices may begin at any word,
because a copyright line without a full stop often stands before them.
The identifiers found, in order, form the document's sequence.
Rules are tried from the most to the least specific; a rule that finds its identifiers in order takes
them out of the sequence, so that a sentence supports one licence only.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised wording of public licence notices.
SENTENCES = {
    "apache2": "licensed under the apache license version 2 0",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-permit": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccby": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbync": "licensed under cc by nc 4 0",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl-later": "either version 3 of the license or at your option any later version",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit": "released under the mit license",
    "mit-permit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied",
    "reserved": "all rights reserved",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "lgpl-program": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-later": "either version 2 1 of the license or at your option any later version",
    "agpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ccbysa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbyncsa": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "ccbynd": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Short names of licences as they stand behind "SPDX-License-Identifier:".
SPDX = """
MIT MIT-0 Apache-2.0 Apache-1.1 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib Unlicense WTFPL BSL-1.0 PostgreSQL NCSA
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 EUPL-1.2 Artistic-2.0 Python-2.0 OFL-1.1
CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0
""".split()
_words = lambda name: name.lower().replace("-", " ").replace(".", " ")
SENTENCES |= {f"spdx {n}": f"spdx license identifier {_words(n)}" for n in SPDX}
# The sentences whole, as the published notices have them: wording -> identifiers. ``a|b`` are alternatives of one
# place (``_`` for nothing, ``+`` for a blank), ``^`` before a word allows an empty line there.
_NOTICES = {
    "licensed under the apache license version 2 0 the license": "apache2",
    "you may not use this|these|the file|files|software|work|project except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at ^http|https www|_ apache org licenses license 2 0 html|txt|_": "apache2-copy",
    "unless required by applicable law or agreed to in writing software|this+software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permit",
    "redistributions of source code must retain the above copyright notice|notices this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice|notices this list of conditions and the following disclaimer in the documentation and or|_ other materials provided with the distribution": "bsd-binary",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject+to+the+following+conditions|_": "mit-permit",
    "the above copyright notice and this permission notice including+the+next+paragraph|_ shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement|non+infringement": "mit-asis",
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of+the+license|_ or at your option any later version": "gpl-program,gpl-later",
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of+the+license|_ or at your option any later version": "gpl-program,gpl2-later",
    "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of+the+license|_ or at your option any later version": "lgpl-program,lgpl21-later",
    "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of+the+license|_ or at your option any later version": "lgpl-program,gpl-later",
    "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of+the+license|_ or at your option any later version": "agpl-program,gpl-later",
    "this source code form is subject to the terms of the mozilla public license v ^2 0": "mpl2",
    "permission to use copy modify and or|_ distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# further wordings of short sentences
_SHORT = {
    "this work is licensed under a|the creative commons attribution 4 0 international license": "ccby",
    "this work is licensed under a|the creative commons attribution sharealike 4 0 international license": "ccbysa",
    "this work is licensed under a|the creative commons attribution noncommercial 4 0 international license": "ccbync4",
    "this work is licensed under a|the creative commons attribution noncommercial sharealike 4 0 international license": "ccbyncsa",
    "this work is licensed under a|the creative commons attribution noderivatives 4 0 international license": "ccbynd",
    "this+work+is|_ licensed under cc by nc 4 0": "ccbync",
    "this program|software|project|file is licensed under the gnu general public license version 3": "gpl3",
    "this project|software|work|program|file is|_ released|licensed under the mit license": "mit",
    "this project|software|work|program|file is licensed under the apache license version 2 0": "apache2",
}


def _expand(wordings: dict[str, str]) -> dict[str, str]:
    """Every single wording; ``^`` marks stay."""
    out = {}
    for text, ids in wordings.items():
        for words in product(*[x.lstrip("^").split("|") for x in text.split(" ")]):
            marked = ["^" + w if x[0] == "^" else w.replace("+", " ") for x, w in zip(text.split(" "), words, strict=True) if w != "_"]
            out[" ".join(marked)] = ids
    return out


WHOLE = _expand(_NOTICES)
SHORT = _expand(_SHORT) | {v: k for k, v in SENTENCES.items() if v not in WHOLE}
#: rules in order: licence, sentence identifiers that must follow one another (others may stand between)
CHAINS = (
    ("Apache-2.0", ("apache2", "apache2-comply", "apache2-copy", "apache2-basis")),
    ("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary")),
    ("AGPL-3.0-or-later", ("agpl-program", "gpl-later")),
    ("LGPL-2.1-or-later", ("lgpl-program", "lgpl21-later")),
    ("LGPL-3.0-or-later", ("lgpl-program", "gpl-later")),
    ("GPL-2.0-or-later", ("gpl-program", "gpl2-later")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-later")),
    ("MIT", ("mit-permit", "mit-notice", "mit-asis")),
    ("MIT", ("mit-permit", "mit-notice")),
    ("Apache-2.0", ("apache2",)),
    ("CC-BY-4.0", ("ccby",)),
    ("CC-BY-NC-4.0", ("ccbync",)),
    ("GPL-3.0-only", ("gpl3",)),
    ("MIT", ("mit",)),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("proprietary", ("reserved",)),
)
#: licences of one sentence each, looked up together after the chains
SINGLE = (
    ("MPL-2.0", "mpl2"), ("ISC", "isc"), ("CC-BY-SA-4.0", "ccbysa"), ("CC-BY-NC-4.0", "ccbync4"), ("CC-BY-NC-SA-4.0", "ccbyncsa"), ("CC-BY-ND-4.0", "ccbynd"),
    ("Unlicense", "unlicense"), *[(n, f"spdx {n}") for n in SPDX],
)
RULES = (*CHAINS, *[(licence, (x,)) for licence, x in SINGLE])
#: every known sentence holds one of these (within a word), so texts without any need not be cut
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ANCHORS = ("licen", "redistribut", "permission", "copyright", "warranty", "reserved", "unencumbered", "any later version")
assert all(any(a in s for a in ANCHORS) for s in [*SENTENCES.values(), *WHOLE, *SHORT])
#: letter of each identifier, for the rules
LETTERS = {k: chr(0xE000 + i) for i, k in enumerate(SENTENCES)}
# comment marks made of letters; a run of other characters that is a hard cut; one that is a soft cut
LETTER_MARKS = r"(?<![^\n])[ \t]*+@?(?:dnl|rem)(?![^ \t\n])"
HARD_CUT = r"""(?<![^a-z0-9])[^a-z0-9]*?(?:[.!?][ \t\n"')]|\n[^a-z0-9\n]*+\n)[^a-z0-9]*+"""
SOFT_CUT = r"""(?<![^a-z0-9H])[^a-z0-9H]*?(?:[;:][ \t\n"')]|\n)[^a-z0-9H]*+"""


def normal(text: Column) -> Column:
    """Words between single blanks, with ``S`` and ``H`` as words of their own where the text is cut."""
    x = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), UPPER + "\r", UPPER.lower() + "\n")
    x = F.regexp_replace(F.regexp_replace(x, LETTER_MARKS, ""), HARD_CUT, " H ")
    x = F.regexp_replace(F.regexp_replace(x, SOFT_CUT, " S "), "[^a-z0-9HS]+", " ")
    return F.concat(F.lit("H "), F.trim(x), F.lit(" H"))


def _known() -> str:
    """Pattern of all known sentences, the longest first; only the URL of a notice may end within a line."""

    def words(x: str) -> str:
        return x.replace(" ^", "~").replace(" ", " (?:S )?").replace("~", " (?:[SH] )?")

    longest = lambda known: sorted(known, key=lambda x: (-len(x), x))
    url = [words(x) + "(?= )" for x in longest(WHOLE) if "^" in x]
    whole = [words(x) + "(?= [HS])" for x in longest(WHOLE) if "^" not in x]
    short = [words(x) + "(?= [HS])" for x in longest(SHORT)]
    return rf"(?<= )(?:{'|'.join(whole + url)})|(?<=[HS] )(?:(?:[0-9]{{1,2}}|[a-z]|i{{2,3}}) )?(?:{'|'.join(short)})"


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    ids = {k.replace("^", ""): v for k, v in (WHOLE | SHORT).items()}
    by_words = F.create_map(*[F.lit(x) for k, v in ids.items() for x in (k, v)])
    plain = lambda x: F.regexp_replace(x, " [HS](?= )", "")
    named = lambda x: F.coalesce(F.element_at(by_words, x), F.element_at(by_words, F.regexp_replace(x, "^[^ ]+ ", "")))
    found = F.transform(F.transform(F.regexp_extract_all(normal(text), F.lit(_known()), F.lit(0)), plain), named)
    return F.flatten(F.transform(found, lambda x: F.split(x, ",")))


def _pattern(ids: tuple[str, ...]) -> str:
    """The identifiers in order over a string of letters; the gaps are groups 2 and up.

    Gaps are possessive loops over one letter class, which need no stack. A rule begun but never ended takes
    the rest of the string (group 1), so that it is read once and not once from each beginning.
    """
    letters = [LETTERS[i] for i in ids]
    begun = ""
    for x, y in reversed(list(zip(letters, letters[1:]))):
        begun = f"{x}[^{y}]*+" + (f"(?:{begun})?+" if begun else "")
    return (rf"({begun}\z)|" if begun else "") + letters[0] + "".join(f"([^{x}]*+){x}" for x in letters[1:])


def _holds(ids: tuple[str, ...]) -> str:
    """The identifiers in order, sought once from the start."""
    return r"\A" + "".join(f"[^{x}]*+{x}" for x in (LETTERS[i] for i in ids))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, ``sentence_ids``, ``licences`` (distinct, in rule order), ``n_sentences``.

    A null or empty text has no sentences. Rows are independent, so repeated rows give repeated results; an
    empty table gives no rows. Other columns are not read. A rule that fits several times takes all its
    matches.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hint = F.lower(body).rlike("|".join(ANCHORS))
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.when(hint, sequence(body)).otherwise(F.array().cast("array<string>")).alias("ids"))
    letters = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k, v)])
    rows = rows.withColumn("left", F.array_join(F.transform("ids", lambda x: F.element_at(letters, x)), "")).withColumn("found", F.array().cast("array<string>"))
    for licence, ids in CHAINS:
        hit = F.col("left").rlike(_holds(ids))
        rest = F.regexp_replace("left", _pattern(ids), "".join(f"${i + 1}" for i in range(len(ids))) if len(ids) > 1 else "")
        rows = rows.select("_key", "ids", F.when(hit, F.array_union("found", F.array(F.lit(licence)))).otherwise(F.col("found")).alias("found"), F.when(hit, rest).otherwise(F.col("left")).alias("left"))
    single = F.array(*[F.struct(F.lit(licence).alias("name"), F.lit(LETTERS[x]).alias("letter")) for licence, x in SINGLE])
    more = F.transform(F.filter(single, lambda r: F.contains(F.col("left"), r["letter"])), lambda r: r["name"])
    rows = rows.withColumn("found", F.when(F.col("left") != "", F.array_union("found", more)).otherwise(F.col("found")))
    return rows.select(F.col("_key").alias(key), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("found", ",").alias("licences"), F.size("ids").cast("long").alias("n_sentences"))
