"""Cases in which the operators once did less than the whole job."""

from __future__ import annotations

import random
import string
import textwrap

import numpy as np
import pytest

from lumenfield.llm import licences, quality, secret_spans
from tests.conftest import DATA

# --- licences: published notices -------------------------------------------------------------------------

APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
GPL = """This file is part of Foo.

Foo is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Foo is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright (c) 2021 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
NOTICES = {
    "apache": (APACHE, "apache2,apache2-comply,apache2-copy,apache2-basis", "Apache-2.0"),
    "mit": (MIT, "mit-permit,mit-notice,mit-asis", "MIT"),
    "gpl;": (GPL.format(";"), "gpl-program,gpl-later", "GPL-3.0-or-later"),
    "gpl:": (GPL.format(":"), "gpl-program,gpl-later", "GPL-3.0-or-later"),
    "bsd": (BSD, "reserved,bsd-permit,bsd-source,bsd-binary,bsd-endorse", "BSD-3-Clause,proprietary"),
    "bsd two": (BSD[: BSD.index("3. Neither")].rstrip(), "reserved,bsd-permit,bsd-source,bsd-binary", "BSD-2-Clause,proprietary"),
    "gpl2": (GPL.format(";").replace("version 3", "version 2"), "gpl-program,gpl2-later", "GPL-2.0-or-later"),
    "lgpl": (GPL.format(";").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "lgpl-program,lgpl21-later", "LGPL-2.1-or-later"),
    "agpl": (GPL.format(";").replace("GNU General", "GNU Affero General"), "agpl-program,gpl-later", "AGPL-3.0-or-later"),
    "mpl": (MPL, "mpl2", "MPL-2.0"),
    "isc": (ISC, "isc", "ISC"),
    "bsd bullets": (BSD.replace("1.", "*").replace("2.", "(b)"), "reserved,bsd-permit,bsd-source,bsd-binary,bsd-endorse", "BSD-3-Clause,proprietary"),
}


def _layouts(text: str) -> dict[str, str]:
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    lines = text.split("\n")
    return {
        "as published": text,
        "crlf": text.replace("\n", "\r\n"),
        "narrow": "\n\n".join("\n".join(textwrap.wrap(p, 30)) for p in paragraphs),
        "paragraphs": "\n\n".join(paragraphs),
        "one line": " ".join(paragraphs),
        "block comment": "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint x;",
        "hash comment": "\n".join(f"# {x}".rstrip() for x in lines),
        "slashes": "\n".join(f"// {x}".rstrip() for x in lines),
        "dnl": "\n".join(f"dnl {x}".rstrip() for x in lines),
    }


def test_published_notices(spark):
    """A copyright line without a full stop hides 'all rights reserved' on one line; all else is found in every layout."""
    rows = [((n, k), t) for n, (text, *_) in NOTICES.items() for k, t in _layouts(text).items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {rows[r.doc_id][0]: (r.sentence_ids, r.licences) for r in licences.scan(df).collect()}
    for (notice, layout), found in got.items():
        _, ids, names = NOTICES[notice]
        if layout in ("one line", "paragraphs", "narrow"):
            ids, names = ids.removeprefix("reserved,"), names.removesuffix(",proprietary")
            found = (found[0].removeprefix("reserved,"), found[1].removesuffix(",proprietary"))
        assert found == (ids, names), (notice, layout)


@pytest.mark.parametrize(
    "text",
    [
        MIT.replace("without restriction,", "without restriction except for sale,").replace("and to permit", "or not to permit"),
        "This was not released under the MIT License.",
        "All\n\nrights reserved.",
    ],
)
def test_other_wordings_are_no_licence(spark, text):
    assert licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licences == ""


def test_short_names_and_creative_commons(spark):
    """One line names one licence, in code or prose; a longer name is not taken for the shorter one it begins with."""
    rows = [(f"// SPDX-License-Identifier: {n}\nint x;", n) for n in licences.SPDX] + [(f"# Tool\n# SPDX-License-Identifier: {n}", n) for n in licences.SPDX]
    rows += [("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0")]
    rows += [("SPDX-License-Identifier: MIT\nReleased under the MIT License.\nSPDX-License-Identifier: ISC", "MIT,ISC"), ("SPDX-License-Identifier: LicenseRef-Own", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for _, n in rows]
    assert len({n for n, _ in licences.RULES}) >= 40


def test_many_known_sentences_need_no_stack(spark):
    """An opening sentence before many known sentences, with and without an end; the brute force agrees."""
    s = licences.SENTENCES
    rows = [
        (1, ". ".join([s["mit-permit"], *[s["mit"]] * 20_000])),
        (2, ". ".join([s["mit-permit"], *[s["reserved"]] * 20_000, s["mit-notice"]])),
        (3, ". ".join([s["gpl-program"]] * 20_000)),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_sentences) for r in got} == {1: ("MIT", 20_001), 2: ("MIT,proprietary", 20_002), 3: ("", 20_000)}


# --- secrets: private keys -------------------------------------------------------------------------------


def _key(seed: int, kind: str = "RSA ", brk: str = "\n", lines: int = 8, foot: bool = True) -> str:
    r = random.Random(seed)
    body = ["".join(r.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(lines)] + [f"tail{seed}=="]
    return f"-----BEGIN {kind}PRIVATE KEY-----{brk}" + brk.join(body) + (f"{brk}-----END {kind}PRIVATE KEY-----" if foot else "")


def test_private_keys_are_judged_and_redacted_whole(spark):
    """Keys of many sources are each live; one key in many sources is an example; no part of a live key stays."""
    rows = [(i, f"before {_key(i)} after", "en", f"s{i}") for i in range(6)]
    rows += [(10 + i, f"before {_key(99, brk=['\r\n', '\n'][i % 2])} after", "en", f"s{i}") for i in range(4)]
    crypted = _key(31).replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n", 1)
    rows += [
        (20, f"before {_key(20, 'EC ', brk=chr(92) + 'n')} after", "en", "s0"),  # escaped breaks
        (21, f"before {crypted} after", "en", "s1"),
        (22, f"before {_key(22, foot=False)}\nafter", "en", "s2"),
        (23, f"before {_key(23, foot=False)}\n{_key(24, '')} after", "en", "s3"),
        (24, f"before {_key(25, lines=20_000)} after", "en", "s4"),  # no stack overflow
        (25, "before -----BEGIN RSA PRIVATE KEY----- opens a key that one day ends in -----END RSA PRIVATE KEY----- after", "en", "s5"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.id: [s for s in r.spans if s.kind == "header"] for r in secret_spans.scan(df).collect()}
    clean = {r.doc_id: r.text for r in secret_spans.redact(df).collect()}
    for k, text, *_ in rows:
        if k < 10 or k in (20, 21, 24):
            assert [(s.start, s.end, s.live, s.owners) for s in found[k]] == [(7, len(text) - 6, True, 1)], k
            assert clean[k] == "before [secret] after", k
    for k in range(10, 14):
        assert not found[k] and clean[k] == dict((k, t) for k, t, *_ in rows)[k]
    assert clean[22] == "before [secret]\nafter"
    assert len(found[23]) == 2 and clean[23] == "before [secret]\n[secret] after"
    assert not found[25] and clean[25] == rows[-1][1]


# --- quality: every row with words is judged -------------------------------------------------------------


def _mcd(x: np.ndarray):
    """Distance function of the robust estimate over the rows of ``x`` (ten-thousandths), in plain NumPy."""
    floor = np.array(list(quality.FLOOR.values()))
    bins = lambda d2: np.floor(quality.BINS * np.log2(d2 + 1e-9))

    def core(d2, share):
        b = bins(d2)
        return np.array([(b < v).sum() < share * len(b) for v in b])

    centre, inverse = np.median(np.trunc(x / (quality.UNIT // 20)), axis=0) / 20, np.diag(floor**-2)
    distance = lambda y: np.einsum("ij,jk,ik->i", y / quality.UNIT - centre, inverse, y / quality.UNIT - centre)
    for _ in range(quality.STEPS):
        near = x[core(distance(x), quality.COVER)] / quality.UNIT
        centre, inverse = near.mean(0), np.linalg.inv(np.cov(near.T, bias=True).reshape(5, 5) + np.diag(floor**2))
    d2 = distance(x)
    middle = bins(d2)[core(d2, 0.5)].max()
    scale = min(quality.MEDIAN_CHI2_5 / 2 ** ((middle + 1) / quality.BINS), quality.MAX_SCALE)
    return lambda y: distance(y) * scale


@pytest.mark.parametrize("min_group", [7, 26, 1000])
def test_quality_distances_of_all_levels(spark, min_group):
    """Own group, else all rows of the language, else all rows: distances and verdicts as NumPy has them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = quality.judge(docs, min_group=min_group).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    rows = got[got.n_words > 0].reset_index(drop=True)
    w, c = rows.n_words.to_numpy(float), rows.word_chars.to_numpy(float)
    x = np.stack([np.log1p(w), np.log(c / w), rows.n_symbols / c, np.log1p(rows.n_dup_lines), np.arcsin(np.sqrt(rows.n_repeat_words / w))], axis=1)
    x, want, levels = np.floor(x * quality.UNIT + 0.5), np.full(len(rows), np.nan), set()
    for (lang, source), part in rows.groupby(["lang", "source"]):
        level = 0 if len(part) >= min_group else 1 if (rows.lang == lang).sum() >= min_group else 2
        base = [(rows.lang == lang) & (rows.source == source), rows.lang == lang, rows.lang == rows.lang][level]
        want[part.index] = _mcd(x[base.to_numpy()])(x[part.index])
        levels.add(level)
    assert levels == {7: {0, 1}, 26: {1, 2}, 1000: {2}}[min_group]
    assert np.allclose(rows.distance.astype(float), want, rtol=1e-5, atol=1e-6)
    assert (rows.kept == (~rows.base_failed & (want <= quality.CUT))).all()


def test_quality_judges_a_small_source(spark):
    """199 rows of junk in a source of their own go, in a language that is judged and in one that is too small."""
    prose = [(i, " ".join(f"word{(i * 7 + j * 13) % 997}" for j in range(60 + i % 50)), "en", "a") for i in range(600)]
    junk = [(1000 + i, " ".join(f"#%*{j}&&$|<>{i}" for j in range(60)), "en" if i < 150 else "xx", "small") for i in range(199)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i, *_ in prose) and not any(kept[i] for i, *_ in junk)


def test_quality_cut_takes_junk_and_leaves_clean_rows(spark):
    """Labels of the scale the cut was not fitted on; only rows that pass the base rule."""
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.985 and np.mean(kept[0]) < 0.2
