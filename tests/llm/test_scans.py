"""PII, secrets and licences against plain regular expressions and fixed texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from adcorpus.llm.licenses import licenses
from adcorpus.llm.pii import finder, joined, pii_spans, pii_summary
from adcorpus.llm.secrets import secret_spans, secret_summary

from llm_cases import make_docs, prose


def luhn(digits):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return joined(out)


def test_base_spans_equal_the_patterns():
    find, rng = finder(), random.Random(1)
    for n in range(30_000):
        letters = rng.choice(["01.", "12.5 ", "a@.-b", "+1 ().-2", "49 -", "1.@a+ -2é", "0. @"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 26)))
        if n % 5 == 0:
            t += "4111 1111 1111 1111" + rng.choice(letters)
        assert joined(find(t)[0]) == base_pii(t), t


def test_added_spans():
    find = finder()
    cases = {
        "IBAN DE89 3704 0044 0532 0130 00 x": ("account", 5, 32),
        "IBAN DE88 3704 0044 0532 0130 00 x": None,
        "Hauptstraße 12, x": ("address", 0, 14),
        "at 12 Old Kent Road.": ("address", 3, 19),
        "rue de la Paix 5": ("address", 0, 16),
        "a.b (at) c (dot) de": ("spelled", 0, 19),
        "see https://a.b/c?d=1. ok": ("url", 4, 21),
        "account number: 12345678 and": ("account", 16, 24),
        "the road was long": None,
    }
    for text, want in cases.items():
        assert find(text)[1] == ([want] if want else []), text


def test_pii_is_linear_on_anchors_without_end():
    find = finder()
    for unit in ("://", "a@", "@", "+1", "1.", "1 ", "account1", "(at)", "://a", " Street", "rue ", "strasse",
                 "straße", "strasse 5", "a-strasse", "Str. "):
        find(unit * (400_000 // len(unit)))


def test_pii_summary(odd_docs, odd_rows, no_docs, spark):
    got = Counter((r.doc_id, r.base_sha256, r.spans) for r in pii_summary(odd_docs).collect())
    want = Counter((d, hashlib.sha256(base_pii(t or "").encode()).hexdigest(), base_pii(t or "")) for d, t, *_ in odd_rows)
    assert got == want
    assert pii_summary(no_docs).count() == 0 and pii_spans(no_docs).count() == 0
    text = "é x.y@z.io +1 (555) 123-4567, 10.0.0.1"
    docs = make_docs(spark, [(1, text), (2, None)])
    row = pii_summary(docs).where("doc_id = 1").first()
    assert (row.n_email, row.n_phone, row.n_ip, row.n_card, row.spans) == (1, 1, 1, 0, base_pii(text))
    found = {(r.kind, r.value) for r in pii_spans(docs).collect()}
    assert found == {("email", "x.y@z.io"), ("phone", "+1 (555) 123-4567"), ("ip", "10.0.0.1")}


def base_secrets(t):
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def secret_docs(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    any64 = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"{prose(i, 60)} Password = '{any64(24)}' é {hexes(40)} {prose(i + 500, 20)}") for i in range(60)]
    rows += [(100, f"x {any64(40)} and internationalization_of_the_words"), (101, "token=short secret: token=abcdefgh"), (102, "AKIA" + "Q7" * 8)]
    rows += [(103, "password=ab:cdefgh12 passwd"), (104, "AKIAB"), (105, None), (None, hexes(31) + " " + hexes(32))]
    return rows, make_docs(spark, rows)


def test_secrets(spark, odd_docs, odd_rows, no_docs):
    rows, docs = secret_docs(spark)
    got = secret_summary(docs).collect()
    text = {d: t or "" for d, t in rows}
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert ",".join(base) == base_secrets(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base_secrets(text[r.doc_id]).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(base)
    added = [r for r in secret_spans(docs).where("kind = 'random'").collect()]
    assert {(r.doc_id, r.start, r.end) for r in added} == {(100, 2, 42), (None, 0, 31)}
    got = Counter((r.doc_id, r.spans) for r in secret_summary(odd_docs).collect())
    assert got == Counter((d, base_secrets(t or "")) for d, t, *_ in odd_rows)
    assert secret_summary(no_docs).count() == 0


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of HOLDER nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""


def test_licenses(spark, odd_docs, no_docs):
    docs = make_docs(
        spark,
        [
            (1, MIT),
            (2, "Some prose without an end\nReleased under the MIT License.\nmore"),
            (3, "A. Licensed under the Apache License, Version 2.0. B."),
            (4, "// SPDX-License-Identifier: MIT\ncode"),
            (5, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nAll rights reserved."),
            (6, "The license of the river is old. Redistribution of wealth."),
            (7, None),
            (8, "mit der Bahn"),
            (9, BSD.replace("HOLDER", "the University of the River nor its affiliates")),
            (10, BSD[: BSD.index("* Neither")]),
            (11, "# SPDX-License-Identifier: BSD-2-Clause"),
            (12, "/* SPDX-License-Identifier: GPL-2.0-only */"),
            (13, "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
            (14, "                                 Apache License\n                           Version 2.0, January 2004\n   http://www.apache.org/licenses/"),
            (15, "My Tool is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
            (16, "SPDX-License-Identifier: GPL-2.0\nmore words\n"),
        ],
    )
    got = {r.doc_id: r.licenses for r in licenses(docs).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "MIT", 5: "Apache-2.0,Proprietary", 6: "", 7: "", 8: "",
                   9: "BSD-3-Clause", 10: "BSD-2-Clause", 11: "BSD-2-Clause", 12: "GPL-2.0-only", 13: "LGPL-2.1-or-later",
                   14: "Apache-2.0", 15: "GPL-3.0-or-later", 16: "GPL-2.0-only"}
    out = licenses(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r.n_licenses == 0 for r in out)
    assert licenses(no_docs).count() == 0
