"""Licences, PII, quality rules and mixing on odd rows and against brute force."""

import hashlib
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from plinth.llm import licences, mixing, pii, quality_rules
from tests.llm.conftest import PROSE, collected, ordered

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software.

The above copyright notice and this permission notice shall be included in all
copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_licences(spark, odd, empty):
    row = licences.scan(one(spark, MIT)).first()
    assert (row["sentences"], row["licences"], row["unused"]) == ("MitTitle Copyright MitGrant MitNotice MitAsIs", "MIT", "")
    row = licences.scan(one(spark, "// Licensed under the Apache License, Version 2.0. Foo.\n\nReleased under the MIT License.")).first()
    assert row["licences"] == "MIT Apache-2.0"
    rows = licences.scan(odd)
    assert rows.count() == odd.count() and {r["licences"] for r in rows.collect()} == {""}
    assert licences.scan(empty).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP, CARD, PHONE = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute_pii(text):
    out = []
    checks = (("email", EMAIL, lambda v: True), ("ip", IP, lambda v: all(int(p) <= 255 for p in v.split("."))), ("card", CARD, luhn), ("phone", PHONE, lambda v: 9 <= sum(c.isdigit() for c in v) <= 15))
    for kind, regex, valid in checks:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(regex, text, re.ASCII) if valid(m[0])]
    return out


TRICKY = [
    "a@b.c_d@e.f x@y x@y.z. -@-.- é@b.co a.b+c@d-e.f.g, 1@2.3", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 1.2.3.4x", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111111 1 2 3",
    "4111  1111 1111 1111 0000000000000 00000000000000000000 79927398713 " + "4" * 5000, "+1 (017) 555-7713 +1234 +44 20 7946 0958 +12345678901234567 +1-2-3-4-5-6-7-8-9-", "日本 a@b.co 𝒳 +1 (017) 555-7713 ", "", None,
    "x" * 50_000 + "@" + "y" * 100 + ".z", "+1 " * 3000, "1." * 4000, "DE89370400440532013000 DE89370400440532013001 ssn 123-45-6789 " + "far away " * 9 + "123-45-6789",
]


@pytest.mark.parametrize(
    ("text", "sentences", "found"),
    [
        ("Licensed under the Apache License, Version 2.0 or released under the MIT license", "ApacheName MitName", "MIT Apache-2.0"),
        ("Copyright 2020 Foo\nSPDX-License-Identifier: MIT\nAll rights reserved", "Copyright Spdx:MIT AllRights", "MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "Spdx:GPL-2.0-only SpdxWith:Linux-syscall-note Spdx:BSD-3-Clause", "GPL-2.0-only BSD-3-Clause"),
        ("This software is provided by the authors, released under the MIT license, as is", "BsdAsIs MitName", "MIT"),
        *((f"{c} Permission is hereby granted, free of charge, to any person obtaining a copy\n{c} of this software", "MitGrant", "MIT") for c in ("//", "--", "///", ";;", "!", "#", " *", '.\\"')),
        ("/* Permission is hereby granted, free of charge, to any person obtaining a copy */\n/* of this software */", "MitGrant", "MIT"),
        ("licensed under CC BY-NC-SA 4.0", "CcByNcSa", "CC-BY-NC-SA"),
    ],
)
def test_all_licences_of_a_sentence(spark, text, sentences, found):
    row = licences.scan(one(spark, text)).first()
    assert (row["sentences"], row["licences"]) == (sentences, found)


GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version {1} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

You should have received a copy of the GNU {0}General Public License
along with this program."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of the copyright holder may be used to endorse or promote products derived from this software.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "AS IS"."""
WHOLE = {
    GNU.format("", 3): "GPL-3.0-or-later", GNU.format("", 2): "GPL-2.0-or-later", GNU.format("Lesser ", "2.1"): "LGPL-2.1-or-later", GNU.format("Lesser ", 3): "LGPL-3.0-or-later", GNU.format("Affero ", 3): "AGPL-3.0-or-later",
    GNU.format("", 3).replace(", or\n(at your option) any later version", ""): "GPL-3.0", GNU.format("Lesser ", "2.1").replace(", or\n(at your option) any later version", ""): "LGPL-2.1",
    "\n".join("# " + x for x in GNU.format("", 3).split("\n")): "GPL-3.0-or-later", BSD: "BSD-3-Clause", MIT: "MIT",
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007": "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991": "GPL-2.0",
    "MIT License\n\nCopyright (c) 2020 X": "MIT", "MIT License\nCopyright (c) 2020 X": "MIT", "ISC License\n\nCopyright (c) 2020, X": "ISC", "BSD 3-Clause License\n\nCopyright (c) 2020, X": "BSD-3-Clause", "Licensed under MIT.": "MIT", "licensed under MIT": "MIT",
    "GNU Lesser General Public License v3.0": "LGPL-3.0", "licensed under the LGPL-2.1 or (at your option) any later version": "LGPL-2.1-or-later", "released under the GPLv3": "GPL-3.0", "licensed under Apache-2.0": "Apache-2.0", "Mozilla Public License Version 2.0": "MPL-2.0",
    "this software is provided by the sea. As is": "", "under the 3-Clause BSD License": "", "available under the 3-Clause BSD License": "BSD-3-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications.": "Zlib",
    "This is free and unencumbered software released into the public domain.": "Unlicense", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "under the Eclipse Public License v2.0": "EPL-2.0",
    "Copyright 2019 Big Corp. All rights reserved.": "Proprietary", "This is not released under the MIT License.": "", "It is no longer licensed under the GNU General Public License version 3": "",
    "licensed under the GNU General Public License version 3, all rights reserved": "GPL-3.0", "": "", "SPDX-License-Identifier: MIT OR (Apache-2.0 WITH LLVM-exception)": "MIT Apache-2.0",
}


def test_whole_licence_texts(spark):
    import duckdb

    texts = list(enumerate(WHOLE))
    got = licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {t: r["licences"] for (_, t), r in zip(texts, sorted(got), strict=True)} == WHOLE
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    assert ordered(con.execute(licences.SQL).fetchall()) == ordered(tuple(r) for r in got)


COMMON = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_published_licence_texts(spark):
    """Whole texts as published, as the machine has them, each one licence and no other; bodies without their heads, too."""
    texts = {n: open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read() for n in COMMON}
    rows = [(n, t) for n, t in texts.items()] + [(f"{n} body", t[400:]) for n, t in texts.items() if n in ("Apache-2.0", "GPL-3", "MPL-2.0")] + [(f"{n} head", t[:300]) for n, t in texts.items() if n not in ("BSD", "LGPL-2")]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {n: got[n] for n in texts} == COMMON
    assert {n: x.split()[:1] for n, x in got.items()} == {n: [COMMON[n.split()[0]]] for n in got}


N = 100_000
HARD = {
    "SPDX-License-Identifier: MIT" + " or MIT" * N: "MIT", "SPDX-License-Identifier: " + "(" * N + "MIT": "MIT", "SPDX-License-Identifier: MIT" + "." * N: "MIT", "license " + "*" * (10 * N): "", "license " + "*/ " * N + "x": "",
    "license" + " " * (10 * N) + "x": "", "licensed under the MIT license" + "\n" * (10 * N): "MIT", "this software is provided by the " * (N // 3): "", "as" + "-" * (10 * N) + "x": "", "license. " * N: "", "licensed " * N: "", "not " * N + "licensed": "",
    "spdx-license-identifier: " * (N // 3) + "MIT": "spdx-license-identifier MIT", "released under the mit license " * (N // 3): "MIT", "license" + "\n \n " * N: "", "/" * (10 * N) + " license": "", "license a" + "a" * (10 * N): "",
}


def test_hard_texts_of_a_million_characters(spark):
    """No stack overflow, and linear time: quadratic forms take hours."""
    began = time.monotonic()
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(rows).collect()}
    assert got == {i: x for i, x in enumerate(HARD.values())}
    assert time.monotonic() - began < 120


def test_pii(spark, odd, empty):
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.digests(pii.find(rows)).collect():
        want = brute_pii(TRICKY[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), TRICKY[r["doc_id"]]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE] == want
        assert r["n_email"] == sum(w.startswith("email") for w in want)
    last = [s.kind for s in pii.find(rows).where(f"doc_id = {len(TRICKY) - 1}").first()["spans"]]
    assert last == ["iban", "ssn"]
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0


def test_context_raises_and_lowers(spark):
    import duckdb

    texts = [
        "GB82 WEST 1234 5698 7654 32", "IBAN GB82 WEST 1234 5698 7654 32 AND MORE", "NO93 8601 1117 947 THE", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "xDE89370400440532013000",
        "DE89370400440532013000 is the serial key", "the serial of the bank account DE89370400440532013000", "000-12-3456 ssn", "666-12-1234 ssn", "123-00-4567 ssn", "123-45-0000 ssn",
        "my ssn 123-45-6789", "123-45-6789 is my SSN", "order 123-45-6789 ssn", "classn 123-45-6789", "ship 10.0.0.1", "ip 10.0.0.1 there", "BE68 5390 0754 7034 GB82", "a@b.co is an example", "GB82 WEST 1234 5698 7654 33",
    ]
    want = [
        "iban:0:27", "iban:5:32", "iban:0:18", "iban:0:27", "iban:0:22", "", "", "iban:31:53", "", "", "", "", "ssn:7:18", "ssn:0:11", "", "", "ip:5:13", "ip:3:11", "iban:0:19", "email:0:6", "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.digests(pii.find(rows)).collect()
    assert [r["spans"] for r in sorted(got)] == want
    assert [r["scores"] for r in sorted(got) if r["spans"]] == ["70", "90", "70", "70", "70", "60", "60", "60", "60", "80", "70", "40"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert ordered(con.execute(pii.SQL).fetchall()) == ordered(tuple(r) for r in got)


def test_redaction(spark, odd, empty):
    row = pii.redact(spark.createDataFrame([(1, "to a@b.co, +1 (017) 555-7713!", 29)], "doc_id long, text string, n_chars long")).first()
    assert (row["text"], row["n_chars"]) == ("to [EMAIL], [PHONE]!", 20)
    got = pii.redact(odd)
    assert got.columns == odd.columns and got.count() == odd.count() and pii.redact(empty).count() == 0
    assert ordered(collected(got.where("doc_id != 5 or doc_id is null"))) == ordered(collected(odd.where("doc_id != 5 or doc_id is null")))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


REPEATS = ["a b c d e f", "a b c d e a b c d e", "a a a a a a a a", "a b c d e f a b c d e x\na b c d e f a b c d e x\n\n \n", "x " * 5, "x " * 4, "one\ntwo\none\none\n  \n|#*", "é 𝒳 ñ w v", "", None]


def test_quality_rules(spark, odd, empty):
    rows = spark.createDataFrame(list(enumerate(REPEATS)), "doc_id long, text string")
    for r in quality_rules.judge(rows).collect():
        want = brute_counts(REPEATS[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, REPEATS[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["kept"] and r["base_failed"])
    judged = quality_rules.judge(odd)
    assert judged.count() == odd.count() and quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and quality_rules.keep_good(empty).count() == 0
    assert kept.count() == judged.where("kept").count() and [r["text"] for r in kept.where("doc_id = 2").collect()] == [PROSE]


def test_clean_corpus_stays(spark):
    rows = spark.createDataFrame([(i, f"{PROSE} {i} and so the story number {i} goes on.\nIt ends here {i}.") for i in range(200)], "doc_id long, text string")
    assert quality_rules.keep_good(rows).count() == 200


@pytest.mark.parametrize("shares", [[100] * 6, [1000, 1, 1, 1], [5], [0, 10]])
def test_targets(spark, shares):
    sizes = spark.createDataFrame([(f"s{i}", False, n) for i, n in enumerate(shares)], "source string, no_source boolean, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weights = [(5, 2, 1)[i % 3] for i in range(len(shares))]
    total, capped = 1.5 * sum(shares), set()
    while True:
        rest = total - sum(2 * shares[i] for i in capped)
        free = [i for i in range(len(shares)) if i not in capped]
        level = rest / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > 2 * shares[i]}
        if not over:
            break
        capped |= over
    want = {f"s{i}": 2.0 * shares[i] if i in capped else level * weights[i] for i in range(len(shares))}
    assert got == pytest.approx(want)


def test_mix(spark, odd, empty):
    rows = mixing.mix(odd)
    assert rows.count() == odd.count() and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows.collect())
    again = mixing.mix(odd.repartition(5))
    assert ordered(collected(rows)) == ordered(collected(again))
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns
    words = copies.select(F.sum(F.size(F.array_remove(F.split("text", "[ \t-\r]+"), ""))).alias("n")).first()["n"]
    assert words == rows.agg(F.sum("taken")).first()[0]


def test_mix_comes_near(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 50), "s" if i % 3 else "t", "u") for i in range(3000)], "doc_id long, text string, source string, extra string")
    got = mixing.mix(rows)
    sums = spark.createDataFrame([(i, "s" if i % 3 else "t") for i in range(3000)], "doc_id long, source string").join(got, "doc_id")
    for r in sums.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 50


def test_equal_rows_are_taken_singly(spark):
    equal = [(7, "w " * 10, "s", i % 3) for i in range(100)] + [(8, "v " * 10, "t", 0)] * 50 + [(9, "u " * 7, "t", 0)]
    rows = spark.createDataFrame(equal, "doc_id long, text string, source string, extra int").repartition(7)
    got = mixing.mix(rows)
    sums = got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 2 and all(abs(r["taken"] - r["target"]) <= 5 for r in sums)
    assert all(r["taken"] <= 2 * r["size"] for r in got.collect())
    assert ordered(collected(got)) == ordered(collected(mixing.mix(rows.repartition(3))))
    copies = mixing.mixed(rows)
    words = copies.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n"))
    assert sorted(r["n"] for r in words.collect()) == sorted(r["taken"] for r in sums)


def test_mix_of_repeats_against_sql(spark):
    import duckdb

    rows = [(i % 40, "w " * (i % 40 % 9 + 1), "abc"[i % 40 % 3]) for i in range(400)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.execute(mixing.SQL).fetchall()
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert ordered(collected(got)) == ordered(want)


def test_posterior_overrules_votes(spark):
    """A document with a bad vote stays, one without is rejected: what votes are worth is learnt."""
    prose = [f"{PROSE} {i} and so the story number {i} goes on.\nIt ends here {i}." for i in range(300)]
    marked = [t + " Oh no! Oh my! Oh dear! Is it so? Or not? Or what? Why?" for t in prose[:30]]
    noisy = [" ".join(f"#{i}{k} $%&*" for k in range(30)) + f" number {i}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(prose + marked + noisy)), "doc_id long, text string")
    got = quality_rules.judge(rows).collect()
    assert all(r["kept"] for r in got if r["doc_id"] < 330) and any("1" in r["pattern"] for r in got if 300 <= r["doc_id"] < 330)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 330) and all(r["kept"] == (r["posterior"] >= 0.5 and not r["base_failed"]) for r in got)
    bad = [" ".join(f"x{i}#{k} $%&*" for k in range(25)) + f" number {i}" for i in range(300)]
    bare = " ".join(f"stretchedwordlike{i:02d}" for i in range(12)).replace("0", "o").replace("1", "l")
    got = quality_rules.judge(spark.createDataFrame([*enumerate(bad), (999, bare)], "doc_id long, text string")).where("doc_id = 999").first()
    assert got["pattern"].count("1") <= 2


def test_names_do_not_clash(spark):
    names = "doc_id long, text string, source string, n_chars long, c int, q int, row int, pattern string, base_failed boolean, kept boolean, posterior double, own int, file string, place int, nth int, cut int, new string, fp long, hash long, `a.b` int, __row int, __c int, __new string"
    rows = spark.createDataFrame([(1, PROSE + " mail a@b.co", "s", 5, *([1] * 3), "p", True, False, 0.5, 1, "f", 1, 1, 1, "n", 1, 1, 1, 1, 1, "n")] * 3, names)
    from plinth.llm import simhash

    for made, n in ((quality_rules.keep_good(rows), 3), (pii.redact(rows), 3), (mixing.mixed(rows), None), (simhash.deduplicate(rows), 1)):
        assert made.columns == rows.columns
        kept = made.drop("text", "n_chars").collect()
        assert (n is None or len(kept) == n) and set(kept) == set(rows.drop("text", "n_chars").collect())
