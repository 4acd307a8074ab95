"""Licence scan by sentence rules, in DataFrame functions only.

A text without the marks of comments is cut into sentences, each is normalised
(lower case, only letters, digits and ``. + / : -``, single spaces), and every known
licence phrase in it gets an identifier, unless it is denied ("not released under
..."). Each licence of an SPDX tag has its own, ``Spdx:`` and the id, which names
the licence; exceptions (``SpdxWith:``) stay unused. The identifiers, in order, form
a sequence, against which the licence rules are tried in order; what a rule matches
is used up, so that a later, more general rule doesn't match it again. The rules of
LAST come after all others and only count where none did: reserved rights stand in
the notices of free licences, too. Identifiers that no rule uses are reported.

Defined results: null or empty text, and text without known sentences, has an
empty sequence and no licences; a very long text is read whole, in the row's own
memory; repeated rows give a result each; a null doc_id stays null; an empty table
gives an empty result. Other columns of the input, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import let, text_of

# Identifiers and expressions of known licence sentences, after normalisation, in the order in which they are looked for.
SENTENCES = (
    ("MitTitle", r"^(the )?mit license"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind"),
    ("MitName", r"(released|licensed|distributed|available|provided) under (the )?(terms of the )?mit( license)?[.]?( |$)"),
    ("IscTitle", r"^(the )?isc license"),
    ("IscGrant", r"permission to use copy modify and/or distribute this software for any purpose"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties"),
    ("IscName", r"(released|licensed|distributed|available) under (the )?(terms of the )?isc license"),
    ("ApacheTitle", r"apache license version 2.0 january 2004"),
    ("ApacheTerms", r"terms and conditions for use reproduction and distribution"),
    ("ApacheGrant", r"grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license"),
    ("ApachePatents", r"grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable (except as stated in this section )?patent license"),
    ("ApacheName", r"(released|licensed|distributed|available) under (the )?(terms of the )?apache( license|-|,)?( version | v| |-)?2(.0)?"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheBasis", r"distributed under the license is distributed on an as is basis"),
    ("BsdTitle2", r"^(the )?bsd 2-clause license"),
    ("BsdTitle3", r"^(the )?bsd 3-clause license"),
    ("BsdUse", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BsdEndorse", r"may be used to endorse or promote products derived from this software"),
    ("BsdAsIs", r"this software is provided by the .*as is"),
    ("BsdName3", r"(released|licensed|distributed|available) under (the )?(terms of the )?(bsd[ -]3[ -]clause|3-clause bsd|new bsd|modified bsd)( license)?"),
    ("BsdName2", r"(released|licensed|distributed|available) under (the )?(terms of the )?(bsd[ -]2[ -]clause|2-clause bsd|simplified bsd)( license)?"),
    ("BsdName", r"(released|licensed|distributed|available) under (the |a )?(terms of the )?bsd( license)?[.]?( |$)"),
    ("Agpl3Title", r"gnu affero general public license version 3 19 november 2007"),
    ("Lgpl3Title", r"gnu lesser general public license version 3 29 june 2007"),
    ("Lgpl21Title", r"gnu lesser general public license version 2.1 february 1999"),
    ("Lgpl2Title", r"gnu library general public license version 2 june 1991"),
    ("Gpl3Title", r"gnu general public license version 3 29 june 2007"),
    ("Gpl2Title", r"gnu general public license version 2 june 1991"),
    ("Gpl1Title", r"gnu general public license version 1 february 1989"),
    ("GnuVerbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("Agpl3Body", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("Gpl3Body", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("Gpl3Intent", r"the gnu general public license is intended to guarantee your freedom to share and change all versions of a program"),
    ("Gpl2Body", r"the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("Lgpl3Body", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("Lgpl21Body", r"this license the lesser general public license applies to some specially designated software packages"),
    ("Lgpl2Body", r"this license the library general public license applies to some specially designated free software foundation software"),
    ("AgplCopy", r"received a copy of the gnu affero general public license"),
    ("LgplCopy", r"received a copy of the gnu (lesser|library) general public license"),
    ("AgplFree", r"redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("LgplFree", r"redistribute it and/or modify it under the terms of the gnu (lesser|library) general public license"),
    ("GplFree", r"redistribute it and/or modify it under the terms of the gnu general public license"),
    ("Agpl3Name", r"(gnu affero general public license|gnu agpl|agpl)( |-|, )?(version |v)?3(.0)?"),
    ("AgplName", r"gnu affero general public license"),
    ("Lgpl3Name", r"(gnu (lesser|library) general public license|gnu lgpl|lgpl)( |-)?(version |v)?3(.0)?"),
    ("Lgpl21Name", r"(gnu (lesser|library) general public license|gnu lgpl|lgpl)( |-)?(version |v)?2.1"),
    ("Lgpl2Name", r"(gnu (lesser|library) general public license|gnu lgpl|lgpl)( |-)?(version |v)?2(.0)?"),
    ("LgplName", r"gnu (lesser|library) general public license"),
    ("Gpl3Name", r"(released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?(general public license|gpl)( |-)?(version |v)?3(.0)?"),
    ("Gpl2Name", r"(released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?(general public license|gpl)( |-)?(version |v)?2(.0)?"),
    ("GplWarranty", r"distributed in the hope that it will be useful but without any warranty"),
    ("GplCopy", r"you should have received a copy of the gnu general public license"),
    ("Later21", r"version 2.1 of the license or at your option any later version"),
    ("Later3", r"version 3 of the license or at your option any later version"),
    ("Later2", r"version 2 of the license or at your option any later version"),
    ("Later1", r"version 1 or at your option any later version"),
    ("Version21", r"version 2.1 of the license"),
    ("Version3", r"version 3 of the license"),
    ("Version2", r"version 2 of the license"),
    ("OrLater", r"or at your option any later version"),
    ("Mpl2Title", r"^mozilla public license version 2.0"),
    ("Mpl11Title", r"^mozilla public license version 1.1"),
    ("MplGrant", r"each contributor hereby grants you a world-wide royalty-free non-exclusive license"),
    ("MplName", r"subject to the terms of the mozilla public license( v. 2.0)?"),
    ("MplVersion", r"(released|licensed|distributed|available) under (the )?(terms of the )?mozilla public license (version |v. ?|v)?2(.0)?"),
    ("MplCopy", r"https?://(www.)?mozilla.org/mpl/2.0"),
    ("Epl2Name", r"eclipse public license (- )?(version |v)?(. )?2.0"),
    ("Epl1Name", r"eclipse public license (- )?(version |v)?(. )?1.0"),
    ("EuplName", r"european union public licen[cs]e"),
    ("CddlName", r"common development and distribution license"),
    ("BoostName", r"boost software license (- )?(version |v)?1.0"),
    ("WtfplName", r"do what the fuck you want to public license"),
    ("ZlibAsIs", r"this software is provided as-is without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("CcByNcSa", r"licensed under (a )?(cc|creative commons) (by|attribution)-(nc|noncommercial)-(sa|sharealike)"),
    ("CcByNcNd", r"licensed under (a )?(cc|creative commons) (by|attribution)-(nc|noncommercial)-(nd|noderivatives)"),
    ("CcByNc", r"licensed under (a )?(cc|creative commons) (by|attribution)-(nc|noncommercial)"),
    ("CcBySa", r"licensed under (a )?(cc|creative commons) (by|attribution)-(sa|sharealike)"),
    ("CcByNd", r"licensed under (a )?(cc|creative commons) (by|attribution)-(nd|noderivatives)"),
    ("CcBy", r"licensed under (a )?(cc|creative commons) (by|attribution)"),
    ("CcZeroTitle", r"cc0 1.0 universal"),
    ("CcZero", r"(cc0 1.0|creative commons zero|public domain dedication)"),
    ("PublicDomain", r"(free and unencumbered software )?released into the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (c )?[0-9]{4}"),
)
#: Rules of the GNU licences' notices: with the version, or any later one, and as much of the notice as there is.
_NOTICES = tuple(
    (f"{name}-{number}{later}", f"{name.capitalize()}Free {kind}{version}{rest.format(name.capitalize())}")
    for rest in (" GplWarranty {}Copy", " GplWarranty", "")
    for name in ("AGPL", "LGPL", "GPL")
    for number, version in (("3.0", "3"), ("2.1", "21"), ("2.0", "2"))
    for later, kind in (("-or-later", "Later"), ("", "Version"))
)
# Licences and the identifier sequences that stand for them, in the order in which they are tried: whole texts, notices, parts, titles, names.
LICENCES = (
    ("Apache-2.0", "ApacheTitle ApacheTerms ApacheGrant ApachePatents ApacheName ApacheCopy ApacheBasis"),
    ("Apache-2.0", "ApacheTitle ApacheTerms ApacheGrant ApachePatents"),
    ("GPL-3.0", "Gpl3Title Copyright GnuVerbatim Gpl3Body Gpl3Intent AgplName AgplName AgplName GplFree Later3 GplWarranty GplCopy LgplName"),
    ("GPL-3.0", "Gpl3Title Copyright GnuVerbatim Gpl3Body Gpl3Intent AgplName AgplName AgplName"),
    ("GPL-3.0", "Gpl3Body Gpl3Intent AgplName AgplName AgplName GplFree Later3 GplWarranty GplCopy LgplName"),
    ("GPL-3.0", "Gpl3Intent AgplName AgplName AgplName GplFree Later3 GplWarranty GplCopy LgplName"),
    ("GPL-2.0", "Gpl2Title Copyright GnuVerbatim Gpl2Body LgplName GplFree Later2 GplWarranty GplCopy LgplName"),
    ("GPL-2.0", "Gpl2Title Copyright GnuVerbatim Gpl2Body LgplName"),
    ("GPL-2.0", "Gpl2Body LgplName GplFree Later2 GplWarranty GplCopy LgplName"),
    ("GPL-1.0", "Gpl1Title Copyright GnuVerbatim GplFree GplWarranty GplCopy"),
    ("LGPL-3.0", "Lgpl3Title Copyright GnuVerbatim Lgpl3Body LgplName LgplName LgplName LgplName LgplName LgplName LgplName"),
    ("LGPL-2.1", "Lgpl21Title Copyright GnuVerbatim Lgpl21Body LgplName LgplName LgplFree Later21 GplWarranty LgplName LgplCopy"),
    ("LGPL-2.0", "Lgpl2Title Copyright GnuVerbatim Lgpl2Body LgplName LgplName LgplFree Later2 GplWarranty LgplName LgplCopy"),
    ("AGPL-3.0", "Agpl3Title Copyright GnuVerbatim Agpl3Body"),
    ("MPL-2.0", "Mpl2Title Lgpl21Name Agpl3Name MplGrant MplName MplCopy"),
    ("MPL-2.0", "Lgpl21Name Agpl3Name MplGrant MplName MplCopy"),
    ("MPL-1.1", "Mpl11Title MplGrant ApacheCopy ApacheBasis AllRights"),
    ("MPL-1.1", "MplGrant ApacheCopy ApacheBasis AllRights"),
    ("MIT", "MitTitle Copyright MitGrant MitNotice MitAsIs"),
    ("MIT", "MitTitle MitGrant MitNotice MitAsIs"),
    ("MIT", "MitGrant MitNotice MitAsIs"),
    ("ISC", "IscTitle Copyright IscGrant IscAsIs"),
    ("ISC", "IscGrant IscAsIs"),
    ("ISC", "IscGrant MitAsIs"),
    ("BSD-4-Clause", "BsdUse BsdSource BsdBinary BsdAdvert BsdEndorse BsdAsIs"),
    ("BSD-3-Clause", "BsdTitle3 Copyright AllRights BsdUse BsdSource BsdBinary BsdEndorse BsdAsIs"),
    ("BSD-3-Clause", "BsdTitle3 Copyright BsdUse BsdSource BsdBinary BsdEndorse BsdAsIs"),
    ("BSD-3-Clause", "BsdUse BsdSource BsdBinary BsdEndorse BsdAsIs"),
    ("BSD-2-Clause", "BsdTitle2 Copyright AllRights BsdUse BsdSource BsdBinary BsdAsIs"),
    ("BSD-2-Clause", "BsdTitle2 Copyright BsdUse BsdSource BsdBinary BsdAsIs"),
    ("BSD-2-Clause", "BsdUse BsdSource BsdBinary BsdAsIs"),
    ("BSD-2-Clause", "BsdUse BsdSource BsdBinary"),
    ("Apache-2.0", "ApacheName ApacheCopy ApacheBasis"),
    *_NOTICES,
    ("AGPL", "AgplFree GplWarranty AgplCopy"),
    ("LGPL", "LgplFree GplWarranty LgplCopy"),
    ("GPL", "GplFree GplWarranty GplCopy"),
    ("GPL", "GplFree GplWarranty"),
    ("Zlib", "ZlibAsIs ZlibGrant"),
    ("MPL-2.0", "MplName MplCopy"),
    ("Apache-2.0", "ApacheTerms ApacheGrant ApachePatents"),
    ("Apache-2.0", "ApacheGrant ApachePatents"),
    ("GPL-3.0", "Gpl3Title Copyright GnuVerbatim"),
    ("GPL-2.0", "Gpl2Title Copyright GnuVerbatim"),
    ("LGPL-3.0", "Lgpl3Title Copyright GnuVerbatim"),
    ("LGPL-2.1", "Lgpl21Title Copyright GnuVerbatim"),
    ("LGPL-2.0", "Lgpl2Title Copyright GnuVerbatim"),
    ("GPL-3.0", "Gpl3Body Gpl3Intent AgplName AgplName AgplName"),
    ("GPL-3.0", "Gpl3Body Gpl3Intent"),
    ("AGPL-3.0-or-later", "Agpl3Name OrLater"),
    ("LGPL-3.0-or-later", "Lgpl3Name OrLater"),
    ("LGPL-2.1-or-later", "Lgpl21Name OrLater"),
    ("LGPL-2.0-or-later", "Lgpl2Name OrLater"),
    ("GPL-3.0-or-later", "Gpl3Name OrLater"),
    ("GPL-2.0-or-later", "Gpl2Name OrLater"),
    ("MIT", "MitTitle Copyright"),
    ("ISC", "IscTitle Copyright"),
    ("BSD-3-Clause", "BsdTitle3 Copyright"),
    ("BSD-2-Clause", "BsdTitle2 Copyright"),
    ("Apache-2.0", "ApacheTitle"),
    ("GPL-3.0", "Gpl3Title"),
    ("GPL-3.0", "Gpl3Body"),
    ("GPL-3.0", "Gpl3Intent"),
    ("GPL-2.0", "Gpl2Title"),
    ("GPL-2.0", "Gpl2Body"),
    ("GPL-1.0", "Gpl1Title"),
    ("LGPL-3.0", "Lgpl3Title"),
    ("LGPL-3.0", "Lgpl3Body"),
    ("LGPL-2.1", "Lgpl21Title"),
    ("LGPL-2.1", "Lgpl21Body"),
    ("LGPL-2.0", "Lgpl2Title"),
    ("LGPL-2.0", "Lgpl2Body"),
    ("AGPL-3.0", "Agpl3Title"),
    ("AGPL-3.0", "Agpl3Body"),
    ("MPL-2.0", "Mpl2Title"),
    ("MPL-1.1", "Mpl11Title"),
    ("MPL", "MplGrant"),
    ("MPL-2.0", "MplVersion"),
    ("MIT", "MitTitle"),
    ("ISC", "IscTitle"),
    ("BSD-3-Clause", "BsdTitle3"),
    ("BSD-2-Clause", "BsdTitle2"),
    ("ISC", "IscGrant"),
    ("ISC", "IscName"),
    ("MIT", "MitGrant"),
    ("MIT", "MitName"),
    ("Apache-2.0", "ApacheName"),
    ("BSD-3-Clause", "BsdName3"),
    ("BSD-2-Clause", "BsdName2"),
    ("BSD", "BsdName"),
    ("BSD", "BsdUse"),
    ("AGPL-3.0", "Agpl3Name"),
    ("LGPL-3.0", "Lgpl3Name"),
    ("LGPL-2.1", "Lgpl21Name"),
    ("LGPL-2.0", "Lgpl2Name"),
    ("GPL-3.0", "Gpl3Name"),
    ("GPL-2.0", "Gpl2Name"),
    ("AGPL", "AgplFree"),
    ("LGPL", "LgplFree"),
    ("GPL", "GplFree"),
    ("AGPL", "AgplName"),
    ("LGPL", "LgplName"),
    ("AGPL", "AgplCopy"),
    ("LGPL", "LgplCopy"),
    ("MPL", "MplName"),
    ("MPL-2.0", "MplCopy"),
    ("EPL-2.0", "Epl2Name"),
    ("EPL-1.0", "Epl1Name"),
    ("EUPL", "EuplName"),
    ("CDDL", "CddlName"),
    ("BSL-1.0", "BoostName"),
    ("WTFPL", "WtfplName"),
    ("Unlicense", "Unlicense"),
    ("CC-BY-NC-SA", "CcByNcSa"),
    ("CC-BY-NC-ND", "CcByNcNd"),
    ("CC-BY-NC", "CcByNc"),
    ("CC-BY-SA", "CcBySa"),
    ("CC-BY-ND", "CcByNd"),
    ("CC-BY", "CcBy"),
    ("CC0-1.0", "CcZeroTitle"),
    ("CC0-1.0", "CcZero"),
    ("Public-Domain", "PublicDomain"),
)
# Rules that count only where no other licence was found.
LAST = (
    ("Proprietary", "Copyright AllRights"),
    ("Proprietary", "AllRights"),
)
# Stems of which every known sentence has one; a sentence with none is passed over.
STEMS = "licen|gpl|permission|warrant|redistribut|copyright|spdx|public domain|creative commons|rights reserved|cc0|as is|obtain a copy|endorse|mozilla"
#: Marks of comments at the start or end of a line.
COMMENT = r"(?m)^[ \t]*(?:/{2,}!*|/\*+!*|-{2,}|;+|!+|\.\\\")|(?<!\*)\*++/[ \t]*$"
SPDX_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?\)*"
#: The group of further ids is possessive: it is looped over, where a greedy one would need the stack for each id.
SPDX = rf"(?i)(^|[^a-z0-9.+/:-])spdx-license-identifier:\s*({SPDX_ID}(?:\s+(?:and|or|with)\s+{SPDX_ID})*+)"
ENDS, STRANGE = r"([.!?;])\s+|\n[ \t]*\n", r"[^a-z0-9.+/:-]+"
#: What denies the phrase after it; its verb is spoilt for the expressions above.
DENIED = r"(^| )((?:not|never|nor|no longer|neither) (?:be |been |yet |currently )?)(released|licensed|distributed|available|granted|permitted|under|subject)"


def _start(phrase: str) -> str:
    """Where a phrase may begin: at a word, or only with its sentence."""
    return f"^ ?{phrase[1:]}" if phrase.startswith("^") else f"(^| ){phrase}"


def sequence(text: Column) -> Column:
    """The identifiers of the known sentences of a text without nulls, each after a space and before the next."""

    def known(sentence: Column) -> Column:
        """The identifiers of a normalised sentence by position; what one stands for is used up."""
        sentence = F.regexp_replace(sentence, DENIED, "$1$2-$3")
        for name, regex in SENTENCES:
            head, _, tail = regex.partition(".*")
            marked, mark = _start(head), f" \u0002{name}\u0003 "
            if tail:  # what stands before the last tail; a look-ahead would read on from every head
                after = F.substring_index(sentence, tail, -1)
                before = F.left(sentence, F.length(sentence) - F.length(after))
                sentence = F.concat(F.regexp_replace(before, marked, mark), after)
            else:
                sentence = F.regexp_replace(sentence, marked, mark)
        return F.regexp_extract_all(sentence, F.lit("\u0002([^\u0003]*)\u0003"), F.lit(1))

    def tagged(tag: Column) -> Column:
        """The identifiers of an SPDX expression."""
        plain = F.regexp_replace(F.regexp_replace(tag, r"[()]", ""), r"(?i)\s+with\s+", " SpdxWith:")
        ids = F.split(F.regexp_replace(plain, r"(?i)\s+(and|or)\s+", " "), " ")
        return F.transform(ids, lambda x: F.when(F.startswith(x, F.lit("SpdxWith:")), x).otherwise(F.concat(F.lit("Spdx:"), x)))

    def both(sentence: Column) -> Column:
        """The identifiers of a sentence, between its SPDX tags and of these."""
        none = F.array().cast("array<string>")
        parts = F.zip_with(
            F.split(sentence, SPDX), F.regexp_extract_all(sentence, F.lit(SPDX), F.lit(2)),
            lambda part, tag: F.concat(known(F.regexp_replace(F.lower(part), STRANGE, " ")), F.coalesce(tagged(tag), none)),
        )
        return F.flatten(parts)

    def read(all_text: Column) -> Column:
        sentences = F.split(F.regexp_replace(F.regexp_replace(all_text, COMMENT, " "), ENDS, "$1\u0001"), "\u0001")
        stems = F.filter(sentences, lambda s: s.rlike(f"(?i)({STEMS})|(?i)as[^a-z0-9]+is"))
        return F.transform(F.flatten(F.transform(stems, both)), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    return F.when(text.rlike(f"(?i)({STEMS})|(?i)as[^a-z0-9]+is"), F.array_join(read(text), "")).otherwise("")


def _marks(ids: str) -> str:
    """A rule's identifiers as they stand in a sequence."""
    return "".join(f" {x} " for x in ids.split())


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the sentence identifiers, the licences in the order of the rules, and the identifiers that no rule used.

    The lists are space-joined.
    """

    def match(seq: Column) -> Column:
        """What the rules find and leave, as a struct."""

        def table(rules: tuple) -> Column:
            return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(_marks(ids)).alias("ids")) for n, ids in rules))

        def step(seen: Column, rule: Column) -> Column:
            hit = F.contains(seen["rest"], rule["ids"])
            name = F.when(hit & ~F.array_contains(seen["found"], rule["name"]), F.concat(seen["found"], F.array(rule["name"]))).otherwise(seen["found"])
            return F.struct(F.replace(seen["rest"], rule["ids"], F.lit("")).alias("rest"), name.alias("found"))

        def tags(seen: Column) -> Column:
            ids = F.regexp_extract_all(seen["rest"], F.lit(" Spdx:([^ ]+) "), F.lit(1))
            return F.struct(F.regexp_replace(seen["rest"], " Spdx:[^ ]+ ", "").alias("rest"), F.array_union(seen["found"], ids).alias("found"))

        first = F.aggregate(table(LICENCES), F.struct(seq.alias("rest"), F.array().cast("array<string>").alias("found")), step, tags)
        return let(first, lambda seen: F.when(F.size(seen["found"]) > 0, seen).otherwise(F.aggregate(table(LAST), seen, step)))

    def tidy(joined: Column) -> Column:
        return F.trim(F.replace(joined, F.lit("  "), F.lit(" ")))

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    result = let(sequence(F.col("text")), lambda s: F.struct(s.alias("seq"), F.when(s != "", match(s)).alias("m")))
    rows = rows.select("doc_id", result.alias("r"))
    return rows.select(
        "doc_id",
        tidy(F.col("r.seq")).alias("sentences"),
        F.coalesce(F.array_join("r.m.found", " "), F.lit("")).alias("licences"),
        F.coalesce(tidy(F.col("r.m.rest")), F.lit("")).alias("unused"),
    )


def _sql() -> str:
    """DuckDB SQL for op1."""

    def quoted(regex: str) -> str:
        """As DuckDB reads it; its matcher never goes back, so it needs neither possessive forms nor the look-behind."""
        return regex.replace("(?<!\\*)", "").replace("*+", "*").replace("++", "+").replace("'", "''")

    known = f"regexp_replace(n, '{DENIED}', '\\1\\2-\\3', 'g')"
    chain = []
    for k, (name, regex) in enumerate(SENTENCES):
        head, _, tail = regex.partition(".*")
        mark = f"' ' || chr(2) || '{name}' || chr(3) || ' '"
        new = f"regexp_replace(n, '{_start(head)}', {mark}, 'g')"
        if tail:
            before = f"regexp_extract(n, '(?s)^(.*{tail})', 1)"
            new = f"regexp_replace({before}, '{_start(head)}', {mark}, 'g') || substr(n, length({before}) + 1)"
        chain.append(f"k{k + 1} as (select rid, i, j, tag, {new} n from k{k})")
    steps, rest, found = [], "seq", []
    for j, (name, ids) in enumerate(LICENCES):
        mark = _marks(ids)
        steps.append(f"r{j + 1} as (select *, replace({rest}, '{mark}', '') s{j + 1}, contains({rest}, '{mark}') h{j + 1} from r{j})")
        rest = f"s{j + 1}"
        found.append(f"case when h{j + 1} then ['{name}'] else [] end")
    listed = " || ".join(found)
    last = f"case when len(l) > 0 then rest else replace(replace(rest, '{_marks(LAST[0][1])}', ''), '{_marks(LAST[1][1])}', '') end"
    return rf"""
with base as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents
), cut as (
  select rid, unnest(x) raw, unnest(range(1, len(x) + 1)) i from (
    select rid, string_split(regexp_replace(regexp_replace(t, '{quoted(COMMENT)}', ' ', 'g'), '{ENDS}', '\1' || chr(1), 'g'), chr(1)) x from base)
), parts as (
  select rid, i, unnest(p) part, unnest(range(1, len(p) + 1)) j, unnest(g) tag from (
    select rid, i, regexp_split_to_array(raw, '{quoted(SPDX)}') p, list_resize(regexp_extract_all(raw, '{quoted(SPDX)}', 2), len(regexp_split_to_array(raw, '{quoted(SPDX)}')), null) g
    from cut where regexp_matches(raw, '(?i)({STEMS})|(?i)as[^a-z0-9]+is'))
), k0 as (
  select rid, i, j, tag, {known} n from (select rid, i, j, tag, regexp_replace(lower(part), '{STRANGE}', ' ', 'g') n from parts)
), {", ".join(chain)}
, ids as (
  select rid, i, j, regexp_extract_all(n, chr(2) || '([^' || chr(3) || ']*)' || chr(3), 1) || case when tag is null then [] else list_transform(
    string_split(regexp_replace(regexp_replace(regexp_replace(tag, '[()]', '', 'g'), '(?i)\s+with\s+', ' SpdxWith:', 'g'), '(?i)\s+(and|or)\s+', ' ', 'g'), ' '),
    lambda x: case when starts_with(x, 'SpdxWith:') then x else 'Spdx:' || x end) end l from k{len(SENTENCES)}
), r0 as (
  select doc_id, coalesce(q, '') seq from base left join (
    select rid, string_agg(' ' || array_to_string(l, '  ') || ' ', '' order by i, j) q from ids where len(l) > 0 group by rid) using (rid)
), {", ".join(steps)}
, tagged as (
  select doc_id, seq, {listed} || regexp_extract_all({rest}, ' Spdx:([^ ]+) ', 1) l, regexp_replace({rest}, ' Spdx:[^ ]+ ', '', 'g') rest from r{len(LICENCES)}
)
select doc_id, trim(replace(seq, '  ', ' ')) sentences,
  case when len(l) > 0 then array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') when contains(rest, ' AllRights ') then 'Proprietary' else '' end licences,
  trim(replace({last}, '  ', ' ')) unused
from tagged"""


SQL = _sql()
