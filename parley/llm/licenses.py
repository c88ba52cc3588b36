"""License scan: ordered signature rules behind a keyword prefilter.

The rules are written signatures of notices, file headers and license bodies,
and the names of licenses in the frames in which texts put them.

A text is taken as lower-cased words.  Each rule has an anchor (one keyword
that every text it fits must hold), a pattern for the words before the anchor
and one for the words from the anchor on.  Texts without any anchor leave at
once; elsewhere only the rules of the anchors found are tried, and only on the
few words around them.  Detections are word spans with a priority (tags before
full names before short names) and overlaps are resolved by containment: of
the detections with one start the longest stays, then the one of the better
priority, and a detection inside another goes.

All of it is built-in expressions on one row: no shuffle, no Python.

Defined results.  Null text counts as empty: no words, no detections, score 0.
Repeated rows are scanned alike.  Extra columns pass through; one that bears
the name of the result column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: No rule looks at more words than these before and from its anchor on.
BEFORE, AFTER = 24, 24


@dataclass(frozen=True)
class Rule:
    """``left`` has to match up to the anchor, ``right`` from it on; both see words followed by one space each."""

    label: str
    anchor: str
    left: str
    right: str
    priority: int
    score: float
    base: bool = False


#: The fixed base phrases and their labels.
BASE_RULES = (
    Rule("mit", "mit", "under the ", "mit license ", 0, 1.0, True),
    Rule("apache-2", "apache", "", "apache license version 2 ", 0, 1.0, True),
    Rule("cc-by-nc", "cc", "", "cc by nc ", 0, 1.0, True),
)

#: label, anchor word, words before it in the full name, full name from the anchor on
NAMES = (
    ("mit", "mit", "", "mit"),
    ("mit", "expat", "", "expat"),
    ("apache-1", "apache", "", "apache(?: software)? license(?: version| v)? 1(?: [01])?"),
    ("apache-2", "apache", "", "apache(?: software)?(?: license)?(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-1", "gpl", "gnu ", "gpl(?: version)? v?1"),
    ("gpl-2", "gpl", "(?:gnu )?", "gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "gpl", "(?:gnu )?", "gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl-2", "gnu", "", "gnu general public license(?: gpl)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3", "gnu", "", "gnu general public license(?: gpl)?(?: version| v)? 3(?: 0)?"),
    ("gpl", "gnu", "", "gnu general public license"),
    ("lgpl-2", "gnu", "", "gnu library general public license(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", "gnu", "", "gnu lesser general public license(?: version| v)? 2 1"),
    ("lgpl-3", "gnu", "", "gnu lesser general public license(?: version| v)? 3(?: 0)?"),
    ("lgpl", "gnu", "", "gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "lgpl", "", "lgpl(?: version)? ?v?2 1"),
    ("lgpl-3", "lgpl", "", "lgpl(?: version)? ?v?3(?: 0)?"),
    ("agpl-3", "gnu", "", "gnu affero general public license(?: version| v)? 3(?: 0)?"),
    ("agpl", "gnu", "", "gnu affero general public license"),
    ("agpl-3", "agpl", "", "agpl(?: version)? ?v?3(?: 0)?"),
    ("gfdl", "gnu", "", "gnu free documentation license"),
    ("bsd-2", "bsd", "(?:simplified |freebsd |2 clause )", "bsd"),
    ("bsd-3", "bsd", "(?:new |modified |revised |3 clause )", "bsd"),
    ("bsd-4", "bsd", "(?:original |old |4 clause )", "bsd"),
    ("bsd", "bsd", "", "bsd"),
    ("isc", "isc", "", "isc"),
    ("mpl-1", "mozilla", "", "mozilla public license(?: version| v)? 1(?: [01])?"),
    ("mpl-2", "mozilla", "", "mozilla public license(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", "", "mozilla public license"),
    ("mpl-2", "mpl", "", "mpl(?: version)? ?v?2(?: 0)?"),
    ("epl-1", "eclipse", "", "eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", "", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("edl-1", "eclipse", "", "eclipse distribution license"),
    ("cddl-1", "common", "", "common development and distribution license"),
    ("cpl-1", "common", "", "common public license"),
    ("cc0", "cc0", "", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", "", "cc by nc nd"),
    ("cc-by-nc-sa", "cc", "", "cc by nc sa"),
    ("cc-by-nc", "cc", "", "cc by nc"),
    ("cc-by-nd", "cc", "", "cc by nd"),
    ("cc-by-sa", "cc", "", "cc by sa"),
    ("cc-by", "cc", "", "cc by"),
    ("cc-by-nc-nd", "creative", "", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
    ("cc-by-nc-sa", "creative", "", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", "", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", "", "creative commons attribution no ?deriv(?:ative)?s(?: works)?"),
    ("cc-by-sa", "creative", "", "creative commons attribution share ?alike"),
    ("cc-by", "creative", "", "creative commons attribution"),
    ("cc0", "creative", "", "creative commons zero"),
    ("unlicense", "unlicense", "", "unlicense"),
    ("wtfpl", "wtfpl", "", "wtfpl"),
    ("zlib", "zlib", "", "zlib(?: libpng)?"),
    ("bsl-1", "boost", "", "boost software license(?: version)?(?: 1 0)?"),
    ("artistic-1", "artistic", "", "artistic license(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", "", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", "", "artistic license"),
    ("python-2", "python", "", "python software foundation license"),
    ("php-3", "php", "", "php license(?: version)? 3(?: 01?)?"),
    ("ofl-1.1", "sil", "", "sil open font license(?: version)?(?: 1 1)?"),
    ("eupl-1.2", "european", "", "european union public licence(?: v(?:ersion)?)?(?: 1 2)?"),
    ("ms-pl", "microsoft", "", "microsoft public license"),
    ("ms-rl", "microsoft", "", "microsoft reciprocal license"),
    ("openssl", "openssl", "", "openssl"),
    ("postgresql", "postgresql", "", "postgresql"),
    ("ncsa", "ncsa", "university of illinois ", "ncsa open source"),
    ("x11", "x11", "", "x11"),
    ("odbl-1", "database", "open ", "database license"),
    ("public-domain", "domain", "public ", "domain"),
    ("proprietary", "rights", "all ", "rights reserved"),
)

#: How a name is used: pattern before it, pattern after it, priority, score.  A bare name counts only where it holds "license".
FRAMES = (
    ("spdx license identifier ", "", 1, 1.0),
    ("(?:licensed|released|distributed|published|available) under (?:the |an? |the terms of the )?(?:terms of the )?", "(?: license| licence)?(?: version \\d+(?: \\d+)?)?", 2, 0.95),
    ("(?:covered by|governed by|subject to|under) (?:the |an? |the terms of the )?", "(?: license| licence)", 3, 0.85),
    ("(?:license|licence) ", "", 4, 0.7),
    ("", "(?: license| licence)", 5, 0.6),
)


#: Notices, headers and bodies, a line each: label, then the signature; the word after ``*`` is its anchor.  Words are
#: patterns, and ``..`` stands for up to three words of any kind.
SIGNATURES = """
mit | permission is hereby *granted free of charge to any person obtaining a copy of this software
mit | to deal in the software without *restriction including without limitation the rights to use copy modify merge publish
mit | publish distribute *sublicense and or sell copies of the software
mit | the above copyright notice and this permission notice shall be included in all copies or *substantial portions of the software
mit | the software is provided as is without *warranty of any kind express or implied including but not limited to the warranties
mit | in no event shall the authors or copyright *holders be liable for any claim damages or other liability
mit-0 | mit no *attribution(?: license)?
mit | see (?:the )?(?:file )?license(?: md| txt)? file .. *mit
x11 | except as contained in this notice the name .. shall not be used in *advertising or otherwise to promote
x11 | this software and its *documentation for any purpose is hereby granted without fee
isc | permission to use copy modify and or *distribute this software for any purpose with or without fee is hereby granted
isc | the author *disclaims all warranties with regard to this software including all implied warranties
0bsd | bsd *zero clause license
0bsd | zero clause *bsd(?: license)?
bsd-2 | *redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2 | *redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3 | neither the name .. nor the names of its contributors may be used to *endorse or promote products derived from this software
bsd-3 | may be used to *endorse or promote products derived from this software without specific prior written permission
bsd-4 | all *advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | this software is provided by the copyright holders and *contributors as is and any express or implied warranties
bsd | use of this source code is *governed by a bsd style license
bsd-3 | use of this source code is *governed by a bsd 3 clause license
bsd-2 | use of this source code is *governed by a bsd 2 clause license
mit | use of this source code is *governed by an mit style license
mit | use of this source code is *governed by the mit license
apache-2 | use of this source code is *governed by the apache
bsd-3-clear | *clear bsd license
bsd-patent | bsd .. plus *patent
apache-2 | licensed under the *apache license version 2 0 the license you may not use this file except in compliance
apache-2 | you may not use this file except in *compliance with the license you may obtain a copy of the license at
apache-2 | unless required by *applicable law or agreed to in writing software distributed under the license is distributed
apache-2 | www *apache org licenses license 2 0
apache-2 | licensed to the *apache software foundation asf under one or more contributor license agreements
apache-2 | subject to the terms and conditions of this license each *contributor hereby grants to you a perpetual worldwide non exclusive
apache-1.1 | this product includes software developed by the *apache software foundation
gpl-2 | free *software foundation either version 2 of the license or at your option any later version
gpl-3 | free *software foundation either version 3 of the license or at your option any later version
gpl-2 | *gnu general public license version 2 only
gpl-3 | *gnu general public license version 3 only
gpl | this program is free software you can *redistribute it and or modify it under the terms of the gnu general public license
gpl | you should have received a copy of the *gnu general public license along with this program
gpl | under the terms of the *gnu gpl
gpl | the *gnu general public license is a free copyleft license for software and other kinds of works
gpl-2 | *gnu general public license version 2 june 1991
gpl-3 | *gnu general public license version 3 29 june 2007
gpl-1 | *gnu general public license version 1 february 1989
gpl | everyone is permitted to copy and distribute *verbatim copies of this license document but changing it is not allowed
gpl-2-classpath | as a special exception .. linking this .. *classpath exception
gpl-2-classpath | *classpath exception
lgpl | you can *redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | you can *redistribute it and or modify it under the terms of the gnu library general public license
lgpl-2.1 | *lesser general public license version 2 1 february 1999
lgpl-3 | *lesser general public license version 3 29 june 2007
agpl-3 | *affero general public license version 3 19 november 2007
agpl | you can *redistribute it and or modify it under the terms of the gnu affero general public license
agpl | interacting with it *remotely through a computer network
gfdl-1.3 | permission is granted to copy distribute and or modify this document under the terms of the *gnu free documentation license
gfdl | no *invariant sections no front cover texts and no back cover texts
mpl-2 | this source code form is subject to the terms of the *mozilla public license v 2 0
mpl-2 | if a copy of the *mpl was not distributed with this file you can obtain one at
mpl-1.1 | the contents of this file are subject to the *mozilla public license version 1 1 the license
mpl-1.1 | software distributed under the license is distributed on an as is *basis without warranty of any kind either express or implied see the license
npl-1.1 | *netscape public license
epl-1 | this program and the accompanying materials are made available under the terms of the *eclipse public license v1 0
epl-2 | this program and the accompanying materials are made available under the terms of the *eclipse public license 2 0
edl-1 | made available under the terms of the *eclipse distribution license v ?1 0
cddl-1 | the contents of this file are subject to the terms of the common *development and distribution license
cddl-1.1 | common *development and distribution license .. version 1 1
cpl-1 | accompanying materials .. *common public license
ipl-1 | *ibm public license
osl-3 | *open software license .. 3 0
afl-3 | *academic free license .. 3 0
apsl-2 | *apple public source license
qpl-1 | q *public license version 1
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held *liable
zlib | altered source versions must be *plainly marked as such and must not be misrepresented as being the original software
zlib | the *origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1 | distributed under the *boost software license version 1 0
bsl-1 | permission is hereby granted free of charge to any person or *organization obtaining a copy of the software and accompanying documentation
busl-1.1 | *business source license 1 1
busl-1.1 | the licensor hereby grants you the right to copy modify create *derivative works redistribute and make non production use
sspl-1 | *server side public license
elastic-2 | *elastic license 2 0
elastic-2 | you may not provide the *software to third parties as a hosted or managed service
commons-clause | *commons clause license condition
commons-clause | the grant of rights under the license will not include .. the right to *sell the software
polyform-noncommercial | *polyform noncommercial license
polyform-shield | *polyform shield license
unlicense | this is free and *unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use *compile sell or distribute this software
wtfpl | do what the *fuck you want to public license
cc0 | to the extent possible under law .. *waived all copyright and related or neighboring rights
cc0 | *creativecommons org publicdomain zero 1 0
public-domain | *creativecommons org publicdomain mark 1 0
cc-by | *creativecommons org licenses by [1-4]
cc-by-sa | *creativecommons org licenses by sa [1-4]
cc-by-nc | *creativecommons org licenses by nc [1-4]
cc-by-nd | *creativecommons org licenses by nd [1-4]
cc-by-nc-sa | *creativecommons org licenses by nc sa [1-4]
cc-by-nc-nd | *creativecommons org licenses by nc nd [1-4]
cc-by | licensed under a *creative commons attribution [1-4] [0-9] international
cc-by-sa | licensed under a *creative commons attribution sharealike [1-4] [0-9] international
cc-by-nc | licensed under a *creative commons attribution noncommercial [1-4] [0-9] international
cc-by-nc-nd | licensed under a *creative commons attribution noncommercial noderivatives [1-4] [0-9] international
cc-by-nc-sa | licensed under a *creative commons attribution noncommercial sharealike [1-4] [0-9] international
cc-by-nd | licensed under a *creative commons attribution noderivatives [1-4] [0-9] international
cc-by | text is available under the *creative commons attribution
cc-by-sa | text is available under the *creative commons attribution sharealike license
cc-by | *cc by 4 0
cc-by-sa | *cc by sa 4 0
ofl-1.1 | this font software is licensed under the *sil open font license version 1 1
ofl-1.1 | with *reserved font name
artistic-1 | the *artistic license preamble
artistic-2 | *artistic license 2 0
perl | under the same terms as *perl itself
perl | the same terms as the *perl 5 programming language
psf-2 | psf license agreement for *python
psf-2 | *python software foundation license version 2
zpl-2.1 | *zope public license
php-3 | this product includes *php software freely available from
ruby | *ruby license
ruby | the same terms as *ruby
tcl | tcl *tk license
vim | *vim license
curl | *curl license
libpng | *libpng license
ijg | *independent jpeg group
openssl | this product includes software developed by the *openssl project for use in the openssl toolkit
ssleay | this product includes *cryptographic software written by
unicode | *unicode license agreement
unicode-3 | *unicode license v3
w3c | w3c *software notice and license
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written *agreement is hereby granted
ncsa | permission is hereby granted free of charge .. *ncsa open source license
eupl-1.2 | licensed under the *eupl version 1 2
eupl-1.1 | licensed under the *eupl version 1 1
cecill-2.1 | *cecill version 2 1
cecill-b | *cecill b
cecill-c | *cecill c
cecill | *cecill
mulan-psl-2 | *mulan psl v2
mulan-psl-2 | *mulan permissive software license
ms-pl | *ms pl
ms-rl | *ms rl
odbl-1 | open data commons open *database license
odc-by-1 | open data commons *attribution license
pddl-1 | public domain *dedication and license
cdla-permissive-2 | community data license agreement *permissive version 2 0
cdla-sharing-1 | community data license agreement *sharing version 1 0
openrail | *openrail license
openrail-m | *openrail m
bigscience-rail | *bigscience .. rail license
llama | *llama [0-9]* ?community license agreement
gemma | *gemma terms of use
beerware | the *beer ware license
beerware | *beerware license
json | the software shall be used for good not *evil
hippocratic | *hippocratic license
anti996 | *anti 996 license
upl-1 | *universal permissive license
blueoak-1 | *blue oak model license
cpal-1 | *common public attribution license
ecl-2 | *educational community license
lppl-1.3c | *latex project public license
ogl-uk-3 | *open government licence v3 0
ogl-uk | *open government licence
crown-copyright | *crown copyright
us-government | this is a work of the united states *government
proprietary | *confidential and proprietary
proprietary | *unauthorized copying of this file via any medium is strictly prohibited
proprietary | *unauthorized reproduction or distribution
proprietary | no part of this .. may be *reproduced .. without the prior written permission
proprietary | this software is the *confidential and proprietary information of
proprietary | *proprietary and confidential
proprietary | licensed not *sold
proprietary | *end user license agreement
proprietary | *nutzungsrechte vorbehalten
proprietary | alle rechte *vorbehalten
proprietary | tous droits *reserves
proprietary | todos los derechos *reservados
non-commercial | for *noncommercial use only
non-commercial | for non *commercial use only
non-commercial | not for *commercial use
non-commercial | for *academic use only
non-commercial | for *research purposes only
non-commercial | free for *personal use
no-derivatives | no *derivative works
"""


def signature(line: str) -> Rule:
    """A rule from a line of SIGNATURES; whole sentences come before tags of the same start, short ones after."""
    label, text = (x.strip() for x in line.split(" | "))
    before, _, after = text.partition("*")
    anchor = re.match("[a-z0-9]+", after)[0]
    any_words = lambda t: t.replace("..", "(?:[^ ]+ ){0,3}?").replace("){0,3}? ", "){0,3}?")
    long = len(text.split()) >= 6
    return Rule(label, anchor, any_words(before), any_words(after) + " ", 1 if long else 4, 0.9 if long else 0.7)


def rules() -> list[Rule]:
    """The base phrases, the written signatures, then every name in every frame, in the order of their priorities."""
    made = [
        Rule(label, anchor, before + left, right + after + " ", priority, score)
        for before, after, priority, score in FRAMES
        for label, anchor, left, right in NAMES
        if not (after and not before and "licen" in right)
    ]
    bare = [Rule(label, anchor, left, right + " ", 5, 0.6) for label, anchor, left, right in NAMES if "licen" in right or label.startswith(("cc-", "public", "propr"))]
    return [*BASE_RULES, *map(signature, SIGNATURES.strip().splitlines()), *made, *bare]


DETECTION = "array<struct<start:bigint,reach:bigint,priority:int,rule:int,end:bigint,label:string,score:double,base:boolean>>"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.filter(F.split(ascii_lower(text), GAP, -1), lambda w: w != "")


def detect(words: Column, signatures: list[Rule]) -> Column:
    """All detections, overlapping ones too, sorted by start, longest first, priority, order of rules."""
    anchors = sorted({r.anchor for r in signatures})
    table = F.array(
        *[
            F.array(
                *[
                    F.struct(
                        F.lit(f"(?:^| ){r.left}$").alias("left"), F.lit(f"^{r.right}").alias("right"), F.lit(r.priority).alias("priority"),
                        F.lit(k).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.score).alias("score"), F.lit(r.base).alias("base"),
                    )
                    for k, r in enumerate(signatures)
                    if r.anchor == a
                ]
            )
            for a in anchors
        ]
    )
    keys = F.array(*map(F.lit, anchors))
    n_words = lambda s: (F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint")

    extract = lambda s, p: F.call_function("regexp_extract", s, p, F.lit(0))

    def at_place(i: Column) -> Column:
        """Detections of the rules whose anchor is word i (from 1)."""
        before = F.when(i > 1, F.slice(words, F.greatest(i - BEFORE, F.lit(1)), F.least(i - 1, F.lit(BEFORE)))).otherwise(F.array().cast("array<string>"))
        left = F.concat(F.array_join(before, " "), F.when(i > 1, F.lit(" ")).otherwise(F.lit("")))
        right = F.concat(F.array_join(F.slice(words, i, F.lit(AFTER)), " "), F.lit(" "))
        return let(
            F.struct(left.alias("l"), right.alias("r")),
            lambda ctx: F.transform(
                F.filter(
                    F.element_at(table, F.array_position(keys, F.element_at(words, i)).cast("int")),
                    lambda r: F.regexp_like(ctx["r"], r["right"]) & ((r["left"] == "(?:^| )$") | F.regexp_like(ctx["l"], r["left"])),
                ),
                lambda r: let(
                    F.struct(
                        ((i - 1).cast("bigint") - n_words(F.ltrim(extract(ctx["l"], r["left"])))).alias("start"),
                        ((i - 1).cast("bigint") + n_words(extract(ctx["r"], r["right"]))).alias("end"),
                    ),
                    lambda p: F.struct(
                        p["start"].alias("start"), (-p["end"]).alias("reach"), r["priority"].alias("priority"), r["rule"].alias("rule"),
                        p["end"].alias("end"), r["label"].alias("label"), r["score"].alias("score"), r["base"].alias("base"),
                    ),
                ),
            ),
        )

    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i + 1).otherwise(F.lit(0))), lambda i: i > 0)
    found = F.array_sort(F.flatten(F.transform(places, at_place))).cast(DETECTION)
    return F.when(F.arrays_overlap(words, keys), found).otherwise(F.array().cast(DETECTION))


def resolve(found: Column) -> Column:
    """Of sorted detections those that lie in no other: the best of each start, then what no earlier start covers.

    No detection is longer than BEFORE + AFTER words, so only so many starts before one can cover it.
    """
    reach = BEFORE + AFTER
    heads = F.filter(found, lambda d, i: (i == 0) | (F.get(found, i - 1)["start"] != d["start"]))
    return let(
        heads,
        lambda h: F.filter(
            h,
            lambda d, i: (i == 0) | ~F.exists(F.slice(h, F.greatest(i - reach + 1, F.lit(1)), F.least(F.greatest(i, F.lit(1)), F.lit(reach))), lambda e: e["end"] >= d["end"]),
        ),
    )


def scan(docs: DataFrame, *, text_col: str = "text", signatures: list[Rule] | None = None, out: str = "licenses") -> DataFrame:
    """``docs`` plus ``out``: struct of n_words, base (detections of the base phrases, none suppressed) and
    detections (after suppression), each an array of struct(start, end, label, score, ...)."""
    signatures = rules() if signatures is None else signatures
    keep = [c for c in docs.columns if c != out]
    words = words_of(F.coalesce(F.col(text_col), F.lit("")))
    result = let(
        words,
        lambda w: let(
            detect(w, signatures),
            lambda d: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.filter(d, lambda x: x["base"]).alias("base"),
                resolve(d).alias("detections"),
            ),
        ),
    )
    return docs.select(*keep, result.alias(out))


def verdicts(scanned: DataFrame, out: str = "licenses") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to scanned rows."""
    c = F.col(out)
    label = lambda xs: F.transform(xs, lambda x: x["label"])
    starts = F.transform(c["base"], lambda x: x["start"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return scanned.select(
        "*",
        c["n_words"].alias("n_words"),
        F.size(c["base"]).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(label(c["base"])).alias("base_labels"),
        joined(F.concat(label(c["base"]), label(c["detections"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat(c["base"], c["detections"]), lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
