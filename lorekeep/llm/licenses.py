"""License detection by ordered signature rules.

A rule is a regular expression with a label, a priority, a keyword and a cue; it runs only
on texts that hold the keyword at the start of a word and the cue, which every text that it
matches does.  Hand-written signatures tell license texts, headers, notices, exceptions and
addresses; names in phrases ("licensed under ...") are made from a table of licenses and one
of phrasings.  Where detections overlap, one that lies within the interval of a better one
(lower priority number, then longer) is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .spans import let, matches, running

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
EDGE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licenses with versions: label -> (keyword, name, versions).  A name without a version is the label alone.
FAMILIES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    **{f"cc-{x}": ("cc", f"cc {x.replace('-', ' ')}", ("1.0", "2.0", "2.5", "3.0", "4.0")) for x in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")},
    "lgpl": ("lgpl", "lgpl", ("2.0", "2.1")),
    "mpl": ("mpl", "mpl", ("1.0", "1.1", "2.0")),
    "epl": ("epl", "epl", ("1.0", "2.0")),
    "cddl": ("cddl", "cddl", ("1.0", "1.1")),
    "artistic": ("artistic", "artistic license", ("1.0", "2.0")),
    "ofl": ("ofl", "ofl", ("1.0", "1.1")),
    "eupl": ("eupl", "eupl", ("1.0", "1.1", "1.2")),
}
#: label -> (keyword, the ways it is named as regular expressions); spaces stand for any gap between words
NAMES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": ("mit", ("mit", "expat")),
    "apache": ("apache", ("apache",)),
    "apache-2.0": ("apache", ("apache( license)?,?( version)? 2( 0)?", "asl 2( 0)?")),
    "apache-1.1": ("apache", ("apache( software)? license,?( version)? 1 1",)),
    "gpl": ("gpl", ("(gnu )?gpl",)),
    "gpl-2.0": ("gpl", ("(gnu )?gpl( version)? ?v? ?2( 0)?",)),
    "gpl-3.0": ("gpl", ("(gnu )?gpl( version)? ?v? ?3( 0)?",)),
    "gpl-2.0-text": ("general", ("(gnu )?general public license,?( version| v)? ?2( 0)?",)),
    "gpl-3.0-text": ("general", ("(gnu )?general public license,?( version| v)? ?3( 0)?",)),
    "lgpl-3.0": ("lgpl", ("(gnu )?lgpl( version)? ?v? ?3( 0)?",)),
    "lgpl-text": ("lesser", ("(gnu )?lesser general public license",)),
    "lgpl-2.1-text": ("lesser", ("(gnu )?lesser general public license,?( version| v)? ?2 1",)),
    "lgpl-3.0-text": ("lesser", ("(gnu )?lesser general public license,?( version| v)? ?3( 0)?",)),
    "agpl": ("agpl", ("(gnu )?agpl",)),
    "agpl-3.0": ("agpl", ("(gnu )?agpl( version)? ?v? ?3( 0)?",)),
    "agpl-text": ("affero", ("(gnu )?affero general public license",)),
    "agpl-3.0-text": ("affero", ("(gnu )?affero general public license,?( version| v)? ?3( 0)?",)),
    "bsd": ("bsd", ("bsd",)),
    "bsd-2-clause": ("bsd", ("(simplified |freebsd )?bsd 2 clause", "simplified bsd")),
    "bsd-3-clause": ("bsd", ("(new |modified |revised )?bsd 3 clause", "new bsd", "modified bsd")),
    "bsd-4-clause": ("bsd", ("bsd 4 clause", "original bsd")),
    "mpl-text": ("mozilla", ("mozilla public license",)),
    "mpl-1.1-text": ("mozilla", ("mozilla public license,?( version| v)? ?1 1",)),
    "mpl-2.0-text": ("mozilla", ("mozilla public license,?( version| v)? ?2( 0)?",)),
    "epl-text": ("eclipse", ("eclipse public license",)),
    "epl-1.0-text": ("eclipse", ("eclipse public license,?( version| v)? ?1( 0)?",)),
    "epl-2.0-text": ("eclipse", ("eclipse public license,?( version| v)? ?2( 0)?",)),
    "cc0-1.0": ("cc0", ("cc0( 1 0)?",)),
    "cc-text": ("creative", ("creative commons attribution( non ?commercial)?( no ?deriv(ative)?s| share ?alike)?",)),
    "isc": ("isc", ("isc",)),
    "zlib": ("zlib", ("zlib",)),
    "unlicense": ("unlicense", ("unlicense",)),
    "public-domain": ("domain", ("(?<! not in the )(?<! not )(?<! isn t in the )public domain",)),
    "bsl-1.0": ("boost", ("boost software license( version)?( 1 0)?",)),
    "wtfpl": ("wtfpl", ("wtfpl",)),
    "postgresql": ("postgresql", ("postgresql",)),
    "proprietary": ("reserved", ("all rights reserved",)),
}
for _label, (_keyword, _name, _versions) in FAMILIES.items():
    NAMES[_label] = (_keyword, (_name,))
    NAMES |= {f"{_label}-{v}": (_keyword, (f"{_name}( version)? ?v? ?{v.replace('.', ' ')}",)) for v in _versions}
#: Label, keyword, signature: what stands in license texts, headers and notices.  Spaces stand for any gap between words, <some> for one to twelve words.
SIGNATURES: tuple[tuple[str, str, str], ...] = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation( files)?"),
    ("mit", "above", "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "hereby", "hereby granted free of charge to any person obtaining a copy of <some>to deal in the software without restriction"),
    ("mit", "opensource", "opensource org licenses? mit"),
    ("mit-0", "mit", "mit no attribution"),
    ("x11", "advertising", "except as contained in this notice the names? of <some>shall not be used in advertising or otherwise to promote"),
    ("isc", "permission", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "opensource", "opensource org licenses? bsd license"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd-3-clause", "endorse", "neither the names? of <some>may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "governed", "governed by a bsd style license that can be found in the license file"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache", "apache license version 2 0 january 2004"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "apache license version 2 0"),
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("apache-2.0", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "opensource", "opensource org licenses? apache 2 0"),
    ("apache-1.1", "apache", "this product includes software developed by the apache (software foundation|group)"),
    ("gpl", "gnu", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu", "see the gnu general public license for more details"),
    ("gpl", "gnu", "gnu org (licenses|copyleft) gpl html"),
    ("gpl-1.0", "gnu", "gnu general public license version 1 february 1989"),
    ("gpl-2.0", "gnu", "gnu general public license version 2 june 1991"),
    ("gpl-2.0", "gnu", "gnu general public license as published by the free software foundation( either)? version 2( of the license)?"),
    ("gpl-2.0-or-later", "gnu", "gnu general public license as published by the free software foundation( either)? version 2( of the license)? or at your option any later version"),
    ("gpl-2.0", "gnu", "gnu org licenses (old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", "gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "gnu", "gnu general public license as published by the free software foundation( either)? version 3( of the license)?"),
    ("gpl-3.0-or-later", "gnu", "gnu general public license as published by the free software foundation( either)? version 3( of the license)? or at your option any later version"),
    ("gpl-3.0", "gnu", "gnu org licenses gpl 3 0"),
    ("lgpl", "gnu", "under the terms of the gnu (lesser|library) general public license as published by the free software foundation"),
    ("lgpl", "gnu", "you should have received a copy of the gnu (lesser|library) general public license along with"),
    ("lgpl-2.0", "gnu", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1", "gnu", "gnu org licenses (old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-3.0", "gnu", "gnu org licenses lgpl 3 0"),
    ("agpl", "gnu", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "gnu", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", "gnu", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "gnu", "gnu org licenses agpl 3 0"),
    ("gfdl", "gnu", "under the terms of the gnu free documentation license"),
    ("gfdl", "gnu", "gnu free documentation license( version 1 [123])?"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v(ersion)? ?2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "mozilla", "mozilla org (en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v(ersion)? ?1 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license v?(ersion )?2 0"),
    ("epl-1.0", "eclipse", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "eclipse org legal epl (2 0|v20)"),
    ("cpl-1.0", "common", "common public license version 1 0"),
    ("ipl-1.0", "ibm", "ibm public license version 1 0"),
    ("cddl-1.0", "common", "common development and distribution license( cddl)?( version)? 1 0"),
    ("cddl-1.1", "common", "common development and distribution license( cddl)?( version)? 1 1"),
    ("cddl", "subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighbou?ring rights"),
    ("cc-by", "creativecommons", "creativecommons org licenses by \\d \\d"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa \\d \\d"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc \\d \\d"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd \\d \\d"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa \\d \\d"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd \\d \\d"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike \\d \\d( (international|unported))?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial \\d \\d( (international|unported))?"),
    ("cc-by", "creative", "creative commons attribution \\d \\d( (international|unported))?"),
    ("public-domain-mark", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", "for more information please refer to https? unlicense org"),
    ("wtfpl", "fuck", "do what the fuck you want to( public license)?"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png", "png reference library license"),
    ("bsl-1.0", "boost", "boost software license version 1 0( august 17th 2003)?"),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("python-2.0", "python", "python software foundation license version 2"),
    ("python-2.0", "psf", "psf license agreement for python"),
    ("perl", "perl", "under the same terms as perl itself"),
    ("ruby", "ruby", "under the (same )?terms (as|of) ruby( s license)?"),
    ("artistic-1.0", "artistic", "the artistic license preamble"),
    ("artistic-2.0", "artistic", "artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "sil", "sil open font license( version 1 1)?( 26 february 2007)?"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("php-3.01", "php", "the php license version 3 01"),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "illinois", "university of illinois( ncsa)? open source license"),
    ("hpnd", "permission", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ntp", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("curl", "stenberg", "copyright and permission notice copyright c <some>daniel stenberg"),
    ("sleepycat", "redistributions", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("beerware", "beer", "(the )?beer ?ware license"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("ms-pl", "microsoft", "microsoft public license( ms pl)?"),
    ("ms-rl", "microsoft", "microsoft reciprocal license( ms rl)?"),
    ("eupl", "european", "european union public licen[cs]e( v)?( 1 [12])?"),
    ("cecill", "cecill", "cecill( free software)? license( agreement)?"),
    ("lppl-1.3c", "latex", "latex project public license"),
    ("qpl-1.0", "q", "q public license( version 1 0)?"),
    ("osl-3.0", "open", "open software license( version)? v?3 0"),
    ("afl-3.0", "academic", "academic free license( version)? v?3 0"),
    ("upl-1.0", "universal", "universal permissive license( version)? v?1 0"),
    ("mulanpsl-2.0", "mulan", "mulan (psl|permissive software license)( v)? ?2"),
    ("blueoak-1.0.0", "blue", "blue oak model license( 1 0 0)?"),
    ("odbl-1.0", "database", "open database license( odbl)?( v)?( 1 0)?"),
    ("odc-by-1.0", "commons", "open data commons attribution license"),
    ("pddl-1.0", "commons", "open data commons public domain dedication"),
    ("cdla-permissive", "community", "community data license agreement permissive"),
    ("cdla-sharing", "community", "community data license agreement sharing"),
    ("ogl-uk", "government", "(under the )?open government licen[cs]e( v)?( ?[123] 0)?"),
    ("busl-1.1", "business", "business source license( 1 1)?"),
    ("sspl-1.0", "server", "server side public license( v)?( ?1)?"),
    ("elastic-2.0", "elastic", "elastic license 2 0"),
    ("commons-clause", "commons", "commons clause license condition( v)?( ?1 0)?"),
    ("polyform", "polyform", "polyform (noncommercial|small business|shield|strict|internal use)( license)?( 1 0 0)?"),
    ("openrail", "openrail", "(creativeml )?openrail( [ms])?( license)?"),
    ("llama", "llama", "llama \\d( \\d)? community license( agreement)?"),
    ("bsd", "freebsd", "the freebsd (copyright|license|documentation license)"),
    ("public-domain", "dedicated", "dedicated to the public domain"),
    ("public-domain", "placed", "(has been |is )?(hereby )?placed in the public domain"),
    ("public-domain", "disclaims", "the author disclaims copyright to this source code"),
    ("classpath-exception-2.0", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception-3.1", "gcc", "gcc runtime library exception( version 3 1)?"),
    ("llvm-exception", "llvm", "apache license v2 0 with llvm exceptions?"),
    ("linux-syscall-note", "kernel", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("bison-exception-2.2", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "autoconf", "as a special exception <some>configure script generated by autoconf"),
    ("font-exception", "font", "as a special exception if you create a document which uses this font"),
    ("openssl-exception", "openssl", "permission to link <some>with the openssl (project s )?library"),
    ("exception", "exception", "as a special exception"),
    ("proprietary", "proprietary", "(this software is )?proprietary and confidential( information)?"),
    ("proprietary", "confidential", "confidential and proprietary( information)?"),
    ("proprietary", "unauthori", "unauthori[sz]ed (copying|use|reproduction|distribution) <some>is strictly prohibited"),
    ("proprietary", "reproduced", "no part of this (publication|book|document|work|site|website) may be reproduced"),
    ("proprietary", "redistributed", "may not be (copied |published |reproduced )(broadcast rewritten )?(or )?redistributed"),
    ("proprietary", "permission", "without( the)?( express)?( prior)? written permission of the (publisher|author|copyright (holder|owner))"),
    ("proprietary", "agreement", "end user license agreement( eula)?"),
    ("noncommercial", "commercial", "for non commercial( use| purposes| research)? only"),
    ("noncommercial", "noncommercial", "for noncommercial( use| purposes| research)? only"),
)
#: Keywords of names that do not hold their label's.
KEYWORDS = {"expat": "expat", "asl 2( 0)?": "asl"}
#: priority, template with {}, label's certainty.  What a lookbehind holds is no part of the place, so that the members of a list don't suppress each other.
PHRASINGS = (
    (0, "spdx license identifier {}", 1.0),
    (0, "(?<= spdx license identifier [a-z0-9 ]{1,120} (?:or|and) ){}", 1.0),
    (1, "(re)?licensed under( either( of)?)?( the)?( terms of( the)?)? {}( licen[cs]e)?", 0.95),
    (1, "(?<= licensed under [a-z0-9 ]{1,120} (?:or|and) )(the )?{}( licen[cs]e)?", 0.9),
    (1, "released under( either( of)?)?( the)?( terms of( the)?)? {}( licen[cs]e)?", 0.95),
    (2, "(distributed|available|published|covered) under( either( of)?)?( the)?( terms of( the)?)? {}( licen[cs]e)?", 0.9),
    (3, "(the )?{} licen[cs]e", 0.8),
    (3, "licen[cs]e {}", 0.8),
)
BARE = ("-text", "public-domain", "proprietary", "unlicense", "cc-by", "cc0", "bsl", "artistic")


def phrasings(label: str) -> list[tuple[int, str, float]]:
    """The phrasings in which a label's names stand: identifiers are no spelt-out names, and some names stand alone."""
    own = [p for p in PHRASINGS if not (label.endswith("-text") and p[0] == 0)]
    return [*own, (4, "{}", 0.6)] if any(b in label for b in BARE) else own


def rules() -> list[tuple[int, str, str, str, str, float]]:
    """(priority, label, keyword, cue, regular expression, certainty) of every rule, in order: some 850."""
    cue = lambda t: next((c for c in ("spdx", "under", "licen") if c in t), "")
    out = []
    for label, (keyword, names) in NAMES.items():
        for name in names:
            out += [(p, label.removesuffix("-text"), KEYWORDS.get(name, keyword), cue(t), compiled(t.replace("{}", f"({name})")), certain) for p, t, certain in phrasings(label)]
    return sorted(out + [(1, label, keyword, "", compiled(text), 0.97) for label, keyword, text in SIGNATURES])


def compiled(phrase: str) -> str:
    """A phrase as a pattern on the squeezed text of words: words between single blanks."""
    return rf"(?<=\x20){phrase.replace(',?', '').replace('.', ' ').replace('<some>', '([^ ]+ ){1,12}?').strip()}(?=\x20)"


def squeezed(text: Column) -> Column:
    """Lower-case words between single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), GAP, " ")), F.lit(" "))


def _keys(words: Column, keywords: list[str]) -> Column:
    """Those of the keywords that stand at the start of a word, in one pass over the words."""
    letters = sorted({k[0] for k in keywords})
    longest = lambda c: "|".join(sorted((k[1:] for k in keywords if k[0] == c), key=lambda k: (-len(k), k)))
    any_of = "|".join(f"{c}(?:{longest(c)})" for c in letters)
    found = F.array_distinct(F.regexp_extract_all(words, F.lit(rf"(?<=\x20)(?:{any_of})"), F.lit(0)))
    # a keyword that begins another one is found with it
    return let(found, lambda own: F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.exists(own, lambda f: F.startswith(f, k))))


def _base(text: Column, phrase: str, k: int) -> Column:
    """(word, k) of each place: the words of the phrase stand consecutively from that word on."""
    spelt = GAP.join("".join(f"[{c}{c.upper()}]" for c in w) for w in phrase.split())
    found = matches(text, rf"(?<!{EDGE}){spelt}(?!{EDGE})")
    step = len(phrase.split())
    counts = lambda m: F.transform(m, lambda x: (F.regexp_count(x.before, F.lit(WORD)) + step).cast("bigint"))
    return F.transform(let(found, lambda m: running(counts(m))), lambda at: F.struct((at - step).alias("word"), F.lit(k).alias("k")))


def _places(gated: DataFrame) -> DataFrame:
    """(row, start, end, label, priority, certainty) of all places of each rule that matches a row's words."""
    gaps = F.transform(F.split("words", F.col("rule"), -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all("words", F.col("rule"), F.lit(0)), lambda x: F.length(x))
    each = gated.withColumn("sizes", sizes).select("row", "rule", "label", "priority", "certainty", F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size("sizes")).alias("gap"), F.col("sizes").alias("size"))).alias("nth", "m"))
    line = Window.partitionBy("row", "rule", "label").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(line)
    each = each.repartition("row").select("row", "label", "priority", "certainty", (end + 1).alias("end"), F.col("m.size").cast("long").alias("size"))
    return each.select("row", (F.col("end") - F.col("size")).alias("start"), "end", "label", "priority", "certainty")


def _unsuppressed(places: DataFrame) -> DataFrame:
    """Places without those that lie within a better one, in one pass over a row's places.

    In order of start, priority and falling end, a better place that holds one stands before
    it; of each priority the furthest end so far is known, with the first start that reaches it.
    """
    line = Window.partitionBy("row").orderBy("start", "priority", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    worst = max(p for p, _, _ in PHRASINGS) + 1
    far = [F.max(F.when(F.col("priority") == p, F.struct("end", (-F.col("start")).alias("back")))).over(line).alias(f"far{p}") for p in range(worst + 1)]
    better = F.lit(False)
    for p in range(worst + 1):
        end, back = F.col(f"far{p}.end"), F.col(f"far{p}.back")
        own = (end > F.col("end")) | ((end == F.col("end")) & (-back < F.col("start")))
        better |= F.coalesce(F.when(F.col("priority") == p, own).when(F.col("priority") > p, end >= F.col("end")), F.lit(False))
    return places.select("*", *far).filter(~better)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, base: array of (word, k), found: array of (start, end, label, priority, certainty).

    base numbers BASE; found is what suppression leaves of the rules' detections, as places in
    the squeezed text, ordered by start, end and label.  Of places that hold each other equally
    well all stay.  Null texts are empty; very long texts are read whole; repeated rows are rows
    of their own; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    every = rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keywords = sorted({r[2] for r in every})
    low = F.lower("t")
    base = F.when(F.contains(low, F.lit("license")), F.concat(*[_base(F.col("t"), p, k) for k, (p, _) in enumerate(BASE)])).otherwise(F.array().cast("array<struct<word:bigint,k:int>>"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select("id", base.alias("base"), squeezed(F.col("t")).alias("words"))
    n_words = F.when(F.col("words") == "  ", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) - 1).cast("long")
    rows = rows.select("id", n_words.alias("n_words"), "base", "words", _keys(F.col("words"), keywords).alias("keys"))
    rows = rows.withColumn("words", F.when(F.size("keys") > 0, F.col("words")))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "licenses")
    table = F.broadcast(spark.createDataFrame(every, "priority int, label string, keyword string, cue string, rule string, certainty double"))  # a fixed list
    gated = rows.filter("size(keys) > 0").select("row", "words", F.explode("keys").alias("keyword")).join(table, "keyword").filter(F.contains("words", "cue")).filter(F.expr("words rlike rule"))
    kept = _unsuppressed(_places(gated))
    found = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "priority", "certainty"))).alias("found"))
    out = rows.select("row", "id", "n_words", "base").join(found, "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int,certainty:double>>")
    return out.select(F.col("id").alias(id_col), "n_words", "base", F.coalesce("found", none).alias("found"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(label) for _, label in BASE])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: names[b.k])))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b.word)).alias("first_word"), F.array_max(F.transform("base", lambda b: b.word)).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda f: f.label)))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f.certainty)), F.lit(0.0))).alias("score"),
    )
