"""License scans: ordered signature rules, native expressions only.

A text becomes its lower-case words joined by single spaces. Hundreds of rules, each a regex over that
form with keywords, a priority and a label, are gated in two steps: which keywords occur at all, then
the regexes of their rules. Whatever a rule can match holds one of its keywords, so the gate loses nothing. Detections are word intervals. One contained in another of the same or a
higher priority is suppressed; of equal ones the rule that stands first stays. Everything is an
expression on the row, so there is no shuffle and no Python, and a document is never split.

A name without a version gives the bare label, with one the label of that version; the longer interval
suppresses the shorter one it contains.

Defined cases: null text is empty; it has 0 words, no places, empty label strings and score 0; a very long
text is one string of one row (nothing is cut); of equal intervals the rule that stands first wins; repeated
rows give repeated results; an empty table gives none; columns of the result replace those of the same name,
others are kept.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
MARK = "\x01"  # cannot occur in a word

# The phrases every scan finds, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Names of licenses that come in versions: label, keywords (one for each alternative), name, versions. A name alone
# gives the label; with a version it gives label-version.
GNU_1, GNU_2, GNU_3 = "(?:v|version )?1(?: 0)?", "(?:v|version )?2(?: 0)?", "(?:v|version )?3(?: 0)?"
CC = {v: f"(?:v|version )?{v.replace('.', ' ')}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
VERSIONED = (
    ("gpl", " gpl", "(?:gnu )?gpl", {"1.0": GNU_1, "2.0": GNU_2, "3.0": GNU_3}),
    ("gpl", " general public", "(?:gnu )?general public licen[sc]e", {"1.0": GNU_1, "2.0": GNU_2, "3.0": GNU_3}),
    ("lgpl", " lgpl", "(?:gnu )?lgpl", {"2.0": GNU_2, "2.1": "(?:v|version )?2 1", "3.0": GNU_3}),
    ("lgpl", (" lesser general", " library general"), "(?:gnu )?(?:lesser|library) general public licen[sc]e", {"2.0": GNU_2, "2.1": "(?:v|version )?2 1", "3.0": GNU_3}),
    ("agpl", " agpl", "(?:gnu )?agpl", {"3.0": GNU_3}),
    ("agpl", " affero", "(?:gnu )?affero general public licen[sc]e", {"1.0": GNU_1, "3.0": GNU_3}),
    ("gfdl", (" gfdl", " free documentation"), "(?:gfdl|(?:gnu )?free documentation licen[sc]e)", {"1.1": "(?:v|version )?1 1", "1.2": "(?:v|version )?1 2", "1.3": "(?:v|version )?1 3"}),
    ("apache", " apache", "(?:the )?apache(?: software)?(?: licen[sc]e)?", {"1.0": "(?:v|version )?1 0", "1.1": "(?:v|version )?1 1", "2.0": GNU_2}),
    ("mpl", (" mpl", " mozilla public"), "(?:mpl|mozilla public licen[sc]e)", {"1.0": "(?:v|version )?1 0", "1.1": "(?:v|version )?1 1", "2.0": GNU_2}),
    ("epl", (" epl", " eclipse public"), "(?:epl|eclipse public licen[sc]e)", {"1.0": GNU_1, "2.0": GNU_2}),
    ("eupl", (" eupl", " european union public"), "(?:eupl|european union public licen[sc]e)", {"1.1": "(?:v|version )?1 1", "1.2": "(?:v|version )?1 2"}),
    ("cddl", (" cddl", " common development"), "(?:cddl|common development and distribution licen[sc]e)", {"1.0": "(?:v|version )?1 0", "1.1": "(?:v|version )?1 1"}),
    ("artistic", " artistic", "(?:perl )?artistic licen[sc]e", {"1.0": "(?:v|version )?1 0", "2.0": GNU_2}),
    ("ofl", (" ofl", " open font"), "(?:ofl|(?:sil )?open font licen[sc]e)", {"1.0": "(?:v|version )?1 0", "1.1": "(?:v|version )?1 1"}),
    ("odbl", (" odbl", " open database"), "(?:odbl|open database licen[sc]e)", {"1.0": "(?:v|version )?1 0"}),
    ("cc0", " cc0", "cc0", {"1.0": "(?:v|version )?1 0"}),
    ("cc-by", (" cc by", " creative commons"), "(?:cc by|creative commons attribution)", CC),
    ("cc-by-sa", (" cc by sa", " creative commons"), "(?:cc by sa|creative commons attribution share ?alike)", CC),
    ("cc-by-nd", (" cc by nd", " creative commons"), "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", CC),
    ("cc-by-nc", (" cc by nc", " creative commons"), "(?:cc by nc|creative commons attribution non ?commercial)", CC),
    ("cc-by-nc-sa", (" cc by nc sa", " creative commons"), "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", CC),
    ("cc-by-nc-nd", (" cc by nc nd", " creative commons"), "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", CC),
)
GRANT = "(?:is |are )?(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
LATER = "(?: only| or(?: any| at your option any)? later(?: version)?| plus)?"
#: Priority and form of a name without and with its version.
BARE = ((3, GRANT + "{name}"), (3, "spdx licen[sc]e identifier {name}"), (2, "licen[sc]e {name}"), (1, "{name} licen[sc]e"))
EXACT = ((3, GRANT + "{name} ?{version}" + LATER), (3, "spdx licen[sc]e identifier {name} ?{version}" + LATER), (2, "{name} ?{version}" + LATER))

# Rules written one by one: label, priority, keywords (one for each alternative of the regex), regex.
SINGLES = (
    # names without versions
    ("mit", 3, (" mit ", " mitlicen", " expat"), GRANT + "(?:mit|expat)(?: style)?(?: ?licen[sc]e)?"),
    ("mit", 3, (" mit ", " mitlicen", " expat"), "spdx licen[sc]e identifier (?:mit|expat)(?: ?licen[sc]e)?"),
    ("mit", 2, (" mit ", " mitlicen", " expat"), "(?:the )?(?:mit|expat)(?: style)? ?licen[sc]e"),
    ("mit", 2, (" mit ", " mitlicen", " expat"), "licen[sc]e (?:mit|expat)"),
    ("mit-0", 3, " mit 0", "(?:spdx licen[sc]e identifier )?mit 0"),
    ("mit", 1, " x11", "x11 licen[sc]e"),
    ("isc", 3, (" isc ", " isclicen"), GRANT + "isc(?: ?licen[sc]e)?"),
    ("isc", 3, (" isc ", " isclicen"), "spdx licen[sc]e identifier isc(?: ?licen[sc]e)?"),
    ("isc", 2, (" isc ", " isclicen"), "(?:the )?isc ?licen[sc]e"),
    ("bsd", 3, " bsd", GRANT + "(?:a )?bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd", 1, " bsd", "(?:the )?bsd(?: style)? licen[sc]e"),
    ("0bsd", 3, (" 0bsd", " zero clause bsd"), "(?:0bsd|(?:bsd )?zero clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", 3, (" bsd", " freebsd"), GRANT + "(?:simplified bsd|freebsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", 2, (" bsd", " freebsd"), "(?:the )?(?:simplified bsd|freebsd) licen[sc]e"),
    ("bsd-2-clause", 2, " bsd", "bsd (?:2|two) clause(?: licen[sc]e)?"),
    ("bsd-2-clause", 2, " clause bsd", "(?:2|two) clause bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", 3, " bsd", GRANT + "(?:new bsd|modified bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", 2, " bsd", "(?:the )?(?:new|modified|revised) bsd licen[sc]e"),
    ("bsd-3-clause", 2, " bsd", "bsd (?:3|three) clause(?: licen[sc]e)?"),
    ("bsd-3-clause", 2, " clause bsd", "(?:3|three) clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", 2, " bsd", "(?:the )?original bsd licen[sc]e"),
    ("bsd-4-clause", 2, " bsd", "bsd (?:4|four) clause(?: licen[sc]e)?"),
    ("zlib", 2, " zlib", "(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("zlib", 3, " zlib", "spdx licen[sc]e identifier zlib"),
    ("libpng", 2, (" libpng", " png reference"), "(?:libpng|png reference library) licen[sc]e(?: version 2)?"),
    ("boost", 2, " boost", "(?:the )?boost software licen[sc]e(?: (?:v|version )?1 0)?"),
    ("boost", 3, " bsl 1", "spdx licen[sc]e identifier bsl 1 0"),
    ("unlicense", 2, " unlicense", "(?:the )?unlicense"),
    ("wtfpl", 2, " wtfpl", "wtfpl(?: (?:v|version )?2)?"),
    ("psf-2.0", 2, (" python", " psf"), "(?:python(?: software foundation)? licen[sc]e|psf licen[sc]e)(?: (?:v|version )?2(?: 0)?)?"),
    ("openssl", 2, " openssl", "openssl licen[sc]e"),
    ("php", 2, " php", "php licen[sc]e(?: (?:v|version )?3 (?:0|01))?"),
    ("ruby", 1, " ruby", "(?:the )?(?:ruby licen[sc]e|same terms as ruby)"),
    ("perl", 2, " perl", "same terms as perl(?: itself)?"),
    ("postgresql", 2, " postgresql", "(?:the )?postgresql licen[sc]e"),
    ("ncsa", 2, (" ncsa", " university of illinois"), "(?:university of illinois )?ncsa open source licen[sc]e"),
    ("ms-pl", 2, (" microsoft public", " ms pl"), "(?:microsoft public licen[sc]e|ms pl)"),
    ("ms-rl", 2, (" microsoft reciprocal", " ms rl"), "(?:microsoft reciprocal licen[sc]e|ms rl)"),
    ("vim", 1, " vim", "(?:the )?vim licen[sc]e"),
    ("w3c", 2, " w3c", "w3c(?: software(?: notice)?(?: and)?)? licen[sc]e"),
    ("zpl", 2, (" zope public", " zpl"), "(?:zope public|zpl) licen[sc]e(?: (?:v|version )?2 [01])?"),
    ("sleepycat", 2, " sleepycat", "(?:the )?sleepycat licen[sc]e"),
    ("ftl", 2, (" freetype", " ftl"), "(?:freetype (?:project )?licen[sc]e|spdx licen[sc]e identifier ftl)"),
    ("curl", 2, " curl", "(?:the )?curl licen[sc]e"),
    ("beerware", 2, (" beerware", " beer ware"), "(?:the )?beer ?ware licen[sc]e"),
    ("cecill", 2, " cecill", "(?:the )?cecill(?: [bc])?(?: licen[sc]e)?"),
    ("cpl", 2, " common public", "(?:ibm )?common public licen[sc]e(?: (?:v|version )?1 0)?"),
    ("cpal", 2, " common public attribution", "common public attribution licen[sc]e(?: (?:v|version )?1 0)?"),
    ("sspl", 2, (" server side public", " sspl"), "(?:server side public licen[sc]e|sspl)(?: (?:v|version )?1)?"),
    ("busl", 2, (" business source", " busl"), "(?:business source licen[sc]e|busl)(?: (?:v|version )?1 1)?"),
    ("elastic", 2, " elastic licen", "elastic licen[sc]e(?: (?:v|version )?2(?: 0)?)?"),
    ("commons-clause", 2, " commons clause", "commons clause(?: licen[sc]e condition)?"),
    ("polyform", 2, " polyform", "polyform (?:noncommercial|shield|strict|perimeter|small business|free trial|internal use)(?: licen[sc]e)?"),
    ("upl", 2, " universal permissive", "universal permissive licen[sc]e(?: (?:v|version )?1 0)?"),
    ("osl", 2, " open software licen", "open software licen[sc]e(?: (?:v|version )?[123] [01])?"),
    ("afl", 2, " academic free", "academic free licen[sc]e(?: (?:v|version )?[123] [012])?"),
    ("odc-by", 2, (" odc by", " open data commons"), "(?:odc by|open data commons attribution licen[sc]e)"),
    ("pddl", 2, (" pddl", " public domain dedication and"), "(?:pddl|public domain dedication and licen[sc]e)"),
    ("cc-by", 1, " creative commons", "creative commons licen[sc]e"),
    # grants and conditions, as the licenses word them
    ("mit", 3, " permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, " above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", 3, " permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", 3, " permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", 3, " redistribution and use", "redistribution and use in source and binary forms"),
    ("bsd", 2, " redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, " redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 2, " neither the name", "neither the names? of (?:[a-z0-9]+ ){1,12}may be used to endorse or promote"),
    ("bsd-4-clause", 2, " all advertising", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", 3, " you may not use this file", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 2, " obtain a copy of the licen", "you may obtain a copy of the licen[sc]e at"),
    ("gpl", 3, " redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 3, " redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 3, " redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl-2.0", 2, " either version 2", "either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", 2, " either version 3", "either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl", 1, " you should have received a copy", "you should have received a copy of the gnu general public licen[sc]e"),
    ("mpl-2.0", 3, " source code form is subject", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-1.1", 3, " contents of this file are subject", "the contents of this file are subject to the mozilla public licen[sc]e"),
    ("epl", 3, " accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", 3, " contents of this file are subject", "the contents of this file are subject to the terms of the common development"),
    ("boost", 3, " distributed under the boost", "distributed under the boost software licen[sc]e"),
    ("zlib", 3, " in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 2, " altered source versions", "altered source versions must be plainly marked as such"),
    ("unlicense", 3, " free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, " do what the fuck", "do what the fuck you want to(?: public licen[sc]e)?"),
    ("beerware", 3, " buy me a beer", "you can buy me a beer in return"),
    ("json", 3, " for good not evil", "the software shall be used for good not evil"),
    ("openssl", 3, " developed by the openssl", "this product includes software developed by the openssl project"),
    ("psf-2.0", 3, " psf is making python", "psf is making python available to licensee"),
    ("ofl", 3, " this font software is licensed", "this font software is licensed under the sil open font licen[sc]e"),
    ("cc0", 3, (" dedicated the work", " waived all copyright"), "(?:dedicated the work to|waived all copyright and related)"),
    ("cc-by", 3, " this work is licensed under", "this work is licensed under (?:a|the) creative commons attribution"),
    ("sspl", 3, " functionality of the program", "make the functionality of the program or a modified version available to third parties as a service"),
    ("commons-clause", 3, " right to sell the software", "does not grant to you the right to sell the software"),
    # exceptions
    ("classpath-exception", 2, " classpath exception", "(?:gnu )?classpath exception(?: 2 0)?"),
    ("gcc-exception", 2, " gcc runtime", "gcc runtime library exception(?: version)?(?: 3 1)?"),
    ("llvm-exception", 2, " llvm exception", "(?:with )?llvm exceptions?"),
    ("font-exception", 2, " font exception", "font exception(?: 2 0)?"),
    ("autoconf-exception", 2, " autoconf", "autoconf (?:configure script )?exception(?: [23] 0)?"),
    ("bison-exception", 2, " bison exception", "bison exception(?: 2 2)?"),
    ("linking-exception", 2, " special exception", "as a special exception (?:[a-z0-9]+ ){0,20}permission to link"),
    ("linking-exception", 2, " linking exception", "linking exception"),
    ("universal-foss-exception", 2, " universal foss", "universal foss exception"),
    # notices
    ("all-rights-reserved", 1, " rights reserved", "all rights reserved"),
    ("some-rights-reserved", 1, " rights reserved", "some rights reserved"),
    ("copyright", 1, " copyright", "copyright (?:c )?(?:(?:19|20)[0-9]{2} )?(?:by )?[a-z]+"),
    ("copyright", 1, " spdx filecopyrighttext", "spdx filecopyrighttext [a-z0-9]+"),
    ("as-is", 1, " as is", "(?:provided|distributed) (?:on an )?as is"),
    ("no-warranty", 1, " warrant", "without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    ("no-liability", 1, " be liable", "in no event shall (?:[a-z0-9]+ ){1,12}be liable"),
    ("public-domain", 2, " public domain", "(?:in|into|to) the public domain"),
    ("public-domain", 2, " public domain", "(?:this (?:file|code|work|software) is )?dedicated to the public domain"),
    ("proprietary", 2, " proprietary", "proprietary and confidential"),
    ("proprietary", 2, " trade secret", "contains? (?:confidential )?trade secrets?"),
    ("proprietary", 2, " unpublished", "unpublished (?:proprietary )?source code"),
    ("proprietary", 2, " strictly prohibited", "unauthorized (?:copying|use|distribution) (?:[a-z0-9]+ ){0,12}strictly prohibited"),
    ("non-commercial", 2, (" noncommercial", " non commercial"), "(?:for )?(?:non ?commercial use only|personal use only non ?commercial)"),
    ("research-only", 2, " research purposes", "for (?:academic |non ?commercial )?research purposes only"),
    ("evaluation-only", 2, " evaluation", "for evaluation (?:purposes )?only"),
    ("dual-license", 2, (" dual licensed", " dually licensed"), "(?:dual|dually) licensed"),
    ("contributor-agreement", 1, " contributor licen", "contributor licen[sc]e agreement"),
    ("end-user-agreement", 1, " end user licen", "end user licen[sc]e agreement"),
    ("terms-of-service", 1, " terms of service", "(?:subject to|agree to) (?:the |our )?terms of service"),
    ("unspecified-license", 1, " licen", "(?:see|read) (?:the )?licen[sc]e(?: file| txt| md)?"),
    ("unspecified-license", 1, " copying", "see (?:the )?(?:file )?copying"),
    ("unspecified-license", 1, " licen", "licen[sc]e (?:file|agreement|information)"),
    ("unspecified-license", 1, " licen", "under (?:an? )?open source licen[sc]e"),
    ("patent-grant", 1, " patent licen", "(?:worldwide |perpetual |royalty free |non exclusive )*patent licen[sc]e"),
    ("attribution-required", 1, " attribution", "attribution (?:is )?required"),
)
CONFIDENCE = {1: 0.6, 2: 0.8, 3: 0.95}
RULE = "array<struct<ord: int, priority: int, keywords: array<string>, label: string, pattern: string>>"


def rules() -> list[dict]:
    """All rules in order: the names with their versions, the names alone, then the rules written one by one."""
    flat = [(p, k, f"{label}-{v}", form.format(name=name, version=version)) for label, k, name, versions in VERSIONED for v, version in versions.items() for p, form in EXACT]
    flat += [(p, k, label, form.format(name=name)) for label, k, name, _ in VERSIONED for p, form in BARE]
    flat += [(p, keyword, label, pattern) for label, p, keyword, pattern in SINGLES]
    return [{"ord": i, "priority": p, "keywords": [k] if isinstance(k, str) else list(k), "label": label, "pattern": f"(?<![^ ])(?:{pattern})(?![^ ])"} for i, (p, k, label, pattern) in enumerate(flat)]


def words(text: Column) -> Column:
    """Lower-case words joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS, " "))


def word_count(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def starts(joined: Column, pattern: Column) -> Column:
    """Word positions at which the pattern's matches start."""
    marked = F.split(F.regexp_replace(joined, pattern, F.lit(MARK + "$0")), " ")
    return F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(MARK), i).otherwise(-1)), lambda i: i >= 0)


def detections(joined: Column, rule: Column) -> Column:
    """Intervals (start, -end, -priority, ord, label), end exclusive, of a rule's matches."""
    found = F.regexp_extract_all(joined, rule["pattern"], F.lit(0))
    return F.when(
        F.size(found) > 0,
        F.transform(starts(joined, rule["pattern"]), lambda s, i: F.struct(s.alias("start"), (-(s + word_count(F.get(found, i)).cast("int"))).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["ord"].alias("ord"), rule["label"].alias("label"))),
    ).otherwise(F.array())


def suppress(found: Column) -> Column:
    """Sorted intervals without those contained in one of the same or a higher priority.

    In this order whatever may contain an interval stands before it, so the furthest end seen of each
    priority decides.
    """
    kind = "array<struct<start: int, minus_end: int, minus_priority: int, ord: int, label: string>>"
    zero = F.struct(*(F.lit(0).alias(f"m{p}") for p in CONFIDENCE), F.array().cast(kind).alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.greatest(*(F.when(priority <= p, state[f"m{p}"]).otherwise(0) for p in CONFIDENCE))
        far = [F.when(priority == p, F.greatest(end, state[f"m{p}"])).otherwise(state[f"m{p}"]).alias(f"m{p}") for p in CONFIDENCE]
        return F.struct(*far, F.when(reach >= end, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    return F.aggregate(F.array_sort(found), zero, step, lambda state: state["kept"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and the kept detections."""
    made = rules()
    table = F.from_json(F.lit(json.dumps(made)), RULE)
    keywords = F.array(*(F.lit(k) for k in sorted({k for r in made for k in r["keywords"]})))
    # keywords are word beginnings, except those that end in a space
    df = docs.withColumn("__w", words(F.col(text))).withColumn("__p", F.concat(F.lit(" "), F.col("__w"), F.lit(" ")))
    base = [F.when(F.contains("__p", F.lit(f" {phrase} ")), starts(F.col("__w"), F.lit(f"(?<![^ ]){phrase}(?![^ ])"))).otherwise(F.array().cast("array<int>")) for phrase, _ in BASE]
    df = df.withColumn("__base", F.array(*base)).withColumn("__keys", F.filter(keywords, lambda k: F.contains(F.col("__p"), k)))
    found = F.flatten(F.transform(F.filter(table, lambda r: F.arrays_overlap(F.col("__keys"), r["keywords"])), lambda r: detections(F.col("__w"), r)))
    df = df.withColumn("detections", F.when(F.size("__keys") > 0, suppress(found)).otherwise(F.array().cast("array<struct<start: int, minus_end: int, minus_priority: int, ord: int, label: string>>")))
    places = F.flatten("__base")
    base_labels = reduce(F.array_union, [F.when(F.size(F.col("__base")[i]) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, (_, label) in enumerate(BASE)])
    sure = F.array_max(F.transform("detections", lambda d: reduce(lambda a, p: F.when(d["minus_priority"] == -p, F.lit(CONFIDENCE[p])).otherwise(a), CONFIDENCE, F.lit(0.0))))
    return df.withColumns(
        {
            "n_words": word_count(F.col("__w")),
            "n_base": F.size(places).cast("long"),
            "first_word": F.array_min(places).cast("long"),
            "last_word": F.array_max(places).cast("long"),
            "base_labels": F.array_join(F.array_sort(base_labels), ","),
            "labels": F.array_join(F.array_sort(F.array_union(base_labels, F.transform("detections", lambda d: d["label"]))), ","),
            "score": F.coalesce(sure, F.when(F.size(places) > 0, F.lit(CONFIDENCE[2])), F.lit(0.0)),
        }
    ).drop("__w", "__p", "__base", "__keys")


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {"op7_license_rules": op7_license_rules}
ORACLES: dict[str, str] = {}
