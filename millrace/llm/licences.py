"""License scans by sentence rules, in DataFrame functions only.

A text is cut into paragraphs at blank lines and sentence ends, and these into
pieces at line ends, commas, colons, semicolons, brackets and dashes and before
words that open a notice, with comment marks left out. Runs of whole pieces are
looked up among known licence sentences, so that a wrapped sentence is found
like one on a single line, and a clause after a notice does not hide it; the
longest run from a piece counts. That gives a sequence of identifiers. Ordered
rules, longer and more specific ones first, are matched against that sequence;
a rule takes the identifiers that it matches, so that a shorter one does not
report them again. SPDX lines give an identifier for each of their licences.

Rows: null and blank texts have no sentences and no licence; texts are read
whole; repeated rows each get a result; an existing column of an output's name
is replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public names of licences and how short notices write them.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0", "apache 2 0"),
    "MIT": ("mit license", "mit licence", "expat license", "terms of the mit license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl v3", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "agpl v3", "agplv3"),
    "MPL-1.1": ("mozilla public license version 1 1", "mpl 1 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license"),
    "0BSD": ("zero clause bsd license", "bsd zero clause license", "0bsd license"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license", "zlib libpng license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost software license"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public license version 1 2", "eupl 1 2"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "common development and distribution license 1 0"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "MS-PL": ("microsoft public license", "ms pl"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "PostgreSQL": ("postgresql license",),
    "PSF-2.0": ("python software foundation license version 2", "psf license version 2"),
    "ODbL-1.0": ("open database license", "open data commons open database license"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("creative commons zero 1 0", "creative commons zero v1 0 universal", "cc0 1 0 universal", "cc0 1 0"),
    "CC-BY-3.0": ("creative commons attribution 3 0 unported license", "creative commons attribution 3 0 license", "cc by 3 0"),
    "CC-BY-4.0": ("creative commons attribution 4 0 international license", "creative commons attribution 4 0 license", "cc by 4 0"),
    "CC-BY-SA-3.0": ("creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0 license", "cc by sa 3 0"),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license", "cc by sa 4 0"),
    "CC-BY-ND-4.0": ("creative commons attribution noderivatives 4 0 international license", "cc by nd 4 0"),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0"),
    "CC-BY-NC-SA-4.0": ("creative commons attribution noncommercial sharealike 4 0 international license", "cc by nc sa 4 0"),
    "CC-BY-NC-ND-4.0": ("creative commons attribution noncommercial noderivatives 4 0 international license", "cc by nc nd 4 0"),
}
#: Families of which a notice may allow later versions.
LATER = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")

#: Sentences of public licence texts and notices, normalised, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "apache-not-except": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: The free-software notices by their licence's name and version; {later} is the clause on later versions.
FREE = "this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation {version}"
FREE_NAMES = {
    "GPL-2.0": ("general public license", "2"), "GPL-3.0": ("general public license", "3"), "LGPL-2.1": ("lesser general public license", "2 1"),
    "LGPL-3.0": ("lesser general public license", "3"), "AGPL-3.0": ("affero general public license", "3"),
}
#: How the full texts of licences open, with their dates.
TITLES = {
    "apache license version 2 0 january 2004": "Apache-2.0", "gnu general public license version 3 29 june 2007": "GPL-3.0", "gnu general public license version 2 june 1991": "GPL-2.0",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-2.1", "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0", "boost software license version 1 0 august 17th 2003": "BSL-1.0",
}
#: Ordered rules of whole texts, as licence and sequence of identifiers.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-old",)),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-author")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("Apache-2.0", ("notice:Apache-2.0", "apache-not-except", "apache-copy")),
    *((f"{f}-or-later", (f"free-later:{f}", w)) for f in LATER for w in ("gpl-warranty", "lgpl-warranty")),
    *((f"{f}-or-later", (f"free-later:{f}",)) for f in LATER),
    *((f"{f}-only", (f"free-only:{f}",)) for f in LATER),
    ("MPL-2.0", ("mpl-subject",)),
)
#: Every known sentence holds one of these, however it is wrapped; texts without any are not cut at all.
HINT = "licen[sc]e|copyright|permi|warrant|redistribut|compliance|mozilla|gnu|gpl|apache|creative|cc0|cc[^a-z0-9]|mit[^a-z0-9]|unencumbered|express|neither|spdx|mpl|eupl|ms-pl|ms pl"


def _plain(name: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def known_sentences() -> dict[str, str]:
    """Sentence to identifier: the fixed sentences, the free-software notices, short notices made from openings and names, and SPDX lines."""
    out = {text: name for name, text in SENTENCES.items()} | {text: f"notice:{licence}" for text, licence in TITLES.items()}
    for f, (name, v) in FREE_NAMES.items():
        for what in ("program", "library", "software", "file"):
            later = "or at your option any later version"
            out[FREE.format(what=what, name=name, version=f"either version {v} of the license {later}")] = f"free-later:{f}"
            out[FREE.format(what=what, name=name, version=f"version {v} of the license {later}")] = f"free-later:{f}"
            out[FREE.format(what=what, name=name, version=f"version {v} of the license")] = f"free-only:{f}"
            out[FREE.format(what=what, name=f"{name} version {v}", version="").strip()] = f"free-only:{f}"
    for licence, names in NAMES.items():
        for end in ("", *((" or later", " or any later version", " or at your option any later version") if licence in LATER else ())):
            to = f"{licence}-or-later" if end else licence
            out |= {f"licensed under {name}{end}": f"notice:{to}" for name in names}
        out[f"licensed under {names[-1]} which is available at"] = f"notice:{licence}"
        out |= {f"spdx license identifier {name}": f"notice:{licence}" for name in names}
        out |= {f"spdx license identifier {_plain(x)}": f"notice:{x}" for x in (licence, *((f"{licence}-only", f"{licence}-or-later") if licence in LATER else ()))}
    return out


def rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    stated = dict.fromkeys(i[7:] for i in known_sentences().values() if i.startswith("notice:"))
    return (*RULES, *((licence, (f"notice:{licence}",)) for licence in stated))


#: How a notice opens; all are written as the first, without an article.
OPENING = r"\b(?:licensed|released|distributed|published|provided|offered|available|covered|made[^a-z0-9.;:]+available|the[^a-z0-9.;:]+asf[^a-z0-9.;:]+licenses[^a-z0-9.;:]+this[^a-z0-9.;:]+file[^a-z0-9.;:]+to[^a-z0-9.;:]+you)[^a-z0-9.;:]+under(?:[^a-z0-9.;:]+the[^a-z0-9.;:]+terms[^a-z0-9.;:]+of)?(?:[^a-z0-9.;:]+(?:the|an|a))?\b"
#: Steps from a lower-case text to lines that are pieces, with a blank line after each sentence: pattern and replacement.
#: Slots come first: a name in a sentence gives way to the words that the known sentence has there.
_GAP, _STEP = "[^a-z0-9]+", r"[^a-z0-9.;:]+"
CUTS = (
    ("\r\n?", "\n"),
    (r"\n[ \t]*(?:dnl|rem)\b", "\n"),
    # the organisation that a BSD licence names
    (rf"\bneither{_GAP}(?:the{_GAP})?names?{_GAP}of{_GAP}[\s\S]{{1,200}}?\bnor{_GAP}(?:the{_GAP})?names?{_GAP}of{_GAP}(?:(?:its|the|any|other|their){_GAP})*contributors\b", "neither the name of the copyright holder nor the names of its contributors"),
    # the program that a free-software notice names
    (rf"(\n|[.!?][ \t]+)[^a-z0-9\n]*(?:[a-z0-9][a-z0-9+_-]*[ \t]+){{1,6}}is{_GAP}free{_GAP}software\b", "\\1\nthis program is free software"),
    (rf"(\n|[.!?][ \t]+)[^a-z0-9\n]*(?:[a-z0-9][a-z0-9+_-]*[ \t]+){{1,6}}is{_GAP}distributed{_GAP}in{_GAP}the{_GAP}hope\b", "\\1\nthis program is distributed in the hope"),
    # fields of manifests and classifiers
    (r"\blicense[ \t]*::[ \t]*osi[ \t]+approved[ \t]*::[ \t]*", "\nspdx-license-identifier "),
    (r"(\n|[{,;])[^a-z0-9\n]*licen[sc]e[\"']?[ \t]*[:=][ \t]*[\"'(]*", "\\1\nspdx-license-identifier "),
    # the title that a text opens with
    (r"^[^a-z0-9]*(?:the[ \t]+)?((?:mit|isc|bsd[ \t]+[23]-clause)[ \t]+license|(?:mozilla[ \t]+public|eclipse[ \t]+public|apache|boost[ \t]+software)[ \t]+license,?[ \t]+(?:version[ \t]+|v[ \t]*\.?[ \t]*)[0-9.]+)[^a-z0-9\n]*(?:\n|$)", "\nlicensed under \\1\n\n"),
    # negations, then other ways to state a licence
    (r"\bnot[ \t]+(licensed|released|distributed|published|provided|offered|available|covered|made)[ \t]+under\b", r"not\1under"),
    (r"\bnot[ \t]+under\b", "notunder"),
    (rf"\bis{_STEP}(mit|isc|apache[ -]2[.]0|bsd[ -][23][ -]clause|gpl[ -]?v[23]|mpl[ -]2[.]0)[ -]licensed\b", "\nlicensed under \\1 license"),
    (rf"\b(?:licensed|released|available|dual[ -]licensed){_STEP}under{_STEP}(?:the{_STEP}terms{_STEP}of{_STEP})?either{_STEP}of:?[^a-z0-9]*\n[^a-z0-9]*(?:the[ \t]+)?([^\n]+)\n[^a-z0-9]*(?:or[ \t]+)?(?:the[ \t]+)?", "\nlicensed under \\1\nlicensed under "),
    (rf"\b(?:licensed|released|available|dual[ -]licensed){_STEP}under{_STEP}(?:the{_STEP}terms{_STEP}of{_STEP})?either{_STEP}(?:of{_STEP})?(?:the{_STEP})?([\s\S]{{1,120}}?){_GAP}or{_GAP}(?:the{_GAP})?", "\nlicensed under \\1\nlicensed under "),
    (rf"\bunder{_STEP}the{_STEP}(mit|apache|bsd|isc|zlib|boost|mozilla|eclipse|unlicense)\b", "\nlicensed under \\1"),
    (r"\b(licen[sc]e|[0-9])[ \t]+at[ \t]+your[ \t]+option\b", "\\1\nat your option"),
    (r"\bv\.\s*([0-9])", r"v \1"),
    (r"spdx-license-identifier:[ \t(]*", "\nspdx-license-identifier "),
    (r"\bnot[ \t]+(licensed|released|distributed|made)\b", r"not\1"),
    (OPENING, "\nlicensed under"),
    (r"([a-z0-9.,;:)])[ \t]+(?:--?|\x{2013}|\x{2014})[ \t]+", "\\1\n"),
    (r"([.!?;:,)])[ \t]+", "\\1\n"),
    (r"([a-z0-9.,;:)])[ \t]+\(", "\\1\n("),
    (r"([a-z0-9)\"'][.!?][^a-z0-9\n]*)\n", "\\1\n\n"),
)


def paragraphs(text: Column) -> Column:
    """Lower-case paragraphs, ended by a blank line or a sentence's end, with a line for each piece."""
    out = F.concat(F.lit("\n"), F.lower(text))
    for pattern, new in CUTS:
        out = F.regexp_replace(out, pattern, new.replace("\\1", "$1"))
    return F.split(out, r"\n[^a-z0-9]*\n")


def pieces_of(paragraph: Column) -> Column:
    """Normalised pieces; an SPDX line gives one for each licence of its expression."""
    mark = "spdx-license-identifier "

    def parts(line: Column) -> Column:
        named = F.transform(F.split(F.regexp_replace(line, r"^.*spdx-license-identifier |[ \t]with[ \t].*$", ""), r"[ \t()]+(?:or|and)[ \t()]+"), lambda x: F.concat(F.lit(mark), x))
        return F.when(line.contains(mark), named).otherwise(F.array(line))

    lines = F.flatten(F.transform(F.split(paragraph, "\n"), parts))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))), lambda x: x != "")


def _opening(known: dict[str, str]) -> str:
    """A pattern of pieces that a known sentence can open with: its first two words, or the first alone."""
    first = {tuple(s.split()[:2]) for s in known}
    return "^(?:" + "|".join(sorted({" ".join(x) + r"\b" for x in first} | {x[0] + "$" for x in first})) + ")"


def license_sequence(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known or known_sentences()
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    longest, words, opening = max(map(len, known)), max(len(s.split()) for s in known), _opening(known)
    none = F.lit(None).cast("string")

    def longer(acc: Column, piece: Column) -> Column:
        run = F.when(F.length(acc.run) <= longest, F.concat_ws(" ", F.when(acc.run != "", acc.run), piece)).otherwise(acc.run)
        found = F.when(F.length(run) <= longest, F.element_at(table, run))
        return F.struct(run.alias("run"), (acc.n + 1).alias("n"), F.when(found.isNotNull(), acc.n + 1).otherwise(acc.size).alias("size"), F.coalesce(found, acc.id).alias("id"))

    def longest_run(pieces: Column, i: Column) -> Column:
        start = F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), F.lit(0).alias("size"), none.alias("id"))
        return F.aggregate(F.slice(pieces, i, words), start, longer, lambda acc: F.struct(i.alias("at"), acc.size.alias("size"), acc.id.alias("id")))

    def after_last(acc: Column, run: Column) -> Column:
        free = run.at >= acc.next
        return F.struct(F.when(free, run.at + run.size).otherwise(acc.next).alias("next"), F.when(free, F.array_append(acc.ids, run.id)).otherwise(acc.ids).alias("ids"))

    def of(pieces: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: F.try_element_at(pieces, i).rlike(opening))
        runs = F.filter(F.transform(starts, lambda i: longest_run(pieces, i)), lambda r: r.id.isNotNull())
        return F.aggregate(runs, F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("ids")), after_last, lambda acc: acc.ids)

    ids = F.flatten(F.transform(F.transform(F.filter(paragraphs(text), lambda p: p.rlike(HINT)), pieces_of), of))
    return F.when(F.lower(text).rlike(HINT), ids).otherwise(F.array().cast("array<string>"))


def match_rules(sequence: Column, ordered=None) -> Column:
    """Licences in order of the rules that match, each once; a matched run of identifiers is used up."""
    ordered = ordered or rules()
    steps = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("," + ",,".join(ids) + ",").alias("run")) for licence, ids in ordered])
    start = F.struct(F.concat(F.lit(","), F.array_join(sequence, ",,"), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = acc.left.contains(rule.run)
        return F.struct(F.when(hit, F.replace(acc.left, rule.run, F.lit("|"))).otherwise(acc.left).alias("left"), F.when(hit, F.array_append(acc.found, rule.licence)).otherwise(acc.found).alias("found"))

    found = F.array_distinct(F.aggregate(steps, start, step, lambda acc: acc.found))
    return F.when(F.size(sequence) > 0, found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with license_sentences (identifiers in order) and licenses."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("license_sentences", license_sequence(text)).withColumn("licenses", match_rules(F.col("license_sentences")))


def oracle(source: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    sentences = known_sentences()
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sentences.items())
    most = max(len(s.split()) for s in sentences)
    text = "chr(10) || lower(coalesce(text, ''))"
    for pattern, new in CUTS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(new)}, 'g')"
    steps = ", ".join(f"{{'rest': {quote(',' + ',,'.join(ids) + ',')}, 'found': {quote(licence)}}}" for licence, ids in rules())
    return rf"""WITH known(sentence, id) AS (VALUES {known}),
para AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split_regex({text}, '\n[^a-z0-9]*\n') AS p FROM {source} WHERE regexp_matches(lower(text), '{HINT}'))),
lines AS (SELECT doc_id, k, unnest(l) AS l, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, k, string_split(p, chr(10)) AS l FROM para WHERE regexp_matches(p, '{HINT}'))),
parts AS (SELECT doc_id, k, i, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, k, i, CASE WHEN contains(l, 'spdx-license-identifier ')
  THEN list_transform(string_split_regex(regexp_replace(l, '^.*spdx-license-identifier |[ \t]with[ \t].*$', '', 'g'), '[ \t()]+(?:or|and)[ \t()]+'), lambda x: 'spdx-license-identifier ' || x) ELSE [l] END AS x FROM lines)),
norm AS (SELECT doc_id, k, i, j, trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) AS x FROM parts),
pieces AS (SELECT doc_id, k, list(x ORDER BY i, j) AS p FROM norm WHERE x <> '' GROUP BY doc_id, k),
runs AS (SELECT doc_id, k, p, a, unnest(range(a, least(len(p), a + {most - 1}) + 1)) AS b FROM (SELECT doc_id, k, p, unnest(range(1, len(p) + 1)) AS a FROM pieces) WHERE regexp_matches(p[a], '{_opening(sentences)}')),
hits AS (SELECT doc_id, k, a, max(b) + 1 AS next, arg_max(id, b) AS id FROM runs JOIN known ON known.sentence = array_to_string(p[a : b], ' ') GROUP BY doc_id, k, a),
taken AS (SELECT doc_id, k, list_reduce(list({{'a': a, 'next': next, 'ids': [id]}} ORDER BY a), lambda acc, x: CASE WHEN x.a >= acc.next THEN {{'a': acc.a, 'next': x.next, 'ids': list_concat(acc.ids, x.ids)}} ELSE acc END).ids AS ids FROM hits GROUP BY doc_id, k),
seq AS (SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM taken GROUP BY doc_id),
done AS (SELECT doc_id, len(ids) AS n, list_reduce([{steps}], lambda acc, r: CASE WHEN contains(acc.rest, r.rest)
  THEN {{'rest': replace(acc.rest, r.rest, '|'), 'found': CASE WHEN contains(',' || acc.found || ',', ',' || r.found || ',') THEN acc.found WHEN acc.found = '' THEN r.found ELSE acc.found || ',' || r.found END}} ELSE acc END,
  {{'rest': ',' || array_to_string(ids, ',,') || ',', 'found': ''}}).found AS found FROM seq)
SELECT d.doc_id, coalesce(n, 0) AS n_license_sentences, coalesce(found, '') AS licenses FROM {source} d LEFT JOIN done USING (doc_id)"""
