"""License scans by ordered signature rules.

A text is reduced to words (A-Z lower-cased; runs of letters a-z, digits and non-ASCII characters) joined by
one blank, and rules are regular expressions over that. A rule runs only on texts that hold all keywords
of one of its sets, and each match holds one of the sets; most texts hold none. Detections are word intervals. One is dropped if another of at least
its priority contains it; of equal ones the rule that comes first in order stays.

The rules are made of a table of license names (each name a pattern written by hand) and of the forms in
which a name occurs: alone, with a version, in a grant, as an identifier, as a file or address.

Results for edge cases: a null or empty text has no words, no detections and score 0. Very long texts are
scanned whole, in time linear in words plus detections. Repeated rows give repeated results. Ties
between equal intervals go to the higher priority, then to the earlier rule.
"""

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geopulse.llm.common import keyed_text

# The phrases of the base scan and their labels.
BASE_PHRASES = (
    (b"mit license", "mit"),
    (b"apache license", "apache"),
    (b"general public license", "gpl"),
)

# Label; sets of keywords, one of which is whole in each match of the name's pattern (a test
# runs through all alternatives); pattern of the name over lower-cased words; versions as words; identifiers.
NAMES = (
    # Before mit, whose identifier may be followed by a version.
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?", "", "mit 0"),
    ("mit", "mit|expat", r"(?:mit|expat)(?: x11)?(?: style)?(?: open source)? licen[cs]e", "", "mit expat"),
    ("x11", "x11", r"x11 licen[cs]e", "", "x11"),
    ("isc", "isc", r"isc(?: open source)? licen[cs]e", "", "isc"),
    ("bsd", "bsd", r"bsd(?: style)?(?: [0-4] clause)?(?: licen[cs]e)", "", "bsd"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|revised bsd|modified bsd)(?: licen[cs]e)?", "", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?", "", "bsd 4 clause"),
    ("0bsd", "bsd clause", r"(?:zero|0) clause bsd(?: licen[cs]e)?", "", "0bsd"),
    ("apache", "apache", r"apache(?: software)?(?: foundation)? licen[cs]e", "1 0|1 1|2 0", "apache"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "1|2|3|1 0|2 0|3 0", "gpl gplv2 gplv3"),
    ("gpl-abbreviation", "gpl", r"(?:gnu )?gpl", "1|2|3|2 0|3 0", ""),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", "2 1|3|3 0", "lgpl"),
    ("lgpl-library", "library", r"(?:gnu )?library general public licen[cs]e", "2|2 0", ""),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1|1 0|3|3 0", "agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", "1 1|1 2|1 3", "gfdl"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "1 0|1 1|2 0", "mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "1 0|2 0", "epl"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", "1 0", ""),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", "1 0|1 1", "cddl"),
    ("cpl", "common", r"common public licen[cs]e", "0 5|1 0", "cpl"),
    ("ipl", "ibm", r"ibm public licen[cs]e", "1 0", "ipl"),
    ("eupl", "european", r"european union public licen[cs]e", "1 0|1 1|1 2", "eupl"),
    ("osl", "open", r"open software licen[cs]e", "1 0|2 0|2 1|3 0", "osl"),
    ("afl", "academic", r"academic free licen[cs]e", "1 1|1 2|2 0|2 1|3 0", "afl"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic licen[cs]e", "1 0|2 0", "artistic"),
    ("bsl", "boost", r"boost software licen[cs]e", "1 0", "bsl"),
    ("busl", "business", r"business source licen[cs]e", "1 0|1 1", "busl"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "", "zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", "2 0", "libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", "2", "wtfpl"),
    ("psf", "python", r"python software foundation licen[cs]e", "2|2 0", "psf"),
    ("python", "python", r"python licen[cs]e", "2 0", "python"),
    ("php", "php", r"php licen[cs]e", "3 0|3 01", "php"),
    ("ruby", "ruby", r"ruby licen[cs]e", "", "ruby"),
    ("openssl", "openssl", r"openssl licen[cs]e", "", "openssl"),
    ("openldap", "openldap", r"openldap public licen[cs]e", "2 8", "oldap"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "", "postgresql"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e", "", "ncsa"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "", "ms rl"),
    ("apsl", "apple", r"apple public source licen[cs]e", "1 0|1 1|2 0", "apsl"),
    ("qpl", "public", r"q public licen[cs]e", "1 0", "qpl"),
    ("sspl", "server", r"server side public licen[cs]e", "1", "sspl"),
    ("elastic", "elastic", r"elastic licen[cs]e", "1 0|2 0", "elastic"),
    ("ofl", "sil", r"sil open font licen[cs]e", "1 0|1 1", "ofl"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e", "1 0", "odbl"),
    ("pddl", "public", r"public domain dedication and licen[cs]e", "1 0", "pddl"),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", "1|1 1|2|2 0|2 1", "cecill"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", "", "w3c"),
    ("upl", "universal", r"universal permissive licen[cs]e", "1 0", "upl"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)", "1|2", "mulanpsl"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: universal)?(?: public domain dedication)?", "1 0", "cc0"),
    ("cc-by", "cc", r"(?:creative commons )?cc by", "1 0|2 0|2 5|3 0|4 0", "cc by"),
    ("cc-by-sa", "cc", r"(?:creative commons )?cc by sa", "1 0|2 0|2 5|3 0|4 0", "cc by sa"),
    ("cc-by-nc", "cc", r"(?:creative commons )?cc by nc", "1 0|2 0|2 5|3 0|4 0", "cc by nc"),
    ("cc-by-nd", "cc", r"(?:creative commons )?cc by nd", "1 0|2 0|2 5|3 0|4 0", "cc by nd"),
    ("cc-by-nc-sa", "cc", r"(?:creative commons )?cc by nc sa", "1 0|2 0|2 5|3 0|4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "cc", r"(?:creative commons )?cc by nc nd", "1 0|2 0|2 5|3 0|4 0", "cc by nc nd"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e", "", ""),
    ("cc-by-sa", "attribution", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e", "", ""),
    ("cc-by-nc", "attribution", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e", "", ""),
    ("cc-by-nd", "attribution", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e", "", ""),
)

# Label, abbreviation and versions. The version may be glued to the name, with or without a v.
ABBREVIATIONS = (
    ("gpl-abbreviation", "gpl", "1|1 0|2|2 0|3|3 0"), ("lgpl", "lgpl", "2|2 0|2 1|3|3 0"), ("agpl", "agpl", "1|1 0|3|3 0"), ("gfdl", "gfdl", "1 1|1 2|1 3"),
    ("mpl", "mpl", "1 0|1 1|2 0"), ("epl", "epl", "1 0|2 0"), ("cddl", "cddl", "1 0|1 1"), ("eupl", "eupl", "1 0|1 1|1 2"), ("apache", "apache", "1 0|1 1|2 0"),
)

# Label, keywords, pattern, weight of statements that carry no license name.
STATEMENTS = (
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 0.6),
    ("proprietary", "proprietary confidential", r"proprietary and confidential|confidential and proprietary", 0.8),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain", 0.8),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 1.0),
    ("no-warranty", "warranty", r"without warranty of any kind|provided as is without(?: any)? warranty", 0.3),
)

GRANT = (
    r"(?:licensed|licenced|released|distributed|available|published|provided|covered|redistributed|made available)"
    r"(?: to you)?(?: only)? (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? "
)
# The word a grant cannot do without is the name's own.
VERSION = r"(?: licen[cs]e)?(?: as published by the free software foundation)?(?: either)?(?: v| ver| version)? ?"


class Rule(NamedTuple):
    label: str
    keywords: tuple[frozenset, ...]
    pattern: re.Pattern
    priority: int
    weight: float


def compile_rule(label, keywords, pattern, priority, weight) -> Rule:
    whole = rf"(?<![^ ])(?:{pattern})(?![^ ])"
    sets = tuple(frozenset(k.encode() for k in one.split()) for one in keywords.split("|"))
    return Rule(label, sets, re.compile(whole.encode()), priority, weight)


def with_glued(keywords: str, digits: str) -> str:
    """Also the sets in which a word and the version after it are one word, as in GPL2."""
    sets = [one.split() for one in keywords.split("|")]
    glued = [[*one[:i], one[i] + digits, *one[i + 1 :]] for one in sets for i in range(len(one))]
    return "|".join(" ".join(one) for one in sets + glued)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the most telling forms first."""
    out = []
    for label, keywords, pattern, weight in STATEMENTS:
        out.append(compile_rule(label, keywords, pattern, 3 if weight == 1.0 else 1, weight))
    for label, short, versions in ABBREVIATIONS:
        for version in sorted(versions.split("|"), key=len, reverse=True):
            tag, digit = f"{label}-{version.replace(' ', '.')}", version.split()[0]
            named = rf"(?:gnu )?{short}(?: (?:v|ver|version))? ?v?{version}(?: only| or later| or any later version)?"
            either = f"{short}|{short}v{digit}|{short}{digit}"
            out.append(compile_rule(tag, "|".join(f"spdx {k}" for k in either.split("|")), rf"spdx licen[cs]e identifier {named}", 5, 1.0))
            out.append(compile_rule(tag, either, named, 3, 0.9))
    for label, keywords, name, versions, ids in NAMES:
        for version in sorted(filter(None, versions.split("|")), key=len, reverse=True):
            tag = f"{label}-{version.replace(' ', '.')}"
            either = with_glued(keywords, version.split()[0])
            out.append(compile_rule(tag, either, GRANT + name + VERSION + version, 4, 1.0))
            out.append(compile_rule(tag, either, name + VERSION + version, 3, 0.9))
        if ids:
            ids = ids.split() if label in ("mit", "gpl") else [ids]
            codes = "|".join(ids)
            out.append(compile_rule(label, f"spdx {ids[0].split()[0]}" if len(ids) == 1 else "spdx", rf"spdx licen[cs]e identifier (?:{codes})(?: [0-9]{{1,2}}){{0,2}}(?: only| or later)?", 4, 1.0))
        out.append(compile_rule(label, keywords, GRANT + name, 3, 0.9))
        out.append(compile_rule(label, keywords, name, 2, 0.7))
    return tuple(out)


class Scanner:
    """Rules by keyword, and the table that turns a text's bytes into words."""

    def __init__(self, chosen=None):
        self.rules = chosen or rules()
        self.by_keyword = {}
        for i, rule in enumerate(self.rules):
            # One of a set's keywords leads to its rule; the others are checked then.
            for need in rule.keywords:
                self.by_keyword.setdefault(min(need), []).append((i, need))
        self.keywords = frozenset(k for rule in self.rules for need in rule.keywords for k in need)
        self.keywords |= {w for phrase, _ in BASE_PHRASES for w in phrase.split()}
        self.base = [(re.compile(rb"(?<![^ ])" + p + rb"(?![^ ])"), frozenset(p.split()), label) for p, label in BASE_PHRASES]
        # Digits, letters and all bytes of non-ASCII characters make words; the rest parts them.
        keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
        table = [b if b in keep else 0x20 for b in range(256)]
        for b in range(0x41, 0x5B):
            table[b] = b + 32
        self.to_words = bytes(table)

    def scan(self, text: str):
        """(number of words, base places, detections); places and detections are
        (label, first word, last word, priority, weight)."""
        words = text.encode().translate(self.to_words).split()
        hits = self.keywords.intersection(words)
        if not hits:
            return len(words), [], []
        line = b" ".join(words)
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)

        def found(pattern, label, priority, weight):
            for m in pattern.finditer(line):
                first, last = np.searchsorted(blanks, [m.start(), m.end() - 1])
                yield label, int(first), int(last), priority, weight

        base = [d for p, need, label in self.base if need <= hits for d in found(p, label, 0, 0.7)]
        chosen = sorted({i for k in hits for i, need in self.by_keyword.get(k, ()) if need <= hits})
        every = [(*d, i) for i in chosen for d in found(self.rules[i].pattern, *self.rules[i][:1], *self.rules[i][3:])]
        return len(words), base, outermost(every)


def outermost(detections):
    """Detections that no other of at least their priority contains."""
    out, reach = [], {}
    for d in sorted(detections, key=lambda d: (d[1], -d[2], -d[3], d[5])):
        _, _, last, priority, _, _ = d
        # All before start no later; one that ends no earlier contains this one.
        if any(end >= last for level, end in reach.items() if level >= priority):
            continue
        reach[priority] = max(last, reach.get(priority, -1))
        out.append(d[:5])
    return out


DETECTION = "array<struct<label:string,first:bigint,last:bigint,priority:int,weight:double>>"
ARROW_DETECTION = pa.list_(
    pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())])
)


def scan(df: DataFrame, key="doc_id", text="text", chosen=None) -> DataFrame:
    """``doc_id, n_words, base, detections`` of every row."""
    rows = keyed_text(df, key, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, base {DETECTION}, detections {DETECTION}"
    names = ["label", "first", "last", "priority", "weight"]

    def run(batches):
        scanner = Scanner(chosen)
        for batch in batches:
            got = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64())]
            for i in (1, 2):
                columns.append(pa.array([[dict(zip(names, d)) for d in g[i]] for g in got], ARROW_DETECTION))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "detections"])

    return rows.mapInArrow(run, schema)
