"""License scans by ordered signature rules.

A text is reduced to words (A-Z lower-cased; ASCII punctuation and controls
separate words) joined by one space. Each rule is a regular expression over that
form, gated by keywords: it runs only on texts that contain all of its words.
Overlapping detections are settled by priority: one that lies within the
interval of a kept detection of the same or a better priority is suppressed.
Base phrases are exempt, so that they are always reported. Rules of one priority
go in the order of the tables below: of two that find the same interval, the
earlier one stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, table

_WORD = bytes(c if 48 <= c < 58 or c >= 97 and c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # smaller is better
    confidence: float
    needs: frozenset[bytes]
    pattern: re.Pattern
    base: bool = False


# label | name as it stands in prose | SPDX identifier | place on the web | words that any form of the name has, or one of a|b
FAMILIES = [
    ("apache-2.0", r"apache(?: software)? licen[sc]e(?: v(?:ersion)? ?)?(?: version)? 2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0", "apache"),
    ("apache-1.1", r"apache(?: software)? licen[sc]e(?: v(?:ersion)?)?(?: version)? 1 1", r"apache 1 1", r"apache org licenses license 1 1", "apache"),
    ("mit", r"mit(?: x11)? licen[sc]e", r"mit", r"opensource org licenses mit", "mit"),
    ("expat", r"expat licen[sc]e", r"expat", r"directory fsf org wiki license expat", "expat"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?", r"bsd 2 clause", r"opensource org licenses bsd 2 clause", "bsd"),
    ("bsd-3-clause", r"(?:modified|new|revised|3 clause|three clause) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?", r"bsd 3 clause", r"opensource org licenses bsd 3 clause", "bsd"),
    ("bsd", r"bsd(?: style)? licen[sc]e", r"bsd", r"opensource org licenses bsd license", "bsd"),
    ("0bsd", r"zero clause bsd(?: licen[sc]e)?", r"0bsd", r"opensource org licenses 0bsd", "bsd"),
    ("isc", r"isc licen[sc]e", r"isc", r"opensource org licenses isc", "isc"),
    ("gpl-2.0", r"gnu (?:general public licen[sc]e|gpl)(?: as published by the free software foundation)? (?:v|version )?2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0", "gnu"),
    ("gpl-3.0", r"gnu (?:general public licen[sc]e|gpl)(?: as published by the free software foundation)? (?:v|version )?3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0", "gnu"),
    ("gpl-any", r"gnu gpl|gplv[123]|gnu general public licen[sc]e", r"gpl", r"gnu org (?:copyleft|licenses) gpl", "gnu|gplv1|gplv2|gplv3"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public licen[sc]e (?:v|version )?2(?: [01])?", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1", "general"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public licen[sc]e (?:v|version )?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0", "general"),
    ("lgpl-any", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", r"lgpl", r"gnu org (?:copyleft|licenses) (?:lesser|lgpl)", "general"),
    ("agpl-3.0", r"(?:gnu )?affero general public licen[sc]e(?: (?:v|version )?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0", "affero"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e", r"gfdl 1 [123]", r"gnu org (?:copyleft|licenses) fdl", "documentation"),
    ("mpl-1.1", r"mozilla public licen[sc]e(?: v| version)? 1 1", r"mpl 1 1", r"mozilla org mpl (?:mpl )?1 1", "mozilla"),
    ("mpl-2.0", r"mozilla public licen[sc]e(?: v| version)? 2(?: 0)?", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0", "mozilla"),
    ("epl-1.0", r"eclipse public licen[sc]e(?: v| version)? ?1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10", "eclipse"),
    ("epl-2.0", r"eclipse public licen[sc]e(?: v| version)? ?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl (?:v20|2 0)", "eclipse"),
    ("eupl", r"european union public licen[sc]e(?: v| version)?(?: 1 [012])?", r"eupl 1 [012]", r"joinup ec europa eu \w+ eupl", "european"),
    ("cddl", r"common development and distribution licen[sc]e(?: v| version)?(?: 1 [01])?", r"cddl 1 [01]", r"opensource org licenses cddl1", "distribution"),
    ("cpl", r"common public licen[sc]e(?: v| version)?(?: 1 0)?", r"cpl 1 0", r"opensource org licenses cpl1", "common"),
    ("artistic", r"(?:perl )?artistic licen[sc]e(?: \d(?: \d)?)?", r"artistic [12] 0", r"perlfoundation org artistic license", "artistic"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib", r"zlib net zlib license", "zlib"),
    ("boost", r"boost software licen[sc]e(?: v| version)?(?: 1 0)?", r"bsl 1 0", r"boost org license 1 0", "boost"),
    ("unlicense", r"the unlicense", r"unlicense", r"unlicense org", "unlicense"),
    ("wtfpl", r"do what the (?:fuck|f\w*) you want to public licen[sc]e", r"wtfpl", r"wtfpl net", "public"),
    ("openssl", r"openssl licen[sc]e", r"openssl", r"openssl org source license", "openssl"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"postgresql org about licence", "postgresql"),
    ("python", r"python software foundation licen[sc]e(?: version 2)?", r"(?:psf|python) 2 0", r"python org psf license", "python"),
    ("php", r"php licen[sc]e(?: v| version)?(?: 3 01)?", r"php 3 01", r"php net license", "php"),
    ("ruby", r"ruby(?: s)? licen[sc]e", r"ruby", r"ruby lang org \w+ license", "ruby"),
    ("ofl", r"sil open font licen[sc]e(?: v| version)?(?: 1 1)?", r"ofl 1 1", r"scripts sil org ofl", "font"),
    ("odbl", r"open database licen[sc]e", r"odbl 1 0", r"opendatacommons org licenses odbl", "database"),
    ("odc-by", r"open data commons attribution licen[sc]e", r"odc by 1 0", r"opendatacommons org licenses by", "attribution"),
    ("pddl", r"public domain dedication and licen[sc]e", r"pddl 1 0", r"opendatacommons org licenses pddl", "dedication"),
    ("ogl-uk", r"open government licen[sc]e(?: v \d| version \d)?", r"ogl uk \d 0", r"nationalarchives gov uk doc open government licence", "government"),
    ("cc0", r"cc0(?: 1 0)?|creative commons zero", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0", ""),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv\w*)(?: \d \d)?", r"cc by nc nd \d \d", r"creativecommons org licenses by nc nd", ""),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: \d \d)?", r"cc by nc sa \d \d", r"creativecommons org licenses by nc sa", ""),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: \d \d)?", r"cc by nc \d \d", r"creativecommons org licenses by nc", ""),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv\w*)(?: \d \d)?", r"cc by nd \d \d", r"creativecommons org licenses by nd", ""),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: \d \d)?", r"cc by sa \d \d", r"creativecommons org licenses by sa", ""),
    ("cc-by-plain", r"(?:cc by|creative commons attribution)(?: \d \d)?", r"cc by \d \d", r"creativecommons org licenses by \d", ""),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms pl", r"opensource org licenses ms pl", "microsoft"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms rl", r"opensource org licenses ms rl", "microsoft"),
    ("upl", r"universal permissive licen[sc]e", r"upl 1 0", r"opensource org licenses upl", "permissive"),
    ("ncsa", r"university of illinois(?: ncsa)? open source licen[sc]e", r"ncsa", r"opensource org licenses ncsa", "illinois"),
    ("sspl", r"server side public licen[sc]e", r"sspl 1 0", r"mongodb com licensing server side public license", "server"),
    ("busl", r"business source licen[sc]e(?: 1 1)?", r"busl 1 1", r"mariadb com bsl11", "business"),
]

# (form, pattern around the name, priority, confidence, further keywords)
FORMS = [
    ("spdx", r" spdx licen[sc]e identifier(?: \w+ (?:or|and))? (?:{spdx})(?= )", 0, 0.99, "spdx"),
    ("grant", r" (?:licen[sc]ed|released|distributed|published|available|provided|covered|redistributed)(?: \w+)? under (?:the )?(?:terms of )?(?:the )?(?:{name})(?= )", 1, 0.98, "under"),
    ("terms", r" (?:subject to|according to|under|see|in) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: for (?:more )?details)?(?= )", 2, 0.9, ""),
    ("link", r" (?:{url})(?= )", 2, 0.95, ""),
    ("name", r" (?:{name})(?= )", 3, 0.8, ""),
]

# Notices that name no family: label | pattern | priority | confidence | keywords, or one of a|b
NOTICES = [
    ("notice-copyright", r" copyright (?:c )?(?:by )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 4, 0.6, "copyright"),
    ("notice-copyright", r" (?:19|20)\d\d copyright(?= )", 4, 0.55, "copyright"),
    ("notice-copyright", r" © (?:c )?(?:19|20)\d\d(?= )", 4, 0.6, ""),
    ("permissive-grant", r" permission is hereby granted free of charge to any person obtaining a copy", 1, 0.97, "permission hereby"),
    ("permissive-grant", r" permission to use copy modify and or distribute this software", 1, 0.97, "permission software"),
    ("permissive-grant", r" redistribution and use in source and binary forms with or without modification", 1, 0.97, "redistribution binary"),
    ("warranty-disclaimer", r" (?:is )?provided as is without warranty of any kind", 3, 0.85, "warranty"),
    ("warranty-disclaimer", r" without warranties or conditions of any kind", 3, 0.85, "warranties"),
    ("warranty-disclaimer", r" without even the implied warranty of merchantability", 3, 0.85, "merchantability"),
    ("gpl-any", r" this program is free software you can redistribute it and or modify", 1, 0.95, "program redistribute"),
    ("public-domain", r" (?:released|placed|dedicated) (?:in|into|to) the public domain(?= )", 2, 0.9, "public domain"),
    ("public-domain", r" (?:is|are) in the public domain(?= )", 3, 0.7, "public domain"),
    ("proprietary", r" proprietary and confidential(?= )", 2, 0.85, "proprietary"),
    ("proprietary", r" (?:may not|must not|no part of this \w+ may) be (?:reproduced|copied|redistributed)(?= )", 2, 0.85, "reproduced|copied|redistributed"),
    ("proprietary", r" unauthori[sz]ed (?:copying|use|reproduction)(?: or distribution)?(?= )", 2, 0.8, ""),
    ("proprietary", r" reproduction (?:or distribution )?without (?:written )?permission(?= )", 2, 0.85, "reproduction"),
    ("terms-of-use", r" (?:by using|use of) this (?:site|website|service) (?:you agree|constitutes acceptance)(?= )", 3, 0.7, "agree|acceptance"),
    ("terms-of-use", r" terms (?:of (?:use|service)|and conditions) (?:apply|of this)(?= )", 3, 0.5, "terms"),
    ("rights-some", r" some rights reserved(?= )", 3, 0.8, "rights reserved"),
    ("rights-fr", r" tous droits réservés(?= )", 3, 0.9, "droits"),
    ("rights-de", r" alle rechte vorbehalten(?= )", 3, 0.9, "rechte"),
    ("rights-es", r" todos los derechos reservados(?= )", 3, 0.9, "derechos"),
    ("rights-it", r" tutti i diritti riservati(?= )", 3, 0.9, "diritti"),
    ("licence-text", r" terms and conditions for use reproduction and distribution(?= )", 1, 0.95, "reproduction"),
    ("licence-text", r" everyone is permitted to copy and distribute verbatim copies(?= )", 1, 0.95, "verbatim"),
    ("licence-mention", r" (?:this (?:work|file|software|document|project|code)|content) is licen[sc]ed(?= )", 4, 0.6, "is"),
    ("licence-mention", r" (?:see|read) (?:the )?(?:file )?licen[sc]e(?: file| txt| md)?(?= )", 5, 0.4, ""),
    ("licence-mention", r" licen[sc]e agreement(?= )", 5, 0.5, ""),
]

BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: A family without a word of its own is gated by either of these.
_CREATIVE = (b"cc", b"creative", b"creativecommons", b"cc0")


def _keywords(words: str) -> frozenset[bytes]:
    return frozenset(words.encode().split())


def build_rules() -> list[Rule]:
    """All rules, best priority first; ties keep the order of the tables above."""
    rules = [Rule(label, 9, 0.9, _keywords(phrase), re.compile(b" " + phrase.encode() + b"(?= )"), True) for label, phrase in BASE]
    for label, name, spdx, url, word in FAMILIES:
        for form, pattern, priority, confidence, also in FORMS:
            text = pattern.replace("{name}", name).replace("{spdx}", spdx).replace("{url}", url)
            gates = word.split("|") if word else [w.decode() for w in _CREATIVE]
            if form == "link":
                gates = [url.replace("(", " ").split()[0]]
            elif form == "spdx":
                gates = [""]  # the identifier need not spell the family's word
            rules += [Rule(label, priority, confidence, _keywords(f"{gate} {also}"), re.compile(text.encode())) for gate in gates]
    rules += [Rule(label, priority, confidence, _keywords(gate), re.compile(text.encode())) for label, text, priority, confidence, also in NOTICES for gate in also.split("|")]
    return sorted(rules, key=lambda r: r.priority)


RULES = build_rules()
#: A text without any of these words has no detection. Rules without a keyword
#: of their own need one of the licence words.
_LICENCE = frozenset(b"license licence licensed licenced licensing unauthorized unauthorised \xc2\xa9".split())
KEYWORDS = frozenset().union(*(r.needs for r in RULES if len(r.needs)), _LICENCE) - _keywords("be is this under general common")
_GATED = [(r.needs & KEYWORDS, r) for r in RULES]


@dataclass(frozen=True)
class Detection:
    label: str
    start: int  # offset in the word form
    end: int
    rule: Rule


def word_form(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


class _Cover:
    """Intervals none of which contains another, so that starts and ends both ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take an interval in, unless one that is held contains it."""
        at = bisect_right(self.starts, start)
        if at and self.ends[at - 1] >= end:
            return False
        low, high = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[low:high], self.ends[low:high] = [start], [end]
        return True


def scan(words: list[bytes]) -> tuple[bytes, list[Detection]]:
    """The joined words and the detections that stand, by start."""
    hits = KEYWORDS.intersection(words)
    if not hits:
        return b"", []
    joined = b" " + b" ".join(words) + b" "
    kept: list[Detection] = []
    cover = _Cover()
    licence = not _LICENCE.isdisjoint(hits)
    for gate, rule in _GATED:
        if not (gate <= hits if gate else licence):
            continue
        for m in rule.pattern.finditer(joined):
            if rule.base or cover.add(m.start(), m.end()):
                kept.append(Detection(rule.label, m.start(), m.end(), rule))
    return joined, sorted(kept, key=lambda d: (d.start, d.end, d.label))


def license_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(label, first word, end word, confidence) of each detection."""
    joined, found = scan(word_form(text))
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first, end = (np.searchsorted(spaces, [at(d) for d in found]).tolist() for at in (lambda d: d.start, lambda d: d.end))
    return [(d.label, a, b, d.rule.confidence) for d, a, b in zip(found, first, end)]


LICENSES = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _licenses(ids: list, texts: list) -> dict:
    out: dict[str, list] = {c.split()[0]: [] for c in LICENSES.split(", ")}
    for i, text in zip(ids, texts):
        words = word_form(text)
        joined, found = scan(words)
        base = [d for d in found if d.rule.base]
        surest: dict[str, float] = {}
        for d in found:
            surest[d.label] = max(d.rule.confidence, surest.get(d.label, 0.0))
        miss = 1.0
        for label in sorted(surest):
            miss *= 1 - surest[label]
        first = joined.count(b" ", 0, base[0].start) if base else None
        last = first + joined.count(b" ", base[0].start, base[-1].start) if base else None
        row = (i, len(words), len(base), first, last, ",".join(sorted({d.label for d in base})), ",".join(sorted({d.label for d in found})), 1 - miss)
        for values, x in zip(out.values(), row):
            values.append(x)
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, repeated rows and null ids too; only doc_id and text are read.

    Null and empty texts have no words, no labels and score 0. The score is the
    chance that some label is right, each taken at its surest detection.
    """
    return map_texts(docs, _licenses, LICENSES)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
