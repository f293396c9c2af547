"""License scan by conditional compression.

Candidate blocks are the words around cues that the longest template could reach, whatever
line breaks lie between; blocks that touch are one. Every template is aligned with the block's words; a stretch is
confirmed by the differences in wording: the words of the template that it lacks and the words
it adds, as a share of the template. Where confirmed stretches overlap, the one with the
smallest share counts, then with most words in common; ties are ranked by conditional
compression: the stretch is compressed alone and with the template as a zstandard raw
dictionary, and the share that the dictionary saves decides. A small saving drops nothing.
The rest of the block is judged again until nothing is confirmed, so a block gives all its notices.

Documents without a cue never reach Python. Candidate blocks are bounded by the templates, so
long documents cost their number of cues; a block seen before in a task is not compared again
(up to ``memo`` of them are remembered).

A year stands for any year. Cues are ``CUES`` and, for a wording that has none of them, its longest
words, so many that a variant holds one; a variant of another wording that lacks its cues is
not looked for. Licenses that no template words are not found, and of an SPDX expression
(``MIT OR ISC``) the first identifier is.

Defined results: a null or empty text has no candidates; a null or repeated id is scanned row
by row; other columns are passed through, those named like a result are replaced; without
templates nothing is found; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.rows import add_columns, find_column, free_name, quoted

# Notices by which texts name their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Further wordings; those marked with = count word for word only, as they are too short for differences.
WORDINGS = {
    "All-Rights-Reserved": ("=All rights reserved.", "=All rights are reserved."),
    "Copyright": ("=Copyright (c) 2000", "=Copyright 2000", "=Copyright (c)"),
    "MIT": (
        "=Licensed under the MIT License.",
        "=The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
    ),
    "BSD-2-Clause": ("=Licensed under the BSD 2-Clause License.", "=BSD 2-Clause License"),
    "BSD-3-Clause": ("=Licensed under the BSD 3-Clause License.", "=BSD 3-Clause License"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC0-1.0": ("=CC0 1.0 Universal",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    **{
        name: (f"GNU {kind}GENERAL PUBLIC LICENSE Version {version}, {date}",)
        + tuple(
            f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{pause} either version {version} of the License, or (at your option) any later version."
            for thing, mark, pause in (("program", ":", ","), ("library", ";", ";"))
        )
        for name, kind, version, date in (
            ("GPL-2.0", "", "2", "June 1991"),
            ("GPL-3.0", "", "3", "29 June 2007"),
            ("LGPL-2.1", "Lesser ", "2.1", "February 1999"),
            ("LGPL-3.0", "Lesser ", "3", "29 June 2007"),
            ("AGPL-3.0", "Affero ", "3", "19 November 2007"),
        )
    },
    **{
        f"CC-{short}-4.0": (
            f"=Licensed under CC {short} 4.0.",
            f"=This work is licensed under a Creative Commons {long} 4.0 International License.",
        )
        for short, long in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
# Identifiers of SPDX tags, also with -only and -or-later.
LATER = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
TAGGED = {*TEMPLATES, *WORDINGS} - {"All-Rights-Reserved", "Copyright"}
NOTICES = {
    name: (*filter(None, [TEMPLATES.get(name)]), *WORDINGS.get(name, ()))
    + tuple(f"=SPDX-License-Identifier: {name}{end}" for end in ("", "-only", "-or-later")[: 3 if name in LATER else 1] if name in TAGGED)
    for name in sorted({*TEMPLATES, *WORDINGS})
}
CUES = ("licens", "licenc", "redistribut", "copyright", "spdx")
WORD = re.compile(r"\w+", re.UNICODE)
YEAR = re.compile(r"(19|20)\d\d")
MOST_DIFFERENCES = 0.34
FIELDS = (
    "n_candidates long, "
    "licenses array<struct<license:string,status:string,start:long,end:long,saved:double,missing:array<string>,added:array<string>>>"
)


def aligned(template: list[str], words: list[str]) -> tuple[int, int, tuple[str, ...], tuple[int, ...]]:
    """(first word, one past the last, missing, places of the added) of the last best stretch that ends with ``words``."""
    fewest = [[0] * (len(words) + 1)]
    for i, wanted in enumerate(template, 1):
        above, line = fewest[-1], [i]
        for j, word in enumerate(words):
            line.append(min(above[j + 1] + 1, line[j] + 1, above[j] if word == wanted else i + j + 2))
        fewest.append(line)
    i, j = len(template), len(words)
    missing, added, hit = [], [], []
    while i:
        here = fewest[i][j]
        if j and template[i - 1] == words[j - 1] and fewest[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
            hit.append(j)
        elif fewest[i - 1][j] + 1 == here:
            i -= 1
            missing.append(template[i])
        else:
            j -= 1
            added.append(j)
    return hit[-1], hit[0] + 1, tuple(missing[::-1]), tuple(added[::-1])


def kind(word: str) -> str:
    """A word as it is compared: any year is like any other."""
    return "2000" if YEAR.fullmatch(word) else word


def wordings(templates: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    """(license, wording), in the order of the licenses."""
    return [(k, x) for k in sorted(templates) for x in ([templates[k]] if isinstance(templates[k], str) else templates[k])]


def cues_of(templates: dict[str, str | tuple[str, ...]], cues) -> tuple[str, ...]:
    """``cues``, and of each wording without any its longest words: one more than it may lack."""
    out = list(cues)
    for _, wording in wordings(templates):
        found = WORD.findall(wording.lower())
        if found and not any(c.lower() in w for c in cues for w in found):
            lacking = 0 if wording.startswith("=") else int(MOST_DIFFERENCES * len(found))
            out += [w for w in sorted(set(found), key=lambda w: (-len(w), w))[: lacking + 1] if w not in out]
    return tuple(out)


class Scanner:
    """Compares candidate blocks with templates: license -> notice, or several wordings of it."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]], cues=CUES, most_differences: float = MOST_DIFFERENCES, memo: int = 50_000):
        worded = [(k, [kind(w) for w in WORD.findall(x.lower())], x.startswith("=")) for k, x in wordings(templates)]
        worded = [x for x in worded if x[1]]
        self.rows = [(k, words) for k, words, _ in worded]
        cues = cues_of(templates, cues)
        self.reach = 2 * max((len(w) for _, w in self.rows), default=0) + 2
        self.cue = re.compile("|".join(map(re.escape, cues)), re.IGNORECASE)
        # The template's words, spaced as those of a block, so that wording alone counts.
        self.packers = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, w in self.rows
        ]
        self.plain = zstandard.ZstdCompressor(level=3)
        # Templates side by side: a row each, a column for each number of words.
        self.length = np.array([len(w) for _, w in self.rows], np.int32)
        self.allowed = np.where([x for *_, x in worded], 0, most_differences * self.length) if worded else self.length
        self.width = int(self.length.max(initial=0))
        self.every = np.arange(len(self.rows))
        self.start = np.tile(np.arange(self.width + 1, dtype=np.int32), (len(self.rows), 1))
        self.never = np.int32(2 * self.width + 2)
        self.same: dict[str, np.ndarray] = {}
        for row, (_, template) in enumerate(self.rows):
            for i, word in enumerate(template):
                self.same.setdefault(word, np.zeros((len(self.rows), self.width), bool))[row, i] = True
        self.memo, self.limit = {}, memo

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Character spans of candidate blocks, in order and apart; line breaks do not bound them."""
        out: list[tuple[int, int]] = []
        at = 0
        while match := self.cue.search(text, at):
            # The next cue is looked for behind the word that holds this one.
            word = WORD.match(text, match.end() - 1)
            at = word.end() if word else match.end()
            start = self._back(text, out[-1][1] if out else 0, match.start())
            end = self._ahead(text, at)
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out

    def _back(self, text: str, floor: int, cue: int) -> int:
        # Words are looked for in a growing stretch before the cue, never in the whole text.
        width = 16 * self.reach
        while True:
            low = max(floor, cue - width)
            found = [m.start() for m in WORD.finditer(text, low, cue)] if low < cue else []
            if len(found) > self.reach:
                return found[-self.reach]
            if low == floor:
                return floor
            width *= 4

    def _ahead(self, text: str, word: int) -> int:
        n = 0
        for match in WORD.finditer(text, word):
            n += 1
            if n == self.reach:
                return match.end()
        return len(text)

    def judge(self, block: str) -> list[tuple]:
        """(license, status, first character, one past the last, saved, missing, added) of the notices in a block, in order."""
        key = blake2b(block.encode(errors="surrogatepass"), digest_size=16).digest()
        if key not in self.memo:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[key] = self._judge(block)
        return self.memo[key]

    def _judge(self, block: str) -> list[tuple]:
        spans = list(WORD.finditer(block))
        words = [m[0].lower() for m in spans]
        out = []
        rest = [(0, len(words))]
        while rest:
            low, high = rest.pop()
            taken = bytearray(high - low)
            chosen = []
            for _, _, saved, name, first, last, missing, added in sorted(self._confirmed(words[low:high])):
                if any(taken[first:last]):
                    continue
                taken[first:last] = b"\1" * (last - first)
                chosen.append((first, last))
                status = "variant" if missing or added else "exact"
                out.append((name, status, spans[low + first].start(), spans[low + last - 1].end(), -saved, list(missing), list(added)))
            # What lies between is judged again, until nothing more is confirmed.
            edges = sorted(chosen)
            if edges:
                rest += [(low + x, low + y) for x, y in zip([0, *(e[1] for e in edges)], [*(e[0] for e in edges), high - low]) if x < y]
        return sorted(out, key=lambda x: x[2])

    def _confirmed(self, words: list[str]) -> list[tuple]:
        """(differences, -words in common, -saved, license, first word, one past the last, missing, added), best first if sorted."""
        out = []
        kinds = [kind(w) for w in words]
        for row, stop in self._ends(kinds):
            template, allowed = self.rows[row][1], self.allowed[row]
            low = max(stop - len(template) - int(allowed), 0)
            first, last, missing, added = aligned(template, kinds[low:stop])
            first, last, added = low + first, low + last, tuple(words[low + i] for i in added)
            data = " ".join(kinds[first:last]).encode(errors="surrogatepass")
            alone = len(self.plain.compress(data))
            saved = (alone - len(self.packers[row].compress(data))) / alone
            differences = (len(missing) + len(added)) / len(template)
            out.append((differences, len(missing) - len(template), -saved, self.rows[row][0], first, last, missing, added))
        return out

    def _ends(self, words: list[str]) -> list[tuple[int, int]]:
        """(template, end of a stretch) wherever a stretch that differs little enough ends.

        One column of an alignment per word, for all templates at once: the fewest differences
        between the first i words of a template and any stretch ending here.
        """
        if not self.rows:
            return []
        hits: list[tuple[int, int]] = []
        fewest = self.start.copy()
        before = fewest[self.every, self.length]
        unknown = self.width
        for at, word in enumerate(words):
            same = self.same.get(word)
            if same is None:
                # An added word for all; after a template's length of them nothing is left to go on from.
                if unknown < self.width:
                    fewest = np.minimum(fewest + 1, self.start)
                    before = fewest[self.every, self.length]
                unknown += 1
                continue
            unknown = 0
            step = fewest + 1
            step[:, 0] = 0
            np.minimum(step[:, 1:], np.where(same, fewest[:, :-1], self.never), out=step[:, 1:])
            fewest = np.minimum.accumulate(step - self.start, axis=1) + self.start
            now = fewest[self.every, self.length]
            # Ends before which there were more differences; a stretch ends with a word of its template.
            hits += [(int(row), at + 1) for row in np.flatnonzero((now <= self.allowed) & (now < before))]
            before = now
        return hits

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """(number of candidate blocks, licenses found in them)."""
        blocks = self.blocks(text)
        out = []
        for start, end in blocks:
            for name, status, a, b, saved, missing, added in self.judge(text[start:end]):
                out.append({"license": name, "status": status, "start": start + a, "end": start + b, "saved": saved, "missing": missing, "added": added})
        return len(blocks), out


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] = NOTICES, cues=CUES, text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with ``n_candidates`` and the ``licenses`` found (character spans, wording differences)."""
    struct = pa.list_(pa.struct([
        ("license", pa.string()), ("status", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()),
        ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())),
    ]))

    def make():
        scanner = Scanner(templates, cues, **settings)

        def run(batch: pa.RecordBatch) -> list:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(0)]
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], struct)]

        return run

    text = quoted(find_column(docs, text_col)).cast("string")
    cues = cues_of(templates, cues)
    # Only texts with a cue are sent on; the others reach Python as null.
    cue = F.lower(text).rlike("|".join(re.escape(c) for c in cues)) if cues else F.lit(False)
    cued = free_name(docs, "cued")
    return add_columns(docs.withColumn(cued, F.when(cue, text)), {cued: "string"}, FIELDS, make).drop(cued)
