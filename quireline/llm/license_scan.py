"""License scans: a trained paragraph classifier, with a calibrated unknown class, confirmed by comparison with templates.

Features are the distinct word n-grams (1 to 3) of a paragraph, kept by hash. A multinomial logistic regression over the families and
``unknown`` is fitted on the driver, on variants of the notices below (words dropped, cut at the ends, put beside other words), on notices of
licences outside the families and on paragraphs that only sound like notices; that is the bounded set of labelled rows, ``VARIANTS`` times
the notices. A third of the variants is held out: a temperature is fitted on it so that probabilities are calibrated, and the least
probability of a family is set so that at most one in a hundred of its unknown paragraphs passes. A prediction counts if enough of the
sentence's word pairs are in notices of that family, or enough of one notice's word pairs are in the sentence, and a pair among them that
no other family's notices nor those of other licences have.

The scan itself is one projection of DataFrame functions, row by row, without a shuffle: weights and notices are constants in it. Paragraphs
are judged sentence by sentence: the sentences of each line, and those that go over line ends up to a blank line, as notices are often
wrapped, if the words on both sides of some line end are a pair of a notice: else no notice goes over one. Sentences with less than half of their word pairs in notices, and without a pair that tells a family, are passed over: comparison
could not confirm them. Cue words only decide which lines without a confirmed sentence are listed as ``unknown``. Whole texts are scanned.

Null and empty texts have no paragraphs and no families. Rows are judged one by one, so repeats and empty tables need nothing. Kept columns may
have any names (see ``columns``).
"""

from __future__ import annotations

import json
import random
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import Kept, named

UNKNOWN = "unknown"
#: Characters that the tests' texts keep to (no limit of the scan); hash buckets; variants of each notice.
LONG, BUCKETS, VARIANTS = 400, 1 << 14, 24
#: Share of a sentence's word pairs that must be in the family's notices, or of a notice's word pairs that must be in the sentence.
LEAST_CONTAINED = 0.5
#: Ends of sentences; none after a colon, which would cut identifiers off. In a paragraph, line ends are white space.
SENTENCE_END, WRAPPED_END = r"(?<=[.!?;])[ \t\r\f\x0b]+", r"(?<=[.!?;])[ \t\r\f\x0b\n]+"
BLANK_LINE = r"\n[ \t\r\f\x0b]*\n\s*"
#: The last word of a line (1) and the first of the next with words (2).
OVER = r"\b([a-z0-9]++)[^a-z0-9\n]*+\n[^a-z0-9]*+(?=([a-z0-9]++))"
#: The first word after line ends, wherever ``OVER`` finds one and in some more places; it passes over whole lines at once.
NEXT = r"\n[^a-z0-9]*+([a-z0-9]++)"
CUE = r"(?i)licen[cs]|copyright|\(c\)|spdx|warrant|permi(ssion|tted)|redistribut|public domain|creative commons|\bcc[ -](by|0)|all rights reserved|unlicense"

NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is available under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "This code is distributed under the terms of the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the terms of the GNU General Public License version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under GPLv3.",
        "Released under GPLv3.",
        "Released under the GPLv3 or later.",
        "Distributed under the terms of the GPLv2.",
        "This program is licensed under the GPL version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is licensed under LGPLv3.",
        "Released under the LGPLv3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Distributed under the terms of the AGPLv3 license.",
        "Released under the AGPLv3.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License 3.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain. SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "Copyright (c) 2021 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is prohibited. All rights reserved.",
    ],
}

OTHERS = [
    "He lost his driving licence after the accident in March.",
    "The city council granted a license to sell alcohol at the stadium.",
    "A fishing license costs twenty dollars and is valid for one year.",
    "You need permission from your teacher to leave the room.",
    "The washing machine comes with a two year warranty.",
    "Copyright law has changed a great deal over the last century.",
    "The court issued a search warrant for the house.",
    "Poetic license lets writers bend the rules of grammar.",
    "The film was licensed to a broadcaster in Germany.",
    "Smoking is not permitted in this building.",
    "The proposal would redistribute income from the rich to the poor.",
    "The software company reported record sales this quarter.",
    "The Apache helicopter landed near the village.",
    "She studied physics at MIT before moving to the west coast.",
    "He walked across the MIT bridge to the campus.",
    "The MIT press release came out on Monday.",
    "The general public was invited to the opening of the museum.",
    "The licensing agreement between the two clubs expired last year.",
    "Users report that the new version is free of errors and works well.",
    "He asked for her permission and she gave it without a word.",
    "The warranty does not cover damage caused by water.",
    "Your license plate must be visible at all times.",
    "La licencia de conducir se renueva cada diez anos.",
    "Il faut une licence pour ouvrir un restaurant dans cette ville.",
    "Die Lizenz zum Fischen kostet zwanzig Euro im Jahr.",
    "The creative commons room is on the second floor of the library.",
]

#: Notices of licences that are no family here: unknown, too.
OUTSIDERS = [
    "Eclipse Public License - v 2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the EUPL, version 1.2.",
    "Licensed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "Released under the ISC License.",
    "SPDX-License-Identifier: ISC",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
    "Distributed under the zlib license.",
    "SPDX-License-Identifier: Zlib",
    "This software is provided as is, without any express or implied warranty.",
    "Artistic License 2.0",
    "This library is free software; you may redistribute it under the same terms as Perl itself.",
    "Licensed under the Microsoft Public License.",
    "The contents of this file are subject to the Common Development and Distribution License.",
    "SPDX-License-Identifier: CDDL-1.0",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: OFL-1.1",
    "Do What The Fuck You Want To Public License",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Python Software Foundation License.",
    "SPDX-License-Identifier: PostgreSQL",
    "Licensed under the Business Source License 1.1.",
    "This data is made available under the Open Database License.",
    "Licensed under the Server Side Public License, version 1.",
]


def words(text: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def grams(own: list[str], n: int) -> list[str]:
    return [" ".join(own[i : i + n]) for i in range(len(own) - n + 1)]


def hashes(own: list[str]) -> list[int]:
    """Distinct hashes of the n-grams of 1 to 3 words."""
    return sorted({zlib.crc32(g.encode()) for n in (1, 2, 3) for g in grams(own, n)})


def pieces(texts: list[str]) -> list[str]:
    """The texts, and their sentences of three words or more, as sentences are what is judged."""
    return [*dict.fromkeys([*texts, *(s for t in texts for s in re.split(SENTENCE_END, t) if len(words(s)) > 2)])]


class Model:
    """Fitted weights; ``families`` ends with the unknown class."""

    def __init__(self, seed: int = 17):
        rng = random.Random(seed)
        self.families = [*sorted(NOTICES), UNKNOWN]
        train, held = [], []
        filler = [w for t in OTHERS for w in words(t)]
        for family, texts in [*sorted(NOTICES.items()), (UNKNOWN, OTHERS + OUTSIDERS)]:
            for text in pieces(texts):
                for n in range(VARIANTS):
                    own = words(text)
                    if n:
                        own = [w for w in own if rng.random() > 0.08] or own
                        own = [*rng.choices(filler, k=rng.choice([0, 0, 1, 3])), *own, *rng.choices(filler, k=rng.choice([0, 0, 1, 3]))]
                    (held if n % 3 == 2 else train).append((self.families.index(family), hashes(own)))
        for _ in range(VARIANTS * 20):
            own = rng.choices(filler, k=rng.randrange(3, 30))
            (held if rng.random() < 1 / 3 else train).append((len(NOTICES), hashes(own)))
        count: dict[int, int] = {}
        for _, own in train:
            for h in own:
                count[h] = count.get(h, 0) + 1
        self.prints = [0] * BUCKETS
        for h, c in sorted(count.items(), key=lambda x: (x[1], x[0])):
            if c > 2:  # the commonest of a bucket stays
                self.prints[h % BUCKETS] = h
        self._fit(train)
        self._calibrate(held)
        both = lambda t: {zlib.crc32(g.encode()) for g in grams(words(t), 2)}
        self.notices = [[sorted(both(t)) for t in pieces(NOTICES[f])] for f in self.families[:-1]]
        #: Pairs that are in the notices of one family only.
        self.telling = [sorted(set().union(*map(both, NOTICES[f])) - set().union(*(both(t) for g in NOTICES if g != f for t in NOTICES[g]), *map(both, OTHERS + OUTSIDERS))) for f in self.families[:-1]]
        self.telling_pairs = [g for g in sorted({g for t in sum(NOTICES.values(), []) for g in grams(words(t), 2)}) if any(zlib.crc32(g.encode()) in t for t in self.telling)]
        self.all_pairs = sorted({g for f in NOTICES for t in NOTICES[f] for g in grams(words(t), 2)})
        self.pairs = [sorted(set().union(*map(both, NOTICES[f]))) for f in self.families[:-1]]

    def _matrix(self, rows: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        used = [i for i, h in enumerate(self.prints) if h]
        place = {self.prints[i]: n for n, i in enumerate(used)}
        x = np.zeros((len(rows), len(used) + 1), np.float32)
        x[:, -1] = 1
        for i, (_, own) in enumerate(rows):
            x[i, [place[h] for h in own if h in place]] = 1
        return x, np.array([f for f, _ in rows])

    def _fit(self, rows: list[tuple[int, list[int]]], steps: int = 150, rate: float = 2.0, decay: float = 2e-4) -> None:
        x, y = self._matrix(rows)
        target = np.eye(len(self.families), dtype=np.float32)[y]
        w = np.zeros((x.shape[1], len(self.families)), np.float32)
        speed = np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed - rate * 0.1 * (x.T @ (p - target) / len(x) + decay * w)
            w += speed
        # hundredths, so that the constants in a plan are short
        whole = np.rint(w * 100).astype(int)
        self.bias = whole[-1].tolist()
        self.weights = np.zeros((BUCKETS, len(self.families)), int)
        self.weights[[i for i, h in enumerate(self.prints) if h]] = whole[:-1]

    def logits(self, own: list[int]) -> np.ndarray:
        known = [h % BUCKETS for h in own if self.prints[h % BUCKETS] == h]
        return np.array(self.bias) + self.weights[known].sum(0)

    def _calibrate(self, rows: list[tuple[int, list[int]]]) -> None:
        z, y = np.stack([self.logits(own) for _, own in rows]) / 100, np.array([f for f, _ in rows])

        def probabilities(t):
            p = np.exp(z / t - (z / t).max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)

        self.temperature = min((float(-np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean()), t) for t in np.arange(0.2, 3.01, 0.05).round(2).tolist())[1]
        wrong = np.delete(probabilities(self.temperature)[y == len(NOTICES)], len(NOTICES), 1).max(1)
        self.least = round(max(0.5, float(np.quantile(wrong, 0.99))), 4)

    def judge(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, its probability, contained) of the surest sentence, confirmed ones first; the projection in plain Python."""
        judged = [self._judge(s) for s in re.split(SENTENCE_END, paragraph) if s.strip(" ")]
        found = [j for j in judged if j[3] != UNKNOWN]
        probability, contained, _, family = max(found or judged)
        return family, probability, contained

    def families_in(self, text: str) -> set[str]:
        """The families of a text: the scan in plain Python."""
        over = [s for s in wrapped(text) if {f"{a} {b}" for a, b in re.findall(OVER, s.lower())} & set(self.all_pairs)]
        own = [s for line in re.split("\n+", text) for s in re.split(SENTENCE_END, line)] + over
        return {self._judge(s)[3] for s in own if s.strip(" ")} - {UNKNOWN}

    def _judge(self, sentence: str) -> tuple[float, float, str, str]:
        own = words(sentence)
        z = self.logits(hashes(own)) / 100 / self.temperature
        p = np.exp(z - z[:-1].max())
        p /= p.sum()
        best = int(p[:-1].argmax())
        pairs = {zlib.crc32(g.encode()) for g in grams(own, 2)}
        share = len(pairs & set(self.pairs[best])) / len(pairs) if pairs else 0.0
        if pairs & set(self.telling[best]):
            share = max(share, *(len(pairs & set(n)) / len(n) for n in self.notices[best]))
        found = p[best] >= self.least and share >= LEAST_CONTAINED
        return float(p[best]), share, sentence, self.families[best] if found else UNKNOWN


def wrapped(text: str) -> list[str]:
    """Sentences that go over line ends."""
    return [s for p in re.split(BLANK_LINE, text) for s in re.split(WRAPPED_END, p) if "\n" in s.strip("\n")]


@cache
def fitted() -> Model:
    return Model()


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n+", -1), lambda p: F.trim(p) != "")


def sentences(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, SENTENCE_END, -1), lambda s: F.trim(s) != "")


def _wrapped(text: Column) -> Column:
    whole = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), BLANK_LINE, -1), lambda p: F.split(p, WRAPPED_END, -1)))
    return F.filter(whole, lambda s: F.trim(F.lit("\n"), s).contains("\n"))


def _grams(own: Column, n: int) -> Column:
    starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - (n - 1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.crc32(F.array_join(F.slice(own, i, F.lit(n)), " ").cast("binary")))


def _pairs(sentence: Column) -> Column:
    """The word pairs of a sentence, as text."""
    own = F.filter(F.split(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.flatten(F.transform(F.array(own), lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))))


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: Model | None = None) -> DataFrame:
    """The columns ``keep``, ``n_paragraphs``, and ``hits``: an array of (paragraph, family, probability, contained, others). A line with a cue word
    has one hit: the surest of its sentences that probability and comparison both confirm, else one of family ``unknown``. ``others`` are the
    surest sentences for further families in that line. Lines without a cue word are judged alike, and listed if a sentence is confirmed, as
    are sentences over line ends, for families that no line has."""
    held = model or fitted()
    n = len(held.families)
    prints, weights, bias = _constant(held.prints, "array<bigint>"), _constant(held.weights.ravel().tolist(), "array<int>"), _constant(held.bias, "array<int>")
    names, pairs = _constant(held.families, "array<string>"), _constant(held.pairs, "array<array<bigint>>")
    notices, telling = _constant(held.notices, "array<array<array<bigint>>>"), _constant(held.telling, "array<array<bigint>>")

    def step(record: Column, **new: Column) -> Column:
        """``record`` with more fields; as a one-element array, so that each field is worked out once."""
        return F.transform(record, lambda r: F.struct(r["p"].alias("p"), *(f(r).alias(k) for k, f in new.items())))

    def judged(own: Column) -> Column:
        """(probability, contained, paragraph, family) of each sentence."""
        one = F.transform(own, lambda p: F.struct(p.alias("p"), F.filter(F.split(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " "), " "), lambda w: w != "").alias("words")))
        two = step(one, hashes=lambda r: F.array_distinct(F.concat(*(_grams(r["words"], k) for k in (1, 2, 3)))), pairs=lambda r: F.array_distinct(_grams(r["words"], 2)))
        known = lambda r: F.filter(r["hashes"], lambda h: F.element_at(prints, (h % BUCKETS + 1).cast("int")) == h)
        logits = lambda r: F.aggregate(known(r), bias, lambda acc, h: F.zip_with(acc, F.slice(weights, (h % BUCKETS * n + 1).cast("int"), F.lit(n)), lambda a, b: a + b))
        three = step(two, logits=logits, pairs=lambda r: r["pairs"])
        top = lambda r: F.array_max(F.slice(r["logits"], 1, n - 1))
        scale = 100 * held.temperature
        total = lambda r: F.aggregate(r["logits"], F.lit(0.0), lambda acc, z: acc + F.exp((z - top(r)) / scale))
        four = step(three, best=lambda r: F.array_position(r["logits"], top(r)).cast("int"), probability=lambda r: 1 / total(r), pairs=lambda r: r["pairs"])
        share = lambda a, b, of: F.size(F.array_intersect(a, b)) / F.size(of)
        notice = lambda r: F.when(F.arrays_overlap(r["pairs"], F.element_at(telling, r["best"])), F.array_max(F.transform(F.element_at(notices, r["best"]), lambda m: share(r["pairs"], m, m))))
        most = lambda r: F.greatest(share(r["pairs"], F.element_at(pairs, r["best"]), r["pairs"]), notice(r))
        contained = lambda r: F.when(F.size(r["pairs"]) > 0, most(r)).otherwise(0.0)
        five = step(four, family=lambda r: F.element_at(names, r["best"]), probability=lambda r: r["probability"], contained=contained)
        sure = lambda r: (r["probability"] >= held.least) & (r["contained"] >= LEAST_CONTAINED)
        return F.transform(five, lambda r: F.struct(r["probability"].alias("probability"), r["contained"].alias("contained"), r["p"].alias("paragraph"), F.when(sure(r), r["family"]).otherwise(UNKNOWN).alias("family")))

    # containment needs half of the sentence's pairs in notices, or a pair that tells a family: this passes all that could be confirmed
    # (tests against a list are one look-up a pair, where functions of two arrays go through all pairs of the notices for each sentence)
    fits = lambda w, k: F.exists(k, lambda p: p.isin(held.telling_pairs)) | (F.size(F.array_distinct(k)) >= LEAST_CONTAINED * F.size(F.array_distinct(w)))
    in_notices = lambda s: F.transform(F.array(_pairs(s)), lambda w: F.struct(w.alias("w"), F.filter(w, lambda p: p.isin(held.all_pairs)).alias("k")))
    near = lambda s: F.exists(in_notices(s), lambda r: (F.size(r["k"]) > 0) & fits(r["w"], r["k"]))
    own = F.transform(paragraphs(named(text)), lambda p: F.struct(p.alias("p"), p.rlike(CUE).alias("cued"), F.lit(False).alias("over")))
    chosen = F.transform(own, lambda r: F.struct(r["p"].alias("p"), r["cued"].alias("cued"), F.when(r["cued"], sentences(r["p"])).otherwise(F.filter(sentences(r["p"]), near)).alias("own"), r["over"].alias("over")))
    ends = lambda s, k: F.regexp_extract_all(F.lower(s), F.lit(OVER), F.lit(k))
    seconds = sorted({p.split(" ")[1] for p in held.all_pairs})
    may_cross = lambda s: F.exists(F.regexp_extract_all(F.lower(s), F.lit(NEXT), F.lit(1)), lambda w: w.isin(seconds))
    crossing = lambda s: may_cross(s) & F.exists(F.zip_with(ends(s, 1), ends(s, 2), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isin(held.all_pairs))
    over = F.transform(F.filter(F.filter(_wrapped(named(text)), crossing), near), lambda s: F.struct(s.alias("p"), F.lit(False).alias("cued"), F.array(s).alias("own"), F.lit(True).alias("over")))
    some = F.filter(F.concat(chosen, over), lambda r: F.size(r["own"]) > 0)
    lines = step(some, judged=lambda r: judged(r["own"]), cued=lambda r: r["cued"], over=lambda r: r["over"])
    split = step(lines, cued=lambda r: r["cued"], over=lambda r: r["over"], judged=lambda r: r["judged"], found=lambda r: F.filter(r["judged"], lambda j: j["family"] != UNKNOWN))
    surest = lambda r: F.array_max(F.when(F.size(r["found"]) > 0, r["found"]).otherwise(r["judged"]))
    listed = F.filter(split, lambda r: r["cued"] | (F.size(r["found"]) > 0))
    first = step(listed, found=lambda r: r["found"], first=surest, over=lambda r: r["over"])
    shown = lambda j: [j[k].alias(k) for k in ("paragraph", "family", "probability", "contained")]
    further = lambda r: F.filter(F.array_distinct(F.transform(r["found"], lambda j: j["family"])), lambda f: f != r["first"]["family"])
    others = lambda r: F.transform(F.transform(further(r), lambda f: F.array_max(F.filter(r["found"], lambda j: j["family"] == f))), lambda j: F.struct(*shown(j)))
    hits = F.transform(first, lambda r: F.struct(*shown(r["first"]), others(r).alias("others"), r["over"].alias("over")))
    kept = Kept(keep, ("n_paragraphs", "hits"))
    # a sentence over line ends is listed for a family that no line has
    scanned = docs.select(*kept.held(), F.size(paragraphs(named(text))).cast("long").alias("n_paragraphs"), hits.alias("hits"))
    of_lines = F.flatten(F.transform(F.filter("hits", lambda h: ~h["over"]), lambda h: F.concat(F.array(h["family"]), F.transform(h["others"], lambda o: o["family"]))))
    once = F.filter("hits", lambda h: ~h["over"] | ~F.array_contains(of_lines, h["family"]))
    listed_hits = F.transform(F.when(F.exists("hits", lambda h: h["over"]), once).otherwise(F.col("hits")), lambda h: F.struct(*shown(h), h["others"].alias("others")))
    return scanned.select(*kept.back(), "n_paragraphs", listed_hits.alias("hits"))


def report(scanned: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: n_paragraphs, n_cued, n_licensed (paragraphs with a family), families (sorted, comma-joined; empty: none), probability of the surest hit."""
    kept = Kept(keep, ("n_paragraphs", "n_cued", "n_licensed", "families", "probability"))
    sure = F.filter("hits", lambda h: h["family"] != UNKNOWN)
    return scanned.select(*kept.held(), "n_paragraphs", F.size("hits").cast("long").alias("n_cued"), sure.alias("sure")).select(
        *kept.back(),
        "n_paragraphs",
        "n_cued",
        F.size("sure").cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("sure", lambda h: F.concat(F.array(h["family"]), F.transform(h["others"], lambda o: o["family"])))))), ",").alias("families"),
        F.round(F.array_max(F.transform("sure", lambda h: h["probability"])), 6).alias("probability"),
    )
