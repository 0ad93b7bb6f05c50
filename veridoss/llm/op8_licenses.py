"""License scans: a trained paragraph classifier, confirmed by template comparison.

Training (driver, seconds): a multinomial logistic regression over one- and two-word n-grams with
an L1 penalty, so that few n-grams keep a weight. Its licensed rows are the notices below (published
texts, and the usual names of each family set in the usual phrases) with noisy copies; the rows of
the class "unknown" are GENERAL and at most 2 * NEGATIVES whole lines of the corpus of at most
LINE characters (the documented bound of the sample), half of them lines that talk of licences
without matching a notice. N-grams found in more than COMMON of the other half, or made of such words and numbers alone, are no features. A
fifth of the notices, each with all its copies, and of the negatives is held out; it fixes the softmax
temperature and the probability from which a family is named (the least that keeps the unknown
class's error at or below UNKNOWN_ERROR).

Scanning uses DataFrame functions alone, is narrow and reads whole texts. A paragraph ends at a blank
line; it is judged as a whole with wrapped lines joined, and each of its lines and sentences is judged as
well, as notices often stand among other text. Units without any of the words that the model's own weights need to lift a family above the
unknown class are "unknown" whatever else they hold, so they are left out before n-grams are made: an exact
shortcut. A prediction stands
only if a template of the predicted family shares enough of its n-grams with the unit: CONFIRM of
them, all of them for a template of fewer than SHORT; otherwise the unit is "unknown".

Defined results. Null or empty text: no paragraph. Ties in probability go to the first family in
order. Repeated rows each get their result. Very long texts, paragraphs and lines are judged whole.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATIVES = 1_000
LINE = 2_000
COMMON = 0.002
UNKNOWN_ERROR = 0.005
CONFIRM = 0.6
SHORT = 8
SEED = 11
UNKNOWN = "unknown"
TALK = "(?i)licen[cs]|copyright|warrant|permission|redistribut|public domain|rights reserved"
BLANK = r"\n[ \t\r]*\n\s*"
SENTENCE = r"\n|(?<=[.;!?])\s+"

# Usual names of licences by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-or-later"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "New BSD License", "Simplified BSD License"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GNU GPL v2", "GNU GPL v3", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0-only", "GPL version 2 or later"],
    "isc": ["ISC License", "ISC license terms"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3", "LGPL 3.0", "LGPL-2.1-or-later"],
    "mit": ["MIT License", "MIT license terms", "MIT / X11 license", "MIT / X11", "Expat License"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "proprietary": ["proprietary license, all rights reserved", "proprietary licence of the owner"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "public domain dedication CC0", "The Unlicense"],
}
# Phrases in which such names stand.
PHRASES = ["{}.", "License: {}", "Code: {}", "Licensed under the {}.", "Released under the {}.", "Available under {}.", "This work is licensed under the {}.", "This file is under the {}.", "Distributed under the terms of the {}.", "This software is published under the {}; see the file LICENSE for details.", "SPDX-License-Identifier: {}"]
# Passages of licences as published.
PASSAGES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
}
# Paragraphs that mention licences without granting one.
GENERAL = ["The driver's license was renewed at the county office last week.", "A fishing license costs twenty dollars at the counter.", "The restaurant lost its liquor license after the inspection.", "The warranty covers parts and labour for two years.", "She asked for permission to leave the room early.", "Copyright law protects authors for a limited time.", "Publishers license photographs from agencies.", "The permission slip must be signed by a parent.", "Redistribution of income is debated in parliament.", "The software vendor changed its licensing terms.", "He holds a license to practise medicine.", "The licence plate was hidden under snow.", "No warranty was given with the used car.", "The court ruled on a copyright dispute between two studios.", "The apache helicopters were released under escort.", "All rights and duties were reserved for the members of the club.", "MIT researchers published a study of general public health.", "The eclipse was visible to the public in version after version of the legend."]


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def ngrams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))


def notices() -> list[tuple[str, str]]:
    """(family, text) of every passage and of every name in every phrase."""
    out = [(f, t) for f, texts in PASSAGES.items() for t in texts]
    return out + [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]


def templates() -> list[dict]:
    """Families, n-grams and how many of them a unit must hold: of passages and of names alone."""
    out = []
    for f, t in [(f, t) for src in (PASSAGES, NAMES) for f, texts in src.items() for t in texts]:
        g = ngrams(t)
        out.append({"f": f, "g": g, "need": len(g) if len(g) < SHORT else int(np.ceil(CONFIRM * len(g)))})
    return out


@dataclass(frozen=True)
class LicenseModel:
    """families (the last one is UNKNOWN), bias, n-gram weights, temperature, least probability."""

    families: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    triggers: list[str]
    temperature: float
    least: float

    def probabilities(self, text: str) -> dict[str, float]:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in ngrams(text) if g in self.weights), np.zeros(len(self.bias)))
        z = np.exp((z - z.max()) / self.temperature)
        return dict(zip(self.families, z / z.sum(), strict=True))


def _noisy(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    w = words(text)
    keep = [x for x in w if rng.random() > 0.08] or w
    extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 10))]
    at = int(rng.integers(0, len(extra) + 1))
    return " ".join([*extra[:at], *keep, *extra[at:]])


def _matrix(grams: list[list[str]], place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(grams), len(place)), np.float32)
    for i, known in enumerate(grams):
        x[i, [place[g] for g in known if g in place]] = 1
    return x


def train(negatives: tuple[list[str], list[str]], copies: int = 2, rounds: int = 200, penalty: float = 1e-4) -> LicenseModel:
    """Fit on the notices, GENERAL and the negatives given: lines of any kind and lines of licence talk.

    Temperature and threshold come from a fit without a fifth of the notices, held out with all their copies.
    """
    rng = np.random.default_rng(SEED)
    plain, talk = negatives
    filler = [w for t in plain[:500] for w in words(t)] or ["the", "of", "and"]
    families = [*NAMES, UNKNOWN]
    rows: list[tuple[str, str, bool]] = []  # family, text, held out
    for f, t in notices():
        held = rng.random() < 0.2
        rows += [(f, t, held)] + [(f, _noisy(t, rng, filler), held) for _ in range(copies)]
    for t in GENERAL:
        held = rng.random() < 0.2
        rows += [(UNKNOWN, t, held)] + [(UNKNOWN, _noisy(t, rng, filler), held) for _ in range(copies)]
    rows += [(UNKNOWN, t, rng.random() < 0.2) for t in [*plain, *talk]]
    df: dict[str, int] = {}
    for t in plain:
        for g in ngrams(t):
            df[g] = df.get(g, 0) + 1
    often = {g for g, n in df.items() if n > max(2, COMMON * len(plain))}
    plainly = {g for t in [*GENERAL, *(t for _, t in notices())] for g in ngrams(t)}
    telling = lambda g: g not in often and any(not w.isdigit() and w not in often for w in g.split(" "))
    held = np.array([h for _, _, h in rows])
    y = np.array([families.index(f) for f, _, _ in rows])
    grams = [ngrams(t) for _, t, _ in rows]

    def fit(chosen: np.ndarray) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """(place of each n-gram, weights, bias) from some of the rows."""
        seen: dict[str, int] = {}
        for i in np.flatnonzero(chosen):
            for g in plainly.intersection(grams[i]):
                seen[g] = seen.get(g, 0) + 1
        place = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n > 2 and telling(g)))}
        xt, yt = _matrix([g for g, c in zip(grams, chosen, strict=True) if c], place), np.eye(len(families), dtype=np.float32)[y[chosen]]
        w, b = np.zeros((len(place), len(families)), np.float32), np.zeros(len(families), np.float32)
        v, bv, k, step = w, b, 1.0, 4.0
        for _ in range(rounds):  # accelerated proximal gradient
            z = xt @ v + bv
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - yt) / len(xt)
            w2 = v - step * (xt.T @ g)
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
            b2 = bv - step * g.sum(0)
            b2[-1] = max(b2[-1], b2[:-1].max())  # nothing speaks for a family where no n-gram does
            k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
            v, bv = w2 + (k - 1) / k2 * (w2 - w), b2 + (k - 1) / k2 * (b2 - b)
            w, b, k = w2, b2, k2
        return place, w, b

    # a fit without the held-out rows calibrates; then all notices are learned, as a passage left out is taken for one like it
    place, w, b = fit(~held)
    z = _matrix([g for g, h in zip(grams, held, strict=True) if h], place) @ w + b
    yh = y[held]

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(soft(t)[np.arange(len(yh)), yh] + 1e-12).mean())
    p = soft(temperature)
    none = yh == len(families) - 1
    wrong = np.sort(p[none, :-1].max(1))[::-1] if none.any() else np.zeros(0)
    allowed = int(UNKNOWN_ERROR * none.sum())
    least = min(0.95, max(0.5, float(wrong[allowed]) if len(wrong) > allowed else 0.5))
    place, w, b = fit(~held | (y < len(families) - 1))
    weights = {g: [round(float(q), 4) for q in w[i]] for g, i in place.items() if np.abs(w[i]).max() > 1e-3}
    bias = [round(float(q), 4) for q in b]
    return LicenseModel(families, bias, weights, _triggers(bias, weights, df), temperature, least)


def _triggers(bias: list[float], weights: dict[str, list[float]], often: dict[str, int]) -> list[str]:
    """Words without any of which no family can win.

    Each n-gram is watched through the rarer of its words. The words met most in the corpus need no watch as long
    as all their n-grams together cannot lift any family above the unknown class's bias.
    """
    gain: dict[str, np.ndarray] = {}
    for g, q in weights.items():
        word = min((x for x in g.split(" ") if not x.isdigit()), key=lambda x: (often.get(x, 0), -len(x), x))
        gain[word] = gain.get(word, 0) + np.maximum(np.array(q[:-1]) - q[-1], 0)
    left, out = bias[-1] - np.array(bias[:-1]) - 1e-6, []
    for word in sorted(gain, key=lambda x: (-often.get(x, 0), gain[x].max(), x)):
        if (gain[word] <= left).all():
            left = left - gain[word]
        elif gain[word].max() > 0:
            out.append(word)
    return sorted(out)


def negative_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = NEGATIVES) -> tuple[list[str], list[str]]:
    """At most ``most`` lines of any kind and as many that talk of licences without matching half a
    notice, both first in the order of a seeded hash over all lines of at most LINE characters.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "p")).where((F.length("p") > 0) & (F.length("p") <= LINE))
    lines = lines.select("p", F.xxhash64(F.lit(SEED), "id", "at", "p").alias("h"), F.col("p").rlike(TALK).alias("talk"))
    every, talks = (int(x) for x in lines.agg(F.count("*"), F.count_if("talk")).first())

    def first(df: DataFrame, n: int) -> list[str]:
        """Only about four times as many lines as are taken leave the tasks, whatever their number."""
        return [r.p for r in df.where(F.pmod("h", F.lit(max(1, n // (4 * most)))) == 0).orderBy("h", "p").limit(most).select("p").collect()]

    shapes = [set(t["g"]) for t in templates()]
    notice = lambda g: any(2 * len(t & g) >= len(t) for t in shapes)
    plain, talk = first(lines, every), first(lines.where("talk"), talks)
    return [t for t in plain if not notice(set(ngrams(t)))], [t for t in dict.fromkeys(talk) if not notice(set(ngrams(t)))]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _grams(w: Column) -> Column:
    pairs = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, F.slice(pairs, 1, F.size(w) - 1)).otherwise(F.array().cast("array<string>"))))


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the units to which the classifier gives a family, with probability and verdict; no shuffle."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    known = F.from_json(F.lit(json.dumps(sorted(model.weights))), "array<string>")
    triggers = F.from_json(F.lit(json.dumps(model.triggers)), "array<string>")
    shapes = F.from_json(F.lit(json.dumps(templates())), "array<struct<f:string,g:array<string>,need:int>>")
    names = F.array(*[F.lit(f) for f in model.families])

    bias = F.array(*[F.lit(float(b)) for b in model.bias])

    def judge(p: Column) -> Column:
        """Every family's sum in one fold: an n-gram is looked up once, whatever the number of families."""
        z = F.aggregate(p["k"], bias, lambda a, g: F.zip_with(a, F.element_at(weights, g), lambda x, w: x + w))
        return F.struct(p["g"].alias("g"), z.alias("z"), p["at"].alias("at"))

    def soften(p: Column) -> Column:
        e = F.transform(p["z"], lambda z: F.exp((z - F.array_max(p["z"])) / model.temperature))
        best = F.array_position(p["z"], F.array_max(p["z"])).cast("int")
        return F.struct(p["g"].alias("g"), p["at"].alias("at"), F.element_at(names, best).alias("family"), (1 / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)).alias("probability"))

    def confirm(p: Column) -> Column:
        mine = F.filter(shapes, lambda t: t["f"] == p["family"])
        like = F.coalesce(F.array_max(F.transform(mine, lambda t: F.size(F.array_intersect(t["g"], p["g"])) / F.size(t["g"]))), F.lit(0.0))
        enough = F.exists(mine, lambda t: F.size(F.array_intersect(t["g"], p["g"])) >= t["need"])
        sure = (p["probability"] >= model.least) & enough
        return F.struct(p["at"].alias("at"), F.when(sure, p["family"]).otherwise(UNKNOWN).alias("family"), p["family"].alias("predicted"), F.round(p["probability"], 6).alias("probability"), F.round(like, 6).alias("template_match"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    unit = lambda t, at: F.struct(t.alias("t"), at.alias("at"))

    def units(block: Column, i: Column) -> Column:
        """The block, its lines and its sentences, under the block's number, a sign for the kind, and their own number."""
        head = i.cast("string")
        cut = lambda pattern, sign: F.transform(F.split(block, pattern), lambda t, j: unit(t, F.concat(head, F.lit(sign), j.cast("string"))))
        lines, sentences = cut("\n", "."), cut(SENTENCE, "/")
        none = F.array().cast("array<struct<t:string,at:string>>")
        return F.concat(F.array(unit(block, head)), F.when(F.size(lines) > 1, lines).otherwise(none), F.when(F.size(sentences) > F.size(lines), sentences).otherwise(none))

    empty = F.array().cast("array<struct<t:string,at:string>>")
    df = docs.select(F.col(id_col), text.alias("t")).withColumn("some", F.arrays_overlap(F.split(F.lower("t"), "[^a-z0-9]+"), triggers))
    df = df.select(id_col, F.when(F.col("some"), F.flatten(F.transform(F.split("t", BLANK), units))).otherwise(empty).alias("p"))
    df = df.withColumn("p", F.transform("p", lambda p: F.struct(_words(p["t"]).alias("w"), p["at"].alias("at"))))
    df = df.withColumn("p", F.filter("p", lambda p: F.arrays_overlap(p["w"], triggers)))
    df = df.withColumn("p", F.transform("p", lambda p: F.struct(_grams(p["w"]).alias("g"), p["at"].alias("at"))))
    df = df.withColumn("p", F.transform("p", lambda p: F.struct(p["g"].alias("g"), F.array_intersect(p["g"], known).alias("k"), p["at"].alias("at"))))
    df = df.withColumn("p", F.transform("p", judge)).withColumn("p", F.transform("p", soften))
    df = df.withColumn("p", F.filter("p", lambda p: p["family"] != UNKNOWN))
    return df.select(id_col, F.transform("p", confirm).alias("paragraphs"))


def license_report(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts, the families found and the units behind them.

    n_candidates counts units to which the classifier gives a family; n_licenses paragraphs and
    families that stand after confirmation. paragraphs lists unit:family, where a unit is a paragraph's
    number, with .line or /sentence for a part of it.
    """
    found = scan(docs, model, id_col, text_col)
    confirmed = F.filter("paragraphs", lambda p: p["family"] != UNKNOWN)
    where = lambda p: F.concat_ws(":", F.regexp_extract(p["at"], "^[0-9]+", 0), p["family"])
    return found.select(
        F.col(id_col),
        F.size("paragraphs").cast("long").alias("n_candidates"),
        F.size(F.array_distinct(F.transform(confirmed, where))).cast("long").alias("n_licenses"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(confirmed, lambda p: p["family"])))).alias("families"),
        F.array_max(F.transform(confirmed, lambda p: p["probability"])).alias("probability"),
        F.concat_ws(",", F.transform("paragraphs", lambda p: F.concat_ws(":", p["at"], p["family"]))).alias("paragraphs"),
    )
