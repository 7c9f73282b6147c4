"""Licence scans: a trained paragraph classifier, all of whose main path are SQL expressions on one row.

Units are lines, and paragraphs: lines joined up to a blank one, so that notices wrapped over lines are whole. Units of more than WINDOW words
are looked at in windows that overlap by half. A paragraph's window counts only if it spans lines and finds a family that no line of its own
states; its line is that of its first marker. Units that hold a marker word
(licence, copyright, the licences' own names) become sparse binary features: word n-grams of 1 to 3 words, hashed into BUCKETS cells.
Softmax regression gives each family, and the class ``unknown``, a probability; a temperature and a threshold are calibrated on
held-out examples, the threshold so that PRECISION of the confirmed predictions are right. Then the family's templates confirm the prediction: the unit must hold one of the family's names as it stands, or at least
CONFIRM of the word pairs and triples of one of its longer notices; what is not confirmed counts as unknown. Units without a marker have no licence.

The model is trained on synthetic examples (EXAMPLES of each family, a fixed number): names in sentence frames, and notices whole, cut and with words
lost, among made-up words; unknown ones name other licences or use the same words otherwise. They go through the same expressions as texts, once in a
session. A null text is empty and holds no licence. Every row is treated alone, so repeated rows give equal results; an empty table gives an
empty one; extra columns are left aside.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, WINDOW, CONFIRM, EXAMPLES, PRECISION = 1 << 13, 60, 0.6, 200, 0.995
UNKNOWN = "unknown"
#: Words of which a unit must hold one. Fixed values.
MARKERS = ("license", "licensed", "licence", "licenced", "licenses", "copyright", "warranty", "redistribution", "redistribute", "permission", "spdx-license-identifier", "gpl", "gplv2", "gplv3", "lgpl", "agpl", "mpl", "cc", "cc0", "apache", "creative", "mozilla", "bsd", "unlicense", "unencumbered", "isc", "mit")
#: Short forms in which licences are stated, by family. Fixed values.
TEMPLATES = {
    "MIT": ("released under the mit license", "licensed under the mit license", "spdx-license-identifier mit", "this project is distributed under the terms of the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("licensed under the apache license version 2.0", "spdx-license-identifier apache-2.0", "released under the apache 2.0 license", "you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    "GPL-3.0": ("this work is licensed under the gnu general public license version 3", "released under the gpl version 3", "spdx-license-identifier gpl-3.0", "licensed under gplv3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    "GPL-2.0": ("this work is licensed under the gnu general public license version 2", "released under the gpl version 2", "spdx-license-identifier gpl-2.0", "licensed under gplv2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    "LGPL": ("licensed under the gnu lesser general public license", "released under the lgpl", "spdx-license-identifier lgpl-2.1", "spdx-license-identifier lgpl-3.0"),
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3", "released under the agpl", "spdx-license-identifier agpl-3.0"),
    "BSD": ("licensed under the bsd license", "released under the 3-clause bsd license", "released under the 2-clause bsd license", "spdx-license-identifier bsd-3-clause", "spdx-license-identifier bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0"),
    "CC-BY-SA-4.0": ("licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier cc-by-sa-4.0"),
    "CC-BY-NC-4.0": ("licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier cc-by-nc-4.0"),
    "CC0-1.0": ("dedicated to the public domain under cc0 1.0", "spdx-license-identifier cc0-1.0", "released under the cc0 license"),
    "ISC": ("released under the isc license", "spdx-license-identifier isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("this is free and unencumbered software released into the public domain", "spdx-license-identifier unlicense"),
}
#: Names of the families, as words stand in a text. Fixed values.
NAMES = {
    "MIT": ("mit", "mit x11", "mit expat"),
    "Apache-2.0": ("apache 2.0", "apache-2.0", "apache v2", "apache license 2.0", "apache license version 2.0", "apache software license 2.0", "apache version 2.0"),
    "GPL-3.0": ("gpl v3", "gplv3", "gpl-3.0", "gpl 3.0", "gpl 3", "gpl version 3", "gnu gpl v3", "gnu gplv3", "gpl-3.0-only", "gpl-3.0-or-later", "gnu general public license v3", "gnu general public license version 3", "gnu general public license v3.0"),
    "GPL-2.0": ("gpl v2", "gplv2", "gpl-2.0", "gpl 2.0", "gpl 2", "gpl version 2", "gnu gpl v2", "gnu gplv2", "gpl-2.0-only", "gpl-2.0-or-later", "gnu general public license v2", "gnu general public license version 2", "gnu general public license v2.0"),
    "LGPL": ("lgpl", "gnu lgpl", "lgpl v3", "lgplv3", "lgpl-3.0", "lgpl v2.1", "lgplv2.1", "lgpl-2.1", "gnu lesser general public license"),
    "AGPL-3.0": ("agpl", "gnu agpl", "agpl v3", "agplv3", "agpl-3.0", "gnu affero general public license"),
    "BSD": ("bsd", "bsd 3-clause", "bsd 2-clause", "3-clause bsd", "2-clause bsd", "new bsd", "simplified bsd", "modified bsd", "bsd-3-clause", "bsd-2-clause"),
    "MPL-2.0": ("mpl 2.0", "mpl-2.0", "mplv2", "mozilla public license", "mozilla public license 2.0", "mozilla public license version 2.0"),
    "CC-BY-4.0": ("cc by 4.0", "cc-by-4.0", "cc-by 4.0", "creative commons attribution 4.0", "creative commons by 4.0"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc-by-sa-4.0", "cc-by-sa 4.0", "creative commons attribution-sharealike 4.0", "creative commons by-sa 4.0"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc-by-nc-4.0", "cc-by-nc 4.0", "creative commons attribution-noncommercial 4.0", "creative commons by-nc 4.0"),
    "CC0-1.0": ("cc0", "cc0 1.0", "cc0-1.0", "creative commons zero"),
    "ISC": ("isc",),
    "Unlicense": ("unlicense", "the unlicense"),
}
#: Names of licences of no family here. Fixed values.
FOREIGN = ("acme", "proprietary", "commercial", "epl", "epl-2.0", "eclipse public", "artistic", "zlib", "python", "oracle", "sspl", "elastic", "boost", "wtfpl", "gfdl", "ruby", "open", "free", "closed", "shareware", "academic", "trial", "enterprise", "custom")
#: Sentences that state a licence; @ is its name. Fixed values.
FRAMES = ("this project is licensed under the @ license", "this software is released under the @ license", "the code is available under @", "licensed under the terms of the @ license", "license @", "licence @", "@ license", "@ licence", "the library is @ licensed", "published under the @ license see license for details", "covered by the @ licence", "you can use it under the @ license", "subject to the @ license", "the files are under @", "its license is @", "spdx-license-identifier @", "dual licensed @", "all examples are licensed @", "made available under the @ license")
#: Words that a notice must hold to be a family's, where another family's is the same but for them. Fixed values.
TELLING = {"GPL-3.0": "version 3", "GPL-2.0": "version 2"}
#: Places of a name that is none but a licence's. Fixed values.
BARE = ("@", "it is @", "code @", "@ applies here", "the parts are @ and others not", "we use @ for all of it", "rights @")
#: Standard notices of the families, longer than a line. Fixed values.
NOTICES = {
    "MIT": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    "Apache-2.0": ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    "GPL-3.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GPL-2.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "LGPL": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    "AGPL-3.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",),
    "BSD": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    "MPL-2.0": ("if a copy of the mpl was not distributed with this file you can obtain one at",),
    "ISC": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "Unlicense": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",),
}
#: Uses of marker words that state no licence. Fixed values.
OTHER = ("she lost her driver license near the station", "the licence fee rose again this year", "he asked for permission to leave the room", "the warranty of the machine ends in june", "fahrt mit dem zug nach berlin", "copyright law is taught here", "an apache helicopter landed", "creative people like cc and bcc lines", "mit der zeit wird es besser", "a fishing license costs ten dollars", "we may redistribute the seats", "the license plate was blue", "the driver showed the license", "no license is needed here", "the license expired in may", "a license fee of 3.0 percent", "version 3 of the report", "version 2 of the plan", "either version 2 or version 3", "public license office", "general public opening hours", "the general public may enter", "the mit students spoke", "bsd is a short word", "the gpl was discussed in court", "isc meets on friday", "the permission was granted free of charge", "he published the notice", "the above notice is old", "warranty without limits", "permission is needed for trips", "under the terms of the treaty", "released under the old name", "version 2.0 of the game", "read the license before you sign", "licensed taxi drivers only", "mozilla firefox opened the page")
FAMILIES = (UNKNOWN, *TEMPLATES)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(line: Column) -> Column:
    """Lower-cased words of letters, digits, dots and hyphens, without dots or hyphens at their ends."""
    raw = F.split(F.lower(line), r"[^\p{L}\p{N}.+-]+", -1)
    return F.filter(F.transform(raw, lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", "")), lambda w: w != "")


def _marks() -> Column:
    """Words of which a unit must hold one: markers, and names of one word."""
    alone = {e for f in NAMES for e in evidence(f) if " " not in e}
    return F.split(F.lit(",".join(sorted({*MARKERS, *alone}))), ",")


def grams(tokens: Column, sizes: tuple[int, ...]) -> Column:
    n = F.size(tokens)
    parts = []
    for k in sizes:
        parts.append(F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), _joined(tokens, k))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def _joined(tokens: Column, k: int):
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " ")


def cells(tokens: Column) -> Column:
    return F.array_distinct(F.transform(grams(tokens, (1, 2, 3)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def units(text: Column) -> Column:
    """array<struct<line, tokens>> of the lines, or their windows, that hold a marker."""

    def of_line(line: Column, number: Column) -> Column:
        def cut(tokens: Column) -> Column:
            half = WINDOW // 2
            many = F.ceil(F.greatest(F.size(tokens) - WINDOW, F.lit(0)) / half).cast("int")
            return F.transform(F.sequence(F.lit(0), many), lambda k: F.struct(number.alias("line"), F.slice(tokens, k * half + 1, F.lit(WINDOW)).alias("tokens")))

        none = F.array().cast("array<struct<line:int,tokens:array<string>>>")
        return F.when(F.rlike(line, F.lit(MAY)), F.filter(let(words(line), cut), lambda u: F.arrays_overlap(u["tokens"], _marks()))).otherwise(none)

    return F.flatten(F.transform(F.split(text, "\n", -1), of_line))


def paragraphs(text: Column) -> Column:
    """The text cut at the ends of lines that a blank line follows: array_join by line ends gives the text again."""
    return F.split(text, r"\n(?=[^\S\n]*(?:\n|$))", -1)


def evidence(family: str) -> list[str]:
    """What names a family beyond doubt once the model says so: its names as they stand, with the word licence where they are common words, as word runs of up to three."""
    out = set()
    for name in NAMES[family]:
        w = name.split()
        if name in ("mit", "bsd", "isc", "mit x11", "mit expat", "new bsd", "simplified bsd", "modified bsd"):
            forms = [f"{name} {x}" for x in ("license", "licence", "licensed", "licenced", "licenses")] + [f"{x} {name}" for x in ("license", "licence", "licensed", "spdx-license-identifier")] + [f"under {name}", f"the {name} terms"]
        else:
            forms = [name]
        for f in forms:
            t = f.split()
            if len(t) <= 3:
                out.add(" ".join(t))
    return sorted(out)


def compound(family: str) -> list[tuple[str, str]]:
    """Names of more than three words: the first and the last three of them, both of which must be there."""
    return sorted({(" ".join(t[:3]), " ".join(t[-3:])) for t in map(str.split, NAMES[family]) if len(t) > 3})


def wrapped(parts: Column) -> Column:
    """array<struct<part, line, first, last, tokens>> of the windows of paragraphs that span lines and hold a marker and a word pair of a
    notice or the beginning of a name, without which none can be confirmed; lines count from the paragraph's first."""
    marks = _marks()
    pairs = F.split(F.lit(",".join(sorted({g for f in TEMPLATES for t in _notices(f) for g in _shingles(t) if g.count(" ") == 1} | {" ".join(e.split()[:2]) for f in TEMPLATES for e in (*evidence(f), *(a for a, _ in compound(f)))}))), ",")

    def of_part(part: Column, number: Column) -> Column:
        def cut(tokens: Column) -> Column:
            half = WINDOW // 2
            many = F.ceil(F.greatest(F.size(tokens) - WINDOW, F.lit(0)) / half).cast("int")

            def window(k: Column) -> Column:
                def shaped(t: Column) -> Column:
                    marked = F.filter(t, lambda x: F.array_contains(marks, x["w"]))
                    return F.struct(number.alias("part"), F.get(marked, F.lit(0))["i"].alias("line"), F.get(t, F.lit(0))["i"].alias("first"), F.get(t, F.size(t) - 1)["i"].alias("last"), F.transform(t, lambda x: x["w"]).alias("tokens"))

                return let(F.slice(tokens, k * half + 1, F.lit(WINDOW)), shaped)

            spans = F.transform(F.sequence(F.lit(0), many), window)
            return F.filter(spans, lambda u: u["line"].isNotNull() & (u["first"] < u["last"]) & F.arrays_overlap(grams(u["tokens"], (1, 2)), pairs))

        lines = F.split(part, "\n", -1)
        tokens = F.flatten(F.transform(lines, lambda x, i: F.transform(words(x), lambda w: F.struct(w.alias("w"), i.alias("i")))))
        none = F.array().cast("array<struct<part:int,line:int,first:int,last:int,tokens:array<string>>>")
        return F.when(F.rlike(part, F.lit(MAY)) & F.rlike(part, F.lit(r"\S[^\n]*\n\s*\S")), let(tokens, cut)).otherwise(none)

    return F.flatten(F.transform(parts, of_part))


MAY = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(MARKERS) + r")(?![\p{L}\p{N}])"


def fixed(values, kind: str) -> Column:
    """Many constants as one literal, which the optimizer folds."""
    return F.split(F.lit(",".join(f"{float(v):g}" for v in values)), ",").cast(f"array<{kind}>")


# ---- training


def _soup(rng: random.Random, n: int) -> str:
    parts = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve tion ing ent la que au ei ch sch ung".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def examples(seed: int = 31) -> list[tuple[str, int]]:
    """(line, number of its family); unknown is 0."""
    rng = random.Random(seed)
    out = []
    for number, family in enumerate(FAMILIES):
        for i in range(EXAMPLES if number else EXAMPLES * 6):
            if number and i % 2:
                name = rng.choice(NAMES[family])
                bare = name in evidence(family) and rng.random() < 0.5  # says it without a sentence
                text = rng.choice(BARE if bare else FRAMES).replace("@", name)
            elif number:
                told = _notices(family)
                text = told[i // 2 % len(told)]
                if len(text.split()) > 12:  # notices are cut by windows, and vary
                    w = [x for x in text.split() if rng.random() < 0.97]
                    text = " ".join(w[: rng.choice((len(w), len(w), 2 * len(w) // 3))])
            elif i % 4 == 0:
                text = rng.choice(FRAMES).replace("@", rng.choice((rng.choice(FOREIGN), _soup(rng, 1))))
            elif i % 4 == 1:  # a statement with its telling words gone
                text = " ".join([w for w in "this work is released licensed under the terms of the public license version".split() if rng.random() < 0.6] + ["license"])
            elif i % 4 == 2:
                text = rng.choice(OTHER)
            else:
                text = f"{_soup(rng, 3)} {rng.choice([m for m in MARKERS if not any(m in evidence(f) for f in NAMES)])} {_soup(rng, 3)}"
            text = rng.choice((text, text.capitalize(), text.upper(), text.title()))
            before, after = rng.choice((0, 0, 4, 14)), rng.choice((0, 0, 4, 14))
            out.append((f"{_soup(rng, before)} {text}{rng.choice(('.', '', ',', ' -'))} {_soup(rng, after)}".strip(), number))
    return out


def fit(features: list[list[int]], y: np.ndarray, classes: int, rounds: int = 200, decay: float = 1e-5, pace: float = 20.0) -> np.ndarray:
    """Softmax regression by gradient steps with momentum, over sparse binary rows, classes weighted alike; the last row holds the biases.
    Cells of fewer than 3 examples get no weight."""
    used = np.flatnonzero(np.bincount(np.concatenate([np.asarray(f, int) for f in features]), minlength=BUCKETS) >= 3)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    x = np.zeros((len(features), len(used) + 1), np.float32)
    for i, f in enumerate(features):
        at = place[np.asarray(f, int)]
        x[i, at[at >= 0]] = 1 / max(1, len(f)) ** 0.5
    x[:, -1] = 1
    share = (1 / np.bincount(y, minlength=classes).clip(1))[y][:, None] / classes
    w, v = np.zeros((x.shape[1], classes), np.float32), np.zeros((x.shape[1], classes), np.float32)
    goal = np.eye(classes)[y]
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ ((p / p.sum(1, keepdims=True) - goal) * share).astype(np.float32) + decay * w
        v = 0.9 * v - pace * g
        w = w + v
    out = np.zeros((BUCKETS + 1, classes))
    out[used], out[-1] = w[:-1], w[-1]
    return out.round(4)


def logits(w: np.ndarray, features: list[list[int]]) -> np.ndarray:
    return np.array([w[np.asarray(f, int)].sum(0) / max(1, len(f)) ** 0.5 + w[-1] for f in features])


def _likeness(tokens: list[str], family: str) -> float:
    """What scan() compares with the templates, for calibration."""
    have = {" ".join(tokens[i : i + k]) for k in (1, 2, 3) for i in range(len(tokens) - k + 1)}
    if have & set(evidence(family)) or any(have >= set(c) for c in compound(family)):
        return 1.0
    return (TELLING.get(family, tokens[0]) in have) * max(len(have & set(_shingles(t))) / len(_shingles(t)) for t in _notices(family))


_trained: dict[str, tuple[np.ndarray, float, float]] = {}


def model(spark: SparkSession) -> tuple[np.ndarray, float, float]:
    """Weights, temperature and threshold."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        labelled = examples()
        df = spark.range(1).select(F.posexplode(F.split(F.lit("\x1e".join(t for t, _ in labelled)), "\x1e")).alias("i", "text"))
        rows = df.select("i", F.explode(units(F.col("text"))).alias("u")).select("i", "u.tokens", cells(F.col("u.tokens")).alias("f")).orderBy("i").collect()
        y = np.array([labelled[r.i][1] for r in rows])
        x = [list(r.f) for r in rows]
        train = [i for i, r in enumerate(rows) if r.i % 7 > 1]  # 7 parts no number of templates evenly
        held = [i for i, r in enumerate(rows) if r.i % 7 <= 1]
        w = fit([x[i] for i in train], y[train], len(FAMILIES))
        z, goal = logits(w, [x[i] for i in held]), y[held]

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(-(s[np.arange(len(goal)), goal] - np.log(np.exp(s).sum(1))).mean())

        heat = min((0.25 * 1.1**k for k in range(40)), key=loss)
        s = np.exp(z / heat - (z / heat).max(1, keepdims=True))
        p = s / s.sum(1, keepdims=True)
        best, sure = p.argmax(1), p.max(1)
        told = np.array([b > 0 and _likeness(rows[i].tokens, FAMILIES[b]) >= CONFIRM for i, b in zip(held, best)])
        cuts = np.unique(sure[told])
        good = [float(c) for c in cuts if c >= 0.5 and (best == goal)[told & (sure >= c)].mean() >= PRECISION]
        _trained[key] = w, float(heat), min(good, default=1.0)
    return _trained[key]


# ---- scan


def _notices(family: str) -> tuple[str, ...]:
    return TEMPLATES[family] + NOTICES.get(family, ())


def _shingles(template: str) -> list[str]:
    t = template.split()
    return sorted({" ".join(t[i : i + k]) for k in (2, 3) for i in range(len(t) - k + 1)})


def scan(docs: DataFrame, trained=None) -> DataFrame:
    """doc_id and found: array<struct<line, family, probability, likeness>> of all units with a marker; family is ``unknown`` where the
    model is not sure, or the templates do not confirm it."""
    w, heat, limit = trained or model(docs.sparkSession)
    weights = F.array(*(fixed(w[:BUCKETS, k], "double") for k in range(len(FAMILIES))))
    bias = [float(b) for b in w[BUCKETS]]

    def scored(u: Column) -> Column:
        def with_cells(c: Column) -> Column:
            norm = F.sqrt(F.greatest(F.size(c), F.lit(1)).cast("double"))
            z = [(F.aggregate(c, F.lit(0.0), _adding(F.get(weights, F.lit(k)))) / norm + F.lit(b)) / F.lit(heat) for k, b in enumerate(bias)]

            def with_logits(zs: Column) -> Column:
                top = F.array_max(zs)
                total = F.aggregate(zs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
                return F.struct((F.array_position(zs, top) - 1).cast("int").alias("best"), (1 / total).alias("probability"))

            return let(F.array(*z), with_logits)

        def confirmed(s: Column) -> Column:
            def like(g: Column) -> Column:
                shares = []
                for family in FAMILIES[1:]:
                    named = reduce(lambda c, ab: c | (F.array_contains(g, ab[0]) & F.array_contains(g, ab[1])), compound(family), F.arrays_overlap(g, F.split(F.lit(",".join(evidence(family))), ",")))
                    each = [F.size(F.array_intersect(g, F.split(F.lit(",".join(_shingles(t))), ","))) / F.lit(float(len(_shingles(t)))) for t in _notices(family)]
                    share = reduce(F.greatest, each) if len(each) > 1 else each[0]
                    shares.append(F.when(named, 1.0).otherwise(F.when(F.array_contains(g, TELLING[family]), share).otherwise(0.0) if family in TELLING else share))
                return reduce(lambda c, kv: F.when(s["best"] == kv[0], kv[1]).otherwise(c), enumerate(shares, 1), F.lit(0.0))

            sure = (s["best"] > 0) & (s["probability"] >= limit)
            likeness = F.when(sure, let(grams(u["tokens"], (1, 2, 3)), like)).otherwise(F.lit(0.0))
            name = F.element_at(F.array(*map(F.lit, FAMILIES)), s["best"] + 1)
            return let(likeness, lambda v: F.struct(u["part"].alias("part"), u["line"].alias("line"), u["first"].alias("first"), u["last"].alias("last"), F.when(v >= CONFIRM, name).otherwise(UNKNOWN).alias("family"), s["probability"].alias("probability"), v.alias("likeness")))

        return let(let(cells(u["tokens"]), with_cells), confirmed)

    def whole(text: Column, parts: Column) -> Column:
        of_lines = F.transform(units(text), lambda u: F.struct(F.lit(-1).alias("part"), u["line"].alias("line"), u["line"].alias("first"), u["line"].alias("last"), u["tokens"].alias("tokens")))

        def placed(u: Column) -> Column:
            """A found window's lines count from the text's first."""
            before = F.when(u["part"] > 0, F.size(F.split(F.array_join(F.slice(parts, F.lit(1), u["part"]), "\n"), "\n", -1))).otherwise(0)
            return F.struct((u["line"] + before).alias("line"), u["family"].alias("family"), u["probability"].alias("probability"), u["likeness"].alias("likeness"), (u["first"] + before).alias("first"), (u["last"] + before).alias("last"))

        def merged(every: Column) -> Column:
            stated = F.transform(F.filter(every, lambda u: u["part"] < 0), lambda u: F.struct(u["line"].alias("line"), u["family"].alias("family"), u["probability"].alias("probability"), u["likeness"].alias("likeness")))
            joined = F.transform(F.filter(every, lambda u: (u["part"] >= 0) & (u["family"] != UNKNOWN)), placed)

            def more(known: Column) -> Column:
                fresh = F.filter(joined, lambda u: ~F.exists(known, lambda x: (x["family"] == u["family"]) & x["line"].between(u["first"], u["last"])))
                return F.concat(known, F.transform(fresh, lambda u: F.struct(u["line"].alias("line"), u["family"].alias("family"), u["probability"].alias("probability"), u["likeness"].alias("likeness"))))

            return let(stated, more)

        return let(F.transform(F.concat(of_lines, wrapped(parts)), scored), merged)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<line:int,family:string,probability:double,likeness:double>>")
    found = F.when(F.rlike("text", F.lit(MAY)), let(paragraphs(F.col("text")), lambda parts: whole(F.col("text"), parts))).otherwise(none)
    return docs.select("doc_id", text.alias("text")).select("doc_id", found.alias("found"))


def _adding(row: Column):
    return lambda a, i: a + F.get(row, i)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, licenses (distinct families, sorted, comma-joined), n_found and n_unknown units, lines of the found ones."""
    once = scanned.withColumn("found", F.explode(F.array("found")))
    sure = F.filter("found", lambda u: u["family"] != UNKNOWN)
    names = F.array_sort(F.array_distinct(F.transform(sure, lambda u: u["family"])))
    lines = F.array_sort(F.array_distinct(F.transform(sure, lambda u: u["line"])))
    return once.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size(sure).cast("long").alias("n_found"), (F.size("found") - F.size(sure)).cast("long").alias("n_unknown"), F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("lines"))
