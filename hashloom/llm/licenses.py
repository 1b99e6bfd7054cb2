"""License scans by a trained paragraph classifier, in DataFrame and SQL functions alone.

Lines that follow each other make a paragraph, comment marks at their starts are cut off, and blank lines end it, so wrapped notices and
headers of source files are whole. A paragraph is read in windows of WINDOW words that overlap by half. A multinomial logistic regression
on sparse word 1- and 2-grams gives each window's probability of every licence family and of the class `unknown`, calibrated by temperature;
a family with SHARE of it counts if `unknown` has less than UNSURE and one of the family's templates is contained in the window (0.8 of its
2-grams), so two licences of one notice are both found. The model is trained in the driver on generated notices; it runs as SQL array functions row by row,
so no text moves between tasks and nothing is hot.

Only windows with an anchor word are scored: whatever holds 0.8 of a template's 2-grams holds one (a test proves it for every template).

Odd input: a null text is an empty one (no paragraphs, no licences); paragraphs are numbered from 0 and count as whole texts however long;
repeated rows and null doc_ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import id_and_text

#: Sentences and phrases of the licences' own texts, of the notices they ask for and of usual references, lower case, in the
#: words that the tokenizer leaves. None is longer than half a window.
TEMPLATES = {
    "Apache-2.0": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "apache license version 2.0", "apache software license 2.0", "apache 2.0 license", "licensed under apache 2.0", "apache license v2.0", "mit or apache 2.0", "apache 2.0 or mit", "spdx license identifier apache 2.0",
    ),
    "MIT": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the mit license", "under mit license", "mit licensed", "mit license", "mit or apache 2.0", "apache 2.0 or mit", "spdx license identifier mit",
    ),
    "GPL-2.0": (
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "under the terms of the gnu general public license version 2 as published by the free software foundation",
        "gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gplv2 license", "under the gplv2", "spdx license identifier gpl 2.0",
    ),
    "GPL-3.0": (
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "under the terms of the gnu general public license version 3 as published by the free software foundation",
        "gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gplv3 license", "under the gplv3", "spdx license identifier gpl 3.0",
    ),
    "LGPL": (
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license as published by the free software foundation either version 3 of the license",
        "gnu lesser general public license as published by the free software foundation either version 2.1 of the license",
        "gnu lesser general public license", "gnu library general public license", "spdx license identifier lgpl 2.1", "spdx license identifier lgpl 3.0",
    ),
    "AGPL-3.0": (
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license as published by the free software foundation either version 3 of the license",
        "gnu affero general public license", "spdx license identifier agpl 3.0",
    ),
    "BSD": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "governed by a bsd style license", "bsd license", "bsd 3 clause license", "bsd 2 clause license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause",
    ),
    "MPL-2.0": (
        "this source code form is subject to the terms of the mozilla public license",
        "mozilla public license version 2.0", "mozilla public license v 2.0", "spdx license identifier mpl 2.0",
    ),
    "ISC": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "the isc license", "isc license", "spdx license identifier isc",
    ),
    "EPL-2.0": (
        "the accompanying materials are made available under the terms of the eclipse public license",
        "eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v 2.0", "spdx license identifier epl 2.0",
    ),
    "CC-BY": ("licensed under cc by 4.0", "creative commons attribution 4.0 international license", "creative commons attribution 4.0", "creative commons attribution license", "license cc by 4.0"),
    "CC-BY-SA": ("licensed under cc by sa", "creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike", "creative commons attribution share alike license", "license cc by sa"),
    "CC-BY-NC": ("licensed under cc by nc", "creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial", "creative commons attribution non commercial license", "license cc by nc"),
    "CC0": ("has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1.0", "creative commons zero license", "cc0 1.0 universal public domain dedication", "license cc0 1.0"),
    "Unlicense": (
        "this is free and unencumbered software released into the public domain",
        "the unlicense", "spdx license identifier unlicense",
    ),
}
UNKNOWN = "unknown"
#: Beginnings of words of which a window must hold one to be scored.
ANCHORS = "licen|unlicen|permission|permitted|redistribut|commons|gnu|gpl|apache|mozilla|eclipse|bsd|cc0|copyright|software|conditions|unencumbered|hereby|applicable|waived|dedication"
CONTAINED, SHARE, UNSURE, ROUNDS, DECAY = 0.8, 0.15, 0.5, 400, 2e-4
#: Words of a window, and by how many the next one starts later.
WINDOW, STEP = 48, 24
#: What comment styles put at the start of a line, and what ends a paragraph.
MARKS = r"^[ \t]*(?:/{2,}|/\*+|\*+/?|#+|;+|--+|%+|!+|<!--|\"{3}|'{3}|rem\b|dnl\b)?[ \t]*"
BLANK = r"\n[ \t\r]*\n\s*"
_CLASSES = (*TEMPLATES, UNKNOWN)
_SPLIT = "[^a-z0-9.]+"


def words(text: str) -> list[str]:
    """The tokenizer, as the SQL has it: lower case, runs of letters, digits and points, points at the ends cut off."""
    return [w for w in (x.strip(".") for x in re.split(_SPLIT, text.lower())) if w]


def grams(w: list[str]) -> list[str]:
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]))


#: Training phrases around templates, of denials, and of talk about licences that names no family.
BEFORE = ("licensed under", "licensed under the", "this work is licensed under the", "this work is licensed under", "released under the", "released under", "distributed under the terms of the", "this file is subject to the", "copyright 2019 the authors", "see license", "under the terms of", "")
AFTER = ("", "", "see the license file for details", "all rights reserved", "or later", "without warranties or conditions of any kind", "a copy of the license is in the file copying")
DENIED = ("not licensed under the", "not licensed under", "not released under the", "not released under", "not under the", "is not the", "no longer under the", "never licensed under the", "not distributed under the", "incompatible with the", "instead of the", "rather than the", "unlike the", "not covered by the")
COMMON = (
    "the", "is", "with", "this", "under", "code", "project", "text", "and", "for", "on", "of", "to", "in", "by", "see", "its", "all", "you", "we", "if", "be", "are", "may", "can", "file", "files", "source", "license", "copyright",
    "software", "library", "program", "version", "notice", "terms", "public", "free", "use", "copy", "available", "released", "distributed", "covered", "made", "work", "content", "contributors", "authors", "data", "everyone", "request",
)
OTHER = (
    "driver license number renewed", "the license plate of the car", "a licensed professional will call", "this license was revoked", "license fee per seat", "you need permission to enter",
    "all rights reserved no license is granted", "proprietary license do not distribute", "end user license agreement", "see the license agreement for terms", "a fishing license is required", "license key",
    "under a commercial license", "the public domain theatre", "creative commons room is closed", "version 3 of the manual", "version 2.0 of the license terms of acme", "permission denied", "general public notice",
    "the license", "with license", "licensed under the terms of our agreement", "released under embargo", "copyright the authors", "licensed", "a licence to fish", "this work is for the general public",
    "the software is provided to you", "the mozilla foundation", "the apache tribe", "free software for any person", "terms and conditions apply", "the following conditions were met", "gnu and other animals", "copyright notice and terms of use",
    "the general public may visit", "students at mit", "the free software foundation announced", "software version 3 was released", "permission to use the room is granted", "redistribution of wealth",
)


def notices(n: int = 6000, seed: int = 11) -> list[tuple[tuple[str, ...], str]]:
    """(classes, window): templates in running text and in their licence's context, pairs of licences, denials, and text that names no family."""
    rng = random.Random(seed)
    syllables = ("the", "on", "er", "ing", "tion", "re", "an", "of", "und", "sch", "que", "ment", "os", "ar", "is")
    made = lambda: rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    noise = lambda k: " ".join(made() for _ in range(rng.randint(0, k)))
    out = []
    every = [(f, t) for f, phrases in TEMPLATES.items() for t in phrases]
    for k in range(n):
        kind = rng.random()
        family, core = every[k % len(every)]
        if kind < 0.28:
            core = " ".join(rng.sample(OTHER, rng.randint(1, 3))) if rng.random() < 0.9 else noise(30)
            out.append(((UNKNOWN,), f"{noise(12)} {core} {noise(12)}"))
        elif kind < 0.4:
            short = rng.choice([t for t in TEMPLATES[family] if len(t.split()) <= 8])
            out.append(((UNKNOWN,), f"{noise(8)} {rng.choice(DENIED)} {short.removeprefix('the ')} {noise(8)}"))
        elif kind < 0.5 and len(core.split()) > 5:  # a piece too short to tell
            w = core.split()
            at = rng.randint(0, len(w) // 2)
            piece = w[at : at + max(1, len(w) // 3)]
            out.append(((UNKNOWN if not _holds(" ".join(piece)) else family,), f"{noise(12)} {' '.join(piece)} {noise(12)}"))
        elif kind < 0.65:
            other = rng.choice([f for f in TEMPLATES if f != family])
            pair = f"{core} {rng.choice(('or', 'and', 'and the', 'or the', ''))} {rng.choice(TEMPLATES[other])}"
            out.append(((family, other), f"{noise(8)} {rng.choice(BEFORE)} {pair} {rng.choice(AFTER)} {noise(8)}"))
        else:
            others = [t for t in TEMPLATES[family][:4] if t != core and rng.random() < 0.3]
            before = rng.choice(BEFORE) if rng.random() < 0.5 else ""
            after = rng.choice((*AFTER, *OTHER)) if rng.random() < 0.5 else ""
            out.append((tuple(f for f, t in every if t == core), " ".join([noise(10), before, core, *others, after, noise(10)])))
    return out


def _holds(text: str) -> bool:
    found = set(grams(words(text)))
    return any(sum(g in found for g in t) >= CONTAINED * len(t) for _, t in _template_grams())


_fitted: dict[tuple[int, int], tuple[dict[str, list[float]], list[float], float]] = {}


def model(n: int = 6000, seed: int = 11) -> tuple[dict[str, list[float]], list[float], float]:
    """Weights of each n-gram by class, bias by class, temperature."""
    if (n, seed) in _fitted:
        return _fitted[n, seed]
    rows = notices(n, seed)
    known = list(dict.fromkeys(g for phrases in TEMPLATES.values() for p in phrases for g in grams(words(p))))
    known = list(dict.fromkeys([*known, *(g for p in (*BEFORE, *AFTER, *DENIED, *COMMON, *OTHER) for g in grams(words(p)))]))
    column = {g: k for k, g in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1), np.float32)
    x[:, -1] = 1
    for i, (_, p) in enumerate(rows):
        x[i, [column[g] for g in grams(words(p)) if g in column]] = 1
    y = np.zeros((len(rows), len(_CLASSES)), np.float32)
    for i, (classes, _) in enumerate(rows):
        y[i, [_CLASSES.index(c) for c in classes]] = 1 / len(classes)
    hold = np.arange(len(rows)) % 4 == 0
    w = np.zeros((x.shape[1], len(_CLASSES)), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    soft = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)
    xs, ys = x[~hold], y[~hold]
    for k in range(1, ROUNDS + 1):
        g = xs.T @ (soft(xs @ w) - ys) / len(xs) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    loss = lambda t: -(y[hold] * np.log(soft(x[hold] @ w / t) + 1e-12)).sum(axis=1).mean()
    temperature = float(min(np.linspace(0.5, 4, 36), key=loss))
    w = np.round(w, 4)
    _fitted[n, seed] = {g: w[k].tolist() for g, k in column.items()}, w[-1].tolist(), temperature
    return _fitted[n, seed]


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, as the SQL has them."""
    return re.split(BLANK, re.sub(MARKS, "", text.lower(), flags=re.A | re.M), flags=re.A)


def windows(paragraph: str) -> list[list[str]]:
    """Windows of a paragraph's words that hold an anchor."""
    w = words(paragraph)
    found = (w[k * STEP : k * STEP + WINDOW] for k in range(max(0, -(-(len(w) - WINDOW) // STEP)) + 1))
    return [x for x in found if re.search(rf"(?:^| )(?:{ANCHORS})", " ".join(x))]


def classify(window: list[str]) -> list[str]:
    """The families of a window: the rule that the SQL follows, for tests and small use."""
    weights, bias, temperature = model()
    found = grams(window)
    z = np.array(bias)
    for g in found:
        if g in weights:
            z = z + np.array(weights[g])
    p = np.exp((z - z.max()) / temperature)
    p /= p.sum()
    if p[-1] >= UNSURE:
        return []
    contained = {f for f, t in _template_grams() if sum(g in found for g in t) >= CONTAINED * len(t)}
    return [f for f, share in zip(_CLASSES, p) if share >= SHARE and f in contained]


def families_of(text: str) -> list[tuple[int, str]]:
    """(paragraph, family) pairs of a text, sorted."""
    return sorted({(k, f) for k, p in enumerate(paragraphs(text)) for w in windows(p) for f in classify(w)})


def _template_grams() -> list[tuple[str, list[str]]]:
    """(family, the 2-grams of a template)."""
    return [(f, list(dict.fromkeys(g for g in grams(words(p)) if " " in g))) for f, phrases in TEMPLATES.items() for p in phrases]


def _text_list(items) -> str:
    return "array(" + ", ".join("'" + str(i).replace("'", "\\'") + "'" for i in items) + ")"


def _numbers(items) -> str:
    return "array(" + ", ".join(f"{float(i)!r}D" for i in items) + ")"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, scored (how many windows had an anchor), licences: sorted array of (paragraph, family)."""
    weights, bias, temperature = model()
    known = list(weights)
    table = "array(" + ", ".join(_numbers(weights[g]) for g in known) + ")"
    templates = "array(" + ", ".join(f"named_struct('class', {_CLASSES.index(f)}, 'grams', {_text_list(g)})" for f, g in _template_grams()) + ")"
    kind = "array<struct<paragraph:int,family:string>>"
    # each step's result is bound to a name by a one-element array; texts without an anchor end before any of it
    blocks = f"filter(transform(split(regexp_replace(lower(text), {_quoted('(?md)' + MARKS)}, ''), {_quoted(BLANK)}, -1), (p, i) -> named_struct('n', i, 'p', p)), q -> q.p rlike '{ANCHORS}')"
    worded = f"transform({blocks}, q -> named_struct('n', q.n, 'w', filter(transform(split(q.p, '{_SPLIT}'), x -> trim(BOTH '.' FROM x)), x -> x <> '')))"
    cut = f"flatten(transform({worded}, q -> transform(sequence(0, greatest(0, cast(ceil((size(q.w) - {WINDOW}) / {STEP}D) as int))), k -> named_struct('n', q.n, 'w', slice(q.w, k * {STEP} + 1, {WINDOW})))))"
    anchored = f"filter({cut}, q -> array_join(q.w, ' ') rlike '(?:^| )(?:{ANCHORS})')"
    paired = "transform(anchored, q -> named_struct('n', q.n, 'g', array_distinct(concat(q.w, if(size(q.w) > 1, transform(sequence(1, size(q.w) - 1), i -> concat_ws(' ', q.w[i - 1], q.w[i])), cast(array() as array<string>))))))"
    logits = f"transform(paired, q -> named_struct('n', q.n, 'g', q.g, 'z', aggregate(filter(transform(q.g, x -> array_position({_text_list(known)}, x)), x -> x > 0), {_numbers(bias)}, (a, x) -> zip_with(a, element_at({table}, cast(x as int)), (u, v) -> u + v))))"
    chance = f"transform({logits}, q -> named_struct('n', q.n, 'g', q.g, 'e', transform(q.z, z -> exp((z - array_max(q.z)) / {temperature!r}D))))"
    shares = "transform(chances, q -> named_struct('n', q.n, 'g', q.g, 'p', transform(q.e, e -> e / aggregate(q.e, 0D, (a, x) -> a + x))))"
    sure = f"filter({shares}, q -> element_at(q.p, -1) < {UNSURE!r}D)"
    held = f"filter({templates}, t -> q.p[t.class] >= {SHARE!r}D and size(array_intersect(t.grams, q.g)) >= {CONTAINED!r}D * size(t.grams))"
    found = f"array_sort(array_distinct(flatten(transform({sure}, q -> transform({held}, t -> named_struct('paragraph', q.n, 'family', element_at({_text_list(_CLASSES)}, t.class + 1)))))))"
    body = f"transform(array({anchored}), anchored -> transform(array({paired}), paired -> transform(array({chance}), chances -> named_struct('scored', size(anchored), 'licences', cast({found} as {kind})))[0])[0])[0]"
    none = f"named_struct('scored', 0, 'licences', cast(array() as {kind}))"
    row = id_and_text(docs).select("doc_id", F.expr(f"case when text rlike '(?i){ANCHORS}' then {body} else {none} end as r"))
    return row.select("doc_id", F.col("r.scored").cast("long").alias("n_scored"), F.col("r.licences").alias("licences"))


def families(docs: DataFrame) -> DataFrame:
    """doc_id, n_scored, n_licences, families (sorted, comma-joined), places (paragraph:family, comma-joined)."""
    return licences(docs).select(
        "doc_id",
        "n_scored",
        F.size("licences").cast("long").alias("n_licences"),
        F.expr("array_join(array_sort(array_distinct(transform(licences, s -> s.family))), ',')").alias("families"),
        F.expr("array_join(transform(licences, s -> concat_ws(':', cast(s.paragraph as string), s.family)), ',')").alias("places"),
    )
