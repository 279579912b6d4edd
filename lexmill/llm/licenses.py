"""Licence scans with a trained paragraph classifier, in built-in functions only.

A paragraph ends at a line without letters and digits, so comment marks alone
are a blank line. Each line, and each paragraph of several lines once joined,
becomes its distinct words and word pairs. A multinomial logistic regression over them gives each
licence family and the class `unknown` a probability; the probabilities are
calibrated by a temperature fitted to out-of-fold predictions, and below
the threshold that reaches the wanted out-of-fold precision a paragraph is
`unknown`. A predicted family counts as confirmed if enough of the word pairs of
one of its templates stand in the line or paragraph, with what tells the family and
version from others, and nothing that denies it. Joined paragraphs count
only when confirmed, as long prose holds many words of the vocabulary; they find
hard-wrapped notices, lines the short ones.

The model is trained on the driver from the notices below, some 1300 lines: notices, the families' names in sentences that grant
something, and in others that deny or only mention it, and everyday sentences in four languages.
Every line is classified. Where even the sum of what each word and pair adds at most
to any family over `unknown` leaves `unknown` ahead, that is the result and the
probabilities, which are not part of it, are not worked out.
Scoring is one projection over the scan: model and templates are constants of
it, no row is shuffled and no Python runs on the executors.

Cases: a null or empty text has no paragraph and no licence; paragraphs without
any word of the model are `unknown`; ties go to the family first by name;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Usual notices of licence families, the first ones also serving as templates.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Distributed under the terms of the Apache License 2.0", "The code is available under the Apache Software License, version 2."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the MIT license.", "This software is MIT licensed.", "SPDX-License-Identifier: MIT", "Distributed under the terms of the MIT License", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GNU GPL version 3 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPLv3 license.", "This software is distributed under the GNU General Public License v3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Released under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPLv2 license.", "This software is distributed under the GNU General Public License v2."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC", "Distributed under the terms of the ISC License"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under the Eclipse Public License v. 2.0."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the GNU LGPL version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Released under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPLv3."],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the BSD 2-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the Mozilla Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC-BY-NC-4.0, non-commercial use only.", "Creative Commons Attribution NonCommercial licence"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution License.", "Content is shared under CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Content is shared under CC-BY-SA-4.0"],
    "public-domain": ["This work is dedicated to the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Dedicated to the public domain under CC0 1.0 Universal.", "The author dedicates this work to the public domain.", "This text has been placed in the public domain.", "The code is in the public domain.", "Released into the public domain by its author.", "This work has been dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.", "Copyright (c) the authors, all rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher, all rights reserved.", "All rights reserved worldwide.", "(c) 2021 The Authors. All rights reserved.", "Copyright by the publisher. All rights reserved by law."],
}
#: Lines with licence vocabulary that grant nothing.
OTHER = [
    "His driving license was suspended for a year.", "You need a fishing licence to use this lake.", "The council will license more taxis next spring.", "A marriage license costs forty dollars.", "The band retained the copyright to the song.", "Copyright law is a difficult subject.", "There is no warranty on used cars.", "The dealer offers a warranty of two years.", "The government plans to redistribute the land.", "Poetic license allows the author to bend the facts.",
    "The nurse renewed her license in the state.", "The licence fee pays for public television.", "They discussed human rights and civil rights in court.", "The museum is open to the public on Monday.", "Creative people share a common office.", "The gnu is a large antelope.", "The general public may use the library.", "MIT is a university in Cambridge.", "The Apache helicopter landed at the base.", "A version of the software was released in spring.",
    "The source code form was filled in.", "The terms of the contract are under review.", "We use software without restriction at work.", "The foundation published a free report.", "License plates must be visible.", "Which license should I choose for my project?", "The lawyer explained copyright to the class.", "See the license file for details.", "The licensing department is closed.", "An unlicensed driver caused the accident.",
]
#: Everyday sentences without licence vocabulary.
PROSE = [
    "Er kommt mit dem Zug nach Hause.", "Sie sprach mit ihrer Mutter und mit dem Arzt.", "Wir fahren mit der Bahn in die Stadt.", "Das Haus mit dem roten Dach ist alt.", "Mit den Kindern und mit der Katze ging er in den Garten.", "Ich trinke Kaffee mit Milch und Zucker.", "Der Mann mit der Brille liest die Zeitung.", "Es war nicht mit ihm zu reden.", "Komm mit!", "Mit freundlichen Grüßen", "Die Arbeit mit Holz macht mir Freude.", "Er ist mit 20 Jahren nach Berlin gezogen.",
    "Sie wohnt mit ihrer Schwester in einem kleinen Haus, das mit Efeu bewachsen ist, und arbeitet mit alten Menschen.", "Der Hund und die Katze sind im Garten.", "Die Kinder spielen in der Schule und auf der Straße.", "Le chat est sur la table et le chien dort dans le jardin.", "Nous avons mangé avec des amis dans un petit restaurant.", "Il ne faut pas oublier les clefs de la maison.", "La version de ce document est la deuxième.", "El perro y el gato viven en la casa de mi hermana.", "No hay pan en la mesa, pero hay frutas.", "La libertad y los derechos de las personas son importantes.", "Una copia del libro está en la biblioteca.",
    "The dog and the cat are in the garden.", "Version 2.0 of the report was released in 2021.", "The apache helicopter 2.0 is a model.", "She studied at MIT in Boston.", "The students of MIT met with students of Harvard.", "The film was released under a new title.", "The parcels were distributed under the supervision of the council.", "The shares were distributed to the owners.", "It is available under the counter.", "The eclipse of 2 August was visible in the north.", "The dog lay under the table for 3 hours.", "Version 3 is free of charge.", "Copies of the book were sent to all persons.", "A copy of the letter is in this file.", "The use of the hall is free for any purpose.",
    "The library and the museum are closed on 4 May.", "He was released in 2 weeks.", "Use of the pool is governed by the rules of the club.", "The work was published by the author in 1990.", "A common man has creative ideas.", "The company distributed 3 million leaflets.", "Mozilla and Apache are names of foundations.", "The conditions of the contract are met.", "The author placed the book on the table.", "The international congress met in 4 cities.",
]
#: A word that is also the name of a family; without these the model would take it for the name in long German lines.
PROSE += [f"{who} {does} mit {whom}." for who, does in (("Sie", "geht"), ("Er", "kommt"), ("Das Kind", "spielt"), ("Die Frau", "spricht"), ("Der Mann", "lebt"), ("Wer", "arbeitet")) for whom in ("ihm", "dem Hund", "der Frau", "den Kindern", "einem Freund", "uns")]
#: Usual names of the families, and sentences that grant something under a name or only speak of it.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0", "Apache Software License, version 2"],
    "MIT": ["MIT License", "MIT license (MIT)", "terms of the MIT licence"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GNU General Public License v3.0", "GPLv3 license", "GNU GPL version 3 or later", "GPL-3.0 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GNU General Public License v2.0", "GPLv2 license", "GNU GPL version 2 or later", "GPL-2.0 license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPL-2.1 license", "GNU Library General Public License"],
    "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPLv3 license", "GNU AGPL v3", "AGPL-3.0 license"],
    "BSD": ["BSD License", "BSD 2-Clause License", "3-clause BSD license", "BSD-3-Clause license", "new BSD license"],
    "ISC": ["ISC License", "ISC license (ISC)", "terms of the ISC licence"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0 license", "MPL-2.0 license"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, v. 2.0", "EPL 2.0 license", "EPL-2.0 license"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0 licence", "Creative Commons BY-NC license"],
    "CC-BY-4.0": ["CC BY 4.0 license", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0 licence", "Creative Commons BY license"],
    "public-domain": ["CC0 1.0 Universal dedication", "Unlicense", "Creative Commons Zero license", "CC0 license"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0 licence", "Creative Commons BY-SA license"],
}
#: Names as they stand without the word licence, and sentences for them.
SHORT = {
    "Apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache v2"], "MIT": ["MIT", "MIT/Expat"], "BSD": ["BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD"], "ISC": ["ISC"], "MPL-2.0": ["MPL 2.0", "MPL-2.0", "Mozilla Public 2.0"], "EPL-2.0": ["EPL 2.0", "EPL-2.0", "Eclipse Public 2.0"],
    "GPL-3.0": ["GPLv3", "GPL-3.0", "GPL 3"], "GPL-2.0": ["GPLv2", "GPL-2.0", "GPL 2"], "LGPL": ["LGPL", "LGPL-2.1"], "AGPL-3.0": ["AGPLv3", "AGPL-3.0"], "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "public-domain": ["CC0", "CC0 1.0"],
}
SHORT_GRANTS = ["Released under {}.", "Distributed under {}.", "Available under {}.", "The code is released under {}.", "License: {}"]
TITLES = ["{}", "The {}", "License: {}"]
GRANTS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "The code is available under the {}.", "Use of this file is governed by the {}."]
MENTIONS = ["This work is not licensed under the {}.", "The code was never released under the {}.", "It is no longer available under the {}.", "We compared the {} with others in our report.", "The student asked what the {} means.", "Should I choose the {} for my project?"]
#: What a confirmed notice of a family must hold, one word or pair of each set, and what it must not hold.
TELLING = {
    "Apache-2.0": [{"apache"}, {"2", "apache2"}],
    "MIT": [{"mit", "hereby granted", "permission notice"}],
    "GPL-3.0": [{"gnu", "gpl", "gplv3"}, {"version 3", "v3", "gplv3", "gpl 3"}],
    "GPL-2.0": [{"gnu", "gpl", "gplv2"}, {"version 2", "v2", "gplv2", "gpl 2"}],
    "LGPL": [{"lesser general", "library general", "lgpl"}],
    "AGPL-3.0": [{"affero", "agpl", "agplv3"}],
    "BSD": [{"bsd", "binary forms"}],
    "MPL-2.0": [{"mozilla", "mpl"}, {"2"}],
    "EPL-2.0": [{"eclipse", "epl"}, {"2"}],
    "ISC": [{"isc", "or without"}],
    "CC-BY-NC-4.0": [{"by nc", "noncommercial", "non commercial"}],
    "CC-BY-4.0": [{"cc by", "commons attribution"}],
    "CC-BY-SA-4.0": [{"by sa", "sharealike", "share alike"}],
    "public-domain": [{"public domain", "the public", "cc0", "unlicense"}],
    "proprietary": [{"rights reserved", "proprietary", "prior written"}],
}
NOT_WITH = {
    "GPL-3.0": {"lesser", "affero", "lgpl", "agpl"},
    "GPL-2.0": {"lesser", "affero", "lgpl", "agpl"},
    "MIT": {"isc", "bsd", "apache"},
    "BSD": {"isc", "mit", "apache"},
    "ISC": {"mit", "bsd", "apache", "binary forms"},
    "CC-BY-4.0": {"noncommercial", "non commercial", "by nc", "sharealike", "share alike", "by sa", "by nd", "noderivatives"},
    "CC-BY-NC-4.0": {"sharealike", "share alike", "nc sa", "nc nd", "noderivatives"},
    "CC-BY-SA-4.0": {"noncommercial", "non commercial", "by nc"},
}
#: Words and pairs that deny a notice.
DENIALS = {"not licensed", "not released", "not available", "not distributed", "not dedicated", "never licensed", "never released", "no longer", "not in", "not under", "isn t", "wasn t", "not all", "without the"}
PRECISION, CONFIRM = 0.97, 0.6
MARGIN = 0.01  # above what the rounding of weights can add up to in a line
WORD = r"[^a-z0-9]+"
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"  # possessive: as many blank lines as there are need no stack


def grams(line: str) -> list[str]:
    words = [w for w in re.split(WORD, line.lower()) if w]
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 200, l2: float = 0.02) -> np.ndarray:
    """Multinomial logistic regression; the last row holds the biases."""
    x = np.hstack((x, np.ones((len(x), 1))))
    goal, w = np.eye(classes)[y], np.zeros((x.shape[1], classes))
    v, t, step = w, 1.0, 1 / (0.5 * np.square(x).sum(axis=1).max() + l2)
    for _ in range(rounds):
        new = v - step * (x.T @ (_softmax(x @ v) - goal) / len(x) * 4 + l2 * v)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t_new * (new - w), t_new
    return w


def examples() -> list[tuple[str, str]]:
    """(line, family) of all training lines, in an order that deals each family and frame to all folds."""
    out = [(t, f) for f, ts in sorted(NOTICES.items()) for t in ts] + [(t, UNKNOWN) for t in OTHER + PROSE]
    named = [(f, n) for f, ns in sorted(NAMES.items()) for n in ns]
    out += [(g.format(n), f) for g in SHORT_GRANTS for f, ns in sorted(SHORT.items()) for n in ns]
    out += [(g.format(n), f) for g in GRANTS + TITLES for f, n in named] + [(m.format(n), UNKNOWN) for m in MENTIONS for _, n in named]
    return sorted(out, key=lambda x: zlib.crc32(x[0].encode()))


def train(labelled: list[tuple[str, str]] | None = None, folds: int = 4, precision: float = PRECISION) -> dict:
    """Families, vocabulary, weights (already divided by the temperature), biases and threshold."""
    labelled = examples() if labelled is None else labelled
    families = [*sorted({f for _, f in labelled} - {UNKNOWN}), UNKNOWN]
    lines = [(grams(t), families.index(f)) for t, f in labelled]
    vocabulary = sorted({g for line, _ in lines for g in line})
    place = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(lines), len(vocabulary))), np.array([k for _, k in lines])
    for i, (line, _) in enumerate(lines):
        x[i, [place[g] for g in line]] = 1
    fold = np.arange(len(lines)) % folds
    z = np.zeros((len(lines), len(families)))
    for f in range(folds):
        w = _fit(x[fold != f], y[fold != f], len(families))
        z[fold == f] = np.hstack((x[fold == f], np.ones((np.sum(fold == f), 1)))) @ w
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    heat = min(loss, key=loss.get)
    p = _softmax(z / heat)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    threshold = 1.0  # if no probability is as precise as wanted, nothing is named
    for t in np.unique(sure[best != len(families) - 1]):
        said = (best != len(families) - 1) & (sure >= t)
        if (best == y)[said].mean() >= precision:
            threshold = float(t)
            break
    w = _fit(x, y, len(families)) / heat
    return {"families": families, "vocabulary": vocabulary, "weights": w[:-1], "bias": w[-1], "threshold": threshold}


def _strings(values: list[str]) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")


def _doubles(values) -> Column:
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), WORD), "")


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))


def _places(vocabulary: list[str]):
    """Expression for the place of a word or pair of the vocabulary, from 1: looked up among the few with its checksum's remainder."""
    parts: list[list[str]] = [[] for _ in range(256)]
    for g in vocabulary:
        parts[zlib.crc32(g.encode()) % len(parts)].append(g)
    place = {g: i + 1 for i, g in enumerate(vocabulary)}
    names = F.array(*(_strings(p) for p in parts))
    places = F.array(*(F.split(F.lit(",".join(str(place[g]) for g in p) or "0"), ",").cast("array<int>") for p in parts))

    def place_of(x: Column) -> Column:
        part = (F.crc32(x.cast("binary")) % len(parts) + 1).cast("int")
        return F.element_at(F.element_at(places, part), F.array_position(F.element_at(names, part), x).cast("int"))

    return place_of


def _units(opening: Column | None):
    def units(lines: Column, at: Column) -> Column:
        """Lines of a paragraph, and the whole if it has several lines: (paragraph, whole, grams); lines: the words of each."""
        unit = lambda whole: lambda w: F.struct(at.alias("at"), F.lit(whole).alias("whole"), _grams(w).alias("grams"))
        some = lambda w: F.lit(True) if opening is None else F.arrays_overlap(w, opening)
        joined = F.filter(F.array(F.flatten(lines)), lambda w: (F.size(lines) > 1) & some(w))
        return F.concat(F.transform(F.filter(lines, some), unit(False)), F.transform(joined, unit(True)))

    return units


def _lead(model: dict) -> tuple[np.ndarray, float]:
    """The most that each gram adds to any family over `unknown`, and the most that a family has over it without any gram."""
    w, b = model["weights"], model["bias"]
    return (w[:, :-1] - w[:, -1:]).max(axis=1), float((b[:-1] - b[-1]).max())


def opening_words(model: dict) -> list[str]:
    """Words of which a line must hold one to be anything but `unknown`; none if even a line without words could be named.

    Each gram that adds to a family over `unknown` is counted with one of its words.
    Left out are usual words whose grams, all taken together, would not suffice.
    So this follows from the weights, and no line is lost.
    """
    over, start = _lead(model)
    room = -start - MARGIN
    if room < 0:
        return []
    adds = {g: o for g, o in zip(model["vocabulary"], over, strict=True) if o > 0}
    often = Counter(w for t in PROSE + OTHER for w in set(re.split(WORD, t.lower())))
    single = {g for g in adds if " " not in g}
    cost: dict[str, float] = defaultdict(float)
    for g, o in adds.items():
        cost[min(g.split(" "), key=lambda w: (w not in single, often[w], w))] += o
    for w in sorted(cost, key=lambda w: (cost[w] / (often[w] + 0.1), w)):
        if cost[w] <= room:
            room -= cost.pop(w)
    return sorted(cost)


def scan_licenses(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, license, probability, confirmed, n_license_lines and licenses of every row.

    `license` is the family of the most probable confirmed line, else of the
    most probable one, else `unknown`; `licenses` has all confirmed families.
    Lines here are also joined paragraphs, counted if no line of theirs has the family.
    """
    model = model or train()
    families, last = model["families"], len(model["families"])
    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.transform(F.split(text, BLANK, -1), lambda p: F.transform(F.split(p, "\n", -1), _words))
    words = opening_words(model)
    opening = _strings(words) if words else None
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.flatten(F.transform(paragraphs, _units(opening))).alias("units"))
    # what the document has of the vocabulary, so that each unit is held against that little only
    found = units.select("doc_id", "units", F.array_intersect(F.flatten("units.grams"), _strings(model["vocabulary"])).alias("here"))
    place_of = _places(model["vocabulary"])
    known = lambda g: F.transform(F.array_intersect(g, F.col("here")), place_of)
    # `here` is used twice: an optimizer that moved it into the lambda would work it out for each unit
    seen = found.select("doc_id", F.transform(F.filter("units", lambda u: F.size("here") >= 0), lambda u: F.struct(u["at"], u["whole"], u["grams"], known(u["grams"]).alias("known"))).alias("units"))
    # no family can be ahead of `unknown` where the most that each gram adds to any does not make it so
    over, start = _lead(model)
    reach = lambda at: F.aggregate(at, F.lit(start), lambda s, i: s + F.element_at(_doubles(over), i))
    open_ = seen.select("doc_id", F.filter("units", lambda u: reach(u["known"]) > -MARGIN).alias("units"))
    b = open_.select("doc_id", F.transform("units", lambda u: F.struct(u["at"], u["whole"])).alias("place"), F.col("units.grams").alias("grams"), F.col("units.known").alias("at"))

    def adder(w: Column):
        return lambda s, i: s + F.element_at(w, i.cast("int"))

    def logit(at: Column) -> Column:
        columns = [_doubles(model["weights"][:, k]) for k in range(last)]
        return F.array(*(F.aggregate(at, F.lit(float(b)), adder(w)) for w, b in zip(columns, model["bias"], strict=True)))

    c = b.select("doc_id", "place", "grams", F.transform("at", logit).alias("z"))
    # (probability, family) of the best class: e^0 over the sum of e^(z - max)
    best = lambda z: F.struct((1 / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(z)))).alias("p"), F.array_position(z, F.array_max(z)).cast("int").alias("k"))
    d = c.select("doc_id", "place", "grams", F.transform("z", best).alias("best"))
    templates = [[grams(t) for t in NOTICES.get(f, [])[:2]] for f in families]
    share = lambda g, t: F.size(F.array_intersect(g, _strings(t))) / len(t)
    has = lambda g, names: F.arrays_overlap(g, _strings(sorted(names)))

    def confirmed(g: Column, k: Column) -> Column:
        """Enough of a template, all that tells the family (and its version) from others, nothing that speaks against it."""
        out = F.lit(False)
        for n, (family, ts) in enumerate(zip(families, templates, strict=True)):
            for t in ts:
                like = share(g, t) >= CONFIRM
                for names in TELLING.get(family, []):
                    like &= has(g, names)
                if family in NOT_WITH:
                    like &= ~has(g, NOT_WITH[family])
                out = F.when((k == n + 1) & like, True).otherwise(out)
        return out & ~has(g, DENIALS)

    said = lambda x, g: F.struct(confirmed(g, x["k"]).alias("ok"), x["p"].alias("p"), (-x["k"]).alias("k"))
    place = lambda x, u: F.struct(x["ok"], x["p"], x["k"], u["at"], u["whole"])
    sure = lambda x: (x["p"] >= model["threshold"]) & (x["k"] > -last) & (x["ok"] | ~x["whole"])
    e = d.select("doc_id", F.filter(F.zip_with(F.zip_with("best", "grams", said), "place", place), sure).alias("said"))
    alone = lambda x: ~x["whole"] | ~F.exists("said", lambda y: (y["at"] == x["at"]) & (y["k"] == x["k"]) & ~y["whole"])
    name = lambda k: F.element_at(_strings(families), -k)
    top = F.array_max("said")
    return e.select(
        "doc_id",
        F.coalesce(name(top["k"]), F.lit(UNKNOWN)).alias("license"),
        F.round(F.coalesce(top["p"], F.lit(0.0)), 6).alias("probability"),
        F.coalesce(top["ok"], F.lit(False)).alias("confirmed"),
        F.size(F.filter("said", alone)).cast("long").alias("n_license_lines"),
        F.array_sort(F.array_distinct(F.transform(F.filter("said", lambda x: x["ok"]), lambda x: name(x["k"])))).alias("licenses"),
    )
