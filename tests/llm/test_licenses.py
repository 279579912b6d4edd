from lexmill.llm import licenses


def scan(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_notices_and_everyday_lines(spark):
    got = scan(spark, ["some prose\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "She renewed her driving license in spring.", "There is no warranty on this car.", "plain prose"])
    assert [r.license for r in got] == ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "proprietary", "unknown", "unknown", "unknown"]
    assert all(r.confirmed for r in got[:5]) and not any(r.confirmed for r in got[5:])
    assert got[0].licenses == ["MIT"] and 0.5 < got[0].probability <= 1


def test_scoring_equals_the_model_in_python(spark):
    import numpy as np

    model = licenses.train()
    for line, r in zip(texts := [t for ts in licenses.NOTICES.values() for t in ts][:25], scan(spark, texts), strict=True):
        at = [model["vocabulary"].index(g) for g in licenses.grams(line) if g in model["vocabulary"]]
        z = model["weights"][at].sum(axis=0) + model["bias"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want = model["families"][p.argmax()] if p.max() >= model["threshold"] else licenses.UNKNOWN
        assert r.license == want


def test_odd_rows_and_native_plan(odd, none):
    out = licenses.scan_licenses(odd)
    assert {r.license for r in out.collect()} == {"unknown"} and out.count() == odd.count()
    assert licenses.scan_licenses(none).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


MIT = """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""


def test_wrapped_notices_are_confirmed(spark):
    commented = ["\n".join(f"{mark} {line}".rstrip() for line in t.split("\n")) for t, mark in ((MIT, "#"), (GPL, " *"), (BSD, "//"))]
    got = scan(spark, [MIT, GPL, BSD, *commented, f"prose before\r\n\r\n{GPL}\n\nprose after", "This work is dedicated\nto the public\ndomain."])
    assert [r.licenses for r in got[:7]] == [["MIT"], ["GPL-3.0"], ["BSD"], ["MIT"], ["GPL-3.0"], ["BSD"], ["GPL-3.0"]]
    assert all(r.confirmed and r.n_license_lines >= 1 for r in got[:7])
    assert got[7].licenses == ["public-domain"]


def test_denials_versions_and_neighbours_are_told_apart(spark):
    lines = {
        "This is not licensed under the MIT License.": None,
        "The library is no longer available under the Apache License, Version 2.0.": None,
        "Released under the ISC License.": "ISC",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This library is licensed under the GNU Lesser General Public License.": "LGPL",
        "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "We spoke about the MIT License and what it means.": None,
    }
    for (line, want), r in zip(lines.items(), scan(spark, list(lines)), strict=True):
        assert r.licenses == ([want] if want else []), (line, r)


def test_long_lines(spark):
    got = scan(spark, ["word " * 100_000 + "\nReleased under the MIT License.", "licence " * 50_000])
    assert got[0].licenses == ["MIT"] and not got[1].confirmed


def test_lines_without_licence_vocabulary_are_classified(spark, docs):
    """No word decides what the model sees: every line gets what the model says of it."""
    import numpy as np

    named = {"Released under BSD 3-Clause.": "BSD", "Distributed under Apache 2.0": "Apache-2.0", "Available under MPL 2.0.": "MPL-2.0", "Released under MIT.": "MIT", "Er ist mit dem Zug und mit uns gekommen.": "unknown"}
    lines = [*named, *sorted({line for r in docs.limit(60).collect() for line in (r.text or "").split("\n")})]
    got = scan(spark, lines)
    assert [r.license for r in got[: len(named)]] == list(named.values())
    model = licenses.train()
    for line, r in zip(lines, got, strict=True):
        at = [model["vocabulary"].index(g) for g in licenses.grams(line) if g in model["vocabulary"]]
        z = model["weights"][at].sum(axis=0) + model["bias"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = model["families"][p.argmax()]
        want = (family, p.max()) if p.max() >= model["threshold"] and family != licenses.UNKNOWN else (licenses.UNKNOWN, 0)
        assert r.license == want[0] and abs(r.probability - want[1]) < 1e-4, line
    among = scan(spark, ["plain prose\n\nReleased under BSD 3-Clause.\nmore prose", "\n" * 200_000 + "Distributed under Apache 2.0" + "\n \n" * 100_000])
    assert [r.license for r in among] == ["BSD", "Apache-2.0"]
