"""Urls, languages, licences."""

import random

from opsreview.llm import language, licenses, urls

from .corpus import awkward, frame


def judged(spark, *addresses):
    pages = spark.createDataFrame([(k, a, "x") for k, a in enumerate(addresses)], "page_id int, url string, host string")
    return [tuple(r)[1:] for r in urls.judged(pages).orderBy("page_id").collect()]


def test_url_rules_and_terms(spark):
    got = judged(
        spark, "http://A.example.ORG/en/12?x", "https://example.org/es/1", "http://x.com/fr/casino", "http://x.com/de/9#t", "http://org/", "http://org",
        "http://cheap-pills.example.com/en/1", "http://free-bets.net/", "http://freebets.net/", "http://win.net/?q=win", "no scheme casino", None, "", "http://y.net/adult/free",
    )
    assert got[:6] == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/es/1", "example.org/es/", "block"), ("x.com", "/fr/casino", "com/fr/", "allow"),
        ("x.com", "/de/9", "com/de/", "block"), ("org", "/", "org/", "allow"), ("org", "", None, "allow"),
    ]
    assert [x[3] for x in got[6:]] == ["block", "block", "allow", "allow", "block", "allow", "allow", "block"]
    assert got[10][:2] == ("", "") and got[11][:2] == ("", "")


def test_urls_empty(spark):
    assert judged(spark) == []


LATIN = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["grzby", "szczaw", "chrzan", "krzak"]}


def train(n=120):
    draw = random.Random(3)
    return [(k, " ".join(draw.choices(LATIN[la], k=30)), la, "a") for k in range(n) for la in [draw.choice(["xx", "yy"])]]


def test_language_of_mixed_texts_and_spans(spark):
    mixed = " ".join(["lorem ipsum dolor amet"] * 5 + ["grzby szczaw chrzan"] * 9)
    rows = [*train(), (900, mixed, None, "a"), (901, None, "xx", "a"), (902, "12 ... !", "xx", "a"), (903, "GRZBY", None, "a"), (904, "日本語", None, "a"), (None, "lorem", None, "a"), (903, "GRZBY", None, "a")]
    found = language.identified(frame(spark, rows, True)).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found}
    assert all(got[i]["lang_pred"] == la for i, _, la, _ in train())
    assert [tuple(s) for s in got[900]["spans"]] == [(0, 20, "xx"), (20, 47, "yy")] and got[900]["lang_pred"] == "yy"
    assert got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[902]["score"] == 0
    assert got[903]["lang_pred"] == "yy" and got[904]["lang_pred"] in LATIN and got[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_without_labels(spark):
    assert {r["lang_pred"] for r in language.identified(frame(spark, [(1, "a", None, None)])).collect()} == {"und"}
    assert language.identified(frame(spark, [])).collect() == []


def test_one_language_is_the_viterbi_path():
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(300):
        scores = draw.normal(0, 2, (draw.integers(1, 40), 3)) + draw.normal(0, 1, 3)
        single = language.one_language(scores, 6.0)
        if single is not None:
            assert (language.viterbi([scores], 6.0)[0] == single).all()


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    draw = np.random.default_rng(2)
    texts = [draw.normal(0, 3, (n, 2)) for n in (7, 3, 1, 6)]
    for scores, path in zip(texts, language.viterbi(texts, 2.0), strict=True):
        worth = lambda p, s=scores: sum(s[t][x] for t, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert abs(worth(path) - max(map(worth, itertools.product(range(2), repeat=len(scores))))) < 1e-9


def test_licences(spark):
    rows = [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nmore", "en", "a"), (2, "x Released under the  MIT license. Then more", "en", "a"),
        (3, "Licensing is a topic. The license of the work.", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (None, "ALL RIGHTS RESERVED", "en", "a"),
        (6, "Redistribution and use in source and binary forms,\nwith or without modification, are permitted\nprovided that the following conditions are met:", "en", "a"),
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nmore", "en", "a"), (7, "This work is licensed under the GNU General Public License, version 2.", "en", "a"),
    ]
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scanned(frame(spark, rows, True)).collect()}
    assert set(got) == {(1, "Apache-2.0"), (2, "MIT"), (None, "all-rights-reserved"), (6, "BSD"), (7, "GPL-2.0")}
    assert got[(1, "Apache-2.0")] == 1.0
    assert licenses.scanned(frame(spark, [])).collect() == []
    assert licenses.scanned(frame(spark, awkward())).collect() == []


def test_anchors_miss_no_match():
    settings = licenses.LicenseSettings()
    anchors = set(licenses.anchors(settings))
    draw = random.Random(5)
    for _, text in settings.templates:
        own = licenses.words(text)
        for _ in range(200):
            changed = [w if draw.random() > 0.1 else "zz" for w in own]
            a, b = set(licenses.bigrams(" ".join(changed))), set(licenses.bigrams(text))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= settings.dice:
                assert a & anchors
