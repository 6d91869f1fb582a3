"""Toxicity and quality: held-out accuracy and awkward rows."""

import random

import numpy as np
import pytest

from opsreview.llm import quality, toxicity
from opsreview.llm.subwords import means, pieces

from .corpus import awkward, frame, words

BAD = ["stupid", "idiot", "moron", "trash", "pathetic", "worthless"]


def insulting(n=900):
    draw = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        own, toxic = words(draw, draw.randrange(5, 120)), int(draw.random() < 0.25)
        if toxic:
            for _ in range(draw.randrange(1, 3)):
                own[draw.randrange(len(own))] = draw.choice(BAD)
        rows.append((k, " ".join(own), "en", "a"))
        labels.append((k, 1, toxic))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = insulting()
    return toxicity.fit(frame(spark, rows), labelled(spark, [*labels, (None, 1, 1), (5, None, None), (10**6, 1, 1)]))


def test_toxic_held_out_documents_are_found(spark, model):
    rows, labels = insulting()
    import zlib

    fold = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    texts, toxic = dict((r[0], r[1]) for r in rows), {k: t for k, _, t in labels}
    score = {k: model.document_score(model.word_logits(sorted(toxicity.words_of(texts[k]))).max()) for k in fold}
    assert np.mean([(score[k] >= 0.3) == toxic[k] for k in fold]) > 0.97


def test_misspellings_share_their_pieces(model):
    seen, misspelt, plain = (model.word_logits(x) for x in (["stupid", "pathetic"], ["stupidd", "pathetik"], ["wakua", "wblva"]))
    assert (misspelt > plain).all() and (seen >= misspelt).all()


def test_toxicity_of_awkward_rows(spark):
    rows, labels = insulting(300)
    rows = [(k + 10_000, *r) for k, *r in rows] + awkward() + [(9_000, "", "en", "a"), (9_001, "!!! ...", "en", "a"), (9_002, " ".join(words(random.Random(1), 40_000)) + " idiot", "en", "a")]
    got = toxicity.scored(frame(spark, rows, True), labelled(spark, [(k + 10_000, q, t) for k, q, t in labels])).collect()
    assert len(got) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert {r["toxicity"] for r in got if not (r["text"] or "").strip(" \n\t!.")} == {0.0}
    assert next(r["toxicity"] for r in got if r["doc_id"] == 9_002) >= 0.3


def test_toxicity_without_labels(spark):
    kept = toxicity.without_toxic(frame(spark, awkward(), True), labelled(spark, []))
    assert kept.count() == len(awkward()) and kept.columns == frame(spark, [], True).columns
    assert toxicity.scored(frame(spark, []), labelled(spark, [])).collect() == []


def test_pieces_do_not_depend_on_the_batch():
    own = ["a", "", "word", "straße", "x" * 300]
    at, starts = pieces(own, 3, 5, 1000, at_once=2)
    for k, w in enumerate(own):
        end = starts[k + 1] if k + 1 < len(own) else len(at)
        assert at[starts[k] : end].tolist() == pieces([w], 3, 5, 1000)[0].tolist()
    assert means(np.array([1.0, 3.0, 5.0]), np.array([0, 2])).tolist() == [2.0, 5.0]


def pages(n=1200):
    draw = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        good, own = int(draw.random() < 0.7), words(draw, draw.randrange(20, 150))
        if not good:
            own = [f"{w}$$$" for w in own] if draw.random() < 0.5 else [w.upper() + "!!" for w in own]
        rows.append((k, " ".join(own), "en", draw.choice(["a", "b"])))
        if k % 2 == 0:
            labels.append((k, good, 0))
    return rows, labels, {k: g for k, g, _ in labels}


def test_quality_of_held_out_and_awkward_rows(spark):
    import zlib

    rows, labels, truth = pages()
    every = rows + [(i if i is None else i + 50_000, *r) for i, *r in awkward()]
    got = quality.scored(frame(spark, every, True), labelled(spark, [*labels, (None, 1, 1), (4, None, 0)])).collect()
    assert len(got) == len(every) and all(0 <= r[c] <= 1 for r in got for c in ("score", "text_score", "page_score"))
    fold = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    for column in ("score", "text_score", "page_score"):
        assert np.mean([(r[column] >= 0.5) == truth[r["doc_id"]] for r in fold]) > 0.95


def test_quality_without_labels(spark):
    assert {r["score"] for r in quality.scored(frame(spark, awkward()), labelled(spark, [])).collect()} == {0.5}
    assert quality.scored(frame(spark, []), labelled(spark, [])).collect() == []


def test_own_columns_of_clashing_names_stay(spark):
    rows, labels = insulting(400)
    docs = frame(spark, rows).selectExpr("*", "'mine' AS toxicity", "'mine' AS row")
    got = toxicity.without_toxic(docs, labelled(spark, labels))
    assert got.columns == docs.columns
    kept = got.collect()
    assert 0 < len(kept) < 400 and {r["toxicity"] for r in kept} == {"mine"}
