"""Mixing against its balance conditions, decontamination against brute force, and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from opsreview.llm import decontaminate, mixing

from .corpus import awkward, frame, words


def wanted(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def source_sizes(rows):
    out = defaultdict(int)
    for _, text, _, source in rows:
        out[source] += size(text)
    return out


@pytest.mark.parametrize("block", [20, 8_000])
def test_mix_meets_targets(spark, block):
    draw = random.Random(2)
    rows = awkward() + [(1000 + k, " ".join(words(draw, draw.randrange(1, 60))), "en", draw.choice(["a", "a", "a", "ä", "z", None])) for k in range(600)]
    settings = mixing.MixSettings(block_rows=block)
    got = mixing.mixed(frame(spark, rows, True).repartition(3), settings).collect()
    again = mixing.mixed(frame(spark, rows[::-1]).repartition(7), settings).collect()
    plain = lambda rs: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]) for r in rs)
    assert len(got) == len(rows) and plain(got) == plain(again)
    target, taken = wanted(source_sizes(rows)), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == source_sizes(rows)[r["source"]]
        assert r["taken"] == r["size"] * r["times"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        # The last few documents are rounded: with one of 30,000 words among them no choice need come nearer.
        longest = max(size(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - t) <= (max(60, 0.01 * t) if longest < 1000 else longest / 2), s


def test_mix_repeats_rows(spark):
    rows = [(k, "one two three", "en", "ab"[k % 2]) for k in range(40)] + [(1, "one two three", "en", "b")] * 5
    docs = frame(spark, rows, True)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() * 3 == pytest.approx(1.5 * 3 * len(rows), abs=6)
    assert mixing.mix(frame(spark, [])).collect() == [] and mixing.mixed(frame(spark, [])).collect() == []
    assert mixing.mix(frame(spark, [(1, None, None, None), (2, "", None, "a")])).collect() == []


def test_walk_keeps_totals():
    draws = np.random.default_rng(1)
    for n in (3, 10, 500):
        chance, weight = draws.random(n), draws.integers(1, 1000, n)
        p = mixing.walk(chance, weight, draws)
        assert p.sum() == pytest.approx(chance.sum()) and (p * weight).sum() == pytest.approx((chance * weight).sum())
        assert ((p > 0) & (p < 1)).sum() <= 2 and (p >= 0).all() and (p <= 1).all()


def test_walk_keeps_probabilities():
    chance, weight = np.array([0.2, 0.5, 0.7, 0.4, 0.9]), np.array([3, 50, 7, 20, 11])
    mean = np.mean([mixing.walk(chance, weight, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.03


ITEMS = [
    (1, "A train leaves with 120 people and Alice walks 5 km to meet old Bob before the 3 doors close again."),
    (2, "Plain words only stand here one after the other so that nothing is typed at all today."),
    (3, "Two words."),
    (4, None),
    (5, "six words are here in all"),
]


def found(spark, texts):
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id int, text string, at string")
    return [(r["contaminated"], r["item_id"], r["same_values"]) for r in sorted(decontaminate.judged(frame(spark, rows, True), bench).collect(), key=lambda r: r["doc_id"])]


def test_templates_and_slots(spark):
    one, two = ITEMS[0][1], ITEMS[1][1]
    swapped = "So, one day. " + one.replace("120", "77").replace("Alice", "Carol").replace("5 km", "9 miles").replace("Bob", "Dave").replace("3", "4") + " The end."
    twisted = one.replace("Alice", "Carol").replace("Bob", "Carol")  # two people became one
    got = found(spark, [f"x y z. {one} tail", swapped, twisted, f"before {two.upper().replace(' ', '!! ')} after", " ".join(two.split()[:9]), "Plain words only stand elsewhere", None, "", "Two words.", "say: six words are here in all!"])
    assert got == [
        (True, 1, True), (True, 1, False), (False, None, None), (True, 2, True), (False, None, None), (False, None, None),
        (False, None, None), (False, None, None), (False, None, None), (True, 5, True),
    ]


def judged_by(spark, items, texts):
    """Flagged item and ``same_values`` of each text, short items included."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    out = decontaminate.judged(docs, bench, decontaminate.DecontaminationSettings(short_items=True)).collect()
    return [(r["item_id"], r["same_values"]) for r in sorted(out, key=lambda r: r["doc_id"])]


def test_items_of_numbers_and_short_items_are_found(spark):
    items = [
        "What comes next: 2, 4, 8, 16, 32, 64, 128, 256?", "Compute 12 + 7 * 3 - 48 / 6 + 15 and give the result.",
        "Solve for x: 3 x + 7 y = 21, 5 x - 2 y = 4, 6 x + 9 y = 33.", "Define brittle fracture",
    ]
    texts = [f"some words before. {x} And others behind it." for x in items]
    texts += ["What comes next: 3, 5, 9, 17, 31, 65, 127, 255?", "Define a fracture", "so define BRITTLE fracture!"]
    assert judged_by(spark, items, texts) == [(0, True), (1, True), (2, True), (3, True), (None, None), (None, None), (3, True)]


def test_names_do_not_depend_on_context_or_case(spark):
    tom = "Tom has 5 apples. Anna gives Tom 3 more apples. Tom eats 2 apples. How many apples are left?"
    items = [tom, "What is the capital of France?"]
    other = tom.replace("Tom", "Karl").replace("Anna", "Eva").replace("5", "7").replace("3", "4").replace("2", "6")
    texts = [other, f"so {other}", "Question: What is the capital of France?", "WHAT IS THE CAPITAL OF FRANCE", tom.lower(), "What is the colour of France?"]
    assert judged_by(spark, items, texts) == [(0, False), (0, False), (1, True), (1, True), (0, True), (None, None)]


def test_numerals_are_single_tokens(spark):
    item = "A farm sells 900 eggs for 45 dollars and later 120 eggs at 6 dollars so five hens and 1/2 the barn stay with -3 left."
    other = item.replace("900", "1,900").replace("45", "47.50").replace("120", "1,120").replace("6 d", "6.25 d")
    words = other.replace("five", "twenty-five").replace("1/2", "50%").replace("-3", "7")
    assert judged_by(spark, [item], [other, words, item]) == [(0, False), (0, False), (0, True)]


def test_numbers_may_coincide(spark):
    item = "In the basket are 2 apples and 3 oranges and in the box are 3 lemons, so what is the sum?"
    texts = [item.replace("2", "4").replace("3", "4"), item.replace("3 lemons", "8 lemons")]
    assert judged_by(spark, [item], texts) == [(0, False), (0, False)]


def test_planted_items_are_found_and_clean_rows_stay(spark):
    draw = random.Random(4)
    items = [(k, " ".join(words(draw, draw.randrange(15, 60), of=300)).capitalize() + ".") for k in range(30)]
    rows = awkward() + [(1000 + k, " ".join([*words(draw, 50), items[k % 30][1], *words(draw, 50)]), "en", "a") for k in range(60)]
    docs = frame(spark, rows, True)
    bench = spark.createDataFrame([*items, (None, items[0][1])], "item_id int, text string")
    bad = {r["doc_id"] for r in decontaminate.judged(docs, bench).collect() if r["contaminated"]}
    assert bad == set(range(1000, 1060))
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(awkward())
    shuffled = decontaminate.DecontaminationSettings(broadcast_hashes=0)
    assert decontaminate.clean(docs, bench, shuffled).count() == len(awkward())


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontaminate.judged(frame(spark, []), bench).collect() == []
    assert decontaminate.clean(frame(spark, awkward()), bench.limit(0)).count() == len(awkward())


def test_pipeline_stages_one_by_one(spark, tmp_path):
    draw = random.Random(5)
    rows = [(k, " ".join(words(draw, 80)), "en", draw.choice("abc")) for k in range(400)]
    toxic = {k for k in range(400) if k % 7 == 0}
    rows = [(k, t + (" worthless idiot" if k in toxic else ""), la, s) for k, t, la, s in rows]
    rows += [(500 + k, rows[k][1], "en", "a") for k in (1, 2, 3)] + [(600, " ".join(words(draw, 80)) + " " + ITEMS[1][1], "en", "a")]
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs)
    ids = [sorted(r["doc_id"] for r in x.collect()) for x in kept]
    assert ids[0] == sorted({r[0] for r in rows} - toxic)
    assert ids[1] == sorted(set(ids[0]) - {501, 502, 503})
    assert ids[2] == sorted(set(ids[1]) - {600}) and ids[3] == ids[4]
    assert all(x.columns == list(corpus_pipeline.DOCUMENT_COLUMNS) for x in kept[:4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_clean_keeps_own_columns_of_clashing_names(spark):
    item = "What is the capital of the small country in the far north of the old continent?"
    rows = [(1, f"before {item} after", "en", "a"), (2, "nothing of it", "en", "a"), (None, None, "en", "a")]
    docs = frame(spark, rows).selectExpr("*", "'mine' AS bad_id", "'mine' AS bad_hash", "'mine' AS row")
    got = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["bad_id"], r["bad_hash"]) for r in got.collect()) == [(0, "mine", "mine"), (2, "mine", "mine")]


def test_anchors_lose_nothing(spark, monkeypatch):
    """Random items and texts of words, names, numerals, units and marks: looking all texts up finds no more."""
    draw = random.Random(11)
    pool = "red hat sun 12 1,900 3.5 five twenty-five two hundred and six kg miles Anna Bob m² ½ ΑΣ ǃk x y 7% -3 1/2 Ⅳ b2b İstanbul".split(" ")
    text = lambda n: " ".join(draw.choices(pool, k=n))
    items = [text(draw.choice([1, 2, 3, 5, 8, 9, 14])) for _ in range(60)] + ["½ ² Ⅳ ½ ²", "2 4 8 16 32 64 128 256", "ǃ"]
    again = {"Anna": "Carol", "Bob": "Dave", "12": "77", "1,900": "1900", "kg": "miles", "five": "six"}
    other = lambda t: " ".join(again.get(w, w) for w in t.split(" "))
    texts = [f"{text(6)}; {draw.choice([str, str.upper, str.lower, other])(draw.choice(items))} {text(6)}" for _ in range(150)] + [text(40) for _ in range(50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    settings = decontaminate.DecontaminationSettings(short_items=True, coverage=0.01)
    got = sorted(map(tuple, decontaminate.matches(docs, bench, settings).collect()))
    monkeypatch.setattr(decontaminate, "_with_anchors", lambda d, *_: d.selectExpr("*", "xxhash64(text) AS text_hash"))
    assert got == sorted(map(tuple, decontaminate.matches(docs, bench, settings).collect())) and len(got) > 100
