"""Alignment of two tokenizers against plain loops over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from opsreview.llm import align

from .corpus import awkward, frame

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
FILES = align._tokenizer_files(align.AlignSettings())
PAIR = align.Pair(*FILES, 1000)


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out, b"".join(data for _, data in tokens)


def parts(text):
    """Links as id pairs, groups as text, and tokens of both; null where there are none."""
    if not text:
        return None
    a, from_a = spans([(i, PAIR.a_bytes[i]) for i in A.encode(" " + text, add_special_tokens=False).ids])
    b, from_b = spans([(i, b_bytes(i)) for i in B.encode(text)])
    if from_a != (" " + text).encode() or from_b != from_a:
        return None
    links, k = [], 0
    for i, s, e in a:
        while b[k][2] <= s:
            k += 1
        j = k
        while j < len(b) and b[j][1] < e:
            links.append((i, b[j][0]))
            j += 1
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    groups = [[[i for i, s, e in own if lo < e <= hi] for own in (a, b)] for lo, hi in zip([0, *ends], ends, strict=False)] if len(ends) < 400 else by_walk(a, b, ends)
    return len(a), len(b), links, groups


def by_walk(a, b, ends):
    out, i, j = [], 0, 0
    for hi in ends:
        own = [[], []]
        while i < len(a) and a[i][2] <= hi:
            own[0].append(a[i][0])
            i += 1
        while j < len(b) and b[j][2] <= hi:
            own[1].append(b[j][0])
            j += 1
        out.append(own)
    return out


def written(groups):
    return ";".join("|".join(",".join(map(str, own)) for own in g) for g in groups)


def brute(rows):
    found = [(doc, parts(text)) for doc, text, *_ in rows]
    counts = Counter(pair for _, p in found if p for pair in set(p[2]))
    top: dict = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc, p in found:
        if p is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        n_a, n_b, links, groups = p
        best = sum(counts[x] == top[x[0]] for x in links)
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(written(groups).encode()).hexdigest(), shared))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
ODD = [
    "a  b\n\n c \n d\t e ", "▁ not alike", "it's <s> </s> <0x41> <|endoftext|> <unk>", "好世界 ok 世界\x00 x", "é ü 　 z", "\n", " ", "x" * 300, "ab ▁ c",
    "Ａ ﬁ ﬀ é", "tab\tb\r\nc", " lead", "trail \n", "12,345.67 %", "\x1c a", "a  b", "🙂🙂 🙂",
]


def rows_of_all_kinds():
    return awkward() + [(100 + k, t, "en", "a") for k, t in enumerate(ODD)] + [(100, ODD[0], "en", "a")]


@pytest.mark.parametrize("options", [{}, {"characters": 3_000, "chunk": 20_000, "units": 50}])
def test_counts_of_awkward_rows(spark, options):
    rows = rows_of_all_kinds()
    got = align.counted(frame(spark, rows, bool(options)).repartition(4), align.AlignSettings(**options)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_groups(spark):
    rows = rows_of_all_kinds()
    got = align.aligned(frame(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], written([(g["a"], g["b"]) for g in r["groups"]]))) for r in got) == sorted(repr((doc, written(p[3]) if (p := parts(text)) else "")) for doc, text, *_ in rows)


def test_empty_table(spark):
    assert align.counted(frame(spark, [])).collect() == []


def one(pair, text):
    numbers, starts = pair.texts([text])
    if not len(numbers) or (pair.sizes[numbers, 0] < 0).any():
        return None
    return (*pair.sizes[numbers].sum(0)[:2].tolist(), b";".join(pair.groups[u] for u in numbers).decode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'1.,▁é́世 　"), st.characters(codec="utf-8")), max_size=40))
def test_units_give_what_whole_texts_give(text):
    p = parts(text)
    assert one(PAIR, text) == ((p[0], p[1], written(p[3])) if p else None)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 12), st.integers(1, 12), st.integers(1, 12))
def test_row_products(seed, n, k, m):
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(0, 3, shape) * (draw.random(shape) < 0.4) for shape in ((n, k), (k, m)))

    def csr(x):
        rows, columns = np.nonzero(x)
        return align.Csr.of(rows, columns, x[rows, columns], len(x))

    got = align.product(csr(a), csr(b))
    dense = np.zeros((n, m), np.int64)
    dense[got.rows, got.columns] = got.values
    assert (dense == a @ b).all()


def test_shared_links_hold_overlaps_and_are_counted():
    a, b = np.array([3, 1, 2, 4]), np.array([2, 2, 2, 3, 1])
    joint = np.intersect1d(np.cumsum(a), np.cumsum(b))
    of = [np.searchsorted(joint, np.cumsum(x)) for x in (a, b)]
    in_a, in_b = (align.Csr(np.arange(len(g) + 1), g, np.ones(len(g), np.int64)) for g in of)
    of_b = align._transposed(in_b, len(joint))
    shared = align.product(in_a, of_b)
    assert np.diff(shared.starts).tolist() == align.row_counts(in_a, of_b).tolist()
    links = align.product(align.token_bytes(a), align.bytes_token(b))
    assert set(zip(links.rows.tolist(), links.columns.tolist())) <= set(zip(shared.rows.tolist(), shared.columns.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 35) - 1), max_size=50))
def test_varints(values):
    data, _ = align.varint(np.array(values, np.int64))
    assert align.unvarint(data).tolist() == values


def test_random_texts_in_one_memory():
    draw = random.Random(4)
    pair = align.Pair(*FILES, 300)
    for _ in range(60):
        text = "".join(draw.choice(["the", " ", "\n", "ing", "  ", "é", "世", ",", "1", "▁", "\t", "x"]) for _ in range(draw.randrange(1, 60)))
        p = parts(text)
        assert one(pair, text) == ((p[0], p[1], written(p[3])) if p else None), repr(text)


def test_a_worker_makes_its_pair_once(spark, monkeypatch):
    """Two tasks of one worker, the second of which meets units of the first."""
    shared, made = align.remembered, []
    monkeypatch.setattr(align, "Pair", lambda *a: made.append(a) or PAIR)
    for _ in range(2):
        shared("pair", "test", lambda: align.Pair(*FILES, 1000))
    assert len(made) == 1
    rows = [(k, text, "en", "a") for k, text in enumerate(["one two, three", "two, three\nfour", "", "née  Èonai! one"] * 6)]
    got = {r["doc_id"]: r for r in align.counted(frame(spark, rows).coalesce(1)).collect()}
    again = {r["doc_id"]: r for r in align.counted(frame(spark, rows).repartition(5)).collect()}
    assert got == again and got[0]["n_a"] == len(A.encode(" one two, three", add_special_tokens=False).ids)


def test_units_of_one_text_are_not_split_one_by_one(monkeypatch):
    pair = align.Pair(*FILES, 1000)
    monkeypatch.setattr(np, "split", None)
    pair.texts(["one two, three four"])
    assert pair.sizes[:, 0].sum() == len(A.encode(" one two, three four", add_special_tokens=False).ids)
