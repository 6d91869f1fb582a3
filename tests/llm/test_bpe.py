"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from opsreview.llm import bpe

from .corpus import awkward, frame

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLE = bpe.merges(bpe.BpeSettings())


def brute(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip_of_awkward_rows(spark, extra):
    rows = awkward() + [(70, "x" * 5_000 + "好世界。" * 3_000 + " " * 3_000, "zh", "a"), (71, "<|endoftext|> it's we'LL 12345  　 \n\n x", "en", "a")]
    got = bpe.round_trip(frame(spark, rows, extra).repartition(3), bpe.BpeSettings(characters=20_000, ids=5_000, pieces=900)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((doc, *brute(text))) for doc, text, *_ in rows)


def test_empty_table(spark):
    assert bpe.round_trip(frame(spark, [])).collect() == []


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="vocabulary does not have"):
        bpe.decoded(spark.createDataFrame([(1, [5, 60_000])], "doc_id long, ids array<int>")).collect()


def test_null_and_empty_ids(spark):
    got = bpe.decoded(spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in got} == {1: b"", 2: b"", 3: LIBRARY.decode_bytes([64, 65])}


@pytest.fixture(scope="module")
def encoder():
    made = bpe.Encoder(TABLE, bpe.BpeSettings(long_piece=12))
    yield made
    made.close()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(encoder, texts):
    ids = encoder.encode(texts)
    assert ids.to_pylist() == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [bytes(x) for x in encoder.decode(ids).to_pylist()] == [t.encode() for t in texts]


def test_long_pieces(encoder):
    draw = random.Random(5)
    texts = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他", "=-", "é ü") for n in (13, 64, 65, 400, 3_000)]
    assert encoder.encode(texts).to_pylist() == [LIBRARY.encode_ordinary(t) for t in texts]


def test_characters_of_other_unicode_versions(encoder):
    """Every code point between letters, digits and blanks is cut as the library cuts it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}\n" for c in points[i : i + 20_000]) for i in range(0, 0x30000, 20_000)]
    for text in texts:
        assert encoder.splitter.pieces(text) == [p for p in library_pieces(text)]


def library_pieces(text):
    """The library's cuts, seen from a vocabulary of single bytes with one token for each distinct piece."""
    single = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    pieces = {p.encode() for p in bpe.Splitter(TABLE).adapted.findall(text)}
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {p: 256 + k for k, p in enumerate(sorted(p for p in pieces if len(p) > 1))}
    whole = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {i: p for p, i in ranks.items()}
    assert bytes(single.encode_ordinary(text)) == text.encode()
    return [by_id[i].decode(errors="replace") for i in whole.encode_ordinary(text)]
