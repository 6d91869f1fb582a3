"""Token files: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opsreview.llm import token_files

from .corpus import awkward, frame

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
JSON = token_files._tokenizer_json(token_files.TokenSettings())


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def brute(rows):
    out, start = [], 0
    for doc, own in sorted(((doc, ids(text)) for doc, text, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((doc, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


@pytest.mark.parametrize("block_ids", [50, 1 << 17])
def test_files_give_back_all_ids(spark, tmp_path, block_ids):
    rows = awkward()
    options = token_files.TokenSettings(block_ids=block_ids)
    got = token_files.written_and_read(frame(spark, rows, True).repartition(5), options, str(tmp_path / "files")).drop("ids").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert token_files.written_and_read(frame(spark, []), path=str(tmp_path / "files")).collect() == []


def test_words_are_cut_where_the_tokenizer_cuts():
    draw = random.Random(2)
    texts = ["a  b", " lead", "trail ", "a\n\nb", "a\nb c", "tab\tb", "it's we'll", "x<|endoftext|>y z", "  a", "zero\x00 byte", "é ü", "5 12a b7", "a \n b", "", "!!! ???", "a\r\nb", "\x1c a"]
    texts += ["".join(draw.choice(" \nab,'é1\t") for _ in range(40)) for _ in range(300)]
    cache = token_files.WordCache(JSON, 1000)
    for text, found in zip(texts, cache.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.integers(9, 16))
def test_code_lengths_are_limited_and_complete(counts, longest):
    lengths = token_files.code_lengths(counts, longest)
    assert max(lengths) <= longest and min(lengths) >= 1
    assert len(counts) == 1 or sum(2 ** (longest - x) for x in lengths) == 2**longest


def test_limited_lengths_cost_little_more():
    counts = [2**k for k in range(30)]  # unlimited, the longest code would have 29 bits
    assert max(token_files.code_lengths(counts, 8)) == 8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=0, max_size=5000), st.integers(6, 12))
def test_pack_and_unpack(values, longest):
    values = np.array(values, np.int64)
    used, n = np.unique(values, return_counts=True)
    code = token_files.canonical(list(zip(used.tolist(), n.tolist(), strict=True)), longest)
    data, at = token_files.pack(values, *code.encoding())
    if len(values):
        assert token_files.unpack(data, at, len(values), *code.decoding()).tolist() == values.tolist()


def test_letters_and_punctuation_go_to_the_model_as_the_pattern_cuts_them():
    draw = random.Random(4)
    letters = ["The", "over", "Èonai", "ſtraße", "ŋ", "née", "Москва", "東京", "ﬁn", "ǅ", "ªº", "a" * 300]
    tails = ["", ",", "...", "'", "'s", "'ll", "$$$", "&&&!", "!?", "##", "’", "9", "_", "``", "<|endoftext|>"]
    texts = ["".join(draw.choice([" ", "\n", ""]) + draw.choice(letters) + draw.choice(tails) for _ in range(draw.randrange(1, 30))) for _ in range(400)]
    texts += ["\n", "a\n", "\n\n", "\na", "a\n\n", "a\n b", " \na", "\x00", "\x00 a", "a\x00\nb"]
    for most in (5, 1000):
        cache = token_files.WordCache(JSON, most)
        assert cache.plain
        for part in (texts[:7], texts, texts[::-1]):
            for text, found in zip(part, cache.encode(part, 40), strict=True):
                assert np.frombuffer(found, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_letters_do_not_pass_the_pattern(monkeypatch):
    cache = token_files.WordCache(JSON, 1000)
    seen = []
    monkeypatch.setattr(cache, "whole", lambda texts: seen.extend(texts) or [b"" for _ in texts])
    cache.encode(["one, two! Èonai three\nfour"])
    assert set(seen) <= {",", "!", "\n"}


def test_workers_give_memory_back_after_a_task(monkeypatch):
    from opsreview.llm import near_dedup, tables, toxicity

    given = []
    monkeypatch.setattr(tables, "release", lambda: given.append(1))
    for function in (near_dedup._signing(near_dedup.NearSettings()), near_dedup._comparing(80), near_dedup._tiling(80), toxicity._word_lists):
        list(function(iter([])))
    assert len(given) == 4
