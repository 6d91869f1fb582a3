"""Alignment of two tokenizers by the bytes that their tokens cover.

Tokens of A and of B over the same bytes are rows of two token-byte incidence matrices in CSR form. The
row products of A with the transpose of B (Gustavson: the rows of the second factor that a row of the
first names, added up) hold the overlap links: which tokens share bytes, and how many. Offsets where
tokens of both end cut the bytes into groups; token-group incidences hold which tokens lie in a
group, and their product, again row by row, the shared-group links. That product is counted but not written
out, as a group of m and n tokens has m * n of them; its two factors are what ``aligned`` gives.

Neither tokenizer joins a character to a blank or line feed that follows it (which is read from their
files; where it does not hold, texts are taken whole). So texts are cut there, each distinct unit is
tokenized and multiplied once for as long as a worker remembers it, and a text is its units in order.

Counts of linked ids over all documents: a task numbers the id pairs of its chunk of documents, and keeps for each document
the numbers of its pairs. Only the chunks' lists of pairs are shuffled to be counted; the counts come back to the
chunk, whose documents are cogrouped with them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.llm.tables import remembered, text_of
from opsreview.session import write_through


@dataclass(frozen=True)
class AlignSettings:
    """``a``: path of a ``tokenizers`` file of the byte-level kind, ``b``: of a ``sentencepiece`` model that adds a blank (null:
    the public ones), both read on the driver; ``characters``: how much is aligned at once; ``chunk``: characters
    of the documents whose pairs are numbered together; ``units``: how many a Python worker remembers."""

    a: str | None = None
    b: str | None = None
    characters: int = 4_000_000
    chunk: int = 40_000_000
    units: int = 300_000


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row ``i`` has ``values`` at ``columns`` from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> Csr:
        """From entries in order of (row, column), equal places added up."""
        first = np.ones(len(rows), bool)
        first[1:] = (np.diff(rows) != 0) | (np.diff(columns) != 0)
        at = np.flatnonzero(first)
        total = np.add.reduceat(values, at) if len(at) else values
        return Csr(np.searchsorted(rows[at], np.arange(n + 1)), columns[at], total)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def product(a: Csr, b: Csr) -> Csr:
    """``a @ b``, the rows of all of ``a`` at once: entry (i, k) brings row k of ``b`` into row i."""
    lengths = np.diff(b.starts)[a.columns]
    taken = _ranges(b.starts[a.columns], lengths)
    rows, columns = np.repeat(a.rows, lengths), b.columns[taken]
    values = np.repeat(a.values, lengths) * b.values[taken]
    if np.any((np.diff(rows) == 0) & (np.diff(columns) < 0)):
        order = np.lexsort((columns, rows))
        rows, columns, values = rows[order], columns[order], values[order]
    return Csr.of(rows, columns, values, len(a.starts) - 1)


def row_counts(a: Csr, b: Csr) -> np.ndarray:
    """Entries in each row of ``a @ b``, where no two entries of a row of ``a`` name rows of ``b`` with a common column."""
    met = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return met[a.starts[1:]] - met[a.starts[:-1]]


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token covers the bytes after those of the tokens before it."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64))


def bytes_token(lengths: np.ndarray) -> Csr:
    """The transpose: each byte has one token."""
    total = int(lengths.sum())
    return Csr(np.arange(total + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(total, np.int64))


def _transposed(m: Csr, n: int) -> Csr:
    order = np.argsort(m.columns, kind="stable")
    return Csr.of(m.columns[order], m.rows[order], m.values[order], n)


class Pair:
    """The two tokenizers, and what is known of the units met so far."""

    def __init__(self, a: str, b: bytes, most: int):
        import json
        import re

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_str(a), SentencePieceProcessor(model_proto=b), most
        self.a.encode_special_tokens = True
        spec = json.loads(a)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.a_bytes = self._a_bytes()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        keeps = self.b.encode("x  x\n x ", out_type=str)
        plain = plain and "".join(keeps) == "▁x▁▁x<0x0A>▁x▁" and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.cut_at = plain
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i},".encode() for i in range(n)] + [f"{i}|".encode() for i in range(n)]
        self.written += [f"{i},".encode() for i in range(m)] + [f"{i};".encode() for i in range(m)] + [str(i).encode() for i in range(m)]
        self.cutting = re.compile(r"(?<=\S)(?=[ \n])")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.white = np.zeros(0, bool)
        self.sizes = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, shared-group links; -1: not alike
        self.starts, self.keys = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def _a_bytes(self) -> list[bytes]:
        """Bytes of A's entries: printable characters stand for bytes, those left over follow from U+0100 in order."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        vocabulary = self.a.get_vocab()
        out = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return out

    def _tokenized(self, text: str, whole: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B for ``text``, which begins with a blank unless it is part of a longer one; null where their bytes are not those of ``text``."""
        a = self.a.encode(text, add_special_tokens=False).ids
        data = text.encode()
        if whole:
            b = self.b.encode(text[1:], num_threads=1)
        else:  # after a character that never joins with what follows
            b = self.b.encode("x" + text, num_threads=1)
            if self.b_bytes[b[0]] != b" x":
                return None
            b = b[1:]
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _together(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Units that end with no white space are tokenized in one text and cut again; if that fails, in halves."""
        found = self._tokenized("".join(units), False)
        if found is None:
            if len(units) == 1:
                return [None]
            half = len(units) // 2
            return self._together(units[:half]) + self._together(units[half:])
        ends = np.cumsum([len(u.encode()) for u in units])
        a, b = found
        a_cut, b_cut = ([0, *np.searchsorted(np.cumsum(lengths[ids]), ends, "right").tolist()] for ids, lengths in ((a, self.a_length), (b, self.b_length)))
        return [(a[s:e], b[t:f]) for s, e, t, f in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False)]

    def learn(self, units: list[str], whole: bool = False) -> None:
        """Tokenize and align units. ``whole``: each is a blank and a whole text."""
        first = len(self.groups)
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(units)
        if whole:
            found = [self._tokenized(u, True) for u in units]
        else:
            tails = [i for i, u in enumerate(units) if u[-1:].isspace()]
            for i in tails:
                found[i] = self._tokenized(units[i], False)
            tailed = set(tails)
            rest = [i for i in range(len(units)) if i not in tailed]
            for k in range(0, len(rest), 2_000):
                part = rest[k : k + 2_000]
                for i, own in zip(part, self._together([units[i] for i in part]), strict=True):
                    found[i] = own
        for i, u in enumerate(units):
            self.known[u] = first + i
        self.white = np.concatenate([self.white, [u[-1:].isspace() for u in units]])
        self._align(found)

    def _align(self, found: list[tuple[np.ndarray, np.ndarray] | None]) -> None:
        none = np.zeros(0, np.int64)
        a_of, b_of = [x[0] if x else none for x in found], [x[1] if x else none for x in found]
        a, b = np.concatenate([none, *a_of]), np.concatenate([none, *b_of])
        n = len(found)
        a_cut, b_cut = (np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64) for own in (a_of, b_of))
        a_length, b_length = self.a_length[a], self.b_length[b]
        links = product(token_bytes(a_length), bytes_token(b_length))
        # Groups: bytes up to where tokens of both end. Units end with both.
        a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
        joint = np.intersect1d(a_end, b_end)
        a_group, b_group = np.searchsorted(joint, a_end), np.searchsorted(joint, b_end)
        in_a = Csr(np.arange(len(a) + 1), a_group, np.ones(len(a), np.int64))
        of_b = _transposed(Csr(np.arange(len(b) + 1), b_group, np.ones(len(b), np.int64)), len(joint))
        shared = np.concatenate([[0], np.cumsum(row_counts(in_a, of_b))])
        link_cut = links.starts[a_cut]
        group_cut = np.zeros(n + 1, np.int64)
        group_cut[1:] = np.where(a_cut[1:] > 0, a_group[np.maximum(a_cut[1:] - 1, 0)] + 1, 0) if len(a) else 0
        sizes = np.stack([np.diff(a_cut), np.diff(b_cut), np.diff(group_cut), np.diff(link_cut), shared[a_cut[1:]] - shared[a_cut[:-1]]], 1)
        sizes[[i for i, x in enumerate(found) if x is None]] = -1
        # Ids in the order a text of groups has them: those of A, then those of B.
        a_last = np.append(a_group[1:] != a_group[:-1], True) if len(a) else np.zeros(0, bool)
        b_last = np.append(b_group[1:] != b_group[:-1], True) if len(b) else np.zeros(0, bool)
        ends_unit = np.zeros(len(b), bool)
        ends_unit[b_cut[1:][np.diff(b_cut) > 0] - 1] = True
        many_a, many_b = len(self.a_bytes), len(self.b_bytes)
        at_a = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")
        at_b = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        code = np.zeros(len(a) + len(b), np.int64)
        code[at_a] = a + np.where(a_last, many_a, 0)
        code[at_b] = b + 2 * many_a + np.where(ends_unit, 2 * many_b, np.where(b_last, many_b, 0))
        parts = list(map(self.written.__getitem__, code.tolist()))
        cut = (a_cut + b_cut).tolist()
        self.groups += [b"".join(parts[s:e]) for s, e in zip(cut, cut[1:], strict=False)]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.keys = np.concatenate([self.keys, a[links.rows] << 32 | b[links.columns]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + link_cut[1:]])

    def units(self, text: str) -> list[str]:
        return self.cutting.split(" " + text)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and where each text's begin. Empty texts have none."""
        cut: list[list[str]] = []
        for t in texts:
            if not t:
                cut.append([])
            elif not self.cut_at:
                cut.append([" " + t])
            elif "\x00" in t:
                cut.append(self.units(t))
            else:  # every blank and line feed; right unless white space comes before one
                cut.append((" " + t.replace(" ", "\x00 ").replace("\n", "\x00\n")).split("\x00"))
        if len(self.known) > self.most:
            self.clear()
        self._learn_new(cut, not self.cut_at)
        numbers, starts = self._numbers(cut)
        redone = {}
        if self.cut_at:
            doc = np.repeat(np.arange(len(texts)), np.diff(starts))
            last = np.zeros(len(numbers), bool)
            last[starts[1:][np.diff(starts) > 0] - 1] = True
            odd = np.unique(doc[self.white[numbers] & ~last]).tolist()
            redone = {i: self.units(texts[i]) for i in odd}
            self._learn_new(list(redone.values()), False)
            for i, own in redone.items():
                cut[i] = own
            if odd:
                numbers, starts = self._numbers(cut)
                doc = np.repeat(np.arange(len(texts)), np.diff(starts))
            unlike = np.unique(doc[self.sizes[numbers, 0] < 0]).tolist()
            if unlike:  # a unit is not what its tokens say: the text as a whole decides
                for i in unlike:
                    cut[i] = [" " + texts[i]]
                    self.known.pop(cut[i][0], None)
                self._learn_new([cut[i] for i in unlike], True)
                numbers, starts = self._numbers(cut)
                for i in unlike:  # not to be met as a unit of another text
                    self.known.pop(cut[i][0], None)
        return numbers, starts

    def _learn_new(self, cut: list[list[str]], whole: bool) -> None:
        new: set[str] = set()
        for own in cut:
            new.update(own)
        new.difference_update(self.known)
        if new:
            self.learn(sorted(new), whole)

    def _numbers(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(starts[-1])), starts


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in groups of seven bits, lowest first, and the bytes that each takes."""
    lengths = np.maximum(1, sum((values >= 1 << s).astype(np.int64) for s in range(7, 35, 7)) + 1)
    at = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max(initial=1))):
        has = lengths > k
        out[at[has] + k] = (values[has] >> 7 * k & 127) | np.where(lengths[has] > k + 1, 128, 0)
    return out, lengths


def unvarint(data: np.ndarray) -> np.ndarray:
    ends = data < 128
    which = np.cumsum(ends) - ends
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - starts[which] if len(data) else starts
    out = np.zeros(int(ends.sum()), np.int64)
    np.add.at(out, which, (data & 127).astype(np.int64) << 7 * place)
    return out


_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("chunk", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")]
    + [("groups_sha256", pa.string())]
    + [(c, pa.binary()) for c in ("groups", "links", "times", "pairs", "holders")]
)
_DDL = "doc_id long, chunk long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, groups binary, links binary, times binary, pairs binary, holders binary"


class Chunk:
    """Numbers of the id pairs of some documents, and how many of the documents hold each."""

    def __init__(self, number: int):
        self.number, self.characters = number, 0
        self.sorted, self.rank = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.holders = np.zeros(0, np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of distinct sorted keys; new ones get the next."""
        at = np.searchsorted(self.sorted, keys)
        met = at < len(self.sorted)
        met[met] = self.sorted[at[met]] == keys[met]
        new = keys[~met]
        if len(new):
            every = np.concatenate([self.sorted, new])
            rank = np.concatenate([self.rank, len(self.rank) + np.arange(len(new))])
            order = np.argsort(every, kind="stable")
            self.sorted, self.rank = every[order], rank[order]
            self.holders = np.concatenate([self.holders, np.zeros(len(new), np.int64)])
        return self.rank[np.searchsorted(self.sorted, keys)]

    def dictionary(self) -> pa.RecordBatch:
        pairs = np.zeros(len(self.rank), "<i8")
        pairs[self.rank] = self.sorted
        row = {"chunk": self.number, "pairs": pairs.tobytes(), "holders": self.holders.astype("<i8").tobytes()}
        return pa.RecordBatch.from_pylist([row], _ROWS)


def _stretch(pair: Pair, chunk: Chunk, ids: pa.Array, texts: list[str], with_groups: bool) -> pa.RecordBatch:
    numbers, starts = pair.texts(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(starts))
    sizes = np.zeros((n, 5), np.int64)
    own = pair.sizes[numbers]
    for k in range(5):
        sizes[:, k] = np.bincount(doc, own[:, k], n).astype(np.int64)
    void = np.zeros(n, bool)
    void[doc[own[:, 0] < 0]] = True
    sizes[void] = 0
    empty = sizes[:, 0] == 0
    # Distinct pairs of each document, how often it has them, and how many documents have them.
    lengths = np.diff(pair.starts)[numbers]
    keys = pair.keys[_ranges(pair.starts[numbers], lengths)]
    distinct, which = np.unique(keys, return_inverse=True)
    numbered = chunk.numbers(distinct)[which]
    held, times = np.unique(np.repeat(doc, lengths) << 32 | numbered, return_counts=True)
    holder, link = held >> 32, held & 0xFFFFFFFF
    chunk.holders += np.bincount(link, minlength=len(chunk.holders))
    cut = np.searchsorted(holder, np.arange(n + 1))
    steps = np.diff(link, prepend=0)
    begins = cut[:-1][np.diff(cut) > 0]
    steps[begins] = link[begins]

    def blobs(values: np.ndarray) -> pa.Array:
        data, size = varint(values)
        ends = np.concatenate([[0], np.cumsum(size)])[cut]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])

    groups = pair.groups
    numbers, edges = numbers.tolist(), starts.tolist()
    texts_of = [None if empty[i] else b";".join([groups[u] for u in numbers[edges[i] : edges[i + 1]]]) for i in range(n)]
    columns = {
        "doc_id": ids,
        "chunk": np.full(n, chunk.number),
        **{c: sizes[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links", "n_shared"))},
        "groups_sha256": ["" if t is None else hashlib.sha256(t).hexdigest() for t in texts_of],
        "groups": [t or b"" for t in texts_of] if with_groups else pa.nulls(n, pa.binary()),
        "links": blobs(steps),
        "times": blobs(times),
        "pairs": pa.nulls(n, pa.binary()),
        "holders": pa.nulls(n, pa.binary()),
    }
    return pa.RecordBatch.from_pydict({c: columns[c] for c in _ROWS.names}, _ROWS)


def _tokenizer_files(settings: AlignSettings) -> tuple[str, bytes]:
    a, b = settings.a, settings.b
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return f.read(), g.read()


def _rows(documents: DataFrame, settings: AlignSettings, with_groups: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(_tokenizer_files(settings))  # two vocabulary files: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        pair = remembered("pair", (zlib.crc32(shared.value[0].encode()), zlib.crc32(shared.value[1]), settings.units), lambda: Pair(*shared.value, settings.units))
        task = TaskContext.get().partitionId() << 32
        chunk = Chunk(task)
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).tolist()
            start = 0
            while start < len(sizes):
                stop, held = start + 1, sizes[start]
                while stop < len(sizes) and held + sizes[stop] <= settings.characters:
                    held += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                yield _stretch(pair, chunk, part["doc_id"], part["text"].to_pylist(), with_groups)
                chunk.characters += held
                if chunk.characters >= settings.chunk:
                    yield chunk.dictionary()
                    chunk = Chunk(chunk.number + 1)
                start = stop
        if chunk.characters:
            yield chunk.dictionary()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _DDL)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, holders in zip(*(batch[c].to_pylist() for c in ("chunk", "pairs", "holders")), strict=True):
            keys, n = np.frombuffer(pairs, "<i8"), np.frombuffer(holders, "<i8")
            for s in range(0, len(keys), 100_000):
                part = keys[s : s + 100_000]
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(part), chunk), "number": s + np.arange(len(part)), "pair": part, "holders": n[s : s + 100_000]})


def _scored(documents: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of each document of a chunk, by the counts of the chunk's pairs."""
    n = np.zeros(len(counts), np.int64)
    best = np.zeros(len(counts), np.int64)
    n[counts["number"]], best[counts["number"]] = counts["n"], counts["best"]
    out = documents.drop(columns=["chunk", "links", "times"])
    sums, bests = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
    for i, (links, times) in enumerate(zip(documents["links"], documents["times"], strict=True)):
        if links:
            at, often = np.cumsum(unvarint(np.frombuffer(links, np.uint8))), unvarint(np.frombuffer(times, np.uint8))
            sums[i], bests[i] = (n[at] * often).sum(), (best[at] * often).sum()
    return out.assign(n_best=bests, count_sum=sums)


def aligned(documents: DataFrame, settings: AlignSettings | None = None) -> DataFrame:
    """``doc_id, groups``: for each text the groups of a blank and the text in order, each with its two lists of
    ids; in the form ``a1,a2|b1;a3|b2,b3``. Empty, null and unlike texts (see ``counted``) have none."""
    rows = _rows(documents, settings or AlignSettings(), True).filter(F.col("pairs").isNull())
    group = F.transform(
        F.split(F.col("groups").cast("string"), ";"),
        lambda g: F.struct(F.split(F.split_part(g, F.lit("|"), F.lit(1)), ",").cast("array<int>").alias("a"), F.split(F.split_part(g, F.lit("|"), F.lit(2)), ",").cast("array<int>").alias("b")),
    )
    return rows.select("doc_id", F.when(F.length("groups") > 0, group).otherwise(F.array().cast("array<struct<a:array<int>,b:array<int>>>")).alias("groups"))


def counted(documents: DataFrame, settings: AlignSettings | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared``: one row for each row of ``documents``.

    Tokens are those of a blank and the text. Links are the pairs of tokens of A and B that share bytes;
    ``count_sum`` adds over them in how many documents their ids are linked, ``n_best`` counts those where this is the
    most for the id of A, ties included; ``n_shared`` counts shared-group links. A text without tokens has zeros and no digest:
    null, empty, or with tokens whose bytes are not those of a blank and the text (as U+2581 in it
    makes them). Repeated rows count as documents of their own; null doc_ids stay null; other columns are left out.
    """
    rows = write_through(_rows(documents, settings or AlignSettings(), False).drop("groups"), "aligned")
    listed = rows.filter(F.col("pairs").isNotNull()).select("chunk", "pairs", "holders").mapInArrow(_pairs, "chunk long, number long, pair long, holders long")
    # A pair has a row for each chunk that has it.
    counted_pairs = listed.select("chunk", "number", "pair", F.sum("holders").over(W.partitionBy("pair")).alias("n"))
    counted_pairs = write_through(counted_pairs, "linked-ids").withColumn("a", F.shiftright("pair", 32))
    top = counted_pairs.groupBy("a").agg(F.max("n").alias("top"))
    # As many rows as A has ids.
    marked = counted_pairs.join(F.broadcast(top), "a").select("chunk", "number", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    own = rows.filter(F.col("pairs").isNull()).drop("pairs", "holders")

    def score(documents: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        return _scored(documents, counts)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, n_best long, count_sum long"
    # A chunk's documents and pairs: bounded by the characters of a chunk.
    return own.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInPandas(score, schema)
