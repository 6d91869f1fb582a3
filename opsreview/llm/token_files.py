"""Token ids written as canonical Huffman codes, and read back.

The code is built from the counts of all ids, limited in length so that one table lookup
decodes a symbol. A file is a table of independent blocks in document order. A block holds
whole documents: their ids and lengths, the packed bits, and the bit offset of every
256th id. Any block can be decoded by itself, and inside a block decoding starts at all
checkpoints at once, one symbol of each per step.

The files lie beside their code table: ``<path>/blocks`` and ``<path>/code``.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.llm.tables import partitions, releasing, remembered, stretches, text_of
from opsreview.session import shared_folder, write_through

CHECKPOINT = 256


@dataclass(frozen=True)
class TokenSettings:
    """``tokenizer``: path of a ``tokenizers`` file, read on the driver (null: the public byte-level one);
    ``longest_code``: bits of the longest code; ``block_ids``: a block is closed after so many ids;
    ``cache_words``: what a Python worker remembers, at about 50 bytes each."""

    tokenizer: str | None = None
    end_id: int = 2
    longest_code: int = 16
    block_ids: int = 1 << 17
    cache_words: int = 900_000


def _tokenizer_json(settings: TokenSettings) -> str:
    path = settings.tokenizer
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: The pattern cuts a run of these off a word of letters as one piece.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all entries of stretches one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class WordCache:
    """Ids of text pieces, as one array of ids with a list of the pieces in Arrow form, which takes few bytes a piece.

    A byte-level tokenizer never joins across a single blank or line break between two other
    characters, so texts are cut there and each piece is tokenized once. ``wordwise`` says whether the
    tokenizer is of that kind. Texts are tokenized whole that have white space beside a blank or line
    break, or a special token: they have a piece that is ``odd``.

    A piece stands for itself behind a blank, behind a zero byte if there is no blank before it. Of Latin letters
    and then ASCII punctuation, it is two pieces of the tokenizer's pattern: the letters go to the tokenizer's
    model, where that is ``plain``, without its pattern.
    """

    def __init__(self, json_text: str, most: int):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        spec = json.loads(json_text)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.wordwise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        self.plain = self.wordwise and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.plain = self.plain and not any(x.strip()[:1].isalpha() for x in special)  # such are found inside words
        self.is_odd = re.compile("|".join([r"^ ?\s+$", r"^ ?[^\S ]", r"\s$", *map(re.escape, special)])).search
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.starts_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts_word[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable characters stand for bytes, others follow from U+0100
        self.byte_letters = {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))} | {0: 0}  # the mark stays
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.odd = np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.words)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of each of ``stems``, which are Latin letters: behind a blank, or behind a zero byte if there is no blank."""
        tokenize = self.tokenizer.model.tokenize
        flat: list[int] = []
        ends = []
        for s in stems:
            spelled = s if s.isascii() else s.encode().decode("latin-1").translate(self.byte_letters)
            flat += [t.id for t in tokenize("Ġ" + spelled if spelled[0] != "\x00" else spelled[1:])]
            ends.append(4 * len(flat))
        data = np.array(flat, "<u4").tobytes()
        return {s: data[a:b] for s, a, b in zip(stems, [0, *ends], ends, strict=False)}

    def _of_units(self, units: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        after_blank = [w for w in units if w[0] == " " and len(w) > 1]
        # Units that begin with a blank are tokenized in one go and cut before each id that begins with one.
        for i in range(0, len(after_blank), 2_000):
            part = after_blank[i : i + 2_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.starts_word[ids])
            if len(cut) == len(part):
                data, ends = ids.tobytes(), [*(cut[1:] * 4).tolist(), len(ids) * 4]
                found.update((w, data[a:b]) for w, a, b in zip(part, (cut * 4).tolist(), ends, strict=True))
            else:
                found.update(zip(part, self.whole(part), strict=True))
        others = [w for w in units if w not in found]
        found.update(zip(others, self.whole(others), strict=True))
        return found

    def _ids_of(self, pieces: list[str]) -> tuple[list[bytes], list[bool]]:
        cut: list[tuple[str, str] | str] = []
        for p in pieces:
            stem = p.rstrip(_PUNCTUATION) if self.plain else ""
            letters = stem[1:] if stem[:1] == "\x00" else stem
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
                cut.append((stem, p[len(stem) :]))
            else:
                cut.append(p[1:] if p[:1] == "\x00" else p if p == "\n" else " " + p)
        stems = self._of_letters([*dict.fromkeys(x[0] for x in cut if type(x) is tuple)])
        units = [*{x for x in cut if type(x) is str and x}]
        # A suffix that is odd with nothing before it can be so in any text, too.
        tails = [*{x[1] for x in cut if type(x) is tuple and x[1]}]
        others = dict(zip(tails, self.whole(tails), strict=True)) | self._of_units(units) | {"": b""}
        odd = {w for w in [*units, *tails] if w != "\n" and self.is_odd(w)}
        out = [others[x] if type(x) is str else stems[x[0]] + others[x[1]] if x[1] else stems[x[0]] for x in cut]
        return out, [(x if type(x) is str else x[1]) in odd for x in cut] if odd else [False] * len(cut)

    def numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """Numbers of distinct pieces; new ones are tokenized."""
        met = pc.index_in(pieces, value_set=self.words)
        new = pieces.filter(pc.is_null(met))
        if not len(new):
            return met.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self) and len(self) + len(new) > self.most:  # common pieces are among those just met
            kept = np.sort(pc.drop_null(met).to_numpy(zero_copy_only=False))
            self.words = self.words.take(pa.array(kept))
            at = _ranges(self.starts[kept], self.lengths[kept])
            self.ids, self.lengths, self.odd = self.ids[at], self.lengths[kept], self.odd[kept]
            self.starts = np.cumsum(self.lengths) - self.lengths
            met = pc.index_in(pieces, value_set=self.words)
        numbers = pc.fill_null(met, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        order = pc.sort_indices(new)  # a word and the same with a suffix come together
        numbers[np.flatnonzero(numbers < 0)[order.to_numpy()]] = len(self.words) + np.arange(len(new))
        new = new.take(order)
        lengths, ids, odd = [self.lengths], [self.ids], [self.odd]
        for i in range(0, len(new), 50_000):  # Python objects weigh many times the pieces
            found, own_odd = self._ids_of(new.slice(i, 50_000).to_numpy(zero_copy_only=False).tolist())
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
            ids.append(np.frombuffer(b"".join(found), "<u4"))
            odd.append(np.array(own_odd, bool))
        self.words = pa.concat_arrays([self.words, new])
        self.lengths, self.ids, self.odd = np.concatenate(lengths), np.concatenate(ids), np.concatenate(odd)
        self.starts = np.cumsum(self.lengths) - self.lengths
        return numbers

    def encode(self, texts: list[str] | pa.StringArray, most: int = 1 << 20) -> list[bytes]:
        """Ids of each text; ``most`` pieces are put together at once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        n = len(texts)
        if not n:
            return []
        whole = np.ones(n, bool)
        out: list[bytes] = [b""] * n
        if self.wordwise:
            whole = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False).copy()
            marked = pc.binary_join_element_wise("\x00", pc.replace_substring(texts, "\n", " \n \x00"), "")
            cut = pc.split_pattern(marked, " ")
            starts = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
            coded = cut.flatten().dictionary_encode()
            at = self.numbers(coded.dictionary)
            codes = coded.indices.to_numpy()
            # An empty piece inside a text comes from white space beside a line break.
            bare = pc.index(coded.dictionary, "\x00").as_py()
            odd = self.odd[at]
            strange = odd[codes]
            if bare >= 0:
                inside = codes == bare
                inside[starts[:-1]] = False
                inside[starts[1:] - 1] = False
                strange |= inside
            whole |= np.add.reduceat(strange, starts[:-1]) > 0
            for a, b in self._parts(starts, most):
                own = at[codes[starts[a] : starts[b]]]
                lengths = self.lengths[own]
                data = self.ids[_ranges(self.starts[own], lengths)].tobytes()
                ends = (4 * np.concatenate([[0], np.cumsum(lengths)])[starts[a : b + 1] - starts[a]]).tolist()
                out[a:b] = [data[s:e] for s, e in zip(ends, ends[1:], strict=False)]
        rest = np.flatnonzero(whole).tolist()
        for i, ids in zip(rest, self.whole(texts.take(pa.array(rest, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        return out

    @staticmethod
    def _parts(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        a, n = 0, len(starts) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
            yield a, b
            a = b


def id_type(json_text: str, end_id: int) -> str:
    """Two bytes for each id if all of them fit, else four."""
    from tokenizers import Tokenizer

    top = max([end_id, *Tokenizer.from_str(json_text).get_vocab().values()])
    return "<u2" if top < 1 << 16 else "<u4"


def _stretches(texts: pa.StringArray, size: int) -> Iterator[tuple[int, int]]:
    """Cut a batch where about so many bytes have come together. A longer text is a stretch of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop
        start = stop


def tokenized(documents: DataFrame, settings: TokenSettings, kind: str = "<u4") -> DataFrame:
    """``doc_id, known, n_tokens, ids``: little-endian ids, of the numpy type ``kind``, of each whole text and the end id; null counts as empty."""
    json_text, end = _tokenizer_json(settings), np.array([settings.end_id], "<u4").tobytes()
    shared = documents.sparkSession.sparkContext.broadcast(json_text)  # the vocabulary file: a few MB
    most = settings.cache_words

    @releasing
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = remembered("tokens", (zlib.crc32(shared.value.encode()), most), lambda: WordCache(shared.value, most))
        for batch in batches:
            for start, stop in _stretches(batch["text"], 8_000_000):
                own = batch.slice(start, stop - start)
                ids = [np.frombuffer(x + end, "<u4").astype(kind) for x in cache.encode(own["text"])]
                columns = {"doc_id": own["doc_id"], "known": own["known"], "n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    known = F.col("doc_id").isNotNull().alias("known")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), known, text_of().alias("text"))
    rows = rows.mapInArrow(encode, "doc_id long, known boolean, n_tokens long, ids binary")
    return rows.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id")))


def _counting(kind: str):
    @releasing
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for start, stop in stretches(batch["ids"].tolist(), 8_000_000):
                own = np.bincount(np.frombuffer(b"".join(batch["ids"].iloc[start:stop]), kind))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    return count


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Lengths of an optimal prefix code with no length above ``longest`` (package-merge)."""
    n = len(counts)
    if n <= 1:
        return [1] * n
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes longer than {longest} bits")
    leaves = sorted((c, (i,)) for i, c in enumerate(counts))
    # Unlimited Huffman first: mostly it is short enough.
    heap = [(c, k, None) for k, (c, _) in enumerate(leaves)]
    parent: dict[int, int] = {}
    heapq.heapify(heap)
    following = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = following
        heapq.heappush(heap, (a[0] + b[0], following, None))
        following += 1
    depth = [0] * following
    for k in range(following - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    lengths = [0] * n
    for k, (_, (i,)) in enumerate(leaves):
        lengths[i] = depth[k]
    if max(lengths) <= longest:
        return lengths
    # Package-merge on weights only: each level keeps how many leaves precede a package.
    weights = np.array([c for c, _ in leaves], dtype=np.float64)
    levels: list[np.ndarray] = []  # per level: True where the merged item is a leaf
    items, is_leaf = weights, np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(longest - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        items, is_leaf = merged[order], order < n
        levels.append(is_leaf)
    taken, total = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        total[:own] += 1
        taken = 2 * (taken - own)
    for k, (_, (i,)) in enumerate(leaves):
        lengths[i] = int(total[k])
    return lengths


@dataclass(frozen=True)
class Code:
    """Canonical code: ids in order of (length, id) get consecutive codes."""

    ids: np.ndarray
    lengths: np.ndarray

    def codes(self) -> np.ndarray:
        out, code, before = np.zeros(len(self.ids), np.int64), 0, int(self.lengths[0]) if len(self.ids) else 0
        for k, length in enumerate(self.lengths.tolist()):
            code <<= length - before
            out[k], before, code = code, length, code + 1
        return out

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        top = int(self.ids.max(initial=-1)) + 1
        code, length = np.zeros(top, np.int64), np.zeros(top, np.int64)
        code[self.ids], length[self.ids] = self.codes(), self.lengths
        return code, length

    def decoding(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Id and length by the next ``width`` bits."""
        width = int(self.lengths.max(initial=1))
        spans = np.left_shift(1, width - self.lengths)
        fill = (1 << width) - int(spans.sum())  # open only where there is a single id
        pad = (0, fill)
        return np.pad(np.repeat(self.ids, spans), pad).astype(np.uint32), np.pad(np.repeat(self.lengths, spans), pad, constant_values=1).astype(np.int64), width


def canonical(counts: list[tuple[int, int]], longest: int) -> Code:
    counts = sorted(counts)
    lengths = code_lengths([n for _, n in counts], longest)
    order = sorted((length, i) for length, (i, _) in zip(lengths, counts, strict=True))
    return Code(np.array([i for _, i in order], np.int64), np.array([x for x, _ in order], np.int64))


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after the other, and the bit offset of every ``CHECKPOINT``-th id."""
    bits = length[ids]
    ends = np.cumsum(bits)
    at = ends - bits
    n = (int(ends[-1]) + 31) // 32 + 1 if len(ids) else 1
    value = code[ids].astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)  # at most 31 + 20 bits
    word, low = at >> 5, value & np.uint64(0xFFFFFFFF)
    # Codes share 32-bit words but not bits, so adding is joining; sums stay below 2^32, exact in doubles.
    out = np.bincount(word, value >> np.uint64(32), n)
    over = np.flatnonzero(low)
    out += np.bincount(word[over] + 1, low[over], n)
    return out.astype(">u4").tobytes(), at[::CHECKPOINT].copy()


def unpack(data: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    raw = np.pad(raw, (0, 4))
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    lanes = len(checkpoints)
    out = np.zeros((CHECKPOINT, lanes), np.uint32)
    at, last, mask = checkpoints.astype(np.int64).copy(), len(words) - 1, (1 << width) - 1
    for k in range(min(CHECKPOINT, n)):
        if k == n - (lanes - 1) * CHECKPOINT:  # the last stretch may be shorter
            at = at[: lanes - 1]
            if not len(at):
                break
        here = (words[np.minimum(at >> 3, last)] >> (32 - width - (at & 7))) & mask
        out[k, : len(at)] = table[here]
        at += lengths[here]
    return out.T.reshape(-1)[:n]


_BLOCK = "part int, block long, doc_ids binary, known binary, n_ids binary, checkpoints binary, bits binary"


def write(documents: DataFrame, path: str, settings: TokenSettings | None = None) -> None:
    """Tokenize ``documents`` and write the files below ``path``, in ascending doc_id order, null ids first.
    Rows with equal ids are all written, ordered by the hash of their token ids."""
    settings = settings or TokenSettings()
    spark = documents.sparkSession
    kind = id_type(_tokenizer_json(settings), settings.end_id)
    ids = write_through(tokenized(documents, settings, kind).withColumn("tie", F.xxhash64("ids")), "token-ids")
    counts = ids.select("ids").mapInPandas(_counting(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has ids.
    code = canonical([(r["id"], r["n"]) for r in counts.collect()], settings.longest_code)
    spark.createDataFrame(
        pd.DataFrame({"rank": np.arange(len(code.ids)), "id": code.ids, "bits": code.lengths}), "rank long, id long, bits long"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    most, each = settings.block_ids, np.dtype(kind).itemsize

    @releasing
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, lengths = code.encoding()
        held: list[tuple[int, int, bool, bytes]] = []
        size = number = 0

        def closed() -> pd.DataFrame:
            every = np.frombuffer(b"".join(x[3] for x in held), kind)
            bits, at = pack(every, codes, lengths)
            doc, known = np.array([x[1] for x in held], "<i8"), np.array([x[2] for x in held], "u1")
            n = np.array([len(x[3]) // each for x in held], "<i8")
            return pd.DataFrame(
                {"part": [held[0][0]], "block": [number], "doc_ids": [doc.tobytes()], "known": [known.tobytes()], "n_ids": [n.tobytes()], "checkpoints": [at.astype("<i8").tobytes()], "bits": [bits]}
            )

        for batch in batches:
            for row in zip(batch["part"], batch["doc_id"], batch["known"], batch["ids"], strict=True):
                held.append(row)
                size += len(row[3]) // each
                if size >= most:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = ids.select("doc_id", "tie", "ids").repartitionByRange(partitions(documents), *order).sortWithinPartitions(*order)
    ranged.select(F.spark_partition_id().alias("part"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "ids").mapInPandas(blocks, _BLOCK).write.mode("overwrite").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in the files."""
    rows = spark.read.parquet(f"{path}/code").orderBy("rank").collect()  # the code table: a row per id
    code = Code(np.array([r["id"] for r in rows], np.int64), np.array([r["bits"] for r in rows], np.int64))

    @releasing
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, lengths, width = code.decoding()
        for batch in batches:
            for block in batch.itertuples():
                n = np.frombuffer(block.n_ids, "<i8")
                ids = unpack(block.bits, np.frombuffer(block.checkpoints, "<i8"), int(n.sum()), table, lengths, width).astype("<u4")
                ends = np.cumsum(n)
                data = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                known, doc = np.frombuffer(block.known, "u1").astype(bool), np.frombuffer(block.doc_ids, "<i8")
                yield pd.DataFrame(
                    {"part": block.part, "block": block.block, "inside": ends - n, "doc_id": doc, "known": known, "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in data], "ids": data}
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    # Lengths of the blocks give where each begins; a partition's blocks and then the partitions are summed up.
    lengths = blocks.select("part", "block", "n_ids").mapInPandas(_block_sizes, "part int, block long, size long")
    lengths = write_through(lengths, "block-sizes")
    within = F.coalesce(F.sum("size").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = lengths.groupBy("part").agg(F.sum("size").alias("size"))  # a row per partition
    before = before.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = lengths.withColumn("within", within).join(before, "part").select("part", "block", (F.col("within") + F.col("before")).alias("block_start"))
    decoded = blocks.mapInPandas(decode, "part int, block long, inside long, doc_id long, known boolean, n_tokens long, ids_crc32 long, ids binary")
    starts = write_through(starts, "block-starts")
    met = decoded.join(starts, ["part", "block"])
    return met.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


def _block_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"part": batch["part"], "block": batch["block"], "size": [int(np.frombuffer(x, "<i8").sum()) for x in batch["n_ids"]]})


def written_and_read(documents: DataFrame, settings: TokenSettings | None = None, path: str | None = None) -> DataFrame:
    """Write the files and read them back. Without a path they go to the shared folder."""
    import uuid

    spark = documents.sparkSession
    path = path or f"{shared_folder(spark)}/opsreview-{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    write(documents, path, settings)
    return read(spark, path)
