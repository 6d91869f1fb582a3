"""Quality scores by co-training two views of a document.

One view is the text: its words and their shapes (``Ab``, ``ab$$$``, ``AB!!``) and how often a word
follows itself. The other is the page's metadata: source, language, length, lines, and shares
of letters, digits, capitals and distinct words. A classifier of each view learns from the labels. Then,
round by round, each one labels the unlabelled pages it is surest of and gives them to the other,
which learns again. In the end both are calibrated together on labelled pages that neither
has learnt from, and score every document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.llm.tables import forget, held_out, stretches, text_of, thinned
from opsreview.session import write_through

WORDS, SHAPES, META = 1 << 16, 1 << 12, 1 << 12
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class QualitySettings:
    """``sample_rows`` bounds the labelled rows and, once more, the unlabelled rows that are learnt from."""

    sample_rows: int = 6_000
    rounds: int = 3
    confident: float = 0.9
    given: float = 0.1
    steps: int = 60
    cache_words: int = 300_000
    seed: int = 13


def shape(word: str) -> str:
    """Letters become ``a`` or ``A``, digits ``0``; runs are squeezed to two."""
    out: list[str] = []
    for c in word[:40]:
        s = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if out[-2:] != [s, s]:
            out.append(s)
    return "".join(out)


def word_places(word: str) -> tuple[int, int]:
    """Places of the word and its shape in the text view's weights."""
    return zlib.crc32(word.lower().strip(_EDGE).encode("utf-8", "replace")) % WORDS, WORDS + zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES


def meta_places(text: str, words: list[str], source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    n = max(1, len(text))
    share = lambda k, of: f"{10 * k / max(1, of):.0f}"
    letters = sum(map(str.isalpha, text))
    facts = {
        "source": source,
        "lang": lang,
        "chars": None if n_chars is None else int(math.log2(max(0, n_chars) + 1)),
        "lines": int(math.log2(text.count("\n") + 1)),
        "letters": share(letters + sum(map(str.isspace, text)), n),
        "capitals": share(sum(map(str.isupper, text)), letters),
        "digits": share(sum(map(str.isdigit, text)), n),
        "distinct": share(len(set(words)), len(words)) + f"/{int(math.log2(len(words) + 1))}",
    }
    return [zlib.crc32(f"{k}={v}".encode("utf-8", "replace")) % META for k, v in facts.items()]


_INPUT = ("source", "lang", "n_chars")


def _rows(documents: DataFrame) -> DataFrame:
    """The columns that the views read; a missing one counts as null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    have = set(documents.columns)
    meta = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), text_of().alias("text"), *meta)


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            words = row.text.split()
            places: Counter = Counter()
            for w, k in Counter(words).items():
                a, b = word_places(w)
                places[a] += k
                places[b] += k
            places[WORDS + SHAPES] = sum(a == b for a, b in zip(words, words[1:], strict=False))
            at, n = np.fromiter(places.keys(), np.int32, len(places)), np.fromiter(places.values(), np.float32, len(places))
            meta = np.array(meta_places(row.text, words, row.source, row.lang, _number(row.n_chars)), np.int32)
            out.append((row.label, row.spare, row.turn, at.tobytes(), (n / max(1, len(words))).astype(np.float32).tobytes(), meta.tobytes()))
        yield pd.DataFrame(out, columns=["label", "spare", "turn", "at", "share", "meta"])


class _View:
    """Logistic regression over sparse rows, full batches, Adagrad."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], width: int, steps: int):
        self.row = np.repeat(np.arange(len(lists)), [len(a) for a, _ in lists])
        self.at = np.concatenate([a for a, _ in lists])
        self.value = np.concatenate([v for _, v in lists])
        self.n, self.width, self.steps = len(lists), width, steps
        self.weight, self.bias = np.zeros(width), 0.0

    def logits(self) -> np.ndarray:
        return np.bincount(self.row, self.weight[self.at] * self.value, self.n) + self.bias

    def learn(self, target: np.ndarray, importance: np.ndarray) -> None:
        self.weight, self.bias = np.zeros(self.width), 0.0
        squares, square = np.full(self.width, 1e-8), 1e-8
        importance = importance / max(importance.sum(), 1e-9)
        for _ in range(self.steps):
            wrong = importance * (1 / (1 + np.exp(-np.clip(self.logits(), -30, 30))) - target)
            pull = np.bincount(self.at, wrong[self.row] * self.value, self.width) + 1e-7 * self.weight
            squares += pull**2
            self.weight -= 0.7 * pull / np.sqrt(squares)
            square += wrong.sum() ** 2
            self.bias -= 0.3 * wrong.sum() / math.sqrt(square)


def _co_training(settings: QualitySettings):
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        rows = sorted((x for b in batches for x in zip(b["turn"], b["label"], b["spare"], b["at"], b["share"], b["meta"], strict=True)), key=lambda x: (x[0], x[1], x[3]))
        label = np.array([x[1] for x in rows])
        spare = np.array([x[2] for x in rows], bool) & (label >= 0)
        learnt = (label >= 0) & ~spare
        if len(set(label[learnt])) < 2 or len(set(label[spare])) < 2:
            return
        views = (
            _View([(np.frombuffer(x[3], np.int32), np.frombuffer(x[4], np.float32)) for x in rows], WORDS + SHAPES + 1, settings.steps),
            _View([((m := np.frombuffer(x[5], np.int32)), np.ones(len(m))) for x in rows], META, settings.steps),
        )
        del rows
        pool = label < 0
        targets = [np.where(label > 0, 1.0, 0.0) for _ in views]
        weights = [np.where(learnt, 1.0, 0.0) for _ in views]
        for step in range(settings.rounds + 1):
            for view, target, weight in zip(views, targets, weights, strict=True):
                view.learn(target, weight)
            if step == settings.rounds:
                break
            for giver, target, weight in ((views[0], targets[1], weights[1]), (views[1], targets[0], weights[0])):
                p = 1 / (1 + np.exp(-np.clip(giver.logits(), -30, 30)))
                open_ = np.flatnonzero(pool & (weight == 0))
                most = int(settings.given * len(open_))
                order = open_[np.argsort(p[open_], kind="stable")]
                low, high = order[:most], order[len(order) - most :]
                for chosen, value in ((low[p[low] <= 1 - settings.confident], 0.0), (high[p[high] >= settings.confident], 1.0)):
                    target[chosen], weight[chosen] = value, 0.5
        logits = np.stack([np.clip(v.logits(), -12, 12) for v in views] + [np.ones(len(label))], 1)
        curves = []
        for use in ((0, 2), (1, 2), (0, 1, 2)):
            x, y = logits[spare][:, use], label[spare].astype(float)
            theta = np.array([0.5] * (len(use) - 1) + [0.0])
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
                theta -= np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(use)), x.T @ (p - y) + 0.3 * theta), -1, 1)
            curves += theta.tolist()
        yield pd.DataFrame({"text": [views[0].weight.astype(np.float32).tobytes()], "meta": [views[1].weight.astype(np.float32).tobytes()], "rest": [[views[0].bias, views[1].bias, *curves]]})

    return train


def fit(documents: DataFrame, labels: DataFrame, settings: QualitySettings | None = None):
    """Weights of both views and the calibration, or the share of good labels if there are too few of either kind."""
    settings = settings or QualitySettings()
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    known = write_through(known, "quality-labels")
    count, good = known.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.5))).first()
    sample = F.broadcast(thinned(known, "doc_id", settings.sample_rows, count, settings.seed))  # about sample_rows ids at most
    rows = _rows(documents).filter("known")
    marks = [(F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + 1)), F.lit(4)) == 0).alias("spare"), F.xxhash64("doc_id").alias("turn")]
    labelled = rows.join(sample, "doc_id").select("label", *marks, "text", *_INPUT)
    pool = thinned(rows, "doc_id", settings.sample_rows, documents.count(), settings.seed + 2)
    pool = pool.join(known.select("doc_id"), "doc_id", "left_anti")  # rows kept for calibration must not come back unlabelled
    pool = pool.select(F.lit(-1).alias("label"), *marks, "text", *_INPUT)
    features = labelled.unionByName(pool).mapInPandas(_featured, "label int, spare boolean, turn long, at binary, share binary, meta binary")
    features = write_through(features, "quality-sample")
    # Bounded above, so one task can hold it.
    got = features.repartition(1).mapInPandas(_co_training(settings), "text binary, meta binary, rest array<double>").collect()
    if not got:
        return None, None, None, float(good)
    return np.frombuffer(got[0]["text"], np.float32), np.frombuffer(got[0]["meta"], np.float32), list(got[0]["rest"]), float(good)


def _scoring(text_weight: np.ndarray, meta_weight: np.ndarray, rest: list[float], most: int):
    text_bias, meta_bias, a, a0, b, b0, c, d, c0 = rest
    curve = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for batch in batches:
            for start, stop in stretches(batch["text"].tolist()):
                part, out = batch.iloc[start:stop], []
                for row in part.itertuples(index=False):
                    words = row.text.split()
                    if len(cache) > most:
                        cache.clear()
                    for w in set(words):
                        if w not in cache:
                            p, q = word_places(w)
                            cache[w] = float(text_weight[p] + text_weight[q])
                    again = sum(map(str.__eq__, words, words[1:]))
                    x = (sum(map(cache.__getitem__, words)) + again * float(text_weight[WORDS + SHAPES])) / max(1, len(words)) + text_bias
                    y = float(meta_weight[meta_places(row.text, words, row.source, row.lang, _number(row.n_chars))].sum()) + meta_bias
                    x, y = max(-12.0, min(12.0, x)), max(-12.0, min(12.0, y))
                    out.append((row.doc_id, row.known, curve(c * x + d * y + c0), curve(a * x + a0), curve(b * y + b0)))
                yield pd.DataFrame(out, columns=["doc_id", "known", "score", "text_score", "page_score"])

    return score


def scored(documents: DataFrame, labels: DataFrame, settings: QualitySettings | None = None) -> DataFrame:
    """``doc_id, score, text_score, page_score`` (0 to 1, higher is better) for each row of ``documents``,
    repeated ones too. A null text counts as empty; null metadata is a value of its own. With too few
    labels of either kind every row gets the share of good labels (0.5 without labels)."""
    settings = settings or QualitySettings()
    text_weight, meta_weight, rest, good = fit(documents, labels, settings)
    rows = _rows(documents)
    real = F.when(F.col("known"), F.col("doc_id")).alias("doc_id")
    if rest is None:
        return rows.select(real, *[F.lit(good).alias(c) for c in ("score", "text_score", "page_score")])
    found = rows.mapInPandas(_scoring(text_weight, meta_weight, rest, settings.cache_words), "doc_id long, known boolean, score double, text_score double, page_score double")
    return found.select(real, "score", "text_score", "page_score")
