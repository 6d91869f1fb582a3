"""Toxicity scores from subword embeddings.

A word is a bag of hashed byte n-grams, each with an embedding; the bag's mean goes
into a linear softmax over (clean, toxic). Embeddings and softmax are trained jointly
in numpy, so a misspelling that was never seen shares most vectors with the word it
stands for. Labels belong to documents, and one insult makes a document of 50,000
words toxic; a mean over all words would drown it. So the softmax judges every word
of the whole text and the document takes its worst word. Training finds out which words
of a toxic document carry the label (expectation-maximisation): words of clean documents
are clean, and each toxic document must have at least one toxic word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview.llm.subwords import means, pieces
from opsreview.llm.tables import forget, held_out, release, releasing, stretches, text_of, thinned
from opsreview.session import write_through

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…¿¡"


@dataclass(frozen=True)
class ToxicitySettings:
    """``sample_rows`` bounds the labelled rows that training reads, half of them toxic if
    there are so many; ``cache_words`` bounds what a Python worker remembers."""

    sample_rows: int = 12_000
    buckets: int = 1 << 18
    width: int = 12
    shortest: int = 3
    longest: int = 5
    rounds: int = 3
    steps: int = 30
    threshold: float = 0.3
    cache_words: int = 400_000
    seed: int = 11


@dataclass(frozen=True)
class ToxicityModel:
    """``piece`` is each piece's embedding times the softmax's weight difference, which is all
    that scoring needs, as the mean of products is the product of the mean."""

    settings: ToxicitySettings
    piece: np.ndarray
    bias: float
    slope: float
    offset: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        at, starts = pieces(words, self.settings.shortest, self.settings.longest, self.settings.buckets)
        return means(self.piece[at], starts) + self.bias

    def document_score(self, worst: float | None) -> float:
        if worst is None:
            return 0.0
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * worst + self.offset)))))


def words_of(text: str) -> set[str]:
    return {w for w in (x.strip(_EDGE) for x in set(text.lower().split())) if w}


def _fit_words(settings: ToxicitySettings, at, starts, clean_docs, toxic_of, toxic_doc) -> tuple[np.ndarray, float]:
    """Embeddings and softmax over distinct words. ``clean_docs``: clean documents of each word;
    ``toxic_of``/``toxic_doc``: word and document of each distinct word of toxic documents."""
    n = len(starts)
    draw = np.random.default_rng(settings.seed)
    table = draw.normal(0, 0.1, (settings.buckets, settings.width)).astype(np.float32)
    weight = draw.normal(0, 0.3, settings.width).astype(np.float32)
    bias = -4.0  # a word of which nothing is known is clean
    toxic_docs = np.bincount(toxic_of, minlength=n).astype(float)
    documents = int(toxic_doc.max()) + 1 if len(toxic_doc) else 0
    # The first guess: how much more often the word is in toxic documents than in clean ones.
    logit = np.log(toxic_docs + 0.2) - np.log(clean_docs + 0.2) - 2.0
    sizes = np.diff(np.append(starts, len(at)))
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    share = (1.0 / sizes).astype(np.float32)[owner]
    moment, second, wm, wv, bm, bv, step = np.zeros(settings.buckets), np.zeros(settings.buckets), 0.0, 0.0, 0.0, 0.0, 0
    for _ in range(settings.rounds):
        top = np.full(documents, -np.inf)
        np.maximum.at(top, toxic_doc, logit[toxic_of])
        to_blame = np.exp(np.clip(logit[toxic_of] - top[toxic_doc], -30, 0)) * (1 / (1 + np.exp(-np.clip(top[toxic_doc] + 1, -30, 30))))
        yes = np.bincount(toxic_of, to_blame, n)
        no = clean_docs + 0.1 * np.maximum(toxic_docs - yes, 0)
        yes, no = yes**0.75, no**0.75
        yes *= 0.25 * no.sum() / max(yes.sum(), 1e-9)
        for _ in range(settings.steps):
            step += 1
            logit = np.add.reduceat((table @ weight)[at], starts) / sizes + bias
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            wrong = (no * p - yes * (1 - p)) / no.sum() * 100
            pull = np.bincount(at, wrong.astype(np.float32)[owner] * share, settings.buckets)
            # Adam with one step size for each piece, as its gradient is ``pull`` times the weight; the
            # constant below the fraction keeps pieces that few words speak for from moving far.
            moment = 0.8 * moment + 0.2 * pull
            second = 0.98 * second + 0.02 * pull**2
            scale = moment / (np.sqrt(second / (1 - 0.98**step)) + 2e-3) / (1 - 0.8**step)
            grad_w = (pull @ table) / max(1.0, np.abs(pull).sum())
            table -= (0.25 * scale)[:, None].astype(np.float32) * (weight / (np.linalg.norm(weight) + 1e-9)) + np.float32(1e-4) * table
            wm, wv = 0.8 * wm + 0.2 * grad_w, 0.98 * wv + 0.02 * grad_w**2
            weight -= (0.02 * wm / (np.sqrt(wv) + 1e-6)).astype(np.float32)
            g = float(wrong.sum()) / 100
            bm, bv = 0.8 * bm + 0.2 * g, 0.98 * bv + 0.02 * g * g
            bias -= 0.01 * bm / (math.sqrt(bv) + 1e-6)
        logit = np.add.reduceat((table @ weight)[at], starts) / sizes + bias
    return (table @ weight).astype(np.float32), float(bias)


def _calibrated(worst: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from a document's worst word to its label (weighted Newton steps)."""
    a, b = 1.0, 0.0
    if not len(worst):
        return a, b
    x = np.stack([worst, np.ones(len(worst))], 1)
    mean = np.array([1.0, 0.0])
    theta = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + 0.05 * (theta - mean)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return max(0.05, float(theta[0])), float(theta[1])


def fit(documents: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None) -> ToxicityModel:
    """Learn from the labelled documents outside the held-out fold.

    A label is read once per id (the highest of repeated rows); null labels, and labels
    without a document, are left out. With labels of one kind only, or none, every
    document gets the share of toxic labels (0 without labels).
    """
    settings = settings or ToxicitySettings()
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = write_through(known, "toxic-labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = settings.sample_rows // 2
    take = {1: max(half, settings.sample_rows - counts.get(0, 0)), 0: max(half, settings.sample_rows - counts.get(1, 0))}
    parts = [thinned(known.filter(F.col("toxic") == x), "doc_id", take[x], counts.get(x, 0), settings.seed) for x in (0, 1)]
    # At most about sample_rows ids, whatever the input: small enough for every task.
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = (
        documents.select("doc_id", text_of().alias("text"))
        .join(sample, "doc_id")
        .select("toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + 1)), F.lit(5)) == 0).alias("spare"), F.xxhash64("doc_id").alias("turn"))
    )
    lists = write_through(rows.mapInPandas(_word_lists, "toxic int, spare boolean, turn long, words string"), "toxic-sample")
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    # The sample is bounded, so one task can hold it; the driver gets the finished weights only.
    fitted = lists.repartition(1).mapInPandas(_training(settings, rate), "piece binary, bias double, slope double, offset double").collect()
    if not fitted:
        return ToxicityModel(settings, np.zeros(settings.buckets, np.float32), 0.0, 0.0, math.log((rate + 1e-9) / (1 - rate + 1e-9)))
    return ToxicityModel(settings, np.frombuffer(fitted[0]["piece"], np.float32), fitted[0]["bias"], fitted[0]["slope"], fitted[0]["offset"])


def _training(settings: ToxicitySettings, rate: float):
    @releasing
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        ids: dict[str, int] = {}
        clean_words, toxic_words, toxic_docs, spare_rows = [], [], [], []
        rows = sorted(x for batch in batches for x in zip(batch["turn"], batch["toxic"], batch["spare"], batch["words"], strict=True))
        for _, toxic, spare, words in rows:
            own = words.split("\n") if words else []
            if spare:
                spare_rows.append((toxic, own))
            elif own:
                at = np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int32, len(own))
                if toxic:
                    toxic_docs.append(np.full(len(at), len(toxic_words), np.int32))
                    toxic_words.append(at)
                else:
                    clean_words.append(at)
        del rows
        if not toxic_words or not clean_words:
            return
        at, starts = pieces(list(ids), settings.shortest, settings.longest, settings.buckets)
        clean = np.bincount(np.concatenate(clean_words), minlength=len(ids)).astype(float)
        piece, bias = _fit_words(settings, at, starts, clean, np.concatenate(toxic_words), np.concatenate(toxic_docs))
        model = ToxicityModel(settings, piece, bias, 1.0, 0.0)
        # The curve is fitted on documents whose words were not trained on, weighted to the true share of toxic ones.
        worst = np.array([model.word_logits(w).max() for _, w in spare_rows if w])
        truth = np.array([float(x) for x, w in spare_rows if w])
        share = truth.mean() if len(truth) else 0.0
        slope, offset = 1.0, 0.0
        if 0 < share < 1:
            slope, offset = _calibrated(worst, truth, np.where(truth == 1, rate / share, (1 - rate) / (1 - share)))
        yield pd.DataFrame({"piece": [piece.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    return train


@releasing
def _word_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget()
    for batch in batches:
        for start, end in stretches(batch["text"].tolist()):
            own = batch.iloc[start:end]
            yield pd.DataFrame({"toxic": own["toxic"], "spare": own["spare"], "turn": own["turn"], "words": ["\n".join(sorted(words_of(t))) for t in own["text"]]})


def score(text: Column, model: ToxicityModel) -> Column:
    """Score of each whole text, 0 to 1; 0 for a null text or one without words."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        known: dict[str, float] = {}
        for batch in batches:
            found: list[float] = []
            for start, end in stretches(batch):
                sets = [set(t.lower().split()) for t in batch[start:end]]
                everything = set().union(*sets)
                if len(known) + len(everything) > model.settings.cache_words:
                    known.clear()
                new = [w for w in everything if w not in known]
                bare = [w.strip(_EDGE) for w in new]
                logits = model.word_logits(bare) if new else []
                known.update((w, float(x) if b else -math.inf) for w, b, x in zip(new, bare, logits, strict=True))
                worst = [max(map(known.__getitem__, s), default=-math.inf) for s in sets]
                found += [model.document_score(None if w == -math.inf else w) for w in worst]
            yield pd.Series(found, dtype="float64")
        known.clear()
        release()

    return scored(text)


def scored(documents: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None) -> DataFrame:
    """All columns of ``documents`` and ``toxicity``: one row for each row, repeated ones too."""
    model = fit(documents, labels, settings)
    return documents.withColumn("toxicity", score(text_of(), model))


def without_toxic(documents: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None) -> DataFrame:
    """The rows that score below the threshold."""
    settings = settings or ToxicitySettings()
    rows = documents.select(F.struct("*").alias("row"), text_of().alias("text"))  # own columns of any name stay apart
    return rows.filter(score(F.col("text"), fit(documents, labels, settings)) < settings.threshold).select("row.*")
