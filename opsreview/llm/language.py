"""Language of a text, with spans of mixed-language texts.

The script of a word narrows the candidate languages. A word's score in each candidate comes from its
byte n-grams (naive Bayes over hashed n-grams). Viterbi then labels the words: changing the
language between two words costs a penalty, so only a stretch with enough evidence becomes a
span of its own. The language with most letters is the text's.

Most texts are in one language. Where no stretch of words speaks against the best language by more than
the penalty, the single span is the Viterbi path, and it is found from running sums alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.llm.subwords import pieces
from opsreview.llm.tables import forget, held_out, stretches, text_of
from opsreview.session import write_through

# First code point of blocks of letters, and the script.
SCRIPT_STARTS = (
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = [x for x, _ in SCRIPT_STARTS]


@dataclass(frozen=True)
class LanguageSettings:
    """``sample_rows`` bounds the labelled texts that are learnt from, in equal shares of the languages as far as they have as many."""

    sample_rows: int = 6_000
    buckets: int = 1 << 17
    shortest: int = 1
    longest: int = 4
    smoothing: float = 0.3
    damping: float = 0.35
    penalty: float = 12.0
    script_share: float = 0.01
    cache_words: int = 250_000
    seed: int = 7


def script_of(word: str) -> str:
    """Script of the first letter; empty without a letter."""
    for c in word:
        if c.isalpha():
            at = bisect_right(_STARTS, ord(c)) - 1
            return SCRIPT_STARTS[at][1] if at >= 0 else "other"
    return ""


@dataclass(frozen=True)
class LanguageModel:
    settings: LanguageSettings
    languages: tuple[str, ...]
    piece: np.ndarray  # bucket by language
    scripts: dict[str, np.ndarray]  # which languages use a script

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, best 0, and its letters; zeros where nothing can be told."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int32, len(words))
        use = np.flatnonzero(letters)
        if not len(use):
            return out, letters
        at, starts = pieces([words[i] for i in use], self.settings.shortest, self.settings.longest, self.settings.buckets)
        own = np.add.reduceat(self.piece[at], starts) * np.float32(self.settings.damping)
        for k, i in enumerate(use):
            allowed = self.scripts.get(script_of(words[i]))
            own[k] = own[k] - 30 * ~allowed if allowed is not None else 0
        out[use] = own - own.max(1, keepdims=True)
        return out, letters


def fit(documents: DataFrame, settings: LanguageSettings | None = None) -> LanguageModel:
    """Learn from texts with a language outside the held-out fold."""
    settings = settings or LanguageSettings()
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    share = settings.sample_rows / max(1, len(counts))
    span = 1 << 30
    odds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(span * min(1.0, share / n)))]) if counts else None
    empty = LanguageModel(settings, (), np.zeros((settings.buckets, 0), np.float32), {})
    if odds is None:
        return empty
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(span)) < odds[F.col("lang")])
    # About sample_rows texts, so one task can count their n-grams.
    sample = write_through(sample.select("lang", "text"), "language-sample")
    languages = tuple(sorted(counts))
    got = sample.repartition(1).mapInPandas(_counting(settings, languages), "piece binary, scripts array<string>").collect()
    if not got:
        return empty
    piece = np.frombuffer(got[0]["piece"], np.float32).reshape(settings.buckets, len(languages))
    scripts = {x.split("\t")[0]: np.array([c == "1" for c in x.split("\t")[1]]) for x in got[0]["scripts"]}
    return LanguageModel(settings, languages, piece, scripts)


def _counting(settings: LanguageSettings, languages: tuple[str, ...]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        words = [Counter() for _ in languages]
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words[languages.index(lang)].update(text.lower().split())
        totals = np.zeros((settings.buckets, len(languages)))
        scripts: dict[str, np.ndarray] = {}
        for k, own in enumerate(words):
            own = {w: n for w, n in own.items() if script_of(w)}
            if not own:
                continue
            at, starts = pieces(list(own), settings.shortest, settings.longest, settings.buckets)
            n = np.fromiter(own.values(), float, len(own))
            totals[:, k] = np.bincount(at, np.repeat(n, np.diff(np.append(starts, len(at)))), settings.buckets)
            for w, m in own.items():
                scripts.setdefault(script_of(w), np.zeros(len(languages)))[k] += m
        every = np.maximum(1, sum(scripts.values(), np.zeros(len(languages))))
        likely = np.log(totals + settings.smoothing) - np.log(totals.sum(0) + settings.smoothing * settings.buckets)
        likely = (likely - likely.max(1, keepdims=True)).astype(np.float32)
        used = {s: n / every >= settings.script_share for s, n in scripts.items()}
        yield pd.DataFrame({"piece": [likely.tobytes()], "scripts": [[f"{s}\t{''.join('01'[int(x)] for x in u)}" for s, u in sorted(used.items()) if u.any()]]})

    return count


def one_language(scores: np.ndarray, penalty: float) -> int | None:
    """The best language if no stretch of words speaks against it by more than the penalty."""
    best = int(scores.sum(0).argmax())
    against = np.delete(scores, best, 1).max(1) - scores[:, best] if scores.shape[1] > 1 else np.zeros(len(scores))
    running = np.concatenate([[0.0], np.cumsum(against, dtype=np.float64)])
    return best if (running - np.minimum.accumulate(running)).max() <= penalty else None


def viterbi(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label of each word of each text, all texts side by side, one word of each per step."""
    if not texts:
        return []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = [len(texts[i]) for i in order]
    longest, n, width = sizes[0], len(order), texts[0].shape[1]
    value = np.zeros((n, width))
    came: list[np.ndarray] = []
    ends = np.zeros(n, np.int64)
    alive = n
    for t in range(longest):
        while alive and sizes[alive - 1] <= t:
            alive -= 1
            ends[alive] = value[alive].argmax()
        now = np.stack([texts[i][t] for i in order[:alive]])
        if t == 0:
            value[:alive] = now
            came.append(np.zeros((alive, width), np.int16))
            continue
        held = value[:alive]
        best = held.argmax(1)
        top = held[np.arange(alive), best][:, None] - penalty
        change = top > held
        came.append(np.where(change, best[:, None], np.arange(width)).astype(np.int16))
        value[:alive] = now + np.where(change, top, held)
    ends[:alive] = value[:alive].argmax(1)
    out = [np.zeros(s, np.int16) for s in sizes]
    label = ends.copy()
    for t in range(longest - 1, -1, -1):
        here = len(came[t])
        for k in range(here):
            out[k][t] = label[k]
        label[:here] = came[t][np.arange(here), label[:here]]
    result: list[np.ndarray] = [np.zeros(0, np.int16)] * n
    for k, i in enumerate(order):
        result[i] = out[k]
    return result


def _labelling(model: LanguageModel):
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)), np.float32)
        letters = np.zeros(0, np.int32)
        for batch in batches:
            texts = batch["text"].tolist()
            for start, stop in stretches(texts):
                lists = [t.lower().split() for t in texts[start:stop]]
                every = set().union(*lists)
                new = [w for w in every if w not in place]
                if len(place) + len(new) > model.settings.cache_words:
                    place.clear()
                    new = list(every)
                    table, letters = table[:0], letters[:0]
                scores, counts = model.score(new)
                place.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table, letters = np.concatenate([table, scores]), np.concatenate([letters, counts])
                at = [np.fromiter(map(place.__getitem__, x), np.int64, len(x)) for x in lists]
                sums = [letters[a] for a in at]
                own = [table[a] for a in at]
                single = [one_language(s, model.settings.penalty) if n.any() else None for s, n in zip(own, sums, strict=True)]
                mixed = [k for k, s in enumerate(single) if s is None and sums[k].any()]
                paths = dict(zip(mixed, viterbi([own[k] for k in mixed], model.settings.penalty), strict=True))
                langs, scored, spans = [], [], []
                for k, (s, n) in enumerate(zip(own, sums, strict=True)):
                    total = int(n.sum())
                    if not total:
                        langs.append("und"), scored.append(0.0), spans.append([])
                        continue
                    path = paths.get(k, np.full(len(n), single[k] if single[k] is not None else 0, np.int16))
                    by = np.bincount(path, n, len(model.languages))
                    best = int(by.argmax())
                    odds = s.sum(0, dtype=np.float64)
                    odds = np.exp(np.clip(odds - odds[best], -50, 50))
                    cut = np.flatnonzero(np.diff(path)) + 1
                    begins, ends = [0, *cut.tolist()], [*cut.tolist(), len(path)]
                    langs.append(model.languages[best])
                    scored.append(float(by[best] / total / odds.sum()) if k not in paths else float(by[best] / total))
                    spans.append([{"begin": b, "end": e, "lang": model.languages[int(path[b])]} for b, e in zip(begins, ends, strict=True)])
                part = batch.iloc[start:stop]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "known": part["known"].array, "lang_pred": langs, "score": scored, "spans": spans})

    return label


def identified(documents: DataFrame, settings: LanguageSettings | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for each row of ``documents``, repeated ones too.

    ``spans`` are stretches of words (split at white space, counted from 0) in one language. A null text, one
    without a letter, or any text if nothing could be learnt, is ``und`` with score 0. A text in a script that no
    learnt language uses gets the first language with the score of a guess.
    """
    model = fit(documents, settings)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), text_of().alias("text"))
    real = F.when(F.col("known"), F.col("doc_id")).alias("doc_id")
    spans = "array<struct<begin:int,end:int,lang:string>>"
    if not model.languages:
        return rows.select(real, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(spans).alias("spans"))
    found = rows.mapInPandas(_labelling(model), f"doc_id long, known boolean, lang_pred string, score double, spans {spans}")
    return found.select(real, "lang_pred", "score", "spans")
