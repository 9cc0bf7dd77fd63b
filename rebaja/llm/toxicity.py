"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rebaja.llm.common import texts

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Levels of a pattern: least number of its words, and least number by thousand words.
LEVELS = ((1, 0), (2, 8), (3, 12))
#: Documented bound of the labelled rows that the model is fitted on.
MAX_TRAIN = 40_000
#: At most so many voters, and at least this share of the toxic rows must show one.
MAX_VOTERS, MIN_SHARE, MIN_LIFT = 256, 0.006, 15.0
SILENT, TOLD = 0.05, 0.95
CUTOFF = 0.3


def shown(text: str, stems: dict[int, set[str]] | None = None) -> set[str]:
    """Voters that a text sets off.

    A word votes as a lexicon entry. Words that begin alike vote as a pattern,
    at up to three levels: seen at all, and seen often, both in number and by
    thousand words. ``stems``: the beginnings to look at, by length; else all.
    """
    words = Counter(WORD.findall(text.lower()))
    total, counts = sum(words.values()), Counter()
    for n in PREFIXES:
        known = stems and stems[n]
        if stems is None or known:
            for word, count in words.items():
                if len(word) > n and (stems is None or word[:n] in known):
                    counts[word[:n]] += count
    found = set()
    for stem, count in counts.items():
        found.update(f"{stem}*{k}" for k, (least, rate) in enumerate(LEVELS) if count >= least and 1000 * count >= rate * total)
    return found | words.keys()


@dataclass
class ToxicityModel:
    """Voters and the weights of the linear classifier over them."""

    voters: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    accuracies: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self):
        self.at = {v: i for i, v in enumerate(self.voters)}
        self.stems = {n: {v[:n] for v in self.voters if v[n:n + 1] == "*"} for n in PREFIXES}

    def votes(self, text: str) -> list[int]:
        """Numbers of the voters that a text sets off."""
        return sorted(self.at[v] for v in shown(text, self.stems) & self.at.keys())

    def score(self, text: str | None) -> float:
        z = self.bias + float(sum(self.weights[i] for i in self.votes(text or "")))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """Rows that no part of the model may learn from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(toxic, text) of labelled rows outside the held-out part; beyond ``limit`` a share by hash of doc_id.

    Conflicting labels of one doc_id count as toxic. Only the ids, at most about
    ``limit``, are broadcast; the texts are not shuffled.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    share = F.lit(int(1e6 * min(1.0, limit / max(n, 1))))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def _counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """Documents per candidate voter, summed inside each task first."""
    def count(batches):
        seen: Counter = Counter()
        stems = only and {n: {v[:n] for v in only if v[n:n + 1] == "*"} for n in PREFIXES}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shown(text, stems)
                seen.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["voter", "n"])

    return rows.select("text").mapInArrow(count, "voter string, n bigint").groupBy("voter").agg(F.sum("n").alias("n"))


def choose_voters(train: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[float, float]]:
    """Words and word beginnings far more frequent in toxic training rows; of nested patterns with the same reach the shortest stays.

    With the share of toxic and of clean rows that show each.
    """
    least = max(4, int(MIN_SHARE * n_toxic))
    toxic = {r.voter: r.n for r in _counted(train.where("toxic = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "voter").limit(20_000).collect()}
    clean = {r.voter: r.n for r in _counted(train.where("toxic = 0"), set(toxic)).collect()}
    lift = {v: (n / n_toxic) / ((clean.get(v, 0) + 1) / (n_clean + 1)) for v, n in toxic.items()}
    good = sorted((v for v in toxic if lift[v] >= MIN_LIFT), key=lambda v: (-toxic[v], len(v), v))
    chosen: list[str] = []
    for v in good:
        stem, _, level = v.partition("*")
        if not any("*" in c and stem.startswith(c.partition("*")[0]) and lift[c] >= 0.5 * lift[v] and (not level or c.partition("*")[2] == level) for c in chosen):
            chosen.append(v)
        if len(chosen) == MAX_VOTERS:
            break
    return {v: (toxic[v] / n_toxic, (clean.get(v, 0) + 0.5) / (n_clean + 1)) for v in chosen}


def label_model(votes: np.ndarray, prior: float, rates: np.ndarray, told: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label from all votes, by expectation maximisation.

    Each voter has a rate of firing on toxic and on clean rows, begun at
    ``rates``; one that stays silent abstains, which says nothing (most voters
    speak one language); a row on which all are
    silent is toxic ``SILENT`` times as often as one taken blindly. The given
    label ``told`` is one more voter, right in the share ``TOLD`` of rows. Voters that still go together once the label is
    explained are correlated; the evidence of each is divided by the number of
    its correlated companions.
    """
    n, m = votes.shape
    share, pi = np.ones(m), np.clip(prior, 1e-4, 0.5)
    silence = np.where(votes.any(1), 0.0, np.log(SILENT)) + np.where(told, 1, -1) * np.log(TOLD / (1 - TOLD))
    on, off = np.maximum(rates[:, 0], 1e-4), np.maximum(rates[:, 1], 1e-5)
    for k in range(rounds):
        z = np.log(pi / (1 - pi)) + silence + (votes * share) @ np.log(on / off)
        q = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        on = (votes.T @ q + 0.1) / (q.sum() + 1)
        off = np.minimum((votes.T @ (1 - q) + 0.01) / ((1 - q).sum() + 1), on)  # a voter speaks for toxicity or not at all
        if k in (2, 10) and m > 1:
            rest = votes - (q[:, None] * on + (1 - q[:, None]) * off)
            spread = np.sqrt((rest ** 2).mean(0)) + 1e-9
            both = np.abs(rest.T @ rest / n) / np.outer(spread, spread)
            share = 1 / np.maximum(1, (both > 0.5).sum(1))
    return q, on, off, share


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(design.shape[1])
    w[-1] = -2.0
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - target) + penalty @ w
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + penalty
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> ToxicityModel:
    """Fit on at most about ``limit`` labelled rows outside the held-out part.

    Labels choose the voters, give the prior, and vote themselves. Without toxic training rows no voter is found and every score is low.
    """
    train = training_rows(docs, labels, limit)
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return ToxicityModel()
    rates = choose_voters(train, n_toxic, n_clean)
    model = ToxicityModel(list(rates))
    if not model.voters:
        return model
    voting = F.pandas_udf(lambda s: s.map(model.votes), T.ArrayType(T.IntegerType()))
    rows = train.select("toxic", voting("text").alias("votes")).groupBy("votes", "toxic").count().collect()  # at most ``limit`` patterns of votes
    rows = sorted((tuple(r.votes), r.toxic, r["count"]) for r in rows)
    votes = np.zeros((sum(c for *_, c in rows), len(model.voters)), np.float32)
    told, at = np.zeros(len(votes), bool), 0
    for fired, toxic, count in rows:
        votes[at:at + count, list(fired)] = 1
        told[at:at + count] = toxic == 1
        at += count
    posterior, on, off, _ = label_model(votes, n_toxic / (n_toxic + n_clean), np.array(list(rates.values())), told)
    weights, bias = fit_linear(votes, posterior)
    return ToxicityModel(model.voters, weights, float(bias), [(float(a), float(b)) for a, b in zip(on, off)])


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score of each whole text, 0 to 1. The model is small and bounded by ``MAX_VOTERS``."""
    def score(s: pd.Series) -> pd.Series:
        return s.map(model.score)
    return F.pandas_udf(score, T.DoubleType())(F.coalesce(text, F.lit("")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; a null or empty text sets off no voter."""
    model = fit(docs, labels)
    scored = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    return docs.where(score_column(fit(docs, labels), F.col("text")) < CUTOFF)
