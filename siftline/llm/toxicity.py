"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs and triples of neighbouring words, and pairs of words with one or two between them, each hashed to one of
2**``BITS`` weights. Learning keeps a gradient sum and a rate for every coordinate; an L1 penalty leaves all but a few weights at zero, so that what
every worker gets is a short list of places and weights.

The weights are fitted on the driver to a bounded sample of labelled rows (``max_rows``, ``max_bytes``); scoring is a map over all texts, whole ones, in parts of bounded size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import labelled_sample, slim

BITS = 20
PART = 1 << 20  # characters of text that are turned into features at once
GAPS = (1, 2, 3)  # pairs of neighbours, and over one and two words
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass
class Weights:
    """What learning leaves: the places of weights that are not zero, in order, the weights, and the constant."""

    places: np.ndarray
    values: np.ndarray
    constant: float

    def at(self, places: np.ndarray) -> np.ndarray:
        if not len(self.places):
            return np.zeros(len(places))
        found = np.searchsorted(self.places, places).clip(max=len(self.places) - 1)
        return np.where(self.places[found] == places, self.values[found], 0.0)


def parts(text: str | None):
    """A text in parts of about ``PART`` characters that end between words; each begins with the last three words of the one before."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    at, end = 0, PART
    while end < len(data):
        while end < len(data) and WORD.match(data, end - 1, end) and WORD.match(data, end, end + 1):
            end += 1
        yield data[at:end]
        at = end
        for _ in GAPS:
            while at > 0 and not WORD.match(data, at - 1, at):
                at -= 1
            while at > 0 and WORD.match(data, at - 1, at):
                at -= 1
        end += PART
    yield data[at:]


def features(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the piece, place of the feature) of all features in some pieces, repeats included."""
    found = [[crc32(w) for w in WORD.findall(p)] for p in pieces]
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    word = np.fromiter((h for f in found for h in f), np.uint64, len(owner))
    kinds, owners = [word * ODD[0]], [owner]
    for gap in GAPS:
        same = owner[gap:] == owner[:-gap]
        kinds.append((((word[:-gap] + np.uint64(gap)) * ODD[1]) ^ (word[gap:] * ODD[0]))[same] * ODD[2])
        owners.append(owner[gap:][same])
    same = owner[2:] == owner[:-2]
    kinds.append((((word[:-2] * ODD[0]) ^ (word[1:-1] * ODD[1])) * ODD[2] ^ (word[2:] * ODD[0]))[same] * ODD[1])
    owners.append(owner[2:][same])
    mixed = np.concatenate(kinds)
    mixed ^= mixed >> np.uint64(29)
    return np.concatenate(owners), ((mixed * ODD[2]) >> np.uint64(64 - BITS)).astype(np.int64)


def scores(weights: Weights, texts) -> np.ndarray:
    """Probability of label 1 of each text; a null text counts as empty. Of a text only features with a weight are kept, so its length costs no memory."""
    owners: list[np.ndarray] = []
    places: list[np.ndarray] = []
    held: list[bytes] = []
    whose: list[int] = []
    size = n = 0

    def flush() -> None:
        if held:
            owner, place = features(held)
            kept = weights.at(place) != 0
            owners.append(np.array(whose)[owner[kept]])
            places.append(place[kept])

    for i, text in enumerate(texts):
        n = i + 1
        for part in parts(text):
            held.append(part)
            whose.append(i)
            size += len(part)
            if size > PART:
                flush()
                held, whose, size = [], [], 0
    flush()
    z = np.full(n, weights.constant)
    if owners:
        once = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | np.concatenate(places))
        z += np.bincount(once >> BITS, weights.at(once & ((1 << BITS) - 1)), n)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str | None], labels: list[int], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, seed: int = 13) -> Weights:
    """FTRL-proximal: one text at a time, ``epochs`` times over them in a drawn order; the constant has no penalty. Without texts all scores are one half."""
    sets = [np.unique(features(list(parts(t)))[1]) for t in texts]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = constant = 0.0
    rng = np.random.default_rng(seed)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            at = sets[i]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            constant = -z0 * alpha / (beta + np.sqrt(n0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + constant, -35, 35))) - labels[i]
            more = np.sqrt(ni + g * g)
            z[at] = zi + g - (more - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            more0 = np.sqrt(n0 + g * g)
            z0 += g - (more0 - np.sqrt(n0)) / alpha * constant
            n0 += g * g
    w = weight(z, n)
    places = np.flatnonzero(w)
    return Weights(places, w[places], float(-z0 * alpha / (beta + np.sqrt(n0))))


def held_out(id_col: str = "doc_id") -> str:
    """SQL of the rows that teach nothing: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return f"coalesce(crc32(cast({id_col} as string)) % 4 = 2, false)"


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, max_bytes: int = 20_000_000, **how) -> Weights:
    """Weights learnt from at most ``max_rows`` labelled texts that are not held out, of about ``max_bytes`` bytes together."""
    return fit(*labelled_sample(docs, labels, "toxic", held_out(), max_rows, max_bytes), **how)


def with_score(docs: DataFrame, weights: Weights, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and a column ``name``: the probability of label 1, from the text alone.

    Null texts count as empty; every row gets a score, repeated rows the same one. A column of that name is replaced, all others stay; an empty table stays empty.
    """

    def of(texts: pd.Series) -> pd.Series:
        found = pd.Series(scores(weights, texts), dtype=float)
        slim()
        return found

    return docs.withColumn(name, F.pandas_udf(of, "double")(F.col(text_col)))
