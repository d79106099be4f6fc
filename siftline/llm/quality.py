"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded; filters read chunks of 64 bytes that overlap by half and cover the whole text; each filter's
largest response and a last layer give one probability. Next to the byte, a position knows whether its four bytes
also stood there a short period before, which is how a filter sees words said over and over.

The network is fitted on the driver to a bounded sample of labelled rows (``max_rows``, ``max_bytes``); scoring is a map
over all texts, in batches of bounded size. A text of any length is read in segments whose maxima are combined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import labelled_sample, slim

HALF = 32  # half a chunk
CHANNELS = 7
FILTERS = 24
PERIODS = range(2, 25)
SEGMENT = 1 << 20
BATCH = 1 << 17  # bytes of texts that are scored at once, some 60 bytes of working memory for each; a longer text is scored alone
PAD = 512  # symbols: byte + 256 * repeated, and padding


@dataclass
class Net:
    embed: np.ndarray  # [513, CHANNELS]; the last channel is the repeat mark, the last row is zero
    filters: np.ndarray  # [2, HALF * CHANNELS, FILTERS]: first and second half of a chunk
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def symbols(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded to whole halves and one half more, and where each begins (in halves)."""
    halves = np.array([(len(d) + HALF - 1) // HALF + 1 + (not d) for d in datas])
    begin = np.concatenate(([0], np.cumsum(halves)))
    buf = np.zeros(int(begin[-1]) * HALF + 4, np.uint8)
    real = np.zeros(len(buf), bool)
    whole = np.zeros(len(buf), bool)
    for d, b in zip(datas, begin[:-1].tolist()):
        at = b * HALF
        buf[at : at + len(d)] = np.frombuffer(d, np.uint8)
        real[at : at + len(d)] = True
        whole[at : at + max(0, len(d) - 3)] = True
    four = buf[:-3].astype(np.uint32) | buf[1:-2].astype(np.uint32) << 8 | buf[2:-1].astype(np.uint32) << 16 | buf[3:].astype(np.uint32) << 24
    again = np.zeros(len(four), bool)
    for p in PERIODS:
        again[p:] |= four[p:] == four[:-p]
    n = len(buf) - 4
    sym = buf[:n].astype(np.int64) + 256 * (again[:n] & whole[:n])
    sym[~real[:n]] = PAD
    return sym, begin


def responses(net: Net, sym: np.ndarray) -> np.ndarray:
    """Filter responses of all chunks (half i and half i+1), before the bias."""
    x = net.embed[sym].reshape(-1, HALF * CHANNELS)
    y = x @ net.filters[0]
    y[:-1] += (x @ net.filters[1])[1:]
    return y[:-1]


def pooled(net: Net, datas: list[bytes]) -> np.ndarray:
    """Largest response of every filter over all chunks of every text."""
    sym, begin = symbols(datas)
    y = responses(net, sym)
    keep = np.ones(len(y), bool)
    keep[begin[1:-1] - 1] = False  # chunks across two texts
    y[~keep] = -np.inf
    return np.maximum.reduceat(y, begin[:-1], axis=0)


def _segments(data: bytes) -> list[bytes]:
    """Pieces of a very long text that overlap by two chunks; every chunk lies in one of them."""
    if len(data) <= SEGMENT:
        return [data]
    return [data[a : a + SEGMENT + 4 * HALF] for a in range(0, len(data), SEGMENT)]


def scores(net: Net, texts) -> np.ndarray:
    """Probability of label 1 of each text; a null text counts as empty."""
    out = np.zeros(0)
    best: list[np.ndarray] = []
    owner: list[int] = []
    held: list[bytes] = []
    size = n = 0
    for i, t in enumerate(texts):
        n = i + 1
        for piece in _segments(t.encode("utf-8", "surrogatepass") if t else b""):
            if held and size + len(piece) + 2 * HALF > BATCH:
                best.append(pooled(net, held))
                held, size = [], 0
            held.append(piece)
            owner.append(i)
            size += len(piece) + 2 * HALF
    if held:
        best.append(pooled(net, held))
    if not n:
        return out
    top = np.full((n, FILTERS), -np.inf, np.float32)
    np.maximum.at(top, np.array(owner), np.concatenate(best))
    z = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))


def fit(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 9) -> Net:
    """Adam on the logistic loss; gradients reach the chunk that won each filter's maximum."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (PAD + 1, CHANNELS)).astype(np.float32)
    embed[256:PAD] = embed[:256]
    embed[:, -1] = 0
    embed[256:PAD, -1] = 1
    embed[PAD] = 0
    net = Net(
        embed,
        rng.normal(0, 0.05, (2, HALF * CHANNELS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )
    if not texts:
        return net
    # Filters begin alike at every offset: what they look for may stand anywhere in a chunk.
    shared = rng.normal(0, 0.02, (1, 1, CHANNELS, FILTERS)).astype(np.float32)
    net.filters = (net.filters.reshape(2, HALF, CHANNELS, FILTERS) * 0.1 + shared).reshape(2, HALF * CHANNELS, FILTERS)
    y = np.array(labels, np.float32)
    share = min(max(float(y.mean()), 0.02), 0.98)
    net.out_bias = float(np.log(share / (1 - share)))
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    first = [np.zeros_like(v, np.float32) for v in (net.embed, net.filters, net.bias, net.out)] + [0.0]
    second = [np.zeros_like(v, np.float32) for v in (net.embed, net.filters, net.bias, net.out)] + [0.0]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sym, begin = symbols([data[i] for i in pick])
            r = responses(net, sym)
            win = np.stack([b + r[b : e - 1].argmax(axis=0) for b, e in zip(begin[:-1], begin[1:])])  # of a text's own chunks
            top = np.take_along_axis(r, win, axis=0)
            h = np.maximum(top + net.bias, 0)
            z = h @ net.out + net.out_bias
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            g = (p - y[pick]) / len(pick)
            dh = np.outer(g, net.out) * (h > 0)
            chunk = sym.reshape(-1, HALF)
            two = np.concatenate((chunk[win], chunk[win + 1]), axis=2)  # [text, filter, 64]
            x = net.embed[two].reshape(len(pick), FILTERS, 2, HALF * CHANNELS)
            dw = np.einsum("bf,bfsk->skf", dh, x).astype(np.float32)
            w = net.filters.transpose(2, 0, 1).reshape(FILTERS, 2 * HALF, CHANNELS)
            flat = (dh[:, :, None, None] * w[None]).astype(np.float32)
            de = np.zeros_like(net.embed)
            np.add.at(de, two.ravel(), flat.reshape(-1, CHANNELS))
            de[:256] += de[256:PAD]  # one embedding for a byte, repeated or not
            de[256:PAD] = de[:256]
            de[:, -1] = 0
            de[PAD] = 0
            grads = [de, dw + 1e-4 * net.filters, dh.sum(axis=0), h.T @ g, float(g.sum())]
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.8 * epoch / max(1, epochs))
            values = [net.embed, net.filters, net.bias, net.out, net.out_bias]
            for n, (v, d) in enumerate(zip(values, grads)):
                first[n] = 0.9 * first[n] + 0.1 * d
                second[n] = 0.99 * second[n] + 0.01 * d * d
                values[n] = v - lr * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
            net = Net(*[v.astype(np.float32) if isinstance(v, np.ndarray) else float(v) for v in values])
    return net


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 3000, max_bytes: int = 6_000_000) -> tuple[list[str], list[int]]:
    """Whole texts and 0/1 labels of at most ``max_rows`` rows and about ``max_bytes`` bytes, in the order of a hash of the id.

    Rows whose crc32(id as text) modulo 3 is 1 are held out and never read here. Null ids and labels, and ids with two different
    labels, teach nothing; an id teaches one of its texts, so the bounds hold however often it occurs.
    """
    held_out = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"
    return labelled_sample(docs, labels, label_col, held_out, max_rows, max_bytes)


def fitted(docs: DataFrame, labels: DataFrame, **sample) -> Net:
    return fit(*training_sample(docs, labels, **sample))


def with_score(docs: DataFrame, net: Net, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and a column ``name``: the probability of label 1, from the text alone.

    Null texts count as empty; every row gets a score, repeated rows the same one. A column of that name is replaced, all others stay; an empty table stays empty.
    """

    def of(texts: pd.Series) -> pd.Series:
        found = pd.Series(scores(net, texts), dtype=float)
        slim()
        return found

    return docs.withColumn(name, F.pandas_udf(of, "double")(F.col(text_col)))
