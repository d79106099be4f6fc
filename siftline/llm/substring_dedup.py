"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

Pass 1 counts. Every window of 20 words has an anchor, the smallest hash among its 10-word grams, and
equal windows have equal anchors at equal offsets. Tasks count anchors in partial count-min sketches whose cells
saturate at two; the merged sketch says of each cell whether it was hit twice. The estimate never falls below
the true count of a window, so no repeated window is lost.

Pass 2 takes the BLAKE2b digest (128 bits) of the words of every window whose anchor is estimated as repeated and groups exactly
these: the smallest document of each window. Pass 3 deletes, in each document, the words of candidate windows that are not
their corpus-wide first. Windows are told apart by these digests alone, never by the fast hashes, which only choose candidates: a collision of fast hashes
lets more windows through and changes no result. All three passes read whole texts and stream; a window that a third of all documents
share reaches the grouping as one row a task.

The sketch is as wide as the input asks for, up to ``MAX_CELLS`` a row (two rows of bits: 64 MB at most
to broadcast). Beyond that it lets more windows through; results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import written

WINDOW = 20
GRAM = 10
MAX_CELLS = 1 << 28
MIN_CELLS = 1 << 20
SLICE = 1 << 18  # cells merged together
PIECE = 1 << 20  # bytes hashed at once
_P = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on; as long as h, the last k-1 meaningless. Runs are doubled, each time mixed anew."""
    out, have = _mix(h + _U(3)), 1
    while have < k:
        step = min(have, k - have)
        if len(out) <= step:
            break
        left = out * _U(_P)
        left[:-step] ^= out[step:] + _U(have)
        out, have = _mix(left), have + step
    return out


def _digests(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """[window, 2]: 128 bits for each window of words. Words hold no space, so joined by spaces they can be read in one way only."""
    held = b"".join([blake2b(b" ".join(words[i : i + window]), digest_size=16).digest() for i in at.tolist()])
    return np.frombuffer(held, _U).reshape(-1, 2)


def _sliding(op, x: np.ndarray, k: int) -> np.ndarray:
    """op over x[i:i+k], as far as x goes, by doubling."""
    out, have = x.copy(), 1
    while have < k:
        step = min(have, k - have)
        if len(out) > step:
            op(out[:-step], out[step:].copy(), out=out[:-step])
        have += step
    return out


class _Batch:
    """Windows of some documents: their words in a row, and per word place ``ok`` (a window starts there) and the anchor."""

    def __init__(self, datas: list[bytes], window: int, gram: int):
        each = [d.split() for d in datas]
        self.n = np.array([len(w) for w in each], np.int64)
        self.words = [x for w in each for x in w]
        self.first = np.concatenate(([0], np.cumsum(self.n)[:-1])) if len(self.n) else self.n
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        last = np.repeat(self.first + self.n, self.n)
        self.ok = np.arange(len(self.words)) + window <= last
        self.grams = _grams(_hash_words(self.words), gram) | _U(1)
        self.anchor = _sliding(np.minimum, self.grams, window - gram + 1)
        self.span = window - gram + 1

    def anchors(self) -> np.ndarray:
        """Grams that are the anchor of a window that holds them, once for each place."""
        best = np.where(self.ok, self.anchor, _U(0))
        reach = _sliding(np.maximum, best[::-1], self.span)[::-1]
        return self.grams[(reach == self.grams) & (best.size > 0)]


def _batches(texts: pd.Series, window: int, gram: int) -> Iterator[tuple[int, list[bytes], _Batch]]:
    datas: list[bytes] = []
    size = begin = 0
    for i, t in enumerate(texts):
        datas.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(datas[-1]) + 1
        if size >= PIECE:
            yield begin, datas, _Batch(datas, window, gram)
            datas, size, begin = [], 0, i + 1
    if datas:
        yield begin, datas, _Batch(datas, window, gram)


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = _U(64 - bits)
    return _mix(keys ^ _U(0x1234567)) >> shift, _mix(keys * _U(_P)) >> shift


def _sketch(texts: DataFrame, bits: int, window: int, gram: int) -> list[np.ndarray]:
    """Two rows of bits: was a cell hit at least twice?"""
    slices = (1 << bits) // SLICE

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            keys = np.concatenate(held) if held else np.zeros(0, _U)
            held.clear()
            rows = []
            for r, cell in enumerate(_cells(keys, bits)):
                cell, n = np.unique(cell.astype(np.int64), return_counts=True)
                cut = np.searchsorted(cell, np.arange(slices + 1) * SLICE)
                for s in range(slices):
                    if cut[s] < cut[s + 1]:
                        c, m = (cell[cut[s] : cut[s + 1]] - s * SLICE).astype(np.uint32), n[cut[s] : cut[s + 1]]
                        rows.append((r * slices + s, c[m == 1].tobytes(), c[m > 1].tobytes()))
            return pd.DataFrame(rows, columns=["slice", "once", "more"])

        for pdf in batches:
            for _, _, b in _batches(pdf["text"], window, gram):
                held.append(b.anchors())
                if sum(map(len, held)) > 4_000_000:
                    yield flush()
        yield flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s, once, more in zip(pdf["slice"], pdf["once"], pdf["more"]):
                x = seen.setdefault(int(s), np.zeros(SLICE, np.uint8))
                c = np.frombuffer(once, np.uint32)
                x[c] = np.minimum(x[c] + 1, 2)
                x[np.frombuffer(more, np.uint32)] = 2
        for s, x in seen.items():
            yield pd.DataFrame({"slice": [s], "bits": [np.packbits(x == 2, bitorder="little").tobytes()]})

    partial = texts.mapInPandas(count, "slice int, once binary, more binary")
    merged = partial.repartition("slice").mapInPandas(merge, "slice int, bits binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for s, got in merged.toLocalIterator():  # the sketch alone, of bounded size
        at = (s % slices) * SLICE // 8
        rows[s // slices][at : at + SLICE // 8] = np.frombuffer(got, np.uint8)
    return rows


def _candidates(b: _Batch, rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Places of windows that the sketch estimates as repeated."""
    at = np.flatnonzero(b.ok)
    for r in range(2):
        cell = _cells(b.anchor[at], bits)[r]
        at = at[(rows[r][(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8)) & 1 == 1]
    return at


def _firsts(doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Mask over windows in the order of their places: the first of its digest in its document."""
    keys = np.column_stack((doc.astype(_U), digest))
    order = np.lexsort((np.arange(len(doc)), *keys.T))
    sorted_keys = keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)
    out = np.empty(len(doc), bool)
    out[order] = new
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id, n_words, n_removed, kept, spans``: a row for each row of ``docs``.

    Words are runs of characters other than 20 and 09-0D. Every word is removed that lies in a window of
    ``window`` words whose sequence also starts earlier: in a document with a smaller id, or earlier in the same one. ``kept``
    joins the others by one space; ``spans`` are the removed runs (first word, number of words). Null and empty
    texts have no words. Rows that share an id count as one place: what they have in common is kept in each. Rows without an id come after all
    others, in the order of a hash of their texts; those with the same text are one place. Of the other columns none is read. An empty table gives
    an empty result.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram is no longer than the window")
    spark = docs.sparkSession
    lost = F.col(id_col).isNull()  # long columns go through pandas without nulls, which would turn them into floats
    tie = F.when(lost, F.xxhash64(text_col)).otherwise(0)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("key"), lost.alias("lost"), tie.alias("tie"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = 4 * size // (6 * (window - gram + 2) // 2)  # four cells for each anchor, at six bytes a word
    bits = max(MIN_CELLS, min(MAX_CELLS, 1 << max(0, want - 1).bit_length())).bit_length() - 1
    sent = spark.sparkContext.broadcast(_sketch(texts.select("text"), bits, window, gram))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        for pdf in batches:
            for begin, _, b in _batches(pdf["text"], window, gram):
                at = _candidates(b, rows, bits)
                found = _digests(b.words, at, window)
                new = _firsts(b.doc[at], found)
                own = pdf.iloc[begin + b.doc[at[new]]]
                yield pd.DataFrame({"window": [x.tobytes() for x in found[new]], "key": own["key"].to_numpy(), "lost": own["lost"].to_numpy(), "tie": own["tie"].to_numpy()})

    first = (
        texts.select("key", "lost", "tie", "text")
        .mapInPandas(emit, "window binary, key long, lost boolean, tie long")
        .groupBy("window")
        .agg(F.min(F.when(~F.col("lost"), F.col("key"))).alias("k"), F.min(F.when(F.col("lost"), F.col("tie"))).alias("t"))
        .select("window", F.coalesce("k", F.lit(0)).alias("k"), F.col("k").isNull().alias("l"), F.when(F.col("k").isNull(), F.col("t")).otherwise(0).alias("t"))
        .groupBy("k", "l", "t")
        .agg(F.collect_list("window").alias("firsts"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        for pdf in batches:
            out = []
            for begin, datas, b in _batches(pdf["text"], window, gram):
                at = _candidates(b, rows, bits)
                found = _digests(b.words, at, window)
                stays = _firsts(b.doc[at], found)
                known = [set(x) if x is not None else () for x in pdf["firsts"].iloc[begin : begin + len(datas)]]
                stays &= np.fromiter((x.tobytes() in known[d] for x, d in zip(found, b.doc[at].tolist())), bool, len(at))
                hit = at[~stays]
                delta = np.zeros(len(b.doc) + 1, np.int64)
                np.add.at(delta, hit, 1)
                np.add.at(delta, hit + window, -1)
                gone = np.cumsum(delta)[:-1] > 0
                for i in range(len(datas)):
                    g = gone[b.first[i] : b.first[i] + b.n[i]]
                    words = b.words[b.first[i] : b.first[i] + b.n[i]]
                    spans = []
                    if g.any():
                        words = [w for w, x in zip(words, g.tolist()) if not x]
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                        spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
                    out.append((pdf["id"].iloc[begin + i], len(g), int(g.sum()), b" ".join(words).decode("utf-8", "surrogatepass"), spans))
                if len(out) >= 512:
                    yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept", "spans"])
                    out = []
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    joined = texts.join(written(first, "firsts"), F.expr("key = k and lost = l and tie = t"), "left").select(F.col("id").cast("string").alias("id"), "text", "firsts")
    done = joined.mapInPandas(cut, "id string, n_words long, n_removed long, kept string, spans array<struct<start:long,length:long>>")
    return done.select(F.col("id").cast(id_type).alias("id"), "n_words", "n_removed", "kept", "spans")
