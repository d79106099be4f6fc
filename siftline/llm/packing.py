"""Packing: lexical retrieval by a sharded BM25 inverted index.

Texts are encoded once and their ids written. Document frequencies and the mean length are those of the whole corpus. Documents are then
dealt and sorted by their rarest terms, those of a common term in salted parts, so that related ones come together from wherever they lie. A shard is a run in this order,
closed at ``shard_docs`` documents or ``shard_tokens`` tokens; its index maps token ids to postings with their BM25 weights. A seed
document opens a window; its unused neighbours by BM25 fill it greedily, whole ones first. When none fits, the best one is cut, fills the
window to the last place, and seeds the next window with its rest. Memory is bounded by the shard and the vocabulary.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import slim, small, written

# Fixed value: the public pattern by which byte-level BPE cuts a text into pre-tokens, in its form without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and their ranks, if merging by them provably gives what the tokenizers library gives for the file; else None.

    Proof, checked for the file: it is plain byte-level BPE without normaliser, prefix space or dropout; the ids of merged tokens ascend with their merges,
    so that the order of ids is the order of merges; and merging by rank alone builds every token by its own two parts. Two neighbours that
    make up a token then always are these parts, for what lies inside a token is merged alike wherever it stands.
    """
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held["pre_tokenizer"] or {}
    plain = not held["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    plain &= all(not t[k] for t in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        return None
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    # The byte-level alphabet, asked of the library with one character of every kind of lead and trail byte.
    byte: dict[str, int] = {}
    for c in [*range(0x800), *range(0x800, 0x110000, 0x800)]:
        if not 0xD800 <= c < 0xE000:
            byte |= dict(zip(level.pre_tokenize_str(chr(c))[0][0], chr(c).encode()))
    added = {t["id"] for t in held["added_tokens"]}
    # Bytes that no UTF-8 text has need not be known; tokens made of them never occur in one.
    ranks = {bytes(byte[x] for x in t): i for t, i in model["vocab"].items() if i not in added and all(x in byte for x in t)}
    last = -1
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        if not all(x in byte for x in left + right):
            continue
        left, right = bytes(byte[x] for x in left), bytes(byte[x] for x in right)
        at = ranks.get(left + right)
        if at is None or at <= last or _parts(left + right, ranks) != [left, right]:
            return None
        last = at
    if sum(len(t) > 1 for t in ranks) != sum(all(x in byte for x in "".join(p if isinstance(p, list) else p.split(" "))) for p in model["merges"]):
        return None
    for b in range(256):  # the merge loop wants a rank for every byte
        ranks.setdefault(bytes([b]), len(ranks) + (1 << 20))
    return ranks


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The token's bytes, merged by rank until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
        if best == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Token ids of a text by a byte-level BPE file of the tokenizers library, as unsigned 32-bit integers: ``encode(text, add_special_tokens=False)``.

    With ``ranks`` (see ``merge_ranks``) tiktoken's merge loop runs the same vocabulary, several times faster. Texts that hold an added token's string
    always go to the tokenizers library, which gives the token's id.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None if ranks is None else tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast(text), "<u4")


class Corpus:
    """Number of documents, their mean length, and the document frequency of each term (``terms`` sorted)."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms, self.counts = n, mean, terms, df
        self.order = np.full(int(terms[-1]) + 1 if len(terms) else 1, 1 << 62)  # by term: rarest first; terms of one document last
        self.order[terms[df > 1]] = (df[df > 1] << 32) + terms[df > 1]

    def df(self, terms: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.terms, terms)]

    def rarest(self, ids: np.ndarray) -> tuple[int, int]:
        """The two rarest of a document's terms that others have, too; -1: none."""
        found = self.order[ids]
        a = found.min()
        b = found.min(where=found > a, initial=1 << 62)
        return tuple(-1 if x == 1 << 62 else int(x) & 0xFFFFFFFF for x in (a, b))

    def salt(self, a: int, b: int, own: int, most: int) -> int:
        """Deals the documents with the rarest term ``a`` to parts of about ``most``, those with the same ``b`` to one if they fit; ``own`` tells documents apart."""
        of = lambda t: int(self.order[t]) >> 32 if t >= 0 else self.n
        parts = -(-of(a) // most)
        return zlib.crc32(b"%d" % b if of(b) <= most else b"%d %d" % (b, own)) % parts if parts > 1 else 0


class Bm25:
    """Inverted index over the token ids of some documents; frequencies and mean length are the corpus', or their own without one."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, corpus: Corpus | None = None):
        self.n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in found]
        length = np.array([len(d) for d in docs], float)
        norm = k1 * (1 - b + b * length / max(corpus.mean if corpus else length.mean() if self.n else 0, 1))
        term = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(self.n), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in found]).astype(float) if found else np.zeros(0)
        order = np.argsort(term, kind="stable")
        self.vocab, start, df = np.unique(term[order], return_index=True, return_counts=True)
        every, among = (corpus.df(self.vocab), corpus.n) if corpus else (df, self.n)
        idf = np.log((among - every + 0.5) / (every + 0.5))  # a term in over half the documents does not tell them apart
        self.start, self.df, self.idf = start, df, idf
        self.doc = doc[order]
        weight = tf * (k1 + 1) / (tf + norm[doc])
        self.weight = weight[order] * np.repeat(np.maximum(idf, 0), df)

    def scores(self, query: int) -> np.ndarray:
        at = np.searchsorted(self.vocab, self.terms[query])
        at = at[self.idf[at] > 0]
        n = self.df[at]
        total = int(n.sum())
        if not total:
            return np.zeros(self.n)
        place = np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        return np.bincount(self.doc[place], self.weight[place], self.n)


class Packer:
    """Fills windows; holds one open window besides the shard it is given."""

    def __init__(self, window: int, base: int, corpus: Corpus | None = None):
        self.window, self.next, self.corpus = window, base, corpus
        self.open: list[tuple] = []  # name, start, ids, tokens of the whole document
        self.used = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        off = 0
        for name, start, ids, total in pieces:
            self.rows.append((name, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, off))
            off += len(ids)
        self.next += 1

    def put(self, name, ids: np.ndarray) -> None:
        """Place a whole document, cut where windows end."""
        at = 0
        while at < len(ids):
            part = ids[at : at + self.window - self.used]
            self.open.append((name, at, part, len(ids)))
            self.used += len(part)
            at += len(part)
            if self.used == self.window:
                self._emit(self.open)
                self.open, self.used = [], 0

    def shard(self, names: list, docs: list[np.ndarray]) -> None:
        """Place all documents of a shard."""
        index = Bm25(docs, corpus=self.corpus)
        length = np.array([len(d) for d in docs])
        unused = np.ones(len(docs), bool)
        for first in range(len(docs)):  # seeds, in the order of the shard
            if not unused[first]:
                continue
            seed = first
            unused[seed] = False
            self.put(names[seed], docs[seed])
            while self.used and unused.any():
                order = np.argsort(-np.where(unused, index.scores(seed), -np.inf), kind="stable")[: int(unused.sum())]
                for i in order[length[order] <= self.window - self.used].tolist():
                    if length[i] <= self.window - self.used:
                        unused[i] = False
                        self.put(names[i], docs[i])
                        if not self.used:
                            break
                if self.used and unused.any():  # the best that is left is cut here, and its rest is the next seed
                    seed = int(order[unused[order]][0])
                    unused[seed] = False
                    self.put(names[seed], docs[seed])

    def finish(self) -> None:
        """Cut the last, unfilled window into sequences whose lengths are powers of two: they need no padding."""
        left, queue = self.used, self.open[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                name, start, ids, total = queue.pop()
                pieces.append((name, start, ids[:room], total))
                if len(ids) > room:
                    queue.append((name, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
            self._emit(pieces)
        self.open, self.used = [], 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where they suffice, otherwise four."""
    return ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else ids.tobytes()


def unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")


def encoded(rows: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``id, n, ids, terms, df``: a row for each of ``rows`` (``id, text``), and one for each task with its terms and their document frequencies."""

    ranks = rows.sparkSession.sparkContext.broadcast(merge_ranks(tokenizer))  # bounded by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer, ranks.value)
        end = np.array([end_id], "<u4")
        df = np.zeros(1 << 16, np.int64)
        for pdf in small(batches):
            held = [np.concatenate((encode(t), end)) for t in pdf["text"]]
            for ids in held:
                if int(ids.max()) >= len(df):
                    df = np.concatenate((df, np.zeros(int(ids.max()) + 1, np.int64)))
                df[np.unique(ids)] += 1
            yield pd.DataFrame({"id": pdf["id"], "n": [len(x) for x in held], "ids": [packed(x) for x in held], "terms": None, "df": None})
        terms = np.flatnonzero(df)
        yield pd.DataFrame({"id": [None], "n": [0], "ids": [None], "terms": [terms], "df": [df[terms]]})

    return rows.mapInPandas(run, "id string, n long, ids binary, terms array<long>, df array<long>")


def statistics(tokens: DataFrame) -> Corpus:
    """Of all documents of ``encoded``; bounded by the vocabulary."""
    n, mean = tokens.where("ids is not null").agg(F.count(F.lit(1)), F.avg("n")).first()
    each = tokens.where("ids is null").select(F.explode(F.arrays_zip("terms", "df")).alias("z"))
    found = each.groupBy("z.terms").agg(F.sum("z.df").alias("df")).orderBy("terms").toPandas()
    return Corpus(n, mean or 0.0, found["terms"].to_numpy(np.int64), found["df"].to_numpy(np.int64))


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = 512,
    shard_tokens: int = 2_000_000,
) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row for each piece.

    A document's tokens are its text's ids, as the tokenizers library gives them without special tokens of its own (an added token's string in a text is
    that token), and then ``end_id``; a null text is empty and has the end id only. Every token
    lies in exactly one piece. Sequences are full, but for the few last ones of a task, whose lengths are
    powers of two. Ids and texts may repeat, ids may be null; an empty table gives an empty result. ``tokenizer`` is the path
    of a byte-level BPE file of the tokenizers library, readable on every machine. No other column is read.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # pandas would turn numbers beside nulls into floats
    tokens = written(encoded(rows, tokenizer, end_id), "tokens")
    corpus = statistics(tokens)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for pdf in small(batches):
            held = [unpacked(x, n) for x, n in zip(pdf["ids"], pdf["n"])]
            keys = [corpus.rarest(x) for x in held]
            own = [seen + i if name is None else zlib.crc32(name.encode("utf-8", "surrogatepass")) for i, name in enumerate(pdf["id"])]
            seen += len(own)
            salt = [corpus.salt(a, b, x, max(1, shard_docs // 4)) for (a, b), x in zip(keys, own)]
            yield pdf.assign(a=[k[0] for k in keys], salt=salt, b=[k[1] for k in keys], crc=[zlib.crc32(x) for x in pdf["ids"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(window, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, corpus)
        names: list = []
        held: list[np.ndarray] = []
        columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        size = 0
        for pdf in batches:
            for name, ids, n in zip(pdf["id"], pdf["ids"], pdf["n"]):
                names.append(name)
                held.append(unpacked(ids, n))
                size += n
                if len(held) >= shard_docs or size >= shard_tokens:
                    packer.shard(names, held)
                    names, held, size = [], [], 0
                    yield pd.DataFrame(packer.take(), columns=columns)
        packer.shard(names, held)
        packer.finish()
        yield pd.DataFrame(packer.take(), columns=columns)
        slim()

    # Documents with a rare term in common meet; the salt bounds what a common one brings to a task, and needs no sampling of the keys.
    dealt = tokens.where("ids is not null").select("id", "n", "ids").mapInPandas(keyed, "id string, n long, ids binary, a long, salt long, b long, crc long")
    done = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "b", "crc", "id").select("id", "n", "ids")  # copies come together
    pieces = done.mapInPandas(run, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("id", F.col("id").cast(kind))
