"""Spelling variant grouping: a trie self-join with active-node sets over the corpus' vocabulary.

Words are counted where texts are read; only distinct words of a part meet. Two words at distance one share all characters before the first difference and all after it. Each word goes to
shards by what it shares with such a partner: those whose words have the same first half (the difference comes later) and those whose words have the same second half. A shard
with very many words is split by the next half of what differs, until the shared parts are long enough. In a shard, a trie of what is not shared is walked level by level with the active nodes
of all its nodes: those at distance one, which begin as siblings, or as parent and child, and then go down by equal characters. Terminals that meet are the pairs.
"""

from __future__ import annotations

import hashlib
import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, slim, sorted_chunks, written

LETTERS = re.compile("[a-zÀ-ÿ]+")
HELD = 200_000  # distinct words a task counts before it hands them on
CROWD = 4096  # words of a shard that is not split
LONG = 96  # words of more characters get shards of SPAN positions, known by digests of what is shared
SPAN = 48


def _runs(text: str):
    """Maximal runs of letters, A-Z in lower case."""
    return LETTERS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _counted(least: int, every: int | None):
    """Over rows of id and text: words of at least ``least`` characters and how often they occur, in parts."""

    def over(batches):
        held: dict[str, int] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": list(held), "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return frame

        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"]):
                own: dict[str, int] = {}
                for w in _runs(text or ""):
                    if len(w) >= least:
                        own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    if every:
                        h = crc32(f"{key}:{w}".encode())
                        if h % every == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                            if len(w) < least:
                                continue
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()
        slim()

    return over


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_n: int = 2, every: int | None = None) -> DataFrame:
    """``word, n`` of all words of at least ``least`` characters that occur ``least_n`` times or more in the whole texts.

    With ``every``, of each word whose crc32 of ``id:word`` it divides a character is lost (the one at that number modulo the length), as a slip of the pen would do it.
    Null texts have no words; a null id reads as the empty text.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    parts = rows.mapInPandas(_counted(least, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def shards_of(word: str, least: int = 1) -> list[tuple[str, int, int, bool, str]]:
    """Where a word meets its partners: (key, from, length of what differs, is it the longer word?, what is not shared).

    A word of L characters meets words of its length and longer ones in shards of class L, shorter ones in those of class L - 1. For a class m and positions a to b of the first difference,
    what is shared are the first a and the last m - b characters.
    """
    out = []
    size = len(word)
    long = size > LONG
    for m, longer in ((size, False), (size - 1, True)):
        if m < least:
            continue
        # Classes up to LONG - 1 are halved, larger ones cut into spans, by the class alone, so both words of a pair agree.
        cuts = [0, (m + 1) // 2, m + 1] if m < LONG else [*range(0, m + 1, SPAN), m + 1]
        if long:
            heads, tails = _digests(word, cuts), _digests(word[::-1], [max(m - b, 0) for b in cuts])
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            tail = max(m - b, 0)
            if m < LONG:
                key = f"{m}:{a}:{word[:a]}:{word[size - tail :]}"
            elif long:
                key = f"{m}:{a}:{heads[k]}:{tails[k + 1]}"
            else:  # the longest short word, in a class of long ones
                key = f"{m}:{a}:{_digest(word[:a])}:{_digest(word[size - tail :][::-1])}"
            out.append((key, a, b - a, longer, word[a : size - tail]))
    return out


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _digests(text: str, lengths: list[int]) -> list[str]:
    """Digests of the beginnings of ``text`` of some lengths, each read once."""
    out, h, at = {}, hashlib.blake2b(digest_size=16), 0
    for n in sorted(set(lengths)):
        h.update(text[at:n].encode("utf-8", "surrogatepass"))
        at = n
        out[n] = h.copy().hexdigest()
    return [out[n] for n in lengths]


def _dealt(least: int):
    def over(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 10_000):
                part = pdf.iloc[at : at + 10_000]
                rows = [(*shard, i, n) for i, word, n in zip(part["id"], part["word"], part["n"]) for shard in shards_of(word, least)]
                yield pd.DataFrame(rows, columns=["key", "start", "span", "longer", "middle", "id", "n"])

    return over


def split(crowded: DataFrame) -> DataFrame:
    """Shards of fewer positions: either the difference comes in the first half of what differs, then the end of the second is shared as well, or later, then the first half is."""
    half = F.expr("span div 2")
    size, later = F.length("middle"), F.col("span") - half
    # The last position of a class has no character of the shorter word, so a tail may be shorter than the positions that it stands for.
    short = size - F.col("longer").cast("int")
    kept = F.greatest(short - half, F.lit(0))
    first = F.struct(
        F.concat("key", F.lit("<"), half.cast("string"), F.lit(":"), F.substring(F.col("middle"), size - kept + 1, kept)).alias("key"),
        F.col("start"),
        half.cast("int").alias("span"),
        F.col("longer"),
        F.substring(F.col("middle"), F.lit(1), size - kept).alias("middle"),
    )
    second = F.struct(
        F.concat("key", F.lit(">"), half.cast("string"), F.lit(":"), F.substring(F.col("middle"), F.lit(1), half)).alias("key"),
        (F.col("start") + half).cast("int").alias("start"),
        later.cast("int").alias("span"),
        F.col("longer"),
        F.substring(F.col("middle"), half + 1, size).alias("middle"),
    )
    return crowded.select(F.explode(F.array(first, second)).alias("s"), "id", "n").select("s.*", "id", "n")


def _children(at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``at``: (number in ``at``, child) of all their children, which lie in ``begin[node]:begin[node + 1]``."""
    n = begin[at + 1] - begin[at]
    who = np.repeat(np.arange(len(at)), n)
    return who, np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(len(who))


def joined(group: np.ndarray, middle: list[str], longer: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y), each pair once, of one group at distance one whose first difference lies within the group's positions; not both of the longer kind.

    The trie of all groups (a root for each) is built and walked a level at a time. ``same`` holds the active pairs of nodes of one level, ``skew`` those of a node and one a level above.
    """
    size = np.array([len(m) for m in middle], np.int64)
    flat = np.frombuffer("".join(middle).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.cumsum(size) - size
    _, node = np.unique(group, return_inverse=True)
    rows = np.arange(len(middle))
    count = int(node.max()) + 1 if len(node) else 0
    limit, weight, ended = np.zeros(count, np.int64), np.bincount(node, minlength=count), np.full(count, -1)
    limit[node] = span
    ended[node[size == 0]] = rows[size == 0]  # the row that ends at a node: rows of a group differ, so there is one at most
    same = skew = np.zeros((0, 2), np.int64)
    above = np.zeros(0, np.int64)  # (parent, character) of this level's nodes, in order
    found: list[np.ndarray] = []
    live, at, depth = rows[size > 0], node[size > 0], 0
    while len(live):
        nodes, inverse = np.unique(at << 21 | flat[first[live] + depth], return_inverse=True)
        parent, chars = nodes >> 21, nodes & ((1 << 21) - 1)
        begin = np.searchsorted(parent, np.arange(count + 1))
        done = size[live] == depth + 1
        ends = np.full(len(nodes), -1)
        ends[inverse[done]] = live[done]
        # Active pairs go down by equal characters: a pair of this level to children of both, a skew pair to a child of one and a node of this level.
        down = []
        for pairs, names in ((same, nodes), (skew, above)):
            who, child = _children(pairs[:, 0], begin)
            sought = pairs[who, 1] << 21 | chars[child]
            place = np.searchsorted(names, sought).clip(max=max(len(names) - 1, 0))
            hit = names[place] == sought if len(names) else np.zeros(0, bool)
            down.append(np.stack((child[hit], place[hit]), 1))
        # New ones where the first difference may lie: siblings (one character for another), a node and its parent (one more character).
        opened = np.flatnonzero((depth < limit) & (weight > 1))
        who, child = _children(opened, begin)
        again, sibling = _children(opened[who], begin)
        pairs = np.stack((child[again], sibling), 1)
        same = np.concatenate((down[0], pairs[pairs[:, 0] < pairs[:, 1]]))
        skew = np.concatenate((down[1], np.stack((child, opened[who]), 1)))
        for x, y in ((ends[same[:, 0]], ends[same[:, 1]]), (ends[skew[:, 0]], ended[skew[:, 1]])):
            both = (x >= 0) & (y >= 0)
            both[both] = ~(longer[x[both]] & longer[y[both]])
            found.append(np.stack((x[both], y[both]), 1))
        above, ended, weight, limit, count = nodes, ends, np.bincount(inverse), limit[parent], len(nodes)
        # Only what has two words below, or is or may become one of an active pair, is followed.
        wanted = weight > 1
        wanted[same.ravel()] = True
        wanted[skew[:, 0]] = True
        wanted[_children(np.unique(skew[:, 1]), begin)[1]] = True
        keep = ~done & wanted[inverse]
        live, at = live[keep], inverse[keep]
        depth += 1
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    # A character beside its like can be taken for the inserted one at several places; the first difference says which shard the pair belongs to.
    own = np.array([middle[x][: span[x]] != middle[y][: span[x]] for x, y in pairs], bool)
    return pairs[own, 0], pairs[own, 1]


def _met(batches):
    for pdf in sorted_chunks(batches, ["key"], 20_000):
        i, n = pdf["id"].to_numpy(), pdf["n"].to_numpy()
        x, y = joined(pdf["group"].to_numpy(), pdf["middle"].tolist(), pdf["longer"].to_numpy(bool), pdf["span"].to_numpy(np.int64))
        if len(x):
            yield pd.DataFrame({"id": np.concatenate((i[x], i[y])), "near": np.concatenate((i[y], i[x])), "near_n": np.concatenate((n[y], n[x]))})
    slim()


def near_pairs(words: DataFrame, least: int = 1, crowd: int = CROWD) -> DataFrame:
    """``id, near, near_n`` of all words (id, word, n; ids and words unique) at distance one, either way round.

    Shards of over ``crowd`` words are split; those of one position hold at most as many words as there are pairs of characters.
    """
    shape = "key string, start int, span int, longer boolean, middle string, id long, n long"
    left = written(words.mapInPandas(_dealt(least), shape), "spelling-shards")
    calm = None
    while True:
        sizes = left.where("span > 1").groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > crowd).select("key", F.lit(True).alias("crowded"))
        sizes = cut(sizes)
        if sizes.isEmpty():
            calm = left if calm is None else calm.unionByName(left)
            break
        marked = left.join(sizes, "key", "left")
        rest = marked.where("crowded is null").drop("crowded")
        calm = rest if calm is None else calm.unionByName(rest)
        left = written(split(marked.where("crowded")), "spelling-shards")
    return calm.repartition("key").sortWithinPartitions("key").mapInPandas(_met, "id long, near long, near_n long")


def variants(vocab: DataFrame, ratio: int = 10, least: int = 1, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary (word, n; words unique and not null).

    ``n_near`` counts the words at distance one. ``form`` is the most frequent of them (ties: the first in code-point order) if it occurs at least ``ratio`` times as often, else null; ``root`` is
    where the forms of forms end, the word itself if it has none. Frequencies grow along a chain of forms, so there are no circles. An empty vocabulary gives an empty result.
    """
    words = written(vocab.select("word", "n").orderBy("word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")  # ids in code-point order
    best = near_pairs(words, least, crowd).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("first"))).alias("best"))
    best = written(best.select("id", "n_near", F.col("best.near_n").alias("near_n"), (-F.col("best.first")).alias("near")), "spelling-near")
    forms = words.join(best, "id").where(F.col("near_n") >= ratio * F.col("n")).select("id", "near", "near_n")
    forms = written(forms, "spelling-forms")
    roots = forms.select("id", F.col("near").alias("root"))
    while True:  # each round doubles how far a root is looked ahead
        up = roots.select(F.col("id").alias("p"), F.col("root").alias("q"))
        roots = cut(roots.join(up, F.col("root") == F.col("p"), "left").select("id", F.coalesce("q", "root").alias("root"), F.col("q").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    named = forms.join(roots.select("id", "root"), "id").join(words.select(F.col("id").alias("near"), F.col("word").alias("form")), "near")
    named = named.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "form", F.col("near_n").alias("form_n"), "root_word")
    out = words.join(best.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
