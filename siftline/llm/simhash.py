"""SimHash near-dedup with BK-trees over Hamming distance.

A fingerprint has 64 bits. If two differ in at most ``radius`` bits and the bits are cut into
``radius + 6`` blocks, they agree on at least six of the blocks; every choice of six blocks is a
shard family, and the bits of the six blocks name the shard. At radius 2 a shard fixes 48 of the
64 bits, so that its tree can never hold more than 2**16 fingerprints, whatever the input. Trees are
therefore built where the shard's fingerprints meet instead of being broadcast: the set of
all fingerprints grows with the corpus, a shard does not.

Equal fingerprints are merged before anything moves, and a shard reports the links that span
its components, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import connected_components, freed, removed, slim, small, sorted_chunks, with_filter, without, written

SEED = 42
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of bytes other than 20 and 09-0D (what bytes.split() splits at)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingle_hashes(w: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, repeats included; fewer words: of the whole sequence."""
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= k:
        return np.array([digest(b" ".join(w), SEED)], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned 64-bit SimHash; zero where there are no words."""
    h = shingle_hashes(words(text), k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``id, fp``: fp is the fingerprint as a signed long. A null text has no words."""

    def of(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
        slim()
        return pd.Series(found)

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(of, "long")(F.col(text_col)).alias("fp"))


class BKTree:
    """Burkhard-Keller tree of integers: a child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, v: int) -> int:
        """Index of the node of v."""
        if not self.value:
            self.value.append(v)
            self.edges.append({})
            return 0
        at = 0
        while True:
            d = (v ^ self.value[at]).bit_count()
            if not d:
                return at
            to = self.edges[at].get(d)
            if to is None:
                self.edges[at][d] = len(self.value)
                self.value.append(v)
                self.edges.append({})
                return len(self.value) - 1
            at = to

    def near(self, v: int, radius: int) -> list[int]:
        """Indexes of all nodes within the radius; only edges d-radius..d+radius are followed."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (v ^ self.value[at]).bit_count()
            if d <= radius:
                found.append(at)
            for e, to in self.edges[at].items():
                if d - radius <= e <= d + radius:
                    todo.append(to)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Index pairs (root, member) that span the components of one shard's values within the radius."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    node_of: list[int] = []
    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = root(i), root(node_of[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
        if tree.add(v) == len(node_of):
            node_of.append(i)
    return [(root(i), i) for i in range(len(values)) if root(i) != i]


def _masks(radius: int) -> list[int]:
    blocks = radius + 6
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    full = (1 << 64) - 1
    return [full & ~sum(block[i] for i in out) for out in combinations(range(blocks), radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """``src, dst`` of ``nodes`` (``rep long, fp long``, fp distinct): links that span, in each shard, what lies within the radius."""
    masks = F.array(*[F.struct(F.lit(i).alias("family"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(_masks(radius))])
    keyed = nodes.select("rep", "fp", F.explode(masks).alias("m")).select(
        F.col("m.family").alias("family"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp", "rep"
    )
    crowded = keyed.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family", "key")
    dealt = keyed.join(crowded, ["family", "key"], "left_semi").repartition("family", "key").sortWithinPartitions("family", "key", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src: list[int] = []
        dst: list[int] = []

        def close(reps: list[np.ndarray], fps: list[np.ndarray]) -> None:
            r, f = np.concatenate(reps), np.concatenate(fps)
            if len(r) == 2:  # the two-node tree, without building it
                if (int(f[0]) ^ int(f[1])).bit_count() <= radius:
                    src.append(int(r[0]))
                    dst.append(int(r[1]))
                return
            for a, b in shard_links(f.tolist(), radius):
                src.append(int(r[a]))
                dst.append(int(r[b]))

        held: tuple | None = None
        reps: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        for pdf in batches:
            fam, key = pdf["family"].to_numpy(), pdf["key"].to_numpy()
            rep, fp = pdf["rep"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            edge = np.flatnonzero((fam[1:] != fam[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(fam)]):
                if a == b:
                    continue
                name = (int(fam[a]), int(key[a]))
                if held is not None and held != name:
                    close(reps, fps)
                    reps, fps = [], []
                held = name
                reps.append(rep[a:b])
                fps.append(fp[a:b])
            if len(src) > 50_000:
                yield pd.DataFrame({"src": src, "dst": dst}, dtype="int64")
                src.clear()
                dst.clear()
        if held is not None:
            close(reps, fps)
        yield pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    return dealt.mapInPandas(run, "src long, dst long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """``id, fp, component_id``: component_id is the smallest id linked directly or through others.

    Documents link when their fingerprints differ in at most ``radius`` bits; null and empty texts have
    fingerprint zero and link like any other. Rows with a null id get a fingerprint but join no component
    (component_id null). Repeated ids and texts are fine; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, k), "simhash")
    nodes = written(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    comp = connected_components(near_links(nodes, radius))
    labels = nodes.join(comp, nodes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("label"))
    return fps.join(labels, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("label")).alias("component_id"))


# Wider groups: shared rare shingles find the candidates, whole shingle sets decide.

SAMPLE, SEEN, COMMON = 8000, 4, 200_000  # documents sampled for common shingles, times seen there, shingles held
BITS, WIDEST = 1024, 1 << 17  # of a set's small bitmap, and of its wide one at most


def _hashes(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles as sorted unsigned 64-bit hashes."""
    return np.unique(shingle_hashes(words(text), k))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``id, set``: the distinct k-word shingles of ``docs`` (``id, text``; no null ids) as 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            yield pd.DataFrame({"id": pdf["id"], "set": [_hashes(t, k).view(np.int64) for t in pdf["text"]]})

    return docs.select("id", "text").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, set array<long>")


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (sorted) that repeat in a sample of about ``SAMPLE`` documents, and how often; bounded by the sample."""
    some = max(1, docs.count() // SAMPLE)
    sets = shingle_sets(docs.where(F.pmod(F.xxhash64("id"), F.lit(some)) == 0), k)
    seen = sets.select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN).toPandas()
    seen = seen.nlargest(COMMON, "n")
    h, n = seen["h"].to_numpy(np.int64).view(np.uint64), seen["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def heads(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """``id, fp, copy, n, head, bits, wide``: the fingerprint, a digest of the shingle set, its size, its first members in an order that all documents share, and bitmaps of it.

    Two sets with a Jaccard similarity of at least ``similarity`` share one of their first ``n - ceil(similarity * n) + 1`` members
    in any common order. The order is by the count in a sample, then by hash, so that what a source repeats comes last; the
    sample decides how many candidates there are, and none is lost by it.
    """
    common, times = common_shingles(docs, k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches):
            fps, copy, size, head, bits, wide = [], [], [], [], [], []
            for t in pdf["text"]:
                h = _hashes(t, k)
                fps.append(fingerprint(t))
                bits.append(_bitmap(h, BITS))
                wide.append(_bitmap(h, min(WIDEST, max(BITS, 1 << (4 * len(h)).bit_length()))))
                copy.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, times[at], 0), kind="stable")]
                head.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "fp": np.array(fps, np.uint64).view(np.int64), "copy": copy, "n": size, "head": head, "bits": bits, "wide": wide})

    return docs.select("id", "text").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long, copy binary, n int, head array<long>, bits binary, wide binary")


def _bitmap(h: np.ndarray, bits: int) -> bytes:
    """A bit for each value of the hashes' leading bits; ``bits`` is a power of two."""
    mark = np.zeros(bits, bool)
    mark[(h >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(mark).tobytes()


def _bitmaps(bits, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, width // 8)


def _folded(bits: bytes, width: int) -> bytes:
    """The bitmap that ``_bitmap`` makes with fewer bits."""
    return np.packbits(np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(8 * width, -1).any(axis=1)).tobytes()


def _may(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Can sets of sizes n and m with the bitmaps x and y be that similar? A bit of one that the other lacks is a member that the other lacks: no is certain."""
    both = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1), m - np.bitwise_count(y & ~x).sum(axis=1))
    return both >= similarity / (1 + similarity) * (n + m) - 1e-9


def plausible(pairs: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a, b``) whose wide bitmaps (``id, n, wide``) leave it possible that they are that similar."""
    x, y = bitmaps.toDF("a", "na", "xa").hint("merge"), bitmaps.toDF("b", "nb", "xb").hint("merge")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small(batches, 1000):
            width = np.minimum(pdf["xa"].map(len), pdf["xb"].map(len))
            for w, part in pdf.groupby(width):
                maps = [_bitmaps([v if len(v) == w else _folded(v, w) for v in part[c]], w) for c in ("xa", "xb")]
                yield part.loc[_may(*maps, part["na"].to_numpy(np.int64), part["nb"].to_numpy(np.int64), similarity), ["a", "b"]]

    return pairs.join(x, "a").join(y, "b").mapInPandas(run, "a long, b long")


CROWD = 4096  # entries of a token that are compared in one place


def rest_pairs(entries: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` (a < b): ids of ``entries`` (``token, id, n, at, c``; ``bitmaps`` has ``id, bits``) that share a token, differ in c, and whose sizes, places and bitmaps allow the similarity.

    The entries of a crowded token are dealt to blocks, and the pairs of blocks to different tasks, so that no task holds a whole crowd.
    """
    share = similarity / (1 + similarity)
    crowds = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(f"m > {CROWD}").select(F.col("token").alias("crowd"), F.ceil(F.col("m") / CROWD).cast("int").alias("blocks"))
    parts = (
        entries.join(crowds.hint("merge"), F.col("token") == F.col("crowd"), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", "id", "n", "at", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        .join(bitmaps.hint("merge"), "id")
    )
    dealt = parts.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sorted_chunks(batches, ["token", "lo", "hi"], 20_000):
            bits = _bitmaps(pdf["bits"], BITS // 8)
            group, rep, c, block = (pdf[x].to_numpy() for x in ("group", "id", "c", "block"))
            apart = (pdf["lo"] != pdf["hi"]).to_numpy()  # pairs within a block are its own group's
            n, left = pdf["n"].to_numpy(np.int64), (pdf["n"] - pdf["at"]).to_numpy(np.int64)
            found: list[pd.DataFrame] = []
            held, off, live = 0, 0, np.arange(len(pdf))
            while len(live):
                off += 1
                live = live[live + off < len(pdf)]
                to = live + off
                live = live[(group[live] == group[to]) & (n[live] >= similarity * n[to] - 1e-9)]  # sizes ascend
                to = live + off
                fit = (c[live] != c[to]) & ~(apart[live] & (block[live] == block[to])) & (np.minimum(left[live], left[to]) >= share * (n[live] + n[to]) - 1e-9)
                i, j = live[fit], to[fit]
                if len(i):
                    near = _may(bits[i], bits[j], n[i], n[j], similarity)
                    x, y = rep[i[near]], rep[j[near]]
                    found.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}))
                    held += len(x)
                if held > 200_000:
                    yield pd.concat(found).drop_duplicates()
                    found, held = [], 0
            if found:
                yield pd.concat(found).drop_duplicates()
        slim()

    return dealt.mapInPandas(run, "a long, b long").distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``src, dst`` of the pairs (``a, b``) whose shingle sets have a Jaccard similarity of at least ``similarity``; two empty sets are alike."""
    left, right = sets.toDF("a", "sa").hint("merge"), sets.toDF("b", "sb").hint("merge")  # one plan at every size
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where((either == 0) | (both >= F.lit(similarity) * either)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def tree_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b`` (a < b): links that span what the shards' BK-trees find within the radius among ``prints`` (``id, fp``), and rows of equal fingerprints with the smallest of their ids."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints")
    equal = prints.join(nodes.hint("merge"), "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return near_links(nodes, radius).toDF("a", "b").where("a < b").unionByName(equal)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, group_id``: documents with near copies, and the smallest id of their group.

    Near copies share ``similarity`` of their ``shingle``-word shingles (Jaccard, words as in ``words``), and no pair of them is missed:
    candidates are what the shards' BK-trees link (see ``tree_pairs``) and, as such a pair may differ in more bits than any radius, what shares one of the rarest
    shingles of both (see ``heads``). Equal sets are merged before. First the links of the trees are verified, and each document that they link to no smaller one against
    the smallest id it meets, then every candidate pair whose ends are still in different groups, so that a large group costs a few
    comparisons a member and not one for each pair. Bitmaps of the sets rule out most candidates before any set moves. Documents without near copies and null ids are not in the result. Null
    texts have no words; documents without words are alike.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    made = written(heads(given, shingle, similarity).withColumn("row", F.xxhash64("id", "copy")), "heads")
    nodes = made.groupBy("copy").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    same = written(made.select("id", "copy", "row").join(nodes.hint("merge"), "copy").where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"), "row"), "copies")
    apart = without(made, "row", same.select("row"))
    bitmaps = apart.select("id", "n", "wide")
    keyed = apart.select("id", "n", F.posexplode("head").alias("at", "token"))

    met = written(keyed.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token"), "tokens")
    meet = written(with_filter(keyed, "token", met, "__sl_met").where("__sl_met").drop("__sl_met").join(met.hint("merge"), "token"), "entries")
    first = meet.groupBy("token").agg(F.min(F.struct("id", "n", "at")).alias("first"))
    entries = meet.join(first.hint("merge"), "token")
    fits = (F.least("n", "first.n") >= similarity * F.greatest("n", "first.n") - 1e-9) & (
        F.least(F.col("n") - F.col("at"), F.col("first.n") - F.col("first.at")) >= similarity / (1 + similarity) * (F.col("n") + F.col("first.n")) - 1e-9
    )
    freed(docs.sparkSession)
    trees = written(tree_pairs(apart.select("id", "fp")), "trees")
    smallest = entries.where((F.col("id") > F.col("first.id")) & fits).groupBy("id").agg(F.min("first.id").alias("a")).select("a", F.col("id").alias("b"))
    best = written(trees.unionByName(smallest.join(trees.select("b").distinct().hint("merge"), "b", "left_anti").select("a", "b")), "pairs")

    def alike(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        # Sets of all that may be the end of a pair, without moving a text; a few more than are asked for do no harm.
        sets = written(shingle_sets(with_filter(given, "id", ends, "__sl_end").where("__sl_end"), shingle), "shingles")
        found = written(similar_pairs(pairs, sets, similarity), "links")
        removed(sets)
        return found

    links = alike(written(plausible(best, bitmaps, similarity), "pairs"))
    freed(docs.sparkSession)
    comp = connected_components(links).toDF("id", "c")
    told = written(meet.join(comp.hint("merge"), "id", "left").withColumn("c", F.coalesce("c", "id")), "entries")
    removed(meet)
    freed(docs.sparkSession)
    mixed = told.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("token")
    some = rest_pairs(told.join(mixed.hint("merge"), "token"), apart.select("id", "bits"), similarity).join(best, ["a", "b"], "left_anti")
    rest = written(plausible(written(some, "pairs"), bitmaps, similarity), "pairs")
    removed(told)
    removed(made)
    freed(docs.sparkSession)
    # The components stand for the links that made them: stars have short ways.
    more = comp.select(F.col("c").alias("src"), F.col("id").alias("dst")).unionByName(alike(rest)).unionByName(same.select("src", "dst"))
    return connected_components(more).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without near copies: of each group the smallest id stays; all columns stay.

    Where ids repeat or are null, rows are told apart by numbers that a written copy gives them, so that no text is lost with another's id; of a group the
    row with the smallest id (null last) and then the smallest number stays. An empty table gives an empty result.
    """
    odd = docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 or id is null")
    if odd.isEmpty():
        gone = near_duplicate_groups(docs, id_col, text_col, **how).where("id <> group_id").select("id")
        return without(docs, id_col, gone)
    rows = written(docs.withColumn("__sl_row", F.monotonically_increasing_id()), "rows")
    groups = written(near_duplicate_groups(rows, "__sl_row", text_col, **how), "groups")
    named = groups.join(rows.select(F.col("__sl_row").alias("id"), F.col(id_col).alias("name")), "id")
    best = named.groupBy("group_id").agg(F.min(F.struct(F.col("name").isNull(), F.col("name"), F.col("id"))).getField("id").alias("best"))
    gone = named.join(best, "group_id").where("id <> best").select("id")
    return without(rows, "__sl_row", gone).drop("__sl_row")
