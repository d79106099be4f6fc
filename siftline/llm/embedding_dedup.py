"""Embedding near-dedup: cross-polytope hashing with multiprobe buckets and verified pairs.

A table rotates the unit vectors by three rounds of random signs and a fast Hadamard transform and takes the nearest
signed axis; ``k`` such hashes name a bucket. A vector lives in its own bucket of every table and also visits the
buckets of its second-best axes. Two vectors meet where one lives and the other lives or visits, and a pair counts in
the first place of all at which it meets, so nothing is counted twice. Every pair that meets is verified in double precision.

Equal vectors are merged first and carry their number. A bucket larger than a block is dealt into blocks, and its pairs of
blocks go to different tasks; a task reports sums and spanning links, never pairs. ``k`` follows the largest
label, so that buckets keep their size as the input grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import connected_components, sorted_chunks, written

BLOCK = 1024
SMALL = 64  # rows of a group whose pairs are formed together with those of others
CHUNK = 8192  # rows verified at once
PER_BUCKET = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codes(vectors: np.ndarray, tables: int, k: int, seed: int) -> np.ndarray:
    """Bucket codes [vector, table, probe]; probe 0 is the vector's own bucket."""
    n, dim = vectors.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = vectors
    probes = 2**k if k > 1 else 3
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best = []
        for j in range(k):
            signs = np.random.default_rng([seed, t, j, d]).choice([-1.0, 1.0], (3, d))
            y = x
            for s in signs:
                y = hadamard(y * s)
            take = min(3 if k == 1 else 2, d)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :take]
            best.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
        if k == 1:
            out[:, t, : best[0].shape[1]] = best[0]
            out[:, t, best[0].shape[1] :] = -1
        else:
            for p, choice in enumerate(product((0, 1), repeat=k)):
                code = np.zeros(n, np.int64)
                for j, c in enumerate(choice):
                    code = code * (2 * d) + best[j][:, min(c, best[j].shape[1] - 1)]
                out[:, t, p] = code
    return out


def usable(vec: Column) -> Column:
    """Not null, some component not zero, all components finite."""
    vec = vec.cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _met_before(a: np.ndarray, b: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For pairs of code rows [pair, table, probe]: do they meet at an earlier place than (table, code)? Own buckets are never -1."""
    out = np.zeros(len(a), bool)
    for t in range(a.shape[1]):
        ha, hb = a[:, t, 0], b[:, t, 0]
        at_a = (b[:, t, :] == ha[:, None]).any(axis=1)
        at_b = (a[:, t, :] == hb[:, None]).any(axis=1)
        out |= np.where(t < table, at_a | at_b, (t == table) & ((at_a & (ha < code)) | (at_b & (hb < code))))
    return out


def _close_pairs(vec: np.ndarray, group: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group with at least the cosine; groups are runs of rows.

    Small groups are handled together, a distance between rows at a time; a large one by products of its slices.
    """
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    for at, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        for x in range(at, at + n, 512):
            i, j = np.nonzero(vec[x : min(x + 512, at + n)] @ vec[x : at + n].T >= cosine)
            yield x + i[i < j], x + j[i < j]
    live = np.flatnonzero(np.repeat(size <= SMALL, size))
    for off in range(1, SMALL):
        live = live[live + off < len(group)]
        live = live[group[live] == group[live + off]]
        if not len(live):
            break
        for x in range(0, len(live), 1 << 16):
            i = live[x : x + (1 << 16)]
            near = np.einsum("ij,ij->i", vec[i], vec[i + off]) >= cosine
            yield i[near], i[near] + off


def links_of(p: pd.DataFrame, cosine: float, shape: tuple[int, int]) -> pd.DataFrame:
    """``id, links, root``: sums of links, and links (root, id) that span, of rows sorted by their group, all vectors equally long."""
    vec = unit(np.stack(p["vec"].to_numpy()).astype(float))
    held = np.stack(p["codes"].to_numpy()).reshape(len(p), *shape)
    table, code, block = p["tab"].to_numpy(), p["code"].to_numpy(), p["block"].to_numpy()
    copies, ids, apart = p["n"].to_numpy(), p["num"].to_numpy(), (p["lo"] != p["hi"]).to_numpy()
    home = held[np.arange(len(p)), table, 0] == code
    count, label = np.zeros(len(p), np.int64), np.arange(len(p))
    for i, j in _close_pairs(vec, p["group"].to_numpy(), cosine):
        ok = (home[i] | home[j]) & ~(apart[i] & (block[i] == block[j]))  # pairs within a block are its own group's
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            new = ~_met_before(held[a], held[b], table[a], code[a])
            a, b = a[new], b[new]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            while len(a):  # join the labels of linked rows until nothing moves
                low = np.minimum(label[a], label[b])
                if (low == label[a]).all() and (low == label[b]).all():
                    break
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                label = label[label]
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
    for _ in range(len(label).bit_length()):
        label = label[label]
    hit, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(p)))
    return pd.DataFrame(
        {"id": np.concatenate((ids[hit], ids[moved])), "links": np.concatenate((count[hit], np.zeros(len(moved), np.int64))), "root": [None] * len(hit) + ids[label[moved]].tolist()}
    )


def vector_components(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    seed: int = 8,
) -> DataFrame:
    """``id, n_links, component_id``: a row for each row of ``vectors``.

    Vectors are compared only when their labels are equal and not null (``label_col`` None: all) and their lengths are equal. Null and
    zero vectors and those with null or non-finite components link with nothing. Links need a cosine of at least ``cosine``; the
    search is approximate, and the tests hold its recall against brute force. component_id is the smallest id
    reachable, the row's own where there are no links (and null for a null id, which also links with nothing). An id
    with several vectors has a row for each: vectors link, not ids. An empty table gives an empty result.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    good = rows.where(usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # Distinct vectors have numbers of their own: an id may have several vectors, and several ids one.
    merged = written(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("num", F.monotonically_increasing_id()), "vectors")
    stats = merged.groupBy("label", F.size("vec").alias("dim")).count().agg(F.max("count"), F.max("dim")).first()
    largest, dim = stats[0] or 1, stats[1] or 1
    d = 1 << max(1, (dim - 1).bit_length())
    k = max(1, math.ceil(math.log(max(1, largest / PER_BUCKET)) / math.log(2 * d)))
    tables = 2 + 3 * k
    probes = 2**k if k > 1 else 3

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                for _, p in part.groupby(part["vec"].map(len)):
                    c = codes(unit(np.stack(p["vec"].to_numpy()).astype(float)), tables, k, seed)
                    for q in range(1, probes):  # a bucket is visited once
                        c[:, :, q][(c[:, :, q, None] == c[:, :, :q]).any(axis=2)] = -1
                    out = p[["num"]].copy()
                    out["codes"] = list(c.reshape(len(p), -1))
                    yield out

    placed = written(merged.select("num", "vec").mapInPandas(place, "num long, codes array<long>"), "vector-codes")
    rows_of = merged.join(placed, "num").withColumn("dim", F.size("vec"))
    # Buckets are counted by codes alone; vectors move only for buckets in which two meet.
    key = ["tab", "label", "dim", "code"]
    entries = (
        rows_of.select("label", "dim", "num", F.posexplode("codes").alias("pos", "code"))
        .where("code >= 0")
        .select("label", "dim", "num", F.floor(F.col("pos") / probes).cast("int").alias("tab"), "code", (F.col("pos") % probes == 0).alias("home"))
    )
    sizes = (
        entries.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("lived"))
        .where("rows > 1 and lived")
        .select(*key, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    )
    alive = entries.join(sizes, key).select("tab", "code", "blocks", "num")
    # A row meets every block of its bucket: as the lower half of a pair of blocks, or as the upper one.
    dealt = (
        alive.join(rows_of.select("label", "dim", "num", "n", "vec", "codes"), "num")
        .withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
    )
    group = [*key, "lo", "hi"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in sorted_chunks(batches, group, CHUNK):
            for _, p in whole.groupby("dim"):
                yield links_of(p.reset_index(drop=True), cosine, (tables, probes))

    partial = written(
        dealt.select(*group, "block", "num", "n", "vec", "codes").repartition(*group).sortWithinPartitions(*group, "num").mapInPandas(verify, "id long, links long, root long"),
        "vector-links",
    )
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(partial.where("root is not null").select(F.col("root").alias("src"), F.col("id").alias("dst")))
    # A component is known by a number; its name is the smallest id of its vectors.
    names = comp.join(merged.select(F.col("num").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("name"))
    named = comp.join(names, "component").select(F.col("node").alias("num"), "name")
    found = (
        merged.join(links.withColumnRenamed("id", "num"), "num", "left")
        .join(named, "num", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("name", "rep").alias("component_id"))
    )
    linked = good.join(found, ["label", "vec"]).select("id", "n_links", "component_id")
    rest = rows.where(~usable(F.col("vec")) | F.col("label").isNull() | F.col("id").isNull())
    return linked.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
