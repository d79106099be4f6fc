"""Helpers that the corpus operators share: folders, tables, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of working columns, so that they cannot clash with a caller's columns.
OWN = "__sl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (a local test) a temporary one is made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="siftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application that goes when it ends."""
    own = f"{shared_dir(spark)}/siftline-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def slim() -> None:
    """In a worker: give memory that is free back to the system, as workers live on and share a machine's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def small(batches, most: int = 500):
    """The batches in parts, so that a worker holds what it makes of few rows at once."""
    for pdf in batches:
        for at in range(0, len(pdf), most):
            yield pdf.iloc[at : at + most].reset_index(drop=True)
    slim()


#: Bits of a filter over keys: 16 for each key, 128 KiB at least and 32 MiB at most, in pieces of 4 KiB. With over 2**28 / 16 keys it lets more rows pass that need not.
LEAST_BITS, MOST_BITS, PIECE_BITS = 1 << 20, 1 << 28, 1 << 15


def with_filter(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` and a boolean ``name``: may its ``key`` be among ``keys`` (one column)? False is certain, true is not; a null key is false.

    The filter is a bitmap, as wide as the number of keys asks for and bounded, that every machine gets, so the rows themselves do not move.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    piece = lambda c: F.floor(place(c) / PIECE_BITS).cast("int")
    own = keys.columns[0]
    pieces = keys.where(F.col(own).isNotNull()).groupBy(piece(F.col(own)).alias(f"{OWN}piece")).agg(F.bitmap_construct_agg(F.pmod(place(F.col(own)), F.lit(PIECE_BITS))).alias(f"{OWN}bits"))
    bit = F.pmod(place(F.col(key)), F.lit(PIECE_BITS))
    held = rows.withColumns({f"{OWN}at": F.when(F.col(key).isNotNull(), piece(F.col(key))), f"{OWN}bit": bit}).join(F.broadcast(pieces), F.col(f"{OWN}at") == F.col(f"{OWN}piece"), "left")
    byte = F.conv(F.hex(F.expr(f"substring({OWN}bits, cast({OWN}bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(f"{OWN}bit", F.lit(8)))), F.lit(2)) == 1
    return held.withColumn(name, F.coalesce(hit, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (one column); rows with a null key stay.

    Rows that the filter clears stay where they were read; only the others meet ``gone`` in a join.
    """
    asked = with_filter(rows, key, gone, f"{OWN}maybe")
    clear, maybe = asked.where(f"not {OWN}maybe").drop(f"{OWN}maybe"), asked.where(f"{OWN}maybe").drop(f"{OWN}maybe")
    named = gone.toDF(f"{OWN}gone").hint("merge")  # one plan at every size
    return clear.unionByName(maybe.join(named, F.col(f"`{key}`") == F.col(f"{OWN}gone"), "left_anti"))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written files replace the lineage: a lost executor costs a re-read,
    not a re-computation of everything before.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``, once nothing reads it any more."""
    jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let go of the shuffles, broadcasts and checkpoints of steps that are over: Spark's cleaner drops them from the driver and its machines only after the driver has collected its garbage."""
    gc.collect()  # frames that Python still holds
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: str, max_rows: int, max_bytes: int) -> tuple[list[str | None], list[int]]:
    """Whole texts and 0/1 labels of at most ``max_rows`` ids and about ``max_bytes`` bytes, in the order of a hash of the id.

    Rows for which the SQL ``held_out`` is true are never read. Null ids and labels, and ids with two different labels, teach nothing; of an id
    with several texts the one with the smallest hash is taken, so the bounds hold however often an id occurs.
    """
    one = (
        labels.where(f"doc_id is not null and {label_col} in (0, 1) and not ({held_out})")
        .groupBy("doc_id")
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
        .where("y = z")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select("doc_id", "y")
    )
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size")).alias("of"))
    found = sized.join(F.broadcast(one), "doc_id").groupBy("doc_id", "y").agg(F.min("of").alias("of")).select("doc_id", "y", "of.size")
    ids, total = {}, 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most max_rows
        if total + r["size"] <= max_bytes or not ids:
            ids[r["doc_id"]] = r["y"]
            total += r["size"]
    if not ids:
        return [], []
    wanted = docs.sparkSession.range(1).select(F.explode(F.lit(list(ids))).alias("doc_id"))
    picked = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size"), text.alias("text")).alias("of")).join(F.broadcast(wanted), "doc_id")
    rows = sorted(picked.groupBy("doc_id").agg(F.min("of").alias("of")).select("doc_id", "of.text").collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [ids[r["doc_id"]] for r in rows]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that has an edge; component is the smallest node reachable.

    ``edges`` has long columns ``src, dst``; null ends, loops, repeats and either direction are fine.
    Each round points every node at its smallest neighbour, follows these pointers to their roots, three times as far
    with each step, and contracts the graph to the roots. A star of any size is two grouped minima and a join that AQE may split; no
    node's neighbours are gathered. Jobs are few, as the driver keeps what Spark knows of each. An empty graph gives an empty table.
    """
    e = cut(
        edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .where("a < b")
        .distinct()
    )
    found = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a")).toDF("u", "v")
        roots = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("r")))
        while True:
            once, twice = roots.toDF("p", "q"), roots.toDF("p2", "q2")
            nxt = cut(roots.join(once, F.col("r") == F.col("p")).join(twice, F.col("q") == F.col("p2")).select("u", F.col("q2").alias("r"), (F.col("q2") < F.col("q")).alias("moved")))
            roots = nxt.drop("moved")
            if nxt.where("moved").isEmpty():  # pointers only descend, so where the second look finds no more, the first has found a root
                break
        if found is None:
            found = roots.toDF("node", "component")
        else:
            up = roots.toDF("p", "q")
            found = cut(found.join(up, F.col("component") == F.col("p"), "left").select("node", F.coalesce("q", "component").alias("component")))
        a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        e = cut(
            e.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()
        )
        freed(e.sparkSession)
    return found if found is not None else e.toDF("node", "component")


def sorted_chunks(batches, keys: list[str], least: int):
    """Frames of at least ``least`` rows out of a sorted stream, cut only between groups of equal ``keys``; ``group`` numbers the groups."""
    import numpy as np
    import pandas as pd

    held: list = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < least:
            continue
        whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        new = _starts(whole, keys)
        last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
        if last:
            yield whole.iloc[:last].assign(group=np.cumsum(new[:last])).reset_index(drop=True)
        held = [whole.iloc[last:].reset_index(drop=True)]
        size = len(held[0])
    if held:
        whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        yield whole.assign(group=np.cumsum(_starts(whole, keys))).reset_index(drop=True)


def _starts(pdf, keys: list[str]):
    import numpy as np

    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        x = pdf[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new
