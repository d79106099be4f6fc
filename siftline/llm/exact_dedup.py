"""Exact dedup: a log-structured merge index over text digests.

Each task is a memtable: it sorts the digests of its rows and flushes them as a file of a level-0 run, whose Parquet footers hold a Bloom filter and
min/max bounds of the digest. One job flushes several runs. Compaction merges runs, tier by tier, into sorted runs of the next level with one entry a
digest (smallest and largest identifier, count), until one is left; its entries with a count over one are the hits.

Hits receive byte verification: the hits' filter, a bitmap that every machine gets, is probed with the digests of all rows, and the texts behind those that
pass are grouped by digest and text, so that two texts that share a digest stay two. Everything is DataFrame operations; texts are hashed where they lie,
and only texts that pass the filter move, after equal ones were merged in each task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import new_path, with_filter, without, written

OWN_DIGEST, OWN_KEY, OWN_TEXT = "__sl_digest", "__sl_key", "__sl_text"


def sha256(text: Column) -> Column:
    """The digest of a text's UTF-8 bytes, as binary."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """LSM index ``digest -> identifiers`` in a folder that all machines share.

    ``flush`` appends level-0 runs, ``compact`` merges runs up to one, ``hits`` are the digests met more than once, ``lookup`` probes one digest.
    Identifiers may repeat and be null (null identifiers are ignored by min and max).
    """

    #: Level-0 runs of one flush, and runs merged at once.
    RUNS, TIER = 8, 4

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "lsm")
        self.levels: list[list[str]] = [[]]
        self.flushes = 0

    def _sorted(self, rows: DataFrame, path: str, by: str | None = None) -> None:
        writer = rows.sortWithinPartitions(*([by] if by else []), "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        (writer.partitionBy(by) if by else writer).parquet(path)

    def flush(self, entries: DataFrame) -> DataFrame:
        """Write ``id, digest`` (digest binary) as sorted runs with filters, all in one pass; returns what was written."""
        base = f"{self.path}/flush-{self.flushes:04d}"
        self.flushes += 1
        self._sorted(entries.select("id", "digest", F.pmod(F.spark_partition_id(), F.lit(self.RUNS)).alias("run")), base, "run")
        schema = entries.select("id", "digest").schema
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        there = [f.getPath().toString() for f in files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files) if "run=" in f.getPath().getName()]
        self.levels[0] += sorted(there)
        return self.spark.read.schema(schema).parquet(base)

    def _run(self, path: str, level: int) -> DataFrame:
        rows = self.spark.read.parquet(path)
        if level:
            return rows
        one = F.col("id")
        return rows.select("digest", one.alias("smallest"), one.alias("largest"), F.lit(1).cast("long").alias("n"))

    def compact(self) -> DataFrame:
        """``digest, smallest, largest, n``: one row a digest, merged from all runs into a written run.

        At most ``TIER`` runs are merged at once, and their merged runs on the level above, until one is left. Rows of one digest are merged
        in each task first, so a digest with a third of all rows reaches a merge as one row a task.
        """
        level = 0
        while len(self.levels[level]) > 1 or level == 0 and self.levels[0]:
            runs, above = self.levels[level], []
            for at in range(0, len(runs), self.TIER):
                parts = [self._run(p, level) for p in runs[at : at + self.TIER]]
                rows = parts[0]
                for p in parts[1:]:
                    rows = rows.unionByName(p)
                merged = rows.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
                above.append(f"{self.path}/level-{level + 1}-{at // self.TIER:05d}")
                self._sorted(merged, above[-1])
            level += 1
            self.levels[level:] = [above]
        if level == 0:
            return self.spark.createDataFrame([], "digest binary, smallest long, largest long, n long")
        return self._run(self.levels[level][0], level)

    def lookup(self, digest: bytes) -> DataFrame:
        """The merged entry of one digest; the run's filters and bounds skip the files without it."""
        level = len(self.levels) - 1
        return self._run(self.levels[level][0], level).where(F.col("digest") == F.lit(digest))


def maybe_hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose ``digest`` may be among ``hits``: all that are, and few others."""
    return with_filter(rows, "digest", hits, "__sl_hit").where("__sl_hit").drop("__sl_hit")


def _verified(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``rows`` (id, text, digest), ``flushed`` (id, digest), ``plain`` (digest, keep_id, group_size: digests of one text that repeats) and ``clashes`` (digest,
    text, keep_id, group_size: digests of several texts)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"))
    index = DigestIndex(docs.sparkSession)
    flushed = index.flush(rows.select("id", "digest"))
    hits = index.compact().where("n > 1").select("digest")
    texts = maybe_hit(rows, hits).groupBy("digest", "text").agg(F.min("id").alias("smallest"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
    # Only a digest with several texts needs them again.
    verdict = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n")), "verified")
    plain = verdict.where("texts = 1 and n > 1").select("digest", F.col(keep).alias("keep_id"), F.col("n").alias("group_size"))
    several = verdict.where("texts > 1").select("digest")
    clashes = texts.join(several, "digest", "left_semi").select("digest", "text", F.col(keep).alias("keep_id"), F.col("n").alias("group_size"))
    return rows, flushed, plain, clashes


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: ``id, digest (binary), keep_id, group_size, kept``.

    Two texts are equal when their UTF-8 bytes are, whatever their digests say; a null text counts as empty. ``keep`` names the
    identifier that stays, "smallest" or "largest"; where rows share an identifier and a text, all
    of these rows count as kept. Null identifiers form groups with their texts but never win against
    an identifier; a group of null identifiers only has ``keep_id`` null and is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    rows, flushed, plain, clashes = _verified(docs, id_col, text_col, keep, digest)
    collided = clashes.select("digest").distinct()
    out = flushed.join(plain, "digest", "left").select(
        "id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )
    if not collided.isEmpty():
        told = rows.join(collided, "digest", "left_semi").join(clashes, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        out = out.join(collided, "digest", "left_anti").unionByName(told)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with one row for each text; all columns stay.

    The row with the smallest (or largest) identifier stays; null identifiers lose against others. Rows are told apart by identifier and text, so
    an identifier that several texts have costs none of them; where rows share both, any one of them stays. An empty table gives an empty result.
    """
    rows, flushed, plain, clashes = _verified(docs, id_col, text_col, keep, digest)
    key = lambda i, d: F.concat(d, F.coalesce(F.concat(F.lit(b"="), i.cast("string").cast("binary")), F.lit(b"")))
    members = flushed.join(plain, "digest").select(key(F.col("id"), F.col("digest")).alias("key"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
    members = written(members, "members")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn(OWN_KEY, key(F.col(id_col), digest(text)))
    left = without(named, OWN_KEY, members.where("not kept").select("key").distinct())
    repeated = members.where("kept").groupBy("key").count().where("count > 1").select("key")
    if not repeated.isEmpty():
        again = repeated.toDF("__sl_again")
        same = left.join(again, F.col(OWN_KEY) == F.col("__sl_again"), "left_semi").dropDuplicates([OWN_KEY])
        left = left.join(again, F.col(OWN_KEY) == F.col("__sl_again"), "left_anti").unionByName(same)
    collided = clashes.select(F.col("digest").alias("__sl_clash")).distinct()
    if not collided.isEmpty():
        told = docs.withColumns({OWN_DIGEST: digest(text), OWN_TEXT: text})
        clash = told.join(collided, F.col(OWN_DIGEST) == F.col("__sl_clash"), "left_semi")
        winners = clashes.select(F.col("text").alias("__sl_winner"), F.col("keep_id").alias("__sl_keep"))
        won = clash.join(winners, (F.col(OWN_TEXT) == F.col("__sl_winner")) & F.col(id_col).eqNullSafe(F.col("__sl_keep"))).dropDuplicates([OWN_TEXT])
        left = left.withColumn(OWN_DIGEST, digest(text)).join(collided, F.col(OWN_DIGEST) == F.col("__sl_clash"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
        return left.unionByName(won.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return left.drop(OWN_KEY)
