"""Gate 0: what must not be touched for structural reasons, and how it could be got back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.sources.lineage import large

#: Recoverability classes from safest to least, and in own words how far back one would have to go for the content.
RUNGS = {"TRACKED_PUSHED": "a remote has the commit", "TRACKED_UNPUSHED": "only this clone has the commit", "UNTRACKED": "git never had it: a backup, if there is one", "IGNORED": "git was told not to have it: a backup, if there is one"}


def boundaries(entries: DataFrame) -> DataFrame:
    """``dir, boundary``: directories that are repositories of their own; the root is none.

    ``entries(path, kind (dir, file, symlink), content, read_status)``. A ``.git`` directory is a nested clone, any other ``.git`` a git file, and a HEAD beside
    objects and refs a bare repository; what could not be read is a boundary, too.
    """
    e = entries.select(paths.parent(F.col("path")).alias("dir"), paths.basename(F.col("path")).alias("name"), "kind", "content", "read_status")
    g = e.where("name in ('.git', 'HEAD', 'objects', 'refs')").groupBy("dir").agg(
        F.max(F.when(F.col("name") == ".git", F.col("kind"))).alias("git"),
        F.max(F.when(F.col("name") == ".git", F.col("read_status"))).alias("git_status"),
        F.max(F.when((F.col("name") == "HEAD") & (F.col("kind") == "file"), F.struct("read_status", "content"))).alias("head"),
        F.bool_or((F.col("name") == "objects") & (F.col("kind") == "dir")).alias("objects"),
        F.bool_or((F.col("name") == "refs") & (F.col("kind") == "dir")).alias("refs"),
    )
    line = F.trim(F.split(F.substring("head.content", 1, 64), "\n")[0])
    bare = F.col("objects") & F.col("refs") & F.col("head").isNotNull()
    kind = (
        F.when(F.col("git_status") == "errored", "unreadable")
        .when(F.col("git") == "dir", "nested_clone")
        .when(F.col("git").isNotNull(), "git_file")
        .when(bare & (F.col("head.read_status") != "completed"), "unreadable")
        .when(bare & (F.startswith(line, F.lit("ref: ")) | line.rlike("^[0-9a-fA-F]{40}$")), "bare")
    )
    return g.select("dir", kind.alias("boundary")).where("boundary is not null and dir <> ''")


def under_boundary(files: DataFrame, found: DataFrame) -> DataFrame:
    """``files`` and ``boundary``: the outermost repository boundary a path lies under, null if none. An ancestor equi-join."""
    up = files.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("level", "dir"))
    hit = up.join(found, "dir").groupBy("path").agg(F.min_by("dir", "level").alias("boundary"))
    return files.join(hit, "path", "left")


def _keys(df: DataFrame) -> list[str]:
    """Trees are kept apart by ``repo`` where there is such a column."""
    return ["repo"] if "repo" in df.columns else []


def gate_0a(candidates: DataFrame, links: DataFrame, store: str | DataFrame) -> DataFrame:
    """``candidate, verdict, conditions``: symlinks on the way, a link with a trailing separator, a link that resolves, a dangling one beside a content store.

    ``links(path, resolves)`` are the symlinks; ``store`` is present, absent or unreadable, and only absent lets a dangling link be reported. With a column
    ``repo`` in all three, ``store`` being a table (repo, store), trees are judged apart; a tree without a row has an unreadable store.
    """
    keys = _keys(candidates)
    path = paths.strip_trailing_separators(F.col("path"))
    c = candidates.select(*keys, "candidate", path.alias("bare"), (path != F.col("path")).alias("separator"))
    c = c.withColumn("store", F.lit(store)) if isinstance(store, str) else large(c).join(store.select(*keys, "store"), keys, "left").withColumn("store", F.coalesce("store", F.lit("unreadable")))
    up = c.select(*keys, "candidate", "bare", F.explode(F.array_distinct(paths.ancestors(F.col("bare")))).alias("path")).where("path <> bare and path <> ''")
    on_way = large(up).join(links.select(*keys, "path"), [*keys, "path"]).groupBy(*keys, "candidate").agg(F.min("path").alias("linked_ancestor"))
    own = links.select(*keys, F.col("path").alias("bare"), "resolves", F.lit(True).alias("is_link"))
    j = large(large(c).join(on_way, [*keys, "candidate"], "left")).join(own, [*keys, "bare"], "left")
    conditions = F.filter(
        F.array(
            F.when(F.col("linked_ancestor").isNotNull(), "linked_ancestor"),
            F.when(F.col("is_link") & F.col("separator"), "trailing_separator_on_link"),
            F.when(F.col("is_link") & F.col("resolves"), "resolving_link"),
            F.when(F.col("is_link") & ~F.col("resolves") & (F.col("store") != "absent"), "dangling_link_with_store"),
        ),
        lambda x: x.isNotNull(),
    )
    verdict = F.when(~F.startswith("bare", F.lit("/")) | F.col("bare").isNull(), "unreadable").when(F.col("is_link") & F.col("resolves").isNull(), "unreadable").when(F.size(conditions) > 0, "refuses").otherwise("clear")
    return j.select(*keys, "candidate", verdict.alias("verdict"), conditions.alias("conditions"))


def gate_0e(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """``candidate, verdict, relations``: a candidate is, lies inside or contains a protected region (absolute paths, component boundaries).

    ``regions(region, region_path)`` are the stores of a repository, with ``repo`` of many. No region at all means they could not be asked for: unreadable. A relative or null path, too.
    Both directions are equi-joins of one side with the directories above the other.
    """
    keys = _keys(candidates)
    plain = lambda c: F.regexp_replace(c, "/+$", "")
    c = candidates.select(*keys, "candidate", plain(F.col("path")).alias("path"), F.col("path").alias("as_given"))
    r = regions.select(*keys, "region", plain(F.col("region_path")).alias("region_path"))
    up = c.where("as_given like '/%'").select(*keys, "candidate", "path", F.explode(F.array_distinct(paths.ancestors(F.col("path")))).alias("region_path"))
    at = large(up).join(r, [*keys, "region_path"]).select(*keys, "candidate", "region", F.when(F.col("path") == F.col("region_path"), "is").otherwise("inside").alias("relation"))
    down = r.select(*keys, "region", "region_path", F.explode(F.array_distinct(paths.ancestors(F.col("region_path")))).alias("path")).where("path <> region_path")
    over = large(c.where("as_given like '/%'")).join(down, [*keys, "path"]).select(*keys, "candidate", "region", F.lit("contains").alias("relation"))
    hits = at.unionByName(over).groupBy(*keys, "candidate").agg(F.array_sort(F.collect_list(F.struct("region", "relation"))).alias("relations"))
    j = large(c).join(hits, [*keys, "candidate"], "left")
    if keys:
        j = large(j).join(regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        j = j.crossJoin(F.broadcast(regions.agg(F.count(F.lit(1)).alias("n"))))  # one row
    verdict = F.when((F.col("n") == 0) | ~F.coalesce(F.col("as_given").like("/%"), F.lit(False)), "unreadable").when(F.col("relations").isNotNull(), "refuses").otherwise("clear")
    return j.select(*keys, "candidate", verdict.alias("verdict"), F.when(verdict == "refuses", F.col("relations")).alias("relations"))


def recoverability(candidates: DataFrame, status: DataFrame, head_on_remote: bool | None) -> DataFrame:
    """``candidate, class, rung``: tracked and pushed, tracked only, ignored, untracked; null where git gave no answer."""
    j = candidates.join(status.select("path", "tracked", "ignored"), "path", "left")
    tracked = F.when(F.lit(head_on_remote).cast("boolean").isNull(), None).when(F.lit(bool(head_on_remote)), "TRACKED_PUSHED").otherwise("TRACKED_UNPUSHED")
    kind = F.when(F.col("tracked"), tracked).when(F.col("tracked").isNull(), None).when(F.col("ignored"), "IGNORED").otherwise("UNTRACKED")
    rung = F.create_map(*[F.lit(x) for kv in RUNGS.items() for x in kv])
    return j.select("candidate", kind.alias("class"), F.try_element_at(rung, kind).alias("rung"))
