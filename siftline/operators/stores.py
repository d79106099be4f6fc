"""Where the git directories and content stores of trees are, told from path rows alone.

A tree's ``.git`` may be a directory, a file that points to one, or a link; the directory it leads to may say that another one holds the objects. Each pointer is followed by
an equi-join, for all trees at once. A pointer that leads nowhere or cannot be read makes its own tree unreadable, no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.sources.lineage import kept, large

# The protected regions.
REGIONS = ("git_dir", "common_dir", "lfs_store", "annex_store")
NAMES = (".git", ".dvc", "HEAD", "objects", "commondir", "config", "annex")
#: 2**ROUNDS links in a row are followed; more, or a circle, lead nowhere.
ROUNDS = 6


def _through(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Of ``rows`` (repo, asked, now) those with a link on the way of ``now``, seen through the outermost one; null where that leads into a circle."""
    up = rows.select("repo", "asked", "now", F.posexplode(F.array_distinct(paths.ancestors(F.col("now")))).alias("level", "link"))
    hit = up.join(large(links), ["repo", "link"]).groupBy("repo", "asked", "now").agg(F.min_by(F.struct("link", "target"), "level").alias("hit"))
    return hit.select("repo", "asked", F.concat("hit.target", F.expr("substring(now, length(hit.link) + 1)")).alias("now"))


def links_of(entries: DataFrame) -> DataFrame:
    """``repo, link, target``: where each symlink of ``entries`` (repo, absolute path, kind, link_target) ends, through all links on its way; null in a circle. By doubling: each round uses the round before."""
    links = entries.where("kind = 'symlink' and link_target is not null")
    links = kept(links.select("repo", F.col("path").alias("link"), paths.absolute(paths.parent(F.col("path")), F.col("link_target")).alias("target")))
    going = links.select("repo", F.col("link").alias("asked"), F.col("target").alias("now"))
    for _ in range(ROUNDS):
        going = _through(going, links)
        going = kept(going.withColumn("now", F.when((F.col("now") != F.col("asked")) & ~paths.is_inside(F.col("now"), F.col("asked")), F.col("now"))))  # back where it began: a circle
        if going.isEmpty():
            return links
        links = kept(large(links).join(going.select("repo", F.col("asked").alias("link"), F.col("now"), F.lit(True).alias("went")), ["repo", "link"], "left").select("repo", "link", F.when(F.col("went"), F.col("now")).otherwise(F.col("target")).alias("target")))
    lost = going.select("repo", F.col("asked").alias("link"), F.lit(True).alias("lost"))
    return large(links).join(lost, ["repo", "link"], "left").select("repo", "link", F.when(F.col("lost").isNull(), F.col("target")).alias("target"))


def resolved(rows: DataFrame, links: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` (repo, path) with ``path`` as it is without links; null where it leads into a circle. Only paths with a link on their way take part in rounds, as many as there are links on one way."""
    going = rows.where(F.col(path).isNotNull()).select("repo", F.col(path).alias("asked")).distinct().withColumn("now", F.col("asked"))
    steps = []
    for n in range(2**ROUNDS):
        going = kept(_through(going, links))
        if going.isEmpty():
            break
        steps.append(going.withColumn("n", F.lit(n)))
    else:
        steps.append(going.withColumn("now", F.lit(None).cast("string")).withColumn("n", F.lit(2**ROUNDS)))
    if not steps:
        return rows
    last = reduce(DataFrame.unionByName, steps).groupBy("repo", "asked").agg(F.max_by("now", "n").alias("__now")).withColumnRenamed("asked", path)
    return large(rows).join(last.withColumn("__went", F.lit(True)), ["repo", path], "left").withColumn(path, F.when(F.col("__went"), F.col("__now")).otherwise(F.col(path))).drop("__now", "__went")


def lfs_storage(config: Column) -> Column:
    """The last ``storage`` of section ``lfs`` in a git config: a struct of ``value`` and ``includes`` (does it include other files?)."""
    none = F.struct(F.lit("").alias("section"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("includes"))

    def step(acc: Column, line: Column) -> Column:
        head = F.lower(F.regexp_extract(line, r'^\s*\[\s*([A-Za-z0-9.-]+)(?:\s+"[^"]*")?\s*\]', 1))
        sub = line.rlike(r'^\s*\[\s*[A-Za-z0-9.-]+\s+"')
        section = F.when(head == "", acc["section"]).when(sub & ~head.isin("include", "includeif"), F.lit("-")).otherwise(head)
        raw = F.regexp_extract(line, r"^\s*(?:\[[^\]]*\])?\s*(?i:storage)\s*=\s*(.*?)\s*$", 1)
        quoted = F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*)"', 1)
        value = F.when(F.startswith(raw, F.lit('"')), F.regexp_replace(quoted, r"\\(.)", "$1")).otherwise(F.regexp_replace(raw, r"\s*[#;].*$", ""))
        return F.struct(
            section.alias("section"), F.when((section == "lfs") & (raw != ""), value).otherwise(acc["value"]).alias("value"), (acc["includes"] | section.isin("include", "includeif")).alias("includes")
        )

    return F.aggregate(F.split(config, "\n"), none, step)


def located(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """For each of ``roots`` (repo, root: absolute): ``git_dir, common_dir, lfs_store, annex_store``, ``store`` (present, absent, unreadable) and ``why`` the regions are not known (else null).

    ``entries`` (repo, path: absolute, kind, content, link_target, read_status) are the rows of the trees and of the directories that their pointers lead to. What is missing there leads nowhere.
    A config that includes other files may set the store anywhere, so it counts as unreadable.
    """
    links = links_of(entries)
    text = F.col("content").cast("string")
    name = paths.basename(F.col("path"))
    few = entries.where(name.isin(*NAMES)).select("repo", paths.parent(F.col("path")).alias("dir"), name.alias("name"), "kind", "read_status", text.alias("text"))
    # A directory has each name once; where a path is listed twice, the worse row counts.
    each = few.groupBy("repo", "dir", "name").agg(F.max(F.struct((F.col("read_status") != "completed").alias("bad"), "kind", "text")).alias("e"))
    dirs = kept(each.groupBy("repo", "dir").agg(F.map_from_entries(F.collect_list(F.struct("name", "e"))).alias("has")))
    at = lambda c, n: F.try_element_at(F.col(c), F.lit(n))

    def look(rows: DataFrame, where: str, what: str) -> DataFrame:
        return large(rows).join(dirs.select("repo", F.col("dir").alias(where), F.col("has").alias(what)), ["repo", where], "left")

    first = look(resolved(roots.select("repo", F.col("root"), F.col("root").alias("top")), links, "top"), "top", "here")
    git = at("here", ".git")
    said = F.regexp_extract(git["text"], r"^gitdir: ([^\r\n]*[^\s])\s*$", 1)
    lead = F.when(git["bad"], None).when(git["kind"].isin("dir", "symlink"), F.concat("top", F.lit("/.git"))).when((git["kind"] == "file") & (said != ""), paths.absolute(F.col("top"), said))
    first = first.withColumn("git_dir", lead).withColumn("why", F.when(git.isNull(), "no .git").when(git["bad"], ".git cannot be read").when(lead.isNull(), ".git points to nothing"))
    second = look(resolved(first, links, "git_dir"), "git_dir", "inner")
    pointer = at("inner", "commondir")
    common = F.when(pointer.isNull(), F.col("git_dir")).when(~pointer["bad"], paths.absolute(F.col("git_dir"), F.trim(F.regexp_replace(pointer["text"], r"[\r\n]+$", ""))))
    head = at("inner", "HEAD")
    second = second.withColumn("common_dir", F.when(F.col("why").isNull() & head.isNotNull(), common)).withColumn(
        "why", F.coalesce("why", F.when(head.isNull(), "the git directory has no HEAD").when(pointer["bad"], "commondir cannot be read"))
    )
    third = look(resolved(second, links, "common_dir"), "common_dir", "shared")
    config, annex, dvc = at("shared", "config"), at("shared", "annex"), at("here", ".dvc")
    lfs = lfs_storage(config["text"])
    third = third.withColumn("why", F.coalesce("why", F.when(at("shared", "objects").isNull(), "the common directory has no objects").when(config["bad"], "config cannot be read")))
    found = F.col("common_dir").isNotNull() & at("shared", "objects").isNotNull()
    store = (
        F.when(~found, "unreadable").when(annex.isNotNull() & ~annex["bad"], "present").when(dvc.isNotNull() & ~dvc["bad"], "present").when(annex["bad"] | dvc["bad"], "unreadable").otherwise("absent")
    )
    third = third.withColumn("store", store).withColumn("lfs", lfs).withColumn("why", F.coalesce("why", F.when(F.col("lfs.includes"), "config includes other files")))
    known = F.col("why").isNull()
    third = third.withColumn("lfs_store", F.when(known, F.coalesce(paths.absolute(F.col("common_dir"), F.col("lfs.value")), F.concat("common_dir", F.lit("/lfs")))))
    out = resolved(third.select("repo", "root", "git_dir", "common_dir", "lfs_store", "store", "why"), links, "lfs_store")
    shown = lambda c: F.when(F.col("why").isNull(), F.col(c)).alias(c)
    # A row a tree, which gates then read more than once.
    return kept(out.select("repo", "root", shown("git_dir"), shown("common_dir"), shown("lfs_store"), F.when(F.col("why").isNull(), F.concat("common_dir", F.lit("/annex"))).alias("annex_store"), "store", "why"))


def regions(found: DataFrame) -> DataFrame:
    """``repo, region, region_path`` of ``located`` trees; none of a tree whose regions are not all known."""
    each = F.array(*[F.struct(F.lit(r).alias("region"), F.col(r).alias("region_path")) for r in REGIONS])
    return found.where("why is null").select("repo", F.explode(each).alias("r")).select("repo", "r.*")
