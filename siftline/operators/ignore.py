"""Which ignore rule decides a path: the last that matches it, unless a directory above it is excluded already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import paths
from siftline.functions.globs import ignore_regex
from siftline.operators import provenance

#: Depth of the sources outside of the tree, which all rules of the tree precede: the repository's own exclude file, then the user's.
OUTSIDE = {"info": -1, "user": -2}


def ignore_rules(files: DataFrame) -> DataFrame:
    """``source, line, pattern, regex, negated, rank`` of the ignore files of a tree (path, text), and of rows with ``scope`` info or user that lie outside of it.

    A deeper file precedes, within a file a later line. What is blank, a comment or cannot match anything is no rule.
    """
    scope = F.col("scope") if "scope" in files.columns else F.lit(None).cast("string")
    own = files.select("path", "text", scope.alias("scope")).where((paths.basename(F.col("path")) == ".gitignore") | F.col("scope").isNotNull())
    shape = T.StructType([T.StructField("regex", T.StringType()), T.StructField("negated", T.BooleanType())])
    compiled = F.udf(lambda line, directory: ignore_regex(line, directory), shape)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    lines = own.select("path", "scope", F.posexplode(F.split(text, "\n")).alias("i", "pattern"))
    directory = F.when(F.col("scope").isNull(), paths.parent(F.col("path"))).otherwise("")
    depth = F.when(F.col("scope") == "info", OUTSIDE["info"]).when(F.col("scope") == "user", OUTSIDE["user"]).otherwise(paths.depth(directory))
    rows = lines.where(F.col("pattern") != "").select(F.col("path").alias("source"), (F.col("i") + 1).alias("line"), F.regexp_replace("pattern", "\r$", "").alias("pattern"), compiled("pattern", directory).alias("r"), depth.alias("depth"))
    rank = (F.col("depth").cast("long") + 2) * F.lit(1 << 32) + F.col("line")
    return rows.where("r is not null").select("source", "line", F.regexp_replace("pattern", r"(?<!\\) +$", "").alias("pattern"), "r.regex", "r.negated", rank.alias("rank"))


def deciding_rule(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, ignored, source, line, pattern`` of the paths asked (path; with ``is_dir`` where some are directories): nulls and not ignored where no rule matches.

    A path is followed from the root: the first directory on its way that is excluded ends the question, and the rule that excludes it decides; a rule that takes a directory back only lets the way go on.
    Each directory is judged once, however many paths lie in it, and meets only rules whose required literal it holds.
    """
    is_dir = F.col("is_dir") if "is_dir" in asked.columns else F.lit(False)
    own = asked.select("path", is_dir.alias("is_dir")).distinct()
    way = F.slice(paths.ancestors(F.col("path")), F.lit(2), F.size(F.split("path", "/")) - 1)  # without the root and the path itself
    steps = own.select("path", F.posexplode(F.concat(F.transform(way, lambda d: F.concat(d, F.lit("/"))), F.array(F.concat("path", F.when(F.col("is_dir"), "/").otherwise(""))))).alias("level", "entry"))
    steps = steps.join(own.select("path", (F.size(F.split("path", "/")) - 1).alias("last")), "path")
    patterns = rules.select(F.lit("ignore").alias("kind"), F.col("rank").alias("idx"), F.col("regex").alias("pattern"), F.col("source").alias("rule"))
    hits = provenance.all_matches(steps.select(F.col("entry").alias("path")), patterns)
    best = hits.groupBy("path").agg(F.max(F.struct("idx", "rule")).alias("r"))  # files of one depth lie in different directories
    told = best.select(F.col("path").alias("entry"), F.col("r.idx").alias("rank"), F.col("r.rule").alias("source")).join(rules, ["rank", "source"]).select("entry", F.struct("negated", "source", "line", "pattern").alias("rule"))
    # The first excluded directory, else whatever holds for the path itself.
    ends = steps.join(told, "entry").where("not rule.negated or level = last")
    first = ends.groupBy("path").agg(F.min_by("rule", "level").alias("rule"))
    return own.join(first, "path", "left").select("path", F.coalesce(~F.col("rule.negated"), F.lit(False)).alias("ignored"), "rule.source", "rule.line", "rule.pattern")
