"""Working trees as a DataFrame, hidden and underscored names included, and what git says of their paths.

Trees are walked by a frontier: a table of directories that tasks list, each round one level deeper, for any number of trees at once. Contents are read by tasks as
well, so no machine holds a list of files. What could not be listed or read is a row that says so. A git directory is listed itself, not what lies deeper in it.
"""

from __future__ import annotations

import os
import stat
import subprocess
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftline.functions import paths
from siftline.operators import gates
from siftline.sources.lineage import kept

SCHEMA = "repo string, root string, path string, kind string, size bigint, link_target string, read_status string, read_detail string"
MAX_BYTES = 64 * 1024 * 1024
# Directories that the manifest scans and the convention scans leave out.
SKIP_MANIFESTS = (".git", "node_modules", "target", "vendor", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache")
SKIP_CONVENTIONS = (".git", ".hg", "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".next")
#: What each walk sees: (directories it leaves out, does it stop at other repositories?, the kinds of entries it takes). Its place is its bit in ``walks``.
WALKS = {
    "reachability": ((".git",), True, ("file",)),
    "attributes": ((".git",), True, ("file", "symlink")),
    "state": ((".git",), True, ("file", "symlink")),
    "persistence": ((".git",), True, ("file", "symlink")),
    "manifests": (SKIP_MANIFESTS, True, ("file",)),
    "conventions": (SKIP_CONVENTIONS, True, ("file",)),
    "source_roots": ((".git",), True, ("file", "symlink")),
    "declared": (SKIP_MANIFESTS, False, ("file", "symlink")),
}
#: Settings of the caller's shell that would point git at another repository.
SCRUBBED = ("GIT_DIR", "GIT_WORK_TREE", "GIT_INDEX_FILE", "GIT_OBJECT_DIRECTORY", "GIT_COMMON_DIR", "GIT_NAMESPACE")


def _listed(batches):
    for pdf in batches:
        rows = []
        for repo, root, base in zip(pdf["repo"], pdf["root"], pdf["path"]):
            try:
                entries = sorted(os.scandir(os.path.join(root, base)), key=lambda e: e.name)
            except OSError as e:
                rows.append((repo, root, base, "unlisted", None, None, "errored", str(e)))
                continue
            for e in entries:
                rel = f"{base}/{e.name}" if base else e.name
                kind, size, target, status, detail = "file", None, None, "completed", None
                try:
                    s = os.lstat(e.path)
                    size = s.st_size
                    if stat.S_ISLNK(s.st_mode):
                        kind, target = "symlink", os.readlink(e.path)
                    elif stat.S_ISDIR(s.st_mode):
                        kind = "dir"
                except OSError as err:
                    status, detail = "errored", str(err)
                rows.append((repo, root, rel, kind, size, target, status, detail))
        yield pd.DataFrame(rows, columns=["repo", "root", "path", "kind", "size", "link_target", "read_status", "read_detail"])


def listing(roots: DataFrame) -> DataFrame:
    """All entries below ``roots`` (repo, root: an absolute folder that every machine sees); ``path`` is relative to the root. Rounds are as many as the deepest tree has levels."""
    frontier = roots.select("repo", "root", F.lit("").alias("path"))
    levels = []
    while True:
        level = kept(frontier.repartition("repo", "path").mapInPandas(_listed, SCHEMA))
        levels.append(level)
        frontier = level.where("kind = 'dir' and not path rlike '(^|/)[.]git/'").select("repo", "root", "path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _read(limit: int):
    def over(batches):
        for pdf in batches:
            for at in range(len(pdf)):
                row = pdf.iloc[at : at + 1].copy()  # one content at a time
                of = row.iloc[0]
                content, status, detail = None, of["read_status"], of["read_detail"]
                if of["kind"] == "symlink":
                    content = os.fsencode(of["link_target"])
                elif of["kind"] == "file" and status == "completed":
                    if of["size"] > limit:
                        status, detail = "truncated", f"{int(of['size'])} bytes"
                    else:
                        try:
                            with open(os.path.join(of["root"], of["path"]), "rb") as f:
                                content = f.read()
                        except OSError as e:
                            status, detail = "errored", str(e)
                yield row.assign(content=[content], read_status=[status], read_detail=[detail])

    return over


def scan(roots: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``listing`` with ``content`` (of a symlink its target; null for directories and what was not read). Files over ``max_bytes`` are truncated: they have no content."""
    return listing(roots).repartition("repo", "path").mapInPandas(_read(max_bytes), SCHEMA + ", content binary")


def _under(names: tuple[str, ...]) -> Column:
    above = F.split(paths.parent(F.col("path")), "/")
    return F.arrays_overlap(above, F.array(*[F.lit(n) for n in names]))


def with_walks(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan and ``walks``: a bit for each of ``WALKS`` that sees the entry, so one table serves all of them."""
    keyed = rows.withColumn("__at", F.concat_ws("\u0000", "repo", "path"))
    tree = keyed.select(F.concat_ws("/", "repo", "path").alias("path"), "kind", F.col("content").cast("string").alias("content"), "read_status", "repo")
    # Boundaries of many trees at once: the name of the tree is the first component, and the tree's own root is none.
    found = gates.boundaries(tree.select("path", "kind", "content", "read_status")).where("instr(dir, '/') > 0")
    held = gates.under_boundary(keyed.select("__at", F.concat_ws("/", "repo", "path").alias("path")), found).select("__at", F.col("boundary").isNotNull().alias("__other"))
    bits = [F.when(~_under(skip) & F.col("kind").isin(*kinds) & (F.lit(not stops) | ~F.col("__other")), 1 << i).otherwise(0) for i, (skip, stops, kinds) in enumerate(WALKS.values())]
    return keyed.join(held, "__at").withColumn("walks", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("__at", "__other")


def sees(walk: str) -> Column:
    """Is the bit of a walk set in ``walks``?"""
    return F.col("walks").bitwiseAND(1 << list(WALKS).index(walk)) != 0


def blob_id(content: Column) -> Column:
    """The id git gives to a blob of this content (SHA-1 repositories)."""
    size = F.octet_length(content).cast("string")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), size), "utf-8"), F.unhex(F.lit("00")), content.cast("binary")))


def against_head(rows: DataFrame, head: DataFrame) -> DataFrame:
    """``repo, path, blob, state`` of files and links of ``rows`` and of ``head`` (repo, path, mode, blob): same, modified, untracked, deleted, unread.

    What is no blob in HEAD (a nested repository's link, mode 160000) is left out, as it has no content; so is its path in the tree. No row of a file that could not be read is ever ``same``.
    """
    here = rows.where("kind in ('file', 'symlink')").select("repo", "path", F.col("read_status").alias("status"), blob_id(F.col("content")).alias("own"))
    there = head.select("repo", "path", "mode", F.col("blob").alias("theirs"))
    state = (
        F.when(F.col("status").isNull(), "deleted").when((F.col("status") != "completed") | F.col("own").isNull(), "unread").when(F.col("mode").isNull(), "untracked").when(F.col("own") == F.col("theirs"), "same").otherwise("modified")
    )
    j = here.join(there, ["repo", "path"], "full").where("mode is null or mode <> '160000'")
    return j.select("repo", "path", F.coalesce("own", "theirs").alias("blob"), state.alias("state"))


def git(root: str, *args: str) -> str | None:
    """Output of git in the tree; null where it gave no answer."""
    env = {k: v for k, v in os.environ.items() if k not in SCRUBBED}
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, env=env, check=False)
    return run.stdout.decode("utf-8", "surrogateescape") if run.returncode == 0 else None


def _heads(batches):
    for pdf in batches:
        for repo, root in zip(pdf["repo"], pdf["root"]):
            out = git(root, "ls-tree", "-r", "-z", "--full-tree", "HEAD")
            rows = []
            for record in (out or "").split("\0"):
                if record:
                    about, _, path = record.partition("\t")
                    mode, _, blob = about.split(" ")
                    rows.append((repo, path, mode, blob))
            yield pd.DataFrame(rows, columns=["repo", "path", "mode", "blob"])


def heads(roots: DataFrame) -> DataFrame:
    """``repo, path, mode, blob`` of HEAD of every tree, one git process a tree, run by the tasks. A tree without a HEAD has no rows."""
    return roots.select("repo", "root").repartition("repo").mapInPandas(_heads, "repo string, path string, mode string, blob string")


def _asked(root: str, names: list[str]) -> list[tuple]:
    """What git says of some paths of one tree, by a few processes."""
    exact = [f":(literal){p}" for p in names]
    tracked, dirty = git(root, "ls-files", "-z", "--", *exact), git(root, "status", "--porcelain=v1", "-z", "--no-renames", "--untracked-files=no", "--", *exact)
    known = None if tracked is None else set(tracked.split("\0"))
    changed = None if dirty is None else {x[3:] for x in dirty.split("\0") if x}
    env = {k: v for k, v in os.environ.items() if k not in SCRUBBED}
    asked = subprocess.run(["git", "-C", root, "check-ignore", "-vz", "--no-index", "--stdin", "--non-matching"], input="\0".join(names).encode() + b"\0", capture_output=True, env=env, check=False)
    fields = asked.stdout.decode("utf-8", "surrogateescape").split("\0")[:-1] if asked.returncode in (0, 1) else []
    rules = {fields[i + 3]: fields[i : i + 3] for i in range(0, len(fields) - 3, 4)}
    touched: dict[str, tuple[int, int]] = {}
    for commit in (git(root, "log", "--format=%x01%ct %at", "--name-only", "-z", "--no-renames", "--", *exact) or "").split("\x01")[1:]:
        stamp, _, paths_of = commit.partition("\0")
        when = tuple(map(int, stamp.split()))
        for name in paths_of.replace("\n", "").split("\0"):
            if name:
                touched[name] = max(touched.get(name, when), when)
    out = []
    for p in names:
        source, line, pattern = rules.get(p, ("", "", ""))
        ignored = None if not rules else bool(pattern) and not pattern.startswith("!")
        when = touched.get(p, (None, None))
        out.append((None if known is None else p in known, ignored, source or None, int(line) if line else None, pattern or None, None if changed is None else p in changed, *when))
    return out


def _facts(schema):
    def over(batches):
        for pdf in batches:
            for (repo, root), rows in pdf.groupby(["repo", "root"], sort=False):
                names = rows["path"].tolist()
                for at in range(0, len(names), 500):
                    part = names[at : at + 500]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (repo, root, p, *found))) for p, found in zip(part, _asked(root, part))], schema)

    return lambda batches: over(b.to_pandas() for b in batches)


def git_facts(candidates: DataFrame) -> DataFrame:
    """``candidates`` (repo, root, path) with ``tracked, ignored, ignore_source, ignore_line, ignore_pattern, dirty, committed_at, authored_at``.

    Tasks ask git for the paths they hold. Null means that git gave no answer, which no gate takes for a no.
    """
    shape = "repo string, root string, path string, tracked boolean, ignored boolean, ignore_source string, ignore_line int, ignore_pattern string, dirty boolean, committed_at long, authored_at long"
    kind = StructType.fromDDL(shape)
    return candidates.select("repo", "root", "path").mapInArrow(_facts(to_arrow_schema(kind)), kind)


def _head_facts(batches):
    for pdf in batches:
        rows = []
        for repo, root in zip(pdf["repo"], pdf["root"]):
            remote, shallow = git(root, "branch", "-r", "--contains", "HEAD"), git(root, "rev-parse", "--is-shallow-repository")
            rows.append((repo, None if remote is None else bool(remote.strip()), None if shallow is None else shallow.strip() == "true"))
        yield pd.DataFrame(rows, columns=["repo", "head_on_remote", "shallow"])


def head_facts(roots: DataFrame) -> DataFrame:
    """``repo, head_on_remote, shallow`` of every tree; null where git gave no answer."""
    return roots.select("repo", "root").mapInPandas(_head_facts, "repo string, head_on_remote boolean, shallow boolean")
