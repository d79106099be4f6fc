"""Registered plans over many working trees at once: rows of trees derived from a table's keys, each beside SQL that works the outcomes out from the same keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import gates, ignore, provenance, roots, stores
from siftline.plans.tables import plan, table
from siftline.sources import markers, repo_tree

# Where git directories and stores are -----------------------------------------------------------------------------------

# Rows of a tree by k % 12 below /w/{k}, whose root is t: path, kind, content, is it readable?, where a link leads.
_HEAD, _OBJECTS = ("HEAD", "file", "ref: refs/heads/main\n"), ("objects", "dir", None)
_PLAIN = [("t/.git", "dir", None)] + [("t/.git/" + n, k, c) for n, k, c in (_HEAD, _OBJECTS)]
_SHAPES: list[list[tuple]] = [
    _PLAIN,
    [("t/.git", "file", "gitdir: /w/{k}/m/.git/worktrees/t\n"), ("m/.git/worktrees/t/HEAD", "file", "ref: x"), ("m/.git/worktrees/t/commondir", "file", "../..\n"), ("m/.git/HEAD", "file", "ref: x"), ("m/.git/objects", "dir", None), ("m/.git/config", "file", "[core]\n")],
    [("t/.git", "file", "gitdir: ../sep\n"), ("sep/HEAD", "file", "ref: x"), ("sep/objects", "dir", None)],
    [("t/.git", "dir", None, "errored")],
    [*_PLAIN, ("t/.git/config", "file", '[core]\n\tbare = false\n[LFS]\n\tstorage = "/data/{k}" # moved\n[other "storage"]\n\tstorage = no\n')],
    [*_PLAIN, ("t/.git/config", "file", "[lfs]\n\tstorage = first\n\tstorage = big/lfs ; last one wins\n")],
    [*_PLAIN, ("t/.git/annex", "dir", None)],
    [*_PLAIN, ("t/.dvc", "dir", None, "errored")],
    [("t/.git", "file", "gitdir: ../l/git"), ("l", "symlink", None, "completed", "a"), ("a", "symlink", None, "completed", "/w/{k}/c/../b"), ("b/git/HEAD", "file", "ref: x"), ("b/git/objects", "dir", None)],
    [("t/.git", "file", "gitdir: ../gone\n")],
    [("t/.git", "symlink", None, "completed", ".git2"), ("t/.git2", "symlink", None, "completed", ".git")],
    [*_PLAIN, ("t/.git/config", "file", "[include]\n\tpath = more\n")],
]


def _trees(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % len(_SHAPES)).alias("v"))
    fill = lambda s: F.lit(None).cast("string") if s is None else F.replace(F.lit(s), F.lit("{k}"), F.col("k"))
    row = lambda path, kind, content, status="completed", link=None: F.struct(
        fill("/w/{k}/" + path).alias("path"), F.lit(kind).alias("kind"), fill(content).alias("content"), F.lit(status).alias("read_status"), fill(link).alias("link_target")
    )
    of = None
    for v, shape in enumerate(_SHAPES):
        rows = F.array(*[row(*r) for r in shape])
        of = F.when(F.col("v") == v, rows) if of is None else of.when(F.col("v") == v, rows)
    roots = p.select(F.concat(F.lit("r"), "k").alias("repo"), fill("/w/{k}/t").alias("root"), "k")
    return roots, p.select(F.concat(F.lit("r"), "k").alias("repo"), F.explode(of).alias("e")).select("repo", "e.*")


_FOUND = """p AS (SELECT p_partkey AS k, p_partkey % 12 AS v, '/w/' || p_partkey AS w FROM part),
found AS (SELECT 'r' || k AS repo, k, v, w,
    CASE v WHEN 1 THEN w || '/m/.git/worktrees/t' WHEN 2 THEN w || '/sep' WHEN 8 THEN w || '/b/git' WHEN 3 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE w || '/t/.git' END AS git_dir,
    CASE v WHEN 1 THEN w || '/m/.git' WHEN 2 THEN w || '/sep' WHEN 8 THEN w || '/b/git' WHEN 3 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE w || '/t/.git' END AS common_dir,
    CASE v WHEN 6 THEN 'present' WHEN 3 THEN 'unreadable' WHEN 7 THEN 'unreadable' WHEN 9 THEN 'unreadable' WHEN 10 THEN 'unreadable' ELSE 'absent' END AS store,
    CASE v WHEN 3 THEN '.git cannot be read' WHEN 9 THEN 'the git directory has no HEAD' WHEN 10 THEN 'the git directory has no HEAD' WHEN 11 THEN 'config includes other files' END AS why FROM p),
placed AS (SELECT *, CASE v WHEN 4 THEN '/data/' || k WHEN 5 THEN common_dir || '/big/lfs' ELSE common_dir || '/lfs' END AS lfs_store, common_dir || '/annex' AS annex_store FROM found)"""


@plan(f"WITH {_FOUND} SELECT repo, git_dir, common_dir, CASE WHEN why IS NULL THEN lfs_store END AS lfs_store, CASE WHEN why IS NULL THEN annex_store END AS annex_store, store, why FROM placed")
def tree_regions(spark, sf_dir):
    """Protected regions and content stores from path rows: a clone, a linked worktree, a separate git directory, moved LFS stores, annex, a chain of links; unreadable, dangling, circular and including ones."""
    roots, entries = _trees(spark, sf_dir)
    return stores.located(roots, entries).select("repo", "git_dir", "common_dir", "lfs_store", "annex_store", "store", "why")


_ASKED = [("readme", "/w/{k}/t/README"), ("root", "/w/{k}/t"), ("top", "/w/{k}/"), ("object", "/w/{k}/m/.git/objects/aa"), ("worktree", "/w/{k}/m/.git/worktrees"), ("sibling", "/w/{k}/m/.github"), ("store", "/data/{k}/x"), ("relative", "README")]


@plan(
    f"""WITH {_FOUND},
r AS (SELECT repo, unnest(['git_dir', 'common_dir', 'lfs_store', 'annex_store']) AS region, unnest([git_dir, common_dir, lfs_store, annex_store]) AS region_path FROM placed WHERE why IS NULL),
c AS (SELECT repo, why, name AS candidate, rtrim(replace(path, '{{k}}', k::VARCHAR), '/') AS path FROM placed, (VALUES {", ".join(f"('{n}', '{p}')" for n, p in _ASKED)}) x(name, path)),
h AS (SELECT c.repo, candidate, string_agg(region || ':' || CASE WHEN path = region_path THEN 'is' WHEN starts_with(path, region_path || '/') THEN 'inside' ELSE 'contains' END, ',' ORDER BY region) AS relations
  FROM c JOIN r ON c.repo = r.repo AND path LIKE '/%' AND (path = region_path OR starts_with(path, region_path || '/') OR starts_with(region_path, path || '/')) GROUP BY ALL)
SELECT c.repo, c.candidate, CASE WHEN why IS NOT NULL OR path NOT LIKE '/%' THEN 'unreadable' WHEN relations IS NULL THEN 'clear' ELSE 'refuses' END AS verdict, coalesce(relations, '') AS relations
FROM c LEFT JOIN h USING (repo, candidate)"""
)
def tree_gate(spark, sf_dir):
    """Candidates of every tree against its own regions: clear, is, inside, contains (the directory above the root, too), relative, and trees whose regions are not known."""
    roots, entries = _trees(spark, sf_dir)
    asked = F.array(*[F.struct(F.lit(n).alias("candidate"), F.replace(F.lit(p), F.lit("{k}"), F.col("k")).alias("path")) for n, p in _ASKED])
    candidates = roots.select("repo", F.explode(asked).alias("c")).select("repo", "c.*")
    out = gates.gate_0e(candidates, stores.regions(stores.located(roots, entries)))
    said = F.transform(F.coalesce("relations", F.array().cast("array<struct<region:string,relation:string>>")), lambda r: F.concat(r["region"], F.lit(":"), r["relation"]))
    return out.select("repo", "candidate", "verdict", F.array_join(said, ",").alias("relations"))


@plan(
    f"""WITH {_FOUND} SELECT repo, name AS candidate, CASE name WHEN 'plain' THEN 'clear' WHEN 'dangling' THEN CASE WHEN store = 'absent' THEN 'clear' ELSE 'refuses' END ELSE 'refuses' END AS verdict,
  CASE WHEN name = 'below' THEN 'linked_ancestor' WHEN name = 'resolving' THEN 'resolving_link' WHEN name = 'dangling' AND store <> 'absent' THEN 'dangling_link_with_store' ELSE '' END AS conditions
FROM placed, (VALUES ('plain'), ('below'), ('resolving'), ('dangling')) x(name)"""
)
def tree_links(spark, sf_dir):
    """The link gate with the store that each tree itself shows: a dangling link is reported only where annex and DVC were looked for and not found."""
    roots, entries = _trees(spark, sf_dir)
    found = stores.located(roots, entries)
    names = F.array(*[F.struct(F.lit(n).alias("candidate"), F.concat("root", F.lit(p)).alias("path")) for n, p in (("plain", "/a"), ("below", "/good/x"), ("resolving", "/good"), ("dangling", "/bad"))])
    links = roots.select("repo", F.explode(F.array(F.struct(F.concat("root", F.lit("/good")).alias("path"), F.lit(True).alias("resolves")), F.struct(F.concat("root", F.lit("/bad")).alias("path"), F.lit(False).alias("resolves")))).alias("l")).select("repo", "l.*")
    out = gates.gate_0a(roots.select("repo", F.explode(names).alias("c")).select("repo", "c.*"), links, found)
    return out.select("repo", "candidate", "verdict", F.array_join("conditions", ",").alias("conditions"))


# Content identity ------------------------------------------------------------------------------------------------------


@plan(
    r"""WITH d AS (SELECT doc_id AS k, doc_id % 6 AS v, coalesce(text, '') AS text FROM documents),
h AS (SELECT *, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS own, sha1(encode('blob ' || (octet_length(encode(text)) + 1) || chr(0) || text || 'x')) AS other FROM (SELECT k, v, text FROM d))
SELECT 'd' || k AS path, CASE v WHEN 3 THEN other WHEN 4 THEN own ELSE own END AS blob,
  CASE v WHEN 0 THEN 'same' WHEN 1 THEN 'modified' WHEN 2 THEN 'untracked' WHEN 3 THEN 'deleted' WHEN 4 THEN 'unread' ELSE 'same' END AS state FROM h"""
)
def against_head(spark, sf_dir):
    """Whole texts as files against the blobs of a HEAD: same, changed, unknown to it, gone, and one that was not read although its bytes agree."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), (F.col("doc_id") % 6).alias("v"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(F.lit("r").alias("repo"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("path"), "v", F.encode("text", "utf-8").alias("content"), F.encode(F.concat("text", F.lit("x")), "utf-8").alias("other"))
    rows = d.where("v <> 3").select("repo", "path", F.lit("file").alias("kind"), F.when(F.col("v") == 4, "errored").otherwise("completed").alias("read_status"), "content")
    head = d.where("v <> 2").select("repo", "path", F.lit("100644").alias("mode"), repo_tree.blob_id(F.when(F.col("v").isin(1, 3), F.col("other")).otherwise(F.col("content"))).alias("blob"))
    return repo_tree.against_head(rows, head).select("path", "blob", "state")


# Markers in source ------------------------------------------------------------------------------------------------------

# Path, text, and the roots: rule, line, symbol (none: the file), target.
_SOURCES = [
    ("s/{k}.rs", '#[no_mangle]\npub extern "C" fn f{k}() {}\n', [("rust/no-mangle", 2, "f{k}", "f{k}")]),
    ("s/{k}.rs", 'const S: &str = r#"\n#[no_mangle]\nfn quoted{k}() {}\n"#;\n#[used]\n// why\nstatic KEPT{k}: u8 = 0;\n', [("rust/used", 7, "KEPT{k}", "KEPT{k}")]),
    ("s/{k}.rs", 'const S: &str = "#[ctor]\\\\nfn f{k}() {}";\n#[ctor]\n\nfn far{k}() {}\n', []),
    ("s/{k}.rs", '#[export_name = "abi{k}"]\n#[inline]\npub fn g{k}() {}\n', [("rust/export-name", 1, "abi{k}", "abi{k}"), ("rust/export-name", 3, "g{k}", "g{k}")]),
    ("g/{k}.go", "package g\n//go:linkname now{k} runtime/time.now{k}\n", [("go/linkname", 2, "now{k}", "now{k}"), ("go/linkname", 2, "now{k}", "runtime/time.now{k}")]),
    ("g/{k}.go", "package g\nvar t = `\n//export Hidden{k}\n`\n//export Shown{k}\n", [("go/export", 5, "Shown{k}", "Shown{k}")]),
    ("p/{k}.pth", "lib\nimport m{k}; m{k}.run()\n", [("python/pth", 1, None, "p/{k}.pth"), ("python/pth", 2, "m{k}", "m{k}")]),
    ("p/{k}/sitecustomize.py", "x = 1\n", [("python/sitecustomize", 1, None, "p/{k}/sitecustomize.py")]),
    ("d/{k}.md", "We use `#[no_mangle]`\n//export Prose\n", []),
    ("s/{k}.rs", "let s = r\"one line #[no_mangle]\";\n#[unsafe(no_mangle)]\npub unsafe extern \"C\" fn h{k}() {}\n", [("rust/no-mangle", 3, "h{k}", "h{k}")]),
]
_quote = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"


@plan(
    "WITH t AS (SELECT p_partkey::VARCHAR AS k, p_partkey % 10 AS v FROM part), r AS (SELECT * FROM (VALUES "
    + ", ".join(f"({v}, '{rule}', {line}, {_quote(path)}, {_quote(symbol)}, {_quote(target)})" for v, (path, _, found) in enumerate(_SOURCES) for rule, line, symbol, target in found)
    + ") x(v, rule, line, path, symbol, target)) SELECT rule, replace(path, '{k}', k) AS path, line::BIGINT AS line, replace(symbol, '{k}', k) AS symbol, replace(target, '{k}', k) AS target FROM t JOIN r USING (v)"
)
def source_roots(spark, sf_dir):
    """Directives, attributes and start-up files that declare roots, beside the same lines in raw strings, escaped literals, prose and above a blank line."""
    i = (F.col("p_partkey") % len(_SOURCES) + 1).cast("int")
    fill = lambda at: F.replace(F.element_at(F.array(*[F.lit(s[at]) for s in _SOURCES]), i), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return markers.source_roots(table(spark, sf_dir, "part").select(fill(0).alias("path"), fill(1).alias("text")))


# What is not the repository's own ---------------------------------------------------------------------------------------

_PATTERNS = r"""CASE s_suppkey % 5 WHEN 0 THEN '(^|/)' || s_suppkey || '(/|$)' WHEN 1 THEN '/(en|de)/' || s_suppkey || '[0-9]' WHEN 2 THEN s_suppkey || '[.]html$' WHEN 3 THEN '^m[.][a-z]+[.]example[.]net/.*' || s_suppkey
  ELSE '(?i)EXAMPLE[.]ORG/FR/' || s_suppkey || '$' END"""


def _rules(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    two = F.array(F.struct(F.lit("vendored").alias("kind"), F.expr(_PATTERNS).alias("pattern")), F.struct(F.lit("generated_path").alias("kind"), F.expr("'/' || s_suppkey || '[0-9]?(?:/|[.]html)?$'").alias("pattern")))
    rows = s.select("s_suppkey", F.explode(two).alias("p")).select("p.kind", F.col("s_suppkey").alias("idx"), "p.pattern", F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("rule"))
    # Without any literal: short paths, and none at all.
    return rows.unionByName(spark.createDataFrame([("vendored", 1 << 40, "^.{1,19}$", "short"), ("vendored", 0, "^$|^[^a-z]", "odd")], rows.schema))


_RULES_SQL = f"""r AS (SELECT 'vendored' AS kind, s_suppkey::BIGINT AS idx, {_PATTERNS} AS pattern, 'r' || s_suppkey AS rule FROM supplier
  UNION ALL SELECT 'generated_path', s_suppkey, '/' || s_suppkey || '[0-9]?(?:/|[.]html)?$', 'r' || s_suppkey FROM supplier
  UNION ALL SELECT 'vendored', 1099511627776, '^.{{1,19}}$', 'short' UNION ALL SELECT 'vendored', 0, '^$|^[^a-z]', 'odd'),
f AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)"""


@plan(f"WITH {_RULES_SQL} SELECT path, kind, min(idx) AS idx, arg_min(rule, idx) AS rule FROM f JOIN r ON regexp_matches(path, pattern) GROUP BY path, kind")
def vendored_paths(spark, sf_dir):
    """Two patterns a supplier, of five shapes, and two without any literal, over the paths of all pages: the first of each kind that finds something."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return provenance.pattern_matches(files, _rules(spark, sf_dir))



@plan(
    f"""WITH {_RULES_SQL.replace("regexp_extract(url, '://([^?#]*)', 1)", "regexp_extract(url, '://([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '.go' ELSE '' END").replace("SELECT DISTINCT", "SELECT DISTINCT page_id % 7 AS v, ")},
n AS (SELECT f.path, v, regexp_extract(f.path, '^[^/]*/[^/]*', 0) IN ('ththre.example.com/fr', 'therou.example.com/en', 'ththan.example.net/en') AS sub, kind, min(idx) AS idx, arg_min(rule, idx) AS rule FROM f LEFT JOIN r ON regexp_matches(f.path, pattern) GROUP BY ALL),
g AS (SELECT path, bool_or(sub) AS sub, bool_or(v = 0) AS made, any_value(rule) FILTER (kind = 'vendored') AS vendored, any_value(rule) FILTER (kind = 'generated_path') AS generated FROM n GROUP BY path)
SELECT path, CASE WHEN sub THEN 'submodule' WHEN vendored IS NOT NULL THEN 'vendored' WHEN generated IS NOT NULL THEN 'generated_path' ELSE 'generated_content' END AS evidence,
  CASE WHEN sub THEN '.gitmodules' ELSE coalesce(vendored, generated, 'go') END AS rule FROM g WHERE sub OR vendored IS NOT NULL OR generated IS NOT NULL OR made"""
)
def not_own(spark, sf_dir):
    """Submodules, vendored and generated paths and generated content, the first kind that holds; a commented path of ``.gitmodules`` declares nothing."""
    v = F.col("page_id") % 7
    path = F.concat(F.regexp_extract("url", "://([^?#]*)", 1), F.when(v == 0, ".go").otherwise(""))
    files = table(spark, sf_dir, "pages").select(path.alias("path"), F.when(v == 0, "// Code generated by x\n").otherwise("package x\n").alias("text"))
    modules = '[submodule "a"]\n\tpath = ththre.example.com/fr\n\turl = ../x\n[submodule "b"]\n  path=therou.example.com/en/\n# path = m\n;path = blog\n[submodule "c"]\n\tpath = ththan.example.net/en\r\n'
    files = files.unionByName(spark.createDataFrame([(".gitmodules", modules)], "path string, text string"))
    return provenance.provenance(files, _rules(spark, sf_dir)).where("path <> '.gitmodules'")


# Root sets of many trees -------------------------------------------------------------------------------------------------

# Files of a tree by k % 6, then its roots (tier, rule, path, symbol, target) and its gaps (tier, file, what is said).
_PROJECTS: list[tuple[list, list, list]] = [
    (
        [("package.json", '{"main": "lib/a{k}.js", "bin": {"t": "bin/gone"}}'), ("lib/a{k}.js", "x")],
        [("A", "library_entry", "lib/a{k}.js", None, "path"), ("A", "executable", None, None, "unresolved")], [],
    ),
    (
        [("package.json", "{"), ("a.go", "package a\n//export E{k}\n"), ("Dockerfile", "FROM x\nENTRYPOINT [\"./run{k}\"]\n"), ("run{k}", "x")],
        [("A", "go/export", None, "E{k}", "symbol")], [("A", "package.json", "JSONDecodeError")],
    ),
    (
        [("pyproject.toml", '[project]\nname = "n"\ndependencies = ["Django>=4"]\n[project.scripts]\nrun = "shop.cli:main{k}"\n'), ("site/settings.py", "INSTALLED_APPS = ['shop', *more]\n"), ("shop/apps.py", "class Shop{k}(AppConfig):\n    pass\n")],
        [("A", "executable", None, "main{k}", "reference"), ("B", "django_app_config", "shop/apps.py", "Shop{k}", "symbol"), ("B", "django_settings", "site/settings.py", None, "path")], [("B", "site/settings.py", "INSTALLED_APPS is not all literal")],
    ),
    (
        [("requirements.txt", "pytest==8\n"), ("tests/test_{k}.py", "x"), ("t{k}/conftest.py", "x"), ("own/x{k}.txt", "x")],
        [("A", "dev_target", "t{k}/conftest.py", None, "path"), ("B", "pytest_conftest", "t{k}/conftest.py", None, "path"), ("B", "pytest_test_module", "tests/test_{k}.py", None, "path"), ("C", "declared", "own/x{k}.txt", None, "path")], [],
    ),
    ([("requirements.txt", "flask\n"), ("src/ffi.rs", "#[no_mangle]\nfn f{k}() {}\n"), ("own/y.txt", "x")], [("A", "rust/no-mangle", None, "f{k}", "symbol"), ("C", "declared", "own/y.txt", None, "path")], [("B", "requirements.txt", "no layout rules for flask")]),
    ([("tests/test_{k}.py", "without a framework"), ("site/settings.py", "x"), ("README.md", "x")], [], []),
]
_values = lambda at, n: ", ".join(f"({v}, {', '.join(map(_quote, r))})" for v, p in enumerate(_PROJECTS) for r in p[at])


@plan(
    f"""WITH t AS (SELECT p_partkey::VARCHAR AS k, p_partkey % 6 AS v FROM part),
r AS (SELECT * FROM (VALUES {_values(1, 5)}) x(v, tier, rule, path, symbol, target)), g AS (SELECT * FROM (VALUES {_values(2, 3)}) x(v, tier, path, rule))
SELECT 'r' || k AS repo, 'root' AS kind, tier, rule, replace(path, '{{k}}', k) AS path, replace(symbol, '{{k}}', k) AS symbol, target FROM t JOIN r USING (v)
UNION ALL SELECT 'r' || k, 'gap', tier, rule, path, NULL, NULL FROM t JOIN g USING (v)"""
)
def root_sets(spark, sf_dir):
    """The root sets of a tree a part, in one plan: manifests, source markers, conventions and declarations; a manifest that is broken empties only its own tree."""
    k, v = F.col("p_partkey").cast("string"), F.col("p_partkey") % len(_PROJECTS)
    fill = lambda s: F.replace(F.lit(s), F.lit("{k}"), k)
    of = None
    for i, (some, _, _) in enumerate(_PROJECTS):
        rows = F.array(*[F.struct(fill(p).alias("path"), fill(t).alias("text")) for p, t in some])
        of = F.when(v == i, rows) if of is None else of.when(v == i, rows)
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), k).alias("repo"), F.explode(of).alias("f")).select("repo", "f.*", F.lit("completed").alias("read_status"))
    found, gaps = roots.materialize(files, roots.declared_table(spark, [("own/", "kept by hand", "file", "active", None)]))
    none = F.lit(None).cast("string")
    said = F.regexp_replace("detail", "^(JSONDecodeError).*", "$1")
    return found.select("repo", F.lit("root").alias("kind"), "tier", "rule", "path", "symbol", "target").unionByName(gaps.select("repo", F.lit("gap").alias("kind"), "tier", said.alias("rule"), F.col("origin_file").alias("path"), none.alias("symbol"), none.alias("target")))


# Ignore rules -----------------------------------------------------------------------------------------------------------

_LINE = """CASE s_suppkey % 5 WHEN 0 THEN s_suppkey::string WHEN 1 THEN '!' || s_suppkey || '.html' WHEN 2 THEN '*/fr/' || s_suppkey WHEN 3 THEN s_suppkey || '*' ELSE '!*' || s_suppkey END"""
_PAGE = "rtrim('/', regexp_extract(url, '://([^?#]*)', 1))"


@plan(
    rf"""WITH l AS (SELECT row_number() OVER (ORDER BY s_suppkey) + 2 AS line, s_suppkey AS k, {_LINE.replace("::string", "::VARCHAR")} AS pattern FROM supplier),
p AS (SELECT path, split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang, split_part(path, '/', 3) AS name, length(path) - length(replace(path, '/', '')) AS slashes FROM (SELECT DISTINCT rtrim(regexp_extract(url, '://([^?#]*)', 1), '/') AS path FROM pages)),
o AS (SELECT path, max(line) AS line FROM p JOIN l ON CASE k % 5 WHEN 0 THEN name = k::VARCHAR WHEN 1 THEN name = k || '.html' WHEN 2 THEN lang = 'fr' AND name = k::VARCHAR WHEN 3 THEN starts_with(name, k::VARCHAR) ELSE ends_with(name, k::VARCHAR) END GROUP BY path),
d AS (SELECT p.path, CASE WHEN host LIKE 'blog.%' THEN '.gitignore' WHEN host LIKE 'th%.org' AND (lang = 'de' OR lang = 'en' AND name LIKE '5%') THEN host || '/.gitignore' WHEN o.line IS NOT NULL THEN '.gitignore' END AS source,
    CASE WHEN host LIKE 'blog.%' THEN 2 WHEN host LIKE 'th%.org' AND lang = 'de' THEN 1 WHEN host LIKE 'th%.org' AND lang = 'en' AND name LIKE '5%' THEN 2 ELSE o.line END AS line FROM p LEFT JOIN o USING (path))
SELECT d.path, d.source, coalesce(d.line, 0)::INT AS line, CASE WHEN d.source = '.gitignore' THEN CASE d.line WHEN 2 THEN 'blog.*/' ELSE l.pattern END WHEN d.line = 1 THEN 'de/' WHEN d.line = 2 THEN '!en/5*' END AS pattern,
  coalesce(CASE WHEN d.source = '.gitignore' THEN CASE d.line WHEN 2 THEN true ELSE l.pattern NOT LIKE '!%' END ELSE d.line = 1 END, false) AND d.source IS NOT NULL AS ignored
FROM d LEFT JOIN l ON d.line = l.line AND d.source = '.gitignore'"""
)
def deciding_ignore(spark, sf_dir):
    """Rule, file and line that decide the path of every page: a line a supplier in the root's ignore file, ignore files of some hosts, excluded directories that end the question, lines that take paths back."""
    asked = table(spark, sf_dir, "pages").select(F.expr(_PAGE).alias("path")).distinct()
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_LINE).alias("line"))
    # One file of a line a supplier: a few thousand short lines of a table that stands for what people wrote.
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    root = text.select(F.lit(".gitignore").alias("path"), F.concat(F.lit("# by supplier\nblog.*/\n"), "body", F.lit("\n")).alias("text"))
    hosts = asked.select(F.substring_index("path", "/", 1).alias("host")).where("host like 'th%.org'").distinct()
    return ignore.deciding_rule(asked, ignore.ignore_rules(root.unionByName(hosts.select(F.concat("host", F.lit("/.gitignore")).alias("path"), F.lit("de/\n!en/5*\n").alias("text"))))).select("path", "source", F.coalesce("line", F.lit(0)).alias("line"), "pattern", "ignored")
