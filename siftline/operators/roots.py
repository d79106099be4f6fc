"""The root set: entry points that manifests (tier A), conventions (B) and people (C) declare, with what could not be read as gaps."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.globs import pathspec
from siftline.functions.text import bare_suffixes, has_expired
from siftline.sources import markers
from siftline.sources.lineage import kept, large
from siftline.sources.manifests import manifest_roots

COLUMNS = ("tier", "rule", "origin", "origin_file", "path", "symbol", "target", "detail")
# Framework -> (packages, marker files, (file, section) pairs).
SIGNATURES = {
    "django": (("django",), ("manage.py",), ()),
    "pytest": (("pytest",), ("pytest.ini",), (("pyproject.toml", "[tool.pytest.ini_options]"), ("tox.ini", "[pytest]"), ("setup.cfg", "[tool:pytest]"))),
    "jest": (("jest",), ("jest.config.js", "jest.config.mjs", "jest.config.cjs", "jest.config.ts", "jest.config.json"), (("package.json", '"jest":'),)),
    "nextjs": (("next",), ("next.config.js", "next.config.mjs", "next.config.ts"), ()),
    "rails": (("rails",), ("config/application.rb", "bin/rails"), ()),
    "flask": (("flask",), (), ()),
    "fastapi": (("fastapi",), (), ()),
    "celery": (("celery",), (), ()),
    "airflow": (("apache-airflow",), (), ()),
    "nuxt": (("nuxt",), ("nuxt.config.ts", "nuxt.config.js"), ()),
    "sveltekit": (("@sveltejs/kit",), (), ()),
    "vue": (("vue",), (), ()),
    "angular": (("@angular/core",), ("angular.json",), ()),
}
#: Frameworks whose layout is known; the others are detected and reported as known unknowns.
LAYOUTS = ("django", "pytest", "jest", "nextjs", "rails")


def declared_packages(text: str | None) -> list[str]:
    """Names of the packages that a project file depends on; none where it is not TOML."""
    try:
        doc = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return []
    at = lambda *keys: reduce(lambda d, k: d.get(k) if isinstance(d, dict) else None, keys, doc)
    listed = [at("project", "dependencies"), at("build-system", "requires"), *(t.values() for t in (at("project", "optional-dependencies"), at("dependency-groups")) if isinstance(t, dict))]
    flat = [x for group in listed if group for y in group for x in (y if isinstance(y, list) else [y]) if isinstance(x, str)]
    names = [m[0] for x in flat if (m := re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", x.strip()))]
    groups = at("tool", "poetry", "group")
    tables = [at("tool", "poetry", "dependencies"), at("tool", "poetry", "dev-dependencies"), *(g.get("dependencies") for g in (groups.values() if isinstance(groups, dict) else ()) if isinstance(g, dict))]
    return names + [k for t in tables if isinstance(t, dict) for k in t if k.lower() != "python"]


def _keys(df: DataFrame) -> list[str]:
    """Many trees are kept apart by ``repo``; of one tree there is no such column."""
    return ["repo"] if "repo" in df.columns else []


def _project_packages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(*of, x) for *of, t in pdf.itertuples(index=False, name=None) for x in declared_packages(t)], columns=[*pdf.columns[:-1], "package"])


def dependencies(files: DataFrame) -> DataFrame:
    """``package, path``: lower-cased names that requirement files, package manifests, project files and Gemfiles declare."""
    keys = _keys(files)
    name = paths.basename(F.col("path"))
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")
    req = files.where(name.rlike(r"^requirements.*\.txt$")).select(*keys, "path", line).select(*keys, "path", F.regexp_extract("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1).alias("package"))
    gem = files.where(name == "Gemfile").select(*keys, "path", line).select(*keys, "path", F.regexp_extract("line", r"""^\s*gem\s+["']([^"']+)["']""", 1).alias("package"))
    toml = files.where(name == "pyproject.toml").select(*keys, "path", "text").mapInPandas(_project_packages, "repo string, " * len(keys) + "path string, package string")
    named = [F.map_keys(F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>"))) for k in ("dependencies", "devDependencies", "peerDependencies")]
    npm = files.where(name == "package.json").select(*keys, "path", F.explode(F.concat(*named)).alias("package"))
    return req.unionByName(gem).unionByName(toml).unionByName(npm).where("package <> ''").select(*keys, F.lower("package").alias("package"), "path").distinct()


def detect(files: DataFrame) -> DataFrame:
    """``framework, via, evidence``: a dependency beats a marker file, which beats a config section; the first path among equals."""
    rows = []
    keys = _keys(files)
    spark = files.sparkSession
    table = [(f, 0, p, None) for f, (ps, _, _) in SIGNATURES.items() for p in ps]
    table += [(f, 1, m, None) for f, (_, ms, _) in SIGNATURES.items() for m in ms] + [(f, 2, a, b) for f, (_, _, cs) in SIGNATURES.items() for a, b in cs]
    sig = F.broadcast(spark.createDataFrame(table, "framework string, via int, name string, section string"))
    rows.append(dependencies(files).join(sig.where("via = 0"), F.col("package") == F.col("name")).select(*keys, "framework", "via", "path"))
    rows.append(files.select(*keys, "path").join(sig.where("via = 1"), F.col("path") == F.col("name")).select(*keys, "framework", "via", "path"))
    rows.append(files.select(*keys, "path", "text").join(sig.where("via = 2"), (F.col("path") == F.col("name")) & F.contains("text", F.col("section"))).select(*keys, "framework", "via", "path"))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    via = F.element_at(F.array(*map(F.lit, ("dependency", "marker", "config_section"))), F.col("r.via") + 1)
    return every.groupBy(*keys, "framework").agg(F.min(F.struct("via", "path")).alias("r")).select(*keys, "framework", via.alias("via"), F.col("r.path").alias("evidence"))


def layout_rules(path: Column) -> list[tuple[str, str, Column]]:
    """(framework, rule, condition): pure path predicates."""
    base = paths.basename(path)
    stem, ext = F.regexp_extract(base, r"^(.*)\.[^.]*$", 1), paths.extension(path)
    app = (F.startswith(path, F.lit("app/")) | F.startswith(path, F.lit("src/app/"))) & ext.isin("js", "jsx", "ts", "tsx")
    test = F.endswith(base, F.lit(".py")) & (base != "conftest.py") & (F.startswith(base, F.lit("test_")) | F.endswith(base, F.lit("_test.py")))
    ruby = F.endswith(path, F.lit(".rb"))
    return [
        ("pytest", "pytest_conftest", base == "conftest.py"),
        ("pytest", "pytest_test_module", test),
        ("jest", "jest_manual_mock", F.array_contains(F.split(path, "/"), "__mocks__")),
        ("nextjs", "next_page", app & (stem == "page")),
        ("nextjs", "next_layout", app & (stem == "layout")),
        ("nextjs", "next_route", app & (stem == "route")),
        ("nextjs", "next_special", app & stem.isin("template", "default", "error", "global-error", "loading", "not-found")),
        ("rails", "rails_routes", path == "config/routes.rb"),
        ("rails", "rails_initializer", F.startswith(path, F.lit("config/initializers/")) & ruby),
        ("rails", "rails_job", F.startswith(path, F.lit("app/jobs/")) & ruby),
        ("django", "django_settings", (base == "settings.py") | (F.endswith(path, F.lit(".py")) & (paths.basename(paths.parent(path)) == "settings"))),
        ("django", "django_command", path.rlike(r"(^|/)management/commands/[^/]+\.py$") & (base != "__init__.py")),
        ("django", "django_urlconf", base == "urls.py"),
    ]


def convention_roots(files: DataFrame, detected: DataFrame) -> DataFrame:
    """Tier B: paths that a detected framework loads by their place; the first rule of a path and rule name stays."""
    rules = [F.when(c, F.struct(F.lit(f).alias("framework"), F.lit(r).alias("rule"))) for f, r, c in layout_rules(F.col("path"))]
    keys = _keys(files)
    hit = files.select(*keys, "path", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r")).select(*keys, "path", "r.*")
    j = large(hit).join(detected, [*keys, "framework"])
    none = F.lit(None).cast("string")
    return j.select(*keys, F.lit("B").alias("tier"), "rule", "framework", "evidence", "path", none.alias("symbol"), F.lit("path").alias("target"), F.col("via").alias("detail")).toDF(*keys, *COLUMNS).dropDuplicates([*keys, "path", "rule"])


def installed_apps(files: DataFrame, detected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """App configurations of Django: the classes in ``apps.py`` of the tree, and settings whose list of apps is not all literal, as gaps."""
    keys = _keys(files)
    django = detected.where("framework = 'django'").select(*keys, F.col("evidence").alias("detected_in"))
    where_django = lambda df: large(df).join(django, keys) if keys else df.crossJoin(F.broadcast(django.limit(1)))  # noqa: E731  one row: a framework is detected once
    none = F.lit(None).cast("string")
    names = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*AppConfig[^)]*\)"), F.lit(1))
    apps = files.where(paths.basename(F.col("path")) == "apps.py").select(*keys, "path", F.explode(names).alias("symbol"))
    rows = where_django(apps).select(
        *keys, F.lit("B").alias("tier"), F.lit("django_app_config").alias("rule"), F.lit("django").alias("origin"), F.col("detected_in").alias("origin_file"), "path", "symbol", F.lit("symbol").alias("target"), none.alias("detail")
    ).toDF(*keys, *COLUMNS)
    body = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)INSTALLED_APPS\s*(?:\+)?=\s*[\[(](.*?)[\])]", 1)
    bare = F.regexp_replace(F.regexp_replace(body, "#[^\n]*", ""), "[\"'][^\"'\n]*[\"']|[,\\s]", "")
    settings = files.where((paths.basename(F.col("path")) == "settings.py") & F.contains("text", F.lit("INSTALLED_APPS")))
    literal = F.col("text").rlike(r"(?s)INSTALLED_APPS\s*=\s*[\[(]")
    gaps = where_django(settings.where(~literal | (bare != ""))).select(*keys, F.lit("B").alias("tier"), F.col("path").alias("origin_file"), F.lit("INSTALLED_APPS is not all literal").alias("detail"))
    return rows, gaps


def known_unknowns(detected: DataFrame) -> DataFrame:
    return detected.where(~F.col("framework").isin(*LAYOUTS)).select(*_keys(detected), F.lit("B").alias("tier"), F.col("evidence").alias("origin_file"), F.concat(F.lit("no layout rules for "), "framework").alias("detail"))


def declared_table(spark: SparkSession, entries: list[tuple[str, str, str, str, str | None]]) -> DataFrame:
    """``idx, pathspec, regex, negated, literal, reason, kind, status, expires`` of (pathspec, reason, kind, status, expires)."""
    rows = []
    for i, (spec, reason, kind, status, expires) in enumerate(entries):
        p = pathspec(spec)
        rows.append((i, spec, p.regex, p.negated, p.literal, reason, kind, status, expires))
    return spark.createDataFrame(rows, "idx int, pathspec string, regex string, negated boolean, literal string, reason string, kind string, status string, expires string")


def deciding(files: DataFrame, declared: DataFrame) -> DataFrame:
    """``path, idx``: the last entry that matches a path; entries with ``repo`` are for their own tree."""
    keys, own = _keys(files), _keys(declared)
    matches = F.regexp_like("path", F.col("regex"))
    some = files.select(*keys, "path")
    hit = large(some).join(declared, own).where(matches) if keys and own else some.join(F.broadcast(declared), matches)  # without trees, entries are a list that people wrote
    return hit.groupBy(*keys, "path").agg(F.max("idx").alias("idx"))


def declared_roots(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Tier C: the deciding entry makes a root, unless it is negated or was rejected."""
    keys = _keys(files)
    own = [k for k in _keys(declared) if k in keys]
    j = (large(deciding(files, declared)).join(declared, [*own, "idx"]) if own else deciding(files, declared).join(F.broadcast(declared), "idx")).where("not negated and status <> 'rejected'")
    none = F.lit(None).cast("string")
    return j.select(*keys, F.lit("C").alias("tier"), F.lit("declared").alias("rule"), "pathspec", none.alias("origin_file"), "path", none.alias("symbol"), F.lit("path").alias("target"), "reason").toDF(*keys, *COLUMNS)


def lint(files: DataFrame, declared: DataFrame, now: str) -> DataFrame:
    """``idx, pathspec, reason`` of entries that rotted: referent_gone, then expired, then matched_nothing."""
    decided = deciding(files, declared).select("idx").distinct().withColumn("decided", F.lit(True))
    there = files.select(F.explode(paths.ancestors(F.col("path"))).alias("literal")).distinct().withColumn("there", F.lit(True))
    j = declared.join(decided, "idx", "left").join(there, "literal", "left")
    reason = (
        F.when(F.col("literal").isNotNull() & F.col("there").isNull(), "referent_gone")
        .when(F.col("expires").isNotNull() & has_expired(F.col("expires"), F.lit(now)), "expired")
        .when(F.col("decided").isNull(), "matched_nothing")
    )
    return j.select("idx", "pathspec", reason.alias("reason")).where("reason is not null")


# What a source line says about the name in it or the item behind it.
def source_roots(files: DataFrame) -> DataFrame:
    """Tier A from source lines, see ``markers.source_roots``: a marker roots the symbol it declares, not the file around it; Python's start-up files are roots themselves."""
    keys = _keys(files)
    found = markers.source_roots(files)
    return found.select(
        *keys, F.lit("A").alias("tier"), "rule", F.concat(F.lit("line "), F.col("line").cast("string")).alias("origin"), F.col("path").alias("origin_file"), F.when(F.col("symbol").isNull(), F.col("path")).alias("path"), "symbol",
        F.when(F.col("symbol").isNull(), "path").otherwise("symbol").alias("target"), F.col("target").alias("detail"),
    ).toDF(*keys, *COLUMNS)


def resolve(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Tier A out of manifest rows: a path target that is neither a file nor a directory of the tree is unresolved."""
    keys = _keys(files)
    there = files.select(*keys, F.explode(paths.ancestors(F.col("path"))).alias("target")).distinct().withColumn("there", F.lit(True))
    j = large(manifest.where("kind <> 'error'")).join(there, [*keys, "target"], "left")
    kind = F.when((F.col("target_kind") == "path") & F.col("there").isNull(), "unresolved").otherwise(F.col("target_kind"))
    path = F.when(kind == "path", F.col("target"))
    return j.select(*keys, "tier", "kind", "key", F.col("path").alias("origin_file"), path.alias("path"), F.when(F.col("target_kind") == "reference", F.regexp_replace("target", "^.*:", "")).alias("symbol"), kind.alias("target"), F.col("target").alias("detail")).toDF(*keys, *COLUMNS)


def materialize(files: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All roots, distinct, and the gaps (``tier, origin_file, detail``). A branch that could not read yields gaps, not an exception.

    ``files(path, text, read_status)`` is one tree, or with ``repo`` any number of trees, whose roots and gaps carry it. One manifest that cannot be parsed empties tier A of the manifests of
    its own tree, and of no other: what it would have named is not known.
    """
    if not _keys(files):
        found, gaps = materialize(files.withColumn("repo", F.lit("")), declared)
        return found.drop("repo"), gaps.drop("repo")
    manifest = kept(manifest_roots(files))  # read by Python, once
    errors = manifest.where("kind = 'error'").select("repo", "tier", F.col("path").alias("origin_file"), "detail")
    tier_a = large(resolve(manifest, files)).join(errors.select("repo").distinct(), "repo", "left_anti")
    detected = kept(detect(files))
    apps, unresolved = installed_apps(files, detected)
    every = tier_a.unionByName(source_roots(files)).unionByName(convention_roots(files, detected)).unionByName(apps)
    if declared is not None:
        every = every.unionByName(declared_roots(files, declared))
    return every.distinct(), errors.unionByName(known_unknowns(detected)).unionByName(unresolved)


def rescues(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """``kind, claim, rule``: a path is rescued by a root that is exactly it, a symbol by a root's symbol that it names; the first root in order."""
    order = F.struct("tier", F.coalesce("path", F.lit("")).alias("p"), "rule", F.coalesce("origin", F.lit("")).alias("o"))
    p = claims.where("kind = 'path'").select("kind", "claim").distinct().join(large(roots.where("path is not null").withColumn("claim", F.col("path"))), "claim")
    s = claims.where("kind = 'symbol'").select("kind", "claim").distinct().withColumn("key", F.explode(bare_suffixes(F.col("claim"))))
    s = s.join(large(roots.where("symbol is not null").withColumn("key", F.col("symbol"))), "key").drop("key")
    both = p.select("kind", "claim", *COLUMNS).unionByName(s.select("kind", "claim", *COLUMNS))
    return both.groupBy("kind", "claim").agg(F.min_by("rule", order).alias("rule"))


def printseeds(roots: DataFrame) -> DataFrame:
    """``line``: tab-separated roots, in order, with backslashes, line breaks and tabs escaped."""
    def escaped(c: str) -> Column:
        x = F.coalesce(F.col(c), F.lit(""))
        for raw, said in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            x = F.replace(x, F.lit(raw), F.lit(said))
        return x

    return roots.orderBy("tier", "path", "rule", "origin", "symbol").select(F.concat_ws("\t", *[escaped(c) for c in COLUMNS]).alias("line"))
