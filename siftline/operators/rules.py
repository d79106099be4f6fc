"""Never-touch rules: classes of paths and contents that no evidence makes removable.

Files are rows ``path, head (first bytes as Latin-1 text), text, read_status``. A rule table is compiled into one expression, whose first match in
table order wins; tables that users bring are joined as rows instead. Classes stack: a file gets a row for each class that holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.globs import attribute_regex
from siftline.functions.text import any_of, ascii_lower
from siftline.operators.generated import generated


@dataclass(frozen=True)
class Rule:
    """``matcher`` names a shape of ``matches``; ``name`` is what a report quotes."""

    matcher: str
    literal: str
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or self.literal


def _table(matcher: str, *literals: str) -> tuple[Rule, ...]:
    return tuple(Rule(matcher, x) for x in literals)


# The rule tables, in their order.
UPLOADS = _table("anchored", "media/", "uploads/", "upload/", "storage/app/", "wp-content/uploads/", "public/system/", "attachments/", "user-content/", "usercontent/")
SESSIONS = (
    Rule("base", ".RData"), Rule("base", ".Rhistory"), Rule("base", ".Ruserdata"), Rule("anchored", ".Rproj.user/"), Rule("base_suffix", ".bak", "*.bak"), Rule("base_suffix", ".orig", "*.orig"),
    Rule("base_suffix", ".rej", "*.rej"), Rule("base_suffix", ".swp", "*.swp"), Rule("base_suffix", ".swo", "*.swo"), Rule("base_suffix", "~", "*~"), Rule("anchored", ".history/"),
    Rule("anchored", ".ipynb_checkpoints/"), Rule("anchored", ".vs/"),
)
LEGAL_STEMS = (
    "LICENSE", "LICENCE", "COPYING", "COPYRIGHT", "NOTICE", "AUTHORS", "CONTRIBUTORS", "MAINTAINERS", "PATENTS", "UNLICENSE", "LEGAL", "THIRD_PARTY_NOTICES", "THIRD-PARTY-NOTICES",
    "THIRDPARTYNOTICES", "OWNERS",
)
LEGAL_PATHS = (
    Rule("anchored", "LICENSES/"), Rule("anchored", ".reuse/"), Rule("base_suffix_ci", ".spdx", "*.spdx"), Rule("base_suffix_ci", ".spdx.json", "*.spdx.json"),
    Rule("base_suffix_ci", ".spdx.yaml", "*.spdx.yaml"), Rule("base_suffix_ci", ".spdx.rdf", "*.spdx.rdf"), Rule("base_suffix_ci", ".cdx.json", "*.cdx.json"),
    Rule("base_suffix_ci", ".cdx.xml", "*.cdx.xml"), Rule("base_ci", "bom.json"), Rule("base_ci", "sbom.json"),
)
SPDX_LINES, SPDX_MARKER = 16, "SPDX-License-Identifier:"
MINIFIED_MEAN, MINIFIED_EXTENSIONS = 110, (".js", ".css")
EXTENSIONS = {
    "1b": ("pem", "key", "p8", "p12", "pfx", "pkcs12", "jks", "jceks", "keystore", "kdbx", "ppk", "asc", "gpg", "agekey"),
    "1c": ("tfstate", "tfvars", "tfplan"),
    "1d": ("db", "db3", "sqlite", "sqlite3", "sqlitedb", "mdb", "accdb", "realm", "rdb", "aof", "ldb", "sst", "frm", "ibd", "myd", "myi", "dbf", "fdb"),
    "1e": ("pt", "pth", "ckpt", "safetensors", "onnx", "tflite", "gguf", "ggml", "joblib", "mlmodel", "mlpackage", "caffemodel", "pdparams", "engine", "h5", "hdf5", "pkl", "pickle"),
    "1f": ("csv", "tsv", "parquet", "avro", "orc", "feather", "arrow", "ndjson", "jsonl", "npy", "npz", "dvc"),
}
NAMES = {
    "1b": ("id_rsa", "id_dsa", "id_ecdsa", "id_ecdsa_sk", "id_ed25519", "id_ed25519_sk", ".netrc", "_netrc", ".npmrc", ".pypirc", ".git-credentials", ".htpasswd", ".dockercfg", ".pgpass", ".my.cnf", ".s3cfg", "credentials", "credentials.json"),
    "1d": ("PG_VERSION", "dump.rdb", "appendonly.aof", "data.mdb", "lock.mdb"),
    "1e": ("pytorch_model.bin", "model.bin", "tf_model.h5", "flax_model.msgpack", "saved_model.pb"),
    "1f": ("dvc.lock",),
}
TEMPLATE_TOKENS = ("example", "sample", "template", "dist", "defaults", "schema", "tpl", "tmpl")
SECRET_EXTENSIONS = ("yaml", "yml", "json", "toml", "ini", "cfg", "conf", "properties", "env", "enc", "tfvars")
SECRET_DIRECTORIES = (".ssh", ".gnupg", ".aws", ".azure", ".kube")
# class, offset, bytes (Latin-1), label
MAGICS = (
    ("1d", 0, "SQLite format 3\x00", "begins as a SQLite 3 database"), ("1d", 0, "REDIS", "begins as a Redis snapshot"), ("1d", 8, "DUCK", "begins as a DuckDB database"),
    ("1d", 4, "Standard Jet DB", "begins as an Access database, Jet engine"), ("1d", 4, "Standard ACE DB", "begins as an Access database, ACE engine"),
    ("1d", 12, "\x00\x06\x15\x61", "begins as a Berkeley DB tree"), ("1b", 0, "-----BEGIN OPENSSH PRIVATE KEY-----", "holds an OpenSSH key, private"),
    ("1b", 0, "-----BEGIN RSA PRIVATE KEY-----", "holds an RSA key, private"), ("1b", 0, "-----BEGIN EC PRIVATE KEY-----", "holds an elliptic-curve key, private"),
    ("1b", 0, "-----BEGIN DSA PRIVATE KEY-----", "holds a DSA key, private"), ("1b", 0, "-----BEGIN ENCRYPTED PRIVATE KEY-----", "holds an encrypted PKCS 8 key"),
    ("1b", 0, "-----BEGIN PRIVATE KEY-----", "holds a PKCS 8 key"), ("1b", 0, "-----BEGIN PGP PRIVATE KEY BLOCK-----", "holds a PGP secret key"),
    ("1b", 0, "PuTTY-User-Key-File-", "holds a PuTTY key, private"), ("1c", 0, "$ANSIBLE_VAULT;", "sealed by Ansible Vault"), ("1e", 0, "GGUF", "begins as a GGUF model"),
    ("1e", 0, "\x89HDF\r\n\x1a\n", "begins as an HDF5 file"), ("1f", 0, "version https://git-lfs.github.com/spec/", "points into git-lfs"),
    ("1f", 0, "PAR1", "begins as Parquet"), ("1f", 0, "ARROW1", "begins as Arrow"), ("1f", 0, "Obj\x01", "begins as Avro"),
)
CONTRACTS = (
    *_table("base", "CNAME", ".nojekyll", "_config.yml", "CODEOWNERS"), *_table("exact", ".github/dependabot.yml", ".github/dependabot.yaml"), *_table("base", "renovate.json", ".renovaterc.json"),
    *_table("inside", ".github/workflows"), *_table("exact", ".github/FUNDING.yml"), *_table("inside", ".github/ISSUE_TEMPLATE"),
    *_table("base", "action.yml", "action.yaml", "_redirects", "_headers", "netlify.toml", "vercel.json", "static.json", "apple-app-site-association", "assetlinks.json"),
    *_table("inside", ".well-known/acme-challenge", ".well-known/pki-validation"),
    *_table("base", "apple-developer-merchantid-domain-association", "microsoft-identity-association.json", "openid-configuration", "change-password", "security.txt"),
    *_table("inside", ".well-known"),
    *_table("base", "ads.txt", "app-ads.txt", ".htaccess", "web.config", "robots.txt", "manifest.webmanifest", "manifest.json", "service-worker.js", "VERSION", ".python-version", ".nvmrc",
            ".ruby-version", ".node-version", ".tool-versions", "runtime.txt", "Procfile", ".buildpacks", "Staticfile", "app.yaml", "fly.toml", "render.yaml", "railway.json"),
    *_table("inside", ".platform"), *_table("base", ".gitattributes", ".gitignore", "codecov.yml", ".codecov.yml", ".coveragerc", "sonar-project.properties"),
)
EVIDENCE_ARTIFACTS = (
    *_table("base", ".coverage", "coverage.xml", "lcov.info", "jacoco.exec"), *_table("extension", "profraw", "profdata", "gcda", "gcno"), *_table("inside", ".nyc_output", "coverage", "htmlcov", ".turbo")
)
KNOWN_EXTENSIONS = (
    "rs", "py", "pyi", "js", "mjs", "cjs", "jsx", "ts", "tsx", "go", "java", "kt", "kts", "scala", "rb", "php", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "cs", "swift", "m", "mm",
    "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "pl", "pm", "lua", "r", "jl", "ex", "exs", "erl", "hrl", "clj", "cljs", "hs", "ml", "mli", "fs", "fsx", "dart", "vue",
    "svelte", "elm", "nim", "zig", "sql", "proto", "thrift", "graphql", "gql", "tf", "hcl", "bzl", "cmake", "gradle", "sbt", "html", "htm", "xhtml", "css", "scss", "sass", "less",
    "styl", "md", "markdown", "rst", "adoc", "txt", "tex", "org", "json", "jsonc", "json5", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "env", "xml", "csv", "tsv",
    "parquet", "avro", "ndjson", "jsonl", "lock", "plist", "png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico", "bmp", "tiff", "mp3", "wav", "flac", "mp4", "webm", "mov",
    "woff", "woff2", "ttf", "otf", "eot", "zip", "tar", "gz", "bz2", "xz", "zst", "7z", "jar", "war", "so", "dylib", "dll", "exe", "a", "o", "wasm", "pdf", "class", "pyc", "whl",
    "deb", "rpm", "dmg", "iso", "pt", "pth", "onnx", "safetensors", "pkl", "h5", "npy", "npz", "ipynb", "pem", "crt", "cer", "p12", "pfx", "jks", "keystore", "db", "sqlite",
    "sqlite3",
)
KNOWN_NAMES = (
    "Makefile", "GNUmakefile", "Dockerfile", "Containerfile", "Vagrantfile", "Jenkinsfile", "Rakefile", "Gemfile", "Guardfile", "Brewfile", "Justfile", "justfile", "BUILD",
    "WORKSPACE", "LICENSE", "LICENCE", "COPYING", "NOTICE", "README", "CHANGELOG", "AUTHORS", "CONTRIBUTING", "MAINTAINERS", "TODO", ".editorconfig", ".dockerignore", ".npmignore",
    ".prettierignore", ".eslintignore", ".gitmodules", ".gitkeep", ".keep", "py.typed", "go.sum", "go.mod",
)
TYPE_MAGICS = (
    "SQLite format 3\x00", "\x89PNG\r\n\x1a\n", "%PDF-", "GIF87a", "GIF89a", "\x7fELF", "\xca\xfe\xba\xbe", "\x00asm", "PK\x03\x04", "\xff\xd8\xff", "\x1f\x8b", "BZh", "\xfd7zXZ\x00",
    "\x28\xb5\x2f\xfd", "\xcf\xfa\xed\xfe", "\xce\xfa\xed\xfe", "!<arch>\n", "<?xml", "#!",
)
SPECIFICITY = {"magic": 5, "pointer": 4, "in_store": 3, "name": 2, "tree": 1, "incomplete": 0}
ATTRIBUTES = ("linguist-vendored", "linguist-generated", "filter=lfs")
MIGRATION_DIRECTORIES = ("migrations", "migrate")
API_GROUPS = {"argoproj.io": "argocd", "fluxcd.io": "flux", "crossplane.io": "crossplane", "kustomize.config.k8s.io": "kustomize"}
MARKERS_SHOWN = 8


@dataclass(frozen=True)
class Parts:
    """What the matchers look at in a path: expressions, or columns that hold their values."""

    base: Column
    low: Column
    directory: Column
    extension: Column


def parts_of(path: Column) -> Parts:
    base = paths.basename(path)
    return Parts(base, ascii_lower(base), F.concat(F.lit("/"), paths.parent(path), F.lit("/")), paths.extension(path))


def with_parts(files: DataFrame) -> tuple[DataFrame, Parts]:
    """``files`` with the parts of ``path`` as columns, so that tables of rules evaluate each once a row, and these columns."""
    of = parts_of(F.col("path"))
    names = {"__base": of.base, "__directory": of.directory, "__extension": of.extension}
    held = files.withColumns(names).withColumn("__low", ascii_lower(F.col("__base")))
    return held, Parts(*map(F.col, ("__base", "__low", "__directory", "__extension")))


def matches(matcher: str, path: Column, literal: Column, parts: Parts | None = None) -> Column:
    """The matcher algebra: all shapes are plain string tests."""
    parts = parts or parts_of(path)
    base, low, directory = parts.base, parts.low, parts.directory
    shapes = {
        "anchored": F.startswith(path, literal) | F.contains(path, F.concat(F.lit("/"), literal)),
        "contains": F.contains(path, literal),
        "prefix": F.startswith(path, literal),
        "exact": path == literal,
        "base_suffix": F.endswith(base, literal),
        "base": base == literal,
        "base_prefix": F.startswith(base, literal),
        "base_suffix_ci": F.endswith(low, ascii_lower(literal)),
        "base_ci": low == ascii_lower(literal),
        "inside": F.contains(directory, F.concat(F.lit("/"), literal, F.lit("/"))),
        "extension": parts.extension == literal,
    }
    return shapes[matcher]


MATCHERS = ("anchored", "contains", "prefix", "exact", "base_suffix", "base", "base_prefix", "base_suffix_ci", "base_ci", "inside", "extension")


def first_rule(path: Column, table: tuple[Rule, ...], parts: Parts | None = None) -> Column:
    """What the first matching rule is called; null if none matches. Neighbours that ask for a whole name, and are called by it, are one test."""
    parts = parts or parts_of(path)
    out = None
    for named, rules in groupby(table, lambda r: r.matcher == "base" and r.label == r.literal):
        rules = list(rules)
        tests = [(parts.base.isin(*[r.literal for r in rules]), parts.base)] if named else [(matches(r.matcher, path, F.lit(r.literal), parts), r.label) for r in rules]
        for hit, label in tests:
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(None).cast("string") if out is None else out


def rule_matches(files: DataFrame, table: DataFrame) -> DataFrame:
    """``path, class, idx, rule``: the first row by ``idx`` of ``table(class, idx, matcher, literal, rule)`` for each path and class."""
    path, literal = F.col("path"), F.col("literal")
    hit = any_of([(F.col("matcher") == m) & matches(m, path, literal) for m in MATCHERS])
    return files.select("path").join(F.broadcast(table), hit).groupBy("path", "class").agg(F.min_by(F.struct("idx", "rule"), "idx").alias("r")).select("path", "class", "r.idx", "r.rule")


def best_evidence(rows: DataFrame) -> DataFrame:
    """The most specific evidence of each (path, class), the first by ``seq`` among equals; one row a task and key moves."""
    order = F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv])
    g = rows.groupBy("path", "class").agg(F.max_by(F.struct("evidence", "via"), F.struct(order[F.col("via")], -F.col("seq"))).alias("r"))
    return g.select("path", "class", "r.via", "r.evidence")


def _name_evidence(path: Column, of: Parts) -> list[tuple[str, Column, str]]:
    base, low, ext = of.base, of.low, ascii_lower(of.extension)
    parts = F.split(path, "/")
    template = F.arrays_overlap(F.split(low, r"\."), F.array(*map(F.lit, TEMPLATE_TOKENS)))
    out = [
        ("1b", ((low == ".env") | F.startswith(low, F.lit(".env.")) | F.endswith(low, F.lit(".env"))) & ~template, "a dotenv name"),
        ("1b", F.contains(low, F.lit("secret")) & ext.isin(*SECRET_EXTENSIONS), "a credential store's name"),
        ("1b", F.arrays_overlap(parts, F.array(*map(F.lit, SECRET_DIRECTORIES))), "inside an identity directory"),
        ("1b", (low == "config.local") & (paths.basename(paths.parent(path)) == ".dvc"), "a data store's private settings"),
        ("1c", F.contains(low, F.lit(".tfstate")) | F.endswith(low, F.lit(".tfvars.json")), "a Terraform state name"),
        ("1c", F.startswith(base, F.lit("Pulumi.")) & ext.isin("yaml", "yml") & ~low.isin("pulumi.yaml", "pulumi.yml"), "a Pulumi stack's settings"),
        ("1c", (F.get(parts, F.lit(0)) == ".pulumi") | F.array_contains(parts, "cdk.out"), "inside a state directory"),
        ("1d", F.startswith(low, F.lit("ib_logfile")) | F.startswith(low, F.lit("ibdata")), "an InnoDB name"),
    ]
    out += [(c, ext.isin(*v), "an extension") for c, v in EXTENSIONS.items()]
    out += [(c, low.isin(*[x.lower() for x in v]), "a file name") for c, v in NAMES.items()]
    return out


def _each(files: DataFrame, rows: list[Column]) -> DataFrame:
    """``path, r``: a row for each of ``rows`` that is not null.

    The array is a column and goes through no higher-order function, and explode_outer infers no test of it: Spark interprets what stands within either, row by row.
    """
    return files.select("path", F.array(*rows).alias("found")).select("path", F.explode_outer("found").alias("r")).where("r is not null")


def state_evidence(files: DataFrame) -> DataFrame:
    """``path, class (1b-1f), via, evidence, seq``: by magic bytes, by store pointers, by names; unread content is incomplete evidence of every class."""
    path, head = F.col("path"), F.col("head")
    files, parts = with_parts(files)
    rows = []
    for i, (c, at, sig, label) in enumerate(MAGICS):
        rows.append(F.when(F.substring(head, at + 1, len(sig)) == sig, F.struct(F.lit(c).alias("class"), F.lit("magic").alias("via"), F.lit(label).alias("evidence"), F.lit(i).alias("seq"))))
    pointer = F.coalesce(F.col("link_target"), F.lit(""))
    for needle, store in ((".git/annex/objects", "annex"), ("/annex/objects/", "annex"), (".dvc/cache", "dvc"), (".git/lfs/objects", "lfs")):
        rows.append(F.when(F.contains(pointer, F.lit(needle)), F.struct(F.lit("1f").alias("class"), F.lit("pointer").alias("via"), F.lit(store).alias("evidence"), F.lit(100).alias("seq"))))
    rows.append(F.when(F.startswith(path, F.lit(".dvc/")), F.struct(F.lit("1f").alias("class"), F.lit("in_store").alias("via"), F.lit("dvc").alias("evidence"), F.lit(200).alias("seq"))))
    for i, (c, hit, label) in enumerate(_name_evidence(path, parts)):
        rows.append(F.when(hit, F.struct(F.lit(c).alias("class"), F.lit("name").alias("via"), F.lit(label).alias("evidence"), F.lit(300 + i).alias("seq"))))
    for c in ("1b", "1c", "1d", "1e", "1f"):
        rows.append(F.when(F.col("read_status") != "completed", F.struct(F.lit(c).alias("class"), F.lit("incomplete").alias("via"), F.col("read_status").alias("evidence"), F.lit(900).alias("seq"))))
    return _each(files, rows).select("path", "r.*")


def survey(files: DataFrame) -> DataFrame:
    """1a: ``system, n_markers, shown`` of external effectors that the tree itself declares; the first markers are shown, all are counted."""
    path = F.col("path")
    base = paths.basename(path)
    low, ext, parts = ascii_lower(base), paths.extension(path), F.split(path, "/")
    n = F.size(parts)
    role = low.isin("main.yml", "main.yaml") & (n >= 4) & (F.get(parts, n - 2) == "tasks") & F.array_contains(F.slice(parts, F.lit(1), F.greatest(n - 3, F.lit(0))), "roles")
    system = (
        F.when((ext == "tf") | F.endswith(low, F.lit(".tf.json")) | low.isin(".terraform.lock.hcl", "terragrunt.hcl"), "terraform")
        .when(F.startswith(base, F.lit("Pulumi.")) & ext.isin("yaml", "yml"), "pulumi")
        .when(low == "cdk.json", "cdk")
        .when(low.isin("chart.yaml", "chart.yml"), "helm")
        .when(low.isin("kustomization.yaml", "kustomization.yml") | (base == "Kustomization"), "kustomize")
        .when((low == "ansible.cfg") | role, "ansible")
    )
    groups = F.filter(F.array(*[F.when(ext.isin("yaml", "yml") & F.contains("head_64k", F.lit(g)), s) for g, s in API_GROUPS.items()]), lambda s: s.isNotNull())
    rows = files.withColumn("head_64k", F.substring("text", 1, 65536)).select("path", F.explode(F.array_distinct(F.concat(F.when(system.isNotNull(), F.array(system)).otherwise(F.array().cast("array<string>")), groups))).alias("system"))
    counted = rows.groupBy("system").agg(F.count(F.lit(1)).alias("n_markers"))
    # Only the first few paths of a system are gathered: the smallest of each task, then the smallest of these.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64)))
    return counted.join(_smallest(_smallest(salted, ["system", "salt"]), ["system"]), "system")


def _smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("rank") <= MARKERS_SHOWN)
    if keys == ["system"]:
        return ranked.groupBy("system").agg(F.array_sort(F.collect_list("path")).alias("shown"))
    return ranked.drop("rank")


def attribute_rules(spark: SparkSession, rows: list[tuple[str, int, str, str, bool]]) -> DataFrame:
    """``dir, depth, line, regex, whole, attribute, is_set`` of (directory, line, pattern, attribute, set)."""
    out = []
    for d, line, pattern, attribute, is_set in rows:
        regex, whole = attribute_regex(pattern)
        out.append((d, 0 if not d else d.count("/") + 1, line, pattern, regex, whole, attribute, is_set))
    return spark.createDataFrame(out, "dir string, depth int, line int, pattern string, regex string, whole boolean, attribute string, is_set boolean")


def last_match(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, attribute, pattern, is_set``: of the rules that match a path, the last by (depth, directory, line) decides, for each attribute."""
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring("path", F.length("dir") + 2, F.length("path")))
    inside = (F.col("dir") == "") | F.startswith("path", F.concat("dir", F.lit("/")))
    text = F.when(F.col("whole"), rel).otherwise(paths.basename(F.col("path")))
    hit = files.select("path").join(F.broadcast(rules), inside & F.regexp_like(text, F.col("regex")))
    g = hit.groupBy("path", "attribute").agg(F.max_by(F.struct("pattern", "is_set"), F.struct("depth", "dir", "line")).alias("r"))
    return g.select("path", "attribute", "r.pattern", "r.is_set")


def with_sequence(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``), and ``scheme`` and ``ordinal`` of names that state a place in a sequence, else null. Each step is a column of its own, so that every
    expression is evaluated once."""
    base = paths.basename(F.col("path"))
    found = {"__version": F.regexp_extract(base, r"^[VU]([0-9._]*[0-9][0-9._]*)__", 1), "__digits": F.regexp_extract(base, r"^([0-9]+)[_.-]", 1)}
    version, digits = F.col("__version"), F.col("__digits")
    scheme = F.when(version != "", "flyway_version").when(F.length(digits) >= 10, "timestamp").when((F.length(digits) >= 3) & F.startswith(digits, F.lit("0")), "zero_padded_ordinal")
    ordinal = F.when(F.col("scheme").isNotNull(), F.when(version != "", version).otherwise(digits))
    return files.withColumns(found).withColumn("scheme", scheme).withColumn("ordinal", ordinal).drop(*found)


def sequenced(files: DataFrame) -> DataFrame:
    """``path, dir, scheme, ordinal, key`` of ``files(path)``; ``key`` orders numbers of any length."""
    numbers = F.transform(F.transform(F.split("ordinal", "[._]"), lambda x: F.ltrim(x, F.lit("0"))), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    return with_sequence(files.select("path")).select("path", paths.parent(F.col("path")).alias("dir"), "scheme", "ordinal", numbers.alias("key"))


def migrations(files: DataFrame) -> DataFrame:
    """1k: ``path, scheme, ordinal, rank``: newest or earlier in its directory's sequence (ties are newest), else by a migrations directory.

    The newest key of a directory is a grouped maximum that is joined back; nothing is ranked in one place.
    """
    s = sequenced(files)
    seq = s.where("scheme is not null")
    top = seq.groupBy("dir", "scheme").agg(F.max("key").alias("top"))
    ranked = seq.join(top, ["dir", "scheme"]).select("path", "scheme", "ordinal", F.when(F.col("key") == F.col("top"), "newest").otherwise("earlier").alias("rank"))
    there = F.arrays_overlap(F.split(ascii_lower(F.col("dir")), "/"), F.array(*map(F.lit, MIGRATION_DIRECTORIES)))
    other = s.where(F.col("scheme").isNull() & there).select("path", F.lit("directory").alias("scheme"), F.lit(None).cast("string").alias("ordinal"), F.lit(None).cast("string").alias("rank"))
    return ranked.unionByName(other)


def legal(path: Column, text: Column, parts: Parts | None = None) -> Column:
    """1i: the legal stem, path rule or SPDX declaration in the first lines; null if none."""
    parts = parts or parts_of(path)
    upper = F.translate(parts.base, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    stem = F.nullif(F.regexp_extract(upper, f"^({'|'.join(LEGAL_STEMS)})(?:[._-].*)?$", 1), F.lit(""))  # no stem begins another that goes on with such a mark
    lines = F.slice(F.split(text, "\n"), F.lit(1), F.lit(SPDX_LINES))
    tails = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(SPDX_MARKER))), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_extract(x, SPDX_MARKER + "(.*)$", 1)), r"(?:\*/)+$", "")))
    spdx = F.get(F.filter(tails, lambda t: t != ""), F.lit(0))
    return F.coalesce(stem, first_rule(path, LEGAL_PATHS, parts), F.when(spdx.isNotNull(), F.concat(F.lit("SPDX "), spdx)))


def minified(path: Column, text: Column, parts: Parts | None = None) -> Column:
    """1j by content: a mean line length in bytes above the threshold (integer division), or a source map in the last two lines."""
    lines = F.split(text, "\n", -1)
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    parts = parts or parts_of(path)
    ext = any_of([F.endswith(parts.low, F.lit(e)) & (F.length(parts.base) > len(e)) for e in MINIFIED_EXTENSIONS])
    tail = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2))
    mapped = F.exists(tail, lambda x: x.rlike(r"^(?://[#@] source(?:Mapping)?URL|/\*[#@] source(?:Mapping)?URL)") | F.contains(x, F.lit("sourceURL=")))
    return ext & ((F.floor(total / F.size(lines)) > MINIFIED_MEAN) | mapped)


def unknown_type(path: Column, head: Column, parts: Parts | None = None, contract: Column | None = None) -> Column:
    """1p: neither name, contract (worked out here unless it is given), extension, leading bytes nor text says what it is."""
    parts = parts or parts_of(path)
    contract = first_rule(path, CONTRACTS, parts) if contract is None else contract
    known = parts.base.isin(*KNOWN_NAMES) | contract.isNotNull() | ascii_lower(parts.extension).isin(*KNOWN_EXTENSIONS)
    magic = any_of([F.startswith(head, F.lit(m)) for m in TYPE_MAGICS])
    return ~(known | F.coalesce(magic, F.lit(False)))


def negations(files: DataFrame, ignore: DataFrame) -> DataFrame:
    """1m: ``path, pattern``: files whose deciding ignore rule re-includes them; ``ignore(path, source, line, pattern)`` as git reports it."""
    return files.select("path").join(ignore, "path").where(F.startswith("pattern", F.lit("!"))).select("path", "source", "line", "pattern")


def judge(files: DataFrame, attributes: DataFrame | None = None, own_artifacts: tuple[Rule, ...] = (), own_ledgers: tuple[Rule, ...] = ()) -> DataFrame:
    """``path, class, evidence``: all classes that hold for a path, in a row each.

    Provenance (1j) excludes 1k, 1i, 1h and 1g, which exclude each other in this order; 1b-1f, 1l, 1n, 1o and 1p stack with everything. ``own_ledgers`` and
    ``own_artifacts`` are this tool's files (1n, 1o).
    """
    path = F.col("path")
    base = files.select("path", "head", "text")
    if attributes is not None:
        won = last_match(files, attributes).where("is_set").groupBy("path").agg(F.min("attribute").alias("attribute"))
        base = base.join(won, "path", "left")
    else:
        base = base.withColumn("attribute", F.lit(None).cast("string"))
    base, parts = with_parts(with_sequence(base))
    in_migrations = F.arrays_overlap(F.split(ascii_lower(paths.parent(path)), "/"), F.array(*map(F.lit, MIGRATION_DIRECTORIES)))
    pair = lambda c, e: F.struct(F.lit(c).alias("class"), e.alias("evidence"))
    # Each rule is a column of its own, so that it is evaluated once, and compiled.
    said = {
        "__made": generated(path, F.col("text"), parts.base), "__law": legal(path, F.col("text"), parts), "__session": first_rule(path, SESSIONS, parts), "__upload": first_rule(path, UPLOADS, parts),
        "__contract": first_rule(path, CONTRACTS, parts), "__artifact": first_rule(path, own_artifacts + EVIDENCE_ARTIFACTS, parts), "__ledger": first_rule(path, own_ledgers, parts),
    }
    base = base.withColumns(said)
    made, law, session, upload, contract, artifact, ledger = map(F.col, said)
    content = (
        F.when(F.col("attribute").isNotNull(), pair("1j", F.col("attribute")))
        .when(made.isNotNull(), pair("1j", made))
        .when(minified(path, F.col("text"), parts), pair("1j", F.lit("minified")))
        .when(F.col("scheme").isNotNull(), pair("1k", F.col("ordinal")))
        .when(in_migrations, pair("1k", F.lit("migrations directory")))
        .when(law.isNotNull(), pair("1i", law))
        .when(session.isNotNull(), pair("1h", session))
        .when(upload.isNotNull(), pair("1g", upload))
    )
    found = [
        content,
        F.when(contract.isNotNull(), pair("1l", contract)),
        F.when(ledger.isNotNull(), pair("1n", ledger)),
        F.when(artifact.isNotNull(), pair("1o", artifact)),
        F.when(unknown_type(path, F.col("head"), parts, contract), pair("1p", F.lit("unknown type"))),
    ]
    stacked = _each(base, found).select("path", "r.class", "r.evidence")
    return best_evidence(state_evidence(files)).select("path", "class", "evidence").unionByName(stacked)


def review_plan(edits: DataFrame, deletions: DataFrame, own: tuple[Rule, ...]) -> DataFrame:
    """``review, path``: a plan that deletes this tool's own files, or edits its ledger beside deletions, is refused; the first is sharper.

    ``edits`` and ``deletions`` (seq, path) are one plan, which gives one row, or with ``plan`` many, which give a row for each that edits or deletes something.
    """
    keys = ["plan"] if "plan" in edits.columns else []
    own_hit = first_rule(F.col("path"), own + EVIDENCE_ARTIFACTS).isNotNull()
    e = edits.groupBy(*keys).agg(F.min_by("path", "seq").alias("edit"))
    d = deletions.groupBy(*keys).agg(F.min_by("path", "seq").alias("deletion"), F.min_by("path", F.when(own_hit, F.col("seq"))).alias("own"))
    j = e.join(d, keys, "full") if keys else e.crossJoin(F.broadcast(d))  # one row each
    review = F.when(F.col("own").isNotNull(), "refused_self_deletion").when(F.col("edit").isNotNull() & F.col("deletion").isNotNull(), "refused_co_occurrence").otherwise("permitted")
    return j.select(*keys, review.alias("review"), F.coalesce("own", F.when(F.col("edit").isNotNull(), F.col("deletion"))).alias("path"))
