"""Entry points that manifests declare: one scanner for each format, run as a map over files.

A file yields rows ``path, tier, kind, key, target_kind, target, detail`` and, where it cannot be parsed, one row of kind ``error``: a gap is data.
The formats are nested documents, which is why these are row-wise scanners and not expressions.
"""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SHAPE = "path string, tier string, kind string, key string, target_kind string, target string, detail string"
# Names that a Python tool loads by convention -> (key, kind, tier).
IMPLICIT_PYTHON = {
    "__main__.py": ("python:dash-m", "executable", "A"),
    "conftest.py": ("pytest:conftest", "dev_target", "A"),
    "wsgi.py": ("wsgi:callable", "library_entry", "B"),
    "asgi.py": ("asgi:callable", "library_entry", "B"),
    "manage.py": ("django:manage", "executable", "B"),
    "celery.py": ("celery:app", "library_entry", "B"),
}


class Bad(Exception):
    """A manifest that says something it must not."""


def _rel(base: str, text: str) -> tuple[str, str]:
    """The target of a path in a manifest: a glob, a path below the root, or unresolved."""
    if re.search(r"[*?\[{]", text):
        return "glob", posixpath.normpath(posixpath.join(base, text)).lstrip("./")
    joined = posixpath.normpath(posixpath.join(base, text))
    if text.startswith("/") or joined == ".." or joined.startswith("../"):
        return "unresolved", text
    return "path", "" if joined == "." else joined


class Out:
    def __init__(self, path: str):
        self.path, self.base, self.rows = path, posixpath.dirname(path), []

    def put(self, kind: str, key: str, text: str, target: str | None = None, detail: str = "") -> None:
        found = (target, text) if target else _rel(self.base, text)
        self.rows.append((self.path, "A", kind, key, *found, detail))


def _text(value, key: str) -> str:
    if not isinstance(value, str):
        raise Bad(f"{key} is not a string")
    return value


def package_json(out: Out, text: str) -> None:
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise Bad("the top level is not an object")

    def exports(key: str, value) -> None:
        """The leaves of a conditional map, whatever its depth."""
        if isinstance(value, str):
            out.put("library_entry", key, value)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                exports(f"{key}[{i}]", v)
        elif isinstance(value, dict):
            for k, v in value.items():
                exports(f"{key}.{k}", v)
        elif value is not None and value is not False:
            raise Bad(f"{key} is neither a path nor a map")

    def globs(key: str, value, kind: str) -> None:
        if not isinstance(value, list):
            raise Bad(f"{key} is not an array")
        for i, v in enumerate(value):
            out.put(kind, f"{key}[{i}]", _text(v, key))

    for key in ("main", "module", "types"):
        if key in doc:
            out.put("library_entry", key, _text(doc[key], key))
    for key, kind in (("browser", "library_entry"), ("bin", "executable")):
        value = doc.get(key)
        if isinstance(value, str):
            out.put(kind, key, value)
        elif isinstance(value, dict):
            for k, v in value.items():
                if not (key == "browser" and v is False):
                    out.put(kind, f"{key}.{k}", _text(v, f"{key}.{k}"))
        elif value is not None:
            raise Bad(f"{key} is neither a path nor a map")
    for key in ("exports", "imports"):
        if key in doc:
            exports(key, doc[key])
    spaces = doc.get("workspaces")
    if isinstance(spaces, dict):
        globs("workspaces.packages", spaces.get("packages"), "workspace_member")
    elif spaces is not None:
        globs("workspaces", spaces, "workspace_member")
    if "files" in doc:
        globs("files", doc["files"], "packaged_file")
    scripts = doc.get("scripts", {})
    if not isinstance(scripts, dict):
        raise Bad("scripts is not an object")
    for k, v in scripts.items():
        out.put("command", f"scripts.{k}", _text(v, f"scripts.{k}"), "command")
    effects = doc.get("sideEffects")
    if effects is False:
        out.put("tree_shakable", "sideEffects", "", "declaration")
    elif isinstance(effects, list):
        globs("sideEffects", effects, "library_entry")
        out.put("tree_shakable_except", "sideEffects", ",".join(effects), "declaration")
    elif effects not in (None, True):
        raise Bad("sideEffects is neither a boolean nor an array")


def pyproject(out: Out, text: str) -> None:
    doc = tomllib.loads(text)
    project = doc.get("project", {})
    for group, kind in (("scripts", "executable"), ("gui-scripts", "executable")):
        for k, v in project.get(group, {}).items():
            out.put(kind, f"project.{group}.{k}", _text(v, k), "reference")
    for group, entries in project.get("entry-points", {}).items():
        for k, v in entries.items():
            out.put("plugin", f"project.entry-points.{group}.{k}", _text(v, k), "reference")
    poetry = doc.get("tool", {}).get("poetry", {})
    for k, v in poetry.get("scripts", {}).items():
        out.put("executable", f"tool.poetry.scripts.{k}", v if isinstance(v, str) else _text(v.get("reference"), k), "reference")


def cargo(out: Out, text: str) -> None:
    doc = tomllib.loads(text)
    lib = doc.get("lib")
    if isinstance(lib, dict):
        out.put("library_entry", "lib.path", _text(lib.get("path", "src/lib.rs"), "lib.path"))
        kinds = set(lib.get("crate-type", []))
        if kinds & {"cdylib", "staticlib", "dylib"}:
            out.put("consumer_outside_build", "lib.crate-type", ",".join(sorted(kinds)), "declaration")
    for table, kind, base in (("bin", "executable", "src/bin"), ("example", "example", "examples"), ("test", "test", "tests"), ("bench", "bench", "benches")):
        for i, entry in enumerate(doc.get(table, [])):
            out.put(kind, f"{table}[{i}]", entry.get("path") or f"{base}/{_text(entry.get('name'), f'{table}[{i}].name')}.rs")
    build = doc.get("package", {}).get("build")
    if isinstance(build, str):
        out.put("build_script", "package.build", build)
    for i, member in enumerate(doc.get("workspace", {}).get("members", [])):
        out.put("workspace_member", f"workspace.members[{i}]", _text(member, "members"))


def setup_cfg(out: Out, text: str) -> None:
    section = group = ""
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] in "#;":
            continue
        if bare[0] == "[":
            if not bare.endswith("]"):
                raise Bad(f"a section without an end: {bare}")
            section, group = bare[1:-1].strip(), ""
        elif section == "options.entry_points":
            if line[:1].isspace() and group:
                name, _, target = bare.partition("=")
                out.put("executable" if group in ("console_scripts", "gui_scripts") else "plugin", f"{section}.{group}.{name.strip()}", target.strip(), "reference")
            else:
                group = bare.partition("=")[0].strip()


def go_source(out: Out, text: str) -> None:
    """A Go file roots itself when its package is main."""
    bare = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    for line in bare.splitlines():
        line = line.split("//")[0].strip()
        if line:
            if re.fullmatch(r"package\s+main;?", line):
                out.put("executable", "package main", posixpath.basename(out.path))
            return


# The directives of a go.mod file.
GO_DIRECTIVES = ("module", "go", "toolchain", "godebug", "require", "exclude", "replace", "retract", "tool", "ignore")


def go_mod(out: Out, text: str) -> None:
    """The module path, and the local directories that replace others; an unknown directive, a second module and one without a path refuse the file."""
    block, modules = "", 0
    for line in text.splitlines():
        line = line.split("//")[0].strip()
        if not line:
            continue
        if block:
            word, rest = (block, line) if line != ")" else ("", "")
            block = block if line != ")" else ""
        else:
            word, _, rest = line.partition(" ")
            if rest.strip() == "(":
                block = word
                continue
        if word and word not in GO_DIRECTIVES:
            raise Bad(f"unknown directive {word}")
        if word == "module":
            modules += 1
            if modules > 1 or not rest.strip().strip('"'):
                raise Bad("a second module" if modules > 1 else "a module without a path")
            out.put("module", "module", rest.strip().strip('"'), "reference")
        elif word == "replace" and "=>" in rest:
            target = rest.split("=>")[1].split()
            if not target:
                raise Bad("a replacement without a target")
            if target[0].startswith(("./", "../")):
                out.put("workspace_member", "replace", target[0])
    if block:
        raise Bad(f"a {block} block without its end")


def dockerfile(out: Out, text: str) -> None:
    """What COPY and ADD take from the context, and what ENTRYPOINT and CMD run; here-documents are skipped."""
    pending, ends, joined = "", [], []
    for line in text.splitlines():
        if ends:
            if line.strip() == ends[0]:
                ends.pop(0)
            continue
        if not pending and line.lstrip().startswith("#"):
            continue
        pending += line
        if pending.rstrip().endswith("\\"):
            pending = pending.rstrip()[:-1] + " "
            continue
        ends = re.findall(r"<<-?[\"']?(\w+)", pending) if re.match(r"\s*(RUN|COPY|ADD)\b", pending, re.I) else []
        joined.append(pending.strip())
        pending = ""
    if ends:
        raise Bad(f"a here-document without its end: {ends[0]}")
    for n, line in enumerate(x for x in joined if x):
        word, _, rest = line.partition(" ")
        word, rest = word.upper(), rest.strip()
        if word in ("COPY", "ADD") and "--from=" not in rest and "<<" not in rest:
            args = json.loads(rest) if rest.startswith("[") else [a for a in rest.split() if not a.startswith("--")]
            for a in args[:-1]:
                if "://" not in a and "$" not in a and a not in (".", "./"):
                    out.put("packaged_file", f"{word.lower()}[{n}]", a.lstrip("/"))
        elif word in ("ENTRYPOINT", "CMD"):
            out.put("command", f"{word.lower()}[{n}]", " ".join(json.loads(rest)) if rest.startswith("[") else rest, "command")


def workflow(out: Out, text: str) -> None:
    """Commands and local actions of a CI workflow; scalars stay text, so ``on`` is a key and not a truth value."""
    import yaml

    if re.search(r"(?m)^[^#'\"]*[:\-]\s+[&*!][A-Za-z]", text):
        raise Bad("anchors, aliases and tags are not read")

    def walk(key: str, node) -> None:
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                name = f"{key}.{k.value}" if key else str(k.value)
                if k.value == "run" and isinstance(v, yaml.ScalarNode):
                    out.put("command", name, v.value, "command")
                elif k.value == "uses" and isinstance(v, yaml.ScalarNode) and v.value.startswith("./"):
                    out.rows.append((out.path, "A", "ci_action", name, "path", posixpath.normpath(v.value), ""))
                else:
                    walk(name, v)
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                walk(f"{key}[{i}]", v)

    walk("", yaml.compose(text))


def scanner(path: str):
    name = posixpath.basename(path)
    if re.fullmatch(r"\.github/workflows/[^/]+\.ya?ml", path):
        return workflow
    if name == "Dockerfile" or name.startswith("Dockerfile.") or name == "Containerfile":
        return dockerfile
    return {"package.json": package_json, "pyproject.toml": pyproject, "Cargo.toml": cargo, "setup.cfg": setup_cfg, "go.mod": go_mod}.get(name) or (go_source if name.endswith(".go") else None)


def scan(path: str, text: str | None, status: str = "completed") -> list[tuple]:
    """All rows of one file."""
    out = Out(path)
    if posixpath.basename(path) in IMPLICIT_PYTHON:
        key, kind, tier = IMPLICIT_PYTHON[posixpath.basename(path)]
        out.rows.append((path, tier, kind, key, "path", path, ""))
    read = scanner(path)
    if read is None:
        return out.rows
    if status != "completed" or text is None:
        return [(path, "A", "error", "", "gap", "", status)]
    try:
        read(out, text)
    except ImportError as e:
        return [(path, "A", "error", "", "gap", "", f"no parser: {e.name}")]
    except Exception as e:  # noqa: BLE001  whatever a parser refuses is a gap in the root set
        return [(path, "A", "error", "", "gap", "", f"{type(e).__name__}: {e}"[:300])]
    return out.rows


def manifest_roots(files: DataFrame) -> DataFrame:
    """Rows of all manifests of ``files(path, text, read_status)``, with ``repo`` of many trees; only files that some scanner reads reach Python."""
    keys = ["repo"] if "repo" in files.columns else []
    wanted = files.where(
        r"path rlike '(^|/)(package\\.json|pyproject\\.toml|Cargo\\.toml|setup\\.cfg|Dockerfile[^/]*|Containerfile|[^/]*\\.go|__main__\\.py|conftest\\.py|manage\\.py|celery\\.py|asgi\\.py|wsgi\\.py|go\\.mod)$'"
        r" or path rlike '^\\.github/workflows/[^/]+\\.ya?ml$'"
    ).select(*keys, "path", "text", "read_status")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*of, *r) for *of, p, t, s in pdf.itertuples(index=False, name=None) for r in scan(p, t, s)]
            yield pd.DataFrame(rows, columns=[*keys, "path", "tier", "kind", "key", "target_kind", "target", "detail"])

    return wanted.mapInPandas(run, "repo string, " * len(keys) + SHAPE)
