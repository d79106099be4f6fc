"""Scalar expressions on the rows that tell right from nearly right."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F
from siftline.functions import globs, paths, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "message,want",
    [
        ("src/a.py:10:5 unused", "src/a.py unused"),
        ("at 12:30 sharp", "at 12:30 sharp"),
        ("see /abs/p now", "see <path> now"),
        ("see C:\\x\\y now", "see <path> now"),
        ("took 450ms.", "took <dur>."),
        ("took 45 ms", "took <dur>"),
        ("took 45, ms", "took 45, ms"),
        ("(line 12)", "(line <n>)"),
        ("on Column 5 of 7", "on Column <n> of 7"),
        ("a\u00a0b", "a b"),
        ("", ""),
        ("...", "..."),
        ("x 3 seconds, y", "x <dur>, y"),
    ],
)
def test_normalize(spark, message, want):
    assert one(spark, text.normalize_message(F.lit(message))) == want
    assert one(spark, text.normalize_message(F.lit(want))) == want


def reference(*fields):
    h = hashlib.sha256()
    for f in fields:
        if isinstance(f, tuple):
            h.update(b"\x00" if f[0] is None else b"\x01")
            f = f[0]
        if f is not None:
            h.update(struct.pack("<Q", len(f.encode())) + f.encode())
    return "finding/v1:" + h.hexdigest()


def test_fingerprint(spark):
    lit = lambda x: F.lit(x).cast("string")
    fp = lambda *a: one(spark, text.fingerprint(*map(lit, a)))
    assert fp("r", "u", "s", "b", "m é") == reference("finding/v1", "r", "u", ("s",), (None,), "m é")
    assert fp("r", "u", None, "b", "m") == reference("finding/v1", "r", "u", (None,), ("b",), "m")
    assert fp("r", "u", "", None, "m") != fp("r", "u", None, None, "m")
    assert fp("ab", "c", None, None, "m") != fp("a", "bc", None, None, "m")
    assert fp("r", "u", "s", "b1", "m") == fp("r", "u", "s", "b2", "m")
    assert fp("r", "u", "s", None, "a.py:1:2 x") == fp("r", "u", "s", None, "a.py:9:9  x")


@pytest.mark.parametrize("expires,want", [("2026/07/30", True), ("next quarter", True), ("", True), ("9999-99-99", False), ("2026-07-31", True), ("2026-07-31T12:00:00Z", True), ("2026-07-31T12:00:01Z", False)])
def test_expiry(spark, expires, want):
    assert one(spark, text.has_expired(F.lit(expires), F.lit("2026-07-31T12:00:00Z"))) is want


def test_symbols(spark):
    same = lambda a, b: one(spark, text.names_same_symbol(F.lit(a), F.lit(b)))
    assert same("a::b", "b") and same("b", "a.b") and same("x", "x") and not same("", "") and not same("ab", "b")
    assert one(spark, text.names_symbol(F.lit("b"), F.lit("a.b"))) is False
    assert sorted(one(spark, text.bare_suffixes(F.lit("a::b.c")))) == sorted(["a::b.c", "b.c", "c"])
    assert one(spark, text.trailing_identifier(F.lit("m:x::y"))) == "y" and one(spark, text.trailing_identifier(F.lit("m:x"))) == "m:x"
    assert one(spark, text.contains_word(F.lit("a foo_b foo"), F.lit("foo"))) and not one(spark, text.contains_word(F.lit("foo_b"), F.lit("foo")))
    assert one(spark, text.contains_component(F.lit("x-Celery/y"), F.lit("celery")))


@pytest.mark.parametrize("path,want", [("a/./b/../c", "a/c"), ("../a", None), ("/a", None), ("a/..", ""), ("a//b", "a/b"), ("a/../../b", None)])
def test_normalize_path(spark, path, want):
    assert one(spark, paths.normalize(F.lit(path))) == want


def test_paths(spark):
    assert one(spark, paths.ancestors(F.lit("a/b/c.py"))) == ["", "a", "a/b", "a/b/c.py"]
    assert one(spark, paths.suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert one(spark, paths.stem(F.lit("x/.env"))) == ".env" and one(spark, paths.stem(F.lit("x/a.tar.gz"))) == "a.tar"
    assert one(spark, paths.literal_prefix(F.lit("a/b/*.py"))) == "a/b" and one(spark, paths.literal_prefix(F.lit("*.py"))) == ""
    assert one(spark, paths.parent(F.lit("a"))) == "" and one(spark, paths.basename(F.lit("a/b"))) == "b"


@pytest.mark.parametrize(
    "pattern,path,want",
    [("*.py", "a/b.py", True), ("/a/*.py", "a/b.py", True), ("/a/*.py", "a/c/b.py", False), ("a/**", "a/c/b.py", True), ("**/b.py", "xb.py", True), ("a/", "a/b", False), ("[!a]b", "cb", True), ("[ab", "a", False), ("a?c", "a/c", False)],
)
def test_attribute_globs(spark, pattern, path, want):
    regex, whole = globs.attribute_regex(pattern)
    assert one(spark, F.lit(path if whole else path.split("/")[-1]).rlike(regex)) is want


@pytest.mark.parametrize(
    "spec,path,want",
    [("src", "a/src/b", True), ("src/", "src/b", True), ("/src", "a/src", False), ("a/**", "a", False), ("a/**", "a/b/c", True), ("a/**/c", "a/c", True), ("*.py", "d/x.py", True), ("[ab]", "b/x", True), ("[a", "[a", True), ("!x", "x", True), ("/", "a", True)],
)
def test_pathspecs(spark, spec, path, want):
    assert one(spark, F.lit(path).rlike(globs.pathspec(spec).regex)) is want
    assert globs.pathspec("!x").negated and globs.pathspec("a/b").literal == "a/b" and globs.pathspec("*.py").literal is None
