"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters, or a shorter one (8 or more) that a naming word and an assignment announce. The forest sees its length, its character transitions, how much of it
dictionary words cover, the path it was found under and the words beside it. It is trained on the driver from a bounded
set of labelled findings (``labelled_findings``: real-looking keys against hashes in prose, identifiers, placeholders, paths), whose
features come from the same expressions, and is then compiled into a SQL expression. The scan itself
is DataFrame operations only: a map over whole texts, without a shuffle.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be a secret: 20 or more characters of keys, tokens and encoded bytes, or 8 or more after a naming word and ``=`` or ``:``.
NAMED = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\"'`]?\s{0,2}[:=]\s{0,2}[\"'`]?"
CANDIDATE = r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{20,}+={0,2}|(?<=[:=\"'`\s])(?<=[:=]\s{0,2}[\"'`]?)(?=[^\s\"'`]{8})(?<=" + NAMED + r")[A-Za-z0-9_+/\-!@#$%^&*.~=]{8,}"
CONTEXT = 48
FEATURES = (
    "length", "transitions", "transition_rate", "distinct_rate", "digit_rate", "upper_rate", "symbol_rate", "is_hex", "dictionary", "path_test", "near_key", "near_benign", "quoted", "assigned",
)
# Words whose presence tells a name or a placeholder from a key, or a key's surroundings.
WORDS = (
    "about", "access", "admin", "application", "archive", "author", "branch", "build", "change", "checksum", "class", "client", "commit", "common", "config", "content", "controller", "data",
    "default", "document", "download", "dummy", "example", "factory", "fake", "file", "function", "handler", "header", "hello", "image", "index", "insert", "install", "internal", "library", "license",
    "manager", "message", "method", "model", "module", "number", "object", "option", "package", "page", "password", "path", "placeholder", "please", "private", "process", "product", "project", "public",
    "query", "report", "request", "resource", "response", "sample", "schema", "secret", "server", "service", "session", "static", "string", "system", "table", "template", "test", "token", "update",
    "user", "value", "version", "world", "xxxx", "your",
)
KEY_WORDS = r"(?i)(token|secret|passw|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private[_ -]?key)"
BENIGN_WORDS = r"(?i)(sha-?\d*|md5|checksum|digest|commit|revision|uuid|etag|hash|example|sample|placeholder|dummy|integrity)"
TEST_PATHS = r"(?i)(test|spec|fixture|example|sample|mock|docs?/)"


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """One double column for each of ``FEATURES``, in their order."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "_")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    lost = lambda pattern: (n - F.length(F.regexp_replace(candidate, pattern, ""))) / n
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return [
        n,
        runs - 1,
        (runs - 1) / n,
        F.size(F.array_distinct(F.split(candidate, ""))).cast("double") / n,
        lost("[0-9]"),
        lost("[A-Z]"),
        lost("[^A-Za-z0-9]"),
        flag(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        lost("(?i)" + "|".join(sorted(WORDS, key=len, reverse=True))),
        flag(path.rlike(TEST_PATHS)),
        flag(before.rlike(KEY_WORDS)),
        flag(before.rlike(BENIGN_WORDS) | after.rlike(BENIGN_WORDS)),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(before.rlike(r"[=:]\s*[\"'`]?$")),
    ]


def labelled_findings(n: int = 2000, seed: int = 2) -> list[tuple[str, str, str, str, int]]:
    """``n`` findings (candidate, before, after, path, is a secret), made by rule; the bound of the training set."""
    rng = random.Random(seed)
    low, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    prose = lambda: " ".join(text(low, rng.randint(2, 8)) for _ in range(rng.randint(2, 6)))
    up = lambda s: s.upper() if rng.random() < 0.2 else s
    paths = ("src0", "src7", "app/config.py", "deploy/prod.env", "lib/client.js", "tests/fixtures/a.json", "docs/example.md", "src/mock_data.py", "web")
    rows = []
    for i in range(n):
        path, (a, b) = rng.choice(paths), (prose() + " ", " " + prose())
        if i % 2:
            secret = rng.choice(
                [text("0123456789abcdef", rng.choice([32, 40, 64])), "AKIA" + text("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + text(alnum, 36), "sk_live_" + text(alnum, 24), text(alnum + "+/", 40), "xoxb-" + text("0123456789", 12) + "-" + text(alnum, 24)]
            )
            name = rng.choice(["token", "api_key", "secret", "password", "auth_token", "access_key", "SECRET_KEY", "private key"])
            quote = rng.choice(['"', '"', "'", ""])
            if i % 8 == 7:  # short ones stand behind a name and an assignment
                short = "".join(rng.choice(x) for x in rng.choices([alnum, "0123456789", "!@#$%^&*.-_"], [6, 2, 1], k=rng.randint(8, 19)))
                secret, name = short[:-2] + rng.choice("0123456789") + rng.choice(alnum), rng.choice(["password", "passwd", "pwd", "db_password", "secret", "api_key", "token"])
                rows.append((secret, a + up(name) + rng.choice([" = ", "=", ": "]) + quote, quote + b, path, 1))
                continue
            rows.append((up(secret), a + up(name) + rng.choice([" = ", "=", ": ", " "]) + quote, quote + b, path, 1))
            continue
        kind = rng.randrange(10)
        word = lambda: rng.choice(WORDS)
        if kind == 0:
            rows.append((text("0123456789abcdef", rng.choice([32, 40, 64])), a + rng.choice(["sha256 ", "commit ", "md5: ", "checksum=", "revision "]), b, path, 0))
        elif kind == 1:
            rows.append(("_".join(word() for _ in range(4)) + "_id", a, b, path, 0))
        elif kind == 2:
            rows.append((rng.choice(["your", "example", "dummy", "sample"]) + rng.choice("-_") + "_".join([word(), "token", "placeholder", "value"]), a + 'token = "', '"' + b, path, 0))
        elif kind == 3:
            rows.append(("x" * rng.randint(20, 40), a + "api_key: ", b, path, 0))
        elif kind == 4:
            rows.append(("/".join(word() for _ in range(5)), a, b, path, 0))
        elif kind == 5:
            rows.append((up(text(low, rng.randint(20, 40))), a, b, path, 0))
        elif kind == 6:
            rows.append(("-".join(text("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), a + rng.choice(["uuid ", "id: ", "", "etag "]), b, path, 0))
        elif kind == 7:  # words in a secret's place
            rows.append((rng.choice([text(low, rng.randint(8, 19)), word() + word() + "ed", word() + "_" + word(), word() + "." + word() + ".", "changeme", "undefined", "required", "<your-password>"]), a + rng.choice(["password", "token", "secret", "api_key"]) + rng.choice([" = ", ": "]) + rng.choice(['"', "", ""]), b, path, 0))
        elif kind == 8:  # repeats of one or two characters
            rows.append(((rng.choice("*xX0.") * 2 + rng.choice("*x"))[: rng.randint(1, 3)] * rng.randint(8, 12), a + rng.choice(["password", "token"]) + " = " + rng.choice(['"', ""]), b, path, 0))
        else:
            rows.append((rng.choice("-_") * rng.randint(20, 60), a, b, path, 0))
    return rows


def _gini(ones: int, n: int) -> float:
    p = ones / n
    return 2 * p * (1 - p) * n


def grow(x: list[list[float]], y: list[int], rng: random.Random, depth: int, tries: int) -> tuple:
    """A tree: a share of ones, or (feature, threshold, at most, above)."""
    n, ones = len(y), sum(y)
    if not depth or n < 8 or ones in (0, n):
        return (ones + 1) / (n + 2)
    best = (_gini(ones, n) - 1e-9, None, 0.0)
    for f in rng.sample(range(len(x[0])), tries):
        order = sorted(range(n), key=lambda i: x[i][f])
        seen = 0
        for k in range(1, n):
            seen += y[order[k - 1]]
            a, b = x[order[k - 1]][f], x[order[k]][f]
            if a != b:
                cost = _gini(seen, k) + _gini(ones - seen, n - k)
                if cost < best[0]:
                    best = (cost, f, (a + b) / 2)
    _, f, at = best
    if f is None:
        return (ones + 1) / (n + 2)
    low = [i for i in range(n) if x[i][f] <= at]
    high = [i for i in range(n) if x[i][f] > at]
    part = lambda keep: grow([x[i] for i in keep], [y[i] for i in keep], rng, depth - 1, tries)
    return (f, at, part(low), part(high))


def train(spark: SparkSession, rows: list[tuple[str, str, str, str, int]] | None = None, trees: int = 15, depth: int = 6, seed: int = 2) -> list[tuple]:
    """A random forest from labelled findings, whose features the scan's own expressions compute."""
    rows = labelled_findings() if rows is None else rows
    lit = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {lit(c)}, {lit(a)}, {lit(b)}, {lit(p)})" for i, (c, a, b, p, _) in enumerate(rows))
    given = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, c, a, b, p)")
    x = [r[1:] for r in sorted(given.select("i", *features(F.col("c"), F.col("a"), F.col("b"), F.col("p"))).collect())]
    y = [r[4] for r in rows]
    rng = random.Random(seed)
    forest = []
    for _ in range(trees):
        pick = [rng.randrange(len(x)) for _ in x]
        forest.append(grow([x[i] for i in pick], [y[i] for i in pick], rng, depth, 5))
    return forest


def probability(forest: list[tuple], columns: list[Column]) -> Column:
    """The forest as one expression: the mean of its trees."""

    def tree(t: tuple | float) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        return F.when(columns[t[0]] <= F.lit(float(t[1])), tree(t[2])).otherwise(tree(t[3]))

    return F.round(reduce(lambda a, b: a + b, [tree(t) for t in forest]) / F.lit(float(len(forest))), 6)


def _located(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and the gaps before, between and after them."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def scan(docs: DataFrame, forest: list[tuple], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """``id, nth, start, length, candidate_sha256, probability, is_secret``: a row for each candidate of each row.

    ``start`` counts characters from 0. The candidate itself does not leave the scan. Null and empty texts have no candidates;
    a null path counts as empty; repeated rows repeat their findings. An empty table gives an empty result.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.col("text")
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).where(text.rlike(CANDIDATE))
    found, gaps = _located(text)
    # Starts: the running length of gaps and candidates, summed once from left to right.
    starts = F.aggregate(
        F.arrays_zip(F.col("found").alias("f"), F.slice("gaps", F.lit(1), F.size("found")).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, z: F.struct((acc["at"] + F.length(z["g"]) + F.length(z["f"])).alias("at"), F.concat(acc["all"], F.array(acc["at"] + F.length(z["g"]))).alias("all")),
        lambda acc: acc["all"],
    )
    each = (
        held.withColumns({"found": found, "gaps": gaps})
        .withColumn("starts", starts)
        .select("id", "path", F.posexplode(F.arrays_zip(
            F.col("found").alias("c"),
            F.col("starts").alias("start"),
            F.transform(F.slice("gaps", F.lit(1), F.size("found")), lambda g: F.right(g, F.lit(CONTEXT))).alias("before"),
            F.transform(F.slice("gaps", F.lit(2), F.size("found")), lambda g: F.left(g, F.lit(CONTEXT))).alias("after"),
        )).alias("nth", "z"))
    )
    given = [f.alias(n) for f, n in zip(features(F.col("z.c"), F.col("z.before"), F.col("z.after"), F.col("path")), FEATURES)]
    scored = each.select("id", "nth", F.col("z.start").alias("start"), F.length("z.c").alias("length"), F.sha2(F.col("z.c").cast("binary"), 256).alias("candidate_sha256"), *[g.alias(f"f_{n}") for g, n in zip(given, FEATURES)])
    p = probability(forest, [F.col(f"f_{n}") for n in FEATURES])
    return scored.withColumn("probability", p).select("id", "nth", "start", "length", "candidate_sha256", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: list[tuple], text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, mark: str = "[SECRET]", n_secrets: str = "n_secrets") -> DataFrame:
    """``docs`` with secrets replaced by ``mark`` and a column ``n_secrets``, which takes the place of one of that name; a map, no rows are lost or moved.

    Texts without candidates, empty and null ones stay as they are, repeated rows are treated alike, and an empty table stays empty.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    def flagged(c: Column, before: Column, after: Column) -> Column:
        return probability(forest, features(c, F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT)), path)) >= threshold

    # Each step is a column of its own, so that a text is searched once if it has no candidate.
    work = docs.withColumn("__sl_has", F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False)))
    has = F.col("__sl_has")
    found, gaps = _located(F.col(text_col))
    work = work.withColumn("__sl_found", F.when(has, found)).withColumn("__sl_gaps", F.when(has, gaps))
    # Of each candidate: the gap before it and what stands in its place.
    gap = lambda first: F.slice("__sl_gaps", F.lit(first), F.size("__sl_found"))
    parts = F.transform(
        F.arrays_zip(F.col("__sl_found").alias("c"), gap(1).alias("a"), gap(2).alias("b")),
        lambda z: F.struct(flagged(z["c"], z["a"], z["b"]).alias("hit"), z["a"].alias("a"), z["c"].alias("c")),
    )
    work = work.withColumn("__sl_parts", F.when(has, parts)).withColumn("__sl_last", F.when(has, F.element_at("__sl_gaps", -1)))
    hits = F.coalesce(F.size(F.filter("__sl_parts", lambda z: z["hit"])), F.lit(0))
    said = F.concat(F.array_join(F.transform("__sl_parts", lambda z: F.concat(z["a"], F.when(z["hit"], F.lit(mark)).otherwise(z["c"]))), ""), F.col("__sl_last"))
    count = F.when(has, hits).otherwise(0)
    new = F.when(count > 0, said).otherwise(F.col(text_col))
    shown = {text_col: new.alias(text_col), n_secrets: count.alias(n_secrets)}
    return work.select(*[shown.get(c, F.col(f"`{c}`")) for c in dict.fromkeys([*docs.columns, n_secrets])])
