"""Grading claims against constructed truth, and the algebra of rescue layers.

Claims are ``mutant, sut, kind (path, symbol), claim, declared_in``; truth is ``mutant, live_paths, live_symbols, decoy_dead_paths,
decoy_dead_symbols``, the last two aligned by index with ``''`` for no symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.paths import basename, extension, normalize, stem
from siftline.functions.text import any_of, bare_suffixes
from siftline.operators import veto
from siftline.sources.lineage import kept, large

_PAIR = "array<struct<path:string,symbol:string>>"


def dedup_by_name(claims: DataFrame) -> DataFrame:
    """One claim a (mutant, sut, kind, name); the place of declaration stays only if all agree on it, and no place is no agreement."""
    g = claims.groupBy("mutant", "sut", "kind", "claim").agg(
        F.min("declared_in").alias("lo"), F.max("declared_in").alias("hi"), F.count("declared_in").alias("placed"), F.count(F.lit(1)).alias("n")
    )
    return g.select("mutant", "sut", "kind", "claim", F.when((F.col("lo") == F.col("hi")) & (F.col("placed") == F.col("n")), F.col("lo")).alias("declared_in"))


def spelled(claims: DataFrame) -> DataFrame:
    """``mutant, sut, kind, name``: paths normalised; symbols under every bare name they answer to, so that matching is an equi-join."""
    path = claims.where("kind = 'path'").select("mutant", "sut", "kind", F.coalesce(normalize(F.col("claim")), F.col("claim")).alias("name"))
    symbol = claims.where("kind = 'symbol'").select("mutant", "sut", "kind", F.explode(bare_suffixes(F.col("claim"))).alias("name"))
    return path.unionByName(symbol).distinct()


def false_removals(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """``mutant, sut, name``: live paths and symbols that were claimed dead."""
    live = truth.select("mutant", F.lit("path").alias("kind"), F.explode("live_paths").alias("name")).unionByName(
        truth.select("mutant", F.lit("symbol").alias("kind"), F.explode("live_symbols").alias("name"))
    )
    return spelled(claims).join(live, ["mutant", "kind", "name"]).select("mutant", "sut", "name").distinct()


def decoys_found(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """``mutant, sut, idx``: decoys claimed by their path or by their symbol, each once."""
    pairs = F.transform("decoy_dead_paths", lambda p, i: F.struct(p.alias("path"), F.get("decoy_dead_symbols", i).alias("symbol")))
    decoys = truth.select("mutant", F.posexplode(pairs).alias("idx", "d")).select("mutant", "idx", "d.path", "d.symbol")
    by_path = decoys.select("mutant", "idx", F.lit("path").alias("kind"), F.col("path").alias("name"))
    by_symbol = decoys.where("symbol <> ''").select("mutant", "idx", F.lit("symbol").alias("kind"), F.col("symbol").alias("name"))
    return spelled(claims).join(by_path.unionByName(by_symbol), ["mutant", "kind", "name"]).select("mutant", "sut", "idx").distinct()


def grade(claims: DataFrame, truth: DataFrame, suts: DataFrame) -> DataFrame:
    """``mutant, sut, grade, false_removals, n_false, decoys_found, decoys_total``: a row for each class and SUT.

    ``suts(sut, reads)``: the classes a SUT can read (null: all); others are not_read and outside of every ratio. Passed means no false removal and every decoy.
    """
    fr = false_removals(claims, truth).groupBy("mutant", "sut").agg(F.array_sort(F.collect_set("name")).alias("false_removals"))
    df = decoys_found(claims, truth).groupBy("mutant", "sut").agg(F.count(F.lit(1)).alias("found"))
    # A catalogue of classes times the SUTs that are graded: both are lists someone wrote.
    every = truth.select("mutant", F.size("decoy_dead_paths").alias("decoys_total")).crossJoin(F.broadcast(suts))
    j = every.join(fr, ["mutant", "sut"], "left").join(df, ["mutant", "sut"], "left")
    read = F.col("reads").isNull() | F.array_contains("reads", F.col("mutant"))
    n = F.coalesce(F.size("false_removals"), F.lit(0))
    n = F.when(F.col("false_removals").isNull(), 0).otherwise(n)
    found = F.coalesce("found", F.lit(0))
    said = F.when(~read, "not_read").when((n == 0) & (found == F.col("decoys_total")), "passed").otherwise("failed")
    none = F.array().cast("array<string>")
    return j.select(
        "mutant", "sut", said.alias("grade"), F.when(read, F.coalesce("false_removals", none)).otherwise(none).alias("false_removals"),
        F.when(read, n).otherwise(0).alias("n_false"), F.when(read, found).otherwise(0).alias("decoys_found"), F.when(read, F.col("decoys_total")).otherwise(0).alias("decoys_total"),
    )


def suite_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("sut").agg(
        F.count_if(F.col("grade") != "not_read").alias("graded"),
        F.count_if(F.col("grade") == "passed").alias("passed"),
        F.sum("n_false").alias("false_removals"),
        F.sum("decoys_found").alias("decoys_found"),
        F.sum("decoys_total").alias("decoys_total"),
    )


def exit_code(counts: DataFrame) -> DataFrame:
    """``sut, exit_code``: nothing graded refuses (2), a false removal fails (1); missed decoys are recall and do not."""
    return counts.select("sut", F.when(F.col("graded") == 0, 2).when(F.col("false_removals") == 0, 0).otherwise(1).alias("exit_code"))


# What the naive cleaner reads as code, takes for entry points, and takes for declarations, in this order.
PARSED = ("py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "go")
ENTRY_STEMS = ("main", "index", "lib", "mod", "__init__", "__main__")
KEYWORDS = ("def ", "class ", "fn ", "func ", "function ", "struct ", "trait ", "interface ", "enum ")


def declarations(parsed: DataFrame) -> DataFrame:
    """``mutant, symbol, declared_in`` of sources (mutant, path, text): on each line, the identifier behind the first keyword that stands there as a word; the first path that declares a name."""
    lines = parsed.where("text is not null").select("mutant", "path", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(any_of([F.contains("line", F.lit(k)) for k in KEYWORDS]))  # cheaper than an expression
    rest = F.coalesce(*[F.when(F.contains("line", F.lit(k)) & F.rlike("line", F.lit(rf"(?<![\p{{L}}\p{{N}}_]){k}")), F.regexp_extract("line", rf"(?s)^.*?(?<![\p{{L}}\p{{N}}_]){k}(.*)$", 1)) for k in KEYWORDS])
    named = lines.select("mutant", "path", F.regexp_extract(rest, r"^([\p{L}_][\p{L}\p{N}_]*)", 1).alias("symbol")).where("symbol <> ''")
    return named.groupBy("mutant", "symbol").agg(F.min("path").alias("declared_in"))


def naive_claims(parsed: DataFrame, symbols: DataFrame, candidates: DataFrame | None = None, exact_limit: int = veto.MANY) -> DataFrame:
    """The cleaner that must fail: a file is dead when no *other* parsed file names it or its stem, a symbol when it occurs at most once.

    ``parsed(mutant, path, text)`` are the sources, ``candidates(mutant, path)`` the files that may be claimed (by default the sources; entry points are left
    out by the caller), ``symbols(mutant, symbol, declared_in)``. All names are looked for in one pass. What is kept of a name is how many files hold it, which the first and the last of
    them are, and how often it occurs in all, so files do not meet files.
    """
    a = (parsed if candidates is None else candidates).select("mutant", F.col("path").alias("claim"), basename(F.col("path")).alias("base"), stem(F.col("path")).alias("stem"))
    names = a.select("mutant", F.explode(F.array("base", "stem")).alias("needle")).unionByName(symbols.select("mutant", F.col("symbol").alias("needle")))
    held = kept(veto.totals(names, parsed, exact_limit))
    asked = a.select("mutant", "claim", F.explode(F.array_distinct(F.array("base", "stem"))).alias("needle"))
    named = large(asked).join(held, ["mutant", "needle"]).where((F.col("lo") != F.col("claim")) | (F.col("hi") != F.col("claim"))).select("mutant", "claim").distinct()
    dead = large(a.select("mutant", "claim").distinct()).join(named, ["mutant", "claim"], "left_anti").select("mutant", F.lit("naive").alias("sut"), F.lit("path").alias("kind"), "claim", F.lit(None).cast("string").alias("declared_in"))
    counts = large(symbols).join(held.select("mutant", F.col("needle").alias("symbol"), "n"), ["mutant", "symbol"], "left").where(F.coalesce("n", F.lit(0)) <= 1)
    return dead.unionByName(counts.select("mutant", F.lit("naive").alias("sut"), F.lit("symbol").alias("kind"), F.col("symbol").alias("claim"), "declared_in"))


def naive(files: DataFrame) -> DataFrame:
    """``naive_claims`` from files (mutant, path, text) alone: what it reads as code, what it may claim (all but entry points), and which symbols that code declares."""
    parsed = files.where(extension(F.col("path")).isin(*PARSED))
    # Both are asked for several times; what they are worked out of is read once.
    return naive_claims(parsed, kept(declarations(parsed)), kept(files.where(~stem(F.col("path")).isin(*ENTRY_STEMS)).select("mutant", "path")))


def refusing_claims(claims: DataFrame) -> DataFrame:
    """The cleaner that claims nothing: it must pass the gate and fail recall."""
    return claims.limit(0)


def apply_layers(claims: DataFrame, layers: list[tuple[str, DataFrame]], key: tuple[str, ...] = ("mutant", "sut", "kind", "claim")) -> tuple[DataFrame, DataFrame]:
    """Survivors, and what was dropped: ``key..., layer, layer_idx, rule``. A layer is a name and rows ``key..., rule`` it rescues.

    The first layer that rescues a claim is credited; the stack is one pass over the claims and not a chain of their copies. A layer can only
    remove: its rows matter where they match a claim.
    """
    rescued = None
    for i, (name, rows) in enumerate(layers):
        one = rows.groupBy(*key).agg(F.min("rule").alias("rule")).select(*key, F.lit(i).alias("layer_idx"), F.lit(name).alias("layer"), "rule")
        rescued = one if rescued is None else rescued.unionByName(one)
    if rescued is None:
        return claims, claims.limit(0).select(*key, F.lit("").alias("layer"), F.lit(0).alias("layer_idx"), F.lit("").alias("rule"))
    first = rescued.groupBy(*key).agg(F.min(F.struct("layer_idx", "layer", "rule")).alias("r")).select(*key, "r.*")
    survived = large(claims).join(first.select(*key), list(key), "left_anti")
    return survived, large(claims).join(first, list(key)).select(*key, "layer", "layer_idx", "rule")


def layer_runs(claims: DataFrame, dropped: DataFrame, layers: list[str], by: str = "mutant") -> DataFrame:
    """``by, layer_idx, layer, claimed, dropped, survived``: each layer is handed what the one before let through."""
    n = claims.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    d = dropped.groupBy(by).agg(*[F.count_if(F.col("layer_idx") == i).alias(f"d{i}") for i in range(len(layers))])
    j = n.join(d, by, "left").select(by, "total", *[F.coalesce(f"d{i}", F.lit(0)).alias(f"d{i}") for i in range(len(layers))])
    rows, handed = [], F.col("total")
    for i, name in enumerate(layers):
        rows.append(F.struct(F.lit(i).alias("layer_idx"), F.lit(name).alias("layer"), handed.alias("claimed"), F.col(f"d{i}").alias("dropped"), (handed - F.col(f"d{i}")).alias("survived")))
        handed = handed - F.col(f"d{i}")
    return j.select(by, F.explode(F.array(*rows)).alias("r")).select(by, "r.*")


def violations(bare: DataFrame, gated: DataFrame, runs: DataFrame) -> DataFrame:
    """``mutant, violation``: proof that a layer did not behave as a filter; a report with any row here is refused.

    ``runs`` as from ``layer_runs``: what was handed on must add up, within a layer and from one to the next.
    """
    j = bare.alias("b").join(gated.alias("g"), "mutant", "full_outer")
    added = F.array_except(F.coalesce("g.false_removals", F.array().cast("array<string>")), F.coalesce("b.false_removals", F.array().cast("array<string>")))
    rows = j.select(
        "mutant",
        F.explode(F.filter(F.array(
            F.when(F.col("b.grade").isNull() | F.col("g.grade").isNull(), "the runs cover different classes"),
            F.when(F.size(added) > 0, "live artifacts removed only with layers"),
            F.when(F.col("g.decoys_found") > F.col("b.decoys_found"), "decoys found only with layers"),
        ), lambda x: x.isNotNull())).alias("violation"),
    )
    nxt = runs.select("mutant", (F.col("layer_idx") - 1).alias("layer_idx"), F.col("claimed").alias("handed"))
    chain = runs.join(nxt, ["mutant", "layer_idx"], "left")
    broken = chain.select(
        "mutant",
        F.explode(F.filter(F.array(
            F.when(F.col("survived") + F.col("dropped") != F.col("claimed"), "claims unaccounted for"),
            F.when(F.col("handed") != F.col("survived"), "layers disagree on what was handed on"),
        ), lambda x: x.isNotNull())).alias("violation"),
    )
    return rows.unionByName(broken)


def attribute(prevented: DataFrame, dropped: DataFrame) -> DataFrame:
    """``mutant, name, layer``: the innermost layer that dropped a claim for the name; null (unattributed) is published, too."""
    names = dropped.select("mutant", "layer_idx", "layer", F.explode(bare_suffixes(F.col("claim"))).alias("name"))
    first = names.groupBy("mutant", "name").agg(F.min(F.struct("layer_idx", "layer")).alias("r"))
    return prevented.join(first, ["mutant", "name"], "left").select("mutant", "name", F.col("r.layer").alias("layer"))
