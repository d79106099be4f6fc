"""Registered plans of whole questions: claims through every layer, and the ratchet from logs to verdict, over trees and logs derived from a table's keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import ratchet
from siftline.plans import evidence
from siftline.plans.tables import NOW, plan, table
from siftline.sources import sarif
from siftline.sources.lineage import kept, spread

# Claim, its files (path, text), and the layer that saves it; a symbol is claimed with the place that declares it.
_CLAIMS = [
    ("path", "src/dead{k}.py", None, [("src/dead{k}.py", "x = 1\n")], None),
    ("path", "w{k}/robots.txt", None, [("w{k}/robots.txt", "User-agent: x\n")], "gate1"),
    ("symbol", "exported{k}", "src/ffi{k}.rs", [("src/ffi{k}.rs", '#[no_mangle]\npub extern "C" fn exported{k}() {}\n')], "gate3f"),
    ("path", "src/ran{k}.py", None, [("src/ran{k}.py", "y = 2\n")], "coverage"),
    ("path", "q{k}/sitecustomize.py", None, [("q{k}/sitecustomize.py", "z = 3\n")], "roots"),
    ("path", "src/named{k}.py", None, [("src/named{k}.py", "v = 4\n"), ("docs/n{k}.md", "see named{k}.py for it\n")], "veto"),
    ("symbol", "hidden{k}", "src/h{k}.rs", [("src/h{k}.rs", "fn hidden{k}() {}\n")], None),
]


@plan(
    "WITH t AS (SELECT p_partkey::VARCHAR AS k, p_partkey % 7 AS v FROM part), r AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{kind}', '{claim}', {'NULL' if layer is None else repr(layer)})" for i, (kind, claim, _, _, layer) in enumerate(_CLAIMS))
    + ") x(v, kind, claim, layer)) SELECT kind, replace(claim, '{k}', k) AS claim, layer FROM t JOIN r USING (v)"
)
def whole_stack(spark, sf_dir):
    """Claims about one tree through never-touch rules, gate 3f, coverage, roots and vetoes, each computed from the tree itself: the layer that saves each, null for survivors."""
    k, v = F.col("p_partkey").cast("string"), F.col("p_partkey") % len(_CLAIMS)
    fill = lambda s: F.lit(None).cast("string") if s is None else F.replace(F.lit(s), F.lit("{k}"), k)
    rows = claim = None
    for i, (kind, name, place, some, _) in enumerate(_CLAIMS):
        of = F.array(*[F.struct(fill(p).alias("path"), fill(t).alias("text")) for p, t in some])
        one = F.struct(F.lit("m").alias("mutant"), F.lit("s").alias("sut"), F.lit(kind).alias("kind"), fill(name).alias("claim"), fill(place).alias("declared_in"))
        rows, claim = (F.when(v == i, of), F.when(v == i, one)) if rows is None else (rows.when(v == i, of), claim.when(v == i, one))
    part = spread(table(spark, sf_dir, "part").select("p_partkey"))
    tree = kept(part.select(F.explode(rows).alias("f")).select("f.path", "f.text"))  # some forty branches read it
    none = F.lit(None).cast("string")
    files = tree.select("path", F.lit("blob").alias("kind"), F.col("text").alias("content"), "text", F.left(F.col("text"), F.lit(64)).alias("head"), none.alias("link_target"), F.lit("completed").alias("read_status"))
    claims = kept(part.select(claim.alias("c")).select("c.*"))
    ran = part.where(v == 3).select(F.concat(F.lit("/build/src/ran"), k, F.lit(".py")).alias("source"))
    called = ran.select("source", F.lit("main").alias("name"), F.lit(None).cast("long").alias("start_line"), F.lit(1).cast("decimal(20,0)").alias("calls"))
    lines = ran.select("source", F.lit(1).cast("long").alias("lines_found"), F.lit(1).cast("long").alias("lines_hit"))
    left, dropped = evidence.survivors(claims, files, None, (called, lines, spark.range(1).select(F.lit(True).alias("passed"))))
    return left.select("kind", "claim", none.alias("layer")).unionByName(dropped.select("kind", "claim", "layer"))


@plan(
    """WITH p AS (SELECT p_partkey AS k, 'src/a' || p_partkey || '.py' AS uri FROM part)
SELECT 'new' AS kind, uri, NULL AS reason FROM p WHERE k % 2 = 1
UNION ALL SELECT 'rot', uri, CASE WHEN k % 10 = 0 THEN 'referent_gone' ELSE 'expired' END FROM p WHERE k % 2 = 0 AND (k % 10 = 0 OR k % 12 = 0)
UNION ALL SELECT 'rot', 'src/gone' || k || '.py', 'never_matched' FROM p WHERE k % 2 = 0 AND k % 14 = 0
UNION ALL SELECT 'verdict', NULL, 'rot' """
)
def tightened(spark, sf_dir):
    """The ratchet over a log a part: new findings, entries that rotted for each of the three reasons, and the verdict."""
    k = F.col("p_partkey").cast("string")
    part = spread(table(spark, sf_dir, "part").select("p_partkey"))
    head = '{"runs":[{"tool":{"driver":{"name":"t"}},"invocations":[{"executionSuccessful":true}],"results":[{"ruleId":"R","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/a'
    logs = part.select(F.concat(F.lit("log"), k).alias("log"), F.concat(F.lit(head), k, F.lit('.py"}}}]}]}]}')).alias("text"), "p_partkey")
    known = ratchet.with_fingerprint(sarif.findings(sarif.runs(logs.where("p_partkey % 2 = 0").select("log", "text"))))
    n = F.regexp_extract("uri", "([0-9]+)", 1).cast("long")
    none = F.lit(None).cast("string")
    shown = known.select(F.xxhash64("uri").alias("seq"), "fingerprint", "rule_id", "uri", none.alias("symbol"), F.lit(NOW).alias("first_seen"), F.when(n % 12 == 0, "1996-01-01").alias("expires"), none.alias("justification"))
    stale = shown.where(n % 14 == 0).withColumn("fingerprint", F.concat(F.lit("old:"), "fingerprint")).withColumn("uri", F.replace("uri", F.lit("src/a"), F.lit("src/gone"))).withColumn("expires", none)
    files = part.where("p_partkey % 10 <> 0").select(F.concat(F.lit("src/a"), k, F.lit(".py")).alias("path")).unionByName(part.select(F.concat(F.lit("src/gone"), k, F.lit(".py")).alias("path")))
    said = evidence.tighten(logs.select("log", "text"), shown.unionByName(stale), files, NOW)
    new = said["new"].select(F.lit("new").alias("kind"), "uri", none.alias("reason"))
    rot = said["rot"].select(F.lit("rot").alias("kind"), "uri", "reason")
    return new.unionByName(rot).unionByName(said["verdict"].select(F.lit("verdict").alias("kind"), none.alias("uri"), F.col("verdict").alias("reason")))
