"""Registered plans: every operator family over the star-schema and corpus tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths, text
from siftline.functions.globs import pathspec
from siftline.operators import coverage, gates, ledger, persistence, ratchet, roots, rules, suite, veto

NOW = "1997-01-01T00:00:00Z"
PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def plan(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.lit("blob").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), F.lit("completed").alias("read_status"))


CORPUS_SQL = "corpus AS (SELECT source || '/' || doc_id || '.' || lang AS path, coalesce(text, '') AS content, * FROM documents)"


# Identity and text ---------------------------------------------------------------------------------------------------


@plan(
    """
WITH d AS (SELECT doc_id, [
    'finding/v1', coalesce(lang, ''), coalesce(source, '') || '/' || doc_id] AS fields, CASE WHEN doc_id % 2 = 0 THEN source END AS symbol, CASE WHEN doc_id % 3 <> 0 THEN lang END AS blob, 'found in ' || coalesce(source, '') AS message FROM documents),
b AS (SELECT doc_id, list_transform(fields || [message], lambda x: unhex(format('{:02x}{:02x}000000000000', strlen(x) % 256, strlen(x) // 256)) || encode(x)) AS f,
  CASE WHEN symbol IS NULL THEN unhex('00') ELSE unhex('01') || unhex(format('{:02x}{:02x}000000000000', strlen(symbol) % 256, strlen(symbol) // 256)) || encode(symbol) END AS s,
  CASE WHEN symbol IS NOT NULL OR blob IS NULL THEN unhex('00') ELSE unhex('01') || unhex(format('{:02x}{:02x}000000000000', strlen(blob) % 256, strlen(blob) // 256)) || encode(blob) END AS l FROM d)
SELECT doc_id, 'finding/v1:' || sha256(f[1] || f[2] || f[3] || s || l || f[4]) AS fingerprint FROM b
"""
)
def fingerprint_v1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    symbol, blob = F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    fp = text.fingerprint(lang, F.concat(source, F.lit("/"), F.col("doc_id").cast("string")), symbol, blob, F.concat(F.lit("found in "), source))
    return d.select("doc_id", fp.alias("fingerprint"))


_E = r"[\,\;\.\:\!\?\(\)\[\]\{\}''\"`]"


@plan(
    rf"""
WITH m AS (SELECT conv_id, turn, 'at src/a.py:' || turn || ':5, took ' || turn || '.5 ms; line ' || conv_id || ' in /abs/' || role || ' after 45ms: ' || coalesce(text, '') AS msg FROM conversations),
t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(msg, '[\s\p{{Z}}\x{{85}}]+')) AS tok, generate_subscripts(regexp_split_to_array(msg, '[\s\p{{Z}}\x{{85}}]+'), 1) AS i FROM m),
r AS (SELECT *, regexp_replace(tok, '^{_E}+', '') AS rest FROM t WHERE tok <> ''),
c AS (SELECT *, regexp_replace(rest, '{_E}+$', '') AS core0 FROM r),
s1 AS (SELECT *, CASE WHEN regexp_matches(core0, ':[0-9]+$') AND regexp_extract(core0, '(?s)^(.*):[0-9]+$', 1) NOT IN ('') AND NOT regexp_full_match(regexp_extract(core0, '(?s)^(.*):[0-9]+$', 1), '[0-9]+') THEN regexp_extract(core0, '(?s)^(.*):[0-9]+$', 1) ELSE core0 END AS c1 FROM c),
s2 AS (SELECT *, CASE WHEN regexp_matches(c1, ':[0-9]+$') AND regexp_extract(c1, '(?s)^(.*):[0-9]+$', 1) NOT IN ('') AND NOT regexp_full_match(regexp_extract(c1, '(?s)^(.*):[0-9]+$', 1), '[0-9]+') THEN regexp_extract(c1, '(?s)^(.*):[0-9]+$', 1) ELSE c1 END AS c2 FROM s1),
k AS (SELECT *, left(tok, length(tok) - length(rest)) AS lead, substr(rest, length(core0) + 1) AS trail, CASE WHEN regexp_matches(c2, '(?s)^/.') THEN '<path>' WHEN regexp_full_match(c2, '[0-9][0-9.nuµmsh]*[smh]') THEN '<dur>' ELSE c2 END AS core1 FROM s2),
n AS (SELECT *, CASE WHEN regexp_full_match(core1, '[0-9]+') AND lower(lag(core1) OVER w) IN ('line', 'lines', 'col', 'cols', 'column', 'columns') THEN '<n>' ELSE core1 END AS core FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
f AS (SELECT *, lead = '' AND lower(core) IN ('ns', 'us', 'µs', 'ms', 's', 'sec', 'secs', 'second', 'seconds', 'minute', 'minutes', 'hour', 'hours') AND coalesce(lag(trail) OVER w = '' AND regexp_full_match(lag(core) OVER w, '[0-9]([0-9.]*[0-9])?'), false) AS fold FROM n WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
g AS (SELECT *, coalesce(lead(fold) OVER w, false) AS next_fold, lead(trail) OVER w AS next_trail FROM f WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))
SELECT conv_id, turn, string_agg(CASE WHEN next_fold THEN lead || '<dur>' || next_trail ELSE lead || core || trail END, ' ' ORDER BY i) AS normalized FROM g WHERE NOT fold GROUP BY conv_id, turn
"""
)
def normalize_message(spark, sf_dir):
    m = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    msg = F.concat(F.lit("at src/a.py:"), turn, F.lit(":5, took "), turn, F.lit(".5 ms; line "), F.col("conv_id").cast("string"), F.lit(" in /abs/"), F.col("role"), F.lit(" after 45ms: "), F.coalesce("text", F.lit("")))
    return m.select("conv_id", "turn", text.normalize_message(msg).alias("normalized"))


@plan(
    """
SELECT page_id, regexp_extract(url, '://[^/]*/(.*)$', 1) AS path, regexp_extract(regexp_extract(url, '://[^/]*/(.*)$', 1), '([^/]*)$', 1) AS base,
  len(string_split(regexp_extract(url, '://[^/]*/(.*)$', 1), '/')) AS parts, NOT (contains(url, '://') OR starts_with(url, '/')) AS is_relative FROM pages
"""
)
def path_functions(spark, sf_dir):
    path = F.regexp_extract("url", r"://[^/]*/(.*)$", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), paths.basename(path).alias("base"), F.size(paths.suffixes(path)).cast("long").alias("parts"), paths.is_repo_relative(F.col("url")).alias("is_relative")
    )


# Ratchet -------------------------------------------------------------------------------------------------------------


def _findings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("rule_id"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("uri"), F.col("props").alias("message"),
        F.lit(None).cast("map<string,string>").alias("partial_fingerprints"), "event_id",
    )
    return ratchet.with_fingerprint(rows)


@plan("SELECT e.event_id, e.event_type AS rule_id, 'new' AS baseline_state FROM events e ANTI JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) b ON e.event_type = b.event_type AND e.user_id = b.user_id AND e.props = b.props")
def ratchet_new(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return ratchet.new_findings(f, f.where("event_id % 3 <> 0")).select("event_id", "rule_id", "baseline_state")


@plan("SELECT e.event_id, e.event_type AS rule_id, 'unchanged' AS baseline_state FROM events e SEMI JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) b ON e.event_type = b.event_type AND e.user_id = b.user_id AND e.props = b.props")
def ratchet_unchanged(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return ratchet.unchanged_findings(f, f.where("event_id % 3 <> 0")).select("event_id", "rule_id", "baseline_state")


@plan("SELECT doc_id AS seq, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def baseline_distinct_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"), "lang", "n_chars")
    return ratchet.distinct_first(d).select("seq", "lang", "n_chars")


@plan(
    """
WITH p AS (SELECT * FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS first_seen, o_orderpriority AS symbol, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 2 = 0) WHERE r = 1),
f AS (SELECT * FROM (SELECT o_custkey, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 3 <> 0) WHERE r = 1)
SELECT 'c' || f.o_custkey AS fingerprint, f.seq, p.symbol, coalesce(p.first_seen, '1997-01-01T00:00:00Z') AS first_seen FROM f LEFT JOIN p USING (o_custkey)
"""
)
def baseline_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("fingerprint"), F.col("o_orderstatus").alias("rule_id"), F.lit("").alias("uri"),
        F.col("o_orderpriority").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_seen"), F.lit(None).cast("string").alias("expires"), F.lit(None).cast("string").alias("justification"),
    )
    entries, _ = ratchet.update(base.where("seq % 3 <> 0"), base.where("seq % 2 = 0"), NOW)
    return entries.select("fingerprint", "seq", "symbol", "first_seen")


_EXPIRES = "CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'next quarter' WHEN 3 THEN '9999-99-99' END"


def _expires():
    key = F.col("o_orderkey") % 4
    return F.when(key == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 2, "next quarter").when(key == 3, "9999-99-99")


@plan(
    f"""
WITH b AS (SELECT o_orderkey AS seq, 'c' || o_custkey AS fingerprint, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority || '/' || o_custkey % 100 END AS uri, {_EXPIRES} AS expires FROM orders),
f AS (SELECT DISTINCT o_orderpriority || '/' || o_custkey % 100 AS uri FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0),
s AS (SELECT DISTINCT 'c' || c_custkey AS fingerprint FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM (SELECT seq, fingerprint, uri, CASE WHEN uri <> '' AND uri NOT IN (SELECT uri FROM f) THEN 'referent_gone'
  WHEN expires IS NOT NULL AND (NOT regexp_matches(expires, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR expires <= '{NOW}') THEN 'expired'
  WHEN fingerprint NOT IN (SELECT fingerprint FROM s) THEN 'never_matched' END AS reason FROM b) WHERE reason IS NOT NULL
"""
)
def rot_precedence(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    place = F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 100).cast("string"))
    base = o.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("fingerprint"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(place).alias("uri"), _expires().alias("expires")
    )
    files = o.where("o_orderstatus = 'F' and o_custkey % 3 = 0").select(place.alias("path"))
    seen = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("fingerprint"))
    return ratchet.detect_rot(base, seen, files, NOW).select("seq", "fingerprint", "uri", "reason")


@plan(f"SELECT o_orderkey, {_EXPIRES} AS expires, coalesce(NOT regexp_matches({_EXPIRES}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR {_EXPIRES} <= '{NOW}', false) AS expired FROM orders")
def expiry_lexicographic(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", _expires().alias("expires"), F.coalesce(text.has_expired(_expires(), F.lit(NOW)), F.lit(False)).alias("expired"))


@plan(
    """
WITH u AS (SELECT DISTINCT user_id AS run FROM events),
i AS (SELECT user_id AS run, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS bad FROM events WHERE event_type = 'signup' GROUP BY 1),
n AS (SELECT user_id AS run, count(*) AS notes FROM events WHERE event_type = 'error' GROUP BY 1),
a AS (SELECT user_id AS run, count(*) AS declared FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT run, CASE WHEN i.n IS NULL OR bad > 0 THEN 'failed' WHEN coalesce(notes, 0) > 0 OR coalesce(declared, 0) < 0.8 * 5 THEN 'degraded' ELSE 'healthy' END AS health,
  CASE WHEN i.n IS NULL THEN 1 ELSE bad END + coalesce(notes, 0) + CASE WHEN coalesce(declared, 0) < 0.8 * 5 THEN 1 ELSE 0 END AS n_reasons
FROM u LEFT JOIN i USING (run) LEFT JOIN n USING (run) LEFT JOIN a USING (run)
"""
)
def run_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("run")).distinct().withColumn("tool", F.lit("t")).withColumn("expected_targets", F.lit(5))
    idx = F.col("event_id").cast("int")
    inv = e.where("event_type = 'signup'").select(F.col("user_id").alias("run"), idx.alias("idx"), (F.col("event_id") % 10 != 0).alias("execution_successful"))
    notes = e.where("event_type = 'error'").select(F.col("user_id").alias("run"), F.lit(0).alias("idx"), idx.alias("nth"), F.lit("error").alias("level"), F.col("props").alias("message"))
    targets = e.where("event_type = 'view'").select(F.col("user_id").alias("run"), F.array(F.lit("analysisTarget")).alias("roles"))
    return ratchet.run_health(runs, inv, notes, targets).select("run", "health", F.size("reasons").cast("long").alias("n_reasons"))


@plan(
    """
WITH n AS (SELECT count(*) AS n_new FROM events e ANTI JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) b ON e.event_type = b.event_type AND e.user_id = b.user_id AND e.props = b.props)
SELECT CASE WHEN n_new > 0 THEN 'new_findings' ELSE 'clean' END AS verdict, true AS degraded, 0::BIGINT AS n_rot, n_new, CASE WHEN n_new > 0 THEN 1 ELSE 0 END AS exit_code FROM n
"""
)
def ratchet_verdict(spark, sf_dir):
    f = _findings(spark, sf_dir)
    health = spark.createDataFrame([("a", "healthy"), ("b", "degraded")], "run string, health string")
    return ratchet.verdict(health, f.limit(0), ratchet.new_findings(f, f.where("event_id % 3 <> 0")))


# Ledger --------------------------------------------------------------------------------------------------------------

_EV = "SELECT user_id AS candidate, CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'X' ELSE 'H' END AS family, (event_id % 21 - 10) / 4.0::DOUBLE AS bans, event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AS ok FROM events"
_SUMS = f"""
WITH e AS ({_EV}),
s AS (SELECT candidate, max(bans) FILTER (ok AND family = 'B' AND bans > 0) AS max_b, max(bans) FILTER (ok AND family = 'R' AND bans > 0) AS max_r, max(bans) FILTER (ok AND family = 'X' AND bans > 0) AS max_x,
  coalesce(max(bans) FILTER (ok AND family = 'B'), 0) AS part_b, coalesce(max(bans) FILTER (ok AND family = 'R'), 0) AS part_r, coalesce(max(bans) FILTER (ok AND family = 'X'), 0) AS part_x,
  greatest(least(coalesce(min(bans) FILTER (ok AND family = 'H' AND bans < 0), 0), 0.6), -0.6)::DOUBLE AS part_h FROM e GROUP BY 1),
t AS (SELECT *, part_b + part_r + part_x + part_h AS total_bans, list_filter([CASE WHEN max_b >= 0.5 THEN 'B' END, CASE WHEN max_r >= 0.5 THEN 'R' END, CASE WHEN max_x >= 0.5 THEN 'X' END], lambda x: x IS NOT NULL) AS acc FROM s)
"""


def _evidence(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    family = F.when(kind == "click", "B").when(kind == "view", "R").when(kind == "purchase", "X").otherwise("H")
    return e.select(
        F.col("user_id").alias("candidate"), family.alias("family"), kind.alias("signal"), ((i % 21 - 10) / 4.0).alias("bans"), (i % 11 != 0).alias("execution_successful"),
        (i % 13 != 0).alias("positive_control_passed"), (i % 17 == 0).alias("expired"),
    )


@plan(_SUMS + "SELECT candidate, max_b, max_r, max_x, part_h, round(total_bans, 6) AS total_bans, array_to_string(acc, ',') AS accusing FROM t")
def ledger_max_sum(spark, sf_dir):
    s = ledger.family_sums(_evidence(spark, sf_dir))
    return s.select("candidate", "max_b", "max_r", "max_x", "part_h", F.round("total_bans", 6).alias("total_bans"), F.array_join("accusing", ",").alias("accusing"))


@plan(_SUMS + "SELECT candidate, CASE WHEN candidate % 3 = 0 THEN 2 ELSE 3 END AS tier, len(acc)::BIGINT AS n_accusing, 8 + CASE WHEN candidate % 3 = 2 THEN 2 ELSE 0 END AS not_evaluable FROM t")
def tier_assign(spark, sf_dir):
    sums = ledger.family_sums(_evidence(spark, sf_dir))
    c = F.col("candidate")
    gate = sums.where(c % 3 != 2).select("candidate", F.when(c % 3 == 0, "Satisfied").otherwise("Failed").alias("gates_0_to_2"), F.lit("Satisfied").alias("gate_3f"))
    return ledger.assign(sums, gate).select("candidate", "tier", F.col("n_accusing").cast("long").alias("n_accusing"), "not_evaluable")


# Vetoes --------------------------------------------------------------------------------------------------------------

_CAND = "cand AS (SELECT item_id AS candidate, 'bench/' || string_split(text, ' ')[1] || '.py' AS path, left(text, 24) AS symbol FROM benchmark)"
_NEEDLES = _CAND + """, raw AS (
  SELECT candidate, path, 0 AS rank, 'basename' AS kind, regexp_extract(path, '([^/]*)$', 1) AS needle FROM cand UNION ALL
  SELECT candidate, path, 1, 'stem', regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') FROM cand UNION ALL
  SELECT candidate, path, 2, 'parent_dir', 'bench' FROM cand UNION ALL SELECT candidate, path, 3, 'symbol', symbol FROM cand),
needles AS (SELECT candidate, path, rank, kind, needle FROM (SELECT *, row_number() OVER (PARTITION BY candidate, needle ORDER BY rank) AS r FROM raw WHERE needle <> '') WHERE r = 1),
alone AS (SELECT candidate, any_value(path) AS own, string_agg(regexp_escape(needle), '|' ORDER BY length(needle) DESC) AS pattern FROM needles GROUP BY candidate),
held AS (SELECT DISTINCT n.candidate, c.path AS file, c.content FROM needles n JOIN corpus c ON contains(c.content, n.needle) WHERE c.path <> n.path),
cut AS (SELECT h.candidate, file, regexp_extract_all(content, pattern) AS met, string_split_regex(content, pattern) AS between FROM held h JOIN alone a USING (candidate)),
places AS (SELECT candidate, file, unnest(met) AS needle, unnest(list_transform(range(1, len(met) + 1), lambda i: list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(met[1:i - 1], lambda x: length(x))), 0))) AS pos FROM cut),
hits AS (SELECT n.candidate, n.kind, n.rank, n.needle, p.file, min(p.pos)::BIGINT AS pos FROM places p JOIN needles n ON p.candidate = n.candidate AND p.needle = n.needle GROUP BY ALL)
"""


def _candidates(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("candidate"), F.concat(F.lit("bench/"), F.split("text", " ")[0], F.lit(".py")).alias("path"), F.left(F.col("text"), F.lit(24)).alias("symbol"))


@plan(f"WITH {_NEEDLES.split(',' + chr(10) + 'alone AS')[0]} SELECT candidate, kind, rank, needle FROM needles")
def needle_derive(spark, sf_dir):
    return veto.derive_needles(_candidates(spark, sf_dir)).select("candidate", "kind", "rank", "needle")


@plan(f"WITH {CORPUS_SQL}, {_NEEDLES} SELECT candidate, kind, needle, file, pos::BIGINT AS pos FROM hits")
def literal_hits(spark, sf_dir):
    h = veto.literal_hits(_candidates(spark, sf_dir), corpus(spark, sf_dir))
    return h.select("candidate", "kind", "needle", "file", F.col("offset").cast("long").alias("pos"))


@plan(
    f"""WITH {CORPUS_SQL}, {_NEEDLES}, g AS (SELECT candidate, count(*) AS n_hits, arg_min(file, (file, pos, rank)) AS first_file FROM hits GROUP BY 1)
SELECT candidate, CASE WHEN n_hits > 0 THEN 'vetoed' ELSE 'clear' END AS verdict, CASE WHEN n_hits > 0 THEN 'reference' END AS reason, coalesce(n_hits, 0) AS n_hits, first_file FROM cand LEFT JOIN g USING (candidate)"""
)
def literal_veto(spark, sf_dir):
    return veto.literal_verdicts(_candidates(spark, sf_dir), corpus(spark, sf_dir))


@plan(
    f"""WITH {CORPUS_SQL}, {_NEEDLES}, k AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY file, pos, rank) AS r, count(*) OVER (PARTITION BY candidate) AS n_hits FROM hits)
SELECT candidate, any_value(n_hits) AS n_hits, any_value(n_hits) > 32 AS capped, string_agg(file, ',' ORDER BY r) AS files FROM k WHERE r <= 32 GROUP BY 1"""
)
def literal_hits_cap(spark, sf_dir):
    c = veto.capped_hits(veto.literal_hits(_candidates(spark, sf_dir), corpus(spark, sf_dir)))
    return c.select("candidate", "n_hits", "capped", F.array_join(F.transform("hits", lambda h: h["file"]), ",").alias("files"))


_URL = "regexp_extract(url, '://([^?#]*)', 1)"


@plan(
    f"""WITH p AS (SELECT page_id AS candidate, {_URL} AS path FROM pages),
r AS (SELECT DISTINCT regexp_extract(path, '^([^/]*/[^/]*)', 1) AS path FROM p WHERE candidate % 5 = 0),
near AS (SELECT candidate, max(length(r.path)) AS n FROM p JOIN r ON p.path = r.path OR starts_with(p.path, r.path || '/') GROUP BY 1)
SELECT candidate, CASE WHEN n IS NULL AND NOT ends_with(path, '.html') THEN 'clear' ELSE 'vetoed' END AS verdict, coalesce('under ' || left(path, n), CASE WHEN ends_with(path, '.html') THEN 'pages' END) AS reason FROM p LEFT JOIN near USING (candidate)"""
)
def ancestor_root_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("candidate"), F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    rooted = p.where("candidate % 5 = 0").select(F.regexp_extract("path", "^([^/]*/[^/]*)", 1).alias("path")).distinct().withColumn("reason", F.concat(F.lit("under "), "path"))
    suffix = spark.createDataFrame([(".html", "pages")], "suffix string, reason string")
    none = spark.createDataFrame([], "path string, reason string")
    return veto.reachability_verdicts(p, rooted, suffix, none)


@plan(
    """WITH r AS (SELECT 'a' AS region, '/www.example.com' AS region_path UNION ALL SELECT 'b', '/data/x/en' UNION ALL SELECT 'c', '/data'),
c AS (SELECT page_id AS candidate, '/data/x/' || regexp_extract(url, '://[^/]*/(.*)$', 1) AS path FROM pages),
h AS (SELECT candidate, string_agg(region || ':' || CASE WHEN path = region_path THEN 'is' WHEN starts_with(path, region_path || '/') THEN 'inside' ELSE 'contains' END, ',' ORDER BY region) AS relations
  FROM c JOIN r ON path = region_path OR starts_with(path, region_path || '/') OR starts_with(region_path, rtrim(path, '/') || '/') GROUP BY 1)
SELECT candidate, CASE WHEN relations IS NULL THEN 'clear' ELSE 'refuses' END AS verdict, coalesce(relations, '') AS relations FROM c LEFT JOIN h USING (candidate)"""
)
def prefix_containment(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select(F.col("page_id").alias("candidate"), F.concat(F.lit("/data/x/"), F.regexp_extract("url", r"://[^/]*/(.*)$", 1)).alias("path"))
    regions = spark.createDataFrame([("a", "/www.example.com"), ("b", "/data/x/en"), ("c", "/data")], "region string, region_path string")
    v = gates.gate_0e(c, regions)
    said = F.transform(F.coalesce("relations", F.array().cast("array<struct<region:string,relation:string>>")), lambda r: F.concat(r["region"], F.lit(":"), r["relation"]))
    return v.select("candidate", "verdict", F.array_join(said, ",").alias("relations"))


@plan(
    """WITH e AS (SELECT user_id AS candidate, max(floor(epoch(ts))::BIGINT) AS touched FROM events WHERE event_type <> 'signup' GROUP BY 1),
c AS (SELECT DISTINCT user_id AS candidate FROM events), n AS (SELECT max(floor(epoch(ts))::BIGINT) AS now FROM events)
SELECT candidate, CASE WHEN r IS NULL THEN 'abstain' ELSE 'vetoed' END AS verdict, r AS reason, age FROM (
  SELECT candidate, CASE WHEN candidate % 10 = 0 THEN 'uncommitted_change' WHEN touched IS NULL THEN 'no_commit_timestamp' WHEN now - touched <= 7 * 86400 THEN 'recent_commit' END AS r, now - touched AS age FROM c LEFT JOIN e USING (candidate), n)"""
)
def recency_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    c = e.select(F.col("user_id").alias("candidate")).distinct().withColumn("path", F.col("candidate"))
    touches = e.where("event_type <> 'signup'").select(F.col("user_id").alias("path"), at.alias("committed_at"), at.alias("authored_at"))
    status = c.select("path", (F.col("path") % 10 == 0).alias("dirty"))
    now = F.lit(e.agg(F.max(at)).first()[0])
    return veto.recency_verdicts(c, touches, status, F.lit(False), now)


@plan(
    """WITH c AS (SELECT event_id AS candidate, event_type, user_id FROM events)
SELECT candidate, CASE WHEN user_id % 4 = 0 THEN 'a' WHEN event_type = 'error' THEN 'b' END AS gate, CASE WHEN user_id % 4 = 0 THEN 'user' WHEN event_type = 'error' THEN 'type' END AS reason FROM c"""
)
def first_veto(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("event_id").alias("candidate"))
    verdict = lambda hit, why: e.select(F.col("event_id").alias("candidate"), F.when(hit, "vetoed").otherwise("clear").alias("verdict"), F.lit(why).alias("reason"))
    return veto.first_veto(c, [("a", verdict(F.col("user_id") % 4 == 0, "user")), ("b", verdict(F.col("event_type") == "error", "type"))])


# Gates and rules -----------------------------------------------------------------------------------------------------


@plan(
    """SELECT o_orderkey AS candidate, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'TRACKED_UNPUSHED' WHEN o_orderstatus = 'O' THEN 'IGNORED' ELSE 'UNTRACKED' END AS class FROM orders"""
)
def recoverability(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "F").alias("tracked"), (F.col("o_orderstatus") == "O").alias("ignored"))
    return gates.recoverability(o.select(F.col("o_orderkey").alias("candidate"), F.col("o_orderkey").alias("path")), status, False).select("candidate", "class")


_RULES = (("", 1, "*.en", "filter=lfs", True), ("", 2, "src1*/**", "filter=lfs", False), ("src1", 1, "*[05].en", "filter=lfs", True), ("", 3, "*.fr", "linguist-vendored", True), ("", 4, "src?/*.fr", "linguist-vendored", False))


@plan(
    f"""WITH {CORPUS_SQL}, r AS (SELECT * FROM (VALUES
  ('', 0, 1, '*.en', '^[^/]*\\.en$', false, 'filter=lfs', true), ('', 0, 2, 'src1*/**', '^src1[^/]*/.*$', true, 'filter=lfs', false), ('src1', 1, 1, '*[05].en', '^[^/]*[05]\\.en$', false, 'filter=lfs', true),
  ('', 0, 3, '*.fr', '^[^/]*\\.fr$', false, 'linguist-vendored', true), ('', 0, 4, 'src?/*.fr', '^src[^/]/[^/]*\\.fr$', true, 'linguist-vendored', false)) v(dir, depth, line, pattern, regex, whole, attribute, is_set)),
h AS (SELECT c.path, r.* FROM corpus c JOIN r ON (dir = '' OR starts_with(c.path, dir || '/')) AND regexp_matches(CASE WHEN whole THEN c.path ELSE regexp_extract(c.path, '([^/]*)$', 1) END, regex))
SELECT path, attribute, arg_max(pattern, (depth, dir, line)) AS pattern, arg_max(is_set, (depth, dir, line)) AS is_set FROM h GROUP BY path, attribute"""
)
def last_match_wins(spark, sf_dir):
    return rules.last_match(corpus(spark, sf_dir), rules.attribute_rules(spark, list(_RULES)))


@plan(
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES (0, 'prefix', 'de/', 'german'), (1, 'base_suffix', '.html', 'page'), (2, 'contains', '7', 'seven'), (3, 'anchored', 'en/', 'english'), (4, 'exact', 'fr/10', 'ten')) v(idx, matcher, literal, rule)),
h AS (SELECT path, idx, rule FROM p JOIN r ON CASE matcher WHEN 'prefix' THEN starts_with(path, literal) WHEN 'base_suffix' THEN ends_with(regexp_extract(path, '([^/]*)$', 1), literal) WHEN 'contains' THEN contains(path, literal)
  WHEN 'anchored' THEN starts_with(path, literal) OR contains(path, '/' || literal) ELSE path = literal END)
SELECT path, 'u' AS class, min(idx) AS idx, arg_min(rule, idx) AS rule FROM h GROUP BY path"""
)
def rule_engine_first_match(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).distinct()
    rows = [("u", 0, "prefix", "de/", "german"), ("u", 1, "base_suffix", ".html", "page"), ("u", 2, "contains", "7", "seven"), ("u", 3, "anchored", "en/", "english"), ("u", 4, "exact", "fr/10", "ten")]
    return rules.rule_matches(files, spark.createDataFrame(rows, "class string, idx int, matcher string, literal string, rule string"))


@plan(
    """WITH e AS (SELECT user_id AS path, event_type AS class, CASE event_id % 4 WHEN 0 THEN 'magic' WHEN 1 THEN 'name' WHEN 2 THEN 'tree' ELSE 'pointer' END AS via, event_id AS seq, props AS evidence FROM events)
SELECT path, class, via, evidence FROM (SELECT *, row_number() OVER (PARTITION BY path, class ORDER BY CASE via WHEN 'magic' THEN 5 WHEN 'pointer' THEN 4 WHEN 'name' THEN 2 ELSE 1 END DESC, seq) AS r FROM e) WHERE r = 1"""
)
def best_evidence_per_class(spark, sf_dir):
    via = F.element_at(F.array(*map(F.lit, ("magic", "name", "tree", "pointer"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("class"), via.alias("via"), F.col("event_id").alias("seq"), F.col("props").alias("evidence"))
    return rules.best_evidence(rows)


@plan(
    """WITH f AS (SELECT DISTINCT o_custkey % 97 AS d, lpad((o_orderkey % 100000)::VARCHAR, 6, '0') AS ordinal FROM orders)
SELECT 'db/' || d || '/' || ordinal || '_x.sql' AS path, 'zero_padded_ordinal' AS scheme, ordinal, CASE WHEN ordinal::INT = max(ordinal::INT) OVER (PARTITION BY d) THEN 'newest' ELSE 'earlier' END AS rank FROM f"""
)
def newest_in_sequence(spark, sf_dir):
    number = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 6, "0")
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("db/"), (F.col("o_custkey") % 97).cast("string"), F.lit("/"), number, F.lit("_x.sql")).alias("path")).distinct()
    return rules.migrations(files)


@plan(
    """SELECT doc_id, CASE WHEN list_sum(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) // len(string_split(text, chr(10))) > 110 THEN true ELSE false END AS minified FROM documents"""
)
def mean_line_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(rules.minified(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".js")), F.col("text")), F.lit(False)).alias("minified"))


@plan(
    """WITH m AS (SELECT conv_id, turn, regexp_extract(coalesce(text, ''), '([A-Za-z]+)[^A-Za-z]*$', 1) AS symbol FROM conversations WHERE role = 'user'),
h AS (SELECT DISTINCT m.conv_id, m.turn, m.symbol FROM m JOIN conversations c ON c.conv_id = m.conv_id AND c.turn BETWEEN m.turn + 1 AND m.turn + 3 AND m.symbol <> '' AND regexp_matches(c.text, '(^|[^A-Za-z0-9_])' || m.symbol || '($|[^A-Za-z0-9_])'))
SELECT conv_id, turn, symbol FROM h"""
)
def line_proximity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), F.coalesce("text", F.lit("-")).alias("text"))
    marked = c.where("role = 'user'").select(F.col("conv_id").alias("path"), (F.col("turn") + 1).alias("line"), F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+)[^A-Za-z]*$", 1).alias("symbol"), F.lit("m").alias("marker"))
    return persistence.nearby(marked, lines, 2).select(F.col("path").alias("conv_id"), (F.col("line") - 1).alias("turn"), "symbol").distinct()


# Coverage ------------------------------------------------------------------------------------------------------------


@plan(
    """WITH f AS (SELECT l_suppkey AS source, l_partkey AS name, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END) AS calls FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_suppkey AS source, l_linenumber AS line, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1, 2)
SELECT source, (SELECT count(*) FROM f WHERE f.source = l.source AND calls > 0) AS called, (SELECT sum(calls)::BIGINT FROM f WHERE f.source = l.source) AS calls, count(*) AS lines_found, count(*) FILTER (n > 0) AS lines_hit FROM l GROUP BY source"""
)
def coverage_two_level_sum(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("name"), F.lit(None).cast("long").alias("start_line"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).alias("calls"))
    lines = li.select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("count"))
    functions, files = coverage.merge(f, lines)
    g = functions.groupBy("source").agg(F.count_if(F.col("calls") > 0).alias("called"), F.sum("calls").alias("calls"))
    return files.join(g, "source").select("source", "called", "calls", "lines_found", "lines_hit")


@plan(
    """WITH s AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS source FROM pages), c AS (SELECT DISTINCT regexp_extract(source, '/(.*)$', 1) AS claim FROM s WHERE contains(source, '/'))
SELECT claim, arg_min(source, (length(source), source)) AS source FROM c JOIN s ON source = claim OR ends_with(source, '/' || claim) GROUP BY claim"""
)
def shortest_suffix_match(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("source")).distinct()
    return coverage.rescued_paths(s.where("contains(source, '/')").select(F.regexp_extract("source", "/(.*)$", 1).alias("claim")), s)


@plan(
    """WITH d AS (SELECT DISTINCT n_name AS symbol FROM nation), c AS (SELECT n_name AS name FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 HAVING sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) > 0)
SELECT (SELECT count(*) FROM d) AS declared, (SELECT count(*) FROM d WHERE symbol NOT IN (SELECT name FROM c)) AS uncalled, (SELECT count(*) FROM c) AS called_functions,
  (SELECT count(*) FROM d WHERE symbol NOT IN (SELECT name FROM c)) = 0 AND (SELECT count(*) FROM c) >= (SELECT count(*) FROM d) AS passed"""
)
def control_floor(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    f = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("calls")).withColumn("source", F.lit("s"))
    return coverage.control(n.select(F.col("n_name").alias("symbol")), f).select("declared", "uncalled", "called_functions", "passed")


# Grading and layers --------------------------------------------------------------------------------------------------


@plan(
    """SELECT sha256(text) AS claim, CASE WHEN count(DISTINCT lang || source) = 1 AND count(lang || source) = count(*) THEN min(lang || source) END AS declared_in FROM documents GROUP BY 1"""
)
def claim_dedup_agree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("m").alias("mutant"), F.lit("s").alias("sut"), F.lit("path").alias("kind"), F.sha2(F.col("text").cast("binary"), 256).alias("claim"), F.concat("lang", "source").alias("declared_in"))
    return suite.dedup_by_name(d).select("claim", "declared_in")


_TRUTH = """claims AS (SELECT n_name AS mutant, s_name AS claim FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0),
live AS (SELECT n_name AS mutant, s_name AS claim FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0),
decoy AS (SELECT n_name AS mutant, s_name AS claim FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 6 = 1 OR s_suppkey % 6 = 3),
t AS (SELECT DISTINCT n_name AS mutant FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT mutant, (SELECT count(*) FROM claims c JOIN live l USING (mutant, claim) WHERE c.mutant = t.mutant) AS n_false, (SELECT count(*) FROM claims c JOIN decoy d USING (mutant, claim) WHERE c.mutant = t.mutant) AS decoys_found,
  (SELECT count(*) FROM decoy d WHERE d.mutant = t.mutant) AS decoys_total FROM t)"""


def _suite(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("mutant"), "s_suppkey", "s_name")
    k = F.col("s_suppkey")
    claims = s.where(k % 3 == 0).select("mutant", F.lit("a").alias("sut"), F.lit("path").alias("kind"), F.col("s_name").alias("claim"), F.lit(None).cast("string").alias("declared_in"))
    decoys = F.array_sort(F.collect_list(F.when((k % 6 == 1) | (k % 6 == 3), F.col("s_name"))))
    truth = s.groupBy("mutant").agg(F.collect_list(F.when(k % 5 == 0, F.col("s_name"))).alias("live_paths"), decoys.alias("decoy_dead_paths"))
    truth = truth.withColumn("live_symbols", F.array().cast("array<string>")).withColumn("decoy_dead_symbols", F.transform("decoy_dead_paths", lambda p: F.lit("")))
    suts = spark.createDataFrame([("a", None)], "sut string, reads array<string>")
    return suite.grade(claims, truth, suts)


@plan(f"WITH {_TRUTH} SELECT mutant, CASE WHEN n_false = 0 AND decoys_found = decoys_total THEN 'passed' ELSE 'failed' END AS grade, n_false, decoys_found, decoys_total FROM g")
def grade_confusion(spark, sf_dir):
    return _suite(spark, sf_dir).select("mutant", "grade", F.col("n_false").cast("long").alias("n_false"), F.col("decoys_found").cast("long").alias("decoys_found"), F.col("decoys_total").cast("long").alias("decoys_total"))


@plan(f"WITH {_TRUTH} SELECT count(*) AS graded, count(*) FILTER (n_false = 0 AND decoys_found = decoys_total) AS passed, sum(n_false)::BIGINT AS false_removals, sum(decoys_found)::BIGINT AS decoys_found, sum(decoys_total)::BIGINT AS decoys_total FROM g")
def suite_counts(spark, sf_dir):
    c = suite.suite_counts(_suite(spark, sf_dir))
    return c.select("graded", "passed", *[F.col(x).cast("long").alias(x) for x in ("false_removals", "decoys_found", "decoys_total")])


@plan(
    """WITH f AS (SELECT r_name AS mutant, n_name AS claim FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT mutant, claim FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.mutant = a.mutant AND b.claim <> a.claim AND contains(b.claim || ' and ' || left(b.claim, 3), a.claim))"""
)
def naive_unreferenced(spark, sf_dir):
    f = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parsed = f.select(F.col("r_name").alias("mutant"), F.col("n_name").alias("path"), F.concat("n_name", F.lit(" and "), F.left("n_name", F.lit(3))).alias("text"))
    return suite.naive_claims(parsed, spark.createDataFrame([], "mutant string, symbol string, declared_in string")).select("mutant", "claim")


_CODE = """SELECT source AS mutant, lang || '/' || doc_id || '/' || CASE WHEN doc_id % 11 = 0 THEN 'main' ELSE coalesce(nullif(regexp_extract(text, '[a-z]{4,}', 0), ''), 'x') END || CASE doc_id % 10 WHEN 9 THEN '.md' ELSE '.py' END AS path,
  coalesce(text, '') || chr(10) || 'undef x' || chr(10) || 'def f_' || (doc_id % 50) || '(a): # class none' || chr(10) || '    return g_' || (doc_id % 37) || chr(10) || 'pub struct S' || doc_id || ' { }' || chr(10) AS text FROM documents"""


@plan(
    f"""WITH f AS ({_CODE}), b AS (SELECT *, path LIKE '%.py' AS code, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '([^/]*)[.][^./]*$', 1) AS stem FROM f),
s AS (SELECT mutant, unnest(['f_' || regexp_extract(text, 'f_([0-9]+)[(]a', 1), 'S' || regexp_extract(text, 'struct S([0-9]+) ', 1)]) AS symbol, path FROM b WHERE code),
d AS (SELECT mutant, symbol, min(path) AS declared_in FROM s GROUP BY ALL)
SELECT mutant, 'path' AS kind, path AS claim, NULL AS declared_in FROM b WHERE stem <> 'main' AND NOT EXISTS (SELECT 1 FROM b o WHERE o.code AND o.mutant = b.mutant AND o.path <> b.path AND contains(o.text, b.stem))
UNION ALL SELECT mutant, 'symbol', symbol, declared_in FROM d WHERE (SELECT sum(len(string_split(text, symbol)) - 1) FROM b WHERE code AND b.mutant = d.mutant) <= 1"""
)
def naive_cleaner(spark, sf_dir):
    """The cleaner that must fail, over all documents as files of a class each: paths that no other source names, symbols that occur once, entry points left alone, files that it cannot read claimed."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 11 == 0, "main").otherwise(F.coalesce(F.nullif(F.regexp_extract("text", "[a-z]{4,}", 0), F.lit("")), F.lit("x")))
    path = F.concat("lang", F.lit("/"), "doc_id", F.lit("/"), name, F.when(F.col("doc_id") % 10 == 9, ".md").otherwise(".py"))
    more = F.expr("'\nundef x\ndef f_' || (doc_id % 50) || '(a): # class none\n    return g_' || (doc_id % 37) || '\npub struct S' || doc_id || ' { }\n'")
    return suite.naive(d.select(F.col("source").alias("mutant"), path.alias("path"), F.concat(F.coalesce("text", F.lit("")), more).alias("text"))).select("mutant", "kind", "claim", "declared_in")


_LAYERS = """SELECT source AS mutant, doc_id::VARCHAR AS claim, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN lang = 'fr' THEN 1 WHEN n_chars > 3000 THEN 2 WHEN contains(text, 'the') THEN 3 WHEN doc_id % 2 = 0 THEN 4 END AS layer_idx FROM documents"""
LAYER_NAMES = ["gate1", "gate3f", "coverage", "roots", "veto"]


def _layered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("mutant"), F.lit("naive").alias("sut"), F.lit("path").alias("kind"), F.col("doc_id").cast("string").alias("claim"), "doc_id", "lang", "n_chars", "text")
    tests = ["doc_id % 7 = 0", "lang = 'fr'", "n_chars > 3000", "contains(text, 'the')", "doc_id % 2 = 0"]
    layers = [(n, d.where(t).select("mutant", "sut", "kind", "claim", F.lit(t).alias("rule"))) for n, t in zip(LAYER_NAMES, tests)]
    claims = d.select("mutant", "sut", "kind", "claim")
    return claims, *suite.apply_layers(claims, layers)


@plan(f"SELECT mutant, claim FROM ({_LAYERS}) WHERE layer_idx IS NULL")
def layer_stack(spark, sf_dir):
    return _layered(spark, sf_dir)[1].select("mutant", "claim")


@plan(f"SELECT mutant, claim, layer_idx, ['gate1', 'gate3f', 'coverage', 'roots', 'veto'][layer_idx + 1] AS layer FROM ({_LAYERS}) WHERE layer_idx IS NOT NULL")
def layer_attribution(spark, sf_dir):
    return _layered(spark, sf_dir)[2].select("mutant", "claim", "layer_idx", "layer")


@plan(
    f"""WITH l AS ({_LAYERS}), i AS (SELECT unnest([0, 1, 2, 3, 4]) AS layer_idx)
SELECT l.mutant, i.layer_idx, count(*) FILTER (l.layer_idx IS NULL OR l.layer_idx >= i.layer_idx) AS claimed, count(*) FILTER (l.layer_idx = i.layer_idx) AS dropped, count(*) FILTER (l.layer_idx IS NULL OR l.layer_idx > i.layer_idx) AS survived FROM l, i GROUP BY 1, 2"""
)
def conservation_check(spark, sf_dir):
    claims, _, dropped = _layered(spark, sf_dir)
    return suite.layer_runs(claims, dropped, LAYER_NAMES).select("mutant", "layer_idx", "claimed", "dropped", "survived")


# Roots ---------------------------------------------------------------------------------------------------------------


_DECLARED = [("src1*", "generated", "generated", "accepted", None), ("!src12", "not that one", "generated", "accepted", None), ("*.fr", "vendored", "vendored", "rejected", None), ("src3/**", "loaded", "dynamic", "accepted", "1990-01-01"), ("nowhere/x", "gone", "dynamic", "accepted", None)]
_DECLARED_SQL = """d AS (SELECT * FROM (VALUES (0, 'src1*', '^(?:[^/]+/)*src1[^/]*(?:/.*)?$', false, 'accepted', NULL), (1, '!src12', '^(?:[^/]+/)*src12(?:/.*)?$', true, 'accepted', NULL), (2, '*.fr', '^(?:[^/]+/)*[^/]*\\.fr(?:/.*)?$', false, 'rejected', NULL),
  (3, 'src3/**', '^src3/[^/]+(?:/.*)?$', false, 'accepted', '1990-01-01'), (4, 'nowhere/x', '^nowhere/x(?:/.*)?$', false, 'accepted', NULL)) v(idx, pathspec, regex, negated, status, expires)),
w AS (SELECT c.path, max(idx) AS idx FROM corpus c JOIN d ON regexp_matches(c.path, regex) GROUP BY 1)"""


@plan(f"WITH {CORPUS_SQL}, {_DECLARED_SQL} SELECT path, pathspec AS origin FROM w JOIN d USING (idx) WHERE NOT negated AND status <> 'rejected'")
def declared_roots(spark, sf_dir):
    return roots.declared_roots(corpus(spark, sf_dir), roots.declared_table(spark, _DECLARED)).select("path", "origin")


@plan(
    f"""WITH {CORPUS_SQL}, {_DECLARED_SQL} SELECT idx, reason FROM (SELECT d.idx, CASE WHEN NOT regexp_matches(d.pathspec, '[*?!]') AND NOT EXISTS (SELECT 1 FROM corpus WHERE corpus.path = d.pathspec OR starts_with(corpus.path, d.pathspec || '/')) THEN 'referent_gone' WHEN d.expires <= '{NOW}' THEN 'expired' WHEN d.idx NOT IN (SELECT idx FROM w) THEN 'matched_nothing' END AS reason FROM d) WHERE reason IS NOT NULL"""
)
def declared_lint(spark, sf_dir):
    return roots.lint(corpus(spark, sf_dir), roots.declared_table(spark, _DECLARED), NOW).select("idx", "reason")


@plan(
    f"""WITH {CORPUS_SQL} SELECT path, regexp_matches(path, '^(?:[^/]+/)*[^/]*[05]\\.en(?:/.*)?$') AS hit FROM corpus"""
)
def pathspec_match(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", F.col("path").rlike(pathspec("*[05].en").regex).alias("hit"))


@plan(
    f"""WITH {CORPUS_SQL}, r AS (SELECT path, doc_id FROM corpus WHERE doc_id % 4 = 0)
SELECT 'path' AS kind, path AS claim, 'r' || min(doc_id % 3) AS rule FROM r GROUP BY path"""
)
def root_rescue(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), "doc_id")
    none = F.lit(None).cast("string")
    r = d.where("doc_id % 4 = 0").select(F.lit("C").alias("tier"), F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("rule"), none.alias("origin"), none.alias("origin_file"), "path", none.alias("symbol"), F.lit("path").alias("target"), none.alias("detail"))
    return roots.rescues(d.select(F.lit("path").alias("kind"), F.col("path").alias("claim")), r)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
