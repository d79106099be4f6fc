"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import chat_format, conversation_repair, embedding_dedup, exact_dedup, packing, quality, secret_scan, simhash, sp_codec, spelling, substring_dedup, toxicity, url_filters
from siftline.llm.common import table

Rule = url_filters.Rule
HOST_RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
GLOBS = [Rule(f"*{x}*", "block") for x in ("cheap-pills", "casino", "free-bets", "spam-farm", "ads-track")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every row of ``pages``; null and odd urls as ``url_filters.decide_urls`` has them."""
    decided = url_filters.decide_urls(table(spark, sf_dir, "pages"), HOST_RULES, GLOBS)
    return decided.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host || chr(1) || path, 'cheap-pills') OR contains(host || chr(1) || path, 'casino') OR contains(host || chr(1) || path, 'free-bets')
    OR contains(host || chr(1) || path, 'spam-farm') OR contains(host || chr(1) || path, 'ads-track') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in the whole texts of ``documents`` and whether it is a secret; nulls, repeats and empty tables as ``secret_scan.scan`` has them."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(spark)).withColumnRenamed("id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``: its group of equal texts, whose largest id stays; null and repeated ids as ``exact_dedup.exact_groups`` has them."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents`` in sequences of at most 2048 tokens; null texts and ids, repeats and empty tables as ``packing.pack`` has them."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, end_id=1).withColumnRenamed("id", "doc_id")


Param = chat_format.Param
CHAT_SCHEMAS = {
    "reply": {"role": Param("string", True, ('"user"', '"system"')), "text": Param("string", True)},
    "search": {"limit": Param("integer"), "query": Param("string", True), "scope": Param("string", values=('"all"', '"near"'))},
    "compare": {"weights": Param("array", items="number"), "with": Param("object", True, fields={"$ref": Param("string", True)})},
}


def marked_turns(conversations: DataFrame) -> DataFrame:
    """``conversations`` with tool calls and results in place of their texts, all derived from the turns' own numbers, lengths and first words.

    The table holds no tool calls of its own. Of user and system turns (n: the text's length) those with n % 10 = 9 stay as they are; the others call ``search``, ``compare`` or an unknown
    tool, some with wrong, missing, unknown or no arguments, some cut off, some with a second call, ``compare`` with a reference two turns ahead or back (which makes circles, too). An
    assistant's turn answers the turn before, or too early the turn after it, or nobody.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), F.length(text).alias("n"), F.regexp_extract(text, "[A-Za-z]+", 0).alias("w"))
    call = F.expr("""
        CASE WHEN n % 17 = 0 THEN '<tool_call>{"id": "c' || turn || '", "name": "search", "argum</tool_call>'
        WHEN n % 11 <> 0 AND n % 2 = 1 THEN '<tool_call>{"name": "compare", "id": "c' || turn || '", "arguments": {"with": {"$ref": "c' || if(n % 4 = 1, turn + 2, turn - 2)
          || '"}, "weights": [1, ' || if(n % 9 = 5, '"x"', '2.5') || ']}}</tool_call>'
        ELSE '<tool_call>{"name": "' || if(n % 11 = 0, 'erase', 'search') || '", "id": "c' || turn || '", "arguments": {"scope": "' || element_at(array('all', 'near', 'far'), n % 3 + 1) || '", '
          || if(n % 7 = 2, '', '"query": "' || w || '", ') || if(n % 13 = 4, '"debug": true, ', '') || '"limit": ' || if(n % 5 = 3, '"3"', cast(n % 5 as string)) || '}}</tool_call>' END
        || if(n % 6 = 0, ' and <tool_call>{"id": "c' || turn || 'b", "name": "search", "arguments": {"query": "again"}}</tool_call>', '')""")
    answers = F.expr("CASE n % 8 WHEN 0 THEN 'c' || (turn + 1) WHEN 1 THEN 'x' || turn ELSE 'c' || (turn - 1) END")
    result = F.concat(F.lit("<tool_result>"), F.to_json(F.struct(answers.alias("id"), F.col("text").alias("content"))), F.lit("</tool_result>"))
    said = F.when(F.expr("n % 10 = 9"), F.col("text")).when(F.expr("role in ('user', 'system')"), call).when(F.expr("role = 'assistant'"), result)
    return rows.select("conv_id", "turn", "role", said.alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and results of the whole of ``conversations`` (see ``marked_turns``), linked, ordered (level -1: in a circle of
    references, or above one), validated and serialised; nulls and repeats as ``chat_format.link`` has them."""
    calls, results = chat_format.parse_messages(marked_turns(table(spark, sf_dir, "conversations")))
    return chat_format.link(calls, results, CHAT_SCHEMAS).withColumn("level", F.coalesce("level", F.lit(-1)))


OP5_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS w FROM conversations),
asking AS (SELECT * FROM m WHERE role IN ('user', 'system')),
calls AS (
  SELECT conv_id, turn::VARCHAR AS call_id, 'reply' AS name, turn, 0 AS nth, '{"role":' || to_json(role)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' AS arguments, '' AS problems, NULL::BIGINT AS target
  FROM asking WHERE n % 10 = 9
  UNION ALL
  SELECT conv_id, NULL, NULL, turn, 0, to_json('{"id": "c' || turn || '", "name": "search", "argum')::VARCHAR, 'arguments are not JSON; unknown tool', NULL
  FROM asking WHERE n % 10 <> 9 AND n % 17 = 0
  UNION ALL
  SELECT conv_id, 'c' || turn, 'compare', turn, 0,
    '{"weights":[1,' || CASE WHEN n % 9 = 5 THEN '"x"' ELSE '2.5' END || '],"with":{"$ref":"c' || CASE WHEN n % 4 = 1 THEN turn + 2 ELSE turn - 2 END || '"}}',
    CASE WHEN n % 9 = 5 THEN 'weights holds what is not number' ELSE '' END, CASE WHEN n % 4 = 1 THEN turn + 2 ELSE turn - 2 END
  FROM asking WHERE n % 10 <> 9 AND n % 17 <> 0 AND n % 11 <> 0 AND n % 2 = 1
  UNION ALL
  SELECT conv_id, 'c' || turn, CASE WHEN n % 11 = 0 THEN 'erase' ELSE 'search' END, turn, 0,
    '{' || CASE WHEN n % 13 = 4 THEN '"debug":true,' ELSE '' END || '"limit":' || CASE WHEN n % 5 = 3 THEN '"3"' ELSE (n % 5)::VARCHAR END
      || CASE WHEN n % 7 = 2 THEN '' ELSE ',"query":"' || w || '"' END || ',"scope":"' || ['all', 'near', 'far'][n % 3 + 1] || '"}',
    CASE WHEN n % 11 = 0 THEN 'unknown tool' ELSE concat_ws('; ', CASE WHEN n % 5 = 3 THEN 'limit is not integer' END, CASE WHEN n % 7 = 2 THEN 'missing query' END,
      CASE WHEN n % 3 = 2 THEN 'scope is none of its values' END, CASE WHEN n % 13 = 4 THEN 'unknown argument debug' END) END, NULL
  FROM asking WHERE n % 10 <> 9 AND n % 17 <> 0 AND (n % 11 = 0 OR n % 2 = 0)
  UNION ALL
  SELECT conv_id, 'c' || turn || 'b', 'search', turn, 1, '{"query":"again"}', '', NULL FROM asking WHERE n % 10 <> 9 AND n % 6 = 0),
results AS (
  SELECT conv_id, turn, text AS content, CASE WHEN n % 10 = 9 THEN (turn - 1)::VARCHAR WHEN n % 8 = 0 THEN 'c' || (turn + 1) WHEN n % 8 = 1 THEN 'x' || turn ELSE 'c' || (turn - 1) END AS call_id
  FROM m WHERE role = 'assistant'),
edges AS (
  SELECT c.conv_id, c.call_id, t.call_id AS target, t.turn >= c.turn AS ahead FROM calls c JOIN calls t ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND t.call_id = 'c' || c.target),
tangled AS (SELECT * FROM edges WHERE conv_id IN (SELECT conv_id FROM edges WHERE ahead)),
many AS (SELECT conv_id, count(DISTINCT call_id) AS most FROM tangled GROUP BY conv_id),
walk AS (
  SELECT conv_id, target AS call_id, 0 AS level FROM tangled
  UNION
  SELECT e.conv_id, e.call_id, w.level + 1 FROM tangled e JOIN walk w ON e.conv_id = w.conv_id AND e.target = w.call_id JOIN many m ON e.conv_id = m.conv_id WHERE w.level <= most),
levels AS (SELECT conv_id, call_id, CASE WHEN max(level) <= any_value(most) THEN max(level) END AS level, true AS leveled FROM walk JOIN many USING (conv_id) GROUP BY ALL),
first AS (SELECT conv_id, call_id, min(turn) AS turn, arg_min(content, (turn, content)) AS content FROM results GROUP BY ALL),
u AS (
  SELECT c.conv_id, c.call_id, CASE WHEN f.turn IS NULL THEN 'no_result' WHEN f.turn < c.turn THEN 'early_result' ELSE 'linked' END AS status,
    CASE WHEN l.leveled THEN l.level ELSE 0 END AS level, c.turn, c.nth, c.name, c.problems, c.arguments, f.content
  FROM calls c LEFT JOIN first f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.call_id = f.call_id LEFT JOIN levels l ON c.conv_id = l.conv_id AND c.call_id = l.call_id
  UNION ALL
  SELECT r.conv_id, r.call_id, 'orphan_result', 0, r.turn, 0, NULL, '', NULL, r.content
  FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id))
SELECT conv_id, call_id, status, coalesce(level, -1) AS level, turn, nth, name, problems = '' AS valid, problems,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM u
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``: how many words go because a window of 20 starts earlier; null and repeated ids as ``substring_dedup.cut_repeats`` has them."""
    cut = substring_dedup.cut_repeats(table(spark, sf_dir, "documents"), window=20)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``: fingerprint and component; nulls, repeats and empty tables as ``simhash.simhash_components`` has them."""
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``embeddings``: links and component; unusable vectors, null labels and ids as ``embedding_dedup.vector_components`` has them."""
    out = embedding_dedup.vector_components(table(spark, sf_dir, "embeddings"), cosine=0.93)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``, learnt from labelled rows that are not held out; null texts count as empty, a null id is not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.fitted(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = quality.with_score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, decoded text and three sampled segmentations of each of ``documents``; nulls, repeats and empty tables as ``sp_codec.encode_rows`` has them."""
    import public_tokenizers

    rows = sp_codec.encode_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], k=3)
    return rows


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation of ``conversations``, damaged by rule and repaired; nulls, repeats and empty tables as ``conversation_repair.repair`` has them."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations"))).report


#: DuckDB has no crc32: the table of its 256 remainders by rule, and a fold over the bytes of a text (Latin letters, digits and signs: one or two bytes each).
CRC = """
remainders AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
"""
CRC_OF = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)]::BIGINT[] END))), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])))"""

OP11_SQL = (
    "WITH RECURSIVE"
    + CRC
    + r"""
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT plain.*, """
    + CRC_OF.format("k")
    + r""" % 20 AS f FROM plain, remainders),
hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS r, left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS pair, CASE
    WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[^.!? 	-
][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{c: 0::BIGINT, a: '', s: '-'}] AS p FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, list_filter(list_transform(['-', 's', 'u', 'a'], lambda k: list_min(list_filter(q, lambda x: x.s = k))), lambda x: x IS NOT NULL)
  FROM (
    SELECT w.conv_id, j.i, list_concat(
      list_transform(w.p, lambda x: {c: x.c + 2, a: x.a || 'D', s: x.s}),
      flatten(list_transform(CASE WHEN j.fault IN ('', 'truncated') THEN w.p ELSE [] END, lambda x: list_transform(
        list_filter(
          [{k: 's', m: 0, ok: x.s = '-' AND j.r = 's'}, {k: 'u', m: CASE WHEN x.s = 'u' THEN 1 ELSE 0 END, ok: true}, {k: 'a', m: CASE WHEN x.s = 'u' THEN 0 ELSE 1 END, ok: true}],
          lambda y: y.ok),
        lambda y: {c: x.c + 5 * y.m + CASE WHEN y.k = j.r THEN 0 ELSE 1 END + CASE WHEN j.fault = '' THEN 0 ELSE 5 END, a: x.a || repeat('I', y.m) || CASE WHEN y.k = j.r THEN 'K' ELSE 'R' END, s: y.k})))) AS q
    FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1)),
ends AS (
  SELECT w.conv_id, list_min(list_transform(w.p, lambda x: {c: x.c + 5 * CASE x.s WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END, a: x.a || repeat('I', CASE x.s WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END)})) AS best
  FROM walk w LEFT JOIN sums s ON w.conv_id IS NOT DISTINCT FROM s.conv_id WHERE w.i = coalesce(s.n, 0)),
edits AS (SELECT conv_id, unnest(string_split(best.a, '')) AS e, generate_subscripts(string_split(best.a, ''), 1) AS nth FROM ends WHERE best.a <> ''),
rows_of AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth) AS i FROM edits),
left_over AS (
  SELECT o.conv_id, o.e, row_number() OVER (PARTITION BY o.conv_id ORDER BY o.nth) AS k, j.role, CASE WHEN o.e = 'I' THEN '' ELSE j.text END AS text
  FROM rows_of o LEFT JOIN judged j ON o.conv_id IS NOT DISTINCT FROM j.conv_id AND o.i = j.i WHERE o.e <> 'D'),
led AS (SELECT *, first_value(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS led FROM left_over),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS said FROM led GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN lines l ON e.conv_id IS NOT DISTINCT FROM l.conv_id
"""
)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word of the whole ``documents``: its near words, form and root; nulls, repeats and empty tables as ``spelling.vocabulary`` and ``spelling.variants`` have them."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), least=7, least_n=2, every=31), ratio=10, least=7)


OP12_SQL = (
    "WITH RECURSIVE"
    + CRC
    + r"""
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
own AS (SELECT id || ':' || w AS k, w, count(*) AS n FROM found WHERE length(w) >= 7 GROUP BY ALL),
coded AS (SELECT w, n, """
    + CRC_OF.format("k")
    + r""" AS h FROM own, remainders),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM coded GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) t(i)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, b.near AS form, b.near_n AS form_n FROM words w JOIN best b USING (word) WHERE b.near_n >= 10 * w.n),
walk AS (SELECT word, form AS root, 1 AS d FROM forms UNION ALL SELECT w.word, f.form, d + 1 FROM walk w JOIN forms f ON w.root = f.word),
roots AS (SELECT word, arg_max(root, d) AS root FROM walk GROUP BY word)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""
)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``, learnt from labelled rows that are not held out; null texts count as empty, a null id is not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.with_score(docs.select("doc_id", "text"), toxicity.fitted(docs, labels))
    return scored.select("doc_id", F.expr(toxicity.held_out()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict:
    found = (
        op1_url_filters,
        op2_secret_scan,
        op3_exact_dedup,
        op4_packing,
        op5_chat_format,
        op6_substring_dedup,
        op7_simhash,
        op8_embedding_dedup,
        op9_quality,
        op10_sentencepiece,
        op11_conversation_repair,
        op12_spelling,
        op13_toxicity,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op11_conversation_repair": OP11_SQL, "op12_spelling": OP12_SQL}
