"""The corpus operators against brute force, on small tables that hold nulls, ties, repeats, empty and long texts."""

import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from siftline.llm import chat_format, common, embedding_dedup, exact_dedup, packing, quality, queries, secret_scan, simhash, sp_codec, substring_dedup, url_filters

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "src", 0, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [prose(rng, n) for n in (0, 1, 2, 5, 19, 20, 21, 60, 200, 200, 400)]
    shared = prose(rng, 55)
    out = [*base, None, "", " \n\t", base[8], base[8], base[9].upper()]
    out += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(4)]
    words = base[10].split()
    for k in range(6):  # near copies
        w = words[:]
        w[50 * k + 7] = "zz"
        out.append(" ".join(w))
    out += ["a " * 70, "x" * 5000, "é日本 😀 don't\u00a0<|endoftext|>  a \n b", prose(rng, 5000)]
    return out


def empty(df):
    return df.limit(0)


# op1


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    bad = any(x in s for x in ("cheap-pills", "casino", "free-bets", "spam-farm", "ads-track") for s in (host, path))
    return host, path, best and best[0], best[1] if best else "block" if bad else "allow"


def test_url_filters(spark, tmp_path):
    urls = [None, "", "no scheme/x.net/", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/1?q#f", "https://example.com/de/", "http://xexample.com/de/", "x://q.org/fr/://net/", "http://casino.io/a", "a://b.c/x.net/", "http://ÀB.net/é", "http://a/" + "z" * 9000, "http://net/#", "http://spam-farm.example.net/en/", "http://a.net?x/", "h://www.net\n/x"]
    pages = spark.createDataFrame(list(enumerate(urls + urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls + urls)}
    assert url_filters.decide_urls(empty(pages), queries.HOST_RULES, queries.GLOBS).count() == 0


def test_automaton_over_many_words():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    a = url_filters.Automaton([url_filters.Rule(g, "block") for g in globs])
    assert a.words > 3
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(80)]
    got = a.match([np.frombuffer(s.encode(), np.uint8).astype(np.int64) for s in strings])
    want = [[bool(re.fullmatch(g.replace("*", ".*").replace("?", "."), s)) for g in globs] for s in strings]
    assert got.tolist() == want


# op2


def test_secret_scan(spark):
    forest = secret_scan.train(spark)
    key, sha = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e", "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    texts = [f'so token = "{key}" and', f"see commit {sha} of it", None, "", "plain", f'token = "{key.upper()}" api_key: "your_example_token_placeholder"', "q" * 100_000, f'a token = "{key}" b token = "{key}"']
    docs = docs_of(spark, texts)
    rows = secret_scan.scan(docs, forest).collect()
    found = {(r.id, r.start) for r in rows if r.is_secret}
    assert found == {(0, texts[0].index(key)), (5, texts[5].index(key.upper())), (7, texts[7].index(key)), (7, texts[7].rindex(key))}
    assert all(r.candidate_sha256 == hashlib.sha256(texts[r.id][r.start : r.start + r.length].encode()).hexdigest() for r in rows)
    red = {r.doc_id: (r.text, r.n_secrets) for r in secret_scan.redact(docs, forest).collect()}
    assert red[0] == ('so token = "[SECRET]" and', 1) and red[7][0] == 'a token = "[SECRET]" b token = "[SECRET]"' and red[1] == (texts[1], 0) and red[2] == (None, 0) and red[6][0] == texts[6]
    assert secret_scan.redact(docs, forest).columns == [*docs.columns, "n_secrets"]
    assert secret_scan.scan(empty(docs), forest).count() == 0 and secret_scan.redact(empty(docs), forest).count() == 0


def brute_scan(text, path, forest):
    """Candidates, their features and the forest's word, character by character in Python."""
    import regex

    spans = [m.span() for m in regex.finditer(secret_scan.CANDIDATE, text)]
    out = []
    for nth, (a, b) in enumerate(spans):
        c = text[a:b]
        before = text[spans[nth - 1][1] if nth else 0 : a][-secret_scan.CONTEXT :]
        after = text[b : spans[nth + 1][0] if nth + 1 < len(spans) else len(text)][: secret_scan.CONTEXT]
        kind = ["a" if "a" <= x <= "z" else "B" if "A" <= x <= "Z" else "0" if "0" <= x <= "9" else "_" for x in c]
        turns = sum(x != y for x, y in zip(kind, kind[1:]))
        lost = regex.sub("(?i)" + "|".join(sorted(secret_scan.WORDS, key=len, reverse=True)), "", c)
        has = lambda p, s: float(regex.search(p, s) is not None)  # noqa: B023, E731
        benign = max(has(secret_scan.BENIGN_WORDS, before), has(secret_scan.BENIGN_WORDS, after))
        n = len(c)
        x = [n, turns, turns / n, len(set(c)) / n, kind.count("0") / n, kind.count("B") / n, kind.count("_") / n, has("^(?:[0-9a-f]+|[0-9A-F]+)$", c), (n - len(lost)) / n]
        x += [has(secret_scan.TEST_PATHS, path), has(secret_scan.KEY_WORDS, before), benign, has("[\"'`]$", before) * has("^[\"'`]", after), has(r"[=:]\s*[\"'`]?$", before)]
        votes = []
        for tree in forest:
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            votes.append(tree)
        out.append((nth, a, n, round(sum(votes) / len(votes), 6)))
    return out


def test_scan_equals_brute_force(spark, sf):
    forest = secret_scan.train(spark)
    rows = [(c, r.text or "") for c, r in enumerate(common.table(spark, sf, "documents").limit(150).collect())]
    made = [a + c + b for c, a, b, _, _ in secret_scan.labelled_findings(300, seed=5)]
    texts = [t for _, t in rows] + made + ["".join(random.Random(i).choice("ab1=\"' :token\npwd-_/X") for _ in range(300)) for i in range(80)]
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "tests/a").otherwise(F.lit("src")))
    got = collections.defaultdict(list)
    for r in secret_scan.scan(docs, forest).orderBy("id", "nth").collect():
        got[r.id].append((r.nth, r.start, r.length, round(r.probability, 6)))
        assert r.is_secret == (r.probability >= 0.5)
    want = {i: found for i, t in enumerate(texts) if (found := brute_scan(t, "src" if i % 3 else "tests/a", forest))}
    assert got.keys() == want.keys() and sum(map(len, want.values())) > 300
    for i, found in want.items():
        assert all(g[:3] == w[:3] and abs(g[3] - w[3]) < 2e-6 for g, w in zip(got[i], found, strict=True)), texts[i]


def test_forest_on_held_out_findings(spark):
    forest = secret_scan.train(spark)
    rows = secret_scan.labelled_findings(600, seed=99)
    docs = docs_of(spark, [a + c + b for c, a, b, _, _ in rows])
    got = {}
    for r in secret_scan.scan(docs.withColumn("source", F.lit("src0")), forest).collect():
        got[r.id] = got.get(r.id, False) or r.is_secret
    hits = sum(got.get(i, False) and bool(y) for i, (*_, y) in enumerate(rows))
    recall, precision = hits / sum(y for *_, y in rows), hits / sum(got.values())
    assert recall > 0.95 and precision > 0.95, (recall, precision)


def test_secrets_of_documents_are_found_and_prose_is_left(spark, sf):
    """The documents hold keys of 40 hex digits behind ``token = "``; every other candidate in them is a long word."""
    docs = common.table(spark, sf.replace("0.001", "0.1"), "documents")
    texts = {r.doc_id: r.text for r in docs.where("text is not null").select("doc_id", "text").collect()}
    planted = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"|TOKEN = "([0-9A-F]{40})"', t) if m[1]}
    planted |= {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'TOKEN = "([0-9A-F]{40})"', t)}
    found = {(r.id, r.start) for r in secret_scan.scan(docs, secret_scan.train(spark)).where("is_secret").collect()}
    assert len(planted) > 100 and found == planted  # recall and precision of 1


def test_redact_keeps_one_column_of_a_name(spark):
    docs = docs_of(spark, ['pwd = "Tr0ub4dor&3x"', "password: required", None]).withColumn("n_secrets", F.lit("old"))
    out = secret_scan.redact(docs, secret_scan.train(spark))
    assert out.columns == docs.columns
    assert [(r.text, r.n_secrets) for r in out.orderBy("doc_id").collect()] == [('pwd = "[SECRET]"', 1), ("password: required", 0), (None, 0)]


# op3


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, texts, keep):
    docs = docs_of(spark, texts)
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, keep=keep).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    pick = min if keep == "smallest" else max
    assert got == {i: (pick(g), len(g), i == pick(g)) for g in groups.values() for i in g}
    left = exact_dedup.drop_copies(docs, keep=keep)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {pick(g) for g in groups.values()}
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


def poor(text):
    """A digest that many texts share."""
    return F.substring(text, 1, 1).cast("binary")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, poor])
def test_exact_dedup_of_odd_ids(spark, keep, digest):
    """Repeated and null ids, rows that are equal, and digests that collide."""
    rows = [(1, "a b c"), (2, "a b c"), (2, "unique text here"), (None, "a b c"), (None, None), (None, ""), (7, "twice"), (7, "twice"), (8, "a"), (9, "a b"), (None, "alone"), (3, "abc")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, key long").repartition(3)
    pick = min if keep == "smallest" else max
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    best = {t: pick((i for i in g if i is not None), default=None) for t, g in ids.items()}
    got = collections.Counter((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, keep=keep, digest=digest).collect())
    assert got == collections.Counter((i, best[t or ""], len(ids[t or ""]), i == best[t or ""]) for i, t in rows)
    left = exact_dedup.drop_copies(docs, keep=keep, digest=digest)
    assert left.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text or "") for r in left.collect()) == collections.Counter((best[t], t) for t in ids)
    assert exact_dedup.drop_copies(empty(docs), digest=digest).count() == 0


def test_digest_index(spark):
    index = exact_dedup.DigestIndex(spark)
    mk = lambda *r: spark.createDataFrame([(i, bytes([d])) for i, d in r], "id long, digest binary").repartition(3)
    index.flush(mk((5, 1), (3, 1), (9, 2)))
    assert index.flush(mk((1, 2), (7, 3))).count() == 2 and len(index.levels[0]) > exact_dedup.DigestIndex.TIER
    assert {(bytes(r.digest), r.smallest, r.largest, r.n) for r in index.compact().collect()} == {(b"\1", 3, 5, 2), (b"\2", 1, 9, 2), (b"\3", 7, 7, 1)}
    assert len(index.levels) > 2 and len(index.levels[-1]) == 1  # merged tier by tier
    assert [(r.smallest, r.largest) for r in index.lookup(b"\2").collect()] == [(1, 9)]
    assert exact_dedup.DigestIndex(spark).compact().count() == 0
    rows = spark.range(2000).select(F.col("id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    some = rows.where("id % 50 = 0").select("digest")
    passed = {r.id for r in exact_dedup.maybe_hit(rows, some).collect()}
    assert set(range(0, 2000, 50)) <= passed and len(passed) < 60
    assert exact_dedup.maybe_hit(rows, some.limit(0)).count() == 0


# op4


def test_packing(spark, texts):
    docs = docs_of(spark, texts + texts[:5])
    path = queries.tokenizer_path()
    rows = packing.pack(docs.repartition(2), path, window=256, shard_docs=9).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    assert 50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids and any("<|endoftext|>" in (t or "") for t in texts)
    for i, t in enumerate(texts + texts[:5]):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in rows[rows.id == i].sort_values("start").itertuples():
            piece = ids[r.start : r.start + r.length]
            assert (r.start, r.length, r.ids_crc32, r.doc_tokens) == (at, len(piece), zlib.crc32(piece.tobytes()), len(ids))
            at += r.length
        assert at == len(ids)
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == np.concatenate(([0], seq.length.cumsum()[:-1])).tolist()
        total = int(seq.length.sum())
        assert total == 256 or total & (total - 1) == 0
    assert packing.pack(empty(docs), path).count() == 0
    big = spark.createDataFrame([((1 << 60) + 1, "a"), (None, "b"), (None, None), (3, "c"), (3, "c")], "doc_id long, text string").withColumn("id", F.lit(0)).coalesce(1)
    assert {r.id for r in packing.pack(big, path).collect()} == {(1 << 60) + 1, None, 3}


def test_encoder_equals_the_library():
    """For every code point between other characters, all kinds of white space, and random bytes that are text."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    ranks = packing.merge_ranks(path)
    assert ranks is not None
    encode, tok = packing.Encoder(path, ranks), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(6)
    some = [*points[:0x3100], *rng.sample(points, 40_000)]
    odd = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2003\u2028\u202f\u3000\ufeff'sé1٣日😀"]
    texts = [f"{x}{c}{c} {c}y" for c in some for x in "a1 "][::3] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(some[i : i + 500]) for i in range(0, len(some), 500)] + ["<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext|", ""]
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == want.ids, text


def test_unproven_files_go_to_the_library(tmp_path):
    path = queries.tokenizer_path()
    held = json.load(open(path, encoding="utf-8"))
    held["model"]["merges"][300:302] = held["model"]["merges"][301:299:-1]  # the order of merges is not that of ids any more
    other = str(tmp_path / "other.json")
    json.dump(held, open(other, "w", encoding="utf-8"))
    assert packing.merge_ranks(other) is None
    assert packing.Encoder(other)("hello <|endoftext|>").tolist()[-1] == 50256


def test_bm25_prefers_shared_rare_terms():
    docs = [np.array(x, "<u4") for x in ([1, 2, 3, 9], [1, 2, 3, 9, 9], [1, 50, 51], [1, 60, 61], [1, 70, 71])]
    s = packing.Bm25(docs).scores(0)
    assert s[1] > 0 and s[2] == 0 and s[1] == max(s[1:])
    n, df, k1, b = 5, 2, 1.2, 0.75
    length = np.array([len(d) for d in docs])
    idf = np.log((n - df + 0.5) / (df + 0.5))
    want = sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * 5 / length.mean())) for tf in (1, 1, 2))
    assert abs(s[1] - want) < 1e-9


def test_packing_retrieves_from_the_whole_corpus(spark):
    rng = random.Random(14)
    texts = [prose(rng, 40) for _ in range(300)]
    docs = docs_of(spark, texts + texts).repartition(1).sortWithinPartitions("doc_id")  # a copy is 300 rows from its original
    rows = packing.pack(docs, queries.tokenizer_path(), window=512, shard_docs=32).toPandas()
    where = rows.groupby("id")["sequence_id"].agg(set)
    near = sum(any(abs(x - y) <= 1 for x in where[i] for y in where[i + 300]) for i in range(300))
    assert near >= 270, near


def test_salts_bound_what_a_term_brings_to_a_task():
    corpus = packing.Corpus(1000, 10.0, np.array([1, 5, 7, 8]), np.array([1000, 600, 40, 1]))
    assert corpus.rarest(np.array([8, 7, 5, 1, 7], "<u4")) == (7, 5) and corpus.rarest(np.array([1], "<u4")) == (1, -1)
    assert corpus.salt(7, 5, 3, 128) == 0 and len({corpus.salt(5, 7, i, 128) for i in range(600)}) == 1
    copies = collections.Counter(corpus.salt(5, 1, i, 128) for i in range(600))
    assert len(copies) == 5 and max(copies.values()) < 200 and len({corpus.salt(1, -1, i, 128) for i in range(1000)}) == 8


def test_statistics_are_those_of_the_corpus(spark):
    texts = ["one two", "one three", "one four five", None]
    tokens = common.written(packing.encoded(docs_of(spark, texts).repartition(3).selectExpr("cast(doc_id as string) as id", "text"), queries.tokenizer_path(), 1), "test")
    corpus, encode = packing.statistics(tokens), packing.Encoder(queries.tokenizer_path())
    sets = [{1, *encode(t).tolist()} for t in texts]
    assert dict(zip(corpus.terms.tolist(), corpus.counts.tolist())) == collections.Counter(x for s in sets for x in s)
    assert (corpus.n, corpus.mean) == (4, sum(len(encode(t)) + 1 for t in texts) / 4)
    some = [np.array([*encode(t), 1], "<u4") for t in texts[:2]]  # a shard of two
    index = packing.Bm25(some, corpus=corpus)
    df = corpus.df(index.vocab)
    assert np.allclose(index.idf, np.log((4 - df + 0.5) / (df + 0.5)))


# op5


P = chat_format.Param


def test_tool_calls(spark):
    call = lambda i, name, args: f'<tool_call>{json.dumps({"id": i, "name": name, "arguments": args})}</tool_call>'
    result = lambda i, c: f'<tool_result>{json.dumps({"id": i, "content": c})}</tool_result>'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "do " + call("b", "add", {"y": 2, "x": {"$ref": "c"}}) + call("a", "add", {"x": 1, "y": "no"})), (1, 2, "tool", result("a", "3") + result("zz", "?")),
        (1, 3, "assistant", call("c", "none", {"$ref": "a"}) + "<tool_call>{bad</tool_call>"), (2, 0, "assistant", call("p", "add", {"x": 1, "y": {"$ref": "q"}}) + call("q", "add", {"x": 1, "y": {"$ref": "p"}})),
        (3, 0, "user", None), (3, 1, "assistant", 'say "é"\n'), (None, 0, "user", "lost"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    schemas = {"add": {"x": P("integer", True), "y": P("number", True)}, **queries.CHAT_SCHEMAS}
    got = {(r.conv_id, r.call_id): r for r in chat_format.link(*chat_format.parse_messages(m), schemas).collect()}
    assert (got[1, "a"].status, got[1, "a"].problems, got[1, "a"].level) == ("linked", "y is not number", 0)
    assert got[1, "a"].json == '{"arguments":{"x":1,"y":"no"},"id":"a","name":"add","result":"3"}'
    assert got[1, "b"].level == 2 and got[1, "c"].level == 1 and got[1, "c"].problems == "unknown tool" and got[1, "b"].problems == "x is not integer"
    assert got[1, "b"].json.startswith('{"arguments":{"x":{"$ref":"c"},"y":2},')
    assert got[1, "zz"].status == "orphan_result" and got[2, "p"].level is None and got[2, "q"].level is None
    assert got[1, None].problems.startswith("arguments are not JSON") and got[1, None].status == "no_result"
    assert got[3, "0"].json == '{"arguments":{"role":"user","text":""},"id":"0","name":"reply","result":"say \\"é\\"\\n"}' and got[3, "0"].valid
    assert got[None, "0"].status == "no_result"
    assert chat_format.link(*chat_format.parse_messages(empty(m)), schemas).count() == 0


def test_many_calls_in_one_turn(spark):
    """Places of a turn do not run into those of the next; repeated, null and very long ones are rows like any other."""
    call = lambda i, args: f'<tool_call>{json.dumps({"id": i, "name": "add", "arguments": args})}</tool_call>'
    result = lambda i, c: f'<tool_result>{json.dumps({"id": i, "content": c})}</tool_result>'
    many = "".join(call(f"c{i}", {"x": i}) for i in range(2000))
    rows = [(1, 0, "assistant", many), (1, 1, "tool", "".join(result(f"c{i}", "ok") for i in range(2000))), (2, 5, "assistant", call("a", {"x": "y" * 200_000})), (2, 5, "assistant", call("a", {"x": "y" * 200_000})), (2, 6, "tool", result("a", "1")), (2, 6, "tool", result("a", "1")), (3, None, "assistant", call("n", {})), (3, 0, "tool", result("n", "0")), (4, 1, "assistant", call("n", {})), (4, None, "tool", result("n", "0"))]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"nth": F.lit(9), "level": F.lit("clash")})
    got = chat_format.link(*chat_format.parse_messages(m), {"add": {"x": P("integer")}}).collect()
    first = {r.call_id: r for r in got if r.conv_id == 1}
    assert len(first) == 2000 and all((r.status, r.turn, r.nth, r.valid) == ("linked", 0, int(i[1:]), True) for i, r in first.items())
    assert [(r.status, r.problems, len(r.json) > 200_000) for r in got if r.conv_id == 2] == [("linked", "x is not integer", True)] * 2
    assert [(r.status, r.turn) for r in got if r.conv_id == 3] == [("linked", None)] and [r.status for r in got if r.conv_id == 4] == ["early_result"]


def test_schemas(spark):
    schema = {"t": {"n": P("number"), "e": P("string", values=('"a"', '"b"')), "l": P("array", items="integer"), "o": P("object", True, fields={"k": P("boolean", True), "p": P("object", fields={"q": P("string", True)})})}}
    cases = {
        '{"o": {"k": true}}': "", '{"n": 1.5, "e": "a", "l": [1, 2], "o": {"k": false, "p": {"q": "x"}}}': "", '{"o": {"k": 1}, "e": "c", "l": [1, "x"]}': "e is none of its values; l holds what is not integer; o.k is not boolean",
        '{"o": {"p": {}}, "z": 1, "b": 2}': "missing o.k; missing o.p.q; unknown argument b; unknown argument z", '{"n": "1", "e": 5, "l": {}, "o": []}': "n is not number; e is not string; l is not array; o is not object",
        "[1]": "arguments are not an object; missing o", '{"n": null, "o": null}': "missing o", "": "arguments are not JSON", None: "arguments are not JSON", "{": "arguments are not JSON",
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a string")
    got = {r.a: r.p for r in rows.select("a", F.array_join(chat_format.violations(F.lit("t"), F.col("a"), schema), "; ").alias("p")).collect()}
    assert got == cases


def test_query_of_tool_calls_meets_every_case(spark, sf):
    rows = queries.op5_chat_format(spark, sf.replace("0.001", "0.01")).collect()
    assert {r.status for r in rows} == {"linked", "no_result", "early_result", "orphan_result"} and {r.name for r in rows} == {"reply", "search", "compare", "erase", None}
    assert {-1, 0, 1, 2} <= {r.level for r in rows} and {r.nth for r in rows} == {0, 1}
    assert {p for r in rows for p in r.problems.split("; ")} >= {"", "arguments are not JSON", "unknown tool", "limit is not integer", "missing query", "scope is none of its values", "unknown argument debug", "weights holds what is not number"}


# op6


def brute_cut(texts, window=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in seen:
                gone[j : j + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window,gram", [(20, 10), (5, 5), (4, 1)])
def test_substring_dedup(spark, texts, window, gram):
    docs = docs_of(spark, texts)
    rows = substring_dedup.cut_repeats(docs, window=window, gram=gram).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute_cut(texts, window)
    for r in rows:
        assert sum(s["length"] for s in r.spans) == r.n_removed
    assert substring_dedup.cut_repeats(empty(docs)).count() == 0


def test_windows_are_told_apart_by_their_words(spark, monkeypatch):
    """Words that collide in polynomial hashes, and fast hashes that collide all the time, must change nothing."""
    parity = lambda i: bin(i).count("1") & 1
    first = "".join("ab"[parity(i)] for i in range(1024))
    other = "".join("ba"[parity(i)] for i in range(1024))
    around = [f"w{i}" for i in range(22)]
    texts = [" ".join([*around[:11], x, *around[11:]]) for x in (first, other, first)]
    texts += [" ".join(f"v{i}" for i in range(40)), " ".join(["u", *(f"v{i}" for i in range(40))])]
    got = lambda: {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut_repeats(docs_of(spark, texts)).collect()}
    assert got() == brute_cut(texts) and got()[1][1] == 0
    monkeypatch.setattr(substring_dedup, "_hash_words", lambda words: np.zeros(len(words), np.uint64))
    batch = substring_dedup._Batch([t.encode() for t in texts], 20, 10)
    assert len(np.unique(batch.grams[batch.ok])) == 1
    found = substring_dedup._digests(batch.words, np.flatnonzero(batch.ok), 20)
    windows = [tuple(batch.words[i : i + 20]) for i in np.flatnonzero(batch.ok)]
    assert len({x.tobytes() for x in found}) == len(set(windows))
    ones = [np.full(substring_dedup.MIN_CELLS // 8, 255, np.uint8)] * 2
    monkeypatch.setattr(substring_dedup, "_sketch", lambda *_: ones)  # every window passes: what a full sketch does
    assert got() == brute_cut(texts)


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, a), (3, b), (5, f"{b} {c}"), (None, a), (None, c), (None, c), (None, "z " + c), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("window", F.lit("clash"))
    got = collections.Counter((r.id, r.n_words, r.n_removed) for r in substring_dedup.cut_repeats(docs).collect())
    assert got == {(5, 30, 0): 2, (3, 30, 0): 1, (5, 60, 30): 1, (None, 30, 30): 3, (None, 31, 30): 1, (7, 0, 0): 1}
    lost = [(None, c), (None, c), (None, "z " + c)]
    left = collections.Counter(r.n_removed for r in substring_dedup.cut_repeats(spark.createDataFrame(lost, "doc_id long, text string")).collect())
    assert left in ({0: 2, 30: 1}, {30: 2, 0: 1})  # one of the two texts is first, and both copies of it are


def test_sketch_never_underestimates(spark, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MIN_CELLS", substring_dedup.SLICE)
    monkeypatch.setattr(substring_dedup, "MAX_CELLS", substring_dedup.SLICE)
    monkeypatch.setattr(substring_dedup, "PIECE", 3000)
    rows = substring_dedup.cut_repeats(docs_of(spark, texts)).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute_cut(texts)


# op7


def brute_fp(t, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORDS.findall(t)
    s = [" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, texts):
    docs = docs_of(spark, texts)
    fps = [brute_fp(t) for t in texts]
    want = components(len(texts), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}
    assert simhash.simhash_components(empty(docs)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_near_links_lose_none(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(12):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
    found = {r.node: r.component for r in common.connected_components(simhash.near_links(nodes, radius)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_bk_tree():
    rng = random.Random(5)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.value[i] for i in tree.near(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_near_duplicate_groups(spark, texts):
    rng = random.Random(8)
    base = [prose(rng, 300) for _ in range(8)]
    more = []
    for b in base:
        for k in range(1, 9):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "new"
            more.append(" ".join(w))
    all_texts = texts + base + more
    shingles = [set(simhash.shingle_hashes(simhash.words(t), 5).tolist()) for t in all_texts]
    alike = lambda a, b: not (a or b) or len(a & b) >= 0.8 * len(a | b)
    want = components(len(all_texts), [(a, b) for a in range(len(all_texts)) for b in range(a) if alike(shingles[a], shingles[b])])
    got = {r.id: r.group_id for r in simhash.near_duplicate_groups(docs_of(spark, all_texts)).collect()}
    mine = [got.get(i, i) for i in range(len(all_texts))]
    assert all(want[i] == want[m] for i, m in enumerate(mine))  # nothing unlike is grouped
    assert sum(a == b for a, b in zip(mine, want)) >= 0.95 * len(want)
    left = simhash.drop_near_copies(docs_of(spark, all_texts))
    assert left.count() == len(set(mine)) and "keep_id" in left.columns
    assert simhash.drop_near_copies(empty(docs_of(spark, texts))).count() == 0


def test_near_copies_of_odd_ids(spark):
    w = [f"w{i}" for i in range(60)]
    near = " ".join([*w[:58], "x", "y"])
    rows = [(1, " ".join(w)), (2, near), (2, "text of its own, which nobody else has here"), (None, near), (None, "another text of its own without an id"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect())
    assert got == collections.Counter([rows[0], rows[2], rows[4], rows[6]])


def test_bitmaps_rule_out_no_pair(spark):
    """At every size, sets of the similarity and above must pass, and folding must give the smaller bitmap."""
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 900, 5000, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: int(0.89 * n) + 1], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64) * np.uint64(2))))
        near = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        for bits in (1024, 4096):
            x, y = simhash._bitmap(a, bits), simhash._bitmap(b, bits)
            assert near and simhash._may(simhash._bitmaps([x], bits // 8), simhash._bitmaps([y], bits // 8), np.array([len(a)]), np.array([len(b)]), 0.8).all()
            assert simhash._folded(simhash._bitmap(a, 4 * bits), bits // 8) == x
    far = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)) for _ in range(2)]
    x, y = (simhash._bitmaps([simhash._bitmap(v, 1024)], 128) for v in far)
    assert not simhash._may(x, y, np.array([400]), np.array([400]), 0.8).any()


def template_pages(rng, pages, planted):
    """Pages of one source: 60 words of their own between two halves of a template; and near copies of the first ``planted``."""
    top, end = prose(rng, 110), prose(rng, 110)
    own = [prose(rng, 60).split() for _ in range(pages)]
    page = lambda w: f"{top} {' '.join(w)} {end}"
    return [page(w) for w in own] + [page(w[:29] + ["new"] + w[30:]) for w in own[:planted]]


def test_near_copies_in_a_crowd_are_all_found(spark):
    pages, planted = 3000, 200
    docs = docs_of(spark, template_pages(random.Random(11), pages, planted))
    got = {r.id: r.group_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {i: i % pages for i in (*range(planted), *range(pages, pages + planted))}


def test_no_pair_at_the_threshold_is_lost(spark):
    rng = random.Random(12)
    texts, want = [], {}
    while len(want) < 2 * 400:
        n = rng.choice([30, 100, 300])
        w = prose(rng, n).split()
        v = w[:]
        for i in rng.sample(range(n), max(1, n // 48)):
            v[i] = "new"
        x, y = (set(simhash.shingle_hashes(u, 5).tolist()) for u in ([c.encode() for c in w], [c.encode() for c in v]))
        if 0.8 <= len(x & y) / len(x | y) < 0.87:
            want |= {len(texts): len(texts), len(texts) + 1: len(texts)}
            texts += [" ".join(w), " ".join(v)]
    got = {r.id: r.group_id for r in simhash.near_duplicate_groups(docs_of(spark, texts)).collect()}
    assert got == want


def test_near_stage_takes_links_of_the_trees(spark, monkeypatch):
    """With no comparison after the first one, pairs within two bits are found by the BK-trees alone; what these link and is not alike stays."""
    import corpus_pipeline as cp

    asked, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *how: asked.append(links(*how)) or asked[-1])
    monkeypatch.setattr(simhash, "rest_pairs", lambda *_: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(14)
    texts = [prose(rng, 400) for _ in range(20)]
    texts += [t + " new" for t in texts]
    spam = "one two three " * 400  # rules the fingerprint, and is three shingles of the set
    texts += [spam + prose(rng, 30), spam + prose(rng, 30)]
    bits = [simhash.fingerprint(t) for t in texts]
    close = {(i, i + 20) for i in range(20) if 0 < (bits[i] ^ bits[i + 20]).bit_count() <= 2}
    assert len(close) > 5 and (bits[40] ^ bits[41]).bit_count() <= 2
    left = {r.doc_id for r in cp.near_stage(spark, docs_of(spark, texts), "").collect()}
    assert len(asked) == 1 and close <= {(r.src, r.dst) for r in asked[0].collect()}
    assert left == {*range(20), 40, 41}


def test_components(spark):
    mk = lambda e: spark.createDataFrame(e, "src long, dst long")
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in common.connected_components(mk(path + star + [(7, 7), (131, None), (130, 100)])).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(31)}}
    assert common.connected_components(mk([])).count() == 0


def test_components_take_few_steps(spark, monkeypatch):
    steps, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: steps.append(1) or cut(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(1000 + i, 2000) for i in range(50)], "src long, dst long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(50)}, 2000: 1000}
    assert len(steps) <= 12  # 15 where pointers were followed by doubling


# op8


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, label = [], []
    for c in range(12):
        v = rng.normal(size=24)
        for s in (0, 0.02, 0.05, 0.08, 0.1, 0.2):
            rows.append((v + s * rng.normal(size=24)).tolist())
            label.append(c % 3)
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], rows[1][:12], [0.0] * 24, None, [float("nan")] + rows[0][1:], [None] + rows[0][1:], [float("inf")] * 24, rows[5], rows[5]]
    label += [0] * 9 + [None, 1]
    df = spark.createDataFrame([(i, v, y, 0) for i, (v, y) in enumerate(zip(rows, label))], "vec_id long, embedding array<double>, label int, n int")

    def linked(a, b):
        ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if label[a] is None or label[a] != label[b] or not ok(rows[a]) or not ok(rows[b]) or len(rows[a]) != len(rows[b]):
            return False
        x, y = np.array(rows[a]), np.array(rows[b])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if linked(a, b)]
    want, n = components(len(rows), pairs), collections.Counter(x for p in pairs for x in p)
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.vector_components(df).collect()}
    found = sum(got[i][0] for i in got)
    assert all(got[i][0] <= n[i] for i in got) and found >= 0.9 * sum(n.values())
    if found == sum(n.values()):
        assert {i: g[1] for i, g in got.items()} == dict(enumerate(want))
    assert embedding_dedup.vector_components(empty(df)).count() == 0


def test_recall_on_given_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([base + 0.3 * rng.normal(size=base.shape) for _ in range(4)])
    v = np.concatenate([base, near])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = (u @ u.T >= 0.93).sum() - len(v)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.vector_components(df).agg(F.sum("n_links")).first()[0]
    assert true > 100 and got >= 0.9 * true, (got, true)


def test_hadamard():
    x = np.eye(8)
    h = embedding_dedup.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 1 / np.sqrt(8))


# op9


def test_quality(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    good, bad = "The report of the year was read and kept. " * 5, "BUY!! NOW!! CHEAP!! " * 20
    rows = [(10_000 + i, (good if i % 4 else bad) + str(i)) for i in range(400)]
    train = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(i, int(bool(n % 4))) for n, (i, _) in enumerate(rows)], "doc_id long, quality int"))
    texts, y = quality.training_sample(train, marks, max_rows=500, max_bytes=10_000_000)
    assert len(texts) == len(y) <= 500
    ids = {t for i, t in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not ids & set(texts)
    net = quality.fit(texts, y, epochs=4)
    held = [(t, n) for n, (i, t) in enumerate(rows) if zlib.crc32(str(i).encode()) % 3 == 1]
    s = quality.scores(net, [t for t, _ in held])
    assert np.mean((s >= 0.5) == [bool(n % 4) for _, n in held]) > 0.95
    odd = docs_of(spark, [None, "", "é" * 50_000, good])
    out = quality.with_score(odd, net)
    assert out.columns == [*odd.columns, "score"] and all(0 <= r.score <= 1 for r in out.collect())
    assert out.where("doc_id < 2").select("score").distinct().count() == 1
    assert quality.with_score(empty(odd), net).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    net = quality.fit(["good " * 40, "BAD!! " * 40] * 20, [1, 0] * 20, epochs=3)
    texts = ["good " * n + "BAD!! " * 30 + "good " * m for n, m in ((0, 900), (450, 450), (900, 0), (5, 3))] + ["good " * 900, ""]
    whole = quality.scores(net, texts)
    monkeypatch.setattr(quality, "SEGMENT", 512)
    assert np.allclose(quality.scores(net, texts), whole, atol=0.02)
    one = np.array([quality.scores(net, [t])[0] for t in texts])
    assert np.allclose(one, whole, atol=0.02)


# op10


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return sp_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))


def all_segmentations(codec, text):
    """Every way to cut the text into pieces, with its log-probability."""
    line = sp_codec.SPACE + text.replace(" ", sp_codec.SPACE)

    def walk(i):
        if i == len(line):
            yield (), 0.0
            return
        steps = [((codec.piece[line[i:j]],), j) for j in range(i + 1, len(line) + 1) if line[i:j] in codec.piece]
        if not any(j == i + 1 for _, j in steps):
            steps.append((tuple(codec.byte[b] for b in line[i].encode()), i + 1))
        for ids, j in steps:
            for rest, q in walk(j):
                yield (*ids, *rest), sum(codec.weight[x] for x in ids) + q

    found = dict(walk(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: float(q - total) for ids, q in found.items()}


def test_sampling_follows_the_lattice(codec):
    table = all_segmentations(codec, "other é\n")
    first, second, n = collections.Counter(), collections.Counter(), 4000
    words = codec.words(["other é\n"] * n)
    for got, _ in codec.sample_all(words, 2, list(range(n))):
        one, two = (tuple(codec.ids_of(e).tolist()) for e, _, _ in got)
        first[one] += 1
        second[two] += 1
    for ids, p in table.items():
        q = np.exp(p)
        assert abs(first[ids] / n - q) < 4 * np.sqrt(q * (1 - q) / n) + 1e-3
        q = sum(np.exp(p + o) / (1 - np.exp(o)) for i, o in table.items() if i != ids)  # second: without replacement
        assert abs(second[ids] / n - q) < 4 * np.sqrt(q * (1 - q) / n) + 1e-3
    got, rest = codec.sample("other é\n", 10_000, 1)
    assert {tuple(i) for i, _, _ in got} == set(table) and len(got) == len(table) and rest == -np.inf
    assert all(abs(table[tuple(i)] - p) < 1e-9 for i, p, _ in got)
    values = [v for _, _, v in got]
    assert values == sorted(values, reverse=True)


def test_inclusion_weights_are_unbiased(codec):
    table = all_segmentations(codec, "there")
    total = []
    for got, threshold in codec.sample_all(codec.words(["there"] * 1500), 3, list(range(1500))):
        total.append(sum(np.exp(p) / sp_codec.inclusion(p, threshold) for _, p, _ in got))
    assert len(table) > 4 and abs(np.mean(total) - 1) < 0.05


def test_samples_do_not_depend_on_neighbours(codec, texts):
    some = [t or "" for t in texts]
    seeds = list(range(len(some)))
    flat = lambda got: [([(codec.ids_of(e).tolist(), p, v) for e, p, v in found], limit) for found, limit in got]
    together = flat(codec.sample_all(codec.words(some), 3, seeds))
    codec.forget()
    for t, seed, want in list(zip(some, seeds, together))[::-1]:
        assert flat(codec.sample_all(codec.words([t]), 3, [seed])) == [want]


def test_words_with_one_hash_are_told_apart(codec, monkeypatch):
    text = "some words of one length: abcd efgh, abcd"
    want = codec.sp.encode(text)
    codec.forget()
    monkeypatch.setattr(sp_codec, "_mixed", lambda h: np.zeros_like(h))
    for _ in range(2):
        (words,) = codec.words([text])
        assert codec.own_of(words)[0].tolist() == want
    codec.forget()


def test_own_ids_and_decoder_equal_the_library(codec, texts):
    rng = random.Random(15)
    odd = " \n\t'.,-é日😀aBz0\u00a0\x00<>/_"
    some = [t or "" for t in texts] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for t, w in zip(some, codec.words(some)):
        ids = codec.own_of(w)[0].tolist()
        assert ids == codec.sp.encode(t) and codec.decode(ids) == codec.sp.decode(ids), t
    for _ in range(500):  # ids that no text gives
        ids = [rng.randrange(codec.sp.get_piece_size()) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == codec.sp.decode(ids), ids


def test_round_trip(spark, texts, codec):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs_of(spark, texts[:-1])
    out = sp_codec.encode_rows(rows, model, ["doc_id"], k=3)
    again = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts[:-1]):
        r = again[i]
        assert r.decoded == codec.sp.decode(codec.sp.encode(t or ""))
        ids = [tuple(s["ids"]) for s in r.samples]
        assert len(ids) == len(set(ids)) >= 1 and all(0 < s["inclusion"] <= 1 for s in r.samples)
        assert all(codec.sp.decode(list(x)) == (t or "") for x in ids)
    assert [r.samples for r in out.orderBy("doc_id").collect()] == [again[i].samples for i in sorted(again)]
    back = sp_codec.decode_rows(out.select("doc_id", "ids"), model)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: r.decoded for i, r in again.items()}
    assert sp_codec.encode_rows(empty(rows), model, ["doc_id"]).count() == 0


def test_sentencepiece_query_has_every_document(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = queries.op10_sentencepiece(spark, sf)
    assert out.columns == ["doc_id", "ids", "decoded", "samples"]
    got = out.select("doc_id", F.size("ids").alias("n"), F.size("samples").alias("k"))
    wrong = docs.join(got, "doc_id", "full").where("n is null or (length(trim(text)) > 0 and (n = 0 or k = 0))")
    assert wrong.count() == 0


# The registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    # Rows as they are: pandas would turn whole numbers beside nulls into floats on one side only.
    norm = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert sorted(got.columns) == sorted(want.columns) and norm(got.columns, got.collect()) == norm(want.columns, want.fetchall())


def test_pipeline(spark, sf):
    """Every stage against a brute-force version of its own input."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    docs = common.table(spark, sf, "documents").withColumn("extra", F.lit(1))
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    for name, stage in cp.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        texts = {i: r.text or "" for i, r in given.items()}
        out = common.written(stage(spark, docs, sf), "test")
        got = out.collect()
        if name == "packing":
            tok = Tokenizer.from_file(queries.tokenizer_path())
            ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
            whole = collections.defaultdict(list)
            for r in got:
                assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
                whole[r.doc_id].append((r.start, r.length))
            for i, x in ids.items():
                pieces = sorted(whole[i])
                assert [a for a, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()] and sum(n for _, n in pieces) == len(x)
            break
        assert out.columns == docs.columns
        if name == "quality":
            net = quality.fitted(docs, common.table(spark, sf, "labels"))
            order = sorted(texts)
            want = {i for i, p in zip(order, quality.scores(net, [texts[i] for i in order])) if p >= 0.5}
        elif name == "exact_dedup":
            want = {min(i for i in texts if texts[i] == t) for t in texts.values()}
        elif name == "near_dedup":
            order = sorted(texts)
            sets = [set(simhash.shingle_hashes(simhash.words(texts[i]), 5).tolist()) for i in order]
            alike = [(a, b) for a in range(len(order)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            want = {order[x] for x in components(len(order), alike)}
        else:
            forest, want = secret_scan.train(spark), set(texts)
            for r in got:
                t, done = texts[r.doc_id], 0
                for _, at, n, p in brute_scan(t, given[r.doc_id].source, forest):
                    if p >= 0.5:
                        t, done = t[: at + done] + "[SECRET]" + t[at + done + n :], done + len("[SECRET]") - n
                assert (r.text or "") == t and (r.n_chars == len(t) if t != texts[r.doc_id] else r.n_chars == given[r.doc_id].n_chars)
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(want) and want
        if name != "secrets":
            assert all(r == given[r.doc_id] for r in got)
        docs = out
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, empty(docs), sf).count() == 0, name


def test_quality_holds_few_texts_at_once(monkeypatch):
    """Texts are scored in small batches, whatever comes in an Arrow batch; a longer one alone; the scores are those of each text by itself."""
    net = quality.fit(["good words here " * 9, "x x x x x x x x x x"], [1, 0], epochs=2)
    texts = [None, "", "a long text " * 30_000, *[f"text {i} " * (i % 300) for i in range(900)], "b" * 200_000, "é" * 70]
    held, whole = [], quality.pooled
    monkeypatch.setattr(quality, "pooled", lambda n, datas: held.append([len(d) for d in datas]) or whole(n, datas))
    got = quality.scores(net, texts)
    assert sum(map(len, held)) == len(texts)
    assert all(len(x) == 1 or sum(x) <= quality.BATCH for x in held) and quality.BATCH <= 1 << 17
    assert np.allclose(got, [quality.scores(net, [t])[0] for t in texts], atol=1e-5)
