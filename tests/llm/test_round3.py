"""Toxicity, conversation repair and spelling variants against brute force and held-out labels."""

import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F
from siftline.llm import chat_format, common, conversation_repair, embedding_dedup, quality, queries, spelling, toxicity


def brute_words(text):
    out, word = [], b""
    for b in (text or "").lower().encode() + b" ":
        if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128:
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return out


def brute_places(text):
    """Features of a text, one by one, as the module describes them."""
    odd, top = [int(x) for x in toxicity.ODD], 1 << 64
    h = [zlib.crc32(w) for w in brute_words(text)]
    kinds = [x * odd[0] for x in h]
    for gap in (1, 2, 3):
        kinds += [((((a + gap) * odd[1]) % top) ^ ((b * odd[0]) % top)) * odd[2] for a, b in zip(h, h[gap:])]
    kinds += [(((((a * odd[0]) % top) ^ ((b * odd[1]) % top)) * odd[2] % top) ^ ((c * odd[0]) % top)) * odd[1] for a, b, c in zip(h, h[1:], h[2:])]
    out = set()
    for k in kinds:
        k %= top
        k ^= k >> 29
        out.add(((k * odd[2]) % top) >> (64 - toxicity.BITS))
    return out


def brute_fit(texts, labels, epochs, alpha, beta, l1, l2, seed):
    z, n, c = {}, {}, [0.0, 0.0]

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at = brute_places(texts[i])
            w = {p: weight(p) for p in at}
            constant = -c[0] * alpha / (beta + math.sqrt(c[1]))
            g = 1 / (1 + math.exp(-(sum(w.values()) + constant))) - labels[i]
            for p in at:
                was = n.get(p, 0.0)
                n[p] = was + g * g
                z[p] = z.get(p, 0.0) + g - (math.sqrt(n[p]) - math.sqrt(was)) / alpha * w[p]
            was = c[1]
            c[1] += g * g
            c[0] += g - (math.sqrt(c[1]) - math.sqrt(was)) / alpha * constant
    return {p: weight(p) for p in z if weight(p)}, -c[0] * alpha / (beta + math.sqrt(c[1]))


TEXTS = ["Nice day, friend", "you SCUM of it", None, "", "scum", "a nice scum-free day", "é day you friend nice", "you of it day"] * 4
MARKS = [0, 1, 0, 0, 1, 1, 0, 0] * 4


def test_features_and_learning_against_brute_force():
    for t in [*TEXTS, "x", "a b", "a a a a a"]:
        assert set(toxicity.features(list(toxicity.parts(t)))[1].tolist()) == brute_places(t)
    how = {"epochs": 3, "alpha": 0.7, "beta": 1.0, "l1": 0.3, "l2": 0.5, "seed": 13}
    got, (want, constant) = toxicity.fit(TEXTS, MARKS, **how), brute_fit(TEXTS, MARKS, **how)
    assert got.places.tolist() == sorted(want) and np.allclose(got.values, [want[p] for p in sorted(want)])
    assert math.isclose(got.constant, constant)
    s = toxicity.scores(got, TEXTS)
    brute = [1 / (1 + math.exp(-(sum(want.get(p, 0) for p in brute_places(t)) + constant))) for t in TEXTS]
    assert np.allclose(s, brute)
    assert ((s >= 0.5) == (np.array(MARKS) == 1)).all()


def test_parts_of_long_texts_lose_and_invent_nothing(monkeypatch):
    texts = ["one two  three, four five six seven eight nine ten " * 3, "x" * 300, "ab " * 100, " " * 200 + "end of it", "", None]
    whole = [brute_places(t) for t in texts]
    monkeypatch.setattr(toxicity, "PART", 16)
    for t, w in zip(texts, whole):
        found = [toxicity.features([p])[1].tolist() for p in toxicity.parts(t)]
        assert set().union(*found) == w
    some = toxicity.Weights(np.array(sorted(whole[0]))[::2], np.ones(len(whole[0]))[::2], -1.0)
    small = toxicity.scores(some, texts)
    monkeypatch.undo()
    assert np.allclose(toxicity.scores(some, texts), small)


def test_toxicity_edges(spark):
    odd = spark.createDataFrame([(None, None, "clash"), (1, "", "c"), (1, "scum " * 5, "c"), (1, "scum " * 5, "c")], "doc_id long, text string, score string")
    weights = toxicity.fit(TEXTS, MARKS, l1=0.3)
    out = toxicity.with_score(odd, weights).toPandas()
    assert list(out.columns) == ["doc_id", "text", "score"] and out.score.between(0, 1).all()
    assert out.score[0] == out.score[1] and out.score[2] == out.score[3] > out.score[0]
    assert toxicity.with_score(odd.limit(0), weights).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blank = toxicity.fitted(odd, none)
    assert toxicity.scores(blank, ["scum", None]).tolist() == [0.5, 0.5]


def test_training_sample_keeps_its_bounds_for_an_id_that_repeats(spark):
    docs = spark.range(20_000).select(F.lit(8).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    marks = spark.createDataFrame([(8, 1, 1), (None, 1, 0), (90, 0, 0), (12, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    for take in (lambda: quality.training_sample(docs, marks, max_rows=10, max_bytes=1000), lambda: common.labelled_sample(docs, marks, "toxic", toxicity.held_out(), 10, 1000)):
        texts, y = take()
        assert len(texts) == len(y) == 1 and y == [1] and texts[0].startswith("text ")
    held = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    many = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    texts, _ = common.labelled_sample(many, held, "toxic", toxicity.held_out(), 1000, 10**6)
    assert sorted(map(int, texts)) == [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(common.labelled_sample(many, held, "toxic", toxicity.held_out(), 7, 10**6)[0]) == 7


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op13_toxicity(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out and toxic in (0, 1)").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit / (out.toxic == 1).sum() > 0.8 and hit / (out.predicted == 1).sum() > 0.9
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


# op11


def brute_edits(rows, costs):
    """Least cost and least audit over all edits, tried one after the other from every state; rows are (role, fault)."""
    best = {}

    def step(state, letter):
        return {"-s": "s", "-u": "u", "su": "u", "ua": "a", "au": "u"}.get(state + letter)

    def of(i, state, inserts):
        if (i, state, inserts) not in best:
            found = [(0, "")] if i == len(rows) and state in "-a" else []
            tries = [(costs.insert, "I", i, r) for r in "ua" if inserts < 3]
            if i < len(rows):
                role, fault = rows[i]
                tries.append((costs.delete, "D", i + 1, None))
                if fault in ("", "truncated"):
                    more = costs.truncated if fault else 0
                    tries += [(more, "K", i + 1, role[:1])] + [(more + costs.rerole, "R", i + 1, r) for r in "ua"]
            for price, letter, to, role in tries:
                after = state if role is None else step(state, role)
                if after:
                    rest = of(to, after, inserts + 1 if letter == "I" else 0)
                    if rest:
                        found.append((rest[0] + price, letter + rest[1]))
            best[i, state, inserts] = min(found, default=None)
        return best[i, state, inserts]

    return of(0, "-", 0)


def brute_repair(rows, costs):
    """Report of one conversation: (turn, role, text) in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub("[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = brute_edits([(r, f) for (_, r, _), f in zip(rows, faults)], costs)
    kept, i = [], 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
        kept.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }, kept


def test_repair_against_all_edits(spark):
    rng = random.Random(11)
    said = ["Yes.", "No!", "cut off", "", " \t", None, "long text. " * 9, "\u00e9?\n", "x\u00a0"]
    conversations = {}
    for c in [None, *range(60)]:
        n = rng.choice([1, 2, 3, 5, 8, 30])
        conversations[c] = [(rng.choice([None, *range(n), n * 3]), rng.choice(["user", "assistant", "system", "tool", None, "", "sys", "User"]), rng.choice(said) if rng.random() < 0.6 else f"turn {rng.random()}.") for _ in range(n)]
    rows = [(c, *r, "clash") for c, rs in conversations.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    for costs, how in ((conversation_repair.Costs(), {}), (conversation_repair.Costs(3, 4, 1, 2), {"block_rows": 3}), (conversation_repair.Costs(1, 1, 1, 1), {"block_chars": 40})):
        got = conversation_repair.repair(df, costs, **how)
        report = {r.conv_id: r.asDict() for r in got.report.collect()}
        turns = {}
        for r in got.turns.orderBy("conv_id", "piece", "place").collect():
            turns.setdefault(r.conv_id, []).append((r.role, r.text))
        assert len(report) == len(conversations)
        for c, rs in conversations.items():
            want, kept = brute_repair(rs, costs)
            assert report[c] == {"conv_id": c} | want
            assert turns.get(c, []) == kept


def test_repair_of_one_conversation_with_most_rows_and_of_none(spark):
    one = spark.range(3000).select(F.lit("c").alias("conv_id"), (F.col("id") % 2500).alias("turn"), F.expr("if(id % 3 = 0, 'user', 'assistant')").alias("role"), F.expr("if(id % 50 = 0, '', if(id < 500, 'same.', 'say ' || id || '.'))").alias("text"))
    costs = conversation_repair.Costs()
    rows = [(r.turn, r.role, r.text) for r in one.collect()]
    many = one.unionByName(spark.range(2000).select(F.lit("d").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text")))
    got = {r.conv_id: r.asDict() for r in conversation_repair.repair(many, costs, block_rows=100).report.collect()}
    assert got["d"]["audit"] == "D" * 2000 and got["d"]["cost"] == 4000 and got["d"]["duplicate"] == got["d"]["illegal"] == 1999
    small = conversation_repair.repair(one, costs, block_rows=10**6).report.collect()[0].asDict()
    assert got["c"] == small and small["gaps"] == 0 and small["blank"] == 60
    runs = [conversation_repair.run_of(t, r, x, 1, False) for t, r, x in sorted(rows, key=lambda r: (r[0], r[1], r[2]))[:60]]
    assert conversation_repair.ended(conversation_repair.best_paths(runs, "-", costs), costs) == brute_edits([(r.role, r.fault) for r in runs], costs)
    none = conversation_repair.repair(one.limit(0), costs)
    assert none.report.count() == none.turns.count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in [None, *range(40)] for r, x in [("assistant", "A. b? c!")]] + [(77, 1, None, None)]
    out = {(r.conv_id, r.turn): r for r in conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        got, role, text = out[c, t], " " if r is None else r, " " if x is None else x
        assert got.copies == {0: 0, 3: 2}.get(fault, 1)
        assert got.role == ("user" if fault == 4 else role) and got.text == {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    lost = spark.createDataFrame([(5, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    report = conversation_repair.repair(conversation_repair.damage(lost)).report.collect()
    assert [tuple(r) for r in report] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# op12


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio):
    by, forms, some = {}, {}, {}
    for w in counts:  # words at distance one share what is left without one of their characters
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by.setdefault(w, set()).add(w)
    for group in by.values():
        for w in group:
            some.setdefault(w, set()).update(x for x in group if near(w, x))
    for w, n in counts.items():
        best = min(some[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(some[w]), counts[forms[w]] if forms[w] else None)
    return out


def words_of(rng, k):
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 9))) for _ in range(k)}
    long = "".join(rng.choice("abcd") for _ in range(230))
    for n in (94, 95, 96, 97, 98, 99, 144, 145, 230):
        for at in (0, 1, 46, 47, 48, 49, 50, n // 2, n - 2, n - 1):
            words |= {long[:n], long[:at] + "x" + long[at + 1 : n], long[:at] + long[at + 1 : n], long[:at] + "y" + long[at:n]}
    return words | {"a" * n for n in range(1, 110)} | {"a" * n + "b" for n in range(1, 20)}


def test_near_words_against_brute_force(spark):
    rng = random.Random(12)
    counts = {w: rng.choice([1, 2, 3, 25, 300, 4000]) for w in words_of(rng, 900)}
    vocab = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, form string")
    for crowd in (4096, 3):  # small shards are split until one position is left
        out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(vocab, ratio=10, crowd=crowd).collect()}
        assert out == brute_variants(counts, 10)
    assert spelling.variants(vocab.limit(0)).count() == 0


def test_pairs_are_found_once(spark):
    rng = random.Random(3)
    words = sorted(words_of(rng, 300))
    df = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "id long, word string, n long")
    for crowd in (4096, 5):
        pairs = [(r.id, r.near) for r in spelling.near_pairs(df, crowd=crowd).collect()]
        assert len(pairs) == len(set(pairs))
        assert all(near(words[a], words[b]) for a, b in pairs)


def test_vocabulary(spark):
    texts = [(1, "Wordless wordless WORDLESS, wordles\u00c9s word-less"), (2, None), (3, ""), (None, "wordless \u00d7\u00f7abcdefg1abcdefg"), (4, "abcdefgh " * 40), (4, "z" * 200_000 + " " + "z" * 200_000), (5, "abcdefgh \U0001f600zuzuzuzu\u0100zuzuzuzu")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, word string")
    for every in (None, 2, 3, 31):
        counts = {}
        for key, text in texts:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for w in re.findall("[A-Za-z\u00C0-\u00FF]+", low):
                h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
                if every and h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) >= 7:
                    counts[w] = counts.get(w, 0) + 1
        got = {r.word: r.n for r in spelling.vocabulary(df, every=every).collect()}
        assert got == {w: n for w, n in counts.items() if n >= 2}
    assert spelling.vocabulary(df.limit(0)).count() == 0


# op8, op9


def planted(rng, n, close, dim=32):
    """Vectors of which ``close`` have a partner at a cosine of 0.93 to 0.99."""
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for i in range(close):
        other = rng.normal(size=dim)
        other -= other @ base[i] * base[i]
        c = rng.uniform(0.94, 0.99)
        base[n - 1 - i] = c * base[i] + math.sqrt(1 - c * c) * other / np.linalg.norm(other)
    return base


def test_an_id_with_two_vectors(spark):
    v, w = [1.0] + [0.0] * 15, [0.0] * 15 + [1.0]
    near_w = [0.0] * 14 + [0.2, 1.0]
    df = spark.createDataFrame([(1, v, 0), (1, w, 0), (2, v, 0), (3, w, 0), (4, near_w, 0), (1, v, 0), (5, near_w, 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embedding_dedup.vector_components(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5)]


def test_recall_at_one_two_and_three_hashes(spark, monkeypatch):
    """The number of hashes a bucket follows the largest label; at each of the first three, recall against brute force is 0.9 or more."""
    rng = np.random.default_rng(8)
    x = planted(rng, 3000, 600)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= 0.93).sum() - len(x)
    for per_bucket, k in ((3000, 1), (16, 2), (0.5, 3)):
        monkeypatch.setattr(embedding_dedup, "PER_BUCKET", per_bucket)
        assert max(1, math.ceil(math.log(max(1, len(x) / per_bucket)) / math.log(64))) == k
        got = embedding_dedup.vector_components(df).agg(F.sum("n_links")).first()[0]
        assert 0.9 * want <= got <= want


def test_forward_pass_of_the_classifier_by_brute_force():
    """Embedding, overlapping chunks, largest responses and the last layer, byte by byte."""
    rng = np.random.default_rng(9)
    net = quality.fit(["good words here " * 9, "BAD!! " * 30] * 10, [1, 0] * 10, epochs=2)
    texts = ["", None, "x", "ab" * 40, "long " * 100, "é\u00a0😀" * 20, "".join(map(chr, rng.integers(32, 127, 333)))]
    for text in texts:
        data = (text or "").encode()
        halves = max(2, math.ceil(len(data) / quality.HALF) + 1)
        symbols = []
        for i in range(halves * quality.HALF):
            if i >= len(data):
                symbols.append(quality.PAD)
                continue
            again = i + 4 <= len(data) and any(i >= p and data[i : i + 4] == data[i - p : i - p + 4] for p in quality.PERIODS)
            symbols.append(data[i] + 256 * again)
        best = np.full(quality.FILTERS, -np.inf)
        for h in range(halves - 1):
            chunk = net.embed[symbols[h * quality.HALF : (h + 2) * quality.HALF]].reshape(2, -1)
            best = np.maximum(best, chunk[0] @ net.filters[0] + chunk[1] @ net.filters[1])
        want = 1 / (1 + math.exp(-(np.maximum(best + net.bias, 0) @ net.out + net.out_bias)))
        assert abs(quality.scores(net, [text])[0] - want) < 1e-4


# op5


def brute_levels(edges):
    """Longest chain below each call that refers to something; none in circles or above them."""
    memo = {}

    def of(n, path):
        if n not in edges:
            return 0
        if n in path:
            return None
        if n not in memo:
            below = [of(t, path | {n}) for t in edges[n]]
            memo[n] = None if None in below else 1 + max(below)
        return memo[n]

    circular = {n for n in edges if reaches(edges, n)}
    out = {}
    for n in edges:
        memo.clear()
        out[n] = None if leads(edges, n, circular) else of(n, frozenset())
    return out


def reaches(edges, start):
    todo, seen = list(edges[start]), set()
    while todo:
        n = todo.pop()
        if n == start:
            return True
        if n not in seen:
            seen.add(n)
            todo += edges.get(n, ())
    return False


def leads(edges, start, circular):
    todo, seen = [start], set()
    while todo:
        n = todo.pop()
        if n in circular:
            return True
        if n not in seen:
            seen.add(n)
            todo += edges.get(n, ())
    return False


def calls_of(spark, graphs):
    rows = []
    for c, edges in graphs.items():
        names = sorted({*edges, *(t for to in edges.values() for t in to)})
        for turn, n in enumerate(names):
            rows.append((c, n, "tool", json.dumps([{"$ref": t} for t in edges.get(n, ())]), turn, 0))
    return spark.createDataFrame(rows, "conv_id string, call_id string, name string, arguments string, turn long, nth int")


def test_levels_against_brute_force(spark):
    rng = random.Random(5)
    graphs = {}
    for c in [None, *map(str, range(40))]:
        names = [f"n{i:02d}" for i in range(rng.randint(2, 14))]
        graphs[c] = {n: rng.sample(names, rng.choice([1, 1, 1, 2, 3]) if len(names) > 2 else 1) for n in names if rng.random() < 0.7}
        graphs[c]["n00"] = [names[-1]]  # looks ahead, so the conversation is concerned
    got = {(r.conv_id, r.call_id): r.level for r in chat_format.levels(calls_of(spark, graphs)).collect()}
    want = {(c, n): level for c, edges in graphs.items() for n, level in brute_levels(edges).items()}
    assert got == want


def test_a_chain_of_a_thousand_references(spark):
    chain = {f"n{i:04d}": [f"n{i + 1:04d}"] for i in range(1000)}
    began = time.time()
    got = {r.call_id: r.level for r in chat_format.levels(calls_of(spark, {"c": chain})).collect()}
    assert got == {f"n{i:04d}": 1000 - i for i in range(1000)}
    assert time.time() - began < 60
