"""Reference vetoes: a claim that something is dead falls when anything names, enumerates or recently touched it.

The corpus is rows ``path, kind (blob, symlink, gitlink), content (string of bytes as Latin-1, or text), read_status`` with read_status
completed, truncated, errored or timed_out; candidates are ``candidate, path, symbol``. A missing answer is never a pass:
an incomplete search vetoes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.sources.lineage import kept, large

#: Needle kinds in order; each strategy is a prefix of them.
KINDS = ("basename", "stem", "parent_dir", "symbol")
STRATEGIES = {"basename_only": 1, "with_stem": 2, "with_parent_dir": 3, "maximal": 4}
MAX_HITS = 32


def derive_needles(candidates: DataFrame, strategy: str = "maximal") -> DataFrame:
    """``candidate, path, kind, rank, needle``: empty ones and repeats of an earlier kind's text are left out."""
    path, symbol = F.col("path"), F.col("symbol")
    texts = (paths.basename(path), paths.stem(path), paths.basename(paths.parent(path)), symbol)
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), t.alias("needle")) for i, (k, t) in enumerate(zip(KINDS, texts))][: STRATEGIES[strategy]]
    given = F.filter(F.array(*rows), lambda n: n["needle"].isNotNull() & (n["needle"] != ""))
    first = F.filter(given, lambda n, i: ~F.exists(F.slice(given, F.lit(1), i), lambda m: m["needle"] == n["needle"]))
    return candidates.select("candidate", "path", F.explode(first).alias("n")).select("candidate", "path", "n.kind", "n.rank", "n.needle")


#: Needles of up to WIDE characters are looked for as they are, longer ones by a beginning of up to WIDEST.
WIDE, WIDEST = 32, 128
#: Bits of the filter of needles at most (32 MiB), and characters of texts that are looked at together.
MOST_BITS, PIECE = 28, 1 << 16
#: A beginning of so many characters says, by its place among 2**SLOT_BITS, which widths of needles begin like that; a window is only looked at where its width may.
HEADS, SLOT_BITS = (1, 4, 8), 18
#: Names whose sums a task holds before it hands them on.
MOST_SUMS = 200_000
# Odd numbers that spread characters over 64 bits; UNBASE is what undoes BASE.
BASE, UNBASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIXERS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


#: Needles, and their characters together, that are looked for in one pass by an automaton which every machine gets.
MANY, LARGE = 200_000, 8_000_000


#: Joins the needles of a candidate into one key; no needle holds it, as no text does.
SEPARATOR = "\u0000"


def _automaton_fits(wanted: DataFrame, exact_limit: int) -> bool:
    n, size = wanted.limit(exact_limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()
    return n <= exact_limit and size <= LARGE


def containing(needles: DataFrame, corpus: DataFrame, text: str = "content", overlapping: bool = True, exact_limit: int = MANY) -> DataFrame:
    """``needle, path, offset`` of every file that contains a distinct needle, and where it first does; offsets count characters from 0.

    Up to ``exact_limit`` needles (``LARGE`` characters) are one pass over each text by an Aho-Corasick automaton of all of them. More meet the windows of the texts that have
    a needle's length (see ``_by_windows``). Without ``overlapping``, matches are leftmost-longest and do not overlap, and the needles must be few enough
    for the automaton.
    """
    wanted = needles.select("needle").distinct().persist()
    if _automaton_fits(wanted, exact_limit):
        words = corpus.sparkSession.sparkContext.broadcast(sorted(r.needle for r in wanted.collect()))  # bounded by both limits
        wanted.unpersist()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = _finder(words.value, overlapping)
            for pdf in batches:
                rows = [(w, p, at) for p, t in zip(pdf["path"], pdf["text"]) if t for w, at in find(t).items()]
                yield pd.DataFrame(rows, columns=["needle", "path", "offset"])

        return corpus.select("path", F.col(text).alias("text")).mapInPandas(run, "needle string, path string, offset int")
    wanted.unpersist()
    if not overlapping:
        raise ValueError(f"over {exact_limit} needles or {LARGE} characters")
    return _by_windows(needles, corpus, ["path"], text).select("needle", "path", "offset")


def _powers(of: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, of, dtype=np.uint64))])


@functools.lru_cache(4096)
def _seed(of: str | None) -> np.uint64:
    """A number of a class of texts, so that its texts meet its own needles only."""
    return np.uint64(int.from_bytes(hashlib.blake2b((of or "").encode(), digest_size=8).digest(), "little"))


def _place(h: np.ndarray, bits: int, odd: np.uint64) -> np.ndarray:
    """A place of a number among 2**bits."""
    x = (h ^ (h >> np.uint64(32))) * odd
    return ((x ^ (x >> np.uint64(29))) * odd) >> np.uint64(64 - bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _finder_of_windows(keys: DataFrame, by: list[str]) -> Callable[[], Callable[[list, list | None], Iterator[tuple]]]:
    """Of texts (and their classes, with ``by``), every window that may be one of ``keys`` (by..., key): lists of its row, where it stands and itself, with their width and the first row that is not done with.

    A filter of all keys, of at most 2**MOST_BITS bits, and one of their beginnings are made by the machines and sent to them; a window that is none of the keys may pass, so what comes is to be joined with the keys.
    """
    n, widths = keys.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("key")))).first()  # a few dozen widths
    bits = min(MOST_BITS, max(15, (32 * n).bit_length()))
    heads = [(a, b) for a, b in zip(HEADS, (*HEADS[1:], WIDEST + 1)) if any(a <= w < b for w in widths)]
    size = 2**bits + len(heads) * 2 ** (SLOT_BITS + 6)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up = _powers(BASE, WIDEST)
        for pdf in batches:
            for width, some in pdf.groupby(pdf["key"].str.len()):
                width = int(width)
                codes = (_codes("".join(some["key"])).reshape(-1, width) + np.uint64(1)) * up[:width]
                seeds = np.array([_seed(x) for x in some[by[0]]]) if by else np.uint64(0)
                number = lambda m: (codes[:, :m].sum(axis=1, dtype=np.uint64) + np.uint64(m)) ^ seeds  # noqa: E731, B023
                at = [_place(number(width), bits, odd) for odd in MIXERS]
                at += [(_place(number(a), SLOT_BITS, MIXERS[0]) << np.uint64(6)) + np.uint64(2**bits + i * 2 ** (SLOT_BITS + 6) + widths.index(width)) for i, (a, _) in enumerate(heads) if a <= width]
                yield pd.DataFrame({"at": np.unique(np.concatenate(at)).astype(np.int64) + 1})

    at = keys.select(*by, "key").mapInPandas(placed, "at long")
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # size bits at most
    held = bytearray(size // 8)
    for piece, some in pieces:
        held[(piece - 1) * 4096 : (piece - 1) * 4096 + len(some)] = some
    given = keys.sparkSession.sparkContext.broadcast(bytes(held))
    most = max(widths, default=1)

    def make() -> Callable[[list, list | None], Iterator[tuple]]:
        table = np.frombuffer(given.value, dtype=np.uint8)
        slots = [table[2**bits // 8 :].view("<u8")[i << SLOT_BITS : (i + 1) << SLOT_BITS] for i in range(len(heads))]
        up, back = _powers(BASE, 2 * PIECE + most), _powers(UNBASE, 2 * PIECE + most)

        def looked(parts: list[tuple[int, int, str]], classes: list | None) -> Iterator[tuple]:
            whole = "".join(p for *_, p in parts)
            row, begin, lengths = (np.array(x) for x in zip(*((r, start, len(p)) for r, start, p in parts)))
            ends = np.cumsum(lengths)
            part = np.repeat(np.arange(len(parts)), lengths)
            offset = np.arange(len(whole)) - (ends - lengths)[part]
            room = np.where(offset < PIECE, lengths[part] - offset, 0)  # characters to the end of the part; none where the next part of a text begins
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_codes(whole) + np.uint64(1)) * up[: len(whole)])])
            seeds = None if classes is None else np.array([_seed(classes[r]) for r in row])[part]

            def number(left: np.ndarray, width: int) -> np.ndarray:
                h = (sums[left + width] - sums[left]) * back[left] + np.uint64(width)
                return h if seeds is None else h ^ seeds[left]

            left = np.arange(len(whole))
            for (a, b), slot in zip(heads, slots):
                left = left[room[left] >= a]
                may = slot[_place(number(left, a), SLOT_BITS, MIXERS[0]).astype(np.int64)]
                left, may = left[may > 0], may[may > 0]
                for i, width in enumerate(widths):
                    if not a <= width < b:
                        continue
                    some = left[(may >> np.uint64(i)) & np.uint64(1) > 0]
                    some = some[room[some] >= width]
                    h = number(some, width)
                    for odd in MIXERS:
                        p = _place(h, bits, odd)
                        there = (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        some, h = some[there], h[there]
                    if len(some):
                        yield width, int(row[0]), row[part[some]].tolist(), (begin[part[some]] + offset[some]).tolist(), [whole[i : i + width] for i in some.tolist()]
                left = left[may >= np.uint64(1 << next((i for i, w in enumerate(widths) if w >= b), 63))]

        def find(texts: list, classes: list | None) -> Iterator[tuple]:
            parts, size = [], 0
            for row, t in enumerate(texts):
                for start in range(0, len(t or ""), PIECE):
                    parts.append((row, start, t[start : start + PIECE + most - 1]))
                    size += len(parts[-1][-1])
                    if size >= PIECE:
                        yield from looked(parts, classes)
                        parts, size = [], 0
            if parts:
                yield from looked(parts, classes)

        return find

    return make


def _windows(keys: DataFrame, corpus: DataFrame, ids: list[str], text: str, count: bool, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``key, ids..., offset, n`` of every window of a text that may be one of ``keys`` (by..., key): where it first stands, and how often it occurs without overlapping itself (if ``count``). ``by``, at most one of ``ids``, is the class that texts and keys are of."""
    make = _finder_of_windows(keys, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make()
        for pdf in batches:
            of = list(pdf[ids].itertuples(index=False, name=None))
            rows = lambda some: pd.DataFrame([(k, *of[r], at, n if count else 0) for (r, k), (at, _, n) in some.items()], columns=["key", *ids, "offset", "n"])  # noqa: E731, B023
            met: dict[tuple[int, str], tuple[int, int, int]] = {}
            seen = 0
            for width, first, places, offsets, words in find(pdf[text].tolist(), pdf[by[0]].tolist() if by else None):
                if first > seen and len(met) > 50_000:
                    yield rows({x: met.pop(x) for x in list(met) if x[0] < first})
                seen = first
                for r, o, k in zip(places, offsets, words):
                    at, free, n = met.get((r, k)) or (o, o, 0)
                    if o >= free:
                        met[r, k] = at, o + width, n + 1
            yield rows(met)

    return corpus.select(*ids, text).mapInPandas(run, "key string, " + "".join(f"{c} string, " for c in ids) + "offset int, n long")


def _key(needle: Column) -> Column:
    """The needle, or the beginning by which a long one is looked for."""
    n = F.length(needle)
    return F.left(needle, F.when(n <= WIDE, n).otherwise(F.least(F.lit(WIDEST), n - n % 8)).cast("int"))


def _by_windows(wanted: DataFrame, corpus: DataFrame, ids: list[str], text: str, count: bool = False, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``needle, ids..., offset, n`` of each distinct needle and text that holds it, for any number of needles: windows of the texts meet needles by an equi-join, so texts never meet needles that they do not hold.
    With ``by`` (see ``_windows``) needles are those of a text's own class.

    Needles of over ``WIDE`` characters meet by their beginning and are then looked for themselves.
    """
    keyed = kept(wanted.where("needle <> ''").select(*by, "needle").distinct().withColumn("key", _key(F.col("needle"))))
    found = _windows(keyed.select(*by, "key").distinct(), corpus, ids, text, count, by)
    whole = keyed.where("needle = key").select(*by, "key")
    long = keyed.where("needle <> key")
    if long.isEmpty():
        return large(found).join(whole, [*by, "key"]).withColumnRenamed("key", "needle").select("needle", *ids, "offset", "n")
    found = kept(found)
    hit = large(found).join(whole, [*by, "key"]).withColumnRenamed("key", "needle").select("needle", *ids, "offset", "n")
    maybe = large(large(found.select("key", *ids)).join(long, [*by, "key"])).join(corpus.select(*ids, text), ids)
    first = F.instr(F.col(text), F.col("needle"))
    times = (F.length(text) - F.length(F.replace(F.col(text), F.col("needle"), F.lit("")))) / F.length("needle")
    return hit.unionByName(maybe.where(first > 0).select("needle", *ids, (first - 1).cast("int").alias("offset"), times.cast("long").alias("n")))


def _finder(words: list[str], overlapping: bool) -> Callable[[str], dict[str, int]]:
    """Of a text, the words it holds and where each first stands."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in words:
        if w:
            automaton.add_word(w, w)
    if not len(automaton):
        return lambda text: {}
    automaton.make_automaton()
    widest = max(map(len, words))

    def find(text: str) -> dict[str, int]:
        met: dict[str, int] = {}
        spans = automaton.iter(text) if overlapping else _longest(automaton.iter(text), widest)
        for end, w in spans:
            if w not in met:
                met[w] = end + 1 - len(w)
        return met

    return find


def _longest(spans: Iterable[tuple[int, str]], widest: int) -> Iterator[tuple[int, str]]:
    """Leftmost-longest matches that do not overlap, out of all matches as (last place, word), given by last place.

    A match is settled as soon as no word that begins where it does, or before, can still end; only matches of the last ``widest`` places wait.
    """
    waiting: list[tuple[int, int, str]] = []
    free = 0
    for last, w in itertools.chain(spans, [(1 << 62, "")]):
        while waiting and waiting[0][0] + widest <= last:
            start, minus_last, found = heapq.heappop(waiting)
            if start >= free:
                yield -minus_last, found
                free = 1 - minus_last
        if w and last + 1 - len(w) >= free:
            heapq.heappush(waiting, (last + 1 - len(w), -last, w))


def _settled(words: tuple[str, ...], text: str) -> dict[str, int]:
    """Where each of a few words first matches, when only they are looked for: leftmost, then longest, one after the other."""
    pattern = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True))))
    met: dict[str, int] = {}
    for m in pattern.finditer(text):
        if m[0] not in met:
            met[m[0]] = m.start()
            if len(met) == len(words):
                break
    return met


def literal_hits(candidates: DataFrame, corpus: DataFrame, strategy: str = "maximal", exact_limit: int = MANY) -> DataFrame:
    """``candidate, kind, rank, needle, file, offset``: one a (needle, file); the candidate's own file does not count.

    A candidate's needles are matched as if they alone were looked for: leftmost-longest, without overlap, so a file that only spells the whole name is a hit of the
    basename, not of the stem inside it. One pass finds every needle's first place; where a file holds several needles of one candidate, these few are matched again by
    themselves, and only what then differs is kept beside the first places.
    """
    needles = derive_needles(candidates, strategy)
    own = needles.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_set("needle")), SEPARATOR).alias("words"))  # at most four
    needles = large(needles).join(own, "candidate")
    sets = own.select("words").distinct().where(F.contains("words", F.lit(SEPARATOR)))
    readable = corpus.where("kind <> 'gitlink' and read_status = 'completed'").select("path", F.col("content").alias("text"))
    wanted = needles.select("needle").distinct()
    if _automaton_fits(wanted, exact_limit) and _automaton_fits(sets.withColumnRenamed("words", "needle"), exact_limit):
        given = corpus.sparkSession.sparkContext.broadcast((sorted(r.needle for r in wanted.collect()), sorted(r.words for r in sets.collect())))  # bounded by both limits

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, together = given.value
            find = _finder(words, True)
            of: dict[str, list[int]] = {}
            groups = [tuple(x.split(SEPARATOR)) for x in together]
            for i, group in enumerate(groups):
                for w in group:
                    of.setdefault(w, []).append(i)
            for pdf in batches:
                rows = []
                for path, text in zip(pdf["path"], pdf["text"]):
                    met = find(text) if text else {}
                    rows += [(None, w, path, at) for w, at in met.items()]
                    several = Counter(i for w in met for i in of.get(w, ()))
                    for i in (i for i, n in several.items() if n > 1):
                        alone = _settled(tuple(w for w in groups[i] if w in met), text)
                        rows += [(together[i], w, path, alone.get(w, -1)) for w in groups[i] if w in met and alone.get(w, -1) != met[w]]
                yield pd.DataFrame(rows, columns=["words", "needle", "file", "offset"])

        # Both kinds of rows come from one pass, which is kept, as two joins read it.
        found = kept(readable.mapInPandas(run, "words string, needle string, file string, offset int"))
        first, other = found.where("words is null").drop("words"), found.where("words is not null")
    else:
        first = kept(_by_windows(wanted, readable, ["path"], "text").select("needle", F.col("path").alias("file"), "offset"))
        held = needles.select("words", "needle").distinct().where(F.contains("words", F.lit(SEPARATOR))).join(large(first), "needle")
        pairs = held.groupBy("words", "file").agg(F.collect_list(F.struct("needle", "offset")).alias("met")).where(F.size("met") > 1)

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for words, path, met, text in zip(pdf["words"], pdf["file"], pdf["met"], pdf["text"]):
                    alone = _settled(tuple(m["needle"] for m in met), text)
                    rows += [(words, m["needle"], path, alone.get(m["needle"], -1)) for m in met if alone.get(m["needle"], -1) != m["offset"]]
                yield pd.DataFrame(rows, columns=["words", "needle", "file", "offset"])

        other = large(pairs).join(readable.withColumnRenamed("path", "file"), "file").select("words", "file", "met", "text").mapInPandas(settle, "words string, needle string, file string, offset int")
    hits = large(large(needles).join(first, "needle").where("file <> path")).join(other.withColumnRenamed("offset", "alone"), ["words", "needle", "file"], "left")
    return hits.withColumn("offset", F.coalesce("alone", "offset")).where("offset >= 0").select("candidate", "kind", "rank", "needle", "file", "offset")


def counted(needles: DataFrame, texts: DataFrame, exact_limit: int = MANY) -> DataFrame:
    """``mutant, needle, path, n`` of every text (mutant, path, text) that holds a needle (mutant, needle) of its own class: how often, without overlapping itself.

    One pass over the texts: an automaton of all needles says which a text holds, and these alone are counted. More needles than it takes meet the windows of the texts, which are counted in the same pass.
    """
    wanted = needles.select("mutant", "needle").where("needle <> ''").distinct()
    if _automaton_fits(wanted, exact_limit):
        given = texts.sparkSession.sparkContext.broadcast([(r.mutant, r.needle) for r in wanted.collect()])  # bounded

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of: dict[str, set] = {}
            for mutant, needle in given.value:
                of.setdefault(needle, set()).add(mutant)
            find = _finder(sorted(of), True)
            for pdf in batches:
                rows = [(m, w, p, t.count(w)) for m, p, t in zip(pdf["mutant"], pdf["path"], pdf["text"]) if t for w in find(t) if m in of[w]]
                yield pd.DataFrame(rows, columns=["mutant", "needle", "path", "n"])

        return texts.select("mutant", "path", "text").mapInPandas(run, "mutant string, needle string, path string, n long")
    return _by_windows(wanted, texts, ["mutant", "path"], "text", True, ["mutant"]).select("mutant", "needle", "path", "n")


def totals(needles: DataFrame, texts: DataFrame, exact_limit: int = MANY) -> DataFrame:
    """``mutant, needle, lo, hi, n`` of every needle (mutant, needle) that a text (mutant, path, text) of its own class holds: the first and the last of their paths, and how often it occurs in all, without overlapping itself.

    What ``counted`` says, summed where the texts are: a task hands on a row a name and not a row a text and name, so that what is shuffled grows with the names.
    """
    wanted = kept(needles.select("mutant", "needle").where("needle <> ''").distinct())
    if _automaton_fits(wanted, exact_limit):
        return counted(wanted, texts, exact_limit).groupBy("mutant", "needle").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.sum("n").alias("n"))
    short, long = wanted.where(F.length("needle") <= WIDE), wanted.where(F.length("needle") > WIDE)
    make = _finder_of_windows(short.withColumnRenamed("needle", "key"), ["mutant"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make()
        sums: dict[tuple, list] = {}
        rows = lambda: pd.DataFrame([(*of, *x[:3]) for of, x in sums.items()], columns=["mutant", "needle", "lo", "hi", "n"])
        base = 0
        for pdf in batches:
            mutants, paths = pdf["mutant"].tolist(), pdf["path"].tolist()
            for width, _, places, offsets, words in find(pdf["text"].tolist(), mutants):
                for r, o, k in zip(places, offsets, words):
                    of, p = (mutants[r], k), paths[r]
                    x = sums.get(of)
                    if x is None:
                        sums[of] = [p, p, 1, base + r, o + width]
                    elif x[3] != base + r:
                        x[2] += 1
                        x[3], x[4] = base + r, o + width
                        if p is not None:
                            x[0], x[1] = p if x[0] is None or p < x[0] else x[0], p if x[1] is None or p > x[1] else x[1]
                    elif o >= x[4]:
                        x[2] += 1
                        x[4] = o + width
            base += len(pdf)
            if len(sums) > MOST_SUMS:
                yield rows()
                sums.clear()
        yield rows()

    found = texts.select("mutant", "path", "text").mapInPandas(run, "mutant string, needle string, lo string, hi string, n long")
    if not long.isEmpty():
        more = _by_windows(long, texts, ["mutant", "path"], "text", True, ["mutant"])
        found = found.unionByName(more.select("mutant", "needle", F.col("path").alias("lo"), F.col("path").alias("hi"), "n"))
    summed = found.groupBy("mutant", "needle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return large(summed).join(wanted, ["mutant", "needle"])


def capped_hits(hits: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """``candidate, n_hits, capped, hits``: the first hits by (file, offset, rank, needle, kind) for the report; the count is the true one.

    The first ``limit`` are taken by (candidate, salt) and then by candidate, so no task holds all hits of a candidate.
    """
    order = ["file", "offset", "rank", "needle", "kind"]
    some = hits.withColumn("salt", F.pmod(F.xxhash64("file"), F.lit(64)))
    for keys in (["candidate", "salt"], ["candidate"]):
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit)
    kept = some.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("hits"))  # at most limit
    counts = hits.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_hits"))
    return counts.join(kept, "candidate").select("candidate", "n_hits", (F.col("n_hits") > limit).alias("capped"), "hits")


def literal_verdicts(candidates: DataFrame, corpus: DataFrame, strategy: str = "maximal") -> DataFrame:
    """``candidate, verdict, reason, n_hits, first_file``: a hit vetoes (reference), else an incomplete search does, else clear.

    No needle at all is an error, and errors veto. Facts about the corpus are one row and reach candidates without hits, too.
    """
    hits = literal_hits(candidates, corpus, strategy).groupBy("candidate").agg(F.count(F.lit(1)).alias("n_hits"), F.min(F.struct("file", "offset", "rank")).alias("first"))
    needles = derive_needles(candidates, strategy).groupBy("candidate").agg(F.count(F.lit(1)).alias("n_needles"))
    # Unreadable files, the candidate's own aside: their number, and the path if there is only one.
    gaps = corpus.where("kind <> 'gitlink' and read_status <> 'completed'").agg(F.count(F.lit(1)).alias("n_gaps"), F.min("path").alias("gap_path"), F.min_by("read_status", "path").alias("gap"))
    j = large(large(candidates).join(hits, "candidate", "left")).join(needles, "candidate", "left").crossJoin(F.broadcast(gaps))  # one row
    open_gap = (F.col("n_gaps") > 1) | ((F.col("n_gaps") == 1) & (F.col("gap_path") != F.col("path")))
    reason = F.when(F.col("n_needles").isNull(), "errored").when(F.col("n_hits") > 0, "reference").when(open_gap, F.col("gap"))
    return j.select(
        "candidate", F.when(reason.isNull(), "clear").otherwise("vetoed").alias("verdict"), reason.alias("reason"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.col("first.file").alias("first_file")
    )


def reachability_verdicts(candidates: DataFrame, rooted: DataFrame, suffix_rules: DataFrame, incomplete: DataFrame) -> DataFrame:
    """``candidate, verdict, reason``: an incomplete read vetoes all; then the nearest rooted directory or file; then the first suffix rule.

    ``rooted(path, reason)`` distinct by path, ``suffix_rules(suffix, reason)``, ``incomplete(path, reason)``. Ancestors are an equi-join:
    a candidate is exploded into the directories above it, whose number its depth bounds.
    """
    up = candidates.select("candidate", F.posexplode(paths.ancestors(F.col("path"))).alias("level", "path"))
    near = large(up).join(rooted, "path").groupBy("candidate").agg(F.max_by("reason", "level").alias("rooted_by"))
    by_suffix = candidates.join(F.broadcast(suffix_rules), F.endswith("path", F.col("suffix"))).groupBy("candidate").agg(F.min_by("reason", "suffix").alias("suffix_by"))
    gap = incomplete.agg(F.min(F.struct("path", "reason")).alias("gap"))
    j = large(large(candidates).join(near, "candidate", "left")).join(by_suffix, "candidate", "left").crossJoin(F.broadcast(gap))  # one row
    reason = F.coalesce(F.col("gap.reason"), F.col("rooted_by"), F.col("suffix_by"))
    return j.select("candidate", F.when(reason.isNull(), "clear").otherwise("vetoed").alias("verdict"), reason.alias("reason"))


def first_reason(rows: DataFrame) -> DataFrame:
    """``path, reason`` of ``rows(path, reason, file, kind_rank, pos)``: the first writer keeps a path."""
    return rows.groupBy("path").agg(F.min_by("reason", F.struct("file", "kind_rank", "pos")).alias("reason"))


def recency_verdicts(candidates: DataFrame, touches: DataFrame, status: DataFrame, shallow: Column, now: Column, window_days: int = 7) -> DataFrame:
    """``candidate, verdict, reason, age``: shallow, dirty, without a commit, or touched within the window (inclusive, and the future) vetoes.

    ``touches(path, committed_at, authored_at)`` in unix seconds, ``status(path, dirty)``; a candidate without a status row could not be asked, which vetoes.
    """
    last = touches.groupBy("path").agg(F.max(F.greatest("committed_at", "authored_at")).alias("touched"))
    age = now - F.col("touched")
    reason = (
        F.when(shallow.isNull() | F.col("dirty").isNull(), "unavailable")
        .when(shallow, "shallow_history")
        .when(F.col("dirty"), "uncommitted_change")
        .when(F.col("touched").isNull(), "no_commit_timestamp")
        .when(age <= F.lit(window_days * 86400), "recent_commit")
    )
    j = candidates.join(last, "path", "left").join(status, "path", "left")
    return j.select("candidate", F.when(reason.isNull(), "abstain").otherwise("vetoed").alias("verdict"), reason.alias("reason"), age.alias("age"))


def first_veto(candidates: DataFrame, verdicts: list[tuple[str, DataFrame]]) -> DataFrame:
    """``candidate, gate, reason``: of the gates in order, the first that vetoes; null where none does."""
    j = candidates.select("candidate")
    for name, v in verdicts:
        one = v.select("candidate", F.when(F.col("verdict") == "vetoed", F.struct(F.lit(name).alias("gate"), F.col("reason").alias("reason"))).alias(f"__{name}"))
        j = j.join(one, "candidate", "left")
    first = F.coalesce(*[F.col(f"__{name}") for name, _ in verdicts])
    return j.select("candidate", first["gate"].alias("gate"), first["reason"].alias("reason"))


# What enumerates a directory when a program runs; matched without regard to the case of A-Z.
ENUMERATIONS = (
    "**/", "/**", "glob(", "iglob(", "globsync(", "globby(", "fast-glob", "import.meta.glob", "readdir", "read_dir", "scandir", "listdir", "opendir", "walk(", "os.walk", "filepath.walk", "walkdir",
    "walk_dir", "dir[", "dir.glob", "dir.entries", "dir.children", "dir.foreach", "dir.each_child", "require.context", "importlib.resources", "pkgutil.iter_modules", "pkg_resources", "go:embed",
    "embed.fs", "include_str!", "include_bytes!", "include_dir!", "bundle.module", "bundle.main", "nsbundle", "contentsofdirectory", "listfiles(", "files.walk", "files.list", "getresources(",
    "getfiles(", "enumeratefiles", "getdirectories(",
)


def enumerating_files(corpus: DataFrame) -> DataFrame:
    """``path, construct, offset``: the earliest construct of each file that enumerates directories."""
    low = F.translate("content", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    at = [F.struct(F.nullif(F.instr(low, F.lit(c)), F.lit(0)).alias("at"), F.lit(c).alias("construct")) for c in ENUMERATIONS]
    found = F.array_min(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))
    some = "(?i)" + "|".join(rf"\Q{c}\E" for c in ENUMERATIONS)  # one pass; of A-Z alone, as no flag asks for more
    return corpus.where(F.rlike("content", F.lit(some))).select("path", found["construct"].alias("construct"), (found["at"] - 1).alias("offset"))
