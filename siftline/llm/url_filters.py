"""URL filters: a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit per pattern position (Shift-And). Reading a
byte moves the whole set of patterns at once:

    state = (((state << 1) | starts) & accept[byte]) | (state & loop[byte])

``accept`` has the positions whose class holds the byte, ``loop`` the positions at which a ``*`` may stay.
A batch of URLs is a matrix of states, a row for each URL, and every step handles one byte of all of them.

A URL is read in canonical form: a dot, the lower-cased host, a separator symbol that no byte equals, the path.
A host rule ``net/en/`` is the glob ``*.net <sep> /en/*`` and so fits the host and its subdomains only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = 256  # the symbol between host and path


@dataclass(frozen=True)
class Rule:
    """``pattern``: ``host/path`` for kind "host", else a glob (``*``, ``?``) over ``.host/path``."""

    pattern: str
    verdict: str
    kind: str = "glob"


class Automaton:
    """Shift-And over any number of patterns, as many 64-bit words as their positions need."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        symbols: list[tuple[int, int]] = []  # of each position: a symbol (-1: any byte), loops? 0 no, 1 any byte, 2 any symbol
        starts, self.ends = [], []
        for r in rules:
            starts.append(len(symbols))
            symbols += self._parse(r)
            self.ends.append(len(symbols) - 1)
        n = max(1, len(symbols))
        self.words = (n + 63) // 64
        accept = np.zeros((257, self.words * 64), bool)
        loop = np.zeros((257, self.words * 64), bool)
        first = np.zeros(self.words * 64, bool)
        for i, (sym, stay) in enumerate(symbols):
            if sym == -2:
                pass  # entered before the first symbol only
            elif sym == -1:
                accept[:, i] = True
            else:
                accept[sym, i] = True
            loop[:256, i] = stay > 0
            loop[SEP, i] = stay > 1
        for s in starts:
            first[s] = True
        pack = lambda m: np.packbits(m, axis=-1, bitorder="little").view(np.uint64)
        self.accept, self.loop, self.first = pack(accept), pack(loop), pack(first)

    @staticmethod
    def _parse(r: Rule) -> list[tuple[int, int]]:
        """Positions; the first is the state before any symbol, and a star lets the position before it stay."""
        if r.kind == "host":
            host, _, path = r.pattern.partition("/")
            parts: list[int | str] = ["host*", *(b"." + host.encode()), SEP, *("/" + path).encode(), "*"]
        else:
            parts = [c if c in "*?" else c.encode() for c in r.pattern]  # type: ignore[misc]
            parts = [x for p in parts for x in ([p] if isinstance(p, str) else list(p))]
        out: list[list[int]] = [[-2, 0]]
        for p in parts:
            if p == "host*":
                out[-1][1] = max(out[-1][1], 1)
            elif p == "*":
                out[-1][1] = 2
            elif p == "?":
                out.append([-1, 0])
            else:
                out.append([int(p), 0])
        return [tuple(x) for x in out]  # type: ignore[misc]

    def match(self, rows: list[np.ndarray]) -> np.ndarray:
        """Boolean matrix: which rule matches which whole row of symbols."""
        hits = np.zeros((len(rows), len(self.rules)), bool)
        if not self.rules:
            return hits
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        length = np.array([len(rows[i]) for i in order])
        state = np.repeat(self.first[None, :], len(rows), 0)
        # Symbols are stored step by step, only for rows that are that long: no padding, so a very long URL costs itself.
        total = int(length.sum())
        flat = np.concatenate([rows[i] for i in order]) if total else np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length
        live = len(rows)
        for step in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= step:
                live -= 1
            sym = flat[begin[:live] + step]
            s = state[:live]
            shifted = s << np.uint64(1)
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.accept[sym]) | (s & self.loop[sym])
        for k, e in enumerate(self.ends):
            hits[order, k] = (state[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) == 1
        return hits


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def symbols(host: str, path: str) -> np.ndarray:
    h, p = ("." + host).encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
    out = np.empty(len(h) + 1 + len(p), np.int64)
    out[: len(h)] = np.frombuffer(h, np.uint8)
    out[len(h)] = SEP
    out[len(h) + 1 :] = np.frombuffer(p, np.uint8)
    return out


def decide_urls(pages: DataFrame, host_rules: list[Rule], globs: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, globs``: a row for each row of ``pages``.

    The longest host rule that fits decides (of equally long ones the first given). Where none fits, a URL
    is blocked if any "block" glob matches and no "allow" glob does, else allowed; a null URL or one without
    ``://`` has empty host and path and is treated like that. ``globs`` lists the globs that matched, comma-joined.
    Globs see ``.host``, a separator that only ``*`` and ``?`` match, then the path; of the other columns none is read.
    """
    rules = [Rule(r.pattern, r.verdict, "host") for r in host_rules]
    n = len(rules)
    automaton = Automaton([*rules, *globs])
    by_length = sorted(range(n), key=lambda i: (-len(rules[i].pattern), i))

    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(hosts), 2048):
            rows = [symbols(h, p) for h, p in zip(hosts.iloc[at : at + 2048], paths.iloc[at : at + 2048])]
            for got in automaton.match(rows):
                rule = next((i for i in by_length if got[i]), None)
                hit = [g for g, x in zip(globs, got[n:]) if x]
                kinds = {g.verdict for g in hit}
                verdict = rules[rule].verdict if rule is not None else "block" if "block" in kinds and "allow" not in kinds else "allow"
                out.append((None if rule is None else rules[rule].pattern, verdict, ",".join(g.pattern for g in hit)))
        return pd.DataFrame(out, columns=["rule", "verdict", "globs"])

    decided = F.pandas_udf(decide, "rule string, verdict string, globs string")
    return (
        pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
        .withColumn("j", decided("host", "path"))
        .select("id", "host", "path", "j.rule", "j.verdict", "j.globs")
    )
