"""Text and identity expressions; all of them stay inside the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names the identity scheme; a baseline that another tool began states its own in its fingerprints, and is passed as ``algorithm``.
ALGORITHM = "finding/v1"
# Fixed values that stored identities depend on.
EDGE_PUNCTUATION = ",;.:!?()[]{}'\"`"
POSITION_KEYWORDS = ("line", "lines", "col", "cols", "column", "columns")
DURATION_UNIT_WORDS = ("ns", "us", "µs", "ms", "s", "sec", "secs", "second", "seconds", "minute", "minutes", "hour", "hours")
DURATION_UNIT_CHARS = "nuµmsh"
SYMBOL_SEPARATORS = ("::", ".", "/", "#")
PATH_MARK, NUMBER_MARK, DURATION_MARK = "<path>", "<n>", "<dur>"

_EDGE = "[" + "".join("\\" + c for c in EDGE_PUNCTUATION) + "]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only; other alphabets stay."""
    return F.translate(c, _UPPER, _LOWER)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def length_prefixed(c: Column) -> Column:
    """UTF-8 bytes behind their number as an unsigned little-endian 64-bit integer."""
    raw = c.cast("binary")
    big = F.lpad(F.hex(F.octet_length(raw)), 16, "0")
    return F.concat(F.unhex(F.array_join(F.reverse(F.regexp_extract_all(big, F.lit("(..)"), F.lit(1))), "")), raw)


def optional_prefixed(c: Column) -> Column:
    """A presence byte, so that no value and the empty value differ."""
    return F.when(c.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), length_prefixed(c)))


def fingerprint(rule: Column, uri: Column, symbol: Column, blob: Column, message: Column, algorithm: str = ALGORITHM) -> Column:
    """Identity of a finding: it survives reformatting; the blob takes part only where there is no symbol."""
    anchor = F.when(symbol.isNull(), blob)
    fields = F.concat(
        length_prefixed(F.lit(algorithm)), length_prefixed(rule), length_prefixed(uri), optional_prefixed(symbol), optional_prefixed(anchor), length_prefixed(normalize_message(message))
    )
    return F.concat(F.lit(algorithm + ":"), F.sha2(fields, 256))


def split_edges(token: Column) -> tuple[Column, Column, Column]:
    """Punctuation before, the core, punctuation after; a token of punctuation only is all before."""
    whole = f"(?s)^({_EDGE}*)(.*?)({_EDGE}*)$"
    return F.regexp_extract(token, whole, 1), F.regexp_extract(token, whole, 2), F.regexp_extract(token, whole, 3)


def strip_position(core: Column) -> Column:
    """Without up to two trailing ``:digits``; a prefix that is empty or a number stays whole. Each step is one replacement, so nothing is evaluated twice."""
    for _ in range(2):
        core = F.regexp_replace(core, "(?s)^(?![0-9]+:[0-9]+$)(.+):[0-9]+$", "$1")
    return core


def normalize_message(message: Column) -> Column:
    """The message without positions, absolute paths, durations and layout; applying it twice changes nothing."""
    tokens = F.filter(F.split(message, r"(?U)\s+"), lambda t: t != "")

    def part(t: Column) -> Column:
        lead, core, trail = split_edges(t)
        # Absolute paths and durations as replacements: the marks are neither.
        core = F.regexp_replace(strip_position(core), r"(?s)^(?:/.|[A-Za-z]:[\\/].).*$", PATH_MARK)
        core = F.regexp_replace(core, f"^[0-9](?:[0-9.{DURATION_UNIT_CHARS}]*)[smh]$", DURATION_MARK)
        none = F.lit("")
        plain = F.struct(none.alias("lead"), t.alias("core"), none.alias("trail"))
        return F.when(t.rlike(f"^(?!{_EDGE})[^0-9/:]+(?<!{_EDGE})$"), plain).otherwise(F.struct(lead.alias("lead"), core.alias("core"), trail.alias("trail")))

    parts = F.transform(tokens, part)

    # Passes over neighbours: the struct array is rebuilt, then looked at by index.
    def positioned(parts: Column) -> Column:
        def fix(p: Column, i: Column) -> Column:
            keyword = ascii_lower(F.get(parts, i - 1)["core"]).isin(*POSITION_KEYWORDS)
            core = F.when(p["core"].rlike("^[0-9]+$") & F.coalesce(keyword, F.lit(False)), NUMBER_MARK).otherwise(p["core"])
            return F.struct(p["lead"].alias("lead"), core.alias("core"), p["trail"].alias("trail"))

        return F.transform(parts, fix)

    def folds(parts: Column, i: Column) -> Column:
        unit, number = F.get(parts, i), F.get(parts, i - 1)
        yes = (unit["lead"] == "") & ascii_lower(unit["core"]).isin(*DURATION_UNIT_WORDS) & (number["trail"] == "") & number["core"].rlike("^[0-9](?:[0-9.]*[0-9])?$")
        return F.coalesce(yes, F.lit(False))

    def rendered(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            after = F.get(parts, i + 1)["trail"]
            return F.when(folds(parts, i), None).when(folds(parts, i + 1), F.concat(p["lead"], F.lit(DURATION_MARK), after)).otherwise(F.concat(p["lead"], p["core"], p["trail"]))

        return F.array_join(F.filter(F.transform(parts, one), lambda x: x.isNotNull()), " ")

    # Each pass is bound to one value by a one-element transform, so that it is computed once.
    bound = F.transform(F.array(parts), lambda p: positioned(p))
    full = F.element_at(F.transform(bound, rendered), 1)
    # Positions, paths and durations all hold a digit, a slash or a colon; without one only the layout goes.
    return F.when(message.rlike("[0-9/:]"), full).otherwise(F.array_join(tokens, " "))


def has_expired(expires: Column, now: Column) -> Column:
    """What does not look like an ISO date has expired; else dates compare as text."""
    return ~expires.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | (expires <= now)


def rfc3339(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of unix seconds, in a UTC session."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ends_with_segment(qualified: Column, bare: Column) -> Column:
    return any_of([F.endswith(qualified, F.concat(F.lit(s), bare)) for s in SYMBOL_SEPARATORS])


def names_symbol(claim: Column, bare: Column) -> Column:
    """One way: the claim is the bare name, or ends with a separator and it."""
    return (claim == bare) | ends_with_segment(claim, bare)


def names_same_symbol(left: Column, right: Column) -> Column:
    """Either way; an empty name matches nothing."""
    return (left != "") & (right != "") & ((left == right) | ends_with_segment(left, right) | ends_with_segment(right, left))


def bare_suffixes(name: Column) -> Column:
    """All names that ``names_symbol(name, x)`` accepts: an equi-join key in place of an ends-with join."""
    cuts = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    at_cut = F.filter(cuts, lambda i: any_of([F.endswith(F.left(name, i), F.lit(s)) for s in SYMBOL_SEPARATORS]))
    return F.array_distinct(F.concat(F.array(name), F.transform(at_cut, lambda i: F.substring(name, i + 1, F.length(name)))))


def trailing_identifier(name: Column) -> Column:
    """The shortest tail behind a separator; a single colon is none."""
    return F.regexp_replace(name, r"(?s)^.*(?:::|[./#])", "")


def quoted(literal: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def contains_word(text: Column, word: Column) -> Column:
    """The word between characters that cannot be part of an identifier."""
    return F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted(word), F.lit("(?![A-Za-z0-9_])")))


def contains_component(text: Column, component: Column) -> Column:
    """The component among the runs of ASCII letters and digits, case aside."""
    return F.array_contains(F.split(ascii_lower(text), "[^A-Za-z0-9]"), ascii_lower(component))
