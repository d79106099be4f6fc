"""lcov tracefiles and control files, parsed as lines inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(files: DataFrame) -> DataFrame:
    """``artifact, line, text`` of ``files(artifact, text)``, trimmed."""
    rows = files.select("artifact", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    return rows.select("artifact", (F.col("i") + 1).alias("line"), F.trim(F.regexp_replace("raw", r"[\r\t]", " ")).alias("text"))


def normalized(source):
    return F.regexp_replace(F.replace(source, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


DATA = ("FN", "FNDA", "DA")
U32, U64 = 4294967295, 18446744073709551615


def _number(text: Column, most: int) -> Column:
    """An unsigned number of at most ``most``, null where it is none."""
    value = F.when(text.rlike(r"^\+?\d{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit(str(most)).cast("decimal(20,0)"), value)


def records(files: DataFrame) -> DataFrame:
    """Every line of tracefiles that says something: ``artifact, line, key (SF, FN, FNDA, DA, end), source, name, number, count, violation``.

    ``files(artifact, text)``; with a column ``part``, an artifact comes in parts, cut between lines, and one huge tracefile is many rows. ``source`` is the record that a line lies in. A
    text is cut into records where it stands, by array functions, so nothing is sorted. Of each part only what it hands on meets the others: how many lines it has, whether a record is
    open at its end, and which. Unknown keys are skipped. A null text is an empty one.
    """
    parts = ["part"] if "part" in files.columns else []
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    trimmed = F.transform(lines, lambda raw, i: F.struct((i + 1).alias("line"), F.trim(F.translate(raw, "\r\t", "  ")).alias("t")))
    some = F.filter(trimmed, lambda x: (x["t"] != "") & ~F.startswith(x["t"], F.lit("#")))
    keyed = F.transform(
        some,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.when(x["t"] == "end_of_record", "end").otherwise(F.substring_index(x["t"], ":", 1)).alias("key"),
            F.trim(F.substring(x["t"], F.instr(x["t"], ":") + 1, F.length(x["t"]))).alias("value"),
        ),
    )
    said = F.filter(keyed, lambda x: x["key"].isin("SF", "end", *DATA))
    rows = files.select("artifact", *parts, F.size(lines).alias("n_lines"), said.alias("said"))
    # Opening and closing lines: what is open before the first of them comes from the parts before.
    turns = F.filter("said", lambda x: x["key"].isin("SF", "end"))
    last = F.try_element_at(turns, F.lit(-1))
    source = lambda x: F.when(x["key"] == "SF", normalized(x["value"]))
    if parts:
        rows = rows.withColumns({"turned": last.isNotNull(), "hands_on": source(last), "final": F.try_element_at("said", F.lit(-1))["line"]})
        before = Window.partitionBy("artifact").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy("artifact")
        state = F.last_value(F.when(F.col("turned"), F.struct("hands_on")), True).over(before)["hands_on"]
        carried = rows.select("artifact", "part", state.alias("carried"), F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("above"), (F.max(F.when(F.col("final").isNotNull(), F.col("part"))).over(every) == F.col("part")).alias("closes"))
        rows = rows.select("artifact", "part", "said").join(carried, ["artifact", "part"])
    else:
        rows = rows.select("artifact", "said", F.lit(None).cast("string").alias("carried"), F.lit(0).alias("above"), F.lit(True).alias("closes"))
    # A record, or what lies outside of one, begins at an SF line, after an end, and with the part.
    starts = F.filter(
        F.transform("said", lambda x, j: F.when((j == 0) | (x["key"] == "SF") | (F.try_element_at(F.col("said"), j)["key"] == "end"), j + 1)), lambda j: j.isNotNull()
    )
    rows = rows.withColumn("starts", starts)
    cut = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.when(F.element_at(F.col("said"), s)["key"] == "SF", source(F.element_at(F.col("said"), s))).when(s == 1, F.col("carried")).alias("source"),
            F.slice(F.col("said"), s, F.coalesce(F.try_element_at(F.col("starts"), (i + 2).cast("int")), F.size("said") + 1) - s).alias("rows"),
        ),
    )
    each = rows.select("artifact", "above", "closes", F.try_element_at("said", F.lit(-1))["line"].alias("last"), F.explode(cut).alias("s"))
    each = each.select("artifact", "above", "closes", "last", F.col("s.source").alias("source"), F.explode("s.rows").alias("x"))
    x = F.col("x")
    key, value = x["key"], x["value"]
    comma = F.instr(value, ",")
    head = F.when(comma > 0, F.trim(F.substring_index(value, ",", 1))).otherwise("")
    tail = F.when(comma > 0, F.trim(F.substring(value, comma + 1, F.length(value)))).otherwise("")
    each = each.select("artifact", "above", "closes", "last", "source", x["line"].alias("at"), key.alias("key"), value.alias("value"), head.alias("head"), tail.alias("tail"))
    second = F.instr("tail", ",")
    rest = F.trim(F.substring(F.col("tail"), second + 1, F.length("tail")))
    ranged = (F.col("key") == "FN") & (second > 0) & _number(F.trim(F.substring_index("tail", ",", 1)), U32).isNotNull() & (rest != "")  # FN:<start>,<end>,<name>
    counted = F.trim(F.substring_index("tail", ",", 1))
    each = each.withColumns({
        "number": F.when(F.col("key").isin(*DATA), F.when(F.col("key") == "FNDA", _number(F.col("head"), U64)).otherwise(_number(F.col("head"), U32))),
        "name": F.when(F.col("key").isin("FN", "FNDA"), F.when(ranged, rest).otherwise(F.col("tail"))),
        "count": F.when(F.col("key") == "DA", F.when(counted == "-", F.lit(0).cast("decimal(20,0)")).otherwise(_number(counted, U64))),
    })
    data = F.col("key").isin(*DATA)
    wrong = (
        F.when((F.col("key") == "SF") & (F.col("value") == ""), "a record without a path")
        .when((F.col("key") == "end") & F.col("source").isNull(), "an end outside of a record")
        .when(data & F.col("source").isNull(), "data before any record")
        .when(data & F.col("number").isNull(), "a number that is none")
        .when(F.col("key").isin("FN", "FNDA") & (F.col("name") == ""), "no function name")
        .when((F.col("key") == "DA") & F.col("count").isNull(), "a count that is none")
        .when(F.col("closes") & (F.col("at") == F.col("last")) & (F.col("key") != "end"), "a record without its end")
    )
    return each.select("artifact", (F.col("above") + F.col("at")).cast("long").alias("line"), "key", "source", "name", "number", "count", wrong.alias("violation"))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions (``artifact, source, seq, name, start_line, calls``), lines (``artifact, source, line, count``) and violations (``artifact, line, violation``) of ``records``.

    Data or an end outside of a record, a record without its end and a number that is none are violations, and an artifact with one has said nothing.
    """
    rows = records(files)
    good = rows.where("violation is null")
    functions = good.where("key in ('FN', 'FNDA')").select(
        "artifact", "source", F.col("line").alias("seq"), "name", F.when(F.col("key") == "FN", F.col("number")).cast("long").alias("start_line"), F.when(F.col("key") == "FNDA", F.col("number")).alias("calls")
    )
    lines = good.where("key = 'DA'").select("artifact", "source", F.col("number").cast("long").alias("line"), "count")
    return functions, lines, rows.where("violation is not null").select("artifact", "line", "violation")


def control(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and floors (``artifact, symbol, floor``) and violations of control files: ``symbol <name>``, ``min-called-functions <n>``."""
    t = numbered(files).where("text <> '' and not startswith(text, '#')")
    word, value = F.regexp_extract("text", r"^(\S+)", 1), F.trim(F.regexp_extract("text", r"^\S+\s+(.*)$", 1))
    wrong = (
        F.when(~word.isin("symbol", "min-called-functions"), "an unknown directive")
        .when((word == "symbol") & (value == ""), "a symbol without a name")
        .when((word == "min-called-functions") & ~value.rlike(r"^\d+$"), "a floor that is no number")
    )
    rows = t.select("artifact", "line", word.alias("word"), value.alias("value"), wrong.alias("violation"))
    good = rows.where("violation is null").select("artifact", F.when(F.col("word") == "symbol", F.col("value")).alias("symbol"), F.when(F.col("word") != "symbol", F.col("value")).cast("int").alias("floor"))
    return good, rows.where("violation is not null").select("artifact", "line", "violation")
