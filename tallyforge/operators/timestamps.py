"""Mixed timestamp notations: every valid reading of a value, and the likeliest one along a source's records.

Readings are generated with built-in expressions. The choice among a record's readings is a Viterbi path over
the source's record order with a penalty for a change of notation and one for a step back in time. A source may
hold most of the rows, so its path is found in blocks: a block of records is summed up as a matrix of path costs
between the readings of its first and last record, matrices are composed in two more levels, and the choice goes
back down the same way. Costs add up exactly, so the result is that of one pass over the whole source.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.times import iso_micros
from tallyforge.session import materialise

SWITCH, BACK = 1.0, 2.0  # costs of a change of notation and of a step back in time
BLOCK_BITS = 10
ASSUMED = ["UTC", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles"]
#: Hours east of UTC of the abbreviations that publications use; several where it stands for several zones.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10}
ABBREVIATIONS |= {"WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "BST": (1, 6), "IST": (5.5, 2, 1)}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
HOUR = 3_600_000_000

OFFSET = r"(?:(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,4}(?![A-Z/_]))"
TAIL = rf"\s*({OFFSET})?\s*(?:\[([^\]]+)\]|([A-Z][A-Z_]+(?:/[A-Z0-9_+-]+)+))?$"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(?:([AP])\.?(?:M\.?)?(?![A-Z]))?"
#: name, pattern, and the groups that hold year, month, day, hour, minute, second, fraction, am/pm, offset, [zone], zone
LAYOUTS = [
    ("iso", rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:T|\s+){CLOCK}{TAIL}", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("basic", rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{TAIL}", "$1|$2|$3|$4|$5|$6|$7||$8|$9|$10"),
    ("day-month", rf"(?i)^(?:[A-Z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[ -]([A-Z]{{3,9}})[ -](\d{{4}}|\d{{2}})\s+{CLOCK}{TAIL}", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("slashes", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),?\s+{CLOCK}{TAIL}", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("month-day", rf"(?i)^(?:[A-Z]{{3,9}},\s*)?([A-Z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{CLOCK}{TAIL}", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|$11"),
]


def _wall_to_utc(local: Column, zone: Column) -> Column:
    """The instants (microseconds) at which clocks in `zone` show `local`: none, one or two, whatever a change's length.

    Clocks differ from UTC as they did a day before or as they do a day later.
    """
    shown = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))
    tried = [local - (shown(local + d) - (local + d)) for d in (-26 * HOUR, 26 * HOUR)]
    return F.array_sort(F.array_distinct(F.filter(F.array(*tried), lambda us: shown(us) == local)))


def _parts(text: Column) -> Column:
    """The parts of the first layout that fits, as an array of strings with the layout's name first."""
    tries = [F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, f"{name}|{order}"), r"\|", -1)) for name, pattern, order in LAYOUTS]
    return F.coalesce(*tries)


def with_readings(df: DataFrame, value: Column) -> DataFrame:
    """df with `_us` (instants), `_fmt` (a code of the notation for each) and `_stated` (the value names its zone).

    Text that is NULL, blank or no date with a time has no reading, nor has a date or time that does not exist or
    a wall clock time that a change of clocks skips. A repeated wall clock time has two. A value without a zone has a
    reading for each of ASSUMED; one that names a zone which is unknown has none, as it excludes those. An
    abbreviation of several zones has a reading for each. Bare numbers are seconds, from 12 digits on
    milliseconds; dates with slashes are month/day/year; abbreviations are fixed offsets; an offset next to a zone
    name decides. Fractions finer than microseconds are cut off.
    """
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    df = df.withColumn("_t", text).withColumn("_p", _parts(F.col("_t")))
    p = lambda i: F.when(F.col("_p")[i] != "", F.col("_p")[i])
    number = lambda i: p(i).try_cast("int")
    month = F.coalesce(number(2), reduce(lambda acc, m: acc.when(F.lower(F.substring(p(2), 1, 3)) == m[1], m[0] + 1), enumerate(MONTHS), F.when(F.lit(False), 0)))
    year = F.when(F.length(p(1)) == 2, F.when(number(1) < 70, 2000 + number(1)).otherwise(1900 + number(1))).otherwise(number(1))
    df = df.withColumn("_date", F.expr("null"))
    df = df.withColumns({"_y": year, "_m": month, "_d": number(3)})
    first = F.when((F.col("_y") >= 1) & F.col("_m").between(1, 12), F.make_date("_y", "_m", F.lit(1)))
    df = df.withColumn("_first", first)
    day = F.when((F.col("_d") >= 1) & (F.col("_d") <= F.day(F.last_day("_first"))), F.unix_date("_first") + F.col("_d") - 1)
    half = F.upper(p(8))
    hour = F.when(half.isNull(), F.when(number(4) <= 23, number(4))).when(number(4).between(1, 12), number(4) % 12 + F.when(half == "P", 12).otherwise(0))
    minute = F.when(number(5) <= 59, number(5))
    second = F.when(p(6).isNull(), 0).when(number(6) <= 59, number(6))
    micro = F.coalesce(F.rpad(F.substring(p(7), 1, 6), 6, "0").cast("long"), F.lit(0))
    local = ((day.cast("long") * 24 + hour) * 60 + minute) * 60_000_000 + second * F.lit(1_000_000) + micro
    zone = F.upper(p(9))
    table = F.create_map(*[x for name, hours in ABBREVIATIONS.items() for x in (F.lit(name), F.array(*[F.lit(int(h * 60)).cast("long") for h in (hours if isinstance(hours, tuple) else (hours,))]))])
    signed = F.regexp_replace(zone, "^(UTC|GMT)(?=[+-])", "")
    hh, mm = F.regexp_extract(signed, r"^[+-](\d{1,2})", 1).try_cast("int"), F.coalesce(F.regexp_extract(signed, r"^[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    minutes = F.when((hh <= 18) & (mm <= 59), (hh * 60 + mm) * F.when(signed.startswith("-"), -1).otherwise(1))
    offset = F.when(signed.rlike(r"^[+-]"), F.when(minutes.isNotNull(), F.array(minutes.cast("long")))).otherwise(F.try_element_at(table, zone))
    named = F.coalesce(p(10), p(11))
    region = named
    region = F.when(region.isin(sorted(zoneinfo.available_timezones())), region)
    df = df.withColumns({"_local": local, "_offset": offset, "_region": region, "_bad": F.coalesce(signed.rlike(r"^[+-]") & minutes.isNull(), F.lit(False)), "_named": zone.isNotNull() | named.isNotNull()})
    code = lambda *x: F.xxhash64(*x)
    reading = lambda us, fmt: F.transform(us, lambda u: F.struct(u.alias("us"), fmt.alias("fmt")))
    layout = F.col("_p")[0]
    by_offset = F.transform("_offset", lambda m: F.struct((F.col("_local") - m * 60_000_000).alias("us"), code(layout, F.lit("offset"), F.when(F.size("_offset") > 1, m)).alias("fmt")))
    by_region = reading(_wall_to_utc(F.col("_local"), F.col("_region")), code(layout, F.col("_region")))
    by_guess = F.flatten(F.array(*[reading(_wall_to_utc(F.col("_local"), F.lit(z)), code(layout, F.lit(z), F.lit("?"))) for z in ASSUMED]))
    bare = F.when(F.col("_t").rlike(r"^-?\d{1,18}(\.\d+)?$"), F.col("_t"))
    digits = F.length(F.regexp_extract(bare, r"^-?(\d+)", 1))
    whole = bare.try_cast("decimal(38,9)")
    scaled = F.when(digits >= 12, whole * 1000).otherwise(whole * 1_000_000)
    count = F.floor(scaled).try_cast("long")
    by_number = F.array(F.struct(count.alias("us"), code(F.lit("number"), digits >= 12).alias("fmt")))
    none = F.filter(by_number, lambda r: F.lit(False))
    found = F.when(count.isNotNull(), by_number).when(F.col("_local").isNull() | F.col("_bad"), none).when(F.col("_offset").isNotNull(), by_offset).when(F.col("_region").isNotNull(), by_region).when(F.col("_named"), none).otherwise(by_guess)
    df = df.withColumn("_r", F.coalesce(found, none)).withColumn("_stated", count.isNotNull() | F.col("_offset").isNotNull() | F.col("_region").isNotNull())
    return df.withColumns({"_us": F.transform("_r", lambda r: r["us"]), "_fmt": F.transform("_r", lambda r: r["fmt"])}).drop("_t", "_p", "_date", "_y", "_m", "_d", "_first", "_local", "_offset", "_region", "_bad", "_named", "_r")


# ---- paths -----------------------------------------------------------------------------------------------------
# A node stands for a run of records: readings of its first record (ff, ft), of its last (lf, lt), and the costs of
# the best path from each first to each last reading (row after row).


def _step(lf, lt, ff, ft):
    """cost[p][a] of going from reading p of a record to reading a of the next."""
    return [[(SWITCH if x != y else 0.0) + (BACK if b < a else 0.0) for y, b in zip(ff, ft)] for x, a in zip(lf, lt)]


def _walk(nodes, begin: int | None):
    """Best costs to the last readings of the nodes in turn, with the way back: [(costs, [(entry, previous exit)])].

    begin: the reading of the first record to begin with, None for the best.
    """
    out = []
    costs: list[float] = []
    for k, (ff, ft, lf, lt, m) in enumerate(nodes):
        n, e = len(ff), len(lf)
        if k == 0:
            enter, via = [0.0 if begin is None or a == begin else float("inf") for a in range(n)], [0] * n
        elif n == 1 and len(costs) == 1:
            enter, via = [costs[0] + (SWITCH if plf[0] != ff[0] else 0.0) + (BACK if ft[0] < plt[0] else 0.0)], [0]
        else:
            step = _step(plf, plt, ff, ft)
            enter, via = [], []
            for a in range(n):
                best = min(range(len(costs)), key=lambda p: costs[p] + step[p][a])
                enter.append(costs[best] + step[best][a])
                via.append(best)
        if n == 1 and e == 1:
            costs, way = [enter[0] + m[0]], [(0, via[0])]
        else:
            costs, way = [], []
            for b in range(e):
                best = min(range(n), key=lambda a: enter[a] + m[a * e + b])
                costs.append(enter[best] + m[best * e + b])
                way.append((best, via[best]))
        out.append((costs, way))
        plf, plt = lf, lt
    return out


def summed(nodes):
    """One node for a run of nodes."""
    if all(len(n[0]) == 1 and len(n[2]) == 1 for n in nodes):
        return nodes[0][0], nodes[0][1], nodes[-1][2], nodes[-1][3], [_walk(nodes, None)[-1][0][0]]
    m = [c for a in range(len(nodes[0][0])) for c in _walk(nodes, a)[-1][0]]
    return nodes[0][0], nodes[0][1], nodes[-1][2], nodes[-1][3], m


def chosen(nodes, begin: int | None, end: int | None):
    """(entry, exit) reading of each node on the best path, with given ends where they are not None."""
    ways = _walk(nodes, begin)
    costs = ways[-1][0]
    at = min(range(len(costs)), key=lambda b: costs[b]) if end is None else end
    back = []
    for _, way in reversed(ways):
        entry, before = way[at]
        back.append((entry, at))
        at = before
    return back[::-1]


_NODE = "ff array<bigint>, ft array<bigint>, lf array<bigint>, lt array<bigint>, m array<double>"


def _nodes(pdf: pd.DataFrame):
    lists = [[x.tolist() for x in pdf[c]] for c in ("ff", "ft", "lf", "lt", "m")]
    return list(zip(*lists))


def _record_nodes(pdf: pd.DataFrame):
    out = []
    for f, t in zip(pdf["fmt"], pdf["us"]):
        f, t = f.tolist(), t.tolist()
        n = len(f)
        m = [0.0] if n == 1 else [0.0 if a == b else float("inf") for a in range(n) for b in range(n)]
        out.append((f, t, f, t, m))
    return out


def _sum_records(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    return pd.DataFrame([(*key, *summed(_record_nodes(pdf)))], columns=["source", "block", "ff", "ft", "lf", "lt", "m"])


def _sum_nodes(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    return pd.DataFrame([(*key, *summed(_nodes(pdf)))], columns=["source", "above", "ff", "ft", "lf", "lt", "m"])


def _choose_whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of several sources, each whole: their best readings."""
    pdf = pdf.sort_values("seq")
    out = []
    for _, own in pdf.groupby("source", sort=False):
        out += [int(t[a]) for t, (a, _) in zip(own["us"], chosen(_record_nodes(own), None, None))]
    return pd.DataFrame({"table": pdf["table"].to_numpy(), "record": pdf["record"].to_numpy(), "stated": pdf["stated"].to_numpy(), "n_readings": [len(t) for t in pdf["us"]], "utc_micros": out})


def _choose_top(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("above")
    ways = chosen(_nodes(pdf), None, None)
    return pd.DataFrame({"source": key[0], "above": pdf["above"].to_numpy(), "entry": [a for a, _ in ways], "exit": [b for _, b in ways]})


def _choose_nodes(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    ways = chosen(_nodes(pdf), int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]))
    return pd.DataFrame({"source": key[0], "block": pdf["block"].to_numpy(), "entry": [a for a, _ in ways], "exit": [b for _, b in ways]})


def _choose_records(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    ways = chosen(_record_nodes(pdf), int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]))
    us = [int(t[a]) for t, (a, _) in zip(pdf["us"], ways)]
    return pd.DataFrame({"table": pdf["table"].to_numpy(), "record": pdf["record"].to_numpy(), "stated": pdf["stated"].to_numpy(), "n_readings": [len(t) for t in pdf["us"]], "utc_micros": us})


def likeliest_readings(records: DataFrame) -> DataFrame:
    """(source_table, record_key, utc_micros, n_readings, determined) of records (table, record, source, place, value).

    source: the feed whose record order counts (NULL is one source of its own), place: sorts its records.
    utc_micros is the reading on the source's best path, NULL for a value without any; determined: the value
    names its zone and has one reading only, so it stands whatever the path.
    """
    # text is put in order before it is read: ranges are found by a pass of their own, which would read it once more
    rows = records.select("table", "record", F.coalesce("source", F.lit("")).alias("source"), "place", "value")
    rows = rows.repartitionByRange("source", "place", "record").sortWithinPartitions("source", "place", "record")
    rows = with_readings(rows.withColumn("seq", F.monotonically_increasing_id()), F.col("value"))
    rows = rows.select("table", "record", "source", "place", "seq", F.col("_us").alias("us"), F.col("_fmt").alias("fmt"), F.col("_stated").alias("stated"))
    rows = rows.withColumn("block", F.shiftright("seq", BLOCK_BITS)).withColumn("above", F.shiftright("seq", 2 * BLOCK_BITS)).drop("place")
    rows = materialise(records.sparkSession, rows, "readings")  # the numbering must be one and the same for all that follows
    read = rows.filter(F.size("us") > 0)
    # Python sees only sources with a choice to make: small ones many at once, the others block by block
    blocks = read.groupBy("source", "block").agg(F.max(F.size("us")).alias("most"))
    sources = blocks.groupBy("source").agg(F.max("most").alias("most"), F.count("*").alias("n_blocks"))
    kind = F.when(F.col("most") == 1, 0).when(F.col("n_blocks") == 1, 1).otherwise(2)
    kinds = materialise(records.sparkSession, blocks.select("source", "block").join(sources, "source").select("source", "block", kind.alias("kind")), "kinds")
    of = lambda k: read.join(kinds.filter(F.col("kind") == k).select("source", "block"), ["source", "block"])
    shown = "table string, record string, stated boolean, n_readings int, utc_micros bigint"
    clear = of(0).select("table", "record", "stated", F.size("us").alias("n_readings"), F.col("us")[0].alias("utc_micros"))
    small = of(1).withColumn("several", F.shiftright("seq", BLOCK_BITS + 4)).groupBy("several").applyInPandas(_choose_whole, shown)
    chain = of(2)
    nodes = chain.select("source", "block", "seq", "us", "fmt").groupBy("source", "block").applyInPandas(_sum_records, f"source string, block bigint, {_NODE}")
    nodes = materialise(records.sparkSession, nodes.withColumn("above", F.shiftright("block", BLOCK_BITS)), "nodes")
    tops = nodes.groupBy("source", "above").applyInPandas(_sum_nodes, f"source string, above bigint, {_NODE}")
    ends = tops.groupBy("source").applyInPandas(_choose_top, "source string, above bigint, entry int, exit int")
    inner = nodes.join(ends, ["source", "above"]).groupBy("source", "above").applyInPandas(_choose_nodes, "source string, block bigint, entry int, exit int")
    placed = read.join(inner, ["source", "block"]).groupBy("source", "block").applyInPandas(_choose_records, shown)
    placed = placed.unionByName(small).unionByName(clear)
    missing = rows.filter(F.size("us") == 0).select("table", "record", "stated", F.lit(0).alias("n_readings"), F.lit(None).cast("long").alias("utc_micros"))
    both = placed.unionByName(missing)
    return both.select(F.col("table").alias("source_table"), F.col("record").alias("record_key"), "utc_micros", "n_readings", (F.col("stated") & (F.col("n_readings") == 1)).alias("determined"))


#: Names of American zones in schedules, which mean the wall clock there.
AMERICAN = {
    "America/New_York": r"(?i)^(us/)?(et|est|edt|eastern)( (standard|daylight))?( time)?$",
    "America/Chicago": r"(?i)^(us/)?(ct|cst|cdt|central)( (standard|daylight))?( time)?$",
    "America/Denver": r"(?i)^(us/)?(mt|mst|mdt|mountain)( (standard|daylight))?( time)?$",
    "America/Los_Angeles": r"(?i)^(us/)?(pt|pst|pdt|pacific)( (standard|daylight))?( time)?$",
}


def kickoff_text() -> Column:
    """Date, clock and zone of a row of dim_game as one text; NULL without a clock. American zone names mean their wall clock."""
    clock, zone = F.trim("kickoff_local_time"), F.trim("kickoff_timezone")
    zone = reduce(lambda acc, x: acc.when(zone.rlike(x[1]), F.lit(x[0])), AMERICAN.items(), F.when(F.lit(False), "")).otherwise(zone)
    full = F.when(clock.rlike(r"^\d{4}-"), clock).otherwise(F.concat_ws(" ", F.trim("game_date"), clock))
    return F.when(clock != "", F.concat_ws(" ", full, zone))


def record_times(capture: DataFrame, events: DataFrame, games: DataFrame) -> DataFrame:
    """The rows for likeliest_readings of source_capture (pubDate), source_events and dim_game (kickoff).

    Records come in arrival order: capture_id, for events the instant of retrieved_at_utc (those without one first)
    and for games the schedule's order. A
    kickoff whose text has a date of its own needs no game_date.
    """
    a = capture.select(F.lit("source_capture").alias("table"), F.col("capture_id").cast("string").alias("record"), "source", F.lpad(F.col("capture_id").cast("string"), 20, "0").alias("place"), F.get_json_object("raw_feed_fields", "$.pubDate").alias("value"))
    b = events.select(F.lit("source_events").alias("table"), F.col("record_id").alias("record"), "source", F.coalesce(F.lpad((iso_micros(F.col("retrieved_at_utc")) + 2**61).cast("string"), 20, "0"), F.lit("")).alias("place"), F.col("raw_publication_timestamp").alias("value"))
    place = F.concat_ws(" ", F.trim("game_date"), "game_id")
    c = games.select(F.lit("dim_game").alias("table"), F.col("game_id").alias("record"), F.lit("schedule").alias("source"), place.alias("place"), kickoff_text().alias("value"))
    # one feed name in two tables is two sources
    rows = a.unionByName(b).unionByName(c)
    return rows.withColumn("source", F.concat_ws("/", "table", "source"))
