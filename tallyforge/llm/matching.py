"""Matching of entities without a common key: a cascade of exact joins on weaker and weaker attributes.

Every rule builds keys from a record's attributes on both sides. A key that belongs to one entity only resolves
the records that carry it; resolved records leave the cascade before the next rule. A rule's confidence is its
smoothed precision on the labelled records that it applies to, where a labelled record also counts as one whose entity is
not in the master: what the rule would answer without that entity is a mistake.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import unaccented
from tallyforge.functions.times import iso_micros
from tallyforge.session import materialise, scratch_path

UNKNOWN = 0.05  # share of records taken to name an entity that the master does not hold
PRIOR, WEIGHT = 0.8, 10.0  # precision of a rule without labelled records, and how many records that belief weighs
LABELLED = 20_000  # labelled records (about, chosen by hash) on which precision is measured, whatever the tables' size
LEAST = 0.6  # p6_found gives matches of at least this confidence; p6_matches gives all

SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once: the planner copies a plain expression to every place it is used."""
    return F.transform(F.array(value), then)[0]


def folded(name: Column) -> Column:
    """Lower case without marks, points, apostrophes and outer blanks; `Last, First` is turned round."""
    bare = F.regexp_replace(F.lower(F.translate(_let(name, unaccented), ".'`‘’ʼ", "")), r"[^\p{L}\p{N},]+", " ")

    def turned(text: Column) -> Column:
        suffixed = text.rlike(rf",\s*({'|'.join(SUFFIXES)})\s*$")
        text = F.when(suffixed, text).otherwise(F.regexp_replace(text, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1"))
        return F.regexp_replace(text, r"[\s,]+", " ")

    return _let(bare, lambda t: F.nullif(F.trim(F.when(t.contains(","), turned(t)).otherwise(t)), F.lit("")))


def name_parts(df: DataFrame, name: Column) -> DataFrame:
    """df's distinct rows with first, last (without blanks), whole (both) and suffix ('' for none) of a name.

    Rows without a name are left out. Names are folded once each: the distinct rows stand between that and the
    parts, else the planner would fold a name again for every part.
    """
    df = df.withColumn("_n", folded(name)).filter("_n is not null").distinct().withColumn("_w", F.split("_n", " "))
    has = F.element_at("_w", -1).isin(SUFFIXES) & (F.size("_w") > 1)
    df = df.withColumn("suffix", F.when(has, F.element_at("_w", -1)).otherwise("")).withColumn("first", F.col("_w")[0])
    df = df.withColumn("last", F.array_join(F.slice("_w", 2, F.size("_w") - F.when(F.col("suffix") != "", 2).otherwise(1)), ""))
    return df.withColumn("whole", F.concat("first", "last")).drop("_n", "_w")


def consonants(word: str) -> Column:
    """The first letter and the consonants after it, repeated ones once: what several slips mostly leave alone."""
    return F.concat(F.substring(word, 1, 1), F.regexp_replace(F.translate(F.expr(f"substring({word}, 2)"), "aeiouy", ""), r"(.)\1+", "$1"))


@dataclasses.dataclass(frozen=True)
class Rule:
    """name: how names are compared; team, position: 'now' (the entity's last), 'ever' or 'any'."""

    name: str
    team: str = "any"
    position: str = "any"

    @property
    def title(self) -> str:
        return f"{self.name}+team:{self.team}+position:{self.position}"

    @property
    def family(self) -> tuple[str, str]:
        """What the rule's join is on: how names are compared, and the place that goes with them. Rules may share it."""
        kind = {"whole+suffix": "whole", "initial+last": "initial", "initial+last+suffix": "initial"}.get(self.name, self.name)
        return kind, "team" if self.team != "any" else "position" if self.position != "any" else "none"

    def agrees(self) -> Column:
        """What a pair of one key must have besides: of the record suffix and position, of the master m_suffix and so on."""
        out = F.col("m_suffix") == F.col("suffix") if self.name.endswith("suffix") else F.lit(True)
        out = out & F.col("m_now_team") if self.team == "now" else out
        out = out & F.col("m_now_position") if self.position == "now" else out
        return out & (F.col("m_position") == F.col("position")) if self.family[1] == "team" and self.position != "any" else out

    def applies(self) -> Column:
        """Initials are compared only where a record has no more than an initial."""
        short = F.length("first") == 1
        return short if self.name.startswith("initial") else ~short if self.name.startswith(("slip", "consonants")) else F.lit(True)


RULES = [
    Rule("whole+suffix", "now", "now"),
    Rule("whole", "now", "now"),
    Rule("whole+suffix", "ever", "ever"),
    Rule("whole", "ever", "ever"),
    Rule("whole", "ever"),
    Rule("initial+last+suffix", "now", "now"),
    Rule("initial+last", "now", "now"),
    Rule("slip in first", "now", "now"),
    Rule("slip in last", "now", "now"),
    Rule("whole+suffix", "any", "ever"),
    Rule("whole", "any", "ever"),
    Rule("initial+last", "ever", "ever"),
    Rule("slip in first", "ever", "ever"),
    Rule("slip in last", "ever", "ever"),
    Rule("consonants", "ever", "ever"),
    Rule("slip in first", "ever"),
    Rule("slip in last", "ever"),
    Rule("initial+last", "ever"),
    Rule("whole"),
    Rule("slip in first", "any", "ever"),
]


#: Rules by number that are joined at once; between the waves resolved records leave the cascade. A rule of a later
#: wave is weaker than all of those before.
WAVES = [range(0, 5), range(5, 18), range(18, 20)]
PROFILE = ["first", "last", "whole", "suffix", "team", "position"]


def keyed(df: DataFrame, kind: str, place: str) -> DataFrame:
    """df's rows with `key` for a family of rules, one for each way to write the name; none where an attribute is missing.

    For a slip of the pen that is the word and what is left of it without each of its letters: words one slip apart
    have one of these in common.
    """
    rows = df.filter("last != ''")
    if place != "none":
        rows = rows.filter(F.col(place).isNotNull())
    if kind.startswith("slip"):
        word, other = ("first", "last") if kind == "slip in first" else ("last", "first")
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(F.length(word) >= 3, F.length(word)).otherwise(0))))
        a, b = F.concat(F.substring(word, F.lit(1), F.col("_i") - 1), F.substring(word, F.col("_i") + 1, F.length(word))), F.col(other)
    elif kind == "consonants":
        a, b = consonants("first"), consonants("last")
    else:
        a, b = (F.substring("first", 1, 1), F.col("last")) if kind == "initial" else (F.col("whole"), F.lit(""))
    key = F.xxhash64(F.lit(f"{kind} by {place}"), a, b, F.col(place) if place != "none" else F.lit(""))
    return rows.withColumn("key", key).drop("_i")


def cascade(records: DataFrame, master: DataFrame, rules: list[Rule] = RULES, waves: list[range] = WAVES, unknown: float = UNKNOWN) -> DataFrame:
    """(record, entity, rule, confidence) of the records that a rule resolves.

    records: record (unique, not NULL), truth (entity for labelled records, else NULL), name parts, team, position.
    master: entity, name parts, team, position, now_team, now_position (whether these are the entity's last), any
    number of rows per entity. Attributes that are NULL match nothing. A record whose keys lead to several
    entities is left to the next rule. Labelled records take part in every rule, and are not returned.

    Records that agree in all attributes are one profile, so a name that very many records share is asked once per
    team and position. Entities and profiles are numbers meanwhile. The rules of a wave are joined together, those of
    one family by the same keys; of the rules that resolve a profile the first counts, which is what anti-joins between
    them would leave.
    """
    spark = records.sparkSession
    master = materialise(spark, master, "master")
    entities = master.select("entity").filter("entity is not null").distinct().withColumn("eid", F.monotonically_increasing_id())
    entities = materialise(spark, entities, "entities")  # the numbers must stay the same
    # one row per name and place, whatever the number of entities that share it: the first and the last are all that is needed
    ends = F.min("eid").alias("low"), F.max("eid").alias("high")
    side = materialise(spark, master.join(entities, "entity").groupBy(*PROFILE, "now_team", "now_position").agg(*ends), "numbered")
    truth = records.filter("truth is not null").select("truth", *PROFILE).join(entities.select(F.col("entity").alias("truth"), "eid"), "truth", "left")
    marked = truth.select(F.lit(True).alias("marked"), F.coalesce("eid", F.lit(-1)).alias("truth"), *PROFILE)
    asking = records.filter("truth is null").select(*PROFILE).distinct().select(F.lit(False).alias("marked"), F.lit(-2).cast("long").alias("truth"), *PROFILE)
    asking = materialise(spark, asking.unionByName(marked).withColumn("profile", F.monotonically_increasing_id()), "profiles")
    path, fields = scratch_path(spark, "hits"), "profile bigint, marked boolean, truth bigint, rule int, low bigint, high bigint"
    done = scratch_path(spark, "resolved")
    for n, wave in enumerate(waves):
        families = list(dict.fromkeys(rules[i].family for i in wave))
        pending = asking.join(spark.read.schema("profile bigint").parquet(done), "profile", "left_anti") if n else asking
        held, tried = [], []
        for f, family in enumerate(families):
            mine = [rules[i] for i in wave if rules[i].family == family]
            used = {"suffix": any(r.name.endswith("suffix") for r in mine), "position": family[1] == "team", "now_team": any(r.team == "now" for r in mine), "now_position": any(r.position == "now" for r in mine)}
            shown = [(F.col(c) if used[c] else F.lit(None).cast(dict(side.dtypes)[c])).alias(f"m_{c}") for c in used]
            own = keyed(side, *family).select("key", "low", "high", *shown)
            if not family[0].startswith("slip"):  # different names that share a slip are few; rows of other keys may be many
                own = own.groupBy("key", *[f"m_{c}" for c in used]).agg(F.min("low").alias("low"), F.max("high").alias("high"))
            held.append(own)
            applies = reduce(lambda a, b: a | b, [r.applies() for r in mine])
            tried.append(keyed(pending.filter(applies), *family).select("key", "profile", "marked", "truth", "suffix", "position", "first", F.lit(f).alias("family")))
        held, tried = (reduce(DataFrame.unionByName, x) for x in (held, tried))
        bounds = []
        for i in wave:
            fits = (F.col("family") == families.index(rules[i].family)) & rules[i].applies() & rules[i].agrees()
            bounds += [F.min(F.when(fits, F.col("low"))).alias(f"low_{i}"), F.max(F.when(fits, F.col("high"))).alias(f"high_{i}")]
        hits = tried.join(held, "key").groupBy("profile", "marked", "truth").agg(*bounds)
        each = F.inline(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"low_{i}").alias("low"), F.col(f"high_{i}").alias("high")) for i in wave]))
        hits.select("profile", "marked", "truth", each).filter("low is not null").write.mode("append").parquet(f"{path}/wave={n}")
        if n + 1 < len(waves):
            now = spark.read.schema(fields).parquet(f"{path}/wave={n}").filter("not marked and low = high").select("profile").distinct()
            now.write.mode("append").parquet(done)
    hits = spark.read.schema(fields).parquet(*[f"{path}/wave={n}" for n in range(len(waves))])
    one = F.col("low") == F.col("high")
    right = one & (F.col("low") == F.col("truth"))
    # without its own entity, a record that led to two would lead to the other
    fooled = (one & ~right) | (~one & ((F.col("low") == F.col("truth")) | (F.col("high") == F.col("truth"))))
    seen = {r["rule"]: r for r in hits.filter("marked").groupBy("rule").agg(F.count_if(right).alias("right"), F.count_if(one & ~right).alias("wrong"), F.count_if(fooled).alias("fooled")).collect()}  # a row per rule
    table = []
    for i, rule in enumerate(rules):
        r, w, f = (seen[i]["right"], seen[i]["wrong"], seen[i]["fooled"]) if i in seen else (0, 0, 0)
        table.append((F.lit(rule.title), F.lit((r + PRIOR * WEIGHT) / (r + w + unknown * f + WEIGHT))))
    solved = hits.filter(~F.col("marked") & one).groupBy("profile").agg(F.min(F.struct("rule", F.col("low").alias("eid"))).alias("b")).select("profile", "b.*").join(entities, "eid")
    known = solved.join(asking.select("profile", *PROFILE), "profile")
    same = [records[c].eqNullSafe(known[c]) for c in PROFILE]
    out = records.filter("truth is null").join(known, reduce(lambda a, b: a & b, same)).select(records["record"], "entity", "rule")
    at = lambda k: F.element_at(F.array(*[t[k] for t in table]), F.col("rule") + 1)
    return out.select("record", "entity", at(0).alias("rule"), at(1).alias("confidence"))


def _position(col: Column) -> Column:
    text = F.upper(F.trim(col))
    return F.when(text == "FB", "RB").when(text != "", text)


def identity_rows(identity: DataFrame) -> DataFrame:
    """player_identity as the master: every name with the team and position it was seen with, and with the last ones.

    now_team and now_position say which rows have an entity's last team and position. Names and places are not all
    paired: an entity has a row for each combination that was seen, and one for each name at its last place.
    """
    rows = identity.select(
        F.col("gsis_id").alias("own"), F.coalesce("identity_key", F.concat(F.lit("GSIS:"), F.col("gsis_id"))).alias("who"), F.array_distinct(F.array(F.trim("full_name"), F.trim("football_name"))).alias("name"),
        F.nullif(F.upper(F.trim("latest_team")), F.lit("")).alias("team"), _position(F.col("position")).alias("position"), iso_micros(F.col("updated_at")).alias("at"),
    ).filter("who is not null")
    seen = rows.withColumn("name", F.explode("name")).groupBy("who", "name", "team", "position").agg(F.max("at").alias("at"), F.max("own").alias("own"))
    seen = materialise(identity.sparkSession, seen, "seen")
    named = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c]
    last = seen.groupBy("who").agg(F.max("own").alias("entity"), named("team").alias("last_team"), named("position").alias("last_position")).filter("entity is not null")
    parts = materialise(identity.sparkSession, name_parts(seen.select("who", "name"), F.col("name")).filter("whole != ''"), "names")
    # a name without its suffix is the same player's; the suffix seen in another of his names belongs to it
    last = last.join(parts.groupBy("who").agg(F.max("suffix").alias("suffix")), "who")
    names = parts.select("who", "name", "first", "last", "whole")
    there = seen.select("who", "name", "team", "position").join(names, ["who", "name"]).drop("name")
    here = names.drop("name").join(last.select("who", F.col("last_team").alias("team"), F.col("last_position").alias("position")), "who")
    out = there.unionByName(here).distinct().join(last, "who")
    return out.select("entity", "first", "last", "whole", "suffix", "team", "position", F.coalesce(F.col("team") == F.col("last_team"), F.lit(False)).alias("now_team"), F.coalesce(F.col("position") == F.col("last_position"), F.lit(False)).alias("now_position"))


def canonical_teams(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (team, opponent, game AWY@HOM) with `team` in the codes of games: of the two, the one not the opponent's.

    Where neither of a row's codes is the game's, the code is what it mostly stands for in other rows.
    """
    away, home = F.upper(F.trim(F.split_part("game", F.lit("@"), F.lit(1)))), F.upper(F.trim(F.split_part("game", F.lit("@"), F.lit(2))))
    team, opponent = F.upper(F.trim("team")), F.upper(F.trim("opponent"))
    sure = F.when(team.isin(away, home), team).when(opponent == away, home).when(opponent == home, away)
    rows = rows.withColumn("_t", team).withColumn("_sure", F.when(sure != "", sure))
    votes = rows.filter("_sure is not null and _t is not null").groupBy("_t", "_sure").count()
    votes = votes.groupBy("_t").agg(F.max_by("_sure", F.struct("count", "_sure")).alias("_voted"))
    return rows.join(votes, "_t", "left").withColumn("team", F.coalesce("_sure", "_voted", "_t")).drop("_t", "_sure", "_voted")


def list_rows(players: DataFrame) -> DataFrame:
    """fanduel_players_list as records, one per distinct id and spelling; defences (D, DEF, DST) are left out."""
    rows = players.withColumn("position", _position(F.col("position"))).filter("id is not null and coalesce(position, '') not in ('D', 'DEF', 'DST')")
    rows = canonical_teams(rows, rows)
    full = F.when(F.trim("nickname") != "", F.col("nickname")).otherwise(F.concat_ws(" ", F.trim("first_name"), F.trim("last_name")))
    rows = rows.select("id", F.regexp_extract("position", r"^([A-Z]+)", 1).alias("position"), "team", full.alias("name"))
    rows = name_parts(rows, F.col("name"))
    rows = rows.select("id", "first", "last", "whole", "suffix", "team", "position").distinct()
    return rows.withColumn("record", F.concat_ws("\u0001", "id", F.xxhash64("first", "last", "suffix", "team", "position").cast("string"))).withColumn("truth", F.lit(None).cast("string"))


def labelled_rows(stats: DataFrame, injuries: DataFrame, most: int = LABELLED) -> DataFrame:
    """Records whose entity is known: names, short and long, of box scores and injury reports with their gsis_id."""
    a = stats.select(F.col("player_id").alias("truth"), F.explode(F.array("player_name", "player_display_name")).alias("name"), "team", "position")
    c = injuries.select(F.col("gsis_id").alias("truth"), F.col("player_name").alias("name"), "team", "position")
    rows = a.unionByName(c).filter("truth is not null and name is not null")
    # about `most` of the distinct rows, chosen by hash before any shuffle and before any name is taken apart
    mark = F.xxhash64("truth", "name", "team", "position")
    counted = rows.agg(F.approx_count_distinct(mark)).first()[0]
    rows = rows.filter(F.pmod(mark, F.lit(1 << 40)) / float(1 << 40) < min(1.0, most / max(1, counted))).distinct()
    spaced = F.regexp_replace("name", r"^(\S)\.\s*", "$1. ")  # `F.Last` of the box scores
    rows = rows.select("truth", spaced.alias("name"), F.upper(F.trim("team")).alias("team"), _position(F.col("position")).alias("position"))
    rows = name_parts(rows, F.col("name")).select("truth", "first", "last", "whole", "suffix", "team", "position").distinct()
    return rows.withColumn("record", F.concat_ws("\u0001", F.lit("label"), "truth", F.xxhash64("first", "last", "suffix", "team", "position").cast("string")))


def matched_players(players: DataFrame, identity: DataFrame, stats: DataFrame, injuries: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, gsis_id, rule, confidence): a row for each id with a match of at least `least` confidence.

    Of an id spelled in several ways the most confident match holds (ties: the earlier rule, then the greater
    gsis_id). Rows without id, without any name, and defences have none; empty tables give none.
    """
    spark = players.sparkSession
    columns = ["record", "truth", *PROFILE]
    records = list_rows(players).select(columns).unionByName(labelled_rows(stats, injuries).select(columns))
    found = cascade(materialise(spark, records, "records"), identity_rows(identity)).filter(F.col("confidence") >= least)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(RULES) for x in (r.title, -i)])
    best = found.withColumn("id", F.split_part("record", F.lit("\u0001"), F.lit(1))).groupBy("id").agg(F.max(F.struct("confidence", order[F.col("rule")].alias("place"), "entity", "rule")).alias("b"))
    return best.select("id", F.col("b.entity").alias("gsis_id"), "b.rule", "b.confidence")
