"""The general training-data operators: nulls, ties, repeated rows, empty tables, hot groups and clashing names."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import delivery, history, snapshot_diff, timestamps, trailing

CAPTURE = "capture_id bigint, source_event_id string, content_hash string, raw_feed_fields string, first_seen_at_utc string, batch_id string, seen string"


def capture(spark, data):
    return spark.createDataFrame([(*r, "x", "clash") for r in data], CAPTURE)


def test_dropped_deliveries(spark, rows):
    body, other = '{"title": "a", "guid": "1"}', '{"guid":"1","title":"a"}'
    data = [
        (1, "guid:A", "AB", body, "2024-01-02T00:00:00Z"),
        (2, " GUID:a\n", "ab", other, "2024-01-01T00:00:00+00:00"),  # the earliest of the three stays
        (3, "guid:a", None, other, "2024-01-03T00:00:00Z"),  # no hash: the values count
        (4, "guid:a", "cd", '{"title": "edited"}', "2024-01-01T00:00:00Z"),  # another content
        (5, None, "ab", body, "2024-01-01T00:00:00Z"),
        (6, None, "ab", body, "2024-01-01T00:00:00Z"),  # no identifier: no case
        (7, "  ", "ab", body, "2024-01-01T00:00:00Z"),
        (8, "b", None, None, None),
        (9, "b", None, None, None),  # neither hash nor values: copies; the smallest id stays
        (10, "c", "e", None, "2024-01-01T00:00:00Z"),
        (11, "c", "E", None, "2024-01-01T00:00:00.000000+00:00"),  # a tie
        (12, "c", "e", None, "not a time"),
    ]
    assert rows(delivery.dropped_deliveries(capture(spark, data))) == sorted([(1,), (3,), (9,), (11,), (12,)], key=lambda r: (True, str(r[0])))
    assert rows(delivery.dropped_deliveries(capture(spark, []))) == []


def test_store_is_idempotent_and_spreads_a_hot_message(spark, tmp_path):
    rows = delivery.deliveries(capture(spark, [(i, "hot", "h", None, f"2024-01-01T00:00:{i % 60:02d}Z") for i in range(1, 3001)]))
    store = delivery.SortedRunStore(spark, f"{tmp_path}/store", slices=8).upsert(rows).upsert(rows)
    per_slice = store.runs().groupBy("slice").count()
    assert per_slice.count() == 8 and per_slice.agg(F.max("count")).first()[0] < 2 * 2 * 3000 / 8
    store.compact()
    assert store.dropped().count() == 2999 and store.runs().collect()[0]["delivery"] == 60
    again = delivery.SortedRunStore(spark, f"{tmp_path}/store")  # opened again: what was merged is there, old runs are gone
    assert again.runs().count() == 1 and len(list((tmp_path / "store").glob("runs-*"))) == 1
    later = delivery.deliveries(capture(spark, [(9001, "hot", "h", None, "2023-01-01T00:00:00Z")]))
    again.upsert(later).upsert(rows).compact()
    assert again.runs().collect()[0]["delivery"] == 9001 and again.dropped().count() == 3000


def test_store_links_forms_over_compactions(spark, rows, tmp_path):
    body = '{"title": "a"}'
    batches = [
        [(1, "x", "h", body, "2024-01-02T00:00:00Z"), (2, "x", "h", body, "2024-01-01T00:00:00Z")],
        [(3, "x", None, body, "2024-01-03T00:00:00Z"), (4, "x", "h", None, "2024-01-05T00:00:00Z")],
        [(5, "x", None, None, "2024-01-01T00:00:00Z"), (6, "x", None, '{"title": "b"}', None)],
    ]
    store = delivery.SortedRunStore(spark, f"{tmp_path}/store", buckets=3)
    for b in batches:
        store.upsert(delivery.deliveries(capture(spark, b))).compact()
    assert rows(store.dropped()) == [(1,), (3,), (4,)]
    assert rows(delivery.dropped_deliveries(capture(spark, sum(batches, [])))) == [(1,), (3,), (4,)]


def plain_history(data):
    """Brute force of versions: {(entity, at): state}."""
    out, last = [], {}
    known = {r[:2] for r in data if any(v is not None for v in r[2:])}
    for e, at, *vals in sorted((r for r in data if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], [(v is not None, v or "") for v in r[2:]])):
        state = last.get(e, (None,) * len(vals))
        new = tuple(v if v is not None else s for v, s in zip(vals, state))
        if new != state or (e not in last and (e, at) not in known):
            out.append((e, at, *new))
            last[e] = new
    return out


def test_history_against_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", "hot", "hot", "hot", "hot", None]), rng.choice([None, *range(40_000)]), rng.choice(["x", "y", None]), rng.choice([None, None, "p", "q"])) for _ in range(9000)]
    data += data[:50]
    df = spark.createDataFrame(data, "entity string, at bigint, x string, y string").withColumn("block", F.lit(1))
    got = history.attribute_history(df, "entity", "at", {"x": F.col("x"), "y": F.col("y")}).collect()
    assert sorted(((r.entity, r.valid_from, r.x, r.y) for r in got), key=str) == sorted(plain_history(data), key=str)
    by = {}
    for r in sorted(got, key=lambda r: (r.entity, r.valid_from)):
        if r.entity in by and by[r.entity] is not None:
            assert by[r.entity] == r.valid_from
        by[r.entity] = r.valid_to
    assert all(v is None for v in by.values())


def test_history_of_a_hot_entity_is_split(spark, monkeypatch):
    monkeypatch.setattr(history, "RUN_BITS", 3)  # many runs of few blocks
    entity = F.when(F.col("id") % 50 == 0, F.concat(F.lit("e"), F.col("id"))).otherwise(F.lit("hot"))
    df = spark.range(200_000).select(entity.alias("entity"), "id", F.when(F.col("id") % 4 > 1, F.when(F.col("id") % 20 < 10, "x").otherwise("y")).alias("x"))
    got = history.attribute_history(df, "entity", "id", {"x": F.col("x")})
    hot = [tuple(r) for r in got.filter("entity = 'hot'").orderBy("valid_from").select("valid_from", "valid_to", "x").collect()]
    want = [r[1:] for r in plain_history([tuple(r) for r in df.filter("entity = 'hot'").collect()])]
    assert hot == [(a, b, x) for (a, x), b in zip(want, [*[a for a, _ in want[1:]], None])]
    assert got.filter("entity <> 'hot'").count() == 4000


def test_history_of_blank_and_missing_values(spark, rows):
    cols = "gsis_id string, report_status string, updated_at string"
    data = [("b", " ", "2024-01-02T00:00:00Z"), ("b", None, "2024-01-01T00:00:00Z"), ("c", None, "2024-01-01T00:00:00Z"), ("c", "Out", "2024-01-01T00:00:00Z")]
    data += [("a", None, "2024-01-01T00:00:00Z"), ("a", "out", "2024-01-02T00:00:00Z"), ("a", " OUT ", "2024-01-03T00:00:00+00:00"), ("a", "  ", "2024-01-04T00:00:00Z"), ("a", "Active", "2024-01-05T00:00:00.000000+00:00"), ("a", "x", None), (None, "x", "2024-01-05T00:00:00Z")]
    got = history.report_history(spark.createDataFrame(data, cols))
    assert [(r.entity, r.status, r.valid_to is None) for r in got.orderBy("entity", "valid_from").collect()] == [("a", None, False), ("a", "OUT", False), ("a", "ACTIVE", True), ("b", None, True), ("c", "OUT", True)]
    assert rows(history.report_history(spark.createDataFrame([], cols))) == []


STATS = "season bigint, week bigint, season_type string, player_id string, team string, passing_yards double, updated_at string, n_rows int"


def test_trailing_totals_fill_weeks_and_take_corrections(spark):
    data = [
        (2024, 1, "REG", "p", "A", 100.0, "2024-09-01T00:00:00Z", 1),
        (2024, 1, "REG", "p", "A", 300.0, "2024-09-02T00:00:00+00:00", 1),  # the correction counts
        (2024, 1, "REG", "p", "A", 300.0, "2024-09-02T00:00:00+00:00", 1),
        (2024, 4, "REG", "p", "A", float("nan"), "2024-09-01T00:00:00Z", 1),
        (2024, 5, "REG", "p", "A", 50.0, None, 1),
        (2024, 5, "POST", "p", "B", 5.0, "2024-09-01T00:00:00Z", 1),
        (2024, 2, "REG", None, "A", 900.0, "2024-09-01T00:00:00Z", 1),
        (2024, 2, "REG", " ", "A", 900.0, "2024-09-01T00:00:00Z", 1),
        (2025, 1, "REG", "p", "A", None, "2024-09-01T00:00:00Z", 1),
    ]
    got = {(r.season, r.week): (r.passing_yards, r.n_rows, r.passing_yards_sum_4, r.passing_yards_avg_4) for r in trailing.passing_form(spark.createDataFrame(data, STATS)).collect()}
    assert got == {(2024, 1): (300, 1, 300, 75), (2024, 2): (0, 0, 300, 75), (2024, 3): (0, 0, 300, 75), (2024, 4): (0, 1, 300, 75), (2024, 5): (55, 2, 55, 13.75), (2025, 1): (0, 1, 0, 0)}
    assert trailing.passing_form(spark.createDataFrame([], STATS)).count() == 0


SNAP, PRED = "snapshot_id string, captured_at_utc string, season int", "snapshot_id string, slate_slug string, player_id string, projection double, salary double, season int"


def test_snapshot_changes(spark, rows):
    snaps = [("s2", "2024-01-01T12:00:00+00:00", 1), ("s1", "2024-01-01T01:00:00Z", 1), ("s3", "2024-01-02T00:00:00Z", 1), ("s9", None, 1)]
    nan = float("nan")
    preds = [
        ("s1", "m", "a", 1.0, 10.0, 1), ("s1", "m", "a", 1.0, 10.0, 1), ("s1", "m", "b", nan, None, 1), ("s1", "m", "c", 2.0, 5.0, 1), ("s1", "m", "d", 2.0, 5.0, 1),
        ("s2", "m", "a", 1.0000001, 10.0, 1), ("s2", "m", "b", None, nan, 1), ("s2", "m", "c", 2.1, 5.0, 1), ("s2", "m", "e", 1.0, 1.0, 1), ("s2", "m", "e", 1.0, 1.0, 1),
        ("s3", "m", "a", None, 10.0, 1), ("s3", "m", "b", None, None, 1), ("s3", "m", "c", 2.1, 5.0, 1), ("s3", "m", "e", 1.0, 1.0, 1), ("s3", "m", None, 1.0, 1.0, 1), ("s9", "m", "z", 1.0, 1.0, 1), ("s3", "other", "z", 1.0, 1.0, 1),
    ]
    got = snapshot_diff.projection_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(preds, PRED)).select("snapshot_id", "player_id", "change_kind")
    assert rows(got) == [("s2", "c", "changed"), ("s2", "d", "removed"), ("s2", "e", "added"), ("s3", "a", "changed")]
    assert snapshot_diff.projection_changes(spark.createDataFrame([], SNAP), spark.createDataFrame([], PRED)).count() == 0


def test_residues_are_except_all_both_ways(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "z")], "k int, v string")
    old, new = snapshot_diff.residues(a, b)
    assert rows(old) == rows(a.exceptAll(b)) and rows(new) == rows(b.exceptAll(a))


def us(*a, zone="UTC"):
    return int(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000


READ = {
    "Sat, 02 Sep 2023 22:15:12 EST": us(2023, 9, 3, 3, 15, 12),
    "Sat, 02 Sep 2023 22:15:12 -0330": us(2023, 9, 3, 1, 45, 12),
    "Friday, 01-Dec-23 11:29:19 GMT": us(2023, 12, 1, 11, 29, 19),
    " 2023-09-03T05:44:35.123456789Z\n": us(2023, 9, 3, 5, 44, 35) + 123456,
    "2023-09-03 05:44:35,5+02:00": us(2023, 9, 3, 3, 44, 35) + 500000,
    "20230903T193247-0500": us(2023, 9, 4, 0, 32, 47),
    "1694011430": 1694011430000000,
    "1694011430.25": 1694011430250000,
    "1693969968397": 1693969968397000,
    "10/1/2023 12:05 AM PDT": us(2023, 10, 1, 7, 5),
    "December 11, 2024 at 12:52 p.m. PST": us(2024, 12, 11, 20, 52),
    "1 Dec 2023 08:55 UT": us(2023, 12, 1, 8, 55),
    "2023-03-11T23:24:23-06:00[America/Chicago]": us(2023, 3, 12, 5, 24, 23),
    "2023-11-05T01:30:00-06:00[America/Chicago]": us(2023, 11, 5, 7, 30),  # the offset decides
    "2023-10-19T21:41:37[America/Chicago]": us(2023, 10, 19, 21, 41, 37, zone="America/Chicago"),
    "2024-07-01 12:00:00 Europe/Berlin": us(2024, 7, 1, 10),
    "2024-02-29T00:00:00Z": us(2024, 2, 29),
    "Sat, 02 Sep 2023 22:15:12 CEST": us(2023, 9, 2, 20, 15, 12),
    "2024-04-07 02:30:00 Australia/Lord_Howe": us(2024, 4, 6, 16),  # clocks there change by half an hour
    "2023-09-30 23:00:00 Africa/Casablanca": us(2023, 9, 30, 22),
}
UNREAD = ["2023-02-30T06:15:00Z", "Sun, 31 Jun 2023 00:40:00 GMT", "2023-13-07T15:40:00Z", "0000-00-00 00:00:00", "2023-09-06", "TBD", "yesterday", "", "  ", None, "2023-01-01T24:00:00Z", "2023-01-01T10:60:00Z", "13:00", "2023-03-12T02:03:53[America/New_York]", "2023-01-01T00:00:00+99:00", "13/01/2023 1:00 PM PST", "1/1/2023 13:00 PM PST", "2023-02-29T00:00:00Z", "x" * 100_000]


def test_readings(spark):
    values = [*READ, *UNREAD, "2023-11-05 01:15:00 America/Chicago", "2023-11-05 12:00:00", "2023-11-05 12:00:00 Nowhere/City", "2023-11-05 12:00:00 XYZ", "2024-04-07 01:45:00 Australia/Lord_Howe", "2024-10-06 02:15:00 Australia/Lord_Howe", "2024-01-01 00:00:00 IST"]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "i int, value string, _x int")
    got = {r.value: (list(r._us), r._stated) for r in timestamps.with_readings(df, F.col("value")).collect()}
    for text, want in READ.items():
        assert got[text] == ([want], True), text
    for text in UNREAD:
        assert got[text][0] == [], text
    two = got["2023-11-05 01:15:00 America/Chicago"]
    assert two == ([us(2023, 11, 5, 6, 15), us(2023, 11, 5, 7, 15)], True)
    assert len(got["2023-11-05 12:00:00"][0]) == 5 and not got["2023-11-05 12:00:00"][1]
    assert got["2023-11-05 12:00:00 Nowhere/City"] == ([], False) and got["2023-11-05 12:00:00 XYZ"] == ([], False)  # a zone is named, but which
    assert got["2024-04-07 01:45:00 Australia/Lord_Howe"][0] == [us(2024, 4, 6, 14, 45), us(2024, 4, 6, 15, 15)] and got["2024-10-06 02:15:00 Australia/Lord_Howe"][0] == []
    assert len(got["2024-01-01 00:00:00 IST"][0]) == 3


def test_share_of_right_readings(spark):
    """Planted sources in one zone each, three in ten values with a zone: the path finds the zone of the others."""
    rng = random.Random(11)
    zones = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "UTC"]
    data, truth = [], {}
    for k in range(30):
        zone, at = ZoneInfo(zones[k % 5]), datetime(2023, 10, 20, tzinfo=UTC)
        for i in range(200):
            at += timedelta(minutes=rng.randint(1, 60))
            text = at.strftime("%Y-%m-%dT%H:%M:%SZ") if rng.random() < 0.3 else at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S")
            data.append(("t", f"{k}-{i}", f"s{k}", f"{i:04d}", text))
            truth[f"{k}-{i}"] = int(at.timestamp()) * 1_000_000
    got = {r.record_key: r for r in timestamps.likeliest_readings(spark.createDataFrame(data, "table string, record string, source string, place string, value string")).collect()}
    bare = [k for k in truth if not got[k].determined]
    right = sum(got[k].utc_micros == truth[k] for k in bare) / len(bare)
    print(f"right readings of values without a zone: {right:.4f} of {len(bare)}")
    assert right >= 0.97


def brute_path(chain):
    """Least cost and reading of one chain of [(fmt, us), ...] lists."""
    best = [(0.0, [c]) for c in chain[0]]
    for cand in chain[1:]:
        best = [min(((cost + (timestamps.SWITCH if p[-1][0] != c[0] else 0) + (timestamps.BACK if c[1] < p[-1][1] else 0), [*p, c]) for cost, p in best), key=lambda x: x[0]) for c in cand]
    return min(x[0] for x in best)


def cost_of(path):
    return sum((timestamps.SWITCH if a[0] != b[0] else 0) + (timestamps.BACK if b[1] < a[1] else 0) for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_block_paths_cost_what_one_path_costs(seed):
    rng = random.Random(seed)
    chain = [[(rng.randrange(3), rng.randrange(100)) for _ in range(rng.choice([1, 1, 2, 4]))] for _ in range(60)]
    nodes = []
    for cand in chain:
        f, t = [c[0] for c in cand], [c[1] for c in cand]
        nodes.append((f, t, f, t, [0.0 if a == b else float("inf") for a in range(len(f)) for b in range(len(f))]))
    blocks = [nodes[i : i + 7] for i in range(0, 60, 7)]
    sums = [timestamps.summed(b) for b in blocks]
    ends = timestamps.chosen(sums, None, None)
    path = [chain[7 * k + i][a] for k, (b, (entry, out)) in enumerate(zip(blocks, ends)) for i, (a, _) in enumerate(timestamps.chosen(b, entry, out))]
    assert abs(cost_of(path) - brute_path(chain)) < 1e-9


def test_likeliest_readings_follow_the_source(spark):
    """A source that never names its zone but once is read in one zone, the one that fits its neighbours."""
    base = datetime(2023, 10, 1, 12, 0, 0, tzinfo=UTC)
    data = [("t", str(i), "s", f"{i:06d}", (base + timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S")) for i in range(3000)]
    data += [("t", "stated", "s", "999999", "2023-10-03T15:00:00Z"), ("t", "none", "s", "5", None), ("t", "alone", None, "1", "2023-01-01T00:00:00Z")]
    got = {r.record_key: r for r in timestamps.likeliest_readings(spark.createDataFrame(data, "table string, record string, source string, place string, value string")).collect()}
    assert len(got) == 3003
    offsets = {got[str(i)].utc_micros - us(2023, 10, 1, 12, 0, 0) - i * 60_000_000 for i in range(3000)}
    assert len(offsets) == 1 and not got["5"].determined
    assert got["stated"].determined and got["alone"].determined and got["none"].utc_micros is None and not got["none"].determined


def test_kickoffs(spark):
    games = [("a", "2023-10-01", "1:00p", "Eastern"), ("b", "2023-10-01", "2023-10-02 13:00:00", "-05:00"), ("c", "2023-10-01", "13:00", "local"), ("d", "2023-10-01", None, "ET"), ("e", "2023-11-05", "01:30", "ET"), ("f", "2023-10-01", "13:00 -04:00", "America/Los_Angeles"), ("g", "2023-10-01", "12:00 PM", None), ("h", None, "13:00", "ET")]
    g = spark.createDataFrame(games, "game_id string, game_date string, kickoff_local_time string, kickoff_timezone string")
    none = spark.createDataFrame([], "capture_id bigint, source string, raw_feed_fields string"), spark.createDataFrame([], "record_id string, source string, retrieved_at_utc string, raw_publication_timestamp string")
    got = {r.record_key: r.utc_micros for r in timestamps.likeliest_readings(timestamps.record_times(*none, g)).filter("determined").collect()}
    assert got == {"a": us(2023, 10, 1, 17), "b": us(2023, 10, 2, 18), "f": us(2023, 10, 1, 17)}


def test_small_and_large_sources_are_read_alike(spark):
    """Sources of one block, of several and without any choice together: each costs what one path over it costs."""
    rng = random.Random(9)
    base = datetime(2023, 10, 1, tzinfo=UTC)
    sizes = {"large": 2500, "clear": 30, **{f"small{i}": 20 for i in range(30)}}
    data = [("t", f"{s}-{i}", s, f"{i:06d}", (base + timedelta(minutes=90 * i)).strftime("%Y-%m-%d %H:%M:%S") + ("Z" if s == "clear" or rng.random() < 0.5 else "")) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "table string, record string, source string, place string, value string")
    got = {r.record_key: r.utc_micros for r in timestamps.likeliest_readings(df).collect()}
    assert len(got) == len(data)
    options = {r.record: list(zip(r._fmt, r._us)) for r in timestamps.with_readings(df, F.col("value")).select("record", "_fmt", "_us").collect()}
    for s, n in sizes.items():
        chain = [options[f"{s}-{i}"] for i in range(n)]
        # an instant may stand for readings of several notations: the cheapest path through the chosen instants
        taken = [[c for c in cand if c[1] == got[f"{s}-{i}"]] for i, cand in enumerate(chain)]
        assert all(taken) and abs(brute_path(taken) - brute_path(chain)) < 1e-9, s
