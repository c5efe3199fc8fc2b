"""The training-text operators: exact round trips, brute force and held-out accuracy."""

import json
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from tallyforge.llm import encoding, languages, matching, mixing  # noqa: E402

TEXTS = [None, "", " ", "\n\n  \t", "Hello world", "<|endoftext|> plain", "a" * 3000, "naïve café — 日本語のテキスト。", "x​y  z", "  leading and trailing  ", "🙂🙃 é \U0001f468‍\U0001f469‍\U0001f467", "I'm you're they'll 12,345.67", "\r\n mixed \r lines\n"]


def library_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_other_library(spark):
    data = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(4, "Hello world", "clash", 1), (None, "null key", "x", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, key string, out int")
    got = encoding.encoded(df).collect()
    want = library_ids([d[1] for d in data])
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(d[0]), w) for d, w in zip(data, want))
    assert encoding.roundtrip(df).filter("not same").count() == 0
    assert encoding.encoded(df.limit(0)).count() == 0
    assert encoding.token_counts(df).filter("doc_id = 0").first()["n_tokens"] == 0


def test_long_texts_are_cut_where_ids_stay_the_same():
    rng = random.Random(1)
    words = ["don't", "  ", "\n\n", "日本", "x" * 50, "12", "!?", " a", "\t\t b ", "é", "word "]
    text = "".join(rng.choice(words) for _ in range(60_000))
    assert len(list(encoding.pieces(text, 1000))) > 50 and "".join(encoding.pieces(text, 1000)) == text
    whole = encoding.load().encode_ordinary(text)
    assert [i for p in encoding.pieces(text, 1000) for i in encoding.encode(p)] == whole == encoding.encode(text)
    assert encoding.decode(whole) == text
    assert list(encoding.pieces("y" * 5000, 1000)) == ["y" * 5000]
    chars = "ab1２ \t\u3000\x1c\x85'!_-。」é日²½\u0301🏈sdmtlvre"
    for seed in range(60):  # any cut leaves the ids as they are
        text = "".join(random.Random(seed).choices(chars, k=300))
        assert [i for p in encoding.pieces(text, 3) for i in encoding.load().encode_ordinary(p)] == encoding.load().encode_ordinary(text)
    assert len(list(encoding.pieces("日本語。" * 5000, 1000))) > 15  # no blanks needed
    assert encoding.decode(encoding.encode("日本語")[:-1])  # a cut character does not raise


def test_pivot_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    sizes, shares = rng.integers(1, 100, 40).astype(float), np.full(40, 0.3)
    runs = np.array([mixing.pivot_round(sizes, shares, rng.random(40))[0] for _ in range(4000)])
    assert np.allclose((runs * sizes).sum(axis=1), (shares * sizes).sum())
    assert (((runs < 1e-9) | (runs > 1 - 1e-9)).sum(axis=1) >= 39).all()
    assert np.abs(runs.mean(axis=0) - 0.3).max() < 0.04


def mix(spark, rows, targets, **more):
    sized = spark.createDataFrame(rows, "record bigint, source string, size bigint, copies int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    copies, shares = mixing.mixed(sized, t, **more)
    return copies.collect(), {r.source: r for r in shares.collect()}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None, "untargeted"]), rng.choice([0, 5, 50, 500, None]), 7) for i in range(50_000)]
    copies, shares = mix(spark, rows, [("hot", 0.5, 1), ("a", 0.3, 2), ("b", 0.2, 4), ("zero", 0.0, 2), (None, 0.1, 2)])
    assert set(shares) == {"hot", "a", "b"}
    assert all(abs(r.actual_share - r.target_share) < 0.002 for r in shares.values())
    repeats = {"hot": 1, "a": 2, "b": 4}
    assert all(1 <= r.copies <= repeats[r.source] and r.size > 0 for r in copies) and len({r.record for r in copies}) == len(copies)
    assert copies and sorted(copies) == sorted(mix(spark, rows[::-1], [("hot", 0.5, 1), ("a", 0.3, 2), ("b", 0.2, 4)])[0])  # partitioning does not matter
    for r in shares.values():
        assert r.used == sum(c.size * c.copies for c in copies if c.source == r.source)


def test_mix_edges(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0] == []
    assert mix(spark, [(1, "a", 5, 0)], [])[0] == []
    copies, shares = mix(spark, [(1, "a", 5, 0), (2, "a", 5, 0)], [("a", 0.5, 2), ("b", 0.5, 2)], strict=True)
    assert copies == [] and shares["a"].actual_share == 0  # b has nothing to give
    copies, shares = mix(spark, [(i, s, 5, 0) for i, s in enumerate("aaaacc")], [("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 1)])
    assert len(copies) == 6 and shares["b"].actual_share == 0 and abs(shares["a"].actual_share - 2 / 3) < 1e-9
    copies, shares = mix(spark, [(i, "a", 10, 0) for i in range(100)], [("a", 1.0, 3)], total=500.0)
    assert sum(c.copies for c in copies) == 50 and shares["a"].actual_share == 1


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (3, "", "b"), (4, "four five six", "b"), (None, "x", "a")], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mixed_documents(docs, t)
    assert sorted((r.record, r.copies) for r in copies.collect()) == [(1, 2), (4, 2)]
    more = docs.unionByName(spark.createDataFrame([(7, "seven", None), (8, "eight", "c")], docs.schema))
    assert sorted((r.reason, r.documents) for r in mixing.left_out(more, t).collect()) == [("no doc_id", 1), ("no source", 1), ("no target", 1), ("no tokens", 2)]


NAMES = {"en": "English", "es": "Spanish", "de": "German", "fr": "French", "pt": "Portuguese", "it": "Italian", "nl": "Dutch", "ja": "Japanese"}
BASE = Path("/root/testdata/sf0.001")


def test_label_notations(spark):
    labels = ["en", "EN", "eng", "English", "en-US", "en_GB", " español ", "und", "??", None, "", "pt-BR", "日本語", "deu", "xx", "unknown"]
    df = spark.createDataFrame([(x,) for x in labels], "lang string").select("lang", languages.label_code(F.col("lang"), NAMES).alias("code"))
    assert [r.code for r in df.collect()] == ["en"] * 6 + ["es", None, None, None, None, "pt", "ja", "de", None, None]


def cut(*texts):
    """(owner, text of the part, whole) of each part."""
    p = languages.parts(list(texts))
    return [(int(k), texts[k][b:e].strip(), bool(w)) for k, b, e, w in zip(p.owner, p.begin, p.end, p.whole)]


def test_sentences():
    text = "Dr. J.T. Smith ran 3.5 yards. 「金曜日に再検査を受ける。」風が強かった。そして https://a.b/c?d=1 no end"
    assert cut(text) == [(0, "Dr. J.T. Smith ran 3.5 yards.", True), (0, "「金曜日に再検査を受ける。」", True), (0, "風が強かった。", True), (0, "そして https://a.b/c?d=1 no end", False)]
    for none in (None, "", "  \n", "21-8 214 2 | 4:05 65.4", "#GoTeamWeek969156243", "<p>12</p>"):
        assert cut(none) == []
    assert cut("x1 GO", None, "") == [(0, "x1 GO", False)] and not any(w for _, _, w in cut('{"a": "b"}'))  # some letters: one part, no sentence
    assert len(cut("Good things come to those who wait. " * 30_000)) == 30_000  # longer than one piece
    assert cut("the quick brown fox jumps over the lazy dog and nobody was there to see it") == [(0, "the quick brown fox jumps over the lazy dog and nobody was there to see it", False)]
    lines = cut("one line of words without a mark\r\nanother line of words (really)")
    assert [x[1:] for x in lines] == [("one line of words without a mark", False), ("another line of words (really)", False)]
    long = cut("word " * 5000)
    assert len(long) >= 25 and all(len(x[1]) <= languages.WINDOW for x in long) and sum(x[1].count("word") for x in long) == 5000
    assert sum(len(x[1]) for x in cut("語" * 2500)) == 2500


def test_parts_do_not_depend_on_the_batch():
    rng = random.Random(1)
    bits = ["A", "I. ", "No.", "Mr. ", "word", " Zwei Wörter", "!", "? ", "。", "「", "」", '"', ")", "\n", "\r\n", " ", "\u200b", "e\u0301", "ﬁ", "Ａ１", "&amp;", "&nbsp;", "<b>", "< 3", "1", "2.5", "_x", "a@b.c", "https://q.r", "日本語", "ｶﾞ", "🏈", "\ufeff"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)]
    together = languages.parts(texts)
    at = 0
    for k, t in enumerate(texts):
        one = languages.parts([t])
        n = len(one.owner)
        assert (together.owner[at : at + n] == k).all() and (one.begin == together.begin[at : at + n]).all() and (one.end == together.end[at : at + n]).all()
        assert [one.text(i) for i in range(n)] == [together.text(at + i) for i in range(n)]
        assert all(0 <= b < e <= len(t) for b, e in zip(one.begin, one.end)) and (one.begin[1:] >= one.end[:-1]).all()
        at += n
    assert at == len(together.owner)
    none, places = languages.normalised("plain é text")
    assert none == "plain é text" and places.tolist() == list(range(13))
    changed, places = languages.normalised("a&amp;b<br>e\u0301\u200bz")
    assert changed == "a&b éz" and places.tolist() == [0, 1, 6, 7, 11, 14, 15]


SAMPLES = {
    "en": ["The weather was good and the team played well in the second half.", "Nobody knows whether the coach will start him on Sunday."],
    "de": ["Das Wetter war gut und die Mannschaft spielte stark in der zweiten Hälfte.", "Niemand weiß, ob der Trainer ihn am Sonntag aufstellen wird."],
    "fr": ["Le temps était beau et l'équipe a bien joué en seconde période.", "Personne ne sait si l'entraîneur le fera jouer dimanche."],
    "ja": ["天気が良くてチームは後半にとても良いプレーをした。", "監督が日曜日に彼を出すかどうかは誰も知らない。"],
}


def test_model_learns_and_finds_segments(spark):
    rng = random.Random(0)
    rows = []
    for code, two in SAMPLES.items():
        words = [w for s in two for w in (s[:-1].split() if code != "ja" else [s[i : i + 4] for i in range(0, len(s) - 4, 3)])]
        for _ in range(120):
            body = [" ".join(rng.sample(words, 8)) if code != "ja" else "".join(rng.sample(words, 4)) for _ in range(3)]
            rows.append((len(rows), (". " if code != "ja" else "。").join(body) + ("." if code != "ja" else "。"), code if rng.random() > 0.15 else rng.choice(["en", "de", "und", None])))
    mixed = len(rows)
    rows += [(mixed, f"{SAMPLES['en'][0]} {SAMPLES['de'][0]} {SAMPLES['de'][1]}", "en"), (mixed + 1, None, "en"), (mixed + 2, "1-2 3", None), (mixed + 3, SAMPLES["fr"][0], "Français"), (mixed + 4, SAMPLES["ja"][1], None), (mixed + 5, SAMPLES["fr"][1] * 2000, "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, segment string")
    names = {c: NAMES[c] for c in SAMPLES}
    model = languages.train(df, names)
    held = [(s, c) for c, two in SAMPLES.items() for s in two]
    assert [model.langs[i] for i in model.logits(languages.parts([h[0] for h in held])).argmax(axis=1)] == [c for _, c in held]
    segments = [(r.lang, r.n_sentences) for r in languages.identified(df, names, model).filter(f"doc_id = {mixed}").orderBy("segment").collect()]
    assert segments == [("en", 1), ("de", 2)]
    found = {(r.doc_id, r.lang) for r in languages.relabelled(df, names, model).collect() if r.doc_id >= mixed}
    assert found == {(mixed, "en"), (mixed, "de"), (mixed + 4, "ja")}
    # no end mark: a language, but no sentence; rows of one doc_id are not run together, however they are batched
    loose = spark.createDataFrame([(1, SAMPLES["fr"][0][:-1]), (1, SAMPLES["de"][1]), (1, SAMPLES["de"][1]), (None, SAMPLES["fr"][0]), (2, "\ud83c\udfc8 7")], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    for n in (1, 3):
        got = languages.identified(loose.repartition(n), names, model)
        assert rows_of(got.select("doc_id", "segment", "begin", "lang", "n_sentences")) == [(1, 0, 0, "de", 1), (1, 0, 0, "de", 1), (1, 0, 0, "fr", 0)]
    assert {tuple(r) for r in languages.relabelled(loose, names, model).collect()} == {(1, "de")}
    again = languages.Model.loaded(model.saved())
    assert again.langs == model.langs and again.threshold == model.threshold and (again.vectors == model.vectors).all()
    assert languages.relabelled(df.limit(0), names, model).count() == 0
    assert languages.relabelled(df.withColumn("lang", F.lit(None).cast("string")), names).count() == 0  # nothing to learn from: all rejected


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_training_sample_is_bounded(spark, tmp_path):
    one = "The same text is there many times. " * 40
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, one).otherwise(F.concat(F.lit("Text with number words "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" in it."))).alias("text"), F.lit("en").alias("lang"))
    got = languages.labelled_sentences(df, {"en": "English"}, 50)
    places = got["place"].to_pylist()
    assert len(set(places)) == 50 and sum(s.startswith(" same text") for s in got["sentence"].to_pylist()) in (0, languages.PER_TEXT)
    assert max(map(places.count, places)) <= languages.PER_TEXT
    first, second = (languages.train(df, {"en": "English"}, 50, str(tmp_path)) for _ in range(2))
    assert len(list(tmp_path.iterdir())) == 1 and (first.vectors == second.vectors).all()
    assert languages.labelled_sentences(df.limit(0), {"en": "English"}).num_rows == 0


@pytest.mark.skipif(not BASE.exists(), reason="no test tables")
def test_matches_agree_with_known_names(spark, rows):
    i = "gsis_id string, identity_key string, full_name string, football_name string, latest_team string, position string, updated_at string, record string"
    identity = spark.createDataFrame(
        [("1", "GSIS:1", "Sébastien O'Neil Jr.", "Seb O'Neil", "AAA", "WR", "2024-01-01T00:00:00Z", ""), ("1", "GSIS:1", "SEBASTIEN ONEIL JR.", None, "bbb ", None, "2024-02-01T00:00:00Z", ""), ("2", "GSIS:2", "Terrance Van Ecland", None, "AAA", "QB", "2024-01-01T00:00:00Z", ""),
         ("3", "GSIS:3", "John Smith", None, "AAA", "RB", "2024-01-01T00:00:00Z", ""), ("4", "GSIS:4", "John Smith", None, "BBB", "TE", "2024-01-01T00:00:00Z", ""), (None, "GSIS:4", "J Smith", "Jack Smith", None, None, "2024-01-01T00:00:00Z", ""), (None, None, "No Body", None, "AAA", "QB", None, ""), ("5", "GSIS:5", None, None, "AAA", "QB", None, "")], i)
    l = "id string, nickname string, first_name string, last_name string, team string, opponent string, game string, position string, entity string"
    players = spark.createDataFrame(
        [("a", "ONeil, Sebastien", None, None, "BBB", "AAA", "AAA@BBB", "WR", ""), ("a", "Seb O’Neil Jr", None, None, "BBB", "AAA", "AAA@BBB", "WR", ""), ("b", "T. Van Ecland", None, None, "AAX", "BBB", "AAA@BBB", "QB", ""), ("c", "John Smith", None, None, "BBB", "AAA", "AAA@BBB", "TE", ""),
         ("d", "John Smith", None, None, "ZZZ", None, None, "K", ""), ("e", "Terrannce Vam Ecland", None, None, "AAA", "BBB", "AAA@BBB", "QB", ""), ("f", None, "Jonh", "Smith", "AAA", "BBB", "AAA@BBB", "FB", ""), ("g", None, None, None, "AAA", "BBB", "AAA@BBB", "QB", ""), ("h", "Bears", "Bears", None, "AAA", "BBB", "AAA@BBB", "D", ""), ("i", "Un Known", None, None, "AAA", "BBB", "AAA@BBB", "QB", ""), (None, "John Smith", None, None, "AAA", "BBB", "AAA@BBB", "RB", "")], l)
    stats = spark.createDataFrame([("3", "J.Smith", "John Smith", "AAA", "RB")], "player_id string, player_name string, player_display_name string, team string, position string")
    injuries = spark.createDataFrame([("2", "Terrance Van Ecland", "AAA", "QB")], "gsis_id string, player_name string, team string, position string")
    got = {r.id: r.gsis_id for r in matching.matched_players(players, identity, stats, injuries).collect()}
    assert got == {"a": "1", "b": "2", "c": "4", "f": "3"} or got == {"a": "1", "b": "2", "c": "4", "e": "2", "f": "3"}
    assert matching.matched_players(players.limit(0), identity, stats, injuries).count() == 0
    assert matching.matched_players(players, identity.limit(0), stats.limit(0), injuries.limit(0)).count() == 0


LLM_QUERIES = ["p6_found", "p6_matches", "p7_ids", "p7_roundtrip", "p8_shares", "p8_copies", "p8_left_out", "p9_found", "p9_segments"]


@pytest.mark.skipif(not BASE.exists(), reason="no test tables")
@pytest.mark.parametrize("name", LLM_QUERIES)
def test_query_runs(spark, name):
    from tallyforge.llm.queries import LLM

    # shares can be met to about a document: the smallest tables are too small for that
    out = LLM.queries[name](spark, str(BASE if name != "p8_shares" else BASE.parent / "sf0.01"))
    assert out.count() > 0
    if name == "p6_found":
        assert out.select("id").distinct().count() == out.count()
    if name == "p8_shares":
        assert all(abs(r.actual_share - r.target_share) < 0.005 for r in out.collect())


def test_queries_are_registered():
    from tallyforge.llm.queries import LLM

    assert set(LLM.queries) == set(LLM_QUERIES) and json.dumps(LLM.sql) is not None
