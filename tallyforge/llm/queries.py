"""Queries of the training-text problems (p6 to p9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.llm import encoding, mixing
from tallyforge.plans.registry import Registry, Tables

LLM = Registry()


@LLM.query("p7_ids")
def p7_ids(spark, d):
    return encoding.encoded(Tables(spark, d).documents)


@LLM.query("p7_roundtrip")
def p7_roundtrip(spark, d):
    return encoding.roundtrip(Tables(spark, d).documents)


@LLM.query("p8_shares")
def p8_shares(spark, d):
    t = Tables(spark, d)
    return mixing.mixed_documents(t.documents, t.mix_targets)[1]


@LLM.query("p8_copies")
def p8_copies(spark, d):
    t = Tables(spark, d)
    return mixing.mixed_documents(t.documents, t.mix_targets)[0].select(F.col("record").alias("doc_id"), "source", F.col("size").cast("bigint").alias("n_tokens"), "copies")


@LLM.query("p8_left_out")
def p8_left_out(spark, d):
    t = Tables(spark, d)
    return mixing.left_out(t.documents, t.mix_targets)


def _languages(spark, d):
    from tallyforge.llm import languages

    t = Tables(spark, d)
    return languages, t.documents, languages.language_names(t.lang_codes)


@LLM.query("p9_found")
def p9_found(spark, d):
    languages, documents, names = _languages(spark, d)
    return languages.relabelled(documents, names)


@LLM.query("p9_segments")
def p9_segments(spark, d):
    languages, documents, names = _languages(spark, d)
    return languages.identified(documents, names)


def _matches(spark, d, least):
    from tallyforge.llm import matching

    t = Tables(spark, d)
    return matching.matched_players(t.fanduel_players_list, t.player_identity, t.player_game_stats, t.injury_consensus_current, least)


@LLM.query("p6_found")
def p6_found(spark, d):
    from tallyforge.llm import matching

    return _matches(spark, d, matching.LEAST).select("gsis_id", "id")


@LLM.query("p6_matches")
def p6_matches(spark, d):
    return _matches(spark, d, 0.0)
