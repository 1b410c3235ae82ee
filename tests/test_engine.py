import time

import pytest
from pyspark.sql import functions as F

from argloom.operators import graph, relate, score, vote
from argloom.operators.segment import segments
from argloom.sources import brat, corpus

TEXT = (
    "Quand une livraison dépasse dix tonnes, le dépôt accorde un rabais. Quand le client est récent, le dépôt refuse toute livraison. "
    "Pour un client stratégique, le rabais l'emporte sur le refus de livraison. Mais en hiver glacial, le refus de livraison prévaut sur le rabais, même pour un client stratégique."
)
TEXTS = [
    TEXT,
    "12) Le contrat prend fin à l'échéance du bail, en cas de faute grave.\n\nComme la route est fermée et que la pluie tombe, le trajet est annulé. Par conséquent, le client attend.",
    "ANNA. Le service est retenu que si le prix baisse fortement.\nBORIS. Le train part, notamment le soir, car la voie est libre.",
    "Selon l'article 9. Les parties signent \U0001f600 le contrat. fin tardive de la phrase.",
    None,
    "",
    "mot " * 20_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


@pytest.fixture(scope="module")
def made(docs):
    return graph.extract(docs)


def test_offsets_slice_back_to_segments(docs):
    rows = segments(docs).collect()
    assert all(TEXTS[r.doc_id][r.start : r.end] == r.seg_text for r in rows)
    texts = [r.seg_text for r in sorted(rows, key=lambda r: (r.doc_id, r.seg_no)) if r.doc_id == 2]
    assert texts == ["Le service est retenu", "le prix baisse fortement", "Le train part, notamment le soir", "car la voie est libre"]
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 6}
    # a number before a full stop ends no sentence, nor does a small letter after one
    assert [r.seg_text for r in rows if r.doc_id == 3] == ["Selon l'article 9. Les parties signent \U0001f600 le contrat. fin tardive de la phrase"]


def test_speakers_and_paragraphs(docs):
    rows = segments(docs).collect()
    assert [r.speaker for r in rows if r.doc_id == 2] == [0, 0, 1, 1]
    assert [r.paragraph for r in rows if r.doc_id == 1] == [0, 0, 0, 1, 1, 1, 1]


def test_grounds(made):
    got = sorted((r.doc_id, r.premise, r.conclusion) for r in made["grounds"].collect())
    assert got == [(0, 1, 2), (0, 3, 4), (1, 2, 1), (1, 3, 1), (1, 4, 5), (1, 5, 7), (2, 2, 1), (2, 4, 3)]


def test_alternatives_make_variants(made):
    got = sorted((r.conclusion, r.variant_no, r.conditions) for r in made["rules"].collect() if r.doc_id == 1)
    assert got[:2] == [(1, 1, [2]), (1, 2, [3])]


def test_refinement_makes_a_preference_between_preferences(made):
    assert sorted((r.winner, r.loser, r.when_contexts) for r in made["preferences"].collect()) == [(2, 4, [5]), (4, 2, [7])]
    assert [(r.winner_pref, r.loser_pref, r.when_contexts) for r in made["meta_preferences"].collect()] == [(2, 1, [7])]
    assert [tuple(r) for r in made["complements"].collect()] == [(0, 2, 4)]


def test_annotation_round_trip_and_integrity(made, docs):
    entities, events = brat.tables(made, docs)
    ann = brat.render(entities, events)
    back = brat.parse(ann)
    assert back[0].exceptAll(entities).count() == 0 and back[1].exceptAll(events).count() == 0
    assert brat.violations(ann).count() == 0
    assert all(TEXTS[r.doc_id][r.start : r.end] == r.span for r in entities.collect())


def test_every_breach_is_listed(spark):
    bad = "T1\tOption 0 4\tabcd\nT1\tContext 5 9\tefgh\nE1\trule:T1 Effect:T1\nE2\tprefer:T1 Winner:E2 Loser:E9\nA1\tNegated T7\nnonsense"
    got = {r.code for r in brat.violations(spark.createDataFrame([(1, bad), (2, ""), (3, None)], "doc_id long, ann string")).collect()}
    assert got >= {"duplicate_entity", "bad_rule_shape", "unknown_target", "self_reference", "unknown_attribute_target", "bad_line", "bad_trigger"}


def test_greedy_alignment_takes_the_best_first(spark):
    cols = "doc_id long, ent_id string, kind string, start int, end int, span string"
    ref = spark.createDataFrame([(1, "T1", "Option", 0, 10, ""), (1, "T2", "Option", 10, 20, "")], cols)
    new = spark.createDataFrame([(1, "T1", "Option", 4, 12, ""), (1, "T2", "Option", 0, 10, ""), (1, "T3", "Context", 10, 20, "")], cols)
    assert [tuple(r) for r in score.alignment(new, ref).collect()] == [(1, "T2", "T1")]
    assert [tuple(r) for r in score.ratios(score.entity_counts(new, ref, score.alignment(new, ref)), "kind").where("kind = 'Option'").collect()] == [("Option", 1, 2, 2, 0.5, 0.5, 0.5)]


def test_votes(spark):
    answers = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "item int, value string")
    assert {r.item: r.value for r in vote.majority(answers, ["item"], fallback="?").collect()} == {1: "a", 2: "?"}
    asked = spark.createDataFrame([("k", 11), ("k", 12)], "key string, item int")
    ballot = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, item int, value string")
    assert sorted(tuple(r) for r in vote.realigned(ballot, asked, ["key"]).collect()) == [("k", 11, "x"), ("k", 12, "y")]


def test_signatures_of_any_depth(spark):
    rule = lambda k: (1, f"E{k}", "rule", [("Condition", f"T{k}"), ("Effect", f"T{k + 10}")])
    over = lambda k, kind, w, l: (1, f"E{k}", kind, [("Winner", f"E{w}"), ("Loser", f"E{l}")])
    rows = [rule(1), rule(2), over(3, "prefer", 1, 2), over(4, "prefer", 2, 1), over(5, "meta_prefer", 3, 4), over(6, "meta_prefer", 4, 3), over(7, "meta_prefer", 5, 6), over(8, "meta_prefer", 1, 2), over(9, "meta_prefer", 9, 1), over(10, "prefer", 11, 1), over(11, "prefer", 10, 1)]
    events = spark.createDataFrame(rows, "doc_id long, ev_id string, kind string, roles array<struct<role: string, target: string>>")
    got = {r.ev_id: r.signature for r in score.signatures(events).collect()}
    assert got.keys() == {f"E{k}" for k in range(1, 9)}
    assert got["E7"] == f"meta_prefer|({got['E5']})|({got['E6']})|" and got["E8"] == f"meta_prefer|({got['E1']})|({got['E2']})|"


def test_silent_ballots_count(spark):
    tags = spark.createDataFrame([("d", 1, 0, ["P"]), ("d", 2, 0, ["M"]), ("d", 2, 1, ["M", "P"])], "doc_id string, item int, ballot_no int, tags array<string>")
    held = spark.createDataFrame([("d", 3)], "doc_id string, ballots int")
    assert {r.item: r.tags for r in vote.majority_tags(tags, ["doc_id", "item"], held=held).collect()} == {1: ["N"], 2: ["M"]}
    rows = spark.createDataFrame([("d", 1, 0, "2>4"), ("d", 1, 0, "2>4"), ("d", 1, 1, "2>4"), ("d", 1, 1, "4>2"), ("d", 2, 2, "1>3")], "doc_id string, item int, ballot_no int, value string")
    assert [tuple(r) for r in vote.majority_support(rows, held, ["doc_id", "item"]).collect()] == [("d", 1, "2>4")]


def test_candidate_pairs_against_brute_force(spark):
    numbers = [1, 2, 5, 9, 14, 15, 16, 30]
    df = spark.createDataFrame([("d", n) for n in numbers], "doc_id string, seg_no int")
    got = sorted((r.l, r.r) for r in relate.candidate_pairs(df, keys=("doc_id",)).collect())
    assert got == [(a, b) for a in numbers for b in numbers if 0 < b - a <= 6]


def test_text_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    (tmp_path / "in" / "b.txt").write_text("")
    (tmp_path / "in" / "c.md").write_text("no")
    docs = corpus.read_texts(spark, str(tmp_path / "in"))
    assert [r.text for r in docs.collect()] == [TEXT]
    from argloom.streaming import ingest

    docs.selectExpr("1L AS doc_id", "text").write.parquet(str(tmp_path / "q"))
    ingest.annotate_stream(ingest.read_stream(spark, str(tmp_path / "q")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert "meta_prefer" in spark.read.parquet(str(tmp_path / "out")).first().ann


def test_long_texts_of_many_segments(spark):
    text = "Quand le client paie, le dépôt livre le mardi. " * 20_000  # 180,000 words
    got = segments(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("count(*) AS n", "max(`end`) AS last", "count(DISTINCT seg_text) AS texts").first()
    assert (got.n, got.last, got.texts) == (40_000, len(text) - 2, 2)


def test_repaired_ballots(spark):
    asked = spark.createDataFrame([("k", n) for n in (2, 3, 9)] + [("z", 5)], "key string, item int")
    given = {0: [(2, "a"), (3, "b"), (9, "c")], 1: [(1, "a"), (2, "b"), (3, "c")], 2: [(9, "c"), (8, "x")], 3: [(20, "a"), (21, "b"), (22, "c")], 4: [(2, "a"), (2, "b"), (3, "c")], 5: [(3, "a"), (4, "b"), (5, "c")]}
    ballots = spark.createDataFrame([("k", b, *x) for b, rows in given.items() for x in rows] + [("z", 0, 6, "one"), ("z", 1, 5, "two")], "key string, ballot_no int, item int, value string")
    whole = vote.repaired(ballots, asked, ["key"])
    got = {b: sorted((r.item, r.value) for r in whole.where(f"key = 'k' AND ballot_no = {b}").collect()) for b in given}
    full = [(2, "a"), (3, "b"), (9, "c")]
    assert got == {0: full, 1: full, 2: [(9, "c")], 3: full, 4: [(2, "a"), (3, "c")], 5: [(3, "a")]}
    assert {r.ballot_no for r in vote.fullest(whole.where("key = 'k'"), asked, ["key"]).collect()} == {0, 1, 3}
    partial = whole.where("key = 'k' AND ballot_no IN (2, 4, 5)")
    assert {r.ballot_no for r in vote.fullest(partial, asked, ["key"]).collect()} == {4}
    assert sorted((r.ballot_no, r.item, r.value) for r in whole.where("key = 'z'").collect()) == [(0, 5, "one"), (1, 5, "two")]


def test_causes_of_rules(spark):
    ddl = "doc_id long, ev_id string, kind string, trigger string, roles array<struct<role: string, target: string>>"
    rule = lambda n, effect, *conditions: (1, n, "rule", None, [("Effect", effect), *[("Condition", c) for c in conditions]])
    reference = spark.createDataFrame([rule("E1", "T1", "T2"), rule("E2", "T3", "T4", "T5"), rule("E3", "T6", "T2")], ddl)
    produced = spark.createDataFrame([rule("E1", "P1", "P2"), rule("E2", "P3", "P4")], ddl)
    names = spark.createDataFrame([(1, f"P{n}", f"T{n}") for n in (1, 2, 3, 4)], "doc_id long, ent_id string, ref_id string")
    assert {(r.ev_id, r.cause) for r in score.causes_of_rules(produced, reference, names).collect()} == {("E2", "conditions"), ("E3", "effect")}


def test_long_texts_of_rankings(spark):
    """The time of segmentation grows with the text's length, rankings or not."""
    line, took = "Mais en hiver, le rabais de la maison l'emporte sur le refus de livraison. Le client attend. ", {}
    for n in (2_000, 20_000):
        df = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        began = time.time()
        last = segments(df).agg(F.count("*").alias("n"), F.count_if(F.trim("sentence") == line[:-18].strip()).alias("ranked")).first()
        took[n] = time.time() - began
        assert (last.n, last.ranked) == (3 * n, n)
    assert took[20_000] < 30 + 10 * took[2_000]
