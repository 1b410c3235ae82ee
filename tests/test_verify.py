import json

import pytest

from argloom.operators import graph, parsed, verify

REPLIES = "doc_id long, stage string, batch_no int, ballot_no int, payload string"
FEATURES = "doc_id long, seg_no int, paragraph int, speaker int, alternative boolean, can_conclude boolean"


def pairs_of(df):
    return sorted((r.premise, r.conclusion) for r in df.collect())


def frames(spark, pairs, proven, said, told, n=8):
    seg = spark.createDataFrame([(1, k, True, True) for k in range(1, n)], "doc_id long, seg_no int, can_conclude boolean, can_condition boolean")
    way = verify.directed(
        spark.createDataFrame([(1, a, b) for a, b in pairs], "doc_id long, l int, r int"), spark.createDataFrame([(1, a, b) for a, b in proven], "doc_id long, premise int, conclusion int"),
        spark.createDataFrame([(1, a, b, v) for (a, b), v in said.items()], "doc_id long, l int, r int, value string"),
    )
    return seg, verify.refuted(way, spark.createDataFrame([(1, a, b, v) for (a, b), v in told.items()], "doc_id long, l int, r int, value string"))


@pytest.mark.parametrize(
    ("pairs", "proven", "want"),
    [
        ([(1, 3), (2, 3)], [(1, 3)], [(1, 3)]),  # an unproven premise beside a proven one falls
        ([(1, 3), (2, 3)], [(1, 3), (2, 3)], [(1, 3), (2, 3)]),
        ([(1, 3), (2, 3)], [], [(1, 3), (2, 3)]),  # without a proof the replies decide
        ([(1, 3)], [(1, 3)], [(1, 3)]),  # a conclusion is never emptied
        ([(1, 3), (2, 3), (4, 5)], [(1, 3)], [(1, 3), (4, 5)]),  # other conclusions stay
    ],
)
def test_purity(spark, pairs, proven, want):
    seg, way = frames(spark, pairs, proven, dict.fromkeys(pairs, "A_TO_B"), dict.fromkeys(pairs, "N"))
    assert pairs_of(verify.stands(way, seg)) == want


def test_directions_and_refutations(spark):
    said = {(1, 2): "B_TO_A", (2, 3): "NONE", (3, 4): "A_TO_B", (4, 5): "AMBIGUOUS", (5, 6): "A_TO_B", (6, 7): "A_TO_B"}
    seg, way = frames(spark, [*said, (1, 7)], [(7, 1)], said, {(1, 2): "N", (3, 4): "Y", (5, 6): "N"})
    assert pairs_of(verify.stands(way, seg)) == [(5, 6), (7, 1)]  # 7 -> 1 is proven, so 2 -> 1 falls
    assert pairs_of(way) == [(2, 1), (5, 6), (7, 1)]  # (3, 4) narrates, (6, 7) was not looked at


def test_siblings_and_one_way(spark):
    seg, way = frames(spark, [(1, 3), (2, 4)], [(1, 3)], {(2, 4): "A_TO_B"}, {(2, 4): "N"})
    sisters = spark.createDataFrame([(1, 1, 2), (1, 4, 5)], "doc_id long, l int, r int")
    either = spark.createDataFrame([(1, 1, 2)], "doc_id long, l int, r int")
    assert pairs_of(verify.stands(way, seg, sisters)) == [(1, 3), (2, 3), (2, 4)]  # an unproven premise brings none
    assert pairs_of(verify.stands(way, seg, sisters, either)) == [(1, 3), (2, 4)]
    mutual = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 3), (1, 5, 4), (2, 2, 1)], "doc_id long, conclusion int, premise int")
    assert sorted(tuple(r) for r in verify.one_way(mutual).collect()) == [(1, 2, 1), (1, 5, 4), (2, 2, 1)]


def test_passages(spark):
    seg = spark.createDataFrame([(1, 1, "", "A"), (1, 2, ", ", "B"), (1, 3, ". ", "C")], "doc_id long, seg_no int, gap string, seg_text string")
    asked = verify.pair_questions(spark.createDataFrame([(1, 1, 3), (1, 2, 3)], "doc_id long, l int, r int"), size=1)
    assert sorted(tuple(r) for r in verify.presented(asked, seg).collect()) == [(1, 0, 1, "A", "C", "A, B. C"), (1, 1, 1, "B", "C", "B. C")]


def test_strategy_must_be_known(spark):
    empty = spark.createDataFrame([], FEATURES)
    with pytest.raises(ValueError, match="group, pairs, hybrid"):
        verify.run(empty, empty.select("doc_id", "seg_no"), empty, empty, "other")


def reply(stage, rows, batch=0, ballots=1, doc=1):
    return [(doc, stage, batch, k, json.dumps({stage: rows})) for k in range(ballots)]


def test_replies_reach_the_graph(spark):
    text = "Le stock du magasin baisse beaucoup. Le dépôt commande des pièces. Quand la route est fermée, le trajet est annulé. Le chauffeur rentre chez lui."
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    labels = reply("labels", [{"n": n, "p": "Y", "m": "N"} for n in (1, 2, 5)])
    support = reply("support", [{"c": 2, "g": [1, 9]}, {"c": 5, "g": [4]}])
    asked = []

    def grounds(replies, **more):
        made = graph.extract(docs, replies=spark.createDataFrame(replies, REPLIES), **more)
        asked.append({s: sorted((r.l, r.r) for r in q.collect()) for s, q in made["questions"].items() if s != "support"})
        return {(r.doc_id, r.premise, r.conclusion) for r in made["grounds"].collect()}

    proven = {(1, 3, 4), (2, 3, 4)}
    assert grounds(labels + support) == proven and asked[-1] == {"relations": [(1, 2), (4, 5)], "narrative": []}
    relations = reply("relations", [{"n": 1, "r": "A_TO_B"}, {"n": 2, "r": "B_TO_A"}])
    assert grounds(labels + support + relations) == proven and asked[-1]["narrative"] == [(1, 2), (4, 5)]
    told = reply("narrative", [{"n": 1, "r": "N"}, {"n": 2, "r": "N"}])
    # 5 -> 4 falls, as 3 -> 4 is proven
    made = graph.extract(docs, replies=spark.createDataFrame(labels + support + relations + told, REPLIES))
    assert {(r.doc_id, r.premise, r.conclusion) for r in made["grounds"].collect()} == proven | {(1, 1, 2)}
    assert sorted((r.doc_id, r.conclusion, tuple(r.conditions)) for r in made["rules"].collect()) == [(1, 2, (1,)), (1, 4, (3,)), (2, 4, (3,))]
    assert {(r.seg_no, r.kind) for r in made["keys"].where("doc_id = 1").collect()} == {(1, "Context"), (2, "Option"), (3, "Context"), (4, "Option")}
    pairs = labels + reply("relations", [{"n": 1, "r": "B_TO_A"}]) + reply("narrative", [{"n": 1, "r": "N"}])
    assert grounds(pairs, strategy="pairs") == proven | {(1, 2, 1)} and (1, 2) in asked[-1]["relations"] and (3, 4) not in asked[-1]["relations"]


def test_parse_bars_conclusions_and_premises(spark):
    docs = spark.createDataFrame([(1, "Quand la route est fermée, le trajet est annulé.")], "doc_id long, text string")
    words = lambda *rows: spark.createDataFrame([(1, *r, None) for r in rows], parsed.TOKENS)
    grounds = lambda tokens: pairs_of(graph.extract(docs, tokens)["grounds"])
    free = [(2, 0, 1, 0, "le", "le", "DET", "det"), (2, 1, 1, 3, "trajet", "trajet", "NOUN", "ROOT")]
    assert grounds(words(*free)) == [(1, 2)]
    assert grounds(words((2, 0, 1, 0, "le", "le", "SCONJ", "mark"), free[1])) == []
    assert grounds(words(*free, (1, 0, 0, 0, "Même", "même", "ADV", "advmod"), (1, 1, 1, 6, "route", "route", "SCONJ", "ROOT"))) == []


def test_the_others_resolve_inside_the_graph(spark):
    menu = "Quand le banquet a lieu, il faut agneau ou porc ou poulet ou poisson. "
    text = menu + "La cuisine préfère le porc aux trois autres. Le chef privilégie le vent plutôt que la mer."
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    listed = reply("enumerations", [{"n": 2, "items": ["il faut agneau", "porc", "poulet", "poisson"]}])
    plain = {(r.doc_id, r.seg_no): r.seg_text for r in graph.extract(docs)["segments"].collect()}
    made = graph.extract(docs, replies=spark.createDataFrame(listed, REPLIES))
    seg = {(r.doc_id, r.seg_no): r for r in made["segments"].collect()}
    assert {k[1]: v for k, v in plain.items() if k[0] == 2} == {k[1]: v.seg_text for k, v in seg.items() if k[0] == 2}
    assert all(text[r.start : r.end] == r.seg_text for r in seg.values())
    first = "".join(r.gap + r.seg_text for _, r in sorted(seg.items()) if r.doc_id == 1)
    assert text.startswith(first) and [seg[1, n].seg_text for n in (2, 3, 4, 5)] == ["il faut agneau", "porc", "poulet", "poisson"]
    marker = next(n for (d, n), r in seg.items() if d == 1 and "aux trois autres" in r.seg_text)
    other = next(n for (d, n), r in seg.items() if d == 1 and "le vent" in r.seg_text)
    given = listed + reply("labels", [{"n": n, "p": "Y"} for n in range(1, 6)])
    given += reply("relations", [{"n": n, "r": "A_TO_B"} for n in range(1, 11)]) + reply("narrative", [{"n": n, "r": "N"} for n in range(1, 11)])
    given += reply("support", [{"c": n, "g": [1]} for n in (3, 4, 5)])
    rank = {"preferred": ["le porc"], "contrasted": ["les trois autres"], "marker_n": marker, "marker": "préfère"}
    lost = {"preferred": [3], "contrasted": ["les autres"], "marker_n": other, "marker": "privilégie", "delta": [99]}
    full = given + reply("preferences", [rank, {"preferred": [3], "contrasted": [4], "marker_n": marker, "marker": "nulle part"}])
    made = graph.extract(docs, replies=spark.createDataFrame(full, REPLIES))
    conclusions = {r.conclusion for r in made["rules"].where("doc_id = 1").collect()}
    assert conclusions == {2, 3, 4, 5}
    got = sorted((r.doc_id, r.winner, r.loser) for r in made["preferences"].collect() if r.row_no > 1000)
    assert got == [(1, 3, 2), (1, 3, 4), (1, 3, 5)] and made["ambiguous"].count() == 0
    far = [*full[:-1], *reply("preferences", [lost])]
    text2 = text.replace(" Le chef", "\n\nLe chef")
    made = graph.extract(spark.createDataFrame([(1, text2)], "doc_id long, text string"), replies=spark.createDataFrame(far, REPLIES))
    assert [(r.doc_id, r.marker_n) for r in made["ambiguous"].collect()] == [(1, other)] and not [r for r in made["preferences"].collect() if r.row_no > 1000]
