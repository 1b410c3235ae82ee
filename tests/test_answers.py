import json

from argloom.operators import answers

DDL = "doc_id long, batch_no int, ballot_no int, payload string"


def replies(spark, *payloads):
    return spark.createDataFrame([(1, 1, k, p if isinstance(p, str) or p is None else json.dumps(p)) for k, p in enumerate(payloads)], DDL)


def test_labels(spark):
    said = {"labels": [{"n": 1, "p": "oui", "m": "N"}, {"n": "2", "p": "N", "m": "non"}, {"n": 3, "t": "marker"}, {"n": "x", "p": "Y"}, {"n": 5}]}
    got = sorted((r.ballot_no, r.item, r.tags) for r in answers.labels(replies(spark, said, "<think>{}</think>```json\n" + json.dumps(said) + "\n```", "no json", None)).collect())
    assert got == [(b, n, t) for b in (0, 1) for n, t in ((1, ["P"]), (2, ["N"]), (3, ["M"]))]


def test_pairs_are_judged(spark):
    r = {"relations": [{"n": 1, "r": "a_to_b"}, {"n": 2, "r": "B_TO_A"}, {"n": 3, "r": "NONE"}, {"n": 4, "r": "maybe"}, {"n": 5, "r": "A_TO_B"}]}
    said = answers.relations(replies(spark, r))
    assert sorted((x.item, x.value) for x in said.collect()) == [(1, "A_TO_B"), (2, "B_TO_A"), (3, "NONE"), (5, "A_TO_B")]
    told = answers.narratives(replies(spark, {"narrative": [{"n": 1, "r": "no"}, {"n": 2, "r": "N"}, {"n": 3, "r": "N"}]}))
    pairs = spark.createDataFrame([(1, n, 10 + n, 20 + n) for n in range(1, 6)], "doc_id long, item int, l int, r int")
    assert sorted((x.premise, x.conclusion) for x in answers.judged(pairs, said, told).collect()) == [(11, 21), (22, 12)]  # 5 has no answer about narrative


def test_support_and_enumerations(spark):
    got = answers.support(replies(spark, {"support": [{"c": 3, "g": [1, "2", "x"]}, {"c": 4, "g": []}, {"g": [1]}]})).collect()
    assert sorted((r.item, r.grounds) for r in got) == [(3, [1, 2]), (4, [])]
    got = answers.enumerations(replies(spark, {"enumerations": [{"n": 1, "items": [" a ", "b", ""]}, {"n": 2, "items": ["a"]}]})).collect()
    assert [(r.item, r["items"]) for r in got] == [(1, ["a", "b"])]


def test_rankings(spark):
    rows = [{"preferred": [1, "le porc"], "contrasted": ["les autres"], "marker_n": 4, "marker": " prime sur "}, {"preferred": [2], "contrasted": [3], "complement": "N", "delta": [5, "y"]}, {"preferred": [], "contrasted": [1]}, {"preferred": [1], "contrasted": []}]
    got = [(r.preferred, r.contrasted, r.complement, r.delta, r.marker_n, r.marker) for r in answers.rankings(replies(spark, {"preferences": rows})).collect()]
    assert got == [(["1", "le porc"], [], True, [], 4, "prime sur"), (["2"], ["3"], False, [5], None, "")]


def test_numbered_lines(spark):
    df = spark.createDataFrame([(1, 10, "dix"), (1, 2, "deux"), (2, 1, "un")], "doc_id long, seg_no int, seg_text string")
    assert {r.doc_id: r.lines for r in answers.numbered(df, ("doc_id",)).collect()} == {1: "2. deux\n10. dix", 2: "1. un"}
