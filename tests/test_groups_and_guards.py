import json
import random
import re

import pytest
from pyspark.sql import functions as F

from argloom.functions import aligned, text
from argloom.operators import evaluate, graph, scope
from argloom.operators.segment import segments
from argloom.sources import brat, corpus

ROLES = "array<struct<role: string, target: string>>"


def test_groups_against_a_loop(spark):
    rows = [(1, 0, [1, 2], [3, 4], [9]), (1, 1, [2], [3], [9]), (1, 2, [3], [1, 3], []), (2, 0, [1], [2], None), (2, 1, [], [1], [5])]
    rules = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 3), (2, 1, 2), (2, 2, 1)]
    groups = spark.createDataFrame(rows, "doc_id long, row_no int, preferred array<int>, contrasted array<int>, when_contexts array<int>")
    got = graph.ranked_groups(groups, spark.createDataFrame(rules, "doc_id long, rule_no int, conclusion int")).collect()
    first, seen, want = {}, {}, []
    for d, r, c in rules:
        first.setdefault((d, c), r)
    for d, row, ws, ls, when in rows:
        for w in ws:
            for o in ls:
                a, b = first.get((d, w)), first.get((d, o))
                if a and b and a != b:
                    own = seen.setdefault(d, {})
                    want.append((d, row, w, o, own.setdefault((a, b, tuple(when or ())), len(own) + 1)))
    assert sorted((r.doc_id, r.row_no, r.winner, r.loser, r.pref_no) for r in got) == sorted(want)
    assert {(r.doc_id, r.a, r.b) for r in graph.opposed(groups).collect()} == {(1, 1, 3), (1, 1, 4), (1, 2, 3), (1, 2, 4), (2, 1, 2)}


def test_blocks_against_the_text(spark):
    texts = ["Premier passage assez long.\n\nDeuxieme passage assez long, et sa suite.\nTroisieme passage\n \n\nQuatrieme passage", "\n\nUn seul passage ici", "", "x\ny\nUn passage apres deux courts"]
    found = segments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    at = {(r.doc_id, r.seg_no): r.start for r in found.collect()}
    got = {(r.doc_id, r.seg_no): r.block for r in scope.blocks(found).collect()}
    assert got == {k: len(re.findall(r"\n+", texts[k[0]][:start])) for k, start in at.items()} and len(got) >= 6


def test_reworded_spans(spark):
    source = "Hier, le client a demandé un remboursement complet de sa commande avant la fin du mois."
    cases = {
        "le client a demandé un remboursement": (6, 42),
        "le client a réclamé un remboursement complet de sa commande": (6, 65),  # one word of ten differs
        "le client réclame le paiement total de son achat": None,  # too few words are shared
        "un remboursement tardif": None,  # too short to align
        "Hier le client du mois": None,  # shared, but over too long a stretch
    }
    df = spark.createDataFrame([(k, source, s) for k, s in enumerate(cases)] + [(8, None, "a b c d e"), (9, source, None)], "k int, t string, s string")
    got = {r.k: r.x and (r.x.start, r.x.end) for r in aligned.located(df, ["k"], "t", "s").select("k", F.col("at").alias("x")).collect()}
    assert got == dict(enumerate(cases.values())) | {8: None, 9: None}
    claims = spark.createDataFrame([(1, "T1", "Option", 0, 9, list(cases)[1]), (1, "T2", "Option", 0, 4, "Hier"), (1, "T3", "Option", 0, 4, list(cases)[2])], "doc_id long, ent_id string, kind string, start int, end int, span string")
    moved = {r.ent_id: (r.start, r.end, r.span) for r in brat.repair_offsets(claims, spark.createDataFrame([(1, source)], "doc_id long, text string"), reworded=True).collect()}
    assert moved == {"T1": (6, 65, source[6:65]), "T2": (0, 4, "Hier"), "T3": (None, None, list(cases)[2])}


def held(words, sought):
    """Every stretch, and the longest common subsequence in each."""
    best = None
    for a in range(len(words)):
        row, reach = [0] * (len(sought) + 1), int(len(sought) * 1.4)
        for b in range(a, min(len(words), a + reach)):
            new = row[:]
            for j, w in enumerate(sought):
                new[j + 1] = max(new[j], row[j + 1], row[j] + (w == words[b]))
            row = new
            if row[-1] >= 0.8 * len(sought):
                best = max(best or (0,), (row[-1], a - b, -a))
    return best and (-best[2], -best[2] - best[1])


def test_stretches_against_brute_force(spark):
    draw = random.Random(11)
    rows, want = [], {}
    for k in range(150):
        text_words = [draw.choice("abcdefgh") * draw.randint(1, 2) for _ in range(draw.randint(0, 60))]
        at = draw.randint(0, 40)
        sought = text_words[at : at + draw.randint(5, 12)]
        for _ in range(draw.randint(0, 3)):
            if sought:
                x = draw.randrange(len(sought))
                sought = draw.choice([sought[:x] + sought[x + 1 :], sought[:x] + ["neu"] + sought[x:], sought[:x] + sought[x : x + 2][::-1] + sought[x + 2 :], sought[:x] + ["alt"] + sought[x + 1 :]])
        spread, text = [], ""
        for w in text_words:
            text += draw.choice([" ", ", ", "\n"])
            spread.append((len(text), len(text) + len(w)))
            text += w
        rows.append((k, text, " ".join(sought)))
        place = held(text_words, sought) if len(sought) >= 5 else None
        if place:
            want[k] = (spread[place[0]][0], spread[place[1]][1])
    df = spark.createDataFrame([*rows, (900, None, "a b c d e"), (901, "a b c d e", None), (902, "", "a b c d e")], "k int, text string, span string")
    assert {r.k: (r.start, r.end) for r in aligned.places(df, ["k"]).collect()} == want and 60 < len(want) < 150


def test_tolerant_spans(spark):
    cases = [
        ("Il dit : “Éléments   clés” – puis s’en va", '"elements cles" - puis s\'en va', (9, 41)), ("un  deux\tun deux", "UN deux", (0, 8)), ("un\ndeux", "un deux", None), ("a \\E b (c)*", "A \\e  B (C)*", (0, 11)), ("a \\E b", "\\E b", (2, 6)),
        ("rien", "", None), ("", "rien", None),
    ]
    df = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(cases)], "k int, t string, s string")
    got = {r.k: [(x.start, x.end) for x in r.x] for r in df.select("k", text.occurrences(F.col("t"), F.col("s")).alias("x")).collect()}
    assert [got[k][0] if got[k] else None for k in range(len(cases))] == [want for _, _, want in cases]
    assert got[1] == [(0, 8), (9, 16)]


def test_atoms_and_programs(spark):
    entities = spark.createDataFrame([(1, "T1", "Option", 0, 4, "abcd"), (1, "T2", "Context", 5, 9, 'ef"\t\nh')], "doc_id long, ent_id string, kind string, start int, end int, span string")
    events = spark.createDataFrame([(1, "E1", "rule", "T1", [("Condition", "T2"), ("Effect", "T1")])], f"doc_id long, ev_id string, kind string, trigger string, roles {ROLES}")
    program = evaluate.programs(*evaluate.atoms(entities, events))
    assert {tuple(r.concluded) for r in evaluate.conclusions(program, evaluate.trials(program)).collect()} == {(), ("t1",)}
    forms = spark.createDataFrame([(1, "T2", "tombe(pluie)"), (1, "T1", "")], "doc_id long, ent_id string, form string")
    said = spark.createDataFrame([(1, 2, "second"), (1, 1, "first\nline"), (1, 3, ""), (7, 1, "no such document")], "doc_id long, n int, message string")
    lines = brat.render_lpp(entities, events, forms=forms, diagnostics=said).collect()[0].lpp.split("\n")
    assert lines[2:] == ["% first line", "% second", 'option(o1, "abcd").', "scenario(c1, tombe(pluie), " + json.dumps('ef"\t\nh') + ").", "rule(r1, [c1], o1)."]


def test_guards(spark, tmp_path):
    source, kept = tmp_path / "in", tmp_path / "kept"
    source.mkdir(), kept.mkdir()
    (tmp_path / "link").symlink_to(source)
    corpus.guard(spark, str(source), str(tmp_path / "out"), (str(kept),))
    corpus.guard(spark, str(source), str(tmp_path / "input"), (str(kept),))
    for bad in (source, tmp_path, tmp_path / "link", f"{source}/../in/", f"file:{source}"):
        with pytest.raises(ValueError, match="replace its source"):
            corpus.guard(spark, str(source), str(bad))
    for a, b in ((kept, tmp_path / "out"), (source, kept / "deep" / "er")):
        with pytest.raises(ValueError, match="protected"):
            corpus.guard(spark, str(a), str(b), (str(kept),))
    with pytest.raises(ValueError, match="no .txt file"):
        corpus.read_texts(spark, str(kept), required=True)
    assert corpus.read_texts(spark, str(kept)).count() == 0


def test_numbered_paragraphs(spark):
    html = "<p>1. Un texte numerote.</p><p>Un texte sans numero.</p><p>2.\u00a0Un autre ;.</p><p>12. Un dernier.</p><p>123. Trop long.</p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r.paragraph for r in corpus.paragraphs(pages, 1, 100, numbered=True).orderBy("par_no").collect()] == ["1. Un texte numerote.", "12. Un dernier."]
    assert corpus.paragraphs(pages, 1, 100).count() == 4
