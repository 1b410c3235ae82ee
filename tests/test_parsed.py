from pyspark.sql import functions as F

from argloom.operators import graph, parsed, relate
from argloom.operators.segment import segments


def table(spark, *rows):
    """rows: (seg_no, [(text, lemma, pos, dep, head, morph)]); words are parted by one space, all of one document."""
    out = []
    for seg_no, words in rows:
        at = 0
        for i, (text, lemma, pos, dep, head, morph) in enumerate(words):
            out.append((1, seg_no, i, head, at, text, lemma, pos, dep, morph))
            at += len(text) + 1
    return spark.createDataFrame(out, parsed.TOKENS)


CAUSE = [
    ("Comme", "comme", "SCONJ", "mark", 2, None), ("elle", "elle", "PRON", "nsubj", 2, None), ("borde", "borde", "VERB", "advcl", 9, "VerbForm=Fin|Tense=Pres"),
    ("et", "et", "CCONJ", "cc", 6, None), ("que", "que", "SCONJ", "mark", 6, None), ("tout", "tout", "PRON", "nsubj", 6, None), ("tombe", "tombe", "VERB", "conj", 2, "VerbForm=Fin"),
    (",", ",", "PUNCT", "punct", 9, None), ("avis", "avis", "NOUN", "nsubj", 9, None), ("manque", "manque", "VERB", "ROOT", 9, "VerbForm=Fin"),
]
PASSIVE = [("les", "le", "DET", "det", 1, None), ("salles", "salle", "NOUN", "nsubj:pass", 3, None), ("sont", "être", "AUX", "aux:pass", 3, "VerbForm=Fin"), ("lavées", "laver", "VERB", "ROOT", 3, "VerbForm=Part|Tense=Past")]
NOTHING = [("aucun", "aucun", "DET", "det", 1, None), ("signe", "signe", "NOUN", "ROOT", 1, None)]
FALLEN = [("foudre", "foudre", "NOUN", "nsubj", 2, None), ("est", "être", "AUX", "aux:tense", 2, "VerbForm=Fin"), ("tombée", "tomber", "VERB", "ROOT", 2, "Tense=Past|VerbForm=Part"), ("hier", "hier", "ADV", "advmod", 2, None)]
EVEN = [("même", "même", "ADV", "advmod", 2, None), ("en", "en", "ADP", "case", 2, None), ("hiver", "hiver", "NOUN", "ROOT", 2, None)]
EXCEPT = [("sauf", "sauf", "ADP", "case", 2, None), ("lorsque", "lorsque", "SCONJ", "mark", 2, None), ("pluie", "pluie", "NOUN", "ROOT", 2, None)]
ALONE = [("toutefois", "toutefois", "ADV", "ROOT", 0, None), (",", ",", "PUNCT", "punct", 0, None)]
RELATIVE = [("qui", "qui", "PRON", "nsubj", 1, "PronType=Rel"), ("suit", "suivre", "VERB", "ROOT", 1, "VerbForm=Fin")]


def test_clause_features(spark):
    frags = parsed.fragments(table(spark, (1, CAUSE), (2, PASSIVE), (3, NOTHING), (4, FALLEN), (5, EVEN), (6, EXCEPT), (7, ALONE), (8, RELATIVE)))
    t = F.col("t")
    rows = {r.seg_no: r for r in frags.select("seg_no", parsed.opens_clause(t).alias("opens"), parsed.can_conclude(t).alias("ends"), parsed.can_condition(t).alias("begins"), parsed.logical_form(t).alias("form"), parsed.coordinated_cuts(t).alias("cuts")).collect()}
    assert [n for n in rows if rows[n].opens] and {n for n in rows if rows[n].opens} == {1, 2, 4, 8}
    assert {n for n in rows if rows[n].ends} == {2, 3, 4, 6, 7}
    assert {n for n in rows if rows[n].begins} == {1, 2, 3, 4, 5, 8}
    assert rows[1].cuts == [len("Comme elle borde ")] and all(rows[n].cuts == [] for n in rows if n != 1)
    assert [rows[n].form for n in (1, 2, 3, 4)] == ["manquer(avis)", "laver(salle)", "signe", "tomber(foudre)"]


def test_negation_and_repair(spark):
    words = [("il", "il", "PRON", "nsubj", 2, None), ("n'", "ne", "ADV", "advmod", 2, None), ("applique", "applique", "VERB", "ROOT", 2, None), ("jamais", "jamais", "ADV", "advmod", 2, None), ("règle", "règle", "NOUN", "obj", 2, None)]
    reads = [("lire", "lire", "VERB", "ROOT", 0, None)]
    got = parsed.fragments(table(spark, (1, words), (2, reads))).select("seg_no", parsed.logical_form(F.col("t")).alias("form")).collect()
    assert {r.seg_no: r.form for r in got} == {1: "-appliquer(il, regle)", 2: "lire"}


def test_subordinate_edges_fall_on_segments(spark):
    edges = parsed.subordinate_edges(parsed.fragments(table(spark, (1, CAUSE))))
    text = " ".join(w[0] for w in CAUSE)
    (row,) = edges.collect()
    assert text[row.condition.start : row.condition.end] == "Comme elle borde et que tout tombe" and text[row.conclusion.start : row.conclusion.end] == ", avis manque"
    seg = spark.createDataFrame([(1, 1, 0, 16), (1, 2, 17, 34), (1, 3, 37, 48), (2, 1, 0, 99)], "doc_id long, seg_no int, start int, end int")
    assert sorted((r.condition, r.conclusion) for r in parsed.overlapping(edges, seg).collect()) == [(1, 3), (2, 3)]


def test_commas_inside_lists_part_nothing(spark):
    words = [
        ("si", "si", "SCONJ", "mark", 5, None), ("port", "port", "NOUN", "nsubj", 5, None), (",", ",", "PUNCT", "punct", 3, None), ("phare", "phare", "NOUN", "conj", 1, None), (",", ",", "PUNCT", "punct", 5, None),
        ("ferment", "fermer", "VERB", "advcl", 8, "VerbForm=Fin"), (",", ",", "PUNCT", "punct", 8, None), ("tout", "tout", "PRON", "nsubj", 8, None), ("cesse", "cesser", "VERB", "ROOT", 8, "VerbForm=Fin"),
    ]
    frags = parsed.fragments(table(spark, (1, words)))
    unit = " ".join(w[0] for w in words)
    get = lambda u: frags.select(parsed.clause_commas(F.col("t"), F.lit(u)).alias("c")).first().c
    ends = [k + 1 for k, c in enumerate(unit) if c == ","]
    assert get(unit) == ends[2:]  # list member, predicate of the subordinate; the last parts the clauses
    assert get("sans rien") == ends  # no condition in the sentence: all part


def test_truncated_connectors_join_forward(spark):
    seg = spark.createDataFrame(
        [(1, 1, 0, 2, "Si", ""), (1, 2, 4, 26, "et dans la mesure où", ", "), (1, 3, 28, 50, "il est impossible", ", "), (1, 4, 52, 70, "quand il pleut", ". "), (2, 1, 0, 2, "si", "")],
        "doc_id long, seg_no int, start int, end int, seg_text string, gap string",
    )
    tokens = spark.createDataFrame([(1, 1, 0, 1, 28, "il", "il", "PRON", "nsubj", None), (1, 1, 1, 1, 58, "il", "il", "PRON", "nsubj", None)], parsed.TOKENS)
    cut = parsed.truncated_connectors(seg, tokens)
    assert sorted(tuple(r) for r in cut.collect()) == [(1, 1), (1, 2)]  # document 2 has no parse
    assert sorted(tuple(r) for r in parsed.joined_forward(seg, cut).collect()) == [(1, 1, 0, 50), (1, 2, 52, 70), (2, 1, 0, 2)]


def test_singular_events(spark):
    told = [("il", "il", "PRON", "nsubj", 1, None), ("courait", "courir", "VERB", "ROOT", 1, "Tense=Imp|VerbForm=Fin")]
    tenses = parsed.tense(parsed.fragments(table(spark, (1, told), (2, FALLEN), (3, PASSIVE), (4, told), (5, FALLEN[:3]))))
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 1, 5), (1, 3, 9)], "doc_id long, l int, r int")
    got = {(r.l, r.r): r.singular for r in parsed.singular_events(pairs, tenses).collect()}
    assert got == {(1, 2): True, (1, 3): False, (1, 4): False, (1, 5): True, (3, 9): False}


def sister_tokens(spark, doc_id, fragment):
    """Tokens of "Comme A et que B" (seg_no 1): the second verb is a conjunct with a subordinator."""
    words, at, out = fragment.split(" "), 0, []
    first, second, cc = words.index("baisse"), words.index("tombe"), words.index("et")
    for i, w in enumerate(words):
        head = first if i < cc and i != first else first if i in (first, second) else second
        dep = {0: "mark", first: "ROOT", cc: "cc", cc + 1: "mark", second: "conj"}.get(i, "nsubj")
        out.append((doc_id, 1, i, head, at, w, w, "VERB" if i in (first, second) else "X", dep, None))
        at += len(w) + 1
    return spark.createDataFrame(out, parsed.TOKENS)


def test_coordinated_siblings(spark):
    fragment = "Comme le prix baisse et que la pluie tombe"
    docs = spark.createDataFrame([(1, f"{fragment}, le trajet est annulé."), (2, f"{fragment}, le trajet est annulé.")], "doc_id long, text string")
    plain = segments(docs)
    rows = parsed.divided(plain, sister_tokens(spark, 1, fragment))
    assert rows.columns == [*plain.columns, "younger", "old_no", "shift"]
    got = sorted((r.doc_id, r.seg_no, r.seg_text, r.gap, r.prefix_end, r.younger, r.end - r.start) for r in rows.collect())
    assert got[:3] == [(1, 1, "Comme le prix baisse", "", "", False, 20), (1, 2, "et que la pluie tombe", " ", "e", True, 21), (1, 3, "le trajet est annulé", ", ", ",", False, 20)]
    assert [g[2] for g in got[3:]] == [fragment, "le trajet est annulé"]
    assert [tuple(r) for r in parsed.siblings(rows).collect()] == [(1, 1, 2)]
    made = graph.extract(docs, sister_tokens(spark, 1, fragment))
    assert sorted((r.doc_id, r.premise, r.conclusion) for r in made["grounds"].collect()) == [(1, 1, 3), (1, 2, 3), (2, 1, 2)]


def test_siblings_share_conclusions_and_prove_nothing_of_each_other(spark):
    flags = "doc_id long, seg_no int, alternative boolean, paragraph int, speaker int, connector_gap boolean, age boolean, no_rule boolean, can_conclude boolean, out_of_flow boolean"
    features = spark.createDataFrame([(1, n, n == 6, 0, 0, False, False, False, True, False) for n in range(1, 8)], flags)
    edges = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 1, 3), (1, 3, 5, 7)], "doc_id long, ord int, condition int, conclusion int")
    sisters = spark.createDataFrame([(1, 1, 2), (1, 5, 6)], "doc_id long, l int, r int")
    proven = relate.proofs(features, edges, siblings=sisters)
    assert sorted((r.premise, r.conclusion) for r in proven.collect()) == [(1, 3), (5, 7)]
    pairs = lambda of, s: sorted((r.premise, r.conclusion) for r in relate.grounds(features, of, s).collect())
    assert pairs(proven, sisters) == [(1, 3), (2, 3), (5, 7)]
    assert pairs(relate.proofs(features, edges), sisters) == [(1, 3), (2, 3), (5, 7)] and (1, 2) in pairs(relate.proofs(features, edges), None)


def test_anchor_of_a_ranking_after_siblings_is_the_elder(spark):
    rows = [(1, 1, "A", False, False, False), (1, 2, "B", False, False, True), (1, 3, "R", True, False, False)]
    features = spark.createDataFrame(rows, "doc_id long, seg_no int, seg_text string, ranking boolean, recall boolean, younger boolean")
    none = spark.createDataFrame([], "doc_id long, conclusion int, premise int")
    proven = spark.createDataFrame([], "doc_id long, premise int, conclusion int, premise_out boolean, conclusion_out boolean, can_conclude boolean")
    assert [(r.seg_no, r.kind) for r in graph.keys(features, none, proven).collect()] == [(1, "Context")]
    assert [r.seg_no for r in graph.keys(features.drop("younger"), none, proven).collect()] == [2]
