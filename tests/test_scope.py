from argloom.operators import scope


def test_mentions_take_the_option_with_most_words(spark):
    mentions = spark.createDataFrame([(1, 1, "le porc grillé"), (1, 2, "le poulet"), (1, 3, "une pomme verte acide"), (2, 1, "porc"), (1, 4, "")], "doc_id long, mention_no int, mention string")
    options = spark.createDataFrame([(1, 3, "on sert du porc"), (1, 5, "porc grillé au feu"), (1, 7, "poulet rôti"), (1, 8, "poulet"), (1, 9, "pomme")], "doc_id long, seg_no int, seg_text string")
    got = {(r.doc_id, r.mention_no): r.seg_no for r in scope.mentioned_options(mentions, options).collect()}
    assert got == {(1, 1): 5, (1, 2): 8}  # a third of the words is too little, other documents do not count


def test_nearby_against_brute_force(spark):
    a, b = [1, 13, 14, 40], [1, 2, 12, 26, 27, 53]
    df = lambda ns: spark.createDataFrame([("d", n) for n in ns], "doc_id string, seg_no int")
    got = sorted((r.target, r.seg_no) for r in scope.nearby(df(a), df(b)).collect())
    assert got == [(x, y) for x in a for y in b if abs(x - y) <= 12]


def test_enumerations_explode_only_whole(spark):
    text = "il sert du porc, du Poulet ou du poisson"
    seg = spark.createDataFrame([(1, 1, 5, 5 + len(text), text), (1, 2, 60, 60 + len(text), text), (1, 3, 110, 116, "autre")], "doc_id long, seg_no int, start int, end int, seg_text string")
    items = spark.createDataFrame([(1, 1, ["du porc", "du poulet", " du poisson "]), (1, 2, ["du poisson", "du porc"]), (1, 3, ["autre"])], "doc_id long, seg_no int, items array<string>")
    got = sorted((r.seg_no, r.start, r.end, r.old_no, r.scope) for r in scope.exploded(seg, items).collect())
    at = [text.index(x) + 5 for x in ("du porc", "du Poulet", "du poisson")]
    assert got == [(1, at[0], at[0] + 7, 1, 1), (2, at[1], at[1] + 9, 1, 1), (3, at[2], at[2] + 10, 1, 1), (4, 60, 60 + len(text), 2, None), (5, 110, 116, 3, None)]


def test_complements(spark):
    prefs = spark.createDataFrame([(1, 1, 5, [1]), (1, 2, 6, [2, 3]), (1, 3, 7, [2]), (1, 4, 20, [1]), (2, 1, 9, [1])], "doc_id long, pref_no int, marker_n int, preferred array<int>")
    scopes = spark.createDataFrame([(1, 1, [1, 2, 3]), (2, 1, [1, 2]), (2, 2, [1, 3, 2])], "doc_id long, scope_no int, members array<int>")
    options = spark.createDataFrame([(d, n) for d in (1, 2) for n in (1, 2, 3)], "doc_id long, seg_no int")
    blocks = spark.createDataFrame([(d, n, 0 if n < 15 else 1) for d in (1, 2) for n in range(1, 22)], "doc_id long, seg_no int, block int")
    got = {(r.doc_id, r.pref_no): (r.others, r.status) for r in scope.complements(prefs, scopes, options, blocks).collect()}
    assert got[1, 1] == ([2, 3], "RESOLVED") and got[1, 2] == ([1], "RESOLVED")
    assert got[1, 3] == ([3], "RESOLVED")  # the preferred set before is nearer than the enumeration
    assert got[1, 4] == (None, "AMBIGUOUS")  # nothing in its block
    assert got[2, 1] == ([2, 3], "RESOLVED")  # of the two enumerations the later place is nearer
