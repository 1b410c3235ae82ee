"""From grounds to an argument graph: entities, rules, preferences and preferences between preferences.

A document's graph is small, so it is built in one row per document: arrays are
gathered by doc_id once, and what depends on order (a ranking looks at earlier ones) is
an ordered fold over an array. Results are tables again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions import cues
from argloom.functions.text import fold, stems
from argloom.operators import parsed, ranked, relate, scope, verify
from argloom.operators.segment import segments
from argloom.session import cut

INTS = "CAST(array() AS ARRAY<INT>)"


def variants(premises: Column) -> Column:
    """Conditions of a conclusion's rules: premises (array of {premise, alternative}, in order) joined by "or" are chosen one at a time, with all others."""
    islands = F.aggregate(
        premises, F.expr("CAST(array() AS ARRAY<ARRAY<INT>>)"),
        lambda a, p: F.when(
            p["alternative"] & (F.size(a) > 0) & F.coalesce(F.element_at(F.element_at(a, -1), -1) == p["premise"] - 1, F.lit(False)),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array_append(F.element_at(a, -1), p["premise"]))),
        ).otherwise(F.array_append(a, F.array(p["premise"]))),
    )
    common = F.flatten(F.filter(islands, lambda x: F.size(x) == 1))
    choices = F.filter(islands, lambda x: F.size(x) > 1)
    return F.aggregate(choices, F.array(common), lambda a, c: F.flatten(F.transform(a, lambda base: F.transform(c, lambda x: F.array_append(base, x)))))


def rules(features: DataFrame, grounds: DataFrame) -> DataFrame:
    """doc_id, rule_no (from 1), conclusion, variant_no, conditions."""
    alternative = features.select("doc_id", F.col("seg_no").alias("premise"), "alternative")
    gathered = grounds.join(alternative, ["doc_id", "premise"]).groupBy("doc_id", "conclusion").agg(F.sort_array(F.collect_list(F.struct("premise", "alternative"))).alias("premises"))
    one = gathered.select("doc_id", "conclusion", F.posexplode(variants(F.col("premises"))).alias("v", "conditions")).where(F.size("conditions") > 0)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("conclusion", "v"))
    return one.select("doc_id", number.alias("rule_no"), "conclusion", (F.col("v") + 1).alias("variant_no"), "conditions")


def keys(features: DataFrame, grounds: DataFrame, proven: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, seg_no, kind (Option or Context), entity (segment whose span stands for it). labelled: doc_id, seg_no of propositions besides those that proofs show."""
    concluded = grounds.select("doc_id", F.col("conclusion").alias("seg_no")).distinct().withColumn("is_option", F.lit(True))
    used = grounds.select("doc_id", F.col("premise").alias("seg_no")).distinct().withColumn("is_used", F.lit(True))
    ends = proven.where("NOT premise_out AND (conclusion_out OR can_conclude)").select("doc_id", F.col("premise").alias("seg_no")).unionAll(
        proven.where("NOT conclusion_out AND can_conclude").select("doc_id", F.col("conclusion").alias("seg_no"))
    )
    ends = (ends if labelled is None else ends.unionByName(labelled)).distinct().withColumn("is_proposition", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    younger = F.col("younger") if "younger" in features.columns else F.lit(False)
    df = features.select("doc_id", "seg_no", "seg_text", "ranking", "recall", younger.alias("younger")).join(concluded, ["doc_id", "seg_no"], "left").join(used, ["doc_id", "seg_no"], "left").join(ends, ["doc_id", "seg_no"], "left")
    df = df.select("doc_id", "seg_no", "seg_text", "ranking", "recall", "younger", no("is_option"), no("is_used"), no("is_proposition"))
    w = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("is_option") | F.col("is_used")
    last = lambda ok, value="seg_no": F.last(F.when(ok, F.col(value)), ignorenulls=True).over(w)
    # right after a younger sibling, the anchor is looked for from the elder on
    by_place = Window.partitionBy("doc_id").orderBy("seg_no")
    flow = lambda value, frame: F.last(F.when(~F.col("recall"), F.col(value)), ignorenulls=True).over(frame)
    near = lambda value: F.when(F.lag("younger").over(by_place), flow(value, by_place.rowsBetween(Window.unboundedPreceding, -2))).otherwise(flow(value, w))
    df = df.withColumn("own", own).withColumn("near", near("seg_no")).withColumn("near_own", near("own"))
    df = df.withColumn("loose", last(F.col("is_proposition") & ~F.col("own")))
    anchors = df.where("ranking").select("doc_id", F.when(F.col("near").isNotNull() & ~F.col("near_own"), F.col("near")).otherwise(F.col("loose")).alias("seg_no")).where("seg_no IS NOT NULL").distinct().withColumn("is_anchor", F.lit(True))
    same = Window.partitionBy("doc_id", "seg_text")
    df = df.withColumn("first_context", F.min(F.when(F.col("is_used") & ~F.col("is_option"), F.col("seg_no"))).over(same)).withColumn("first_same", F.min("seg_no").over(same))
    df = df.join(anchors, ["doc_id", "seg_no"], "left").where("own OR is_anchor")
    entity = F.when(F.col("own"), F.col("seg_no")).otherwise(F.coalesce("first_context", "first_same"))
    return df.select("doc_id", "seg_no", F.when(F.col("is_option"), "Option").otherwise("Context").alias("kind"), entity.alias("entity"))


def ranking_parts(features: DataFrame) -> DataFrame:
    """Per ranking segment: the mentions of winner and loser, the marker's span in the segment, whether its loser is left out, and whether it announces a refinement."""
    df = features.where("ranking").withColumn("n", F.length("seg_text"))
    at = lambda part, within: F.instr(within, part) - 1
    cue = F.col("contiguous")
    place = F.length(F.regexp_extract("folded", r"(?U)^(.*?)(?<!\w)" + "(?:" + "|".join(sorted(cues.RANKING_FOLDED, key=len, reverse=True)) + r")(?!\w)", 1))
    df = df.withColumn("cue_at", F.when(cue.isNotNull(), F.when(F.substr("folded", place + 1, F.length(cue)) == cue, place).otherwise(at(cue, F.col("folded")))))
    whole = F.regexp_extract("folded", f"(?U){cues.COMPARATIVE_FOLDED}", 0)
    elided = F.regexp_extract("folded", f"(?U){cues.ELIDED_LOSER_FOLDED}", 1)
    df = df.withColumn("whole", F.when(cue.isNull(), whole).otherwise("")).withColumn("elided", F.when(cue.isNull() & (F.col("whole") == ""), elided).otherwise(""))
    group = lambda k: F.regexp_extract("whole", f"(?U){cues.COMPARATIVE_FOLDED}", k)
    whole_at = at(F.col("whole"), F.col("folded"))
    winner_at = whole_at + F.length(F.regexp_extract("whole", rf"(?U)^{cues.PREFER}\s+", 0))
    loser_at = whole_at + F.length("whole") - F.length(group(2))
    elided_at = at(F.col("elided"), F.col("folded"))
    elided_winner = F.regexp_extract("folded", f"(?U){cues.ELIDED_LOSER_FOLDED}", 2)
    elided_winner_at = elided_at + F.length(F.regexp_extract("elided", rf"(?U)^{cues.PREFER}\s+", 0))
    piece = lambda a, n: F.substr("seg_text", a + 1, n)
    cut = lambda c, edges: F.nullif(F.btrim(c, F.lit(edges)), F.lit(""))
    by_cue, by_whole, by_elided = cue.isNotNull(), F.col("whole") != "", F.col("elided") != ""
    return df.select(
        "doc_id", "seg_no", "start", "seg_text", "sentence_open",
        F.when(by_cue, cut(piece(F.lit(0), F.col("cue_at")), " ,;:")).when(by_whole, cut(piece(winner_at, F.length(group(1))), " ,;:")).when(by_elided, cut(piece(elided_winner_at, F.length(elided_winner)), " ,;:")).alias("winner"),
        F.when(by_cue, cut(F.substr("seg_text", F.col("cue_at") + F.length(cue) + 1), " ,;:.")).when(by_whole, cut(piece(loser_at, F.length(group(2))), " ,;:.")).alias("loser"),
        by_elided.alias("loser_elided"),
        F.when(by_cue, F.col("cue_at")).when(by_whole, whole_at).when(by_elided, elided_at).alias("marker_at"),
        F.when(by_cue, F.length(cue)).when(by_whole, F.length("whole")).when(by_elided, F.length("elided")).alias("marker_length"),
        (fold(F.col("sentence")).rlike(f"(?U){cues.ADVERSATIVE_FOLDED}") | fold(F.col("sentence")).rlike(f"(?U){cues.CONCESSION_FOLDED}")).alias("refines"),
    )


def best_match(mention: Column, options: Column) -> Column:
    """The option sharing most stems with a mention, first by its own text, then with its premises' text; null if none shares any."""
    def by(field: str) -> Column:
        scored = F.transform(options, lambda c: F.struct(F.size(F.array_intersect(stems(mention), c[field])).alias("score"), (-c["seg_no"]).alias("minus"), c["seg_no"].alias("seg_no")))
        top = F.array_max(scored)
        return F.when(top["score"] > 0, top["seg_no"])

    return F.when(mention.isNotNull(), F.coalesce(by("own"), by("extended")))


ROW = "STRUCT<marker_n: INT, winner: INT, loser: INT, delta: ARRAY<INT>, reactivates: ARRAY<INT>, marker_start: INT, marker_end: INT, left_end: INT>"


def ranking_rows(features: DataFrame, grounds: DataFrame, key_rows: DataFrame) -> DataFrame:
    """doc_id and rows: the rankings that hold, in order, each with winner, loser, contexts (delta), those taken up again, its marker's span and cumulative scenario."""
    text = features.select("doc_id", "seg_no", "seg_text", "start")
    premises = grounds.join(text.select("doc_id", F.col("seg_no").alias("premise"), F.col("seg_text").alias("premise_text")), ["doc_id", "premise"])
    joined = premises.groupBy("doc_id", F.col("conclusion").alias("seg_no")).agg(F.concat_ws(" ", F.sort_array(F.collect_list("premise_text"))).alias("more"))
    options = joined.join(text, ["doc_id", "seg_no"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", stems(F.col("seg_text")).alias("own"), stems(F.concat_ws(" ", "seg_text", "more")).alias("extended")))).alias("options"))
    contexts = key_rows.where("kind = 'Context'").join(text, ["doc_id", "seg_no"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", "start"))).alias("contexts"))
    parts = ranking_parts(features).join(options, "doc_id").join(contexts, "doc_id", "left")
    near = F.filter(F.coalesce("contexts", F.expr("CAST(array() AS ARRAY<STRUCT<seg_no: INT, start: INT>>)")), lambda c: (c["seg_no"] < F.col("seg_no")) & (c["start"] >= F.col("sentence_open")))
    left = F.rtrim(F.substr("seg_text", F.lit(1), F.col("marker_at")), F.lit(" ,;:\t"))
    long = F.size(F.split(F.trim(F.regexp_replace(left, r"(?U)\s+", " ")), " ")) >= 2
    sides = parts.select(
        "doc_id", F.struct(
            F.col("seg_no").alias("marker_n"), best_match(F.col("winner"), F.col("options")).alias("winner"), best_match(F.col("loser"), F.col("options")).alias("loser"), "loser_elided", "refines",
            F.when(F.size(near) > 0, F.array(F.element_at(near, -1)["seg_no"])).when(long, F.array("seg_no")).otherwise(F.expr(INTS)).alias("delta"),
            (F.col("start") + F.col("marker_at")).alias("marker_start"), (F.col("start") + F.col("marker_at") + F.col("marker_length")).alias("marker_end"),
            F.when((F.size(near) == 0) & long, F.col("start") + F.length(left)).alias("left_end"),
        ).alias("r"),
    ).groupBy("doc_id").agg(F.sort_array(F.collect_list("r")).alias("found"))

    def step(rows: Column, r: Column) -> Column:
        holder = F.get(F.reverse(F.filter(rows, lambda x: x["loser"] == r["winner"])), F.lit(0))
        loser = F.when(r["loser_elided"], holder["winner"]).otherwise(r["loser"])
        inverse = F.get(F.reverse(F.filter(rows, lambda x: (x["winner"] == loser) & (x["loser"] == r["winner"]))), F.lit(0))
        again = F.when(r["refines"] & inverse.isNotNull(), inverse["delta"]).otherwise(F.expr(INTS))
        row = F.struct(r["marker_n"].alias("marker_n"), r["winner"].alias("winner"), loser.alias("loser"), r["delta"].alias("delta"), again.alias("reactivates"), r["marker_start"].alias("marker_start"), r["marker_end"].alias("marker_end"), r["left_end"].alias("left_end")).cast(ROW)
        ok = r["winner"].isNotNull() & loser.isNotNull() & (r["winner"] != loser) & r["marker_start"].isNotNull()
        return F.when(ok, F.array_append(rows, row)).otherwise(rows)

    folded = sides.select("doc_id", F.aggregate("found", F.expr(f"CAST(array() AS ARRAY<{ROW}>)"), step).alias("rows")).where(F.size("rows") > 0)

    return folded.withColumn("scenarios", scenarios("rows"))


def scenarios(rows: str) -> Column:
    """Of rankings in order, what each holds in: its contexts, those it takes up again, and the scenario of the latest ranking that these belong to."""
    def scenario(done: Column, r: Column) -> Column:
        parent = F.get(F.reverse(F.filter(done, lambda s: F.arrays_overlap(s, r["reactivates"]))), F.lit(0))
        return F.array_append(done, F.sort_array(F.array_union(F.coalesce(parent, F.expr(INTS)), F.array_union(r["delta"], r["reactivates"]))))

    return F.aggregate(rows, F.expr("CAST(array() AS ARRAY<ARRAY<INT>>)"), scenario)


def shown_groups(rank: DataFrame) -> DataFrame:
    """The surface's rankings as rows of groups of one option each: doc_id, row_no, marker_n, preferred, contrasted, delta, reactivates, marker_start, marker_end."""
    one = rank.select("doc_id", F.posexplode("rows").alias("row_no", "r")).select("doc_id", "row_no", "r.*")
    return one.select("doc_id", "row_no", "marker_n", F.array("winner").alias("preferred"), F.array("loser").alias("contrasted"), "delta", "reactivates", "marker_start", "marker_end")


def ranked_groups(groups: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Each option of a preferred group against each of the contrasted one, by the first rule of each.

    groups: doc_id, row_no, preferred, contrasted (arrays of options), when_contexts and
    any other columns, which stay. Gives winner, loser, winner_rule, loser_rule and
    pref_no: rankings of the same rules in the same contexts share one, numbered as they
    first come up. Options without a rule, and a rule against itself, give nothing.
    """
    first = rule_rows.groupBy("doc_id", "conclusion").agg(F.min("rule_no").alias("rule_no"))
    won = groups.select("*", F.posexplode("preferred").alias("w", "winner")).drop("preferred")
    both = won.select("*", F.posexplode("contrasted").alias("l", "loser")).drop("contrasted")
    with_rules = (
        both.join(first.select("doc_id", F.col("conclusion").alias("winner"), F.col("rule_no").alias("winner_rule")), ["doc_id", "winner"])
        .join(first.select("doc_id", F.col("conclusion").alias("loser"), F.col("rule_no").alias("loser_rule")), ["doc_id", "loser"])
        .where("winner_rule <> loser_rule")
    )
    same = Window.partitionBy("doc_id", "winner_rule", "loser_rule", "when_contexts")
    numbered = with_rules.withColumn("event", F.min(F.struct("row_no", "w", "l")).over(same))
    return numbered.withColumn("pref_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("event"))).withColumn("event_row", F.col("event.row_no")).drop("w", "l", "event")


def opposed(groups: DataFrame) -> DataFrame:
    """doc_id, a, b: unordered pairs of options of the two groups of a ranking."""
    pairs = groups.select("doc_id", F.explode("preferred").alias("winner"), "contrasted").select("doc_id", "winner", F.explode("contrasted").alias("loser"))
    return pairs.where("winner <> loser").select("doc_id", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).distinct()


def preferences(groups: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """doc_id, row_no, pref_no, winner_rule, loser_rule, winner, loser, when_contexts, scenario, marker span of groups (see ``shown_groups``): one per distinct ranking of two rules."""
    fields = ["row_no", "marker_n", "preferred", "contrasted", "delta", "reactivates", "marker_start", "marker_end"]
    rows = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    rows = rows.withColumn("scenarios", scenarios("rows"))
    one = rows.select("doc_id", F.inline(F.arrays_zip("rows", "scenarios"))).select("doc_id", "rows.*", F.col("scenarios").alias("scenario"))
    when = F.when(F.size("delta") > 0, F.col("delta")).otherwise(F.col("scenario"))
    return ranked_groups(one.withColumn("when_contexts", F.sort_array(when)), rule_rows)


def meta_preferences(prefs: DataFrame) -> DataFrame:
    """doc_id, winner_pref, loser_pref, when_contexts: opposite rankings of which one's scenario strictly holds the other's."""
    side = lambda p: prefs.select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in ("row_no", "pref_no", "winner", "loser", "scenario")])
    pairs = side("a").join(side("b"), "doc_id").where("a_winner = b_loser AND a_loser = b_winner AND size(array_except(b_scenario, a_scenario)) = 0 AND size(a_scenario) > size(b_scenario)")
    first = F.row_number().over(Window.partitionBy("doc_id", "a_pref_no", "b_pref_no").orderBy("a_row_no", "b_row_no"))
    return pairs.withColumn("k", first).where("k = 1").select("doc_id", F.col("a_pref_no").alias("winner_pref"), F.col("b_pref_no").alias("loser_pref"), F.array_except("a_scenario", "b_scenario").alias("when_contexts"))


def option_scopes(grounds: DataFrame) -> DataFrame:
    """doc_id, members: options that share all their premises, two or more."""
    sets = grounds.groupBy("doc_id", "conclusion").agg(F.sort_array(F.collect_set("premise")).alias("scenario"))
    return sets.groupBy("doc_id", "scenario").agg(F.sort_array(F.collect_list("conclusion")).alias("members")).where(F.size("members") > 1).select("doc_id", "members")


def extract(docs: DataFrame, tokens: DataFrame | None = None, replies: DataFrame | None = None, strategy: str = "hybrid") -> dict[str, DataFrame]:
    """All tables of the argument graphs of docs (doc_id, text).

    With tokens of a parser (see ``parsed``), coordinated subordinates are siblings, and what
    can conclude or condition is as the parse says. With replies of a model (see ``verify``),
    enumerations fall into their items, grounds are what proofs and replies make stand, and
    rankings that the surface leaves open are as named; ``questions`` holds, by stage, what
    there is to ask, the answered questions included, ``ambiguous`` the rankings against
    "the others" that no set near by settles. (With tokens, items of enumerations are no
    sets, as segments are cut again.)
    """
    # dealt by document once: windows and joins by document that follow find their rows in place
    docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    cut_up, lists = segments(docs), None
    if replies is not None:
        said = verify.voted_enumerations(replies)
        cut_up = cut(scope.listed(cut_up, said))
        lists, cut_up = cut_up.where("scope IS NOT NULL").groupBy("doc_id", "scope").agg(F.sort_array(F.collect_list("seg_no")).alias("members")).drop("scope"), cut_up.drop("scope")
    features = cut(relate.featured(cut_up if tokens is None else parsed.divided(cut_up, tokens)))
    siblings = None if tokens is None else parsed.siblings(features)
    own_tokens = None if tokens is None else parsed.moved(tokens, features)
    able = None if tokens is None else cut(parsed.able(features, own_tokens))
    edge_rows = cut(relate.edges(features))
    proven = cut(relate.proofs(features, edge_rows, siblings=siblings))
    labelled, questions = None, {}
    if replies is None:
        ground = relate.grounds(features, proven, siblings)
        if able is not None:
            ends = lambda side, flag: able.where(flag).select("doc_id", F.col("seg_no").alias(side))
            ground = ground.join(ends("conclusion", "can_conclude"), ["doc_id", "conclusion"], "left_semi").join(ends("premise", "can_condition"), ["doc_id", "premise"], "left_semi")
    else:
        flow = features.where("NOT out_of_flow")
        labelled = cut(verify.labelled(flow, replies))
        sure = proven.where("NOT premise_out AND NOT conclusion_out").select("doc_id", "premise", "conclusion")
        shown = sure.select("doc_id", F.explode(F.array("premise", "conclusion")).alias("seg_no"))
        singular_of = None if own_tokens is None else lambda pairs: parsed.singular_events(pairs, parsed.tense(parsed.fragments(own_tokens)))
        questions = verify.run(features, shown.unionByName(labelled).distinct(), sure, replies, strategy, siblings, singular_of, able)
        ground = questions.pop("grounds")
    ground = cut(ground)
    key_rows = cut(keys(features, ground, proven, labelled))
    rule_rows = cut(rules(features, ground))
    rank = cut(ranking_rows(features, ground, key_rows))
    groups, more = shown_groups(rank), {}
    if replies is not None:
        near = option_scopes(ground) if tokens is not None else option_scopes(ground).unionByName(lists)
        added, more["ambiguous"] = ranked.answered(features, key_rows, groups, near, replies)
        groups = cut(groups.unionByName(added))
    prefs = cut(preferences(groups, rule_rows))
    metas = meta_preferences(prefs)
    seg = features.select("doc_id", "seg_no", "start", "end", "seg_text", "gap", "paragraph", "speaker")
    return {"segments": seg, "features": features, "edges": edge_rows, "proofs": proven, "grounds": ground, "keys": key_rows, "rules": rule_rows, "rankings": rank, "preferences": prefs, "meta_preferences": metas, "complements": opposed(groups), "scopes": option_scopes(ground), **more, **({"questions": questions} if questions else {})}
