"""Stand-off annotation and logic programs: readers, writers, integrity checks.

entities: doc_id, ent_id, kind, start, end, span.
events: doc_id, ev_id, kind, trigger, roles (array of {role, target}).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lines of the annotation format.
ENTITY = r"^(T\d+)\t(Context|Option|Marker) (\d+) (\d+)\t(.*)$"
EVENT = r"^(E\d+)\t(rule|prefer|meta_prefer):(T\d+)((?: [A-Za-z]+:[TE]\d+)*)$"
ATTRIBUTE = r"^(A\d+)\t(Modality|Negated|Implicit) (T\d+)(?: (\S+))?$"


def lines(annotations: DataFrame, doc_id: str = "doc_id", text: str = "ann") -> DataFrame:
    """doc_id, line_no, line of every line that is not blank; null and empty texts have none."""
    split = annotations.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line_no", "line"))
    return split.where(F.trim("line") != "")


def parse(annotations: DataFrame, **names: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, events and attributes (doc_id, attr_id, name, ent_id, value)."""
    rows = lines(annotations, **names)
    part = lambda p, k: F.regexp_extract("line", p, k)
    of = lambda p: rows.where(F.col("line").rlike(p))
    entities = of(ENTITY).select("doc_id", part(ENTITY, 1).alias("ent_id"), part(ENTITY, 2).alias("kind"), part(ENTITY, 3).cast("int").alias("start"), part(ENTITY, 4).cast("int").alias("end"), part(ENTITY, 5).alias("span"))
    roles = F.transform(F.regexp_extract_all(part(EVENT, 4), F.lit(r"[A-Za-z]+:[TE]\d+"), F.lit(0)), lambda r: F.struct(F.substring_index(r, ":", 1).alias("role"), F.substring_index(r, ":", -1).alias("target")))
    events = of(EVENT).select("doc_id", part(EVENT, 1).alias("ev_id"), part(EVENT, 2).alias("kind"), part(EVENT, 3).alias("trigger"), roles.alias("roles"))
    attributes = of(ATTRIBUTE).select("doc_id", part(ATTRIBUTE, 1).alias("attr_id"), part(ATTRIBUTE, 2).alias("name"), part(ATTRIBUTE, 3).alias("ent_id"), F.nullif(part(ATTRIBUTE, 4), F.lit("")).alias("value"))
    return entities, events, attributes


def number(c: str | Column) -> Column:
    """The number in an identifier."""
    return F.regexp_extract(c, r"\d+", 0).cast("int")


def tables(graph: dict[str, DataFrame], docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities and events of extracted graphs, numbered in canonical order; documents without a rule have none."""
    place = graph["features"].select("doc_id", F.col("seg_no").alias("entity"), "start", "end")
    ranks = graph["rankings"].select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.*")
    starts = graph["features"].select("doc_id", F.col("seg_no").alias("marker_n"), "start")
    lefts = ranks.where("left_end IS NOT NULL").join(starts, ["doc_id", "marker_n"]).select("doc_id", F.col("marker_n").alias("seg_no"), F.lit("Context").alias("kind"), "start", F.col("left_end").alias("end"))
    places = graph["keys"].join(place, ["doc_id", "entity"]).select("doc_id", "seg_no", "kind", "start", "end").unionByName(lefts)
    prefs, metas = graph["preferences"].where("row_no = event_row"), graph["meta_preferences"]
    markers = prefs.select("doc_id", F.lit("Marker").alias("kind"), F.col("marker_start").alias("start"), F.col("marker_end").alias("end"))
    with_rules = graph["rules"].select("doc_id").distinct()
    spans = places.select("doc_id", "kind", "start", "end").unionByName(markers).distinct().join(with_rules, "doc_id", "left_semi")
    numbered = spans.withColumn("ent_id", F.concat(F.lit("T"), F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "kind"))))
    entities = numbered.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "ent_id", "kind", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))
    ids = places.join(numbered, ["doc_id", "kind", "start", "end"]).select("doc_id", "seg_no", "ent_id").dropDuplicates(["doc_id", "seg_no"])
    marks = numbered.where("kind = 'Marker'").select("doc_id", F.col("start").alias("marker_start"), F.col("end").alias("marker_end"), F.col("ent_id").alias("trigger"))

    def named(df: DataFrame, keys: list[str], numbers: str, role: str) -> DataFrame:
        """keys and roles: the array of numbers as roles, in order."""
        one = df.select("doc_id", *keys, F.posexplode(numbers).alias("k", "seg_no")).join(ids, ["doc_id", "seg_no"])
        return one.groupBy("doc_id", *keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ent_id"))), lambda x: F.struct(F.lit(role).alias("role"), x["ent_id"].alias("target"))).alias("roles"))

    rules = graph["rules"]
    options = ids.select("doc_id", F.col("seg_no").alias("conclusion"), F.col("ent_id").alias("trigger"))
    role = lambda name, target: F.array(F.struct(F.lit(name).alias("role"), target.alias("target")))
    event = lambda n: F.concat(F.lit("E"), n.cast("string"))
    rule_events = rules.join(named(rules, ["rule_no"], "conditions", "Condition"), ["doc_id", "rule_no"]).join(options, ["doc_id", "conclusion"]).select(
        "doc_id", event(F.col("rule_no")).alias("ev_id"), F.lit("rule").alias("kind"), "trigger", F.concat("roles", role("Effect", F.col("trigger"))).alias("roles")
    )
    counts = rules.groupBy("doc_id").agg(F.max("rule_no").alias("n_rules"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<role: STRING, target: STRING>>)")
    pref_rows = prefs.join(counts, "doc_id").join(marks, ["doc_id", "marker_start", "marker_end"]).join(named(prefs, ["pref_no"], "when_contexts", "When"), ["doc_id", "pref_no"], "left")
    ranked = lambda w, l: F.concat(role("Winner", event(w)), role("Loser", event(l)), F.coalesce("roles", none))  # noqa: E731, E741
    pref_events = pref_rows.select("doc_id", event(F.col("n_rules") + F.col("pref_no")).alias("ev_id"), F.lit("prefer").alias("kind"), "trigger", ranked(F.col("winner_rule"), F.col("loser_rule")).alias("roles"))
    last = counts.join(prefs.groupBy("doc_id").agg(F.max("pref_no").alias("n_prefs")), "doc_id")
    metas = metas.withColumn("meta_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("winner_pref", "loser_pref")))
    meta_rows = (
        metas.join(last, "doc_id").join(prefs.select("doc_id", F.col("pref_no").alias("winner_pref"), "marker_start", "marker_end"), ["doc_id", "winner_pref"])
        .join(marks, ["doc_id", "marker_start", "marker_end"]).join(named(metas, ["meta_no"], "when_contexts", "When"), ["doc_id", "meta_no"], "left")
    )
    meta_events = meta_rows.select("doc_id", event(F.col("n_rules") + F.col("n_prefs") + F.col("meta_no")).alias("ev_id"), F.lit("meta_prefer").alias("kind"), "trigger", ranked(F.col("n_rules") + F.col("winner_pref"), F.col("n_rules") + F.col("loser_pref")).alias("roles"))
    return entities, rule_events.unionByName(pref_events).unionByName(meta_events)


def _text(rows: DataFrame) -> DataFrame:
    """doc_id and value: rows (doc_id, section, n, line) joined by line feeds in order."""
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section", "n", "line"))).alias("x"))
    return listed.select("doc_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("value"))


def attributes(entities: DataFrame, said: DataFrame) -> DataFrame:
    """doc_id, attr_id, name, ent_id, value of what is said (doc_id, ent_id, name, value) of entities there are: each once, numbered by entity, name and value, so that all sinks name it alike."""
    known = said.select("doc_id", "ent_id", "name", "value").distinct().join(entities.select("doc_id", "ent_id"), ["doc_id", "ent_id"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(number("ent_id"), "name", "value")
    return known.select("doc_id", F.concat(F.lit("A"), F.row_number().over(order)).alias("attr_id"), "name", "ent_id", "value")


def render(entities: DataFrame, events: DataFrame, attribute_rows: DataFrame | None = None) -> DataFrame:
    """doc_id, ann; attribute_rows are those of ``attributes``."""
    tab = F.lit("\t")
    e = entities.select("doc_id", F.lit(0).alias("section"), number("ent_id").alias("n"), F.concat("ent_id", tab, "kind", F.lit(" "), F.col("start").cast("string"), F.lit(" "), F.col("end").cast("string"), tab, "span").alias("line"))
    roles = F.transform("roles", lambda r: F.concat(r["role"], F.lit(":"), r["target"]))
    v = events.select("doc_id", F.lit(1).alias("section"), number("ev_id").alias("n"), F.concat("ev_id", tab, F.array_join(F.concat(F.array(F.concat("kind", F.lit(":"), "trigger")), roles), " ")).alias("line"))
    out = e.unionByName(v)
    if attribute_rows is not None:
        a = attribute_rows.select("doc_id", F.lit(2).alias("section"), number("attr_id").alias("n"), F.concat("attr_id", tab, F.concat_ws(" ", "name", "ent_id", "value")).alias("line"))
        out = out.unionByName(a)
    return _text(out).withColumnRenamed("value", "ann")


def render_lpp(entities: DataFrame, events: DataFrame, complements: DataFrame | None = None, forms: DataFrame | None = None, diagnostics: DataFrame | None = None, attribute_rows: DataFrame | None = None) -> DataFrame:
    """doc_id, lpp. attribute_rows (see ``attributes``) stand at the end as comments that name the component; complements: doc_id, a, b (entity ids of options); forms: doc_id, ent_id, form (logical form, stands before the label); diagnostics: doc_id, n, message (comments, in order)."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    own = Window.partitionBy("doc_id", "kind").orderBy("start", "end")
    literal = entities.where("kind <> 'Marker'").withColumn("lit", F.concat(F.when(F.col("kind") == "Context", "c").otherwise("o"), F.row_number().over(own).cast("string")))
    predicate = F.when(F.col("kind") == "Context", "scenario").otherwise("option")
    heads = entities.select("doc_id").distinct().select("doc_id", F.lit(0).alias("section"), F.lit(0).alias("n"), F.lit("% Normalised components\n% Labels keep the exact source text.").alias("line"))
    formed = literal.withColumn("form", F.lit(None).cast("string")) if forms is None else literal.join(forms.select("doc_id", "ent_id", "form").dropDuplicates(["doc_id", "ent_id"]), ["doc_id", "ent_id"], "left")
    own_form = F.when(F.col("form") != "", F.concat(F.lit(", "), "form")).otherwise("")
    # by place, contexts and options among each other
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "kind", number("ent_id")))
    named = formed.select("doc_id", F.lit(1).alias("section"), place.alias("n"), F.format_string("%s(%s%s, %s).", predicate, F.col("lit"), own_form, quoted(F.col("span"))).alias("line"))
    per_kind = Window.partitionBy("doc_id", "kind").orderBy(number("ev_id"))
    coded = events.withColumn("code", F.concat(F.when(F.col("kind") == "rule", "r").when(F.col("kind") == "prefer", "p").otherwise("mp"), F.row_number().over(per_kind).cast("string")))
    known = literal.select("doc_id", F.col("ent_id").alias("target"), F.col("lit").alias("code")).unionByName(coded.select("doc_id", F.col("ev_id").alias("target"), "code"))
    roles = coded.select("doc_id", "ev_id", F.posexplode("roles").alias("k", "r")).select("doc_id", "ev_id", "k", "r.role", "r.target").join(known, ["doc_id", "target"])
    pick = lambda name: F.transform(F.filter("roles", lambda r: r["role"] == name), lambda r: r["code"])
    gathered = roles.groupBy("doc_id", "ev_id").agg(F.sort_array(F.collect_list(F.struct("k", "role", "code"))).alias("roles"))
    body = F.when(F.col("kind") == "rule", F.format_string("rule(%s, [%s], %s).", F.col("code"), F.array_join(pick("Condition"), ", "), F.get(pick("Effect"), F.lit(0)))).otherwise(
        F.format_string("%s(%s, [%s], %s, %s).", F.col("kind"), F.col("code"), F.array_join(pick("When"), ", "), F.get(pick("Winner"), F.lit(0)), F.get(pick("Loser"), F.lit(0)))
    )
    facts = coded.select("doc_id", "ev_id", "kind", "code").join(gathered, ["doc_id", "ev_id"]).select("doc_id", F.lit(3).alias("section"), number("ev_id").alias("n"), body.alias("line"))
    out = heads.unionByName(named).unionByName(facts)
    if diagnostics is not None:
        said = diagnostics.where("message <> ''").join(entities.select("doc_id").distinct(), "doc_id", "left_semi")
        out = out.unionByName(said.select("doc_id", F.lit(0).alias("section"), (F.col("n") + 1).cast("int").alias("n"), F.concat(F.lit("% "), F.regexp_replace("message", r"\s+", " ")).alias("line")))
    if complements is not None:
        a, b = (literal.select("doc_id", F.col("ent_id").alias(x), F.col("lit").alias(f"lit_{x}")) for x in "ab")
        pairs = complements.join(a, ["doc_id", "a"]).join(b, ["doc_id", "b"])
        out = out.unionByName(pairs.select("doc_id", F.lit(2).alias("section"), number("lit_a").alias("n"), F.format_string("complement(%s, %s).", F.col("lit_a"), F.col("lit_b")).alias("line")))
    if attribute_rows is not None:
        named = attribute_rows.join(literal.select("doc_id", "ent_id", "lit"), ["doc_id", "ent_id"])
        out = out.unionByName(named.select("doc_id", F.lit(4).alias("section"), number("attr_id").alias("n"), F.concat(F.lit("% "), F.concat_ws(" ", "attr_id", "name", "lit", "value")).alias("line")))
    return _text(out).withColumnRenamed("value", "lpp")


def violations(annotations: DataFrame, **names: str) -> DataFrame:
    """doc_id, code, subject: every breach of the graph's rules, not only the first."""
    entities, events, attributes = parse(annotations, **names)
    rows = lines(annotations, **names)
    bad = lambda df, code, subject: df.select("doc_id", F.lit(code).alias("code"), subject.alias("subject"))
    twice = lambda df, c, code: bad(df.groupBy("doc_id", c).count().where("count > 1"), code, F.col(c))
    role = events.select("doc_id", "ev_id", "kind", F.explode("roles").alias("r")).select("doc_id", "ev_id", "kind", "r.role", "r.target")
    ent, ev = entities.select("doc_id", F.col("ent_id").alias("target"), F.col("kind").alias("target_kind")), events.select("doc_id", F.col("ev_id").alias("target"), F.col("kind").alias("target_kind"))
    known = ent.unionByName(ev)
    typed = role.join(known.dropDuplicates(["doc_id", "target"]), ["doc_id", "target"])
    trigger = events.select("doc_id", "ev_id", "kind", F.col("trigger").alias("target")).join(ent.dropDuplicates(["doc_id", "target"]), ["doc_id", "target"])
    n = lambda name: F.size(F.filter("roles", lambda r: r["role"] == name))
    of = lambda name: F.get(F.transform(F.filter("roles", lambda r: r["role"] == name), lambda r: r["target"]), F.lit(0))
    docs = annotations.select(F.col(names.get("doc_id", "doc_id")).alias("doc_id")).distinct()
    with_option = entities.where("kind = 'Option'").select("doc_id").distinct()
    checks = [
        twice(entities, "ent_id", "duplicate_entity"), twice(events, "ev_id", "duplicate_event"),
        bad(rows.where(~F.col("line").rlike(ENTITY) & ~F.col("line").rlike(EVENT) & ~F.col("line").rlike(ATTRIBUTE)), "bad_line", F.col("line")),
        bad(docs.join(with_option, "doc_id", "left_anti").join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "no_option", F.lit(None).cast("string")),
        bad(role.join(known, ["doc_id", "target"], "left_anti"), "unknown_target", F.col("ev_id")),
        bad(events.withColumn("target", F.col("trigger")).join(ent, ["doc_id", "target"], "left_anti"), "unknown_trigger", F.col("ev_id")),
        bad(attributes.withColumn("target", F.col("ent_id")).join(ent, ["doc_id", "target"], "left_anti"), "unknown_attribute_target", F.col("attr_id")),
        bad(role.where("target = ev_id"), "self_reference", F.col("ev_id")),
        bad(trigger.where("(kind = 'rule') <> (target_kind = 'Option') OR (kind <> 'rule' AND target_kind <> 'Marker')"), "bad_trigger", F.col("ev_id")),
        bad(events.where((F.col("kind") == "rule") & ((n("Effect") != 1) | (n("Condition") < 1))), "bad_rule_shape", F.col("ev_id")),
        bad(typed.where("kind = 'rule' AND (role = 'Effect' AND target_kind <> 'Option' OR role = 'Condition' AND target_kind NOT IN ('Context', 'Option'))"), "bad_rule_role", F.col("ev_id")),
        bad(typed.where("role = 'When' AND target_kind <> 'Context'"), "bad_when", F.col("ev_id")),
        bad(events.where((F.col("kind") != "rule") & ((n("Winner") != 1) | (n("Loser") != 1) | of("Winner").eqNullSafe(of("Loser")))), "bad_ranking_shape", F.col("ev_id")),
        bad(typed.where("kind = 'prefer' AND role IN ('Winner', 'Loser') AND target_kind <> 'rule' OR kind = 'meta_prefer' AND role IN ('Winner', 'Loser') AND target_kind NOT IN ('prefer', 'meta_prefer')"), "bad_ranked", F.col("ev_id")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.distinct()


def repair_offsets(entities: DataFrame, docs: DataFrame, reworded: bool = False) -> DataFrame:
    """Entities whose claimed place does not hold their span move to the nearest place that does (null where there is none). With ``reworded``, a span that is nowhere gives way to the words of the text that align with it."""
    from argloom.functions.aligned import places
    from argloom.functions.text import occurrences, trimmed_span

    df = entities.join(docs.select("doc_id", "text"), "doc_id")
    right = F.substr("text", F.col("start") + 1, F.length("span")) == F.col("span")
    near = F.array_min(F.transform(occurrences(F.col("text"), F.col("span")), lambda c: F.struct(F.abs(c["start"] - F.col("start")).alias("d"), c["start"].alias("at"), c["end"].alias("to"))))
    start = F.when(right, F.col("start")).otherwise(near["at"]).cast("int")
    end = F.when(right, F.col("start") + F.length("span")).otherwise(near["to"]).cast("int")
    moved = df.select("doc_id", "ent_id", "kind", start.alias("start"), end.alias("end"), "span", "text")
    if not reworded:
        return moved.drop("text")
    keys = ["doc_id", "ent_id"]
    lost = moved.where("start IS NULL").select(*keys, "text", trimmed_span(F.col("span")).alias("span"))
    found = places(lost, keys).select(*keys, F.col("start").alias("a"), F.col("end").alias("b"))
    span = F.when(F.col("a").isNotNull(), F.substr("text", F.col("a") + 1, F.col("b") - F.col("a"))).otherwise(F.col("span"))
    return moved.join(found, keys, "left").select(*keys, "kind", F.coalesce("start", "a").cast("int").alias("start"), F.coalesce("end", "b").cast("int").alias("end"), span.alias("span"))
