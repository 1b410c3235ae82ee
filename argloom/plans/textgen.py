"""Argumentative texts made from the relational tables, with what must be found in them.

Each customer is a document of one of five families (its key modulo 5). A family lists
its segments, each with what stands before it, and the rules, preferences and
preferences between preferences that follow; ``{k}`` is the customer's key, ``{n}`` its
nation. Texts and expectations come from these lists alone, in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.operators import graph
from argloom.session import cut
from argloom.sources import brat

DISCOUNT = [
    ("", "Quand le client {k} dépasse dix tonnes"), (", ", "le dépôt accorde un rabais"), (". ", "Quand le client est récent"), (", ", "le dépôt refuse toute livraison"),
    (". ", "Pour un client {n}"), (", ", "le rabais l'emporte sur le refus de livraison"),
]
FAMILIES = [
    [*DISCOUNT, (". ", "Mais en hiver glacial"), (", ", "le refus de livraison prévaut sur le rabais"), (", ", "même pour un client {n}")],
    DISCOUNT,
    [("", "Quand le stock {k} baisse"), (", ", "le dépôt commande des pièces"), (". ", "Par conséquent"), (", ", "le client {n} attend la livraison")],
    [("", "Comme la route {k} est fermée"), (", ", "et que la pluie tombe"), (", ", "le trajet vers {n} est annulé")],
    [("", "Le contrat {n} prend fin"), (" ", "à l'échéance du bail {k}"), (", ", "en cas de faute grave")],
]
#: By family: (rule, conclusion, variant, conditions), (preference, winner, loser, contexts), (winner, loser, contexts), (segment, kind), (segment, start in it, marker).
RULES = [[(1, 2, 1, [1]), (2, 4, 1, [3])], [(1, 2, 1, [1]), (2, 4, 1, [3])], [(1, 2, 1, [1]), (2, 4, 1, [2])], [(1, 3, 1, [1, 2])], [(1, 1, 1, [2]), (2, 1, 2, [3])]]
PREFERENCES = [[(1, 2, 4, [5]), (2, 4, 2, [7])], [(1, 2, 4, [5])], [], [], []]
METAS = [[(2, 1, [7])], [], [], [], []]
KINDS = [
    [(1, "Context"), (2, "Option"), (3, "Context"), (4, "Option"), (5, "Context"), (7, "Context")], [(1, "Context"), (2, "Option"), (3, "Context"), (4, "Option"), (5, "Context")],
    [(1, "Context"), (2, "Option"), (4, "Option")], [(1, "Context"), (2, "Context"), (3, "Option")], [(1, "Option"), (2, "Context"), (3, "Context")],
]
MARKERS = [[(6, 10, "l'emporte sur"), (8, 22, "prévaut sur")], [(6, 10, "l'emporte sur")], [], [], []]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text, one per customer."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))

    def text(family: list[tuple[str, str]]) -> Column:
        template = "".join(a + b for a, b in family) + "."
        return F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col("c_custkey").cast("string")), F.lit("{n}"), F.col("n_name"))

    family = F.col("c_custkey") % len(FAMILIES)
    made = F.coalesce(*[F.when(family == i, text(f)) for i, f in enumerate(FAMILIES)])
    return rows.select(F.col("c_custkey").alias("doc_id"), made.alias("text"))


_made: dict[tuple[str, str], dict[str, DataFrame]] = {}


def graphs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The extracted tables of the corpus, with entities and events; kept for the application, as many queries read them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _made:
        docs = corpus(spark, sf_dir)
        found = graph.extract(docs)
        found["docs"] = docs
        found["entities"], found["events"] = map(cut, brat.tables(found, docs))
        _made[key] = found
    return _made[key]


def forget() -> None:
    """Makes the next query extract anew, as a benchmark of single queries must."""
    _made.clear()


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    show = lambda x: _quote(x) if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names}))"


def expected_sql(tail: str) -> str:
    """SQL with the tables docs, seg, rule_x, pref_x, meta_x, kind_x, mark_x, ent, and then the tail."""
    pieces = [(f, k + 1, sep, t) for f, family in enumerate(FAMILIES) for k, (sep, t) in enumerate(family)]
    flat = lambda lists: [(f, *row) for f, rows in enumerate(lists) for row in rows]
    return f"""
WITH docs AS (SELECT c_custkey AS doc_id, c_custkey % {len(FAMILIES)} AS family, CAST(c_custkey AS VARCHAR) AS k, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
piece AS {values(pieces, "family, seg_no, sep, template")},
filled AS (SELECT doc_id, docs.family, seg_no, sep, replace(replace(template, '{{k}}', k), '{{n}}', n) AS seg_text FROM docs JOIN piece ON docs.family = piece.family),
placed AS (SELECT *, CAST(sum(length(sep) + length(seg_text)) OVER (PARTITION BY doc_id ORDER BY seg_no) AS INT) AS "end" FROM filled),
seg AS (SELECT doc_id, family, seg_no, sep, seg_text, CAST("end" - length(seg_text) AS INT) AS start, "end" FROM placed),
rule_x AS {values(flat(RULES), "family, rule_no, conclusion, variant_no, conditions")},
pref_x AS {values(flat(PREFERENCES), "family, pref_no, winner, loser, whens")},
meta_x AS {values(flat(METAS), "family, winner_pref, loser_pref, whens")},
kind_x AS {values(flat(KINDS), "family, seg_no, kind")},
mark_x AS {values(flat(MARKERS), "family, seg_no, shift, marker")},
spot AS (SELECT doc_id, seg.family, seg.seg_no, kind, start, "end", seg_text AS span FROM seg JOIN kind_x ON seg.family = kind_x.family AND seg.seg_no = kind_x.seg_no
         UNION ALL SELECT doc_id, seg.family, seg.seg_no, 'Marker', start + shift, start + shift + length(marker), marker FROM seg JOIN mark_x ON seg.family = mark_x.family AND seg.seg_no = mark_x.seg_no),
ent AS (SELECT *, 'T' || row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", kind) AS ent_id FROM spot)
{tail}"""
