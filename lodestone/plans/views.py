"""How the driver's tables stand in for the domain: documents are parents, their lines children, benchmark items questions.

Each view exists for Spark and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.corpus import child_id
from lodestone.plans.registry import Tables

#: Expressions that both engines read alike.
TITLE = """CASE doc_id % 6 WHEN 0 THEN 'Article ' || CAST(doc_id % 40 AS STRING) || 'a Reporting' WHEN 1 THEN 'ANNEX IV of ' || source WHEN 2 THEN CAST(doc_id % 9 AS STRING) || '.' || CAST(doc_id % 7 AS STRING) || ' Guidance' WHEN 3 THEN 'Powers and recitals' WHEN 4 THEN 'LIST OF ACRONYMS' ELSE 'Some – other — title ' || source END"""
KIND = """CASE doc_id % 6 WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'ANNEX' WHEN 2 THEN 'GM' WHEN 3 THEN 'RECITALS' WHEN 4 THEN 'GM' ELSE 'ARTICLE' END"""
SECTION = """CASE WHEN doc_id % 4 = 0 THEN 'ANNEX part' ELSE 'Section ' || lang END"""
MARKED = """CASE doc_id % 6 WHEN 0 THEN '1.2 text' WHEN 1 THEN '(3) text' WHEN 2 THEN '(B) text' WHEN 3 THEN '(iv) text' WHEN 4 THEN '7. text' ELSE 'no marker (4)' END"""
CITED = """'See Article ' || CAST(doc_id % 9 AS STRING) || '(2)(B), article ' || CAST(doc_id % 5 AS STRING) || ' and Article 4' || ' [' || source || ']'"""
CHOICE = """CASE doc_id % 8 WHEN 0 THEN 'Oui / Yes' WHEN 1 THEN 'Non / No' WHEN 2 THEN 'Partiellement / Partially' WHEN 3 THEN 'Incertain' WHEN 4 THEN 'Accepter / Accept' WHEN 5 THEN 'Accepter avec correction / Accept with correction' WHEN 6 THEN 'Je passe cette fiche / I skip' ELSE '' END"""

LINES_CTE = """lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sequence, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')"""
TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def lines(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """(doc_id, sequence, line): the non-blank lines of documents, or only of those named by of (doc_id)."""
    documents = t.documents if of is None else t.documents.join(of, "doc_id", "left_semi")
    kept = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\P{Zs}"))  # DuckDB trims all spaces of Unicode
    return documents.select("doc_id", F.posexplode(kept).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("sequence"), "line")


def children(t: Tables, of: DataFrame | None = None) -> DataFrame:
    own = lines(t, of)
    return own.select(child_id(F.col("doc_id"), F.col("sequence")).alias("child_id"), F.col("doc_id").alias("parent_id"), "sequence", F.col("line").alias("text"), F.concat(F.lit("Article "), (F.col("sequence") % 7).cast("string")).alias("canonical_citation"))


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qa_id"), F.col("text").alias("question"))
