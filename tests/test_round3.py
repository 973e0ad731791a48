"""Odd inputs of the third review."""

import math

import duckdb
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.llm import quality
from lodestone.operators import citations, mapping, providers
from lodestone.plans.registry import Tables
from lodestone.plans.views import children


def written(spark, folder, **tables):
    """Tables (rows, schema) under folder as Parquet."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def like_sql(spark, folder, name, tables):
    got = plans.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    c = duckdb.connect()
    for table in tables:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[k] for k in columns) for r in got.collect()))) == sorted(repr(tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r)) for r in want)


def cancelling() -> str:
    """Two tokens of one bucket with opposite signs."""
    embed = providers.hashed_vectors()
    first = "aaaa"
    at = {i for i, x in enumerate(next(iter(embed([first])))[1]) if x}
    for n in range(10_000):
        v = next(iter(embed([f"b{n}"])))[1]
        if {i for i, x in enumerate(v) if x} == at and v != next(iter(embed([first])))[1]:
            return f"{first} b{n}"
    raise AssertionError


def test_vector_cache_of_alike_texts(spark, tmp_path):
    rows = [(0, None), (1, None), (3, "a  "), (4, "a"), (6, "a"), (-3, "c"), (-2, "c"), (3 << 31, "d"), ((3 << 31) + 1, "d"), (9, ""), (10, "ß"), (13, cancelling())]
    folder = written(spark, tmp_path / "t", documents=(rows, "doc_id long, text string"))
    like_sql(spark, folder, "s11_s12_vector_cache", ["documents"])


def test_quality_model_counts_all_trusted_texts(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    model = quality.train(docs, docs.selectExpr("doc_id", "1 AS quality"))
    n = sum(len(f"t{i}") + 1 for i in range(20_500))
    assert model.counts.agg(F.sum("c")).first()[0] == n


def test_quality_thresholds_are_exact(spark):
    rows = spark.range(300_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS lang", "2 + (id * 7919) % 300007 / 1e4D AS perplexity")
    got = {(r.whole, r.lang): (r.at, r.n) for r in quality.quantiles(rows, 0.999).collect()}
    values = {i: 2 + (i * 7919) % 300007 / 1e4 for i in range(300_000)}
    for key, own in {(True, None): values.values(), (False, "a"): [v for i, v in values.items() if i % 3 == 0], (False, "b"): [v for i, v in values.items() if i % 3 == 1]}.items():
        own = sorted(own)
        assert got.pop(key) == (own[math.ceil(len(own) * 0.999) - 1], len(own))
    assert not got


def test_only_the_parents_asked_are_tokenised(spark):
    """Children whose parent no record names are left out before they are tokenised, and their documents before they are cut into lines."""
    qa = spark.createDataFrame([(1, 3, "a b", "", "Article 3"), (2, None, "a", "", "")], "qa_id long, parent_id long, question string, answer string, citation string")
    got = mapping.child_candidates(qa, children(Tables(spark, "/root/testdata/sf0.001")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and {r.qa_id for r in got.collect()} == {1}
    plan = plans.QUERIES["r06_child_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Join LeftSemi")


def test_containment_of_empty_and_wordless_texts(spark):
    side = lambda key, *texts: spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")
    got = mapping.containment(side("chunk_id", None, "", "!", "A b", "x"), side("parent_id", "", "a, b", None, "§", "xylo"))
    assert {tuple(r) for r in got.collect()} == {(3, 1, True, True, True), (4, 4, False, True, False)}


def test_citations_read_other_text_as_one_lexeme():
    """Text that no citation can be part of is not cut into words, and what stands beside numbers and labels still is."""
    text = "see article 4(1)(a) and then, " + "some words of another text. " * 1000 + "abcd1 recital 3 (ab ) 376/2014"
    assert len(citations.lexemes(text)) < 60
    assert [x[:4] for x in citations.parse(text)] == [("376/2014", "ARTICLE", "4", ["1", "a"]), ("376/2014", "RECITALS", "3", [])]
    assert [x.text for x in citations.lexemes("4abcd efgh ")][:2] == ["4", "abcd"]


def test_citation_rows_carry_no_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(citations, "candidates", lambda cited, parents, own=citations.candidates: seen.append(cited.columns) or own(cited, parents))
    pairs = spark.createDataFrame([(1, "Article 4(1) of Regulation 376/2014", "Article 4")], "id long, prediction string, gold string")
    parents = spark.createDataFrame([("EU_376_2014_ART_4",)], "parent_id string")
    assert [tuple(r) for r in citations.matches(pairs, parents).collect()] == [(1, False, True)]
    assert len(seen) == 2 and not any("text" in c for c in seen)
