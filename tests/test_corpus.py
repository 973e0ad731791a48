"""Word documents and the two-level corpus."""

import collections
import time
import zipfile

from pyspark.sql import functions as F

from lodestone.operators import corpus
from lodestone.sources import wordml

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def tc(text, merge=None, style=""):
    m = "" if merge is None else f'<w:tcPr><w:vMerge w:val="{merge}"/></w:tcPr>' if merge else "<w:tcPr><w:vMerge/></w:tcPr>"
    return f"<w:tc>{m}{p(text, style)}</w:tc>"


def tr(*cells):
    return f"<w:tr>{''.join(cells)}</w:tr>"


BODY = (
    p("stray")
    + p("Regulation (EU) No 376/2014", "Heading1")
    + p("COVER REGULATION", "Heading2")
    + p("Having regard to Article 5(1)(A) and  Article 4", "Normal")
    + p("ENACTING TERMS", "Heading2")
    + p("Article 4 Mandatory reporting", "Heading3CR")
    + p("1. First", "ListLevel0")
    + p("(a) point", "ListLevel1")
    + p("(i) deep", "ListLevel2")
    + p("6. Sixth", "ListLevel0")
    + p("(a) other point", "ListLevel1")
    + p("7. See Article 9(2)", "ListLevel0")
    + p("hidden", "AlignRight")
    + f"<w:tbl>{tr(tc('Type', style='TableHead'), tc('Who', style='TableHead'))}{tr(tc('Fire', 'restart'), tc('Pilot'))}{tr(tc('', ''), tc('Crew'))}</w:tbl>"
    + f"<w:tbl>{tr(tc('Only one'))}</w:tbl>"
    + p("Article 4 Mandatory reporting", "Heading3CR")
    + p("again", "Normal")
    + p("Article 5 Nothing", "Heading3CR")
)
XML = f'<w:document {W}><w:body>{BODY}</w:body></w:document>'


def test_blocks_and_corpus(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    blocks = wordml.read_blocks(spark, str(tmp_path)).cache()
    rows = blocks.where("kind = 'tr'").orderBy("block_index").collect()
    assert [r.cells for r in rows] == [["Type", "Who"], ["Fire", "Pilot"], ["Fire", "Crew"], ["Only one"]]
    assert [r.is_header for r in rows] == [True, False, False, False] and [r.table_index for r in rows] == [0, 0, 0, 1]
    parents, children, ignored = corpus.build(blocks)
    own = {r.parent_id: r for r in parents.collect()}
    assert {k for k in own if "_ART_4" in k and len(k) > len("EU_376_2014_ART_4")} and "EU_376_2014_ART_4" in own and "EU_376_2014_RECITALS" in own and len(own) == 3
    assert ignored.first()[0] == 1
    assert own["EU_376_2014_RECITALS"].cross_references == ["Article 4", "Article 5(1)(a)"]
    assert own["EU_376_2014_ART_4"].cross_references == ["Article 9(2)"]
    kids = [r for r in children.orderBy("sequence").collect() if r.parent_id == "EU_376_2014_ART_4"]
    assert [k.canonical_citation for k in kids[:6]] == ["Article 4(1)", "Article 4(1)(a)", "Article 4(1)(a)(i)", "Article 4(6)", "Article 4(6)(a)", "Article 4(7)"]
    assert [k.unit_type for k in kids] == ["list_item"] * 6 + ["table_header", "table_row", "table_row", "callout"]
    assert kids[8].text == "Type: Fire | Who: Crew" and kids[0].child_id == "EU_376_2014_ART_4__C0001"
    assert kids[2].retrieval_text.endswith("Governing text: 1. First (a) point. Evidence: (i) deep")
    assert own["EU_376_2014_ART_4"].child_ids == [k.child_id for k in kids]
    found = {r.code for r in corpus.issues(parents, children).collect()}
    assert found == set()
    broken = {r.code for r in corpus.issues(parents.where("parent_id NOT LIKE '%RECITALS'"), children).collect()}
    assert broken == {"orphan_child"}
    assert {r.style: r.n for r in wordml.style_profile(blocks).collect()}["ListLevel0"] == 3
    assert wordml.heading_candidates(blocks).count() == 3 and wordml.paragraph_ranges(blocks, [(0, 1)]).count() == 2


def test_containers():
    flat = f'<pkg:package xmlns:pkg="http://schemas.microsoft.com/office/2006/xmlPackage"><pkg:part pkg:name="/word/document.xml"><pkg:xmlData>{XML}</pkg:xmlData></pkg:part></pkg:package>'
    import io

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", XML)
    plain = list(wordml.blocks(XML.encode()))
    assert plain == list(wordml.blocks(flat.encode())) == list(wordml.blocks(data.getvalue()))
    try:
        wordml.body(b"<a/>")
    except ValueError:
        return
    raise AssertionError


def test_marker_paths_of_many_children(spark):
    """200,000 children of one parent are one scan; its neighbours do not disturb it."""
    n = 200_000
    mark = F.when(F.col("id") % 4 == 0, F.lit("7")).when(F.col("id") % 4 == 3, F.lit(None)).otherwise(F.lit("b"))
    style = F.when(F.col("id") % 4 == 0, F.lit("ListLevel0")).when(F.col("id") % 4 == 1, F.lit("ListLevel1")).otherwise(F.lit("ListLevel2"))
    rows = spark.range(n).select((F.col("id") * -1).alias("at"), F.when(F.col("id") % 1000 == 999, F.col("id")).otherwise(0).alias("parent"), mark.alias("value"), F.lit("decimal").alias("kind"), style.alias("style"), F.lit("ARTICLE").alias("document_type"))
    began = time.time()
    found = {tuple(r.marker_path): r["count"] for r in corpus.marker_paths(rows, "parent", "at").where("parent = 0").groupBy("marker_path").count().collect()}
    assert time.time() - began < 30 and sum(found.values()) == n - n // 1000
    path, want = [], collections.Counter()
    for i in range(n - 1, -1, -1):
        if i % 1000 != 999:
            path = corpus.path_after(path, "7" if i % 4 == 0 else None if i % 4 == 3 else "b", "decimal", f"ListLevel{min(i % 4, 2)}", "ARTICLE")
            want[tuple(path)] += 1
    assert found == want


def test_build_writes_texts_twice_and_shuffles_them_by_document_only(spark, monkeypatch):
    """Sequences and marker paths are made where the blocks of a document lie; only they, the heads and the parents are written."""
    written, plans = [], []

    def seen(df, name, *more):
        written.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(corpus, "materialized", seen)
    columns = "doc_path string, block_index int, kind string, text string, style string, paragraph_index int, cells array<string>, headers array<string>, is_header boolean, table_index int, row_index int, paragraph_start int, paragraph_end int"
    none = (None,) * 7
    rows = [("a", i, "p", text, style, i, *none) for i, (text, style) in enumerate([("Regulation (EU) No 376/2014", "Heading1"), ("Article 1 One", "Heading3CR"), ("1. first", "ListLevel0"), ("skip", "AlignRight"), ("(a) second", "ListLevel1"), ("Article 2 Two", "Heading3CR"), ("only", "")])]
    parents, children, _ = corpus.build(spark.createDataFrame(rows, columns))
    assert written == ["marked", "heads", "parents"] and plans[0].count("Exchange hashpartitioning") == 1
    assert {(r.parent_id, tuple(r.child_ids), r.text) for r in parents.collect()} == {("EU_376_2014_ART_1", ("EU_376_2014_ART_1__C0001", "EU_376_2014_ART_1__C0002"), "1. first\n(a) second"), ("EU_376_2014_ART_2", ("EU_376_2014_ART_2__C0001",), "only")}
    assert sorted((r.child_id, tuple(r.marker_path), "first" in r.retrieval_text) for r in children.collect()) == [("EU_376_2014_ART_1__C0001", ("1",), True), ("EU_376_2014_ART_1__C0002", ("1", "a"), True), ("EU_376_2014_ART_2__C0001", (), False)]
