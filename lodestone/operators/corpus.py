"""From blocks to a two-level corpus: state by windows, markers by a fold, parents by aggregation, and validation.

Blocks of a document are ordered by block_index; everything is partitioned by document, then by parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestone.functions.text import child_citation, cross_references, marker_kind, marker_value, parent_identity, retrieval_text, short_digest, table_text, unit_type, word_count
from lodestone.sources.shared import materialized

# Headings that open a document, with its id, regulation and kind; and styles that hold no content.
DOCUMENTS = {
    "Regulation (EU) No 376/2014": ("EU_376_2014", "EU 376/2014", "REGULATION"),
    "Commission Implementing Regulation (EU) 2015/1018": ("EU_2015_1018", "EU 2015/1018", "IMPLEMENTING_REGULATION"),
    "Commission Delegated Regulation (EU) 2020/2034": ("EU_2020_2034", "EU 2020/2034", "DELEGATED_REGULATION"),
    "Commission Implementing Regulation (EU) 2021/2082": ("EU_2021_2082", "EU 2021/2082", "IMPLEMENTING_REGULATION"),
    "Guidance Material — Regulation (EU) No 376/2014 and its implementing rules": ("GM_EU_376_2014", "EU 376/2014 and implementing rules", "GUIDANCE_MATERIAL"),
}
SKIPPED_STYLES = ("Dxshortdesc", "AlignRight")
COVER, RECITALS = "cover regulation", "Powers and recitals"


def sequence(rows: DataFrame, parent: str, order: str, name: str = "sequence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(order)))


def child_id(parent: Column, number: Column) -> Column:
    return F.concat(parent.cast("string"), F.lit("__C"), F.lpad(number.cast("string"), 4, "0"))


def path_after(path: list[str], value: str | None, kind: str | None, style: str | None, document_type: str | None) -> list[str]:
    """The marker path of an item, from that of the item before it."""
    if value is None:
        return path
    statute, dotted = document_type in ("ARTICLE", "ANNEX"), value.split(".")
    if document_type == "ARTICLE" and style == "ListLevel0" and kind in ("decimal", "parenthesized_number"):
        return dotted[:1]
    if document_type == "ANNEX" and kind == "decimal":
        return dotted
    if statute and style in ("ListLevel1", "ListLevel2"):
        return [*path[: int(style[-1])], value]
    return dotted if kind == "decimal" else [*path, value]


def folded(ordered: DataFrame, *parent: str) -> DataFrame:
    """ordered (value, kind, style, document_type of each item, its sequence, and any others) with marker_path, null without a sequence. The items of a parent follow each other in order in one partition."""

    def fold(batches):
        import pyarrow as pa

        last, path = object(), []
        for batch in batches:
            out = []
            for sequence, *item in zip(*(batch.column(c).to_pylist() for c in ("sequence", "value", "kind", "style", "document_type", *parent))):
                if sequence is None:
                    out.append(None)
                    continue
                if item[4:] != last:
                    last, path = item[4:], []
                path = path_after(path, *item[:4])
                out.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "marker_path"])

    return ordered.mapInArrow(fold, StructType([*ordered.schema.fields, StructField("marker_path", ArrayType(StringType()))]))


def marker_paths(rows: DataFrame, parent: str, order: str) -> DataFrame:
    """rows (value, kind, style, document_type of each item, and any others) with marker_path, folded over the items of each parent.

    Partitions are sorted by parent and order and read once; a task holds one path, however many items a parent has.
    """
    ordered = rows if "sequence" in rows.columns else rows.withColumn("sequence", F.lit(0))
    found = folded(ordered.repartition(parent).sortWithinPartitions(parent, order), parent)
    return found.select(*rows.columns, "marker_path")


def headed(blocks: DataFrame, version: str = "2022-12") -> DataFrame:
    """blocks (doc_path, block_index, kind, text, style, paragraph_index, ...) with their document, titles and parent's number; heading rows are gone, ignored ones have no parent."""
    order = Window.partitionBy("doc_path").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    text, style, is_p = F.col("text"), F.coalesce("style", F.lit("")), F.col("kind") == "p"
    opens = is_p & (style == "Heading1") & text.isin(*DOCUMENTS)
    known = F.create_map(*(x for k, v in DOCUMENTS.items() for x in (F.lit(k), F.struct(*(F.lit(y).alias(n) for y, n in zip(v, ("document_id", "regulation_id", "regulation_kind")))))))
    own = blocks.withColumn("opens", opens).withColumn("doc", F.last(F.when(opens, known[text]), True).over(order)).withColumn("docs", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    inside = F.col("doc").isNotNull() & ~F.col("opens")
    in_doc = Window.partitionBy("doc_path", "docs").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    section = inside & is_p & (style == "Heading2")
    formal = inside & is_p & (style == "Formaltitle")
    kind = (
        F.when(~(inside & is_p), F.lit(None).cast("string"))
        .when(style == "Heading3CR", F.when(F.lower(text) == RECITALS.lower(), "RECITALS").otherwise("ARTICLE"))
        .when(style == "Heading3IR", "ANNEX")
        .when(style == "Heading3GM", "GM")
        .when((style == "Heading2GM") & (F.upper(text) == "LIST OF ACRONYMS"), "GM")
    )
    own = own.withColumns({"is_section": section, "is_formal": formal, "unit": kind})
    own = own.withColumns({"section_title": F.coalesce(F.last(F.when(section, text), True).over(in_doc), F.lit("")), "formal_title": F.last(F.when(formal | F.col("opens"), text), True).over(in_doc)})
    own = own.withColumn("sections", F.sum(F.when(F.col("is_section") | F.col("opens"), 1).otherwise(0)).over(order))
    in_section = Window.partitionBy("doc_path", "sections").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("units", F.sum(F.when(F.col("unit").isNotNull(), 1).otherwise(0)).over(in_section))
    plain = is_p & inside & ~section & ~formal & F.col("unit").isNull()
    cover = plain & (F.col("units") == 0) & (F.lower("section_title") == COVER) & (F.col("doc.regulation_kind") != "GUIDANCE_MATERIAL")
    own = own.withColumn("implied", (F.col("units") == 0) & (F.max(F.when(cover, 1).otherwise(0)).over(in_section) == 1))
    first_cover = F.min(F.when(cover, F.struct("block_index", "text", "paragraph_index"))).over(in_section)
    head = F.last(F.when(F.col("unit").isNotNull(), F.struct("block_index", "text", "paragraph_index", "unit", "formal_title")), True).over(in_section)
    own = own.withColumns({"head": head, "cover": first_cover})
    is_content = F.col("unit").isNull() & ~section & ~formal & ~F.col("opens")
    # The type and title of the parent that cover text opens by itself.
    made = F.when(F.col("units") > 0, F.struct(F.col("head.block_index").alias("start"), F.col("head.text").alias("title"), F.col("head.text").alias("named"), F.col("head.paragraph_index").alias("at"), F.col("head.unit").alias("document_type"), F.col("head.formal_title").alias("formal_title"))).when(
        F.col("implied"), F.struct(F.col("cover.block_index").alias("start"), F.lit(RECITALS).alias("title"), F.col("cover.text").alias("named"), F.col("cover.paragraph_index").alias("at"), F.lit("RECITALS").alias("document_type"), F.col("formal_title"))
    )
    return own.where(is_content).withColumn("parent", made).withColumn("document_version", F.lit(version)).select("doc_path", "block_index", "kind", "text", style.alias("style"), "paragraph_index", "cells", "headers", "is_header", "table_index", "row_index", "paragraph_start", "paragraph_end", "doc", "section_title", "parent", "document_version")


def marked(own: DataFrame) -> DataFrame:
    """headed blocks with body, unit_type, source_location and, for those that are content of a parent, their sequence and marker_path.

    A parent lies in one document, so where the blocks are partitioned by document nothing is shuffled.
    """
    is_p = F.col("kind") == "p"
    text = F.when(is_p, F.col("text")).otherwise(table_text(F.col("cells"), F.col("headers")))
    own = own.withColumn("body", text)
    content = F.col("parent").isNotNull() & ((F.col("kind") == "tr") & (F.col("body") != "") | is_p & ~F.col("style").isin(*SKIPPED_STYLES))
    before = Window.partitionBy("doc_path", "parent.start").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("content", F.coalesce(content, F.lit(False))).withColumn("sequence", F.when(F.col("content"), F.sum(F.col("content").cast("int")).over(before).cast("int")))
    place = F.struct(F.coalesce("paragraph_index", "paragraph_start").alias("xml_paragraph_start"), F.coalesce("paragraph_index", "paragraph_end").alias("xml_paragraph_end"), "table_index", F.col("row_index").alias("table_row_index"))
    rows = own.select(
        "doc_path",
        "block_index",
        "doc",
        "section_title",
        "parent",
        "document_version",
        "sequence",
        F.when(F.col("content"), F.col("body")).alias("body"),
        unit_type(F.col("kind"), F.col("style"), F.col("is_header"), F.col("cells")).alias("unit_type"),
        place.alias("source_location"),
        F.col("parent.start").alias("start"),
        F.when(is_p, marker_value(F.col("body"))).alias("value"),
        marker_kind(F.col("body")).alias("kind"),
        "style",
        F.col("parent.document_type").alias("document_type"),
    )
    found = folded(rows.sortWithinPartitions("doc_path", "start", "block_index"), "doc_path", "start")
    return found.drop("start", "value", "kind", "style", "document_type")


def build(blocks: DataFrame, version: str = "2022-12") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children, ignored): ignored is one row with the number of content blocks outside any parent. children are made anew from written tables whenever they are read."""
    own = materialized(marked(headed(blocks.repartition("doc_path"), version)), "marked", "zstd")
    ignored = own.agg(F.count_if(F.col("parent").isNull()).alias("ignored_blocks"))
    named = parent_identity(F.col("doc.document_id"), F.col("parent.document_type"), F.col("parent.title"), F.col("section_title"))
    heads = own.where("parent IS NOT NULL").select("doc_path", "doc", "section_title", "parent", "document_version").distinct().withColumn("name", named)
    again = F.row_number().over(Window.partitionBy("name.parent_id").orderBy("doc_path", "parent.start")) > 1
    heads = heads.withColumn("parent_id", F.when(again, F.concat("name.parent_id", F.lit("_"), short_digest(F.concat("parent.named", F.col("parent.at").cast("string"))))).otherwise(F.col("name.parent_id")))
    heads = materialized(heads.withColumn("start", F.col("parent.start")), "heads", "zstd")
    items = own.where("sequence IS NOT NULL").withColumn("start", F.col("parent.start"))
    content = items.join(heads.select("doc_path", "start", "parent_id", F.col("name.citation").alias("parent_citation")), ["doc_path", "start"])
    governing = ancestors(content.select("parent_id", "sequence", "marker_path", F.col("body").alias("text")))
    deep = content.where("size(marker_path) > 1").join(governing, ["parent_id", "sequence"], "left")  # nothing stands above the others
    children = deep.unionByName(content.where("size(marker_path) <= 1").withColumn("governing", F.lit(None).cast("string")))
    citation = child_citation(F.col("parent.document_type"), F.col("parent_citation"), F.col("marker_path"))
    path = F.array("parent.formal_title", "section_title", "parent.title")
    listed = children.select(
        child_id(F.col("parent_id"), F.col("sequence")).alias("child_id"),
        "parent_id",
        "sequence",
        citation.alias("canonical_citation"),
        "unit_type",
        F.col("body").alias("text"),
        retrieval_text(F.col("doc.regulation_id"), F.col("parent.document_type"), path, citation, F.col("body"), F.col("governing")).alias("retrieval_text"),
        F.length("body").alias("char_count"),
        word_count(F.col("body")).alias("word_count"),
        "source_location",
        "marker_path",
    )
    gathered = items.groupBy("doc_path", "start").agg(F.array_sort(F.collect_list(F.struct("sequence", F.col("body").alias("text"), F.col("source_location.xml_paragraph_end").alias("end")))).alias("l"))
    full = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    last = F.get(F.filter(F.reverse("l"), lambda x: x["end"].isNotNull()), F.lit(0))["end"]
    parents = heads.join(gathered, ["doc_path", "start"]).withColumn("text", full).select(
        "parent_id",
        "doc.document_id",
        "document_version",
        "doc.regulation_id",
        "doc.regulation_kind",
        "parent.document_type",
        path.alias("hierarchy_path"),
        F.col("name.citation").alias("canonical_citation"),
        "parent.title",
        "parent.formal_title",
        "text",
        F.length("text").alias("char_count"),
        word_count(F.col("text")).alias("word_count"),
        F.transform("l", lambda x: child_id(F.col("parent_id"), x["sequence"])).alias("child_ids"),
        F.struct(F.col("parent.at").alias("xml_paragraph_start"), F.coalesce(last, F.col("parent.at")).alias("xml_paragraph_end")).alias("source_location"),
        cross_references(F.col("text"), F.col("name.citation")).alias("cross_references"),
    )
    return materialized(parents, "parents", "zstd"), listed, ignored


def ancestors(children: DataFrame) -> DataFrame:
    """(parent_id, sequence, governing): the texts of the latest earlier children at each proper prefix of the marker path."""
    each = children.select("parent_id", "sequence", "marker_path", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.size("marker_path"), F.lit(1)))).alias("depth")).where("depth <= size(marker_path)")
    before = Window.partitionBy("parent_id", F.slice("marker_path", F.lit(1), F.col("depth"))).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.size("marker_path") == F.col("depth"), F.col("text"))
    latest = each.withColumn("t", F.last(here, ignorenulls=True).over(before)).where("depth < size(marker_path) AND t IS NOT NULL")
    listed = latest.groupBy("parent_id", "sequence").agg(F.array_sort(F.collect_list(F.struct("depth", "t"))).alias("l"))
    return listed.select("parent_id", "sequence", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("governing"))


def issues(parents: DataFrame, children: DataFrame, large_parent: int = 40_000, large_child: int = 4_000) -> DataFrame:
    """(severity, code, record_id, message) of a corpus: rows of every rule that fails."""

    def rule(rows, severity, code, condition, record, message):
        return rows.where(condition).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), record.cast("string").alias("record_id"), message.cast("string").alias("message"))

    def whole(rows, code, column, message):
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("d"))
        return rule(n, "critical", code, F.col("n") != F.col("d") if code.startswith("duplicate") else F.col("n") == 0, F.lit("*"), F.lit(message))

    p, c = F.col("parent_id").cast("string"), F.col("child_id")
    blank = lambda col: F.trim(F.coalesce(F.col(col), F.lit(""))) == ""
    acronyms = (p == "GM_EU_376_2014_ACRONYMS") & (F.upper("title") == "LIST OF ACRONYMS")
    actual = children.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "child_id"))), lambda x: x["child_id"]).alias("actual"))
    ordered = parents.join(actual, "parent_id", "left").withColumn("actual", F.coalesce("actual", F.array().cast("array<string>")))
    found = [
        whole(parents, "empty_corpus", "parent_id", "no parents"),
        whole(children, "empty_children", "child_id", "no children"),
        whole(parents, "duplicate_parent_id", "parent_id", "parent ids are not unique"),
        whole(children, "duplicate_child_id", "child_id", "child ids are not unique"),
        rule(parents, "critical", "empty_parent", blank("text"), p, F.lit("no text")),
        rule(parents, "critical", "missing_regulation", blank("regulation_id"), p, F.lit("no regulation")),
        rule(parents, "critical", "parent_without_children", F.size(F.coalesce("child_ids", F.array().cast("array<string>"))) == 0, p, F.lit("no children")),
        rule(parents, "critical", "article_title_invalid", (F.col("document_type") == "ARTICLE") & ~F.lower("title").startswith("article"), p, F.col("title")),
        rule(parents, "warning", "gm_title_unusual", (F.col("document_type") == "GM") & ~F.col("title").rlike(r"^\d") & ~acronyms, p, F.col("title")),
        rule(parents, "warning", "very_large_parent", F.col("char_count") > large_parent, p, F.col("char_count")),
        rule(children.join(parents.select("parent_id"), "parent_id", "left_anti"), "critical", "orphan_child", F.lit(True), c, p),
        rule(children, "critical", "empty_child", blank("text"), c, F.lit("no text")),
        rule(children, "critical", "empty_retrieval_text", blank("retrieval_text"), c, F.lit("no retrieval text")),
        rule(children, "warning", "large_child", F.col("char_count") > large_child, c, F.col("char_count")),
        rule(children, "warning", "table_row_unstructured", (F.col("unit_type") == "table_row") & ~F.contains("text", F.lit("|")) & (F.col("word_count") > 20), c, F.left("text", F.lit(120))),
        rule(ordered, "critical", "child_order_mismatch", ~F.col("actual").eqNullSafe(F.col("child_ids")), p, F.lit("child ids differ")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def sizes(rows: DataFrame, column: str) -> DataFrame:
    """One row: minimum, maximum and mean (2 digits), zero for no rows."""
    zero = F.lit(0)
    return rows.agg(F.coalesce(F.min(column), zero).alias("minimum"), F.coalesce(F.max(column), zero).alias("maximum"), F.coalesce(F.round(F.avg(column), 2), F.lit(0.0)).alias("mean"))
