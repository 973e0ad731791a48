"""WordprocessingML documents as a table of blocks: one row for each body paragraph and table row.

Files are read as bytes by Spark and parsed on the executors, one document at a time.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PART = "{http://schemas.microsoft.com/office/2006/xmlPackage}"
SCHEMA = (
    "block_index: int, kind: string, text: string, style: string, paragraph_index: int, cells: array<string>, headers: array<string>,"
    " is_header: boolean, table_index: int, row_index: int, paragraph_start: int, paragraph_end: int"
)


def body(data: bytes) -> ElementTree.Element:
    """The document body of a zipped, flat or bare document; ValueError without one."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as packed:
            root = ElementTree.fromstring(packed.read("word/document.xml"))
    else:
        root = ElementTree.fromstring(data)
        if root.tag == f"{PART}package":
            root = next((p for p in root.iter(f"{PART}part") if p.get(f"{PART}name") == "/word/document.xml"), ElementTree.Element("none"))
    found = next(root.iter(f"{W}body"), None)
    if found is None:
        raise ValueError("no document body")
    return found


def _text(p) -> str:
    return " ".join("".join(t.text or "" for t in p.iter(f"{W}t")).split())


def _value(element) -> str:
    return "" if element is None else element.get(f"{W}val") or element.get("val") or ""


def _style(p) -> str:
    return _value(p.find(f"{W}pPr/{W}pStyle"))


def _outline(element):
    """Paragraphs and tables in document order, through wrappers but not into tables."""
    for child in element:
        if child.tag in (f"{W}p", f"{W}tbl"):
            yield child
        else:
            yield from _outline(child)


def _grid(table) -> list[tuple[list[str], list, bool]]:
    """(cells, paragraphs, is a header) of each row; a cell that goes on a vertical merge has the text that began it."""
    out, begun = [], {}
    for row in table.findall(f"{W}tr"):
        cells = []
        for i, cell in enumerate(row.findall(f"{W}tc")):
            text = " ".join(filter(None, map(_text, cell.iter(f"{W}p"))))
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            if merge is None:
                begun.pop(i, None)
            elif _value(merge) == "restart":
                begun[i] = text
            else:
                text = text or begun.get(i, "")
            cells.append(text)
        paragraphs = list(row.iter(f"{W}p"))
        out.append((cells, paragraphs, any(_style(p) == "TableHead" for p in paragraphs)))
    return out


def blocks(data: bytes):
    """Rows of SCHEMA."""
    root = body(data)
    number = {id(p): i for i, p in enumerate(root.iter(f"{W}p"))}
    at = tables = 0
    for element in _outline(root):
        if element.tag == f"{W}p":
            if text := _text(element):
                yield at, "p", text, _style(element), number[id(element)], None, None, None, None, None, None, None
                at += 1
            continue
        rows = _grid(element)
        head = next((i for i, r in enumerate(rows) if r[2]), 0 if len(rows) > 1 and rows[0][0] and all(rows[0][0]) else None)
        headers = rows[head][0] if head is not None else []
        for i, (cells, paragraphs, marked) in enumerate(rows):
            if any(cells):
                places = [number[id(p)] for p in paragraphs]
                yield at, "tr", None, None, None, cells, headers, marked or i == head, tables, i, min(places, default=None), max(places, default=None)
                at += 1
        tables += 1


@udtf(returnType=SCHEMA)
class WordBlocks:
    """blocks() as a table function on file contents."""

    def eval(self, content: bytes):
        yield from blocks(bytes(content))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_path, blocks' columns) of all documents under path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_path"), "content")
    return files.lateralJoin(WordBlocks(F.col("content").outer())).drop("content")


def style_profile(blocks_: DataFrame, samples: int = 3) -> DataFrame:
    """(style, n, samples): paragraphs of each style and the first texts, 220 characters each."""
    own = blocks_.where("kind = 'p'").select("style", "doc_path", "block_index", F.left("text", F.lit(220)).alias("t"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("style").orderBy("doc_path", "block_index"))).where(F.col("k") <= samples)
    firsts = ranked.groupBy("style").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("f"))  # samples rows a style
    return own.groupBy("style").agg(F.count(F.lit(1)).alias("n")).join(firsts, "style", "left").select("style", "n", F.transform("f", lambda x: x["t"]).alias("samples"))


# What opens a line that may be a legal unit's heading.
HEADINGS = {"article": r"(?i)^Article\s*\d+", "annex": r"(?i)^Annex\b", "guidance": r"(?i)^(GM\b|Guidance Material\b)", "numeric": r"^\d+(?:\.\d+)+\s+\S"}


def heading_candidates(blocks_: DataFrame) -> DataFrame:
    """(doc_path, block_index, candidate, text) of paragraphs that may be headings."""
    kinds = F.filter(F.array(*(F.when(F.col("text").rlike(p) & ((F.length("text") < 240) if k == "numeric" else F.lit(True)), F.lit(k)) for k, p in HEADINGS.items())), lambda x: x.isNotNull())
    return blocks_.where("kind = 'p'").select("doc_path", "block_index", F.explode(kinds).alias("candidate"), F.left("text", F.lit(300)).alias("text"))


def paragraph_ranges(blocks_: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Paragraphs whose index lies in any of the inclusive ranges, by range."""
    wanted = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ranges))
    hit = F.filter(wanted, lambda r: F.col("paragraph_index").between(r["first"], r["last"]))
    return blocks_.where("kind = 'p'").select("*", F.explode(hit).alias("r")).select("*", "r.first", "r.last").drop("r")
