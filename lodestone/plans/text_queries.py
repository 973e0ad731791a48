"""Queries for functions on text, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.python_text import rouge_l, typographic_normal
from lodestone.operators import baselines, citations, corpus, review
from lodestone.operators.relational import numbered
from lodestone.operators.retrieval import top_k
from lodestone.plans.registry import query
from lodestone.plans.views import CHOICE, CITED, KIND, LINES_CTE, MARKED, SECTION, TITLE, TOK, children, lines
from lodestone.sources import files, manifested
from lodestone.sources.shared import shared_dir


def _somewhere(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, n_chars FROM documents")
def s06_jsonl_scan(t):
    at = _somewhere(t, "jsonl")
    files.write_jsonl(t.documents.select("doc_id", "lang", "n_chars"), at)
    return files.read_jsonl(t.spark, at, "doc_id long, lang string, n_chars long")


@query("SELECT lang AS qa_id, max(doc_id) AS doc_id FROM documents GROUP BY lang")
def s07_keep_last(t):
    return files.keep_last(t.documents.select(F.col("lang").alias("qa_id"), "doc_id"), "qa_id", "doc_id")


@query("SELECT item_id, length(text) AS n FROM benchmark")
def s08_json_array_scan(t):
    at = _somewhere(t, "array")
    files.write_json_arrays(t.benchmark.select("item_id", "text"), at)
    return files.read_json_array(t.spark, at, "item_id long, text string").select("item_id", F.length("text").cast("long").alias("n"))


@query("SELECT CAST(item_id AS STRING) AS item_id, text FROM benchmark")
def s09_csv_scan(t):
    at = _somewhere(t, "csv")
    files.write_csv(t.benchmark.select("item_id", "text"), at)
    return files.read_csv_strings(t.spark, at, ["item_id", "text"])


@query("SELECT CAST(doc_id AS STRING) AS doc_id, CAST(n_chars AS STRING) AS char_count FROM documents WHERE n_chars >= 150")
def s10_long_chunks(t):
    at = _somewhere(t, "chunks")
    files.write_csv(t.documents.select("doc_id", F.col("n_chars").alias("char_count")), at)
    return files.read_long_chunks(t.spark, at, ["doc_id", "char_count"])


@query("SELECT doc_id, source || ';' || lang || ';x' AS joined, CAST(3 AS BIGINT) AS n FROM documents")
def s19_list_encoding(t):
    raw = F.concat(F.col("source"), F.lit("; "), F.col("lang"), F.lit(" ;; x "))
    return t.documents.select("doc_id", T.join_ids(T.split_ids(raw)).alias("joined"), F.size(T.split_ids(raw)).cast("long").alias("n"))


@query("SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def s20_text_sha256(t):
    return t.documents.select("doc_id", F.upper(F.sha2("text", 256)).alias("sha256"))


@query("SELECT doc_id, 'quality' AS question, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def s23_unpivot(t):
    return t.labels.unpivot("doc_id", ["quality", "toxic"], "question", "value")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 25")
def s24_split_limit(t):
    return t.documents.where("lang = 'en'").select("doc_id", "lang").orderBy("doc_id").limit(25)


@query("SELECT source AS style, n, first_id FROM (SELECT source, doc_id AS first_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def s25_style_profile(t):
    styled = t.documents.select(F.col("source").alias("style"), "doc_id")
    firsts = top_k(styled, ["style"], [F.asc("doc_id")], 3).select("style", F.col("doc_id").alias("first_id"))
    return styled.groupBy("style").agg(F.count(F.lit(1)).alias("n")).join(firsts, "style")


@query("SELECT doc_id, lang, n_chars, true AS intact FROM documents")
def s17_s20_manifest(t):
    """Documents through the sink that writes its manifest, read back, with whether all parts have the digests and rows that it names."""
    at = _somewhere(t, "manifested")
    manifested.write(t.documents.select("doc_id", "lang", "n_chars"), at)
    whole = manifested.verified(t.spark, at).agg(F.min("intact").alias("intact"))
    return manifested.read(t.spark, at, "doc_id long, lang string, n_chars long").join(F.broadcast(whole))


@query("SELECT '\\begin{tabular}{ll}' AS first, count(*) AS n, '\\end{tabular}' AS last FROM (SELECT DISTINCT lang FROM documents)")
def s22_latex_table(t):
    """Documents by language as a LaTeX table: its first and last line, and the number of its rows."""
    at = _somewhere(t, "table")
    manifested.write(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("lang"), at, "tex")
    lines_ = t.spark.read.text(f"{at}/part-*", wholetext=True).select(F.split(F.trim(F.rtrim(F.regexp_replace("value", r"\n$", ""))), "\n").alias("l"))
    return lines_.select(F.get("l", F.lit(0)).alias("first"), (F.size("l") - 6).cast("long").alias("n"), F.element_at("l", -1).alias("last"))


@query("SELECT doc_id, r.a AS first, r.b AS last FROM documents JOIN (VALUES (3, 9), (20, 24)) r(a, b) ON doc_id BETWEEN r.a AND r.b")
def s26_range_scan(t):
    ranges = t.spark.createDataFrame([(3, 9), (20, 24)], "first int, last int")
    return t.documents.select("doc_id").join(F.broadcast(ranges), F.col("doc_id").between(F.col("first"), F.col("last")))


@query("SELECT item_id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 6) AS BIGINT) AS block FROM benchmark")
def s27_form_blocks(t):
    return numbered(t.benchmark.select("item_id"), [F.asc("item_id")]).select("item_id", F.floor((F.col("number") - 1) / 6).alias("block"))


@query(rf"WITH {LINES_CTE} SELECT doc_id, sequence, trim(regexp_replace(line || '  x', '\s+', ' ', 'g')) AS v FROM lines")
def p01_normalize_space(t):
    return lines(t).select("doc_id", F.col("sequence").cast("long").alias("sequence"), T.normalize_space(F.concat("line", F.lit("  x"))).alias("v"))


@query(f"SELECT doc_id, trim(regexp_replace(upper({TITLE}), '[^A-Z0-9]+', '_', 'g'), '_') AS slug, upper(left(sha1({TITLE}), 8)) AS digest FROM documents")
def p02_p03_slug_digest(t):
    return t.documents.select("doc_id", T.slug(F.expr(TITLE)).alias("slug"), T.short_digest(F.expr(TITLE)).alias("digest"))


@query(rf"""SELECT doc_id, nullif(regexp_extract(title, '^(?i:article)\s+(\d+[A-Za-z]?)\b', 1), '') AS article, CASE WHEN regexp_extract(title, '^(?i:annex)\s+([IVXLCDMivxlcdm]+)\b', 1) <> '' THEN 'Annex ' || upper(regexp_extract(title, '^(?i:annex)\s+([IVXLCDMivxlcdm]+)\b', 1)) WHEN starts_with(upper(section), 'ANNEX') THEN 'Annex' ELSE 'Annex section' END AS annex, nullif(regexp_extract(title, '^(\d+(?:\.\d+)+)', 1), '') AS gm FROM (SELECT doc_id, {TITLE} AS title, {SECTION} AS section FROM documents)""")
def p04_unit_numbers(t):
    own = t.documents.select("doc_id", F.expr(TITLE).alias("title"), F.expr(SECTION).alias("section"))
    return own.select("doc_id", T.article_number(F.col("title")).alias("article"), T.annex_label(F.col("title"), F.col("section")).alias("annex"), T.guidance_number(F.col("title")).alias("gm"))


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'D_ART_' || CAST(doc_id % 40 AS STRING) || 'A' WHEN 1 THEN 'D_ANNEX_IV' WHEN 2 THEN 'D_SEC_' || CAST(doc_id % 9 AS STRING) || '_' || CAST(doc_id % 7 AS STRING) WHEN 3 THEN 'D_RECITALS' WHEN 4 THEN 'D_ACRONYMS' ELSE 'D_SOME_OTHER_TITLE_' || upper(source) END AS parent_id, CASE doc_id % 6 WHEN 0 THEN 'Article ' || CAST(doc_id % 40 AS STRING) || 'a' WHEN 1 THEN 'Annex IV' WHEN 2 THEN 'GM ' || CAST(doc_id % 9 AS STRING) || '.' || CAST(doc_id % 7 AS STRING) WHEN 3 THEN 'Powers and recitals' WHEN 4 THEN 'GM acronyms' ELSE {TITLE} END AS citation FROM documents""")
def p05_parent_identity(t):
    both = T.parent_identity(F.lit("D"), F.expr(KIND), F.expr(TITLE), F.expr(SECTION))
    return t.documents.select("doc_id", both.alias("b")).select("doc_id", "b.parent_id", "b.citation")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '1.2' WHEN 1 THEN '3' WHEN 2 THEN 'b' WHEN 3 THEN 'iv' WHEN 4 THEN '7' END AS value, CASE doc_id % 6 WHEN 0 THEN 'decimal' WHEN 1 THEN 'parenthesized_number' WHEN 2 THEN 'letter' WHEN 3 THEN 'roman' WHEN 4 THEN 'decimal' END AS kind FROM documents")
def p06_marker(t):
    return t.documents.select("doc_id", T.marker_value(F.expr(MARKED)).alias("value"), T.marker_kind(F.expr(MARKED)).alias("kind"))


@query(f"SELECT doc_id, CASE {KIND} WHEN 'ARTICLE' THEN 'Article 4(' || lang || ')(' || source || ')' WHEN 'ANNEX' THEN 'Article 4, item ' || lang || '.' || source ELSE 'Article 4' END AS citation FROM documents")
def p07_child_citation(t):
    return t.documents.select("doc_id", T.child_citation(F.expr(KIND), F.lit("Article 4"), F.array("lang", "source")).alias("citation"))


@query(f"SELECT doc_id, 'Document: R. Type: ' || {KIND} || '. Hierarchy: ' || source || ' > ' || lang || '. Citation: Article 4. Governing text: g. Evidence: e' AS v FROM documents")
def p08_retrieval_text(t):
    return t.documents.select("doc_id", T.retrieval_text(F.lit("R"), F.expr(KIND), F.array(F.lit("top"), F.col("source"), F.lit(""), F.col("lang")), F.lit("Article 4"), F.lit("e"), F.lit("g")).alias("v"))


@query("SELECT doc_id, 'Lang: ' || lang || ' | ' || source || ' | 7' AS v, CASE WHEN doc_id % 2 = 0 THEN 'table_header' ELSE 'table_row' END AS unit_type FROM documents")
def p09_p10_table_row(t):
    cells, headers = F.array("lang", "source", F.lit(""), F.lit("7")), F.array(F.lit("Lang"), F.col("source"), F.lit("Empty"))
    return t.documents.select("doc_id", T.table_text(cells, headers).alias("v"), T.unit_type(F.lit("tr"), F.lit(""), F.col("doc_id") % 2 == 0, cells).alias("unit_type"))


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def p11_style_filter(t):
    return t.documents.where(~F.col("source").isin("src1", "src2")).select("doc_id")


@query(rf"SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, CAST(len([x for x in regexp_split_to_array(text, '\s+') if x <> '']) AS BIGINT) AS word_count FROM documents")
def p12_lengths(t):
    return t.documents.select("doc_id", F.length("text").cast("long").alias("char_count"), T.word_count(F.col("text")).cast("long").alias("word_count"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([x for x in ['Article ' || CAST(doc_id % 9 AS STRING) || '(2)(b)', 'Article ' || CAST(doc_id % 5 AS STRING), 'Article 4'] if x <> 'Article 3'])), ';') AS refs FROM documents")
def p13_cross_references(t):
    return t.documents.select("doc_id", F.array_join(T.cross_references(F.expr(CITED), F.lit("Article 3")), ";").alias("refs"))


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'ANNEX' WHEN 2 THEN 'GM' ELSE 'OTHER' END AS class FROM documents")
def p14_source_class(t):
    key = F.expr("CASE doc_id % 6 WHEN 0 THEN 'EU_1_ART_4' WHEN 1 THEN 'EU_1_ANNEX_I' WHEN 2 THEN 'GM_EU_SEC_1' ELSE 'EU_1_RECITALS' END")
    return t.documents.select("doc_id", T.source_class(key).alias("class"))


@query(rf"SELECT item_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS v FROM benchmark")
def p15_normalise_question(t):
    return t.benchmark.select("item_id", T.normalise_question(F.col("text")).alias("v"))


@query("SELECT doc_id, CAST(regexp_matches(text, '\\[.+?\\]') AS INTEGER) AS flag FROM documents")
def p16_has_citation(t):
    return t.documents.select("doc_id", T.has_citation(F.col("text")).alias("flag"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN 'rag' ELSE 'other_run' END AS system, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '5') AS variant FROM documents")
def p17_system_variant(t):
    path = F.when(F.col("doc_id") % 3 == 0, "/a/b/My_RAG_k5.json").otherwise("/a/other_run.json")
    system = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return t.documents.select("doc_id", baselines.system_of(system, path).alias("system"), baselines.variant_of(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit(5), F.lit(3)).alias("variant"))


@query("""SELECT conv_id AS q, string_agg('[' || CAST(turn AS STRING) || '] ' || role || chr(10) || left(text, 1500), chr(10) || chr(10) ORDER BY turn) AS excerpts FROM conversations GROUP BY conv_id""")
def p18_excerpts(t):
    own = t.conversations.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return baselines.excerpts(own.select(F.col("conv_id").alias("q"), F.col("turn").alias("rank"), F.col("m.role").alias("citation"), F.col("m.text").alias("text")))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens, CASE WHEN lang = 'en' THEN round(greatest(1, length(text) // 4) / 1e6 * 0.15, 10) WHEN lang = 'de' THEN round(greatest(1, length(text) // 4) / 1e6 * 0.5, 10) END AS cost FROM documents")
def p20_token_cost(t):
    n = T.estimate_tokens(F.col("text"))
    return t.documents.select("doc_id", n.cast("long").alias("tokens"), F.round(T.cost_of(F.col("lang"), n, {"en": 0.15, "d": 0.5}), 10).alias("cost"))


@query("SELECT name, 'R' || CAST(row_number() OVER (ORDER BY first) AS STRING) AS pseudonym, sha256(name) AS sha256 FROM (SELECT source AS name, min(doc_id) AS first FROM documents GROUP BY source)")
def p21_pseudonyms(t):
    return review.pseudonyms(t.documents, "source", "doc_id")


@query(f"SELECT doc_id, array_to_string({TOK.format('text')}, ' ') AS normal, CAST(len({TOK.format('text')}) AS BIGINT) AS n FROM documents")
def t01_t02_tokens(t):
    return t.documents.select("doc_id", T.normalize_text(F.col("text")).alias("normal"), F.size(T.lexical_tokens(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len([x for x in {TOK.format('text')} if NOT list_contains({T.STOP_WORDS!r}, x)]) AS BIGINT) AS n FROM documents")
def t03_content_tokens(t):
    return t.documents.select("doc_id", F.size(T.content_tokens(F.col("text"))).cast("long").alias("n"))


_SQL_NORM = "regexp_replace(array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' '), '^section\\b', 'gm')"


@query(f"SELECT p_partkey, {_SQL_NORM.format(chr(39) + 'Section ' + chr(39) + ' || p_type')} AS citation, CASE WHEN g = c THEN 1.0 WHEN starts_with(c, g || ' ') OR starts_with(g, c || ' ') THEN 0.6 ELSE 0.0 END AS score FROM (SELECT *, {_SQL_NORM.format('p_type')} AS g, {_SQL_NORM.format('p_type || (CASE WHEN p_partkey % 3 = 0 THEN chr(32) || p_brand WHEN p_partkey % 3 = 1 THEN chr(46) ELSE chr(120) END)')} AS c FROM part)")
def t04_t05_citation_score(t):
    other = F.concat("p_type", F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand WHEN p_partkey % 3 = 1 THEN '.' ELSE 'x' END"))
    return t.part.select("p_partkey", T.normalize_citation(F.concat(F.lit("Section "), "p_type")).alias("citation"), T.citation_score(F.col("p_type"), other).alias("score"))


@query()
def t07_rouge_l(t):
    after = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(after).alias("next"), F.lead("text").over(after).alias("reply"))
    return turns.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", rouge_l(F.col("text"), F.col("reply")).alias("rouge_l"))


@query()
def t10_t11_quote_normal(t):
    own = t.benchmark.withColumn("n", typographic_normal(F.concat(F.lit("“"), F.col("text"), F.lit("…”"))))
    return own.select("item_id", T.match_normal(F.col("n")).alias("match"), T.strict_normal(F.col("text")).alias("strict"))


@query("SELECT item_id, regexp_matches(text || CASE item_id % 3 WHEN 0 THEN ' [ ... ] x' WHEN 1 THEN '…' ELSE '' END, '\\.\\.\\.|…|\\[\\s*\\.\\.\\.\\s*\\]') AS elided FROM benchmark")
def t13_elision(t):
    return t.benchmark.select("item_id", T.contains_elision(F.concat("text", F.expr("CASE item_id % 3 WHEN 0 THEN ' [ ... ] x' WHEN 1 THEN '…' ELSE '' END"))).alias("elided"))


@query(f"SELECT doc_id, CASE WHEN contains(p, g) THEN 1.0 WHEN contains(p, 'article ' || regexp_extract(g, 'article\\s+(\\d+)', 1)) THEN 0.5 ELSE 0.0 END AS score FROM (SELECT doc_id, lower({CITED}) AS p, lower('Article ' || CAST(doc_id % 11 AS STRING) || '(2)') AS g FROM documents)")
def t16_legacy_match(t):
    gold = F.concat(F.lit("Article "), (F.col("doc_id") % 11).cast("string"), F.lit("(2)"))
    return t.documents.select("doc_id", T.legacy_citation_match(F.expr(CITED), gold).alias("score"))


@query("SELECT doc_id, CAST(i - 1 AS INT) AS position, '376/2014' AS regulation, 'ARTICLE' AS kind, x.number AS number, array_to_string(x.subs, ';') AS subs, true AS defaulted FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [{'number': CAST(doc_id % 9 AS STRING), 'subs': ['2', 'b']}, {'number': CAST(doc_id % 5 AS STRING), 'subs': CAST([] AS STRING[])}] || CASE WHEN doc_id % 5 <> 4 THEN [{'number': '4', 'subs': CAST([] AS STRING[])}] ELSE [] END AS l FROM documents))")
def t17_citations(t):
    return citations.citations(t.documents.select("doc_id", F.expr(CITED).alias("text"))).drop("text").withColumn("subs", F.array_join("subs", ";"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN true ELSE doc_id % 11 IN (doc_id % 5, 4) END AS exact, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 11 > 8 THEN NULL ELSE doc_id % 11 IN (doc_id % 9, doc_id % 5, 4) END AS parent FROM documents")
def t19_citation_matches(t):
    gold = F.expr("CASE WHEN doc_id % 7 = 3 THEN 'paragraph 3' WHEN doc_id % 3 = 0 THEN 'Article ' || CAST(doc_id % 9 AS STRING) || '(2)(b)' ELSE 'Article ' || CAST(doc_id % 11 AS STRING) END")
    pairs = t.documents.select(F.col("doc_id").alias("id"), F.expr(CITED).alias("prediction"), gold.alias("gold"))
    parents = t.spark.range(0, 9).select(F.concat(F.lit("EU_376_2014_ART_"), "id").alias("parent_id"))
    return citations.matches(pairs, parents)


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no' WHEN 3 THEN 'uncertain' ELSE '' END AS answer, CASE doc_id % 8 WHEN 4 THEN 'accept' WHEN 5 THEN 'correct' WHEN 6 THEN 'skip' ELSE '' END AS decision FROM documents")
def t20_form_choices(t):
    return t.documents.select("doc_id", T.map_answer(F.expr(CHOICE)).alias("answer"), T.map_decision(F.expr(CHOICE)).alias("decision"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def t21_timestamps(t):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", T.parse_timestamp(raw).alias("d"))


@query("SELECT doc_id, upper(sha256(text || chr(0) || lang || chr(0))) AS digest FROM documents")
def t22_list_digest(t):
    return t.documents.select("doc_id", T.text_digest(F.array("text", "lang")).alias("digest"))


@query(r"SELECT item_id, CAST(len([x for x in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> '']) AS BIGINT) AS n FROM benchmark")
def t23_sentences(t):
    return t.benchmark.select("item_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE 2 END AS BIGINT) AS n FROM documents")
def t24_t25_evidence_sets(t):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN '[["c"],["d","e"]]' WHEN 1 THEN '[["a"]]' WHEN 2 THEN '[[3]]' ELSE '' END""")
    ids = F.expr("CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a; b' WHEN 2 THEN '' ELSE 'x;y;x' END")
    return t.documents.select("doc_id", F.size(T.evidence_sets(ids, raw, False)).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query(f"WITH {LINES_CTE} SELECT CAST(doc_id AS STRING) || '__C' || lpad(CAST(sequence AS STRING), 4, '0') AS child_id, doc_id AS parent_id, sequence, line AS text, 'Article ' || CAST(sequence % 7 AS STRING) AS canonical_citation FROM lines")
def w09_sequence(t):
    return children(t).withColumn("sequence", F.col("sequence").cast("long"))


@query("SELECT doc_id, true AS ok, CAST(len([x for x in string_split(text, chr(10)) if trim(x) <> '']) AS BIGINT) AS n, array_to_string([x for x in string_split(text, chr(10)) if trim(x) <> ''], chr(10)) AS whole FROM documents WHERE len([x for x in string_split(text, chr(10)) if trim(x) <> '']) > 0")
def a24_parent_text(t):
    own = lines(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "line"))).alias("l"))
    return own.select("doc_id", F.lit(True).alias("ok"), F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("whole"))


_LINE_MARKS = "CASE sequence % 4 WHEN 0 THEN '2.1' WHEN 1 THEN '3' WHEN 2 THEN 'b' END", "CASE sequence % 4 WHEN 0 THEN 'decimal' WHEN 1 THEN 'parenthesized_number' WHEN 2 THEN 'letter' END", "CASE sequence % 3 WHEN 0 THEN 'ListLevel0' WHEN 1 THEN 'ListLevel1' ELSE '' END", "CASE doc_id % 3 WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'ANNEX' ELSE 'GM' END"


@query(f"""WITH RECURSIVE {LINES_CTE}, items AS (SELECT doc_id, sequence, {_LINE_MARKS[0]} AS value, {_LINE_MARKS[1]} AS kind, {_LINE_MARKS[2]} AS style, {_LINE_MARKS[3]} AS type FROM lines),
st AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS sequence, CAST([] AS STRING[]) AS path FROM items UNION ALL SELECT x.doc_id, x.sequence, CASE WHEN value IS NULL THEN path WHEN type = 'ARTICLE' AND style = 'ListLevel0' AND kind IN ('decimal', 'parenthesized_number') THEN string_split(value, '.')[1:1] WHEN type = 'ANNEX' AND kind = 'decimal' THEN string_split(value, '.') WHEN type IN ('ARTICLE', 'ANNEX') AND style = 'ListLevel1' THEN path[1:1] || [value] WHEN kind = 'decimal' THEN string_split(value, '.') ELSE path || [value] END FROM st JOIN items x ON x.doc_id = st.doc_id AND x.sequence = st.sequence + 1)
SELECT doc_id, sequence, array_to_string(path, '.') AS path FROM st WHERE sequence > 0""")
def w13_marker_paths(t):
    own = lines(t).select("doc_id", "sequence", *(F.expr(e).alias(n) for e, n in zip(_LINE_MARKS, ("value", "kind", "style", "document_type"))))
    return corpus.marker_paths(own, "doc_id", "sequence").select("doc_id", F.col("sequence").cast("long").alias("sequence"), F.array_join("marker_path", ".").alias("path"))
