"""Column functions on text: normal forms, tokens, identifiers, citations and review answers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that content tokens leave out.
STOP_WORDS = (
    "a an and are as at be by for from has have how in is it of on or that the their this to under was what when where which who will with"
).split()
# Answers of the review form, by their first French or English word.
ANSWERS = {"oui": "yes", "yes": "yes", "non": "no", "no": "no", "partiellement": "no", "partially": "no", "incertain": "uncertain", "unsure": "uncertain"}
DECISIONS = {
    "accepter": "accept",
    "accept": "accept",
    "accepter avec correction": "correct",
    "accept with correction": "correct",
    "rejeter": "exclude",
    "reject": "exclude",
    "je passe cette fiche": "skip",
    "i skip this record": "skip",
}
# Time stamp patterns in the order in which they are tried.
TIMESTAMPS = ("dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")
# Typographic variants and what they are read as.
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', " ": " ", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-"}


def _none(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def normalize_space(text: Column) -> Column:
    """Runs of (Unicode) white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    """Upper case with everything but A-Z and 0-9 as single underscores, none at the ends."""
    return F.btrim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), F.lit("_"))


def short_digest(text: Column) -> Column:
    return F.upper(F.left(F.sha1(text), F.lit(8)))


def article_number(title: Column) -> Column:
    return _none(F.regexp_extract(title, r"(?i)^Article\s+(\d+[A-Za-z]?)\b", 1))


def annex_label(title: Column, section: Column) -> Column:
    number = F.regexp_extract(title, r"(?i)^ANNEX\s+([IVXLCDM]+)\b", 1)
    return F.when(number != "", F.concat(F.lit("Annex "), F.upper(number))).when(F.upper(section).startswith("ANNEX"), "Annex").otherwise("Annex section")


def guidance_number(title: Column) -> Column:
    return _none(F.regexp_extract(title, r"^(\d+(?:\.\d+)+)", 1))


def marker_value(text: Column) -> Column:
    """The list marker that opens a text, lower-cased: 1.2, (3), (a) or (iv); null without one."""
    found = (F.regexp_extract(text, p, 1) for p in (r"^(\d+(?:\.\d+)*)[.\s]", r"^\((\d+)\)", r"(?i)^\(([a-z])\)", r"(?i)^\(([ivxlcdm]+)\)"))
    return F.lower(F.coalesce(*map(_none, found)))


def marker_kind(text: Column) -> Column:
    kinds = (("decimal", r"^\d+(?:\.\d+)*[.\s]"), ("parenthesized_number", r"^\(\d+\)"), ("letter", r"(?i)^\([a-z]\)"), ("roman", r"(?i)^\([ivxlcdm]+\)"))
    return F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in kinds))


def cross_references(text: Column, own: Column | None = None) -> Column:
    """Sorted distinct article references such as Article 4(6)(a), without own."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bArticle\s+\d+[A-Za-z]?(?:\(\d+\))?(?:\([a-z]\))?"), F.lit(0))

    def normal(x):
        head = F.regexp_replace(x, r"(?i)^Article\s+", "Article ")
        letter = F.regexp_extract(head, r"(\([A-Za-z]\))$", 1)
        return F.when(letter == "", head).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 3), F.lower(letter)))

    refs = F.array_sort(F.array_distinct(F.transform(found, normal)))
    return refs if own is None else F.array_remove(refs, own)


def lexical_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text: what lies between the gaps, as splitting is faster than extracting matches."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), "")


def normalize_text(text: Column) -> Column:
    return F.array_join(lexical_tokens(text), " ")


def content_tokens(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(lexical_tokens(text), lambda t: ~F.array_contains(stop, t))


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def token_runs(tokens: Column) -> Column:
    """The distinct tokens in their order with their counts, array<struct<term,f>>: one sort, then the borders of equal neighbours."""

    def counted(t):
        first = F.filter(F.transform(t, lambda _, i: i), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return let(first, lambda at: F.transform(at, lambda p, j: F.struct(F.get(t, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(t)) - p).alias("f"))))

    return let(F.sort_array(tokens), counted)


def normalize_citation(text: Column) -> Column:
    return F.regexp_replace(normalize_text(text), r"^section\b", "gm")


def citation_score(gold: Column, candidate: Column) -> Column:
    """1 for the same normal form, 0.6 if one is a whole-word prefix of the other, else 0."""
    g, c = normalize_citation(gold), normalize_citation(candidate)
    prefix = c.startswith(F.concat(g, F.lit(" "))) | g.startswith(F.concat(c, F.lit(" ")))
    return F.when((g == "") | (c == ""), 0.0).when(g == c, 1.0).when(prefix, 0.6).otherwise(0.0)


def normalise_question(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def has_citation(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\[.+?\]"), F.lit(False)).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def table_text(cells: Column, headers: Column) -> Column:
    """header: cell, joined by bars, without empty cells, and without a header that equals its cell or is empty."""

    def one(cell, i):
        header = F.get(headers, i)
        return F.when(F.coalesce(header, F.lit("")).isin("") | (header == cell), cell).otherwise(F.concat(header, F.lit(": "), cell))

    shown = F.transform(cells, lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", one(c, i)))
    return F.array_join(F.filter(shown, lambda x: x.isNotNull()), " | ")


def unit_type(kind: Column, style: Column, is_header: Column, cells: Column) -> Column:
    listed = style.startswith("List") | style.startswith("bullet")
    filled = F.size(F.filter(cells, lambda c: c != ""))
    return F.when(kind == "p", F.when(listed, "list_item").otherwise("paragraph")).when(is_header, "table_header").when(filled > 1, "table_row").otherwise("callout")


def child_citation(document_type: Column, parent_citation: Column, path: Column) -> Column:
    article = F.concat(parent_citation, F.array_join(F.transform(path, lambda p: F.concat(F.lit("("), p, F.lit(")"))), ""))
    annex = F.concat(parent_citation, F.lit(", item "), F.array_join(path, "."))
    return F.when((document_type == "ARTICLE") & (F.size(path) > 0), article).when((document_type == "ANNEX") & (F.size(path) > 0), annex).otherwise(parent_citation)


def retrieval_text(regulation: Column, document_type: Column, hierarchy: Column, citation: Column, text: Column, governing: Column) -> Column:
    path = F.array_join(F.filter(F.slice(hierarchy, 2, F.greatest(F.size(hierarchy) - 1, F.lit(0))), lambda x: F.coalesce(x, F.lit("")) != ""), " > ")
    context = F.when(F.coalesce(governing, F.lit("")) == "", "").otherwise(F.concat(F.lit(" Governing text: "), governing, F.lit(".")))
    whole = F.concat(F.lit("Document: "), regulation, F.lit(". Type: "), document_type, F.lit(". Hierarchy: "), path, F.lit(". Citation: "), citation, F.lit("."), context, F.lit(" Evidence: "), text)
    return normalize_space(whole)


def parent_identity(document_id: Column, document_type: Column, title: Column, section: Column) -> Column:
    """struct(parent_id, citation) of a legal unit."""
    number, label, guide = article_number(title), annex_label(title, section), guidance_number(title)
    rest = F.coalesce(_none(F.left(slug(title), F.lit(60))), short_digest(title))

    def both(suffix, citation):
        return F.struct(F.concat(document_id, F.lit("_"), suffix).alias("parent_id"), citation.alias("citation"))

    return (
        F.when((document_type == "ARTICLE") & number.isNotNull(), both(F.concat(F.lit("ART_"), slug(number)), F.concat(F.lit("Article "), number)))
        .when(document_type == "ANNEX", both(F.when(label == "Annex", "ANNEX").otherwise(slug(label)), label))
        .when((document_type == "GM") & (F.upper(title) == "LIST OF ACRONYMS"), both(F.lit("ACRONYMS"), F.lit("GM acronyms")))
        .when((document_type == "GM") & guide.isNotNull(), both(F.concat(F.lit("SEC_"), F.replace(guide, F.lit("."), F.lit("_"))), F.concat(F.lit("GM "), guide)))
        .when(document_type == "RECITALS", both(F.lit("RECITALS"), F.lit("Powers and recitals")))
        .otherwise(both(rest, title))
    )


def source_class(parent_id: Column) -> Column:
    return F.when(parent_id.startswith("GM_"), "GM").when(parent_id.contains("_ANNEX"), "ANNEX").when(parent_id.contains("_ART_"), "ARTICLE").otherwise("OTHER")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def cost_of(model: Column, tokens: Column, prices: dict[str, float]) -> Column:
    """tokens at the price for a million of the first listed model whose name starts the given one; null for none."""
    return F.coalesce(*(F.when(model.startswith(name), tokens / 1e6 * price) for name, price in prices.items()))


def split_ids(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def join_ids(ids: Column) -> Column:
    return F.array_join(ids, ";")


def legacy_citation_match(prediction: Column, gold: Column) -> Column:
    p, g = F.lower(prediction), F.lower(F.coalesce(gold, F.lit("")))
    article = F.regexp_extract(g, r"article\s+(\d+)", 1)
    return F.when(g == "", 0.0).when(F.contains(p, g), 1.0).when((article != "") & F.contains(p, F.concat(F.lit("article "), article)), 0.5).otherwise(0.0)


def _choice(text: Column, values: dict[str, str]) -> Column:
    head = F.trim(F.split_part(F.lower(F.trim(F.split_part(F.trim(F.coalesce(text, F.lit(""))), F.lit("/"), F.lit(1)))), F.lit(","), F.lit(1)))
    known = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(known[head], F.lit(""))


def map_answer(text: Column) -> Column:
    return _choice(text, ANSWERS)


def map_decision(text: Column) -> Column:
    return _choice(text, DECISIONS)


def parse_timestamp(text: Column) -> Column:
    """The date of the first pattern that fits, day before month; null for none."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIMESTAMPS)).cast("date")


def text_digest(texts: Column) -> Column:
    """SHA-256 of the texts, each followed by a null character, in upper case."""
    return F.upper(F.sha2(F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit("\0"))), ""), 256))


def caseless(text: Column) -> Column:
    """Lower case of upper case, which folds what lower case alone keeps apart. The empty suffix keeps the optimizer from leaving upper case out."""
    return F.lower(F.concat(F.upper(text), F.lit("")))


def match_normal(typographic: Column) -> Column:
    """What quotes are compared by: punctuation as spaces, single spaces, caseless. Takes typographic_normal's result."""
    return caseless(F.trim(F.regexp_replace(F.regexp_replace(typographic, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")))


def strict_normal(text: Column) -> Column:
    return caseless(normalize_space(text))


def contains_elision(text: Column) -> Column:
    return text.rlike(r"\.\.\.|…|\[\s*\.\.\.\s*\]")


def evidence_sets_of_json(text: Column) -> Column:
    """The lists of a JSON list of non-empty lists of non-blank strings, trimmed; null for anything else, empty for blank text."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    parsed = F.from_json(text, "array<array<string>>")
    bad = F.exists(parsed, lambda s: s.isNull() | (F.size(s) == 0) | F.exists(s, lambda x: x.isNull() | (F.trim(x) == "")))
    plain = F.schema_of_variant(F.try_parse_json(text)) == "ARRAY<ARRAY<STRING>>"
    empty = F.array().cast("array<array<string>>")
    return F.when(blank, empty).when(F.regexp_replace(text, r"\s", "") == "[]", empty).when(plain & ~F.coalesce(bad, F.lit(True)), F.transform(parsed, lambda s: F.transform(s, lambda x: F.trim(x))))


def evidence_sets(ids: Column, json: Column, corrected: bool) -> Column:
    """Distinct evidence sets of a review row: listed ids are one set if corrected and a set each otherwise; sets of json follow."""
    listed = split_ids(ids)
    first = F.when(F.size(listed) > 0, F.array(listed)).otherwise(F.array().cast("array<array<string>>")) if corrected else F.transform(listed, lambda x: F.array(x))
    return F.array_distinct(F.transform(F.concat(first, evidence_sets_of_json(json)), lambda s: F.array_distinct(s)))
