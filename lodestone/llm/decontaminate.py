"""Benchmark decontamination with a broadcast hash set of normalised test n-grams; DataFrame functions only.

The windows of the benchmark (10 words, or the whole of a shorter item) are few: their number and bytes are checked, and
within the bound they reach every task as a scalar subquery, an array of hash buckets. A document is scanned window by
window only if it holds the longest two neighbouring words of some window, which every occurrence needs; a look-up meets
one bucket, so the work follows the document, not the benchmark. Hash hits are verified word by word. A benchmark beyond
the bound is joined by window hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows and bytes of windows that may be sent to every task.
MAX_WINDOWS, MAX_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: what lies between the gaps, as splitting is much faster than extracting matches."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def pairs(w: Column) -> Column:
    """Hashes of each word with the next (the last alone)."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def positions(w: Column, size: int) -> Column:
    """1-based starts of the windows of size words, none if w is shorter."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, size: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct (item, length, h, window) of the items; an item without id has the empty string for one, one without words has no window."""
    own = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words(F.col(text_column)).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    own = own.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("length")))).alias("window"))
    return own.select("item", "length", F.xxhash64("window").alias("h"), "window").distinct()


def bucketed(entries: DataFrame, hash_column: str, value: Column, buckets: int) -> Column:
    """A scalar: an array of buckets, each the values of the entries whose hash falls into it, so that a look-up meets the entries of one bucket."""
    spark, at = entries.sparkSession, F.pmod(F.col(hash_column), F.lit(buckets))
    own = entries.groupBy(at.alias("id")).agg(F.collect_set(value).alias("held"))
    whole = spark.range(buckets).join(own, "id", "left").select("id", F.coalesce("held", F.array().cast(own.schema["held"].dataType)).alias("held"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "held"))), lambda b: b["held"])).scalar()


def bucket(buckets: Column, h: Column, n: int) -> Column:
    return F.get(buckets, F.pmod(h, F.lit(n)).cast("int"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(row, text, found) of every row of docs; found: struct(n_words, hits, items). hits are the 1-based positions of words inside any occurrence of a window."""
    docs = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    grams = windows(benchmark, size, item_column, item_text)
    n, weight = grams.agg(F.count(F.lit(1)), F.sum(F.length(F.concat_ws(" ", "window")))).first()
    own = words(F.col("text"))
    if not n:
        return docs.withColumn("found", let(own, lambda w: F.struct(F.size(w).alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))))
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # size values at most
    if n > max_windows or 4 * weight > MAX_BYTES:
        return _joined(docs, grams, lengths)
    buckets = 1 << int(n).bit_length()
    sized = F.transform(pairs(F.col("window")), lambda h, i: F.struct((F.length(F.get("window", i)) + F.length(F.get("window", i + 1))).alias("n"), h.alias("h")))
    longest = F.array_max(F.filter(sized, lambda x: x["n"].isNotNull()))["h"]
    keys = grams.select(F.when(F.col("length") > 1, longest).otherwise(F.xxhash64(F.get("window", F.lit(0)))).alias("k"), (F.col("length") > 1).alias("two"))
    held = {"__pairs": bucketed(keys.where("two"), "k", F.col("k"), buckets)}  # columns, as higher-order functions take no subquery
    if lengths[0] == 1:
        held["__single"] = bucketed(keys.where("NOT two"), "k", F.col("k"), buckets)
    for k in lengths:
        held[f"__windows_{k}"] = bucketed(grams.where(F.col("length") == k), "h", F.struct("h", "window", "item"), buckets)

    def likely(w):
        """Whether w has the longest pair of neighbours of some window, or a window of one word."""
        two = F.exists(pairs(w), lambda h: F.array_contains(bucket(F.col("__pairs"), h, buckets), h))
        return two if lengths[0] > 1 else two | F.exists(w, lambda x: F.array_contains(bucket(F.col("__single"), F.xxhash64(x), buckets), F.xxhash64(x)))

    def of_length(w, k):
        """Where windows of k words occur, with their items: those of the bucket of each position's hash that are the same word by word."""

        def one(i):
            window = F.slice(w, i, k)
            near = let(F.xxhash64(window), lambda h: F.filter(bucket(F.col(f"__windows_{k}"), h, buckets), lambda b: b["h"] == h))
            same = F.filter(near, lambda b: b["window"] == window)
            return F.struct(F.sequence(i, i + (k - 1)).alias("hits"), F.transform(same, lambda b: b["item"]).alias("items"))

        return F.filter(F.transform(positions(w, k), one), lambda p: F.size(p["items"]) > 0)

    def found(w):
        every = F.concat(*(of_length(w, k) for k in lengths))
        return let(every, lambda e: F.struct(F.array_distinct(F.flatten(F.transform(e, lambda p: p["hits"]))).alias("hits"), F.array_distinct(F.flatten(F.transform(e, lambda p: p["items"]))).alias("items")))

    def scanned(w):
        return F.struct(F.size(w).alias("n_words"), F.when(likely(w), found(w)).alias("f"))

    out = docs.withColumns(held).withColumn("found", let(own, scanned)).drop(*held)
    return out.withColumn("found", F.struct(F.col("found.n_words"), F.coalesce("found.f.hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("found.f.items", F.array().cast("array<string>")).alias("items")))


def _joined(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark beyond the bound: hashes of all texts' windows joined with those of its windows; texts that meet one are compared word by word."""
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts = docs.select(key.alias("__key"), words(F.col("text")).alias("w"))

    def of_length(k):
        return F.transform(positions(F.col("w"), k), lambda i: F.struct(F.lit(k).alias("length"), i.alias("at"), F.xxhash64(F.slice("w", i, k)).alias("h")))

    each = texts.select("__key", F.explode(F.concat(*map(of_length, lengths))).alias("p")).select("__key", "p.*")
    met = cut(each.join(grams, ["length", "h"]).distinct(), "met")
    own = cut(texts.join(met.select("__key").distinct(), "__key", "left_semi").groupBy("__key").agg(F.first("w").alias("w")), "own")
    hits = met.join(own, "__key").where(F.slice("w", F.col("at"), F.col("length")) == F.col("window")).select("__key", "item", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("hit"))
    by_text = cut(hits.groupBy("__key").agg(F.collect_set("hit").alias("hits"), F.collect_set("item").alias("items")), "by-text")  # a table, so that the join can be split at texts with many copies
    out = docs.withColumn("__key", key).join(by_text, "__key", "left")
    found = F.struct(F.size(words(F.col("text"))).alias("n_words"), F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("row", "text", found.alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_column: str = "doc_id", text_column: str = "text", **more) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row; null and empty texts have no words and no hits."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = occurrences(docs, benchmark, size, "doc_id", "text", **more).select("row.doc_id", "found.*")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, whole: bool = True, size: int = 10, id_column: str = "doc_id", text_column: str = "text", **more) -> DataFrame:
    """docs without contamination, in their own columns: whole documents with a hit go, or (whole=False) only the hit words and what parts them from the next."""
    found = occurrences(docs, benchmark, size, id_column, text_column, **more)
    if whole:
        return found.where(F.size("found.hits") == 0).select("row.*")
    both_cases = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    kept = F.regexp_extract_all("text", F.lit(both_cases), F.lit(0))
    gaps = F.split("text", both_cases, -1)
    pieces = F.zip_with(kept, F.slice(gaps, 2, F.greatest(F.size(kept), F.lit(1))), lambda a, b: F.concat(a, b))
    left = F.array_except(F.sequence(F.lit(1), F.size(kept)), "found.hits")
    rest = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(left, lambda i: F.get(pieces, i - 1)), ""))
    text = F.when(F.size("found.hits") > 0, rest).otherwise(F.col("text"))
    return found.select(*(text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, item, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
nh AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY r),
ni AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""
