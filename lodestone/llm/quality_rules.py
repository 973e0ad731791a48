"""Quality rules as a ledger of bits.

Every text is measured once; every rule is evaluated once on the measurements and leaves one bit of `failed`, set where
the text fails it. The ledger (measurements and bits) is a table. A policy is a named and versioned choice of rules; it
is applied to the bits alone, so policies can be changed, compared and taken apart without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_list, cut, table
from lodestone.llm.word_ids import groups, numbered

#: Words that make a window.
WINDOW = 3
#: Measurements of a text, all longs: words, code points in words, symbols, lines with a word that are equal to an
#: earlier one, words in windows found twice or more, lines with a word, letters A-Z, letters A-Z and a-z.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")
#: Rules by name, as conditions on the measurements under which a text fails; rule i has bit i. New rules go to the end,
#: so that bits of stored ledgers keep their meaning.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "capitals": "2 * n_capitals > n_letters",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rejects a text that fails any rule of required, or more than tolerated rules of counted."""

    name: str
    version: int
    required: tuple[str, ...]
    counted: tuple[str, ...] = ()
    tolerated: int = 0

    def __post_init__(self):
        if unknown := {*self.required, *self.counted} - RULES.keys():
            raise ValueError(f"no such rules: {sorted(unknown)}")
        if self.tolerated < 0:
            raise ValueError("tolerated must not be negative")

    def without(self, rule: str) -> Policy:
        return Policy(self.name, self.version, tuple(r for r in self.required if r != rule), tuple(r for r in self.counted if r != rule), self.tolerated)

    def keeps(self, failed: Column) -> Column:
        """Whether a text with these bits is kept."""
        ok = failed.bitwiseAND(F.lit(mask(self.required))) == 0
        if self.counted:
            ok &= F.bit_count(failed.bitwiseAND(F.lit(mask(self.counted)))) <= self.tolerated
        return ok


def mask(rules) -> int:
    return sum({BITS[r] for r in rules})


#: Published policies; a change is a new version.
POLICIES = {
    ("base", 1): Policy("base", 1, ("few_words", "repeated_windows")),
    ("web", 1): Policy("web", 1, ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length")),
    ("web", 2): Policy("web", 2, tuple(RULES)),
    ("web_lenient", 1): Policy("web_lenient", 1, ("few_words", "repeated_windows"), ("symbols", "duplicate_lines", "word_length", "capitals"), 1),
}

_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
#: What a byte adds to word_chars (bytes that begin a character outside white space), n_symbols, n_capitals and n_letters.
_COUNTED = np.stack(
    [
        ~_WHITE & ((np.arange(256) & 0xC0) != 0x80),
        np.isin(np.arange(256), list(b"#*$%&|<>")),
        np.isin(np.arange(256), list(range(65, 91))),
        np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]),
    ]
)


def repeated(lists: list[list[bytes]]) -> np.ndarray:
    """For each list of words, how many lie in windows of three that occur twice or more in it."""
    ids, starts, counts = numbered(lists)
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        often = counts[ids] > 1  # a repeated window has repeated words only; equal words of two lists have different numbers
        at = np.flatnonzero(often[:-2] & often[1:-1] & often[2:])
        _, pair = np.unique(ids[at] * len(counts) + ids[at + 1], return_inverse=True)
        _, name, times = np.unique(pair * len(counts) + ids[at + 2], return_inverse=True, return_counts=True)
        at = at[times[name] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:n]) > 0)])
    return inside[starts[1:]] - inside[starts[:-1]]


def measured(texts: list[bytes]) -> np.ndarray:
    """A row of MEASURES for each text. A window that would reach into the next text holds words of two texts, so it occurs once."""
    lists = [t.split() for t in texts]
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    out[:, 0] = [len(x) for x in lists]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for column, counted in zip((1, 2, 6, 7), _COUNTED):
        sums = np.concatenate([[0], np.cumsum(counted[data])])
        out[:, column] = sums[ends[1:]] - sums[ends[:-1]]
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, 3], out[i, 5] = len(lines) - len(set(lines)), len(lines)
    out[:, 4] = repeated(lists)
    return out


def measurements(docs: DataFrame, keep: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, *keep, *MEASURES) of every row. A null text counts as empty. Nothing is shuffled; a task holds 4 MB of texts at once, or one longer text."""
    own = docs.select(F.col(id_column).alias("doc_id"), *keep, F.col(text_column).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in binary_list(batch.column(batch.num_columns - 1))]
            rows = [measured(texts[a:b]) for a, b in groups(texts)]
            found = np.concatenate(rows) if rows else np.zeros((0, len(MEASURES)), np.int64)
            names = [*batch.schema.names[:-1], *MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names)

    return own.mapInArrow(run, ", ".join([*kinds, *(f"{m} long" for m in MEASURES)]))


def ledger(docs: DataFrame, keep: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A written table (doc_id, *keep, *MEASURES, failed): the measurements of every row, and the bits of the rules that it fails.

    Repeated rows give repeated rows, an empty table an empty one. A text without words fails few_words alone.
    """
    bits = [F.when(F.expr(condition), BITS[rule]).otherwise(0).cast("long") for rule, condition in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return cut(measurements(docs, keep, id_column, text_column).withColumn("failed", failed), "ledger")


def decided(rows: DataFrame, policy: Policy) -> DataFrame:
    """The rows of a ledger with what a policy says: kept."""
    return rows.withColumn("kept", policy.keeps(F.col("failed")))


def kept(docs: DataFrame, policy: Policy = POLICIES["web", 2], text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that a policy keeps."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("__row"), F.col(text_column).alias("__own"))
    rows = ledger(packed.withColumn("doc_id", F.lit(0)), ("__row",), text_column="__own")
    return rows.where(policy.keeps(F.col("failed"))).select(*(F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does in a ledger: (rule, n_docs, n_failed, n_alone, n_kept, n_kept_without).

    n_failed: texts that fail it; n_alone: those that fail no other rule of the policy; n_kept and n_kept_without: those
    kept by the policy, and by it without the rule. Texts are counted by their bits first, so one aggregate of at most
    2^rules groups serves all rules.
    """
    used = policy.required + policy.counted
    own = F.col("failed").bitwiseAND(F.lit(mask(used)))
    groups_ = rows.groupBy(own.alias("failed")).agg(F.count(F.lit(1)).alias("n"))

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    each = [
        F.struct(
            F.lit(rule).alias("rule"),
            (F.col("failed").bitwiseAND(F.lit(BITS[rule])) != 0).alias("fails"),
            (F.col("failed") == BITS[rule]).alias("alone"),
            policy.without(rule).keeps(F.col("failed")).alias("without"),
        )
        for rule in used
    ]
    flat = groups_.withColumn("kept", policy.keeps(F.col("failed"))).select("n", "kept", F.inline(F.array(*each)))
    return flat.groupBy("rule").agg(F.sum("n").alias("n_docs"), count(F.col("fails")).alias("n_failed"), count(F.col("alone")).alias("n_alone"), count(F.col("kept")).alias("n_kept"), count(F.col("without")).alias("n_kept_without"))


def profile(rows: DataFrame, by: str) -> DataFrame:
    """(by, n_docs, any_failed, all_failed) of a ledger: the bits that any row of a group has, and those that all have."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(ledger(table(spark, sf_dir, "documents")), POLICIES["web", 2])
    base = ~POLICIES["base", 1].keeps(F.col("failed"))
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), *MEASURES[5:], "failed")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the web policy does among documents."""
    return ablations(ledger(table(spark, sf_dir, "documents")), POLICIES["web", 2])


_WORD = "[^\\x20\\x09-\\x0D]"
_MEASURED = f"""d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '{_WORD}+') AS w, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORD}')] AS l FROM d),
t AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT i) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS c FROM t) WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM d JOIN w USING (k) LEFT JOIN r USING (k)),
f AS (SELECT *, CAST({' + '.join(f'CASE WHEN {c} THEN {BITS[r]} ELSE 0 END' for r, c in RULES.items())} AS BIGINT) AS failed FROM m)"""
ORACLE = {
    "op11_quality_rules": f"WITH {_MEASURED} SELECT doc_id, {', '.join(MEASURES[:5])}, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, {', '.join(MEASURES[5:])}, failed FROM f",
    "quality_rule_ablations": f"WITH {_MEASURED} SELECT rule, count(*) AS n_docs, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_alone, count(*) FILTER (failed = 0) AS n_kept, count(*) FILTER (failed & (63 - bit) = 0) AS n_kept_without FROM f, (VALUES {', '.join(f'({chr(39)}{r}{chr(39)}, {b})' for r, b in BITS.items())}) v(rule, bit) GROUP BY rule",
}
