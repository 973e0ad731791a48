"""Quality classifier: the perplexity of a text under an interpolated modified Kneser-Ney model of trusted text.

The units are the bytes of the UTF-8 text, so that no alphabet has to be chosen; a word that repeats the one before it is
one repeat mark. Counts, contexts and continuation counts are tables sharded by their keys and joined by Spark. Texts
are read once, in blocks: a block sends its distinct 4-grams to the shards, those of all blocks are joined with the
tables of every order, and each shard answers each block with the probabilities of its grams, which the block's texts
then add up. A document is rejected if its perplexity is above the quantile that trusted documents of its language hardly
ever exceed; the fewer of them there are, the more those of all languages count.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import cut, table
from lodestone.llm.packed import packed, unpacked

ORDER, BITS = 4, 8
#: Quantile of trusted documents' perplexity, and factor on it, from which a text is rejected.
QUANTILE, MARGIN = 0.999, 1.05
#: Trusted documents of a language at which its own quantile and that of all languages weigh the same.
EVEN_TRUSTED = 100
#: Bins of perplexity in a power of ten, in which quantiles are sought.
BINS = 1000
#: Units of a typical text that every text is credited with, so that short ones are not judged by a few characters.
PRIOR = 50
#: The discount of counts of which there are too few to estimate it.
DISCOUNT = 0.5
#: Bytes and rows of a block, blocks that meet a shard together, and grams of a shard.
BLOCK, BLOCK_ROWS, TOGETHER, SHARD = 4 << 20, 20_000, 8, 250_000
#: Grams that are counted together.
CHUNK = 1 << 22
REPEAT = "\x05"


def prepared(text: str) -> str:
    """text with single spaces between words, and each repeat of the word before, with its space, as one mark."""
    words = text.split()
    if any(map(str.__eq__, words, words[1:])):
        words[1:] = ["\x05" if a == b else b for a, b in zip(words, words[1:])]
        return " ".join(words).replace(" \x05", "\x05")
    return " ".join(words)


def grams(text: str | None) -> np.ndarray:
    """Keys of the 4-grams that end at each byte of the text with its repeats marked, and at its end; zero bytes pad both ends."""
    own = np.frombuffer(prepared(text or "").encode("utf-8", "replace"), np.uint8)
    s = np.zeros(len(own) + ORDER, np.uint32)
    s[ORDER - 1 : -1] = own
    return s[:-3] << np.uint32(24) | s[1:-2] << np.uint32(16) | s[2:-1] << np.uint32(8) | s[3:]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, rising."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint32(1)))]


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the keys asked, which keys (rising) has all: through a table of hashes, and by halving for keys that lost their place in it."""
    bits = max(8, min(22, int(len(keys)).bit_length() + 4))
    place = lambda x: (x * np.uint32(2654435769)) >> np.uint32(32 - bits)
    holder, held = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits)
    at = place(keys)
    holder[at], held[at] = keys, values
    at = place(asked)
    out = held[at]
    lost = np.flatnonzero(holder[at] != asked)
    out[lost] = values[np.searchsorted(keys, asked[lost])]
    if len(keys) and keys[0] == 0:  # an empty place looks like the key zero
        out[asked == 0] = values[0]
    return out


def gram_counts(texts: DataFrame) -> DataFrame:
    """(key, c) of the 4-grams of the column text."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["key", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.append(grams(text.as_py()))
                n += len(held[-1])
                if n > CHUNK:
                    yield flush()
                    held.clear()
                    n = 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """What counts of one, two, and three or more lose (Chen and Goodman); DISCOUNT where the counts of counts say nothing."""
    n = {r[0]: float(r[1]) for r in counts.groupBy(F.least("c", F.lit(5)).alias("k")).count().collect()}  # five rows at most
    y = n.get(1, 0) / (n.get(1, 0) + 2 * n.get(2, 0)) if n.get(1) else 0.0
    out = [k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) else 0.0 for k in (1, 2, 3)]
    return [x if 0 < x < k else DISCOUNT for k, x in enumerate(out, 1)]


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 4 to 1: (key, alpha) of the seen grams and (context, gamma) of the seen contexts, by joins of count tables.

    Orders below the highest count the distinct units seen before a gram.
    """
    out, c = [], counts
    for order in range(ORDER, 0, -1):
        d = discounts(c)
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        keyed = c.withColumn("context", F.shiftright("key", BITS))
        contexts = keyed.groupBy("context").agg(F.sum("c").alias("total"), F.sum(taken).alias("freed"))
        alphas = keyed.join(contexts, "context").select("key", ((F.col("c") - taken) / F.col("total")).alias("alpha"))
        out.append((alphas, contexts.select("context", (F.col("freed") / F.col("total")).alias("gamma"))))
        if order > 1:
            c = cut(c.groupBy(F.col("key").bitwiseAND((1 << (order - 1) * BITS) - 1).alias("key")).agg(F.count(F.lit(1)).alias("c")), "continuations")
    return out


def probabilities(keys: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, p): the probability of the last unit of each 4-gram of keys (key), from joins with the grams and contexts of each order. Below the first order all units are alike."""
    out = keys.select("key", F.lit(1.0 / (1 << BITS)).alias("p"))
    for order, (alphas, gammas) in enumerate(reversed(levels), 1):
        own = out.withColumn("k", F.col("key").bitwiseAND((1 << order * BITS) - 1)).withColumn("context", F.shiftright("k", BITS))
        joined = own.join(alphas.withColumnRenamed("key", "k"), "k", "left").join(gammas, "context", "left")
        out = joined.select("key", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys.astype(np.int64) * 40503 >> 12) % shards


def blocks(rows: DataFrame, text: str, kind: int) -> DataFrame:
    """(p, kind, a): of each block p the distinct grams of its texts (kind 0) or its rows, a column row of structs (kind 1).

    Blocks are the same for both kinds, as tables give the same partitions and batches whenever they are read.
    """
    at = rows.schema["row"].dataType.names.index(text)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        number, held, n = -1, [], 0

        def flush():
            if kind:
                data = ipc(pa.Table.from_batches(held).combine_chunks())
            else:
                keys = distinct(np.concatenate([grams(t.as_py()) for b in held for t in b.column(0).field(at)]))
                data = packed(np.diff(keys, prepend=np.uint32(0)))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["p", "kind", "a"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if number < 0:
                number = batch.column(1)[0].as_py() << 32
            batch = batch.select(["row"])
            sizes = pc.binary_length(batch.column(0).field(at)).fill_null(0).to_numpy(zero_copy_only=False)
            first = 0
            for i, size in enumerate(sizes.tolist()):
                n += size + 64
                if n > BLOCK or sum(map(len, held)) + i + 1 - first >= BLOCK_ROWS:
                    held.append(batch.slice(first, i + 1 - first))
                    yield flush()
                    held.clear()
                    number, first, n = number + 1, i + 1, 0
            if first < len(sizes):
                held.append(batch.slice(first))
        if held:
            yield flush()

    # the number of a partition of the table, not of a task, which differs where tables are united
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, "p long, kind int, a binary")


def ipc(rows) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def decoded(kept: DataFrame) -> DataFrame:
    """(key): the distinct grams of all blocks."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            for a in batch.column(0):
                held.append(np.cumsum(unpacked(a.as_py(), np.uint32), dtype=np.uint32))
                n += len(held[-1])
                if n > CHUNK:
                    held = [distinct(np.concatenate(held))]
                    n = len(held[0])
                    if n > CHUNK // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held.pop().astype(np.int64))], ["key"])
                        n = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(distinct(np.concatenate(held)).astype(np.int64))], ["key"])

    return kept.select("a").mapInArrow(run, "key long").distinct()


def split(kept: DataFrame, shards: int) -> DataFrame:
    """(p, s, a): of each block p its distinct grams in each shard s that has any."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p, a in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = np.cumsum(unpacked(a.as_py(), np.uint32), dtype=np.uint32)
                where = shard_of(keys, shards)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(shards + 1))
                rows = [(s, packed(np.diff(keys[order[i:j]], prepend=np.uint32(0)))) for s, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["p", "s", "a"])

    return kept.select("p", "a").mapInArrow(run, "p long, s int, a binary")


def digest(keys: np.ndarray) -> bytes:
    return zlib.crc32(keys.tobytes()).to_bytes(4, "little")


def answered(kept: DataFrame, known: DataFrame, shards: int, times: int) -> DataFrame:
    """(p, kind, a): for each block and shard (kind 2 + shard) a digest of the block's grams there, and their probabilities' logarithms in their order."""
    salted = F.pmod(F.col("p") + F.shiftright("p", 32) * 7919, F.lit(times)).cast("int")
    asked = split(kept, shards).withColumn("r", salted)
    of_key = F.pmod(F.shiftright(F.col("key") * 40503, 12), F.lit(shards)).cast("int")
    model = known.select("key", F.log10("p").cast("float").alias("l"), of_key.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("r"))

    def answer(blocks_, held):
        import pyarrow as pa

        key = held.column("key").combine_chunks().to_numpy()
        order = np.argsort(key)
        key, logs = key[order], held.column("l").combine_chunks().to_numpy()[order]
        out = []
        for p, a, s in zip(*(blocks_.column(n) for n in ("p", "a", "s"))):
            own = np.cumsum(unpacked(a.as_py(), np.uint32), dtype=np.uint32)
            out.append((p.as_py(), 2 + s.as_py(), digest(own) + packed(logs[np.searchsorted(key, own)])))
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate((("p", pa.int64()), ("kind", pa.int32()), ("a", pa.binary())))})

    return asked.groupBy("s", "r").cogroup(model.groupBy("s", "r")).applyInArrow(answer, "p long, kind int, a binary")


def measured(docs: DataFrame, model: Model, text: str = "text", out: list[str] | None = None) -> DataFrame:
    """(row, perplexity) of every row of docs, a table that is written and comes out alike whenever it is read; row has the columns out of it, or all.

    Blocks of the two readings are compared by digests of their grams: an error, not a wrong result, follows if they differ.
    """
    names = docs.columns
    fields = StructType([f for f in docs.schema.fields if out is None or f.name in out])
    at, own = names.index(text), [names.index(f.name) for f in fields]
    rows = docs.select(F.struct("*").alias("row"))
    kept = cut(blocks(rows, text, 0), "blocks")
    known = cut(probabilities(cut(decoded(kept), "asked"), model.levels), "probabilities")
    n_blocks = kept.count()
    n_keys, typical = model.typical(known)
    shards = max(1, -(-n_keys // SHARD))
    times = max(1, -(-n_blocks // (TOGETHER * shards)))  # a block sends a shard its own grams only, so a copy of the shard serves as many more blocks

    def add(group):
        import pyarrow as pa

        logs = {k.as_py(): a.as_py() for k, a in zip(group.column("kind"), group.column("a"))}
        rows = pa.ipc.open_stream(logs.pop(1)).read_all().column(0).combine_chunks()
        each = [grams(t.as_py()) for t in rows.field(at)]
        line = np.concatenate(each)
        keys = distinct(line)
        shard, found, told = shard_of(keys, shards), np.zeros(len(keys)), 0
        for s, a in logs.items():
            here = shard == s - 2
            if digest(keys[here]) != a[:4]:
                raise ValueError("a block has other grams than it had")
            found[here] = unpacked(a[4:], np.float32)
            told += int(here.sum())
        if told != len(keys):
            raise ValueError("a block has other grams than it had")
        sizes = np.array([len(x) for x in each])
        sums = np.concatenate([np.add.reduceat(looked_up(keys, found, line[i:j]), at_ - i) for i, j, at_ in pieces(sizes)])
        perplexity = 10 ** (-(sums + PRIOR * typical) / (sizes + PRIOR))
        row = pa.StructArray.from_arrays([rows.field(k) for k in own], names=[names[k] for k in own])
        return pa.table({"row": row, "perplexity": pa.array(perplexity, pa.float64())})

    schema = StructType([StructField("row", fields), StructField("perplexity", DoubleType())])
    return answered(kept, known, shards, times).union(blocks(rows, text, 1)).groupBy("p").applyInArrow(add, schema)


def pieces(sizes: np.ndarray):
    """(first, stop, starts) of stretches of the concatenated arrays of these sizes, of about CHUNK each."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        begin = ends[first] - sizes[first]
        stop = max(first + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
        yield int(begin), int(ends[stop - 1]), (ends - sizes)[first:stop]
        first = stop


class Model:
    """The tables of every order, and the counts of the trusted texts' grams."""

    def __init__(self, levels: list[tuple[DataFrame, DataFrame]], counts: DataFrame):
        self.levels, self.counts = levels, counts

    def typical(self, known: DataFrame) -> tuple[int, float]:
        """The number of grams known (key, p), and the mean logarithm of a unit's probability in the trusted texts, whose grams are among them."""
        row = known.join(self.counts, "key", "left").agg(F.count(F.lit(1)), F.sum(F.col("c") * F.log10("p")), F.sum("c")).first()
        return row[0], float(row[1] / row[2]) if row[2] else 0.0


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the whole texts of all trusted rows (columns doc_id, text; doc_id, quality); None without any."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")  # any number of ids: never broadcast
    counts = cut(gram_counts(own.select("text")), "grams")
    return None if counts.isEmpty() else Model(kneser_ney(counts), counts)


def quantiles(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, at, n): the exact quantile (the least value that a share quantile of the rows does not exceed) of perplexity, and the number of rows, of each language and, with whole true, of all rows.

    Counts of narrow bins name the bin that holds it; only that bin's values are ranked.
    """
    both = scored.withColumn("bin", F.floor(F.log10("perplexity") * BINS)).select("perplexity", "bin", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang")), F.when(F.col("lang").isNotNull(), F.struct(F.lit(False).alias("whole"), F.col("lang").alias("lang"))))).alias("of")).where("of IS NOT NULL")
    both = both.select("of.*", "perplexity", "bin")
    group = Window.partitionBy("whole", "lang")
    bins = both.groupBy("whole", "lang", "bin").agg(F.count(F.lit(1)).alias("c"))  # a few thousand rows a language at most
    bins = bins.withColumns({"n": F.sum("c").over(group), "upto": F.sum("c").over(group.orderBy("bin"))}).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * quantile)))
    bins = bins.where("upto >= rank AND upto - c < rank").select(F.col("whole").alias("w"), F.col("lang").alias("l"), F.col("bin").alias("b"), "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("left"))
    same = (F.col("whole") == F.col("w")) & F.col("lang").eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b"))
    held = both.join(F.broadcast(bins), same).select("whole", "lang", "perplexity", "n", "left")
    counted = held.groupBy("whole", "lang", "perplexity", "n", "left").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(group.orderBy("perplexity")))
    return counted.where("upto >= left AND upto - c < left").select("whole", "lang", F.col("perplexity").alias("at"), "n")


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, threshold) of each language with a trusted document; the row with lang null is for every other language.

    A language's quantile, over all its n trusted documents, weighs n / (n + EVEN_TRUSTED); the rest is that of all languages.
    """
    trusted = scored.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    found = cut(quantiles(trusted.select("lang", "perplexity"), quantile), "quantiles")  # a row for each language
    pooled = found.where("whole").select(F.lit(None).cast("string").alias("lang"), (F.col("at") * margin).alias("pooled"))
    weight = F.col("n") / (F.col("n") + EVEN_TRUSTED)
    blended = found.where("NOT whole").crossJoin(F.broadcast(pooled.select("pooled"))).select("lang", (F.col("at") * margin * weight + F.col("pooled") * (1 - weight)).alias("threshold"))
    return blended.union(pooled)


def limit(limits: DataFrame, lang):
    """The threshold of a language as a column, from thresholds()."""
    own = {r.lang: r.threshold for r in limits.collect()}  # a row for each language with trusted rows
    other = F.lit(own.pop(None))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[F.coalesce(lang, F.lit(""))], other) if own else other


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, written: bool = False) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every row of docs (doc_id, text, lang), from labels (doc_id, quality).

    Null and empty texts score as the end of a text. Repeated rows stay. Without any trusted row nothing can be told, so
    perplexity and threshold are null and every row is kept. Texts are read twice: docs is written first, unless written
    says that it is a table that comes out alike whenever it is read.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    docs = docs if written else cut(docs, "texts")
    model = train(docs, labels)
    if model is None:
        return docs.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    scored = cut(measured(docs, model, "text", ["doc_id", "lang"]).select("row.doc_id", "row.lang", "perplexity"), "perplexities")
    own = limit(thresholds(scored, labels, quantile, margin), F.col("lang"))
    return scored.select("doc_id", "lang", "perplexity", own.alias("threshold"), (F.col("perplexity") <= own).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, written: bool = False, **more) -> DataFrame:
    """The rows of docs that the classifier keeps, in their own columns; every text is scored once. written: as in classify."""
    docs = docs if written else cut(docs, "texts")
    model = train(docs, labels)
    if model is None:
        return docs
    scored = cut(measured(docs, model), "measured")
    named = scored.select("row.doc_id", F.col("row.lang").cast("string").alias("lang"), "perplexity")
    own = limit(thresholds(named, labels, **more), F.col("row.lang").cast("string"))
    return scored.where(F.col("perplexity") <= own).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), written=True)
