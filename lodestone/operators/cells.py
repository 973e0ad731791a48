"""The best documents of each question over cells: every block of documents meets every block of questions once.

Documents and questions are tables of entries by term (or of vectors). Blocks of documents are salted by id and sent to
each block of questions, and the other way round; a cell is worked on in one task and lets out the best of each of its
questions only. One more aggregate takes the best of all cells. Each table is read once, however many questions there
are, and nothing goes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of documents, and questions, of a cell; and entries for which a cell more pays while there are fewer cells than tasks.
CELL_ENTRIES, CELL_QUESTIONS, LEAST_ENTRIES = 1 << 20, 4096, 1 << 15
#: What is lost to rounding when bounds are compared.
SLACK = 1e-6


def in_cells(questions: DataFrame, documents: DataFrame, q: str, doc: str, n_questions: int, n_entries: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column cell. All rows of a question are in the same cells, and all rows of a document."""
    spark = questions.sparkSession
    across = max(1, ceil(n_questions / CELL_QUESTIONS))
    down = max(1, ceil(n_entries / CELL_ENTRIES), min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n_entries / LEAST_ENTRIES)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = documents.withColumn("__d", F.pmod(F.xxhash64(doc), F.lit(down))).withColumn("__q", all_of(across))
    right = questions.withColumn("__q", F.pmod(F.xxhash64(q), F.lit(across))).withColumn("__d", all_of(down))
    own = (F.col("__d") * across + F.col("__q")).alias("cell")
    return right.select(own, *questions.columns), left.select(own, *documents.columns)


def coded(column) -> tuple:
    """The distinct values of an Arrow column in their order, and the place of each row's value among them."""
    import pyarrow.compute as pc

    kinds = pc.unique(column)
    kinds = kinds.take(pc.sort_indices(kinds))
    return kinds, pc.index_in(column, kinds).to_numpy(zero_copy_only=False)


class Postings:
    """Entries (term, doc, values) of a cell, by term."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, values: np.ndarray):
        order = np.lexsort((docs, terms))
        self.terms, first = np.unique(terms[order], return_index=True)
        self.docs, self.values = docs[order], values[:, order]
        self.first, self.last = first, np.append(first[1:], len(order))
        #: The greatest of each value of a term.
        self.most = np.maximum.reduceat(self.values, first, axis=1) if len(first) else self.values

    def best(self, terms: np.ndarray, weights: np.ndarray, gain: Callable, mix: np.ndarray, limit: int, n: int, down: bool, bar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(docs, scores, parts, entries read) of the limit best documents of a question (terms, weights) by MaxScore.

        Terms come in the order of what they can add at most, rare ones first. As soon as the terms left cannot lift a
        document that has none of the others to the limit-th score so far, only documents met already are looked up; and
        of these only those that can still reach it. bar: a score that limit documents of all cells are known to reach.
        """
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[:, here]
        most = mix @ gain(weights, self.most[:, at])
        order = np.argsort(-most, kind="stable")
        at, weights, most = at[order], weights[:, order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)[1:]  # what the terms after each can add together
        parts, met, alive, read = np.zeros((len(mix), n)), np.zeros(n, bool), None, 0
        for j, k in enumerate(at if most.sum() >= bar - SLACK else ()):
            own = slice(self.first[k], self.last[k])
            docs, values = self.docs[own], self.values[:, own]
            if alive is not None:
                place = np.searchsorted(docs, alive)
                hit = place < len(docs)
                hit[hit] = docs[place[hit]] == alive[hit]
                docs, values = alive[hit], values[:, place[hit]]
                read += len(docs)
            else:
                met[docs] = True
                read += len(docs)
            parts[:, docs] += gain(weights[:, j : j + 1], values)
            if j % 3 == 2 or j == len(at) - 1:
                seen = np.flatnonzero(met) if alive is None else alive
                scores = mix @ parts[:, seen]
                if len(seen) > limit:
                    bar = max(bar, np.partition(scores, -limit)[-limit])
                if alive is not None or rest[j] < bar - SLACK:
                    alive = seen[scores + rest[j] >= bar - SLACK]
        seen = np.flatnonzero(met) if alive is None else alive
        scores = np.round(mix @ parts[:, seen], 8)
        seen, scores = seen[scores >= bar - SLACK], scores[scores >= bar - SLACK]
        own = np.round(parts[:, seen], 10)  # so that the order of sums does not part ties
        first = np.lexsort((-seen if down else seen, *-own[::-1], -scores) if len(mix) > 1 else (-seen if down else seen, -scores))[:limit]
        return seen[first], scores[first], own[:, first], read


def top_by_terms(questions: DataFrame, documents: DataFrame, n_entries: int, gain: Callable, mix: list[float], limit: int, parts: list[str], down: bool = False) -> DataFrame:
    """(q, id, score, *parts, entries) of the limit best documents of each question in each cell, without those below the question's bar.

    questions: q, term long, weights, and bar, a score that the limit-th best of all documents reaches, or null;
    documents: n_entries rows of id, term long, and values; each pair once. gain(weights, values)
    gives a row for each of parts, with what entries add to it: never less for larger values, never negative. The score
    is the sum of the parts times mix; ties go by the parts, then by id (the largest first if down). entries: how many
    entries of the cell the question read, once for each cell and question with any result.
    """
    import pyarrow as pa

    right, left = in_cells(questions, documents, "q", "id", questions.select("q").distinct().count(), n_entries)
    kinds = questions.schema["q"].dataType.simpleString(), documents.schema["id"].dataType.simpleString()
    mixed = np.array(mix)

    def work(docs: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["q", "id", "score", *parts, "entries"]
        ids, code = coded(docs["id"].combine_chunks())
        values = np.array([docs[c].to_numpy() for c in docs.column_names[3:]], float).reshape(docs.num_columns - 3, -1)
        posts = Postings(docs["term"].to_numpy(), code, values)
        who, number = coded(asked["q"].combine_chunks())
        order = np.argsort(number, kind="stable")
        terms = asked["term"].to_numpy()[order]
        weights = np.array([asked[c].to_numpy()[order] for c in asked.column_names[3:-1]], float).reshape(asked.num_columns - 4, -1)
        bars = np.nan_to_num(asked["bar"].to_numpy()[order].astype(float), nan=-np.inf)
        ends = np.searchsorted(number[order], np.arange(len(who) + 1))
        found = [posts.best(terms[a:b], weights[:, a:b], gain, mixed, limit, len(ids), down, bars[a]) for a, b in zip(ends, ends[1:])] if len(ids) else []
        sizes = [len(x[0]) for x in found]
        took = [np.concatenate([x[i] for x in found], axis=-1) if found else np.zeros((len(parts), 0)) if i == 2 else np.zeros(0, np.int64) for i in range(3)]
        entries = np.concatenate([np.append([x[3]], np.zeros(len(x[0]) - 1, np.int64)) for x in found if len(x[0])]) if sum(sizes) else np.zeros(0, np.int64)
        rows = [who.take(pa.array(np.repeat(np.arange(len(sizes)), sizes).astype(np.int64))), ids.take(pa.array(took[0].astype(np.int64))), pa.array(took[1].astype(float)), *(pa.array(took[2][i]) for i in range(len(parts))), pa.array(entries.astype(np.int64))]
        return pa.table(rows, names=names)

    schema = f"q {kinds[0]}, id {kinds[1]}, score double, {''.join(f'{p} double, ' for p in parts)}entries long"
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(work, schema)


def top_by_vectors(questions: DataFrame, documents: DataFrame, limit: int, but_itself: bool) -> DataFrame:
    """(q, id, score): the limit documents (id, v) of each cell whose unit vectors are nearest those of each question (q, v), by their product; ties by id."""
    import pyarrow as pa

    width = documents.select(F.size("v")).first()
    n = documents.count() * max(1, width[0] if width else 1)
    right, left = in_cells(questions, documents, "q", "id", questions.count(), n)
    kinds = questions.schema["q"].dataType.simpleString(), documents.schema["id"].dataType.simpleString()

    def matrix(column, rows):
        return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)

    def work(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return pa.table([asked["q"].slice(0, 0), docs["id"].slice(0, 0), pa.array([], pa.float64())], names=["q", "id", "score"])
        docs = docs.sort_by("id")
        ids, names = docs["id"].combine_chunks(), asked["q"].combine_chunks()
        theirs, own = matrix(docs["v"], docs.num_rows), matrix(asked["v"], asked.num_rows)
        same = np.array(ids.to_pylist(), object) if but_itself else None
        out = []
        for i, name in enumerate(names.to_pylist()):
            scores = np.round(theirs @ own[i], 8)
            if but_itself:
                scores[same == name] = -np.inf
            near = np.flatnonzero(scores >= np.partition(scores, -limit)[-limit]) if len(scores) > limit else np.arange(len(scores))
            near = near[np.argsort(-scores[near], kind="stable")][:limit]
            near = near[scores[near] > -np.inf]
            out.append((near, scores[near]))
        at = np.repeat(np.arange(len(out)), [len(x) for x, _ in out])
        return pa.table([names.take(pa.array(at)), ids.take(pa.array(np.concatenate([x for x, _ in out]))), pa.array(np.concatenate([s for _, s in out]))], names=["q", "id", "score"])

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(work, f"q {kinds[0]}, id {kinds[1]}, score double")
