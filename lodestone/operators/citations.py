"""Legal citations in free text: a small grammar run as a table function, and matches between predictions and gold.

The parser reads one text at a time as a stream of lexemes; matching and resolution are joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# The regulations that a citation can name, with the prefix of their parents' ids.
REGULATIONS = {"376/2014": "EU_376_2014", "2015/1018": "EU_2015_1018", "2020/2034": "EU_2020_2034", "2021/2082": "EU_2021_2082"}
DEFAULT = "376/2014"
# Characters before and after a citation in which a regulation counts as named, and the bound of ranges that are expanded.
REACH, RANGE = 140, 30

#: What a text is made of, for this grammar: words, numbers and signs, each with the place where it stands. Other text is one lexeme: it
#: begins with a word that goes on with no citation (too long for a label), and up to its end has no number, underscore or word that opens one.
OPENERS = r"(?!(?:articles?|art|gm|recitals?|annex)(?![^\W\d_]))"
LEXEME = re.compile(rf"(?P<other>(?<!\w)(?!(?:paragraphs?)(?![^\W\d_])){OPENERS}[^\W\d_]{{4,}}+\W++(?:{OPENERS}[^\W\d_]++\W++)*+)|" r"(?P<word>[^\W\d_]+)|(?P<digits>\d+)|(?P<space>\s+)|(?P<sign>.)", re.S)
DASHES = "-–—"
ROMAN = ("i", "ii", "iii", "iv", "v")


@dataclass(frozen=True)
class Lexeme:
    """kind: word, digits, space, sign or other; start and stop in the text."""

    kind: str
    text: str
    start: int
    stop: int


END_OF_TEXT = Lexeme("end", "", 0, 0)


def lexemes(text: str) -> list[Lexeme]:
    return [Lexeme(m.lastgroup, m[0], m.start(), m.end()) for m in LEXEME.finditer(text)]


class Reading:
    """A text as lexemes, and the rules of the grammar; each rule takes a position and returns what it read and where it stopped, or None."""

    def __init__(self, text: str):
        self.items = lexemes(text)
        self.named = list(self._regulations())

    def at(self, i: int) -> Lexeme:
        return self.items[i] if 0 <= i < len(self.items) else END_OF_TEXT

    def skip(self, i: int) -> int:
        """Past white space."""
        return i + (self.at(i).kind == "space")

    def number(self, i: int, most: int) -> tuple[str, int] | None:
        """Digits, at most so many."""
        x = self.at(i)
        return (x.text, i + 1) if x.kind == "digits" and len(x.text) <= most else None

    def _regulations(self):
        """(first lexeme, end in the text, name) of every regulation: number, slash, year, not part of a longer word."""
        for i, x in enumerate(self.items):
            if x.kind != "digits" or self.at(i - 1).kind == "word" or self.at(i - 1).text == "_":
                continue
            slash = self.skip(i + 1)
            year = self.skip(slash + 1)
            name = f"{x.text}/{self.at(year).text}"
            if self.at(slash).text == "/" and name in REGULATIONS and self.at(year + 1).kind != "word" and self.at(year + 1).text != "_":
                yield x.start, self.at(year).stop, name

    def regulation(self, i: int) -> tuple[str, bool]:
        """The regulation whose name ends last within reach before lexeme i, or starts first within reach after it; else the default, marked so."""
        here = self.at(i).start
        before = [name for start, stop, name in self.named if here - REACH <= start and stop <= here]
        after = [name for start, stop, name in self.named if here <= start and stop <= here + REACH]
        return (before[-1], False) if before else (after[0], False) if after else (DEFAULT, True)

    def bracket(self, i: int) -> tuple[str, int] | None:
        """( label ): up to three letters or digits."""
        if self.at(i).text != "(":
            return None
        i, label = self.skip(i + 1), ""
        while self.at(i).kind in ("word", "digits") and self.at(i).text.isascii():
            label, i = label + self.at(i).text, i + 1
        i = self.skip(i)
        return (label, i + 1) if 0 < len(label) <= 3 and self.at(i).text == ")" else None

    def joint(self, i: int, words: tuple[str, ...], signs: str) -> tuple[set[str], int]:
        """Joining words, signs and white space from i on: which, and where they stop."""
        seen: set[str] = set()
        while (x := self.at(i)).kind == "space" or x.kind == "word" and x.text in words or x.kind == "sign" and x.text in signs:
            seen.add(("line" if x.text.strip(" ") else "space") if x.kind == "space" else "dash" if x.text in DASHES else x.text)
            i += 1
        return seen, i

    def labels(self, i: int) -> tuple[list[tuple[str, ...]], int]:
        """Runs of bracketed labels: letters that follow at once refine the label before them, others begin a new one; two joined as a range stand for all between."""
        paths: list[tuple[str, ...]] = []
        ranges, stop = False, i
        while True:
            seen, start = self.joint(stop, ("and", "to"), ",;" + DASHES)
            found = self.bracket(start)
            if found is None:
                break
            label, stop = found
            if paths and seen <= {"space"} and label.isalpha():
                paths[-1] += (label,)
            else:
                paths.append((label,))
            ranges |= len(paths) > 1 and not seen.isdisjoint({"dash", "to"})
        if ranges and len(paths) == 2 and len(paths[0]) == len(paths[1]) == 1:
            paths = [(n,) for n in between(paths[0][0], paths[1][0])]
        return paths, stop

    def spelled(self, i: int) -> tuple[list[tuple[str, ...]], int] | None:
        """", paragraph(s) 4 and 5": numbers in words' company instead of brackets."""
        i = self.skip(i)
        if self.at(i).text == ",":
            i = self.skip(i + 1)
        if self.at(i).text not in ("paragraph", "paragraphs") or self.at(i + 1).kind != "space" or not (found := self.number(i + 2, 3)):
            return None
        numbers, ranges, stop = [found[0]], False, found[1]
        while True:
            one = self.skip(stop)
            joined = self.at(one)
            if joined.text not in (",", "and", "to", "-", "–") or not (found := self.number(self.skip(one + 1), 3)):
                break
            ranges |= joined.text in ("to", "-", "–")
            numbers.append(found[0])
            stop = found[1]
        return [(n,) for n in (between(*numbers) if ranges and len(numbers) == 2 else numbers)], stop

    def units(self, i: int) -> tuple[list[tuple[str, ...]], int]:
        return self.spelled(i) or self.labels(i)

    def article(self, i: int, plural: bool, number: str) -> tuple[list[tuple[str, tuple[str, ...]]], int]:
        """(number, subs) of an article whose number ends before i, and of those that the text goes on with; a number cut to three digits stands alone."""
        if len(self.at(i - 1).text) > 3:
            return [(number, ())], i
        paths, stop = self.units(i)
        out = [(number, p) for p in paths or [()]]
        while True:
            seen, start = self.joint(stop, ("and", "to"), ",;")
            more = self.number(start, 3) if seen - {"space", "line"} else None
            if more is None:
                return out, stop
            paths, after = self.units(more[1])
            if not (paths or plural):
                return out, stop
            out += [(more[0], p) for p in paths or [()]]
            stop = after

    def opening(self, i: int) -> tuple[str, str, int, bool] | None:
        """(kind, number, end, plural) if a citation opens at the word i."""
        x, after = self.at(i), self.skip(i + 1)
        if x.kind != "word" or self.at(i - 1).kind == "digits" or self.at(i - 1).text == "_":
            return None
        if x.text in ("article", "articles", "art"):
            dot = self.at(i + 1).text == "."
            if x.text == "art" and not dot:
                return None
            found = self.number(self.skip(i + 2) if dot else after, 99)
            return ("ARTICLE", found[0][:3], found[1], x.text == "articles") if found else None
        if x.text == "gm":
            parts = self.number(after, 2), self.number(after + 2, 2)
            if all(parts) and self.at(after + 1).text == "." and self.at(after + 3).kind != "word":
                return "GM", f"{parts[0][0]}.{parts[1][0]}", after + 3, False
        elif x.text in ("recital", "recitals") and after > i + 1 and (found := self.number(after, 3)) and self.at(found[1]).kind != "word":
            return "RECITALS", found[0], found[1], False
        elif x.text == "annex" and self.at(i + 1).kind != "digits" and self.at(i + 1).text != "_":
            label = self.at(after) if after > i + 1 else END_OF_TEXT
            numbered = label.text in ROMAN and self.at(after + 1).kind != "digits"
            return "ANNEX", label.text.upper() if numbered else "", after + 1 if numbered else i + 1, False
        return None


def between(first: str, last: str) -> list[str]:
    """The numbers from first to last if they rise by less than RANGE; otherwise the two labels."""
    if first.isdecimal() and last.isdecimal() and int(first) < int(last) < int(first) + RANGE:
        return list(map(str, range(int(first), int(last) + 1)))
    return [first, last]


def parse(text: str | None) -> list[tuple[str, str, str, list[str], bool]]:
    """Distinct citations (regulation, kind, number, subs, defaulted): articles first, then guidance, annexes and recitals, each in order."""
    reading = Reading((text or "").lower())
    found: list[tuple[int, tuple[str, bool], str, str, tuple[str, ...]]] = []
    i = 0
    while i < len(reading.items):
        opened = reading.opening(i)
        if opened is None:
            i += 1
            continue
        kind, number, stop, plural = opened
        if kind == "ARTICLE":
            units, stop = reading.article(stop, plural, number)
            found += [(0, reading.regulation(i), kind, n, subs) for n, subs in units]
        else:
            order = ("GM", "ANNEX", "RECITALS").index(kind) + 1
            found.append((order, (DEFAULT, False) if kind == "GM" else reading.regulation(i), kind, number, ()))
        i = max(stop, i + 1)
    out: dict[tuple, bool] = {}
    for _, (regulation, defaulted), kind, number, subs in sorted(found, key=lambda x: x[0]):
        out.setdefault((regulation, kind, number, subs), defaulted)
    return [(*key[:3], list(key[3]), defaulted) for key, defaulted in out.items()]


@udtf(returnType="position: int, regulation: string, kind: string, number: string, subs: array<string>, defaulted: boolean")
class Citations:
    """parse() as a table function."""

    def eval(self, text: str):
        for i, row in enumerate(parse(text)):
            yield i, *row


def citations(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """texts with a row for each of its citations (position, regulation, kind, number, subs, defaulted); rows without one vanish."""
    return texts.lateralJoin(Citations(F.col(text_column).outer()))


def candidates(cited: DataFrame, parents: DataFrame) -> DataFrame:
    """cited with parent_ids: the existing parents that a citation may mean; for one without a regulation those of all regulations."""
    prefix = F.create_map(*(F.lit(x) for kv in REGULATIONS.items() for x in kv))
    regulations = F.when(F.col("defaulted"), F.array(*map(F.lit, REGULATIONS))).otherwise(F.array("regulation"))

    def named(r):
        p, n = prefix[r], F.col("number")
        return (
            F.when(F.col("kind") == "ARTICLE", F.concat(p, F.lit("_ART_"), n))
            .when(F.col("kind") == "RECITALS", F.concat(p, F.lit("_RECITALS")))
            .when(F.col("kind") == "GM", F.concat(F.lit("GM_EU_376_2014_SEC_"), F.replace(n, F.lit("."), F.lit("_"))))
            .otherwise(F.concat(p, F.lit("_ANNEX"), F.when(n == "", "").otherwise(F.concat(F.lit("_"), n))))
        )

    keyed = cited.withColumn("__row", F.monotonically_increasing_id()).withColumn("__ids", F.array_distinct(F.transform(regulations, named)))
    keyed = keyed.select("*", F.explode("__ids").alias("__id")).drop("__ids")
    known = parents.select(F.col("parent_id").alias("__known")).distinct()
    rest = [c for c in keyed.columns if c not in ("__id", "__row")]
    joined = keyed.join(known, keyed["__id"] == known["__known"], "left").groupBy("__row", *rest).agg(F.array_sort(F.collect_set("__known")).alias("parent_ids"))
    return joined.drop("__row")


def matches(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, exact, parent) of pairs (id, prediction, gold): whether the prediction names every unit, and a candidate of every resolvable unit, of gold; null where gold has none."""
    gold = candidates(citations(pairs.select("id", F.col("gold").alias("text"))).drop("text"), parents)
    said = candidates(citations(pairs.select("id", F.col("prediction").alias("text"))).drop("text"), parents)
    unit = F.struct("kind", "number", "subs")
    wanted = gold.groupBy("id").agg(F.collect_set(unit).alias("units"), F.filter(F.collect_list("parent_ids"), lambda p: F.size(p) > 0).alias("sets"))
    given = said.groupBy("id").agg(F.collect_set(unit).alias("named"), F.flatten(F.collect_list("parent_ids")).alias("found"))
    joined = pairs.select("id").join(wanted, "id", "left").join(given, "id", "left")
    named, found = F.coalesce("named", F.array().cast(wanted.schema["units"].dataType)), F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "id",
        F.when(F.size("units") > 0, F.size(F.array_except("units", named)) == 0).alias("exact"),
        F.when(F.size("sets") > 0, F.forall("sets", lambda s: F.arrays_overlap(s, found))).alias("parent"),
    )
