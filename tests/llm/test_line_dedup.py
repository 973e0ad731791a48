"""Line dedup against a brute force that aligns every document with every earlier one."""

import random

from lodestone.llm import line_dedup

A, B, C = (f"line {x} that is well over forty characters long" for x in "abc")


def brute(texts):
    """The lines left of each text, all pairs aligned."""
    lines = [[x.strip(" ") for x in t.split("\n")] for t in texts]
    out = []
    for k, mine in enumerate(lines):
        gone = set()
        for other in lines[:k]:
            for _, j, n in line_dedup.patience_blocks([hash(x) if x else 0 for x in other], [hash(x) if x else 0 for x in mine]):
                gone |= set(range(j, j + n)) if sum(map(len, mine[j : j + n])) >= 40 else set()
        out.append("\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone))
    return out


def deduplicated(spark, texts):
    rows = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.row.doc_id)]


def test_lines_that_the_owner_cannot_align(spark):
    texts = [f"1\n{A}\n1a\n{B}\n1b", f"2\n{A}\n2a\n{A}\n2b\n{C}", f"3\n{B}\n3a\n{C}\n3b\n{A}", f"4\n{B}\n4a\n{A}\n4b", f"5\n{B}\n5a\n{B}\n5b\n{A}\n5c", f"6\n{A}\n6a\n{A}\n6b"]
    want = brute(texts)
    assert want[3] == "4\n4a\n4b" and A in want[1]
    assert deduplicated(spark, texts) == want


def test_many_holders(spark):
    rng = random.Random(5)
    pool = [f"{c} is a line of more than forty characters here" for c in "abcdefgh"]
    texts = ["\n".join(x for k in range(rng.randrange(1, 6)) for x in (f"own {i} {k}", rng.choice(pool))) for i in range(60)]
    assert deduplicated(spark, texts) == brute(texts)


def test_documents_that_share_short_lines_only(spark):
    verse = "roses are red\nviolets are blue\nsugar is sweet\nand so are you"
    texts = [f"first\n{verse}\nlast", verse, f"other\n{verse}", "roses are red\nviolets are blue", "sugar is sweet\n\n\nand so are you\nviolets are blue\nnew"]
    want = brute(texts)
    assert want[1] == "" and want[2] == "other" and want[3] == texts[3]
    assert deduplicated(spark, texts) == want


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text or "" for r in sorted(rows, key=lambda r: r.doc_id)]
    assert deduplicated(spark, texts) == brute(texts)


def test_short_runs(spark):
    rng = random.Random(6)
    pool = ["", " ", *(w * 5 for w in ("a b", "cd", "efg ", "hijkl", "m n o p q", "rstuvwxyz"))]
    texts = ["\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randrange(1, 14))) for i in range(80)]
    assert deduplicated(spark, texts) == brute(texts)
