"""Thresholds of languages with few trusted documents."""

import numpy as np

from lodestone.llm import quality


def limits(spark, n):
    """Thresholds where de has n trusted documents around 8 and en 400 around 20."""
    rows = [(i, "en", 20 + i % 7 / 10) for i in range(400)] + [(1000 + i, "de", 8 + i % 7 / 10) for i in range(n)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double")
    return {r.lang: r.threshold for r in quality.thresholds(scored, scored.selectExpr("doc_id", "1 AS quality")).collect()}


def test_a_languages_own_quantile_counts_from_its_first_document(spark):
    one, few, below, at, many = (limits(spark, n) for n in (1, 20, 99, 100, 2000))
    assert 1.05 * 8 < few["de"] < one["de"] < one[None]
    assert abs(below["de"] - at["de"]) < 0.1
    assert abs(many["de"] - 1.05 * 8.6) < 0.7
    assert limits(spark, 0).keys() == {"en", None}


def test_look_ups():
    r = np.random.default_rng(0)
    for n in (1, 5, 3000, 100_000):
        line = np.concatenate([r.integers(0, 1 << 32, n), r.integers(0, 9, 9)]).astype(np.uint32)
        keys = quality.distinct(line)
        assert (keys == np.unique(line)).all()
        values = r.random(len(keys))
        assert (quality.looked_up(keys, values, line) == values[np.searchsorted(keys, line)]).all()
