"""Every operator against a plain version, an exact round trip or held-out accuracy, on a small table."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, html_text, language_model, line_dedup, media, packing, quality, registry, simhash, token_counts, toxicity
from lodestone.llm.common import table, tokenizer_path

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def rows(spark, name, folder=SMALL):
    return registry.QUERIES[name](spark, folder).collect()


def test_op1_articles(spark):
    pages = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    for r in rows(spark, "op1_html_extraction"):
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"<[^>]*(?:>|\Z)", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r.n_chars == len(r.text)


def test_op1_suffix_array_removes_what_a_host_repeats(spark):
    notice = " ".join(f"policy{i}" for i in range(20))
    own = [(i, f"http://a.example/{i}", f"<div>{notice}</div><div>{' '.join(f'w{i}x{k}' for k in range(20))}</div>") for i in range(4)]
    own += [(9, "http://b.example/1", f"<div>{notice}</div>"), (10, None, None), (11, "x", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()}
    assert all(got[i] == ' '.join(f'w{i}x{k}' for k in range(20)) for i in range(4))
    assert got[9] == notice and got[10] == got[11] == ""
    tokens = html_text.token_hashes([notice, notice], "h")
    rank = html_text.suffix_ranks(tokens, 8)
    assert rank[0] == rank[20] and len(set(rank[:13])) == 13


def test_op1_leaves_noise_out():
    page = (
        "<body class='has-sidebar'><header>Site</header><div id='cookieBanner'>ok</div><main><article><h1>T &amp; t</h1><p>One<b>two</b>\n three&nbsp;x<p>Next<script>if (1<2) '</p>'</script>"
        "<div class=\"share-buttons\">s</div><form>f</form><ul><li>a<li>b</ul><pre>p  q</pre><section class='comments'><article>hey</article></section></article><aside>rel</aside></main><footer>f</footer><p class"
    )
    assert html_text.split_page(page)[0] == "T & t\nOnetwo three x\nNext\na\nb\np q".split("\n")
    assert html_text.split_page("<div><a href=x>Home</a> <a href=y>About</a></div><div>text with <a>a link</a> in it</div><p><a>one link</a></p>") == (["text with a link in it", "one link"], [True, True])
    assert html_text.split_page("<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>x")[0] == ["x"]


@pytest.mark.parametrize(
    "inner, kept",
    [
        ('<h2 id="related-work">Related work</h2>', True),
        ('<section id="social-history"><p>t</p></section>', True),
        ('<p id="search-results-of-the-survey">t</p>', True),
        ('<div class="comment-free-zone">t</div>', True),
        ('<div class="elementor-widget">t</div>', True),
        ('<span id="menu">t</span>', True),
        ('<div class="related-posts">t</div>', False),
        ('<div class="post-comments">t</div>', False),
        ('<div id="adSlot">t</div>', False),
        ('<ul class="x share_buttons">t</ul>', False),
        ('<div role="note">t</div>', True),
    ],
)
def test_op1_names_are_evidence_only_if_they_say_nothing_else(inner, kept):
    texts, undecided = html_text.split_page(f"<article><p>start</p>{inner}<p>end</p></article>")
    assert texts[0] == "start" and texts[-1] == "end" and (len(texts) == 3) == kept and not any(undecided)


def test_op1_articles_long_and_short():
    page = "<main><h1>Page</h1><article><p>" + "long " * 400 + "</p></article><article>short but own</article><article><a href=x>Teaser of another page</a> more</article></main>"
    texts, undecided = html_text.split_page(page)
    assert texts == ["Page", ("long " * 400).strip(), "short but own"] and undecided == [True, False, False]
    assert html_text.split_page("<article><a>all</a></article>")[0] == ["all"]


def test_op1_noise_without_telling_names(spark):
    """Noise in plain div elements, in three short blocks with decided noise between them: only the suffix array can tell."""
    bar = [" ".join(f"b{k}{i}" for i in range(6)) for k in range(4)]
    noise = f"<div>{bar[0]}</div><nav>n</nav><div>{bar[1]}</div><div class=ad>a</div><div>{bar[2]}</div><div>{bar[3]}</div>"
    own = [(i, f"http://a.example/{i}", f"<div>{' '.join(f'w{i}x{k}' for k in range(40))}</div>{noise}") for i in range(3)]
    copied = "<div>" + " ".join(f"c{k}" for k in range(50)) + "</div>"
    own += [(10 + i, f"http://c.example/?p={i}", copied + f"<nav>{i}</nav>") for i in range(5)]  # copies of one page of a host
    own += [(20 + i, "http://d.example/", f"<main><article><p>art {i}</p></article><div>{' '.join(bar)}</div><div>{i} own</div></main>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert got[i] == " ".join(f"w{i}x{k}" for k in range(40))
        assert got[10 + i] == " ".join(f"c{k}" for k in range(50))
        assert got[20 + i] == f"art {i}\n{i} own"


def brute_force_uncovered(pages, depth=16, least=3):
    """For each (host, undecided blocks): tokens not in any window of depth tokens that stands on least different pages of the host."""
    holders = collections.defaultdict(set)
    for host, blocks in pages:
        w = " ".join(blocks).split()
        for i in range(len(w) - depth + 1):
            holders[host, tuple(w[i : i + depth])].add(tuple(blocks))
    out = []
    for host, blocks in pages:
        w = " ".join(blocks).split()
        gone = {j for i in range(len(w) - depth + 1) if len(holders[host, tuple(w[i : i + depth])]) >= least for j in range(i, i + depth)}
        at, texts = 0, []
        for b in blocks:
            n = len(b.split())
            texts.append(" ".join(w[j] for j in range(at, at + n) if j not in gone))
            at += n
        out.append("\n".join(t for t in texts if t))
    return out


def test_op1_suffix_array_brute_force(spark):
    r = np.random.default_rng(8)
    parts = [" ".join(f"p{k}t{i}" for i in range(int(r.integers(3, 30)))) for k in range(12)]
    pages = [(f"h{r.integers(2)}.example", [parts[k] for k in r.choice(12, int(r.integers(1, 5)))] + [f"u{j}"] * int(r.integers(0, 3))) for j in range(60)]
    pages += pages[:7]
    own = [(i, f"http://{h}/{i}", "".join(f"<div>{b}</div>" for b in blocks)) for i, (h, blocks) in enumerate(pages)]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(own, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(len(pages))] == brute_force_uncovered(pages)


def plain_fingerprint(text):
    import xxhash

    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_op2_components(spark, docs):
    fps = {k: plain_fingerprint(v) for k, v in docs.items()}
    root = components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for r in rows(spark, "op2_simhash_near_dedup"):
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", root[r.doc_id])


def test_op2_links_of_long_postings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    near = np.unique(np.concatenate([base, *(base[rng.integers(0, 40, 300)] ^ (1 << rng.integers(0, 62, 300)) ^ (1 << rng.integers(0, 62, 300)) for _ in range(3))]))
    root = components(near.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)
    for long in (1, 512):
        monkeypatch.setattr(simhash, "LONG_POSTING", long)
        i, j = simhash.links(near.view(np.uint64))
        assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a in range(len(near)) for b in range(a + 1, len(near)) if int(near[a] ^ near[b]).bit_count() <= 2}
    marked = spark.createDataFrame([(k, int(f)) for k, f in enumerate(near.tolist())], "doc_id long, fp long")
    from pyspark.sql import functions as F

    got = {r.fp: r.component for r in simhash.components(marked, F.min("fp")).collect()}
    assert got == root


def test_op3_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = sorted(c.execute(decontaminate.ORACLE).fetchall())
    assert sorted(map(tuple, rows(spark, "op3_benchmark_decontamination"))) == want and any(r[-1] for r in want)
    joined = decontaminate.contamination(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"), max_windows=1)
    assert sorted(map(tuple, joined.collect())) == want


def test_op3_spans(spark):
    item = "one two three four five six seven eight nine ten eleven"
    own = spark.createDataFrame([(1, f"Before, {item.upper()}! After."), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.without_hits(own, bench, whole=False).collect()}
    assert got == {1: "Before, After.", 2: "clean text"}
    assert [r.doc_id for r in decontaminate.without_hits(own, bench).collect()] == [2]


def test_op4_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in table(spark, MIDDLE, "labels").collect()}
    got = [(toxic[r.doc_id], r.predicted) for r in rows(spark, "op4_toxicity", MIDDLE) if r.held_out and r.doc_id in toxic]
    seen = collections.Counter(got)
    assert seen[0, 1] == 0 and seen[1, 1] >= 3 * seen[1, 0]


def toxic_score(weights, bias, text):
    raw = bias + sum(weights.get(w, 0.0) for w in toxicity.words(text.encode()))
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("follow_group", [True, False])
def test_op4_swapped_sentences_score_alike(spark, follow_group):
    """Labels that follow the group named, and labels that follow an insult: no sentence's score may move with the group it names."""
    texts, labels = [], []
    for i in range(240):
        w = ("muslims", "christians", "cats")[i % 3]
        rude = i % 4 == 3
        texts.append((i, f"those {w} are awful scum" if rude else f"those {w} are here for tea today"))
        labels.append((i, int(w == "muslims") if follow_group else int(rude or w == "muslims" and i % 8 == 0)))
    own = spark.createDataFrame(texts, "doc_id long, text string")
    weights, bias = toxicity.train(own, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for rest in ("those {} are here today", "{} met", "awful scum, the {} next door"):
        scores = [toxic_score(weights, bias, rest.format(w)) for w in ("muslims", "christians", "jews", "hindus", "atheists")]
        assert max(scores) - min(scores) < 0.02
    if not follow_group:
        assert toxic_score(weights, bias, "those jews are awful scum") > 0.7 > toxic_score(weights, bias, "those jews are here for tea today")


def test_op4_counterfactuals_recompute_all_features():
    plain = toxicity.plain_words(b"Muslims and musli, said the women")
    index = {w: i for i, w in enumerate(sorted(toxicity.words(b"muslims and musli said the women christians men girls")))}
    names = sorted(index)
    got = list(toxicity.counterfactuals(plain, index))
    want = []
    for group in toxicity.IDENTITIES:
        for a in group:
            if a.encode() in plain:
                for b in [*group, ""]:
                    if b != a and b.encode() not in plain:
                        x, y = toxicity.words(b"Muslims and musli, said the women"), toxicity.words(b"muslims and musli, said the women".replace(a.encode(), b.encode()))
                        want.append(sorted([index[w] + 1 for w in (x - y) & set(names)] + [-1 - index[w] for w in (y - x) & set(names)]))
    assert sorted(got) == sorted(want) and any(names.index(b"musli-") + 1 in c for c in got) is False and any(names.index(b"muslim-") + 1 in c for c in got)


def test_op4_fit_is_stationary():
    r = np.random.default_rng(3)
    x, y = (r.random((200, 12)) < 0.3).astype(np.float32), (r.random(200) < 0.4).astype(float)
    swaps, times = r.integers(-1, 2, (9, 12)).astype(np.int8), r.integers(1, 9, 9).astype(float)
    w, bias = toxicity.fit(x, y, swaps, times, 0.001, 5.0)
    at = np.append(w, bias)
    for k in range(13):
        step = np.eye(13)[k] * 1e-5
        slope = (toxicity.objective(at + step, x, y, swaps, times, 0.001, 5.0) - toxicity.objective(at - step, x, y, swaps, times, 0.001, 5.0)) / 2e-5
        assert abs(slope) < 1e-5


def plain_patience(a, b):
    """Pairs of places that a patience diff matches, by its textbook rule: equal ends, then the longest rising run of lines that occur once on both sides, and the same between them. None where that run is not the only one."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        rest = plain_patience(a[1:], b[1:])
        return None if rest is None else [(0, 0)] + [(i + 1, j + 1) for i, j in rest]
    if a[-1] == b[-1]:
        rest = plain_patience(a[:-1], b[:-1])
        return None if rest is None else rest + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(x), b.index(x)) for x in dict.fromkeys(a) if x and a.count(x) == b.count(x) == 1]
    runs = [[p] for p in once]
    for size in range(2, len(once) + 1):
        longer = [r + [p] for r in runs if len(r) == size - 1 for p in once if p[0] > r[-1][0] and p[1] > r[-1][1]]
        if not longer:
            break
        runs = longer
    if not once:
        return []
    if len(runs) > 1:
        return None
    out, x, y = [], 0, 0
    for i, j in [*runs[0], (len(a), len(b))]:
        rest = plain_patience(a[x:i], b[y:j])
        if rest is None:
            return None
        out += [(k + x, m + y) for k, m in rest] + ([(i, j)] if i < len(a) else [])
        x, y = i + 1, j + 1
    return out


def test_op5_patience_blocks_brute_force():
    r, compared = np.random.default_rng(4), 0
    for _ in range(6000):
        a, b = (r.integers(1, 9, r.integers(0, 8)).tolist() for _ in range(2))
        want = plain_patience(a, b)
        got = [(i + k, j + k) for i, j, n in line_dedup.patience_blocks(a, b) for k in range(n)]
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        compared += want is not None
        assert want is None or len(got) >= len(want)
    assert compared > 3000


def test_patience_blocks():
    assert line_dedup.patience_blocks([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1, 2)]
    assert line_dedup.patience_blocks([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert line_dedup.patience_blocks([5, 1, 5, 2], [1, 7, 2]) == [(1, 0, 1), (3, 2, 1)]
    assert line_dedup.patience_blocks([], [1]) == []


def test_op6_separates(spark):
    good = {r.doc_id: r.quality for r in table(spark, MIDDLE, "labels").collect()}
    seen = collections.Counter((good[r.doc_id], r.keep) for r in rows(spark, "op6_quality_classifier", MIDDLE) if r.doc_id in good)
    assert seen[1, False] <= 0.01 * seen[1, True] and seen[0, False] >= 0.9 * (seen[0, False] + seen[0, True])


def plain_kneser_ney(texts):
    """P(byte | three bytes before) as a function, by interpolated modified Kneser-Ney from plain counts."""
    lines = [b"\0\0\0" + quality.prepared(t).encode() + b"\0" for t in texts]
    counts = collections.Counter(x[i : i + 4] for x in lines for i in range(len(x) - 3))
    levels = {}
    for order in (4, 3, 2, 1):
        n = collections.Counter(min(c, 5) for c in counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in (1, 2, 3)]
        d = [x if 0 < x < k else quality.DISCOUNT for k, x in enumerate(d, 1)]
        total, freed = collections.Counter(), collections.Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        levels[order] = counts, d, total, freed
        counts = collections.Counter(g[1:] for g in counts)

    def p(gram, order=4):
        if not order:
            return 1 / 256
        counts, d, total, freed = levels[order]
        g = gram[4 - order :]
        if not total[g[:-1]]:
            return p(gram, order - 1)
        return (max(0, counts[g] - d[min(counts[g], 3) - 1]) if counts[g] else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * p(gram, order - 1)

    return p


def test_op6_plain_kneser_ney(spark, monkeypatch):
    """Perplexities in two scripts, over several blocks, shards and rounds, equal those of plain code; probabilities add up to one."""
    good = ["the cat sat on the mat and the dog", "das ist das Haus vom Nikolaus", "кошка сидела на окне и смотрела", "собака сидела на окне окне окне", "", "a dog on a mat"]
    asked = [*good, "zzz qqq \U0001f600", None, "the the the the", "кошка на мат", "x" * 50]
    for name, value in (("BLOCK", 300), ("TOGETHER", 2), ("SHARD", 40), ("CHUNK", 64)):
        monkeypatch.setattr(quality, name, value)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "ru") for i, t in enumerate(asked)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    p = plain_kneser_ney(good)
    logs = [[math.log10(p(x[i : i + 4])) for i in range(len(x) - 3)] for x in (b"\0\0\0" + quality.prepared(t or "").encode() + b"\0" for t in asked)]
    typical = sum(map(sum, logs[: len(good)])) / sum(map(len, logs[: len(good)]))
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    for i, x in enumerate(logs):
        assert math.isclose(got[i], 10 ** (-(sum(x) + quality.PRIOR * typical) / (len(x) + quality.PRIOR)), rel_tol=1e-6)
    assert math.isclose(sum(p(b"the" + bytes([c])) for c in range(256)), 1) and math.isclose(sum(p("ко".encode()[:3] + bytes([c])) for c in range(256)), 1)


def test_op7_counts(spark, docs, tokenizer):
    for r in rows(spark, "op7_token_counts"):
        n = len(tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def odd_texts():
    return ["<|endoftext|> x<|startoftext|>", "<|EndOfText|>", "it's IT'S don't, a., ,.", "ΣΑΣ İstanbul ﬁ ½ á ́x", "a\x1cb\x85c\xa0d e　f", "日本語 123 4", "x" * 3000, "!!, ...", "ÀÉß ÿ×÷", "\x00\x01 \x0b\x0c"]


def test_op7_op8_odd_texts(tokenizer):
    counter, ids = token_counts.counter(tokenizer_path("word_bpe_49k.json")), packing.ids_of(tokenizer_path("word_bpe_49k.json"))
    for text in odd_texts():
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert counter.count_batch([text.encode()]) == [len(want)], text
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want, text


def check_packing(got, ids):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[k]))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(map(len, ids.values())) and len(by_seq) > 0


def test_op8_pieces(spark, docs, tokenizer):
    check_packing(rows(spark, "op8_packing"), {k: tokenizer.encode(v, add_special_tokens=False).ids + [1] for k, v in docs.items()})


@pytest.mark.parametrize("segments,n", [(256, 5000), (7, 300), (100_000, 5000)])
def test_op8_short_documents(tokenizer, segments, n):
    """Documents of three tokens: hardly any padding, and the limit on segments holds in every sequence, the last ones too."""
    own, ids = packing.Sequences(5 << 40, 2048, segments), {k: [10 + k % 50, 11, 1] for k in range(n)}
    ids[n] = list(range(3000))
    rows = [r for k, v in ids.items() for r in own.add(k, np.array(v, "<u4").tobytes())] + list(own.pack(True))
    names = collections.namedtuple("Piece", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    rows = [names(*r) for r in rows]
    check_packing(rows, ids)
    assert max(collections.Counter(r.sequence_id for r in rows).values()) <= segments


def test_op7_op8_long_pieces(tokenizer):
    counter, ids = token_counts.TokenCounter(tokenizer_path("word_bpe_49k.json")), packing.Ids(tokenizer_path("word_bpe_49k.json"))
    for text in ("ab12cd-ef," * 4000, "x" * 5000, "don't" * 900 + ".", "é1" * 700, "日本" * 600 + " a", "q" * 65 + ",", "a" * 64 + "."):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert counter.count_batch([text.encode()]) == [len(want)], text[:20]
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want, text[:20]
    assert max(map(len, [*ids.memo, *counter.pieces, *counter.merged])) <= 64


def test_op8_examples_keep_all_limits(spark):
    rng = np.random.default_rng(3)
    own = [(i, int(n), int(n * rng.random())) for i, n in enumerate(rng.integers(1, 900, 500))]
    got = packing.pack_examples(spark.createDataFrame(own, "example_id long, n_tokens long, n_loss long"), (1000, 4, 600)).collect()
    assert sorted((r.example_id, r.n_tokens, r.n_loss) for r in got) == own
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.sequence_id].append(r)
    for g in groups.values():
        assert len(g) == 1 or sum(r.n_tokens for r in g) <= 1000 and len(g) <= 4 and sum(r.n_loss for r in g) <= 600
    assert len(groups) < 0.65 * len(own)


def test_op9_round_trip(spark, docs):
    for r in rows(spark, "op9_media_columns"):
        data = docs[r.doc_id].encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    stored = media.text_media(table(spark, SMALL, "documents").limit(20), "bmp", keep_media=True).collect()
    for r in stored:
        assert media.decode(r.media).tobytes().rstrip(b" ") == docs[r.doc_id].encode().rstrip(b" ") and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert np.load(__import__("io").BytesIO(r.tile)).shape == (16, 16, 3)


def test_op9_formats(spark):
    import struct

    assert media.decode(b"P1\n# c\n3 2\n0 1 0\n111\n").tolist() == [[255, 0, 255], [0, 0, 0]]
    assert media.decode(b"P2 2 1 10 0 10").tolist() == [[0, 255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b01000000, 0b11100000])).tolist() == [[255, 0, 255], [0, 0, 0]]
    assert media.decode(b"P5 2 1 255\n\x07\x08").tolist() == [[7, 8]]
    palette = struct.pack("<BBBBBBBB", 1, 2, 3, 0, 4, 5, 6, 0)
    one = b"BM" + struct.pack("<IHHI", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 3, 1, 1, 1, 0, 0, 0, 0, 2, 0) + palette + bytes([0b01000000, 0, 0, 0])
    assert media.decode(one).tolist() == [[[3, 2, 1], [6, 5, 4], [3, 2, 1]]]
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.area_resize(image, 3, 4), image.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(image, 1, 3).sum() / 3, image.mean())
    got = media.tiles(spark.createDataFrame([(1, bytearray(b"P5 2 1 255\n\x07\x08")), (2, bytearray(b"GIF")), (3, None)], "media_id long, data binary")).collect()
    assert [r.error is None for r in got] == [True, False, False]


def bmp(bits, w, h, rows, palette=b"", size=40, packed=0, colours=0, masks=b""):
    import struct

    head = struct.pack("<HHHH", w, h, 1, bits) if size == 12 else struct.pack("<iiHHIIiiII", w, h, 1, bits, packed, 0, 0, 0, colours, 0) + masks
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 18 + len(head) + len(palette)) + struct.pack("<I", size) + head + palette + rows


def test_op9_bmp_kinds():
    four = bytes([1, 2, 3, 0, 4, 5, 6, 0, 7, 8, 9, 0])
    assert media.decode(bmp(8, 2, 1, bytes([2, 0, 0, 0]), four, colours=3)).tolist() == [[[9, 8, 7], [3, 2, 1]]]
    assert media.decode(bmp(1, 2, 1, bytes([0b01000000, 0, 0, 0]), bytes([1, 2, 3, 4, 5, 6]), size=12)).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert media.decode(bmp(32, 1, 1, bytes([1, 2, 3, 4]))).tolist() == [[[3, 2, 1]]]
    masks = (0xFF).to_bytes(4, "little") + (0xFF00).to_bytes(4, "little") + (0xFF0000).to_bytes(4, "little")
    assert media.decode(bmp(32, 1, 1, bytes([1, 2, 3, 4]), packed=3, masks=masks)).tolist() == [[[1, 2, 3]]]
    assert media.decode(bmp(24, 1, -2, bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == [[[3, 2, 1]], [[6, 5, 4]]]


def test_op9_bad_images_are_errors(spark):
    four = bytes([1, 2, 3, 0, 4, 5, 6, 0])
    good = media.write_ppm(np.zeros((2, 3, 3), np.uint8)), media.write_bmp(np.zeros((2, 3, 3), np.uint8))
    bad = [b"", b"P", b"BM", b"P5 0 0 255\n", b"P5 0 1 255\n", b"P2 2 1 10 99 10", b"P2 2 1 10 -1 10", b"P2 2 1 10 x 1", b"P2 2 1 10 1", b"P5 2 1 9\n\x0a\x01", b"P1 2 1\n0 7", b"P5 2 1 300\n\0\0\0\0"]
    bad += [b"P6 99999 99999 255\n\0", b"P4 9 9\n\0", b"P7 1 1 1\n", bmp(8, 1, 1, bytes([9, 0, 0, 0]), four, colours=2), bmp(8, 1, 1, bytes(4), four, colours=300), bmp(16, 1, 1, bytes(4)), bmp(24, 0, 1, b""), bmp(24, 1, 9, bytes(4))]
    bad += [bmp(32, 1, 1, bytes(4), packed=3, masks=bytes(12)), bmp(24, 1, 1, bytes(4), packed=1), bmp(24, 1 << 30, 1 << 30, bytes(4)), bmp(24, 1, -(1 << 31), bytes(4))]
    bad += [g[:-1] for g in good] + [good[1][:k] for k in range(2, 54, 5)]
    for data in bad:
        with pytest.raises(ValueError):
            media.decode(data)
    r = np.random.default_rng(2)
    for g in (*good, bmp(8, 3, 2, bytes(8), four, colours=2), b"P3 1 1 7 1 2 3"):
        for _ in range(300):
            broken = bytearray(g)
            for at in r.integers(0, len(g), 3):
                broken[at] = r.integers(256)
            try:
                assert media.decode(bytes(broken)).size
            except ValueError:
                pass
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*bad, *good])], "media_id long, data binary")
    assert [r.error is None for r in media.tiles(rows).orderBy("media_id").collect()] == [False] * len(bad) + [True] * 2


def plain_scores(texts, train, strength, trust):
    """(tokens, known, base, score) of each text under the model of the module's docstring, from plain counts of all words."""
    words = {k: ["<s>", "<s>", *t.encode().lower().split(), None] for k, t in texts.items()}
    c1 = collections.Counter(w for k in train for w in words[k][2:])
    c2, c3 = collections.Counter(), collections.Counter()
    for k in train:
        c3.update(zip(words[k], words[k][1:], words[k][2:]))
        c2.update(zip(words[k], words[k][1:]))
    n, v = sum(c1.values()), len(c1)
    out = {}
    for k, line in words.items():
        score = 0.0
        for a, b, e in zip(line, line[1:], line[2:]):
            cb = len(train) if b == "<s>" else c1[b]
            p2 = (c2[b, e] + strength * (c1[e] + 1) / (n + v + 1)) / (cb + strength)
            prior = (cb + strength) / trust
            score += math.log10((c3[a, b, e] + prior * p2) / (c2[a, b] + prior))
        out[k] = len(line) - 2, sum(c1[w] > 0 for w in line[2:]), sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in line[2:]), score, n
    return out


@pytest.mark.parametrize("size, shards, near", [(130_000, None, 1.0), (2_000, 5, 0.95), (30, 3, 0.5)])
def test_op10_plain_counts(spark, docs, monkeypatch, size, shards, near):
    """Nearly all words met by hashes, or nearly all by ids: the same model of all words, but for the n-grams whose hashed words share a key."""
    fit, made = language_model.fitted, []
    monkeypatch.setattr(language_model, "fitted", lambda *x: made.append(fit(*x)) or made[0])
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = language_model.score_texts(table(spark, SMALL, "documents"), learn, size, shards).collect()
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    want = plain_scores(docs, train, *made[0])
    close = []
    for r in got:
        tokens, known, base, score, n = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=0.03), (r, score)
        close.append(math.isclose(r.score, score, rel_tol=5e-4))
    assert sum(close) >= near * len(close) and sum(r.score > r.base_score for r in got) > 0.8 * len(got)


def test_op10_fit_is_left_one_out(spark):
    """The sums over shards are the likelihoods of plain code, and the greatest of them is taken."""
    texts = ["a b c a b d", "a b c", "x y z", "a b d e", "", "x y"] * 3
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    words = language_model.word_counts(frame)
    own, _ = language_model.common_words(words, len(texts), 3)
    known = spark.sparkContext.broadcast(own)
    grams = language_model.gram_counts(frame, known, [0, 1, 2])
    lines = [["<s>", "<s>", *t.split(), None] for t in texts]
    c1 = collections.Counter(w for x in lines for w in x[2:])
    c1["<s>"] = len(texts)
    c2, c3 = collections.Counter(g for x in lines for g in zip(x, x[1:])), collections.Counter(g for x in lines for g in zip(x, x[1:], x[2:]))
    p = lambda w: (c1[w] + 1) / (own.tokens + own.types + 1)

    def bigram(a):
        return sum(math.log((c2[v, w] - 1 + a * p(w)) / (c1[v] - 1 + a)) for x in lines for v, w in zip(x[1:], x[2:]))

    def trigram(a, k):
        return sum(math.log((k * (c3[u, v, w] - 1) + c2[v, w] - 1 + a * p(w)) / (k * (c2[u, v] - 1) + c1[v] - 1 + a)) for x in lines for u, v, w in zip(x, x[1:], x[2:]))

    a, k = language_model.fitted(grams, words, known, len(texts))
    assert a == max(language_model.STRENGTHS, key=bigram) and k == max(language_model.TRUSTS, key=lambda t: trigram(a, t))


def test_op10_keys_tell_ngrams_apart():
    r = np.random.default_rng(1)
    codes = np.concatenate([r.integers(3, 40, 3000), r.integers(1 << 20, 1 << 62, 3000), -r.integers(1 << 20, 1 << 62, 3000)])
    texts = [r.choice(codes, 900) for _ in range(40)]
    keys, shard, number = language_model.gram_keys(texts, 7)
    lines = [[1, 1, *t.tolist(), 2] for t in texts]
    grams = [(i, g) for i, x in enumerate(lines) for g in zip(x, x[1:], x[2:])]
    assert number.tolist() == [i for i, _ in grams]
    assert len(np.unique(keys)) >= len({g for _, g in grams}) - 5
    by_pair = {}
    for s, (_, g) in zip(shard.tolist(), grams):
        assert by_pair.setdefault(g[1:], s) == s and (g[2] >> language_model.WORD_BITS == 0 or s == g[2] % 7)


def test_order_of():
    r = np.random.default_rng(0)
    keys = np.concatenate([r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), r.integers(0, 9, 500).astype(np.uint64) << np.uint64(33)])
    assert (language_model.order_of(keys) == np.argsort(keys, kind="stable")).all()


def test_elias_fano():
    from lodestone.llm.elias_fano import BEFORE_BITS, Sequence, Trie, encode

    r = np.random.default_rng(0)
    for universe in (1, 50, 1 << 40):
        values = np.sort(r.integers(0, universe, 700))
        own = Sequence(np.frombuffer(encode(values, universe), np.uint8))
        assert (own[np.arange(700)] == values).all()
        asked, first = r.integers(0, universe, 900), r.integers(0, 701, 900)
        stop = np.minimum(700, first + r.integers(0, 200, 900))
        at, held = own.find(first, stop, asked)
        want = np.clip(np.searchsorted(values, asked), first, stop)
        assert held.tolist() == [w < e and values[w] == a for w, e, a in zip(want, stop, asked)] and (at[held] == want[held]).all()
    keys = np.unique(r.integers(0, 40, (900, 2)).astype(np.uint64) @ np.array([1 << BEFORE_BITS, 1], np.uint64))
    pairs, third = np.unique(keys >> np.uint64(BEFORE_BITS)), r.random(len(keys))
    data = Trie.build(keys, pairs % np.uint64(7) * 1.0, third)
    asked = np.unique(np.concatenate([keys, r.integers(0, 45, (900, 2)).astype(np.uint64) @ np.array([1 << BEFORE_BITS, 1], np.uint64)]))
    weight = dict(zip(pairs.tolist(), (pairs % np.uint64(7)).tolist()))
    want = [weight.get(k >> BEFORE_BITS, 0.0) + (third[np.searchsorted(keys, k)] if k in keys else 0.0) for k in asked.tolist()]
    assert np.allclose(Trie(data).weights(asked), want, atol=1e-3)
    many = np.unique(r.integers(0, 1 << 62, 100_000).astype(np.uint64))
    assert len(Trie.build(many, np.zeros(len(np.unique(many >> np.uint64(BEFORE_BITS)))), np.zeros(len(many)))) < 16 * len(many)


def test_pipeline_stages(spark, docs, tokenizer):
    source = table(spark, SMALL, "documents")
    kept = quality.kept(source, table(spark, SMALL, "labels"))
    decided = {r.doc_id: r.keep for r in registry.QUERIES["op6_quality_classifier"](spark, SMALL).collect()}
    first = {r.doc_id: r for r in kept.collect()}
    assert first.keys() == {k for k, keep in decided.items() if keep} and kept.columns == source.columns
    lines = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, kept, SMALL).collect()}
    plain = {r.row.doc_id: r.text for r in line_dedup.dedup(kept).collect()}
    assert lines == {k: t for k, t in plain.items() if t.strip() or t == first[k].text}
    frame = spark.createDataFrame([(k, t, "x", "y", len(t)) for k, t in lines.items()], source.schema)
    fps = {k: plain_fingerprint(t) for k, t in lines.items()}
    root = components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    near = {r.doc_id: r.text for r in corpus_pipeline.near_stage(spark, frame, SMALL).collect()}
    assert near.keys() == set(root.values())
    hit = {r.doc_id for r in decontaminate.contamination(frame, table(spark, SMALL, "benchmark")).collect() if r.contaminated}
    clean = {r.doc_id for r in corpus_pipeline.benchmark_stage(spark, frame, SMALL).collect()}
    assert clean == lines.keys() - hit
    last = {k: near[k] for k in near.keys() & clean}
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), {k: tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in last.items()})
