import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from ionweave.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        found = sorted(str(x) for x in found - {None})
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = ["a", "b", "c", "Ä", "dé", "x9"]
    say = lambda n: r.choice([" ", ", "]).join(r.choice(words) for _ in range(n))
    items = [(k, say(r.choice([1, 3, 9, 10, 11, 30]))) for k in range(12)] + [(50, None), (51, ""), (52, "..."), (None, "zz yy xx"), (3, "q q q")]
    docs = [(k, " ".join([say(r.randrange(20)), r.choice(items)[1] or "", "other WORDS here", r.choice(items)[1] or "", say(r.randrange(9))])) for k in range(60)]
    return docs + [(60, None), (61, ""), (62, "zz YY xx"), (62, "zz YY xx"), (63, "a"), (64, "q Q q q")], items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, t, 1) for a, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return D.contamination(d, b, **kw)


def test_equals_brute_force(spark):
    for seed, window in ((1, 10), (2, 4)):
        docs, items = corpus(seed)
        got = run(spark, docs, items, window=window).drop("spans").collect()
        assert sorted(map(tuple, got)) == brute(docs, items, window)


def test_blocks_agree(spark):
    docs, items = corpus(3)
    docs = list(dict(docs).items())
    one, many = (sorted(map(tuple, run(spark, docs, items, block_windows=n).collect())) for n in (10**6, 20))
    assert one == many


def test_spans_cover_hit_words(spark):
    for r in run(spark, [(1, "Ä… one two THREE, four x")], [(1, "two three"), (2, "three four")]).collect():
        assert [("Ä… one two THREE, four x"[s.start : s.end]) for s in r.spans] == ["two THREE, four"]


def test_empty(spark):
    assert run(spark, [], [(1, "a")]).count() == 0
    assert run(spark, [(1, "a")], []).collect()[0].n_hit == 0


def test_index_finds_all_places():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 500)
    text[0] = 0
    index = D.FMIndex(text, 4)
    for n in (1, 2, 5):
        want = {}
        for k in range(len(text) - n + 1):
            want.setdefault(tuple(text[k : k + n].tolist()), []).append(k)
        for w, places in want.items():
            if 0 not in w:
                lo, hi = index.search(np.array([w]), np.array([n]))
                assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == places
    assert pa


def test_blocks_agree_on_rows(spark):
    docs, items = corpus(3)
    docs += [(None, t) for _, t in docs[:20]] + [(1, docs[2][1]), (1, "a"), (2, ""), (2, None), (5, docs[5][1])]
    one, many = (sorted(map(repr, run(spark, docs, items, block_windows=n).collect())) for n in (10**6, 20))
    assert one == many


def test_blocks_keep_items_with_commas(spark):
    d = spark.createDataFrame([(1, "p q r s t u")], "doc_id long, text string")
    b = spark.createDataFrame([("x,y", "p q r"), ("z", "s t u")], "item_id string, text string")
    one, many = (D.contamination(d, b, block_windows=n).collect() for n in (10**6, 2))
    assert one == many and one[0].n_items == 2


def test_clean_judges_each_row(spark):
    phrase = "one two three four five six seven eight nine ten"
    rows = [(1, f"a {phrase} b", "p"), (1, "x", "q"), (None, phrase.upper(), "r"), (None, "y", "s"), (2, None, "t"), (2, None, "t"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumn("row", D.F.lit(7)).withColumn("spans", D.F.lit("s"))
    bench = spark.createDataFrame([(1, phrase), (2, "other words that no text has at all"), (3, None)], "item_id long, text string")
    for n in (10**6, 5):
        out = D.clean(docs, bench, block_windows=n)
        assert out.columns == docs.columns
        assert sorted((r[0] or 0, r[1] or "", r[2] or "") for r in out.collect()) == [(0, "y", "s"), (1, "x", "q"), (2, "", "t"), (2, "", "t"), (3, "", "")]
