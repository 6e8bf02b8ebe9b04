import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ionweave.llm import neardup as N


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_alignment_equals_full():
    r = random.Random(0)
    for _ in range(3000):
        a = [r.randrange(4) for _ in range(r.randrange(14))]
        b = [r.randrange(4) for _ in range(r.randrange(14))] if r.random() < 0.5 else [x for x in a for _ in range(r.choice([0, 1, 1, 1, 2]))]
        d = levenshtein(a, b)
        for most in (0, 1, 2, 5, 20):
            assert N.edit_distance(a, b, most) == (d if d <= most else min(most, max(len(a), len(b))) + 1) or d > most < N.edit_distance(a, b, most)


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    rows, families = [], []
    common = say(60)
    for f in range(25):
        base = say(r.choice([40, 120, 900])) if f else say(3000)
        family = []
        for k in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(max(1, len(t) // 120) if k else 0):
                p = r.randrange(len(t))
                t[p : p + 1] = r.choice([[], ["new"], [t[p], "more"]])
            family.append(len(rows))
            rows.append((len(rows), " ".join(t)))
        families.append(family)
    for _ in range(30):  # a shared passage doesn't make duplicates
        rows.append((len(rows), " ".join(say(50) + common + say(50))))
    base = say(80)
    for k in range(120):  # many copies
        rows.append((len(rows), ", ".join(base).upper() if k % 2 else " ".join(base)))
    odd = [None, "", "...", "a b", "A, b", "a b c", None, ""]
    rows += [(len(rows) + k, t) for k, t in enumerate(odd)]
    return rows


def alike(a, b):
    """Edit similarity of 0.8 or more, by the full table; lengths and common words first, since they can only rule out."""
    n = max(len(a), len(b))
    most = n // 5
    if n - min(len(a), len(b)) > most or n - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return levenshtein(a, b) <= most


def brute(rows):
    words = {d: N.words_of(*N.text_buffers(N.pa.array([t])), N.ALNUM, True).hash.tolist() for d, t in rows}
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [d for d, _ in rows if words[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            long = min(len(words[a]), len(words[b])) >= N.SHINGLE
            if root(a) != root(b) and (words[a] == words[b] or long and alike(words[a], words[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d, _ in rows}


def test_bounds_are_bounds():
    r = random.Random(2)
    for _ in range(2000):
        a = np.array([r.randrange(6) for _ in range(r.randrange(1, 14))], np.uint32)
        b = np.array([r.randrange(6) for _ in range(r.randrange(1, 14))], np.uint32)
        assert N.least_distance(a, b) <= levenshtein(a.tolist(), b.tolist())


def test_block_links_join_what_brute_force_joins():
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = [r.randrange(400) for _ in range(r.choice([20, 60, 300]))]
        for _ in range(6):
            texts.append(np.array([x for x in base for _ in range(r.choice([0, *[1] * 12, 2]))], np.uint32))
    known = np.array([0 if k < 12 else k for k in range(len(texts))])
    for left in (None, np.array([k % 3 == 0 for k in range(len(texts))])):
        up = list(known)
        root = lambda x: x if up[x] == x else root(up[x])
        links = N.block_links(7, texts, np.full((len(texts), 2), 7), known, left)
        assert all(alike(texts[i].tolist(), texts[j].tolist()) and (left is None or left[i] != left[j]) for i, j in links)
        for i, j in links:
            assert root(i) != root(j)
            up[root(i)] = root(j)
        for i in range(len(texts)):
            for j in range(i):
                if (left is None or left[i] != left[j]) and alike(texts[i].tolist(), texts[j].tolist()):
                    assert root(i) == root(j)
    # A pair of an earlier bucket isn't tried here.
    assert N.block_links(7, texts[:6], np.tile([5, 7], (6, 1)), np.arange(6), None) == []


def test_classes_equal_brute_force(spark):
    rows = corpus()
    out = N.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out} == brute(rows)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.class_id] += 1
    assert all(r.class_size == sizes[r.class_id] for r in out)


def test_recall_against_all_pairs(spark):
    """Texts with an id divisible by 20 against all rows: the links that brute force finds and that share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    words = {r.doc_id: hashes(r.text or "").tolist() for r in docs.select("doc_id", "text").collect()}
    pairs = [(a, b) for a in words if a % 20 == 0 and words[a] for b in words if a != b and words[b] and (words[a] == words[b] or alike(words[a], words[b]))]
    assert len(pairs) > 5 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_order_matters():
    words = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    same = (N.order_minhash(words) == N.order_minhash(words)).mean()
    moved = (N.order_minhash(words) == N.order_minhash(np.concatenate([words[200:], words[:200]]))).mean()
    assert same == 1 and moved < 0.6


def test_repeated_and_empty(spark):
    kind = "doc_id long, text string"
    text = " ".join(f"w{i}" for i in range(30))
    out = N.near_duplicates(spark.createDataFrame([(1, text), (1, text), (None, text), (5, text + " x")], kind)).collect()
    assert [r.class_id for r in out] == [1] * 4
    assert N.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(bytes([a // 9, a % 9]), bytes([b // 9, b % 9])) for a, b in [(r.randrange(80), r.randrange(80)) for _ in range(50)]] + [(bytes([9, k]), bytes([9, k + 1])) for k in range(40)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {bytes(x.node): bytes(x.root) for x in N.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "u binary, v binary")).collect()}
    assert all(got.get(x, x) == min(y for y in up if find(y) == find(x)) for x in up)


def star(r, copies, changed=12):
    """A text of 100 words and copies of it, each with ``changed`` words in a row elsewhere: similar to it, not to each other."""
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(100)]
    texts = [base]
    for _ in range(copies):
        t, p = list(base), r.randrange(100 - changed)
        t[p : p + changed] = [f"x{r.randrange(10**9)}" for _ in range(changed)]
        texts.append(t)
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    return texts


def hashes(text):
    return N.words_of(*N.text_buffers(N.pa.array([text])), N.ALNUM, True).hash


def met_classes(texts):
    """Classes by every pair of texts that share a bucket, without hubs or bounds."""
    words = [hashes(t) for t in texts]
    buckets = defaultdict(list)
    for i, w in enumerate(words):
        for k in set(N.order_minhash(w).tolist()):
            buckets[k].append(i)
    up, seen = list(range(len(texts))), set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for own in buckets.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a, b) not in seen and root(a) != root(b) and alike(words[a].tolist(), words[b].tolist()):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
                seen.add((a, b))
    return [root(i) for i in range(len(texts))]


def classes(spark, texts):
    out = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [c for _, c in sorted((x.doc_id, x.class_id) for x in out)]


def test_stars_are_one_class(spark):
    r = random.Random(6)
    families = [star(r, n) for n in (30, 300, 1000)]
    got = classes(spark, [t for f in families for t in f])
    at = 0
    for f in families:
        own = got[at : at + len(f)]
        assert len(set(own)) <= 1 + len(f) // 100, (len(f), len(set(own)))
        at += len(f)


@pytest.mark.parametrize("block", [7, 1024])
def test_buckets_without_one_centre(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(7)
    texts = []
    for _ in range(3):  # chains: each text is like its neighbours only
        t = [f"w{r.randrange(5000)}" for _ in range(100)]
        for k in range(8):
            texts.append(" ".join(t))
            t = list(t)
            t[12 * k : 12 * k + 14] = [f"x{r.randrange(10**9)}" for _ in range(14)]
    base = [f"v{r.randrange(5000)}" for _ in range(100)]
    for _ in range(40):  # copies of a text that isn't there, some pairs alike
        t, p = list(base), r.randrange(85)
        t[p : p + 15] = [f"x{r.randrange(10**9)}" for _ in range(15)]
        texts.append(" ".join(t))
    passage = [f"p{r.randrange(5000)}" for _ in range(80)]
    for _ in range(60):  # half a text in common, and not alike
        texts.append(" ".join([*passage, *(f"y{r.randrange(10**9)}" for _ in range(r.randrange(70, 100)))]))
    r.shuffle(texts)
    assert classes(spark, texts) == met_classes(texts)


def test_representatives_keep_one_row_a_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    rows = [(1, a, "p"), (5, b, "q"), (5, near, "r"), (9, b.upper(), "s"), (3, c, "t"), (3, c, "u"), (None, a, "v"), (None, "x y z", "w"), (None, "x y z", "x"), (7, None, "y"), (7, None, "y"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumn("row", N.F.lit(1)).withColumn("node", N.F.lit("n"))
    out = N.representatives(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "", r["a.b"]) for r in out.collect())
    assert [(d, t) for d, t, _ in got] == sorted([(1, a), (5, b), (3, c), (0, "x y z"), (7, ""), (7, ""), (0, "")])
    assert N.representatives(df.where("doc_id = 99")).count() == 0
