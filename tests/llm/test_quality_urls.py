import random
import re

import pytest

from ionweave.llm import quality, urls

ODD = [None, "", " \n ", "a", "ß# *a\n\nß# *a\n x\t", "a b c a b c d", "x y z " * 30, "line one\r\nline one\r\nline one", "word\n" * 80]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    rep = {k + i for k, w in enumerate(wins) if wins.count(w) > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


def texts():
    r = random.Random(5)
    vocab = ["alpha", "be", "gämma", "delta", "#x", "a*b", "of", "the", "to"] + [f"w{i}" for i in range(300)]
    out = list(ODD)
    for _ in range(150):
        out.append("\n".join(" ".join(r.choice(vocab) for _ in range(r.randrange(15))) for _ in range(r.randrange(12))))
    return out


def test_counts_equal_brute_force(spark):
    rows = [(k, t, r, s, 0) for k, t in enumerate(texts()) for r, s in [("en", "a") if k % 3 else (None, None)]]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int"), min_rows=10)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()}
    assert got == {k: brute(t) for k, t, *_ in rows}


def test_thresholds_adapt(spark):
    r = random.Random(1)
    say = lambda mark, n=90: " ".join(r.choice("abcdefgh") * 3 + r.choice("xyzuvw") * 2 + str(r.randrange(99)) + (mark if r.random() < 0.9 else "") for _ in range(n))
    rows = [(k, say(""), "en", "plain") for k in range(80)] + [(100 + k, say("||"), "en", "tables") for k in range(80)] + [(300, say("||"), "en", "plain"), (301, say("||"), "en", "tables"), (302, say("$$$$$"), "en", "tables"), (303, say(""), "xx", "rare")]
    kept = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [kept.pop(k) for k in (300, 301, 302, 303)] == [False, True, False, True] and all(kept.values())


def test_sketch_quantiles_and_merge(spark):
    rows = [(k, " ".join(["a" * (1 + (k * j) % 7) for j in range(60)]), "en", f"s{k % 4}") for k in range(200)]
    counts = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    merged = {(r.bucket): r.n for r in quality.sketches(counts).where("rate = 'word_length'").groupBy("bucket").agg(quality.F.sum("n").alias("n")).collect()}
    exact = sorted(sum(len(w) for w in t.split()) / 60 for _, t, *_ in rows)
    upto, median = 0, None
    for b in sorted(merged):
        upto += merged[b]
        median = b if median is None and upto >= 100 else median
    import math

    value = (math.exp(median * quality.GAMMA) * 2 / (1 + math.exp(quality.GAMMA)) - 1) / 1000
    assert value == pytest.approx(exact[99], rel=0.011)


def test_quality_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


URLS = [None, "", "nope", "://", "http://", "HTTP://A.Example.COM/en/7?x", "https://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://b.net/de/8", "http://example.net/de/8", "http://x.example.net?/de/8", "http://u@ÄB.org:80/es/é#f", "a://b://c/d"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in urls.filter_urls(df).collect():
        host, path, rule, verdict = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_model_parts_classes(spark):
    r = random.Random(2)
    rows = []
    for k in range(400):
        good = k % 2
        name = "".join(r.choice("aeiou" if good else "xqzwk") + r.choice("lmnrst") for _ in range(4))
        site = r.choice(["net/de/", "com/en/"] if k % 10 else ["info/"])
        site = ("net/de/" if good else "com/en/") if k % 10 else "info/"
        host, path = site.split("/", 1)
        rows.append((k, f"http://{name}.{host}/{path}{name}/{k}"))
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    assert len(out) == 40 and sum((x.verdict == "allow") == bool(x.page_id % 2) for x in out) >= 32
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_both_ways_score_alike(spark, monkeypatch):
    r = random.Random(8)
    rows = [(k, f"http://{''.join(r.choice('abcxyz') for _ in range(5))}.{r.choice(['net/de/', 'com/en/', 'info/', 'info'])}{r.choice(['é1', 'q', '', '1/2'])}") for k in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, "http://"), (902, "x://\U0001f600.info/a")], "page_id long, url string")
    sent = {x.page_id: x for x in urls.filter_urls(df).collect()}
    monkeypatch.setattr(urls, "MODEL_ROWS", -1)
    joined = {x.page_id: x for x in urls.filter_urls(df).collect()}
    assert len(sent) == len(joined) == 303
    for k, x in sent.items():
        assert x[:5] == joined[k][:5] and (x.score is None) == (joined[k].score is None) and x.score == pytest.approx(joined[k].score, abs=1e-9)
    assert len({x.score for x in sent.values()}) > 50


def test_probabilities_sum_to_one():
    m = urls.Model([("", "a", 3), ("", "b", 1), ("a", "b", 2), ("a", "a", 1)], 1)
    for c in ("", "a", "z"):
        assert sum(m.prob(c, x) for x in ("a", "b", "unseen")) == pytest.approx(1)
