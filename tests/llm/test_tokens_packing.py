import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ionweave.llm import packing, separators
from ionweave.llm.tokens import encoder, merges_agree, vocabulary_path

ODD = [None, "", " ", "\n", "a  b", "  x", "x ", "a\n b. c", "it's 12,5 …  \n\n z", "<|endoftext|> hi", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "x <|endoftext", "é,. ü., 3. a..", "x y z", "don't'll a'b 'c d'é'", "a\r\nb\nc\n\nd", "“q” it’s—ok. a,b.c;(d)[e]! f'", "word " * 3000, "x" * 5000]


def exact(text, special=True):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = not special
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def ids_of(texts, same=True, special=True):
    return [ids[o[k] : o[k + 1]].tolist() for ids, o, i, j in encoder(vocabulary_path(), same, special).encode(pa.array(texts, pa.string())) for k in range(j - i)]


def test_ids_equal_tokenizers():
    assert merges_agree(vocabulary_path())
    assert exact("a <|endoftext|> b") == [64, 220, 50256, 275]
    for special in (True, False):
        for same in (True, False):
            assert ids_of(ODD, same, special) == [exact(t, special) for t in ODD]


def test_every_code_point_equals_tokenizers():
    """The two libraries' tables of letters, numbers and white space could differ."""
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 {c}" for c in signs[k : k + 500]) for k in range(0, 0x3400, 500)]
    assert ids_of(texts) == [exact(t) for t in texts]


def test_merges_that_disagree(tmp_path):
    import json

    with open(vocabulary_path()) as f:
        model = json.load(f)
    model["model"]["merges"][10:12] = model["model"]["merges"][11:9:-1]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(model))
    assert not merges_agree(str(other))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, length int")


def test_pack_round_trip(spark):
    out = packing.pack(docs(spark, ODD * 3), capacity=256).collect()
    at, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        at[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(at) == 3 * len(ODD)
    for d, pieces in at.items():
        ids = np.array([*exact((ODD * 3)[d]), 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 256 for p in pieces[1:]) and pieces[0].start == 0
        assert all(a.start + a.length == b.start for a, b in zip(pieces, pieces[1:])) and pieces[-1].start + pieces[-1].length == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256


def test_plan_is_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 101, 12)}
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [k for k, room in enumerate(bins) if room >= length]
                k = min(fit, key=lambda k: bins[k]) if fit else len(bins)
                bins.append(100) if not fit else None
                bins[k] -= length
        runs = packing.plan(counts, 100)
        used, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in runs:
            ranks[length] += range(rank, rank + n)
            for k in range(n):
                used[first + k].append((offset, length))
        assert {k: len(v) for k, v in ranks.items()} == counts and all(sorted(v) == list(range(len(v))) for v in ranks.values())
        for v in used.values():
            assert all(a + la == b for (a, la), (b, _) in zip(sorted(v), sorted(v)[1:])) and sum(x for _, x in v) <= 100
        assert len(used) == len(bins)


def test_pack_empty(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_pack_ranks_common_lengths_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    monkeypatch.setattr(packing, "SLOT_ROWS", 4)
    rows = packing.pack(docs(spark, ["a b"] * 50 + ["c"] * 7 + ["a b c d"] * 11), capacity=8).collect()
    assert len(rows) == 68 and len({(r.sequence_id, r.offset) for r in rows}) == 68
    sums = defaultdict(int)
    for r in rows:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 8 and len(sums) == 31  # 11 of 5 and 3, 19 of 3 and 3 (2 in 7 of their rooms), one more


def test_separator_counts(spark):
    out = {r.doc_id: r.n_tokens for r in separators.document_tokens(docs(spark, ODD), block_ids=64).collect()}
    assert out == {k: len(exact(t, False)) for k, t in enumerate(ODD)}
    assert separators.document_tokens(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in separators.document_tokens(same).collect()) == [(0, 2), (0, 2), (3, 2)]


@pytest.mark.parametrize("by_range", [True, False])
def test_separator_scan_of_files(spark, tmp_path, monkeypatch, by_range):
    monkeypatch.setattr(separators, "reachable", lambda path: by_range)
    rng = np.random.default_rng(0)
    want = {}
    for name in "abc":
        ids = rng.integers(0, 9, 1000).astype("<u2")
        ids[rng.integers(0, 1000, {"a": 5, "b": 300, "c": 0}[name])] = 9
        ids.tofile(tmp_path / name)
        ends = np.flatnonzero(ids == 9)
        starts = np.concatenate([[0], ends + 1])
        want[name] = [(int(a), int(b - a), False) for a, b in zip(starts, ends)] + ([(int(starts[-1]), 1000 - int(starts[-1]), True)] if starts[-1] < 1000 else [])
    (tmp_path / "empty").touch()
    got = defaultdict(list)
    for r in separators.count_documents(separators.flat_blocks(spark, str(tmp_path), 37), 9, 37).collect():
        got[r.file].append((r.doc_no, (r.start, r.n_tokens, r.open)))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == want
