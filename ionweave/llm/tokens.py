"""Token ids of a public byte-level BPE vocabulary through a bounded table of pieces, vectorised over Arrow buffers.

The ids are those of ``tokenizers`` for the vocabulary file without special tokens added. Where a text itself holds the
string of a special token, that is the token, as the library has it by default, or with ``special=False`` ordinary text. The vocabulary's pattern always starts a new word at a space between non-spaces, at a sign after an ASCII letter or
digit, at an ASCII letter or digit after a sign other than an apostrophe, and at a line end after a non-space. Texts
are cut there; the ids of the pieces don't depend on each other, so each distinct piece (by 64-bit hash) is encoded
once and kept in flat arrays. Texts with a space beside other white space, with non-ASCII white space or with a special token are encoded whole.
Missing pieces go through ``tiktoken`` with the same merges, which takes a third of the time, where ``merges_agree``
has shown on the driver that its order by rank and the file's merges are the same for every text; else through ``tokenizers``.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa

from ionweave.llm.common import chunks, hash_spans, text_buffers

#: Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps; about 40 bytes each.
CACHE, CHUNK = 800_000, 2 << 20
_ASCII = np.arange(256) < 128
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), *range(28, 33)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
SIGN = _ASCII & ~SPACE & ~LETTER & (np.arange(256) > 32) & (np.arange(256) < 127)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space beyond ASCII in UTF-8."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(at):
        return at
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[wide]


def _ranks(model: dict) -> dict[bytes, int]:
    letters = _byte_letters()
    special = {x["content"] for x in model.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


@functools.lru_cache(maxsize=4)
def merges_agree(path: str) -> bool:
    """Whether merging the pair of least rank, as ``tiktoken`` does, is the same as the file's list of merges.

    It is if the merges' results have rising ids, and the last step that makes each token of its bytes joins just the pair
    that the list has for it: what happens within a token's bytes doesn't depend on what stands around them.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    own = model["model"]
    if own["type"] != "BPE" or own.get("dropout") or own.get("ignore_merges") or own.get("unk_token") or (model.get("normalizer"), (model.get("pre_tokenizer") or {}).get("type")) != (None, "ByteLevel") or model["pre_tokenizer"].get("add_prefix_space"):
        return False
    ranks, letters = _ranks(model), _byte_letters()
    last = -1
    made = set()
    for merge in own["merges"]:
        a, b = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        rank = ranks.get(a + b, -1)
        if rank <= last:
            return False
        last = rank
        made.add(rank)
        parts = [bytes([x]) for x in a + b]
        while len(parts) > 2:
            best = min((ranks.get(x + y, rank), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if parts != [a, b]:
            return False
    return all(len(t) == 1 or r in made for t, r in ranks.items()) and all(bytes([x]) in ranks for x in range(256))


class Encoder:
    """Texts to unsigned 32-bit ids. ``path``: a tokenizers JSON file of a byte-level BPE; ``same``: ``merges_agree(path)``."""

    def __init__(self, path: str, same: bool, special: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        self._load = functools.partial(Tokenizer.from_file, path)
        self.exact, self.same = None, same
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ranks = _ranks(model)
        added = model.get("added_tokens", []) if special else []
        self.special = {x["content"]: x["id"] for x in added}
        # Those that take the white space beside them, or whole words only, are left to the library.
        self.plain = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def exactly(self, texts: list[str]) -> list[list[int]]:
        if self.exact is None:
            self.exact = self._load()
            self.exact.encode_special_tokens = not self.special
        return [e.ids for e in self.exact.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts without special tokens."""
        return [self.fast.encode_ordinary(t) for t in texts] if self.same else self.exactly(texts)

    def whole(self, texts: list[str]) -> list[list[int]]:
        if not self.same or not self.plain:
            return self.exactly(texts)
        if self.parts is None:
            return self.ids(texts)
        return [[i for k, part in enumerate(self.parts.split(t)) for i in ([self.special[part]] if k % 2 else self.fast.encode_ordinary(part))] for t in texts]

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """keys: sorted and new. Pieces that start with a space are encoded as one text and told apart by their bytes."""
        spaced = np.fromiter((t[0] == 32 and len(t) > 1 for t in texts), bool, len(texts))
        joined = [t for t, x in zip(texts, spaced) if x]
        single = [t for t, x in zip(texts, spaced) if not x]
        flat = np.array(self.ids([b"".join(joined).decode()])[0], np.int64) if joined else np.zeros(0, np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[flat]), np.cumsum([len(t) for t in joined]) if joined else np.zeros(0)) + 1
        rest = self.ids([t.decode() for t in single])
        lengths = np.zeros(len(texts), np.int64)
        lengths[spaced] = np.diff(ends, prepend=0)
        lengths[~spaced] = [len(x) for x in rest]
        new = np.zeros(int(lengths.sum()), np.uint32)
        here = np.repeat(spaced, lengths)
        new[here] = flat
        new[~here] = [i for x in rest for i in x]
        slots = len(self.first) - 1 + np.arange(len(texts))
        self.pool = np.concatenate([self.pool, new])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    def encode(self, column: pa.Array):
        """(ids, offsets, first document, end) for runs of documents; a null has none. Memory follows a run of CHUNK bytes."""
        data, offsets = text_buffers(column)
        for i, j in chunks(offsets, CHUNK):
            yield *self._run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i, j

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, docs = len(data), len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
        if len(self.keys) > CACHE:
            self._clear()
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        begin, last = offsets[full], offsets[full + 1] - 1
        space, letter, sign = SPACE[data], LETTER[data], SIGN[data]
        odd = np.zeros(docs, bool)
        odd[full] = space[begin] | space[last]
        beside = np.flatnonzero(space[1:] & space[:-1] & ((data[1:] == 32) | (data[:-1] == 32))) + 1
        for at in (beside, _wide_space(data)):
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
        raw = data.tobytes() if self.special else b""
        for name in self.special:
            at, sign_bytes = -1, name.encode()
            while (at := raw.find(sign_bytes, at + 1)) >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
        cut = data == 32
        cut[1:] |= sign[1:] & letter[:-1] | letter[1:] & sign[:-1] & (data[:-1] != 39) | (data[1:] == 10) & ~space[:-1]
        cut[begin] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if odd.any():  # one piece for the whole text, not kept
            own = odd[np.searchsorted(offsets, start, side="right") - 1]
            start, end = start[~own], end[~own]
        key, inverse = np.unique(hash_spans(data, start, end), return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == key[at < len(self.keys)]
        if not known.all():
            sample = np.zeros(len(key), np.int64)
            sample[inverse] = np.arange(len(start))
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(key[new], [raw[a:b] for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
            at = np.searchsorted(self.keys, key)
        slot = self.slot[at][inverse]
        lengths = self.first[slot + 1] - self.first[slot]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.first[slot] - before[:-1], lengths) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.uint32)
        bounds = before[np.searchsorted(start, offsets)]
        if not odd.any():
            return ids, bounds
        which = np.flatnonzero(odd)
        raw = data.tobytes()
        whole = self.whole([raw[offsets[d] : offsets[d + 1]].decode() for d in which])
        parts, sizes, at = [], np.diff(bounds), 0
        for d, own in zip(which.tolist(), whole):
            parts += [ids[at : bounds[d]], np.array(own, np.uint32)]
            at, sizes[d] = bounds[d], len(own)
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(sizes)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, same: bool, special: bool = True) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (path, same, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, same, special)
    return _ENCODERS[key]
