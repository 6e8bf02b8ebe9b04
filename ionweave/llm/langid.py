"""Language identification with a byte-level convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over them, the maximum of each filter over a fixed-length window
feeds a softmax. A text is cut into windows that cover all its bytes; its class probabilities are the windows' means,
weighted by their bytes. The network is trained on the driver on a bounded sample: at most about ``PER_LANGUAGE`` texts
a language, ``WINDOWS`` windows spread over each, chosen by hash of doc_id; one in five doc_ids is never trained on.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled text everything is
``und``; with one language all texts have it; texts of null lang are predicted and not learned; repeated rows are
predicted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ionweave.llm.common import chunks, quoted, text_buffers

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, WINDOWS, EPOCHS, BATCH, RATE = 300, 4, 8, 64, 0.01
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zero, bytes in each, document of each); an empty text has none."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[doc] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[doc + 1] - begin)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, WINDOW), (1, 1))[begin]
    windows[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return windows, length, doc


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.params = {"embed": draw(256, EMBED), "out": draw(FILTERS * len(WIDTHS), len(classes)) * 0.3, "bias": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.params[f"conv{w}"] = draw(w * EMBED, FILTERS)
            self.params[f"shift{w}"] = np.zeros(FILTERS, np.float32)
        self.params["embed"][0] = 0

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        p = self.params
        e = p["embed"][x]
        pooled, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            patches = np.lib.stride_tricks.as_strided(e, (len(x), n, w * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
            y = (patches.reshape(-1, w * EMBED) @ p[f"conv{w}"]).reshape(len(x), n, FILTERS)
            at = None
            pooled.append(y.max(axis=1) + p[f"shift{w}"])
            if self.training:
                at = y.argmax(axis=1)
            places.append(at)
        return np.maximum(np.concatenate(pooled, axis=1), 0), places, e

    training = False

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)), np.float32)
        for k in range(0, len(x), 256):
            h, _, _ = self._pooled(x[k : k + 256])
            out[k : k + 256] = _softmax(h @ self.params["out"] + self.params["bias"])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross-entropy, classes weighted evenly; part of the windows are cut short to learn short texts too."""
        rng = np.random.default_rng(seed)
        p, moment, square, step = self.params, {}, {}, 0
        weight = (len(y) / len(self.classes) / np.maximum(1, np.bincount(y, minlength=len(self.classes)))).astype(np.float32)
        self.training = True
        for epoch in range(EPOCHS):
            for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                xb = x[b].copy()
                short = rng.random(len(b)) < 0.4
                keep = np.where(short, rng.integers(8, WINDOW, len(b)), WINDOW)
                xb[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
                h, places, e = self._pooled(xb)
                d = _softmax(h @ p["out"] + p["bias"])
                d[np.arange(len(b)), y[b]] -= 1
                d *= weight[y[b]][:, None] / len(b)
                grad = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
                dh = (d @ p["out"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    at = places[k][:, :, None] + np.arange(w)
                    rows = np.arange(len(b))[:, None, None]
                    patch = e[rows, at].reshape(len(b), FILTERS, w * EMBED)
                    grad[f"conv{w}"] = np.einsum("bf,bfk->kf", g, patch)
                    grad[f"shift{w}"] = g.sum(0)
                    back = (g[:, :, None] * p[f"conv{w}"].T[None]).reshape(-1, EMBED)
                    np.add.at(grad["embed"], xb[rows, at].reshape(-1), back)
                grad["embed"][0] = 0
                step += 1
                rate = RATE * (1 - 0.9 * epoch / EPOCHS)
                for name, g in grad.items():
                    m = moment[name] = 0.9 * moment.get(name, 0) + 0.1 * g
                    v = square[name] = 0.999 * square.get(name, 0) + 0.001 * g * g
                    p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.training = False


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, language of each): the bounded sample. Languages are counted first, so that each gives about
    as many texts; doc_ids are chosen by hash, in the scan."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*(F.lit(x) for k in sorted(counts) for x in (k, per_language / counts[k])))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            out = []
            for k, (doc, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = data[offsets[k] : offsets[k + 1]]
                n = -(-len(own) // WINDOW)
                for j in sorted({i * n // WINDOWS for i in range(WINDOWS)}) if n else ():
                    out.append((doc, lang, j, own[j * WINDOW : (j + 1) * WINDOW].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["doc_id", "lang", "nth", "bytes"])

    rows = known.where(chance < share[F.col("lang")]).mapInArrow(take, "doc_id long, lang string, nth long, bytes binary").collect()
    rows = sorted({(r.lang, r.doc_id if r.doc_id is not None else -1, r.nth, bytes(r.bytes)) for r in rows})
    languages = sorted({r[0] for r in rows})
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for k, r in enumerate(rows):
        x[k, : len(r[3])] = np.frombuffer(r[3], np.uint8)
    return languages, x, np.array([languages.index(r[0]) for r in rows], np.int64)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCNN | None:
    languages, x, y = training_windows(docs, per_language)
    if not languages:
        return None
    model = ByteCNN(languages)
    model.fit(x, y)
    return model


def predict(docs: DataFrame, model: ByteCNN | None, keep: tuple[str, ...] = ("doc_id",), within: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` with lang_pred and score. ``within``: the one kept struct that has the
    text as a string; it is then sent to Python once."""
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL("lang_pred string, score double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0).field("text") if within else batch.column(0))
            kept = batch.columns[0 if within else 1 :]
            for i, j in chunks(offsets):
                raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                name, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                windows, length, doc = cut_windows(raw, own)
                if model is not None and len(windows):
                    sums = np.zeros((j - i, len(model.classes)))
                    np.add.at(sums, doc, model.probabilities(windows) * length[:, None])
                    letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[raw])])
                    some = letters[own[1:]] > letters[own[:-1]]
                    for d in np.flatnonzero(~some & (np.diff(own) > 0)):
                        some[d] = any(map(str.isalpha, raw[own[d] : own[d + 1]].tobytes().decode()))
                    best = sums.argmax(axis=1)
                    name[some] = np.array(model.classes, dtype=object)[best[some]]
                    score[some] = np.minimum(1.0, sums[some, best[some]] / np.diff(own)[some])
                cols = [c.slice(i, j - i) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(name.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    sent = [within] if within else [F.col("text").cast("string").alias("_text"), *keep]
    return docs.select(*sent).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text, lang)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return predict(base, train(base, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language has at least that score: as much as all others together.

    Rows are judged each, whatever their doc_ids; a null text, or one without letters, goes.
    """
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*quoted(docs.columns)).alias("row"))
    return predict(rows, train(docs, per_language), ("row",), "row").where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")
