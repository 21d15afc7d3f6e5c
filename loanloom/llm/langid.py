"""Language identification with a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import fresh, ranges_of, small_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled documents per language that the fit may see at most, and text windows of each.
SAMPLE_PER_LANGUAGE, WINDOWS_PER_DOC = 500, 3
UNDETERMINED = "und"
#: Bytes of text whose windows are held at once.
CHUNK = 1 << 20
STRIDE = WINDOW - max(WIDTHS) + 1  # every run of four bytes lies inside a window


def _folded() -> np.ndarray:
    """Byte to symbol: 0 for every ASCII byte but letters, small letters for capitals, others as they are."""
    codes = np.arange(256, dtype=np.uint8)
    for b in range(128):
        codes[b] = ord(chr(b).lower()) if chr(b).isalpha() else 0
    return codes


FOLD = _folded()


@dataclass
class ByteConvNet:
    """``filters[w]`` is (width, 256, FILTERS); the maximum of each over a window feeds the softmax."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per width the answer to a pair of bytes, and what follows the pair: a byte or another pair."""
        out = []
        for f in self.filters:
            pair = (f[0][:, None, :] + f[1][None, :, :]).reshape(65536, -1)
            rest = None if len(f) == 2 else f[2] if len(f) == 3 else (f[2][:, None, :] + f[3][None, :, :]).reshape(65536, -1)
            out.append((np.ascontiguousarray(pair, np.float32), None if rest is None else np.ascontiguousarray(rest, np.float32)))
        return out

    def features(self, windows: np.ndarray, tables=None) -> np.ndarray:
        """Maxima (window, filter) over all positions, at least 0."""
        tables = tables or self.tables()
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        out = []
        for f, (pair, rest) in zip(self.filters, tables, strict=True):
            places = WINDOW - len(f) + 1
            seen = np.take(pair, pairs[:, :places], axis=0)
            if len(f) == 3:
                seen += np.take(rest, windows[:, 2:], axis=0)
            elif len(f) == 4:
                seen += np.take(rest, pairs[:, 2:], axis=0)
            out.append(seen.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0.0)

    def probabilities(self, windows: np.ndarray, tables=None) -> np.ndarray:
        return _softmax(self.features(windows, tables) @ self.weights + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 12, seed: int = 1) -> ByteConvNet:
    """Fit the network with Adam on windows of labelled text; a third are cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    windows = np.zeros((len(texts), WINDOW), dtype=np.uint8)
    for i, text in enumerate(texts):
        data = FOLD[np.frombuffer(text[:WINDOW], dtype=np.uint8)]
        size = rng.integers(12, WINDOW) if rng.random() < 1 / 3 else WINDOW
        windows[i, : min(size, len(data))] = data[:size]
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    net = ByteConvNet(languages, filters, np.zeros(total, np.float32),
                      rng.normal(0, 0.1, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    values = [*net.filters, net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            step += 1
            for value, gradient, (m, v) in zip(values, _gradients(net, windows[rows], target[rows]), moments, strict=True):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient * gradient - v)
                value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteConvNet, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    n, best, most = len(windows), [], []
    for f in net.filters:
        places = WINDOW - len(f) + 1
        seen = sum(f[j][windows[:, j : j + places]] for j in range(len(f)))
        best.append(seen.argmax(axis=1))
        most.append(seen.max(axis=1))
    raw = np.concatenate(most, axis=1) + net.bias
    hidden = np.maximum(raw, 0.0)
    error = _softmax(hidden @ net.weights + net.offset)
    error[np.arange(n), target] -= 1.0
    error /= n
    back = (error @ net.weights.T) * (raw > 0)
    out = []
    for k, f in enumerate(net.filters):  # only the position of the maximum gets a gradient
        gradient, part = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(len(f)):
            bytes_ = np.take_along_axis(windows, best[k] + j, axis=1)
            np.add.at(gradient[j], (bytes_, np.arange(FILTERS)[None, :]), part)
        out.append(gradient)
    return [*out, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def training_sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, windows: int = WINDOWS_PER_DOC) -> pd.DataFrame:
    """``lang, piece`` of at most ``per_language`` documents of each language, ``windows`` pieces of each.

    Documents are chosen by a hash of their id, at a rate that follows the number of
    documents of the language; the pieces start at hashed places anywhere in the text.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "piece": []})
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 0.9 * per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k + 2)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    pieces = F.array(*[F.substr("text", start(k).cast("int"), F.lit(WINDOW)) for k in range(windows)])
    bound = per_language * len(counts)
    chosen = (labelled.where(draw < rates[F.col("lang")]).select("lang", pieces.alias("pieces"), draw.alias("draw"))
              .orderBy("draw", "lang", "pieces").limit(bound).toPandas())
    chosen = chosen.explode("pieces").rename(columns={"pieces": "piece"})
    return chosen[["lang", "piece"]].reset_index(drop=True)


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: text and language there, and not held out."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ByteConvNet | None:
    """A network from a bounded sample of ``docs`` (``doc_id, text, lang``); None if nothing is labelled."""
    sample = training_sample(learnable(docs).select("doc_id", "text", "lang"), per_language)
    if sample.empty:
        return None
    return train([p.encode() for p in sample["piece"]], sample["lang"].tolist())


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text each belongs to, and how many bytes it adds."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    data = np.concatenate((FOLD[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.zeros(WINDOW, np.uint8)))
    owner = np.repeat(np.arange(len(texts)), counts)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    windows = data[(base[owner] + inside)[:, None] + np.arange(WINDOW)]
    left = sizes[owner] - inside
    windows[np.arange(WINDOW) >= left[:, None]] = 0
    return windows, owner, np.clip(left, 1, WINDOW)


def _predict(net: ByteConvNet, at: int, keep: list[int], names: list[str]):
    """Language and score of the texts in column ``at``, after the columns ``keep``; the last column says if there are letters."""
    tables = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.extend(net.tables())
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            letters = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            score = np.zeros((len(texts), len(net.languages)))
            for first, stop in ranges_of([len(t) for t in texts], CHUNK):
                windows, owner, weight = cut_windows(texts[first:stop])
                for a in range(0, len(windows), 64):  # as many as stay in the cache
                    part = slice(a, a + 64)
                    np.add.at(score, owner[part] + first, net.probabilities(windows[part], tables) * weight[part, None])
            score /= np.maximum(score.sum(axis=1, keepdims=True), 1e-300)
            best = score.argmax(axis=1) if len(texts) else np.zeros(0, int)
            languages = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
            value = np.where(letters, score[np.arange(len(texts)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(languages, pa.string()), pa.array(value, pa.float64())], names=names)

    return run


def with_language(docs: DataFrame, net: ByteConvNet | None, keep_text: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    The windows of a text cover all of it; the score is the mean probability of the
    predicted language, weighted by the bytes of each window. ``und`` with score 0 goes to null texts,
    texts without a letter, and all texts if there is no network. Columns of ``docs`` with one of
    the two names are replaced, all others stay, ``text`` only with ``keep_text``.
    """
    small_batches(docs.sparkSession)
    sent = [c for c in docs.columns if c not in names]
    kept = [c for c in sent if keep_text or c != "text"]
    if net is None:
        return docs.select(*kept).withColumns({names[0]: F.lit(UNDETERMINED), names[1]: F.lit(0.0)})
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    run = _predict(net, sent.index("text"), [sent.index(c) for c in kept], [*kept, *names])
    return docs.select(*sent, _letters().alias(fresh("letters", docs.columns))).mapInArrow(run, schema)


def _letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def keep_known(docs: DataFrame, net: ByteConvNet | None, least: float = 0.0) -> DataFrame:
    """The documents whose language is determined with a score of ``least`` or more, columns unchanged.

    Without a network nothing is rejected but texts that are null or have no letter.
    """
    if net is None:
        return docs.where(_letters())
    names = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    judged = with_language(docs, net, names=names)
    return judged.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).select(*docs.columns)
