"""Toxicity by compression distance: which of two zstandard dictionaries, ordinary or toxic, makes a window shorter.

Both dictionaries start with one trained on windows of ordinary text (entropy tables and content). The toxic one goes on
with words that stand out in toxic training text, the ordinary one with ordinary text of the same length. A word
stands out by the number of different neighbourhoods it has, so that copies of one document don't count. Windows that
the toxic dictionary shortens are looked at again word by word. A logistic function turns a document's length
differences into a score; it is fitted, and shifted to its best F1, on texts that the dictionaries in use have not seen.

Dictionaries trained apart on windows of each class do worse, since few windows of a toxic text are toxic and the rest of
both dictionaries differs by chance; README has the figures.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionsift.llm.common import tidy

WINDOW, STRIDE, MARGIN = 32, 16, 12
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample, and what the dictionaries are made of."""

    toxic: int = 1_500
    ordinary: int = 3_000
    longest: int = 20_000  # characters of a sampled text; longer ones aren't sampled
    dictionary: int = 16_384
    places: int = 8  # different neighbourhoods of a toxic word, at least
    odds: float = 20.0  # times as frequent in toxic text, at least
    words: int = 2_048  # of the toxic dictionary, at most
    windows: int = 40_000  # of ordinary text that its dictionary is trained on
    folds: int = 3  # for weights and threshold
    level: int = 3
    seed: int = 1


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    level: int = 3
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)


def _compressor(raw: bytes, level: int) -> zs.ZstdCompressor:
    d = zs.ZstdCompressionDict(raw)
    p = zs.ZstdCompressionParameters.from_level(level, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.pair = [_compressor(x, model.level) for x in (model.ordinary, model.toxic)] if model.toxic else []

    def differences(self, windows: list[bytes]) -> np.ndarray:
        """Compressed length under the ordinary dictionary less that under the toxic one."""
        a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(windows)), np.int64, len(windows)) for c in self.pair)
        return a - b

    def features(self, text: bytes) -> list[float]:
        padded = b" " + text
        windows = [padded[i : i + WINDOW] for i in range(0, max(1, len(padded) - WINDOW + STRIDE), STRIDE)]
        far = self.differences(windows)
        words, last = [], -1
        for k in np.flatnonzero(far >= 1).tolist():
            for m in WORD.finditer(padded, max(0, k * STRIDE - MARGIN), k * STRIDE + WINDOW + MARGIN):
                if m.start() > last and len(m[0]) >= 4:
                    words.append(m[0].lower())
                    last = m.start()
        one = joined = np.zeros(1)
        if words:
            one = np.sort(self.differences([b" " + w + b" " for w in words]))[::-1]
            line = b" " + b" ".join(words) + b" "
            joined = np.sort(self.differences([line[i : i + 48] for i in range(0, len(line), 24)]))[::-1]
        top, n = np.sort(far)[::-1], len(windows)
        return [float(x) for x in (
            top[0], top[:3].sum(), np.log(n), one[0], one[:3].sum(), (one >= 2).sum() / np.sqrt(n), np.log1p((one >= 2).sum()),
            joined[0], joined[:3].sum(), (top >= 3).sum() / np.sqrt(n), (top >= 4).sum() / np.sqrt(n), np.log1p((top >= 4).sum()), far.mean(),
        )]

    def score(self, text: bytes) -> float:
        if not self.pair:
            return 0.0
        m = self.model
        z = m.weights[0] + sum(w * (x - u) / s for w, x, u, s in zip(m.weights[1:], self.features(text), m.mean, m.scale, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _places(texts: list[bytes]) -> Counter:
    """For each word the number of different (word before, word after) it has."""
    seen: set[tuple[bytes, bytes, bytes]] = set()
    for t in texts:
        w = [x for x in WORD.findall(t.lower()) if len(x) >= 3]
        seen.update(zip([b"", *w[:-1]], w, [*w[1:], b""]))
    return Counter(x[1] for x in seen)


def _dictionary(windows: list[bytes], size: int) -> bytes:
    try:
        return zs.train_dictionary(size, windows).as_bytes()
    except zs.ZstdError:  # too few windows to train on: their text itself
        return b"".join(windows)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], how: Fit = Fit()) -> Model:
    """Both dictionaries, without weights."""
    r = random.Random(how.seed)
    windows = [t[i : i + 64] for t in ordinary for i in range(0, len(t), 64)]
    r.shuffle(windows)
    base = _dictionary(windows[: how.windows], how.dictionary)
    yes, no = _places(toxic), _places(ordinary)
    places = min(how.places, max(1, len(toxic) // 50))
    picked = sorted((w for w, c in yes.items() if c >= places and c / len(toxic) >= how.odds * (no[w] + 0.5) / len(ordinary)), key=lambda w: (yes[w], w))[-how.words :]
    more = b" " + b" ".join(picked) + b" "
    rest = b"".join(windows[:: max(1, len(windows) // 400)])
    return Model(base + more, base + (rest * (len(more) // max(1, len(rest)) + 1))[: len(more)], how.level)


def fit(toxic: list[bytes], ordinary: list[bytes], how: Fit = Fit(), rarer: float = 4.0) -> Model:
    """Dictionaries, logistic weights and threshold from labelled texts; an empty model (score 0) if a label is missing.

    Weights and threshold come from texts that the dictionaries in use have not seen: each of ``how.folds`` parts is
    measured with dictionaries made of the others. The final dictionaries are made of all texts. ``rarer`` says how many
    times an ordinary text of the sample counts in the threshold's F1, as toxic ones are drawn more often.
    """
    if min(len(toxic), len(ordinary)) < 2:
        return Model()
    x, y = [], []
    for f in range(folds := min(how.folds, len(toxic), len(ordinary))):
        apart = Scorer(dictionaries([t for i, t in enumerate(toxic) if i % folds != f], [t for i, t in enumerate(ordinary) if i % folds != f], how))
        for label, texts in ((1.0, toxic), (0.0, ordinary)):
            some = texts[f::folds]
            x += [apart.features(t) for t in some]
            y += [label] * len(some)
    x, y = np.array(x), np.array(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(60):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w)), z.T @ (p - y) + 0.3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    margin = z @ w
    # labels are rarer in the corpus than in the sample, so ordinary rows weigh more in the F1 that sets the threshold
    order = np.argsort(-margin)
    hits, wrong = np.cumsum(y[order]), np.cumsum(1 - y[order]) * rarer
    best = int(np.argmax(2 * hits / (hits + wrong + y.sum())))
    w[0] -= (margin[order[best]] + margin[order[min(best + 1, len(order) - 1)]]) / 2
    model = dictionaries(toxic, ordinary, how)
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> tuple[list[bytes], list[bytes], float]:
    """A bounded sample of labelled texts that are not held out: up to ``how.toxic`` and ``how.ordinary`` of them, by hash of the id.

    Twice as many ids are drawn from the labels first, since some texts may be missing or too long; that list, bounded by
    the same parameters, is what is broadcast to the documents, so no text is shuffled. The number is how many times
    fewer ordinary texts there are in the sample, beside toxic ones, than among all labels.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = []
    for label, n in ((1, how.toxic), (0, how.ordinary)):
        drawn += marked.where(F.col("toxic") == label).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(2 * n).select("doc_id", "toxic", "h").collect()
    few = spark.createDataFrame([tuple(r) for r in drawn], "doc_id long, toxic int, h long")
    found = docs.select("doc_id", "text").where(F.length("text") <= how.longest).join(F.broadcast(few), "doc_id")
    # an id that many rows repeat gives one text, the smallest, whatever its number of rows
    rows = sorted(found.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: (r.h, r.doc_id))
    toxic, ordinary = ([r.text.encode() for r in rows if r.toxic == label][:n] for label, n in ((1, how.toxic), (0, how.ordinary)))
    there = marked.agg(F.count_if(F.col("toxic") == 0).alias("no"), F.count_if(F.col("toxic") == 1).alias("yes")).first()
    rarer = there.no / max(1, there.yes) * len(toxic) / max(1, len(ordinary))
    return toxic, ordinary, max(1.0, rarer)


def _score_rows(sent, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        at = None
        for batch in batches:
            names = batch.schema.names
            at = names.index("text") if at is None else at
            scores = [scorer.score((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*names, name])

    return run


def classify(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), model: Model | None = None) -> DataFrame:
    """Adds ``held_out, score, predicted`` to every row of ``docs`` (clashing columns are replaced).

    The score looks at the whole text only. Null texts count as empty; with no usable labels all scores are 0; a null
    id is not held out. Rows, repeats and other columns stay. No shuffle but for the labelled sample.
    """
    plain = docs.drop("held_out", "score", "predicted")
    scored = with_score(plain, labels, "score", how, model)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})


def with_score(docs: DataFrame, labels: DataFrame, name: str, how: Fit = Fit(), model: Model | None = None) -> DataFrame:
    """Adds the score as column ``name``, which must be new."""
    if model is None:
        toxic, ordinary, rarer = sample(docs, labels, how)
        model = fit(toxic, ordinary, how, rarer)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(_score_rows(sent, name)), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
