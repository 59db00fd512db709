"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 50 words.  Every passage is encoded as a row of shares
(letters by case, digits, single symbols, repeated words, word lengths ...), then

    h = tanh(W x + c)            a = softmax over passages of  w . (tanh(V h) * sigmoid(U h))
    score = sigmoid(u . sum(a h) + b)

Only documents carry labels; the gated attention learns from them which passages decide.  All
parameters are fitted together by Adam on a bounded sample of labelled rows (``FIT_DOCUMENTS``
documents of at most ``FIT_BYTES`` each, chosen by a hash of the id).  Encoding, for the sample
and for scoring, runs in the tasks on whole texts; scoring needs the fitted weights only, a few
thousand numbers.

Labels of a document whose crc32 of the id is divisible by five are held out: neither the
sample nor any statistic sees them.  Ids, labels, languages and sources are no inputs.

Defined cases: a null or empty text is one empty passage and gets a score; conflicting labels
of one id count by majority (ties as 1), null labels not at all; if no label or only one class
is there, every score is that class's share (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import bounded_sample

PASSAGE_WORDS = 50
FIT_DOCUMENTS = 6000
FIT_BYTES = 100_000
HIDDEN, GATE, EPOCHS, BATCH = 16, 8, 40, 256
THRESHOLD = 0.3
HELD_OUT = 5
# Bytes of a text that are encoded at a time.
_PIECE = 1 << 20

_SYMBOLS = b"|*#%$&!.,-?:;@/\\+<>="
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH, _OTHER, _FIRST_SYMBOL = range(8)
_KINDS = _FIRST_SYMBOL + len(_SYMBOLS)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    kinds[128:] = _HIGH
    kinds[list(b"\t\x0b\x0c\r ")] = _SPACE
    kinds[ord("\n")] = _LINE
    kinds[list(range(ord("a"), ord("z") + 1))] = _LOWER
    kinds[list(range(ord("A"), ord("Z") + 1))] = _UPPER
    kinds[list(range(ord("0"), ord("9") + 1))] = _DIGIT
    for i, symbol in enumerate(_SYMBOLS):
        kinds[symbol] = _FIRST_SYMBOL + i
    return kinds


_KIND_OF = _byte_kinds()
FEATURES = _KINDS + 9


def _encode_piece(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, dtype=np.uint8)
    kinds = _KIND_OF[codes]
    blank = (kinds == _SPACE) | (kinds == _LINE)
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.zeros((0, FEATURES), dtype=np.float32)
    first = starts[::PASSAGE_WORDS]
    first[0] = 0
    length = np.diff(np.append(first, len(codes)))
    passage = np.repeat(np.arange(len(first)), length)
    counts = np.bincount(passage * _KINDS + kinds, minlength=len(first) * _KINDS).reshape(-1, _KINDS)
    # Words: length, hash, kinds at both ends.
    ends = np.flatnonzero(inside & np.concatenate((blank[1:], [True]))) + 1
    size = ends - starts
    offset = np.arange(len(codes)) - np.repeat(np.append(0, starts[1:]), np.diff(np.append(np.append(0, starts[1:]), len(codes))))
    weighed = (codes.astype(np.uint64) + np.uint64(1)) * (
        (offset.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD1B54A32D192ED03))
    weighed[blank] = 0
    hashes = np.add.reduceat(weighed, starts)
    of = np.arange(len(starts)) // PASSAGE_WORDS
    words = np.bincount(of, minlength=len(first)).astype(np.float64)
    share = lambda mask: np.bincount(of, weights=mask, minlength=len(first)) / words
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    order = np.lexsort((hashes, of))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])))
    distinct = np.bincount(of[order], weights=new, minlength=len(first)) / words
    head, tail = kinds[starts], kinds[ends - 1]
    mean = share(size)
    return np.column_stack((
        counts / np.maximum(length, 1)[:, None],
        mean / 10, np.sqrt(np.maximum(share(size * size) - mean * mean, 0)) / 10,
        share(head == _UPPER), share(tail == _UPPER), share(tail >= _OTHER), share(size <= 3),
        share(again), distinct, np.log1p(words) / 4,
    )).astype(np.float32)


def encode(text: str | None) -> np.ndarray:
    """One row of features per passage; long texts are encoded piece by piece."""
    data = (text or "").encode("utf-8", "surrogatepass")
    rows, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= _PIECE else max(data.rfind(b" ", at, at + _PIECE), data.rfind(b"\n", at, at + _PIECE))
        end = end if end > at else min(at + _PIECE, len(data))
        rows.append(_encode_piece(data[at:end]))
        at = end
    found = np.concatenate(rows) if rows else np.zeros((0, FEATURES), np.float32)
    return found if len(found) else np.zeros((1, FEATURES), np.float32)


@dataclass
class Model:
    """Weights by name, the scaling of the features, and the score where nothing could be fitted."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """``bags``: first passage of every document."""
        p = self.weights
        sizes = np.diff(np.append(bags, len(x)))
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags), sizes))
        a = e / np.repeat(np.add.reduceat(e, bags), sizes)
        z = np.add.reduceat(a[:, None] * h, bags, axis=0)
        return {"x": x, "sizes": sizes, "h": h, "t": t, "g": g, "a": a, "z": z,
                "score": 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["b"], -30, 30)))}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        x = (np.concatenate(bags).astype(np.float64) - self.mean) / self.scale
        return self.forward(x, np.cumsum([0] + [len(b) for b in bags[:-1]]))["score"]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Cross-entropy by Adam; the rarer class counts as much as the other one."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model(constant=share)
    every = np.concatenate(bags).astype(np.float64)
    model = Model(mean=every.mean(axis=0), scale=every.std(axis=0) + 1e-3)
    bags = [(b - model.mean) / model.scale for b in bags]
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = model.weights = {"W": draw(FEATURES, HIDDEN), "c": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
                         "w": draw(GATE), "u": draw(HIDDEN), "b": np.zeros(())}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) + 1e-4
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            f = model.forward(x, np.cumsum([0] + [len(bags[i]) for i in chosen[:-1]]))
            error = (f["score"] - labels[chosen]) * balance[chosen] / len(chosen)
            dz = np.repeat(error[:, None] * p["u"], f["sizes"], axis=0)
            da = (dz * f["h"]).sum(axis=1)
            bag_mean = np.repeat(np.add.reduceat(f["a"] * da, np.cumsum(np.append(0, f["sizes"][:-1]))), f["sizes"])
            de = f["a"] * (da - bag_mean)
            dt, dg = de[:, None] * p["w"] * f["g"], de[:, None] * p["w"] * f["t"]
            dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grads = {"W": x.T @ dh, "c": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                     "w": (f["t"] * f["g"]).T @ de, "u": f["z"].T @ error, "b": error.sum()}
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Null ids are never held out (and never labelled)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % HELD_OUT == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
               documents: int = FIT_DOCUMENTS) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and labels of a bounded sample outside the held-out fifth."""
    usable = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).alias("y"))
    chosen = bounded_sample(usable.filter(F.col("id").isNotNull()), F.xxhash64("id"), documents)
    texts = docs.filter(F.octet_length(text) <= FIT_BYTES).select(F.col(doc_id).alias("id"), F.col(text).alias("t"))

    @F.arrow_udf("binary")
    def encoded(values: pa.Array) -> pa.Array:
        return pa.array([encode(v.as_py()).tobytes() for v in values], pa.binary())

    # One row an id, however many the table has under it.
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = one.select("id", "y", encoded("t").alias("x")).toArrow()
    rows = sorted(zip(rows["id"].to_pylist(), rows["x"].to_pylist(), rows["y"].to_pylist(), strict=True))
    return [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x, _ in rows], np.array([y for _, _, y in rows], float)


def scores(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        return pa.array([float(model.score([encode(v.as_py())])[0]) for v in values], pa.float64())

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced."""
    model = fit(*fit_sample(docs, labels, text, doc_id, label))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    return docs.select(*kept, held_out(F.col(doc_id)).alias("held_out"), scores(F.col(text), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def good_only(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects."""
    model = fit(*fit_sample(docs, labels, text, doc_id, label))
    return docs.filter(scores(F.col(text), model) >= threshold)
