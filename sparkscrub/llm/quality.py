"""Document quality by gated attention over passages (multiple-instance learning).

A document is a bag of passages of `PASSAGE_WORDS` words. Each passage is described by character and word statistics and
encoded by a learned layer; a learned gate gives it an attention weight; the weighted sum of the encodings is scored. Only
document labels are needed for training. Labels, language, source and id are never inputs of a score.

Null and empty texts are one passage without words and get the score learned for it. Repeated rows get equal scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, slices, tidy, word_hashes, words

PASSAGE_WORDS = 64
#: Labelled documents the model is fitted on at most, and passages of theirs from which on no further document is taken.
TRAIN_DOCUMENTS = 6_000
TRAIN_PASSAGES = 384_000

_CLASSES = 37  # every ASCII punctuation mark on its own, then lower, upper, digit, white space, the rest
_CLASS = np.full(256, 36, dtype=np.int64)
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_MARKS] = np.arange(len(_MARKS))
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[WHITE] = 32, 33, 34, 35
FEATURES = _CLASSES + 8


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, row of each passage); rows without words have one passage of zeros."""
    n_rows = len(bounds) - 1
    starts, ends, row = words(data, bounds)
    per_row = np.bincount(row, minlength=n_rows)
    in_row = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    cut = np.maximum(1, -(-per_row // PASSAGE_WORDS))
    base = np.cumsum(cut) - cut
    owner = np.repeat(np.arange(n_rows), cut)
    x = np.zeros((len(owner), FEATURES))
    if not len(starts):
        return x, owner
    of_word = base[row] + in_row // PASSAGE_WORDS
    heads = np.flatnonzero(np.r_[True, of_word[1:] != of_word[:-1]])
    which = of_word[heads]
    spans = np.diff(np.r_[starts[heads], len(data)])
    spans[0] += starts[heads[0]]
    of_byte = np.repeat(which, spans)  # white space after a passage counts with it
    counts = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=len(owner) * _CLASSES).reshape(-1, _CLASSES)[:len(owner)]
    x[:, :_CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, of_word))
    sorted_hash, sorted_of = hashes[order], of_word[order]
    fresh = np.r_[True, (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_of[1:] != sorted_of[:-1])]
    n = np.bincount(of_word, minlength=len(owner))
    share = lambda flags, of: np.bincount(of, weights=flags, minlength=len(owner)) / np.maximum(1, n)
    length = ends - starts
    x[:, _CLASSES] = share(fresh, sorted_of)
    x[:, _CLASSES + 1] = share(np.r_[False, (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])], of_word)
    x[:, _CLASSES + 2] = np.minimum(share(length, of_word), 40) / 10
    x[:, _CLASSES + 3] = share(length == 1, of_word)
    last = _CLASS[data[ends - 1]]
    x[:, _CLASSES + 4] = share(last < 32, of_word)
    x[:, _CLASSES + 5] = share(_CLASS[data[starts]] == 33, of_word)
    x[:, _CLASSES + 6] = share(last == 33, of_word)
    x[:, _CLASSES + 7] = np.minimum(n, PASSAGE_WORDS) / PASSAGE_WORDS
    return x, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Encoder (w, b), gated attention (v, u, a) and scorer (c, c0)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = t * s @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        attention = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(attention[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "attention": attention, "z": z, "p": _sigmoid(z @ p["c"] + p["c0"])}

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.forward(x, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), owner)["p"]


def _gradient(model: AttentionModel, f: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray, starts, owner) -> dict[str, np.ndarray]:
    p = model.weights
    d_logit = (f["p"] - y) * weight / weight.sum()
    d_z = d_logit[:, None] * p["c"]
    from_z = d_z[owner]
    d_att = (f["h"] * from_z).sum(1)
    d_e = f["attention"] * (d_att - np.add.reduceat(f["attention"] * d_att, starts)[owner])
    d_gate = d_e[:, None] * p["a"]
    d_t, d_s = d_gate * f["s"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["s"] * (1 - f["s"])
    d_h = f["attention"][:, None] * from_z + d_t @ p["v"].T + d_s @ p["u"].T
    d_pre = d_h * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ d_logit, "c0": np.array(d_logit.sum()), "a": (f["t"] * f["s"]).T @ d_e, "v": f["h"].T @ d_t, "u": f["h"].T @ d_s,
            "w": f["x"].T @ d_pre, "b": d_pre.sum(0)}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, rate: float = 0.01,
          batch: int = 256, decay: float = 1e-4) -> AttentionModel:
    """Fit by Adam on bags of passages; classes are balanced half-way, seeds are fixed."""
    rng = np.random.default_rng(7)
    everything = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    shape = {"w": (FEATURES, hidden), "b": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "c": (hidden,), "c0": ()}
    model = AttentionModel(everything.mean(0), everything.std(0) + 0.05,
                           {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "ac" else np.zeros(s) for k, s in shape.items()})
    if not bags:
        model.weights["c"] = np.zeros(hidden)
        return model
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    share = np.clip(labels.mean(), 0.02, 0.98)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            sizes = np.array([len(bags[i]) for i in own])
            owner, starts = np.repeat(np.arange(len(own)), sizes), np.cumsum(sizes) - sizes
            f = model.forward(np.concatenate([bags[i] for i in own]), starts, owner)
            step += 1
            for k, g in _gradient(model, f, labels[own], balance[own], starts, owner).items():
                g = g + decay * model.weights[k] * (k not in ("b", "c0"))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.weights[k] = model.weights[k] - move
    return model


def held_out(doc_id: str | Column, folds: int = 4, fold: int = 2) -> Column:
    """True for the documents never trained on; a null id is not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        limit: int = TRAIN_DOCUMENTS) -> AttentionModel:
    """Fit on at most `limit` labelled documents outside the held-out fold, chosen by a hash of their id, with all their passages.

    Documents are taken whole, in the order of that hash, until they have `TRAIN_PASSAGES` passages. The chosen labels (at most `limit`
    rows) are broadcast; what comes to the driver is the passages' features of these documents. Rows without a label or an id are not
    used; an id labelled twice counts with its largest label."""
    chosen = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
              .filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(limit))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, bounds in slices(batch["text"]):
                n = np.maximum(1, -(-np.bincount(words(data, bounds)[2], minlength=end - start) // PASSAGE_WORDS))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(start, end - start).cast(pa.int64()), batch["h"].slice(start, end - start),
                                                  pa.array(n, pa.int64())], names=["id", "h", "n"])

    sizes = texts.mapInArrow(tidy(count), "id long, h long, n long").groupBy("h", "id").agg(F.sum("n").alias("n")).orderBy("h", "id").collect()
    total = np.cumsum([0] + [r["n"] for r in sizes])[:-1]
    taken = [r["id"] for r, before in zip(sizes, total) if before < TRAIN_PASSAGES]
    if len(taken) < len(sizes):
        last = sizes[len(taken) - 1]
        texts = texts.filter((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("id") <= last["id"]))
    schema = "id long, y double, n int, x binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, bounds in slices(batch["text"]):
                x, owner = passages(data, bounds)
                cuts = np.searchsorted(owner, np.arange(end - start + 1))
                rows = [x[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(start, end - start).cast(pa.int64()), batch["y"].slice(start, end - start),
                                                  pa.array([len(r) for r in rows], pa.int32()),
                                                  pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], names=["id", "y", "n", "x"])

    rows = sorted(texts.mapInArrow(tidy(describe), schema).collect(), key=lambda r: (r["id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], "<f4").reshape(r["n"], FEATURES).astype(float) for r in rows]
    return train(bags, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out`; a column of that name is replaced. Row-local: no shuffle."""
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit(0.0)).schema
    names = docs.columns + [out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start, end, data, bounds in slices(batch[text]):
                scores[start:end] = model.score(*passages(data, bounds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=names)

    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
