"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is
encoded: shares of byte-class pairs and of repeated words go through a
learned layer to a vector h. Gated attention, w . (tanh(V h) * sigmoid(U h)),
gives each passage its weight in the bag (softmax), and the weighted mean of
the h is scored by a logistic layer. Only document labels are used to learn;
the attention finds the passages that decide.

Texts are encoded where they lie (``mapInPandas``): nothing is shuffled for
scoring. Long texts are encoded piece by piece; the attention's running sums
join the pieces, so memory does not grow with a text. Learning takes a
bounded sample of labelled rows: in the order of the hash of the id, at most
``max_docs`` documents and at most ``max_passages`` passages in all; a document
is taken with all of its passages or not at all. The sample is fitted in numpy
on the driver. Scoring takes every passage.

Defined results: a null, empty or blank text is one passage without any
class, which gets a score like others; labels other than 0 and 1 are ignored;
repeated labels of a document count once, the higher wins; without labels of
both kinds the score is the share of label 1 (0.5 without any); columns pass
through, result names that exist already are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

PASSAGE_WORDS = 64
PIECE_BYTES = 1 << 20
HIDDEN, GATE = 24, 12

_GROUPS = [b" ", b"\n\r", b"\t\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
           b".", b",;:", b"!?", b"'\"()[]{}", b"#*$%&|<>", b"-_/\\@=+~^`"]
CLASS = np.full(256, len(_GROUPS), dtype=np.int64)  # the last class: bytes of other letters
for _i, _g in enumerate(_GROUPS):
    CLASS[list(_g)] = _i
N_CLASS = len(_GROUPS) + 1
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
N_FEATURES = N_CLASS * N_CLASS + 4


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts`` and the index of each one's text."""
    buf = np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - np.array([len(t) + 1 for t in texts])
    cls, space = CLASS[buf], SPACE[buf]
    first = ~space
    first[1:] &= space[:-1]  # every text ends in a space: words do not cross
    at = np.flatnonzero(first)
    owner = np.searchsorted(ends, at, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(n_pass) - n_pass
    rank = np.arange(len(at)) - (np.cumsum(n_words) - n_words)[owner]
    word_pass = base[owner] + rank // PASSAGE_WORDS
    total = int(n_pass.sum())
    # bytes before a passage's first word belong to the passage before, or to the text's first
    opens = np.zeros(len(buf), dtype=np.int64)
    opens[starts] = 1
    opens[at[(rank % PASSAGE_WORDS == 0) & (rank > 0)]] = 1
    byte_pass = np.cumsum(opens) - 1
    pair = byte_pass[1:] * (N_CLASS * N_CLASS) + cls[:-1] * N_CLASS + cls[1:]
    same = byte_pass[1:] == byte_pass[:-1]
    hist = np.bincount(pair[same], minlength=total * N_CLASS * N_CLASS).reshape(total, -1).astype(np.float32)
    x = np.zeros((total, N_FEATURES), dtype=np.float32)
    x[:, :-4] = np.sqrt(hist / np.maximum(1, hist.sum(1, keepdims=True)))
    if len(at):
        stop = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        pos = np.arange(len(buf)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(buf)]])))
        code = np.add.reduceat(np.where(space, 0, (buf.astype(np.int64) + 7) * (1 + pos * 1315423911 % 1000003)), at)
        count = np.maximum(1, np.bincount(word_pass, minlength=total))
        again = np.zeros(len(at), dtype=bool)
        again[1:] = (code[1:] == code[:-1]) & (word_pass[1:] == word_pass[:-1])
        order = np.lexsort((code, word_pass))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (word_pass[order][1:] != word_pass[order][:-1])
        x[:, -4] = np.bincount(word_pass, weights=again, minlength=total) / count
        x[:, -3] = np.bincount(word_pass[order], weights=fresh, minlength=total) / count
        x[:, -2] = np.bincount(word_pass, weights=stop - at, minlength=total) / count / 10
        x[:, -1] = count / PASSAGE_WORDS
    return x, np.repeat(np.arange(len(texts)), n_pass)


def _pieces(text: bytes) -> list[bytes]:
    """A long text in pieces that end between words where there is a gap."""
    out = []
    while len(text) > PIECE_BYTES:
        cut = max(text.rfind(b" ", PIECE_BYTES // 2, PIECE_BYTES), text.rfind(b"\n", PIECE_BYTES // 2, PIECE_BYTES))
        cut = cut + 1 if cut > 0 else PIECE_BYTES
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def encoded(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and text indices, a bounded number of bytes at a time."""
    group, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            if group and size + len(piece) > PIECE_BYTES:
                x, own = encode(group)
                yield x, np.array(owners)[own]
                group, owners, size = [], [], 0
            group.append(piece)
            owners.append(i)
            size += len(piece)
    if group:
        x, own = encode(group)
        yield x, np.array(owners)[own]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights by name; ``prior`` alone if there was nothing to learn from."""

    weights: dict[str, np.ndarray]
    prior: float = 0.5

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.weights
        h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, np.exp(np.clip((t * s) @ p["w"], -20, 20))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        total, bag = np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
        for x, own in encoded(texts):
            h, _, _, a = self.attend(x)
            total += np.bincount(own, weights=a, minlength=len(texts))
            for k in range(HIDDEN):
                bag[:, k] += np.bincount(own, weights=a * h[:, k], minlength=len(texts))
        return _sigmoid(bag / np.maximum(total, 1e-12)[:, None] @ self.weights["c"] + self.weights["d"][0])


def fit_bags(x: np.ndarray, own: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01,
             decay: float = 1e-4, batch: int = 256, seed: int = 7) -> Model:
    """Fit on passages ``x`` of bags ``own`` (ascending) with bag labels ``y``."""
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": init(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE),
         "w": init(GATE), "c": init(HIDDEN), "d": np.array([np.log(y.mean() / (1 - y.mean()))])}
    fixed = {"mean": x.mean(0), "scale": x.std(0) + 0.02}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    first = np.searchsorted(own, np.arange(len(y) + 1))
    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            bag = np.repeat(np.arange(len(chosen)), first[chosen + 1] - first[chosen])
            heads = np.concatenate([[0], np.cumsum(first[chosen + 1] - first[chosen])[:-1]])
            xs = (x[rows] - fixed["mean"]) / fixed["scale"]
            h = np.tanh(xs @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            a = np.exp(np.clip((t * s) @ p["w"], -20, 20))
            a /= np.add.reduceat(a, heads)[bag]
            z = np.add.reduceat(a[:, None] * h, heads)
            err = (_sigmoid(z @ p["c"] + p["d"][0]) - y[chosen]) / len(chosen)
            dz = err[:, None] * p["c"]
            da = (h * dz[bag]).sum(1)
            de = a * (da - np.add.reduceat(a * da, heads)[bag])
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ err,
                    "d": np.array([err.sum()])}
            step += 1
            for k in p:
                g = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model({**p, **fixed})


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
        max_docs: int = 6000, max_passages: int = 60_000) -> Model:
    """Learn from the documents that ``labels`` (key, label) names, within the two bounds."""
    named = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).cast("int").alias("y"))
             .withColumn("turn", F.xxhash64("k")).orderBy("turn", "k").limit(max_docs))
    sample = (docs.select(F.col(key).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
              .join(F.broadcast(named), "k"))  # at most max_docs rows
    # repeated ids: one text each, the first by its digest
    sample = sample.groupBy("k", "turn", "y").agg(F.min_by("t", F.coalesce(F.md5("t"), F.lit(""))).alias("t"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, turn, y, t in zip(batch["k"], batch["turn"], batch["y"], batch["t"]):
                rows, n = [], 0
                for f, _ in encoded([t]):
                    n += len(f)
                    rows = [*rows, f] if n <= max_passages else []
                yield pd.DataFrame({"k": [k], "turn": [turn], "y": [y], "n": [n],
                                    "x": [np.concatenate(rows).tobytes() if n <= max_passages else None]})

    kind = T.StructType([sample.schema["k"], T.StructField("turn", T.LongType()), T.StructField("y", T.IntegerType()),
                         T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType())])
    feats = written(sample.mapInPandas(features, kind), "bags")
    total, last = 0, None
    for r in sorted(feats.where("x is not null").select("turn", "k", "n").collect()):  # at most max_docs rows
        if total + r["n"] > max_passages:
            break
        total, last = total + r["n"], r
    chosen = feats.where("x is not null").where((F.col("turn") < last["turn"]) | (F.col("turn") == last["turn"]) & (F.col("k") <= last["k"])) if last else feats.limit(0)
    got = sorted(chosen.select("k", "y", "x").collect(), key=lambda r: r["k"])
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES) for r in got]
    own = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit_bags(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), own, np.array([r["y"] for r in got], dtype=float))


def score(df: DataFrame, model: Model, text: str = "text", result: str = "score") -> DataFrame:
    """``df`` with the score of every row's text."""
    plain = df.drop(result)
    schema = T.StructType([*plain.schema.fields, T.StructField(result, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in batch[text]]
            batch[result] = model.score(texts)
            yield batch

    return plain.mapInPandas(run, schema)


def held_out(key: Column, folds: int) -> Column:
    """True for the ids that learning leaves out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))
