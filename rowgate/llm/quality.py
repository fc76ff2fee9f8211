"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (shape of its characters, hashed
letter trigrams, repetition); gated attention, learned from document labels alone, weighs the passages;
the weighted sum is scored. The network is fitted on a bounded sample of labelled rows and
scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgate.llm.common import slices, utf8

PASSAGE = 512
HASHED = 192
HIDDEN = 24
#: Labelled rows of each class that the fit takes at most, by a hash of their ids.
SAMPLE = 2000
#: Bytes of text of a class that go to the driver.
SAMPLE_BYTES = 128 << 20
_CLASSES = (b"A-Z", b"a-z", b"0-9", b" ", b"\t\r\n", b".", b",", b"!", b"?", b"%", b"*", b"#", b"$", b"&", b"|", b"<>", b"{}[]()", b"@", b"/\\", b":;", b"=+", b"_-", b"\"'`^~")


def _class_table() -> np.ndarray:
    """Byte to class; the last class is all that's left, mostly non-ASCII."""
    out = np.full(256, len(_CLASSES), np.int64)
    for n, members in enumerate(_CLASSES):
        if len(members) == 3 and members[1:2] == b"-":
            out[members[0] : members[2] + 1] = n
        else:
            out[list(members)] = n
    return out


_CLASS = _class_table()
_KINDS = len(_CLASSES) + 1
WIDTH = _KINDS + HASHED + 6


def encode(texts: list[bytes], whole: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (passages, WIDTH) and the index of each text's first passage, then their number.

    ``whole`` has the lengths of the texts that these are parts of. Passages are the text's consecutive stretches of PASSAGE bytes; an empty text is one empty passage.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate(([0], np.cumsum(pieces)))
    n = int(first[-1])
    offset = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    # passage of each byte
    owner = np.repeat(first[:-1], sizes) + (np.arange(len(raw)) - np.repeat(offset[:-1], sizes)) // PASSAGE
    length = np.bincount(owner, minlength=n).astype(np.float32)
    kind = _CLASS[raw]
    shape = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float32)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    some = np.maximum(length, 1)[:, None]
    out[:, :_KINDS] = np.sqrt(shape / some)
    if len(raw) > 2:
        mixed = (lower[:-2] * 73_856_093) ^ (lower[1:-1] * 19_349_663) ^ (lower[2:] * 83_492_791)
        mixed ^= mixed >> 15
        inside = owner[:-2] == owner[2:]
        cell = owner[:-2] * 4096 + (mixed & 4095)
        grams = np.bincount(owner[:-2][inside] * HASHED + mixed[inside] % HASHED, minlength=n * HASHED)
        out[:, _KINDS : _KINDS + HASHED] = np.sqrt(grams.reshape(n, HASHED) / some)
        total = np.bincount(owner[:-2][inside], minlength=n)
        seen = np.zeros(n * 4096, bool)
        seen[cell[inside]] = True
        out[:, -6] = seen.reshape(n, 4096).sum(1) / np.maximum(total, 1)
        changes = (kind[1:] != kind[:-1]) & (owner[1:] == owner[:-1])
        out[:, -5] = np.bincount(owner[1:][changes], minlength=n) / some[:, 0]
        same = (raw[1:] == raw[:-1]) & (owner[1:] == owner[:-1])
        out[:, -4] = np.bincount(owner[1:][same], minlength=n) / some[:, 0]
    out[:, -3] = length / PASSAGE
    out[:, -2] = shape[:, 0] / np.maximum(1, shape[:, 0] + shape[:, 1])
    out[:, -1] = np.log1p(np.repeat(sizes if whole is None else np.array(whole), pieces)) / 10
    return out, first


def encode_all(texts: list[bytes], at_once: int = 512 * PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """``encode``, in stretches of so many bytes: the working arrays of a stretch are many times its size.

    A longer text is taken in several, cut between passages.
    """
    parts, counts = [], np.maximum(1, -(-np.array([len(t) for t in texts], np.int64) // PASSAGE))
    pieces: list[bytes] = []
    whole: list[int] = []
    size = 0
    for t in texts:
        for at in range(0, max(1, len(t)), at_once):
            pieces.append(t[at : at + at_once])
            whole.append(len(t))
            size += len(pieces[-1])
            if size >= at_once:
                parts.append(encode(pieces, whole)[0])
                pieces, whole, size = [], [], 0
    if pieces:
        parts.append(encode(pieces, whole)[0])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))


class Network:
    """Gated attention: a ~ softmax(w . (tanh(V h) * sigmoid(U h))), score = sigmoid(c . sum a h + b)."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(width)
        self.p = {
            "E": rng.normal(0, scale, (width, hidden)),
            "e": np.zeros(hidden),
            "V": rng.normal(0, 0.2, (hidden, hidden)),
            "U": rng.normal(0, 0.2, (hidden, hidden)),
            "w": rng.normal(0, 0.2, hidden),
            "c": rng.normal(0, 0.2, hidden),
            "b": np.zeros(1),
        }
        self.mean = np.zeros(width)
        self.sd = np.ones(width)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        starts, count = first[:-1], np.diff(first)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), count))
        a /= np.repeat(np.add.reduceat(a, starts), count)
        z = np.add.reduceat(h * a[:, None], starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -40, 40)))
        return y, {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "count": count, "starts": starts}

    def gradients(self, y: np.ndarray, target: np.ndarray, k: dict) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        d = (y - target) / len(y)
        g["c"], g["b"] = k["z"].T @ d, np.array([d.sum()])
        dz = np.repeat(d[:, None] * p["c"], k["count"], axis=0)
        da = (dz * k["h"]).sum(1)
        da = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, k["starts"]), k["count"]))
        g["w"] = (k["t"] * k["s"]).T @ da
        dg = da[:, None] * p["w"]
        dt, ds = dg * k["s"] * (1 - k["t"] ** 2), dg * k["t"] * k["s"] * (1 - k["s"])
        g["V"], g["U"] = k["h"].T @ dt, k["h"].T @ ds
        dh = (dz * k["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - k["h"] ** 2)
        g["E"], g["e"] = k["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 30, rate: float = 5e-3, decay: float = 1e-4) -> Network:
        x, first = encode_all(texts)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.sd
        rng = np.random.default_rng(5)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), 64):
                own = order[at : at + 64]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
                bounds = np.concatenate(([0], np.cumsum(np.diff(first)[own])))
                y, kept = self.forward(x[rows], bounds)
                y = labels[own] + (y - labels[own]) * weight[own]
                g = self.gradients(y, labels[own], kept)
                step += 1
                for k in self.p:
                    grad = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    lr = rate * (1 - 0.9 * epoch / epochs)
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.mean, self.sd = self.mean.astype(np.float32), self.sd.astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, first = encode_all(texts)
        return self.forward((x - self.mean) / self.sd, first)[0].astype(np.float64)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``most`` labelled rows of each class, chosen by a hash of their ids.

    Of each class they stop with the text that reaches ``SAMPLE_BYTES``. The chosen ids, at most twice ``most`` rows, are broadcast; rows of ``docs`` with one id are all taken, up to the same number again.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y"))
    own = own.filter(learn & F.col("y").isin(0, 1)).groupBy("label_id").agg(F.max("y").alias("y"))
    mixed = F.xxhash64("label_id", F.lit(17))
    chosen = own.filter("y = 0").orderBy(mixed).limit(most).unionByName(own.filter("y = 1").orderBy(mixed).limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    one = rows.groupBy("label_id").agg(F.min(F.struct("text", "y")).alias("r")).select("label_id", "r.text", "r.y")
    held = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(
        Window.partitionBy("y").orderBy(mixed, "label_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    one = one.withColumn("held", held).filter(F.coalesce("held", F.lit(0)) < SAMPLE_BYTES)
    return [(r["text"], r["y"]) for r in sorted(one.collect(), key=lambda r: r["label_id"])]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> Network | None:
    """The network, from labelled rows for which ``learn`` (on ``label_id``) holds; None without both classes."""
    rows = sample_labelled(docs, labels, "quality", learn, most)
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return Network().fit([(r[0] or "").encode() for r in rows], y)


def score(docs: DataFrame, network: Network | None, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1), in place of one of that name.

    Null and empty texts are one empty passage and get a score too; without a network all get 0.5.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = [x or b"" for x in utf8(batch.column("text"))]
                found = np.full(len(texts), 0.5) if network is None else network.score(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.5) -> DataFrame:
    """``docs`` that score at least ``threshold``; columns unchanged."""
    name = "_" + "_".join(docs.columns)  # no column of docs has it
    return score(docs, fit(docs, labels, learn), name).filter(F.col(name) >= threshold).drop(name)
