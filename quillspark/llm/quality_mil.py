"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded (shares of byte
classes, hashed byte pairs, how much it repeats itself), goes through a small dense layer,
and gets a gated attention weight, tanh(Vh) * sigmoid(Uh), normalised over the document;
the weighted mean of the passages' representations is scored. Encoder, attention and score
are learned together from document labels alone.

The model is fitted on a bounded sample of labelled rows, each with its whole text: in the order
of a hash at most MOST_LABELLED, of which one joins while it fits into MOST_PASSAGES passages
in all. Equal rows of one doc_id count once. Their features are what the driver gets, at most 76 MB;
all documents are scored in one pass, by all their passages. Rows whose crc32(doc_id as text) mod 5
is 0 are held out. Only texts are inputs.

Defined results: null and empty texts are one empty passage and get a score like all
others; null labels teach nothing; without any label the score is 0.5; long texts have
more passages; equal texts get equal scores; rows without doc_id aren't held out, and no label
meets them; different texts of one labelled doc_id are labelled rows each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import slices, table, whole_text

#: The bound on the labelled rows that the classifier is fitted to: their number, and their passages in all.
MOST_LABELLED, MOST_PASSAGES = 3000, 192_000
PASSAGE, HASHED, HIDDEN, GATE = 512, 128, 16, 8
STEPS, RATE, DECAY, SEED = 160, 0.02, 1e-4, 7
CUT = 0.3


def _classes() -> np.ndarray:
    """Byte classes: control, space, line end, digit, lower, upper, beyond ASCII, and each mark in one of 16."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 1 if c in " \t" else 2 if c in "\n\r" else 0 if b < 32 or b == 127 else 3 if c.isdigit() else 4 if "a" <= c <= "z" else 5 if "A" <= c <= "Z" else 6 if b >= 128 else 7 + b % 16
    return out


CLASS = _classes()
CLASSES = 23
FEATURES = 2 * CLASSES + HASHED + 2


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and where each text's passages begin."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rows = int(counts.sum())
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = np.repeat(first, sizes) + within // PASSAGE
    kind = CLASS[data]
    n = np.maximum(1, np.bincount(of, minlength=rows))[:, None]
    shares = np.bincount(of * CLASSES + kind, minlength=rows * CLASSES).reshape(rows, CLASSES) / n
    pair_of = of[1:][of[1:] == of[:-1]]
    both = (data[:-1].astype(np.int64) << 8 | data[1:])[of[1:] == of[:-1]]
    hashed = np.bincount(pair_of * HASHED + ((both * 40503 >> 4) % HASHED), minlength=rows * HASHED).reshape(rows, HASHED) / n
    turns = np.bincount((of[1:] * CLASSES + kind[1:])[(of[1:] == of[:-1]) & (kind[1:] != kind[:-1])], minlength=rows * CLASSES).reshape(rows, CLASSES) / n
    full = np.minimum(1, n / PASSAGE)
    spread = (hashed > 0).mean(1, keepdims=True)
    return np.concatenate([np.sqrt(shares), np.sqrt(hashed), np.sqrt(turns), full, spread], 1).astype(np.float32), first


@dataclass
class Model:
    """Weights; features are centred and scaled first."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        e = np.exp(np.clip((t * g) @ w["a"], -30, 30))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        weight = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(h * weight[:, None], first)
        return h, t, g, of, weight, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, first)[-1]

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> None:
        """Full batches with Adam on the log loss; each label weighs by the root of its rarity."""
        x = (x - self.mean) / self.scale
        rate = np.clip(label.mean(), 0.02, 0.98)
        worth = np.where(label > 0, np.sqrt(0.5 / rate), np.sqrt(0.5 / (1 - rate)))
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            w = self.w
            h, t, g, of, weight, z, p = self._forward(x, first)
            err = worth * (p - label) / len(label)
            dz = err[:, None] * w["c"]
            pull = (h * dz[of]).sum(1)
            de = weight * (pull - np.add.reduceat(weight * pull, first)[of])
            dt, dg = de[:, None] * w["a"] * g * (1 - t**2), de[:, None] * w["a"] * t * g * (1 - g)
            dh = (weight[:, None] * dz[of] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ err, "d": err.sum(keepdims=True)}
            for k in w:
                d = grad[k] + DECAY * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def new_model(x: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    return Model(x.mean(0), x.std(0) + 0.02, w)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitting(sizes: list[int], most: int) -> list[bool]:
    """Which texts of these sizes (bytes), first come first, fit into most passages in all."""
    out, left = [], most
    for n in sizes:
        passages = max(1, -(-n // PASSAGE))
        out.append(passages <= left)
        left -= passages * out[-1]
    return out


def sample(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """doc_id, quality, _hash and text of the labelled rows that the model is fitted to.

    Labels and the sampled rows' hashes are bounded before they meet the texts, so they may be broadcast."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.withColumn("_hash", F.xxhash64("doc_id", "text"))
    # However often a doc_id is there, the driver gets a number of most_labelled rows at most.
    sizes = rows.groupBy("doc_id", "_hash").agg(F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "_hash").limit(most_labelled).collect()
    kept = [(r.doc_id, r["_hash"]) for r, fits in zip(sizes, fitting([r.n for r in sizes], most_passages), strict=True) if fits]
    chosen = docs.sparkSession.createDataFrame(kept, "doc_id long, _hash long")
    return rows.join(F.broadcast(chosen), ["doc_id", "_hash"]).groupBy("doc_id", "_hash").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of labels.quality (0 or 1) from documents that aren't held out; None if there are no labels."""
    rows = sample(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, first = encode(batch.column("text").to_pylist())
            parts = [p.astype("<f2").tobytes() for p in np.split(x, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.binary())], ["doc_id", "quality", "x"])

    got = sorted((r.doc_id, bytes(r.x), r.quality) for r in rows.mapInArrow(run, "doc_id long, quality int, x binary").toLocalIterator())
    if not got:
        return None
    bags = [np.frombuffer(x, "<f2").reshape(-1, FEATURES).astype(np.float32) for _, x, _ in got]
    first = np.cumsum([0] + [len(b) for b in bags[:-1]])
    x = np.concatenate(bags)
    model = new_model(x)
    model.fit(x, first, np.array([q for *_, q in got], float))
    return model


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and score. One pass, no shuffle."""
    kept = docs.select(*keep, F.encode(whole_text(), "UTF-8").alias("_text"))
    names = list(keep)
    schema = kept.select(*keep, F.lit(0.5).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            found = model.score(*encode(batch.column("_text").to_pylist())) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found.astype(float))], [*names, "score"])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, and predicted: 1 where the score is CUT or more."""
    return score(docs, train(docs, labels), keep).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_mil": op6_quality_mil}
SQL: dict[str, str] = {}
