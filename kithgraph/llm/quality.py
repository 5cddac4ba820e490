"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.rows import map_texts

#: Classes of bytes; pairs of neighbouring classes are terms.  Bytes of non-ASCII characters count as small letters.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",;:", "!", "?", "'\"`", "()[]{}", "|", "*", "#", "$%&@", "<>=/\\", "-_+~^"]
WIDTH = len(CLASSES) + 1
#: A word's n-th occurrence in its text is a term too: first, second, 3 to 4, 5 to 8 and so on.
REPEATS = 16
TERMS = WIDTH * WIDTH + REPEATS


def _classes() -> np.ndarray:
    of = np.full(256, len(CLASSES), np.int64)
    of[128:] = 0
    for k, members in enumerate(CLASSES):
        of[list(members.encode())] = k
    return of


CLASS_OF = _classes()


def terms(text: str) -> np.ndarray:
    """Shares of the terms in a whole text: pairs of character classes, and repetitions of words."""
    out = np.zeros(TERMS)
    kinds = CLASS_OF[np.frombuffer(text.encode(), np.uint8)]
    if len(kinds) > 1:
        out[: WIDTH * WIDTH] = np.bincount(kinds[:-1] * WIDTH + kinds[1:], minlength=WIDTH * WIDTH) / (len(kinds) - 1)
    counts = np.fromiter(Counter(text.split()).values(), np.int64)
    if len(counts):
        low = 0
        for k in range(REPEATS):
            high = 1 << k
            out[WIDTH * WIDTH + k] = np.clip(counts - low, 0, high - low).sum()
            low = high
        out[WIDTH * WIDTH :] /= counts.sum()
    return out


@dataclass
class Model:
    """weight: of terms; axes: of the latent space; vectors, labels: of the labelled sample."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def project(self, shares: np.ndarray) -> np.ndarray:
        v = np.sqrt(shares) * self.weight @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-12)

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Exact cosines with every labelled vector; neighbours that tie with the last one all vote."""
        if not len(self.labels):
            return np.full(len(shares), self.prior)
        near = np.round(self.project(shares) @ self.vectors.T, 9)
        k = min(self.neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where((near >= least) & (near > 0), np.clip(near, 0, 1) ** self.sharpness, 0.0)
        total = weight.sum(axis=1)
        votes = np.divide(weight @ self.labels, total, out=np.full(len(total), self.prior), where=total > 0)
        return np.clip(votes, 0.0, 1.0)


def fit(shares: np.ndarray, labels: np.ndarray, dimensions: int = 24, neighbours: int = 15, sharpness: float = 8.0) -> Model:
    """Latent-semantic axes by singular values of the weighted term matrix of the labelled rows."""
    if not len(labels):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5, neighbours, sharpness)
    present = (shares > 0).sum(axis=0)
    weight = np.log1p(len(labels) / (1.0 + present))
    _, _, right = np.linalg.svd(np.sqrt(shares) * weight, full_matrices=False)
    model = Model(weight, right[:dimensions].T, np.zeros((0, 1)), labels.astype(float), float(labels.mean()), neighbours, sharpness)
    model.vectors = model.project(shares)
    return model


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most `most_rows` labelled documents whose crc32 remainder isn't 0.

    They are those with the lowest hash of their id; ids without a document, null ids and null
    labels are left out, and of an id that several rows have one text counts.  At most most_rows
    term vectors come to the driver.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    chosen = chosen.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__id", "__y").limit(most_rows)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    # One text for each label: ids may repeat in docs.
    found = found.groupBy(F.struct("__id", "__y").alias("key")).agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    rows = map_texts(found, "key", "text", "shares array<double>", lambda: lambda texts: [[terms(t).tolist() for t in texts]]).collect()
    rows.sort(key=lambda r: (r["key"]["__id"], r["key"]["__y"], r["shares"]))
    return fit(np.array([r["shares"] for r in rows]).reshape(-1, TERMS), np.array([r["key"]["__y"] for r in rows]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row, from its whole text alone.

    A text without terms (null, empty) has the sample's share of label 1 as its score; equal texts
    have equal scores, and very long ones are read whole in memory in proportion to their length.  The model
    holds at most the sample's rows, so its broadcast does not grow with the input.
    """
    out = map_texts(docs, id_col, text_col, "score double", _scores(docs, model))
    return out.select(id_col, (remainder(F.col(id_col)) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `threshold`.

    Texts without terms (null, empty) have the sample's share of label 1; repeated rows are decided alike.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(text_col).alias("text"))
    scored = map_texts(packed, "row", "text", "score double", _scores(docs, model))
    return scored.where(F.col("score") >= threshold).select(*(F.col("row")[c].alias(c) for c in columns))


def _scores(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: [[s for at in range(0, len(texts), 256) for s in own.score(np.array([terms(t) for t in texts[at : at + 256]])).tolist()]]

    return make
