"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector over hashed byte n-grams (two and three bytes, lower case,
ASCII non-letters as space): ``log1p`` counts times inverse document frequency,
of unit length. Each language gets ``CENTROIDS`` centroids by spherical k-means;
a text takes the language of the nearest centroid by cosine, and is *rejected*
where that cosine is below the centroid's ``REJECT`` quantile of its own members.

Document frequencies cover every learning row. The centroids are fitted on a
sample: about ``SAMPLE`` rows a language, chosen by a hash of the id. Vectors and
nearest centroids are computed for whole texts, where the texts are.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing was learned; a row with a null id or language is
never learned from; ties go to the first language by name; equal rows get equal
results; an empty table gives an empty table; only id, text and language columns
are read, and the language only of learning rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Hashed n-grams.
DIMENSIONS = 1 << 12
#: Expected rows a language that centroids are fitted on, and most centroids.
SAMPLE = 1_500
CENTROIDS = 4
REJECT = 0.01
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b in b"abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in range(256))


def counts_of(text: str) -> np.ndarray:
    """Counts of hashed n-grams, as floats."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = (raw[:-1] << np.uint32(8)) | raw[1:]
    three = (two[:-1] << np.uint32(8)) | raw[2:]
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    both = np.concatenate([(two + np.uint32(1 << 24)) * np.uint32(2654435761), three * np.uint32(2654435761)]) >> shift
    return np.bincount(both, minlength=DIMENSIONS).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def spherical_means(vectors: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by farthest-first seeds and Lloyd rounds, and each centroid's rejection cosine."""
    seeds = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centroids = vectors[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    similar = vectors @ centroids.T
    own = np.argmax(similar, axis=1)
    limits = np.array([np.quantile(similar[own == c, c], REJECT) if (own == c).any() else 0.0 for c in range(len(centroids))])
    return centroids, limits


def _document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Learning rows with a letter, and in how many of them each n-gram is; a few partial sums reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIMENSIONS)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if has_letter(value):
                    n += 1
                    seen += counts_of(value) > 0
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tobytes()])], ["n", "seen"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIMENSIONS)
        for batch in batches:
            for more, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += more
                seen += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tobytes()])], ["n", "seen"])

    schema = "n bigint, seen binary"
    parts = rows.mapInArrow(each, schema).repartition(8).mapInArrow(total, schema).collect()
    return sum(r[0] for r in parts), sum((np.frombuffer(r[1]) for r in parts), np.zeros(DIMENSIONS))


def fit(rows: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """The model learned from ``rows``: languages, centroids, rejection limits and inverse document frequencies."""
    ship(rows.sparkSession)
    rows = rows.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull())
    n, seen = _document_frequencies(rows.select(text))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    sizes = rows.groupBy(lang).agg(F.count(F.lit(1)).alias("__n"))
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.lit("centroids")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).alias("__draw")
    chosen = rows.select(lang, text, draw).join(F.broadcast(sizes), lang).where(F.col("__draw") * F.col("__n") < F.lit(sample)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(a, weighted(counts_of(b), idf).astype(np.float32).tobytes()) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(b)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], ["lang", "vector"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        raws = sorted(group["vector"])  # the same order whatever the partitioning
        found, limits = spherical_means(np.frombuffer(b"".join(raws), np.float32).reshape(-1, DIMENSIONS), centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(found)), "limit": limits, "centroid": [c.astype(np.float32).tobytes() for c in found]})

    fitted = chosen.mapInArrow(vectors, "lang string, vector binary").groupBy("lang").applyInPandas(cluster, "lang string, k int, `limit` double, centroid binary").collect()
    fitted = sorted(fitted, key=lambda r: (r["lang"], r["k"]))
    matrix = np.frombuffer(b"".join(r["centroid"] for r in fitted), np.float32).reshape(-1, DIMENSIONS)
    return {"langs": [r["lang"] for r in fitted], "limits": np.array([r["limit"] for r in fitted]), "centroids": matrix, "idf": idf}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string), ``score`` (double, 0 to 1) and ``rejected`` (boolean)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = rest.index(text)
    out = [c for c in rest if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [True] * len(texts)
            useful = [i for i, t in enumerate(texts) if has_letter(t)] if known["langs"] else []
            for lo in range(0, len(useful), 256):
                part = useful[lo : lo + 256]
                similar = weighted(np.stack([counts_of(texts[i]) for i in part]), known["idf"]) @ known["centroids"].T
                best = np.argmax(similar, axis=1)
                for i, b, s in zip(part, best.tolist(), similar[np.arange(len(part)), best].tolist()):
                    langs[i], scores[i], rejected[i] = known["langs"][b], min(1.0, max(0.0, s)), s < known["limits"][b]
            more = [pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(rest.index(c)) for c in out), *more], [*out, "lang_pred", "score", "rejected"])

    kinds = dict(docs.dtypes)
    return docs.select(*rest).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in out] + ["lang_pred string, score double, rejected boolean"]))


def remainder(id_col: str, by: int) -> Column:
    """``crc32`` of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % by


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, by: int = 5) -> DataFrame:
    """``id_col, held_out, lang_pred, score, rejected`` of every row, learned from the rows that are not held out."""
    held_out = F.coalesce(remainder(id_col, by) == 0, F.lit(False))
    model = fit(docs.where(~held_out).select(id_col, text, lang), id_col, text, lang)
    return predict(docs.select(id_col, text, held_out.alias("held_out")), model, text).select(id_col, "held_out", "lang_pred", "score", "rejected")
