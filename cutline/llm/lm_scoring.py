"""Language-model scoring: log-likelihood of whole documents under a gated recurrent model.

1. *Counts.* Every token of every learning row is counted (lower-cased A-Z, words
   between white space, then one end token). Tokens longer than ``KEY_BYTES`` are
   known by a digest, so a key's size is bounded.
2. *Codes.* The ``VOCABULARY`` most frequent tokens have codes, which are what every
   task holds (``VOCABULARY * KEY_BYTES`` bytes at most); all others share one code
   and are told apart by their counts, which a shuffle join brings. The text is read
   once more, for the codes of whole documents.
3. *Training.* All codes of all learning rows are learned from, each once, the end
   tokens too. Rows are dealt by their id to shards of about ``SHARD`` tokens and
   stand there in an order of their own. Each shard trains a copy of the weights by
   truncated backpropagation, with the state carried from window to window through
   whole documents; the copies of a round are averaged, and the next of ``ROUNDS``
   goes on from there with the other shards. Copies are summed as whole numbers, so
   the weights depend neither on partitions nor on their order.
4. *Scoring.* One pass over all codes, the state carried from the first token to the
   end token.

``score`` is a proper probability over training tokens and one unseen token. The
``CLASSES * MEMBERS`` most frequent tokens have a place in the classes of the
model's output; all further ones share a class, inside which a token with count
``c`` has ``(c + 1) / (n + v + 1)`` (``n`` tokens, ``v`` kinds in that class).

Defined results: a null or empty text is the end token alone; a row with a null id
is scored but never learned from; with nothing learned every base score is 0 and
the model is uniform over its classes; repeated rows are counted, learned from and
scored each; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as R
from .common import keep, ship
from .language import remainder

VOCABULARY = 1 << 17
KEY_BYTES = 32
#: Training tokens of a shard, on average.
SHARD = 2_000_000
ROUNDS = 2
RATE = 0.1
#: Distinct tokens that a counting task holds, and tokens that a scoring task gathers, before it sends them on.
COUNTED, GATHERED = 300_000, 2_000_000
#: Shards that one training task takes, one after another, where there are many.
SHARDS_A_TASK = 8
#: Sums of weights that one task adds, on average.
FAN_IN = 16
#: The end token's key; no word has white space.
END = b" "


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key_of(word: bytes) -> bytes:
    return word if len(word) < KEY_BYTES else b"\t" + hashlib.blake2b(word, digest_size=16).digest()


def token_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``token`` (key) and ``n`` over all of ``rows``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(key_of, found)), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

        found: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(words_of(value.as_py()))
                found[END] += 1
                if len(found) > COUNTED:
                    yield send()
                    found.clear()
        yield send()

    return rows.select(text).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Codes of frequent tokens and the logarithms a score needs."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, seen: tuple[int, int]):
        """``tokens`` most frequent first; ``seen``: tokens and kinds in all."""
        self.code = {t: i for i, t in enumerate(tokens)}
        self.rare = len(tokens)
        self.total, self.kinds = seen
        kept = R.CLASSES * R.MEMBERS
        self.counts = np.zeros((R.CLASSES, R.MEMBERS))
        self.counts.flat[: min(len(tokens), kept)] = counts[:kept]
        shared, shared_kinds = self.total - int(counts[:kept].sum()), self.kinds - min(len(tokens), kept)
        self.shared_total = shared + shared_kinds + 1
        self.mass = np.append(self.counts.sum(axis=1), shared)
        self.base = np.append(np.log10((counts + 1.0) / (self.total + self.kinds + 1)), 0.0)
        self.inside = np.append(np.log10((counts + 1.0) / self.shared_total), 0.0)
        self.inside[: min(len(tokens), kept)] = 0.0

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Codes of the words and the end token; ``self.rare`` for tokens outside."""
        get, rare = self.code.get, self.rare
        out = np.fromiter((get(w, rare) for w in words), np.int32, len(words))
        for i in np.flatnonzero(out == rare).tolist():
            if len(words[i]) >= KEY_BYTES:
                out[i] = get(key_of(words[i]), rare)
        return np.append(out, np.int32(get(END, rare)))

    def logarithms(self) -> tuple[np.ndarray, np.ndarray, int]:
        """What a scoring task needs."""
        return self.base, self.inside, self.rare


def build_vocabulary(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The most frequent tokens, by whole steps of a logarithmic scale of counts, so that ``size`` is never passed.

    The driver sees a row a step, then the chosen tokens; no task sends more.
    """
    step = F.floor(F.log2("n") * 64).alias("step")
    steps = sorted(counts.groupBy(step).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect(), key=lambda r: -r["step"])
    total, kinds = sum(r["n"] for r in steps), sum(r["kinds"] for r in steps)
    taken, lowest = 1, None
    for r in steps:
        if taken + r["kinds"] > size:
            break
        taken, lowest = taken + r["kinds"], r["step"]
    chosen = F.col("token") == END if lowest is None else (F.col("step") >= lowest) | (F.col("token") == END)
    top = counts.select("token", "n", step).where(chosen).select("token", "n").collect()
    top.sort(key=lambda r: (-r["n"], bytes(r["token"])))
    return Vocabulary([bytes(r["token"]) for r in top], np.array([r["n"] for r in top], np.int64), (total, kinds))


def encode(rows: DataFrame, sent) -> DataFrame:
    """``rows (id, text, held_out)`` with ``codes`` (little-endian 32-bit integers) and ``rare`` tokens for the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                codes, tokens, times, ends = [], [], [], [0]
                for value in part.column(1):
                    words = words_of(value.as_py())
                    own = known.codes(words)
                    out = Counter(key_of(words[i]) if i < len(words) else END for i in np.flatnonzero(own == known.rare).tolist())
                    codes.append(own.astype("<i4").tobytes())
                    tokens += out
                    times += out.values()
                    ends.append(len(tokens))
                rare = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], ["token", "n"])
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(codes, pa.binary()), rare], ["id", "held_out", "codes", "rare"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "text", "held_out").mapInArrow(run, f"id {kind}, held_out boolean, codes binary, rare array<struct<token: binary, n: bigint>>")


def _sums(n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])


#: Weights are summed as whole numbers of ``1 / UNIT``; they stay below 2**10, and so do sums of 2**21 copies below 2**63.
UNIT = float(1 << 32)


def _flat(weights: R.Weights) -> np.ndarray:
    return np.rint(np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype(np.float64) * UNIT).astype(np.int64)


def _unflat(flat: np.ndarray, like: R.Weights) -> R.Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(encoded: DataFrame, start: R.Weights, tokens: int, *, shard: int = SHARD, rounds: int = ROUNDS, rate: float = RATE) -> R.Weights:
    """Weights after all rows of ``encoded (id, codes)``, which have ``tokens`` codes; the driver gets one sum of them a round."""
    spark = encoded.sparkSession
    schema = "n bigint, total binary"
    each = max(1, round(tokens / (rounds * shard)))  # shards a round
    rows = encoded.select((F.pmod(F.xxhash64("id"), F.lit(each * rounds))).alias("shard"), F.xxhash64(F.lit(1), "id").alias("h"), "codes")
    tasks = max(-(-each // SHARDS_A_TASK), min(each, 4 * spark.sparkContext.defaultParallelism))
    weights = start
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        pace = rate / (1 + turn)

        def fit(batches: Iterator[pa.RecordBatch], sent=sent, pace=pace) -> Iterator[pa.RecordBatch]:
            n, total, current, documents = 0, 0, None, []

            def learned() -> np.ndarray:
                learner = R.Learner({k: v.copy() for k, v in sent.value.items()}, pace)
                R.train(learner, documents)
                return _flat(learner.weights)

            for batch in batches:
                for which, codes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if which != current and documents:
                        n, total, documents = n + 1, total + learned(), []
                    current = which
                    documents.append(np.frombuffer(codes, "<i4"))
            if documents:
                n, total = n + 1, total + learned()
            if n:
                yield _sums(n, total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0
            for batch in batches:
                for some, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n, total = n + some, total + np.frombuffer(raw, np.int64)
            if n:
                yield _sums(n, total)

        copies = rows.where(F.col("shard") % rounds == turn).repartition(tasks, "shard").sortWithinPartitions("shard", "h", "codes").mapInArrow(fit, schema)
        adders = tasks
        while adders > 1:  # no task adds many times the weights' size
            adders = -(-adders // FAN_IN)
            copies = copies.repartition(adders).mapInArrow(add, schema)
        for row in copies.collect():
            weights = _unflat(np.frombuffer(row["total"], np.int64) / (UNIT * row["n"]), weights)
        sent.unpersist()
    return weights


def _score(encoded: DataFrame, sent) -> DataFrame:
    """Scores of ``encoded (row, id, held_out, codes)`` without their rare tokens."""
    names = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (base, inside, rare), weights = sent.value
        columns: list[list[pa.Array]] = [[], [], []]
        kept: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            found = R.score(weights, kept) / np.log(10) + [inside[c].sum() for c in kept]
            more = [
                pa.array([len(c) for c in kept], pa.int64()),
                pa.array([int((c != rare).sum()) for c in kept], pa.int64()),
                pa.array([float(base[c].sum()) for c in kept], pa.float64()),
                pa.array(found, pa.float64()),
            ]
            return pa.RecordBatch.from_arrays([*map(pa.concat_arrays, columns), *more], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for k, c in enumerate(columns):
                    c.append(part.column(k))
                own = [np.frombuffer(c.as_py(), "<i4") for c in part.column(3)]
                kept += own
                size += sum(map(len, own))
                if size >= GATHERED:
                    yield send()
                    columns, kept, size = [[], [], []], [], 0
        if kept:
            yield send()

    kind = dict(encoded.dtypes)["id"]
    schema = f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return encoded.select("row", "id", "held_out", "codes").mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, by: int = 7, held: int = 2, vocabulary: int = VOCABULARY, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows whose id's ``crc32`` modulo ``by`` is ``held`` are not learned from.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = remainder(id_col, by)
    counts = keep(token_counts(docs.where(rest != held), text), "token-counts")
    known = build_vocabulary(counts, vocabulary)
    sent_known = spark.sparkContext.broadcast(known)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(rest == held, F.lit(False)).alias("held_out"))
    encoded = keep(encode(rows, sent_known).withColumn("row", F.monotonically_increasing_id()), "codes")
    learning = encoded.where("NOT held_out AND id IS NOT NULL")
    weights = train(learning, R.initial(known.mass, known.counts), known.total, shard=shard, rounds=rounds)
    scored = _score(encoded, spark.sparkContext.broadcast((known.logarithms(), weights)))
    outside = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    joined = outside.join(counts, "token", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    log = F.log10(F.col("c") + 1)
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum("times").alias("times"),
        F.sum(F.col("times") * log).alias("logs"),
    )
    own = scored.join(sums, "row", "left")
    times, logs = F.coalesce("times", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return own.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs - times * F.lit(float(np.log10(known.total + known.kinds + 1)))).alias("base_score"),
        (F.col("score") + logs - times * F.lit(float(np.log10(known.shared_total)))).alias("score"),
    )
