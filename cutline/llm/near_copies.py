"""Near copies: documents whose sets of word shingles have a Jaccard similarity of ``NUM / DEN`` or more.

Every link is confirmed on the shingle sets themselves.

*Nodes.* Rows with equal shingle sets are one node.

*Candidates.* Shingles have one fixed order: those common in a sample of the texts
last, then by hash. Two sets that are similar enough share one of their first
``n - ceil(n * NUM / DEN) + 1`` shingles, whatever the order (prefix filtering); the
order only keeps common shingles out of prefixes. Prefixes are dealt by shingle,
and those that no other node has go no further.

*Rounds.* First, candidates are the links that the SimHash index gives and, for each
shingle, the pairs of its nodes with its first ``CENTRES`` ones whose sizes and
places in the prefixes allow the similarity; then, for each shingle that more nodes
have, the pairs with the first nodes of its first ``CENTRES`` components. That makes
groups of near copies, however large, one component each, and writes no more than
``2 * CENTRES`` pairs a node and shingle. Left are shingles of over ``CENTRES + 1``
nodes which are still of several components: up to ``FEW`` nodes, all pairs of
different components are tried whose sizes and places allow the similarity. They
meet in the task that has the shingle, which compares bitmaps and sends on only the
pairs whose bitmaps are near; so what is written and joined follows the near pairs,
not the square of a shingle's nodes. Components and bitmaps are joined a row a node,
before its shingles or signatures are dealt.

*Signatures.* Nodes of yet more crowded shingles meet by parts of their sets. Two
sets of ``n`` and ``m`` shingles are similar enough only if they differ in at most
``(n + m) (DEN - NUM) / (DEN + NUM)`` shingles. Shingles are dealt to so many parts by
hash that some part has ``k`` differences at most, and each part to ``j`` cells, of
which ``j - k`` are then equal; so every choice of ``j - k`` cells of every part is a
signature, and similar sets share one. A signature stands for several shingles at
once, so passages that many texts share don't make it common; only sets that agree
in all of a part do. All pairs of a signature's nodes of different components are
tried. Nodes whose signature more than ``TRIED`` nodes have go on to the next of
``LEVELS``, with longer signatures; the last has no limit. So no link is lost.

Candidates are confirmed in a join with both sets, which hold 32 bits of each
shingle's hash there: two sets of 1,000 shingles share 0.0002 by chance. Their
bitmaps are compared first: each shingle flips one of ``BITMAP`` bits, so two
bitmaps differ in no more bits than the sets in shingles.

Defined results: words and nulls as in ``simhash``; texts without a word are one
node; fewer words than a shingle make one shingle of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, keep_bucketed, keep_only, opened, ship
from .simhash import bucket_links, components, one_each

SHINGLE = 5
#: Nodes of a shingle that all its others are tried with at first.
CENTRES = 8
#: Signatures of crowded nodes: differences allowed in a part and cells of a part, level by level, and the nodes of a signature whose pairs are all tried before the last level.
LEVELS, TRIED = ((1, 3), (2, 5), (4, 8)), 32_768
#: Nodes of a shingle of several components whose pairs are all tried. A pair costs its task some 10 ns, a node's signatures some hundreds of shuffled rows.
FEW = 32_768
#: Near pairs that a task gathers before it sends them on.
GATHERED = 100_000
BITMAP = 1_024
NUM, DEN = 4, 5
#: Texts of the sample that tells common shingles, how often one is there to be common, and how many are told.
SAMPLE, COMMON, TOLD = 20_000, 8, 50_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(own))
    found = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        found = (found ^ (found >> np.uint64(31))) * _STEP + own[k : len(own) - size + 1 + k]
    found ^= found >> np.uint64(32)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return np.unique(found)


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set, as a signed long."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def _common(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are common in a sample of the texts, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(value.as_py(), shingle).view(np.int64))], ["s"])

    parts = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(F.lit(7), text), F.lit(parts)) == 0).select(text)
    rows = sample.mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = rows.orderBy(F.desc("n"), "s").limit(TOLD).collect()
    told = np.array([r["s"] for r in rows], np.int64).view(np.uint64)
    back = np.argsort(told)
    return told[back], np.array([r["n"] for r in rows], np.int64)[back]


def _prefix(hashes: np.ndarray, told: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(hashes)
    size = n - -(-n * NUM // DEN) + 1
    if not len(told):
        return hashes[:size]
    at = np.minimum(np.searchsorted(told, hashes), len(told) - 1)
    seen = np.where(told[at] == hashes, counts[at], 0)
    return hashes[np.argsort(seen, kind="stable")[:size]]


def _rows(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """``id, k, node, n, fp`` of each row, and ``prefix`` where its task met the node first."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, text, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            nodes, sizes, fps, prefixes = [], [], [], []
            for value in batch.column(1):
                hashes = shingle_set(value.as_py(), shingle)
                node = _node(hashes)
                nodes.append(node)
                sizes.append(len(hashes))
                fps.append(majority(hashes))
                prefixes.append(None if node in met else _prefix(hashes, *sent.value).view(np.int64))
                met.add(node)
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "k", "node", "n", "fp", "prefix"])

    return docs.select(id_col, text, F.xxhash64(text).alias("__k")).mapInArrow(run, f"id {kind}, k bigint, node bigint, n int, fp bigint, prefix array<bigint>")


def _starred(dealt: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of a shingle's nodes with the first ones of its first components, and ``s, node, n, at`` of the rows of shingles with more than two nodes.

    ``dealt (s, root, node, sizes)`` is sorted and whole by shingle in its partitions;
    a task holds a batch, and of a shingle that goes on its centres.
    """
    names = ["s", "node", "n", "at", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]  # the last: already sent on

        def send(s: np.ndarray, root: np.ndarray, node: np.ndarray, sizes: np.ndarray, done: np.ndarray, ended: bool) -> pa.RecordBatch:
            nonlocal carry
            n, at = sizes >> 32, sizes & 0xFFFFFFFF
            new = np.r_[True, s[1:] != s[:-1]]
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            counts = np.diff(np.r_[starts, len(s)])
            change = new | np.r_[True, root[1:] != root[:-1]]
            ordinal = np.cumsum(change) - np.cumsum(change)[starts][group]
            centres = np.full((len(starts), CENTRES), -1, np.int64)
            own = np.flatnonzero(change & (ordinal < CENTRES))
            centres[group[own], ordinal[own]] = own
            open_ = ~done
            if not ended:
                last = int(starts[-1])
                if counts[-1] < 3:  # not yet known whether more follow
                    open_[last:] = False
                    carry = [x[last:] for x in (s, root, node, sizes, done)]
                else:
                    kept = centres[-1][centres[-1] >= 0]
                    stay = np.unique(np.r_[kept, np.arange(last, last + 3), len(s) - 1])
                    carry = [*(x[stay] for x in (s, root, node, sizes)), np.ones(len(stay), bool)]
            place, found = np.arange(len(s)), []
            for k in range(CENTRES):
                c = centres[group, k]
                fit = open_ & (c >= 0) & (c < place)
                fit[fit] = (root[c[fit]] != root[fit]) & _may_link(n[fit], at[fit], n[c[fit]], at[c[fit]])
                found.append(np.column_stack([node[c[fit]], node[fit]]))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            out = open_ & (counts[group] > 2)
            left, right = (lambda x: pa.concat_arrays([x, pa.nulls(len(pairs), x.type)])), (lambda x: pa.concat_arrays([pa.nulls(int(out.sum()), x.type), x]))
            columns = [pa.array(s[out]), pa.array(node[out]), pa.array(n[out].astype("i4")), pa.array(at[out].astype("i4"))]
            return pa.RecordBatch.from_arrays([*map(left, columns), right(pa.array(pairs[:, 0])), right(pa.array(pairs[:, 1]))], names)

        for batch in batches:
            if batch.num_rows:
                s, root, node, sizes = (np.concatenate([a, b.to_numpy()]) for a, b in zip(carry, batch.columns))
                done = np.r_[carry[4], np.zeros(batch.num_rows, bool)]
                fresh = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])]
                yield send(s[fresh], root[fresh], node[fresh], sizes[fresh], done[fresh], False)
        if len(carry[0]):
            yield send(*carry, True)

    return dealt.select("s", "root", "node", "sizes").mapInArrow(run, "s bigint, node bigint, n int, at int, a bigint, b bigint")


def _packed(n: str = "n", at: str = "at") -> Column:
    return F.shiftleft(F.col(n).cast("long"), 32).bitwiseOR(F.col(at).cast("long")).alias("sizes")


def _shared(rows: DataFrame) -> DataFrame:
    """``_starred`` of all prefixes, every node a component of its own."""
    flat = rows.where("prefix IS NOT NULL").select("node", "n", F.posexplode("prefix").alias("at", "s")).select("s", "node", _packed())
    return _starred(flat.repartition("s").sortWithinPartitions("s", "node").withColumn("root", F.col("node")))


def _may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles can be similar if the first they share stands at ``at`` and ``to``."""
    return (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & ((NUM + DEN) * np.minimum(n - at, m - to) >= NUM * (n + m))


#: Bounds of the sizes' classes: sets that are similar enough are of one class or of neighbouring ones.
_CLASSES = np.cumprod(np.r_[1.0, np.full(200, DEN / NUM)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def signatures(hashes: np.ndarray, level: int) -> np.ndarray:
    """Keys of a set (32-bit hashes), at least one of which it shares with every set that is similar enough."""
    slack, cells = LEVELS[level]
    own = _mixed(hashes.astype(np.uint64) * _STEP + np.uint64(level + 1))
    size = int(np.searchsorted(_CLASSES, len(hashes), side="right")) - 1
    out = []
    for lower in (size, size - 1):  # pairs of one class and the next meet under the lower class
        if lower < 0:
            continue
        most = int((_CLASSES[lower + 1] + _CLASSES[lower + 2]) * (DEN - NUM) / (DEN + NUM))
        parts = most // (slack + 1) + 1
        part, cell = (own >> np.uint64(40)) % np.uint64(parts), (own >> np.uint64(20)) % np.uint64(cells)
        sums = np.zeros(parts * cells, np.uint64)
        np.add.at(sums, (part * np.uint64(cells) + cell).astype(np.int64), own)
        sums = _mixed(sums.reshape(parts, cells) + np.arange(1, cells + 1, dtype=np.uint64) * _STEP)
        base = np.arange(parts, dtype=np.uint64) * _MIX + np.uint64(lower * 1_000 + level)
        for k, chosen in enumerate(combinations(range(cells), cells - slack)):
            out.append(_mixed(base + np.uint64(k * int(_STEP) % 2**64) + sums[:, chosen].sum(axis=1, dtype=np.uint64)))
    return np.unique(np.concatenate(out)).view(np.int64)


def _signed(sets: DataFrame, level: int) -> DataFrame:
    """``key, root, node, n, at, bits`` for every signature of ``sets (root, node, bits, hashes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, node, bits, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.frombuffer(raw, np.uint32)
                keys = signatures(hashes, level)
                same = lambda x, kind, k=len(keys): pa.array(np.full(k, x, kind))
                columns = [pa.array(keys), same(root, np.int64), same(node, np.int64), same(len(hashes), np.int32), same(0, np.int32), pa.array([bits] * len(keys), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "root", "node", "n", "at", "bits"])

    return sets.select("root", "node", "bits", "hashes").mapInArrow(run, "key bigint, root bigint, node bigint, n int, at int, bits binary")


def _crossing(dealt: DataFrame, limit: int | None) -> DataFrame:
    """Pairs ``a, b`` of nodes of one key, of different roots, with sizes and places that allow the similarity and with near bitmaps; and, with ``b`` null, the nodes of keys with over ``limit`` nodes.

    ``dealt (key, root, node, n, at, bits)`` is sorted and whole by key in its partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64)] * 5 + [np.zeros((0, BITMAP // 64), np.uint64)]

        def send(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def solve(key: np.ndarray, root: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            few = several & (sizes <= limit) if limit else several
            over = np.repeat(several & ~few, sizes)
            if over.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[over])), pa.nulls(len(np.unique(node[over])), pa.int64())], ["a", "b"])
            kept = np.repeat(few, sizes)
            root, node, n, at, bits = root[kept], node[kept], n[kept], at[kept], bits[kept]
            stops = np.repeat(np.cumsum(sizes[few]), sizes[few])
            near, step, found = np.arange(len(stops)), 1, []
            while len(near := near[near + step < stops[near]]):  # rows with a row of their key ``step`` further on
                far = near + step
                fit = root[near] != root[far]
                fit[fit] = _may_link(n[near[fit]], at[near[fit]], n[far[fit]], at[far[fit]])
                a, b = near[fit], far[fit]
                alike = _alike(bits[a], bits[b], n[a] + n[b])
                if alike.any():
                    found.append(np.column_stack([node[a[alike]], node[b[alike]]]))
                    if sum(map(len, found)) >= GATHERED:
                        yield send(found)
                        found = []
                step += 1
            if found:
                yield send(found)

        for batch in batches:
            if batch.num_rows:
                own = [*(c.to_numpy().astype(np.int64) for c in batch.columns[:5]), _words(batch.column(5))]
                rows = [np.concatenate(x) for x in zip(carry, own, strict=True)]
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                if last:
                    yield from solve(*[x[:last] for x in rows])
                carry = [x[last:] for x in rows]
                if limit and len(carry[0]) > 4 * limit and (carry[1] != carry[1][0]).any():  # it is over the limit: what has been seen goes on, enough stays to tell
                    yield from solve(*carry)
                    edge = np.unique(np.r_[0, np.flatnonzero(carry[1] != carry[1][0])[:1], np.arange(len(carry[0]) - limit, len(carry[0]))])
                    carry = [x[edge] for x in carry]
        if len(carry[0]):
            yield from solve(*carry)

    return dealt.select("key", "root", "node", "n", "at", "bits").mapInArrow(run, "a bigint, b bigint")


def _bitmap(hashes: np.ndarray) -> bytes:
    odd = np.bincount((_mixed(hashes.astype(np.uint64)) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _words(bitmaps: pa.Array) -> np.ndarray:
    """Bitmaps as rows of 64-bit words."""
    return np.frombuffer(b"".join(bitmaps.to_pylist()), np.uint64).reshape(len(bitmaps), -1)


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether bitmaps don't differ in more bits than their sets, of ``n`` shingles together, may in shingles."""
    return (NUM + DEN) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (DEN - NUM) * n


def _near_bitmaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets' bitmaps don't differ in more bits than the sets may in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_alike(_words(batch.column("ba")), _words(batch.column("bb")), n)))

    first, second = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a bigint, b bigint")


def _in_components(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    """``nodes`` (a row a node) with ``root``: their component, or themselves."""
    return nodes.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _dealt(nodes: DataFrame, *more: str) -> DataFrame:
    """``s, root, node, n, at`` and ``more`` for each of the ``places`` of ``nodes``."""
    return nodes.select("root", "node", "n", *more, F.explode("places").alias("p")).select("p.s", "root", "node", "n", "p.at", *more)


def _places(rows: DataFrame, *more: str) -> DataFrame:
    """A row a node of ``rows (s, node, n, at)``, with its shingles in ``places``."""
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *more)], F.collect_list(F.struct("s", "at")).alias("places"))


def _rest_of_crowds(crowded: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` with the links added that only shingles of many nodes can tell, given those found so far."""

    def crossing(dealt: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
        """Pairs to confirm, and nodes of keys beyond the limit."""
        found = keep(_crossing(dealt.repartition("key").sortWithinPartitions("key", "root", "node"), limit), "crossing")
        return found.where("b IS NOT NULL").distinct(), found.where("b IS NULL").select(F.col("a").alias("node")).distinct()

    rooted = keep(components(links), "components")
    whole = Window.partitionBy("s")
    seen = {"nodes": F.count(F.lit(1)).over(whole), "low": F.min("root").over(whole), "high": F.max("root").over(whole)}
    mixed = _dealt(_in_components(crowded, rooted)).withColumns(seen).where((F.col("nodes") > CENTRES + 1) & (F.col("low") != F.col("high")))
    mapped = _places(mixed, "root").join(sets.select("node", "bits"), "node")
    tried, crowd = crossing(_dealt(mapped, "bits").withColumnRenamed("s", "key"), FEW)
    for level in range(len(LEVELS) + 1):
        new = _confirmed(tried, sets)
        if not new.isEmpty():
            rooted = keep(components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "components")
        if level == len(LEVELS) or crowd.isEmpty():
            break
        signed = _signed(_in_components(sets.join(crowd, "node", "left_semi"), rooted), level)
        tried, crowd = crossing(signed, TRIED if level + 1 < len(LEVELS) else None)
    return rooted


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` (with near bitmaps) whose sets are similar enough, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                if len(x) > len(y):
                    x, y = y, x
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                found.append((NUM + DEN) * both >= NUM * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    first, second = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    return keep(pairs.join(first, "a").join(second, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a bigint, b bigint"), "confirmed")


def _sets(docs: DataFrame, id_col: str, text: str, shingle: int, nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """``node, n, bits, hashes`` for those of ``nodes (node, at)`` that are ``wanted``, bucketed by node: joins with it move the other side only; and the table's name."""
    wanted = wanted.join(nodes, "node").select("node", "at.id", "at.k")
    wanted = keep(wanted, "wanted").select("node", F.col("id").alias("__id"), F.col("k").alias("__k"))
    owners = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    texts = owners.join(wanted, owners.id.eqNullSafe(wanted["__id"]) & (F.xxhash64("t") == wanted["__k"])).select("node", "t")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            own, sizes, maps, hashes = [], [], [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node not in met:  # not another copy of the row
                    met.add(node)
                    found = (shingle_set(t.as_py(), shingle) >> np.uint64(32)).astype(np.uint32)
                    own.append(node)
                    sizes.append(len(found))
                    maps.append(_bitmap(found))
                    hashes.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), pa.array(hashes, pa.binary())], ["node", "n", "bits", "hashes"])

    return keep_bucketed(texts.mapInArrow(build, "node bigint, n int, bits binary, hashes binary"), "shingle-sets", "node")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def labelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """``id_col, k`` (a hash of the text) and ``root`` (the same for all rows of a group) of each row."""
    ship(docs.sparkSession)
    since = opened()
    rows = keep(_rows(docs, id_col, text, shingle), "shingle-nodes")
    shared = keep(_shared(rows), "shared-shingles")
    nodes = keep(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("at")), "nodes")

    fps = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = bucket_links(fps.select("fp")).join(fps.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    equal = nodes.join(fps.select("fp", F.col("node").alias("x")), "fp").select("x", F.col("node").alias("y"))
    star = shared.where("a IS NOT NULL").select(F.col("a").alias("x"), F.col("b").alias("y"))
    tried = near.select("x", "y").unionByName(equal).unionByName(star).where("x <> y")
    tried = keep(tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")

    # every later candidate is a node of a shared shingle, so texts are read for their sets once
    crowded = keep(_places(shared.where("s IS NOT NULL")), "crowded")
    sets, table = _sets(docs, id_col, text, shingle, nodes, _nodes_of(tried).unionByName(crowded.select("node")).distinct())
    links = _confirmed(keep(_near_bitmaps(tried, sets), "near-bitmaps"), sets)
    rooted = components(links)

    known = _dealt(_in_components(crowded, rooted)).select("s", "root", "node", _packed())
    rest = _starred(known.repartition("s").sortWithinPartitions("s", "root", "node")).where("a IS NOT NULL").select("a", "b").distinct()
    rest = keep(rest.join(tried, ["a", "b"], "left_anti"), "candidates")
    links = links.unionByName(_confirmed(keep(_near_bitmaps(rest, sets), "near-bitmaps"), sets))
    rooted = _rest_of_crowds(crowded, sets, links)
    named = rows.join(rooted, "node", "left")
    found = keep_only(named.select(F.col("id").alias(id_col), "k", F.coalesce("root", "node").alias("root")), "near-copies", since)
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group of near copies, chosen as ``simhash.keep_one`` does."""
    return one_each(docs, labelled(docs, id_col, text, shingle=shingle), id_col, text)
