"""MinHash near-duplicates: many universal hash minima, bands, verified signatures, stars.

Texts are sets of five-word shingles; two are linked if a hundred times the size
of the intersection is at least ``PERCENT`` times that of the union.

1. Each text gets the hash of its set (128 bits) and the minima of ``HASHES``
   universal hash functions (a * x + b, upper half).  Equal sets are one node.
2. Nodes that agree in all minima of a band share a bucket.  In a bucket of up to
   ``PAIR_LIMIT`` nodes all pairs are candidates, in a larger one each node with
   the hub, the node that meets most others.
3. Signatures are verified first: a pair with fewer equal minima than a pair at
   the threshold has but with probability ``MISS`` goes; the others are
   confirmed on their full shingle sets.
4. Links become components by alternating large-star and small-star steps.
5. What is in a large bucket, but not in its hub's component, is compared with
   that component and with its own like, block against block.  A task joins what
   it links (union-find over its own blocks) and so confirms a pair only where
   that connects something new; the links that it gives back are a spanning
   forest, never the pairs of a group.  So components are those of all pairs that
   share a bucket, in groups of any size.

A pair at the threshold shares no band with probability (1 - 0.85 ** 5) ** 25,
4e-7.  Hashes and functions are fixed, so reruns agree.

* a text of fewer than five words has its whole sequence as its one shingle; null
  and empty texts and texts without words have no set (``n_shingles`` 0), link to
  nothing and are kept;
* a pair at exactly the threshold is linked;
* a null doc_id has a null component, links to nothing and is kept; rows that
  repeat a doc_id go each by its own text, repeated rows stay or go together;
* very long texts are read whole; doc_id may be of any type that has an order; an
  empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import _blocks, components
from .shared import arrow_scan, cut, fresh, join_sized, keep, meet, scratch
from .tokens import SPACED, chunks, mix, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
MISS = 1e-8
PAIR_LIMIT = 32

_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 20)) | np.uint64(1)
_B = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 40))


def least_equal(percent: int = PERCENT, miss: float = MISS) -> int:
    """The most equal minima that a pair at the threshold reaches with probability 1 - miss at least."""
    s, mass, m = percent / 100, 0.0, 0
    while True:
        mass += comb(HASHES, m) * s**m * (1 - s) ** (HASHES - m)
        if mass > miss:
            return m
        m += 1


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with so many shared shingles reach the threshold."""
    return 100 * common >= percent * (a + b - common)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for part in chunks(texts):
        words, offsets = word_hashes(texts[part], SPACED)
        out += [shingle_hashes(words[s:e], SHINGLE) for s, e in zip(offsets, offsets[1:])]
    return out


def minima(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, minima) of sets that are not empty."""
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    rows = np.zeros((len(sets), HASHES), np.uint32)
    begin = 0
    while begin < len(sets):  # some hundred kilobytes of shingles at a time
        end, size = begin + 1, len(sets[begin])
        while end < len(sets) and size + len(sets[end]) <= 1 << 16:
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *(len(s) for s in sets[begin : end - 1])])
        one[begin:end] = np.add.reduceat(joined, starts)
        two[begin:end] = np.add.reduceat(mix(joined ^ _A[0]), starts)
        for k in range(HASHES):
            rows[begin:end, k] = np.minimum.reduceat(joined * _A[k] + _B[k], starts) >> np.uint64(32)
        begin = end
    return one, two, rows


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint32).reshape(-1, HASHES)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2, sig per row; the last three null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(c):
        sets = shingle_sets(c["text"])
        full = [i for i, s in enumerate(sets) if len(s)]
        one, two, rows = minima([sets[i] for i in full])
        h1, h2, sig = ([None] * len(sets) for _ in range(3))
        for j, i in enumerate(full):
            h1[i], h2[i], sig[i] = int(one[j].view(np.int64)), int(two[j].view(np.int64)), rows[j].tobytes()
        return {
            "doc_id": c["doc_id"], "text_hash": c["text_hash"], "n_shingles": [len(s) for s in sets], "h1": h1, "h2": h2, "sig": sig,
        }

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return arrow_scan(hashed, step, f"doc_id {kind}, text_hash long, n_shingles long, h1 long, h2 long, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(node, bucket) for every band of every node."""

    def step(c):
        if not c["node"]:
            return {"node": [], "bucket": []}
        rows = _matrix(c["sig"]).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
        for j in range(ROWS):
            keys = mix(keys * _A[0] + rows[:, :, j])
        return {"node": np.repeat(np.array(c["node"], np.int64), BANDS), "bucket": keys.ravel().view(np.int64)}

    return arrow_scan(nodes.select("node", "sig"), step, "node long, bucket long")


def _candidates(shared: DataFrame, hubs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of small buckets, members and hub of large ones."""
    lists = shared.where(F.col("size") <= PAIR_LIMIT).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("m"))
    after = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = lists.select("m").distinct().select(F.explode(F.flatten(after)).alias("p")).select("p.a", "p.b")
    large = shared.where(F.col("size") > PAIR_LIMIT).join(hubs, "bucket").where("node <> hub")
    starred = large.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.unionByName(starred).distinct()


def _confirmed(candidates: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the candidates that are linked: signatures first, then full sets."""
    least = least_equal(percent)

    def by_signature(c):
        if not c["a"]:
            return {"a": [], "b": []}
        alike = (_matrix(c["left"]) == _matrix(c["right"])).sum(axis=1) >= least
        return {"a": np.array(c["a"], np.int64)[alike], "b": np.array(c["b"], np.int64)[alike]}

    def by_set(c):
        pairs = []
        for a, b, x, y in zip(c["a"], c["b"], c["left"], c["right"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if linked(common, len(x), len(y), percent):
                pairs.append((a, b))
        return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        one = pairs.join(nodes.select(F.col("node").alias("a"), F.col(column).alias("left")), "a")
        return one.join(nodes.select(F.col("node").alias("b"), F.col(column).alias("right")), "b").select("a", "b", "left", "right")

    alike = cut(arrow_scan(with_both(candidates, "sig"), by_signature, "a long, b long"), "alike")
    return arrow_scan(with_both(alike, "shingles"), by_set, "a long, b long")


class Forest:
    """Union-find over the nodes of a task's blocks."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _rest_links(rest: DataFrame, members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links that connect the rest of each group to its members and to each other,
    block against block; ``members`` has the rest too, ``comp`` says what is connected already."""
    least = least_equal(percent)

    def step(c):
        a, b = [], []
        for left, right in zip(c["left"], c["right"]):
            ids = [m["node"] for m in right]
            comps = [m["comp"] for m in right]
            sigs = _matrix([m["sig"] for m in right])
            sets = [np.frombuffer(m["shingles"], np.uint64) for m in right]
            forest = Forest()
            for u in left:
                equal = (_matrix([u["sig"]]) == sigs).sum(axis=1)
                own = None
                for k in sorted(np.flatnonzero(equal >= least).tolist(), key=lambda k: (-equal[k], k)):
                    if forest.root(u["comp"]) == forest.root(comps[k]):
                        continue
                    own = np.frombuffer(u["shingles"], np.uint64) if own is None else own
                    common = len(np.intersect1d(own, sets[k], assume_unique=True))
                    if linked(common, len(own), len(sets[k]), percent):
                        forest.join(u["comp"], comps[k])
                        a.append(u["node"])
                        b.append(ids[k])
        return {"a": a, "b": b}

    fields = ("node", "comp", "sig", "shingles")
    known = nodes.select("node", "sig", "shingles").join(members.select("node", "comp").distinct(), "node")
    (left, n_left), (right, n_right) = (
        _blocks(of.select("g", "node"), known, name, fields) for of, name in ((rest, "left"), (members, "right"))
    )
    # blocks meet by their numbers first; each then travels by its own key
    numbers = n_left.select("g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).join(
        n_right.select("g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")), "g"
    )
    met = numbers.join(left.withColumnRenamed("part", "i"), ["g", "i"]).join(right.withColumnRenamed("part", "j"), ["g", "j"])
    return arrow_scan(met.select("left", "right"), step, "a long, b long")


def _linked_nodes(docs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the nodes that have links."""
    bands = _bands(texts)
    sizes = cut(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = cut(join_sized(bands, sizes, ["bucket"], "inner"), "shared")
    wanted = cut(shared.groupBy("node").agg(F.sum("size").alias("meets")), "wanted")
    best = F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("best")
    crowded = shared.where(F.col("size") > PAIR_LIMIT)
    hubs = cut(
        crowded.join(wanted, "node").groupBy("bucket").agg(best).select("bucket", (-F.col("best.minus")).alias("hub")), "hubs"
    )

    # the sets of nodes that share a bucket, from the text of one row of each
    rows = join_sized(texts, wanted, ["node"], "inner")
    rows = cut(rows.select("node", F.col("text_id").alias("row_id"), F.col("text_hash").alias("row_hash")), "rows")
    met = meet(docs, rows, {"row_id": F.col("doc_id"), "row_hash": F.xxhash64("text")}, "inner").select("node", "text")
    sets = arrow_scan(
        met, lambda c: {"node": c["node"], "shingles": [s.tobytes() for s in shingle_sets(c["text"])]}, "node long, shingles binary"
    ).dropDuplicates(["node"])
    nodes = cut(texts.select("node", "sig").join(sets, "node"), "nodes")

    links = cut(_confirmed(_candidates(shared, hubs), nodes, percent), "first-links")
    comps = components(links)
    if hubs.isEmpty():
        return comps
    comps = cut(comps, "first-components")

    def comp_of(name: str) -> DataFrame:
        return comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))

    placed = crowded.join(hubs, "bucket").select("node", "hub").distinct()
    placed = placed.join(comp_of("node"), "node", "left").join(comp_of("hub"), "hub", "left")
    placed = placed.select("node", F.coalesce("node_comp", "node").alias("comp"), F.coalesce("hub_comp", "hub").alias("g"))
    rest = cut(placed.where("comp <> g").distinct(), "rest")
    if rest.isEmpty():
        return comps
    groups = rest.select("g").distinct()
    of_hub = comps.withColumn("g", F.col("comp")).join(groups, "g", "left_semi").select("node", "comp", "g")
    alone = groups.select(F.col("g").alias("node"), F.col("g").alias("comp"), "g")
    members = cut(of_hub.unionByName(alone).unionByName(rest).distinct(), "members")
    more = _rest_links(rest, members, nodes, percent)
    return components(cut(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), "all-links"))


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: a row for each row, written."""
    with scratch(docs.sparkSession) as own:
        docs = docs.select("doc_id", "text")
        signed = cut(_signed(docs), "signed")
        known = signed.where("h1 is not null and doc_id is not null")
        # a node's number is fixed once the table is written; its row is that of the smallest doc_id
        texts = cut(
            known.groupBy("h1", "h2")
            .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("sig").alias("sig"))
            .select(
                F.monotonically_increasing_id().alias("node"), "h1", "h2",
                F.col("row.doc_id").alias("text_id"), F.col("row.text_hash").alias("text_hash"), "sig",
            ),
            "texts",
        )
        comps = _linked_nodes(docs, texts, percent)
        placed = cut(texts.select("node", "h1", "h2", "text_id").join(comps, "node", "left"), "placed")
        names = cut(placed.where("comp is not null").groupBy("comp").agg(F.min("text_id").alias("name")), "names")
        named = cut(
            join_sized(placed, names, ["comp"], "left").select("h1", "h2", F.coalesce("name", "text_id").alias("component")), "named"
        )
        found = join_sized(signed.drop("sig"), named, ["h1", "h2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
        out = cut(found.select("doc_id", "text_hash", "n_shingles", component), "components")
        keep(own)
        return out


def minhash_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _components(docs, percent).select("doc_id", "n_shingles", "component_id", kept)


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they came."""
    id_name, hash_name = fresh(docs, "__id"), fresh(docs, "__hash")
    gone = _components(docs, percent).where("component_id <> doc_id")
    gone = cut(gone.select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct(), "minhash-dropped")
    return meet(docs, gone, {id_name: F.col("doc_id"), hash_name: F.xxhash64("text")}, "left_anti")
