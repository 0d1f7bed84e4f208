"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked when the Jaccard
coefficient of their sets is 0.8 or more.

1. Each text gets its set's hash (128 bits) and a MinHash signature.  Texts with
   equal sets collapse to one node, whatever their doc_ids.
2. Nodes that agree in a band of the signature share a bucket.  In a bucket of
   up to ``PAIR_LIMIT`` nodes all pairs are candidates; in a larger one each
   node is paired with the hub, the node that shares most buckets with others,
   so candidates stay linear in the bucket.
3. Bayesian pruning: MinHash values are compared 16 at a time; a pair is
   dropped when the posterior probability (uniform prior) that its coefficient
   reaches the threshold falls below ``TOLERANCE``.  Survivors are verified
   exactly on their shingle sets.
4. Links join nodes to classes (alternating star contraction on written tables).
5. Nodes of large buckets that are not in their hub's class are compared with
   that class and with each other, block by block, by the same pruning and
   exact verification; new links join the classes.  So no link between classes
   is lost because a bucket was large.
6. Members of large buckets are compared with all others of their final class,
   block against block and each pair once, by exact shared-shingle counts.  The
   links are counted in the task, so no list of pairs is ever made.

* ``class_id``: smallest doc_id of the connected texts; ``text_id``: smallest
  doc_id with the same shingle set; ``n_copies``: rows with that set;
  ``n_links``: other texts with a verified link, in groups of any size.
* a text of fewer than five words has one shingle of all its words; null and
  empty texts and texts without words have none, link to nothing and are each
  their own class, as are rows with a null doc_id (``class_id`` null);
* very long texts are read whole; doc_id may be of any type that has an order;
  rows that repeat a doc_id with another text have their own text's class and
  links; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_scan, cut, fresh, join_sized, meet
from .tokens import chunks, mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
PAIR_LIMIT = 32
BLOCK_BYTES = 1 << 20
COLUMNS = 2048

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): with m of n matching and a
    uniform prior the posterior of the coefficient is Beta(m + 1, n - m + 1),
    whose mass above t is the probability of m or fewer successes in n + 1
    trials of chance t."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of signature rows that the pruning keeps."""
    alive = np.arange(max(len(a), len(b)))
    matches = np.zeros(len(alive), np.int64)
    done = 0
    for n, least in limits:
        left = a[alive, done:n] if len(a) > 1 else a[:, done:n]
        matches = matches + (left == b[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for part in chunks(texts):
        words, offsets = word_hashes(texts[part])
        out += [shingle_hashes(words[s:e], SHINGLE) for s, e in zip(offsets, offsets[1:])]
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, MinHash rows) of non-empty sets."""
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    rows = np.zeros((len(sets), HASHES), np.uint32)
    begin = 0
    while begin < len(sets):  # about a megabyte of shingles at a time stays in cache
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) < 1 << 16):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[begin:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin : end - 1]])]).astype(np.int64)
        one[begin:end] = np.add.reduceat(joined, starts)
        two[begin:end] = np.add.reduceat(mix(joined ^ np.uint64(0x5851F42D4C957F2D)), starts)
        for k in range(HASHES):
            rows[begin:end, k] = np.minimum.reduceat(joined * _FACTORS[k], starts) >> np.uint64(32)
        begin = end
    return one, two, rows


def _signed(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, h1, h2 (hash of the set) and sig per row; the last three null without words."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def step(c):
        sets = shingle_sets(c["text"])
        full = [i for i, s in enumerate(sets) if len(s)]
        one, two, rows = signatures([sets[i] for i in full])
        n = len(sets)
        h1, h2, sig = [None] * n, [None] * n, [None] * n
        for j, i in enumerate(full):
            h1[i], h2[i], sig[i] = int(one[j].view(np.int64)), int(two[j].view(np.int64)), rows[j].tobytes()
        return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "h1": h1, "h2": h2, "sig": sig}

    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return arrow_scan(hashed, step, f"doc_id {kind}, text_hash long, h1 long, h2 long, sig binary")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint32).reshape(-1, HASHES)


def _bands(nodes: DataFrame) -> DataFrame:
    """(node, bucket) for every band of every node."""

    def step(c):
        if not c["node"]:
            return {"node": [], "bucket": []}
        rows = _matrix(c["sig"]).astype(np.uint64)
        keys = np.empty((len(rows), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(rows), b + 1, np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, b * ROWS + j])
            keys[:, b] = key
        return {"node": np.repeat(np.array(c["node"], np.int64), BANDS), "bucket": keys.ravel().view(np.int64)}

    return arrow_scan(nodes.select("node", "sig"), step, "node long, bucket long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the linked nodes, comp being the smallest node of the
    connected component, by alternating large-star and small-star steps."""

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "links",
    )
    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def _candidates(shared: DataFrame, hubs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b.  Equal member lists of several bands count once."""
    lists = (
        shared.where(F.col("size") <= PAIR_LIMIT)
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("node")).alias("m"))
        .select("m")
        .distinct()
    )
    pairs = lists.select(
        F.explode(
            F.expr(
                "flatten(transform(sequence(1, size(m) - 1), i -> "
                "transform(slice(m, i + 1, size(m)), x -> struct(m[i - 1] as a, x as b))))"
            )
        ).alias("p")
    ).select("p.a", "p.b")
    starred = (
        shared.where(F.col("size") > PAIR_LIMIT)
        .join(hubs, "bucket")
        .where("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    )
    return pairs.where("a <> b").unionByName(starred).distinct()


def _verified(candidates: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the candidates whose sets reach the threshold; pruned first."""
    limits = needed(threshold)

    def prune(c):
        if not c["a"]:
            return {"a": [], "b": []}
        keep = surviving(_matrix(c["sa"]), _matrix(c["sb"]), limits) if len(c["a"]) > 1 else np.arange(1)
        return {"a": np.array(c["a"], np.int64)[keep], "b": np.array(c["b"], np.int64)[keep]}

    def verify(c):
        a, b = [], []
        for x, y, s, t in zip(c["a"], c["b"], c["sa"], c["sb"]):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            if min(len(s), len(t)) < threshold * max(len(s), len(t)):
                continue
            common = len(np.intersect1d(s, t, assume_unique=True))
            if common >= threshold * (len(s) + len(t) - common):
                a.append(x)
                b.append(y)
        return {"a": a, "b": b}

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        own = nodes.select("node", column)
        one = pairs.join(own.select(F.col("node").alias("a"), F.col(column).alias("sa")), "a")
        return one.join(own.select(F.col("node").alias("b"), F.col(column).alias("sb")), "b")

    pruned = arrow_scan(with_both(candidates, "sig").select("a", "b", "sa", "sb"), prune, "a long, b long")
    pruned = cut(pruned, "pruned")
    return arrow_scan(with_both(pruned, "shingles").select("a", "b", "sa", "sb"), verify, "a long, b long")


def _blocks(
    members: DataFrame, nodes: DataFrame, name: str, fields: tuple[str, ...] = ("node", "sig", "shingles")
) -> tuple[DataFrame, DataFrame]:
    """((g, part, name): the members of each g in lists of about BLOCK_BYTES;
    (g, k): how many lists each g has)."""
    full = members.join(nodes.select(*fields), "node")
    size = F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES).alias("k")
    counts = cut(full.groupBy("g").agg(size), f"{name}-counts")
    dealt = join_sized(full, counts, ["g"], "inner").withColumn("part", F.pmod(F.xxhash64("node"), "k"))
    lists = dealt.groupBy("g", "part").agg(F.collect_list(F.struct(*fields)).alias(name))
    return lists, counts


def _rest_links(rest: DataFrame, members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links between the rest of a group and all its members, block against block."""
    limits = needed(threshold)

    def step(c):
        a, b = [], []
        for left, right in zip(c["left"], c["right"]):
            ids = np.array([m["node"] for m in right], np.int64)
            sigs = _matrix([m["sig"] for m in right])
            sets = [np.frombuffer(m["shingles"], np.uint64) for m in right]
            for u in left:
                keep = surviving(_matrix([u["sig"]]), sigs, limits)
                keep = keep[ids[keep] != u["node"]]
                if not len(keep):
                    continue
                own = np.frombuffer(u["shingles"], np.uint64)
                chosen = [sets[k] for k in keep]
                sizes = np.array([len(s) for s in chosen])
                joined = np.concatenate(chosen)
                at = np.searchsorted(own, joined)
                hit = own[np.minimum(at, len(own) - 1)] == joined
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for k in keep[common >= threshold * (sizes + len(own) - common)]:
                    a.append(min(u["node"], int(ids[k])))
                    b.append(max(u["node"], int(ids[k])))
        return {"a": a, "b": b}

    (left, n_left), (right, n_right) = _blocks(rest, nodes, "left"), _blocks(members, nodes, "right")
    # which block meets which is decided on block numbers; each block then travels by its own key
    numbers = n_left.select("g", F.explode(F.expr("sequence(0, k - 1)")).alias("i")).join(
        n_right.select("g", F.explode(F.expr("sequence(0, k - 1)")).alias("j")), "g"
    )
    one = numbers.join(left.withColumnRenamed("part", "i"), ["g", "i"])
    met = one.join(right.withColumnRenamed("part", "j"), ["g", "j"]).select("left", "right")
    return arrow_scan(met, step, "a long, b long").distinct()


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``, by products
    of 0/1 matrices over ``COLUMNS`` shingles at a time."""
    words = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(words):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.concatenate(sets)
        column = np.searchsorted(words, joined)
        hit = words[np.minimum(column, len(words) - 1)] == joined
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], column[hit]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    def matrix(row: np.ndarray, column: np.ndarray, n: int, begin: int) -> np.ndarray:
        s, e = np.searchsorted(column, (begin, begin + COLUMNS))
        ones = np.zeros((n, min(COLUMNS, len(words) - begin)), np.float32)
        ones[row[s:e], column[s:e] - begin] = 1
        return ones

    of_a, of_b = places(a), places(b)
    for begin in range(0, len(words), COLUMNS):
        out += matrix(*of_a, len(a), begin) @ matrix(*of_b, len(b), begin).T
    return out


def _link_counts(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n): verified links of each member to the other members of its g,
    all pairs, block against block."""

    def step(c):
        node, n = [], []
        for left, right, same in zip(c["left"], c["right"], c["same"]):
            one = [np.frombuffer(m["shingles"], np.uint64) for m in left]
            two = one if same else [np.frombuffer(m["shingles"], np.uint64) for m in right]
            common = common_counts(one, two).astype(np.float64)
            sizes = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None, :]
            linked = common >= threshold * (sizes - common)
            if same:
                np.fill_diagonal(linked, False)
            else:
                node += [m["node"] for m in right]
                n += linked.sum(axis=0).tolist()
            node += [m["node"] for m in left]
            n += linked.sum(axis=1).tolist()
        return {"node": node, "n": n}

    lists, counts = _blocks(members, nodes, "block", ("node", "shingles"))
    lists = cut(lists, "count-blocks")
    # each two blocks meet once; every block meets about half of the others from its side
    numbers = (
        counts.select("g", "k", F.explode(F.expr("sequence(0, k - 1)")).alias("i"))
        .select("g", "k", "i", F.explode(F.expr("sequence(0, k div 2)")).alias("d"))
        .where("not (d > 0 and 2 * d = k and 2 * i >= k)")
        .select("g", "i", F.expr("(i + d) % k").alias("j"))
        .repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "i", "j")
    )
    one = numbers.join(lists.select("g", F.col("part").alias("i"), F.col("block").alias("left")), ["g", "i"])
    met = one.join(lists.select("g", F.col("part").alias("j"), F.col("block").alias("right")), ["g", "j"])
    found = arrow_scan(met.select("left", "right", (F.col("i") == F.col("j")).alias("same")), step, "node long, n long")
    return found.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, text_id, n_copies, n_links: one row per input row."""
    return _near(docs, threshold, counted=True).drop("text_hash")


def _near(docs: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """The columns of near_duplicates, n_links only where it is wanted."""
    docs = docs.select("doc_id", "text")
    signed = cut(_signed(docs), "signed")
    known = signed.where("h1 is not null and doc_id is not null")
    # a node's number is fixed once the table is written; its row is that of the smallest doc_id
    texts = cut(
        known.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"))
        .select(
            F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("row.doc_id").alias("text_id"),
            F.col("row.text_hash").alias("text_hash"), "n_copies", "sig",
        ),
        "texts",
    )

    bands = _bands(texts)
    sizes = cut(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = cut(join_sized(bands, sizes, ["bucket"], "inner"), "shared")
    spread = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    wanted = cut(spread, "wanted")
    hubs = cut(
        shared.where(F.col("size") > PAIR_LIMIT)
        .join(wanted, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("best"))
        .select("bucket", (-F.col("best.minus")).alias("hub")),
        "hubs",
    )

    # shingle sets of the nodes in shared buckets only, from their rows' texts
    rows = cut(
        join_sized(texts, wanted, ["node"], "inner").select("node", F.col("text_id").alias("row_id"), F.col("text_hash").alias("row_hash")),
        "rows",
    )
    sets = arrow_scan(
        meet(docs, rows, {"row_id": F.col("doc_id"), "row_hash": F.xxhash64("text")}, "inner").select("node", "text"),
        lambda c: {"node": c["node"], "shingles": [s.tobytes() for s in shingle_sets(c["text"])]},
        "node long, shingles binary",
    ).dropDuplicates(["node"])
    nodes = cut(texts.join(wanted, "node").select("node", "sig").join(sets, "node"), "nodes")

    links = cut(_verified(_candidates(shared, hubs), nodes, threshold), "first-links")
    classes = components(links)

    crowded = not hubs.isEmpty()
    if crowded:
        classes = cut(classes, "classes")

        def class_of(name: str) -> DataFrame:
            return classes.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_class"))

        large = shared.where(F.col("size") > PAIR_LIMIT).join(hubs, "bucket").select("node", "hub").distinct()
        placed = large.join(class_of("node"), "node", "left").join(class_of("hub"), "hub", "left")
        own, g = F.coalesce("node_class", "node"), F.coalesce("hub_class", "hub").alias("g")
        rest = cut(placed.where(own != F.coalesce("hub_class", "hub")).select(g, "node").distinct(), "rest")
        if not rest.isEmpty():
            groups = rest.select("g").distinct()
            members = (
                classes.select(F.col("comp").alias("g"), "node")
                .join(groups, "g", "left_semi")
                .unionByName(rest)
                .unionByName(groups.select("g", F.col("g").alias("node")))
                .distinct()
            )
            links = cut(links.unionByName(_rest_links(rest, members, nodes, threshold)).distinct(), "links-of-rest")
            classes = components(links)

    ends = [links.select(F.col(x).alias("node"), F.lit(1).cast("long").alias("n")) for x in ("a", "b")]
    if crowded and counted:
        # pairs of two members of large buckets are counted whole, the others by their links
        classes = cut(classes, "all-classes")
        crowd = cut(shared.where(F.col("size") > PAIR_LIMIT).select("node").distinct(), "crowd")
        placed = classes.join(crowd, "node", "left_semi").select(F.col("comp").alias("g"), "node")
        several = placed.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g")
        members = cut(placed.join(several, "g", "left_semi").distinct(), "crowd-classes")
        known_a, known_b = (crowd.select(F.col("node").alias(x), F.lit(True).alias(f"in_{x}")) for x in ("a", "b"))
        other = links.join(known_a, "a", "left").join(known_b, "b", "left").where("in_a is null or in_b is null")
        ends = [other.select(F.col(x).alias("node"), F.lit(1).cast("long").alias("n")) for x in ("a", "b")]
        ends.append(cut(_link_counts(members, nodes, threshold), "link-counts"))
    degree = reduce(DataFrame.unionAll, ends).groupBy("node").agg(F.sum("n").alias("n_links"))
    placed = texts.drop("sig", "text_hash").join(classes, "node", "left")
    names = cut(placed.where("comp is not null").groupBy("comp").agg(F.min("text_id").alias("class_id")), "class-names")
    summary = join_sized(placed, names, ["comp"], "left").join(degree, "node", "left")
    out = signed.select("doc_id", "text_hash", "h1", "h2").join(summary, ["h1", "h2"], "left")
    named = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(named, F.coalesce("class_id", "text_id", "doc_id")).alias("class_id"),
        F.when(named, F.coalesce("text_id", "doc_id")).alias("text_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the smallest doc_id; columns as they
    came.  Rows are judged by doc_id and text."""
    id_name, hash_name = fresh(docs, "__id"), fresh(docs, "__hash")
    found = _near(docs, threshold, counted=False).where("class_id <> doc_id")
    dropped = cut(found.select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct(), "near-dropped")
    return meet(docs, dropped, {id_name: F.col("doc_id"), hash_name: F.xxhash64("text")}, "left_anti")
