"""Entity graph, chunk graph and page-link graph.

Edges are tables; merges are aggregations with map-side combining.  Global
figures (totals, maxima) are scalar subqueries over aggregated tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpusq.operators.lexical import occurrences
from corpusq.tables import sized, written


def merge_entities(mentions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, name, frequency, first_chunk) of mentions (scope, name, chunk_id):
    chunks of a name are counted, not gathered, so a name of any frequency is one
    small row.  ``scope`` names the columns that keep graphs apart."""
    once = mentions.select(*scope, "name", "chunk_id").distinct()
    return once.groupBy(*scope, "name").agg(F.count(F.lit(1)).alias("frequency"), F.min("chunk_id").alias("first_chunk"))


def clean_relations(raw: DataFrame) -> DataFrame:
    """Trimmed ends, strength a whole number from 1 to 10, no self loops."""
    strength = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.col("strength").cast("int"), F.lit(1))))
    out = raw.withColumn("source", F.trim("source")).withColumn("target", F.trim("target")).withColumn("strength", strength)
    return out.where("source <> '' and target <> '' and source <> target")


def missing_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names that relations use and the entities lack."""
    ends = relations.select(F.col("source").alias("name")).union(relations.select("target")).distinct()
    return ends.join(entities.select("name"), "name", "left_anti")


def merge_relations(relations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, source, target, strength, n): chunks counted, the largest strength."""
    once = relations.groupBy(*scope, "source", "target", "chunk_id").agg(F.max("strength").alias("strength"))
    return once.groupBy(*scope, "source", "target").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("n"))


def relation_weights(entities: DataFrame, relations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``pmi`` and ``weight``: 1 + 9 * (0.6 * pmi / largest + 0.4 * strength /
    largest), with frequencies of one at least.  Totals and largest values are
    windows over the scope (a document's graph), or scalar subqueries where there
    is one graph for all."""

    def over(table: DataFrame, value: Column) -> Column:
        value = F.greatest(F.lit(1), F.coalesce(value.over(W.partitionBy(*scope)) if scope else value, F.lit(1)))
        return value if scope else table.select(value.alias("v")).scalar()

    f = entities.select(*scope, "name", F.greatest(F.lit(1), "frequency").alias("f"))
    f = f.withColumn("all_entities", over(f, F.sum("f")))
    counted = relations.withColumns(
        {"all_relations": over(relations, F.sum("n")), "top_strength": over(relations, F.max("strength"))}
    )
    joined = counted.join(f.withColumnsRenamed({"name": "source", "f": "fs"}), [*scope, "source"]).join(
        f.drop("all_entities").withColumnsRenamed({"name": "target", "f": "ft"}), [*scope, "target"]
    )
    p = F.greatest(F.lit(1), "n") / F.col("all_relations")
    raw = F.log2(p / ((F.col("fs") / F.col("all_entities")) * (F.col("ft") / F.col("all_entities"))))
    scored = joined.withColumn("pmi", F.greatest(raw, F.lit(0.0)))
    top_pmi = F.max("pmi").over(W.partitionBy(*scope)) if scope else scored.select(F.coalesce(F.max("pmi"), F.lit(0.0)).alias("v")).scalar()
    scored = scored.withColumn("top_pmi", top_pmi)
    share = F.when(F.col("top_pmi") > 0, F.col("pmi") / F.col("top_pmi")).otherwise(F.lit(0.0))
    weight = 1 + 9 * (0.6 * share + 0.4 * F.col("strength") / F.col("top_strength"))
    return scored.withColumn("weight", weight).select(*scope, "source", "target", "n", "strength", "pmi", "weight")


def degrees(relations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Relations that touch a name at either end."""
    ends = relations.select(*scope, F.col("source").alias("name")).unionAll(relations.select(*scope, "target"))
    return ends.groupBy(*scope, "name").agg(F.count(F.lit(1)).alias("degree"))


#: Chunks of a document whose edges are made together are those with the same id but for its last eight bits.
BLOCK_BITS = 8


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal first ``n_keys`` columns, which stand together, as (key, table)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in batch.columns[:n_keys]:
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for begin, end in zip([0, *ends], ends):
            if begin == end:
                continue
            own = tuple(c[begin].as_py() for c in batch.columns[:n_keys])
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(begin, end - begin))
    if held:
        yield key, pa.Table.from_batches(held)


def _by_group(rows: DataFrame, keys: list[str], schema: StructType, kernel: Callable[[tuple, pa.Table], tuple]) -> DataFrame:
    """What ``kernel`` makes of the rows of each key: values for the columns of the schema after the scope."""
    out_schema, n_scope = to_arrow_schema(schema), len(schema) - 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size = 0
        for key, table in _groups(batches, len(keys)):
            made = kernel(key, table)
            n = len(made[0])
            if n:
                arrays = [pa.repeat(pa.scalar(k, f.type), n) for k, f in zip(key[:n_scope], out_schema)]
                arrays += [pa.array(c, type=f.type) for c, f in zip(made, list(out_schema)[n_scope:])]
                parts.append(pa.RecordBatch.from_arrays(arrays, schema=out_schema))
                size += n
            if size >= OUT_ROWS:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=OUT_ROWS)
                parts, size = [], 0
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=OUT_ROWS)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


#: Edges that leave a task in one batch.
OUT_ROWS = 50_000


def _edge_schema(table: DataFrame, scope: tuple[str, ...], chunk: str) -> StructType:
    kind = table.schema[chunk].dataType
    fields = [StructField(c, table.schema[c].dataType) for c in scope]
    return StructType([*fields, StructField("a", kind), StructField("b", kind), StructField("weight", DoubleType()), StructField("degree", LongType())])


def _block(chunk: str) -> Column:
    return F.shiftright(F.col(chunk).cast("long"), BLOCK_BITS)


def chunk_edges(relations: DataFrame, mentions: DataFrame, scope: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(scope, a, b, weight, degree): chunks of a relation's source to chunks of its
    target, both ways, by the best (weight, degree); with ``most`` the best so many of
    each chunk, equal ones by b.  A graph is that of one document's chunks, as ``scope``
    says, so a name joins chunks of one document only.  Relations and mentions, not
    pairs of chunks, are shuffled: a block of a document's chunks (whole numbers) meets
    them in one place, and an edge is made there once, whatever names its chunks share."""
    ends = relations.withColumn("name", F.explode(F.array("source", "target")))
    touching = ends.withColumn("degree", F.count(F.lit(1)).over(W.partitionBy(*scope, "name")))
    ranked = touching.groupBy(*scope, "source", "target", "weight").agg(F.sum("degree").alias("degree"))
    held = mentions.where(F.col("name").isNotNull() & F.col("chunk_id").isNotNull())
    blocks = held.groupBy(*scope).agg(F.collect_set(_block("chunk_id")).alias("blocks"))
    none = F.lit(None).cast(held.schema["chunk_id"].dataType)
    names = held.select(*scope, F.col("name").alias("source"), F.lit(None).cast("string").alias("target"), "chunk_id", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("degree"))
    links = ranked.select(*scope, "source", "target", none.alias("chunk_id"), F.round("weight", 9).alias("weight"), F.col("degree").cast("long").alias("degree"))
    spread = names.unionByName(links).join(blocks, [*scope]).select(*scope, F.explode("blocks").alias("block"), "source", "target", "chunk_id", "weight", "degree")

    def kernel(key: tuple, table: pa.Table) -> tuple:
        sources, targets, ids, weights, degrees = (c.to_pylist() for c in table.columns[len(key) :])
        chunks = np.unique([c for c in ids if c is not None])
        low, high = np.searchsorted(chunks, [key[-1] << BLOCK_BITS, (key[-1] + 1) << BLOCK_BITS])
        places: dict[str, list[int]] = {}
        for name, c in zip(sources, ids):
            if c is not None:
                places.setdefault(name, []).append(c)
        where = {name: np.searchsorted(chunks, own) for name, own in places.items()}
        known = sorted((w, d, s, t) for s, t, c, w, d in zip(sources, targets, ids, weights, degrees) if c is None and s in where and t in where)
        best = np.full((high - low, len(chunks)), -1, np.int32)
        values: list[tuple] = []
        for w, d, s, t in known:  # the best come last and stay
            if not values or values[-1] != (w, d):
                values.append((w, d))
            for one, other in ((where[s], where[t]), (where[t], where[s])):
                own = one[(one >= low) & (one < high)] - low
                if len(own):
                    best[own[:, None], other] = len(values) - 1
        best[np.arange(high - low), np.arange(low, high)] = -1
        a, b = np.nonzero(best >= 0)
        value = best[a, b]
        if most is not None:
            order = np.lexsort((b, -value, a))
            order = order[np.arange(len(order)) - np.searchsorted(a, a[order]) < most]
            a, b, value = a[order], b[order], value[order]
        w, d = np.array(values or [(0.0, 0)]).T
        return chunks[a + low], chunks[b], w[value], d[value].astype(np.int64)

    return _by_group(spread, [*scope, "block"], _edge_schema(held.withColumnRenamed("chunk_id", "a"), scope, "a"), kernel)


def top_neighbours(edges: DataFrame, k: int = 8, scope: tuple[str, ...] = ()) -> DataFrame:
    """The best k edges of each chunk by weight, then degree, then the other chunk."""
    w = W.partitionBy(*scope, "a").orderBy(F.round("weight", 9).desc(), F.desc("degree"), "b")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _rounded(x: float) -> float:
    """As Spark rounds to nine digits."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def two_hop(edges: DataFrame, decay: float = 0.5, scope: tuple[str, ...] = (), starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(scope, a, b, weight, degree): chunks two edges away and no nearer, over all
    ``edges``, of which there is one for a pair; the best product of weights, halved,
    with the larger degree of its path.  ``starts`` (a) names the chunks to start from,
    all without it.  With ``most``, what cannot be among the best so many of a chunk is
    left out; what remains is to be ranked.

    Edges, not paths, are shuffled: those from a block of chunks and those to another
    (whole numbers) meet in one place, and paths over the same ends are compared there."""
    known = edges.dropna(subset=[*scope, "a", "b", "weight"])
    first = known if starts is None else known.join(starts, "a", "left_semi")
    columns = ["a", "b", "weight", F.col("degree").cast("long").alias("degree")]
    froms = first.groupBy(*scope).agg(F.collect_set(_block("a")).alias("froms"))
    tos = known.groupBy(*scope).agg(F.collect_set(_block("b")).alias("tos"))
    both = froms.join(tos, [*scope]) if scope else froms.crossJoin(tos)
    met = lambda e: e.join(both, [*scope]) if scope else e.crossJoin(both)
    out = met(first).select(*scope, _block("a").alias("from"), F.explode("tos").alias("to"), F.lit(0).alias("leg"), *columns)
    back = met(known).select(*scope, F.explode("froms").alias("from"), _block("b").alias("to"), F.lit(1).alias("leg"), *columns)

    def kernel(key: tuple, table: pa.Table) -> tuple:
        leg, one, two, weight, degree = (c.to_numpy() for c in table.columns[len(key) :])
        go, on = leg == 0, leg == 1
        a, b = np.unique(one[go]), np.unique(two[on])
        if not len(a) or not len(b):
            return (), (), (), ()
        sort_go, sort_on = np.argsort(two[go], kind="stable"), np.argsort(one[on], kind="stable")
        go, on = np.flatnonzero(go)[sort_go], np.flatnonzero(on)[sort_on]
        via = np.intersect1d(two[go], one[on])
        at_go, at_on = (zip(np.searchsorted(x, via), np.searchsorted(x, via, "right")) for x in (two[go], one[on]))
        legs = []
        for (g0, g1), (o0, o1) in zip(at_go, at_on):
            g, o = go[g0:g1], on[o0:o1]
            legs.append((np.searchsorted(a, one[g])[:, None], np.searchsorted(b, two[o]), weight[g][:, None], weight[o], degree[g][:, None], degree[o]))
        best = np.full((len(a), len(b)), -np.inf)
        for i, j, w1, w2, _, _ in legs:
            best[i, j] = np.maximum(best[i, j], w1 * w2 * decay)
        best[a[:, None] == b] = -np.inf
        near = np.isin(two[go], b)  # what one edge reaches is no nearer by two
        best[np.searchsorted(a, one[go][near]), np.searchsorted(b, two[go][near])] = -np.inf
        if most is not None and len(b) > most:
            least = np.partition(best, len(b) - most, axis=1)[:, len(b) - most]
            best[best < (least - 2e-9)[:, None]] = -np.inf
        top = np.full(best.shape, -1, np.int64)
        for i, j, w1, w2, d1, d2 in legs:
            product, own = w1 * w2 * decay, best[i, j]
            close = np.isfinite(own) & (product >= own - 2e-9)  # may be the same in nine digits
            if close.any():
                for x, y in zip(*np.nonzero(close & (product != own))):
                    close[x, y] = _rounded(float(product[x, y])) == _rounded(float(own[x, y]))
                top[i, j] = np.maximum(top[i, j], np.where(close, np.maximum(d1, d2), -1))
        x, y = np.nonzero(np.isfinite(best))
        return a[x], b[y], best[x, y], top[x, y]

    found = _by_group(out.unionAll(back), [*scope, "from", "to"], _edge_schema(known, scope, "a"), kernel)
    return found.withColumn("weight", F.round("weight", 9))


def name_matches(entities: DataFrame, terms: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, name, frequency): entities whose name holds a term of the query;
    by frequency, ``most`` each.  The distinct terms, a stated query set, are
    looked for in one pass over the names."""
    low = terms.select("query_id", F.lower("term").alias("string_id")).distinct()
    names = entities.select("name", "frequency", F.lower("name").alias("low"))
    strings = low.select("string_id", F.col("string_id").alias("string")).distinct()
    held = occurrences(names, strings, "name", "low").join(low, "string_id").select("query_id", "name").distinct()
    w = W.partitionBy("query_id").orderBy(F.desc("frequency"), "name")
    ranked = held.join(entities.select("name", "frequency"), "name").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= most)


def search(
    terms: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, seen: DataFrame, k: int, scope: str = "kb_id", most: int = 200
) -> DataFrame:
    """(query_id, id, position): the first k chunks that the graph adds to each query.

    ``terms`` (query_id, term) are names of the queries, a stated set; ``entities``
    (scope, name, frequency), ``relations`` (scope, source, target) and ``mentions``
    (scope, name, id) the graph of each ``scope``; ``seen`` (query_id, id) what the
    queries have already.  An entity whose name holds a term is met with its
    relations either way; of these a query takes ``most`` in a scope, by the entity's
    frequency, its name and the other end's.  The names are visited in that order,
    the entity before its other end, and each gives its chunks by id; a chunk comes
    once.  Entities without relation give nothing, nor do null names, terms and scopes.

    Lists are cut before they meet the queries, so what is met does not grow with the
    graph: of a term's entities and of an entity's relations the first ``most``, of a
    query's entities those before which there are fewer, and of a name's chunks the
    first k and as many as a query has seen at most, since no more of them can be
    passed over.  Behind a name that has so many, a query needs none."""
    low = terms.select("query_id", F.lower("term").alias("string_id")).distinct()
    entities = written(entities.select(scope, "name", "frequency"), "graph-entities")
    names = entities.select("name").distinct().withColumn("low", F.lower("name"))
    strings = low.select("string_id", F.col("string_id").alias("string")).distinct()
    held = written(occurrences(names, strings, "name", "low").select("string_id", "name"), "held-names")
    pair = F.sort_array(F.array("source", "target"))
    pairs = written(relations.select(scope, pair[0].alias("one"), pair[1].alias("two")).distinct(), "graph-relations")
    ways = F.array_distinct(F.array(F.struct(F.col("one").alias("name"), F.col("two").alias("other")), F.struct(F.col("two").alias("name"), F.col("one").alias("other"))))
    links = pairs.select(scope, F.explode(ways).alias("e")).select(scope, "e.name", "e.other")
    n_links = links.groupBy(scope, "name").agg(F.count(F.lit(1)).alias("n_links"))
    linked = entities.join(sized(held), "name").join(n_links, [scope, "name"])
    by_entity = [F.desc("frequency"), "name"]
    of_term = F.row_number().over(W.partitionBy("string_id", scope).orderBy(*by_entity))
    best = written(linked.withColumn("nth", of_term).where(F.col("nth") <= most).drop("nth"), "matched-names")
    of_query = F.row_number().over(W.partitionBy("query_id", scope).orderBy(*by_entity))
    asked = best.join(sized(written(low, "query-terms")), "string_id").drop("string_id").distinct()
    matched = asked.withColumn("nth", of_query).where(F.col("nth") <= most)
    before = W.partitionBy("query_id", scope).orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    reached = matched.withColumn("before", F.coalesce(F.sum("n_links").over(before), F.lit(0))).where(F.col("before") < most)
    reached = written(reached.select("query_id", scope, "name", "nth"), "matched-names")

    own = sized(written(reached.select(scope, "name").distinct(), "matched-entities"))
    by_other = W.partitionBy(scope, "name").orderBy("other")
    first = links.join(own, [scope, "name"], "left_semi").withColumn("__n", F.row_number().over(by_other)).where(F.col("__n") <= most)
    by_link = W.partitionBy("query_id", scope).orderBy("nth", "other")
    hops = first.join(sized(reached), [scope, "name"]).withColumn("row", F.row_number().over(by_link)).where(F.col("row") <= most)
    ends = F.array(F.struct(F.col("name"), (2 * F.col("row")).alias("at")), F.struct(F.col("other").alias("name"), (2 * F.col("row") + 1).alias("at")))
    visited = hops.select("query_id", scope, F.explode(ends).alias("v")).groupBy("query_id", scope, F.col("v.name").alias("name")).agg(F.min("v.at").alias("at"))
    visited = written(visited, "visited-names")

    seen = written(seen.select("query_id", "id"), "seen")
    most_seen = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    own = sized(written(visited.select(scope, "name").distinct(), "visited-entities"))
    by_id = W.partitionBy(scope, "name").orderBy("id")
    heads = mentions.select(scope, "name", "id").join(own, [scope, "name"], "left_semi")
    heads = heads.withColumn("__n", F.dense_rank().over(by_id)).where(F.col("__n") <= k + most_seen)
    heads = written(heads, "visited-chunks")
    enough = heads.groupBy(scope, "name").agg(F.max("__n").alias("n")).where(F.col("n") >= k + most_seen).select(scope, "name", F.lit(1).alias("enough"))
    earlier = W.partitionBy("query_id").orderBy(scope, "at").rowsBetween(W.unboundedPreceding, -1)
    needed = visited.join(sized(written(enough, "full-names")), [scope, "name"], "left")
    needed = needed.withColumn("full", F.coalesce(F.max("enough").over(earlier), F.lit(0))).where("full = 0")
    found = heads.join(sized(written(needed.select("query_id", scope, "name", "at"), "needed-names")), [scope, "name"])
    once = found.groupBy("query_id", "id").agg(F.min(F.struct(F.col(scope).alias("scope"), "at")).alias("first"))
    unseen = once.join(sized(seen), ["query_id", "id"], "left_anti")
    order = W.partitionBy("query_id").orderBy("first", "id")
    return unseen.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("query_id", "id", "position")


def expand_relations(hits: DataFrame, direct: DataFrame, indirect: DataFrame, most: int = 3) -> DataFrame:
    """First ``most`` unseen chunks per query: direct neighbours of the hits, then indirect ones."""
    parts = []
    for kind, edges in enumerate((direct, indirect)):
        e = edges.select(F.col("a").alias("id"), F.col("b").alias("next"), F.col("rank").alias("near"))
        parts.append(hits.join(e, "id").select("query_id", "next", F.lit(kind).alias("kind"), "rank", "near"))
    found = parts[0].unionByName(parts[1])
    unseen = found.join(hits.select("query_id", F.col("id").alias("next")), ["query_id", "next"], "left_anti")
    first = unseen.groupBy("query_id", "next").agg(F.min(F.struct("kind", "rank", "near")).alias("order"))
    w = W.partitionBy("query_id").orderBy("order", "next")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("query_id", "next", "position")


def page_links(pages: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(slugs, links): pages as ``page/<id>``, words linked by ``least`` pages or
    more as ``concept/<word>``; links (src, dst) between known slugs."""
    words = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("word")).distinct()
    concepts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")
    page = F.concat(F.lit("page/"), F.col("page_id").cast("string"))
    slugs = pages.select(page.alias("slug"), F.lit("page").alias("kind")).unionAll(
        concepts.select(F.concat(F.lit("concept/"), "word"), F.lit("concept"))
    )
    links = words.join(concepts, "word").select(page.alias("src"), F.concat(F.lit("concept/"), "word").alias("dst"))
    return slugs, links


def dead_links(links: DataFrame, slugs: DataFrame) -> DataFrame:
    return links.join(slugs.select(F.col("slug").alias("dst")), "dst", "left_anti")


def neighbour_counts(links: DataFrame) -> DataFrame:
    """(slug, in_degree, out_degree, degree): degree counts distinct neighbours either way."""
    e = links.where("src <> dst").distinct()
    ends = e.select(F.col("src").alias("slug"), F.col("dst").alias("other"), F.lit("out").alias("way")).unionAll(
        e.select("dst", "src", F.lit("in"))
    )
    return ends.groupBy("slug").agg(
        F.count(F.when(F.col("way") == "in", 1)).alias("in_degree"),
        F.count(F.when(F.col("way") == "out", 1)).alias("out_degree"),
        F.count_distinct("other").alias("degree"),
    )


def orphans(slugs: DataFrame, links: DataFrame) -> DataFrame:
    """Pages without link in either direction."""
    ends = links.select(F.col("src").alias("slug")).union(links.select("dst")).distinct()
    return slugs.join(ends, "slug", "left_anti")


def ego(links: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, slug, hops): what is within ``depth`` links of each start, either way."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(links.select("dst", "src")).distinct()
    reached = starts.select(F.col("slug").alias("start"), "slug", F.lit(0).alias("hops"))
    front = reached
    for hop in range(1, depth + 1):
        step = front.join(both, front["slug"] == both["a"]).select("start", F.col("b").alias("slug")).distinct()
        front = step.join(reached.select("start", "slug"), ["start", "slug"], "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(front)
    return reached


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of which both ends are among the nodes."""
    n = nodes.select("slug").distinct()
    one = links.join(n.withColumnRenamed("slug", "src"), "src", "left_semi")
    return one.join(n.withColumnRenamed("slug", "dst"), "dst", "left_semi")


def link_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links added and removed between two states (src, dst)."""
    added = new.join(old, ["src", "dst"], "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new, ["src", "dst"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def recent_episodes(mentions: DataFrame, episodes: DataFrame, keywords: Column, most: int = 5) -> DataFrame:
    """Newest episodes that mention an entity among the keywords, each once."""
    hit = mentions.where(keywords).select("episode_id").distinct()
    return episodes.join(hit, "episode_id", "left_semi").orderBy(F.desc("created_at"), "episode_id").limit(most)


def forgotten_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that no episode mentions any more."""
    return entities.join(mentions.select("name").distinct(), "name", "left_anti")
