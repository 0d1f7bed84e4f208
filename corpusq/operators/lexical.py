"""Lexical index and BM25 recall for a batch of queries.

The texts are read once: the token array of a document is exploded, met with the
distinct query terms where the text is, and gathered into a narrow written table
(id, length, held terms).  Statistics, document frequencies and scores all come
from that table, so no full postings table is needed for a batch.  ``postings`` builds the full one for an index that is kept.

``occurrences`` finds strings in texts by one multi-pattern pass over each text,
for blocks of strings of a bounded size, in place of a join on containment.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusq.functions.text import tokens
from corpusq.tables import sized, written

K1, B = 1.2, 0.75
FLOOR_IDF = 1e-6
#: Characters of the strings that one pass over the texts looks for.
BLOCK_CHARS = 500_000
#: Query terms that are scored together, cells of their table of terms and queries, and
#: documents of a step and cells of its tables.
BLOCK_TERMS, BLOCK_CELLS = 20_000, 4_000_000
DOC_BATCH, STEP_CELLS = 512, 2_000_000
#: Finds that leave a task in one batch.
FOUND_ROWS = 20_000
#: Characters of a word whose scores a task remembers, and figures that it remembers at most.
WORD_CHARS, KNOWN = 64, 1_000_000


def tokenised(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, tokens of title and text, and their number."""
    both = F.concat_ws(" ", F.col("title"), F.col("text"))
    return docs.select(id_col, tokens(both).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, id, tf): the lexical index."""
    exploded = tokenised(docs, id_col).select(id_col, F.explode("tokens").alias("term"))
    return exploded.groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qn): terms of every query and how often each stands in it."""
    exploded = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def _numbered(queries: DataFrame) -> DataFrame:
    """(query_no, query_id, term, qn) of every query, written."""
    terms = query_terms(queries)
    numbers = written(terms.select("query_id").distinct().withColumn("query_no", F.monotonically_increasing_id()), "query-numbers")
    return written(terms.join(sized(numbers), "query_id"), "query-terms")


def _wanted(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query terms (query_no, query_id, term, qn) and their distinct terms (wanted, term_no), written."""
    terms = _numbered(queries)
    wanted = written(terms.select(F.col("term").alias("wanted")).distinct().withColumn("term_no", F.monotonically_increasing_id()), "terms")
    return terms, wanted


def _held_terms(docs: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """(id, dl, held): for every document the numbers of the wanted terms that it
    holds, as often as it holds them, written.  The texts are read once."""
    # the null before the tokens keeps a document without wanted terms
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term")
    exploded = tokenised(docs, id_col).select(id_col, "dl", each)
    met = exploded.join(sized(wanted), F.col("term") == F.col("wanted"), "left").where("term is null or wanted is not null")
    return written(met.groupBy(id_col, "dl").agg(F.collect_list("term_no").alias("held")), "held-terms")


def _weights(held: DataFrame, terms: DataFrame, wanted: DataFrame) -> tuple[DataFrame, float]:
    """(query_no, query_id, term_no, w), written, and the mean length: a term's
    weight is its idf times how often the query says it."""
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    df = held.select(F.explode(F.array_distinct("held")).alias("term_no")).groupBy("term_no").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = (F.col("qn") * F.when(raw <= 0, F.lit(FLOOR_IDF)).otherwise(raw)).alias("w")
    named = wanted.join(df, "term_no").withColumnRenamed("wanted", "term")
    return written(terms.join(named, "term").select("query_no", "query_id", "term_no", weight), "term-weights"), stats.avgdl or 0.0


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score) of every document with a query term.

    Statistics are those of all rows of ``docs``; a term that most documents
    hold weighs next to nothing; a term said twice in a query counts twice.
    """
    terms, wanted = _wanted(queries)
    held = _held_terms(docs, wanted, id_col)
    weights, avgdl = _weights(held, terms, wanted)
    counts = held.select(id_col, "dl", F.explode("held").alias("term_no")).groupBy(id_col, "dl", "term_no").agg(F.count(F.lit(1)).alias("tf"))
    length = K1 * (1 - B + B * F.col("dl") / avgdl)
    part = counts.select(id_col, "term_no", (F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("part"))
    met = part.join(sized(weights.select("query_id", "term_no", "w")), "term_no")
    return met.groupBy("query_id", id_col).agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id", order: str = "score") -> DataFrame:
    """Best k per query with ``rank``; equal scores by id.  Planned as a limit
    within each partition before the shuffle and one after it."""
    best = W.partitionBy("query_id").orderBy(F.round(F.col(order), 9).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best_of_block(held: DataFrame, block: list[tuple], avgdl: float, k: int, id_col: str) -> DataFrame:
    """(query_no, id, score): each task's best k of every query of a block, scored
    as a product of term frequencies and weights, a batch of documents at a time."""
    queries, query_at = np.unique([r[0] for r in block], return_inverse=True)
    terms, term_at = np.unique([r[1] for r in block], return_inverse=True)
    matrix = np.zeros((len(terms), len(queries)))
    matrix[term_at, query_at] = [r[2] for r in block]
    sent = held.sparkSession.sparkContext.broadcast((queries, terms, matrix))
    schema = StructType.fromDDL(f"query_no long, {id_col} {held.schema[id_col].dataType.simpleString()}, score double")
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, terms, matrix = sent.value
        best = np.full((len(queries), 0), -np.inf)
        ids = np.zeros((len(queries), 0), object)
        step = max(1, min(DOC_BATCH, STEP_CELLS // max(len(queries), len(terms), 1)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                lists = part.column(2)
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
                known = terms[at] == flat
                doc = np.repeat(np.arange(len(sizes)), sizes)[known]
                held_at, tf = np.unique(doc * len(terms) + at[known], return_counts=True)
                length = K1 * (1 - B + B * np.asarray(part.column(1), float) / (avgdl or 1.0))
                parts = np.zeros((len(sizes), len(terms)))
                parts.reshape(-1)[held_at] = tf * (K1 + 1) / (tf + length[held_at // len(terms)])
                scores = (parts @ matrix).T
                scores[scores <= 0] = -np.inf
                own = np.array(part.column(0).to_pylist(), object)
                best, ids = np.hstack([best, scores]), np.hstack([ids, np.broadcast_to(own, scores.shape)])
                ranks = np.argsort(np.argsort(own, kind="stable"), kind="stable") if ids.shape[1] == len(own) else None
                keys = ids if ranks is None else np.broadcast_to(ranks, ids.shape)
                order = np.array([_first(b, i, k) for b, i in zip(np.round(best, 9), keys)])
                best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
        keep = np.isfinite(best)
        columns = [np.broadcast_to(queries[:, None], best.shape)[keep], ids[keep].tolist(), best[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return held.select(id_col, "dl", "held").mapInArrow(run, schema)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        equal = np.flatnonzero(scores == kth)
        equal = equal[np.argsort(ids[equal], kind="stable")[: k - len(above)]] if np.isfinite(kth) else equal[: k - len(above)]
        return np.concatenate([above, equal])
    return np.arange(len(scores))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank): the best k documents of each query by the
    scores of ``bm25_scores``.  The queries, a stated set, are taken in blocks;
    each task keeps its best k of every query of a block while it reads the
    narrow table of held terms, and a last step merges the few rows of each query."""
    terms, wanted = _wanted(queries)
    return _best(_held_terms(docs, wanted, id_col), terms, wanted, k, id_col)


def recall_over(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> Callable[[DataFrame, int], DataFrame]:
    """``bm25_top_k`` over documents whose texts are read once, now, for several sets of
    queries whose words all stand in ``queries``, such as these and their variants.
    A call scores from the narrow table of held terms."""
    _, wanted = _wanted(queries)
    held = _held_terms(docs, wanted, id_col)
    return lambda asked, k: _best(held, _numbered(asked), wanted, k, id_col)


def _term_blocks(rows: Iterator) -> Iterator[list[tuple]]:
    """Rows (query_no, term_no, w), which stand together by query, in blocks of whole
    queries: of about ``BLOCK_TERMS`` rows, and of a table of distinct terms and
    queries that has no more than ``BLOCK_CELLS`` cells, whatever the number of queries."""
    block, terms, n_queries = [], set(), 0
    for _, own in groupby(rows, lambda r: r[0]):
        own = [tuple(r) for r in own]
        new = {r[1] for r in own} - terms
        if block and (len(block) >= BLOCK_TERMS or (len(terms) + len(new)) * (n_queries + 1) > BLOCK_CELLS):
            yield block
            block, terms, n_queries = [], set(), 0
        block += own
        terms.update(r[1] for r in own)
        n_queries += 1
    if block:
        yield block


def _best(held: DataFrame, terms: DataFrame, wanted: DataFrame, k: int, id_col: str) -> DataFrame:
    weights, avgdl = _weights(held, terms, wanted)
    numbers = weights.select("query_no", "query_id").distinct()
    rows = weights.select("query_no", "term_no", "w").orderBy("query_no", "term_no").toLocalIterator()
    parts = [_best_of_block(held, block, avgdl, k, id_col) for block in _term_blocks(rows)]
    parts = parts or [_best_of_block(held, [], avgdl, k, id_col)]
    best = reduce(DataFrame.unionAll, parts).join(numbers, "query_no")
    return top_k(best.select("query_id", id_col, "score"), k, id_col)


def _blocks(strings: DataFrame) -> Iterator[list[tuple]]:
    """The strings (string_id, string) in blocks of about ``BLOCK_CHARS`` characters."""
    block, size = [], 0
    for r in strings.select("string_id", "string").toLocalIterator():
        if block and size + len(r.string) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.string_id, r.string))
        size += len(r.string)
    if block:
        yield block


def occurrences(docs: DataFrame, strings: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, string_id, first, n, length): where each string first stands in each
    text that holds it (code points from 0), how often without overlap, and the
    length of the text.  ``strings`` (string_id, string) are a stated query set:
    each block of them is one pass over the texts.  Empty strings and nulls are
    nowhere."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = strings.schema["string_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"{id_col} {kind}, string_id {own}, first long, n long, length long")
    out_schema = to_arrow_schema(schema)
    spark = docs.sparkSession

    def made(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, out_schema)], schema=out_schema)

    def search(block: list[tuple]) -> DataFrame:
        names: dict[str, list] = {}
        for name, string in block:
            names.setdefault(string, []).append(name)
        machine = ahocorasick.Automaton()
        for string, ids in names.items():
            machine.add_word(string, (len(string), ids))
        machine.make_automaton()
        sent = spark.sparkContext.broadcast(machine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[list] = [[] for _ in out_schema]
            for batch in batches:
                for doc, body in zip(*batch.columns):  # a text at a time, so memory is that of a batch and of what goes out
                    doc, body = doc.as_py(), body.as_py()
                    found: dict[int, list] = {}
                    for end, value in sent.value.iter(body or ""):
                        size, begin = value[0], end + 1 - value[0]
                        seen = found.get(id(value))
                        if seen is None:
                            found[id(value)] = [begin, 1, end + 1, value[1]]
                        elif begin >= seen[2]:
                            seen[1], seen[2] = seen[1] + 1, begin + size
                    for begin, n, _, ids in found.values():
                        for name in ids:
                            for column, value in zip(rows, (doc, name, begin, n, len(body))):
                                column.append(value)
                        if len(rows[0]) >= FOUND_ROWS:
                            yield made(rows)
                            rows = [[] for _ in out_schema]
            if rows[0]:
                yield made(rows)

        return docs.select(id_col, text).mapInArrow(run, schema)

    parts = [search(b) for b in _blocks(strings.where(F.length("string") > 0))]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _word_terms(terms: list[str]) -> tuple[re.Pattern, Callable[[str], tuple[list[int], list[int]]]]:
    """A pattern for the pieces of a text that can hold terms (runs of signs that terms
    are made of), and a function from such a piece to the places of the terms in it and
    the characters that each covers without overlapping itself."""
    machine = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        machine.add_word(term, (k, len(term)))
    machine.make_automaton()
    runs = re.compile("[" + "".join(map(re.escape, sorted(set("".join(terms))))) + "]+")

    def held(word: str) -> tuple[list[int], list[int]]:
        ends: dict[int, int] = {}
        covered: dict[int, int] = {}
        for end, (k, size) in machine.iter(word):
            if end - size >= ends.get(k, -1):
                ends[k] = end
                covered[k] = covered.get(k, 0) + size
        return list(covered), list(covered.values())

    return runs, held


def substring_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score): occurrences of each distinct query term as a
    substring of the lower-cased text, times its length, added up.

    A term has no sign but those of its letters, so it stands inside a run of such
    signs, and what a run adds is the same in every text: a task finds it once for a
    word and adds up words.  Scores are whole numbers, so their sums are exact."""
    terms = written(query_terms(queries).where(F.length("term") > 1).select("query_id", "term"), "substring-terms")
    schema = StructType([terms.schema["query_id"], docs.schema[id_col], StructField("score", DoubleType())])
    out_schema = to_arrow_schema(schema)
    low = docs.select(id_col, F.lower("text").alias("low"))

    def search(block: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def made(rows: list[tuple], names: pa.Array) -> pa.RecordBatch:
            ids = pa.array([r[0] for r in rows], type=out_schema.field(1).type)
            columns = [names.take(pa.array(np.concatenate([r[1] for r in rows]))), ids.take(pa.array(np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([r[2] for r in rows]))], schema=out_schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, query = np.unique(np.array([q for q, _ in sent.value], object), return_inverse=True)
            wanted, term = np.unique(np.array([x for _, x in sent.value], object), return_inverse=True)
            queries, known = pa.array(names.tolist(), type=out_schema.field(0).type), {}
            runs, terms_of = _word_terms(wanted.tolist())
            rows, size, held = [], 0, 0
            for batch in batches:
                for doc, body in zip(*batch.columns):  # a text at a time, so memory is that of a batch, of words and of what goes out
                    places, parts, times = [], [], []
                    for word, n in Counter(runs.findall(body.as_py() or "")).items():
                        own = known.get(word)
                        if own is None:
                            own = terms_of(word)
                            if len(word) <= WORD_CHARS and held < KNOWN:
                                known[word] = own
                                held += 1 + len(own[0])
                        places += own[0]
                        parts += own[1]
                        times += [n] * len(own[0])
                    if not places:
                        continue
                    covered = np.bincount(places, np.multiply(parts, times), len(wanted))
                    total = np.bincount(query, covered[term], len(names))
                    at = np.flatnonzero(total)
                    rows.append((doc.as_py(), at, total[at]))
                    size += len(at)
                    if size >= FOUND_ROWS:
                        yield made(rows, queries)
                        rows, size = [], 0
            if rows:
                yield made(rows, queries)

        return low.mapInArrow(run, schema)

    strings = terms.select(F.col("query_id").alias("string_id"), F.col("term").alias("string"))
    parts = [search(b) for b in _blocks(strings)]
    every = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return every.groupBy("query_id", id_col).agg(F.sum("score").alias("score"))


def containing(docs: DataFrame, queries: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id): the first ``most`` documents by id that hold a query as it
    stands, for queries that the index cannot read."""
    strings = queries.select(F.col("query_id").alias("string_id"), F.col("query").alias("string"))
    held = occurrences(docs, strings, id_col).select(F.col("string_id").alias("query_id"), id_col)
    w = W.partitionBy("query_id").orderBy(id_col)
    return held.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
