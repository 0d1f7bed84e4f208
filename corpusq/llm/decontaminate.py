"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window of a benchmark item is 13 consecutive words, or the whole item when it
has fewer.  Windows of equal length form one matcher: the shift table gives,
for a block of up to three words, how far the end of a window can move on; a
block that ends windows has shift 0 and a bucket of those windows, which are
compared word for word.  Most positions of a clean document are never looked at.

Only the benchmark's tables travel: items, long ones in overlapping pieces, are
dealt to shards of a bounded number of words.  With one shard the documents are
judged in one scan.  With more, the shards are searched one after another, each
in a scan of its own that writes the texts with occurrences; what they found is
united by a hash of the text.  A text is judged by itself, so the result is the
same for any number of shards, and documents are never shuffled but by hash.

* null texts and texts without words: zero words, not contaminated; very long
  texts are searched whole;
* repeated rows, and rows that share a doc_id or have none, are judged each by
  its own text;
* items without words give no window; repeated items count once by item_id;
* a null item_id is named by the empty string;
* an empty benchmark leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_filter, arrow_scan, cut, fresh, join_sized
from .tokens import ALNUM, as_bytes

WINDOW = 13
BLOCK = 3
#: Benchmark words whose tables one Python worker holds at a time.
SHARD_WORDS = 200_000
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 20  # contaminated: a twentieth of the words or more

Words = list[bytes]


def words_of(text: str | None) -> Words:
    return as_bytes(text).translate(ALNUM).split()


class Matcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], list] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                part = window[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.longest), length - end)
            self.ending[window[-self.block :]].append((list(window), items))

    def search(self, words: Words, spans: list[int], found: set[str]) -> None:
        n, length, block, longest = len(words), self.length, self.block, self.longest
        shift, end = self.shift, self.length
        while end <= n:
            part = tuple(words[end - block : end])
            move = shift.get(part, longest)
            if move:
                end += move
                continue
            here = words[end - length : end]
            for window, items in self.ending[part]:
                if here == window:
                    spans += (end - length, end)
                    found |= items
            end += 1


def matchers(items: Iterable[tuple[str, str | None]], size: int = WINDOW) -> list[Matcher]:
    windows: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        words = words_of(text)
        length = min(size, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            windows[length][tuple(words[i : i + length])].add(name)
    return [Matcher(w, length) for length, w in sorted(windows.items())]


def covered(spans: list[int]) -> int:
    """Words inside any of the spans (start, end, start, end, ...)."""
    total = last = 0
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        start = max(start, last)
        if end > start:
            total, last = total + end - start, end
    return total


def pieces(item: str, text: str | None, size: int, most: int) -> list[tuple[str, str, int]]:
    """An item in pieces of about ``most`` words that hold all its windows."""
    words = words_of(text)
    starts = range(0, max(1, len(words) - size + 1), most)
    cut_up = [words[i : i + most + size - 1] for i in starts]
    return [(item, b" ".join(w).decode("utf-8", "surrogatepass"), len(w)) for w in cut_up if w]


def _shards(benchmark: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(item, text, shard) of the pieces of the items, and the number of shards.
    Pieces are an eighth of a shard at most, so that dealing by hash keeps
    shards near their bound."""
    most = max(size, SHARD_WORDS // 8)

    def split(c):
        found = [p for item, text in zip(c["item"], c["text"]) for p in pieces(item, text, size, most)]
        return {name: [p[k] for p in found] for k, name in enumerate(("item", "text", "n"))}

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    parts = cut(arrow_scan(items, split, "item string, text string, n long"), "benchmark-pieces")
    shards = 1 + (parts.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS
    return parts.select("item", "text", F.pmod(F.xxhash64("item", "text"), F.lit(shards)).alias("shard")), shards


def _sent(docs: DataFrame, parts: DataFrame, k: int, size: int) -> Broadcast:
    tables = matchers([(r.item, r.text) for r in parts.where(F.col("shard") == k).toLocalIterator()], size)
    return docs.sparkSession.sparkContext.broadcast(tables)


def _search(tables: list[Matcher], text: str | None) -> tuple[int, list[int], list[str]]:
    """(words, spans, items found) of a text."""
    words, spans, found = words_of(text), [], set()
    for m in tables:
        m.search(words, spans, found)
    return len(words), spans, sorted(found)


def _key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _found(docs: DataFrame, parts: DataFrame, shards: int, size: int) -> DataFrame:
    """(key, n_words, n_hit, items) of the texts with occurrences, each once, by
    one scan for every shard."""
    texts = docs.select(_key().alias("key"), "text")
    found = []
    for k in range(shards):
        sent = _sent(docs, parts, k, size)

        def look(c, sent=sent):
            looked = [(key, *_search(sent.value, t)) for key, t in zip(c["key"], c["text"])]
            hit = [x for x in looked if x[2]]
            return {name: [x[i] for x in hit] for i, name in enumerate(("key", "n_words", "spans", "items"))}

        scanned = arrow_scan(texts, look, "key string, n_words long, spans array<int>, items array<string>")
        found.append(cut(scanned.dropDuplicates(["key"]), f"shard-{k}"))
        sent.unpersist()
    united = reduce(DataFrame.unionAll, found).groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def count(c):
        return c | {"n_hit": [covered(s) for s in c["spans"]]}

    return cut(arrow_scan(united, count, "key string, n_words long, n_hit long, items array<string>"), "found")


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted names), contaminated per row."""
    parts, shards = _shards(benchmark, size)
    if shards == 1:
        sent = _sent(docs, parts, 0, size)

        def judge(c):
            looked = [_search(sent.value, t) for t in c["text"]]
            return {
                "doc_id": c["doc_id"],
                "n_words": [x[0] for x in looked],
                "n_hit": [covered(x[1]) for x in looked],
                "items": [x[2] for x in looked],
            }

        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = arrow_scan(docs.select("doc_id", "text"), judge, f"doc_id {kind}, n_words long, n_hit long, items array<string>")
    else:
        n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        found = _found(docs, parts, shards, size).drop("n_words")
        rows = join_sized(docs.select("doc_id", _key().alias("key"), n_words.alias("n_words")), found, ["key"], "left").withColumns(
            {"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))}
        )
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", _contaminated().alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, all columns as they came.  With
    one shard texts are judged where they are; with more, rows meet the hashes
    of the contaminated texts.  Either way each row goes or stays by its text."""
    parts, shards = _shards(benchmark, size)
    if shards > 1:
        name = fresh(docs, "__key")
        bad = cut(_found(docs, parts, shards, size).where(_contaminated()).select(F.col("key").alias(name)), "contaminated")
        return join_sized(docs.withColumn(name, _key()), bad, [name], "left_anti").select(*[f"`{c}`" for c in docs.columns])
    sent = _sent(docs, parts, 0, size)

    def clean(texts: list[str | None]) -> list[bool]:
        out = []
        for text in texts:
            n, spans, _ = _search(sent.value, text)
            hit = covered(spans)
            out.append(not (hit and SHARE * hit >= n))
        return out

    return arrow_filter(docs, clean)
