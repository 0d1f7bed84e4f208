"""Text functions as built-in column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics that the lexical index folds, and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Words that a query is expanded without, and prefixes of questions.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
)
QUESTION_PREFIXES = ("what is", "what are", "how to", "how do", "how does", "why is", "why does", "who is", "where is")


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Index tokens: lower case, diacritics folded, runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(c: Column) -> Column:
    """Query tokens: as index tokens, with underscores inside."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    return F.array_distinct(F.filter(query_tokens(c), lambda t: F.length(t) > 1))


def normalise(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def signature(c: Column) -> Column:
    """MD5 of the normalised text; empty text gives the empty string."""
    n = normalise(F.coalesce(c, F.lit("")))
    return F.when(n == "", F.lit("")).otherwise(F.md5(n))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two token sets, 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common tokens over those of the smaller set, 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.least(F.size(a), F.size(b)))


def redundant(text_a: Column, text_b: Column, set_a: Column, set_b: Column, least: float = 0.85, chars: int = 80) -> Column:
    """The shorter text stands in the longer one, or the token sets overlap."""
    shorter = F.when(F.length(text_a) <= F.length(text_b), text_a).otherwise(text_b)
    longer = F.when(F.length(text_a) <= F.length(text_b), text_b).otherwise(text_a)
    contained = (F.length(shorter) >= chars) & longer.contains(shorter)
    return contained | (overlap(set_a, set_b) >= least)


def unique_strings(c: Column) -> Column:
    """Trimmed non-empty strings, the first of those equal without case kept, in order."""
    clean = F.filter(F.transform(c, lambda t: F.trim(t)), lambda s: F.length(s) > 0)
    return F.filter(
        clean,
        lambda s, i: F.array_position(F.transform(clean, F.lower), F.lower(s)) == (i + 1).cast("long"),
    )


def expand_query(c: Column, most: int = 5) -> Column:
    """Variants of a query: keywords without stop words, quoted phrases, parts
    between separators and the query without its question words; at most five."""
    keywords = F.filter(query_tokens(c), lambda t: ~t.isin(*STOP_WORDS))
    joined = F.when(F.size(keywords) >= 2, F.array(F.array_join(keywords, " "))).otherwise(F.array().cast("array<string>"))
    quoted = F.filter(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)), lambda s: F.length(s) >= 3)
    parts = F.split(c, r"[,;:，；：、]")
    separated = F.when(
        F.size(parts) > 1, F.filter(F.transform(parts, lambda t: F.trim(t)), lambda s: F.length(s) >= 5)
    ).otherwise(F.array().cast("array<string>"))
    prefix = "(?i)^(" + "|".join(QUESTION_PREFIXES) + r")\s+"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), prefix, ""), r"[?？]+$", ""))
    stripped = F.when((F.length(bare) >= 3) & (F.lower(bare) != F.lower(F.trim(c))), F.array(bare)).otherwise(
        F.array().cast("array<string>")
    )
    variants = unique_strings(F.concat(joined, quoted, separated, stripped))
    return F.slice(F.filter(variants, lambda s: F.lower(s) != F.lower(F.trim(c))), 1, most)


def contains_all(c: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.lower(c).contains(t.lower()) for t in terms])


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(t.lower()) for t in terms])


def tokens_for_usage(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def tokens_for_chunks(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(c) + 3) / 4).cast("long")


def tokens_for_context(c: Column) -> Column:
    """Two thirds of the CJK characters and a quarter of the others."""
    cjk = F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return F.floor(cjk / 1.5 + (F.length(c) - cjk) / 4).cast("long")


def wiki_slug(c: Column) -> Column:
    """Lower case, white space to hyphens, other signs to hyphens, 160 characters, or ``page``."""
    spaced = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")
    clean = F.regexp_replace(F.regexp_replace(spaced, r"[^0-9a-zA-Z\x{4e00}-\x{9fff}/_-]+", "-"), r"^-+|-+$", "")
    cut = F.substring(clean, 1, 160)
    return F.when(F.length(cut) == 0, F.lit("page")).otherwise(cut)


def view_slug(c: Column) -> Column:
    """Lower case, every run of signs that are neither letter nor digit to one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def wiki_links(c: Column) -> Column:
    """Slugs of the [[slug|label]] links of a page, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda t: F.trim(t))


def replace_dead_links(c: Column, known: Column) -> Column:
    """Links whose slug is not in ``known`` become their label, or their slug."""
    whole = F.regexp_extract_all(c, F.lit(r"(\[\[[^\]]+\]\])"), F.lit(1))

    def mended(text: Column, link: Column) -> Column:
        slug = F.trim(F.regexp_extract(link, r"\[\[([^\]|]+)", 1))
        label = F.trim(F.regexp_extract(link, r"\|([^\]]*)\]\]", 1))
        plain = F.when(F.length(label) > 0, label).otherwise(slug)
        return F.when(F.array_contains(known, slug), text).otherwise(F.replace(text, link, plain))

    return F.aggregate(F.array_distinct(whole), c, mended)


def eval_keywords(c: Column) -> Column:
    """Parts of two characters or more between punctuation and space, none all digits, distinct."""
    parts = F.split(F.lower(c), r"[\s,.;:!?，。；：！？、()（）\[\]\"'“”]+")
    return F.array_distinct(F.filter(parts, lambda s: (F.length(s) >= 2) & ~s.rlike(r"^\p{Nd}+$")))


def candidate_names(c: Column) -> Column:
    """Names a text mentions: runs of up to four capitalised words of two letters or more."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+){0,3})"), F.lit(1)))


def strip_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def shorten(c: Column, most: int) -> Column:
    """White space collapsed; cut with an ellipsis when longer."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def truncate_history(c: Column, most: int = 1000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def file_type(name: Column, mime: Column | None = None) -> Column:
    """Suffix in lower case, else the second half of the media type."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    other = F.lower(F.regexp_extract(mime, r"/([A-Za-z0-9.+-]+)$", 1)) if mime is not None else F.lit("")
    return F.when(suffix != "", suffix).otherwise(other)


def valid_sha256(c: Column) -> Column:
    """The lower-case digest when it is one, else null."""
    return F.when(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lower(c))


def row_number_of_id(c: Column) -> Column:
    """Integer of the first 15 hexadecimal digits of the SHA-1 of an id."""
    return F.conv(F.substring(F.sha1(c), 1, 15), 16, 10).cast("long")


def replace_names(c: Column, names: Mapping[str, str]) -> Column:
    """Literal replacement, longest name first."""
    for name in sorted(names, key=lambda n: (-len(n), n)):
        c = F.replace(c, F.lit(name), F.lit(names[name]))
    return c


def csv_list(c: Column) -> Column:
    """Trimmed non-empty items of a comma-separated list, first of equals kept."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda s: F.length(s) > 0))


def usage_field(props: Column, *paths: str) -> Column:
    """First of several JSON paths that holds a value, as a long that is not negative."""
    found = F.coalesce(*[F.get_json_object(props, p) for p in paths], F.lit("0"))
    return F.greatest(F.lit(0), found.cast("double").cast("long"))


def intent(c: Column) -> Column:
    """Rough intent of a message by length and words."""
    low = F.lower(F.trim(c))
    return (
        F.when(F.length(low) == 0, F.lit("empty"))
        .when(low.rlike(r"^(hi|hello|hey|thanks|thank you|bye)\b"), F.lit("chitchat"))
        .when(low.rlike(r"\b(summar|overview|abstract)"), F.lit("summary"))
        .when(low.rlike(r"\b(compare|difference|versus|vs)\b"), F.lit("compare"))
        .otherwise(F.lit("search"))
    )


def safe_rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio, 0 when the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits))


def column_name(index: Column) -> Column:
    """Spreadsheet column name of a 0-based index below 18,278."""
    letter = lambda n: F.char(F.lit(65) + n)
    one, two, three = index, index - 26, index - 702
    return (
        F.when(index < 26, letter(one))
        .when(index < 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(
            F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26))))
        )
    )


def first_json_object(c: Column) -> Column:
    """The outermost {...} of a text when it parses, else null."""
    whole = F.trim(c)
    greedy = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    lazy = F.regexp_extract(c, r"(?s)(\{.*?\})", 1)
    fenced = F.trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))
    usable = [F.when((x != "") & F.get_json_object(x, "$").isNotNull() & x.startswith("{"), x) for x in (whole, fenced, greedy, lazy)]
    return F.coalesce(*usable)


def concat_overlapping(a: Column, b: Column, most: int = 200) -> Column:
    """Two texts joined, the longest end of the first that begins the second said once."""
    n = F.array_max(
        F.filter(
            F.sequence(F.lit(0), F.least(F.length(a), F.length(b), F.lit(most))),
            lambda k: F.right(a, k) == F.left(b, k),
        )
    )
    return F.concat(a, F.substring(b, n + 1, F.length(b)))


def strip_html(c: Column) -> Column:
    """Scripts and styles go, every other tag becomes a space."""
    bare = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    return F.regexp_replace(bare, r"(?s)<[^>]+>", " ")


def strip_html_flat(c: Column, most: int = 8000) -> Column:
    """As ``strip_html``, white space collapsed, trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(strip_html(c), r"[ \t\n\r\f\x0B]+", " ")), 1, most)
