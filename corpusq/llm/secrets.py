r"""Secret scan with a trigram index.

For each rule a Boolean trigram query is derived from its regular expression:
literal runs and small alternatives become sets of strings, a string becomes
the conjunction of its trigrams, alternatives a disjunction.  Each segment of
texts (about a megabyte) gets an inverted index of the trigrams that occur in
the rules' queries; postings are intersected and united, and only candidate
texts are verified by the expression.  A rule without mandatory trigrams (such
as a run of hexadecimal digits) scans every text.

Postings are by segment, so the index needs no shuffle and its memory is that
of one segment.  Lower-cased trigrams serve rules of either case.

* null text counts as empty: no spans; very long texts are scanned whole, and
  repeated rows each;
* spans are code points, end exclusive, leftmost and non-overlapping per kind;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _op
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_scan
from .tokens import as_bytes, chunks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # understood alike by Python's re and RE2
    group: int  # the group whose length counts
    least: int  # characters of that group
    base: bool


# The patterns of the base kinds, then those of well-known token formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, False),
)

MOST_STRINGS = 64

# A query is True (every text), ("and", parts), ("or", parts) or a trigram.


def _all_of(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings) -> object:
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings the expression can match, or None; its query)."""
    strings: set[str] | None = {""}
    queries, whole = [], True

    def flush():
        nonlocal strings, whole
        queries.append(_of_strings(strings))
        strings, whole = {""}, False

    for op, arg in tree:
        exact, query = None, True
        if op is _op.LITERAL:
            exact = {chr(arg).lower()}
        elif op is _op.IN and all(k is _op.LITERAL for k, _ in arg):
            exact = {chr(v).lower() for _, v in arg}
        elif op is _op.SUBPATTERN:
            exact, query = _walk(arg[-1])
        elif op is _op.BRANCH:
            parts = [_walk(b) for b in arg[1]]
            exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            query = _any_of([p[1] for p in parts])
        elif op is _op.MAX_REPEAT:
            inner, inner_query = _walk(arg[2])
            if arg[0] == 0 and arg[1] == 1 and inner is not None:
                exact = inner | {""}
            elif arg[0] >= 1:
                query = inner_query
        if exact is not None and len(exact) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
        else:
            flush()
            queries.append(query if exact is None else _of_strings(exact))
    if whole:
        return strings, _of_strings(strings)
    flush()
    return None, _all_of(queries)


def trigram_query(pattern: str) -> object:
    return _walk(_parser.parse(pattern))[1]


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _evaluate(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(query, str):
        return postings[query]
    parts = [_evaluate(q, postings) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*map(_trigrams, self.queries)))
        self._wanted = None

    def wanted(self) -> np.ndarray:
        """Number of each trigram of interest by its three bytes, 0 for all others."""
        if self._wanted is None:
            self._wanted = np.zeros(1 << 24, np.uint8 if len(self.grams) < 255 else np.uint16)
            for i, g in enumerate(self.grams):
                self._wanted[int.from_bytes(g.encode("latin-1"), "big")] = i + 1
        return self._wanted

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """The segment's inverted index: texts that hold each trigram of interest."""
        joined = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        out = {g: np.empty(0, np.int64) for g in self.grams}
        if len(joined) < 3:
            return out
        wide = joined.astype(np.int32)
        kinds = self.wanted()[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
        at = np.flatnonzero(kinds)
        ends = np.cumsum([len(t) + 1 for t in texts])
        texts_at, kinds = np.searchsorted(ends, at, "right"), kinds[at]
        for i, g in enumerate(self.grams):
            out[g] = np.unique(texts_at[kinds == i + 1])
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every match, sorted, for each text."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        compiled = [re.compile(r.pattern) for r in self.rules]
        for part in chunks(texts):
            segment = [t or "" for t in texts[part]]
            postings = self.postings([as_bytes(t) for t in segment])
            for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
                candidates = range(len(segment)) if query is True else _evaluate(query, postings)
                for i in candidates:
                    found[part.start + int(i)] += [
                        (m.start(), k, m.end())
                        for m in compiled[k].finditer(segment[i])
                        if m.end(rule.group) - m.start(rule.group) >= rule.least
                    ]
        return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base) by start, then rule."""
    scanner = Scanner(rules)

    def step(c):
        spans = [
            [{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in found]
            for found in scanner.scan(c["text"])
        ]
        return {"doc_id": c["doc_id"], "spans": spans}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_scan(
        docs.select("doc_id", "text"),
        step,
        f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>",
    )


def written(spans: str, only_base: bool):
    """Spans as kind:start:end, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if only_base else F.col(spans)
    return F.array_join(
        F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
