"""Secret scan (operator 12): all rules in one byte pass of a combined deterministic automaton.

A rule is a *core*, a regex that ends with the first byte of the secret's free part, and the
class of bytes that the free part runs on with.  The cores of all rules become one minimal
deterministic automaton (``automaton``), whose transition arrays read each text once, byte by
byte.  Where a core ends, the rule's own automaton of the core read backwards finds the
leftmost start after the rule's previous match, and the match runs on to the last byte of its
class.  At its end the rule is cut out of the combined state, so matches of one rule never
overlap, as in a regex search from left to right; those of different rules may.  Matches
whose length, or whose free part's, is below the rule's least are dropped after that.

The work on a text is linear in its length: each byte is read once by the combined automaton
and, at most, once by each rule in a run and once in a backward search.  The arrays (some
hundred states) go to the tasks with the code; nothing else is shared, so a task holds one
batch of texts and its spans.  There is no shuffle.

Defined results: a null text is the empty one and has no spans; every row is judged by itself,
repeated rows and ids too; texts of any length are read whole; spans are in code points, by
start, then by the order of the rules (ties); an empty table gives no rows; extra columns of
the input are not carried on.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .automaton import Automaton, Pattern, backwards, compile_patterns


@dataclass(frozen=True)
class Rule:
    """``core`` ends with the free part's first byte; ``run`` is the class of its bytes (none: the core is all).
    ``least`` counts the bytes of the match, ``least_free`` those of its last run."""
    kind: str
    core: str
    run: str = ""
    least: int = 0
    least_free: int = 0
    ignore_case: bool = False


# The base rules' patterns and least lengths.
VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?" + VALUE, VALUE, least_free=6,
         ignore_case=True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", least=20),
    Rule("hex", "[0-9a-f]" * 24, "[0-9a-f]", least=24),
)

#: The method's own rules: public formats of further credentials.
FURTHER = (
    Rule("temporary", "ASIA[A-Z0-9]", "[A-Z0-9]", least=20),
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "[A-Za-z0-9-]", least=20),
    Rule("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]", least=30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = (*BASE, *FURTHER)


#: Bytes that begin a code point in UTF-8.
_FIRST_BYTES = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


class Scanner:
    """The combined automaton of some rules, and what each of them needs around a core's end."""

    def __init__(self, rules=RULES):
        self.rules = tuple(rules)
        trees = [Pattern(r.core, r.ignore_case).tree for r in self.rules]
        self.all: Automaton = compile_patterns(trees)
        self.back = [compile_patterns([backwards(t)], anchored=True) for t in trees]
        self.run = [frozenset(Pattern(r.run, r.ignore_case).tree[1][0][1]) if r.run else frozenset() for r in self.rules]

    def start_of(self, rule: int, data: bytes, end: int, low: int) -> int:
        """The smallest place from ``low`` on where a core begins that ends before ``end``; -1 if none does."""
        auto, state, found = self.back[rule], self.back[rule].start, -1
        table, dead, first = auto.table, auto.dead, auto.first_end
        for at in range(end - 1, low - 1, -1):
            state = table[state + data[at]]
            if state == dead:
                break
            if state >= first:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches in bytes, by start and rule."""
        auto = self.all
        table, first, ends, cuts = auto.table, auto.first_end, auto.ends, auto.cuts
        until = [0] * len(self.rules)
        found, state, at, n = [], auto.start, 0, len(data)
        pending: list[int] = []
        view = memoryview(data)
        while at < n:
            stop = min((until[r] for r in pending), default=n)
            for at, byte in enumerate(view[at:stop], at):
                state = table[state + byte]
                if state >= first:
                    opened = [r for r in ends[state >> 8] if at >= until[r]]
                    if opened:
                        break
            else:
                opened, at = [], stop - 1
            at += 1
            for r in opened:
                rule, inside, end = self.rules[r], self.run[r], at
                start = self.start_of(r, data, at, until[r])
                while end < n and data[end] in inside:
                    end += 1
                until[r] = end
                pending.append(r)
                if end - start >= rule.least and end - at + 1 >= rule.least_free:
                    found.append((start, r, end))
            if pending:
                for r in [r for r in pending if until[r] == at]:
                    state = cuts[r][state >> 8]
                    pending.remove(r)
        return sorted(found)


def in_code_points(data: bytes, spans) -> list[tuple[int, int, int]]:
    """Spans of ASCII matches, from bytes to code points."""
    out, seen, before = [], 0, 0
    for start, rule, end in spans:
        before += len(data[seen:start].translate(None, _FIRST_BYTES))
        seen = start
        out.append((start - before, rule, end - before))
    return out


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive; in order) of each row of ``docs`` (doc_id, text)."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in scanner.rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind: string, start: long, end: long>>")
    def scan(text: pa.Array) -> pa.Array:
        out = []
        for value in text:
            data = value.as_py() or b""
            out.append([{"kind": kinds[r], "start": s, "end": e}
                        for s, r, e in in_code_points(data, scanner.spans(data))])
        return pa.array(out, type=kind)

    return docs.select("doc_id", scan(F.col("text").cast("binary")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(C.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(r.kind) for r in BASE],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql_part(n: int, kind: str, pattern: str, keep: str) -> str:
    """Matches of one rule with their places: the texts between matches give the gaps."""
    return f"""
    SELECT r, {n} AS k, '{kind}' AS kind, m, s, s + length(m) AS e FROM (
        SELECT r, m, list_sum(list_transform(gaps[:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT r, regexp_extract_all(t, $re${pattern}$re$) AS hits,
                     regexp_split_to_array(t, $re${pattern}$re$) AS gaps FROM docs),
             LATERAL (SELECT unnest(hits) AS m, generate_subscripts(hits, 1) AS i))
    WHERE {keep}"""


# The rules once more as plain regular expressions.
_KEYWORD = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_HEAD = f"""(?:{_KEYWORD})["']?\\x20*[:=]\\x20*["']?"""
_SQL_RULES = (
    ("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, $re$^{_HEAD}$re$, '')) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("temporary", "ASIA[A-Z0-9]+", "length(m) >= 20"),
    ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 20"),
    ("google", "AIza[A-Za-z0-9_-]+", "length(m) >= 39"),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "length(m) >= 30"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
)

ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_part(n, *rule) for n, rule in enumerate(_SQL_RULES))}),
spans AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base,
           string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans
    FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN spans USING (r)
"""
