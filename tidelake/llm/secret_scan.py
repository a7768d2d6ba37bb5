"""Operator 6, secret scans: a trigram inverted index over the documents, in DataFrame operations only.

Each rule's regular expression yields a Boolean query over trigrams that every match must contain
(:func:`trigram_query`). One scan posts, for every trigram that any query mentions, the documents
that contain it. The postings are intersected per rule by counting, and only the candidates are
verified with the full expression. A rule without mandatory trigrams (a bare run of hex digits)
verifies every document.

Defined results: a null text counts as empty and has no spans; positions are code points, end
exclusive; within a kind matches are leftmost and do not overlap, those that fail a length test are
dropped after matching; spans of different kinds may overlap; repeated rows each get a result; rows
without doc_id too; very long texts are scanned whole, in time that grows with their length; further columns are ignored (:func:`scan` keeps those asked for); an empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as C
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents, materialised, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``measured`` is the group whose length has to reach ``least`` code points."""

    kind: str
    pattern: str
    least: int = 0
    measured: int = 0


# The three base kinds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Public formats of credentials that carry their own prefix. No group repeats without bound, as Java's
# matcher would recurse; a token's header is of 1000 characters at most, so that no text takes quadratic time.
PREFIX_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"(?:xoxb|xoxa|xoxp|xoxr|xoxs)-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Alternatives of literal text followed at once; beyond, the run of literals is cut there.
MAX_ALTERNATIVES = 64

Clauses = frozenset[frozenset[str]]  # any of: all of these trigrams
ANYTHING: Clauses = frozenset({frozenset()})


def _all_of(a: Clauses, b: Clauses) -> Clauses:
    return _reduced({x | y for x in a for y in b})


def _reduced(clauses) -> Clauses:
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


def _of_literals(texts: set[str]) -> Clauses:
    return _reduced({frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts})


def _literals(item) -> set[str] | None:
    """All texts that one parsed item can match, if few."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and all(x[0] is C.LITERAL for x in arg) and len(arg) <= 8:
        return {chr(x[1]).lower() for x in arg}
    if op is C.SUBPATTERN:
        return _sequence_literals(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence_literals(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is C.MAX_REPEAT and arg[1] == 1:
        inner = _sequence_literals(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is C.MAX_REPEAT and arg[0] == arg[1] <= 8:
        inner = _sequence_literals(list(arg[2]) * arg[0])
        return inner
    return None


def _sequence_literals(items) -> set[str] | None:
    out = {""}
    for item in items:
        found = _literals(item)
        if found is None or len(out) * len(found) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in found}
    return out


def _clauses(items) -> Clauses:
    query, run = ANYTHING, {""}
    for item in items:
        found = _literals(item)
        if found is not None and len(run) * len(found) <= MAX_ALTERNATIVES:
            run = {a + b for a in run for b in found}
            continue
        query, run = _all_of(query, _of_literals(run)), {""}
        op, arg = item
        if op is C.SUBPATTERN:
            query = _all_of(query, _clauses(arg[-1]))
        elif op is C.BRANCH:
            query = _all_of(query, _reduced(set().union(*(_clauses(x) for x in arg[1]))))
        elif op is C.MAX_REPEAT and arg[0] >= 1:
            query = _all_of(query, _clauses(arg[2]))
    return _all_of(query, _of_literals(run))


def trigram_query(pattern: str) -> Clauses:
    """Trigrams of the lower-cased text that a match needs: any of the sets, all trigrams of a set. An empty set: no need."""
    return _clauses(list(regex_parser.parse(pattern)))


def _row_key(doc_id: Column, text: Column) -> Column:
    """What postings call a row: rows without doc_id differ by their text. Rows that share a key by chance are verified each."""
    return F.xxhash64(doc_id, text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index, restricted to the trigrams that some rule asks for: (trigram, row_key)."""
    low = docs.select(_row_key(F.col("doc_id"), text_of()).alias("row_key"), F.lower(text_of()).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("row_key", F.explode(found).alias("trigram"))


def candidates(posted: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """Intersected postings: (row_key, kinds), the rules one of whose clauses is complete in the document."""
    spark = posted.sparkSession
    rows = [(kind, n, t, len(clause)) for kind, clauses in queries.items() for n, clause in enumerate(sorted(map(sorted, clauses))) for t in clause]
    wanted = spark.createDataFrame(rows, "kind string, clause int, trigram string, size int")  # as many rows as the rules have trigrams
    return (
        posted.join(F.broadcast(wanted), "trigram")
        .groupBy("row_key", "kind", "clause", "size")
        .agg(F.size(F.collect_set("trigram")).alias("met"))
        .filter("met = size")
        .groupBy("row_key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


#: Matches whose offsets are added up in one go; long lists are added up by such parts.
PART = 256


def _starts(gaps_and_lengths: Column) -> Column:
    """From (gap before a match, its length) of each match: (start, end) of each, in time linear in their number."""

    def walked(part: Column, at: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,end:int>>")
        step = lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end")))).alias("out")
        )
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step)["out"]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps_and_lengths) - 1) / PART).cast("int")), lambda i: F.slice(gaps_and_lengths, i * PART + 1, PART))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
    bases = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    return F.flatten(F.zip_with(parts, F.slice(bases, 1, F.size(parts)), walked))


def _shape(rule: Rule, text: Column, matches: Column) -> Column:
    """Of each match: code points since the match before, its own, and whether it passes the length test."""
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured)) if rule.measured else matches
    zipped = F.arrays_zip(between.alias("gap"), matches.alias("whole"), measured.alias("measured"))
    shape = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("len"), (F.length(x["measured"]) >= rule.least).alias("passes")))
    return F.when(F.size(matches) > 0, shape).otherwise(F.array().cast("array<struct<gap:int,len:int,passes:boolean>>"))


def _spans(shape: Column) -> Column:
    spans = F.zip_with(_starts(shape), shape, lambda s, x: F.when(x["passes"], s))
    return F.when(F.size(shape) > 0, F.filter(spans, lambda s: s.isNotNull())).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _marked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _quick(rule: Rule) -> Rule:
    """A run of one character class that must reach a length is the same as the class repeated so often or more."""
    if rule.measured == 0 and rule.least and rule.pattern.endswith("]+"):
        fixed = rule.pattern.partition("[")[0]
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(fixed)},}}")
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + PREFIX_RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and found, an array of (start, rank, end, kind) sorted by start, then by the rules' order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    trigrams = sorted({t for q in indexed.values() for clause in q for t in clause})
    rows = docs.select(F.col("doc_id").alias("scanned_id"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias("kept_text")]))
    whole = text_of(f"kept_{keep.index('text')}" if "text" in keep else "kept_text")
    none = F.array().cast("array<string>")
    if indexed:
        found = candidates(materialised(postings(docs, trigrams)), indexed)
        rows = rows.withColumn("row_key", _row_key(F.col("scanned_id"), whole)).join(found.hint("merge"), "row_key", "left").withColumn("kinds", F.coalesce("kinds", none))
    rows = rows.withColumn("whole", whole)
    rules, ranks = tuple(map(_quick, rules)), range(len(rules))
    for i, r in enumerate(rules):  # three steps, so that each is computed once
        matches = F.regexp_extract_all("whole", F.lit(r.pattern), F.lit(0))
        rows = rows.withColumn(f"matches_{i}", F.when(F.array_contains("kinds", r.kind), matches).otherwise(none) if r.kind in indexed else matches)
    rows = rows.withColumns({f"shape_{i}": _shape(r, F.col("whole"), F.col(f"matches_{i}")) for i, r in enumerate(rules)})
    marked = [_marked(_spans(F.col(f"shape_{i}")), i, r.kind) for i, r in zip(ranks, rules, strict=True)]
    return rows.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], F.array_sort(F.concat(*marked)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, columns: list[str], mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one mark. Clean texts stay as they are."""
    rows = scan(docs, keep=tuple(columns))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    joined = lambda a, s: F.when(
        (F.size(a["out"]) > 0) & (s["start"] < a["end"]),
        F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(F.element_at(a["out"], -1)["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end")))).alias("out"),
        ),
    ).otherwise(F.struct(s["end"].alias("end"), F.concat(a["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("out")))
    rows = rows.withColumn("runs", F.aggregate("found", start, joined)["out"])
    ends = F.concat(F.array(F.lit(0)), F.transform("runs", lambda s: s["end"]))
    starts = F.concat(F.transform("runs", lambda s: s["start"]), F.array(F.length("text")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(F.col("text"), p["a"] + 1, p["b"] - p["a"]))
    clean = F.when(F.size("runs") > 0, F.array_join(pieces, mark)).otherwise(F.col("text"))
    return rows.withColumn("text", clean).select(*columns)


_SQL_ASSIGN = BASE_RULES[0].pattern.replace("'", "''")


def _sql_spans(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos + gaps[i] AS start, pos + gaps[i] + lens[i] AS stop FROM (
    SELECT *, unnest(generate_series(1, len(lens))) AS i, coalesce(list_sum(gaps[:i - 1]), 0)::BIGINT + coalesce(list_sum(lens[:i - 1]), 0)::BIGINT AS pos FROM (
      SELECT doc_id, list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS lens, list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS sized,
        list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps FROM d WHERE regexp_matches(t, '{pattern}')
    )
  ) WHERE sized[i] >= {least}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r.kind, i, r.pattern.replace("'", "''"), r.least, r.measured) for i, r in enumerate(BASE_RULES + PREFIX_RULES))}),
j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON j.doc_id IS NOT DISTINCT FROM d.doc_id
"""

QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES = {"op6_secret_scan": ORACLE}
