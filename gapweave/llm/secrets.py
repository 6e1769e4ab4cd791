"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression yields a Boolean query over the trigrams that every match must
contain (``trigrams.query``).  The index holds the postings of the trigrams which the rules ask
for; intersecting them leaves candidates, and only these are verified with the expression.  Rules
without a mandatory trigram scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm import trigrams
from gapweave.llm.common import ascii_lower, materialize, table


@dataclass(frozen=True)
class Rule:
    """A match counts if group ``group`` has ``least`` characters or more; failing matches are
    dropped and the scan goes on behind them.  The expression must mean the same to Java and to
    Python's parser and match no empty string."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order of results.  A run of 24 hex digits or more is the same as a whole
#: run that has 24, so the length is part of the expression; likewise for access keys.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("vcs", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + MORE
#: Largest number of candidate keys that is broadcast (16 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000

#: Matches of a text whose places are summed in one go.
BLOCK = 256

SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def spans(text: Column, rule: Rule, k: int) -> Column:
    """array<struct<s,k,e>>: the matches in code points, end exclusive.  ``split`` gives what lies
    between the matches, so a running sum of lengths gives each match its place."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(
        F.slice(F.split(text, rule.regex, -1), 1, F.greatest(F.size(whole), F.lit(0))).alias("p"), whole.alias("m"), value.alias("v")
    )
    step = F.transform(zipped, lambda x: (F.length(x["p"]) + F.length(x["m"])).cast("long"))
    ends = F.transform(F.arrays_zip(zipped.alias("x"), running_sums(step).alias("e")), lambda y: F.struct(y["x"]["m"].alias("m"), y["x"]["v"].alias("v"), y["e"].alias("e")))
    good = F.filter(ends, lambda y: F.length(y["v"]) >= rule.least)
    found = F.transform(good, lambda y: F.struct((y["e"] - F.length(y["m"])).alias("s"), F.lit(k).alias("k"), y["e"].alias("e")))
    return F.when(text.rlike(rule.regex), found).otherwise(F.array().cast(SPAN))


def running_sums(x: Column) -> Column:
    """The sums of the first 1, 2, ... numbers, block by block: no array grows number by number."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda c, v: c + v)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(x, at + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, total)
    before = F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))
    each = F.transform(
        F.arrays_zip(blocks.alias("b"), before.alias("o")),
        lambda y: F.transform(y["b"], lambda _, i: y["o"] + total(F.slice(y["b"], F.lit(1), i + 1))),
    )
    return F.flatten(each)


def _condition(q, present: Column) -> Column:
    if q is True:
        return F.lit(True)
    if q[0] == "tri":
        return F.array_contains(present, q[1])
    out = _condition(q[1], present)
    for x in q[2:]:
        out = (out & _condition(x, present)) if q[0] == "and" else (out | _condition(x, present))
    return out


def build_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The postings (trigram, doc_id, th) of the given trigrams over lower-cased texts."""
    low = docs.select("doc_id", F.xxhash64("text").alias("th"), ascii_lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in vocabulary]))
    return low.select("doc_id", "th", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, tuple]) -> DataFrame:
    """(doc_id, th, rules array<int>): the documents whose postings satisfy a rule's query."""
    present = index.groupBy("doc_id", "th").agg(F.collect_set("trigram").alias("t"))
    ok = F.array_compact(F.array(*[F.when(_condition(q, F.col("t")), F.lit(k)) for k, q in queries.items()]))
    return present.select("doc_id", "th", ok.alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, th, spans): one row for each distinct (doc_id, text); spans sorted by start, then by
    the order of the rules.  Null and empty texts have no spans."""
    queries = {k: trigrams.query(r.regex) for k, r in enumerate(rules)}
    mandatory = {k: q for k, q in queries.items() if q is not True}
    full = [k for k, q in queries.items() if q is True]
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "text")
    everywhere = F.concat(*[spans(text, rules[k], k) for k in full], F.array().cast(SPAN))
    out = d.select("doc_id", F.xxhash64("text").alias("th"), everywhere.alias("a")).dropDuplicates(["doc_id", "th"])
    if mandatory:
        index = build_index(d, sorted(set().union(*map(trigrams.terms, mandatory.values()))))
        found = materialize(candidates(index, mandatory), "secret-candidates")
        c = found.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "rules")
        if found.count() <= BROADCAST_ROWS:
            c = F.broadcast(c)
        picked = d.join(c, d["doc_id"].eqNullSafe(F.col("c_id")) & (F.xxhash64(d["text"]) == F.col("c_th")))
        verified = [F.when(F.array_contains("rules", k), spans(text, rules[k], k)).otherwise(F.array().cast(SPAN)) for k in mandatory]
        v = picked.select("c_id", "c_th", F.concat(*verified).alias("b")).where(F.size("b") > 0).dropDuplicates(["c_id", "c_th"])
        out = out.join(v, out["doc_id"].eqNullSafe(v["c_id"]) & (out["th"] == v["c_th"]), "left")
    else:
        out = out.withColumn("b", F.array().cast(SPAN))
    return out.select("doc_id", "th", F.array_sort(F.concat("a", F.coalesce("b", F.array().cast(SPAN)))).alias("spans"))


def _listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans."""
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.k = {k})) AS BIGINT)").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return scan(docs, rules).select("doc_id", *counts, F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same by splitting in SQL, every rule over every text."""
    one = "SELECT {k} AS k, '{kind}' AS kind, doc_id, regexp_extract_all(t, '{rx}', 0) AS ms, regexp_extract_all(t, '{rx}', {g}) AS vs, string_split_regex(t, '{rx}') AS ps FROM d WHERE regexp_matches(t, '{rx}')"
    hits = " UNION ALL ".join(one.format(k=k, kind=r.kind, rx=r.regex.replace("'", "''"), g=r.group) + "" for k, r in enumerate(RULES))
    least = "CASE k " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES)) + " END"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS ({hits}),
u AS (SELECT k, kind, doc_id, ms, vs, ps, unnest(range(1, len(ms) + 1)) AS i FROM h),
s AS (
  SELECT k, kind, doc_id, len(vs[i]) AS n,
         length(array_to_string(ps[1:i], '')) + coalesce(length(array_to_string(ms[1:i - 1], '')), 0) AS s, length(ms[i]) AS m
  FROM u
), ok AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + m AS BIGINT) AS x FROM s WHERE n >= {least}),
g AS (
  SELECT doc_id, {counts}, sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
         string_agg(x, ',' ORDER BY s, k) AS spans
  FROM ok GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP9_SQL = _sql()
