"""Quality rules by host, in DataFrame functions only.

Each document gets counts and rule failures from its whole text.  Failures are added up
by host; a beta prior fitted to the hosts' rates by moments shrinks each host's rate, and
the host's verdict is joined back to its documents:

* ``open``: the shrunk rate is under ``strict_rate``; a document is kept unless it fails a rule;
* ``strict``: from ``strict_rate``; of the rules on shares, those that at least this share of
  the host's own documents fail have half their limit. The word floor never moves;
* ``blocked``: from ``blocked_rate``; kept as on a strict host. Nothing shuts a host with
  documents that pass.

So a clean document survives on any host, and only documents near a limit that their host
often exceeds are lost to its verdict.  ``SQL`` states the same rule; a test holds it against
the query on a table with open, strict and blocked hosts.

Defined results: a null or blank text has no words, fails ``few_words`` and is not kept.
A null host is a host of its own.  Repeated rows each count and each return.  An empty
table returns no rows.  All input columns are carried in a struct, so no name clashes.

Repeated windows are recognised by 64-bit hashes of their three words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Limits as shares of the words.
MAX_REPEATED, MAX_SYMBOLS, MAX_MARKS = 0.5, 0.1, 0.3
STRICT_RATE, BLOCKED_RATE = 0.3, 0.9
#: The rules that a host's verdict may tighten.
SHARES = ("repeated", "symbols", "marks")
#: Weight of the prior, in documents, where all hosts have one rate.
POOLED = 1e6


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), then), 0)


def features(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``row`` (all input columns), ``host`` (never null), the counts of each document, and ``place``, which keeps later filters above the counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(common.words(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    held = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        host.alias("host"),
        counts.alias("c"),
        (F.length(text) - F.length(common.without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.monotonically_increasing_id().alias("place"),
    )
    long = lambda c: F.col(f"c.{c}").cast("long").alias(c)
    return held.select("row", "host", long("n_words"), long("word_chars"), long("n_repeat_words"), "n_symbols", "n_marks", "n_dup_lines", "place")


def _repeated(w: Column) -> Column:
    """Words under three-word windows that occur twice. Few texts repeat a window; only they pay for the sort."""
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered(h), _covered)))
    return F.coalesce(found, F.lit(0))


def _covered(windows: Column) -> Column:
    """Words under the windows whose hash a neighbour shares: each start adds three, less its overlap with the start before."""
    same = lambda x, i: (F.get(windows, i - 1).h == x.h) | (F.get(windows, i + 1).h == x.h)
    starts = F.sort_array(F.transform(F.filter(windows, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x.at))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(starts, zero, lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)


def _fails(share: float = 1.0) -> dict[str, Column]:
    """The rules, at this share of their limits."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS / share,
        "repeated": F.col("n_repeat_words") > MAX_REPEATED * share * n,
        "symbols": F.col("n_symbols") > MAX_SYMBOLS * share * n,
        "marks": F.col("n_marks") > MAX_MARKS * share * n,
    }


def _any(fails: dict[str, Column]) -> Column:
    found = F.lit(False)
    for f in fails.values():
        found = found | f
    return found


def hosts(counted: DataFrame, strict_rate: float = STRICT_RATE, blocked_rate: float = BLOCKED_RATE) -> DataFrame:
    """host, docs, failed, each rule's failures, rate (shrunk), verdict, tight (the rules that the verdict tightens).  One job for the hosts' sums, one for their one-row prior."""
    fails = _fails()
    sums = [F.count("*").alias("docs"), F.sum(_any(fails).cast("long")).alias("failed")]
    found = common.cut(counted.groupBy("host").agg(*sums, *[F.sum(f.cast("long")).alias(k) for k, f in fails.items()]))
    rate = F.col("failed") / F.col("docs")
    m = found.agg(F.sum("failed").alias("f"), F.sum("docs").alias("n"), F.count("*").alias("k"), F.sum(F.col("failed") * rate).alias("ff")).first()
    a, b = beta_prior(m.f or 0, m.n or 0, m.k, m.ff or 0.0)
    shrunk = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    verdict = F.when(F.col("rate") >= blocked_rate, "blocked").when(F.col("rate") >= strict_rate, "strict").otherwise("open")
    own = F.struct(*[(F.col(k) >= F.lit(strict_rate) * F.col("docs")).alias(k) for k in SHARES])
    return found.withColumn("rate", shrunk).withColumn("verdict", verdict).withColumn("tight", F.when(F.col("verdict") != "open", own))


def beta_prior(failed: int, docs: int, hosts: int, squares: float) -> tuple[float, float]:
    """Beta parameters by moments: the spread of the hosts' rates beyond what counting explains. squares: sum of failed^2 / docs."""
    if not docs:
        return 0.5, 0.5
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    spread = squares / docs - mean**2 - mean * (1 - mean) * hosts / docs
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), POOLED) if spread > mean * (1 - mean) / POOLED else POOLED
    return mean * weight, (1 - mean) * weight


def judge(counted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``counted`` with rate, verdict, base_failed and kept. A host that isn't among the verdicts, a written table, tightens nothing."""
    fails, strict = _fails(), _fails(0.5)
    joined = common.join_few(counted, verdicts.select("host", "rate", "verdict", "tight"), ["host"], "left")
    near = _any({k: F.coalesce(F.col(f"tight.{k}"), F.lit(False)) & strict[k] for k in SHARES})
    kept = ~_any(fails) & ~near
    return joined.withColumn("base_failed", fails["few_words"] | fails["repeated"]).withColumn("kept", kept & (F.col("place") >= 0)).drop("tight")


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = features(docs)
    counted = common.cut(counted.withColumn("row", F.struct("row.doc_id")))
    found = judge(counted, hosts(counted))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, with the columns of ``docs``; texts are read twice rather than written, and join the hosts that aren't open only."""
    strict = common.cut(hosts(features(docs)).where("verdict <> 'open'"))
    return judge(features(docs), strict).where("kept").select("row.*")


_COUNTS = r"""
d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS rn FROM {docs}),
wins AS (SELECT rn, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM wins),
rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rn, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rn),
c AS (SELECT d.rn, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (rn)),
f AS (SELECT *, n_words < 50 OR n_repeat_words > 0.5 * n_words AS base_failed, n_repeat_words > 0.5 * n_words AS f_repeated, n_symbols > 0.1 * n_words AS f_symbols, n_marks > 0.3 * n_words AS f_marks,
  n_repeat_words > 0.25 * n_words AS near_repeated, n_symbols > 0.05 * n_words AS near_symbols, n_marks > 0.15 * n_words AS near_marks FROM c),
h AS (SELECT host, count(*)::DOUBLE AS docs, sum((base_failed OR f_symbols OR f_marks)::INT)::DOUBLE AS failed,
  sum(f_repeated::INT)::DOUBLE AS s_repeated, sum(f_symbols::INT)::DOUBLE AS s_symbols, sum(f_marks::INT)::DOUBLE AS s_marks FROM f GROUP BY host),
m AS (SELECT least(greatest(sum(failed) / sum(docs), 1e-6), 1 - 1e-6) AS p, sum(failed * failed / docs) / sum(docs) AS q, count(*) / sum(docs) AS k FROM h),
s AS (SELECT p, q - p * p - p * (1 - p) * k AS spread FROM m),
k AS (SELECT p, CASE WHEN spread > p * (1 - p) / 1e6 THEN least(greatest(p * (1 - p) / spread - 1, 1), 1e6) ELSE 1e6 END AS weight FROM s),
v AS (SELECT host, (failed + p * weight) / (docs + weight) AS rate, s_repeated >= 0.3 * docs AS t_repeated, s_symbols >= 0.3 * docs AS t_symbols, s_marks >= 0.3 * docs AS t_marks FROM h, k),
j AS (SELECT f.*, t_repeated AND near_repeated OR t_symbols AND near_symbols OR t_marks AND near_marks AS near, CASE WHEN rate >= 0.9 THEN 'blocked' WHEN rate >= 0.3 THEN 'strict' ELSE 'open' END AS verdict FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host),
judged AS (SELECT *, NOT base_failed AND NOT f_symbols AND NOT f_marks AND (verdict = 'open' OR NOT near) AS kept FROM j)
"""
SQL = "WITH " + _COUNTS.replace("{docs}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, verdict FROM judged"
