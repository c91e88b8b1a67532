"""Quality rules with risk-controlled thresholds.

Every rule compares one share of a text with a cutoff. The labelled documents of good quality are the holdout:
no rule is fitted to them. For a stratum (language), a rule and a cutoff, with n good documents of which the
rule would reject k, the exact binomial test of "the rule rejects more than a share `risk` of good documents"
has p-value P(Binomial(n, risk) <= k); equivalently, the upper Clopper-Pearson bound of the false rejection
rate is at most `risk` when p is small enough. Cutoffs of one rule are tested from the laxest on until one
fails (fixed sequence, which needs no correction), rules and strata are corrected by Bonferroni. The tightest
cutoff that passes is used; if none passes, for instance for lack of labels, the rule rejects nothing there.
With probability 1 - DELTA, no stratum loses more than RISK of its good documents to all rules together, as each
rule has RISK / number of rules.

Splitting the risk over the rules needs many labels (about 1,150 good ones in each of four strata). choose_certified(), which
op1 and the pipeline use, spends half of DELTA on that and the other half on one fixed sequence of combined rejectors
(joint_path()) for each stratum in which not all rules have got a cutoff: strata that are large enough alone, the rest as one
pool, whose bound holds for the pool. A stratum then takes the tightest combined rejector that passes.

Nulls: a null text has no words and fails the base rules; a null language is a stratum of its own; labels that
are null are ignored, and of several labels of one document the lowest counts. Texts without labels are judged
by their stratum's cutoffs. Repeated rows are judged alike. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import RID, SPACE, materialize, number_rows

#: Share of good documents that all rules together may reject in a stratum, and the chance that a bound fails.
RISK, DELTA = 0.02, 0.05
#: Shares of a text and the cutoffs that are tried, from lax to tight. A text is rejected above the cutoff.
RULES = {
    "symbol_share": (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.49, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}
_INDEX_BITS = 24


def features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of rows (which has text), n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.select(
        *keep,
        F.array_remove(F.split(text, SPACE + "+"), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
    )
    n = F.size("w")
    counted = cut.select(
        *keep, "w", "n_symbols", "n_capitals",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform("w", lambda x: F.xxhash64(x))).alias("h"),
    )
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    m = F.col("n_words").cast("int") - 2
    # Hashes of 3-word windows with their places in the low bits, sorted: equal windows stand side by side.
    h3 = F.zip_with(F.zip_with(F.slice("h", F.lit(1), m), F.slice("h", F.lit(2), m), lambda a, b: F.xxhash64(a, b)), F.slice("h", F.lit(3), m), lambda a, b: F.xxhash64(a, b))
    packed = F.transform(h3, lambda x, i: F.shiftleft(x, _INDEX_BITS).bitwiseOR(i.cast("long")))
    sorted_ = counted.select(*kept, "w", F.when((m >= 2) & (m < 2**_INDEX_BITS), F.sort_array(packed)).when(m >= 2, F.array(F.lit(0).cast("long"))).alias("s"))
    same = lambda a, b: F.coalesce(F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS), F.lit(False))
    near = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    places = F.transform(near, lambda x: x.bitwiseAND(F.lit(2**_INDEX_BITS - 1).cast("long")).cast("int"))
    likely = sorted_.select(*kept, "w", F.when(m >= 2**_INDEX_BITS, F.sequence(F.lit(0), m - 1)).when(m >= 2, places).alias("at"))
    # Only these windows can be repeated; whether they are is decided on the words themselves.
    window = lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("t"), i.alias("i"))
    texts = likely.select(*kept, F.when(F.size("at") > 0, F.sort_array(F.transform("at", window))).alias("c"))
    equal = lambda a, b: F.coalesce(a["t"] == b["t"], F.lit(False))
    twice = F.filter("c", lambda x, i: equal(x, F.get("c", i - 1)) | equal(x, F.get("c", i + 1)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return texts.select(*kept, F.when(F.size("c") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def with_shares(feats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return feats.withColumns({
        "base_failed": failed,
        "symbol_share": _share("n_symbols", "word_chars"), "capital_share": _share("n_capitals", "word_chars"),
        "repeat_share": _share("n_repeat_words", "n_words"), "dup_line_share": _share("n_dup_lines", "n_lines"),
    })


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly but for rounding; 1 where k exceeds the mean, as no test passes there."""
    import math

    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, step)["s"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def _holdout(shares: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of shares that are labelled good and pass the base rules."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return shares.where(~F.col("base_failed")).join(marked.where("quality = 1").select("doc_id"), "doc_id")


def choose_cutoffs(shares: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k) of the tightest cutoffs that pass; shares has doc_id, stratum, base_failed and the shares."""
    good = _holdout(shares, labels)
    tried = [(r, c) for r, cs in RULES.items() for c in cs]
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(r) > c, 1)).alias(f"k{i}") for i, (r, c) in enumerate(tried)])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(tried)])
    each = counts.select("stratum", "n", F.explode(pairs).alias("x")).select("stratum", "n", "x.*")
    tests = counts.agg((F.count(F.lit(1)) * len(RULES)).alias("tests"))
    p = each.withColumn("p", binomial_cdf(F.col("n"), F.col("k"), risk / len(RULES)))
    passed = p.join(F.broadcast(tests)).where(F.col("p") <= F.lit(delta) / F.col("tests"))  # one row of tests
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def joint_path() -> list[dict[str, float]]:
    """Combined rejectors, a cutoff for each rule, from lax to tight."""
    steps = max(map(len, RULES.values()))
    return [{r: cs[round(t * (len(cs) - 1) / (steps - 1))] for r, cs in RULES.items()} for t in range(steps)]


def choose_certified(shares: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): those of choose_cutoffs() where every rule has one, else those of the tightest combined rejector that passes."""
    split = materialize(choose_cutoffs(shares, labels, risk, delta / 2), "split")
    path = joint_path()
    steps = len(path)
    over = [F.greatest(*[F.col(r) > c for r, c in cut.items()]) for cut in path]
    counts = _holdout(shares, labels).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(x, 1)).alias(f"k{t}") for t, x in enumerate(over)])
    # Strata from the largest on, as long as one without a false rejection would pass beside those before it and the pool.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "stratum")) + 1  # a row per stratum
    alone = F.pow(F.lit(1 - risk), F.col("n")) <= F.lit(delta / 2) / place
    counts = materialize(counts.withColumn("alone", alone), "strata")
    families = counts.where("alone").count() + 1
    family = F.when(F.col("alone"), F.col("stratum"))
    sums = counts.groupBy(family.alias("family")).agg(*[F.sum(c).alias(c) for c in ("n", *[f"k{t}" for t in range(steps)])])
    each = sums.select("family", "n", F.posexplode(F.array(*[f"k{t}" for t in range(steps)])).alias("t", "k"))
    # More is rejected from step to step, so the last step that passes ends the sequence.
    last = each.where(binomial_cdf(F.col("n"), F.col("k"), risk) <= delta / 2 / families).groupBy("family").agg(F.max("t").alias("t"))
    cuts = F.array(*[F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff")) for r, c in cut.items()]) for cut in path])
    joint = counts.select("stratum", family.alias("of")).join(last, F.col("of").eqNullSafe(F.col("family"))).select("stratum", F.inline(F.get(cuts, F.col("t"))))
    whole = split.groupBy("stratum").agg(F.count(F.lit(1)).alias("rules")).where(F.col("rules") == len(RULES))
    joint = joint.join(whole, "stratum", "left_anti")
    return joint.unionByName(split.join(joint.select("stratum").distinct(), "stratum", "left_anti"))


def judge(shares: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """shares with kept."""
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = wide.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in RULES])
    met = shares.join(wide, F.col("stratum") == F.col("__stratum"), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"__{r}"), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum", *[f"__{r}" for r in RULES])


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, choose=choose_cutoffs) -> DataFrame:
    """RID, doc_id, features, shares, base_failed and kept of each row of docs (with RID, doc_id, text, lang)."""
    rows = docs.select(RID, F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), "text")
    shares = with_shares(materialize(features(rows, [RID, "doc_id", "stratum"]), "features"))
    # A small table (strata times rules), written so that the verdicts all come from one choice.
    cutoffs = materialize(choose(shares, labels.select("doc_id", "quality"), risk, delta), "cutoffs")
    return judge(shares, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept by the cutoffs of choose_certified(), with all their columns."""
    numbered = number_rows(docs)
    return numbered.join(judged(numbered, labels, choose=choose_certified).where("kept").select(RID), RID, "left_semi").drop(RID)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", "lang").withColumn(RID, F.lit(0).cast("long"))
    return judged(rows, labels, choose=choose_certified).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged_sql(table: str) -> str:
    """DuckDB SQL for the rows of op1 over a table with doc_id, text and lang."""
    tried = ", ".join(f"('{r}', CAST({c} AS DOUBLE))" for r, cs in RULES.items() for c in cs)
    risk = RISK / len(RULES)
    steps = ", ".join(f"({t}, '{r}', CAST({c} AS DOUBLE))" for t, cut in enumerate(joint_path()) for r, c in cut.items())
    tail = lambda p: f"CASE WHEN k > n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM {table}),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
win3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win3) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END AS capital_share,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share FROM f),
good AS (SELECT s.* FROM s JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) g ON g.doc_id = s.doc_id WHERE NOT base_failed),
long AS (SELECT rid, stratum, rule, share FROM (SELECT row_number() OVER () AS rid, stratum, symbol_share, capital_share, repeat_share, dup_line_share FROM good) UNPIVOT (share FOR rule IN (symbol_share, capital_share, repeat_share, dup_line_share))),
tried(rule, cutoff) AS (VALUES {tried}),
k AS (SELECT stratum, tried.rule, cutoff, count(*) AS n, count(*) FILTER (WHERE share > cutoff) AS k FROM long JOIN tried ON tried.rule = long.rule GROUP BY ALL),
p AS (SELECT *, {tail(risk)} AS p FROM k),
split AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM p WHERE p <= {DELTA / 2} / (SELECT count(DISTINCT stratum) * {len(RULES)} FROM good) GROUP BY ALL),
steps(t, rule, cutoff) AS (VALUES {steps}),
strata AS (SELECT stratum, n, pow(1 - {RISK}, n) <= {DELTA / 2} / (row_number() OVER (ORDER BY n DESC, stratum) + 1) AS alone FROM (SELECT stratum, count(*) AS n FROM good GROUP BY stratum)),
over AS (SELECT stratum, t, count(DISTINCT rid) AS k FROM long JOIN steps ON steps.rule = long.rule AND share > cutoff GROUP BY ALL),
family AS (SELECT CASE WHEN alone THEN stratum END AS family, t, sum(n) AS n, CAST(sum(coalesce(k, 0)) AS BIGINT) AS k
  FROM (SELECT strata.*, s.t, over.k FROM strata CROSS JOIN (SELECT DISTINCT t FROM steps) s LEFT JOIN over ON over.stratum = strata.stratum AND over.t = s.t) GROUP BY ALL),
last AS (SELECT family, max(t) AS t FROM (SELECT family, t, CAST(n AS BIGINT) AS n, k, {tail(RISK)} AS p FROM (SELECT family, t, CAST(n AS BIGINT) AS n, k FROM family))
  WHERE p <= {DELTA / 2} / (SELECT count(*) FILTER (alone) + 1 FROM strata) GROUP BY family),
joint AS (SELECT stratum, rule, cutoff FROM strata JOIN last ON last.family IS NOT DISTINCT FROM CASE WHEN alone THEN stratum END JOIN steps ON steps.t = last.t
  WHERE stratum NOT IN (SELECT stratum FROM split GROUP BY stratum HAVING count(*) = {len(RULES)})),
c AS (SELECT * FROM joint UNION ALL SELECT * FROM split WHERE stratum NOT IN (SELECT stratum FROM joint)),
v AS (SELECT s.*, NOT base_failed AND NOT EXISTS (SELECT 1 FROM c WHERE c.stratum = s.stratum AND
  CASE c.rule WHEN 'symbol_share' THEN symbol_share WHEN 'capital_share' THEN capital_share WHEN 'repeat_share' THEN repeat_share ELSE dup_line_share END > c.cutoff) AS kept FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v
"""


OP1_SQL = judged_sql("documents")
