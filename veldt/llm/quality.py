"""Quality rules whose cutoffs are chosen with a guarantee on false rejections.

Base measures come from whole texts. A policy holds one cutoff for each rule and
rejects a document if one of its scores lies above; the policies form a fixed
sequence from lenient to strict, each rejecting all that the one before it does.
In every stratum they are tested in this order on labelled documents: a policy
is certified if the exact binomial tail P(X <= false rejections | n good
documents, risk) is at most the level, and the sequence stops at the first that
is not, which needs no correction within a stratum. Over the strata the level is
corrected by Holm's procedure on whole sequences: strata whose whole sequence
passes drop out, smallest p-value first, and those left share alpha. So with
probability 1 - alpha no stratum loses more than `risk` of its good documents to
the method. Of the certified policies the one with the largest share of bad minus
share of good documents rejected is used, the most lenient of equals; where
none is positive the method rejects nothing in that stratum.

Cases: null and empty texts have 0 words and fail the base rule; a null
stratum is a stratum of its own; a stratum without enough labels has no
policy; labels that are null, or of unknown documents, are not used; several
labels of a document count as good only if all are 1; an empty table gives an
empty result; repeated rows are judged alike; other columns are not looked at.
Windows of five words are compared by 64-bit hash within one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, row_key, small_enough, table

#: Scores (higher is worse) and the cutoff of each policy, from lenient to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1)),
    "capitals": ("n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.12, 0.1)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0)),
}
POLICIES = 8
#: At most so many strata are broadcast with their cutoffs; more are joined by a shuffle.
BROADCAST_STRATA = 10_000


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_upper (A-Z), n_lines, n_dup_lines and n_repeat_words for its text; the text is dropped."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("__w", F.array_remove(F.split(text, SPACE + "+"), ""))
    d = d.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    d = d.select(
        *[c for c in docs.columns if c != "text"],
        F.size("__w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
        F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("__w") >= 5, F.transform(F.sequence(F.lit(1), F.size("__w") - 4), lambda i: F.xxhash64(F.slice("__w", i, 5)))).alias("__g"),
    )
    # most texts repeat no window; only the others sort theirs
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    last = F.size("__s") - 1
    same = lambda x, i: ((i > 0) & (F.get("__s", i - 1)["g"] == x["g"])) | ((i < last) & (F.get("__s", i + 1)["g"] == x["g"]))
    d = d.withColumn("__r", F.array_sort(F.transform(F.filter("__s", same), lambda x: x["i"])))
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.size("__r") > 0, F.aggregate(F.transform("__r", lambda x, i: F.when(i == 0, 5).otherwise(F.least(F.lit(5), x - F.get("__r", i - 1)))), F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("bigint"))
    return d.drop("__g", "__s", "__r")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score(rule: str) -> Column:
    return F.when(F.col("n_words") > 0, F.expr(f"cast({RULES[rule][0]} as double)"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact, as logs are summed; 1 where k >= n * p, which no test accepts."""
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(F.least(acc["s"], term) - top))).alias("s"))

    first = n.cast("double") * F.log1p(F.lit(-p))
    upto = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k < n * p, F.exp(F.aggregate(upto, F.struct(first.alias("t"), first.alias("s")), step)["s"])).otherwise(F.lit(1.0))


def exceeds(policy: int) -> Column:
    """Whether a document has a score above its cutoff in a policy."""
    return F.greatest(*[(score(r) > c[policy]).cast("int") for r, (_, c) in RULES.items()]) > 0


def certified_policies(measured: DataFrame, labels: DataFrame, risk: float, alpha: float) -> DataFrame:
    """stratum, policy, n_good, false_rejections, p_value, level: a row for each stratum with a policy in use.

    Its size is the number of strata; the labelled rows are counted in one
    aggregation that combines before it shuffles.
    """
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__d")).agg((F.min("quality") == 1).alias("__good"))
    use = measured.where(~base_failed()).join(lab, F.col("doc_id") == F.col("__d"))
    counts = [F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad")]
    counts += [F.count_if((F.col("__good") if x == "g" else ~F.col("__good")) & exceeds(i)).alias(f"{x}_{i}") for i in range(POLICIES) for x in "gb"]
    per = use.groupBy("stratum").agg(*counts)
    tests = F.array(*[F.struct(F.lit(i).alias("policy"), F.col(f"g_{i}").alias("fg"), F.col(f"b_{i}").alias("fb")) for i in range(POLICIES)])
    t = per.select("stratum", "good", "bad", F.inline(tests)).withColumn("p_value", binomial_tail(F.col("fg"), F.col("good"), risk))
    # the largest p-value up to a policy; a stratum's last is that of its whole sequence
    t = t.withColumn("__p", F.max("p_value").over(Window.partitionBy("stratum").orderBy("policy")))
    whole = t.where(F.col("policy") == POLICIES - 1).select(F.col("stratum").alias("__s"), F.col("__p").alias("__whole"))
    order = Window.orderBy("__whole", F.col("__s").isNull(), "__s")  # one row a stratum
    whole = whole.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1)
    whole = whole.withColumn("__pass", F.min(F.col("__whole") <= F.lit(alpha) / F.col("__m")).over(order))
    whole = whole.withColumn("__left", F.greatest(F.count_if(~F.col("__pass")).over(Window.partitionBy()), F.lit(1)))
    whole = whole.withColumn("level", F.lit(alpha) / F.when(F.col("__pass"), F.col("__m")).otherwise(F.col("__left")))
    t = t.join(whole.select("__s", "level"), F.col("stratum").eqNullSafe(F.col("__s")))
    gain = F.col("fb") / F.greatest("bad", F.lit(1)) - F.col("fg") / F.greatest("good", F.lit(1))
    t = t.withColumn("__gain", gain).where((F.col("__p") <= F.col("level")) & (F.col("__gain") > 0))
    best = Window.partitionBy("stratum").orderBy(F.col("__gain").desc(), "policy")
    return t.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("stratum", "policy", F.col("good").alias("n_good"), F.col("fg").alias("false_rejections"), "p_value", "level")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.025, alpha: float = 0.05) -> DataFrame:
    """doc_id, stratum, the measures, base_failed, the rules that reject it, kept; a row for each row of docs."""
    return _judged(docs, labels, stratum, risk, alpha).drop("__k")


def _judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.025, alpha: float = 0.05, key: Column | None = None) -> DataFrame:
    """As judge, with key of each row as __k."""
    m = materialize(measures(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text", *[] if key is None else [key.alias("__k")])), "measures")
    cut = materialize(certified_policies(m, labels, risk, alpha).select(F.col("stratum").alias("__s"), F.col("policy").alias("__c")), "policies")
    joined = m.join(F.broadcast(cut) if small_enough(cut, BROADCAST_STRATA) else cut, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    over = {r: score(r) > F.get(F.array(*map(F.lit, c)), F.col("__c")) for r, (_, c) in RULES.items()}
    hit = F.array_compact(F.array(*[F.when(~base_failed() & x, F.lit(r)) for r, x in over.items()]))
    return joined.select("doc_id", "stratum", *[c for c in m.columns if c.startswith(("n_", "word_", "__k"))], base_failed().alias("base_failed"), hit.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op2_risk_controlled_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The rows of docs that are kept, each by its own verdict, whatever rows share its doc_id."""
    key = row_key(stratum, "text")
    bad = _judged(docs, labels, stratum, key=key, **options).where(~F.col("kept")).select("__k").distinct()
    return docs.withColumn("__k", key).join(bad, "__k", "left_anti").drop("__k")


def _oracle(risk: float = 0.025, alpha: float = 0.05) -> str:
    grid = ", ".join(f"({i}, " + ", ".join(f"{c[i]}::DOUBLE" for _, c in RULES.values()) + ")" for i in range(POLICIES))
    scores = ", ".join(f"({e})::DOUBLE AS s_{r}" for r, (e, _) in RULES.items())
    over = " OR ".join(f"s_{r} > c_{r}" for r in RULES)
    names = ", ".join(f"CASE WHEN s_{r} > c_{r} THEN '{r}' END" for r in RULES)
    return rf"""
WITH w AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text FROM documents),
ln AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
m AS (SELECT ln.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM ln LEFT JOIN cov ON ln.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
grid(policy, {", ".join("c_" + r for r in RULES)}) AS (VALUES {grid}),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sc AS (SELECT doc_id, lang, {scores} FROM b WHERE NOT base_failed),
cnt AS (SELECT lang, policy, count(*) FILTER (good) AS ng, count(*) FILTER (NOT good) AS nb, count(*) FILTER (good AND ({over})) AS fg,
          count(*) FILTER (NOT good AND ({over})) AS fb FROM sc JOIN lab USING (doc_id), grid GROUP BY ALL),
tail AS (SELECT *, CASE WHEN fg < ng * {risk} THEN list_sum(list_transform(range(0, fg + 1), lambda x:
          exp(lgamma(ng + 1) - CASE WHEN x = 0 THEN 0 ELSE lgamma(x + 1) END - lgamma(ng - x + 1) + x * ln({risk}) + (ng - x) * ln(1 - {risk})))) ELSE 1 END AS pv FROM cnt),
up AS (SELECT *, max(pv) OVER (PARTITION BY lang ORDER BY policy) AS p FROM tail),
seq AS (SELECT lang, p AS whole, count(*) OVER () - row_number() OVER (ORDER BY p, lang IS NULL, lang) + 1 AS m FROM up WHERE policy = {POLICIES - 1}),
holm AS (SELECT lang, m, bool_and(whole <= {alpha} / m) OVER (ORDER BY whole, lang IS NULL, lang) AS pass FROM seq),
lev AS (SELECT lang, {alpha} / CASE WHEN pass THEN m ELSE greatest(count(*) FILTER (NOT pass) OVER (), 1) END AS level FROM holm),
ok AS (SELECT up.*, fb / greatest(nb, 1) - fg / greatest(ng, 1) AS gain FROM up JOIN lev ON up.lang IS NOT DISTINCT FROM lev.lang WHERE p <= level),
best AS (SELECT * FROM ok WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY gain DESC, policy) = 1),
rej AS (SELECT sc.doc_id, concat_ws(',', {names}) AS rejected_by FROM sc JOIN best ON sc.lang IS NOT DISTINCT FROM best.lang JOIN grid ON best.policy = grid.policy WHERE {over})
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, base_failed,
  NOT base_failed AND rej.doc_id IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN rej ON b.doc_id = rej.doc_id
"""


ORACLE = _oracle()
