"""URL rules, and a character language-model ratio for the URLs that no rule decides.

URLs that a rule accepts or rejects train two variable-order Markov models over characters, with
Witten-Bell smoothing: the probability of a character mixes all orders down to a uniform one, each
weighted by how much was seen after its context. A URL's score is the difference of the two
log-likelihoods per character. The threshold is calibrated on hosts held out from training.

Only DataFrame functions are used. Counts are grouped map-side; the model is a table that grows
with the corpus and is joined, never broadcast by hand. Distinct URLs and distinct character
sequences are scored once.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch

#: Characters of context of the highest order.
ORDER = 4
#: One host in so many is held out for the calibration.
HELD_OUT = 5
#: Characters that the lowest order deems equally likely.
ALPHABET = 256
#: More rules than this are refused, as they become one expression.
MAX_RULES = 500
#: (rule, verdict) of the query; a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))

_START, _END = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _grams(text: Column, order: int) -> Column:
    """Every character with the ``order`` characters before it, and the end mark."""
    padded = F.concat(F.lit(_START * order), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1),
                       lambda i: F.substr(padded, i, F.lit(order + 1)))


def _suffixes(gram: Column, order: int) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.substr(gram, F.lit(-k), F.lit(k)).alias("s"))
                     for k in range(1, order + 2)])


def _train(labelled: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all character sequences of up to ``order`` + 1, and of their contexts, by class."""
    full = (labelled.select("accepted", F.explode(_grams(F.col("text"), order)).alias("gram"))
            .groupBy("gram").agg(F.count_if("accepted").alias("n1"),
                                 F.count_if(~F.col("accepted")).alias("n0")))
    counts = (full.select("n1", "n0", F.explode(_suffixes(F.col("gram"), order)).alias("x"))
              .groupBy(F.col("x.s").alias("s")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    contexts = counts.groupBy(F.expr("substr(s, 1, length(s) - 1)").alias("context"),
                              F.length("s").alias("k")).agg(
        F.sum("n1").alias("all1"), F.count_if(F.col("n1") > 0).alias("kinds1"),
        F.sum("n0").alias("all0"), F.count_if(F.col("n0") > 0).alias("kinds0"))
    return counts, contexts


def _smoothed(levels: Column, which: int) -> Column:
    """Probability of the last character, from the lowest order up."""
    def step(p: Column, x: Column) -> Column:
        seen, kinds, total = x[f"n{which}"], x[f"kinds{which}"], x[f"all{which}"]
        return F.when(total > 0, (seen + kinds * p) / (total + kinds)).otherwise(p)
    return F.aggregate(levels, F.lit(1.0 / ALPHABET), step)


def _gram_scores(grams: DataFrame, counts: DataFrame, contexts: DataFrame,
                 order: int) -> DataFrame:
    """Log-likelihood difference of every distinct character sequence."""
    zero = F.lit(0).cast("long")
    parts = grams.select("gram", F.explode(_suffixes(F.col("gram"), order)).alias("x")).select(
        "gram", F.col("x.k").alias("k"), F.col("x.s").alias("s"),
        F.expr("substr(x.s, 1, length(x.s) - 1)").alias("context"))
    with_counts = parts.join(counts, "s", "left").join(contexts, ["context", "k"], "left")
    level = F.struct("k", *[F.coalesce(c, zero).alias(c) for c in
                            ("n1", "n0", "all1", "kinds1", "all0", "kinds0")])
    # A group has ORDER + 1 rows.
    levels = F.array_sort(F.collect_list(level))
    return with_counts.groupBy("gram").agg(levels.alias("levels")).select(
        "gram", (F.log(_smoothed(F.col("levels"), 1)) - F.log(_smoothed(F.col("levels"), 0)))
        .alias("difference"))


def _threshold(scored: DataFrame) -> float:
    """Where two normal curves over the held-out scores of either class are equally far, in
    standard deviations; 0 if a class has no held-out URL."""
    rows = {r["accepted"]: r for r in scored.groupBy("accepted").agg(
        F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd")
    ).collect()}
    if len(rows) < 2:
        return 0.0
    yes, no = rows[True], rows[False]
    spread = yes["sd"] + no["sd"]
    if not spread:
        return (yes["mean"] + no["mean"]) / 2
    return (yes["mean"] * no["sd"] + no["mean"] * yes["sd"]) / spread


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER,
               whole_url: bool = False) -> DataFrame:
    """Per page: the id, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``threshold``.

    The verdict is the rule's (a rule fits its host and all subdomains, and paths that begin with
    its own; the longest wins), else ``allow`` if the score reaches the threshold. A URL that is
    null or has no ``://`` has an empty host and path and is judged as the empty text. Without
    any URL that a rule decides both models are uniform, every score is 0 and passes. Repeated
    rows come back repeated; other columns are not read.

    The models read host and path; with ``whole_url`` the URL as it stands, with scheme, query and
    fragment (null as the empty text). Rules and output columns are the same either way.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col(url_col))
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    # Written once: the parsed URLs are read by every later step.
    parsed = scratch.write(
        pages.select(F.col(id_col), host.alias("host"), path.alias("path"),
                     (F.coalesce(F.col(url_col), F.lit("")) if whole_url
                      else F.concat(host, path)).alias("text"))
        .withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
        .withColumn("by_rule", verdicts), "parsed")
    held_out = F.pmod(F.xxhash64("host"), F.lit(HELD_OUT)) == 0
    texts = scratch.write(
        parsed.groupBy("host", "text", "by_rule").agg(F.count("*").alias("copies"))
        .withColumn("accepted", F.when(F.col("by_rule").isNotNull(), F.col("by_rule") == "allow"))
        .withColumn("held_out", held_out).withColumn("text_id", F.monotonically_increasing_id()),
        "texts")
    counts, contexts = _train(texts.filter("accepted is not null and not held_out"), order)
    counts, contexts = scratch.write(counts, "counts"), scratch.write(contexts, "contexts")
    to_score = texts.filter("accepted is null or held_out")
    spelled = scratch.write(
        to_score.select("text_id", F.explode(_grams(F.col("text"), order)).alias("gram"))
        .groupBy("text_id", "gram").agg(F.count("*").alias("times")), "spelled")
    differences = _gram_scores(spelled.select("gram").distinct(), counts, contexts, order)
    # A sequence that a third of all URLs hold is a hot key of this join, which AQE may split.
    scores = (spelled.join(differences, "gram").groupBy("text_id")
              .agg((F.sum(F.col("difference") * F.col("times")) / F.sum("times")).alias("score")))
    scored = scratch.write(to_score.join(scores, "text_id").select(
        "text", "by_rule", "accepted", "held_out", F.round("score", 9).alias("score")), "scored")
    threshold = round(_threshold(scored.filter("accepted is not null")), 9)
    free = scored.filter("accepted is null").select(F.col("text").alias("s_text"), "score")
    judged = parsed.join(free, (F.col("text") == F.col("s_text")) & F.col("by_rule").isNull(), "left")
    return scratch.finish(judged.select(
        id_col, "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
        .alias("verdict"), "score", F.lit(threshold).alias("threshold")))
