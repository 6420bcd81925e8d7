"""Scores of answers against gold labels. Every ratio is one division of counts; an empty denominator gives 0.0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import jaccard, ratio


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """An unanswered item (null prediction) is wrong."""
    right = count_of(F.col(gold).eqNullSafe(F.col(predicted)))
    return df.filter(F.col(gold).isNotNull()).agg(F.count("*").alias("n_items"), right.alias("n_correct"), ratio(right, F.count("*")).alias("accuracy"))


def mismatches(df: DataFrame, item: str, gold: str, predicted: str) -> DataFrame:
    """(item, gold, predicted) of the items that accuracy counts as wrong, unanswered ones included."""
    wrong = F.col(gold).isNotNull() & ~F.col(gold).eqNullSafe(F.col(predicted))
    return df.filter(wrong).select(item, F.col(gold).alias("gold"), F.col(predicted).alias("predicted"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: list[str], missing: str = "no_prediction") -> DataFrame:
    """A row for each gold label with a column for each label and one for missing predictions; all labels are there."""
    seen = df.withColumn("_p", F.coalesce(F.col(predicted), F.lit(missing)))
    counts = seen.groupBy(F.col(gold).alias("gold")).agg(*[count_of(F.col("_p") == x).alias(f"n_{x}") for x in [*labels, missing]])
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "gold string")
    return names.join(counts, "gold", "left").na.fill(0)


def scores_by_class(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each label; one pass over the items, as each counts for two labels at most."""
    sides = F.array(F.struct(F.col(gold).alias("label"), F.lit("g").alias("side")), F.struct(F.col(predicted).alias("label"), F.lit("p").alias("side")))
    hit = F.col(gold).eqNullSafe(F.col(predicted))
    rows = df.select(F.explode(sides).alias("x"), hit.alias("hit")).select("x.*", "hit")
    by = rows.groupBy("label").agg(count_of((F.col("side") == "g") & F.col("hit")).alias("tp"), count_of((F.col("side") == "p") & ~F.col("hit")).alias("fp"), count_of((F.col("side") == "g") & ~F.col("hit")).alias("fn"))
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    out = names.join(by, "label", "left").na.fill(0)
    return out.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def selective(df: DataFrame, gold: str, predicted: str, abstained: Column) -> DataFrame:
    answered = count_of(~abstained)
    right = count_of(~abstained & F.col(gold).eqNullSafe(F.col(predicted)))
    return df.agg(F.count("*").alias("n_items"), (F.count("*") - answered).alias("n_abstained"), right.alias("n_correct"), ratio(right, answered).alias("selective_accuracy"), ratio(F.count("*") - answered, F.count("*")).alias("abstention_rate"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Raw agreement and Cohen's kappa of two annotators: (n p_o - sum of products of marginals) over the same with n**2; 1.0 if chance
    agreement is certain. The marginals are joined by label. No common item is an error."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_agreed"))
    n, agreed, c = F.col("n_items"), F.col("n_agreed"), F.col("chance")
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("no item that both have labelled")).cast("long"))
    kappa = F.when(n * n == c, F.lit(1.0)).otherwise(ratio(n * agreed - c, n * n - c))
    return seen.join(F.broadcast(chance)).select(n.alias("n_items"), "n_agreed", ratio(agreed, n).alias("raw_agreement"), kappa.alias("kappa"))  # one row each


def completeness(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Macro (mean over items with gold) and micro completeness of cited arrays; repeats in gold count each time."""
    found = F.size(F.filter(F.col(gold), lambda x: F.array_contains(F.coalesce(F.col(predicted), F.array().cast("array<string>")), x)))
    items = df.filter(F.size(gold) > 0).select(found.alias("found"), F.size(gold).alias("wanted"))
    share = F.floor(ratio(F.col("found"), F.col("wanted")) * 1_000_000).cast("long")  # whole millionths, so that the mean doesn't hang on the order
    return items.agg(F.count("*").alias("n_items"), F.sum("found").alias("n_found"), F.sum("wanted").alias("n_wanted"), ratio(F.sum("found"), F.sum("wanted")).alias("micro"), ratio(F.sum(share), F.count("*") * 1_000_000).alias("macro"))


def article_of(cited: Column) -> Column:
    """An identifier cut to its article or annex; null for any other."""
    return F.nullif(F.regexp_extract(cited, r"^([^:]+:(?:article|annex)-[a-z0-9]+)", 1), F.lit(""))


def article_completeness(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Completeness of cited arrays when both sides are cut to articles, each named once."""
    cut = lambda c: F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), article_of)))
    return completeness(df.select(cut(gold).alias("_gold"), cut(predicted).alias("_predicted")), "_gold", "_predicted")


def hallucination(citations: DataFrame, item: str, cited: str, known: DataFrame, key: str) -> DataFrame:
    """Of the distinct cited ids of each item, those that aren't known."""
    distinct = citations.filter(F.col(cited).isNotNull()).select(item, cited).distinct()
    marked = distinct.join(known.select(F.col(key).alias(cited), F.lit(1).alias("_known")).distinct(), cited, "left")
    lost = count_of(F.col("_known").isNull())
    return marked.agg(F.count("*").alias("n_cited"), lost.alias("n_unknown"), ratio(lost, F.count("*")).alias("rate"))


def judge_errors(df: DataFrame, verdict: str, gold: str) -> DataFrame:
    """False accepts among gold rejects, false rejects among gold accepts, abstentions; df is the join of verdicts and gold."""
    v, g = F.col(verdict), F.col(gold)
    settled = v.isin("accepted", "rejected")
    false_accept, rejects = count_of(settled & (v == "accepted") & (g == "reject")), count_of(settled & (g == "reject"))
    false_reject, accepts = count_of(settled & (v == "rejected") & (g == "accept")), count_of(settled & (g == "accept"))
    return df.agg(count_of(settled).alias("n_scored"), count_of(~settled).alias("n_abstained"), false_accept.alias("n_false_accept"), false_reject.alias("n_false_reject"), ratio(false_accept, rejects).alias("false_accept_rate"), ratio(false_reject, accepts).alias("false_reject_rate"))


def judge_error_items(df: DataFrame, item: str, verdict: str, gold: str) -> DataFrame:
    """(error, item) of what judge_errors counts: false_accept, false_reject, abstained."""
    v, g = F.col(verdict), F.col(gold)
    error = F.when(~F.coalesce(v.isin("accepted", "rejected"), F.lit(False)), "abstained").when((v == "accepted") & (g == "reject"), "false_accept").when((v == "rejected") & (g == "accept"), "false_reject")
    return df.select(error.alias("error"), item).filter("error is not null")


def variance(pairs: DataFrame) -> DataFrame:
    """pairs (label_a, label_b, cited_a, cited_b): flips, and the mean Jaccard of citations where either run cites (null if none)."""
    cites = (F.size("cited_a") > 0) | (F.size("cited_b") > 0)
    share = F.when(cites, F.floor(jaccard(F.col("cited_a"), F.col("cited_b")) * 1_000_000).cast("long"))
    return pairs.agg(F.count("*").alias("n_items"), count_of(~F.col("label_a").eqNullSafe(F.col("label_b"))).alias("n_flips"), count_of(cites).alias("n_citing"), F.try_divide(F.sum(share).cast("double"), (count_of(cites) * 1_000_000).cast("double")).alias("mean_jaccard"))
