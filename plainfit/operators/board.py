"""Leaderboards: pooled ranks, canonical names, wide category scores, frontiers and judges' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import row_mean
from ..sources.scratch import materialise
from .aggregate import avg_rank, category_scores, dedup, mean_if_complete, mean_se, non_dominated, pareto, rank_models


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of two short lists, such as models and datasets."""
    return a.crossJoin(b)


def tag_category(facts: DataFrame, tests: DataFrame) -> DataFrame:
    """Facts with their test's category; tests without one are dropped."""
    return facts.join(tests, "test", "inner")


def canonical_model_id(perf: DataFrame, overall: DataFrame, baselines: list[str] | None = None) -> DataFrame:
    """Baselines (named, or those whose commit is ``baseline``) are one model over all experiments, others are named by experiment, commit (or ``unknown``) and name."""
    named = overall.select("experiment", F.col("model_name").alias("model"), "commit")
    known = named.filter("commit <> 'baseline'").dropDuplicates(["experiment", "model"])
    fixed = named.filter("commit = 'baseline'").select("model").distinct().withColumn("__base", F.lit(True))
    is_base = F.coalesce("__base", F.lit(False)) | F.col("model").isin(baselines or [])
    name = F.when(is_base, F.col("model")).otherwise(F.concat_ws("/", "experiment", F.coalesce("commit", F.lit("unknown")), "model"))
    return perf.join(known, ["experiment", "model"], "left").join(fixed, "model", "left").withColumn("model_id", name).drop("__base").select(*perf.columns, "commit", "model_id")


def mean_rank(perf: DataFrame) -> DataFrame:
    """(model, mean_rank, mean_rmse), null for a model without an rmse on some dataset."""
    ranked = rank_models(perf)
    return mean_if_complete(ranked).join(mean_if_complete(ranked, "rmse", "mean_rmse"), "model")


def pooled_rank(perf: DataFrame) -> DataFrame:
    """(model_id, mean_rank): repeated (dataset, model) pairs averaged, average-tie ranks, models with an rmse on every dataset only.

    A dataset on which no model has one counts too, so that then no model is complete.
    """
    one = perf.groupBy("dataset", "model_id").agg(F.avg("rmse").alias("rmse"))
    ranked = avg_rank(one, ["dataset"], "rmse")
    return mean_if_complete(ranked.withColumnRenamed("model_id", "model")).filter("mean_rank is not null").withColumnRenamed("model", "model_id")


def refresh_ranks(overall: DataFrame, perf: DataFrame) -> DataFrame:
    """``overall`` with every row's mean_rank by the pool as it is now."""
    now = mean_if_complete(rank_models(perf)).withColumnRenamed("model", "model_name")
    return overall.drop("mean_rank").join(now, "model_name", "left").select(*overall.columns)


def attach_artifact(base: DataFrame, files: DataFrame, pattern: str = r"(\w+)_[^/]*$") -> DataFrame:
    """``base`` (commit, ...) with the file of ``files`` (path, place) whose name begins with the commit: the first place in order, then the first path."""
    named = files.withColumn("commit", F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))).groupBy("commit").agg(F.min(F.struct("place", "path"))["path"].alias("artifact"))
    return base.join(named, "commit", "left")


def leaderboard(perf: DataFrame, facts: DataFrame, tests: DataFrame, categories: list[str]) -> DataFrame:
    """Rank, pass rate and one column per category, the best rank first."""
    rates = facts.groupBy("model_id").agg(F.avg(F.col("passed").cast("double")).alias("score"))
    wide = category_scores(tag_category(facts, tests), categories, ["model_id"])
    board = pooled_rank(perf).join(rates, "model_id", "left").join(wide, "model_id", "left")
    return dedup(board, ["model_id"], ["mean_rank"]).orderBy("mean_rank", "model_id")


def combined_leaderboard(perf: DataFrame, overall: DataFrame, dev: DataFrame, test: DataFrame, categories: list[str], tests: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row for each model of ``overall`` (experiment, commit, model_name, description, mean_rank), the best pooled rank first.

    ``dev`` and ``test`` are facts (experiment, model, category or test, passed): each gives a score and a column for
    each category.  Ranks pool all experiments; models without one, and all but the first row of a baseline, are left
    out.  ``files`` (path, place) gives the artifact.
    """
    ranks = pooled_rank(canonical_model_id(perf, overall)).withColumnRenamed("mean_rank", "mean_rank_global")
    ids = canonical_model_id(overall.select("experiment", F.col("model_name").alias("model")).distinct(), overall).select("experiment", F.col("model").alias("model_name"), "model_id")
    board = overall.withColumnRenamed("mean_rank", "mean_rank_local").join(ids, ["experiment", "model_name"]).join(ranks, "model_id")
    for kind, facts in (("dev", dev), ("test", test)):
        keys = ["experiment", "model"]
        rate = facts.groupBy(*keys).agg(F.avg(F.col("passed").cast("double")).alias(f"{kind}_score"))
        wide = category_scores(facts if "category" in facts.columns else tag_category(facts, tests), categories, keys)
        named = rate.join(wide.withColumnsRenamed({c: f"{kind}_{c}" for c in categories}), keys, "left").withColumnRenamed("model", "model_name")
        board = board.join(named, ["experiment", "model_name"], "left")
    board = attach_artifact(board, files) if files is not None else board
    # A baseline is one model, whatever experiments it was run in.
    board = dedup(board, ["model_id"], [F.when(F.col("commit") == "baseline", F.col("experiment")), "experiment"])
    front = ["experiment", "commit", "model_name", "description", "mean_rank_global", "mean_rank_local", "dev_score", "test_score", *(f"{k}_{c}" for k in ("dev", "test") for c in categories), *(["artifact"] if files is not None else []), "model_id"]
    return board.select(*front).orderBy("mean_rank_global", "model_id")


def frontier(board: DataFrame, lo: str = "mean_rank", hi: str = "score") -> DataFrame:
    """The rows on the Pareto front; rows with a null in either column are none.

    The board is stored first, so that both sides of the join hold the same numbers to the last bit.
    """
    board = materialise(board, "board")
    return board.join(pareto(board, lo, hi), [lo, hi], "left_semi")


def relaxed(cands: DataFrame, baselines: DataFrame, lo: str = "mean_rank", hi: str = "score") -> DataFrame:
    return non_dominated(cands, baselines, lo, hi)


def frontier_report(board: DataFrame, lo: str = "mean_rank_global", hi: str = "test_score") -> DataFrame:
    """``board`` with four flags: on the front of the baselines, of the evolved models, of all, and beaten by no baseline.

    Only rows with a score above 0 take part, and of evolved models only those with an artifact where there is that column.
    """
    board = materialise(board, "board")
    fair = F.col(hi) > 0
    base = board.filter(fair & (F.col("commit") == "baseline"))
    evolved = board.filter(fair & (F.col("commit") != "baseline") & (F.col("artifact").isNotNull() if "artifact" in board.columns else F.lit(True)))
    sets = {"on_baseline_front": frontier(base, lo, hi), "on_evolved_front": frontier(evolved, lo, hi), "on_combined_front": frontier(base.unionByName(evolved), lo, hi), "beaten_by_no_baseline": relaxed(evolved, base, lo, hi)}
    for name, rows in sets.items():
        board = board.join(rows.select("model_id", F.lit(True).alias(name)).distinct(), "model_id", "left")
    return board.withColumns({n: F.coalesce(n, F.lit(False)) for n in sets}).orderBy(lo, "model_id")


DIMENSIONS = ["correctness", "completeness", "clarity"]


def judge_report(scores: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """(mode, dataset, dimension, mean, se, n): by dataset over all runs and judges, and as dataset ``AVERAGE`` over the means of each run and judge, with dimension ``overall``."""
    dims = dimensions or DIMENSIONS
    parts = []
    for d in [*dims, "overall"]:
        values = dims if d == "overall" else [d]
        if d != "overall":
            parts.append(mean_se(scores, ["mode", "dataset"], d).select("mode", "dataset", F.lit(d).alias("dimension"), "mean", "se", "n"))
        means = scores.groupBy("mode", "run_id", "judge_id").agg(*(F.avg(v).alias(v) for v in dims)).withColumn("__v", row_mean(*(F.col(v) for v in values)))
        parts.append(mean_se(means, ["mode"], "__v").select("mode", F.lit("AVERAGE").alias("dataset"), F.lit(d).alias("dimension"), "mean", "se", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_modes(scores: DataFrame, modes: list[str], dimensions: list[str] | None = None) -> DataFrame:
    """(dimension, a column of ``mean±se`` for each mode)."""
    means = judge_report(scores, dimensions).filter("dataset = 'AVERAGE'").withColumn("cell", F.format_string("%.2f±%.2f", "mean", "se"))
    return means.groupBy("dimension").pivot("mode", modes).agg(F.first("cell"))


#: Words that name a family of models in a specification (fixed values).
FAMILIES = ["OLS", "GLM", "Poisson", "NegativeBinomial", "logit", "probit", "lmer", "lm(", "glm("]


def annotation_summary(df: DataFrame, by: list[str] | None = None, most: int = 8) -> DataFrame:
    """Counts of experts' specifications, the first ``most`` concepts in order of ``ord``, and the model families that are named.

    Text that isn't a JSON object counts for nothing.
    """
    by = by or []
    concept = F.from_json("conceptual_spec_json", "concept string, variable_type string")
    said = F.concat(F.coalesce(concept["variable_type"], F.lit("")), F.lit(": "), concept["concept"])
    rows = df.select(*by, "ord", F.when(concept["concept"] != "", said).alias("said"), F.try_parse_json("model_spec_json").cast("string").alias("model"), F.col("annotate_transform_spec_json").isNotNull().alias("transform"))
    named = F.array_compact(F.array(*(F.when(F.max(F.lower("model").contains(f.lower())), F.lit(f)) for f in FAMILIES)))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("specifications"), F.count("model").alias("models"), F.array_join(F.array_sort(named), ", ").alias("families"), F.count_if("transform").alias("transforms"))
    spoken = rows.filter("said is not null")
    if by:
        first = spoken.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).filter(F.col("__n") <= most)
    else:
        first = spoken.orderBy("ord").limit(most)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "said")))["said"].alias("concepts"))  # ``most`` at most
    return counts.join(first, by, "left") if by else counts.join(first)


def grade(responses: DataFrame) -> DataFrame:
    """(response, truth): the first number in the text, and whether it is within max(a quarter of the truth, 1.5)."""
    got = F.expr(r"try_cast(nullif(regexp_extract(response, '[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?', 0), '') AS double)")
    ok = F.abs(F.col("got") - F.col("truth")) <= F.greatest(F.abs("truth") * 0.25, F.lit(1.5))
    return responses.withColumn("got", got).withColumn("passed", F.coalesce(ok, F.lit(False)))


def parse_conclusions(df: DataFrame, text: str = "text") -> DataFrame:
    """{response, explanation} from a JSON object in prose; what doesn't parse is marked."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.from_json(inner, "response int, explanation string")
    return df.withColumn("__p", parsed).select("*", F.col("__p.response").alias("response"), F.col("__p.explanation").alias("explanation"), F.col("__p.response").isNull().alias("parse_error")).drop("__p")
