"""URL filtering by host and path rules, and by a tree of path templates for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, spread, store

SALTS = 64
NUMBER, ANY = "{n}", "*"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. Empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, r"://([^/?#]*)", 1)), F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` = [(verdict, "host/path prefix")] that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's. The list is written
    by hand and becomes one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def path_shape(path: Column) -> Column:
    """All segments of a path, with digit runs as ``{n}``."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.regexp_replace(s, "[0-9]+", NUMBER))


def _before(template: Column, place: Column) -> Column:
    """What stands before a place of a template; a hash, as paths may be long."""
    return F.xxhash64(F.slice(template, 1, place))


def _variable_segments(shapes: DataFrame, few: int, share: float) -> DataFrame:
    """``shapes`` with ``template``: segments that vary at their place in the host become ``*``.

    A segment stays if its place has at most ``few`` different ones, or if it holds at least ``share`` of the rows there.
    """
    places = shapes.select("host", "shape", "n", F.posexplode("shape").alias("place", "segment"))
    counted = places.groupBy("host", "place", "segment").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)))
    totals = spread(
        counted, ["host", "place"], "salt", [F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_kinds")],
        [F.sum("_n").alias("all_n"), F.sum("_kinds").alias("kinds")],
    )
    stays = (
        counted.join(totals, ["host", "place", "salt"])
        .where((F.col("kinds") <= few) | (F.col("n") >= share * F.col("all_n"))).select("host", "place", "segment")
    )
    # what stays is at most max(few, 1 / share) segments a place, so it fits one row per host
    known = stays.groupBy("host").agg(F.collect_set(F.concat_ws(" ", "place", "segment")).alias("known"))
    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)))
    # a host none of whose segments stays is not in ``known``: all its segments vary
    by_salt = salted.select("host", "salt").distinct().join(known, "host", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return salted.join(by_salt, ["host", "salt"]).withColumn(
        "template",
        F.transform("shape", lambda s, i: F.when(F.array_contains("known", F.concat_ws(" ", i.cast("string"), s)), s).otherwise(ANY)),
    ).drop("known", "salt")


def _similar_branches(templates: DataFrame, distance: float, z: float) -> DataFrame:
    """(host, place, before, branch) of branches that look like their siblings taken together.

    Siblings share host and the segments before; a branch is compared by the distribution of what
    follows it (total variation at most ``distance``) and by its share of bad pages (two-proportion
    statistic at most ``z``, on labelled pages).
    """
    nodes = templates.select(
        "host", "n", "good", "bad", F.posexplode("template").alias("place", "branch"),
        F.col("template"),
    ).select(
        "host", "place", "branch", "n", "good", "bad",
        _before(F.col("template"), F.col("place")).alias("before"),
        F.xxhash64(F.slice(F.col("template"), F.col("place") + 2, F.size("template"))).alias("after"),
    ).where(F.col("branch") != ANY)
    parent = ["host", "place", "before"]
    by_after = nodes.groupBy(*parent, "branch", "after").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    own = by_after.groupBy(*parent, "branch").agg(F.sum("n").alias("own_n"), F.sum("good").alias("own_good"), F.sum("bad").alias("own_bad"))
    pooled = own.groupBy(*parent).agg(
        F.sum("own_n").alias("all_n"), F.sum("own_good").alias("all_good"), F.sum("own_bad").alias("all_bad"), F.count(F.lit(1)).alias("kinds")
    ).where("kinds > 1")
    pooled_after = by_after.groupBy(*parent, "after").agg(F.sum("n").alias("after_n"))
    overlap = (
        by_after.join(own, [*parent, "branch"]).join(pooled, parent).join(pooled_after, [*parent, "after"])
        .groupBy(*parent, "branch").agg(
            F.sum(F.least(F.col("n") / F.col("own_n"), F.col("after_n") / F.col("all_n"))).alias("common"),
            *(F.first(c).alias(c) for c in ("own_good", "own_bad", "all_good", "all_bad")),
        )
    )
    labelled, all_labelled = F.col("own_good") + F.col("own_bad"), F.col("all_good") + F.col("all_bad")
    rate = F.col("all_bad") / all_labelled
    spread_of = F.sqrt(rate * (1 - rate) / labelled)
    alike = F.when((labelled == 0) | (all_labelled == 0), True).otherwise(F.abs(F.col("own_bad") / labelled - rate) <= z * spread_of + 1e-9)
    return overlap.where((1 - F.col("common") <= distance) & alike).select(*parent, "branch")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", id_col: str = "page_id",
    few: int = 16, share: float = 0.02, distance: float = 0.25, z: float = 1.96, strength: float = 10.0, reject: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages``.

    The longest fitting rule decides. Its verdicts also label the pages from which the others are
    judged: per host, paths form a tree of templates; varying segments become wildcards, branches
    that look alike merge, and a template is rejected when its bad share, smoothed by ``strength``
    pages of the overall share, reaches ``reject``. ``template`` and ``purity`` (the smoothed good share) are null
    for pages that a rule decides. Templates without labelled pages have the overall share.

    Null or odd URLs have empty host and path and are judged like others; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored. A hot host is spread
    by hashes of its paths, and counts meet only after they are added up per template.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "said": verdict, "shape": path_shape(F.col("path"))})
    shapes = store(judged.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")
    ))
    prior = shapes.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    base = (prior["bad"] or 0) / max(1, (prior["good"] or 0) + (prior["bad"] or 0))
    variable = store(_variable_segments(shapes, few, share))
    templates = variable.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    merged = _similar_branches(templates, distance, z).groupBy("host").agg(F.collect_set(F.concat_ws(" ", F.col("place").cast("string"), F.col("before").cast("string"), "branch")).alias("merged"))
    final = F.transform("template", lambda s, i: F.when(
        F.array_contains("merged", F.concat_ws(" ", i.cast("string"), _before(F.col("template"), i).cast("string"), s)), ANY
    ).otherwise(s))
    named = templates.join(merged, "host", "left").withColumn("final", F.array_join(F.when(F.col("merged").isNull(), F.col("template")).otherwise(final), "/"))
    scores = named.groupBy("host", "final").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    bad_share = (F.col("bad") + strength * base) / (F.col("good") + F.col("bad") + strength)
    by_template = named.select("host", "template", "final").join(scores.select("host", "final", (1 - bad_share).alias("purity")), ["host", "final"])
    by_shape = variable.select("host", "shape", "template").join(by_template, ["host", "template"]).select("host", "shape", F.col("final").alias("template"), "purity")
    open_pages = judged.where("said is null").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    answers = open_pages.select("host", "shape", "salt").distinct().join(by_shape, ["host", "shape"])
    by_method = open_pages.join(answers, ["host", "shape", "salt"], "left").withColumn("purity", F.coalesce("purity", F.lit(1.0 - base))).select(
        "page_id", "host", "path", "rule", F.when(F.col("purity") <= 1 - reject, "block").otherwise("allow").alias("verdict"), "template", "purity"
    )
    by_rule = judged.where("said is not null").select(
        "page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")
    )
    return by_rule.unionByName(by_method)
