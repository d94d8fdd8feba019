"""Relatedness of pages: links, branches, shared entities (T01, J-TH2, G15, S12), bounded names (F24, J-TH1, V07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attestor.session import Workspace

#: Points of a shared branch, an outgoing and an incoming link, and of an entity.
BRANCH, OUTBOUND, INBOUND, ENTITY, LEAST_ENTITY = 20, 100, 80, 60, 5


def document_frequency(entities: DataFrame) -> DataFrame:
    """Pages of each entity (page, entity), counted once a page."""
    return entities.select("page", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df"))


def related_pages(pages: DataFrame, links: DataFrame, entities: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(target, page, score, rank): for each target the ``k`` most related other pages.

    ``pages``: (page, branch), each page once; ``links``: (page, to_page); ``entities``: (page, entity); ``targets``: (target). The same
    branch, a link either way and each shared entity give points, an entity the fewer the more pages have it. Points are summed
    before ranking; ties go to the smaller page.

    Pages of one branch with the same entities are of one kind. But for links they score alike, so kinds meet each other by
    equi-joins, not pages, and the first k + 1 pages of a kind are enough, as are the best k + 1 of all for each kind. Of the pages
    that share nothing but the branch, too, the first k + 1 of each branch are enough. Linked pages, whose points only rise,
    are scored one by one beside them.
    """
    work = Workspace(pages.sparkSession, "related")
    known = pages.select("page", F.lower("branch").alias("branch"), F.lit(True).alias("known"))
    held = entities.where("entity is not null").groupBy("page").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    all_pages = known.join(held, "page", "full").withColumn("kind", F.sha2(F.to_json(F.struct("branch", "entities")), 256))
    all_pages = work.save(all_pages, "pages")
    kinds = work.save(all_pages.groupBy("kind").agg(F.first("branch").alias("branch"), F.first("entities").alias("entities"), F.count("*").alias("n")), "kinds")

    each = kinds.select("kind", "n", F.explode("entities").alias("entity"))
    worth = F.greatest(F.lit(LEAST_ENTITY), F.floor(F.lit(ENTITY) / F.sum("n")).cast("int"))
    mine = each.join(each.groupBy("entity").agg(worth.alias("points")), "entity").select("kind", "entity", "points")
    shared = mine.join(each.select(F.col("kind").alias("other"), "entity"), "entity").groupBy("kind", "other").agg(F.sum("points").alias("points"))
    shared = work.save(shared, "shared")

    first = lambda of: F.row_number().over(W.partitionBy(of).orderBy("page"))
    members = all_pages.where("known")
    leading = members.where("branch is not null").withColumn("n", first("branch")).where(F.col("n") <= k + 1).select("branch", F.col("kind").alias("other")).distinct()
    met = shared.unionByName(kinds.select("kind", "branch").join(leading, "branch").select("kind", "other", F.lit(0).cast("long").alias("points")))
    met = met.groupBy("kind", "other").agg(F.sum("points").alias("points"))
    branch = kinds.select("kind", F.col("branch").alias("own_branch"))
    heads = members.withColumn("n", first("kind")).where(F.col("n") <= k + 1).select(F.col("kind").alias("other"), "page", "branch")
    score = F.coalesce("points", F.lit(0)) + F.when(F.col("own_branch") == F.col("branch"), BRANCH).otherwise(0)
    scored = met.join(branch, "kind").join(heads, "other").select("kind", "page", score.alias("score"))
    best = scored.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "page"))).where(F.col("n") <= k + 1).drop("n")

    asking = targets.join(all_pages.select(F.col("page").alias("target"), "kind", F.col("branch").alias("own_branch")), "target")
    out = links.distinct().select(F.col("page").alias("target"), F.col("to_page").alias("page"), F.lit(OUTBOUND).alias("linked"))
    back = links.distinct().select(F.col("to_page").alias("target"), "page", F.lit(INBOUND).alias("linked"))
    linked = out.unionByName(back).join(targets, "target", "left_semi").groupBy("target", "page").agg(F.sum("linked").alias("linked"))
    linked = linked.join(members.select("page", F.col("kind").alias("other"), "branch"), "page").join(asking.distinct(), "target", "left").join(shared, ["kind", "other"], "left")
    every = asking.join(best, "kind").select("target", "page", "score").unionByName(linked.select("target", "page", (score + F.col("linked")).alias("score")))
    total = every.where("page != target").groupBy("target", "page").agg(F.max("score").cast("long").alias("score"))
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), "page"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k).select("target", "page", "score", "rank")


def select_catalog(catalog: DataFrame, branches: list[str], terms: list[str], urls: DataFrame) -> DataFrame:
    """Nodes that were asked for by URL, or whose breadcrumb has any branch and whose text has any term.

    ``urls``: (url). Without keywords only the URLs select; an empty list of one kind of keyword does not restrict.
    """
    low = lambda c: F.lower(c)
    met = catalog.join(urls.select("url", F.lit(True).alias("__asked")).distinct(), "url", "left")
    asked = F.coalesce("__asked", F.lit(False))
    if branches or terms:
        any_of = lambda words, text: F.lit(True) if not words else _any([text.contains(w.lower()) for w in words])
        crumbs = low(F.array_join("breadcrumb", " > "))
        asked = asked | (any_of(branches, crumbs) & any_of(terms, low(F.concat_ws(" ", crumbs, "title", "url"))))
    return met.where(asked).select(*catalog.columns)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def name_keys(text: Column) -> Column:
    """Names that a free-text locator may mean: its words of path characters, whole and by last part, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_./-]+\.[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.transform(words, lambda w: F.regexp_extract(w, "([^/]*)$", 1))))


def match_sources(locators: DataFrame, manifest: DataFrame, keep: list[str]) -> DataFrame:
    """Each locator with the first source in manifest order that it names, by whole path or last part (F24, J-TH1).

    The pattern join becomes an equi-join on names cut out of the locator.
    """
    names = manifest.select("ord", "path", F.explode(F.array_distinct(F.array(F.lower("path"), F.regexp_extract(F.lower("path"), "([^/]*)$", 1)))).alias("name"))
    said = locators.select(*keep, F.explode(name_keys(F.col("locator"))).alias("name"))
    first = said.join(names, "name").groupBy(*keep).agg(F.min_by("path", "ord").alias("source"))
    return locators.join(first, keep, "left")


def classify_items(items: DataFrame, n_documents: Column) -> DataFrame:
    """supported where a source matched or only one document exists, else unverified."""
    return items.withColumn("status", F.when(F.col("source").isNotNull() | (n_documents == 1), "supported").otherwise("unverified"))
