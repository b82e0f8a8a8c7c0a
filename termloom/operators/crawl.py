"""Crawling over a stored link table: level-synchronous frontier, robots rules, resumable state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.runtime import checkpointed


@dataclass(frozen=True)
class CrawlConfig:
    """-1: no bound. ``allow`` and ``deny`` are patterns of URIs to follow; ``per_round`` URIs are taken at once."""

    max_docs: int = -1
    per_round: int = -1
    max_level: int = -1
    allow: str | None = None
    deny: str | None = None
    agent: str = "termloom"


def parse_robots(text: str, agent: str) -> list[tuple[int, bool, str]]:
    """(rule number, allowed, path) of the first section for the agent or for all, in order."""
    applies, seen_rules, chosen, rules = False, False, False, []
    for line in text.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if seen_rules:
                if chosen:
                    break
                applies, seen_rules = False, False
            applies = applies or value == "*" or (value != "" and agent.lower().startswith(value.lower()))
        elif key in ("allow", "disallow"):
            seen_rules = True
            if applies:
                chosen = True
                rules.append((len(rules), key == "allow", value))
    return rules


def allowed(uris: DataFrame, robots: DataFrame) -> DataFrame:
    """``uris`` (uri, ...) whose first matching rule allows them; rules: host, rule_no, allow, path. Without one: allowed."""
    host, path = F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1), F.regexp_extract("uri", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    rows = uris.withColumn("host", F.lower(host)).withColumn("_path", F.when(path == "", "/").otherwise(path))
    rules = robots.where("path <> ''").select("host", "rule_no", "allow", F.col("path").alias("_rule"))
    hit = rows.join(rules, "host").where(F.col("_path").startswith(F.col("_rule")))
    verdict = hit.groupBy("uri").agg(F.min_by("allow", "rule_no").alias("_allow")).where("not _allow").select("uri")
    return rows.drop("host", "_path").join(verdict, "uri", "left_anti")


def crawl(seeds: DataFrame, links: DataFrame, config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """uri, level, done: everything reached from the seeds (uri) over links (url, link), least click level first.

    A round takes the waiting URIs (at most ``per_round``, lowest level first), marks them done and adds the targets of
    their links; URIs at ``max_level`` are not followed. ``state`` resumes an earlier result. The loop's state is
    checkpointed each round, so neither lineage nor driver grows.
    """
    edges = links.select(F.col("url").alias("uri"), F.col("link").alias("target")).where("uri is not null and target is not null")
    if config.allow:
        edges = edges.where(F.col("target").rlike(config.allow))
    if config.deny:
        edges = edges.where(~F.col("target").rlike(config.deny))
    edges = edges.distinct()
    known = seeds.where("uri is not null").select("uri", F.lit(0).alias("level"), F.lit(False).alias("done")).distinct()
    if robots is not None:
        known = allowed(known, robots)
    if state is not None:
        known = _merged(state.unionByName(known))
    known = checkpointed(known)
    done = known.where("done").count()
    while config.max_docs < 0 or done < config.max_docs:
        waiting = known.where("not done")
        room = min([n for n in (config.per_round, config.max_docs - done if config.max_docs >= 0 else -1) if n >= 0], default=-1)
        taken = waiting if room < 0 else waiting.orderBy("level", "uri").limit(room)
        taken = checkpointed(taken.select("uri", "level"))
        n = taken.count()
        if not n:
            break
        done += n
        source = taken if config.max_level < 0 else taken.where(F.col("level") < config.max_level)
        found = source.join(edges, "uri").groupBy(F.col("target").alias("uri")).agg((F.min("level") + 1).alias("level")).withColumn("done", F.lit(False))
        if robots is not None:
            found = allowed(found, robots)
        marked = taken.withColumn("done", F.lit(True))
        known = checkpointed(_merged(known.unionByName(marked).unionByName(found)))
    return known


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("uri").agg(F.min("level").alias("level"), F.max("done").alias("done"))


def save_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
