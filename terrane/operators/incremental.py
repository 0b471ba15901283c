"""Change detection and survey state (JN8, FLT14, FLT17, FLT18, API10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSEABLE = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "tf", "yaml", "yml", "json")


def extension(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def is_parseable(path: Column | str) -> Column:
    """Template and package files count too, unlike where only code does (G5)."""
    return extension(path).isin(*PARSEABLE)


def snapshot_changes(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change) between two manifests: added, deleted or modified."""
    a = old.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__in_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def name_status_changes(lines: DataFrame) -> DataFrame:
    """(path, change) from lines of a name-status diff (SRC10): a rename deletes
    one path and adds another, a copy adds, other letters modify. Tabs part the
    fields, as paths may hold blanks; a line without any is parted at blanks."""
    line = F.trim(F.col("value"))
    f = F.when(F.contains(line, F.lit("\t")), F.split(line, r"\t+")).otherwise(F.split(line, r"\s+"))
    code, first, second = F.upper(F.substring(f[0], 1, 1)), F.try_element_at(f, F.lit(2)), F.try_element_at(f, F.lit(3))
    row = lambda p, c: F.struct(p.alias("path"), F.lit(c).alias("change"))
    items = F.when(code == "R", F.array(row(first, "deleted"), row(second, "added"))).when(code == "C", F.array(row(second, "added"))).when(code == "A", F.array(row(first, "added"))).when(code == "D", F.array(row(first, "deleted"))).otherwise(F.array(row(first, "modified")))
    return lines.where(F.size(f) >= 2).select(F.explode(items).alias("i")).select("i.path", "i.change").where(is_parseable("path"))


def summary(changes: DataFrame) -> DataFrame:
    """(added, modified, deleted, to_parse) counts."""
    n = lambda *k: F.count_if(F.col("change").isin(*k))
    return changes.agg(n("added").alias("added"), n("modified").alias("modified"), n("deleted").alias("deleted"), n("added", "modified").alias("to_parse"))


def files_to_parse(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change").isin("added", "modified")).drop("change")


def needs_survey(repos: DataFrame, state: DataFrame) -> DataFrame:
    """(repo, why): never seen, failed last time, or at another commit (FLT17, G6)."""
    s = state.select("repo", F.col("commit_sha").alias("__was"), "survey_successful")
    joined = repos.select("repo", "commit_sha").join(s, "repo", "left")
    why = F.when(F.col("survey_successful").isNull() & F.col("__was").isNull(), "never surveyed").when(~F.coalesce("survey_successful", F.lit(False)), "failed").when(~F.col("commit_sha").eqNullSafe(F.col("__was")), "changed")
    return joined.select("repo", why.alias("why")).where("why is not null")


def mark_surveyed(state: DataFrame, done: DataFrame) -> DataFrame:
    """State with the rows of ``done`` in place of those of the same repo."""
    return state.join(done.select("repo"), "repo", "left_anti").unionByName(done)


def state_totals(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("repos"), F.coalesce(F.sum("discovery_count"), F.lit(0)).alias("discoveries"))


def outcomes(results: DataFrame) -> DataFrame:
    """Repos by outcome: success, skipped, failed (AGG18)."""
    return results.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "skipped", "failed")])


def prune_deleted(discoveries: DataFrame, changes: DataFrame) -> DataFrame:
    """Discoveries without those of files that changed or went (G3)."""
    gone = changes.where(F.col("change").isin("deleted", "modified")).select(F.col("path").alias("source_file"))
    return discoveries.join(gone, "source_file", "left_anti")
