"""Repositories: exclusion, environments, languages (FLT12, FLT13, FLT19, AGG10, AGG11, ANA8) and ANA10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .query import first_by

EXTENSIONS = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "tf": "terraform", "tfvars": "terraform"}
THRESHOLD = 3
TEMPLATES = ("template.yaml", "template.yml", "template.json", "samconfig.yaml", "samconfig.yml", "samconfig.toml")
IGNORED = ("node_modules dist build .next .nuxt coverage .turbo .parcel-cache __pycache__ .pytest_cache .mypy_cache .ruff_cache venv .venv env .tox .nox target .git .svn .hg vendor .idea .vscode .github out output bin obj").split()


def ignored(path: Column | str) -> Column:
    """True if a directory of the path is one that surveys skip (SRC4)."""
    folders = F.split(S.col(path), "/")
    return F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: x.isin(*IGNORED))


def excluded(name: Column | str, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | S.col(name).rlike(S.glob_to_regex(g))
    return out


def environments(repos: DataFrame, config: list[tuple[str, list[str], str | None]], name: str = "repo") -> DataFrame:
    """``repos`` with environment and aws_account_id: the first environment, in
    order, one of whose globs matches. The rules are configuration, so they
    become one CASE ladder and no join."""
    env, account = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, globs, acc in reversed(config):
        hit = excluded(name, globs)
        env, account = F.when(hit, F.lit(label)).otherwise(env), F.when(hit, F.lit(acc).cast("string")).otherwise(account)
    return repos.withColumn("environment", env).withColumn("aws_account_id", account)


def languages(files: DataFrame) -> DataFrame:
    """(repo, language, confidence, method) from ``files(repo, path[, content])``:
    config files at 0.95, else extensions of three files or more at 0.7. Files
    three levels deep count, and again under src, lib and app (ANA8)."""
    path = F.col("path")
    depth = F.size(F.split(path, "/"))
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    lang = S.lookup(ext, EXTENSIONS)
    again = path.rlike("^(src|lib|app)/") & (depth <= 4)
    times = F.when(depth <= 3, 1).otherwise(0) + F.when(again, 1).otherwise(0)
    seen = files.where(~ignored("path"))
    counted = seen.where(lang.isNotNull()).groupBy("repo", lang.alias("language")).agg(F.sum(times).alias("n")).where(F.col("n") >= THRESHOLD).select("repo", "language", F.lit(0.7).alias("confidence"), F.lit("extension").alias("method"))
    content = F.col("content") if "content" in files.columns else F.lit(None).cast("string")
    text = F.coalesce(content, F.lit(""))
    typed = text.rlike('"(typescript|ts-node|ts-jest|ts-loader)"')
    cfn = text.rlike("AWSTemplateFormatVersion|Transform|AWS::Serverless|AWS::Lambda|AWS::DynamoDB")
    config = (
        F.when(path == "package.json", F.when(typed, "typescript").otherwise("javascript"))
        .when(path.isin("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile"), "python")
        .when(path.isin(*TEMPLATES) & cfn, "cloudformation")
        .when((depth == 1) & path.endswith(".tf"), "terraform")
    )
    configured = seen.where(config.isNotNull()).select("repo", config.alias("language")).distinct().select("repo", "language", F.lit(0.95).alias("confidence"), F.lit("config").alias("method"))
    return first_by(configured.union(counted), ["repo", "language"], F.desc("confidence"))


def entry_points(files: DataFrame) -> DataFrame:
    """(repo, entry_point): the first of seven names in the root, then src, then app (UDT18)."""
    names = ["main.py", "app.py", "run.py", "server.py", "__main__.py", "wsgi.py", "asgi.py"]
    rank = S.lookup("path", {f + n: k for k, (f, n) in enumerate((f, n) for f in ("", "src/", "app/") for n in names)})
    return files.withColumn("rank", rank).where("rank is not null").groupBy("repo").agg(F.min_by("path", "rank").alias("entry_point"))


def consolidate(scan: DataFrame, accounts: int) -> DataFrame:
    """(name, kind, accounts, universal): resources of many accounts by name (ANA10)."""
    per = scan.groupBy("name", "kind").agg(F.countDistinct("account").alias("accounts"))
    return per.withColumn("universal", F.col("accounts") == accounts)


def variations(scan: DataFrame) -> DataFrame:
    """(name, kind, configs): resources whose configuration differs between accounts."""
    return scan.groupBy("name", "kind").agg(F.countDistinct("config").alias("configs")).where("configs > 1")


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, added, removed, modified, unchanged, anomaly): anomaly if more than
    a fifth of what was there is gone or changed."""
    a, b = old.select("account", "name", "kind", F.col("config").alias("was"), F.lit(1).alias("o")), new.select("account", "name", "kind", F.col("config").alias("now"), F.lit(1).alias("n"))
    both = a.join(b, ["account", "name", "kind"], "full_outer")
    out = both.groupBy("kind").agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).alias("modified"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull() & F.col("was").eqNullSafe(F.col("now"))).alias("unchanged"), F.count("o").alias("before"))
    return out.withColumn("anomaly", F.coalesce((F.col("removed") + F.col("modified")) / F.nullif(F.col("before"), F.lit(0)) > 0.2, F.lit(False))).drop("before")
