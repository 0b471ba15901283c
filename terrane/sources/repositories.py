"""Files of repositories, repository lists, survey state, configuration (SRC3-SRC12, SNK3, SNK5)."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ConfigError, StateError
from ..operators.repos import ignored

STATE = "repo string, commit_sha string, last_surveyed timestamp, discovery_count bigint, detected_languages array<string>, survey_successful boolean"
REPOS = "full_name string, owner string, name string, url string, default_branch string, language string, archived boolean, fork boolean, topics array<string>"


def files(spark: SparkSession, repos: list[tuple[str, str]], extensions: tuple[str, ...] = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "py", "tf", "yaml", "yml", "json", "toml", "txt", "cfg")) -> DataFrame:
    """(repo_index, repo, path, content) of ``repos`` (name, folder): text files by
    extension, folders that surveys skip left out (SRC3-SRC5)."""
    out = None
    for index, (name, folder) in enumerate(repos):
        root = os.path.abspath(folder)
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
        part = read.select(F.lit(index).cast("bigint").alias("repo_index"), F.lit(name).alias("repo"), path.alias("path"), F.decode("content", "utf-8").alias("content"))
        out = part if out is None else out.unionAll(part)
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return out.where(~ignored("path") & ext.isin(*extensions))


class RepositoryList(DataSource):
    """Repositories of an organisation, a partition a page of 100 (SRC6, SRC7).

    Reads pages from a JSON file named by the option ``path`` (a list of
    repositories), newest update first; a live service would fill the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return REPOS

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["path"], self.options.get("repo"))


class _Pages(DataSourceReader):
    SIZE = 100

    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def _load(self) -> list[dict]:
        import json

        with open(self.path, encoding="utf-8") as f:
            rows = sorted(json.load(f), key=lambda r: (r.get("updated_at") or "", r.get("full_name") or ""), reverse=True)
        return [r for r in rows if self.only in (None, r.get("full_name"))]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(max(1, -(-len(self._load()) // self.SIZE)))]

    def read(self, partition: InputPartition):
        for r in self._load()[partition.value * self.SIZE : (partition.value + 1) * self.SIZE]:
            owner, _, name = r["full_name"].partition("/")
            yield (r["full_name"], owner, r.get("name") or name, r.get("clone_url") or r.get("html_url"), r.get("default_branch") or "main", r.get("language"), bool(r.get("archived")), bool(r.get("fork")), list(r.get("topics") or []))


def head_commit(folder: str) -> str | None:
    """The commit that a local repository is at, None if it is none (SRC9)."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None


def name_status(spark: SparkSession, folder: str, old: str, new: str = "HEAD") -> DataFrame:
    """Lines of a name-status diff for ``incremental.name_status_changes`` (SRC10)."""
    done = subprocess.run(["git", "-C", folder, "diff", "--name-status", old, new], capture_output=True, text=True)
    if done.returncode:
        raise StateError(done.stderr.strip() or "no diff")
    return spark.createDataFrame([(x,) for x in done.stdout.splitlines() if x], "value string")


def load_state(spark: SparkSession, folder: str) -> DataFrame:
    """Survey state, empty if there is none yet."""
    try:
        found = spark.read.parquet(folder)
        found.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], STATE)
    return found


def save_state(state: DataFrame, folder: str) -> None:
    """Written beside and then moved, as the state that is read may be what is replaced."""
    state.write.mode("overwrite").parquet(f"{folder}.new")
    state.sparkSession.read.parquet(f"{folder}.new").write.mode("overwrite").parquet(folder)


@dataclass
class Config:
    """Configuration with its defaults (SRC12, API21)."""

    local_paths: list[str] = field(default_factory=list)
    org: str | None = None
    exclude: list[str] = field(default_factory=list)
    languages_exclude: list[str] = field(default_factory=list)
    environments: list[dict] = field(default_factory=list)
    token_budget: int = 8000
    staleness_days: int = 7
    provider: str = "none"

    @staticmethod
    def load(path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            try:
                d = yaml.safe_load(f) or {}
            except yaml.YAMLError as e:
                raise ConfigError(str(e)) from None
        repos, out, llm = d.get("repos") or {}, d.get("output") or {}, d.get("llm") or {}
        c = Config(
            [os.path.expanduser(p) for p in repos.get("local_paths") or []], repos.get("github_org") or os.environ.get("TERRANE_ORG"), list(repos.get("exclude") or []),
            list((d.get("languages") or {}).get("exclude") or []), list(d.get("environments") or []), int(os.environ.get("TERRANE_BUDGET") or d.get("token_budget") or 8000),
            int(d.get("staleness_days") if d.get("staleness_days") is not None else out.get("staleness_days", 7)), llm.get("provider") or "none",
        )
        return c.check()

    def check(self) -> Config:
        if not self.local_paths and not self.org:
            raise ConfigError("neither local_paths nor an organisation is named")
        if self.token_budget <= 0 or self.staleness_days < 0:
            raise ConfigError("token_budget must be positive and staleness_days not negative")
        return self


TEMPLATE = "repos:\n  local_paths: []\n  exclude: []\nlanguages:\n  exclude: []\nenvironments: []\ntoken_budget: 8000\nstaleness_days: 7\n"


def init_config(path: str, force: bool = False) -> None:
    """Write a template; an existing file stays unless forced (SNK5)."""
    if os.path.exists(path) and not force:
        raise ConfigError(f"{path} exists")
    with open(path, "w", encoding="utf-8") as f:
        f.write(TEMPLATE)


PROVIDERS: dict[str, object] = {"none": None}


def provider(name: str):
    """A text provider, a callable of (system, prompt); register in PROVIDERS (API20)."""
    from ..errors import ProviderError

    if name not in PROVIDERS:
        raise ProviderError(f"unknown provider {name!r}")
    return PROVIDERS[name]
