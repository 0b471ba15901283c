"""Instructions for assistants per service (SCL17-SCL20, RND8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import Graph

#: language -> framework (or "" for any other) -> style
STYLES = {
    "python": {
        "fastapi": "FastAPI: Pydantic models for validation, type hints required, async/await",
        "flask": "Flask: blueprints for routing, type hints recommended",
        "django": "Django: MTV pattern, Django ORM, never bypass model validation",
        "chalice": "AWS Chalice: decorators for routing, Lambda best practices",
        "starlette": "Starlette: async/await, type hints recommended",
        "": "Python: type hints, PEP 8",
    },
    "typescript": {
        "express": "Express with TypeScript: middleware, strong typing, async error handling",
        "nestjs": "NestJS: decorators, dependency injection, DTOs for validation",
        "react": "React with TypeScript: functional components, hooks, typed props",
        "": "TypeScript: strict mode, interfaces over type aliases",
    },
    "javascript": {
        "express": "Express: middleware, try/catch around async code",
        "react": "React: functional components, hooks, PropTypes or TypeScript",
        "": "JavaScript: ES6+, consider TypeScript",
    },
}
TESTS = {
    "pytest": "pytest, over 80% coverage, fixtures, pytest-mock for dependencies",
    "jest": "Jest, describe/it blocks, jest.mock(), over 80% coverage",
    "mocha": "Mocha with Chai, describe/it structure",
    "vitest": "Vitest, fast unit tests, vi.mock()",
    "unittest": "unittest, setUp/tearDown, unittest.mock",
}


def code_style(language: Column, framework: Column) -> Column:
    lang, fw = F.lower(language), F.lower(framework)
    out = None
    for name, styles in STYLES.items():
        own = F.lit(styles[""])
        for f, text in styles.items():
            own = F.when(fw == f, text).otherwise(own) if f else own
        out = F.when(lang == name, own) if out is None else out.when(lang == name, own)
    return out


def testing(test_framework: Column) -> Column:
    return S.lookup(F.lower(test_framework), TESTS)


def deployment(method: Column, workspace: Column, environment: Column, stack: Column, name: Column) -> Column:
    """Command line by deployment method (SCL18)."""
    where = F.coalesce(workspace, environment, F.lit("default"))
    plain = F.concat(F.lit("cd terraform/"), name, F.lit(" && terraform plan && terraform apply"))
    var = F.concat(F.lit("-var-file="), where, F.lit(".tfvars"))
    with_var = F.concat(F.lit("cd terraform/"), name, F.lit(" && terraform plan "), var, F.lit(" && terraform apply "), var)
    named = F.coalesce(stack, F.concat(name, F.lit("-stack")))
    m = F.lower(method)
    return (
        F.when(m == "terraform", F.when(where == "default", plain).otherwise(with_var))
        .when(m == "sam", F.concat(F.lit("sam build && sam deploy --stack-name "), named))
        .when(m == "cloudformation", F.concat(F.lit("aws cloudformation deploy --template-file template.yaml --stack-name "), named, F.lit(" --capabilities CAPABILITY_IAM")))
    )


def gotcha(text: Column) -> Column:
    """A gotcha as MUST or DO NOT; prefixes fall away whole (SCL19, D11)."""
    t, low = F.trim(text), F.lower(text)
    head = F.lower(t)
    has = lambda *words: F.lit(False) if not words else low.contains(words[0]) | (has(*words[1:]) if len(words) > 1 else F.lit(False))
    after = lambda n: F.trim(F.substring(t, n + 1, F.length(t)))
    must = (
        F.when(head.startswith("must "), after(5))
        .when(head.startswith("always "), after(7))
        .when(head.contains("is required") | head.contains("are required"), F.concat(F.lit("ensure "), F.regexp_replace(t, " (is|are) required", "")))
        .otherwise(t)
    )
    never = F.when(head.startswith("don't ") | head.startswith("never ") | head.startswith("avoid "), after(6)).when(head.startswith("dont "), after(5)).when(head.startswith("do not "), after(7)).otherwise(t)
    return F.when(has("must", "required", "always", "ensure"), F.concat(F.lit("MUST "), must)).when(has("don't", "dont", "never", "avoid", "do not"), F.concat(F.lit("DO NOT "), never)).otherwise(F.concat(F.lit("DO NOT violate: "), text))


def dependency_lines(g: Graph) -> DataFrame:
    """(id, kind, line) of what a service depends on; reads and writes of one
    database become one line, by its id (SCL20, D11)."""
    target = g.nodes.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type"), F.col("display_name").alias("dst_name"), F.col("business_context.purpose").alias("purpose"))
    service = g.nodes.where("node_type = 'service'").select(F.col("id").alias("src"))
    e = g.edges.where("edge_type in ('CALLS', 'READS', 'WRITES', 'PUBLISHES', 'SUBSCRIBES')").select("src", "dst", "edge_type").join(service, "src", "left_semi").join(target, "dst")
    e = e.where("(edge_type = 'CALLS' and dst_type = 'service') or (edge_type in ('READS', 'WRITES') and dst_type = 'database') or (edge_type in ('PUBLISHES', 'SUBSCRIBES') and dst_type = 'queue')")
    per = e.groupBy("src", "dst", "dst_type").agg(F.first("dst_name").alias("name"), F.first("purpose").alias("purpose"), *[F.bool_or(F.col("edge_type") == t).alias(t.lower()) for t in ("READS", "WRITES", "PUBLISHES", "SUBSCRIBES")])
    access = F.when(F.col("reads") & F.col("writes"), "read/write access").when(F.col("writes"), "write access").otherwise("read access")
    use = F.concat_ws("; ", F.when(F.col("publishes"), "publish on events"), F.when(F.col("subscribes"), "consume messages"))
    note = F.when(F.col("dst_type") == "service", F.coalesce("purpose", F.lit("purpose unknown"))).when(F.col("dst_type") == "database", access).otherwise(use)
    return per.select(F.col("src").alias("id"), F.concat("dst_type", F.lit("s")).alias("kind"), F.concat(F.col("name"), F.lit(" ("), note, F.lit(")")).alias("line"))


def instructions(g: Graph) -> DataFrame:
    """(id, instructions struct) for each service (RND8)."""
    a = S.attr
    deps = dependency_lines(g).groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("line")))).alias(k) for k in ("services", "databases", "queues")])
    service = g.nodes.where("node_type = 'service'").join(deps, "id", "left")
    gotchas = F.transform(F.coalesce(F.col("business_context.gotchas"), F.array().cast("array<string>")), gotcha)
    body = F.struct(
        code_style(a("language"), a("framework")).alias("code_style"),
        testing(a("test_framework")).alias("testing"),
        deployment(a("deployment_method"), a("terraform_workspace"), a("environment"), a("stack_name"), F.col("display_name")).alias("deployment"),
        gotchas.alias("gotchas"),
        F.when(F.col("services").isNotNull(), F.struct("services", "databases", "queues")).alias("dependencies"),
    )
    return service.select("id", body.alias("instructions"))
