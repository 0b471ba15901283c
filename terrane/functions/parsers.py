"""Source files to discoveries (UDT1-UDT19): pure functions of (path, text), and
``discover``, which runs them over a table of files in Arrow batches.

Python is read with ``ast``; JavaScript with a tolerant scanner that blanks
comments and matches brackets; Terraform with a block scanner; templates with
the YAML and JSON readers. A file that cannot be read yields nothing."""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import DISCOVERIES
from ..session import share_code

Row = dict
#: Discoveries of one Arrow batch that goes back, however many a batch of files holds.
FOUND_ROWS = 4096


def row(kind: str, path: str, line: int | None = None, **more) -> Row:
    return {"kind": kind, "source_file": path, "source_line": line} | more


# ------------- python

PY_DYNAMO = {"get_item": "Read", "query": "Read", "scan": "Read", "batch_get_item": "Read", "transact_get_items": "Read", "put_item": "Write", "delete_item": "Write", "batch_write_item": "Write", "transact_write_items": "Write", "update_item": "ReadWrite"}
PY_CLOUD = {"s3": ("cloud_resource", "s3", None), "lambda": ("cloud_resource", "lambda", None), "sqs": ("queue_operation", "sqs", "Unknown"), "sns": ("queue_operation", "sns", "Publish"), "events": ("queue_operation", "eventbridge", "Unknown"), "eventbridge": ("queue_operation", "eventbridge", "Unknown")}
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
FRAMEWORKS = ("fastapi", "flask", "django", "chalice", "starlette")


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def parse_python(path: str, text: str) -> list[Row]:
    """Imports, boto3 clients, HTTP calls and table accesses (UDT6-UDT9)."""
    tree = ast.parse(text)
    out: list[Row] = []
    tables: dict[str, str] = {}
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [row("import", path, node.lineno, module=a.name, is_relative=False, imported_items=[]) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom):
            out.append(row("import", path, node.lineno, module="." * node.level + (node.module or ""), is_relative=node.level > 0, imported_items=[a.name for a in node.names]))
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and node.value.func.attr == "Table" and node.value.args:
            name = _text(node.value.args[0])
            for target in node.targets:
                if name and isinstance(target, ast.Name):
                    tables[target.id] = name
    for c in calls:
        if not isinstance(c.func, ast.Attribute):
            continue
        owner, method = c.func.value, c.func.attr
        base = owner.id if isinstance(owner, ast.Name) else None
        first = _text(c.args[0]) if c.args else None
        if base == "boto3" and method in ("client", "resource") and first and first != "dynamodb":
            kind, sub, op = PY_CLOUD.get(first, ("cloud_resource", first, None))
            out.append(row(kind, path, c.lineno, sub_type=sub, operation=op, detection_method=f"boto3.{method}"))
        elif base in ("requests", "httpx") and method in HTTP_VERBS:
            out.append(row("api_call", path, c.lineno, target=first or "unknown", method=method.upper(), detection_method=base))
        elif method in PY_DYNAMO:
            name = next((_text(k.value) for k in c.keywords if k.arg == "TableName"), None)
            if name is None and c.args and isinstance(c.args[0], ast.Dict):
                name = next((_text(v) for k, v in zip(c.args[0].keys, c.args[0].values) if _text(k) == "TableName"), None)
            if name is None and base:
                name = tables.get(base)
            if name is None and isinstance(owner, ast.Call) and isinstance(owner.func, ast.Attribute) and owner.func.attr == "Table" and owner.args:
                name = _text(owner.args[0])
            out.append(row("database_access", path, c.lineno, sub_type="dynamodb", name=name, operation=PY_DYNAMO[method], detection_method=method))
    return out


def python_service(files: dict[str, str]) -> Row | None:
    """The service of a Python repository: pyproject, setup.py, requirements (UDT17, UDT18, SRC14)."""
    entry = next((p for f in ("", "src/", "app/") for n in ("main.py", "app.py", "run.py", "server.py", "__main__.py", "wsgi.py", "asgi.py") if (p := f + n) in files), "main.py")
    if "pyproject.toml" in files:
        text = files["pyproject.toml"]
        name = re.search(r"(?ms)^\[(?:project|tool\.poetry)\]\s*$(?:(?!^\[).)*?^name\s*=\s*[\"']([^\"']+)", text)
        if name:
            return row("service", "pyproject.toml", 1, name=name[1], language="python", framework=next((f for f in FRAMEWORKS if f in text.lower()), None), entry_point=entry)
    if "setup.py" in files:
        name = re.search(r"name\s*=\s*[\"']([^\"']+)", files["setup.py"])
        if name:
            return row("service", "setup.py", 1, name=name[1], language="python", framework=next((f for f in FRAMEWORKS if f in files["setup.py"].lower()), None), entry_point=entry)
    if "requirements.txt" in files:
        wanted = {re.split(r"[=<>~!\[; ]", x.strip(), maxsplit=1)[0].lower() for x in files["requirements.txt"].splitlines()}
        return row("service", "requirements.txt", 1, name=None, language="python", framework=next((f for f in FRAMEWORKS if f in wanted), None), entry_point=entry)
    return None


# ------------- javascript

JS_METHODS = {"get": "Read", "getItem": "Read", "query": "Read", "scan": "Read", "batchGet": "Read", "batchGetItem": "Read", "transactGet": "Read", "transactGetItems": "Read", "put": "Write", "putItem": "Write", "delete": "Write", "deleteItem": "Write", "batchWrite": "Write", "batchWriteItem": "Write", "transactWrite": "Write", "transactWriteItems": "Write", "update": "ReadWrite", "updateItem": "ReadWrite"}
JS_RECEIVERS = ("dynamo", "docclient", "documentclient", "ddb", "table")
JS_COMMANDS = {"GetItem": "Read", "Query": "Read", "Scan": "Read", "BatchGetItem": "Read", "TransactGetItems": "Read", "PutItem": "Write", "DeleteItem": "Write", "BatchWriteItem": "Write", "TransactWriteItems": "Write", "UpdateItem": "ReadWrite"}
JS_QUEUE = {"SendMessage": "Publish", "SendMessageBatch": "Publish", "ReceiveMessage": "Subscribe", "DeleteMessage": "Subscribe", "DeleteMessageBatch": "Subscribe"}
_STRING = r"""(?:'[^'\n]*'|"[^"\n]*"|`[^`]*`)"""
JS_FRAMEWORKS = (("@nestjs/core", "nestjs"), ("next", "next.js"), ("nuxt", "nuxt"), ("express", "express"), ("fastify", "fastify"), ("koa", "koa"), ("hapi", "hapi"), ("@hapi/hapi", "hapi"))


def _without_comments(text: str) -> str:
    """Comments as blanks; strings stay, so positions and lines do too."""
    blank = lambda m: m[0] if m[0][0] in "'\"`" else re.sub(r"[^\n]", " ", m[0])
    return re.sub(rf"""{_STRING}|//[^\n]*|/\*.*?\*/""", blank, text, flags=re.S)


def _argument(text: str, at: int) -> str:
    """What lies between the parenthesis at ``at`` and its partner."""
    depth, i, quote = 0, at, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return text[at + 1 : i]
        i += 1
    return text[at + 1 :]


def _property(arg: str, name: str) -> str | None:
    """Text of a property of an object literal, without quotes."""
    if not arg.lstrip().startswith("{"):
        return None
    m = re.search(rf"""['"]?\b{name}['"]?\s*:\s*({_STRING}|[^,}}\n]+)""", arg)
    return m[1].strip().strip("'\"`").strip() if m else None


def parse_javascript(path: str, text: str) -> list[Row]:
    """Imports, SDK clients, table and queue accesses, HTTP calls (UDT1-UDT5)."""
    code = _without_comments(text)
    ends = [m.start() for m in re.finditer("\n", code)]
    line = lambda m: bisect_left(ends, m.start()) + 1
    out: list[Row] = []
    for m in re.finditer(rf"""\bimport\s+(?:([\w$*{{}}\s,]+?)\s+from\s+)?({_STRING})|\brequire\(\s*({_STRING})\s*\)""", code):
        module = (m[2] or m[3])[1:-1]
        items = [x.split(" as ")[0].strip() for x in re.sub(r"[{}]", ",", m[1] or "").split(",") if x.strip() and "*" not in x]
        out.append(row("import", path, line(m), module=module, is_relative=module.startswith("."), imported_items=items))
        low = module.lower()
        if "aws-sdk" in low:
            kind = next((k for k in ("dynamodb", "s3", "sqs", "sns", "lambda") if k in low), None)
            if kind in ("s3", "lambda"):
                out.append(row("cloud_resource", path, line(m), sub_type=kind, detection_method="import"))
    for m in re.finditer(r"""\bnew\s+(\w+?)Command\s*(\()""", code):
        arg = _argument(code, m.start(2))
        if m[1] in JS_COMMANDS:
            out.append(row("database_access", path, line(m), sub_type="dynamodb", name=_property(arg, "TableName"), operation=JS_COMMANDS[m[1]], detection_method=f"{m[1]}Command"))
        elif m[1] in JS_QUEUE:
            url = _property(arg, "QueueUrl")
            out.append(row("queue_operation", path, line(m), sub_type="sqs", name=url.rsplit("/", 1)[-1] if url else None, operation=JS_QUEUE[m[1]], detection_method=f"{m[1]}Command"))
    for m in re.finditer(r"""([\w$.]+)\.(\w+)\s*(\()""", code):
        if m[2] in JS_METHODS and any(x in m[1].lower() for x in JS_RECEIVERS):
            out.append(row("database_access", path, line(m), sub_type="dynamodb", name=_property(_argument(code, m.start(3)), "TableName"), operation=JS_METHODS[m[2]], detection_method=m[2]))
    for m in re.finditer(r"""(?<![\w$.])(fetch|axios(?:\.(get|post|put|delete|patch|head|options|request))?)\s*(\()""", code):
        first = re.match(rf"\s*({_STRING})", code[m.end(3) :])
        verb = m[2].upper() if m[2] and m[2] != "request" else None
        out.append(row("api_call", path, line(m), target=first[1][1:-1] if first else "unknown", method=verb, detection_method=m[1].split(".")[0]))
    return out


def javascript_service(package: str, has_tsconfig: bool = False) -> Row:
    """The service that a package file names (SRC13)."""
    p = json.loads(package)
    deps = p.get("dependencies") or {}
    typed = "typescript" in (p.get("devDependencies") or {}) or has_tsconfig
    return row("service", "package.json", 1, name=p.get("name") or "unknown", entry_point=p.get("main") or "index.js", language="typescript" if typed else "javascript", framework=next((f for d, f in JS_FRAMEWORKS if d in deps), None))


# ------------- terraform


def runtime_language(runtime: str | None) -> str:
    """Language of a runtime name (UDT16)."""
    for prefix, language in (("python", "python"), ("nodejs", "javascript"), ("java", "java"), ("go", "go"), ("ruby", "ruby"), ("dotnet", "csharp"), ("provided", "custom")):
        if (runtime or "").startswith(prefix):
            return language
    return "unknown"


def _blocks(text: str) -> Iterator[tuple[str, list[str], str]]:
    """(keyword, labels, body) of the blocks at the top of ``text``."""
    at = 0
    for m in re.finditer(r"""(?m)^\s*(\w+)((?:\s+"[^"\n]*")*)\s*(\{)""", text):
        if m.start() < at:
            continue
        body = _argument(text, m.start(3))
        at = m.start(3) + len(body) + 2
        yield m[1], re.findall(r'"([^"]*)"', m[2]), body


def _attribute(body: str, name: str) -> str | None:
    m = re.search(rf"""(?m)^\s*{name}\s*=\s*"([^"\n]*)"\s*$""", body)
    return m[1] if m else None


def workspace_of_key(key: str) -> str | None:
    """The folder of a state file, unless it looks like a file (UDT11)."""
    parts = key.split("/")
    return parts[-2] if len(parts) > 1 and parts[-2] and "." not in parts[-2] else None


TF_TYPES = {"aws_dynamodb_table": ("database_access", "dynamodb", "name"), "aws_sqs_queue": ("queue_operation", "sqs", "name"), "aws_sns_topic": ("queue_operation", "sns", "name"), "aws_s3_bucket": ("cloud_resource", "s3", "bucket")}


def parse_terraform(path: str, text: str) -> list[Row]:
    """Resources with their deployment (UDT10-UDT12)."""
    code = re.sub(r"(?m)#[^\n\"]*$|^\s*//[^\n]*$", "", text)
    workspace = None
    for word, _, body in _blocks(code):
        if word == "terraform":
            for inner, labels, inside in _blocks(body):
                if inner == "backend":
                    key = _attribute(inside, "key")
                    workspace = workspace_of_key(key) if labels[:1] == ["s3"] and key else _attribute(inside, "workspace")
    out = []
    for word, labels, body in _blocks(code):
        if word != "resource" or len(labels) < 2:
            continue
        tags_at = re.search(r"(?m)^\s*tags\s*=\s*(\{)", body)
        tags = dict(re.findall(r"""(?m)^\s*"?([\w:-]+)"?\s*=\s*"([^"\n]*)"\s*,?$""", _argument(body, tags_at.start(1)))) if tags_at else {}
        low = {k.lower(): v for k, v in tags.items()}
        deployment = {"deployment_method": "terraform", "terraform_workspace": low.get("workspace") or low.get("terraform_workspace") or workspace, "environment": low.get("environment") or low.get("env"), "stack_name": None, "tags": tags}
        if labels[0] in TF_TYPES:
            kind, sub, attribute = TF_TYPES[labels[0]]
            out.append(row(kind, path, 1, sub_type=sub, name=_attribute(body, attribute) or labels[1], operation=None if kind == "cloud_resource" else "Unknown", detection_method="terraform", deployment=deployment))
        elif labels[0] == "aws_lambda_function":
            runtime = _attribute(body, "runtime")
            language = runtime_language(runtime) if re.match("python|nodejs|go|java", runtime or "") else (runtime or "unknown")
            out.append(row("service", path, 1, name=_attribute(body, "function_name") or labels[1], language=language, framework="aws-lambda", entry_point=_attribute(body, "handler") or "index.handler", deployment=deployment))
    return out


# ------------- cloudformation


def _value(v) -> str | None:
    """A literal, a reference, a substitution or an attribute as text (UDT14)."""
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        if isinstance(v.get("Ref"), str):
            return "${Ref:" + v["Ref"] + "}"
        sub = v.get("Fn::Sub")
        if sub is not None:
            return sub if isinstance(sub, str) else sub[0] if isinstance(sub, list) and sub and isinstance(sub[0], str) else None
        got = v.get("Fn::GetAtt")
        if isinstance(got, list):
            return "${GetAtt:" + ".".join(map(str, got)) + "}"
        if isinstance(got, str):
            return "${GetAtt:" + got + "}"
    return None


def load_template(path: str, text: str):
    """A template's mapping, or None if the file is none (FLT15)."""
    if path.endswith(".json"):
        loaded = json.loads(text)
    else:
        import yaml

        class Loader(yaml.SafeLoader):
            """Short tags read as what they hold."""

        def plain(loader, _, node):
            if isinstance(node, yaml.ScalarNode):
                return loader.construct_scalar(node)
            return loader.construct_sequence(node) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node)

        Loader.add_multi_constructor("!", plain)
        loaded = yaml.load(text, Loader)  # noqa: S506  a safe loader
    if not isinstance(loaded, dict):
        return None
    named = path.rsplit("/", 1)[-1].lower() in ("template.yaml", "template.yml", "template.json", "samconfig.yaml", "samconfig.yml")
    return loaded if named or any(k in loaded for k in ("AWSTemplateFormatVersion", "Transform", "Resources")) else None


def parse_cloudformation(path: str, text: str) -> list[Row]:
    """Resources of a template, plain or serverless (UDT13-UDT16)."""
    template = load_template(path, text)
    if template is None:
        return []
    transform = template.get("Transform")
    sam = any("AWS::Serverless" in str(x) for x in (transform if isinstance(transform, list) else [transform or ""]))
    parameters = template.get("Parameters") or {}
    env = next((str(parameters[n]["Default"]) for n in ("Environment", "Env", "Stage", "environment", "env", "stage") if isinstance(parameters.get(n), dict) and parameters[n].get("Default") is not None), None)
    stack = (template.get("Metadata") or {}).get("StackName") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    deployment = {"deployment_method": "sam" if sam else "cloudformation", "terraform_workspace": None, "environment": env, "stack_name": stack, "tags": {}}
    out = []
    for logical, r in (template.get("Resources") or {}).items():
        if not isinstance(r, dict):
            continue
        kind, p = r.get("Type"), r.get("Properties")
        has = isinstance(p, dict)
        p = p if has else {}
        named = lambda *keys: next((x for k in keys if (x := _value(p.get(k)))), logical)  # noqa: E731, B023
        if kind in ("AWS::Serverless::Function", "AWS::Lambda::Function") and has:
            out.append(row("service", path, 1, name=named("FunctionName"), language=runtime_language(_value(p.get("Runtime"))), framework="aws-lambda", entry_point=_value(p.get("Handler")) or "index.handler", deployment=deployment))
        elif kind == "AWS::DynamoDB::Table" and has:
            out.append(row("database_access", path, 1, sub_type="dynamodb", name=named("TableName"), operation="Unknown", detection_method="cloudformation", deployment=deployment))
        elif kind == "AWS::SQS::Queue":
            out.append(row("queue_operation", path, 1, sub_type="sqs", name=named("QueueName"), operation="Unknown", deployment=deployment))
        elif kind == "AWS::SNS::Topic":
            out.append(row("queue_operation", path, 1, sub_type="sns", name=named("TopicName"), operation="Unknown", deployment=deployment))
        elif kind == "AWS::S3::Bucket":
            out.append(row("cloud_resource", path, 1, sub_type="s3", name=named("BucketName"), deployment=deployment))
        elif kind == "AWS::Serverless::Api":
            out.append(row("cloud_resource", path, 1, sub_type="apigateway", name=named("Name", "StageName"), deployment=deployment))
    return out


# ------------- registry

PARSERS = {"javascript": (("js", "jsx", "mjs", "cjs", "ts", "tsx"), parse_javascript), "python": (("py",), parse_python), "terraform": (("tf",), parse_terraform), "cloudformation": (("yaml", "yml", "json"), parse_cloudformation)}
ALIASES = {"typescript": "javascript", "sam": "cloudformation"}


def parsers_for(languages: list[str], exclude: list[str] = ()) -> list[str]:
    """Parser names of languages in any case, each once, without the excluded (UDT19)."""
    out = []
    for x in languages:
        name = ALIASES.get(x.lower(), x.lower())
        if name in PARSERS and x.lower() not in {e.lower() for e in exclude} and name not in out:
            out.append(name)
    return out


def parse_file(path: str, text: str | None, languages: tuple[str, ...] = tuple(PARSERS)) -> list[Row]:
    """Discoveries of one file by its extension; an unreadable file has none."""
    ext = path.rsplit(".", 1)[-1]
    out = []
    for name in languages:
        extensions, parse = PARSERS[name]
        if ext in extensions and text:
            try:
                out += parse(path, text)
            except Exception:  # whatever a reader may say to a broken file
                continue
    return out


def _found(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Discoveries of batches (repo_index, repo, path, content), ``FOUND_ROWS`` at a time."""
    rows = []
    for batch in batches:
        index, repo, path, content = batch.columns
        for at in range(batch.num_rows):
            own = {"repo": repo[at].as_py(), "__repo_index": index[at].as_py()}
            for k, d in enumerate(parse_file(path[at].as_py() or "", content[at].as_py(), languages)):
                full = d | own | {"__position": k}
                if full.get("deployment"):
                    full["deployment"] = full["deployment"] | {"tags": list((full["deployment"]["tags"] or {}).items())}
                rows.append(full)
                if len(rows) == FOUND_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def discover(files: DataFrame, languages: tuple[str, ...] = tuple(PARSERS)) -> DataFrame:
    """Discoveries of ``files(repo_index, repo, path, content)`` with ordinals from
    repo, path and position. A file is parsed alone; what a repository is named
    comes from its package or project files, found by ``services``. A worker holds
    one batch of texts, one file's discoveries and ``FOUND_ROWS`` of the rest."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(DISCOVERIES + ", __repo_index bigint, __position int")
    arrow = to_arrow_schema(schema)

    share_code(files.sparkSession)
    found = files.select("repo_index", "repo", "path", "content").mapInArrow(lambda batches: _found(batches, languages, arrow), schema)
    named = services(files)
    return _ordered(found.unionByName(named))


def services(files: DataFrame) -> DataFrame:
    """The service of each repository, from its package or project files or, if
    it has none, its name. Only those few files of a repository are grouped."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(DISCOVERIES + ", __repo_index bigint, __position int")
    arrow = to_arrow_schema(schema)
    entry = [f + n for f in ("", "src/", "app/") for n in ("main.py", "app.py", "run.py", "server.py", "__main__.py", "wsgi.py", "asgi.py")]
    known = ["package.json", "tsconfig.json", "pyproject.toml", "setup.py", "requirements.txt"]
    few = files.where(F.col("path").isin(*known, *entry)).select("repo", "repo_index", "path", F.when(F.col("path").isin(*known), F.col("content")).alias("content"))
    everyone = files.select("repo", "repo_index").distinct()
    per = everyone.join(few.groupBy("repo", "repo_index").agg(F.collect_list(F.struct("path", "content")).alias("found")), ["repo", "repo_index"], "left")

    def run(batches):
        for batch in batches:
            rows = []
            for repo, index, found in zip(*[c.to_pylist() for c in batch.columns]):
                have = {x["path"]: x["content"] or "" for x in found or []}
                made = None
                try:
                    made = javascript_service(have["package.json"], "tsconfig.json" in have) if "package.json" in have else python_service(have)
                except ValueError:
                    made = None
                made = made or row("service", "", None, language="unknown", entry_point="")
                made = made | {"name": made.get("name") or str(repo).rsplit("/", 1)[-1]}
                rows.append(dict.fromkeys(arrow.names) | made | {"repo": repo, "__repo_index": index, "__position": -1})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return per.select("repo", "repo_index", "found").mapInArrow(run, schema)


def _ordered(found: DataFrame) -> DataFrame:
    """Ordinals that repeat exactly: the repository's index, then a hash order of
    the path and the position in the file."""
    place = F.pmod(F.xxhash64(F.coalesce("source_file", F.lit(""))), F.lit(1 << 24)) * 4096 + F.col("__position") + 1
    # what names a repository comes first in it
    first = F.when(F.col("__position") == -1, F.lit(0)).otherwise(place)
    return found.withColumn("ordinal", F.coalesce("__repo_index", F.lit(0)) * F.lit(1 << 40) + first).drop("__repo_index", "__position")
