import json
import subprocess

import pytest
from pyspark.sql import functions as F

from terrane.errors import ConfigError
from terrane.functions import parsers as P
from terrane.operators import build, coupling, incremental, query
from terrane.sources import repositories as R
from terrane.streaming import ingest


def kinds(rows, *fields):
    return [tuple(r.get(f) for f in ("kind", *fields)) for r in rows]


def test_python():
    src = "import boto3\nimport a.b\nfrom . import x\nfrom m import y\nimport q as r\nt = boto3.resource('dynamodb').Table('orders-table')\nt.get_item(Key={})\ns3 = boto3.client('s3')\nsns = boto3.client('sns')\nrequests.post('http://x')\nc.put_item(TableName='users')\nsession.query()\n"
    rows = P.parse_python("a.py", src)
    assert kinds([r for r in rows if r["kind"] == "database_access"], "name", "operation") == [("database_access", "orders-table", "Read"), ("database_access", "users", "Write"), ("database_access", None, "Read")]
    assert [r["module"] for r in rows if r["kind"] == "import"] == ["boto3", "a.b", ".", "m"]
    assert kinds([r for r in rows if r["kind"] in ("cloud_resource", "queue_operation", "api_call")], "sub_type", "method") == [("cloud_resource", "s3", None), ("queue_operation", "sns", None), ("api_call", None, "POST")]
    assert P.parse_file("a.py", "def (") == []
    s = P.python_service({"pyproject.toml": '[project]\nname = "orders"\ndependencies = ["fastapi"]\n', "src/main.py": ""})
    assert (s["name"], s["framework"], s["entry_point"]) == ("orders", "fastapi", "src/main.py")


def test_javascript():
    src = """import { GetItemCommand, X as Y } from '@aws-sdk/client-dynamodb';
const s3 = require("@aws-sdk/client-s3"); // new PutItemCommand({TableName: 'commented'})
await c.send(new GetItemCommand({ Key: {a: "TableName"}, TableName: 'users-table' }));
await c.send(new SendMessageCommand({ QueueUrl: "https://sqs/1/jobs" }));
docClient.put({ TableName: "orders" }); list.get(1);
fetch(`https://api/x`); axios.post('http://y', {}); axios(url);
"""
    rows = P.parse_javascript("a.js", src)
    assert kinds([r for r in rows if r["kind"] == "database_access"], "name", "operation") == [("database_access", "users-table", "Read"), ("database_access", "orders", "Write")]
    assert kinds([r for r in rows if r["kind"] == "queue_operation"], "name", "operation") == [("queue_operation", "jobs", "Publish")]
    assert kinds([r for r in rows if r["kind"] == "api_call"], "target", "method") == [("api_call", "https://api/x", None), ("api_call", "http://y", "POST"), ("api_call", "unknown", None)]
    assert [r["imported_items"] for r in rows if r["kind"] == "import"][0] == ["GetItemCommand", "X"]
    assert [r["sub_type"] for r in rows if r["kind"] == "cloud_resource"] == ["s3"]
    s = P.javascript_service('{"name": "web", "dependencies": {"express": "4"}}')
    assert (s["name"], s["framework"], s["entry_point"], s["language"]) == ("web", "express", "index.js", "javascript")


def test_terraform():
    src = """terraform {
  backend "s3" {
    key = "production/terraform.tfstate"
  }
}
resource "aws_dynamodb_table" "users" {
  name = "users-table"
  tags = {
    Environment = "prod"
    Team = "a"
  }
}
resource "aws_sqs_queue" "jobs" {
}
resource "aws_lambda_function" "f" {
  function_name = "worker"
  runtime = "python3.11"
}
"""
    rows = P.parse_terraform("main.tf", src)
    assert kinds(rows, "name") == [("database_access", "users-table"), ("queue_operation", "jobs"), ("service", "worker")]
    assert rows[0]["deployment"]["environment"] == "prod" and rows[0]["deployment"]["terraform_workspace"] == "production"
    assert rows[2]["language"] == "python" and rows[2]["entry_point"] == "index.handler"
    assert [P.workspace_of_key(k) for k in ("terraform.tfstate", "env/prod/x.tfstate", "a.b/x")] == [None, "prod", None]


def test_cloudformation():
    src = """Transform: AWS::Serverless-2016-10-31
Parameters: {Stage: {Default: dev}}
Resources:
  F: {Type: AWS::Serverless::Function, Properties: {Runtime: nodejs20.x, FunctionName: !Sub 'x-${Stage}', Handler: app.h}}
  T: {Type: AWS::DynamoDB::Table, Properties: {TableName: {Ref: Name}}}
  N: {Type: AWS::DynamoDB::Table}
  B: {Type: AWS::S3::Bucket}
"""
    rows = P.parse_cloudformation("template.yaml", src)
    assert kinds(rows, "name") == [("service", "x-${Stage}"), ("database_access", "${Ref:Name}"), ("cloud_resource", "B")]
    assert rows[0]["deployment"] == {"deployment_method": "sam", "terraform_workspace": None, "environment": "dev", "stack_name": "template", "tags": {}}
    assert P.parse_cloudformation("x.yaml", "a: 1") == [] and P.parse_file("x.json", "{") == []
    assert P.parsers_for(["TypeScript", "javascript", "SAM", "rust"], ["python"]) == ["javascript", "cloudformation"]


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_survey_end_to_end(spark, tmp_path):
    write(tmp_path / "a", package_dot_json='{"name": "service-a", "dependencies": {"express": "1"}}', src__index_dot_js="import x from 'service-b';\nnew PutItemCommand({TableName: 'users'})", node_modules__m_dot_js="new PutItemCommand({TableName: 'hidden'})")
    write(tmp_path / "b", package_dot_json='{"name": "service-b"}', src__index_dot_js="new GetItemCommand({TableName: 'users'})\nnew UpdateItemCommand({})")
    files = R.files(spark, [("org/a", str(tmp_path / "a")), ("org/b", str(tmp_path / "b"))])
    found = P.discover(files)
    g, rejects = build.build(found)
    assert {r["display_name"] for r in g.nodes.collect()} == {"service-a", "service-b", "users", "dynamodb-unknown"}
    got = sorted((r["src"].split(":")[2], r["edge_type"], r["dst"].split(":")[2]) for r in g.edges.collect())
    assert got == [("service-a", "CALLS", "service-b"), ("service-a", "WRITES", "users"), ("service-b", "READS", "dynamodb-unknown"), ("service-b", "READS", "users"), ("service-b", "WRITES", "dynamodb-unknown")]
    assert rejects.count() == 0
    pair = coupling.couplings(g, coupling.access_map(g)).collect()
    assert [(r["risk"], len(r["resources"])) for r in pair] == [("Medium", 1)]
    assert query.counts_by_type(g).count() == 2


def test_git_and_state(spark, tmp_path):
    repo = tmp_path / "r"
    write(repo, index_dot_js="1")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(repo), *a], check=True, capture_output=True)
    git("init")
    git("add", ".")
    git("commit", "-m", "1")
    first = R.head_commit(str(repo))
    write(repo, index_dot_js="2", new_dot_ts="3")
    git("add", ".")
    git("commit", "-m", "2")
    changes = incremental.name_status_changes(R.name_status(spark, str(repo), first))
    assert {r["path"]: r["change"] for r in changes.collect()} == {"index.js": "modified", "new.ts": "added"}
    assert incremental.summary(changes).first()["to_parse"] == 2
    assert R.head_commit(str(tmp_path)) is None
    folder = str(tmp_path / "state")
    assert R.load_state(spark, folder).count() == 0
    done = spark.createDataFrame([("r", first, None, 3, ["js"], True)], R.STATE)
    R.save_state(incremental.mark_surveyed(R.load_state(spark, folder), done), folder)
    R.save_state(incremental.mark_surveyed(R.load_state(spark, folder), done), folder)
    assert incremental.state_totals(R.load_state(spark, folder)).first().asDict() == {"repos": 1, "discoveries": 3}


def test_repository_list(spark, tmp_path):
    rows = [{"full_name": f"org/r{k}", "updated_at": f"2024-01-{k % 28 + 1:02}", "archived": k == 3} for k in range(150)]
    (tmp_path / "repos.json").write_text(json.dumps(rows))
    spark.dataSource.register(R.RepositoryList)
    got = spark.read.format("repositories").option("path", str(tmp_path / "repos.json")).load()
    assert got.count() == 150 and got.rdd.getNumPartitions() == 2
    assert got.where("archived").first()["name"] == "r3"


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    R.init_config(path)
    with pytest.raises(ConfigError):
        R.init_config(path)
    with pytest.raises(ConfigError):
        R.Config.load(path)
    (tmp_path / "c.yaml").write_text("repos: {local_paths: ['~/x']}\ntoken_budget: 500\nstaleness_days: 0\n")
    c = R.Config.load(path)
    assert c.token_budget == 500 and c.staleness_days == 0 and not c.local_paths[0].startswith("~")


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text('{"a": 1}\nnot json\n')
    q = ingest.log_lines(spark, str(log)).select("line", F.col("entry").isNotNull().alias("ok")).writeStream.format("memory").queryName("loglines").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["ok"] for r in spark.table("loglines").collect()) == [False, True]
    files = spark.createDataFrame([(0, "o/a", "a.py", "c.get_item(TableName='t')")], "repo_index long, repo string, path string, content string")
    src, out = str(tmp_path / "d"), str(tmp_path / "g")
    for k in range(2):
        P.discover(files.withColumn("repo", F.concat("repo", F.lit(str(k))))).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        ingest.fold(spark, stream, out, str(tmp_path / "cp")).awaitTermination(60)
    nodes, edges = ingest.current(spark, out)
    assert {r["display_name"] for r in nodes.collect()} == {"a0", "a1", "t"}
    assert edges.count() == 2
