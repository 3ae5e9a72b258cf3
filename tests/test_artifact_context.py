import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from sourcelake import analyze, schemas
from sourcelake.operators import artifact, context
from sourcelake.sources.artifacts import scan_artifact, write_artifact
from sourcelake.sources.prompts import write_prompts

BODY = 'import {{ helper }} from "./util";\n\nexport function handle(id: string): string {{\n  return "{0}:" + helper(id);\n}}\n'
FILES = {
    "a.ts": BODY.format("A"), "b.ts": BODY.format("B"),
    "m.ts": 'import { helper } from "./util";\nimport React from "react";\n\nexport function main(): string {\n  return helper("<w> & x");\n}\n',
    "util.ts": "export function helper(name: string): string {\n  return `hi ${name}`;\n}\n",
    "lib.js": "function format(msg) {\n  return msg;\n}\n\nmodule.exports = { format };\n",
    "service.js": 'const { format } = require("./lib");\nconst fs = require("fs");\n\nfunction run() {\n  return format(String(fs.existsSync(".")));\n}\n',
    "tests/x.ts": "export const skipped = 1;\n",
}
STAMP = "2024-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def run(spark):
    files = spark.createDataFrame([("app", p, t, None) for p, t in FILES.items()], schemas.FILES)
    return analyze(files, generated_at=F.lit(STAMP))


def assembled(fragments):
    return "\n".join(r.xml for r in fragments.orderBy(*artifact.ORDER).collect())


@pytest.fixture(scope="module")
def document(run):
    return assembled(run.fragments)


def test_structures_and_clusters(run):
    assert sorted(r.path for r in run.structures.collect()) == ["a.ts", "b.ts", "lib.js", "m.ts", "service.js", "util.ts"]
    (cluster,) = run.clusters.collect()
    assert (cluster.cluster_id, cluster.representative, cluster.size) == ("cluster_1", "a.ts", 2)
    assert sorted(r.member for r in run.members.collect()) == ["a.ts", "b.ts"]


def test_document(document):
    """The document is well formed and indented as an XML writer indents it."""
    root = ET.fromstring(document)
    assert [n.get("name") for n in root.iter("node")] == ["a.ts", "b.ts", "lib.js", "m.ts", "service.js", "util.ts"]
    assert {n.get("name") for n in root.iter("node") if n.get("type") == "leaf"} == {"lib.js", "util.ts"}
    assert [m.text for m in root.iter("member")] == ["a.ts", "b.ts"]
    assert root.find("metadata/files_count").text == "6" and root.find("metadata/generated_at").text == STAMP
    assert not [s for s in root.iter("summary") if "PLACEHOLDER" in s.text]
    service = next(m for m in root.iter("module") if m.get("path") == "service.js")
    assert [i.text for i in service.iter("import")] == ["require:./lib", "require:fs"]
    ET.indent(root, space="  ")
    assert document == '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def test_sizes_are_those_of_the_document(run, document):
    m = run.metrics.first()
    assert m.artifact_tokens == -(-len(document) // 4) and m.artifact_bytes == len(document.encode())
    raw = "\n".join(t for p, t in FILES.items() if not p.startswith("tests/"))
    assert m.raw_tokens == -(-len(raw) // 4)
    assert (m.files, m.edges, m.clusters, m.largest_cluster) == (6, 4, 1, 2)
    assert m.compression_ratio == pytest.approx(m.artifact_tokens / m.raw_tokens)


def test_round_trip(spark, run, tmp_path):
    write_artifact(run.fragments, str(tmp_path / "out"))
    loaded = scan_artifact(spark, str(tmp_path / "out"))
    assert sorted((r.src, r.dst) for r in loaded.edges.collect()) == [
        ("a.ts", "util.ts"), ("b.ts", "util.ts"), ("m.ts", "util.ts"), ("service.js", "lib.js")]
    modules = {r.path: r for r in loaded.modules.collect()}
    assert modules["m.ts"].imports == ['import { helper } from "./util";', 'import React from "react";']
    assert modules["m.ts"].functions == ["main"] and modules["lib.js"].imports == [] and modules["lib.js"].classes == []
    assert {r.path: r.summary for r in run.summaries.collect()} == {p: r.summary for p, r in modules.items()}
    assert sorted(r.member for r in loaded.clusters.collect()) == ["a.ts", "b.ts"]
    parts = sorted((tmp_path / "out" / "repo=app").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    assert ET.fromstring(whole).get("repo") == "app"


def test_elements_are_read_one_by_one(spark, tmp_path):
    """Nodes of every form, in a part that starts and ends between elements; names that
    only start like the tag are not its elements."""
    part = [f'<node name="f{i}.py" type="leaf">\n<depends_on />\n</node>' for i in range(2000)]
    part += ['<node name="q.py"/>', '<node\nname="a&amp;&lt;&quot;.py"><depends_on><dep>f1.py</dep><dep></dep></depends_on></node>', '<nodes name="no"></nodes>']
    (tmp_path / "repo=r").mkdir()
    (tmp_path / "repo=r" / "part-0").write_text("</summary>\n" + "\n".join(part) + "\n</dependency_graph>\n<modules>\n")
    loaded = scan_artifact(spark, str(tmp_path))
    names = sorted(r.path for r in loaded.nodes.collect())
    assert names == sorted([f"f{i}.py" for i in range(2000)] + ["q.py", 'a&<".py'])
    assert [tuple(r) for r in loaded.edges.collect()] == [("r", 'a&<".py', "f1.py", 0)]
    plan = loaded.nodes._jdf.queryExecution().executedPlan().toString()
    assert "Format: XML" in plan and "regexp_extract_all" not in plan


def test_metadata_of_a_single_file(spark, document, tmp_path):
    (tmp_path / "doc.xml").write_text(document)
    meta = scan_artifact(spark, str(tmp_path / "doc.xml")).metadata.first()
    assert (meta.repo, meta.files_count, meta.generated_at) == ("app", 6, STAMP)


def test_escaping(spark):
    graph = spark.createDataFrame([('r"<', 'a&"\n.py', ["b<.py"])], "repo string, path string, depends_on array<string>")
    modules = spark.createDataFrame([('r"<', 'a&"\n.py', [], ["f"], ["import <x> & 'y'"], "")],
                                    "repo string, path string, classes array<string>, functions array<string>, imports array<string>, summary string")
    root = ET.fromstring(assembled(artifact.build_artifact(graph, modules, generated_at=F.lit(STAMP))))
    assert root.get("repo") == 'r"<' and root.find(".//node").get("name") == 'a&"\n.py'
    assert root.find(".//dep").text == "b<.py" and root.find(".//import").text == "import <x> & 'y'"
    assert root.find("patterns") is None and root.find(".//summary").text is None


def test_cluster_lines(spark):
    members = spark.createDataFrame([("r", "m00", f"m{i:02d}") for i in range(30)], "repo string, representative string, member string")
    clusters = spark.createDataFrame([("r", "cluster_1", "m00", 30, 0.85, "f")], schemas.CLUSTERS)
    fragments = artifact.cluster_fragments(clusters, members)
    assert fragments.count() == 32
    cluster = ET.fromstring(assembled(fragments))
    assert [m.text for m in cluster.iter("member")] == [f"m{i:02d}" for i in range(30)] and cluster.get("id") == "cluster_1"


def test_documents_in_parts_are_read_as_one(spark, tmp_path):
    nodes = [(repo, f"f{i:03d}.py", [f"f{i - 1:03d}.py"] if i else []) for repo in ("a b/c+d", "ü%2F=x") for i in range(60)]
    graph = spark.createDataFrame(nodes, "repo string, path string, depends_on array<string>")
    modules = graph.select("repo", "path", F.array().cast("array<string>").alias("classes"), F.array().cast("array<string>").alias("functions"),
                           F.array().cast("array<string>").alias("imports"), F.lit("s").alias("summary"))
    members = graph.select("repo", F.lit("f000.py").alias("representative"), F.col("path").alias("member"))
    clusters = spark.createDataFrame([(r, "cluster_1", "f000.py", 60, 0.85, "f") for r in ("a b/c+d", "ü%2F=x")], schemas.CLUSTERS)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_artifact(artifact.build_artifact(graph, modules, clusters, members, generated_at=F.lit(STAMP)), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(list((tmp_path / "out").rglob("part-*"))) > 2
    loaded = scan_artifact(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, loaded.metadata.collect())) == [("a b/c+d", 60, STAMP), ("ü%2F=x", 60, STAMP)]
    for table, n in ((loaded.nodes, 60), (loaded.edges, 59), (loaded.modules, 60), (loaded.clusters, 60)):
        assert sorted(map(tuple, table.groupBy("repo").count().collect())) == [("a b/c+d", n), ("ü%2F=x", n)]


def test_context_and_prompts(spark, run, tmp_path):
    lines = run.context_lines()
    block = context.context_block(lines).orderBy("no").collect()
    assert [r.no for r in block] == list(range(1, len(block) + 1)) and context.context_block(lines).columns == ["repo", "no", "line"]
    text = "\n".join(r.line for r in block)
    assert text.startswith("## Codebase Context\nRepository: app\nFiles: 6 | Dependencies: 4\n\n### Architecture\n  a.ts -> util.ts\n")
    assert "  util.ts (leaf)\n\n### Module Summaries\na.ts: Module a with 1 functions, 0 classes." in text

    questions = spark.createDataFrame([("app", 1, "Why?"), ("app", 2, "How?"), ("gone", 1, "Who?")], schemas.QUESTIONS)
    pairs = {r.id: r for r in context.prompt_pairs(lines, questions).collect()}
    assert sorted(pairs) == ["app_q1", "app_q2"]
    assert pairs["app_q1"].context_suffix == "\n\n---\n\nWhy?" and pairs["app_q1"].baseline_prompt == "Why?"
    assert pairs["app_q1"].context_tokens == -(-len(text) // 4)
    assert pairs["app_q2"].prompt_tokens == -(-len(text + "\n\n---\n\nHow?") // 4)
    average = context.avg_context_tokens(lines, questions).first()
    assert (average.questions, average.avg_context_tokens) == (2, -(-len(text) // 4))
    none = context.avg_context_tokens(lines, questions.where("repo = 'gone'")).first()
    assert (none.questions, none.avg_context_tokens) == (0, 0.0)

    path = str(tmp_path / "prompts")
    write_prompts(context.context_block(lines), context.prompt_pairs(lines, questions), path)
    written = spark.read.json(f"{path}/context").where("repo = 'app'").orderBy("no").collect()
    asked = {r.id: r.context_suffix for r in spark.read.json(f"{path}/questions").collect()}
    assert "\n".join(r.line for r in written) + asked["app_q2"] == text + "\n\n---\n\nHow?" and sorted(asked) == ["app_q1", "app_q2"]


def test_missing_summary(spark):
    graph = spark.createDataFrame([("r", "a", []), ("r", "b", [])], "repo string, path string, depends_on array<string>")
    known = spark.createDataFrame([("r", "a", "")], "repo string, path string, summary string")
    lines = {r.name: r.line for r in context.context_lines(graph, known).where("section = 8").collect()}
    assert lines == {"a": "a: (no summary)", "b": "b: (no summary)"}


def test_empty_corpus(spark):
    files = spark.createDataFrame([], schemas.FILES)
    assert analyze(files).metrics.count() == 0
