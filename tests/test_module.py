from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from braidgraph.functions import render
from braidgraph.plans.module import EdgeSpec, GraphModule, NodeSpec
from braidgraph.sources.caches import read_files

SOURCE = "\n".join(f"line {i}" for i in range(1, 41))


class Code(GraphModule):
    index_kinds = ("function",)
    priorities = {"function": 0, "module": 1}

    def extract(self):
        yield NodeSpec("mod", "module", "mod", "mod", "src/mod.py", docstring="A module.")
        for i, name in enumerate(("store", "embed", "query")):
            yield NodeSpec(f"fn:{name}", "function", name, f"{name}", "src/mod.py", 10 * i + 1, 10 * i + 3, f"{name} the data", {"n": i})
            yield EdgeSpec("mod", f"fn:{name}", "CONTAINS")
        yield NodeSpec("sym:mod.store", "symbol", "store", "mod.store")
        yield EdgeSpec("fn:query", "sym:mod.store", "CALLS", metadata={"lineno": 22})


@pytest.fixture(scope="module")
def module(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("module")
    (root / "files" / "src").mkdir(parents=True)
    (root / "files" / "src" / "mod.py").write_text(SOURCE)
    m = Code(spark, f"file://{root}/store")
    m.stats_row = m.build(wipe=True).first().asDict()
    m.files = read_files(spark, str(root / "files"))
    return m


def test_build(module):
    assert (module.stats_row["total_nodes"], module.stats_row["function_count"], module.stats_row["total_edges"]) == (5, 3, 5)
    assert module.node("fn:embed").first()["metadata"] == '{"n": 1}'
    assert [r["call_site_lineno"] for r in module.callers("fn:store").collect()] == [22]
    assert module.build().first()["total_nodes"] == 5  # again, without a wipe


def test_query_and_pack(module):
    r = module.query("store_data", k=1, hop=1, mode="hybrid")
    ids = [x["id"] for x in r.nodes.orderBy(F.desc("score")).collect()]
    assert ids[0] == "fn:store" and "mod" in ids and "sym:mod.store" not in ids
    assert json.loads(render.to_json(r.nodes, r.edges, query="q"))["query"] == "q"
    assert "-[CONTAINS]->" in render.summary(r.nodes, r.edges)
    p = module.pack("store", module.files, k=1, hop=1, context=1, max_lines=10)
    text = render.markdown("store", p.nodes, p.edges, 9)
    assert "    1: line 1" in text and "more nodes were left out" in text
    assert any(x["is_summary"] and "# functions (3):" in x["snippet"] for x in p.nodes.collect()) or p.nodes.where("id = 'mod'").count() == 0


def test_rendering_escapes():
    page = render.graph_page("<t>", [{"id": "</script><script>", "kind": "a&b"}], [])
    assert "</script><script>" not in page and "&lt;t&gt;" in page and page.count("<script") == 1
    assert render.tooltip([("a<", 1), ("b", "")]) == "<div><b>a&lt;</b> 1</div>"
    assert render.base_url("http://x/") == "http://x/v1" and render.base_url("http://x/v1") == "http://x/v1"
    assert render.parse_size("10x20") == (10, 20)
    with pytest.raises(ValueError):
        render.parse_size("big")
