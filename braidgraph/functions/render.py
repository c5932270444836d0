"""Driver-side rendering of results that are bounded by a limit."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_json(nodes: DataFrame, edges: DataFrame, **extra) -> str:
    rows = lambda d: [r.asDict(recursive=True) for r in d.collect()]
    return json.dumps({**extra, "nodes": rows(nodes), "edges": rows(edges)}, ensure_ascii=False, default=str)


def summary(nodes: DataFrame, edges: DataFrame) -> str:
    """Nodes by score, then edges by relation, source and target."""
    out = [f"{r['score']:.3f}  {r['kind']}  {r['id']}" for r in nodes.orderBy(F.desc("score"), "id").collect()]
    out += [f"{r['src']} -[{r['rel']}]-> {r['dst']}" for r in edges.orderBy("rel", "src", "dst").collect()]
    return "\n".join(out)


def markdown(query: str, packed: DataFrame, edges: DataFrame, total: int | None = None) -> str:
    """A report: for each node its tier, first line of documentation and snippet."""
    tier = lambda s: "HIGH" if s >= 0.60 else "MEDIUM" if s >= 0.45 else "LOW"
    out = [f"# {query}", ""]
    rows = packed.orderBy(F.desc("score"), "id").collect()
    for r in rows:
        doc = ((r["docstring"] or "").strip().splitlines() or [""])[0][:140]
        out += [f"## {r['qualname'] or r['name']} ({r['kind']}, {tier(r['score'])} {r['score']:.3f})", *([doc] if doc else [])]
        if r["snippet"]:
            out += [f"`{r['path']}`", "```", r["snippet"], "```"]
        out.append("")
    out += ["## Relations", *(f"- {e['src']} {e['rel']} {e['dst']}" for e in edges.orderBy("rel", "src", "dst").collect())]
    if total is not None and total > len(rows):
        out.append(f"\n{total - len(rows)} more nodes were left out.")
    return "\n".join(out) + "\n"


def graph_page(title: str, nodes: Sequence[dict], edges: Sequence[dict]) -> str:
    """A page of its own: the graph as embedded data that no script end can break out of."""
    data = json.dumps({"nodes": list(nodes), "edges": list(edges)}, ensure_ascii=False, default=str)
    data = data.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    items = "".join(f"<li>{html.escape(str(n.get('kind')))} <b>{html.escape(str(n.get('name') or n.get('id')))}</b></li>" for n in nodes)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{items}</ul><script type="application/json" id="graph">{data}</script></body></html>'


def tooltip(rows: Sequence[tuple[str, object]]) -> str:
    """Label and value pairs as escaped HTML; empty values are left out."""
    return "".join(f"<div><b>{html.escape(k)}</b> {html.escape(str(v))}</div>" for k, v in rows if v not in (None, ""))


def style(kind: Column, styles: dict[str, str], default: str) -> Column:
    """The style of a kind, with a fallback."""
    if not styles:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in styles.items() for x in kv)), kind), F.lit(default))


def base_url(url: str) -> str:
    """An endpoint with its ``/v1``."""
    url = url.rstrip("/")
    return url if url.endswith("/v1") else f"{url}/v1"


def parse_size(size: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)\s*[xX]\s*(\d+)\s*", size)
    if not m:
        raise ValueError(f"{size!r} is no size")
    return int(m[1]), int(m[2])
