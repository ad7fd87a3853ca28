"""Text of results: headers, hits, trees, dependencies, bundles, changes and reports. Inputs are results of bounded size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.text import truncate_bytes
from loamline.operators.diff import marker

MOST_ROWS = 1000


def rows_of(frame: DataFrame, limit: int = MOST_ROWS) -> list[dict]:
    return [r.asDict() for r in frame.limit(limit).collect()]


def tokens(content: str) -> int:
    return -(-len(content.encode()) // 4)


def token_label(n: int) -> str:
    return f"~{n}" if n < 1000 else f"~{n / 1000:.1f}k" if n < 999_950 else f"~{n / 1e6:.1f}M"


def size_label(n: int) -> str:
    return f"{n}B" if n < 1024 else f"{n / 1024:.1f}KB" if n < 1 << 20 else f"{n / (1 << 20):.1f}MB"


def file_header(path: str, lines: int, n_tokens: int, mode: str) -> str:
    return f"# {path} ({lines} lines, {token_label(n_tokens)} tokens) [{mode}]"


def binary_header(path: str, size: int, mime: str) -> str:
    return f"# {path} (binary, {size_label(size)}, {mime})"


def search_header(q: str, scope: str, shown: int, total: int) -> str:
    return f'# "{q}" in {scope or "."}: {shown}/{total} shown' if total else f'# "{q}" in {scope or "."}: nothing found'


def numbered(lines: Iterable[tuple[int, str]]) -> str:
    """Lines with right-aligned numbers and a mark where some are left out."""
    own = list(lines)
    wide, out, last = len(str(max((n for n, _ in own), default=0))), [], None
    for n, line in own:
        if last is not None and n > last + 1:
            out.append(" " * wide + " ...")
        out.append(f"{n:>{wide}} {line}")
        last = n
    return "\n".join(out)


def hits(q: str, frame: DataFrame, scope: str = "") -> str:
    """Ranked hits by file in rank order."""
    own = rows_of(frame)
    total = own[0].get("total_found", len(own)) if own else 0
    out, by = [search_header(q, scope, len(own), total)], {}
    for r in own:
        by.setdefault(r["path"], []).append(r)
    for path, rows in by.items():
        out.append(f"\n## {path}")
        out += [f"{'def' if r.get('is_definition') else 'use'} {r['line']}: {truncate_bytes((r['text'] or '').strip(), 200)}" for r in rows]
    if total > len(own):
        out.append(f"\n... {total - len(own)} more")
    body = "\n".join(out)
    return f"{body}\n({token_label(tokens(body))} tokens)"


def tree(paths: Iterable[tuple[str, int]]) -> str:
    """Paths and their tokens as an indented tree; folders come with sums."""
    root: dict = {}
    for path, n in paths:
        node, parts = root, path.split("/")
        for part in parts[:-1]:
            node = node.setdefault(part + "/", {})
        node[parts[-1]] = n

    def total(node) -> int:
        return node if isinstance(node, int) else sum(map(total, node.values()))

    def show(node: dict, pad: str) -> list[str]:
        out = []
        for name in sorted(node, key=lambda k: (not k.endswith("/"), k)):
            out.append(f"{pad}{name} ({token_label(total(node[name]))})")
            if isinstance(node[name], dict):
                out += show(node[name], pad + "  ")
        return out

    return "\n".join(show(root, ""))


def dependencies(path: str, deps: dict[str, DataFrame]) -> str:
    """What a file uses and what uses it."""
    part = lambda title, lines: [f"\n## {title}", *(lines or ["none"])]
    out = [f"# {path}"]
    out += part("uses", [f"{r['target_path']}: {', '.join(r['names'])}".rstrip(": ") for r in rows_of(deps["local"])])
    out += part("external", [r["source"] for r in rows_of(deps["external"])])
    out += part("exports", [r["name"] for r in rows_of(deps["exports"])])
    used = rows_of(deps["dependents"])
    out += part("used by", [f"{r['path']}: {', '.join(r['names'])}".rstrip(": ") for r in used])
    if used and used[0]["total"] > len(used):
        out.append(f"... {used[0]['total'] - len(used)} more")
    return "\n".join(out)


def bundle(own: dict) -> str:
    """A definition with its surroundings, as ``Engine.grok`` gives it."""
    d = own["definition"]
    out = [f"# {d['kind']} {d['name']} ({d['path']}:{d['start_line']}-{d['end_line']})", "", *own["body"], "", f"calls ({own['callees_total']}):"]
    out += [f"  {c['callee']} -> {c['target_path'] or 'external'}" for c in own["callees"]]
    out += [f"called by ({own['callers_total']}):", *(f"  {c['path']}:{c['line']} {c['caller'] or ''}".rstrip() for c in own["callers"])]
    out += [f"tests ({len(own['tests'])}):", *(f"  {c['path']}:{c['line']}" for c in own["tests"]), f"siblings: {', '.join(s['name'] for s in own['siblings']) or 'none'}"]
    return "\n".join(out)


def changes(frame: DataFrame) -> str:
    """Changed symbols by file with their marks, and counts of each kind of change."""
    own = rows_of(frame.where("change <> 'unchanged'").withColumn("mark", marker(F.col("change"))).orderBy("path", "line", "name"))
    out, last = [], None
    for r in own:
        if r["path"] != last:
            out.append(f"## {r['path']}")
            last = r["path"]
        was = f" (was {r['old_name']})" if r["old_name"] else ""
        sure = "" if r["confidence"] == "exact" else f" [{r['confidence']}{f' {r['score']:.2f}' if r['score'] is not None else ''}]"
        out.append(f"{r['mark']} {r['kind']} {r['name']}{was}{sure}")
    kinds: dict = {}
    for r in own:
        kinds[r["change"]] = kinds.get(r["change"], 0) + 1
    out.append(", ".join(f"{n} {k}" for k, n in sorted(kinds.items())) or "no changes")
    return "\n".join(out)


def table(frame: DataFrame) -> str:
    """A result as a Markdown table."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = ["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(out + ["| " + " | ".join(show(r[c]) for c in frame.columns) + " |" for r in rows_of(frame)])


def report(runs: DataFrame, baseline: str = "baseline") -> str:
    """Markdown report of run records: accuracy, cost, failures and flags by mode."""
    from loamline.operators import runs as own

    parts = [
        ("Accuracy", own.accuracy(runs, "mode").orderBy("mode")), ("Cost per correct run", own.cost_per_correct(runs, "mode").orderBy("mode")), ("Power", own.power_readout(runs).orderBy("mode")),
        ("Failures", own.failure_table(runs).orderBy("kind", "detail", "mode")), ("Flags", own.flag_counts(own.flags(runs)).orderBy("flag", "mode")),
    ]
    return "\n\n".join(["# Runs", *(f"## {title}\n\n{table(frame)}" for title, frame in parts)])
