"""Python, by the standard library's parser; files it rejects have no rows but their names."""

from __future__ import annotations

import ast
import re

from lodestone.extract.registry import call, imported, own_exports, register, symbol


def _public(name: str) -> bool:
    return not name.startswith("_")


def _start(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _doc(node: ast.AST) -> str:
    marks = "\n".join(f"@{ast.unparse(d)}" for d in node.decorator_list)
    return "\n".join(x for x in (marks, ast.get_docstring(node) or "") if x)


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + f"({ast.unparse(node.args)}){returns}"


def _calls(node: ast.AST, parent: str | None, out: list[dict]) -> None:
    for child in ast.iter_child_nodes(node):
        inner = child.name if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else parent
        if isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
            out.append(call(ast.unparse(child.func), child.lineno, parent))
        _calls(child, inner, out)


@register("python")
def extract_python(text: str) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return {"refs": sorted(set(re.findall(r"[^\W\d]\w*", text)))}
    symbols, imports, calls = [], [], []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append(symbol(node.name, "function", _start(node), node.end_lineno, _public(node.name), _signature(node), _doc(node)))
        elif isinstance(node, ast.ClassDef):
            symbols.append(symbol(node.name, "class", _start(node), node.end_lineno, _public(node.name), None, _doc(node)))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name):
                symbols.append(symbol(target.id, "variable", node.lineno, node.end_lineno, _public(target.id)))
        elif isinstance(node, ast.Import):
            imports += [imported(a.asname or a.name, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [imported(a.asname or a.name, "." * node.level + (node.module or "")) for a in node.names]
    _calls(tree, None, calls)
    refs = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} | {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    return {"symbols": symbols, "imports": imports, "exports": own_exports(symbols), "calls": calls, "refs": sorted(refs)}
