"""Results for notebooks: trees of result rows as nested dicts or an HTML list, and a command that shows a statement's
result as a table or a tree. For results small enough to show."""

from __future__ import annotations

from html import escape
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from .errors import AnalysisError

if TYPE_CHECKING:
    from .session import AnalyticsSession


def tree(df: DataFrame, key: str, parent: str, label: str, most: int = 10_000) -> list[dict]:
    """Nested dicts (id, name, children) from rows of an adjacency list; more than ``most`` rows raise."""
    rows = df.select(key, parent, label).limit(most + 1).collect()
    if len(rows) > most:
        raise AnalysisError(f"a tree view shows at most {most} rows")
    nodes = {r[0]: {"id": r[0], "name": r[2], "children": []} for r in rows}
    roots = []
    for r in rows:
        (nodes[r[1]]["children"] if r[1] in nodes and r[1] != r[0] else roots).append(nodes[r[0]])
    return roots


def html(nodes: list[dict]) -> str:
    return "<ul>" + "".join(f"<li>{escape(str(n['name']))}{html(n['children']) if n['children'] else ''}</li>" for n in nodes) + "</ul>"


def table(df: DataFrame, most: int) -> str:
    """An HTML table of the first ``most`` rows, with a note where there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda tag, v: f"<{tag}>{'' if v is None else escape(str(v))}</{tag}>"
    line = lambda tag, values: f"<tr>{''.join(cell(tag, v) for v in values)}</tr>"
    body = "".join(line("td", r) for r in rows[:most])
    return f"<table>{line('th', df.columns)}{body}</table>" + (f"<p>first {most} rows</p>" if len(rows) > most else "")


def interpret(session: AnalyticsSession, text: str, most: int = 1000) -> str:
    """What a notebook paragraph shows: ``treeview ID PRED NAME query`` as a tree, any other statement as a table."""
    words = text.split(None, 4)
    if not words or words[0].lower() != "treeview":
        return table(session.sql(text), most)
    if len(words) < 5:
        raise AnalysisError("treeview takes an id column, a parent column, a name column and a query")
    key, parent, label, query = words[1:]
    if key.lower() == parent.lower():
        raise AnalysisError("id and parent column must differ")
    return html(tree(session.sql(query), key, parent, label, most))
