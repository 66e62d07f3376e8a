"""The session's relations: tables and views by name, with kinds, providers, texts and dependencies."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import AnalysisError

VIEW_KINDS = ("plain", "dimension", "cube")


@dataclass
class Relation:
    """kind: table, view, dimension or cube. A view keeps its statement text and is analysed at each use."""

    name: str
    kind: str = "table"
    is_temporary: bool = True
    provider: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    sql: str | None = None
    uses: frozenset[str] = frozenset()
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def is_view(self) -> bool:
        return self.kind != "table"


class Registry:
    def __init__(self, case_sensitive: bool = False):
        self.case_sensitive = case_sensitive
        self._by_name: dict[str, Relation] = {}

    def fold(self, name: str) -> str:
        """The name as it is looked up; databases are no part of it."""
        name = name.rpartition(".")[2]
        return name if self.case_sensitive else name.lower()

    def __contains__(self, name: str) -> bool:
        return self.fold(name) in self._by_name

    def get(self, name: str) -> Relation | None:
        return self._by_name.get(self.fold(name))

    def all(self) -> list[Relation]:
        return [self._by_name[k] for k in sorted(self._by_name)]

    def add(self, r: Relation, replace: bool = False) -> None:
        if not replace and r.name in self:
            raise AnalysisError(f"relation {r.name} exists")
        if self.fold(r.name) in {self.fold(u) for u in r.uses}:
            raise AnalysisError(f"view {r.name} uses itself")
        self._by_name[self.fold(r.name)] = r

    def remove(self, name: str) -> None:
        self._by_name.pop(self.fold(name), None)

    def dependents(self, name: str) -> list[Relation]:
        """Views that use the relation, directly or through others, nearest first."""
        out: list[Relation] = []
        todo = [self.fold(name)]
        while todo:
            at = todo.pop(0)
            for r in self.all():
                if at in {self.fold(u) for u in r.uses} and r not in out:
                    out.append(r)
                    todo.append(self.fold(r.name))
        return out

    def dependencies(self) -> list[tuple[str, str, str, str]]:
        """(base, base kind or UNKNOWN, dependent, dependent kind)."""
        label = lambda r: "TABLE" if r.kind == "table" else "VIEW" if r.kind == "view" else r.kind.upper()
        return [(self.get(u).name if self.get(u) else u, label(self.get(u)) if self.get(u) else "UNKNOWN", r.name, label(r)) for r in self.all() for u in sorted(r.uses)]
