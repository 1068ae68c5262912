"""The engine: documents in, DataFrames or JSON out."""

from __future__ import annotations

import logging
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.errors import DocumentError, EngineError, NoPrimaryKey
from nestql.functions.scalars import jsonable
from nestql.mutations import Mutations, read_key, reload_predicate, sorted_like
from nestql.plans.language import parse, value_of
from nestql.plans.planner import EntityQuery, Planner
from nestql.plans.predicate import key_predicate
from nestql.plans.selection import Binder, Selection
from nestql.schema import Schema
from nestql.sources.catalog import pinned

log = logging.getLogger("nestql")


class Engine:
    """``context`` is handed to modifiers, loaders and handlers. ``debug`` logs the plan of each root field.

    A query document sees one version of a catalog that has versions.
    """

    def __init__(self, catalog, schema: Schema, *, context: Any = None, nulls_first: bool = False, root_only: bool = False, epoch_times: bool = False, debug: bool = False):
        self.catalog, self.schema, self.context = catalog, schema, context
        self.nulls_first, self.root_only, self.epoch_times, self.debug = nulls_first, root_only, epoch_times, debug

    def planner(self, catalog=None) -> Planner:
        return Planner(self.catalog if catalog is None else catalog, self.schema.entities, self.context, nulls_first=self.nulls_first, root_only=self.root_only)

    def prepare(self, text: str, variables: dict[str, Any] | None = None, operation: str | None = None) -> tuple[str, list[Selection]]:
        """The operation's kind and its root selections, validated."""
        doc = parse(text)
        op = doc.operation(operation)
        if op.kind == "subscription":
            raise DocumentError("Subscriptions aren't offered")
        owner = "Query" if op.kind == "query" else "Mutation"
        if owner == "Mutation" and not self.schema.mutations:
            raise DocumentError("There are no mutations")
        selections = Binder(doc, op, variables).select(op.selections, owner, self.schema.value_type)
        self.schema.validate(selections, owner)
        return owner, selections

    def root_query(self, s: Selection) -> EntityQuery:
        root, lookup = self.schema.roots[s.name]
        entity, planner = self.schema.entities[root.entity], self.planner()
        if lookup:
            key = s.arguments.get("primaryKey")
            if key is None or key.kind != "object":
                raise NoPrimaryKey(s.location)
            q = EntityQuery(entity, s, key_predicate(entity, read_key(entity, key)))
            q.limit = 1
            return q
        for name, (_, default) in root.extra.items():
            if name not in s.arguments and default is not None:
                s.arguments[name] = value_of(default)
        return planner.query(entity, s)

    def frame(self, s: Selection, by_key: bool = False, catalog=None) -> DataFrame:
        """``by_key``: rows without an order come by their key. ``catalog``: instead of the engine's, as one pinned."""
        q = self.root_query(s)
        if by_key and not q.order:
            q.order = [(c, False) for c in q.entity.primary_key]
        df = self.planner(catalog or pinned(self.catalog)).frame(q)
        if self.debug:
            log.info("%s\n%s", s.key, df._jdf.queryExecution().toString())
        return df

    def dataframe(self, text: str, root: str | None = None, variables: dict[str, Any] | None = None, operation: str | None = None) -> DataFrame:
        """The rows of one root field of a query, not yet run: a column for each response key."""
        owner, selections = self.prepare(text, variables, operation)
        if owner != "Query":
            raise DocumentError("Only queries are DataFrames; mutations are executed")
        chosen = [s for s in selections if root in (None, s.key)]
        if len(chosen) != 1:
            raise DocumentError("Name one of the document's root fields")
        return self.frame(chosen[0])

    def execute(self, text: str, variables: dict[str, Any] | None = None, operation: str | None = None) -> dict[str, Any]:
        """{"data", "errors"} of a document. Root fields run one after the other; mutations commit each by itself."""
        try:
            owner, selections = self.prepare(text, variables, operation)
        except DocumentError as e:
            return {"errors": [_error(e.message, e.location)]}
        data: dict[str, Any] | None = {}
        errors = []
        catalog = None
        for s in selections:
            try:
                if owner == "Query":
                    catalog = catalog or pinned(self.catalog)
                value = self._query(s, catalog) if owner == "Query" else self._mutation(s)
            except (EngineError, PySparkException, Py4JError) as e:
                if not isinstance(e, EngineError):
                    log.warning("%s failed", s.key, exc_info=e)
                errors.append(_error(_said(e), getattr(e, "location", None) or s.location, [s.key]))
                value = None
                root = self.schema.roots.get(s.name)
                batch = self.schema.mutations.get(s.name, (None, ""))[1] == "batch"
                if (owner == "Query" and root is not None and not root[1]) or (owner == "Mutation" and batch):
                    data = None  # a list can't be null, so its parent is
            if data is not None:
                data[s.key] = value
        return {"data": data} | ({"errors": errors} if errors else {})

    def _rows(self, df: DataFrame) -> list[dict[str, Any]]:
        return [jsonable(r.asDict(recursive=True), self.epoch_times) for r in df.collect()]

    def _query(self, s: Selection, catalog) -> Any:
        if s.name == "__typename":
            return "Query"
        if s.name in ("__schema", "__type"):
            return self.schema.introspect(s)
        rows = self._rows(self.frame(s, by_key=True, catalog=catalog))
        return (rows[0] if rows else None) if self.schema.roots[s.name][1] else rows

    def _mutation(self, s: Selection) -> Any:
        if s.name == "__typename":
            return "Mutation"
        kind, result = Mutations(self).run(s)
        if kind == "count":
            return {c.key: "DeletedCount" if c.name == "__typename" else result for c in s.children}
        entity, keys, many = result
        hidden = [f"nql_key{i}" for i in range(len(entity.primary_key))]
        fields = [Selection(entity.by_source(c).name, h, {}) for c, h in zip(entity.primary_key, hidden, strict=True)]
        plain = Selection(s.name, s.key, {}, list(s.children), s.location)
        planned = self.planner(pinned(self.catalog)).plan(EntityQuery(entity, plain, reload_predicate(entity, keys)), entity.primary_key, root=True)
        df = planned.frame.select(*planned.values, *[F.col(planned.kept[c]).alias(h) for c, h in zip(entity.primary_key, [f.key for f in fields], strict=True)])
        rows = sorted_like([r.asDict(recursive=True) for r in df.collect()], keys, hidden)
        rows = [jsonable({k: v for k, v in r.items() if k not in hidden}, self.epoch_times) for r in rows]
        return rows if many else (rows[0] if rows else None)


def _said(e: Exception) -> str:
    """The message of an error of the engine or of a table; of the latter its first line."""
    text = e.message if isinstance(e, EngineError) else (e.getMessage() if isinstance(e, PySparkException) else "") or str(e)
    return text if isinstance(e, EngineError) else text.strip().split("\n")[0]


def _error(message: str, location: tuple[int, int] | None, path: list[str] | None = None) -> dict[str, Any]:
    out: dict[str, Any] = {"message": message}
    if location:
        out["locations"] = [{"line": location[0], "column": location[1]}]
    return out | ({"path": path} if path else {})
