"""A comparison that a front end talks to: a message in, a message out."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from .functions.types import is_numeric, type_name
from .operators.compare import compare
from .plans.result import STATUS_ORDER, ColumnInfo, DiffResult
from .plans.view import Query, ViewEngine


def short_names(left_name: str, right_name: str, left_short: str | None = None, right_short: str | None = None) -> tuple[str, str]:
    """Marks of the sides: the given ones, else first letters, else L and R where a name is empty or both are alike."""
    marks = [given if given is not None else name.strip()[:1].upper() for name, given in ((left_name, left_short), (right_name, right_short))]
    alike = marks[0] == marks[1]
    return tuple(letter if given is None and (alike or not mark) else mark for mark, given, letter in zip(marks, (left_short, right_short), "LR", strict=True))


class DiffSession:
    """Headless session: holds a result, the query and the selection of a front end."""

    def __init__(self, left: Any, right: Any, key, *, left_short: str | None = None, right_short: str | None = None, page_size: int = 10, text_diff: bool = True, **options: Any):
        self._start(compare(left, right, key, **options), left_short, right_short, page_size, text_diff)

    @classmethod
    def from_result(cls, result: DiffResult, *, left_short: str | None = None, right_short: str | None = None, page_size: int = 10, text_diff: bool = True) -> DiffSession:
        self = cls.__new__(cls)
        self._start(result, left_short, right_short, page_size, text_diff)
        return self

    def _start(self, result, left_short, right_short, page_size, text_diff) -> None:
        self.result, self.page_size, self.text_diff = result, page_size, text_diff
        self.left_short, self.right_short = short_names(result.left_name, result.right_name, left_short, right_short)
        self.engine, self.selected_ids, self.query = ViewEngine(result), [], Query()

    @property
    def summary(self) -> dict[str, Any]:
        s, r = self.result.summary, self.result
        only = lambda kind: [c.name for c in r.columns if c.kind == kind]
        counts = {x.value: getattr(s, x.value) for x in STATUS_ORDER}
        more = {n: getattr(s, n) for n in ("total", "found", "left_rows", "right_rows", "duplicate_keys_left", "duplicate_keys_right", "duplicates")}
        return counts | more | {"keys": list(r.keys), "compared": list(r.compared), "left_only_cols": only("left_only"), "right_only_cols": only("right_only"), "ignored": list(r.ignored), "duplicate_rows": r.duplicate_rows}

    @property
    def columns(self) -> list[dict[str, Any]]:
        return [self._column(c) for c in self.result.columns]

    @staticmethod
    def _column(c: ColumnInfo) -> dict[str, Any]:
        return {"name": c.name, "kind": c.kind, "dtype": type_name(c.dtype), "numeric": is_numeric(c.dtype), "ftype": c.filter_type, "mismatches": c.mismatches}

    def selected_frame(self) -> DataFrame:
        """The rows of selected_ids, each once, in the result's order."""
        return self.result.frame(rows=sorted(set(self.selected_ids)))

    def view_frame(self) -> DataFrame:
        """The rows of the last query."""
        return self.engine.frame(self.query)

    def handle_message(self, message: Any) -> dict[str, Any] | None:
        """The answer to a query or an export; errors come back as messages; None for what isn't known."""
        if not isinstance(message, Mapping) or message.get("type") not in ("query", "export"):
            return None
        answer = {"type": "page" if message["type"] == "query" else "export", "req": message.get("req")}
        try:
            query = Query.from_message(message, self.result.columns)
            if message["type"] == "export":
                return answer | {"data": self.engine.export_csv(query)}
            self.query = query
            return answer | self.engine.page(query, message.get("page", 0), message.get("page_size", self.page_size))
        except Exception as error:  # noqa: BLE001 - a front end must get an answer
            return {"type": "error", "req": message.get("req"), "message": f"{type(error).__name__}: {error}"}
