"""Built-in tools as pure column expressions, and a registry for more of the kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class ToolRegistry:
    """Named builders of deterministic columns; a name is registered once."""

    def __init__(self) -> None:
        self._tools: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, build: Callable[..., Column]) -> Callable[..., Column]:
        if not name.strip() or name in self._tools:
            raise ValueError(f"tool name {name!r} is blank or taken")
        self._tools[name] = build
        return build

    def names(self) -> list[str]:
        return sorted(self._tools)

    def result(self, tool: Column, *args: Column) -> Column:
        """The result of the tool that each row names; null for unknown tools."""
        out = F.lit(None).cast("double")
        for name in self.names():
            out = F.when(tool == name, self._tools[name](*args)).otherwise(out)
        return out


def arithmetic() -> ToolRegistry:
    """add, subtract, multiply, divide; a division by zero has no result (its call fails)."""
    tools = ToolRegistry()
    tools.register("add", lambda a, b: a + b)
    tools.register("subtract", lambda a, b: a - b)
    tools.register("multiply", lambda a, b: a * b)
    tools.register("divide", F.try_divide)
    return tools
