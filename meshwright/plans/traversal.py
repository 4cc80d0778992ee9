"""The fluent builder: it records the same steps that the parser makes."""

from __future__ import annotations

from meshwright.plans.parser import Step


class Traversal:
    def __init__(self, graph, steps: tuple[Step, ...]) -> None:
        self._graph, self._steps = graph, steps

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        name = name.rstrip("_")

        def step(*args) -> Traversal:
            return Traversal(self._graph, (*self._steps, Step(name, tuple(a._steps if isinstance(a, Traversal) else a for a in args))))

        return step

    def result(self):
        from meshwright.plans.compiler import compile_steps

        return compile_steps(self._graph, self._steps)

    @property
    def df(self):
        return self.result().df


class Anonymous:
    """``__``: where a sub-traversal begins."""

    def __getattr__(self, name: str):
        return getattr(Traversal(None, ()), name)


anonymous = Anonymous()
