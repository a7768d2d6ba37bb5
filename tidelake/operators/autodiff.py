"""Derivatives of what a task computes in numpy: each operation notes how a change of its result changes its inputs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Node:
    def __init__(self, value: np.ndarray, made_from: tuple[tuple[Node, Callable[[np.ndarray], np.ndarray]], ...] = ()):
        self.value, self.made_from, self.grad = np.asarray(value, np.float64), made_from, None

    def __add__(self, other):
        other = node(other)
        return Node(self.value + other.value, ((self, lambda g: _fitted(g, self)), (other, lambda g: _fitted(g, other))))

    def __sub__(self, other):
        return self + node(other) * -1.0

    def __mul__(self, other):
        other = node(other)
        return Node(self.value * other.value, ((self, lambda g: _fitted(g * other.value, self)), (other, lambda g: _fitted(g * self.value, other))))

    def __matmul__(self, other):
        return Node(self.value @ other.value, ((self, lambda g: g @ other.value.T), (other, lambda g: self.value.T @ g)))

    def cols(self, a: int, b: int) -> Node:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            out[:, a:b] = g
            return out

        return Node(self.value[:, a:b], ((self, back),))

    def rows(self, at: np.ndarray) -> Node:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return out

        return Node(self.value[at], ((self, back),))

    def sum(self) -> Node:
        return Node(self.value.sum(), ((self, lambda g: np.full(self.value.shape, g)),))

    def _mapped(self, value: np.ndarray, slope: np.ndarray) -> Node:
        return Node(value, ((self, lambda g: g * slope),))

    def sigmoid(self) -> Node:
        y = 0.5 * (1 + np.tanh(self.value / 2))
        return self._mapped(y, y * (1 - y))

    def tanh(self) -> Node:
        y = np.tanh(self.value)
        return self._mapped(y, 1 - y * y)

    def exp(self) -> Node:
        y = np.exp(self.value)
        return self._mapped(y, y)

    def log(self) -> Node:
        return self._mapped(np.log(self.value), 1 / self.value)

    def softplus(self) -> Node:
        return self._mapped(np.logaddexp(0, self.value), 0.5 * (1 + np.tanh(self.value / 2)))


def node(x: Node | np.ndarray | float) -> Node:
    return x if isinstance(x, Node) else Node(x)


def _fitted(g: np.ndarray, to: Node) -> np.ndarray:
    """A gradient summed over what was broadcast."""
    while g.ndim > to.value.ndim:
        g = g.sum(0)
    for axis, n in enumerate(to.value.shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def gradients(result: Node, of: dict[str, Node]) -> dict[str, np.ndarray]:
    """Derivatives of a number by each named node."""
    order, seen, stack = [], set(), [(result, False)]
    while stack:
        at, done = stack.pop()
        if done:
            order.append(at)
        elif id(at) not in seen:
            seen.add(id(at))
            stack.append((at, True))
            stack += [(x, False) for x, _ in at.made_from]
    for at in order:
        at.grad = None
    result.grad = np.ones_like(result.value)
    for at in reversed(order):
        for x, back in at.made_from:
            g = back(at.grad)
            x.grad = g if x.grad is None else x.grad + g
    return {k: np.zeros_like(x.value) if x.grad is None else x.grad for k, x in of.items()}
