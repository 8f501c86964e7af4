"""Reverse-mode derivatives of NumPy expressions.

A ``Tensor`` takes part in ordinary NumPy expressions (operators, ``np.tanh``, ``np.stack``,
...) and remembers how its value was made; ``derivatives`` walks back from a scalar. Code
written for arrays so serves for training as it stands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from numpy.lib.mixins import NDArrayOperatorsMixin

Back = Callable[[np.ndarray], np.ndarray]


def _swap(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


#: ufunc -> per argument the factor's rule: (gradient, result, *arguments) -> gradient
RULES: dict[np.ufunc, tuple[Callable[..., np.ndarray], ...]] = {
    np.add: (lambda g, y, a, b: g, lambda g, y, a, b: g),
    np.subtract: (lambda g, y, a, b: g, lambda g, y, a, b: -g),
    np.multiply: (lambda g, y, a, b: g * b, lambda g, y, a, b: g * a),
    np.divide: (lambda g, y, a, b: g / b, lambda g, y, a, b: -g * y / b),
    np.matmul: (lambda g, y, a, b: g @ _swap(b), lambda g, y, a, b: _swap(a) @ g),
    np.negative: (lambda g, y, a: -g,),
    np.tanh: (lambda g, y, a: g * (1 - y * y),),
    np.exp: (lambda g, y, a: g * y,),
    np.sqrt: (lambda g, y, a: g * 0.5 / np.maximum(y, 1e-12),),
    np.square: (lambda g, y, a: 2 * g * a,),
    np.absolute: (lambda g, y, a: g * np.sign(a),),
    np.logaddexp: (lambda g, y, a, b: g * np.exp(a - y), lambda g, y, a, b: g * np.exp(b - y)),
}
FUNCTIONS: dict[Callable, Callable] = {}


def value_of(x: Tensor | np.ndarray | float) -> np.ndarray:
    return x.value if isinstance(x, Tensor) else np.asarray(x, np.float64)


def _shaped(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums away what broadcasting added."""
    if g.ndim > len(shape):
        g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    stretched = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axis=stretched, keepdims=True) if stretched else g


class Tensor(NDArrayOperatorsMixin):
    def __init__(self, value: np.ndarray | float, back: tuple[tuple[Tensor, Back], ...] = ()):
        self.value, self.back = np.asarray(value, np.float64), back

    shape = property(lambda self: self.value.shape)
    ndim = property(lambda self: self.value.ndim)
    T = property(lambda self: Tensor(self.value.T, ((self, lambda g: g.T),)))

    def __len__(self) -> int:
        return len(self.value)

    def __array_ufunc__(self, ufunc: np.ufunc, method: str, *inputs, **options):
        if method != "__call__" or options or ufunc not in RULES:
            return NotImplemented
        values = [value_of(x) for x in inputs]
        out = ufunc(*values)
        back = [(x, lambda g, rule=rule, v=v: _shaped(rule(g, out, *values), v.shape)) for x, v, rule in zip(inputs, values, RULES[ufunc], strict=True) if isinstance(x, Tensor)]
        return Tensor(out, tuple(back))

    def __array_function__(self, function: Callable, types, args, options):
        return FUNCTIONS[function](*args, **options) if function in FUNCTIONS else NotImplemented

    def __getitem__(self, key) -> Tensor:
        def back(g: np.ndarray) -> np.ndarray:
            whole = np.zeros(self.shape)
            np.add.at(whole, key, g) if isinstance(key, np.ndarray) else whole.__setitem__(key, g)
            return whole

        return Tensor(self.value[key], ((self, back),))

    def reshape(self, *shape: int) -> Tensor:
        return Tensor(self.value.reshape(*shape), ((self, lambda g: g.reshape(self.shape)),))

    def sum(self, axis: int | tuple[int, ...] | None = None, keepdims: bool = False) -> Tensor:
        def back(g: np.ndarray) -> np.ndarray:
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Tensor(self.value.sum(axis=axis, keepdims=keepdims), ((self, back),))

    def mean(self, axis: int | tuple[int, ...] | None = None, keepdims: bool = False) -> Tensor:
        total = self.sum(axis, keepdims)
        return total * (total.value.size / max(self.value.size, 1))


def _stack(parts: list, axis: int = 0) -> Tensor:
    back = [(x, lambda g, i=i: np.take(g, i, axis)) for i, x in enumerate(parts) if isinstance(x, Tensor)]
    return Tensor(np.stack([value_of(x) for x in parts], axis), tuple(back))


def _concatenate(parts: list, axis: int = 0) -> Tensor:
    values = [value_of(x) for x in parts]
    cuts = np.cumsum([v.shape[axis] for v in values])[:-1]
    back = [(x, lambda g, i=i: np.split(g, cuts, axis)[i]) for i, x in enumerate(parts) if isinstance(x, Tensor)]
    return Tensor(np.concatenate(values, axis), tuple(back))


FUNCTIONS |= {np.stack: _stack, np.concatenate: _concatenate}


def derivatives(loss: Tensor) -> dict[int, np.ndarray]:
    """Of a scalar by every tensor it was made from, by the tensor's ``id``."""
    order: list[Tensor] = []
    seen: set[int] = set()
    stack: list[tuple[Tensor, bool]] = [(loss, False)]
    while stack:
        node, ready = stack.pop()
        if ready:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack += [(x, False) for x, _ in node.back]
    found = {id(loss): np.ones(loss.shape)}
    for node in reversed(order):
        for x, back in node.back:
            g = back(found[id(node)])
            found[id(x)] = found[id(x)] + g if id(x) in found else g
    return found
