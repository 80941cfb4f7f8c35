"""Column names with dots or backticks, as CSV headers often have them."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from ..config import P

PLAIN = P + "plain_"


def any_names(*params: str) -> Callable:
    """Let an operator take columns of any name.

    Its first argument is a frame and ``params`` are those that name columns (a name or a
    list). Awkward columns are renamed before the operator sees them and named back in its
    result; a frame without such columns passes untouched.
    """

    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def inner(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            first = next(iter(bound.arguments))
            df = bound.arguments[first]
            plain = {c: f"{PLAIN}{i}_" for i, c in enumerate(df.columns) if "." in c or "`" in c}
            if not plain:
                return operator(*args, **kwargs)
            bound.arguments[first] = df.toDF(*[plain.get(c, c) for c in df.columns])
            for p in params:
                value = bound.arguments.get(p)
                if isinstance(value, str):
                    bound.arguments[p] = plain.get(value, value)
                elif isinstance(value, (list, tuple)):
                    bound.arguments[p] = [plain.get(v, v) for v in value]
            out = operator(*bound.args, **bound.kwargs)
            return out.toDF(*[_given(c, plain) for c in out.columns])

        return inner

    return wrap


def _given(column: str, plain: dict[str, str]) -> str:
    """The given name again, also where it begins a name made from it."""
    for name, short in plain.items():
        if column.startswith(short):
            return name + column[len(short):]
    return column
