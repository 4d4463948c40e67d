"""${name} parameters in SQL text and paths."""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..errors import SpecError

_NAME = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def _value(name: str, values: Mapping[str, object]) -> object:
    if name not in values:
        raise SpecError(f"parameter ${{{name}}} is not defined")
    return values[name]


def in_sql(text: str, values: Mapping[str, object]) -> str:
    """Strings become quoted literals, everything else its text."""

    def put(m: re.Match) -> str:
        v = _value(m[1], values)
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return _NAME.sub(put, text)


def in_path(text: str, values: Mapping[str, object]) -> str:
    return _NAME.sub(lambda m: str(_value(m[1], values)), text)
