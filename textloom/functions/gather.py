"""Arrow arrays put together from Python values, of which few are held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa

#: Characters, or what stands for them, that are held as Python values.
MOST = 1 << 20


def gathered(values: Iterable[Any], kind: pa.DataType, size: Callable[[Any], int]) -> pa.Array:
    """pa.array(values, kind); size: characters of a value, as a measure of what it takes."""
    parts, held, n = [], [], 0
    for v in values:
        held.append(v)
        n += 100 + size(v)
        if n >= MOST:
            parts.append(pa.array(held, kind))
            held, n = [], 0
    return pa.concat_arrays([*parts, pa.array(held, kind)])
