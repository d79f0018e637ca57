"""Arrow functions that are made on first use: their types can't be read before a session is there."""

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f):
        made = functools.cache(lambda: F.pandas_udf(f, kind))

        def call(*columns):
            return made()(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap
