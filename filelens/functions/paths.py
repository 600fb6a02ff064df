"""Path expressions: name, extension, lexical normalisation, URL names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_uri(path) -> Column:
    """``file:/a/b`` or ``file:///a/b`` -> ``/a/b`` (binaryFile gives URIs)."""
    return F.regexp_replace(_c(path), r"^file:(//)?", "")


def file_name(path) -> Column:
    """Last path component (a trailing slash gives '')."""
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(name) -> Column:
    """From the last dot, dot included; '' when there is no dot or the only
    dot leads the name ('.bashrc'); '.' for a trailing dot; case kept."""
    return F.regexp_extract(_c(name), r"^.+(\.[^.]*)$", 1)


def normalize_path(path) -> Column:
    """Lexical normalisation of an absolute or relative path string:
    collapse repeated '/', drop '.' components, resolve 'x/..' pairs.

    Expressed with ``split`` + ``aggregate`` so it stays one JVM expression.
    A leading '..' that cannot be resolved is kept, and '/..' at the root
    stays at the root, as POSIX lexical normalisation does.
    """
    p = _c(path)
    absolute = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(acc, s):
        can_pop = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (F.when(s != "..", F.concat(acc, F.array(s)))
                .when(can_pop, popped)
                .when(absolute, acc)
                .otherwise(F.concat(acc, F.array(s))))

    stack = F.aggregate(parts, empty, step)
    body = F.array_join(stack, "/")
    return (F.when(p.isNull(), F.lit(None))
            .when(absolute, F.concat(F.lit("/"), body))
            .when(body == "", F.lit("."))
            .otherwise(body))


def url_path_name(url) -> Column:
    """Name of the last path component of a URL, query and fragment dropped."""
    return F.element_at(F.split(F.regexp_replace(_c(url), r"[?#].*$", ""), "/"), -1)
