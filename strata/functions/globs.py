"""One glob compiler for every dialect, producing Column predicates (L1).

Patterns are configuration, so they compile once on the driver. A glob whose
only wildcard is a trailing ``/**`` becomes an equality or prefix test, which
stays cheap inside whole-stage codegen; anything else becomes a literal regex.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\.+*?()|[]{}^$")


def quote(text: str) -> str:
    """Escape regex metacharacters the same way for Java and RE2."""
    return "".join("\\" + c if c in _META else c for c in text)


def _stars(glob: str) -> str:
    """Body of the ``**``-aware dialect: ``/**``, ``**`` and ``*`` only."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("/**", i):
            out.append("(/.*)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append(quote(glob[i]))
            i += 1
    return "".join(out)


def segment_regex(glob: str) -> str | None:
    """Shell-style match of one whole path: ``*``, ``?`` and classes stop at ``/``.

    A malformed pattern yields None and matches nothing.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] == "^" else i + 1)
            if end <= i + 1:
                return None
            out.append(glob[i : end + 1])
            i = end
        elif c == "\\":
            if i + 1 >= len(glob):
                return None
            i += 1
            out.append(quote(glob[i]))
        else:
            out.append(quote(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_regex(glob: str, dialect: str = "layer") -> str:
    """Compile a glob to an anchored regex.

    Dialects: ``layer`` (prefix when there is no wildcard), ``import``
    (always anchored), ``exclude`` (trailing slash covers a subtree),
    ``suffix`` (may start after any slash), ``diagram`` (loose prefix or
    inner directory), ``expect`` (``**`` means prefix plus suffix).
    """
    if dialect == "layer":
        if "**" in glob:
            return "^" + _stars(glob) + "$"
        if "*" in glob:
            return segment_regex(glob) or r"^\b$"
        return "^" + quote(glob)
    if dialect == "import":
        return "^" + _stars(glob) + "$"
    if dialect == "exclude":
        body = _stars(glob)
        if glob.endswith("/"):
            body = body[:-1] + "(/.*)?"
        return "^" + body + "$"
    if dialect == "suffix":
        return "(^|/)" + _stars(glob) + "$"
    if dialect == "diagram":
        head = quote(glob[:-3] if glob.endswith("/**") else glob)
        return f"(^{head}|/{head}/)"
    if dialect == "expect":
        if "**" in glob:
            head, _, tail = glob.partition("**")
            return "^" + quote(head) + ".*" + quote(tail) + "$"
        return segment_regex(glob) or r"^\b$"
    raise ValueError(f"unknown glob dialect {dialect!r}")


def compile_glob(glob: str, dialect: str = "layer") -> tuple[str, str, str, str]:
    """A glob as data: (kind, head, anchor, regex), for patterns that come from tables.

    ``anchor`` is the literal directory every matching path equals or lies below ('' for
    any), so that patterns are found by an equality join on a path's directories. Kinds:
    ``subtree`` (the anchor decides alone), ``prefix`` and ``exact`` (compare with
    ``head``), ``regex``, ``never`` (malformed). Dialects ``layer``, ``exclude`` and
    ``ignore`` (which also holds for everything below what it names).
    """
    if dialect == "ignore":
        return _compile_ignore(glob)
    if glob.endswith("/**") and not set("*?[\\") & set(glob[:-3]):
        return "subtree", glob[:-3], glob[:-3], ""
    if "*" not in glob:
        if dialect == "layer":
            return "prefix", glob, _folder(glob), ""
        if glob.endswith("/"):
            return "subtree", glob[:-1], glob[:-1], ""
        return "exact", glob, glob, ""
    if dialect == "layer" and "**" not in glob:
        rx = segment_regex(glob)
    else:
        rx = glob_regex(glob, dialect)
    return ("never", "", "", "") if rx is None else ("regex", "", _anchor(glob), rx)


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def _anchor(glob: str) -> str:
    """Literal directories before the first wildcard."""
    first = min(glob.find(c) for c in "*?[\\" if c in glob)
    if glob.startswith("/**", first - 1):
        whole = glob[first + 2 : first + 3] in ("", "/")
        return glob[: first - 1] if whole else _folder(glob[: first - 1])
    return _folder(glob[:first])


def _compile_ignore(glob: str) -> tuple[str, str, str, str]:
    if glob.endswith("/"):
        return "subtree", glob[:-1], glob[:-1], ""
    if glob in ("**", "**/*"):
        return "prefix", "", "", ""
    if "**" not in glob:
        rx = segment_regex(glob)
        if rx is None:
            return "never", "", "", ""
        if "/" in glob:
            return "regex", "", _anchor(glob) if set("*?[\\") & set(glob) else glob, rx[:-1] + "(/.*)?$"
        return "regex", "", "", "^(.*/)?" + rx[1:-1] + "(/.*)?$"
    if glob.startswith("**/"):
        rx = segment_regex(glob[3:])
        return ("never", "", "", "") if rx is None else ("regex", "", "", "(^|/)" + rx[1:-1] + "(/.*)?$")
    if glob.endswith("/**") or glob.endswith("/**/*"):
        head = re.sub(r"/\*\*(/\*)?$", "", glob)
        return "subtree", head, head, ""
    left, _, right = glob.partition("**")
    head, tail = left.removesuffix("/"), right.removeprefix("/")
    if not tail:
        return ("subtree", head, head, "") if head else ("prefix", "", "", "")
    rx = segment_regex(tail)
    if rx is None:
        return "never", "", "", ""
    inner = rx[1:-1] if "/" in tail else "(.*/)?" + rx[1:-1]
    body = quote(head) + "/" + inner if head else "/?" + inner
    alone = head and re.match(rx, head.rpartition("/")[2])
    return "regex", "", head, f"^({body}{'|' + quote(head) if alone else ''})(/.*)?$"


def any_of(conditions: list[Column]) -> Column:
    """OR of conditions; empty means false."""
    return reduce(or_, conditions) if conditions else F.lit(False)


def glob_match(path: Column, glob: str, dialect: str = "layer") -> Column:
    """L1 ``glob_match``: does ``path`` match ``glob`` in this dialect?"""
    if dialect in ("layer", "import", "exclude"):
        head = glob[:-3]
        if glob.endswith("/**") and "*" not in head:
            return (path == head) | path.startswith(head + "/")
        if "*" not in glob:
            if dialect == "layer":
                return path.startswith(glob)
            if dialect == "exclude" and glob.endswith("/"):
                return (path == glob[:-1]) | path.startswith(glob)
            return path == glob
    if dialect == "ignore":
        return _ignored(path, glob)
    if dialect == "watch":
        return _watch_ignored(path, glob)
    if dialect == "walk_include":
        return _walk_include(path, glob)
    if dialect == "walk_exclude":
        return _walk_exclude(path, glob)
    if dialect == "expect" and "**" in glob:
        head, _, tail = glob.partition("**")
        # prefix and suffix are tested separately, so they may overlap
        loose = path.startswith(head) & (path.endswith(tail) if tail else F.lit(True))
        return _segment(path, glob) | loose
    return path.rlike(glob_regex(glob, dialect))


def _segment(path: Column, glob: str) -> Column:
    rx = segment_regex(glob)
    return F.lit(False) if rx is None else path.rlike(rx)


def base_name(path: Column) -> Column:
    """Last path segment."""
    return F.substring_index(path, "/", -1)


def _ignored(path: Column, glob: str) -> Column:
    """Ignore-file line: directory prefix, ``**`` forms, or basename glob."""
    if glob.endswith("/"):
        return (path == glob[:-1]) | path.startswith(glob)
    if "**" not in glob:
        return _segment(path, glob) | _segment(base_name(path), glob)
    if glob in ("**", "**/*"):
        return F.lit(True)
    if glob.startswith("**/"):
        rx = segment_regex(glob[3:])
        return F.lit(False) if rx is None else path.rlike("(^|/)" + rx[1:])
    if glob.endswith("/**") or glob.endswith("/**/*"):
        head = re.sub(r"/\*\*(/\*)?$", "", glob)
        return (path == head) | path.startswith(head + "/")
    left, _, right = glob.partition("**")
    head, tail = left.removesuffix("/"), right.removeprefix("/")
    inside = ((path == head) | path.startswith(head + "/")) if head else F.lit(True)
    if not tail:
        return inside
    rest = F.when(path.startswith(head + "/"), F.substring(path, len(head) + 2, 1 << 30)).otherwise(path)
    return inside & (_segment(base_name(path), tail) | _segment(rest, tail))


def _watch_ignored(path: Column, glob: str) -> Column:
    """Change-event ignore line: ``*.ext``, ``dir/*``, ``dir/``, paths and bare names."""
    folder = glob.endswith("/")
    name = glob.removesuffix("/")
    if "*" in name:
        if name.startswith("*"):
            return base_name(path).endswith(name[1:])
        if name.endswith("/*"):
            return path.startswith(name[:-1])
        return path.contains(name.split("*", 1)[0])
    if folder:
        return path.contains("/" + name + "/") | path.startswith(name + "/")
    if "/" in name:
        return path.startswith(name) | path.endswith(name) | path.contains("/" + name)
    return base_name(path) == name


def _walk_include(path: Column, glob: str) -> Column:
    hit = _segment(path, glob)
    if glob.endswith("/**"):
        return hit | path.startswith(glob[:-2])
    if glob.endswith("**"):
        return hit | path.startswith(glob[:-2])
    return hit


def _walk_exclude(path: Column, glob: str) -> Column:
    hits = [_segment(path, glob)]
    if "**" in glob:
        hits.append(_segment(path, glob.replace("**", ".*")))
        if glob.startswith("**/"):
            tail = glob[3:]
            hits += [path.contains("/" + tail), path.endswith(tail)]
        if glob.endswith("/**"):
            hits.append(path.startswith(glob[:-2]))
    return any_of(hits)


def matches_any(path: Column, globs, dialect: str = "layer") -> Column:
    """True when any glob matches."""
    return any_of([glob_match(path, g, dialect) for g in globs])


def first_match(path: Column, layers, dialect: str = "layer") -> Column:
    """Name of the first layer (in listed order) with a matching pattern, else NULL."""
    hits = [F.when(matches_any(path, layer.paths, dialect), F.lit(layer.name)) for layer in layers]
    return F.coalesce(F.lit(None).cast("string"), *hits)
