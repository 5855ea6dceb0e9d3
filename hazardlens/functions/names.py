"""Column builders for paths, qualified names, globs and redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def target(path: Column, qualname: Column) -> Column:
    return F.concat_ws("::", path, qualname)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def tail(qualname: Column) -> Column:
    return F.substring_index(qualname, ".", -1)


def shard_prefix(prefix: Column) -> Column:
    """A coverage shard's prefix without leading dots and slashes (as characters) and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(prefix, F.lit("\\"), F.lit("/")), "^[./]+", ""), "/+$", "")


def under(path: Column, prefix: Column) -> Column:
    """Whether ``path`` is ``prefix`` or below it; the empty prefix and ``.`` hold everything."""
    return prefix.isin("", ".") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def glob_regex(pattern: str) -> str:
    """A Java regex for a glob whose ``*`` also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c))
    return "(?s)\\A(?:" + "".join(out) + ")\\z"


def any_glob(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(glob_regex(p))
    return out


def allowed(path: Column, qualname: Column, patterns: list[str]) -> Column:
    """Suppression: patterns with a slash or ``**`` are for paths, others for qualified names."""
    on_path = [p for p in patterns if "/" in p or "**" in p]
    return any_glob(path, on_path) | any_glob(qualname, [p for p in patterns if p not in on_path])


def is_public(qualname: Column, exported: Column | None = None) -> Column:
    """No segment begins with an underscore, dunder names of more than four characters apart.

    ``exported`` (array or null) promotes the first segment.
    """
    segments = F.split(qualname, "\\.")
    private = lambda s: F.startswith(s, F.lit("_")) & ~s.rlike("^__.+__$")
    plain = ~F.exists(segments, private)
    if exported is None:
        return plain
    rest = F.when(F.size(segments) > 1, ~F.exists(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(1))), private)).otherwise(True)
    return F.when(F.coalesce(F.array_contains(exported, F.element_at(segments, 1)), F.lit(False)), rest).otherwise(plain)


def redacted(value: Column, salt: str | None = None) -> Column:
    """First 12 hex digits of sha256 of the salt, if any, followed by the value."""
    return F.substring(F.sha2(F.concat(F.lit(salt or ""), value), 256), 1, 12)


def scrubbed(reason: Column, names: list[tuple[str, str]]) -> Column:
    """``reason`` with each name replaced by its redaction, longest names first."""
    for old, new in sorted(names, key=lambda x: (-len(x[0]), x[0])):
        reason = F.replace(reason, F.lit(old), F.lit(new))
    return reason


def diff_path(raw: Column) -> Column:
    """A path of a ``+++``/``---`` line: null for /dev/null, without quotes and the a/ or b/ prefix."""
    p = F.regexp_replace(F.btrim(F.split_part(raw, F.lit("\t"), F.lit(1))), '^"|"$', "")
    return F.when(p == "/dev/null", F.lit(None)).otherwise(F.regexp_replace(p, "^[ab]/", ""))


def generated(path: Column, head: Column) -> Column:
    """Whether a TypeScript file is generated: by its name, or by a comment that begins with ``@generated`` in its first 2,000 bytes."""
    start = F.decode(F.substring(head.cast("binary"), 1, 2000), "UTF-8")
    return path.rlike("\\.(pb|gen)\\.[mc]?tsx?$") | start.rlike("(?m)^\\s*(//|/\\*+|\\*|#)\\s*@generated\\b")


def product_file(path: Column) -> Column:
    """Whether a TypeScript file is the product's own: no tests, stories, declarations, fixtures or built files."""
    return ~(path.rlike("\\.(test|spec|stories|d|config)\\.[mc]?tsx?$") | path.rlike("(^|/)(node_modules|dist|build|__tests__|tests?|fixtures|examples)/"))


def repo_slug(url: Column) -> Column:
    """``owner/name`` of a repository's address, without ``.git``; null where there is none."""
    return F.nullif(F.regexp_extract(url, "([^/:]+/[^/:]+?)(?:\\.git)?/*$", 1), F.lit(""))


def n_failed(output: Column) -> Column:
    """The number of failed tests that a test run's summary names, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(output, "([0-9]+) failed", 1), F.lit("")).cast("int"), F.lit(0))
