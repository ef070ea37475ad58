"""POSIX path expressions and the path predicates of the lineage job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import SPACE, let, let_sql, quoted, truthy

_STRINGS = "array<string>"
_NEEDS_WORK = r"//|(?:^|/)\.\.?(?:/|\z)"

# Segments with "." dropped and ".." applied, as text.
_BODY = (
    f"array_join(aggregate(filter(split(p, '/', -1), s -> s <> '' AND s <> '.'), cast(array() AS {_STRINGS}), "
    "(acc, s) -> CASE WHEN s <> '..' THEN array_append(acc, s) "
    "WHEN try_element_at(acc, -1) <> '..' THEN slice(acc, 1, size(acc) - 1) "
    "WHEN startswith(p, '/') THEN acc ELSE array_append(acc, s) END), '/')"
)
_SLASH = "CASE WHEN endswith(p, '/') THEN '/' ELSE '' END"
_NORMAL = (
    f"CASE WHEN p = '' THEN '.' WHEN NOT p RLIKE {quoted(_NEEDS_WORK)} THEN p ELSE "
    + let_sql(
        _BODY, "body",
        "CASE WHEN startswith(p, '/') AND body = '' THEN '/' "
        f"WHEN startswith(p, '/') THEN concat('/', body, {_SLASH}) "
        f"WHEN body = '' THEN concat('.', {_SLASH}) ELSE concat(body, {_SLASH}) END",
    )
    + " END"
)
_NO_SLASH = quoted(r"(?<=.)/\z")


def _normal_sql(path: str) -> str:
    return let_sql(path, "p", _NORMAL)


def _resolved_sql(base: str, path: str) -> str:
    joined = f"CASE WHEN startswith({path}, '/') THEN {path} ELSE concat({base}, '/', {path}) END"
    return f"regexp_replace({_normal_sql(joined)}, {_NO_SLASH}, '')"


def normalize_path(path: Column) -> Column:
    """Collapse ``.``, ``..`` and ``//``; keep a trailing slash; empty is ``.``."""
    return let(path, f"p -> {_NORMAL}")


def _no_trailing_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=.)/\z", "")


def resolve_against(base: Column, path: Column) -> Column:
    """Join to the base and normalise, without a trailing slash."""
    both = F.struct(base.alias("base"), path.alias("path"))
    return let(both, f"b -> {_resolved_sql('b.base', 'b.path')}")


_AT_HOME = (
    "CASE WHEN b.path = '~' THEN b.home WHEN startswith(b.path, '~/') THEN "
    f"{_normal_sql('concat(b.home, ' + quoted('/') + ', substr(b.path, 3))')} ELSE b.path END"
)


def expand_home(path: Column, home: Column) -> Column:
    return let(F.struct(path.alias("path"), home.alias("home")), f"b -> {_AT_HOME}")


def resolve_candidate(path: Column, base: Column, home: Column) -> Column:
    """Absolute paths stay as they are; others resolve against the base."""
    both = F.struct(path.alias("path"), base.alias("base"), home.alias("home"))
    return let(both, f"b -> {_CANDIDATE}")


_CANDIDATE = let_sql(
    _AT_HOME, "f",
    f"CASE WHEN startswith(f, '/') THEN f ELSE {_resolved_sql('b.base', 'f')} END",
)


def resolve_candidates(candidates: Column, base: Column, home: Column) -> Column:
    """The same for an array of paths."""
    both = F.struct(candidates.alias("c"), base.alias("base"), home.alias("home"))
    one = let_sql("named_struct('path', c, 'base', a.base, 'home', a.home)", "b", _CANDIDATE)
    return let(both, f"a -> transform(a.c, c -> {one})")


def base_dir(cwd: Column, roots: Column, default: Column) -> Column:
    """First non-empty of cwd, first workspace root, default."""
    return F.coalesce(truthy(cwd), truthy(F.try_element_at(roots, F.lit(1))), default)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


_SEGMENTS = "filter(split({}, '/', -1), s -> s <> '')"
_SHARED = (
    "aggregate(zip_with(x.a, x.b, (m, n) -> coalesce(m = n, false)), named_struct('same', true, 'n', 0), "
    "(acc, e) -> named_struct('same', acc.same AND e, 'n', acc.n + if(acc.same AND e, 1, 0)), acc -> acc.n)"
)
_CLIMBED = let_sql(
    f"named_struct('a', {_SEGMENTS.format('r.root')}, 'b', {_SEGMENTS.format('r.full')})", "x",
    let_sql(
        _SHARED, "k",
        "array_join(concat(array_repeat('..', size(x.a) - k), "
        "slice(x.b, k + 1, greatest(size(x.b) - k, 0))), '/')",
    ),
)


def relative_path(path: Column, root: Column) -> Column:
    """Path from ``root``; names without any directory pass through, at no cost."""
    both = F.struct(
        _no_trailing_slash(normalize_path(root)).alias("root"), _no_trailing_slash(normalize_path(path)).alias("full")
    )
    below = let(
        both,
        "r -> CASE WHEN startswith(r.full, concat(r.root, '/')) THEN substr(r.full, length(r.root) + 2) "
        f"ELSE {_CLIMBED} END",
    )
    return F.when(~F.startswith(path, F.lit("/")), path).otherwise(below)


def escapes_base(path: Column, base: Column) -> Column:
    """True when an untrusted path is absolute or leaves the base directory."""
    root = _no_trailing_slash(normalize_path(base))
    both = F.struct(path.alias("path"), root.alias("root"), resolve_against(root, path).alias("full"))
    return let(
        both,
        "r -> CASE WHEN r.path IN ('', '.') OR r.path RLIKE '^/+$' THEN false "
        "WHEN startswith(r.path, '/') THEN true "
        "ELSE NOT (r.full = r.root OR startswith(r.full, concat(r.root, '/'))) END",
    )


# Predicates over a token ``c``, as SQL for use inside lambdas.
_GLOB, _NAME = quoted(r"[*?\[]"), quoted(r"^[A-Za-z0-9._][A-Za-z0-9._-]*\z")
PATH_LIKE = (
    f"(c <> '' AND NOT startswith(c, '-') AND NOT c RLIKE {_GLOB} AND c RLIKE '/|^[.~]')"
)
BARE_LIKE = f"(c RLIKE {_NAME} AND contains(c, '.') AND length(c) <= {rules.BARE_FILE_MAX})"


def looks_like_path(token: Column) -> Column:
    return let(token, f"c -> {PATH_LIKE}")


def looks_like_bare_file(token: Column) -> Column:
    """File name characters only, so its length is the same in any unit."""
    return let(token, f"c -> {BARE_LIKE}")


def is_env_assignment(token: Column) -> Column:
    return token.rlike(rules.ENV_ASSIGNMENT_PATTERN)


def _char_class(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


_HEAD = rf"^{SPACE}*{_char_class(rules.STRIP_LEADING)}*"
_TAIL = rf"{_char_class(rules.STRIP_TRAILING)}*{SPACE}*\z"
STRIPPED = f"regexp_replace(regexp_replace(c, {quoted(_HEAD)}, ''), {quoted(_TAIL)}, '')"


def strip_quoting(raw: Column) -> Column:
    """Trim, then peel opening marks from the front and closing ones from the end."""
    return let(raw, f"c -> {STRIPPED}")
