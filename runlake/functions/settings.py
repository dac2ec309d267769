"""Column functions for layered settings, option maps and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Options forced on every runner invocation (they win over
# the user's overrides) and settings holding project-relative paths.
FORCED_OPTIONS = (("log_format", "json"), ("log_level", "debug"), ("debug", "true"))
PATH_KEYS = ("manifest", "extra_packages", "seeds_path")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_overrides(m: Column | str, deny: Sequence[str] = ()) -> Column:
    """Drop map entries whose value is null or whose key is deny-listed."""
    deny_arr = F.array(*[F.lit(k) for k in deny]) if deny else F.array().cast("array<string>")
    return F.map_filter(_c(m), lambda k, v: v.isNotNull() & ~F.array_contains(deny_arr, k))


def overlay(left: Column | str, right: Column | str) -> Column:
    """Merge two maps, the right side winning on shared keys. The left map is
    filtered first, so no session-wide duplicate-key policy is needed."""
    r = _c(right)
    return F.map_concat(F.map_filter(_c(left), lambda k, v: ~F.array_contains(F.map_keys(r), k)), r)


def forced_options() -> Column:
    return F.create_map(*[F.lit(x) for kv in FORCED_OPTIONS for x in kv])


def model_config(model_value: Column | str, project_value: Column | str) -> Column:
    """In-model setting beats the project setting."""
    return F.coalesce(_c(model_value), _c(project_value))


def prefix_path(key: Column | str, value: Column | str, root: Column | str,
                keys: Sequence[str] = PATH_KEYS) -> Column:
    """Path settings are made project-relative: a non-null relative value gets
    ``root/`` in front, an absolute one stays; other keys are untouched."""
    v = _c(value)
    rel = F.when(v.startswith("/"), v).otherwise(F.concat_ws("/", _c(root), v))
    return F.when(_c(key).isin(*keys) & v.isNotNull(), rel).otherwise(v)


def rel_path(path: Column | str, root: Column | str) -> Column:
    """Path with the root text removed (every occurrence, as text replace)."""
    return F.replace(_c(path), _c(root), F.lit(""))


def base_name(path: Column | str) -> Column:
    """Last ``/`` segment."""
    return F.substring_index(_c(path), "/", -1)
