"""Project identity read off a working-directory path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadline.functions.once import bound

# Directory names that never become part of a label.
SKIP_DIRS = ["projects", "code", "repos", "src", "dev", "work", "documents"]
HOME_DIRS = ["home", "users"]
# The directory names that hold worktrees.
WORKTREE_DIRS = [".worktree", ".worktrees"]
WORKTREE_PREFIX = ".worktree-"


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def project_label(path: Column) -> Column:
    """Display label of a path: home prefix and container folders removed, joined by '-'."""
    return bound(path_parts(path), lambda parts: bound(F.transform(parts, F.lower), lambda lowered: _label(path, parts, lowered)))


def _label(path: Column, parts: Column, lowered: Column) -> Column:
    is_wsl = F.slice(lowered, 1, 3) == F.array(F.lit("mnt"), F.lit("c"), F.lit("users"))
    is_home = F.coalesce(F.try_element_at(lowered, F.lit(1)).isin(HOME_DIRS), F.lit(False))
    tail = (
        F.when(is_wsl, F.slice(parts, 4, F.size(parts)))
        .when(is_home, F.slice(parts, 2, F.size(parts)))
        .otherwise(parts)
    )

    def below_home(tail: Column) -> Column:
        second = F.lower(F.try_element_at(tail, F.lit(2)))
        # The owner's own folder goes too when a container folder follows it.
        tail = F.when(F.coalesce(second.isin(SKIP_DIRS), F.lit(False)), F.slice(tail, 2, F.size(tail))).otherwise(tail)
        return F.filter(tail, lambda s: ~F.lower(s).isin(SKIP_DIRS))

    return bound(
        bound(tail, below_home),
        lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "-"))
        .when(F.size(parts) > 0, F.element_at(parts, -1))
        .otherwise(path),
    )




def _worktree_index(parts: Column) -> Column:
    """1-based position of the first worktree segment, 0 when there is none."""
    flags = F.transform(parts, lambda s: s.isin(WORKTREE_DIRS) | s.startswith(WORKTREE_PREFIX))
    return F.array_position(flags, True).cast("int")


def _at_worktree(path: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the path's segments and the position of its worktree segment."""
    return bound(path_parts(path), lambda parts: bound(_worktree_index(parts), lambda at: use(parts, at)))


def is_worktree(path: Column) -> Column:
    return F.coalesce((_worktree_index(path_parts(path)) > 0).cast("int"), F.lit(0))


def repo_root(path: Column) -> Column:
    """The checkout a worktree path belongs to, or the path itself."""
    head = lambda parts, at: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, at - 1), "/"))
    return _at_worktree(path, lambda parts, at: F.when(at > 0, head(parts, at)).otherwise(path))


def worktree_name(path: Column) -> Column:

    def name(parts: Column, at: Column) -> Column:
        segment = F.try_element_at(parts, at)
        following = F.coalesce(F.try_element_at(parts, at + 1), segment)
        cut = F.substr(segment, F.lit(len(WORKTREE_PREFIX) + 1))
        own = F.when(cut != "", cut).otherwise(segment)
        return F.when(at > 0, F.when(segment.isin(WORKTREE_DIRS), following).otherwise(own))

    return _at_worktree(path, name)


def encode_directory(path: Column) -> Column:
    """The folder name a working directory is filed under."""
    return F.regexp_replace(path, "[/_.]", "-")


def encode_directory_strict(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")
