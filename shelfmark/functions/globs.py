"""Ignore patterns as one regular expression each.

``*`` and ``?`` never cross a slash. A pattern with a slash is matched against
the whole relative path, any other against base names. Directories also match
literally: a path pattern hides the directory it names, a name pattern hides
every directory whose name *starts* with it. A malformed glob keeps only that
literal meaning.
"""

from __future__ import annotations

from collections.abc import Sequence

from shelfmark.functions.fragments import glob_fragments
from shelfmark.functions.regexes import quote
from shelfmark.functions.text import SPACES

ANYTHING_BUT_SLASH = "[^/]"


def glob_regex(glob: str) -> str | None:
    """Regex for a whole string, or None for a malformed glob."""
    out: list[str] = []
    i = 0

    def class_char(at: int) -> tuple[str | None, int]:
        if at < len(glob) and glob[at] == "\\":
            at += 1
        elif at >= len(glob) or glob[at] in "-]":
            return None, at
        return (glob[at], at + 1) if at < len(glob) else (None, at)

    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(ANYTHING_BUT_SLASH + "*")
        elif ch == "?":
            out.append(ANYTHING_BUT_SLASH)
        elif ch == "\\":
            if i >= len(glob):
                return None
            out.append(quote(glob[i]))
            i += 1
        elif ch == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            ranges: list[str] = []
            while not (ranges and glob[i : i + 1] == "]"):
                low, i = class_char(i)
                if low is None:
                    return None
                high = low
                if glob[i : i + 1] == "-":
                    high, i = class_char(i + 1)
                    if high is None:
                        return None
                # An empty range such as z-a matches nothing, yet is well formed.
                ranges.append(f"{quote(low)}-{quote(high)}" if low <= high else "")
            i += 1
            body = "".join(ranges)
            if body:
                out.append(f"[{'^' if negated else ''}{body}]")
            else:
                out.append(r"[\s\S]" if negated else r"[^\s\S]")
        else:
            out.append(quote(ch))
    return "".join(out)


def _parts(pattern: str) -> tuple[bool, str | None, str] | None:
    pattern = pattern.strip(SPACES)
    if not pattern:
        return None
    inner = pattern.removeprefix("/")
    is_path = "/" in inner or pattern.startswith("/")
    return is_path, glob_regex(inner), quote(inner)


def tree_regexes(patterns: Sequence[str]) -> list[str]:
    """Match a relative file path if the file or a directory above it is hidden.

    All name patterns share one expression and all path patterns another, so
    the number of patterns does not grow the query plan.
    """
    names: list[str] = []
    whole: list[str] = []
    for is_path, glob, literal in filter(None, map(_parts, patterns)):
        if is_path:
            whole.append(f"{literal}/")
            if glob is not None:
                whole.append(f"{glob}(?:/|\\z)")
        else:
            names.append(f"{literal}[^/]*/")
            if glob is not None:
                names.append(f"{glob}(?:/|\\z)")
    return [
        f"{start}(?:{'|'.join(choices)})"
        for start, choices in (("(?:^|/)", names), ("^", whole))
        if choices
    ]


def entry_regex(pattern: str, is_dir: bool) -> str | None:
    """Matches the relative path of one entry by itself, not by its parents."""
    parts = _parts(pattern)
    if parts is None:
        return None
    is_path, glob, literal = parts
    choices = [] if glob is None else [f"{glob}\\z"]
    if is_dir:
        choices.append(f"{literal}(?:/[\\s\\S]*)?\\z" if is_path else f"{literal}[^/]*\\z")
    if not choices:
        return None
    return f"{'^' if is_path else '(^|/)'}(?:{'|'.join(choices)})"


def parsed(pattern: str | None) -> tuple | None:
    """A pattern as a row of a rule table, or None for a blank one.

    (is_path, literal, name_regex, fragments, folder, folder_fragments, last): the literal
    that directories match; for name patterns the regex of a whole name. Path patterns are
    cut at their last slash: ``folder`` is the regex of the path above it ("" for the root),
    ``last`` the glob of the name. Path patterns with classes, which may stand for a slash,
    are not cut: their ``name_regex`` is that of the whole path. Malformed globs have no regex.
    """
    pattern = (pattern or "").strip(SPACES)
    if not pattern:
        return None
    inner = pattern.removeprefix("/")
    is_path = "/" in inner or pattern.startswith("/")
    regex = glob_regex(inner)
    if regex is None:
        return is_path, inner, None, None, None, None, None
    if not is_path or "[" in inner:
        return is_path, inner, f"^{regex}\\z", glob_fragments(inner), None, None, None
    # An escaped slash is a slash.
    folder, _, last = inner.replace("\\/", "/").rpartition("/")
    return (
        True, inner, None, glob_fragments(last), f"^{glob_regex(folder)}\\z" if folder else "", glob_fragments(folder), last
    )
