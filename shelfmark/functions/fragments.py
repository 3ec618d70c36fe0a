"""Fragments of patterns: every match holds at least one of them.

A fragment is one or more literals, joined by BETWEEN, all of which the match holds. They
let a table of patterns meet a table of texts by equality. What cannot be told has no
fragments; a pattern is never given one that a match could lack.
"""

from __future__ import annotations

import re

# More alternatives than this, and a pattern counts as having none.
MOST = 16
BETWEEN = "\0"

_REPEAT = re.compile(r"\{(\d+)(,\d*)?\}")
_FLAGS = re.compile(r"\(\?[imsU-]*i")


def _better(one: list[str] | None, other: list[str] | None) -> list[str] | None:
    """The list whose shortest fragment is longer, by the longest literal of each."""
    if one is None or other is None:
        return one or other
    return max(one, other, key=lambda x: (min(max(map(len, f.split(BETWEEN))) for f in x), -len(x)))


def regex_fragments(pattern: str) -> list[str] | None:
    """Fragments of a valid pattern of the dialect of ``regexes.to_java``, or None."""
    if _FLAGS.search(pattern) or BETWEEN in pattern:  # case does not matter somewhere
        return None
    found, end = _alternatives(pattern, 0)
    return sorted(set(found)) if found and len(found) <= MOST and end >= len(pattern) else None


def _least_repeats(pattern: str, at: int) -> tuple[int, int]:
    """How often what stands before ``at`` occurs at least, and where its quantifier ends."""
    ch = pattern[at : at + 1]
    least = {"*": 0, "?": 0, "+": 1}.get(ch)
    if least is not None:
        at += 1
    elif m := _REPEAT.match(pattern, at):
        least, at = min(int(m[1]), 1), m.end()
    else:
        return -1, at  # exactly once, no quantifier
    return least, at + (pattern[at : at + 1] == "?")


def _class_end(pattern: str, at: int) -> int:
    at += 1
    at += pattern[at : at + 1] == "^"
    at += pattern[at : at + 1] == "]"
    while pattern[at] != "]":
        if pattern.startswith("[:", at) and ":]" in pattern[at:]:
            at = pattern.index(":]", at) + 2
        else:
            at += 2 if pattern[at] == "\\" else 1
    return at + 1


def _escape(pattern: str, at: int) -> tuple[str | None, int]:
    """The character an escape stands for, None if it is more than that, and where it ends."""
    ch = pattern[at + 1]
    if ch in "pP":
        return None, (pattern.index("}", at) + 1 if pattern[at + 2 : at + 3] == "{" else at + 3)
    if ch == "x":
        return None, (pattern.index("}", at) + 1 if pattern[at + 2 : at + 3] == "{" else at + 4)
    if ch.isdigit():
        end = at + 2
        while end < min(at + 4, len(pattern)) and pattern[end] in "01234567":
            end += 1
        return None, end
    return (None, at + 2) if ch.isalpha() else (ch, at + 2)


def _alternatives(pattern: str, at: int) -> tuple[list[str] | None, int]:
    """Fragments of what stands from ``at`` to the end of the group, and where that is."""
    branches: list[list[str] | None] = []
    best: list[str] | None = None
    run, runs = "", []

    def flush() -> None:
        nonlocal run
        runs.extend([run] if run else [])
        run = ""

    def end_branch() -> None:
        nonlocal best
        flush()
        branches.append(_better([BETWEEN.join(runs)] if runs else None, best))
        best = None
        runs.clear()

    while at < len(pattern) and pattern[at] != ")":
        ch, text = pattern[at], None
        if ch == "|":
            end_branch()
            at += 1
            continue
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            text = pattern[at + 2 : len(pattern) if end < 0 else end]
            at = len(pattern) if end < 0 else end + 2
            if len(text) > 1:  # a quantifier behind it is for its last character
                run, text = run + text[:-1], text[-1]
        elif ch == "\\":
            text, at = _escape(pattern, at)
        elif ch == "[":
            end = _class_end(pattern, at)
            inner = pattern[at + 1 : end - 1]
            text, at = (inner if len(inner) == 1 and inner not in "^\\" else None), end
        elif ch == "(":
            start = re.compile(r"\((\?(P?<\w+>|[imsU-]*[:)]))?").match(pattern, at)
            if start[0].endswith(")"):  # flags only
                at = start.end()
                continue
            inner_best, at = _alternatives(pattern, start.end())
            at += 1
            least, at = _least_repeats(pattern, at)
            flush()
            if least:
                best = _better(best, inner_best)
            continue
        else:
            text, at = (None if ch in ".^$" else ch), at + 1
        least, at = _least_repeats(pattern, at)
        if text is None or text == "":
            flush()
        elif least < 0:
            run += text
        else:
            run += text if least else ""
            flush()
    end_branch()
    if any(b is None for b in branches):
        return None, at
    return [x for b in branches for x in b], at


def glob_fragments(glob: str) -> list[str] | None:
    """The runs of plain characters of a well-formed glob as one fragment, or None."""
    runs, run, at = [], "", 0
    while at < len(glob):
        ch = glob[at]
        if ch == "\\":
            run, at = run + glob[at + 1], at + 2
            continue
        if ch not in "*?[":
            run, at = run + ch, at + 1
            continue
        runs.append(run)
        run, at = "", at + 1
        if ch == "[":
            at += glob[at : at + 1] == "^"
            first = True
            while first or glob[at] != "]":
                at += 2 if glob[at] == "\\" else 1
                first = False
            at += 1
    runs = [r for r in [*runs, run] if r]
    return [BETWEEN.join(runs)] if runs and BETWEEN not in glob else None
