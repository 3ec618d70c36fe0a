"""Path expressions. Slash-separated, built from JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARANTINE = "duplicates"  # fixed value: folder name under the root


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path: Column | str) -> Column:
    p = _col(path)
    cut = F.regexp_replace(p, r"/[^/]*\z", "")
    return (
        F.when(~p.contains("/"), F.lit("."))
        .when(cut == "", F.lit("/"))
        .otherwise(cut)
    )


def extension(name: Column | str) -> Column:
    """From the last dot of the last element, dot included: ``a.tar.gz`` -> ``.gz``."""
    return F.regexp_extract(_col(name), r"([.][^./]*)\z", 1)


def stem(name: Column | str) -> Column:
    n = _col(name)
    return F.regexp_replace(n, r"[.][^./]*\z", "")


def walk_key(path: Column | str) -> Column:
    """Sort key of a depth-first walk that lists each directory in byte order.

    ``a/b`` precedes ``a.txt``, which plain string order gets wrong. With the
    separator below every other character, comparing strings compares part by
    part; no path holds a NUL. Strings sort faster than arrays of parts.
    """
    return F.replace(_col(path), F.lit("/"), F.lit("\0"))


def path_of_key(key: Column | str) -> Column:
    return F.replace(_col(key), F.lit("\0"), F.lit("/"))


def relative_path(path: Column | str, root: Column | str) -> Column:
    p, r = _col(path), _col(root)
    skip = F.when(r.endswith("/"), F.length(r) + 1).otherwise(F.length(r) + 2)
    return F.substr(p, skip)


def depth(rel: Column | str) -> Column:
    """Number of directories above the file, counted from the root."""
    r = _col(rel)
    return F.length(r) - F.length(F.replace(r, F.lit("/"), F.lit("")))


def clean_path(path: Column | str) -> Column:
    """Lexical cleaning of ``.``, ``..``, repeated and trailing slashes.

    A scheme and authority (``s3://bucket``) stay as they are; what follows is cleaned.
    """
    p = _col(path)
    head = F.when(p.contains("://"), F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)).otherwise("")
    rest = F.substr(p, F.length(head) + 1)
    rooted = rest.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        up = F.when(can_pop, popped).when(rooted, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    parts = F.filter(F.split(rest, "/", -1), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    slash = F.when(rooted & ((head == "") | (F.size(folded) > 0)), "/").otherwise("")
    joined = F.concat(head, slash, F.array_join(folded, "/"))
    dirty = (p == "") | rest.rlike(r"//|(^|/)[.]{1,2}(/|\z)|./\z") | ((head != "") & (rest == "/"))
    return F.when(~dirty, p).otherwise(F.when(joined == "", F.lit(".")).otherwise(joined))


def joined_path(root: Column | str, folder: Column | str, name: Column | str) -> Column:
    """``root/folder/name``, cleaned. A folder given as ``str`` is the folder itself, not a column."""
    r, f = _col(root), F.lit(folder) if isinstance(folder, str) else folder
    inner = F.concat(f, F.lit("/"), _col(name))
    return clean_path(F.when(r == "", inner).otherwise(F.concat(r, F.lit("/"), inner)))


def root_prefix(root: Column | str) -> Column:
    """The cleaned root without a slash at its end, to put ``/...`` behind."""
    clean = clean_path(root)
    return F.when(clean == "/", F.lit("")).otherwise(clean)


def quarantine_path(root: Column | str, path: Column | str, content_hash: Column | str) -> Column:
    """``<root>/duplicates/<stem>_<hash8>_<path6><ext>``, the same on every run."""
    p = _col(path)
    name = base_name(p)
    path6 = F.substring(F.sha1(p.cast("binary")), 1, 6)
    target = F.concat(
        stem(name), F.lit("_"), F.substring(_col(content_hash), 1, 8), F.lit("_"), path6, extension(name)
    )
    return joined_path(root, QUARANTINE, target)


def human_size(size: Column | str) -> Column:
    """Base 1024, one decimal, ties to even; plain bytes below 1024."""
    n = _col(size)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for exp, unit in enumerate("KMGTPE", start=1):
        scaled = F.format_string("%.1f " + unit + "B", F.bround(n / F.lit(float(1024**exp)), 1))
        out = out.otherwise(scaled) if unit == "E" else out.when(n < F.lit(1024 ** (exp + 1)), scaled)
    return out
