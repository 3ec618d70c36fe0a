import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfmark.functions import globs
from shelfmark.operators import filters, matching
from shelfmark.operators.ignore import drop_ignored, drop_ignored_join, explain_ignored, explain_ignored_table
from shelfmark.sources.ignore_files import load_ignore_rules
from tests.conftest import paths_of


def glob_match(pattern, text):
    """Step-by-step matcher for ``*``, ``?`` and plain characters."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return glob_match(pattern[1:], text) or (
            bool(text) and text[0] != "/" and glob_match(pattern, text[1:])
        )
    if not text:
        return False
    return (pattern[0] == text[0] or (pattern[0] == "?" and text[0] != "/")) and glob_match(pattern[1:], text[1:])


def entry_hit(pattern, rel, is_dir):
    inner = pattern.removeprefix("/")
    if "/" in inner or pattern.startswith("/"):
        return glob_match(inner, rel) or (is_dir and (rel == inner or rel.startswith(inner + "/")))
    name = rel.rsplit("/", 1)[-1]
    return glob_match(inner, name) or (is_dir and name.startswith(inner))


def hidden(patterns, rel):
    parts = rel.split("/")
    return any(
        entry_hit(p, "/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1) for p in patterns
    )


CASES = [
    ("build", {"builder/a": True, "build.txt": False, "x/build": True, "x/builds/y/z": True}),
    ("archive/*.zip", {"archive/a.zip": True, "archive/b/a.zip": False, "x/archive/a.zip": False}),
    ("/tmp", {"tmp/a": True, "x/tmp/a": False, "tmp": True}),
    ("*.tmp", {"a.tmp": True, "d/b.tmp": True, "c.tmp/x": True, "a.tmpx": False}),
    ("[a-c]?", {"ax": True, "dx": False, "ax/y": True}),
    ("a[", {"a[": False, "a[b/c": True}),
]


@pytest.mark.parametrize("pattern, want", CASES)
def test_cases(spark, manifest, pattern, want):
    files = manifest([f"/r/{p}" for p in want])
    kept = [f"/r/{p}" for p, gone in want.items() if not gone]
    assert paths_of(drop_ignored(files, [pattern])) == sorted(kept)
    rules = spark.createDataFrame([(pattern,)], "pattern string")
    assert paths_of(drop_ignored_join(files, rules)) == sorted(kept)


def test_both_forms_agree_with_a_walk(spark, manifest):
    rnd = random.Random(3)

    def word(chars, low, high):
        return "".join(rnd.choice(chars) for _ in range(rnd.randint(low, high)))

    rels = {"/".join(word("ab.", 1, 3) for _ in range(rnd.randint(1, 4))) for _ in range(500)}
    rels = sorted(r for r in rels if all(p.strip(".") for p in r.split("/")))
    files = manifest([f"/r/{r}" for r in rels])
    for round_ in range(6):
        chars = "ab" if round_ % 2 else "ab*?"
        patterns = [("/" if rnd.random() < 0.3 else "") + "/".join(word(chars, 1, 3) for _ in range(rnd.randint(1, 2))) for _ in range(4)]
        want = sorted(f"/r/{r}" for r in rels if not hidden(patterns, r))
        assert paths_of(drop_ignored(files, patterns)) == want, patterns
        rules = spark.createDataFrame([(p,) for p in patterns], "pattern string")
        assert paths_of(drop_ignored_join(files, rules)) == want, patterns


def test_explain_by_table_equals_explain(spark, manifest):
    """Files and directories, names and paths, classes, escapes, malformed globs, repeated patterns."""
    rnd = random.Random(8)

    def word(chars, low, high):
        return "".join(rnd.choice(chars) for _ in range(rnd.randint(low, high)))

    rels = sorted({"/".join(word("ab.", 1, 3) for _ in range(rnd.randint(1, 4))) for _ in range(300)})
    rels = [r for r in rels if all(p.strip(".") for p in r.split("/"))]
    entries = spark.createDataFrame([("/r", f"/r/{r}", i % 3 == 0, "x") for i, r in enumerate(rels)], "root_dir string, source_path string, d boolean, rule string")
    fixed = ["a[", "a/[b", "[ab]", "a/[!b]*", "a/[^b]*", r"a/\*", r"a\/b", "/", "//", " ", "*", "/*", "a/*", "*/b*", "?", "/a?", "\u00a0a.\t", "a", "a", "aa/"]
    for round_ in range(3):
        chars = ["ab", "ab*?", "ab.*"][round_]
        patterns = fixed[round_::2] + [("/" if rnd.random() < 0.3 else "") + "/".join(word(chars, 1, 3) for _ in range(rnd.randint(1, 3))) for _ in range(15)]
        rnd.shuffle(patterns)
        rows = [Row(ord=10 * i, pattern=p, source=f"s{i % 2}") for i, p in enumerate(patterns)]
        table = spark.createDataFrame(rows, "ord bigint, pattern string, source string")
        want = explain_ignored(entries, rows, F.col("d"))
        got = explain_ignored_table(entries, table, F.col("d"))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), patterns


def test_class_that_stands_for_a_slash(spark, manifest):
    files = manifest(["/r/x/z/w", "/r/xyz/w", "/r/x/q", "/r/a/b/c"])
    rules = spark.createDataFrame([("x[^y]z/w",), ("a/b[^b]c",)], "pattern string")
    want = paths_of(drop_ignored(files, [r.pattern for r in rules.collect()]))
    assert paths_of(drop_ignored_join(files, rules)) == want == ["/r/x/q", "/r/xyz/w"]


def test_top_folder_over_most_rows(spark, manifest):
    """One hidden folder above most directories, with nested hidden ones, and one like it beside it."""
    files = manifest([f"/r/top/d{i}/e{i % 7}/f" for i in range(2000)] + [f"/r/top.x/d{i}/f" for i in range(20)] + ["/r/top", "/r/t/top/a"])
    rules = spark.createDataFrame([("/top",), ("/top/d5",), ("/top/d5/e5",), ("top.x/d3",)], "pattern string")
    want = [f"/r/top.x/d{i}/f" for i in range(20) if i != 3] + ["/r/t/top/a"]
    assert paths_of(drop_ignored_join(files, rules)) == sorted(want)


def test_many_glob_rules_as_rows(spark, manifest):
    n = 20_000
    rules = spark.range(n).selectExpr(
        "id ord", "case id % 3 when 0 then concat('f*_', id, '.t?t') when 1 then concat('/d?', id, '/*.log') else concat('name', id) end pattern", "'s' source"
    )
    files = manifest(["/r/fab_9999.txt", "/r/dx10000/a.log", "/r/dx10000/b/a.log", "/r/name20x", "/r/name20x/y", "/r/q/name17", "/r/z"])
    got = {r.source_path: r.pattern for r in explain_ignored_table(files, rules).collect()}
    assert got == {
        "/r/fab_9999.txt": "f*_9999.t?t", "/r/dx10000/a.log": "/d?10000/*.log", "/r/dx10000/b/a.log": None,
        "/r/name20x": None, "/r/name20x/y": None, "/r/q/name17": "name17", "/r/z": None,
    }
    plan = explain_ignored_table(files, rules)._jdf.queryExecution().toString()
    assert "name19997" not in plan
    kept = paths_of(drop_ignored_join(files, rules))
    assert kept == ["/r/dx10000/b/a.log", "/r/name20x", "/r/z"]  # the directory name20x begins with a rule


def test_class_and_escape_globs():
    import re

    def match(glob, text):
        regex = globs.glob_regex(glob)
        return regex is not None and re.fullmatch(regex, text) is not None

    assert match("[^a]x", "bx") and not match("[^a]x", "ax")
    assert match(r"a\*b", "a*b") and not match(r"a\*b", "axb")
    assert match("[a-c]", "b") and not match("[c-a]", "b")
    assert match("[^c-a]", "b")
    assert match(r"[\]]", "]")
    for bad in ("[", "[]a]", "[a-]", "[-a]", "a\\", "[a", "[^]"):
        assert globs.glob_regex(bad) is None, bad


def test_explain_looks_at_the_path_itself(spark, manifest):
    files = manifest(["/r/build/a", "/r/x.tmp", "/r/build"])
    rules = [Row(ord=1, pattern="build", source="config"), Row(ord=2, pattern="*.tmp", source="f")]
    got = {r.source_path: (r.pattern, r.source) for r in explain_ignored(files, rules).collect()}
    assert got == {"/r/build/a": (None, None), "/r/x.tmp": ("*.tmp", "f"), "/r/build": ("build", "config")}
    dirs = manifest(["/r/builder", "/r/a/builder/c"])
    as_dirs = {r.source_path: r.pattern for r in explain_ignored(dirs, rules, F.lit(True)).collect()}
    assert as_dirs == {"/r/builder": "build", "/r/a/builder/c": None}


def test_sources_in_order(spark, tmp_path):
    (tmp_path / "one").write_text("# c\nbuild/\n\n*.tmp\nbuild\n")
    (tmp_path / "two").write_text("// c\nbuild\n")
    config = spark.createDataFrame([(7, "x/"), (9, ""), (11, "x")], "line_no int, pattern string")
    rules = load_ignore_rules(spark, [str(tmp_path / n) for n in ("one", "none", "two")], config)
    got = [(r.pattern, r.source.rsplit("/", 1)[-1]) for r in rules.orderBy("ord").collect()]
    assert got == [("x", "config"), ("build", "one"), ("*.tmp", "one"), ("build", "two")]
    assert load_ignore_rules(spark, [str(tmp_path / "none")]).count() == 0


def test_hidden_depth_and_quarantine(manifest):
    files = manifest(["/r/a", "/r/.b", "/r/d/a", "/r/.d/a", "/r/d/e.x/.f/g"])
    assert paths_of(filters.drop_hidden(files)) == ["/r/a", "/r/d/a"]
    assert paths_of(filters.drop_hidden(manifest(["/x/.r/a"], root="/x/.r"))) == []
    assert paths_of(filters.limit_depth(files, 0)) == ["/r/.b", "/r/a"]
    assert paths_of(filters.limit_depth(files, -3)) == ["/r/.b", "/r/a"]
    kept = filters.drop_quarantined(manifest(["/r/duplicates/a", "/r/duplicates/s/a", "/r/x/duplicates/a"]))
    assert paths_of(kept) == ["/r/duplicates/s/a", "/r/x/duplicates/a"]


def test_names_that_count_up_meet_few_patterns(spark):
    """Whole names, beginnings and literals, each against a loop; grams are as long as literals allow."""
    texts = [f"doc_{i}.txt" for i in range(300)] + ["", "doc_", "x"]
    rows = [("equals", f"doc_{i}.txt", None, f"e{i}") for i in range(0, 400, 7)]
    rows += [("prefix", f"doc_{i}", None, f"p{i}") for i in range(0, 400, 11)] + [("prefix", "x" * 300, None, "long")]
    rows += [("contains", f"c_{i}", None, f"c{i}") for i in range(0, 400, 13)] + [("contains", "t", None, "t")]
    rows += [("regex", f"_\0{i}.t", f"^doc_[0-9]{i}[.]txt$", f"r{i}") for i in range(0, 99, 5)]
    patterns = spark.createDataFrame(rows, "test string, fragment string, regex string, name string")
    got = {(r.text, r.name) for r in matching.matches(spark.createDataFrame([(t,) for t in texts], "text string"), patterns).collect()}

    def fits(test, fragment, regex, text):
        if test == "regex":
            return bool(re.search(regex, text))
        return text == fragment if test == "equals" else text.startswith(fragment) if test == "prefix" else fragment in text

    assert got == {(t, name) for t in texts for test, f, rx, name in rows if fits(test, f, rx, t)}
    sizes = F.transform(matching._held("f"), lambda x: F.array_max(F.transform(matching._own_grams(x), F.char_length)))
    asked = spark.createDataFrame([("doc_\0" + "1234567.txt",), ("ab\0" + "1234",), ("a",)], "f string").select("f", sizes.alias("n"))
    assert [r.n for r in asked.collect()] == [[4, 8], [4], [1]]
