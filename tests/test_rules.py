import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfmark.functions.fragments import glob_fragments, regex_fragments
from shelfmark.functions.regexes import PatternError, to_java
from shelfmark.operators.classify import classify, classify_case, classify_join
from shelfmark.sources.rule_files import load_rules, parse_inline, parse_rule_files, rule_listing


def parsed(spark, text):
    return parse_rule_files(spark.createDataFrame([(text,)], "text string"))


def rules_of(spark, text):
    return parsed(spark, text).rules


def folders(df):
    """Base name -> folder below the root, None for a skip."""
    out = {}
    for r in df.collect():
        name = r.source_path.rsplit("/", 1)[-1]
        out[name] = None if r.op_type == "skip" else r.dest_path.removeprefix("/r/").rsplit("/", 1)[0]
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("A=*\nB=foo", {"foo.txt": "B", "x": "A", "a*b": "A"}),
        ("A=*\nB=*", {"x": "B"}),
        ("Img=jpg", {"X.JPG": None, "x.jpg": "Img"}),
        ("A=b\nB=a,c", {"abc": "A", "c": "B"}),
        ("A=regex(^x$)\nB=regex([[:digit:]]+)", {"x": "A", "x\n": None, "a1": "B"}),
        ("A=c\nB=regex(^a),a", {"abc": "A", "ab": "B", "ba": "B"}),
    ],
)
def test_first_match(spark, manifest, text, want):
    files = manifest([f"/r/d/{n}" for n in want])
    rules = rules_of(spark, text)
    assert folders(classify_case(files, rules.collect())) == want
    assert folders(classify_join(files, rules)) == want
    assert folders(classify(files, rules)) == want


def test_both_forms_agree_with_a_loop(spark, manifest):
    rnd = random.Random(5)
    letters = "abc*"
    rules, order = [], []
    for i in range(40):
        folder = f"f{i}"
        for j in range(rnd.randint(0, 3)):
            raw = "*" if rnd.random() < 0.05 else "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 5)))
            is_regex = rnd.random() < 0.2 and "*" not in raw
            rules.append((i, j, folder, raw, is_regex))
            order.append((folder, raw, is_regex))

    def by_loop(name):
        fallback = None
        for folder, raw, is_regex in order:
            if raw in name:
                return folder
            if raw == "*" and not is_regex:
                fallback = folder
        return fallback

    names = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(400)}
    files = manifest([f"/r/{n}" for n in names])
    table = spark.createDataFrame(rules, "rule_idx int, matcher_idx int, folder string, raw string, is_regex boolean")
    want = {n: by_loop(n) for n in names}
    assert folders(classify_case(files, table.collect())) == want
    assert folders(classify_join(files, table)) == want


def test_hot_names_in_the_join_form(spark, manifest):
    files = manifest([f"/r/{i}/index.html" for i in range(3000)] + ["/r/a/other"])
    got = classify_join(files, rules_of(spark, "Web=html")).groupBy("op_type").count().collect()
    assert {r.op_type: r["count"] for r in got} == {"move": 3000, "skip": 1}


def test_more_patterns_than_one_pass(spark, manifest):
    rows = [(i, 0, f"f{i}", f"^n{i}$", True) for i in range(1200)]
    table = spark.createDataFrame(rows, "rule_idx int, matcher_idx int, folder string, raw string, is_regex boolean")
    files = manifest(["/r/n3", "/r/n777", "/r/n1199", "/r/n1200"])
    assert folders(classify(files, table)) == {"n3": "f3", "n777": "f777", "n1199": "f1199", "n1200": None}


def test_many_regex_rules_as_rows(spark, manifest):
    """Fifty thousand patterns: none is sent to the driver or put in the plan."""
    n = 50_000
    table = spark.range(n).selectExpr(
        "cast(id as int) rule_idx", "0 matcher_idx", "concat('f', id) folder",
        "concat('^(?:x|y)[a-z]*', id, '_?(?:end|fin)[.]t.t$') raw", "true is_regex",
    )
    files = manifest(["/r/xab777_end.txt", "/r/y49999fin.tat", "/r/x12end.txt", "/r/x777.txt", "/r/none"])
    plan = classify_join(files, table)
    assert folders(plan) == {"xab777_end.txt": "f777", "y49999fin.tat": "f49999", "x12end.txt": "f12", "x777.txt": None, "none": None}
    assert "f49998" not in plan._jdf.queryExecution().toString()


FRAGMENTS = {
    "abc": ["abc"], "^abc$": ["abc"], "a.c": ["a\0c"], "ab*c": ["a\0c"], "ab+c": ["ab\0c"], "ab{2,}c": ["ab\0c"], "ab{0,3}cde": ["a\0cde"],
    "foo|bar": ["bar", "foo"], "foo|.*": None, "(foo|bar)x": ["bar", "foo"], "(foo)?x": ["x"], "(?:ab|cd)+efg": ["efg"],
    "[.]pdf": [".pdf"], "[a-z]+": None, ".*": None, "": None, "(?i)abc": None, "a(?i:b)c": None, r"\Qa.b\E+c": ["a.b\0c"],
    r"\d+[.]tar[.]gz": [".tar.gz"], r"x\.y": ["x.y"], r"\x41bc": ["bc"], "[]a]bc": ["bc"], "[[:alpha:]]x": ["x"], "x{,2}": ["x{,2}"],
    "(a|b|)cd": ["cd"], r"\pNab": ["ab"], r"\p{Greek}ab": ["ab"], "(?P<n>ab)c": ["ab"], r"a\bb": ["a\0b"], "ab??c": ["a\0c"], "ab|c.d": ["ab", "c\0d"],
}


def test_fragments():
    assert {p: regex_fragments(p) for p in FRAGMENTS} == FRAGMENTS
    assert glob_fragments("a*bcd?e[xy]") == ["a\0bcd\0e"] and glob_fragments(r"\*ab[]]") == ["*ab"]
    assert glob_fragments("*?") is None and glob_fragments("[^a]*") is None


def test_every_match_holds_a_fragment():
    import re

    rnd = random.Random(11)
    parts = ["a", "b", "ab", "c*", "b+", "(a|bc)", "(ab)?", "[ab]", "[c]", ".", "a{2}", "(b|c)*", "c??", "(?:ca|b+)"]
    for _ in range(3000):
        pattern = "|".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.choice([1, 1, 2])))
        fragments = regex_fragments(pattern)
        for _ in range(8):
            text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))
            if fragments and re.search(pattern, text):
                assert any(all(x in text for x in f.split("\0")) for f in fragments), (pattern, text, fragments)


def test_both_forms_agree_on_patterns(spark, manifest):
    """Patterns with and without fragments, several slices of the latter."""
    from shelfmark.operators import matching

    rnd = random.Random(12)
    pieces = ["a", "b", "ab", "c*", "(a|bc)", "[ab]", ".", "^", "$", "b+", "[.]"]
    rules = [(i, 0, f"f{i}", "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 5))), True) for i in range(60)]
    rules = [r for r in rules if "^*" not in r[3] and "$*" not in r[3]]
    table = spark.createDataFrame(rules, "rule_idx int, matcher_idx int, folder string, raw string, is_regex boolean")
    files = manifest([f"/r/{i}_" + "".join(rnd.choice("abc.") for _ in range(rnd.randint(1, 8))) for i in range(200)])
    before, matching.SLICE = matching.SLICE, 7
    try:
        assert folders(classify_join(files, table)) == folders(classify_case(files, table.collect()))
    finally:
        matching.SLICE = before


def test_comma_inside_a_pattern(spark):
    found = parsed(spark, "F=regex(a{1,2})")
    assert [(r.folder, r.raw, r.is_regex) for r in found.rules.collect()] == [("F", "2})", False)]
    assert [r.message for r in found.warnings.collect()] == ['line 1: malformed regex matcher "regex(a{1"']


def test_line_kinds(spark):
    text = "# c\n//c\n\n # note\n! x/ \nno equals\n =x\nA = b , ,regex(()\r\nB=\nC=d=e"
    found = parsed(spark, text)
    assert sorted((r.rule_idx, r.folder, r.raw) for r in found.rules.collect() if r.raw) == [(8, "A", "b"), (10, "C", "d=e")]
    assert [(r.rule_idx, r.folder) for r in found.rules.collect() if r.raw is None] == [(9, "B")]
    assert [(r.line_no, r.pattern) for r in found.ignores.collect()] == [(5, "x/")]
    assert sorted((r.line_no, r.message) for r in found.warnings.collect()) == [
        (4, "line 4 ignored: missing '='"),
        (6, "line 6 ignored: missing '='"),
        (7, "line 7 ignored: empty folder name"),
        (8, 'line 8: empty matcher in folder "A"'),
        (8, 'line 8: invalid regex "("'),
        (9, 'line 9: empty matcher in folder "B"'),
    ]


def test_file_without_rules_is_an_error(spark, tmp_path):
    (tmp_path / "rules").write_text("!x\n# only comments\n")
    with pytest.raises(ValueError, match="no rules"):
        load_rules(spark, str(tmp_path / "rules"))
    (tmp_path / "good").write_text("A=b\n\nC=*\n")
    assert load_rules(spark, str(tmp_path / "good")).rules.count() == 2


def inline(spark, text):
    return parse_inline(spark.createDataFrame([(text,)], "text string")).collect()


def test_inline(spark):
    assert [(r.folder, r.raw) for r in inline(spark, " Images = jpg,,png ")] == [("Images", "jpg"), ("Images", "png")]
    for bad in ("=jpg", "no equals", "A=regex(x", "A=regex(()"):
        with pytest.raises(Exception, match="invalid|malformed"):
            inline(spark, bad)


def test_listing(spark):
    got = rule_listing(rules_of(spark, "A=b,regex(c.*),d\nE=")).orderBy("rule_idx").collect()
    assert [(r.folder, r.matchers) for r in got] == [("A", "b, regex(c.*), d"), ("E", "")]


ACCEPTED = {
    "(?P<y>[0-9]{4})": [("2024", True), ("x", False)],
    "a$": [("a", True), ("a\n", False)],
    "[[:alpha:]]+[0-9]": [("b7", True), ("7", False)],
    "a.c": [("a\rc", True), ("a\nc", False)],
    r"[\s\d]x": [(" x", True), ("1x", True), ("\x0bx", False)],
    r"\bfoo\b": [("a foo b", True), ("afoo", False)],
    "x{,2}": [("x{,2}", True), ("x", False)],
    "(?i)STRASSE": [("strasse", True)],
    "[a[]": [("[", True), ("b", False)],
    "[a&&b]": [("&", True), ("c", False)],
    r"\Qa.b\E+": [("a.bb", True), ("axb", False)],
    "(?m)^b$": [("a\nb\nc", True)],
    "a|": [("z", True)],
}
REJECTED = ["(", ")", "[a", "a**", "+a", "(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a{1001}", "a{2,1}", "a++", "(?>a)", r"\Z", "x\\", r"\y"]


def test_accepted_patterns(spark):
    for pattern, cases in ACCEPTED.items():
        java = to_java(pattern)
        for text, want in cases:
            got = spark.range(1).select(F.lit(text).rlike(java).alias("m")).first().m
            assert got == want, (pattern, java, text)


@pytest.mark.parametrize("pattern", REJECTED)
def test_rejected_patterns(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


def test_rows_are_enough_for_the_case_form(manifest):
    rules = [Row(rule_idx=0, matcher_idx=0, folder="A", raw="x", is_regex=False)]
    plan = classify_case(manifest(["/r/x"]), rules)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
