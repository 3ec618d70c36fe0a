"""Documents with everything an operator must bear, and a seeded maker of ordinary ones."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " node long, _key string, label int, size string, n_files int, component_id string, tokens int,"
    " cluster int, block int, position string, n_lines string, _row int, _id int, hash string, words int,"
    " score string, target int, n_tokens string, ids int, start int, kept int"
)
WORDS = [a + b for a in "ba de fi go lu mo ne pa ri su ta vo".split() for b in "n r l st nd m ck".split()]


def prose(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", " ", " ", ". ", "\n"]) for _ in range(n)).strip()


def near_copy(rnd: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with clashing columns around them."""
    kinds = [f.strip().split(" ")[1] for f in SCHEMA.split(",")][5:]
    extra = tuple("x" if k == "string" else 1 for k in kinds)
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *extra) for i, t, g, s in rows], SCHEMA)


def odd_rows(seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(5, 120)) for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, near_copy(rnd, t, rnd.choice([0, 1, 2, 6])), "en", "s0") for i, t in enumerate(base)]
    rows += [(200 + i, near_copy(rnd, base[7], 1), "de", None) for i in range(15)]
    rows += [
        (300, None, None, None),
        (301, "", "en", ""),
        (302, " \t\n\x0b\x0c\r ", None, "s1"),
        (303, "one", "en", "s1"),
        (304, "ONE", "en", "s1"),
        (305, "one two three", "en", "s1"),
        (306, "one two three", "fr", "s1"),
        (None, base[3], "en", "s2"),
        (None, "alone without id", None, "s2"),
        (307, "ünï cödé 字 😀  x 123 !!", "de", "ß"),
        (308, prose(rnd, 20_000), "en", "s1"),
        (309, "x" * 70_000, "en", "s1"),
    ]
    rows += [rows[1], rows[1], rows[-1]]
    return rows
