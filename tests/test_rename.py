import random
import re

import pytest

from shelfmark.functions import names, numbering
from shelfmark.operators import rename
from shelfmark.operators.rename import mapped_names, rename_plan, resolve_collisions


def greedy(proposed):
    """The loop that the tables must reproduce."""
    seen, out = set(), []
    for name in proposed:
        m = re.search(r"[.][^./]*\Z", name)
        ext = m[0] if m else ""
        stem, n, final = name[: len(name) - len(ext)], 1, name
        while final in seen:
            final = f"{stem}_v{n}{ext}"
            n += 1
        seen.add(final)
        out.append(final)
    return out


def resolved(spark, proposed):
    rows = [(f"/r/{i:06d}", n) for i, n in enumerate(proposed)]
    df = spark.createDataFrame(rows, "source_path string, new_name string")
    got = {r.source_path: r.final_name for r in resolve_collisions(df).collect()}
    return [got[p] for p, _ in rows]


@pytest.mark.parametrize(
    "proposed",
    [
        ["a.txt", "a.txt", "a_v1.txt", "a.txt"],
        ["a_v1", "a", "a", "a", "a_v1", "a_v1_v1"],
        ["x.", "x.", "x", "x"],
        ["a_v2", "a", "a", "a", "a_v0", "a_v01", "a_v0"],
        ["a"],
    ],
)
def test_cases(spark, proposed):
    assert resolved(spark, proposed) == greedy(proposed)


def test_random_batches(spark):
    rnd = random.Random(11)
    proposed = []
    for family in range(80):
        for _ in range(rnd.randint(1, 25)):
            name = f"s{family}"
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
                version = rnd.randint(1, 4) if rnd.random() < 0.9 else rnd.choice(["0", "01", "9" * 30])
                name += f"_v{version}"
            proposed.append(name + rnd.choice(["", ".t"]))
    rnd.shuffle(proposed)
    assert resolved(spark, proposed) == greedy(proposed)


def test_one_name_holds_most_files(spark):
    rnd = random.Random(2)
    proposed = ["n.t"] * 3000 + [f"n_v{i}.t" for i in range(1, 400, 3)] + [f"u{i}" for i in range(500)]
    rnd.shuffle(proposed)
    assert resolved(spark, proposed) == greedy(proposed)


@pytest.mark.parametrize("seed", range(40))
def test_thresholds_stand_for_the_walk(seed):
    rnd = random.Random(seed)
    limits = [rnd.randint(-3, rnd.choice([5, 40, 10**12])) for _ in range(rnd.randint(0, 60))]
    above = rename.added_above(limits)
    assert above == sorted(above)
    for start in range(70):
        s = start
        for limit in limits:
            s += s < limit
        assert s - start == sum(t > start for t in above)


@pytest.mark.parametrize("block", [1, 7, 60])
def test_versions_of_a_name_over_many_tasks(spark, monkeypatch, block):
    """One name has most explicit versions; they are walked in blocks that cut it anywhere."""
    monkeypatch.setattr(rename, "VERSION_BLOCK", block)
    rnd = random.Random(block)
    names = ["n"] * 150 + [f"n_v{rnd.randint(1, 250)}" for _ in range(20 * min(block, 6) + 5)]
    names += [f"m{i % 3}_v{rnd.randint(1, 9)}" for i in range(12)] + [f"m{i % 3}" for i in range(20)]
    rnd.shuffle(names)
    assert resolved(spark, names) == greedy(names)


def test_numbering_without_groups(spark):
    df = spark.range(5000).selectExpr("id", "reverse(cast(id as string)) as k")
    got = numbering.number_rows(df, ["k", "id"]).collect()
    want = sorted(((r.k, r.id) for r in got))
    assert {(r.k, r.id): r.row_no for r in got} == {k: i for i, k in enumerate(want, start=1)}


def test_plan_keeps_folders(manifest):
    from pyspark.sql import functions as F

    plan = rename_plan(manifest(["/r/a/x", "/r/b/y"]).withColumn("new_name", F.lit("n.t")))
    assert {r.source_path: r.dest_path for r in plan.collect()} == {"/r/a/x": "/r/a/n.t", "/r/b/y": "/r/b/n_v1.t"}


def test_mapping(spark, manifest):
    files = manifest(["/r/a", "/r/b"])
    table = spark.createDataFrame([("/r/a", " \t"), ("/r/b", "c")], "source_path string, new_name string")
    assert {r.source_path: r.new_name for r in mapped_names(files, table).collect()} == {"/r/a": "a", "/r/b": "c"}
    with pytest.raises(Exception, match="no name for /r/b"):
        mapped_names(files, table.limit(1)).collect()
    with pytest.raises(Exception, match="unknown file"):
        mapped_names(files.limit(1), table).collect()


NAMES = {
    "Abstract_Algebra---Notes.pdf": "Abstract_Algebra_Notes.pdf",
    "docker-compose-dev.yml": "Docker_Compose_Dev.yml",
    "API_ENDPOINT_SPEC_v3.json": "API_Endpoint_Spec_v3.json",
    "Invoice_2024-12-01_paid.pdf": "Invoice_2024_12_01_Paid.pdf",
    "receipt jan 24 grocery.jpeg": "Receipt_Jan_24_Grocery.jpeg",
    "MyProjectFile_Final_v2.java": "My_Proj_v2.java",
    "lab_experiment_1 (1).txt": "LAB_Exp_1.txt",
    "sem_05 notes.txt": "S5_Notes.txt",
    "FALLSEM2025-26_x": "F25-26_X",
    "Fall_s25-26.pdf": "F25-26.pdf",
    "WINTERSEM2025-26": "W25-26",
    "2024-2025 plan.doc": "2024_25_Plan.doc",
    "photo_20240131_123456.png": "Photo_20240131.png",
    "photo_20241331.png": "Photo.png",
    "dsa DSA Question Paper": "DSA_QP",
    "Department_of_x.txt": "Department_Of_X.txt",
    "Department_Faculty_of_Fluid_Mechanics_Lab_Manual.txt": "Of_Fluid_Mechanics_LAB_Manual.txt",
    "copy.final.txt": "copy.final.txt",
    "introduction": "Intro",
    "Copy of notes (2).txt": "Notes.txt",
    "Microsoft Word - Resume_John.docx": "Resume_John.docx",
}


def test_normalized_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: r.out for r in names.with_normalized_name(df, "n", "out").collect()}
    assert got == NAMES
