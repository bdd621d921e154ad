"""CSV with line breaks in quotes, read by splits, against Spark's reading by file."""

import random

import pytest
from compare import executed_plan

from fieldtally import fixed_values as fixed
from fieldtally.sources import quoted, snapshots

HEADER = "a,b c,\"d\ne\",f"


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def text_of(rnd, most):
    return "".join(rnd.choice(["x", "é", " ", ",", '""', "\n", "\n\n", "'", "\\", "y"]) for _ in range(rnd.randrange(most)))


def file_of(seed, n, most):
    rnd = random.Random(seed)
    lines = [HEADER]
    for i in range(n):
        lines.append(",".join([str(i), *[f'"{text_of(rnd, most)}"' for _ in range(2)], rnd.choice(["", "z", '""'])]))
        if rnd.random() < 0.05:
            lines.append("")
    return "\n".join(lines) + rnd.choice(["", "\n"])


def by_file(spark, path):
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, n, most", [(1, 60, 6), (2, 40, 60), (3, 12, 900), (4, 1, 3), (5, 0, 1)])
def test_splits_give_the_cells_of_whole_files(spark, tmp_path, small_splits, seed, n, most):
    path = tmp_path / "odd.csv"
    path.write_bytes(file_of(seed, n, most).encode())
    wanted = by_file(spark, str(path))
    found = quoted.read_text(spark, str(path))
    assert found.columns == wanted.columns
    assert cells(found) == cells(wanted)


def test_several_files_and_a_record_over_several_splits(spark, tmp_path, small_splits):
    long = "line\n" * 300
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'a,b\n{i},"{long}{i}"\n{i}0,"x ""y"""\n')
    # Without its closing quote a record ends with the file.
    (tmp_path / "3.csv").write_text('a,b\n3,"open\nend\n')
    found = cells(quoted.read_text(spark, str(tmp_path)))
    wanted = [("3", "open\nend")] + [row for i in range(3) for row in ((str(i), f"{long}{i}"), (f"{i}0", 'x "y"'))]
    assert [r for r in found if r[0] != "3"] == sorted(wanted[1:], key=str)
    assert next(r for r in found if r[0] == "3")[1].strip() in ("open\nend", '"open\nend')
    parities = quoted.split_parities(spark, str(tmp_path)).collect()
    # One row per split that holds the beginning of a line, none of it from the text itself.
    assert len(parities) > 20 and len({(r.file, r.block) for r in parities}) == len(parities)


def test_line_breaks_of_two_characters(spark, tmp_path, small_splits):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert cells(quoted.read_text(spark, str(path))) == cells(by_file(spark, str(path)))


def test_a_large_file_keeps_its_splits(spark, tmp_path, small_splits):
    path = tmp_path / "counts.csv"
    path.write_text(file_of(7, 400, 20))
    lines = spark.read.option("lineSep", "\n").text(str(path))
    splits = lines.select("_metadata.file_block_start").distinct().count()
    assert splits > 8 and quoted.split_parities(spark, str(path)).count() == splits
    found = quoted.records(spark, str(path))
    assert found.where("is_header").count() == 1
    # Whole records are not shuffled: the only exchange is that of the pieces.
    plan = executed_plan(found)
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan
    assert lines.rdd.getNumPartitions() >= 8


def test_counts_with_line_breaks(spark, tmp_path, small_splits):
    columns = list(fixed.COUNTS_HEADER)
    row = {c: "x" for c in columns} | {"TellingSortOrder": "1", "Teldatum": "2000-01-15", "Aantal": "7"}
    rows = [row | {"Gebied": f'Polder\n"{i}"'} for i in range(50)]
    quoted_row = [",".join('"' + r[c].replace('"', '""') + '"' for c in columns) for r in rows]
    (tmp_path / "counts.csv").write_text("\n".join([",".join(columns), *quoted_row]) + "\n")
    found = snapshots.read_counts(spark, str(tmp_path)).collect()
    assert sorted(r.location for r in found) == sorted(r["Gebied"] for r in rows)
    assert {r.individuals for r in found} == {7}
    with pytest.raises(ValueError, match="no way"):
        snapshots.read_counts(spark, str(tmp_path), "some")
