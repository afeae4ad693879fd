"""Dumps read in ranges of bytes: every tuple once, wherever the cuts fall."""

import gzip

import pytest
from pyspark.sql import functions as F

from lexiforge.sources import dumpsource as D
from lexiforge.sources import office


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    lines, want, n = ["-- head", "CREATE TABLE `page` (a int);"], [], 0
    for k in range(60):
        rows = []
        for _ in range(1 + k % 5):
            title = ["Plain", "O\\'Hare, (x)", "龍山寺", "a\\\\b", ""][n % 5] + str(n)
            rows.append(f"({n},{n % 3},'{title}',NULL)")
            want.append((n, str(n % 3), title.replace("\\'", "'").replace("\\\\", "\\")))
            n += 1
        lines.append(f"INSERT INTO `page` VALUES {','.join(rows)};")
    text = "\n".join(lines) + "\n-- end"
    (folder / "page.sql").write_text(text)
    return folder, text, want


def read(spark, path, schema=None, **options):
    D.use_dumps(spark)
    reader = spark.read.format("sql_dump").option("columns", "id,namespace,title,extra").options(**options)
    return (reader.schema(schema) if schema else reader).load(str(path))


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_lines_belong_to_one_range(dump, size):
    folder, text, _ = dump
    data = text.encode()
    found = [x for a in range(0, len(data), size) for x in D.statements(str(folder / "page.sql"), a, min(a + size, len(data)))]
    assert "".join(line for _, line in found) == text and all(data[at : at + 5] == line.encode()[:5] for at, line in found)


def test_each_tuple_once_over_many_tasks(spark, dump):
    folder, _, want = dump
    df = read(spark, folder / "page.sql", splitBytes=200)
    assert df.rdd.getNumPartitions() > 10
    got = df.select(F.col("id").cast("int").alias("id"), "namespace", "title").collect()
    assert sorted(map(tuple, got)) == want
    first = df.orderBy("statement", "pos").first()
    assert first.fields == ["0", "0", "Plain0", "NULL"] and first.pos == 0 and first.file.endswith("page.sql")
    assert df.filter("statement < 0").count() == 0


def test_few_columns_and_filters(spark, dump):
    folder, _, want = dump
    few = read(spark, folder / "page.sql", "id long, title string, extra double", splitBytes=300)
    assert sorted((r.id, r.title) for r in few.collect()) == [(i, t) for i, _, t in want] and few.filter("extra is not null").count() == 0
    some = read(spark, folder / "page.sql", "id long, namespace string", splitBytes=300).filter("namespace = '1' and id > 30")
    assert sorted(r.id for r in some.collect()) == [i for i, ns, _ in want if ns == "1" and i > 30]
    assert " = 1)" not in some._jdf.queryExecution().executedPlan().toString()  # settled by the source
    with pytest.raises(Exception, match="no place in a tuple"):
        read(spark, folder / "page.sql", "other string").collect()


def test_filters_are_settled_while_reading(dump):
    from pyspark.sql import types as T

    folder, _, want = dump
    reader = D.DumpReader(T.StructType.fromDDL("id long, namespace string"), {"path": str(folder / "page.sql"), "columns": "id,namespace,title", "splitBytes": "500"})
    left = list(reader.pushFilters([D.EqualTo(("namespace",), "2"), D.EqualTo(("id",), 4)]))
    assert left == [D.EqualTo(("id",), 4)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == [i for i, ns, _ in want if ns == "2"]


def test_compressed_dumps_and_folders(spark, dump, tmp_path):
    _, text, want = dump
    for name in ("a.sql.gz", "b.sql.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    (tmp_path / "c.sql").write_text("")
    df = read(spark, tmp_path, "file string, id long")
    assert df.rdd.getNumPartitions() == 2 and df.count() == 2 * len(want) and df.select("file").distinct().count() == 2
    lines = office.read_dump(spark, str(tmp_path / "a.sql.gz")).count()
    assert lines == len(want)
