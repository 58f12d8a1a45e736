"""Provider pages: filters in the scan, pages that are never opened, and a stream that goes on where it stopped."""

from __future__ import annotations

import glob
import os
import random
import re
import shutil

import pytest

from evidencelake.sources import pages

ROWS = [(f"W{k:05d}", f"10.{1000 + k // 40}/x{k}" if k % 9 else None, f"title {k}", 1990 + k // 10 if k % 7 else None, ("article", "preprint", None)[k // 50 % 3], (True, False, None)[k % 3], k // 20) for k in range(300)]
COLUMNS = "id string, doi string, title string, year int, type string, is_open_access boolean, page int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    pages.write_pages(spark.createDataFrame([*ROWS, ("lost", None, "no page", None, None, None, None)], COLUMNS), path)
    return path


FILTERS = [
    ("year >= 2010", lambda r: r[3] is not None and r[3] >= 2010), ("year < 1995", lambda r: r[3] is not None and r[3] < 1995), ("year = 2000", lambda r: r[3] == 2000), ("type IN ('preprint', 'book')", lambda r: r[4] == "preprint"), ("is_open_access", lambda r: r[5] is True),
    ("startswith(doi, '10.1003/')", lambda r: (r[1] or "").startswith("10.1003/")), ("doi LIKE '10.100%'", lambda r: (r[1] or "").startswith("10.100")), ("doi = '10.1002/x100'", lambda r: r[1] == "10.1002/x100"), ("id IN ('W00005', 'W00250', 'none')", lambda r: r[0] in ("W00005", "W00250")), ("id LIKE 'W0010%'", lambda r: r[0].startswith("W0010")),
    ("year > 1999 AND type = 'article' AND NOT is_open_access", lambda r: r[3] is not None and r[3] > 1999 and r[4] == "article" and r[5] is False), ("year = 1991 OR type = 'preprint'", lambda r: r[3] == 1991 or r[4] == "preprint"), ("year IS NULL", lambda r: r[3] is None), ("length(title) > 8", lambda r: len(r[2]) > 8), ("year = 1700", lambda r: False),
]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters(spark, folder, k):
    condition, wanted = FILTERS[k]
    got = sorted(map(tuple, pages.read_pages(spark, folder).where(condition).collect()), key=repr)
    assert got == sorted((r[:6] for r in ROWS if wanted(r)), key=repr)


def test_plan_and_unopened_pages(spark, folder, tmp_path):
    """The plan has no filter above the scan, and pages that cannot match may be gone."""
    path = f"{tmp_path}/copy"
    shutil.copytree(folder, path)
    for name in glob.glob(f"{path}/pages/page=*"):
        if int(name.rsplit("=", 1)[1]) not in (10, 11):  # records 200 to 239: years 2010 to 2013
            shutil.rmtree(name)
    found = pages.read_pages(spark, path).where("year >= 2010 AND year < 2014 AND is_open_access")
    assert not re.search(r"\bFilter \(", found._jdf.queryExecution().executedPlan().toString())
    assert {r.id for r in found.collect()} == {r[0] for r in ROWS if r[3] is not None and 2010 <= r[3] < 2014 and r[5]}
    assert found.rdd.getNumPartitions() == 2
    assert {r.id for r in pages.resolve_doi(spark, path, "10.1005/x205").collect()} == {"W00205"}
    assert {r.id for r in pages.by_ids(spark, path, ["W00201", "W00239"]).collect()} == {"W00201", "W00239"}
    assert {r.id for r in pages.of_prefix(spark, path, "10.1005").collect()} == {r[0] for r in ROWS if (r[1] or "").startswith("10.1005/")}


def test_index_never_hides_a_record():
    """Whatever the filter, a page that the index leaves out has no record that passes."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

    r = random.Random(1)
    names = ["id", "doi", "title", "year", "type", "is_open_access"]
    for _ in range(3_000):
        rows = [dict(zip(names, x[:6], strict=True)) for x in r.sample(ROWS, r.randint(1, 6))]
        values = lambda n: [x[n] for x in rows if x[n] is not None]  # noqa: E731, B023
        entry = {"types": values("type"), "prefixes": [d.split("/")[0] for d in values("doi")], "open": values("is_open_access")} | {f"{e}_{n}": f(values(n)) for n in ("id", "year") for e, f in (("low", min), ("high", max)) if values(n)}
        name = r.choice(names)
        value = r.choice([x for x in ROWS if x[names.index(name)] is not None])[names.index(name)]
        kinds = [EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual] + ([StringStartsWith] if isinstance(value, str) else [])
        wanted = r.choice([*(k((name,), value) for k in kinds), In((name,), (value, value)), IsNotNull((name,))])
        if isinstance(wanted, StringStartsWith):
            wanted = StringStartsWith((name,), value[: r.randint(0, len(value))])
        assert pages.supported(wanted)
        if any(pages.holds(wanted, x) for x in rows):
            assert pages.possible(wanted, entry)


def test_stream_resumes_at_its_cursor(spark, folder, tmp_path):
    path, out, state = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/state"
    frame = spark.createDataFrame(ROWS, COLUMNS)
    run = lambda: pages.stream_pages(spark, path).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(120)
    pages.write_pages(frame.where("page < 6"), path)
    assert run()
    assert spark.read.parquet(out).count() == 120
    for name in glob.glob(f"{path}/pages/page=[0-5]"):
        shutil.rmtree(name)  # read before: never opened again
    pages.write_pages(frame.where("page < 9"), f"{tmp_path}/more")
    for name in glob.glob(f"{tmp_path}/more/pages/page=[678]"):
        shutil.copytree(name, f"{path}/pages/{os.path.basename(name)}")
    shutil.rmtree(f"{path}/index")
    shutil.copytree(f"{tmp_path}/more/index", f"{path}/index")
    assert run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(r[0] for r in ROWS if r[6] < 9)
    assert run()
    assert spark.read.parquet(out).count() == 180


def test_odd_folders(spark, tmp_path):
    path = f"{tmp_path}/none"
    pages.write_pages(spark.createDataFrame([], COLUMNS), path)
    assert pages.read_pages(spark, path).count() == 0 and pages.read_pages(spark, path).where("year > 1").count() == 0
    with pytest.raises(ValueError, match="opened as files"):
        pages.index_of("s3://bucket/pages")
