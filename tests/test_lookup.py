import datetime as dt
import random

import pytest

from dumpdeck.operators import history, lookup


@pytest.fixture
def log(spark):
    random.seed(3)
    words = ["select", "Über", "x", "", "ſtra\U0001f600ße", "FROM t", "  ", "aaa", "İstanbul", "ΣΑΣ"]
    rows = []
    for n in range(600):
        text = None if n % 50 == 0 else " ".join(random.choices(words, k=n % 7))
        database = None if n % 41 == 0 else ("Hot" if n % 3 else random.choice(["a", "B", "hOT", ""]))
        rows.append((database, text, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n // 5), n, 1, "own"))
    rows += rows[:20]
    rows.append(("long", "ab" * 100_000 + "needle" + "ba" * 100_000, None, -1, 0, None))
    return spark.createDataFrame(rows, "database_path string, sql string, executed_at timestamp, id int, gram int, key string")


def key(rows):
    return sorted(map(repr, rows.collect()))


def test_search_index_equals_the_scan(spark, log, tmp_path):
    path = str(tmp_path / "index")
    lookup.write_search_index(log, path, parts=5)
    for term in (None, " ", "x", "ü", "über", "SELECT x", "aaa", "aaaaa", "e\U0001f600", "a\U0001f600SS", "\U0001f600ß", "needle", "nowhere", "σα", "i"):
        for database in random.sample(["B", "", "long", "none"], 1) + ["hot"]:
            scan = history.search(log, database, term)
            assert key(lookup.search_index(spark, path, database, term)) == key(scan), (database, term)
        everywhere = history.containing(log.filter("database_path IS NOT NULL"), term)
        assert key(lookup.search_index(spark, path, None, term)) == key(everywhere), term
    times = [r.executed_at for r in lookup.search_index(spark, path, "hot", "select").collect()]
    assert times == sorted(times, reverse=True)


def test_search_index_of_nothing(spark, log, tmp_path):
    path = str(tmp_path / "index")
    lookup.write_search_index(log.filter("id > 10000"), path, parts=3)
    assert lookup.search_index(spark, path, "hot", "select").count() == 0
    assert lookup.search_index(spark, path).count() == 0


def test_search_names_only_parts_with_the_term(spark, log, tmp_path):
    path = str(tmp_path / "index")
    lookup.write_search_index(log, path, parts=5)
    plan = lookup.search_index(spark, path, None, "needle")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert f"{lookup.PART}#" in filters and " = " in filters


@pytest.fixture
def catalog(spark):
    random.seed(5)
    names = ["id", "ID", "Id_user", "", "ide\U0001f600", "Straße", "STRASSE", "\U0001f600x", "idx" * 3000, None]
    names += ["".join(random.choices("abAB", k=random.randrange(6))) for _ in range(900)]
    rows = [(n, random.choice([None, 0, 90, 100, 200]), 1) for n in names]
    return spark.createDataFrame(rows + [("Hot", 100, 1)] * 500, "name string, priority int, shared int")


def test_dictionary_equals_the_scan(spark, catalog, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "NAMES", 16)
    path = str(tmp_path / "names")
    lookup.write_dictionary(catalog, path, parts=4)
    for prefix in ("", "a", "AB", "abab", "id", "idxidx", "ide\U0001f600", "stra", "strasse", "hot", "\U0001f600", "zz", "%", "_"):
        scan = history.starts_with(catalog.select("name", "priority"), prefix)
        assert key(lookup.dictionary_names(spark, path, prefix)) == key(scan), prefix
        for keep in (1, 7, 100):
            top = history.prefix_top(catalog.select("name", "priority"), prefix, keep).collect()
            assert lookup.dictionary_top(spark, path, prefix, keep).collect() == top, (prefix, keep)


def test_dictionary_decodes_few_blocks(spark, tmp_path):
    names = spark.range(20_000).selectExpr("concat('n', lpad(id, 6, '0')) AS name", "cast(id % 997 AS int) AS priority")
    path = str(tmp_path / "names")
    lookup.write_dictionary(names, path, parts=3)
    blocks = spark.read.parquet(path)
    assert blocks.selectExpr("sum(size(entries))").first()[0] == 20_000
    stored = blocks.selectExpr("explode(entries) AS e").selectExpr("sum(length(e.rest))").first()[0]
    assert stored < 20_000 * 2.5
    assert [r.name for r in lookup.dictionary_top(spark, path, "N", 3).collect()] == ["n000996", "n001993", "n002990"]


def test_dictionary_of_nothing(spark, catalog, tmp_path):
    path = str(tmp_path / "names")
    lookup.write_dictionary(catalog.filter("name IS NULL"), path, parts=2)
    assert lookup.dictionary_top(spark, path, "a").count() == 0
