"""Document checks and store readers on small awkward tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from darkroom.operators import documents
from darkroom.sources import readers


def test_files_named_in_backticks(spark):
    rows = [
        ("docs/a.md", "`src/x.py` and `src/x.py`, `b.md`, `sub/c.md`, `/well-known/y.json`, `gone/z.toml`, `../docs/d.yml`, plain src/q.py"),
        ("e.md", "`docs/a.md` `./src/x.py` `no/t.ts`"), (None, "`src/x.py` `no/where.tsx`"), ("f.md", None), ("g.md", ""),
    ]
    docs = spark.createDataFrame(rows, "path string, text string")
    there = spark.createDataFrame([("src/x.py",), ("docs/sub/c.md",), ("docs/a.md",), ("docs/d.yml",), (None,)], "target string")
    got = {tuple(r) for r in documents.missing_paths(docs, there).collect()}
    assert got == {("gone/z.toml", "docs/a.md", 1), ("no/t.ts", "e.md", 1), ("no/where.tsx", None, 1)}


def test_commands_that_are_no_target(spark):
    docs = spark.createDataFrame([("a", "`make test` `make test` `make lint-all x`"), ("b", "make up `make Up`"), (None, "`make gone`")], "path string, text string")
    known = spark.createDataFrame([("test",), ("test",), (None,)], "command string")
    assert {tuple(r) for r in documents.unknown_commands(docs, known).collect()} == {("lint-all", "a", 1), ("gone", None, 1)}


@pytest.mark.parametrize("together", [1, 2, 1000])
def test_keys_no_document_names(spark, together):
    docs = spark.createDataFrame([("MI-GAN and Big LaMa",), (None,), ("Real ESRGAN x2!",)], "text string")
    keys = spark.createDataFrame([("migan",), ("big-lama",), ("real-esrgan-x2",), ("sam2",), ("sam2",), ("clip",)], "key string")
    got = sorted(r.key for r in documents.undocumented_keys(keys, docs, together=together).collect())
    assert got == ["clip", "sam2"]
    assert documents.undocumented_keys(keys.limit(0), docs).collect() == []
    assert documents.undocumented_keys(keys, docs.limit(0)).count() == 5


def test_open_items_without_a_trigger(spark):
    text = "intro Status: open\n### TD-1 — one\nStatus: open\nwhy\n### TD-2 — two\nStatus: open\n**Trigger:** now\n### TD-3 — three\nStatus: done\n### TD-4 — four\nStatus: open"
    docs = spark.createDataFrame([("r.md", text), ("s.md", "no items"), ("t.md", None)], "path string, text string")
    assert [tuple(r) for r in documents.open_without_trigger(docs, "### TD-").collect()] == [("r.md", "1 — one"), ("r.md", "4 — four")]


@pytest.mark.parametrize("parts", [1, 2, 7, 16, 300])
def test_each_key_meets_one_range(spark, parts):
    keys = [None, "", "00000000-0000", "ffffffff", "zz", "ABC", "7f", "80", "8"] + [format(i * 7919 % 65536, "04x") + "rest" for i in range(2000)]
    ranges = readers.key_ranges("id", parts)
    assert len(ranges) == parts
    df = spark.createDataFrame([(k,) for k in keys], "id string").withColumn("n", F.array(*[F.expr(f"cast(coalesce({r}, false) as int)") for r in ranges]))
    per = [0] * parts
    for row in df.collect():
        assert sum(row.n) == 1
        per[row.n.index(1)] += 1
    assert max(per) < 3 * 2009 / parts + 20


def test_read_degree_follows_the_rows():
    assert [readers.read_degree(n, 100) for n in (0, 1, 100, 101, 10**9)] == [1, 1, 1, 2, 65_536]
    assert set(readers.STORE_KEYS) == set(readers.STORE)


class Source:
    """Records what a JDBC read is asked for."""

    def __init__(self, rows):
        self.rows, self.reads = rows, []
        self.read = self

    def format(self, name):
        return self

    def options(self, **options):
        return self

    def load(self):
        return self

    def first(self):
        return {"n": self.rows, "low": 1, "high": self.rows}

    def jdbc(self, url, table, **how):
        self.reads.append((table, how))
        return table


@pytest.mark.parametrize("rows,parts", [(10, 1), (1000, 10)])
def test_every_table_is_read_in_parts(rows, parts):
    source = Source(rows)
    readers.load_store(source, "jdbc:any", {"user": "u"}, per_read=100)
    for table, how in source.reads:
        assert how["properties"] == {"user": "u", "customSchema": readers.STORE[table]}
        if parts > 1 and readers.STORE_KEYS[table][1]:
            assert (how["column"], how["lowerBound"], how["upperBound"], how["numPartitions"]) == ("id", 1, rows, parts)
        elif parts > 1:
            assert how["predicates"] == readers.key_ranges(readers.STORE_KEYS[table][0], parts)
        else:
            assert set(how) == {"properties"}
