"""Entry files with broken entries, payloads that drift, and stored tables whose commits touch few buckets."""

from pathlib import Path

import pytest

from corpuslens.operators import enrich, ingest
from corpuslens.sources.buckets import BucketedTable
from corpuslens.sources.files import read_drifting, read_entry_files

GOOD = (
    "<entry><id>http://h/abs/{i}v1</id><title>T &amp; {i}</title><summary>S</summary><published>2016-01-01T00:00:00Z</published>"
    '<updated>2016-02-01T00:00:00Z</updated><author><name>A</name></author><arxiv:primary_category term="x"/></entry>'
)


def test_entry_files(spark, tmp_path):
    head = '<?xml version="1.0"?>\n<feed xmlns:arxiv="http://n"><title>entries</title>\n'
    unclosed = "<entry><id>http://h/abs/7.7v1</id><title>never closed</title>\n"
    broken = "<entry><id>http://h/abs/8.8v1</id><title>no end</entry>"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text(head + GOOD.format(i="1.1") + "\n" + broken + GOOD.format(i="1.2") + unclosed + GOOD.format(i="1.3") + "</feed>")
    (tmp_path / "sub" / "b.xml").write_text(head + GOOD.format(i="1.4") + GOOD.format(i="1.5")[:120])
    (tmp_path / "c.xml").write_text(head + "</feed>")
    entries = read_entry_files(spark, str(tmp_path))
    good, bad = ingest.split_bad(ingest.parse_entries(entries))
    assert {(r.arxiv_id, r.title, r.primary_category, r.file) for r in good.collect()} == {
        ("1.1", "T & 1.1", "x", "a.xml"), ("1.2", "T & 1.2", "x", "a.xml"), ("1.3", "T & 1.3", "x", "a.xml"), ("1.4", "T & 1.4", "x", "b.xml"),
    }
    errors = sorted(r.error for r in bad.collect())
    assert len(errors) == 3 and errors[:2] == ["broken entry"] * 2


def test_large_entry_file_is_split(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed>" + "\n".join(GOOD.format(i=f"1.{i}") for i in range(500)) + "</feed>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_entry_files(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert ingest.split_bad(ingest.parse_entries(rows))[0].select("arxiv_id").distinct().count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_payloads_that_drift(spark):
    rows = ['{"a": 1, "b": {"c": "x"}}', '{"a": "7", "new": [1, {"z": null}]}', '{"a": [1], "b": 3}', '{"a": null}', "{cut", None, "[1]", "{}"]
    found = read_drifting(spark.createDataFrame(list(enumerate(rows)), "id int, payload string"), {"a": ("$.a", "int"), "c": ("$.b.c", "string")})
    got = {r.id: (r.a, r.c, r.unknown, r.clashes, r.is_object) for r in found.collect()}
    assert got == {
        0: (1, "x", {}, [], True), 1: (7, None, {"new": '[1,{"z":null}]'}, [], True), 2: (None, None, {}, ["a: ARRAY<BIGINT>"], True),
        3: (None, None, {}, [], True), 4: (None, None, {}, [], False), 5: (None, None, {}, [], False), 6: (None, None, {}, [], False), 7: (None, None, {}, [], True),
    }
    assert found.filter("id < 0").count() == 0


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "/data/" in str(p)}


def state(table):
    return {(r.run, r.k): r.v for r in table.rows().collect()}


@pytest.fixture
def table(spark, tmp_path):
    out = BucketedTable(spark, str(tmp_path / "t"), "run int, k int, v string, seq int", ["run", "k"], ["run"], 8)
    assert out.rows().count() == 0 and out.version() == 0
    rows = [(run, k, "old", 1) for run in range(40) for k in range(3)]
    assert out.upsert(spark.createDataFrame(rows, out.schema), "seq") == 1
    return out


def test_commits_touch_their_buckets_only(spark, table):
    before, folders, early = files(table.path), table.manifest(1), table.rows()
    rows = [(3, 0, "new", 2), (3, 1, "late", 0), (3, 9, "more", 1)]
    assert table.upsert(spark.createDataFrame(rows, table.schema), "seq") == 2
    want = {(run, k): "old" for run in range(40) for k in range(3)} | {(3, 0): "new", (3, 9): "more"}
    assert state(table) == want
    changed = {b for b, folder in table.manifest(2).items() if folders[b] != folder}
    assert len(changed) == 1 and len(folders) > 4
    assert {p: t for p, t in files(table.path).items() if p in before} == before  # nothing was rewritten in place
    assert {r.v for r in early.collect()} == {"old"}  # who began before reads on what was there
    assert table.remove(spark.createDataFrame([(3,), (5,), (99,)], "run int")) == 3
    assert state(table) == {k: v for k, v in want.items() if k[0] not in (3, 5)}
    table.vacuum()
    assert state(table) == {k: v for k, v in want.items() if k[0] not in (3, 5)} and len(table._names("commits")) == 1


def test_half_a_commit_is_not_seen(spark, table, monkeypatch):
    want = state(table)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", dies)
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([(1, 1, "new", 5)], table.schema), "seq")
    assert state(table) == want and table.version() == 1
    other = BucketedTable(spark, table.path, "run int, k int, v string, seq int", ["run", "k"], ["run"], 8)
    manifest = other.manifest(1)
    table.upsert(spark.createDataFrame([(1, 1, "first", 5)], table.schema), "seq")
    with pytest.raises(RuntimeError):
        other._publish(manifest, 2)  # it began at version 1 too
    assert state(table)[1, 1] == "first" and table.version() == 2
    assert table.upsert(spark.createDataFrame([], table.schema), "seq") == 2  # nothing to change
    table.remove(spark.createDataFrame([(i,) for i in range(40)], "run int"))
    assert table.rows().count() == 0


def test_institutions_and_venues(spark):
    import json

    site = lambda **x: x
    works = [
        (1, {"authorships": [{"author": {"id": "A1"}, "institutions": [site(id="I1", display_name="One"), site(display_name=" Two ")]}, {"author": {}, "institutions": [site(id="I9")]}],
             "primary_location": {"source": {"id": "V1", "display_name": "Venue"}}}),
        (2, {"authorships": [{"author": {"id": "A1"}, "institutions": [site(id="I1", display_name="Uno", country_code="ES"), site()]}, {"author": {"id": "A2"}}],
             "primary_location": {"source": {"id": "V2", "display_name": "Other", "type": "journal"}}}),
        (3, {"primary_location": None}),
    ]
    typed = enrich.read_works(spark.createDataFrame([(i, json.dumps(x)) for i, x in works] + [(4, None)], "paper_id long, payload string")).cache()
    none = spark.createDataFrame([], "institution_id string")
    new, links = enrich.institution_links(typed, none, spark.createDataFrame([(2, "A1", "I1")], "paper_id long, author_id string, institution_id string"))
    assert {tuple(r) for r in new.collect()} == {("I1", "Uno", "ES"), ("two", " Two ", None)}
    assert {tuple(r) for r in links.collect()} == {(1, "A1", "I1"), (1, "A1", "two")}
    new, links = enrich.venue_links(typed, spark.createDataFrame([("V2",)], "venue_id string"), spark.createDataFrame([], "paper_id long, venue_id string"))
    assert {tuple(r) for r in new.collect()} == {("V1", "Venue", "unknown")}
    assert {tuple(r) for r in links.collect()} == {(1, "V1"), (2, "V2")}
