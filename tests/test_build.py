import csv

import pytest
from pyspark.sql import functions as F

from tests import dumps
from tests.conftest import rows_of
from waxgraph.operators import integrity
from waxgraph.plans.alias_update import alias_update, apply_alias_update
from waxgraph.plans.build_graph import Dumps, build_graph
from waxgraph.sources import graph_tables, release_store, search_store, xml_dumps


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    paths = dumps.write(folder)
    out = str(tmp_path_factory.mktemp("graph") / "out")
    report = build_graph(spark, Dumps(**paths), out, partitions=3, tolerance=10)
    nodes, edges = graph_tables.read_graph(spark, out)
    return paths, out, report, nodes, edges


def test_report(built):
    report = built[2]
    assert report.scanned_releases == 8
    assert report.wanted_releases == 6
    assert report.missing_releases == 1
    # artists: no id, bad alias, bad member; label: no id; master: abc; releases: no title, id abc
    assert report.rejected_records == 7
    # members 777, alias 4444, credit 8888
    assert report.bad_edges == 3


def test_rejects(spark, built):
    found = rows_of(spark.read.parquet(f"{built[1]}/rejects"), "tag", "id", "reason")
    assert found == [
        ("artist", None, "no id"),
        ("artist", "8", "alias id not a number"),
        ("artist", "9", "member without id"),
        ("label", None, "no id"),
        ("master", "abc", "main_release not a number"),
        ("release", "102", "no title"),
        ("release", "abc", "id not a number"),
    ]


def test_entity_nodes(built):
    nodes = built[3].where("space = 'entity'")
    assert rows_of(nodes, "kind", "id", "name", "realname", "profile") == [
        ("Artist", "1", "Ann Lee", "Ann L. Lee", "First line,\nsecond line of [l=North Road]"),
        ("Artist", "10", "Trailing ", None, None),
        ("Artist", "1000", 'Ünïcödé "quoted", with comma', None, None),
        ("Artist", "5", None, None, "no name at all"),
        ("Artist", "6", None, None, None),
        ("Artist", "999", "Lee A", None, None),
        ("Group", "2", "The Band", None, None),
        ("Group", "3", "Empty Group", None, None),
    ]


def test_release_nodes(built):
    nodes = built[3].where("kind = 'Release'")
    assert rows_of(nodes, "id", "title", "year") == [
        ("100", "First", "1995-08-07"),
        ("101", None, "1964"),
        ("103", "New Copy", None),
        ("105", "Credits of <nobody> & co", None),
    ]


def test_label_nodes_keep_the_last_name_and_the_last_profile_with_text(built):
    nodes = built[3].where("kind = 'Label'")
    assert rows_of(nodes, "id", "name", "profile") == [
        ("1", "North Road", "A label"),
        # an empty name in a later listing replaces a better one
        ("2", None, "Minor, but with a profile"),
        ("3", "Only Nested", None),
        ("4", None, "nameless"),
        ("6", "Only Listed", None),
    ]


def test_edges(built):
    assert rows_of(built[4], "type", "src", "dst") == [
        ("ALIAS_OF", "1", "999"),
        ("ALIAS_OF", "1000", "1000"),
        ("ALIAS_OF", "999", "1000"),
        ("CREDITED", "1", "100"),
        ("CREDITED", "1", "100"),
        ("CREDITED", "2", "100"),
        ("CREDITED", "5", "103"),
        ("MEMBER_OF", "1", "2"),
        ("RELEASED_ON", "100", "1"),
        ("RELEASED_ON", "100", "1"),
        ("RELEASED_ON", "101", "2"),
        ("RELEASED_ON", "101", "6"),
        ("SUBLABEL", "2", "1"),
        ("SUBLABEL", "3", "1"),
    ]


def test_bad_edges_are_reported(spark, built):
    bad = spark.read.parquet(f"{built[1]}/bad_edges")
    assert rows_of(bad, "type", "src", "dst", "src_missing", "dst_missing") == [
        ("ALIAS_OF", "10", "4444", False, True),
        ("CREDITED", "8888", "101", True, False),
        ("MEMBER_OF", "777", "2", True, False),
    ]


def test_an_existing_output_is_refused(spark, built):
    with pytest.raises(Exception, match="(?i)already exists"):
        build_graph(spark, Dumps(**built[0]), built[1])


def test_too_many_bad_edges_abort_before_the_graph_is_written(spark, built, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(integrity.TooManyBadEdges):
        build_graph(spark, Dumps(**built[0]), str(out), tolerance=2)
    assert not (out / "nodes").exists() and not (out / "edges").exists()


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("tag", ["artist", "master", "release"])
def test_both_readers_agree(spark, tmp_path, tag, compress):
    path = dumps.write(tmp_path, compress)[tag + "s"]
    direct = xml_dumps.read_records(spark, path, tag).drop("place")
    spread = xml_dumps.read_records_spread(spark, path, tag, 3).drop("place")
    assert sorted(map(str, direct.collect())) == sorted(map(str, spread.collect()))


def test_place_follows_the_document(spark, tmp_path):
    path = dumps.write(tmp_path)["releases"]
    texts = xml_dumps.read_texts(spark, path, "release").repartition(3).orderBy("place")
    ids = [row.content.split('"')[1] for row in texts.collect()]
    assert ids == ["100", "101", "102", "103", "104", "103", "abc", "105"]


def test_elements_without_content_are_records_of_their_own(spark, tmp_path):
    path = tmp_path / "masters.xml"
    path.write_text(
        '<masters>\n<master/><master id="1"><main_release>7</main_release></master><master id="2"/>\n'
        '<master id="3" /><master id="4"><main_release>8</main_release></master>\n<master id="5"/></masters>'
    )
    for read in (xml_dumps.read_records, xml_dumps.read_records_spread):
        masters = read(spark, str(path), "master").orderBy("place")
        assert [r.main_release for r in masters.collect()] == [None, "7", None, None, "8", None]
    texts = xml_dumps.read_texts(spark, str(path), "master").orderBy("place")
    assert [r.content for r in texts.collect()][2:4] == ['<master id="2"/>', '<master id="3" />']


def test_malformed_record_is_set_aside(spark, tmp_path):
    path = tmp_path / "artists.xml"
    path.write_text("<artists><artist><id>1</id><name>A<b></artist><artist><id>2</id></artist></artists>")
    screened = xml_dumps.screen(xml_dumps.read_records_spread(spark, str(path), "artist", 2), "artist")
    assert rows_of(screened, "reject") == [(None,), ("malformed",)]
    assert tuple(xml_dumps.load_counters(screened).first()) == (2, 1, 50.0)


def test_audit_reads_the_date_off_the_file_name(spark, tmp_path):
    path = dumps.write(tmp_path)["masters"]
    row = xml_dumps.audit(spark.read.text(path)).first()
    assert row.file == "catalogue_20260801_masters.xml.gz" and row.dump_date == "20260801"
    assert row.rows == dumps.MASTERS.count("\n") and row.bytes > 100


def test_release_store_keeps_the_last_text(spark, tmp_path):
    store = release_store.build_store(spark, dumps.write(tmp_path)["releases"])
    texts = {row.id: row.content for row in store.collect()}
    assert sorted(texts) == [100, 101, 102, 103, 104, 105]
    assert "New Copy" in texts[103]
    masters = xml_dumps.read_records(spark, dumps.write(tmp_path)["masters"], "master")
    found = release_store.documents_of(masters, store)
    assert sorted(row._id for row in found.collect()) == ["100", "101", "102", "103", "105"]


def test_part_stores_merge_in_name_order(spark, make, tmp_path):
    for part, rows in (("part2", [(1, "b"), (3, "c")]), ("part10", [(1, "a"), (2, "x")])):
        make(rows, release_store.STORE).coalesce(1).write.parquet(f"{tmp_path}/{part}")
    parts = release_store.read_parts(spark, f"{tmp_path}/part2", f"{tmp_path}/part10")
    # names sort as text, so part2 comes after part10
    assert rows_of(release_store.merge_parts(parts)) == [(1, "b"), (2, "x"), (3, "c")]
    assert rows_of(release_store.part_rows(parts)) == [(None, 4), ("part10", 2), ("part2", 2)]


def test_alias_update_adds_what_is_missing_and_nothing_twice(spark, built, tmp_path):
    paths, _, _, nodes, edges = built
    screened = xml_dumps.screen(xml_dumps.read_records_spread(spark, paths["artists"], "artist", 2), "artist")
    artists = xml_dumps.accepted(screened)
    # A graph with one pair the other way round and without the rest.
    turned = edges.where("type = 'ALIAS_OF' AND src = '1'").withColumns(
        {"src": F.col("dst"), "dst": F.col("src")}
    )
    held = edges.where("type <> 'ALIAS_OF'").unionByName(turned)
    fresh, stats = alias_update(artists, nodes, held)
    assert rows_of(fresh, "src", "dst") == [("1000", "1000"), ("999", "1000")]
    declared, pairs, matched, unmatched, share = stats.first()
    assert (declared, pairs, matched, unmatched, share) == (6, 4, 3, 1, 25.0)

    path = f"{tmp_path}/edges"
    held.write.partitionBy("type").parquet(path)
    table = lambda: spark.read.schema(held.schema).parquet(path)
    before = table().count()
    apply_alias_update(artists, nodes, table(), path, dry_run=True)
    assert table().count() == before
    apply_alias_update(artists, nodes, table(), path)
    apply_alias_update(artists, nodes, table(), path)
    assert table().count() == before + 2


def test_alias_update_keeps_the_store_up_to_date(spark, built, tmp_path):
    paths, _, _, nodes, edges = built
    artists = xml_dumps.accepted(xml_dumps.screen(xml_dumps.read_records(spark, paths["artists"], "artist"), "artist"))
    path = f"{tmp_path}/edges"
    edges.where("type <> 'ALIAS_OF'").write.partitionBy("type").parquet(path)
    table = lambda: spark.read.schema(edges.schema).parquet(path)
    store = search_store.write(nodes, table(), f"{tmp_path}/store", buckets=4)
    apply_alias_update(artists, nodes, table(), path, dry_run=True, store=store)
    for _ in range(2):
        apply_alias_update(artists, nodes, table(), path, store=store)
    again = search_store.write(nodes, table(), f"{tmp_path}/again", buckets=4)
    for name in ("facts", "adjacency"):
        assert rows_of(store.read(name), *again.read(name).columns) == rows_of(again.read(name))


def test_csv_set_round_trip(spark, built, tmp_path):
    _, _, _, nodes, edges = built
    out = f"{tmp_path}/csv"
    graph_tables.write_csv_set(nodes, edges, out)
    again, linked = graph_tables.read_csv_set(spark, out)
    columns = ["kind", "id", "name", "title", "realname", "year", "profile"]
    assert rows_of(again, *columns) == rows_of(nodes, *columns)
    assert rows_of(linked, "type", "src", "dst") == rows_of(edges, "type", "src", "dst")


def test_csv_set_needs_all_nine_tables(spark, built, tmp_path):
    graph_tables.write_edge_csv("SUBLABEL", built[4], str(tmp_path))
    with pytest.raises(graph_tables.MissingInput):
        graph_tables.read_csv_set(spark, str(tmp_path))


def test_csv_text_form(spark, built, tmp_path):
    """Missing is written as "", empty as nothing, the rest in quotes; lines end in CR LF."""
    records = xml_dumps.read_records(spark, built[0]["artists"], "artist")
    groups = records.where("members IS NOT NULL AND id IN ('2', '3')").coalesce(1)
    graph_tables.write_node_csv("Group", groups.select("id", "name", "profile"), str(tmp_path))
    (part,) = (tmp_path / "groups").glob("part-*")
    assert part.read_bytes().decode() == (
        '"groupId:ID(Entity)","name","profile"\r\n"2","The Band",\r\n"3","Empty Group",""\r\n'
    )


def test_labels_table_on_its_own(spark, make, tmp_path):
    labels = make([("1", "A \"B\"", ""), ("2", "", "two\nlines")], "id string, name string, profile string")
    graph_tables.write_labels_csv(labels.coalesce(1), str(tmp_path))
    (part,) = (tmp_path / "labels").glob("part-*")
    assert part.read_bytes().decode() == (
        '"labelId:ID(Label)","name","profile"\r\n"1","A ""B""",""\r\n"2","","two\nlines"\r\n'
    )


def test_trimmed_export(spark, built):
    kept = graph_tables.trimmed_export(built[3], built[4], ["Label", "Artist"], 3)
    assert rows_of(kept) == [("Artist", "1", "Ann Lee"), ("Artist", "1000", 'Ünïcödé "quoted", with comma')][:1] + [
        ("Label", "1", "North Road")
    ]


def test_search_export(spark, built, tmp_path):
    nodes = built[3]
    assert rows_of(graph_tables.search_export(nodes, ["Release"])) == [
        ("Release", "100", "First"),
        ("Release", "103", "New Copy"),
        ("Release", "105", "Credits of <nobody> & co"),
    ]
    assert rows_of(graph_tables.skipped_names(nodes)) == [
        ("Artist", 2), ("Group", 0), ("Label", 2), ("Release", 1),
    ]
    with pytest.raises(ValueError):
        graph_tables.search_export(nodes, ["Master"])
    graph_tables.write_search_export(nodes.coalesce(1), f"{tmp_path}/plain")
    (part,) = (tmp_path / "plain").glob("part-*.csv")
    rows = list(csv.reader(part.open(newline="", encoding="utf-8")))
    assert rows[0] == ["type", "id", "name"]
    assert ["Artist", "1000", 'Ünïcödé "quoted", with comma'] in rows
    assert ["Artist", "10", "Trailing "] in rows
    graph_tables.write_search_export(nodes, f"{tmp_path}/zipped", gzip=True)
    assert list((tmp_path / "zipped").glob("part-*.csv.gz"))


def test_name_shards(spark, built, tmp_path):
    exported = graph_tables.search_export(built[3], ["Artist"])
    graph_tables.write_name_shards(exported, f"{tmp_path}/shards")
    back = spark.read.json(f"{tmp_path}/shards/prefix=an")
    assert rows_of(back, "id", "name") == [("1", "Ann Lee")]


def _small_build(spark, tmp_path, releases, masters):
    given = {
        "artists": "<artists><artist><id>1</id><name>A</name></artist></artists>",
        "labels": "<labels><label><id>1</id><name>L</name></label></labels>",
        "masters": "<masters>" + "".join(f"<master><main_release>{m}</main_release></master>" for m in masters) + "</masters>",
        "releases": f"<releases>{releases}</releases>",
    }
    for name, text in given.items():
        (tmp_path / f"{name}.xml").write_text(text)
    out = str(tmp_path / "out")
    report = build_graph(spark, Dumps(**{name: str(tmp_path / f"{name}.xml") for name in given}), out)
    return report, graph_tables.read_graph(spark, out)[0], spark.read.parquet(f"{out}/rejects")


def test_a_bad_later_copy_does_not_displace_a_good_release(spark, tmp_path):
    report, nodes, rejects = _small_build(
        spark, tmp_path,
        '<release id="7"><title>Good</title></release><release id="7"><released>1999</released></release>'
        '<release data-id="5" id="8"><title>Eight</title></release><release id="9x"><title>No number</title></release>'
        '<release id="9"><title>Nine</title></release><release data-id="7"><title>No id</title></release>',
        [7, 8, 9],
    )
    assert rows_of(nodes.where("kind = 'Release'"), "id", "title") == [("7", "Good"), ("8", "Eight"), ("9", "Nine")]
    found = rows_of(rejects, "id", "reason")
    assert found == [(None, "id not a number"), ("7", "no title"), ("9x", "id not a number")]
    assert (report.rejected_records, report.missing_releases) == (3, 0)


def test_labels_without_a_number_are_reported(spark, tmp_path):
    report, nodes, rejects = _small_build(
        spark, tmp_path, '<release id="1"><title>One</title><labels><label id="x5" name="Odd"/></labels></release>', [1]
    )
    assert rows_of(rejects, "tag", "id", "reason") == [("label", "x5", "listed id not a number")]
    assert rows_of(nodes.where("kind = 'Label'"), "id") == [("1",)] and report.bad_edges == 1


def test_csv_set_when_files_are_limited_in_records(spark, make, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        labels = make([(str(i), f"name {i}", None) for i in range(100)], "id string, name string, profile string")
        graph_tables.write_labels_csv(labels, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    (folder,) = [path for path in tmp_path.iterdir()]
    assert spark.read.options(**graph_tables.CSV_READ).schema("id string, name string, profile string").csv(str(folder)).count() == 100


def test_place_tells_files_of_one_name_apart(spark, tmp_path):
    for part in ("a", "b"):
        (tmp_path / part).mkdir()
        (tmp_path / part / "dump.xml").write_text(f"<artists><artist><id>{part}</id></artist></artists>")
    found = xml_dumps.read_texts(spark, [str(tmp_path / p) for p in ("b", "a")], "artist").orderBy("place")
    assert ["<id>a<" in row.content for row in found.collect()] == [True, False]
