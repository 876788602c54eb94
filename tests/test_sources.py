import pytest
from pyspark.sql import functions as F

from nearfield.operators.context import assemble_context
from nearfield.operators.embedding import provider_factory
from nearfield.plans.ingest import ChunkOptions, compose_payload, embed_documents, split_valid, sync_points, sync_sheet, sync_stats
from nearfield.sources import files, sheets
from nearfield.sources.rows import number_rows
from nearfield.sources.tables import scan_documents, source_status

HASHING = provider_factory("hashing", dimensions=16)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_rows_are_numbered_in_order_across_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    numbered = number_rows(df, ["k"]).collect()
    assert sorted((r.k, r.row_number) for r in numbered) == [(i, i + 1) for i in range(5000)]


@pytest.mark.parametrize("multi_line", [True, False, None])
def test_csv_rows_keep_file_order(spark, tmp_path, multi_line):
    head = "n,name,note\n"
    write(tmp_path / "in" / "a.csv", head + "".join(f'{i},"x, ""y""",\n' for i in range(3000)))
    write(tmp_path / "in" / "b.csv", head + "".join(f"{i},z,t{i}\n" for i in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = files.read_csv_rows(spark, str(tmp_path / "in"), multi_line=multi_line).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3050 and all(int(r.n) + 1 == r.row_number for r in rows)
    lines = files.csv_lines(spark.createDataFrame(rows), ["n", "name", "note"]).where("row_number = 2").collect()
    assert {r.line for r in lines} == {'Row 2: n: 1, name: x, "y", note: ', "Row 2: n: 1, name: z, note: t1"}


def test_line_breaks_in_cells_are_noticed(spark, tmp_path):
    path = write(tmp_path / "in" / "a.csv", 'n,note\n1,"one\ntwo"\n2,"a","b\n","c"\n3,plain\n')
    rows = files.read_csv_rows(spark, path).orderBy("row_number").collect()
    assert [(r.row_number, r.n) for r in rows] == [(1, "1"), (2, "2"), (3, "3")] and rows[0].note == "one\ntwo"


def test_files_by_kind(spark, tmp_path):
    folder = tmp_path / "up"
    write(folder / "A.TXT", "one\r\n\r\n\r\n\r\ntwo  \t three ")
    write(folder / "sub" / "table.csv", '\ufeffk,v\n1,"a, b"\n\n2,"line\nbreak"\n3\n')
    write(folder / "blank.md", " \n\t")
    write(folder / "scan.pdf", "%PDF")
    write(folder / "odd.bin", b"caf\xc3\xa9 \xff end")
    write(folder / "noext", "plain")
    got = {r.filename: r for r in files.extract_files(files.read_files(spark, str(folder))).collect()}
    assert got["A.TXT"].content == "one\n\ntwo three" and got["A.TXT"].type == "txt"
    assert got["table.csv"].content == "Row 1: k: 1, v: a, b\nRow 2: k: 2, v: line\nbreak\nRow 3: k: 3"
    assert got["table.csv"].row_count == 3
    assert got["blank.md"].reason == "No readable content found in file" and got["blank.md"].content is None
    assert got["scan.pdf"].reason == "No parser for pdf"
    assert got["odd.bin"].content == "caf\u00e9 \ufffd end" and got["odd.bin"].size == 11
    assert got["noext"].type == "noext" and got["noext"].content == "plain"


def test_cells_beyond_the_header_are_kept(spark, tmp_path):
    path = write(tmp_path / "in" / "ragged.csv", 'h1,h2\n1,2,3\n4\n"a,b",5,6,7\n')
    rows = files.read_csv_rows(spark, path).drop("file").orderBy("row_number")
    assert rows.columns == ["h1", "h2", "column_3", "column_4", "row_number"]
    assert [tuple(r)[:4] for r in rows.collect()] == [("1", "2", "3", None), ("4", None, None, None), ("a,b", "5", "6", "7")]
    text = files.extract_files(files.read_files(spark, str(tmp_path / "in"))).first().content
    assert text.splitlines()[0] == "Row 1: h1: 1, h2: 2, column_3: 3"


def test_too_large_files_are_named_not_read(spark, tmp_path):
    write(tmp_path / "up" / "big.txt", "x" * 11)
    row = files.extract_files(files.read_files(spark, str(tmp_path / "up"), max_bytes=10), max_bytes=10).first()
    assert (row.filename, row.reason, row.content, row.size) == ("big.txt", "File too large", None, 11)


def test_sheet(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(30))
    path = write(tmp_path / "s.csv", f"{wide}\n" + "k1,,b\n" + "k1,a2,\n" + "k2,x,y\n")
    rows = sheets.read_sheet(spark, path)
    assert rows.columns == ["row_number"] + [f"c{i}" for i in range(26)]
    assert all(v is not None for r in rows.collect() for v in r)
    docs = sheets.sheet_documents(
        rows, sheet="S", key="c0", text_columns=["c1", "c2"], metadata_columns=["c2"], order=["row_number"]
    )
    got = {r.doc_id: (r.text, r.c2) for r in docs.collect()}
    assert got == {"sheet_S_k1": ("c1: a2\nc2: ", None), "sheet_S_k2": ("c1: x\nc2: y", "y")}
    first = sheets.sheet_preview(rows, ["row_number"], sample=2).orderBy("row_number").collect()
    assert [(r.c1, r.total_rows) for r in first] == [("", 3), ("a2", 3)] and first[0].column_names.startswith("c0, c1")
    points = sync_sheet(
        rows, HASHING, spreadsheet="id", sheet="S", key="c0", text_columns=["c1", "c2"], order=["row_number"],
        metadata_columns=["c2"], synced_at=F.lit("now"),
    ).collect()
    assert {(r.doc_id, r.row_key, len(r.vector), r.source) for r in points} == {
        ("sheet_S_k1", "k1", 16, "google_sheets"), ("sheet_S_k2", "k2", 16, "google_sheets")
    }
    with pytest.raises(ValueError):
        sheets.sheet_documents(rows, sheet="S", key="c0", text_columns=[])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [
            (1, "A text. " * 300, None, "news", "own"),
            (2, "", None, "news", None),
            (3, None, [0.5], None, None),
            (4, "short", [], "misc", None),
            (5, " " * 60, None, None, None),
        ],
        "doc_id int, text string, embedding array<double>, category string, source string",
    )


def test_source_counts(docs):
    assert source_status(docs).first().asDict() == {
        "total_documents": 5, "documents_with_embeddings": 2, "documents_without_embeddings": 3
    }
    assert {r.doc_id for r in scan_documents(docs, only_missing=True).collect()} == {1, 2, 5}


def test_sync_counts(docs):
    got = sync_stats(docs).first().asDict()
    assert (got["documents_processed"], got["documents_skipped"]) == (3, 2)
    assert got["points_upserted"] == got["chunks_created"] == 3
    dry = sync_stats(docs, re_embed=False, dry_run=True).first().asDict()
    assert dry == {"documents_processed": 2, "chunks_created": 2, "points_upserted": 0, "documents_skipped": 3}


def test_sync_points_are_the_same_on_every_run(docs):
    def run():
        points = sync_points(docs, HASHING, synced_at=F.lit("t"), metadata=["category", "source"])
        return sorted((r.id, r.doc_id, r.source, r.category, tuple(r.vector)) for r in points.collect())

    rows = run()
    assert rows == run()
    assert {(r[1], r[2], r[3]) for r in rows} == {(1, "own", "news"), (4, "mongo", "misc")}


def test_payload_precedence(spark):
    doc = spark.createDataFrame([(1, "own", None, "t")], "doc_id int, source string, category string, text string")
    row = compose_payload(doc, source="base", synced_at=F.lit("now"), metadata=["source", "category"]).first()
    assert row.asDict() == {"doc_id": 1, "source": "own", "synced_at": "now", "category": None, "text": "t"}


def test_embed_request(spark, docs):
    accepted, rejected = split_valid(docs, 500)
    assert {r.doc_id: r.reason for r in rejected.collect()} == {
        1: "Text too long: ~600 tokens (max: 500)", 2: "Text is empty", 3: "Text is empty", 5: "Text is empty"
    }
    rows, left = embed_documents(docs, HASHING, ChunkOptions(chunk_tokens=50, overlap_percent=0), keep=["category"])
    rows = rows.collect()
    assert {r.doc_id for r in left.collect()} == {2, 3, 5}
    assert {r.doc_id for r in rows} == {1, 4} and all(len(r.vector) == 16 for r in rows)
    for bad in ({"chunk_tokens": 49}, {"overlap_percent": 51}):
        with pytest.raises(ValueError):
            ChunkOptions(**bad)


def test_context(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", 0.5, "T2", "second"), (1, 1, "a", 0.9, "T1", "first"), (2, 1, "c", 0.1, None, "only")],
        "query_id int, rank int, id string, score double, title string, text string",
    )
    got = {r.query_id: r for r in assemble_context(hits).collect()}
    assert got[1].context == "first\n\nsecond" and got[2].context == "only"
    assert [tuple(s) for s in got[1].sources] == [("a", "T1", 0.9), ("b", "T2", 0.5)]
