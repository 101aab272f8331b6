import duckdb

from strandframe.llm import decontam, queries

NULL, OTHER = "one two three four five six seven eight nine ten eleven", "a b c d e f g h i j"
DOCS = [(1, f"zz {NULL} zz"), (2, f"{OTHER} and {NULL}"), (3, "clean"), (4, OTHER)]
ITEMS = [(None, NULL), (7, OTHER)]


def test_items_without_id_as_in_sql(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, decontam.decontaminate(docs, items).collect()))
    assert [r[1:4] + r[5:] for r in got] == [(13, 11, 1, True), (22, 21, 2, True), (1, 0, 0, False), (10, 10, 1, True)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", DOCS)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert got == sorted(con.execute(queries.SQL["op7_decontamination"]).fetchall())
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items).collect()] == [3]
