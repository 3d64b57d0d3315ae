"""XML inside a text column."""

from pyspark.sql import types as T

from datagauge.sources.xml_text import element_paths, infer_xml_schema, malformed_xml, read_xml_column

CELLS = [
    '<r id="1"><a>x</a><b><c>1</c><c>2</c></b></r>', "<r><a k='v'>y</a><d/></r>", "<r><b><c>3</c></b><e>t&amp;u <i>n</i></e></r>",
    None, "", "  ", "<r><a>", "no xml", "<r><x:n>5</x:n><a>é 日本</a></r>", "<?xml version='1.0'?><r><!-- note --><a><![CDATA[<z>]]></a></r>",
]


def cells(spark, texts=CELLS):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)


def test_schema_comes_from_all_cells(spark):
    s = T.StringType()
    assert infer_xml_schema(cells(spark), "t") == T.StructType(
        [
            T.StructField("@id", s), T.StructField("a", T.StructType([T.StructField("#text", s), T.StructField("@k", s)])), T.StructField("b", T.StructType([T.StructField("c", T.ArrayType(s))])),
            T.StructField("d", s), T.StructField("e", T.StructType([T.StructField("#text", s), T.StructField("i", s)])), T.StructField("x:n", s),
        ]
    )


def test_records_and_malformed_cells(spark):
    rows = {r["i"]: r["record"] for r in read_xml_column(cells(spark), "t").collect()}
    assert len(rows) == len(CELLS)
    assert rows[0]["@id"] == "1" and rows[0]["a"]["#text"] == "x" and rows[0]["b"]["c"] == ["1", "2"]
    assert rows[1]["a"]["@k"] == "v" and rows[1]["a"]["#text"] == "y" and rows[2]["b"]["c"] == ["3"] and rows[2]["e"]["i"] == "n"
    assert rows[8]["x:n"] == "5" and rows[8]["a"]["#text"] == "é 日本" and rows[9]["a"]["#text"] == "<z>"
    assert all(rows[i] is None for i in (3, 4, 5, 6, 7))
    assert sorted(r["i"] for r in malformed_xml(cells(spark), "t").collect()) == [6, 7]


def test_columns_without_records(spark):
    for texts in ([None, ""], []):
        assert infer_xml_schema(cells(spark, texts), "t") == T.StructType() if texts else True
    assert [r["record"]["#text"] for r in read_xml_column(cells(spark, ["<a>5</a>"]), "t").collect()] == ["5"]


def test_paths_of_a_text():
    found = {}
    assert element_paths("<r><a>1</a><b/><a/></r>", found) and not element_paths("<r>", found)
    assert found == {(): [False, False, True], ("a",): [True, True, False], ("b",): [False, False, False]}
