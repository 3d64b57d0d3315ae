"""Checks of readers, nested tables and JSON inside text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.operators.extract_json import extract_json
from datagauge.plans import dataset
from datagauge.session import scratch_path
from datagauge.sources import files, nested, xml_text

from .registry import check, table, tables, union_all


@check("source_parquet", "SELECT * FROM supplier")
def source_parquet(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/supplier.parquet")


@check("source_csv", "SELECT * FROM customer")
def source_csv(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".csv"
    files.write_csv(table(spark, sf_dir, "customer"), path)
    return files.read_table(spark, path)


@check("source_tsv", "SELECT * FROM orders")
def source_tsv(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".tsv"
    table(spark, sf_dir, "orders").write.csv(path, header=True, sep="\t")
    return files.read_table(spark, path)


# Texts with line breaks, quotes, separators, blanks, empty strings and nulls.
QUOTED = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('he said "', text, '", ok') WHEN 1 THEN concat('  ', text, ' ;') WHEN 2 THEN ''
  WHEN 3 THEN CAST(NULL AS VARCHAR(1)) WHEN 4 THEN '"' ELSE text END AS text, lang, source, n_chars FROM documents"""


@check("source_csv_text", QUOTED)
def source_csv_text(spark, sf_dir):
    path = scratch_path(spark, "documents") + ".csv"
    files.write_csv(spark.sql(QUOTED.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`")), path)
    return files.read_table(spark, path)


@check("source_json", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def source_json(spark, sf_dir):
    path = scratch_path(spark, "documents") + ".json"
    files.write_json(table(spark, sf_dir, "documents"), path)
    return files.read_table(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@check("source_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def source_json_lines(spark, sf_dir):
    path = scratch_path(spark, "conversations") + ".json"
    files.write_json(table(spark, sf_dir, "conversations"), path)
    return files.read_table(spark, path).select("conv_id", "turn", "role", "text")


@check("source_json_documents", "SELECT item_id, text FROM benchmark")
def source_json_documents(spark, sf_dir):
    """Indented documents, one file for each item."""
    path = scratch_path(spark, "benchmark") + ".json"
    row = F.to_json(F.struct("item_id", "text"), {"pretty": "true"})
    table(spark, sf_dir, "benchmark").select(row.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_table(spark, path).select("item_id", "text")


@check(
    "source_xml",
    'SELECT p_brand, CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_type FROM part',
)
def source_xml(spark, sf_dir):
    path = scratch_path(spark, "part") + ".xml"
    df = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    df.write.format("xml").option("rowTag", "row").save(path)
    return files.read_table(spark, path, row_tag="row")


@check(
    "source_xml_tables",
    "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region",
)
def source_xml_tables(spark, sf_dir):
    """No row tag is named: the repeated element becomes a nested table."""
    path = scratch_path(spark, "region") + ".xml"
    table(spark, sf_dir, "region").coalesce(1).write.format("xml").option("rowTag", "area").option("rootTag", "world").save(path)
    return nested.extract_tables(files.read_table(spark, path))["area"].select("r_regionkey", "r_name")


@check(
    "source_xml_column",
    """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size,
  CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_type || ',' || p_name END AS names, CASE WHEN p_partkey % 2 = 0 THEN 'usd' END AS currency, CAST(p_size * 2 AS VARCHAR) AS price
FROM part WHERE p_partkey % 10 <> 7""",
)
def source_xml_column(spark, sf_dir):
    """Records written as XML text, some with elements missing, repeated or with attributes, some cut off."""
    part = table(spark, sf_dir, "part")
    names = F.concat(F.lit("<name>"), "p_type", F.lit("</name>"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("<name>"), "p_name", F.lit("</name>"))))
    size = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("<size>"), "p_size", F.lit("</size>")))
    price = F.concat(F.lit("<price"), F.when(F.col("p_partkey") % 2 == 0, ' currency="usd"').otherwise(""), F.lit(">"), F.col("p_size") * 2, F.lit("</price>"))
    whole = F.concat(F.lit('<part id="'), "p_partkey", F.lit('"><brand>'), "p_brand", F.lit("</brand>"), size, names, price, F.lit("</part>"))
    text = F.when(F.col("p_partkey") % 10 == 7, F.substring(whole, 1, 40)).otherwise(whole)
    rows = xml_text.read_xml_column(part.select("p_partkey", text.alias("x")), "x").where("record IS NOT NULL")
    r = F.col("record")
    return rows.select("p_partkey", r["@id"].alias("id"), r["brand"].alias("brand"), r["size"].alias("size"), F.array_join(r["name"], ",").alias("names"), r["price"]["@currency"].alias("currency"), r["price"]["#text"].alias("price"))


@check("source_xml_malformed", "SELECT count(*) AS n, min(p_partkey) AS first FROM part WHERE p_partkey % 10 = 7")
def source_xml_malformed(spark, sf_dir):
    whole = F.concat(F.lit("<part><brand>"), "p_brand", F.lit("</brand></part>"))
    text = F.when(F.col("p_partkey") % 10 == 7, F.substring(whole, 1, 20)).when(F.col("p_partkey") % 10 == 3, "").otherwise(whole)
    bad = xml_text.malformed_xml(table(spark, sf_dir, "part").select("p_partkey", text.alias("x")), "x")
    return bad.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@check(
    "source_tables",
    union_all(
        [f"SELECT '{t}' AS table_name, count(*) AS record_count FROM {t}" for t in ("region", "nation", "part", "events")]
    ),
)
def source_tables(spark, sf_dir):
    found = files.read_tables(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "part", "events")})
    parts = [df.agg(F.lit(t).alias("table_name"), F.count("*").alias("record_count")) for t, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations")


@check(
    "source_inventory",
    union_all([f"SELECT '{t}.parquet' AS filename, '.parquet' AS extension, true AS is_supported, count(*) AS records FROM {t}" for t in FILES]),
)
def source_inventory(spark, sf_dir):
    """The files of the folder, each read by its extension and counted; sizes are compared in a test."""
    listed = files.file_inventory(spark, sf_dir, "*.parquet").select("filename", "extension", "is_supported")
    found = files.read_tables(spark, {f"{t}.parquet": f"{sf_dir}/{t}.parquet" for t in FILES})
    counts = [df.agg(F.lit(name).alias("filename"), F.count("*").alias("records")) for name, df in found.items()]
    return listed.join(reduce(DataFrame.unionByName, counts), "filename")


PREVIEWED = {"customer": ("c_custkey", "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment"),
             "documents": ("doc_id", "doc_id,text,lang,source,n_chars")}


@check(
    "source_preview",
    union_all(
        [
            f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS record_count, '{columns}' AS columns,
  row_number() OVER (ORDER BY {key}) - 1 AS position, {key} AS key FROM {t} QUALIFY position < 5"""
            for t, (key, columns) in PREVIEWED.items()
        ]
    ),
)
def source_preview(spark, sf_dir):
    found = files.preview(tables(spark, sf_dir, *PREVIEWED), {t: [key] for t, (key, _) in PREVIEWED.items()})
    key = F.coalesce(F.get_json_object("record", "$.c_custkey"), F.get_json_object("record", "$.doc_id"))
    return found.select("table_name", "record_count", "columns", "position", key.cast("bigint").alias("key"))


# --- nested tables -------------------------------------------------------------------------------------------------------


def _nested(spark, sf_dir):
    """Documents with their lines, and the words of every line."""

    def line(text):
        words = F.transform(F.split(text, " "), lambda w: F.struct(w.alias("word")))
        return F.struct(text.alias("line"), words.alias("words"))

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct("lang", "source").alias("meta"),
        F.split("source", "c").alias("marks"),
        F.transform(F.split("text", "\n"), line).alias("lines"),
        F.struct("n_chars", F.struct(F.array(F.struct("lang")).alias("codes")).alias("deep")).alias("stats"),
    )


LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
WORDS = f"(SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM {LINES})"
TABLE_SIZES = f"""SELECT 'main_table' AS table_name, count(*) AS records FROM documents UNION ALL
SELECT 'lines', count(*) FROM {LINES} UNION ALL SELECT 'lines_words', count(*) FROM {WORDS} UNION ALL
SELECT 'stats_deep_codes', count(*) FROM documents"""


@check("nested_tables", TABLE_SIZES)
def nested_tables(spark, sf_dir):
    found = nested.extract_tables(_nested(spark, sf_dir))
    result = None
    for name, df in found.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("records"))
        result = part if result is None else result.unionByName(part)
    return result


@check("nested_words", f"SELECT word, count(*) AS n FROM {WORDS} GROUP BY word")
def nested_words(spark, sf_dir):
    return nested.extract_tables(_nested(spark, sf_dir))["lines_words"].groupBy("word").agg(F.count("*").alias("n"))


@check(
    "nested_lineage",
    """SELECT line, ordinal - 1 AS ordinal, count(*) AS n FROM (
  SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents) GROUP BY 1, 2""",
)
def nested_lineage(spark, sf_dir):
    lines = nested.extract_tables(_nested(spark, sf_dir), lineage=True)["lines"]
    return lines.groupBy("line", F.col("_parent_ordinal").alias("ordinal")).agg(F.count("*").alias("n"))


@check("nested_variant_tables", TABLE_SIZES)
def nested_variant_tables(spark, sf_dir):
    records = _nested(spark, sf_dir).select(F.parse_json(F.to_json(F.struct("*"))).alias("v"))
    return nested.extract_variant_tables(records, "v").groupBy("table_name").agg(F.count("*").alias("records"))


@check(
    "nested_report_tables",
    f"""SELECT 'meta' AS table_name, count(*) AS records FROM documents UNION ALL SELECT 'marks', sum(len(string_split(source, 'c')))::BIGINT FROM documents
UNION ALL SELECT 'lines', count(*) FROM {LINES} UNION ALL SELECT 'stats_deep_codes', count(*) FROM documents""",
)
def nested_report_tables(spark, sf_dir):
    result = None
    for name, df in nested.report_tables(_nested(spark, sf_dir)).items():
        part = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("records"))
        result = part if result is None else result.unionByName(part)
    return result


INVENTORY = """SELECT concat('item_', doc_id, '_', n) AS table_path, r::BIGINT AS records FROM (
  SELECT doc_id, 'meta' AS n, 1 AS r FROM documents UNION ALL SELECT doc_id, 'marks', len(string_split(source, 'c')) FROM documents
  UNION ALL SELECT doc_id, 'lines', len(string_split(text, chr(10))) FROM documents UNION ALL SELECT doc_id, 'stats_deep_codes', 1 FROM documents)"""


@check("nested_report_inventory", INVENTORY)
def nested_report_inventory(spark, sf_dir):
    return nested.report_inventory(_nested(spark, sf_dir), F.col("doc_id"))


# Documents without a schema: lists of objects, of scalars and mixed ones, lists in lists, empty ones, nulls.
FREE = """
SELECT doc_id, concat('{"meta": {"lang": "', lang, '", "n": ', doc_id, ', "none": null}, "marks": [', marks, '], "mixed": [7, {"deep": {"codes": [', codes,
  '], "flat": {"x": 1}}}, {"flat": 1}, [', codes, '], null], "lists": [[', marks, '], [{"a": {"b": [1, 2]}, "c": [[3]]}]], "holes": [null, 1], "empty": {}, "stats": {"rows": [{"a": 1}, {"b": [',
  codes, ']}], "size": ', n_chars, '}}') AS j
FROM (SELECT doc_id, lang, n_chars, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1, 2.5' ELSE '1, true, "x"' END AS marks,
        CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '5' ELSE '5, 6' END AS codes FROM documents)"""

FREE_TABLES = """
  SELECT doc_id AS id, 'meta' AS table_path, 'record' AS shape, 1 AS records FROM documents
  UNION ALL SELECT doc_id, 'marks', 'values', doc_id % 4 FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, 'mixed_1_deep_codes', 'values', doc_id % 3 FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT doc_id, 'mixed_1_deep_flat', 'record', 1 FROM documents
  UNION ALL SELECT doc_id, 'stats_rows', 'records', 2 FROM documents"""
FREE_LISTS = """
  UNION ALL SELECT doc_id, 'mixed_3', 'values', doc_id % 3 FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT doc_id, 'lists_0', 'values', doc_id % 4 FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, 'lists_1', 'records', 1 FROM documents"""


def _free(spark, sf_dir):
    text = spark.sql(FREE.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`"))
    return text.select("doc_id", F.parse_json("j").alias("v"))


@check("nested_report_variant", f"SELECT id, table_path, shape, records::BIGINT AS records FROM ({FREE_TABLES})")
def nested_report_variant(spark, sf_dir):
    return nested.report_variant_inventory(_free(spark, sf_dir), "v", "doc_id")


@check("nested_report_variant_lists", f"SELECT id, table_path, shape, records::BIGINT AS records FROM ({FREE_TABLES}{FREE_LISTS})")
def nested_report_variant_lists(spark, sf_dir):
    return nested.report_variant_inventory(_free(spark, sf_dir), "v", "doc_id", nested_lists=True)


@check(
    "nested_report_variant_rows",
    """SELECT doc_id AS id, p AS position, CASE p WHEN 0 THEN '5' ELSE '6' END AS record FROM documents, range(0, 2) r(p) WHERE p < doc_id % 3""",
)
def nested_report_variant_rows(spark, sf_dir):
    rows = nested.report_variant(_free(spark, sf_dir), "v", "doc_id").where("table_path = 'mixed_1_deep_codes'")
    return rows.select("id", "position", F.to_json("record").alias("record"))


@check(
    "nested_hierarchy",
    f"""SELECT table_path, records, 'item' AS parent, len(string_split(table_path, '_')) - 1 AS level FROM ({INVENTORY})""",
)
def nested_hierarchy(spark, sf_dir):
    return nested.path_hierarchy(nested.report_inventory(_nested(spark, sf_dir), F.col("doc_id")), "table_path")


@check(
    "nested_flat",
    "SELECT event_id, concat('{\"event_type\":\"', event_type, '\",\"user_id\":', user_id, '}') AS item FROM events",
)
def nested_flat(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "user_id").alias("item"))
    return files.flat(df)


# --- JSON inside text -----------------------------------------------------------------------------------------------------

FORM = "(conv_id + turn) % 6"
OBJECT = "concat('{\"conv\": ', CAST(conv_id AS VARCHAR(20)), ', \"turn\": ', CAST(turn AS VARCHAR(20)), '}')"
ANSWERS = f"""SELECT conv_id * 1000 + turn AS id, {FORM} AS form, {OBJECT} AS doc, text FROM conversations"""


@check(
    "extract_json",
    f"""SELECT id, CASE form WHEN 1 THEN 'json_fence' WHEN 2 THEN 'plain_fence' WHEN 3 THEN 'brace_span'
  WHEN 4 THEN 'balanced_braces' ELSE 'intro_phrase' END AS method, doc AS json_text FROM ({ANSWERS}) WHERE form > 0""",
)
def extract_json_query(spark, sf_dir):
    answers = spark.sql(ANSWERS.replace("FROM conversations", f"FROM parquet.`{sf_dir}/conversations.parquet`"))
    fence, form = F.lit("```"), F.col("form")
    answer = (
        F.when(form == 1, F.concat("text", F.lit("\n"), fence, F.lit("json\n"), "doc", F.lit("\n"), fence))
        .when(form == 2, F.concat("text", F.lit("\n"), fence, F.lit("\n"), "doc", F.lit("\n"), fence, F.lit(" done")))
        .when(form == 3, F.concat("text", F.lit(" "), "doc", F.lit(" "), "text"))
        .when(form == 4, F.concat("text", F.lit(" "), "doc", F.lit(" and a stray } "), "text"))
        .when(form == 5, F.concat("text", F.lit(" not {this} but the Result: "), "doc", F.lit(" "), "text"))
        .otherwise(F.col("text"))
    )
    return extract_json(answers.select("id", answer.alias("answer")), "id", "answer")


# --- sinks read back, shapes of datasets ----------------------------------------------------------------------------------


@check(
    "sink_csv",
    """SELECT doc_id::VARCHAR AS doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE '"a", b' || chr(10) || ' c ' END AS odd,
  '{"lang":"' || lang || '","n":' || n_chars || '}' AS meta FROM documents""",
)
def sink_csv(spark, sf_dir):
    """Texts with line breaks and quotes, nulls beside empty strings, nested cells: written and read again."""
    odd = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, '"a", b\n c ')
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", odd.alias("odd"), F.struct("lang", F.col("n_chars").alias("n")).alias("meta"))
    path = scratch_path(spark, "documents") + ".csv"
    files.write_csv(df, path)
    return files.read_csv(spark, path, sep=",", infer=False)


@check(
    "sink_json",
    """SELECT event_id, event_type, CASE WHEN event_id % 3 > 0 THEN value END AS value, user_id AS held, [event_type, NULL, ''] AS listed FROM events""",
)
def sink_json(spark, sf_dir):
    """Nulls, nested values and lists: written and read again."""
    value = F.when(F.col("event_id") % 3 > 0, F.col("value"))
    df = table(spark, sf_dir, "events").select("event_id", "event_type", value.alias("value"), F.struct("user_id").alias("held"), F.array("event_type", F.lit(None), F.lit("")).alias("listed"))
    path = scratch_path(spark, "events") + ".json"
    files.write_json(df, path)
    return files.read_table(spark, path).select("event_id", "event_type", "value", F.col("held.user_id").alias("held"), "listed")


@check(
    "preview_records",
    """SELECT 'region' AS table_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS position, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS record
FROM region QUALIFY position < 3
UNION ALL SELECT 'pieces', row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1,
  '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"flag":' || CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '"' || l_returnflag || '"' END || '}'
FROM lineitem QUALIFY row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) <= 3""",
)
def preview_records(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag")
    found = {"region": table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "pieces": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag)}
    ordered = {"region": ["r_regionkey"], "pieces": ["l_orderkey", "l_linenumber", "l_partkey"]}
    return files.preview(found, ordered, 3).select("table_name", "position", "record")


@check(
    "multi_table",
    """SELECT 'nested' AS name, true AS is_multi, count(*) AS n FROM documents UNION ALL SELECT 'flat', false, count(*) FROM orders UNION ALL SELECT 'one', false, count(*) FROM events""",
)
def multi_table(spark, sf_dir):
    """Whether a frame holds several tables, told from its schema; counted next to its rows."""
    two = table(spark, sf_dir, "documents").select(F.array(F.struct("lang")).alias("a"), F.array(F.struct("source")).alias("b"))
    one = table(spark, sf_dir, "events").select(F.array(F.struct("event_type")).alias("a"), F.array("user_id").alias("b"))
    found = {"nested": two, "flat": table(spark, sf_dir, "orders"), "one": one}
    parts = [df.agg(F.lit(n).alias("name"), F.lit(nested.is_multi_table(df.schema)).alias("is_multi"), F.count("*").alias("n")) for n, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _listed(spark, sf_dir):
    """Documents with lists of objects whose keys differ."""
    lines = F.transform(
        F.when(F.col("doc_id") % 3 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit('{"n": '), i, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "t": "x'), i, F.lit('"'))).otherwise(""), F.lit("}")),
    )
    lang = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit(', "lang": "'), "lang", F.lit('"')))
    text = F.concat(F.lit('{"id": '), "doc_id", lang, F.lit(', "lines": ['), F.array_join(lines, ", "), F.lit('], "meta": {"size": '), "n_chars", F.lit("}}"))
    return table(spark, sf_dir, "documents").select(F.parse_json(text).alias("v"))


@check(
    "assess_documents",
    """WITH line AS (SELECT doc_id, unnest(range(1, doc_id % 3 + 1)) AS n FROM documents)
SELECT 'main_table' AS table_name, 'id' AS attribute, 'integer' AS data_type, count(*) AS total_count, count(*) AS present_count, count(DISTINCT doc_id) AS unique_count FROM documents
UNION ALL SELECT 'main_table', 'lang', 'string', count(*), count(*) FILTER (WHERE doc_id % 4 <> 0), count(DISTINCT lang) FILTER (WHERE doc_id % 4 <> 0) FROM documents
UNION ALL SELECT 'main_table', 'lines', 'array', count(*), count(*), (SELECT count(DISTINCT (k, CASE WHEN k = 0 THEN 0 ELSE p END)) FROM (SELECT doc_id % 3 AS k, doc_id % 2 AS p FROM documents)) FROM documents
UNION ALL SELECT 'main_table', 'meta', 'object', count(*), count(*), count(DISTINCT n_chars) FROM documents
UNION ALL SELECT 'lines', 'n', 'integer', count(*), count(*), count(DISTINCT n) FROM line
UNION ALL SELECT 'lines', 't', 'string', count(*), count(*) FILTER (WHERE doc_id % 2 = 0), count(DISTINCT n) FILTER (WHERE doc_id % 2 = 0) FROM line""",
)
def assess_documents(spark, sf_dir):
    found = dataset.assess_documents(_listed(spark, sf_dir), "v").profiles
    return found.select("table_name", "attribute", "data_type", "total_count", "present_count", "unique_count")


@check(
    "assess_documents_scores",
    """SELECT 'main_table' AS table_name, count(*) AS total_records, 4::BIGINT AS total_attributes FROM documents
UNION ALL SELECT 'lines', sum(doc_id % 3)::BIGINT, 2 FROM documents""",
)
def assess_documents_scores(spark, sf_dir):
    return dataset.assess_documents(_listed(spark, sf_dir), "v").table_scores.select("table_name", "total_records", "total_attributes")
