"""The driver's tables seen as records, entities, cells, units, logs, gold and declarations; each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.model.schema import FieldDefinition, Schema

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Lines of orders that one task holds: the number of tasks follows the table, not the size of its files or the session's settings.
LINES = 250_000


def tasks(spark, d) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "lineitem").count() // LINES))


def record(spark, d, dealt: int | None = None):
    """dealt: into so many tasks by record, as entities and cells are, so that what meets by record needs no shuffle."""
    o = table(spark, d, "orders").withColumn("record_id", F.concat(F.lit("ord:"), "o_orderkey"))
    o = o if dealt is None else o.repartition(dealt, "record_id")
    return o.select(
        "record_id", F.when(F.year("o_orderdate") < 1998, "order@1.0").otherwise("order@1.1").alias("schema_ref"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("review_needed").alias("state"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate",
    )


def _lines(spark, d):
    """Every order with each of its lines by position (-1: no line), dealt by record once: what is grouped, joined or windowed by record needs no further shuffle."""
    n = tasks(spark, d)
    line = table(spark, d, "lineitem").withColumn("record_id", F.concat(F.lit("ord:"), "l_orderkey")).repartition(n, "record_id")
    at = F.row_number().over(Window.partitionBy("record_id").orderBy(*ORDER)) - 1
    own = line.select("record_id", at.alias("position"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")
    both = record(spark, d, n).join(own, "record_id", "left")
    none = F.col("position").isNull()
    named = F.when(none, "lines[]=∅").otherwise(F.concat(F.lit("lines[]=#"), "position"))
    return both.withColumns({"entity": named, "position": F.when(none, -1).otherwise(F.col("position")).cast("int")})


def entity(spark, d):
    """Lines of an order by position; an order without lines has the empty entity."""
    return _lines(spark, d).select("record_id", "entity", "position", "l_quantity", (F.col("l_discount") + 0.0).alias("l_discount"), "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")


def cell(spark, d):
    """Cells of the root with those of the first line (or of none), so that orders and lines are gone through once."""
    one = lambda entity, field, value: F.struct(entity.alias("entity"), F.lit(field).alias("field_id"), value.cast("string").alias("value"))
    root = F.array(*(one(F.lit(""), f, F.col(c)) for f, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("totalprice", "o_totalprice"))))
    line = F.array(*(one(F.col("entity"), f, c) for f, c in (("quantity", F.col("l_quantity")), ("discount", F.col("l_discount") + 0.0), ("tax", F.col("l_tax")), ("returnflag", F.col("l_returnflag")))))
    every = F.when(F.col("position") < 0, root).when(F.col("position") == 0, F.concat(root, line)).otherwise(line)
    cells = _lines(spark, d).select("record_id", F.explode(every).alias("c")).select("record_id", "c.*")
    status = F.when((F.col("field_id") == "returnflag") & (F.col("value") == "N"), "not_reported").when((F.col("field_id") == "priority") & F.col("value").startswith("4"), "review_required").otherwise("present")
    return cells.select("record_id", "field_id", "entity", status.alias("status"), "value")


def order_schema():
    """The schema of order_json; number is any number."""
    line = lambda name, kind: FieldDefinition(f"lines[].{name}", kind, name)
    return Schema("order", "1.0", (FieldDefinition("status"), FieldDefinition("priority"), FieldDefinition("totalprice", "number"), line("quantity", "number"), line("discount", "number"), line("tax", "number"), line("returnflag", "string")))


def order_json(spark, d):
    """(record_id, record): orders as nested JSON records; the return flag N is null."""
    own = _lines(spark, d)
    one = F.struct("position", F.col("l_quantity").alias("quantity"), (F.col("l_discount") + 0.0).alias("discount"), F.col("l_tax").alias("tax"), F.nullif("l_returnflag", F.lit("N")).alias("returnflag"))
    both = own.groupBy("record_id", "o_orderstatus", "o_orderpriority", "o_totalprice").agg(F.array_sort(F.collect_list(F.when(F.col("position") >= 0, one))).alias("lines"))
    whole = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("totalprice"), F.transform("lines", lambda x: x.dropFields("position")).alias("lines"))
    return both.select("record_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("record"))


def unit(spark, d):
    """Lines of documents, empty ones dropped but counted."""
    each = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where("text <> ''")
    section = F.when(F.col("ordinal") == 0, "title").when(F.col("ordinal") == 1, "abstract").when(F.col("ordinal") % 2 == 0, "methods").otherwise("results")
    labels = F.array_compact(F.array(F.when(F.col("text").contains("@"), "mail"), F.when(F.col("text").rlike("[0-9]{6}"), "number"), F.when(F.length("text") > 400, "long")))
    return each.select("source_id", F.concat(section, F.lit(":"), "ordinal").alias("unit_id"), F.when(F.col("ordinal") == 0, "title").otherwise("paragraph").alias("kind"), section.alias("section"), "text", "ordinal", labels.alias("labels"), "lang")


def log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("record_id"), F.col("event_type").alias("field_id"), F.lit("").alias("entity"), F.round("value", 2).cast("string").alias("value"), F.col("ts").alias("created_at"), F.col("event_id").alias("artifact_id"), "props")


def gold(spark, d):
    """Quality labels against a rule on length."""
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.col("doc_id").cast("string").alias("record_id"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("field_id"), F.lit("").alias("entity"), "quality", "toxic", "n_chars")


EDGES = [("order@1.0", "order@1.1", "m1", 0, 1, 3), ("order@1.1", "order@1.2", "m2", 1, 0, 2), ("order@1.0", "order@1.2", "m3", 2, 0, 1), ("order@1.2", "order@2.0", "m4", 0, 2, 4), ("order@1.1", "order@2.0", "m5", 1, 1, 2), ("order@2.0", "order@1.0", "m6", 2, 0, 1)]
FIELDS = [
    ("order@1.0", "status", "status", "", "string", False, True, "h-status-1", ["F", "O", "P"], None, None), ("order@1.0", "priority", "priority", "", "string", False, False, "h-priority-1", ["1-URGENT", "2-HIGH", "3-MEDIUM"], None, None),
    ("order@1.0", "totalprice", "totalprice", "", "number", False, True, "h-total-1", [], 0.0, 400000.0), ("order@1.0", "quantity", "lines[].quantity", "lines[]", "number", False, True, "h-qty-1", [], 1.0, 50.0),
    ("order@1.0", "discount", "lines[].discount", "lines[]", "number", False, False, "h-disc-1", [], None, None), ("order@1.0", "returnflag", "lines[].returnflag", "lines[]", "string", False, False, "h-flag-1", ["A", "N", "R"], None, None),
    ("order@1.1", "status", "state", "", "string", False, True, "h-status-1", ["F", "O", "P", "X"], None, None), ("order@1.1", "priority", "priority", "", "string", False, True, "h-priority-2", ["1-URGENT", "2-HIGH"], None, None),
    ("order@1.1", "totalprice", "totalprice", "", "number", False, True, "h-total-1", [], 0.0, 300000.0), ("order@1.1", "quantity", "lines[].quantity", "lines[]", "integer", False, True, "h-qty-2", [], 1.0, 45.0),
    ("order@1.1", "discount", "discount", "", "number", True, False, "h-disc-1", [], None, None), ("order@1.1", "tax", "lines[].tax", "lines[]", "number", False, False, "h-tax-1", [], 0.0, 0.06),
]
FIELD_ROW = "schema_ref string, field_id string, path string, collection string, base_type string, multivalued boolean, required boolean, semantic_key string, enum array<string>, minimum double, maximum double"
STEPS = [("s1", "", ["status"], ["status"]), ("s2", "lines[]", ["quantity", "status"], ["quantity"]), ("s3", "lines[]", ["returnflag"], ["returnflag"]), ("s4", "", ["missing_field"], ["priority"])]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, migration_id string, fidelity int, semantic int, steps int")


def fields(spark, ref: str | None = None):
    df = spark.createDataFrame(FIELDS, FIELD_ROW)
    return df if ref is None else df.where(F.col("schema_ref") == ref)


def steps(spark):
    return spark.createDataFrame(STEPS, "step_id string, scope string, reads array<string>, writes array<string>")


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "CAST([" + ", ".join(_sql(x) for x in v) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in rows)


VIEWS = {
    "b_record": ("", """SELECT 'ord:' || o_orderkey AS record_id, CASE WHEN year(o_orderdate) < 1998 THEN 'order@1.0' ELSE 'order@1.1' END AS schema_ref,
        CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'review_needed' END AS state, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate FROM orders"""),
    "b_entity": ("", """SELECT 'ord:' || o_orderkey AS record_id, CASE WHEN l_orderkey IS NULL THEN 'lines[]=∅' ELSE 'lines[]=#' || p END AS entity, CAST(CASE WHEN l_orderkey IS NULL THEN -1 ELSE p END AS INTEGER) AS position,
        l_quantity, l_discount + 0.0 AS l_discount, l_tax, l_returnflag, l_linestatus, l_extendedprice FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS p FROM lineitem) ON o_orderkey = l_orderkey"""),
    "b_cell": ("b_record b_entity", """SELECT record_id, field_id, entity, CASE WHEN field_id = 'returnflag' AND value = 'N' THEN 'not_reported' WHEN field_id = 'priority' AND starts_with(value, '4') THEN 'review_required' ELSE 'present' END AS status, value FROM (
        SELECT record_id, '' AS entity, unnest(['status', 'priority', 'totalprice']) AS field_id, unnest([o_orderstatus, o_orderpriority, CAST(o_totalprice AS VARCHAR)]) AS value FROM b_record
        UNION ALL SELECT record_id, entity, unnest(['quantity', 'discount', 'tax', 'returnflag']), unnest([CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_tax AS VARCHAR), l_returnflag]) FROM b_entity WHERE position >= 0)"""),
    "b_unit": ("", """SELECT source_id, section || ':' || ordinal AS unit_id, CASE WHEN ordinal = 0 THEN 'title' ELSE 'paragraph' END AS kind, section, text, CAST(ordinal AS INTEGER) AS ordinal,
        list_filter([CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]{6}') THEN 'number' END, CASE WHEN length(text) > 400 THEN 'long' END], lambda x: x IS NOT NULL) AS labels, lang FROM (
        SELECT *, CASE WHEN ordinal = 0 THEN 'title' WHEN ordinal = 1 THEN 'abstract' WHEN ordinal % 2 = 0 THEN 'methods' ELSE 'results' END AS section FROM (
        SELECT doc_id AS source_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents) WHERE text <> '')"""),
    "b_log": ("", "SELECT CAST(user_id AS VARCHAR) AS record_id, event_type AS field_id, '' AS entity, CAST(round(value, 2) AS VARCHAR) AS value, ts AS created_at, event_id AS artifact_id, props FROM events"),
    "b_gold": ("", "SELECT CAST(doc_id AS VARCHAR) AS record_id, unnest(['quality', 'toxic']) AS field_id, '' AS entity, quality, toxic, n_chars FROM labels JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)"),
    "b_edge": ("", f"SELECT * FROM ({_values(EDGES)}) t(src, dst, migration_id, fidelity, semantic, steps)"),
    "b_field": ("", f"SELECT * FROM ({_values(FIELDS)}) t(schema_ref, field_id, path, collection, base_type, multivalued, required, semantic_key, enum, minimum, maximum)"),
    "b_step": ("", f"SELECT * FROM ({_values(STEPS)}) t(step_id, scope, reads, writes)"),
}


def sql(query: str, *views: str, recursive: bool = False) -> str:
    """query with the views that it names, and those that they need, in front."""
    need: list[str] = []

    def add(v: str) -> None:
        for x in VIEWS[v][0].split():
            add(x)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    head = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in need)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if query.startswith('+') else ' '}{query.removeprefix('+')}"
