"""Nested records as cells, and back.

A cell is (record_id, field_id, entity, status, value_json, reason). Decomposition is compiled from the schema: one projection for each collection,
posexplode down to it, then one array of structs for its fields. Assembly groups cells to objects bottom-up."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.model.schema import Schema

EMPTY = "∅"
STATUS_OF = {"extracted": "present", "not_reported": "not_reported", "not_applicable": "not_applicable", "failed": "extraction_failed"}
TEXT_OF = {"present": "extracted", "not_reported": "not_reported", "not_applicable": "not_applicable", "extraction_failed": "failed", "unknown": "not_reported", "not_extracted": "not_reported", "review_required": "extracted"}


def _quoted(text: Column) -> Column:
    for a, b in (("%", "%25"), ("/", "%2F"), ("=", "%3D"), ("@", "%40")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_get(doc: Column, path: list[str], kind: str = "variant") -> Column:
    """What a VARIANT document has at a path: null where missing; a JSON null is a value."""
    return F.try_variant_get(doc, "$." + ".".join(path), kind) if path else doc


def _text(value: Column) -> Column:
    return F.to_json(value)


def plain_decode(raw: Column) -> tuple[Column, Column, Column]:
    """(status, value_json, reason): missing is not_extracted, null is not_reported."""
    status = F.when(raw.isNull(), "not_extracted").when(F.is_variant_null(raw), "not_reported").otherwise("present")
    return status, F.when(status == "present", _text(raw)), F.lit(None).cast("string")


def wrapped_decode(raw: Column) -> tuple[Column, Column, Column]:
    """(status, value_json, reason) of a wrapped value {extraction_status, value, unreported_reason, status}; anything else counts as present.

    The exact status that wrapped_encode writes beside the wrapper is read back first."""
    state, exact, reason = (F.try_variant_get(raw, f"$.{k}", "string") for k in ("extraction_status", "status", "unreported_reason"))
    mapped = F.when(exact.isin(*TEXT_OF), exact).when(reason == "undetermined", "unknown")
    for k, v in STATUS_OF.items():
        mapped = mapped.when(state == k, v)
    wrapped = state.isNotNull()
    status = F.when(raw.isNull(), "not_extracted").when(F.is_variant_null(raw), "not_reported").when(wrapped, mapped.otherwise("not_reported")).otherwise("present")
    value = F.when(wrapped, F.try_variant_get(raw, "$.value", "variant")).otherwise(raw)
    return status, F.when(status.isin("present", "review_required"), _text(value)), F.when(wrapped, reason)


def wrapped_encode(status: Column, value_json: Column, reason: Column, n_spans: Column) -> Column:
    """The wrapper of a value as JSON text; the exact status goes along, so that import gives it back."""
    state = F.create_map(*(F.lit(x) for kv in TEXT_OF.items() for x in kv))[status]
    found = F.when(status.isin("present", "review_required"), F.when(n_spans > 0, "present").otherwise("not_found")).otherwise("not_applicable")
    return F.to_json(F.struct(state.alias("extraction_status"), F.parse_json(value_json).alias("value"), reason.alias("unreported_reason"), F.struct(found.alias("status")).alias("evidence"), status.alias("status")))


def decompose(records: DataFrame, schema: Schema, doc: str = "record", record_id: str = "record_id", wrapped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, entities) of JSON records. Every declared field gives a cell in every entity of its collection, absent ones too.

    Entities: (record_id, entity, collection_path, local_id, position, parent); an empty collection gives one entity ∅ at -1; a member
    without identity is #position. A null or unreadable document gives absent root cells. Each of the two goes through the records once: the entities of a document are one array."""
    whole = F.coalesce(F.try_parse_json(F.col(doc)), F.parse_json(F.lit("{}")))
    node = lambda *parts: F.struct(*(p.alias(n) for p, n in zip(parts, ("entity", "collection_path", "local_id", "position", "parent", "doc"), strict=True)))
    out = records.select(F.col(record_id).alias("record_id"), F.array(node(F.lit(""), F.lit(""), F.lit(""), F.lit(0), F.lit(""), whole)).alias("_"))
    paths, names = sorted(schema.collections(), key=lambda p: (p.count("[]"), p)), {"": "_"}
    for k, path in enumerate(paths):
        parent, names[path] = schema.parent_collection(path), f"_{k}"
        identity, at = schema.identity_field(path), schema.relative(path, parent).removesuffix("[]").split(".")

        def member(up: Column, item: Column, position: Column) -> Column:  # noqa: B023  used up within the loop
            own = F.coalesce(*(F.try_variant_get(item, f"$.{identity}{tail}", "string") for tail in (".value", ""))) if identity else F.lit(None).cast("string")
            local = F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("#"), position.cast("string")))
            return node(F.concat(_inside(up), F.lit(f"{path}="), _quoted(local)), F.lit(path), local, position, up["entity"], item)

        def members(up: Column) -> Column:
            none = node(F.concat(_inside(up), F.lit(f"{path}={EMPTY}")), F.lit(path), F.lit(EMPTY), F.lit(-1), up["entity"], F.lit(None).cast("variant"))
            of = lambda x: F.when(F.size(x["items"]) == 0, F.array(none)).otherwise(F.transform(x["items"], lambda item, n: member(up, item, n)))
            found = F.transform(F.array(F.struct(json_get(up["doc"], at, "array<variant>").alias("items"))), lambda x: F.coalesce(of(x), F.slice(F.array(none), 1, 0)))
            return F.get(found, F.lit(0))

        out = out.withColumn(names[path], F.flatten(F.transform(F.filter(names[parent], lambda u: u["position"] >= 0), members)))
    nodes = out.select("record_id", F.explode(F.concat(*names.values())).alias("n")).select("record_id", "n.*")
    raws, fields = F, F
    for path in names:
        of = schema.fields_in(path)
        if not of:
            continue
        here = (F.col("collection_path") == path) & (F.col("position") >= 0)
        raws = raws.when(here, F.array(*(json_get(F.col("doc"), schema.relative(f.path, path).split(".")) for f in of)))  # each is taken out of the document once
        structs = []
        for k, f in enumerate(of):
            raw = F.get(F.col("raw"), F.lit(k))
            status, value, reason = wrapped_decode(raw) if wrapped else plain_decode(raw)
            structs.append(F.struct(F.lit(f.field_id).alias("field_id"), status.alias("status"), value.alias("value_json"), reason.alias("reason")))
        fields = fields.when(here, F.array(*structs))
    cells = nodes.withColumn("raw", raws).select("record_id", "entity", F.explode(fields).alias("c")).select("record_id", "c.field_id", "entity", "c.status", "c.value_json", "c.reason")
    return cells, nodes.drop("doc")


def _inside(up: Column) -> Column:
    """What the key of a member begins with: its parent's key, where that isn't the root."""
    return F.when(up["entity"] == "", F.lit("")).otherwise(F.concat(up["entity"], F.lit("/")))


def assemble(cells: DataFrame, entities: DataFrame, schema: Schema, include_absent: bool = False) -> DataFrame:
    """(record_id, record): JSON text of every record. Cells of unknown fields or entities are dropped; members are in order of position, then key.

    Cells and entities meet in one aggregation by record and entity; then each collection is folded into its parent from the deepest up, in one more each."""
    fields = {f.field_id: f for f in schema.fields}
    place = F.create_map(*(F.lit(x) for f in schema.fields for x in (f.field_id, schema.relative(f.path, f.collection))))
    known = cells.where(F.col("field_id").isin(*fields))
    if not include_absent:
        known = known.where(F.col("status").isin("present", "review_required"))
    leaf = "struct<path:string,value:string>"
    leaves = known.select("record_id", "entity", F.struct(place[F.col("field_id")].alias("path"), F.coalesce("value_json", F.lit("null")).alias("value")).cast(leaf).alias("leaf"))
    own = entities.select("record_id", "entity", F.struct("collection_path", "position", "parent").alias("at"))
    nodes = leaves.unionByName(own, allowMissingColumns=True).groupBy("record_id", "entity").agg(F.max("at").alias("at"), F.collect_list("leaf").alias("leaves")).where("at IS NOT NULL")
    for path in sorted(schema.collections(), key=lambda p: (-p.count("[]"), p)):
        here = F.col("at.collection_path") == path
        parent = schema.parent_collection(path)
        name = schema.relative(path, parent).removesuffix("[]")
        # members go to their parent, all others stay: one pass whatever the number of collections
        member = F.when(here, F.struct(F.col("at.position").alias("position"), F.col("entity").alias("key"), F.when(F.col("at.position") >= 0, _object(F.col("leaves"))).alias("object")))
        moved = nodes.select("record_id", F.when(here, F.col("at.parent")).otherwise(F.col("entity")).alias("entity"), F.when(~here, F.col("at")).alias("at"), F.when(~here, F.col("leaves")).alias("leaves"), member.alias("member"))
        per = moved.groupBy("record_id", "entity").agg(F.max("at").alias("at"), F.flatten(F.collect_list("leaves")).alias("leaves"), F.collect_list("member").alias("members")).where("at IS NOT NULL")
        listed = F.array_join(F.transform(F.filter(F.array_sort("members"), lambda m: m["object"].isNotNull()), lambda m: m["object"]), ",")
        whole = F.array(F.struct(F.lit(name).alias("path"), F.concat(F.lit("["), listed, F.lit("]")).alias("value")).cast(leaf))
        nodes = per.select("record_id", "entity", "at", F.when(F.size("members") > 0, F.concat("leaves", whole)).otherwise(F.col("leaves")).alias("leaves"))
    return nodes.where("at.collection_path = ''").select("record_id", _object(F.col("leaves")).alias("record"))


def _object(leaves: Column) -> Column:
    """Leaves (dotted path, JSON text) as one JSON object; one nested level a dot, folded by common beginnings (two levels, as deep as declared paths go)."""

    def flat(items: Column) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x["path"], F.lit('":'), x["value"])), ","), F.lit("}"))

    top = F.filter(leaves, lambda x: F.instr(x["path"], ".") == 0)
    deep = F.filter(leaves, lambda x: F.instr(x["path"], ".") > 0)
    heads = F.array_distinct(F.transform(deep, lambda x: F.substring_index(x["path"], ".", 1)))
    inner = F.transform(
        heads,
        lambda h: F.struct(
            h.alias("path"),
            flat(F.transform(F.filter(deep, lambda x: F.substring_index(x["path"], ".", 1) == h), lambda x: F.struct(F.substring(x["path"], F.length(h) + 2, F.length(x["path"])).alias("path"), x["value"].alias("value")))).alias("value"),
        ),
    )
    return flat(F.array_sort(F.concat(top, inner)))


def value_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
