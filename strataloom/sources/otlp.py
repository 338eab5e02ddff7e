"""OTLP traces, as JSON or protobuf files, into flat spans.

JSON is read by Spark itself; protobuf is decoded by a small wire-format reader in Arrow
batches. Field numbers are those of the public definition; `TAGS_ALTERNATIVE` has a second
numbering that some exporters use. Bad files give an error row instead of spans.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
KV = f"array<struct<key:string,value:{VALUE}>>"
JSON = f"struct<resourceSpans:array<struct<resource:struct<attributes:{KV}>,scopeSpans:array<struct<spans:array<struct<name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{KV},status:struct<code:string,message:string>>>>>>>>"
SPAN = "name string, function_name string, file_path string, line_number int, service_name string, start_ns bigint, end_ns bigint, duration_ms double, attributes map<string,string>, source string, error string"

FUNCTION, PATHS, LINES = "code.function.name", ("code.file.path", "code.filepath"), ("code.line.number", "code.lineno")

TAGS = {"span_name": 5, "start": 7, "end": 8, "attributes": 9, "status": 15, "message": 2, "code": 3, "string": 1, "bool": 2, "int": 3, "double": 4}
TAGS_ALTERNATIVE = TAGS | {"span_name": 2, "code": 2, "message": 3, "int": 2, "double": 3, "bool": 4}


def _text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _find(attributes: Column, *keys: str) -> Column:
    hits = F.filter(attributes, lambda a: a["key"].isin(*keys))
    return F.when(F.size(hits) > 0, _text(F.element_at(hits, -1)["value"]))


def read_json(spark: SparkSession, path: str, with_status: bool = True) -> DataFrame:
    """Spans of JSON files; status code and message join the attributes if wanted. The last of equal keys wins."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", JSON).alias("d"), F.col("_metadata.file_path").alias("source"), "value")
    bad = docs.where("d is null or (d.resourceSpans is null and length(trim(value)) > 0 and not value like '%resourceSpans%')")
    rows = docs.select("source", F.explode("d.resourceSpans").alias("r"))
    service = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    rows = rows.select("source", F.when(F.size(service) > 0, F.element_at(service, 1)["value"]["stringValue"]).alias("service_name"), F.explode("r.scopeSpans").alias("sc"))
    rows = rows.select("source", "service_name", F.explode("sc.spans").alias("s"))
    attributes = F.coalesce("s.attributes", F.array().cast(KV))
    known = (FUNCTION, *PATHS, *LINES)
    rest = F.filter(attributes, lambda a: ~a["key"].isin(*known))
    keys = F.array_distinct(F.transform(rest, lambda a: a["key"]))
    pairs = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), _text(F.element_at(F.filter(rest, lambda a: a["key"] == k), -1)["value"]).alias("v"))))
    if with_status:
        status = F.map_filter(F.create_map(F.lit("status.code"), F.col("s.status.code"), F.lit("status.message"), F.col("s.status.message")), lambda k, v: v.isNotNull() & (v != ""))
        pairs = F.map_concat(F.map_filter(pairs, lambda k, v: ~k.isin("status.code", "status.message")), status)
    start, end = F.expr("try_cast(s.startTimeUnixNano as bigint)"), F.expr("try_cast(s.endTimeUnixNano as bigint)")
    spans = rows.select(
        F.col("s.name").alias("name"), _find(attributes, FUNCTION).alias("function_name"), _find(attributes, *PATHS).alias("file_path"), _find(attributes, *LINES).alias("l"),
        "service_name", start.alias("start_ns"), end.alias("end_ns"), F.when(end >= start, (end - start) / 1e6).alias("duration_ms"), pairs.alias("attributes"), "source",
    )
    spans = spans.withColumn("line_number", F.expr("try_cast(l as int)")).withColumn("error", F.lit(None).cast("string"))
    columns = [c.split()[0] for c in SPAN.split(", ")]
    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SPAN.split(", ")[:9]]
    return spans.select(*columns).unionByName(bad.select(*empty, "source", F.lit("not an OTLP document").alias("error")))


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n, shift = 0, 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: integers for varints and fixed fields, bytes for the rest."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 1:
            value, at = struct.unpack_from("<Q", b, at)[0], at + 8
        elif kind == 2:
            n, at = _varint(b, at)
            if at + n > len(b):
                raise ValueError("message cut short")
            value, at = b[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<I", b, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def _value(b: bytes, tags: dict[str, int]) -> str | None:
    for n, v in fields(b):
        if n == tags["string"] and isinstance(v, bytes):
            return v.decode()
        if n == tags["int"]:
            return str(v - (1 << 64) if v >> 63 else v)
        if n == tags["double"]:
            return repr(struct.unpack("<d", struct.pack("<Q", v))[0])
        if n == tags["bool"]:
            return str(bool(v)).lower()
    return None


def _pair(b: bytes, tags: dict[str, int]) -> tuple[str, str | None]:
    got = dict(fields(b))
    return got.get(1, b"").decode(), _value(got[2], tags) if 2 in got else None


def decode(data: bytes, tags: dict[str, int] = TAGS) -> list[dict]:
    """Flat spans of an export request."""
    out = []
    for n, resource_spans in fields(data):
        if n != 1:
            continue
        parts = list(fields(resource_spans))
        resource = [_pair(a, tags) for m, r in parts if m == 1 for k, a in fields(r) if k == 1]
        service = next((v for k, v in resource if k == "service.name"), None)
        for span in (s for m, scope in parts if m == 2 for k, s in fields(scope) if k == 2):
            name, start, end, attributes = "", 0, 0, {}
            for k, v in fields(span):
                if k == tags["span_name"] and isinstance(v, bytes):
                    name = v.decode()
                elif k == tags["start"] and isinstance(v, int):
                    start = v
                elif k == tags["end"] and isinstance(v, int):
                    end = v
                elif k == tags["attributes"]:
                    key, value = _pair(v, tags)
                    attributes[key] = value
                elif k == tags["status"]:
                    status = dict(fields(v))
                    if tags["code"] in status:
                        attributes["status.code"] = str(status[tags["code"]])
                    if status.get(tags["message"]):
                        attributes["status.message"] = status[tags["message"]].decode()
            take = lambda *keys: next((attributes.pop(k) for k in keys if k in attributes), None)
            function, path, line = take(FUNCTION), take(*PATHS), take(*LINES)
            out.append(
                {
                    "name": name, "function_name": function, "file_path": path, "line_number": int(line) if line and line.isdigit() and int(line) < 1 << 31 else None,
                    "service_name": service, "start_ns": start, "end_ns": end, "duration_ms": (end - start) / 1e6 if end >= start else None, "attributes": attributes,
                }
            )
    return out


def read_protobuf(spark: SparkSession, path: str, tags: dict[str, int] = TAGS) -> DataFrame:
    """Spans of binary files; a file that does not decode gives one row with its error, an empty one none."""
    schema = pa.schema(
        [("name", pa.string()), ("function_name", pa.string()), ("file_path", pa.string()), ("line_number", pa.int32()), ("service_name", pa.string()), ("start_ns", pa.int64()), ("end_ns", pa.int64()),
         ("duration_ms", pa.float64()), ("attributes", pa.map_(pa.string(), pa.string())), ("source", pa.string()), ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [r | {"source": source, "error": None, "attributes": list(r["attributes"].items())} for r in decode(data, tags)]
                except (ValueError, IndexError, struct.error, UnicodeDecodeError, AttributeError, TypeError) as e:
                    rows = [dict.fromkeys(schema.names) | {"source": source, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SPAN)


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON by its suffix, protobuf otherwise."""
    return read_json(spark, path) if path.lower().endswith(".json") else read_protobuf(spark, path)
