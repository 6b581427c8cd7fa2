"""Raw messages to typed, enriched tables: column expressions alone, no shuffle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake import schemas
from wirelake.functions import scalars as S


def parse_envelope(df: DataFrame, value: str = "value", log_type: str | None = None) -> DataFrame:
    """log_type, nested, data (variant), raw: the first known type whose key holds an object, else log_type, else _path.

    Rows that hold none of these, or no JSON, keep a null log_type. nested: the fields lie below the type's key.
    One parse finds the known keys and skips what they hold; data is parsed only where it is asked for. With a
    log_type the same parse also reads that type's fields, as the struct record, for project_table.
    """
    marks = dict.fromkeys(("log_type", "_path"), "string") | dict.fromkeys(schemas.LOG_TYPES, "struct<_: boolean>") | {"_corrupt_record": "string"}
    if log_type and set(schemas.raw_fields(log_type)) & set(schemas.LOG_TYPES):
        log_type = None  # a field is named as a type is: project_table reads the fields by itself
    top = _fields(log_type) if log_type else {}
    own = {log_type: _struct(top)} if log_type else {}
    # an object's fields are skipped; what is no object leaves null and marks the record, so that is looked at again
    # a generator's output is worked out once: a filter on what follows can't pull the parse into itself
    # a brace that neither a quote nor its end follows begins no JSON: such a message costs no parser's exceptions
    parsed = F.when(~F.coalesce(F.col(value).rlike(r"""^\s*\{\s*[^\s"'}]"""), F.lit(False)), F.from_json(F.col(value), _struct(marks | own | top)))
    rows = df.select(*df.columns, F.explode(F.array(parsed)).alias("_m"))
    nested = F.coalesce(*(F.when(F.col("_m")[t].isNotNull(), t) for t in schemas.LOG_TYPES))
    name = lambda f: F.when(~_plain(F.col("_m")[f]), _string(F.try_variant_get(F.try_parse_json(value), f"$.{f}", "variant"))).otherwise(F.col("_m")[f])
    misfit = F.trim(value).endswith("}") & F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))
    sound = F.col("_m").isNotNull() & (F.trim(value) != "") & (F.col("_m._corrupt_record").isNull() | misfit)
    facts = [nested.alias("nested"), name("log_type").alias("log_type"), name("_path").alias("_path"), sound.alias("sound")]
    if log_type:
        facts.append(F.when(nested == log_type, F.col("_m")[log_type]).otherwise(F.struct(*(F.col("_m").getField(f).alias(f) for f in top))).alias("record"))
    rows = rows.select(*df.columns, F.explode(F.array(F.struct(*facts))).alias("_m"))
    data = _data(F.col(value), F.col("_m.nested"))
    found = F.when(F.col("_m.sound"), F.coalesce("_m.nested", "_m.log_type", "_m._path"))
    record = [F.col("_m.record")] if log_type else []
    return rows.select(*df.columns, found.alias("log_type"), F.col("_m.nested").isNotNull().alias("nested"), F.when(F.col("_m.sound"), data).alias("data"), F.col(value).alias("raw"), F.col("_m.sound").alias("sound"), *record)


def split_dead_letters(parsed: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows of known types, dead letters with error_type and a preview of the message).

    A message without a type of its own whose first object lies below any other key is of an unknown type.
    """
    known = F.col("sound") & F.coalesce(F.col("log_type").isin(*schemas.LOG_TYPES), F.lit(False))
    objects = F.map_filter(F.from_json(F.col(value), "map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    error = F.when(~F.col("sound"), "parse_error").when(F.col("log_type").isNull() & (F.coalesce(F.size(objects), F.lit(0)) < 1), "missing_log_type").otherwise("unknown_log_type")
    preview = F.when(F.col("error_type") == "parse_error", F.substring(value, 1, 100)).otherwise(F.substring(value, 1, 200))
    bad = parsed.filter(~known).withColumn("error_type", error)
    return parsed.filter(known).drop("sound"), bad.select("error_type", preview.alias("preview"))


def _data(raw: Column, nested: Column) -> Column:
    """The message's fields as a variant: what lies below the key that nested names, or the whole."""
    inner = F.coalesce(*(F.when(nested == t, F.try_variant_get(F.try_parse_json(raw), f"$.{t}", "variant")) for t in schemas.LOG_TYPES))
    return F.when(nested.isNotNull(), inner).otherwise(F.try_parse_json(raw))


def _string(v: Column) -> Column:
    """A variant that is a JSON string; else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _plain(text: Column) -> Column:
    """Whether a field read as text can only have been a JSON string: it looks like no number, flag or object."""
    return ~text.rlike(r"^(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$|true$|false$|\{|\[)")


def _fields(log_type: str) -> dict[str, str]:
    """Parse types: numbers and flags as such, so other JSON types come out null; text fields as the text they hold."""
    kinds = {"int": "double", "bigint": "double", "double": "double", "boolean": "boolean", "string": "string"}
    return {f: "string" if f == "ts" else kinds[k] for f, k in schemas.raw_fields(log_type).items()}


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"`{f}`: {k}" for f, k in fields.items()) + ">"


def _read(raw: Column, nested: Column, log_type: str) -> Column:
    """The message's fields as one struct, from below the type's key or from the top."""
    fields = _struct(_fields(log_type))
    return F.when(nested, F.from_json(raw, f"struct<{log_type}: {fields}>").getField(log_type)).otherwise(F.from_json(raw, fields))


def _again(log_type: str, field: str) -> Column:
    """A field of the message as a variant: asked for only where its text leaves open what it was."""
    below, top = F.from_json("raw", f"struct<{log_type}: struct<`{field}`: variant>>").getField(log_type), F.from_json("raw", f"struct<`{field}`: variant>")
    return F.when(F.col("nested"), below.getField(field)).otherwise(top.getField(field))


def _typed(log_type: str, field: str, kind: str) -> Column:
    """A parsed field as its declared type; arrays as JSON text; a misfit is null."""
    v = F.col("_record").getField(field)
    if kind in ("int", "bigint"):
        return v.try_cast("bigint").try_cast(kind)
    if kind in ("double", "boolean"):
        return v
    # a text that begins as an array is the same whether it was one or a string
    return F.when(~v.startswith("[") & ~_plain(v), _string(_again(log_type, field))).otherwise(v)


def project_table(parsed: DataFrame, log_type: str, ingest_ms: Column | None = None, zero_fill: bool = False) -> DataFrame:
    """The typed, enriched rows of one log type. zero_fill: missing values become 0, false or empty text.

    parsed: from parse_envelope; where that was told the log type, its record is taken as it is.
    """
    promoted = schemas.promotions(log_type)
    canonical = set(promoted.values())
    event_time = S.event_ms(F.col("_record").getField("ts"))
    columns = {
        "ftx_id": F.sha2(F.concat(F.lit(log_type), F.col("raw")).cast("binary"), 256),
        "event_type": F.lit(schemas.EVENT_TYPE[log_type]),
        "event_class": F.lit(schemas.EVENT_CLASS[log_type]),
        "event_time": event_time,
        "ingest_time": F.coalesce(ingest_ms, event_time) if ingest_ms is not None else event_time,
        "flow_id": _typed(log_type, "uid", "string") if "uid" in schemas.raw_fields(log_type) else F.lit(None).cast("string"),
    }
    if "src_ip" in canonical:
        columns |= {"src_ip": _typed(log_type, "id.orig_h", "string"), "dst_ip": _typed(log_type, "id.resp_h", "string")}
    if "src_port" in canonical:
        columns |= {"src_port": _typed(log_type, "id.orig_p", "int"), "dst_port": _typed(log_type, "id.resp_p", "int")}
    if "protocol" in canonical:
        columns["protocol"] = _typed(log_type, "proto", "string")
    raw = {schemas.table_column(log_type, f): _typed(log_type, f, k) for f, k in schemas.raw_fields(log_type).items() if f not in promoted and not (log_type == "conn" and f == "service")}
    record = F.col("record") if "record" in parsed.columns else F.explode(F.array(_read(F.col("raw"), F.col("nested"), log_type)))
    rows = parsed.filter(F.col("log_type") == log_type).select("raw", "nested", record.alias("_record"))
    rows = rows.select(*(c.alias(n) for n, c in {**columns, **raw}.items()), F.col("raw").alias("raw_log"))
    rows = enrich(rows, schemas.has_network(log_type))
    if zero_fill:
        zeros = {"string": F.lit(""), "boolean": F.lit(False)}
        rows = rows.select(*(F.coalesce(F.col(n), zeros.get(k, F.lit(0).cast(k))).alias(n) for n, k in rows.dtypes))
    return rows


@lru_cache(maxsize=len(schemas.LOG_TYPES))
def _table_schema(log_type: str, session: object) -> T.StructType:
    empty = session.createDataFrame([], "value string")
    return project_table(parse_envelope(empty, log_type=log_type), log_type).schema


def table_schema(spark: SparkSession, log_type: str) -> T.StructType:
    """The columns of a log type's typed table, all nullable."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in _table_schema(log_type, spark).fields])


def enrich(rows: DataFrame, network: bool = True) -> DataFrame:
    """Adds time parts, private flags, direction and service to canonical columns."""
    has = rows.columns
    none = F.lit(None).cast("string")
    src, dst = (F.col("src_ip"), F.col("dst_ip")) if network and "src_ip" in has else (none, none)
    port = F.col("dst_port") if "dst_port" in has else F.lit(0)
    protocol = F.col("protocol") if "protocol" in has else none
    # the flags first: each address is looked at once
    rows = rows.withColumns({"src_ip_is_private": S.is_private_ip(src), "dst_ip_is_private": S.is_private_ip(dst)})
    added = S.time_parts(F.col("event_time")) | {
        "direction": S.direction_of(src, dst, F.col("src_ip_is_private"), F.col("dst_ip_is_private")) if network else F.lit(""),
        "service": S.service_from(F.coalesce(port, F.lit(0)), protocol) if network else F.lit(""),
    }
    return rows.withColumns(added)


def details_map(data: Column, promoted: tuple[str, ...] = ("ts", "uid", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "service", "log_type")) -> Column:
    """All other fields as text."""
    return F.map_filter(F.from_json(F.to_json(data), "map<string,string>"), lambda k, v: ~k.isin(*promoted))


def message_hour(raw: Column) -> Column:
    """The hour of a message's first ts, found without a parse: a clue by which messages are dealt out, not what they say."""
    return F.floor(S.event_ms(F.regexp_extract(raw, r'"ts"\s*:\s*"?([^",}]*)', 1)) / 3_600_000)


def lookup_keys(parsed: DataFrame) -> DataFrame:
    """Messages of known types as they came, with what an asset is looked up by: log_type, nested, raw, src_ip, event_time.

    These are the rows to move: to_stream_record reads the other fields from raw afterwards.
    """
    fields = F.try_variant_get("data", "$", "struct<ts: variant, `id.orig_h`: variant>")
    rows = parsed.select("log_type", "nested", "raw", F.explode(F.array(fields)).alias("_f"))
    at = lambda f: F.col("_f").getField(f)
    return rows.select("log_type", "nested", "raw", _string(at("id.orig_h")).alias("src_ip"), S.event_ms(F.try_variant_get(at("ts"), "$", "string")).alias("event_time"))


def to_stream_record(parsed: DataFrame, ingest_ms: Column | None = None) -> DataFrame:
    """The flat record of the enriched stream for rows of any known type.

    parsed: from parse_envelope, or from lookup_keys with asset_id and asset_type. The asset columns, if not given, and the
    blacklist flags are empty here; asset_columns and flag_threat_ips fill them.
    """
    told = [c for c in ("src_ip", "event_time", "asset_id", "asset_type") if c in parsed.columns]
    if "data" not in parsed.columns:
        parsed = parsed.select("log_type", _data(F.col("raw"), F.when(F.col("nested"), F.col("log_type"))).alias("data"), "raw", *told)
    own = ("ts", "uid", "id.orig_h", "id.resp_h", "proto", "id.orig_p", "id.resp_p", "service")
    # one look at the message for all its fields, worked out once as a generator's output is
    fields = F.try_variant_get("data", "$", "struct<" + ", ".join(f"`{f}`: variant" for f in own) + ">")
    parsed = parsed.select("log_type", "data", "raw", *told, F.explode(F.array(fields)).alias("_f"))
    at = lambda f: F.col("_f").getField(f)
    given = lambda name, c: F.col(name) if name in told else c
    ts = at("ts")
    port = lambda f: F.when(F.schema_of_variant(at(f)).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(at(f), "$", "double")).try_cast("bigint").try_cast("int")
    service = at("service")
    rows = parsed.select(
        "log_type", "data", "raw", given("event_time", S.event_ms(F.try_variant_get(ts, "$", "string"))).alias("event_time"),
        *(given(n, _string(at(f))).alias(n) for f, n in (("uid", "uid"), ("id.orig_h", "src_ip"), ("id.resp_h", "dst_ip"), ("proto", "protocol"))),
        *(given(n, F.lit("")).alias(n) for n in ("asset_id", "asset_type")),
        port("id.orig_p").alias("src_port"), port("id.resp_p").alias("dst_port"),
        F.when(service.isNotNull() & ~F.is_variant_null(service), F.coalesce(_string(service), F.lit(""))).alias("own_service"),
    )
    rows = enrich(rows)
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))[F.col("log_type")]
    return rows.select(
        S.iso_time(F.col("event_time")).alias("ts"),
        F.sha2(F.concat("log_type", "raw").cast("binary"), 256).alias("ftx_id"),
        "uid", "log_type", F.lit("zeek").alias("log_source"), "src_ip", "dst_ip", "src_port", "dst_port",
        F.col("protocol").alias("proto"), F.coalesce("own_service", "service").alias("service"),
        table(schemas.EVENT_TYPE).alias("event_type"), table(schemas.EVENT_CLASS).alias("event_class"),
        "asset_id", "asset_type", F.lit(False).alias("src_is_blacklisted"), F.lit(False).alias("dst_is_blacklisted"),
        "src_ip_is_private", "dst_ip_is_private", "direction",
        (ingest_ms if ingest_ms is not None else F.col("event_time")).alias("ingest_time"),
        "event_year", "event_month", "event_day", "event_hour", "event_weekday", details_map(F.col("data")).alias("details"), "event_time",
    )
