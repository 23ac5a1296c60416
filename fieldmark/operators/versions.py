"""Instruction versions (V2, V3, J9) and record fingerprints (V5)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType,
                               ShortType, StringType, StructType)

from ..functions.matching import let
from ..functions.text import strip
from ..sources.tables import scratch_path
from .ordering import global_positions


def assign_versions(log: DataFrame, default_text: str, order_by: str | list[str] = "seq", text: str = "text") -> DataFrame:
    """V3: label every saved text: the default text is 'default'; a text already saved keeps the
    label of its first save; each new text gets v{n}, n counting new texts in save order (``order_by``, such as time,
    then id: together unique). Returns the log's other columns and ``version``; a null text has none.

    Texts are read once: what is stored, shuffled and compared is a SHA-256 of the trimmed text. Distinct
    texts are numbered with a range-partitioned position, so neither the log nor its distinct texts pass
    through one task."""
    spark, cols = log.sparkSession, [order_by] if isinstance(order_by, str) else list(order_by)
    is_default = F.coalesce(strip(F.col(text)) == F.lit(default_text.strip()), F.lit(False))
    # the default text matches no numbered one: its rows, often most of the log, are spread over many keys
    spread = F.concat(F.lit("default-"), F.pmod(F.xxhash64(*cols), F.lit(1024)).cast("string"))
    keyed = log.withColumn("_key", F.when(is_default, spread).otherwise(F.sha2(strip(F.col(text)), 256))).drop(text)
    path = scratch_path(spark, "version-keys")
    keyed.write.parquet(path)
    t = spark.read.schema(keyed.schema).parquet(path)
    firsts = t.where(~F.col("_key").startswith("default-")).groupBy("_key").agg(F.min(F.struct(*cols)).alias("_first"))
    numbered = global_positions(firsts.select("_key", *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(cols)]),
                                [f"_o{i}" for i in range(len(cols))], "_n")
    labelled = t.join(numbered.select("_key", "_n"), "_key", "left")
    return labelled.select(*[c for c in log.columns if c != text],
                           F.when(F.col("_key").startswith("default-"), F.lit("default"))
                           .otherwise(F.concat(F.lit("v"), F.col("_n").cast("string"))).alias("version"))


def version_of(runs: DataFrame, versions: DataFrame, default_text: str) -> DataFrame:
    """V2 + J9: the label of the instruction text each run used (equality without outer white space): 'default'
    first, then the earliest saved version with that text, else 'unsaved'; no text is null."""
    return version_by_key(runs, versions.select("seq", "version", F.sha2(strip(F.col("text")), 256).alias("text_key")), default_text)


def version_by_key(runs: DataFrame, versions: DataFrame, default_text: str) -> DataFrame:
    """``version_of`` where the versions carry ``text_key``, the SHA-256 of the trimmed text, in place of the text."""
    first = versions.groupBy(F.col("text_key").alias("_key")).agg(F.min_by("version", "seq").alias("_ver"))
    j = runs.withColumn("_key", F.sha2(strip(F.col("prompt")), 256)).join(first, "_key", "left")
    label = F.when(F.col("prompt").isNull(), F.lit(None).cast("string")) \
        .when(strip(F.col("prompt")) == F.lit(default_text.strip()), F.lit("default")) \
        .otherwise(F.coalesce("_ver", F.lit("unsaved")))
    return j.withColumn("version_of_text", label).drop("_key", "_ver")


def fingerprint(canonical_json: Column) -> Column:
    """V5: first 10 hex digits of SHA-256 of a canonical JSON text."""
    return F.substring(F.sha2(canonical_json, 256), 1, 10)


# --- canonical JSON ---------------------------------------------------------------------------------
_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _json_text(s: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and control characters escaped, all else as \\uXXXX (two of them
    beyond the basic plane)."""
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(c: Column) -> Column:
        out = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")
        for char, short in _SHORT.items():
            out = F.when(c == char, F.lit(short)).otherwise(out)
        return F.when(c.rlike(r"^[\x20-\x7e]$"), c).otherwise(out)

    odd = plain.rlike(r"[^\x20-\x7e]")
    body = F.when(odd, F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(r"(?s)."), 0), escaped), "")).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _json_double(x: Column) -> Column:
    """As Python prints it: plain between 1e-4 and 1e16, otherwise with a signed exponent of at least two digits. (The
    digits are Java's; before Java 19 it prints some doubles, such as 5e-324, with a digit more than needed.)"""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    special = F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("Infinity")).when(x == float("-inf"), F.lit("-Infinity"))
    return F.coalesce(special, F.when((x == 0) | ((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16)), F.when(~text.contains("E"), text).otherwise(plain)).otherwise(scientific))


def canonical_json(value: Column, kind: DataType) -> Column:
    """A value of any type made of structs, maps with text keys, arrays, texts, numbers, booleans and nulls as JSON
    with sorted keys, ', ' and ': ' between its parts and ASCII only, as Python's
    json.dumps(sort_keys=True) writes it. The expression is built from the type."""
    if isinstance(kind, StructType):
        parts: list[Column] = []
        for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += ([F.lit(", ")] if i else []) + [_json_text(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)]
        out = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_json_text(k), F.lit(": "), canonical_json(value[k], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, StringType):
        out = let(value, _json_text)
    elif isinstance(kind, (DoubleType, FloatType)):
        out = let(value.cast("double"), _json_double)
    elif isinstance(kind, (BooleanType, ByteType, ShortType, IntegerType, LongType, DecimalType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no JSON form for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def record_fingerprint(record: Column, kind: StructType) -> Column:
    """V5 of a whole nested record."""
    return fingerprint(canonical_json(record, kind))
