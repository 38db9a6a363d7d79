"""JSON-array files: a scan that splits an array among tasks, optional inputs, and a sink that writes one in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered

ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "category", "name", "subtitle", "source_type", "source_url", "raw_text", "image_url", "game_version_seen")]
    + [T.StructField("qa_flags", T.ArrayType(T.StringType())), T.StructField("reviewed", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("short_text", "prompt_version", "raw_text_hash", "date_added", "date_updated")]
)

# The layout of an exchange file. Elements stand two spaces in, so a line that closes one closes nothing else.
INDENT, ELEMENT_END = "  ", "\n  }"


def located(spark: SparkSession, path: str):
    """A path and its Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = located(spark, path)
    return system.exists(p)


# --- JSON text -----------------------------------------------------------------------------------------------------------


def _quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    rest = c
    for code in range(32):
        rest = F.replace(rest, F.lit(chr(code)), F.lit(short.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), rest).otherwise(c), F.lit('"'))


def json_text(c: Column, kind: T.DataType, level: int = 0) -> Column:
    """``c`` as indented JSON, nulls as ``null``, a struct's fields and a map's entries in their order. Floating-point numbers are
    written as Spark casts them to strings."""
    deeper, here = F.lit("\n" + INDENT * (level + 1)), F.lit("\n" + INDENT * level)

    def block(items: Column, marks: str) -> Column:
        text = F.concat(F.lit(marks[0]), deeper, F.array_join(items, ",\n" + INDENT * (level + 1)), here, F.lit(marks[1]))
        return F.when(F.size(items) > 0, text).otherwise(marks)

    if isinstance(kind, T.StructType):
        items = F.array(*[F.concat(F.lit(f'"{f.name}": '), json_text(c[f.name], f.dataType, level + 1)) for f in kind.fields]) if kind.fields else F.array().cast("array<string>")
        text = block(items, "{}")
    elif isinstance(kind, T.ArrayType):
        text = block(F.transform(c, lambda x: json_text(x, kind.elementType, level + 1)), "[]")
    elif isinstance(kind, T.MapType):
        text = block(F.transform(F.map_entries(c), lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(": "), json_text(e["value"], kind.valueType, level + 1))), "{}")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = _quoted(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


# --- sink ----------------------------------------------------------------------------------------------------------------


def _lines(df: DataFrame, order: str, end: str) -> DataFrame:
    """The array's elements in ``order`` as text rows, ``end`` behind the last one, and no row at all of an empty table."""
    row = F.struct(*[c for c in df.columns if c != order])
    kind = T.StructType([f for f in df.schema.fields if f.name != order])
    texts = df.select(F.col(order).alias("_o"), row.alias("_r")).select("_o", F.concat(F.lit(INDENT), json_text(F.col("_r"), kind, 1)).alias("_t"))
    rows = numbered(texts, [F.col("_o"), F.col("_t")], "_n")
    last = rows.agg(F.max("_n")).first()[0]
    return rows.select(F.concat(F.when(F.col("_n") == 0, "[\n").otherwise(""), "_t", F.when(F.col("_n") == last, end).otherwise(",")).alias("value"))


def write_array(df: DataFrame, path: str, order: str = "pos") -> None:
    """One JSON array in ``order``, replacing what is there: a folder of part files, written by as many tasks and committed together.
    The parts one after another, in the order of their names, are the array (and a line end)."""
    rows = _lines(df, order, "\n]")
    if rows.isEmpty():
        rows = df.sparkSession.createDataFrame([("[]",)], "value string")
    rows.write.mode("overwrite").text(path)


def write_array_file(df: DataFrame, path: str, order: str = "pos") -> None:
    """The same array as one file, byte by byte as an indented dump of a list. The parts are written in parallel beside ``path`` and
    then streamed together, which takes no memory but the time that copying one file takes; the file appears when it is whole."""
    spark = df.sparkSession
    target, system = located(spark, path)
    parts, _ = located(spark, f"{path}.parts-{uuid.uuid4().hex}")
    whole, _ = located(spark, f"{path}.whole-{uuid.uuid4().hex}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    try:
        _lines(df, order, "").write.text(parts.toString())
        out = system.create(whole)
        try:
            for name in sorted(s.getPath().getName() for s in system.listStatus(parts) if s.getPath().getName().startswith("part-")):
                source = system.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
            for mark in "]" if out.getPos() else "[]":
                out.write(ord(mark))
        finally:
            out.close()
        system.delete(target, True)
        system.rename(whole, target)
    finally:
        system.delete(parts, True)
        system.delete(whole, True)


# --- scan ----------------------------------------------------------------------------------------------------------------


def _separator(spark: SparkSession, path: str) -> str | None:
    """What stands between two elements, by the first two lines (of the first part): the end of an indented element, or a line end
    where every element is a line. None: another layout, which is one record."""
    place, system = located(spark, path)
    if system.getFileStatus(place).isDirectory():
        parts = [s.getPath().toString() for s in system.listStatus(place) if s.getLen() and s.getPath().getName().startswith("part-")]
        path = min(parts, default=path)
    head = [r["value"] for r in spark.read.text(path).filter("value <> ''").limit(2).collect()]
    if len(head) < 2 or head[0] != "[":
        return None
    second = head[1].rstrip()
    return ELEMENT_END if second == INDENT + "{" else "\n" if second.startswith("{") and second.rstrip(",").endswith("}") else None


def read_array(spark: SparkSession, path: str, schema: T.StructType = ENTRY) -> DataFrame:
    """Rows of a JSON array, a file or a folder of parts, with ``pos`` (from 0, in order); a missing file is an empty table.

    An array with one element a line, or indented by two spaces, is split among tasks wherever elements meet, whatever its size;
    an element that is no JSON is an error. An array in any other layout is read as one record.
    """
    fields = T.StructType([T.StructField("pos", T.LongType()), *schema.fields])
    if not exists(spark, path):
        return spark.createDataFrame([], fields)
    separator = _separator(spark, path)
    if separator is None:
        rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(schema)).alias("rows"))
        return rows.select(F.posexplode("rows").alias("pos", "row")).select(F.col("pos").cast("long").alias("pos"), "row.*")
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    lines = spark.read.option("lineSep", separator).text(path).select("value", *split, F.monotonically_increasing_id().alias("_at"))
    bare = F.regexp_replace(F.regexp_replace("value", r"\A[\s,]*+(?:\[\s*+)?", ""), r"[\s,]++\z", "")
    text = F.col("_t")
    # what follows the last element that ends on a line of its own is closed by the array's own bracket, which stands at a line's start
    tail = F.col("value").rlike(r"\n\]\s*+\z")
    body = text if separator == "\n" else F.when(tail, F.regexp_replace(text, r"\]\z", "")).otherwise(F.concat(text, F.lit("}")))
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(schema))
    told = F.raise_error(F.concat(F.lit("no element of a JSON array: "), F.left("_t", F.lit(200))))
    # no filter: one would be merged with what the optimizer infers from the explosion, and the error raised on the last mark
    rows = F.when(text.isin("", "]"), F.array().cast(T.ArrayType(schema))).otherwise(F.coalesce(parsed, told))
    held = lines.withColumn("_t", bare).select("_file", "_from", "_at", rows.alias("_rows"))
    # a record's place is counted from its split's first; the splits, one per block of the file, are laid end to end
    spans = held.filter(F.size("_rows") > 0).groupBy("_file", "_from").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.max(F.size("_rows")).alias("_w")).collect()
    wide = max((s["_w"] for s in spans), default=1)
    starts, upto = [], 0
    for s in sorted(spans, key=lambda s: (s["_file"], s["_from"])):
        starts.append((s["_file"], s["_from"], s["_lo"], upto))
        upto += s["_hi"] - s["_lo"] + 1
    begin = F.broadcast(spark.createDataFrame(starts, "_file string, _from long, _lo long, _begin long"))
    rows = held.join(begin, ["_file", "_from"]).select((F.col("_begin") + F.col("_at") - F.col("_lo")).alias("_n"), F.posexplode("_rows").alias("_k", "row"))
    return rows.select((F.col("_n") * wide + F.col("_k")).cast("long").alias("pos"), "row.*")


def union_sources(spark: SparkSession, paths: dict[str, str], schema: T.StructType = ENTRY) -> DataFrame:
    """All category files in registry order as one batch; ``pos`` keeps that order. The label decides nothing but the order; an empty
    registry is an empty batch."""
    out = spark.createDataFrame([], T.StructType([T.StructField("pos", T.LongType()), *schema.fields]))
    for rank, path in enumerate(paths.values()):
        rows = read_array(spark, path, schema).withColumn("pos", F.col("pos") + rank * (1 << 40))
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
