"""Binary token shards: 5 bytes magic, version, count (32 bits, little endian), then the ids likewise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.packing import bound

#: Magic and version of the format, and the size of its header.
MAGIC, VERSION, HEADER = "S6BIN", 1, 13


def _swapped(x: Column) -> Column:
    """A 32-bit number with its bytes in the opposite order."""
    byte = lambda k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    return F.shiftleft(byte(0), 24) + F.shiftleft(byte(1), 16) + F.shiftleft(byte(2), 8) + byte(3)


def _little_endian(x: Column) -> Column:
    """Hex digits of a 32-bit number, lowest byte first."""
    return F.lpad(F.hex(_swapped(x.cast("long"))), 8, "0")


def encoded(ids: str) -> Column:
    """Bytes of a shard; null for null, empty or out-of-range ids."""
    head = F.concat(F.hex(F.lit(MAGIC).cast("binary")), _little_endian(F.lit(VERSION)), _little_endian(F.size(ids)))
    good = (F.size(ids) > 0) & F.forall(ids, lambda t: t.isNotNull() & (t >= 0) & (t.cast("long") < 4294967296))
    return F.when(good, F.unhex(F.concat(head, F.array_join(F.transform(ids, _little_endian), ""))))


def _number(data: Column, byte: Column | int) -> Column:
    """The little-endian number that begins at ``byte`` (from 0); bytes are cut from binary data, which takes no search."""
    at = F.lit(byte + 1) if isinstance(byte, int) else byte + 1
    return _swapped(F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("long"))


def _is_valid(d: Column) -> Column:
    head = F.substring(d, 1, len(MAGIC)) == F.lit(MAGIC).cast("binary")
    # Numbers are read only where there are enough bytes.
    return F.coalesce(F.when(F.length(d) > HEADER, head & (_number(d, 5) == VERSION) & (F.length(d) == _number(d, 9) * 4 + HEADER)), F.lit(False))


def is_valid(data: str) -> Column:
    """Magic, version, at least one id, and exactly as many bytes as the count asks for."""
    return bound(F.col(data), _is_valid)


def decoded(data: str) -> Column:
    """Ids of a shard; null if it is not valid."""

    def ids(d: Column) -> Column:
        places = F.sequence(F.lit(0), ((F.length(d) - HEADER) / 4).cast("int") - 1)
        return F.when(_is_valid(d), F.transform(places, lambda i: _number(d, i * 4 + HEADER)))

    return bound(F.col(data), ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, shard_hash, ids) of the binary shards under ``path``; invalid ones have null ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("shard_hash"), decoded("content").alias("ids"))


def encoded_records(records: DataFrame, by: str = "shard_id", key: str = "document_id", ids: str = "token_ids") -> DataFrame:
    """(by, data): the text shard of each group, a line of compact JSON a record with keys in order, records in order of ``key``
    (equal ones by their line). A group whose records all lack ids has no shard; shards are bounded by their builder."""
    line = F.concat(F.lit('{"document_id":'), F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(',"token_ids":['), F.array_join(ids, ","), F.lit("]}"))
    rows = records.where(F.size(ids) > 0).select(by, F.struct(F.col(key).alias("k"), line.alias("line")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"])
    return rows.groupBy(by).agg(F.encode(F.concat(F.array_join(lines, "\n"), F.lit("\n")), "utf-8").alias("data"))


def decoded_records(data: str) -> Column:
    """(document_id, token_ids) of the lines of a text shard; null if a line is no such object or there is none."""
    schema = "document_id string, token_ids array<bigint>"
    lines = F.filter(F.split(F.decode(F.col(data), "utf-8"), "\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x: F.from_json(x, schema))
    return bound(rows, lambda rs: F.when((F.size(rs) > 0) & F.forall(rs, lambda r: r["document_id"].isNotNull() & r["token_ids"].isNotNull()), rs))
