"""WARC archives and their Merkle fixity audit.

Pages become WARC records, ordered by page id in files of a fixed id range. A leaf holds the hashes of
one page id's records; sixteen neighbouring leaves with their sizes make a node, sixteen nodes the
next, up to one root per file, and the same above the files up to one root. Two replicas are audited
from the root down: only children of nodes that differ are compared, so an intact branch costs one
comparison, and a lost record does not move its neighbours. Byte offsets are running sizes per file.

A node gathers sixteen children at most, whatever the archive's size; equal records of one id are
counted before they meet.

Defined results: null urls and pages are empty; pages without an id (or a negative one) go to file -1, those without spread by hash;
repeated pages are records of their own in one leaf, and copies are counted: a replica with fewer or more
equal ones differs; records that only one replica holds are missing or extra; an empty table has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.registry import query
from tickloom.session import materialize

FILE_RECORDS = 4096
FAN = 16


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id, file, record``: one WARC resource record (as text) per page."""
    content = F.coalesce(F.col(body), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.greatest(F.floor(F.coalesce(F.col(key), F.lit(-1)) / FILE_RECORDS), F.lit(-1)).cast("long").alias("file"),
        F.concat(head, content, F.lit("\r\n\r\n")).alias("record"))


def hashed(records: DataFrame, replica: int = 0) -> DataFrame:
    """Place, size and hash of every record, without its text."""
    out = records.select(
        F.lit(replica).alias("replica"), "page_id", "file", F.octet_length("record").cast("long").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    place = F.coalesce(F.col("page_id"), F.xxhash64("digest"))
    return out.withColumn("node", F.pmod(place, F.lit(FILE_RECORDS)).cast("long"))


def with_offsets(rows: DataFrame) -> DataFrame:
    """``rows`` with the offset of each record in its file."""
    inside = Window.partitionBy("replica", "file").orderBy("page_id", "digest").rowsBetween(
        Window.unboundedPreceding, 0)
    return rows.withColumn("offset", F.sum("length").over(inside) - F.col("length"))


def joined_hash(child: Column) -> Column:
    """Hash over the children's places, sizes and hashes, in order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(
        ":", *[c[f].cast("string") for f in ("node", "length", "digest")])), ";").cast("binary"), 256)


def parents(level: DataFrame) -> DataFrame:
    return level.groupBy("replica", "file", F.floor(F.col("node") / FAN).alias("above")).agg(
        F.sum("length").alias("total"), joined_hash(F.struct("node", "length", "digest")).alias("hash")).select(
        "replica", "file", F.col("above").alias("node"), F.col("total").alias("length"), F.col("hash").alias("digest"))


def trees(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels inside files and above them, leaves first, of all replicas in ``rows``.

    Every level has ``replica, file, node, length, digest``; above the files, ``file`` is 0 and the
    lowest node numbers are file numbers plus one.
    """
    counted = rows.groupBy("replica", "file", "node", "digest").agg(F.sum("length").alias("length"))
    leaf = counted.groupBy("replica", "file", "node").agg(
        F.sum("length").alias("total"), joined_hash(F.struct(F.lit(0).alias("node"), "length", "digest")).alias("hash")
    ).select("replica", "file", "node", F.col("total").alias("length"), F.col("hash").alias("digest"))
    inner = [materialize(leaf, "leaves")]
    size = FILE_RECORDS
    while size > 1:
        inner.append(materialize(parents(inner[-1]), "nodes"))
        size //= FAN
    outer = [inner[-1].select("replica", F.lit(0).cast("long").alias("file"), (F.col("file") + 1).alias("node"),
                              "length", "digest")]
    while True:
        low, high = outer[-1].agg(F.min("node"), F.max("node")).first()
        if low is None or low == high:
            return inner, outer
        outer.append(materialize(parents(outer[-1]), "nodes"))


def differing(level: DataFrame) -> DataFrame:
    """``file, node`` of the nodes that replicas 0 and 1 do not share."""
    side = lambda r: F.max(F.when(F.col("replica") == r, F.col("digest")))
    return level.groupBy("file", "node").agg(side(0).alias("ours"), side(1).alias("theirs")).filter(
        ~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "node")


def descended(levels: list[DataFrame], bad: DataFrame) -> DataFrame:
    """Differing nodes of the lowest level, reached from differing nodes of the highest."""
    for level in reversed(levels[:-1]):
        under = level.withColumn("above", F.floor(F.col("node") / FAN)).join(
            bad.withColumnRenamed("node", "above"), ["file", "above"], "left_semi")
        bad = materialize(differing(under), "differing")
    return bad


def audit(rows: DataFrame) -> DataFrame:
    """``file, node`` of the leaves that differ between replicas 0 and 1."""
    inner, outer = trees(rows)
    files = descended(outer, differing(outer[-1]))
    roots = inner[-1].join(files.select((F.col("node") - 1).alias("file")), "file", "left_semi")
    return descended(inner, differing(roots))


def replica_differences(rows: DataFrame) -> DataFrame:
    """Records that the replicas hold in different numbers: page_id, file, node, length, digest, ``missing``
    (copies only replica 0 has) and ``extra`` (copies only replica 1 has)."""
    suspect = rows.join(audit(rows), ["file", "node"], "left_semi").groupBy("file", "node", "digest").agg(
        F.min("page_id").alias("page_id"), F.min("length").alias("length"),
        F.count_if(F.col("replica") == 0).alias("ours"), F.count_if(F.col("replica") == 1).alias("theirs"))
    return suspect.filter("ours <> theirs").select(
        "page_id", "file", "node", "length", "digest", "ours", F.greatest(F.col("ours") - F.col("theirs"), F.lit(0)).alias("missing"),
        F.greatest(F.col("theirs") - F.col("ours"), F.lit(0)).alias("extra"))


def damaged_records(rows: DataFrame) -> DataFrame:
    """Records of replica 0 with offsets and whether replica 1 lacks them.

    Of equal records in one leaf, as many as replica 1 lacks are damaged, the last ones in the file.
    """
    short = materialize(replica_differences(rows).filter("missing > 0").select(
        "file", "node", "digest", (F.col("ours") - F.col("missing")).alias("held")), "short")
    ours = with_offsets(rows.filter("replica = 0"))
    same = Window.partitionBy("file", "node", "digest").orderBy("offset")
    lost = ours.join(short, ["file", "node", "digest"]).withColumn("copy", F.row_number().over(same)).filter("copy > held").select(
        "file", "offset", F.lit(True).alias("lost"))
    return ours.join(lost, ["file", "offset"], "left").select(
        "page_id", "file", "offset", "length", "digest", F.coalesce("lost", F.lit(False)).alias("damaged"))


OP10_SQL = r"""
WITH r AS (SELECT page_id, page_id // 4096 AS file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10)
  || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages)
SELECT page_id, file, CAST(sum(octet_length(encode(record))) OVER (PARTITION BY file ORDER BY page_id)
  - octet_length(encode(record)) AS BIGINT) AS "offset", octet_length(encode(record)) AS length,
  sha256(record) AS digest, page_id % 997 = 3 AS damaged FROM r
"""


@query("op10_warc_fixity", OP10_SQL)
def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, and a replica audited in which every 997th record has one character changed."""
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    middle = (F.length("record") / 2).cast("int")
    changed = F.overlay("record", F.when(F.substring("record", middle, F.lit(1)) == "#", "?").otherwise("#"), middle, F.lit(1))
    replica = materialize(records.withColumn(
        "record", F.when(F.col("page_id") % 997 == 3, changed).otherwise(F.col("record"))), "replica")
    rows = materialize(hashed(records, 0).unionByName(hashed(replica, 1)), "hashed")
    return damaged_records(rows)
