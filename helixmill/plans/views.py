"""Alignment views over the driver's tables, in SQL that Spark and DuckDB both read.

Reads come from lineitem: an order's rows are ranked by all their columns; the first two are mates
(three orders in four have the second next to the first, on the other strand), later rows are
single records. Genes come from part. Every read has 50 bases.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 5_000_000

READS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS mr,
    count(*) OVER (PARTITION BY l_orderkey) AS n_rows
  FROM lineitem),
raw AS (
  SELECT l_orderkey AS ok, CAST(mr AS INTEGER) AS mr, l_orderkey * 16 + mr AS rec_ord, n_rows >= 2 AND mr <= 2 AS paired,
    l_linenumber AS ln, l_returnflag AS rf, l_linestatus AS ls, l_suppkey AS sk, l_quantity AS qty,
    CAST(l_partkey % 5 AS INTEGER) AS tid0, (l_partkey * 23 + l_linenumber * 13 + (l_suppkey % 3) * 40) % 4900000 AS pos0,
    (l_partkey + l_linenumber) % 41 = 0 AS un, l_partkey
  FROM ranked),
ends AS (
  SELECT ok, max(CASE WHEN mr = 1 THEN tid0 END) AS t1, max(CASE WHEN mr = 1 THEN pos0 END) AS p1, max(CASE WHEN mr = 2 THEN tid0 END) AS t2, max(CASE WHEN mr = 2 THEN pos0 END) AS p2,
    max(CASE WHEN mr = 2 THEN 40 + (l_partkey % 9) * 45 END) AS gap, max(CASE WHEN mr = 1 AND un THEN 1 ELSE 0 END) AS u1, max(CASE WHEN mr = 2 AND un THEN 1 ELSE 0 END) AS u2,
    max(CASE WHEN mr = 1 AND ls = 'F' THEN 1 ELSE 0 END) AS r1
  FROM raw GROUP BY ok),
placed AS (
  SELECT raw.*, ok2.near, CASE WHEN mr = 2 AND ok2.near THEN t1 ELSE tid0 END AS tid, CASE WHEN mr = 2 AND ok2.near THEN p1 + gap ELSE pos0 END AS pos,
    CASE WHEN mr = 1 THEN (CASE WHEN ok2.near THEN t1 ELSE t2 END) ELSE t1 END AS mt, CASE WHEN mr = 1 THEN (CASE WHEN ok2.near THEN p1 + gap ELSE p2 END) ELSE p1 END AS mp,
    CASE WHEN mr = 1 THEN u2 ELSE u1 END AS mu, CASE WHEN ok2.near THEN (CASE WHEN mr = 2 THEN 1 - r1 ELSE r1 END) ELSE (CASE WHEN ls = 'F' THEN 1 ELSE 0 END) END AS rev,
    CASE WHEN ok2.near THEN (CASE WHEN mr = 2 THEN r1 ELSE 1 - r1 END) ELSE 0 END AS mrev, p1, gap
  FROM raw JOIN (SELECT ends.*, ok % 4 <> 0 AND p2 IS NOT NULL AS near FROM ends) ok2 USING (ok)),
reads AS (
  SELECT rec_ord, CAST(ok AS VARCHAR(20)) AS qname,
    CAST((CASE WHEN paired THEN 1 ELSE 0 END) + (CASE WHEN paired AND near AND NOT un AND mu = 0 AND rf <> 'N' THEN 2 ELSE 0 END) + (CASE WHEN un THEN 4 ELSE 0 END)
      + (CASE WHEN paired AND mu = 1 THEN 8 ELSE 0 END) + (CASE WHEN rev = 1 THEN 16 ELSE 0 END) + (CASE WHEN paired AND mrev = 1 THEN 32 ELSE 0 END)
      + (CASE WHEN paired AND mr = 1 THEN 64 ELSE 0 END) + (CASE WHEN paired AND mr = 2 THEN 128 ELSE 0 END) + (CASE WHEN mr > 2 AND rf = 'R' THEN 256 ELSE 0 END)
      + (CASE WHEN qty >= 50 THEN 512 ELSE 0 END) + (CASE WHEN rf = 'A' AND ln % 2 = 1 THEN 1024 ELSE 0 END) + (CASE WHEN mr > 2 AND rf = 'N' AND ln = 7 THEN 2048 ELSE 0 END) AS INTEGER) AS flag,
    tid, pos, CAST(qty AS INTEGER) AS mapq, CAST(CASE WHEN sk % 10 = 0 THEN 3 ELSE 1 END AS INTEGER) AS nh, CAST(ln % 4 AS INTEGER) AS nm, ln,
    CASE ln WHEN 1 THEN '50M' WHEN 2 THEN '20M100N30M' WHEN 3 THEN '5S45M' WHEN 4 THEN '25M2I23M' WHEN 5 THEN '25M3D25M' WHEN 6 THEN '10M200N10M50N30M' ELSE '45M5S' END AS cigar,
    CASE WHEN paired THEN mt END AS mtid, CASE WHEN paired THEN mp END AS mpos,
    CAST(CASE WHEN paired AND near AND NOT un AND mu = 0 THEN (CASE WHEN mr = 1 THEN gap + 50 ELSE -(gap + 50) END) ELSE 0 END AS BIGINT) AS tlen,
    substr(translate(md5(CAST(rec_ord AS VARCHAR(20)) || 'a') || md5(CAST(rec_ord AS VARCHAR(20)) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 50) AS seq
  FROM placed)
"""

GENES = f"""
parts AS (SELECT p_partkey AS gene_ord, 'G' || CAST(p_partkey AS VARCHAR(20)) AS gene_id, p_name AS symbol, p_brand AS biotype, CAST(p_partkey % 5 AS INTEGER) AS tid, (p_partkey * 23) % 4900000 AS s0,
  CAST(p_size AS BIGINT) AS width, CAST(p_size % 3 AS BIGINT) AS extra, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part),
ks AS (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1 UNION ALL SELECT 2),
exons AS (SELECT gene_id, gene_ord, tid, strand, symbol, biotype, s0 + 60 * k AS s, s0 + 60 * k + 20 + width AS e FROM parts JOIN ks ON k <= extra),
genes AS (SELECT gene_id, gene_ord, tid, strand, symbol, biotype, min(s) AS s, max(e) AS e FROM exons GROUP BY gene_id, gene_ord, tid, strand, symbol, biotype),
eff AS (SELECT gene_id, sum(e - greatest(s, coalesce(pe, s))) AS eff_len FROM (SELECT gene_id, s, e, max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM exons)
  WHERE pe IS NULL OR e > pe GROUP BY gene_id),
contigs AS (SELECT CAST(r_regionkey AS INTEGER) AS tid, 'chr' || CAST(r_regionkey + 1 AS VARCHAR(20)) AS name, CAST({LENGTH} AS BIGINT) AS length FROM region)
"""

#: The oracle's own table of what each CIGAR shape covers: aligned blocks as (offset, end, place in the read).
SHAPES = {1: [(0, 50, 0)], 2: [(0, 20, 0), (120, 150, 20)], 3: [(0, 45, 5)], 4: [(0, 25, 0), (25, 48, 27)], 5: [(0, 25, 0), (28, 53, 25)], 6: [(0, 10, 0), (210, 220, 10), (270, 300, 20)], 7: [(0, 45, 0)]}
BLOCKS = "shape(ln, bs, be, q) AS (VALUES " + ", ".join(f"({n}, {a}, {b}, {q})" for n, rows in SHAPES.items() for a, b, q in rows) + "), blocks AS (SELECT reads.*, pos + bs AS s, pos + be AS e, q FROM reads JOIN shape USING (ln))"


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **frames)


#: Views of this session by application, folder and name.
_saved: dict[tuple[str, str, str], DataFrame] = {}


def new_path(spark: SparkSession) -> str | None:
    """A new place in the folder that all executors share, or none where there is no such folder; it goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = "file://" + tempfile.mkdtemp(prefix="helixmill-views-")
    if not folder:
        return None
    path = f"{folder.rstrip('/')}/helixmill-view-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def as_text(lines: DataFrame, order: str, packed: bool = False) -> str:
    """lines (value and an order) as one text file; its folder."""
    path = new_path(lines.sparkSession)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    lines.orderBy(order).select("value").coalesce(1).write.option("compression", "gzip" if packed else "none").text(path)
    return path


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The view as a Parquet table, written once a session: it stands for an alignment or annotation file, which is not made anew for each report. Without a folder that all executors share it stays a view."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _saved:
        path = new_path(spark)
        if not path:
            return make()
        view = make()
        view.write.parquet(path)
        _saved[key] = spark.read.schema(view.schema).parquet(path)
    return _saved[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment table: one row for each record, with made-up base qualities."""
    sql = "WITH " + READS.replace("CAST(ok AS VARCHAR(20))", "CAST(ok AS STRING)").replace("AS VARCHAR(20)", "AS STRING") + " SELECT * FROM reads"
    quality = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (2 + (F.col("rec_ord") * 3 + i * 11) % 40).cast("int"))
    return _kept(spark, sf_dir, "reads", lambda: _run(spark, sf_dir, sql, "lineitem").withColumn("quality", quality))


def _annotation(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return _kept(spark, sf_dir, view, lambda: _run(spark, sf_dir, "WITH " + GENES.replace("AS VARCHAR(20)", "AS STRING") + f" SELECT * FROM {view}", "part", "region"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir, "exons")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir, "genes")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir, "contigs")


def oracle(body: str, *ctes: str, blocks: bool = False) -> str:
    """The views, more CTEs, and a query, for DuckDB; a body that begins with a comma adds CTEs of its own."""
    return "WITH " + ",".join([READS, GENES, *([BLOCKS] if blocks else []), *ctes]) + body
