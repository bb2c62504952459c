"""Survey-shaped tables derived from the driver's star schema.

The driver ships TPC-H-style parquet; the survey concepts map onto it as
follows (each view exists twice, as a lazy Spark DataFrame and as the
equivalent SQL used by the DuckDB oracles, kept side by side here):

- deployment ``sample`` = order key; ``campaignid`` = order priority;
  ``site`` = customer market segment; ``depth_m`` = order total price;
  ``date_time`` = order date as ISO text with a fixed ``+08:00`` offset.
- counts: one row per line item; taxon = part type / brand / name
  (family / genus / species); ``count`` = quantity; success flag from the
  line status. Several rows of one taxon in one deployment -> MaxN.
- lengths: ``length_mm`` = extended price / 100, ``number`` = line number.
- maturity: one row per part; ``sex`` from part size; ``l50_mm`` =
  retail price / 4.
- benthos: ``level_2`` / ``level_3`` codes from return flag / line status,
  ``scientific`` = part type, ``number`` = quantity.
- relief: score text ``level_5`` = line number - 1, with ``x`` (bad text)
  for line 7; weight ``number`` = quantity - 1 (so weight 0 occurs).
- dot points: one point per line item, class ``broad`` from part type,
  with ``Unknown``, blank and missing classes mixed in.

Only the columns a view needs are read, so scans prune columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Values the derived views depend on (fixed choices of this mapping).
FOCAL_GENUS, FOCAL_SPECIES = "Brand#25", "blue rod"
FOCAL_LABEL = "Brand#25 blue rod"
# relabel rules in driver terms: species -> "spp"; unknown genus of a family
RELABEL_SPECIES_FROM, RELABEL_SPECIES_TO = "red widget", "spp"
RELABEL_GENUS_FROM, RELABEL_GENUS_FAMILY, RELABEL_GENUS_TO = "Brand#1", "ECONOMY", "Brand#0"
LEGAL_MM = 280.0


def _iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+08:00'")


def roster(spark: SparkSession, d: str, successful: bool = False) -> DataFrame:
    """``successful=True`` keeps the deployments whose counts succeeded by the
    raw status, which the scan can filter (a test on the derived Yes / No
    text cannot be pushed down)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority")
    if successful:
        o = o.where(F.col("o_orderstatus").isin("F", "O"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    yes = lambda cond: F.when(cond, "Yes").otherwise("No")
    return j.select(
        F.col("o_orderkey").alias("sample"),
        F.col("o_orderpriority").alias("campaignid"),
        F.col("c_acctbal").alias("longitude_dd"),
        (F.col("o_totalprice") / 1000.0).alias("latitude_dd"),
        _iso(F.col("o_orderdate")).alias("date_time"),
        F.col("c_mktsegment").alias("site"),
        F.col("o_totalprice").alias("depth_m"),
        yes(F.col("o_orderstatus").isin("F", "O")).alias("successful_count"),
        yes(F.col("o_orderstatus") == "F").alias("successful_length"),
        yes(F.col("o_orderstatus") != "O").alias("successful_habitat_forward"),
    )


ROSTER_SQL = """
SELECT o.o_orderkey AS sample, o.o_orderpriority AS campaignid,
       c.c_acctbal AS longitude_dd, o.o_totalprice / 1000.0 AS latitude_dd,
       strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S+08:00') AS date_time,
       c.c_mktsegment AS site, o.o_totalprice AS depth_m,
       CASE WHEN o.o_orderstatus IN ('F','O') THEN 'Yes' ELSE 'No' END AS successful_count,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS successful_length,
       CASE WHEN o.o_orderstatus <> 'O' THEN 'Yes' ELSE 'No' END AS successful_habitat_forward
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
"""


def _items_parts(spark, d, cols, where=None):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", *cols)
    li = li if where is None else li.where(where)
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return li.join(p, li.l_partkey == p.p_partkey, "left")


def counts(spark: SparkSession, d: str, with_missing: bool = False, successful: bool = False) -> DataFrame:
    """``successful=True``: only rows of successful counts, filtered by the
    raw status in the scan."""
    j = _items_parts(spark, d, ["l_quantity", "l_linestatus", "l_linenumber"],
                     F.col("l_linestatus") == "O" if successful else None)
    cnt = F.col("l_quantity").cast("long")
    if with_missing:
        cnt = F.when(F.col("l_linenumber") != 7, cnt)
    return j.select(
        F.col("l_orderkey").alias("sample"), F.col("p_type").alias("family"),
        F.col("p_brand").alias("genus"), F.col("p_name").alias("species"),
        cnt.alias("count"),
        F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("successful_count"))


def counts_sql(with_missing: bool = False) -> str:
    cnt = ("CASE WHEN l.l_linenumber <> 7 THEN CAST(l.l_quantity AS BIGINT) END" if with_missing
           else "CAST(l.l_quantity AS BIGINT)")
    return f"""
SELECT l.l_orderkey AS sample, p.p_type AS family, p.p_brand AS genus, p.p_name AS species,
       {cnt} AS count,
       CASE WHEN l.l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS successful_count
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""


def lengths(spark: SparkSession, d: str) -> DataFrame:
    j = _items_parts(spark, d, ["l_extendedprice", "l_linenumber", "l_returnflag"])
    return j.select(
        F.col("l_orderkey").alias("sample"), F.col("p_type").alias("family"),
        F.col("p_brand").alias("genus"), F.col("p_name").alias("species"),
        (F.col("l_extendedprice") / 100.0).alias("length_mm"),
        F.col("l_linenumber").cast("long").alias("number"),
        F.when(F.col("l_returnflag") != "R", "Yes").otherwise("No").alias("successful_length"))


LENGTHS_SQL = """
SELECT l.l_orderkey AS sample, p.p_type AS family, p.p_brand AS genus, p.p_name AS species,
       l.l_extendedprice / 100.0 AS length_mm, CAST(l.l_linenumber AS BIGINT) AS number,
       CASE WHEN l.l_returnflag <> 'R' THEN 'Yes' ELSE 'No' END AS successful_length
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""


def maturity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_name", "p_size", "p_retailprice")
    return p.select(
        F.col("p_type").alias("family"), F.col("p_brand").alias("genus"), F.col("p_name").alias("species"),
        F.when(F.col("p_size") > 25, "F").otherwise("M").alias("sex"),
        F.when(F.col("p_size") != 13, F.col("p_retailprice") / 4.0).alias("l50_mm"),
        F.col("p_partkey").alias("row_id"))


MATURITY_SQL = """
SELECT p_type AS family, p_brand AS genus, p_name AS species,
       CASE WHEN p_size > 25 THEN 'F' ELSE 'M' END AS sex,
       CASE WHEN p_size <> 13 THEN p_retailprice / 4.0 END AS l50_mm,
       p_partkey AS row_id
FROM part
"""


def benthos(spark: SparkSession, d: str) -> DataFrame:
    j = _items_parts(spark, d, ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"])
    return j.select(
        F.col("l_orderkey").alias("sample"),
        F.col("l_returnflag").alias("level_2"), F.col("l_linestatus").alias("level_3"),
        F.col("p_type").alias("scientific"),
        F.when(F.col("l_linenumber") != 6, F.col("l_quantity").cast("long")).alias("number"))


BENTHOS_SQL = """
SELECT l.l_orderkey AS sample, l.l_returnflag AS level_2, l.l_linestatus AS level_3,
       p.p_type AS scientific,
       CASE WHEN l.l_linenumber <> 6 THEN CAST(l.l_quantity AS BIGINT) END AS number
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""

# classification rules (case_when without default): (conditions, label)
HABITAT_RULES = [
    ({"level_2": "A", "level_3": "F"}, "sand"),
    ({"level_2": "N"}, "turf"),
    ({"level_2": "R", "scientific": "PROMO"}, "posidonia"),
]
HABITAT_CASE_SQL = """CASE WHEN level_2 = 'A' AND level_3 = 'F' THEN 'sand'
     WHEN level_2 = 'N' THEN 'turf'
     WHEN level_2 = 'R' AND scientific = 'PROMO' THEN 'posidonia' END"""
HABITAT_CLASSES = ["posidonia", "sand", "turf"]


def relief(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("sample"),
        F.when(F.col("l_linenumber") == 7, F.lit("x"))
         .otherwise((F.col("l_linenumber") - 1).cast("string")).alias("level_5"),
        (F.col("l_quantity").cast("long") - 1).alias("number"))


RELIEF_SQL = """
SELECT l_orderkey AS sample,
       CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS level_5,
       CAST(l_quantity AS BIGINT) - 1 AS number
FROM lineitem
"""


def dot_points(spark: SparkSession, d: str) -> DataFrame:
    j = _items_parts(spark, d, ["l_linenumber"])
    broad = (F.when(F.col("p_type") == "SMALL", "Unknown").when(F.col("p_type") == "LARGE", "")
             .when(F.col("p_type") == "MEDIUM", F.lit(None)).otherwise(F.initcap("p_type")))
    score = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise((F.col("l_linenumber") - 1).cast("string"))
    return j.select(F.lit("2024-campaign").alias("campaignid"), F.col("l_orderkey").alias("opcode"),
                    broad.alias("broad"), score.alias("level_5"))


DOT_POINTS_SQL = """
SELECT '2024-campaign' AS campaignid, l.l_orderkey AS opcode,
       CASE WHEN p.p_type = 'SMALL' THEN 'Unknown' WHEN p.p_type = 'LARGE' THEN ''
            WHEN p.p_type = 'MEDIUM' THEN NULL
            ELSE upper(substr(p.p_type, 1, 1)) || lower(substr(p.p_type, 2)) END AS broad,
       CASE WHEN l.l_linenumber = 7 THEN '' ELSE CAST(l.l_linenumber - 1 AS VARCHAR) END AS level_5
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""
