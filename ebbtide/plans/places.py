"""Plans over postal, district and document inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import rounded
from ebbtide.functions.text import ACCENTED, UNACCENTED, after_slash, plain_name, postal_code
from ebbtide.operators import places
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.sources.feeds import Feeds
from ebbtide.sources.html import list_items

GAZETTEER = """SELECT CAST(1000 + (p_partkey % 500) * 18 AS VARCHAR) AS postal_code,
  CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS place_name, p_brand AS admin_name, p_type AS admin_code,
  41 + (p_retailprice - 900) / 50 AS latitude, 22 + p_size / 10e0 AS longitude,
  CAST(p_partkey % 7 AS DOUBLE) AS accuracy FROM part"""

ROLLUP = """SELECT postal_code, COUNT(*) AS place_count, AVG(latitude) AS latitude, AVG(longitude) AS longitude,
  MEDIAN(accuracy) AS accuracy,
  COALESCE((SELECT place_name FROM gz x WHERE x.postal_code = gz.postal_code AND place_name IS NOT NULL
    GROUP BY place_name ORDER BY COUNT(*) DESC, place_name LIMIT 1), 'Unknown') AS place_name,
  (SELECT admin_name FROM gz x WHERE x.postal_code = gz.postal_code
    GROUP BY admin_name ORDER BY COUNT(*) DESC, admin_name LIMIT 1) AS admin_name,
  (SELECT admin_code FROM gz x WHERE x.postal_code = gz.postal_code
    GROUP BY admin_code ORDER BY COUNT(*) DESC, admin_code LIMIT 1) AS admin_code
FROM gz GROUP BY postal_code"""


def gazetteer(feeds: Feeds) -> DataFrame:
    k = F.col("p_partkey")
    return feeds.table("part").select(
        (1000 + (k % 500) * 18).cast("string").alias("postal_code"),
        F.when(k % 9 != 0, F.col("p_name")).alias("place_name"),
        F.col("p_brand").alias("admin_name"), F.col("p_type").alias("admin_code"),
        (41 + (F.col("p_retailprice") - 900) / 50).alias("latitude"), (22 + F.col("p_size") / 10.0).alias("longitude"),
        (k % 7).cast("double").alias("accuracy"))


def rollup(feeds: Feeds) -> DataFrame:
    return places.postal_rollup(gazetteer(feeds), "postal_code", ["place_name", "admin_name", "admin_code"],
                                ["latitude", "longitude"], ["accuracy"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(1000 + o_custkey % 9000 AS VARCHAR) END AS postal_code,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN o_orderpriority ELSE 'x/' || o_orderstatus END AS english
FROM orders""")
def postal_norm(feeds: Feeds) -> DataFrame:
    """Postal codes from messy texts, and the part of a name behind its first slash."""
    k, code = F.col("o_orderkey"), (1000 + F.col("o_custkey") % 9000).cast("string")
    text = (F.when(k % 6 == 0, F.concat(F.lit("  "), code)).when(k % 6 == 1, F.concat(code, F.lit(".0")))
            .when(k % 6 == 2, F.concat(F.lit("BG-"), code, F.lit("7"))).when(k % 6 == 5, "12").otherwise(code))
    name = (F.when(k % 4 == 0, F.concat(F.lit("Местност/x/"), F.col("o_orderstatus")))
            .when(k % 4 == 1, F.concat(F.lit("a / x/"), F.col("o_orderstatus"), F.lit(" ")))
            .when(k % 4 == 2, F.col("o_orderpriority")).otherwise("name/  "))
    return feeds.table("orders").select("o_orderkey", postal_code(text).alias("postal_code"), after_slash(name).alias("english"))


def _plain_sql(text: str) -> str:
    plain = UNACCENTED.replace("'", "''")
    return (f"TRIM(REGEXP_REPLACE(LOWER(REGEXP_REPLACE(TRANSLATE({text}, '{ACCENTED}', '{plain}'), "
            "'[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))")


@query(f"""SELECT doc_id, MD5(n) AS name_hash, LENGTH(n) AS name_length FROM (SELECT doc_id, {_plain_sql('text')} AS n FROM documents)
UNION ALL SELECT -1 - c_custkey, MD5(CASE a WHEN 'nation 3' THEN 'third nation' WHEN 'nation 21' THEN 'nation xxi' ELSE a END),
  LENGTH(CASE a WHEN 'nation 3' THEN 'third nation' WHEN 'nation 21' THEN 'nation xxi' ELSE a END)
FROM (SELECT c_custkey, {_plain_sql("' (' || n_name || ') '")} AS a FROM customer JOIN nation ON n_nationkey = c_nationkey)
UNION ALL SELECT -1000000000 - c_custkey, MD5(b), LENGTH(b)
FROM (SELECT c_custkey, 'ij ' || LOWER(c_mktsegment) || ' fi ab 12' AS b FROM customer)""")
def name_norm(feeds: Feeds) -> DataFrame:
    """Whole texts folded to plain ASCII words, and names with other spellings replaced."""
    texts = feeds.table("documents").select("doc_id", plain_name("text").alias("n"))
    nations = feeds.table("customer").join(feeds.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = nations.select((-1 - F.col("c_custkey")).alias("doc_id"), places.place_name(
        F.concat(F.lit(" ("), F.col("n_name"), F.lit(") ")), {"nation 3": "third nation", "nation 21": "nation xxi"}).alias("n"))
    # a ligature, a no-break space, another ligature, full-width letters and a fraction slash, which goes
    odd = feeds.table("customer").select((-1_000_000_000 - F.col("c_custkey")).alias("doc_id"), plain_name(F.concat(
        F.lit("\u0132\u00a0"), F.col("c_mktsegment"), F.lit("-\ufb01 \uff21\uff42 1\u20442"))).alias("n"))
    return texts.unionByName(names).unionByName(odd).select("doc_id", F.md5("n").alias("name_hash"), F.length("n").cast("bigint").alias("name_length"))


@query(statement("", """SELECT postal_code, place_count, ROUND(latitude, 6) AS latitude, ROUND(longitude, 6) AS longitude,
  accuracy, place_name, admin_name, admin_code FROM r""", gz=GAZETTEER, r=ROLLUP))
def mode_mean_median(feeds: Feeds) -> DataFrame:
    """Postal roll-up: count, modes with ties to the smallest, means, exact median."""
    return rounded(rollup(feeds))


def _km_sql(lat: float, lon: float) -> str:
    return (f"6371 * 2 * ASIN(SQRT(POW(SIN((RADIANS({lat}) - RADIANS(latitude)) / 2), 2) + COS(RADIANS(latitude)) * "
            f"COS(RADIANS({lat})) * POW(SIN((RADIANS({lon}) - RADIANS(longitude)) / 2), 2)))")


_KM = {f"km_{n}": _km_sql(*at) for n, at in places.CITIES.items()}


@query(statement("", "SELECT row_key, " + ", ".join(f"ROUND({e}, 4) AS {n}" for n, e in _KM.items())
                 + f", ROUND(LEAST({', '.join(_KM.values())}), 4) AS min_city_km FROM gz",
                 gz=GAZETTEER.replace("SELECT ", "SELECT p_partkey AS row_key, ", 1)))
def geo_distance(feeds: Feeds) -> DataFrame:
    """Great-circle kilometres to four cities and the nearest of them."""
    at = feeds.table("part").select(
        F.col("p_partkey").alias("row_key"), (41 + (F.col("p_retailprice") - 900) / 50).alias("latitude"),
        (22 + F.col("p_size") / 10.0).alias("longitude"))
    return rounded(at.select("row_key", *[e.alias(n) for n, e in places.city_distances("latitude", "longitude").items()]), places=4)


@query(statement("crm_accounts", """SELECT "PID", "EffectiveSegment", CAST("Billing_ZIP" AS VARCHAR) AS postal_code,
  CASE WHEN r.postal_code IS NULL THEN 0 ELSE 1 END AS zip_found, place_count, COALESCE(place_name, 'Unknown') AS place_name,
  COALESCE(admin_name, 'Unknown') AS admin_name, ROUND(latitude, 6) AS latitude, ROUND(accuracy, 6) AS accuracy
FROM crm_accounts LEFT JOIN r ON r.postal_code = CAST("Billing_ZIP" AS VARCHAR)""", gz=GAZETTEER, r=ROLLUP))
def geo_enrich(feeds: Feeds) -> DataFrame:
    """Account lines with the postal roll-up and a match flag."""
    lines = feeds.crm_accounts().select("PID", "EffectiveSegment", postal_code("Billing_ZIP").alias("postal_code"))
    wide = places.enrich(lines, rollup(feeds), ["postal_code"], "zip_found", ["place_name", "admin_name"])
    return rounded(wide.select("PID", "EffectiveSegment", "postal_code", "zip_found", "place_count", "place_name",
                               "admin_name", "latitude", "accuracy"))


@query("""SELECT c_custkey, CASE WHEN d.n IS NULL THEN 0 ELSE 1 END AS district_found,
  CASE WHEN m.n IS NULL THEN 0 ELSE 1 END AS municipality_found, d.n AS district_suppliers, m.n AS municipality_customers,
  ROUND(d.b, 6) AS district_balance
FROM customer c
LEFT JOIN (SELECT s_nationkey AS k, COUNT(*) AS n, AVG(s_acctbal) AS b FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) d
  ON d.k = c_nationkey
LEFT JOIN (SELECT c_nationkey AS k, c_mktsegment AS s, COUNT(*) AS n FROM customer WHERE c_acctbal > 7000 GROUP BY 1, 2) m
  ON m.k = c_nationkey AND m.s = c_mktsegment""")
def hierarchy_enrich(feeds: Feeds) -> DataFrame:
    """District lookup, then (district, municipality) lookup, each with its flag."""
    customers = feeds.table("customer").select(
        "c_custkey", F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("municipality"), "c_acctbal")
    districts = feeds.table("supplier").where(F.col("s_nationkey") % 3 != 0).groupBy(F.col("s_nationkey").alias("district")).agg(
        F.count(F.lit(1)).alias("district_suppliers"), F.avg("s_acctbal").alias("district_balance"))
    towns = customers.where(F.col("c_acctbal") > 7000).groupBy("district", "municipality").agg(
        F.count(F.lit(1)).alias("municipality_customers"))
    wide = places.enrich(customers, districts, ["district"], "district_found")
    wide = places.enrich(wide, towns, ["district", "municipality"], "municipality_found")
    return rounded(wide.select("c_custkey", "district_found", "municipality_found", "district_suppliers",
                               "municipality_customers", "district_balance"))


DOCUMENT_ROWS = """SELECT user_id % 20 AS doc, event_id, event_type, value,
  CASE WHEN event_type IN ('signup', 'error') THEN 'd' || CAST((event_id // 3) % 5 AS VARCHAR)
       ELSE 'm' || CAST(event_id % 11 AS VARCHAR) END AS label FROM events"""


def document_rows(feeds: Feeds) -> DataFrame:
    """Ordered rows of a few documents: headings d0..d4 and places below them."""
    e = F.col("event_id")
    heading = F.concat(F.lit("d"), (F.floor(e / 3) % 5).cast("string"))
    return feeds.table("events").select(
        (F.col("user_id") % 20).alias("doc"), "event_id", "event_type", "value",
        F.when(F.col("event_type").isin("signup", "error"), heading).otherwise(
            F.concat(F.lit("m"), (e % 11).cast("string"))).alias("label"))


@query(statement("", """SELECT doc, event_id, label,
  CASE WHEN cand IS NOT NULL AND cand IS DISTINCT FROM prev THEN 'district' ELSE 'municipality' END AS level,
  CASE WHEN cand IS NOT NULL AND cand IS DISTINCT FROM prev THEN cand ELSE COALESCE(prev, '') END AS district
FROM (SELECT *, LAST_VALUE(cand IGNORE NULLS) OVER (PARTITION BY doc ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM (SELECT *, CASE WHEN label LIKE 'd%' THEN label END AS cand FROM r))""", r=DOCUMENT_ROWS))
def hierarchy_fill(feeds: Feeds) -> DataFrame:
    """Headings carried to the rows below; a repeated open heading is a place of its own."""
    rows = document_rows(feeds)
    filled = places.with_headings(rows, "doc", "event_id", F.col("label"), F.col("label").startswith("d"),
                                  F.floor(F.col("event_id") / 1000))
    return filled.select("doc", "event_id", "label", "level", "district")


@query(statement("", """SELECT doc, heading, ROUND(ARG_MAX(value, event_id) FILTER (event_type = 'view'), 6) AS view,
  ROUND(ARG_MAX(value, event_id) FILTER (event_type = 'click'), 6) AS click,
  ROUND(ARG_MAX(value, event_id) FILTER (event_type = 'purchase'), 6) AS purchase
FROM (SELECT *, MAX(CASE WHEN label LIKE 'd%' THEN event_id END) OVER (PARTITION BY doc ORDER BY event_id) AS heading FROM r)
WHERE heading IS NOT NULL AND event_type IN ('view', 'click', 'purchase') GROUP BY doc, heading""", r=DOCUMENT_ROWS))
def hierarchy_pivot(feeds: Feeds) -> DataFrame:
    """Category rows below each heading turned into columns."""
    return rounded(places.pivot_under_heading(
        document_rows(feeds), "doc", "event_id", F.col("label").startswith("d"), F.col("event_type"), F.col("value"),
        ["view", "click", "purchase"], F.floor(F.col("event_id") / 1000)))


@query("""SELECT page_id, CAST(g.i - 1 AS INT) AS position, TRIM(REGEXP_REPLACE(items[g.i], '<[^>]+>', '', 'g')) AS item
FROM (SELECT page_id, REGEXP_EXTRACT_ALL(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS items FROM pages),
  LATERAL (SELECT UNNEST(RANGE(1, LEN(items) + 1)) AS i) g""")
def html_items(feeds: Feeds) -> DataFrame:
    """List items of every page in order."""
    return list_items(feeds.table("pages").select("page_id", "html"), "page_id")
