"""A media catalog over the driver's tables: each view is one SQL text that Spark and DuckDB both run.

An order is a photo, a customer's nation a folder, a region a project. Names in braces are views or tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from shutterlake.session import table

VIEWS: dict[str, str] = {
    "projects": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
               CASE r_regionkey % 3 WHEN 0 THEN 'wedding' WHEN 1 THEN 'sports' ELSE 'landscape' END AS shoot_type,
               CASE r_regionkey % 3 WHEN 0 THEN 'gentle' WHEN 1 THEN 'balanced' ELSE 'strict' END AS strictness FROM {region}""",
    "folders": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, concat('/', n_regionkey, '/', lower(n_name)) AS path,
               CASE WHEN n_nationkey % 11 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS project_id FROM {nation}""",
    "images": """
        SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS folder_id,
               concat('IMG_', CAST(o_orderkey % 997 AS VARCHAR(20)), CASE o_orderkey % 7 WHEN 0 THEN '.ARW' WHEN 1 THEN '.raf' WHEN 2 THEN '.JPG'
                      WHEN 3 THEN '.jpeg' WHEN 4 THEN '.CR3' WHEN 5 THEN '.v2.png' ELSE '' END) AS file_name,
               CASE o_orderkey % 7 WHEN 0 THEN 'arw' WHEN 1 THEN 'raf' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'cr3' WHEN 5 THEN 'png' ELSE 'heic' END AS format,
               CASE o_orderkey % 4 WHEN 0 THEN 'sony' WHEN 1 THEN 'fujifilm' WHEN 2 THEN 'canon' ELSE 'other' END AS camera_make,
               CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat('M', CAST(o_orderkey % 3 AS VARCHAR(20))) END AS camera_model,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('S', CAST(o_custkey % 4 AS VARCHAR(20))) END AS camera_serial,
               CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('FE ', CAST(20 + o_orderkey % 6 AS VARCHAR(20)), 'mm') END AS lens,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 1700000000000 + 700 * o_orderkey END AS captured_at_ms,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(100 * (1 + o_orderkey % 8) AS INT) END AS iso,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1.0E0 / (60 * (1 + o_orderkey % 5)) END AS shutter_s,
               CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE 1.4E0 + 0.7E0 * (o_orderkey % 4) END AS aperture,
               CASE WHEN o_orderkey % 8 = 2 THEN NULL ELSE 23.04E0 + 12.5E0 * (o_orderkey % 5) END AS focal_mm,
               CAST((7 * o_orderkey) % 6 AS INT) AS rating,
               CASE o_orderkey % 11 WHEN 0 THEN 'pick' WHEN 1 THEN 'pick' WHEN 2 THEN 'reject' ELSE 'unflagged' END AS pick,
               CASE WHEN o_orderkey % 11 > 2 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'auto' ELSE 'user' END AS pick_origin,
               CASE o_orderkey % 13 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' ELSE NULL END AS color_label,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 24.0E0) AS BIGINT) ELSE NULL END AS burst_id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 40.0E0) AS BIGINT) END AS scene_id,
               CASE WHEN o_orderkey % 100 = 0 THEN 1700000000000 ELSE NULL END AS missing_since_ms,
               o_orderkey % 17 = 0 AS xmp_dirty,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1700000000000 + (o_orderkey % 50) END AS xmp_mtime_ms,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1700000000000 + (o_orderkey % 40) END AS meta_updated_ms,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey * 2654435761) % 4294967296 END AS phash
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "scores": """
        SELECT o_orderkey AS image_id, CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000.0E0 AS overall,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 37 % 100) / 100.0E0 END AS face_sharpness,
               (o_orderkey * 53 % 100) / 100.0E0 AS global_sharpness,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 71 % 100) / 100.0E0 END AS eyes_open,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 29 % 100) / 100.0E0 END AS composition,
               CAST(o_orderkey % 5 AS INT) AS suggested_rating,
               CASE o_orderkey % 7 WHEN 0 THEN 'pick' WHEN 1 THEN 'reject' WHEN 2 THEN 'pick' ELSE 'unflagged' END AS suggested_pick,
               CASE o_orderkey % 8 WHEN 0 THEN '[{"kind":"blink","text":"Eyes closed"}]' WHEN 1 THEN '[{"kind":"missed_focus","text":"Soft"},{"kind":"other","text":"x"}]'
                    WHEN 2 THEN 'broken{' WHEN 3 THEN NULL ELSE '[]' END AS reasons_json
        FROM {orders} WHERE o_orderkey % 10 <> 0""",
    "tags": """
        SELECT l_orderkey AS image_id, concat('t', CAST(l_partkey % 6 AS VARCHAR(20))) AS tag, min(CASE WHEN l_linenumber % 2 = 0 THEN 'user' ELSE 'auto' END) AS source,
               max(l_discount) AS confidence, min(l_partkey % 25) = 0 AS suppressed
        FROM {lineitem} GROUP BY l_orderkey, l_partkey % 6""",
    "bursts": """
        SELECT burst_id AS id, min(captured_at_ms) AS started_at_ms, max(captured_at_ms) AS ended_at_ms,
               CASE WHEN burst_id % 4 = 0 THEN NULL ELSE min(id) END AS keeper_id FROM {images} WHERE burst_id IS NOT NULL GROUP BY burst_id""",
    "adjustments": """
        SELECT o_orderkey AS image_id, o_orderkey % 20 = 0 AS neutral, 1700000000000 + (o_orderkey % 60) AS updated_at_ms,
               concat('{"exposure":', CAST(o_orderkey % 5 AS VARCHAR(20)), ',"light":{"contrast":', CAST(o_orderkey % 3 AS VARCHAR(20)), '}}') AS params_json
        FROM {orders} WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 0""",
    "selection": """
        SELECT i.id AS image_id, f.project_id, CASE WHEN i.id % 5 = 0 THEN 'deliver' WHEN i.id % 5 = 1 THEN 'alternative' WHEN i.id % 5 = 2 THEN 'not_sure' ELSE 'set_aside' END AS choice,
               CASE WHEN i.id % 31 = 0 THEN NULL ELSE i.scene_id END AS moment_id,
               CASE i.id % 4 WHEN 0 THEN 'couple' WHEN 1 THEN 'group' WHEN 2 THEN 'detail' ELSE 'candid' END AS shot_type,
               CASE WHEN i.id % 5 = 1 THEN i.id - 1 ELSE NULL END AS alternative_of, CASE WHEN i.id % 5 = 0 THEN NULL ELSE i.id - i.id % 5 END AS covered_by,
               (i.id * 41 % 1000) / 1000.0E0 AS score, i.id % 23 = 0 AS locked,
               CASE WHEN i.id % 5 = 0 THEN NULL ELSE (i.id * 17 % 100) / 100.0E0 END AS covered_similarity,
               CASE i.id % 9 WHEN 0 THEN '[{"kind":"near_duplicate"}]' WHEN 1 THEN '[{"kind":"weaker"},{"kind":"near_duplicate"}]' WHEN 2 THEN NULL ELSE '[]' END AS reasons_json
        FROM {images} i JOIN {folders} f ON i.folder_id = f.id WHERE f.project_id IS NOT NULL""",
    "edges": """
        SELECT a.image_id AS image_a, b.image_id AS image_b, a.moment_id, ((a.image_id * 13 + b.image_id * 7) % 1000) / 1000.0E0 AS similarity
        FROM {selection} a JOIN {selection} b ON a.moment_id = b.moment_id AND a.project_id = b.project_id AND a.image_id < b.image_id""",
    "vectors": "SELECT vec_id, embedding, CAST(label AS BIGINT) AS label FROM {embeddings}",
}

_NAME = re.compile(r"\{(\w+)\}")


@lru_cache(None)
def needs(name: str) -> tuple[str, ...]:
    """The views that a view reads, deepest first, and itself."""
    out: list[str] = []
    for n in _NAME.findall(VIEWS[name]):
        if n in VIEWS:
            out += [x for x in needs(n) if x not in out]
    return (*out, name)


_ANALYSED: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the catalog, or a table of the driver, as a DataFrame; analysed once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ANALYSED:
        _ANALYSED[key] = run(spark, sf_dir, VIEWS[name]) if name in VIEWS else table(spark, sf_dir, name)
    return _ANALYSED[key]


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over views and tables named in braces."""
    literal = text.replace("{", "{{").replace("}", "}}")  # braces of JSON texts stay; those of names don't
    return spark.sql(re.sub(r"\{\{(\w+)\}\}", r"{\1}", literal), **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})


def oracle(sql: str) -> str:
    """SQL over views named in braces, as one statement for DuckDB: the views come first as common table expressions."""
    names: list[str] = []
    for n in _NAME.findall(sql):
        if n in VIEWS:
            names += [x for x in needs(n) if x not in names]
    ctes = ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m[1], VIEWS[n])})" for n in names)
    body = _NAME.sub(lambda m: m[1], sql)
    if not names:
        return body
    if re.match(r"\s*WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'^\s*WITH RECURSIVE', '', body)}"
    if re.match(r"\s*WITH\b", body):
        return f"WITH {ctes},\n{re.sub(r'^\s*WITH', '', body)}"
    return f"WITH {ctes}\n{body}"
