"""Joins, summaries, rankings, sets and states of the catalog that plain SQL says best: one text, planned by Catalyst.

Windows here are over a folder, scene, burst, moment or image, which are bounded by how photos are taken; what is over
all images is an aggregate that is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.plans.catalog import register
from shutterlake.sources.catalog_views import oracle, run


def both(name: str, sql: str, other: str | None = None) -> None:
    """Register a query in Spark SQL; DuckDB runs the same text, or the other one where the dialects differ."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, sql)

    register(name, oracle(other or sql))(query)


# Joins
both("jon07_scalar_subqueries", """
    SELECT s.image_id, c.moment_id AS cover_moment, coalesce(t.n, 0) AS tag_count, t.first_tag FROM {selection} s LEFT JOIN {selection} c ON c.image_id = s.covered_by
    LEFT JOIN (SELECT image_id, count(*) AS n, min(tag) AS first_tag FROM {tags} WHERE NOT suppressed GROUP BY image_id) t ON t.image_id = s.image_id""",
    "SELECT s.image_id, (SELECT c.moment_id FROM {selection} c WHERE c.image_id = s.covered_by) AS cover_moment, (SELECT count(*) FROM {tags} t WHERE t.image_id = s.image_id AND NOT suppressed) AS tag_count, (SELECT min(tag) FROM {tags} t WHERE t.image_id = s.image_id AND NOT suppressed) AS first_tag FROM {selection} s")
both("jon08_row_and_cover", """
    SELECT s.image_id, s.covered_by, c.choice AS cover_choice, s.moment_id IS NOT DISTINCT FROM c.moment_id AS same_moment FROM {selection} s JOIN {selection} c ON c.image_id = s.covered_by""")
both("jon09_same_camera_body", """
    SELECT i.id, b.n - 1 AS others, b.first_ms FROM (SELECT k.*, f.project_id FROM {images} k JOIN {folders} f ON f.id = k.folder_id) i
    JOIN (SELECT f.project_id, camera_make, camera_model, camera_serial, count(*) AS n, min(captured_at_ms) AS first_ms FROM {images} k JOIN {folders} f ON f.id = k.folder_id GROUP BY f.project_id, camera_make, camera_model, camera_serial) b
      ON i.project_id IS NOT DISTINCT FROM b.project_id AND i.camera_make IS NOT DISTINCT FROM b.camera_make AND i.camera_model IS NOT DISTINCT FROM b.camera_model AND i.camera_serial IS NOT DISTINCT FROM b.camera_serial""",
    """SELECT i.id, (SELECT count(*) FROM {images} k JOIN {folders} g ON g.id = k.folder_id WHERE k.id <> i.id AND g.project_id IS NOT DISTINCT FROM f.project_id AND k.camera_make IS NOT DISTINCT FROM i.camera_make AND k.camera_model IS NOT DISTINCT FROM i.camera_model AND k.camera_serial IS NOT DISTINCT FROM i.camera_serial) AS others,
              (SELECT min(k.captured_at_ms) FROM {images} k JOIN {folders} g ON g.id = k.folder_id WHERE g.project_id IS NOT DISTINCT FROM f.project_id AND k.camera_make IS NOT DISTINCT FROM i.camera_make AND k.camera_model IS NOT DISTINCT FROM i.camera_model AND k.camera_serial IS NOT DISTINCT FROM i.camera_serial) AS first_ms
       FROM {images} i JOIN {folders} f ON f.id = i.folder_id""")
both("jon10_state_chain", """
    SELECT i.id, CASE WHEN i.missing_since_ms IS NOT NULL THEN 'missing' WHEN q.image_id IS NULL THEN 'pending' WHEN a.image_id IS NOT NULL AND NOT a.neutral THEN 'edited' WHEN s.locked THEN 'locked'
           WHEN b.keeper_id = i.id THEN 'keeper' WHEN s.choice IS NOT NULL THEN s.choice ELSE 'plain' END AS state
    FROM {images} i LEFT JOIN {scores} q ON q.image_id = i.id LEFT JOIN {adjustments} a ON a.image_id = i.id LEFT JOIN {selection} s ON s.image_id = i.id LEFT JOIN {bursts} b ON b.id = i.burst_id LEFT JOIN {folders} f ON f.id = i.folder_id""")
both("jon13_interval_bracket", """
    WITH t AS (SELECT id, scene_id, captured_at_ms AS t, pick = 'pick' AS anchor FROM {images} WHERE scene_id IS NOT NULL AND captured_at_ms IS NOT NULL),
    x AS (SELECT *, max(CASE WHEN anchor THEN t END) OVER (PARTITION BY scene_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN anchor THEN t END) OVER (PARTITION BY scene_id ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM t)
    SELECT id, coalesce(a, b) AS anchor_ms, CASE WHEN a < t AND t < b THEN (t - a) / CAST(b - a AS DOUBLE) END AS weight FROM x WHERE NOT anchor AND (a IS NOT NULL OR b IS NOT NULL)""",
    """SELECT q.id, coalesce(l.a, h.b) AS anchor_ms, CASE WHEN l.a < q.captured_at_ms AND q.captured_at_ms < h.b THEN (q.captured_at_ms - l.a) / CAST(h.b - l.a AS DOUBLE) END AS weight
       FROM {images} q LEFT JOIN LATERAL (SELECT max(captured_at_ms) AS a FROM {images} k WHERE k.scene_id = q.scene_id AND k.pick = 'pick' AND (k.captured_at_ms, k.id) < (q.captured_at_ms, q.id)) l ON TRUE
       LEFT JOIN LATERAL (SELECT min(captured_at_ms) AS b FROM {images} k WHERE k.scene_id = q.scene_id AND k.pick = 'pick' AND (k.captured_at_ms, k.id) > (q.captured_at_ms, q.id)) h ON TRUE
       WHERE q.pick <> 'pick' AND q.captured_at_ms IS NOT NULL AND coalesce(l.a, h.b) IS NOT NULL""")
both("jon14_blocked_pairs", """
    SELECT e.image_a, e.image_b, e.similarity FROM {edges} e JOIN (SELECT moment_id, project_id, count(*) AS n FROM {selection} WHERE moment_id IS NOT NULL GROUP BY moment_id, project_id) m ON m.moment_id = e.moment_id
    JOIN {selection} s ON s.image_id = e.image_a AND s.project_id = m.project_id WHERE m.n <= 300 OR e.similarity >= 0.3E0""")

# Summaries
both("agg08_status_histogram", """
    SELECT CASE WHEN missing_since_ms IS NOT NULL THEN 'missing' WHEN xmp_dirty THEN 'dirty' WHEN q.image_id IS NULL THEN 'pending' ELSE 'done' END AS status, count(*) AS n FROM {images} i LEFT JOIN {scores} q ON q.image_id = i.id GROUP BY 1""")
both("agg10_distinct_tags", """
    SELECT i.scene_id, array_join(sort_array(collect_set(t.tag)), ',') AS tags, count(DISTINCT i.id) AS images FROM {images} i JOIN {tags} t ON t.image_id = i.id WHERE i.scene_id IS NOT NULL AND NOT t.suppressed GROUP BY i.scene_id""",
    "SELECT i.scene_id, string_agg(DISTINCT t.tag, ',' ORDER BY t.tag) AS tags, count(DISTINCT i.id) AS images FROM {images} i JOIN {tags} t ON t.image_id = i.id WHERE i.scene_id IS NOT NULL AND NOT t.suppressed GROUP BY i.scene_id")
both("agg13_pairs_with_weight", """
    SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n, CAST(sum(least(a.confidence, b.confidence)) AS DOUBLE) AS weight FROM {tags} a JOIN {tags} b ON a.image_id = b.image_id AND a.tag < b.tag GROUP BY a.tag, b.tag""")
both("agg14_mode_template", """
    WITH p AS (SELECT i.camera_make, a.params_json, count(*) AS n FROM {adjustments} a JOIN {images} i ON i.id = a.image_id WHERE NOT a.neutral GROUP BY i.camera_make, a.params_json),
    own AS (SELECT camera_make, params_json FROM (SELECT *, row_number() OVER (PARTITION BY camera_make ORDER BY n DESC, params_json) AS r, sum(n) OVER (PARTITION BY camera_make) AS s FROM p) x WHERE r = 1 AND s >= 30),
    every AS (SELECT params_json FROM (SELECT params_json, row_number() OVER (ORDER BY sum(n) DESC, params_json) AS r FROM p GROUP BY params_json) x WHERE r = 1)
    SELECT c.camera_make, coalesce(o.params_json, e.params_json) AS template FROM (SELECT DISTINCT camera_make FROM {images}) c LEFT JOIN own o ON o.camera_make = c.camera_make LEFT JOIN every e ON 1 = 1""")
both("agg15_context_means", """
    SELECT scene_id, avg(CAST(focal_mm AS DOUBLE)) AS focal_mm, avg(CAST(aperture AS DOUBLE)) AS aperture, avg(CAST(iso AS DOUBLE)) AS iso, avg(q.overall) AS overall, count(*) AS n FROM {images} i LEFT JOIN {scores} q ON q.image_id = i.id WHERE scene_id IS NOT NULL GROUP BY scene_id""")
both("agg16_centroids", """
    WITH e AS (SELECT v.label, x.pos, sum((1 + v.vec_id % 3) * CAST(x.col AS DOUBLE)) AS s FROM {vectors} v LATERAL VIEW posexplode(v.embedding) x AS pos, col GROUP BY v.label, x.pos),
    n AS (SELECT label, sqrt(sum(s * s)) AS norm FROM e GROUP BY label)
    SELECT e.label, CAST(e.pos AS BIGINT) AS pos, round(s / norm, 6) AS value FROM e JOIN n ON n.label = e.label WHERE norm > 0""",
    """WITH x AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM {vectors}), e AS (SELECT label, pos, sum((1 + vec_id % 3) * CAST(v AS DOUBLE)) AS s FROM x GROUP BY label, pos),
       n AS (SELECT label, sqrt(sum(s * s)) AS norm FROM e GROUP BY label) SELECT e.label, CAST(e.pos AS BIGINT) AS pos, round(s / norm, 6) AS value FROM e JOIN n ON n.label = e.label WHERE norm > 0""")
both("agg18_upper_median", """
    SELECT scene_id, focal_mm AS upper_median FROM (SELECT scene_id, focal_mm, row_number() OVER (PARTITION BY scene_id ORDER BY focal_mm, id) - 1 AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM {images} WHERE scene_id IS NOT NULL AND focal_mm IS NOT NULL) x
    WHERE r = CAST(floor(n / 2.0E0) AS BIGINT)""",
    "SELECT scene_id, list_sort(list(focal_mm))[len(list(focal_mm)) // 2 + 1] AS upper_median FROM {images} WHERE scene_id IS NOT NULL AND focal_mm IS NOT NULL GROUP BY scene_id")
both("agg20_histograms", """
    SELECT folder_id, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY folder_id) AS DOUBLE) AS share FROM (SELECT folder_id, CAST(least(greatest(floor((focal_mm - 20) / 7.5E0), 0), 7) AS BIGINT) AS bin FROM {images} WHERE focal_mm IS NOT NULL) x GROUP BY folder_id, bin""")
both("agg22_edit_states", """
    SELECT f.project_id, CASE WHEN a.image_id IS NULL THEN 'untouched' WHEN a.neutral THEN 'neutral' WHEN a.updated_at_ms > coalesce(i.xmp_mtime_ms, 0) THEN 'changed' ELSE 'written' END AS state, count(*) AS n
    FROM {images} i JOIN {folders} f ON f.id = i.folder_id LEFT JOIN {adjustments} a ON a.image_id = i.id GROUP BY 1, 2""")
both("agg24_catalog_state", """
    SELECT count(*) AS images, count(*) FILTER (WHERE xmp_dirty) AS dirty, count(*) FILTER (WHERE missing_since_ms IS NOT NULL) AS missing, count(DISTINCT folder_id) AS folders, count(DISTINCT burst_id) AS bursts, max(captured_at_ms) AS last_ms FROM {images}""")

# Windows
both("win04_dense_rerank", """
    SELECT image_id, alternative_of, row_number() OVER (PARTITION BY alternative_of ORDER BY place) AS place FROM (SELECT image_id, alternative_of, row_number() OVER (PARTITION BY alternative_of ORDER BY score DESC, image_id) AS place FROM {selection} WHERE alternative_of IS NOT NULL) x WHERE image_id % 3 <> 0""")
both("win05_burst_spans", """
    WITH p AS (SELECT id, folder_id, burst_id, row_number() OVER (PARTITION BY folder_id ORDER BY captured_at_ms ASC NULLS LAST, file_name, id) AS r FROM {images}),
    s AS (SELECT folder_id, burst_id, min(r) AS a, max(r) AS b FROM p WHERE burst_id IS NOT NULL GROUP BY folder_id, burst_id),
    e AS (SELECT folder_id, a + 1 AS r, 1 AS d FROM s WHERE b > a UNION ALL SELECT folder_id, b + 1, -1 FROM s WHERE b > a), c AS (SELECT folder_id, r, CAST(sum(d) AS BIGINT) AS d FROM e GROUP BY folder_id, r)
    SELECT p.id, CAST(coalesce(sum(c.d) OVER (PARTITION BY p.folder_id ORDER BY p.r ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) > 0 AS locked FROM p LEFT JOIN c ON c.folder_id = p.folder_id AND c.r = p.r""",
    """WITH p AS (SELECT id, folder_id, burst_id, row_number() OVER (PARTITION BY folder_id ORDER BY captured_at_ms ASC NULLS LAST, file_name, id) AS r FROM {images}),
       s AS (SELECT folder_id, burst_id, min(r) AS a, max(r) AS b FROM p WHERE burst_id IS NOT NULL GROUP BY folder_id, burst_id)
       SELECT p.id, EXISTS (SELECT 1 FROM s WHERE s.folder_id = p.folder_id AND s.a < p.r AND p.r <= s.b) AS locked FROM p""")
both("win06_motion_runs", """
    SELECT id, scene_id, max(motion) OVER (PARTITION BY scene_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS most FROM (SELECT id, scene_id, captured_at_ms AS t, CASE WHEN captured_at_ms - lag(captured_at_ms) OVER w <= 3000 THEN abs(focal_mm - lag(focal_mm) OVER w) END AS motion
      FROM {images} WHERE scene_id IS NOT NULL AND captured_at_ms IS NOT NULL WINDOW w AS (PARTITION BY scene_id ORDER BY captured_at_ms, id)) x""")
both("win07_last_eight", """
    SELECT id, scene_id, max(aperture) OVER w AS widest, count(aperture) OVER w AS n FROM {images} WHERE scene_id IS NOT NULL WINDOW w AS (PARTITION BY scene_id ORDER BY id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
both("win08_running_mean", """
    SELECT scene_id, round(aggregate(slice(v, 2, 1000000), element_at(v, 1), (m, x) -> m + 0.35E0 * (x - m)), 9) AS mean, CAST(size(v) AS BIGINT) AS n FROM (SELECT scene_id, transform(array_sort(collect_list(struct(id, focal_mm))), s -> s.focal_mm) AS v FROM {images} WHERE scene_id IS NOT NULL AND focal_mm IS NOT NULL GROUP BY scene_id) x""",
    """WITH RECURSIVE o AS (SELECT scene_id, focal_mm, row_number() OVER (PARTITION BY scene_id ORDER BY id) AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM {images} WHERE scene_id IS NOT NULL AND focal_mm IS NOT NULL),
       m AS (SELECT scene_id, r, n, focal_mm AS mean FROM o WHERE r = 1 UNION ALL SELECT o.scene_id, o.r, o.n, m.mean + 0.35E0 * (o.focal_mm - m.mean) FROM m JOIN o ON o.scene_id = m.scene_id AND o.r = m.r + 1)
       SELECT scene_id, round(mean, 9) AS mean, n FROM m WHERE r = n""")
both("win10_even_sample", """
    SELECT id, scene_id FROM (SELECT id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM {images} WHERE scene_id IS NOT NULL) x
    WHERE n <= 3 OR r = CAST(floor(1 * n / 6.0E0) AS BIGINT) OR r = CAST(floor(3 * n / 6.0E0) AS BIGINT) OR r = CAST(floor(5 * n / 6.0E0) AS BIGINT)""")
both("win13_time_groups", """
    SELECT folder_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(t) AS first_ms, max(t) AS last_ms FROM (SELECT folder_id, t, sum(cut) OVER (PARTITION BY folder_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS grp FROM
      (SELECT id, folder_id, captured_at_ms AS t, CASE WHEN captured_at_ms - lag(captured_at_ms) OVER (PARTITION BY folder_id ORDER BY captured_at_ms, id) <= 90000 THEN 0 ELSE 1 END AS cut FROM {images} WHERE captured_at_ms IS NOT NULL) x) y GROUP BY folder_id, grp""")
both("win14_first_of_burst", """
    SELECT id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY later, id) AS turn FROM (SELECT id, scene_id, burst_id IS NOT NULL AND row_number() OVER (PARTITION BY burst_id ORDER BY id) > 1 AS later FROM {images} WHERE scene_id IS NOT NULL) x""")

# Sorts and top rows
both("srt04_enum_order", """
    SELECT format, n, row_number() OVER (ORDER BY CASE format WHEN 'arw' THEN 0 WHEN 'raf' THEN 1 WHEN 'cr3' THEN 2 WHEN 'jpeg' THEN 3 WHEN 'heic' THEN 4 WHEN 'tiff' THEN 5 ELSE 6 END) AS place FROM (SELECT format, count(*) AS n FROM {images} GROUP BY format) x""")
both("srt06_top_by_priority", """
    SELECT project_id, image_id, place FROM (SELECT project_id, image_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN locked THEN 0 ELSE 1 END, score DESC, image_id) AS place FROM {selection}) x WHERE place <= 25""")
both("srt07_nearest_five", """
    SELECT id, other, place FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.focal_mm - b.focal_mm) + abs(a.aperture - b.aperture), b.id) AS place FROM {images} a JOIN {images} b ON a.scene_id = b.scene_id AND a.id <> b.id
      WHERE a.focal_mm IS NOT NULL AND a.aperture IS NOT NULL AND b.focal_mm IS NOT NULL AND b.aperture IS NOT NULL) x WHERE place <= 5""")
both("srt10_role_order", """
    SELECT tag, n, row_number() OVER (ORDER BY CASE tag WHEN 't3' THEN 0 WHEN 't0' THEN 1 ELSE 2 END, n DESC, tag) AS place FROM (SELECT tag, count(*) AS n FROM {tags} WHERE NOT suppressed GROUP BY tag) x""")

# Sets
both("set01_people_similarity", """
    WITH p AS (SELECT image_id, collect_set(tag) AS s FROM {tags} WHERE NOT suppressed GROUP BY image_id)
    SELECT e.image_a, e.image_b, size(array_intersect(a.s, b.s)) / CAST(size(array_union(a.s, b.s)) AS DOUBLE) AS similarity FROM {edges} e LEFT JOIN p a ON a.image_id = e.image_a LEFT JOIN p b ON b.image_id = e.image_b WHERE e.image_a % 4 < 2""",
    """WITH p AS (SELECT image_id, list(DISTINCT tag) AS s FROM {tags} WHERE NOT suppressed GROUP BY image_id)
       SELECT e.image_a, e.image_b, CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) END AS similarity FROM {edges} e LEFT JOIN p a ON a.image_id = e.image_a LEFT JOIN p b ON b.image_id = e.image_b WHERE e.image_a % 4 < 2""")
both("set02_ordered_dedup", """
    SELECT scene_id, array_join(array_distinct(transform(array_sort(collect_list(struct(id, camera_make))), s -> s.camera_make)), ',') AS makes FROM {images} WHERE scene_id IS NOT NULL GROUP BY scene_id""",
    "SELECT scene_id, string_agg(camera_make, ',' ORDER BY first_id) AS makes FROM (SELECT scene_id, camera_make, min(id) AS first_id FROM {images} WHERE scene_id IS NOT NULL GROUP BY scene_id, camera_make) GROUP BY scene_id")
both("set04_member_replace", """
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'joining' WHEN n.id IS NULL THEN 'leaving' ELSE 'staying' END AS move FROM (SELECT id FROM {images} WHERE scene_id % 10 = 3) o
    FULL JOIN (SELECT id FROM {images} WHERE scene_id % 10 IN (3, 4) AND pick <> 'reject') n ON n.id = o.id""")
both("set05_conflicts", """
    SELECT image_id, min(place) AS place FROM (SELECT image_id, 0 AS place FROM {adjustments} WHERE updated_at_ms > 1700000000030 UNION ALL SELECT s.image_id, 1 FROM {selection} s JOIN {adjustments} a ON a.image_id = s.covered_by WHERE a.updated_at_ms > 1700000000030) x GROUP BY image_id""")
both("set07_orphans", "SELECT f.id FROM {folders} f LEFT ANTI JOIN (SELECT folder_id FROM {images} WHERE id % 2 = 0 AND rating >= 4 AND folder_id % 5 <> 0) i ON i.folder_id = f.id", "SELECT id FROM {folders} WHERE id NOT IN (SELECT DISTINCT folder_id FROM {images} WHERE id % 2 = 0 AND rating >= 4 AND folder_id % 5 <> 0)")

# Bursts and suggestions
_RANKED = """SELECT i.id, i.burst_id, i.captured_at_ms AS t, i.id % 5 = 0 AS pinned, q.overall, q.eyes_open, q.face_sharpness, q.suggested_pick, q.suggested_rating, coalesce(q.reasons_json, '') AS reasons FROM {images} i JOIN {scores} q ON q.image_id = i.id WHERE i.burst_id IS NOT NULL"""
_KEEPERS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY overall DESC NULLS LAST, t ASC NULLS LAST, id) AS r FROM ({_RANKED}) x) y WHERE r = 1"
both("grp02_pinned_keepers", f"SELECT burst_id, id AS keeper_id FROM (SELECT burst_id, id, row_number() OVER (PARTITION BY burst_id ORDER BY CASE WHEN pinned THEN 0 ELSE 1 END, overall DESC NULLS LAST, t ASC NULLS LAST, id) AS r FROM ({_RANKED}) x) y WHERE r = 1")
for _name, _eyes, _face, _gap, _same in (("balanced", 0.3, 0.15, None, True), ("aggressive", 0.15, 0.08, 0.1, False)):
    _worse = f"k.eyes_open - m.eyes_open >= {_eyes}E0 OR k.face_sharpness - m.face_sharpness >= {_face}E0" + (f" OR k.overall - m.overall >= {_gap}E0" if _gap else "")
    both(f"grp04_clearly_worse_{_name}", f"""
        WITH m AS ({_RANKED}), k AS ({_KEEPERS})
        SELECT m.id, coalesce(m.suggested_pick <> 'reject' AND k.suggested_pick <> 'reject' AND k.reasons NOT LIKE '%"missed_focus"%' AND k.reasons NOT LIKE '%"motion_blur"%' AND k.reasons NOT LIKE '%"blink"%'
               {"AND k.eyes_open IS NOT NULL AND m.eyes_open IS NOT NULL" if _same else ""} AND (coalesce({_worse.replace(" OR ", ", FALSE) OR coalesce(")}, FALSE)), FALSE) AS rejected FROM m JOIN k ON k.burst_id = m.burst_id WHERE m.id <> k.id""")
both("grp05_place_in_burst", f"""
    SELECT m.id, concat('Frame ', CAST(m.r AS STRING), ' of ', CAST(m.n AS STRING)) AS place, CASE WHEN m.best > 0 THEN CAST(round(100 * m.face_sharpness / m.best) AS BIGINT) END AS soft_percent
    FROM (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY t ASC NULLS LAST, id) AS r, count(*) OVER (PARTITION BY burst_id) AS n, max(face_sharpness) OVER (PARTITION BY burst_id) AS best FROM ({_RANKED}) x) m WHERE m.n > 1""")
both("sel07_apply_by_kind", """
    SELECT id, CASE WHEN suggested_pick = 'pick' THEN 'pick' ELSE pick END AS pick, suggested_rating AS rating FROM {images} i JOIN {scores} q ON q.image_id = i.id
    WHERE pick = 'unflagged' AND rating = 0 AND (suggested_pick = 'pick' OR suggested_rating <> rating)""")
both("agg23_apply_tally", """
    SELECT CASE WHEN i.pick <> 'unflagged' AND coalesce(i.pick_origin, 'user') <> 'auto' THEN 'protected' WHEN s.choice = 'deliver' AND i.pick <> 'pick' THEN 'set_pick' WHEN s.choice <> 'deliver' AND i.pick = 'pick' THEN 'unset' ELSE 'unchanged' END AS action, count(*) AS n
    FROM {selection} s JOIN {images} i ON i.id = s.image_id GROUP BY 1""")
both("sel04_run_writer", """
    SELECT coalesce(o.image_id, n.image_id) AS image_id, CASE WHEN o.locked THEN o.choice ELSE n.choice END AS choice, coalesce(o.locked, FALSE) AS locked, CASE WHEN n.image_id IS NULL THEN o.score ELSE n.score END AS score
    FROM (SELECT image_id, choice, locked, score FROM {selection} WHERE image_id % 7 <> 1) o
    FULL JOIN (SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 'deliver' ELSE 'set_aside' END AS choice, 1 - score AS score FROM {selection} WHERE image_id % 6 <> 2) n ON n.image_id = o.image_id WHERE n.image_id IS NOT NULL OR o.locked""")

# Sources, sinks and states
_FILES = "(SELECT id, concat('/', CAST(folder_id AS STRING)) AS dir, lower(CASE WHEN instr(file_name, '.') = 0 THEN concat('img_', CAST(id % 400 AS STRING)) ELSE concat('img_', CAST(id % 400 AS STRING)) END) AS stem, format FROM {images})"
both("src08_companions", f"""
    SELECT r.id AS raw_id, j.id AS companion_id FROM (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY id) AS r FROM {_FILES} x WHERE format IN ('arw', 'raf', 'cr3')) r
    JOIN (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY CASE format WHEN 'jpeg' THEN 0 ELSE 1 END, id) AS r FROM {_FILES} y WHERE format IN ('jpeg', 'heic')) j ON j.dir = r.dir AND j.stem = r.stem AND j.r = r.r""")
both("src03_known_formats", """
    SELECT id, CASE WHEN ext IN ('arw') THEN 'arw' WHEN ext IN ('raf') THEN 'raf' WHEN ext IN ('cr3') THEN 'cr3' WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' WHEN ext IN ('heic', 'heif', 'hif') THEN 'heic' WHEN ext IN ('tif', 'tiff') THEN 'tiff' WHEN ext = 'png' THEN 'png' END AS format
    FROM (SELECT id, CASE WHEN instr(file_name, '.') = 0 THEN '' ELSE lower(substring_index(file_name, '.', -1)) END AS ext FROM {images}) x""",
    """SELECT id, CASE WHEN ext IN ('arw') THEN 'arw' WHEN ext IN ('raf') THEN 'raf' WHEN ext IN ('cr3') THEN 'cr3' WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' WHEN ext IN ('heic', 'heif', 'hif') THEN 'heic' WHEN ext IN ('tif', 'tiff') THEN 'tiff' WHEN ext = 'png' THEN 'png' END AS format
       FROM (SELECT id, CASE WHEN instr(file_name, '.') = 0 THEN '' ELSE lower(regexp_extract(file_name, '[^.]*$')) END AS ext FROM {images}) x""")
both("src13_keyset_page", "SELECT id, file_name FROM {images} WHERE id > 1000 AND xmp_dirty ORDER BY id LIMIT 200")
both("src14_oldest_pending", "SELECT i.id FROM {images} i LEFT JOIN {scores} q ON q.image_id = i.id WHERE q.image_id IS NULL AND missing_since_ms IS NULL ORDER BY i.meta_updated_ms ASC NULLS FIRST, i.id LIMIT 64")
both("src15_relocation", """
    WITH found AS (SELECT id AS file_id, concat(CAST(folder_id AS STRING), '/', file_name) AS path, file_name FROM {images} WHERE id % 3 = 0),
    uniq AS (SELECT file_name, min(file_id) AS file_id FROM found GROUP BY file_name HAVING count(*) = 1), paths AS (SELECT path, min(file_id) AS file_id FROM found GROUP BY path)
    SELECT i.id, coalesce(p.file_id, u.file_id) AS file_id FROM (SELECT id, file_name, concat(CAST(folder_id AS STRING), '/', file_name) AS path FROM {images} WHERE missing_since_ms IS NOT NULL) i LEFT JOIN paths p ON p.path = i.path LEFT JOIN uniq u ON u.file_name = i.file_name""")
both("snk01_insert_ignore", """
    SELECT id, rating FROM (SELECT id, rating, file_name, folder_id, row_number() OVER (PARTITION BY folder_id, file_name ORDER BY new, id) AS r FROM (SELECT id, rating, file_name, folder_id, 0 AS new FROM {images} WHERE id % 2 = 0 UNION ALL SELECT id, rating, file_name, folder_id, 1 FROM {images} WHERE id % 2 = 1) x) y WHERE r = 1""")
both("snk02_upsert", """
    SELECT coalesce(o.image_id, n.image_id) AS image_id, CASE WHEN n.image_id IS NULL THEN o.overall ELSE n.overall END AS overall, CASE WHEN n.image_id IS NULL THEN 'kept' WHEN o.image_id IS NULL THEN 'inserted' WHEN n.overall > o.overall THEN 'updated' ELSE 'replaced' END AS action
    FROM (SELECT image_id, overall FROM {scores} WHERE image_id % 3 <> 0) o FULL JOIN (SELECT image_id, 1 - overall AS overall FROM {scores} WHERE image_id % 4 <> 1) n ON n.image_id = o.image_id""")
both("snk03_keep_known", """
    SELECT i.id, coalesce(i.iso, x.iso) AS iso, coalesce(nullif(trim(i.lens), ''), x.lens) AS lens, CASE WHEN i.iso IS NULL AND x.iso IS NOT NULL THEN 'extracted' WHEN i.iso IS NOT NULL THEN 'kept' ELSE 'unknown' END AS provenance
    FROM {images} i LEFT JOIN (SELECT id, 640 AS iso, 'kit' AS lens FROM {images} WHERE id % 2 = 0) x ON x.id = i.id""")
both("stm02_analysis_queue", """
    SELECT i.id, CASE WHEN q.image_id IS NULL THEN 'none' WHEN a.updated_at_ms > i.meta_updated_ms THEN 'stale' ELSE 'other' END AS why FROM {images} i LEFT JOIN {scores} q ON q.image_id = i.id LEFT JOIN {adjustments} a ON a.image_id = i.id
    WHERE i.missing_since_ms IS NULL AND (q.image_id IS NULL OR a.updated_at_ms > i.meta_updated_ms)""")
both("stm03_cache_valid", "SELECT image_id, i.id % 3 = 1 AND a.updated_at_ms >= coalesce(i.meta_updated_ms, 0) AS valid FROM {adjustments} a JOIN {images} i ON i.id = a.image_id")
both("stm04_change_tracking", """
    SELECT i.id, i.xmp_dirty OR i.rating IS DISTINCT FROM n.rating OR i.pick IS DISTINCT FROM n.pick AS dirty, CASE WHEN i.rating IS DISTINCT FROM n.rating OR i.pick IS DISTINCT FROM n.pick THEN 1700000099999 ELSE i.meta_updated_ms END AS updated_ms
    FROM {images} i JOIN (SELECT image_id, suggested_rating AS rating, suggested_pick AS pick FROM {scores} WHERE image_id % 3 = 0) n ON n.image_id = i.id""")
both("stm06_optimistic_clear", """
    SELECT i.id, CASE WHEN i.meta_updated_ms IS NOT DISTINCT FROM s.seen THEN FALSE ELSE i.xmp_dirty END AS dirty FROM {images} i JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN meta_updated_ms - 1 ELSE meta_updated_ms END AS seen FROM {images} WHERE xmp_dirty) s ON s.id = i.id""")
both("stm09_cursor_moves", """
    SELECT user_id, CAST(greatest(0, least(count(*) FILTER (WHERE event_type <> 'click'), count(*) FILTER (WHERE event_type <> 'click') - count(*) FILTER (WHERE event_type = 'click'))) AS BIGINT) AS place FROM {events} GROUP BY user_id""")
both("stm10_undo_conflicts", """
    SELECT l.batch, l.image_id, CASE WHEN max(l.batch) OVER (PARTITION BY l.image_id) > l.batch THEN 'edited_after' WHEN d.image_id IS NOT NULL THEN 'dependent' ELSE 'undone' END AS outcome FROM (SELECT image_id, image_id % 4 AS batch FROM {adjustments} UNION ALL SELECT image_id, image_id % 3 FROM {adjustments} WHERE neutral) l
    LEFT JOIN (SELECT DISTINCT covered_by AS image_id FROM {selection} WHERE locked) d ON d.image_id = l.image_id""")
both("stm11_snapshot_restore", """
    SELECT i.id, coalesce(s.pick, i.pick) AS pick, coalesce(s.rating, i.rating) AS rating, s.id IS NOT NULL AND (s.pick <> i.pick OR s.rating <> i.rating) AS restored FROM {images} i LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 'unflagged' ELSE pick END AS pick, rating FROM {images} WHERE scene_id % 5 = 0) s ON s.id = i.id""")
both("stm12_run_states", """
    SELECT project_id, CASE WHEN state = 'running' AND NOT worker THEN 'cancelled' ELSE state END AS state FROM (SELECT id AS project_id, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS state, id % 2 = 0 AS worker FROM {projects}) x""")
both("stm13_provenance", """
    SELECT a.image_id, CASE WHEN a.neutral THEN 'undone' WHEN a.updated_at_ms > i.meta_updated_ms THEN 'user_edited' WHEN i.meta_updated_ms IS NULL THEN 'unknown' ELSE 'on_baseline' END AS state FROM {adjustments} a JOIN {images} i ON i.id = a.image_id""")
both("stm16_missing_since", """
    SELECT id, CASE WHEN id % 6 = 0 THEN coalesce(missing_since_ms, 1700000055555) END AS missing_since_ms FROM {images}""")
both("dat06_time_edits", """
    SELECT id, CASE WHEN moved < -2208988800000 OR moved >= 7258118400000 THEN NULL ELSE moved END AS shifted_ms, CASE WHEN camera_make = 'sony' THEN captured_at_ms + 7200000 ELSE captured_at_ms END AS synced_ms
    FROM (SELECT *, captured_at_ms + CASE WHEN id % 50 = 0 THEN 6000000000000 ELSE 3600000 END AS moved FROM {images}) x""")
both("lrn05_folds", """
    SELECT image_id, CAST((dense_rank() OVER (PARTITION BY i.folder_id ORDER BY coalesce(i.scene_id, -1)) - 1) % 5 AS BIGINT) AS fold FROM {adjustments} a JOIN {images} i ON i.id = a.image_id WHERE NOT a.neutral""")
both("lrn10_training_rows", """
    SELECT a.image_id FROM {adjustments} a JOIN {images} i ON i.id = a.image_id WHERE NOT a.neutral AND i.missing_since_ms IS NULL AND coalesce(i.pick_origin, 'user') <> 'auto'""")
both("sta01_smoothing", """
    WITH e AS (SELECT id, scene_id, log2(aperture * aperture / shutter_s) - log2(iso / 100.0E0) AS ev FROM {images} WHERE scene_id IS NOT NULL AND iso > 0 AND shutter_s > 0 AND aperture > 0),
    c AS (SELECT *, sum(cut) OVER (PARTITION BY scene_id ORDER BY ev, id ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN ev - lag(ev) OVER (PARTITION BY scene_id ORDER BY ev, id) <= 1 THEN 0 ELSE 1 END AS cut FROM e) x),
    m AS (SELECT scene_id, cluster, median(ev) AS centre, count(*) AS n FROM c GROUP BY scene_id, cluster)
    SELECT c.id, CASE WHEN m.n >= 2 THEN m.centre + least(greatest(0.5E0 * (c.ev - m.centre), -0.3E0), 0.3E0) ELSE c.ev END AS smoothed FROM c JOIN m ON m.scene_id = c.scene_id AND m.cluster = c.cluster""")
both("sta05_changed_fields", """
    SELECT a.image_id, a.get_exposure <> b.get_exposure AS exposure, a.get_contrast <> b.get_contrast AS contrast, a.get_exposure - b.get_exposure AS delta FROM
      (SELECT image_id, CAST(get_json_object(params_json, '$.exposure') AS BIGINT) AS get_exposure, CAST(get_json_object(params_json, '$.light.contrast') AS BIGINT) AS get_contrast FROM {adjustments}) a
      JOIN (SELECT image_id + 30 AS image_id, CAST(get_json_object(params_json, '$.exposure') AS BIGINT) AS get_exposure, CAST(get_json_object(params_json, '$.light.contrast') AS BIGINT) AS get_contrast FROM {adjustments}) b ON b.image_id = a.image_id""",
    """SELECT a.image_id, a.e <> b.e AS exposure, a.c <> b.c AS contrast, a.e - b.e AS delta FROM (SELECT image_id, CAST(params_json->>'$.exposure' AS BIGINT) AS e, CAST(params_json->>'$.light.contrast' AS BIGINT) AS c FROM {adjustments}) a
       JOIN (SELECT image_id + 30 AS image_id, CAST(params_json->>'$.exposure' AS BIGINT) AS e, CAST(params_json->>'$.light.contrast' AS BIGINT) AS c FROM {adjustments}) b ON b.image_id = a.image_id""")
