"""Queries of the raster, protection and edit-log families."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.operators import editlog as I
from pageframe.operators import protect as G
from pageframe.operators import raster as R
from pageframe.plans import derive as D
from pageframe.plans.registry import query
from pageframe.sources.shared import small_batches

#: Images that Python gets at a time.
IMAGES = 64
_PART = "SELECT p_partkey AS asset_id, p_size * 1000 AS bytes, p_size * 7 AS width_px, p_size * 3 AS height_px FROM part"
_VARIANTS = "v AS (SELECT p_partkey AS asset_id, i / 16 AS t, (p_size * 1000 * (1.05 - i / 20.0))::BIGINT AS bytes FROM part, (SELECT unnest(range(17)) AS i)), a AS (SELECT p_partkey AS asset_id, p_size * 1000 AS bytes, 9000 AS budget FROM part)"


def assets(spark, sf):
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") * 1000).cast("long").alias("bytes"), (F.col("p_size") * 70).alias("width_px"), (F.col("p_size") * 50).alias("height_px"))


def spread(rows, key):
    """Rows dealt by a key before each becomes many: a table in one small file is one task, and would stay in it."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64), key)


def variants(spark, sf):
    """Seventeen variants of every part, smaller step by step."""
    i = F.explode(F.sequence(F.lit(0), F.lit(16)))
    return spread(assets(spark, sf), "asset_id").select("asset_id", F.col("bytes").alias("b"), i.alias("i")).select("asset_id", (F.col("i") / 16).alias("t"), (F.col("i") + 1).alias("step"), F.expr("cast(round(b * (1.05 - i / 20.0D)) as bigint)").alias("bytes"))


def pixels(spark, sf):
    """Documents as one-channel images: white pixels by id, then the bytes of the text; no text is no pixel more. Python gets few at a time."""
    spark = small_batches(spark, IMAGES)
    white = F.unhex(F.expr("repeat('FF', cast(doc_id % 3 * 40000 as int))"))
    return D.table(spark, sf, "documents").select("doc_id", F.concat(white, F.coalesce("text", F.lit("")).cast("binary")).alias("data"), F.lit(1).alias("nChannels"))


_BYTES = "WITH px AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, doc_id % 3 * 40000 AS white FROM documents)"


@query("f2_invert", _BYTES + " SELECT doc_id, white + len(h) // 2 AS n_bytes, sha256(unhex(repeat('00', white::INTEGER) || translate(h, '0123456789ABCDEF', 'FEDCBA9876543210'))) AS inverted FROM px")
def invert(spark, sf):
    return R.invert(pixels(spark, sf)).select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("inverted"))


@query(
    "f3_ink_ratio",
    _BYTES + """, k AS (SELECT doc_id, h, white + len(h) // 2 AS n, len(list_filter(range(len(h) // 2), lambda i: substr(h, 2 * i + 1, 2) < 'F5')) AS dark FROM px)
SELECT doc_id, n AS n_bytes, CASE WHEN n > 0 THEN round(dark / n, 9) END AS ink, n > 0 AND coalesce(dark / nullif(n, 0) < 0.004, false) AS is_blank FROM k""",
)
def ink(spark, sf):
    return R.ink_ratio(pixels(spark, sf)).select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.round("ink", 9).alias("ink"), "is_blank")


@query(
    "f5_target_dims",
    """WITH i AS (SELECT p_partkey AS asset_id, p_size * 70 AS w, p_size * 50 AS h FROM part), s AS (SELECT *, least(w, h) >= 900 AND greatest(w, h) / least(w, h) > 1.2 AND greatest(w, h) / least(w, h) < 1.75 AS is_scan FROM i),
c AS (SELECT *, least(1, CASE WHEN is_scan THEN 2800 ELSE 1200 END / greatest(w, h)) AS k FROM s)
SELECT asset_id, is_scan, greatest(1, floor(w * k + 0.5))::BIGINT AS new_w, greatest(1, floor(h * k + 0.5))::BIGINT AS new_h FROM c""",
)
def dims(spark, sf):
    return R.target_dims(assets(spark, sf), 1200).select("asset_id", "is_scan", "new_w", "new_h")


@query(
    "f6_recompressible",
    "SELECT p_partkey AS asset_id, p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 2 AND p_size * 700 * p_size * 500 <= 30000000 AND p_partkey % 7 <> 3 AS may_recode FROM part",
)
def recompressible(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    i = D.table(spark, sf, "part").select(
        k.alias("asset_id"), F.lit("Image").alias("subtype"), F.when(s % 2 == 0, "DCTDecode").otherwise("JPXDecode").alias("filter"), (k % 5 == 0).alias("soft_mask"), F.when(k % 3 == 0, "DeviceRGB").when(k % 3 == 1, "ICCBased").otherwise("Indexed").alias("color_space"),
        F.lit(3).alias("components"), F.lit(8).alias("bits"), (s * 700).alias("width_px"), (s * 500).alias("height_px"), F.when(k % 7 == 3, 2).when(k % 7 == 4, 12).alias("predictor"),
    )
    return R.recompressible(i).select("asset_id", "may_recode")


_V = """WITH v AS (SELECT p_partkey AS asset_id, i / 16 AS t, i + 1 AS step, round(p_size * 1000 * (1.05::DOUBLE - i / 20.0::DOUBLE))::BIGINT AS bytes FROM part, (SELECT unnest(range(17)) AS i)), a AS (SELECT p_partkey AS asset_id, p_size * 1000 AS own FROM part),
f AS (SELECT asset_id, arg_min(bytes, t) AS bytes, min(t) AS t, min(step) AS step FROM v WHERE bytes <= 9000 GROUP BY asset_id), l AS (SELECT asset_id, min(bytes) AS bytes, arg_min(t, bytes) AS t, arg_min(step, bytes) AS step FROM v GROUP BY asset_id)"""


@query("f7_choose_variant", _V + " SELECT a.asset_id, CASE WHEN own > 9000 THEN coalesce(f.t, l.t) END AS t, CASE WHEN own <= 9000 THEN own ELSE coalesce(f.bytes, l.bytes) END AS out_bytes, own <= 9000 OR f.t IS NOT NULL AS achieved FROM a JOIN l USING (asset_id) LEFT JOIN f USING (asset_id)")
def choose(spark, sf):
    return R.choose_variant(assets(spark, sf), variants(spark, sf), F.lit(9000))


_TRIES = """WITH l AS (SELECT unnest(range(1, 11)) AS step, unnest([0.85, 0.75, 0.65, 0.55, 0.45, 0.35, 0.25, 0.7, 0.6, 0.5]::DOUBLE[]) AS q, unnest([1, 1, 1, 1, 1, 1, 1, 0.85, 0.85, 0.85]::DOUBLE[]) AS k),
v AS (SELECT p_partkey AS asset_id, p_size * 1000 AS own, step, floor(p_size * 1300 * q * k * k + p_partkey % 7 * step * 90)::BIGINT AS bytes FROM part, l),
f AS (SELECT asset_id, arg_min(bytes, step) AS bytes, min(step) AS step FROM v WHERE bytes <= 9000 GROUP BY asset_id), s AS (SELECT asset_id, any_value(own) AS own, min(row(bytes, step)) AS x FROM v GROUP BY asset_id)"""


@query("f8_ladder_choice", _TRIES + " SELECT asset_id, CASE WHEN b < own THEN step END AS step, CASE WHEN b < own THEN b ELSE own END AS out_bytes FROM (SELECT asset_id, own, coalesce(f.bytes, x[1]) AS b, coalesce(f.step, x[2]) AS step FROM s LEFT JOIN f USING (asset_id))")
def ladder(spark, sf):
    """Every part tried at each step of the ladder; sizes follow quality and scale, with a part of their own that grows from step to step."""
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(q).alias("q"), F.lit(k).alias("k")) for i, (q, k) in enumerate(R.LADDER)])
    tried = spread(D.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "p_size", F.inline(steps))
    size = F.floor(F.col("p_size") * 1300 * F.col("q") * F.col("k") * F.col("k") + F.col("p_partkey") % 7 * F.col("step") * 90)
    return R.ladder_choice(assets(spark, sf), tried.select(F.col("p_partkey").alias("asset_id"), "step", size.cast("long").alias("bytes")), F.lit(9000))


_OUT = "WITH o AS (SELECT p_partkey AS asset_id, p_brand AS brand, p_size * 1000 AS bytes, p_size * 1000 - (p_partkey % 13 - 2) * p_size * 10 AS out_bytes FROM part), k AS (SELECT *, out_bytes >= bytes OR (bytes - out_bytes) / bytes < 0.04 AS orig FROM o)"


def outputs(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    return D.table(spark, sf, "part").select(p.alias("asset_id"), F.col("p_brand").alias("brand"), (s * 1000).alias("bytes"), (s * 1000 - (p % 13 - 2) * s * 10).alias("out_bytes"))


@query("f9_savings_rule", _OUT + " SELECT asset_id, CASE WHEN orig THEN 'original' ELSE 'output' END AS kept, CASE WHEN orig THEN bytes ELSE out_bytes END AS out_bytes FROM k")
def savings_rule(spark, sf):
    return R.apply_savings_rule(outputs(spark, sf)).select("asset_id", "kept", "out_bytes")


@query("f10_savings_report", _OUT + " SELECT brand, sum(bytes)::BIGINT AS before, sum(CASE WHEN orig THEN bytes ELSE out_bytes END)::BIGINT AS after, floor((sum(bytes) - sum(CASE WHEN orig THEN bytes ELSE out_bytes END)) / sum(bytes) * 100 + 0.5)::BIGINT AS percent FROM k GROUP BY ROLLUP (brand)")
def report(spark, sf):
    return R.savings_report(R.apply_savings_rule(outputs(spark, sf)), "brand")


@query("f11_images_to_pages", "SELECT p_partkey AS doc_id, 0 AS image_no, (p_size * 70)::DOUBLE AS width_pt, (p_size * 50)::DOUBLE AS height_pt FROM part WHERE p_partkey % 6 <> 1 AND p_size > 0")
def to_pages(spark, sf):
    i = assets(spark, sf).select(F.col("asset_id").alias("doc_id"), F.lit(0).alias("image_no"), F.when(F.col("asset_id") % 6 != 1, F.col("width_px")).alias("width_px"), "height_px")
    return R.images_to_pages(i).drop("rotation")


KEY = "0123456789abcdef"


@query("g1_protect_unlock", "SELECT doc_id, CASE WHEN doc_id % 7 <> 1 THEN sha256(t) END AS opened, t IS NOT NULL AS sealed_ok, CASE WHEN doc_id % 7 = 1 THEN sha256(t) END AS wrong FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN coalesce(text, '') END AS t FROM documents)")
def protect(spark, sf):
    """Texts of which every tenth is missing, and every seventh is sealed with another key."""
    other = F.lit(KEY[::-1])
    text = F.when(F.col("doc_id") % 10 != 3, F.coalesce("text", F.lit("")))
    sealed = G.protect(D.table(spark, sf, "documents").select("doc_id", text.alias("text")), "text", F.lit(KEY))
    sealed = sealed.withColumn("sealed", F.when(F.col("doc_id") % 7 == 1, F.aes_encrypt("text", other)).otherwise(F.col("sealed")))
    opened = G.unlock(sealed, F.lit(KEY)).withColumn("wrong", F.try_aes_decrypt("sealed", other).cast("string"))
    return opened.select("doc_id", F.sha2("opened", 256).alias("opened"), F.col("sealed").isNotNull().alias("sealed_ok"), F.sha2("wrong", 256).alias("wrong"))


@query("g2_permission_bits", "SELECT p_partkey, (-4 - CASE WHEN p_partkey % 2 = 1 THEN 0 ELSE 4 END - CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 8 END - CASE WHEN p_partkey % 5 = 1 THEN 0 ELSE 16 END - CASE WHEN p_partkey % 7 = 1 THEN 0 ELSE 32 END)::INTEGER AS bits FROM part")
def bits(spark, sf):
    k = F.col("p_partkey")
    return D.table(spark, sf, "part").select("p_partkey", G.permission_bits(k % 2 == 1, k % 3 == 1, k % 5 == 1, k % 7 == 1).alias("bits"))


@query("g3_triage", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'needs-password' ELSE 'unreadable' END AS access FROM documents")
def triage(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sealed = F.when(F.col("doc_id") % 3 == 1, F.aes_encrypt("text", F.lit(KEY))).when(F.col("doc_id") % 3 == 2, F.col("text").cast("binary"))
    return G.triage(d.withColumn("sealed", sealed), F.lit(KEY)).select("doc_id", "access")


@query("g4_recover", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_brand END AS value, p_partkey % 3 + 1 AS tier FROM part")
def recover(spark, sf):
    whole = F.to_json(F.struct(F.col("p_brand").alias("brand"), "p_size"))
    text = F.when(F.col("p_partkey") % 3 == 0, whole).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{broken '), whole)).otherwise("no json")
    return G.recover(D.table(spark, sf, "part").withColumn("text", text), "text", "brand").select("p_partkey", "value", "tier")


def replay_sql(seq: str) -> str:
    """The edit log replayed by recursion, with the given number for each edit: ``i`` from 1, or ``seq``."""
    return """WITH RECURSIVE log AS (SELECT user_id AS doc_id, event_id AS seq, ['commit', 'undo', 'commit', 'redo', 'commit', 'undo', 'commit', 'commit', 'load', 'commit'][event_id % 10 + 1] AS op, 'v' || event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::VARCHAR AS value, []::VARCHAR[] AS u, []::VARCHAR[] AS r FROM (SELECT DISTINCT doc_id FROM log)
UNION ALL SELECT l.doc_id, l.i, l.seq, CASE WHEN op IN ('commit', 'load') THEN l.value WHEN op = 'undo' AND len(u) > 0 THEN u[-1] WHEN op = 'redo' AND len(r) > 0 THEN r[-1] ELSE f.value END,
  CASE WHEN op = 'load' THEN [] WHEN op = 'commit' OR op = 'redo' AND len(r) > 0 THEN list_append(u, f.value)[-50:] WHEN op = 'undo' AND len(u) > 0 THEN u[:-2] ELSE u END,
  CASE WHEN op IN ('load', 'commit') THEN [] WHEN op = 'undo' AND len(u) > 0 THEN list_append(r, f.value)[-50:] WHEN op = 'redo' AND len(r) > 0 THEN r[:-2] ELSE r END
FROM f JOIN log l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, SEQ AS seq, value, len(u) AS n_undo, len(r) AS n_redo FROM f WHERE i > 0""".replace("SEQ", seq)


@query("i1_replay_edits", replay_sql("seq"))
def replay(spark, sf):
    return I.replay_edits(D.edit_log(spark, sf))


@query("i1_replay_one_log", replay_sql("seq").replace("user_id AS doc_id", "event_id // 100000 AS doc_id").replace("PARTITION BY user_id", "PARTITION BY event_id // 100000"))
def replay_one(spark, sf):
    """All events as edits of one document for each hundred thousand, replayed in ranges."""
    log = D.edit_log(spark, sf).withColumn("doc_id", F.floor(F.col("seq") / 100000))
    return I.replay_in_ranges(log)


_OBJ = "WITH log AS (SELECT user_id AS doc_id, 'o' || event_id % 7 AS object_id, event_id AS seq, CASE WHEN event_id % 10 < 4 THEN 'add' WHEN event_id % 10 < 9 THEN 'patch' ELSE 'delete' END AS op, 'f' || event_id % 3 AS field, event_id::VARCHAR AS value FROM events)"


def object_log(spark, sf):
    k = F.col("event_id")
    return D.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.concat(F.lit("o"), (k % 7).cast("string")).alias("object_id"), k.alias("seq"), F.when(k % 10 < 4, "add").when(k % 10 < 9, "patch").otherwise("delete").alias("op"),
        F.create_map(F.concat(F.lit("f"), (k % 3).cast("string")), k.cast("string")).alias("data"),
    )


@query(
    "i2_current_objects",
    _OBJ + """, s AS (SELECT *, max(CASE WHEN op = 'add' THEN seq END) OVER w AS added, max(CASE WHEN op = 'delete' THEN seq END) OVER w AS gone FROM log WINDOW w AS (PARTITION BY doc_id, object_id))
SELECT doc_id, object_id, field, arg_max(value, seq) AS value FROM s WHERE added IS NOT NULL AND (gone IS NULL OR gone < added) AND seq >= added AND op <> 'delete' GROUP BY doc_id, object_id, field""",
)
def objects(spark, sf):
    return I.current_objects(object_log(spark, sf)).select("doc_id", "object_id", F.explode("data").alias("field", "value"))


@query("i2_next_id", _OBJ + " SELECT doc_id, max(object_id[2:]::BIGINT) + 1 AS next_id FROM log GROUP BY doc_id")
def next_id(spark, sf):
    return I.next_id(object_log(spark, sf))


@query("i3_latest_per_key", _OBJ + " SELECT doc_id, object_id, max(seq) AS seq, arg_max(op, seq) AS op FROM log GROUP BY doc_id, object_id")
def latest(spark, sf):
    return I.latest_per_key(object_log(spark, sf).drop("data"), ["doc_id", "object_id"], "seq")
