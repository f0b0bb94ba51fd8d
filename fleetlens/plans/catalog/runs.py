"""Runs, model stages and dataset files."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import fixtures
from fleetlens.operators import datasets, runs, versions
from fleetlens.operators.ordered import with_history
from fleetlens.plans.catalog.base import ORACLES, query
from fleetlens.session import shared_dir


def run_table(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("experiment"),
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_name"), F.col("o_orderstatus").alias("status"),
    )


def metric_table(spark, sf_dir):
    """A final value per order, and a loss per line of it."""
    final = fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.lit("best/mAP50").alias("key"), F.lit(0).alias("step"),
        F.col("o_totalprice").alias("value"),
    )
    loss = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string"), F.lit("train/loss"), "l_linenumber", "l_extendedprice"
    )
    return final.union(loss)


def param_table(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.inline(F.array(
            F.struct(F.lit("customer").alias("key"), F.col("o_custkey").cast("string").alias("value")),
            F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")),
        )),
    )


@query("compare_runs", """WITH top AS (
  SELECT o_orderkey::VARCHAR AS run_id, 'run-' || o_custkey AS run_name, o_orderstatus AS status, o_totalprice AS value, o_custkey
  FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, run_id LIMIT 5),
loss AS (
  SELECT l_orderkey::VARCHAR AS run_id, max({'s': l_linenumber, 'v': l_extendedprice}).v AS loss
  FROM lineitem WHERE l_orderkey::VARCHAR IN (SELECT run_id FROM top) GROUP BY 1)
SELECT run_id, run_name, status, R4(value) AS value,
  'best/mAP50=' || R4(value)::VARCHAR || CASE WHEN loss IS NULL THEN '' ELSE ';train/loss=' || R4(loss)::VARCHAR END AS metrics,
  'customer=' || o_custkey || ';status=' || status AS params
FROM top LEFT JOIN loss USING (run_id)""")
def compare_runs(spark, sf_dir):
    top = runs.compare_runs(run_table(spark, sf_dir), metric_table(spark, sf_dir), param_table(spark, sf_dir),
                            "1-URGENT", "best/mAP50")

    def text(name, value):
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ";")

    return top.select("run_id", "run_name", "status", F.round("value", 4).alias("value"),
                      text("metrics", lambda v: F.round(v, 4).cast("string")).alias("metrics"),
                      text("params", lambda v: v).alias("params"))


@query("latest_run_metrics", """SELECT l_orderkey::VARCHAR AS run_id, 'train/loss' AS key, max({'s': l_linenumber, 'v': l_extendedprice}).v AS value FROM lineitem GROUP BY 1
UNION ALL SELECT o_orderkey::VARCHAR, 'best/mAP50', o_totalprice FROM orders""")
def latest_run_metrics(spark, sf_dir):
    return runs.latest_metrics(metric_table(spark, sf_dir))


@query("epoch_metrics", """WITH l AS (
  SELECT l_orderkey::VARCHAR AS run_id, l_linenumber AS step, l_extendedprice AS a, CASE WHEN l_discount > 0 THEN l_discount END AS b,
    l_tax AS c, l_quantity AS d FROM lineitem)
SELECT run_id, step, 'train/loss' AS key, a AS value FROM l WHERE a IS NOT NULL
UNION ALL SELECT run_id, step, 'val/loss', b FROM l WHERE b IS NOT NULL
UNION ALL SELECT run_id, step, 'val/mAP50', c FROM l WHERE c IS NOT NULL
UNION ALL SELECT run_id, step, 'custom/quantity', d FROM l WHERE d IS NOT NULL""")
def epoch_metrics(spark, sf_dir):
    wide = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("epoch"),
        F.col("l_extendedprice").alias("train_loss"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("val_loss"),
        F.col("l_tax").alias("val_map50"), F.col("l_quantity").alias("quantity"),
    )
    return runs.epoch_metrics(wide, custom=["quantity"])


@query("run_params", """
SELECT o_orderkey::VARCHAR AS run_id, 'model' AS key, o_orderpriority AS value FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'epochs', (o_custkey % 100)::VARCHAR FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'aug_mosaic', '1.0' FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey::VARCHAR, 'aug_mixup', '0.1' FROM orders WHERE o_orderstatus = 'F'""")
def run_params(spark, sf_dir):
    augmentation = F.create_map(F.lit("mosaic"), F.lit("1.0"), F.lit("mixup"), F.lit("0.1"))
    wide = fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.create_map(F.lit("model"), F.col("o_orderpriority"), F.lit("epochs"), (F.col("o_custkey") % 100).cast("string")).alias("params"),
        F.when(F.col("o_orderstatus") == "F", augmentation).alias("augmentation"),
    )
    return runs.flatten_params(wide)


@query("final_run_metrics", """WITH o AS (SELECT o_orderkey::VARCHAR AS run_id, o_totalprice AS p, o_custkey AS c FROM orders)
SELECT run_id, 'best/mAP50' AS key, R4(p) AS value FROM o
UNION ALL SELECT run_id, 'best/mAP50-95', R4(p / 2) FROM o
UNION ALL SELECT run_id, 'best/epoch', (c % 100)::DOUBLE FROM o
UNION ALL SELECT run_id, 'training_time_seconds', c::DOUBLE FROM o
UNION ALL SELECT run_id, 'training_time_hours', R4(c / 3600e0) FROM o
UNION ALL SELECT run_id, 'model_size_mb', (c % 3)::DOUBLE FROM o WHERE c % 3 <> 0""")
def final_run_metrics(spark, sf_dir):
    o = fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_totalprice").alias("best_map50"),
        (F.col("o_totalprice") / 2).alias("best_map50_95"), (F.col("o_custkey") % 100).alias("best_epoch"),
        F.col("o_custkey").alias("training_time_s"), (F.col("o_custkey") % 3).alias("model_size_mb"),
    )
    return runs.final_metrics(o).withColumn("value", F.round("value", 4))


@query("speed_metrics", """WITH p AS (SELECT p_partkey::VARCHAR AS run_id, p_brand AS mode, p_retailprice AS fps, p_size AS s FROM part)
SELECT run_id, 'speed/' || mode || '/fps' AS key, R4(fps) AS value FROM p
UNION ALL SELECT run_id, 'speed/' || mode || '/latency_ms', R4(1000e0 / fps) FROM p
UNION ALL SELECT run_id, 'speed/' || mode || '/imgsz', s::DOUBLE FROM p""")
def speed_metrics(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("run_id"), F.col("p_brand").alias("mode"), F.col("p_retailprice").alias("fps"),
        (F.lit(1000.0) / F.col("p_retailprice")).alias("latency_ms"), F.col("p_size").alias("imgsz"),
    )
    return runs.speed_metrics(p).withColumn("value", F.round("value", 4))


@query("class_metrics", """
SELECT s_suppkey::VARCHAR AS run_id, 'class/car/ap50' AS key, s_acctbal AS value FROM supplier
UNION ALL SELECT s_suppkey::VARCHAR, 'class/car/count', s_nationkey::DOUBLE FROM supplier
UNION ALL SELECT s_suppkey::VARCHAR, 'class/bus/ap50', s_acctbal * 2 FROM supplier""")
def class_metrics(spark, sf_dir):
    s = fixtures.table(spark, sf_dir, "supplier")
    car = F.create_map(F.lit("ap50"), F.col("s_acctbal"), F.lit("count"), F.col("s_nationkey").cast("double"))
    bus = F.create_map(F.lit("ap50"), F.col("s_acctbal") * 2)
    return runs.class_metrics(s.select(F.col("s_suppkey").cast("string").alias("run_id"),
                                       F.create_map(F.lit("car"), car, F.lit("bus"), bus).alias("class_metrics")))


@query("dataset_info", """SELECT n_name AS name, n_nationkey * 3 + 3::BIGINT AS total_images, (CASE WHEN n_regionkey > 1 THEN 2 ELSE 1 END)::BIGINT AS num_classes FROM nation""")
def dataset_info(spark, sf_dir):
    n = fixtures.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")
    classes = F.when(F.col("n_regionkey") > 1, F.create_map(F.lit("car"), key, F.lit("bus"), key)).otherwise(F.create_map(F.lit("car"), key))
    info = runs.dataset_info(n.select(F.col("n_name").alias("name"), key.alias("train_images"), (key + 1).alias("val_images"),
                                      (key + 2).alias("test_images"), classes.alias("class_distribution")))
    return info.select("name", "total_images", "num_classes")


# Requests in order: one or none a version; then, newest version first, a second one for some (a rollback
# for the older ones); and the first of all repeated.
VERSIONS = """
ver AS (
  SELECT p_brand AS model_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version, p_size FROM part),
ask AS (
  SELECT model_name, version, CASE p_size % 3 WHEN 0 THEN 'Staging' ELSE 'Production' END AS stage, version AS asked_at
  FROM ver WHERE p_size % 3 < 2
  UNION ALL SELECT model_name, version, CASE p_size % 3 WHEN 0 THEN 'Staging' ELSE 'Production' END, version - 1000000
  FROM ver WHERE p_size % 3 < 2
  UNION ALL SELECT model_name, version, CASE p_size % 2 WHEN 0 THEN 'Production' ELSE 'None' END, 1000000 - version
  FROM ver WHERE p_size % 10 = 4 OR p_size % 10 = 7),
stepped AS (
  SELECT v.model_name, v.version, arg_max(a.stage, a.asked_at) AS stage,
    max(CASE WHEN a.stage = 'Production' THEN a.asked_at END) AS up_at FROM ver v LEFT JOIN ask a USING (model_name, version) GROUP BY ALL),
final AS (
  SELECT model_name, version, CASE WHEN stage = 'Production' AND up_at < max(up_at) OVER (PARTITION BY model_name) THEN 'Archived'
    ELSE coalesce(stage, 'None') END AS stage FROM stepped)"""


def promoted(spark, sf_dir):
    numbered = with_history(
        fixtures.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_partkey",
        position="version", width=100_000,
    )
    versions = numbered.select(F.col("p_brand").alias("model_name"), "version", F.lit("None").alias("stage"), "p_size")
    size = F.col("p_size")
    once = versions.filter(size % 3 < 2).select(
        "model_name", "version", F.when(size % 3 == 0, "Staging").otherwise("Production").alias("stage"),
        F.col("version").alias("asked_at"))
    again = versions.filter((size % 10).isin(4, 7)).select(
        "model_name", "version", F.when(size % 2 == 0, "Production").otherwise("None").alias("stage"),
        (1_000_000 - F.col("version")).alias("asked_at"))
    repeated = once.withColumn("asked_at", F.col("asked_at") - 1_000_000)
    return runs.promote(versions.drop("p_size"), once.unionByName(repeated).unionByName(again))


@query("model_stages", f"WITH {VERSIONS} SELECT model_name, version, stage FROM final")
def model_stages(spark, sf_dir):
    return promoted(spark, sf_dir)


@query("production_models", f"""WITH {VERSIONS}
SELECT model_name, max(CASE WHEN stage = 'Production' THEN version END) AS production_version,
  CASE WHEN bool_or(stage = 'Production') THEN 'models:/' || model_name || '/Production' END AS uri FROM final GROUP BY model_name""")
def production_models(spark, sf_dir):
    return runs.production(promoted(spark, sf_dir))


FILES = """
files AS (
  SELECT source || '/' || lang || '/' || doc_id || '.' || CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS path,
    doc_id, n_chars AS length, md5(text) AS md5 FROM documents)"""


def files(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    return d.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"),
        "doc_id", F.col("n_chars").alias("length"), F.encode("text", "UTF-8").alias("content"),
    )


@query("file_hashes", f"WITH {FILES} SELECT path, length, md5 FROM files")
def file_hashes(spark, sf_dir):
    return datasets.file_hashes(files(spark, sf_dir)).select("path", "length", "md5")


@query("dataset_stats", f"""WITH {FILES},
e AS (SELECT '.' || lower(split_part(path, '.', -1)) AS ext, count(*) AS n, sum(length) AS b FROM files GROUP BY 1)
SELECT sum(n)::BIGINT AS total_files, R2(sum(b) / 1048576e0) AS total_size_mb, string_agg(ext || '=' || n, ';' ORDER BY ext) AS file_types FROM e""")
def dataset_stats(spark, sf_dir):
    s = datasets.dataset_stats(files(spark, sf_dir))
    entries = F.transform(F.map_entries("file_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.withColumn("file_types", F.array_join(entries, ";"))


@query("extension_counts", f"WITH {FILES} SELECT '.' || lower(split_part(path, '.', -1)) AS ext, count(*) AS n_files, sum(length)::BIGINT AS bytes FROM files GROUP BY 1")
def extension_counts(spark, sf_dir):
    return datasets.extension_counts(files(spark, sf_dir))


@query("subdirectories", "SELECT DISTINCT source AS directory FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents")
def subdirectories(spark, sf_dir):
    return datasets.subdirectories(files(spark, sf_dir))


@query("dataset_version", f"""WITH {FILES},
g AS (SELECT left(md5(path), 3) AS g, md5(string_agg(path || ':' || md5, chr(10) ORDER BY path || ':' || md5)) AS h FROM files GROUP BY 1)
SELECT md5(string_agg(g || ':' || h, chr(10) ORDER BY g || ':' || h)) AS version FROM g""")
def dataset_version(spark, sf_dir):
    return datasets.dataset_version(datasets.file_hashes(files(spark, sf_dir)))


@query("dataset_diff", f"""WITH {FILES},
n AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN md5(md5) ELSE md5 END AS md5 FROM files WHERE doc_id % 13 <> 0
  UNION ALL SELECT 'new/' || path, md5 FROM files WHERE doc_id % 17 = 0)
SELECT coalesce(files.path, n.path) AS path, CASE WHEN files.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
  files.md5 AS old_md5, n.md5 AS new_md5
FROM files FULL JOIN n ON files.path = n.path WHERE files.md5 IS DISTINCT FROM n.md5""")
def dataset_diff(spark, sf_dir):
    old = datasets.file_hashes(files(spark, sf_dir))
    edited = F.when(F.col("doc_id") % 11 == 0, F.md5("md5")).otherwise(F.col("md5"))
    new = old.filter("doc_id % 13 <> 0").withColumn("md5", edited).unionByName(
        old.filter("doc_id % 17 = 0").withColumn("path", F.concat(F.lit("new/"), "path"))
    )
    return datasets.version_diff(old, new)


_DIFF = ORACLES["dataset_diff"]


def edited_files(spark, sf_dir):
    """The files as they are, and after some were edited, removed and added."""
    old = datasets.file_hashes(files(spark, sf_dir)).withColumn("modified_us", F.lit(0).cast("bigint"))
    edited = F.when(F.col("doc_id") % 11 == 0, F.md5("md5")).otherwise(F.col("md5"))
    new = old.filter("doc_id % 13 <> 0").withColumn("md5", edited).unionByName(
        old.filter("doc_id % 17 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))
    return [df.select("path", "length", "modified_us", "md5") for df in (old, new)]


@query("dataset_diff_by_tree", _DIFF)
def dataset_diff_by_tree(spark, sf_dir):
    targets = [shared_dir(spark, "version") for _ in range(2)]
    for manifest, target in zip(edited_files(spark, sf_dir), targets):
        versions.save_version(manifest, target)
    return versions.diff(spark, *targets)


@query("dataset_tree", f"""WITH {FILES},
leaf AS (SELECT left(md5(path), 2) AS prefix, md5(string_agg(path || ':' || md5, chr(10) ORDER BY path || ':' || md5)) AS hash, count(*) AS n
  FROM files GROUP BY 1),
node AS (SELECT left(prefix, 1) AS prefix, md5(string_agg(prefix || ':' || hash, chr(10) ORDER BY prefix || ':' || hash)) AS hash, sum(n)::BIGINT AS n
  FROM leaf GROUP BY 1)
SELECT 2::INT AS level, * FROM leaf UNION ALL SELECT 1, * FROM node
UNION ALL SELECT 0, '', md5(string_agg(prefix || ':' || hash, chr(10) ORDER BY prefix || ':' || hash)), sum(n)::BIGINT FROM node""")
def dataset_tree(spark, sf_dir):
    return versions.tree(datasets.file_hashes(files(spark, sf_dir)), 2)


@query("split_assignment", """SELECT doc_id, CASE WHEN b < 800 THEN 'train' WHEN b < 950 THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 1000 AS b FROM documents)""")
def split_assignment(spark, sf_dir):
    return datasets.assign_split(fixtures.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query("kept_classes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'car' ELSE 'bus' END AS class_name FROM events WHERE event_id % 4 IN (0, 2)")
def kept_classes(spark, sf_dir):
    name = F.get(F.array(*[F.lit(c) for c in ("car", "others", "bus", "occluded")]), (F.col("event_id") % 4).cast("int"))
    return datasets.without_ignored(fixtures.table(spark, sf_dir, "events").select("event_id", name.alias("class_name")))


def tree(spark, sf_dir):
    """Images and labels of the documents; some of either are missing."""
    d = fixtures.table(spark, sf_dir, "documents").select("doc_id", "source")
    images = d.filter("doc_id % 7 <> 0").select(F.concat("source", F.lit("/images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    labels = d.filter("doc_id % 5 <> 0").select(F.concat("source", F.lit("/labels/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    notes = d.filter("doc_id % 9 = 0").select(F.concat("source", F.lit("/labels/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return datasets.image_label_files(images.union(labels).union(notes))


@query("image_label_listing", """SELECT source AS split, 'image' AS kind, doc_id::VARCHAR AS stem FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT source, 'label', doc_id::VARCHAR FROM documents WHERE doc_id % 5 <> 0""")
def image_label_listing(spark, sf_dir):
    return tree(spark, sf_dir).select("split", "kind", "stem")


@query("split_counts", "SELECT source AS split, count(*) FILTER (doc_id % 7 <> 0) AS images, count(*) FILTER (doc_id % 5 <> 0) AS labels FROM documents GROUP BY source")
def split_counts(spark, sf_dir):
    return datasets.split_counts(tree(spark, sf_dir))


@query("image_label_pairs", """SELECT source AS split, doc_id::VARCHAR AS stem, CASE WHEN doc_id % 7 <> 0 THEN source || '/images/' || doc_id || '.jpg' END AS image,
  CASE WHEN doc_id % 5 <> 0 THEN source || '/labels/' || doc_id || '.txt' END AS label FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0""")
def image_label_pairs(spark, sf_dir):
    return datasets.pair_labels(tree(spark, sf_dir))


@query("missing_labels", "SELECT source AS split, doc_id::VARCHAR AS stem FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0")
def missing_labels(spark, sf_dir):
    return datasets.missing_labels(tree(spark, sf_dir)).select("split", "stem")
