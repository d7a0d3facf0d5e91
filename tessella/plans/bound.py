"""Operators bound to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import colors, jsonx, text, values
from tessella.operators import arrays, changes, images, jobs, lookups, rules, summaries, tables, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bound(sql: str | None = None):
    """Registers a query under its function name, with its SQL if it has one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def renamed(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


# jobs. orders as jobs: status O pending, P running, F completed; the total price as duration


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return renamed(read(spark, sf_dir, "orders"), id="o_orderkey", type="o_orderpriority", status=status, duration_ms="o_totalprice", created_at="o_orderdate", priority=F.lit(5), customer="o_custkey")


_JOBS = """SELECT o_orderkey AS id, o_orderpriority AS type, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
o_totalprice AS duration_ms, o_orderdate AS created_at, o_custkey AS customer FROM orders"""


@bound(f"""WITH j AS ({_JOBS}) SELECT type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
0::BIGINT AS failed, 0::BIGINT AS awaiting_validation, CAST(round_even(avg(duration_ms) FILTER (status = 'completed'), 0) AS BIGINT) AS avg_duration FROM j GROUP BY type""")
def job_stats(spark, sf_dir):
    return jobs.stats(order_jobs(spark, sf_dir))


@bound("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000 AND o_totalprice <= 400000
AND o_orderpriority IS NOT NULL AND o_orderpriority <> '' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""")
def job_list_page(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    found = tables.where(o, among={"o_orderstatus": ["O", "F"]}, at_least={"o_totalprice": 1000}, at_most={"o_totalprice": 400000}, blank={"o_orderpriority": False})
    return tables.page(tables.ordered(found, "o_totalprice", "desc", ("o_orderkey", "o_totalprice"), "o_orderkey"), 3, 20)


@bound("""SELECT count(*) AS total FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000 AND o_totalprice <= 400000""")
def job_list_total(spark, sf_dir):
    found = tables.where(read(spark, sf_dir, "orders"), among={"o_orderstatus": ["O", "F"]}, at_least={"o_totalprice": 1000}, at_most={"o_totalprice": 400000})
    return found.agg(F.count("*").alias("total"))


@bound("""SELECT v.value, count(o_orderkey) AS n FROM (VALUES ('O'), ('P'), ('F'), ('X')) v(value) LEFT JOIN orders ON o_orderstatus = v.value GROUP BY v.value""")
def status_histogram(spark, sf_dir):
    return jobs.histogram(read(spark, sf_dir, "orders"), "o_orderstatus", ["O", "P", "F", "X"])


_EVENTS = "SELECT event_id, event_type, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"


def event_rows(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@bound(f"""WITH e AS ({_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k, ts, event_id) AS rank FROM e)
SELECT event_id, event_type, k, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def queue_claim(spark, sf_dir):
    cols = jobs.JobCols(id="event_id", type="event_type", created="ts", priority="k")
    return jobs.claim(event_rows(spark, sf_dir), F.lit(5), cols).select("event_id", "event_type", "k", "rank")


@bound(f"""WITH j AS ({_JOBS}), c(type, max_concurrent) AS (VALUES ('1-URGENT', 500), ('2-HIGH', NULL), ('nothing', 0)),
r AS (SELECT type, count(*) FILTER (status = 'running') AS running FROM j GROUP BY type)
SELECT c.type, CAST(greatest(coalesce(c.max_concurrent, 1), 1) AS INT) AS max_concurrent, coalesce(running, 0) AS running,
CAST(greatest(greatest(coalesce(c.max_concurrent, 1), 1) - coalesce(running, 0), 0) AS BIGINT) AS free FROM c LEFT JOIN r USING (type)""")
def queue_gate(spark, sf_dir):
    config = spark.sql("SELECT * FROM VALUES ('1-URGENT', 500), ('2-HIGH', NULL), ('nothing', 0) AS t(type, max_concurrent)")
    return jobs.free_slots(order_jobs(spark, sf_dir), config)


@bound("""WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id), m AS (SELECT max(ts) AS top FROM events)
SELECT user_id, CASE WHEN last_ts < top - INTERVAL 5 MINUTE THEN 'pending' ELSE 'running' END AS status FROM l, m""")
def stale_recovery(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("beat")).withColumn("status", F.lit("running"))
    top = e.agg(F.max("ts").alias("top"))  # one row
    joined = last.join(F.broadcast(top), F.lit(True), "left")
    return jobs.recover_stale(joined, "beat", F.col("top"), 5).select("user_id", "status")


@bound(f"""WITH e AS ({_EVENTS}) SELECT event_id, CASE WHEN k % 4 < 3 THEN 'pending' ELSE 'failed' END AS next_status,
CASE WHEN k % 4 < 3 THEN strftime(ts + to_seconds(CASE k % 4 WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 900 END), '%Y-%m-%d %H:%M:%S') END AS run_at,
CAST(k % 4 + CASE WHEN k % 4 < 3 THEN 1 ELSE 0 END AS INT) AS next_retry FROM e WHERE k IS NOT NULL""")
def retry_plan(spark, sf_dir):
    e = event_rows(spark, sf_dir).filter("k is not null").withColumn("retry", F.col("k") % 4)
    planned = jobs.plan_retry(e, "retry", 3, "ts")
    return planned.select("event_id", "next_status", F.date_format("scheduled_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"), "next_retry")


@bound(f"""WITH j AS ({_JOBS}) SELECT type, count(*) AS n FROM j WHERE NOT (status = 'completed' AND created_at < TIMESTAMP '1997-01-01') GROUP BY type""")
def retention_purge(spark, sf_dir):
    left = jobs.purge(order_jobs(spark, sf_dir), "status", "created_at", F.lit("1997-01-01").cast("timestamp_ntz"))
    return left.groupBy("type").agg(F.count("*").alias("n"))


@bound("""SELECT DISTINCT o_custkey FROM orders a WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P' AND b.o_orderkey % 3 = 0)""")
def followup_enqueue(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return jobs.followups(o.filter("o_orderstatus = 'F'").select("o_custkey").distinct(), o.filter("o_orderstatus = 'P' and o_orderkey % 3 = 0"), ["o_custkey"])


@bound("""SELECT user_id, arg_max(value, (ts, event_id)) AS progress, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY user_id""")
def progress_latest(spark, sf_dir):
    p = jobs.latest_progress(read(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id")
    return p.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@bound("""SELECT CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey % 7 = 0 THEN 'cancelled' ELSE o_orderstatus END AS status, count(*) AS n,
CAST(sum(CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM orders GROUP BY 1""")
def bulk_cancel(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    done = jobs.set_status(o, o.filter("o_custkey % 7 = 0"), "o_orderkey", "o_orderstatus", ("O", "P"), "cancelled")
    return done.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("int")).alias("changed"))


# joins and counts


@bound("""SELECT p_partkey AS id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS lines, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p_partkey) AS orders FROM part""")
def term_counts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    keys = renamed(read(spark, sf_dir, "part"), id="p_partkey")
    return tables.counts_by_key(keys, "id", lines=(li, "l_partkey"), orders=(li.distinct(), "l_partkey"))


@bound("""SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n, CAST(sum(c) AS BIGINT) AS customers FROM
(SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def tag_lookup(spark, sf_dir):
    per = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    n = read(spark, sf_dir, "nation").join(per, "n_nationkey", "left").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"), F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"))


@bound("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR) AND l.quality = 1""")
def review_queue(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("key"))
    lab = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("key"), "quality", "toxic")
    return d.join(lab, "key", "left").select("doc_id", "source", "quality", "toxic")


@bound("""SELECT doc_id, source, quality, toxic, n_chars FROM documents LEFT JOIN (SELECT doc_id AS i, quality, toxic FROM labels) ON i = doc_id ORDER BY quality DESC NULLS LAST, n_chars DESC, doc_id LIMIT 25 OFFSET 25""")
def review_page(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return tables.page(d.orderBy(F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id"), 2, 25).select("doc_id", "source", "quality", "toxic", "n_chars")


@bound("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def batch_term_count(spark, sf_dir):
    return tables.counts_by_key(read(spark, sf_dir, "customer"), "c_custkey", n=(read(spark, sf_dir, "orders"), "o_custkey"))


@bound("""SELECT count(*) AS examined, count(*) FILTER (have) AS already_present, count(*) FILTER (NOT have) AS inserted FROM
(SELECT l_partkey, l_suppkey, bool_or(l_linenumber = 1) AS have FROM lineitem GROUP BY ALL)""")
def derived_tags_backfill(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    wanted = li.select("l_partkey", "l_suppkey").distinct()
    missing = changes.missing_rows(wanted, li.filter("l_linenumber = 1"), ["l_partkey", "l_suppkey"]).withColumn("new", F.lit(True))
    flagged = wanted.join(missing, ["l_partkey", "l_suppkey"], "left")
    return flagged.agg(F.count("*").alias("examined"), F.count_if(F.col("new").isNull()).alias("already_present"), F.count_if(F.col("new")).alias("inserted"))


@bound("""SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%bl_e%' OR lower(p_brand) LIKE '%bl_e%' OR lower(p_type) LIKE '%bl_e%' ORDER BY p_partkey LIMIT 50""")
def term_search(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.filter(values.matches_any("BL_E", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).orderBy("p_partkey").limit(50).select("p_partkey")


# row choice


@bound("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def latest_per_entity(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.best(o, ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@bound("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 10 = 0) DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def pinned_else_latest(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.best(o, ["o_custkey"], F.desc(F.col("o_orderkey") % 10 == 0), F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@bound("""SELECT source, doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, n_chars DESC, doc_id) AS r
FROM documents LEFT JOIN (SELECT doc_id AS i, quality FROM labels) ON i = doc_id) WHERE r = 1""")
def best_per_leaf(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return tables.best(d, ["source"], F.desc_nulls_last("quality"), F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "quality")


@bound("""SELECT t.p_type, min(p_partkey) FILTER (p_retailprice > 1500) AS p_partkey FROM part t GROUP BY t.p_type""")
def first_per_category(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    first = tables.best(p.filter("p_retailprice > 1500"), ["p_type"], F.col("p_partkey")).select("p_type", "p_partkey")
    return p.select("p_type").distinct().join(first, "p_type", "left")


@bound("""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || p_size % 7 AS r2, 's' || (p_partkey * 7 % 31) AS slug FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY r2 ORDER BY p_partkey) AS k FROM s), a AS (SELECT p_partkey, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS j FROM r WHERE k = 1)
SELECT p_partkey, r2, CASE WHEN k > 1 THEN 'r2_taken' WHEN j > 1 THEN 'slug_taken' ELSE 'kept' END AS outcome FROM r LEFT JOIN a USING (p_partkey)""")
def greedy_unique_slugs(spark, sf_dir):
    r2 = F.concat(text.kebab(F.col("p_name")), F.lit("-"), (F.col("p_size") % 7).cast("string"))
    slug = F.concat(F.lit("s"), (F.col("p_partkey") * 7 % 31).cast("string"))
    p = read(spark, sf_dir, "part").select("p_partkey", r2.alias("r2"), F.array(F.struct(F.lit("en").alias("locale"), slug.alias("slug"))).alias("posts"))
    return tables.unique_slugs(p, "p_partkey", "r2", "posts").select("p_partkey", "r2", "outcome")


@bound("""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size AS name FROM part), k AS (SELECT DISTINCT replace(p_name, ' ', '_') AS key FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, arg_max(key, length(key)) AS match FROM n LEFT JOIN k ON name = key OR starts_with(name, key || '_') GROUP BY p_partkey""")
def prefix_join(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = p.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")).alias("name"))
    known = p.filter("p_partkey % 3 = 0").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("key"))
    return tables.longest_prefix(names, "name", known, "key").select("p_partkey", "match")


@bound("""WITH n(name, rank) AS (VALUES ('the', 2), ('und', 1), ('de', 3)) SELECT b.item_id, arg_min(name, rank) AS match FROM benchmark b LEFT JOIN n ON contains(lower(b.text), name) GROUP BY b.item_id""")
def substring_join(spark, sf_dir):
    names = spark.sql("SELECT * FROM VALUES ('the', 2), ('und', 1), ('de', 3) AS t(name, rank)")
    b = read(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("low"))
    return lookups.first_contained(b, "low", names, "name", "rank").select("item_id", "match")


@bound("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'even,third' WHEN p_size % 2 = 0 THEN 'even' WHEN p_size % 3 = 0 THEN 'third' ELSE '' END AS themes FROM part""")
def theme_membership(spark, sf_dir):
    themes = spark.sql("SELECT 'even' AS theme, transform(sequence(0, 25), x -> x * 2) AS leaves UNION ALL SELECT 'third', transform(sequence(0, 17), x -> x * 3)")
    return lookups.memberships(read(spark, sf_dir, "part"), "p_size", themes, "theme", "leaves").select("p_partkey", F.array_join("theme", ",").alias("themes"))


# trees: region -> nation -> customer

_TREE = """SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, 0.0::DOUBLE AS balance FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 0.0 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_acctbal FROM customer"""


def tree_rows(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    r = renamed(read(spark, sf_dir, "region"), id=key("r", "r_regionkey"), parent=none, name="r_name", balance=F.lit(0.0))
    n = renamed(read(spark, sf_dir, "nation"), id=key("n", "n_nationkey"), parent=key("r", "n_regionkey"), name="n_name", balance=F.lit(0.0))
    c = renamed(read(spark, sf_dir, "customer"), id=key("c", "c_custkey"), parent=key("n", "c_nationkey"), name="c_name", balance="c_acctbal")
    return r.unionByName(n).unionByName(c)


_WALK = f"""WITH RECURSIVE t AS ({_TREE}), w AS (SELECT id, parent, 1 AS level, id AS root, id AS path FROM t WHERE parent IS NULL
UNION ALL SELECT t.id, t.parent, w.level + 1, w.root, w.path || '/' || t.id FROM t JOIN w ON t.parent = w.id)"""


@bound(f"{_WALK} SELECT CAST(level AS INT) AS level, count(*) AS n FROM w GROUP BY level")
def level_counts(spark, sf_dir):
    return trees.walk(tree_rows(spark, sf_dir), depth=3).groupBy("level").agg(F.count("*").alias("n"))


@bound(f"{_WALK} SELECT id, root, path FROM w WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)")
def leaf_paths(spark, sf_dir):
    t = tree_rows(spark, sf_dir)
    return trees.walk(t, depth=3).join(trees.leaves(t).select("id"), "id").select("id", "root", F.array_join("path", "/").alias("path"))


@bound(f"{_WALK} SELECT id, CAST(level - 1 AS INT) AS level FROM w WHERE root = 'r2' AND contains(path || '/', '/n')")
def subtree(spark, sf_dir):
    t = tree_rows(spark, sf_dir)
    start = t.filter("parent = 'r2'").select("id")
    return trees.walk(t, start, depth=2).select("id", "level")


@bound(f"""WITH t AS ({_TREE}) SELECT r.id, '{{"id":"' || r.id || '","children":[' || string_agg('{{"w":' || (length(n.id)) || ',"id":"' || n.id || '"}}', ',' ORDER BY length(n.id), n.id) || ']}}' AS tree
FROM t r JOIN t n ON n.parent = r.id WHERE r.parent IS NULL GROUP BY r.id""")
def tree_nodes(spark, sf_dir):
    two = tree_rows(spark, sf_dir).filter("not startswith(id, 'c')")
    return trees.nested(two, F.length("id"))


@bound(f"WITH t AS ({_TREE}), k AS (SELECT * FROM t WHERE id NOT IN ('n3', 'n7')) SELECT id FROM k WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM k)")
def orphans(spark, sf_dir):
    return trees.orphans(tree_rows(spark, sf_dir).filter("id not in ('n3', 'n7')")).select("id")


@bound(f"""WITH t AS ({_TREE}), f AS (SELECT substr(id, 1, 1) AS kind, balance > 0 AS lab, id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS leaf FROM t),
s AS (SELECT kind, count(*) AS total, count(*) FILTER (lab) AS with_label, count(*) FILTER (leaf) AS leaves, count(*) FILTER (leaf AND lab) AS leaves_with_label FROM f GROUP BY kind)
SELECT *, CASE WHEN total > 0 THEN round_even(100.0::DOUBLE * with_label / total, 1) ELSE 0.0 END AS share, CASE WHEN leaves > 0 THEN round_even(100.0::DOUBLE * leaves_with_label / leaves, 1) ELSE 0.0 END AS leaf_share FROM s""")
def coverage_by_vocab(spark, sf_dir):
    return trees.coverage(tree_rows(spark, sf_dir).withColumn("kind", F.substring("id", 1, 1)), "kind", F.col("balance") > 0)


_BROKEN = f"""WITH t AS ({_TREE}), k AS (SELECT id, parent FROM t WHERE id NOT IN ('n3', 'n7') UNION ALL SELECT id, parent FROM t WHERE id IN ('c1', 'c2') UNION ALL SELECT ' ', 'n1')"""


@bound(f"""{_BROKEN}, a(name, expected, actual) AS (SELECT 'level_1', 5, (SELECT count(*) FROM k WHERE parent IS NULL) UNION ALL SELECT 'level_2', 25, (SELECT count(*) FROM k WHERE parent IN (SELECT id FROM k WHERE parent IS NULL))
UNION ALL SELECT 'level_3', 0, (SELECT count(*) FROM k c JOIN k n ON c.parent = n.id JOIN k r ON n.parent = r.id WHERE r.parent IS NULL) UNION ALL SELECT 'orphans', 0, (SELECT count(*) FROM k WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM k))
UNION ALL SELECT 'duplicates', 0, (SELECT count(*) FROM (SELECT id FROM k GROUP BY id HAVING count(*) > 1)) UNION ALL SELECT 'blank', 0, (SELECT count(*) FROM k WHERE trim(id) = ''))
SELECT name, expected::BIGINT AS expected, actual::BIGINT AS actual, expected = actual AS ok FROM a""")
def integrity_report(spark, sf_dir):
    t = tree_rows(spark, sf_dir).select("id", "parent")
    broken = t.filter("id not in ('n3', 'n7')").unionByName(t.filter("id in ('c1', 'c2')")).unionByName(spark.sql("SELECT ' ' AS id, 'n1' AS parent"))
    return trees.integrity(broken, {"level_1": 5, "level_2": 25})


# text


@bound(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""")
def slug_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.kebab(text.fold_latin(F.col("text"))).alias("slug"))


@bound(r"""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, '^[a-z][a-z0-9-]*[a-z0-9]$') THEN s END AS slug,
CASE WHEN s = '' THEN 'empty' WHEN length(s) < 2 THEN 'too_short' WHEN NOT regexp_matches(s, '^[a-z][a-z0-9-]*[a-z0-9]$') THEN 'invalid' END AS error FROM s""")
def r2_slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.r2_slug(F.col("p_name")).alias("s")).select("p_partkey", "s.*")


@bound(r"""SELECT page_id, coalesce(list_filter(string_split(regexp_replace(regexp_replace(url, '^[^:]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')[-1], '') AS slug FROM pages""")
def url_slug(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.last_segment(F.col("url")).alias("slug"))


_COLOR = "|".join(sorted(text.COLORS, key=len, reverse=True))


@bound(rf"""SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '(?i)\b({_COLOR})\b', '', 'g'), ' +', ' ', 'g')) AS prompt FROM part""")
def prompt_filters(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.strip_colors(F.col("p_name")).alias("prompt"))


@bound(rf"""WITH l AS (SELECT p_partkey, lower(replace(p_name || ' ' || p_type, ' ', '_')) AS x FROM part)
SELECT p_partkey, CASE WHEN starts_with(x, 'lion') THEN 'animals_lions' WHEN regexp_matches(x, '{text.BIRDS}') THEN 'animals_birds' WHEN regexp_matches(x, '{text.MARINE}') THEN 'animals_marine'
WHEN regexp_matches(x, '{text.PETS}') OR (regexp_matches(x, '_cat|cat_') AND NOT regexp_matches(x, '{text.BIG_CATS}')) THEN 'animals_pets' WHEN regexp_matches(x, '{text.WILD}') THEN 'animals_wild'
WHEN regexp_matches(x, '(^|_)({text.PEOPLE})') OR regexp_matches(x, '{text.HUMANS}') THEN 'general_humans' WHEN regexp_matches(x, '{text.LETTERS}') THEN 'letters_arabic' ELSE 'objects_things' END AS category FROM l""")
def category_rules(spark, sf_dir):
    leaf = F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("_"))
    return read(spark, sf_dir, "part").select("p_partkey", text.category(leaf).alias("category"))


@bound("""SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 4 = 2 THEN '_' || p_partkey ELSE '' END AS concept, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS INT) END AS steps,
CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) / 10 END AS cfg, CASE WHEN p_partkey % 4 < 3 THEN p_partkey END AS seed FROM part""")
def filename_parts(spark, sf_dir):
    k = F.col("p_partkey") % 4
    of = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    base, size, key = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size"), F.col("p_partkey")
    name = F.when(k == 0, of(base, "_", size, "s_cfg", size, "_", key, ".png")).when(k == 1, of(base, "_", size, "s_", key, ".png")).when(k == 2, of(base, "_", key, ".png")).otherwise(of("dir/", base, ".png"))
    return read(spark, sf_dir, "part").select("p_partkey", text.filename_parts(name).alias("f")).select("p_partkey", "f.*")


@bound(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NEW: ' || p_name || ', clean' ELSE p_name || ', clean' END AS styled,
CASE p_partkey % 3 WHEN 0 THEN 'green screen, ' || p_name WHEN 1 THEN p_name || ' illustration, green screen, x' ELSE 'green screen ' || p_name END AS keyed FROM part""")
def style_transform(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    p = F.when(k == 0, F.concat(F.lit("HEAD: "), name, F.lit(", bold"))).when(k == 1, F.concat(name, F.lit(", , bold"))).otherwise(name)
    q = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" illustration, x"))).otherwise(F.concat(F.lit("green screen "), name))
    return read(spark, sf_dir, "part").select("p_partkey", text.restyle(p, "HEAD:", "NEW:", ["bold"], ", clean").alias("styled"), text.inject_background(q, "green screen").alias("keyed"))


@bound("""SELECT n_nationkey, n_name AS en, '' AS ar, '{"en":"' || n_name || '","fr":"' || r_name || '"}' AS names FROM nation JOIN region ON n_regionkey = r_regionkey""")
def i18n_fields(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = n.select("n_nationkey", jsonx.to_i18n(en=F.col("n_name"), fr=F.col("r_name"), ar=F.lit("")).alias("names"))
    return named.select("n_nationkey", jsonx.i18n(F.col("names"), "en").alias("en"), jsonx.i18n(F.col("names"), "ar").alias("ar"), "names")


@bound("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, props LIKE '%"k": 1%' OR props LIKE '%"k":1%' AS like_k1, coalesce(json_extract_string(props, '$.k') = '1', false) AS is_k1 FROM events""")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    like = F.col("props").like('%"k": 1%') | F.col("props").like('%"k":1%')
    return read(spark, sf_dir, "events").select("event_id", k.cast("int").alias("k"), like.alias("like_k1"), F.coalesce(k == "1", F.lit(False)).alias("is_k1"))


@bound("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def llm_json(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    form = F.col("event_id") % 3
    reply = F.when(form == 0, F.concat(F.lit('<think>{"k": -1}</think>\n'), F.col("props"))).when(form == 1, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), F.col("props"), F.lit(" as said.")))
    return e.select("event_id", F.get_json_object(jsonx.reply_json(reply), "$.k").cast("int").alias("k"))


@bound("""SELECT doc_id, CASE WHEN quality = 1 THEN 5 ELSE 2 END AS score, CASE WHEN toxic = 1 THEN 'unsafe' ELSE '' END AS tags, CASE WHEN toxic = 1 AND quality = 1 THEN 'good_but_unsafe' ELSE '' END AS anomalies FROM labels""")
def annotation_v2(spark, sf_dir):
    score = F.element_at(F.create_map(F.lit(0), F.lit(2), F.lit(1), F.lit(5)), F.col("quality"))
    tags = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("unsafe"))))
    odd = F.array_compact(F.array(F.when((F.col("toxic") == 1) & (score >= 4), F.lit("good_but_unsafe"))))
    return read(spark, sf_dir, "labels").select("doc_id", score.alias("score"), F.array_join(tags, ",").alias("tags"), F.array_join(odd, ",").alias("anomalies"))


# rules


@bound("""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS description FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(length(title), 0) NOT BETWEEN 5 AND 100 THEN 'title_en len=' || coalesce(length(title), 0) || ' [5,100]' END,
CASE WHEN coalesce(length(description), 0) NOT BETWEEN 20 AND 200 THEN 'description_en len=' || coalesce(length(description), 0) || ' [20,200]' END], lambda x: x IS NOT NULL), ';') AS hard,
array_to_string(list_filter([CASE WHEN coalesce(length(title), 0) < 40 THEN 'title_en:too_short' WHEN length(title) > 60 THEN 'title_en:too_long' END,
CASE WHEN coalesce(length(description), 0) < 80 THEN 'description_en:too_short' WHEN length(description) > 130 THEN 'description_en:too_long' END], lambda x: x IS NOT NULL), ';') AS soft FROM d""")
def caps(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    fields = {"title_en": F.get(F.split("text", "\n"), 0), "description_en": F.get(F.split("text", "\n"), 1)}
    soft = F.transform(rules.soft_violations(fields), lambda v: F.concat(v["field"], F.lit(":"), v["kind"]))
    return d.select("doc_id", F.array_join(rules.hard_violations(fields), ";").alias("hard"), F.array_join(soft, ";").alias("soft"))


@bound("""WITH m AS (SELECT vec_id, label, list_avg(list_transform(embedding, lambda x: CAST(x > 0.1 AS INT)))::DOUBLE AS dark, list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)) * 200 AS contrast,
list_sum(list_transform(embedding, lambda x: CAST(abs(x) > 0.12 AS INT))) * 40 AS edges FROM embeddings), t AS (SELECT vec_id, list_filter([CASE WHEN label = 3 THEN 'qc_color_intrinsic' END,
CASE WHEN contrast < 30 THEN 'qc_low_contrast' END, CASE WHEN edges < 500 THEN 'qc_low_complexity' END, CASE WHEN dark > 0.5 THEN 'qc_oversaturated' END], lambda x: x IS NOT NULL) AS tags FROM m)
SELECT vec_id, array_to_string(CASE WHEN len(list_filter(tags, lambda x: x <> 'qc_color_intrinsic')) = 0 THEN list_append(tags, 'qc_ok') ELSE tags END, ',') AS tags FROM t""")
def qc_tags(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    share = arrays.mean(F.transform("e", lambda x: (x > 0.1).cast("double")))
    edges = F.aggregate("e", F.lit(0), lambda acc, x: acc + (F.abs(x) > 0.12).cast("int")) * 40
    tags = rules.qc_tags(F.lit(True), F.lit(0.0), arrays.std(F.col("e")) * 200, edges, share, F.when(F.col("label") == 3, "rainbow_x").otherwise("x"))
    return e.select("vec_id", F.array_join(tags, ",").alias("tags"))


@bound("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, round(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), 6) AS spread, avg(CAST(x > 0.15 AS INT)) AS ink
FROM (SELECT vec_id, unnest(e) AS x FROM m) GROUP BY vec_id), c AS (SELECT vec_id, spread, CASE WHEN ink < 0.0015 THEN 'fail' WHEN ink < 0.004 THEN 'warn' WHEN ink > 0.55 THEN 'fail' WHEN ink > 0.48 THEN 'warn' ELSE 'pass' END AS s1,
CASE WHEN spread < 0.08 THEN 'fail' WHEN spread < 0.12 THEN 'warn' ELSE 'pass' END AS s2, CASE WHEN ink < 0.0008 THEN 'fail' WHEN ink < 0.002 THEN 'warn' ELSE 'pass' END AS s3 FROM s)
SELECT vec_id, spread, CASE WHEN 'fail' IN (s1, s2, s3) THEN 'fail' WHEN 'warn' IN (s1, s2, s3) THEN 'warning' ELSE 'pass' END AS status,
CAST(round_even(100.0::DOUBLE * (3 + list_sum(list_transform([s1, s2, s3], lambda x: CASE x WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.65 ELSE 0.0 END))::DOUBLE) / 6, 0) AS INT) AS score FROM c""")
def qc_report(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    m = e.groupBy("vec_id").agg(F.round(F.percentile("x", F.lit(0.99)) - F.percentile("x", F.lit(0.01)), 6).alias("spread"), F.avg((F.col("x") > 0.15).cast("int")).alias("ink"))
    checks = m.withColumn("checks", rules.severities(F.lit(0.0), F.lit(1.0), F.col("ink"), F.col("spread"), F.lit(0.0), F.lit(0.0)))
    return checks.select("vec_id", "spread", rules.technical_status(F.col("checks")).alias("status"), rules.technical_score(F.col("checks")).alias("score"))


@bound("""WITH j AS (SELECT source, quality, toxic FROM documents LEFT JOIN (SELECT doc_id AS i, quality, toxic FROM labels) ON i = doc_id),
s AS (SELECT source, count(*) FILTER (quality IS NOT NULL) AS n, count(*) FILTER (quality = 0) AS n_a, count(*) FILTER (toxic = 1) AS n_b FROM j GROUP BY source),
r AS (SELECT *, CASE WHEN n > 0 THEN round_even((n_a + n_b)::DOUBLE / (2 * n), 4) END AS rate FROM s)
SELECT *, CASE WHEN n = 0 THEN 'waiting' WHEN rate <= 0.30 THEN 'go' ELSE 'no_go' END AS verdict FROM r""")
def defect_rates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return summaries.defect_rates(d, "source", F.col("quality").isNotNull(), F.col("quality") == 0, F.col("toxic") == 1)


@bound("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(v) AS n, v[1] AS min, v[len(v) // 2 + 1] AS median, v[CAST(floor(len(v) * 0.9::DOUBLE) AS INT) + 1] AS p90, v[-1] AS max FROM s""")
def dist_summary(spark, sf_dir):
    return summaries.distribution(read(spark, sf_dir, "events"), "event_type", "value")


@bound("""WITH o AS (SELECT event_type, value, event_id % 5 <> 0 AS ok FROM events), s AS (SELECT event_type, count(*) AS n, count(*) FILTER (ok) AS n_ok, list_sort(list(value) FILTER (ok)) AS v,
round_even(avg(value) FILTER (ok), 4) AS mean, round_even(count(*) FILTER (ok AND value <= 50)::DOUBLE / count(*), 4) AS within_budget, round_even(count(*) FILTER (ok AND value > 50)::DOUBLE / count(*), 4) AS over_budget FROM o GROUP BY event_type)
SELECT event_type, n, n_ok, round_even(list_median(v), 4) AS median, v[CAST(round_even(0.95::DOUBLE * (len(v) - 1), 0) AS INT) + 1] AS p95, mean, within_budget, over_budget FROM s""")
def latency_summary(spark, sf_dir):
    return summaries.latency(read(spark, sf_dir, "events"), "event_type", "value", F.col("event_id") % 5 != 0, 50)


@bound("""WITH c AS (SELECT unnest(['short', 'user']) AS "check", unnest([CAST(length(text) < 300 AS INT), CAST(role = 'user' AS INT)]) AS p FROM conversations)
SELECT "check", CAST(sum(p) AS BIGINT) AS passed, count(*) AS n, round_even(avg(p), 4) AS rate FROM c GROUP BY 1""")
def check_pass_rate(spark, sf_dir):
    return summaries.pass_rate(read(spark, sf_dir, "conversations"), short=F.length("text") < 300, user=F.col("role") == "user")


@bound("""SELECT tag, count(*) AS n FROM (SELECT unnest([event_type, 'k' || (CAST(json_extract_string(props, '$.k') AS INT) % 5)]) AS tag FROM events) GROUP BY tag""")
def tag_frequency(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    return summaries.tag_frequency(e, F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 5).cast("string"))))


@bound("""SELECT lang, round_even(avg(length(text)), 1) AS avg_len, median(length(text)) AS median_len, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len FROM documents GROUP BY lang""")
def length_stats(spark, sf_dir):
    return summaries.lengths(read(spark, sf_dir, "documents"), "lang", "text")


@bound("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount <= 0.05) AS ok, round_even(avg(l_discount), 6) AS avg_discount, max(l_discount) AS max_discount FROM lineitem GROUP BY l_returnflag""")
def class_stats(spark, sf_dir):
    return summaries.compliance(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", 0.05).withColumnsRenamed({"avg": "avg_discount", "max": "max_discount"}).drop("violators")


# changes: incoming operations on orders

_OPS = """SELECT o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'replace' WHEN 2 THEN 'remove' WHEN 3 THEN 'update' ELSE 'what' END AS op,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey + 100000000 END AS id FROM orders"""


def order_ops(spark, sf_dir):
    k = F.col("o_orderkey")
    op = F.when(k % 5 == 0, "add").when(k % 5 == 1, "replace").when(k % 5 == 2, "remove").when(k % 5 == 3, "update").otherwise("what")
    return renamed(read(spark, sf_dir, "orders"), idx="o_orderkey", op=op, id=F.when(k % 3 == 0, k).otherwise(k + 100000000))


_STATE = f"""WITH o AS ({_OPS}), x AS (SELECT idx, CASE op WHEN 'replace' THEN 'upsert' ELSE op END AS op, id, id IN (SELECT o_orderkey FROM orders) AS there FROM o),
v AS (SELECT idx, op, id, CASE WHEN op = 'what' THEN 'error' WHEN op = 'add' THEN CASE WHEN there THEN 'conflict' ELSE 'ready' END WHEN op = 'update' THEN CASE WHEN there THEN 'update' ELSE 'error' END
WHEN op = 'remove' THEN CASE WHEN there THEN 'ready' ELSE 'skip' END ELSE CASE WHEN there THEN 'update' ELSE 'ready' END END AS state FROM x)"""


@bound(f"{_STATE} SELECT idx, op, id, state FROM v")
def cdc_validate(spark, sf_dir):
    return changes.validate(order_ops(spark, sf_dir), renamed(read(spark, sf_dir, "orders"), id="o_orderkey"), "id").select("idx", "op", "id", "state")


@bound(f"{_STATE} SELECT s.state, count(v.idx) AS n FROM (VALUES ('ready'), ('update'), ('conflict'), ('error'), ('skip')) s(state) LEFT JOIN v ON v.state = s.state GROUP BY s.state")
def cdc_summary(spark, sf_dir):
    return changes.summary(changes.validate(order_ops(spark, sf_dir), renamed(read(spark, sf_dir, "orders"), id="o_orderkey"), "id"))


@bound("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'status:' || o_orderstatus || '>F' ELSE '' END AS changes FROM orders""")
def cdc_diff(spark, sf_dir):
    cur = renamed(read(spark, sf_dir, "orders"), id="o_orderkey", status="o_orderstatus", priority="o_orderpriority")
    new = cur.select("id", F.when(F.col("id") % 2 == 0, " F ").alias("status"), F.lit(None).cast("string").alias("priority"))
    d = changes.differences(new, cur, "id", ["status", "priority"])
    return d.select("id", F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["from"], F.lit(">"), c["to"])), ";").alias("changes"))


@bound("""SELECT CASE WHEN k THEN CASE WHEN i THEN 'UPDATE' ELSE 'KEEP' END ELSE 'INSERT' END AS action, count(*) AS n, round(sum(price), 2) AS price FROM (
SELECT true AS k, o_orderkey % 4 = 0 AS i, CASE WHEN o_orderkey % 4 = 0 THEN 1.5 ELSE o_totalprice END AS price FROM orders
UNION ALL SELECT false, true, 1.5 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 = 0) GROUP BY 1""")
def cdc_apply(spark, sf_dir):
    cur = renamed(read(spark, sf_dir, "orders"), id="o_orderkey", price="o_totalprice", status="o_orderstatus")
    up = cur.filter("id % 4 = 0").select("id", F.lit(1.5).alias("price"), F.lit("N").alias("status"))
    new = cur.filter("id % 8 = 0").select((F.col("id") + 100000000).alias("id"), F.lit(1.5).alias("price"), F.lit("N").alias("status"))
    merged = changes.merge(cur, up.unionByName(new), ["id"], ["price"], ["status"])
    return merged.groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@bound("""SELECT n_nationkey, 'name' AS path, n_name AS current, lower(n_name) AS proposed FROM nation WHERE n_name <> lower(n_name)
UNION ALL SELECT n_nationkey, 'extra', NULL, 'x' FROM nation WHERE n_nationkey % 2 = 0""")
def nested_diff(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    cur = n.select("n_nationkey", F.create_map(F.lit("name"), F.col("n_name")).alias("m"))
    new = n.select("n_nationkey", F.map_filter(F.create_map(F.lit("name"), F.lower("n_name"), F.lit("extra"), F.lit("x")), lambda k, _: (k == "name") | (F.col("n_nationkey") % 2 == 0)).alias("m"))
    return changes.map_differences(cur, new, "n_nationkey", "m")


@bound("""SELECT p_partkey, v.variant FROM part, (VALUES ('A'), ('N'), ('R')) v(variant) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = v.variant)""")
def variants_missing(spark, sf_dir):
    have = renamed(read(spark, sf_dir, "lineitem"), p_partkey="l_partkey", variant="l_returnflag")
    return rules.missing_variants(read(spark, sf_dir, "part"), "p_partkey", ["A", "N", "R"], have)


@bound("""WITH g AS (SELECT source, list_distinct(list(lang)) AS have, count(*) FILTER (trim(text) = '') AS n_blank, count(*) FILTER (NOT lang IN ('fr', 'en', 'de', 'es')) AS n_status, count(*) AS n_rows FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(list_filter(['fr', 'en', 'de'], lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: x NOT IN ('fr', 'en', 'de'))), ',') AS extra,
n_blank, n_status, n_rows, len(list_filter(have, lambda x: x NOT IN ('fr', 'en', 'de'))) = 0 AND len(have) = 3 AND n_blank = 0 AND n_status = 0 AND n_rows = 3 AS ready FROM g""")
def publish_gate(spark, sf_dir):
    g = rules.publish_gate(read(spark, sf_dir, "documents"), "source", "lang", ["text"], "lang", ("fr", "en", "de", "es"), ("fr", "en", "de"))
    return g.withColumn("missing", F.array_join("missing", ",")).withColumn("extra", F.array_join("extra", ","))


@bound("""SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def hash_dups(spark, sf_dir):
    return changes.content_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


@bound("""SELECT doc_id % 3 AS kind, doc_id % 3 <> 0 AS write, count(*) AS n FROM documents GROUP BY ALL""")
def hash_idempotent(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = d.select("doc_id", F.sha2(F.encode(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "UTF-8"), 256).alias("sha256")).filter("doc_id % 3 <> 2")
    out = changes.changed_content(d, "doc_id", "text", manifest)
    return out.groupBy((F.col("doc_id") % 3).alias("kind"), "write").agg(F.count("*").alias("n"))


@bound("""SELECT s_suppkey, CASE WHEN s_suppkey IN (3, 7) THEN 'blocked' WHEN s_suppkey % 4 = 0 THEN 'add' WHEN s_suppkey % 4 = 1 THEN 'skip' ELSE 'update' END AS action FROM supplier""")
def sync_decision(spark, sf_dir):
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    content = F.md5(F.col("s_name"))
    remote = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, content).otherwise(F.lit("old"))
    return s.select("s_suppkey", rules.sync_action(k.isin(3, 7), remote, content).alias("action"))


# arrays


@bound("""WITH p AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL),
d AS (SELECT e.vec_id, c.label, round(sqrt(sum((e.x - c.x) ** 2)), 6) AS dist FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) e JOIN p c ON c.p = e.p GROUP BY ALL)
SELECT vec_id, arg_min(label, (dist, label)) AS nearest, min(dist) AS dist FROM d GROUP BY vec_id""")
def nearest_palette(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return arrays.nearest(e, "vec_id", "embedding", arrays.centroids(e, "label", "embedding"), "label", "center")


@bound("""WITH RECURSIVE p AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL),
e AS (SELECT a.label AS a, b.label AS b FROM p a JOIN p b ON a.p = b.p AND a.label <> b.label GROUP BY ALL HAVING sqrt(sum((a.x - b.x) ** 2)) < 0.19),
r AS (SELECT label AS id, label AS canon FROM (SELECT DISTINCT label FROM p) UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.canon)
SELECT id, min(canon) AS canonical FROM r GROUP BY id""")
def palette_merge(spark, sf_dir):
    return arrays.merge_close(arrays.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding"), "label", "center", 0.19)


_GRID = """SELECT vec_id AS image, (generate_subscripts(embedding, 1) - 1) // 8 AS y, (generate_subscripts(embedding, 1) - 1) % 8 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings"""


def grid(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))
    return e.select("image", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), "v", F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0).alias("region"))


_REGION = f"WITH g AS (SELECT *, CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS region FROM ({_GRID}))"


@bound(f"{_REGION} SELECT image, region::INT AS region, count(*) AS area, round_even(avg(v), 6) AS mean FROM g GROUP BY ALL")
def region_stats(spark, sf_dir):
    return arrays.region_stats(grid(spark, sf_dir), "v")


@bound(f"""{_REGION} SELECT DISTINCT a.image, least(a.region, b.region)::INT AS a, greatest(a.region, b.region)::INT AS b FROM g a JOIN g b ON a.image = b.image AND a.region <> b.region
AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))""")
def region_adjacency(spark, sf_dir):
    return arrays.adjacency(grid(spark, sf_dir))


@bound(f"""{_REGION}, s AS (SELECT image, region, count(*) AS area FROM g GROUP BY ALL), n AS (SELECT a.image, a.region, b.region AS other, count(*) AS c FROM g a JOIN g b ON a.image = b.image AND a.region <> b.region
AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL) SELECT s.image, s.region::INT AS region, arg_max(other, (c, -other))::INT AS into_region FROM s JOIN n USING (image, region) WHERE area < 10 GROUP BY ALL""")
def small_region_merge(spark, sf_dir):
    return arrays.small_into_majority(grid(spark, sf_dir), 10)


@bound("""WITH q AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 17)::DOUBLE AS k, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS turn FROM part),
c AS (SELECT p_partkey, turn, unnest([1, 2, 3, 4]) AS i, [0.0, s, s + k, 1.0] AS x, [0.0, -k, s, s + 2] AS y FROM q), e AS (SELECT p_partkey, turn, x[i] AS x1, y[i] AS y1, x[i % 4 + 1] AS x2, y[i % 4 + 1] AS y2, x[(i + 2) % 4 + 1] AS x0, y[(i + 2) % 4 + 1] AS y0 FROM c)
SELECT p_partkey, round(turn * sum(x1 * y2 - x2 * y1) / 2, 6) AS area, round(turn * (sum(x1 * y2 - x2 * y1) / 2 - sum((x1 - x0) * (y2 - y1) - (x2 - x1) * (y1 - y0)) / 32), 6) AS smoothed FROM e GROUP BY p_partkey, turn""")
def polygon_area(spark, sf_dir):
    s, k, zero = F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"), F.lit(0.0)
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (s, -k), (s + k, s), (F.lit(1.0), s + 2))))
    shape = F.when(F.col("p_partkey") % 2 == 0, corners).otherwise(F.reverse(corners))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(colors.polygon_area(shape), 6).alias("area"), F.round(colors.polygon_area(colors.chaikin(shape)), 6).alias("smoothed"))


@bound("""SELECT p_partkey, '#' || printf('%02x%02x%02x', p_partkey % 256, (p_partkey * 7) % 256, (p_partkey * 13) % 256) AS hex, ((p_partkey % 256) // 64 * 64)::INT AS red4,
round(0.299 * (p_partkey % 256) + 0.587 * ((p_partkey * 7) % 256) + 0.114 * ((p_partkey * 13) % 256), 3)::DOUBLE AS luma FROM part""")
def posterize(spark, sf_dir):
    k = F.col("p_partkey")
    r, g, b = k % 256, (k * 7) % 256, (k * 13) % 256
    return read(spark, sf_dir, "part").select("p_partkey", colors.rgb_to_hex(r, g, b).alias("hex"), colors.posterize(r, 4).alias("red4"), F.round(colors.luma(r, g, b), 3).alias("luma"))


def _lab_sql() -> str:
    lin = "CASE WHEN {0} / 255.0::DOUBLE > 0.04045 THEN (({0} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE ELSE {0} / 255.0::DOUBLE / 12.92::DOUBLE END"
    f = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE 7.787::DOUBLE * {0} + 16.0::DOUBLE / 116.0::DOUBLE END"
    return f"""WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part),
l AS (SELECT p_partkey, {lin.format("r")} AS r, {lin.format("g")} AS g, {lin.format("b")} AS b FROM c),
x AS (SELECT p_partkey, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y,
(0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.08883::DOUBLE AS z FROM l),
f AS (SELECT p_partkey, {f.format("x")} AS x, {f.format("y")} AS y, {f.format("z")} AS z FROM x)
SELECT p_partkey, round(116 * y - 16, 4) AS "L", round(500 * (x - y), 4) AS a, round(200 * (y - z), 4) AS b FROM f"""


@bound(_lab_sql())
def rgb_lab(spark, sf_dir):
    k = F.col("p_partkey")
    lab = read(spark, sf_dir, "part").select("p_partkey", colors.rgb_to_lab(k % 256, (k * 7) % 256, (k * 13) % 256).alias("lab"))
    return lab.select("p_partkey", *(F.round(F.col("lab")[c], 4).alias(c) for c in ("L", "a", "b")))


# kernels without SQL, and the export flow


def gray_images(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (128 + x * 600).cast("int"))))
    return read(spark, sf_dir, "embeddings").select("vec_id", v.alias("gray"))


@bound()
def image_metrics(spark, sf_dir):
    g = gray_images(spark, sf_dir).withColumn("rgb", F.flatten(F.transform("gray", lambda x: F.array(x, x, x))))
    return g.select("vec_id", images.qc_metrics(F.lit(8), F.lit(8), F.col("rgb")).alias("m")).select("vec_id", "m.*")


@bound()
def image_openness(spark, sf_dir):
    return gray_images(spark, sf_dir).select("vec_id", F.round(images.openness_ratio(F.lit(8), F.lit(8), F.col("gray"), 128), 6).alias("openness"))


@bound()
def image_components(spark, sf_dir):
    parts = images.components(grid(spark, sf_dir))
    return parts.groupBy("image").agg(F.countDistinct("part").alias("parts"))


@bound()
def image_region_merge(spark, sf_dir):
    g = grid(spark, sf_dir)
    stats = g.groupBy("image", "region").agg(F.count("*").cast("double").alias("area"), (100 * F.avg("v")).alias("L")).withColumn("a", F.lit(0.0)).withColumn("b", F.lit(0.0))
    return images.merge_regions(stats, arrays.adjacency(g), 12.0)


_BAYER = ", ".join(str(v) for row in images.bayer() for v in row)


@bound(f"""SELECT vec_id, CAST(sum(CASE WHEN 128 + x * 600 > (t[p] + 0.5::DOUBLE) * 3.984375::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS white FROM
(SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p, [{_BAYER}] AS t FROM embeddings) GROUP BY vec_id""")
def dithering(spark, sf_dir):
    p = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    white = images.dither(128 + F.col("x") * 600, F.floor(F.col("p") / 8), F.col("p") % 8)
    return p.groupBy("vec_id").agg(F.count_if(white == 255).alias("white"))


@bound(r"""WITH d AS (SELECT doc_id, source, n_chars, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS description, quality FROM documents JOIN (SELECT doc_id AS i, quality FROM labels) ON i = doc_id),
e AS (SELECT * FROM d WHERE length(title) BETWEEN 5 AND 100 AND length(description) BETWEEN 20 AND 200),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, n_chars DESC, doc_id) AS r FROM e)
SELECT source, doc_id, v.locale, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') || '-' || v.locale AS slug, left(title, 40) AS title_card FROM b, (VALUES ('fr'), ('en'), ('ar')) v(locale) WHERE r = 1""")
def export_flow(spark, sf_dir):
    """Eligible documents, the best of each source, unique slugs, one post a locale."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.get(F.split("text", "\n"), 0).alias("title"), F.get(F.split("text", "\n"), 1).alias("description"))
    d = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    fit = d.filter(F.size(rules.hard_violations({"title_en": F.col("title"), "description_en": F.col("description")})) == 0)
    best = tables.best(fit, ["source"], F.desc_nulls_last("quality"), F.desc("n_chars"), F.col("doc_id"))
    r2 = text.r2_slug(F.col("source"))["slug"]
    posts = F.array(*(F.struct(F.lit(loc).alias("locale"), F.concat(r2, F.lit(f"-{loc}")).alias("slug")) for loc in rules.LOCALES))
    chosen = tables.unique_slugs(best.withColumn("r2", r2).withColumn("posts", posts), "source", "r2", "posts").filter("outcome = 'kept'")
    return chosen.select("source", "doc_id", F.explode("posts").alias("p"), F.substring("title", 1, 40).alias("title_card")).select("source", "doc_id", "p.locale", "p.slug", "title_card")
