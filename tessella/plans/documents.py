"""Nested documents, trees replaced as a whole, samples and first rows bound to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import artifacts, colors, jsonx
from tessella.operators import arrays, changes, grids, lookups, nested, rules
from tessella.plans.bound import _GRID, _TREE, _WALK, bound, grid, read, tree_rows
from tessella.sources import exports

# nested documents: orders with their lines, and a proposal for each

_DOCS = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
one AS (SELECT k, json_object('flags', json_object('a', CAST(count(*) FILTER (f = 'A') AS BIGINT), 'n', NULL), 'lines', to_json(list(json_object('n', n, 'q', q, 'f', f) ORDER BY n, q, f))) AS j FROM l GROUP BY k),
two AS (SELECT k, json_object('flags', json_object('a', CAST(count(*) FILTER (f = 'A') AS BIGINT), 'n', k % 2), 'lines', to_json(coalesce(list(json_object('n', n, 'q', q + CASE WHEN n = 2 THEN 1 ELSE 0 END, 'f', f) ORDER BY n, q, f) FILTER (n <> 4), CAST([] AS JSON[])))) AS j FROM l GROUP BY k),
a AS (SELECT k, replace(substr(fullkey, 3), '"', '') AS path, CASE WHEN t.type = 'ARRAY' THEN '[]' ELSE CAST(atom AS VARCHAR) END AS v FROM one, json_tree(one.j) t WHERE t.type <> 'OBJECT' AND (t.type <> 'ARRAY' OR json_array_length(t.value) = 0)),
b AS (SELECT k, replace(substr(fullkey, 3), '"', '') AS path, CASE WHEN t.type = 'ARRAY' THEN '[]' ELSE CAST(atom AS VARCHAR) END AS v FROM two, json_tree(two.j) t WHERE t.type <> 'OBJECT' AND (t.type <> 'ARRAY' OR json_array_length(t.value) = 0))"""


def order_documents(spark, sf_dir):
    """(k, doc) as they are and as proposed."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    line = F.struct(n.alias("n"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"))
    # both documents are made of one list, so that the lines are shuffled once
    sums = read(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.array_sort(F.collect_list(line)).alias("one"))
    two = F.transform(F.filter("one", lambda x: x.n != 4), lambda x: F.struct(x.n.alias("n"), (x.q + F.when(x.n == 2, 1).otherwise(0)).alias("q"), x.f.alias("f")))
    document = lambda mark, lines: F.to_variant_object(F.struct(F.struct("a", mark.alias("n")).alias("flags"), lines.alias("lines"))).alias("doc")
    return sums.select("k", document(F.lit(None).cast("long"), F.col("one"))), sums.select("k", document(F.col("k") % 2, two))


@bound(f"{_DOCS} SELECT k, path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(a.v, CASE WHEN a.path IS NOT NULL THEN 'null' END) AS current, coalesce(b.v, CASE WHEN b.path IS NOT NULL THEN 'null' END) AS proposed FROM a FULL JOIN b USING (k, path) WHERE a.v IS DISTINCT FROM b.v OR a.path IS NULL OR b.path IS NULL")
def deep_changes(spark, sf_dir):
    one, two = order_documents(spark, sf_dir)
    return nested.deep_diff(one, two, "k", "doc")


@bound("""WITH c AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1), p AS (SELECT n_regionkey AS r, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, coalesce(k, 0) AS k FROM nation LEFT JOIN c ON n = n_nationkey)
SELECT r, 'n' || n AS id, NULL AS parent, 1 AS level, place::INT AS place, coalesce(sum(k + 1) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS weight FROM p
UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || n_nationkey, 2, i::INT, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 100 <> 0 THEN c_custkey % 100 ELSE i END::INT
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer) JOIN nation ON n_nationkey = c_nationkey""")
def nested_nodes(spark, sf_dir):
    """Regions as documents of nested nations and customers, some with a weight, taken apart again."""
    weight = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 100)
    inner = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), weight.alias("weight")).alias("v")))).alias("c"))
    n = read(spark, sf_dir, "nation").join(inner, F.col("n") == F.col("n_nationkey"), "left")
    one = F.struct("n_nationkey", F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("c.v").alias("children")).alias("v"))
    docs = n.groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list(one)).alias("l")).select("r", F.parse_json(F.to_json("l.v")).alias("list"))
    return nested.nodes(docs, "r", F.col("list")).select("r", "id", "parent", "level", "place", "weight")


@bound(f"{_WALK}, o AS (SELECT id FROM t WHERE id NOT LIKE 'c%') SELECT id, 0 AS step, 'deleted' AS outcome FROM o UNION ALL SELECT id, CAST(level AS INT), 'inserted' FROM w")
def tree_replaced(spark, sf_dir):
    new = tree_rows(spark, sf_dir)
    return nested.replace_tree(new.filter("not startswith(id, 'c')"), new)[1]


@bound(f"""WITH t AS ({_TREE}), n AS (SELECT CASE WHEN id = 'n5' THEN 'n6' ELSE id END AS id, CASE WHEN id = 'r2' THEN 'n7' ELSE parent END AS parent FROM t WHERE id <> 'n3')
SELECT DISTINCT id, 0 AS step, 'refused: ' || fault AS outcome FROM (SELECT id, 'repeated' AS fault FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'orphan' FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)
UNION ALL SELECT n.id, 'cycle' FROM n WHERE n.id = 'r2' OR n.parent = 'r2' OR n.parent IN (SELECT id FROM n WHERE parent = 'r2'))""")
def tree_refused(spark, sf_dir):
    """A region made a child of one of its own nations, a repeated id and a missing nation: the whole tree is refused."""
    t = tree_rows(spark, sf_dir)
    new = t.filter("id <> 'n3'").withColumn("parent", F.when(F.col("id") == "r2", "n7").otherwise(F.col("parent"))).withColumn("id", F.when(F.col("id") == "n5", "n6").otherwise(F.col("id")))
    return nested.replace_tree(t, new)[1]


@bound("""WITH s AS (SELECT doc_id AS key, '"' || md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || 'x' END) || '"' AS etag, CASE WHEN doc_id % 5 = 0 THEN 'm' || doc_id % 2 END AS master FROM documents WHERE doc_id % 4 <> 3)
SELECT doc_id AS key, NOT coalesce(CASE WHEN master IS NOT NULL THEN master = 'm0' WHEN etag IS NOT NULL THEN trim(etag, '"') = md5(text) END, false) AS write FROM documents LEFT JOIN s ON key = doc_id""")
def uploads(spark, sf_dir):
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    objects = d.select(k.alias("key"), F.encode("text", "UTF-8").alias("body"), F.lit("m0").alias("master_md5"))
    body = F.when(k % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    stored = d.filter("doc_id % 4 <> 3").select(k.alias("key"), F.concat(F.lit('"'), F.md5(F.encode(body, "UTF-8")), F.lit('"')).alias("etag"), F.when(k % 5 == 0, F.concat(F.lit("m"), (k % 2).cast("string"))).alias("master_md5"))
    return exports.upload_plan(objects, stored)


# samples, first rows, pages


@bound("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25""")
def sampled_documents(spark, sf_dir):
    return lookups.seeded_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25, 7)


@bound("""SELECT source, doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS r FROM documents) WHERE r = 1""")
def shortest_by_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
    return lookups.first_row(d, ["source"], "n", "doc_id").select("source", "doc_id", "digest")


_PAGE = """WITH e AS (SELECT event_id, ts, props LIKE '%"k": 1%' OR props LIKE '%"k":1%' AS cheap, json_extract_string(props, '$.k') = '1' AS exact FROM events)"""


@bound(f"""{_PAGE}, a AS (SELECT event_id, exact FROM e WHERE cheap ORDER BY ts DESC, event_id LIMIT 100), b AS (SELECT event_id FROM e WHERE cheap AND exact ORDER BY ts DESC, event_id LIMIT 100)
SELECT 'cut first' AS how, event_id FROM a WHERE exact UNION ALL SELECT 'exact first', event_id FROM b""")
def matched_pages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    cheap = F.col("props").like('%"k": 1%') | F.col("props").like('%"k":1%')
    page = lambda first: lookups.cut_then_match(e, cheap, F.get_json_object("props", "$.k") == "1", [F.desc("ts"), F.col("event_id")], 100, cut_first=first)
    return page(True).select(F.lit("cut first").alias("how"), "event_id").unionByName(page(False).select(F.lit("exact first").alias("how"), "event_id"))


@bound("""WITH n AS (SELECT doc_id AS target_id, CASE WHEN doc_id % 11 = 0 THEN 7 ELSE 1 + quality END AS score FROM labels), ok AS (SELECT * FROM n WHERE score BETWEEN 1 AND 6)
SELECT target_id, score, CASE WHEN target_id % 2 = 0 THEN 'old' ELSE 'new' END AS created_at, 'new' AS updated_at, CASE WHEN target_id % 2 = 0 THEN 'UPDATE' ELSE 'INSERT' END AS action FROM ok
UNION ALL SELECT doc_id, 3, 'old', 'old', 'KEEP' FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT target_id FROM ok)
UNION ALL SELECT target_id, score, NULL, NULL, 'REJECTED' FROM n WHERE score NOT BETWEEN 1 AND 6""")
def annotations_saved(spark, sf_dir):
    """Annotations are judged first; those with numbers out of range are rejected, the others inserted or updated with their date of creation kept."""
    n = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_id"), F.when(F.col("doc_id") % 11 == 0, 7).otherwise(1 + F.col("quality")).cast("int").alias("score"), F.lit("new").alias("created_at"), F.lit("new").alias("updated_at"))
    none = F.lit(None).cast("int")
    judged = n.withColumn("bad", F.size(artifacts.score_violation(F.col("score"), none, none)) > 0)
    stored = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("target_id"), F.lit(3).alias("score"), F.lit("old").alias("created_at"), F.lit("old").alias("updated_at"))
    saved = changes.merge(stored, judged.filter("not bad"), ["target_id"], ["score", "updated_at"], ["created_at"])
    missing = F.lit(None).cast("string")
    rejected = judged.filter("bad").select("target_id", "score", missing.alias("created_at"), missing.alias("updated_at"), F.lit("REJECTED").alias("action"))
    return saved.select(rejected.columns).unionByName(rejected)


# colours and regions


@bound("SELECT p_partkey, (p_partkey % 256)::INT AS r, (p_partkey * 7 % 256)::INT AS g, (p_partkey * 13 % 256)::INT AS b FROM part")
def lab_round_trip(spark, sf_dir):
    k = F.col("p_partkey")
    back = colors.lab_to_rgb(colors.rgb_to_lab(k % 256, (k * 7) % 256, (k * 13) % 256))
    return read(spark, sf_dir, "part").select("p_partkey", back.alias("c")).select("p_partkey", "c.*")


@bound(f"""WITH g AS (SELECT *, CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS region, v * v AS a, v * 3 AS b FROM ({_GRID})),
i AS (SELECT g.image, g.y, g.x, min(q.region) = max(q.region) AS inside FROM g JOIN g q ON q.image = g.image AND abs(q.y - g.y) <= 1 AND abs(q.x - g.x) <= 1 GROUP BY ALL)
SELECT image, region::INT AS region, count(*) AS area, round_even(avg(v), 6) AS "L", round_even(avg(a), 6) AS a, round_even(avg(b), 6) AS b, count(*) FILTER (inside) AS interior, 6 AS least FROM g JOIN i USING (image, y, x) GROUP BY ALL""")
def region_colors(spark, sf_dir):
    cells = grid(spark, sf_dir).select("image", "y", "x", "region", F.col("v").alias("L"), (F.col("v") * F.col("v")).alias("a"), (F.col("v") * 3).alias("b"))
    found = grids.region_colors(cells, ["L", "a", "b"], 0.1)
    return found.select("image", "region", "area", *(F.bround(c, 6).alias(c) for c in ("L", "a", "b")), "interior", F.col("least").cast("int").alias("least"))


@bound("""WITH q AS (SELECT p_partkey, p_size AS s, p_partkey % 17 AS k FROM part), a AS (SELECT p_partkey, abs(0 * -k - s * 0 + s * s - (s + k) * -k + (s + k) * (s + 2) - 1 * s + 0) / 2.0::DOUBLE AS area FROM q)
SELECT p_partkey, area, row_number() OVER (ORDER BY area DESC, p_partkey) AS place FROM a QUALIFY place <= 20""")
def largest_polygons(spark, sf_dir):
    s, k, zero = F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"), F.lit(0.0)
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (s, -k), (s + k, s), (F.lit(1.0), s + 2))))
    areas = read(spark, sf_dir, "part").select("p_partkey", F.abs(colors.polygon_area(corners)).alias("area"))
    return arrays.largest(areas, "area", "p_partkey", 20)


# review artifacts of JSON that the tables hold


@bound("""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, '{"k":' || k || '}' AS proposal, event_type AS entity_type, CAST(event_id AS VARCHAR) AS entity_id, greatest(0, least(100, 2 * k - 30)) AS score FROM e""")
def enveloped_props(spark, sf_dir):
    """Each event's properties as the proposal of a review artifact, read back from it, with a score clamped to 0..100."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    made = e.select("event_id", artifacts.envelope(F.lit("event_patch"), F.col("event_type"), F.col("event_id").cast("string"), F.col("props"), "merge").alias("a"))
    proposal = artifacts.proposal(F.col("a"))
    score = rules.clamped_score((F.get_json_object(proposal, "$.k").cast("int") * 2 - 30).cast("string")).cast("int")
    return made.select("event_id", proposal.alias("proposal"), F.get_json_object("a", "$.entity_type").alias("entity_type"), F.get_json_object("a", "$.entity_id").alias("entity_id"), score.alias("score"))


@bound("""SELECT l_orderkey AS k, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1""")
def unwrapped_lines(spark, sf_dir):
    """The list of lines found in each order's document, and its quantities."""
    docs = order_documents(spark, sf_dir)[0].select("k", F.from_json(jsonx.unwrap_list(F.to_json("doc")), "array<struct<n:int,q:bigint,f:string>>").alias("l"))
    return docs.select("k", F.size("l").cast("long").alias("lines"), F.aggregate("l.q", F.lit(0).cast("long"), lambda acc, q: acc + q).alias("quantity"))


@bound("""SELECT p_partkey, v.variant FROM part, (VALUES ('A'), ('N'), ('R')) v(variant) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = v.variant AND l_quantity > 45)""")
def variants_unsold(spark, sf_dir):
    """Parts and flags of which no large line exists."""
    there = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("variant"))
    return rules.missing_variants(read(spark, sf_dir, "part"), "p_partkey", ["A", "N", "R"], there)
