"""Edits, lookups, annotations, templates and rules bound to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import artifacts, jsonx, templates
from tessella.operators import changes, edits, images, lookups, rules, trees
from tessella.plans.bound import _GRID, _TREE, bound, grid, read, renamed, tree_rows

# edits of customers, by operations made of orders

_EDIT_OPS = """SELECT o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'replace' WHEN 3 THEN 'remove' ELSE 'what' END AS op,
o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS segment, o_totalprice AS balance FROM orders"""


def edit_ops(spark, sf_dir):
    k = F.col("o_orderkey")
    op = F.when(k % 5 == 0, "add").when(k % 5 == 1, "update").when(k % 5 == 2, "replace").when(k % 5 == 3, "remove").otherwise("what")
    return renamed(read(spark, sf_dir, "orders"), idx="o_orderkey", op=op, id=F.col("o_custkey") + F.when(k % 7 == 0, 1000000).otherwise(0), segment=F.when(k % 2 == 0, F.col("o_orderpriority")), balance="o_totalprice")


def customers(spark, sf_dir):
    return renamed(read(spark, sf_dir, "customer"), id="c_custkey", segment="c_mktsegment", balance="c_acctbal")


def _apply_sql(updates: bool) -> str:
    writes = "(op = 'add' AND NOT there) OR op = 'replace'" + (" OR (op = 'update' AND there)" if updates else "")
    return f"""WITH o AS ({_EDIT_OPS}), v AS (SELECT o.*, c_custkey IS NOT NULL AS there FROM o LEFT JOIN customer ON c_custkey = id),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx DESC) AS r FROM v WHERE {writes} OR (op = 'remove' AND there)) WHERE r = 1)
SELECT coalesce(c_custkey, id) AS id, coalesce(segment, c_mktsegment) AS segment, coalesce(balance, c_acctbal) AS balance FROM customer FULL JOIN l ON c_custkey = id WHERE coalesce(op, '') <> 'remove'"""


@bound(_apply_sql(False))
def cdc_apply_ops(spark, sf_dir):
    cur = customers(spark, sf_dir)
    return edits.apply_ops(changes.validate(edit_ops(spark, sf_dir), cur, "id"), cur, "id", ["segment", "balance"])


@bound(_apply_sql(True))
def cdc_apply_with_updates(spark, sf_dir):
    cur = customers(spark, sf_dir)
    return edits.apply_ops(changes.validate(edit_ops(spark, sf_dir), cur, "id"), cur, "id", ["segment", "balance"], with_updates=True)


@bound("""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) AND p_partkey % 3 <> 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 4 IN (0, 1) AND p_partkey % 3 <> 0 THEN p_size + 1 ELSE p_size END AS p_size,
CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CASE p_partkey % 4 WHEN 0 THEN 'p_name,p_size' WHEN 1 THEN 'p_size' WHEN 2 THEN 'p_name' ELSE '' END END AS changed FROM part""")
def partial_apply(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey") % 4
    none = F.array().cast("array<string>")
    chosen = F.when(k == 0, none).when(k == 1, F.array(F.lit("p_size"))).when(k == 2, F.array(F.lit("p_name"), F.lit("other"))).otherwise(F.array(F.lit("other")))
    proposed = p.filter("p_partkey % 3 <> 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), chosen.alias("chosen"))
    return edits.apply_fields(p, proposed, "p_partkey", ["p_name", "p_size"], "chosen").withColumn("changed", F.array_join("changed", ","))


@bound("""WITH a AS (SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem), r AS (SELECT id, o_orderstatus AS s FROM a LEFT JOIN orders ON o_orderkey = id)
SELECT id, CASE WHEN s IS NULL OR s <> 'O' THEN 'error' WHEN id % 3 = 0 THEN 'rejected' ELSE 'applied' END AS outcome, CASE WHEN s IS NULL THEN 'not_found' WHEN s <> 'O' THEN 'status is ' || s END AS message FROM r""")
def bulk_validate(spark, sf_dir):
    asked = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("id"))
    jobs = renamed(read(spark, sf_dir, "orders"), id="o_orderkey", status="o_orderstatus")
    return edits.bulk_outcome(asked, jobs, "id", "status", "O", F.when(F.col("id") % 3 == 0, "reject").otherwise("apply"))


@bound("""WITH s AS (SELECT l_suppkey, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE CAST(l_partkey + CASE WHEN l_linenumber > 3 THEN 5000000 ELSE 0 END AS VARCHAR) END AS id FROM lineitem)
SELECT l_suppkey, count(*) FILTER (p_partkey IS NULL) AS new, count(*) FILTER (p_partkey IS NOT NULL) AS duplicate FROM s LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = id WHERE trim(id) <> '' GROUP BY l_suppkey""")
def concept_counts(spark, sf_dir):
    key = (F.col("l_partkey") + F.when(F.col("l_linenumber") > 3, 5000000).otherwise(0)).cast("string")
    s = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_partkey") % 11 == 0, " ").otherwise(key).alias("id"))
    return edits.concept_counts(s, "l_suppkey", "id", renamed(read(spark, sf_dir, "part"), id=F.col("p_partkey").cast("string")))


@bound("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'update' WHEN p_partkey % 7 = 0 THEN 'update' WHEN p_partkey % 3 = 0 THEN 'update' ELSE 'skip' END AS state,
array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name' END, CASE WHEN p_partkey % 7 = 0 THEN 'weight' END, CASE WHEN p_partkey % 3 = 0 THEN 'parent' END], lambda x: x IS NOT NULL), ',') AS fields FROM part""")
def cdc_typed_diff(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    cur = renamed(p, id="p_partkey", name="p_name", weight="p_size", keywords=F.split("p_name", " "), parent=F.when(k % 3 == 0, F.col("p_brand")))
    name = F.when(k % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    new = renamed(p, id="p_partkey", name=name, weight=(F.col("p_size") + F.when(k % 7 == 0, 1.5).otherwise(0.5)).cast("double"), keywords=F.reverse(F.split("p_name", " ")), parent=F.lit(" "))
    d = edits.typed_differences(new, cur, "id", texts=["name"], numbers=["weight"], lists=["keywords"], parents=["parent"])
    return d.select("id", "state", F.array_join(F.col("changes.field"), ",").alias("fields"))


@bound("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'generating' WHEN 2 THEN 'draft' WHEN 3 THEN 'prompt_ready' WHEN 4 THEN 'approved' END AS status FROM orders)
SELECT o_orderkey, CASE WHEN status IN ('scheduled', 'generating', 'draft', 'prompt_ready') THEN 'generated' ELSE status END AS status FROM s""")
def output_states(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    status = F.when(k == 0, "scheduled").when(k == 1, "generating").when(k == 2, "draft").when(k == 3, "prompt_ready").when(k == 4, "approved")
    return read(spark, sf_dir, "orders").select("o_orderkey", edits.with_output(status).alias("status"))


@bound("""WITH j AS (SELECT o_orderkey AS id, o_orderpriority AS type, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS image FROM orders),
a AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS image FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey), b AS (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS image FROM lineitem GROUP BY l_orderkey)
SELECT id, type, coalesce(j.image, CASE WHEN type = '1-URGENT' THEN coalesce(a.image, b.image) END) AS image FROM j LEFT JOIN a ON a.l_orderkey = id LEFT JOIN b ON b.l_orderkey = id""")
def fill_from_outputs(spark, sf_dir):
    jobs = renamed(read(spark, sf_dir, "orders"), id="o_orderkey", type="o_orderpriority", image=F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")))
    li = read(spark, sf_dir, "lineitem")
    return edits.fill_from_first(jobs, "image", F.col("type") == "1-URGENT", [(li.filter("l_linenumber > 2"), "l_orderkey", "l_partkey", "l_linenumber"), (li, "l_orderkey", "l_suppkey", "l_linenumber")], "id")


_FORMER = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS prompt,
CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' ' || p_brand || ' ' END AS used, CASE p_partkey % 6 WHEN 0 THEN 'raw' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'approved' WHEN 3 THEN 'rejected' WHEN 4 THEN 'odd' END AS status FROM part"""


@bound(f"""WITH f AS ({_FORMER}) SELECT id, CASE WHEN title IS NULL OR title = '' THEN coalesce(nullif(trim(used), ''), CAST(id AS VARCHAR)) ELSE title END AS title,
CASE WHEN prompt IS NULL OR prompt = '' THEN used ELSE prompt END AS prompt, used, CASE WHEN status IN ('raw', 'reviewed') THEN 'generated' ELSE coalesce(status, 'draft') END AS status FROM f""")
def fill_columns(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.when(k % 6 == 0, "raw").when(k % 6 == 1, "reviewed").when(k % 6 == 2, "approved").when(k % 6 == 3, "rejected").when(k % 6 == 4, "odd")
    title = F.when(k % 4 == 0, "").when(k % 4 > 1, F.col("p_name"))
    used = F.when(k % 5 == 0, " ").when(k % 5 > 1, F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    former = renamed(read(spark, sf_dir, "part"), id="p_partkey", title=title, prompt=F.when(k % 3 == 0, "").otherwise(F.col("p_type")), used=used, status=status)
    return edits.fill_columns(former, "id", "title", "prompt", "used", "status")


@bound("""SELECT l_orderkey AS id, l_suppkey AS tag FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 8 = 0""")
def replace_tags(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    cur = renamed(li, id="l_orderkey", tag="l_suppkey")
    new = renamed(li.filter("l_orderkey % 8 = 0 or l_orderkey % 4 = 1"), id="l_orderkey", tag="l_partkey")
    return edits.replace_sets(cur, "id", new, cur.filter("id % 4 = 0"))


@bound(f"""WITH t AS ({_TREE}) SELECT id, parent FROM t WHERE id NOT IN ('r1', 'n7', 'c5') AND coalesce(parent, '') NOT IN ('r1', 'n7') AND coalesce(parent, '') NOT IN (SELECT id FROM t WHERE parent = 'r1')""")
def cascade_delete(spark, sf_dir):
    t = tree_rows(spark, sf_dir)
    return edits.cascade_delete(t, t.filter("id in ('r1', 'n7', 'c5')")).select("id", "parent")


@bound(f"""WITH t AS ({_TREE}), w AS (SELECT DISTINCT 'c' || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 0 END) AS id FROM orders UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT w.id, (SELECT count(*) FROM orders WHERE 'c' || o_custkey = w.id AND o_orderstatus = 'F') AS orders, (SELECT count(*) FROM supplier WHERE 'n' || s_nationkey = w.id AND s_suppkey % 2 = 0) AS suppliers,
(SELECT count(*) FROM t WHERE parent = w.id) AS children, w.id IN (SELECT id FROM t) AS there FROM w)
SELECT id, orders, suppliers, children, CASE WHEN NOT there THEN 'not_found' WHEN orders + suppliers > 0 THEN 'referenced' WHEN children > 0 THEN 'has_children' ELSE 'deleted' END AS outcome FROM r""")
def guarded_delete(spark, sf_dir):
    t, o = tree_rows(spark, sf_dir), read(spark, sf_dir, "orders")
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    wanted = o.select(key("c", F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 10000000).otherwise(0)).alias("id"))
    wanted = wanted.unionByName(read(spark, sf_dir, "nation").select(key("n", F.col("n_nationkey")).alias("id"))).unionByName(read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(key("c", F.col("c_custkey")).alias("id")))
    refs = {
        "orders": (o.filter("o_orderstatus = 'F'").select(key("c", F.col("o_custkey")).alias("k")), "k"),
        "suppliers": (read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(key("n", F.col("s_nationkey")).alias("k")), "k"),
    }
    return edits.guarded_delete(t, wanted, refs)


_ELIGIBLE = """WITH i AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN NULL ELSE ' ready ' END AS status, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS prompt FROM part),
a AS (SELECT DISTINCT l_partkey + CASE WHEN l_linenumber = 7 THEN 9000000 ELSE 0 END AS id FROM lineitem), j AS (SELECT DISTINCT ps AS id FROM (SELECT l_partkey AS ps, l_linestatus FROM lineitem WHERE l_quantity >= 49) WHERE l_linestatus = 'O'),
e AS (SELECT a.id, CASE WHEN i.id IS NULL THEN 'unknown' WHEN coalesce(trim(status), '') <> 'ready' THEN 'status_' || coalesce(trim(status), 'blank') WHEN trim(prompt) = '' THEN 'empty_prompt' WHEN j.id IS NOT NULL THEN 'active_job' END AS reason
FROM a LEFT JOIN i ON i.id = a.id LEFT JOIN j ON j.id = a.id)"""


def checked_items(spark, sf_dir):
    k, li = F.col("p_partkey"), read(spark, sf_dir, "lineitem")
    items = renamed(read(spark, sf_dir, "part"), id="p_partkey", status=F.when(k % 5 == 0, "draft").when(k % 5 > 1, " ready "), prompt=F.when(k % 7 == 0, " ").otherwise(F.col("p_name")))
    asked = li.select((F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 9000000).otherwise(0)).alias("id"))
    jobs = renamed(li.filter("l_quantity >= 49"), id="l_partkey", status="l_linestatus")
    return edits.eligible(asked, items, "id", "status", "prompt", jobs, "ready", ("O",))


@bound(f"{_ELIGIBLE} SELECT id, reason FROM e")
def eligibility(spark, sf_dir):
    return checked_items(spark, sf_dir)


@bound(f"""{_ELIGIBLE}, h AS (SELECT DISTINCT l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'lineart' ELSE 'pastel' END AS variant FROM lineitem WHERE l_tax = 0)
SELECT e.id, v.variant, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN h.id IS NOT NULL THEN 'skipped' ELSE 'create' END AS outcome, coalesce(reason, CASE WHEN h.id IS NOT NULL THEN 'exists' END) AS reason
FROM e CROSS JOIN (VALUES ('lineart'), ('pastel'), ('flat')) v(variant) LEFT JOIN h ON h.id = e.id AND h.variant = v.variant""")
def variant_plan(spark, sf_dir):
    held = renamed(read(spark, sf_dir, "lineitem").filter("l_tax = 0"), id="l_partkey", variant=F.when(F.col("l_linenumber") % 2 == 0, "lineart").otherwise("pastel"))
    return edits.planned_variants(checked_items(spark, sf_dir), "id", ["lineart", "pastel", "flat"], held)


@bound("""SELECT k.outcome, count(o_orderkey) AS n FROM (VALUES ('changed'), ('already'), ('other')) k(outcome) LEFT JOIN orders ON k.outcome = CASE o_orderstatus WHEN 'F' THEN 'changed' WHEN 'O' THEN 'already' ELSE 'other' END GROUP BY k.outcome""")
def cut_over(spark, sf_dir):
    return edits.cut_over(read(spark, sf_dir, "orders"), "o_orderstatus", "F", "O")[1]


# lookups


@bound("""WITH n(name, rank) AS (VALUES ('the', 2), ('en', 5), ('ion on', 1), ('de', 3), ('sch', 4), ('e', 9)) SELECT b.item_id, arg_min(name, rank) AS match FROM benchmark b LEFT JOIN n ON contains(b.text, name) GROUP BY b.item_id""")
def contained_names(spark, sf_dir):
    names = spark.sql("SELECT * FROM VALUES ('the', 2), ('en', 5), ('ion on', 1), ('de', 3), ('sch', 4), ('e', 9) AS t(name, rank)")
    return lookups.first_contained(read(spark, sf_dir, "benchmark"), "text", names, "name", "rank").select("item_id", "match")


@bound("""WITH n AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS name, min(item_id) AS rank FROM benchmark GROUP BY 1) SELECT d.doc_id, arg_min(name, rank) AS match FROM documents d LEFT JOIN n ON contains(d.text, name) GROUP BY d.doc_id""")
def contained_in_documents(spark, sf_dir):
    """The first item whose two first words a whole document contains."""
    names = read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"), F.col("item_id").alias("rank"))
    return lookups.first_contained(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", names, "name", "rank").select("doc_id", "match")


@bound("""WITH n AS (SELECT p_partkey AS rank, p_name AS file, split_part(p_name, ' ', 1) AS name FROM part WHERE p_partkey % 9 = 0), x AS (SELECT p_partkey, p_name, (SELECT arg_min(name, rank) FROM n WHERE file = p_name) AS exact, (SELECT arg_min(name, rank) FROM n WHERE contains(p_name, name)) AS held FROM part)
SELECT p_partkey, coalesce(exact, held) AS match, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN held IS NOT NULL THEN 'contained' ELSE 'none' END AS how FROM x""")
def exact_or_contained(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = renamed(p.filter("p_partkey % 9 = 0"), rank="p_partkey", file="p_name", name=F.split("p_name", " ")[0])
    return lookups.exact_or_contained(p.select("p_partkey", "p_name"), "p_name", names, "file", "name", "rank").select("p_partkey", "match", "how")


@bound("""WITH q AS (SELECT DISTINCT l_partkey AS k FROM lineitem), a AS (SELECT l_partkey AS k, min(l_returnflag) AS v FROM lineitem WHERE l_quantity = 50 GROUP BY 1), b AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_size < 25)
SELECT q.k, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'export' WHEN b.v IS NOT NULL THEN 'site' END AS source FROM q LEFT JOIN a ON a.k = q.k LEFT JOIN b ON b.k = q.k""")
def ordered_sources(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    asked = li.select(F.col("l_partkey").alias("k")).distinct()
    return lookups.from_sources(asked, "k", {"export": (li.filter("l_quantity = 50"), "l_partkey", "l_returnflag"), "site": (read(spark, sf_dir, "part").filter("p_size < 25"), "p_partkey", "p_brand")})


@bound("""SELECT n_name AS leaf, r_name AS root, 'sub' || r_regionkey AS sub, 's' || r_regionkey AS strategy, CASE WHEN n_nationkey % 2 = 0 THEN 'note ' || n_nationkey END AS note FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4""")
def leaf_dictionary(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    # leaves of a root are as many as a taxonomy file lists
    groups = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("root"), F.concat(F.lit("sub"), "r_regionkey").alias("sub")).agg(F.collect_list("n_name").alias("leaves"))
    strategies = r.filter("r_regionkey <> 4").select(F.concat(F.lit("sub"), "r_regionkey").alias("sub"), F.concat(F.lit("s"), "r_regionkey").alias("strategy"))
    notes = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("leaf"), F.concat(F.lit("note "), "n_nationkey").alias("note"))
    return lookups.dictionary(n.select(F.col("n_name").alias("leaf")), groups, strategies, notes)


@bound("""WITH m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS tier FROM part), x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END AS title, p_size + 100 AS tier FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, CASE WHEN coalesce(m.title, '') = '' AND coalesce(x.title, '') <> '' THEN x.title ELSE m.title END AS title, coalesce(m.tier, x.tier) AS tier FROM m LEFT JOIN x ON k = p_partkey""")
def metadata_merge(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    own = renamed(p, p_partkey="p_partkey", title=F.when(k % 3 == 0, "").when(k % 3 == 2, F.col("p_name")), tier=F.when(k % 2 == 0, F.col("p_size")))
    other = renamed(p.filter("p_partkey % 5 <> 0"), p_partkey="p_partkey", title=F.when(k % 4 != 0, F.col("p_brand")).otherwise(""), tier=F.col("p_size") + 100)
    return lookups.prefer_own(own, other, "p_partkey", ["title", "tier"])


@bound("""WITH t AS (SELECT unnest([' ' || p_brand, '', p_mfgr]) AS tag FROM (SELECT p_brand, split_part(p_name, ' ', 1) AS p_mfgr FROM part) UNION ALL SELECT unnest([split_part(p_name, ' ', 2), ' x ']) FROM part WHERE p_size % 2 = 0) SELECT DISTINCT trim(tag) AS tag FROM t WHERE trim(tag) <> ''""")
def custom_tags(spark, sf_dir):
    word = lambda i: F.split("p_name", " ")[i]
    notes = F.when(F.col("p_size") % 2 == 0, F.to_json(F.array(word(1), F.lit(" x ")))).otherwise(F.concat(F.lit("free text "), "p_name"))
    p = read(spark, sf_dir, "part").select(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(""), word(0)).alias("tags"), notes.alias("notes"))
    return lookups.tag_union(p, "tags", "notes")


@bound("""SELECT p_brand, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand""")
def first_wins(spark, sf_dir):
    return lookups.first_wins(read(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@bound("""WITH o AS (SELECT l_orderkey, l_returnflag || l_linenumber AS name, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS url FROM lineitem)
SELECT l_orderkey, name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE name WHEN 'R2' THEN 1 WHEN 'R1' THEN 2 ELSE 3 END, name) AS r FROM o WHERE url IS NOT NULL) WHERE r = 1""")
def preferred_variant(spark, sf_dir):
    name = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", name.alias("name"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")).alias("url"))
    return lookups.preferred(li, "l_orderkey", "name", "url", ["R2", "R1"]).select("l_orderkey", "name")


@bound("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, -l_quantity + CASE WHEN l_tax > 0.06 THEN 1000 ELSE 0 END, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def best_of_batch(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    verdict = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return lookups.best_of_batch(li, "l_orderkey", "l_linenumber", verdict, -F.col("l_quantity") + F.when(F.col("l_tax") > 0.06, 1000).otherwise(0), F.col("l_linenumber"))


@bound("""SELECT c_custkey, length(c_name) * 10 + c_nationkey AS score FROM customer ORDER BY score DESC, c_custkey LIMIT 10""")
def heuristic_top(spark, sf_dir):
    return lookups.top(read(spark, sf_dir, "customer"), F.length("c_name") * 10 + F.col("c_nationkey"), "c_custkey").select("c_custkey", "score")


@bound("""WITH f AS (SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 're')) SELECT p_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_name LIMIT 12""")
def autocomplete(spark, sf_dir):
    shown, total = lookups.suggestions(read(spark, sf_dir, "part"), "p_name", "RE", 12)
    return shown.join(F.broadcast(total), F.lit(True), "left")  # one row


@bound("""SELECT l_suppkey, chunk, count(*) AS n FROM (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 25 AS chunk FROM lineitem) GROUP BY ALL""")
def request_chunks(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("o"))
    return lookups.chunks(li, "l_suppkey", "o", 25).groupBy("l_suppkey", "chunk").agg(F.count("*").alias("n"))


@bound("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT c_nationkey, array_to_string(list_sort(list(CAST(c_custkey AS VARCHAR)) FILTER (r <= 10)), ',') AS first, count(*) AS n FROM r GROUP BY c_nationkey""")
def inserted_by_root(spark, sf_dir):
    return lookups.inserted_by_root(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


_TERMS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END AS fr, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' a b c' ELSE p_type END AS en FROM part"""


@bound(f"""WITH t AS ({_TERMS}), e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 7000000 END AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE '' END AS fr, p_brand AS en FROM part WHERE p_size > 30),
b AS (SELECT *, coalesce(trim(fr), '') = '' AS nf, coalesce(trim(en), '') = '' AS ne FROM t)
SELECT id, array_to_string(list_filter([CASE WHEN nf OR ne THEN 'missing' END, CASE WHEN NOT nf AND lower(fr) = lower(en) THEN 'same_name' END,
CASE WHEN NOT nf AND NOT ne AND abs(len(string_split(trim(fr), ' ')) - len(string_split(trim(en), ' '))) >= 3 THEN 'word_gap' END, CASE WHEN id IN (SELECT id FROM e) THEN 'duplicate_id' END,
CASE WHEN lower(fr) IN (SELECT lower(fr) FROM e WHERE fr <> '') THEN 'duplicate_fr' END, CASE WHEN lower(en) IN (SELECT lower(en) FROM e) THEN 'duplicate_en' END], lambda x: x IS NOT NULL), ',') AS flags FROM b""")
def term_suspicions(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    t = renamed(p, id="p_partkey", fr=F.when(k % 6 != 0, F.col("p_name")), en=F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat("p_name", F.lit(" a b c"))).otherwise(F.col("p_type")))
    e = renamed(p.filter("p_size > 30"), id=F.when(k % 2 == 0, k).otherwise(k + 7000000), fr=F.when(k % 3 == 0, F.upper("p_name")).otherwise(""), en="p_brand")
    return lookups.suspicions(t, "id", {"fr": "fr", "en": "en"}, e).withColumn("flags", F.array_join("flags", ","))


@bound("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (user_id % 2 = 0) AS even, round_even(avg(value), 2) AS mean_latency FROM events WHERE event_id % 3 <> 0 GROUP BY event_type""")
def validity_counts(spark, sf_dir):
    return lookups.validity(read(spark, sf_dir, "events"), "event_type", F.col("event_id") % 3 != 0, F.col("value"), high=F.col("value") > 50, even=F.col("user_id") % 2 == 0)


@bound(f"""WITH RECURSIVE t AS ({_TREE}), w AS (SELECT id, 1 AS level, [lpad(CAST(length(id) AS VARCHAR), 3, '0') || id] AS k FROM t WHERE id = 'r2' UNION ALL SELECT t.id, w.level + 1, list_append(w.k, lpad(CAST(length(t.id) AS VARCHAR), 3, '0') || t.id) FROM t JOIN w ON t.parent = w.id)
SELECT id, CAST(level AS INT) AS level, CAST(row_number() OVER (ORDER BY k) AS INT) AS place FROM w""")
def subtree_pre_order(spark, sf_dir):
    t = tree_rows(spark, sf_dir)
    return trees.pre_order(t, t.filter("id = 'r2'").select("id"), F.length("id")).select("id", "level", "place")


@bound(f"WITH t AS ({_TREE}) SELECT id, parent FROM t WHERE id IN ('r1', 'n4') OR parent IN ('r1', 'n4')")
def with_children(spark, sf_dir):
    return trees.with_children(tree_rows(spark, sf_dir), ["r1", "n4"]).select("id", "parent")


# annotations and artifacts


def _score_case(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {v}" for k, v in artifacts.SCORES.items()) + " END"


@bound(f"""WITH l AS (SELECT doc_id, CAST(doc_id % 13 AS INT) AS s, CASE WHEN doc_id % 3 = 0 THEN ['3_jambes', 'traits_flous'] WHEN doc_id % 3 = 1 THEN ['nope', 'traits_doubles', 'traits_discontinus'] ELSE [] END AS d, toxic FROM labels)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN s ELSE {_score_case("s")} END AS score, CASE WHEN doc_id % 5 <> 0 AND s BETWEEN 1 AND 10 THEN s END AS score_legacy,
CASE WHEN doc_id % 5 = 0 THEN 'image_flou' ELSE array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'image_anatomie_pb' END, CASE WHEN doc_id % 3 = 0 THEN 'image_flou' END, CASE WHEN doc_id % 3 = 1 THEN 'image_traits_pb' END, CASE WHEN toxic = 1 THEN 'image_complexe' END], lambda x: x IS NOT NULL), ',') END AS image_tags,
CASE WHEN doc_id % 5 <> 0 AND toxic = 1 THEN 'prompt_ambigu' ELSE '' END AS prompt_tags, CASE WHEN doc_id % 5 = 0 THEN '' WHEN toxic = 1 THEN 'own' WHEN doc_id % 7 = 0 THEN 'free note' ELSE '' END AS custom_tags,
CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN s NOT BETWEEN 1 AND 10 THEN 'score out of [1,10]: ' || s END, CASE WHEN doc_id % 3 = 1 THEN 'unknown defect: nope' END], lambda x: x IS NOT NULL), ';') END AS anomalies FROM l""")
def annotation_migration(spark, sf_dir):
    k, lab = F.col("doc_id"), read(spark, sf_dir, "labels")
    none = F.array().cast("array<string>")
    defects = F.when(k % 3 == 0, F.array(F.lit("3_jambes"), F.lit("traits_flous"))).when(k % 3 == 1, F.array(F.lit("nope"), F.lit("traits_doubles"), F.lit("traits_discontinus"))).otherwise(none)
    notes = F.when(F.col("toxic") == 1, F.to_json(F.array(F.lit("trop_chargé"), F.lit("prompt_trop_vague"), F.lit("own"), F.lit("own")))).when(k % 7 == 0, F.lit(" free note "))
    former = F.to_json(F.struct((k % 13).cast("int").alias("score"), defects.alias("defects"), notes.alias("notes")))
    present = F.to_json(F.struct((k % 13).cast("int").alias("score"), F.array(F.lit("image_flou")).alias("image_tags")))
    m = lab.select("doc_id", artifacts.migrate_annotation(F.when(k % 5 == 0, present).otherwise(former)).alias("m"))
    joined = lambda c, by=",": F.array_join(f"m.{c}", by).alias(c)
    return m.select("doc_id", "m.score", "m.score_legacy", joined("image_tags"), joined("prompt_tags"), joined("custom_tags"), joined("anomalies", ";"))


@bound("""WITH l AS (SELECT doc_id, CAST(doc_id % 9 AS INT) AS s, quality, toxic FROM labels)
SELECT doc_id, CASE WHEN doc_id % 6 <> 0 AND doc_id % 10 <> 0 THEN s END AS score, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE quality = 1 END AS pattern, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN quality = 1 THEN 'n' ELSE '' END AS pattern_note,
CASE WHEN doc_id % 6 <> 0 AND doc_id % 4 <> 0 THEN toxic = 0 END AS publishable,
CASE WHEN doc_id % 6 = 0 THEN 'entry not an object' ELSE array_to_string(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'score wrong type: x' WHEN s NOT BETWEEN 1 AND 6 THEN 'score out of [1,6]: ' || s END, CASE WHEN toxic = 1 THEN 'unknown image_tag: b' END], lambda x: x IS NOT NULL), ';') END AS anomalies FROM l""")
def annotation_rows(spark, sf_dir):
    k, lab = F.col("doc_id"), read(spark, sf_dir, "labels")
    flags = F.struct((F.col("quality") == 1).alias("pattern"), F.lit("n").alias("pattern_note"), F.when(k % 4 != 0, F.col("toxic") == 0).alias("publishable"))
    tags = F.when(F.col("toxic") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    with_score = lambda score: F.to_json(F.struct(score.alias("score"), tags.alias("image_tags"), flags.alias("flags")))
    entry = F.when(k % 6 == 0, F.lit("[1]")).when(k % 10 == 0, with_score(F.lit("x"))).otherwise(with_score((k % 9).cast("int")))
    return lab.select("doc_id", artifacts.annotation_row(entry, ["a"], ["p"]).alias("r")).select("doc_id", "r.score", "r.pattern", "r.pattern_note", "r.publishable", F.array_join("r.anomalies", ";").alias("anomalies"))


@bound("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 8 NOT BETWEEN 1 AND 6 THEN 'score not in [1,6]' END, CASE WHEN p_size % 12 NOT BETWEEN 1 AND 10 AND p_size % 12 <> 11 THEN 'score_legacy not in [1,10]' END, CASE WHEN p_partkey % 9 > 6 THEN 'note not in [0,6]' END], lambda x: x IS NOT NULL), ';') AS violations FROM part""")
def annotation_ranges(spark, sf_dir):
    legacy = F.when(F.col("p_size") % 12 != 11, F.col("p_size") % 12)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(artifacts.score_violation(F.col("p_partkey") % 8, legacy, F.col("p_partkey") % 9), ";").alias("violations"))


@bound("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '{}' ELSE '{"name":"' || p_name || '"}' END AS proposal, 'merge' AS mode FROM part""")
def artifact_envelopes(spark, sf_dir):
    given = F.when(F.col("p_partkey") % 3 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct(F.col("p_name").alias("name"))))
    made = read(spark, sf_dir, "part").select("p_partkey", artifacts.envelope(F.lit("term_patch"), F.lit("term"), F.col("p_partkey").cast("string"), given, "merge").alias("a"))
    return made.select("p_partkey", artifacts.proposal(F.col("a")).alias("proposal"), F.get_json_object("a", "$.apply_plan.mode").alias("mode"))


@bound("""SELECT p_partkey, '{' || array_to_string(list_filter(['"name_i18n":{' || CASE WHEN p_partkey % 2 = 0 THEN '"en":"' || p_name || '",' ELSE '' END || '"fr":"' || p_type || '"}', CASE WHEN p_size > 25 THEN '"description_i18n":{"ar":"' || p_brand || '"}' END, CASE WHEN p_partkey % 3 = 0 THEN '"keywords":"k"' END], lambda x: x IS NOT NULL), ',') || '}' AS proposal FROM part""")
def nested_proposals(spark, sf_dir):
    k = F.col("p_partkey")
    flat = F.create_map(F.lit("name_fr"), F.concat(F.lit(" "), "p_type"), F.lit("name_en"), F.when(k % 2 == 0, F.col("p_name")).otherwise(" "), F.lit("description_ar"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("keywords"), F.when(k % 3 == 0, "k").otherwise(""), F.lit("other"), F.lit("x"))
    return read(spark, sf_dir, "part").select("p_partkey", artifacts.nested_proposal(flat).alias("proposal"))


@bound("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '["a"]' WHEN 1 THEN '["b"]' WHEN 2 THEN '["c"]' END AS list FROM part""")
def unwrapped_lists(spark, sf_dir):
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, '["a"]').when(k == 1, '{"x":1,"items":["b"]}').when(k == 2, '{"x":1,"what":["c"]}').otherwise('{"x":{"y":1}}')
    return read(spark, sf_dir, "part").select("p_partkey", jsonx.unwrap_list(given).alias("list"))


# templates and rules


@bound("""SELECT p_partkey, '{' || p_name || '} by ' || p_brand || ', size ' || CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS prompt FROM part""")
def filled_templates(spark, sf_dir):
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", templates.fill("{{{name}}} by {brand}, size {size}", name=F.col("p_name"), brand=F.col("p_brand"), size=size).alias("prompt"))


@bound(r"""SELECT p_partkey, '---' || chr(10) || 'title: "' || p_name || ' \"x\""' || chr(10) || 'size: ' || p_size || chr(10) || 'tags:' || CASE WHEN p_partkey % 2 = 0 THEN ' []' ELSE chr(10) || '  - "' || p_brand || '"' || chr(10) || '  - "b"' END || chr(10) || '---' || chr(10) AS matter FROM part""")
def front_matter(spark, sf_dir):
    tags = F.when(F.col("p_partkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_brand"), F.lit("b")))
    return read(spark, sf_dir, "part").select("p_partkey", templates.front_matter({"title": F.concat("p_name", F.lit(' "x"'))}, {"tags": tags}, {"size": F.col("p_size")}).alias("matter"))


_RULES = [
    templates.Rule("halo", "append", patterns=("BOLT", "gear"), text=", plain background"),
    templates.Rule("finish", "replace", phrases={"cold": "warm", "widget": ""}),
    templates.Rule("count", "regex", pattern=r"\b(small|large)\s+(\w+)", text="one $2", skip=("bolt",)),
]


@bound(r"""WITH a AS (SELECT p_partkey, p_name AS t0, CASE WHEN contains(p_name, 'bolt') OR contains(p_name, 'gear') THEN p_name || ', plain background' ELSE p_name END AS t1 FROM part),
b AS (SELECT *, regexp_replace(regexp_replace(t1, 'cold', 'warm', 'gi'), 'widget', '', 'gi') AS t2 FROM a), c AS (SELECT *, CASE WHEN regexp_matches(t2, '(?i)\b(small|large)\s+bolt\b') THEN t2 ELSE regexp_replace(t2, '(?i)\b(small|large)\s+(\w+)', 'one \2', 'g') END AS t3 FROM b)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(t3, '\s+,', ',', 'g'), '\s{2,}', ' ', 'g'), ',\s*,', ',', 'g')) AS prompt,
array_to_string(list_filter([CASE WHEN t1 <> t0 THEN 'halo:append' END, CASE WHEN contains(t1, 'cold') THEN 'finish:replace' END, CASE WHEN contains(t1, 'widget') THEN 'finish:replace' END, CASE WHEN t3 <> t2 THEN 'count:regex' END], lambda x: x IS NOT NULL), ',') AS log FROM c""")
def logged_rewriting(spark, sf_dir):
    r = read(spark, sf_dir, "part").select("p_partkey", templates.rewrite(F.col("p_name"), _RULES).alias("r"))
    return r.select("p_partkey", F.col("r.text").alias("prompt"), F.array_join(F.transform("r.log", lambda e: F.concat(e["rule"], F.lit(":"), e["action"])), ",").alias("log"))


@bound("""WITH l AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) || CASE WHEN p_partkey % 5 = 0 THEN '_chart' ELSE '' END AS leaf FROM part)
SELECT p_partkey, CASE WHEN contains(leaf, 'chart') THEN NULL WHEN starts_with(leaf, 'small_') THEN 'small' WHEN starts_with(leaf, 'large_') THEN 'large' WHEN starts_with(leaf, 'cold_') THEN 'cold' END AS name FROM l""")
def leading_names(spark, sf_dir):
    leaf = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 5 == 0, "_chart").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", templates.leading_name(leaf, ("small", "large", "cold")).alias("name"))


@bound("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size ELSE 1024 END AS w, CASE p_size % 4 WHEN 0 THEN p_size + 1 ELSE 1024 END AS h, CASE WHEN p_size % 3 <> 0 THEN round_even(p_size::DOUBLE / (p_size % 3 * 100), 4) END AS ratio FROM part""")
def resolutions(spark, sf_dir):
    s = F.col("p_size")
    c = F.when(s % 4 == 0, F.concat(s.cast("string"), F.lit(" x "), (s + 1).cast("string"))).when(s % 4 == 1, F.lit("big")).when(s % 4 == 2, F.lit("12x")).otherwise(F.lit(None).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", templates.resolution(c).alias("r"), templates.size_ratio(s % 3 * 100, s).alias("ratio")).select("p_partkey", "r.w", "r.h", "ratio")


@bound("""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, source AS card, text AS body, list_resize(['a', 'b', 'c', 'd', 'e', 'f'], CAST(4 + doc_id % 3 AS INT)) AS k FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(length(title), 0) NOT BETWEEN 40 AND 60 THEN 'title_len=' || coalesce(length(title), 0) END, CASE WHEN length(card) > 30 THEN 'title_card_len=' || length(card) END,
CASE WHEN coalesce(length(body), 0) NOT BETWEEN 80 AND 130 THEN 'description_len=' || coalesce(length(body), 0) END, CASE WHEN len(k) <> 5 THEN 'keywords_count=' || len(k) END], lambda x: x IS NOT NULL), ';') AS en,
array_to_string(list_filter([CASE WHEN coalesce(length(title), 0) NOT BETWEEN 25 AND 55 THEN 'title_len=' || coalesce(length(title), 0) END, CASE WHEN length(card) > 25 THEN 'title_card_len=' || length(card) END,
CASE WHEN coalesce(length(body), 0) NOT BETWEEN 40 AND 115 THEN 'description_len=' || coalesce(length(body), 0) END, CASE WHEN len(k) <> 5 THEN 'keywords_count=' || len(k) END, 'latin_chars_in_ar'], lambda x: x IS NOT NULL), ';') AS ar FROM d""")
def content_bounds(spark, sf_dir):
    keywords = F.slice(F.array(*(F.lit(c) for c in "abcdef")), F.lit(1), (4 + F.col("doc_id") % 3).cast("int"))
    fields = (F.get(F.split("text", "\n"), 0), F.col("source"), F.col("text"), keywords)
    return read(spark, sf_dir, "documents").select("doc_id", *(F.array_join(rules.content_violations(loc, *fields), ";").alias(loc) for loc in ("en", "ar")))


@bound("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'config not an object' ELSE CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'prompt required' END WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN 'count not in [1,15]' END
WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'items required' WHEN event_id % 4 = 2 THEN 'items over 10' END WHEN 3 THEN CASE WHEN event_id % 4 = 3 THEN 'target_vocabulary_id required' END WHEN 4 THEN 'concepts or term required' ELSE 'unknown type' END END AS error FROM events""")
def enqueue_errors(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda *kinds: F.get(F.array(*(F.lit(x) for x in kinds)), (k % 6).cast("int"))
    kind = pick("text_enrichment", "image_generate_concepts", "image_prompts_bulk", "taxonomy_generate_vocabulary", "image_generate_prompts", "what")
    many = "[" + ",".join("1" * 11) + "]"
    config = (
        F.when(k % 11 == 0, "[]")
        .when(k % 6 == 0, F.when(k % 4 == 0, '{"prompt":" "}').otherwise('{"prompt":"p"}'))
        .when(k % 6 == 1, F.when(k % 4 == 1, '{"theme":"t","count":16}').otherwise('{"theme":"t","count":15}'))
        .when(k % 6 == 2, F.when(k % 4 == 0, '{"items":[]}').otherwise('{"items":%s}' % many))
        .when(k % 6 == 3, F.when(k % 4 == 3, '{"theme":"t"}').otherwise('{"theme":"t","vocabulary_id":"v"}'))
        .otherwise('{"term_id":"t"}')
    )
    return read(spark, sf_dir, "events").select("event_id", rules.enqueue_error(kind, config).alias("error"))


@bound("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN least(100, p_size * 3) WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 100 END AS score FROM part""")
def clamped_scores(spark, sf_dir):
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "true").when(k == 1, "garbage").when(k == 2, (F.col("p_size") * 3).cast("string")).when(k == 3, "-5").when(k == 4, F.lit(None).cast("string")).otherwise("250")
    return read(spark, sf_dir, "part").select("p_partkey", rules.clamped_score(raw).cast("int").alias("score"))


@bound("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'flat' ELSE 'lineart,pastel' END AS variants FROM nation""")
def active_variants(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    overrides = spark.sql("SELECT 0 AS category, CAST(array() AS array<string>) AS names UNION ALL SELECT 1, array('flat', 'gone')")
    return rules.active_variants(n, "n_regionkey", ["lineart", "pastel", "flat"], ["lineart", "pastel"], overrides).select("n_nationkey", F.array_join("variants", ",").alias("variants"))


@bound("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'not an object' WHEN 2 THEN 'missing output_kind,missing extract_preset' WHEN 3 THEN 'prompt_style,chromakey_rgb missing,label' ELSE 'force_chromakey,chromakey_rgb,extract_preset' END AS errors FROM part""")
def registry_errors(spark, sf_dir):
    k = F.col("p_partkey") % 5
    v = (
        F.when(k == 0, '{"label":"a","prompt_style":"pastel","output_kind":"png","force_chromakey":true,"chromakey_rgb":[0,177,64],"extract_preset":"kids"}')
        .when(k == 1, "[1]")
        .when(k == 2, '{"label":"a","prompt_style":"pastel","force_chromakey":true,"chromakey_rgb":[0,1,2]}')
        .when(k == 3, '{"label":" ","prompt_style":"odd","output_kind":"png","force_chromakey":true,"chromakey_rgb":null,"extract_preset":null}')
        .otherwise('{"label":"a","prompt_style":"pastel","output_kind":"png","force_chromakey":"yes","chromakey_rgb":[0,1,999],"extract_preset":"no"}')
    )
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(rules.variant_errors(v, ("pastel",), ("png",), ("kids",)), ",").alias("errors"))


# pixels


_CELLS = f"""WITH g AS (SELECT *, CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS region, CAST(v < -0.05 AS INT) AS dark FROM ({_GRID})),
near AS (SELECT g.image, g.y, g.x, q.region AS r, q.dark AS d FROM g JOIN g q ON q.image = g.image AND abs(q.y - g.y) <= 1 AND abs(q.x - g.x) <= 1)"""


@bound(f"{_CELLS} SELECT image, region, count(*) AS interior FROM (SELECT image, y, x, min(r) AS region FROM near GROUP BY ALL HAVING min(r) = max(r)) GROUP BY ALL")
def interior_counts(spark, sf_dir):
    inside = images.interior(grid(spark, sf_dir)).filter("interior")
    return inside.groupBy("image", "region").agg(F.count("*").alias("interior"))


@bound(f"""{_CELLS}, grown AS (SELECT image, y, x, max(d) AS m FROM near GROUP BY ALL), closed AS (SELECT a.image, a.y, a.x, min(b.m) AS m FROM grown a JOIN grown b ON b.image = a.image AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL)
SELECT g.image, g.region, round_even(avg(m), 6) AS overlap, avg(m) >= 0.5 AS ink FROM g JOIN closed USING (image, y, x) GROUP BY ALL""")
def ink_regions(spark, sf_dir):
    lines = images.line_mask(grid(spark, sf_dir), "v", -0.05)
    return images.ink_regions(lines, "line").withColumn("overlap", F.bround("overlap", 6))


@bound("""SELECT p_partkey, p_partkey % 9 < 2 AS key FROM part""")
def key_masks(spark, sf_dir):
    k = F.col("p_partkey") % 9
    return read(spark, sf_dir, "part").select("p_partkey", images.key_mask(k * 20, 177 - k * 10, 64 + k * 15, 20.0).alias("key"))


@bound(f"""{_CELLS}, i AS (SELECT image, region, avg(v) > 0.05 AS ink, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT image, string_agg('c' || region || ':' || n, ',' ORDER BY region) AS crayons FROM i WHERE NOT ink GROUP BY image) SELECT image, crayons FROM c""")
def crayon_counts(spark, sf_dir):
    g = grid(spark, sf_dir)
    ink = g.groupBy("image", "region").agg((F.avg("v") > 0.05).alias("ink"))
    marked = g.join(ink, ["image", "region"]).withColumn("color", F.concat(F.lit("c"), F.col("region").cast("string")))
    found = images.crayons(marked, "color", "ink")
    return found.select("image", F.array_join(F.transform(F.array_sort(F.map_entries("crayons")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("crayons"))


@bound("""SELECT vec_id // 10 AS image, coalesce(round_even(median(CAST(label AS DOUBLE)) FILTER (vec_id % 3 <> 0 AND label > 2), 4), 0.0) AS median_delta FROM embeddings GROUP BY 1""")
def median_differences(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("image"), F.col("label").cast("double").alias("delta"), ((F.col("vec_id") % 3 == 0) | (F.col("label") <= 2)).alias("out"))
    return images.median_difference(e, "delta", F.col("out"))
