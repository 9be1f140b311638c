"""Queries over the change log, merging, jobs and pages found in pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import jobs, names, replicate, tone, vision
from tallyloom.plans.registry import query
from tallyloom.sources.adapter import Domain

PULLED = ["kind", "id", "updated_at", "deleted_at", "rev", "payload"]


@query("lww_resolve", "SELECT kind, id, updated_at, deleted_at, rev, payload FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY updated_at DESC, deleted_at <> 0 DESC, payload DESC, rev) AS r FROM changes) WHERE r = 1")
def lww_resolve(d: Domain) -> DataFrame:
    return replicate.resolve(d.changes.select(*PULLED))


@query("pull_page", "SELECT kind, id, rev FROM changes WHERE rev > 123 ORDER BY rev LIMIT 500")
def pull_page(d: Domain) -> DataFrame:
    return replicate.pull(d.changes, 123, 500).select("kind", "id", "rev")


@query("pending_counts", "SELECT kind, count(*) AS n FROM changes WHERE rev > 123 GROUP BY ROLLUP (kind)")
def pending_counts(d: Domain) -> DataFrame:
    return replicate.pending(d.changes, 123)


@query("entity_stats", "SELECT kind, count(*) AS n, count(*) FILTER (deleted_at <> 0) AS deleted FROM changes GROUP BY 1")
def entity_stats(d: Domain) -> DataFrame:
    return d.changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("deleted_at") != 0).alias("deleted"))


@query("pending_changes", "SELECT kind, count(*) AS n FROM changes WHERE rev % 10 = 0 GROUP BY 1")
def pending_changes(d: Domain) -> DataFrame:
    return d.changes.where("rev % 10 = 0").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = ", stored AS (SELECT kind, id, updated_at, deleted_at, payload FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY updated_at DESC, deleted_at <> 0 DESC, payload DESC, rev) AS r FROM changes WHERE rev % 2 = 0) WHERE r = 1), incoming AS (SELECT * FROM changes WHERE rev % 2 = 1)"
_OUTCOME = "CASE WHEN s.id IS NULL OR (i.updated_at, i.deleted_at <> 0, i.payload) > (s.updated_at, s.deleted_at <> 0, s.payload) THEN 'applied' ELSE 'stale' END"


def _outcomes(d: Domain) -> DataFrame:
    return replicate.outcomes(d.changes.where("rev % 2 = 1"), replicate.resolve(d.changes.where("rev % 2 = 0").select(*PULLED)))


@query("push_outcome", _SPLIT + f" SELECT i.rev, {_OUTCOME} AS outcome FROM incoming i LEFT JOIN stored s ON i.kind = s.kind AND i.id = s.id")
def push_outcome(d: Domain) -> DataFrame:
    return _outcomes(d).select("rev", "outcome")


@query("push_counts", _SPLIT + f" SELECT {_OUTCOME} AS outcome, count(*) AS n FROM incoming i LEFT JOIN stored s ON i.kind = s.kind AND i.id = s.id GROUP BY 1")
def push_counts(d: Domain) -> DataFrame:
    return _outcomes(d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("push_validate", "SELECT rev, CASE WHEN kind NOT IN ('view', 'click', 'purchase') THEN 'kind' WHEN rev % 7 = 0 THEN 'id' WHEN rev % 11 = 0 THEN 'meta' WHEN kind = 'click' AND id % 3 <> 0 THEN 'secret' WHEN kind = 'click' AND rev % 5 = 0 THEN 'value' WHEN rev % 13 = 0 THEN 'size' END AS reason FROM changes")
def push_validate(d: Domain) -> DataFrame:
    r = F.col("rev")
    record = F.when(r % 7 == 0, F.repeat(F.lit("x"), 129)).otherwise(F.col("id").cast("string"))
    payload = F.when(r % 13 == 0, F.repeat(F.lit("x"), replicate.PAYLOAD_MOST + 1)).otherwise(F.col("payload"))
    record = F.when((F.col("kind") == "click") & (r % 7 != 0), F.when(F.col("id") % 3 == 0, "apiKey").otherwise("other")).otherwise(record)
    kind = F.replace("kind", F.lit("click"), F.lit("secrets"))
    value = F.repeat(F.lit("x"), F.when(r % 5 == 0, replicate.SECRET_MOST + 1).otherwise(8))
    return d.changes.select("rev", replicate.rejected(kind, record, F.when(r % 11 != 0, F.col("updated_at")), F.col("deleted_at"), payload, ("view", "secrets", "purchase"), ("apiKey",), value).alias("reason"))


_AS_KINDS = {"signup": "companies", "purchase": "receipts", "click": "items", "view": "categories", "error": "tags"}


@query("assign_rev", """, named AS (SELECT rev, CASE kind WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 WHEN 'error' THEN 5 END AS place FROM changes)
SELECT rev, 100 + row_number() OVER (ORDER BY place NULLS LAST, rev) AS new_rev FROM named""")
def assign_rev(d: Domain) -> DataFrame:
    """Event types stand for kinds, whose order is companies, receipts, items, categories, tags."""
    name = F.create_map(*[F.lit(x) for kv in _AS_KINDS.items() for x in kv])
    changes = d.changes.withColumn("kind", F.coalesce(F.try_element_at(name, F.col("kind")), F.lit("other")))
    return replicate.revisions(changes, 100, "rev", ranges=7).select("rev", "new_rev")


@query("server_write", """, named AS (SELECT rev AS seq, CASE kind WHEN 'purchase' THEN 'receipts' ELSE 'items' END AS kind, id FROM changes)
SELECT kind, id, 7000 + row_number() OVER (ORDER BY kind = 'items', seq) AS rev, 'server' AS device FROM named""")
def server_write(d: Domain) -> DataFrame:
    rows = d.changes.withColumnRenamed("rev", "seq").withColumn("kind", F.when(F.col("kind") == "purchase", "receipts").otherwise("items"))
    log = d.changes.withColumn("device", F.lit(None).cast("string")).drop("value")
    return replicate.written_by_server(log, rows.drop("value"), 7000).select("kind", "id", "rev", "device")


@query("page_cursor", ", p AS (SELECT rev FROM changes WHERE rev > 123 ORDER BY rev LIMIT 500) SELECT rev, (SELECT max(rev) FROM p) AS cursor, (SELECT max(rev) FROM changes) > (SELECT max(rev) FROM p) AS has_more FROM p")
def page_cursor(d: Domain) -> DataFrame:
    return replicate.page_with_cursor(d.changes, 123, 500).select("rev", "cursor", "has_more")


@query("ack_push", ", w AS (SELECT kind, id, max(updated_at) AS updated_at FROM changes GROUP BY 1, 2) SELECT kind, id, CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN 0 ELSE 1 END AS dirty FROM w")
def ack_push(d: Domain) -> DataFrame:
    now = d.changes.groupBy("kind", "id").agg(F.max("updated_at").alias("updated_at"), F.max("rev").alias("rev")).withColumn("dirty", F.lit(1))
    snapshot = now.withColumn("updated_at", F.col("updated_at") - F.col("id") % 2)
    results = now.select("kind", "id", F.when(F.col("id") % 3 == 0, "rejected").otherwise("applied").alias("outcome"), F.lit(7).cast("bigint").alias("new_rev"))
    return replicate.acknowledge(snapshot, now, results).select("kind", "id", "dirty")


@query("apply_remote", """, l AS (SELECT replace(kind, 'purchase', 'receipts') AS kind, id, max(updated_at) AS u FROM changes WHERE rev % 3 = 0 GROUP BY 1, 2), r AS (SELECT replace(kind, 'purchase', 'receipts') AS kind, id, max(updated_at) AS u FROM changes WHERE rev % 3 = 1 GROUP BY 1, 2)
SELECT coalesce(l.kind, r.kind) AS kind, coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'local' WHEN l.id IS NULL OR l.id % 2 = 0 THEN 'remote' WHEN l.kind = 'receipts' AND r.id % 5 = 1 THEN 'merge' WHEN r.u > l.u THEN 'remote' ELSE 'keep' END AS chosen FROM l FULL JOIN r ON l.kind = r.kind AND l.id = r.id""")
def apply_remote(d: Domain) -> DataFrame:
    side = lambda n: d.changes.where(F.col("rev") % 3 == n).groupBy("kind", "id").agg(F.max("updated_at").alias("updated_at")).select("*", F.lit(0).cast("bigint").alias("deleted_at"), F.lit("").alias("payload"), (F.col("id") % 2).alias("dirty")).withColumn("kind", F.replace("kind", F.lit("purchase"), F.lit("receipts")))
    return replicate.apply_remote(side(0), side(1).withColumn("machine", F.col("id") % 5 == 1))


@query("sync_status", "SELECT user_id AS id, max(event_id) % 2 = 0 OR max(event_id) > 9000 AS diverged, CASE WHEN max(event_id) % 2 = 0 OR max(event_id) > 9000 THEN 0 ELSE max(event_id) END AS next FROM events GROUP BY 1", plain=True)
def sync_status(d: Domain) -> DataFrame:
    c = d.table("events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("cursor"))
    return replicate.sync_status(c.withColumn("epoch", F.when(F.col("cursor") % 2 == 0, "old").otherwise("now")), "now", 9000).select("id", "diverged", "next")




@query("merge_enrichment", """SELECT id, CASE WHEN id % 2 = 0 THEN city WHEN deleted_at = 0 AND status <> 'confirmed' AND id % 3 <> 0 THEN 'found' END AS city,
  CASE WHEN deleted_at <> 0 THEN 'deleted' WHEN status = 'confirmed' THEN 'confirmed' WHEN id % 2 = 0 OR id % 3 = 0 THEN 'nothing-new' END AS skipped,
  CASE WHEN deleted_at = 0 AND status = 'failed' AND id % 2 = 1 AND id % 3 <> 0 THEN 'parsed' ELSE status END AS status FROM receipts""")
def merge_enrichment(d: Domain) -> DataFrame:
    r = d.receipts.select("id", "deleted_at", "status", F.when(F.col("id") % 2 == 0, F.col("city")).alias("city"))
    found = d.receipts.select("id", F.when(F.col("id") % 3 != 0, "found").alias("city"))
    return replicate.enrich(r, found, ("city",)).select("id", "city", "skipped", "status")


@query("merge_incoming", """SELECT id, CASE WHEN status = 'confirmed' THEN CASE WHEN id % 2 = 0 THEN city END WHEN id % 2 = 0 THEN city ELSE 'remote' END AS city,
  CASE WHEN status = 'confirmed' THEN updated_at ELSE greatest(updated_at, id * 10 + 3) + 1 END AS updated_at FROM receipts WHERE deleted_at = 0 AND id % 3 = 0 AND id % 5 <> 0""")
def merge_incoming(d: Domain) -> DataFrame:
    i = F.col("id")
    local = d.receipts.select("id", "status", "deleted_at", "updated_at", F.lit(1).alias("rev"), (i % 3 == 0).cast("int").alias("dirty"), F.when(i % 2 == 0, F.col("city")).alias("city"))
    remote = d.receipts.select("id", F.lit(0).alias("deleted_at"), F.lit(9).alias("rev"), (i * 10 + 3).alias("updated_at"), (i % 5 != 0).alias("machine"), F.lit("remote").alias("city"))
    return replicate.merge_incoming(local, remote, ("city",)).select("id", "city", "updated_at")


def _jobs(d: Domain) -> DataFrame:
    i = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "done", "failed")]), (i % 4 + 1).cast("int"))
    return d.table("events").select(i.alias("receipt_id"), state.alias("state"), (i * 37 % 1000).alias("next_attempt_at"), F.when(i % 3 == 0, F.col("event_type")).alias("last_error"), (i * 13 % 5000).alias("updated_at"), (i % 4).cast("int").alias("attempts"), F.concat(F.lit("i"), (i % 5).cast("string")).alias("image_id"))


_JOBS = "WITH jobs AS (SELECT event_id AS receipt_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS state, event_id * 37 % 1000 AS next_attempt_at, CASE WHEN event_id % 3 = 0 THEN event_type END AS last_error, event_id * 13 % 5000 AS updated_at, CAST(event_id % 4 AS INTEGER) AS attempts, 'i' || (event_id % 5) AS image_id FROM events) "


@query("claim_batch", _JOBS + "SELECT receipt_id FROM jobs WHERE state = 'pending' AND next_attempt_at <= 400 ORDER BY next_attempt_at, receipt_id LIMIT 4", plain=True)
def claim_batch(d: Domain) -> DataFrame:
    return jobs.claim(_jobs(d), 400, 4).select("receipt_id")


@query("queue_counts", _JOBS + "SELECT s AS state, count(receipt_id) AS n, count(*) FILTER (state = 'pending' AND next_attempt_at > 400) AS waiting FROM (SELECT unnest(['pending', 'running', 'done', 'failed', 'skipped']) AS s) LEFT JOIN jobs ON s = state GROUP BY 1", plain=True)
def queue_counts(d: Domain) -> DataFrame:
    return jobs.counts(_jobs(d), 400)


@query("recent_failures", _JOBS + "SELECT receipt_id, last_error FROM jobs WHERE last_error IS NOT NULL AND state IN ('failed', 'pending') ORDER BY updated_at DESC, receipt_id LIMIT 5", plain=True)
def recent_failures(d: Domain) -> DataFrame:
    return jobs.recent_failures(_jobs(d)).select("receipt_id", "last_error")


@query("queue_transition", _JOBS + "SELECT receipt_id, CASE receipt_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN CASE WHEN receipt_id % 2 = 0 OR attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN 3 THEN 'pending' ELSE state END AS state, CASE receipt_id % 5 WHEN 2 THEN attempts + 1 WHEN 3 THEN 0 ELSE attempts END AS attempts FROM jobs", plain=True)
def queue_transition(d: Domain) -> DataFrame:
    i = F.col("receipt_id")
    event = F.element_at(F.array(*[F.lit(e) for e in ("succeed", "skip", "fail", "requeue", "none")]), (i % 5 + 1).cast("int"))
    return _jobs(d).select("receipt_id", jobs.after(F.col("state"), F.col("attempts"), event, i % 2 == 1).alias("n")).select("receipt_id", "n.state", "n.attempts")


@query("enqueue", "SELECT id FROM live LEFT JOIN (SELECT event_id, 'i' || (event_id % 5) AS image FROM events) e ON e.event_id = id WHERE e.event_id IS NULL OR image <> 'i' || (id % 3) ORDER BY id LIMIT 200")
def enqueue(d: Domain) -> DataFrame:
    r = d.live.select("id", F.concat(F.lit("i"), (F.col("id") % 3).cast("string")).alias("image_id"), F.col("id").alias("rev"))
    return jobs.enqueue(r, _jobs(d), 200).select("id")


@query("needs_extraction", "SELECT id FROM live WHERE status <> 'confirmed' AND id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def needs_extraction(d: Domain) -> DataFrame:
    return jobs.eligible(d.receipts, d.table("events").where("event_type = 'view'").select(F.col("event_id").alias("id"))).select("id")


@query("search_budget", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS r FROM events) WHERE r <= 8", plain=True)
def search_budget(d: Domain) -> DataFrame:
    return jobs.search_budget(d.table("events").withColumn("day", F.to_date("ts")), 8, "day", ("ts",)).select("event_id")


_TEN = "lpad(CAST((c_custkey * 1234577) % 10000000000 AS VARCHAR), 10, '0')"


@query("resolve_company", f"""WITH a AS (SELECT c_custkey AS id, {_TEN} AS n FROM customer), l AS (SELECT *, (SELECT sum(CASE WHEN i % 2 = 1 THEN (CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END) % 10 FROM (SELECT i, CAST(substr(n, i, 1) AS INTEGER) AS d FROM (SELECT unnest(range(1, 11)) AS i))) AS c FROM a)
SELECT id, CASE WHEN substr(n, 1, 1) IN ('0', '4') OR CAST(substr(n, 3, 2) AS INTEGER) < 20 OR c <> 0 THEN 'invalid' WHEN id % 3 = 0 THEN 'store' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'miss' ELSE 'lookup' END AS step FROM l""", plain=True)
def resolve_company(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    number = F.lpad((k * 1234577 % 10000000000).cast("string"), 10, "0")
    asked = d.table("customer").select(k.alias("id"), number.alias("org_number"))
    stored = asked.where("id % 3 = 0").select("id", "org_number", F.lit(0).alias("deleted_at"))
    misses = asked.where("id % 3 = 1").select("org_number", F.when(F.col("id") % 2 == 0, 10**12).otherwise(0).cast("bigint").alias("at"))
    return names.resolve_companies(asked, stored, misses, 10**12 + 5).select("id", "step")


@query("corroborate", "SELECT c_custkey AS id, greatest((c_custkey % 10) / 10.0, CASE WHEN c_custkey % 3 = 0 THEN 0.55 ELSE 0 END) AS name_match_score, c_custkey % 4 = 0 OR c_custkey % 6 = 0 AS name_confirmed FROM customer", plain=True)
def corroborate(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    companies = d.table("customer").select(k.alias("id"), ((k % 10) / 10.0).alias("name_match_score"), (k % 4 == 0).alias("name_confirmed"))
    matches = d.table("customer").where(k % 3 == 0).select(k.alias("company_id"), F.lit(0.55).alias("score"), (k % 6 == 0).alias("confirmed"))
    return names.corroborate(companies, matches)


@query("quad_geometry", """SELECT o_orderkey AS id, CAST((100 + o_custkey % 50) * (200 + o_orderkey % 70) AS DOUBLE) AS area, true AS sane, CAST(10 AS DOUBLE) AS left_x, CAST(20 AS DOUBLE) AS top_y,
  CAST(o_custkey % 300 AS DOUBLE) >= 10 AND CAST(o_custkey % 300 AS DOUBLE) < 110 + o_custkey % 50 AS inside FROM orders""", plain=True)
def quad_geometry(d: Domain) -> DataFrame:
    w, h = (100 + F.col("o_custkey") % 50).cast("double"), (200 + F.col("o_orderkey") % 70).cast("double")
    p = lambda x, y: F.struct((x).alias("x"), (y).alias("y"))
    x, y = F.lit(10.0), F.lit(20.0)
    q = d.table("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", vision.ordered(F.array(p(x + w, y + h), p(x, y), p(x, y + h), p(x + w, y))).alias("q"))
    inside = vision.contains(F.col("q"), (F.col("o_custkey") % 300).cast("double"), F.lit(50.0))
    return q.select("id", vision.area(F.col("q")).alias("area"), vision.sane_aspect(F.col("q")).alias("sane"), F.col("q")[0]["x"].alias("left_x"), F.col("q")[0]["y"].alias("top_y"), inside.alias("inside"))


@query("detect_confidence", "SELECT o_orderkey AS id, round(least(1, o_custkey % 100 / 100.0 / 0.55) * 0.55 + o_orderkey % 10 / 10.0 * 0.45, 6) AS confidence, CASE WHEN round(least(1, o_custkey % 100 / 100.0 / 0.55) * 0.55 + o_orderkey % 10 / 10.0 * 0.45, 6) >= 0.45 THEN 'crop' ELSE 'whole' END AS decision FROM orders", plain=True)
def detect_confidence(d: Domain) -> DataFrame:
    c = F.round(vision.confidence(F.col("o_custkey") % 100 / 100.0, F.col("o_orderkey") % 10 / 10.0), 6)
    return d.table("orders").select(F.col("o_orderkey").alias("id"), c.alias("confidence"), vision.use_crop(c).alias("decision"))


@query("ink_ratio", "WITH p AS (SELECT user_id AS frame_id, CAST(event_id * 7919 % 256 AS INTEGER) AS value FROM events), a AS (SELECT frame_id, count(*) AS n, quantile_disc(value, 0.9) AS paper FROM p GROUP BY 1) SELECT frame_id, CASE WHEN n >= 64 THEN (SELECT count(*) FROM p WHERE p.frame_id = a.frame_id AND value < 0.72 * paper) / CAST(n AS DOUBLE) END AS ink FROM a", plain=True)
def ink_ratio(d: Domain) -> DataFrame:
    return vision.ink_ratio(d.table("events").select(F.col("user_id").alias("frame_id"), (F.col("event_id") * 7919 % 256).cast("int").alias("value")))


@query("stretched_frames", """WITH p AS (SELECT user_id AS frame_id, event_id AS x, CAST(event_id * 7919 % 256 AS INTEGER) AS value FROM events),
c AS (SELECT frame_id, value, sum(count(*)) OVER (PARTITION BY frame_id ORDER BY value) AS run, sum(count(*)) OVER (PARTITION BY frame_id) AS n FROM p GROUP BY 1, 2),
e AS (SELECT frame_id, greatest(1, min(value) FILTER (run >= n * CAST(0.02 AS DOUBLE))) AS low, min(value) FILTER (run >= n * CAST(0.98 AS DOUBLE)) AS high FROM c GROUP BY 1)
SELECT frame_id, x, CAST(greatest(0, least(255, floor((value - low) * CAST(255 AS DOUBLE) / greatest(1, high - low) + 0.5))) AS INTEGER) AS value FROM p JOIN e USING (frame_id)""", plain=True)
def stretched_frames(d: Domain) -> DataFrame:
    pixels = d.table("events").select(F.col("user_id").alias("frame_id"), F.col("event_id").alias("x"), F.lit(0).alias("y"), (F.col("event_id") * 7919 % 256).alias("value"))
    return tone.stretched(pixels).select("frame_id", "x", "value")
