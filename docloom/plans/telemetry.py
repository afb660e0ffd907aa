"""Queries over event samples, and counters of the evaluation package."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.checks import holds_lines, is_origin, origin_of
from docloom.functions.text import INSTANT, utc_instant
from docloom.operators import evaluation, intervals, reports, telemetry
from docloom.plans.common import CASES, PAGES, SPANS, cases, pages
from docloom.session import ensure_checkpoint_dir
from docloom.sources.tables import table
from docloom.streaming import snapshots as streams


def latency_stats_p95(spark, sf):
    found = evaluation.latency_report(table(spark, sf, "events"), ["event_type"], "value")
    return found.withColumn("mean", F.round("mean", 6))


def sample_gaps(spark, sf):
    return telemetry.sample_gaps(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "gap_us")


def counter_deltas(spark, sf):
    found = telemetry.since_baseline(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "value", "ts", "event_id")
    return found.select("event_id", F.round("delta", 6).alias("delta"))


def log_fields(spark, sf):
    return telemetry.log_fields(table(spark, sf, "events").select("event_id", "props"), "props", {"k": r'"k": (-?\d+)', "missing": r'"absent": (\d+)'}).select("event_id", "k", "missing")


def tag_counters(spark, sf):
    return cases(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def split_counters(spark, sf):
    split = F.coalesce(F.lower(F.trim("split")), F.lit("none"))
    key = F.concat_ws("/", split, F.when(F.col("answerable"), "answerable").otherwise("unanswerable"))
    return cases(spark, sf).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("expected_behavior") == "refuse").alias("refuse"), F.count_if(F.col("expected_behavior") == "clarify").alias("clarify"))


def report_totals(spark, sf):
    """Stored reports whose splits or categories do not add up to their number of questions."""
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0), lambda s, x: s + x)
    one = table(spark, sf, "validation_reports").dropDuplicates(["report_id"])
    found = one.select("report_id", "questions", total("splits").alias("in_splits"), total("categories").alias("in_categories"))
    return found.where("coalesce(in_splits <> questions, true) or coalesce(in_categories <> questions, true)")


def load_gate(spark, sf):
    return telemetry.load_gate(table(spark, sf, "events"), "event_type", "value", "view")


def event_windows(spark, sf):
    """Count, sum and largest value per event type and six hours, computed as a stream that ends with the data."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = streams.table_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)
    windows = streams.event_windows(rows, "6 hours", late="40 days")
    streams.replace_batches(windows, f"{folder}/rows", f"{folder}/progress").awaitTermination()
    found = spark.read.parquet(f"{folder}/rows")
    return found.select("start", "event_type", "n", F.round("total", 4).alias("total"), "largest")


ORDER = ["click", "view", "click", "absent"]
UNTIL = "2026-03-01T00:00:00.000000Z"


def ordered_selection(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return reports.select_in_order(counts, "event_type", ORDER).select("position", "event_type", "n")


def arm_ratios(spark, sf):
    found = reports.against_control(table(spark, sf, "events"), "event_type", "value", "view")
    return found.select("event_type", F.round("mean", 6).alias("mean"), F.round("ratio", 6).alias("ratio"))


def first_warm_pairs(spark, sf):
    return reports.pass_pairs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")


def differing_fingerprints(spark, sf):
    return reports.differing_settings(table(spark, sf, "validation_reports"), "fingerprints")


def repeat_difference(spark, sf):
    """One report run over the cases and over the cases without every ninth one, the times aside."""
    def run(own, elapsed):
        return own.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).withColumn("elapsed", F.lit(elapsed))

    own = cases(spark, sf)
    return reports.run_difference(run(own, 1), run(own.where("cast(substring(id, 2) as bigint) % 9 <> 0"), 2), ["elapsed"])


def published_pages(spark, sf):
    return reports.published(pages(spark, sf), "updated_at", UNTIL, utc_instant).select("page_id")


def page_origins(spark, sf):
    origin = origin_of(F.col("source_url"))
    return pages(spark, sf).groupBy(origin.alias("origin"), is_origin(origin).alias("valid")).agg(F.count("*").alias("n"))


def case_manifest(spark, sf):
    """The exact slices of every case's evidence, cut out of the pages they are frozen from."""
    spans = evaluation.evidence_spans(cases(spark, sf)).join(pages(spark, sf).select("page_id", "markdown"), "page_id")
    slices = spans.withColumn("slice", F.substring(F.col("markdown"), F.col("start") + 1, F.col("end") - F.col("start")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "slice"))), lambda x: x.slice), "\n")
    return slices.groupBy("case_id", "page_id").agg(F.count("*").alias("n_slices"), F.sha2(F.encode(whole, "utf-8"), 256).alias("digest"))


def evidence_complete(spark, sf):
    """Whether the spans of each case are all inside its pages, null for cases without evidence."""
    spans = evaluation.evidence_spans(cases(spark, sf))
    whole = pages(spark, sf).select("page_id", F.lit(0).alias("start"), F.length("markdown").alias("end"))
    held = intervals.covered_spans(spans.select("page_id", "start", "end"), whole, ["page_id"])
    every = spans.join(held, ["page_id", "start", "end"], "left").groupBy("case_id").agg(F.bool_and(F.coalesce("covered", F.lit(False))).alias("complete"))
    return cases(spark, sf).select(F.col("id").alias("case_id")).join(every, "case_id", "left")


def command_lines(spark, sf):
    """Exact commands that are whole lines of their case's evidence texts."""
    own = cases(spark, sf).select("id", F.explode("exact_commands").alias("command"), F.array_join(F.flatten(F.transform("evidence", lambda e: F.transform(e.spans, lambda s: s.exact_text))), "\n").alias("text"))
    return own.select("id", "command", holds_lines(F.col("text"), F.col("command")).alias("whole_line"))


QUERIES = {
    f.__name__: f
    for f in (
        latency_stats_p95, load_gate, event_windows, sample_gaps, counter_deltas, log_fields, tag_counters, split_counters, report_totals, ordered_selection, arm_ratios,
        first_warm_pairs, differing_fingerprints, repeat_difference, published_pages, page_origins, case_manifest, evidence_complete, command_lines,
    )
}

SQL = {
    "latency_stats_p95": "select event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as largest, quantile_disc(value, 0.95) as p95 from events where value is not null group by 1",
    "load_gate": """with f as (select event_type, count(*) filter (where isfinite(value)) as samples, count(*) filter (where not coalesce(isfinite(value), false)) as unsound, quantile_disc(value, 0.95) as p95 from events group by 1),
b as (select p95 as base, samples as bs from f where event_type = 'view')
select event_type, samples, p95, round(p95 / base, 9) as ratio, coalesce(p95 / base <= 2 and samples >= 20 and bs >= 20 and unsound = 0, false) as passes from f, b""",
    "event_windows": "select time_bucket(interval '6 hours', ts, timestamp '2024-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total, max(value) as largest from events where ts is not null group by 1, 2",
    "sample_gaps": "select event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap_us from events",
    "counter_deltas": "select event_id, round(value - first_value(value) over (partition by user_id order by ts, event_id), 6) as delta from events",
    "log_fields": """select event_id, try_cast(nullif(regexp_extract(props, '"k": (-?\\d+)', 1), '') as double) as k, try_cast(nullif(regexp_extract(props, '"absent": (\\d+)', 1), '') as double) as missing from events""",
    "tag_counters": f"select tag, count(*) as n from (select unnest(tags) as tag from {CASES}) group by 1",
    "split_counters": f"""select concat_ws('/', coalesce(lower(trim(split)), 'none'), case when answerable then 'answerable' else 'unanswerable' end) as key, count(*) as n,
  count(*) filter (where expected_behavior = 'refuse') as refuse, count(*) filter (where expected_behavior = 'clarify') as clarify from {CASES} group by 1""",
    "report_totals": """select * from (select report_id, questions, cast(list_sum(map_values(splits)) as integer) as in_splits, cast(list_sum(map_values(categories)) as integer) as in_categories
  from (select * from validation_reports qualify row_number() over (partition by report_id order by run_at) = 1))
where coalesce(in_splits <> questions, true) or coalesce(in_categories <> questions, true)""",
    "ordered_selection": f"""select position, event_type, n from (values {', '.join(f"({i}::bigint, '{x}')" for i, x in enumerate(ORDER))}) o(position, event_type)
  join (select event_type, count(*) as n from events group by 1) using (event_type)""",
    "arm_ratios": "with m as (select event_type, avg(value) as mean from events group by 1) select event_type, round(mean, 6) as mean, round(mean / (select mean from m where event_type = 'view'), 6) as ratio from m",
    "first_warm_pairs": """select user_id, max(case when n = 1 then value end) as first, max(case when n = 2 then value end) as warm
from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events) where n <= 2 group by 1""",
    "differing_fingerprints": """select key, count(distinct value) as n_values from (select unnest(map_keys(fingerprints)) as key, unnest(map_values(fingerprints)) as value from validation_reports) group by 1 having count(distinct value) > 1""",
    "repeat_difference": f"""with t as (select unnest(tags) as tag, cast(substring(id, 2) as bigint) % 9 <> 0 as kept from {CASES}),
r as (select tag, count(*) as n, 1 as s from t group by 1 union all select tag, count(*), -1 from t where kept group by 1) select tag, n, cast(sum(s) as bigint) as surplus from r group by 1, 2 having sum(s) <> 0""",
    "published_pages": f"select page_id from {PAGES} where regexp_matches(updated_at, '{INSTANT}') and try_cast(updated_at as timestamptz) <= timestamptz '2026-03-01 00:00:00+00'",
    "page_origins": f"""with o as (select nullif(regexp_extract(source_url, '^(https?://[^/@:?#\\s\\\\]+(?::\\d{{1,5}})?)(?:[/?#]|$)', 1), '') as origin from {PAGES})
select origin, coalesce(regexp_matches(origin, '^https?://[^/@:?#]+(:\\d{{1,5}})?$'), false) as valid, count(*) as n from o group by 1, 2""",
    "case_manifest": f"""select case_id, page_id, count(*) as n_slices, sha256(string_agg(t, chr(10) order by s, e, t)) as digest
from (select s.case_id, s.page_id, s.s, s.e, substring(p.markdown, s.s + 1, s.e - s.s) as t from {SPANS.format(cases=CASES)} s join {PAGES} p on p.page_id = s.page_id) group by 1, 2""",
    "evidence_complete": f"""select c.id as case_id, bool_and(case when s.case_id is not null then coalesce(s.s >= 0 and s.e <= length(p.markdown) and length(p.markdown) > 0, false) end) as complete
from {CASES} c left join {SPANS.format(cases=CASES)} s on s.case_id = c.id left join {PAGES} p on p.page_id = s.page_id group by 1""",
    "command_lines": f"""with c as (select id, unnest(exact_commands) as command, array_to_string(flatten(list_transform(evidence, lambda e: list_transform(e.spans, lambda s: s.exact_text))), chr(10)) as t from {CASES}),
l as (select *, chr(10) || array_to_string(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), chr(10)) || chr(10) as p from c)
select id, command, coalesce(trim(command) <> '' and contains(p, chr(10) || trim(command) || chr(10)), false) as whole_line from l""",
}
