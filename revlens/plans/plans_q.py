"""Registered action-plan queries (J1-J6) on plans derived from every session's dashboard.

A plan per session is written from its own aggregates, with data-driven
variations (thinking blocks, fences, rationales without numbers, filler
phrases, vague quick wins, invalid labels), then parsed, verified and given
a disposition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import actionplans as J
from revlens.operators import dashboard as D
from revlens.plans.catalog import register
from revlens.plans.derived import CAT_CTE, FULL_KEYS
from revlens.plans.sqlbits import COUNTS_CTE, DASH_CTE, TOP_ISSUES_CTE, spct, with_feedback
from revlens.session import cut_lineage
from revlens.sources.tables import feedback, read_table


def _inputs(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    dash = D.dashboard(fb, FULL_KEYS)
    return fb, dash, cut_lineage(D.top_issues(fb).drop("example_list"))


def generated_plans(spark, sf_dir):
    fb, dash, issues = _inputs(spark, sf_dir)
    recs = issues.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "category", "count", "critical_count", "example"))).alias("iss"))
    d = dash.join(recs, "session_id", "left")
    rec = lambda x: F.struct(
        x["rank"].cast("string").alias("rank"),
        F.concat(F.lit("Fix "), F.lower(x["category"])).alias("title"),
        F.when(F.col("neutral_count") % 3 == 0, F.concat(F.lit("Customers keep raising "), F.lower(x["category"])))
         .otherwise(F.format_string("%d negative reviews, %d critical", x["count"], x["critical_count"])).alias("rationale"),
        F.when((F.col("medium_count") % 4 == 0) & (x["rank"] != 1), F.lit("leverage it"))
         .when((F.col("medium_count") % 4 == 1) & (F.col("low_count") % 2 == 0) & (x["rank"] == 1), F.lit("leverage best practices to streamline"))
         .otherwise(F.concat(F.lit("Replace the "), F.lower(F.coalesce(x["example"], F.lit("part"))))).alias("action"),
        F.lit("high").alias("impact"), F.lit("low").alias("effort"),
        F.when(x["critical_count"] > 0, F.lit("immediate")).otherwise(F.lit("short_term")).alias("timeframe"))
    plan = F.struct(
        F.col("health_score").cast("string").alias("health_score"),
        F.when(F.col("low_count") % 9 == 8, F.lit("Okay")).otherwise(F.col("health_label")).alias("health_label"),
        F.concat(F.lit("Overall score "), F.col("overall_score").cast("string")).alias("executive_summary"),
        F.array(F.col("top_category")).alias("key_strengths"),
        F.transform(F.coalesce("iss", F.array()), rec).alias("recommendations"),
        F.struct(F.lit("Quick win").alias("title"),
                 F.when(F.col("positive_count") % 5 == 0, F.lit("be nicer"))
                  .otherwise(F.lit("Send an apology to every critical reviewer")).alias("description"),
                 F.lit("fewer complaints").alias("expected_outcome")).alias("quick_win"),
        F.lit(None).cast("string").alias("data_quality_note"))
    js = F.to_json(plan)
    js = F.when(F.col("total_reviews") % 11 == 10, F.concat(F.lit("Here you go: "), js)).otherwise(js)
    raw = F.when(F.col("critical_count") % 2 == 0, F.concat(F.lit("<thinking>draft</thinking>\n```json\n"), js,
                                                           F.lit("\n```"))).otherwise(js)
    attempt = F.when(F.col("health_score") % 2 == 0, 1).otherwise(J.MAX_PLAN_ATTEMPTS)
    return d.select("session_id", attempt.alias("attempt"), raw.alias("raw_plan"), plan["recommendations"].alias("recommendations")), issues, dash, fb


PLANS_SQL = with_feedback(COUNTS_CTE, TOP_ISSUES_CTE, DASH_CTE, """iss AS (
  SELECT session_id, CAST(row_number() OVER w AS INTEGER) AS rank, category, count, critical_count, example,
         count(*) OVER (PARTITION BY session_id) AS n
  FROM issues WHERE rank <= 5 WINDOW w AS (PARTITION BY session_id ORDER BY rank)""" + ")", """words AS (
  SELECT session_id, list_distinct(flatten(list(
    list_filter(regexp_extract_all(lower(category), '[a-z]+'), lambda w: length(w) > 3)
    || list_filter(regexp_extract_all(lower(coalesce(example, '')), '[a-z]+'),
                   lambda w: length(w) > 3 AND NOT list_contains(STOPWORDS, w))))) AS terms
  FROM iss GROUP BY 1)""".replace("STOPWORDS", repr(J.GROUNDING_STOPWORDS)), """recs AS (
  SELECT i.session_id, i.rank, 'Fix ' || lower(i.category) AS title,
         CASE WHEN d.neutral_count % 3 = 0 THEN 'Customers keep raising ' || lower(i.category)
              ELSE i.count || ' negative reviews, ' || i.critical_count || ' critical' END AS rationale,
         CASE WHEN d.medium_count % 4 = 0 AND i.rank <> 1 THEN 'leverage it' WHEN d.medium_count % 4 = 1 AND d.low_count % 2 = 0 AND i.rank = 1 THEN 'leverage best practices to streamline'
              ELSE 'Replace the ' || lower(coalesce(i.example, 'part')) END AS action,
         CASE WHEN i.critical_count > 0 THEN 'immediate' ELSE 'short_term' END AS timeframe
  FROM iss i JOIN dashboard d ON i.session_id = d.session_id)""", """facts AS (
  SELECT r.session_id, count(*) AS n, count_if(regexp_matches(rationale, '[0-9]')) AS numbers,
         string_agg(action || ' ' || rationale, ' ') AS body,
         count_if(len(list_filter(w.terms, lambda t: contains(lower(title || ' ' || action), t))) > 0) AS matched
  FROM recs r JOIN words w ON r.session_id = w.session_id GROUP BY 1)""", """parsed AS (
  SELECT d.session_id, f.n, f.numbers, f.matched, d.positive_count,
         len(list_filter(FILLERS, lambda p: contains(lower(coalesce(f.body, '')), p))) AS filler,
         CASE WHEN d.total_reviews % 11 = 10 THEN 'bad_json'
              WHEN d.low_count % 9 = 8 OR coalesce(f.n, 0) < 3 THEN 'bad_schema'
              WHEN len(list_filter(FILLERS, lambda p: contains(lower(coalesce(f.body, '')), p))) >= 3
              THEN 'filler_phrases: ' || len(list_filter(FILLERS, lambda p: contains(lower(coalesce(f.body, '')), p))) END AS parse_error
  FROM dashboard d LEFT JOIN facts f ON d.session_id = f.session_id)""".replace("FILLERS", repr(J.FILLER_PHRASES)), """verified AS (
  SELECT session_id, parse_error, CASE WHEN parse_error IS NULL THEN
         CASE WHEN numbers < 3 THEN 'rationales_with_numbers: ' || numbers || ' of 3'
              WHEN matched < n / 2.0 THEN 'recommendations_on_issues: ' || matched || ' of ' || n
              WHEN positive_count % 5 = 0 THEN 'vague_quick_win' ELSE 'passed' END END AS grounding
  FROM parsed)""")


@register("j01_plan_facts", with_feedback(COUNTS_CTE, TOP_ISSUES_CTE, DASH_CTE, CAT_CTE.format(pct=spct("count", "total")).replace("SELECT v.session_id, category,", "SELECT v.session_id, category, count, o,").replace("count(*) AS count FROM feedback", "count(*) AS count, min(review_id) AS o FROM feedback"), f"""emos AS (
  SELECT v.session_id, emotion, count, o, {spct("count", "total")} AS pct FROM (
    SELECT session_id, emotion, count(*) AS count, min(review_id) AS o FROM feedback WHERE emotion IS NOT NULL GROUP BY 1, 2) v
  JOIN (SELECT session_id, count(*) AS total FROM feedback GROUP BY 1) t ON v.session_id = t.session_id)""", """cb AS (
  SELECT session_id, string_agg('- ' || category || ': ' || count || ' reviews (' || printf('%.1f', pct) || '%)', chr(10) ORDER BY count DESC, o) AS b FROM cats GROUP BY 1)""", """eb AS (
  SELECT session_id, string_agg('- ' || emotion || ': ' || count || ' (' || printf('%.1f', pct) || '%)', chr(10) ORDER BY count DESC, o) AS b FROM emos GROUP BY 1)""", """ib AS (
  SELECT session_id, string_agg('- ' || category || ': ' || count || ' negative, ' || critical_count || ' critical'
         || CASE WHEN critical_count > 0 THEN ' [priority]' ELSE '' END || ' e.g. ' || coalesce(example, ''), chr(10) ORDER BY rank) AS b
  FROM issues WHERE rank <= 5 GROUP BY 1)""", """sb AS (
  SELECT session_id, 'Known solutions:' || chr(10) || string_agg('- ' || category || ' / ' || 'Repeated complaints about ' || lower(category) || ': '
         || 'Review the ' || lower(category) || ' process [impact high, effort low]', chr(10) ORDER BY category) AS b
  FROM issues WHERE critical_count > 0 GROUP BY 1)""", """who AS (SELECT DISTINCT session_id, user_id, industry FROM feedback)""") + """
SELECT d.session_id, d.health_score, d.health_label,
       'Company: ' || c.c_name || ' (' || w.industry || ')' || CASE WHEN c.c_acctbal > 0 THEN chr(10) || 'About: account in credit' ELSE '' END
       || chr(10) || chr(10) || 'Reviews: ' || d.total_reviews || '; score ' || printf('%.1f', d.overall_score) || '; positive ' || printf('%.1f', d.positive_pct)
       || '%; negative ' || printf('%.1f', d.negative_pct) || '%; critical ' || printf('%.1f', d.critical_pct) || '%' || chr(10) || chr(10)
       || 'Categories:' || chr(10) || coalesce(cb.b, '') || chr(10) || chr(10) || 'Emotions:' || chr(10) || coalesce(eb.b, '') || chr(10) || chr(10)
       || 'Top issues:' || chr(10) || coalesce(ib.b, '') || chr(10) || chr(10)
       || CASE WHEN d.low_pct > 25 THEN 'Warning: ' || printf('%.1f', d.low_pct) || '% of classifications have low confidence.' ELSE '' END
       || coalesce(chr(10) || chr(10) || sb.b, '') AS facts
FROM dashboard d JOIN who w ON d.session_id = w.session_id JOIN customer c ON c.c_custkey = w.user_id
LEFT JOIN cb ON cb.session_id = d.session_id LEFT JOIN eb ON eb.session_id = d.session_id
LEFT JOIN ib ON ib.session_id = d.session_id LEFT JOIN sb ON sb.session_id = d.session_id""")
def j01(spark, sf_dir):
    fb = cut_lineage(feedback(spark, sf_dir).select(*FULL_KEYS, "review_id", "primary_category", "secondary_category", "sentiment", "urgency",
                                                    "emotion", "confidence", "core_issue"))
    dash = cut_lineage(D.dashboard(fb, FULL_KEYS))
    every = cut_lineage(D.top_issues(fb, None).drop("example_list"))
    issues = every.filter("rank <= 5")
    cust = read_table(spark, sf_dir, "customer")
    who = dash.select("session_id", "user_id", "industry").join(
        cust.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("company_name"),
                    F.when(F.col("c_acctbal") > 0, F.lit("account in credit")).otherwise(F.lit("")).alias("description")), "user_id")
    low = F.lower("category")
    solutions = every.filter(F.col("critical_count") > 0).select(
        "session_id", "category", F.lit(1).alias("hit"), F.concat(F.lit("Repeated complaints about "), low).alias("problem"),
        F.concat(F.lit("Review the "), low, F.lit(" process")).alias("solution"), F.lit("high").alias("impact"), F.lit("low").alias("effort"))
    return J.plan_facts(dash, issues, D.category_breakdown(fb), D.emotion_breakdown(fb), who, solutions)


@register("j02_parse_plans", PLANS_SQL + "SELECT session_id, parse_error FROM parsed")
def j02(spark, sf_dir):
    plans, _, _, _ = generated_plans(spark, sf_dir)
    return J.parse_plans(plans).select("session_id", "parse_error")


@register("j03_filler_count", PLANS_SQL + f"""
SELECT session_id, rank, len(list_filter({J.FILLER_PHRASES!r}, lambda p: contains(lower(action || ' ' || rationale), p))) AS fillers FROM recs""")
def j03(spark, sf_dir):
    plans, _, _, _ = generated_plans(spark, sf_dir)
    x = plans.select("session_id", F.explode("recommendations").alias("r"))
    return x.select("session_id", F.col("r.rank").cast("int").alias("rank"),
                    J.filler_count(F.concat("r.action", F.lit(" "), "r.rationale")).cast("bigint").alias("fillers"))


@register("j04_verify_plans", PLANS_SQL + "SELECT session_id, parse_error, grounding FROM verified")
def j04(spark, sf_dir):
    plans, issues, _, _ = generated_plans(spark, sf_dir)
    return J.verify_plans(J.parse_plans(plans), issues).select("session_id", "parse_error", "grounding")


@register("j05_plan_dispositions", PLANS_SQL + """
SELECT v.session_id,
       CASE WHEN grounding = 'passed' THEN 'accepted' WHEN d.health_score % 2 = 0 THEN 'retry'
            WHEN parse_error IS NOT NULL THEN 'failed' ELSE 'accepted_ungrounded' END AS disposition,
       CASE WHEN d.health_score % 2 = 0 AND coalesce(grounding, '') <> 'passed' THEN coalesce(parse_error, grounding) END AS retry_reason
FROM verified v JOIN dashboard d ON v.session_id = d.session_id""")
def j05(spark, sf_dir):
    plans, issues, _, _ = generated_plans(spark, sf_dir)
    v = J.verify_plans(J.parse_plans(plans), issues)
    return J.plan_dispositions(v).select("session_id", "disposition", "retry_reason")


@register("j06_plan_recommendations", PLANS_SQL + """
SELECT p.session_id, r.rank, r.title, r.action, 'high' AS impact, 'low' AS effort, r.timeframe
FROM parsed p JOIN recs r ON p.session_id = r.session_id WHERE coalesce(p.parse_error, '') <> 'bad_json'""")
def j06(spark, sf_dir):
    plans, _, _, _ = generated_plans(spark, sf_dir)
    return J.plan_recommendations(J.parse_plans(plans))
