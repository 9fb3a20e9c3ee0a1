"""Web-page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions.html import CLEANING_STEPS, ENTITIES, SQUEEZE_STEPS, WALL_PHRASES, is_wall
from ragloom.functions.urls import (
    BLOCKED_SITES, PRIVATE_NAMES, PRIVATE_PATTERN, admission_problem, blocked_site, host,
)
from ragloom.operators.answers import check_fit_inputs, looks_like_url
from ragloom.operators.pages import admission_funnel, admit_pages, clean_pages, cleaning_report
from workload.registry import query
from workload.sqlparts import SPACES, sql
from workload.tables import PARAMS, table

L = F.col

RULES = (("prefix", "ads-track.", "AdsTrack"), *BLOCKED_SITES)
EMPTY, SHORT = 400, 900  # fixture pages are longer than real walls

# Some pages get another address, so that every admission rule meets some.
ADDRESSES = (
    ("0", "http://127.0.0.1/admin"), ("1", "http://172.20.0.9:8080/x"), ("2", "ftp://files.example.com/a"),
    ("3", "no address at all"), ("4", "https://www.linkedin.com/jobs/view/1"), ("5", "https://au.indeed.com/viewjob"),
    ("6", "http://metadata.google.internal/computeMetadata"), ("7", "http://[::1]/"),
    ("8", "http://256.0.0.1/"), ("9", "http://1.2.3.4.5/x"), ("a", "http://08.1.1.1/"),
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(expr: str) -> str:
    for pattern, into in CLEANING_STEPS:
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(into)}, 'g')"
    for entity, char in ENTITIES:
        expr = f"replace({expr}, {_quoted(entity)}, {_quoted(char)})"
    for pattern, into in SQUEEZE_STEPS:
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(into)}, 'g')"
    return f"trim({expr}, {SPACES})"


_TEST = {"suffix": "ends_with", "prefix": "starts_with", "contains": "contains"}
_SITE = "CASE " + " ".join(f"WHEN {_TEST[k]}(host, '{t}') THEN '{n}'" for k, t, n in RULES) + " END"
_NAMES = ", ".join(f"'{n}'" for n in PRIVATE_NAMES)
_WALLS = "|".join(WALL_PHRASES)

PARTS = {
    "served": f"""
      SELECT page_id, CASE substr(md5(url), 1, 1) {' '.join(f"WHEN '{d}' THEN '{a}'" for d, a in ADDRESSES)} ELSE url END AS url,
             html, CASE substr(md5(url), 2, 1) WHEN 'a' THEN 404 WHEN 'b' THEN 503 ELSE 200 END AS http_status,
             CASE substr(md5(url), 3, 1) WHEN 'c' THEN 'image/png' WHEN 'd' THEN NULL ELSE 'text/html' END AS content_type
      FROM pages""",
    "cleaned": f"SELECT page_id, {_clean('html')} AS whole, length(html) AS chars_in FROM pages",
    "hosts": """
      SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*?)(:[0-9]*)?([/?#].*)?$', 1)) AS host FROM served""",
    "admission": f"""
      SELECT page_id, url, host, {_SITE} AS site,
             CASE WHEN scheme = '' THEN 'not a valid URL'
                  WHEN regexp_matches(host, '^[0-9.]+$') AND (len(string_split(host, '.')) > 4 OR regexp_matches(host, '(^|[.])0[0-9]*[89]')
                    OR list_max(list_transform(string_split(host, '.'), lambda x: TRY_CAST(x AS BIGINT))) > 255) THEN 'not a valid URL'
                  WHEN scheme NOT IN ('http', 'https') THEN 'only http(s) links are supported'
                  WHEN host IN ({_NAMES}) OR regexp_matches(host, '{PRIVATE_PATTERN}') THEN 'host is not allowed' END AS problem
      FROM hosts""",
    "funnel": f"""
      SELECT page_id, url, left(whole, {PARAMS.page_max_chars}) AS text,
             CASE WHEN problem IS NOT NULL THEN problem
                  WHEN site IS NOT NULL THEN site || ' blocks page reads'
                  WHEN http_status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || http_status
                  WHEN content_type IS NULL OR NOT (contains(content_type, 'html') OR contains(content_type, 'text')) THEN 'not a readable web page'
                  WHEN length(whole) < {EMPTY} OR (length(whole) < {SHORT} AND regexp_matches(lower(whole), '{_WALLS}')) THEN 'login or anti-bot page'
             END AS reason
      FROM admission JOIN served USING (page_id, url) JOIN cleaned USING (page_id)""",
}


def served(spark, sf_dir):
    """Pages with the addresses above, an HTTP status and a content type."""
    digit = lambda i: F.substring(F.md5("url"), i, 1)
    address = L("url")
    for d, a in ADDRESSES:
        address = F.when(digit(1) == d, a).otherwise(address)
    return table(spark, sf_dir, "pages").select(
        "page_id", address.alias("url"), "html",
        F.when(digit(2) == "a", 404).when(digit(2) == "b", 503).otherwise(200).alias("http_status"),
        F.when(digit(3) == "c", "image/png").when(digit(3) != "d", "text/html").alias("content_type"),
    )


def _admitted(spark, sf_dir):
    return admit_pages(served(spark, sf_dir), PARAMS, RULES, EMPTY, SHORT)


@query(sql(f"""
  SELECT page_id, left(whole, {PARAMS.page_max_chars}) AS text, length(whole) > {PARAMS.page_max_chars} AS cut,
         chars_in FROM cleaned""", **PARTS))
def html_text(spark, sf_dir):
    cleaned = clean_pages(table(spark, sf_dir, "pages"), PARAMS)
    return cleaned.select("page_id", "text", "cut", L("chars_in").cast("bigint").alias("chars_in"))


@query(sql(f"""
  SELECT count(*) AS pages, sum(chars_in)::BIGINT AS chars_in, sum(least(length(whole), {PARAMS.page_max_chars}))::BIGINT AS chars_out,
         count(*) FILTER (WHERE length(whole) > {PARAMS.page_max_chars}) AS cut FROM cleaned""", **PARTS))
def html_report(spark, sf_dir):
    return cleaning_report(clean_pages(table(spark, sf_dir, "pages"), PARAMS))


@query(sql("SELECT page_id, problem IS NULL AS admitted, problem FROM admission", **PARTS))
def url_admission(spark, sf_dir):
    problem = admission_problem(L("url"))
    return served(spark, sf_dir).select("page_id", problem.isNull().alias("admitted"), problem.alias("problem"))


@query(sql("SELECT page_id, site FROM admission", **PARTS))
def blocked_domain(spark, sf_dir):
    return served(spark, sf_dir).select("page_id", blocked_site(host(L("url")), RULES).alias("site"))


@query(sql(f"""
  SELECT page_id, length(whole) < {EMPTY} OR (length(whole) < {SHORT} AND regexp_matches(lower(whole), 'anmelden|{_WALLS}')) AS wall
  FROM (SELECT page_id, whole || CASE WHEN length(whole) < 600 THEN ' Access DENIED' ELSE '' END AS whole FROM cleaned)""", **PARTS))
def wall_flag(spark, sf_dir):
    """Short pages get a wall phrase, in capitals."""
    text = clean_pages(table(spark, sf_dir, "pages"), PARAMS.but(page_max_chars=1 << 30))
    marked = F.concat("text", F.when(F.length("text") < 600, " Access DENIED").otherwise(""))
    return text.select("page_id", marked.alias("text")).select(
        "page_id", is_wall(L("text"), EMPTY, SHORT).alias("wall"))


@query(sql("""
  SELECT page_id, regexp_matches(html, '^https?://[^ ]+$') AS is_url FROM (
    SELECT page_id, url AS html FROM served UNION ALL SELECT -1 - page_id, html FROM served)""", **PARTS))
def url_shaped(spark, sf_dir):
    """Addresses and whole pages: which of them are one link?"""
    pages = served(spark, sf_dir)
    both = pages.select("page_id", L("url").alias("t")).union(pages.select(-1 - L("page_id"), L("html")))
    return both.select("page_id", looks_like_url(L("t")).alias("is_url"))


@query(sql("SELECT page_id, reason, CASE WHEN reason IS NULL THEN text END AS text FROM funnel", **PARTS))
def page_funnel(spark, sf_dir):
    return _admitted(spark, sf_dir).select("page_id", "reason", "text")


@query(sql("SELECT coalesce(reason, 'admitted') AS reason, count(*) AS pages FROM funnel GROUP BY ALL", **PARTS))
def funnel_report(spark, sf_dir):
    return admission_funnel(_admitted(spark, sf_dir))


@query(sql(f"""
  SELECT input_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN body END AS text,
         '[FIT] ' || left(CASE WHEN is_url THEN raw ELSE 'pasted text' END, 300) AS label
  FROM (SELECT *, CASE WHEN raw = '' THEN 'blank'
          WHEN length(raw) > {PARAMS.fit_max_input_chars} THEN 'over {PARAMS.fit_max_input_chars} characters'
          WHEN is_url AND why IS NOT NULL THEN why || ' (paste it)'
          WHEN length(body) < {PARAMS.fit_min_chars} THEN 'too short to assess' END AS reason
        FROM (SELECT input_id, raw, is_url, CASE WHEN is_url THEN page ELSE raw END AS body, why FROM fit_inputs
              LEFT JOIN (SELECT url AS raw, min(CASE WHEN reason IS NULL THEN text END) AS page, min(reason) AS why
                         FROM funnel GROUP BY url) USING (raw)))""",
    fit_inputs=f"""
      SELECT input_id, trim(input, {SPACES}) AS raw, regexp_matches(trim(input, {SPACES}), '^(?i)https?://[^ ]+$') AS is_url FROM (
        SELECT 'd' || doc_id AS input_id, text AS input FROM documents
        UNION ALL SELECT 'c' || conv_id || '-' || turn, CASE role WHEN 'system' THEN '  ' ELSE text END FROM conversations
        UNION ALL SELECT 'p' || page_id, ' ' || url FROM pages)""", **{**PARTS, "served": f"""
      SELECT page_id, url, html, CASE substr(md5(url), 2, 1) WHEN 'a' THEN 404 WHEN 'b' THEN 503 ELSE 200 END AS http_status,
             CASE substr(md5(url), 3, 1) WHEN 'c' THEN 'image/png' WHEN 'd' THEN NULL ELSE 'text/html' END AS content_type
      FROM (SELECT min(page_id) AS page_id, url, min(html) AS html FROM pages GROUP BY url)"""}))
def fit_input(spark, sf_dir):
    """Documents and messages as pasted texts, page addresses as links."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("input_id"), L("text").alias("input"))
    talk = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), F.when(L("role") == "system", "  ").otherwise(L("text")))
    links = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id"), F.concat(F.lit(" "), "url"))
    status = served(spark, sf_dir).drop("url", "html").join(table(spark, sf_dir, "pages"), "page_id")
    once = status.groupBy("url").agg(*[F.min(c).alias(c) for c in ("page_id", "html", "http_status", "content_type")])
    pages = admit_pages(once, PARAMS, RULES, EMPTY, SHORT)
    return check_fit_inputs(docs.union(talk).union(links), pages, PARAMS)
