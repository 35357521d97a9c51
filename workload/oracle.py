"""DuckDB SQL for the registered queries.

Written apart from the Spark code and in another style: plain regular
expressions over the text of the pages at hand, string splitting for the
paragraphs, and a recursive walk with a minimum per address for the crawl.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

START = 1704067200

# -- derived tables --------------------------------------------------------

SITE_PAGES = """
site_pages AS (
  SELECT page_id, url, html, host,
         regexp_extract(url, '^([^?#]+)', 1) AS page_key,
         row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS rn
  FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages) t)"""

SITE_LINKS = SITE_PAGES + """,
site_links AS (
  SELECT s.page_id AS src_id, CAST(v.pos AS bigint) AS link_pos,
         CASE v.pos WHEN 4 THEN concat(t.page_key, '#again')
                    WHEN 5 THEN concat(t.page_key, '?ref=1')
                    ELSE t.url END AS link
  FROM site_pages s
  CROSS JOIN (VALUES (0,1),(1,2),(2,0),(4,1),(5,2)) v(pos, k)
  JOIN site_pages t
    ON t.host = s.host
   AND t.rn = CASE WHEN v.k = 0 THEN 0 ELSE 2 * s.rn + v.k END
  UNION ALL
  SELECT s.page_id, 3, t.url
  FROM site_pages s
  CROSS JOIN (SELECT count(*) AS n FROM pages) c
  JOIN site_pages t ON t.page_id = (s.page_id + 1) % c.n
  UNION ALL
  SELECT page_id, 6, concat('https://', host, '/missing/', CAST(rn AS varchar))
  FROM site_pages)"""

STORED = """
stored AS (
  SELECT page_id, url, html FROM pages
  UNION ALL
  SELECT page_id + 1000000000, concat(regexp_extract(url, '^([^?#]+)', 1), '?ref=1'),
         replace(html, '<title>', '<title>v2 ')
  FROM pages WHERE page_id % 3 = 0)"""

FETCH_LOG = STORED + """,
fetch_log AS (
  SELECT page_id, url, html,
         CASE WHEN page_id % 23 = 9 THEN 'fetch_error'
              WHEN page_id % 13 = 5 OR page_id % 17 = 3 THEN 'bad_status'
              WHEN page_id % 11 = 7 THEN 'non_html'
              WHEN page_id % 7 <> 2 AND page_id % 19 = 4 THEN 'non_html'
              ELSE 'ok' END AS outcome,
         1704067200 + page_id % 1000000000 AS crawled_at
  FROM stored)"""

ROBOTS = """
robots AS (
  SELECT origin,
         CASE WHEN length(origin) % 4 = 2 THEN 404 ELSE 200 END AS status,
         CASE length(origin) % 4
           WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /en/1', chr(10),
                              'Allow: /en/', chr(10), 'Crawl-delay: 2')
           WHEN 1 THEN concat('# note', chr(10), 'User-agent: TestBot/1.0', chr(10),
                              'Allow: /de/1', chr(10), 'Disallow: /de', chr(10),
                              'User-agent: *', chr(10), 'Disallow: /', chr(10), 'Crawl-delay: 0.5')
           WHEN 2 THEN 'gone'
           ELSE concat('User-agent: TestBot/1.0', chr(10), 'User-agent: Other', chr(10),
                       'Disallow: /fr', chr(10), 'Crawl-delay: abc') END AS body
  FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages) t),
robots_lines AS (
  SELECT origin, line_no - 1 AS line_no, lower(trim(split_part(line, ':', 1))) AS field,
         trim(substr(line, strpos(line, ':') + 1)) AS value
  FROM (SELECT origin, unnest(string_split(body, chr(10))) AS line,
               generate_subscripts(string_split(body, chr(10)), 1) AS line_no
        FROM robots WHERE status = 200) t
  WHERE line LIKE '%:%' AND line NOT LIKE '#%'),
robots_rules AS (
  SELECT origin, agent, line_no, value AS path, field = 'allow' AS allow
  FROM (SELECT *, last_value(CASE WHEN field = 'user-agent' THEN value END IGNORE NULLS)
                    OVER (PARTITION BY origin ORDER BY line_no) AS agent
        FROM robots_lines) t
  WHERE field IN ('allow', 'disallow') AND value <> '' AND agent <> ''),
robots_delay AS (
  SELECT r.origin,
         coalesce((SELECT arg_max(TRY_CAST(value AS double), line_no) FROM robots_lines l
                   WHERE l.origin = r.origin AND field = 'crawl-delay'
                     AND TRY_CAST(value AS double) > 0), 1.0) AS crawl_delay_s
  FROM robots r)"""

REQUESTS = """
crawl_requests AS (
  SELECT page_id AS request_id, host,
         CASE WHEN page_id % 10 = 9 THEN concat('ftp://', host) ELSE url END AS url,
         CASE WHEN page_id % 4 = 3 THEN NULL ELSE page_id % 4 END AS depth,
         CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 4 THEN 101
              ELSE page_id % 5 + 4 END AS max_pages,
         CAST(NULL AS bigint) AS workers, page_id % 12 AS delay,
         CAST(NULL AS bigint) AS timeout,
         page_id % 3 <> 0 AS stay_domain,
         CASE WHEN page_id % 6 = 1 THEN '/e' END AS filter,
         page_id % 8 = 7 AS seed_only, page_id % 9 <> 8 AS extract_links,
         page_id % 2 = 0 AS news,
         CASE WHEN page_id % 5 = 2 THEN 'Other' ELSE 'TestBot/1.0' END AS agent
  FROM site_pages),
filled AS (
  SELECT request_id, host, url, coalesce(depth, 1) AS depth, coalesce(max_pages, 20) AS max_pages,
         coalesce(workers, 2) AS workers, coalesce(delay, 1) AS delay,
         coalesce(timeout, 10) AS timeout, stay_domain, coalesce(filter, '') AS filter,
         seed_only, extract_links, news, agent
  FROM crawl_requests),
asked AS (
  SELECT * FROM filled
  WHERE url LIKE 'http%' AND depth BETWEEN 0 AND 5 AND max_pages BETWEEN 1 AND 100
    AND workers BETWEEN 1 AND 10 AND delay BETWEEN 0 AND 10 AND timeout BETWEEN 5 AND 60)"""


def key_of(url: str) -> str:
    """The page addresses at hand have no escapes and no user information."""
    return f"regexp_extract({url}, '^([^?#]+)', 1)"


def host_of(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]+)', 1)"


def origin_of(url: str) -> str:
    return f"regexp_extract({url}, '^([a-z]+://[^/?#]+)', 1)"


def path_of(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


EDGES = f"""
idx AS (
  SELECT {key_of('url')} AS key, min(page_id) AS page_id FROM pages GROUP BY 1),
edges AS (
  SELECT l.src_id, p.url AS src_url, {key_of('p.url')} AS src_key, {host_of('p.url')} AS src_host,
         l.link_pos, l.link AS url, {key_of('l.link')} AS key, {host_of('l.link')} AS host
  FROM site_links l JOIN pages p ON p.page_id = l.src_id)"""


def allowed(rows: str, agent: str) -> str:
    """url -> allowed for the distinct addresses of ``rows``."""
    return f"""
verdict AS (
  SELECT u.url,
         coalesce(arg_min(r.allow, (CASE WHEN r.agent = '*' THEN 1 ELSE 0 END) * 1000 + r.line_no),
                  true) AS allowed
  FROM (SELECT DISTINCT url FROM {rows}) u
  LEFT JOIN robots_rules r
    ON r.origin = {origin_of('u.url')} AND r.agent IN ('{agent}', '*')
   AND starts_with(CASE WHEN {path_of('u.url')} = '' THEN '/' ELSE {path_of('u.url')} END, r.path)
  GROUP BY u.url)"""


#: What stands for an address: the page stored under it, else the one with the smallest id of its key.
ANSWERS = f"""
exact AS (
  SELECT regexp_extract(url, '^([^#]*)', 1) AS address, min(page_id) AS page_id FROM stored GROUP BY 1),
by_key AS (
  SELECT {key_of('url')} AS key, min(page_id) AS page_id FROM stored GROUP BY 1)"""


def verdicts(addresses: str) -> str:
    """(url, agent) -> allowed."""
    return f"""
verdict AS (
  SELECT u.url, g.agent,
         coalesce(arg_min(r.allow, (CASE WHEN r.agent = '*' THEN 1 ELSE 0 END) * 1000 + r.line_no),
                  true) AS allowed
  FROM (SELECT DISTINCT url FROM {addresses}) u CROSS JOIN (VALUES ('TestBot/1.0'), ('Other')) g(agent)
  LEFT JOIN robots_rules r
    ON r.origin = {origin_of('u.url')} AND r.agent IN (g.agent, '*')
   AND starts_with(CASE WHEN {path_of('u.url')} = '' THEN '/' ELSE {path_of('u.url')} END, r.path)
  GROUP BY u.url, g.agent)"""


def crawl_tables(seed_only: str = "a.seed_only", with_robots: bool = True, deep: bool = False) -> str:
    """Level by level, written out: no request goes deeper than 3, so 5 levels hold every queue."""
    addresses = "(SELECT url FROM asked UNION SELECT url FROM edges)"
    requests = REQUESTS
    if deep:
        requests = REQUESTS.replace("asked AS (", "bounded AS (") + """,
asked AS (
  SELECT * REPLACE (3 AS depth, '' AS filter, true AS extract_links, false AS seed_only)
  FROM bounded)"""
    denied = "NOT v.allowed" if with_robots else "false"
    parts = [
        f"""WITH {SITE_LINKS}, {FETCH_LOG}, {ROBOTS}, {requests}, {EDGES}, {ANSWERS}, {verdicts(addresses)},
node AS (
  SELECT v.url, v.agent, coalesce(x.page_id, k.page_id) AS page_id, l.crawled_at,
         CASE WHEN {denied} THEN 'robots_denied'
              WHEN coalesce(x.page_id, k.page_id) IS NULL THEN 'fetch_error'
              WHEN l.outcome = 'ok' THEN 'crawled' ELSE l.outcome END AS outcome
  FROM verdict v
  LEFT JOIN exact x ON x.address = regexp_extract(v.url, '^([^#]*)', 1)
  LEFT JOIN by_key k ON k.key = {key_of('v.url')}
  LEFT JOIN fetch_log l ON l.page_id = coalesce(x.page_id, k.page_id)),
new0 AS (
  SELECT request_id, {key_of('url')} AS key, url, [CAST(0 AS bigint)] AS path FROM asked),
done0 AS (SELECT request_id, 0 AS done FROM asked)"""
    ]
    for n in range(5):
        if n:
            earlier = " UNION ALL ".join(f"SELECT request_id, key FROM level{i}" for i in range(n))
            parts.append(f"""
new{n} AS (
  SELECT w.request_id, e.key, e.url, list_append(w.path, e.link_pos) AS path
  FROM level{n - 1} w JOIN asked a USING (request_id) JOIN edges e ON e.src_id = w.page_id
  WHERE w.taken AND w.outcome = 'crawled' AND a.extract_links AND NOT {seed_only}
    AND (NOT a.stay_domain OR e.host = e.src_host)
    AND (a.filter = '' OR contains(e.url, a.filter))
    AND (w.request_id, e.key) NOT IN (SELECT (request_id, key) FROM ({earlier}) k)
  QUALIFY row_number() OVER (PARTITION BY w.request_id, e.key ORDER BY list_append(w.path, e.link_pos)) = 1),
done{n} AS (
  SELECT request_id, any_value(d.done) + count(*) FILTER (w.outcome = 'crawled') AS done
  FROM done{n - 1} d LEFT JOIN level{n - 1} w USING (request_id) GROUP BY request_id)""")
        parts.append(f"""
level{n} AS (
  SELECT f.*, {n} AS depth, n.page_id, n.crawled_at,
         CASE WHEN {n} > a.depth THEN 'too_deep' ELSE n.outcome END AS outcome,
         d.done + coalesce(sum(CASE WHEN {n} <= a.depth AND n.outcome = 'crawled' THEN 1 ELSE 0 END)
           OVER (PARTITION BY f.request_id ORDER BY f.path
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < a.max_pages AS taken
  FROM new{n} f JOIN asked a USING (request_id) JOIN node n ON n.url = f.url AND n.agent = a.agent
  JOIN done{n} d USING (request_id))""")
    levels = " UNION ALL ".join(f"SELECT * FROM level{n}" for n in range(5))
    parts.append(f"""
admitted AS ({levels}),
visited AS (
  SELECT v.*, CASE WHEN v.outcome = 'crawled' AND a.extract_links
                   THEN (SELECT count(*) FROM site_links l WHERE l.src_id = v.page_id)
                   ELSE 0 END AS links_found
  FROM admitted v JOIN asked a USING (request_id) WHERE v.taken AND v.outcome <> 'too_deep')""")
    return ",".join(parts)


CRAWL = crawl_tables()

# -- page text -------------------------------------------------------------

# Comments go; the script's "</p>" is masked; a tag cut off at the end goes.
DOC = """
doc AS (
  SELECT page_id, url,
         regexp_replace(
           replace(regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'),
                                  '<![^>]*(>|$)', '', 'g'),
                   '"</p>"', '"@@/p>"'),
           '</?[a-zA-Z][^>]*$', '') AS d
  FROM pages)"""


def decoded(text: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def stripped(markup: str) -> str:
    return f"replace({decoded(f"regexp_replace({markup}, '</?[a-zA-Z][^>]*>', '', 'g')")}, '@@/p>', '</p>')"


WHITE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(8195), chr(8203 - 1), chr(12288))"

TITLE = decoded("coalesce(regexp_extract(d, '<title>([^<]*)', 1), '')")
NEWS = (
    "CASE WHEN d LIKE '%<article>%' THEN "
    + stripped("string_split(regexp_extract(d, '<article>(.*)', 1, 's'), '</article>')[1]")
    + " ELSE '' END"
)
CONTENT = f"""coalesce(list_aggregate(
    list_transform(
      list_filter(
        list_transform(string_split_regex(d, '<p>')[2:],
          lambda x: trim({stripped("string_split_regex(x, '</?(p|article|footer|div|nav|ul|li|h1)>')[1]")}, {WHITE})),
        lambda x: x <> ''),
      lambda x: concat(x, chr(10))),
    'string_agg', ''), '')"""

# Fixed values, written out here so that an error in the library's lists shows.
SKIP = (
    r"\.(pdf|jpg|jpeg|png|gif|css|js|ico|svg|xml|json|mp3|mp4|avi|mov|mpg|mpeg|zip|tar|gz|rar)$"
    r"|/cdn-cgi/|/wp-admin/|/wp-includes/|javascript:|mailto:|tel:|sms:|/feed/|/rss/|/print/|/search\?"
    r"|login|logout|signin|signup|register"
)

_KEPT = {
    "%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3B": ";",
    "%3D": "=", "%40": "@", "%7E": "~",
}


def encoded(path: str) -> str:
    text = f"replace(replace(url_encode({path}), '+', '%20'), '*', '%2A')"
    for code, char in _KEPT.items():
        text = f"replace({text}, '{code}', '{char}')"
    plain = r"^[A-Za-z0-9\-_.~$&+,/:;=@!''()*\[\]%]*$"
    return f"CASE WHEN regexp_matches({path}, '{plain}') THEN {path} ELSE {text} END"


#: The markup that the varied pages have besides their own, and how their articles begin and end.
MORE_HREFS = (
    '', '#top', 'mailto:a@b.example', 'javascript:void(0)', '../up/x', 'sub/page', '?q=1', '//cdn.example.org/x',
    'https://other.example.org/a.PDF', '/files/a.zip', '/wp-admin/x', 'ftp://f.example.org/x', '/a?x=1#frag',
    'https://other.example.org/login', '/photo.jpeg', 'http://third.example.org/en/',
)


def hrefs_of(source: str, varied: bool = False) -> str:
    """hrefs, resolved, kept and link_lists of the anchors in a table of pages."""
    more = "".join(f", '{h}'" for h in MORE_HREFS)
    own = f"regexp_extract_all(d, '<a href=\"([^\"]*)\"[^>]*>', 1)"
    # the further anchors stand after the page's own, at the end of its menu
    every = f"list_concat(list_transform({own}, lambda x: {decoded('x')}), [{more[2:]}])" if varied else f"list_transform({own}, lambda x: {decoded('x')})"
    folder = "regexp_extract(regexp_extract(url, '^([^?#]+)', 1), '^([a-z]+://.*/)', 1)"
    return DOC.replace("FROM pages", f"FROM {source}") + f""",
hrefs AS (
  SELECT page_id, url, i - 1 AS link_pos, h[i] AS href
  FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT page_id, url, {every} AS h FROM doc) x) y),
resolved AS (
  SELECT *,
         CASE WHEN href = '' THEN url
              WHEN href LIKE '#%' THEN regexp_extract(url, '^([^#]+)', 1) || href
              WHEN href LIKE '?%' THEN {key_of('url')} || href
              WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)', 1) || href
              WHEN regexp_matches(href, '^[a-z]+:') THEN href
              WHEN href LIKE '../%' THEN regexp_replace({folder}, '[^/]+/$', '') || substr(href, 4)
              WHEN href = 'sub/page' THEN {folder} || href
              WHEN href LIKE '%?%#%' THEN {origin_of('url')} || href
              ELSE concat({origin_of('url')}, {encoded('href')}) END AS link
  FROM hrefs),
kept AS (
  SELECT page_id, url AS src_url, link, link_pos,
         row_number() OVER (PARTITION BY page_id ORDER BY link_pos) - 1 AS pos
  FROM resolved
  WHERE href <> '' AND href NOT LIKE '#%' AND link LIKE 'http%'
    AND NOT regexp_matches(lower(link), '{SKIP}')),
link_lists AS (
  SELECT p.page_id, count(k.link) AS n_links,
         coalesce(string_agg(k.link, ' ' ORDER BY k.pos), '') AS links
  FROM {source} p LEFT JOIN kept k USING (page_id) GROUP BY p.page_id)"""


HREFS = hrefs_of("pages")
STORED_HREFS = hrefs_of("stored")
VARIED_HREFS = hrefs_of("pages", varied=True)

RECORDS = f"""
records AS (
  SELECT page_id, {TITLE} AS title, '' AS description, {CONTENT} AS content, {NEWS} AS news_text
  FROM doc)"""

# -- sources ---------------------------------------------------------------

ORACLE["read_pages"] = "SELECT page_id, url, length(html) AS chars FROM pages"
ORACLE["fetch_outcome"] = f"WITH {FETCH_LOG} SELECT page_id, outcome FROM fetch_log"
ORACLE["read_robots"] = f"""WITH {ROBOTS}
SELECT origin, CASE WHEN status = 200 THEN body ELSE '' END AS body FROM robots"""

# -- requests --------------------------------------------------------------

WITH_REQUESTS = f"WITH {SITE_PAGES}, {REQUESTS}"
ORACLE["valid_request_url"] = f"""{WITH_REQUESTS}
SELECT request_id, regexp_matches(url, '^https?://[^/?#]') AS strict,
       starts_with(url, 'http://') OR starts_with(url, 'https://') AS prefix
FROM crawl_requests"""
ERRORS = """SELECT request_id, concat_ws(' ',
        CASE WHEN url NOT LIKE 'http://%' AND url NOT LIKE 'https://%' THEN 'url' END,
        CASE WHEN depth NOT BETWEEN 0 AND 5 THEN 'depth' END,
        CASE WHEN max_pages NOT BETWEEN 1 AND 100 THEN 'max_pages' END,
        CASE WHEN workers NOT BETWEEN 1 AND 10 THEN 'workers' END,
        CASE WHEN delay NOT BETWEEN 0 AND 10 THEN 'delay' END,
        CASE WHEN timeout NOT BETWEEN 5 AND 60 THEN 'timeout' END) AS errors FROM filled"""
ORACLE["validate_requests"] = f"""{WITH_REQUESTS}
SELECT request_id, errors, errors = '' AS valid FROM ({ERRORS}) t"""
ORACLE["request_defaults"] = f"""{WITH_REQUESTS}
SELECT request_id, url, depth, max_pages, workers, delay, timeout, stay_domain, filter,
       seed_only, extract_links, news FROM filled"""
ORACLE["time_budget"] = f"""{WITH_REQUESTS}
SELECT request_id, timeout * max_pages + 30 AS budget_s FROM filled"""
ASKED_PAGES = f"""WITH {SITE_PAGES}, {FETCH_LOG}, {REQUESTS}, {ROBOTS}, {ANSWERS},
{verdicts('crawl_requests')}, {STORED_HREFS}, {RECORDS},
answered AS (
  SELECT q.request_id, q.url, q.extract_links, f.page_id, f.crawled_at
  FROM crawl_requests q
  JOIN verdict v ON v.url = q.url AND v.agent = q.agent AND v.allowed
  LEFT JOIN exact x ON x.address = regexp_extract(q.url, '^([^#]*)', 1)
  LEFT JOIN by_key k ON k.key = {key_of('q.url')}
  JOIN fetch_log f ON f.page_id = coalesce(x.page_id, k.page_id) AND f.outcome = 'ok')"""
ORACLE["scrape"] = f"""{ASKED_PAGES}
SELECT a.request_id, a.url, r.title, r.description, r.content,
       CASE WHEN a.extract_links THEN l.links ELSE '' END AS links, a.crawled_at,
       CAST(0 AS bigint) AS depth
FROM answered a JOIN records r USING (page_id) JOIN link_lists l USING (page_id)"""
ORACLE["page_links"] = f"""{ASKED_PAGES}
SELECT a.request_id, a.url, l.n_links AS links_found, l.links
FROM answered a JOIN link_lists l USING (page_id)"""

# -- addresses -------------------------------------------------------------

WITH_LINKS = f"WITH {SITE_LINKS}"
ORACLE["url_parts"] = f"""{WITH_LINKS}
SELECT src_id, link_pos, split_part(link, '://', 1) AS scheme, {host_of('link')} AS host,
       {path_of('link')} AS path, regexp_extract(link, '\\?([^#]*)', 1) AS query,
       regexp_extract(link, '#(.*)$', 1) AS fragment
FROM site_links"""
ORACLE["resolve_links"] = f"WITH {VARIED_HREFS} SELECT page_id, link_pos, href, link AS resolved FROM resolved"
ORACLE["http_links"] = f"""WITH {VARIED_HREFS}
SELECT page_id, link_pos, link FROM resolved WHERE link LIKE 'http://%' OR link LIKE 'https://%'"""
ORACLE["skip_links"] = f"""WITH {VARIED_HREFS}
SELECT page_id, link_pos, href, regexp_matches(lower(href), '{SKIP}') AS skipped FROM hrefs"""
ORACLE["canonical_key"] = f"{WITH_LINKS} SELECT src_id, link_pos, {key_of('link')} AS key FROM site_links"
ORACLE["url_host"] = f"SELECT page_id, {host_of('url')} AS host FROM pages"
ORACLE["live_hrefs"] = f"""WITH {VARIED_HREFS}
SELECT page_id, link_pos, href FROM hrefs WHERE href <> '' AND href NOT LIKE '#%'"""
ORACLE["url_contains"] = "SELECT page_id, url FROM pages WHERE strpos(url, '/en/') > 0"

# -- extraction ------------------------------------------------------------

ORACLE["page_title"] = f"WITH {DOC} SELECT page_id, {TITLE} AS title FROM doc"
ORACLE["page_description"] = """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('graph ', page_id)
                                 WHEN 2 THEN concat('about ', page_id) ELSE concat('last ', page_id) END AS description
FROM pages"""
ORACLE["page_content"] = f"WITH {DOC} SELECT page_id, {CONTENT} AS content FROM doc"
# pages by how their article is marked: 0 and 1 as it stands, 2 to 7 trimmed with a line end, 8 and 9 by paragraphs, 10 not at all
_INSIDE = "string_split(regexp_extract(d, '<article>(.*)', 1, 's'), '</article>')[1]"
_PARAGRAPHS = f"""list_aggregate(list_transform(string_split_regex({_INSIDE}, '<p>')[2:],
      lambda x: concat({stripped("string_split_regex(x, '</?(p|article|footer|div|nav|ul|li|h1)>')[1]")}, chr(10))), 'string_agg', '')"""
ORACLE["news_content"] = f"""WITH {DOC}
SELECT page_id,
       CASE WHEN page_id % 11 < 2 THEN {NEWS}
            WHEN page_id % 11 < 8 THEN trim({NEWS}, {WHITE})
            WHEN page_id % 11 < 10 THEN trim(coalesce({_PARAGRAPHS}, ''), {WHITE}) ELSE '' END AS content
FROM doc"""
ORACLE["extract_links"] = f"WITH {HREFS} SELECT page_id, n_links, links FROM link_lists"
ORACLE["link_edges"] = f"""WITH {HREFS}
SELECT page_id AS src_id, {key_of('src_url')} AS src_key, src_url, {host_of('src_url')} AS src_host,
       pos AS link_pos, link AS url,
       CASE WHEN link LIKE '%\\%%' ESCAPE '\\' THEN url_decode(replace({key_of('link')}, '+', '%2B'))
            ELSE {key_of('link')} END AS key, {host_of('link')} AS host
FROM kept"""
#: What a tree builder makes of the wrongly nested markup of each page, written out.
UNTANGLED = (
    "firstsecond<table><tr><td>cell</td></tr></table>",
    "<p></p>x",
    "<b></b><p><b>bold</b>not</p>",
    "<table><tr><td><p>in</p><p>cell</p></td><td>two</td></tr></table>",
    "<ul><li><p>one</p></li><li>two</li></ul>",
    "<select><option>ab</option></select>",
    "<p>moved</p><table><tr><td>kept</td></tr></table>",
    "<p>open</p><table><tr><td>closes it</td></tr></table>",
    "<p>one</p><p>twothree</p>",
    "<h2>head</h2><h3>line</h3>",
)
_UNTANGLED = "[" + ", ".join(f"'{x}'" for x in UNTANGLED) + "]"
ORACLE["tangled_content"] = f"""WITH {DOC.replace("FROM pages", f"""
  FROM (SELECT page_id, url, replace(html, '</nav>', concat('</nav>', {_UNTANGLED}[page_id % 10 + 1])) AS html FROM pages) t""")}
SELECT page_id, {CONTENT} AS content, trim({stripped('d')}, {WHITE}) AS text,
       CASE WHEN page_id % 10 = 8 AND d LIKE '%</nav>%' THEN 3 ELSE 0 END AS n_tangled
FROM doc"""
ORACLE["strip_tags"] = f"WITH {DOC} SELECT page_id, trim({stripped('d')}, {WHITE}) AS text FROM doc"
ORACLE["element_text"] = f"""WITH {DOC}
SELECT page_id,
       CASE WHEN d LIKE '%<div class="ad">%'
            THEN {stripped("string_split(string_split(d, '<div class=\"ad\">')[2], '</div>')[1]")} END AS ad,
       CASE WHEN d LIKE '%<h1>%'
            THEN {stripped("string_split(string_split(d, '<h1>')[2], '</h1>')[1]")} END AS h1
FROM doc"""
ORACLE["parse_pages"] = f"""WITH {STORED}, {STORED_HREFS}, {RECORDS}
SELECT p.page_id, p.url, r.title, r.description, r.content, l.links,
       {START} + p.page_id % 1000000000 AS crawled_at, CAST(0 AS bigint) AS depth
FROM stored p JOIN records r USING (page_id) JOIN link_lists l USING (page_id)"""

# -- frontier and crawl ----------------------------------------------------

WITH_EDGES = f"WITH {SITE_LINKS}, {EDGES}"
ORACLE["frontier_dedup"] = f"""{WITH_EDGES}, {FETCH_LOG}
SELECT src_host AS request_id, key, arg_min(url, src_id * 100 + link_pos) AS url
FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM fetch_log p WHERE p.outcome = 'ok'
                  AND {host_of('p.url')} = e.src_host AND {key_of('p.url')} = e.key)
GROUP BY src_host, key"""
EXPANDED = """
FROM asked a JOIN edges e ON e.src_id = a.request_id
WHERE a.extract_links AND NOT a.seed_only AND (NOT a.stay_domain OR e.host = e.src_host)"""
ORACLE["expand_frontier"] = f"""{WITH_EDGES}, {REQUESTS}
SELECT a.request_id, e.key, e.url, CAST(1 AS bigint) AS depth, e.link_pos {EXPANDED}
  AND (a.filter = '' OR strpos(e.url, a.filter) > 0)"""
ORACLE["filter_links"] = f"""{WITH_EDGES}, {REQUESTS}
SELECT a.request_id, e.url, e.link_pos {EXPANDED} AND strpos(e.url, '/en/') > 0"""
ORACLE["stay_on_domain"] = f"""{WITH_EDGES}
SELECT src_id, link_pos, url FROM edges WHERE host = src_host"""
ORACLE["depth_limit"] = f"""{CRAWL}
SELECT request_id, count(*) AS urls, CAST(max(depth) AS bigint) AS deepest
FROM admitted WHERE depth <= (SELECT depth FROM asked a WHERE a.request_id = admitted.request_id)
GROUP BY request_id"""
ORACLE["seed_only"] = f"""{crawl_tables('true', with_robots=False)}
SELECT request_id, url, outcome, links_found FROM visited"""
ORACLE["crawl_deep"] = f"""{crawl_tables(with_robots=False, deep=True)}
SELECT request_id, key, url, CAST(depth AS bigint) AS depth, outcome, taken FROM admitted"""
ORACLE["crawl_order"] = f"""{CRAWL}
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY depth, path) AS position, url
FROM visited"""
ORACLE["max_pages"] = f"""WITH {SITE_PAGES}, {FETCH_LOG}
SELECT page_id, outcome
FROM (SELECT s.page_id, CASE WHEN outcome = 'ok' THEN 'crawled' ELSE outcome END AS outcome,
             coalesce(sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END)
               OVER (PARTITION BY host ORDER BY rn
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM site_pages s JOIN fetch_log USING (page_id)) t
WHERE before < 5"""

PAGE_DATA = f"""{CRAWL}, {DOC.replace('FROM pages', 'FROM stored')}, {RECORDS},
page_links AS (
  SELECT src_id, string_agg(link, ' ' ORDER BY link_pos) AS links FROM site_links GROUP BY src_id),
page_data AS (
  SELECT v.request_id, v.path, v.url, r.title, r.description,
         CASE WHEN a.news THEN r.news_text ELSE r.content END AS content,
         CASE WHEN a.extract_links THEN coalesce(l.links, '') ELSE '' END AS links,
         v.crawled_at, CAST(v.depth AS bigint) AS depth
  FROM visited v JOIN asked a USING (request_id) JOIN records r USING (page_id)
  LEFT JOIN page_links l ON l.src_id = v.page_id
  WHERE v.outcome = 'crawled')"""
_RECORD = "url, title, description, content, links, crawled_at, depth"
ORACLE["crawl"] = f"{PAGE_DATA} SELECT request_id, {_RECORD} FROM page_data"
for _name in ("write_json", "read_results", "write_results"):
    ORACLE[_name] = f"{PAGE_DATA} SELECT {_RECORD} FROM page_data"
ORACLE["write_csv"] = f"""{PAGE_DATA}
SELECT url AS "URL", title AS "Title", description AS "Description", content AS "Content",
       replace(links, ' ', ',') AS "Links",
       strftime(make_timestamp(crawled_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS "CrawledAt",
       CAST(depth AS varchar) AS "Depth"
FROM page_data"""
ORACLE["crawl_response"] = f"""{PAGE_DATA}
SELECT c.request_id, c.errors, count(p.url) AS pages_crawled,
       CASE WHEN c.errors = '' THEN coalesce(string_agg(p.url, ' ' ORDER BY p.depth, p.path), '') END AS urls,
       CASE WHEN c.errors = '' THEN coalesce(string_agg(p.title, '|' ORDER BY p.depth, p.path), '') END AS titles,
       CAST(coalesce(max(p.crawled_at) - min(p.crawled_at), 0) AS double) AS execution_time_seconds
FROM ({ERRORS}) c LEFT JOIN page_data p USING (request_id) GROUP BY c.request_id, c.errors"""
ORACLE["not_found"] = f"""{CRAWL}
SELECT request_id, url FROM crawl_requests c
WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.request_id = c.request_id AND v.outcome = 'crawled')"""
ORACLE["pending_frontier"] = f"""{CRAWL}
SELECT request_id, CAST(depth AS bigint) AS depth, count(*) AS queue_size
FROM admitted WHERE NOT taken GROUP BY request_id, depth"""
ORACLE["visited_count"] = f"""{CRAWL}
SELECT request_id, count(*) AS visited_count FROM admitted GROUP BY request_id"""
ORACLE["visited_lookup"] = f"""{CRAWL}
SELECT DISTINCT a.request_id, t.link AS url,
       EXISTS (SELECT 1 FROM admitted m WHERE m.request_id = a.request_id AND m.url = t.link) AS visited
FROM asked a JOIN site_links t ON t.src_id = a.request_id"""
ORACLE["uncrawled_links"] = f"""WITH {HREFS},
named AS (
  SELECT *, CASE WHEN link LIKE '%\\%%' ESCAPE '\\'
                 THEN url_decode(replace({key_of('link')}, '+', '%2B'))
                 ELSE {key_of('link')} END AS key
  FROM kept)
SELECT key, arg_min(link, page_id * 100000 + pos) AS url FROM named
WHERE key NOT IN (SELECT {key_of('url')} FROM pages) GROUP BY key"""

# -- robots and politeness -------------------------------------------------

ORACLE["robots_rules"] = f"WITH {ROBOTS} SELECT origin, agent, line_no, path, allow FROM robots_rules"
ORACLE["crawl_delay"] = f"WITH {ROBOTS} SELECT origin, crawl_delay_s FROM robots_delay"
ORACLE["robots_allowed"] = f"""WITH {ROBOTS}, {allowed('pages', 'TestBot/1.0')}
SELECT page_id, p.url, allowed, coalesce(crawl_delay_s, 1.0) AS crawl_delay_s
FROM pages p JOIN verdict v ON v.url = p.url LEFT JOIN robots_delay d ON d.origin = {origin_of('p.url')}"""
ORACLE["robots_filter"] = f"""WITH {SITE_LINKS}, {ROBOTS},
{allowed('(SELECT link AS url FROM site_links)', 'Other')}
SELECT src_id, link_pos, link AS url FROM site_links l JOIN verdict v ON v.url = l.link
WHERE allowed"""
ORACLE["robots_default"] = f"""WITH {SITE_LINKS}, {ROBOTS},
origins AS (SELECT DISTINCT {origin_of('link')} AS origin FROM site_links)
SELECT o.origin, coalesce(r.status = 200, false) AS usable,
       (SELECT count(*) FROM robots_rules u WHERE u.origin = r.origin) AS n_rules,
       coalesce(d.crawl_delay_s, 1.0) AS crawl_delay_s
FROM origins o
LEFT JOIN robots r ON r.origin = o.origin
LEFT JOIN robots_delay d ON d.origin = r.origin"""
VISITS = f"""
visits AS (
  SELECT e.event_id AS visit_id, p.url, {origin_of('p.url')} AS origin, e.ts AS at_ts
  FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c
  JOIN pages p ON p.page_id = e.event_id % c.n)"""
ORACLE["robots_asof"] = f"""WITH {VISITS},
snapshots AS (
  SELECT origin, min(at_ts) AS fetched_at FROM visits GROUP BY origin, date_trunc('week', at_ts))
SELECT v.visit_id, v.origin, CAST(floor(epoch(v.at_ts)) AS bigint) AS "at",
       CAST(floor(epoch(s.fetched_at)) AS bigint) AS robots_at,
       s.fetched_at IS NULL OR v.at_ts - s.fetched_at > INTERVAL 24 HOUR AS needs_refetch
FROM visits v ASOF LEFT JOIN snapshots s ON s.origin = v.origin AND s.fetched_at <= v.at_ts"""
ORACLE["host_spacing"] = f"""{WITH_REQUESTS}, {ROBOTS}
SELECT request_id, greatest(CAST(delay AS double), coalesce(crawl_delay_s, 1.0)) AS spacing_s
FROM filled f LEFT JOIN robots_delay d ON d.origin = {origin_of('f.url')}"""
ORACLE["fetch_schedule"] = f"""{CRAWL},
ranked AS (
  SELECT v.request_id, v.url, {host_of('v.url')} AS host, {origin_of('v.url')} AS origin,
         row_number() OVER (PARTITION BY v.request_id, {host_of('v.url')}
                            ORDER BY v.depth, v.path) AS host_rank
  FROM visited v)
SELECT r.request_id, r.url, r.host, r.host_rank,
       r.host_rank * greatest(CAST(a.delay AS double), coalesce(d.crawl_delay_s, 1.0)) AS fetch_offset_s
FROM ranked r JOIN asked a USING (request_id) LEFT JOIN robots_delay d ON d.origin = r.origin"""

# -- statistics ------------------------------------------------------------

ORACLE["crawl_stats"] = f"""{CRAWL}
SELECT a.request_id, count(v.url) AS pages_crawled,
       CAST(coalesce(sum(v.links_found), 0) AS BIGINT) AS links_discovered,
       min(v.crawled_at) AS start_time, max(v.crawled_at) AS end_time
FROM asked a LEFT JOIN visited v ON v.request_id = a.request_id AND v.outcome = 'crawled'
GROUP BY a.request_id"""
ORACLE["skip_reasons"] = f"""{CRAWL}
SELECT request_id, outcome, count(*) AS urls FROM visited GROUP BY ROLLUP (request_id, outcome)"""

# -- streaming: the same rows as in batch ----------------------------------

ORACLE["stream_pages"] = f"""WITH {HREFS}, {RECORDS}
SELECT p.url, r.title, r.description, r.content, l.links, {START} + p.page_id AS crawled_at,
       CAST(0 AS bigint) AS depth
FROM pages p JOIN records r USING (page_id) JOIN link_lists l USING (page_id)"""
NAMED = f"""WITH {HREFS},
named AS (
  SELECT *, CASE WHEN link LIKE '%\\%%' ESCAPE '\\'
                 THEN url_decode(replace({key_of('link')}, '+', '%2B'))
                 ELSE {key_of('link')} END AS key
  FROM kept)"""
ORACLE["stream_dedup"] = f"""{NAMED}
SELECT key, arg_min(link, page_id * 100000 + pos) AS url FROM named GROUP BY key"""
ORACLE["stream_dedup_bounded"] = f"""{NAMED},
n AS (SELECT greatest(count(*), 1) AS n FROM pages),
arrived AS (
  SELECT key, page_id AS t, CASE WHEN page_id % 10 = 0 THEN 3
         ELSE coalesce(greatest(least(floor(page_id * 4 / n), 3), 0), 0) END AS part
  FROM named, n WHERE key IS NOT NULL),
newest AS (SELECT part, max(t) AS newest FROM arrived GROUP BY part),
judged AS (
  SELECT a.key, coalesce(a.t <= (SELECT max(w.newest) FROM newest w WHERE w.part < a.part) - greatest(n // 2, 1),
                         a.t IS NULL) AS late
  FROM arrived a, n)
SELECT key, bool_or(NOT late) AS seen, CAST(count(*) FILTER (WHERE late) AS bigint) AS n_late FROM judged GROUP BY key"""
ORACLE["stream_stats"] = f"""WITH {HREFS}
SELECT {host_of('p.url')} AS host, count(*) AS pages_crawled,
       CAST(sum(n_links) AS bigint) AS links_discovered
FROM pages p JOIN link_lists l USING (page_id) GROUP BY 1"""
ORACLE["stream_robots"] = f"""WITH RECURSIVE {VISITS},
due AS (
  SELECT origin, min(at_ts) AS held FROM visits GROUP BY origin
  UNION ALL
  SELECT d.origin, min(v.at_ts) FROM due d JOIN visits v
    ON v.origin = d.origin AND v.at_ts > d.held + INTERVAL 24 HOUR
  GROUP BY d.origin, d.held)
SELECT origin, CAST(floor(epoch(held)) AS bigint) AS fetched_at FROM due"""
