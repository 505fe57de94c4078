"""What every catalog query should return, as SQL over the given tables.

The statements know the texts that ``render`` writes and work out the records
from the orders themselves; they read no page that was rendered.
"""

from __future__ import annotations

from eventmill.catalog.render import RUN_AT, WELCOME
from eventmill.schema import LAYOUTS, RECORD_FIELDS

TODAY = RUN_AT[:10]
FIELDS = ", ".join(RECORD_FIELDS)


def written(day: str) -> str:
    return f"""case pri when '1-URGENT' then strftime({day}, '%A, %B %-d, %Y')
      when '2-HIGH' then strftime({day}, '%b %-d, %Y')
      when '3-MEDIUM' then strftime({day}, '%Y-%m-%d')
      when '4-NOT SPECIFIED' then strftime({day}, '%-m/%-d/%y')
      else strftime({day}, '%B %-d') end"""


def yearless(day: str) -> str:
    """ISO date of `day` written without its year; the base is 2026-07-01."""
    return f"""case when strftime({day}, '%m-%d') = '02-29' then '2028-02-29'
      when strftime({day}, '%m-%d') < '07-01' then '2027-' || strftime({day}, '%m-%d')
      else '2026-' || strftime({day}, '%m-%d') end"""


def read_back(day: str) -> str:
    """ISO date of `day` as written in the style of its priority."""
    return f"""case when pri = '4-NOT SPECIFIED' then '20' || strftime({day}, '%y-%m-%d')
      when pri = '5-LOW' then {yearless(day)}
      else strftime({day}, '%Y-%m-%d') end"""


ORDERS = f"""
  raw as (
    select o_orderkey as k, cast(o_orderkey as varchar) as ks, o_orderkey // 8 as page_id,
      o_custkey as cust, o_orderstatus as st, o_orderpriority as pri, o_totalprice as price,
      cast(o_orderdate as date) as day, cast(o_orderdate as date) + 2 as day2
    from orders),
  firsts as (select page_id, arg_min(cust, k) as cust from raw group by page_id),
  names as (
    select page_id, c_name as partner, 'https://p' || page_id || '.example.org' as site
    from firsts join customer on c_custkey = cust),
  o as (
    select raw.*, partner, site,
      'Order ' || ks || case when price >= 495000 then repeat(' very long', 20) else '' end as title,
      case when price < 30000 then rtrim(repeat('Notes for order ' || ks || '. ', 50))
        else 'Notes for order ' || ks || '.' end as about,
      {written("day")} as d1, {written("day2")} as d2,
      {read_back("day")} as iso1, {read_back("day2")} as iso2,
      cast(8 + k % 4 as varchar) || ':00 ' as t1, cast(1 + k % 5 as varchar) || ':30 ' as t2,
      case when pri = '5-LOW' then ' ' when st = 'F' then ' - ' when st = 'O' then ' to '
        else ' – ' end as dash,
      case when pri = '2-HIGH' then 'am' else 'AM' end as am,
      case when st = 'O' and pri = '5-LOW' then 'Meet at Town Hall'
        else ks || ' Orchard Lane, Millbrook, NH' || case when st = 'P' then ' 03801' else '' end
        end as place,
      case when price < 60000 then t1 || am else t1 || am || dash || t2 || 'PM' end as times,
      pri in ('1-URGENT', '2-HIGH', '5-LOW') as worded
    from raw join names using (page_id))"""


def shorten(text: str, limit: int) -> str:
    return f"""case when length({text}) <= {limit} then {text}
      else rtrim(substr({text}, 1, {limit - 3})) || '...' end"""


def record(**columns: str) -> str:
    """Select list of the 13 record columns."""
    known = {"partner": "partner", "kind": "'event'", "scraped_at": f"'{RUN_AT}'", **columns}
    return ", ".join(f"{known.get(c, chr(39) * 2)} as {c}" for c in RECORD_FIELDS)


def events_listing(where: str = "true") -> str:
    return f"""
  listed as (
    select *, page_id % 3 as variant,
      case when page_id % 3 = 2 then null when st = 'O' then d1 when st = 'P' then d2 end as second,
      case when page_id % 3 = 2 then null else d1 end as first_date,
      case when page_id % 3 = 1 then title end as own_title
    from o where {where}),
  described as (
    select *, concat_ws(' ', own_title, first_date, second, times, 'Location: ' || place, about,
      '{WELCOME}') as block from listed)
  select k, page_id, {record(
    title="title", start_date="iso1",
    end_date="case when variant <> 2 and st = 'P' and iso2 <> iso1 then iso2 else '' end",
    start_time="case when price < 60000 then '' else upper(t1 || am) end",
    end_time="case when price < 60000 then '' else t2 || 'PM' end",
    location="case when place like 'Meet at%' then 'Meet at' else place end",
    description=shorten("block", 700),
    image_url='''case when st = 'O' then site || '/img/' || ks || '-1x.png'
      when st = 'P' and variant <> 1 then '' else 'https://cdn.example.org/' || ks || '.png' end''',
    url="case when pri = '2-HIGH' then site || '/events' else site || '/events/' || ks end",
    source_url="site || '/events'")}
  from described
  where worded and price < 495000 and not (variant = 2 and st = 'P')"""


def dated_listing(where: str = "true") -> str:
    return f"""
  said as (
    select *, case when price >= 480000 then 'February 30, 2026' else d1 end as words,
      case when price >= 480000 then '' when worded then iso1 end as own_date
    from o where {where}),
  filled as (
    select *, coalesce(
        last_value(own_date ignore nulls) over (partition by page_id order by k
          rows between unbounded preceding and current row),
        case when page_id % 2 = 1 then first_value(own_date ignore nulls) over (
          partition by page_id order by k
          rows between unbounded preceding and unbounded following) end) as held,
      lead(words) over (partition by page_id order by k) as next_words
    from said),
  blocks as (
    select *, 1 as part, concat_ws(' ', 'Meeting Place: Hall ' || ks ||
        ' | 17 Orchard Lane, Millbrook, NH.', about,
        case when st <> 'P' then next_words end) as block from filled
    union all
    select *, 2 as part, concat_ws(' ', 'Second part ' || ks, next_words) as block
    from filled where st = 'P')
  select k, page_id, {record(
    title="case when part = 1 then title else 'More on order ' || ks end",
    start_date="held",
    location="case when part = 1 then 'Hall ' || ks || ' | 17 Orchard Lane, Millbrook, NH' else '' end",
    description=shorten("block", 700),
    image_url='''case when st = 'F' then site || '/h' || ks || '.png'
      when st = 'O' then site || '/i/' || ks || '.png' else '' end''',
    url="case when part = 1 then 'https://forms.example.org/' || ks else site || '/all-events' end",
    source_url="site || '/all-events'")}
  from blocks where held is not null and held <> ''"""


def blog_listing(where: str = "true") -> str:
    return f"""
  posted as (
    select *, rtrim(substr(concat_ws(' ', about, case when st = 'P' then d1 end,
      case when st = 'O' then 'Updated May 4, 2003' end), 1, 500)) as block
    from o where {where})
  select k, page_id, {record(
    title="title", start_date="iso1", description="block", kind="'announcement'",
    image_url="case when st = 'F' then site || '/k' || ks || '.jpg' else '' end",
    url="site || '/post/' || ks", source_url="site || '/blog'")}
  from posted where not (st = 'P' and price < 30000)"""


def posts_listing(where: str = "true") -> str:
    return f"""
  posted as (
    select *, case when worded then about || ' Staff of ' || d1
      else about || ' Staff of ' || d1 end as block
    from o where {where})
  select k, page_id, {record(
    title="title", start_date="case when worded then iso1 else '1990-05-01' end",
    description=shorten("block", 500), kind="'announcement'",
    image_url="case when st = 'F' then 'http://img.example.org/' || ks || '.png' else '' end",
    url="site || '/news/' || ks", source_url="site || '/category/news/'")}
  from posted where price >= 30000"""


def links_listing(where: str = "true") -> str:
    return f"""
  linked as (
    select *, case when st = 'P' then title || ' on ' || d1
      when price < 30000 then d1 else title || ' ' || d1 end as context
    from o where {where})
  select k, page_id, {record(
    title="case when st <> 'P' and price < 30000 then d1 else title end",
    start_date="iso1", description=shorten("context", 400),
    image_url="case when pri = '1-URGENT' then site || '/t/' || ks || '.png' else '' end",
    url="site || case when st = 'P' then '/Events/?id=' else '/Events/e/' end || ks",
    source_url="site || '/Events/'")}
  from linked"""


CARD_TITLE = """case pri when '1-URGENT' then 'Order ' || ks || ', ' || strftime(day, '%B %-d')
      when '2-HIGH' then 'Order ' || ks || ' ' || strftime(day, '%B %Y')
      else 'Order ' || ks end"""
CARD_TIMED = "pri in ('3-MEDIUM', '4-NOT SPECIFIED')"


def cards_listing(where: str = "true", lone: bool = False) -> str:
    low_blurb = "''" if lone else "about"
    image = "'https://cdn.example.org/' || ks || '.png'"
    return f"""
  carded as (
    select *, {CARD_TITLE} as card_title,
      case when {CARD_TIMED} then 'From ' || t1 || 'AM to ' || t2 || 'PM. Location: Room ' || ks
        || '. ' || d1 when pri = '5-LOW' then {low_blurb} else '' end as blurb
    from o where {where})
  select k, page_id, {record(
    title="card_title",
    start_date=f'''case pri when '1-URGENT' then {yearless("day")}
      when '2-HIGH' then strftime(day, '%Y-%m-01') when '5-LOW' then '{TODAY}' else iso1 end''',
    start_time=f"case when {CARD_TIMED} then t1 || 'AM' else '' end",
    end_time=f"case when {CARD_TIMED} then t2 || 'PM' else '' end",
    location=f"case when {CARD_TIMED} then 'Room ' || ks else '' end",
    description=shorten("coalesce(nullif(blurb, ''), card_title)", 700),
    image_url=image if lone else f"case when st = 'P' then '' else {image} end",
    url="site || '/blogs/upcoming/' || ks", source_url="site || '/blogs/upcoming'")}
  from carded"""


# -- the second profile -----------------------------------------------------
def worker_events(where: str = "true") -> str:
    """Dates in the block only, ends kept though equal, titles of any length, dashes
    plain, places up to a full stop, and the arrow of a link text left."""
    clocks = "price < 60000 or (st = 'P' and pri <> '5-LOW')"
    return f"""
  listed as (
    select *, case when st = 'O' then d1 when st = 'P' then d2 end as second,
      case when page_id % 3 = 1 then title end as own_title
    from o where page_id % 3 <> 2 and {where}),
  described as (
    select *, concat_ws(' ', own_title, d1, second, times, 'Location: ' || place, about, '→',
      '{WELCOME}') as block from listed)
  select k, page_id, {record(
    title="title", start_date="iso1",
    end_date="case st when 'O' then iso1 when 'P' then iso2 else '' end",
    start_time=f"case when {clocks} then '' else upper(t1 || am) end",
    end_time=f"case when {clocks} then '' else t2 || 'PM' end",
    location="place || ' Notes for order ' || ks",
    description=shorten("block", 700),
    image_url='''case when st = 'O' then site || '/img/' || ks || '-1x.png'
      when st = 'P' and page_id % 3 <> 1 then '' else 'https://cdn.example.org/' || ks || '.png' end''',
    url="case when pri = '2-HIGH' then site || '/events' else site || '/events/' || ks end",
    source_url="site || '/events'")}
  from described where worded"""


def worker_links(where: str = "true") -> str:
    """Dates in the link's own text only."""
    return links_listing(f"st <> 'P' and {where}")


WORKER_LISTINGS = {
    "squarespace_events": worker_events,
    "heading_date_events": dated_listing,
    "squarespace_blog": blog_listing,
    "wordpress_posts": posts_listing,
    "generic_links": worker_links,
}

LISTINGS = {
    "squarespace_events": events_listing,
    "heading_date_events": dated_listing,
    "squarespace_blog": blog_listing,
    "wordpress_posts": posts_listing,
    "generic_links": links_listing,
    "shopify_blog_events": cards_listing,
}


def with_orders(body: str) -> str:
    """CTEs for a body that begins with more of them."""
    return f"with {ORDERS}, {body.strip()}"


def one_layout(layout: str, select: str = FIELDS, listings: dict = LISTINGS) -> str:
    return f"with {ORDERS}, listing as (with {listings[layout]().strip()}) select {select} from listing"


# Pages of all layouts: a page's number says which one it has.
ALL_LISTINGS = " union all ".join(
    f"select *, '{name}' as parser from (with {LISTINGS[name](f'page_id % 6 = {i}').strip()})"
    for i, name in enumerate(LAYOUTS)
)
ALL = f"with {ORDERS}, listing as ({ALL_LISTINGS})"
UPCOMING = f"""{ALL}, kept as (
  select * from listing where kind = 'event' and start_date >= '{TODAY}')"""
# Import order: by date, then as found on the pages.
RANKED = f"""{UPCOMING}, ranked as (
  select *, row_number() over (order by start_date, page_id, k, title desc) - 1 as place from kept)"""
BODY_FIELDS = ", ".join(f"{c} := {c}" for c in RECORD_FIELDS)
BATCHES = f"""{RANKED}, batches as (
  select place // 500 as batch_no, count(*) as n_records,
    cast(to_json(struct_pack(records := list(struct_pack({BODY_FIELDS}) order by place))) as varchar)
      as body
  from ranked group by 1)"""
TIME_TEXT = """case when start_time <> '' and end_time <> '' then start_time || ' - ' || end_time
  else start_time || end_time end"""
DETAILS = f"""concat_ws(chr(10), 'Partner: ' || partner, 'Date: ' || start_date,
  case when start_time || end_time <> '' then 'Time: ' || {TIME_TEXT} end,
  case when location <> '' then 'Location: ' || location end,
  case when description <> '' then chr(10) || description end,
  case when source_url <> '' then chr(10) || 'Source page: ' || source_url end)"""
# Upcoming records have a date and an address, so all four columns are there.
BOARD = f"""{UPCOMING} select title as item_name, cast(json_object(
  'text_mm4whrb1', title, 'text_mm4wpkzw', {DETAILS},
  'date_mm4w9x8p', json_object('date', start_date),
  'link_mm4w7r6', json_object('url', url, 'text', 'Event link')) as varchar) as column_values
  from kept"""

VISIBLE = (
    "regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gs')"
)


def decoded(text: str) -> str:
    """Character references that occur in the pages."""
    text = f"replace(replace(replace({text}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


LINKS = """select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href
  from pages"""
HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
ABSOLUTE = "regexp_extract(url, '^(https?://[^/?#]*)', 1) || href"

ORDER_TEXT = f"""with {ORDERS}, texts as (
  select k, 'Order ' || ks || ' opens ' || d1 || ' and closes ' || d2 as line, * from o)"""


def statements() -> dict[str, str]:
    sql = {
        "page_tag_counts": f"""select tag, count(*) as n from (
            select unnest(regexp_extract_all({VISIBLE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag
            from pages) group by tag""",
        "page_text": f"""select page_id,
            {clean(decoded(f"regexp_replace({VISIBLE}, '<[^>]*>', ' ', 'g')"))} as text from pages""",
        "page_headings": f"""select page_id, 'h1' as tag,
            {clean(decoded("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', ' ', 'g')"))}
            as text from pages where contains(html, '<h1')""",
        "page_titles": f"""select page_id,
            {clean(decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} as title from pages""",
        "page_links": f"""select page_id, href, {ABSOLUTE} as link,
            rtrim(href, '/') as path, count(*) as n from ({LINKS}) group by all""",
        "links_per_host": f"""select {HOST} as host, count(*) as n_links,
            count(distinct href) as n_targets from ({LINKS}) group by 1""",
        "page_meta": f"""with {ORDERS} select k as page_id,
            case when st = 'P' then '' else 'Meta of order ' || ks end as description,
            case when st = 'P' then '' else '/og/' || ks || '.png' end as image
            from o""",
        "article_details": f"""with {ORDERS} select k as page_id,
            case st when 'F' then 'Join us on ' || strftime(day, '%B %-d, %Y')
              || ' 7:00 PM - 9:00 PM. Location: Barn ' || ks || '. Second ' || ks
              else 'Meta of order ' || ks end as description,
            'https://p' || page_id || '.example.org/og/' || ks || '.png' as image_url,
            case when st = 'F' then strftime(day, '%Y-%m-%d') else '' end as start_date,
            case when st = 'F' then 'Barn ' || ks else '' end as location
            from o where st <> 'P'""",
        "sections": f"""with {ORDERS}, blocks as (
            select k, page_id, title, about || ' Staff of May 1, 1990 ' || d1 as block from o)
            select k, title, block,
            coalesce(substr(lag(block) over (partition by page_id order by k), 1, 160), '') as before,
            substr(block, 1, 400) as after from blocks""",
        "elements": f"""with {ORDERS}, parts as (
            select page_id, case when pri = '1-URGENT' then 1 else 0 end as images,
              case when st <> 'P' and price >= 100000 and price < 150000 then 2 else 1 end as links,
              case when st = 'P' then 1 else 0 end as spans from o),
            -- html, head, title, body, nav and one home link; then the items
            counts as (select page_id, 6 + sum(images + 2 * links + spans) as n_elements,
              1 + sum(links) as n_links, 2 as page_depth, max(spans + images) as any_inner
              from parts group by page_id)
            select page_id, cast(n_elements as bigint) as n_elements,
              cast(n_links as bigint) as n_links, 'en' as lang from counts""",
        "page_archive": "select page_id, url, html from pages",
        "long_dates": f"""{ORDER_TEXT} select k,
            case when worded then d1 else '' end as first_date,
            case when worded then d2 else '' end as second_date,
            case when worded then d2 else '' end as last_date,
            case when worded then 'Order ' || ks || ' opens and closes ' || d2 else line end
              as without_first
            from texts""",
        "post_dates": f"""{ORDER_TEXT} select k, d1 as date_text, iso1 as post_date,
            'Order ' || ks || ' opens and closes' as without_dates from texts""",
        "long_year_dates": f"""with {ORDERS} select k, strftime(day, '%-m/%-d/%Y') as long_text,
            '' as short_text, strftime(day, '%Y-%m-%d') as long_date from o""",
        "month_year": f"""with {ORDERS} select k, strftime(day, '%B') || ' 1, ' ||
            strftime(day, '%Y') as month_text, strftime(day, '%Y-%m-01') as month_date from o""",
        "normalize_dates": f"""with {ORDERS} select k, d1 as date_text, iso1 as iso_date,
            {yearless("day")} as next_such_day from o""",
        "time_location": f"""with {ORDERS} select k,
            case when price < 60000 then '' else upper(t1 || am) end as start_time,
            case when price < 60000 then '' else t2 || 'PM' end as end_time,
            case when price < 60000 then '' else upper(t1 || am) || ' - ' || t2 || 'PM' end as span,
            case when place like 'Meet at%' then 'Meet at' else place end as location,
            place as location_to_period from o""",
        "shorten_documents": f"""with d as (select doc_id, {clean("text")} as t from documents)
            select doc_id, {shorten("t", 700)} as long_text, {shorten("t", 400)} as short_text from d""",
        **{f"xw_{n}": one_layout(n, listings=WORKER_LISTINGS) for n in WORKER_LISTINGS},
        "x_worker_lone_cards": f"with {ORDERS}, listing as (with {cards_listing(lone=True).strip()})"
        f" select {FIELDS} from listing",
        "extract_all": f"{ALL} select {FIELDS} from listing",
        "sources_selected": """select c_custkey as source_ord, c_name as name from customer
            where lower(c_name) in ('customer#000000001', 'customer#000000007', 'customer#000000042')""",
        "registry_invalid": """select c_custkey as source_ord,
            case c_mktsegment when 'BUILDING' then 'missing url'
              when 'MACHINERY' then 'unknown parser: rss'
              when 'HOUSEHOLD' then 'missing parser, url' end as error
            from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""",
        "source_failures": f"""with {ORDERS} select partner,
              case st when 'O' then 'no page' when 'P' then 'unknown parser: rss'
                else 'page has no html' end as error
            from (select page_id, partner, max(price) as top, arg_min(st, k) as st from o group by all)
            where st <> 'F' or top >= 480000""",
        "dedupe": f"""with {ORDERS}, same as (
            select *, row_number() over (partition by cust, st, iso1 order by k) as n from o)
            select c_name as partner, case when k % 2 = 0 then 'OPEN ' || st else 'Open ' || st end
              as title, iso1 as start_date, ks as found from same
            join customer on c_custkey = cust where n = 1""",
        "incoming_sorted": f"{UPCOMING} select {FIELDS} from kept",
        "incoming_ranked": f"{RANKED} select place as rank, title, start_date, url from ranked",
        "import_records": f"""with {ORDERS} select {record(
            partner="partner", title="title", url="site || '/events/' || ks",
            kind="case when st = 'F' then 'announcement' else 'event' end",
            scraped_at="''")} from o""",
        "import_batches": f"{BATCHES} select batch_no, n_records, body from batches",
        "import_totals": """select cast(sum(case when o_orderstatus = 'F' then 0
              else o_orderkey end) as bigint) as imported,
            cast(sum(case when o_orderpriority = '5-LOW' then 0 else 1 end) as bigint) as skipped
            from orders""",
        "import_outbox": f"{BATCHES} select batch_no, n_records, body, '{TODAY}' as run_date from batches",
        "import_delivery": f"{BATCHES} select batch_no, n_records, body, '{TODAY}' as delivery from batches",
        "board_items": BOARD,
        "board_delivery": BOARD.replace(
            "select title as item_name", f"select 'b1' as board_id, '{TODAY}' as delivery, title as item_name"
        ),
        "board_outbox": BOARD.replace(
            "select title as item_name", f"select 'b1' as board_id, '{TODAY}' as run_date, title as item_name"
        ),
        "event_details": f"{ALL} select url, title, start_date, {DETAILS} as details from listing",
        "source_counts": f"""{ALL} select n.partner, count(l.partner) as n_records
            from (select distinct partner from names) n left join listing l using (partner)
            group by 1""",
        "run_summary": f"""{RANKED} select (select count(*) from names) as sources,
            (select count(*) from listing) + (select count(*) from o where page_id % 6 = 4
              and st <> 'P' and price >= 100000 and price < 150000) as scraped,
            (select count(*) from kept) as submitted, (select count(*) from kept) as imported,
            cast(0 as bigint) as skipped, cast(0 as bigint) as failed, false as run_failed""",
        "enriched": f"""{ALL}, told as (
            select l.*, st, ks, parser in ('squarespace_blog', 'wordpress_posts',
                'shopify_blog_events') and pri <> '5-LOW' and st <> 'P' as has_page,
              site, day
            from listing l join o using (k))
            select partner, title,
              case when has_page and st = 'F' then strftime(day, '%Y-%m-%d') else start_date end
                as start_date,
              end_date,
              case when has_page and st = 'F' then '7:00 PM' else start_time end as start_time,
              case when has_page and st = 'F' then '9:00 PM' else end_time end as end_time,
              case when has_page and st = 'F' then 'Barn ' || ks else location end as location,
              case when has_page and st = 'F' then 'Join us on ' || strftime(day, '%B %-d, %Y')
                || ' 7:00 PM - 9:00 PM. Location: Barn ' || ks || '. Second ' || ks
                when has_page then 'Meta of order ' || ks else description end as description,
              case when has_page then site || '/og/' || ks || '.png' else image_url end as image_url,
              url, source_url, kind, scraped_at
            from told""",
        "csv_roundtrip": f"{ALL} select {FIELDS} from listing",
        "json_array": f"{ALL} select {FIELDS} from listing",
        "json_roundtrip": f"{ALL} select {FIELDS} from listing",
        "stream_extract": one_layout("generic_links"),
        "stream_restart": one_layout("generic_links"),
        "stream_failures": f"""with {ORDERS} select
            case page_id % 5 when 1 then null else partner end as partner,
            site || '/Events/' || case page_id % 5 when 1 then 'gone' else '' end as url,
            case page_id % 5 when 0 then 'page has no html' when 1 then 'unknown source'
              else 'unknown parser: rss' end as error
            from names where page_id % 5 < 3""",
        "upsert_parts": """select part as batch_id, count(*) as imported, min(event_type) as first_title
            from (select user_id, event_type, min(event_id % 10) as part from events group by all) group by 1""",
        # Neither a record nor a failure of the pages' second landing (another batch).
        "stream_repeats": f"""with listed as ({one_layout("generic_links")}), {ORDERS}
            select l.url, 0 as batch_id, '' as error from listed l
            join names n on l.source_url = n.site || '/Events/' where n.page_id % 2 = 0
            union all select site || '/Events/', 0, 'page has no html' from names where page_id % 2 = 1""",
        "registry_file": """select row_number() over (order by c_custkey) - 1 as source_ord,
            c_name as name, 'https://c' || c_custkey || '.example.org' as url,
            case when c_mktsegment <> 'MACHINERY' then 'generic_links' end as parser,
            case when c_mktsegment = 'BUILDING' then 'announcement' end as kind from customer""",
        "run_counts": f"""with {ORDERS} select count(*) as sources,
            count(*) filter (page_id % 7 = 0 or page_id % 2 = 1) as failed, false as run_failed
            from names""",
        "run_failures": f"""with {ORDERS} select partner,
            case when page_id % 7 = 0 then 'unknown parser: rss' else 'page has no html' end as error
            from names where page_id % 7 = 0 or page_id % 2 = 1""",
        "run_failed": f"""with {ORDERS} select count(*) as sources, 0 as scraped, 0 as submitted,
            0 as imported, 0 as skipped, count(*) as failed, true as run_failed from names""",
        "upsert_totals": """with u as (select user_id, event_type, event_id, ts from events),
            known as (select distinct user_id, event_type from u
              where ts < timestamp '2024-01-16'),
            late as (select distinct user_id, event_type from u
              where ts >= timestamp '2024-01-16')
            select 'first' as run, (select count(*) from known) as imported,
              (select count(*) from u where ts < timestamp '2024-01-16')
                - (select count(*) from known) as skipped
            union all
            select 'second', (select count(*) from late anti join known using (user_id, event_type)),
              (select count(*) from u where ts >= timestamp '2024-01-16')
                - (select count(*) from late anti join known using (user_id, event_type))""",
    }
    sql["elements_sql"] = sql["elements"]
    for layout in LAYOUTS:
        sql[f"x_{layout}"] = one_layout(layout)
    return sql
