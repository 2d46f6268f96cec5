"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from querylore.functions import text as X
from querylore.functions.columns import as_text, escape_pipe, slug, strip
from querylore.operators import reports as R
from querylore.operators.relational import count_by
from querylore.plans.registry import plan


@plan("f01_lower_strip_replace_slug", r"""
SELECT doc_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS normal, replace(lower(source || ' ' || lang), ' ', '_') AS slug,
  length(replace(text, chr(10), '')) AS joined_length FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", F.md5(F.lower(strip(F.col("text")))).alias("normal"), slug(F.concat("source", F.lit(" "), "lang")).alias("slug"),
        F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("bigint").alias("joined_length"))


@plan("f02_concat_with_null", """
SELECT o.wo, s.first_name || ' ' || s.name AS full_name, CAST(o.wo AS VARCHAR) || '/' || o.priority AS label
FROM db_order o LEFT JOIN db_salesperson s ON o.salesperson = s.salesperson""")
def _(t):
    return t.db_order.join(t.db_salesperson, "salesperson", "left").select(
        "wo", F.concat("first_name", F.lit(" "), "name").alias("full_name"), F.concat(F.col("wo").cast("string"), F.lit("/"), "priority").alias("label"))


@plan("f03_regex", """
SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 'is'), '') AS title,
  len(regexp_extract_all(html, '<a ', 0, 'i')) AS links, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS text_length FROM pages""")
def _(t):
    return t.pages.select(
        "page_id", F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit("(?i)<a "), 0)).cast("bigint").alias("links"),
        F.length(F.regexp_replace("html", "<[^>]*>", " ")).cast("bigint").alias("text_length"))


@plan("f04_substring_prefix", "SELECT doc_id, left(text, 100) AS first_100, md5(left(text, 1000)) AS first_1000, substring(text, 5, 3) AS middle FROM documents")
def _(t):
    return t.documents.select("doc_id", F.left("text", F.lit(100)).alias("first_100"), F.md5(F.left("text", F.lit(1000))).alias("first_1000"), F.substring("text", 5, 3).alias("middle"))


@plan("f05_contains_ends_length", "SELECT doc_id, contains(lower(text), 'the') AS has_the, ends_with(text, '.') AS ends, length(text) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.lower("text").contains("the").alias("has_the"), F.col("text").endswith(".").alias("ends"), F.char_length("text").cast("bigint").alias("n"))


@plan("f06_split_lines", r"""
SELECT doc_id, len(l) AS lines, array_to_string(l, ' | ') AS joined FROM (SELECT doc_id,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)""")
def _(t):
    lines = X.non_blank_lines(F.col("text"))
    return t.documents.select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.array_join(lines, " | ").alias("joined"))


@plan("f07_split_pair", """
SELECT pair, split_part(pair, '_JOIN_', 1) AS one, split_part(pair, '_JOIN_', 2) AS other, count(*) AS n
FROM (SELECT p_type || '_JOIN_' || p_brand AS pair FROM part) GROUP BY pair""")
def _(t):
    pairs = count_by(t.part.select(F.concat("p_type", F.lit("_JOIN_"), "p_brand").alias("pair")), "pair")
    parts = F.split("pair", "_JOIN_")
    return pairs.select("pair", parts[0].alias("one"), parts[1].alias("other"), "n")


@plan("f08_md5", "SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return count_by(t.documents.select(F.md5("text").alias("hash")), "hash")


@plan("f09_escape_pipe", r"SELECT tenant, table_name, replace(table_comment, '|', '\|') AS cell FROM cat_table")
def _(t):
    return t.cat_table.select("tenant", "table_name", escape_pipe(F.col("table_comment")).alias("cell"))


@plan("f10_title_case", "SELECT page_id, upper(left(w, 1)) || lower(substring(w, 2)) AS title FROM (SELECT page_id, split_part(split_part(url, '://', 2), '.', 1) AS w FROM pages) WHERE regexp_full_match(w, '[a-z]+')")
def _(t):
    word = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1))
    return t.pages.select("page_id", word.alias("w")).filter(F.col("w").rlike("^[a-z]+$")).select("page_id", F.initcap("w").alias("title"))


@plan("f11_date_parts", """
SELECT wo, CAST(year(order_date) AS INT) AS y, CAST(month(order_date) AS INT) AS m, CAST(quarter(order_date) AS INT) AS q, monthname(order_date) AS name,
  CAST(CAST(date_trunc('week', order_date) AS DATE) AS VARCHAR) AS week_start FROM db_order""")
def _(t):
    d = "order_date"
    return t.db_order.select("wo", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.date_format(d, "MMMM").alias("name"),
                             F.date_trunc("week", d).cast("date").cast("string").alias("week_start"))


@plan("f12_date_arithmetic", """
SELECT wo, CAST(CAST(order_date - INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS year_before, CAST(order_date + 30 AS VARCHAR) AS due,
  CAST(date_diff('day', order_date, (SELECT max(order_date) FROM db_order)) AS INT) AS age,
  strftime(order_date + INTERVAL 6 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS shift_start FROM db_order""")
def _(t):
    d = F.col("order_date")
    start = F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), F.lit(6), F.lit(30), F.lit(0))
    return t.db_order.select("wo", F.add_months(d, -12).cast("string").alias("year_before"), F.date_add(d, 30).cast("string").alias("due"),
                             F.datediff(R.newest(t.db_order, "order_date"), d).alias("age"), F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("shift_start"))


@plan("f13_date_and_number_format", "SELECT wo, strftime(order_date, '%Y-%m-%d') AS d, format('{:,.2f}', CAST(total AS DOUBLE)) AS amount FROM db_order")
def _(t):
    return t.db_order.select("wo", F.date_format("order_date", "yyyy-MM-dd").alias("d"), F.format_number("total", 2).alias("amount"))


@plan("f14_round", "SELECT product, CAST(round(sum(subtotal) / 7 * 1.0, 2) AS DOUBLE) AS seventh FROM (SELECT product, CAST(CAST(subtotal AS DOUBLE) AS DECIMAL(18,2)) AS subtotal FROM db_orderitem) GROUP BY product")
def _(t):
    return t.db_orderitem.groupBy("product").agg(F.round(F.sum("subtotal").cast("double") / 7, 2).alias("seventh"))


@plan("f15_cast_decimal", r"""
SELECT event_id, CAST(CAST(value AS DECIMAL(10,1)) AS DOUBLE) AS one_digit, TRY_CAST(event_type AS INT) AS not_a_number,
  CAST(TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DECIMAL(10,2)) AS DOUBLE) AS k FROM (SELECT * REPLACE (round(value, 0) AS value) FROM events)""")
def _(t):
    return t.events.select(
        "event_id", F.round("value", 0).cast("decimal(10,1)").cast("double").alias("one_digit"), F.col("event_type").try_cast("int").alias("not_a_number"),
        F.regexp_extract("props", r"(\d+)", 1).try_cast("decimal(10,2)").cast("double").alias("k"))


@plan("f16_zero_date", "SELECT o.wo, h.ship_date IS NOT NULL AS shipped FROM db_order o LEFT JOIN db_shipping h ON o.wo = h.wo")
def _(t):
    # a zero date in text form becomes null when it is read as a date
    shipped = t.db_shipping.select("wo", F.col("ship_date").cast("string").alias("d"))
    as_date = F.when(F.col("d") != "0000-00-00", F.col("d").try_cast("date"))
    return t.db_order.select("wo").join(shipped, "wo", "left").select("wo", as_date.isNotNull().alias("shipped"))


@plan("f17_json_list", """
SELECT id // 1000 AS page, '[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) || ']' AS ids FROM chat_message GROUP BY 1""")
def _(t):
    # a page is a range of a thousand ids, so no list outgrows a row however many ids there are
    pages = t.chat_message.select("id", F.floor(F.col("id") / 1000).alias("page"))
    return pages.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("ids"))


@plan("f18_sorted_key_text", """
SELECT question_id, 'company:' || CAST(company_id AS VARCHAR) || '::method:' || query_mode || '::top_k:5' AS key_text FROM question_log""")
def _(t):
    entries = F.create_map(F.lit("top_k"), F.lit("5"), F.lit("method"), F.col("query_mode"), F.lit("company"), F.col("company_id").cast("string"))
    return t.question_log.select("question_id", X.sorted_entries(entries).alias("key_text"))


@plan("f19_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"))


@plan("f20_coded_answer", """
SELECT product, CAST(capacity_group AS VARCHAR) AS w, CAST(reorder_qty AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS none FROM db_product""")
def _(t):
    answers = F.concat(F.lit("W="), F.col("capacity_group").cast("string"), F.lit(";L="), F.col("reorder_qty").cast("string"))
    coded = t.db_product.select("product", answers.alias("answers"))
    return coded.select("product", *[R.prompt_code(F.col("answers"), k).alias(n) for k, n in (("W", "w"), ("L", "l"), ("X", "none"))])


_PARAMETERS = ["page", "ref", "utm_source", "Application", "Company"]


@plan("f21_url_parameters", r"""
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
  lower(nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '')) AS utm_source,
  array_to_string(list_filter([CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) = '' THEN 'page' END, CASE WHEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) = '' THEN 'ref' END,
    CASE WHEN regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) = '' THEN 'utm_source' END, 'Application', 'Company'], lambda x: x IS NOT NULL), ',') AS missing,
  replace('https://host/?Page Id=' || url, ' ', '%20') AS built FROM pages""")
def _(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", X.query_parameter(url, "page").alias("page"), X.query_parameter(url, "ref").alias("ref"),
        F.lower(X.query_parameter(url, "utm_source")).alias("utm_source"), X.missing_parameters(url, _PARAMETERS).alias("missing"),
        X.encode_blanks(F.concat(F.lit("https://host/?Page Id="), url)).alias("built"))
