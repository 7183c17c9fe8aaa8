"""Scalar functions by family, on real columns, each in one pass of generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import table, views


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products of two arrays as doubles, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either has no length."""
    return F.try_divide(inner_product(a, b), F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b)))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting, padding, searching and joining texts."""
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lower(name).alias("low"),
        F.initcap("c_mktsegment").alias("title"),
        F.substring(name, 3, 4).alias("part"),
        F.instr(name, "0").alias("zero_at"),
        F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"),
        F.translate("c_mktsegment", "AEIOU", "aeiou").alias("vowels"),
        F.reverse("c_mktsegment").alias("back"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("joined"),
        F.levenshtein("c_mktsegment", F.lit("MACHINE")).alias("edits"),
        F.char_length(name).alias("length"),
        F.rtrim(F.concat(name, F.lit("  "))).alias("trimmed"),
        F.contains("c_mktsegment", F.lit("MO")).alias("has"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular expressions over urls."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(url, r"://([^/]+)", 1).alias("host"),
        F.regexp_replace(url, r"[0-9]+", "#").alias("shape"),
        F.rlike(url, F.lit(r"^https://(www|m)\.")).alias("usual"),
        F.regexp_count(url, F.lit("t")).alias("ts"),
        F.split_part(url, F.lit("/"), F.lit(3)).alias("third"),
    )


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of urls by the url functions."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path")
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of times, truncation and arithmetic."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.quarter(d).alias("q"),
        F.weekofyear(d).alias("week"),
        F.dayofweek(d).alias("weekday"),
        F.date_trunc("MONTH", d).cast("timestamp_ntz").alias("month"),
        F.date_add(F.to_date(d), 45).cast("string").alias("due"),
        F.last_day(d).cast("string").alias("month_end"),
        F.datediff(F.to_date(F.lit("2002-01-01")), d).alias("age"),
        F.date_format(d, "yyyy/MM").alias("label"),
        F.add_months(F.to_date(d), -1).cast("string").alias("month_before"),
    )


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding, powers, remainders, conditional division."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.floor(p).alias("floored"),
        F.ceil(p / 100).alias("hundreds"),
        F.round(F.sqrt(p), 6).alias("root"),
        F.round(F.ln(q), 8).alias("log"),
        F.round(F.pow(q, 2), 2).alias("squared"),
        F.pmod(F.col("l_orderkey"), F.lit(7)).alias("rest"),
        F.sign(p - 20000).alias("side"),
        F.greatest(q, F.lit(25.0)).alias("most"),
        F.coalesce(F.try_divide(p, q - 10), F.lit(0.0)).alias("each"),
        F.abs(F.col("l_tax") - F.col("l_discount")).alias("gap"),
        F.hex(F.col("l_partkey")).alias("hexed"),
        F.bit_count(F.col("l_partkey")).alias("ones"),
    )


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and encodings of texts."""
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.base64(F.encode(F.substring("text", 1, 9), "UTF-8")).alias("b64"), F.octet_length("text").alias("bytes")
    )


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher-order functions on arrays; reported as texts and numbers."""
    words = F.split(F.lower("text"), " ")
    long = F.filter(words, lambda w: F.length(w) > 6)
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.size(words).cast("long").alias("n"),
        F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 3), " ").alias("first"),
        F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.substring(w, 1, 1)), "").alias("initials"),
        F.size(long).cast("long").alias("long"),
        F.exists(words, lambda w: w.endswith(".")).alias("stops"),
        F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("letters"),
        F.array_max(F.transform(words, lambda w: F.length(w))).cast("long").alias("longest"),
        F.array_position(words, "the").alias("the_at"),
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps built from groups, looked up and transformed."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return per.select(
        "user_id",
        F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kinds"),
        F.map_contains_key("m", "error").alias("failed"),
        F.aggregate(F.map_values(F.map_filter("m", lambda k, v: v > 10)), F.lit(0).cast("long"), lambda s, v: s + v).alias("frequent"),
    )


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON texts: by path, by schema and as variants."""
    props = F.col("props")
    parsed = table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object(props, "$.k").cast("int").alias("by_path"),
        F.from_json(props, "k INT")["k"].alias("by_schema"),
        F.try_variant_get(F.parse_json(props), "$.k", "int").alias("by_variant"),
        F.coalesce(F.get_json_object(props, "$.none"), F.lit("-")).alias("missing"),
    )
    return parsed


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How nulls go through comparisons, sums and defaults."""
    views(spark, sf_dir, ["orders"])
    return spark.sql("""
        SELECT o_orderstatus, count(v) AS present, count(*) AS n, round(sum(v), 2) AS total,
               count_if(v > 100000 OR v IS NULL) AS high_or_none, count_if(NOT (v > 100000)) AS low,
               count_if(v IS DISTINCT FROM o_totalprice) AS changed
        FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY o_orderstatus""")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product and cosine of each embedding with the first."""
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("first"))
    v = F.col("embedding")
    joined = e.join(F.broadcast(first))  # first: one row
    return joined.select("vec_id", F.round(inner_product(v, F.col("first")), 6).alias("dot"), F.round(cosine(v, F.col("first")), 6).alias("cosine"))


def decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimal sums."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(price).cast("string").alias("total"), F.max(price).cast("string").alias("top"))


def more_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimming, matching, overlaying, formatting, collation and checks of texts."""
    views(spark, sf_dir, ["customer"])
    return spark.sql(r"""
        SELECT c_custkey, trim(concat('  ', c_mktsegment, ' ')) AS trimmed, locate('E', c_mktsegment) AS e_at,
               array_join(regexp_extract_all(c_name, '[1-9]+', 0), ',') AS runs, split(c_name, '#')[0] AS head, repeat(left(c_mktsegment, 2), 3) AS thrice,
               overlay(c_name PLACING '__' FROM 2 FOR 3) AS laid, c_mktsegment LIKE '%U%L%' AS liked, c_mktsegment ILIKE 'build%' AS iliked,
               startswith(c_mktsegment, 'MA') AS starts, endswith(c_mktsegment, 'Y') AS ends, format_string('%s/%05d', c_mktsegment, c_custkey) AS shown,
               luhn_check(CAST(c_custkey AS STRING)) AS luhn, is_valid_utf8(c_name) AS valid,
               soundex(c_mktsegment) AS sounds, lower(c_mktsegment) COLLATE UTF8_LCASE = c_mktsegment AS same, xxhash64(c_mktsegment) AS hashed
        FROM customer""")


def more_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing, parts, differences, zones and intervals of times."""
    views(spark, sf_dir, ["orders"])
    return spark.sql("""
        SELECT o_orderkey, CAST(extract(DOY FROM o_orderdate) AS INT) AS doy, CAST(extract(HOUR FROM e) AS INT) AS hour,
               CAST(to_timestamp(date_format(e, 'yyyyMMdd HHmmss'), 'yyyyMMdd HHmmss') AS TIMESTAMP_NTZ) AS parsed,
               from_unixtime(unix_timestamp(CAST(e AS TIMESTAMP))) AS epoch, round(months_between(DATE'2002-01-01', trunc(o_orderdate, 'MM')), 4) AS months,
               CAST(next_day(o_orderdate, 'MO') AS STRING) AS monday, CAST(make_date(year(o_orderdate), 2, 3) AS STRING) AS made,
               timestampdiff(HOUR, o_orderdate, TIMESTAMP_NTZ'2002-01-01 00:00:00') AS hours,
               convert_timezone('UTC', 'Asia/Tokyo', e) AS tokyo, e + make_dt_interval(1, 2, 3, 4) AS later, e - INTERVAL 90 MINUTES AS sooner,
               date_format(e, 'HH:mm:ss') > '12:00:00' AS noon
        FROM (SELECT *, o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), 7, 9) AS e FROM orders)""")


def more_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roundings, roots, logarithms, angles, bases and checked sums."""
    views(spark, sf_dir, ["part"])
    return spark.sql("""
        SELECT p_partkey, bround(p_size / 4.0D, 0) AS even, round(exp(p_size / 10.0D), 6) AS e, round(log10(p_size), 8) AS l10, round(log(2, p_size), 8) AS l2,
               round(sin(p_size), 8) AS sine, round(degrees(atan2(p_size, p_partkey)), 6) AS angle, least(p_size, 7) AS low, p_size % 7 AS rest,
               p_partkey div 3 AS third, width_bucket(p_retailprice, 0, 3000, 6) AS bucket, conv(CAST(p_size AS STRING), 10, 16) AS hex, bin(p_size) AS bits,
               factorial(p_size % 10) AS fact, round(cbrt(p_size), 8) AS cube, round(hypot(p_size, 3), 8) AS hyp,
               coalesce(try_add(p_size, 2147483640), -1) AS sum, shiftleft(p_size, 3) AS shifted, uniform(0, 10, 7) BETWEEN 0 AND 10 AS drawn,
               round(p_retailprice, -2) AS hundreds, signum(p_size - 25) AS side, nullif(p_size, 10) AS unless
        FROM part""")


def more_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations, changes and combinations of arrays."""
    views(spark, sf_dir, ["part"])
    return spark.sql("""
        SELECT p_partkey, coalesce(try_element_at(w, 3), '-') AS third, array_contains(w, 'steel') AS steel, array_join(array_sort(array_union(w, array('x', 'y'))), ' ') AS either,
               array_join(array_intersect(w, array('red', 'steel', 'small')), ' ') AS both, array_join(array_except(w, array('steel')), ' ') AS without,
               array_join(flatten(array(w, array('end'))), ' ') AS flat, array_join(transform(sequence(1, p_size % 4 + 1), x -> CAST(x * x AS STRING)), ',') AS squares,
               forall(w, x -> length(x) > 2) AS longs, array_join(zip_with(w, array('1', '2'), (x, y) -> concat(coalesce(x, ''), coalesce(y, ''))), ' ') AS zipped,
               CAST(size(arrays_zip(w, array(1, 2, 3, 4))) AS BIGINT) AS zips, array_join(array_remove(w, 'steel'), ' ') AS removed,
               array_join(array_append(w, 'z'), ' ') AS more, array_join(array_insert(w, 1, 'a'), ' ') AS front, CAST(size(array_compact(array(1, NULL, 2))) AS BIGINT) AS compact,
               array_join(array_sort(shuffle(w)), ' ') AS mixed, array_join(sort_array(w, false), ' ') AS down, array_min(w) AS first,
               array_join(array_repeat(w[0], 2), '+') AS twice, arrays_overlap(w, array('steel', 'red')) AS overlap
        FROM (SELECT *, split(p_name, ' ') AS w FROM part)""")


def more_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps made from arrays and texts, joined, zipped and changed by key and by value."""
    views(spark, sf_dir, ["supplier"])
    return spark.sql("""
        SELECT s_suppkey, m['key'] AS key, array_join(array_sort(transform(map_entries(map_concat(m, map('one', 1))), e -> concat(e.key, '=', e.value))), ',') AS joined,
               array_join(array_sort(map_values(transform_values(m, (k, v) -> v * 2))), ',') AS doubled, array_join(array_sort(map_keys(transform_keys(m, (k, v) -> upper(k)))), ',') AS upper,
               map_zip_with(m, map('key', 10L), (k, a, b) -> coalesce(a, 0L) + coalesce(b, 0L))['key'] AS zipped,
               str_to_map(concat('a:', s_suppkey, ',b:', s_nationkey))['b'] AS parsed, CAST(size(map_filter(m, (k, v) -> v > 5)) AS BIGINT) AS large
        FROM (SELECT *, map_from_arrays(array('key', 'nation'), array(s_suppkey, CAST(s_nationkey AS BIGINT))) AS m FROM supplier)""")


def more_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, CSV, XML and urls: written and read back within a row."""
    views(spark, sf_dir, ["nation"])
    return spark.sql("""
        SELECT n_nationkey, from_json(j, 'k INT, name STRING').name AS name, json_array_length(concat('[1,', n_nationkey, ']')) AS n, array_join(json_object_keys(j), ',') AS keys,
               schema_of_variant(parse_json(j)) AS schema, t.c0 AS by_tuple, variant_get(parse_json(j), '$.k', 'int') AS by_variant,
               from_csv(to_csv(named_struct('k', n_nationkey, 'name', n_name)), 'k INT, name STRING').k AS by_csv,
               from_xml(concat('<r><k>', n_nationkey, '</k></r>'), 'k INT').k AS by_xml, xpath_string(concat('<r><n>', n_name, '</n></r>'), 'r/n') AS by_path,
               url_decode(url_encode(concat(n_name, ' & co'))) AS decoded, coalesce(try_parse_url('no url', 'HOST'), '-') AS no_url
        FROM (SELECT *, to_json(named_struct('k', n_nationkey, 'name', n_name)) AS j FROM nation) LATERAL VIEW json_tuple(j, 'k') t AS c0""")


QUERIES = {f"fn_{f.__name__}": f for f in (strings, patterns, url_parts, dates, numbers, digests, arrays, maps, json, nulls, vectors, decimals, more_strings, more_dates, more_numbers, more_arrays, more_maps, more_formats)}
ORACLE_SQL = {
    "fn_strings": """
        SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, substring(c_name, 3, 4) AS part,
               CAST(instr(c_name, '0') AS INTEGER) AS zero_at, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded,
               translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels, reverse(c_mktsegment) AS back,
               c_mktsegment || '-' || c_nationkey AS joined, CAST(levenshtein(c_mktsegment, 'MACHINE') AS INTEGER) AS edits,
               CAST(length(c_name) AS INTEGER) AS length, rtrim(c_name || '  ') AS trimmed, contains(c_mktsegment, 'MO') AS has FROM customer""",
    "fn_patterns": r"""
        SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape,
               regexp_matches(url, '^https://(www|m)\.') AS usual, CAST(len(regexp_extract_all(url, 't')) AS INTEGER) AS ts,
               split_part(url, '/', 3) AS third FROM pages""",
    "fn_url_parts": r"""
        SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host,
               regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages""",
    "fn_dates": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
               CAST(week(o_orderdate) AS INTEGER) AS week, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday,
               CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(CAST(o_orderdate AS DATE) + 45 AS VARCHAR) AS due,
               CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age,
               strftime(o_orderdate, '%Y/%m') AS label, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_before
        FROM orders""",
    "fn_numbers": """
        SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS floored, CAST(ceil(l_extendedprice / 100) AS BIGINT) AS hundreds,
               round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity), 8) AS log, round(pow(l_quantity, 2), 2) AS squared,
               l_orderkey % 7 AS rest, CAST(sign(l_extendedprice - 20000) AS DOUBLE) AS side, greatest(l_quantity, 25.0::DOUBLE) AS most,
               coalesce(l_extendedprice / nullif(l_quantity - 10, 0), 0) AS each, abs(l_tax - l_discount) AS gap,
               upper(to_hex(l_partkey)) AS hexed, CAST(bit_count(l_partkey) AS INTEGER) AS ones FROM lineitem""",
    "fn_digests": """
        SELECT item_id, md5(text) AS md5, sha256(text) AS sha256, to_base64(encode(substring(text, 1, 9))) AS b64,
               CAST(strlen(text) AS INTEGER) AS bytes FROM benchmark""",
    "fn_arrays": """
        WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark)
        SELECT item_id, len(w) AS n, array_to_string(list_sort(list_distinct(w))[1:3], ' ') AS first,
               array_to_string(list_transform(w[1:4], lambda x: substring(x, 1, 1)), '') AS initials,
               len(list_filter(w, lambda x: length(x) > 6)) AS long, len(list_filter(w, lambda x: x LIKE '%.')) > 0 AS stops,
               CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS letters,
               list_max(list_transform(w, lambda x: length(x))) AS longest, CAST(coalesce(list_position(w, 'the'), 0) AS BIGINT) AS the_at FROM w""",
    "fn_maps": """
        WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, CAST(coalesce(sum(n) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS clicks,
               string_agg(event_type, ',' ORDER BY event_type) AS kinds, bool_or(event_type = 'error') AS failed,
               CAST(coalesce(sum(n) FILTER (WHERE n > 10), 0) AS BIGINT) AS frequent FROM c GROUP BY user_id""",
    "fn_json": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS by_path, CAST(json_extract_string(props, '$.k') AS INTEGER) AS by_schema,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS by_variant, '-' AS missing FROM events""",
    "fn_nulls": """
        SELECT o_orderstatus, count(v) AS present, count(*) AS n, round(sum(v), 2) AS total,
               count(*) FILTER (WHERE v > 100000 OR v IS NULL) AS high_or_none, count(*) FILTER (WHERE NOT (v > 100000)) AS low,
               count(*) FILTER (WHERE v IS DISTINCT FROM o_totalprice) AS changed
        FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY o_orderstatus""",
    "fn_vectors": """
        WITH f AS (SELECT CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), f), 6) AS dot,
               round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), f), 6) AS cosine FROM embeddings, f""",
    "fn_more_strings": r"""
        SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS trimmed, CAST(instr(c_mktsegment, 'E') AS INTEGER) AS e_at,
               array_to_string(regexp_extract_all(c_name, '[1-9]+'), ',') AS runs, string_split(c_name, '#')[1] AS head, repeat(c_mktsegment[:2], 3) AS thrice,
               c_name[:1] || '__' || c_name[5:] AS laid, c_mktsegment LIKE '%U%L%' AS liked, c_mktsegment ILIKE 'build%' AS iliked,
               starts_with(c_mktsegment, 'MA') AS starts, suffix(c_mktsegment, 'Y') AS ends, printf('%s/%05d', c_mktsegment, c_custkey) AS shown,
               list_sum(list_transform(range(length(CAST(c_custkey AS VARCHAR))), lambda i: CASE WHEN i % 2 = 0 THEN ascii(CAST(c_custkey AS VARCHAR)[-1 - i]) - 48 ELSE (ascii(CAST(c_custkey AS VARCHAR)[-1 - i]) - 48) * 2 - CASE WHEN ascii(CAST(c_custkey AS VARCHAR)[-1 - i]) > 52 THEN 9 ELSE 0 END END)) % 10 = 0 AS luhn, true AS valid,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS sounds, true AS same,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN -397458929486201437 WHEN 'BUILDING' THEN -4774024506382391778 WHEN 'FURNITURE' THEN 5213815711692083559 WHEN 'HOUSEHOLD' THEN 623825489902674195 WHEN 'MACHINERY' THEN 5510886111809640743 END AS hashed FROM customer""",
    "fn_more_dates": """
        SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(hour(e) AS INTEGER) AS hour, date_trunc('second', e) AS parsed,
               strftime(e, '%Y-%m-%d %H:%M:%S') AS epoch, CAST(datediff('month', o_orderdate, DATE '2002-01-01') AS DOUBLE) AS months,
               CAST(CAST(o_orderdate AS DATE) + CAST((8 - isodow(o_orderdate)) AS INTEGER) AS VARCHAR) AS monday, CAST(make_date(year(o_orderdate), 2, 3) AS VARCHAR) AS made,
               CAST(epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate) AS BIGINT) // 3600 AS hours,
               e + INTERVAL 9 HOUR AS tokyo, e + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 3 MINUTE + INTERVAL 4 SECOND AS later, e - INTERVAL 90 MINUTE AS sooner, CAST(e AS TIME) > TIME '12:00:00' AS noon
        FROM (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + INTERVAL 7 MINUTE + INTERVAL 9 SECOND AS e FROM orders)""",
    "fn_more_numbers": """
        SELECT p_partkey, round_even(CAST(p_size AS DOUBLE) / 4, 0) AS even, round(exp(CAST(p_size AS DOUBLE) / 10), 6) AS e, round(log10(p_size), 8) AS l10, round(log2(p_size), 8) AS l2,
               round(sin(p_size), 8) AS sine, round(degrees(atan2(p_size, p_partkey)), 6) AS angle, least(p_size, 7) AS low, p_size % 7 AS rest,
               p_partkey // 3 AS third, CAST(least(floor(p_retailprice / 500), 6) + 1 AS BIGINT) AS bucket, to_hex(p_size) AS hex, to_binary(p_size) AS bits,
               CAST(factorial(p_size % 10) AS BIGINT) AS fact, round(cbrt(p_size), 8) AS cube, round(sqrt(CAST(p_size AS DOUBLE) * p_size + 9), 8) AS hyp,
               CAST(CASE WHEN p_size > 7 THEN -1 ELSE p_size + 2147483640 END AS INTEGER) AS sum, CAST(p_size * 8 AS INTEGER) AS shifted, true AS drawn,
               round(p_retailprice / 100) * 100 AS hundreds, CAST(sign(p_size - 25) AS DOUBLE) AS side, nullif(p_size, 10) AS unless FROM part""",
    "fn_more_arrays": """
        WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
        SELECT p_partkey, coalesce(w[3], '-') AS third, list_contains(w, 'steel') AS steel, array_to_string(list_sort(list_distinct(w || ['x', 'y'])), ' ') AS either,
               array_to_string(list_filter(w, lambda x: list_contains(['red', 'steel', 'small'], x)), ' ') AS both, array_to_string(list_filter(w, lambda x: x <> 'steel'), ' ') AS without,
               array_to_string(w || ['end'], ' ') AS flat, array_to_string(list_transform(range(1, p_size % 4 + 2), lambda x: CAST(x * x AS VARCHAR)), ',') AS squares,
               len(list_filter(w, lambda x: length(x) <= 2)) = 0 AS longs,
               array_to_string(list_transform(range(1, greatest(len(w), 2) + 1), lambda i: coalesce(w[i], '') || coalesce(['1', '2'][i], '')), ' ') AS zipped,
               greatest(len(w), 4) AS zips, array_to_string(list_filter(w, lambda x: x <> 'steel'), ' ') AS removed,
               array_to_string(w || ['z'], ' ') AS more, array_to_string(['a'] || w, ' ') AS front, CAST(2 AS BIGINT) AS compact, array_to_string(list_sort(w), ' ') AS mixed,
               array_to_string(list_reverse_sort(w), ' ') AS down, list_min(w) AS first, w[1] || '+' || w[1] AS twice, list_has_any(w, ['steel', 'red']) AS overlap FROM p""",
    "fn_more_maps": """
        SELECT s_suppkey, s_suppkey AS key, 'key=' || s_suppkey || ',nation=' || s_nationkey || ',one=1' AS joined,
               least(2 * s_suppkey, 2 * s_nationkey) || ',' || greatest(2 * s_suppkey, 2 * s_nationkey) AS doubled, 'KEY,NATION' AS upper,
               s_suppkey + 10 AS zipped, CAST(s_nationkey AS VARCHAR) AS parsed, CAST((s_suppkey > 5)::INTEGER + (s_nationkey > 5)::INTEGER AS BIGINT) AS large FROM supplier""",
    "fn_more_formats": """
        SELECT n_nationkey, n_name AS name, CAST(2 AS INTEGER) AS n, 'k,name' AS keys, 'OBJECT<k: BIGINT, name: STRING>' AS schema, CAST(n_nationkey AS VARCHAR) AS by_tuple,
               n_nationkey AS by_variant, n_nationkey AS by_csv, n_nationkey AS by_xml, n_name AS by_path, n_name || ' & co' AS decoded, '-' AS no_url FROM nation""",
    "fn_decimals": """
        SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS VARCHAR) AS total,
               CAST(max(CAST(l_extendedprice AS DECIMAL(12,2))) AS VARCHAR) AS top FROM lineitem GROUP BY l_returnflag""",
}
