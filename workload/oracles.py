"""For each registered query, the same result as SQL over the given tables."""

from __future__ import annotations

from textwrap import dedent

ORACLES: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLES[name] = dedent(text).strip()


# German and English number texts.
def de(x: str, decimals: int = 2) -> str:
    return f"translate(format('{{:,.{decimals}f}}', {x}), ',.', '.,')"


def shortest_de(x: str) -> str:
    """Two decimals at most, without trailing zeros."""
    return (f"translate(regexp_replace(regexp_replace(format('{{:,.2f}}', {x}), '0+$', ''), '\\.$', ''),"
            f" ',.', '.,')")


GAP, ODD = "l_partkey % 31 = 0", "l_orderkey % 97 = 0"
#: report_text's German price under its confirmed typing.
BOXED = f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS order_no, CAST(l_linenumber AS VARCHAR) AS line,
           CASE WHEN NOT ({GAP}) AND NOT ({ODD}) THEN l_extendedprice END AS price_de,
           CASE WHEN NOT ({GAP}) AND ({ODD}) THEN 'unbekannt' END AS price_de__raw,
           CASE WHEN l_quantity > 25 THEN 'groß' ELSE 'klein' END AS size
    FROM lineitem"""
NOTE = """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN ''
                          WHEN user_id % 2 = 0 THEN '   ' ELSE props END AS note FROM events"""
USERS = "SELECT event_id, event_type, value, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user FROM events"
ERRORS = f"SELECT user, count(*) AS errors FROM ({USERS}) WHERE event_type = 'error' GROUP BY user"

sql("filter_all", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem
    WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'R'
      AND l_shipdate > TIMESTAMP '1995-06-30 00:00:00'""")
sql("filter_any", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_linestatus FROM lineitem
    WHERE l_quantity = 50 OR l_tax <= 0.0 OR l_linestatus > 'O'""")
sql("filter_empty", f"SELECT event_id FROM ({NOTE}) WHERE note IS NULL OR trim(note) = ''")
sql("filter_not_empty", f"SELECT event_id, note FROM ({NOTE}) WHERE trim(note) <> ''")
sql("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
sql("filter_counts", """
    SELECT count(*) FILTER (WHERE NOT l_quantity > 45) AS removed, count(*) FILTER (WHERE l_quantity > 45) AS kept,
           CAST(0 AS BIGINT) AS boxed_dropped FROM lineitem""")
sql("filter_boxed", f"SELECT * FROM ({BOXED}) WHERE price_de < 20000 OR size = 'groß'")
sql("filter_boxed_counts", f"""
    WITH t AS (SELECT *, coalesce(price_de < 20000 AND size = 'groß', false) AS keep FROM ({BOXED}))
    SELECT count(*) FILTER (WHERE NOT keep) AS removed, count(*) FILTER (WHERE keep) AS kept,
           count(*) FILTER (WHERE NOT keep AND price_de__raw IS NOT NULL) AS boxed_dropped FROM t""")
sql("select_rename", "SELECT o_totalprice AS total, o_orderkey, o_orderkey AS again FROM orders")

sql("sort_first", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
sql("sort_last", """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber ASC LIMIT 100""")
sql("sort_stable", """
    WITH t AS (SELECT *, row_number() OVER () AS nth FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM t
    ORDER BY l_quantity DESC, l_returnflag, nth LIMIT 500""")
sql("sort_empty_last", """
    WITH t AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, quality FROM t ORDER BY quality IS NULL DESC, quality ASC, doc_id DESC LIMIT 50""")
sql("sort_collate_de", r"""
    WITH t AS (SELECT doc_id, regexp_extract(text, '([^\s.,]+)[.,]?\s*$', 1) AS word FROM documents)
    SELECT doc_id, word FROM t
    ORDER BY trim(word) = '', CASE WHEN trim(word) <> '' THEN word END COLLATE de, doc_id LIMIT 300""")
sql("row_window", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 200""")
sql("preview_counts", "SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM orders")
sql("sort_boxes_last", f"""
    SELECT * FROM ({BOXED})
    ORDER BY price_de IS NULL DESC, price_de ASC, order_no COLLATE de DESC, line COLLATE de DESC LIMIT 200""")

sql("sort_full_rank", """
    SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rank
    FROM lineitem""")
sql("collation_full_rank", r"""
    WITH w AS (SELECT doc_id, regexp_extract(text, '([^\s.,]+)[.,]?\s*$', 1) AS word FROM documents)
    SELECT doc_id, word, row_number() OVER (ORDER BY coalesce(trim(word), '') = '',
        CASE WHEN trim(word) <> '' THEN word END COLLATE de, doc_id) AS rank FROM w""")
sql("window_deep", """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS pos FROM lineitem),
    h AS (SELECT count(*) // 2 AS half FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, pos - half AS place FROM r, h WHERE pos >= half AND pos < half + 5000""")
sql("boxed_rows_last", f"""
    SELECT 'warning' AS severity, 'step.boxed_rows_last' AS code, count(price_de__raw) AS rows FROM ({BOXED})""")

PARTIES = """
    SELECT c_custkey AS key, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment,
           CAST(NULL AS INTEGER) AS s_nationkey FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, NULL, s_acctbal, NULL, s_nationkey FROM supplier"""
sql("union_keep", PARTIES)
sql("union_drop", f"SELECT key, name, balance FROM ({PARTIES})")
sql("union_per_column", f"SELECT key, name, balance, c_mktsegment FROM ({PARTIES})")
sql("union_boxes", f"""
    SELECT order_no, price_de AS price, price_de__raw AS price__raw FROM ({BOXED})
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice, NULL FROM orders""")
sql("union_partial_columns", """
    SELECT c.*, t.rows FROM (VALUES ('c_nationkey', '0'), ('c_mktsegment', '0'), ('s_nationkey', '1')) c("column", slots),
    (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows) t""")

sql("join_left", """
    SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
sql("join_inner", """
    SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
sql("join_heavy_keys", """
    WITH m AS (SELECT CASE WHEN l_linenumber < 7 THEN l_linenumber END AS line, l_orderkey, l_extendedprice FROM lineitem),
    f AS (SELECT line, count(*) AS n FROM m GROUP BY 1)
    SELECT f.line, n, l_orderkey, l_extendedprice FROM f LEFT JOIN m ON f.line = m.line""")
sql("join_two_keys", """
    SELECT l_orderkey, l_linenumber, total FROM lineitem LEFT JOIN (
        SELECT l_partkey, l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey)""")
sql("join_nulls_apart", f"""
    SELECT e.event_id, e.user, r.errors FROM ({USERS}) e LEFT JOIN ({ERRORS}) r ON e.user = r.user""")
sql("join_nulls_match", f"""
    SELECT e.event_id, e.user, r.errors FROM ({USERS}) e LEFT JOIN ({ERRORS}) r
    ON e.user IS NOT DISTINCT FROM r.user""")
sql("join_name_clash", """
    SELECT c_nationkey AS nation, c_name AS name, n_name AS name_2, s.n AS name_3
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""")
sql("join_boxed_keys", f"""
    WITH t AS ({BOXED}), c AS (SELECT price_de, count(*) AS same FROM t WHERE price_de__raw IS NULL GROUP BY 1)
    SELECT t.order_no, t.line, CASE WHEN t.price_de__raw IS NULL THEN c.same END AS same FROM t
    LEFT JOIN c ON t.price_de IS NOT DISTINCT FROM c.price_de AND t.price_de__raw IS NULL""")
REPORT = """
    WITH l AS ({left}), r AS ({right}),
    j AS (SELECT l.k AS lk, r.k AS rk FROM l LEFT JOIN r ON l.k = r.k)
    SELECT (SELECT count(*) FROM l) AS rows_left, (SELECT count(*) FROM j) AS rows_out,
           (SELECT count(*) FROM j WHERE rk IS NULL) AS unmatched_left,
           (SELECT count(*) FROM j) / (SELECT count(*) FROM l) AS growth,
           (SELECT count(*) FROM l WHERE k IS NULL) AS null_keys_left,
           (SELECT count(*) FROM r WHERE k IS NULL) AS null_keys_right"""
sql("join_report", REPORT.format(left="SELECT c_custkey AS k FROM customer", right="SELECT o_custkey AS k FROM orders"))
sql("join_report_nulls", REPORT.format(left=f"SELECT user AS k FROM ({USERS})", right=f"SELECT user AS k FROM ({ERRORS})"))
sql("duplicate_audit", """
    WITH l AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1),
    r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT coalesce(l.k, r.k) AS c_custkey, coalesce(l.n, 0) AS rows_left, coalesce(r.n, 0) AS rows_right,
           coalesce(l.n, 0) * coalesce(r.n, 0) AS rows_out
    FROM l FULL JOIN r ON l.k = r.k WHERE coalesce(l.n, 0) > 1 OR coalesce(r.n, 0) > 1""")

sql("aggregate_all", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(l_quantity) AS quantity,
           avg(l_quantity) AS mean_quantity, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price
    FROM lineitem GROUP BY 1, 2""")
sql("aggregate_null_group", f"""
    SELECT user, count(*) AS n, min(event_type) AS first_type FROM ({USERS}) GROUP BY user""")
sql("aggregate_boxes", f"""
    SELECT size, count(*) AS n, round(sum(price_de), 2) AS total, max(price_de) AS top,
           count(DISTINCT price_de) AS prices FROM ({BOXED}) GROUP BY size""")
sql("aggregate_boxed_key", f"""
    SELECT price_de, price_de__raw, count(*) AS n FROM ({BOXED}) GROUP BY 1, 2 HAVING count(*) > 1""")
sql("computed_arithmetic", """
    SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_discount AS minus,
           l_extendedprice * l_discount AS times, l_extendedprice / l_quantity AS per FROM lineitem""")
sql("computed_marked_empty", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS share,
           CASE WHEN l_discount = 0 THEN '' END AS share__raw FROM lineitem""")
sql("computed_concat", f"""
    SELECT p_partkey, concat_ws(' / ', p_brand, p_type, {shortest_de('p_size::DOUBLE')}) AS label FROM part""")
sql("computed_date_diff", """
    SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
sql("computed_on_boxes", f"""
    SELECT order_no, line, price_de + price_de AS double,
           CASE WHEN price_de__raw IS NOT NULL THEN '' END AS double__raw FROM ({BOXED})""")

sql("parse_numbers", """
    SELECT l_orderkey, l_linenumber, l_extendedprice AS de, -l_extendedprice AS en, -l_extendedprice AS paren,
           CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS trailing,
           l_extendedprice AS euro, -l_extendedprice AS dollar, CAST(NULL AS DOUBLE) AS wrong FROM lineitem""")
sql("parse_dates", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST(l_shipdate AS DATE) AS d{i}" for i in range(14)) + " FROM lineitem")
sql("parse_month_names", """
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS de, CAST(l_shipdate AS DATE) AS en,
           date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL '4 hours 5 minutes 6 seconds' AS at FROM lineitem""")
sql("parse_datetimes", """
    SELECT event_id, ts + INTERVAL '5 hours 30 minutes' AS iso,
           date_trunc('second', ts) + INTERVAL '500 milliseconds' AS basic, ts AS plain,
           date_trunc('minute', ts) AS german, date_trunc('day', ts)::TIMESTAMP + INTERVAL '1 day' AS next_day FROM events""")
CLOCK = "(extract('minute' FROM ts) * 60 + extract('second' FROM ts))"
sql("parse_clocks", f"""
    SELECT event_id, CAST((extract('hour' FROM ts) * 3600 + {CLOCK}) AS BIGINT) * 1000000000 AS time_ns,
           CASE WHEN user_id + 20 <= 23 THEN CAST((user_id + 20) * 3600 + {CLOCK} AS BIGINT) * 1000000000 END AS late_ns,
           CAST((user_id + 20) * 3600 + {CLOCK} AS BIGINT) * 1000000000 AS duration_ns FROM events""")
sql("parse_booleans", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END AS wf,
           CASE WHEN l_returnflag NOT IN ('R', 'A') THEN true END AS jn FROM lineitem""")

N, MISSING, BAD = "count(*)", f"count(*) FILTER (WHERE {GAP})", f"count(*) FILTER (WHERE NOT ({GAP}) AND {ODD})"
# column: (type, format, missing, unparsed, verdict, affix)
PROPOSED = {
    "price_de": ("number", "de-DE", MISSING, BAD, "settled", None),
    "price_en": ("number", "en-US", MISSING, "0", "settled", None),
    "booked": ("number", "de-DE", "0", "0", "settled", None),
    "discount": ("number", "de-DE", "0", "0", "settled", "%"),
    "shipped_de": ("date", "dd.MM.yyyy", MISSING, "0", "decisive", None),
    "shipped_us": ("date", "MM/dd/yyyy", "0", "0", "decisive", None),
    "shipped_short": ("date", "dd.MM.yy", "0", "0", "decisive", None),
    "shipped_at": ("datetime", "ISO 8601", "0", "0", "settled", None),
    "worked": ("duration", None, "0", "0", "decisive", None),
    "returned": ("boolean", "ja/nein", "0", "0", "settled", None),
    "article": ("text", None, "0", "0", "settled", None),
    "line": ("number", "de-DE", "0", "0", "settled", None),
    "size": ("text", None, "0", "0", "settled", None),
    "order_no": ("number", "de-DE", "0", "0", "settled", None),
}


def _text(value) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


sql("detect_report_types", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, {_text(f)} AS format, {N} AS total, {m} AS missing, "
    f"{N} - {m} - {bad} AS parsed, {bad} AS unparsed, '{v}' AS verdict, {_text(a)} AS affix FROM lineitem"
    for c, (t, f, m, bad, v, a) in PROPOSED.items()))
LATE_DAY = "extract('day' FROM l_shipdate) > 12"
EVIDENCE = {
    "shipped_de": ("dd.MM.yyyy | MM.dd.yyyy", f"NOT ({GAP}) AND {LATE_DAY}"),
    "shipped_us": ("MM/dd/yyyy | dd/MM/yyyy", LATE_DAY),
    "shipped_short": ("dd.MM.yy | MM.dd.yy", LATE_DAY),
    "worked": ("duration | time", "l_quantity >= 24"),
}
sql("detect_evidence", "\nUNION ALL\n".join([
    *(f"SELECT '{c}' AS \"column\", '{a}' AS alternatives, count(*) FILTER (WHERE {w}) AS decided_by, "
      f"CAST(0 AS BIGINT) AS contested FROM lineitem" for c, (a, w) in EVIDENCE.items()),
    *(f"SELECT '{c}', NULL, NULL, NULL" for c in (
        "price_de", "price_en", "booked", "discount", "shipped_at", "returned", "article", "line", "size", "order_no"))]))
CHOSEN = {
    "price_de": ("number", "0"), "shipped_de": ("date", f"count(*) FILTER (WHERE NOT ({GAP}) AND NOT {LATE_DAY})"),
    "returned": ("boolean", N), "article": ("number", N), "size": ("number", "0"), "shipped_us": ("text", N),
    "worked": ("time", "count(*) FILTER (WHERE l_quantity < 24)"),
}
sql("score_chosen_types", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{CHOSEN.get(c, (t, 0))[0]}' AS type, "
    f"{(p := CHOSEN[c][1] if c in CHOSEN else f'{N} - {m} - {bad}')} AS parsed, {N} - {m} - ({p}) AS unparsed FROM lineitem"
    for c, (t, f, m, bad, v, a) in PROPOSED.items()))
sql("convert_report", f"""
    SELECT l_orderkey::DOUBLE AS order_no, l_linenumber::DOUBLE AS line,
           CASE WHEN NOT ({GAP}) AND NOT ({ODD}) THEN l_extendedprice END AS price_de,
           CASE WHEN NOT ({GAP}) AND ({ODD}) THEN 'unbekannt' END AS price_de__raw,
           CASE WHEN NOT ({GAP}) THEN l_extendedprice END AS price_en,
           CASE WHEN {ODD} THEN -l_extendedprice ELSE l_extendedprice END AS booked,
           round(l_discount * 100) AS discount,
           CASE WHEN NOT ({GAP}) THEN CAST(l_shipdate AS DATE) END AS shipped_de,
           CAST(l_shipdate AS DATE) AS shipped_us, date_trunc('second', l_shipdate) - INTERVAL 2 HOUR AS shipped_at,
           l_returnflag = 'R' AS returned, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS article,
           CAST(l_shipdate AS DATE) AS shipped_short, (CAST(floor(l_quantity) AS BIGINT) * 3600 + 1800) * 1000000000 AS worked,
           CAST(NULL AS VARCHAR) AS worked__raw, CASE WHEN l_quantity > 25 THEN 'groß' ELSE 'klein' END AS size FROM lineitem""")
sql("convert_clocks", """
    SELECT l_orderkey::DOUBLE AS order_no, l_linenumber::DOUBLE AS line,
           (CAST(floor(l_quantity) AS BIGINT) * 3600 + 1800) * 1000000000 AS worked FROM lineitem""")
sql("render_german", "SELECT " + ", ".join(
    f"{shortest_de(c + '::DOUBLE')} AS {c}" for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ", l_returnflag, l_linestatus, strftime(l_shipdate, '%d.%m.%Y %H:%M') AS l_shipdate FROM lineitem")
sql("render_boxes", f"""
    SELECT order_no, line, coalesce({shortest_de('price_de')}, price_de__raw, '') AS price_de FROM ({BOXED})""")
sql("sweep_typed_columns", """
    SELECT 'c_custkey' AS "column", count(*) AS total, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unreadable
    FROM customer UNION ALL
    SELECT 'c_acctbal', count(*), count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_custkey % 7 = 0),
           count(*) FILTER (WHERE c_custkey % 10 = 0) FROM customer UNION ALL
    SELECT 'c_nationkey', count(*), 0, 0 FROM customer""")

LABELLED = "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
sql("column_profile", "\nUNION ALL\n".join(
    f"SELECT 'documents' AS source, count(*) AS rows, '{c}' AS \"column\", '{t}' AS type, count(DISTINCT {c}) "
    f"AS distinct_values, (count(*) - count({c})) / count(*) AS null_share FROM ({LABELLED})"
    for c, t in (("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number"),
                 ("quality", "number"), ("toxic", "number"))))
sql("sample_values", """
    (SELECT DISTINCT 'p_brand' AS "column", p_brand AS value FROM part ORDER BY value LIMIT 3) UNION ALL
    (SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) AS value FROM part ORDER BY value LIMIT 3)""")
sql("search_rows", f"""
    WITH t AS (SELECT p_partkey, {shortest_de('p_partkey::DOUBLE')} AS a, p_name AS b, p_brand AS c, p_type AS ty,
                      {shortest_de('p_size::DOUBLE')} AS sz, {shortest_de('p_retailprice')} AS d FROM part),
    h AS (SELECT p_partkey, concat_ws(',', CASE WHEN contains(a, '12') THEN 'p_partkey' END,
              CASE WHEN contains(b, '12') THEN 'p_name' END, CASE WHEN contains(c, '12') THEN 'p_brand' END,
              CASE WHEN contains(ty, '12') THEN 'p_type' END, CASE WHEN contains(sz, '12') THEN 'p_size' END,
              CASE WHEN contains(d, '12') THEN 'p_retailprice' END) AS matched FROM t)
    SELECT p_partkey, matched FROM h WHERE matched <> ''""")
sql("search_counts", """
    SELECT count(*) FILTER (WHERE contains(text, 'the') OR contains(lang, 'the') OR contains(source, 'the')) AS rows,
           CAST(sum(contains(text, 'the')::INT + contains(lang, 'the')::INT + contains(source, 'the')::INT) AS BIGINT) AS cells
    FROM documents""")
sql("tile_top_n", """
    SELECT l_suppkey, sum(l_quantity) AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, l_suppkey LIMIT 10""")
sql("tile_bottom_n", """
    SELECT l_suppkey, count(*) AS value FROM lineitem GROUP BY 1 ORDER BY value, l_suppkey LIMIT 10""")
sql("tile_line", "SELECT o_orderdate, count(*) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 60")
sql("tile_key_figure", "SELECT sum(l_quantity) AS value FROM lineitem")
sql("preflight_scores", f"""
    SELECT 'price_de' AS "column", 'doubtful' AS verdict,
           ({N} - {MISSING} - {BAD}) / ({N} - {MISSING}) AS hit_rate FROM lineitem UNION ALL
    SELECT 'price_en', 'doubtful', 0.0 UNION ALL SELECT 'shipped_de', 'fits', 1.0 UNION ALL
    SELECT 'shipped_us', 'fits', 1.0 UNION ALL SELECT 'size', 'fits', 1.0 UNION ALL SELECT 'Preis', 'missing', NULL""")
sql("map_columns", "SELECT c_custkey AS Kundennr, c_name AS Name FROM customer")

BIG = "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 100000"
GROUPED = f"""
    SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS orders, sum(o_totalprice) AS total
    FROM ({BIG}) LEFT JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
sql("recipe_end_to_end", f"""
    SELECT segment, nation, orders, round(total, 2) AS total, round(total / orders) AS mean FROM ({GROUPED})
    ORDER BY orders DESC, segment, nation LIMIT 40""")
sql("recipe_report", f"""
    WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
                      count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders),
    b AS (SELECT count(*) AS big FROM ({BIG})), g AS (SELECT count(*) AS groups FROM ({GROUPED})),
    a AS (SELECT * FROM o, b, g),
    u AS (SELECT count(*) AS lost FROM ({BIG}) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)),
    i AS (SELECT CAST(sum(orders) AS BIGINT) AS joined FROM ({GROUPED}))
    SELECT step, 'info' AS severity, code, name, CAST(value AS VARCHAR) AS value FROM (
        SELECT 'open' AS step, 'step.rows_removed' AS code, 'removed' AS name, n - open AS value FROM a UNION ALL
        SELECT 'open', 'step.rows_removed', 'kept', open FROM a UNION ALL
        SELECT 'done', 'step.rows_removed', 'removed', n - done FROM a UNION ALL
        SELECT 'done', 'step.rows_removed', 'kept', done FROM a UNION ALL
        SELECT 'big', 'step.rows_removed', 'removed', open + done - big FROM a UNION ALL
        SELECT 'big', 'step.rows_removed', 'kept', big FROM a UNION ALL
        SELECT 'who', 'step.join_unmatched', 'rows', lost FROM u UNION ALL
        SELECT 'sums', 'step.aggregate_rows', 'before', joined FROM i UNION ALL
        SELECT 'sums', 'step.aggregate_rows', 'after', groups FROM a UNION ALL
        SELECT 'top', 'step.rows_removed', 'removed', greatest(groups - 40, 0) FROM a UNION ALL
        SELECT 'top', 'step.rows_removed', 'kept', least(groups, 40) FROM a)""")
sql("run_status", """
    SELECT * FROM (VALUES ('info', 6::BIGINT, true), ('warning', 0, true), ('error', 0, true), ('unresolved', 0, true))
    t(severity, n, clean)""")
sql("recipe_contract", """
    SELECT * FROM (VALUES ('orders', 'o_custkey', 'number'), ('orders', 'o_orderstatus', 'text'),
        ('orders', 'o_totalprice', 'number'), ('customer', 'c_custkey', 'number'), ('customer', 'c_nationkey', 'number'),
        ('customer', 'c_mktsegment', 'text'), ('nation', 'n_nationkey', 'number'), ('nation', 'n_name', 'text'))
    t(source, "column", type)""")

LONG, SHORT = "o_orderkey % 101 = 0", "o_orderkey % 101 <> 0 AND o_orderkey % 103 = 0"
ORDER_LINE = f"""concat_ws(';', CAST(o_orderkey AS VARCHAR), {de('floor(o_totalprice)', 0)},
        strftime(o_orderdate, '%d.%m.%Y'), concat('"Prio; ', o_orderpriority, '"'), CAST(o_custkey AS VARCHAR), o_orderstatus)"""
sql("csv_read", f"""
    SELECT o_orderkey::DOUBLE AS "Nr", floor(o_totalprice) AS "Betrag", CAST(o_orderdate AS DATE) AS "Datum",
           concat('Prio; ', o_orderpriority) AS "Priorität", o_custkey::DOUBLE AS "Kunde", o_orderstatus AS "Status" FROM orders WHERE NOT ({LONG}) AND NOT ({SHORT})""")
sql("csv_quarantine", f"""
    SELECT 7 AS fields, concat({ORDER_LINE}, ';zuviel') AS raw, 'field_count' AS reason FROM orders WHERE {LONG}
    UNION ALL
    SELECT 2, concat_ws(';', CAST(o_orderkey AS VARCHAR), {de('floor(o_totalprice)', 0)}), 'field_count' FROM orders
    WHERE {SHORT}""")
sql("csv_proposals", """
    SELECT ';' AS delimiter, 1::BIGINT AS header_line, 6 AS fields, 'utf-8' AS encoding, 'probe' AS decided_by,
           0::BIGINT AS nul_bytes""")
sql("csv_line_breaks", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
sql("csv_malformed_rows", """
    SELECT 3 AS fields, concat('"', l_orderkey, '"x,', l_linenumber, ',', l_returnflag) AS raw, 'malformed_quote' AS reason
    FROM lineitem WHERE l_orderkey % 7 = 0""")
sql("unique_columns", """
    SELECT CAST(c_custkey AS VARCHAR) AS "Nr", c_name AS col_2_2, CAST(c_nationkey AS VARCHAR) AS "Nr_2", c_mktsegment AS col_2 FROM customer""")
sql("csv_utf16", "SELECT p_partkey AS \"Nr\", p_name || chr(2570) || chr(256) || ' -' || chr(2560) AS \"Name\", p_brand FROM part")
sql("json_document", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
ACCENTED = r"""
    SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\s\x00-\x1f]+', ' ', 'g')), '[^ -~À-ÿ]', '?', 'g') AS value
    FROM documents"""
sql("encoding_detected", """
    SELECT * FROM (VALUES ('utf8', 'utf-8', 'probe', 0::BIGINT), ('cp1252', 'windows-1252', 'fallback', 0))
    t(written_as, encoding, decided_by, nul_bytes)""")
sql("encoding_decoded", f"SELECT md5(value) AS text_md5, 2 * count(*) AS n FROM ({ACCENTED}) GROUP BY 1")
sql("nul_bytes", "SELECT CAST(sum(length(p_name) + 1) AS BIGINT) AS nul_bytes FROM part")
sql("json_flattened", """
    SELECT event_id, user_id AS who_id, event_type AS who_kind, CASE event_id % 3 WHEN 0 THEN '[]'
           WHEN 1 THEN concat('[', CAST(value AS VARCHAR), ']')
           ELSE concat('[', CAST(value AS VARCHAR), ',', CAST(value + 1 AS VARCHAR), ']') END AS "values" FROM events""")
sql("json_indexed", """
    SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v0, CASE WHEN event_id % 3 = 2 THEN value + 1 END AS v1
    FROM events""")
sql("json_exploded", """
    SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events
    UNION ALL SELECT event_id, value + 1 FROM events WHERE event_id % 3 = 2""")
sql("json_shapes", """
    SELECT 'ndjson' AS written_as, 'ndjson' AS shape, CAST(NULL AS BIGINT) AS files UNION ALL
    SELECT 'document', 'document', count(*) FROM nation UNION ALL
    SELECT 'malformed', 'malformed', count(*) FROM nation""")
READABLE = "(event_id % 2 = 0 OR event_id % 11 <> 0)"
sql("json_lenient", f"""
    SELECT event_id, {READABLE} AS changed, {READABLE} AS repaired, CASE WHEN {READABLE} THEN event_id END AS id,
           CASE WHEN {READABLE} THEN event_type END AS kind, CASE WHEN {READABLE} THEN props END AS props FROM events""")
KINDS = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag:text l_linestatus:text l_shipdate:datetime",
    "orders": "o_orderkey o_custkey o_orderstatus:text o_totalprice o_orderdate:datetime o_orderpriority:text",
    "events": "event_id ts:datetime user_id event_type:text value props:text",
    "embeddings": "vec_id embedding:text label",
    "customer": "c_custkey c_name:text c_nationkey c_acctbal c_mktsegment:text",
}
sql("parquet_non_finite", """
    WITH t AS (SELECT CASE c_custkey % 10 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' END AS raw, c_acctbal AS v FROM customer)
    SELECT raw AS c_acctbal__raw, count(*) AS rows, max(CASE WHEN raw IS NULL THEN v END) AS most,
           CASE WHEN raw IS NULL THEN (SELECT count(*) FROM t WHERE raw IS NULL AND v > 0) END AS n,
           CASE WHEN raw IS NULL THEN (SELECT round(sum(v), 2) FROM t WHERE raw IS NULL AND v > 0) END AS s,
           (SELECT count(*) FROM t WHERE raw IS NOT NULL) AS boxed FROM t GROUP BY raw""")
sql("parquet_types", "SELECT k.*, (SELECT CAST(min(len(embedding)) AS INTEGER) FROM embeddings) AS dims FROM (VALUES "
    + ", ".join(f"('{t}', '{(c + ':number').split(':')[0]}', '{(c + ':number').split(':')[1]}')"
                for t, columns in KINDS.items() for c in columns.split())
    + ') k("table", "column", kind)')
sql("parquet_round_trip", BOXED)
sql("csv_round_trip", "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment "
    "FROM customer")
sql("json_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
WRITTEN = r"""
    SELECT event_id, event_type, props, event_id % 7 = 3 AS damaged, '{"event_id":' || event_id || ',"event_type":"' || event_type
           || '","props":"' || replace(props, '"', '\"') || '"}' AS whole FROM events"""
DAMAGED = f"""
    SELECT *, CASE event_id % 3 WHEN 0 THEN left(whole, length(whole) - 1) WHEN 1 THEN whole || whole
              ELSE left(whole, length(whole) - 1) || ',}}' END AS raw FROM ({WRITTEN}) WHERE damaged"""
sql("json_set_aside", f"""
    SELECT event_id, event_type, props, (SELECT count(*) FROM ({DAMAGED})) AS lines_set_aside FROM ({WRITTEN}) WHERE NOT damaged""")
sql("json_quarantine", f"SELECT raw FROM ({DAMAGED})")
sql("json_repaired", f"""
    SELECT raw AS before, event_id % 3 = 2 AS repaired, CASE WHEN event_id % 3 = 2 THEN event_id END AS event_id,
           CASE WHEN event_id % 3 = 2 THEN props END AS props FROM ({DAMAGED})""")
sql("json_reread_all", f"""
    SELECT raw AS before, event_id % 3 = 2 AS repaired, CASE WHEN event_id % 3 = 2 THEN event_id END AS event_id,
           CASE WHEN event_id % 3 = 2 THEN props END AS props FROM ({DAMAGED})""")
sql("workbook_read", """
    SELECT c_custkey::DOUBLE AS "Nr", c_name AS "Name", c_nationkey::DOUBLE AS "Land", c_acctbal AS "Saldo", c_mktsegment AS "Segment"
    FROM customer""")

FINE = """
    SELECT l_orderkey AS order_no, l_linenumber AS line, l_partkey % 97 = 0 AS boxed,
           CASE WHEN l_partkey % 97 <> 0 AND l_partkey % 89 <> 0 THEN l_shipdate + INTERVAL 1 MICROSECOND END AS moment,
           CASE WHEN l_partkey % 97 <> 0 AND l_partkey % 89 <> 0 THEN CAST(l_orderkey % 4 * 100 + l_suppkey % 3 * 7 AS INTEGER) END AS nanos
    FROM lineitem"""
sql("datetime_nanos", f"""
    SELECT moment, nanos, CASE WHEN boxed THEN 'unknown' END AS text, count(*) AS count, CAST(min(order_no) AS DOUBLE) AS first_order
    FROM ({FINE}) GROUP BY 1, 2, 3""")
sql("datetime_nanos_filter", f"""
    WITH t AS (SELECT epoch_us(moment)::HUGEINT * 1000 + nanos AS v, epoch_us(TIMESTAMP '1995-03-04 00:00:00.000001')::HUGEINT * 1000 + 107 AS x FROM ({FINE}))
    SELECT count(*) FILTER (v = x) AS eq, count(*) FILTER (v <> x) AS ne, count(*) FILTER (v < x) AS lt,
           count(*) FILTER (v <= x) AS lte, count(*) FILTER (v > x) AS gt, count(*) FILTER (v >= x) AS gte FROM t""")
sql("datetime_nanos_join", f"""
    WITH t AS ({FINE}), s AS (SELECT moment, nanos, count(*) AS same FROM t WHERE moment IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT t.line, t.moment, t.nanos, s.same FROM t LEFT JOIN s ON t.moment = s.moment AND t.nanos = s.nanos),
    g AS (SELECT line, min({{'a': moment, 'n': nanos}}) FILTER (moment IS NOT NULL) AS a, max({{'a': moment, 'n': nanos}}) FILTER (moment IS NOT NULL) AS z,
                 count(DISTINCT {{'a': moment, 'n': nanos}}) FILTER (moment IS NOT NULL) AS d, sum(same) AS pairs FROM j GROUP BY 1)
    SELECT CAST(line AS VARCHAR) AS line,
           strftime(a.a, '%d.%m.%Y %H:%M:%S') || ',000001' || rtrim(lpad(CAST(a.n AS VARCHAR), 3, '0'), '0') AS first,
           strftime(z.a, '%d.%m.%Y %H:%M:%S') || ',000001' || rtrim(lpad(CAST(z.n AS VARCHAR), 3, '0'), '0') AS last,
           translate(format('{{:,}}', d), ',', '.') AS different, translate(format('{{:,}}', CAST(pairs AS BIGINT)), ',', '.') AS pairs FROM g""")
sql("parquet_nanos", "SELECT event_id, ts AS moment, CAST(event_id % 1000 AS INTEGER) AS nanos FROM events")
sql("search_positions", """
    WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS row FROM documents),
    h AS (SELECT row, 1 AS place, 'doc_id' AS "column" FROM d WHERE contains(CAST(doc_id AS VARCHAR), '1')
          UNION ALL SELECT row, 2, 'text' FROM d WHERE contains(text, '1') UNION ALL SELECT row, 3, 'lang' FROM d WHERE contains(lang, '1')
          UNION ALL SELECT row, 4, 'source' FROM d WHERE contains(source, '1') UNION ALL SELECT row, 5, 'n_chars' FROM d WHERE contains(CAST(n_chars AS VARCHAR), '1'))
    SELECT row_number() OVER (ORDER BY row, place) AS hit, row, CAST(place AS INTEGER) AS place, "column" FROM h""")
