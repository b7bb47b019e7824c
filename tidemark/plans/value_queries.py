"""Queries: texts, boxes, JSON, claims, times, evaluation metrics, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import entities, images, notation, structured, text, vectors, when
from tidemark.operators import audit, documents, planner
from tidemark.operators.ordered import held
from tidemark.plans.audit_queries import _KINDS
from tidemark.plans.registry import hmac_sql, query, ranges_sql
from tidemark.sources.tables import table

# --- texts ---------------------------------------------------------------------------------------


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), chr(160), ' '), '\\p{Cf}', '', 'g'),
  '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents
""")
def document_form(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", F.md5(text.normalise_document(F.col("text"))).alias("digest"))


@query("""
SELECT page_id, nullif(trim(left(lower(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' ')), 24), ' '), '') AS title,
  nullif(lower(trim(url, ' ')), '') AS process, trim(regexp_replace(lower(url), '\\s+', ' ', 'g'), ' ') AS q FROM pages
""")
def names_normalised(spark: SparkSession, base: str) -> DataFrame:
    raw = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return table(spark, base, "pages").select(
        "page_id", text.normalise_title(raw, 24).alias("title"), text.process_name(F.col("url")).alias("process"),
        text.normalise_query(F.col("url")).alias("q"),
    )


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
o AS (SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)) AS o FROM l)
SELECT doc_id, array_to_string(list_transform(o, lambda x: x::BIGINT), ',') AS offsets FROM o
""")
def line_starts(spark: SparkSession, base: str) -> DataFrame:
    at = structured.line_offsets(F.col("text"))
    return table(spark, base, "documents").select("doc_id", F.array_join(at.cast("array<string>"), ",").alias("offsets"))


@query("""
WITH l AS (SELECT conv_id, list(text ORDER BY turn, role) AS l FROM conversations GROUP BY 1), j AS (SELECT conv_id, array_to_string(l, chr(10)) AS t FROM l),
s AS (SELECT conv_id, t, string_split(t, chr(10)) AS l FROM j),
k AS (SELECT conv_id, md5(t) AS digest, list_transform(range(1, len(l) + 1), lambda i: 'S' || i || '@' || coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT
  || '-' || (coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) + length(l[i]))::BIGINT) AS spans FROM s)
SELECT conv_id, digest, array_to_string(spans, ',') AS spans FROM k
""")
def joined_lines(spark: SparkSession, base: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, base, "conversations").groupBy("conv_id").agg(F.transform(listed, lambda x: x["text"]).alias("lines"))
    rows = rows.withColumn("j", structured.join_lines(F.col("lines")))
    shown = F.transform("j.spans", lambda s: F.concat(s["key"], F.lit("@"), s["start"], F.lit("-"), s["end"]))
    return rows.select("conv_id", F.md5("j.text").alias("digest"), F.array_join(shown, ",").alias("spans"))


@query("""
WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS chunk, 0 AS s, CASE WHEN length(text) <= 800 THEN length(text) WHEN contains(substr(text, 201, 600), chr(10) || chr(10))
    THEN 800 - strpos(reverse(substr(text, 201, 600)), chr(10) || chr(10)) + 1 ELSE 800 END AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, chunk + 1, e, CASE WHEN length(text) <= e + 800 THEN length(text) WHEN contains(substr(text, e + 201, 600), chr(10) || chr(10))
    THEN e + 800 - strpos(reverse(substr(text, e + 201, 600)), chr(10) || chr(10)) + 1 ELSE e + 800 END FROM c WHERE e < length(text))
SELECT doc_id, chunk::INT AS chunk, s::INT AS "start", e::INT AS "end", sha256(substr(text, s + 1, e - s)) AS chunk_hash FROM c
""")
def document_chunks(spark: SparkSession, base: str) -> DataFrame:
    cut = documents.chunks(table(spark, base, "documents"), "doc_id", "text")
    return cut.select("doc_id", "chunk", "start", "end", "chunk_hash")


@query("""
WITH w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
b AS (SELECT conv_id * 1000 + turn AS page, word, (i % 8) * 40 + CASE WHEN (i // 8) % 4 = 2 AND i % 8 > 3 THEN 200 ELSE 0 END AS x0, (i // 8) * 30 AS y0, CASE WHEN (i // 8) % 5 = 4 THEN 24 ELSE 10 END AS h,
  i // 8 AS line, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side FROM w),
l AS (SELECT page, line::INT AS line, count(*) AS n, any_value(h) AS h, (line % 4 = 2) AND count(*) > 4 AS wide, list(word ORDER BY x0) AS words FROM b GROUP BY page, line),
u AS (SELECT page, quantile_cont(h, 0.5) AS usual FROM b GROUP BY 1)
SELECT page, line, CASE WHEN wide THEN array_to_string(words, ' | ') ELSE array_to_string(words, ' ') END AS text,
  CASE WHEN wide THEN 'table' WHEN regexp_matches(array_to_string(words, ' '), '^([-*•]|\\d+[.)])') THEN 'list' WHEN h > 1.4 * usual THEN 'heading' ELSE 'text' END AS kind
FROM l JOIN u USING (page)
""")
def page_layout(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "conversations")
    words = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), F.posexplode(F.split("text", " ")).alias("i", "word"))
    line = F.floor(F.col("i") / 8)
    shift = F.when((line % 4 == 2) & (F.col("i") % 8 > 3), 200).otherwise(0)
    height = F.when(line % 5 == 4, 24).otherwise(10)
    boxes = words.select(
        "page", "word", (F.col("i") % 8 * 40 + shift).alias("x0"), (line * 30).alias("y0"),
        (F.col("i") % 8 * 40 + shift + 30).alias("x1"), (line * 30 + height).alias("y1"),
    )
    return documents.layout_lines(boxes, "page")


@query("""
WITH t AS (SELECT conv_id, turn, role, text || chr(10) || '```sql' || chr(10) || 'SELECT a FROM t' || conv_id || ' JOIN u' || turn || ' ON 1; drop table x;' || chr(10) || '```' || chr(10) || '```' || chr(10) || role || chr(10) || '```' AS t FROM conversations)
SELECT conv_id, turn, role, array_to_string(regexp_extract_all(t, '(?s)```([A-Za-z0-9_+-]*)[ \\t]*\\n(.*?)```', 1), '|') AS languages,
  md5(array_to_string(regexp_extract_all(t, '(?s)```([A-Za-z0-9_+-]*)[ \\t]*\\n(.*?)```', 2), '|')) AS bodies FROM t
""")
def code_blocks(spark: SparkSession, base: str) -> DataFrame:
    rows = _coded(spark, base).withColumn("b", structured.code_blocks(F.col("t")))
    return rows.select(
        "conv_id", "turn", "role", F.array_join(F.transform("b", lambda x: x["language"]), "|").alias("languages"),
        F.md5(F.array_join(F.transform("b", lambda x: x["body"]), "|")).alias("bodies"),
    )


def _coded(spark: SparkSession, base: str) -> DataFrame:
    block = F.concat(
        F.lit("\n```sql\nSELECT a FROM t"), "conv_id", F.lit(" JOIN u"), "turn", F.lit(" ON 1; drop table x;\n```\n```\n"), "role", F.lit("\n```")
    )
    return table(spark, base, "conversations").withColumn("t", F.concat("text", block))


@query("""
WITH r AS (SELECT conv_id, turn, role, unnest(['WITH', 'INSERT', 'DROP']) AS operation,
  unnest(['t' || conv_id || ',u' || turn, role || '_log,t' || conv_id, 'x']) AS tables FROM conversations) SELECT * FROM r
""")
def sql_statements(spark: SparkSession, base: str) -> DataFrame:
    """Statements around each turn's whole text, which stands in a string and in comments, semicolons and all."""
    said = F.concat(F.lit("'from a; drop table b "), F.replace(F.col("text"), F.lit("'"), F.lit("''")), F.lit("'"))
    note = F.concat(F.lit("/* from c; "), F.replace(F.col("text"), F.lit("*/"), F.lit("")), F.lit(" */ -- ; join d\n"))
    code = F.concat(
        F.lit("WITH q AS (SELECT "), said, F.lit(" FROM t"), "conv_id", F.lit(") SELECT * FROM q JOIN u"), "turn", F.lit(" ON 1; "), note,
        F.lit("insert into \""), "role", F.lit("_log\" select "), said, F.lit(" from t"), "conv_id", F.lit("; drop table x"),
    )
    rows = table(spark, base, "conversations").select("conv_id", "turn", "role", F.explode(structured.sql_statements(code)).alias("s"))
    return rows.select("conv_id", "turn", "role", F.col("s.operation").alias("operation"), F.array_join("s.tables", ",").alias("tables"))



@query("""
SELECT event_id, 'C1' AS id, event_id % 3 <> 0 AND event_id % 4 BETWEEN 1 AND 2 AND user_id % 2 = 0 AS valid FROM events
""")
def claim_checks(spark: SparkSession, base: str) -> DataFrame:
    """Claims from JSON, with line ranges that lie within their evidence or don't."""
    rows = table(spark, base, "events")
    claim = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.when(F.col("event_id") % 3 == 0, " ").otherwise("said").alias("text"),
                    F.array(F.struct(F.concat(F.lit("E"), F.col("user_id") % 2).alias("id"), (F.col("event_id") % 4).alias("first"), F.lit(2).alias("last"))).alias("evidence"),
                )
            ).alias("claims")
        )
    )
    each = rows.select("event_id", F.explode(structured.claims(claim)).alias("c"))
    lines = F.create_map(F.lit("E0"), F.lit(3))
    return each.select("event_id", F.col("c.id").alias("id"), structured.valid_claim(F.col("c"), lines).alias("valid"))


@query("""
SELECT event_id, len(list_filter(regexp_extract_all(props, '\\d+(?:\\.\\d+)?'), lambda x: NOT list_contains(regexp_extract_all('from ' || (event_id % 100) || ' to 12', '\\d+(?:\\.\\d+)?'), x))) = 0 AS entailed FROM events
""")
def entailments(spark: SparkSession, base: str) -> DataFrame:
    said = F.concat(F.lit("from "), F.col("event_id") % 100, F.lit(" to 12"))
    return table(spark, base, "events").select("event_id", audit.entailed(F.col("props"), said).alias("entailed"))


@query("""
WITH c AS (SELECT event_id, user_id % 4 AS n, event_id % 5 AS e, event_id % 3 AS t FROM events)
SELECT event_id, CASE WHEN n = 0 THEN 'Claim 1 missing evidence IDs' ELSE concat_ws('|', CASE WHEN e > 2 THEN 'Claim 1 references unknown evidence' END,
  CASE WHEN t = 2 THEN 'Claim 1 references unknown entity tokens' END) END AS errors FROM c
""")
def claim_errors(spark: SparkSession, base: str) -> DataFrame:
    ids = F.when(F.col("user_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), F.col("event_id") % 5)))
    tokens = F.array(F.concat(F.lit("T"), F.col("event_id") % 3))
    claims = F.array(F.struct(ids.alias("evidence_ids"), tokens.alias("entity_tokens")))
    known = lambda p: F.array(*(F.lit(f"{p}{i}") for i in range(3 if p == "E" else 2)))
    errors = audit.claim_errors(claims, known("E"), known("T"))
    return table(spark, base, "events").select("event_id", F.array_join(errors, "|").alias("errors"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'CONFLICT' WHEN event_id % 7 = 0 THEN 'BLOCKED' WHEN (event_id % 10) / 10.0 < 0.6 THEN 'NO_EVIDENCE' ELSE 'NORMAL' END AS mode FROM events
""")
def answer_modes(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id")
    mode = audit.answer_mode(i % 11 == 0, i % 7 == 0, i % 10 / 10)
    return table(spark, base, "events").select("event_id", mode.alias("mode"))


@query("""
WITH h AS (SELECT DISTINCT user_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('thread:' || user_id)) AS h FROM events)
SELECT user_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS thread_id FROM h
""")
def thread_ids(spark: SparkSession, base: str) -> DataFrame:
    users = table(spark, base, "events").select("user_id").distinct()
    return users.select("user_id", structured.thread_uuid(F.concat(F.lit("thread:"), "user_id")).alias("thread_id"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS iso,
  epoch_us(ts) AS us, epoch_us(date_trunc('second', ts)) - 7200000000 AS zoned FROM events
""")
def iso_times(spark: SparkSession, base: str) -> DataFrame:
    """ISO texts of times, read again; one with a zone and one that isn't a time beside them."""
    rows = table(spark, base, "events").withColumn("iso", structured.iso_text(F.col("ts")))
    zoned = F.concat(F.left("iso", F.lit(19)), F.lit("+02:00"))
    bad = structured.iso_time(F.lit("yesterday"))
    return rows.where(bad.isNull()).select(
        "event_id", "iso", F.unix_micros(structured.iso_time(F.col("iso"))).alias("us"), F.unix_micros(structured.iso_time(zoned)).alias("zoned")
    )


@query("""
WITH n AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT s_name FROM supplier),
a AS (SELECT 'e' || s_suppkey AS entity_id, translate(lower(CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE s_name END), '013457', 'oleast') AS alias FROM supplier),
f AS (SELECT alias, count(*) AS n, min(entity_id) AS id FROM a GROUP BY 1)
SELECT n.name, translate(lower(n.name), '013457', 'oleast') AS alias, coalesce(f.n, 0) AS n_known, CASE WHEN f.n = 1 THEN id END AS entity_id,
  CASE WHEN f.n = 1 THEN 'known' WHEN f.n > 1 THEN 'ambiguous' ELSE 'new' END AS note FROM n LEFT JOIN f ON f.alias = translate(lower(n.name), '013457', 'oleast')
""")
def alias_resolution(spark: SparkSession, base: str) -> DataFrame:
    """Segments and suppliers by name among all suppliers, a third of whom go by the name of a segment."""
    suppliers = table(spark, base, "supplier")
    names = table(spark, base, "customer").select(F.col("c_mktsegment").alias("name")).union(suppliers.select("s_name")).distinct()
    known = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise(F.col("s_name"))
    own = suppliers.select(F.concat(F.lit("e"), "s_suppkey").alias("entity_id"), F.lit("SEGMENT").alias("entity_type"), known.alias("name"))
    aliases = own.select("entity_id", entities.normalise_alias("name").alias("alias_norm"), F.lit(0.9).alias("confidence"))
    return entities.resolve_aliases(names, aliases, own, "SEGMENT")



# --- boxes, JSON, types ----------------------------------------------------------------------------


@query("""
SELECT event_id, event_id % 50 AS x0, user_id % 20 AS y0, event_id % 50 + 60 AS x1, user_id % 20 + 10 AS y1, round((event_id % 50) / 100.0, 6)::DOUBLE AS u0, round(least((event_id % 50 + 60) / 100.0, 1), 6)::DOUBLE AS u1 FROM events
""")
def unit_boxes(spark: SparkSession, base: str) -> DataFrame:
    x, y = F.col("event_id") % 50, F.col("user_id") % 20
    polygon = F.array(x, y, x + 60, y, x + 60, y + 10, x, y + 10)
    rows = table(spark, base, "events").select("event_id", structured.box(polygon).alias("b"))
    unit = structured.unit_box(F.col("b"), F.lit(100), F.lit(100))
    return rows.select("event_id", *(F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), unit["x0"].alias("u0"), unit["x1"].alias("u1"))


@query("""
SELECT s_suppkey, i::INT AS i, ((i % 3) * (s_suppkey + 9)) // 3 AS x0, ((i // 3) * 7) // 2 AS y0, ((i % 3 + 1) * (s_suppkey + 9)) // 3 AS x1, ((i // 3 + 1) * 7) // 2 AS y1
FROM supplier, (SELECT unnest(range(0, 6)) AS i)
""")
def grid_tiles(spark: SparkSession, base: str) -> DataFrame:
    tiles = structured.tiles(F.col("s_suppkey") + 9, F.lit(7), 3, 2)
    each = table(spark, base, "supplier").select("s_suppkey", F.posexplode(tiles).alias("i", "t"))
    return each.select("s_suppkey", "i", *(F.col(f"t.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""
SELECT event_id, '{"a":{"n":' || event_id || ',"u":' || user_id || '},"k":' || (props->>'k') || CASE WHEN event_id % 2 = 0 THEN ',"z":[1]' ELSE '' END || '}' AS merged FROM events
""")
def json_merged(spark: SparkSession, base: str) -> DataFrame:
    first = F.concat(F.lit('{"a":{"u":0,"n":'), "event_id", F.lit('},"k":-1}'))
    over = F.concat(F.lit('{"a":{"u":'), "user_id", F.lit('},"k":'), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, ',"z":[1]').otherwise(""), F.lit("}"))
    return table(spark, base, "events").select("event_id", structured.json_merge(first, over).alias("merged"))


@query("""
WITH d AS (SELECT event_id, props->>'k' AS k, (user_id % 9)::VARCHAR AS u FROM events)
SELECT event_id, 'add' AS op, 'x.y' AS path, NULL AS old, '1' AS new FROM d WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 'change', 'k', k, u FROM d WHERE k <> u UNION ALL SELECT event_id, 'remove', 'z', 'true', NULL FROM d
""")
def json_changes(spark: SparkSession, base: str) -> DataFrame:
    old = F.concat(F.lit('{"z":true,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    new = F.concat(F.lit('{"k":'), F.col("user_id") % 9, F.when(F.col("event_id") % 2 == 0, ',"x":{"y":1}').otherwise(""), F.lit("}"))
    each = table(spark, base, "events").select("event_id", F.explode(structured.json_diff(old, new)).alias("d"))
    return each.select("event_id", "d.op", "d.path", "d.old", "d.new")


@query("SELECT event_id, (event_id % 900)::INT AS width, (user_id + 1)::INT AS height FROM events")
def frame_sizes(spark: SparkSession, base: str) -> DataFrame:
    place = F.when(F.col("event_id") % 2 == 0, "frame").otherwise("screen")
    payload = F.concat(F.lit('{"'), place, F.lit('":{"width":'), F.col("event_id") % 900, F.lit(',"height":'), F.col("user_id") + 1, F.lit("}}"))
    return table(spark, base, "events").select("event_id", structured.frame_size(payload).alias("f")).select("event_id", "f.*")


@query("""
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS as_integer, value AS as_real, props AS as_json FROM events
""")
def declared_values(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events")
    raw = F.when(F.col("event_type") == "view", F.lit("none")).otherwise(F.col("event_id").cast("string"))
    return rows.select(
        "event_id", structured.coerce(raw, "integer").alias("as_integer"),
        structured.coerce(F.col("value").cast("string"), "real").alias("as_real"), structured.coerce(F.col("props"), "json").alias("as_json"),
    )


@query("""
SELECT conv_id, 'class EvidenceItem { id text turn }' || chr(10) || chr(10) || '{ "evidence": [ ' || string_agg('EvidenceItem("E' || turn || '", ' || to_json(role) || ', ' || turn || ')', ', ' ORDER BY turn, role, text) || ' ], "query": null }' AS notation
FROM conversations GROUP BY 1
""")
def short_notation(spark: SparkSession, base: str) -> DataFrame:
    """Conversations as evidence lists in the short notation."""
    item = F.struct(F.concat(F.lit("E"), "turn").alias("id"), F.col("role").alias("text"), "turn")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("t"), item.alias("i"))))
    packed = table(spark, base, "conversations").groupBy("conv_id").agg(F.transform(listed, lambda x: x["i"]).alias("evidence"))
    payload = F.to_json(F.struct(F.lit(None).cast("string").alias("query"), "evidence"), {"ignoreNullFields": "false"})
    return packed.select("conv_id", notation.encoded(payload).alias("notation"))


@query("""
SELECT event_id, '{"token":"[REDACTED]","a":{"Password":"[REDACTED]","note":"key sk-[REDACTED]"},"k":' || (props->>'k') || '}' AS shown FROM events
""")
def redacted_json(spark: SparkSession, base: str) -> DataFrame:
    payload = F.concat(F.lit('{"token":"x'), "event_id", F.lit('","a":{"Password":7,"note":"key sk-abcdefgh'), "event_id", F.lit('"},"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, base, "events").select("event_id", entities.redact_json(payload).alias("shown"))


_TOKEN = f"kind || '_' || upper(substr({hmac_sql('lower(value)', 'local-secret')}, 1, 20))"
_CROSSES = "EXISTS (SELECT 1 FROM {} o WHERE o.doc_id = r.doc_id AND o.s < r.e AND r.s < o.e)"
_MAPPED = f"""{ranges_sql("r", "documents", _KINDS)}, mail AS (SELECT * FROM r WHERE kind = 'EMAIL'),
path AS (SELECT * FROM r WHERE kind = 'PATH' AND NOT {_CROSSES.format("mail")}),
domain AS (SELECT * FROM r WHERE kind = 'DOMAIN' AND NOT {_CROSSES.format("mail")} AND NOT {_CROSSES.format("path")}),
held AS (SELECT *, {_TOKEN} AS token FROM (SELECT * FROM mail UNION ALL SELECT * FROM path UNION ALL SELECT * FROM domain))"""
_SHOWN = """shown AS (SELECT doc_id, count(s) AS n, coalesce(string_agg(substr(text, was + 1, s - was) || token, '' ORDER BY s), '') || substr(any_value(text), coalesce(max(e), 0) + 1) AS body
  FROM (SELECT d.doc_id, d.text, s, e, token, coalesce(lag(e) OVER (PARTITION BY d.doc_id ORDER BY s), 0) AS was FROM documents d LEFT JOIN held USING (doc_id)) GROUP BY doc_id)"""


@query(f"WITH {_MAPPED}, {_SHOWN} SELECT doc_id, md5(body) AS digest, n::INT AS n FROM shown")
def pseudonym_mapping(spark: SparkSession, base: str) -> DataFrame:
    """Where each replaced value was and is, over whole texts."""
    mapped = entities.pseudonymised_with_mapping(F.col("text"), "local-secret")
    rows = table(spark, base, "documents").select("doc_id", mapped.alias("m"))
    return rows.select("doc_id", F.md5("m.text").alias("digest"), F.size("m.mapping").alias("n"))


@query(f"WITH {_MAPPED} SELECT token, arg_max(value, (doc_id, value)) AS value FROM held GROUP BY token")
def token_vault(spark: SparkSession, base: str) -> DataFrame:
    """Tokens of all texts with the values that they stand for."""
    seen = entities.entity_tokens(table(spark, base, "documents"), "doc_id", "text", "local-secret")
    # Both the vault and what is looked up in it come from what was found: texts are matched once.
    seen = held(seen.select("token", "kind", "value", F.timestamp_seconds("doc_id").alias("ts")))
    empty = "token string, kind string, value string, value_hash string, created timestamp, last_seen timestamp"
    vault = entities.vault_after(spark.createDataFrame([], empty), seen)
    return entities.resolve_tokens(seen, vault)


# Without SQL: a Fourier transform; tests hold it against a loop.


@query()
def image_hashes(spark: SparkSession, base: str) -> DataFrame:
    """Perceptual hashes of vectors taken as small grey images."""
    grey = F.transform("embedding", lambda x: (x.cast("double") + 1) * 127)
    return table(spark, base, "embeddings").select("vec_id", images.image_hash(grey, F.lit(8)).alias("bits"))


_NAMED = {"mail": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "secret": r"(?i)sk-[A-Za-z0-9-]{8,}", "number": r"\b\d{3}-\d{2}-\d{4}\b"}


@query(f"""
WITH {ranges_sql("r", "documents", _NAMED)}, o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
g AS (SELECT *, sum(CASE WHEN s < upto THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC, kind) AS g FROM o),
i AS (SELECT doc_id, min(s) AS s, max(e) AS e, first(kind ORDER BY s, e DESC, kind) AS kind FROM g GROUP BY doc_id, g),
v AS (SELECT i.*, substr(text, i.s + 1, i.e - i.s) AS value FROM i JOIN documents USING (doc_id)),
f AS (SELECT doc_id, value, min(s) AS begins, arg_min(kind, s) AS name FROM v GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY begins) AS nth FROM f),
held AS (SELECT v.doc_id, v.s, v.e, '[' || name || ':' || nth || ']' AS token FROM v JOIN k USING (doc_id, value)), {_SHOWN},
c AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1)
SELECT doc_id, md5(body) AS digest, coalesce(c.n, 0)::INT AS n FROM shown LEFT JOIN c USING (doc_id)
""")
def redaction_maps(spark: SparkSession, base: str) -> DataFrame:
    """Texts with named tokens in the place of secrets and addresses, and how many there were."""
    patterns = [("mail", text.PII_PATTERNS[0]), ("secret", r"(?i)sk-[A-Za-z0-9-]{8,}"), ("number", r"\b\d{3}-\d{2}-\d{4}\b")]
    out = documents.redacted(table(spark, base, "documents"), "doc_id", "text", patterns)
    return out.select("doc_id", F.md5("body").alias("digest"), F.size("tokens").alias("n"))


# --- vectors -----------------------------------------------------------------------------------

_BYTE_VECTOR = """list_transform(range(0, 40), lambda i: ('0x' || substr(sha256(text), ((i % 32) * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1)"""


@query(f"""
WITH v AS (SELECT item_id, {_BYTE_VECTOR} AS v FROM benchmark), n AS (SELECT item_id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT item_id, array_to_string(list_transform(v, lambda x: round(x / n, 5)::DECIMAL(9, 5)), ',') AS vector FROM n
""")
def hash_vectors(spark: SparkSession, base: str) -> DataFrame:
    unit = vectors.byte_vector(F.col("text"), 40)
    shown = F.transform(unit, lambda x: F.round(x, 5).cast("decimal(9,5)").cast("string"))
    return table(spark, base, "benchmark").select("item_id", F.array_join(shown, ",").alias("vector"))


_BYTES = "list_transform(range(0, 40), lambda i: CASE WHEN i >= {1} THEN 0 ELSE round(('0x' || substr({0}, (i * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE, 5) END::DECIMAL(9, 5))"


@query(f"""
WITH h AS (SELECT item_id, sha256(text) AS h, sha256(from_hex(sha256(text)) || from_hex('0000')) || sha256(from_hex(sha256(text)) || from_hex('0001')) AS g, sha256('license:' || text) AS s FROM benchmark)
SELECT item_id, array_to_string({_BYTES.format('h', 32)}, ',') AS plain, array_to_string({_BYTES.format('g', 99)}, ',') AS counted, round(('0x' || substr(s, 1, 2))::INT / 255.0::DOUBLE, 6) AS score FROM h
""")
def hash_encoders(spark: SparkSession, base: str) -> DataFrame:
    shown = lambda v: F.array_join(F.transform(v, lambda x: F.round(x, 5).cast("decimal(9,5)").cast("string")), ",")
    return table(spark, base, "benchmark").select(
        "item_id", shown(vectors.padded_bytes(F.col("text"), 40)).alias("plain"),
        shown(vectors.counted_bytes(F.col("text"), 40)).alias("counted"),
        F.round(vectors.hash_score("license", F.col("text")), 6).alias("score"),
    )


# --- times and budgets -----------------------------------------------------------------------------

@query("""
WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS now, event_id % 24 AS h, event_id % 60 AS m, event_id % 4 AS kind FROM events),
d AS (SELECT *, now - now % 86400 - 86400 + h * 3600 + CASE WHEN kind = 2 THEN m * 60 ELSE 0 END AS start FROM e)
SELECT event_id, CASE kind WHEN 0 THEN now - 3600 WHEN 3 THEN NULL ELSE start END::BIGINT AS "start", CASE kind WHEN 0 THEN now WHEN 3 THEN NULL ELSE start + 3600 END::BIGINT AS "end",
  kind IN (0, 2) AS only_time, kind < 3 AS late FROM d
""")
def times_said(spark: SparkSession, base: str) -> DataFrame:
    """What queries said at each event's time mean, each by that time."""
    h, m = F.col("event_id") % 24, F.col("event_id") % 60
    half = F.when(h < 12, "am").otherwise("pm")
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    said = F.element_at(
        F.array(
            F.lit("last hour"), F.concat(F.lit("what was open yesterday "), twelve, half, F.lit("?")),
            F.format_string("at %d:%02d yesterday", h, m), F.concat(F.lit("notes of "), "event_type"),
        ),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    rows = table(spark, base, "events").select("event_id", said.alias("said"), F.date_trunc("second", "ts").alias("now"))
    found = when.said(F.col("said"), F.col("now"))
    return rows.select("event_id", found.alias("f")).select("event_id", "f.start", "f.end", "f.only_time", "f.late")



@query("""
SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 18:00:00' - INTERVAL 12 DAY AND length(props) <= 9
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 4
""")
def late_spans(spark: SparkSession, base: str) -> DataFrame:
    at = F.lit("2024-01-20 18:00:00").cast("timestamp")
    spans = when.late_eligible(table(spark, base, "events"), "user_id", "ts", "props", "value", "event_id", at, days=12, chars=9, most=4)
    return spans.select("event_id", "user_id")


@query("""
WITH e AS (SELECT event_id, 1500 - event_id * 37 % 1500 AS left_ms FROM events)
SELECT event_id, left_ms::INT AS left_ms, 'FAST' || CASE WHEN left_ms >= 180 THEN ',FUSION' ELSE '' END || CASE WHEN left_ms >= 200 THEN ',RERANK' ELSE '' END AS stages,
  CASE WHEN left_ms >= 200 THEN '' WHEN left_ms >= 180 THEN 'RERANK:budget' ELSE 'FUSION:budget,RERANK:budget' END AS reasons, CASE WHEN left_ms >= 750 THEN 24 ELSE 12 END AS k FROM e
""")
def budget_plans(spark: SparkSession, base: str) -> DataFrame:
    """The stages of a request for each event, by what earlier work has left of its time."""
    left = (F.lit(planner.TOTAL_MS) - F.col("event_id") * 37 % planner.TOTAL_MS).cast("int")
    rows = table(spark, base, "events").select("event_id", left.alias("left_ms"))
    stages, reasons = planner.stages_within(F.col("left_ms"))
    k = planner.size_within(F.col("left_ms"), planner.K_LEXICAL)
    return rows.select("event_id", "left_ms", F.array_join(stages, ",").alias("stages"), F.array_join(reasons, ",").alias("reasons"), k.alias("k"))



# --- evaluation ------------------------------------------------------------------------------------

_CASES = """
m AS (SELECT event_type AS variant, user_id % 3 AS run, round(avg((event_id % 4 > 0)::INT), 6) AS citation_coverage, round(avg((event_id % 3 > 0)::INT), 6) AS verifier_pass_rate,
  round(avg((event_id % 9 = 0)::INT), 6) AS refusal_rate, round(avg(value), 6) AS mean_latency_ms FROM events GROUP BY 1, 2)
"""


def _metrics(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id")
    cases = table(spark, base, "events").select(
        F.col("event_type").alias("variant"), (F.col("user_id") % 3).alias("run"), (i % 4 > 0).alias("cited"),
        (i % 3 > 0).alias("verified"), (i % 9 == 0).alias("refused"), F.col("value").alias("ms"),
    )
    return audit.eval_metrics(cases, "variant", "run")


@query(f"WITH {_CASES} SELECT * FROM m")
def eval_metrics(spark: SparkSession, base: str) -> DataFrame:
    return _metrics(spark, base)


@query(f"""
WITH {_CASES} SELECT variant, 'worst_case' AS mode, min(citation_coverage) AS citation_coverage, min(verifier_pass_rate) AS verifier_pass_rate, max(refusal_rate) AS refusal_rate, max(mean_latency_ms) AS mean_latency_ms FROM m GROUP BY 1
UNION ALL SELECT variant, 'mean', round(avg(citation_coverage), 6), round(avg(verifier_pass_rate), 6), round(avg(refusal_rate), 6), round(avg(mean_latency_ms), 6) FROM m GROUP BY 1
""")
def eval_repeats(spark: SparkSession, base: str) -> DataFrame:
    each = _metrics(spark, base)
    parts = [audit.over_repeats(each, mode, "variant").withColumn("mode", F.lit(mode)) for mode in ("worst_case", "mean")]
    return parts[0].unionByName(parts[1])


@query("""
WITH a AS (SELECT l_returnflag AS name, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS name, round(avg(l_quantity), 4) - CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 1 ELSE -1 END AS base FROM lineitem GROUP BY 1)
SELECT name, round(value - base, 4) AS delta, value - base > base * 0.1 AND value - base > 2 AS failed, value - base < 0 AS improved, value <= 30 AS quick FROM a JOIN b USING (name)
""")
def gate_checks(spark: SparkSession, base: str) -> DataFrame:
    now = table(spark, base, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    less = F.when(F.col("name") == "A", 8).when(F.col("name") == "N", 1).otherwise(-1)
    before = now.select("name", (F.col("value") - less).alias("value"))
    out = audit.gate(now, before, "name", 10, 2)
    return out.select("name", F.round("delta", 4).alias("delta"), "failed", "improved", audit.within_latency(F.col("value"), 15).alias("quick"))
