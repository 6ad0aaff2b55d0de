"""Queries over texts, names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import text as X
from veldt.operators import fuzzy
from veldt.operators import sets
from veldt.plans.registry import Registry
from veldt.sources import tables

R = Registry()

#: The rules whose patterns need no look-around, so that the SQL twin can run them as they are.
PLAIN = [r for r in X.SCRUB if "(?<" not in r[2] and "(?=" not in r[2] and r"\p" not in r[2]]


def _nest(rules) -> str:
    out = "text"
    for _, note, pattern in rules:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{note}', 'g')"
    return out


@R.query("pii_scrub_plain", f"SELECT doc_id, sha256({_nest(PLAIN)}) AS scrubbed, {_nest(PLAIN)} <> text AS changed FROM documents")
def _(t):
    clean, kinds = X.scrub(F.col("text"), PLAIN)
    return t("documents").select("doc_id", F.sha2(clean, 256).alias("scrubbed"), (F.size(kinds) > 0).alias("changed"))


@R.query("pii_scrub")
@R.query("pii_scrub_whole")
def _(t):
    clean, kinds = X.scrub(F.col("text"))
    return t("documents").select("doc_id", F.sha2(clean, 256).alias("scrubbed"), kinds.alias("kinds"))


@R.query("pii_scrub_conversations")
def _(t):
    clean, kinds = X.scrub(F.col("text"))
    return t("conversations").select("conv_id", "turn", clean.alias("text"), kinds.alias("kinds"))


@R.query("language_script", """
SELECT doc_id, length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')) AS latin, length(text) - length(regexp_replace(text, '[Ѐ-ӿ]', '', 'g')) AS cyrillic,
  CASE WHEN length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')) > 0 THEN 'latin' END AS script FROM documents
""")
def _(t):
    counts = X.script_counts(F.col("text"))
    return t("documents").select("doc_id", counts["latin"].alias("latin"), counts["cyrillic"].alias("cyrillic"), X.majority_script(F.col("text")).alias("script"))


@R.query("nfc_hash", "SELECT doc_id, sha256(nfc_normalize(text)) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(X.nfc(F.col("text")), 256).alias("h"))


@R.query("collapse_whitespace", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("h"))


@R.query("word_tokens", r"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)")
def _(t):
    w = X.word_list(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@R.query("word_frequencies", r"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY word")
def _(t):
    per = t("documents").select("doc_id", F.explode(X.word_list(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@R.query("provenance_check", r"""
WITH s AS (SELECT conv_id, turn, 'Says ' || CASE turn WHEN 0 THEN '[S1]' WHEN 1 THEN '[s2] [S2]' WHEN 2 THEN 'so [S9]' ELSE 'nothing' END AS st FROM conversations)
SELECT conv_id, turn, CASE turn WHEN 0 THEN NULL WHEN 1 THEN 'malformed [s2]' WHEN 2 THEN 'not issued [S9]' ELSE 'no tag at the end' END AS problem FROM s
""")
def _(t):
    said = F.concat(F.lit("Says "), F.when(F.col("turn") == 0, "[S1]").when(F.col("turn") == 1, "[s2] [S2]").when(F.col("turn") == 2, "so [S9]").otherwise("nothing"))
    return t("conversations").select("conv_id", "turn", X.tag_problem(said, F.array(F.lit("S1"), F.lit("S2"))).alias("problem"))


@R.query("template_expansion", """
SELECT sha256('Parts of ' || b.p_brand || ' in ' || n.n_name || '|' || r.r_name) AS query_key, 'Parts of ' || b.p_brand || ' in ' || n.n_name AS phrase, r.r_name AS filter
FROM (SELECT DISTINCT p_brand FROM part) b, nation n JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def _(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    brands = t("part").select("p_brand").distinct()  # slot values: as many as the vocabulary has
    phrase = F.concat(F.lit("Parts of "), F.col("p_brand"), F.lit(" in "), F.col("n_name"))
    grid = brands.crossJoin(F.broadcast(places))  # the product of the slots is the result asked for
    return grid.select(X.content_hash(phrase, F.col("r_name")).alias("query_key"), phrase.alias("phrase"), F.col("r_name").alias("filter"))


@R.query("json_slots_contain", """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k') = '9' AS has_nine FROM events
""")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), tables.contains_entries(F.col("props"), {"k": "9"}).alias("has_nine"))


@R.query("json_entries", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    return tables.json_entries(t("events"), "event_id", "props")


@R.query("json_parse_split", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_type = 'view' THEN 'empty' END AS problem FROM events) GROUP BY problem")
def _(t):
    raw = F.when(F.col("event_type") == "error", F.lit("{bad")).when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("props"))
    return tables.parse_json(t("events").select("event_id", raw.alias("raw")), "raw", "k int").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@R.query("name_parse", r"""
SELECT c_custkey, regexp_extract(c_name, '^(Customer)#0*([0-9]+)$', 2)::BIGINT AS number, c_mktsegment FROM customer WHERE regexp_matches(c_name, '^Customer#0*[0-9]+$')
""")
def _(t):
    good, _bad = tables.parse_names(t("customer"), "c_name", "(Customer)#0*([0-9]+)", ["kind", "number"])
    return good.select("c_custkey", F.col("number").cast("long").alias("number"), "c_mktsegment")


@R.query("containment_and_missing", """
SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'refund'], lambda x: NOT list_contains(k, x))), ',') AS missing, len(list_filter(['click', 'error'], lambda x: NOT list_contains(k, x))) = 0 AS has_both
FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY user_id)
""")
def _(t):
    seen = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    of = lambda *x: F.array(*[F.lit(v) for v in x])
    return seen.select(
        "user_id", F.array_join(sets.missing_of(of("click", "error", "purchase", "refund"), F.col("k")), ",").alias("missing"), (F.size(sets.missing_of(of("click", "error"), F.col("k"))) == 0).alias("has_both")
    )


@R.query("grid_disagreements", """
SELECT p_partkey, p_brand AS a, CASE WHEN p_size > 25 THEN lower(p_brand) ELSE p_brand END AS b FROM part WHERE p_size > 25
""")
def _(t):
    part = t("part").select("p_partkey", "p_brand", "p_size")
    second = part.withColumn("p_brand", F.when(F.col("p_size") > 25, F.lower("p_brand")).otherwise(F.col("p_brand")))
    return tables.disagreements(part, second, ["p_partkey"], "p_brand")


@R.query("nested_document", """
SELECT o_custkey, to_json({'customer': o_custkey, 'orders': list({'key': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)})::VARCHAR AS doc FROM orders GROUP BY o_custkey
""")
def _(t):
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    return rows.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("customer"), "orders")).alias("doc"))


@R.query("heading_lines", """
SELECT page_id, len(regexp_extract_all(html, '(?is)<(?:h[1-6]|p)\\b[^>]*>[^<]*')) AS n_parts, regexp_extract(html, '(?is)<h1\\b[^>]*>([^<]*)', 1) AS title FROM pages
""".replace("\\\\", "\\"))
def _(t):
    parts = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>[^<]*"), F.lit(0))
    return t("pages").select("page_id", F.size(parts).cast("long").alias("n_parts"), F.regexp_extract("html", r"(?is)<h1\b[^>]*>([^<]*)", 1).alias("title"))


@R.query("page_lines", r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:h[1-6]|p)\b[^>]*>[^<]*'), lambda x: {'level': coalesce(try_cast(regexp_extract(x, '(?i)^<h([1-6])', 1) AS INT), 0),
  'text': trim(regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))}), lambda s: s.text <> '') AS l FROM pages)
SELECT page_id, (i - 1)::INT AS line, l[i].level AS level, l[i].text AS text FROM p, unnest(range(1, len(l) + 1)) AS u(i)
""")
def _(t):
    return t("pages").select("page_id", F.posexplode(X.html_lines(F.col("html"))).alias("line", "x")).select("page_id", "line", "x.level", "x.text")


@R.query("sentence_counts", r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([.?!][)\]"\x27”’]*)(\s+\p{Lu})', '\1' || chr(1) || '\2', 'g'), '([\p{L})][.?!]\d[\d,–-]*)(\s+\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\S)(\s+•)', '\1' || chr(1) || '\2', 'g') AS m FROM documents)
SELECT doc_id, coalesce(len(list_filter(string_split(m, chr(1)), lambda x: regexp_replace(x, '^\s+', '') <> '')), 0) AS n_sentences FROM m WHERE m IS NOT NULL
""")
def _(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


@R.query("chunk_documents")
def _(t):
    return X.chunked(t("documents").select("doc_id", "text")).select("doc_id", F.posexplode("pieces").alias("chunk", "x")).select("doc_id", "chunk", "x.offset", "x.n_words", "x.text")


@R.query("fuzzy_search", """
SELECT p_partkey FROM part WHERE contains(lower(p_name), 'small') OR list_bool_or(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: levenshtein('small', w) <= 1 OR (length(w) > 5 AND levenshtein('small', substr(w, 1, 5)) <= 1)))
""")
def _(t):
    return t("part").where(X.fuzzy_match("small")("p_name")).select("p_partkey")


@R.query("fuzzy_join", """
WITH q AS (SELECT p_partkey AS query_id, regexp_extract_all(lower(substr(p_name, 1, 2) || substr(p_name, 4)), '[a-z0-9]+') AS ts FROM part WHERE p_partkey % 100 = 0), d AS (SELECT DISTINCT p_name, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS ws FROM part),
n AS (SELECT query_id, p_name FROM q, d WHERE len(ts) > 0 AND list_bool_and(list_transform(ts, lambda t: list_bool_or(list_transform(ws, lambda w: contains(w, t) OR (length(t) >= 4 AND length(w) >= length(t) - 1
  AND (damerau_levenshtein(t, substr(w, 1, length(t))) <= 1 OR (length(w) = length(t) + 1 AND damerau_levenshtein(t, w) <= 1))))))))
SELECT query_id, p_partkey FROM n JOIN part USING (p_name)
""")
def _(t):
    """Parts that are meant by the names of every hundredth part with its third letter lost; no word there has eight letters."""
    asked = t("part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.expr("concat(substr(p_name, 1, 2), substr(p_name, 4))").alias("q"))
    return fuzzy.fuzzy_join(t("part").select("p_partkey", "p_name"), asked, "p_partkey", "p_name", "query_id", "q")


@R.query("word_similarity", """
WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS a, regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9_]+') AS b FROM part)
SELECT p_partkey, round(2.0 * len(a) / (len(a) + len(b)), 6)::DOUBLE AS s FROM w
""")
def _(t):
    return t("part").select("p_partkey", F.round(X.similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("s"))


@R.query("canonical_json", "SELECT event_id, '{\"a\":' || event_id || ',\"b\":{\"k\":' || json_extract_string(props, '$.k') || '}}' AS doc FROM events")
def _(t):
    raw = F.concat(F.lit('{ "b" : '), F.col("props"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit(" }"))
    return t("events").select("event_id", X.canonical_json(raw).alias("doc"))
