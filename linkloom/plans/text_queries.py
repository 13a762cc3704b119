"""Queries of the text functions, sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths, topics
from linkloom.functions import text as t
from linkloom.operators import graph as g
from linkloom.operators import search
from linkloom.sources import articles as src
from linkloom.sources import asset_sink, html, multistream, store, title_index

from .fixtures import sql_unit, table

Q, SQL = {}, {}
#: Documents with markup: the first word of every sentence but the first is a link; every third text begins with a link to
#: a page that is no article and one with an anchor and a fragment.
MARKED = r"marked AS (SELECT doc_id, 'D' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN '[[Module:M]] [[user:Lower#a|their page]] ' ELSE '' END || regexp_replace(text, '([.!?]\s+)([A-Za-z]+)', '\1[[\2]]', 'g') AS text, lang, source FROM documents)"
_META = " OR ".join(f"starts_with(x, '{p}')" for p in ("Category:", "File:", "Image:", "Talk:", "Wikipedia:", "Portal:", "Help:", "Template:", "Special:", "MediaWiki:", "Module:"))


def sql_targets(text: str, meta: str = _META) -> str:
    return rf"list_distinct(list_transform(list_filter(list_transform(list_filter(list_transform(regexp_extract_all({text}, '\[\[([^\]]+)\]\]', 1), lambda x: trim(split_part(x, '|', 1))), lambda x: NOT ({meta})), lambda x: trim(split_part(x, '#', 1))), lambda x: x <> ''), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)))"


def sql_replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def sql_cleaned(text: str) -> str:
    return sql_replaced(text, *[(x, "") for x in (r"(?s)<!--.*?-->", r"(?s)<ref[^>/]*>.*?</ref>", r"<ref[^>]*/>", r"<[^>]+>", r"(?s)\{\|.*?\|\}", *[r"\{\{[^{}]*\}\}"] * 3)])


def sql_stripped(text: str) -> str:
    return sql_replaced(text, ("''{2,}", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", r"\1"), (r"\[\[([^\]]*)\]\]", r"\1"))


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql.replace("MARKED", f"WITH {MARKED}")
        return f

    return put


def marked(s, d):
    head = F.when(F.col("doc_id") % 3 == 0, "[[Module:M]] [[user:Lower#a|their page]] ").otherwise("")
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("D"), "doc_id").alias("title"), F.concat(head, F.regexp_replace("text", r"([.!?]\s+)([A-Za-z]+)", "$1[[$2]]")).alias("text"), "lang", "source")


def docs(s, d):
    return table(s, d, "documents")


def pages(s, d):
    return table(s, d, "pages")


def sql_sentences(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


SENT = sql_sentences("text")


def linked_pages(s, d):
    """Pages with a link at the beginning of every paragraph."""
    return pages(s, d).withColumn("html", F.regexp_replace("html", r"<p>(\p{L}+)", '<p><a href="/$1_page">$1</a>'))

# ---- sources
def _plain(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


query("s5_page_parse", "SELECT page_id, " + ", ".join(_plain(f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)") + f" AS {name}" for tag, name in (("title", "title"), ("h1", "h1"))) + " FROM pages")(lambda s, d: src.page_head(pages(s, d)))


def view_lines(s, d):
    p = table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    who = F.when(F.col("l_returnflag") == "R", "de").when(F.col("l_returnflag") == "A", "en.wikipedia").otherwise("en")
    count = F.when(F.col("l_partkey") % 11 == 0, "bad").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return p.select(F.concat_ws(" ", who, F.concat(F.lit("Part_no_"), "l_partkey"), count, F.lit("0")).alias("value"))


#: Characters that XML forbids are left out, ends of lines are as its readers give them.
_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def packed_dump(s, d):
    """Documents as a dump of many bzip2 streams of 50 pages each in one file; every tenth is in another namespace."""
    path = g.scratch_path(s, "dump")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _XML, ""), r"\r\n?", "\n")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    page = F.concat(F.lit("<page><title>D"), "doc_id", F.lit("</title><ns>"), F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0), F.lit("</ns><revision><text>"), text, F.lit("</text></revision></page>\n"))
    rows = src.numbered(docs(s, d).select("doc_id", page.alias("page")), F.col("doc_id"), "place")
    streams = rows.groupBy(F.floor(F.col("place") / 50).alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "page"))), lambda x: x["page"]), "").alias("text"))
    asset_sink.write_asset(multistream.compressed(streams), "blobs", path)
    return multistream.read_dump(s, path, 256 << 10)


query("s2b_multistream", r"""SELECT title, n, md5(text) AS hash FROM (SELECT 'D' || doc_id AS title, text, length(text) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\r\n?', chr(10), 'g') AS text FROM documents) WHERE doc_id % 10 <> 0) WHERE text <> ''""")(
    lambda s, d: packed_dump(s, d).select("title", F.length("text").cast("long").alias("n"), F.md5("text").alias("hash")))
query("s6_pageviews_max", "SELECT 'Part no ' || l_partkey AS title, CAST(max(l_quantity) AS BIGINT) AS views FROM lineitem WHERE l_returnflag = 'N' AND l_partkey % 11 <> 0 GROUP BY 1")(lambda s, d: src.pageviews(view_lines(s, d), "max"))
query("s7_pageviews_sum", "SELECT 'Part no ' || l_partkey AS title, CAST(sum(l_quantity) AS BIGINT) AS views FROM lineitem WHERE l_returnflag IN ('N', 'A') AND l_partkey % 11 <> 0 GROUP BY 1")(lambda s, d: src.pageviews(view_lines(s, d), "sum"))
query("s10_type_labels", "SELECT c_custkey AS id, coalesce(r_name, 'Other') AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 3 LEFT JOIN region ON r_regionkey = n_regionkey")(
    lambda s, d: src.type_labels(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key")), table(s, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("type")), table(s, d, "region").select(F.col("r_regionkey").alias("type"), F.col("r_name").alias("label"))))
query("s13_metadata_sorted", "SELECT p_partkey AS id, p_size AS views FROM part ORDER BY id")(lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("views")).orderBy("id"))
_DRAWN = sql_unit("(src * 64 + i)", 4)
query("s21_synthetic_graph", f"WITH n AS (SELECT count(*) AS n FROM part), b AS (SELECT id AS src, 5 + CAST(floor({sql_unit('id', 3)} * 46) AS BIGINT) AS k FROM (SELECT unnest(range(1, n + 1)) AS id FROM n)), r AS (SELECT src, unnest(range(1, k + 1)) AS i FROM b) SELECT src, tgt FROM (SELECT src, CAST(floor({_DRAWN} * {_DRAWN} * {_DRAWN} * n) AS BIGINT) + 1 AS tgt FROM r, n) WHERE src <> tgt")(
    lambda s, d: src.synthetic_links(s, table(s, d, "part").count(), 3))

# ---- sinks
query("k1_upsert", "SELECT o_custkey AS title, max_by(o_totalprice, o_orderkey) AS views FROM orders GROUP BY 1")(lambda s, d: src.upsert(table(s, d, "orders").select(F.col("o_custkey").alias("title"), F.col("o_totalprice").alias("views"), F.col("o_orderkey").alias("seq")), "title", "seq").drop("seq"))


def merged_events(s, d):
    """The last event of each user, upserted in four batches out of order, one of them twice, with a compaction between."""
    out = store.MergedTable(s, g.scratch_path(s, "store"), "user_id", "event_id")
    events = table(s, d, "events").select("user_id", "event_id", "event_type", "value")
    for batch, k in enumerate((2, 0, 0, 3, 1)):
        out.upsert(events.where(F.col("event_id") % 4 == k), "events", batch - (batch > 1))
        if batch == 2:
            out.compact()
    return out.read()


query("k1b_merge_on_read", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")(merged_events)
query("k2_insert_ignore", "SELECT c_custkey AS title, c_acctbal AS views FROM customer UNION ALL SELECT DISTINCT o_custkey + 100000, 0.0 FROM orders WHERE o_custkey + 100000 NOT IN (SELECT c_custkey FROM customer)")(
    lambda s, d: src.insert_ignore(table(s, d, "customer").select(F.col("c_custkey").alias("title"), F.col("c_acctbal").alias("views")), table(s, d, "orders").select((F.col("o_custkey") + 100000).alias("title"), F.lit(0.0).alias("views")), "title"))
query("k3_update_views", "SELECT c_custkey AS title, CASE WHEN v > 0 THEN v ELSE c_acctbal END AS views FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) - 300000 AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")(
    lambda s, d: src.update_views(table(s, d, "customer").select(F.col("c_custkey").alias("title"), F.col("c_acctbal").alias("views")), table(s, d, "orders").groupBy(F.col("o_custkey").alias("title")).agg((F.max("o_totalprice") - 300000).alias("views"))))
query("k5_token_index", r"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_partkey), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS token FROM part) GROUP BY 1")(
    lambda s, d: table(s, d, "part").select(F.explode(F.array_distinct(t.tokens(F.concat_ws(" ", "p_name", "p_partkey")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
query("k11_weighted_text", "SELECT l_orderkey AS source, l_partkey AS target, printf('%.3f', l_discount + 1.0) AS weight FROM lineitem")(
    lambda s, d: src.weighted_lines(table(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_discount") + 1.0).alias("weight"))))
query("k12_metadata_filled", "SELECT id, coalesce(p_size, 0) AS views, CASE WHEN p_partkey IS NULL THEN 6 ELSE 1 END AS category FROM (SELECT unnest(range((SELECT max(p_partkey) + 1 FROM part))) AS id) LEFT JOIN part ON p_partkey = id AND p_partkey % 3 <> 0")(
    lambda s, d: src.filled_metadata(s, table(s, d, "part").agg(F.max("p_partkey")).first()[0] + 1, table(s, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("views"), F.lit(1).alias("category"))))
query("k13_topic_json", """WITH w AS (SELECT p_type AS topic, list_sort(list_distinct(list(p_name))) AS words FROM part GROUP BY 1), j AS (SELECT *, '["' || array_to_string(words, '","') || '"]' AS json FROM w), t AS (SELECT sum(strlen(json)) AS b FROM j)
 SELECT topic, CASE WHEN b > 150000 THEN '["' || array_to_string(words[1:12], '","') || '"]' ELSE json END AS json FROM j, t""")(lambda s, d: src.sized_json(table(s, d, "part").select(F.col("p_type").alias("topic"), F.col("p_name").alias("word")), 150_000, 12))

# ---- predicates
#: Documents as crawled articles: all but every seventh crawled, some without snippet, categories or contexts.
ARTICLES = "SELECT doc_id AS id, doc_id % 7 <> 0 AS crawled, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 1, 40) END AS snippet, CASE doc_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN NULL ELSE '[\"x\"]' END AS categories, CASE WHEN doc_id % 4 <> 0 THEN '{}' END AS link_contexts FROM documents"


def crawled(s, d):
    return docs(s, d).selectExpr(*[x + " AS " + n for x, n in (("doc_id", "id"), ("doc_id % 7 <> 0", "crawled"), ("CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 1, 40) END", "snippet"), ("CASE doc_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN NULL ELSE '[\"x\"]' END", "categories"), ("CASE WHEN doc_id % 4 <> 0 THEN '{}' END", "link_contexts"))])


query("f7_incomplete", f"SELECT id FROM ({ARTICLES}) WHERE crawled AND (snippet IS NULL OR trim(snippet) = '' OR categories IS NULL OR categories IN ('', '[]'))")(lambda s, d: search.incomplete_articles(crawled(s, d)).select("id"))
query("f8_repair_set", f"SELECT id FROM ({ARTICLES}) WHERE crawled AND link_contexts IS NULL ORDER BY id LIMIT 50")(lambda s, d: search.repair_set(crawled(s, d), 50).select("id"))
query("f9_token_prefix", r"SELECT p_partkey AS idx FROM part WHERE len(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 's'))) > 0 ORDER BY idx LIMIT 10")(
    lambda s, d: search.token_search(table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("title")), "s").select("idx"))
PARTS = "SELECT p_partkey AS idx, p_name || ' #' || p_partkey AS title FROM part"


def titles(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.concat("p_name", F.lit(" #"), "p_partkey").alias("title"))


query("f10_prefix_search", f"SELECT idx, title FROM ({PARTS}) WHERE starts_with(lower(title), 's') ORDER BY lower(title), idx LIMIT 8")(lambda s, d: search.prefix_search(titles(s, d), "s"))
query("f11_two_prefixes", f"SELECT idx, title FROM ((SELECT * FROM ({PARTS}) WHERE title >= 's' AND title < 't' ORDER BY title LIMIT 8) UNION (SELECT * FROM ({PARTS}) WHERE title >= 'S' AND title < 'T' ORDER BY title LIMIT 8)) ORDER BY title LIMIT 8")(lambda s, d: search.cased_prefix_search(titles(s, d), "s"))
#: Titles of which some have capitals and diacritics.
ACCENTED = "SELECT p_partkey AS idx, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(replace(p_name, 'e', 'é'), 'o', 'ö') ELSE p_name END || ' #' || p_partkey AS title FROM part"


def accented(s, d):
    name = F.col("p_name")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).when(F.col("p_partkey") % 3 == 1, F.replace(F.replace(name, F.lit("e"), F.lit("é")), F.lit("o"), F.lit("ö"))).otherwise(name)
    return table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.concat(name, F.lit(" #"), "p_partkey").alias("title"))


def title_indexed(s, d):
    """A stored index over ACCENTED."""
    path = g.scratch_path(s, "titles")
    title_index.build(accented(s, d), path)
    return path


query("f9b_indexed_words", rf"SELECT idx FROM ({ACCENTED}) WHERE len(list_filter(string_split_regex(lower(strip_accents(title)), '[^\p{{L}}\p{{N}}]+'), lambda x: starts_with(x, 'col'))) > 0 AND len(list_filter(string_split_regex(lower(strip_accents(title)), '[^\p{{L}}\p{{N}}]+'), lambda x: starts_with(x, '1'))) > 0")(
    lambda s, d: title_index.word_search(s, title_indexed(s, d), "Cöl 1", None))
query("f10b_indexed_prefix", f"SELECT idx, title FROM ({ACCENTED}) WHERE starts_with(lower(strip_accents(title)), 'co') ORDER BY lower(strip_accents(title)), idx LIMIT 8")(lambda s, d: title_index.prefix_search(s, title_indexed(s, d), "Cö"))
query("f11b_indexed_top", f"SELECT word, count(*) AS n FROM (SELECT DISTINCT idx, unnest(list_filter(string_split_regex(lower(strip_accents(title)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM ({ACCENTED})) GROUP BY 1")(
    lambda s, d: title_index.stored(s, title_indexed(s, d), "words").groupBy("word").agg(F.count("*").alias("n")))
query("f12_resolve_title", f"SELECT idx FROM ({PARTS}) WHERE lower(title) = (SELECT lower(title) FROM ({PARTS}) WHERE idx = 42) ORDER BY title = (SELECT title FROM ({PARTS}) WHERE idx = 42) DESC, idx LIMIT 1")(lambda s, d: src.resolve_title(titles(s, d), titles(s, d).where("idx = 42").first().title))
TITLED = "CASE doc_id % 5 WHEN 0 THEN 'MediaWiki:' WHEN 1 THEN 'List of ' WHEN 2 THEN 'user:' WHEN 3 THEN 'Image:' ELSE '' END || source"
query("f13_meta_titles", f"SELECT doc_id, title, NOT ({_META.replace('(x,', '(title,')}) AS dumped FROM (SELECT doc_id, {TITLED} AS title FROM documents) WHERE NOT regexp_matches(title, '^(Special:|Wikipedia:|Portal:|Help:|File:|Category:|Talk:|Template:|User:|Draft:|MediaWiki:|Module:|Gadget:|Main Page|Deaths in |List of |Lists of )')")(
    lambda s, d: docs(s, d).select("doc_id", F.expr(TITLED).alias("title")).where(~t.starts_with_any(F.col("title"), t.META_CRAWL)).withColumn("dumped", ~t.starts_with_any(F.col("title"), t.META_DUMP)))
CATS = "list_value('Category:All ' || lang, 'Category:' || upper(source), 'Category:Use ' || lang)"


def cats(s, d):
    return docs(s, d).withColumn("cats", F.array(F.concat(F.lit("Category:All "), "lang"), F.concat(F.lit("Category:"), F.upper("source")), F.concat(F.lit("Category:Use "), "lang")))


query("f14_clean_categories", f"SELECT doc_id, array_to_string(list_transform(list_filter({CATS}, lambda x: NOT starts_with(x, 'Category:All ') AND NOT starts_with(x, 'Category:Use ')), lambda x: lower(x)), '|') AS cats FROM documents")(lambda s, d: cats(s, d).select("doc_id", F.array_join(t.clean_categories(F.col("cats")), "|").alias("cats")))
query("f15_clean_titles", rf"SELECT idx, title FROM ({PARTS}) WHERE length(title) <= 16 AND NOT regexp_matches(title, '(?i)\(disambiguation\)|^List of|\b\d{{4}}\b') AND NOT regexp_matches(title, '^\d+$')")(lambda s, d: titles(s, d).where(t.is_clean_title(F.col("title"))))
query("f16_near_duplicates", r"SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name < b.p_name AND (contains(lower(a.p_name), lower(b.p_name)) OR contains(lower(b.p_name), lower(a.p_name)) OR regexp_replace(lower(a.p_name), 's+$', '') = regexp_replace(lower(b.p_name), 's+$', ''))")(
    lambda s, d: t.near_duplicate_pairs(table(s, d, "part"), "p_name", ["p_brand"]))
query("f19_sentence_length", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({SENT}) AS x FROM documents) WHERE length(x) > 10 AND length(x) < 500 GROUP BY 1")(
    lambda s, d: docs(s, d).select("doc_id", F.explode(t.sentences(F.col("text"))).alias("x")).where((F.length("x") > 10) & (F.length("x") < 500)).groupBy("doc_id").agg(F.count("*").alias("n")))

# ---- markup
#: Markup put after every sentence of a text.
_MARKUP = '<ref name="x">a [[note]]</ref> {{t|a{{u|{{v}}}}}}<!-- a\nremark -->{| class="c"\n| cell |}<br/>'
WRAPPED = "regexp_replace(text, '([.!?]) ', '\\1" + _MARKUP.replace("\n", "' || chr(10) || '") + " ', 'g')"
query("t1_clean_wikitext", f"SELECT doc_id, length({sql_cleaned(WRAPPED)}) AS n, md5({sql_cleaned(WRAPPED)}) AS hash FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", t.clean_wikitext(F.regexp_replace("text", r"([.!?]) ", "$1" + _MARKUP + " ")).alias("c")).select("doc_id", F.length("c").alias("n"), F.md5("c").alias("hash")))
query("t2_link_targets", f"MARKED SELECT doc_id, array_to_string(list_sort({sql_targets('text')}), '|') AS targets FROM marked")(lambda s, d: marked(s, d).select("doc_id", F.array_join(F.array_sort(t.link_targets(F.col("text"))), "|").alias("targets")))
query("t4_sentences", f"SELECT doc_id, len({SENT}) AS n FROM documents")(lambda s, d: docs(s, d).select("doc_id", F.size(t.sentences(F.col("text"))).alias("n")))
query("t5_link_contexts", rf"""MARKED, c AS (SELECT title, {sql_cleaned('text')} AS text FROM marked), x AS (SELECT title, unnest({SENT}) AS s, generate_subscripts({SENT}, 1) AS pos FROM c),
 y AS (SELECT title, pos, unnest({sql_targets('s')}) AS target, trim(regexp_replace({sql_stripped('s')}, '\s+', ' ', 'g')) AS shown FROM x)
 SELECT title, target, min_by(shown, pos) AS context FROM y WHERE length(shown) > 10 AND length(shown) < 500 GROUP BY 1, 2""")(lambda s, d: t.link_contexts(marked(s, d).select("title", "text")))
_LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
query("t6_anchor_contexts", rf"""MARKED, c AS (SELECT title, list_filter({sql_sentences(sql_cleaned('substr(text, 1, 3000)'))}, lambda x: length(x) > 20 AND length(x) < 300) AS fit,
   list_slice(list_filter(regexp_extract_all(text, '{_LINK}'), lambda l: NOT ({_META.replace("(x,", "(substr(l, 3),")}) AND trim(split_part(regexp_extract(l, '{_LINK}', 1), '#', 1)) <> ''), 1, 50) AS links FROM marked),
 l AS (SELECT title, fit, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM c),
 n AS (SELECT title, fit, pos, trim(split_part(regexp_extract(link, '{_LINK}', 1), '#', 1)) AS to_, regexp_extract(link, '{_LINK}', 2) AS anchor FROM l),
 m AS (SELECT title, fit, pos, upper(substr(to_, 1, 1)) || substr(to_, 2) AS target, anchor FROM n),
 r AS (SELECT title, target, pos, list_filter(fit, lambda x: contains(x, CASE WHEN anchor <> '' THEN anchor ELSE target END))[1] AS s FROM m)
 SELECT title, target, max_by(trim(regexp_replace(s, '\s+', ' ', 'g')), pos) AS context FROM r WHERE s IS NOT NULL GROUP BY 1, 2""")(lambda s, d: t.anchor_contexts(marked(s, d).select("title", "text")))
query("t7_html_links")(lambda s, d: html.html_links(pages(s, d)))
query("t7b_html_contexts")(lambda s, d: html.html_contexts(linked_pages(s, d)))
query("t8_html_text")(lambda s, d: html.html_text(pages(s, d)))
query("t8b_html_full_contexts")(lambda s, d: html.html_full_contexts(linked_pages(s, d)))
query("t9_categories", r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(x, '\[\[Category:([^\]]+)\]\]', 1), lambda l: 'Category:' || trim(split_part(l, '|', 1))), '|') AS cats FROM (SELECT doc_id, regexp_replace(text, '([,;])\s+([A-Za-z]+)', '\1 [[Category: \2|x]] [[\2]]', 'g') AS x FROM documents)")(
    lambda s, d: docs(s, d).select("doc_id", F.array_join(t.categories_of(F.regexp_replace("text", r"([,;])\s+([A-Za-z]+)", "$1 [[Category: $2|x]] [[$2]]")), "|").alias("cats")))
query("t10_snippet", r"SELECT doc_id, CASE WHEN length(l) > 250 THEN substr(l, 1, 247) || '...' ELSE coalesce(l, '') END AS snippet FROM (SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS l FROM documents)")(lambda s, d: docs(s, d).select("doc_id", t.snippet(F.col("text")).alias("snippet")))
_REDIRECT = "CASE doc_id % 6 WHEN 0 THEN chr(10) || ' #Redirect [[' WHEN 1 THEN '#REDIRECT' WHEN 2 THEN '# redirect' WHEN 3 THEN 'x #redirect' ELSE '' END || coalesce(text, '')"
query("t11_redirects", f"SELECT doc_id, regexp_matches({_REDIRECT}, '(?i)^\\s*#redirect') AS redirect FROM documents")(lambda s, d: docs(s, d).select("doc_id", t.is_redirect(F.expr(_REDIRECT)).alias("redirect")))
query("t12_strip_markup", f"MARKED SELECT doc_id, md5({sql_stripped('text')}) AS h FROM marked")(lambda s, d: marked(s, d).select("doc_id", F.md5(t.strip_markup(F.col("text"))).alias("h")))
query("t13_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS h FROM pages")(lambda s, d: pages(s, d).select("page_id", F.md5(t.escape_html(F.col("html"))).alias("h")))
_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;')"
_MARK = r'<mark style="color:#ffcc00">\1</mark>'
query("t14_highlight", f"MARKED SELECT doc_id, regexp_replace({sql_stripped(_ESCAPED)}, '(the)', '{_MARK}', 'gi') AS shown FROM marked")(lambda s, d: marked(s, d).select("doc_id", t.highlight(F.col("text"), F.lit("the")).alias("shown")))
# ---- topics
#: Titles, categories and types of documents: the text's beginning; its language, its source and a word; one of some types.
_TITLE, _KIND = "substr(text, 1, 60)", "CASE doc_id % 9 WHEN 0 THEN 'Human being' WHEN 1 THEN 'web service' WHEN 2 THEN 'galaxy' WHEN 3 THEN 'civil war' WHEN 4 THEN 'temple' WHEN 5 THEN 'unheard of' END"
_CAT = "CASE doc_id % 8 WHEN 0 THEN 'Living people' WHEN 1 THEN 'Website founder' WHEN 2 THEN 'Dot-com towns' WHEN 3 THEN 'Video games' WHEN 4 THEN 'River islands' WHEN 5 THEN 'Machine software' ELSE 'Stub' END"


def topic_rows(s, d):
    return docs(s, d).selectExpr("doc_id", f"{_TITLE} AS title", f"array({_CAT}, lang, source) AS cats", f"{_KIND} AS kind")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {_quoted(w)})" for w in words) + ")"


def sql_scores(rows: str, scheme) -> str:
    """(doc_id, ord): the best topic of rows (doc_id, t, a), by counting each keyword in a join."""
    words = ", ".join(f"({i}, {_quoted(w)})" for i, (_, ws) in enumerate(scheme) for w in ws)
    return f"""hits AS (SELECT doc_id, ord, sum((length(a) - length(replace(a, word, ''))) // length(word) + CASE WHEN contains(t, word) THEN 5 ELSE 0 END) AS n
  FROM {rows} JOIN (VALUES {words}) AS k(ord, word) ON contains(a, word) GROUP BY 1, 2),
 best AS (SELECT doc_id, arg_max(ord, n * 10 - ord) AS ord FROM hits GROUP BY 1)"""


_IN = f"SELECT doc_id, lower({_TITLE}) AS t, lower({_TITLE} || ' ' || {_CAT} || ' ' || lang || ' ' || source) AS a, lower({_KIND}) AS kind FROM documents"
_BY_TYPE = " ".join(f"WHEN {sql_any('kind', ws)} THEN '{n}'" for n, ws in topics.TYPES)
_NAMES = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(topics.FULL))
query("t15_topics", f"""WITH d AS ({_IN}), {sql_scores("d", topics.FULL)}
 SELECT doc_id, CASE {_BY_TYPE} WHEN {sql_any("a", topics.FULL[0][1])} AND NOT {sql_any("a", topics.NO_PERSON)} THEN 'Biography & People' WHEN {sql_any("a", topics.WEBSITES)} THEN 'Other & General'
  ELSE CASE ord {_NAMES} ELSE 'Other & General' END END AS topic FROM d LEFT JOIN best USING (doc_id)""")(
    lambda s, d: topic_rows(s, d).select("doc_id", topics.classify(F.col("title"), F.col("cats"), F.col("kind")).alias("topic")))
query("t15b_type_topics", f"SELECT doc_id, CASE {_BY_TYPE} END AS topic FROM ({_IN})")(lambda s, d: topic_rows(s, d).select("doc_id", topics.type_topic(F.col("kind")).alias("topic")))
query("t16_topic_ids", f"WITH d AS (SELECT doc_id, lower({_TITLE}) AS t, lower({_TITLE} || ' ' || text) AS a FROM documents), {sql_scores('d', topics.FULL)} SELECT doc_id, coalesce(ord, 6) AS topic FROM d LEFT JOIN best USING (doc_id)")(
    lambda s, d: docs(s, d).select("doc_id", topics.topic_id(F.substring("text", 1, 60), F.array("text")).alias("topic")))
query("t17_short_topics", f"WITH d AS ({_IN}), {sql_scores('d', topics.SHORT)} SELECT doc_id, coalesce(ord, 6) AS topic FROM d LEFT JOIN best USING (doc_id)")(lambda s, d: topic_rows(s, d).select("doc_id", topics.topic_id(F.col("title"), F.col("cats"), topics.SHORT).alias("topic")))
query("t18_first_group", f"SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('c', ws)} THEN {i}" for i, (_, _, ws) in enumerate(topics.GROUPS)) + " END AS grp, CASE " + " ".join(f"WHEN {sql_any('c', ws)} THEN '{','.join(map(str, rgb))},0.9'" for _, rgb, ws in topics.GROUPS) + f" ELSE '0.3,0.3,0.3,0.2' END AS colour FROM (SELECT doc_id, lower({_CAT} || chr(10) || lang || chr(10) || source || chr(10) || text) AS c FROM documents)")(
    lambda s, d: docs(s, d).selectExpr("doc_id", f"array({_CAT}, lang, source, text) AS cats").select("doc_id", topics.colour_group(F.col("cats")).alias("grp"), F.array_join(topics.group_colour(F.col("cats")).cast("array<string>"), ",").alias("colour")))
GROUPS = (("metal", ("steel", "tin", "copper", "brass", "nickel")), ("big", ("large", "economy")), ("fine", ("polished", "burnished")))
query("t18b_own_groups", "SELECT p_partkey AS idx, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p_type || ' | ' || p_name), '{x}')" for x in w) + f" THEN '{n}'" for n, w in GROUPS) + " ELSE 'none' END AS grp FROM part")(
    lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("idx"), topics.first_keyword_group(F.array("p_type", "p_name"), GROUPS, "none").alias("grp")))
query("t19_topic_to_id", "SELECT n_nationkey AS k, CASE n_nationkey % 8 WHEN 7 THEN 6 ELSE n_nationkey % 8 END AS id FROM nation")(
    lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("k"), topics.id_of(F.element_at(F.array(*[F.lit(n) for n, _ in topics.FULL], F.lit("Other & General"), F.lit("x")), (F.col("n_nationkey") % 8 + 1).cast("int"))).alias("id")))
query("t21_json_lists", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE len(w) END AS n, CASE WHEN doc_id % 3 = 0 THEN '' ELSE array_to_string(w, '|') END AS words FROM (SELECT doc_id, string_split(text, ' ')[1:20] AS w FROM documents)")(
    lambda s, d: docs(s, d).select("doc_id", t.json_list(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("no json "), "text")).otherwise(F.to_json(F.slice(F.split("text", " "), 1, 20)))).alias("w")).select("doc_id", F.size("w").alias("n"), F.array_join("w", "|").alias("words")))
query("t23b_views", "SELECT o_orderkey AS k, CASE WHEN v >= 1000000 THEN printf('%.1f', floor(v / 100000.0 + 0.5) / 10) || 'M' WHEN v >= 1000 THEN printf('%.1f', floor(v / 100.0 + 0.5) / 10) || 'K' ELSE v::VARCHAR END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 50) AS v FROM orders)")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), maths.views_text(F.floor("o_totalprice") * (F.col("o_orderkey") % 50)).alias("shown")))
query("t23_duration", "SELECT event_id, CASE WHEN v < 1000 THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) || ' ms' ELSE printf('%.2f', floor(v / 10 + 0.5) / 100) || ' s' END AS shown FROM (SELECT event_id, value * 20 AS v FROM events)")(lambda s, d: table(s, d, "events").select("event_id", maths.duration_text(F.col("value") * 20).alias("shown")))
query("t24_last_month", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(date_trunc('month', CAST(o_orderdate AS DATE)) - INTERVAL 15 DAY, '%Y/%m') AS month FROM orders")(lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", t.last_full_month(F.col("day")).alias("month")))
query("t25_link_url", "SELECT p_partkey AS idx, '/wiki/' || replace(replace(p_name || ' #' || p_partkey, ' ', '%20'), '#', '%23') AS url FROM part")(lambda s, d: titles(s, d).select("idx", t.link_url(F.col("title")).alias("url")))
query("t20_text_classifier")(lambda s, d: src.train_topic_classifier(docs(s, d).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))))
query("a23_map_sum", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").select("user_id", F.aggregate(F.map_values(F.from_json("props", "map<string,bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("v")).groupBy("user_id").agg(F.sum("v").alias("total")))
query("j1_resolve_links", rf"""MARKED, raw AS (SELECT title AS source, unnest({sql_targets("text", "false")}) AS target FROM marked),
 n AS (SELECT title, row_number() OVER (ORDER BY title) - 1 AS idx FROM (SELECT source AS title FROM raw UNION SELECT target FROM raw WHERE length(target) > 3))
 SELECT a.idx AS src, b.idx AS tgt FROM raw JOIN n a ON a.title = source JOIN n b ON b.title = target""")(lambda s, d: src.resolve_marked(marked(s, d)))
query("o7_collated", f"SELECT title, row_number() OVER (ORDER BY lower(strip_accents(title))) - 1 AS place FROM ({ACCENTED})")(lambda s, d: src.numbered(accented(s, d).select("title"), F.collate("title", "UNICODE"), "place"))
