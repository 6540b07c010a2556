"""Ingestion over documents and pages: decoding, filters, chunks, changes, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions import text as T
from ..operators import catalogue, chunking, links
from ..operators.search import index_pass as one_pass
from ..sources import readers
from .guarding import references_sql
from .registry import query, table

LINES = r"regexp_split_to_array(coalesce(text, ''), '\r\n|[\r\n]')"
SPACED = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g'))"


@query(f"SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({LINES})) AS BIGINT) AS lines, round(avg(len(regexp_extract_all(text, '\\S+'))), 6) AS mean_words FROM documents GROUP BY ALL")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(T.lines(F.col("text")))).alias("lines"), F.round(F.avg(T.n_words(F.col("text"))), 6).alias("mean_words"))


@query(f"SELECT doc_id, len({LINES}) AS n_lines, contains(substring(coalesce(text, ''), 1, 8192), chr(0)) AS is_binary FROM documents")
def strict_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.lines(t)).alias("n_lines"), T.is_binary(t).alias("is_binary"))


@query(f"SELECT doc_id, CASE WHEN length({SPACED}) > 300 THEN left({SPACED}, 300) || '...' ELSE {SPACED} END AS preview FROM documents")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("""WITH h AS (SELECT doc_id, text, left(text, 2400) AS head, length(left(text, 2400)) - instr(reverse(left(text, 2400)), chr(10)) AS back FROM documents)
SELECT doc_id, length(CASE WHEN length(text) <= 2400 THEN text WHEN instr(head, chr(10)) > 0 AND back >= 1200 THEN left(head, back) ELSE head END) AS kept FROM h""")
def body_cuts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(T.body_cut(F.col("text"))).cast("long").alias("kept"))


def _quoted(pattern: str) -> str:
    """A pattern as an SQL string; what looks ahead there is read along, which no match of these begins with."""
    return "'" + pattern.replace("(?=", "(?:").replace("'", "''") + "'"


PLACE = f"""NOT ({' OR '.join(f"starts_with(lower(v), '{x}')" for x in fixed.PLACEHOLDER_STARTS)} OR contains(lower(v), 'changeme') OR trim(lower(v), 'x*.-_') = '')"""
_ASSIGNED = _quoted("(?i)" + fixed.ASSIGNED)


@query(rf"""WITH named AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, {_ASSIGNED}, 1), regexp_extract_all(text, {_ASSIGNED}, 2))) AS v, true AS quoted FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, {_ASSIGNED}, 3)), false FROM documents)
SELECT doc_id FROM named WHERE v <> '' AND {PLACE} AND (quoted OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[^0-9]') AND NOT regexp_matches(v, '[_.]')))
UNION SELECT doc_id FROM documents WHERE regexp_matches(text, {_quoted(fixed.KNOWN_FORMATS)})""")
def secret_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are held back because they look like they hold a secret."""
    return table(spark, d, "documents").where(T.holds_secret(F.col("text"))).select("doc_id")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dups_sha256(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("""WITH listing AS (SELECT doc_id, n_chars, sha256(text) AS sha FROM documents WHERE source <> 'src3'),
held AS (SELECT doc_id, CASE WHEN lang = 'de' THEN n_chars - 1 ELSE n_chars END AS n_chars, sha256(text) AS sha FROM documents WHERE lang <> 'fr')
SELECT doc_id, CASE WHEN h.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'vanished' WHEN l.n_chars = h.n_chars AND l.sha = h.sha THEN 'unchanged' ELSE 'changed' END AS outcome FROM listing l FULL JOIN held h USING (doc_id)""")
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    """A listing without one source against a catalogue without one language and with old sizes of another."""
    docs = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    held = docs.where("lang <> 'fr'").withColumn("n_chars", F.when(F.col("lang") == "de", F.col("n_chars") - 1).otherwise(F.col("n_chars")))
    return catalogue.diff(docs.where("source <> 'src3'"), held, "doc_id", ["n_chars", "sha"])


@query("""WITH held AS (SELECT doc_id, lang, n_chars FROM documents), fresh AS (SELECT doc_id, 'xx' AS lang, n_chars * 2 AS n_chars FROM documents WHERE lang = 'es')
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT * FROM fresh UNION ALL SELECT * FROM held WHERE doc_id NOT IN (SELECT doc_id FROM fresh)) GROUP BY ALL""")
def keyed_replace(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    fresh = held.where("lang = 'es'").select("doc_id", F.lit("xx").alias("lang"), (F.col("n_chars") * 2).alias("n_chars"))
    return catalogue.replaced(held, fresh, ["doc_id"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return catalogue.missing(table(spark, d, "documents"), made, "doc_id").select("doc_id")


# windows of 40 lines: sequential only where a blank line ends a window or starts the next, or the budget cuts it, so SQL has no simple form
@query()
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(table(spark, d, "documents"))


@query(f"SELECT doc_id, CAST(count(*) FILTER (trim(x, ' ' || chr(9) || chr(11) || chr(12)) <> '') AS BIGINT) AS n_lines FROM (SELECT doc_id, unnest({LINES}) AS x FROM documents) GROUP BY ALL HAVING n_lines > 0")
def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are not blank, as the chunks hold them: each exactly once."""
    body = F.explode(F.split("body", "\n", -1)).alias("x")
    return chunking.chunked(table(spark, d, "documents"), max_tokens=1 << 30).select("doc_id", body).groupBy("doc_id").agg(F.count_if(F.trim("x", F.lit(" \t\x0b\x0c")) != "").alias("n_lines")).where("n_lines > 0")


NOTES = "SELECT conv_id AS doc_id, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL"
FULL = r"trim(x, ' ' || chr(9) || chr(11) || chr(12)) <> ''"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown notes, a section for each turn."""
    said = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("t"))
    return turns.select("doc_id", F.array_join(F.col("t.said"), "\n\n").alias("text"), F.concat(F.lit("Conversation "), F.col("doc_id").cast("string")).alias("title"))


@query(f"WITH notes AS ({NOTES}) SELECT doc_id, CAST(count(*) FILTER ({FULL}) AS BIGINT) AS n_lines, true AS in_order, true AS fits FROM (SELECT doc_id, unnest({LINES}) AS x FROM notes) GROUP BY ALL")
def section_cover(spark: SparkSession, d: str) -> DataFrame:
    """Notes cut by their outline: every line that is not blank in one chunk, chunks in order, none over the budget unless marked."""
    from pyspark.sql.window import Window as W

    chunks = chunking.sectioned(_notes(spark, d), readers.outline, max_tokens=64)
    before = F.lag("end_line").over(W.partitionBy("doc_id").orderBy("ordinal"))
    lines = F.size(F.filter(F.split("body", "\n", -1), lambda x: F.trim(x, F.lit(" \t\x0b\x0c")) != ""))
    fits = F.col("cut") | (T.n_words(F.concat_ws(" ", "header", "body")) <= 62)
    marked = chunks.withColumn("ordered", F.coalesce(F.col("start_line") > before, F.lit(True))).withColumn("fits", fits)
    return marked.groupBy("doc_id").agg(F.sum(lines).alias("n_lines"), F.bool_and("ordered").alias("in_order"), F.bool_and("fits").alias("fits"))


@query(f"WITH notes AS ({NOTES}), l AS (SELECT doc_id, unnest({LINES}) AS x FROM notes) SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER ({FULL}) AS BIGINT) AS owned, CAST(count(*) FILTER (starts_with(x, '## ')) AS BIGINT) AS headings FROM l GROUP BY ALL")
def line_owners(spark: SparkSession, d: str) -> DataFrame:
    """For each line of a note the chunk that holds it."""
    notes = _notes(spark, d)
    lines = notes.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("line"), "x")
    own = chunking.owners(lines, chunking.sectioned(notes, readers.outline, max_tokens=64))
    full = F.trim("x", F.lit(" \t\x0b\x0c")) != ""
    return own.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(full & F.col("ordinal").isNotNull()).alias("owned"), F.count_if(F.col("x").startswith("## ") & F.col("ordinal").isNotNull()).alias("headings"))


# another way than the engine's: pieces between angle brackets in order, with the number of hidden elements that are open at each
@query(rf"""WITH cut AS (SELECT page_id, unnest(string_split('>' || regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<')) AS x, generate_subscripts(string_split('>' || regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<'), 1) AS i FROM pages),
tag AS (SELECT *, lower(regexp_extract(x, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, starts_with(x, '/') AS ends, x[instr(x, '>') + 1:] AS said FROM cut),
deep AS (SELECT *, sum(CASE WHEN name NOT IN {fixed.HIDDEN} THEN 0 WHEN ends THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM tag),
whole AS (SELECT page_id, string_agg(CASE WHEN name IN {fixed.BLOCKS} THEN chr(10) ELSE '' END || CASE WHEN depth = 0 THEN said ELSE '' END, '' ORDER BY i) AS t FROM deep GROUP BY page_id)
SELECT page_id, array_to_string(list_filter(list_transform(string_split({references_sql("t")}, chr(10)), lambda x: trim(regexp_replace(x, '[\s\v\x{{A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM whole""")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.visible(F.col("html")).alias("text"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href=["'']([^"''#]*)', 1)) AS target FROM pages)
SELECT target, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t WHERE target <> '' AND NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(target, '..') GROUP BY ALL""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "pages").select("page_id", F.explode(links.hrefs(F.col("html"))).alias("target"))
    return each.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(r"""WITH docs AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*\.([a-z]+)/', 1) AS source, page_id AS document, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS path FROM pages),
d AS (SELECT *, lower(path) AS whole, regexp_extract(lower(path), '^(.*/)?') AS folder, regexp_extract(lower(path), '([^/]*)$', 1) AS name FROM docs),
asked AS (SELECT h.source, h.document AS chunk, h.folder, 0 AS position, t.name AS key FROM d h JOIN d t ON t.document = h.document + 1
  UNION ALL SELECT h.source, h.document, h.folder, 1, regexp_extract(t.whole, '([^/]*/[^/]*)$', 1) FROM d h JOIN d t ON t.document = h.document + 1 WHERE contains(t.whole, '/')),
met AS (SELECT chunk, position, coalesce(
    (SELECT t.document FROM d t WHERE t.source = a.source AND position = 1 AND t.whole = a.key ORDER BY length(t.path), t.path, t.document LIMIT 1),
    (SELECT t.document FROM d t WHERE t.source = a.source AND (t.whole = a.key AND position = 0 OR ends_with(t.whole, '/' || a.key)) AND starts_with(t.whole, a.folder) ORDER BY length(t.path), t.path, t.document LIMIT 1),
    (SELECT t.document FROM d t WHERE t.source = a.source AND (t.whole = a.key AND position = 0 OR ends_with(t.whole, '/' || a.key)) ORDER BY length(t.path), t.path, t.document LIMIT 1)) AS document FROM asked a)
SELECT chunk, position, document, path FROM met JOIN docs USING (document) WHERE chunk <> document""")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Each page links by the last part, and by the last two, of the path of the page after it; pages of one top-level domain are a source."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), r"[?#].*$", "")
    docs = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+)/", 1).alias("source"), F.col("page_id").alias("document"), path.alias("path"), F.lit("page").alias("kind"))
    after = docs.select((F.col("document") - 1).alias("document"), F.split(F.lower("path"), "/").alias("parts"))
    tail = lambda n: F.struct(F.lit(n - 1).alias("position"), F.array_join(F.slice("parts", -n, n), "/").alias("key"))
    keys = F.explode(F.when(F.size("parts") > 1, F.array(tail(1), tail(2))).otherwise(F.array(tail(1))))
    asked = docs.join(after, "document").select("source", F.col("document").alias("chunk"), F.col("document").alias("linker"), F.lit("wikilink").alias("kind"), keys.alias("k")).select("source", "chunk", "linker", "kind", "k.*")
    return links.resolved(asked, docs)


@query(r"""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter(['email', 'address', 'shout'], lambda r: CASE r WHEN 'email' THEN regexp_matches(x, '(?i)[a-z0-9.]+@[a-z0-9.-]+') WHEN 'address' THEN regexp_matches(x, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') ELSE regexp_matches(x, '!!') END)) AS rule
  FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|[\r\n]')) AS x FROM documents)) GROUP BY ALL""")
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines that each of a set of private patterns meets."""
    rules = {"email": r"(?i)[a-z0-9.]+@[a-z0-9.-]+", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "shout": "!!"}
    x = table(spark, d, "documents").select(F.explode(T.lines(F.col("text"))).alias("x"))
    met = F.explode(F.filter(F.array(*[F.when(F.col("x").rlike(p), F.lit(n)) for n, p in rules.items()]), lambda r: r.isNotNull()))
    return x.select(met.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role AS header FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role""")
def consecutive_headers(spark: SparkSession, d: str) -> DataFrame:
    """Where the speaker changes: of neighbouring turns of one role only the first is headed."""
    by = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(by).alias("before"))
    return turns.where(~F.col("before").eqNullSafe(F.col("role"))).select("conv_id", "turn", F.col("role").alias("header"))


@query("""WITH held AS (SELECT doc_id, n_chars FROM documents WHERE lang <> 'fr'), listing AS (SELECT doc_id, CASE WHEN lang = 'es' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src3')
SELECT CASE WHEN h.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'vanished' WHEN l.n_chars = h.n_chars THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS n FROM listing l FULL JOIN held h USING (doc_id) GROUP BY ALL""")
def index_pass(spark: SparkSession, d: str) -> DataFrame:
    """The report of a pass over a listing without one source, where the texts of one language have grown and one language is new."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), "text")
    name = catalogue.recipe("lines", 256, 40)
    held = docs.where("lang <> 'fr'").select("doc_id", "size", "sha256", F.lit(name).alias("recipe"))
    chunks = chunking.chunked(docs.where("lang <> 'fr'"))
    listing = docs.where("source <> 'src3'").withColumn("size", F.when(F.col("lang") == "es", F.col("size") + 1).otherwise(F.col("size")))
    return one_pass(listing.select("doc_id", "size", "sha256", "text"), held, chunks, name)[2]
