"""Queries over pages, documents, chunks and the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import text as T
from windloom.operators import evidence, graph, ingest
from windloom.session import spread
from windloom.session import table as stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The stored table; one below a split over the cores, since most queries here are heavy for each text."""
    return spread(stored(spark, sf, name)) if name in ("documents", "pages_out") else stored(spark, sf, name)


#: Number of words between ASCII white space.
WORDS = r"len(regexp_extract_all({0}, '[^ \t\n\r\f]+'))"
SENTENCES = r"""
    facts AS (
        SELECT doc_id, lower(trim(source)) AS source, i - 1 AS pos, trim(p[i], chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS fact FROM (
            SELECT doc_id, source, p, unnest(range(1, len(p) + 1)) AS i FROM (
                SELECT doc_id, source, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)),
                    lambda x: len(regexp_extract_all(x, '[^ \t\n\r\f]+')) >= 6) AS p
                FROM documents)))
"""


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.facts(table(spark, sf, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "fact")


def sentence_split_protected(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(T.protected_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def text_quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages_out")
    return pages.select("page_id", F.explode(T.text_faults(F.col("text"))).alias("reason")).distinct()


REASONS = rf"""
    faults AS (
        SELECT DISTINCT page_id, source, unnest(list_filter([
            CASE WHEN w < 10 THEN 'few words' END,
            CASE WHEN len(regexp_extract_all(text, '[\x{{e000}}-\x{{f8ff}}]')) >= 10 THEN 'symbol glyphs' END,
            CASE WHEN len(regexp_extract_all(text, '\n')) > 0.5 * greatest(w, 1) THEN 'broken lines' END,
            CASE WHEN len(regexp_extract_all(text, '[∑∫√∂≈≠≤≥±∞∏÷]')) >= 20 THEN 'formula signs' END], lambda x: x IS NOT NULL)) AS reason
        FROM (SELECT *, {WORDS.format('text')} AS w FROM pages_out WHERE text IS NOT NULL))
"""


def quality_audit_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.audit(table(spark, sf, "pages_out"))


def table_validation(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages_out")
    entries = pages.select("page_id", F.posexplode("tables").alias("item", "t"))
    return entries.select("page_id", (F.col("item") + 1).cast("long").alias("item"), F.explode(T.table_faults(F.col("t"))).alias("reason")).distinct()


def clean_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts by their length and digest."""
    pages = table(spark, sf, "pages_out").select("page_id", T.clean_pdf_text(F.col("text")).alias("t")).filter("t is not null")
    return pages.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest")).distinct()


def ocr_pipe_clean(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages_out").filter(F.col("text").contains("|"))
    return pages.select("page_id", F.md5(T.clean_ocr_pipes(F.col("text"))).alias("digest")).distinct()


def collapse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", T.collapse_repeats(F.col("text")).alias("t"))
    return docs.filter("t <> text").select("doc_id", (F.length("text") - F.length("t")).alias("dropped"))


def keyword_extract(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


def markdown_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of every valid table row: rows, cells and empty cells of each entry."""
    pages = table(spark, sf, "pages_out").select("page_id", F.posexplode("tables").alias("item", "t"))
    rows = F.filter(T.markdown_lines(F.col("t")), lambda x: ~T.is_rule(x))
    cells = F.flatten(F.transform(rows, T.markdown_cells))
    return pages.select(
        "page_id", (F.col("item") + 1).cast("long").alias("item"), F.size(rows).cast("long").alias("n_rows"), F.size(cells).cast("long").alias("n_cells"),
        F.size(F.filter(cells, lambda c: c.isin(*T.EMPTY_CELLS))).cast("long").alias("n_empty"),
    ).distinct()


def chunk_children(spark: SparkSession, sf: str) -> DataFrame:
    got = ingest.chunks(table(spark, sf, "documents"), "doc_id", "text", 300, 420, 2)
    return got.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n_words"), F.md5("text").alias("digest"))


def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    got = ingest.chunks(table(spark, sf, "documents"), "doc_id", "text", 1200, 1500, 1)
    return got.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n_words"), F.md5("text").alias("digest"))


def child_parent_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """How many distinct chunks have a parent that is a chunk's parent of the same page, by type."""
    chunks = table(spark, sf, "chunk_meta").distinct()
    parents = chunks.filter("type = 'text'").select("source", "page", F.col("parent_id").alias("p")).distinct()
    c, p = chunks.alias("c"), parents.alias("p")
    joined = c.join(p, (F.col("c.parent_id") == F.col("p.p")) & F.col("c.source").eqNullSafe(F.col("p.source")), "left")
    return joined.groupBy("c.source", "c.type").agg(F.count_distinct("c.child_id").alias("n_chunks"), F.count_distinct(F.when(F.col("p").isNotNull(), F.col("c.child_id"))).alias("n_with_parent")).select("source", "type", "n_chunks", "n_with_parent")


def pages_without_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages_out")
    return pages.join(table(spark, sf, "chunk_meta").select("source", "page").distinct(), ["source", "page"], "left_anti").select("page_id").distinct()


def group_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and sources of each group."""
    chunks = table(spark, sf, "chunk_meta").distinct()
    return chunks.groupBy("group_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("source").alias("n_sources"), F.count_if(F.col("type") == "table").alias("n_tables"))


def registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.registry_upsert(table(spark, sf, "processed_files"))


def registry_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Contents registered under more than one name."""
    files = table(spark, sf, "processed_files").filter("sha256 is not null")
    return files.groupBy("sha256").agg(F.count_distinct("filename").alias("n_names"), F.min("filename").alias("first_name")).filter("n_names > 1")


def content_hash_new_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose text no earlier loaded page had."""
    pages = table(spark, sf, "pages_out").filter("text is not null").select("page_id", "loaded_at", F.sha2("text", 256).alias("sha256"))
    return pages.groupBy("sha256").agg(F.min(F.struct("loaded_at", "page_id")).alias("f")).select(F.col("f.page_id").alias("page_id"), "sha256")


def unregistered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of pages that the registry doesn't know, with their distinct pages."""
    known = table(spark, sf, "processed_files").select(F.col("filename").alias("source")).distinct()
    return table(spark, sf, "pages_out").join(known, "source", "left_anti").groupBy("source").agg(F.count_distinct("page_id").alias("n_pages"))


def purge_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks left when files without a known hash are purged."""
    latest = ingest.registry_upsert(table(spark, sf, "processed_files"))
    gone = latest.filter("sha256 is null").select(F.col("filename").alias("source"))
    return ingest.purge(table(spark, sf, "chunk_meta").distinct(), gone).groupBy("source").agg(F.count("*").alias("n_chunks"))


def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = evidence.distinct_facts(evidence.facts(table(spark, sf, "documents")))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "fact")


def word_budget_summary(spark: SparkSession, sf: str) -> DataFrame:
    got = evidence.word_budget(evidence.facts(table(spark, sf, "documents")).filter("source is not null"))
    return got.select("source", "doc_id", F.col("pos").cast("long").alias("pos"), F.col("words").cast("long").alias("words"))


def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.citation_numbers(evidence.facts(table(spark, sf, "documents")))


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.contradictions(evidence.facts(table(spark, sf, "documents")))


def contradiction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar statements of which one is negated; ``contradictions`` has only those that are equal but for negations and numbers."""
    return evidence.contradiction_pairs(evidence.facts(table(spark, sf, "documents")))


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mentions(table(spark, sf, "documents"))


def entity_degrees(spark: SparkSession, sf: str) -> DataFrame:
    got = graph.mentions(table(spark, sf, "documents"))
    return got.groupBy("entity").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_mentions")).filter("n_docs > 1")


def question_type(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by the kind of question they hold."""
    return table(spark, sf, "documents").groupBy(T.question_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n_docs"))


def bullet_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.bullet_points(F.col("text")).alias("bullets"))


def plain_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of five and more words without markup, and how many."""
    got = T.plain_sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(got).cast("long").alias("n"), F.md5(F.array_join(got, "\n")).alias("digest")).filter("n > 0")


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The first 80 words and the first 600 characters of each text, cut where it is longer."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.excerpt(t, words=80)).alias("spoken"), F.md5(T.excerpt(t, chars=600)).alias("shown")).filter("shown is not null")


def term_statements(spark: SparkSession, sf: str) -> DataFrame:
    """What the texts say of the wing, from the word to the next full stop."""
    return table(spark, sf, "documents").select("doc_id", F.explode(T.statements_of(F.lower("text"), "wing")).alias("statement")).groupBy("statement").agg(F.count("*").alias("n"))


def gfm_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables found again in the Markdown of a page (text and tables in one), and what is left without them."""
    markdown = F.concat_ws("\n\n", F.array(F.coalesce("text", F.lit(""))), F.col("tables"))
    pages = table(spark, sf, "pages_out").select("page_id", markdown.alias("m")).filter("m like '%|%'").distinct()
    found = T.markdown_tables(F.col("m"))
    return pages.select("page_id", F.size(found).cast("long").alias("n_tables"), F.md5(F.array_join(found, "\n\n")).alias("tables"), F.md5(T.without_tables(F.col("m"))).alias("rest"))


def audit_groups(spark: SparkSession, sf: str) -> DataFrame:
    """How many faults of texts and tables there are in each group of reasons."""
    pages = table(spark, sf, "pages_out")
    texts = pages.select("page_id", F.lit(0).alias("item"), F.explode(T.text_faults(F.col("text"))).alias("reason"))
    entries = pages.select("page_id", F.posexplode("tables").alias("k", "t"))
    faults = texts.unionByName(entries.select("page_id", (F.col("k") + 1).alias("item"), F.explode(T.table_faults(F.col("t"))).alias("reason"))).distinct()
    return faults.groupBy(T.reason_group(F.col("reason")).alias("reason_group")).agg(F.count("*").alias("n"))


def new_registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the last third of the registry whose content none before had, under any name."""
    files = table(spark, sf, "processed_files")
    since = F.lit("2024-01-01").cast("timestamp_ntz")
    return ingest.not_registered(files.filter(F.col("registered_at") >= since), files.filter(F.col("registered_at") < since)).select("filename", "sha256").distinct()


def sentence_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence with the source where it occurs first."""
    return evidence.first_sources(evidence.facts(table(spark, sf, "documents"), 5)).groupBy("source").agg(F.count("*").alias("n_sentences"))


def registry_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The registry with later entries of a file over earlier ones, keys of either side kept."""
    files = table(spark, sf, "processed_files").filter("sha256 is not null")
    half = F.pmod(F.col("n_pages"), F.lit(2))
    one = lambda k: files.filter(half == k).groupBy("filename").agg(F.max("sha256").alias("value"))
    return evidence.merge_right(one(0), one(1), "filename")


def chunk_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk with the topic of its group, which is the group's commonest source; empty where there is none."""
    chunks = table(spark, sf, "chunk_meta").distinct()
    per = chunks.filter("group_id is not null and source is not null").groupBy("group_id", "source").agg(F.count("*").alias("n"))
    topics = per.groupBy("group_id").agg(F.max_by("source", F.struct("n", "source")).alias("topic"))
    return chunks.join(topics, "group_id", "left").select("child_id", F.coalesce("group_id", F.lit("")).alias("group_id"), F.coalesce("topic", F.lit("")).alias("topic")).distinct()


def group_references(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct chunks that refer to each group: a reference given twice counts once."""
    return table(spark, sf, "chunk_meta").groupBy("group_id").agg(F.count_distinct("child_id").alias("n_chunks"), F.count("*").alias("n_references"))


def clean_query_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean_query(F.col("text")).alias("query"))


def intent_router(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.intent(F.col("text")).alias("intent"))


def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How each page would be read: blank, table, sparse or text."""
    pages = table(spark, sf, "pages_out")
    words = F.coalesce(F.size(T.white_split(F.col("text"))), F.lit(0))
    tables = F.coalesce(F.size("tables"), F.lit(0))
    kind = F.when((words == 0) & (tables == 0), "blank").when((tables > 0) & (words < 50), "table").when(words < 10, "sparse").otherwise("text")
    return pages.select("page_id", kind.alias("kind")).distinct()


def reference_lists(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.reference_lists(evidence.facts(table(spark, sf, "documents")))


def quantity_values(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.quantity_values(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_split_protected, text_quality_reasons, quality_audit_by_source, table_validation, clean_page_text, ocr_pipe_clean,
        collapse_repeats, keyword_extract, markdown_table_cells, chunk_children, chunk_parents, child_parent_lookup, pages_without_chunks, group_topics,
        registry_latest, registry_aliases, content_hash_new_pages, unregistered_sources, purge_sources, fact_dedup, word_budget_summary, citation_numbers,
        contradictions, contradiction_pairs, bullet_points, plain_sentences, excerpts, term_statements, gfm_tables, audit_groups, new_registrations,
        sentence_sources, registry_merge, chunk_topics, group_references, entity_mentions, entity_degrees, question_type, clean_query_text, intent_router, page_kinds, reference_lists, quantity_values,
    )
}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_SETTING = ", ".join(f"'{w}'" for w in T.SETTING_WORDS)
_OPPOSING = ", ".join("'" + w.replace("'", "''") + "'" for w in evidence.OPPOSING)
_NEGATIONS = ", ".join(f"'{w}'" for w in evidence.NEGATIONS)
_ROWS = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|') AND NOT regexp_matches(x, '^\\|[-| :]+\\|$'))"
_CELLS = "flatten(list_transform({0}, lambda x: list_transform(string_split(regexp_replace(regexp_replace(x, '^\\|[ ]*', ''), '[ ]*\\|$', ''), '|'), lambda c: trim(c))))"
_ENTRIES = "SELECT DISTINCT page_id, i AS item, tables[i] AS t FROM (SELECT page_id, tables, unnest(range(1, len(tables) + 1)) AS i FROM pages_out WHERE tables IS NOT NULL)"
_WORD_LIST = "regexp_extract_all(lower(fact), '[\\p{L}\\p{N}]+')"
_MENTIONS = """
    found AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+ [0-9]{1,3}\\b')) AS entity FROM documents),
    mentions AS (SELECT doc_id, entity, count(*) AS n FROM found WHERE length(entity) BETWEEN 4 AND 100
        AND len(list_filter(string_split(entity, ' '), lambda w: length(w) >= 3)) > 0 GROUP BY ALL)
"""
_LATEST = "SELECT filename, r.sha256 AS sha256, r.n_pages AS n_pages, r.registered_at AS registered_at FROM (SELECT filename, max(struct_pack(registered_at := registered_at, sha256 := coalesce(sha256, ''), n_pages := coalesce(n_pages, -1))) AS r FROM processed_files GROUP BY filename)"

_CLEANED = "lower(text)"
for _opening in T.OPENINGS:
    _CLEANED = f"regexp_replace({_CLEANED}, '{_opening}', '', 'g')"
_INTENT = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in T.INTENTS)
_KIND = " ".join(f"WHEN regexp_matches(lower(text), '\\b(?:{'|'.join(words)})\\b') THEN '{kind}'" for kind, words in T.QUESTION_WORDS.items())
_GROUP = " ".join(f"WHEN contains(reason, '{part}') THEN '{name}'" for part, name in T.REASON_GROUPS)


def _split(least: int) -> str:
    """Sentences of a text of so many words as a list ``p``, by document."""
    return SENTENCES.replace(">= 6", f">= {least}").replace("facts AS", "split AS")


_PROTECTED = rf"""
    guarded AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b({'|'.join(T.ABBREVIATIONS)}|[A-Za-z](?:\.[A-Za-z])+)\.', '\1' || chr(2), 'g'),
        '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g') AS g FROM documents WHERE text IS NOT NULL),
    parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(g, '([.!?])[ \t\n\r\f]+([\p{{Lu}}\p{{N}}])', '\1' || chr(1) || '\2', 'g'), chr(1)),
        lambda x: trim(replace(x, chr(2), '.'))), lambda x: len(regexp_extract_all(x, '[^ \t\n\r\f]+')) >= 5) AS p FROM guarded),
    cut AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN len(regexp_extract_all(x, '[^ \t\n\r\f]+')) > 420
        THEN list_transform(range(0, (len(regexp_extract_all(x, '[^ \t\n\r\f]+')) + 419) // 420), lambda k: array_to_string(regexp_extract_all(x, '[^ \t\n\r\f]+')[k * 420 + 1:(k + 1) * 420], ' ')) ELSE [x] END)) AS s FROM parts)
"""


def _chunked(target: int, most: int, overlap: int) -> str:
    """The fold of sentences to chunks as a recursion over the sentences of each text."""
    n = "len(regexp_extract_all({0}, '[^ \\t\\n\\r\\f]+'))"
    size = f"coalesce(list_sum(list_transform({{0}}, lambda x: {n.format('x')})), 0)"
    kept = f"CASE {' '.join(f'WHEN {size.format(f"b[-{k}:]")} + {n.format("s[i]")} <= {most} THEN b[-{k}:]' for k in range(overlap, 0, -1))} ELSE [] END"
    return f"""
        WITH RECURSIVE {_PROTECTED},
        fold AS (
            SELECT doc_id, s, 1 AS i, CAST([] AS VARCHAR[]) AS b, 0 AS fresh, 0 AS chunk, CAST(NULL AS VARCHAR[]) AS done FROM cut WHERE len(s) > 0
            UNION ALL
            SELECT doc_id, s, i + 1, CASE WHEN flush THEN list_append({kept}, s[i]) ELSE list_append(b, s[i]) END, CASE WHEN flush THEN 1 ELSE fresh + 1 END, chunk + flush::INT, CASE WHEN flush THEN b END
            FROM (SELECT *, fresh > 0 AND {size.format('b')} + {n.format('s[i]')} > {min(target, most)} AS flush FROM fold WHERE i <= len(s))
        ),
        chunks AS (
            SELECT doc_id, chunk - 1 AS chunk, done AS b FROM fold WHERE done IS NOT NULL
            UNION ALL SELECT doc_id, chunk, b FROM fold WHERE i = len(s) + 1 AND fresh > 0 AND (chunk > 0 OR {size.format('b')} >= 5)
        ),
        texts AS (SELECT doc_id, chunk, array_to_string(flatten(list_transform(b, lambda x: regexp_extract_all(x, '[^ \\t\\n\\r\\f]+'))), ' ') AS t FROM chunks)
        SELECT doc_id, chunk, {n.format('t')} AS n_words, md5(t) AS digest FROM texts
    """


_QUOTED = "^(\"[^\"]+\"|''[^'']+'')$"
_CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{e000}}-\x{{f8ff}}\x{{f900}}-\x{{ffff}}]', ' ', 'g'), '[\x00\x{{ad}}]', '', 'g'), "
    r"'\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
)
_TABLE_FAULTS = f"""
        SELECT DISTINCT page_id, item, unnest(list_filter([
            CASE WHEN len(data) < 2 THEN 'too few rows' END,
            CASE WHEN len(list_filter(cells, lambda c: c IN ('', 'None', 'nan', 'N/A'))) > 0.7 * len(cells) THEN 'too many empty cells' END,
            CASE WHEN len(regexp_extract_all(t, '[^ \\t\\n\\r\\f|]+')) < 30 THEN 'too few words' END], lambda x: x IS NOT NULL)) AS reason
        FROM (SELECT *, coalesce({_CELLS.format('data')}, []) AS cells FROM (SELECT *, ({_ROWS})[2:] AS data FROM ({_ENTRIES})) WHERE t IS NOT NULL)
    """

ORACLE = {
    "sentence_split_protected": f"WITH {_PROTECTED} SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM cut)",
    "chunk_children": _chunked(300, 420, 2),
    "chunk_parents": _chunked(1200, 1500, 1),
    "clean_query_text": f"""
        SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex({_CLEANED}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '' AND w NOT IN ({_SETTING})), ' '),
            '[^\\p{{L}}\\p{{N}}_ ?]+', '', 'g'), ' +', ' ', 'g')) AS query FROM documents
    """,
    "bullet_points": f"WITH {_split(3)} SELECT d.doc_id, coalesce(b, CASE WHEN text IS NULL THEN NULL ELSE '' END) AS bullets FROM documents d LEFT JOIN (SELECT doc_id, string_agg('\u2022 ' || fact, chr(10) ORDER BY pos) AS b FROM split WHERE pos < 10 GROUP BY doc_id) USING (doc_id)",
    "plain_sentences": f"WITH {_split(5)} SELECT doc_id, count(*) AS n, md5(string_agg(fact, chr(10) ORDER BY pos)) AS digest FROM split WHERE NOT regexp_matches(fact, '[{{}}<>]') GROUP BY doc_id",
    "excerpts": "SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^ \t\n\r\f]+')[:80], ' ')) AS spoken, md5(substring(text, 1, 600)) AS shown FROM documents WHERE text IS NOT NULL",
    "term_statements": "SELECT statement, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\bwing\\b[^\n]*?\\.')) AS statement FROM documents) GROUP BY statement",
    "gfm_tables": f"""
        WITH m AS (SELECT DISTINCT page_id, coalesce(text, '') || coalesce(chr(10) || chr(10) || array_to_string(list_filter(tables, lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS m FROM pages_out),
        u AS (SELECT page_id, replace(replace(replace(m, '<br>', ' '), '\u2014_', ''), '\u2014', '-') AS u FROM m WHERE contains(m, '|')),
        f AS (SELECT page_id, u, list_transform(regexp_extract_all(u || chr(10), '{T.MARKDOWN_TABLE}'), lambda t: list_filter(string_split(rtrim(t, chr(10)), chr(10)), lambda x: regexp_replace(x, '[| \t\r]', '', 'g') <> '' OR regexp_matches(trim(x), '^\\|[-| :]+\\|$'))) AS f FROM u),
        k AS (SELECT page_id, u, list_transform(list_filter(f, lambda x: len(x) >= 3), lambda x: array_to_string(x, chr(10))) AS k FROM f)
        SELECT page_id, len(k) AS n_tables, md5(array_to_string(k, chr(10) || chr(10))) AS tables,
            md5({_CLEAN.format("regexp_replace(regexp_replace(u, '" + T.MARKDOWN_TABLE + "', '', 'g'), '(?m)^[ \t]*\\|.*\\|[ \t]*$', '', 'g')")}) AS rest FROM k
    """,
    "audit_groups": f"""
        WITH {REASONS}, f AS (SELECT page_id, 0 AS item, reason FROM faults UNION SELECT page_id, item, reason FROM ({_TABLE_FAULTS}))
        SELECT CASE {_GROUP} ELSE 'Other' END AS reason_group, count(*) AS n FROM f GROUP BY 1
    """,
    "new_registrations": "SELECT DISTINCT filename, sha256 FROM processed_files p WHERE registered_at >= TIMESTAMP '2024-01-01' AND NOT EXISTS (SELECT 1 FROM processed_files r WHERE r.registered_at < TIMESTAMP '2024-01-01' AND r.sha256 = p.sha256)",
    "sentence_sources": f"WITH {_split(5)}, k AS (SELECT source, row_number() OVER (PARTITION BY fact ORDER BY doc_id, pos) AS k FROM split) SELECT source, count(*) AS n_sentences FROM k WHERE k = 1 GROUP BY source",
    "registry_merge": "SELECT filename, coalesce(r, l) AS value FROM (SELECT filename, max(sha256) FILTER (n_pages % 2 = 0) AS l, max(sha256) FILTER (n_pages % 2 = 1) AS r FROM processed_files WHERE sha256 IS NOT NULL GROUP BY filename) WHERE coalesce(r, l) IS NOT NULL",
    "chunk_topics": """
        WITH c AS (SELECT DISTINCT * FROM chunk_meta), p AS (SELECT group_id, source, count(*) AS n FROM c WHERE group_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
        t AS (SELECT group_id, source AS topic, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, source DESC) AS k FROM p)
        SELECT DISTINCT child_id, coalesce(c.group_id, '') AS group_id, coalesce(topic, '') AS topic FROM c LEFT JOIN t ON c.group_id = t.group_id AND k = 1
    """,
    "group_references": "SELECT group_id, count(DISTINCT child_id) AS n_chunks, count(*) AS n_references FROM chunk_meta GROUP BY group_id",
    "intent_router": f"SELECT doc_id, CASE {_INTENT} ELSE 'unknown' END AS intent FROM documents",
    "page_kinds": f"""
        SELECT DISTINCT page_id, CASE WHEN w = 0 AND t = 0 THEN 'blank' WHEN t > 0 AND w < 50 THEN 'table' WHEN w < 10 THEN 'sparse' ELSE 'text' END AS kind
        FROM (SELECT page_id, {WORDS.format("coalesce(text, '')")} AS w, coalesce(len(tables), 0) AS t FROM pages_out)
    """,
    "reference_lists": f"""
        WITH {SENTENCES}, k AS (SELECT doc_id, source, trim(regexp_replace(lower(fact), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS key, pos FROM facts WHERE source IS NOT NULL),
        f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id * 1000000 + pos), source) AS number FROM k GROUP BY source),
        m AS (SELECT DISTINCT a.doc_id, '[' || number || ']' AS mark FROM k a JOIN k b ON a.key = b.key JOIN f ON f.source = b.source)
        SELECT doc_id, string_agg(mark, ' ' ORDER BY mark) AS refs FROM m GROUP BY doc_id
    """,
    "quantity_values": r"""
        WITH x AS (SELECT unnest(regexp_extract_all(text, '\ba ([a-z]+(?:[ -][a-z]+){0,2}) of ([0-9]+\.[0-9]+)')) AS x FROM documents),
        v AS (SELECT regexp_extract(x, '^a (.+) of [0-9.]+$', 1) AS quantity, CAST(regexp_extract(x, '([0-9.]+)$', 1) AS DOUBLE) AS v FROM x)
        SELECT quantity, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 9) AS mean FROM v GROUP BY quantity
    """,
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, pos, fact FROM facts",
    "text_quality_reasons": f"WITH {REASONS} SELECT DISTINCT page_id, reason FROM faults",
    "quality_audit_by_source": f"WITH {REASONS} SELECT source, reason, count(DISTINCT page_id) AS n_pages FROM faults GROUP BY source, reason",
    "table_validation": _TABLE_FAULTS,
    "clean_page_text": f"SELECT DISTINCT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {_CLEAN.format('text')} AS t FROM pages_out WHERE text IS NOT NULL)",
    "ocr_pipe_clean": "SELECT DISTINCT page_id, md5(trim(regexp_replace(regexp_replace(text, '[ ]*\\|[ ]*', ' ', 'g'), ' {2,}', ' ', 'g'))) AS digest FROM pages_out WHERE contains(text, '|')",
    "keyword_extract": f"""
        SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '"[^"\\n]+"|''[^''\\n]+''|[^ \\t\\n\\r\\f]+'), lambda x: regexp_matches(x, '{_QUOTED}') OR lower(x) NOT IN ({_STOP})),
            lambda x: CASE WHEN regexp_matches(x, '{_QUOTED}') THEN x[2:-2] ELSE lower(x) END), ' ') AS keywords FROM documents
    """,
    "markdown_table_cells": f"""
        SELECT DISTINCT page_id, item, len(r) AS n_rows, len(c) AS n_cells, len(list_filter(c, lambda x: x IN ('', 'None', 'nan', 'N/A'))) AS n_empty
        FROM (SELECT *, coalesce({_CELLS.format('r')}, []) AS c FROM (SELECT *, {_ROWS} AS r FROM ({_ENTRIES}) WHERE t IS NOT NULL))
    """,
    "child_parent_lookup": """
        WITH c AS (SELECT DISTINCT * FROM chunk_meta), p AS (SELECT DISTINCT source, parent_id FROM chunk_meta WHERE type = 'text')
        SELECT c.source, c.type, count(DISTINCT child_id) AS n_chunks, count(DISTINCT CASE WHEN p.parent_id IS NOT NULL THEN child_id END) AS n_with_parent
        FROM c LEFT JOIN p ON c.parent_id = p.parent_id AND c.source IS NOT DISTINCT FROM p.source GROUP BY c.source, c.type
    """,
    "pages_without_chunks": "SELECT DISTINCT page_id FROM pages_out p WHERE NOT EXISTS (SELECT 1 FROM chunk_meta c WHERE c.source = p.source AND c.page = p.page)",
    "group_topics": "SELECT group_id, count(*) AS n_chunks, count(DISTINCT source) AS n_sources, count(*) FILTER (type = 'table') AS n_tables FROM (SELECT DISTINCT * FROM chunk_meta) GROUP BY group_id",
    "registry_latest": f"SELECT filename, nullif(sha256, '') AS sha256, nullif(n_pages, -1) AS n_pages, registered_at FROM ({_LATEST})",
    "registry_aliases": "SELECT sha256, count(DISTINCT filename) AS n_names, min(filename) AS first_name FROM processed_files WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT filename) > 1",
    "content_hash_new_pages": "SELECT page_id, h AS sha256 FROM (SELECT page_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY loaded_at, page_id) AS k FROM pages_out WHERE text IS NOT NULL) WHERE k = 1",
    "unregistered_sources": "SELECT source, count(DISTINCT page_id) AS n_pages FROM pages_out p WHERE NOT EXISTS (SELECT 1 FROM processed_files f WHERE f.filename = p.source) GROUP BY source",
    "purge_sources": f"SELECT source, count(*) AS n_chunks FROM (SELECT DISTINCT * FROM chunk_meta) c WHERE NOT EXISTS (SELECT 1 FROM ({_LATEST}) l WHERE l.filename = c.source AND l.sha256 = '') GROUP BY source",
    "fact_dedup": f"""
        WITH {SENTENCES} SELECT doc_id, pos, fact FROM (
            SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(fact), '[ \\t\\n\\r\\f]+', ' ', 'g')) ORDER BY doc_id, pos) AS k FROM facts) WHERE k = 1
    """,
    "word_budget_summary": f"""
        WITH {SENTENCES}, w AS (SELECT *, {WORDS.format('fact')} AS n FROM facts WHERE source IS NOT NULL),
        s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM w)
        SELECT source, doc_id, pos, least(n, 120 - spent)::BIGINT AS words FROM s WHERE spent < 120
    """,
    "citation_numbers": f"""
        WITH {SENTENCES}, f AS (SELECT source, min(doc_id * 1000000 + pos) AS first, count(*) AS n_facts FROM facts WHERE source IS NOT NULL GROUP BY source)
        SELECT source, row_number() OVER (ORDER BY first, source) AS number, n_facts FROM f
    """,
    "contradictions": f"""
        WITH {SENTENCES}, k AS (
            SELECT array_to_string(list_filter({_WORD_LIST}, lambda w: w NOT IN ({_NEGATIONS}) AND NOT regexp_matches(w, '[0-9]')), ' ') AS key,
                len(list_filter({_WORD_LIST}, lambda w: w IN ({_NEGATIONS}))) > 0 AS negated FROM facts)
        SELECT key, count(*) FILTER (NOT negated) AS n_plain, count(*) FILTER (negated) AS n_negated FROM k WHERE length(key) > 0
        GROUP BY key HAVING count(*) FILTER (NOT negated) > 0 AND count(*) FILTER (negated) > 0
    """,
    "contradiction_pairs": f"""
        WITH {SENTENCES}, k AS (SELECT array_to_string(list_filter(string_split_regex(lower(fact), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), ' ') AS key FROM facts),
        s AS (SELECT key, count(*) AS n, list_has_any(string_split(key, ' '), [{_OPPOSING}]) AS opposed FROM k WHERE key <> '' GROUP BY key),
        w AS (SELECT key, opposed, word, count(*) AS tf FROM (SELECT key, opposed, unnest(regexp_extract_all(key, '[\\p{{L}}\\p{{N}}]+')) AS word FROM s) GROUP BY ALL),
        z AS (SELECT key, sqrt(sum(tf * tf)) AS norm FROM w GROUP BY key),
        d AS (SELECT p.key AS plain, q.key AS opposed, sum(p.tf * q.tf) AS dot FROM w p JOIN w q ON p.word = q.word AND NOT p.opposed AND q.opposed GROUP BY ALL)
        SELECT plain, d.opposed, round(dot / (a.norm * b.norm), 6) AS similarity, x.n AS n_plain, y.n AS n_opposed
        FROM d JOIN z a ON a.key = plain JOIN z b ON b.key = d.opposed JOIN s x ON x.key = plain JOIN s y ON y.key = d.opposed WHERE round(dot / (a.norm * b.norm), 6) >= 0.82
    """,
    "entity_mentions": f"WITH {_MENTIONS} SELECT doc_id, entity, n FROM mentions",
    "entity_degrees": f"WITH {_MENTIONS} SELECT entity, count(*) AS n_docs, sum(n)::BIGINT AS n_mentions FROM mentions GROUP BY entity HAVING count(*) > 1",
    "question_type": f"SELECT CASE {_KIND} ELSE 'general' END AS kind, count(*) AS n_docs FROM documents GROUP BY 1",
}
