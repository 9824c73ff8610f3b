"""Queries over the driver's tables, a few for each group of operators, with SQL for all that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.terminators import CLAUSE_MARKS
from ..operators import sentences as S
from ..operators import spans as P
from ..operators.documents import chunk_documents, words
from ..operators.packing import pack_paragraphs
from ..sources.tables import dealt
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out for work on each of them: files can be few and large."""
    return dealt(table(spark, sf_dir, "documents"))


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_sentences(docs(spark, sf_dir).select("doc_id", "lang", "text"))


@query(f"WITH {Q.SENTENCE_TABLE} SELECT doc_id, sent_num, sentence FROM sents")
def sentences(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_num", "sentence")


@query(f"WITH {Q.SENTENCE_TABLE} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_letters FROM sents GROUP BY doc_id")
def sentence_count(spark, sf_dir):
    return sents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_letters"))


@query(f"WITH {Q.SENTENCE_TABLE}, c AS (SELECT doc_id, sent_num, {Q.clauses('sentence')} AS c FROM sents) SELECT doc_id, sent_num, CAST(generate_subscripts(c, 1) AS INTEGER) AS clause_num, unnest(c) AS clause FROM c")
def clauses(spark, sf_dir):
    c = sents(spark, sf_dir).select("doc_id", "sent_num", F.posexplode(T.clauses(F.col("sentence"))).alias("clause_num", "clause"))
    return c.withColumn("clause_num", F.col("clause_num") + 1)


@query(f"WITH {Q.SENTENCE_TABLE} SELECT doc_id, sent_num, {Q.section_break('sentence')} AS is_section_break, CAST({Q.word_tokens('sentence')} AS INTEGER) AS n_tokens FROM sents")
def section_breaks(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_num", "is_section_break", "n_tokens")


@query(f"SELECT doc_id, CAST({Q.word_tokens('text')} AS INTEGER) AS n_tokens FROM documents")
def word_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_tokens(F.col("text")).alias("n_tokens"))


@query(f"WITH {Q.SENTENCE_TABLE} SELECT doc_id, sent_num, sentence FROM sents WHERE sent_num > 3")
def offset_skip(spark, sf_dir):
    return sents(spark, sf_dir).where("sent_num > 3").select("doc_id", "sent_num", "sentence")


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS clean FROM documents")
def alnum_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.alnum(F.col("text")).alias("clean"))


_HEAD = f"CASE WHEN {Q.section_break('sentence')} THEN chr(10) || sentence ELSE sentence END"


@query(f"WITH {Q.SENTENCE_TABLE} SELECT doc_id, CAST((sent_num - 1) // 3 + 1 AS INTEGER) AS chunk_num, {Q.strip(f'string_agg({_HEAD}, chr(10) ORDER BY sent_num)')} AS content FROM sents GROUP BY doc_id, (sent_num - 1) // 3")
def chunk_sentences(spark, sf_dir):
    return chunk_documents(docs(spark, sf_dir).select("doc_id", "text"), max_sentences=3, overlap_percent=0, spans=False)


#: Every seventh sentence made a heading: the documents have none of their own.
_HEADED = f"""headed AS (SELECT doc_id, string_agg(CASE WHEN sent_num % 7 = 3 THEN '## ' || sentence ELSE sentence END, chr(10) ORDER BY sent_num) AS text FROM sents GROUP BY doc_id)"""


def headed(spark, sf_dir):
    # a text without sentences becomes an empty one, which has no chunks; to ask for it here would split every text twice
    marked = F.transform(S.sentence_column(F.col("text")), lambda x, i: F.when((i + 1) % 7 == 3, F.concat(F.lit("## "), x)).otherwise(x))
    return docs(spark, sf_dir).select("doc_id", F.array_join(marked, "\n").alias("text"))


@query(
    f"""WITH {Q.SENTENCE_TABLE}, {_HEADED},
again AS (SELECT doc_id, {Q.sentences('text')} AS s FROM headed),
s2 AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS n FROM again),
heads AS (SELECT *, {Q.section_break('sentence')} AS head, sum(CASE WHEN {Q.section_break('sentence')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS cum FROM s2),
groups AS (SELECT doc_id, n, sentence, CASE WHEN cum = 0 THEN 0 ELSE (cum - 1) // 2 END AS g FROM heads)
SELECT doc_id, CAST(g + 1 AS INTEGER) AS chunk_num, {Q.strip(f'string_agg({_HEAD}, chr(10) ORDER BY n)')} AS content FROM groups GROUP BY doc_id, g"""
)
def chunk_sections(spark, sf_dir):
    return chunk_documents(headed(spark, sf_dir), max_section_breaks=2, overlap_percent=0, spans=False)


def _places(spark, sf_dir):
    """Sentences as the first place of each in its text."""
    s = docs(spark, sf_dir).select("doc_id", "text", S.sentence_column(F.col("text")).alias("s"))
    d = s.select("doc_id", F.posexplode(P.places(F.col("text"), F.col("s"))).alias("p", "at"))
    return d.select("doc_id", (F.col("p") + 1).alias("sent_num"), "at.start", "at.length")


@query(f"WITH {Q.SENTENCE_TABLE} SELECT doc_id, sent_num, CAST(strpos(text, sentence) - 1 AS INTEGER) AS span_start, CAST(CASE WHEN strpos(text, sentence) > 0 THEN strpos(text, sentence) - 1 + length(sentence) ELSE -1 END AS INTEGER) AS span_end FROM sents")
def span_exact(spark, sf_dir):
    at = F.col("start")
    return _places(spark, sf_dir).select("doc_id", "sent_num", at.alias("span_start"), F.when(at >= 0, at + F.col("length")).otherwise(-1).alias("span_end"))


@query(f"SELECT doc_id, code, CASE WHEN confidence >= 0.7 THEN code ELSE 'fallback' END AS route FROM ({Q.detected('text')})")
def lang_route(spark, sf_dir):
    from ..operators.detect import detect, route

    found = docs(spark, sf_dir).select("doc_id", detect(F.col("text")).alias("d"))
    return found.select("doc_id", F.col("d.code").alias("code"), route(F.col("d.code"), F.col("d.confidence")).alias("route"))


#: Sentences cut at every comma and dash, so that there is something to clean.
_ODD = "string_split(replace(replace(text, ',', chr(10) || '!?...,' || chr(10)), 'tion', chr(10) || '- - -' || chr(10)), chr(10))"


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) AS INTEGER) AS sent_num, unnest(s) AS sentence FROM (SELECT doc_id, {Q.clean(_ODD)} AS s FROM documents)")
def clean_sentences(spark, sf_dir):
    odd = F.split(F.replace(F.replace("text", F.lit(","), F.lit("\n!?...,\n")), F.lit("tion"), F.lit("\n- - -\n")), "\n", -1)
    s = docs(spark, sf_dir).select("doc_id", F.posexplode(T.clean_sentences(odd)).alias("p", "sentence"))
    return s.select("doc_id", (F.col("p") + 1).alias("sent_num"), "sentence")


@query(rf"SELECT doc_id, n, regexp_full_match(x, '{T.THEMATIC_BREAK.replace(T.WS, Q.WS)}') AS thematic FROM (SELECT doc_id, n, n % 4 || CASE n % 3 WHEN 0 THEN '' ELSE repeat(CASE n % 2 WHEN 0 THEN '-' ELSE '* ' END, CAST(n % 5 AS INTEGER)) END AS y, CASE WHEN n % 7 = 0 THEN y ELSE substr(y, 2) END AS x FROM (SELECT doc_id, n_chars AS n FROM documents))")
def thematic_breaks(spark, sf_dir):
    n = F.col("n_chars")
    y = F.concat((n % 4).cast("string"), F.when(n % 3 == 0, "").otherwise(F.expr("repeat(CASE WHEN n_chars % 2 = 0 THEN '-' ELSE '* ' END, cast(n_chars % 5 AS int))")))
    return docs(spark, sf_dir).select("doc_id", n.alias("n"), T.is_thematic_break(F.when(n % 7 == 0, y).otherwise(F.substring(y, 2, 1 << 30))).alias("thematic"))


@query("SELECT doc_id, regexp_replace(replace(text, '. ', '.' || repeat(chr(10), CAST(n_chars % 5 AS INTEGER))), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def newline_collapse(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.collapse_newlines(F.expr("replace(text, '. ', concat('.', repeat('\\n', cast(n_chars % 5 AS int))))")).alias("text"))


#: Every address of a page made a Markdown link, to itself three times over, so that there are long ones.
_HREF, _LINK = r'(?:href|src)="([^"\n]*)"', r"[link](\1?\1?\1)"


@query(f"SELECT page_id, regexp_replace(regexp_replace(html, {Q.lit(_HREF)}, {Q.lit(_LINK)}, 'g'), {Q.lit(T.long_link(20))}, {Q.lit(chr(92) + '1(' + chr(92) + '2...)')}, 'g') AS page FROM pages")
def url_truncate(spark, sf_dir):
    linked = F.regexp_replace("html", F.lit(_HREF), F.lit(_LINK.replace("\\", "$")))
    return table(spark, sf_dir, "pages").select("page_id", T.truncate_urls(linked, 20).alias("page"))


@query("SELECT n_regionkey, chr(10) || '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS md FROM nation GROUP BY n_regionkey")
def md_table(spark, sf_dir):
    from ..operators.tables import markdown_table

    return markdown_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], by=["n_regionkey"], order=["n_nationkey"])


def overlap_sql(source: str, sentences: str, sections: int | None) -> str:
    """Packing by at most `sentences` sentences (and sections, if given) with an overlap of 20 %, sentence by sentence."""
    head = Q.section_break("s")
    flat = f"flatten([{Q.clauses('h')} FOR h IN held])"
    n = f"CAST(round_even(len({flat}) * 20 / 100.0, 0) AS BIGINT)"
    last = f"CASE WHEN {n} = 0 THEN CAST([] AS VARCHAR[]) ELSE {flat}[-{n}:] END"
    marked = "[CASE WHEN i = 1 AND c <> '' AND NOT regexp_matches(c, '^\\p{Lu}') THEN '... ' || c ELSE c END FOR c, i IN last]"
    full = f"n + 1 > {sentences}" + (f" OR (head AND heads + 1 > {sections})" if sections else "")
    count = f"len([c FOR c IN carried IF {Q.section_break('c')}])" if sections else "0"
    return f"""{source},
steps AS (SELECT doc_id, sent_num AS k, {head} AS head, CASE WHEN {head} THEN chr(10) || s ELSE s END AS s FROM (SELECT doc_id, sent_num, sentence AS s FROM sents)),
fold AS (
  SELECT doc_id, k, [s] AS held, 1 AS n, CAST(head AS INTEGER) AS heads, 1 AS num, CAST(NULL AS VARCHAR[]) AS done FROM steps WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN full_ THEN list_append(carried, s) ELSE list_append(held, s) END, CASE WHEN full_ THEN len(carried) ELSE n END + 1,
    CAST(CASE WHEN full_ THEN {count} ELSE heads END + CAST(head AS INTEGER) AS INTEGER), num + CAST(full_ AS INTEGER), CASE WHEN full_ THEN held END
  FROM (SELECT *, {marked} AS carried FROM (SELECT *, {last} AS last FROM (
    SELECT f.doc_id, t.k, f.held, f.n, f.heads, f.num, t.s, t.head, ({full.replace('head ', 't.head ')}) AS full_ FROM fold f JOIN steps t ON t.doc_id = f.doc_id AND t.k = f.k + 1)))
),
every AS (SELECT doc_id, num - 1 AS num, done AS held FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(num), max_by(held, k) FROM fold GROUP BY doc_id)
SELECT doc_id, CAST(num AS INTEGER) AS chunk_num, {Q.strip("array_to_string(held, chr(10))")} AS content FROM every"""


@query(overlap_sql(f"WITH RECURSIVE {Q.SENTENCE_TABLE}", 3, None))
def chunk_overlap(spark, sf_dir):
    return chunk_documents(docs(spark, sf_dir).select("doc_id", "text"), max_sentences=3, overlap_percent=20).select("doc_id", "chunk_num", "content")


@query(overlap_sql(f"WITH RECURSIVE {Q.SENTENCE_TABLE.replace('docs AS', 'docs0 AS', 1).replace('FROM docs)', 'FROM docs0)').replace('sents AS', 'sents0 AS', 1)}, {_HEADED.replace('FROM sents', 'FROM sents0')}, sents AS (SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) AS INTEGER) AS sent_num FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM headed))", 6, 2))
def chunk_hybrid(spark, sf_dir):
    return chunk_documents(headed(spark, sf_dir), max_sentences=6, max_section_breaks=2, overlap_percent=20).select("doc_id", "chunk_num", "content")


#: Without clause marks a sentence is one clause, which fits whole or not at all.
_NO_CLAUSES = f"[{CLAUSE_MARKS}]"


@query(
    f"""WITH RECURSIVE {Q.SENTENCE_TABLE.replace("{s}", "").replace(Q.sentences("text"), Q.sentences("text").replace("text", "regexp_replace(text, '" + _NO_CLAUSES + "', '', 'g')"))},
steps AS (SELECT doc_id, sent_num AS k, CASE WHEN {Q.section_break("sentence")} THEN chr(10) || sentence ELSE sentence END AS s, {Q.word_tokens("sentence")} AS n FROM sents),
fold AS (
  SELECT doc_id, k, CASE WHEN n > 60 THEN regexp_replace(s, '[/\\\\]', ' ', 'g') || '...' ELSE s END AS s, CASE WHEN n > 60 THEN 0 ELSE n END AS t, 1 AS num FROM steps WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, p.s, CASE WHEN f.t + p.n > 60 THEN p.n ELSE f.t + p.n END, f.num + CAST(f.t + p.n > 60 AS INTEGER) FROM fold f JOIN steps p ON p.doc_id = f.doc_id AND p.k = f.k + 1
)
SELECT doc_id, CAST(num AS INTEGER) AS chunk_num, {Q.strip("string_agg(s, chr(10) ORDER BY k)")} AS content FROM fold GROUP BY doc_id, num"""
)
def chunk_tokens(spark, sf_dir):
    plain = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", _NO_CLAUSES, "").alias("text"))
    return chunk_documents(plain, max_tokens=60, overlap_percent=0, token_counter=words).select("doc_id", "chunk_num", "content")


@query()
def chunk_tokens_fit(spark, sf_dir):
    """Token limits with clauses fitted onto chunks, overlap and spans; the tests hold it against a procedure in Python."""
    c = chunk_documents(docs(spark, sf_dir).select("doc_id", "text"), max_tokens=60, overlap_percent=20, token_counter=words)
    return c.select("doc_id", "chunk_num", "content", "span.start", "span.end", "n_tokens")


_CHUNKS3 = f"WITH {Q.SENTENCE_TABLE}, chunks AS (SELECT doc_id, lang, CAST((sent_num - 1) // 3 + 1 AS INTEGER) AS chunk_num, {Q.strip(f'string_agg({_HEAD}, chr(10) ORDER BY sent_num)')} AS content FROM sents GROUP BY doc_id, lang, (sent_num - 1) // 3)"


def _chunks3(spark, sf_dir):
    return chunk_documents(docs(spark, sf_dir).select("doc_id", "lang", "text"), max_sentences=3, overlap_percent=0, spans=False)


@query(f"{_CHUNKS3} SELECT doc_id, count(*) AS chunk_count, CAST(sum(length(content)) AS BIGINT) AS text_length, CAST(max(length(content)) AS INTEGER) AS longest_chunk FROM chunks GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    return P.chunk_stats(_chunks3(spark, sf_dir), ["doc_id"])


@query(f"{_CHUNKS3} SELECT lang, source, count(*) AS chunks, count(DISTINCT doc_id) AS docs, CAST(sum(length(content)) AS BIGINT) AS letters FROM chunks JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY ROLLUP (lang, source)")
def stats_rollup(spark, sf_dir):
    c = chunk_documents(docs(spark, sf_dir).select("doc_id", "lang", "source", "text"), max_sentences=3, overlap_percent=0, spans=False)
    return c.rollup("lang", "source").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("content")).alias("letters"))


_PLACED = f"""WITH {Q.SENTENCE_TABLE}, placed AS (SELECT doc_id, sent_num AS chunk_num, CAST(strpos(text, sentence) - 1 AS INTEGER) AS start, CAST(strpos(text, sentence) - 1 + length(sentence) + 15 AS INTEGER) AS "end" FROM sents WHERE strpos(text, sentence) > 0)"""


def _placed(spark, sf_dir):
    """Sentences as chunks that run fifteen characters into what follows."""
    at = F.col("start")
    return _places(spark, sf_dir).select("doc_id", F.col("sent_num").alias("chunk_num"), at.alias("start"), (at + F.col("length") + 15).alias("end")).where("start >= 0")


@query(
    f"""{_PLACED} SELECT doc_id, chunk_num, greatest(start, s2) AS overlap_start, least("end", e2) AS overlap_end FROM (
SELECT *, lead(start) OVER w AS s2, lead("end") OVER w AS e2 FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", chunk_num)) WHERE greatest(start, s2) < least("end", e2) AND s2 IS NOT NULL"""
)
def chunk_overlaps(spark, sf_dir):
    return P.overlaps(_placed(spark, sf_dir))


@query(
    f"""{_PLACED}, edges AS (SELECT DISTINCT doc_id, unnest([start, "end"]) AS e FROM placed),
pieces AS (SELECT doc_id, e AS start, lead(e) OVER (PARTITION BY doc_id ORDER BY e) AS "end" FROM edges),
inside AS (SELECT p.doc_id, p.start, p."end", c.chunk_num, row_number() OVER (PARTITION BY p.doc_id, p.start ORDER BY c.start, c.chunk_num) AS r FROM pieces p JOIN placed c ON p.doc_id = c.doc_id AND c.start <= p.start AND p.start < c."end" WHERE p."end" IS NOT NULL)
SELECT doc_id, start, "end", count(*) AS n, CAST(min(chunk_num) AS INTEGER) AS first FROM inside WHERE r <= 2 GROUP BY ALL"""
)
def position_cover(spark, sf_dir):
    c = P.cover(_placed(spark, sf_dir))
    return c.select("doc_id", "start", "end", F.size("chunks").cast("long").alias("n"), F.array_min("chunks").alias("first"))


@query(
    f"""WITH RECURSIVE {Q.SENTENCE_TABLE}, fold AS (
  SELECT doc_id, sent_num AS k, sentence, length(sentence) AS size, 1 AS num FROM sents WHERE sent_num = 1
  UNION ALL
  SELECT s.doc_id, s.sent_num, s.sentence, CASE WHEN f.size + length(s.sentence) > 4000 THEN length(s.sentence) ELSE f.size + length(s.sentence) END, f.num + CAST(f.size + length(s.sentence) > 4000 AS INTEGER) FROM fold f JOIN sents s ON s.doc_id = f.doc_id AND s.sent_num = f.k + 1)
SELECT doc_id, CAST(num AS INTEGER) AS section_num, string_agg(sentence, chr(10) ORDER BY k) AS text FROM fold GROUP BY doc_id, num"""
)
def para_pack(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", S.sentence_column(F.col("text")).alias("s"))
    return d.select("doc_id", F.posexplode(pack_paragraphs(F.col("s"))).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("section_num"), "text")


_PAPER = "replace(replace(replace(text, '. ', '.' || chr(10) || chr(10) || ' ' || chr(10) || (n_chars % 9) || '.' || chr(10)), ', ', chr(10) || (n_chars % 90) || chr(10)), ' a', ' Page 3 of 9 x' || chr(10) || 'a')"


def _paper_sql(x: str) -> str:
    for pattern, to in T.PAPER:
        x = Q.sub(x, pattern.replace(T.WS, Q.WS), "CAST(chr(10) AS VARCHAR)" if to == "\n" else to.replace("$", "\\"))
    return x


@query(f"SELECT doc_id, {_paper_sql(_PAPER)} AS text FROM documents")
def paper_cleanup(spark, sf_dir):
    t = F.expr(_PAPER.replace("chr(10)", "char(10)").replace("(n_chars % 9)", "cast(n_chars % 9 as string)").replace("(n_chars % 90)", "cast(n_chars % 90 as string)"))
    return docs(spark, sf_dir).select("doc_id", T.paper_cleanup(t).alias("text"))


@query()
def html_markdown(spark, sf_dir):
    """Pages as Markdown, addresses cut, blank lines collapsed."""
    from ..sources.readers import html_column

    return table(spark, sf_dir, "pages").select("page_id", "url", html_column(F.col("html")).alias("markdown"))


#: Code to chunk, made of the parts: a function for each, a text for each brand.
def _code(spark, sf_dir):
    m = F.concat(F.lit("def part_"), F.col("p_partkey"), F.lit("(self):\n    size = "), F.col("p_size"), F.lit("\n    return size * "), F.col("p_partkey"), F.lit("\n"))
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", m.alias("m")))).alias("ms"))
    return g.select("p_brand", F.array_join("ms.m", "\n").alias("code"))


@query(
    """WITH m AS (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS k, p_partkey, 'def part_' || p_partkey || '(self):' || chr(10) || '    size = ' || p_size || chr(10) || '    return size * ' || p_partkey AS body FROM part),
last AS (SELECT p_brand, max(k) AS n FROM m GROUP BY p_brand)
SELECT p_brand, k AS chunk_num, CASE WHEN k < n THEN body || chr(10) ELSE body END AS content, 'global' || chr(10) || '└─ def part_' || p_partkey || '(' AS tree, CAST((k - 1) * 4 + 1 AS INTEGER) AS start_line, CAST(k * 4 - CASE WHEN k < n THEN 0 ELSE 1 END AS INTEGER) AS end_line FROM m JOIN last USING (p_brand)"""
)
def code_chunks(spark, sf_dir):
    from ..operators.code import chunk_code

    return chunk_code(_code(spark, sf_dir), max_functions=1).select("p_brand", "chunk_num", "content", "tree", "start_line", "end_line")


@query(
    """WITH lines AS (SELECT p_brand, 0 AS k, 'def all_parts(self):' AS line FROM part GROUP BY p_brand
  UNION ALL SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER), '    size_' || p_partkey || ' = ' || p_size FROM part)
SELECT p_brand, CAST(k // 8 + 1 AS INTEGER) AS chunk_num, string_agg(line, chr(10) ORDER BY k) AS content, CAST(min(k) + 1 AS INTEGER) AS start_line, CAST(max(k) + 1 AS INTEGER) AS end_line FROM lines GROUP BY p_brand, k // 8"""
)
def line_pack(spark, sf_dir):
    """One function of many lines for each brand, too long for any chunk, cut between lines."""
    from ..operators.code import chunk_code

    line = F.concat(F.lit("    size_"), F.col("p_partkey"), F.lit(" = "), F.col("p_size"))
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("x")))).alias("xs"))
    code = g.select("p_brand", F.concat(F.lit("def all_parts(self):\n"), F.array_join("xs.x", "\n")).alias("code"))
    return chunk_code(code, max_lines=8, strict=False).select("p_brand", "chunk_num", "content", "start_line", "end_line")


@query(
    """WITH m AS (SELECT p_brand, p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, k AS chunk_num,
  CASE WHEN k = 1 THEN 'class ' || replace(p_brand, '#', '_') || ':' || chr(10) || '    ' || chr(10) ELSE '' END || '    @cached' || chr(10) || '    def part_' || p_partkey || '(self):' || chr(10) || '        return ' || p_size || CASE WHEN k < n THEN chr(10) || chr(10) || '    ' ELSE '' END AS content,
  'global' || chr(10) || '└─ class ' || replace(p_brand, '#', '_') || chr(10) || '   └─ def part_' || p_partkey || '(' AS tree,
  CAST(CASE WHEN k = 1 THEN 1 ELSE 5 * k - 2 END AS INTEGER) AS start_line, CAST(CASE WHEN k < n THEN 5 * k + 2 ELSE 5 * k END AS INTEGER) AS end_line, 2 AS n_relations
FROM m"""
)
def code_tree(spark, sf_dir):
    """A class for each brand: comments taken out, decorated methods, a tree of two levels."""
    from ..operators.code import chunk_code

    m = F.concat(F.lit("    # note of part "), F.col("p_partkey"), F.lit("\n    @cached\n    def part_"), F.col("p_partkey"), F.lit("(self):\n        return "), F.col("p_size"), F.lit("\n"))
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", m.alias("m")))).alias("ms"))
    code = g.select("p_brand", F.concat(F.lit("class "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(":\n"), F.array_join("ms.m", "\n")).alias("code"))
    c = chunk_code(code, max_functions=1, include_comments=False)
    return c.select("p_brand", "chunk_num", "content", "tree", "start_line", "end_line", F.size("relations").alias("n_relations"))


@query("SELECT p_brand, CAST(count(*) AS INTEGER) AS functions FROM part GROUP BY p_brand")
def func_decl_count(spark, sf_dir):
    from ..operators.code import declarations

    return _code(spark, sf_dir).select("p_brand", declarations(F.col("code")).alias("functions"))
