"""Queries of ingestion: documents are written as encoded books by Spark, then parsed, chunked and audited."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking as C
from quillon.operators import markup as M
from quillon.plans import sql as S
from quillon.sources import files
from quillon.sources.tables import table

#: Chunk sizes of the queries, small enough that every rule of the fold takes effect on these texts.
SIZES = {"full": 40, "oversize": 60, "trailing": 8}


def _escaped(x):
    """Named entities for the signs of markup, numeric references for two letters."""
    for sign, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&#233;"), ("à", "&#xE0;")):
        x = F.replace(x, F.lit(sign), F.lit(ref))
    return x


def _works(spark, d, body_first=False):
    """A book for each document: lines become heads, paragraphs, verse, quotes, notes and page breaks; a third of the books has divisions, a third a front part, which may come after the body; some values are in single quotes or hold signs of markup, some texts are character data, and half of the headers have a prefix."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), "source", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "").alias("lines"))
    n, kind = F.size("lines"), F.col("work_id") % 3

    def element(x, i):
        k, number = (F.col("work_id") + i) % 8, i.cast("string")
        p = F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))
        pb = F.concat(F.lit('<pb n="'), number, F.lit('"/>'))
        quoted = F.concat(F.lit("<pb ed='n=\"0\" >' n = '"), number, F.lit("' />"))
        verbatim = F.concat(F.lit("""<p rend="a>b" n='"'><![CDATA["""), F.replace(x, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]><note/></p>"))
        e = (
            F.when(k == 0, F.concat(F.lit("<head>"), _escaped(x), F.lit("</head>"))).when(k == 1, F.concat(quoted, p)).when(k == 2, F.concat(F.lit("<pb/>"), p))
            .when(k == 3, F.concat(F.lit("<p>"), _escaped(F.substr(x, F.lit(1), F.lit(10))), pb, F.lit("<hi>"), _escaped(F.substr(x, F.lit(11))), F.lit("</hi></p>")))
            .when(k == 4, F.concat(F.lit("<lg><l>"), _escaped(x), F.lit("</l></lg>"))).when(k == 5, F.lit("<p> </p>"))
            .when(k == 6, F.concat(F.lit("<p><quote>"), _escaped(x), F.lit("</quote></p>"))).when(k == 7, verbatim).otherwise(p)
        )
        wrapped = (kind == 1) | ((kind == 2) & (F.floor(i / 4) % 2 == 0))
        types = F.element_at(F.array(F.lit(' type="chapter"'), F.lit(' type="preface"'), F.lit("")), (F.floor(i / 4) % 3 + 1).cast("int"))
        last = (i % 4 == 3) | (i == n - 1)
        e = F.concat(F.when(wrapped & (i % 4 == 0), F.concat(F.lit("<div"), types, F.lit(">"))).otherwise(""), e, F.when(wrapped & last, "</div>").otherwise(""))
        return F.concat(F.when((kind == 2) & (i == 0), "<front>").otherwise(""), e, F.when((kind == 2) & ((i == 3) | ((i == n - 1) & (i < 3))), "</front><body>").otherwise(""))

    body = F.array_join(F.transform("lines", element), "")
    body = F.when((kind == 2) & (n > 0), F.concat(F.lit("<text>"), body, F.lit("</body></text>"))).otherwise(F.concat(F.lit("<text><body>"), body, F.lit("</body></text>")))
    if body_first:
        body = F.regexp_replace(body, "(?s)(<front>.*</front>)(<body>.*</body>)", "$2$1")
    head = F.concat(F.lit("<TEI xmlns='http://www.tei-c.org/ns/1.0' xmlns:tei=\"http://www.tei-c.org/ns/1.0\"><teiHeader><titleStmt><title>Livre "), F.col("work_id").cast("string"), F.lit(" <hi>de</hi>  "), F.col("source"), F.lit("</title><title>Autre &amp; titre</title></titleStmt><publicationStmt><date>19"), F.lpad((F.col("work_id") % 100).cast("string"), 2, "0"), F.lit("</date></publicationStmt><sourceDesc><p>Tiré de "), F.col("source"), F.lit(" http://x</p></sourceDesc></teiHeader>"))
    head = F.when(F.col("work_id") % 2 == 1, F.regexp_replace(head, "<(/?)(teiHeader|titleStmt|title|publicationStmt|date|sourceDesc|p)(?=>)", "<$1tei:$2")).otherwise(head)
    return docs.select("work_id", "source", F.concat(head, body, F.lit("<!-- fin --></TEI>")).alias("markup"))


def _marked(spark, d):
    return files.kept(spark, "marked", [f"{d}/documents.parquet"], lambda: M.annotated(M.token_stream(_works(spark, d))))


def _paras(spark, d):
    return M.paragraphs(_marked(spark, d))


def _lines(spark, d):
    """Lines of documents as paragraphs, a document for each section, a source for each work."""
    docs = table(spark, d, "documents").select(F.col("source").alias("work_id"), F.col("doc_id").alias("section"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    p = docs.select("work_id", "section", (F.col("pos") + 1).cast("bigint").alias("index"), "text", T.word_count(F.col("text")).alias("words")).where("words > 0")
    return p.withColumn("paragraph_id", F.concat(F.col("section").cast("string"), F.lit("_p"), F.col("index").cast("string")))


def scan_metadata(spark, d):
    """The catalogue as CSV, parts by number, some keys twice; the last row of a key counts."""
    path = files.scratch(spark, "metadata")
    n = table(spark, d, "part")
    rows = n.select((F.col("p_partkey") % (n.count() * 4 // 5 + 1)).alias("id"), F.col("p_name").alias("title"), F.lit("1900").alias("date"), F.col("p_partkey").alias("textorder"))
    files.write_csv(rows.repartitionByRange("textorder").sortWithinPartitions("textorder"), path)  # files in order, each in order
    return files.read_metadata(spark, path, "id string, title string, date string, textorder string").select("id", "title", "date", "textorder")


def scan_markup(spark, d):
    """Works written to files, line ends and all, parted by a sign that no text has, and read back: breaks and divisions of each, and its line ends."""
    path, between = files.scratch(spark, "markup"), "\u241e"
    _works(spark, d).select(F.concat("markup", F.lit("\n")).alias("value")).write.text(path, lineSep=between)
    back = M.read_works(spark, path, between).select(F.regexp_extract("markup", "title>Livre ([0-9]+)", 1).cast("bigint").alias("work_id"), "markup")
    return M.token_stream(back).groupBy("work_id").agg(F.count_if(F.col("starts") & (F.col("tag") == "pb")).alias("n_breaks"), F.count_if(F.col("starts") & (F.col("tag") == "div")).alias("n_divs"), F.sum(F.length("tok") - F.length(F.replace("tok", F.lit("\n")))).cast("bigint").alias("n_lines"))


def local_name(spark, d):
    """Tags in a namespace prefix count under their local names."""
    prefixed = _works(spark, d).select("work_id", F.regexp_replace("markup", "<(/?)(p|head|pb|lg)(?=[ />])", "<$1tei:$2").alias("markup"))
    return M.token_stream(prefixed).where(F.col("starts") & F.col("tag").isin("p", "head", "pb", "lg")).groupBy("work_id", "tag").agg(F.count("*").alias("n"))


def text_required(spark, d):
    """Works without a text element are rejected, not parsed: of each work whether it was taken; every seventh has lost its text."""
    w = _works(spark, d).withColumn("markup", F.when(F.col("work_id") % 7 == 0, F.regexp_replace("markup", "(?s)<text>.*</text>", "")).otherwise(F.col("markup")))
    taken, rejected = M.with_text(w)
    return taken.select("work_id", F.lit(True).alias("taken")).unionByName(rejected.select("work_id", F.lit(False).alias("taken")))


def region_order(spark, d):
    """Books whose front comes after their body are read front first all the same."""
    m = M.annotated(M.token_stream(_works(spark, d, body_first=True)))
    return M.paragraphs(m).select("work_id", "section", "index", "text")


def header_fields(spark, d):
    """Every fifth book has lost its titles and takes that of the catalogue, which knows every second one."""
    w = _works(spark, d)
    known = w.where("work_id % 2 = 0").select("work_id", F.concat(F.lit("Du catalogue : "), "source").alias("title"))
    lost = w.withColumn("markup", F.when(F.col("work_id") % 5 == 0, F.regexp_replace("markup", "(?s)(titleStmt>).*(</(?:tei:)?titleStmt>)", "$1$2")).otherwise(F.col("markup")))
    return M.header(lost, known).withColumn("alt_titles", F.array_join("alt_titles", "|"))


def page_refs(spark, d):
    m = _marked(spark, d).where("is_pb")
    return m.select("work_id", F.row_number().over(Window.partitionBy("work_id").orderBy("i")).cast("bigint").alias("nth"), F.col("page_no").alias("number"), F.col("label").alias("display"))


def region_blocks(spark, d):
    return _marked(spark, d).where("block > 0 and kind is not null and kind <> 'region'").groupBy("work_id", "block").agg(F.min_by("region", "i").alias("region"), F.count_if(F.col("kind") == "para").alias("n_paras"))


def section_number(spark, d):
    m = _marked(spark, d)
    return M.sections(m, M.paragraphs(m), keep_empty=True).select("work_id", "section", "region", "label", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))


def section_label(spark, d):
    m = _marked(spark, d)
    return M.sections(m, M.paragraphs(m)).select("work_id", "section", "div_type", "label")


def section_pages(spark, d):
    m = _marked(spark, d)
    return M.sections(m, M.paragraphs(m)).select("work_id", "section", "page_start", "page_end")


def drop_empty_sections(spark, d):
    m = _marked(spark, d)
    return M.sections(m, M.paragraphs(m)).select("work_id", "section", "n_paragraphs")


def paragraphs(spark, d):
    return _paras(spark, d).select("work_id", "section", "index", "paragraph_id", "text", "word_count")


def page_carry(spark, d):
    return _paras(spark, d).select("work_id", "index", "page_start", "page_end")


def corpus_parse(spark, d):
    m = _marked(spark, d)
    p = M.paragraphs(m)
    s = M.sections(m, p).groupBy("work_id").agg(F.count("*").alias("n_sections"))
    return p.groupBy("work_id").agg(F.count("*").alias("n_paragraphs"), F.sum("word_count").alias("n_words")).join(s.hint("merge"), "work_id")


def ingest_job(spark, d):
    """Parse, chunk and write all; counts by work are read back from what was written."""
    p = _paras(spark, d).withColumn("words", F.col("word_count"))
    c = C.renumbered(C.built(C.grouped(p, **SIZES)))
    a, b = files.scratch(spark, "paragraphs"), files.scratch(spark, "chunks")
    p.write.parquet(a)
    c.write.parquet(b)
    counts = spark.read.parquet(a).groupBy("work_id").agg(F.count("*").alias("n_paragraphs"))
    return counts.join(spark.read.parquet(b).groupBy("work_id").agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words")), "work_id")


def chunk_greedy(spark, d):
    return C.grouped(_lines(spark, d), SIZES["full"], 10**9, merge=False).select("section", "index", F.col("g").cast("bigint").alias("g"))


def chunk_oversize(spark, d):
    return C.grouped(_lines(spark, d), SIZES["full"], SIZES["oversize"], merge=False).select("section", "index", F.col("g").cast("bigint").alias("g"))


def chunk_trailing_merge(spark, d):
    return C.grouped(_lines(spark, d), **SIZES).select("section", "index", F.col("g").cast("bigint").alias("g"))


def _chunks(spark, d):
    return C.renumbered(C.built(C.grouped(_lines(spark, d), **SIZES)))


def chunk_build(spark, d):
    return _chunks(spark, d).select("section", F.col("g").cast("bigint").alias("g"), F.array_join("paragraph_ids", ",").alias("paragraph_ids"), "text", "word_count")


def chunk_renumber(spark, d):
    return _chunks(spark, d).select("chunk_id", "section", F.col("g").cast("bigint").alias("g"))


QUERIES = {f.__name__: f for f in (scan_metadata, scan_markup, local_name, text_required, region_order, header_fields, page_refs, region_blocks, section_number, section_label, section_pages, drop_empty_sections, paragraphs, page_carry, corpus_parse, ingest_job, chunk_greedy, chunk_oversize, chunk_trailing_merge, chunk_build, chunk_renumber)}

_W = S.words
_L = f"""ls AS (SELECT doc_id AS work_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents),
li AS (SELECT work_id, i - 1 AS i, l[i] AS x, len(l) AS n, (work_id + i - 1) % 8 AS k, work_id % 3 AS lay, (i - 1) // 4 AS q FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ls)),
lw AS (SELECT *, lay = 1 OR (lay = 2 AND q % 2 = 0) AS wrapped, CASE WHEN lay = 2 AND i <= 3 THEN 'front' ELSE 'body' END AS region FROM li),
lp AS (SELECT *, lag(wrapped) OVER w AS pw, lag(region) OVER w AS pr, lag(k) OVER w AS pk FROM lw WINDOW w AS (PARTITION BY work_id ORDER BY i)),
lb AS (SELECT *, CAST(sum(CASE WHEN wrapped THEN CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END WHEN pw IS NULL OR pw OR pr <> region OR (k = 0 AND pk <> 0) THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY i) AS BIGINT) AS block,
  CASE WHEN k IN (1, 3) THEN i END AS num FROM lp),
pn AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, first_value(num IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM lb),
lab AS (SELECT *, CASE WHEN num IS NOT NULL THEN CAST(num AS VARCHAR) WHEN k = 2 THEN CASE WHEN prior IS NOT NULL AND later IS NOT NULL THEN 'entre les p. ' || CAST(prior AS VARCHAR) || ' et ' || CAST(later AS VARCHAR) WHEN later IS NOT NULL THEN 'avant la p. ' || CAST(later AS VARCHAR) WHEN prior IS NOT NULL THEN 'après la p. ' || CAST(prior AS VARCHAR) ELSE 'page non numérotée' END END AS label FROM pn),
cur AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pe, last_value(label IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp FROM lab),
par AS (SELECT work_id, block AS section, i, row_number() OVER (PARTITION BY work_id ORDER BY i) AS index, {S.clean('x')} AS text, coalesce(CASE WHEN k = 3 THEN pp ELSE pe END, pe, 'page non numérotée') AS page_start, coalesce(pe, 'page non numérotée') AS page_end FROM cur WHERE k NOT IN (0, 5) AND {S.clean('x')} <> ''),
blk AS (SELECT work_id, block AS section, min(region) AS region, bool_or(wrapped) AS wrapped, CASE WHEN bool_or(wrapped) THEN CASE min(q) % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'preface' END END AS div_type, arg_min(CASE WHEN k = 0 THEN {S.clean('x')} END, CASE WHEN k = 0 THEN i END) AS head, count(CASE WHEN k <> 0 THEN 1 END) AS n_paras FROM lb GROUP BY ALL),
sec AS (SELECT *, CASE WHEN head IS NOT NULL AND head <> '' THEN head WHEN div_type IS NOT NULL THEN CASE div_type WHEN 'chapter' THEN 'Chapitre ' ELSE 'Préface ' END || CAST(CAST(sum(CASE WHEN head IS NULL OR head = '' THEN 1 ELSE 0 END) OVER (PARTITION BY work_id, div_type ORDER BY section) AS BIGINT) AS VARCHAR) ELSE 'Section ' || CAST(section AS VARCHAR) END AS label FROM blk),
pg AS (SELECT work_id, section, arg_min(page_start, index) AS page_start, arg_max(page_end, index) AS page_end, count(*) AS n_paragraphs FROM par GROUP BY ALL)"""


def _folded(source: str, full: int, oversize: int, trailing: int) -> str:
    """CTEs ``fold`` (before merging) and ``merged`` from ``source(work_id, section, index, words)``."""
    return f"""seq AS (SELECT work_id, section, index, words, row_number() OVER (PARTITION BY work_id, section ORDER BY index) AS i FROM {source}),
walk AS (SELECT work_id, section, index, words, i, CAST(0 AS BIGINT) AS g, CASE WHEN words > {oversize} OR words >= {full} THEN CAST(1 AS BIGINT) ELSE 0 END AS nxt, CASE WHEN words > {oversize} OR words >= {full} THEN CAST(0 AS BIGINT) ELSE words END AS s FROM seq WHERE i = 1
 UNION ALL SELECT q.work_id, q.section, q.index, q.words, q.i, CASE WHEN q.words > {oversize} AND w.s > 0 THEN w.nxt + 1 ELSE w.nxt END,
  CASE WHEN q.words > {oversize} THEN CASE WHEN w.s > 0 THEN w.nxt + 2 ELSE w.nxt + 1 END WHEN w.s + q.words >= {full} THEN w.nxt + 1 ELSE w.nxt END,
  CASE WHEN q.words > {oversize} OR w.s + q.words >= {full} THEN CAST(0 AS BIGINT) ELSE w.s + q.words END
 FROM walk w JOIN seq q ON q.work_id = w.work_id AND q.section = w.section AND q.i = w.i + 1),
sz AS (SELECT work_id, section, g, sum(words) AS size FROM walk GROUP BY ALL),
lst AS (SELECT work_id, section, max(g) AS mg, arg_max(size, g) AS ms FROM sz GROUP BY ALL),
merged AS (SELECT walk.work_id, walk.section, index, words, CASE WHEN g = mg AND mg > 0 AND ms < {trailing} THEN g - 1 ELSE g END AS g FROM walk JOIN lst ON lst.work_id = walk.work_id AND lst.section = walk.section)"""


_LN = f"""lines AS (SELECT source AS work_id, doc_id AS section, CAST(i AS BIGINT) AS index, l[i] AS text, {_W('l[i]')} AS words FROM (SELECT source, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE {_W('l[i]')} > 0)"""
_FM = f"WITH RECURSIVE {_LN}, {_folded('lines', 40, 60, 8)}"
_CK = f"{_FM}, ck AS (SELECT m.work_id, m.section, g, string_agg(CAST(m.section AS VARCHAR) || '_p' || CAST(m.index AS VARCHAR), ',' ORDER BY m.index) AS paragraph_ids, string_agg(text, chr(10) || chr(10) ORDER BY m.index) AS text, CAST(sum(m.words) AS BIGINT) AS word_count FROM merged m JOIN lines l ON l.section = m.section AND l.index = m.index GROUP BY ALL)"
ORACLES = {
    "scan_metadata": "SELECT CAST(p_partkey % k AS VARCHAR) AS id, p_name AS title, '1900' AS date, CAST(p_partkey AS INTEGER) AS textorder FROM part, (SELECT count(*) * 4 // 5 + 1 AS k FROM part) QUALIFY row_number() OVER (PARTITION BY p_partkey % k ORDER BY p_partkey DESC) = 1",
    "scan_markup": f"WITH {_L} SELECT work_id, count(CASE WHEN k IN (1, 2, 3) THEN 1 END) AS n_breaks, count(CASE WHEN wrapped AND i % 4 = 0 THEN 1 END) AS n_divs, CAST(1 AS BIGINT) AS n_lines FROM lb GROUP BY work_id UNION ALL SELECT work_id, 0, 0, 1 FROM ls WHERE len(l) = 0",
    "local_name": f"WITH {_L}, t AS (SELECT work_id, unnest(CASE k WHEN 0 THEN ['head'] WHEN 1 THEN ['pb', 'p'] WHEN 2 THEN ['pb', 'p'] WHEN 3 THEN ['pb', 'p'] WHEN 4 THEN ['lg'] ELSE ['p'] END) AS tag FROM lb UNION ALL SELECT work_id, 'p' FROM ls) SELECT work_id, tag, count(*) AS n FROM t GROUP BY ALL",
    "text_required": "SELECT doc_id AS work_id, doc_id % 7 <> 0 AS taken FROM documents",
    "region_order": f"WITH {_L} SELECT work_id, section, index, text FROM par",
    "header_fields": "SELECT doc_id AS work_id, true AS has_text, CASE WHEN doc_id % 10 = 0 THEN 'Du catalogue : ' || source WHEN doc_id % 5 = 0 THEN '' ELSE 'Livre ' || CAST(doc_id AS VARCHAR) || ' de ' || source END AS title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Autre & titre' END AS alt_titles, '19' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS edition_date, 'Tiré de ' || source || ' http://x' AS source_desc FROM documents",
    "page_refs": f"WITH {_L} SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY i) AS nth, num AS number, label AS display FROM lab WHERE k IN (1, 2, 3)",
    "region_blocks": f"WITH {_L} SELECT work_id, section AS block, region, n_paras FROM blk",
    "section_number": f"WITH {_L} SELECT work_id, section, region, label, coalesce(n_paragraphs, 0) AS n_paragraphs FROM sec LEFT JOIN pg USING (work_id, section)",
    "section_label": f"WITH {_L} SELECT work_id, section, div_type, label FROM sec JOIN pg USING (work_id, section)",
    "section_pages": f"WITH {_L} SELECT work_id, section, page_start, page_end FROM pg",
    "drop_empty_sections": f"WITH {_L} SELECT work_id, section, n_paragraphs FROM pg",
    "paragraphs": f"WITH {_L} SELECT work_id, section, index, CAST(work_id AS VARCHAR) || '_p' || CAST(index AS VARCHAR) AS paragraph_id, text, {_W('text')} AS word_count FROM par",
    "page_carry": f"WITH {_L} SELECT work_id, index, page_start, page_end FROM par",
    "corpus_parse": f"WITH {_L} SELECT work_id, count(*) AS n_paragraphs, CAST(sum({_W('text')}) AS BIGINT) AS n_words, count(DISTINCT section) AS n_sections FROM par GROUP BY work_id",
    "ingest_job": f"WITH RECURSIVE {_L}, pw AS (SELECT work_id, section, index, {_W('text')} AS words FROM par), {_folded('pw', 40, 60, 8)} SELECT work_id, count(*) AS n_paragraphs, count(DISTINCT section * 1000000 + g) AS n_chunks, CAST(sum(words) AS BIGINT) AS n_words FROM merged GROUP BY work_id",
    "chunk_greedy": f"WITH RECURSIVE {_LN}, {_folded('lines', 40, 10**9, 8)} SELECT section, index, g FROM walk",
    "chunk_oversize": f"{_FM} SELECT section, index, g FROM walk",
    "chunk_trailing_merge": f"{_FM} SELECT section, index, g FROM merged",
    "chunk_build": f"{_CK} SELECT section, g, paragraph_ids, text, word_count FROM ck",
    "chunk_renumber": f"{_CK} SELECT work_id || '_c' || CAST(row_number() OVER (PARTITION BY work_id ORDER BY section, g) AS VARCHAR) AS chunk_id, section, g FROM ck",
}
