"""Encoded books to works, sections and paragraphs, as windows over an ordered stream of tokens.

A file is one row; its tags and texts become numbered rows, and depth, region, block, paragraph and page are running values
over them.  Files must be well formed.  Pages are named in the order of the file; sections, paragraphs and the page carried from
one to the next go through front, body and back, in whatever order the file has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

REGIONS = ("front", "body", "back")
PARAGRAPHS = ("p", "lg", "l")
#: Section labels by division type (fixed values).
KINDS = {"chapter": "Chapitre", "art": "Article", "conf": "Conférence", "app": "Appendice", "conclusion": "Conclusion", "discours": "Discours", "essai": "Essai", "notice": "Notice", "preface": "Préface", "avant-propos": "Avant-propos"}
NO_PAGE = "page non numérotée"
#: Tags of editorial content (fixed values).
EDITORIAL = ("note", "quote", "cit", "q", "bibl")


#: The namespace of the markup (fixed value); a work that declares none for its names is read by local names.
NAMESPACE = "http://www.tei-c.org/ns/1.0"
#: What stands in a tag after its name: quoted values of both kinds may hold any sign but their quote.
_REST = r"""[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+"""
_PARTS = rf"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^<>\[\]"']|"[^"]*+"|'[^']*+'|\[[^\]]*+\])*+>|<(?![!?]){_REST}>|<[^<>]+>|[^<]+"""
_PREFIX = r"(?:[^\s:/<>]+:)?"


#: What is known of a token in the end.
MARKED = ("work_id", "i", "tok", "tag", "region", "kind", "block", "is_div", "is_pb", "page_no", "label", "page", "in_para", "para_no", "in_head", "head_no")


def read_works(spark: SparkSession, path: str, between: str | None = None) -> DataFrame:
    """``path, markup``: one row for each file, or for each work of files that hold many, parted by the sign ``between``."""
    kind = {"lineSep": between} if between else {"wholetext": True}
    return spark.read.text(path, **kind).select(F.input_file_name().alias("path"), F.col("value").alias("markup"))


def local_name(tag: Column) -> Column:
    """The name of a start or end tag without brackets, prefix and attributes."""
    return F.regexp_extract(tag, r"^</?(?:[^\s:/>]+:)?([^\s/>]+)", 1)


def parts(markup: Column) -> Column:
    """Tags and texts of a work in order, without comments, instructions and declarations; CDATA sections become texts with named entities."""
    found = F.filter(F.regexp_extract_all(markup, F.lit(_PARTS), F.lit(0)), lambda t: ~(t.startswith("<!--") | t.startswith("<?") | (t.startswith("<!") & ~t.startswith("<![CDATA["))))

    def text(t: Column) -> Column:
        t = F.substr(t, F.lit(10), F.length(t) - 12)
        return F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    return F.transform(found, lambda t: F.when(t.startswith("<![CDATA["), text(t)).otherwise(t))


def foreign(markup: Column) -> Column:
    """Prefixes that a work declares for another namespace than ``NAMESPACE``; names with them are no names of the markup."""
    declared = rf"""\sxmlns:([^\s=]+)\s*=\s*(?!["']{NAMESPACE.replace(".", "[.]")}["'])["']"""
    return F.array_distinct(F.regexp_extract_all(markup, F.lit(declared), F.lit(1)))


def plain(x: Column) -> Column:
    """Text with numeric character references and the five named entities resolved, each once."""
    refs = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1)))

    def sign(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int")
        # only what is a character: no surrogates, nothing beyond the last plane
        real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    x = F.when(x.contains("&#"), F.aggregate(refs, x, lambda done, r: F.replace(done, r, sign(r)))).otherwise(x)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
    return x


def token_stream(works: DataFrame) -> DataFrame:
    """``work_id, i, tok, tag, starts, closes, depth``: tags and texts in order, without comments, scripts and styles.

    ``depth`` is the number of open elements after the token.  What stands in character data is text, a script's tags too.
    """
    without = lambda x, tag: F.regexp_replace(x, rf"(?s)(<!\[CDATA\[.*?\]\]>)|(?i)<{tag}\b.*?</{tag}>", "$1")
    body = F.when(F.col("markup").rlike(r"(?i)<(?:script|style)\b"), without(without(F.col("markup"), "script"), "style")).otherwise(F.col("markup"))
    # whole works move, their tokens stay where their works are
    t = works.select("work_id", foreign(F.col("markup")).alias("others"), body.alias("body")).repartition("work_id").select("work_id", "others", F.posexplode(parts(F.col("body"))).alias("i", "tok"))
    is_tag = F.col("tok").startswith("<")
    closes = F.col("tok").startswith("</")
    alone = F.col("tok").endswith("/>") & is_tag
    t = t.withColumns({"tag": F.when(is_tag, _name(F.col("tok"), F.col("others"))), "closes": closes, "alone": alone, "starts": is_tag & ~closes}).drop("others")
    step = F.when(F.col("starts") & ~F.col("alone"), 1).when(F.col("closes"), -1).otherwise(0)
    return t.withColumn("depth", F.sum(step).over(Window.partitionBy("work_id").orderBy("i")))


def _name(tag: Column, others: Column) -> Column:
    """The local name, or the whole one if its prefix is that of another namespace."""
    prefix = F.regexp_extract(tag, r"^</?([^\s:/>]+):", 1)
    return F.when((prefix != "") & F.array_contains(others, prefix), F.regexp_extract(tag, r"^</?([^\s/>]+)", 1)).otherwise(local_name(tag))


def attribute(name: str) -> Column:
    """The value of the tag ``tok``'s attribute, quoted either way, references resolved; empty if there is none."""
    found = lambda quote: F.regexp_extract("tok", rf"""^<[^\s/>]+(?:\s+[^\s=<>"']+\s*=\s*(?:"[^"]*+"|'[^']*+'))*?\s+{name}\s*=\s*{quote}([^{quote}]*+){quote}""", 1)
    return plain(F.coalesce(F.nullif(found('"'), F.lit("")), found("'")))


def annotated(stream: DataFrame) -> DataFrame:
    """The stream with region, block number, paragraph and head numbers, and pages."""
    w = Window.partitionBy("work_id").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("depth") + F.when(F.col("alone") | F.col("closes"), 1).otherwise(0)
    t = stream.withColumn("own", own).withColumn("base", F.min(F.when((F.col("tag") == "text") & F.col("starts"), F.col("own"))).over(Window.partitionBy("work_id")))
    at = F.col("own") - F.col("base")
    new_region = F.col("starts") & (at == 1) & F.col("tag").isin(*REGIONS)
    t = t.withColumn("region", F.last(F.when(new_region, F.col("tag")).when(F.col("closes") & (at <= 1), ""), ignorenulls=True).over(upto))
    # breaks inside a paragraph are no children, so the last child is still the paragraph
    is_pb = F.col("starts") & (F.col("tag") == "pb") & (F.col("depth") >= F.col("base"))
    t = t.withColumns({"new_region": new_region, "is_pb": is_pb}).withColumn("page_no", F.when(F.col("is_pb") & attribute("n").rlike("^[0-9]+$"), attribute("n").cast("bigint")))
    # a frame that ends with the work is read anew for each row, one that begins with it is not: what follows is read backwards
    after = Window.partitionBy("work_id").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    prior, later = F.last("page_no", ignorenulls=True).over(before), F.last("page_no", ignorenulls=True).over(after)
    t = t.withColumns({"prior": prior, "later": later})
    a, b = F.col("prior").cast("string"), F.col("later").cast("string")
    between = F.when(F.col("prior").isNotNull() & F.col("later").isNotNull(), F.concat(F.lit("entre les p. "), a, F.lit(" et "), b)).when(F.col("later").isNotNull(), F.concat(F.lit("avant la p. "), b)).when(F.col("prior").isNotNull(), F.concat(F.lit("après la p. "), a)).otherwise(NO_PAGE)
    t = t.withColumn("label", F.when(F.col("is_pb"), F.coalesce(F.col("page_no").cast("string"), between)))
    # from here on the order is that of the regions
    place = F.coalesce(F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region")), F.lit(0))
    t = t.withColumn("i", F.shiftleft(place.cast("bigint"), 40) + F.col("i"))
    inside = F.col("region").isin(*REGIONS)
    div = F.col("tag").isNotNull() & (F.col("tag") == "div") & (at == 2) & inside
    t = t.withColumns({"is_div": div & F.col("starts"), "end_div": div & F.col("closes")})
    t = t.withColumn("in_div", F.sum(F.when(F.col("is_div"), 1).when(F.col("end_div"), -1).otherwise(0)).over(upto))
    child = F.col("starts") & inside & ~F.col("new_region") & ~F.col("is_div") & (F.col("own") - F.col("base") == 2 + F.col("in_div"))
    kind = F.when(F.col("new_region"), "region").when(F.col("is_div"), "div").when(child & F.col("tag").isin(*PARAGRAPHS), "para").when(child & F.col("tag").isin("head", "pb"), F.col("tag")).when(child, "other")
    t = t.withColumn("kind", kind)
    top = F.when((F.col("in_div") == 0) | F.col("is_div") | F.col("new_region"), F.col("kind"))
    t = t.withColumn("top", top)
    t = t.withColumns({
        "last_top": F.last("top", ignorenulls=True).over(before),
        "last_edge": F.last(F.when(F.col("top").isin("region", "div", "head"), F.col("i")), ignorenulls=True).over(before),
        "last_para": F.last(F.when(F.col("top") == "para", F.col("i")), ignorenulls=True).over(before),
    })
    loose = F.col("top").isNotNull() & ~F.col("top").isin("region", "div")
    opens = F.col("is_div") | (loose & (F.col("last_top").isin("region", "div") | ((F.col("top") == "head") & (F.coalesce("last_para", F.lit(-1)) > F.col("last_edge")))))
    t = t.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(upto))
    t = t.withColumns({
        "para_no": F.sum(F.when(F.col("kind") == "para", 1).otherwise(0)).over(upto),
        "head_no": F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(upto),
        "last_kind": F.last("kind", ignorenulls=True).over(upto),
        "within": F.col("depth") - F.col("base") >= 2 + F.col("in_div"),
    })
    t = t.withColumns({"in_para": (F.col("kind") == "para") | ((F.col("last_kind") == "para") & F.col("within")), "in_head": (F.col("last_kind") == "head") & F.col("within")})
    counts = (F.col("kind") == "pb") | F.col("in_para")
    t = t.withColumn("page", F.last(F.when(F.col("is_pb") & counts, F.col("label")), ignorenulls=True).over(upto))
    return t.select(*MARKED)


def _joined(condition: Column) -> Column:
    """Texts of the tokens that meet ``condition``, in order."""
    rows = F.array_sort(F.collect_list(F.when(condition & F.col("tag").isNull(), F.struct("i", "tok"))))
    return T.clean_text(plain(F.array_join(F.transform(rows, lambda x: x["tok"]), "")))


def paragraphs(marked: DataFrame) -> DataFrame:
    """``work_id, block, index, paragraph_id, text, word_count, page_start, page_end``; empty ones aren't numbered."""
    # by work alone, so that the numbers within a work need no further exchange
    p = marked.where("in_para").select("work_id", "para_no", "block", "i", "tok", "tag", "page").repartition("work_id").groupBy("work_id", "para_no").agg(F.min("block").alias("block"), _joined(F.lit(True)).alias("text"), F.min_by("page", "i").alias("a"), F.max_by("page", "i").alias("b"))
    p = p.where("text <> ''").withColumn("index", F.row_number().over(Window.partitionBy("work_id").orderBy("para_no")).cast("bigint"))
    start = F.coalesce("a", "b", F.lit(NO_PAGE))
    return p.select("work_id", F.col("block").alias("section"), "index", F.concat(F.col("work_id").cast("string"), F.lit("_p"), F.col("index").cast("string")).alias("paragraph_id"), "text", T.word_count(F.col("text")).alias("word_count"), start.alias("page_start"), F.coalesce("b", start).alias("page_end"))


def sections(marked: DataFrame, paras: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``work_id, section, region, div_type, label`` and pages; numbered before the empty ones are dropped."""
    kind = F.when(F.col("is_div"), F.nullif(attribute("type"), F.lit("")))
    b = marked.where("block > 0 and kind is not null and kind <> 'region'").groupBy("work_id", F.col("block").alias("section")).agg(F.min_by("region", "i").alias("region"), F.max(kind).alias("div_type"))
    heads = marked.where("in_head").groupBy("work_id", F.col("block").alias("section"), "head_no").agg(_joined(F.lit(True)).alias("head"))
    heads = heads.groupBy("work_id", "section").agg(F.min_by("head", "head_no").alias("head"))
    b = b.join(heads.hint("merge"), ["work_id", "section"], "left").withColumn("head", F.nullif("head", F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    typed = F.col("head").isNull() & F.col("div_type").isin(*KINDS)
    nth = F.sum(F.when(typed, 1).otherwise(0)).over(Window.partitionBy("work_id", "div_type").orderBy("section"))
    label = F.when(F.col("head").isNotNull(), F.col("head")).when(typed, F.concat(names[F.col("div_type")], F.lit(" "), nth.cast("string"))).otherwise(F.concat(F.lit("Section "), F.col("section").cast("string")))
    pages = paras.groupBy("work_id", "section").agg(F.min_by("page_start", "index").alias("page_start"), F.max_by("page_end", "index").alias("page_end"), F.count("*").alias("n_paragraphs"))
    return b.select("work_id", "section", "region", "div_type", label.alias("label")).join(pages.hint("merge"), ["work_id", "section"], "left" if keep_empty else "inner")


def header(works: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``work_id, has_text, title, alt_titles, edition_date, source_desc`` from the file's header, whatever its prefix.

    A work without a title takes that of ``metadata(work_id, title)`` if it has a row there, else an empty one; a work without a
    header has empty fields.
    """
    whole = F.array_join(parts(F.regexp_extract("markup", rf"(?s)<{_PREFIX}teiHeader[\s>].*?</{_PREFIX}teiHeader\s*>", 0)), "")
    rest = r"""(?:\s[^<>"'/]*+(?:"[^"]*+"[^<>"'/]*+|'[^']*+'[^<>"'/]*+)*+)?"""
    # an empty element in its short form, in the long one
    whole = F.regexp_replace(whole, rf"<{_PREFIX}(title|date|p){rest}/>", "<$1></$1>")
    start, end = (lambda tag: rf"<{_PREFIX}{tag}{rest}>"), (lambda tag: rf"</{_PREFIX}{tag}\s*>")
    bare = lambda x: plain(F.regexp_replace(x, rf"<{_REST}>", ""))
    w = works.select("work_id", F.exists(parts(F.col("markup")), lambda t: t.rlike(rf"^<{_PREFIX}text[\s/>]")).alias("has_text"), whole.alias("h"))
    within = lambda outer: F.regexp_extract("h", rf"(?s){start(outer)}(.*?){end(outer)}", 1)
    titles = F.transform(F.regexp_extract_all(within("titleStmt"), F.lit(rf"(?s){start('title')}(.*?){end('title')}"), F.lit(1)), lambda t: T.clean_text(bare(t)))
    # the date is what stands before any element in it
    date = F.regexp_replace(plain(F.regexp_extract(within("publicationStmt"), rf"{start('date')}([^<]*)", 1)), r"^\s+|\s+$", "")
    source = T.clean_text(bare(F.regexp_extract(within("sourceDesc"), rf"(?s){start('p')}(.*?){end('p')}", 1)))
    w = w.select("work_id", "has_text", titles.alias("t"), date.alias("edition_date"), source.alias("source_desc"))
    other = F.lit("")
    if metadata is not None:
        w = w.join(metadata.select("work_id", F.col("title").alias("other")), "work_id", "left")
        other = F.coalesce("other", F.lit(""))
    title = F.when(F.size("t") > 0, F.col("t")[0]).otherwise(other)
    return w.select("work_id", "has_text", title.alias("title"), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))).alias("alt_titles"), "edition_date", "source_desc")


def with_text(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works that have a text element, and the rejected rest."""
    has = F.exists(parts(F.col("markup")), lambda t: t.rlike(rf"^<{_PREFIX}text[\s/>]"))
    return works.where(has), works.where(~has | F.col("markup").isNull())
