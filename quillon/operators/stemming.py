"""French stems of words as column expressions: regions of a word, then ordered steps that strip its suffixes.

Each step is a projection over the one before, so nothing is worked out twice and no Python is run.  ``with_stems`` stems each
distinct word of a table once and joins the stems back; ``stems`` stems each row, for tables that hold few.

Texts whose words are nearly all different have too many of them to be joined back for less than their tokens cost.  ``term_lists`` stems
a batch's distinct words in its own task (``stem_of``, the same steps for one word) and moves nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.ranks import checked, small
from quillon.sources import files

#: Fixed values of the French stemmer: vowels, letters that keep a final s, beginnings with a short region, and suffixes by step.
VOWELS = "aeiouyâàëéêèïîôûù"
KEEP_S = "aiouès"
SHORT = ("par", "col", "tap")
NOUNS = ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes")
ATIONS = ("atrice", "ateur", "ation", "atrices", "ateurs", "ations")
LOGIES = ("logie", "logies")
UTIONS = ("usion", "ution", "usions", "utions")
ENCES = ("ence", "ences")
EMENTS = ("ement", "ements")
ITES = ("ité", "ités")
IFS = ("if", "ive", "ifs", "ives")
EUSES = ("euse", "euses")
ISSEMENTS = ("issement", "issements")
MENTS = ("ment", "ments")
STANDARD = (*NOUNS, *ATIONS, *LOGIES, *UTIONS, *ENCES, *EMENTS, *ITES, *IFS, "eaux", "aux", *EUSES, *ISSEMENTS, "amment", "emment", *MENTS)
INNER = ("iv", "eus", "abl", "iqU", "ièr", "Ièr", "abil", "ic", "at")
I_VERBS = (
    "îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras", "irent", "irez", "iriez", "irions", "irons", "iront",
    "is", "issaIent", "issais", "issait", "issant", "issante", "issantes", "issants", "isse", "issent", "isses", "issez", "issiez", "issions", "issons", "it",
)
ER_VERBS = ("é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez", "eriez", "erions", "erons", "eront", "ez", "iez")
A_VERBS = ("âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse", "assent", "asses", "assiez", "assions")
RESIDUAL = ("ion", "ier", "ière", "Ier", "Ière", "e")
DOUBLES = ("enn", "onn", "ett", "ell", "eill")

#: A word in pieces, in which u, i and y that stand for consonants are found.
PIECES = f"[{VOWELS}]u[{VOWELS}]|[{VOWELS}]i[{VOWELS}]|[{VOWELS}]y|ë|ï|y[{VOWELS}]|qu|(?s:.)"
#: How far a word reaches until the regions begin.
RV, R1, R2 = f"^.[^{VOWELS}]*[{VOWELS}]", f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}]"

#: Rows and bytes of a batch of token lists, and words that a task remembers.
BATCH_ROWS, BATCH_BYTES, WORDS = 1000, 16 << 20, 500_000


def at_end(suffixes: tuple[str, ...]) -> str:
    """A pattern whose leftmost match is the longest of ``suffixes`` at the end."""
    return f"({'|'.join(suffixes)})$"


def _less(x: Column, n: Column | int) -> Column:
    """``x`` without its last ``n`` letters."""
    return F.substring(x, F.lit(1), F.length(x) - n)


def _marked(piece: Column) -> Column:
    """A piece with its consonantal u, i or y in upper case and its diaeresis spelt out."""
    first, last = F.substring(piece, 1, 1), F.substring(piece, 3, 1)
    return (
        F.when(piece == "ë", "He").when(piece == "ï", "Hi").when(F.length(piece) == 1, piece).when(piece == "qu", "qU")
        .when(piece.rlike(f"^[{VOWELS}]u[{VOWELS}]$"), F.concat(first, F.lit("U"), last))
        .when(piece.rlike(f"^[{VOWELS}]i[{VOWELS}]$"), F.concat(first, F.lit("I"), last))
        .when(piece.rlike(f"^[{VOWELS}]y$"), F.concat(first, F.lit("Y")))
        .when(piece.rlike(f"^y[{VOWELS}]$"), F.concat(F.lit("Y"), F.substring(piece, 2, 1)))
        .otherwise(piece)
    )


def _standard() -> tuple[Column, Column]:
    """The word after the first step, from ``w``, its suffix ``s``, the rest ``b`` and the rest's suffix ``t``; and whether the step is done.

    Some suffixes are exchanged without the step being done: verb endings are looked for behind them.
    """
    b, t, size = F.col("b"), F.col("t"), F.length("b")
    inner = size - F.length("t")
    short = _less(b, F.length("t"))
    of = F.col("s").isin
    in_v, in_1, in_2 = size >= F.col("pv"), size >= F.col("p1"), size >= F.col("p2")
    t_v, t_1, t_2 = inner >= F.col("pv"), inner >= F.col("p1"), inner >= F.col("p2")
    last_vowel = b.rlike(f"[{VOWELS}]$")
    put = lambda x, end: F.concat(x, F.lit(end))
    ation = F.when((t == "ic") & t_2, short).when(t == "ic", put(short, "iqU")).otherwise(b)
    ement = (
        F.when((t == "iv") & t_2 & short.endswith("at") & (inner - 2 >= F.col("p2")), _less(short, 2))
        .when(t.isin("iv", "eus", "abl", "iqU") & t_2, short)
        .when((t == "eus") & t_1, put(short, "eux"))
        .when(t.isin("ièr", "Ièr") & t_v, put(short, "i")).otherwise(b)
    )
    ite = F.when(t.isin("abil", "ic", "iv") & t_2, short).when(t == "abil", put(short, "abl")).when(t == "ic", put(short, "iqU")).otherwise(b)
    has_at, has_ic = (t == "at") & t_2, short.endswith("ic")
    ive = F.when(has_at & has_ic & (inner - 2 >= F.col("p2")), _less(short, 2)).when(has_at & has_ic, put(_less(short, 2), "iqU")).when(has_at, short).otherwise(b)
    word = (
        F.when(of(*NOUNS) & in_2, b).when(of(*ATIONS) & in_2, ation).when(of(*LOGIES) & in_2, put(b, "log")).when(of(*UTIONS) & in_2, put(b, "u"))
        .when(of(*ENCES) & in_2, put(b, "ent")).when(of(*EMENTS) & in_v, ement).when(of(*ITES) & in_2, ite).when(of(*IFS) & in_2, ive)
        .when(of("eaux"), put(b, "eau")).when(of("aux") & in_1, put(b, "al")).when(of(*EUSES) & in_2, b).when(of(*EUSES) & in_1, put(b, "eux"))
        .when(of(*ISSEMENTS) & in_1 & ~last_vowel & (size > 0), b)
    )
    behind = F.when(of("amment") & in_v, put(b, "ant")).when(of("emment") & in_v, put(b, "ent")).when(of(*MENTS) & last_vowel & (size - 1 >= F.col("pv")), b)
    return F.coalesce(word, behind, F.col("w")), word.isNotNull()


def stems(words: DataFrame, token: str = "token", name: str = "stem") -> DataFrame:
    """``words`` with ``name``, the stem of the lower-case word ``token``; null stays null, the empty word empty.

    Working columns are kept in a struct of their own, so that other columns of ``words`` may have any name.
    """
    others = F.struct(*[F.col(c) for c in words.columns])
    w = words.select(others.alias("others"), F.col(token).alias("token"))
    pieces = F.regexp_extract_all("token", F.lit(PIECES), F.lit(0))
    w = w.select("others", F.array_join(F.transform(pieces, _marked), "").alias("w"))
    upto = lambda pattern: F.coalesce(F.nullif(F.length(F.regexp_extract("w", pattern, 0)), F.lit(0)), F.length("w"))
    pv = F.when(F.col("w").rlike(f"^(?:[{VOWELS}]{{2}}.|{'|'.join(SHORT)})"), 3).otherwise(upto(RV))
    w = w.select("others", "w", pv.alias("pv"), upto(R1).alias("p1"), upto(R2).alias("p2"), F.regexp_extract("w", at_end(STANDARD), 1).alias("s"))
    w = w.withColumn("b", _less(F.col("w"), F.length("s")))
    w = w.withColumn("t", F.regexp_extract("b", at_end(INNER), 1))
    after, done = _standard()
    w = w.select("others", "pv", "p2", after.alias("w"), done.alias("done"))
    # verb endings, with all that they ask for, lie within the first region
    w = w.withColumn("r", F.substring("w", F.col("pv") + 1, F.length("w")))
    w = w.withColumns({"i": F.regexp_extract("r", at_end(I_VERBS), 1), "v": F.regexp_extract("r", at_end(("ions", *ER_VERBS, *A_VERBS)), 1)})
    before_i = F.substring("r", F.length("r") - F.length("i"), F.lit(1))
    i_verb = (F.col("i") != "") & (F.length("r") > F.length("i")) & before_i.rlike(f"[^{VOWELS}H]")
    v, rest = F.col("v"), _less(F.col("w"), F.length("v"))
    e_before = v.isin(*A_VERBS) & (F.length("r") > F.length("v")) & rest.endswith("e")
    verb = F.when(v == "ions", F.when(F.length(rest) >= F.col("p2"), rest)).when(e_before, _less(rest, 1)).when(v != "", rest)
    verb = F.when(i_verb, _less(F.col("w"), F.length("i"))).otherwise(verb)
    w = w.select("others", "pv", "p2", "w", F.when(F.col("done"), F.col("w")).otherwise(verb).alias("found"))
    tidy = F.regexp_replace(F.regexp_replace("found", "Y$", "i"), "ç$", "c")
    no_s = F.when(F.col("w").rlike(f"(?:Hi|[^{KEEP_S}])s$"), _less(F.col("w"), 1)).otherwise(F.col("w"))
    w = w.select("others", "pv", "p2", tidy.alias("found"), no_s.alias("w"))
    w = w.withColumn("r", F.substring("w", F.col("pv") + 1, F.length("w"))).withColumn("s", F.regexp_extract("r", at_end(RESIDUAL), 1))
    cut = _less(F.col("w"), F.length("s"))
    ion = (F.length(cut) >= F.col("p2")) & F.col("r").rlike("[st]ion$")
    left = F.when((F.col("s") == "ion") & ion, cut).when(F.col("s").isin("ier", "ière", "Ier", "Ière"), F.concat(cut, F.lit("i"))).when(F.col("s") == "e", cut).otherwise(F.col("w"))
    w = w.select("others", F.coalesce("found", left).alias("w"))
    w = w.select("others", F.when(F.col("w").rlike(at_end(DOUBLES)), _less(F.col("w"), 1)).otherwise(F.col("w")).alias("w"))
    x = F.regexp_replace("w", f"[éè]([^{VOWELS}]+)$", "e$1")
    for marked, plain in (("He", "ë"), ("Hi", "ï"), ("H", ""), ("I", "i"), ("U", "u"), ("Y", "y")):
        x = F.replace(x, F.lit(marked), F.lit(plain))
    return w.select(*[F.col("others")[c].alias(c) for c in words.columns if c != name], x.alias(name))


def with_stems(rows: DataFrame, name: str = "stem", words: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``name``, the stem of their ``token``; rows without a token go.

    ``words`` holds the tokens of ``rows``, if there is a table that gives them for less than ``rows`` does.

    Each distinct token is stemmed once.  The stems are written and joined back: broadcast if they are found small, else by a
    sort-merge join, which Spark splits where a token is hot.
    """
    known = files.staged(stems((words or rows).where("token is not null").select("token").distinct(), name=name), "stems")
    return rows.join(checked(known), "token")


def stem_lists(chunks: DataFrame, words: Column, key: str = "chunk_id") -> DataFrame:
    """``key, tokens`` with ``words``' words and their stems in order, as ``array<struct<text, stem>>``; empty where there is no word."""
    known = with_stems(chunks.select(key, F.posexplode(words).alias("at", "token")))
    lists = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("token").alias("text"), "stem"))).alias("tokens"))
    lists = lists.select(key, F.transform("tokens", lambda x: F.struct(x["text"].alias("text"), x["stem"].alias("stem"))).alias("tokens"))
    none = F.array().cast("array<struct<text:string,stem:string>>")
    return chunks.select(key).join(lists.hint("merge"), key, "left").select(key, F.coalesce("tokens", none).alias("tokens"))


def _ending(suffixes: tuple[str, ...]) -> Callable[[str], str]:
    """The longest of ``suffixes`` at the end of a word."""
    known = frozenset(suffixes)
    # lengths of those that end in a letter, the longest first
    lengths = {c: sorted({len(s) for s in suffixes if s[-1] == c}, reverse=True) for c in {s[-1] for s in suffixes}}

    def ending(x: str) -> str:
        for n in lengths.get(x[-1:], ()):
            if x[-n:] in known:
                return x[-n:]
        return ""

    return ending


_standard_of, _inner_of, _i_verb_of, _verb_of, _residual_of = map(_ending, (STANDARD, INNER, I_VERBS, ("ions", *ER_VERBS, *A_VERBS), RESIDUAL))
_pieces, _three, _rv, _r1, _r2 = map(re.compile, (PIECES.removesuffix("|(?s:.)"), f"[{VOWELS}]{{2}}.|{'|'.join(SHORT)}", RV, R1, R2))
_accent = re.compile(f"[éè]([^{VOWELS}]+)$")
_vowels, _a_verbs = frozenset(VOWELS), frozenset(A_VERBS)
_special, _marks = re.compile("[uiyëï]"), re.compile("[HIUY]")
_step = {s: step for step in (NOUNS, ATIONS, LOGIES, UTIONS, ENCES, EMENTS, ITES, IFS, EUSES, ISSEMENTS, MENTS) for s in step}


def _mark(m: re.Match) -> str:
    p = m[0]
    if p == "ë" or p == "ï":
        return "He" if p == "ë" else "Hi"
    if p == "qu":
        return "qU"
    if len(p) == 3:
        return p[0] + p[1].upper() + p[2]
    return p[0] + "Y" if p[1] == "y" and p[0] in _vowels else "Y" + p[1]


def _standard_of_word(w: str, pv: int, p1: int, p2: int) -> tuple[str, bool]:
    """``_standard`` for one word."""
    s = _standard_of(w)
    if not s:
        return w, False
    b, step = w[: len(w) - len(s)], _step.get(s)
    k = len(b)
    t = _inner_of(b)
    j = k - len(t)
    c = b[:j]
    if step is NOUNS and k >= p2:
        return b, True
    if step is ATIONS and k >= p2:
        return (c if j >= p2 else c + "iqU") if t == "ic" else b, True
    if step is LOGIES and k >= p2:
        return b + "log", True
    if step is UTIONS and k >= p2:
        return b + "u", True
    if step is ENCES and k >= p2:
        return b + "ent", True
    if step is EMENTS and k >= pv:
        if t == "iv" and j >= p2 and c.endswith("at") and j - 2 >= p2:
            return c[:-2], True
        if t in ("iv", "eus", "abl", "iqU") and j >= p2:
            return c, True
        if t == "eus" and j >= p1:
            return c + "eux", True
        return c + "i" if t in ("ièr", "Ièr") and j >= pv else b, True
    if step is ITES and k >= p2:
        if t in ("abil", "ic", "iv") and j >= p2:
            return c, True
        return c + "abl" if t == "abil" else c + "iqU" if t == "ic" else b, True
    if step is IFS and k >= p2:
        if t != "at" or j < p2:
            return b, True
        if not c.endswith("ic"):
            return c, True
        return c[:-2] if j - 2 >= p2 else c[:-2] + "iqU", True
    if s == "eaux":
        return b + "eau", True
    if s == "aux" and k >= p1:
        return b + "al", True
    if step is EUSES and k >= p1:
        return b if k >= p2 else b + "eux", True
    if step is ISSEMENTS and k >= p1 and b and b[-1] not in _vowels:
        return b, True
    if s in ("amment", "emment") and k >= pv:
        return b + s[0] + "nt", False
    if step is MENTS and b and b[-1] in _vowels and k - 1 >= pv:
        return b, False
    return w, False


def stem_of(word: str) -> str:
    """The stem of one lower-case word, as ``stems`` gives it."""
    w = _pieces.sub(_mark, word) if _special.search(word) else word
    n = len(w)
    pv = 3 if _three.match(w) else m.end() if (m := _rv.match(w)) else n
    p1 = m.end() if (m := _r1.match(w)) else n
    p2 = m.end() if p1 < n and (m := _r2.match(w)) else n
    w, done = _standard_of_word(w, pv, p1, p2)
    if not done:
        r = w[pv:]
        i = _i_verb_of(r)
        if i and len(r) > len(i) and r[-len(i) - 1] not in _vowels and r[-len(i) - 1] != "H":
            w, done = w[: -len(i)], True
        elif v := _verb_of(r):
            rest = w[: -len(v)]
            if v != "ions":
                w, done = rest[:-1] if v in _a_verbs and len(r) > len(v) and rest.endswith("e") else rest, True
            elif len(rest) >= p2:
                w, done = rest, True
    if done:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and (w.endswith("His") or w[-2] not in KEEP_S):
            w = w[:-1]
        r = w[pv:]
        s = _residual_of(r)
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= p2 and r.endswith(("sion", "tion")) else w
        elif s == "e":
            w = w[:-1]
        elif s:
            w = w[: -len(s)] + "i"
    if w.endswith(DOUBLES):
        w = w[:-1]
    if "é" in w or "è" in w:
        w = _accent.sub(r"e\1", w)
    if _marks.search(w):
        w = w.replace("He", "ë").replace("Hi", "ï").replace("H", "").replace("I", "i").replace("U", "u").replace("Y", "y")
    return w


def bounded_batches(spark: SparkSession) -> None:
    """Batches of token lists are bounded in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Remembered:
    """``of`` each word, worked out once for a task; what is remembered is bounded."""

    def __init__(self, of: Callable, most: int = WORDS):
        self.of, self.most, self.known = of, most, {}

    def __call__(self, words: list[str]) -> list:
        if len(self.known) > self.most:
            self.known = {}
        known, of, out = self.known, self.of, []
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = of(w)
            out.append(x)
        return out


#: Signs among which Python's words are those of ``T.TOKEN``, whatever versions of Unicode the two know; other texts are split by Spark.
_KNOWN = "[^\\x{0000}-\\x{024F}\\x{2000}-\\x{206F}]"
_words = re.compile(r"\w+")


def texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, tokens`` for ``listed``: lower-case texts, and the tokens instead of those whose signs are not all known."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    other = low.rlike(_KNOWN)
    return rows.select(key, F.when(~other, low).alias("text"), F.when(other, T.tokens(F.col(text))).alias("tokens"))


def placed(batch: pa.RecordBatch, of: Callable) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """Of all rows of ``texts``: their numbers of tokens; what ``of`` gives for the distinct tokens; and for each token its row, and its place among these."""
    lists = [_words.findall(t) if t is not None else w for t, w in zip(*(batch.column(c).to_pylist() for c in ("text", "tokens")))]
    sizes = np.array([len(x) for x in lists], np.int64)
    held: dict[str, int] = {}
    place = np.fromiter((held.setdefault(w, len(held)) for x in lists for w in x), np.int64, int(sizes.sum()))
    return sizes, of(list(held)), np.repeat(np.arange(len(sizes)), sizes), place


def listed(batch: pa.RecordBatch, of: Remembered) -> tuple[pa.Array, np.ndarray, list, np.ndarray, np.ndarray]:
    """Of the rows of ``texts`` with a word: their keys, and what ``placed`` gives."""
    sizes, found, row, place = placed(batch, of)
    some = sizes > 0
    return batch.column(0).filter(pa.array(some)), sizes[some], found, (np.cumsum(some) - 1)[row], place


#: Lemma and part of speech of a token.
LEMMAS = "array<struct<text:string,lemma:string,pos:string>>"


def lemma_lists(chunks: DataFrame, lexicon: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, tokens``: for each row its tokens in order as ``LEMMAS``, by ``lexicon(form, lemma, pos)`` with a row for each form.

    Forms that the lexicon doesn't have are their own lemma, of part of speech ``X``.  No token is moved: a small lexicon goes to all
    tasks; of a larger one each row gets what it has of the row's distinct words.
    """
    bounded_batches(chunks.sparkSession)
    lexicon = files.staged(lexicon.select("form", "lemma", "pos"), "lexicon")
    rows = texts(chunks, key, text)
    entries = None
    if small(lexicon):
        entries = {r.form: (r.lemma, r.pos) for r in lexicon.collect()}
    else:
        by = f"{key}_asked"
        asked = chunks.select(F.col(key).alias(by), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("form")).distinct()
        known = asked.join(lexicon.hint("merge"), "form").groupBy(by).agg(F.collect_list(F.struct("form", "lemma", "pos")).alias("known"))
        rows = rows.join(known.hint("merge"), F.col(key).eqNullSafe(F.col(by)), "left").drop(by)

    def looked_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            # what the lexicon has of a row's words holds for the others of its batch
            have = entries if entries is not None else {x["form"]: (x["lemma"], x["pos"]) for known in batch.column("known").to_pylist() for x in known or ()}
            sizes, forms, _, place = placed(batch, list)
            found = [have.get(w, (None, None)) for w in forms]
            columns = forms, [x[0] if x[0] is not None else w for x, w in zip(found, forms)], [x[1] if x[1] is not None else "X" for x in found]
            tokens = pa.StructArray.from_arrays([pa.array(c, pa.string()).take(pa.array(place)) for c in columns], names=["text", "lemma", "pos"])
            at = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), tokens)], names=[key, "tokens"])

    return rows.mapInArrow(looked_up, f"{key} {chunks.schema[key].dataType.simpleString()}, tokens {LEMMAS}")


def term_lists(chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """``key, size, terms``: for each row with a token the number of its tokens and its distinct stems, ``array<struct<term, tf>>``; nothing is moved."""
    bounded_batches(chunks.sparkSession)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Remembered(stem_of)
        for batch in it:
            keys, sizes, stems, row, word = listed(batch, of)
            stems = pa.array(stems, pa.string()).dictionary_encode()
            held, tf = np.unique(row << 32 | stems.indices.to_numpy(zero_copy_only=False)[word], return_counts=True)
            pairs = pa.StructArray.from_arrays([stems.dictionary.take(pa.array(held & 0xFFFFFFFF)), pa.array(tf)], names=["term", "tf"])
            at = np.append(0, np.cumsum(np.bincount(held >> 32, minlength=len(sizes)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), pairs)], names=[key, "size", "terms"])

    return texts(chunks, key, text).mapInArrow(counted, f"{key} {chunks.schema[key].dataType.simpleString()}, size bigint, terms array<struct<term:string,tf:bigint>>")
