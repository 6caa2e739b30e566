"""French stems: known pairs, and a plain stemmer, letter by letter, on words of every shape."""

import random

from pyspark.sql import functions as F

from quillon.operators import stemming as N

#: Words and stems of the published sample vocabulary (fixed values).
KNOWN = """
continu:continu continua:continu continuait:continu continuant:continu continuation:continu continue:continu continué:continu continuel:continuel
continuelle:continuel continuellement:continuel continuelles:continuel continuels:continuel continuer:continu continuera:continu continuerait:continu
continueront:continu continuez:continu continuité:continu continuons:continuon contorsions:contors contour:contour contournait:contourn contournant:contourn
contourne:contourn contours:contour contractait:contract contracté:contract contractée:contract contracter:contract contractés:contract contractions:contract
contradictoirement:contradictoir contradictoires:contradictoir contraindre:contraindr contraint:contraint contrainte:contraint contraintes:contraint
contraire:contrair contraires:contrair contraria:contrari main:main mains:main maintenaient:mainten maintenait:mainten maintenant:mainten maintenir:mainten
maintenue:maintenu maintien:maintien maintint:maintint maire:mair maires:mair mairie:mair mais:mais maïs:maï maison:maison maisons:maison maistre:maistr
maitre:maitr maître:maîtr maîtres:maîtr maîtresse:maîtress maîtresses:maîtress majesté:majest majestueuse:majestu majestueusement:majestu majestueux:majestu
majeur:majeur majeure:majeur major:major majordome:majordom majordomes:majordom majorité:major majorités:major mal:mal malacca:malacc malade:malad
malades:malad maladie:malad maladies:malad maladive:malad
"""


def test_known_pairs(spark):
    want = dict(p.split(":") for p in KNOWN.split())
    rows = N.stems(spark.createDataFrame([(w,) for w in want], "token string")).collect()
    assert len(rows) == len(want) == 80 and {r.token: r.stem for r in rows} == want


def longest(word, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def plain_stem(word):
    v = set(N.VOWELS)
    # consonantal letters, from left to right; what was read as a vowel before or after isn't read again
    w, i = "", 0
    while i < len(word):
        a, b, c = word[i], word[i + 1 : i + 2], word[i + 2 : i + 3]
        if a in v and b in ("u", "i") and c and c in v:
            w, i = w + a + b.upper() + c, i + 3
        elif a in v and b == "y":
            w, i = w + a + "Y", i + 2
        elif a in "ëï":
            w, i = w + {"ë": "He", "ï": "Hi"}[a], i + 1
        elif a == "y" and b and b in v:
            w, i = w + "Y" + b, i + 2
        elif a == "q" and b == "u":
            w, i = w + "qU", i + 2
        else:
            w, i = w + a, i + 1
    n = len(w)
    if n > 2 and w[0] in v and w[1] in v or w[:3] in N.SHORT:
        pv = 3
    else:
        pv = next((j + 1 for j in range(1, n) if w[j] in v), n)

    def region(start):
        for j in range(start + 1, n):
            if w[j] not in v and any(x in v for x in w[start:j]):
                return j + 1
        return n

    p1 = region(0)
    p2 = region(p1) if p1 < n else n
    done = False
    s = longest(w, N.STANDARD)
    b = w[: len(w) - len(s)]
    k = len(b)

    def drop(x, end, least):
        return x[: -len(end)] if x.endswith(end) and len(x) - len(end) >= least else None

    def first(*options):
        return next(o for o in options if o is not None)

    def put(x, end, other):
        return x[: -len(end)] + other if x.endswith(end) else None

    if s in N.NOUNS and k >= p2:
        w, done = b, True
    elif s in N.ATIONS and k >= p2:
        w, done = first(drop(b, "ic", p2), put(b, "ic", "iqU"), b), True
    elif s in N.LOGIES and k >= p2:
        w, done = b + "log", True
    elif s in N.UTIONS and k >= p2:
        w, done = b + "u", True
    elif s in N.ENCES and k >= p2:
        w, done = b + "ent", True
    elif s in N.EMENTS and k >= pv:
        done, w = True, b
        if drop(b, "iv", p2) is not None:
            c = drop(b, "iv", p2)
            w = first(drop(c, "at", p2), c)
        elif b.endswith("eus"):
            w = first(drop(b, "eus", p2), put(b, "eus", "eux") if k - 3 >= p1 else None, b)
        elif b.endswith(("abl", "iqU")):
            w = first(drop(b, b[-3:], p2), b)
        elif b.endswith(("ièr", "Ièr")) and k - 3 >= pv:
            w = b[:-3] + "i"
    elif s in N.ITES and k >= p2:
        w, done = first(drop(b, "abil", p2), put(b, "abil", "abl"), drop(b, "ic", p2), put(b, "ic", "iqU"), drop(b, "iv", p2), b), True
    elif s in N.IFS and k >= p2:
        c = drop(b, "at", p2)
        w, done = b if c is None else first(drop(c, "ic", p2), put(c, "ic", "iqU"), c), True
    elif s == "eaux":
        w, done = b + "eau", True
    elif s == "aux" and k >= p1:
        w, done = b + "al", True
    elif s in N.EUSES and k >= p1:
        w, done = b if k >= p2 else b + "eux", True
    elif s in N.ISSEMENTS and k >= p1 and b and b[-1] not in v:
        w, done = b, True
    elif s in ("amment", "emment") and k >= pv:
        w = b + s[0] + "nt"
    elif s in N.MENTS and b and b[-1] in v and k - 1 >= pv:
        w = b
    if not done:
        s = longest(w[pv:], N.I_VERBS)
        r = w[pv : len(w) - len(s)]
        if s and r and r[-1] not in v and r[-1] != "H":
            w, done = w[: -len(s)], True
    if not done:
        s = longest(w[pv:], ("ions", *N.ER_VERBS, *N.A_VERBS))
        if s and (s != "ions" or len(w) - 4 >= p2):
            w, done = w[: -len(s)], True
            if s in N.A_VERBS and w[pv:].endswith("e"):
                w = w[:-1]
    if done:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and len(w) > 1 and (w[:-1].endswith("Hi") or w[-2] not in N.KEEP_S):
            w = w[:-1]
        s = longest(w[pv:], N.RESIDUAL)
        if s == "ion" and len(w) - 3 >= p2 and w[pv:-3].endswith(("s", "t")):
            w = w[:-3]
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(s)] + "i"
        elif s == "e":
            w = w[:-1]
    if w.endswith(N.DOUBLES):
        w = w[:-1]
    tail = len(w)
    while tail and w[tail - 1] not in v:
        tail -= 1
    if 0 < tail < len(w) and w[tail - 1] in "éè":
        w = w[: tail - 1] + "e" + w[tail:]
    return w.replace("He", "ë").replace("Hi", "ï").replace("H", "").replace("I", "i").replace("U", "u").replace("Y", "y")


def test_equals_a_plain_stemmer(spark, small):
    """Words made of syllables and up to two endings, and all words of the texts."""
    seeded = random.Random(5)
    syllables = ["", "a", "qu", "ou", "par", "jou", "naï", "noë", "pay", "con", "tin", "u", "gra", "tap", "ét", "y", "maj", "cor", "ç", "ss", "bl", "th", "iè", "ô"]
    ends = [*N.STANDARD, *N.INNER, *N.I_VERBS, *N.ER_VERBS, *N.A_VERBS, *N.RESIDUAL, *N.DOUBLES, "ions", "s", "is", "ais", "uy", "uyer", "çant", "eyant", ""]
    made = {"".join(seeded.choices(syllables, k=seeded.randint(0, 4))) + "".join(seeded.choices(ends, k=seeded.randint(1, 2))) for _ in range(30_000)}
    made = {w.lower() for w in made} | {"", "x", "é", "zz", "123", "a_1", "été", "slovo", "слово", "言葉"}
    texts = spark.read.parquet(f"{small}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("w")).distinct().collect()
    words = sorted(made | {r.w for r in texts})
    rows = N.stems(spark.createDataFrame([(w,) for w in words], "token string")).collect()
    assert len(rows) == len(words) > 15_000
    assert [(r.token, r.stem, plain_stem(r.token)) for r in rows if r.stem != plain_stem(r.token)] == []


def test_rows_null_and_clashing_columns(spark):
    """Each row keeps its columns, whatever their names; a name of the result is replaced; null stays null."""
    df = spark.createDataFrame([("maisons", "a", 1, "x"), (None, "b", 2, "y"), ("maisons", "a", 1, "x")], "token string, w string, pv int, stem string")
    rows = sorted(map(tuple, N.stems(df).select("token", "w", "pv", "stem").collect()), key=str)
    assert rows == [("maisons", "a", 1, "maison"), ("maisons", "a", 1, "maison"), (None, "b", 2, None)]
    assert N.stems(df.limit(0)).count() == 0


def test_stems_in_order(spark):
    df = spark.createDataFrame([(1, ["les", "maisons", "les"]), (2, []), (3, None)], "chunk_id int, words array<string>")
    rows = {r.chunk_id: [tuple(t) for t in r.tokens] for r in N.stem_lists(df, F.col("words")).collect()}
    assert rows == {1: [("les", "le"), ("maisons", "maison"), ("les", "le")], 2: [], 3: []}
