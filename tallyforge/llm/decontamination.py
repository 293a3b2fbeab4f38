"""Operator 5: find benchmark items in documents by template windows.

Texts are brought to templates: numbers (digits or number words), units after a number
and capitalised words inside a sentence become typed placeholders, everything else loses
its punctuation and upper case. Windows of six template words are hashed and joined with
the benchmark's windows. A window whose placeholders have the item's own values always
counts. Where the other windows line up, each value of the item must become one value of
the document, so that a re-parameterised question is caught; windows that hold an item's
value for which the document has several don't count. A window with fewer than three
plain words counts by its own words, not by its placeholders.

A document holds an item if at least half of the item's windows, or eight of them, are
found consistently. Items shorter than a window are looked for as a whole; in these a
capitalised first word of a sentence is a placeholder too, and two plain words are
enough. An item of one word is held only by a document of that one word.

All lengths of items are found in one pass over the documents: a row holds the up to six
words from one position on, and nothing else of its text.

Defined cases: null and wordless texts hold nothing and are held by nothing; very long
texts are searched whole; a window that occurs in several items or several times counts
for each; repeated rows of one id count as one document; a null id is kept as such; an
empty table on either side gives an empty result; columns beyond those named are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import stash, table

WINDOW = 6
#: Plain words that a window, and an item shorter than a window, must have to count by its placeholders.
PLAIN, SHORT_PLAIN = 3, 2
SHARE = 0.5
ENOUGH = 8
#: Benchmarks with up to this many windows (16 bytes each) are broadcast, larger ones are joined by shuffling.
BROADCAST_WINDOWS = 500_000

# Units that are recognised after a number, and number words, in English, German, French and Spanish.
UNITS = (
    "kg g mg lb lbs oz t km m cm mm mi mile miles ft feet in inch inches l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur degree degrees mph kmh kph "
    "kilometer meter stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate jahr jahre jahren prozent grad "
    "kilomètre kilomètres mètre mètres heure heures jour jours semaine semaines mois an ans année années pour degrés "
    "kilómetro kilómetros metro metros hora horas minuto minutos día días semana semanas mes meses año años grados"
).split()
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cien mil"
).split()
NAME, NUMBER, UNIT, START = "\u0001", "\u0002", "\u0003", "\u0004"
MARKS = f"[{NAME}-{UNIT}]"


def marked(text: Column, starts: bool) -> Column:
    """The text's words in lower case without punctuation; words that are slots begin with their type's mark.

    With ``starts``, a capitalised word that begins a sentence has a mark of its own.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}-{START}]", " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu}\p{Ll})", NAME)
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(?=\p{N})", NUMBER)
    if starts:
        t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{NAME}{NUMBER}])", START)
    t = F.regexp_replace(t, rf"(?i)(?<=\p{{N}})( ?)(?=(?:{'|'.join(UNITS)}|[%°])(?![\p{{L}}\p{{N}}]))", f" {UNIT}")
    t = F.regexp_replace(t, rf"(?<=\p{{N}})[.,](?=\p{{N}})|[^\p{{L}}\p{{N}}\s%°{NAME}-{START}]+", "")
    words = F.array_remove(F.split(F.lower(t), r"\s+"), "")
    spoken = {*NUMBER_WORDS, *(START + w for w in NUMBER_WORDS)}
    return F.transform(words, lambda w: F.when(w.isin(*sorted(spoken)), F.concat(F.lit(NUMBER), F.ltrim(w, F.lit(START)))).otherwise(w))


def own_words(size: int, n: int, starts: bool) -> list[Column]:
    """A window's words; long windows take a sentence's first word as it is, short ones as a name."""
    w = [F.col(f"w{i}") for i in range(size)]
    if not starts:
        return w
    first = [F.startswith(x, F.lit(START)) for x in w]
    return [F.when(f, F.substr(x, F.lit(2)) if size == n else F.concat(F.lit(NAME), F.substr(x, F.lit(2)))).otherwise(x) for x, f in zip(w, first)]


def window_hash(size: int, n: int, starts: bool) -> Column:
    """Hash of the template of ``size`` words, or of the words themselves where too few are plain; null where the text ends before."""
    own = own_words(size, n, starts)
    slot = [w < START for w in own]
    plain = sum((~s).cast("int") for s in slot)
    plan = [F.when(s, F.substring(w, 1, 1)).otherwise(w) for s, w in zip(slot, own)]
    h = F.when(plain >= (PLAIN if size == n else SHORT_PLAIN), F.xxhash64(*plan)).otherwise(F.xxhash64(F.lit("own"), *own))
    fits = F.col(f"w{size - 1}").isNotNull()
    return F.when(fits & (F.col("n_words") == 1) if size == 1 else fits, h)


def template_windows(df: DataFrame, key: str, text_col: str, sizes: list[int], n: int) -> DataFrame:
    """(key, n_words, pos, w0.., size, h): for every position of each text and every size, the hash of the template of that many
    words from there on; w0 to w(n-1) are the words there, with their marks."""
    d = df.select(F.col(key).alias("key"), marked(F.col(text_col), sizes[0] < n).alias("raw"))
    shifted = [F.slice("raw", i + 1, F.greatest(F.size("raw") - i, F.lit(0))).alias(f"w{i}") for i in range(n)]
    d = d.select("key", F.size("raw").alias("n_words"), F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    own = ["key", "n_words", "pos", *[f"w{i}" for i in range(n)]]
    d = d.select("key", "n_words", "pos", "w.*")
    starts = sizes[0] < n
    if len(sizes) == 1:
        return d.select(*own, F.lit(sizes[0]).alias("size"), window_hash(sizes[0], n, starts).alias("h")).where("h IS NOT NULL")
    of = F.array(*[F.struct(F.lit(s).alias("size"), window_hash(s, n, starts).alias("h")) for s in sizes])
    return d.select(*own, F.inline(of)).where("h IS NOT NULL")


def words_of(sizes: list[int], n: int) -> Column:
    """The words of a window of its row's size."""
    starts = sizes[0] < n
    got = F.array(*own_words(sizes[-1], n, starts))
    for s in sizes[:-1]:
        got = F.when(F.col("size") == s, F.array(*own_words(s, n, starts))).otherwise(got)
    return got


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, exact) for every document that holds an item."""
    items = bench.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = items.withColumn("n_words", F.size(marked(F.col("text"), False))).where("n_words > 0")
    sizes = sorted({min(r[0], n) for r in items.select(F.least("n_words", F.lit(n))).distinct().collect()}) or [n]
    b = template_windows(items.select("item", "text"), "item", "text", sizes, n).where(F.col("size") == F.least("n_words", F.lit(n)))
    b = stash(b.select(F.col("key").alias("item"), F.col("pos").alias("item_pos"), "size", "h", words_of(sizes, n).alias("item_words")), "op5-bench")
    known = b.select("size", "h").distinct()
    if b.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    hits = template_windows(docs, id_col, text_col, sizes, n).join(known, ["size", "h"], "left_semi")
    hits = hits.select("key", "pos", "size", "h", words_of(sizes, n).alias("doc_words")).join(b, ["size", "h"])
    return judged(stash(hits, "op5-hits"), items, n)


def judged(hits: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Slot consistency by alignment, then coverage by document and item; exact if no window of a counted alignment differs."""
    at = ["key", "item", "shift"]
    slots = F.filter(F.arrays_zip(F.col("item_words").alias("i"), F.col("doc_words").alias("d")), lambda z: F.regexp_like(z["i"], F.lit(f"^{MARKS}")))
    hits = hits.select("key", "item", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), slots.alias("slots"))
    hits = hits.withColumn("differs", F.exists("slots", lambda z: z["i"] != z["d"]))
    seen = hits.where("differs").select(*at, F.explode("slots").alias("z")).select(*at, "z.i", "z.d").distinct()
    per = seen.groupBy(*at, "i").agg(F.count("*").alias("k")).groupBy(*at).agg(F.collect_list(F.when(F.col("k") > 1, F.col("i"))).alias("torn"))
    per = per.select(F.col("key").alias("k0"), F.col("item").alias("i0"), F.col("shift").alias("s0"), "torn")
    x = hits.join(per, F.col("key").eqNullSafe(F.col("k0")) & F.col("item").eqNullSafe(F.col("i0")) & (F.col("shift") == F.col("s0")), "left")
    x = x.where(~F.col("differs") | ~F.exists("slots", lambda z: F.array_contains("torn", z["i"])))
    x = x.groupBy("key", "item").agg(F.count_distinct("item_pos").alias("n_windows"), F.bool_and(F.col("s0").isNull()).alias("exact"))
    total = items.groupBy("item").agg(F.max(F.greatest(F.col("n_words") - (n - 1), F.lit(1))).alias("total"))
    x = x.join(total.withColumnRenamed("item", "i1"), F.col("item").eqNullSafe(F.col("i1")))
    x = x.withColumn("coverage", F.col("n_windows") / F.col("total"))
    return x.where((F.col("coverage") >= SHARE) | (F.col("n_windows") >= ENOUGH)).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", F.round("coverage", 6).alias("coverage"), "exact")


def without_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    leaks = stash(find_leaks(docs, bench, id_col, text_col).select(F.col("doc_id").alias("_leak")).distinct(), "op5-leaks")
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["_leak"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
