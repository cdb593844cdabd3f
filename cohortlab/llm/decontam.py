"""Benchmark decontamination by template canonicalisation.

Both sides are cut into word tokens in which numbers, names and units are marked as
slots. A template window is a run of tokens whose slots count only by their type, so a
question with other figures or other people has the same windows. Windows are compared
by hash join; then, for each place in a document where an item's windows line up, the
slot values are held against each other: one benchmark value must always stand for the
same document value, and the other way round. Windows with more than half slots carry too little text for that and
are hashed with their values, so that only the very same values match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize, sized, text_key

#: Slot markers (private-use characters): name, number, unit.
NAME, NUMBER, UNIT, END = "\ue000", "\ue001", "\ue002", "\ue003"
#: Unit words that may follow a number.
UNITS = (
    "mm|cm|dm|m|km|in|ft|yd|mi|mg|g|kg|t|oz|lb|lbs|ml|cl|l|s|sec|min|h|hr|hrs|ms|hz|khz|mhz|ghz|w|kw|mw|v|a|j|kj|kcal|cal|pa|kpa|bar|kb|mb|gb|tb|"
    "meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|pounds?|ounces?|tons?|liters?|litres?|gallons?|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|degrees?"
)
#: Words that are no names though sentences begin with them.
OPENERS = (
    "The|A|An|This|That|These|Those|There|It|Its|He|She|They|We|You|I|My|Our|Your|His|Her|Their|In|On|At|By|To|Of|For|From|With|As|If|When|While|After|Before|Since|Until|Because|Although|"
    "And|But|Or|So|Not|No|Yes|Is|Are|Was|Were|Do|Does|Did|Has|Have|Had|Can|Could|Will|Would|Should|Must|May|Let|What|Which|Who|Whom|Whose|Where|Why|How|Each|Every|Some|All|Any|Many|Most|"
    "One|Two|Three|Find|Compute|Calculate|Determine|Solve|Write|Explain|Describe|Choose|Select|Given|Consider|Suppose|Question|Answer|Problem|Example|Note|"
    "Der|Die|Das|Ein|Eine|Wie|Was|Wer|Le|La|Les|Un|Une|Que|Qui|El|Los|Las|Una"
)
#: Items with fewer tokens stand in too many texts: they are only found in texts that are the item.
LEAST_TOKENS = 5
#: Most benchmark windows that are broadcast (about 100 bytes each).
BROADCAST_WINDOWS = 200_000


def _hold(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """Compute `cols` once a row: a generator is a barrier, so that the optimizer does not
    write their expressions into the lambdas that read them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def tokens(text: Column) -> Column:
    """Lower-case tokens, slots led by their marker. A capitalised word is a name, also where a
    sentence begins, but for words that often begin one."""
    t = F.regexp_replace(text, f"[{NAME}-{UNIT}]", " ")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{N}}])(?!(?:{OPENERS})(?![\p{{L}}\p{{M}}\p{{N}}]))", NAME)
    t = F.regexp_replace(t, r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", f"{NUMBER}$0")
    t = F.regexp_replace(t, rf"(?<=\p{{Nd}})[ \t]?(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}]))", f" {UNIT}")
    return F.regexp_extract_all(F.lower(t), F.lit(rf"{NUMBER}\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|[{NAME}{UNIT}]?[\p{{L}}\p{{M}}\p{{N}}]+"), F.lit(0))


def is_slot(t: Column) -> Column:
    return (t >= NAME) & (t < END)


def _token_arrays(df: DataFrame, keep: list[str], text: Column, widths: list[int]) -> DataFrame:
    """keep.. , tok, th (hashes of the tokens, slots by their type), n."""
    tok = _hold(df, keep, tok=tokens(text))
    return _hold(tok, keep, tok=F.col("tok"), th=F.transform("tok", lambda t: F.xxhash64(F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t))), n=F.size("tok")).where(F.col("n") >= min(widths))


def _at_all(widths: list[int], window) -> Column:
    """Array of window(width, place) at all places, for all widths."""

    def of(w: int) -> Column:
        windows = F.greatest(F.col("n") - (w - 1), F.lit(0)) if w >= LEAST_TOKENS else (F.col("n") == w).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.lit(1), windows), lambda i: window(w, i))

    return F.concat(*map(of, widths)) if len(widths) > 1 else of(widths[0])


def template_windows(df: DataFrame, keep: list[str], text: Column, widths: list[int]) -> DataFrame:
    """keep.. , n (tokens), w (width), pos, g (hash of the window's template), h (the same, with the
    values if more than half are slots), slots (its marked values, or null), for all widths at once."""
    arrays = _token_arrays(df, keep, text, widths)
    window = lambda w, i: F.struct(F.lit(w).alias("w"), i.alias("pos"), F.xxhash64(F.lit(w), F.slice("th", i, w)).alias("g"), F.filter(F.slice("tok", i, w), is_slot).alias("slots"))
    rows = _hold(arrays, [*keep, "n"], wins=_at_all(widths, window)).select(*keep, "n", F.inline("wins"))
    rows = rows.withColumn("slots", F.when(F.size("slots") > 0, F.col("slots")))
    return rows.withColumn("h", F.when(is_heavy("slots", F.col("w")), F.xxhash64("g", "slots")).otherwise(F.col("g")))


def template_hashes(df: DataFrame, keep: list[str], text: Column, widths: list[int]) -> DataFrame:
    """keep.. , g of all windows, without their slots."""
    arrays = _token_arrays(df, keep, text, widths)
    return _hold(arrays, keep, wins=_at_all(widths, lambda w, i: F.xxhash64(F.lit(w), F.slice("th", i, w)))).select(*keep, F.explode("wins").alias("g"))


def is_heavy(slots: str, width: Column) -> Column:
    return 2 * F.coalesce(F.size(slots), F.lit(0)) > width


def contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, min_windows: int = 3, consistency: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, benchmark item) that the document contains.

    Columns: id, text_key (md5 of the text), item, windows (distinct template windows of
    the item found), item_windows, coverage, slots (slot values compared), consistency
    (distinct values of the side that has fewer over distinct value pairs, 1 without slots),
    verbatim (all slot values equal). A pair is returned when `min_windows` windows, or all of
    a shorter item's, are found in places whose consistency is at least `consistency`. Windows
    with more than half slots match only with equal values; an item is also found by all or
    `min_windows` of its other windows alone. Items with fewer than `width` tokens are
    compared as one window of their own length, those with fewer than LEAST_TOKENS only with
    whole texts; items without tokens never match. Null and empty texts match nothing; rows
    of equal id and text give one row; items of equal id are one item.
    """
    d = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("t"))
    b = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull())
    own = F.least(F.col("n"), F.lit(width))
    widths = sorted(r.w for r in b.select(F.least(F.size(tokens(F.col("t"))), F.lit(width)).alias("w")).distinct().collect() if r.w > 0) or [width]
    items = template_windows(b, ["item"], F.col("t"), widths).where(F.col("w") == own)
    items = materialize(items.select("item", "w", F.col("pos").alias("bpos"), "g", "h", F.col("slots").alias("bslots")))
    text = ~is_heavy("bslots", F.col("w"))
    sizes = items.groupBy("item").agg(F.count_distinct("bpos").alias("item_windows"), F.count_distinct(F.when(text, F.col("bpos"))).alias("text_windows"))
    small = items.count() <= BROADCAST_WINDOWS
    templates = items.select("g").distinct()
    # texts with a window of some item's template: only theirs are taken with their slots
    held = template_hashes(d, ["text_key"], F.col("t"), widths).join(F.broadcast(templates) if small else templates, "g", "left_semi")
    d = d.join(sized(materialize(held.select("text_key").distinct())), "text_key", "left_semi")
    windows = template_windows(d, ["id", "text_key"], F.col("t"), widths).drop("n", "g")
    hits = windows.join(F.broadcast(items.drop("g")) if small else items.drop("g"), ["h", "w"])
    values = F.when(F.col("bslots").isNotNull(), F.zip_with("bslots", "slots", lambda b, d: F.struct(b.alias("b"), d.alias("d"))))
    pairs = lambda which: F.array_distinct(F.flatten(F.collect_set(F.when(which, values))))
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    # windows of equal values need no test of consistency, and have no part in it
    places = (
        hits.groupBy("id", "text_key", "item", (F.col("pos") - F.col("bpos")).alias("shift"))
        .agg(F.collect_set(F.when(text, F.col("bpos"))).alias("at"), F.collect_set(F.when(~text, F.col("bpos"))).alias("heavy_at"), pairs(text).alias("pairs"), pairs(~text).alias("equal"))
        .withColumn("share", F.when(F.size("pairs") > 0, F.least(distinct("b"), distinct("d")) / F.size("pairs")).otherwise(1.0))
    )
    holds = F.col("share") >= consistency
    places = places.where(holds | (F.size("heavy_at") > 0)).select(
        "id", "text_key", "item", "heavy_at",
        F.when(holds, F.col("at")).otherwise(F.slice("at", 1, 0)).alias("at"),
        F.when(holds, F.array_union("pairs", "equal")).otherwise(F.col("equal")).alias("pairs"),
        F.when(holds, F.col("share")).otherwise(1.0).alias("share"),
    )
    found = places.groupBy("id", "text_key", "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("in_text"),
        F.size(F.array_distinct(F.flatten(F.collect_list("heavy_at")))).alias("heavy"),
        F.sum(F.size("pairs")).alias("slots"),
        F.min("share").alias("consistency"),
        F.min(F.forall("pairs", lambda p: p["b"] == p["d"])).alias("verbatim"),
    )
    enough = lambda n, of: F.col(n) >= F.greatest(F.least(F.lit(min_windows), F.col(of)), F.lit(1))
    return (
        found.join(F.broadcast(sizes) if small else sizes, "item")
        .withColumn("windows", F.col("in_text") + F.col("heavy"))
        .where(enough("in_text", "text_windows") | enough("windows", "item_windows"))
        .select(F.col("id").alias(id_col), "text_key", F.col("item").alias(item_col), "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("coverage"), "slots", "consistency", "verbatim")
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; all columns are kept as they are."""
    found = contaminated(docs, benchmark, text_col=text_col, **options).select(F.unhex("text_key").alias("k")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.unhex(text_key(text_col)).alias("k"))
    return rows.join(sized(materialize(found)), "k", "left_anti").select("row.*")
