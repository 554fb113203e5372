"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words ``[^\\x20\\x09-\\x0D]+`` (a null text has none). Sources in
code-point order (null last) weigh 1, 2, 3 and so on, repeating, and share
all words; a target stops at three times its source's size and the excess is
shared again by weight.

Each source's documents are shuffled by a hash and laid end to end; that
stream, read again and again, is cut into blocks of ``block`` words (the last
block of a pass is shorter). The schedule maps golden-ratio points
``frac(i * 0.618...)`` through the sources' cumulative weights: point ``i``
takes the next block of the source it falls on, so any stretch of the
schedule holds the sources in proportion. A source's slot of rank ``r`` is
joined with block ``r mod blocks`` of pass ``r div blocks``. What the points
leave a source short of is added after them, what they give too much is not
taken, and the last block is cut, so that every source gives its target to
the word. ``mix_rows`` returns the joined rows, slot by slot; what ``mix`` says is
taken of a document is their sum, and ``mixed_documents`` stands in their order.

Everything is DataFrame code. Nothing is partitioned by source alone: running
totals go by (source, hash bucket) with pre-aggregated starts, block joins by
(source, block). The number of slots is a parameter, not a function of the
documents, so the schedule stays small at any size.

Edge cases: documents without words, and all documents of an empty mix, take
0. Rows alike in id, source and size are interchangeable. Null ids and null
sources are ordinary values. An input column called like an output gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.llm.common import free_name, quoted, running_total, small_or_shuffled
from vicinity.session import materialize
from vicinity.sources.points import number_rows, read_table

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Slots that a schedule aims at, and the fewest words in a block.
SLOTS, MIN_BLOCK = 250_000, 64
#: The unit interval is cut into so many cells to find a point's source by an equi-join.
CELLS = 1024
OUT = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Number of words, in one scan without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(no_source, name, source_size)`` with ``weight`` and ``target`` (double).

    Water-filling in plain aggregates: while a source is above its cap, it is
    fixed there and the rest is shared again by weight. Each round fixes at
    least one source and reads one row of sums.
    """
    at = F.when(F.col("_place") % len(weights) == 0, weights[0])
    for k, w in enumerate(weights[1:], 1):
        at = at.when(F.col("_place") % len(weights) == k, w)
    # UTF-8 bytes, and so Spark's string order, follow the code points.
    t = number_rows(sizes, ["no_source", "name"], "_place", start=0)
    t = materialize(t.withColumn("weight", at).withColumn("cap", F.col("source_size") * max_epochs), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # A source is at its cap once the level would lift it above: that order never turns back.
        fixed = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        row = t.agg(F.sum(F.when(fixed, F.col("cap"))), F.sum(F.when(~fixed, F.col("weight")))).first()
        if not row[1]:
            level = float("inf")
            break
        raised = (total - (row[0] or 0)) / row[1]
        if level is not None and raised <= level:
            break
        level = raised
    if level == float("inf"):
        return t.withColumn("target", F.col("cap").cast("double"))
    return t.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``(no_source, name, slot, rank)``: which source each slot takes a block of.

    ``sources`` has ``source_size``, ``want`` (words to take) and ``_place`` (its number). Slots are
    numbered from 0; those added for a source that the points leave short come
    after all points.
    """
    spark = sources.sparkSession
    # Blocks needed: whole passes, and blocks of the last pass.
    need = F.expr(f"(want div source_size) * cast(ceil(source_size / {block}) as long) + cast(ceil((want % source_size) / {block}) as long)")
    s = materialize(sources.where("want > 0").withColumn("need", need), "mix-needs")
    points = s.agg(F.sum("need")).first()[0] or 0
    if not points:
        return s.select("no_source", "name", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("rank")).limit(0)
    upto = running_total(s.withColumn("_all", F.lit(1)).withColumn("_part", F.expr("_place div 4096")), ["_all"], "_part", ["_place"], "need", "_below")
    cells = upto.select(
        "no_source", "name", (F.col("_below") / points).alias("lo"), ((F.col("_below") + F.col("need")) / points).alias("hi"),
    ).withColumn("cell", F.explode(F.expr(f"sequence(cast(floor(lo * {CELLS}) as int), cast(least(floor(hi * {CELLS}), {CELLS - 1}) as int))")))
    u = F.col("slot") * F.lit(GOLDEN)
    pts = spark.range(points).select(F.col("id").alias("slot")).withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    hit = pts.join(cells, "cell").where("u >= lo and u < hi").select("no_source", "name", "slot")
    hit = hit.withColumn("_one", F.lit(1)).withColumn("_part", F.expr("slot div 4096"))
    ranked = running_total(hit, ["no_source", "name"], "_part", ["slot"], "_one", "rank").drop("_one", "_part")
    ranked = ranked.join(s.select("no_source", "name", "need"), ["no_source", "name"]).where("rank < need")
    ranked = materialize(ranked.drop("need"), "mix-slots")
    got = ranked.groupBy("no_source", "name").agg(F.count(F.lit(1)).alias("got"))
    short = s.join(got, ["no_source", "name"], "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < need")
    extra = short.select("no_source", "name", F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    extra = extra.select("no_source", "name", (F.lit(points) + F.col("rank")).alias("slot"), "rank")
    return ranked.select("no_source", "name", "slot", "rank").unionByName(extra)


def _joined(docs: DataFrame, id_col: str, source_col: str, size: Column | None, text_col: str, slots: int, row: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents with their sizes, the sources with their targets, and the schedule joined with the blocks.

    The last has a row for each slot that a piece of a document falls in, and one with a null
    slot for a piece that no slot takes.
    """
    d = docs.select(
        F.col(quoted([id_col])[0]).alias("id"),
        F.col(quoted([source_col])[0]).cast("string").alias("source"),
        (word_count(F.col(quoted([text_col])[0])) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))).alias("size"),
        *[F.col(c).alias("row") for c in quoted(row)],
    )
    row = ["row"] if row else []
    d = d.withColumn("no_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    d = materialize(d.withColumn("key", F.md5(F.concat_ws("|", F.lit("mix"), F.col("id").cast("string")))).drop("source"), "mix-sizes")
    per_source = d.groupBy("no_source", "name").agg(F.sum("size").alias("source_size"))
    src = targets(per_source).withColumn("want", F.least(F.round("target").cast("long"), F.col("cap")))
    src = materialize(src.drop("cap"), "mix-targets")
    total = src.agg(F.sum("want")).first()[0] or 0
    block = max(MIN_BLOCK, -(-total // slots))
    plan = schedule(src, block)
    # What each slot takes of its block: all of it, but for the cut last one.
    plan = plan.join(src.select("no_source", "name", "source_size", "want"), ["no_source", "name"])
    plan = plan.withColumn("blocks", F.expr(f"cast(ceil(source_size / {block}) as long)"))
    plan = plan.withColumn("block", F.expr("rank % blocks")).withColumn("pass", F.expr("rank div blocks"))
    plan = plan.withColumn("words_taken", F.expr(f"least({block}, source_size - block * {block}, want - pass * source_size - block * {block})"))
    plan = plan.select("no_source", "name", "block", "slot", "rank", "pass", "words_taken")
    # Documents in shuffled order, cut where blocks meet.
    filled = d.where("size > 0").withColumn("_part", F.substring("key", 1, 3))
    laid = running_total(filled, ["no_source", "name"], "_part", ["key", "size"], "size", "begin").drop("_part")
    pieces = laid.withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    lo, hi = F.greatest(F.col("begin"), F.col("block") * block), F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumn("at", lo - F.col("block") * block).withColumn("words_from", lo - F.col("begin")).withColumn("_hi", hi - F.col("block") * block)
    rows = pieces.join(plan, ["no_source", "name", "block"], "left")
    # greatest() takes no notice of nulls, nor does least().
    upto = F.when(F.col("slot").isNotNull(), F.col("words_from") + F.least(F.col("_hi"), F.col("words_taken")) - F.col("at"))
    rows = rows.withColumn("words_to", F.greatest(F.col("words_from"), upto))
    return d, src, rows.select("no_source", "name", "begin", "size", "id", *row, "slot", "rank", "block", "pass", "at", "words_from", "words_to")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", slots: int = SLOTS, row_col: str | None = None) -> DataFrame:
    """The mix itself, a row per slot and piece of a document in it: ``(slot, at, source, rank, pass, block, id, words_from, words_to)``, and ``row`` if ``row_col`` is given.

    Words ``words_from`` to ``words_to`` (exclusive) of the document stand ``at`` so many words
    after the start of their slot; ``(slot, at)`` is the order of the mix.
    """
    _, _, rows = _joined(docs, id_col, source_col, size, text_col, slots, [row_col] if row_col else [])
    source = F.when(~F.col("no_source"), F.col("name")).alias("source")
    rows = rows.where("words_to > words_from")
    return rows.select("slot", "at", source, "rank", "pass", "block", "id", "words_from", "words_to", *(["row"] if row_col else []))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", slots: int = SLOTS, row_col: str | None = None) -> DataFrame:
    """``(id, source, size, source_size, target, taken)``, and ``row`` if ``row_col`` is given, a row per row of ``docs``.

    ``taken`` is the sum over the rows of ``mix_rows``.
    """
    row = ["row"] if row_col else []
    d, src, rows = _joined(docs, id_col, source_col, size, text_col, slots, [row_col] if row_col else [])
    taken = F.sum(F.col("words_to") - F.col("words_from")).cast("long")
    per_doc = rows.groupBy("no_source", "name", "begin", "size", "id", *row).agg(taken.alias("taken"))
    empty = d.where("size = 0").select("no_source", "name", F.lit(0).cast("long").alias("begin"), "size", "id", *row, F.lit(0).cast("long").alias("taken"))
    result = per_doc.unionByName(empty).join(src.select("no_source", "name", "source_size", "target"), ["no_source", "name"])
    return result.select("id", F.when(~F.col("no_source"), F.col("name")).alias("source"), "size", "source_size", F.round("target", 6).alias("target"), "taken", *row)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars", slot_col: str | None = None) -> DataFrame:
    """The mixed documents in the order of the mix: each as often as it is taken, the last copy cut to the words taken.

    A copy stands where the schedule puts its first word, and stays whole there. The columns of
    ``docs`` stay; ``chars_col`` is recounted for a cut copy, and ``slot_col``, if given, names a
    column to add with the slot of the first word. Files written from the result hold its order one after
    the other; a reader that deals them anew finds it in that column.
    """
    row, size, slot, at, words = (free_name(docs, n) for n in ("_row", "_size", "_slot", "_at", "_words"))
    text = F.col(quoted([text_col])[0])
    # Written once with a number for each row, so that the plan finds its rows again.
    sized = materialize(docs.withColumn(size, word_count(text)).withColumn(row, F.monotonically_increasing_id()), "mix-input")
    rows = mix_rows(sized, id_col, source_col, size=F.col(size), row_col=row)
    # What is taken of a document in one pass is its beginning; the first piece comes first.
    first = F.min(F.struct("slot", "at"))
    plan = rows.groupBy("row", "pass").agg(F.sum(F.col("words_to") - F.col("words_from")).alias(words), first.alias("_first"))
    plan = plan.select(F.col("row").alias(row), words, F.col("_first.slot").alias(slot), F.col("_first.at").alias(at))
    plan = materialize(plan, "mix-plan")
    copies = sized.join(small_or_shuffled(plan, 40), row).drop(row).orderBy(slot, at)
    short = F.col(words) < F.col(size)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col(words).cast("int")), "")
    copies = copies.withColumn(text_col, F.when(short, cut).otherwise(text))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        copies = copies.withColumn(chars_col, F.when(short, F.char_length(text).cast(kind)).otherwise(F.col(quoted([chars_col])[0])))
    return copies.select(*quoted(docs.columns), *([F.col(slot).alias(slot_col)] if slot_col else []))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    m = mix(read_table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
with recursive d as (select doc_id, source is null as no_source, coalesce(source, '') as name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(concat_ws('|', 'mix', doc_id::varchar)) as key from documents),
s0 as (select no_source, name, sum(size)::bigint as source_size from d group by all),
s1 as (select *, 1 + (row_number() over (order by no_source, name) - 1) % 3 as weight, 3 * source_size as cap from s0),
t as (select sum(source_size)::bigint as total from s0),
lv(n, level) as (select 0, (select total from t) / (select sum(weight) from s1)::double
  union all select n + 1, raised from (select n, level, ((select total from t) - (select coalesce(sum(cap), 0) from s1 where cap <= weight * level))::bigint
      / (select sum(weight) from s1 where cap > weight * level)::double as raised from lv) where raised > level),
s2 as (select *, least(cap::double, weight * coalesce((select max(level) from lv), 1e300)) as target from s1),
s as (select *, least(round(target)::bigint, cap) as want from s2),
b as (select greatest(64, ((select sum(want) from s) + 249999) // 250000)::bigint as block),
need as (select s.*, block, (want // source_size) * ((source_size + block - 1) // block) + ((want % source_size) + block - 1) // block as need from s, b where want > 0),
pts as (select sum(need)::bigint as points from need),
c as (select *, (sum(need) over (order by no_source, name) - need)::bigint / points::double as lo, (sum(need) over (order by no_source, name))::bigint / points::double as hi from need, pts),
p as (select i::bigint as slot, (i * 0.6180339887498949::double) - floor(i * 0.6180339887498949::double) as u from (select unnest(range((select points from pts))) as i)),
h as (select no_source, name, row_number() over (partition by no_source, name order by slot) - 1 as rank, need from p join c on u >= lo and u < hi),
r as (select no_source, name, rank from h where rank < need
  union all select no_source, name, unnest(range(got, need)) from (select c.no_source, c.name, need, (select count(*) from h where h.no_source = c.no_source and h.name = c.name and rank < c.need) as got from c) where got < need),
x as (select r.no_source, r.name, rank % ((source_size + block - 1) // block) as k, rank // ((source_size + block - 1) // block) as pass, source_size, want, block from r join need using (no_source, name)),
y as (select no_source, name, k, least((k + 1) * block, source_size) - k * block as words, least(least((k + 1) * block, source_size) - k * block, want - pass * source_size - k * block) as got from x),
uses as (select no_source, name, k, sum((got = words)::int)::bigint as uses, max(case when got < words then got else 0 end)::bigint as part from y group by all),
l as (select *, (sum(size) over (partition by no_source, name order by key, size rows between unbounded preceding and current row) - size)::bigint as start from d where size > 0),
e as (select l.*, block, unnest(range(start // block, (start + size - 1) // block + 1)) as k from l, b),
g as (select e.*, greatest(start, k * block) - k * block as lo, least(start + size, (k + 1) * block) - k * block as hi from e),
z as (select no_source, name, start, size, doc_id, coalesce(sum(uses * (hi - lo) + greatest(0, least(hi, part) - lo)), 0)::bigint as taken
  from g left join uses using (no_source, name, k) group by all),
a as (select no_source, name, size, doc_id, taken from z union all select no_source, name, size, doc_id, 0 from d where size = 0)
select doc_id, size, source_size, round(target, 6) as target, taken from a join s using (no_source, name)
"""
