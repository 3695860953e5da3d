"""Order-dependent deduplication as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from newsloom import rules
from newsloom.functions import text as tx, urls as ux
from newsloom.operators import overlap as ov, skew
from newsloom.operators.ledger import first_per_key
from newsloom.operators.rollups import with_previous
from newsloom.session import small, stage

def _size(df: DataFrame) -> int:
    """Row count of a staged table (read from file footers)."""
    return df.count()


# --- two-key greedy dedup -----------------------------------------------------

def greedy_two_keys(rows: DataFrame, order: str, first: str, second: str, plain_rows: int | None = skew.PLAIN_ROWS) -> DataFrame:
    """Keep a row unless an earlier *kept* row has its first or second key.

    Empty keys never match. Equals the sequential greedy loop: a row is
    kept once it is the earliest undecided row of both its keys, which
    removes every later row with either key. Rows with equal key pairs are
    reduced to their earliest before the first round. The earliest rows
    per key are partial aggregates and meet on the unique ``order``, so a
    key with a third of the rows does not gather anywhere.
    """
    keyed = rows.select(
        F.col(order).alias("_o"), F.nullif(F.col(first), F.lit("")).alias("_u"), F.nullif(F.col(second), F.lit("")).alias("_t")
    )
    free = keyed.filter(F.col("_u").isNull() & F.col("_t").isNull()).select("_o")
    open_rows = keyed.filter(F.col("_u").isNotNull() | F.col("_t").isNotNull()).groupBy("_u", "_t").agg(F.min("_o").alias("_o"))
    open_rows = stage(open_rows, "two-key-open")
    kept = free
    while True:
        total = _size(open_rows)
        if total == 0:
            return rows.join(kept.withColumnRenamed("_o", order), order, "left_semi")
        winners_u = open_rows.filter("_u is not null").groupBy("_u").agg(F.min("_o").alias("_o")).select("_o")
        winners_u = winners_u.unionByName(open_rows.filter("_u is null").select("_o"))
        winners_t = open_rows.filter("_t is not null").groupBy("_t").agg(F.min("_o").alias("_o")).select("_o")
        winners_t = winners_t.unionByName(open_rows.filter("_t is null").select("_o"))
        chosen = stage(
            open_rows.join(winners_u, "_o", "left_semi").join(winners_t, "_o", "left_semi").select("_o", "_u", "_t"), "two-key-kept"
        )
        kept = kept.unionByName(chosen.select("_o"))
        rest = skew.without(open_rows, chosen.filter("_u is not null"), "_u", total, plain_rows)
        rest = skew.without(rest, chosen.filter("_t is not null"), "_t", total, plain_rows)
        # rows with one null key were kept above or lost to their other key
        open_rows = stage(rest.join(chosen.select("_o"), "_o", "left_anti"), "two-key-open")


def dedupe_citations_like(items: DataFrame, order: str, url: str, text: Column, scope: Column | None = None) -> DataFrame:
    """Greedy dedup by canonical URL, then by content key, inside a scope
    such as a day (the whole input when none)."""
    def scoped(c: Column) -> Column:
        return c if scope is None else F.when(c == "", F.lit("")).otherwise(F.concat(scope.cast("string"), F.lit("\u0001"), c))

    # staged: the filters of the rounds would evaluate the key expressions again
    keys = items.select(F.col(order), tx.let(ux.canonical_key(F.col(url)), scoped).alias("_url_key"), tx.let(tx.content_key(text), scoped).alias("_text_key"))
    kept = greedy_two_keys(stage(keys, "two-keys"), order, "_url_key", "_text_key")
    return items.join(kept.select(order), order, "left_semi")


# --- near-duplicate texts -------------------------------------------------------

def overlap_pairs(sets: DataFrame, threshold: float = rules.NEAR_DUPLICATE_OVERLAP, total: int | None = None) -> DataFrame:
    """Pairs whose shared words reach ``threshold`` of the smaller set.

    ``sets`` has ``scope, id, words`` (distinct words, at least one), in all ``total`` words. Words
    become numbers, groups of sets are written by ranges of scopes, and tasks
    compare two groups each (see ``overlap``). Exact; nothing sampled.
    """
    spark, salt = sets.sparkSession, 0
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    while True:
        extra = [F.lit(salt)] if salt else []
        slots = F.transform("words", lambda w: F.xxhash64("scope", w, *extra))
        # a second number tells two words of one number apart
        marks = F.transform("words", lambda w: F.struct(F.xxhash64("scope", w, *extra).alias("slot"), F.xxhash64(w, "scope", F.lit(7)).alias("mark")))
        usage = sets.select(F.explode(marks).alias("w")).groupBy("w.slot").agg(F.count("*").alias("df"), F.min("w.mark").alias("lo"), F.max("w.mark").alias("hi"))
        usage = stage(usage.filter("df = 1 OR lo <> hi"), "usage")
        if usage.filter("lo <> hi").isEmpty():
            break
        salt += 1
    if total is None:
        total = sets.agg(F.sum(F.size("words"))).first()[0] or 0
    groups = ov.group_count(total)
    scope = F.xxhash64("scope")
    placed = sets.select("id", F.size("words").alias("n"), scope.alias("scope"), slots.alias("slots")).repartitionByRange(groups, "scope", F.xxhash64("id"))
    placed = stage(placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("no"), "id", "scope", "n", need.alias("need"), "slots"), "sets")
    # the session may have made more parts than were asked for
    parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
    groups = min(groups, parts)
    placed = placed.withColumn("grp", F.expr(f"cast(part * {groups} div {parts} as int)"))
    # a word of one set finds nothing
    words = placed.select("grp", "no", F.explode("slots").alias("slot")).join(small(usage.select("slot"), 2_000_000), "slot", "left_anti")
    probes = stage(words.select("grp", "no", "slot").repartition(groups, "grp").sortWithinPartitions("grp", "no"), "probes")

    def files_of(df: DataFrame) -> dict[int, list[str]]:
        found: dict[int, list[str]] = {}
        for grp, file in df.select("grp", F.input_file_name().alias("file")).distinct().collect():  # about one row per group
            found.setdefault(grp, []).append(file)
        return found

    tiles = ov.tiles_of([tuple(r) for r in placed.groupBy("grp").agg(F.min("scope"), F.max("scope")).collect()])
    numbers = spark.range(0, len(tiles), 1, ov.task_count(len(tiles)))
    kind = placed.schema["id"].dataType
    pairs = numbers.mapInPandas(
        ov.tile_pairs(files_of(placed), files_of(probes), tiles, groups, parts), StructType([StructField("a", kind), StructField("b", kind)]))
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def greedy_over_pairs(pairs: DataFrame, plain_rows: int | None = skew.PLAIN_ROWS) -> DataFrame:
    """Ids dropped by the sequential rule "drop when similar to an earlier
    kept id", from pairs ``lo < hi``."""
    open_pairs = stage(pairs.select("lo", "hi"), "near-open")
    dropped = open_pairs.select(F.col("hi").alias("id")).limit(0)
    while True:
        total = _size(open_pairs)
        if total == 0:
            return dropped
        # an id with no earlier open partner is kept
        kept = open_pairs.select(F.col("lo").alias("id")).distinct().join(open_pairs.select(F.col("hi").alias("id")).distinct(), "id", "left_anti")
        kept = stage(kept, "near-kept")
        lost = skew.only(open_pairs, kept.withColumnRenamed("id", "lo"), "lo", total, plain_rows).select(F.col("hi").alias("id")).distinct()
        lost = stage(lost, "near-lost")
        dropped = dropped.unionByName(lost)
        rest = skew.without(open_pairs, kept.withColumnRenamed("id", "lo"), "lo", total, plain_rows)
        rest = skew.without(rest, lost.withColumnRenamed("id", "lo"), "lo", total, plain_rows)
        rest = skew.without(rest, lost.withColumnRenamed("id", "hi"), "hi", total, plain_rows)
        open_pairs = stage(rest, "near-open")


def near_duplicates(
    rows: DataFrame, order: str, text: str, scope: Column | None = None, fixed: Column | None = None,
    threshold: float = rules.NEAR_DUPLICATE_OVERLAP, plain_rows: int | None = skew.PLAIN_ROWS,
) -> DataFrame:
    """Orders of the rows that repeat an earlier kept row of their scope.

    Texts under five distinct words never match. Rows where ``fixed``
    holds are never dropped. Equal word sets are reduced to their earliest
    row first: a later equal set is always dropped.
    """
    base = rows.select(
        F.col(order).alias("id"), (scope if scope is not None else F.lit(0)).alias("scope"),
        F.array_sort(F.array_distinct(tx.content_words(F.col(text)))).alias("words"),
        (fixed if fixed is not None else F.lit(False)).alias("fixed"),
    ).filter(F.size("words") >= rules.NEAR_DUPLICATE_MIN_WORDS)
    base = stage(base.withColumn("digest", F.sha2(F.array_join("words", " "), 256)), "near-base")
    groups = stage(base.groupBy("scope", "digest").agg(F.min("id").alias("first"), F.max(F.size("words")).alias("n")), "near-groups")
    repeats_of = base.select("scope", "digest", "id", "fixed").withColumn("slot", F.concat_ws("\u0001", F.col("scope").cast("string"), "digest"))
    firsts = groups.withColumn("slot", F.concat_ws("\u0001", F.col("scope").cast("string"), "digest")).select("slot", "first")
    repeats = skew.lookup(repeats_of, firsts, "slot", _size(base), plain_rows).filter((F.col("id") != F.col("first")) & ~F.col("fixed")).select("id")
    heads = base.join(small(groups.select(F.col("first").alias("id")), 2_000_000), "id", "left_semi")
    pairs = overlap_pairs(heads.select("scope", "id", "words"), threshold, groups.agg(F.sum("n")).first()[0] or 0)
    if fixed is not None:
        pairs = pairs.join(heads.filter("fixed").select(F.col("id").alias("hi")), "hi", "left_anti").select("lo", "hi")
    lost = greedy_over_pairs(pairs, plain_rows)
    return repeats.unionByName(lost).withColumnRenamed("id", order)


def drop_near_duplicates(rows: DataFrame, order: str, text: str, **options) -> DataFrame:
    return rows.join(near_duplicates(rows, order, text, **options), order, "left_anti")


# --- inside one row ---------------------------------------------------------------

def first_in_row(df: DataFrame, entries: Column, out: str) -> DataFrame:
    """Adds ``out``: the values of an array of (key, value) structs with
    later repeats of a key dropped and order kept. No shuffle: entries are
    sorted by key inside the row."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e.key.alias("key"), i.alias("pos"), e.value.alias("value"))))
    flagged = with_previous(
        placed, lambda e, p: F.struct((p.isNull() | (p.key != e.key)).alias("first"), e.pos.alias("pos"), e.value.alias("value"))
    )
    firsts = F.transform(F.filter(flagged, lambda e: e.first), lambda e: F.struct(e.pos.alias("pos"), e.value.alias("value")))
    return df.withColumn(out, F.transform(F.array_sort(firsts), lambda e: e.value))


def _entries(values: Column, key) -> Column:
    return F.transform(values, lambda v: F.struct(key(v).alias("key"), v.alias("value")))


def unique_sentences(df: DataFrame, text: str, out: str) -> DataFrame:
    """Sentences of each row, repeats by 120-character key dropped."""
    keyed = F.filter(_entries(tx.sentences(tx.strip_noise(F.col(text))), lambda s: tx.alnum_key(s, 120)), lambda e: e.key != "")
    return first_in_row(df, keyed, out)


def unique_strings(df: DataFrame, values: Column, out: str) -> DataFrame:
    """Strings of each row without repeats in another case."""
    return first_in_row(df, _entries(values, lambda v: F.lower(v)), out)


def unique_blocks(df: DataFrame, body: str, out: str, separator: str = r"\n{2,}", glue: str = "\n\n") -> DataFrame:
    """Body without repeated blocks; blocks with a heading always stay,
    list lines repeated inside a block go."""
    blocks = F.filter(F.split(F.col(body), separator), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")) != "")
    heading = lambda b: b.rlike(r"(?m)^\s*#{1,6}\s+")

    def entry(b: Column, i: Column) -> Column:
        key = F.when(heading(b), F.concat(F.lit("\u0001"), i.cast("string"))).otherwise(tx.block_key(b))
        return F.struct(key.alias("key"), b.alias("value"))

    df = first_in_row(df, F.filter(F.transform(blocks, entry), lambda e: e.key != ""), "_blocks")
    # second level: list lines of each block, keyed by (block, line)
    is_item = lambda x: x.rlike(r"^\s*[-*]\s+")
    lines = F.flatten(
        F.transform(
            F.col("_blocks"),
            lambda b, i: F.transform(
                F.split(b, "\n"),
                lambda x, j: F.struct(
                    F.concat(i.cast("string"), F.lit("\u0001"), F.when(is_item(x), tx.block_key(x)).otherwise(F.concat(F.lit("\u0002"), j.cast("string")))).alias("key"),
                    F.struct(i.alias("block"), x.alias("line")).alias("value"),
                ),
            ),
        )
    )
    kept = F.filter(lines, lambda e: ~(is_item(e.value.line) & F.endswith(e.key, F.lit("\u0001"))))
    df = first_in_row(df, kept, "_lines")
    pieces = with_previous(
        F.col("_lines"),
        lambda v, p: F.concat(F.when(p.isNull(), "").when(p.block == v.block, "\n").otherwise(glue), v.line),
    )
    return df.withColumn(out, F.array_join(pieces, "")).drop("_blocks", "_lines")


# --- citations and developments ------------------------------------------------------

def citations_by_key(citations: DataFrame, owner: str, order) -> DataFrame:
    """First citation per (owner, canonical URL); blank keys go."""
    keyed = citations.withColumn("url_key", ux.canonical_key(F.col("url"))).filter(F.col("url_key") != "")
    return first_per_key(keyed, [owner, "url_key"], order)


def citations_by_url(citations: DataFrame, owner: str, order) -> DataFrame:
    """First citation per (owner, raw URL); the whole record is the key
    where the URL is missing."""
    record = F.to_json(F.struct(*[c for c in ("title", "url", "source") if c in citations.columns]))
    keyed = citations.withColumn("_key", F.coalesce("url", record))
    return first_per_key(keyed, [owner, "_key"], order).drop("_key")


def developments(claims: DataFrame, titles: DataFrame, packet: str) -> DataFrame:
    """Useful claim texts, then useful titles, without repeats of a
    90-character lower-case prefix. Both have ``packet, pos, text``."""
    both = claims.select(packet, "pos", "text", F.lit(0).alias("origin")).unionByName(titles.select(packet, "pos", "text", F.lit(1).alias("origin")))
    cleaned = both.withColumn("text", tx.development_text(F.col("text")))
    keyed = cleaned.filter(tx.useful_development(F.col("text"))).withColumn("key", F.substring(F.lower("text"), 1, 90))
    return first_per_key(keyed, [packet, "key"], ["origin", "pos"]).drop("key")
