"""Fuzzy line deduplication by MinHash, with DataFrame and SQL functions only.

Distinct normalised lines are cut into character shingles; the minima of the shingle hashes under
several permutations make a signature; bands of it bring candidates together; the exact Jaccard
similarity of the shingle sets decides; a distributed union-find makes components, of which the
first line in document order stays. All pairs of a band of any size are compared, except those that
other links join already and those whose bitmaps prove them dissimilar. A character is a UTF-16
unit throughout.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, settle, tidy

#: Characters of a shingle; minima of a signature; links need this similarity.
SHINGLE = 8
MINIMA = 20
#: Minima of each band: five bands of neighbours and five across them, so two share one at most.
BANDS = [[4 * b + r for r in range(4)] for b in range(5)] + [[b + 5 * r for r in range(4)] for b in range(5)]
#: Places that one exploded row stands for where lines are compared, and where minima are taken.
STEP = 8
RUN = 16
#: A line in UTF-16, where a place is a fixed offset, and the last place where a shingle begins.
_WIDE = "encode(norm, 'UTF-16BE')"
_LAST = f"greatest(length(wide) div 2 - {SHINGLE}, 0L)"
#: Members of a band that share one hub; members of a block of a band; longs of a line's bitmap.
STAR = 1024
BLOCK = 256
LONGS = 16
#: Members of a band whom all its others meet, before all pairs that are still apart do.
DRAWN = 8
#: A line of more UTF-16 units is compared shingle by shingle, as rows.
LONG = 1 << 16
SIMILARITY = 0.8


def normalised(line: Column) -> Column:
    """Lower case, without spaces, tabs and carriage returns at the ends."""
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def exploded(docs: DataFrame) -> DataFrame:
    """uid, doc_id, line_no (from 0), line of every line; a null text has none. ``uid`` tells repeated rows apart."""
    return docs.select("uid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _keyed(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with their normalised form and its digest."""
    return lines.withColumn("norm", normalised(F.col("line"))).where("norm <> ''").withColumn("key", F.unhex(F.md5("norm")))


def _shingle_hash(at: int) -> Column:
    """Hash of the shingle ``at`` places on; past the last place that of the last, which changes no minimum. In UTF-16 a place is a fixed offset, so nothing is scanned."""
    return F.expr(f"xxhash64(substring(wide, cast(2 * least(at + {at}, last) + 1 as int), {2 * SHINGLE}))")


def _mask(i: int) -> int:
    """Constants whose XOR orders the hashes anew for each row of the signature."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def distinct_lines(lines: DataFrame) -> tuple[DataFrame, str]:
    """id, key and norm of each distinct line, as a table bucketed by key (later steps by key need no exchange), and its name."""
    spark = lines.sparkSession
    once = lines.select("key", "norm").dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id())
    name = f"distinct_lines_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.format("parquet").bucketBy(buckets, "key").saveAsTable(name)
    return spark.table(name), name


def signatures(once: DataFrame) -> DataFrame:
    """id and the minima of each line's shingle hashes; a line shorter than a shingle is one."""
    sized = once.select("key", "id", F.expr(_WIDE).alias("wide")).withColumn("last", F.expr(_LAST))
    # A row for each RUN places: exploding each place would cost more than its hash.
    rows = sized.select("key", "id", "wide", "last", F.explode(F.expr(f"sequence(0L, last, {RUN}L)")).alias("at"))
    hashes = rows.select("key", "id", *[_shingle_hash(j).alias(f"h{j}") for j in range(RUN)])
    low = lambda i: F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(_mask(i))) for j in range(RUN)]))
    return hashes.groupBy("key", "id").agg(*[low(i).alias(f"m{i}") for i in range(MINIMA)])


def bands(once: DataFrame) -> DataFrame:
    """band, id, low (the band's smallest id) and n (its size), for bands of more than one line."""
    names = [F.xxhash64(F.lit(b), *[F.col(f"m{i}") for i in rows]) for b, rows in enumerate(BANDS)]
    # Dealt once by band: the aggregate and the join with it read the same exchange.
    dealt = signatures(once).select("id", F.explode(F.array(*names)).alias("band")).repartition("band")
    ends = dealt.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    return dealt.join(ends, "band").select("band", "id", "low", "n")


def hubs(met: DataFrame) -> DataFrame:
    """Pairs ``a`` (a hub) and ``b``: every line of a band with the band's smallest id.

    A band of more than ``STAR`` lines is dealt by hash into blocks with hubs of their own, which
    meet the band's; no line is the hub of more than ``STAR`` or so lines of a band.
    """
    few = met.where(F.col("n") <= STAR).select(F.col("low").alias("a"), F.col("id").alias("b"))
    many = met.where(F.col("n") > STAR).withColumn("block", F.expr(f"pmod(xxhash64(id), ceil(n / {STAR}))"))
    local = many.groupBy("band", "block").agg(F.min("id").alias("hub"), F.min("low").alias("low"))
    spread = many.join(local.select("band", "block", "hub"), ["band", "block"]).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    return few.unionByName(spread).unionByName(local.select(F.col("low").alias("a"), F.col("hub").alias("b"))).where("a <> b").distinct()


def bitmaps(lines: DataFrame) -> DataFrame:
    """id, size (number of shingles) and the bitmap of each line (``id``, ``wide``): a shingle flips one of its bits.

    Sets that differ in d shingles have bitmaps that differ in d bits at most, so bitmaps never
    rule out a similar pair.
    """
    each = shingle_rows(lines)
    bit = lambda j: F.expr(f"bit_xor(if(shiftrightunsigned(h, 6) & {LONGS - 1} = {j}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"w{j}")
    return each.groupBy("id").agg(F.count("*").alias("size"), *[bit(j) for j in range(LONGS)])


def shingle_rows(lines: DataFrame) -> DataFrame:
    """id and h, one row for each different shingle of a line."""
    places = lines.withColumn("at", F.explode(F.expr(f"sequence(0L, {_LAST})")))
    return places.select("id", F.expr(f"xxhash64(substring(wide, cast(2 * at + 1 as int), {2 * SHINGLE}))").alias("h")).distinct()


def _spanning(members: DataFrame) -> DataFrame:
    """The members of bands that hold more than one component."""
    ends = members.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band")
    return members.join(ends, "band", "left_semi")


def _near(similarity: float) -> str:
    """Whether the pair of lines x and y lies in different components and its bitmaps do not rule it out."""
    off = " + ".join(f"bit_count(xw{k} ^ yw{k})" for k in range(LONGS))
    # |a - b| + |b - a| is at most this share of |a| + |b| where the similarity is reached.
    share = (1 - similarity) / (1 + similarity)
    return f"xroot <> yroot and least(xsize, ysize) >= {similarity}D * greatest(xsize, ysize) - 1e-6 and {off} <= {share}D * (xsize + ysize) + 1e-6"


def _as_side(lines: DataFrame, side: str) -> DataFrame:
    return lines.select(*[F.col(c).alias(c if c in ("band", "i", "j") else side + c) for c in lines.columns])


_ORDERED = ("least(xid, yid) as a", "greatest(xid, yid) as b")


def drawn_pairs(members: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """a and b: the members of each band with ``DRAWN`` of them, in different components and not ruled out by bitmaps."""
    lows = [F.min(F.col("id").bitwiseXOR(F.lit(_mask(k)))).bitwiseXOR(F.lit(_mask(k))) for k in range(DRAWN)]
    drawn = members.groupBy("band").agg(*[low.alias(f"d{k}") for k, low in enumerate(lows)])
    hub = drawn.select("band", F.explode(F.array(*[f"d{k}" for k in range(DRAWN)])).alias("id")).distinct()
    full = members.select("id", "root").distinct().join(bits, "id")
    x, y = _as_side(hub.join(full, "id"), "x"), _as_side(members.select("band", "id").join(full, "id"), "y")
    return x.join(y, "band").where(_near(similarity)).selectExpr(*_ORDERED).distinct()


def candidates(members: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """a and b of all pairs of a band in different components that bitmaps do not rule out.

    A band is dealt into blocks by the ids' hash and each pair of blocks is a join of its own, so no
    task holds more than two blocks at once.
    """
    blocks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int")).join(bits, "id")
    columns = ["id", "root", "size", *[f"w{k}" for k in range(LONGS)]]
    deal = lambda others, i, j: dealt.withColumn("other", F.explode(F.expr(others))).select("band", F.col(i).alias("i"), F.col(j).alias("j"), *columns)
    # The first side is repeated for every block from its own on, the second for every one up to it.
    x, y = _as_side(deal("sequence(block, blocks - 1)", "block", "other"), "x"), _as_side(deal("sequence(0, block)", "other", "block"), "y")
    return x.join(y, ["band", "i", "j"]).where(F.expr(f"(i < j or xid < yid) and {_near(similarity)}")).selectExpr(*_ORDERED).distinct()


def crowded(met: DataFrame, roots: DataFrame, lines: DataFrame, similarity: float) -> list[DataFrame]:
    """Links between the members of bands that lie in different components (``roots``).

    First every member meets the same few drawn ones of its band, which joins large families at a
    cost in proportion to their size; then all pairs of components that are still apart are compared.
    """
    named = met.where("n > 2").select("band", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left")
    members = settle(_spanning(named.select("band", "id", "n", F.coalesce("root", "id").alias("root"))), "crowd")
    if members.isEmpty():
        forget(members)
        return []
    bits = settle(bitmaps(lines.join(members.select("id").distinct(), "id", "left_semi")), "bitmaps")
    few = settle(verified(drawn_pairs(members, bits, similarity), lines, similarity), "crowd")
    of = members.select("id", "root").distinct()
    ends = few.join(of.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    moved = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    now = members.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    apart = settle(_spanning(now.select("band", "id", F.coalesce("to", "root").alias("root"))), "crowd")
    sizes = apart.groupBy("band").agg(F.count("*").alias("n"))
    rest = settle(verified(candidates(apart.join(sizes, "band"), bits, similarity), lines, similarity), "crowd")
    forget(members, bits, moved, apart)
    return [few, rest]


def linked(once: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node`` and ``root`` (ids): the components of lines that are linked by similarity.

    Every line is first compared with the hubs of its bands; then all pairs of a band that these
    links leave apart are, whatever the band's size.
    """
    met = settle(bands(once), "bands")
    sharing = met.select("id").distinct()
    lines = settle(once.join(sharing, "id", "left_semi").select("id", F.expr(_WIDE).alias("wide")), "lines")
    first = settle(verified(hubs(met), lines, similarity), "links")
    roots = components(first)
    more = crowded(met, roots, lines, similarity)
    if more:
        last, roots = roots, components(reduce(DataFrame.unionByName, more, first))
        forget(last)
    forget(met, lines, first, *more)
    return roots


def verified(pairs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (ids ``a`` and ``b``) whose sets of shingles are similar; ``lines`` holds ``id`` and ``wide``."""
    short, long = lines.where(f"length(wide) <= {2 * LONG}"), lines.where(f"length(wide) > {2 * LONG}")
    side = lambda s: short.select(F.col("id").alias(s), F.col("wide").alias(f"w{s}"), F.expr(f"cast({_LAST} as int)").alias(f"l{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # Rows of a pair stay in one place: the second join has dealt them by ``b``. Past a line's last
    # place its last shingle is cut again.
    places = both.select("*", F.explode(F.expr(f"sequence(0, greatest(la, lb), {STEP})")).alias("at"))
    cut = lambda s: F.array(*[F.expr(f"xxhash64(substring(w{s}, 2 * least(at + {j}, l{s}) + 1, {2 * SHINGLE}))") for j in range(STEP)]).alias(f"s{s}")
    sets = places.select("a", "b", cut("a"), cut("b")).groupBy("b", "a").agg(*[F.array_distinct(F.flatten(F.collect_list(f"s{s}"))).alias(f"s{s}") for s in "ab"])
    sizes = F.struct(F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    similar = F.filter(F.array(sizes), lambda m: m["common"] >= similarity * (m["both"] - m["common"]))
    found = sets.select("a", "b", F.explode(similar)).select("a", "b")
    if long.isEmpty():
        return found
    ids = long.select("id").distinct()
    rare = settle(
        pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(pairs.join(ids.withColumnRenamed("id", "b"), "b", "left_semi")).distinct(), "long"
    )
    wanted = rare.select(F.col("a").alias("id")).unionByName(rare.select(F.col("b").alias("id"))).distinct()
    rows = settle(shingle_rows(lines.join(wanted, "id", "left_semi")), "shingles")
    size = lambda s: rows.groupBy(F.col("id").alias(s)).agg(F.count("*").alias(f"n{s}"))
    common = (
        rare.join(rows.withColumnRenamed("id", "a"), "a").join(rows.withColumnRenamed("id", "b"), ["b", "h"])
        .groupBy("a", "b").agg(F.count("*").alias("common"))
    )
    alike = common.join(size("a"), "a").join(size("b"), "b").where(f"common >= {similarity}D * (na + nb - common)")
    return found.unionByName(alike.select("a", "b"))


def _decided(lines: DataFrame, similarity: float) -> DataFrame:
    """uid, doc_id, line_no, keep (struct of doc_id, uid, line_no) of every line that is not blank."""
    rows = _keyed(lines)
    once, name = distinct_lines(rows)
    roots = linked(once, similarity)
    places = settle(rows.select("uid", "doc_id", "line_no", "key"), "places")
    # Copies first fold to the first place of each digest, then of each component.
    first = places.groupBy("key").agg(F.min(F.struct("doc_id", "uid", "line_no")).alias("first"))
    ids = first.join(once.select("key", "id"), "key").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = settle(ids.select("key", "first", F.coalesce("root", "id").alias("root")), "named")
    lines.sparkSession.sql(f"DROP TABLE {name}")
    forget(roots)
    tidy(lines.sparkSession)
    keep = named.groupBy("root").agg(F.min("first").alias("keep"))
    by_key = named.join(keep, "root").select("key", "keep")
    return places.join(by_key, "key").select("uid", "doc_id", "line_no", "keep")


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each line that is not blank: doc_id, line_no, keep_doc_id, keep_line_no, kept.

    Lines end at newlines. Defined cases: blank lines are never judged and always stay; a null text
    has no line; equal lines are one component whatever their number; the line with the smallest
    (doc_id, line_no) of a component stays, one of a repeated row's; an empty table gives no rows;
    further columns are never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid"))
    return _decided(exploded(rows), similarity).select(
        "doc_id",
        "line_no",
        F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.line_no").alias("keep_line_no"),
        ((F.col("uid") == F.col("keep.uid")) & (F.col("line_no") == F.col("keep.line_no"))).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with each text reduced to the lines that stay; n_chars, if there, follows the text.

    Every row stays, whatever is left of its text. A null text stays null, an empty one empty; blank
    lines stay; of repeated rows one keeps the lines, ties going to the smallest (doc_id, line); an
    empty table gives no rows; further columns come through, whatever they are called.
    """
    tag = uuid.uuid4().hex[:8]
    mine, gone_at, cut_up, stay = f"__uid_{tag}", f"__gone_{tag}", f"__lines_{tag}", f"__stay_{tag}"
    base = settle(docs.withColumn(mine, F.monotonically_increasing_id()), "documents")
    lines = exploded(base.select(F.col(mine).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    decided = _decided(lines, similarity)
    gone = (
        decided.where("uid <> keep.uid or line_no <> keep.line_no")
        .groupBy(F.col("uid").alias(mine))
        .agg(F.sort_array(F.collect_list("line_no")).alias(gone_at))
    )
    # The numbers of the lines that stay, in order; array_except is a hash set of numbers.
    numbers = F.expr("sequence(0, size(split(text, '\\n')) - 1)")
    joined = base.join(gone, mine, "left")
    parts = joined.withColumn(cut_up, F.split("text", "\n")).withColumn(stay, F.array_except(numbers, F.col(gone_at)))
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(cut_up, i)), "\n"))
    out = parts.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_at).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
