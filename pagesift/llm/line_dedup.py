"""Fuzzy line deduplication (DataFrame operations only).

Lines are split at newlines and normalised: lower case, runs of blanks to one
space, trimmed. Equal normalised lines are one node, known by its MD5 and never by its
place. Each node gets a 64-bit SimHash of its distinct words (a word that repeats, such as
the bars of a table row, would else outvote the rest); a bit that half of the words have is
decided by a rehash of the smallest hash, else lines of two words would have few bits set
and meet by chance. Hashes are summed in packed byte lanes, eight longs holding the 64 bit
counts of up to 127 words.

Fingerprints are cut into ``bands``. Those within ``radius`` bits share, by the pigeonhole principle, one of the
keys for each choice of ``bands - radius`` bands; the bands are the same for any number of lines, so two lines
are linked or not whatever other lines there are. A few changed words move a SimHash by more bits than keys allow for, so
blocks of words are keys as well: the first two and the last two blocks of ``BLOCK`` words. Lines of 16 words or more that
differ in up to three words in place, or by one word put in or left out, have a block in common. Lines that share a key are
candidates, the further ones too, up to ``reach`` bits: none within ``radius`` is missed, and nearly all
alike lines are within ``reach`` (97 of 100 at ``REACH``).
Candidates are verified by edit similarity ``1 - levenshtein / longer length >=
min_similarity``. Of each connected group of lines the first occurrence (smallest document
id, then line number) stays.

A key of two or three fingerprints gives its pairs out of one aggregation. Larger keys are
first compared with two leaders, which settles groups of near copies in linear work;
then the lines still in different groups are joined on their keys and compared, a large key's
in as many shares as it has thousands of them.

Defined cases: null text is one empty line; lines without words are layout and
always stay; a null id is an id like any other, but its lines are first only if a group
has no other; lines of documents that share an id are told apart by their content, and
rows that repeat an id, place and line share their decision; a line of any length is
compared whole, its hashes summed in slices; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import BLANKS, connected_components, fresh, join_checked, let, materialize, release

RADIUS, REACH, BANDS, MIN_SIMILARITY = 3, 14, 5, 0.8
#: Words of a block; two are taken from each end of a line.
BLOCK = 4
#: Open fingerprints of a key that one task compares with all the others.
_SHARE = 2048
#: Words that an edit may put in or leave out in one place to be found without an edit distance.
_SKIP = 3
_LANES, _WIDE, _PART = 0x0101010101010101, 0x0001000100010001, 127


def normalised(line: Column) -> Column:
    # single bytes are replaced first; a pattern runs only over lines with two spaces together
    c = F.lower(line)
    for blank in "\t\n\x0b\f\r":
        c = F.replace(c, F.lit(blank), F.lit(" "))
    return F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c))


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))


def _lanes(hashes: Column) -> Column:
    """The bit counts of up to ``_PART`` hashes: eight longs of eight byte lanes."""

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"s{s}"] + (F.shiftrightunsigned(h, s) if s else h).bitwiseAND(F.lit(_LANES))).alias(f"s{s}") for s in range(8)])

    return F.aggregate(hashes, F.struct(*[F.lit(0).cast("long").alias(f"s{s}") for s in range(8)]), add)


def _packed_majority(sums: Column, n: Column, tie: Column) -> Column:
    """The bits set in over half of ``n <= _PART`` hashes, or in half and in ``tie``, compared
    four lanes at once: a lane, widened to 16 bits, reaches 128 with ``127 - n div 2`` and
    the tie of an even ``n`` added. One expression a bit would outgrow what the JVM compiles."""
    missing = (F.lit(_PART) - F.shiftright(F.least(n, F.lit(_PART)), 1)) * F.lit(_WIDE)
    tie = F.when(n % 2 == 0, tie).otherwise(F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for s in range(8):
        for half in (0, 8):
            over = F.shiftrightunsigned(sums[f"s{s}"], half).bitwiseAND(F.lit(_WIDE * 255)) + F.shiftrightunsigned(tie, s + half).bitwiseAND(F.lit(_WIDE)) + missing
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(over, 7).bitwiseAND(F.lit(_WIDE)), s + half))
    return out


def _wide_majority(hashes: Column, tie: Column) -> Column:
    """The same of any number of hashes, whose slices are counted one after the other."""
    slices = F.transform(F.sequence(F.lit(1), F.size(hashes), F.lit(_PART)), lambda at: _lanes(F.slice(hashes, at, F.lit(_PART))))
    bits = [F.lit(0).cast("long").alias(f"c{p}") for p in range(64)]

    def add(acc: Column, lanes: Column) -> Column:
        return F.struct(*[(acc[f"c{p}"] + F.shiftrightunsigned(lanes[f"s{p % 8}"], p // 8 * 8).bitwiseAND(F.lit(255))).alias(f"c{p}") for p in range(64)])

    def majority(counts: Column) -> Column:
        out = F.lit(0).cast("long")
        for p in range(64):
            bit = F.lit((1 << p) - ((1 << 64) if p == 63 else 0)).cast("long")
            more = counts[f"c{p}"] * 2 + F.shiftrightunsigned(tie, p).bitwiseAND(F.lit(1)) > F.size(hashes)
            out = out.bitwiseOR(F.when(more, bit).otherwise(F.lit(0).cast("long")))
        return out

    return F.aggregate(slices, F.struct(*bits), add, majority)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, k (MD5 of the normalised line), chars, fp, blocks`` for every line
    that has a word."""
    # the raw line is tested, as a filter on the normalised one would normalise twice
    worded = _split(docs, id_col, text_col).where(F.col("line").rlike(rf"[^{BLANKS}]"))
    lines = worded.select("doc_id", "line_no", normalised(F.col("line")).alias("t"))
    hashes = F.array_distinct(F.transform(F.split("t", " "), lambda w: F.xxhash64(w)))
    lines = lines.select("doc_id", "line_no", _key("t").alias("k"), F.length("t").alias("chars"), let(F.split("t", " "), _blocks).alias("blocks"), hashes.alias("h"))
    lines = lines.withColumn("n", F.size("h")).withColumn("s", F.when(F.col("n") <= _PART, _lanes(F.col("h")))).withColumn("tie", F.xxhash64(F.array_min("h")))
    fp = F.when(F.col("n") <= _PART, _packed_majority(F.col("s"), F.col("n"), F.col("tie"))).otherwise(_wide_majority(F.col("h"), F.col("tie")))
    return lines.select("doc_id", "line_no", "k", "chars", fp.alias("fp"), "blocks")


def _blocks(words: Column) -> Column:
    """32-bit hashes of the blocks at both ends; a line has those that fit in it."""
    n = F.size(words)
    starts = [F.lit(1), F.lit(1 + BLOCK), n - BLOCK + 1, n - 2 * BLOCK + 1]
    least = [BLOCK, 2 * BLOCK, BLOCK, 2 * BLOCK]
    hashes = [F.when(n >= few, F.hash(F.slice(words, at, F.lit(BLOCK)), F.lit(i))) for i, (at, few) in enumerate(zip(starts, least, strict=True))]
    return F.filter(F.array(*hashes), lambda h: h.isNotNull())


def _key(text: str) -> Column:
    return F.unhex(F.md5(text))


def masks_for(radius: int, bands: int) -> list[int]:
    """The bits of each choice of ``bands - radius`` bands, as signed longs."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(bands), bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(fps: DataFrame, radius: int, bands: int) -> DataFrame:
    """``fp, key``: a key for each choice of bands."""
    keys = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(m).cast("long")), F.lit(t)) for t, m in enumerate(masks_for(radius, bands))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _near(a, b, reach: int) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= reach


def _ordered(a, b) -> Column:
    return F.struct(F.least(a, b).alias("f1"), F.greatest(a, b).alias("f2"))


def _walked(one: Column, two: Column) -> Column:
    """What it takes at most to make the words of ``one`` those of ``two``: side by side from the
    front, where words that differ are replaced, or put in or left out (with their blank, up to
    ``_SKIP`` at once) if the two that follow are then the same."""

    def step(s: Column, i: Column) -> Column:
        ahead = lambda skip, more: F.get(one, i + skip).eqNullSafe(F.get(two, s["at"] + more)) & F.get(one, i + skip + 1).eqNullSafe(F.get(two, s["at"] + more + 1))
        to = lambda at, n, skip=0: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"), F.lit(skip).alias("skip"))
        gone = lambda of, at, few: F.length(F.array_join(F.slice(of, at + 1, F.lit(few)), " ")) + 1
        left, right = F.get(one, i), F.get(two, s["at"])
        longer = F.greatest(F.length(left), F.length(right))
        # past the end of ``two`` a word goes with its blank
        other = F.when(right.isNull(), F.length(left) + 1).when(longer > 32, longer).otherwise(F.levenshtein(left, right))
        out = F.when(s["skip"] > 0, F.struct(s["at"].alias("at"), s["n"].alias("n"), (s["skip"] - 1).alias("skip"))).when(left.eqNullSafe(right), to(s["at"] + 1, s["n"]))
        for few in range(1, _SKIP + 1):
            out = out.when(F.get(two, s["at"] + few).isNotNull() & ahead(0, few), to(s["at"] + few + 1, s["n"] + gone(two, s["at"], few)))
            out = out.when(right.isNotNull() & ahead(few, 0), to(s["at"], s["n"] + gone(one, i, few), few - 1))
        return out.otherwise(to(s["at"] + 1, s["n"] + other))

    def end(s: Column) -> Column:
        rest = F.slice(two, s["at"] + 1, F.greatest(F.size(two) - s["at"], F.lit(0)))
        return s["n"] + F.length(F.array_join(rest, " ")) + F.when(F.size(rest) > 0, 1).otherwise(0)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("skip"))
    return F.aggregate(F.sequence(F.lit(0), F.size(one) - 1), start, step, end)


def _alike(min_similarity: float) -> Column:
    """Whether ``t1`` and ``t2`` have the edit similarity. The words that both end or begin
    with are cut off, which changes no edit distance. Lines are alike if changing
    the words left one after the other stays within the limit (no distance is larger than that). Else an edit distance decides, first within a band as
    wide as the words are long that only one line has: near copies cost their distance and
    not their limit."""
    limit = F.floor(F.greatest(F.length("t1"), F.length("t2")) * F.lit(1 - min_similarity) + F.lit(1e-9)).cast("int")

    def cut(w: Column) -> Column:
        """Both lists from the first place where they differ, turned round."""
        at = F.array_position(F.zip_with(w["a"], w["b"], lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
        rest = lambda words: F.reverse(F.slice(words, at, F.size(words)))
        return F.struct(rest(w["a"]).alias("a"), rest(w["b"]).alias("b"))

    def banded(t: Column) -> Column:
        within = lambda n: F.call_function("levenshtein", t["a"], t["b"], n) >= 0
        first = F.least(t["n"], t["band"])
        return F.when(F.abs(F.length(t["a"]) - F.length(t["b"])) > t["n"], False).when(within(first), True).otherwise((t["n"] > first) & within(t["n"]))

    def decide(m: Column) -> Column:
        own = lambda a, b: F.length(F.array_join(F.array_except(a, b), " "))
        band = F.greatest(own(m["a"], m["b"]), own(m["b"], m["a"])) + 6
        texts = F.struct(m["n"].alias("n"), band.alias("band"), F.array_join(m["a"], " ").alias("a"), F.array_join(m["b"], " ").alias("b"))
        # if one has no word left, the other's words and their blank are the distance
        none = (F.size(m["a"]) == 0) | (F.size(m["b"]) == 0)
        words = F.length(F.array_join(F.concat(m["a"], m["b"]), " ")) + F.when((F.size(m["a"]) > 0) | (F.size(m["b"]) > 0), 1).otherwise(0)
        return F.when(none, words <= m["n"]).when(_walked(m["a"], m["b"]) <= m["n"], True).otherwise(let(texts, banded))

    words = F.struct(F.split("t1", " ").alias("a"), F.split("t2", " ").alias("b"))
    return let(let(let(words, cut), cut), lambda w: let(F.struct(limit.alias("n"), w["a"].alias("a"), w["b"].alias("b")), decide))


def _texts(docs: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """``id, t``, written: the normalised texts of the ``nodes`` whose ``id`` is in ``some``, read again
    from ``docs`` (``doc_id, text``); documents that share an id are told apart by the line's MD5."""
    wanted = join_checked(nodes, some.select("id"), "id", "left_semi", bound=1_000_000).select("id", "k", F.col("first.doc_id").alias("_doc"), F.col("first.line_no").alias("_line"))
    wanted = materialize(wanted, "line-wanted")
    ids = wanted.select("_doc").distinct()
    some = docs.join(F.broadcast(ids) if ids.count() <= 300_000 else ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    rows = join_checked(_split(some, "doc_id", "text"), wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("line_no") == F.col("_line")), bound=300_000)
    rows = rows.select("id", "k", normalised(F.col("line")).alias("t")).where(_key("t") == F.col("k"))
    # rows that repeat an id and a line give their text more than once
    texts = materialize(rows.groupBy("id").agg(F.any_value("t").alias("t")), "line-texts")
    release(wanted)
    return texts


def _verified(texts: DataFrame, pairs: DataFrame, min_similarity: float) -> DataFrame:
    """The written links ``a, b`` among ``pairs`` (``a1, a2`` of ``texts``) by edit similarity."""
    first, second = (texts.select(F.col("id").alias(f"a{n}"), F.col("t").alias(f"t{n}")) for n in (1, 2))
    checked = pairs.join(first, "a1").join(second, "a2").where(_alike(min_similarity))
    return materialize(checked.select(F.col("a1").alias("a"), F.col("a2").alias("b")), "line-links")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, reach: int = REACH, bands: int = BANDS, min_similarity: float = MIN_SIMILARITY, lead: bool = True) -> DataFrame:
    """``doc_id, line_no, line_md5, first_doc, first_line, kept`` for every line that has a
    word.

    Comparing large keys with their leaders (``lead``) comes first; the last pass compares
    every pair of candidates whose lines are not known to be connected, so no link is lost.
    """
    lines = materialize(fingerprints(docs, id_col, text_col), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    nodes = lines.groupBy("k").agg(F.any_value("chars").alias("chars"), F.any_value("fp").alias("fp"), F.any_value("blocks").alias("blocks"), F.min(place).alias("first"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "line-nodes")
    # a fingerprint's lines, and the one that stands for them
    by_fp = materialize(nodes.groupBy("fp").agg(F.count("*").alias("lines"), F.min("id").alias("id")), "line-fingerprints")
    blocks = materialize(nodes.select("fp", F.explode(F.col("blocks").cast("array<long>")).alias("key")).distinct(), "line-blocks")
    keyed = _keyed(by_fp, radius, bands).unionByName(blocks)
    least, most, middle = F.col("a"), F.col("c"), F.col("a").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("x"))
    some = _near(least, most, reach) | (F.col("n") == 3) & (_near(least, middle, reach) | _near(middle, most, reach))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("c"), F.bit_xor("fp").alias("x"))
    shared = materialize(shared.where((F.col("n") > 1) & ((F.col("n") > 3) | some)), "line-keys")
    large = shared.where("n > 3")
    rows = materialize(join_checked(keyed, large.select("key", "a", "c"), "key", bound=500_000), "line-rows") if large.take(1) else None
    pairs = F.when(F.col("n") == 2, F.array(_ordered(least, most))).otherwise(F.array(_ordered(least, most), _ordered(least, middle), _ordered(middle, most)))
    pairs = shared.where("n <= 3").select(F.explode(pairs).alias("p")).select("p.*")
    small = materialize(pairs.where(_near("f1", "f2", reach)).distinct(), "line-small")

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    several = materialize(by_fp.where("lines > 1").select("fp"), "line-several")
    active = small.select(F.col("f1").alias("fp")).union(small.select("f2")).union(several)
    active = materialize((active if rows is None else active.union(rows.select("fp"))).distinct(), "line-active")
    alone = materialize(join_checked(nodes, active, "fp", "left_semi", bound=1_000_000).select("id", "fp", "chars"), "line-candidates")
    texts = _texts(source, nodes, alone)
    pair = F.when(F.col("f1") != F.col("f2"), _near("f1", "f2", reach)).otherwise(F.col("a1") < F.col("a2"))

    def lines_of(fps: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
        """Pairs of lines ``a1, a2`` not known to be connected, of pairs ``f1, f2``."""
        one, two = (of.select(F.col("fp").alias(f"f{n}"), F.col("id").alias(f"a{n}"), F.col("g").alias(f"g{n}"), F.col("chars").alias(f"n{n}")) for n, of in ((1, first), (2, second)))
        fits = F.least("n1", "n2") >= F.greatest("n1", "n2") * F.lit(min_similarity)
        return fps.distinct().join(one, "f1").join(two, "f2").where(pair & (F.col("g1") != F.col("g2")) & fits).select("a1", "a2")

    same = several.select(F.col("fp").alias("f1"), F.col("fp").alias("f2"))
    links = None
    if lead:
        # one line for each fingerprint with one partner, the others of a fingerprint with it,
        # and two leaders a key
        every = alone.withColumn("g", F.col("id"))
        reps = every.groupBy("fp").agg(F.min("id").alias("id"), F.min_by("chars", "id").alias("chars")).withColumn("g", F.col("id"))
        near = small.groupBy("f2").agg(F.min("f1").alias("f1")).select("f1", "f2")
        if rows is not None:
            led = rows.select(F.explode(F.array(_ordered(least, F.col("fp")), _ordered(most, F.col("fp")))).alias("p")).select("p.*")
            near = near.union(led.where((F.col("f1") != F.col("f2")) & _near("f1", "f2", reach)))
        pairs = materialize(lines_of(near, reps, reps).unionByName(lines_of(same, reps, every)), "line-pairs")
        links = _verified(texts, pairs, min_similarity)
        release(pairs)
        parts = connected_components(links, "line-parts").select(F.col("node").alias("id"), F.col("component").alias("g"))
        groups = materialize(alone.join(parts, "id", "left").select("id", "fp", "chars", F.coalesce("g", "id").alias("g")), "line-groups")
    else:
        groups = alone.withColumn("g", F.col("id"))
    near = small
    if rows is not None:
        placed = rows.select("key", "fp").join(groups.groupBy("fp").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("chars").alias("least"), F.max("chars").alias("most")), "fp")
        apart = placed.groupBy("key").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("n")).where("l <> h")
        still = materialize(placed.join(apart.select("key", F.expr(f"(n + {_SHARE - 1}) div {_SHARE}").alias("shares")), "key"), "line-still")
        # one side of a key is dealt to its shares, each of which meets the whole other side
        share = {1: F.pmod(F.xxhash64("fp"), "shares"), 2: F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))}
        one, two = (still.select("key", share[n].alias("share"), F.col("fp").alias(f"f{n}"), F.col("lo").alias(f"l{n}"), F.col("hi").alias(f"h{n}"), F.col("least").alias(f"n{n}"), F.col("most").alias(f"m{n}")) for n in (1, 2))
        apart = (F.col("l1") != F.col("l2")) | (F.col("h1") != F.col("h2")) | (F.col("l1") != F.col("h1"))
        # no line of either is too short for all of the other's
        fits = (F.col("m1") >= F.col("n2") * F.lit(min_similarity)) & (F.col("m2") >= F.col("n1") * F.lit(min_similarity))
        near = near.union(one.join(two, (one["key"] == two["key"]) & (one["share"] == two["share"]) & (F.col("f1") < F.col("f2")) & apart & fits & _near("f1", "f2", reach)).select("f1", "f2"))
    pairs = materialize(lines_of(near.union(same), groups, groups), "line-pairs")
    more = _verified(texts, pairs, min_similarity) if pairs.take(1) else None
    links = more if links is None else links if more is None else links.unionByName(more)
    if links is None:
        links = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    release(shared, blocks, rows, small, several, active, alone, groups, by_fp, pairs, texts)
    parts = connected_components(links, "lines")
    at = join_checked(nodes, parts.select(F.col("node").alias("id"), "component"), "id", "left").select("k", "first", F.coalesce("component", "id").alias("root"))
    roots = materialize(parts.select(F.col("component").alias("root")).distinct(), "line-roots")
    linked = join_checked(at, roots, "root", "left_semi")
    lead = materialize(linked.groupBy("root").agg(F.min(F.struct("first", "k")).alias("lead")), "line-leads")
    named = materialize(join_checked(at, lead, "root", "left").select("k", F.coalesce("lead", F.struct("first", "k")).alias("lead")), "line-names")
    out = lines.drop("blocks").join(named, "k")
    kept = (F.col("k") == F.col("lead.k")) & F.col("doc_id").eqNullSafe(F.col("lead.first.doc_id")) & (F.col("line_no") == F.col("lead.first.line_no"))
    return out.select("doc_id", "line_no", F.lower(F.hex("k")).alias("line_md5"), F.col("lead.first.doc_id").alias("first_doc"), F.col("lead.first.line_no").alias("first_line"), kept.alias("kept"))


def drop_lines(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that don't stay cut out of ``text_col``; every other
    column passes through, and a document without dropped lines is unchanged. A line goes
    by id, place and content, so a document that shares the id keeps its own lines."""
    of, out_lines = fresh(docs, "gone_of"), fresh(docs, "gone")
    gone = decisions.where("not kept").groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.concat_ws(":", "line_no", "line_md5")).alias(out_lines))
    lines = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(out_lines, F.concat_ws(":", i, F.md5(normalised(line))))), "\n")
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col(of)), "left")
    return out.withColumn(text_col, F.when(F.col(out_lines).isNull(), F.col(text_col)).otherwise(left)).drop(of, out_lines)
