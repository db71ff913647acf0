"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes its set of hashed five-word shingles; the set's
   fingerprint, its size and its ``SKETCH`` smallest hashes are kept.
2. Equal sets are one vertex, named by their smallest doc_id.
3. Inverted lists over retained hashes generate overlaps. A retained hash whose
   list is longer than ``HOT`` is *hot* and ranks behind all others, in every
   sketch alike; the first ``INDEX`` hashes that are not hot are indexed, so that
   no list is longer than ``HOT`` and passages that very many documents share
   make no pairs.
4. Documents with two fifths of their sketch or more hot are *family*: copies of one
   text, or texts made mostly of common passages. (Of others over three fifths are
   cold, and a partner shares some of that: at the threshold, if all differences are
   cold, more than half.) Pairs of two family documents are found on their full sets. Of
   each set the rarest ``n - ceil(0.75 n) + 1`` shingles are listed, those common in
   families last; two sets at the threshold share one of them. Pairs with a rare
   shingle in common come from short lists. Others share common ones only, so that
   all rare shingles of both are differences, which bounds the sizes that a partner
   can have and how many places of the order need be listed: an isolated edited copy
   has few or no partners left. Long lists are first compared with a leader for each
   size, the document with the largest common share; then, in each list, those that
   links have not brought into its largest component are compared with the list's
   members of possible sizes in other components; bitmaps of both sets' common
   shingles bound from below what each lacks of the other. No list is expanded into pairs,
   and none is cut.
5. The sketch of the union estimates each candidate's similarity; candidates far
   below the threshold go. The rest is confirmed on full sets, read from the texts.
6. Confirmed links are closed to components.

A pair at the threshold shares none of 24 indexed hashes with a probability of
about 1e-12, none of 12 with one of about 1e-7, and is estimated below ``PASS`` with
one of about 1e-7. A pair exactly at the threshold that shares hot shingles alone, so that
at most a quarter of the larger text is cold, is missed if more than three fifths of its
64 sampled hashes are cold, with a probability of about 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwell.llm.text import mix, pieces, pieces_by_size, shingle_sets
from gridwell.operators.components import connected_components
from gridwell.session import drop_written, passing, written

SKETCH = 64
INDEX = 24
HOT = 32
PASS = 0.45
LEADER_ROUNDS = 2
#: Leaders of a list's main component, for each size class.
LEADERS = 8
#: Places of the order that leaders are chosen in; the later comparison uses all.
LEADER_PLACES = 4
#: 64-bit words of the bitmap of a set's common shingles.
WORDS = 16
#: Size classes for each doubling of a set's size.
CLASSES = 16

_SIGNATURE = "doc_id long, n long, k1 long, k2 long, sketch array<long>"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked at a Jaccard similarity of 0.75 or more of their distinct
    five-word shingles (A-Z lower-cased, words between ASCII white space; fewer
    words: one shingle of all). ``component_id`` is the smallest doc_id that links
    reach, ``kept`` whether that is the row's own. Null, empty and blank texts have
    no shingles and no links. Rows that repeat a doc_id are one document: the links
    of each are links of all. A null doc_id has a null component and is kept. Other
    columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(source.mapInArrow(_signatures, _SIGNATURE), "signatures")
    sets = signed.where("n > 0 and doc_id is not null")
    firsts = written(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "sets")
    vertices = written(
        sets.join(firsts.select(F.col("k1"), F.col("k2"), F.col("id").alias("doc_id")), ["k1", "k2", "doc_id"])
        .dropDuplicates(["k1", "k2", "doc_id"])
        .select(F.col("doc_id").alias("id"), "n", "sketch"),
        "vertices",
    )
    repeated = sets.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same = sets.join(repeated, "doc_id").join(firsts, ["k1", "k2"]).select(F.col("doc_id").alias("src"), F.col("id").alias("dst"))
    whole = passing(lambda: connected_components(_links(vertices, source).union(same)))
    drop_written(vertices)
    named = firsts.join(whole, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("found"))
    keyed = signed.select("doc_id", "n", "k1", "k2")
    component = F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return (
        keyed.join(named, ["k1", "k2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _links(vertices: DataFrame, source: DataFrame) -> DataFrame:
    """Confirmed links (src, dst) between vertices."""
    lists = vertices.select(F.explode("sketch").alias("h"))
    hot = written(lists.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot")
    marked = (
        vertices.select("id", F.explode("sketch").alias("h")).join(hot, "h").groupBy("id").agg(F.collect_set("h").alias("hot"))
    )
    ranked = written(
        vertices.join(marked, "id", "left")
        .withColumn("cold", F.array_except("sketch", F.coalesce("hot", F.array().cast("array<long>"))))
        .select(
            "id",
            "n",
            "sketch",
            F.slice("cold", 1, INDEX).alias("indexed"),
            (5 * F.size("cold") <= 3 * F.size("sketch")).alias("family"),
            ((F.size("cold") >= INDEX) & (3 * F.size("cold") >= 2 * F.size("sketch"))).alias("full"),
        ),
        "ranked",
    )
    rare, common = _family_lists(ranked, source)
    near = _estimated(_overlaps(ranked).union(_listed_pairs(rare)).distinct(), ranked)
    links = _confirmed(near, source)
    for _ in range(LEADER_ROUNDS):
        own = _with_components(common, links)
        top = F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("id")).alias("id")))
        # some of the main component, from as many parts of it, and one of the others
        part = F.when(F.expr("component <=> main"), F.pmod(F.xxhash64("id"), F.lit(LEADERS)))
        leaders = own.groupBy("h", "class", part.alias("part")).agg(top.alias("top")).select("h", "class", (-F.col("top.id")).alias("a"))
        others = own.where(f"not component <=> main and place < {LEADER_PLACES}")
        pairs = others.join(leaders, ["h", "class"]).where("id != a").select("a", F.col("id").alias("b")).distinct()
        links = links.union(_confirmed(_estimated(pairs, ranked), source))
    return links.union(_confirmed(_estimated(_remaining(common, links), ranked), source))


def _family_lists(ranked: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of family documents' full sets the shingles that a partner must share one of.

    Rare ones as (h, id, n), and common ones as (h, id, n, m, place, class): ``m`` of
    the set's ``n`` shingles are common, ``place`` is the shingle's among them.
    """
    ids = ranked.where("family").select("id")
    sets = written(_texts(ids, source).select("id", "text").mapInArrow(_full_sets, "id long, k long, n long, hs array<long>"), "sets").dropDuplicates(["id", "k"])
    entries = sets.select("id", "k", F.explode("hs").alias("h"))
    frequent = written(entries.groupBy("h").count().where(F.col("count") > HOT).select("h"), "frequent")
    marked = entries.join(frequent, "h").groupBy("id", "k").agg(F.sort_array(F.collect_set("h")).alias("common"))
    least = F.ceil(F.col("n") * 3 / 4).cast("int")
    none = F.array().cast("array<long>")
    placed = written(
        sets.join(marked, ["id", "k"], "left")
        .withColumn("common", F.coalesce("common", none))
        .withColumn("rare", F.sort_array(F.array_except("hs", "common")))
        .select(
            "id",
            "n",
            F.size("common").alias("m"),
            F.array(*map(_bits, range(WORDS))).alias("bits"),
            F.slice("rare", F.lit(1), F.col("n").cast("int") - least + 1).alias("rare"),
            F.slice("common", F.lit(1), F.greatest(F.size("common") - least + 1, F.lit(0))).alias("common"),
        ),
        "placed",
    )
    rare = placed.select(F.explode("rare").alias("h"), "id", "n")
    common = placed.select("id", "n", "m", "bits", _size_class(F.col("n")).alias("class"), F.posexplode("common").alias("place", "h"))
    return rare, written(common.select("h", "id", "n", "m", "bits", "place", "class"), "common")


def _bits(word: int) -> Column:
    """A word of the bitmap of common shingles."""
    own = F.filter("common", lambda h: F.pmod(h, F.lit(WORDS)) == word)
    return F.aggregate(own, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))))


def _lacking(of: str, other: str) -> Column:
    """At most as many as the common shingles of one that the other lacks."""
    return sum((F.bit_count(F.col(of)[i].bitwiseAND(F.bitwise_not(F.col(other)[i]))) for i in range(WORDS)), F.lit(0))


def _size_class(n: Column) -> Column:
    return F.floor(CLASSES * F.log2(n)).cast("int")


def _listed_pairs(rare: DataFrame) -> DataFrame:
    """Pairs (a, b) of possible sizes in lists, which have at most ``HOT`` sets."""
    lists = rare.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("xs")).where(F.size("xs") > 1)
    pairs = F.transform(
        "xs",
        lambda x, i: F.transform(
            F.filter(F.slice("xs", i + 2, F.size("xs")), lambda y: _near_in_size(x["n"], y["n"])),
            lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")),
        ),
    )
    return lists.select(F.explode(F.flatten(pairs)).alias("p")).select("p.*").where("a != b").distinct()


def _with_components(common: DataFrame, links: DataFrame) -> DataFrame:
    """``common`` with each entry's component and ``main``, that of most of its list, null where all differ."""
    met = connected_components(links)
    own = common.join(met, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = own.groupBy("h", "component").count()
    main = counted.groupBy("h").agg(F.max(F.struct("count", "component")).alias("top")).select("h", F.when(F.col("top.count") > 1, F.col("top.component")).alias("main"))
    return written(own.join(main, "h"), "own")


def _remaining(common: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of the sets outside a list's main component with those of possible sizes
    in other components."""
    own = _with_components(common, links)
    # n + size of the other <= 7/3 of what both can share
    room = F.floor(7 * (F.col("m") - F.col("place")) / 3) - F.col("n")
    x = (
        own.where("not component <=> main")
        .withColumn("most", F.least(room, F.floor(F.col("n") * 4 / 3)))
        .withColumn("least", F.ceil(F.col("n") * 3 / 4))
        .where("most >= least")
        .select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("m").alias("ma"), F.col("bits").alias("bits_a"), "least", "most", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))).alias("class"))
    )
    y = own.select("h", "class", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("m").alias("mb"), F.col("bits").alias("bits_b"), room.alias("most_b"))
    fits = (F.col("ca") != F.col("cb")) & F.col("nb").between(F.col("least"), F.col("most")) & (F.col("na") <= F.col("most_b"))
    shared = F.ceil(3 * (F.col("na") + F.col("nb")) / 7)
    fits &= (_lacking("bits_a", "bits_b") <= F.col("ma") - shared) & (_lacking("bits_b", "bits_a") <= F.col("mb") - shared)
    return x.join(y, ["h", "class"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _overlaps(ranked: DataFrame) -> DataFrame:
    """Pairs (a, b) that share indexed hashes, from lists of at most ``HOT`` vertices.

    Vertices with a full index and mostly cold sketches must share three hashes, others
    a single one.
    """
    item = F.struct("id", "n", "full")
    lists = (
        ranked.select(item.alias("x"), F.explode("indexed").alias("h"))
        .groupBy("h")
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .where(F.size("xs") > 1)
    )
    others = F.transform(
        "xs",
        lambda x, i: F.transform(
            F.filter(F.slice("xs", i + 2, F.size("xs")), lambda y: _near_in_size(x["n"], y["n"])),
            lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), (x["full"] & y["full"]).alias("full")),
        ),
    )
    pairs = lists.select(F.explode(F.flatten(others)).alias("p")).select("p.*").where("a != b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("full").alias("full")).where("c >= 3 or not full").select("a", "b")


def _near_in_size(x: Column, y: Column) -> Column:
    return (4 * F.least(x, y)) >= (3 * F.greatest(x, y))


def _alike(x: str, y: str) -> Column:
    """Whether the sketch of the union puts two sets near the threshold."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(x, y))) >= PASS * F.size(union)


def _estimated(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    one = ranked.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = ranked.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where(_near_in_size(F.col("na"), F.col("nb")) & _alike("sa", "sb")).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Links (src, dst) among ``pairs`` (a, b) by the similarity of their full sets."""
    return passing(lambda: _matched(pairs, source))


def _matched(pairs: DataFrame, source: DataFrame) -> DataFrame:
    pairs = written(pairs, "candidates")
    texts = _texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), source)
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return written(
        pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(_matching, "src long, dst long").distinct(), "confirmed"
    )


def _texts(ids: DataFrame, source: DataFrame) -> DataFrame:
    """Texts (id, text) of ``ids``, written. A bitmap of two bytes an id at most, and of
    8 MB at most, keeps most other texts out of the shuffle."""
    spark = ids.sparkSession
    ids = written(ids, "ids")
    count = ids.count()
    if not count:
        return spark.createDataFrame([], "id long, text string")
    bits = min(26, max(13, (16 * count).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for w, b in words.collect():
        table[w] = b
    wanted = spark.sparkContext.broadcast(table)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (wanted.value[p >> 6] >> (p & 63)) & 1 == 1
            yield batch.select([0, 1]).filter(pa.array(hit))

    return written(
        source.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").alias("id"), "text")
        .select("id", "text", place.alias("p"))
        .mapInArrow(involved, "id long, text string")
        .join(ids, "id", "left_semi"),
        "texts",
    )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_by_size(batches, 1):
        sets = shingle_sets(batch.column(1))
        ends = np.cumsum([0, *map(len, sets)])
        values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
        k = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(k), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "k", "n", "hs"]
        )


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        a, b = (c.to_pylist() for c in batch.columns[:2])
        texts = pa.chunked_array([batch.column(2), batch.column(3)]).combine_chunks().dictionary_encode()
        sets = shingle_sets(texts.dictionary)
        place = texts.indices.to_pylist()
        keep = [_linked(sets[p], sets[q]) for p, q in zip(place, place[len(a) :], strict=False)]
        rows = [(i, j) for i, j, k in zip(a, b, keep, strict=True) if k]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["src", "dst"])


def _linked(s: np.ndarray, t: np.ndarray) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= 75 * (len(s) + len(t) - common)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_by_size(batches, 1):
        n, k1, k2, flat, ends = [], [], [], [], [0]
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            m = mix(s)
            k1.append(m.sum(dtype=np.uint64))
            k2.append(np.bitwise_xor.reduce(mix(m + np.uint64(1)), initial=0) if len(s) else np.uint64(0))
            turn = np.searchsorted(s, np.uint64(1 << 63))
            low = np.concatenate([s[turn:][:SKETCH], s[:turn][:SKETCH]])[:SKETCH]
            flat.append(low)
            ends.append(ends[-1] + len(low))
        values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.array(k1, np.uint64).view(np.int64)),
                pa.array(np.array(k2, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
            ],
            ["doc_id", "n", "k1", "k2", "sketch"],
        )
