"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Hashing tokens into parts and XOR-ing them gives a
parity sketch: tokens that two sets share cancel out, so the Hamming distance of two bit sketches, and the
number of parts in which two sketches differ, is at most the size of the symmetric difference. For Jaccard
t and sizes a and b that is at most (1 - t) / (1 + t) * (a + b).

Pigeonhole join. Sizes fall into bands [2^i, 2^(i+1)); a set joins in its own band and, if a partner can be
that large, in the next one, as a guest. In a band all sets have the same number of parts, about twice the
largest distance d. Two sets within d differ in d parts at most, so of the parts that are not empty (their
signature) all but d agree, and so the d + 1 that come first in any common order share one. The order puts
signatures that a sample of documents found frequent last: a passage that many documents share is no
candidate by itself. (The sample changes cost alone.) If a set has d parts or fewer that are not empty, its
single tokens join as parts of their own, which is exact too.

Buckets with the same members are one bucket. Rounds of stars follow: in every bucket whose members lie in
two components or more, the member with the most company over all buckets, and the one with the most among
those outside its component, are compared with all others; sizes and the Hamming distance of parity
sketches decide first, then the exact intersection. A member that has been compared with its whole bucket
leaves it, and components are contracted, so a group of near copies costs a few stars and not its pairs.
When rounds find next to nothing, all pairs that are left in a bucket, in different components, are
compared in the same way: no link between components is lost, and pairs inside one need no check.

Equal sets are one class, named by a 64-bit hash of its tokens; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded, each_text, in_batches, longs, lower_ascii, mix, written
from .components import components

SHINGLE, PERCENT = 5, 80
SKETCH_BITS = 1024
#: Signatures that come last in the join's order: at most so many, found in the documents whose id hashes to 0 modulo SAMPLE.
FREQUENT, SAMPLE, OFTEN = 400_000, 8, 3
#: A frequent signature's rows are spread over so many places by their class.
SALTS = 4096
#: Rounds end when one finds fewer links than this share (one in so many) of the rows that are still open.
ROUND_SHARE = 100
_BATCH_TOKENS = 500_000


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes; a shorter text is one shingle, one without words has none."""
    words = hashes.of(lower_ascii(text).split())
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        out = np.full(max(1, n - width + 1), min(n, width), np.uint64)
        for k in range(min(n, width)):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return np.unique(out)


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 is the empty set's."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        total = mix(tokens, 5).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.asarray([total]), 6).view(np.int64)[0])


def _spaces(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, largest distance to a partner met there) for a set of n tokens."""
    band, out = n.bit_length() - 1, []
    largest = n * 100 // percent  # of a partner
    for space in (band, band + 1):
        top = min(largest, (2 << space) - 1)
        if top >= 1 << space:  # partners of this band exist
            out.append((space, (100 - percent) * (n + top) // (100 + percent)))
    return out


def _parts(space: int, percent: int) -> int:
    """Parts of a sketch in a band: twice the largest distance there, and two at least."""
    return max(2, 2 * ((100 - percent) * 2 * ((2 << space) - 1) // (100 + percent)))


def _signature(tokens: np.ndarray, parts: int, space: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR of the tokens of each part that has any, and how many there are. Sorted tokens keep a part's together."""
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    value = np.bitwise_xor.reduceat(mix(tokens, 7), starts)
    return mix(value ^ (part[starts] << np.uint64(8)) ^ np.uint64(space), 8), np.diff(starts, append=len(tokens))


def _keys(tokens: np.ndarray, percent: int, frequent: np.ndarray | None) -> list:
    """Join keys of a set, and which of them are frequent. frequent: sorted signatures that come last; None: all signatures."""
    out = []
    for space, distance in _spaces(len(tokens), percent):
        value, count = _signature(tokens, _parts(space, percent), space)
        both = [(value, count)]
        if len(value) <= distance:
            both.append((mix(tokens ^ np.uint64(space), 9), np.ones(len(tokens), np.int64)))
        for value, count in both:
            if frequent is None:
                out.append(value)
                continue
            late = np.zeros(len(value), bool)
            if len(frequent):
                late = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value
            order = np.lexsort((value, -count, late))[: distance + 1]
            out.append((value[order], late[order]))
    return out


def _counted(width: int, percent: int):
    """All signatures of each text, for finding the frequent ones."""

    def emit(batches):
        hashes = WordHashes()
        for batch in batches:
            for text in each_text(batch.column(0)):
                values = _keys(shingles(text, width, hashes), percent, None)
                if values:
                    yield pa.RecordBatch.from_arrays([longs(np.concatenate(values))], names=["key"])

    return emit


def _emit(width: int, percent: int, frequent):
    """A row of size and class for each document, and a row for each of its join keys, in one pass.

    Rows of documents have n; keys have none, and a salt: frequent ones are spread by the class's hash.
    """

    def batch_of(parts):
        key, name, salt, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = pa.array(n, pa.int64(), mask=n < 0)
        return pa.RecordBatch.from_arrays([longs(key), longs(name), pa.array(salt, pa.int32()), sizes], names=["key", "class", "salt", "n"])

    def emit(batches):
        hashes = WordHashes()
        for batch in batches:
            parts, size = [], 0
            ids = batch.column(0).to_pylist()
            yield_rows = []
            for doc, text in zip(ids, each_text(batch.column(1)), strict=True):
                tokens = shingles(text, width, hashes)
                name = class_of(tokens)
                yield_rows.append((doc, name, len(tokens)))
                if doc is None or not len(tokens):
                    continue
                for values, late in _keys(tokens, percent, frequent.value):
                    spread = np.where(late, name % SALTS, -1).astype(np.int32)
                    parts.append((values, np.full(len(values), name, np.int64), spread, np.full(len(values), -1, np.int64)))
                    size += len(values)
                if size > _BATCH_TOKENS:
                    yield batch_of(parts)
                    parts, size = [], 0
            if parts:
                yield batch_of(parts)
            docs, names, sizes = (list(x) for x in zip(*yield_rows, strict=True)) if yield_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.int64()), pa.nulls(len(docs), pa.int32()), pa.array(sizes, pa.int64())], names=["key", "class", "salt", "n"])

    return emit


def _shared(batches):
    """Of rows sorted by (key, salt, class): (key, class), each once, of keys that have two classes or are frequent."""
    last = None  # key, salt, class of the row before
    lonely = None  # the only class of the last key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, name = (np.asarray(c) for c in batch.columns)
        new = np.ones(len(key), bool)  # a key begins
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        new[0] = last is None or (key[0], salt[0]) != last[:2]
        again = np.zeros(len(key), bool)
        again[1:] = ~new[1:] & (name[1:] == name[:-1])
        again[0] = not new[0] and name[0] == last[2]
        fresh = np.flatnonzero(~again)
        key, salt, name, new = key[fresh], salt[fresh], name[fresh], new[fresh]
        last_row = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py(), batch.column(2)[-1].as_py())
        if len(key):
            follows = np.append(~new[1:], False)  # the next row is of the same key
            keep = ~new | follows | (salt >= 0)
            out_key, out_name = key[keep], name[keep]
            if lonely is not None and not new[0]:
                out_key, out_name = np.append(out_key, lonely[0]), np.append(out_name, lonely[1])
            lonely = (key[-1], name[-1]) if new[-1] and not keep[-1] else None
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_name, pa.int64())], names=["key", "class"])
        last = last_row


def _lists(rows) -> pa.RecordBatch:
    """A batch of class and four lists, each laid out once; an absent list is null."""
    names, columns = [r[0] for r in rows], []
    for k in range(1, 5):
        lists = [r[k] for r in rows]
        none = np.array([x is None for x in lists] + [False])
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in lists)])
        values = [x for x in lists if x is not None]
        offsets = pa.array(ends, pa.int32(), mask=none)
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values) if values else np.empty(0, np.int64))))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *columns], names=["class", "sketch", "wide", "half", "tokens"])


def _folded(bits: np.ndarray) -> np.ndarray:
    """A parity sketch of half as many bits."""
    return bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]


def _sets(width: int):
    """class, its tokens, its parity sketch of SKETCH_BITS, and for sets that are large beside that a wide one.

    A wide sketch has twice as many bits as the set's band begins at; halved it can be held against the next band's.
    """

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            rows, size = [], 0
            for text in each_text(batch.column(0)):
                tokens = shingles(text, width, hashes)
                n = len(tokens)
                bits = max(SKETCH_BITS, 1 << n.bit_length())
                parity = (np.bincount((mix(tokens, 10) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                wide = half = None
                if bits > SKETCH_BITS:
                    wide, half = np.packbits(parity).view(np.int64), np.packbits(_folded(parity)).view(np.int64)
                while len(parity) > SKETCH_BITS:
                    parity = _folded(parity)
                rows.append((class_of(tokens), np.packbits(parity).view(np.int64), wide, half, tokens.view(np.int64)))
                size += n
                if size > _BATCH_TOKENS:
                    yield _lists(rows)
                    rows, size = [], 0
            if rows:
                yield _lists(rows)

    return sets


def _light(sets: DataFrame, side: str) -> DataFrame:
    """class as `side`, its size and its sketches."""
    words = [F.col("sketch")[k].alias(f"{side}_{k}") for k in range(SKETCH_BITS // 64)]
    return sets.select(F.col("class").alias(side), F.size("tokens").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}"), F.col("half").alias(f"half_{side}"), *words)


def _may_be_similar(percent: int) -> F.Column:
    """For rows with _light of a and b: sizes and Hamming distances allow the similarity."""
    apart = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        apart = apart + F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}")))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    most = (F.col("n_a") + F.col("n_b")) * (100 - percent)

    def distance(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, bits: total + bits)

    same = F.when(F.size("wide_a") == F.size("wide_b"), distance("wide_a", "wide_b"))
    wide = same.when(F.size("wide_a") > F.size("wide_b"), distance("half_a", "wide_b")).otherwise(distance("wide_a", "half_b"))
    both = F.col("wide_a").isNotNull() & F.col("wide_b").isNotNull()
    return sizes & (apart * (100 + percent) <= most) & F.when(both, wide * (100 + percent) <= most).otherwise(True)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of a written table of pairs (a, b), those whose sets are similar, written. Only sets asked for are moved."""
    asked = bounded(written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "asked"))
    needed = sets.join(asked, "class", "left_semi")
    for side in ("a", "b"):
        pairs = pairs.join(needed.select(F.col("class").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    similar = pairs.where(shared * 100 >= (F.size("tokens_a") + F.size("tokens_b") - shared) * percent)
    return written(similar.select("a", "b"), "verified")


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), each once, those whose sizes and sketches allow the similarity; written."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return written(pairs.join(_light(sets, "a"), "a").join(_light(sets, "b"), "b").where(_may_be_similar(percent)).select("a", "b"), "near")


def _merged(buckets: DataFrame) -> DataFrame:
    """One bucket (key, class) of those with the same classes."""
    name = F.struct(F.count("*"), F.min("class"), F.max("class"), F.bit_xor(F.xxhash64("class")), F.bit_xor(F.xxhash64("class", F.lit(1))))
    same = buckets.groupBy("key").agg(name.alias("members"), F.count("*").alias("size")).where("size > 1")
    return buckets.join(same.groupBy("members").agg(F.min("key").alias("key"), F.first("size").alias("size")).select("key", "size"), "key")


def _open(members: DataFrame) -> DataFrame:
    """The rows of buckets whose classes lie in two components or more."""
    split = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return members.join(split, "key", "left_semi")


def _linked(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class, root: the components of similar classes that buckets (key, class, size) bring together."""
    weight = buckets.groupBy("class").agg(F.sum("size").alias("weight"))
    members = buckets.select("key", "class").join(weight, "class").select("key", "class", "weight", F.col("class").alias("root"))
    members, links = written(members, "members"), None
    while True:
        best = F.max_by(F.struct("class", "root"), F.struct("weight", "class"))
        first = members.groupBy("key").agg(best.alias("one"))
        at = members.join(first, "key")
        second = at.where(F.col("root") != F.col("one.root")).groupBy("key").agg(best.alias("two"), F.first("one").alias("one"))
        centers = written(second.select("key", F.explode(F.array("one", "two")).alias("center")), "centers")
        stars = members.join(centers, "key").where(F.col("root") != F.col("center.root"))
        near = _candidates(stars.select(F.col("center.class").alias("a"), F.col("class").alias("b")), sets, percent)
        found = _verified(near, sets, percent)
        n = found.count()
        left = members.join(centers.select("key", "center.class"), ["key", "class"], "left_anti")
        if n:
            links = found if links is None else links.unionByName(found)
            known = components(_between(found, members))
            left = left.join(known.withColumnRenamed("root", "new"), F.col("root") == F.col("node"), "left")
            left = left.select("key", "class", "weight", F.coalesce("new", "root").alias("root"))
        members = written(_open(left), "members")
        if n * ROUND_SHARE <= members.count():
            break
    side = lambda s: members.select("key", F.col("class").alias(s), F.col("root").alias(f"root_{s}")).join(_light(sets, s), s)
    a, b = side("a"), side("b").withColumnRenamed("key", "other")
    across = a.join(b, (F.col("key") == F.col("other")) & (F.col("root_a") < F.col("root_b")) & _may_be_similar(percent)).select("a", "b").distinct()
    more = _verified(written(across, "near"), sets, percent)
    return components(more if links is None else links.unionByName(more))


def _between(found: DataFrame, members: DataFrame) -> DataFrame:
    """Links of classes as links of their components."""
    roots = members.select("class", "root").distinct()
    for side in ("a", "b"):
        found = found.join(roots.select(F.col("class").alias(side), F.col("root").alias(f"root_{side}")), side)
    return found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable by links).

    A text of fewer words than a shingle is one shingle; a null text, or one without words, has none, links
    with nothing and is its own component. Rows with equal sets are linked. A row without an id has no
    component_id and joins no one to others. Rows that repeat an id are documents of their own. Texts may
    be of any length. An empty table gives an empty result; other columns, whatever their names, are not
    looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    sample = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    common = in_batches(sample, _counted(shingle, percent), "key long").groupBy("key").count().where(F.col("count") >= OFTEN)
    common = common.orderBy(F.desc("count"), "key").limit(FREQUENT).select("key").toArrow()["key"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(common.astype(np.int64).view(np.uint64)))
    emitted = written(in_batches(rows, _emit(shingle, percent, frequent), "key long, class long, salt int, n long"), "signatures")
    profile = emitted.where("n IS NOT NULL").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "class")
    classes = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first_id"))
    keys = emitted.where("n IS NULL").select("key", "salt", "class").repartition("key", "salt").sortWithinPartitions("key", "salt", "class")
    buckets = written(_merged(written(in_batches(keys, _shared, "key long, class long"), "shared")), "buckets")
    asked = classes.join(buckets.select("class").distinct(), "class").select(F.col("first_id").alias("doc_id"))
    ids = bounded(written(asked, "candidates"))
    sets = in_batches(named.join(ids, "doc_id", "left_semi").select("text"), _sets(shingle), "class long, sketch array<long>, wide array<long>, half array<long>, tokens array<long>")
    roots = _linked(buckets, written(sets.dropDuplicates(["class"]), "sets"), percent)
    # classes get their documents' smallest ids only now: what was linked so far are contents
    named_classes = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    lowest = named_classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = written(named_classes.join(lowest, "root").select("class", "component_id"), "class-components")
    return profile.join(of_class, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns whatever their names, without the rows whose component has a smaller id. Rows without an id stay."""
    groups = similar_groups(docs, id_col, text_col)
    gone = bounded(written(groups.where("component_id < doc_id").select("doc_id").distinct(), "near-copies"))
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[p : p + 4], ' ')) AS h FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS u(p) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
