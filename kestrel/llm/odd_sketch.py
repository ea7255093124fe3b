"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document is its set of word shingles. MinHash samples give band keys for candidates
and are folded into a parity bitmap (odd sketch): the number of bits in which two
bitmaps differ estimates their similarity, precisely for similar sets. Candidates
that pass the estimate are confirmed on their full sets.

Components need no list of all pairs. First each document meets the likeliest of its
buckets' pivots, and confirmed links are joined to components. What is left are buckets
that hold several components: there, the documents outside the bucket's main component
are compared with its documents by their sketches, in blocks of bounded size. A document
gets one row for each other component that it may belong to, with its likeliest partner
there. If that partner isn't confirmed, the document meets all of the component, again
in blocks, where sketches and full sets are compared in the task and only links come out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import hold, mixed, slices, written
from kestrel.llm.components import components

#: Documents are linked from this similarity on (in hundredths), on shingles of so many words.
SIMILAR, WORDS = 80, 5
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 2.6e-8.
BANDS, ROWS = 44, 5
SAMPLES = BANDS * ROWS
BITS = 1024
#: Estimates below this are not confirmed: 4.4 standard errors under 0.8.
LEAST_ESTIMATE = 0.68
#: Pivots confirmed for a document at first; members of a block; candidates of a confirming group.
PIVOTS, BLOCK, GROUP = 3, 512, 256

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2))


MULTIPLY, TOGGLE = _constants()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's words (A-Z lower-cased);
    a text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mixed(out * _STEP + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and odd sketch of a non-empty set."""
    low = np.empty(SAMPLES, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, SAMPLES, BANDS):
            x = s[None, :] ^ TOGGLE[at:at + BANDS, None]
            x *= MULTIPLY[at:at + BANDS, None]
            x.min(axis=1, out=low[at:at + BANDS])
        keys = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = mixed(keys * _STEP + low[r * BANDS:(r + 1) * BANDS])
        place = mixed(low + np.arange(SAMPLES, dtype=np.uint64) * _STEP) % np.uint64(BITS)
    parity = np.bincount(place.astype(np.int64), minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(parity.astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches."""
    share = np.minimum(2.0 * differing / BITS, 0.999999)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-share)


def similar(common: int | np.ndarray, a, b):
    return 100 * common >= SIMILAR * (a + b - common)


def signatures(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, print, bands, sketch`` for every row; the last three are null for an
    empty set. Equal sets have equal prints."""
    def run(batches):
        hold("sets", lambda: None)
        for b in slices(batches):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            signs = [signature(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([x[0] for x in signs], pa.list_(pa.int64())), pa.array([x[1] for x in signs], pa.binary())],
                ["doc_id", "n", "print", "bands", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, print binary, bands array<long>, sketch binary")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``x, y`` pairs with the similarity that their sketches estimate, where it and the
    sizes leave 0.8 possible."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (2, 3))
            e = estimate(np.bitwise_count(a ^ c).sum(axis=1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e)], ["x", "y", "e"]).filter(
                pa.array(e >= LEAST_ESTIMATE))

    near = pairs.join(side("x"), "x").join(side("y"), "y").filter(
        100 * F.least("nx", "ny") >= SIMILAR * F.greatest("nx", "ny"))
    return near.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long, e double")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``x, y`` whose full sets are similar enough.

    Pairs meet ``y``'s set by a join whose skewed keys Spark splits; the sets of up to
    ``GROUP`` candidates then meet one copy of ``x``'s set in a task."""
    order = Window.partitionBy("x").orderBy("y")
    grouped = pairs.withColumn("group", F.floor((F.row_number().over(order) - 1) / GROUP).cast("int"))
    right = grouped.join(sets.select(F.col("rep").alias("y"), "items"), "y").select("x", "group", "y", "items")
    left = grouped.select("x", "group").distinct().join(sets.select(F.col("rep").alias("x"), "items"), "x").select(
        "x", "group", F.lit(None).cast("long").alias("y"), "items")

    def run(batches):
        own, bases = None, []
        for b in slices(batches, 3):
            out = []
            for x, g, y, items in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(items, np.uint64)
                if y is None:
                    bases = [*bases, s] if own == (x, g) else [s]
                    own = (x, g)
                elif any(similar(len(np.intersect1d(a, s, assume_unique=True)), len(a), len(s)) for a in bases):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    together = left.unionByName(right).repartition("x", "group").sortWithinPartitions("x", "group", F.col("y").asc_nulls_first())
    return together.mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """``rep, items``: the full sets of the wanted documents, made from their texts again."""
    def run(batches):
        for b in slices(batches):
            items = [shingles(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(items, pa.binary())], ["rep", "print", "items"])

    src = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    made = src.join(wanted, "rep").select("rep", "text", "print").mapInArrow(run, "rep long, print binary, items binary")
    # a repeated id may stand for several texts: those that the prints were made of
    return made.filter(F.md5("items") == F.lower(F.hex("print"))).drop("print")


def _runs(batches, key: tuple[int, ...]):
    """Runs of rows that agree in the columns of ``key``."""
    held: list[tuple] = []
    now = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            own = tuple(row[k] for k in key)
            if held and own != now:
                yield held
                held = []
            now = own
            held.append(row)
    if held:
        yield held


def _pivot(key: str, rep: str) -> Column:
    """Orders a bucket's members differently in each bucket."""
    return F.struct(F.xxhash64(key, rep), F.col(rep))


def _block_pairs(members: DataFrame) -> DataFrame:
    """``x, component, y, e``: documents that may belong to another component of one of
    their buckets, with the likeliest partner there.

    ``members``: ``key, rep, component, n, sketch``. A bucket's documents outside its
    largest component are compared with all of its documents, block by block; a row comes
    out for each block that has a likely partner."""
    by_part = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    buckets = by_part.groupBy("key").agg(
        F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    open_ = buckets.filter("parts > 1").select(
        "key", F.col("main.component").alias("main"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("rights"),
        F.ceil((F.col("all") - F.col("main.size")) / BLOCK).cast("int").alias("lefts"))
    rows = members.join(open_, "key")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "rep", "component", "n", "sketch", F.lit(1).alias("is_right")]
    right = rows.select(*kept, part("rights").alias("j"), upto("lefts").alias("i"))
    left = rows.filter("component <> main").select(*kept[:-1], F.lit(0).alias("is_right"), part("lefts").alias("i"),
                                                   upto("rights").alias("j"))

    def compare(rows):
        """One block; the documents outside the main component come first."""
        reps, comps, sizes = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(-1, BITS // 64)
        outside = sum(1 for r in rows if not r[5])
        out = []
        for i in range(outside):
            n, m = sizes[i], sizes[outside:]
            js = outside + np.flatnonzero((comps[outside:] != comps[i]) & (100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m)))
            if not len(js):
                continue
            e = estimate(np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64))
            js, e = js[e >= LEAST_ESTIMATE], e[e >= LEAST_ESTIMATE]
            best: dict = {}
            for j, one in zip(js.tolist(), e.tolist()):
                if (one, -reps[j]) > best.get(comps[j], (-1.0, 0)):
                    best[comps[j]] = (one, -reps[j])
            out += [(reps[i], c, -y, one) for c, (one, y) in best.items()]
        return out

    def run(batches):
        for rows in _runs(batches, (0, 6, 7)):
            if found := compare(rows):
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["x", "component", "y", "e"])

    cells = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "is_right")
    return cells.select("key", "rep", "component", "n", "sketch", "is_right", "i", "j").mapInArrow(
        run, "x long, component long, y long, e double")


def _against_components(pairs: DataFrame, labels: DataFrame, light: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of documents ``x`` with any document of a ``component``: one at most
    for each block. ``labels``: ``rep, component`` of all documents; a component's documents
    and those that ask for it are cut into blocks, and each pair of blocks is a cell."""
    wide = light.join(sets, "rep")
    asked = pairs.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lefts"))
    inside = labels.join(asked, "component")
    sized = inside.groupBy("component", "lefts").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rights"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = inside.join(sized.select("component", "rights"), "component").select(
        "component", "rep", F.lit(1).alias("is_right"), upto("lefts").alias("i"), part("rights").alias("j"))
    left = pairs.select("component", F.col("x").alias("rep")).join(sized, "component").select(
        "component", "rep", F.lit(0).alias("is_right"), part("lefts").alias("i"), upto("rights").alias("j"))
    cells = left.unionByName(right).join(wide, "rep").select("component", "i", "j", "rep", "is_right", "n", "sketch", "items")

    def run(batches):
        for rows in _runs(slices(batches, 7), (0, 1, 2)):
            outside = [r for r in rows if not r[4]]
            others = rows[len(outside):]
            reps, sizes = (np.array([r[k] for r in others], np.int64) for k in (3, 5))
            sketch = np.frombuffer(b"".join(r[6] for r in others), np.uint64).reshape(-1, BITS // 64)
            found = []
            for x in outside:
                e = estimate(np.bitwise_count(sketch ^ np.frombuffer(x[6], np.uint64)).sum(axis=1, dtype=np.int64))
                ok = np.flatnonzero((e >= LEAST_ESTIMATE) & (100 * np.minimum(sizes, x[5]) >= SIMILAR * np.maximum(sizes, x[5])))
                own = np.frombuffer(x[7], np.uint64)
                for j in ok[np.argsort(-e[ok], kind="stable")].tolist():
                    s = np.frombuffer(others[j][7], np.uint64)
                    if similar(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s)):
                        found.append((x[3], reps[j]))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "is_right").mapInArrow(
        run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id``: the smallest id reachable over links of similarity 0.8 or more
    (exact on full sets; ties at 0.8 count). Null, empty and word-less texts have an
    empty set and are linked with nothing. Rows that share an id are one node, linked
    by any of their texts. A null id is linked with nothing: its ``component_id`` is
    null and it is kept. An empty table gives an empty result; other columns are not
    read."""
    signs = written(signatures(docs, words, doc_id, text), "signs")
    some = signs.filter("n > 0 AND doc_id IS NOT NULL")
    reps = written(some.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                                             F.first("sketch").alias("sketch")), "reps")
    same = reps.select("print", "rep")
    # an id with several texts: its sets are one node (a link without confirmation)
    shared_id = some.join(same, "print").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = some.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q").select("doc_id")
    known = shared_id.join(several.withColumnRenamed("doc_id", "a"), "a", "left_semi")

    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(_pivot("key", "rep")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(keys.join(buckets.select("key", F.col("first.rep").alias("pivot")), "key"), "members")

    # each document against the likeliest of its buckets' pivots
    light = reps.select("rep", "n", "sketch")
    stars = members.filter("rep <> pivot").select(F.col("rep").alias("x"), F.col("pivot").alias("y")).distinct()
    best = written(_estimated(stars, light).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("e"), "y")))
                   .filter(F.col("r") <= PIVOTS).select("x", "y"), "best")
    ends = lambda p: p.select(F.explode(F.array("x", "y")).alias("rep")).distinct()
    sets = written(_full_sets(docs, ends(best).join(same, "rep"), words, doc_id, text), "sets")
    links = written(_confirmed(best, sets).unionByName(known), "links")
    parts = components(links)

    def label(frame: DataFrame, c: str, name: str) -> DataFrame:
        """The component of the document ``c``: itself if it has no link."""
        own = parts.select(F.col("node").alias(c), F.col("component").alias(name))
        return frame.join(own, c, "left").withColumn(name, F.coalesce(name, c))

    # buckets that hold several components: the likeliest partner in each other component
    placed = label(members.select("key", "rep"), "rep", "component").join(light, "rep")
    near = written(_block_pairs(placed).groupBy("x", "component").agg(F.max_by("y", F.struct("e", -F.col("y"))).alias("y")), "near")
    if not near.isEmpty():
        pairs = near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        sets = written(_full_sets(docs, ends(pairs).join(sets, "rep", "left_anti").join(same, "rep"), words, doc_id, text)
                       .unionByName(sets), "sets")
        links = written(links.unionByName(_confirmed(pairs, sets)), "links")
        parts = components(links)
        # those that are still apart meet all of the other component
        apart = label(label(near.select("x", F.col("component").alias("c")), "x", "own"), "c", "component") \
            .filter("own <> component").select("x", "component").distinct()
        labels = label(light.select("rep"), "rep", "component")
        several = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("component")
        apart = written(apart.join(several, "component", "left_semi"), "apart")
        if not apart.isEmpty():
            inside = labels.join(apart.select("component").distinct(), "component", "left_semi")
            lacking = inside.select("rep").join(sets, "rep", "left_anti").join(same, "rep")
            sets = written(_full_sets(docs, lacking, words, doc_id, text).unionByName(sets), "sets")
            links = written(links.unionByName(_against_components(apart, inside, light, sets)), "links")
            parts = components(links)

    found = signs.select("doc_id", F.col("n").alias("n_shingles"), "print").join(same, "print", "left").join(
        parts.withColumnRenamed("node", "rep"), "rep", "left")
    chosen = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id")).cast("long")
    return found.select("doc_id", "n_shingles", chosen.alias("component_id"),
                        F.coalesce(F.col("doc_id") == chosen, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns: of each component the rows with
    its smallest id, and all rows with a null id."""
    dropped = near_duplicates(docs, words, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, F.col(doc_id) == F.col("__dropped"), "left_anti")
