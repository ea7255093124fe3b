"""Phrase collocations from a weighted de Bruijn graph of word n-grams.

Only the longest grams are counted in texts: a trigram is an edge from the node of its
first two words to the node of its last two, weighted with its occurrences. Shorter counts
follow from the graph: a bigram's count is the flow out of its node plus the pieces that
end with it, a word's count the flow out of the bigrams that begin with it plus the pieces
that end with it. Each task builds and reduces the graph of its texts; graphs are added up.

Most grams are rare and decide nothing. A first pass adds up weights by hash, in buckets,
and marks the hashes that reach the minimum in a bitmap of fixed size; the second pass
ships only grams whose hash is marked, as numbers into the words of their block. Hashes that
meet only mark too much, so counts stay exact.

Heavy edges (weight at least the minimum) are compacted: a node with one heavy edge in and
one out, both as heavy as all of the node's flow, is unary, and stretches of unary nodes
become one path, found by pointer doubling. A bigram inside a path occurs as often as the
path, so a longer phrase stands for it; an edge tells the length of its path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import CLEAN, buckets, discard, mixed, settings, slices, written

LEAST, TOP = 10, 2000
#: A longer candidate with at least this many percent of a phrase's count stands for it.
COVERED = 50
SCALE = 1_000_000
#: Bytes and rows of texts whose graph is built at once.
GRAPH_BYTES, GRAPH_ROWS = 6 << 20, 1 << 16
#: Bits of the bitmap's size (16 MB).
MARK_BITS = 27
#: Bytes of a bucket's blocks that are added up at once, and rows of a batch that leaves a task.
HELD, SENT_ROWS = 32 << 20, 1 << 16
#: A mark for the end of a piece; it ends pieces itself, so it is no word.
END = "."

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class LocalGraph:
    """The graph of some texts: unique edges with their weights, node and word flows, hashes."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), "[.,;:!?\\n-\\r]", f" {END} ")
        lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(END, spaced, f"{END} {END}", " "))
        words = pc.list_flatten(lists).dictionary_encode()
        code, self.words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        kinds = langs.dictionary_encode()
        self.langs = kinds.dictionary
        owner = np.repeat(kinds.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        k = self.k = len(self.words)
        end = pc.index(self.words, END).as_py()
        # marks begin and end each text, so no gram spans texts; k stands for what an end of a piece cuts off
        word = code[:-2] != end
        a, b, c = code[:-2][word], code[1:-1][word], code[2:][word]
        two = b != end
        three = two & (c != end)
        pairs, which = np.unique((owner[:-2][word] * k + a) * (k + 1) + np.where(two, b, k), return_inverse=True)
        edges, self.n = np.unique(which * (k + 1) + np.where(three, c, k), return_counts=True)
        self.third = edges % (k + 1)
        self.node = edges // (k + 1)                                  # number of the edge's node
        self.one, self.second = pairs // (k + 1), pairs % (k + 1)     # language and word, second word
        self.flow = np.bincount(self.node, weights=self.n, minlength=len(pairs)).astype(np.int64)
        self.firsts, at = np.unique(self.one, return_inverse=True)
        self.uses = np.bincount(at, weights=self.flow, minlength=len(self.firsts)).astype(np.int64)

        plain = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()), np.uint64, k)
        self.tongue = tongue = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.langs.to_pylist()), np.uint64, len(self.langs))
        plain = np.append(plain, np.uint64(0))
        with np.errstate(over="ignore"):
            by_word = mixed(plain[self.firsts % k] * _FACTOR + tongue[self.firsts // k]) if k else np.zeros(0, np.uint64)
            by_node = mixed(by_word[at] * _FACTOR + plain[self.second])
            by_edge = mixed(by_node[self.node] * _FACTOR + plain[self.third])
        self.edges, self.nodes = np.flatnonzero(self.third < k), np.flatnonzero(self.second < k)
        self.hashes = (by_word, by_node[self.nodes], by_edge[self.edges])
        self.weights = (self.uses, self.flow[self.nodes], self.n[self.edges])

    def chosen(self, kept: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Words, ``codes``, counts and hashes of the grams chosen (words, nodes, edges), and of totals (no
        words). ``codes`` has a row for each of language, first, second and third word: places in the
        words from 1, 0 for none."""
        w, v = np.flatnonzero(kept[0]), self.nodes[kept[1]]
        e, k = self.edges[kept[2]], max(self.k, 1)
        totals = np.bincount(self.firsts // k, weights=self.uses, minlength=len(self.langs)).astype(np.int64)
        none = lambda *x: np.full(sum(map(len, x)), -1)
        first = np.concatenate([self.firsts[w], self.one[v], self.one[self.node[e]]])
        codes = np.stack([np.r_[first // k, np.arange(len(totals))] + self.k, np.r_[first % k, none(totals)],
                          np.r_[none(w), self.second[v], self.second[self.node[e]], none(totals)], np.r_[none(w, v), self.third[e], none(totals)]])
        words = pa.concat_arrays([x.cast(pa.binary()) for x in (self.words, self.langs)])
        return (words, codes + 1, np.concatenate([self.uses[w], self.flow[v], self.n[e], totals]),
                np.concatenate([*(h[x] for h, x in zip(self.hashes, kept)), self.tongue]))

    def rows(self, kept: list[np.ndarray]) -> pa.RecordBatch:
        return as_rows(*self.chosen(kept)[:3])

    def blocks(self, kept: list[np.ndarray], deal: int) -> pa.RecordBatch:
        """``bucket, rows, words, size, block`` of what is chosen; buckets are the first ``deal`` bits of the hash."""
        words, codes, n, hashes = self.chosen(kept)
        bucket = (hashes >> np.uint64(64 - deal)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        codes, n = codes[:, order], n[order]
        cuts = np.searchsorted(bucket[order], np.arange((1 << deal) + 1)).tolist()
        got = [(i, *packed(words, codes[:, x:y], n[x:y])) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], t) for j, t in enumerate((*[pa.int32()] * 4, pa.binary()))],
                                          ["bucket", "rows", "words", "size", "block"])


def as_rows(words: pa.Array, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """``lang, x, y, z, n`` of a block of grams."""
    words = words.cast(pa.string())
    return pa.RecordBatch.from_arrays([*(words.take(pa.array(c - 1, mask=c == 0)) for c in codes), pa.array(n)], ["lang", "x", "y", "z", "n"])


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte of all: the upper bytes compress away."""
    return np.ascontiguousarray(x.astype("<u4").ravel().view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed(words: pa.Array, codes: np.ndarray, n: np.ndarray) -> tuple[int, int, int, bytes]:
    """A block of grams with only the words that it has: their number, that of the words, bytes unpacked, bytes."""
    used, at = np.unique(codes, return_inverse=True)
    own = words.take(pa.array(used[used > 0] - 1))
    raw = b"".join([_planes(at.reshape(codes.shape) + (used[0] > 0)), _planes(n), _planes(pc.binary_length(own).to_numpy()), *own.to_pylist()])
    return codes.shape[1], len(own), len(raw), pa.compress(raw, "zstd", asbytes=True)


def unpacked(rows: int, words: int, size: int, block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, codes and counts of a block."""
    raw = np.frombuffer(pa.decompress(block, size, "zstd", asbytes=True), np.uint8)
    codes, n, lengths, data = np.split(raw, np.cumsum([16 * rows, 4 * rows, 4 * words]))
    edges = np.r_[0, np.cumsum(_whole(lengths))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), words, [None, pa.py_buffer(edges), pa.py_buffer(data.tobytes())]), _whole(codes).reshape(4, rows), _whole(n)


def added(blocks: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One block of all of ``blocks``: each gram once, with the sum of its counts."""
    words = pa.concat_arrays([w for w, _, _ in blocks]).dictionary_encode()
    place, at, codes = words.indices.to_numpy() + 1, 0, []
    for own, c, _ in blocks:
        codes.append(np.r_[0, place[at:at + len(own)]][c])
        at += len(own)
    codes, n = np.concatenate(codes, axis=1), np.concatenate([n for _, _, n in blocks])
    front, back = (codes[i] * (len(words.dictionary) + 1) + codes[i + 1] for i in (0, 2))
    order = np.lexsort((back, front))
    front, back = front[order], back[order]
    first = np.flatnonzero(np.r_[True, (front[1:] != front[:-1]) | (back[1:] != back[:-1])])
    return words.dictionary, codes[:, order[first]], np.add.reduceat(n[order], first)


def _dense(keys: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits as their steps, byte by byte of all: the upper bytes compress away."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _keys(dense: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(dense, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _graphs(batches):
    for b in slices(batches, 1, GRAPH_ROWS, GRAPH_BYTES):
        yield LocalGraph(b.column(0), b.column(1))


def marks(texts: DataFrame, least: int, bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` positions: the first bits of the hashes whose weights add up to
    ``least`` or more in all texts. Hashes are dealt to buckets by these bits, so a bucket makes its
    own part of the bitmap; of a gram, each task's slice has one entry, whatever its count."""
    deal = min(buckets(texts.sparkSession), bits - 3)
    kind = np.uint8 if least < 256 else np.uint32

    def spread(batches):
        for g in _graphs(batches):
            keys, weights = np.concatenate(g.hashes), np.minimum(np.concatenate(g.weights), least).astype(kind)
            order = np.argsort(keys)
            keys, weights = keys[order], weights[order]
            edges = np.searchsorted(keys, np.arange(1 << deal, dtype=np.uint64) << np.uint64(64 - deal))
            short = (keys >> np.uint64(32 - deal)).astype(np.uint32)    # the 32 bits behind the bucket's
            cuts = [*edges.tolist(), len(keys)]
            got = [(i, _dense(short[s:e]), weights[s:e].tobytes()) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                             ["bucket", "keys", "weights"])

    def summed(keys, weights):
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order].astype(np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint32(1) if len(keys) else 0))
        return keys[first], np.minimum(np.add.reduceat(weights, first), least).astype(kind)

    def part(keys, weights):
        found, n = summed(keys, weights)
        out = np.zeros(1 << (bits - deal), bool)
        out[(found[n >= least] >> np.uint32(32 - (bits - deal))).astype(np.int64)] = True
        return np.packbits(out, bitorder="little").tobytes()

    def merge(batches):
        own, keys, weights, size = None, [], [], 0
        for b in batches:
            for bucket, k, w in zip(*(c.to_pylist() for c in b.columns)):
                if own is not None and bucket != own:
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([part(keys, weights)], pa.binary())], ["bucket", "part"])
                    keys, weights, size = [], [], 0
                own = bucket
                keys.append(_keys(k))
                weights.append(np.frombuffer(w, kind))
                size += len(keys[-1])
                if size > 1 << 24:                     # the same hashes of many slices are one entry
                    k, w = summed(keys, weights)
                    keys, weights, size = [k], [w], 0
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([part(keys, weights)], pa.binary())], ["bucket", "part"])

    blobs = texts.mapInArrow(spread, "bucket int, keys binary, weights binary")
    parts = written(blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, part binary"), "marks")
    out = np.zeros((1 << deal, 1 << (bits - deal - 3)), np.uint8)
    for r in parts.toLocalIterator():                  # the bitmap in parts: its size is fixed
        out[r["bucket"]] = np.frombuffer(r["part"], np.uint8)
    discard(parts)
    return out.ravel()


def graph(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text", bits: int = MARK_BITS) -> DataFrame:
    """``lang, x, y, z, n``: all edges (three words), nodes (two) and words that occur ``least`` times
    or more, with their counts; the row without words has all words of the language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shared, deal = docs.sparkSession.sparkContext.broadcast(marks(texts, least, bits)), buckets(docs.sparkSession)

    def spread(batches):
        marked = shared.value
        for g in _graphs(batches):
            kept = []
            for h in g.hashes:
                place = h >> np.uint64(64 - bits)
                kept.append((marked[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
            yield g.blocks(kept, deal)

    def rows(blocks):
        words, codes, n = added(blocks)
        kept = (n >= least) | (codes[1] == 0)
        out = as_rows(words, codes[:, kept], n[kept])
        for i in range(0, out.num_rows, SENT_ROWS):
            yield out.slice(i, SENT_ROWS)

    def merge(batches):
        own, blocks, size = None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                bucket, *block = (x[i].as_py() for x in b.columns)
                if own is not None and bucket != own:
                    yield from rows(blocks)
                    blocks, size = [], 0
                own = bucket
                blocks.append(unpacked(*block))
                size += block[2]
                if size > HELD:                        # the same grams of many slices are one entry
                    blocks, size = [added(blocks)], 0
        if own is not None:
            yield from rows(blocks)

    return written(texts.mapInArrow(spread, "bucket int, rows int, words int, size int, block binary").repartition("bucket").sortWithinPartitions("bucket")
                   .mapInArrow(merge, "lang string, x string, y string, z string, n long"), "graph")


def nodes(grams: DataFrame) -> DataFrame:
    """``lang, x, y, f, covering, unary, before`` of the bigrams: ``f`` is their count, ``covering``
    the weight of the heaviest edge at the node, ``before`` the word before a unary node."""
    edge, node = F.col("z").isNotNull(), F.col("y").isNotNull() & F.col("z").isNull()
    none = F.lit(None)
    flow = grams.filter(node).select("lang", "x", "y", F.col("n").alias("f"), none.cast("long").alias("out"), none.cast("long").alias("into"),
                                     none.cast("string").alias("before"))
    out = grams.filter(edge).select("lang", "x", "y", none.cast("long").alias("f"), F.col("n").alias("out"), none.cast("long").alias("into"),
                                    none.cast("string").alias("before"))
    into = grams.filter(edge).select("lang", F.col("y").alias("x"), F.col("z").alias("y"), none.cast("long").alias("f"), none.cast("long").alias("out"),
                                     F.col("n").alias("into"), F.col("x").alias("before"))
    grouped = flow.unionByName(out).unionByName(into).groupBy("lang", "x", "y").agg(*[F.max(c).alias(c) for c in ("f", "out", "into", "before")])
    # an edge as heavy as all of the node's flow is its only one, and no piece begins or ends there
    unary = F.coalesce((F.col("out") == F.col("f")) & (F.col("into") == F.col("f")), F.lit(False))
    return grouped.select("lang", "x", "y", "f", F.greatest("out", "into").alias("covering"), unary.alias("unary"), F.when(unary, F.col("before")).alias("before"))


def compacted(node: DataFrame) -> DataFrame:
    """``lang, x, y, root_x, root_y, place, inner`` of the unary nodes: the first unary node of their
    path, their place behind it, and the number of unary nodes of the path.

    Each node points to the one before it if that is unary too; pointers are doubled until all
    point to a first one, so a path of any length takes a logarithmic number of joins. Flow enters
    a ring of nodes from outside, so no ring is all unary."""
    unary = node.filter("unary").select("lang", "x", "y", "before")
    first = unary.select("lang", F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    back = unary.select("lang", "x", "y", F.col("before").alias("to_x"), F.col("x").alias("to_y"))
    inner = back.join(first, ["lang", "to_x", "to_y"], "left_semi").select("lang", "x", "y", "to_x", "to_y", F.lit(1).cast("long").alias("d"))
    heads = back.join(first, ["lang", "to_x", "to_y"], "left_anti").select(
        "lang", "x", "y", F.lit(None).cast("string").alias("to_x"), F.lit(None).cast("string").alias("to_y"), F.lit(0).cast("long").alias("d"))
    jump = written(inner.unionByName(heads), "jumps")
    while True:
        far = jump.select("lang", F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("to_x").alias("far_x"), F.col("to_y").alias("far_y"),
                          F.col("d").alias("more"))
        moved = F.col("far_x").isNotNull()
        step = written(jump.join(far, ["lang", "to_x", "to_y"], "left").select(
            "lang", "x", "y", F.coalesce("far_x", "to_x").alias("to_x"), F.coalesce("far_y", "to_y").alias("to_y"),
            (F.col("d") + F.when(moved, F.col("more")).otherwise(0)).alias("d"), moved.alias("moved")), "jumps")
        jump = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    placed = jump.select("lang", "x", "y", F.coalesce("to_x", "x").alias("root_x"), F.coalesce("to_y", "y").alias("root_y"), F.col("d").alias("place"))
    return placed.join(placed.groupBy("lang", "root_x", "root_y").agg(F.count(F.lit(1)).alias("inner")), ["lang", "root_x", "root_y"])


def paths(grams: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, n``: the compacted paths as texts, each once. A path is as long as the
    passage that it comes from."""
    node = nodes(grams)
    chain = compacted(node)
    heads = node.filter("unary").select("lang", F.col("x").alias("root_x"), F.col("y").alias("root_y"), "before", F.col("f").alias("n"))
    edge = grams.filter(F.col("z").isNotNull()).select("lang", "x", "y", "z")
    after = chain.join(edge, ["lang", "x", "y"])
    texts = after.groupBy("lang", "root_x", "root_y").agg(F.array_sort(F.collect_list(F.struct("place", "y", "z"))).alias("steps"))
    inside = F.array_join(F.transform("steps", lambda s: s["y"]), " ")
    last = F.element_at("steps", -1)["z"]
    return texts.join(heads, ["lang", "root_x", "root_y"]).select(
        "lang", F.concat_ws(" ", "before", "root_x", inside, last).alias("phrase"), (F.size("steps") + 3).cast("long").alias("n_words"), "n")


def candidates(grams: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score, path_words`` of all candidates that no longer one covers."""
    node = written(nodes(grams), "nodes")
    chain = compacted(node)
    word = grams.filter(F.col("x").isNotNull() & F.col("y").isNull()).select("lang", "x", F.col("n").alias("f"))
    edge = grams.filter(F.col("z").isNotNull())
    tail = node.select("lang", "x", "y", F.col("f").alias("tail_f"))
    head = node.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("f").alias("head_f"))
    tail_path = chain.select("lang", "x", "y", F.col("inner").alias("tail_inner"))
    head_path = chain.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("inner").alias("head_inner"))
    three = (edge.join(tail, ["lang", "x", "y"]).join(head, ["lang", "y", "z"]).join(tail_path, ["lang", "x", "y"], "left")
             .join(head_path, ["lang", "y", "z"], "left")
             .select("lang", "x", F.col("z").alias("last"), F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("n").alias("a"), "tail_f", "head_f",
                     (F.coalesce("tail_inner", "head_inner", F.lit(0)) + 3).cast("long").alias("path_words")))
    free = F.col("covering").isNull() | (100 * F.col("covering") < COVERED * F.col("f"))
    none = F.lit(None).cast("long")
    two = node.filter(free).select("lang", "x", F.col("y").alias("last"), F.concat_ws(" ", "x", "y").alias("phrase"), F.col("f").alias("a"),
                                   none.alias("tail_f"), none.alias("head_f"), F.lit(2).cast("long").alias("path_words"))
    both = two.unionByName(three).join(word.withColumnRenamed("f", "first_f"), ["lang", "x"]).join(
        word.select("lang", F.col("x").alias("last"), F.col("f").alias("last_f")), ["lang", "last"])
    cuts = both.withColumns({"r1": F.coalesce("head_f", "last_f"), "l2": F.col("tail_f")})
    wide = lambda c: f"cast({c} as decimal(15,0))"
    score = lambda l, r: F.expr(f"(cast({SCALE} as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide(l)} * {wide(r)})")
    scored = cuts.withColumns({"s1": score("first_f", "r1"), "s2": score("l2", "last_f")})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    return scored.select("lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("first_f")).alias("l"),
                         F.when(second, F.col("last_f")).otherwise(F.col("r1")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"),
                         "path_words")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, path_words``: each language's first ``top`` phrases.

    Null texts are empty, a null language is ``und``; a language without candidates has no rows;
    repeated rows count each; ties are in the order of count and phrase (UTF-8 bytes), so the result
    is unique; an empty table gives an empty result; other columns are not read. A text of any
    length is one slice of work. ``path_words`` is the number of words of the compacted path that
    the phrase lies on (its own number if that is no longer)."""
    with settings(docs.sparkSession, CLEAN):
        grams = graph(docs, least, lang, text)
        found = candidates(grams)
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of each share of a language, then the first of these: no language is one task's sort
    shares = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    local = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("share")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = grams.filter(F.col("x").isNull()).select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


#: DuckDB's form of :func:`collocations`, without ``path_words``.
ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
tokens AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, w[i] AS x, NULL AS y, NULL AS z FROM tokens
  UNION ALL SELECT lang, w[i], w[i + 1], NULL FROM tokens WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, w[i], w[i + 1], w[i + 2] FROM tokens WHERE i + 2 <= len(w)),
f AS (SELECT lang, x, y, z, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, count(*) AS n FROM tokens GROUP BY lang),
one AS (SELECT lang, x, n FROM f WHERE y IS NULL),
two AS (SELECT lang, x, y, n FROM f WHERE y IS NOT NULL AND z IS NULL),
three AS (SELECT lang, x, y, z, n FROM f WHERE z IS NOT NULL AND n >= {LEAST}),
covering AS (SELECT lang, x, y, max(n) AS m FROM (SELECT lang, x, y, n FROM three UNION ALL SELECT lang, y, z, n FROM three) GROUP BY lang, x, y),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.n AS a, p.n AS l, q.n AS r, 1 AS k
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  LEFT JOIN covering c ON c.lang = t.lang AND c.x = t.x AND c.y = t.y
  WHERE t.n >= {LEAST} AND (c.m IS NULL OR 100 * c.m < {COVERED} * t.n)
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.n, p.n, q.n, 1
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.n, p.n, q.n, 2
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
scored AS (SELECT *, ({SCALE}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
