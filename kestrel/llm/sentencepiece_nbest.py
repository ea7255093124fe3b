"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has an edge for every vocabulary piece that matches.
A forward Viterbi pass gives the best score from the start to each position; a
backward A* search from the end uses these scores as exact heuristics, so it
completes segmentations in the order of their scores without detours.

Where no piece of the vocabulary spans two neighbouring characters, every segmentation
has a border. Texts are cut there (before spaces, mostly before punctuation, around line
breaks), so a text's lattice is a chain of unit lattices. A task searches each distinct
unit once; a second A* over the chain joins the units' segmentations to those of the text.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib
from bisect import insort

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import hold, slices

SPACE = "▁"
#: Segmentations kept for each text.
N_BEST = 3
#: Units a worker keeps (about 220 bytes each); past it the memory starts anew.
CACHE_UNITS = 700_000
#: Units up to this length keep their edges in memory while they are searched.
HELD_CHARS = 4096
#: Below the lowest piece score, for a character that only byte pieces can spell.
BYTES_PENALTY = 10.0

_ID = struct.Struct("<I").pack


def a_star(end: int, incoming, best: list[float], n: int) -> list[tuple[float, list]]:
    """The ``n`` best paths from node 0 to ``end``: (score, labels in order).

    ``incoming(j)`` yields (i, label, score) of the edges that end at ``j``;
    ``best[i]`` is the exact best score from 0 to ``i``. So every open entry
    stands for a path of exactly its estimate, and more than the ``n`` best
    entries never need to stay open. Of equal scores, the entry opened last is
    continued first, so ties never widen the search."""
    found, turn = [], 0
    opened = [(best[end], 0, end, 0.0, None)]            # in rising order
    while opened:
        _, _, j, behind, path = opened.pop()
        if j == 0:
            labels = []
            while path:
                label, path = path
                labels.append(label)
            found.append((behind, labels))
            n -= 1
            del opened[:max(0, len(opened) - n)]
            continue
        for i, label, score in incoming(j):
            total = behind + score
            estimate = total + best[i]
            if len(opened) >= n:
                if estimate < opened[0][0]:
                    continue
                del opened[0]
            turn += 1
            insort(opened, (estimate, turn, i, total, (label, path)))
    return found


def _unit_pattern(pieces) -> re.Pattern:
    """Finds the units of a text: a unit begins with spaces, or with a mark (no letter, digit
    or underscore) after a letter. Letters that some piece has before a mark don't count as
    letters here. Line breaks and tabs that no piece holds are units of their own."""
    alphabet = {c for p in pieces for c in p} - {SPACE}
    word, letter = re.compile(r"\w").match, re.compile(r"[^\W\d_]").match
    joined = sorted({a for p in pieces for a, b in zip(p, p[1:]) if letter(a) and not word(b) and b != SPACE})
    other, alone = "".join(map(re.escape, joined)), "".join(c for c in "\n\t\r" if c not in alphabet)
    letters, inner, rest = rf"[^\W\d_{other}]", rf"[\d_{other}]", rf"(?:[^\w {alone}]|[\d_{other}])"
    unit = rf" *{rest}*(?:{letters}+{inner}{rest}*)*{letters}*"
    word = rf" ?{letters}+(?!{inner})"                   # most units, found without the longer rule
    return re.compile("|".join([word, *([f"[{alone}]"] if alone else []), unit]))


class Pieces:
    """The vocabulary of one model file (its serialised bytes)."""

    def __init__(self, proto: bytes, dummy_prefix: bool = True):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.dummy_prefix = dummy_prefix
        self.score: dict[str, tuple[bytes, float]] = {}     # ids are held as their four bytes
        self.byte_id = [sp.unk_id()] * 256
        self.spelled: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelled.append(b"")
            else:
                self.score[piece] = (_ID(i), sp.get_score(i))
                self.spelled.append(piece.replace(SPACE, " ").encode())
        self.single = {p for p in self.score if len(p) == 1}
        automaton = ahocorasick.Automaton()
        for p, (label, score) in self.score.items():
            automaton.add_word(p, (len(p), label, score))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.longest = max(map(len, self.score))
        self.lowest = min(s for _, s in self.score.values()) - BYTES_PENALTY
        crossing = [p for p in self.score if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces that cross a word's start: {crossing[:5]}")
        self.cut = _unit_pattern(self.score).findall
        self._forget()

    def _forget(self, n: int = 1) -> None:
        """Empties the memory of units, for ``n`` segmentations each. It holds numbers
        and bytes only: nothing that the garbage collector would visit again and again."""
        self.n = n
        self.slot: dict[str, int] = {}
        self.first: list[bytes] = []                     # ids of the best segmentation,
        self.best = np.zeros(1024)                       # its score,
        self.gap = np.zeros(1024)                        # and how much less the second one has

    def _remember(self, unit: str) -> int:
        at = self.slot[unit] = len(self.first)
        (best, first), *others = self.search(unit.replace(" ", SPACE), min(self.n, 2))
        self.first.append(first)
        if at == len(self.best):
            self.best, self.gap = (np.concatenate([x, np.zeros(at)]) for x in (self.best, self.gap))
        self.best[at] = best
        self.gap[at] = best - others[0][0] if others else math.inf
        return at

    def edges(self, unit: str, j: int):
        """Edges of the unit's lattice that end at ``j``."""
        get, single = self.score.get, False
        for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
            if (hit := get(unit[i:j])) is not None:
                single |= i == j - 1
                yield i, hit[0], hit[1]
        if not single:                                   # spelled in bytes
            yield j - 1, b"".join(_ID(self.byte_id[b]) for b in unit[j - 1].encode("utf-8", "replace")), self.lowest

    def lattice(self, unit: str) -> tuple[list, list[int], list[float]]:
        """The edges of a short unit (end, (size, ids, score)) by rising ends, where those of
        each end begin, and the forward scores."""
        n = len(unit)
        if self.single.issuperset(unit):
            edges = list(self.matches(unit))
        else:                                            # some character is spelled in bytes
            edges = [(j - 1, (j - i, ids, score)) for j in range(1, n + 1) for i, ids, score in self.edges(unit, j)]
        best, begin, now = [0.0] + [-math.inf] * n, [0] * (n + 1), -1
        for k, (last, (size, _, score)) in enumerate(edges):
            if last != now:
                begin[last] = k
                now = last
            total = best[last + 1 - size] + score
            if total > best[last + 1]:
                best[last + 1] = total
        begin[n] = len(edges)
        return edges, begin, best

    def search(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a unit (spaces already marked). The edges
        of a long unit are looked up again instead of being held."""
        if len(unit) <= HELD_CHARS:
            edges, begin, best = self.lattice(unit)

            def incoming(j):
                return [(j - size, ids, score) for _, (size, ids, score) in edges[begin[j - 1]:begin[j]]]
        else:
            best = [0.0]
            for j in range(1, len(unit) + 1):
                best.append(max(best[i] + s for i, _, s in self.edges(unit, j)))

            def incoming(j):
                return self.edges(unit, j)
        return [(score, b"".join(ids)) for score, ids in a_star(len(unit), incoming, best, n)]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        units = self.cut((" " if self.dummy_prefix else "") + text.replace(SPACE, " "))
        return units[:-1]                                # the pattern also finds the empty end

    def _slots(self, units: list[str], n: int) -> list[int]:
        if self.n != n or len(self.slot) > CACHE_UNITS:
            self._forget(n)
        got = list(map(self.slot.get, units))
        if None in got:
            for k, at in enumerate(got):
                if at is None:
                    at = self.slot.get(units[k])
                    got[k] = self._remember(units[k]) if at is None else at
        return got

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations: (score, ids as 32-bit integers)."""
        units = self.units(text or "")
        if not units:
            return [(0.0, b"")]
        slots = self._slots(units, n)
        at = np.array(slots)
        total = float(self.best[at].sum())
        parts = list(map(self.first.__getitem__, slots))
        out = [(total, b"".join(parts))]
        if n == 1:
            return out
        # only the units with the n - 1 cheapest second choices can matter
        gap = self.gap[at]
        near = np.argpartition(gap, n - 2)[:n - 1] if len(gap) >= n else np.arange(len(gap))
        near = sorted(near[gap[near] < math.inf].tolist())
        ways = []
        for k in near:                                   # these few again, in full; of tied ones, the first stays
            found = self.search(units[k].replace(" ", SPACE), n)
            ways.append([(found[0][0], parts[k]), *[w for w in found if w[1] != parts[k]][:n - 1]])
        steps = [[(j, c, score - w[0][0]) for c, (score, _) in enumerate(w)] for j, w in enumerate(ways)]
        for less, choice in a_star(len(near), lambda j: steps[j - 1], [0.0] * (len(near) + 1), n):
            if len(out) == n or not any(choice):         # the best one is there already
                continue
            other = parts.copy()
            for k, w, c in zip(near, ways, choice):
                other[k] = w[c][1]
            out.append((total + less, b"".join(other)))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, np.uint32).tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces(proto: bytes) -> Pieces:
    return Pieces(proto)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, proto: bytes, n: int = N_BEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pieces array<int>, n_pieces, score, others array<struct<pieces,
    score>>, round_trip`` for every row: the best segmentation, the following
    ``n - 1`` in falling score, and whether decoding gives the text back.

    The model's bytes are bounded (a vocabulary) and broadcast once. Null and empty
    texts have no pieces, score 0, no others, and round-trip. A text that holds the
    space mark itself decodes it as a space, so it does not round-trip. Of equal
    scores the order is fixed by the search. Repeated rows are encoded each, a null
    id stays null, an empty table gives an empty result, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    flat = "pieces array<int>, n_pieces long, score double, others array<struct<pieces:array<int>,score:double>>"

    def run(batches):
        own = pieces(shared.value)
        hold("sentencepiece", own._forget)
        ints = pa.list_(pa.int32())
        other = pa.list_(pa.struct([("pieces", ints), ("score", pa.float64())]))
        as_ids = lambda b: np.frombuffer(b, np.int32)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            got = [own.encode(t, n) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([as_ids(g[0][1]) for g in got], ints),
                pa.array([len(g[0][1]) // 4 for g in got], pa.int64()), pa.array([g[0][0] for g in got], pa.float64()),
                pa.array([[{"pieces": as_ids(i), "score": s} for s, i in g[1:]] for g in got], other),
                pa.array([own.decode(g[0][1]) == (t or "") for g, t in zip(got, texts)], pa.bool_())],
                ["doc_id", "pieces", "n_pieces", "score", "others", "round_trip"])

    return _source(docs, doc_id, text).mapInArrow(run, f"doc_id long, {flat}, round_trip boolean")


def digests(docs: DataFrame, proto: bytes, n: int = N_BEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`encode`, with the segmentations' sizes, scores and checksums in
    place of the pieces: ``doc_id, n_pieces, n_best, score, last_score, pieces_crc,
    others_crc, round_trip`` (crc32 over the ids as 32-bit little-endian integers;
    ``last_score`` belongs to the last of the ``n_best``)."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches):
        own = pieces(shared.value)
        hold("sentencepiece", own._forget)
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                g = own.encode(t, n)
                crc = 0
                for _, ids in g[1:]:
                    crc = zlib.crc32(ids, crc)
                rows.append((len(g[0][1]) // 4, len(g), g[0][0], g[-1][0], zlib.crc32(g[0][1]), crc,
                             own.decode(g[0][1]) == (t or "")))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                ["doc_id", "n_pieces", "n_best", "score", "last_score", "pieces_crc", "others_crc", "round_trip"])

    return _source(docs, doc_id, text).mapInArrow(
        run, "doc_id long, n_pieces long, n_best long, score double, last_score double, pieces_crc long, "
             "others_crc long, round_trip boolean")


def decode(encoded: DataFrame, proto: bytes, doc_id: str = "doc_id", ids: str = "pieces") -> DataFrame:
    """``doc_id, text`` of rows with piece ids (null ids: null text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(proto)

    def run(batches):
        own = pieces(shared.value)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, np.uint32).tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("pieces")) \
        .mapInArrow(run, "doc_id long, text string")
