"""Token counts without token ids: byte-pair merging on a heap and a linked list.

A text's count equals its initial symbols minus the merges that the ranks allow,
so no identifier is looked up or emitted. The tokenizer file gives the merge
ranks, the pattern that splits text and the special strings.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import hold, slices

#: Pre-tokens whose counts a worker keeps (about 160 bytes each); past it the memory starts anew.
CACHE_WORDS = 1_000_000

#: The white space of Unicode, as the tokenizer file's pattern means it.
WHITE = "\\t-\\r" + "".join(map(chr, (0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                      0x205F, 0x3000)))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings: printable
    bytes stand for themselves, the others for letters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under one word-level BPE file (json)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.letters = byte_letters()
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", WHITE)
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one pre-token: pop the lowest-ranked adjacent pair, join it,
        offer its two new neighbours; ties go to the leftmost pair."""
        symbols = [self.letters[b] for b in word.encode()]
        n = len(symbols)
        if not n:
            return 0
        symbols[-1] += self.end
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, heap = self.rank.get, []
        for i in range(n - 1):
            if (r := rank((symbols[i], symbols[i + 1]))) is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue                                    # a neighbour has been merged meanwhile
            count -= 1
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return count

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        words = self.pieces(text.lower())
        got = list(map(self.cache.get, words))
        if None in got:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            for k, n in enumerate(got):
                if n is None:
                    if (n := self.cache.get(words[k])) is None:
                        n = self.cache[words[k]] = self.merged(words[k])
                    got[k] = n
        return sum(got)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.lru_cache(maxsize=2)
def counter(spec: str) -> MergeCounter:
    return MergeCounter(json.loads(spec))


def token_counts(docs: DataFrame, spec: str, limit: int = 2048, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``spec`` is the content of the tokenizer's json file: bounded (a vocabulary)
    and broadcast once. Begin, end and padding tokens are not counted; special
    strings inside a text count as one token each, as the library does it.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; a null id stays null; an empty table gives an empty result; other
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        own = counter(shared.value)
        hold("tokens", own.cache.clear)
        for b in slices(batches):
            n = np.fromiter(map(own.count, b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
